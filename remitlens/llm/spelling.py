"""Spelling variants of the words of a corpus, linked at one edit.

Two words one edit apart share their beginning up to the edit or their end after
it. The vocabulary is therefore sorted twice, forwards and backwards, and cut into
lists of words with a common beginning: two code points forwards, three backwards.
Every pair lies in exactly one list, told by where its first difference is. A list
longer than ``MOST`` is cut again: by the length of the shorter word, then at the
middle of what may still differ, until only one code point is open; the alphabet
bounds such lists. So the lists of any vocabulary are short and no word is left out.

A list is scanned in sorted order. The banded rows of the edit matrix of a prefix
serve all words that share it: the next word starts at the row of its common prefix
with the word before. Rows are kept for all words of the list at once and dropped
for those that the prefix already puts more than one edit away; once none is left,
all words with that prefix are skipped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.store import pinned, prepare

SHORTEST = 5
FEWEST = 3
#: Words of a list that is scanned as it is.
MOST = 2048
#: One in so many (document, word) pairs loses a code point.
DELETED = 97
_RUN = re.compile("[a-zÀ-ÿ]+")
_CHUNK = 1 << 20
_FLUSH = 200_000
_FAR = 9
#: So few asking words are handled without arrays.
_FEW = 24


# --- vocabulary ---------------------------------------------------------------------------------


def _chunks(text: str):
    """A long text in parts of about a million code points that end where a run ends."""
    at = 0
    while at < len(text):
        stop = at + _CHUNK
        if stop < len(text):
            run = _RUN.match(text, stop)
            stop = run.end() if run else stop
        yield text[at:stop]
        at = stop


def _count_words(batches):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    total: Counter = Counter()

    def out():
        rows = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=schema)
        total.clear()
        return rows

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if not text:
                continue
            found: Counter = Counter()
            for part in _chunks(text.encode().lower().decode()):  # bytes: A-Z alone
                found.update(_RUN.findall(part))
            seed = zlib.crc32(f"{doc_id}:".encode() if doc_id is not None else b":")
            for run, n in found.items():
                h = zlib.crc32(run.encode(), seed)
                if h % DELETED == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
                if len(run) >= SHORTEST:
                    total[run] += n
            if len(total) > _FLUSH:
                yield out()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of all whole texts of ``docs(doc_id, text)`` with at least five code points and three occurrences."""
    prepare(docs.sparkSession)
    counted = docs.select("doc_id", "text").mapInArrow(_count_words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)


# --- scan of one sorted list --------------------------------------------------------------------


def _next_row(letter: str, p: int, last: tuple[np.ndarray, np.ndarray], letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of the prefix of ``p`` letters from that of ``p - 1``: the asking words still within one edit, and their cells."""
    asking, above = last
    cells = above + (letters[asking, p - 1 : p + 2] != ord(letter))
    cells[:, :2] = np.minimum(cells[:, :2], above[:, 1:] + 1)
    cells[:, 1] = np.minimum(cells[:, 1], cells[:, 0] + 1)
    cells[:, 2] = np.minimum(cells[:, 2], cells[:, 1] + 1)
    # columns behind the end of an asking word don't exist
    cells[p - 1 + np.arange(3) > lengths[asking][:, None]] = _FAR
    near = cells.min(1) <= 1
    return asking[near], cells[near].astype(np.int8)


def _next_few(letter: str, p: int, last: list[tuple], words: list[str]) -> list[tuple]:
    """The same for a few asking words, without arrays."""
    out = []
    for i, a, b, c in last:
        word = words[i]
        n = len(word)
        x = min(a + (word[p - 2 : p - 1] != letter), b + 1) if p > 1 else b + 1
        y = min(b + (word[p - 1] != letter), c + 1, x + 1) if p <= n else _FAR
        z = min(c + (word[p] != letter), y + 1) if p < n else _FAR
        x = x if p - 1 <= n else _FAR
        if x < 2 or y < 2 or z < 2:
            out.append((i, x, y, z))
    return out


def one_edit(words: list[str]) -> list[tuple[int, int]]:
    """(i, j): all ordered pairs of distinct ``words`` exactly one edit apart, by one scan of the sorted list."""
    order = sorted(range(len(words)), key=words.__getitem__)
    lengths = np.array([len(w) for w in words], np.int64)
    # code points of the asking words, between columns of nothing
    letters = np.full((len(words), int(lengths.max(initial=0)) + 4), -1, np.int32)
    for i, w in enumerate(words):
        letters[i, 1 : len(w) + 1] = np.frombuffer(w.encode("utf-32-le"), np.int32)
    # rows[p]: asking words that prefix p leaves open, and their cells for columns p - 1, p and p + 1
    rows: list = [(np.arange(len(words)), np.tile(np.array([_FAR, 0, 1], np.int8), (len(words), 1)))]
    found: list[tuple[int, int]] = []
    before, dead = "", None
    for place in order:
        word = words[place]
        common = 0
        for a, b in zip(word, before):
            if a != b:
                break
            common += 1
        before = word
        if dead is not None and common >= dead:
            continue  # a shared prefix that is too far from everyone
        dead = None
        del rows[common + 1 :]
        for p in range(len(rows), len(word) + 1):
            row = rows[-1]
            if isinstance(row, tuple):
                row = _next_row(word[p - 1], p, row, letters, lengths)
                if len(row[0]) <= _FEW:
                    row = [(i, *cells) for i, cells in zip(row[0].tolist(), row[1].tolist())]
            else:
                row = _next_few(word[p - 1], p, row, words)
            rows.append(row)
            if not row:
                dead = p
                break
        else:
            row = rows[-1]
            if isinstance(row, tuple):
                row = [(i, *cells) for i, cells in zip(row[0].tolist(), row[1].tolist())]
            for i, *cells in row:
                cell = len(words[i]) - len(word) + 1
                if 0 <= cell <= 2 and cells[cell] == 1:
                    found.append((i, place))
    return found


# --- lists --------------------------------------------------------------------------------------


def _keyed(rows: DataFrame) -> DataFrame:
    """Key of the list that a row (word, n, m, head, tail, low, high) belongs to.

    All words of a list share their first ``head`` and last ``tail`` code points. It
    answers for the pairs whose shorter word has ``m`` code points (any, where 0)
    and whose common beginning has at least ``low`` and less than ``high``.
    """
    begin, end = F.substring("word", F.lit(1), F.col("head")), F.expr("right(word, tail)")
    return rows.withColumn("list", F.concat_ws(" ", "m", "head", "tail", "low", "high", begin, end))


def _halves(rows: DataFrame) -> DataFrame:
    """Rows of long lists, each once per length and half that it may be needed in."""
    length = F.length("word")
    shorter = F.when(F.col("m") == 0, F.array(length - 1, length)).otherwise(F.array("m"))
    rows = rows.withColumn("m", F.explode(shorter)).where((F.col("m") >= SHORTEST) & (F.col("m") >= F.col("head") + F.col("tail")))
    middle = F.col("head") + F.expr("(m - head - tail + 1) div 2").cast("int")
    # first difference at or after the middle: the beginning is shared up to there; before it: the end is shared from there
    later = F.struct(middle.alias("head"), F.col("tail"), F.greatest("low", middle).alias("low"), F.col("high"))
    sooner = F.struct(F.col("head"), (F.col("m") - middle).alias("tail"), F.col("low"), F.least("high", middle).alias("high"))
    cut = rows.select("word", "n", "m", F.explode(F.array(later, sooner)).alias("h")).select("word", "n", "m", "h.*")
    return cut.where("low < high")


def _lists(words: DataFrame, most: int) -> DataFrame:
    """(list, word, n): every pair one edit apart lies in one list, and no list is longer than ``most`` without need."""
    whole = lambda head, tail, low, high: words.select(
        "word", "n", F.lit(0).alias("m"), *[F.lit(v).alias(c) for c, v in (("head", head), ("tail", tail), ("low", low), ("high", high))]
    )
    rows = _keyed(whole(2, 0, 2, 1 << 30).unionByName(whole(0, 3, 0, 2)))
    done = None
    while True:
        open_ = F.when(F.col("m") == 0, F.lit(1 << 30)).otherwise(F.col("m") - F.col("head") - F.col("tail"))
        sizes = rows.groupBy("list").agg(F.count("*").alias("size"), F.first(open_).alias("open"))
        # with one open code point, and one more in longer words, a list is bounded by the alphabet
        long = sizes.where((F.col("size") > most) & (F.col("open") > 1)).select("list")
        if long.isEmpty():
            return rows if done is None else done.unionByName(rows)
        short = rows.join(long, "list", "left_anti")
        done = short if done is None else done.unionByName(short)
        rows = pinned(_keyed(_halves(rows.join(long, "list", "left_semi").drop("list"))), "spelling-lists")


def _answers(words: list[str], n: list[int], m: int, back: bool, low: int, high: int):
    """Per asking word of one list: its number of near words, the largest n among them and its first word."""
    found: dict[int, tuple[int, int, str]] = {}
    for a, b in one_edit([w[::-1] for w in words] if back else words):
        x, y = words[a], words[b]
        least = min(len(x), len(y))
        common = next((k for k in range(least) if x[k] != y[k]), least)
        if m not in (0, least) or not low <= common < high:
            continue  # another list's pair
        count, top, form = found.get(a, (0, 0, ""))
        if (-n[b], y) < (-top, form):
            top, form = n[b], y
        found[a] = count + 1, top, form
    return [(words[a], *v) for a, v in found.items()]


def _scan(batches):
    """Rows sorted by list: every list is scanned once it is whole."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
    rest: list[tuple] = []

    def answered(rows):
        _, _, _, m, head, tail, low, high = rows[0]
        # a list that shares its end is sorted from behind
        return _answers([r[1] for r in rows], [r[2] for r in rows], m, tail > head, low, high)

    for batch in batches:
        out = []
        for _, own in groupby(zip(*[c.to_pylist() for c in batch.columns]), key=itemgetter(0)):
            own = list(own)
            if rest and rest[0][0] == own[0][0]:
                rest += own
                continue
            if rest:
                out += answered(rest)
            rest = own
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)
    if rest and (out := answered(rest)):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)


def variants(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of ``words (word, n)``, distinct words of at least five code points.

    Near words are one inserted, deleted or replaced code point apart. The form of a
    word is its near word of largest n (ties: first in code-point order) if that n is
    at least twice its own; the root is the last of its chain of forms.

    Defined cases: rows with a null or shorter word or a null n are left out; words
    without a near word have n_near 0, no form and themselves as root; other columns
    are not read; an empty table gives an empty table.
    """
    prepare(words.sparkSession)
    words = pinned(words.where((F.length("word") >= SHORTEST) & F.col("n").isNotNull()).select("word", "n"), "spelling-words")
    ddl = "word string, n_near long, form_n long, form string"
    # lists are short, so none of them makes a partition uneven
    lists = _lists(words, most).select("list", "word", "n", "m", "head", "tail", "low", "high")
    found = lists.repartition("list").sortWithinPartitions("list").mapInArrow(_scan, ddl)
    # most often written first, then by code point: the smallest (-n, word)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct(-F.col("form_n"), "form")).alias("best"))
    near = words.join(best, "word", "left")
    takes = -F.col("best.col1") >= 2 * F.col("n")
    formed = pinned(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.form")).alias("form"),
            F.when(takes, -F.col("best.col1")).alias("form_n"),
        ),
        "spelling-forms",
    )
    # n doubles from form to form, so chains have fewer than 64 links and pointers that double reach every end
    steps = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(6):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if steps.join(onward, "root", "left_semi").isEmpty():
            break
        steps = pinned(steps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return formed.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))
