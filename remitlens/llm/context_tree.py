"""Code length of texts under context-tree weighting over bytes.

A text is its words, A-Z lower-cased, joined by one space, and an end byte. Each
byte is eight binary decisions, one per node of a binary tree of depth eight; each
node has a context tree of its own over the preceding bytes. A context keeps the
counts of zeros and ones seen there in the training texts, its Krichevsky-Trofimov
block probability P_e, and the weighted probability of the counts below it,
P_w = (P_e + product of the P_w of the longer contexts) / 2 (Willems, Shtarkov and
Tjalkens 1995). A prediction mixes the Krichevsky-Trofimov estimates of all depths
by the weights that the training texts leave.

Plan. (1) One pass over the texts writes blocks of bounded size: the texts, the
distinct byte grams (context and byte) with their training counts, the distinct
words with theirs. (2) Grams and words are summed over all blocks. The two longest
context depths are made in numpy, where the grams of a shorter context meet; above
them the context trees are tables, one row per (context, node), made bottom-up by
one grouped sum per depth and read top-down by one join per depth. (3) Each block gets back the code lengths of its own grams and
sums them over its texts. Hot grams and words meet once per block, not per
occurrence.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.llm import hashing
from remitlens.llm.store import pinned, prepare

END = 0x0A
SPACE = 0x20
#: Bytes of one text that are handled at once; longer texts are cut between words.
PIECE = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LONG_WORD = 40


# --- (1) blocks ---------------------------------------------------------------------------------


def _pieces(raw: bytes) -> list[bytes]:
    """A long text cut at white space into pieces of about ``PIECE`` bytes, each with a word."""
    raw = raw.strip(b" \t\n\v\f\r")
    out, at = [], 0
    spaces = np.flatnonzero(hashing.SPACES[np.frombuffer(raw, np.uint8)]) if len(raw) > PIECE else np.zeros(0, np.int64)
    while len(raw) - at > PIECE:
        k = int(np.searchsorted(spaces, at + PIECE, "right")) - 1
        if k < 0 or spaces[k] <= at:
            k += 1  # a word longer than a piece: up to its end
        if k >= len(spaces):
            break
        out.append(raw[at : spaces[k]].strip(b" \t\n\v\f\r"))
        at = int(spaces[k])
        while at < len(raw) and hashing.SPACES[raw[at]]:
            at += 1
    return [*out, raw[at:]]


def _framed(w: hashing.Words, leads: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): each text's ``leads`` row, then its words with a space after each; the last one ends in END."""
    depth, texts = leads.shape[1], len(w.counts)
    lengths = w.ends - w.starts
    size = np.bincount(w.documents, lengths + 1, texts).astype(np.int64) if len(lengths) else np.zeros(texts, np.int64)
    bare = (w.counts == 0) & last  # no word: the end alone
    offsets = np.concatenate([[0], np.cumsum(size + bare + depth)])
    out = np.full(offsets[-1], SPACE, np.uint8)
    out[(offsets[:-1, None] + np.arange(depth)).ravel()] = leads.ravel()
    if len(lengths):
        before = np.cumsum(lengths + 1) - (lengths + 1)
        begin = before - before[np.minimum(w.offsets[:-1], len(before) - 1)][w.documents] + offsets[:-1][w.documents] + depth
        step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(begin, lengths) + step] = _LOWER[w.data[np.repeat(w.starts, lengths) + step]]
    out[offsets[1:][last] - 1] = END
    return out, offsets


def _grams(data: np.ndarray, depth: int) -> np.ndarray:
    """For every byte from ``depth`` on: its context, nearest byte first, and the byte itself, in one integer."""
    n = len(data) - depth
    out = data[depth:].astype(np.int64)
    for j in range(1, depth + 1):
        out |= data[depth - j : depth - j + n].astype(np.int64) << (8 * (depth + 1 - j))
    return out


def _places(offsets: np.ndarray, depth: int) -> np.ndarray:
    """Which entries of ``_grams`` belong to a text byte and not to a lead."""
    inside = np.ones(int(offsets[-1]), bool)
    inside[(offsets[:-1, None] + np.arange(depth)).ravel()] = False
    return inside[depth:]


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``weights`` per distinct key, sorted."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(weights, heads) if len(heads) else weights


def _flagged(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct non-negative ``keys`` below 2^62 and how often each is one to learn from."""
    both, times = np.unique(keys << 1 | learn, return_counts=True)
    return _counted(both >> 1, times * (both & 1))


def _word_key(word: bytes) -> bytes:
    """The word itself, or a 128-bit digest of a long one behind a byte that no word begins with."""
    return word if len(word) <= _LONG_WORD else b" " + hashlib.blake2b(word, digest_size=16).digest()


_BLOCK = pa.schema(
    [
        ("block", pa.int64()), ("texts", pa.binary()), ("offsets", pa.binary()), ("row", pa.list_(pa.int64())), ("last", pa.list_(pa.bool_())),
        ("grams", pa.list_(pa.int64())), ("gram_n", pa.list_(pa.int64())),
        ("words", pa.list_(pa.binary())), ("word_n", pa.list_(pa.int64())),
        ("ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
    ]
)
_BLOCK_DDL = (
    "block long, texts binary, offsets binary, row array<long>, last array<boolean>, grams array<long>, gram_n array<long>, "
    "words array<binary>, word_n array<long>, ids array<long>, held_out array<boolean>"
)


class _Block:
    """Texts of one block, and its distinct grams and words as they come in."""

    def __init__(self, depth: int):
        self.depth, self.bytes = depth, 0
        self.data, self.sizes, self.rows, self.last, self.ids, self.held = [], [], [], [], [], []
        self.grams, self.words = [], []

    def add(self, w: hashing.Words, leads: np.ndarray, rows, last: np.ndarray, ids, held: np.ndarray, learn: np.ndarray) -> bytes:
        data, offsets = _framed(w, leads, last)
        self.data.append(data)
        self.sizes.append(np.diff(offsets))
        self.bytes += len(data)
        self.rows += rows
        self.last += last.tolist()
        self.ids += ids
        self.held += held.tolist()
        owner = np.repeat(np.arange(len(leads)), np.diff(offsets) - self.depth)
        grams = _grams(data, self.depth)[_places(offsets, self.depth)]
        self.grams.append(_flagged(grams, learn[owner]))
        keys, first, place = np.unique(w.hashes, return_index=True, return_inverse=True)
        times = np.bincount(place, learn[w.documents], len(keys)).astype(np.int64)
        texts = [w.data[a:b].tobytes().lower() for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist())]
        self.words.append((keys.view(np.int64), times, np.array([*map(_word_key, texts), None], object)[:-1]))
        return data[-self.depth :].tobytes()

    def finished(self, number: int) -> pa.RecordBatch:
        data = np.concatenate(self.data)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(self.sizes))]).astype(np.int64)
        grams, gram_n = _counted(*(np.concatenate(x) for x in zip(*self.grams)))
        keys = np.concatenate([x[0] for x in self.words])
        _, first = np.unique(keys, return_index=True)
        _, word_n = _counted(keys, np.concatenate([x[1] for x in self.words]))
        words = np.concatenate([x[2] for x in self.words])[first]
        packed = zstandard.ZstdCompressor(level=3).compress(data.tobytes())
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), pa.array([packed], pa.binary()), pa.array([offsets.tobytes()], pa.binary()), one(self.rows, pa.int64()),
                one(self.last, pa.bool_()), one(grams, pa.int64()), one(gram_n, pa.int64()), one(words.tolist(), pa.binary()),
                one(word_n, pa.int64()), one(self.ids, pa.int64()), one(self.held, pa.bool_()),
            ],
            schema=_BLOCK,
        )


def _write_blocks(depth: int, block_bytes: int):
    """Rows (doc_id, text, held_out, learn) as blocks of about ``block_bytes``; one piece at least."""

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        block, number, row = _Block(depth), part, part
        start = np.full(depth, END, np.uint8)

        def cut():
            nonlocal block, number
            done, block, number = block.finished(number), _Block(depth), number + 1
            return done

        for batch in batches:
            for some in hashing.slices(batch, "text", PIECE):
                texts = some.column("text")
                ids = some.column("doc_id").to_pylist()
                held, learn = (some.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("held_out", "learn"))
                if some.num_rows > 1 or len(texts[0].as_py() or "") <= PIECE // 4:
                    w = hashing.words(texts, codes=hashing.LOWERED)
                    n = some.num_rows
                    block.add(w, np.tile(start, (n, 1)), list(range(row, row + n)), np.ones(n, bool), ids, held, learn)
                else:
                    lead, cuts = start.tobytes(), _pieces(texts[0].as_py().encode())
                    for k, piece in enumerate(cuts):
                        w = hashing.words(pa.array([piece], pa.binary()), codes=hashing.LOWERED)
                        leads, last = np.frombuffer(lead, np.uint8)[None], np.array([k == len(cuts) - 1])
                        lead = block.add(w, leads, [row], last, ids, held, learn)
                        if block.bytes >= block_bytes:
                            yield cut()
                row += some.num_rows
                if block.bytes >= block_bytes:
                    yield cut()
        if block.bytes:
            yield cut()

    return run


# --- (2) context trees --------------------------------------------------------------------------

#: Depths below which a context's descendants are handled together: at most 256^2 contexts.
_INNER = 2


def _log_gamma(x, log):
    """Logarithm of the gamma function for x >= 1/2: seven steps up, then Stirling's series. Columns or arrays."""
    y = x + 7
    steps = x
    for k in range(1, 7):
        steps = steps * (x + k)
    inverse = 1 / y
    square = inverse * inverse
    series = inverse * (square * (square * (square * (-1 / 1680) + 1 / 1260) + -1 / 360) + 1 / 12)
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + series - log(steps)


def _block_probability(a, b, log):
    """Natural logarithm of the Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones (doubles)."""
    return _log_gamma(a + 0.5, log) + _log_gamma(b + 0.5, log) - _log_gamma(a + b + 1, log) - math.log(math.pi)


def _parent(key):
    """The same node one context byte shorter."""
    return (key >> 16 << 8) | (key & 255)


class _Descendants:
    """The contexts below some contexts of one depth, from all grams that begin with these: one array level per depth.

    Level 0 is the longest context. A node's key is its context and, in the last
    byte, its place in the binary tree (a leading one and the bits before it).
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, inner: int):
        i = np.arange(8)
        self.bit = ((grams[:, None] & 255) >> (7 - i) & 1).ravel()
        keys = ((grams[:, None] >> 8 << 8) + (1 << i) + ((grams[:, None] & 255) >> (8 - i))).ravel()
        n = np.repeat(n, 8).astype(float)
        self.keys, self.places, self.zeros, self.ones, self.pe, self.longer = [], [], [], [], [], []
        below, zeros, ones = None, n * (1 - self.bit), n * self.bit
        for k in range(inner + 1):
            keys, place = np.unique(keys if k == 0 else _parent(keys), return_inverse=True)
            total = lambda v: np.bincount(place, v, len(keys))  # noqa: E731, B023
            zeros, ones, longer = total(zeros), total(ones), total(below) if k else None
            pe = np.where(zeros + ones > 0, _block_probability(zeros, ones, np.log), 0.0)
            below = np.logaddexp(pe, longer) - math.log(2) if k else pe
            for own, v in ((self.keys, keys), (self.places, place), (self.zeros, zeros), (self.ones, ones), (self.pe, pe), (self.longer, longer)):
                own.append(v)

    def lengths(self, q0: np.ndarray, q1: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 probability of each gram, given what the contexts from the root to the last level contribute and leave open."""
        for k in range(len(self.keys) - 2, -1, -1):
            up = self.places[k + 1]
            share = 1 / (1 + np.exp(np.minimum(self.longer[k] - self.pe[k], 700))) if k else 1.0
            total = self.zeros[k] + self.ones[k] + 1
            q0 = q0[up] + left[up] * share * (self.zeros[k] + 0.5) / total
            q1 = q1[up] + left[up] * share * (self.ones[k] + 0.5) / total
            left = left[up] * (1 - share)
        at = self.places[0]
        return np.log10(np.where(self.bit == 1, q1[at], q0[at])).reshape(-1, 8).sum(1)


def _by_root(handle, schema: pa.Schema, least: int = 1 << 18):
    """Rows sorted by the first column as whole groups of it, many at a time: ``handle(table) -> columns``."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def answered(table: pa.Table):
            for some in pa.table(handle(table), schema=schema).to_batches():
                yield some

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < least:
                continue
            table = pa.Table.from_batches(held)
            roots = table.column(0).to_numpy()
            whole = int(np.searchsorted(roots, roots[-1]))
            if whole:
                yield from answered(table.slice(0, whole))
            held = table.slice(whole).to_batches()
        if held:
            yield from answered(pa.Table.from_batches(held))

    return run


def gram_lengths(grams: DataFrame, depth: int) -> DataFrame:
    """(gram, log10_p) for ``grams (gram, n)``: distinct grams, n how often each was seen in training (0 allowed)."""
    inner = min(_INNER, depth - 1)
    root = F.shiftright("gram", 8 * (1 + inner)).alias("root")

    def bottom(table: pa.Table):
        own = _Descendants(table["gram"].to_numpy(), table["n"].to_numpy(), inner)
        return [own.keys[-1], own.zeros[-1], own.ones[-1], own.longer[-1]]

    def top(table: pa.Table):
        is_gram = table["n"].is_valid().to_numpy()
        rows, above = table.filter(pa.array(is_gram)), table.filter(pa.array(~is_gram))
        own = _Descendants(rows["gram"].to_numpy(), rows["n"].to_numpy(), inner)
        keys = above["gram"].to_numpy()
        order = np.argsort(keys)
        place = order[np.searchsorted(keys[order], own.keys[-1])]
        return [rows["gram"].to_numpy(), own.lengths(*[above[c].to_numpy()[place] for c in ("q0", "q1", "rest")])]

    def spread(rows: DataFrame, handle, ddl: str, schema) -> DataFrame:
        return rows.repartition("root").sortWithinPartitions("root").mapInArrow(_by_root(handle, pa.schema(schema)), ddl)

    f8, i8 = pa.float64(), pa.int64()
    last = spread(
        grams.select(root, "gram", "n"), bottom, "key long, a double, b double, longer double", [("key", i8), ("a", f8), ("b", f8), ("longer", f8)]
    )
    a, b = F.col("a"), F.col("b")
    pe = F.when(a + b == 0, F.lit(0.0)).otherwise(_block_probability(a, b, F.log))
    most, least = F.greatest("pe", "longer"), F.least("pe", "longer")
    weighted = most + F.log1p(F.exp(least - most)) - math.log(2)
    share = 1 / (1 + F.exp(F.least(F.col("longer") - F.col("pe"), F.lit(700.0))))
    above_key = F.shiftleft(F.shiftright("key", 16), 8) + F.col("key").bitwiseAND(F.lit(255))
    levels: list[DataFrame] = []
    for k in range(depth - inner, -1, -1):  # upwards: one grouped sum per depth
        if levels:
            last = levels[0].groupBy(above_key.alias("key")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pw").alias("longer"))
        levels.insert(0, pinned(last.withColumn("pe", pe).select("key", "a", "b", weighted.alias("pw"), share.alias("share")), f"contexts-{k}"))
    mixed = None
    total = a + b + 1
    for level in levels:  # downwards: one join per depth
        own = F.col("share")
        here = level.select("key", (own * (a + 0.5) / total).alias("p0"), (own * (b + 0.5) / total).alias("p1"), (1 - own).alias("open"))
        if mixed is None:
            mixed = here.select("key", F.col("p0").alias("q0"), F.col("p1").alias("q1"), F.col("open").alias("rest"))
        else:
            above = mixed.select(F.col("key").alias("up"), "q0", "q1", "rest")
            mixed = here.withColumn("up", above_key).join(above, "up").select(
                "key", (F.col("q0") + F.col("rest") * F.col("p0")).alias("q0"), (F.col("q1") + F.col("rest") * F.col("p1")).alias("q1"),
                (F.col("rest") * F.col("open")).alias("rest"),
            )
    none = F.lit(None)
    rows = grams.select(root, "gram", "n", *[none.cast("double").alias(c) for c in ("q0", "q1", "rest")]).unionByName(
        mixed.select(F.shiftright("key", 8).alias("root"), F.col("key").alias("gram"), none.cast("long").alias("n"), "q0", "q1", "rest")
    )
    return spread(rows, top, "gram long, log10_p double", [("gram", i8), ("log10_p", f8)])


# --- (3) texts ----------------------------------------------------------------------------------


def _measure(depth: int, train_tokens: int, vocabulary: int, ends: int):
    """Scores of a block's pieces from its texts and the values of its own grams and words."""
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
         ("n_bytes", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    )
    unit = math.log10(train_tokens + vocabulary + 1)

    def table(values: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
        own = values.filter(pc.equal(values["kind"], kind))
        keys, v = own["key"].to_numpy(), own["value"].to_numpy()
        order = np.argsort(keys)
        return keys[order], v[order]

    def run(blocks: pa.Table, values: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return schema.empty_table()
        one = {c: blocks[c][0].as_py() for c in ("texts", "offsets", "row", "last", "ids", "held_out")}
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(one["texts"]), np.uint8)
        offsets = np.frombuffer(one["offsets"], np.int64)
        (grams, lengths), (_, counts) = table(values, 0), table(values, 1)
        parts, word_hashes = [], []
        n = len(offsets) - 1
        at = 0
        while at < n:  # a few megabytes at a time
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
            a, own = int(offsets[at]), offsets[at : stop + 1] - offsets[at]
            some = data[a : int(offsets[stop])]
            inside = _places(own, depth)
            sizes = np.diff(own) - depth
            heads, full = np.cumsum(sizes) - sizes, np.flatnonzero(sizes > 0)
            place = np.searchsorted(grams, _grams(some, depth)[inside])
            score = np.zeros(stop - at)
            score[full] = np.add.reduceat(lengths[place], heads[full])
            body = some[depth:][inside]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            column = pa.Array.from_buffers(pa.large_binary(), stop - at, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
            w = hashing.words(column)
            word_hashes.append(w.hashes.view(np.int64))
            parts.append((at, stop, w.documents, w.counts, sizes, score))
            at = stop
        # the words of a block are known by their place among its sorted hashes
        hashes = np.concatenate(word_hashes)
        seen = counts[np.unique(hashes, return_inverse=True)[1]] if len(hashes) else np.zeros(0)
        tables, first = [], 0
        for (at, stop, owner, n_words, sizes, score), own in zip(parts, word_hashes):
            times = seen[first : first + len(own)]
            first += len(own)
            last = np.array(one["last"][at:stop])
            sums = lambda v: np.bincount(owner, v, stop - at)  # noqa: E731, B023
            tables.append(
                pa.table(
                    [
                        one["row"][at:stop], one["ids"][at:stop], one["held_out"][at:stop], n_words + last,
                        sums(times > 0).astype(np.int64) + (last & (ends > 0)), sizes,
                        sums(np.log10(times + 1) - unit) + last * (math.log10(ends + 1) - unit), score,
                    ],
                    schema=schema,
                )
            )
        return pa.concat_tables(tables)

    return run


def score(docs: DataFrame, learn: Column, held_out: Column, depth: int = 5, block_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte), one row per row of ``docs``.

    ``score`` is the log10 probability of the text under the weighted context trees
    of up to ``depth`` bytes (2 to 6), learned from the rows where ``learn`` holds;
    bits_per_byte is its code length, the end byte counted. ``base_score`` is that of
    the add-one word model. Both are of the same tokens.

    Defined cases: a null, empty or blank text is the end alone; null ``learn`` or
    ``held_out`` is false; with nothing to learn from, every bit has probability one
    half and base_score is 0 (N = V = 0); repeated rows and ids are counted and
    scored each; texts of any length are read whole, in pieces cut between words;
    other columns of ``docs`` are not read; an empty table gives an empty table.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must lie between 2 and 6")
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
    )
    blocks = pinned(rows.mapInArrow(_write_blocks(depth, block_bytes), _BLOCK_DDL), "context-blocks", "zstd")
    grams = blocks.select("block", F.explode(F.arrays_zip(F.col("grams").alias("gram"), F.col("gram_n").alias("n"))).alias("g")).select("block", "g.gram", "g.n")
    words = blocks.select(
        "block", F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.col("word_n").alias("n"))).alias("place", "w")
    ).select("block", "w.word", F.col("place").cast("long").alias("key"), "w.n")
    lengths = gram_lengths(pinned(grams.groupBy("gram").agg(F.sum("n").alias("n")), "context-grams"), depth)
    vocabulary = pinned(words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "context-words")
    ends = rows.where("learn").count()
    size = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train_tokens, known = size.n + ends, size.v + (ends > 0)
    values = grams.join(lengths, "gram").select(F.col("block").alias("of"), F.lit(0).alias("kind"), F.col("gram").alias("key"), F.col("log10_p").alias("value")).unionByName(
        words.join(vocabulary.withColumnRenamed("n", "total"), "word", "left")
        .select(F.col("block").alias("of"), F.lit(1).alias("kind"), "key", F.coalesce(F.col("total"), F.lit(0)).cast("double").alias("value"))
    )
    texts = blocks.select("block", "texts", "offsets", "row", "last", "ids", "held_out")
    pieces = texts.groupBy("block").cogroup(values.groupBy("of")).applyInArrow(
        _measure(depth, train_tokens, known, ends),
        "row long, doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double",
    )
    total = lambda c: F.sum(c).alias(c)
    whole = pieces.groupBy("row", "doc_id", "held_out").agg(*map(total, ("n_tokens", "n_known", "n_bytes", "base_score", "score")))
    return whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
