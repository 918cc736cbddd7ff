"""Token packing by best-fit decreasing with a segment tree over remaining capacity.

Documents are tokenized where they are read and cut into full windows and a rest;
only (document, start, length, checksum) rows move on. They are dealt in turn to
groups of bounded size, and each group packs its pieces from
the longest down: a segment tree indexed by remaining capacity finds the tightest
open window that still holds the piece.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm import hashing
from remitlens.llm.store import pinned, prepare

#: Words whose ids a task remembers, and letters of such a word; past the first it starts afresh. Bounds memory, not results.
REMEMBERED, LONGEST = 1_000_000, 64


#: The letter that stands for a byte in a byte-level vocabulary: itself if printable, else the next one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class _Remembered(dict):
    """Ids of words by word; a word that is not there yet is learned when it is asked for."""

    def __init__(self, learn):
        super().__init__()
        self._learn = learn

    def __missing__(self, word: str) -> bytes | None:
        ids = self._learn(self, word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


class Encoder:
    """Token ids of whole texts, with the ids of words remembered.

    Byte-level pair encodings never join across a single space, which opens the
    next word, nor across a single line feed, which is a piece of its own. A text
    is therefore the concatenation of its lines' " word" chunks, unless white
    space borders on white space or on an end of the text; then it is encoded
    whole. A full stop or comma after a letter is a piece of its own, too.

    ``special_tokens`` gives the strings of special tokens their own ids, as the
    tokenizer does by itself; without it they are ordinary text. A text that holds
    the string of an added token is encoded whole.
    """

    def __init__(self, tokenizer_file: str, special_tokens: bool = False):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        self._tokenizer.encode_special_tokens = not special_tokens
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._added = [t.content for t in added if special_tokens or not t.special]
        self._model = self._tokenizer.model
        self._marks = {mark: self._encode(mark) for mark in "\n.,"}
        #: ids of a word by whether a space stands before it; None if white space stands at its ends
        self._known = tuple(_Remembered(partial(self._learn, space)) for space in ("", " "))

    def _encode(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, space: str, letters: str) -> bytes:
        """Ids of one piece: an optional space and letters."""
        if letters.isascii():
            mapped = (_BYTE_LETTERS[32] if space else "") + letters
        else:
            mapped = (space + letters).encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self._model.tokenize(mapped)]).tobytes()

    def _learn(self, space: str, known: dict[str, bytes | None], word: str) -> bytes | None:
        """Ids of a word that is not in ``known``."""
        if word.isalpha():
            return self._piece(space, word)
        if not word or word != word.strip():
            return None
        if word[-1] in ".," and word[:-1].isalpha():
            return known[word[:-1]] + self._marks[word[-1]]
        return self._encode(space + word)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if sum(map(len, self._known)) > REMEMBERED:
            for known in self._known:
                known.clear()
        whole = ("  ", " \n", "\n ", "\n\n", *self._added)
        plain, spaced, feed = *(known.__getitem__ for known in self._known), self._marks["\n"]
        out = []
        for text in texts:
            ids: bytes | None = None
            if text and not (text[0].isspace() or text[-1].isspace() or any(x in text for x in whole)):
                lines = []
                try:
                    for line in text.split("\n"):
                        # the first word of a line has no space before it
                        head, *rest = line.split(" ")
                        lines.append(plain(head) + b"".join(map(spaced, rest)))
                    ids = feed.join(lines)
                except TypeError:  # a word with white space at its ends
                    pass
            if ids is None:
                ids = self._encode(text) if text else b""
            out.append(np.frombuffer(ids, "<u4"))
        return out


@cache
def _encoder(tokenizer_file: str) -> Encoder:
    """One per worker process, so that its memory serves all tasks there."""
    return Encoder(tokenizer_file, special_tokens=True)


def _pieces(tokenizer_file: str, size: int, end: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches):
        encoder = _encoder(tokenizer_file)
        for batch in batches:
            for part in hashing.slices(batch, "text", most=1 << 20):
                rows = []
                names = part.column("doc_id").to_pylist()
                gc.disable()  # word lists hold no cycles, and there are many
                try:
                    encoded = encoder.encode(part.column("text").fill_null("").to_pylist())
                finally:
                    gc.enable()
                for name, ids in zip(names, encoded):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for start in range(0, len(ids), size):
                        piece = ids[start : start + size]
                        rows.append((name, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree of counts over the capacities."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        i = self.leaves + capacity
        while i:
            self.tree[i] += 1
            i >>= 1

    def take_tightest(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) with the least capacity of at least ``length``, taken out; None if there is none."""
        tree, i = self.tree, self.leaves + length
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up to the first ancestor with a filled right sibling
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            tree[i] -= 1
            i >>= 1
        return capacity, self.stacks[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; lengths are in decreasing order."""
    opened, places, offsets, n = OpenWindows(size), [], [], 0
    for length in lengths:
        fit = opened.take_tightest(length)
        if fit is None:
            fit, n = (size, n), n + 1
        capacity, window = fit
        places.append(window)
        offsets.append(size - capacity)
        if capacity > length:
            opened.add(capacity - length, window)
    return places, offsets


def _pack(size: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        window, offset = best_fit_decreasing(table["length"].to_pylist(), size)
        return table.append_column("window", pa.array(window, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(docs: DataFrame, tokenizer_file: str, size: int = 2048, end: int = 1, group_pieces: int = 20_000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    Every row of ``docs(doc_id, text)`` becomes its token ids and the id ``end``;
    the string of a special token in a text is that token.
    Documents longer than ``size`` are cut into full windows first; the rests and
    shorter documents share windows of ``size`` ids. ``sequence_id`` is unique over
    all groups, not consecutive; offsets in a sequence are gapless from 0.
    ``group_pieces`` bounds the rests that one task packs together; the number of
    groups follows the input, and rests are dealt to the groups in turn.

    Defined cases: a null or empty text is the id ``end`` alone; texts of any
    length are used whole; equal lengths go by doc_id, start and checksum; rows
    that repeat a doc_id are separate documents; a null doc_id is packed as null;
    other columns are ignored; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = pinned(
        texts.mapInArrow(_pieces(tokenizer_file, size, end), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"),
        "pieces",
    )
    rests = pieces.where(F.col("length") < size)
    groups = max(1, -(-rests.count() // group_pieces))
    packed = rests.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(groups))).groupBy("part").applyInArrow(
        _pack(size),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long",
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    # shared windows take even numbers, full ones odd
    shared = packed.select(*columns, (2 * (F.col("part") + F.col("window") * groups)).alias("sequence_id"), "offset")
    full = pieces.where(F.col("length") == size).select(
        *columns, (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return shared.unionByName(full)


def padding(packed: DataFrame, size: int = 2048) -> DataFrame:
    """(sequences, tokens, padded): ids of padding, none for a sequence whose length is a power of two."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    exact = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return used.agg(
        F.count("*").alias("sequences"), F.sum("used").alias("tokens"),
        F.sum(F.when(exact, F.lit(0)).otherwise(size - F.col("used"))).alias("padded"),
    )
