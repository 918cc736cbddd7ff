"""Benchmark passages in documents, by greedy string tiling.

Seeds are the runs of ``least`` tokens. Documents send only the seeds that a
bitmap of the benchmark's seeds lets through (2 MB at most, built by a bitmap
aggregate, whatever the benchmark's size; false hits only cost rows), and these
meet the benchmark's seeds in a shuffle join. A pair whose seeds cover too little
of the item cannot reach the threshold and stops there. For the others the longest
common runs are marked greedily, found by Karp-Rabin hashing, until none of
``least`` tokens is left: tiles may stand in any order, so a passage that was cut
and rearranged is still covered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm import hashing
from remitlens.llm.store import pinned, prepare

SLOTS = 1 << 24
_PAGE = 1 << 15  # bits of one bitmap of bitmap_construct_agg
_MODULUS = (1 << 61) - 1
_BASE = 1_000_003


def _tokens(column: pa.Array) -> hashing.Words:
    """Runs of ASCII letters, digits and longer code points, A-Z lower-cased."""
    return hashing.words(column, separators=hashing.PUNCTUATION, codes=hashing.LOWERED)


def _item_seeds(least: int):
    schema = pa.schema([("item_id", pa.int64()), ("item_at", pa.int32()), ("h", pa.int64()), ("n_tokens", pa.int32())])

    def run(batches):
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                w = _tokens(part.column("text"))
                first, h = hashing.windows(w, least)
                d = w.documents[first] if len(first) else first
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(pa.array(d)), pa.array((first - w.offsets[d]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(w.counts[d].astype(np.int32))],
                    schema=schema,
                )

    return run


def _document_seeds(least: int, bitmap: bytes):
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64())])

    def run(batches):
        bits = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                w = _tokens(part.column("text"))
                first, h = hashing.windows(w, least)
                slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
                hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                d, h = w.documents[first[hit]], h[hit]
                # each seed of a document once
                order = np.lexsort((h, d))
                d, h = d[order], h[order]
                new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]) if len(d) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d[new])), pa.array(h[new].view(np.int64))], schema=schema)

    return run


def _seed_bitmap(seeds: DataFrame) -> bytes:
    """Bitmap over the slots of the benchmark's seeds: at most SLOTS / 32768 rows of 4 KB reach the driver."""
    slot = F.col("h").bitwiseAND(F.lit(SLOTS - 1))
    rows = (
        seeds.select(F.floor(slot / _PAGE).alias("page"), (slot % _PAGE).alias("bit"))
        .groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    )
    out = np.zeros(SLOTS // 8, np.uint8)
    for row in rows:
        out[row.page * (_PAGE // 8) : (row.page + 1) * (_PAGE // 8)] = np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length) of each tile.

    The longest run of equal unmarked tokens is marked first; equal lengths go by
    place in the text, then in the item. Runs of ``least`` tokens are found by a
    rolling hash and compared token by token before they are extended. A start inside
    a run that was followed on the same diagonal is shorter than that run and is passed
    over, so a round compares a pair of places once, however often a token repeats.
    """
    a_free, b_free = [True] * len(item), [True] * len(text)
    lead = pow(_BASE, least - 1, _MODULUS)

    def rolled(tokens: list[int], free: list[bool]):
        """(start, hash) of each run of ``least`` free tokens."""
        h = size = 0
        for i, token in enumerate(tokens):
            if not free[i]:
                h = size = 0
                continue
            if size == least:
                h -= tokens[i - least] * lead
                size -= 1
            h = (h * _BASE + token) % _MODULUS
            size += 1
            if size == least:
                yield i - least + 1, h

    found: list[tuple[int, int, int]] = []
    while True:
        places: dict[int, list[int]] = {}
        for p, h in rolled(item, a_free):
            places.setdefault(h, []).append(p)
        longest, matches = least, []
        followed: dict[int, int] = {}  # diagonal -> end in the text of its last run
        for t, h in rolled(text, b_free):
            for p in places.get(h, ()):
                if t < followed.get(p - t, 0):
                    continue
                k = 0
                while p + k < len(item) and t + k < len(text) and a_free[p + k] and b_free[t + k] and item[p + k] == text[t + k]:
                    k += 1
                followed[p - t] = t + k
                if k > longest:
                    longest, matches = k, []
                if k == longest:
                    matches.append((t, p))
        if not matches:
            return found
        for t, p in matches:
            if all(a_free[p : p + longest]) and all(b_free[t : t + longest]):
                a_free[p : p + longest] = b_free[t : t + longest] = [False] * longest
                found.append((p, t, longest))


def _tile(least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tiles", pa.int64()), ("n_covered", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                docs, items = _tokens(part.column("text")), _tokens(part.column("item_text"))
                rows = []
                for i in range(part.num_rows):
                    own = items.hashes[items.offsets[i] : items.offsets[i + 1]]
                    text = docs.hashes[docs.offsets[i] : docs.offsets[i + 1]]
                    # only tokens in a run of ``least`` that the item also has can lie in a tile
                    grams, theirs = _grams(text, least), _grams(own, least)
                    marks = np.zeros(len(text) + 1, np.int64)
                    at = np.flatnonzero(np.isin(grams, theirs))
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + least, -1)
                    near = np.cumsum(marks)[:-1] > 0
                    segments: list[int] = []
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]])))
                    for a, b in edges.reshape(-1, 2).tolist():
                        segments += [-1, *text[a:b].tolist()]  # -1 is no token: runs don't cross it
                    found = tiles(own.tolist(), segments, least)
                    rows.append((len(found), sum(k for _, _, k in found), len(own)))
                columns = list(zip(*rows)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("item_id"), *[pa.array(c, pa.int64()) for c in columns]], schema=schema
                )

    return run


def _grams(tokens: np.ndarray, least: int) -> np.ndarray:
    n = len(tokens) - least + 1
    h = np.full(max(n, 0), least, np.uint64)
    for j in range(least if n > 0 else 0):
        h = hashing.mix(h + tokens[j : j + n])
    return h


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, percent: int = 50) -> DataFrame:
    """(doc_id, item_id, n_tiles, n_covered, n_tokens) of each contaminated pair.

    ``docs(doc_id, text)`` against ``benchmark(item_id, text)``. A pair is
    contaminated when tiles of at least ``least`` tokens cover at least
    ``percent`` / 100 of the item's tokens. Tokens are runs of ASCII letters and
    digits and other code points, A-Z lower-cased; punctuation is passed over.

    Defined cases: null or empty texts and items of fewer than ``least`` tokens
    match nothing; long texts are used whole; rows with a null doc_id or item_id
    are in no pair; rows that repeat an id with the same text give one pair, with
    different texts one row for each that is contaminated; other columns are
    ignored; an empty table on either side gives an empty table.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    seeds = pinned(items.mapInArrow(_item_seeds(least), "item_id long, item_at int, h long, n_tokens int"), "seeds")
    found = texts.mapInArrow(_document_seeds(least, _seed_bitmap(seeds)), "doc_id long, h long")
    reached = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (least - 1)))))
    candidates = (
        found.join(seeds, "h").groupBy("doc_id", "item_id", "n_tokens")
        .agg(F.collect_set("item_at").alias("places"))  # at most the item's tokens
        .where(100 * F.size(reached) >= percent * F.col("n_tokens"))
        .select("doc_id", "item_id")
    ).distinct()
    return (
        texts.join(pinned(candidates, "candidates"), "doc_id")
        .join(items.withColumnRenamed("text", "item_text"), "item_id")
        .select("doc_id", "item_id", "text", "item_text")
        .mapInArrow(_tile(least), "doc_id long, item_id long, n_tiles long, n_covered long, n_tokens long")
        .where(100 * F.col("n_covered") >= percent * F.col("n_tokens"))
        .distinct()
    )
