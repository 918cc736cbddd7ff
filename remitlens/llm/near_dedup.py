"""Near-duplicate documents by circulant MinHash with exact verification.

Signatures. One permutation sigma places a shingle hash in a universe of 2^22
slots; a second permutation pi gives the value of a slot, and coordinate k of
the signature reads pi circularly shifted by k (Li and Li, "C-MinHash", 2022).
All coordinates of a shingle are therefore one contiguous slice of pi.

Plan. (1) One pass over the texts gives set size, a 128-bit key of the set and
the band keys. Documents with equal sets collapse to the smallest doc_id. (2)
Documents that share a band key are compared with the smallest document of that
bucket on full sets. (3) Buckets that still hold several components are compared
in blocks of bounded size; a block pair reports only links that join components,
never all pairs. (4) Connected components.

Step 3 makes the result exact for every pair that shares a band. With 40 bands
of 5 coordinates a pair at Jaccard 0.8 shares none with probability 1e-7.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm import hashing
from remitlens.llm.components import components
from remitlens.llm.store import pinned, prepare

UNIVERSE = 1 << 22
BLOCK = 512
_CHUNK = 4096


@cache
def _circulant(width: int) -> tuple[np.ndarray, int]:
    """Windows of ``width`` consecutive values of pi, one per slot, and the multiplier of sigma."""
    random = np.random.Generator(np.random.PCG64(71))
    pi = random.permutation(UNIVERSE).astype(np.uint32)
    extended = np.concatenate([pi, pi[:width]])
    return np.lib.stride_tricks.sliding_window_view(extended, width), 0x9E3779B97F4A7C15


def signatures(values: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """MinHash signature of each non-empty set; rows of empty sets are all ones."""
    view, odd = _circulant(width)
    slots = (hashing.mix(values * np.uint64(odd)) >> np.uint64(64 - 22)).astype(np.int64)
    out = np.full((len(offsets) - 1, width), np.uint32(0xFFFFFFFF), np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for at in range(0, len(slots), _CHUNK):
        rows, own = view[slots[at : at + _CHUNK]], owner[at : at + _CHUNK]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        least = np.minimum.reduceat(rows, heads, axis=0)
        out[own[heads]] = np.minimum(out[own[heads]], least)
    assert len(full) == len(np.unique(owner))
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit key of each band, the band's number included."""
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    for j in range(rows):
        h = hashing.mix(h * np.uint64(0x100000001B3) + parts[:, :, j])
    return h


def _sign(shingle: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                w = hashing.words(part.column("text"), codes=hashing.LOWERED)
                values, offsets = hashing.shingle_sets(w, shingle)
                keys = band_keys(signatures(values, offsets, bands * rows), bands, rows)
                raw = values.tobytes()
                sets = [hashlib.blake2b(raw[a * 8 : b * 8], digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(sets, pa.binary()), lists], schema=schema)

    return run


def _sets(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                w = hashing.words(part.column("text"), codes=hashing.LOWERED)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), hashing.binaries(*hashing.shingle_sets(w, shingle))], schema=schema)

    return run


def _linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def _verify_pairs(percent: int):
    def run(batches):
        for batch in batches:
            left, right = (batch.column(n).to_pylist() for n in ("left_set", "right_set"))
            keep = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(bool(_linked(int((y[at] == x).sum()), len(x), len(y), percent)))
            yield batch.select(["member", "hub"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify_block(percent: int):
    """Links between two blocks of a bucket, reduced to those that join components."""

    def run(table: pa.Table) -> pa.Table:
        seen: dict[int, int] = {}

        def root(c: int) -> int:
            while seen.get(c, c) != c:
                seen[c] = seen.get(seen[c], seen[c])
                c = seen[c]
            return c

        left, right = (table.filter(pc.equal(table["side"], s)) for s in (0, 1))
        found: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            sets = [np.frombuffer(x, np.uint64) for x in right["shingles"].to_pylist()]
            sizes = np.array([len(x) for x in sets])
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            names, groups = right["rep"].to_pylist(), right["component"].to_pylist()
            for rep, group, raw in zip(left["rep"].to_pylist(), left["component"].to_pylist(), left["shingles"].to_pylist()):
                own = np.frombuffer(raw, np.uint64)
                low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                reach = high - low
                # positions of all postings of the shared shingles
                flat = np.repeat(low - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
                shared = np.bincount(owner[flat], minlength=len(sets))
                for i in np.flatnonzero(_linked(shared, len(own), sizes, percent)):
                    x, y = root(group), root(groups[i])
                    if x != y:
                        seen[max(x, y)] = min(x, y)
                        found.append((rep, names[i]))
        return pa.table({"member": pa.array([a for a, _ in found], pa.int64()), "hub": pa.array([b for _, b in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs(doc_id, text)``.

    Two documents are linked when their sets of distinct ``shingle``-word
    shingles have a Jaccard similarity of at least ``percent`` / 100. Words are
    runs without ASCII white space, A-Z lower-cased.

    Defined cases: a null or empty text has an empty set and no link; fewer words
    than ``shingle`` make one shingle of the whole sequence; texts of any length
    are used whole; equal sets are one class (any number of copies costs one
    row); rows that repeat a doc_id are one document, linked wherever one of its
    texts is, and get the same answer; a null doc_id is linked with nothing, has a null component_id and is kept;
    other columns of ``docs`` are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = pinned(
        texts.mapInArrow(_sign(shingle, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>"),
        "signatures",
    )
    known = signed.where("doc_id is not null and set_key is not null")
    # one representative per distinct set; the copies join it by key at the end
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    copies = known.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "rep")
    reps = known.join(classes, "set_key").where("doc_id = rep").select("rep", F.explode("bands").alias("band"))
    hubs = reps.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = pinned(reps.join(hubs, "band").select("band", "rep", "hub", "n"), "members")

    involved = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = pinned(
        texts.join(involved, "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, shingles binary")
        .distinct(),
        "sets",
    )

    def with_set(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.join(sets.select(F.col("doc_id").alias(key), F.col("shingles").alias(name)), key)

    pairs = members.where("rep <> hub").select(F.col("rep").alias("member"), "hub").distinct()
    first_links = pinned(
        with_set(with_set(pairs, "member", "left_set"), "hub", "right_set")
        .select("member", "hub", "left_set", "right_set")
        .mapInArrow(_verify_pairs(percent), "member long, hub long"),
        "links",
    )
    links = first_links.unionByName(_remaining_links(members, sets, first_links, percent))
    joined = copies.where("doc_id <> rep").select(F.col("doc_id").alias("member"), F.col("rep").alias("hub"))
    groups = pinned(components(links.unionByName(joined), "member", "hub"), "components")
    return (
        signed.select("doc_id", "n_shingles")
        .join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _remaining_links(members: DataFrame, sets: DataFrame, first_links: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets that the comparison with the hub left in several components.

    The hub has been compared with everyone, so only the other members matter.
    Members outside the bucket's most common component (side 0) meet all members
    (side 1) in blocks of about ``BLOCK`` rows.
    """
    found = components(first_links, "member", "hub").withColumnsRenamed({"node": "rep"})
    placed = (
        members.where("rep <> hub and n > 2").join(found, "rep", "left")
        .select("band", "rep", F.coalesce("component", "rep").alias("component"))
    )
    placed = pinned(placed, "placed")
    per_component = placed.groupBy("band", "component").agg(F.count("*").alias("size"))
    buckets = (
        per_component.groupBy("band")
        .agg(F.sum("size").alias("n"), F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("top"))
        .where("parts > 1")
        .select("band", F.col("top.component").alias("main"), (F.col("n") - F.col("top.size")).alias("few"), F.col("n").alias("all"))
    )
    open_members = placed.join(buckets, "band")
    few, every = (F.ceil(F.col(c) / F.lit(BLOCK)).cast("int") for c in ("few", "all"))
    block = lambda count: F.pmod(F.xxhash64("rep"), count).cast("int")
    left = open_members.where("component <> main").select(
        "band", block(few).alias("i"), F.explode(F.sequence(F.lit(0), every - 1)).alias("j"), "rep", "component", F.lit(0).alias("side")
    )
    right = open_members.select(
        "band", F.explode(F.sequence(F.lit(0), few - 1)).alias("i"), block(every).alias("j"), "rep", "component", F.lit(1).alias("side")
    )
    shipped = left.unionByName(right).join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    return shipped.groupBy("band", "i", "j").applyInArrow(_verify_block(percent), "member long, hub long")
