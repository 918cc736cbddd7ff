"""Repeated word passages found through difference-cover anchors.

A difference cover D of the residues modulo m holds, for every distance, two
members at that distance. So two equal windows at any two positions have a
common shift k < m at which both are at a cover position: hashing only the
anchors (the 8 words that start at a cover position) cannot miss a repeated
window of 20 words, and only 4 of 13 positions are hashed. {0, 1, 3, 9} modulo 13
is a perfect difference set, and 13 + 8 - 1 = 20.

Plan. (1) Anchors of all documents meet by hash; those that occur twice or more
go back to their documents. (2) Each is extended to the windows around it, which
are hashed in full (96 bits) and meet again; a window with an earlier equal is
marked. (3) The words under marked windows go. Equal anchors and windows of one
batch are grouped where they are read, before the shuffle: a hash sends one row
per batch, however often it occurs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from remitlens.llm import hashing
from remitlens.llm.store import pinned, prepare

#: A perfect difference set and its modulus (fixed values).
COVER = (0, 1, 3, 9)
PERIOD = 13


_PLACES = pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int32())]))
_PLACES_DDL = "array<struct<doc_id: long, at: int>>"


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(0).to_numpy()


def _grouped(order: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal keys as (first members, other members, offsets of these), in the order of the first members.

    ``order`` sorts the rows by key and ``head`` marks the first row of each key in it.
    """
    first, group = order[head], np.cumsum(head) - 1
    by_place = np.argsort(first)
    rank = np.empty(len(first), np.int64)
    rank[by_place] = np.arange(len(first))
    others, owner = order[~head], rank[group[~head]]
    sizes = np.bincount(owner, minlength=len(first))
    return first[by_place], others[np.argsort(owner, kind="stable")], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def _places(ids: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(ids), pa.array(at)], fields=list(_PLACES.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _anchors(window: int):
    """One row per anchor hash of a batch: its first place, and the other places in the batch."""
    length = window - PERIOD + 1
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True

    def run(batches):
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                w = hashing.words(part.column("text"))
                first, h = hashing.windows(w, length)
                documents = w.documents[first] if len(first) else first
                place = first - w.offsets[documents]
                here = covered[place % PERIOD]
                h, ids, at = h[here], _ids(part)[documents[here]], place[here].astype(np.int32)
                order = np.argsort(h, kind="stable")
                head = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
                own, others, offsets = _grouped(order, head)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[own].view(np.int64)), pa.array(ids[own]), pa.array(at[own]), _places(ids[others], at[others], offsets)],
                    names=["h", "doc_id", "at", "others"],
                )

    return run


def _windows(window: int):
    """Windows that hold a repeated anchor: one row per distinct window of a batch, at its earliest place."""

    def run(batches):
        for batch in batches:
            for part in hashing.slices(batch.filter(batch.column("anchors").is_valid()), "text"):
                w = hashing.words(part.column("text"))
                first, h1 = hashing.windows(w, window)
                h2 = (hashing.windows(w, window, seed=1)[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                if not len(first):
                    continue
                # +1 where a window can first hold the anchor, -1 where it no longer does
                marks = np.zeros(len(w.hashes) + 1, np.int64)
                anchors = part.column("anchors")
                sizes = np.diff(np.asarray(anchors.offsets))
                at = np.asarray(anchors.flatten()).astype(np.int64)
                base = np.repeat(w.offsets[:-1], sizes)
                np.add.at(marks, np.maximum(base, base + at - (PERIOD - 1)), 1)
                np.add.at(marks, base + at + 1, -1)
                near = np.cumsum(marks)[first] > 0
                first, h1, h2 = first[near], h1[near], h2[near]
                documents = w.documents[first]
                ids, at = _ids(part)[documents], (first - w.offsets[documents]).astype(np.int32)
                order = np.lexsort((at, ids, h2, h1))
                a, b = h1[order], h2[order]
                head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
                own, others, offsets = _grouped(order, head)
                # of a repeated row (same id and place) neither is later than the other
                same = (ids[others] == np.repeat(ids[own], np.diff(offsets))) & (at[others] == np.repeat(at[own], np.diff(offsets)))
                counts = np.add.reduceat(np.append(~same, False).astype(np.int64), np.minimum(offsets[:-1], len(same))) * (np.diff(offsets) > 0)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                others = others[~same]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[own].view(np.int64)), pa.array(h2[own]), pa.array(ids[own]), pa.array(at[own]), _places(ids[others], at[others], offsets)],
                    names=["h1", "h2", "doc_id", "at", "later"],
                )

    return run


def _kept(window: int, texts: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64())]
    schema = pa.schema([*fields, ("kept_text", pa.string()) if texts else ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                w = hashing.words(part.column("text"))
                marks = np.zeros(len(w.hashes) + 1, np.int64)
                lists = part.column("removed").fill_null([])
                sizes = np.diff(np.asarray(lists.offsets))
                at = np.repeat(w.offsets[:-1], sizes) + np.asarray(lists.flatten()).astype(np.int64)
                np.add.at(marks, at, 1)
                np.add.at(marks, np.minimum(at + window, len(w.hashes)), -1)
                gone = np.cumsum(marks)[:-1] > 0
                out = []
                for d in range(part.num_rows):
                    drop = gone[w.offsets[d] : w.offsets[d + 1]]
                    own = w.texts(d)
                    joined = b" ".join([x for x, g in zip(own, drop.tolist()) if not g] if drop.any() else own)
                    out.append(joined.decode() if texts else hashlib.sha256(joined).hexdigest())
                bounds = np.concatenate([[0], np.cumsum(gone)])[w.offsets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(np.diff(bounds).astype(np.int64)), pa.array(out, pa.string())],
                    schema=schema,
                )

    return run


def repeated_passages(docs: DataFrame, window: int = 20, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs(doc_id, text)``.

    A word goes if it lies in a window of ``window`` words whose sequence also
    starts earlier: in a document with a smaller doc_id, or earlier in the same
    one. Windows are judged on the input. The kept words are joined by one space;
    ``texts=True`` gives them as ``kept_text`` instead of their SHA-256.

    Defined cases: a null or empty text has no words; fewer than ``window`` words
    lose nothing; long texts are used whole; equal documents keep the one with
    the smallest doc_id; rows that repeat a doc_id with the same text get the
    same answer and don't count as copies of each other; a null doc_id is
    compared with nothing and keeps everything; other columns are ignored; an
    empty table gives an empty table. ``window`` must be at least 14.
    """
    if window < PERIOD + 1:
        raise ValueError(f"window must be at least {PERIOD + 1}")
    prepare(docs.sparkSession)
    texts_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    anchors = texts_of.where("doc_id is not null").mapInArrow(_anchors(window), f"h long, doc_id long, at int, others {_PLACES_DDL}")
    own = F.array(F.struct("doc_id", "at"))
    repeated = (
        anchors.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1 or size(others) > 0")
        .select(F.inline(F.concat(own, "others")))
    )
    # as long as the document's words at most
    per_document = pinned(repeated.groupBy("doc_id").agg(F.collect_list("at").alias("anchors")), "anchors")
    # both joins with the texts are left joins on the same key, so that one exchange of the texts serves both
    candidates = texts_of.join(per_document, "doc_id", "left").mapInArrow(
        _windows(window), f"h1 long, h2 int, doc_id long, at int, later {_PLACES_DDL}"
    )
    earliest = F.min(F.struct("doc_id", "at")).over(Window.partitionBy("h1", "h2"))
    itself = F.when(F.struct("doc_id", "at") > F.col("first"), own).otherwise(F.array().cast(_PLACES_DDL))
    removed = (
        candidates.withColumn("first", earliest).select(F.inline(F.concat(itself, "later")))
        .groupBy("doc_id").agg(F.collect_list("at").alias("removed"))
    )
    last = "kept_text" if texts else "kept_sha256"
    return (
        texts_of.join(removed, "doc_id", "left")
        .mapInArrow(_kept(window, texts), f"doc_id long, n_words long, n_removed long, {last} string")
    )
