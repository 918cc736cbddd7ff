"""Word and window hashes over Arrow text batches, as whole-array numpy work.

A batch is one byte buffer with document offsets. Words, their hashes and the
hashes of word windows are computed for all documents of the batch together, in
segments of about a megabyte, so memory does not depend on the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_U = np.uint64

#: ASCII white space: the complement of the word class [^\x20\x09-\x0D].
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and bytes of longer code points.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _RANDOM.integers(0, 1 << 62, 8, dtype=np.uint64) * _U(2) + _U(1)
#: Byte codes with A-Z mapped to the codes of a-z, and without.
LOWERED = _BYTE.copy()
LOWERED[0x41:0x5B] = LOWERED[0x61:0x7B]
PLAIN = _BYTE


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit integers (multiply and shift)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


@dataclass
class Words:
    """Words of a batch: byte spans, hashes, and ``offsets[d]:offsets[d + 1]`` for document ``d``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    @property
    def documents(self) -> np.ndarray:
        """Document number of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def texts(self, d: int) -> list[bytes]:
        """The words of document ``d``."""
        a, b = self.offsets[d], self.offsets[d + 1]
        raw = self.data
        return [raw[s:e].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(column: pa.Array, separators: np.ndarray = SPACES, codes: np.ndarray = PLAIN) -> Words:
    """Words of every text of a column; a word never spans two texts."""
    raw, doc_offsets = buffers(column)
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[doc_offsets] = True
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < n:
        stop = min(n, at + SEGMENT)
        while stop < n and not separators[raw[stop]] and not first[stop]:  # up to the end of the word
            near = np.flatnonzero(separators[raw[stop : stop + 4096]] | first[stop : min(n, stop + 4096)])
            stop = stop + int(near[0]) if len(near) else min(n, stop + 4096)
            if len(near):
                break
        inside = ~separators[raw[at:stop]]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | first[at + 1 : stop]
        close = inside.copy()
        close[:-1] &= ~inside[1:] | first[at + 1 : stop]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
        if len(starts):
            lengths = ends - starts
            kept = np.cumsum(lengths) - lengths
            place = np.arange(int(lengths.sum())) - np.repeat(kept, lengths)
            power = np.cumprod(np.full(int(lengths.max()), _BASE[0], np.uint64))
            hashes = mix(np.add.reduceat(codes[raw[at:stop][inside]] * power[place], kept) ^ lengths.astype(np.uint64))
            parts.append((starts + at, ends + at, hashes))
        at = stop
    empty = np.zeros(0, np.int64)
    starts, ends, hashes = (
        (np.concatenate(p) for p in zip(*parts)) if parts else (empty, empty, np.zeros(0, np.uint64))
    )
    return Words(raw, starts, ends, hashes, np.searchsorted(starts, doc_offsets))


def windows(w: Words, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each window of ``size`` words that lies in one document."""
    n = len(w.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base = _BASE[1 + seed]
    h = np.full(n, _U(size), np.uint64)
    for j in range(size):
        h = (h ^ (h >> _U(31))) * base + w.hashes[j : j + n]
    documents = w.documents
    whole = np.flatnonzero(documents[:n] == documents[size - 1 :])
    return whole, mix(h[whole])


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted: (values, offsets).

    A document of fewer words than ``size`` has its whole sequence as the only
    shingle; one without words has none.
    """
    first, hashes = windows(w, size)
    documents = w.documents
    owner = documents[first] if len(first) else np.zeros(0, np.int64)
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    tails = []
    for d in short:
        own = w.hashes[w.offsets[d] : w.offsets[d + 1]]
        h = np.full(1, _U(len(own)), np.uint64)
        for x in own:
            h = (h ^ (h >> _U(31))) * _BASE[1] + x
        tails.append(mix(h))
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
    values, sizes, at = [], np.zeros(len(counts), np.int64), dict(zip(short.tolist(), tails))
    for d in range(len(counts)):
        own = np.unique(hashes[bounds[d] : bounds[d + 1]]) if bounds[d] < bounds[d + 1] else at.get(d)
        if own is not None:
            values.append(own)
            sizes[d] = len(own)
    return (
        np.concatenate(values) if values else np.zeros(0, np.uint64),
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
    )


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20):
    """Cut a batch into runs of rows of at most about ``most`` bytes of text (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = buffers(column)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column whose row ``i`` holds ``values[offsets[i]:offsets[i + 1]]`` as little-endian bytes."""
    data = np.ascontiguousarray(values).view(np.uint8)
    width = values.dtype.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(data)]
    ).cast(pa.binary())
