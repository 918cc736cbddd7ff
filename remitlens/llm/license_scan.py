"""License texts in documents: MinHash bands over overlapping windows, then exact containment.

A copy of a template is a stretch of L shingles that holds ``percent`` of the
template's distinct shingles. L is the template's length and ``inserted`` words
more; where the percentage allows the loss of fewer shingles than one insertion
breaks, L is the length alone. Copies are looked for in windows of S shingles, S a
power of two with L <= S / 2 + 1, at every S / 2: any stretch of L shingles lies
whole in one window. That window has a Jaccard similarity of at least
J = need / (S + s - need) with the template's s distinct shingles, and as many bands
are taken as make a miss less likely than ``miss``. Retrieved windows are widened by
L to both sides, joined where they overlap, and every stretch in them is counted on
full shingle sets, so the result does not depend on where the windows lie.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from remitlens.llm import hashing
from remitlens.llm.near_dedup import UNIVERSE, _circulant
from remitlens.llm.store import prepare

MAX_TEMPLATE_WORDS = 200_000
INSERTED = 64  # words that a copy may have more than its template, in all
_STEP = 8192  # shingles of a document that are looked at together; a multiple of every stride up to its half

# Notices and opening paragraphs of common licenses.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at"
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}


def stretch_size(shingles: int, percent: int = 80, shingle: int = 5, inserted: int = INSERTED, distinct: int | None = None) -> int:
    """Longest copy of a template of so many shingles (``distinct`` of them different) that is looked for."""
    distinct = shingles if distinct is None else distinct
    lost = distinct - -(-percent * distinct // 100)
    return shingles + inserted if lost >= shingle - 1 or distinct < shingles else shingles


def window_size(shingles: int, percent: int = 80, shingle: int = 5, inserted: int = INSERTED, distinct: int | None = None) -> int:
    """Window for a template of so many shingles: a power of two, at least 2."""
    stretch = stretch_size(shingles, percent, shingle, inserted, distinct)
    return max(2, 1 << (2 * (stretch - 1) - 1).bit_length()) if stretch > 1 else 2


def bands_for(shingles: int, percent: int, miss: float, size: int | None = None) -> int:
    """Bands of one coordinate that miss a matching window with probability ``miss`` at most."""
    need, size = -(-percent * shingles // 100), size or window_size(shingles, percent)
    similarity = need / (size + shingles - need)
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log1p(-similarity))


def _prepared(templates: dict[str, str], shingle: int, percent: int, miss: float, inserted: int) -> dict[int, list[tuple[str, np.ndarray, int, int]]]:
    """Window size -> (name, distinct shingle hashes, stretch, bands) of its templates."""
    words = hashing.words(pa.array(list(templates.values()), pa.string()), hashing.PUNCTUATION, hashing.LOWERED)
    if len(words.hashes) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of {len(words.hashes)} words; at most {MAX_TEMPLATE_WORDS} go to every task")
    values, offsets = hashing.shingle_sets(words, shingle)
    out: dict[int, list[tuple[str, np.ndarray, int, int]]] = {}
    for i, name in enumerate(templates):
        if words.counts[i] < shingle:
            raise ValueError(f"template {name} has fewer than {shingle} words")
        own = values[offsets[i] : offsets[i + 1]]
        shape = (int(words.counts[i]) - shingle + 1, percent, shingle, inserted, len(own))
        size = window_size(*shape)
        out.setdefault(size, []).append((name, own, stretch_size(*shape), bands_for(len(own), percent, miss, size)))
    return out


def _slots(values: np.ndarray, odd: int) -> np.ndarray:
    return (hashing.mix(values * np.uint64(odd)) >> np.uint64(64 - 22)).astype(np.int64)


class _Retriever:
    """Candidate (window start, template) pairs of a document's shingles for one window size."""

    def __init__(self, size: int, templates: list[tuple[str, np.ndarray, int, int]], view: np.ndarray, odd: int):
        self.size, self.templates = size, templates
        self.bands = max(b for *_, b in templates)
        self.least = np.stack([view[_slots(own, odd)].min(0)[: self.bands] for _, own, *_ in templates])
        self.marked = np.zeros(UNIVERSE, bool)
        self.marked[self.least.ravel()] = True

    def candidates(self, rows: np.ndarray):
        stride = self.size // 2
        n = -(-len(rows) // stride)
        rows = rows[:, : self.bands]
        if len(rows) < n * stride:
            rows = np.concatenate([rows, np.full((n * stride - len(rows), self.bands), UNIVERSE - 1, rows.dtype)])
        blocks = rows.reshape(n, stride, self.bands).min(1) if stride > 1 else rows
        windows = np.minimum(blocks[:-1], blocks[1:]) if n > 1 else blocks
        for i in np.flatnonzero(self.marked[windows].any(1)).tolist():
            hit = self.least == windows[i]
            for j, (*_, bands) in enumerate(self.templates):
                if hit[j, :bands].any():
                    yield i * stride, j


def best_stretch(hashes: np.ndarray, template: np.ndarray, stretch: int) -> tuple[int, int]:
    """(first shingle, distinct shingles of ``template``) of the fullest stretch, the first of equals.

    A stretch starts at a shingle of the template; ``template`` is sorted.
    """
    at = np.minimum(np.searchsorted(template, hashes), len(template) - 1)
    places = np.flatnonzero(template[at] == hashes)
    kinds, places = at[places].tolist(), places.tolist()
    counts: dict[int, int] = {}
    best, end = (0, 0), 0
    for i, start in enumerate(places):
        while end < len(places) and places[end] < start + stretch:
            counts[kinds[end]] = counts.get(kinds[end], 0) + 1
            end += 1
        if len(counts) > best[1]:
            best = start, len(counts)
        counts[kinds[i]] -= 1
        if not counts[kinds[i]]:
            del counts[kinds[i]]
    return best


def find_licenses(hashes: np.ndarray, retrievers: list[_Retriever], view: np.ndarray, odd: int, percent: int) -> dict[str, tuple[int, int, int]]:
    """name -> (first shingle of the stretch, shared, template's shingles) of the best stretch of a document."""
    best: dict[str, tuple[int, int, int]] = {}
    for r in retrievers:
        regions: dict[int, list[list[int]]] = {}
        for at in range(0, len(hashes), _STEP):
            own = hashes[at : at + _STEP + r.size]
            for start, j in r.candidates(view[_slots(own, odd)]):
                regions.setdefault(j, []).append([at + start - r.templates[j][2], at + start + r.size + r.templates[j][2]])
        for j, spans in regions.items():
            name, template, stretch, _ = r.templates[j]
            joined: list[list[int]] = []
            for a, b in sorted(spans):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([max(0, a), b])
            for a, b in joined:
                start, shared = best_stretch(hashes[a:b], template, stretch)
                if 100 * shared >= percent * len(template) and shared > best.get(name, (0, 0, 0))[1]:
                    best[name] = (a + start, shared, len(template))
    return best


def scan(docs: DataFrame, templates: dict[str, str] | None = None, shingle: int = 5, percent: int = 80, miss: float = 1e-6, inserted: int = INSERTED) -> DataFrame:
    """(doc_id, license, first_word, n_shared, n_shingles) for each license found in ``docs(doc_id, text)``.

    Words are runs of ASCII letters and digits and other code points, A-Z
    lower-cased. A license is found when some stretch of its template's length and
    ``inserted`` words more, wherever it stands, holds at least ``percent`` / 100 of
    the template's distinct shingles (a template that one insertion takes below
    ``percent`` is looked for in its own length); the row names the stretch with
    most of them, the first of equals, by its first word that belongs to the template.

    Defined cases: null, empty and short texts hold no license; texts of any
    length are scanned whole, in overlapping stretches; rows that repeat a doc_id
    are answered one by one; a null doc_id passes through; other columns are
    ignored; an empty table or an empty template list gives an empty table.
    Templates of fewer than ``shingle`` words and of more than
    ``MAX_TEMPLATE_WORDS`` in all raise ValueError.
    """
    prepare(docs.sparkSession)
    by_size = _prepared(TEMPLATES if templates is None else templates, shingle, percent, miss, inserted)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("first_word", pa.int64()), ("n_shared", pa.int64()), ("n_shingles", pa.int64())])

    def run(batches):
        width = max((b for own in by_size.values() for *_, b in own), default=1)
        view, odd = _circulant(width)
        retrievers = [_Retriever(size, own, view, odd) for size, own in sorted(by_size.items())]
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                w = hashing.words(part.column("text"), hashing.PUNCTUATION, hashing.LOWERED)
                first, hashes = hashing.windows(w, shingle)
                bounds = np.searchsorted(first, w.offsets)
                rows = []
                for d, name in enumerate(part.column("doc_id").to_pylist()):
                    own = hashes[bounds[d] : bounds[d + 1]]
                    if len(own):
                        rows += [(name, k, *v) for k, v in sorted(find_licenses(own, retrievers, view, odd, percent).items())]
                columns = list(zip(*rows)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, license string, first_word long, n_shared long, n_shingles long"
    )
