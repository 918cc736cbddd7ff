"""Near-duplicates, repeated passages and repeated lines against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from remitlens.llm import hashing, line_dedup, near_dedup, substring_dedup
from remitlens.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def classes(rows, k, percent):
    sets = defaultdict(list)
    for d, t in rows:
        if d is not None:
            sets[d].append(shingles(t, k))
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(docs, corpus, k):
    want = classes([(r[0], r[1]) for r in corpus], k, 80)
    got = near_dedup.near_duplicates(docs, shingle=k).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    sizes = {r[0]: len(shingles(r[1], k)) for r in corpus}
    assert all(sizes[r.doc_id] == r.n_shingles for r in got)


def test_near_duplicates_in_one_large_group_of_variants(spark):
    """Pairs on both sides of the threshold inside shared buckets, some linked through others only."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == classes(rows, 4, 80)


def test_repeated_id_with_two_texts_links_by_either(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, a), (1, b), (2, a), (3, b)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1}


def test_signature_is_circulant():
    values = np.array([3, 99, 12345], np.uint64)
    whole = near_dedup.signatures(values, np.array([0, 3]), 16)
    parts = near_dedup.signatures(values, np.array([0, 1, 2, 3]), 16)
    assert (whole[0] == parts.min(0)).all()
    view, _ = near_dedup._circulant(16)
    assert (view[0][1:] == view[1][:-1]).all()  # the next slot is the same permutation shifted by one


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def passages(rows, n):
    """(n_words, removed flags) per row, for rows of distinct ids in order."""
    seen, out = {}, {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if seen.setdefault(key, (d, i)) != (d, i):
                gone[i : i + n] = [True] * n
        out[d] = (w, gone)
    return out


@pytest.mark.parametrize("n", [14, 20])
def test_repeated_passages_equal_brute_force(docs, corpus, n):
    want = passages({(r[0], r[1]) for r in corpus if r[0] is not None}, n)
    got = substring_dedup.repeated_passages(docs, window=n).collect()
    assert len(got) == len(corpus)
    for r in got:
        w, gone = want[r.doc_id] if r.doc_id is not None else (WORD.findall(corpus[0][1]), [False] * 1000)
        text = " ".join(x for x, g in zip(w, gone) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone[: len(w)]), hashlib.sha256(text.encode()).hexdigest())
    kept = substring_dedup.repeated_passages(docs, window=n, texts=True).where("doc_id = 0").first().kept_text
    assert kept == " ".join(WORD.findall(corpus[0][1]))


def test_cover_meets_at_every_distance():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))
    with pytest.raises(ValueError):
        substring_dedup.repeated_passages(None, window=13)


def test_words_do_not_depend_on_segments(monkeypatch):
    texts = ["a bb\tccc", None, "", "x" * 5000 + " y", "é ü\x0bz", "end"]
    column = pa.array(texts)
    whole = hashing.words(column)
    monkeypatch.setattr(hashing, "SEGMENT", 3)
    cut = hashing.words(column)
    assert [whole.texts(d) for d in range(6)] == [[x.encode() for x in WORD.findall(t or "")] for t in texts]
    assert (whole.hashes == cut.hashes).all() and (whole.offsets == cut.offsets).all()
    assert len(hashing.words(pa.array([], pa.string())).hashes) == 0


LINES = [
    (1, "a\nb\nc\nd\n\ne"), (2, "x\na\nb\nc\nd\ny"), (3, "a\n \nb\n\nc"), (4, "p\np\np\np\np"), (5, "a\nb"), (6, ""), (7, None),
    (8, "a\nb\nc\nd\n\ne"), (9, "\n\n\n"), (8, "a\nb\nc\nd\n\ne"), (None, "a\nb\nc"),
]


def test_repeated_lines_cases(spark):
    frame = spark.createDataFrame(LINES, "doc_id long, text string").withColumn("gone", F.lit(1)).withColumn("spans", F.lit("x"))
    got = {(r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.repeated_lines(frame).collect()}
    assert got == {
        (1, 6, 0, "a\nb\nc\nd\n\ne"), (2, 6, 4, "x\ny"), (3, 5, 5, ""), (4, 5, 4, "p"), (5, 2, 0, "a\nb"), (6, 1, 0, ""),
        (7, 0, 0, None), (8, 6, 6, ""), (9, 4, 0, "\n\n\n"), (None, 3, 0, "a\nb\nc"),
    }


@pytest.mark.parametrize("run", [near_dedup.near_duplicates, substring_dedup.repeated_passages, line_dedup.repeated_lines])
def test_empty_table(empty, run):
    assert run(empty).collect() == []
