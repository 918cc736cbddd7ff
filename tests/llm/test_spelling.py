"""Spelling variants against all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from remitlens.llm import queries, spelling

SF_DIR = "/root/testdata/sf0.001"


def distance_one(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) - len(x) == 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def brute_words(rows):
    counts = Counter()
    for d, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            k = h % len(run)
            counts[run if h % 97 else run[:k] + run[k + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(words):
    """{word: (form, root, n, n_near, form_n)}, neighbours by deletion lists."""
    shape = {}
    for w in words:
        for k in range(len(w)):
            shape.setdefault((k, w[:k], w[k + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            near[w] |= shape[k, w[:k], w[k + 1 :]] - {w}
            if w[:k] + w[k + 1 :] in words:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def table(result):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in result}


@pytest.mark.parametrize("alphabet, few", [("ab", 24), ("abcé", 24), ("abcdefgh", 0), ("abcdefgh", 1000)])
def test_scan_finds_all_pairs(alphabet, few, monkeypatch):
    monkeypatch.setattr(spelling, "_FEW", few)
    rng = random.Random(2)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(150)}
    for w in list(words)[:50]:
        k = rng.randrange(len(w))
        words |= {w[:k] + "z" + w[k:], w[:k] + "q" + w[k + 1 :], w[:k] + w[k + 1 :] or "a"}
    words = list(words)
    pairs = spelling.one_edit(words)
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and distance_one(a, b)}
    assert spelling.one_edit([]) == [] and spelling.one_edit(["lonely"]) == []


@pytest.mark.parametrize("most", [2, 40, 2048])
def test_variants_equal_brute_force(spark, most):
    """Short lists force every level of the cutting; one beginning holds a third of all words."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))): rng.randint(3, 60) for _ in range(700)}
    words |= {"common" + "".join(rng.choice("xyz") for _ in range(rng.randint(1, 5))): rng.randint(3, 9) for _ in range(300)}
    words |= {"chain" + "a" * k: 3 * 2**k for k in range(12)} | {"verylongword" * 20: 3, "verylongword" * 20 + "s": 7}
    frame = spark.createDataFrame([*words.items(), (None, 5), ("abc", 9), ("nothing", None)], "word string, n long").repartition(4)
    assert table(spelling.variants(frame, most).collect()) == brute(words)


def test_vocabulary(spark, docs, corpus, monkeypatch):
    rows = [(r[0], r[1]) for r in corpus] + [(i, "Straße ÀÉ÷× naïve NAÏVE Hello-hello" + " word" * i) for i in range(9000, 9012)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.word: r.n for r in spelling.vocabulary(frame).collect()} == brute_words(rows)
    text = "alpha beta" * 50 + " gamma"
    monkeypatch.setattr(spelling, "_CHUNK", 7)
    assert "".join(spelling._chunks(text)) == text
    assert [x for part in spelling._chunks(text) for x in re.findall("[a-z]+", part)] == re.findall("[a-z]+", text)


def test_empty(spark, empty):
    out = spelling.variants(spelling.vocabulary(empty))
    assert out.collect() == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    out = queries.QUERIES["op13_spelling"](spark, SF_DIR)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert table(out.collect()) == brute(brute_words(rows))
