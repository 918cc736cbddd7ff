"""Context-tree weighting against a recursive version with exact fractions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from remitlens.llm import context_tree, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SF_DIR = "/root/testdata/sf0.001"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    return WORD.findall(low)


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) if a + b else 0.0


class Trees:
    """One context tree per binary node, asked recursively."""

    def __init__(self, depth, texts):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for data in texts:
            for context, node, bit in self.path(data):
                for k in range(depth + 1):
                    self.counts[context[:k], node][bit] += 1
                    if k < depth:
                        self.children[context[:k], node].add(context[: k + 1])
        self.memo = {}

    def path(self, data):
        data = b"\n" * self.depth + data
        for i in range(self.depth, len(data)):
            context = data[i - self.depth : i][::-1]
            for j in range(8):
                yield context, (j, data[i] >> (8 - j)), data[i] >> (7 - j) & 1

    def weighted(self, context, node):
        """(log P_e, log of the product below, log P_w)."""
        key = context, node
        if key not in self.memo:
            pe = log_kt(*self.counts[key]) if key in self.counts else 0.0
            if len(context) == self.depth:
                self.memo[key] = pe, 0.0, pe
            else:
                below = sum(self.weighted(c, node)[2] for c in self.children.get(key, ()))
                top = max(pe, below)
                self.memo[key] = pe, below, top + math.log((math.exp(pe - top) + math.exp(below - top)) / 2)
        return self.memo[key]

    def probability(self, context, node, bit, k=0):
        a = self.counts.get((context[:k], node), (0, 0))
        own = (a[bit] + 0.5) / (sum(a) + 1)
        if k == self.depth:
            return own
        pe, below, _ = self.weighted(context[:k], node)
        top = max(pe, below)
        share = math.exp(pe - top) / (math.exp(pe - top) + math.exp(below - top))
        return share * own + (1 - share) * self.probability(context, node, bit, k + 1)

    def score(self, data):
        return sum(math.log10(self.probability(*x)) for x in self.path(data))


def brute(rows, depth):
    """{doc_id: list of (held_out, n_tokens, n_known, N, base, score)} of rows (doc_id, text)."""
    part = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 7
    learn = [(d, t) for d, t in rows if part(d) not in (None, 2)]
    counts = Counter(w for _, t in learn for w in [*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    trees = Trees(depth, [b" ".join(tokens(t)) + b"\n" for _, t in learn])
    out = defaultdict(list)
    for d, t in rows:
        own = [*tokens(t), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        out[d].append((part(d) == 2, len(own), sum(counts[w] > 0 for w in own), n, base, trees.score(b" ".join(tokens(t)) + b"\n")))
    return out


def same(result, expected):
    got = defaultdict(list)
    for r in result:
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert {d: len(x) for d, x in got.items()} == {d: len(x) for d, x in expected.items()}
    for d, own in expected.items():
        for a, b in zip(sorted(got[d]), sorted(own)):
            assert a[:4] == b[:4]
            assert a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)


def run(docs, **settings):
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    return context_tree.score(docs, part != 2, part == 2, **settings)


@pytest.mark.parametrize("depth, block_bytes", [(3, 1 << 24), (4, 700)])
def test_scores_equal_recursion(spark, docs, corpus, depth, block_bytes):
    rows = [(r[0], r[1]) for r in corpus if r[1] is None or len(r[1]) < 700]
    rows += [(5001, "Größe ÄÖ  x"), (5002, "w" * 300 + " tail"), (5003, "\x00 \x85 end\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    out = run(frame, depth=depth, block_bytes=block_bytes)
    assert out.columns == [
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"
    ]
    result = out.collect()
    same(result, brute(rows, depth))
    sizes = {d: len(b" ".join(tokens(t)) + b"\n") for d, t in rows}
    assert all(r.n_bytes == sizes[r.doc_id] and r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes) for r in result)


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    """Pieces of one text score as the text does."""
    assert context_tree._pieces(b"ab cd") == [b"ab cd"]
    monkeypatch.setattr(context_tree, "PIECE", 20)
    text = b"  aa bbb  c " + b"d" * 50 + b" \n ee ff " * 5
    pieces = context_tree._pieces(text)
    assert len(pieces) > 3 and b" ".join(pieces).split() == text.split() and all(p.split() for p in pieces)
    assert context_tree._pieces(b" " * 60) == [b""]


def test_piece_boundaries(spark):
    """A text longer than a piece, once in the middle of a table and once alone."""
    text = ("lorem ipsum dolor " * 300_000).strip()
    out = {r.doc_id: r for r in run(spark.createDataFrame([(1, text), (2, "lorem ipsum"), (10, text + " end")], "doc_id long, text string"), block_bytes=1 << 20).collect()}
    assert out[1].n_tokens == 900_001 and out[10].n_tokens == 900_002 and out[1].n_bytes == len(text) + 1
    assert 0 < out[1].bits_per_byte < 0.01


def test_probabilities_sum_to_one(spark):
    """All 256 bytes after one context."""
    context = int.from_bytes(b"ba", "big")
    rows = [(context << 8 | x, n) for x, n in [(x, (x * 7) % 5 if x < 90 else 0) for x in range(256)]]
    rows += [(int.from_bytes(b"bc", "big") << 8 | x, 3) for x in (65, 66)]
    lengths = context_tree.gram_lengths(spark.createDataFrame(rows, "gram long, n long"), 2)
    p = {r.gram: 10**r.log10_p for r in lengths.collect()}
    assert len(p) == 258
    assert math.fsum(v for g, v in p.items() if g >> 8 == context) == pytest.approx(1, abs=1e-12)


def test_nothing_to_learn(spark, empty):
    assert run(empty).collect() == []
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    r = run(spark.createDataFrame([(held, "ab c")], "doc_id long, text string")).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)
    assert r.score == pytest.approx(-5 * 8 * math.log10(2)) and r.bits_per_byte == pytest.approx(8)


def test_log_gamma():
    xs = np.array([0.5, 1.0, 1.5, 3.25, 10.0, 1e3, 1e7])
    assert context_tree._log_gamma(xs, np.log) == pytest.approx([math.lgamma(x) for x in xs], rel=1e-11, abs=1e-10)


def test_groups_stay_whole_across_batches():
    schema = pa.schema([("root", pa.int64())])
    rows = [1, 1, 2, 3, 3, 3, 3, 3, 4]
    seen = []
    run = context_tree._by_root(lambda t: seen.append(t["root"].to_pylist()) or [t["root"]], schema, least=3)
    out = [x for b in run(pa.record_batch([pa.array(rows[i : i + 2])], schema=schema) for i in range(0, 9, 2)) for x in b["root"].to_pylist()]
    assert out == rows and all(sum(r in g for g in seen) == 1 for r in rows)


def test_query(spark, tmp_path):
    """The bound query over a table of its own, every row against the recursion."""
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    rows = [(r.doc_id, (r.text or "")[:400]) for r in texts[:40]] + [(None, "no id"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    same(queries.QUERIES["op12_context_tree"](spark, str(tmp_path)).collect(), brute(rows, 5))


def test_held_out_texts_are_told(spark):
    """Held-out documents cost far less than their bytes."""
    result = queries.QUERIES["op12_context_tree"](spark, SF_DIR).where("held_out").collect()
    assert len(result) > 20
    assert -sum(r.score for r in result) * math.log2(10) / sum(r.n_bytes for r in result) < 2.4
