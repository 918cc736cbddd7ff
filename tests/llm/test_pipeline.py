"""The pipeline stage by stage against plain Python, and the bound queries with SQL against DuckDB."""

import os
import re

import pytest

import corpus_pipeline
from compare import compare, connect
from remitlens.llm import language_id, queries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not mounted")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF_DIR), queries.QUERIES[name], queries.ORACLES[name], SF_DIR) is None


def cut_lines(rows):
    seen, out = set(), {}
    for d, text in sorted(rows):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for k in range(len(full) - 2):
            key = tuple(lines[i] for i in full[k : k + 3])
            gone |= set(range(full[k], full[k + 2] + 1)) if key in seen else set()
            seen.add(key)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or WORD.search(kept):
            out[d] = kept
    return out


def one_of_each(texts):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(low(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: texts[d] for d in names if root(d) == d}


def test_stages(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    net = language_id.train(docs, steps=250)
    monkeypatch.setattr(language_id, "train", lambda docs: net)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontaminate", "packing"]

    first = stages["language_id"](spark, docs, SF_DIR).cache()
    assert first.columns == docs.columns
    rows = {r.doc_id: r.text for r in first.collect()}
    lettered = {r.doc_id for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text)}
    assert len(rows) >= 0.99 * len(lettered) and set(rows) <= lettered

    second = stages["line_dedup"](spark, first, SF_DIR).cache()
    assert second.columns == docs.columns
    cut = {r.doc_id: r.text for r in second.collect()}
    assert cut == cut_lines(rows.items())
    assert all(r.n_chars == len(r.text) for r in second.collect())

    third = stages["near_dedup"](spark, second, SF_DIR).cache()
    kept = {r.doc_id: r.text for r in third.collect()}
    assert kept == one_of_each(cut)

    fourth = stages["decontaminate"](spark, third, SF_DIR).cache()
    left = {r.doc_id for r in fourth.collect()}
    plain = lambda t: " " + " ".join(re.findall(r"[a-z0-9\u0080-￿]+", t.lower())) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    whole = {d for d, t in kept.items() if any(i in plain(t) for i in items)}
    assert not left & whole and len(kept) - len(left) <= len(whole) + 1

    packed = stages["packing"](spark, fourth, SF_DIR).collect()
    assert {r.doc_id for r in packed} == left
    assert all(0 < r.length <= 2048 for r in packed)


def test_stage_edge_cases(spark, docs, empty, monkeypatch):
    """Extra columns pass the filters; nulls and blanks stay where a stage does not judge them."""
    for name in ("line_dedup", "near_dedup"):
        stage = dict(corpus_pipeline.STAGES)[name]
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        assert out.where("doc_id is null").count() == 1
        assert stage(spark, empty, SF_DIR).count() == 0
    assert corpus_pipeline.drop_contaminated(spark, empty, SF_DIR).count() == 0
    net = language_id.fit([("en", b"word", 3), ("de", b"wort", 3)], steps=5)
    monkeypatch.setattr(language_id, "train", lambda docs: net)
    assert corpus_pipeline.identify_language(spark, docs, SF_DIR).where("text is null or trim(text) = ''").count() == 0
