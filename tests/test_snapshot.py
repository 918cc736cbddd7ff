"""Snapshots are reproducible, and replay filters before it aggregates."""

import inspect
import json

import pytest

from remitlens.errors import EmptyInput, InvalidRange
from remitlens.operators import snapshot as op
from remitlens.sources import sinks
from remitlens.sources.schemas import RAW_SNAPSHOT_ROW

ROWS = [
    (1400, "eur/usd", "mainnet", 0.7, 10.0, 45.0),
    (1401, "eur/usd", "mainnet", 0.8, 30.0, 40.0),
    (1420, "btc/usd", "mainnet", 0.95, 50.0, 66.0),
    (1410, "btc/usd", "mainnet", 0.9, 20.0, 60.0),
]
EMPTY = '{"model_version":"reliability-v2025.01","records":[]}'


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, RAW_SNAPSHOT_ROW)


def payload(df):
    return "".join(r["value"] for r in df.orderBy("position").collect())


def test_golden_values(rows):
    got = json.loads(payload(op.replay_payload(rows, 1400, 1420)))
    assert [r["corridor"] for r in got["records"]] == ["btc/usd", "eur/usd"]
    btc, eur = got["records"]
    assert btc["avg_reliability"] == pytest.approx(0.925) and btc["total_volume"] == 70.0 and btc["avg_latency_ms"] == 63.0
    assert eur["avg_reliability"] == pytest.approx(0.75) and eur["total_volume"] == 40.0 and eur["avg_latency_ms"] == 42.5


def test_same_bytes_for_any_order_and_partitioning(spark):
    rows = [(i, f"c{i % 7}", "mainnet", (i * 37 % 101) / 101, i * 0.1, i / 3) for i in range(2000)]
    forward = spark.createDataFrame(rows, RAW_SNAPSHOT_ROW)
    backward = spark.createDataFrame(rows[::-1], RAW_SNAPSHOT_ROW)
    texts = {
        payload(op.replay_payload(df, 0, 2000))
        for df in (forward, backward, forward.repartition(13), backward.repartition(3, "latency_ms"), forward)
    }
    assert len(texts) == 1


def test_empty_and_reversed_range(rows):
    assert payload(op.replay_payload(rows, 1, 2)) == EMPTY
    with pytest.raises(InvalidRange):
        op.replay(rows, 5, 1)
    with pytest.raises(EmptyInput):
        op.generate_snapshot(rows.where("false"), require_rows=True)


def test_source_is_that_of_the_lowest_ledger(spark):
    rows = [(2, "x", "mainnet", 1.0, 1.0, 1.0), (1, "x", "testnet", 1.0, 1.0, 1.0), (1, "x", "zeta", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, RAW_SNAPSHOT_ROW)
    assert op.generate_snapshot(df).first()["source"] == "testnet"
    assert op.generate_snapshot(df, by_network=True).count() == 3


def test_payload_of_two_networks_in_one_corridor_is_json(spark):
    rows = [(1, "a", "x", 1.0, 1e-13, 1.0), (1, "a", "y", 1.0, 1e26, 1.0), (1, "b", "x", float("nan"), 1.0, None)]
    snap = op.generate_snapshot(spark.createDataFrame(rows, RAW_SNAPSHOT_ROW), by_network=True)
    got = json.loads(payload(op.payload_lines(snap)))["records"]
    assert [(r["corridor"], r["source"]) for r in got] == [("a", "x"), ("a", "y"), ("b", "x")]
    assert [r["total_volume"] for r in got] == [1e-13, 1e26, 1.0] and got[2]["avg_reliability"] is None


def test_written_lines_are_the_payload(rows, tmp_path):
    snap = op.generate_snapshot(rows)
    sinks.write_snapshot_payload(snap, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    text = "".join("".join(p.read_text().splitlines()) for p in parts)
    assert text == payload(op.payload_lines(snap))


def test_digest_ignores_order_but_not_content(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS v")
    first = op.snapshot_digest(df, ["id", "v"], "all").first()
    assert first == op.snapshot_digest(df.repartition(5, "v"), ["id", "v"], "all").first()
    assert first["record_count"] == 100
    changed = op.snapshot_digest(df.selectExpr("id", "if(id = 5, 11, v) AS v"), ["id", "v"], "all").first()
    assert changed["data_hash"] != first["data_hash"]


def test_no_clock_on_the_replay_path():
    source = inspect.getsource(op)
    assert not any(word in source for word in ("current_timestamp", "datetime.now", "time.time", "unix_timestamp()"))
