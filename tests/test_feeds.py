"""Payload readers, realtime messages, sinks and streams."""

import json
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from remitlens.operators import logs as lg
from remitlens.sources import payloads, schemas, sinks
from remitlens.streaming import jobs
from remitlens.streaming import messages as msg


def texts(spark, values):
    rows = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "event_id bigint, value string")


POINTS = [{"day": "2024-01-02", "volume_usd": 2}, {"date": "2024-01-01", "volume": 1.5}]


def test_series_envelopes(spark):
    junk = [{"volume": 5}, {"date": "2024-01-03", "volume": "7"}, {"date": "2024-01-04", "volume": None, "payment_volume": 4}, {"date": ""}]
    for payload in (POINTS + junk, {"points": POINTS + junk}, {"series": POINTS + junk}, {"data": POINTS + junk}):
        got = payloads.normalize_series(texts(spark, [payload]), payloads.VALUE_NAMES["volume"], ["event_id"], out="volume").collect()
        assert [(r["date"], r["volume"]) for r in got] == [("2024-01-01", 1.5), ("2024-01-02", 2.0), ("2024-01-04", 4.0)]
    nothing = payloads.normalize_series(texts(spark, [{"other": POINTS}, "not json"]), ["volume"], ["event_id"])
    assert nothing.count() == 0


def test_payment_page_file(spark, tmp_path):
    page = {"_embedded": {"records": [
        {"id": "1", "transaction_successful": True, "from": "GA", "to": "GB", "amount": "12.5000000", "asset_type": "native", "created_at": "2024-01-01T00:00:00Z"},
        {"id": "2", "transaction_successful": False, "from": "GA", "to": "GC", "amount": "oops", "asset_type": "credit_alphanum4", "asset_code": "USD"},
    ]}}
    (tmp_path / "page.json").write_text(json.dumps(page, indent=1))
    rows = payloads.payments(payloads.read_pages(spark, str(tmp_path), schemas.PAYMENT_PAGE)).orderBy("id").collect()
    assert [(r["asset_code"], r["amount"] and float(r["amount"])) for r in rows] == [("XLM", 12.5), ("USD", None)]


def test_orderbook_and_trades(spark):
    book = {"bids": [{"price": "1.1", "amount": "5"}, {"price": "1.0", "amount": "6"}], "asks": [{"price": "1.2", "amount": "7"}], "base": {}, "counter": {"asset_code": "USD"}}
    rows = payloads.orderbook(payloads.parse_pages(texts(spark, [book]), schemas.ORDERBOOK)).orderBy("side", "level").collect()
    assert [(r["side"], r["level"], float(r["price"])) for r in rows] == [("ask", 0, 1.2), ("bid", 0, 1.1), ("bid", 1, 1.0)]
    trade = {"_embedded": {"records": [{"id": "1", "price": {"n": "1", "d": "4"}}, {"id": "2", "price": {"n": "1", "d": "0"}}]}}
    prices = payloads.trades(payloads.parse_pages(texts(spark, [trade]), schemas.TRADE_PAGE)).orderBy("id").collect()
    assert [r["price"] for r in prices] == [0.25, None]


VALID = {
    "snapshot_update": {"snapshot_id": "s", "epoch": 1, "timestamp": "t", "hash": "h"},
    "corridor_update": {"corridor_id": "c", "corridor_key": "k", "success_rate": 9.5, "volume_usd": 1, "total_transactions": 2},
    "anchor_update": {"anchor_id": "a", "name": "n", "reliability_score": 1, "status": "s"},
    "ping": {"timestamp": 1}, "pong": {"timestamp": 1.5}, "connected": {"connection_id": "x"}, "error": {"message": "m"},
    "health_alert": {"corridor_id": "c", "severity": "critical", "message": "m", "timestamp": "t"},
    "new_payment": {"corridor_id": "c", "amount": 5, "successful": True, "timestamp": "t"},
    "subscription_confirm": {},
}


def test_every_message_type(spark):
    rows = msg.parse_messages(texts(spark, [{"type": k, **v} for k, v in VALID.items()])).orderBy("event_id").collect()
    assert [r["kind"] for r in rows] == list(VALID)
    assert rows[1]["success_rate"] == 9.5 and rows[8]["successful"] is True and rows[8]["amount"] == 5.0


def test_damaged_messages(spark):
    bad = [
        "not json", '"text"', "[1, 2]", "null", "5", {"no": "type"}, {"type": 7}, {"type": None},  # dropped
        {"type": "brand_new"}, {"type": "ping", "timestamp": "1"}, {"type": "health_alert", "corridor_id": "c", "severity": "fatal", "message": "m", "timestamp": "t"},
        {"type": "new_payment", "corridor_id": "c", "amount": 5, "successful": 1, "timestamp": "t"},
    ]
    rows = msg.parse_messages(texts(spark, bad)).orderBy("event_id").collect()
    assert [(r["event_id"], r["kind"]) for r in rows] == [(8, "unknown"), (9, "unknown"), (10, "unknown"), (11, "unknown")]


def test_subscriptions_and_gaps(spark):
    parsed = msg.parse_messages(texts(spark, [{"type": "corridor_update", **VALID["corridor_update"]}, {"type": "new_payment", **VALID["new_payment"]}]))
    subs = spark.createDataFrame([("me", "corridor:k"), ("you", "payments:c"), ("me", "payments:z")], "subscriber string, channel string")
    assert sorted((r["subscriber"], r["event_id"]) for r in msg.subscribed(parsed, subs).collect()) == [("me", 0), ("you", 1)]
    start = datetime(2024, 1, 1)
    feed = spark.createDataFrame(
        [("a", i, start + timedelta(seconds=s)) for i, s in enumerate((0, 30, 61, 62))], "connection string, event_id int, received_at timestamp_ntz"
    )
    assert [r["gap_seconds"] for r in msg.stale_gaps(feed, "connection", rows_per_block=1).collect()] == [31.0]


def log_rows():
    return [
        {"timestamp": "2024-01-01T00:00:01Z", "level": "ERROR", "message": "x", "error": {"message": "boom"}, "token": "t", "http_method": "GET", "response_time_ms": 1500},
        {"timestamp": "2024-01-02T00:00:01.123+0000", "level": "info", "message": "y", "request_id": "r1", "query": "q"},
    ]


def test_log_files_to_daily_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(r) for r in log_rows()))
    shaped = lg.shape_logs(payloads.read_logs(spark, str(tmp_path / "in")))
    assert "token" not in shaped.columns and "error" not in shaped.columns
    first = shaped.where("log_level = 'ERROR'").first()
    assert first["tags"] == ["error", "http_request"] and first["error_message"] == "boom" and first["response_time_seconds"] == 1.5
    assert shaped.where("log_level = 'info'").first()["trace_id"] == "r1"
    query = jobs.run_log_router(payloads.stream_logs(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    query.awaitTermination()
    everything = spark.read.parquet(str(tmp_path / "out/logs/all"))
    assert sorted(r["log_date"] for r in everything.collect()) == [date(2024, 1, 1), date(2024, 1, 2)]
    assert spark.read.parquet(str(tmp_path / "out/logs/errors")).count() == 1


def test_retention_drops_old_partitions_only(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = [(i, date(2024, 1, 1) + timedelta(days=i)) for i in range(40)]
    spark.createDataFrame(rows, "id int, log_date date").write.partitionBy("log_date").parquet(path)
    removed = sinks.apply_retention(spark, path, datetime(2024, 2, 9))
    assert len(removed) == 10 and removed[-1] == "log_date=2024-01-10"
    assert spark.read.parquet(path).count() == 30


def test_retention_over_routed_logs_and_repeated_batches(spark, tmp_path):
    path = str(tmp_path / "routed")
    logs = spark.createDataFrame([(i, datetime(2024, 1, 1 + i), ["error"] if i % 2 else []) for i in range(20)], "id int, event_time timestamp, tags array<string>")
    for _ in range(2):
        sinks.route_logs(logs, path, batch_id=7, files_per_day=1)
    assert spark.read.parquet(f"{path}/all").count() == 20 and spark.read.parquet(f"{path}/errors").count() == 10
    assert len(sinks.apply_retention(spark, f"{path}/all", datetime(2024, 2, 9))) == 10
    assert spark.read.parquet(f"{path}/all").count() == 10


def test_pages_by_line_and_by_file(spark, tmp_path):
    for name, text in (("lines", '{"a": 1}\n{"a": 2}\n{"a": 3}\n'), ("whole", '{\n "a": 4\n}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.json").write_text(text)
    assert sorted(r["a"] for r in payloads.read_pages(spark, str(tmp_path / "lines"), "a int", lines=True).collect()) == [1, 2, 3]
    assert [r["a"] for r in payloads.read_pages(spark, str(tmp_path / "whole"), "a int").collect()] == [4]


def _written(folder):
    """Text of the one part file that holds the row (empty partitions may leave files too)."""
    return max((p.read_text() for p in folder.glob("part-*")), key=len)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame(
        [("a,b", datetime(2024, 1, 2, 3, 4, 5), 0.98765, None)], "name string, date timestamp_ntz, success_rate double, note string"
    )
    sinks.export_csv(df, {"name": "Name", "date": "When", "success_rate": "Rate", "note": "Note"}, str(tmp_path / "csv"))
    text = _written(tmp_path / "csv").splitlines()
    assert text == ["Name,When,Rate,Note", '"a,b",2024-01-02 03:04:05,98.77%,']
    sinks.export_json(df, ["name"], str(tmp_path / "json"))
    assert json.loads(_written(tmp_path / "json")) == {"name": "a,b"}


def test_network_store_prunes(spark, tmp_path):
    df = spark.createDataFrame([("a", "testnet"), ("b", "mainnet")], "corridor string, network string")
    for _ in range(2):  # a repeated batch replaces itself
        sinks.append_metrics(df, str(tmp_path / "store"), batch_id=3)
    stored = spark.read.parquet(str(tmp_path / "store")).where("network = 'mainnet'")
    assert [r["corridor"] for r in stored.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(network" in stored._jdf.queryExecution().toString()


def _write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


MESSAGE = "event_id bigint, received_at timestamp, kind string, note string"


def test_bounded_lists_over_two_batches(spark, tmp_path):
    def rows(start, n, kind):
        return [{"event_id": i, "received_at": f"2024-01-01T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}", "kind": kind, "note": "n"} for i in range(start, start + n)]

    source = tmp_path / "in"
    for name, start in (("a.json", 0), ("b.json", 1000)):
        _write(source, name, rows(start, 60, "health_alert") + rows(start, 70, "new_payment"))
        stream = spark.readStream.schema(MESSAGE).json(str(source))
        jobs.run_bounded_lists(stream, str(tmp_path / "out")).awaitTermination()
    alerts = jobs.bounded_list(spark, str(tmp_path / "out"), "health_alert", 1)
    assert sorted(r["event_id"] for r in alerts.collect()) == list(range(1010, 1060))
    pays = jobs.bounded_list(spark, str(tmp_path / "out"), "new_payment", 1)
    assert sorted(r["event_id"] for r in pays.collect()) == list(range(40, 70)) + list(range(1000, 1070))


def test_latest_state_stream_resumes(spark, tmp_path):
    source = tmp_path / "in"
    for name, event_id in (("a.json", 1), ("b.json", 2)):
        _write(source, name, [{"event_id": event_id, "received_at": "2024-01-01T00:00:00", "kind": "corridor_update", "note": f"v{event_id}"}])
        stream = spark.readStream.schema(MESSAGE).json(str(source)).withColumn("corridor_key", F.lit("k"))
        jobs.run_to_files(msg.latest_state(stream, "corridor_update", "corridor_key", ["event_id"]), str(tmp_path / "out")).awaitTermination()
    got = jobs.latest_rows(spark, str(tmp_path / "out"), ["corridor_key"]).collect()
    assert [(r["event_id"], r["note"]) for r in got] == [(2, "v2")]


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    source = tmp_path / "in"
    _write(source, "a.json", [{"user_id": 1, "ts": f"2024-01-01T00:{m:02d}:00"} for m in (0, 5)] + [{"user_id": 2, "ts": "2024-01-01T12:00:00"}])
    stream = spark.readStream.schema("user_id bigint, ts timestamp").json(str(source))
    jobs.run_to_files(msg.session_windows(stream), str(tmp_path / "out"), mode="append").awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out/out")).collect()
    assert [(r["user_id"], r["events"]) for r in rows] == [(1, 2)]  # the other session is still open


def test_silent_connection_is_reported(spark, tmp_path):
    source = tmp_path / "in"
    _write(source, "a.json", [{"connection": "c", "received_at": "2024-01-01T00:00:00"}])
    stream = spark.readStream.schema("connection string, received_at timestamp").json(str(source))
    query = (
        jobs.staleness(stream, seconds=1).writeStream.format("memory").queryName("stale").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    )
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("stale").where("stale").isEmpty():
            time.sleep(0.5)
        assert [r["connection"] for r in spark.table("stale").where("stale").collect()] == ["c"]
    finally:
        query.stop()


def test_catch_up(spark):
    rows = lambda *days: spark.createDataFrame([(f"x{d}", datetime(2024, 1, d), "p") for d in days], "id string, updated_at timestamp_ntz, payload string")
    got = msg.catch_up(rows(1, 5), rows(2, 6), datetime(2024, 1, 4), ["corridor", "anchor"]).collect()
    assert sorted((r["type"], r["id"]) for r in got) == [("anchor", "x6"), ("corridor", "x5")]
    only = msg.catch_up(rows(1, 5), rows(2, 6), datetime(2024, 1, 1), ["anchor"])
    assert only.count() == 2


@pytest.mark.parametrize("when, group", [((2024, 1, 10, 1), "Today"), ((2024, 1, 9, 23), "Yesterday"), ((2024, 1, 3, 13), "Last 7 Days"), ((2024, 1, 3, 12), "Last 30 Days"), ((2023, 12, 1, 0), "Older")])
def test_age_groups_compare_strictly(spark, when, group):
    from remitlens.operators import notifications

    df = spark.createDataFrame([(datetime(*when),)], "ts timestamp_ntz")
    assert notifications.group_by_age(df, datetime(2024, 1, 10, 12)).first()["group"] == group
