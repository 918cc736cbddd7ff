"""JSON payloads, realtime messages, streams and exports over the supplied tables."""

from datetime import datetime

from pyspark.sql import functions as F

from remitlens.operators import contract_events as ev
from remitlens.operators import snapshot
from remitlens.plans import contracts as contract_plans
from remitlens.plans import corridors as corridor_plans
from remitlens.plans import operations
from remitlens.plans.registry import ORACLES, query, rounded
from remitlens.plans.views import EVENTS, PAYMENTS, dsum
from remitlens.sources import commits, payloads, schemas, sinks
from remitlens.sources.tables import events, payments, table
from remitlens.streaming import jobs
from remitlens.streaming import messages as msg


def _pages(df, key, record, schema):
    """JSON pages with one page per key, as an endpoint would return them."""
    page = F.to_json(F.struct(F.struct(F.collect_list(record).alias("records")).alias("_embedded")))
    text = df.groupBy(key).agg(page.alias("value")).select("value")
    return payloads.parse_pages(text, schema)


# ---- JSON envelopes ------------------------------------------------------------------------------


@query(
    "read_payments",
    """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag <> 'R' AS transaction_successful, 'G' || o_custkey AS source_account, 'G' || l_suppkey AS dest_account,
    CASE WHEN l_linestatus = 'O' THEN 'USD' ELSE 'XLM' END AS asset_code, CAST(l_extendedprice AS DOUBLE) AS amount, l_shipdate AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def read_payments(spark, sf):
    base = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    g = lambda c: F.concat(F.lit("G"), F.col(c).cast("string"))
    record = F.struct(
        F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)").alias("id"),
        (F.col("l_returnflag") != "R").alias("transaction_successful"),
        g("o_custkey").alias("from"), g("l_suppkey").alias("to"),
        F.when(F.col("l_linestatus") == "O", "credit_alphanum4").otherwise("native").alias("asset_type"),
        F.when(F.col("l_linestatus") == "O", "USD").alias("asset_code"),
        F.format_string("%.7f", "l_extendedprice").alias("amount"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )
    parsed = payloads.payments(_pages(base, "l_orderkey", record, schemas.PAYMENT_PAGE))
    return parsed.select(
        "id", "transaction_successful", "source_account", "dest_account", "asset_code",
        F.col("amount").cast("double").alias("amount"), F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


@query(
    "read_trades",
    """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, coalesce(NULL, 'XLM') AS base_asset, 'A' || l_suppkey AS counter_asset, l_quantity AS base_amount,
    round(l_extendedprice / l_quantity, 9) AS price FROM lineitem""",
)
def read_trades(spark, sf):
    record = F.struct(
        F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)").alias("id"),
        F.lit("native").alias("base_asset_type"),
        F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("counter_asset_code"),
        F.format_string("%.7f", "l_quantity").alias("base_amount"),
        F.struct(F.format_string("%.2f", "l_extendedprice").alias("n"), F.format_string("%.0f", "l_quantity").alias("d")).alias("price"),
    )
    parsed = payloads.trades(_pages(table(spark, sf, "lineitem"), "l_orderkey", record, schemas.TRADE_PAGE))
    return rounded(parsed, price=9).select("id", "base_asset", "counter_asset", F.col("base_amount").cast("double").alias("base_amount"), "price")


@query(
    "read_orderbook",
    """WITH l AS (SELECT 'S' || l_orderkey AS base_asset, CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side, l_extendedprice AS price, l_quantity AS amount, l_orderkey, l_linenumber, l_partkey FROM lineitem)
    SELECT base_asset, 'XLM' AS counter_asset, side, CAST(row_number() OVER (PARTITION BY base_asset, side ORDER BY price, amount, l_orderkey, l_linenumber, l_partkey) - 1 AS INTEGER) AS level, price, amount FROM l""",
)
def read_orderbook(spark, sf):
    entry = F.struct(
        F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"), "l_orderkey", "l_linenumber", "l_partkey",
    )

    def side(flag):
        kept = F.array_sort(F.collect_list(F.when(F.col("l_linestatus") == flag, entry)))
        return F.transform(
            kept, lambda e: F.struct(F.format_string("%.7f", e["p"]).alias("price"), F.format_string("%.7f", e["q"]).alias("amount"))
        )

    # one book per order: a handful of levels each
    books = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(side("O").alias("bids"), side("F").alias("asks"))
    text = books.select(
        F.to_json(F.struct("bids", "asks", F.struct(F.concat(F.lit("S"), F.col("l_orderkey").cast("string")).alias("asset_code")).alias("base"))).alias("value")
    )
    levels = payloads.orderbook(payloads.parse_pages(text, schemas.ORDERBOOK))
    return levels.select("base_asset", "counter_asset", "side", "level", F.col("price").cast("double").alias("price"), F.col("amount").cast("double").alias("amount"))


_SERIES = f"""WITH {EVENTS}, d AS (SELECT user_id, ts::DATE AS date, count(*) AS n, max(k) AS k FROM ev GROUP BY 1, 2)
    SELECT user_id, strftime(date, '%Y-%m-%d') AS date, CAST(n AS DOUBLE) AS volume FROM d WHERE k BETWEEN 10 AND 94"""


@query("normalize_series", _SERIES)
def normalize_series(spark, sf):
    k, day = F.col("k"), F.date_format("date", "yyyy-MM-dd")
    daily = events(spark, sf).groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.max("k").alias("k"))
    # fields vary by day: three names for the date, three for the value, gaps and text values
    point = F.struct(
        F.when((k < 40) & (k >= 10), day).alias("date"), F.when(k.between(40, 70), day).alias("day"), F.when(k > 70, day).alias("timestamp"),
        F.when(k < 50, F.col("n")).alias("volume"), F.when(k.between(50, 80), F.col("n")).alias("volume_usd"),
        F.when(k.between(81, 94), F.col("n")).alias("payment_volume"), F.when(k > 94, F.lit("many")).alias("volume_text"),
    )
    text = F.replace(F.to_json(F.collect_list(point)), F.lit("volume_text"), F.lit("volume"))
    user = F.col("user_id")
    payload = daily.groupBy("user_id").agg(text.alias("text"))
    payload = payload.select(
        "user_id",
        F.when(user < 40, F.col("text"))
        .when(user < 80, F.concat(F.lit('{"points":'), F.col("text"), F.lit("}")))
        .when(user < 120, F.concat(F.lit('{"series":'), F.col("text"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"data":'), F.col("text"), F.lit("}")))
        .alias("value"),
    )
    return payloads.normalize_series(payload, payloads.VALUE_NAMES["volume"], ["user_id"], out="volume")


def _series_family(family):
    names = payloads.VALUE_NAMES[family]

    @query(
        f"normalize_series_{family}",
        f"WITH {EVENTS} SELECT user_id, strftime(ts::DATE, '%Y-%m-%d') AS date, CAST(count(*) AS DOUBLE) AS number FROM ev GROUP BY user_id, ts::DATE",
    )
    def series(spark, sf):
        day, n = F.date_format("date", "yyyy-MM-dd"), F.col("n")
        daily = events(spark, sf).groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
        # the name of the value varies by day
        point = F.struct(day.alias("date"), *[F.when(F.pmod(n, F.lit(len(names))) == i, n).alias(name) for i, name in enumerate(names)])
        payload = daily.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(point).alias("series"))).alias("value"))
        return payloads.normalize_series(payload, names, ["user_id"])


for _family in ("active_accounts", "transactions", "new_accounts", "fees", "contract_calls"):
    _series_family(_family)


# ---- realtime messages ---------------------------------------------------------------------------

def message_text(spark, sf):
    """One JSON text per event; a few are damaged in the ways a feed can be."""
    k, kind, text = F.col("k"), F.col("event_type"), lambda c: F.col(c).cast("string")
    user = F.concat(F.lit("U"), text("user_id"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = {
        "signup": F.struct(F.lit("anchor_update").alias("type"), user.alias("anchor_id"), F.lit("n").alias("name"), F.col("value").alias("reliability_score"), F.lit("ok").alias("status")),
        "click": F.struct(F.lit("corridor_update").alias("type"), user.alias("corridor_id"), user.alias("corridor_key"), k.alias("success_rate"), F.col("value").alias("volume_usd"), k.alias("total_transactions")),
        "view": F.struct(F.lit("health_alert").alias("type"), user.alias("corridor_id"), F.when(k < 80, "warning").otherwise("fatal").alias("severity"), F.lit("m").alias("message"), stamp.alias("timestamp")),
        "purchase": F.struct(F.lit("new_payment").alias("type"), user.alias("corridor_id"), F.col("value").alias("amount"), (k < 50).alias("successful"), stamp.alias("timestamp")),
        "error": F.struct(F.lit("error").alias("type"), text("event_id").alias("message")),
    }
    encoded = F.coalesce(*[F.when(kind == name, F.to_json(b)) for name, b in body.items()])
    damaged = (
        F.when(k == 95, F.lit('"text"'))
        .when(k == 96, F.lit('{"value":1}'))
        .when(k == 97, F.lit('{"type":5}'))
        .when(k == 98, F.lit('{"type":"brand_new","value":1}'))
        .when((k == 94) & (kind == "click"), F.regexp_replace(encoded, '"success_rate":94', '"success_rate":"94"'))
        .when(k == 93, F.lit("{broken"))
    )
    return events(spark, sf).select(
        "event_id", F.col("ts").alias("received_at"), user.alias("connection"), F.coalesce(damaged, encoded).alias("value")
    )


_MSG = f"""WITH {EVENTS}, m AS (SELECT event_id, ts AS received_at, 'U' || user_id AS connection, value AS v, k,
    CASE WHEN k = 98 THEN 'brand_new' WHEN event_type = 'signup' THEN 'anchor_update' WHEN event_type = 'click' THEN 'corridor_update' WHEN event_type = 'view' THEN 'health_alert' WHEN event_type = 'purchase' THEN 'new_payment' ELSE 'error' END AS type,
    event_type FROM ev WHERE k NOT IN (93, 95, 96, 97)),
  msg AS (SELECT *, CASE WHEN k = 98 OR (event_type = 'view' AND k >= 80) OR (event_type = 'click' AND k = 94) THEN 'unknown' ELSE type END AS kind FROM m)"""


@query("parse_messages", f"""{_MSG} SELECT event_id, type, kind, CASE WHEN type IN ('corridor_update', 'health_alert', 'new_payment') THEN connection END AS corridor_id,
    CASE WHEN type = 'new_payment' THEN v END AS amount, CASE WHEN type = 'new_payment' THEN k < 50 END AS successful FROM msg""")
def parse_messages(spark, sf):
    return msg.parse_messages(message_text(spark, sf)).select("event_id", "type", "kind", "corridor_id", "amount", "successful")


@query("latest_corridor_state", f"{_MSG} SELECT connection AS corridor_key, max(event_id) AS event_id, arg_max(v, event_id) AS volume_usd FROM msg WHERE kind = 'corridor_update' GROUP BY 1")
def latest_corridor_state(spark, sf):
    state = msg.latest_state(msg.parse_messages(message_text(spark, sf)), "corridor_update", "corridor_key", ["received_at", "event_id"])
    return state.select("corridor_key", "event_id", "volume_usd")


@query("newest_alerts", f"{_MSG} SELECT event_id, connection AS corridor_id FROM msg WHERE kind = 'health_alert' ORDER BY received_at DESC, event_id DESC LIMIT 50")
def newest_alerts(spark, sf):
    alerts = msg.parse_messages(message_text(spark, sf)).where(F.col("kind") == "health_alert")
    return jobs.newest(alerts, jobs.ALERT_LIST).select("event_id", "corridor_id")


def subscriptions(spark, sf):
    """(subscriber, channel): customers follow the corridor, or the payments and the anchor, of their own number."""
    first = F.col("c_mktsegment") < "F"
    names = F.when(first, F.array(F.lit("corridor:"))).otherwise(F.array(F.lit("payments:"), F.lit("anchor:")))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("subscriber"), F.explode(names).alias("prefix")).select(
        "subscriber", F.concat("prefix", F.lit("U"), F.col("subscriber").cast("string")).alias("channel")
    )


@query(
    "subscribed_messages",
    f"""{_MSG} SELECT c_custkey AS subscriber, event_id, CASE kind WHEN 'corridor_update' THEN 'corridor:' WHEN 'new_payment' THEN 'payments:' ELSE 'anchor:' END || connection AS channel
    FROM msg JOIN customer ON 'U' || c_custkey = connection AND CASE WHEN c_mktsegment < 'F' THEN kind = 'corridor_update' ELSE kind IN ('new_payment', 'anchor_update') END""",
)
def subscribed_messages(spark, sf):
    delivered = msg.subscribed(msg.parse_messages(message_text(spark, sf)), subscriptions(spark, sf))
    return delivered.select("subscriber", "event_id", "channel")


@query(
    "stale_gaps",
    """WITH p AS (SELECT 'U' || user_id AS connection, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS silent_from, ts AS silent_to FROM events)
    SELECT connection, silent_from, silent_to, (epoch_us(silent_to) - epoch_us(silent_from)) / 1e6 AS gap_seconds FROM p WHERE epoch_us(silent_to) - epoch_us(silent_from) > 30000000""",
)
def stale_gaps(spark, sf):
    feed = table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("received_at"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("connection")
    )
    return msg.stale_gaps(feed, "connection")


_CATCH = """c AS (SELECT 'corridor' AS type, c_name AS id, TIMESTAMP '2024-01-01' + INTERVAL (c_nationkey) DAY AS updated_at, c_mktsegment AS payload FROM customer
  UNION ALL SELECT 'anchor', s_name, TIMESTAMP '2024-01-01' + INTERVAL (s_nationkey) DAY, s_suppkey::VARCHAR FROM supplier), u AS (SELECT * FROM c WHERE updated_at > TIMESTAMP '2024-01-10')"""


def _catch_up(spark, sf):
    def stamped(df, name, nation, payload):
        start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
        return df.select(F.col(name).alias("id"), F.timestamp_add("DAY", F.col(nation), start).alias("updated_at"), payload.alias("payload"))

    corridors = stamped(table(spark, sf, "customer"), "c_name", "c_nationkey", F.col("c_mktsegment"))
    anchors = stamped(table(spark, sf, "supplier"), "s_name", "s_nationkey", F.col("s_suppkey").cast("string"))
    return msg.catch_up(corridors, anchors, datetime(2024, 1, 10), ["corridor", "anchor"])


@query("catch_up", f"WITH {_CATCH} SELECT * FROM u")
def catch_up(spark, sf):
    return _catch_up(spark, sf)


@query("catch_up_summary", f"WITH {_CATCH} SELECT type, count(*) AS updates, max(updated_at) AS last_update FROM u GROUP BY 1")
def catch_up_summary(spark, sf):
    return msg.catch_up_summary(_catch_up(spark, sf))


_ROLLUP = f"WITH {PAYMENTS} SELECT date_trunc('day', ts) AS window_start, corridor, count(*) AS payments, count(*) FILTER (NOT successful) AS failures, {dsum('amount_usd')} AS volume_usd FROM payments GROUP BY 1, 2"


@query("payment_rollup", _ROLLUP)
def payment_rollup(spark, sf):
    return rounded(msg.payment_rollup(payments(spark, sf, "ts", "corridor", "successful", "amount_usd")), volume_usd=4)


# ---- streams: the same operators fed by a file stream that runs until the input is used up --------


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    # a file source wants a folder or a pattern
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")


@query(
    "stream_event_rollup",
    "SELECT date_trunc('day', ts) AS window_start, event_type AS corridor, count(*) AS payments, count(*) FILTER (event_type = 'error') AS failures, round(CAST(sum(CAST(value AS DECIMAL(38,12))) AS DOUBLE), 4) AS volume_usd FROM events GROUP BY 1, 2",
)
def stream_event_rollup(spark, sf):
    rows = event_stream(spark, sf).select(
        "ts", F.col("event_type").alias("corridor"), (F.col("event_type") != "error").alias("successful"), F.col("value").alias("amount_usd")
    )
    path = jobs.stream_dir(spark, "rollup")
    jobs.run_to_files(msg.payment_rollup(rows), path).awaitTermination()
    out = jobs.latest_rows(spark, path, ["window_start", "corridor"])
    return rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), volume_usd=4)


@query("stream_latest_state", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 1")
def stream_latest_state(spark, sf):
    rows = event_stream(spark, sf).select("user_id", "event_id", "value", F.col("event_type").alias("kind"))
    path = jobs.stream_dir(spark, "latest")
    jobs.run_to_files(msg.latest_state(rows, "click", "user_id", ["event_id"]), path).awaitTermination()
    return jobs.latest_rows(spark, path, ["user_id"]).select("user_id", "event_id", "value")


@query("stream_bounded_lists", "SELECT event_id, ts AS received_at FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def stream_bounded_lists(spark, sf):
    kind = F.when(F.col("event_type") == "error", F.lit("health_alert")).otherwise(F.lit("new_payment"))
    rows = event_stream(spark, sf).select("event_id", F.col("ts").alias("received_at"), kind.alias("kind"))
    path = jobs.stream_dir(spark, "lists")
    run = jobs.run_bounded_lists(rows, path)
    run.awaitTermination()
    return jobs.bounded_list(spark, path, "health_alert", run.lastProgress["batchId"]).select("event_id", "received_at")


@query("read_logs", f"WITH {EVENTS} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, event_type AS level, 'user ' || user_id AS message, CAST(k AS INTEGER) AS http_status FROM ev")
def read_logs(spark, sf):
    rows = events(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("event_type").alias("level"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"), F.col("k").cast("int").alias("http_status"), "value",
    )
    path = jobs.stream_dir(spark, "log-files")
    columns = ["timestamp", "level", "message", "http_status"]
    sinks.export_json(rows, columns, path)
    return payloads.read_logs(spark, path).select(*columns)


@query("read_contract_events", f"""WITH {EVENTS} SELECT event_id AS seq, CASE WHEN event_type = 'error' AND k < 5 THEN 'system' ELSE 'contract' END AS type,
    CASE WHEN event_type = 'signup' AND k < 5 THEN NULL ELSE 'C' || user_id END AS contract_id, CASE WHEN k = 50 THEN 2 ELSE 1 END AS n_topics FROM ev""")
def read_contract_events(spark, sf):
    path = jobs.stream_dir(spark, "contract-events")
    contract_plans.envelopes(spark, sf).write.mode("overwrite").parquet(path)
    return payloads.read_contract_events(spark, path).select("seq", "type", "contract_id", F.size("topics").alias("n_topics"))


@query("stream_decode_events", f"{contract_plans._VERDICT} SELECT event_id AS seq, split_part(e, ':', 1) AS error_code, split_part(e, ':', 2) AS error_detail FROM v WHERE e IS NOT NULL")
def stream_decode_events(spark, sf):
    rows = contract_plans.envelopes_of(event_stream(spark, sf).selectExpr("event_id", "ts", "user_id", "event_type", "value", "cast(get_json_object(props, '$.k') as bigint) AS k"))
    path = jobs.stream_dir(spark, "decode")
    jobs.run_event_normalisation(rows, path).awaitTermination()
    return spark.read.parquet(f"{path}/quarantine").select("seq", "error_code", "error_detail")


@query(
    "session_windows",
    """WITH g AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events FROM s GROUP BY user_id, sid""",
)
def session_windows(spark, sf):
    return msg.session_windows(table(spark, sf, "events").select("user_id", "ts"), gap="6 hours")


# ---- exports -------------------------------------------------------------------------------------


@query(
    "export_columns",
    f"""WITH {PAYMENTS} SELECT corridor AS "Corridor", strftime(date, '%Y-%m-%d %H:%M:%S') AS "Date", printf('%.2f', round(r * 100, 2)) || '%' AS "Success", coalesce(reason, '') AS "Reason"
    FROM (SELECT corridor, date_trunc('month', ts) AS date, count(*) FILTER (successful)::DOUBLE / count(*) AS r, max(failure_reason) AS reason FROM payments GROUP BY 1, 2)""",
)
def export_columns(spark, sf):
    rows = payments(spark, sf, "corridor", "ts", "successful", "failure_reason").groupBy(
        "corridor", F.date_trunc("month", "ts").alias("date")
    ).agg((F.count_if("successful") / F.count("*")).alias("success_rate"), F.max("failure_reason").alias("reason"))
    return sinks.export_columns(rows, {"corridor": "Corridor", "date": "Date", "success_rate": "Success", "reason": "Reason"})


@query("routed_error_logs", f"WITH {operations.RAW_LOGS} SELECT event_id, event_time::DATE AS log_date FROM logs WHERE tags LIKE 'error%'")
def routed_error_logs(spark, sf):
    path = jobs.stream_dir(spark, "logs")
    sinks.route_logs(operations.shaped_logs(spark, sf), path)
    return spark.read.parquet(f"{path}/errors").select("event_id", "log_date")


@query("network_store", f"WITH {PAYMENTS} SELECT corridor, count(*) AS n FROM payments WHERE network = 'testnet' GROUP BY 1")
def network_store(spark, sf):
    path = jobs.stream_dir(spark, "networks")
    sinks.append_metrics(payments(spark, sf, "corridor", "network"), path)
    stored = spark.read.parquet(path).where(F.col("network") == "testnet")
    return stored.groupBy("corridor").agg(F.count("*").alias("n"))


@query("corridor_api_rows", f"WITH {PAYMENTS}, {corridor_plans.METRICS} SELECT corridor, to_json({{'id': corridor, 'attempts': total_attempts}})::VARCHAR AS body FROM m")
def corridor_api_rows(spark, sf):
    body = F.to_json(F.struct(F.col("corridor").alias("id"), F.col("total_attempts").alias("attempts")))
    return corridor_plans.metrics(spark, sf).select("corridor", body.alias("body"))


@query(
    "diff_maps",
    """WITH c AS (SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'P') AS b, count(*) FILTER (o_orderstatus = 'O') AS c FROM orders GROUP BY 1)
    SELECT id, a AS old_value, b AS new_value FROM c WHERE a <> b""",
)
def diff_maps(spark, sf):
    status = F.col("o_orderstatus")
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count_if(status == "F").alias("a"), F.count_if(status == "P").alias("b"), F.count_if(status == "O").alias("c")
    )
    changed = ev.diff_maps(F.create_map(F.lit("x"), "a", F.lit("same"), "c"), F.create_map(F.lit("x"), "b", F.lit("same"), "c"))
    return counts.select("id", F.explode(changed).alias("metric", "v")).select(
        "id", F.col("v.old").alias("old_value"), F.col("v.new").alias("new_value")
    )


_DECODED = "seq bigint, contract_id string, epoch string, snapshot_hash string, source_data_hash string, submitted_at bigint, submitter string"


def _committed(spark, sf):
    """Decoded events in two batches; the second fails once between its sinks before it goes through."""
    path = jobs.stream_dir(spark, "committed")
    rows = events(spark, sf)
    for batch_id in (0, 1):
        decoded = ev.decode_snapshot_events(contract_plans.envelopes_of(rows.where(F.col("event_id") % 2 == batch_id)))

        def good(sink):
            return lambda df: sink(df.withColumns({"epoch": F.col("epoch").cast("string"), "submitted_at": F.col("submitted_at").cast("bigint")}))

        if batch_id == 1:
            try:
                with commits.batch(spark, path, batch_id) as b:
                    good(b.part("events"))(ev.normalized(decoded))
                    raise OSError("the quarantine is out of reach")
            except OSError:
                pass
        with commits.batch(spark, path, batch_id) as b:
            sinks.write_normalized_events(decoded, good(b.part("events")), b.part("quarantine"))
    return path


@query("committed_events", ORACLES["decode_events_normalized"])
def committed_events(spark, sf):
    return commits.read(spark, _committed(spark, sf), "events", _DECODED)


@query("committed_quarantine", ORACLES["decode_events_rejected"])
def committed_quarantine(spark, sf):
    return commits.read(spark, _committed(spark, sf), "quarantine", "seq bigint, error_code string, error_detail string")


@query("erase_users_in_files", ORACLES["erase_users"])
def erase_users_in_files(spark, sf):
    path, schema = jobs.stream_dir(spark, "erase"), "event_id bigint, user_id bigint"
    with commits.batch(spark, path, 0) as b:
        b.part("events")(events(spark, sf).select(F.col("event_id").cast("bigint"), F.col("user_id").cast("bigint")))
    confirmed = operations.data_requests(spark, sf).where("kind = 'deletion' and status = 'confirmed'")
    commits.erase_users(spark, path, "events", schema, confirmed)
    return commits.read(spark, path, "events", schema)
