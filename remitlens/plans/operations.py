"""Logs, alerts, notifications and routing over the supplied tables."""

from datetime import datetime

from pyspark.sql import functions as F

from remitlens.functions import numbers, redaction, times
from remitlens.operators import alerts as al
from remitlens.operators import logs as lg
from remitlens.operators import notifications as nt
from remitlens.operators import paging, routing
from remitlens.operators.contract_events import once
from remitlens.plans import corridors as corridor_plans
from remitlens.plans import parties
from remitlens.plans.common import AS_OF, AS_OF_SQL, EVENTS_AS_OF, EVENTS_AS_OF_SQL
from remitlens.plans.registry import query, rounded
from remitlens.plans.views import EVENTS, PAYMENTS, davg, dsum
from remitlens.sources.tables import events, payments, table

# ---- logs ----------------------------------------------------------------------------------------

RAW_LOGS = f"""{EVENTS}, raw AS (SELECT event_id, ts, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
    CASE WHEN event_type = 'error' AND k < 50 THEN 'ERROR' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'WARN' WHEN event_type = 'view' AND k > 90 THEN 'warn' ELSE 'info' END AS level,
    CASE WHEN event_type <> 'error' THEN event_type || ' ok' WHEN k < 30 THEN 'Database timeout' WHEN k < 60 THEN 'rpc failed' WHEN k < 80 THEN 'database locked' ELSE 'unexpected' END AS message,
    CASE WHEN k >= 50 THEN 'req-' || event_id END AS request_id,
    CASE event_type WHEN 'click' THEN 'GET' WHEN 'error' THEN 'GET' WHEN 'purchase' THEN 'POST' END AS http_method,
    CASE WHEN event_type IN ('click', 'error', 'purchase') THEN '/api/' || event_type || '/' || k // 25 END AS http_path,
    CASE WHEN event_type = 'error' AND k < 50 THEN 500 WHEN event_type = 'error' THEN 404 WHEN event_type = 'purchase' THEN 201 WHEN event_type = 'click' THEN 200 END AS http_status,
    CAST(floor(value * 10) AS BIGINT) AS response_time_ms,
    CASE WHEN event_type = 'view' OR (event_type = 'error' AND k >= 30 AND k < 90) THEN 'getLedger' END AS rpc_method,
    CASE WHEN event_type = 'signup' OR (event_type = 'error' AND k < 30) THEN 'SELECT 1' END AS query,
    CASE WHEN event_type = 'error' THEN 'E' || k END AS error_text FROM ev),
  logs AS (SELECT event_id, date_trunc('second', ts) AS event_time, level AS log_level, message, request_id AS trace_id, http_method, http_path, http_status, response_time_ms, rpc_method, query,
    concat_ws(',', CASE WHEN level IN ('ERROR', 'error') THEN 'error' END, CASE WHEN level IN ('WARN', 'warn') THEN 'warning' END, CASE WHEN http_method IS NOT NULL THEN 'http_request' END,
      CASE WHEN rpc_method IS NOT NULL THEN 'rpc_call' END, CASE WHEN query IS NOT NULL THEN 'database' END) AS tags,
    CASE WHEN level IN ('ERROR', 'error') THEN error_text END AS error_message, CASE WHEN http_method IS NOT NULL THEN response_time_ms / 1000.0 END AS response_time_seconds FROM raw)"""
_L = f"WITH {RAW_LOGS}"


def raw_logs(spark, sf, rows=None):
    """Raw log documents of the events, or of ``rows`` of the same form."""
    k, kind = F.col("k"), F.col("event_type")
    error = kind == "error"
    http = kind.isin("click", "error", "purchase")
    secret = F.lit("hidden")
    return (events(spark, sf) if rows is None else rows).select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.when(error & (k < 50), "ERROR").when(error, "error").when(kind == "signup", "WARN").when((kind == "view") & (k > 90), "warn").otherwise("info").alias("level"),
        F.when(~error, F.concat(kind, F.lit(" ok"))).when(k < 30, "Database timeout").when(k < 60, "rpc failed").when(k < 80, "database locked").otherwise("unexpected").alias("message"),
        F.when(k >= 50, F.concat(F.lit("req-"), F.col("event_id").cast("string"))).alias("request_id"),
        F.when(kind.isin("click", "error"), "GET").when(kind == "purchase", "POST").alias("http_method"),
        F.when(http, F.concat(F.lit("/api/"), kind, F.lit("/"), F.floor(k / 25).cast("string"))).alias("http_path"),
        F.when(error & (k < 50), 500).when(error, 404).when(kind == "purchase", 201).when(kind == "click", 200).alias("http_status"),
        F.floor(F.col("value") * 10).alias("response_time_ms"),
        F.when((kind == "view") | (error & (k >= 30) & (k < 90)), "getLedger").alias("rpc_method"),
        F.when((kind == "signup") | (error & (k < 30)), "SELECT 1").alias("query"),
        F.when(error, F.struct(F.concat(F.lit("E"), k.cast("string")).alias("message"))).alias("error"),
        *[secret.alias(name) for name in redaction.SENSITIVE_FIELDS],
    )


def shaped_logs(spark, sf):
    return lg.shape_logs(raw_logs(spark, sf)).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


@query(
    "shape_logs",
    f"{_L} SELECT event_id, event_time, log_level, trace_id, tags, error_message, response_time_seconds::DOUBLE AS response_time_seconds FROM logs",
)
def shape_logs(spark, sf):
    shaped = shaped_logs(spark, sf).withColumn("tags", F.array_join("tags", ","))
    leaked = [c for c in redaction.SENSITIVE_FIELDS if c in shaped.columns]
    if leaked:
        raise AssertionError(f"sensitive fields left: {leaked}")
    return shaped.select("event_id", "event_time", "log_level", "trace_id", "tags", "error_message", "response_time_seconds")


@query(
    "retention",
    f"""{_L}, d AS (SELECT event_id, date_diff('day', event_time::DATE, DATE '2024-02-10') AS age FROM logs)
    SELECT event_id, CASE WHEN age >= 14 THEN 'cold' WHEN age >= 7 THEN 'warm' ELSE 'hot' END AS tier FROM d WHERE age < 30""",
)
def retention(spark, sf):
    dated = shaped_logs(spark, sf).withColumn("log_date", F.to_date("event_time"))
    return lg.retention(dated, datetime(2024, 2, 10, 8)).select("event_id", "tier")


_HTTP = "logs WHERE http_method IS NOT NULL"


def http_logs(spark, sf):
    return shaped_logs(spark, sf).where(F.col("http_method").isNotNull())


@query(
    "api_usage",
    f"""{_L}, u AS (SELECT count(*) AS total_requests, {davg('response_time_ms')} AS average_response_ms, round(100.0 * count(*) FILTER (http_status >= 400) / count(*), 6) AS error_rate FROM {_HTTP})
    SELECT *, CASE WHEN error_rate < 5 THEN 'HEALTHY' ELSE 'DEGRADED' END AS health FROM u""",
)
def api_usage(spark, sf):
    return rounded(lg.api_usage(http_logs(spark, sf)), average_response_ms=6, error_rate=6)


@query("top_endpoints", f"{_L} SELECT http_path AS endpoint, http_method AS method, count(*) AS count, {davg('response_time_ms')} AS average_ms FROM {_HTTP} GROUP BY 1, 2 ORDER BY count DESC, endpoint, method LIMIT 10")
def top_endpoints(spark, sf):
    return rounded(lg.top_endpoints(http_logs(spark, sf)), average_ms=6)


@query("status_distribution", f"{_L} SELECT http_status, count(*) AS count FROM {_HTTP} GROUP BY 1")
def status_distribution(spark, sf):
    return lg.status_distribution(http_logs(spark, sf))


@query("log_levels_over_time", f"{_L} SELECT date_trunc('hour', event_time) AS time, log_level, count(*) AS count FROM logs GROUP BY 1, 2")
def log_levels_over_time(spark, sf):
    return lg.log_levels_over_time(shaped_logs(spark, sf))


@query("top_error_messages", f"{_L} SELECT message, count(*) AS count FROM logs WHERE tags LIKE 'error%' GROUP BY 1 ORDER BY count DESC, message LIMIT 10")
def top_error_messages(spark, sf):
    return lg.top_error_messages(shaped_logs(spark, sf))


# ---- redaction -----------------------------------------------------------------------------------

def _redacted_sql(column: str, rules=(*redaction.TEXT_RULES, redaction.SSN_RULE)) -> str:
    for pattern, replacement in rules:
        column = f"regexp_replace({column}, '{pattern}', '{replacement.replace('$1', chr(92) + '1')}', 'g')"
    return column


@query("redact_documents", f"SELECT doc_id, {_redacted_sql('text')} AS text FROM documents")
def redact_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", redaction.redact_text(F.col("text"), mnemonics=False).alias("text"))


@query("redact_conversations", f"SELECT conv_id, turn, {_redacted_sql('text')} AS text FROM conversations")
def redact_conversations(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", redaction.redact_text(F.col("text"), mnemonics=False).alias("text"))


_ASCII = "regexp_replace(text, '[^ -~]', '', 'g')"
_ALL_RULES = (*redaction.MNEMONIC_RULES, *redaction.TEXT_RULES, redaction.SSN_RULE)


@query("redact_mnemonics", f"SELECT doc_id, {_redacted_sql(_ASCII, _ALL_RULES)} AS text FROM documents")
def redact_mnemonics(spark, sf):
    """All rules on the ASCII letters of each text, where the word boundaries of the two
    engines agree: a check of the rules against SQL. ``redact_all`` redacts whole texts."""
    plain = F.regexp_replace("text", "[^ -~]", "")
    return table(spark, sf, "documents").select("doc_id", redaction.redact_text(plain).alias("text"))


def redact_all(spark, sf):
    """All rules on the unchanged documents; tests hold it against brute force, as the engines' word boundaries differ."""
    return table(spark, sf, "documents").select("doc_id", redaction.redact_text(F.col("text")).alias("text"))


@query(
    "redact_nested",
    f"""WITH {EVENTS} SELECT event_id, '[REDACTED]' AS token, '[REDACTED]' AS inner_secret, CASE WHEN k < 50 THEN '****@[REDACTED]' ELSE event_type END AS note,
    k AS number, '[REDACTED]' AS listed_key, event_type AS listed_note FROM ev""",
)
def redact_nested(spark, sf):
    text = lambda c: F.col(c).cast("string")
    note = F.when(F.col("k") < 50, F.concat(text("user_id"), F.lit("@mail.example.org"))).otherwise(F.col("event_type"))
    tree = F.struct(
        F.struct(text("k").alias("clientSecret"), note.alias("note"), F.col("k").alias("number")).alias("inner"),
        F.struct(text("k").alias("x")).alias("authToken"),
        F.array(F.struct(text("value").alias("api_key"), F.col("event_type").alias("note"))).alias("items"),
    )
    masked = redaction.redact_columns(events(spark, sf).select("event_id", tree.alias("tree")))
    return masked.select(
        "event_id", F.col("tree.authToken").alias("token"), F.col("tree.inner.clientSecret").alias("inner_secret"), F.col("tree.inner.note").alias("note"),
        F.col("tree.inner.number").alias("number"), F.col("tree.items")[0]["api_key"].alias("listed_key"), F.col("tree.items")[0]["note"].alias("listed_note"),
    )


@query(
    "redact_keys",
    f"""WITH {EVENTS} SELECT event_id, 'user' || user_id AS user, '[REDACTED]' AS "apiKey", '[REDACTED]' AS "AUTH_header",
    CASE WHEN k < 50 THEN '****@[REDACTED]' ELSE event_type END AS contact FROM ev""",
)
def redact_keys(spark, sf):
    text = lambda c: F.col(c).cast("string")
    fields = F.create_map(
        F.lit("user"), F.concat(F.lit("user"), text("user_id")),
        F.lit("apiKey"), text("k"),
        F.lit("AUTH_header"), text("value"),
        F.lit("contact"), F.when(F.col("k") < 50, F.concat(text("user_id"), F.lit("@mail.example.org"))).otherwise(F.col("event_type")),
    )
    masked = once(events(spark, sf), m=redaction.redact_map(fields))
    return masked.select("event_id", *[F.col("m")[name].alias(name) for name in ("user", "apiKey", "AUTH_header", "contact")])


# ---- client side metrics -------------------------------------------------------------------------

_VITAL = f"""WITH {EVENTS}, v AS (SELECT event_id AS id, ts, CASE event_type WHEN 'signup' THEN 'lcp' WHEN 'click' THEN 'inp' WHEN 'view' THEN 'cls' WHEN 'purchase' THEN 'ttfb' ELSE 'api-latency' END AS name,
    CASE WHEN event_type = 'view' THEN value / 1000 ELSE value * 10 END AS value, CASE WHEN k < 90 THEN '/v/' || k // 30 END AS endpoint FROM ev)"""


def vitals(spark, sf):
    kind = F.col("event_type")
    name = F.when(kind == "signup", "lcp").when(kind == "click", "inp").when(kind == "view", "cls").when(kind == "purchase", "ttfb")
    return events(spark, sf).select(
        F.col("event_id").alias("id"),
        "ts",
        name.otherwise("api-latency").alias("name"),
        F.when(kind == "view", F.col("value") / 1000).otherwise(F.col("value") * 10).alias("value"),
        F.when(F.col("k") < 90, F.concat(F.lit("/v/"), F.floor(F.col("k") / 30).cast("string"))).alias("endpoint"),
    )


@query(
    "web_vitals",
    f"""{_VITAL}, l AS (SELECT name, arg_max(value, (ts, id)) AS value FROM v GROUP BY 1),
    c(name, good, poor) AS (VALUES ('lcp', 2500, 4000), ('fid', 100, 300), ('inp', 200, 500), ('cls', 0.1, 0.25), ('fcp', 1800, 3000), ('ttfb', 800, 1800))
    SELECT l.name, value, CASE WHEN good IS NULL OR value <= good THEN 'good' WHEN value <= poor THEN 'needs-improvement' ELSE 'poor' END AS rating FROM l LEFT JOIN c USING (name)""",
)
def web_vitals(spark, sf):
    return lg.web_vitals(vitals(spark, sf))


@query("endpoint_latency", f"{_VITAL} SELECT endpoint, CAST(floor(sum(CAST(value AS DECIMAL(38,12)))::DOUBLE / count(*) + 0.5) AS BIGINT) AS latency FROM v WHERE name = 'api-latency' AND endpoint <> '' GROUP BY 1")
def endpoint_latency(spark, sf):
    return lg.endpoint_latency(vitals(spark, sf))


@query("error_timeline", "SELECT date_trunc('hour', ts) AS time, count(*) AS count FROM events WHERE event_type = 'error' GROUP BY 1")
def error_timeline(spark, sf):
    return lg.error_timeline(table(spark, sf, "events").where(F.col("event_type") == "error"))


_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edge/120.0", "Mozilla/5.0 (Macintosh) Version/17 Safari/605",
    "Mozilla/5.0 (X11; Linux x86_64) Firefox/121.0", "Mozilla/5.0 (Linux; Android 14) Chrome/120 Mobile", "curl/8.0", "Mozilla/5.0 (iPad; iOS 17) Safari/604",
]


@query(
    "client_breakdown",
    f"""WITH {EVENTS}, u AS (SELECT {_AGENTS!r}[k // 17 + 1] AS ua FROM ev WHERE event_type = 'error'),
    p AS (SELECT CASE WHEN ua LIKE '%Firefox%' THEN 'Firefox' WHEN ua LIKE '%Chrome%' THEN 'Chrome' WHEN ua LIKE '%Safari%' THEN 'Safari' WHEN ua LIKE '%Edge%' THEN 'Edge' ELSE 'Unknown' END AS browser,
      CASE WHEN ua LIKE '%Windows%' THEN 'Windows' WHEN ua LIKE '%Mac%' THEN 'macOS' WHEN ua LIKE '%Linux%' THEN 'Linux' WHEN ua LIKE '%Android%' THEN 'Android' WHEN ua LIKE '%iOS%' THEN 'iOS' ELSE 'Unknown' END AS os,
      CASE WHEN regexp_matches(ua, '(?i)Mobi|Android') THEN 'Mobile' WHEN regexp_matches(ua, '(?i)Tablet|iPad') THEN 'Tablet' ELSE 'Desktop' END AS device FROM u),
    l AS (SELECT 'browser' AS dimension, browser AS value FROM p UNION ALL SELECT 'os', os FROM p UNION ALL SELECT 'device', device FROM p)
    SELECT dimension, value, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY dimension), 6) AS share_pct FROM l GROUP BY 1, 2""",
)
def client_breakdown(spark, sf):
    agents = F.array(*[F.lit(a) for a in _AGENTS])
    errors = events(spark, sf).where(F.col("event_type") == "error").select(
        F.get(agents, F.floor(F.col("k") / 17).cast("int")).alias("user_agent")
    )
    return rounded(lg.client_breakdown(errors), share_pct=6)


@query(
    "session_stats",
    """WITH g AS (SELECT user_id, ts, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
    s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g),
    d AS (SELECT user_id, sid, count(*) AS n, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS secs FROM s GROUP BY 1, 2)
    SELECT count(*) AS total_sessions, round(sum(secs) / count(*), 4) AS mean_duration_seconds, round(100.0 * count(*) FILTER (n = 1) / count(*), 6) AS bounce_rate FROM d""",
)
def session_stats(spark, sf):
    stats = lg.session_stats(table(spark, sf, "events"), gap_seconds=6 * 3600)
    return rounded(stats, mean_duration_seconds=4, bounce_rate=6)


_GDPR = f"""WITH {EVENTS}, r AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 'export' WHEN event_type = 'view' THEN 'deletion' END AS kind,
    CASE WHEN k < 50 THEN 'pending' WHEN k >= 97 THEN 'confirmed' ELSE 'done' END AS status FROM ev WHERE event_type IN ('click', 'view'))"""


def data_requests(spark, sf):
    kind, k = F.col("event_type"), F.col("k")
    return events(spark, sf).where(kind.isin("click", "view")).select(
        "user_id",
        F.when(kind == "click", "export").otherwise("deletion").alias("kind"),
        F.when(k < 50, "pending").when(k >= 97, "confirmed").otherwise("done").alias("status"),
    )


@query(
    "gdpr_summary",
    f"""{_GDPR}, a AS (SELECT user_id, count(*) FILTER (event_type = 'signup' AND k >= 20) AS consents, count(*) AS activity_count FROM ev GROUP BY 1),
    q AS (SELECT user_id, count(*) FILTER (kind = 'export' AND status = 'pending') AS pending_exports, count(*) FILTER (kind = 'deletion' AND status = 'pending') AS pending_deletions FROM r GROUP BY 1)
    SELECT user_id, consents, coalesce(pending_exports, 0) AS pending_exports, coalesce(pending_deletions, 0) AS pending_deletions, activity_count FROM a LEFT JOIN q USING (user_id)""",
)
def gdpr_summary(spark, sf):
    ev = events(spark, sf)
    consents = ev.where(F.col("event_type") == "signup").select("user_id", (F.col("k") >= 20).alias("granted"))
    return lg.gdpr_summary(consents, data_requests(spark, sf), ev)


@query("erase_users", f"{_GDPR} SELECT event_id, user_id FROM ev WHERE user_id NOT IN (SELECT user_id FROM r WHERE kind = 'deletion' AND status = 'confirmed')")
def erase_users(spark, sf):
    return lg.erase_users(events(spark, sf).select("event_id", "user_id"), data_requests(spark, sf))


# ---- alerts --------------------------------------------------------------------------------------

_RULE_SQL = {
    "high_error_rate": ("log_level = 'error'", 10),
    "slow_responses": ("response_time_ms >= 2000", 5),
    "rpc_failures": ("log_level = 'error' AND rpc_method IS NOT NULL", 3),
    "database_errors": ("log_level = 'error' AND lower(message) LIKE '%database%'", 1),
}


LOG_ALERTS_SQL = (
    f"""{_L}, w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, event_time, TIMESTAMP '1970-01-01') AS s FROM logs) """
    + " UNION ALL ".join(
        f"SELECT '{n}' AS rule, s AS window_start, s + INTERVAL 6 HOUR AS window_end, count(*) AS count FROM w WHERE {t} GROUP BY s HAVING count(*) > {c}"
        for n, (t, c) in _RULE_SQL.items()
    )
)


@query("log_alerts", LOG_ALERTS_SQL)
def log_alerts(spark, sf):
    return al.log_alerts(shaped_logs(spark, sf), window="6 hours")


_RATIO = f"""b AS (SELECT time_bucket(INTERVAL 1 HOUR, event_time, TIMESTAMP '1970-01-01') AS b, count(*) AS n, count(*) FILTER (http_status BETWEEN 500 AND 599) AS bad FROM {_HTTP} GROUP BY 1),
  x AS (SELECT b + INTERVAL (i) HOUR AS e, n, bad FROM b, range(1, 7) t(i)),
  r AS (SELECT e AS evaluated_at, CAST(sum(bad) AS DOUBLE) / sum(n) AS ratio FROM x GROUP BY 1)"""


def _ratio(spark, sf):
    return al.error_ratio(http_logs(spark, sf), window="6 hours", slide="1 hour", limit=0.2)


ERROR_RATIO_SQL = f"{_L}, {_RATIO} SELECT evaluated_at, round(ratio, 9) AS ratio, ratio > 0.2 AS firing FROM r"


@query("error_ratio", ERROR_RATIO_SQL)
def error_ratio(spark, sf):
    return rounded(_ratio(spark, sf), ratio=9)


ALERT_HOLD_SQL = (
    f"""{_L}, {_RATIO}, f AS (SELECT evaluated_at, ratio > 0.2 AS firing, max(CASE WHEN NOT ratio > 0.2 THEN evaluated_at END) OVER (ORDER BY evaluated_at) AS lf FROM r),
    s AS (SELECT *, min(evaluated_at) OVER (PARTITION BY lf) AS since FROM f WHERE firing)
    SELECT evaluated_at, since FROM s WHERE evaluated_at - since >= INTERVAL 3 HOUR"""
)


@query("alert_hold", ALERT_HOLD_SQL)
def alert_hold(spark, sf):
    evaluations = _ratio(spark, sf).withColumn("series", F.lit("5xx"))
    return al.hold(evaluations, ["series"], seconds=3 * 3600).select("evaluated_at", "since")


_EDGES = [0.1, 0.25, 0.5, 1.0, 2.0]


@query(
    "histogram_quantile",
    f"""{_L}, s AS (SELECT event_time::DATE AS date, response_time_ms / 1000.0 AS x FROM {_HTTP}),
    e(i, lo, hi) AS (VALUES (1, 0.0, 0.1), (2, 0.1, 0.25), (3, 0.25, 0.5), (4, 0.5, 1.0), (5, 1.0, 2.0)),
    c AS (SELECT date, i, lo, hi, count(*) FILTER (x <= hi) AS c, count(*) FILTER (x <= lo AND i > 1) AS p, count(*) AS n FROM s, e GROUP BY ALL),
    f AS (SELECT *, 0.9 * n AS r, row_number() OVER (PARTITION BY date ORDER BY i) AS rn FROM c WHERE c >= 0.9 * n)
    SELECT d.date, round(coalesce(lo + (hi - lo) * (r - p) / nullif(c - p, 0), 2.0)::DOUBLE, 9) AS quantile FROM (SELECT DISTINCT date FROM s) d LEFT JOIN f ON f.date = d.date AND rn = 1""",
)
def histogram_quantile(spark, sf):
    rows = http_logs(spark, sf).select(F.to_date("event_time").alias("date"), (F.col("response_time_ms") / 1000.0).alias("seconds"))
    return rounded(al.histogram_quantile(rows, ["date"], "seconds", _EDGES, 0.9), quantile=9)


@query(
    "latency_alert",
    f"{_L}, s AS (SELECT http_path AS endpoint, quantile_cont(response_time_ms / 1000.0::DOUBLE, 0.99) AS p FROM {_HTTP} GROUP BY 1) SELECT endpoint, round(p, 6) AS p99 FROM s WHERE p > 1.0",
)
def latency_alert(spark, sf):
    rows = http_logs(spark, sf).select(F.col("http_path").alias("endpoint"), (F.col("response_time_ms") / 1000.0).alias("seconds"))
    return rounded(al.latency_alert(rows, ["endpoint"], "seconds"), p99=6)


@query(
    "counter_rate",
    f"""WITH {EVENTS}, p AS (SELECT user_id, ts, k, lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM ev)
    SELECT user_id, date_trunc('day', ts) AS window_start, round(CAST(sum(CASE WHEN k < q THEN k ELSE k - q END) AS DOUBLE) / 86400, 9) AS rate FROM p WHERE q IS NOT NULL GROUP BY 1, 2""",
)
def counter_rate(spark, sf):
    samples = events(spark, sf).select("user_id", "ts", "event_id", F.col("k").alias("value"))
    return rounded(al.counter_rate(samples, ["user_id"], ["ts", "event_id"], "1 day", 86400.0), rate=9)


@query("gauge_ratio_alert", "SELECT c_custkey, round(c_acctbal / 10000, 9) AS ratio FROM customer WHERE c_acctbal / 10000 > 0.8")
def gauge_ratio_alert(spark, sf):
    gauges = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("used"), F.lit(10000.0).alias("capacity"))
    return rounded(al.gauge_ratio_alert(gauges, "used", "capacity", al.POOL_RATIO), ratio=9).select("c_custkey", "ratio")


@query(
    "ingestion_lag",
    f"WITH {PAYMENTS}, l AS (SELECT network, max(ts) AS last_ts FROM payments GROUP BY 1) SELECT *, date_diff('second', last_ts, TIMESTAMP '2001-11-03 00:04:00') AS lag_seconds, date_diff('second', last_ts, TIMESTAMP '2001-11-03 00:04:00') > 300 AS firing FROM l",
)
def ingestion_lag(spark, sf):
    return al.ingestion_lag(payments(spark, sf, "network", "ts"), datetime(2001, 11, 3, 0, 4))


@query(
    "request_panels",
    f"""{_L} SELECT date_trunc('day', event_time) AS window_start, http_path AS endpoint, http_method AS method, round(count(*) / 86400.0::DOUBLE, 9) AS rate,
    round(sum(response_time_ms)::DOUBLE / greatest(count(response_time_ms), 0.0001), 6) AS mean_latency_ms FROM {_HTTP} GROUP BY 1, 2, 3""",
)
def request_panels(spark, sf):
    return rounded(al.request_panels(shaped_logs(spark, sf), window="1 day", seconds=86400.0), rate=9, mean_latency_ms=6)


@query("cache_hit_ratio", f"WITH {EVENTS} SELECT date_trunc('day', ts) AS window_start, round((count(*) FILTER (k >= 30) / 86400.0::DOUBLE) / greatest(count(*) / 86400.0::DOUBLE, 0.0001), 9) AS hit_ratio FROM ev GROUP BY 1")
def cache_hit_ratio(spark, sf):
    return rounded(al.hit_ratio(events(spark, sf), "ts", "1 day", 86400.0, F.col("k") >= 30), hit_ratio=9)


@query("errors_by_type", f"{_L} SELECT date_trunc('day', event_time) AS window_start, message AS error_type, round(count(*) / 86400.0::DOUBLE, 9) AS rate FROM logs WHERE tags LIKE 'error%' GROUP BY 1, 2")
def errors_by_type(spark, sf):
    errors = shaped_logs(spark, sf).where(F.array_contains("tags", "error")).withColumnRenamed("message", "error_type")
    return rounded(al.rate_by(errors, ["error_type"], "event_time", "1 day", 86400.0), rate=9)


_RULES_ROWS = [
    (1, None, "success_rate", "below", 65.0, True, None),
    (2, "NATION_1->NATION_2", "latency", "above", 100000.0, True, None),
    (3, None, "liquidity", "above", 3000000.0, True, datetime(1999, 1, 1)),
    (4, None, "volume", "above", 0.0, True, datetime(2000, 6, 1)),
    (5, None, "latency", "above", 1.0, False, None),
    (6, None, "volume", "equals", 0.0, True, AS_OF),
]


def _sql_value(v):
    return "NULL" if v is None else f"TIMESTAMP '{v}'" if isinstance(v, datetime) else f"'{v}'" if isinstance(v, str) else str(v)


_RULES_SQL = ", ".join("(" + ", ".join(_sql_value(v) for v in row) + ")" for row in _RULES_ROWS)


@query(
    "apply_alert_rules",
    f"""WITH {PAYMENTS}, {corridor_plans.METRICS}, rules(rule_id, corridor_id, metric_type, condition, threshold, is_active, snoozed_until) AS (VALUES {_RULES_SQL}),
    v AS (SELECT corridor, 'success_rate' AS metric_type, success_rate AS value FROM m UNION ALL SELECT corridor, 'latency', average_latency_ms FROM m
      UNION ALL SELECT corridor, 'liquidity', liquidity_depth_usd FROM m UNION ALL SELECT corridor, 'volume', liquidity_volume_24h_usd FROM m)
    SELECT rule_id::BIGINT AS rule_id, corridor, metric_type, condition, value AS trigger_value, threshold::DOUBLE AS threshold_value, metric_type || ' of ' || corridor || ' is ' || condition || ' threshold' AS message
    FROM v JOIN rules USING (metric_type) WHERE is_active AND (snoozed_until IS NULL OR snoozed_until <= {AS_OF_SQL}) AND (corridor_id IS NULL OR corridor_id = corridor)
      AND CASE condition WHEN 'above' THEN value > threshold WHEN 'below' THEN value < threshold ELSE value = threshold END""",
)
def apply_alert_rules(spark, sf):
    rules = spark.createDataFrame(
        _RULES_ROWS,
        "rule_id bigint, corridor_id string, metric_type string, condition string, threshold double, is_active boolean, snoozed_until timestamp_ntz",
    )
    return al.apply_alert_rules(al.corridor_measures(corridor_plans.metrics(spark, sf)), rules, AS_OF)


# ---- notifications -------------------------------------------------------------------------------

NOTES = f"""{EVENTS}, notes AS (SELECT event_id AS id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS type,
    CASE WHEN k >= 75 THEN 'critical' WHEN k >= 50 THEN 'high' WHEN k >= 25 THEN 'medium' ELSE 'low' END AS priority,
    CASE event_type WHEN 'purchase' THEN 'payments' WHEN 'click' THEN 'liquidity' WHEN 'view' THEN 'liquidity' ELSE 'system' END AS category,
    value > 50 AS read, 'Note ' || event_type AS title, 'Value is ' || k AS message,
    CASE WHEN k >= 60 THEN 'payment-success' WHEN k >= 50 THEN '' END AS template_id, CASE WHEN k >= 20 THEN date_trunc('second', ts) + INTERVAL (k) MINUTE END AS read_at FROM ev)"""
_N = f"WITH {NOTES}"


def notes(spark, sf):
    k, kind = F.col("k"), F.col("event_type")
    read_at = F.timestamp_add("MINUTE", k.cast("int"), F.date_trunc("second", "ts").cast("timestamp_ntz"))
    metadata = F.map_filter(
        F.create_map(
            F.lit("templateId"), F.when(k >= 60, "payment-success").when(k >= 50, ""),
            F.lit("readAt"), F.when(k >= 20, read_at.cast("string")),
        ),
        lambda _, v: v.isNotNull(),
    )
    return events(spark, sf).select(
        F.col("event_id").alias("id"), "user_id", "ts",
        F.when(kind == "purchase", "success").when(kind == "error", "error").when(kind == "signup", "warning").otherwise("info").alias("type"),
        F.when(k >= 75, "critical").when(k >= 50, "high").when(k >= 25, "medium").otherwise("low").alias("priority"),
        F.when(kind == "purchase", "payments").when(kind.isin("click", "view"), "liquidity").otherwise("system").alias("category"),
        (F.col("value") > 50).alias("read"),
        F.concat(F.lit("Note "), kind).alias("title"),
        F.concat(F.lit("Value is "), k.cast("string")).alias("message"),
        metadata.alias("metadata"),
    )


@query(
    "filter_notifications",
    f"""{_N} SELECT id, type, priority FROM notes WHERE type IN ('error', 'info') AND priority IN ('high', 'critical') AND NOT read
    AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND (lower(title) LIKE '%is 7%' OR lower(message) LIKE '%is 7%')""",
)
def filter_notifications(spark, sf):
    return nt.filter_notifications(
        notes(spark, sf), types=["error", "info"], priorities=["high", "critical"], categories=[], read_status="unread",
        date_range=(datetime(2024, 1, 5), datetime(2024, 1, 20)), search="IS 7",
    ).select("id", "type", "priority")


@query(
    "notification_distribution",
    f"""{_N}, d(dimension, key) AS (VALUES ('type', 'success'), ('type', 'error'), ('type', 'warning'), ('type', 'info'), ('priority', 'low'), ('priority', 'medium'), ('priority', 'high'), ('priority', 'critical'))
    SELECT dimension, key, count(id) AS count FROM d LEFT JOIN notes ON CASE WHEN dimension = 'type' THEN type ELSE priority END = key GROUP BY 1, 2
    UNION ALL SELECT 'category', category, count(*) FROM notes GROUP BY 2""",
)
def notification_distribution(spark, sf):
    return nt.distribution(notes(spark, sf))


@query(
    "notification_totals",
    f"""{_N} SELECT count(*) AS total, count(*) FILTER (NOT read) AS unread, round(100.0 * count(*) FILTER (read) / count(*), 6) AS read_rate,
    round(avg(date_diff('second', date_trunc('second', ts), read_at) / 60.0) FILTER (read AND read_at IS NOT NULL), 2) AS average_response_minutes FROM notes""",
)
def notification_totals(spark, sf):
    whole = notes(spark, sf).withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return rounded(nt.totals(whole), read_rate=6, average_response_minutes=2)


@query(
    "notification_daily",
    f"""{_N}, d AS (SELECT unnest(generate_series(DATE '2023-12-22', DATE '2024-01-20', INTERVAL 1 DAY))::DATE AS date)
    SELECT d.date, count(id) AS count, count(*) FILTER (NOT read) AS unread FROM d LEFT JOIN notes ON ts::DATE = d.date GROUP BY 1""",
)
def notification_daily(spark, sf):
    return nt.daily_stats(notes(spark, sf), EVENTS_AS_OF)


@query("group_related", f"{_N} SELECT coalesce(nullif(template_id, ''), category || '-' || type) AS \"group\", count(*) AS count, count(*) FILTER (NOT read) AS unread, max(ts) AS latest FROM notes GROUP BY 1")
def group_related(spark, sf):
    return nt.group_related(notes(spark, sf))


@query(
    "group_by_age",
    f"""{_N} SELECT CASE WHEN ts::DATE = DATE '2024-01-20' THEN 'Today' WHEN ts::DATE = DATE '2024-01-19' THEN 'Yesterday' WHEN ts > {EVENTS_AS_OF_SQL} - INTERVAL 7 DAY THEN 'Last 7 Days'
    WHEN ts > {EVENTS_AS_OF_SQL} - INTERVAL 30 DAY THEN 'Last 30 Days' ELSE 'Older' END AS "group", count(*) AS count FROM notes GROUP BY 1""",
)
def group_by_age(spark, sf):
    return nt.group_by_age(notes(spark, sf), EVENTS_AS_OF)


@query("group_by_priority", f"{_N} SELECT upper(priority[1]) || priority[2:] AS \"group\", count(*) AS count FROM notes GROUP BY 1")
def group_by_priority(spark, sf):
    return nt.group_by_age(notes(spark, sf), EVENTS_AS_OF, by="priority")


@query(
    "notification_history_groups",
    f"""{_N} SELECT CASE WHEN ts::DATE = DATE '2024-01-20' THEN 'Today' WHEN ts::DATE = DATE '2024-01-19' THEN 'Yesterday' WHEN ts >= {EVENTS_AS_OF_SQL} - INTERVAL 7 DAY THEN 'This Week'
    ELSE strftime(ts, '%B %Y') END AS "group", count(*) AS count FROM notes GROUP BY 1""",
)
def notification_history_groups(spark, sf):
    return nt.group_by_age(notes(spark, sf), EVENTS_AS_OF, by="history")


@query("sort_notifications", f"{_N} SELECT id, priority, ts FROM notes ORDER BY CASE priority WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END DESC, ts DESC, id")
def sort_notifications(spark, sf):
    return paging.sort_notifications(notes(spark, sf), "priority").select("id", "priority", "ts")


@query("cap_newest", f"{_N} SELECT id, ts FROM notes ORDER BY ts DESC, id DESC LIMIT 100")
def cap_newest(spark, sf):
    return paging.cap_newest(notes(spark, sf)).select("id", "ts")


@query("cap_newest_per_user", f"{_N} SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rn FROM notes) WHERE rn <= 20")
def cap_newest_per_user(spark, sf):
    return paging.cap_newest(notes(spark, sf), 20, per="user_id").select("user_id", "id")


@query(
    "render_templates",
    f"""WITH {EVENTS}, e AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'payment-success' WHEN 'error' THEN 'payment-failed' WHEN 'view' THEN 'low-liquidity' WHEN 'click' THEN 'system-alert' END AS t, user_id, k FROM ev)
    SELECT event_id, t AS template_id, CASE t WHEN 'system-alert' THEN 'System Alert: {{{{alertType}}}}' WHEN 'payment-success' THEN 'Payment Completed Successfully' WHEN 'payment-failed' THEN 'Payment Failed' ELSE 'Low Liquidity Alert' END AS title,
      CASE t WHEN 'payment-success' THEN 'Payment of ' || k || ' XLM to {{{{amount}}}} was completed in {{{{duration}}}}s.' WHEN 'payment-failed' THEN 'Payment of ' || k || ' XLM to {{{{amount}}}} failed: ' || CASE WHEN k < 50 THEN 'timeout' ELSE '{{{{reason}}}}' END
      WHEN 'low-liquidity' THEN 'Liquidity pool P' || user_id || ' has fallen below ' || k || '% capacity.' ELSE '{{{{description}}}} - Action required: {{{{action}}}}' END AS message FROM e WHERE t IS NOT NULL""",
)
def render_templates(spark, sf):
    kind, k = F.col("event_type"), F.col("k").cast("string")
    template = (
        F.when(kind == "purchase", "payment-success").when(kind == "error", "payment-failed").when(kind == "view", "low-liquidity")
        .when(kind == "click", "system-alert").otherwise("no-such-template")
    )
    variables = F.create_map(
        F.lit("amount"), k, F.lit("recipient"), F.lit("{{amount}}"), F.lit("threshold"), k,
        F.lit("pool"), F.concat(F.lit("P"), F.col("user_id").cast("string")),
        F.lit("reason"), F.when(F.col("k") < 50, "timeout").otherwise(""),
    )
    rows = events(spark, sf).select("event_id", template.alias("template_id"), variables.alias("variables"))
    return nt.render_templates(rows, nt.template_table(spark)).select("event_id", "template_id", "title", "message")


@query(
    "mark_read_batch",
    f"{_N} SELECT id, read OR (priority = 'critical') AS read, CASE WHEN priority = 'critical' THEN '2024-01-20T12:00:00' ELSE read_at::VARCHAR END AS read_at FROM notes",
)
def mark_read_batch(spark, sf):
    all_notes = notes(spark, sf)
    marked = nt.mark_read(all_notes, all_notes.where(F.col("priority") == "critical"), EVENTS_AS_OF)
    return marked.select("id", "read", F.col("metadata")["readAt"].alias("read_at"))


@query("delete_batch", f"{_N} SELECT id, type FROM notes WHERE priority <> 'low'")
def delete_batch(spark, sf):
    all_notes = notes(spark, sf)
    return nt.delete_batch(all_notes, all_notes.where(F.col("priority") == "low")).select("id", "type")


# ---- prediction, conversion, routes --------------------------------------------------------------

_PRED = """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'USDC' WHEN '2' THEN 'USDC' WHEN '3' THEN 'XLM' WHEN '4' THEN 'EUR' ELSE 'BRL' END AS source_asset,
    CASE l_returnflag WHEN 'A' THEN 'XLM' WHEN 'N' THEN 'PHP' ELSE 'USDC' END AS dest_asset, l_extendedprice AS amount, l_linenumber * 3 AS hour FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  b(pair, base) AS (VALUES ('USDC-XLM', 0.95), ('USDC-EURC', 0.92), ('XLM-USDC', 0.94), ('USDC-PHP', 0.88), ('USDC-NGN', 0.82), ('EUR-USD', 0.91)),
  p AS (SELECT r.*, least(0.99::DOUBLE, coalesce(base, 0.8)::DOUBLE * greatest(0.85::DOUBLE, 1.0 - amount / 100000 * 0.1) * CASE WHEN hour BETWEEN 9 AND 17 THEN 1.02 ELSE 0.98 END::DOUBLE) AS p FROM r LEFT JOIN b ON pair = source_asset || '-' || dest_asset)"""


def payment_requests(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    first = F.substring("o_orderpriority", 1, 1)
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(first.isin("1", "2"), "USDC").when(first == "3", "XLM").when(first == "4", "EUR").otherwise("BRL").alias("source_asset"),
        F.when(flag == "A", "XLM").when(flag == "N", "PHP").otherwise("USDC").alias("dest_asset"),
        F.col("l_extendedprice").alias("amount"),
        (F.col("l_linenumber") * 3).alias("hour"),
    )


_ADVICE = [routing.RECOMMENDATIONS[level].replace("'", "''") for level in ("low", "medium", "high")]


@query(
    "predict_success",
    f"""{_PRED} SELECT l_orderkey, l_linenumber, l_partkey, round(p, 6) AS success_probability, round(greatest(0, p - ((1 - p) * 0.3 + 0.02)), 6) AS lower_bound,
    round(least(1, p + ((1 - p) * 0.3 + 0.02) / 2), 6) AS upper_bound, CASE WHEN p >= 0.85 THEN 'low' WHEN p >= 0.65 THEN 'medium' ELSE 'high' END AS risk_level,
    concat_ws(',', CASE WHEN least(0.99, p + 0.03) > p THEN 'XLM' END, CASE WHEN 0.96 > p THEN 'USDC' END) AS routes,
    CASE WHEN p >= 0.85 THEN '{_ADVICE[0]}' WHEN p >= 0.65 THEN '{_ADVICE[1]}' ELSE '{_ADVICE[2]}' END AS advice FROM p""",
)
def predict_success(spark, sf):
    scored = routing.predict_success(payment_requests(spark, sf))
    out = rounded(scored, success_probability=6, lower_bound=6, upper_bound=6)
    routes = F.array_join(F.transform("alternative_routes", lambda r: r["via_asset"]), ",")
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "success_probability", "lower_bound", "upper_bound", "risk_level",
        routes.alias("routes"), F.col("recommendation").alias("advice"),
    )


_PRICE = f"px AS (SELECT p_brand AS asset, {davg('p_retailprice')} AS price_usd FROM part GROUP BY 1)"


@query(
    "convert_amounts",
    f"""WITH {_PRICE}, a AS (SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS f, 'Brand#' || (l_linenumber * 5) AS t, l_extendedprice AS amount FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey, l_linenumber, l_partkey, f AS from_asset, t AS to_asset, amount, round(s.price_usd / d.price_usd, 9) AS rate, round(amount * (s.price_usd / d.price_usd), 4) AS converted_amount
    FROM a LEFT JOIN px s ON s.asset = f LEFT JOIN px d ON d.asset = t""",
)
def convert_amounts(spark, sf):
    part = table(spark, sf, "part")
    prices = part.groupBy(F.col("p_brand").alias("asset")).agg(F.round(numbers.exact_avg("p_retailprice"), 6).alias("price_usd"))
    amounts = table(spark, sf, "lineitem").join(part.select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("p_brand").alias("from_asset"),
        F.concat(F.lit("Brand#"), (F.col("l_linenumber") * 5).cast("string")).alias("to_asset"), F.col("l_extendedprice").alias("amount"),
    )
    return rounded(routing.convert(amounts, prices), rate=9, converted_amount=4)


_ROUTES = [
    (status, route, spread_bps + extra, service, slip, net)
    for status, extra in (("F", 0.0), ("O", 2.5), ("P", 7.0))
    for route, spread_bps, service, slip, net in (
        ("order_book", 20.0, 5.0, 10.0, 0.5), ("anchor_direct", 5.0, 30.0, 0.0, 12.0), ("liquidity_pool", 12.0, 8.0, 25.0, 0.5)
    )
]
_COSTS = f"""WITH rt(route_set, route, spread, service, slip, net) AS (VALUES {', '.join(str(r) for r in _ROUTES)}),
  q AS (SELECT o_orderkey AS request_id, o_totalprice AS a, 1.1::DOUBLE AS mid, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 1.098 END AS want, route, a * spread::DOUBLE / 10000 + a * service::DOUBLE / 10000 + net::DOUBLE + a * slip::DOUBLE / 10000 AS fees FROM orders JOIN rt ON route_set = o_orderstatus),
  c AS (SELECT *, (a - fees) * mid AS est FROM q)"""


def quote_requests(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderstatus").alias("route_set"), F.col("o_totalprice").alias("source_amount"),
        F.lit(1.1).alias("mid_market_rate"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 1.098).alias("destination_amount"),
    )


def route_list(spark):
    return spark.createDataFrame(
        _ROUTES, "route_set string, route string, spread_bps double, service_bps double, slippage_bps double, network_fee double"
    )


@query(
    "compare_routes",
    f"""{_COSTS} SELECT request_id, route, CAST(row_number() OVER (PARTITION BY request_id ORDER BY fees, route) AS INTEGER) AS rank, round(fees, 7) AS total_fees_source, round(est, 9) AS estimated_destination_amount,
    round(CASE WHEN want IS NOT NULL THEN greatest(0, want - est) END, 9) AS destination_shortfall FROM c""",
)
def compare_routes(spark, sf):
    out = rounded(
        routing.route_costs(quote_requests(spark, sf), route_list(spark)),
        total_fees_source=7, estimated_destination_amount=9, destination_shortfall=9,
    )
    return out.select("request_id", "route", "rank", "total_fees_source", "estimated_destination_amount", "destination_shortfall")


@query("best_routes", f"{_COSTS} SELECT request_id, arg_min(route, (fees, route)) AS route, round(min(fees), 7) AS total_fees_source FROM c GROUP BY 1")
def best_routes(spark, sf):
    best = routing.best_routes(quote_requests(spark, sf), route_list(spark))
    return rounded(best, total_fees_source=7).select("request_id", "route", "total_fees_source")


_WEEK = f"""WITH {PAYMENTS}, h AS (SELECT corridor, ts::DATE AS date, successful FROM payments WHERE date_diff('day', ts::DATE, DATE '2000-01-01') BETWEEN 0 AND 13),
  w AS (SELECT corridor, 100.0 * count(*) FILTER (successful AND date > DATE '1999-12-25') / nullif(count(*) FILTER (date > DATE '1999-12-25'), 0) AS n,
    100.0 * count(*) FILTER (successful AND date <= DATE '1999-12-25') / nullif(count(*) FILTER (date <= DATE '1999-12-25'), 0) AS b FROM h GROUP BY 1)"""


def _week(spark, sf):
    daily = payments(spark, sf, "corridor", "ts", "successful").groupBy("corridor", F.to_date("ts").alias("date")).agg(
        F.count("*").alias("attempts"), F.count_if("successful").alias("successes")
    )
    return routing.corridor_insights(daily, AS_OF)


@query(
    "corridor_insights",
    f"""{_WEEK} SELECT corridor, round(n, 6) AS rate, round(n - b, 6) AS change, n < 95 AS below_target, corridor || ' success rate ' || CASE WHEN n > b THEN 'improved ' WHEN n < b THEN 'dropped ' ELSE 'changed ' END
    || printf('%.1f', round(abs(n - b), 1)) || '% this week' AS sentence FROM w""",
)
def corridor_insights(spark, sf):
    return rounded(_week(spark, sf), rate=6, change=6)


@query("corridor_insight_summary", f"{_WEEK} SELECT count(*) FILTER (n < 95) || ' corridors dropped below 95% uptime' AS sentence FROM w")
def corridor_insight_summary(spark, sf):
    return routing.weak_corridor_sentence(_week(spark, sf))


# ---- text formats --------------------------------------------------------------------------------


@query(
    "format_values",
    f"""WITH {EVENTS} SELECT event_id, CASE WHEN value * 10000 >= 1000000 THEN printf('%.1f', round(value * 10000 / 1000000, 1)) || 'M' WHEN value * 10000 >= 1000 THEN printf('%.1f', round(value * 10000 / 1000, 1)) || 'K'
      ELSE regexp_replace(printf('%.6f', value * 10000), '\\.?0+$', '') END AS compact,
    CASE WHEN k = 0 THEN 'N/A' WHEN k * 37 < 1000 THEN (k * 37) || 'ms' ELSE printf('%.1f', round(k * 37 / 1000.0, 1)) || 's' END AS duration,
    CASE WHEN s < 3600 THEN 'Less than 1h ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS relative,
    CASE WHEN s >= 86400 THEN s // 86400 || 'd ' || (s % 86400) // 3600 || 'h left' WHEN s >= 3600 THEN s // 3600 || 'h ' || (s % 3600) // 60 || 'm left' WHEN s > 0 THEN s // 60 || 'm left' ELSE 'Ended' END AS time_left,
    CAST(floor(value + 0.5) AS BIGINT) AS whole, ts::DATE - CAST(dayofweek(ts) AS INTEGER) AS week_start, ts::DATE + (6 - CAST(dayofweek(ts) AS INTEGER)) AS week_end, strftime(ts, '%b') AS month
    FROM (SELECT *, epoch(TIMESTAMP '2024-02-01')::BIGINT - epoch(date_trunc('second', ts))::BIGINT AS s FROM ev)""",
)
def format_values(spark, sf):
    ts = F.date_trunc("second", "ts").cast("timestamp_ntz")
    end = F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))
    day = F.to_date("ts")
    return events(spark, sf).select(
        "event_id",
        numbers.compact(F.col("value") * 10000).alias("compact"),
        times.format_duration(F.col("k") * 37).alias("duration"),
        times.relative_time(ts, end).alias("relative"),
        times.time_left(end, ts).alias("time_left"),
        numbers.js_round("value").alias("whole"),
        times.week_start(day).alias("week_start"),
        times.week_end(day).alias("week_end"),
        times.month_label(day).alias("month"),
    )


@query(
    "time_range_presets",
    "SELECT '24h' AS preset, count(*) AS events FROM events WHERE ts >= TIMESTAMP '2024-01-19 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"
    " UNION ALL SELECT '7d', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"
    " UNION ALL SELECT '30d', count(*) FROM events WHERE ts >= TIMESTAMP '2023-12-21' AND ts <= TIMESTAMP '2024-01-20 12:00:00'",
)
def time_range_presets(spark, sf):
    rows = table(spark, sf, "events").select("ts")
    presets = {p: times.time_range(p, EVENTS_AS_OF) for p in ("24h", "7d", "30d")}
    # one scan for all presets
    counts = rows.agg(*[F.count_if(F.col("ts").between(F.lit(a), F.lit(b))).alias(p) for p, (a, b) in presets.items()])
    pairs = [F.struct(F.lit(p).alias("preset"), F.col(f"`{p}`").alias("events")) for p in presets]
    return counts.select(F.inline(F.array(*pairs)))
