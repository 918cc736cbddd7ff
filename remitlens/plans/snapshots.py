"""Snapshots and replay over the payments."""

from pyspark.sql import functions as F

from remitlens.functions.numbers import canonical_number
from remitlens.operators import snapshot as op
from remitlens.plans.registry import query, rounded
from remitlens.plans.views import PAYMENTS, davg, dsum
from remitlens.sources.tables import snapshot_rows, table

_SNAPSHOT = f"""
  SELECT corridor,
         arg_min(network, (ledger_sequence, network, reliability, amount_usd, latency_ms)) AS source,
         {davg('reliability')} AS avg_reliability,
         {dsum('amount_usd')} AS total_volume,
         {davg('latency_ms')} AS avg_latency_ms
  FROM payments"""


def _round(df):
    return rounded(df, avg_reliability=6, total_volume=4, avg_latency_ms=6)


@query("snapshot_by_corridor", f"WITH {PAYMENTS} {_SNAPSHOT} GROUP BY corridor")
def snapshot_by_corridor(spark, sf):
    return _round(op.generate_snapshot(snapshot_rows(spark, sf)))


@query(
    "snapshot_by_network",
    f"""WITH {PAYMENTS}
    SELECT corridor, network AS source, {davg('reliability')} AS avg_reliability,
           {dsum('amount_usd')} AS total_volume, {davg('latency_ms')} AS avg_latency_ms
    FROM payments GROUP BY corridor, network""",
)
def snapshot_by_network(spark, sf):
    return _round(op.generate_snapshot(snapshot_rows(spark, sf), by_network=True))


@query(
    "snapshot_wide_range",
    """SELECT l_returnflag AS corridor, 'x' AS source, CAST(sum(m) AS DOUBLE) / 1048576 AS total_volume, CAST(sum(m) AS DOUBLE) / 1048576 / count(*) AS avg_latency_ms
    FROM (SELECT l_returnflag, (l_orderkey * 31 + l_linenumber) % 1000003 AS m FROM lineitem) GROUP BY 1""",
)
def snapshot_wide_range(spark, sf):
    """Volumes of 2**-20 to 2**80 whose large parts cancel: sums in double would lose the small ones."""
    m = F.expr("(l_orderkey * 31 + l_linenumber) % 1000003").cast("double")
    parts = [(m * 2.0**60, None), (m * 2.0**-20, m * 2.0**-20), (m * -(2.0**60), None)]
    values = F.array(*[F.struct(v.alias("volume"), (F.lit(None).cast("double") if x is None else x).alias("latency_ms")) for v, x in parts])
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ledger_sequence"), F.col("l_returnflag").alias("corridor"), F.lit("x").alias("source"), F.lit(1.0).alias("reliability"),
        F.inline(values),
    )
    return op.generate_snapshot(rows).select("corridor", "source", "total_volume", "avg_latency_ms")


@query("filter_ledger_range", f"WITH {PAYMENTS} SELECT ledger_sequence, corridor, network AS source, reliability, amount_usd AS volume, latency_ms FROM payments WHERE ledger_sequence BETWEEN 100 AND 900")
def filter_ledger_range(spark, sf):
    return op.filter_ledger_range(snapshot_rows(spark, sf), 100, 900)


@query("replay_range", f"WITH {PAYMENTS} {_SNAPSHOT} WHERE ledger_sequence BETWEEN 100 AND 900 GROUP BY corridor")
def replay_range(spark, sf):
    return _round(op.replay(snapshot_rows(spark, sf), 100, 900))


# The payload prints a number with the shortest digits that read back; so does DuckDB in this range.
_LINES = f"""s AS ({_SNAPSHOT} {{where}} GROUP BY corridor),
    r AS (SELECT row_number() OVER (ORDER BY corridor, source) AS position, '{{{{"corridor":"' || corridor || '","source":"' || source
             || '","avg_reliability":' || avg_reliability::VARCHAR || ',"total_volume":' || total_volume::VARCHAR
             || ',"avg_latency_ms":' || avg_latency_ms::VARCHAR || '}}}}' AS j FROM s)
    SELECT 0 AS position, '{{{{"model_version":"{op.MODEL_VERSION}","records":[' AS value
    UNION ALL SELECT position, CASE WHEN position = 1 THEN '' ELSE ',' END || j FROM r
    UNION ALL SELECT coalesce(max(position), 0) + 1, ']}}}}' FROM r"""


def _lines(spark, sf, start, end):
    return op.payload_lines(_round(op.replay(snapshot_rows(spark, sf), start, end)))


@query("replay_payload", f"WITH {PAYMENTS}, " + _LINES.format(where="WHERE ledger_sequence BETWEEN 100 AND 900"))
def replay_payload(spark, sf):
    return _lines(spark, sf, 100, 900)


@query("replay_payload_empty_range", f"WITH {PAYMENTS}, " + _LINES.format(where="WHERE ledger_sequence BETWEEN -9 AND -1"))
def replay_payload_empty_range(spark, sf):
    return _lines(spark, sf, -9, -1)


@query("snapshot_lines", f"WITH {PAYMENTS}, l AS (WITH " + _LINES.format(where="") + ") SELECT value FROM l")
def snapshot_lines(spark, sf):
    from remitlens.sources import sinks

    return sinks.snapshot_lines(_round(op.generate_snapshot(snapshot_rows(spark, sf))))


def _digest_sql(source: str, row: str, kind: str) -> str:
    slices = ", ".join(
        f"sum(CAST(('0x' || substr(h, {1 + 16 * i}, 16)) AS UBIGINT))::VARCHAR AS s{i}" for i in range(4)
    )
    return f"""h AS (SELECT sha256({row}) AS h FROM {source}),
    d AS (SELECT count(*) AS n, {slices} FROM h)
    SELECT '{kind}' AS snapshot_type, n AS record_count,
           sha256(concat_ws('|', n::VARCHAR, s0, s1, s2, s3)) AS data_hash FROM d"""


@query(
    "snapshot_digest",
    f"WITH {PAYMENTS}, c AS ({_SNAPSHOT} GROUP BY corridor), "
    + _digest_sql("c", "concat_ws('|', corridor, source, avg_reliability::VARCHAR, total_volume::VARCHAR, avg_latency_ms::VARCHAR)", "corridor"),
)
def snapshot_digest(spark, sf):
    snap = _round(op.generate_snapshot(snapshot_rows(spark, sf)))
    numbers = ["avg_reliability", "total_volume", "avg_latency_ms"]
    texts = snap.withColumns({n: canonical_number(n) for n in numbers})
    return op.snapshot_digest(texts, ["corridor", "source", *numbers], "corridor")
