"""Contract events, contract state, reconciliation and validation over the supplied tables."""

from pyspark.sql import functions as F

from remitlens.functions.addresses import (
    address_error,
    address_short,
    amount_error,
    asset_code_error,
    asset_type_matches,
    corridor_key,
    corridor_name,
    hex32,
    receiver_id_error,
    signed_payload,
)
from remitlens.operators import contract_events as ev
from remitlens.operators import contract_state as cs
from remitlens.operators import quality as q
from remitlens.operators import reconcile as rec
from remitlens.plans.common import EVENTS_AS_OF, EVENTS_AS_OF_SQL
from remitlens.plans.registry import query, rounded
from remitlens.plans.views import EVENTS, PAYMENTS, davg, dsum
from remitlens.sources.tables import events, payments, table

# ---- contract events -----------------------------------------------------------------------------
# The property k of an event decides which field of its envelope is damaged, and the type which rule.


def envelopes(spark, sf):
    return envelopes_of(events(spark, sf))


def envelopes_of(rows):
    k, kind = F.col("k"), F.col("event_type")
    s = F.lit

    def entry(key, val_kind, val, key_kind="symbol"):
        return F.struct(
            (s(key_kind) if isinstance(key_kind, str) else key_kind).alias("key_kind"),
            (s(key) if isinstance(key, str) else key).alias("key"),
            (s(val_kind) if isinstance(val_kind, str) else val_kind).alias("val_kind"),
            (s(val) if isinstance(val, str) else val).alias("val"),
        )

    text = lambda c: F.col(c).cast("string")
    version = F.when(k < 60, s("1")).when(k < 90, s("2")).otherwise(s("999"))
    snapshot_hash = F.sha2(text("event_id"), 256)
    absent = F.lit(None)
    data = F.array_compact(
        F.array(
            F.when(k == 10, entry("epoch", "u64", "1", key_kind="string")),
            F.when(~k.isin(11), entry("schema_version", F.when(k == 12, s("u64")).otherwise(s("u32")), version)),
            entry("epoch", F.when(k == 16, s("u32")).otherwise(s("u64")), F.when(k == 20, s("18446744073709551615")).when(k == 21, s("18446744073709551616")).otherwise(text("event_id"))),
            F.when(k == 13, entry("epoch", "u64", "7")),
            F.when(k == 14, entry("note", "string", "x")),
            entry("snapshot_hash", "bytes", F.when(k == 17, s("abcd")).otherwise(F.upper(snapshot_hash))),
            entry("source_data_hash", "bytes", F.sha2(text("user_id"), 256)),
            entry("submitted_at", F.when(k == 18, s("string")).otherwise(s("u64")), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")),
            F.when(k != 15, entry("submitter", F.when(k == 19, s("string")).otherwise(s("address")), F.concat(s("G"), text("user_id")))),
            F.when((k >= 60) & (k != 61), entry("snapshot_size_bytes", F.when(k == 62, s("u32")).otherwise(s("u64")), "8192")),
        )
    )
    topic = F.struct(
        F.when(k == 51, s("string")).otherwise(s("symbol")).alias("kind"),
        F.when(k == 53, absent.cast("string")).when(k == 52, s("payment_made")).otherwise(s(ev.SNAPSHOT_TOPIC)).alias("value"),
    )
    # the envelope is built once per row, as if it had been read from storage
    return ev.once(rows, _envelope=F.struct(
        F.col("event_id").alias("seq"),
        F.when((kind == "error") & (k < 5), s("system")).otherwise(s("contract")).alias("type"),
        F.when((kind == "signup") & (k < 5), absent.cast("string")).otherwise(F.concat(s("C"), text("user_id"))).alias("contract_id"),
        F.when(k == 50, F.array(topic, topic)).otherwise(F.array(topic)).alias("topics"),
        F.when(k == 54, s("vec")).otherwise(s("map")).alias("data_kind"),
        data.alias("data"),
    )).select("_envelope.*")


_VERDICT = f"""WITH {EVENTS}, v AS (SELECT *, CASE
    WHEN event_type = 'error' AND k < 5 THEN 'UnsupportedEventType:system'
    WHEN event_type = 'signup' AND k < 5 THEN 'MissingContractId:'
    WHEN k = 50 THEN 'InvalidTopicCount:2' WHEN k = 51 THEN 'InvalidTopicType:' WHEN k = 53 THEN 'InvalidTopicEncoding:'
    WHEN k = 54 THEN 'InvalidEventData:' WHEN k = 52 THEN 'UnsupportedTopic:payment_made' WHEN k = 10 THEN 'InvalidFieldNameType:'
    WHEN k = 11 THEN 'MissingField:schema_version' WHEN k = 12 THEN 'InvalidFieldType:schema_version'
    WHEN k >= 90 THEN 'UnsupportedSchemaVersion:999' WHEN k = 13 THEN 'DuplicateField:epoch' WHEN k = 14 THEN 'UnexpectedField:note'
    WHEN k = 15 THEN 'MissingField:submitter' WHEN k = 61 THEN 'MissingField:snapshot_size_bytes' WHEN k = 62 THEN 'InvalidFieldType:snapshot_size_bytes'
    WHEN k = 16 THEN 'InvalidFieldType:epoch' WHEN k = 17 THEN 'InvalidFieldType:snapshot_hash' WHEN k = 18 THEN 'InvalidFieldType:submitted_at'
    WHEN k = 19 THEN 'InvalidFieldType:submitter' WHEN k = 21 THEN 'ValueOutOfRange:epoch' END AS e FROM ev)"""


@query("decode_events_normalized", f"""{_VERDICT} SELECT event_id AS seq, 'C' || user_id AS contract_id, CASE WHEN k = 20 THEN '18446744073709551615' ELSE event_id::VARCHAR END AS epoch, sha256(event_id::VARCHAR) AS snapshot_hash,
    sha256(user_id::VARCHAR) AS source_data_hash, CAST(floor(epoch(ts)) AS BIGINT) AS submitted_at, 'G' || user_id AS submitter FROM v WHERE e IS NULL""")
def decode_events_normalized(spark, sf):
    # unsigned 64-bit values travel as decimals
    rows = ev.normalized(ev.decode_snapshot_events(envelopes(spark, sf)))
    return rows.withColumns({"epoch": F.col("epoch").cast("string"), "submitted_at": F.col("submitted_at").cast("bigint")})


@query("decode_events_rejected", f"{_VERDICT} SELECT event_id AS seq, split_part(e, ':', 1) AS error_code, split_part(e, ':', 2) AS error_detail FROM v WHERE e IS NOT NULL")
def decode_events_rejected(spark, sf):
    return ev.rejected(ev.decode_snapshot_events(envelopes(spark, sf)))


@query(
    "drop_fenced_writes",
    f"""WITH {EVENTS}, w AS (SELECT user_id AS resource, event_id AS seq, k AS token, max(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev)
    SELECT resource, seq, token FROM w WHERE m IS NULL OR token >= m""",
)
def drop_fenced_writes(spark, sf):
    writes = events(spark, sf).select(F.col("user_id").alias("resource"), F.col("event_id").alias("seq"), F.col("k").alias("token"))
    return ev.drop_fenced_writes(writes)


_SUB = f"""WITH {EVENTS}, s AS (SELECT user_id AS contract_id, event_id AS arrival, k // 2 + event_id // 400 AS epoch,
    CASE WHEN event_type = 'view' AND k > 80 THEN 0 ELSE 2 END AS metric_count, event_type = 'error' AND k > 80 AS paused FROM ev),
  b AS (SELECT *, CASE WHEN paused THEN 'ContractPaused' WHEN epoch = 0 THEN 'InvalidEpoch' WHEN metric_count = 0 THEN 'EmptyMetrics' END AS basic FROM s),
  m AS (SELECT *, max(CASE WHEN basic IS NULL THEN epoch END) OVER (PARTITION BY contract_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM b)"""


def submissions(spark, sf):
    k, kind = F.col("k"), F.col("event_type")
    return events(spark, sf).select(
        F.col("user_id").alias("contract_id"),
        F.col("event_id").alias("arrival"),
        (F.floor(k / 2) + F.floor(F.col("event_id") / 400)).alias("epoch"),
        F.when((kind == "view") & (k > 80), 0).otherwise(2).alias("metric_count"),
        ((kind == "error") & (k > 80)).alias("paused"),
    )


@query("accept_epochs", f"{_SUB} SELECT contract_id, arrival, epoch, coalesce(basic, CASE WHEN epoch <= last THEN 'EpochMonotonicityViolated' END) AS reason FROM m")
def accept_epochs(spark, sf):
    return ev.accept_epochs(submissions(spark, sf)).select("contract_id", "arrival", "epoch", "reason")


@query(
    "accept_epochs_with_duplicates",
    f"""{_SUB}, a AS (SELECT contract_id, epoch, arrival AS t FROM m WHERE basic IS NULL AND NOT coalesce(epoch <= last, false))
    SELECT m.contract_id, m.arrival, m.epoch, coalesce(basic, CASE WHEN a.t < m.arrival THEN 'DuplicateEpoch' END, CASE WHEN m.epoch <= last THEN 'EpochMonotonicityViolated' END) AS reason
    FROM m LEFT JOIN a ON a.contract_id = m.contract_id AND a.epoch = m.epoch""",
)
def accept_epochs_with_duplicates(spark, sf):
    checked = ev.accept_epochs(submissions(spark, sf), check_duplicates=True)
    return checked.select("contract_id", "arrival", "epoch", "reason")


# Epoch metrics: orders per customer and month.
_METRICS = """WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS epoch, 'orders_' || o_custkey AS metric, count(*) AS value FROM orders GROUP BY 1, 2),
  e AS (SELECT epoch, coalesce(lag(epoch) OVER (ORDER BY epoch), 0) AS prev FROM (SELECT DISTINCT epoch FROM m)),
  n AS (SELECT m.epoch, prev, metric, value FROM m JOIN e USING (epoch)),
  o AS (SELECT e.epoch, m.metric, m.value FROM e JOIN m ON m.epoch = e.prev),
  d AS (SELECT coalesce(n.epoch, o.epoch) AS to_epoch, coalesce(n.metric, o.metric) AS metric, o.value AS old_value, n.value AS new_value FROM n FULL JOIN o ON n.epoch = o.epoch AND n.metric = o.metric),
  c AS (SELECT prev AS from_epoch, to_epoch, metric, CASE WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'removed' ELSE 'changed' END AS change, old_value, new_value
    FROM d JOIN e ON e.epoch = d.to_epoch WHERE old_value IS DISTINCT FROM new_value)"""


def epoch_metrics(spark, sf):
    return table(spark, sf, "orders").groupBy(
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("epoch"),
        F.concat(F.lit("orders_"), F.col("o_custkey").cast("string")).alias("metric"),
    ).agg(F.count("*").alias("value"))


@query("diff_metrics", f"{_METRICS} SELECT from_epoch, to_epoch, metric, change, old_value, new_value FROM c")
def diff_metrics(spark, sf):
    return ev.diff_metrics(epoch_metrics(spark, sf))


@query("diff_receipts", f"""{_METRICS} SELECT e.epoch, e.prev AS from_epoch, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
    count(*) FILTER (change = 'changed') AS changed FROM e LEFT JOIN c ON c.to_epoch = e.epoch GROUP BY 1, 2""")
def diff_receipts(spark, sf):
    return ev.diff_receipts(epoch_metrics(spark, sf))


@query("previous_epochs", f"{_METRICS} SELECT epoch, prev AS from_epoch FROM e")
def previous_epochs(spark, sf):
    return ev.previous_epochs(epoch_metrics(spark, sf))


# Stored events: order status is the verification status.
_STORED = """s AS (SELECT o_orderkey AS id, 'C' || o_custkey AS contract_id, o_orderpriority AS event_type, o_orderkey AS ledger, o_orderdate AS created_at,
    CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'P' THEN 'failed' WHEN 'O' THEN 'pending' END AS verification_status, year(o_orderdate) AS epoch FROM orders)"""


def stored_events(spark, sf):
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("contract_id"),
        F.col("o_orderpriority").alias("event_type"),
        F.col("o_orderkey").alias("ledger"),
        F.col("o_orderdate").alias("created_at"),
        F.when(status == "F", "verified").when(status == "P", "failed").when(status == "O", "pending").alias("verification_status"),
        F.year("o_orderdate").cast("bigint").alias("epoch"),
    )


@query(
    "query_events",
    f"""WITH {_STORED} SELECT id, contract_id, created_at FROM s WHERE event_type = '5-LOW' AND verification_status = 'verified' AND ledger BETWEEN 10 AND 100000
    ORDER BY created_at DESC, id DESC LIMIT 40 OFFSET 5""",
)
def query_events(spark, sf):
    return ev.query_events(
        stored_events(spark, sf), event_type="5-LOW", verification_status="verified", ledger_range=(10, 100000), limit=40, offset=5
    ).select("id", "contract_id", "created_at")


@query("event_stats", f"WITH {_STORED} SELECT count(*) AS total, count(*) FILTER (verification_status = 'verified') AS verified, count(*) FILTER (verification_status = 'pending') AS pending, count(*) FILTER (verification_status = 'failed') AS failed FROM s")
def event_stats(spark, sf):
    return ev.event_stats(stored_events(spark, sf))


@query("verification_summary", f"WITH {_STORED} SELECT contract_id, max(epoch) AS epoch, arg_max(created_at, (epoch, created_at, id)) AS created_at, arg_max(verification_status, (epoch, created_at, id)) AS status FROM s GROUP BY 1")
def verification_summary(spark, sf):
    return ev.verification_summary(stored_events(spark, sf))


@query("audit_trail", f"WITH {_STORED} SELECT id, epoch, created_at, verification_status FROM s WHERE contract_id = 'C7' ORDER BY epoch DESC, created_at DESC, id DESC")
def audit_trail(spark, sf):
    return ev.audit_trail(stored_events(spark, sf), "C7").select("id", "epoch", "created_at", "verification_status")


@query(
    "ledger_progress_check",
    f"""WITH {EVENTS}, l AS (SELECT user_id, event_id AS seq, event_id // 10 + k // 50 AS ledger, CAST(floor(epoch(ts)) AS BIGINT) AS closed_at FROM ev),
    p AS (SELECT *, lag(ledger) OVER w AS pl, lag(closed_at) OVER w AS pt FROM l WINDOW w AS (PARTITION BY user_id ORDER BY seq))
    SELECT user_id, seq, ledger >= pl AND closed_at >= pt AND (ledger <> pl OR closed_at = pt) AND closed_at - pt >= ledger - pl AS valid FROM p WHERE pl IS NOT NULL""",
)
def ledger_progress_check(spark, sf):
    ledgers = events(spark, sf).select(
        "user_id",
        F.col("event_id").alias("seq"),
        (F.floor(F.col("event_id") / 10) + F.floor(F.col("k") / 50)).alias("ledger"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("closed_at"),
    )
    return ev.ledger_progress_check(ledgers, ["user_id"]).select("user_id", "seq", "valid")


# ---- contract state ------------------------------------------------------------------------------

_STATE_SQL = """CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderpriority < '3' THEN 'AwaitingDeposit' ELSE 'AwaitingBeneficiary' END
    WHEN o_orderstatus = 'F' THEN 'AwaitingRelease' WHEN o_orderpriority < '4' THEN 'Disputed' ELSE 'Released' END"""


@query(
    "escrow_due",
    f"""WITH e AS (SELECT o_orderkey AS id, {_STATE_SQL} AS state, CAST(epoch(o_orderdate) AS BIGINT) AS deadline, o_totalprice > 200000 AS by_depositor FROM orders),
    t AS (SELECT *, CASE state WHEN 'AwaitingDeposit' THEN 'Cancelled' WHEN 'AwaitingBeneficiary' THEN 'Refunded' WHEN 'AwaitingRelease' THEN 'Released'
      WHEN 'Disputed' THEN CASE WHEN by_depositor THEN 'Released' ELSE 'Refunded' END END AS target FROM e)
    SELECT id, state, target IS NOT NULL AND 900000000 < deadline AS action_allowed, CASE WHEN 900000000 >= deadline THEN target END AS timeout_outcome FROM t""",
)
def escrow_due(spark, sf):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    state = (
        F.when((status == "O") & (priority < "3"), "AwaitingDeposit")
        .when(status == "O", "AwaitingBeneficiary")
        .when(status == "F", "AwaitingRelease")
        .when(priority < "4", "Disputed")
        .otherwise("Released")
    )
    states = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        state.alias("state"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("deadline"),
        F.when(F.col("o_totalprice") > 200000, "depositor").otherwise("beneficiary").alias("dispute_initiator"),
    )
    return cs.escrow_due(states, F.lit(900_000_000)).select("id", "state", "action_allowed", "timeout_outcome")


@query(
    "timelock_due",
    """WITH t AS (SELECT l_orderkey AS id, l_linenumber, l_partkey, CAST(epoch(o_orderdate) AS BIGINT) AS created_at, l_orderkey AS created_ledger,
      CAST(epoch(o_orderdate) AS BIGINT) + CAST(floor(o_totalprice * 200 - 5000000) AS BIGINT) AS unlock_time, CAST(epoch(l_shipdate) AS BIGINT) AS now, l_orderkey + l_linenumber - 1 AS ledger
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT id, l_linenumber, l_partkey, CASE WHEN unlock_time <= created_at THEN 'InvalidUnlockTime'
      WHEN ledger < created_ledger OR now < created_at OR (ledger = created_ledger AND now <> created_at) OR now - created_at < ledger - created_ledger THEN 'InvalidLedgerProgression'
      WHEN now < unlock_time THEN 'NotUnlockedYet' ELSE 'Executable' END AS status FROM t""",
)
def timelock_due(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    created = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    locks = (
        table(spark, sf, "lineitem")
        .join(orders, F.expr("l_orderkey = o_orderkey"))
        .select(
            F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", created.alias("created_at"),
            F.col("l_orderkey").alias("created_ledger"),
            (created + F.floor(F.col("o_totalprice") * 200 - 5000000)).alias("unlock_time"),
            F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("now"),
            (F.col("l_orderkey") + F.col("l_linenumber") - 1).alias("ledger"),
        )
    )
    return cs.timelock_due(locks).select("id", "l_linenumber", "l_partkey", "status")


@query(
    "swap_settlement_check",
    """WITH j AS (SELECT o_custkey AS maker, l_orderkey AS offer_id, l_linenumber AS seq, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS output_amount,
      o_totalprice / 10 AS min_output, o_orderstatus = 'P' AS cancelled, o_orderpriority = '1-URGENT' AS filled FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    f AS (SELECT offer_id, min((seq, part, supp, output_amount)) AS at FROM j WHERE NOT filled AND NOT cancelled AND output_amount >= min_output GROUP BY 1)
    SELECT j.offer_id, seq, part, supp, CASE WHEN filled OR (seq, part, supp, output_amount) > f.at THEN 'AlreadyFilled' WHEN cancelled THEN 'Cancelled'
      WHEN output_amount < min_output THEN 'SlippageExceeded' ELSE 'Settled' END AS result FROM j LEFT JOIN f ON f.offer_id = j.offer_id""",
)
def swap_settlement_check(spark, sf):
    offers = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("maker"),
        F.col("o_orderkey").alias("offer_id"),
        F.col("o_totalprice").alias("amount_in"),
        (F.col("o_totalprice") / 10).alias("min_output"),
        (F.col("o_orderstatus") == "P").alias("cancelled"),
        (F.col("o_orderpriority") == "1-URGENT").alias("filled"),
    )
    settlements = (
        table(spark, sf, "lineitem")
        .join(offers.select("maker", "offer_id"), F.expr("l_orderkey = offer_id"))
        .select(
            "maker", "offer_id", F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("output_amount"),
        )
    )
    checked = cs.swap_settlement_check(offers, settlements, ["seq", "part", "supp", "output_amount"])
    return checked.select("offer_id", "seq", "part", "supp", "result")


@query(
    "approvals_met",
    """WITH v AS (SELECT a.l_partkey AS p, count(DISTINCT a.l_suppkey) AS n FROM lineitem a WHERE a.l_returnflag = 'A' AND EXISTS
      (SELECT 1 FROM lineitem o WHERE o.l_partkey = a.l_partkey AND o.l_suppkey = a.l_suppkey AND o.l_linestatus = 'F') GROUP BY 1)
    SELECT p_partkey AS proposal_id, coalesce(n, 0) AS valid_approvals, coalesce(n, 0) >= p_size / 8.0 AND p_type <> 'PROMO' AS executable FROM part LEFT JOIN v ON p = p_partkey""",
)
def approvals_met(spark, sf):
    lines = table(spark, sf, "lineitem")
    proposals = table(spark, sf, "part").select(
        F.col("p_partkey").alias("proposal_id"), (F.col("p_size") / 8.0).alias("threshold"), (F.col("p_type") == "PROMO").alias("executed")
    )
    key = F.col("l_partkey").alias("proposal_id")
    approvals = lines.where(F.col("l_returnflag") == "A").select(key, F.col("l_suppkey").alias("approver"))
    owners = lines.where(F.col("l_linestatus") == "F").select(key, F.col("l_suppkey").alias("owner"))
    return cs.approvals_met_rows(proposals, approvals, owners).select("proposal_id", "valid_approvals", "executable")


_TTL = """WITH policy(label, threshold, extend_to) AS (VALUES ('MACHINERY', 200000, 600000), ('BUILDING', 50000, 400000)),
  c AS (SELECT c_custkey::VARCHAR AS address, c_mktsegment AS label, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal * 30) AS BIGINT) END AS remaining FROM customer),
  d AS (SELECT address, c.label, remaining, CASE WHEN remaining IS NULL THEN 'missing' WHEN remaining < coalesce(threshold, 100000) THEN 'extend' ELSE 'healthy' END AS action,
    CASE WHEN remaining < coalesce(threshold, 100000) THEN coalesce(p.extend_to, 535680) END::BIGINT AS extend_to FROM c LEFT JOIN policy p ON p.label = c.label)"""


def ttl_checks(spark, sf):
    customer = table(spark, sf, "customer")
    contracts = customer.select(
        F.col("c_custkey").cast("string").alias("address"),
        F.col("c_mktsegment").alias("label"),
        F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") * 30)).alias("remaining"),
    )
    segment = F.col("label")
    policies = contracts.where(segment.isin("MACHINERY", "BUILDING")).select(
        "address",
        F.when(segment == "MACHINERY", 200_000).otherwise(50_000).cast("bigint").alias("threshold"),
        F.when(segment == "MACHINERY", 600_000).otherwise(400_000).cast("bigint").alias("extend_to"),
    )
    return cs.ttl_due(contracts, policies)


@query("ttl_due", f"{_TTL} SELECT * FROM d")
def ttl_due(spark, sf):
    return ttl_checks(spark, sf)


@query(
    "ttl_metrics",
    f"""{_TTL} SELECT label, min(remaining) AS remaining, count(*) FILTER (action = 'extend' AND NOT remaining < 1000) AS bumped,
    count(*) FILTER (action = 'extend' AND remaining < 1000) AS bump_errors, count(*) FILTER (action = 'healthy') AS skipped FROM d GROUP BY 1""",
)
def ttl_metrics(spark, sf):
    return cs.ttl_metrics(ttl_checks(spark, sf).withColumn("bump_ok", ~(F.col("remaining") < 1000)))


# ---- reconciliation ------------------------------------------------------------------------------
# Period = order. Off-chain: settled orders. On-chain: what the order lines say.

_REC = """WITH periods AS (SELECT o_orderkey AS period FROM orders),
  off AS (SELECT o_orderkey AS period, sha256(o_orderstatus) AS h, sha256(year(o_orderdate)::VARCHAR) AS s FROM orders WHERE o_orderstatus <> 'P'),
  onc AS (SELECT l_orderkey AS period, sha256(max(l_linestatus)) AS h, sha256(year(min(l_shipdate))::VARCHAR) AS s FROM lineitem GROUP BY 1),
  d AS (SELECT p.period, k.kind, k.detail FROM periods p LEFT JOIN off ON off.period = p.period LEFT JOIN onc ON onc.period = p.period,
    LATERAL (VALUES
      (CASE WHEN off.period IS NOT NULL AND onc.period IS NULL THEN 'MissingOnChain' END, 'off-chain aggregate exists but on-chain snapshot is missing'),
      (CASE WHEN off.period IS NULL AND onc.period IS NOT NULL THEN 'MissingOffChain' END, 'on-chain snapshot exists but off-chain aggregate is missing'),
      (CASE WHEN off.h <> onc.h THEN 'SnapshotHashMismatch' END, 'snapshot hash mismatch'),
      (CASE WHEN off.s <> onc.s THEN 'SourceDataHashMismatch' END, 'source data hash mismatch')) k(kind, detail) WHERE k.kind IS NOT NULL),
  mis AS (SELECT off.period, CASE WHEN off.period > 5000 THEN 'rejected' END AS error FROM off ANTI JOIN onc ON off.period = onc.period)"""


def _sides(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    periods = orders.select(F.col("o_orderkey").alias("period"))
    off = orders.where(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("period"),
        F.sha2("o_orderstatus", 256).alias("snapshot_hash"),
        F.sha2(F.year("o_orderdate").cast("string"), 256).alias("source_data_hash"),
    )
    on = lines.groupBy(F.col("l_orderkey").alias("period")).agg(
        F.sha2(F.max("l_linestatus"), 256).alias("snapshot_hash"),
        F.sha2(F.year(F.min("l_shipdate")).cast("string"), 256).alias("source_data_hash"),
    )
    return periods, off, on


@query("reconcile", f"{_REC} SELECT period, kind, detail FROM d")
def reconcile(spark, sf):
    return rec.reconcile(*_sides(spark, sf))


@query("discrepancy_alerts", f"{_REC} SELECT 'DiscrepancyDetected' AS kind, 'Warning' AS severity, period, detail AS message FROM d")
def discrepancy_alerts(spark, sf):
    return rec.discrepancy_alerts(rec.reconcile(*_sides(spark, sf)))


@query("missing_submissions", f"{_REC} SELECT period FROM mis")
def missing_submissions(spark, sf):
    return rec.missing_submissions(*_sides(spark, sf))


def _submit(missing):
    return missing.select("period", F.when(F.col("period") > 5000, F.lit("rejected")).alias("error"))


@query("resubmission_alerts", f"""{_REC} SELECT 'MissingSubmissionResubmitFailed' AS kind, 'Critical' AS severity, period,
    'automatic resubmission failed for missing on-chain snapshot: ' || error AS message FROM mis WHERE error IS NOT NULL""")
def resubmission_alerts(spark, sf):
    attempts, _ = rec.resubmit(*_sides(spark, sf), _submit)
    return rec.resubmission_alerts(attempts)


@query(
    "reconcile_after_resubmission",
    f"{_REC} SELECT period, kind, detail FROM d WHERE NOT (kind = 'MissingOnChain' AND period IN (SELECT period FROM mis WHERE error IS NULL))",
)
def reconcile_after_resubmission(spark, sf):
    periods, off, on = _sides(spark, sf)
    _, stored = rec.resubmit(periods, off, on, _submit)
    return rec.reconcile(periods, off, stored)


@query(
    "reconciliation_report",
    f"""{_REC} SELECT (SELECT count(*) FROM periods) AS checked_periods, (SELECT count(*) FROM d) AS discrepancies, count(*) AS missing_periods, count(*) AS attempts,
    count(error) AS failures FROM mis""",
)
def reconciliation_report(spark, sf):
    periods, off, on = _sides(spark, sf)
    attempts, _ = rec.resubmit(periods, off, on, _submit)
    return rec.reconciliation_report(periods, rec.reconcile(periods, off, on), attempts)


_REG = f"""WITH b AS (SELECT p_name || '/' || p_brand AS name, {davg('l_extendedprice', 9)} AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate < TIMESTAMP '1996-06-01' GROUP BY 1),
  c AS (SELECT p_name || '/' || p_brand AS name, {davg('l_extendedprice', 9)} AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-06-01' GROUP BY 1)"""


def _benchmarks(spark, sf):
    from remitlens.functions.numbers import exact_avg

    part = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_name", "p_brand").alias("name"))
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    joined = lines.join(part, F.expr("l_partkey = p_partkey"))
    cut = F.to_timestamp_ntz(F.lit("1996-06-01 00:00:00"))
    value = F.round(exact_avg("l_extendedprice"), 9).alias("value")
    return (
        joined.where(F.col("l_shipdate") >= cut).groupBy("name").agg(value),
        joined.where(F.col("l_shipdate") < cut).groupBy("name").agg(value),
    )


@query(
    "check_gas_regression",
    f"""{_REG}, j AS (SELECT c.name, c.value, b.value AS baseline, (c.value - b.value) / nullif(b.value, 0) AS ch FROM c LEFT JOIN b USING (name))
    SELECT name, value, baseline, round(ch, 9) AS change, CASE WHEN baseline IS NULL THEN 'NEW' WHEN ch > 0.2 THEN 'FAIL' ELSE 'OK' END AS status FROM j""",
)
def check_gas_regression(spark, sf):
    return rounded(rec.check_regression(*_benchmarks(spark, sf)), change=9)


@query(
    "check_throughput_regression",
    f"""{_REG}, j AS (SELECT c.name, c.value, b.value AS baseline, CASE WHEN b.value > 0 THEN (c.value - b.value) / b.value * 100 END AS ch FROM c LEFT JOIN b USING (name))
    SELECT name, value, baseline, round(ch, 9) AS change_pct, CASE WHEN baseline IS NULL OR baseline <= 0 THEN 'MISSING_BASELINE' WHEN ch < -10 THEN 'REGRESSION' ELSE 'OK' END AS status FROM j""",
)
def check_throughput_regression(spark, sf):
    return rounded(rec.check_throughput(*_benchmarks(spark, sf)), change_pct=9)


# ---- validation ----------------------------------------------------------------------------------

_VC = """WITH r AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 9500 THEN '' ELSE c_name END AS corridor_key, c_mktsegment AS asset_a_code,
    CASE WHEN c_acctbal > 9000 THEN lower(c_name) ELSE 'G' || lpad(c_custkey::VARCHAR, 55, '0') END AS asset_a_issuer,
    CASE WHEN c_acctbal > 8500 THEN c_mktsegment || '_TOO_LONG_CODE' ELSE c_mktsegment END AS asset_b_code, 'M' || lpad(c_nationkey::VARCHAR, 68, '0') AS asset_b_issuer,
    c_acctbal / 80 AS success_rate, CASE WHEN c_acctbal > 0 THEN c_acctbal / 100 END AS health_score FROM customer),
  v AS (SELECT id, concat_ws(',', CASE WHEN trim(corridor_key) = '' THEN 'MissingField:corridor_key' END,
    CASE WHEN NOT regexp_matches(asset_a_issuer, '^G[A-Z0-9]{55}$') THEN 'InvalidAddress:asset_a_issuer' END,
    CASE WHEN length(asset_b_code) > 12 THEN 'InvalidFormat:asset_b_code' END,
    CASE WHEN success_rate < 0 OR success_rate > 100 THEN 'OutOfRange:success_rate' END,
    CASE WHEN health_score < 0 OR health_score > 100 THEN 'OutOfRange:health_score' END) AS reasons FROM r)"""


def corridor_records(spark, sf):
    bal, seg = F.col("c_acctbal"), F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(bal > 9500, "").otherwise(F.col("c_name")).alias("corridor_key"),
        seg.alias("asset_a_code"),
        F.when(bal > 9000, F.lower("c_name")).otherwise(F.concat(F.lit("G"), F.lpad(F.col("c_custkey").cast("string"), 55, "0"))).alias("asset_a_issuer"),
        F.when(bal > 8500, F.concat(seg, F.lit("_TOO_LONG_CODE"))).otherwise(seg).alias("asset_b_code"),
        F.concat(F.lit("M"), F.lpad(F.col("c_nationkey").cast("string"), 68, "0")).alias("asset_b_issuer"),
        (bal / 80).alias("success_rate"),
        F.when(bal > 0, bal / 100).alias("health_score"),
    )


@query("validate_corridors", f"{_VC} SELECT id, reasons FROM v WHERE reasons <> ''")
def validate_corridors(spark, sf):
    bad = q.quarantined(q.validate_corridors(corridor_records(spark, sf)))
    return bad.select("id", F.array_join("reasons", ",").alias("reasons"))


@query("validation_reason_counts", f"{_VC}, x AS (SELECT unnest(string_split(reasons, ',')) AS r FROM v WHERE reasons <> '') SELECT split_part(r, ':', 1) AS error_type, count(*) AS count FROM x GROUP BY 1")
def validation_reason_counts(spark, sf):
    return q.reason_counts(q.validate_corridors(corridor_records(spark, sf)))


_VA = """WITH r AS (SELECT c_custkey AS id, 'A' || CAST(floor(c_acctbal) AS BIGINT) AS anchor_id, c_name AS anchor_name, c_acctbal / 90 AS reliability_score,
    c_nationkey - 2 AS total_assets, c_acctbal AS total_volume_usd, CASE WHEN c_nationkey < 8 THEN 'Red' WHEN c_nationkey < 16 THEN 'Green' ELSE 'Blue' END AS status FROM customer),
  n AS (SELECT *, count(*) OVER (PARTITION BY anchor_id) AS c FROM r),
  v AS (SELECT id, concat_ws(',', CASE WHEN reliability_score < 0 OR reliability_score > 100 THEN 'OutOfRange:reliability_score' END,
    CASE WHEN total_assets < 0 THEN 'OutOfRange:total_assets' END, CASE WHEN total_volume_usd < 0 THEN 'OutOfRange:total_volume_usd' END,
    CASE WHEN status = 'Blue' THEN 'InvalidFormat:status' END, CASE WHEN c > 1 THEN 'DuplicateAnchorId:anchor_id' END) AS reasons FROM n)"""


@query("validate_anchors", f"{_VA} SELECT id, reasons FROM v WHERE reasons <> ''")
def validate_anchors(spark, sf):
    bal, nation = F.col("c_acctbal"), F.col("c_nationkey")
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("A"), F.floor(bal).cast("string")).alias("anchor_id"),
        F.col("c_name").alias("anchor_name"),
        (bal / 90).alias("reliability_score"),
        *[F.lit(50.0).alias(s) for s in q.ANCHOR_SCORES[1:]],
        (nation - 2).alias("total_assets"),
        bal.alias("total_volume_usd"),
        F.when(nation < 8, "Red").when(nation < 16, "Green").otherwise("Blue").alias("status"),
        F.lit("2025-06-18T10:30:00Z").alias("timestamp"),
    )
    return q.quarantined(q.validate_anchors(rows)).select("id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "validation_health",
    f"""SELECT count(*) FILTER (ts > {EVENTS_AS_OF_SQL} - INTERVAL 24 HOUR AND ts <= {EVENTS_AS_OF_SQL} AND event_type = 'error') AS failed_records_24h,
    max(ts) AS last_validation_run, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 6) AS validation_pass_rate FROM events""",
)
def validation_health(spark, sf):
    results = table(spark, sf, "events").select(F.col("ts").alias("validated_at"), (F.col("event_type") != "error").alias("passed"))
    return rounded(q.validation_health(results, EVENTS_AS_OF), validation_pass_rate=6)


@query(
    "network_violations",
    f"""WITH {PAYMENTS} SELECT 'payments' AS table_name, count(*) AS rows, count(*) FILTER (network NOT IN ('mainnet', 'testnet', 'futurenet')) AS violations FROM payments
    UNION ALL SELECT 'orders', count(*), count(*) FILTER (o_orderstatus = 'P') FROM orders""",
)
def network_violations(spark, sf):
    status = F.col("o_orderstatus")
    orders = table(spark, sf, "orders").select(F.when(status == "O", "mainnet").when(status == "F", "testnet").alias("Network"))
    return q.network_violations({"payments": payments(spark, sf, "network"), "orders": orders})


@query("read_network", f"WITH {PAYMENTS} SELECT payment_id, amount_usd FROM payments WHERE network = 'mainnet'")
def read_network(spark, sf):
    return q.read_network(payments(spark, sf, "payment_id", "network", "amount_usd"), "mainnet").drop("network")


# Typed amounts: prices as people type them.
_AMOUNTS = """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice::VARCHAR WHEN o_orderpriority LIKE '2%' THEN '-' || o_totalprice
    WHEN o_orderpriority LIKE '3%' THEN o_totalprice || '12345678' WHEN o_orderpriority LIKE '4%' THEN '9999999' || CAST(floor(o_totalprice) AS BIGINT) || '000000' ELSE 'abc' END AS amount FROM orders)"""


@query(
    "validate_amount",
    f"""{_AMOUNTS} SELECT id, CASE WHEN try_cast(amount AS DOUBLE) IS NULL OR try_cast(amount AS DOUBLE) <= 0 THEN 'NotPositive' WHEN try_cast(amount AS DOUBLE) > 1e12 THEN 'TooLarge'
    WHEN length(split_part(amount, '.', 2)) > 7 THEN 'TooManyDecimals' END AS reason FROM t""",
)
def validate_amount(spark, sf):
    # format_string keeps plain decimals where a double cast would print an exponent
    plain = F.regexp_replace(F.format_string("%.2f", "o_totalprice"), r"0$", "")
    kind = F.substring("o_orderpriority", 1, 1)
    text = (
        F.when(kind == "1", plain)
        .when(kind == "2", F.concat(F.lit("-"), plain))
        .when(kind == "3", F.concat(plain, F.lit("12345678")))
        .when(kind == "4", F.concat(F.lit("9999999"), F.floor("o_totalprice").cast("string"), F.lit("000000")))
        .otherwise(F.lit("abc"))
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), amount_error(text).alias("reason"))


@query(
    "validate_address",
    """WITH t AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'MACHINERY' THEN ' G' || lpad(c_custkey::VARCHAR, 55, 'A') || ' ' WHEN 'BUILDING' THEN 'M' || lpad(c_custkey::VARCHAR, 68, '7')
      WHEN 'HOUSEHOLD' THEN 'G' || c_name WHEN 'FURNITURE' THEN 'M' || c_custkey ELSE c_name END AS a FROM customer)
    SELECT id, CASE WHEN regexp_matches(trim(a), '^G[A-Z0-9]{55}$') OR regexp_matches(trim(a), '^M[A-Z0-9]{68}$') THEN NULL
      WHEN trim(a) LIKE 'G%' THEN 'Invalid G-address: must be 56 characters (A-Z, 0-9).' WHEN trim(a) LIKE 'M%' THEN 'Invalid M-address: must be 69 characters (muxed account).'
      ELSE 'Invalid address: must start with G (account) or M (muxed account).' END AS error,
      CASE WHEN length(trim(a)) <= 16 THEN trim(a) ELSE left(trim(a), 8) || '...' || right(trim(a), 8) END AS short FROM t""",
)
def validate_address(spark, sf):
    seg, key = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    address = (
        F.when(seg == "MACHINERY", F.concat(F.lit(" G"), F.lpad(key, 55, "A"), F.lit(" ")))
        .when(seg == "BUILDING", F.concat(F.lit("M"), F.lpad(key, 68, "7")))
        .when(seg == "HOUSEHOLD", F.concat(F.lit("G"), F.col("c_name")))
        .when(seg == "FURNITURE", F.concat(F.lit("M"), key))
        .otherwise(F.col("c_name"))
    )
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), address_error(address).alias("error"), address_short(address).alias("short")
    )


@query(
    "validate_asset_code",
    """SELECT p_partkey AS id, CASE WHEN NOT regexp_matches(upper(p_type) || ':' || replace(p_brand, '#', ''), '^[A-Z0-9]+(:[A-Z0-9]+)?$') THEN 'InvalidAsset' END AS asset_error,
    CASE WHEN length(trim(substr(p_name, 1, p_size % 9))) = 0 THEN 'Required' WHEN length(trim(substr(p_name, 1, p_size % 9))) < 3 THEN 'InvalidLength' END AS receiver_error,
    length(p_type) <= 4 AS is_alphanum4, length(p_type) BETWEEN 5 AND 12 AS is_alphanum12 FROM part""",
)
def validate_asset_code(spark, sf):
    asset = F.concat_ws(":", F.upper("p_type"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
    receiver = F.substr(F.col("p_name"), F.lit(1), F.col("p_size") % 9)
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        asset_code_error(asset).alias("asset_error"),
        receiver_id_error(receiver).alias("receiver_error"),
        asset_type_matches(F.col("p_type"), "alphanum4").alias("is_alphanum4"),
        asset_type_matches(F.col("p_type"), "alphanum12").alias("is_alphanum12"),
    )


@query(
    "corridor_keys",
    """SELECT o_orderkey AS id, o_orderstatus || '-' || split_part(o_orderpriority, '-', 1) AS name, o_orderstatus || ':' || o_custkey || '->' || o_orderpriority || ':' || o_orderkey AS key FROM orders""",
)
def corridor_keys(spark, sf):
    text = lambda c: F.col(c).cast("string")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        corridor_name(F.concat_ws(":", "o_orderstatus", text("o_custkey")), F.concat_ws(":", F.split("o_orderpriority", "-")[0], text("o_custkey"))).alias("name"),
        corridor_key(F.col("o_orderstatus"), text("o_custkey"), F.col("o_orderpriority"), text("o_orderkey")).alias("key"),
    )


@query(
    "signed_payload",
    "SELECT o_orderkey AS id, printf('%016x', o_orderkey) || sha256(o_orderkey::VARCHAR) || sha256(o_custkey::VARCHAR) AS payload, sha256(o_orderkey::VARCHAR) AS hash FROM orders",
)
def signed_payload_query(spark, sf):
    first = F.unhex(F.sha2(F.col("o_orderkey").cast("string"), 256))
    second = F.unhex(F.sha2(F.col("o_custkey").cast("string"), 256))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.lower(F.hex(signed_payload(F.col("o_orderkey"), first, second))).alias("payload"),
        hex32(first).alias("hash"),
    )
