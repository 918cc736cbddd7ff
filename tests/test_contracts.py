"""Contract events, reconciliation and contract state on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from remitlens.errors import BadEvent, MissingNetworkColumn
from remitlens.operators import contract_events as ev
from remitlens.operators import contract_state as cs
from remitlens.operators import quality, reconcile
from remitlens.sources import sinks
from remitlens.sources.schemas import CONTRACT_EVENT

AA, BB = "aa" * 32, "bb" * 32


def fields(version, **changes):
    base = {
        "epoch": ("u64", "42"), "schema_version": ("u32", str(version)), "snapshot_hash": ("bytes", AA),
        "source_data_hash": ("bytes", BB), "submitted_at": ("u64", "1724512400"), "submitter": ("address", "GSUB"),
    }
    if version != 1:
        base["snapshot_size_bytes"] = ("u64", "8192")
    base.update(changes)
    return [("symbol", k, *v) for k, v in base.items() if v is not None]


def event(seq, data, type="contract", contract_id="C1", topics=(("symbol", "snapshot_submitted"),), data_kind="map"):
    return (seq, type, contract_id, list(topics), data_kind, data)


def decode(spark, events):
    return ev.decode_snapshot_events(spark.createDataFrame(events, CONTRACT_EVENT))


def test_both_versions_give_the_same_row(spark):
    rows = ev.normalized(decode(spark, [event(1, fields(1)), event(2, fields(2))])).orderBy("seq").collect()
    assert [r["epoch"] for r in rows] == [42, 42]
    assert rows[0][1:] == rows[1][1:]
    assert rows[0]["snapshot_hash"] == AA and rows[0]["submitted_at"] == 1724512400


CASES = {
    "UnsupportedEventType": event(0, fields(1), type="system"),
    "MissingContractId": event(0, fields(1), contract_id=None),
    "InvalidTopicCount": event(0, fields(1), topics=[]),
    "InvalidTopicType": event(0, fields(1), topics=[("string", "snapshot_submitted")]),
    "InvalidTopicEncoding": event(0, fields(1), topics=[("symbol", None)]),
    "InvalidEventData": event(0, fields(1), data_kind="vec"),
    "UnsupportedTopic": event(0, fields(1), topics=[("symbol", "other")]),
    "InvalidFieldNameType": event(0, [("u32", "1", "u64", "1"), *fields(1)]),
    "InvalidFieldNameEncoding": event(0, [("symbol", None, "u64", "1"), *fields(1)]),
    "UnsupportedSchemaVersion": event(0, fields(999)),
    "DuplicateField": event(0, [*fields(1), ("symbol", "epoch", "u64", "43")]),
    "UnexpectedField": event(0, fields(1, note=("string", "x"))),
    "MissingField": event(0, fields(1, submitter=None)),
    "InvalidFieldType": event(0, fields(1, epoch=("u32", "42"))),
    "ValueOutOfRange": event(0, fields(1, epoch=("u64", str(2**64)))),
}


def test_every_error_code(spark):
    events = [(i, *case[1:]) for i, case in enumerate(CASES.values())]
    got = {r["seq"]: r["error_code"] for r in ev.rejected(decode(spark, events)).collect()}
    assert [got.get(i) for i in range(len(CASES))] == list(CASES)


def test_first_error_wins(spark):
    cases = [
        (event(0, []), "MissingField", "schema_version"),  # an empty map fails at the version lookup
        (event(1, [("symbol", "x", "u64", "1"), *fields(1), ("symbol", "epoch", "u64", "1")]), "UnexpectedField", "x"),
        (event(2, [*fields(1), ("symbol", "epoch", "u64", "1"), ("symbol", "x", "u64", "1")]), "DuplicateField", "epoch"),
        (event(3, fields(2, epoch=("u32", "1"), snapshot_size_bytes=("u32", "1"))), "InvalidFieldType", "snapshot_size_bytes"),
        (event(4, fields(1, epoch=None, submitter=None)), "MissingField", "epoch"),
        (event(5, fields(1, schema_version=("u64", "1"))), "InvalidFieldType", "schema_version"),
        (event(6, [*fields(1), ("u32", "1", "u64", "1")]), "InvalidFieldNameType", ""),
    ]
    got = {r["seq"]: (r["error_code"], r["error_detail"]) for r in ev.rejected(decode(spark, [c[0] for c in cases])).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]


def test_failfast_keeps_earlier_events_and_fails(spark):
    decoded = decode(spark, [event(1, fields(1)), event(2, fields(999)), event(3, fields(2))])
    written = []
    with pytest.raises(BadEvent, match="event 2: UnsupportedSchemaVersion"):
        sinks.write_normalized_events(decoded, lambda good: written.extend(r["seq"] for r in good.collect()), None, "failfast")
    assert written == [1]


def test_both_sinks_share_the_outcome_without_its_envelope(spark, monkeypatch):
    decoded = decode(spark, [event(1, fields(1)), event(2, fields(999)), event(3, fields(2))])
    persisted, persist, seen = [], type(decoded).persist, {}
    monkeypatch.setattr(type(decoded), "persist", lambda df, *a: persisted.append(df.columns) or persist(df, *a))
    sinks.write_normalized_events(decoded, lambda good: seen.update(good=good.collect()), lambda bad: seen.update(bad=bad.collect()))
    assert [set(columns) for columns in persisted] == [{"error", *ev.normalized(decoded).columns}]
    assert sorted(r["seq"] for r in seen["good"]) == [1, 3]
    assert [tuple(r) for r in seen["bad"]] == [(2, "UnsupportedSchemaVersion", "999")]


def test_sink_failure_fails_the_batch(spark):
    def broken(_):
        raise RuntimeError("sink down")

    with pytest.raises(RuntimeError):
        sinks.write_normalized_events(decode(spark, [event(1, fields(1))]), broken, broken)


def test_older_token_after_a_newer_one_is_rejected(spark):
    rows = [("r", 1, 5), ("r", 2, 7), ("r", 3, 5), ("r", 4, 7), ("r", 5, 6), ("s", 1, 1)]
    df = spark.createDataFrame(rows, "resource string, seq bigint, token bigint")
    kept = sorted((r["resource"], r["seq"]) for r in ev.drop_fenced_writes(df, rows_per_block=2).collect())
    assert kept == [("r", 1), ("r", 2), ("r", 4), ("s", 1)]


def epochs(spark, rows):
    return spark.createDataFrame(rows, "epoch bigint, metric string, value bigint")


def test_sixty_four_epochs(spark):
    rows = [(e, m, v * e) for e in range(1, 65) for m, v in (("daa", 10), ("volume", 1000))]
    receipts = ev.diff_receipts(epochs(spark, rows)).orderBy("epoch").collect()
    assert tuple(receipts[0]) == (1, 0, 2, 0, 0)
    assert all(tuple(r) == (r["epoch"], r["epoch"] - 1, 0, 0, 2) for r in receipts[1:])


def test_diff_of_two_epochs(spark):
    rows = [(1, "daa", 10), (1, "volume", 100), (1, "gone", 1), (2, "daa", 11), (2, "volume", 100), (2, "new", 3)]
    got = {(r["to_epoch"], r["metric"]): (r["change"], r["old_value"], r["new_value"]) for r in ev.diff_metrics(epochs(spark, rows)).collect()}
    assert got[(2, "daa")] == ("changed", 10, 11)
    assert got[(2, "gone")] == ("removed", 1, None)
    assert got[(2, "new")] == ("added", None, 3)
    assert (2, "volume") not in got and got[(1, "daa")] == ("added", None, 10)


def test_diffs_keep_null_contracts_and_null_epochs(spark):
    rows = [(c, e, m, v) for c in (None, "C1") for e, m, v in ((1, "daa", 10), (1, "gone", 1), (2, "daa", 11), (2, "new", 3), (None, "lost", 7))]
    metrics = spark.createDataFrame(rows, "contract_id string, epoch bigint, metric string, value bigint")
    diffs = {tuple(r) for r in ev.diff_metrics(metrics).collect()}
    own = [(0, 1, "daa", "added", None, 10), (0, 1, "gone", "added", None, 1), (1, 2, "daa", "changed", 10, 11), (1, 2, "gone", "removed", 1, None),
           (1, 2, "new", "added", None, 3), (0, None, "lost", "added", None, 7)]
    assert diffs == {(c, *r) for c in (None, "C1") for r in own}
    receipts = {tuple(r) for r in ev.diff_receipts(metrics).collect()}
    assert receipts == {(c, *r) for c in (None, "C1") for r in ((1, 0, 2, 0, 0), (2, 1, 1, 1, 1), (None, 0, 1, 0, 0))}


def test_epoch_acceptance(spark):
    rows = [
        ("c", 1, 0, 2, False), ("c", 2, 5, 0, False), ("c", 3, 5, 2, True), ("c", 4, 5, 2, False), ("c", 5, 5, 2, False),
        ("c", 6, 3, 2, False), ("c", 7, 6, 2, False), ("d", 8, 1, 2, False),
    ]
    df = spark.createDataFrame(rows, "contract_id string, arrival bigint, epoch bigint, metric_count int, paused boolean")

    def reasons(**kw):
        return [r["reason"] for r in ev.accept_epochs(df, rows_per_block=2, **kw).orderBy("arrival").collect()]

    old = "EpochMonotonicityViolated"
    assert reasons() == ["InvalidEpoch", "EmptyMetrics", "ContractPaused", None, old, old, None, None]
    assert reasons(check_duplicates=True)[4:6] == ["DuplicateEpoch", old]


def hashes(spark, rows):
    return spark.createDataFrame([(p, bytes([a]) * 32, bytes([b]) * 32) for p, a, b in rows], "period bigint, snapshot_hash binary, source_data_hash binary")


def test_reconciliation_cases(spark):
    periods = spark.createDataFrame([(1,), (3,), (7,), (8,), (9,)], "period bigint")
    off = hashes(spark, [(1, 1, 2), (3, 7, 8), (7, 5, 6), (9, 1, 1)])
    on = hashes(spark, [(1, 9, 2), (8, 1, 1), (9, 1, 1)])
    found = reconcile.reconcile(periods, off, on)
    assert sorted((r["period"], r["kind"]) for r in found.collect()) == [
        (1, "SnapshotHashMismatch"), (3, "MissingOnChain"), (7, "MissingOnChain"), (8, "MissingOffChain"),
    ]
    assert {r["severity"] for r in reconcile.discrepancy_alerts(found).collect()} == {"Warning"}

    def submit(missing):
        return missing.select("period", F.when(F.col("period") == 7, F.lit("rpc down")).alias("error"))

    attempts, stored = reconcile.resubmit(periods, off, on, submit)
    assert sorted(r["period"] for r in attempts.collect()) == [3, 7]
    alerts = reconcile.resubmission_alerts(attempts).collect()
    assert [(a["period"], a["severity"], a["kind"]) for a in alerts] == [(7, "Critical", "MissingSubmissionResubmitFailed")]
    after = reconcile.reconcile(periods, off, stored)
    assert sorted((r["period"], r["kind"]) for r in after.collect()) == [
        (1, "SnapshotHashMismatch"), (7, "MissingOnChain"), (8, "MissingOffChain"),
    ]
    report = reconcile.reconciliation_report(periods, after, attempts).first()
    assert tuple(report) == (5, 3, 2, 2, 1)


def test_epoch_mismatch(spark):
    periods = spark.createDataFrame([(1,)], "period bigint")
    off = hashes(spark, [(1, 1, 1)])
    on = off.withColumn("record_period", F.lit(2).cast("bigint"))
    got = reconcile.reconcile(periods, off, on).first()
    assert tuple(got) == (1, "EpochMismatch", "period mismatch: off-chain=1, on-chain=2")


def test_regression_thresholds(spark):
    frame = lambda rows: spark.createDataFrame(rows, "name string, value double")
    base = frame([("a", 100.0), ("b", 100.0), ("z", 0.0)])
    gas = reconcile.check_regression(frame([("a", 120.0), ("b", 120.1), ("n", 1.0)]), base)
    assert {r["name"]: r["status"] for r in gas.collect()} == {"a": "OK", "b": "FAIL", "n": "NEW"}
    rps = reconcile.check_throughput(frame([("a", 90.0), ("b", 89.9), ("n", 1.0), ("z", 5.0)]), base)
    assert {r["name"]: r["status"] for r in rps.collect()} == {
        "a": "OK", "b": "REGRESSION", "n": "MISSING_BASELINE", "z": "MISSING_BASELINE",
    }


def test_escrow_boundaries(spark):
    states = [("a", "AwaitingDeposit", 10, None), ("b", "AwaitingBeneficiary", 10, None), ("c", "AwaitingRelease", 10, None),
              ("d", "Disputed", 10, "depositor"), ("e", "Disputed", 10, "beneficiary"), ("f", "Released", 10, None)]
    df = spark.createDataFrame(states, "id string, state string, deadline bigint, dispute_initiator string")
    before = cs.escrow_due(df, F.lit(9)).orderBy("id").collect()
    assert [r["action_allowed"] for r in before] == [True] * 5 + [False]
    assert {r["timeout_outcome"] for r in before} == {None}
    at = cs.escrow_due(df, F.lit(10)).orderBy("id").collect()
    assert [r["timeout_outcome"] for r in at] == ["Cancelled", "Refunded", "Released", "Released", "Refunded", None]


def test_timelock_rules(spark):
    rows = [
        (1, 100, 5, 100, 100, 5), (2, 100, 5, 101, 100, 5), (3, 100, 5, 200, 101, 5), (4, 100, 5, 200, 101, 7),
        (5, 100, 5, 200, 99, 6), (6, 100, 5, 200, 199, 6), (7, 100, 5, 200, 200, 6), (8, 100, 5, 200, 150, 4),
    ]
    df = spark.createDataFrame(rows, "id int, created_at bigint, created_ledger bigint, unlock_time bigint, now bigint, ledger bigint")
    bad = "InvalidLedgerProgression"
    assert [r["status"] for r in cs.timelock_due(df).orderBy("id").collect()] == [
        "InvalidUnlockTime", "NotUnlockedYet", bad, bad, bad, "NotUnlockedYet", "Executable", bad,
    ]


def test_swap_settlement(spark):
    offers = spark.createDataFrame(
        [("m", 1, 10, 100, False, False), ("m", 2, 10, 100, False, True), ("m", 3, 10, 100, True, False)],
        "maker string, offer_id int, amount_in bigint, min_output bigint, filled boolean, cancelled boolean",
    )
    tries = [("m", 1, 1, 99), ("m", 1, 2, 100), ("m", 1, 3, 50), ("m", 2, 1, 200), ("m", 3, 1, 200), ("m", 9, 1, 1)]
    df = spark.createDataFrame(tries, "maker string, offer_id int, seq int, output_amount bigint")
    got = cs.swap_settlement_check(offers, df, ["seq"]).orderBy("offer_id", "seq").collect()
    assert [r["result"] for r in got] == ["SlippageExceeded", "Settled", "AlreadyFilled", "Cancelled", "AlreadyFilled", "OfferNotFound"]


def test_approvals_of_strangers_do_not_count(spark):
    rows = [(1, ["a", "b", "c"], 2, ["a", "x"], False), (2, ["a", "b"], 2, ["b", "a"], False), (3, ["a"], 1, ["a"], True)]
    df = spark.createDataFrame(rows, "proposal_id int, owners array<string>, threshold int, approvals array<string>, executed boolean")
    got = cs.approvals_met(df).orderBy("proposal_id").collect()
    assert [(r["valid_approvals"], r["executable"]) for r in got] == [(1, False), (2, True), (1, False)]


def test_ttl_actions(spark):
    contracts = spark.createDataFrame(
        [("a", "A", 400_000, None), ("b", "B", 50_000, None), ("c", "C", None, None), ("d", "D", 150_000, "key"), ("e", "E", 100_000, None)],
        "address string, label string, remaining bigint, storage_key string",
    )
    policies = spark.createDataFrame([("d", 200_000, 600_000)], "address string, threshold bigint, extend_to bigint")
    got = {r["address"]: (r["label"], r["action"], r["extend_to"]) for r in cs.ttl_due(contracts, policies).collect()}
    assert got == {
        "a": ("A", "healthy", None), "b": ("B", "extend", 535_680), "c": ("C", "missing", None),
        "d": ("D:key", "extend", 600_000), "e": ("E", "healthy", None),
    }


def test_network_isolation(spark):
    rows = spark.createDataFrame(
        [("corridor_a", "testnet", 0.85, 100.0), ("corridor_b", "mainnet", 0.92, 220.0)],
        "corridor string, network string, reliability double, volume double",
    )
    assert [r["corridor"] for r in quality.read_network(rows, "mainnet").collect()] == ["corridor_b"]
    with pytest.raises(MissingNetworkColumn, match="corridor_metrics"):
        quality.require_network_column({"corridor_metrics": rows.drop("network")})
    quality.require_network_column({"x": rows.withColumnRenamed("network", "NETWORK")})
