"""Rules over contract state tables: escrow, time locks, swaps, approvals and storage lifetime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default lifetime policy in ledgers.
TTL_THRESHOLD, TTL_EXTEND_TO = 100_000, 535_680
# State an escrow reaches when its deadline passes.
TIMEOUT_OUTCOME = {"AwaitingDeposit": "Cancelled", "AwaitingBeneficiary": "Refunded", "AwaitingRelease": "Released"}


def escrow_due(states: DataFrame, now: Column) -> DataFrame:
    """Participant action before the deadline, time-out outcome from the deadline on.

    A dispute goes against its initiator; terminal states have neither.
    """
    outcome = F.coalesce(*[F.when(F.col("state") == s, F.lit(o)) for s, o in TIMEOUT_OUTCOME.items()])
    disputed = F.when(F.col("dispute_initiator") == "depositor", F.lit("Released")).otherwise(F.lit("Refunded"))
    target = F.when(F.col("state") == "Disputed", disputed).otherwise(outcome)
    open_state = target.isNotNull()
    return states.withColumns(
        {
            "action_allowed": open_state & (now < F.col("deadline")),
            "timeout_outcome": F.when(open_state & (now >= F.col("deadline")), target),
        }
    )


def progression_ok(created_at: Column, created_ledger: Column, now: Column, ledger: Column) -> Column:
    """Neither ledger nor time goes back, time stands still within a ledger, and
    every elapsed ledger accounts for at least one second."""
    return (
        (ledger >= created_ledger)
        & (now >= created_at)
        & ((ledger != created_ledger) | (now == created_at))
        & ((now - created_at) >= (ledger - created_ledger))
    )


def timelock_due(transfers: DataFrame) -> DataFrame:
    """Status of a time-locked transfer: first failing check, else Executable."""
    ok = progression_ok(F.col("created_at"), F.col("created_ledger"), F.col("now"), F.col("ledger"))
    return transfers.withColumn(
        "status",
        F.when(F.col("unlock_time") <= F.col("created_at"), F.lit("InvalidUnlockTime"))
        .when(~ok, F.lit("InvalidLedgerProgression"))
        .when(F.col("now") < F.col("unlock_time"), F.lit("NotUnlockedYet"))
        .otherwise(F.lit("Executable")),
    )


def swap_settlement_check(offers: DataFrame, settlements: DataFrame, order: list[str]) -> DataFrame:
    """Result of every settlement attempt of an offer, in order.

    The first attempt that passes fills the offer; later ones find it filled.
    That first attempt is a map-side minimum per offer joined back.
    """
    seq = F.struct(*order)
    invalid_amount = (F.col("amount_in") <= 0) | (F.col("min_output") <= 0)
    joined = settlements.join(offers, ["maker", "offer_id"], "left").withColumn("_seq", seq)
    fits = (
        F.col("min_output").isNotNull() & ~invalid_amount & ~F.col("filled") & ~F.col("cancelled")
        & (F.col("output_amount") >= F.col("min_output"))
    )
    filling = joined.where(fits).groupBy("maker", "offer_id").agg(F.min("_seq").alias("_filled_at"))
    result = (
        F.when(F.col("min_output").isNull(), F.lit("OfferNotFound"))
        .when(invalid_amount, F.lit("InvalidAmount"))
        .when(F.col("filled") | (F.col("_seq") > F.col("_filled_at")), F.lit("AlreadyFilled"))
        .when(F.col("cancelled"), F.lit("Cancelled"))
        .when(F.col("output_amount") < F.col("min_output"), F.lit("SlippageExceeded"))
        .otherwise(F.lit("Settled"))
    )
    return joined.join(filling, ["maker", "offer_id"], "left").withColumn("result", result).drop("_seq", "_filled_at")


def approvals_met(proposals: DataFrame) -> DataFrame:
    """Approvals of snapshotted owners against the threshold, arrays in the proposal row."""
    valid = F.size(F.array_intersect("approvals", "owners"))
    return proposals.withColumns(
        {
            "valid_approvals": valid.cast("bigint"),
            "executable": (valid >= F.col("threshold")) & ~F.col("executed"),
        }
    )


def approvals_met_rows(proposals: DataFrame, approvals: DataFrame, owners: DataFrame) -> DataFrame:
    """The same with one row per approval and per owner."""
    valid = (
        approvals.select("proposal_id", F.col("approver").alias("owner"))
        .distinct()
        .join(owners.select("proposal_id", "owner"), ["proposal_id", "owner"], "left_semi")
        .groupBy("proposal_id")
        .agg(F.count("*").alias("valid_approvals"))
    )
    counted = proposals.join(valid, "proposal_id", "left").withColumn("valid_approvals", F.coalesce("valid_approvals", F.lit(0)))
    return counted.withColumn("executable", (F.col("valid_approvals") >= F.col("threshold")) & ~F.col("executed"))


def ttl_due(contracts: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """missing / extend / healthy per contract entry; a policy of the contract overrides the defaults."""
    if policies is not None:
        contracts = contracts.join(policies, "address", "left")
    else:
        contracts = contracts.withColumns({"threshold": F.lit(None).cast("bigint"), "extend_to": F.lit(None).cast("bigint")})
    threshold = F.coalesce("threshold", F.lit(TTL_THRESHOLD))
    label = F.concat_ws(":", "label", "storage_key") if "storage_key" in contracts.columns else F.col("label")
    action = (
        F.when(F.col("remaining").isNull(), F.lit("missing"))
        .when(F.col("remaining") < threshold, F.lit("extend"))
        .otherwise(F.lit("healthy"))
    )
    return contracts.select(
        "address",
        label.alias("label"),
        "remaining",
        action.alias("action"),
        F.when(action == "extend", F.coalesce("extend_to", F.lit(TTL_EXTEND_TO))).cast("bigint").alias("extend_to"),
    )


def ttl_metrics(checks: DataFrame) -> DataFrame:
    """Remaining lifetime and extend / error / skip counts per label.

    ``bump_ok`` says whether an extension succeeded; it is null when none was due.
    """
    due = F.col("action") == "extend"
    return checks.groupBy("label").agg(
        F.min("remaining").alias("remaining"),
        F.count_if(due & F.coalesce("bump_ok", F.lit(True))).alias("bumped"),
        F.count_if(due & ~F.coalesce("bump_ok", F.lit(True))).alias("bump_errors"),
        F.count_if(F.col("action") == "healthy").alias("skipped"),
    )
