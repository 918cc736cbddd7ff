"""Contract events: versioned normalisation, epoch acceptance, write fencing and metric diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.operators.scans import ROWS_PER_BLOCK, neighbours, previous_max, previous_row, quantile_blocks

# The event topic and the fields of each schema version, in check order.
SNAPSHOT_TOPIC = "snapshot_submitted"
V1_FIELDS = ["epoch", "schema_version", "snapshot_hash", "source_data_hash", "submitted_at", "submitter"]
V2_FIELDS = [
    "epoch", "schema_version", "snapshot_hash", "snapshot_size_bytes", "source_data_hash", "submitted_at", "submitter",
]


def _error(code: str, detail: Column | str = "") -> Column:
    text = F.lit(detail) if isinstance(detail, str) else F.coalesce(detail, F.lit(""))
    return F.struct(F.lit(code).alias("code"), text.alias("detail"))


def _names(fields: list[str]) -> Column:
    return F.array(*[F.lit(f) for f in fields])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A generator over a one-element array keeps the optimizer from copying the
    expressions into every later use, which matters for array scans.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


# Codes of entries whose key is no symbol, or has no text; no key starts like that.
_BAD_KIND, _BAD_TEXT = "\0kind", "\0text"


def _at(code: str) -> Column:
    """1-based position of the first entry of that name or code, 0 when there is none."""
    return F.coalesce(F.array_position("_codes", F.lit(code)), F.lit(0))


def _first_entry(name: str) -> Column:
    return F.get("data", (_at(name) - 1).cast("int"))


def _unsigned(text: Column) -> Column:
    """A 64-bit unsigned integer as decimal(20,0), null outside its range."""
    value = text.try_cast("decimal(20,0)")
    return F.when((value >= 0) & (value <= F.lit(str(2**64 - 1)).cast("decimal(20,0)")), value)


def _wrong_type(name: str, kind: str, extra: Column | None = None) -> Column:
    ok = F.coalesce(F.col(f"_{name}")["val_kind"] == kind, F.lit(False))
    if extra is not None:
        ok = ok & F.coalesce(extra, F.lit(False))
    return F.when(~ok, _error("InvalidFieldType", name))


def _hash_error(name: str) -> Column:
    return _wrong_type(name, "bytes", F.col(f"_{name}")["val"].rlike("^[0-9a-fA-F]{64}$"))


def _entry_errors() -> Column:
    """Errors of the entries in data order: bad key, repeated key, unexpected key."""

    def check(entry, index):
        return (
            F.when(entry["key_kind"] != "symbol", _error("InvalidFieldNameType"))
            .when(entry["key"].isNull(), _error("InvalidFieldNameEncoding"))
            .when(F.array_position(F.col("_codes"), entry["key"]) <= index, _error("DuplicateField", entry["key"]))
            .when(~F.array_contains(F.col("_expected"), entry["key"]), _error("UnexpectedField", entry["key"]))
        )

    # most events have no such entry, which whole-array functions tell without looking at one entry at a time
    clean = (
        (_at(_BAD_KIND) == 0) & (_at(_BAD_TEXT) == 0) & (F.size(F.array_distinct("_codes")) == F.size("_codes"))
        & (F.size(F.array_except("_codes", "_expected")) == 0)
    )
    return F.when(~clean, F.get(F.array_compact(F.transform("data", check)), F.lit(0)))


def decode_snapshot_events(events: DataFrame) -> DataFrame:
    """Adds ``error`` (first failing check, null when valid) and the normalised columns.

    The checks form one ordered coalesce over the envelope, so the first error
    wins exactly as in a sequential decoder, without leaving the JVM. The
    entries of the payload are looked up once per row, before the checks.
    """
    topic, number = F.get("topics", F.lit(0)), F.col("_number")
    # the one pass over the entries; every later look-up is an array search by name
    code = lambda e: F.when(F.coalesce(e["key_kind"], F.lit("")) != "symbol", F.lit(_BAD_KIND)).otherwise(F.coalesce(e["key"], F.lit(_BAD_TEXT)))
    found = once(events, _codes=F.transform("data", code))
    found = once(
        found,
        _version_at=_at("schema_version"), _bad_key_at=_at(_BAD_KIND), _bad_text_at=_at(_BAD_TEXT),
        **{f"_{name}": _first_entry(name) for name in V2_FIELDS},
    )
    version = F.col("_schema_version")
    found = once(
        found,
        _number=version["val"].try_cast("bigint"),
        _expected=F.when(version["val"].try_cast("bigint") == 2, _names(V2_FIELDS)).otherwise(_names(V1_FIELDS)),
    )
    version_at, bad_key_at, bad_text_at = F.col("_version_at"), F.col("_bad_key_at"), F.col("_bad_text_at")

    def met_first(position: Column) -> Column:
        return (position > 0) & ((version_at == 0) | (position < version_at))

    missing = F.get(F.array_except("_expected", "_codes"), F.lit(0))
    too_big = [
        F.when(_unsigned(F.col(f"_{name}")["val"]).isNull(), _error("ValueOutOfRange", name))
        for name in ("epoch", "submitted_at")
    ]
    error = F.coalesce(
        F.when(F.col("type") != "contract", _error("UnsupportedEventType", F.col("type"))),
        F.when(F.col("contract_id").isNull(), _error("MissingContractId")),
        F.when(F.size("topics") != 1, _error("InvalidTopicCount", F.size("topics").cast("string"))),
        F.when(topic["kind"] != "symbol", _error("InvalidTopicType")),
        F.when(topic["value"].isNull(), _error("InvalidTopicEncoding")),
        F.when((F.col("data_kind") != "map") | F.col("data").isNull(), _error("InvalidEventData")),
        F.when(topic["value"] != SNAPSHOT_TOPIC, _error("UnsupportedTopic", topic["value"])),
        F.when(met_first(bad_key_at) & ~(met_first(bad_text_at) & (bad_text_at < bad_key_at)), _error("InvalidFieldNameType")),
        F.when(met_first(bad_text_at), _error("InvalidFieldNameEncoding")),
        F.when(version_at == 0, _error("MissingField", "schema_version")),
        F.when(version["val_kind"] != "u32", _error("InvalidFieldType", "schema_version")),
        F.when(~F.coalesce(number.isin(1, 2), F.lit(False)), _error("UnsupportedSchemaVersion", version["val"])),
        _entry_errors(),
        F.when(missing.isNotNull(), _error("MissingField", missing)),
        F.when(number == 2, _wrong_type("snapshot_size_bytes", "u64")),
        _wrong_type("epoch", "u64"),
        _hash_error("snapshot_hash"),
        _hash_error("source_data_hash"),
        _wrong_type("submitted_at", "u64"),
        _wrong_type("submitter", "address"),
        *too_big,
    )
    decoded = once(
        found,
        error=error,
        epoch=_unsigned(F.col("_epoch")["val"]),
        snapshot_hash=F.lower(F.col("_snapshot_hash")["val"]),
        source_data_hash=F.lower(F.col("_source_data_hash")["val"]),
        submitted_at=_unsigned(F.col("_submitted_at")["val"]),
        submitter=F.col("_submitter")["val"],
    )
    return decoded.drop(*[c for c in decoded.columns if c.startswith("_")])


def normalized(decoded: DataFrame) -> DataFrame:
    """Valid events in their common form; both schema versions give the same columns."""
    return decoded.where(F.col("error").isNull()).select(
        "seq", "contract_id", "epoch", "snapshot_hash", "source_data_hash", "submitted_at", "submitter"
    )


def rejected(decoded: DataFrame) -> DataFrame:
    """Undecodable events with the code of their first error."""
    return decoded.where(F.col("error").isNotNull()).select(
        "seq", F.col("error.code").alias("error_code"), F.col("error.detail").alias("error_detail")
    )


def drop_fenced_writes(writes: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Keep a write unless its token is below the highest token written before to the resource.

    A rejected token is below the maximum anyway, so the running maximum over
    all writes equals the one over accepted writes.
    """
    scanned = previous_max(writes, ["resource"], ["seq"], "token", quantile_blocks(writes, "seq", rows_per_block), "_highest")
    return scanned.where(F.col("_highest").isNull() | (F.col("token") >= F.col("_highest"))).drop("_highest")


def accept_epochs(submissions: DataFrame, check_duplicates: bool = False, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adds ``reason`` (null = accepted) per contract in arrival order.

    Accepted epochs are the strict records of the valid submissions. With
    ``check_duplicates`` an epoch that was accepted before is reported as
    DuplicateEpoch, ahead of the monotonicity check.
    """
    basic = (
        F.when(F.coalesce("paused", F.lit(False)), F.lit("ContractPaused"))
        .when(F.col("epoch") == 0, F.lit("InvalidEpoch"))
        .when(F.col("metric_count") == 0, F.lit("EmptyMetrics"))
    )
    checked = submissions.withColumn("_basic", basic).withColumn("_epoch", F.when(F.col("_basic").isNull(), F.col("epoch")))
    scanned = previous_max(checked, ["contract_id"], ["arrival"], "_epoch", quantile_blocks(checked, "arrival", rows_per_block), "_last")
    too_old = F.col("epoch") <= F.col("_last")
    if check_duplicates:
        first = (
            scanned.where(F.col("_basic").isNull() & ~F.coalesce(too_old, F.lit(False)))
            .select("contract_id", "epoch", F.col("arrival").alias("_accepted_at"))
        )
        # as a struct, so that submissions without a contract meet their like
        scanned = _join_epochs(scanned, first, ["contract_id"], "left")
        again = F.col("_accepted_at") < F.col("arrival")
        reason = F.coalesce("_basic", F.when(again, F.lit("DuplicateEpoch")), F.when(too_old, F.lit("EpochMonotonicityViolated")))
        return scanned.withColumn("reason", reason).drop("_basic", "_epoch", "_last", "_accepted_at")
    reason = F.coalesce("_basic", F.when(too_old, F.lit("EpochMonotonicityViolated")))
    return scanned.withColumn("reason", reason).drop("_basic", "_epoch", "_last")


def previous_epochs(epochs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each epoch of a contract with its predecessor, 0 for the first.

    ``keys`` names the contract columns (``contract_id`` when the frame has it).
    """
    return _epoch_list(epochs, _contract_keys(epochs, keys)).drop("_next")


def _contract_keys(df: DataFrame, keys: list[str] | None) -> list[str]:
    return keys if keys is not None else [c for c in ("contract_id",) if c in df.columns]


def _epoch_list(epochs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, epoch, from_epoch, _next) with blocked scans, so that a long list is not one task."""
    distinct = epochs.select(*keys, "epoch").distinct()
    placed = neighbours(distinct, keys, "epoch", quantile_blocks(distinct, "epoch"), "_prev", "_next")
    return placed.select(*keys, "epoch", F.coalesce("_prev", F.lit(0)).alias("from_epoch"), "_next")


def _join_epochs(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on keys and epoch as one struct: null keys and null epochs meet their like."""
    at = F.struct(*keys, "epoch").alias("_at")
    return left.select("*", at).join(right.select(at, *[c for c in right.columns if c not in (*keys, "epoch")]), "_at", how).drop("_at")


def diff_metrics(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Added, removed and changed metrics between consecutive epochs of a contract.

    ``metrics`` holds (epoch, metric, value), and ``contract_id`` if there are
    several contracts; a metric is named once per epoch. Every row stands for the
    new side of its epoch and the old side of the next one, and one aggregation on
    (contract, epoch, metric) brings the sides together: a large epoch spreads
    over its metrics. Rows without a contract are a contract of their own; a null
    epoch has none before or after it, so all its metrics are added.
    """
    keys = _contract_keys(metrics, keys)
    placed = _join_epochs(metrics, _epoch_list(metrics, keys), keys, "inner")
    value = metrics.schema["value"].dataType
    none = F.lit(None).cast(value)
    new = F.struct(F.col("from_epoch"), F.col("epoch").alias("to_epoch"), F.lit(1).alias("n"), F.lit(0).alias("o"), F.col("value").alias("new_value"), none.alias("old_value"))
    old = F.struct(F.col("epoch").alias("from_epoch"), F.col("_next").alias("to_epoch"), F.lit(0).alias("n"), F.lit(1).alias("o"), none.alias("new_value"), F.col("value").alias("old_value"))
    sides = placed.select(*keys, "metric", F.inline(F.array(new, old))).where("n = 1 or to_epoch is not null")
    both = sides.groupBy(*keys, "from_epoch", "to_epoch", "metric").agg(
        F.max("n").alias("n"), F.max("o").alias("o"), F.max("old_value").alias("old_value"), F.max("new_value").alias("new_value")
    )
    kind = (
        F.when(F.col("o") == 0, F.lit("added"))
        .when(F.col("n") == 0, F.lit("removed"))
        .when(~F.col("old_value").eqNullSafe(F.col("new_value")), F.lit("changed"))
    )
    return both.withColumn("change", kind).where(F.col("change").isNotNull()).select(
        *keys, "from_epoch", "to_epoch", "metric", "change", "old_value", "new_value"
    )


def diff_receipts(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of added, removed and changed metrics per epoch, zeros included."""
    keys = _contract_keys(metrics, keys)
    counts = (
        diff_metrics(metrics, keys)
        .groupBy(*keys, F.col("to_epoch").alias("epoch"))
        .agg(
            F.count_if(F.col("change") == "added").alias("added"),
            F.count_if(F.col("change") == "removed").alias("removed"),
            F.count_if(F.col("change") == "changed").alias("changed"),
        )
    )
    zero = F.lit(0)
    return _join_epochs(previous_epochs(metrics, keys), counts, keys, "left").select(
        *keys, "epoch", "from_epoch", *[F.coalesce(c, zero).alias(c) for c in ("added", "removed", "changed")]
    )


def diff_maps(previous: Column, following: Column) -> Column:
    """Map of changed keys to (old, new) for two metric maps of one row."""
    zipped = F.map_zip_with(previous, following, lambda _, old, new: F.struct(old.alias("old"), new.alias("new")))
    return F.map_filter(zipped, lambda _, v: ~v["old"].eqNullSafe(v["new"]))


def query_events(
    events: DataFrame,
    contract_id: str | None = None,
    event_type: str | None = None,
    epoch: int | None = None,
    hash: str | None = None,
    ledger_range: tuple[int, int] | None = None,
    time_range: tuple | None = None,
    verification_status: str | None = None,
    order_by: str = "created_at_desc",
    limit: int | None = None,
    offset: int | None = None,
) -> DataFrame:
    """Conjunctive event query with six orderings; the default is newest first."""
    equal = {
        "contract_id": contract_id, "event_type": event_type, "epoch": epoch, "hash": hash,
        "verification_status": verification_status,
    }
    for column, value in equal.items():
        if value is not None:
            events = events.where(F.col(column) == value)
    if ledger_range:
        events = events.where(F.col("ledger").between(*ledger_range))
    if time_range:
        events = events.where(F.col("created_at").between(F.lit(time_range[0]), F.lit(time_range[1])))
    column, _, way = order_by.rpartition("_")
    key = F.col(column)
    events = events.orderBy(key.desc() if way == "desc" else key.asc(), F.col("id").desc() if way == "desc" else F.col("id").asc())
    if offset:
        events = events.offset(offset)
    return events.limit(limit) if limit is not None else events


def event_stats(events: DataFrame) -> DataFrame:
    status = F.col("verification_status")
    return events.agg(
        F.count("*").alias("total"),
        F.count_if(status == "verified").alias("verified"),
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status == "failed").alias("failed"),
    )


def verification_summary(events: DataFrame) -> DataFrame:
    """Latest epoch per contract with its status; a missing status is pending."""
    latest = events.groupBy("contract_id").agg(F.max_by(F.struct("*"), F.struct("epoch", "created_at", "id")).alias("r"))
    return latest.select(
        "contract_id",
        F.col("r.epoch").alias("epoch"),
        F.col("r.created_at").alias("created_at"),
        F.coalesce("r.verification_status", F.lit("pending")).alias("status"),
    )


def audit_trail(events: DataFrame, contract_id: str) -> DataFrame:
    return events.where(F.col("contract_id") == contract_id).orderBy(F.desc("epoch"), F.desc("created_at"), F.desc("id"))


def ledger_progress_check(ledgers: DataFrame, keys: list[str], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Consecutive ledgers that break progression, per key in arrival order."""
    from remitlens.operators.contract_state import progression_ok

    scanned = previous_row(ledgers, keys, ["seq"], ["ledger", "closed_at"], quantile_blocks(ledgers, "seq", rows_per_block), "_prev")
    ok = progression_ok(F.col("_prev.closed_at"), F.col("_prev.ledger"), F.col("closed_at"), F.col("ledger"))
    return scanned.where(F.col("_prev").isNotNull()).withColumn("valid", ok).drop("_prev")
