"""Notification filters, statistics, grouping, templates and batch updates."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The keys every distribution reports, and the built-in templates.
TYPES = ["success", "error", "warning", "info"]
PRIORITIES = ["low", "medium", "high", "critical"]
TEMPLATES = [
    ("payment-success", "success", "medium", "payments", "Payment Completed Successfully",
     "Payment of {{amount}} XLM to {{recipient}} was completed in {{duration}}s."),
    ("payment-failed", "error", "high", "payments", "Payment Failed",
     "Payment of {{amount}} XLM to {{recipient}} failed: {{reason}}"),
    ("low-liquidity", "warning", "high", "liquidity", "Low Liquidity Alert",
     "Liquidity pool {{pool}} has fallen below {{threshold}}% capacity."),
    ("system-alert", "warning", "critical", "system", "System Alert: {{alertType}}",
     "{{description}} - Action required: {{action}}"),
]


def filter_notifications(
    df: DataFrame,
    types: list[str] | None = None,
    priorities: list[str] | None = None,
    categories: list[str] | None = None,
    read_status: str = "all",
    date_range: tuple[datetime, datetime] | None = None,
    search: str | None = None,
) -> DataFrame:
    """Conjunctive filter; an empty list filters nothing, the date range is inclusive."""
    tests = [F.col(c).isin(v) for c, v in (("type", types), ("priority", priorities), ("category", categories)) if v]
    if read_status in ("read", "unread"):
        tests.append(F.col("read") if read_status == "read" else ~F.col("read"))
    if date_range:
        tests.append(F.col("ts").between(F.lit(date_range[0]), F.lit(date_range[1])))
    if search:
        term = search.lower()
        tests.append(F.lower("title").contains(term) | F.lower("message").contains(term))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def distribution(df: DataFrame) -> DataFrame:
    """Counts per type and priority (all fixed keys, zeros included) and per category."""
    fixed = [("type", TYPES), ("priority", PRIORITIES)]
    columns = [F.count_if(F.col(c) == key).alias(f"{c}_{key}") for c, keys in fixed for key in keys]
    rows = [
        F.struct(F.lit(c).alias("dimension"), F.lit(key).alias("key"), F.col(f"{c}_{key}").alias("count"))
        for c, keys in fixed
        for key in keys
    ]
    known = df.agg(*columns).select(F.inline(F.array(*rows)))
    categories = df.groupBy(F.col("category").alias("key")).agg(F.count("*").alias("count"))
    return known.unionByName(categories.select(F.lit("category").alias("dimension"), "key", "count"))


def totals(df: DataFrame) -> DataFrame:
    """Total, unread, read rate and mean minutes until read (null when nothing was read)."""
    read_at = F.col("metadata")["readAt"].try_cast("timestamp_ntz")
    answered = F.col("read") & read_at.isNotNull()
    minutes = F.timestamp_diff("SECOND", F.col("ts").cast("timestamp_ntz"), read_at) / 60.0
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("read")).alias("unread"),
        F.coalesce(F.try_divide(F.count_if("read") * 100.0, F.count("*")), F.lit(0.0)).alias("read_rate"),
        F.avg(F.when(answered, minutes)).alias("average_response_minutes"),
    )


def daily_stats(df: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Count and unread per day of the last ``days`` days, zeros included."""
    last = as_of.date()
    first = last - timedelta(days=days - 1)
    counted = (
        df.where(F.to_date("ts").between(F.lit(first), F.lit(last)))
        .groupBy(F.to_date("ts").alias("date"))
        .agg(F.count("*").alias("count"), F.count_if(~F.col("read")).alias("unread"))
    )
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date"))
    return spine.join(counted, "date", "left").select(
        "date", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("unread", F.lit(0)).alias("unread")
    )


def group_key() -> Column:
    """Template id when there is one (an empty one counts as none), else category-type."""
    template = F.nullif(F.col("metadata")["templateId"], F.lit(""))
    return F.coalesce(template, F.concat_ws("-", "category", "type"))


def group_related(df: DataFrame) -> DataFrame:
    return df.groupBy(group_key().alias("group")).agg(
        F.count("*").alias("count"), F.count_if(~F.col("read")).alias("unread"), F.max("ts").alias("latest")
    )


def age_group(as_of: datetime) -> Column:
    """Calendar groups for today and yesterday, then strict 7 and 30 day distances."""
    today = F.lit(as_of.date())
    day, ts = F.to_date("ts"), F.col("ts")
    return (
        F.when(day == today, F.lit("Today"))
        .when(day == F.date_sub(today, 1), F.lit("Yesterday"))
        .when(ts > F.lit(as_of - timedelta(days=7)), F.lit("Last 7 Days"))
        .when(ts > F.lit(as_of - timedelta(days=30)), F.lit("Last 30 Days"))
        .otherwise(F.lit("Older"))
    )


def history_group(as_of: datetime) -> Column:
    """The history list: today, yesterday, this week, then month and year."""
    today = F.lit(as_of.date())
    day = F.to_date("ts")
    return (
        F.when(day == today, F.lit("Today"))
        .when(day == F.date_sub(today, 1), F.lit("Yesterday"))
        .when(F.col("ts") >= F.lit(as_of - timedelta(days=7)), F.lit("This Week"))
        .otherwise(F.date_format("ts", "MMMM yyyy"))
    )


def group_by_age(df: DataFrame, as_of: datetime, by: str = "date") -> DataFrame:
    """Counts per age group, or per capitalised type or priority."""
    if by == "date":
        key = age_group(as_of)
    elif by == "history":
        key = history_group(as_of)
    else:
        key = F.concat(F.upper(F.substring(by, 1, 1)), F.expr(f"substring({by}, 2)"))
    return df.groupBy(key.alias("group")).agg(F.count("*").alias("count"))


def interpolate(template: Column, variables: Column) -> Column:
    """Replace every ``{{name}}`` in one pass. A missing or empty value leaves the
    placeholder, and a value that itself looks like a placeholder is not expanded."""
    parts = F.split(template, r"(?=\{\{\w+\}\})|(?<=\}\})")

    def fill(part):
        name = F.regexp_extract(part, r"^\{\{(\w+)\}\}$", 1)
        value = F.nullif(F.try_element_at(variables, name), F.lit(""))
        return F.when(name != "", F.coalesce(value, part)).otherwise(part)

    return F.array_join(F.transform(parts, fill), "")


def template_table(spark) -> DataFrame:
    return spark.createDataFrame(
        TEMPLATES, "template_id string, type string, priority string, category string, title_template string, message_template string"
    )


def render_templates(events: DataFrame, templates: DataFrame) -> DataFrame:
    """One notification per event whose template exists."""
    joined = events.join(templates, "template_id")
    return joined.select(
        "event_id",
        "template_id",
        "type",
        "priority",
        "category",
        interpolate(F.col("title_template"), F.col("variables")).alias("title"),
        interpolate(F.col("message_template"), F.col("variables")).alias("message"),
    )


def mark_read(df: DataFrame, ids: DataFrame, as_of: datetime) -> DataFrame:
    """Set the read flag and the read time of the listed notifications."""
    marked = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    joined = df.join(marked, "id", "left")
    stamp = F.create_map(F.lit("readAt"), F.lit(as_of.isoformat()))
    without = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != "readAt")
    return joined.withColumns(
        {
            "read": F.col("read") | F.coalesce("_hit", F.lit(False)),
            "metadata": F.when(F.col("_hit"), F.map_concat(without, stamp)).otherwise(F.col("metadata")),
        }
    ).drop("_hit")


def delete_batch(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_anti")


def csv_rows(df: DataFrame) -> DataFrame:
    """Columns of the notification export as text."""
    return df.select(
        F.col("id").cast("string").alias("ID"), F.col("type").alias("Type"), F.col("priority").alias("Priority"),
        F.col("category").alias("Category"), F.col("title").alias("Title"), F.col("message").alias("Message"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("Timestamp"), F.col("read").cast("string").alias("Read"),
    )
