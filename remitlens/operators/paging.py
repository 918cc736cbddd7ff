"""Sorting with a total order, field selection and three kinds of pagination."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitlens.errors import InvalidCursor, InvalidFields

# Page limits.
DEFAULT_CURSOR_LIMIT, MAX_CURSOR_LIMIT, DEFAULT_PAGE_SIZE = 50, 100, 10
#: Rows up to the end of a page that may be gathered for it.
ROWS_AT_ONCE = 100_000
# Rank of the notification priorities.
PRIORITY_ORDER = {"low": 0, "medium": 1, "high": 2, "critical": 3}


@dataclass(frozen=True)
class Page:
    """One page of rows with its metadata. ``total`` counts all matching rows."""

    rows: DataFrame
    total: int
    has_next: bool
    next_offset: int | None = None
    pages: int | None = None


def select_fields(df: DataFrame, fields: list[str] | None) -> DataFrame:
    """Sparse field selection; unknown names are rejected with the allowed ones."""
    if not fields:
        return df
    unknown = [f for f in fields if f not in df.columns]
    if unknown:
        raise InvalidFields(unknown, df.columns)
    return df.select(*fields)


def sort_by(df: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Numeric sort, ties by the other columns; a non-numeric key leaves the order alone."""
    if not isinstance(df.schema[key].dataType, T.NumericType):
        return df
    ties = [f.name for f in df.schema.fields if f.name != key and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return df.orderBy(F.col(key).asc() if ascending else F.col(key).desc(), *ties)


def sort_anchors(anchors: DataFrame, key: str = "reliability", descending: bool = True) -> DataFrame:
    """Card order: failure rate is reversed, its descending order lists the lowest first."""
    column = {"reliability": "reliability_score", "transactions": "total_transactions"}.get(key, key)
    down = descending if key != "failure_rate" else not descending
    return anchors.orderBy(F.desc(column) if down else F.asc(column), F.asc("anchor_id"))


def sort_anchor_table(anchors: DataFrame, field: str = "reliability_score", descending: bool = True) -> DataFrame:
    """Table order: plain direction, names compared in lower case."""
    known = ("name", "failure_rate", "total_transactions")
    key = F.lower("name") if field == "name" else F.col(field if field in known else "reliability_score")
    return anchors.orderBy(key.desc() if descending else key.asc(), F.asc("anchor_id"))


def sort_notifications(df: DataFrame, key: str = "timestamp", descending: bool = True) -> DataFrame:
    if key == "priority":
        column = F.coalesce(*[F.when(F.col("priority") == p, F.lit(n)) for p, n in PRIORITY_ORDER.items()])
    else:
        column = F.col("ts" if key == "timestamp" else key)
    return df.orderBy(column.desc() if descending else column.asc(), F.desc("ts"), F.asc("id"))


def cap_newest(df: DataFrame, n: int = 100, per: str | None = None) -> DataFrame:
    """Newest n rows overall, or per user."""
    if per is None:
        return df.orderBy(F.desc("ts"), F.desc("id")).limit(n)
    from remitlens.operators.rankings import last_n

    return last_n(df, [per], ["ts", "id"], n)


@dataclass(frozen=True)
class _Term:
    """One column of an order; nulls come first, or last in a falling order, as in ``orderBy``."""

    name: str
    falling: bool
    kind: T.DataType

    @property
    def sorting(self) -> Column:
        return F.desc(self.name) if self.falling else F.asc(self.name)

    @property
    def sent(self) -> Column:
        """The value in a form that keeps its meaning on the way to the driver and back."""
        col = F.col(self.name)
        if isinstance(self.kind, T.TimestampType):
            return F.unix_micros(col)
        return col.cast("string") if isinstance(self.kind, T.TimestampNTZType) else col

    def literal(self, value) -> Column:
        if isinstance(self.kind, T.TimestampType):
            return F.timestamp_micros(F.lit(value))
        return F.lit(bytes(value) if isinstance(value, bytearray) else value).cast(self.kind)

    def before(self, value) -> Column:
        col = F.col(self.name)
        if value is None:
            return col.isNotNull() if self.falling else F.lit(False)
        at = self.literal(value)
        return F.coalesce(col > at, F.lit(False)) if self.falling else F.coalesce(col < at, F.lit(True))

    def same(self, value) -> Column:
        return F.col(self.name).isNull() if value is None else F.col(self.name).eqNullSafe(self.literal(value))


def _terms(df: DataFrame, order: list[str]) -> list[_Term]:
    split = [(name, way.lower()) for name, _, way in (text.partition(" ") for text in order)]
    names = [name for name, _ in split]
    wrong = [f"{name} {way}" for name, way in split if way not in ("", "asc", "desc") or name not in df.columns or names.count(name) > 1]
    if wrong:
        raise InvalidFields(wrong, df.columns)
    return [_Term(name, way == "desc", df.schema[name].dataType) for name, way in split]


def _before(terms: list[_Term], cut: Row) -> Column:
    """Whether a row comes before ``cut`` in the order."""
    condition = F.lit(False)
    for i in reversed(range(len(terms))):
        condition = terms[i].before(cut[i]) | (terms[i].same(cut[i]) & condition)
    return condition


def page_rows(df: DataFrame, order: list[str], start: int, limit: int, total: int, at_once: int = ROWS_AT_ONCE, sample: int = 4096, seed: int = 7) -> DataFrame:
    """Rows ``start`` to ``start + limit`` of ``df`` in an order, without sorting what comes before them.

    Selection by sampled order statistics: keys of about ``sample`` rows (these reach
    the driver) give two cuts that should enclose the page, one map-side count says how
    many rows come before each, and only the rows between them are looked at in the
    next round. The counts are exact, so a sample that misses costs a round, never a
    row. It ends when at most ``at_once`` rows would have to be gathered for the page,
    or when the cuts no longer part the rows (rows equal in the whole order). ``order``
    holds column names, each with ``asc`` or ``desc`` after it or nothing.
    """
    terms = _terms(df, order)
    low, high, first, last = None, None, 0, total  # rows of the part are first..last in the order
    part = df
    while start + limit - first > at_once and last > first:
        size = last - first
        drawn = part.select(*[t.name for t in terms]).sample(min(1.0, sample / size), seed).orderBy(*[t.sorting for t in terms])
        drawn = drawn.select(*[t.sent.alias(t.name) for t in terms]).collect()
        if not drawn:
            break
        slack = 1 if size <= sample else 2 * len(drawn) ** 0.5 + 1  # four standard deviations of a rank in a sample
        places = ((start - first) / size * len(drawn) - slack, (min(start + limit, last) - first) / size * len(drawn) + slack)
        cuts = [drawn[max(0, min(len(drawn) - 1, int(p)))] for p in places]
        counts = part.agg(*[F.count_if(_before(terms, c)).alias(f"_n{i}") for i, c in enumerate(cuts)]).first()
        before = (first, last)
        if counts[0] and first + counts[0] <= start:
            low, first = cuts[0], first + counts[0]
        if counts[1] and before[0] + counts[1] >= min(start + limit, before[1]):
            high, last = cuts[1], before[0] + counts[1]
        if (first, last) == before:
            break
        part = df if low is None else df.where(~_before(terms, low))
        part = part if high is None else part.where(_before(terms, high))
        seed += 1
    return part.orderBy(*[t.sorting for t in terms]).offset(max(0, start - first)).limit(limit)


def _page(df: DataFrame, order: list, start: int, limit: int, total: int) -> DataFrame:
    if all(isinstance(o, str) for o in order):
        return page_rows(df, order, start, limit, total)
    return df.orderBy(*order).offset(start).limit(limit)


def paginate_offset(df: DataFrame, order: list, limit: int, offset: int = 0) -> Page:
    """``order`` as text (``"total desc"``) makes deep pages cheap; Column terms sort all rows up to the page."""
    total = df.count()
    following = offset + limit
    more = following < total
    return Page(_page(df, order, offset, limit, total), total, more, following if more else None)


def paginate_page(df: DataFrame, order: list, page: int = 1, size: int = DEFAULT_PAGE_SIZE) -> Page:
    """As ``paginate_offset``, by page number from 1."""
    total = df.count()
    pages = max(1, -(-total // size))
    return Page(_page(df, order, (page - 1) * size, size, total), total, page < pages, pages=pages)


def encode_cursor(created_at: datetime, row_id) -> str:
    return base64.b64encode(json.dumps({"created_at": created_at.isoformat(), "id": row_id}).encode()).decode()


def decode_cursor(cursor: str) -> tuple[datetime, object]:
    try:
        data = json.loads(base64.b64decode(cursor, validate=True))
        return datetime.fromisoformat(data["created_at"]), data["id"]
    except (ValueError, KeyError, TypeError) as exc:
        raise InvalidCursor(f"cursor {cursor!r} cannot be read") from exc


def paginate_cursor(df: DataFrame, limit: int = DEFAULT_CURSOR_LIMIT, cursor: str | None = None) -> tuple[list, str | None]:
    """Newest first by (created_at, id). A page costs one filtered top-n, never an offset scan.

    Returns the page rows (at most 100) and the cursor of the next page.
    """
    limit = min(limit, MAX_CURSOR_LIMIT)
    rows = keyset_page(df, limit + 1, cursor).collect()
    page = rows[:limit]
    following = encode_cursor(page[-1]["created_at"], page[-1]["id"]) if len(rows) > limit else None
    return page, following


def keyset_page(df: DataFrame, limit: int, cursor: str | None = None) -> DataFrame:
    """Rows after the cursor, as a frame."""
    if cursor:
        created_at, row_id = decode_cursor(cursor)
        created, at = F.col("created_at"), F.lit(created_at)
        # the plain range predicate reaches the file scan, the tie-break runs after it
        df = df.where(created <= at).where((created < at) | (F.col("id") < F.lit(row_id)))
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
