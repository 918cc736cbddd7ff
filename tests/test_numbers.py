"""Exact sums, rounding, blocked scans and percentiles against plain Python."""

import math
import random
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from remitlens.functions import numbers as n
from remitlens.operators import scans


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=40))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_exact_sum_does_not_depend_on_order(spark, values):
    total = lambda vs, parts: (
        spark.createDataFrame([(v,) for v in vs], "v double").repartition(parts).agg(n.exact_sum("v").alias("s")).first()["s"]
    )
    forward, backward = total(values, 1), total(values[::-1], 5)
    assert forward == backward
    assert forward == pytest.approx(float(sum(map(Fraction, values))), abs=1e-9 * len(values), rel=1e-12)


def test_exact_sum_of_nothing_is_null(spark):
    assert spark.createDataFrame([(None,)], "v double").agg(n.exact_sum("v").alias("s")).first()["s"] is None


@pytest.mark.parametrize(
    "values",
    [[1e19, 1.0], [-1e19, 3.0], [1e-13] * 7, [math.inf, 1.0], [-math.inf, 2.0], [math.nan, 1.0], [math.inf, -math.inf], [5e-324, 0.0], [1e308, 1e308],
     [float(2**52), 0.5], [-0.1, 0.1, -1e-20], [0.1] * 10, [None, 2.5]],
)
def test_exact_sum_is_the_ieee_sum(spark, values):
    got = spark.createDataFrame([(v,) for v in values], "v double").agg(n.exact_sum("v").alias("s")).first()["s"]
    given = [v for v in values if v is not None]
    want = math.fsum(given) if all(math.isfinite(v) and abs(v) < 1e300 for v in given) else sum(given)
    assert math.isnan(got) and math.isnan(want) or got == want or abs(got - want) <= math.ulp(want)


def test_exact_sum_keeps_a_hash_aggregate(spark):
    plan = spark.range(10).groupBy(F.col("id") % 2).agg(n.exact_sum(F.col("id").cast("double")))._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHash" not in plan


def test_canonical_numbers_read_back(spark):
    fixed = {1e-13: "1e-13", 1.5e-7: "1.5e-7", 1e19: "1e19", 1e15: "1000000000000000.0", 0.0001: "0.0001", 12.5: "12.5", -3.0: "-3.0", 1e26: "1e26", 0.1 + 0.2: "0.30000000000000004"}
    for value, text in fixed.items():
        assert one(spark, n.canonical_number(F.lit(value))) == text
    rng = random.Random(1)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-20, 20) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", n.canonical_number("v").alias("t")).collect()
    assert all(float(r["t"]) == r["v"] for r in rows)
    for odd in (math.nan, math.inf, None):
        assert one(spark, n.canonical_number(F.lit(odd).cast("double"))) == "null"


def test_js_rounding(spark):
    rows = [(-2.5, -2), (2.5, 3), (-2.6, -3), (0.5, 1), (-0.5, 0)]
    for value, expected in rows:
        assert one(spark, n.js_round(F.lit(value))) == expected


def test_number_text(spark):
    cases = {1.5e6: "1.5M", 2345.0: "2.3K", 12.0: "12", 7.25: "7.25"}
    for value, text in cases.items():
        assert one(spark, n.compact(F.lit(value))) == text
    assert one(spark, n.canonical_number(F.lit(10_000_000.0))) == "10000000.0"
    assert one(spark, n.canonical_number(F.lit(0.0))) == "0.0"
    assert one(spark, n.canonical_number(F.lit(0.0005))) == "0.0005"
    assert one(spark, n.compact_intl(F.lit(1234567.0))) == "1.2M"


def test_safe_division(spark):
    assert one(spark, n.safe_div(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, n.pct(F.lit(1), F.nullif(F.lit(0), F.lit(0)))) == 0.0


def test_scans_keep_null_keys_and_null_order_values(spark):
    rows = [("a", 1, 5), ("a", None, 9), (None, 1, 7), (None, 2, 3), (None, 3, 8), ("b", None, 1)]
    df = spark.createDataFrame(rows, "k string, seq int, v int")
    for size in (1, 2, 100):
        block = scans.even_block(df, "seq", size)
        got = sorted(((r["k"], r["seq"], r["m"]) for r in scans.previous_max(df, ["k"], ["seq"], "v", block, "m").collect()), key=repr)
        assert got == sorted([("a", None, None), ("a", 1, 9), (None, 1, None), (None, 2, 7), (None, 3, 7), ("b", None, None)], key=repr)
        sums = {(r["k"], r["seq"]): r["t"] for r in scans.running_sum(df, ["k"], ["seq"], "v", block, "t").collect()}
        assert sums == {("a", None): 9, ("a", 1): 14, (None, 1): 7, (None, 2): 10, (None, 3): 18, ("b", None): 1}
        two = {(r["k"], r["seq"]): (r["p"], r["q"]) for r in scans.previous_two(df, ["k"], ["seq"], "v", block, "p", "q").collect()}
        assert two == {("a", None): (None, None), ("a", 1): (9, None), (None, 1): (None, None), (None, 2): (7, None), (None, 3): (3, 7), ("b", None): (None, None)}
    got = {r["k"]: r["x"] for r in scans.exact_percentiles(df, ["k"], "v", {"x": 0.5}).collect()}
    assert got == {"a": 7.0, None: 7.0, "b": 1.0}


def test_blocks_follow_the_data(spark):
    sparse = spark.createDataFrame([(i * 10**9,) for i in range(100)], "seq long")
    assert sparse.select(scans.even_block(sparse, "seq", 10).alias("b")).distinct().count() == 11
    assert sparse.select(scans.even_block(sparse, "seq").alias("b")).distinct().count() == 2
    small = spark.createDataFrame([(i / 100_000,) for i in range(1001)], "v double")
    assert {r["x"] for r in scans.exact_percentiles(small, [], "v", {"x": 0.5}).collect()} == {0.005}


def _series(seed, size=400, keys=3):
    rng = random.Random(seed)
    # one key holds most of the rows
    return [(0 if rng.random() < 0.7 else rng.randrange(keys), i, rng.randrange(50)) for i in range(size)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_blocked_scans_equal_a_sequential_pass(spark, width):
    rows = _series(1)
    df = spark.createDataFrame(rows, "k int, seq bigint, v int")
    block = scans.number_block("seq", width)
    highest = {r["seq"]: r["m"] for r in scans.previous_max(df, ["k"], ["seq"], "v", block, "m").collect()}
    before = {r["seq"]: r["p"] for r in scans.previous_row(df, ["k"], ["seq"], ["v"], block, "p").collect()}
    totals = {r["seq"]: r["t"] for r in scans.running_sum(df, ["k"], ["seq"], "v", block, "t").collect()}
    top, last, total = {}, {}, {}
    for k, seq, v in rows:
        assert highest[seq] == top.get(k)
        assert (before[seq]["v"] if before[seq] else None) == last.get(k)
        total[k] = total.get(k, 0) + v
        assert totals[seq] == total[k]
        top[k] = max(top.get(k, v), v)
        last[k] = v


def test_global_rank_is_dense_over_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id % 10 AS score").repartition(7)
    got = scans.global_rank(df, [F.desc("score"), F.asc("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert [(r["score"], r["id"]) for r in got] == sorted(((i % 10, i) for i in range(1000)), key=lambda t: (-t[0], t[1]))


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 0.99, 1.0])
def test_exact_percentiles(spark, p):
    rng = random.Random(3)
    data = {"hot": [rng.choice([rng.uniform(-50, 5000), 7.0]) for _ in range(500)], "one": [3.5], "two": [1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r["k"]: r["x"] for r in scans.exact_percentiles(df, ["k"], "v", {"x": p}).collect()}
    for k, values in data.items():
        ordered = sorted(values)
        at = p * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert got[k] == pytest.approx(low + (high - low) * (at - math.floor(at)), abs=1e-9)
    whole = scans.exact_percentiles(df, [], "v", {"x": p}).first()["x"]
    everything = sorted(v for vs in data.values() for v in vs)
    assert everything[0] <= whole <= everything[-1]
