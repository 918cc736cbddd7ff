"""Blocks of ordered scans under outliers, clusters and hot keys, and the scans against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from remitlens.operators import contract_events as ev
from remitlens.operators import scans


def orders(kind, n):
    rng = random.Random(1)
    return {
        "outlier": [*range(n - 1), 10**12],
        "negative outlier": [-(10**15), *range(n - 1)],
        "clusters": [rng.choice([0, 10**6, 10**9]) + rng.randrange(2000) for _ in range(n)],
        "geometric": [int(1.002**i) if i < 10_000 else i * 10**9 for i in range(n)],
        "even": list(range(n)),
    }[kind]


@pytest.mark.parametrize("kind", ["outlier", "negative outlier", "clusters", "geometric", "even"])
def test_blocks_are_filled_evenly(spark, kind):
    n, per_block = 40_000, 1000
    rows = [("hot" if i % 3 else f"k{i % 50}", x) for i, x in enumerate(orders(kind, n))]
    df = spark.createDataFrame(rows, "k string, x long").repartition(4)
    blocks = scans.quantile_blocks(df, "x", per_block).added(df, "b")
    sizes = [r["count"] for r in blocks.groupBy("b").count().collect()]
    assert len(sizes) > 20 and max(sizes) <= 3 * per_block
    bounds = blocks.groupBy("b").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("b").collect()
    assert all(a.high < b.low for a, b in zip(bounds, bounds[1:]))  # block numbers keep the order


def test_few_rows_and_nulls(spark):
    df = spark.createDataFrame([(1,), (None,), (10**12,)], "x long")
    assert {(r.x, r.b) for r in scans.quantile_blocks(df, "x").added(df, "b").collect()} == {(1, 0), (None, None), (10**12, 0)}
    none = df.where("false")
    assert scans.quantile_blocks(none, "x").added(none, "b").collect() == []


@pytest.mark.parametrize("kind", ["outlier", "clusters"])
def test_neighbours(spark, kind):
    rng = random.Random(5)
    values = {("a", x) for x in orders(kind, 3000)} | {(None, x) for x in orders("even", 40)} | {("b", 7), ("c", None)}
    df = spark.createDataFrame(rng.sample(sorted(values, key=repr), len(values)), "k string, x long").repartition(3)
    got = scans.neighbours(df, ["k"], "x", scans.quantile_blocks(df, "x", 100), "before", "after")
    own = {}
    for k, x in values:
        own.setdefault(k, []).append(x)
    expected = set()
    for k, xs in own.items():
        xs = sorted(xs, key=lambda x: (x is not None, x or 0))
        expected |= {(k, x, xs[i - 1] if i else None, xs[i + 1] if x is not None and i + 1 < len(xs) else None) for i, x in enumerate(xs)}
    assert {tuple(r) for r in got.collect()} == expected


def test_percentiles_of_counted_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None, "b"]), float(rng.randint(-50, 50)), rng.randint(1, 4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, n int")
    plain = df.withColumn("_", F.explode(F.sequence(F.lit(1), "n")))
    points = {"p50": 0.5, "p99": 0.99}
    weighted, each = (
        {tuple(r) for r in scans.exact_percentiles(x, ["k"], "v", points, weight=w).collect()} for x, w in ((df, "n"), (plain, None))
    )
    assert weighted == each
    own = sorted(v for k, v, n in rows for _ in range(n) if k is None)
    at = 0.5 * (len(own) - 1)
    median = own[int(at)] + (own[-int(-at // 1)] - own[int(at)]) * (at - int(at))
    assert {p50 for k, p50, _ in weighted if k is None} == {median}


def test_repeated_epoch_without_a_contract(spark):
    rows = [(None, 5, 1, 1), (None, 7, 2, 1), (None, 5, 3, 1), ("c", 5, 4, 1), ("c", 5, 5, 1), ("c", 4, 6, 1)]
    df = spark.createDataFrame(rows, "contract_id string, epoch long, arrival long, metric_count long").withColumn("paused", F.lit(False))
    got = {r.arrival: r.reason for r in ev.accept_epochs(df, check_duplicates=True).collect()}
    assert got == {1: None, 2: None, 3: "DuplicateEpoch", 4: None, 5: "DuplicateEpoch", 6: "EpochMonotonicityViolated"}
