"""Exact sums over the whole range of a double."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from remitlens.functions import accumulate
from remitlens.operators import snapshot
from remitlens.sources.schemas import RAW_SNAPSHOT_ROW


def wide(rng, n):
    """Doubles of every magnitude, subnormals and exact halves of the range included."""
    pick = [
        lambda: rng.uniform(-1000, 1000), lambda: math.ldexp(rng.uniform(-1, 1), rng.randint(-1070, 1000)), lambda: float(rng.randint(-9, 9)),
        lambda: math.ldexp(rng.getrandbits(53), rng.choice([-1074, -100, -72, 0, 40, 900])), lambda: 0.0, lambda: -0.0, lambda: 5e-324,
    ]
    return [rng.choice(pick)() for _ in range(n)]


def totals(df):
    out = accumulate.exact_totals(df, ["k"], ["v", "w"], {"n": (F.count("*"), F.sum)})
    return {r.k: (r.v, r.w, r.n) for r in out.collect()}


def near(got, exact):
    """Within one unit in the last place of the exact sum."""
    assert got == pytest.approx(float(exact), rel=2.3e-16, abs=5e-324)


def test_any_order_gives_the_exact_sum(spark):
    rng = random.Random(6)
    rows = [(i % 9, v, w) for i, (v, w) in enumerate(zip(wide(rng, 3000), wide(rng, 3000)))]
    # big values that cancel and leave a small one
    rows += [(90, 1e300, 2.0**53), (90, 1e-300, 3 * 2.0**52 + 3), (90, -1e300, 1.0)]
    rows += [(91, -5e-324, -(2.0**52)), (92, 1.5, None), (92, None, None), (93, 2.0**1023, -(2.0**1023)), (93, -1.0, 2.0**-1074)]
    schema = "k int, v double, w double"
    forward, backward = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::-1], schema)
    results = [totals(df) for df in (forward, backward, forward.repartition(11), backward.repartition(3, "v"))]
    assert all(r == results[0] for r in results)
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        v, w, n = results[0][k]
        assert n == len(own)
        for got, values in ((v, [r[1] for r in own]), (w, [r[2] for r in own])):
            values = [x for x in values if x is not None]
            assert (got is None) == (not values)
            if values:
                near(got, sum(map(Fraction, values)))


def test_special_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, inf, 1.0), (1, 2.0, nan), (2, inf, -inf), (2, -inf, 1e308), (None, 1e308, 4.0), (None, 1e308, -4.0)]
    got = totals(spark.createDataFrame(rows, "k int, v double, w double"))
    assert got[1][0] == inf and math.isnan(got[1][1]) and math.isnan(got[2][0]) and got[2][1] == -inf
    assert got[None] == (inf, 0.0, 2)
    assert totals(spark.createDataFrame([], "k int, v double, w double")) == {}


def test_payload_over_the_whole_range(spark):
    rng = random.Random(7)
    values = wide(rng, 1200)
    rows = [(i, f"c{i % 5}", ["b", "a"][i % 2], rng.random(), v, abs(v)) for i, v in enumerate(values)]
    forward, backward = (spark.createDataFrame(x, RAW_SNAPSHOT_ROW) for x in (rows, rows[::-1]))
    texts = set()
    for df in (forward, backward, forward.repartition(13), backward.repartition(3, "latency_ms")):
        texts.add("".join(r["value"] for r in snapshot.replay_payload(df, 0, 5000).orderBy("position").collect()))
    assert len(texts) == 1


def test_the_big_aggregate_is_hashed(spark):
    df = spark.createDataFrame([(1, "c", "s", 1.0, 1.0, 1.0)], RAW_SNAPSHOT_ROW)
    plan = snapshot.generate_snapshot(df)._jdf.queryExecution().executedPlan().toString()
    partial = [line for line in plan.splitlines() if "partial_count(reliability" in line]
    assert partial and all("HashAggregate" in line and "ObjectHash" not in line for line in partial)
