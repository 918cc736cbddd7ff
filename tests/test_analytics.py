"""Rankings, comparison, activity, validation, redaction, notifications, routing, paging."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from remitlens.errors import InvalidCursor, InvalidFields
from remitlens.functions import addresses, bands, redaction, times
from remitlens.operators import anchors, corridors, governance, logs, notifications, paging, pools, rankings, routing, wallets
from remitlens.operators import alerts as al

ASSETS = [
    ("AQUA", "G1", 0.00234, 18.4, 4_120_000.0, 12_341), ("yXLM", "G2", 0.132, 9.7, 5_450_000.0, 2_108),
    ("USDC", "G3", 1.0, 0.1, 96_300_000.0, 640), ("XLM", "native", 0.1287, -3.2, 182_500_000.0, 3_954),
    ("NEWX", "G5", 0.0041, None, 12_800.0, 87),
]


def codes(df):
    return [r["asset_code"] for r in df.orderBy("rank").collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture
def assets(spark):
    return spark.createDataFrame(
        ASSETS, "asset_code string, asset_issuer string, price_usd double, change_24h_pct double, volume_24h_usd double, holder_count bigint"
    )


def test_movers(assets):
    assert codes(rankings.top_movers(assets)) == ["AQUA", "yXLM", "XLM", "USDC", "NEWX"]
    assert codes(rankings.top_movers(assets, "volume")) == ["XLM", "USDC", "yXLM", "AQUA", "NEWX"]
    assert codes(rankings.top_movers(assets, limit=2)) == ["AQUA", "yXLM"]
    assert codes(rankings.top_movers(assets, direction="losers")) == ["XLM"]
    assert codes(rankings.asset_rankings(assets, "holders"))[:4] == ["AQUA", "XLM", "yXLM", "USDC"]


def test_best_and_worst_corridor(spark):
    rows = [("USDC-XLM", 94.5, 487.0, 6_200_000.0, 850_000.0, 12.5, 94.0), ("EURC-PHP", 88.3, 520.0, 4_500_000.0, 620_000.0, 18.2, 85.0)]
    df = spark.createDataFrame(
        rows,
        "corridor string, success_rate double, average_latency_ms double, liquidity_depth_usd double, liquidity_volume_24h_usd double, average_slippage_bps double, health_score double",
    )
    got = corridors.best_worst(df).collect()
    assert {(r["corridor"], r["indicator"]) for r in got} == {("USDC-XLM", "best"), ("EURC-PHP", "worst")}
    assert {(r["corridor"], r["trend"]) for r in got} == {("USDC-XLM", "high"), ("EURC-PHP", "low")}
    assert {r["trend"] for r in corridors.best_worst(df.limit(1)).collect()} == {"stable"}  # no range


def activity(spark, offsets, as_of):
    return spark.createDataFrame([("w", as_of - timedelta(days=d), c) for d, c in offsets.items()], "wallet string, date date, count bigint")


def test_activity_calendar(spark):
    as_of = date(2024, 3, 6)
    a = activity(spark, {2: 3, 1: 5, 0: 2}, as_of)
    summary = wallets.activity_summary(a).first()
    assert (summary["total"], summary["active_days"], summary["mean_per_active_day"]) == (10, 3, 3.3)
    assert summary["busiest_day"] == as_of - timedelta(days=1)
    streak = lambda o: rankings.current_streak(activity(spark, o, as_of), "wallet", as_of).first()["streak"]
    assert streak({2: 1, 1: 1, 0: 1}) == 3 and streak({3: 4}) == 0 and streak({5: 1, 1: 1, 0: 1}) == 2
    grid = wallets.calendar_grid(a, as_of, "wallet")
    assert grid.count() % 7 == 0
    assert grid.agg(F.min("weekday"), F.max("weekday"), F.sum("count")).first() == (0, 6, 10)


def test_pool_totals(spark):
    rows = [("a", 9_374_512.5, 1_006_000.0, 3_018.0, 22.918, 3.374)]
    df = spark.createDataFrame(rows, "pool string, tvl_usd double, volume_24h_usd double, fees_24h_usd double, apy double, impermanent_loss_pct double")
    got = pools.pool_stats(df).first()
    assert (got["pools"], got["tvl_usd"]) == (1, 9_374_512.5)
    empty = pools.pool_stats(df.where("false")).first()
    assert (empty["pools"], empty["tvl_usd"], empty["average_apy"]) == (0, 0.0, 0.0)


def test_growth_without_a_base(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("b", 1, 4), ("b", 2, 5)], "k string, t int, n bigint")
    got = {r["k"]: (r["growth"], r["growth_pct"]) for r in rankings.growth(df, ["k"], "t", "n").collect()}
    assert got == {"a": (5, 0.0), "b": (1, 25.0)}


def test_amounts_and_addresses(spark):
    amounts = {"1": None, "0": "NotPositive", "": "NotPositive", "-3": "NotPositive", "abc": "NotPositive", "2000000000000": "TooLarge",
               "1.1234567": None, "1.12345678": "TooManyDecimals", "1.2.3": "TooManyDecimals", "12 USD": None}
    for text, reason in amounts.items():
        assert one(spark, addresses.amount_error(F.lit(text))) == reason, text
    assert one(spark, addresses.address_error(F.lit("G" + "A" * 55))) is None
    assert one(spark, addresses.address_error(F.lit(" M" + "7" * 68))) is None
    assert one(spark, addresses.address_error(F.lit("   "))) == "Address is required."
    assert one(spark, addresses.address_error(F.lit("Gabc"))) == addresses.G_ERROR
    assert one(spark, addresses.address_error(F.lit("X"))) == addresses.PREFIX_ERROR
    assert one(spark, addresses.address_short(F.lit("A" * 10 + "B" * 10))) == "A" * 8 + "..." + "B" * 8
    assert one(spark, addresses.address_short(F.lit("short"))) == "short"
    assert one(spark, addresses.asset_code_error(F.lit("usdc"))) == "InvalidAsset"
    assert one(spark, addresses.asset_code_error(F.lit("USDC:GBEZ"))) is None
    assert one(spark, F.hex(addresses.signed_payload(F.lit(1), F.lit(b"\x02" * 32), F.lit(b"\x03" * 32)))) == "00" * 7 + "01" + "02" * 32 + "03" * 32
    assert one(spark, addresses.hex32(F.lit(b"\x01" * 31))) is None


def test_bands(spark):
    checks = [
        (bands.health_status, [(69.9, "down"), (70, "degraded"), (90, "optimal")]),
        (bands.health_label, [(74.9, "Needs attention"), (75, "Good"), (90, "Excellent")]),
        (bands.il_severity, [(0.9, "low"), (1, "medium"), (5, "high")]),
        (bands.anchor_tier, [(84.9, "critical"), (85, "warning"), (95, "healthy")]),
        (bands.latency_heat, [(1000, "top"), (1001, "high"), (9000, "bottom")]),
    ]
    for fn, cases in checks:
        for value, name in cases:
            assert one(spark, fn(F.lit(float(value)))) == name
    assert one(spark, bands.vital_rating(F.lit("cls"), F.lit(0.25))) == "needs-improvement"
    assert one(spark, bands.vital_rating(F.lit("unknown"), F.lit(1e9))) == "good"


def test_redaction(spark):
    cases = {
        "account G" + "A" * 55: "account G****[REDACTED]",
        "seed S" + "B" * 55: "seed S****[REDACTED_SECRET]",
        "jwt eyJhbGci.eyJzdWI.sig_1": "jwt [REDACTED_JWT]",
        "k " + "a1" * 16: "k [REDACTED_KEY]",
        "mail joe.x@example.com!": "mail ****@[REDACTED]!",
        "call +1234567890123": "call +123****[REDACTED]",
        "card 1234-5678-9012-3456": "card ****-****-****-[REDACTED]",
        "plain text 42": "plain text 42",
    }
    for text, expected in cases.items():
        assert one(spark, redaction.redact_text(F.lit(text))) == expected
    assert one(spark, redaction.redact_text(F.lit("ssn 123-45-6789"), ssn=True)) == "ssn ***-**-[REDACTED]"
    words = " ".join(["word"] * 12)
    assert one(spark, redaction.redact_text(F.lit(words), mnemonics=True)) == "[12_WORD_MNEMONIC_REDACTED]"
    tree = spark.createDataFrame([({"token": {"a": 1}, "list": [{"note": "a@b.io", "secretKey": "x"}]}, None)], "t struct<token: struct<a: int>, list: array<struct<note: string, secretKey: string>>>, n string")
    row = redaction.redact_columns(tree).first()
    assert row["t"]["token"] == "[REDACTED]" and tuple(row["t"]["list"][0]) == ("****@[REDACTED]", "[REDACTED]") and row["n"] is None
    masked = one(spark, redaction.redact_map(F.create_map(F.lit("API_KEY"), F.lit("x"), F.lit("note"), F.lit("a@b.io"))))
    assert masked == {"API_KEY": "[REDACTED]", "note": "****@[REDACTED]"}
    df = spark.createDataFrame([(1, ("s", "keep"))], "id int, auth struct<token:string,user:string>")
    assert redaction.drop_sensitive_fields(df).schema["auth"].dataType.fieldNames() == ["user"]


def test_templates(spark):
    variables = F.create_map(F.lit("a"), F.lit("{{b}}"), F.lit("b"), F.lit("B"), F.lit("empty"), F.lit(""))
    text = "x {{a}} {{b}}{{b}} {{empty}} {{missing}} }} {{ a }}"
    assert one(spark, notifications.interpolate(F.lit(text), variables)) == "x {{b}} BB {{empty}} {{missing}} }} {{ a }}"


def test_prediction_rules(spark):
    rows = [("USDC", "XLM", 0.0, 10), ("USDC", "XLM", 0.0, 18), ("AAA", "BBB", 1e9, 3)]
    df = spark.createDataFrame(rows, "source_asset string, dest_asset string, amount double, hour int")
    got = routing.predict_success(df).collect()
    assert got[0]["success_probability"] == pytest.approx(0.969) and got[0]["risk_level"] == "low"
    assert [r["via_asset"] for r in got[0]["alternative_routes"]] == ["XLM"]
    assert got[1]["success_probability"] == pytest.approx(0.931)
    assert got[2]["success_probability"] == pytest.approx(0.8 * 0.85 * 0.98) and got[2]["risk_level"] == "medium"


def test_text_formats(spark):
    end = F.lit(datetime(2024, 1, 2))
    assert one(spark, times.relative_time(F.lit(datetime(2024, 1, 1, 23, 30)), end)) == "Less than 1h ago"
    assert one(spark, times.relative_time(F.lit(datetime(2023, 12, 30)), end)) == "3d ago"
    assert one(spark, times.time_left(F.lit(datetime(2024, 1, 3, 5)), end)) == "1d 5h left"
    assert one(spark, times.time_left(F.lit(datetime(2024, 1, 1)), end)) == "Ended"
    assert one(spark, times.format_duration(F.lit(90_000))) == "1.5m"
    assert times.time_range("7d", datetime(2024, 1, 8, 5, 6)) == (datetime(2024, 1, 1), datetime(2024, 1, 8, 5, 6))
    assert one(spark, times.week_start(F.lit(date(2024, 3, 6)))) == date(2024, 3, 3)


def test_deep_pages_equal_a_full_sort(spark):
    df = spark.range(0, 3000, 1, 6).selectExpr(
        "id", "if(id % 50 = 3, null, timestamp_ntz'2024-10-27 00:30:00' + make_dt_interval(0, 0, id * 7919 % 600)) AS at",
        "if(id % 3 = 0, 'hot', if(id % 7 = 0, null, concat('k', id % 40))) AS kind", "cast(id * 31 % 97 as double) AS x",
        "timestamp'2024-10-27 00:30:00' + make_dt_interval(0, 0, id % 300) AS zoned", "cast(id % 11 as decimal(9, 2)) AS d",
    )
    for order in (["kind desc", "at desc", "x", "id"], ["d", "zoned desc", "id desc"]):
        sorting = [F.desc(o.split()[0]) if o.endswith("desc") else F.asc(o) for o in order]
        full = [r["id"] for r in df.orderBy(*sorting).collect()]
        for start in (1490, 2995):
            got = paging.page_rows(df, order, start, 10, 3000, at_once=100, sample=400)
            assert [r["id"] for r in got.collect()] == full[start : start + 10], (order, start)
    # only a part of the rows is sorted for the page
    plan = paging.page_rows(df, ["id"], 1490, 10, 3000, at_once=100, sample=400)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan
    # rows equal in the whole order cannot be parted
    assert paging.page_rows(df, ["d"], 2000, 10, 3000, at_once=100, sample=400).select("d").distinct().count() <= 2
    assert paging.page_rows(df.where("false"), ["id"], 50, 10, 0, at_once=20).count() == 0
    for wrong in (["nothing"], ["id", "id desc"], ["id sideways"]):
        with pytest.raises(InvalidFields):
            paging.page_rows(df, wrong, 0, 1, 3000)


def test_paging(spark):
    df = spark.range(25).selectExpr("id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, id % 5) AS created_at")
    page = paging.paginate_offset(df, ["id"], 10, 20)
    assert (page.total, page.has_next, page.rows.count()) == (25, False, 5)
    last = paging.paginate_page(df, ["id"], page=3)
    assert (last.pages, last.has_next, [r["id"] for r in last.rows.collect()]) == (3, False, [20, 21, 22, 23, 24])
    assert paging.paginate_page(df.where("false"), ["id"]).pages == 1
    seen, cursor = [], None
    while True:
        rows, cursor = paging.paginate_cursor(df, 10, cursor)
        seen += [r["id"] for r in rows]
        if cursor is None:
            break
    assert sorted(seen) == list(range(25)) and len(seen) == 25
    with pytest.raises(InvalidCursor):
        paging.decode_cursor("not a cursor")
    with pytest.raises(InvalidFields) as error:
        paging.select_fields(df, ["id", "nope"])
    assert error.value.invalid == ["nope"] and "created_at" in error.value.allowed


def test_sort_of_text_is_left_alone(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "t string, n int")
    assert paging.sort_by(df, "t") is df
    assert [r["n"] for r in paging.sort_by(df, "n").collect()] == [1, 2]


def test_anchor_orders(spark):
    df = spark.createDataFrame([("x", "B", 3.0, 9.0), ("y", "a", 1.0, 5.0)], "anchor_id string, name string, failure_rate double, reliability_score double")
    ids = lambda d: [r["anchor_id"] for r in d.collect()]
    assert ids(paging.sort_anchors(df, "failure_rate")) == ["y", "x"]
    assert ids(paging.sort_anchors(df, "reliability")) == ["x", "y"]
    assert ids(paging.sort_anchor_table(df, "name", descending=False)) == ["y", "x"]


def test_anchor_without_transactions(spark):
    df = spark.createDataFrame([("a", 0, 0, None), ("b", 3, 2, 0.0)], "anchor string, total_transactions bigint, successful_transactions bigint, avg_settlement_time_ms double")
    got = {r["anchor"]: (r["success_rate"], r["reliability_score"]) for r in anchors.anchor_reliability(df).collect()}
    assert got == {"a": (0.0, 0.0), "b": (66.67, 76.67)}


def test_graph_rules(spark):
    a = spark.createDataFrame([("A1", "One", 0.0, "g"), ("A2", None, 90.0, "g"), ("U_I", "Clash", 80.0, "g")], "id string, name string, reliability_score double, status string")
    c = spark.createDataFrame(
        [("A1", "A9", "U", "I", None, 95.0, 1.0), ("A1", "A9", "X", "J", 5.0, None, 1.0), (None, "A9", "Y", "J", 5.0, 1.0, 1.0)],
        "source_anchor_id string, destination_anchor_id string, source_asset_code string, source_asset_issuer string, volume_usd double, success_rate double, liquidity_score double",
    )
    nodes = {r["id"]: (r["type"], r["val"]) for r in anchors.graph_nodes(a, c).collect()}
    assert nodes == {"A1": ("anchor", 50.0), "U_I": ("anchor", 80.0), "X_J": ("asset", 30.0)}
    links = anchors.link_health(anchors.graph_links(c)).collect()
    assert sorted((r["source"], r["target"], r["value"], r["health_band"]) for r in links) == [
        ("A1", "U_I", 0.0, "unknown"), ("A1", "X_J", 5.0, "unknown"), ("U_I", "A9", 0.0, "healthy"), ("X_J", "A9", 5.0, "unknown"),
    ]


def test_user_agents(spark):
    ua = "Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537 Edge/120"
    assert tuple(one(spark, logs.parse_client(F.lit(ua)))) == ("Chrome", "Windows", "Desktop")
    assert tuple(one(spark, logs.parse_client(F.lit("x Linux; Android 14 Mobile")))) == ("Unknown", "Linux", "Mobile")


def test_quest_paths_and_achievements(spark):
    visits = spark.createDataFrame([("u", "/liquidity-pools/1"), ("u", "/claimable-balances"), ("u", "/corridors"), ("v", "/other")], "user_id string, path string")
    done = governance.path_completions(visits)
    # the dashboard quest also lists the root path, so any other page completes it
    assert sorted(r["quest_id"] for r in done.collect()) == ["view-claimable-balances", "view-corridor", "view-dashboard", "view-liquidity-pools"]
    trail = [("w", "/sep6", 1), ("w", "/sep6", 2), ("w", "/sep6", 3), ("w", "/send-payment", 4), ("x", "/corridors", 1), ("x", "/corridors", 2)]
    trail = spark.createDataFrame(trail, "user_id string, path string, visited_at int")
    earlier = spark.createDataFrame([("x", "view-corridor"), ("x", "view-dashboard")], "user_id string, quest_id string")
    got = sorted((r["user_id"], r["quest_id"]) for r in governance.path_completions(trail, earlier).collect())
    assert got == [("w", "send-payment"), ("w", "view-dashboard"), ("w", "view-sep6")]
    scores = governance.quest_scores(done, governance.quest_table(spark))
    unlocked = {r["achievement"] for r in governance.achievements(scores).where("user_id = 'u'").collect()}
    assert unlocked == {"first-quest", "explorer-3", "defi-expert"}
    assert {r["user_id"]: r["rank"] for r in governance.leaderboard(scores).collect()} == {"u": 1, "v": 2}


def test_hold_needs_five_true_minutes(spark):
    start = datetime(2024, 1, 1)
    flags = [True] * 11 + [False] + [True] * 4
    rows = [("s", start + timedelta(seconds=30 * i), f) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "series string, evaluated_at timestamp_ntz, firing boolean")
    got = al.hold(df, ["series"], seconds=300, rows_per_block=2).collect()
    assert [(r["evaluated_at"], r["since"]) for r in got] == [(start + timedelta(seconds=300), start)]


def test_histogram_quantile(spark):
    df = spark.createDataFrame([("a", v) for v in (0.05, 0.2, 0.3, 0.9)] + [("b", 9.0)], "k string, s double")
    got = {r["k"]: r["quantile"] for r in al.histogram_quantile(df, ["k"], "s", [0.1, 0.5, 1.0], 0.5).collect()}
    assert got == {"a": pytest.approx(0.1 + 0.4 * 0.5), "b": 1.0}


def test_counter_reset(spark):
    start = datetime(2024, 1, 1)
    rows = [("c", start + timedelta(seconds=s), v) for s, v in ((0, 10), (10, 15), (20, 3), (30, 4))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value bigint")
    assert al.counter_rate(df, ["k"], ["ts"], "5 minutes", 300.0, rows_per_block=2).first()["rate"] == pytest.approx((5 + 3 + 1) / 300)


def test_sessions(spark):
    start = datetime(2024, 1, 1)
    rows = [(1, start + timedelta(minutes=m), i) for i, m in enumerate((0, 10, 39, 69, 200))] + [(2, start, 9)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, event_id bigint")
    got = logs.session_stats(df, rows_per_block=2).first()
    # user 1: 0-39, 69 (30 min later starts anew), 200; user 2: one event
    assert got["total_sessions"] == 4
    assert got["mean_duration_seconds"] == pytest.approx(39 * 60 / 4)
    assert got["bounce_rate"] == 75.0


def test_insight_sentences(spark):
    df = spark.createDataFrame(
        [("A", 55.04, 3, 1500.0, 1000.0, 60), ("B", None, -2, None, None, 10), ("C", 10.0, 0, 100.0, None, 80)],
        "asset_code string, largest_holder_pct double, holder_growth_30d int, transfer_volume_30d double, avg_transfer_volume double, total_trustlines int",
    )
    got = {r["asset_code"]: r["sentences"] for r in pools.insight_sentences(df).collect()}
    assert got["A"] == [
        "The largest single holder controls 55.0% of supply, indicating high concentration.",
        "Holder count grew by 3 over the past 30 days.",
        "30-day transfer volume (1.5K) is 50% above the historical average.",
    ]
    assert got["B"] == ["Trustline count changed by -2 over 30 days — sample size is small, so trends may not be representative."]
    assert got["C"][1:] == ["Holder count was flat over the past 30 days.", "30-day transfer volume: 100."]
