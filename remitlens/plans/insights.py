"""Generated sentences on anchors and governance."""

from datetime import datetime

from pyspark.sql import functions as F

from remitlens.operators import routing
from remitlens.plans import parties
from remitlens.plans.registry import query, rounded
from remitlens.plans.views import PAYMENTS
from remitlens.sources.tables import payments

_CUT = "DATE '1995-03-25'"


@query(
    "anchor_insights",
    f"""WITH {PAYMENTS}, f AS (SELECT anchor, asset, min(ts)::DATE AS first FROM payments GROUP BY 1, 2), n AS (SELECT anchor, first AS date, count(*) AS new_assets FROM f GROUP BY 1, 2),
    d AS (SELECT anchor, ts::DATE AS date, count(*) AS a, count(*) FILTER (successful) AS s FROM payments GROUP BY 1, 2),
    w AS (SELECT d.anchor, 100.0 * sum(s) FILTER (date > {_CUT}) / nullif(sum(a) FILTER (date > {_CUT}), 0) - 100.0 * sum(s) FILTER (date <= {_CUT}) / nullif(sum(a) FILTER (date <= {_CUT}), 0) AS change,
      CAST(coalesce(sum(new_assets) FILTER (date > {_CUT}), 0) AS BIGINT) AS new_assets FROM d LEFT JOIN n USING (anchor, date) WHERE date_diff('day', date, DATE '1995-04-01') BETWEEN 0 AND 13 GROUP BY 1)
    SELECT anchor, round(change, 6) AS change, new_assets, concat_ws('; ', anchor || ' reliability ' || CASE WHEN change > 0 THEN 'rose ' WHEN change < 0 THEN 'dropped ' ELSE 'changed ' END || printf('%.1f', round(abs(change), 1)) || '% this week',
      CASE WHEN new_assets > 0 THEN anchor || ' now supports ' || new_assets || ' new assets' END) AS sentence FROM w""",
)
def anchor_insights(spark, sf):
    rows = payments(spark, sf, "anchor", "asset", "ts", "successful")
    by_asset = rows.groupBy("anchor", "asset").agg(F.min("ts").alias("first"))
    new = by_asset.groupBy("anchor", F.to_date("first").alias("date")).agg(F.count("*").alias("new_assets"))
    daily = rows.groupBy("anchor", F.to_date("ts").alias("date")).agg(
        F.count("*").alias("attempts"), F.count_if("successful").alias("successes")
    )
    return rounded(routing.anchor_insights(daily.join(new, ["anchor", "date"], "left"), datetime(1995, 4, 1)), change=6)


@query(
    "governance_insights",
    f"""{parties._VOTES} SELECT proposal_id, 'Proposal ' || proposal_id || ' has ' || printf('%.1f', round(100.0 * votes_for / (votes_for + votes_against + votes_abstain), 1)) || '% support at ' || printf('%.1f', round(100.0 * voters / 1000, 1)) || '% turnout' AS sentence FROM c""",
)
def governance_insights(spark, sf):
    return routing.governance_insights(parties.vote_counts_frame(spark, sf), eligible=1000)
