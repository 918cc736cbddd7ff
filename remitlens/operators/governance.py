"""Proposals, votes, scheduled jobs and quests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from remitlens.functions.numbers import pct
from remitlens.operators.scans import global_rank

# Quests with their category, experience points and the pages that complete them.
QUESTS = [
    ("view-corridor", "exploration", 50, ["/corridors"]),
    ("view-anchor", "analysis", 75, ["/anchors"]),
    ("view-analytics", "analysis", 50, ["/analytics"]),
    ("view-trustlines", "network", 50, ["/trustlines"]),
    ("view-health", "network", 50, ["/health"]),
    ("view-liquidity-pools", "defi", 100, ["/liquidity-pools", "/liquidity"]),
    ("view-claimable-balances", "defi", 75, ["/claimable-balances"]),
    ("view-dashboard", "exploration", 25, ["/dashboard", "/"]),
    ("view-sep6", "education", 75, ["/sep6"]),
    ("send-payment", "education", 100, ["/send-payment"]),
]
# Achievements (id, counted quests, threshold).
ACHIEVEMENTS = [
    ("first-quest", "quests", 1),
    ("explorer-3", "quests", 3),
    ("master-5", "quests", 5),
    ("champion-10", "quests", 10),
    ("defi-expert", "explorer", 2),
]
# Job list order.
JOB_ORDER = {"critical": 0, "warning": 1, "healthy": 2, "unknown": 3}


def governance_summary(proposals: DataFrame) -> DataFrame:
    return proposals.agg(
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("total_votes"), F.lit(0)).alias("total_votes"),
    )


def vote_counts(votes: DataFrame) -> DataFrame:
    """Votes per choice and distinct voters of each proposal.

    One row per (proposal, voter) first, so a hot proposal is counted over its voters.
    """
    per_voter = votes.groupBy("proposal_id", "voter").agg(
        F.count_if(F.col("choice") == "for").alias("f"),
        F.count_if(F.col("choice") == "against").alias("a"),
        F.count_if(F.col("choice") == "abstain").alias("n"),
    )
    return per_voter.groupBy("proposal_id").agg(
        F.sum("f").alias("votes_for"),
        F.sum("a").alias("votes_against"),
        F.sum("n").alias("votes_abstain"),
        F.count("*").alias("voters"),
    )


def vote_breakdown(counts: DataFrame) -> DataFrame:
    total = F.col("votes_for") + F.col("votes_against") + F.col("votes_abstain")
    safe_total = F.nullif(total, F.lit(0))
    return counts.select(
        *counts.columns,
        total.alias("total_votes"),
        pct(F.col("votes_for"), safe_total).alias("for_pct"),
        pct(F.col("votes_against"), safe_total).alias("against_pct"),
        pct(F.col("votes_abstain"), safe_total).alias("abstain_pct"),
    )


def top_voters(votes: DataFrame, limit: int = 10) -> DataFrame:
    """Voters by number of proposals voted on."""
    return (
        votes.select("voter", "proposal_id")
        .distinct()
        .groupBy("voter")
        .agg(F.count("*").alias("proposals"))
        .orderBy(F.desc("proposals"), "voter")
        .limit(limit)
    )


def turnout(counts: DataFrame, eligible: int | None = None) -> DataFrame:
    votes = F.col("votes_for") + F.col("votes_against") + F.col("votes_abstain")
    share = pct(F.col("voters"), F.lit(eligible)) if eligible else F.lit(None).cast("double")
    return counts.select("proposal_id", "voters", votes.alias("votes"), share.alias("turnout_pct"))


def job_summary(jobs: DataFrame) -> DataFrame:
    executions, failures = F.coalesce(F.sum("executions"), F.lit(0)), F.coalesce(F.sum("failures"), F.lit(0))
    return jobs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if("active").alias("active_jobs"),
        F.count_if(F.col("health_status") == "healthy").alias("healthy"),
        F.count_if(F.col("health_status") == "warning").alias("warning"),
        F.count_if(F.col("health_status") == "critical").alias("critical"),
        executions.alias("executions"),
        failures.alias("failures"),
        pct(executions - failures, F.nullif(executions, F.lit(0))).alias("success_rate"),
    )


def job_list(jobs: DataFrame) -> DataFrame:
    order = F.coalesce(*[F.when(F.col("health_status") == s, F.lit(n)) for s, n in JOB_ORDER.items()])
    return jobs.orderBy(order, "name")


def quest_table(spark) -> DataFrame:
    return spark.createDataFrame([q[:3] for q in QUESTS], "quest_id string, category string, xp bigint")


def path_completions(visits: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Quests completed by page visits: (user_id, quest_id), in the order of ``visited_at``.

    A visit completes the first quest, in list order, that the user has not
    completed and one of whose paths starts the page path. ``done`` (user_id,
    quest_id) lists earlier completions. Of the visits that match the same quests
    only as many as there are such quests can complete anything, so each user
    keeps a bounded number of visits, and the rest never leaves its task.
    """
    found = F.array_compact(F.array(*[F.when(_any_prefix(paths), F.lit(quest)) for quest, _, _, paths in QUESTS]))
    order = ["visited_at", "path"] if "visited_at" in visits.columns else ["path"]
    matched = visits.select("user_id", F.struct(*order).alias("at"), found.alias("quests")).where(F.size("quests") > 0)
    nth = F.row_number().over(Window.partitionBy("user_id", "quests").orderBy("at"))
    few = matched.withColumn("nth", nth).where(F.col("nth") <= len(QUESTS))
    per_user = few.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("at", "quests"))).alias("visits"))
    nothing = F.array().cast("array<string>")
    before = nothing
    if done is not None:
        earlier = done.groupBy("user_id").agg(F.collect_set("quest_id").alias("before"))
        per_user = per_user.join(earlier, "user_id", "left")
        before = F.coalesce("before", nothing)

    def visit(completed, v):
        left = F.array_except(v["quests"], completed)
        return F.when(F.size(left) > 0, F.concat(completed, F.slice(left, 1, 1))).otherwise(completed)

    completed = F.aggregate("visits", before, visit)
    return per_user.select("user_id", F.explode(F.array_except(completed, before)).alias("quest_id"))


def _any_prefix(paths: list[str]):
    test = F.lit(False)
    for path in paths:
        test = test | F.col("path").startswith(path)
    return test


def quest_scores(progress: DataFrame, quests: DataFrame) -> DataFrame:
    """Experience, completed quests and defi quests per user; an unknown quest gives 0 points."""
    return (
        progress.join(quests, "quest_id", "left")
        .groupBy("user_id")
        .agg(
            F.coalesce(F.sum("xp"), F.lit(0)).alias("xp"),
            F.count("*").alias("completed"),
            F.count_if(F.col("category") == "defi").alias("defi_completed"),
        )
    )


def leaderboard(scores: DataFrame) -> DataFrame:
    """Rank of every user by experience, ties by user id, without a single-task sort."""
    return global_rank(scores.select("user_id", "xp", "completed"), [F.desc("xp"), F.asc("user_id")])


def achievements(scores: DataFrame) -> DataFrame:
    """Unlocked achievements, one row each."""
    unlocked = F.array_compact(
        F.array(
            *[
                F.when(F.col("completed" if kind == "quests" else "defi_completed") >= threshold, F.lit(name))
                for name, kind, threshold in ACHIEVEMENTS
            ]
        )
    )
    return scores.select("user_id", F.explode(unlocked).alias("achievement"))
