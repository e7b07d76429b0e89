"""Offline oracle: the best that reuse could do for each target, and dataset totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import paired_outcome, unit_score
from ..functions.text import py_strip
from ..schemas import HARM

#: Columns that a report about targets must not hold, as they tell the winner.
HINDSIGHT = ("winning_action", "winning_experience_id", "winning_rank")


def per_target(rows: DataFrame, threshold: float = 0.5, labels: bool = False) -> DataFrame:
    """One row per target_query_id. labels adds the winning action for dataset totals; reports leave it out.

    Ties go to the cheaper action: direct, reuse, fresh. One shuffle by target, combined on the map side;
    the ranks list of a target is bounded by its candidates.
    """
    harm = paired_outcome(F.col("direct_score"), F.col("reuse_score"), F.lit(float(threshold))) == HARM
    agg = rows.groupBy("target_query_id").agg(
        F.min("memory_snapshot_id").alias("memory_snapshot_id"),
        F.count("*").alias("candidate_count"),
        F.sort_array(F.collect_list("candidate_rank")).alias("candidate_ranks_evaluated"),
        F.min("retrieval_query_count").alias("retrieval_query_count"),
        F.min("requested_top_k").alias("requested_top_k"),
        F.min("context_token_budget").alias("context_token_budget"),
        F.min("direct_score").alias("direct_score"),
        F.max("reuse_score").alias("candidate_set_oracle_reuse_score"),
        F.max("fresh_score").alias("fresh_score"),
        F.count_if(harm).alias("pair_harm_count"),
    )
    d, r, f = F.col("direct_score"), F.col("candidate_set_oracle_reuse_score"), F.col("fresh_score")
    best = F.greatest(d, r, f)  # nulls are passed over
    out = agg.withColumn("offline_policy_oracle_score", best).withColumns(
        {"reuse_gain_over_direct": r - d, "policy_gain_over_direct": F.col("offline_policy_oracle_score") - d, "policy_gain_over_reuse": F.col("offline_policy_oracle_score") - r}
    )
    if labels:
        return out.withColumn("winning_action", F.when(d == best, "direct").when(r == best, "reuse").otherwise("fresh"))
    return out.drop("pair_harm_count")


def summary(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of dataset totals, means, coverages and the zero-filled histogram of winning actions."""
    t = per_target(rows, threshold, labels=True)
    d, r = F.col("direct_score"), F.col("candidate_set_oracle_reuse_score")
    good = float(threshold)
    action = F.col("winning_action")
    base = t.agg(
        F.min("memory_snapshot_id").alias("memory_snapshot_id"),
        F.lit(good).alias("good_threshold"),
        F.count("*").alias("target_count"),
        F.sum("candidate_count").alias("candidate_count"),
        F.sum("pair_harm_count").alias("pair_harm_count"),
        F.count_if(r > d).alias("helpful_target_count"),
        F.count_if(r < d).alias("harmful_target_count"),
        F.count_if((d >= good) & (r < good)).alias("candidate_set_reuse_target_harm_count"),
        F.avg(d).alias("direct_mean"),
        F.avg(r).alias("candidate_set_oracle_reuse_mean"),
        F.avg("offline_policy_oracle_score").alias("offline_policy_oracle_mean"),
        *[F.count_if(action == a).alias(f"action_{a}") for a in ("direct", "reuse", "fresh")],
    )
    n, c = F.col("target_count"), F.col("candidate_count")
    return base.where("target_count > 0").withColumns(
        {
            "mean_candidate_count": c / n,
            "pair_harm_rate": F.col("pair_harm_count") / c,
            "helpful_coverage": F.col("helpful_target_count") / n,
            "harmful_coverage": F.col("harmful_target_count") / n,
            "candidate_set_reuse_target_harm_rate": F.col("candidate_set_reuse_target_harm_count") / n,
            "reuse_gain_over_direct": F.col("candidate_set_oracle_reuse_mean") - F.col("direct_mean"),
            "policy_gain_over_direct": F.col("offline_policy_oracle_mean") - F.col("direct_mean"),
            "policy_gain_over_reuse": F.col("offline_policy_oracle_mean") - F.col("candidate_set_oracle_reuse_mean"),
        }
    )


def row_violations(rows: DataFrame) -> DataFrame:
    """(rule, key): rows whose ids are blank, whose scores leave [0, 1] or whose counts aren't positive."""
    blank = lambda c: F.coalesce(py_strip(F.col(c)) == "", F.lit(True))
    least = lambda c: F.coalesce(F.col(c) < 1, F.lit(True))
    rules = [(blank(c), f"blank_{c}") for c in ("target_query_id", "experience_id", "memory_snapshot_id")]
    rules += [(~unit_score(F.col(c)), f"{c}_out_of_range") for c in ("direct_score", "reuse_score")]
    rules += [(F.col("fresh_score").isNotNull() & ~unit_score(F.col("fresh_score")), "fresh_score_out_of_range")]
    rules += [(least(c), f"{c}_not_positive") for c in ("candidate_rank", "retrieval_query_count", "requested_top_k", "context_token_budget")]
    key = F.concat_ws("/", "target_query_id", "experience_id")
    return rows.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))).alias("rule"), key.alias("key"))


def violations(rows: DataFrame) -> DataFrame:
    """(rule, key): broken rules of a candidate-set table. Empty when it is sound."""
    one = rows.agg(F.min("memory_snapshot_id").alias("a"), F.max("memory_snapshot_id").alias("z"), F.count("*").alias("n"))
    whole = one.select(F.explode(F.array_compact(F.array(F.when(F.col("n") == 0, "no_rows"), F.when(F.col("a") != F.col("z"), "several_memory_snapshots")))).alias("rule"), F.lit("*").alias("key"))
    pairs = rows.groupBy("target_query_id", "experience_id").count().where("count > 1").select(F.lit("duplicate_pair").alias("rule"), F.concat_ws("/", "target_query_id", "experience_id").alias("key"))
    differs = lambda c: F.min(c) != F.max(c)
    g = rows.groupBy("target_query_id").agg(
        differs("direct_score").alias("inconsistent_direct_score"),
        (differs("fresh_score") | ((F.count("fresh_score") != 0) & (F.count("fresh_score") != F.count("*")))).alias("inconsistent_fresh_score"),
        (differs("retrieval_query_count") | differs("requested_top_k") | differs("context_token_budget")).alias("inconsistent_budget"),
        (F.count_distinct("candidate_rank") != F.count("*")).alias("duplicate_rank"),
    )
    rules = ("inconsistent_direct_score", "inconsistent_fresh_score", "inconsistent_budget", "duplicate_rank")
    targets = g.select(F.explode(F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in rules]))).alias("rule"), F.col("target_query_id").alias("key"))
    return whole.union(pairs).union(targets).union(row_violations(rows))
