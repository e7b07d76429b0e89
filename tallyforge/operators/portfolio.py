"""Hot memory: decayed priority, top-k, hot / cold / expired partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import half_life_decay
from ..policies import PortfolioPolicy
from ..storage import written


def activity_violations(activities: DataFrame, experiences: DataFrame, current_step: int) -> DataFrame:
    """(rule, key): repeated or unknown experiences, negative steps, steps in the future."""
    dup = activities.groupBy("experience_id").count().where("count > 1").select(F.lit("duplicate_activity").alias("rule"), F.col("experience_id").alias("key"))
    unknown = activities.join(experiences.select("experience_id").distinct(), "experience_id", "left_anti").select(F.lit("unknown_experience"), "experience_id").distinct()
    v, u = F.col("last_validated_step"), F.col("last_used_step")
    rules = F.array_compact(
        F.array(
            F.when(F.coalesce(v < 0, F.lit(True)), "last_validated_step_invalid"), F.when(v > current_step, "last_validated_step_in_future"),
            F.when(u < 0, "last_used_step_invalid"), F.when(u > current_step, "last_used_step_in_future"),
        )
    )
    return dup.union(unknown).union(activities.select(F.explode(rules), "experience_id"))


def scores(records: DataFrame, activities: DataFrame, current_step: int, policy: PortfolioPolicy) -> DataFrame:
    """Scores of active records that have an activity.

    records: experience_id, state, benefit_rate, breakage_upper_bound. Age counts from the last validation;
    mere use doesn't refresh it.
    """
    base = F.col("benefit_rate") * (F.lit(1.0) - F.col("breakage_upper_bound"))
    age = F.lit(current_step) - F.col("last_validated_step")
    return (
        records.where("state = 'active'").join(activities, "experience_id")
        .select("experience_id", base.alias("priority_base"), half_life_decay(age, policy.half_life_steps).alias("decay"), age.cast("long").alias("age_steps"))
        .withColumn("priority", F.col("priority_base") * F.col("decay"))
    )


def partition(records: DataFrame, activities: DataFrame, current_step: int, policy: PortfolioPolicy) -> DataFrame:
    """(experience_id, priority, tier, hot_rank): hot, cold or expired for every active record.

    Active records are joined with their scores once and written; hot is a top-k of that table (TakeOrderedAndProject), as large as
    the capacity, so there is no global window over all records.
    """
    s = scores(records, activities, current_step, policy).select("experience_id", "priority")
    active = written(records.where("state = 'active'").select("experience_id").join(s, "experience_id", "left"), "portfolio")
    best = active.where(F.col("priority") >= policy.minimum_priority).orderBy(F.desc("priority"), "experience_id").limit(policy.capacity)
    # a window over the capacity's few rows only
    hot = best.select("experience_id", F.row_number().over(Window.orderBy(F.desc("priority"), "experience_id")).alias("hot_rank"))
    ranked = active.join(F.broadcast(hot) if policy.capacity <= 100_000 else hot, "experience_id", "left")
    tier = F.when(F.col("hot_rank").isNotNull(), "hot").when(F.col("priority") < policy.minimum_priority, "expired").otherwise("cold")
    return ranked.select("experience_id", "priority", tier.alias("tier"), "hot_rank")


def partition_violations(parts: DataFrame, records: DataFrame, policy: PortfolioPolicy) -> DataFrame:
    """(rule, key) against a partition as stored: tiers must be disjoint, cover the active records and no others, and hold the capacity."""
    active = records.where("state = 'active'").select("experience_id")
    tiers = parts.groupBy("experience_id").agg(F.count("*").alias("n"), F.count_distinct("tier").alias("k"))
    several = tiers.where("n > 1").select(F.when(F.col("k") > 1, "tiers_overlap").otherwise("repeated_in_tier").alias("rule"), F.col("experience_id").alias("key"))
    missing = active.join(parts, "experience_id", "left_anti").select(F.lit("active_without_tier"), "experience_id")
    foreign = parts.select("experience_id").distinct().join(active, "experience_id", "left_anti").select(F.lit("tier_of_inactive"), "experience_id")
    wrong = parts.select(F.explode(F.array_compact(F.array(F.when(~F.col("tier").isin("hot", "cold", "expired"), "unknown_tier"), F.when((F.col("tier") == "hot") != F.col("hot_rank").isNotNull(), "hot_rank_contradicts_tier")))), "experience_id")
    full = parts.where("tier = 'hot'").agg(F.count("*").alias("n")).where(F.col("n") > policy.capacity).select(F.lit("hot_above_capacity"), F.lit("*"))
    return several.union(missing).union(foreign).union(wrong).union(full)
