"""Evidence: write gate, reliability of experiences, lifecycle state from ordered observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import paired_outcome, rate, wilson_upper
from ..policies import LifecyclePolicy
from ..schemas import BENEFIT, BOTH_BAD, BOTH_GOOD, HARM


def label_pairs(df: DataFrame, threshold: Column | float = 0.5) -> DataFrame:
    """Adds outcome and difference to rows with direct_score and reuse_score."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return df.withColumns({"outcome": paired_outcome(F.col("direct_score"), F.col("reuse_score"), t), "difference": F.col("reuse_score") - F.col("direct_score")})


def write_gate(candidates: DataFrame, minimum_gain: float = 0.0) -> DataFrame:
    """Source evidence that may enter memory as a candidate: a gain above the minimum, never of the test role."""
    if minimum_gain < 0:
        raise ValueError("minimum_gain must not be negative")
    gain = F.col("reuse_score") - F.col("direct_score")
    return candidates.withColumn("gain", gain).where((F.col("gain") > minimum_gain) & (F.col("evidence_role") != "test")).withColumn("state", F.lit("candidate"))


def _with_outcome(obs: DataFrame) -> DataFrame:
    o = paired_outcome(F.col("direct_score"), F.col("reuse_score"), F.col("good_threshold"))
    return obs.withColumns({"outcome": o, "gain": F.col("reuse_score") - F.col("direct_score")})


def _summary_columns(prefix: dict[str, Column]) -> dict[str, Column]:
    n, benefit, harm, good, bad, mean = (prefix[k] for k in ("n", "benefit", "harm", "both_good", "both_bad", "mean_gain"))
    return {
        "observations": n,
        "benefit_count": benefit,
        "harm_count": harm,
        "mean_gain": mean,
        "harm_rate": rate(harm, n),
        "benefit_rate": rate(benefit, n),
        "direct_good_count": harm + good,
        "direct_bad_count": benefit + bad,
        "conditional_breakage_rate": rate(harm, harm + good),
        "repair_rate": rate(benefit, benefit + bad),
        "breakage_upper_bound": wilson_upper(harm, harm + good),
        "harm_upper_bound": wilson_upper(harm, n),
    }


def reliability(observations: DataFrame, experiences: DataFrame | None = None) -> DataFrame:
    """One row per experience_id; experiences without observations come in with zeros if given.

    Counts are combined on the map side: one shuffle of at most one row per experience and task.
    """
    o = F.col("outcome")
    agg = (
        _with_outcome(observations).groupBy("experience_id")
        .agg(
            F.count("*").alias("n"), F.count_if(o == BENEFIT).alias("benefit"), F.count_if(o == HARM).alias("harm"),
            F.count_if(o == BOTH_GOOD).alias("both_good"), F.count_if(o == BOTH_BAD).alias("both_bad"), F.avg("gain").alias("mean_gain"),
        )
    )
    if experiences is not None:
        agg = experiences.select("experience_id").join(agg, "experience_id", "left").fillna(0)
    return agg.select("experience_id", *[c.alias(k) for k, c in _summary_columns({k: F.col(k) for k in ("n", "benefit", "harm", "both_good", "both_bad", "mean_gain")}).items()])


def risk_upper_bound(df: DataFrame, measures: tuple[str, ...] = ("wilson_95_conditional_breakage_upper_bound", "wilson_95_breakage_upper_bound", "wilson_95_harm_upper_bound")) -> tuple[Column, Column]:
    """(value, name) of the first measure that df has and that isn't null; else 1 and a marker."""
    have = [m for m in measures if m in df.columns]
    value = F.coalesce(*[F.col(m) for m in have], F.lit(1.0))
    name = F.coalesce(*[F.when(F.col(m).isNotNull(), F.lit(m)) for m in have], F.lit("missing_risk_upper_bound"))
    return value, name


#: Observations of one experience that are summed up in one piece, as its order numbers run.
SEGMENT = 1 << 18
_RUNNING = ("n", "benefit", "harm", "both_good", "gain")


def _segment(df: DataFrame, order: str, segment: int) -> Column:
    """Piece of an experience's order; all of it is one piece where the order isn't by whole numbers."""
    whole = df.schema[order].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.coalesce(F.floor(F.col(order) / F.lit(segment)), F.lit(-1)).cast("long") if whole else F.lit(0).cast("long")


def running_totals(observations: DataFrame, order: str = "seq", segment: int = SEGMENT, carried: DataFrame | None = None) -> DataFrame:
    """experience_id, order and the totals n, benefit, harm, both_good, gain of each observation and all before it.

    A segmented scan: order numbers are cut into pieces of `segment`, each piece is summed up by itself, and totals of the pieces before
    are added, so that one experience of most observations is spread over tasks. Rows are shuffled once, by experience
    and piece; otherwise only one row a piece moves. carried (experience_id, the same totals) is what was before all of them.
    """
    o = F.col("outcome")
    one = lambda name: (o == name).cast("long")
    rows = _with_outcome(observations).select("experience_id", order, _segment(observations, order, segment).alias("_s"), F.lit(1).cast("long").alias("n"), one(BENEFIT).alias("benefit"), one(HARM).alias("harm"), one(BOTH_GOOD).alias("both_good"), F.col("gain"))
    piece = Window.partitionBy("experience_id", "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("experience_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("experience_id", "_s").agg(*[F.sum(c).alias(c) for c in _RUNNING])
    if carried is not None:
        totals = totals.unionByName(carried.select("experience_id", F.lit(-(1 << 62)).alias("_s"), *_RUNNING))
    before = totals.select("experience_id", "_s", *[F.sum(c).over(earlier).alias(f"_{c}") for c in _RUNNING]).where("_n is not null")
    run = rows.select("experience_id", order, "_s", *[F.sum(c).over(piece).alias(c) for c in _RUNNING])
    return run.join(before, ["experience_id", "_s"], "left").select("experience_id", order, *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in _RUNNING])


def ready(policy: LifecyclePolicy) -> Column:
    """Whether running totals promote a candidate."""
    good = F.col("harm") + F.col("both_good")
    return (
        (F.col("n") >= policy.promotion_min_observations) & (good >= policy.promotion_min_direct_good_observations) & (F.col("benefit") >= policy.promotion_min_benefits)
        & (F.col("gain") / F.col("n") > policy.promotion_min_mean_gain) & (wilson_upper(F.col("harm"), good) <= policy.promotion_max_wilson_breakage_upper_bound)
        & (F.col("harm") < policy.quarantine_at_harm_count)
    )


def lifecycle_state(observations: DataFrame, policy: LifecyclePolicy = LifecyclePolicy(), order: str = "seq", segment: int = SEGMENT) -> DataFrame:
    """State of each experience after its observations in order.

    Promotion asks the running totals of every prefix, as a later drop doesn't revoke it; harm to the limit
    quarantines for good.
    """
    return running_totals(observations, order, segment).groupBy("experience_id").agg(
        F.max("n").alias("observations"),
        F.when(F.max("harm") >= policy.quarantine_at_harm_count, "quarantine").when(F.max(ready(policy)), "active").otherwise("candidate").alias("state"),
    )


def state_histogram(records: DataFrame) -> DataFrame:
    return records.groupBy("state").agg(F.count("*").alias("n"))
