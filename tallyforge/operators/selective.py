"""Risk and coverage at given operating points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import paired_outcome, rate, unit_score
from ..schemas import BENEFIT, BOTH_BAD, BOTH_GOOD, HARM
from .gate import SCANNED, selection_key

#: More points than this are a mistake rather than a grid; up to it, they are sorted at the driver and broadcast.
MOST_POINTS = 10_000


def invariant_reasons(candidates: DataFrame) -> DataFrame:
    """Adds the reasons that no threshold can lift, and whether there are none."""
    kept = F.array_except("rejection_reasons", F.array(*[F.lit(r) for r in SCANNED]))
    return candidates.withColumn("invariant_rejection_reasons", kept).withColumn("invariant_eligible", F.size("invariant_rejection_reasons") == 0)


#: What is counted of chosen candidates.
COUNTED = ("accepted_count", "benefit_count", "harm_count", "both_good_count", "both_bad_count", "gain")


def staircase(candidates: DataFrame) -> DataFrame:
    """Candidates that some operating point chooses, with `lower_risk`, the least risk of those preferred to them.

    Preference begins with the better fit, so what a point's fit threshold admits is the head of a target's order, and its
    choice is the first there within the risk threshold: a candidate is chosen exactly where the fit threshold is its own
    or less and the risk threshold is from its own risk up to, but not including, lower_risk (null: no limit).
    """
    sound = F.col("applicability_score").isNotNull() & ~F.isnan("applicability_score") & F.col("risk_upper_bound").isNotNull() & ~F.isnan("risk_upper_bound")
    ahead = Window.partitionBy("target_query_id").orderBy(selection_key()).rowsBetween(Window.unboundedPreceding, -1)
    eligible = invariant_reasons(candidates).where(F.col("invariant_eligible") & sound)
    return eligible.withColumn("lower_risk", F.min("risk_upper_bound").over(ahead)).where("lower_risk is null or risk_upper_bound < lower_risk")


def _nodes(size: int, up: bool) -> list[tuple[int, int]]:
    """(place, node): the nodes of a binary indexed tree that a value at the place adds to (up), or that a prefix up to it is made of."""
    out = []
    for j in range(size):
        k = j + 1
        while 0 < k <= size:
            out.append((j, k))
            k += (k & -k) if up else -(k & -k)
    return out


def point_totals(chosen: DataFrame, points: list) -> DataFrame:
    """op_seq and sums of COUNTED over the candidates that each point chooses. chosen: staircase with the columns COUNTED.

    A candidate's thresholds form a rectangle: two signed corners in the grid of the points' thresholds, summed where they lie.
    A point's totals are the corners at its fit or above and its risk or below. Risk places become nodes of a binary indexed tree, at most
    fifteen for each, and along the fit a running sum within each node; nothing meets every point.
    """
    spark = chosen.sparkSession
    fits, risks = (np.unique([p[c] for p in points]) for c in ("minimum_applicability", "maximum_risk_upper_bound"))

    @F.pandas_udf("i int, j int, k int")
    def places(fit: pd.Series, risk: pd.Series, lower: pd.Series) -> pd.DataFrame:
        until = np.where(lower.isna(), len(risks), np.searchsorted(risks, lower.fillna(0.0)))
        return pd.DataFrame({"i": np.searchsorted(fits, fit, side="right") - 1, "j": np.searchsorted(risks, risk), "k": until}, dtype="int32")

    at = chosen.withColumn("_p", places(F.col("applicability_score").cast("double"), F.col("risk_upper_bound").cast("double"), F.col("lower_risk").cast("double")))
    corner = F.explode(F.array(F.struct(F.col("_p.j").alias("j"), F.lit(1).alias("sign")), F.struct(F.col("_p.k").alias("j"), F.lit(-1).alias("sign"))))
    cells = at.where("_p.i >= 0").select(F.col("_p.i").alias("i"), corner.alias("c"), *COUNTED).where(F.col("c.j") < len(risks)).groupBy("i", F.col("c.j").alias("j")).agg(*[F.sum(F.col("c.sign") * F.col(x)).alias(x) for x in COUNTED])
    adds = spark.createDataFrame(pd.DataFrame(_nodes(len(risks), True), columns=["j", "node"], dtype="int32"))
    sums = cells.join(F.broadcast(adds), "j").groupBy("node", "i").agg(*[F.sum(x).alias(x) for x in COUNTED])
    down: dict[int, list[int]] = {}
    for j, k in _nodes(len(risks), False):
        down.setdefault(j, []).append(k)
    asked = [(p["op_seq"], int(np.searchsorted(fits, p["minimum_applicability"])), k) for p in points for k in down[int(np.searchsorted(risks, p["maximum_risk_upper_bound"]))]]
    queries = spark.createDataFrame(pd.DataFrame(asked, columns=["op_seq", "i", "node"]).astype({"i": "int32", "node": "int32"}))
    both = sums.select("node", "i", F.lit(None).cast(queries.schema["op_seq"].dataType).alias("op_seq"), *COUNTED).unionByName(queries.select("node", "i", "op_seq", *[F.lit(0).alias(x) for x in COUNTED]))
    above = Window.partitionBy("node").orderBy(F.desc("i"), F.col("op_seq").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    part = both.select("op_seq", *[F.sum(x).over(above).alias(x) for x in COUNTED]).where("op_seq is not null")
    return part.groupBy("op_seq").agg(*[F.sum(x).alias(x) for x in COUNTED])


def sweep(candidates: DataFrame, points: DataFrame, universe: DataFrame, selected_pairs: bool = False) -> DataFrame:
    """One row per operating point, in op_seq order.

    candidates: target_query_id, experience_id, recall_rank, applicability_score, risk_upper_bound,
    environment_score, rejection_reasons, direct_score, reuse_score, good_threshold. Each target's staircase is found
    once for all points, whose number is checked; outcomes are counted of what is chosen only. selected_pairs lists what each
    point chooses, which is as large as points and targets together ask for.
    """
    given = points.limit(MOST_POINTS + 1).collect()
    if not 1 <= len(given) <= MOST_POINTS:
        raise ValueError(f"between 1 and {MOST_POINTS} operating points are required")
    for c in ("minimum_applicability", "maximum_risk_upper_bound"):
        if not all(p[c] is not None and 0.0 <= p[c] <= 1.0 for p in given):
            raise ValueError(f"{c} must be in [0, 1]")
    steps = staircase(candidates)
    o = paired_outcome(F.col("direct_score"), F.col("reuse_score"), F.col("good_threshold"))
    counted = {"accepted_count": F.lit(1), "benefit_count": (o == BENEFIT).cast("int"), "harm_count": (o == HARM).cast("int"), "both_good_count": (o == BOTH_GOOD).cast("int"), "both_bad_count": (o == BOTH_BAD).cast("int"), "gain": F.col("reuse_score") - F.col("direct_score")}
    agg = point_totals(steps.select("applicability_score", "risk_upper_bound", "lower_risk", *[v.cast("double" if k == "gain" else "long").alias(k) for k, v in counted.items()]), given)
    agg = agg.withColumn("mean_gain", rate(F.col("gain"), F.col("accepted_count"))).drop("gain")
    targets = universe.agg(F.count_distinct("target_query_id").alias("n")).first()["n"]
    out = points.join(F.broadcast(agg), "op_seq", "left").withColumn("target_count", F.lit(targets).cast("long")).fillna(0)
    if selected_pairs:
        covers = (F.col("applicability_score") >= F.col("minimum_applicability")) & (F.col("risk_upper_bound") <= F.col("maximum_risk_upper_bound")) & F.coalesce(F.col("maximum_risk_upper_bound") < F.col("lower_risk"), F.lit(True))
        pair = F.struct("target_query_id", "experience_id")
        chosen = steps.select("target_query_id", "experience_id", "applicability_score", "risk_upper_bound", "lower_risk").join(F.broadcast(points), covers).groupBy("op_seq").agg(F.sort_array(F.collect_list(pair)).alias("selected_pairs"))
        out = out.join(chosen, "op_seq", "left")
    harm, benefit, good, bad, n = (F.col(x) for x in ("harm_count", "benefit_count", "both_good_count", "both_bad_count", "accepted_count"))
    return out.withColumns({"coverage": rate(n, F.col("target_count")), "accepted_harm_rate": rate(harm, n), "conditional_breakage_rate": rate(harm, harm + good), "repair_rate": rate(benefit, benefit + bad)})


def violations(candidates: DataFrame, universe: DataFrame) -> DataFrame:
    """(rule, key): repeated pairs or ranks, targets outside the universe, scores that differ within a target, bad scores."""
    pair = candidates.groupBy("target_query_id", "experience_id").count().where("count > 1").select(F.lit("duplicate_pair").alias("rule"), F.concat_ws("/", "target_query_id", "experience_id").alias("key"))
    rank = candidates.groupBy("target_query_id", "recall_rank").count().where("count > 1").select(F.lit("duplicate_rank"), "target_query_id")
    outside = candidates.join(universe.select("target_query_id"), "target_query_id", "left_anti").select(F.lit("target_outside_universe"), "target_query_id").distinct()
    g = candidates.groupBy("target_query_id").agg((F.min("direct_score") != F.max("direct_score")).alias("d"), (F.min("good_threshold") != F.max("good_threshold")).alias("t"))
    mixed = g.where("d or t").select(F.lit("inconsistent_target_protocol"), "target_query_id")
    bad = candidates.where(~(unit_score(F.col("direct_score")) & unit_score(F.col("reuse_score")) & unit_score(F.col("good_threshold")))).select(F.lit("score_out_of_range"), F.concat_ws("/", "target_query_id", "experience_id"))
    twice = universe.groupBy("target_query_id").count().where("count > 1").select(F.lit("duplicate_universe_target"), "target_query_id")
    none = universe.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("empty_universe"), F.lit("*"))
    return pair.union(rank).union(outside).union(mixed).union(bad).union(twice).union(none)
