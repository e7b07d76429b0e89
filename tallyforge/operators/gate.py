"""Trust gate: all reasons against each candidate, then one decision for each target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import finite, reasons
from ..functions.text import is_unspecified, py_strip, same_folded, strip_text
from ..policies import GatePolicy, QueryBudget

#: Fixed order of the columns of a trace.
TRACE = (
    "experience_id", "recall_rank", "state", "environment_compatible", "environment_score", "environment_mode", "environment_hard_mismatches",
    "environment_soft_mismatches", "provenance_valid", "reliability_observations", "reliability_benefits", "reliability_mean_gain", "risk_upper_bound",
    "risk_measure", "reliability_valid", "query_plan_valid", "applicability_score", "applicability_scorer_id", "applicability_matched_signatures",
    "applicability_required_signatures", "applicability_matched_contraindications", "applicability_valid", "passed", "first_failure", "rejection_reasons",
)
#: Reasons that an operating point may scan again with other thresholds.
SCANNED = ("risk_upper_bound_too_high", "applicability_below_threshold")


def plan_reasons(prepared: Column, experience_id: Column, target_id: Column, target_query: Column, applier_id: Column, applier_version: Column, budget: QueryBudget = QueryBudget()) -> Column:
    """Ordered reasons against a prepared plan struct; a missing plan has that one reason.

    target_id and target_query are compared stripped. Nulls inside a plan count against it.
    """
    p = prepared
    text, query = py_strip(p["transformed_query"]), strip_text(target_query)
    within = lambda c, most: c.between(1, most)
    cost = p["estimated_cost"]
    bad_cost = ~finite(cost) | (cost < 0)
    dear = F.lit(False) if budget.max_application_cost is None else ~bad_cost & (cost > budget.max_application_cost)
    found = reasons(
        (p["experience_id"] != experience_id, "prepared_experience_mismatch"),
        (py_strip(p["target_query_id"]) != py_strip(target_id), "prepared_target_id_mismatch"),
        ((p["target_query"] != target_query) & (strip_text(p["target_query"]) != query), "prepared_target_query_mismatch"),
        (F.coalesce(text, F.lit("")) == "", "empty_transformed_query"),
        (F.coalesce((text != "") & same_folded(text, query), F.lit(False)), "unchanged_transformed_query"),
        (F.coalesce(F.length(text), F.lit(0)) > budget.max_query_characters, "transformed_query_too_long"),
        (is_unspecified(p["generated_by"]) | is_unspecified(p["application_version"]), "missing_application_provenance"),
        (py_strip(p["generated_by"]) != py_strip(applier_id), "application_applier_mismatch"),
        (py_strip(p["application_version"]) != py_strip(applier_version), "application_version_mismatch"),
        (~within(p["retrieval_query_count"], budget.max_retrieval_queries), "retrieval_query_budget_exceeded"),
        (~within(p["requested_top_k"], budget.max_top_k), "top_k_budget_invalid"),
        (~within(p["context_token_budget"], budget.max_context_tokens), "context_token_budget_invalid"),
        (bad_cost, "application_cost_invalid"),
        (dear, "application_cost_budget_exceeded"),
    )
    return F.when(p.isNull(), F.array(F.lit("missing_prepared_query_plan"))).otherwise(found)


def reliability_reasons(policy: GatePolicy) -> Column:
    mean, risk = F.col("reliability_mean_gain"), F.col("risk_upper_bound")
    return reasons(
        (F.col("reliability_observations") < policy.minimum_observations, "insufficient_reliability_observations"),
        (F.col("reliability_benefits") < policy.minimum_benefits, "insufficient_reliability_benefits"),
        (~finite(mean) | (mean <= policy.minimum_mean_gain), "reliability_mean_gain_too_low"),
        (~finite(risk) | (risk > policy.maximum_risk_upper_bound), "risk_upper_bound_too_high"),
    )


def applicability_reasons(policy: GatePolicy) -> Column:
    score = F.col("applicability_score")
    found = reasons(
        (is_unspecified(F.col("applicability_scorer_id")), "missing_applicability_scorer"),
        (F.size("applicability_matched_contraindications") > 0, "applicability_contraindication_matched"),
        (F.col("applicability_missing_features"), "missing_applicability_features"),
        (~finite(score) | (score < policy.minimum_applicability), "applicability_below_threshold"),
    )
    return F.when(score.isNull(), F.array(F.lit("missing_applicability_estimate"))).otherwise(found)


def gate_traces(candidates: DataFrame, policy: GatePolicy = GatePolicy(), budget: QueryBudget = QueryBudget()) -> DataFrame:
    """All candidates with every reason against them, in the order of the checks.

    candidates: target_query_id, target_query, experience_id, recall_rank, state, environment columns, provenance,
    reliability_observations/benefits/mean_gain, risk_upper_bound, risk_measure, applier_id, applier_version,
    prepared (struct or null), applicability columns. Only projections: no shuffle.
    """
    c = F.col
    staged = candidates.withColumns(
        {
            "provenance_valid": ~is_unspecified(c("provenance")),
            "_reliability": reliability_reasons(policy),
            "_plan": plan_reasons(c("prepared"), c("experience_id"), c("target_query_id"), c("target_query"), c("applier_id"), c("applier_version"), budget),
            "_fit": applicability_reasons(policy),
        }
    )
    first = reasons((c("state") != "active", "experience_not_active"), (~c("environment_compatible"), "environment_mismatch"), (~c("provenance_valid"), "missing_provenance"))
    out = staged.withColumn("rejection_reasons", F.concat(first, c("_reliability"), c("_plan"), c("_fit"))).withColumns(
        {
            "reliability_valid": F.size("_reliability") == 0,
            "query_plan_valid": F.size("_plan") == 0,
            "applicability_valid": F.size("_fit") == 0,
            "passed": F.size("rejection_reasons") == 0,
            "first_failure": F.get("rejection_reasons", F.lit(0)),
            "semantic_intent_valid": F.size("rejection_reasons") == F.size("_plan"),
        }
    )
    return out.select("target_query_id", *TRACE, "semantic_intent_valid", c("prepared.transformed_query").alias("prepared_query"))


def selection_key() -> Column:
    """Order of choice: best fit, least risk, best environment, nearest recall, id."""
    return F.struct((-F.col("applicability_score")).alias("a"), F.col("risk_upper_bound").alias("r"), (-F.col("environment_score")).alias("e"), F.col("recall_rank").alias("k"), F.col("experience_id").alias("x"))


def decide(traces: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: intended and executed action, query and reason. targets: target_query_id, target_query.

    Both choices come from one aggregation by target; targets without candidates come back by a left join.
    """
    choice = F.struct(F.col("experience_id").alias("id"), py_strip(F.col("prepared_query")).alias("query"))
    best = traces.groupBy("target_query_id").agg(
        F.count("*").alias("candidate_count"),
        F.min_by(choice, F.when(F.col("passed"), selection_key())).alias("won"),
        F.min_by(F.col("experience_id"), F.when(F.col("semantic_intent_valid"), selection_key())).alias("meant"),
    )
    d = targets.join(best, "target_query_id", "left")
    won, meant = F.col("won.id"), F.col("meant")
    reason = F.when(won.isNotNull(), "reuse_selected").when(F.col("candidate_count").isNull(), "no_candidates").when(meant.isNotNull(), "invalid_query_plan_fallback").otherwise("no_eligible_experience")
    return d.select(
        "target_query_id",
        F.when(won.isNotNull() | meant.isNotNull(), "reuse").otherwise("direct").alias("intended_action"),
        F.coalesce(won, meant).alias("intended_experience_id"),
        F.when(won.isNotNull(), "reuse").otherwise("direct").alias("executed_action"),
        won.alias("executed_experience_id"),
        F.coalesce(F.col("won.query"), strip_text(F.col("target_query"))).alias("executed_query"),
        reason.alias("reason"),
    )


def traces_by_target(traces: DataFrame) -> DataFrame:
    """(target_query_id, traces): arrays in recall order, bounded by the number of candidates recalled."""
    row = F.struct(F.col("recall_rank").alias("_k"), F.struct(*TRACE).alias("t"))
    return traces.groupBy("target_query_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]).alias("traces"))
