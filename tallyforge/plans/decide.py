"""Trusted reuse for whole batches of requests: one plan from memory records to decisions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_text
from ..operators.applicability import coverage
from ..operators.environment import match
from ..operators.gate import decide, gate_traces
from ..operators.portfolio import partition
from ..operators.recall import Recall, recall_top_m
from ..operators.reliability import risk_upper_bound
from ..policies import EnvironmentPolicy, GatePolicy, PlanApplication, PortfolioPolicy, QueryBudget
from ..schemas import ENVIRONMENT_FIELDS, RECALL_SCORER

#: (required, observed, contraindicated signatures) -> applicability columns, as coverage.
Scorer = Callable[[Column, Column, Column], dict[str, Column]]
#: Recalled pairs -> the same with `prepared`, a struct or null, as apply_plans.
Applier = Callable[[DataFrame], DataFrame]


@dataclass
class Decisions:
    """eligible: records that entered recall; rejected: active ones of another environment; recalled; traces; decisions."""

    eligible: DataFrame
    rejected: DataFrame
    recalled: DataFrame
    traces: DataFrame
    decisions: DataFrame
    portfolio: DataFrame | None = None
    recall_scorer_id: str = RECALL_SCORER


def component_id(component: object, own: str) -> str:
    """The id that results name for a hook: its `scorer_id` if that isn't blank, else what it's called; own without a hook."""
    if component is None:
        return own
    given = getattr(component, "scorer_id", None)
    if isinstance(given, str) and given.strip():
        return given.strip()
    return getattr(component, "__name__", type(component).__name__)


def with_plans(pairs: DataFrame, plans: DataFrame) -> DataFrame:
    """pairs with their plan's text in `_q` and whether they have one in `_planned`: target_query_id, experience_id, source_query_id.

    The join is outer: a candidate without a plan stays and is rejected for it. The source query is never
    a target of its own experience.
    """
    p = plans.select(F.col("target_query_id").alias("_t"), F.col("experience_id").alias("_e"), F.col("transformed_query").alias("_q"))
    # by target alone, the experience being compared within: plans and what follows share that partitioning, so plan texts move once
    same = (F.col("experience_id") >= F.col("_e")) & (F.col("experience_id") <= F.col("_e"))
    on = (F.col("target_query_id") == F.col("_t")) & same & ~F.col("target_query_id").eqNullSafe(F.col("source_query_id"))
    return pairs.join(p, on, "left").withColumn("_planned", F.col("_t").isNotNull()).drop("_t", "_e")


def prepare(planned: DataFrame, application: PlanApplication = PlanApplication()) -> DataFrame:
    """with_plans, with the target's text, as `prepared`: a struct or null."""
    a = application
    prepared = F.struct(
        F.col("target_query_id"), F.col("target_query"), F.col("experience_id"), F.col("_q").alias("transformed_query"), F.lit(a.applier_id).alias("generated_by"), F.lit(a.estimated_cost).alias("estimated_cost"),
        F.lit(a.application_version).alias("application_version"), F.lit(a.retrieval_query_count).alias("retrieval_query_count"), F.lit(a.requested_top_k).alias("requested_top_k"), F.lit(a.context_token_budget).alias("context_token_budget"),
    )
    return planned.withColumn("prepared", F.when(F.col("_planned"), prepared)).drop("_q", "_planned")


def apply_plans(recalled: DataFrame, plans: DataFrame, application: PlanApplication = PlanApplication()) -> DataFrame:
    """recalled with `prepared`, a struct or null. recalled: target_query_id, target_query, experience_id, source_query_id."""
    return prepare(with_plans(recalled, plans), application)


def decide_batch(
    records: DataFrame, requests: DataFrame, plans: DataFrame | None, environment: dict[str, str], *, gate: GatePolicy = GatePolicy(), budget: QueryBudget = QueryBudget(),
    environment_policy: EnvironmentPolicy = EnvironmentPolicy(), application: PlanApplication = PlanApplication(), max_candidates: int = 5, activities: DataFrame | None = None,
    current_step: int | None = None, portfolio_policy: PortfolioPolicy | None = None,
    recall: Recall | None = None, scorer: Scorer | None = None, applier: Applier | None = None,
) -> Decisions:
    """records: experience_id, state, source_query_id, source_query, environment struct, provenance, applicability_signature,
    contraindication_signature, applier_id, applier_version, reliability columns (observations, benefit_count,
    mean_gain, breakage_upper_bound, benefit_rate). requests: target_query_id, target_query, signatures.

    Order matters and is kept: active, hot, same environment, then recall of the nearest among those.
    The current environment is a literal, so distinct environments are compared once, not for each target. recall, scorer and
    applier replace word overlap, signature coverage and precomputed plans (`plans` is None then).
    """
    portfolio = None
    pool = records.where("state = 'active'")
    if portfolio_policy is not None:
        if activities is None or current_step is None:
            raise ValueError("a portfolio needs activities and current_step")
        portfolio = partition(records, activities, current_step, portfolio_policy)
        pool = pool.join(portfolio.where("tier = 'hot'").select("experience_id"), "experience_id", "left_semi")
    current = F.struct(*[F.lit(environment.get(f)).alias(f) for f in ENVIRONMENT_FIELDS])
    matched = match(pool, current, environment_policy)
    eligible = matched.where("environment_compatible")
    asked = requests.withColumn("target_query", strip_text(F.col("target_query")))
    recalled = recall(asked, eligible, max_candidates) if recall else recall_top_m(asked, eligible, max_candidates)
    # texts of targets come last, once for each, so that no join moves a text for every candidate
    pairs = recalled.join(eligible, "experience_id")
    candidates = applier(pairs.join(asked, "target_query_id")) if applier else prepare(with_plans(pairs, plans).join(asked, "target_query_id"), application)
    bounds = {"wilson_95_conditional_breakage_upper_bound": "breakage_upper_bound", "wilson_95_harm_upper_bound": "harm_upper_bound"}
    candidates = candidates.withColumns({k: F.col(c) for k, c in bounds.items() if c in candidates.columns})
    risk, measure = risk_upper_bound(candidates)
    candidates = candidates.withColumns((scorer or coverage)(F.col("applicability_signature"), F.col("signatures"), F.col("contraindication_signature"))).withColumns(
        {
            "reliability_observations": F.col("observations"), "reliability_benefits": F.col("benefit_count"), "reliability_mean_gain": F.col("mean_gain"),
            "risk_upper_bound": risk, "risk_measure": measure,
        }
    )
    traces = gate_traces(candidates, gate, budget)
    return Decisions(eligible, matched.where("not environment_compatible"), recalled, traces, decide(traces, asked), portfolio, component_id(recall, RECALL_SCORER))
