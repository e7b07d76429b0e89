"""Experience cards: policy, statistics recomputed from events, registry rules. Violations are (rule, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import close, finite, paired_verdict
from ..functions.text import has_duplicates, text_list_violation, versioned_id
from ..policies import CardActivationPolicy
from ..schemas import ACTIVATION_STAGES, CARD_STATES, TIER_SOURCES, TIERS
from .evidence_checks import duplicates, is_blank
from .episodes import _broken


def conditional_harm_rate(harm: Column, direct_correct: Column) -> Column:
    """Null where no trial had a correct baseline."""
    return F.try_divide(harm.cast("double"), direct_correct.cast("double"))


def policy_failures(policy: CardActivationPolicy = CardActivationPolicy()) -> Column:
    """Ordered messages against serving a card."""
    c = F.col
    harm = conditional_harm_rate(c("harm_count"), c("direct_correct_trials"))
    # The messages of the card format.
    found = [
        (~c("verification_tier").isin(*policy.allowed_verification_tiers), "verification tier is not allowed"),
        (c("independent_episode_count") < policy.min_independent_episodes, "too few independent episodes"),
        (c("independent_document_count") < policy.min_independent_documents, "too few independent documents"),
        (c("matched_trials") < policy.min_matched_trials, "too few matched trials"),
        (c("benefit_count") < policy.min_benefit_count, "too few beneficial transfers"),
        (harm.isNull(), "conditional harm is unobserved"),
        (harm > policy.max_conditional_harm_rate, "conditional harm exceeds the serving ceiling"),
        (c("mean_gain") <= 0, "mean paired gain is not positive"),
    ]
    return F.array_compact(F.array(*[F.when(x, F.lit(m)) for x, m in found]))


def _text_list_broken(c: Column) -> Column:
    return F.coalesce(text_list_violation(c).isNotNull(), F.lit(False))


def specification_violations(cards: DataFrame) -> DataFrame:
    """Rules within the structs `activation` (stage, query_pattern, gap_pattern and three lists of texts) and `repair`."""
    a, r = F.col("activation"), F.col("repair")
    lists = ("preconditions", "contraindications", "required_retriever_capabilities")
    rules = [
        (~F.coalesce(a["stage"].isin(*ACTIVATION_STAGES), F.lit(False)), "unknown_activation_stage"),
        *[(is_blank(a[x]), f"blank_{x}") for x in ("query_pattern", "gap_pattern")],
        *[(_text_list_broken(a[x]), f"{x}_invalid") for x in lists],
        *[(is_blank(r[x]), f"blank_{x}") for x in ("operator_type", "slot_template", "evidence_contract")],
    ]
    return _broken(cards, rules, versioned_id(F.col("card_id"), F.col("version")))


def card_violations(cards: DataFrame, policy: CardActivationPolicy = CardActivationPolicy()) -> DataFrame:
    """Rules within one card."""
    c = F.col
    counts = ("matched_trials", "benefit_count", "neutral_count", "harm_count", "direct_correct_trials")
    key = lambda x: F.struct(x["episode_id"].alias("e"), x["turn_id"].alias("t"))
    source, canonical = F.transform("source_turns", key), F.transform("canonical_turns", key)
    rules = [
        *[(is_blank(c(x)), f"blank_{x}") for x in ("card_id", "version", "created_at")],
        (~F.coalesce(c("lifecycle_state").isin(*CARD_STATES), F.lit(False)), "unknown_lifecycle_state"),
        (~F.coalesce(c("verification_tier").isin(*TIERS), F.lit(False)), "unknown_verification_tier"),
        *[(F.coalesce(c(x) < 0, F.lit(True)), f"{x}_negative") for x in counts],
        (c("benefit_count") + c("neutral_count") + c("harm_count") != c("matched_trials"), "counts_do_not_add_up"),
        (F.size("verification_event_ids") != c("matched_trials"), "events_do_not_cover_trials"),
        (has_duplicates(c("verification_event_ids")), "duplicate_event_ids"),
        (c("direct_correct_trials") > c("matched_trials"), "direct_correct_above_trials"),
        (c("harm_count") > c("direct_correct_trials"), "harm_above_direct_correct"),
        (~finite(c("mean_gain")), "mean_gain_not_finite"),
        (F.coalesce(F.size("source_turns"), F.lit(0)) < 1, "no_source_turns"),
        (has_duplicates(source), "duplicate_source_turns"),
        (F.size(F.array_except(canonical, source)) > 0, "canonical_not_in_sources"),
        (c("independent_episode_count") < 1, "no_independent_episode"),
        (c("independent_document_count") < 1, "no_independent_document"),
        (c("independent_document_count") > c("independent_episode_count"), "documents_above_episodes"),
        ((c("lifecycle_state") == "active") & ((c("benefit_count") < 1) | (c("mean_gain") <= 0)), "active_without_benefit"),
        ((c("lifecycle_state") == "active") & (F.size(policy_failures(policy)) > 0), "active_against_policy"),
    ]
    return _broken(cards, rules, versioned_id(c("card_id"), c("version")))


def recomputed_statistics(cards: DataFrame, events: DataFrame) -> DataFrame:
    """Per card: what its cited events really say, beside counts of unknown, unpaired and dependent events.

    cards and events meet in one equi-join on the event id; sums are combined before the shuffle by card.
    """
    cited = cards.select(versioned_id(F.col("card_id"), F.col("version")).alias("versioned_id"), "verification_tier", F.explode("verification_event_ids").alias("verification_id"))
    e = events.select("verification_id", "episode_id", "target", "source", "verdict", "baseline_score", "treatment_score", "quality_threshold", F.lit(True).alias("known"))
    j = cited.join(e, "verification_id", "left")
    v, b, t, q = F.col("verdict"), F.col("baseline_score"), F.col("treatment_score"), F.col("quality_threshold")
    allowed = F.lit(False)
    for tier, sources in TIER_SOURCES.items():
        allowed = allowed | ((F.col("verification_tier") == tier) & F.col("source").isin(*sources))
    return j.groupBy("versioned_id").agg(
        F.count("*").alias("trials"), F.count_if(v == "pass").alias("benefits"), F.count_if(v == "uncertain").alias("neutrals"), F.count_if(v == "fail").alias("harms"), F.count_if(b >= q).alias("direct_correct"),
        F.avg(F.coalesce(t - b, F.lit(0.0))).alias("observed_gain"), F.count_if(F.col("known").isNull()).alias("unknown_events"), F.count_if(F.col("target") != "paired_benefit").alias("unpaired_events"),
        (F.count("episode_id") - F.count_distinct("episode_id")).alias("dependent_trials"), F.count_if(F.col("known") & ~allowed).alias("unsupported_sources"),
    )


def source_turns(cards: DataFrame, turns: DataFrame) -> DataFrame:
    """(versioned_id, episode_id, turn_id, action, evidence) of every source reference; action null if unknown."""
    refs = cards.select(versioned_id(F.col("card_id"), F.col("version")).alias("versioned_id"), F.explode("source_turns").alias("r")).select("versioned_id", "r.*")
    return refs.join(turns.select("episode_id", "turn_id", "action", "evidence"), ["episode_id", "turn_id"], "left")


def registry_violations(cards: DataFrame, events: DataFrame, turns: DataFrame) -> DataFrame:
    """Cards against the archive: parents, sources, events, tiers, statistics, independence."""
    c = F.col
    named = cards.withColumn("versioned_id", versioned_id(c("card_id"), c("version")))
    parents = named.select("versioned_id", F.explode("parent_versioned_ids").alias("parent")).join(named.select(c("versioned_id").alias("parent")), "parent", "left_anti").select(F.lit("unknown_parent").alias("rule"), c("versioned_id").alias("key"))
    src = source_turns(cards, turns)
    bad_turns = src.where("action is null").select(F.lit("unknown_source_turn"), "versioned_id").union(src.where("action = 'base'").select(F.lit("source_turn_is_base"), "versioned_id")).distinct()
    docs = src.select("versioned_id", "episode_id", F.explode_outer("evidence.doc_id").alias("doc_id")).groupBy("versioned_id").agg(F.count_distinct("episode_id").alias("episodes"), F.count_distinct("doc_id").alias("documents"))
    passed = named.select("versioned_id", F.explode("verification_event_ids").alias("verification_id")).join(events.where("verdict = 'pass'").select("verification_id", "episode_id"), "verification_id").select("versioned_id", "episode_id")
    unproven = src.select("versioned_id", "episode_id").distinct().join(passed, ["versioned_id", "episode_id"], "left_anti").select(F.lit("source_without_benefit"), "versioned_id").distinct()
    stats = recomputed_statistics(cards, events)
    j = named.join(stats, "versioned_id", "left").join(docs, "versioned_id", "left")
    differs = [c(a) != c(b) for a, b in (("matched_trials", "trials"), ("benefit_count", "benefits"), ("neutral_count", "neutrals"), ("harm_count", "harms"), ("direct_correct_trials", "direct_correct"))]
    rules = [
        (c("trials").isNull(), "no_events"),
        (c("unknown_events") > 0, "unknown_event"),
        (c("unpaired_events") > 0, "event_not_paired"),
        (c("dependent_trials") > 0, "trials_not_independent"),
        (c("unsupported_sources") > 0, "sources_do_not_support_tier"),
        (differs[0] | differs[1] | differs[2] | differs[3] | differs[4], "counts_differ_from_events"),
        (~close(c("observed_gain"), c("mean_gain"), 1e-9, 1e-9), "mean_gain_differs_from_events"),
        (F.coalesce(c("documents"), F.lit(0)) == 0, "no_source_documents"),
        (c("episodes") != c("independent_episode_count"), "episode_count_differs"),
        (c("documents") != c("independent_document_count"), "document_count_differs"),
    ]
    return parents.union(bad_turns).union(unproven).union(_broken(j, rules, c("versioned_id"))).union(duplicates(named, "versioned_id"))


def with_verdicts(events: DataFrame) -> DataFrame:
    """events with expected_verdict, paired_gain and baseline_is_correct, null where scores are missing."""
    b, t, q = F.col("baseline_score"), F.col("treatment_score"), F.col("quality_threshold")
    return events.withColumns({"expected_verdict": paired_verdict(b, t, q), "paired_gain": t - b, "baseline_is_correct": b >= q})
