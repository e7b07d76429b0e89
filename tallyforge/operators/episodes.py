"""Episodes: validation of multi-turn records, verification events, sessions and pairs. Violations are (rule, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import close, finite, paired_verdict
from ..functions.text import has_duplicates, normalize_text, text_list_violation
from ..schemas import EPISODE_ACTIONS, EPISODE_GAP_CATEGORIES, NEXT_ACTIONS, SUFFICIENCY, TERMINAL_REASONS, VERDICTS, VERIFICATION_SOURCES, VERIFICATION_TARGETS
from .evidence_checks import duplicates, is_blank

_TERMINAL = ("answer", "stop_abstain")


def _broken(df: DataFrame, rules: list[tuple[Column, str]], key: Column) -> DataFrame:
    named = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules]
    return df.select(F.explode(F.array_compact(F.array(*named))).alias("rule"), key.alias("key"))


def turn_violations(turns: DataFrame) -> DataFrame:
    """Rules within one turn: domains, card reference, one query, unique evidence and gaps, costs."""
    c = F.col
    reuse = c("action") == "reuse_repair"
    evidence = F.transform("evidence", lambda e: F.struct(e["doc_id"], e["unit_id"]))
    least = lambda x, n: F.coalesce(c(x) < n, F.lit(True))
    rules = [
        (is_blank(c("turn_id")), "blank_turn_id"),
        (is_blank(c("operator")), "blank_operator"),
        (~F.coalesce(c("action").isin(*EPISODE_ACTIONS), F.lit(False)), "unknown_action"),
        (~F.coalesce(c("next_action").isin(*NEXT_ACTIONS), F.lit(False)), "unknown_next_action"),
        (~F.coalesce(c("sufficiency").isin(*SUFFICIENCY), F.lit(False)), "unknown_sufficiency"),
        (reuse & c("experience_card_version").isNull(), "reuse_without_card"),
        (~reuse & c("experience_card_version").isNotNull(), "card_without_reuse"),
        (c("experience_card_version").isNotNull() & is_blank(c("experience_card_version")), "blank_card_version"),
        (F.coalesce(F.size("executed_queries"), F.lit(0)) != 1, "not_one_query"),
        (text_list_violation(c("executed_queries")).isNotNull(), "executed_queries_invalid"),
        (text_list_violation(c("target_gap_ids")).isNotNull(), "target_gap_ids_invalid"),
        (has_duplicates(evidence), "duplicate_evidence"),
        (has_duplicates(c("gap_ids")), "duplicate_gap_ids"),
        ((c("sufficiency") == "sufficient") & (F.size("gap_ids") > 0), "sufficient_with_gaps"),
        (F.exists("evidence", lambda e: F.coalesce(e["rank"] < 1, F.lit(True))), "evidence_rank_invalid"),
        (F.exists("evidence", lambda e: ~finite(e["retrieval_score"])), "retrieval_score_invalid"),
        (~(finite(c("duplicate_ratio")) & c("duplicate_ratio").between(0, 1)), "duplicate_ratio_invalid"),
        (~(finite(c("latency_ms")) & (c("latency_ms") >= 0)), "latency_invalid"),
        *[(least(x, 0), f"{x}_negative") for x in ("new_evidence_count", "retrieval_calls", "input_tokens", "output_tokens")],
    ]
    return _broken(turns, rules, F.concat_ws("#", "episode_id", "turn_index"))


def gap_violations(gaps: DataFrame) -> DataFrame:
    """gaps: episode_id, turn_index, gap_id, category, target, slot, description."""
    rules = [(~F.coalesce(F.col("category").isin(*EPISODE_GAP_CATEGORIES), F.lit(False)), "unknown_gap_category"), *[(is_blank(F.col(x)), f"blank_{x}") for x in ("gap_id", "target", "slot", "description") if x in gaps.columns]]
    return _broken(gaps, rules, F.concat_ws("#", "episode_id", "turn_index", "gap_id"))


def episode_violations(episodes: DataFrame, turns: DataFrame) -> DataFrame:
    """The state machine over the turns of each episode.

    Each turn sees its neighbours through lag and lead over one window; counts and the final checks come from
    one aggregation on the same partitioning, so turns are shuffled once, by episode.
    """
    c = F.col
    w = Window.partitionBy("episode_id").orderBy("turn_index", "turn_id")
    every = Window.partitionBy("episode_id")
    t = turns.withColumns(
        {
            "_nth": F.row_number().over(w), "_n": F.count(F.lit(1)).over(every), "_prior": F.lag("gap_ids").over(w), "_next": F.lead("action").over(w),
            "_same": F.count(F.lit(1)).over(Window.partitionBy("episode_id", "turn_id")),
        }
    ).join(episodes.select("episode_id", "terminal_reason"), "episode_id")
    first, last = c("_nth") == 1, c("_nth") == c("_n")
    base, na = c("action") == "base", c("next_action")
    targets = F.coalesce(F.size("target_gap_ids"), F.lit(0))
    forced = (c("_n") == 1) & base & F.coalesce(c("terminal_reason") == "baseline_complete", F.lit(False))
    stray = F.size(F.array_except(F.coalesce("target_gap_ids", F.array().cast("array<string>")), F.coalesce("_prior", F.array().cast("array<string>")))) > 0
    per_turn = [
        (c("_same") > 1, "duplicate_turn_id"),
        (first & ~base, "first_turn_not_base"),
        (~first & base, "base_after_first_turn"),
        (base & (targets > 0), "base_targets_gaps"),
        (~first & (targets == 0), "repair_without_target"),
        (~first & (targets > 0) & stray, "repair_targets_unknown_gap"),
        ((c("sufficiency") == "sufficient") & (na != "answer"), "sufficient_without_answer"),
        ((c("sufficiency") != "sufficient") & (na == "answer") & ~forced, "answer_without_sufficiency"),
        (na.isin(*_TERMINAL) & ~last, "terminal_action_before_end"),
        (~na.isin(*_TERMINAL) & last, "end_without_terminal_action"),
        (~na.isin(*_TERMINAL) & ~last & (c("_next") != F.when(na.isin("reuse_repair", "fresh_repair"), na)), "decision_not_executed"),
    ]
    found = _broken(t, per_turn, F.concat_ws("#", "episode_id", "turn_index"))
    pair = lambda e: F.struct(e["doc_id"].alias("doc_id"), e["unit_id"].alias("unit_id"))
    ends = turns.groupBy("episode_id").agg(
        F.count("*").alias("n"), F.max_by(F.struct("sufficiency", "next_action"), F.struct("turn_index", "turn_id")).alias("end"), F.min_by("action", F.struct("turn_index", "turn_id")).alias("start"),
        F.flatten(F.collect_list(F.transform("evidence", pair))).alias("seen"),
    )
    e = episodes.join(ends, "episode_id", "left")
    reason, end = c("terminal_reason"), c("end")
    direct = (c("n") == 1) & (c("start") == "base")
    text = ("episode_id", "run_context_id", "comparison_group_id", "original_query", "opened_at", "frozen_at", "schema_version")
    per_episode = [
        *[(is_blank(c(x)), f"blank_{x}") for x in text],
        (c("document_session_id").isNotNull() & is_blank(c("document_session_id")), "blank_document_session_id"),
        (~F.coalesce(reason.isin(*TERMINAL_REASONS), F.lit(False)), "unknown_terminal_reason"),
        (c("n").isNull(), "no_turns"),
        ((reason == "sufficient") & ((end["sufficiency"] != "sufficient") | (end["next_action"] != "answer")), "sufficient_end_without_evidence"),
        ((reason == "baseline_complete") & ~direct, "baseline_complete_not_direct"),
        (~reason.isin("sufficient", "baseline_complete") & (end["next_action"] != "stop_abstain"), "terminal_reason_needs_stop"),
        (F.size(F.array_except(F.transform("final_evidence", pair), "seen")) > 0, "final_evidence_not_retrieved"),
    ]
    return found.union(_broken(e, per_episode, c("episode_id"))).union(duplicates(episodes, "episode_id"))


def event_violations(events: DataFrame) -> DataFrame:
    """Rules within one verification event."""
    c = F.col
    paired = c("target") == "paired_benefit"
    three = ("baseline_score", "treatment_score", "quality_threshold")
    whole = c("baseline_score").isNotNull() & c("treatment_score").isNotNull() & c("quality_threshold").isNotNull()
    gain = c("treatment_score") - c("baseline_score")
    rules = [
        *[(is_blank(c(x)), f"blank_{x}") for x in ("verification_id", "episode_id", "metric_id", "created_at")],
        (~F.coalesce(c("target").isin(*VERIFICATION_TARGETS), F.lit(False)), "unknown_target"),
        (~F.coalesce(c("source").isin(*VERIFICATION_SOURCES), F.lit(False)), "unknown_source"),
        (~F.coalesce(c("verdict").isin(*VERDICTS), F.lit(False)), "unknown_verdict"),
        *[(c(x).isNotNull() & ~finite(c(x)), f"{x}_not_finite") for x in ("score", *three)],
        (c("direct_baseline_episode_ref").isNotNull() & is_blank(c("direct_baseline_episode_ref")), "blank_baseline_ref"),
        (paired & c("direct_baseline_episode_ref").isNull(), "paired_without_baseline"),
        (paired & ~whole, "paired_without_scores"),
        (paired & whole & ~F.coalesce(close(c("score"), gain), F.lit(False)), "paired_score_not_gain"),
        (paired & whole & (c("verdict") != paired_verdict(c("baseline_score"), c("treatment_score"), c("quality_threshold"))), "verdict_contradicts_scores"),
        (~paired & (c("baseline_score").isNotNull() | c("treatment_score").isNotNull() | c("quality_threshold").isNotNull()), "paired_fields_on_other_target"),
    ]
    return _broken(events, rules, c("verification_id"))


def arms(episodes: DataFrame, turns: DataFrame) -> DataFrame:
    """episodes with is_direct_baseline and contains_repair."""
    t = turns.groupBy("episode_id").agg(F.count("*").alias("_n"), F.count_if(F.col("action") == "base").alias("_b"))
    return episodes.join(t, "episode_id", "left").withColumns({"is_direct_baseline": F.coalesce((F.col("_n") == 1) & (F.col("_b") == 1), F.lit(False)), "contains_repair": F.coalesce(F.col("_n") > F.col("_b"), F.lit(False))}).drop("_n", "_b")


def pair_violations(events: DataFrame, episodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Paired events against both of their episodes; unknown references of any event."""
    a = arms(episodes, turns)
    cols = ("episode_id", "original_query", "run_context_id", "comparison_group_id", "is_direct_baseline", "contains_repair")
    t = a.select(*[F.col(x).alias(f"t_{x}") for x in cols])
    b = a.select(*[F.col(x).alias(f"b_{x}") for x in cols])
    j = events.join(t, F.col("episode_id") == F.col("t_episode_id"), "left").join(b, F.col("direct_baseline_episode_ref") == F.col("b_episode_id"), "left")
    c = F.col
    paired = c("target") == "paired_benefit"
    both = paired & c("t_episode_id").isNotNull() & c("b_episode_id").isNotNull() & (c("t_episode_id") != c("b_episode_id"))
    rules = [
        (c("t_episode_id").isNull(), "unknown_episode"),
        (c("direct_baseline_episode_ref").isNotNull() & c("b_episode_id").isNull(), "unknown_baseline"),
        (paired & (c("episode_id") == c("direct_baseline_episode_ref")), "paired_with_itself"),
        (both & ~c("b_is_direct_baseline"), "baseline_not_direct"),
        (both & ~c("t_contains_repair"), "treatment_without_repair"),
        (both & (c("t_original_query") != c("b_original_query")), "queries_differ"),
        (both & (c("t_run_context_id") != c("b_run_context_id")), "contexts_differ"),
        (both & (c("t_comparison_group_id") != c("b_comparison_group_id")), "comparison_groups_differ"),
    ]
    return _broken(j, rules, c("verification_id"))


def session_violations(sessions: DataFrame, episodes: DataFrame) -> DataFrame:
    """Sessions against the episodes that they group."""
    ids = sessions.select("session_id", F.explode_outer("episode_ids").alias("episode_id"))
    j = ids.join(episodes.select("episode_id", "document_session_id", F.lit(True).alias("_known")), "episode_id", "left")
    rules = [
        (F.col("episode_id").isNull(), "no_episodes"),
        (F.col("episode_id").isNotNull() & F.col("_known").isNull(), "unknown_episode"),
        (F.col("_known") & ~F.col("document_session_id").eqNullSafe(F.col("session_id")), "session_mismatch"),
    ]
    own = [(is_blank(F.col(x)), f"blank_{x}") for x in ("session_id", "scope_ref", "scope_version", "opened_at", "frozen_at", "schema_version")]
    repeats = [(has_duplicates(F.transform("episode_ids", normalize_text)), "duplicate_episode_ids")]
    return _broken(j, rules, F.concat_ws("/", "session_id", "episode_id")).union(_broken(sessions, own + repeats, F.col("session_id"))).union(duplicates(sessions, "session_id"))


def context_violations(episodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """Episodes of unknown run contexts, repeated contexts."""
    lost = episodes.join(contexts.select("run_context_id"), "run_context_id", "left_anti").select(F.lit("unknown_run_context").alias("rule"), F.col("episode_id").alias("key"))
    return lost.union(duplicates(contexts, "run_context_id"))


def verifications_for(events: DataFrame, episodes: DataFrame, episode_id: str) -> DataFrame:
    """Events of one episode by id; an unknown episode is an error."""
    if episodes.where(F.col("episode_id") == episode_id).isEmpty():
        raise KeyError(episode_id)
    return events.where(F.col("episode_id") == episode_id).orderBy("verification_id")
