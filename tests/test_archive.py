import pytest
from pyspark.sql import functions as F

from tallyforge.operators import cards, episodes
from tallyforge.operators.evidence_checks import IntegrityError
from tallyforge.plans import ledger
from tallyforge.policies import CardActivationPolicy
from tallyforge.schemas import CARDS, EPISODES, EVENTS, SESSIONS, TURNS


def frame(spark, schema, rows, defaults):
    full = [defaults | r for r in rows]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in full], schema)


TURN = dict(turn_index=0, turn_id="u0", action="base", operator="op", executed_queries=["q"], target_gap_ids=[], sufficiency="insufficient", gap_ids=["g0"], next_action="fresh_repair", evidence=[("d0", "x", 1, 0.5)], duplicate_ratio=0.0, new_evidence_count=1, retrieval_calls=1, input_tokens=1, output_tokens=1, latency_ms=1.0)
LAST = dict(turn_index=1, turn_id="u1", action="fresh_repair", target_gap_ids=["g0"], sufficiency="sufficient", gap_ids=[], next_action="answer", evidence=[("d1", "x", 1, 0.5)])
EPISODE = dict(episode_id="e", run_context_id="r", comparison_group_id="c", original_query="q", opened_at="0", frozen_at="1", terminal_reason="sufficient", schema_version="v", final_evidence=[("d1", "x")])


def turns(spark, *rows):
    return frame(spark, TURNS, rows, TURN)


def eps(spark, *rows):
    return frame(spark, EPISODES, rows or [{}], EPISODE)


def rules(df):
    return {r[0] for r in df.collect()}


def two(spark, first=None, last=None):
    return turns(spark, {"episode_id": "e"} | (first or {}), {"episode_id": "e"} | LAST | (last or {}))


def test_sound_episode(spark):
    assert rules(episodes.episode_violations(eps(spark), two(spark))) == set()
    assert rules(episodes.turn_violations(two(spark))) == set()


@pytest.mark.parametrize(
    "episode,first,last,rule",
    [
        ({}, {"action": "fresh_repair"}, {}, "first_turn_not_base"), ({}, {}, {"action": "base"}, "base_after_first_turn"), ({}, {"target_gap_ids": ["g"]}, {}, "base_targets_gaps"), ({}, {}, {"target_gap_ids": []}, "repair_without_target"),
        ({}, {}, {"target_gap_ids": ["zz"]}, "repair_targets_unknown_gap"), ({}, {}, {"next_action": "stop_abstain"}, "sufficient_without_answer"), ({}, {}, {"sufficiency": "unknown"}, "answer_without_sufficiency"),
        ({}, {"next_action": "stop_abstain"}, {}, "terminal_action_before_end"), ({}, {}, {"next_action": "fresh_repair"}, "end_without_terminal_action"), ({}, {"next_action": "reuse_repair"}, {}, "decision_not_executed"), ({}, {}, {"turn_id": "u0"}, "duplicate_turn_id"),
        ({"terminal_reason": "baseline_complete"}, {}, {}, "baseline_complete_not_direct"), ({"terminal_reason": "budget"}, {}, {}, "terminal_reason_needs_stop"), ({"final_evidence": [("d9", "x")]}, {}, {}, "final_evidence_not_retrieved"),
        ({"terminal_reason": "odd"}, {}, {}, "unknown_terminal_reason"), ({"opened_at": " "}, {}, {}, "blank_opened_at"), ({"document_session_id": " "}, {}, {}, "blank_document_session_id"), ({}, {}, {"sufficiency": "insufficient"}, "sufficient_end_without_evidence"),
    ],
)
def test_episode_rules(spark, episode, first, last, rule):
    assert rule in rules(episodes.episode_violations(eps(spark, episode), two(spark, first, last)))


def test_forced_baseline_and_no_turns(spark):
    t = turns(spark, {"episode_id": "e", "next_action": "answer", "gap_ids": []})
    assert rules(episodes.episode_violations(eps(spark, {"terminal_reason": "baseline_complete", "final_evidence": [("d0", "x")]}), t)) == set()
    assert "no_turns" in rules(episodes.episode_violations(eps(spark), t.limit(0)))
    assert "duplicate_episode_id" in rules(episodes.episode_violations(eps(spark, {}, {}), two(spark)))


@pytest.mark.parametrize(
    "change,rule",
    [
        ({"action": "reuse_repair"}, "reuse_without_card"), ({"experience_card_version": "c@1"}, "card_without_reuse"), ({"executed_queries": ["a", "b"]}, "not_one_query"), ({"executed_queries": [" "]}, "executed_queries_invalid"),
        ({"evidence": [("d", "x", 1, 0.1), ("d", "x", 2, 0.1)]}, "duplicate_evidence"), ({"evidence": [("d", "x", 0, 0.1)]}, "evidence_rank_invalid"), ({"evidence": [("d", "x", 1, float("nan"))]}, "retrieval_score_invalid"), ({"gap_ids": ["g", "g"]}, "duplicate_gap_ids"),
        ({"sufficiency": "sufficient"}, "sufficient_with_gaps"), ({"duplicate_ratio": 1.1}, "duplicate_ratio_invalid"), ({"latency_ms": -1.0}, "latency_invalid"), ({"input_tokens": -1}, "input_tokens_negative"), ({"action": "zz"}, "unknown_action"), ({"operator": ""}, "blank_operator"),
    ],
)
def test_turn_rules(spark, change, rule):
    assert rule in rules(episodes.turn_violations(turns(spark, {"episode_id": "e"} | change)))


EVENT = dict(verification_id="v", episode_id="e", target="paired_benefit", source="gold", metric_id="m", verdict="pass", created_at="t", score=0.8, direct_baseline_episode_ref="b", baseline_score=0.1, treatment_score=0.9, quality_threshold=0.5)


def events(spark, *rows):
    return frame(spark, EVENTS, rows or [{}], EVENT)


@pytest.mark.parametrize(
    "change,rule",
    [
        ({}, None), ({"direct_baseline_episode_ref": None}, "paired_without_baseline"), ({"baseline_score": None}, "paired_without_scores"), ({"score": 0.7}, "paired_score_not_gain"), ({"verdict": "fail"}, "verdict_contradicts_scores"), ({"target": "answer"}, "paired_fields_on_other_target"),
        ({"metric_id": " "}, "blank_metric_id"), ({"source": "x"}, "unknown_source"), ({"treatment_score": float("inf")}, "treatment_score_not_finite"),
    ],
)
def test_event_rules(spark, change, rule):
    found = rules(episodes.event_violations(events(spark, change)))
    assert (rule in found) if rule else not found


def archive(spark, baseline=None):
    e = eps(spark, {}, {"episode_id": "b", "terminal_reason": "baseline_complete", "final_evidence": []} | (baseline or {}))
    t = two(spark).union(turns(spark, {"episode_id": "b", "next_action": "answer", "gap_ids": []}))
    return e, t


@pytest.mark.parametrize(
    "event,baseline,rule",
    [
        ({}, {}, None), ({"direct_baseline_episode_ref": "e"}, {}, "paired_with_itself"), ({"episode_id": "b", "direct_baseline_episode_ref": "e"}, {}, "baseline_not_direct"), ({"episode_id": "b", "direct_baseline_episode_ref": "e"}, {}, "treatment_without_repair"),
        ({}, {"original_query": "z"}, "queries_differ"), ({}, {"run_context_id": "z"}, "contexts_differ"), ({}, {"comparison_group_id": "z"}, "comparison_groups_differ"), ({"episode_id": "zz"}, {}, "unknown_episode"), ({"direct_baseline_episode_ref": "zz"}, {}, "unknown_baseline"),
    ],
)
def test_pair_rules(spark, event, baseline, rule):
    e, t = archive(spark, baseline)
    found = rules(episodes.pair_violations(events(spark, event), e, t))
    assert (rule in found) if rule else not found


def test_contexts_sessions_and_append(spark):
    e, t = archive(spark, {"document_session_id": "s"})
    ctx = spark.createDataFrame([("r",)], "run_context_id string")
    base = dict(session_id="s", scope_ref="x", scope_version="1", opened_at="0", frozen_at="1", schema_version="v")
    ok = frame(spark, SESSIONS, [{"episode_ids": ["b"]}], base)
    ledger.append_archive(ctx, e, t, events(spark), ok)
    bad = frame(spark, SESSIONS, [{"episode_ids": ["e", "zz"]}], base)
    assert rules(episodes.session_violations(bad, e)) == {"session_mismatch", "unknown_episode"}
    with pytest.raises(IntegrityError):
        ledger.append_archive(ctx.limit(0), e, t, events(spark), ok)
    old = {"contexts": ctx, "episodes": e, "turns": t, "events": events(spark).limit(0), "sessions": ok.limit(0)}
    assert ledger.extend_archive(old, {"events": events(spark), "sessions": ok})["sessions"].count() == 1
    gap = spark.createDataFrame([("e", 0, "g", "no such category", "x")], "episode_id string, turn_index int, gap_id string, category string, target string")
    with pytest.raises(IntegrityError):
        ledger.extend_archive(old, {"events": events(spark), "gaps": gap})
    assert episodes.verifications_for(events(spark), e, "e").count() == 1
    with pytest.raises(KeyError):
        episodes.verifications_for(events(spark), e, "zz")


CARD = dict(card_id="c", version="1", lifecycle_state="active", created_at="t", verification_tier="gold", verification_event_ids=["v1", "v2"], matched_trials=2, benefit_count=2, neutral_count=0, harm_count=0, direct_correct_trials=1, mean_gain=0.4, source_turns=[("e1", "u1"), ("e2", "u1")],
            canonical_turns=[("e1", "u1")], independent_episode_count=2, independent_document_count=2, parent_versioned_ids=[])


def card(spark, **change):
    return frame(spark, CARDS, [change], CARD)


@pytest.mark.parametrize(
    "change,rule",
    [
        ({}, None), ({"benefit_count": 1}, "counts_do_not_add_up"), ({"verification_event_ids": ["v1"]}, "events_do_not_cover_trials"), ({"direct_correct_trials": 3}, "direct_correct_above_trials"), ({"harm_count": 2, "benefit_count": 0}, "harm_above_direct_correct"),
        ({"mean_gain": float("nan")}, "mean_gain_not_finite"), ({"source_turns": []}, "no_source_turns"), ({"canonical_turns": [("e9", "u")]}, "canonical_not_in_sources"), ({"mean_gain": 0.0}, "active_without_benefit"), ({"verification_tier": "proxy"}, "active_against_policy"),
        ({"direct_correct_trials": 0}, "active_against_policy"), ({"independent_document_count": 0}, "no_independent_document"), ({"version": " "}, "blank_version"),
    ],
)
def test_card_rules(spark, change, rule):
    found = rules(cards.card_violations(card(spark, **change)))
    assert (rule in found) if rule else not found


def test_policy_messages_in_order(spark):
    c = card(spark, verification_tier="proxy", independent_episode_count=1, independent_document_count=1, matched_trials=1, benefit_count=0, neutral_count=0, harm_count=1, direct_correct_trials=1, mean_gain=-0.1)
    assert c.select(cards.policy_failures()).first()[0] == [
        "verification tier is not allowed", "too few independent episodes", "too few independent documents", "too few matched trials", "too few beneficial transfers", "conditional harm exceeds the serving ceiling", "mean paired gain is not positive",
    ]
    assert card(spark).select(cards.policy_failures(CardActivationPolicy(max_conditional_harm_rate=0.0))).first()[0] == []


def registry(spark):
    t = turns(spark, *[{"episode_id": e} | LAST | {"action": "reuse_repair", "experience_card_version": "z@1", "evidence": [(d, "x", 1, 0.5)]} for e, d in (("e1", "d1"), ("e2", "d2"))], {"episode_id": "e3"})
    v = events(spark, {"verification_id": "v1", "episode_id": "e1", "baseline_score": 0.5, "treatment_score": 0.9, "score": 0.4}, {"verification_id": "v2", "episode_id": "e2", "baseline_score": 0.3, "treatment_score": 0.7, "score": 0.4})
    return v, t


@pytest.mark.parametrize(
    "change,rule",
    [
        ({}, None), ({"parent_versioned_ids": ["x@1"]}, "unknown_parent"), ({"verification_event_ids": ["v1", "zz"]}, "unknown_event"), ({"mean_gain": 0.5}, "mean_gain_differs_from_events"), ({"direct_correct_trials": 2}, "counts_differ_from_events"),
        ({"source_turns": [("e1", "u1"), ("e9", "u1")]}, "unknown_source_turn"), ({"source_turns": [("e3", "u0")]}, "source_turn_is_base"), ({"source_turns": [("e3", "u0")]}, "source_without_benefit"), ({"independent_episode_count": 3}, "episode_count_differs"),
        ({"independent_document_count": 1}, "document_count_differs"), ({"verification_event_ids": []}, "no_events"),
    ],
)
def test_registry_rules(spark, change, rule):
    v, t = registry(spark)
    found = rules(cards.registry_violations(card(spark, **change), v, t))
    assert (rule in found) if rule else not found


def test_registry_tiers_and_register(spark):
    v, t = registry(spark)
    assert "sources_do_not_support_tier" in rules(cards.registry_violations(card(spark), v.withColumn("source", F.lit("judge")), t))
    assert "trials_not_independent" in rules(cards.registry_violations(card(spark), v.withColumn("episode_id", F.lit("e1")), t))
    assert "event_not_paired" in rules(cards.registry_violations(card(spark), v.withColumn("target", F.lit("answer")), t))
    none = card(spark).limit(0)
    assert ledger.register_cards(none, card(spark), v, t).count() == 1
    with pytest.raises(IntegrityError):
        ledger.register_cards(card(spark), card(spark), v, t)


def test_card_specifications(spark):
    from tallyforge.operators import cards as card_ops

    shape = "card_id string, version string, activation struct<stage string, query_pattern string, gap_pattern string, preconditions array<string>, contraindications array<string>, required_retriever_capabilities array<string>>, repair struct<operator_type string, slot_template string, evidence_contract string>"
    good = ("c", "1", ("pre_retrieval", "q", "g", ["a"], [], []), ("o", "s", "e"))
    bad = ("d", "1", ("later", " ", "g", ["a", " a "], [""], []), ("o", None, "e"))
    found = {(r["key"], r["rule"]) for r in card_ops.specification_violations(spark.createDataFrame([good, bad], shape)).collect()}
    assert found == {("d@1", x) for x in ("unknown_activation_stage", "blank_query_pattern", "preconditions_invalid", "contraindications_invalid", "blank_slot_template")}


def test_lifecycle_policy_asks_no_more_benefits_than_observations():
    from tallyforge.policies import LifecyclePolicy

    with pytest.raises(ValueError):
        LifecyclePolicy(promotion_min_observations=1, promotion_min_benefits=5)


def test_listings_are_in_order(spark):
    tables = {"episodes": eps(spark, {"episode_id": "b"}, {"episode_id": "a"}, {"episode_id": "B"}), "cards": spark.createDataFrame([("c", "2"), ("b", "10"), ("c", "10")], "card_id string, version string")}
    assert [r.episode_id for r in ledger.listing(tables, "episodes").collect()] == ["B", "a", "b"]
    assert [(r.card_id, r.version) for r in ledger.listing(tables, "cards").collect()] == [("b", "10"), ("c", "10"), ("c", "2")]


def sound_archive(spark):
    e, t = archive(spark, {"document_session_id": "s"})
    ctx = spark.createDataFrame([("r",)], "run_context_id string")
    base = dict(session_id="s", scope_ref="x", scope_version="1", opened_at="0", frozen_at="1", schema_version="v")
    return {"contexts": ctx, "episodes": e, "turns": t, "events": events(spark), "sessions": frame(spark, SESSIONS, [{"episode_ids": ["b"]}], base)}


@pytest.mark.parametrize("name", ["contexts", "episodes", "events", "sessions"])
def test_what_is_there_is_refused(spark, name):
    old = sound_archive(spark)
    with pytest.raises(IntegrityError, match="duplicate_"):
        ledger.extend_archive(old, {name: old[name].limit(1)})


def test_appends_check_what_they_touch(spark):
    old = sound_archive(spark)
    new = {"events": events(spark, {"verification_id": "v9"})}
    part = ledger.touched_archive(old, new)
    assert {r.episode_id for r in part["episodes"].collect()} == {"e", "b"} and part["sessions"].count() == 0 and [r.verification_id for r in part["events"].collect()] == ["v9"]
    assert ledger.extend_archive(old, new)["events"].count() == 2
    with pytest.raises(IntegrityError, match="unknown_episode"):
        ledger.extend_archive(old, {"events": events(spark, {"verification_id": "v9", "episode_id": "zz"})})
    # more turns of a baseline make it none, which an event of the archive relies on
    with pytest.raises(IntegrityError):
        ledger.extend_archive(old, {"turns": turns(spark, {"episode_id": "b", "turn_index": 1, "turn_id": "u1", "action": "fresh_repair"})})


def test_new_card_versions_name_registered_parents(spark):
    v, t = registry(spark)
    child = card(spark, card_id="d", parent_versioned_ids=["c@1"])
    assert ledger.register_cards(card(spark), child, v, t).count() == 2
    with pytest.raises(IntegrityError, match="unknown_parent"):
        ledger.register_cards(card(spark).limit(0), child, v, t)
    with pytest.raises(IntegrityError, match="duplicate_versioned_id"):
        ledger.register_cards(card(spark).limit(0), child.unionByName(child), v, t)
