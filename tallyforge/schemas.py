"""Vocabularies and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Closed vocabularies of the data model.
ACTIONS = ("direct", "reuse", "fresh")
BENEFIT, HARM = "direct_bad_reuse_good", "direct_good_reuse_bad"
BOTH_GOOD, BOTH_BAD = "direct_good_reuse_good", "direct_bad_reuse_bad"
STATES = ("candidate", "active", "quarantine", "retired")
EVIDENCE_ROLES = ("development", "calibration", "test")
DECISION_REASONS = ("reuse_selected", "no_candidates", "no_eligible_experience", "invalid_query_plan_fallback")
EPISODE_ACTIONS = ("base", "reuse_repair", "fresh_repair")
NEXT_ACTIONS = ("answer", "reuse_repair", "fresh_repair", "stop_abstain")
SUFFICIENCY = ("sufficient", "insufficient", "unknown")
GAP_CATEGORIES = ("bridge_entity", "attribute", "relation", "evidence_span", "other")
EPISODE_GAP_CATEGORIES = ("bridge_entity", "attribute", "relation", "evidence_span", "contradiction", "other")
TERMINAL_REASONS = ("sufficient", "baseline_complete", "no_progress", "budget", "risk_reject", "error")
VERIFICATION_TARGETS = ("answer", "evidence", "paired_benefit")
VERIFICATION_SOURCES = ("gold", "human", "judge", "proxy")
VERDICTS = ("pass", "fail", "uncertain")
CARD_STATES = STATES
ACTIVATION_STAGES = ("pre_retrieval", "post_retrieval")
TIERS = ("gold", "human", "multi_judge", "proxy")
TIER_SOURCES = {"gold": ("gold",), "human": ("gold", "human"), "multi_judge": ("gold", "human", "judge"), "proxy": VERIFICATION_SOURCES}
UNSPECIFIED = ("", "unset", "unspecified", "unknown")

# Environment fields: in strict mode all eight retrieval fields must agree; in tiered mode the first five must.
HARD_FIELDS = ("corpus_id", "corpus_version", "retriever_id", "index_id", "index_version")
SOFT_FIELDS = ("retriever_version", "analyzer_id", "analyzer_version")
RETRIEVAL_FIELDS = ("corpus_id", "corpus_version", "retriever_id", "retriever_version", "index_id", "index_version", "analyzer_id", "analyzer_version")
ENVIRONMENT_FIELDS = ("corpus_id", "corpus_version", "retriever_id", "retriever_version", "rewriter_id", "rewriter_version", "index_id", "index_version", "analyzer_id", "analyzer_version")
RECALL_SCORER, APPLICABILITY_SCORER = "source-query-jaccard-v1", "signature-coverage-v2"


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()
SS = T.ArrayType(S)

ENVIRONMENT = _struct(**dict.fromkeys(ENVIRONMENT_FIELDS, S))
ORACLE_ROWS = _struct(
    target_query_id=S, experience_id=S, memory_snapshot_id=S, candidate_rank=I, direct_score=D, reuse_score=D, retrieval_query_count=I, requested_top_k=I, context_token_budget=I, fresh_score=D
)
SOURCE_EVIDENCE = _struct(direct_score=D, reuse_score=D, dataset_id=S, split=S, source_group_id=S, evidence_role=S, metric_protocol_id=S, applier_id=S, applier_version=S, minimum_gain=D, gain=D, passes_paired_write_gate=B)
OBSERVATION = _struct(
    target_query_id=S, direct_score=D, reuse_score=D, good_threshold=D, dataset_id=S, split=S, target_group_id=S, evidence_role=S, metric_protocol_id=S, applier_id=S, applier_version=S, outcome=S, gain=D
)
TRANSFORMATION = _struct(
    experience_id=S, source_query_id=S, source_query=S, transformed_query=S, atomic_units=SS, environment=ENVIRONMENT, provenance=S, transformation_type=S, application_note=S, applicability_signature=SS,
    source_dataset_id=S, source_split=S, source_group_id=S, diagnosed_failure=S, gap_categories=SS, contraindication_signature=SS,
)
RECORD = _struct(state=S, transformation=TRANSFORMATION, source_evidence=SOURCE_EVIDENCE, transfer_observations=T.ArrayType(OBSERVATION))
ACTIVITIES = _struct(experience_id=S, last_validated_step=L, last_used_step=L)
REQUESTS = _struct(target_query_id=S, target_query=S, signatures=SS, signature_extractor_id=S, signature_extractor_version=S, signature_input_scope=S)
PLANS = _struct(target_query_id=S, experience_id=S, transformed_query=S)
OPERATING_POINTS = _struct(op_seq=I, minimum_applicability=D, maximum_risk_upper_bound=D)
RUN_CONTEXTS = _struct(run_context_id=S)
EPISODES = _struct(
    episode_id=S, run_context_id=S, comparison_group_id=S, original_query=S, opened_at=S, frozen_at=S, document_session_id=S, terminal_reason=S, final_answer_ref=S, final_answer_hash=S, schema_version=S,
    final_evidence=T.ArrayType(_struct(doc_id=S, unit_id=S)),
)
TURNS = _struct(
    episode_id=S, turn_index=I, turn_id=S, action=S, operator=S, executed_queries=SS, target_gap_ids=SS, experience_card_version=S, sufficiency=S, gap_ids=SS, next_action=S,
    evidence=T.ArrayType(_struct(doc_id=S, unit_id=S, rank=I, retrieval_score=D)), duplicate_ratio=D, new_evidence_count=I, retrieval_calls=I, input_tokens=L, output_tokens=L, latency_ms=D,
)
EVENTS = _struct(verification_id=S, episode_id=S, target=S, source=S, metric_id=S, verdict=S, created_at=S, score=D, direct_baseline_episode_ref=S, baseline_score=D, treatment_score=D, quality_threshold=D)
SESSIONS = _struct(session_id=S, scope_ref=S, scope_version=S, episode_ids=SS, opened_at=S, frozen_at=S, schema_version=S)
CARDS = _struct(
    card_id=S, version=S, lifecycle_state=S, created_at=S, verification_tier=S, verification_event_ids=SS, matched_trials=L, benefit_count=L, neutral_count=L, harm_count=L, direct_correct_trials=L, mean_gain=D,
    source_turns=T.ArrayType(_struct(episode_id=S, turn_id=S)), canonical_turns=T.ArrayType(_struct(episode_id=S, turn_id=S)), independent_episode_count=L, independent_document_count=L, parent_versioned_ids=SS,
)

#: Stages of the pipeline at which a card may apply.
ACTIVATION_STAGES = ("pre_retrieval", "post_retrieval")
