"""Registered queries of the library's operators over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import CURRENT, environment_struct, parts, relation
from .functions import scores as sc
from .functions import text as tx
from .operators import applicability, cards, environment, episodes, evidence_checks, gate, oracle, portfolio, recall, reliability, selective
from .plans.decide import apply_plans, decide_batch, prepare, with_plans
from .plans.ledger import Ledger
from .policies import EnvironmentPolicy, GatePolicy, LifecyclePolicy, PlanApplication, PortfolioPolicy, QueryBudget
from .schemas import ENVIRONMENT_FIELDS, ORACLE_ROWS
from .sources.oracle_csv import read_oracle_csv
from .sources.requests import read_plan_bundle, read_requests
from .sources.sinks import json_lines, write_joined, write_jsonl_file
from .sources.snapshot import read_snapshot, write_snapshot
from .storage import file_system, shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LIFECYCLE = LifecyclePolicy(quarantine_at_harm_count=3)
PORTFOLIO = PortfolioPolicy(capacity=20, half_life_steps=10.0, minimum_priority=0.01)
TIERED = EnvironmentPolicy("tiered", 0.80, 0.10)
GATE = GatePolicy(maximum_risk_upper_bound=0.70)
BUDGET = QueryBudget(max_query_characters=400)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r9(c: Column | str) -> Column:
    return F.round(c, 9)


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r9(c).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("int", "bigint") else F.col(c) for c, k in df.dtypes])


def counted(v: DataFrame) -> DataFrame:
    """Violations as a table of its own: every (rule, key), repeated ones counted."""
    return v.toDF("rule", "key").groupBy("rule", "key").agg(F.count("*").alias("n"))


@query
def paired_outcomes(spark, d):
    o = relation(spark, d, "observations")
    return reliability.label_pairs(o, F.col("good_threshold")).select("target_query_id", "experience_id", F.col("seq").cast("long").alias("seq"), "outcome", "difference")


@query
def oracle_targets(spark, d):
    t = oracle.per_target(relation(spark, d, "oracle_rows"))
    return rounded(t.withColumn("candidate_ranks_evaluated", joined(F.col("candidate_ranks_evaluated").cast("array<string>"))))


@query
def oracle_summary(spark, d):
    return rounded(oracle.summary(relation(spark, d, "oracle_rows")))


@query
def oracle_violations(spark, d):
    return counted(oracle.violations(relation(spark, d, "raw_oracle_rows")))


@query
def oracle_rule_breaks(spark, d):
    """Candidate-set rows with every rule broken somewhere: blanks, nulls, negatives, unequal budgets and half-given scores."""
    return counted(oracle.violations(relation(spark, d, "planted_oracle_rows")))


@query
def reliability_summary(spark, d):
    return rounded(reliability.reliability(relation(spark, d, "observations"), relation(spark, d, "sources")))


@query
def wilson_bound(spark, d):
    o = relation(spark, d, "oracle_rows").groupBy("experience_id").agg(F.count("*").alias("n"), F.count_if(F.col("reuse_score") < 0.25).alias("k"))
    return rounded(o.withColumn("bound", sc.wilson_upper(F.col("k"), F.col("n"))))


@query
def lifecycle(spark, d):
    return rounded(reliability.lifecycle_state(relation(spark, d, "observations"), LIFECYCLE))


@query
def lifecycle_default(spark, d):
    return rounded(reliability.lifecycle_state(relation(spark, d, "observations")))


@query
def state_histogram(spark, d):
    return reliability.state_histogram(reliability.lifecycle_state(relation(spark, d, "observations"), LIFECYCLE))


@query
def write_gate(spark, d):
    return rounded(reliability.write_gate(relation(spark, d, "sources"), 0.0).select("experience_id", "state", "gain"))


@query
def transfer_violations(spark, d):
    return counted(evidence_checks.transfer_violations(relation(spark, d, "observations"), relation(spark, d, "sources")))


@query
def record_violations(spark, d):
    return counted(evidence_checks.record_violations(relation(spark, d, "sources"), relation(spark, d, "observations"), LIFECYCLE))


def _evidence(spark, d):
    """(candidates that pass the write gate, legal observations of them)."""
    sources, o = relation(spark, d, "sources"), relation(spark, d, "observations")
    admitted = written(reliability.write_gate(sources).select(sources.columns), "sources")
    o = written(o.join(admitted.select("experience_id"), "experience_id", "left_semi").select(o.columns), "observations")
    broken = evidence_checks.transfer_violations(o, sources).select("key").distinct()
    return admitted, written(o.withColumn("key", F.concat_ws("/", "experience_id", "seq")).join(broken, "key", "left_anti").select(o.columns), "legal")


@query
def ledger_ingest(spark, d):
    """A ledger grown in steps: candidates through the write gate, legal observations in two batches, retirements; then its totals."""
    sources = relation(spark, d, "sources")
    admitted, legal = _evidence(spark, d)
    retired = sources.where("state = 'retired'").join(admitted, "experience_id", "left_semi")
    ledger = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", sources.schema, legal.schema, LIFECYCLE, buckets=8)
    ledger.add_candidates(sources.where("evidence_role <> 'test'"))
    ledger.record_transfers(legal.where("seq <= 5"), 0)
    ledger.record_transfers(legal.where("seq > 5"), 1)
    ledger.retire(retired)
    return rounded(ledger.totals().select("experience_id", "state", "n", "benefit", "harm", "both_good", "gain"))


def _file(spark, name):
    """A path in the shared folder for a file that a query writes and reads; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return path


@query
def source_oracle_csv(spark, d):
    """Candidate sets as one quoted CSV file, some ids of several lines, read back in splits and checked."""
    i = F.col("target_query_id")
    rows = relation(spark, d, "oracle_rows").withColumn("target_query_id", F.when(i.cast("long") % 7 == 0, F.concat(F.lit('of "two"\nlines '), i)).otherwise(i))
    columns = [f.name for f in ORACLE_ROWS]
    line = F.to_csv(F.struct(*columns), {"quoteAll": "true", "escape": '"'})
    path = _file(spark, "candidates.csv")
    write_joined(rows.select("target_query_id", "candidate_rank", line.alias("value")), path, ["target_query_id", "candidate_rank"], "\n", head=",".join(columns) + "\n", tail="\n")
    return rounded(read_oracle_csv(spark, path))


@query
def source_requests(spark, d):
    """All documents as requests in one file of JSON lines, read back and checked."""
    known = {"signature_extractor_id": "x", "signature_extractor_version": "1", "signature_input_scope": "query_only"}
    rows = _requests(spark, d).select("target_query_id", F.concat(F.lit("q "), F.coalesce("target_query", F.lit(""))).alias("target_query"), "signatures", *[F.lit(v).alias(k) for k, v in known.items()])
    path = _file(spark, "requests.jsonl")
    write_jsonl_file(rows, path, ["target_query_id"])
    return read_requests(spark, path).select("target_query_id", F.md5("target_query").alias("query_md5"), F.length("target_query").cast("long").alias("n_chars"), joined(F.array_sort("signatures")).alias("signatures"), "signature_input_scope")


@query
def source_plan_bundle(spark, d):
    """A plan for every document in one bundle, read back and checked."""
    rows = relation(spark, d, "plans")
    path = _file(spark, "plans.json")
    write_joined(rows.select("target_query_id", json_lines(rows).alias("value")), path, ["target_query_id"], ",", head='{"schema_version":1,"applier_id":"precomputed-plan","application_version":"v1","plans":[', tail="]}\n")
    bundle = read_plan_bundle(spark, path)
    return bundle.plans.select("*", F.lit(bundle.applier_id).alias("applier_id"), F.lit(bundle.application_version).alias("application_version"))


@query
def source_snapshot(spark, d):
    """A memory with its evidence as one canonical document, read back with all its rules checked."""
    admitted, legal = _evidence(spark, d)
    states = reliability.lifecycle_state(legal, LIFECYCLE).select("experience_id", F.col("state").alias("_state"))
    none = F.array().cast("array<string>")
    gain = F.col("reuse_score") - F.col("direct_score")
    said = {"source_query": F.concat(F.lit("query of "), "experience_id"), "transformed_query": F.lit("a; b"), "atomic_units": F.array(F.lit("x")), "environment": F.struct(*[F.lit(CURRENT[f]).alias(f) for f in ENVIRONMENT_FIELDS]), "provenance": F.lit("log"), "transformation_type": F.lit("t"), "application_note": F.lit("")}
    more = {"applicability_signature": F.array(F.lit("a")), "diagnosed_failure": F.lit("f"), "gap_categories": F.array(F.lit("attribute")), "contraindication_signature": none, "stored_dataset_id": F.lit("unset"), "metric_protocol_id": F.col("source_metric_protocol_id"), "applier_id": F.col("source_applier_id"), "applier_version": F.col("source_applier_version")}
    records = admitted.join(states, "experience_id", "left").withColumns({**said, **more, "state": F.coalesce("_state", F.lit("candidate")), "gain": gain, "passes_paired_write_gate": gain > F.col("minimum_gain")})
    observations = reliability.label_pairs(legal.withColumn("split", F.lit("cal")), F.col("good_threshold")).withColumnRenamed("difference", "gain")
    path = _file(spark, "memory.json")
    write_snapshot(records, observations, "m1", LIFECYCLE, path)
    back = read_snapshot(spark, path)
    seen = back.observations.groupBy("experience_id").agg(F.count("*").alias("n"), F.sum("gain").alias("gain"), F.count_if(F.col("outcome") == "direct_bad_reuse_good").alias("benefit"))
    return rounded(back.records.select("experience_id", "state", "source_query_id", F.col("gain").alias("source_gain")).join(seen, "experience_id", "left").fillna(0))


def _portfolio_inputs(spark, d):
    o = relation(spark, d, "observations")
    states = reliability.lifecycle_state(o, LIFECYCLE).select("experience_id", "state")
    known = states.select("experience_id")
    a = relation(spark, d, "activities").where("last_validated_step is not null").join(known, "experience_id", "left_semi")
    return reliability.reliability(o).join(states, "experience_id"), a


@query
def portfolio_scores(spark, d):
    return rounded(portfolio.scores(*_portfolio_inputs(spark, d), 30, PORTFOLIO))


@query
def portfolio_partition(spark, d):
    return rounded(portfolio.partition(*_portfolio_inputs(spark, d), 30, PORTFOLIO).fillna(0, ["hot_rank"]))


@query
def tier_violations(spark, d):
    """A stored partition with tiers that overlap, lack records, hold foreign ones or contradict their ranks."""
    return counted(portfolio.partition_violations(relation(spark, d, "stored_tiers"), relation(spark, d, "tier_records"), PORTFOLIO))


@query
def activity_violations(spark, d):
    return counted(portfolio.activity_violations(relation(spark, d, "activities"), relation(spark, d, "sources"), 29))


def _env(spark, d, policy):
    e = relation(spark, d, "environments").select("experience_id", environment_struct().alias("e"))
    cur = F.struct(*[F.lit(CURRENT[f]).alias(f) for f in ENVIRONMENT_FIELDS])
    m = environment.match(e, cur, policy, "e")
    return rounded(m.select("experience_id", "environment_compatible", "environment_score", joined("environment_hard_mismatches").alias("hard"), joined("environment_soft_mismatches").alias("soft")))


@query
def env_strict(spark, d):
    return _env(spark, d, EnvironmentPolicy())


@query
def env_tiered(spark, d):
    return _env(spark, d, TIERED)


@query
def token_jaccard(spark, d):
    """Every document against one item of the benchmark, all items in turn (id modulo their number). An item's words are cut once, not for each document."""
    b = relation(spark, d, "memory").select("item_id", tx.words(F.col("source_query")).alias("held"))
    n = F.broadcast(b.agg(F.greatest(F.max("item_id") + 1, F.lit(1)).alias("n")))
    t = relation(spark, d, "requests").join(n).withColumn("item_id", F.substring("target_query_id", 2, 20).cast("long") % F.col("n"))
    return rounded(t.join(b, "item_id").select("target_query_id", tx.jaccard(tx.words(F.col("target_query")), F.col("held")).alias("score")))


@query
def recall_topm(spark, d):
    return rounded(recall.recall_top_m(relation(spark, d, "requests"), relation(spark, d, "memory"), 5))


@query
def applicability_coverage(spark, d):
    s = relation(spark, d, "signatures")
    c = applicability.coverage(F.array_distinct(tx.normalize_signatures(parts("required"))), parts("observed"), parts("contra"))
    return rounded(s.select("id", c["applicability_score"].alias("score"), joined(c["applicability_matched_signatures"]).alias("matched"), joined(c["applicability_matched_contraindications"]).alias("vetoes"), c["applicability_missing_features"].alias("missing")))


def _memory(spark, d):
    rel = reliability.reliability(relation(spark, d, "memory_observations"), relation(spark, d, "memory"))
    env = F.struct(*[(F.col("corpus_id") if f == "corpus_id" else F.lit(CURRENT[f])).alias(f) for f in ENVIRONMENT_FIELDS])
    return (
        relation(spark, d, "memory").join(rel, "experience_id").withColumn("environment", env).withColumn("applicability_signature", F.array_distinct(parts("required"))).withColumn("contraindication_signature", parts("contra"))
        .withColumns({"applier_id": F.lit("precomputed-plan"), "applier_version": F.when(F.col("item_id") % 13 == 0, "v2").otherwise("v1")})
    )


def _requests(spark, d):
    return relation(spark, d, "requests").withColumn("signatures", F.array_distinct(parts("signatures")))


def _recalled(spark, d, memory):
    return recall.recall_top_m(_requests(spark, d), memory.where("state = 'active' and corpus_id = 'wiki'"), 5)


def _plans(spark, d, recalled):
    """Plans for three of four recalled pairs; some blank, some unchanged, some long."""
    k = F.substring("target_query_id", 2, 20).cast("long") + F.substring("experience_id", 2, 20).cast("long")
    rows = recalled.withColumn("k", k).where("k % 4 <> 0").join(_requests(spark, d).select("target_query_id", "target_query"), "target_query_id")
    text = F.when(F.col("k") % 7 == 0, F.col("target_query")).when(F.col("k") % 5 == 0, "  ").when(F.col("k") % 11 == 0, F.rpad(F.lit("x"), 500, "x")).otherwise(F.concat(F.lit(" plan "), F.col("k").cast("string")))
    return rows.select("target_query_id", "experience_id", text.alias("transformed_query"))


def _decide(spark, d):
    """Decisions whose plans are derived from the recalled pairs. Memory and pairs, which both sides read, are written once."""
    m = written(_memory(spark, d), "memory")
    r = written(_recalled(spark, d, m), "recalled")
    return decide_batch(m, _requests(spark, d), _plans(spark, d, r), CURRENT, gate=GATE, budget=BUDGET, environment_policy=EnvironmentPolicy(), application=PlanApplication(), max_candidates=5, recall=lambda *_: r)


@query
def plan_reasons(spark, d):
    """Reasons against plans alone, over all recalled pairs."""
    m, r = written(_memory(spark, d), "memory"), _requests(spark, d)
    recalled = written(_recalled(spark, d, m), "recalled")
    p = prepare(with_plans(recalled.join(m, "experience_id"), _plans(spark, d, recalled)).join(r.select("target_query_id", "target_query"), "target_query_id"))
    why = gate.plan_reasons(F.col("prepared"), F.col("experience_id"), F.col("target_query_id"), F.col("target_query"), F.col("applier_id"), F.col("applier_version"), BUDGET)
    return p.select("target_query_id", "experience_id", joined(why).alias("reasons"))


@query
def gate_traces(spark, d):
    t = _decide(spark, d).traces
    return rounded(
        t.select("target_query_id", "experience_id", F.col("recall_rank").cast("long").alias("recall_rank"), "reliability_observations", "reliability_mean_gain", "risk_upper_bound", "applicability_score", "passed", "semantic_intent_valid", joined("rejection_reasons").alias("reasons"))
    )


@query
def gate_decisions(spark, d):
    return _decide(spark, d).decisions.select("target_query_id", "intended_action", "intended_experience_id", "executed_action", "executed_experience_id", F.md5("executed_query").alias("query_md5"), "reason")


class SharedSignatures:
    """A recall hook: the share of a request's signatures that a record requires, a word index of signatures instead of words."""

    scorer_id = "shared-signatures"

    def __call__(self, requests, records, m):
        asked = requests.select("target_query_id", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
        held = records.select("experience_id", F.explode("applicability_signature").alias("s"))
        met = asked.join(held, "s").groupBy("target_query_id", "experience_id").agg((F.count("*") / F.max("n")).alias("recall_score"))
        return recall.rank_scored(met, m)


@query
def hooked_decisions(spark, d):
    """Decisions with recall, scorer and applier given by the caller: shared signatures, one fit for all, a plan for every pair."""
    m = written(_memory(spark, d), "memory")
    fit = lambda required, observed, contra: applicability.coverage(required, observed, contra) | {"applicability_score": F.lit(0.75), "applicability_scorer_id": F.lit("always")}
    plan = lambda pairs: apply_plans(pairs, pairs.select("target_query_id", "experience_id", F.concat(F.lit("rewrite for "), "experience_id").alias("transformed_query")), PlanApplication())
    out = decide_batch(m, _requests(spark, d), None, CURRENT, gate=GATE, budget=BUDGET, max_candidates=4, recall=SharedSignatures(), scorer=fit, applier=plan)
    t = out.traces.select("target_query_id", "experience_id", F.col("recall_rank").cast("long").alias("recall_rank"), "passed", joined("rejection_reasons").alias("reasons"))
    won = out.decisions.select("target_query_id", "executed_experience_id", "reason", F.lit(out.recall_scorer_id).alias("recall_scorer_id"))
    return t.join(won, "target_query_id")


HOT = PortfolioPolicy(capacity=60, half_life_steps=10.0, minimum_priority=0.001)


@query
def hot_recall(spark, d):
    """Recall among the hot records of the current environment only, as decide_batch finds them."""
    m = written(_memory(spark, d), "memory")
    known = relation(spark, d, "memory_activities").where("last_validated_step is not null").join(m.select("experience_id"), "experience_id", "left_semi")
    none = spark.createDataFrame([], "target_query_id string, experience_id string, transformed_query string")
    out = decide_batch(m, _requests(spark, d), none, CURRENT, gate=GATE, budget=BUDGET, max_candidates=5, activities=known, current_step=30, portfolio_policy=HOT)
    return rounded(out.recalled)


POINTS = [(0, 0.0, 1.0), (1, 0.25, 0.8), (2, 0.5, 0.7), (3, 0.5, 0.55), (4, 1.0, 0.7)]


def _selective(spark, d):
    t = _decide(spark, d).traces
    k = F.substring("target_query_id", 2, 20).cast("long")
    return t.withColumns({"direct_score": (k % 9) / F.lit(8.0), "reuse_score": ((k + F.substring("experience_id", 2, 20).cast("long")) % 9) / F.lit(8.0), "good_threshold": F.lit(0.5)})


@query
def selective_sweep(spark, d):
    points = spark.createDataFrame(POINTS, "op_seq int, minimum_applicability double, maximum_risk_upper_bound double")
    return rounded(selective.sweep(_selective(spark, d), points, relation(spark, d, "requests").select("target_query_id")))


@query
def selective_pairs(spark, d):
    """What each operating point chooses, one row a pair."""
    points = spark.createDataFrame(POINTS, "op_seq int, minimum_applicability double, maximum_risk_upper_bound double")
    out = selective.sweep(_selective(spark, d), points, relation(spark, d, "requests").select("target_query_id"), selected_pairs=True)
    return out.select(F.col("op_seq").cast("long").alias("op_seq"), F.explode("selected_pairs").alias("p")).select("op_seq", "p.*")


@query
def selective_violations(spark, d):
    """Candidates of two rows per pair of a part of the oracle rows' shape, against a universe that lacks some."""
    c = relation(spark, d, "raw_oracle_rows").withColumnRenamed("candidate_rank", "recall_rank").withColumn("good_threshold", F.lit(0.5))
    u = relation(spark, d, "oracle_rows").select("target_query_id").distinct().where("cast(target_query_id as long) % 101 <> 0")
    return counted(selective.violations(c, u))


def _turns(spark, d):
    t = relation(spark, d, "turns")
    ev = F.array(F.struct(F.col("episode_id").alias("doc_id"), F.col("turn_id").alias("unit_id"), F.lit(1).alias("rank"), F.lit(1.0).alias("retrieval_score")))
    n = F.col("n_text")
    return t.withColumns(
        {
            "executed_queries": F.when(n % 9 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))), "target_gap_ids": parts("targets"), "gap_ids": parts("gaps"), "evidence": ev, "duplicate_ratio": (n % 10) / F.lit(8.0),
            "new_evidence_count": n % 5 - F.lit(0), "retrieval_calls": F.lit(1), "input_tokens": n.cast("long"), "output_tokens": n.cast("long") - 20, "latency_ms": F.lit(1.0),
        }
    )


def _episodes(spark, d):
    e = relation(spark, d, "episodes")
    last = F.array(F.struct(F.col("episode_id").alias("doc_id"), F.when(F.col("episode_id").cast("long") % 9 == 0, "u99").otherwise("u0").alias("unit_id")))
    return e.withColumns({"final_evidence": last, "opened_at": F.lit("t0"), "frozen_at": F.lit("t1"), "schema_version": F.lit("v0")})


@query
def turn_violations(spark, d):
    return counted(episodes.turn_violations(_turns(spark, d)))


@query
def episode_violations(spark, d):
    return counted(episodes.episode_violations(_episodes(spark, d), _turns(spark, d)))


def _events(spark, d):
    return relation(spark, d, "events").withColumns({"metric_id": F.lit("f1"), "created_at": F.lit("t")})


@query
def event_violations(spark, d):
    return counted(episodes.event_violations(_events(spark, d)))


@query
def paired_verdicts(spark, d):
    return rounded(cards.with_verdicts(_events(spark, d)).select("verification_id", "expected_verdict", "paired_gain", "baseline_is_correct"))


@query
def pair_violations(spark, d):
    return counted(episodes.pair_violations(_events(spark, d), _episodes(spark, d), _turns(spark, d)))


@query
def episode_verifications(spark, d):
    """Verification events of one episode."""
    return episodes.verifications_for(_events(spark, d), _episodes(spark, d), "7").select("verification_id", "target", "source", "verdict", "score")


@query
def context_violations(spark, d):
    c = spark.createDataFrame([("rc0",), ("rc1",), ("rc1",)], "run_context_id string")
    return counted(episodes.context_violations(_episodes(spark, d), c))


@query
def session_violations(spark, d):
    """Four sessions that each claim the episodes of a residue class, right and wrong ones."""
    e = _episodes(spark, d)
    k = F.col("episode_id").cast("long")
    ids = e.withColumn("session_id", F.concat(F.lit("s"), (k % 5).cast("string"))).groupBy("session_id").agg(F.array_sort(F.collect_list("episode_id")).alias("episode_ids"))
    s = ids.withColumns({x: F.lit("x") for x in ("scope_ref", "scope_version", "opened_at", "frozen_at", "schema_version")})
    return counted(episodes.session_violations(s, e))


def _cards(spark, d):
    ref = lambda n: F.array(F.struct((F.substring("card_id", 2, 20).cast("long") % 60).cast("string").alias("episode_id"), F.lit(n).alias("turn_id")))
    return relation(spark, d, "cards").withColumns({"created_at": F.lit("t"), "verification_event_ids": parts("event_ids"), "source_turns": ref("u1"), "canonical_turns": ref("u1"), "parent_versioned_ids": F.when(F.substring("card_id", 2, 20).cast("long") % 6 == 0, F.array(F.lit("c1@1"), F.lit("zz@1"))).otherwise(F.array().cast("array<string>"))})


@query
def card_policy_failures(spark, d):
    return _cards(spark, d).select("card_id", joined(cards.policy_failures()).alias("failures"), r9(cards.conditional_harm_rate(F.col("harm_count"), F.col("direct_correct_trials"))).alias("harm_rate"))


@query
def card_violations(spark, d):
    return counted(cards.card_violations(_cards(spark, d)))


@query
def card_statistics(spark, d):
    return rounded(cards.recomputed_statistics(_cards(spark, d), _events(spark, d)))


@query
def registry_violations(spark, d):
    return counted(cards.registry_violations(_cards(spark, d), _events(spark, d), _turns(spark, d)))


@query
def normal_forms(spark, d):
    """Signature, gap and text normal forms of names with odd spacing."""
    p = relation(spark, d, "signatures")
    odd = F.concat(F.lit(" \t"), F.upper("required"), F.lit(" - X  y\n"))
    return p.select("id", tx.normalize_signature(odd).alias("signature"), tx.normalize_gap(odd).alias("gap"), tx.normalize_text(odd).alias("text"), tx.is_unspecified(F.when(F.col("id") % 3 == 0, " UnKnown ").otherwise(F.col("required"))).alias("unspecified"))
