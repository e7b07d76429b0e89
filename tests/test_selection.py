import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import applicability, environment, gate, recall, selective
from tallyforge.plans.decide import decide_batch
from tallyforge.policies import EnvironmentPolicy, GatePolicy, PortfolioPolicy, QueryBudget
from tallyforge.schemas import ENVIRONMENT_FIELDS

ENV = {f: f"{f}-1" for f in ENVIRONMENT_FIELDS}


def env(**change):
    return F.struct(*[F.lit(v).alias(k) for k, v in (ENV | change).items()])


@pytest.mark.parametrize(
    "mode,change,ok,score,hard,soft",
    [
        ("strict", {}, True, 1.0, [], []), ("strict", {"rewriter_id": "x", "rewriter_version": "y"}, True, 1.0, [], []), ("strict", {"analyzer_version": "x"}, False, 0.0, ["analyzer_version"], []),
        ("strict", {"index_id": " Unset ", "corpus_id": "z"}, False, 0.0, ["index_id", "corpus_id"], []), ("tiered", {"analyzer_version": "x"}, True, 0.8, [], ["analyzer_version"]),
        ("tiered", {"analyzer_version": "x", "retriever_version": "y"}, False, 0.6, [], ["retriever_version", "analyzer_version"]), ("tiered", {"corpus_version": "x"}, False, 0.0, ["corpus_version"], []), ("tiered", {"analyzer_id": "unknown"}, False, 0.0, ["analyzer_id"], []),
    ],
)
def test_environment(spark, mode, change, ok, score, hard, soft):
    r = spark.range(1).select(*[c.alias(k) for k, c in environment.compatibility(env(**change), env(), EnvironmentPolicy(mode, 0.7, 0.2)).items()]).first()
    assert (r.environment_compatible, r.environment_hard_mismatches, r.environment_soft_mismatches) == (ok, hard, soft)
    assert r.environment_score == pytest.approx(score)


@pytest.mark.parametrize(
    "req,obs,con,score,missing",
    [(["A ", "b"], ["a"], [], 0.5, False), (["a"], ["a"], [], 1.0, False), ([], ["a"], [], 0.0, True), (["a"], [], [], 0.0, True), (["a"], ["a", "x"], ["X"], 0.0, False), (None, None, None, 0.0, True)],
)
def test_applicability(spark, req, obs, con, score, missing):
    df = spark.createDataFrame([(req, obs, con)], "r array<string>, o array<string>, c array<string>")
    r = df.select(*[c.alias(k) for k, c in applicability.coverage(F.col("r"), F.col("o"), F.col("c")).items()]).first()
    assert (r.applicability_score, r.applicability_missing_features) == (score, missing)


def requests(spark, rows):
    return spark.createDataFrame(rows, "target_query_id string, target_query string")


def memory(spark, rows):
    return spark.createDataFrame(rows, "experience_id string, source_query string")


def test_recall_order_ties_and_fill(spark):
    got = recall.recall_top_m(requests(spark, [("t", "alpha beta"), ("u", "")]), memory(spark, [("near", "alpha beta gamma"), ("tie-a", "alpha"), ("exact", "Alpha, beta"), ("a-far", "zzz"), ("blank", "...")]), 4).collect()
    by = {}
    for r in got:
        by.setdefault(r.target_query_id, {})[r.recall_rank] = r.experience_id
    assert by["t"] == {1: "exact", 2: "near", 3: "tie-a", 4: "a-far"}
    assert by["u"] == {1: "blank", 2: "a-far", 3: "exact", 4: "near"}


def test_recall_against_all_pairs(spark):
    rnd = random.Random(5)
    text = lambda: " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 4)))
    t, e = [(f"t{i}", text()) for i in range(40)], [(f"e{i:02}", text()) for i in range(25)]

    def jac(a, b):
        a, b = set(re.findall(r"\w+", a)), set(re.findall(r"\w+", b))
        return 1.0 if not a | b else len(a & b) / len(a | b)

    want = {(x, k + 1): y for x, q in t for k, (_, y) in enumerate(sorted((-jac(q, s), y) for y, s in e)[:5])}
    got = {(r.target_query_id, r.recall_rank): r.experience_id for r in recall.recall_top_m(requests(spark, t), memory(spark, e), 5).collect()}
    assert got == want
    with pytest.raises(ValueError):
        recall.recall_top_m(requests(spark, t), memory(spark, e), 0)


def candidate(spark, **change):
    base = dict(
        target_query_id="t", target_query="who was first", experience_id="e", recall_rank=1, state="active", environment_compatible=True, environment_score=1.0, environment_mode="strict", environment_hard_mismatches=[], environment_soft_mismatches=[],
        provenance="log", reliability_observations=3, reliability_benefits=1, reliability_mean_gain=0.4, risk_upper_bound=0.66, risk_measure="w", applier_id="plan", applier_version="v1", applicability_score=1.0, applicability_scorer_id="s",
        applicability_matched_signatures=["a"], applicability_required_signatures=["a"], applicability_matched_contraindications=[], applicability_missing_features=False, plan="x y",
        p_experience="e", p_target="t", p_query="who was first", generated_by="plan", application_version="v1", retrieval_query_count=1, requested_top_k=5, context_token_budget=100, estimated_cost=0.0,
    ) | change
    kinds = {bool: "boolean", int: "int", float: "double", str: "string", list: "array<string>", type(None): "string"}
    typed = {k: ("double" if k in ("applicability_score", "estimated_cost") else kinds[type(v)]) for k, v in base.items()}
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {t}" for k, t in typed.items()))
    p = F.struct(
        F.col("p_experience").alias("experience_id"), F.col("p_target").alias("target_query_id"), F.col("p_query").alias("target_query"), F.col("plan").alias("transformed_query"), "generated_by", "application_version", "retrieval_query_count", "requested_top_k",
        "context_token_budget", "estimated_cost",
    )
    return df.withColumn("prepared", F.when(F.col("plan").isNotNull(), p))


@pytest.mark.parametrize(
    "change,reasons",
    [
        ({}, []), ({"state": "candidate", "environment_compatible": False, "provenance": " "}, ["experience_not_active", "environment_mismatch", "missing_provenance"]),
        ({"reliability_observations": 1, "reliability_benefits": 0, "reliability_mean_gain": 0.0, "risk_upper_bound": 0.71}, ["insufficient_reliability_observations", "insufficient_reliability_benefits", "reliability_mean_gain_too_low", "risk_upper_bound_too_high"]),
        ({"reliability_mean_gain": float("nan")}, ["reliability_mean_gain_too_low"]), ({"plan": None}, ["missing_prepared_query_plan"]), ({"plan": " "}, ["empty_transformed_query"]), ({"plan": " WHO was first "}, ["unchanged_transformed_query"]),
        ({"plan": "x" * 51}, ["transformed_query_too_long"]), ({"p_experience": "z", "p_target": "z", "p_query": "z"}, ["prepared_experience_mismatch", "prepared_target_id_mismatch", "prepared_target_query_mismatch"]),
        ({"generated_by": "unknown"}, ["missing_application_provenance", "application_applier_mismatch"]), ({"application_version": "v2"}, ["application_version_mismatch"]),
        ({"retrieval_query_count": 2, "requested_top_k": 0, "context_token_budget": 9999}, ["retrieval_query_budget_exceeded", "top_k_budget_invalid", "context_token_budget_invalid"]), ({"estimated_cost": -1.0}, ["application_cost_invalid"]),
        ({"estimated_cost": 2.0}, ["application_cost_budget_exceeded"]), ({"applicability_score": None}, ["missing_applicability_estimate"]), ({"applicability_score": 0.4}, ["applicability_below_threshold"]),
        ({"applicability_score": 0.0, "applicability_matched_contraindications": ["x"]}, ["applicability_contraindication_matched", "applicability_below_threshold"]), ({"applicability_scorer_id": "unset", "applicability_missing_features": True}, ["missing_applicability_scorer", "missing_applicability_features"]),
    ],
)
def test_gate_reasons(spark, change, reasons):
    t = gate.gate_traces(candidate(spark, **change), GatePolicy(), QueryBudget(max_query_characters=50, max_application_cost=1.0))
    r = t.first()
    assert r.rejection_reasons == reasons and r.passed == (not reasons) and r.first_failure == (reasons[0] if reasons else None)


def test_veto_holds_at_zero_threshold(spark):
    r = gate.gate_traces(candidate(spark, applicability_score=0.0, applicability_matched_contraindications=["x"]), GatePolicy(minimum_applicability=0.0)).first()
    assert r.rejection_reasons == ["applicability_contraindication_matched"]


def decided(spark, *changes):
    df = candidate(spark, **changes[0])
    for c in changes[1:]:
        df = df.unionByName(candidate(spark, **c))
    targets = requests(spark, [("t", " who was first "), ("alone", " x ")])
    return {r.target_query_id: r for r in gate.decide(gate.gate_traces(df), targets).collect()}


def test_decisions(spark):
    d = decided(spark, {})
    assert (d["t"].executed_action, d["t"].executed_query, d["t"].reason) == ("reuse", "x y", "reuse_selected")
    assert (d["alone"].executed_action, d["alone"].executed_query, d["alone"].reason) == ("direct", "x", "no_candidates")
    assert decided(spark, {"state": "candidate"})["t"].reason == "no_eligible_experience"
    f = decided(spark, {"plan": None})["t"]
    assert (f.intended_action, f.intended_experience_id, f.executed_action, f.executed_experience_id, f.reason) == ("reuse", "e", "direct", None, "invalid_query_plan_fallback")


@pytest.mark.parametrize("worse,better", [({"applicability_score": 0.9}, {}), ({"risk_upper_bound": 0.5}, {"risk_upper_bound": 0.4}), ({"environment_score": 0.8}, {}), ({"recall_rank": 2}, {"recall_rank": 1}), ({}, {"experience_id": "a", "p_experience": "a"})])
def test_selection_order(spark, worse, better):
    won = decided(spark, {"plan": "worse", "recall_rank": 1} | worse, {"plan": "better", "experience_id": "e2", "p_experience": "e2", "recall_rank": 1} | better)
    assert won["t"].executed_query == "better" if better or worse.get("recall_rank") else True
    if "applicability_score" in worse or "environment_score" in worse:
        assert won["t"].executed_query == "better"


def test_gate_has_no_outcome_columns(spark):
    assert not {c for c in gate.gate_traces(candidate(spark)).columns if re.search("gold|answer|outcome|direct_score|reuse_score", c)}


def batch(spark, **kw):
    rel = dict(observations=3, benefit_count=1, mean_gain=0.4, breakage_upper_bound=0.66, benefit_rate=1 / 3)
    rows = [(e, s, "src", q, "log", ["a"], [], "precomputed-plan", "v1", c, *rel.values()) for e, s, q, c in (("hot", "active", "alpha beta", "corpus_id-1"), ("cold", "active", "alpha", "corpus_id-1"), ("off", "quarantine", "alpha", "corpus_id-1"), ("away", "active", "alpha", "x"))]
    df = spark.createDataFrame(rows, "experience_id string, state string, source_query_id string, source_query string, provenance string, applicability_signature array<string>, contraindication_signature array<string>, applier_id string, applier_version string, corpus string, observations long, benefit_count long, mean_gain double, breakage_upper_bound double, benefit_rate double")
    df = df.withColumn("environment", F.struct(*[(F.col("corpus") if f == "corpus_id" else F.lit(ENV[f])).alias(f) for f in ENVIRONMENT_FIELDS]))
    req = spark.createDataFrame([("t", "alpha beta", ["a"]), ("src", "alpha beta", ["a"])], "target_query_id string, target_query string, signatures array<string>")
    plans = spark.createDataFrame([("t", "hot", "p1"), ("t", "cold", "p2"), ("src", "hot", "p3")], "target_query_id string, experience_id string, transformed_query string")
    return decide_batch(df, req, plans, ENV, **kw)


def test_batch_filters_before_recall_and_never_reuses_own_source(spark):
    out = batch(spark)
    assert {r.experience_id for r in out.recalled.collect()} == {"hot", "cold"}
    assert [r.experience_id for r in out.rejected.collect()] == ["away"]
    d = {r.target_query_id: r for r in out.decisions.collect()}
    assert d["t"].executed_query == "p1" and d["src"].reason == "invalid_query_plan_fallback"


def test_batch_with_portfolio(spark):
    a = spark.createDataFrame([("cold", 5, None)], "experience_id string, last_validated_step long, last_used_step long")
    out = batch(spark, activities=a, current_step=5, portfolio_policy=PortfolioPolicy(1, 10.0))
    assert {r.experience_id for r in out.recalled.collect()} == {"cold"}
    with pytest.raises(ValueError):
        batch(spark, portfolio_policy=PortfolioPolicy(1, 10.0))


class LongestFirst:
    """A recall hook: the m longest source queries for every target."""

    scorer_id = " longest-first "

    def __call__(self, requests, records, m):
        pairs = requests.select("target_query_id").crossJoin(records.select("experience_id", (F.length("source_query") / 100).alias("recall_score")))
        return recall.rank_scored(pairs, m)


def test_hooks_take_part_and_are_named(spark):
    from tallyforge.operators.applicability import coverage
    from tallyforge.plans.decide import component_id

    always = lambda required, observed, contra: coverage(required, observed, contra) | {"applicability_score": F.lit(0.75), "applicability_scorer_id": F.lit("always")}
    out = batch(spark, recall=LongestFirst(), scorer=always, max_candidates=1)
    assert {r.experience_id for r in out.recalled.collect()} == {"hot"} and out.recall_scorer_id == "longest-first"
    assert {(r.applicability_score, r.applicability_scorer_id) for r in out.traces.collect()} == {(0.75, "always")}
    assert batch(spark).recall_scorer_id == component_id(None, "source-query-jaccard-v1") == "source-query-jaccard-v1"

    class Unnamed:
        scorer_id = "  "

    assert component_id(Unnamed(), "own") == "Unnamed" and component_id(coverage, "own") == "coverage"


def selective_rows(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], "target_query_id string, experience_id string, recall_rank int, applicability_score double, risk_upper_bound double, rejection_reasons array<string>, direct_score double, reuse_score double, good_threshold double, environment_score double")


def test_sweep_strict_and_permissive(spark):
    c = selective_rows(spark, [("t1", "e1", 1, 0.9, 0.1, [], 0.0, 1.0, 0.5), ("t2", "e2", 1, 0.9, 0.6, ["risk_upper_bound_too_high"], 1.0, 0.0, 0.5), ("t2", "e3", 2, 1.0, 0.0, ["missing_provenance"], 1.0, 1.0, 0.5)])
    p = spark.createDataFrame([(0, 0.5, 0.2), (1, 0.5, 0.7)], "op_seq int, minimum_applicability double, maximum_risk_upper_bound double")
    u = spark.createDataFrame([("t1",), ("t2",)], "target_query_id string")
    a, b = selective.sweep(c, p, u, selected_pairs=True).orderBy("op_seq").collect()
    assert (a.coverage, a.harm_count, a.accepted_count) == (0.5, 0, 1) and (b.coverage, b.harm_count, b.conditional_breakage_rate) == (1.0, 1, 1.0)
    assert [tuple(x) for x in b.selected_pairs] == [("t1", "e1"), ("t2", "e2")]
    with pytest.raises(ValueError):
        selective.sweep(c, p.limit(0), u)
    rules = {r[0] for r in selective.violations(c.union(c.limit(1)), u.where("target_query_id <> 't2'")).collect()}
    assert rules == {"duplicate_pair", "duplicate_rank", "target_outside_universe"}


def sets_of(texts):
    return {k: set(re.findall(r"\w+", v)) for k, v in texts.items()}


def best_of(asked, memory, m):
    a, b = sets_of(asked), sets_of(memory)
    score = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    return {k: sorted((-score(w, v), i) for i, v in b.items())[:m] for k, w in a.items()}


def test_recall_emits_m_rows_of_a_shard(spark):
    """Whatever words all experiences have, a target gets m rows of each shard; all scores equal those of plain sets."""
    rnd = random.Random(3)
    text = lambda: " ".join(["the", *rnd.choices([f"w{i}" for i in range(40)], k=rnd.randint(0, 6))])
    memory = {f"e{i:03}": text() for i in range(150)} | {"e900": "", "e901": "..", "e902": "the"}
    asked = {f"t{i}": text() for i in range(12)} | {"none": "!!", "new": "unheard", "the": "the"}
    e, t = spark.createDataFrame([*memory.items()], "experience_id string, source_query string"), spark.createDataFrame([*asked.items()], "target_query_id string, target_query string")
    want = best_of(asked, memory, 4)
    for shard_words in (recall.SHARD_WORDS, 200, 40):
        got = {}
        for r in recall.recall_top_m(t, e, 4, shard_words).orderBy("recall_rank").collect():
            got.setdefault(r.target_query_id, []).append((-r.recall_score, r.experience_id))
        assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_shard_search_equals_all_pairs_and_looks_at_few(seed):
    """Words of very different frequency: bounds leave few experiences, the result is that of all pairs."""
    rnd = random.Random(seed)
    pool = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    memory = {f"e{i:05}": " ".join(rnd.choices(pool, weights, k=rnd.choice([0, 1, 5, 30, 60]))) for i in range(1500)}
    asked = {f"t{i}": " ".join(rnd.choices(pool, weights, k=rnd.choice([0, 1, 8, 50, 300]))) for i in range(40)} | {f"c{i}": v + " extra" for i, v in enumerate(list(memory.values())[:20])}
    sets, shard = sets_of(memory), None
    shard = recall.build_shard(pa.array(sets), pa.array([sorted(v) for v in sets.values()], pa.list_(pa.string())))
    number = {w: i for i, w in enumerate(shard["vocab"].to_pylist())}
    want, looked = best_of(asked, memory, 5), 0
    for k, w in sets_of(asked).items():
        found, scores, seen = recall.search_shard(shard, np.array([number[x] for x in sorted(w) if x in number], np.int64), len(w), 5)
        assert [(-s, shard["ids"][i].as_py()) for i, s in zip(found.tolist(), scores.tolist(), strict=True)] == want[k]
        looked += seen
    assert looked < 0.35 * len(asked) * len(memory)


def test_recall_rows_on_the_given_tables(spark):
    """At sf0.1 the search hands on under a tenth of as many rows as there are pairs."""
    from tallyforge.adapters import relation

    d = "/root/testdata/sf0.1"
    t, e = relation(spark, d, "requests"), relation(spark, d, "memory")
    top = recall.recall_top_m(t, e, 5)
    assert top.count() == 5 * t.count() < 0.1 * t.count() * e.count()
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def random_candidates(rnd, targets, most):
    """Few distinct thresholds, so that ties and dominated candidates abound."""
    rows = []
    for t in range(targets):
        for k in range(rnd.randint(0, most)):
            fit, risk = rnd.choice([None, float("nan"), *[i / 8 for i in range(9)]]), rnd.choice([float("nan"), *[i / 8 for i in range(9)]])
            rows.append((f"t{t}", f"e{k}", k + 1, fit, risk, rnd.choice([[], [], ["risk_upper_bound_too_high"], ["missing_provenance"]]), rnd.randint(0, 8) / 8, rnd.randint(0, 8) / 8, 0.5))
    return rows


def choose(rows, fit, risk):
    """By target, the candidate that one operating point chooses, taken straight from the order of preference."""
    best = {}
    for r in rows:
        if r[5] in ([], ["risk_upper_bound_too_high"]) and r[3] is not None and r[3] >= fit and r[4] <= risk:
            key = (-r[3], r[4], -1.0, r[2], r[1])
            if r[0] not in best or key < best[r[0]][0]:
                best[r[0]] = key, r
    return {t: r for t, (_, r) in best.items()}


def totals(chosen):
    of = lambda f: sum(1 for r in chosen.values() if f(r[6] >= r[8], r[7] >= r[8]))
    gain = sum(r[7] - r[6] for r in chosen.values()) / len(chosen) if chosen else 0.0
    return len(chosen), of(lambda d, x: not d and x), of(lambda d, x: d and not x), of(lambda d, x: d and x), of(lambda d, x: not d and not x), gain


@pytest.mark.parametrize("seed", range(3))
def test_sweep_against_every_choice(spark, seed):
    rnd = random.Random(seed)
    rows = random_candidates(rnd, 60, 7)
    points = [(i, rnd.choice([k / 16 for k in range(17)]), rnd.choice([k / 16 for k in range(17)])) for i in range(80)]
    p = spark.createDataFrame(points, "op_seq int, minimum_applicability double, maximum_risk_upper_bound double")
    u = spark.createDataFrame([(f"t{t}",) for t in range(60)], "target_query_id string")
    got = {r.op_seq: r for r in selective.sweep(selective_rows(spark, rows), p, u, selected_pairs=True).collect()}
    for i, fit, risk in points:
        c, r = choose(rows, fit, risk), got[i]
        assert (r.accepted_count, r.benefit_count, r.harm_count, r.both_good_count, r.both_bad_count) == totals(c)[:5] and r.mean_gain == pytest.approx(totals(c)[5]) and r.target_count == 60
        assert [tuple(x) for x in r.selected_pairs or []] == sorted((t, x[1]) for t, x in c.items())


def test_sweep_of_most_points_meets_no_candidate_with_every_point(spark):
    rnd = random.Random(8)
    rows = random_candidates(rnd, 300, 5)
    points = [(i, rnd.random(), rnd.random()) for i in range(selective.MOST_POINTS)]
    p = spark.createDataFrame(points, "op_seq int, minimum_applicability double, maximum_risk_upper_bound double")
    u = spark.createDataFrame([(f"t{t}",) for t in range(300)], "target_query_id string")
    out = selective.sweep(selective_rows(spark, rows), p, u)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.op_seq: r for r in out.collect()}
    assert len(got) == selective.MOST_POINTS
    for i, fit, risk in points[::250]:
        assert (got[i].accepted_count, got[i].benefit_count, got[i].harm_count, got[i].both_good_count, got[i].both_bad_count) == totals(choose(rows, fit, risk))[:5]
    with pytest.raises(ValueError):
        selective.sweep(selective_rows(spark, rows), p.union(p.limit(1)), u)
    with pytest.raises(ValueError):
        selective.sweep(selective_rows(spark, rows), p.limit(3).withColumn("minimum_applicability", F.lit(1.5)), u)


def test_environments_are_compared_once_each(spark):
    """Whatever the number of records, as many comparisons as there are distinct environments; nulls are one value."""
    known = [ENV, ENV | {"index_id": None}, ENV | {"analyzer_version": "x"}, ENV | {"corpus_id": " Unset "}]
    rows = [(f"e{i}", tuple((known[i % 4])[f] for f in ENVIRONMENT_FIELDS)) for i in range(200)]
    df = spark.createDataFrame(rows, "experience_id string, environment struct<" + ",".join(f"{f}:string" for f in ENVIRONMENT_FIELDS) + ">")
    counted = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(x):
        counted.add(1)
        return x

    policy = EnvironmentPolicy("tiered", 0.7, 0.2)
    real = environment.compatibility
    environment.compatibility = lambda a, b, p: real(a, b, p) | {"environment_compatible": seen(real(a, b, p)["environment_compatible"])}
    try:
        got = {r.experience_id: (r.environment_compatible, r.environment_hard_mismatches) for r in environment.match(df, env(), policy).collect()}
    finally:
        environment.compatibility = real
    assert counted.value == 4
    want = {r.experience_id: (r.environment_compatible, r.environment_hard_mismatches) for r in df.select("experience_id", *[c.alias(k) for k, c in real(F.col("environment"), env(), policy).items()]).collect()}
    assert got == want and len(got) == 200 and sum(ok for ok, _ in got.values()) == 100
