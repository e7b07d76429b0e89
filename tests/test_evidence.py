import pytest
from pyspark.sql import functions as F

from tallyforge.operators import evidence_checks as ec
from tallyforge.operators import oracle, portfolio, reliability
from tallyforge.policies import LifecyclePolicy, PortfolioPolicy

from .model import fold_state, histories, wilson

PILOT = [("q1", "e1", 1, 0.4, 0.7, 0.6), ("q1", "e2", 2, 0.4, 0.3, 0.6), ("q2", "e1", 1, 0.8, 0.6, 0.9), ("q2", "e3", 2, 0.8, 0.8, 0.9), ("q3", "e2", 1, 0.6, 0.6, 0.6), ("q3", "e3", 2, 0.6, 0.2, 0.6)]


def pilot(spark, rows=PILOT, snapshot="s"):
    full = [(t, e, snapshot, k, d, r, 1, 2, 2048, f) for t, e, k, d, r, f in rows]
    return spark.createDataFrame(full, "target_query_id string, experience_id string, memory_snapshot_id string, candidate_rank int, direct_score double, reuse_score double, retrieval_query_count int, requested_top_k int, context_token_budget int, fresh_score double")


def test_oracle_goldens(spark):
    s = oracle.summary(pilot(spark)).first()
    assert (s.target_count, s.candidate_count, s.mean_candidate_count, s.pair_harm_count) == (3, 6, 2.0, 1)
    assert s.helpful_coverage == pytest.approx(1 / 3) and s.pair_harm_rate == pytest.approx(1 / 6)
    assert (s.direct_mean, s.candidate_set_oracle_reuse_mean, s.offline_policy_oracle_mean) == pytest.approx((0.6, 0.7, 2.2 / 3))
    assert (s.reuse_gain_over_direct, s.policy_gain_over_direct, s.policy_gain_over_reuse) == pytest.approx((0.1, 2 / 15, 1 / 30))
    assert (s.action_direct, s.action_reuse, s.action_fresh) == (1, 1, 1)


def test_targets_tell_no_winner(spark):
    assert not set(oracle.per_target(pilot(spark)).columns) & {*oracle.HINDSIGHT, "pair_harm_count"}


def rules(df):
    return {r[0] for r in df.collect()}


@pytest.mark.parametrize(
    "change,rule",
    [
        (lambda r: [*r, r[0]], "duplicate_pair"), (lambda r: [*r, ("q1", "e9", 1, 0.4, 0.1, 0.6)], "duplicate_rank"), (lambda r: [*r, ("q1", "e9", 3, 0.5, 0.1, 0.6)], "inconsistent_direct_score"),
        (lambda r: [*r, ("q1", "e9", 3, 0.4, 0.1, None)], "inconsistent_fresh_score"), (lambda r: [*r, ("q9", " ", 1, 0.4, 0.1, None)], "blank_experience_id"), (lambda r: [*r, ("q9", "e", 0, 0.4, 0.1, None)], "candidate_rank_not_positive"),
        (lambda r: [*r, ("q9", "e", 1, 0.4, 1.1, None)], "reuse_score_out_of_range"), (lambda r: [*r, ("q9", "e", 1, float("nan"), 0.1, None)], "direct_score_out_of_range"), (lambda r: [*r, ("q9", "e", 1, 0.4, 0.1, -0.1)], "fresh_score_out_of_range"),
    ],
)
def test_oracle_rules(spark, change, rule):
    assert rule in rules(oracle.violations(pilot(spark, change(PILOT))))


def test_oracle_sound_empty_and_snapshots(spark):
    assert rules(oracle.violations(pilot(spark))) == set()
    assert rules(oracle.violations(pilot(spark).limit(0))) == {"no_rows"}
    assert "several_memory_snapshots" in rules(oracle.violations(pilot(spark).union(pilot(spark, [("q8", "e", 1, 0.1, 0.1, None)], "t"))))
    with pytest.raises(ec.IntegrityError):
        ec.raise_if_any(oracle.violations(pilot(spark).limit(0)))


def observations(spark, by):
    rows = [(e, i, d, r, 0.5) for e, h in by.items() for i, (d, r) in enumerate(h)]
    return spark.createDataFrame(rows, "experience_id string, seq int, direct_score double, reuse_score double, good_threshold double")


def test_reliability_of_four_outcomes(spark):
    obs = observations(spark, {"e": [(0.0, 1.0), (1.0, 0.0), (0.8, 0.9), (0.2, 0.1)]})
    r = reliability.reliability(obs, spark.createDataFrame([("e",), ("none",)], "experience_id string")).collect()
    by = {x.experience_id: x for x in r}
    e = by["e"]
    assert (e.observations, e.harm_rate, e.conditional_breakage_rate, e.repair_rate) == (4, 0.25, 0.5, 0.5)
    assert e.mean_gain == pytest.approx(0.0, abs=1e-12)
    assert (by["none"].observations, by["none"].breakage_upper_bound, by["none"].harm_rate) == (0, 1.0, 0.0)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_lifecycle_equals_fold(spark, k):
    p = LifecyclePolicy(quarantine_at_harm_count=k)
    by = histories(400, k)
    got = {r.experience_id: r.state for r in reliability.lifecycle_state(observations(spark, by), p).collect()}
    assert got == {e: fold_state(h, p) for e, h in by.items()}
    assert len(set(got.values())) == 3


def test_write_gate(spark):
    df = spark.createDataFrame([("a", 0.5, 0.5, "development"), ("b", 0.5, 0.6, "development"), ("c", 0.1, 0.9, "test")], "experience_id string, direct_score double, reuse_score double, evidence_role string")
    assert [r.experience_id for r in reliability.write_gate(df).collect()] == ["b"]
    with pytest.raises(ValueError):
        reliability.write_gate(df, -0.1)


def records(spark, rows):
    return spark.createDataFrame(rows, "experience_id string, state string, benefit_rate double, breakage_upper_bound double")


def acts(spark, rows):
    return spark.createDataFrame(rows, "experience_id string, last_validated_step long, last_used_step long")


def test_portfolio_top_k_half_life_and_ties(spark):
    u = wilson(0, 4)
    r = records(spark, [(x, "active", 2 / 6, u) for x in ("new", "mid", "old", "b", "lost")] + [("cand", "candidate", 1.0, 0.0)])
    a = acts(spark, [("new", 10, None), ("mid", 5, 9), ("old", 0, 10), ("b", 0, None), ("cand", 10, None)])
    p = PortfolioPolicy(2, 10.0)
    s = {x.experience_id: x for x in portfolio.scores(r, a, 10, p).collect()}
    assert s["new"].priority_base == pytest.approx(0.170036, abs=1e-6) and s["old"].decay == 0.5 and s["old"].priority_base == s["new"].priority_base
    tiers = {x.experience_id: x.tier for x in portfolio.partition(r, a, 10, p).collect()}
    assert tiers == {"new": "hot", "mid": "hot", "old": "cold", "b": "cold", "lost": "cold"}
    strict = {x.experience_id: x.tier for x in portfolio.partition(r, a, 10, PortfolioPolicy(9, 10.0, 0.1)).collect()}
    assert strict["old"] == "expired" and strict["lost"] == "cold"
    one = {x.experience_id: x.tier for x in portfolio.partition(r, acts(spark, [("old", 0, None), ("b", 0, None)]), 10, PortfolioPolicy(1, 10.0)).collect()}
    assert one["b"] == "hot" and one["old"] == "cold"


def test_activity_rules(spark):
    r = records(spark, [("a", "active", 1.0, 0.0)])
    a = acts(spark, [("a", 5, 4), ("a", 11, None), ("x", 1, 12), ("y", -1, None)])
    assert rules(portfolio.activity_violations(a, r, 10)) == {"duplicate_activity", "unknown_experience", "last_validated_step_in_future", "last_used_step_in_future", "last_validated_step_invalid"}


SRC = "experience_id string, state string, source_query_id string, source_dataset_id string, source_group_id string, source_metric_protocol_id string, source_applier_id string, source_applier_version string"
OBS = "experience_id string, seq int, target_query_id string, target_group_id string, dataset_id string, evidence_role string, metric_protocol_id string, applier_id string, applier_version string"


@pytest.mark.parametrize(
    "change,rule",
    [
        ({}, None), ({"evidence_role": "test"}, "test_evidence"), ({"target_query_id": "src"}, "source_query_as_transfer"), ({"target_group_id": "g"}, "source_group_as_transfer"), ({"metric_protocol_id": "z"}, "metric_protocol_differs"),
        ({"applier_version": "z"}, "applier_differs"), ({"target_query_id": "t0"}, "duplicate_target"), ({"target_group_id": "g0"}, "duplicate_group"), ({"experience_id": "zz"}, "unknown_experience"), ({"experience_id": "r"}, "retired_experience"),
    ],
)
def test_transfer_rules(spark, change, rule):
    src = spark.createDataFrame([(e, s, "src", "ds", "g", "m", "a", "v") for e, s in (("e", "active"), ("r", "retired"))], SRC)
    base = dict(experience_id="e", seq=1, target_query_id="t1", target_group_id="g1", dataset_id="ds", evidence_role="calibration", metric_protocol_id="m", applier_id="a", applier_version="v")
    first = base | {"seq": 0, "target_query_id": "t0", "target_group_id": "g0"}
    names = OBS.replace(" string", "").replace(" int", "").split(", ")
    obs = spark.createDataFrame([tuple(r[n] for n in names) for r in (first, base | change)], OBS)
    assert rules(ec.transfer_violations(obs, src)) == ({rule} if rule else set())
    keys = {r.key for r in ec.transfer_violations(obs, src).collect()}
    assert all(k.endswith("/1") for k in keys)  # the first occurrence is legal


def test_lifecycle_in_pieces(spark):
    """However orders are cut into pieces, states are those of a fold; so with totals carried from before."""
    by = histories(60, 25)
    p = LifecyclePolicy(quarantine_at_harm_count=3)
    want = {r.experience_id: (r.observations, r.state) for r in reliability.lifecycle_state(observations(spark, by), p).collect()}
    for segment in (1, 3, 7):
        assert {r.experience_id: (r.observations, r.state) for r in reliability.lifecycle_state(observations(spark, by), p, segment=segment).collect()} == want
    named = observations(spark, by).withColumn("seq", F.format_string("%05d", "seq"))  # no whole numbers: one piece
    assert {r.experience_id: (r.observations, r.state) for r in reliability.lifecycle_state(named, p).collect()} == want


def test_one_experience_of_a_million_observations_is_spread(spark):
    n = 1_000_000
    i = F.col("id")
    rows = spark.range(n + 50).select(
        F.when(i < n, "hot").otherwise("cold").alias("experience_id"), (i % n).cast("int").alias("seq"), ((i % 3 == 0) & (i > 5)).cast("double").alias("direct_score"), ((i % 3 == 0) | (i % 5 == 0)).cast("double").alias("reuse_score"), F.lit(0.5).alias("good_threshold")
    )
    run = reliability.running_totals(rows, segment=1 << 17)
    spread = run.where("experience_id = 'hot'").groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.max("n").alias("last")).collect()
    assert len(spread) > 1 and max(r["n"] for r in spread) < 0.7 * n and max(r["last"] for r in spread) == n
    last = run.where("experience_id = 'hot' and seq in (0, 131071, 131072, 999999)").orderBy("seq").collect()
    count = lambda k, f: sum(1 for x in range(k + 1) if f(x))
    direct, reuse = (lambda x: x % 3 == 0 and x > 5), (lambda x: x % 3 == 0 or x % 5 == 0)
    assert [(r.n, r.benefit, r.harm, r.both_good) for r in last] == [(r.seq + 1, count(r.seq, lambda x: not direct(x) and reuse(x)), 0, count(r.seq, direct)) for r in last]


def test_partition_is_disjoint_and_whole(spark):
    r = records(spark, [(f"e{i}", "active" if i % 4 else "candidate", i / 20, 0.5) for i in range(20)])
    a = acts(spark, [(f"e{i}", i % 6, None) for i in range(0, 20, 2)])
    p = PortfolioPolicy(capacity=3, half_life_steps=2.0, minimum_priority=0.05)
    parts = portfolio.partition(r, a, 5, p)
    assert portfolio.partition_violations(parts, r, p).count() == 0
    assert parts.count() == 15 and sorted(x.hot_rank for x in parts.where("tier = 'hot'").collect()) == [1, 2, 3]
    stored = parts.collect()
    change = lambda f: spark.createDataFrame([f(dict(x.asDict())) for x in stored], parts.schema)
    rules = lambda df, policy=p: {x[0] for x in portfolio.partition_violations(df, r, policy).collect()}
    assert rules(parts.union(parts.where("tier = 'hot'").selectExpr("experience_id", "priority", "'cold'", "cast(null as int)"))) == {"tiers_overlap"}
    assert rules(parts.union(parts.where("tier = 'cold'"))) == {"repeated_in_tier"}
    assert rules(parts.where("tier <> 'expired'")) == ({"active_without_tier"} if parts.where("tier = 'expired'").count() else set())
    assert rules(change(lambda x: x | {"tier": "warm", "hot_rank": None} if x["tier"] == "hot" else x)) == {"unknown_tier"}
    assert rules(change(lambda x: x | {"hot_rank": 9})) == {"hot_rank_contradicts_tier"}
    assert rules(parts, PortfolioPolicy(capacity=2, half_life_steps=2.0)) == {"hot_above_capacity"}
    assert rules(parts.union(spark.createDataFrame([("e0", 1.0, "cold", None)], parts.schema))) == {"tier_of_inactive"}
