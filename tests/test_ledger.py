"""Ledgers, archives and streams that grow by batches."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.evidence_checks import IntegrityError
from tallyforge.plans import ledger as lg
from tallyforge.plans.store import KeyedTable
from tallyforge.policies import LifecyclePolicy
from tallyforge.streaming.evidence import append_checked

from .model import fold_state

RECORDS = "experience_id string, state string, direct_score double, reuse_score double, evidence_role string, source_query_id string, source_dataset_id string, source_group_id string, source_metric_protocol_id string, source_applier_id string, source_applier_version string"
OBSERVATIONS = "experience_id string, seq int, target_query_id string, target_group_id string, dataset_id string, evidence_role string, metric_protocol_id string, applier_id string, applier_version string, direct_score double, reuse_score double, good_threshold double"
POLICY = LifecyclePolicy(quarantine_at_harm_count=2)


def candidates(spark, *ids, **change):
    base = {"state": "?", "direct_score": 0.25, "reuse_score": 0.75, "evidence_role": "development", "source_query_id": "sq", "source_dataset_id": "ds", "source_group_id": "sg", "source_metric_protocol_id": "f1", "source_applier_id": "plan", "source_applier_version": "v1"} | change
    return spark.createDataFrame([(i, *base.values()) for i in ids], RECORDS)


def seen(spark, *rows, **change):
    """Observations (experience, seq, direct, reuse), each of a target of its own."""
    base = {"target_query_id": None, "target_group_id": None, "dataset_id": "ds", "evidence_role": "calibration", "metric_protocol_id": "f1", "applier_id": "plan", "applier_version": "v1"} | change
    full = [(e, s, base["target_query_id"] or f"t{e}{s}", base["target_group_id"] or f"g{e}{s}", *list(base.values())[2:], d, r, 0.5) for e, s, d, r in rows]
    return spark.createDataFrame(full, OBSERVATIONS)


def empty_ledger(spark, path, buckets=8):
    of = lambda ddl: spark.createDataFrame([], ddl).schema
    return lg.Ledger(spark, str(path), of(RECORDS), of(OBSERVATIONS), POLICY, buckets)


def states(ledger):
    return {r.experience_id: r.state for r in ledger.records().collect()}


def test_batches_equal_a_fold(spark, tmp_path):
    rnd = random.Random(1)
    ids = [f"e{i}" for i in range(40)]
    history = {e: [(rnd.randint(0, 8) / 8, rnd.randint(0, 8) / 8) for _ in range(rnd.randint(0, 9))] for e in ids}
    led = empty_ledger(spark, tmp_path / "l")
    led.add_candidates(candidates(spark, *ids[:25]))
    led.add_candidates(candidates(spark, *ids[25:]))
    assert states(led) == dict.fromkeys(ids, "candidate")
    for batch, (lo, hi) in enumerate(((0, 2), (2, 3), (3, 9))):
        rows = [(e, s, d, r) for e, h in history.items() for s, (d, r) in enumerate(h) if lo <= s < hi]
        led.record_transfers(seen(spark, *rows), batch)
        assert states(led) == {e: fold_state(h[:hi], POLICY) for e, h in history.items()}
    got = {r.experience_id: r for r in led.totals().collect()}
    for e, h in history.items():
        assert (got[e].n, got[e].last_seq) == (len(h), len(h) - 1) and got[e].gain == sum(r - d for d, r in h)


def test_a_batch_again_counts_once(spark, tmp_path):
    led = empty_ledger(spark, tmp_path / "l")
    led.add_candidates(candidates(spark, "a", "b"))
    first = seen(spark, ("a", 1, 0.0, 1.0), ("b", 1, 1.0, 0.0))
    led.record_transfers(first, 0)
    before = sorted(map(tuple, led.totals().collect()))
    led.record_transfers(first, 0)
    assert sorted(map(tuple, led.totals().collect())) == before and led.observations.read().count() == 2
    # as after a failure between the two writes: observations are there, totals aren't
    second = seen(spark, ("a", 2, 0.0, 1.0))
    led.observations.append(second, 1)
    led.record_transfers(second, 1)
    assert {r.experience_id: r.n for r in led.totals().collect()} == {"a": 2, "b": 1} and led.observations.read().count() == 3
    with pytest.raises(IntegrityError, match="batch_before_last"):
        led.record_transfers(seen(spark, ("a", 3, 0.0, 1.0)), 0)


@pytest.mark.parametrize(
    "row,change,rule",
    [
        (("a", 1, 0, 1), {}, "seq_not_after_last"), (("zz", 9, 0, 1), {}, "unknown_experience"), (("a", 9, 0, 1), {"evidence_role": "test"}, "test_evidence"), (("a", 9, 0, 1), {"target_query_id": "sq"}, "source_query_as_transfer"), (("a", 9, 0, 1), {"target_group_id": "sg"}, "source_group_as_transfer"),
        (("a", 9, 0, 1), {"metric_protocol_id": "em"}, "metric_protocol_differs"), (("a", 9, 0, 1), {"applier_version": "v2"}, "applier_differs"), (("a", 9, 0, 1), {"target_query_id": "ta1"}, "duplicate_target"), (("a", 9, 0, 1), {"target_group_id": "ga1"}, "duplicate_group"), (("gone", 9, 0, 1), {}, "retired_experience"),
    ],
)
def test_refused_evidence_changes_nothing(spark, tmp_path, row, change, rule):
    led = empty_ledger(spark, tmp_path / "l")
    led.add_candidates(candidates(spark, "a", "gone"))
    led.record_transfers(seen(spark, ("a", 1, 0.0, 1.0), ("gone", 1, 0.0, 1.0)), 0)
    led.retire(spark.createDataFrame([("gone",)], "experience_id string"))
    before = sorted(map(tuple, led.totals().collect()))
    e, s, d, r = row
    with pytest.raises(IntegrityError, match=rule):
        led.record_transfers(seen(spark, (e, s, float(d), float(r)), **change), 1)
    assert sorted(map(tuple, led.totals().collect())) == before and led.observations.read().count() == 2


def test_candidates_and_retirement(spark, tmp_path):
    led = empty_ledger(spark, tmp_path / "l")
    led.add_candidates(candidates(spark, "weak", reuse_score=0.25).union(candidates(spark, "a", "b")))
    assert states(led) == {"a": "candidate", "b": "candidate"}
    with pytest.raises(IntegrityError, match="duplicate_experience_id"):
        led.add_candidates(candidates(spark, "a", "c"))
    with pytest.raises(IntegrityError, match="test_source_evidence"):
        led.add_candidates(candidates(spark, "c", evidence_role="test"))
    led.retire(spark.createDataFrame([("a",), ("a",)], "experience_id string"))
    with pytest.raises(IntegrityError, match="unknown_experience"):
        led.retire(spark.createDataFrame([("zz",)], "experience_id string"))
    assert states(led) == {"a": "retired", "b": "candidate"}
    led.record_transfers(seen(spark, ("b", 1, 1.0, 0.0), ("b", 2, 1.0, 0.0)), 0, evaluate=False)
    assert states(led)["b"] == "candidate"
    led.record_transfers(seen(spark, ("b", 3, 0.0, 0.0)), 1)
    assert states(led) == {"a": "retired", "b": "quarantine"}


def test_untouched_buckets_are_neither_read_nor_written(spark, tmp_path):
    led = empty_ledger(spark, tmp_path / "l", buckets=16)
    ids = [f"e{i}" for i in range(200)]
    led.add_candidates(candidates(spark, *ids))
    one = seen(spark, ("e7", 1, 0.0, 1.0))
    touched = led.observations.touched(one)
    assert len(touched) == 1
    scan = led.totals(touched)
    assert 0 < len(scan.inputFiles()) and {f.split("bucket=")[1].split("/")[0] for f in led.totals().inputFiles()} >= {str(touched[0])}
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    stamp = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "l" / "totals").rglob("*.parquet")}
    before = stamp()
    led.record_transfers(one, 0)
    same = [p for p, t in stamp().items() if before.get(p) == t]
    assert {p.parent.name for p in before} - {p.parent.name for p in same} == {f"bucket={touched[0]}"}


def test_memory_operators(spark):
    """The same steps on tables in memory, old ones checked as a whole."""
    none = candidates(spark).limit(0)
    records = lg.add_candidates(none, candidates(spark, "a", "b"))
    assert {r.state for r in records.collect()} == {"candidate"}
    with pytest.raises(IntegrityError, match="duplicate_experience_id"):
        lg.add_candidates(records, candidates(spark, "a"))
    obs = seen(spark).limit(0)
    records, obs = lg.record_transfers(records, obs, seen(spark, ("a", 1, 1.0, 0.0), ("a", 2, 1.0, 0.0)), POLICY)
    assert {r.experience_id: r.state for r in records.collect()} == {"a": "quarantine", "b": "candidate"} and obs.count() == 2
    with pytest.raises(IntegrityError, match="duplicate_target"):
        lg.record_transfers(records, obs, seen(spark, ("a", 3, 1.0, 0.0), target_query_id="ta1"), POLICY)
    assert {r.experience_id: r.state for r in lg.retire(records, ["b"]).collect()} == {"a": "quarantine", "b": "retired"}


def test_keyed_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k string, v int").schema, ["k"], 4)
    rows = lambda *kv: spark.createDataFrame(kv, "k string, v int")
    assert t.read().count() == 0
    t.commit(rows(("a", 1), ("b", 2)), 0)
    t.commit(rows(("c", 3)), 1)
    with pytest.raises(IntegrityError, match="committed_before: b"):
        t.commit(rows(("b", 9), ("d", 4)), 2)
    with pytest.raises(IntegrityError, match="duplicate_k: d"):
        t.commit(rows(("d", 4), ("d", 5)), 2)
    t.commit(rows(("a", 7)), 0)  # the batch again, other rows: it replaces itself
    assert sorted((r.k, r.v, r.batch) for r in t.read().collect()) == [("a", 7, 0), ("c", 3, 1)]
    t.commit(rows(), 3)
    assert t.read().count() == 2


def test_stream_refuses_what_another_batch_holds(spark, tmp_path):
    schema = "k string, v int"
    put = lambda name, *rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    bad = lambda b: b.where("v < 0").select(F.lit("negative").alias("rule"), F.col("k").alias("key"))

    def run(checkpoint="cp"):
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        q = append_checked(src, bad, str(tmp_path / "out"), str(tmp_path / checkpoint), ["k"], 4).trigger(availableNow=True).start()
        q.awaitTermination()

    stored = lambda: sorted((r.k, r.v) for r in KeyedTable(spark, str(tmp_path / "out"), spark.createDataFrame([], schema).schema, ["k"], 4).read().collect())
    put("p0", ("a", 1), ("b", 2))
    run()
    put("p1", ("c", 3))
    run()
    assert stored() == [("a", 1), ("b", 2), ("c", 3)]
    put("p2", ("b", 5))
    with pytest.raises(Exception, match="committed_before"):
        run()
    assert stored() == [("a", 1), ("b", 2), ("c", 3)]


def test_a_replayed_stream_adds_nothing(spark, tmp_path):
    schema = "k string, v int"
    spark.createDataFrame([("a", 1), ("b", 2)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    for checkpoint in ("cp1", "cp2"):  # a lost checkpoint begins again with batch 0
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        append_checked(src, lambda b: b.limit(0).select("k", "k").toDF("rule", "key"), str(tmp_path / "out"), str(tmp_path / checkpoint), ["k"], 4).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
