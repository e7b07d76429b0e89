import json
import os

import pytest

from tallyforge import cli
from tallyforge.operators import oracle
from tallyforge.operators.evidence_checks import IntegrityError
from tallyforge.policies import CardActivationPolicy, EnvironmentPolicy, GatePolicy, LifecyclePolicy, PortfolioPolicy, QueryBudget
from tallyforge.sources.config import ConfigError, parse_config
from tallyforge.sources.oracle_csv import read_oracle_csv
from tallyforge.sources.requests import read_plan_bundle, read_requests
from tallyforge.sources.sinks import oracle_report, write_atomic, write_jsonl_file
from tallyforge.sources.snapshot import dumps_snapshot, read_snapshot, write_snapshot
from tallyforge.sources.strict_json import FormatError, strict_loads

HEAD = "target_query_id,experience_id,memory_snapshot_id,candidate_rank,direct_score,reuse_score,retrieval_query_count,requested_top_k,context_token_budget"
ROWS = ["q1,e1,s,1,0.4,0.7,1,2,2048,0.6", "q1,e2,s,2,0.4,0.3,1,2,2048,0.6", "q2,e1,s,1,0.8,0.6,1,2,2048,0.9"]


def put(tmp_path, text, name="f"):
    p = tmp_path / name
    p.write_bytes(text.encode("utf-8"))
    return str(p)


def test_csv(spark, tmp_path):
    p = put(tmp_path, "﻿" + HEAD + ",fresh_score\n" + "\n".join(ROWS) + "\n\n")
    assert oracle.summary(read_oracle_csv(spark, p)).first().candidate_count == 3
    bare = put(tmp_path, HEAD + "\n" + "\n".join(r.rsplit(",", 1)[0] for r in ROWS), "g")
    assert {r.fresh_score for r in read_oracle_csv(spark, bare).collect()} == {None}


@pytest.mark.parametrize("text", [HEAD + ",odd\n" + ROWS[0], HEAD.replace("reuse_score,", "") + "\nq,e,s,1,1,1,1,1", HEAD + "\nq1,e1,s,1,x,0.7,1,2,2048", HEAD + "\nq1,e1,s,1,nan,0.7,1,2,2048", HEAD + "\nq1,e1,s,1.5,0.4,0.7,1,2,2048", HEAD + "\nq1,e1,s,1,0.5f,0.7,1,2,2048", HEAD + "\nq1,e1,s,1,1e400,0.7,1,2,2048", HEAD + "\n"])
def test_csv_refusals(spark, tmp_path, text):
    with pytest.raises((FormatError, IntegrityError)):
        read_oracle_csv(spark, put(tmp_path, text)).collect()


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', '{"a":NaN}', '{"a":{"b":1,"b":1}}', "[Infinity]", "{} x"])
def test_strict_json(text):
    with pytest.raises(FormatError):
        strict_loads(text)


ENV = {k: f"{k}-1" for k in ("corpus_id", "corpus_version", "retriever_id", "retriever_version", "index_id", "index_version", "analyzer_id", "analyzer_version", "rewriter_id", "rewriter_version")}


def toml(**change):
    s = {
        "experiment": {"name": "x", "seed": 1}, "actions": {"direct": True, "reuse": True, "fresh": False}, "evaluation": {"good_threshold": 0.5, "max_history_candidates": 5, "paired_harm_is_primary": True}, "environment": dict(ENV),
        "environment_compatibility": {"mode": "strict", "minimum_score": 1.0, "soft_mismatch_penalty": 0.1}, "write_gate": {"minimum_source_gain": 0.0},
        "reliability": {"minimum_transfer_observations": 3, "minimum_direct_good_observations": 2, "minimum_benefits": 1, "minimum_mean_gain": 0.0, "maximum_conditional_breakage_upper_bound": 0.7, "quarantine_at_harm_count": 1},
        "candidate_recall": {"scorer": "source-query-jaccard-v1", "maximum_candidates": 5}, "applicability": {"scorer": "signature-coverage-v2", "minimum_score": 0.5}, "application": {"applier_id": "precomputed-plan", "application_version": "v1"},
        "budget": {"maximum_retrieval_queries": 1, "top_k": 5, "context_tokens": 4096, "maximum_query_characters": 2048},
    }
    for k, v in change.items():
        section, field = k.split("__")
        if v is None:
            s[section].pop(field)
        else:
            s[section][field] = v
    return "\n".join(f"[{k}]\n" + "\n".join(f"{n} = {json.dumps(v)}" for n, v in t.items()) for k, t in s.items())


def test_config():
    c = parse_config(toml().encode()).require_runtime_ready().require_decidable()
    assert c.gate_policy == GatePolicy(3, 1, 0.0, 0.7, 0.5) and c.lifecycle_policy == LifecyclePolicy() and c.query_budget.max_top_k == 5 and c.max_candidates == 5
    assert parse_config(toml(budget__maximum_application_cost=2).encode()).query_budget.max_application_cost == 2


@pytest.mark.parametrize("change", [{"experiment__odd": 1}, {"experiment__seed": None}, {"experiment__seed": True}, {"reliability__minimum_benefits": -1}, {"evaluation__good_threshold": 1.5}, {"evaluation__max_history_candidates": 4}, {"environment_compatibility__mode": "odd"}, {"budget__top_k": 0}, {"application__applier_id": " "}])
def test_config_refusals(change):
    with pytest.raises(ConfigError):
        parse_config(toml(**change).encode())


def test_config_placeholders():
    c = parse_config(toml(environment__index_id="UNSET").encode())
    with pytest.raises(ConfigError):
        c.require_runtime_ready()
    with pytest.raises(ConfigError):
        parse_config(toml(actions__fresh=True).encode()).require_decidable()


@pytest.mark.parametrize("make", [lambda: GatePolicy(minimum_observations=0), lambda: GatePolicy(maximum_risk_upper_bound=1.1), lambda: QueryBudget(max_top_k=0), lambda: QueryBudget(max_application_cost=-1.0), lambda: EnvironmentPolicy("odd"), lambda: LifecyclePolicy(quarantine_at_harm_count=0), lambda: PortfolioPolicy(True, 1.0), lambda: PortfolioPolicy(1, 0.0), lambda: CardActivationPolicy(min_independent_documents=3), lambda: CardActivationPolicy(())])
def test_policy_domains(make):
    with pytest.raises(ValueError):
        make()


def observation(target, d, r):
    outcome = {(True, True): "direct_good_reuse_good", (True, False): "direct_good_reuse_bad", (False, True): "direct_bad_reuse_good", (False, False): "direct_bad_reuse_bad"}[d >= 0.5, r >= 0.5]
    return dict(target_query_id=target, direct_score=d, reuse_score=r, good_threshold=0.5, dataset_id="ds", split="cal", target_group_id=f"g-{target}", evidence_role="calibration", metric_protocol_id="m", applier_id="precomputed-plan", applier_version="v1", outcome=outcome, gain=r - d)


def record(eid="one", state="active", **change):
    t = dict(experience_id=eid, source_query_id="src", source_query="who was born first", transformed_query="a; b", atomic_units=["x"], environment=ENV, provenance="log", transformation_type="t", application_note="", applicability_signature=["comparison", "two_entity"], source_dataset_id="ds", source_split="dev",
             source_group_id="sg", diagnosed_failure="f", gap_categories=["attribute"], contraindication_signature=["single_entity"])
    s = dict(direct_score=0.0, reuse_score=1.0, dataset_id="ds", split="dev", source_group_id="sg", evidence_role="development", metric_protocol_id="m", applier_id="precomputed-plan", applier_version="v1", minimum_gain=0.0, gain=1.0, passes_paired_write_gate=True)
    out = {"state": state, "transformation": t, "source_evidence": s, "transfer_observations": [observation("a", 0.0, 1.0), observation("b", 0.8, 0.9), observation("c", 0.7, 0.8)]}
    for k, v in change.items():
        (t if k in t else s if k in s else out)[k] = v
    return out


def memory(*records, version=2, **extra):
    p = LifecyclePolicy()
    return json.dumps({"schema_version": version, "memory_snapshot_id": "m1", "lifecycle_policy": {k: getattr(p, k) for k in p.__dataclass_fields__}, "records": list(records)} | extra)


def test_snapshot_round_trip_is_canonical(spark, tmp_path):
    a = read_snapshot(spark, put(tmp_path, memory(record(), record("b2", "candidate", transfer_observations=[])), "a")).require_runtime_ready()
    text = dumps_snapshot(a.records, a.observations, "m1", a.policy)
    b = read_snapshot(spark, put(tmp_path, memory(record("b2", "candidate", transfer_observations=[]), record()), "b"))
    assert dumps_snapshot(b.records, b.observations, "m1", b.policy) == text
    assert json.loads(text)["records"][1]["transfer_observations"][0]["outcome"] == "direct_bad_reuse_good"
    again = read_snapshot(spark, put(tmp_path, text, "c"))
    assert again.records.count() == 2 and again.observations.count() == 3


@pytest.mark.parametrize(
    "text",
    [
        memory(record(), odd=1), memory(record(), version=3), memory(record()).replace('"state": "active"', '"state": "active", "state": "active"'), memory(record(evidence_role="test")), memory(record(gain=0.5)), memory(record(state="candidate")), memory(record(), record()),
        memory(record(passes_paired_write_gate=False)), memory(record(source_dataset_id="other")), memory(record(gap_categories=["odd"])), memory(record(transfer_observations=[observation("a", 0.0, 1.0) | {"outcome": "direct_bad_reuse_bad"}])), memory(record(direct_score=True)),
    ],
)
def test_snapshot_refusals(spark, tmp_path, text):
    with pytest.raises((FormatError, IntegrityError)):
        read_snapshot(spark, put(tmp_path, text))


def test_old_snapshots_can_be_audited_only(spark, tmp_path):
    r = record()
    for k in ("diagnosed_failure", "gap_categories", "contraindication_signature"):
        del r["transformation"][k]
    s = read_snapshot(spark, put(tmp_path, memory(r, version=1)))
    assert s.records.first().gap_categories == []
    with pytest.raises(FormatError):
        s.require_runtime_ready()


def request(tid, sig=("comparison", "two_entity"), **change):
    return json.dumps({"target_query_id": tid, "target_query": f"query {tid}", "signatures": list(sig), "signature_extractor_id": "x", "signature_extractor_version": "1", "signature_input_scope": "query_only"} | change)


@pytest.mark.parametrize("lines", [[request("a"), ""], [request("a"), request("a")], [request("a", odd=1)], [request("a", signature_input_scope="all")], [request("a"), request("b", signature_extractor_version="2")], [request("a", ("x", " X "))], [request("a", target_query=" ")], ["{", request("a")]])
def test_request_refusals(spark, tmp_path, lines):
    with pytest.raises((FormatError, IntegrityError)):
        read_requests(spark, put(tmp_path, "\n".join(lines) + "\n\n" * (lines[-1] == "")))


def plans(*rows, **extra):
    return json.dumps({"schema_version": 1, "applier_id": "precomputed-plan", "application_version": "v1", "plans": [dict(zip(("target_query_id", "experience_id", "transformed_query"), r, strict=True)) for r in rows]} | extra)


def test_empty_requests_and_bundles(spark, tmp_path):
    assert read_requests(spark, put(tmp_path, "")).count() == 0
    assert read_plan_bundle(spark, put(tmp_path, plans(("a", "b", "c")), "p")).plans.count() == 1
    for i, bad in enumerate((plans(("a", "b", "c"), ("a", "b", "d")), plans(schema_version=2), plans(odd=1), plans(("a", "b", " ")))):
        with pytest.raises((FormatError, IntegrityError)):
            read_plan_bundle(spark, put(tmp_path, bad, f"b{i}"))


def test_decide_end_to_end(spark, tmp_path, capsys):
    paths = {
        "config": put(tmp_path, toml(), "c.toml"), "memory": put(tmp_path, memory(record()), "m.json"), "plans": put(tmp_path, plans(("target-reuse", "one", "p; q"), ("target-not-applicable", "one", "p; q")), "p.json"),
        "requests": put(tmp_path, "\n".join([request("target-reuse"), request("target-not-applicable", ["definition"]), request("target-missing-plan")]), "r.jsonl"), "output": str(tmp_path / "out" / "d.jsonl"),
    }
    assert cli.main(["decide", *[x for k, v in paths.items() for x in (f"--{k}", v)]]) == 0
    told = [json.loads(x) for x in open(paths["output"])]
    got = {r["request"]["target_query_id"]: (r["decision"]["executed_action"], r["decision"]["reason"]) for r in told}
    assert got == {"target-reuse": ("reuse", "reuse_selected"), "target-not-applicable": ("direct", "no_eligible_experience"), "target-missing-plan": ("direct", "invalid_query_plan_fallback")}
    assert [r["request"]["target_query_id"] for r in told] == sorted(got)
    for r in told:
        assert set(r) == {"artifact_type", "schema_version", "config_sha256", "memory_snapshot_id", "request", "effective_config", "recall", "portfolio", "decision"}
        assert r["artifact_type"] == "trusted_reuse_decision" and r["schema_version"] == 2 and r["memory_snapshot_id"] == "m1" and len(r["config_sha256"]) == 64
        assert set(r["effective_config"]) == {"gate_policy", "query_budget", "environment", "environment_compatibility", "candidate_recall", "applicability", "application"}
        assert r["effective_config"]["environment"] == ENV and isinstance(r["effective_config"]["gate_policy"]["minimum_applicability"], float)
        assert set(r["request"]) == {"target_query_id", "target_query", "signatures", "signature_extractor_id", "signature_extractor_version", "signature_input_scope"}
        assert r["recall"] == {"scorer_id": "source-query-jaccard-v1", "max_candidates": r["effective_config"]["candidate_recall"]["maximum_candidates"], "candidate_experience_ids": ["one"]} and r["portfolio"] == {"enabled": False}
        assert {"intended_action", "intended_experience_id", "executed_action", "executed_experience_id", "executed_query", "reason", "traces"} <= set(r["decision"]) and [t["experience_id"] for t in r["decision"]["traces"]] == ["one"]
    text = open(paths["output"]).read()
    assert not any(w in text for w in ("gold", "direct_score", "reuse_score"))
    bad = put(tmp_path, toml(application__application_version="v2"), "c2.toml")
    assert cli.main(["decide", *[x for k, v in (paths | {"config": bad}).items() for x in (f"--{k}", v)]]) == 2


def test_other_commands(spark, tmp_path, capsys):
    assert cli.main(["config-validate", "--config", put(tmp_path, toml(), "c")]) == 0
    assert cli.main(["config-validate", "--config", put(tmp_path, toml(environment__index_id="unset"), "d")]) == 2
    assert cli.main(["config-validate", "--allow-placeholders", "--config", str(tmp_path / "d")]) == 0
    assert cli.main(["memory-validate", "--memory", put(tmp_path, memory(record()), "m")]) == 0
    assert '"state_counts": {"active": 1}' in capsys.readouterr().out
    out = str(tmp_path / "o.json")
    assert cli.main(["oracle", "--input", put(tmp_path, HEAD + ",fresh_score\n" + "\n".join(ROWS), "i"), "--output", out]) == 0
    doc = json.load(open(out))
    assert doc["offline_diagnostic_only"] and doc["target_count"] == 2 and len(doc["targets"]) == 2 and not any("winning" in k for t in doc["targets"] for k in t)
    assert cli.main(["demo"]) == 0 and "reuse_selected" in capsys.readouterr().out
    with pytest.raises(ValueError):
        oracle_report(spark.range(1), spark.range(1).selectExpr("id winning_action"), out, "x")


def test_atomic_write_leaves_no_rest(tmp_path):
    p = str(tmp_path / "x")
    write_atomic(p, "a")
    with pytest.raises(TypeError):
        write_atomic(p, 5)
    assert open(p).read() == "a" and os.listdir(tmp_path) == ["x"]


def test_joined_files_are_those_of_the_driver(spark, tmp_path):
    """Part files of several tasks, put together, byte by byte what rows through the driver would give; none and one row too."""
    rows = [(f"t{i:03}", i, [i], "é\n\"" * (i % 3), None if i % 2 else 0.1 * i) for i in range(50)]
    df = spark.createDataFrame(rows, "target_query_id string, n long, a array<long>, s string, x double").repartition(7)
    for n in (50, 1, 0):
        p = str(tmp_path / f"j{n}")
        write_jsonl_file(df.where(f"n < {n}"), p, ["target_query_id"])
        lines = open(p, encoding="utf-8").read().splitlines()
        assert [json.loads(x) for x in lines] == [{"target_query_id": t, "n": i, "a": a, "s": s, "x": x} for t, i, a, s, x in rows[:n]] and lines == [json.dumps(json.loads(x), ensure_ascii=False, separators=(",", ":"), sort_keys=True) for x in lines]
        oracle_report(spark.range(1).selectExpr("2 AS target_count"), df.where(f"n < {n}"), p, "in.csv")
        doc = {"offline_diagnostic_only": True, "source_csv": "in.csv", "target_count": 2, "targets": [{"target_query_id": t, "n": i, "a": a, "s": s, "x": x} for t, i, a, s, x in rows[:n]]}
        text = open(p, encoding="utf-8").read()
        assert json.loads(text) == doc and (n == 0 or text == json.dumps(doc, ensure_ascii=False, indent=2) + "\n")
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".")]
    q = f"file://{tmp_path}/by-scheme"
    write_jsonl_file(df, q, ["target_query_id"])
    write_jsonl_file(df, q, ["target_query_id"])
    assert len(open(tmp_path / "by-scheme").readlines()) == 50


def test_snapshot_file_is_the_canonical_document(spark, tmp_path):
    a = read_snapshot(spark, put(tmp_path, memory(record(), *[record(f"m{i}", "candidate", transfer_observations=[]) for i in range(20)]), "a"))
    for records in (a.records, a.records.limit(0)):
        o = a.observations.join(records.select("experience_id"), "experience_id", "left_semi")
        write_snapshot(records.repartition(5), o, "m1", a.policy, str(tmp_path / "w"))
        assert open(tmp_path / "w", encoding="utf-8").read() == dumps_snapshot(records, o, "m1", a.policy)
    write_snapshot(a.records, a.observations, "m1", a.policy, str(tmp_path / "w"))
    assert read_snapshot(spark, str(tmp_path / "w")).records.count() == 21


def test_csv_records_over_splits(spark, tmp_path):
    """Fields of several lines, doubled quotes and blank lines in a file read by many tasks; errors tell the record, not the line."""
    import csv
    import io

    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow([*HEAD.split(","), "fresh_score"])
    want = [(f'q{i}\nof "{i}",\n\nlines' if i % 3 == 0 else f"q{i}", f"e{i}") for i in range(400)]
    for i, (q, e) in enumerate(want):
        w.writerow([q, e, "s", 1, 0.5, 0.25, 1, 2, 2048, ""])
        if i % 50 == 0:
            out.write("\n")
    p = put(tmp_path, "\ufeff" + out.getvalue(), "big.csv")
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "2000")
    try:
        assert spark.read.text(p).rdd.getNumPartitions() > 3
        rows = read_oracle_csv(spark, p).collect()
        assert sorted((r.target_query_id, r.experience_id) for r in rows) == sorted(want)
        text = out.getvalue().replace("e251,s,1,", "e251,s,one,").replace("e7,s,1,0.5", "e7,s,1,half")
        with pytest.raises(FormatError, match="record 9: direct_score; record 253: candidate_rank"):
            read_oracle_csv(spark, put(tmp_path, text, "bad.csv"))
    finally:
        spark.conf.set(key, old)


def test_csv_is_parsed_once(spark, tmp_path):
    """Checks and the caller read typed rows; nothing parses a record again."""
    rows = read_oracle_csv(spark, put(tmp_path, HEAD + ",fresh_score\n" + "\n".join(ROWS) + "\n"))
    assert "from_csv" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 3


def test_snapshot_in_splits(spark, tmp_path):
    """A document read by many tasks: braces, quotes and escapes in strings, and what is wrong between records."""
    odd = 'a}"{[\\ é\n]},{'
    given = [record(f"m{i}", "candidate", transfer_observations=[]) for i in range(60)]
    for r in given:
        r["transformation"]["source_query"] = odd
    text = memory(*given)
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "3000")
    try:
        for i, good in enumerate((text, json.dumps(json.loads(text), indent=1, ensure_ascii=False) + "\n")):
            p = put(tmp_path, good, f"s{i}")
            rows = read_snapshot(spark, p).records
            assert spark.read.option("lineSep", "}").text(p).rdd.getNumPartitions() > 3
            assert {(r.experience_id, r.source_query) for r in rows.select("experience_id", "source_query").collect()} == {(f"m{i}", odd) for i in range(60)}
        for i, (a, b) in enumerate((("}, {", "}{"), ("}, {", "}, 1, {"), ("}, {", "},, {"), ('"records": [', '"records": [,'))):
            bad = text[::-1].replace(a[::-1], b[::-1], 1)[::-1] if a == "}, {" else text.replace(a, b, 1)
            assert bad != text
            with pytest.raises(FormatError):
                read_snapshot(spark, put(tmp_path, bad, f"b{i}"))
        for i, bad in enumerate((text[:-1], text + "}", text + "{}", "", "[]")):
            with pytest.raises(FormatError):
                read_snapshot(spark, put(tmp_path, bad, f"c{i}"))
    finally:
        spark.conf.set(key, old)
