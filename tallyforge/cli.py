"""Command line: demo, oracle, config-validate, memory-validate, decide."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import functions as F

from .operators import oracle
from .operators.evidence_checks import IntegrityError
from .operators.gate import traces_by_target
from .operators.reliability import reliability, state_histogram
from .plans.decide import decide_batch
from .session import session
from .sources.config import ConfigError, load_config
from .sources.oracle_csv import read_oracle_csv
from .sources.requests import read_plan_bundle, read_requests
from .sources.sinks import oracle_report, write_jsonl_file
from .sources.snapshot import read_snapshot
from .sources.strict_json import FormatError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyforge")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("demo")
    o = sub.add_parser("oracle")
    o.add_argument("--input", required=True), o.add_argument("--output", required=True), o.add_argument("--good-threshold", type=float, default=0.5)
    c = sub.add_parser("config-validate")
    c.add_argument("--config", required=True), c.add_argument("--allow-placeholders", action="store_true")
    sub.add_parser("memory-validate").add_argument("--memory", required=True)
    d = sub.add_parser("decide")
    for name in ("config", "memory", "requests", "plans", "output"):
        d.add_argument(f"--{name}", required=True)
    return p


def scored_records(snapshot):
    """Records of a snapshot with their reliability, computed once for each experience."""
    return snapshot.records.join(reliability(snapshot.observations, snapshot.records), "experience_id")


def _decide(a) -> None:
    config = load_config(a.config, for_runtime=True).require_decidable()
    spark = session()
    snapshot = read_snapshot(spark, a.memory).require_runtime_ready()
    requests, bundle = read_requests(spark, a.requests), read_plan_bundle(spark, a.plans)
    app = config.values["application"]
    if (bundle.applier_id, bundle.application_version) != (app["applier_id"], app["application_version"]):
        raise FormatError("the plan bundle's applier differs from the configuration's")
    out = decide_batch(
        scored_records(snapshot), requests, bundle.plans, config.environment, gate=config.gate_policy, budget=config.query_budget, environment_policy=config.environment_policy,
        application=bundle.application(config.query_budget), max_candidates=config.max_candidates,
    )
    values = config.values
    sections = {k: values[k] for k in ("environment_compatibility", "candidate_recall", "applicability", "application") if k in values}
    effective = json.dumps({"gate_policy": asdict(config.gate_policy), "query_budget": asdict(config.query_budget), "environment": config.environment, **sections})
    found = out.recalled.groupBy("target_query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("recall_rank", "experience_id"))), lambda x: x["experience_id"]).alias("found"))
    asked = requests.select("target_query_id", F.struct(*requests.columns).alias("request"))
    decided = out.decisions.join(traces_by_target(out.traces), "target_query_id", "left").withColumn("traces", F.coalesce("traces", F.array().cast(traces_by_target(out.traces).schema["traces"].dataType)))
    decided = decided.select("target_query_id", F.struct(*sorted(decided.columns)).alias("decision"))
    rows = decided.join(asked, "target_query_id").join(found, "target_query_id", "left").withColumns(
        {
            "recall": F.struct(F.lit(out.recall_scorer_id).alias("scorer_id"), F.lit(config.max_candidates).alias("max_candidates"), F.coalesce("found", F.array().cast("array<string>")).alias("candidate_experience_ids")),
            "portfolio": F.struct(F.lit(out.portfolio is not None).alias("enabled")),
            "artifact_type": F.lit("trusted_reuse_decision"), "schema_version": F.lit(2), "config_sha256": F.lit(config.sha256), "memory_snapshot_id": F.lit(snapshot.memory_snapshot_id),
            "effective_config": F.from_json(F.lit(effective), F.schema_of_json(F.lit(effective))),
        }
    ).drop("found")
    write_jsonl_file(rows, a.output, ["target_query_id"], leave=["target_query_id"])
    # which records could be recalled at all is the same for every request, so it is written once beside the decisions
    audit = out.eligible.select("experience_id", F.lit("eligible").alias("role")).union(out.rejected.select("experience_id", F.lit("environment_rejected")))
    if out.portfolio is not None:
        audit = audit.union(out.portfolio.select("experience_id", "tier"))
    write_jsonl_file(audit, f"{a.output}.audit.jsonl", ["role", "experience_id"])
    print(f"decisions written to {a.output}")


def demo_decisions(spark):
    """Decisions over a built-in memory of one active experience."""
    from .schemas import ENVIRONMENT_FIELDS

    env = {f: f"demo-{f}" for f in ENVIRONMENT_FIELDS}
    obs = [("demo", i, d, r, 0.5) for i, (d, r) in enumerate(((0.0, 1.0), (0.8, 0.9), (0.7, 0.8)))]
    observations = spark.createDataFrame(obs, "experience_id string, seq int, direct_score double, reuse_score double, good_threshold double")
    memory = spark.range(1).select(
        F.lit("demo").alias("experience_id"), F.lit("active").alias("state"), F.lit("source").alias("source_query_id"), F.lit("Which of two rivers is longer?").alias("source_query"), F.struct(*[F.lit(v).alias(k) for k, v in env.items()]).alias("environment"),
        F.lit("demo").alias("provenance"), F.array(F.lit("comparison")).alias("applicability_signature"), F.array().cast("array<string>").alias("contraindication_signature"), F.lit("precomputed-plan").alias("applier_id"), F.lit("v1").alias("applier_version"),
    ).join(reliability(observations), "experience_id")
    requests = spark.createDataFrame([("t1", "Which of two lakes is deeper?", ["comparison"])], "target_query_id string, target_query string, signatures array<string>")
    plans = spark.createDataFrame([("t1", "demo", "depth of lake one; depth of lake two")], "target_query_id string, experience_id string, transformed_query string")
    return decide_batch(memory, requests, plans, env).decisions


def run(argv: list[str]) -> int:
    a = parser().parse_args(argv)
    if a.command == "demo":
        for r in demo_decisions(session()).toLocalIterator():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    elif a.command == "oracle":
        rows = read_oracle_csv(session(), a.input)
        oracle_report(oracle.summary(rows, a.good_threshold), oracle.per_target(rows, a.good_threshold), a.output, a.input)
        print(f"offline oracle report written to {a.output}")
    elif a.command == "config-validate":
        c = load_config(a.config, for_runtime=not a.allow_placeholders)
        print(json.dumps({"config": a.config, "experiment": c.values["experiment"]["name"], "runtime_ready": not a.allow_placeholders}))
    elif a.command == "memory-validate":
        s = read_snapshot(session(), a.memory)
        states = {r["state"]: r["n"] for r in state_histogram(s.records).orderBy("state").collect()}
        print(json.dumps({"memory": a.memory, "memory_snapshot_id": s.memory_snapshot_id, "schema_version": s.schema_version, "runtime_ready": s.schema_version == 2, "record_count": sum(states.values()), "state_counts": states}))
    else:
        _decide(a)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(sys.argv[1:] if argv is None else argv)
    except (ConfigError, FormatError, IntegrityError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
