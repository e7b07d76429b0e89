"""Memory snapshot: one strict JSON document to and from tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import close, paired_outcome
from ..functions.text import gap_violation, normalize_gap, normalize_signatures
from ..operators.evidence_checks import raise_if_any, record_violations, transfer_violations
from ..policies import LifecyclePolicy
from ..schemas import ENVIRONMENT_FIELDS, RECORD
from ..storage import written
from .json_parts import document_parts
from .sinks import write_joined
from .strict_json import FormatError, check_shape, problems, refuse_problems

VERSIONS = (1, 2)
POLICY_FIELDS = ("promotion_min_observations", "promotion_min_direct_good_observations", "promotion_min_benefits", "promotion_min_mean_gain", "promotion_max_wilson_breakage_upper_bound", "quarantine_at_harm_count")
_SINCE_2 = ("diagnosed_failure", "gap_categories", "contraindication_signature")


def _kind(t: T.DataType):
    if isinstance(t, T.StructType):
        return {f.name: _kind(f.dataType) for f in t}
    if isinstance(t, T.ArrayType):
        return [_kind(t.elementType)]
    return {"string": str, "double": float, "int": int, "bigint": int, "boolean": bool}[t.simpleString()]


def _check(doc) -> dict:
    """Checks a document, whose records may be left out, and returns the shape of a record."""
    if not isinstance(doc, dict) or doc.get("schema_version") not in VERSIONS or isinstance(doc.get("schema_version"), bool):
        raise FormatError("unsupported schema_version")
    record = _kind(RECORD)
    if doc["schema_version"] == 1:
        record["transformation"] = {k: v for k, v in record["transformation"].items() if k not in _SINCE_2}
    policy = {k: int if "count" in k or "observations" in k or "benefits" in k else float for k in POLICY_FIELDS}
    check_shape(doc, {"schema_version": int, "memory_snapshot_id": str, "lifecycle_policy": policy, "records": [record]})
    if not doc["memory_snapshot_id"].strip():
        raise FormatError("memory_snapshot_id must not be blank")
    return record


class Snapshot:
    """records and observations tables with the document's id, version and policy."""

    def __init__(self, records: DataFrame, observations: DataFrame, memory_snapshot_id: str, schema_version: int, policy: LifecyclePolicy):
        self.records, self.observations = records, observations
        self.memory_snapshot_id, self.schema_version, self.policy = memory_snapshot_id, schema_version, policy

    def require_runtime_ready(self) -> Snapshot:
        if self.schema_version != VERSIONS[-1]:
            raise FormatError("older snapshots can be audited only; write them again to upgrade")
        return self


def read_snapshot(spark: SparkSession, path: str, check: bool = True) -> Snapshot:
    """Tables of a snapshot document, read in parts. All rules are checked, derived fields included."""
    doc, parts = document_parts(spark, path)
    shape = _check(doc)
    refuse_problems(problems(parts, lambda r: check_shape(r, shape, "$.records[]")), "memory snapshot")
    policy = LifecyclePolicy(**doc["lifecycle_policy"])
    r = written(parts.select(F.from_json("value", RECORD).alias("r")).select("r.*"), "snapshot-records")
    t, s = "transformation.", "source_evidence."
    empty = F.array().cast("array<string>")
    records = r.select(
        F.col(t + "experience_id").alias("experience_id"), "state", *[F.col(t + x).alias(x) for x in ("source_query_id", "source_query", "transformed_query", "atomic_units", "environment", "provenance", "transformation_type", "application_note")],
        normalize_signatures(F.col(t + "applicability_signature")).alias("applicability_signature"), normalize_signatures(F.coalesce(t + "contraindication_signature", empty)).alias("contraindication_signature"),
        F.transform(F.coalesce(t + "gap_categories", empty), normalize_gap).alias("gap_categories"), F.coalesce(t + "diagnosed_failure", F.lit("")).alias("diagnosed_failure"),
        F.col(t + "source_dataset_id").alias("stored_dataset_id"), F.col(t + "source_split").alias("stored_split"), F.col(t + "source_group_id").alias("stored_group_id"),
        *[F.col(s + x).alias(x) for x in ("direct_score", "reuse_score", "evidence_role", "minimum_gain", "applier_id", "applier_version", "metric_protocol_id", "gain", "passes_paired_write_gate")],
        F.col(s + "dataset_id").alias("source_dataset_id"), F.col(s + "split").alias("source_split"), F.col(s + "source_group_id").alias("source_group_id"),
        F.col(s + "metric_protocol_id").alias("source_metric_protocol_id"), F.col(s + "applier_id").alias("source_applier_id"), F.col(s + "applier_version").alias("source_applier_version"),
    )
    observations = r.select(F.col(t + "experience_id").alias("experience_id"), F.posexplode("transfer_observations").alias("seq", "o")).select("experience_id", "seq", "o.*")
    if check:
        raise_if_any(snapshot_violations(records, observations, policy))
    return Snapshot(records, observations, doc["memory_snapshot_id"], doc["schema_version"], policy)


def snapshot_violations(records: DataFrame, observations: DataFrame, policy: LifecyclePolicy) -> DataFrame:
    """(rule, key): stored and transfer rules, and derived fields that don't follow from the scores."""
    c = F.col
    gain = c("reuse_score") - c("direct_score")
    wrong = records.where(~close(c("gain"), gain, 1e-12) | (c("passes_paired_write_gate") != (gain > c("minimum_gain")))).select(F.lit("derived_source_field").alias("rule"), c("experience_id").alias("key"))
    gaps = records.where(gap_violation(c("gap_categories")).isNotNull()).select(F.lit("gap_categories_invalid"), c("experience_id"))
    told = observations.where((c("outcome") != paired_outcome(c("direct_score"), c("reuse_score"), c("good_threshold"))) | ~close(c("gain"), gain, 1e-12)).select(F.lit("derived_observation_field"), F.concat_ws("/", "experience_id", "seq"))
    # a retired record may hold evidence from before
    live = transfer_violations(observations, records).where("rule <> 'retired_experience'")
    return record_violations(records, observations, policy).union(live).union(wrong).union(gaps).union(told)


def to_document(records: DataFrame, observations: DataFrame) -> DataFrame:
    """(experience_id, json): canonical JSON of each record, keys sorted; nested observations in order of seq."""
    o = observations.withColumn("outcome", paired_outcome(F.col("direct_score"), F.col("reuse_score"), F.col("good_threshold"))).withColumn("gain", F.col("reuse_score") - F.col("direct_score"))
    fields = sorted(f.name for f in RECORD["transfer_observations"].dataType.elementType)
    nested = o.groupBy("experience_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("o")))), lambda x: x["o"]).alias("transfer_observations"))
    j = records.join(nested, "experience_id", "left")
    env = F.struct(*[F.col(f"environment.{f}").alias(f) for f in sorted(ENVIRONMENT_FIELDS)]).alias("environment")
    moved = {"source_dataset_id": "stored_dataset_id", "source_split": "stored_split", "source_group_id": "stored_group_id"}
    t = F.struct(*[env if f == "environment" else F.col(moved.get(f, f)).alias(f) for f in sorted(x.name for x in RECORD["transformation"].dataType)])
    back = {"dataset_id": "source_dataset_id", "split": "source_split"}
    gain = F.col("reuse_score") - F.col("direct_score")
    derived = {"gain": gain, "passes_paired_write_gate": gain > F.col("minimum_gain")}
    s = F.struct(*[derived.get(f, F.col(back.get(f, f))).alias(f) for f in sorted(x.name for x in RECORD["source_evidence"].dataType)])
    obs = F.coalesce("transfer_observations", F.array().cast(j.schema["transfer_observations"].dataType))
    row = F.struct(s.alias("source_evidence"), F.col("state"), obs.alias("transfer_observations"), t.alias("transformation"))
    return j.select("experience_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def _canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_records(records: DataFrame, observations: DataFrame) -> DataFrame:
    """(experience_id, value): each record as it stands in the document, written out where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [_canonical(json.loads(x)) for x in b.column("json").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("experience_id"), pa.array(text, pa.string())], names=["experience_id", "value"])

    return to_document(records, observations).mapInArrow(run, "experience_id string, value string")


def _around(memory_snapshot_id: str, policy: LifecyclePolicy) -> tuple[str, str]:
    """What comes before and after the records."""
    doc = {"schema_version": VERSIONS[-1], "memory_snapshot_id": memory_snapshot_id, "lifecycle_policy": {k: getattr(policy, k) for k in POLICY_FIELDS}, "records": []}
    head, tail = _canonical(doc).split('"records":[]')
    return f'{head}"records":[', f"]{tail}\n"


def dumps_snapshot(records: DataFrame, observations: DataFrame, memory_snapshot_id: str, policy: LifecyclePolicy) -> str:
    """The canonical document as a string, for small memories; write_snapshot writes those of any size."""
    raise_if_any(snapshot_violations(records, observations, policy))
    head, tail = _around(memory_snapshot_id, policy)
    return head + ",".join(r["value"] for r in canonical_records(records, observations).orderBy("experience_id").toLocalIterator()) + tail


def write_snapshot(records: DataFrame, observations: DataFrame, memory_snapshot_id: str, policy: LifecyclePolicy, path: str) -> None:
    """The single canonical document, records by id, sorted keys, compact; records are sorted and written by tasks, never by the driver."""
    raise_if_any(snapshot_violations(records, observations, policy))
    head, tail = _around(memory_snapshot_id, policy)
    write_joined(canonical_records(records, observations), path, ["experience_id"], ",", head, tail)
