"""Integrity of evidence: transfer observations, stored records, identifiers. All are violations tables (rule, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_unspecified
from ..policies import LifecyclePolicy
from .reliability import lifecycle_state


class IntegrityError(ValueError):
    """Raised by raise_if_any for a table that breaks its rules."""


def raise_if_any(found: DataFrame, shown: int = 20) -> None:
    """Raise with the first few violations, if there are any."""
    rows = found.limit(shown).collect()
    if rows:
        raise IntegrityError("; ".join(f"{r[0]}: {r[1]}" for r in rows))


def _explode(df: DataFrame, rules: list[tuple[Column, str]], key: Column) -> DataFrame:
    named = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules]
    return df.select(F.explode(F.array_compact(F.array(*named))).alias("rule"), key.alias("key"))


def transfer_violations(observations: DataFrame, sources: DataFrame) -> DataFrame:
    """(rule, key) for observations that are no independent evidence of their experience.

    observations: experience_id, seq, target_query_id, target_group_id, dataset_id, evidence_role,
    metric_protocol_id, applier_id, applier_version. sources: experience_id, state, source_query_id, and the
    same of the source evidence as source_*. Of repeated targets or groups, the first by seq is legal.
    One shuffle by experience serves the join and both windows.
    """
    s = sources.select(
        "experience_id", F.col("state").alias("_state"), F.col("source_query_id").alias("_q"), F.col("source_dataset_id").alias("_ds"), F.col("source_group_id").alias("_g"),
        F.col("source_metric_protocol_id").alias("_m"), F.col("source_applier_id").alias("_a"), F.col("source_applier_version").alias("_v"),
    )
    nth = lambda col: F.row_number().over(Window.partitionBy("experience_id", "dataset_id", col).orderBy("seq")) > 1
    j = observations.join(s, "experience_id", "left").withColumns({"_t2": nth("target_query_id"), "_g2": nth("target_group_id")})
    c = F.col
    rules = [
        (c("_state").isNull(), "unknown_experience"),
        (c("_state") == "retired", "retired_experience"),
        (c("evidence_role") == "test", "test_evidence"),
        (c("target_query_id") == c("_q"), "source_query_as_transfer"),
        ((c("dataset_id") == c("_ds")) & (c("target_group_id") == c("_g")), "source_group_as_transfer"),
        (c("metric_protocol_id") != c("_m"), "metric_protocol_differs"),
        ((c("applier_id") != c("_a")) | (c("applier_version") != c("_v")), "applier_differs"),
        (c("_t2"), "duplicate_target"),
        (c("_g2"), "duplicate_group"),
    ]
    return _explode(j, rules, F.concat_ws("/", "experience_id", "seq"))


def record_violations(records: DataFrame, observations: DataFrame, policy: LifecyclePolicy = LifecyclePolicy()) -> DataFrame:
    """(rule, key) for stored records: blank or repeated ids, source evidence that could not have entered, metadata
    that contradicts it, and a state that the ordered observations don't lead to (retired is exempt)."""
    states = lifecycle_state(observations, policy).select("experience_id", F.col("state").alias("_expected"))
    j = records.join(states, "experience_id", "left")
    c = F.col
    against = lambda stored, evidence: ~is_unspecified(c(stored)) & (c(stored) != c(evidence))
    rules = [
        (is_blank(c("experience_id")), "blank_experience_id"),
        (c("evidence_role") == "test", "test_source_evidence"),
        (~(c("reuse_score") - c("direct_score") > c("minimum_gain")), "source_fails_write_gate"),
        (against("stored_dataset_id", "source_dataset_id"), "source_dataset_id_contradicted"),
        (against("stored_split", "source_split"), "source_split_contradicted"),
        (against("stored_group_id", "source_group_id"), "source_group_id_contradicted"),
        ((c("state") != "retired") & (c("state") != F.coalesce("_expected", F.lit("candidate"))), "state_contradicts_evidence"),
    ]
    twice = duplicates(records, "experience_id")
    return _explode(j, rules, c("experience_id")).union(twice)


def is_blank(c: Column) -> Column:
    from ..functions.text import py_strip

    return F.coalesce(py_strip(c) == "", F.lit(True))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(rule, key) for repeated keys."""
    return df.groupBy(*keys).count().where("count > 1").select(F.lit("duplicate_" + "_".join(keys)).alias("rule"), F.concat_ws("/", *keys).alias("key"))
