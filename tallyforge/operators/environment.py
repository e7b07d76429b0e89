"""Environment compatibility, strict or tiered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_unspecified
from ..policies import EnvironmentPolicy
from ..schemas import HARD_FIELDS, RETRIEVAL_FIELDS, SOFT_FIELDS


def _names(fields: tuple[str, ...], holds: Callable[[str], Column]) -> Column:
    return F.array_compact(F.array(*[F.when(holds(f), F.lit(f)) for f in fields]))


def compatibility(reference: Column, current: Column, policy: EnvironmentPolicy = EnvironmentPolicy()) -> dict[str, Column]:
    """Columns of a comparison of two environment structs.

    A field that either side leaves unspecified is a hard mismatch in both modes. Names come first from
    unspecified fields, then from differing ones, each in field order.
    """
    unknown = lambda f: is_unspecified(reference[f]) | is_unspecified(current[f])
    differs = lambda f: ~reference[f].eqNullSafe(current[f])
    strict = policy.mode == "strict"
    hard = F.array_union(_names(RETRIEVAL_FIELDS, unknown), _names(RETRIEVAL_FIELDS if strict else HARD_FIELDS, differs))
    soft = F.array().cast("array<string>") if strict else _names(SOFT_FIELDS, lambda f: ~unknown(f) & differs(f))
    clean = F.size(hard) == 0
    score = F.when(clean, F.greatest(F.lit(0.0), 1.0 - F.size(soft) * F.lit(0.0 if strict else policy.soft_mismatch_penalty))).otherwise(0.0)
    ok = clean if strict else clean & (score >= policy.minimum_score)
    return {"environment_compatible": ok, "environment_score": score, "environment_mode": F.lit(policy.mode), "environment_hard_mismatches": hard, "environment_soft_mismatches": soft}


def match(records: DataFrame, current: Column, policy: EnvironmentPolicy = EnvironmentPolicy(), environment: str = "environment") -> DataFrame:
    """records with the columns of their comparison with the current environment.

    Records share few environments, so each distinct one is compared once and joined back; the dimension is
    sent to the records where it's small, as Spark finds out from its size.
    """
    known = records.select(F.col(environment).alias("_e")).distinct()
    compared = known.withColumns(compatibility(F.col("_e"), current, policy))
    return records.join(compared, F.col(environment).eqNullSafe(F.col("_e")), "left").drop("_e")
