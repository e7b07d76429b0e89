"""Applicability: which declared signatures of an experience the current query shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import normalize_signatures
from ..schemas import APPLICABILITY_SCORER


def coverage(required: Column, observed: Column, contraindications: Column, normalized: bool = False) -> dict[str, Column]:
    """Score and explanation; arrays of signatures, nulls counting as empty.

    A matched contraindication vetoes (score 0). Without required or observed signatures, the
    score is 0 and features are missing.
    """
    empty = F.array().cast("array<string>")
    norm = (lambda c: F.coalesce(c, empty)) if normalized else (lambda c: normalize_signatures(F.coalesce(c, empty)))
    req, obs, con = F.sort_array(norm(required)), norm(observed), F.sort_array(norm(contraindications))
    vetoes = F.array_intersect(con, obs)
    veto = F.size(vetoes) > 0
    missing = ~veto & ((F.size(req) == 0) | (F.size(obs) == 0))
    matched = F.when(missing, empty).otherwise(F.array_intersect(req, obs))
    score = F.when(veto | missing, 0.0).otherwise(F.size(F.array_intersect(req, obs)) / F.greatest(F.size(req), F.lit(1)).cast("double"))
    return {
        "applicability_score": score,
        "applicability_scorer_id": F.lit(APPLICABILITY_SCORER),
        "applicability_matched_signatures": matched,
        "applicability_required_signatures": req,
        "applicability_matched_contraindications": vetoes,
        "applicability_missing_features": missing,
    }
