"""Run configuration: strict TOML to policies. Control data, read on the driver."""

from __future__ import annotations

import hashlib
import math
import tomllib
from dataclasses import dataclass

from ..policies import EnvironmentPolicy, GatePolicy, LifecyclePolicy, QueryBudget
from ..schemas import APPLICABILITY_SCORER, ENVIRONMENT_FIELDS, RECALL_SCORER, UNSPECIFIED


class ConfigError(ValueError):
    """Raised for a configuration that breaks its format or isn't ready to run."""


# Sections, fields and kinds of the format. A trailing ? marks an optional field.
FORMAT = {
    "experiment": {"name": "text", "seed": "whole0"},
    "actions": {"direct": "flag", "reuse": "flag", "fresh": "flag"},
    "evaluation": {"good_threshold": "unit", "max_history_candidates": "whole1", "paired_harm_is_primary": "flag"},
    "environment": dict.fromkeys(ENVIRONMENT_FIELDS, "text"),
    "environment_compatibility": {"mode": "text", "minimum_score": "unit", "soft_mismatch_penalty": "unit"},
    "write_gate": {"minimum_source_gain": "number0"},
    "reliability": {
        "minimum_transfer_observations": "whole1", "minimum_direct_good_observations": "whole1", "minimum_benefits": "whole0", "minimum_mean_gain": "number",
        "maximum_conditional_breakage_upper_bound": "unit", "quarantine_at_harm_count": "whole1",
    },
    "candidate_recall": {"scorer": "text", "maximum_candidates": "whole1"},
    "applicability": {"scorer": "text", "minimum_score": "unit"},
    "application": {"applier_id": "text", "application_version": "text"},
    "budget": {"maximum_retrieval_queries": "whole1", "top_k": "whole1", "context_tokens": "whole1", "maximum_query_characters": "whole1", "maximum_application_cost?": "number0"},
}


def _kind_ok(kind: str, v) -> bool:
    if kind == "text":
        return isinstance(v, str) and bool(v.strip())
    if kind == "flag":
        return isinstance(v, bool)
    if kind.startswith("whole"):
        return isinstance(v, int) and not isinstance(v, bool) and v >= int(kind[-1])
    if isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v):
        return False
    return {"unit": 0 <= v <= 1, "number": True, "number0": v >= 0}[kind]


@dataclass(frozen=True)
class RunConfig:
    values: dict[str, dict]
    sha256: str
    environment: dict[str, str]
    environment_policy: EnvironmentPolicy
    lifecycle_policy: LifecyclePolicy
    gate_policy: GatePolicy
    query_budget: QueryBudget

    @property
    def max_candidates(self) -> int:
        return self.values["candidate_recall"]["maximum_candidates"]

    def require_runtime_ready(self) -> RunConfig:
        app = self.values["application"]
        open_ = [f"environment.{k}" for k, v in self.environment.items() if _placeholder(v)] + [f"application.{k}" for k, v in app.items() if _placeholder(v)]
        if open_:
            raise ConfigError("replace placeholder values: " + ", ".join(open_))
        return self

    def require_decidable(self) -> RunConfig:
        a = self.values["actions"]
        if not (a["direct"] and a["reuse"]) or a["fresh"]:
            raise ConfigError("decide needs direct and reuse, without fresh")
        for section, known in (("candidate_recall", RECALL_SCORER), ("applicability", APPLICABILITY_SCORER)):
            if self.values[section]["scorer"] != known:
                raise ConfigError(f"unsupported {section} scorer: {self.values[section]['scorer']}")
        return self


def _placeholder(v: str) -> bool:
    return v.strip().casefold() in UNSPECIFIED


def parse_config(data: bytes) -> RunConfig:
    try:
        doc = tomllib.loads(data.decode("utf-8"))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigError(f"invalid TOML: {e}") from None
    if set(doc) != set(FORMAT):
        raise ConfigError(f"unknown or missing sections: {sorted(set(doc) ^ set(FORMAT))}")
    for section, fields in FORMAT.items():
        have = doc[section]
        if not isinstance(have, dict):
            raise ConfigError(f"[{section}] must be a table")
        needed, every = {f for f in fields if f[-1] != "?"}, {f.rstrip("?"): k for f, k in fields.items()}
        if wrong := (needed - set(have)) | (set(have) - set(every)):
            raise ConfigError(f"[{section}] has unknown or missing fields {sorted(wrong)}")
        for name, v in have.items():
            if not _kind_ok(every[name], v):
                raise ConfigError(f"[{section}].{name} is invalid: {v!r}")
    r, b = doc["reliability"], doc["budget"]
    if doc["evaluation"]["max_history_candidates"] != doc["candidate_recall"]["maximum_candidates"]:
        raise ConfigError("[evaluation].max_history_candidates must equal [candidate_recall].maximum_candidates")
    risk, gain = float(r["maximum_conditional_breakage_upper_bound"]), float(r["minimum_mean_gain"])
    try:
        return RunConfig(
            doc, hashlib.sha256(data).hexdigest(), doc["environment"], EnvironmentPolicy(**doc["environment_compatibility"]),
            LifecyclePolicy(r["minimum_transfer_observations"], r["minimum_direct_good_observations"], r["minimum_benefits"], gain, risk, r["quarantine_at_harm_count"]),
            GatePolicy(r["minimum_transfer_observations"], r["minimum_benefits"], gain, risk, float(doc["applicability"]["minimum_score"])),
            QueryBudget(b["maximum_retrieval_queries"], b["top_k"], b["context_tokens"], b["maximum_query_characters"], b.get("maximum_application_cost")),
        )
    except ValueError as e:
        raise ConfigError(str(e)) from None


def load_config(path: str, for_runtime: bool = False) -> RunConfig:
    with open(path, "rb") as f:
        config = parse_config(f.read())
    return config.require_runtime_ready() if for_runtime else config
