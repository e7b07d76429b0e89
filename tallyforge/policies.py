"""Thresholds as frozen values, checked when built."""

from __future__ import annotations

import math
from dataclasses import dataclass

from .schemas import TIERS


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _unit(x: float) -> bool:
    return math.isfinite(x) and 0 <= x <= 1


def _whole(x, least: int) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= least


@dataclass(frozen=True)
class GatePolicy:
    minimum_observations: int = 2
    minimum_benefits: int = 1
    minimum_mean_gain: float = 0.0
    maximum_risk_upper_bound: float = 0.70
    minimum_applicability: float = 0.50

    def __post_init__(self) -> None:
        _need(_whole(self.minimum_observations, 1), "minimum_observations must be at least 1")
        _need(_whole(self.minimum_benefits, 0), "minimum_benefits must not be negative")
        _need(math.isfinite(self.minimum_mean_gain), "minimum_mean_gain must be finite")
        _need(_unit(self.maximum_risk_upper_bound), "maximum_risk_upper_bound must be in [0, 1]")
        _need(_unit(self.minimum_applicability), "minimum_applicability must be in [0, 1]")


@dataclass(frozen=True)
class QueryBudget:
    max_retrieval_queries: int = 1
    max_top_k: int = 10
    max_context_tokens: int = 4096
    max_query_characters: int = 2048
    max_application_cost: float | None = None

    def __post_init__(self) -> None:
        for name in ("max_retrieval_queries", "max_top_k", "max_context_tokens", "max_query_characters"):
            _need(_whole(getattr(self, name), 1), f"{name} must be a positive integer")
        cost = self.max_application_cost
        _need(cost is None or (math.isfinite(cost) and cost >= 0), "max_application_cost must be finite and not negative")


@dataclass(frozen=True)
class EnvironmentPolicy:
    mode: str = "strict"
    minimum_score: float = 0.80
    soft_mismatch_penalty: float = 0.10

    def __post_init__(self) -> None:
        object.__setattr__(self, "mode", self.mode.strip().casefold())
        _need(self.mode in ("strict", "tiered"), "mode must be strict or tiered")
        _need(_unit(self.minimum_score), "minimum_score must be in [0, 1]")
        _need(_unit(self.soft_mismatch_penalty), "soft_mismatch_penalty must be in [0, 1]")


@dataclass(frozen=True)
class LifecyclePolicy:
    promotion_min_observations: int = 3
    promotion_min_direct_good_observations: int = 2
    promotion_min_benefits: int = 1
    promotion_min_mean_gain: float = 0.0
    promotion_max_wilson_breakage_upper_bound: float = 0.70
    quarantine_at_harm_count: int = 1

    def __post_init__(self) -> None:
        _need(_whole(self.promotion_min_observations, 1), "promotion_min_observations must be at least 1")
        _need(_whole(self.promotion_min_direct_good_observations, 1), "promotion_min_direct_good_observations must be at least 1")
        _need(_whole(self.promotion_min_benefits, 0), "promotion_min_benefits must not be negative")
        _need(self.promotion_min_benefits <= self.promotion_min_observations, "promotion_min_benefits cannot exceed promotion_min_observations")
        _need(math.isfinite(self.promotion_min_mean_gain), "promotion_min_mean_gain must be finite")
        _need(_unit(self.promotion_max_wilson_breakage_upper_bound), "promotion_max_wilson_breakage_upper_bound must be in [0, 1]")
        _need(_whole(self.quarantine_at_harm_count, 1), "quarantine_at_harm_count must be at least 1")


@dataclass(frozen=True)
class PortfolioPolicy:
    capacity: int
    half_life_steps: float
    minimum_priority: float = 0.0

    def __post_init__(self) -> None:
        _need(_whole(self.capacity, 1), "capacity must be a positive integer")
        _need(math.isfinite(self.half_life_steps) and self.half_life_steps > 0, "half_life_steps must be finite and positive")
        _need(_unit(self.minimum_priority), "minimum_priority must be in [0, 1]")


@dataclass(frozen=True)
class CardActivationPolicy:
    allowed_verification_tiers: tuple[str, ...] = ("gold", "human")
    min_independent_episodes: int = 2
    min_independent_documents: int = 2
    min_matched_trials: int = 2
    min_benefit_count: int = 2
    max_conditional_harm_rate: float = 0.1

    def __post_init__(self) -> None:
        tiers = self.allowed_verification_tiers
        _need(bool(tiers) and len(set(tiers)) == len(tiers) and set(tiers) <= set(TIERS), "allowed_verification_tiers must be unique, known and not empty")
        for name in ("min_independent_episodes", "min_independent_documents", "min_matched_trials", "min_benefit_count"):
            _need(_whole(getattr(self, name), 1), f"{name} must be at least 1")
        _need(self.min_independent_documents <= self.min_independent_episodes, "min_independent_documents cannot exceed min_independent_episodes")
        _need(_unit(self.max_conditional_harm_rate), "max_conditional_harm_rate must be in [0, 1]")


@dataclass(frozen=True)
class PlanApplication:
    """Who prepared the plans and what each may cost."""

    applier_id: str = "precomputed-plan"
    application_version: str = "v1"
    retrieval_query_count: int = 1
    requested_top_k: int = 5
    context_token_budget: int = 4096
    estimated_cost: float = 0.0
