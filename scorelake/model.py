"""Policies, contracts, values and errors."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import StrEnum
from typing import Any


class CaseFormatError(ValueError):
    """A case file that is not valid input."""


class MetricPluginError(ValueError):
    """A plugin metric that cannot be used."""


class UndefinedPolicy(StrEnum):
    """What an undefined score becomes."""

    ERROR = "error"
    SKIP = "skip"
    ZERO = "zero"
    ONE = "one"


class Severity(StrEnum):
    INFO = "info"
    WARNING = "warning"
    ERROR = "error"


def finite(value: Any, what: str) -> float:
    """``value`` as a float; booleans, other types and non-finite numbers are refused."""
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise TypeError(f"{what} must be a number")
    if not math.isfinite(value):
        raise ValueError(f"{what} must be finite")
    return float(value)


@dataclass(frozen=True)
class MetricValue:
    """A score, or the reason why there is none."""

    score: float | None
    reason: str | None = None
    details: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.score is None:
            if not self.reason:
                raise ValueError("an undefined value needs a reason")
        else:
            finite(self.score, "score")

    @property
    def defined(self) -> bool:
        return self.score is not None


@dataclass(frozen=True)
class Contract:
    """What an audit expects of a metric."""

    minimum: float = 0.0
    maximum: float = 1.0
    identity_score: float | None = 1.0
    symmetric: bool = False
    deterministic: bool = True
    tolerance: float = 1e-12

    def __post_init__(self) -> None:
        low, high, slack = (finite(getattr(self, k), k) for k in ("minimum", "maximum", "tolerance"))
        if low > high:
            raise ValueError("minimum must not exceed maximum")
        if slack < 0:
            raise ValueError("tolerance must not be negative")
        if self.identity_score is not None and not low <= finite(self.identity_score, "identity_score") <= high:
            raise ValueError("identity_score must lie within the bounds")
        for k in ("symmetric", "deterministic"):
            if not isinstance(getattr(self, k), bool):
                raise TypeError(f"{k} must be a boolean")


@dataclass(frozen=True)
class BootstrapConfig:
    """Replicates, confidence and seed; the domains keep the two random streams apart.

    A replicate's draws are SHA-256 digests of (domain, seed, replicate,
    position), so results of another implementation with the same scheme are
    matched bit for bit by passing its domains.
    """

    samples: int = 2000
    confidence: float = 0.95
    seed: int = 0
    bootstrap_domain: str = "scorelake-bootstrap-v1"
    sign_domain: str = "scorelake-sign-flip-v1"

    def __post_init__(self) -> None:
        for k in ("samples", "seed"):
            if isinstance(getattr(self, k), bool) or not isinstance(getattr(self, k), int):
                raise TypeError(f"{k} must be an integer")
        if self.samples < 1:
            raise ValueError("samples must be positive")
        if not 0 < finite(self.confidence, "confidence") < 1:
            raise ValueError("confidence must lie between 0 and 1")
