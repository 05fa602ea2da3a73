"""Typed results: audit records, actions, verdicts and reports."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

# Semantic types, issue labels, confidence bands.
SEMANTIC_TYPES = ["integer", "float", "decimal", "boolean", "datetime", "categorical", "string", "identifier", "percentage", "currency", "text"]
BANDS = [(0.95, "SAFE"), (0.85, "HIGH"), (0.70, "REVIEW"), (0.0, "LOW")]


def band(confidence: float) -> str:
    return next(name for least, name in BANDS if confidence >= least)


@dataclass
class Action:
    """One repair command: an operation of the closed list, its target columns and parameters."""

    operation: str
    columns: list[str] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)
    confidence: float = 1.0
    reason: str = ""


@dataclass
class Verdict:
    valid: bool
    confidence: float
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


@dataclass
class Audit:
    """What one action did."""

    operation: str
    rows_before: int
    rows_after: int
    columns_before: int
    columns_after: int
    success: bool = True
    warnings: list[str] = field(default_factory=list)
    details: dict[str, Any] = field(default_factory=dict)
    confidence: float = 1.0
    at: datetime = field(default_factory=lambda: datetime.now(UTC))


@dataclass
class Evidence:
    """A layout rule's score."""

    rule: str
    layout: str
    score: float
    evidence: list[str] = field(default_factory=list)


def as_dict(x: Any) -> dict:
    return asdict(x)
