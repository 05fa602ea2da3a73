"""Language-model advice: a protocol, retries, tolerant parsing and checks. None is configured by default."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame

from millrace.errors import PlanError, ProviderError
from millrace.plans.repair import OPERATIONS
from millrace.records import Action

#: Attempts at the first model, at the second, and the pause between.
FIRST, SECOND, PAUSE = 2, 1, 1.0
#: Errors that no further attempt can mend.
PERMANENT = {400, 401, 403, 404}


class Provider(Protocol):
    configured: bool

    def complete(self, prompt: str, model: str | None = None) -> str: ...

    def propose(self, df: DataFrame) -> list[Action]: ...


@dataclass
class NotConfigured:
    """The default: every consumer falls back on its deterministic form."""

    configured: bool = False

    def complete(self, prompt: str, model: str | None = None) -> str:
        raise ProviderError("no provider is configured")

    def propose(self, df: DataFrame) -> list[Action]:
        return []


def with_retries(call: Callable[[str | None], str], first: str | None = None, second: str | None = None, sleep: Callable[[float], None] = time.sleep) -> str:
    """Try the first model twice, the second once; permanent errors end a model's turn."""
    last: Exception | None = None
    for model, times in ((first, FIRST), (second, SECOND if second else 0)):
        for k in range(times):
            try:
                return call(model)
            except Exception as e:
                last = e
                if getattr(e, "status", None) in PERMANENT:
                    break
                if k + 1 < times:
                    sleep(PAUSE)
    raise ProviderError(f"all attempts failed: {last}")


def without_thoughts(answer: str) -> str:
    return re.sub(r"<think>.*?(</think>|$)", "", answer, flags=re.S).strip()


def parse_json(answer: str) -> Any:
    """JSON as it is, in a fence, or from the first brace to the last."""
    answer = without_thoughts(answer)
    tries = [answer, *re.findall(r"```(?:json)?\s*(.*?)```", answer, re.S)]
    if "{" in answer and "}" in answer:
        tries.append(answer[answer.index("{") : answer.rindex("}") + 1])
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            continue
    raise PlanError("the answer holds no JSON")


def checked_actions(proposed: list[dict], df: DataFrame) -> tuple[list[Action], list[str]]:
    """Known operations on known columns, with confidences between 0 and 1; and what was left out."""
    good, warnings = [], []
    for p in proposed:
        if p.get("operation") not in OPERATIONS:
            warnings.append(f"unknown operation: {p.get('operation')}")
            continue
        columns = [c for c in p.get("columns", []) if c in df.columns]
        warnings += [f"unknown column: {c}" for c in p.get("columns", []) if c not in df.columns]
        if columns or not p.get("columns"):
            good.append(Action(p["operation"], columns, p.get("params", {}), min(1.0, max(0.0, float(p.get("confidence", 0.5)))), p.get("reason", "")))
    return good, warnings


#: Values of a column that a provider gets to see, and their longest length.
SHOWN, SHOWN_CHARS = 3, 80


def compact_profile(df: DataFrame) -> dict:
    """What a provider gets to see: schema, nulls, duplicates, three rows, and a profile of each column.

    The columns' profiles come from one scan; their semantic types from the evidence that type repair uses.
    """
    from millrace.operators.duplicates import duplicate_count
    from millrace.operators.profile import column_details
    from millrace.operators.types import infer_types

    if not df.columns:
        return {"rows": df.count(), "schema": {}, "nulls": {}, "duplicates": 0, "sample": [], "column_profiles": []}
    details = {r["column_name"]: r for r in column_details(df, samples=SHOWN).collect()}  # a row for each column
    kinds = infer_types(df)
    columns = [
        {
            "column": c, "dtype": d["dtype"], "semantic_type": kinds[c].type if c in kinds else d["dtype"], "type_confidence": kinds[c].confidence if c in kinds else 1.0, "null_count": d["null_count"],
            "null_percentage": round(100 * d["null_share"], 2), "unique_count": d["unique_count"], "sample_values": [v[:SHOWN_CHARS] for v in d["samples"]], "possible_id": d["is_potential_id"], "constant": d["is_constant"],
        }
        for c, d in details.items()
    ]
    n = next(iter(details.values()))
    return {
        "rows": n["non_null_count"] + n["null_count"], "schema": dict(df.dtypes), "nulls": {c: d["null_count"] for c, d in details.items()}, "duplicates": duplicate_count(df),
        "sample": [r.asDict() for r in df.limit(3).collect()], "column_profiles": columns,
    }
