"""The one-click pipeline and the smaller cleaning vocabulary."""

from __future__ import annotations

import atexit
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from millrace.errors import PlanError
from millrace.functions.text import title_case, ws_trim
from millrace.operators import duplicates, missing, outliers, profile, reshape, rows, structure, types
from millrace.plans.provider import Provider
from millrace.plans.repair import Result, State, repair, working_copy
from millrace.records import Action, Audit
from millrace.stable import delete

WIDE = ("WIDE_TABLE", "PIVOT_TABLE", "CROSSTAB")
#: Steps of reshape_stage() that only leave rows out.
SELECTIONS = {"remove_repeated_headers", "remove_metadata_rows"}


@dataclass
class Outcome:
    df: DataFrame
    audits: list[Audit]
    before: float
    after: float
    layout: str
    seconds: float
    summary: list[str] = field(default_factory=list)

    @property
    def improvement(self) -> float:
        return max(0.0, self.after - self.before)


def reshape_stage(df: DataFrame, layout: structure.Layout) -> tuple[DataFrame, list[str]]:
    """Stage 1: packed cells, headers and metadata rows inside of data, headers, wide layouts."""
    done = []
    packed = reshape.detect_packed(df)
    if packed and packed["confidence"] >= 0.85:
        df = reshape.explode_packed(df, packed["synchronized"], packed["delimiter"])
        done.append("explode_multi_value_cells")
    for name, f in (("remove_repeated_headers", rows.remove_repeated_headers), ("remove_metadata_rows", rows.remove_metadata_rows)):
        if df.limit(3).count() > 2:
            df = f(df)
            done.append(name)
    score = {e.layout: e.score for e in layout.rules}
    if score.get("MULTI_HEADER", 0) >= 0.5 and layout.layout == "MULTI_HEADER":
        df = reshape.flatten_headers(df)
        done.append("flatten_headers")
        if structure.detect(df).layout in WIDE:
            df = reshape.unpivot(df)
            done.append("unpivot")
    elif layout.layout in WIDE and layout.confidence >= 0.6:
        df = reshape.unpivot(df)
        done.append("unpivot")
    return df, done


def plan_stage(df: DataFrame, state: State | None = None, repeated: int | None = None) -> list[Action]:
    """Stage 2: the ordered actions that a table needs; capping outliers always comes last.

    state, repeated: rows and nulls, and how many rows repeat an earlier one, if they are counted already.
    """
    n, nulls = state or rows.null_counts(df)
    texts = [c for c in df.columns if missing.is_text(df, c)]
    plan = []
    if duplicates.duplicate_count(df) if repeated is None else repeated:
        plan.append(Action("remove_duplicate_rows"))
    if any(reshape.N.is_unnamed(c) or c.strip() != c for c in df.columns) or len(set(df.columns)) < len(df.columns):
        plan.append(Action("rename_columns"))
    if n:
        plan += [Action("drop_empty_rows"), Action("drop_empty_columns")]
    if n > 10 and any(0.8 <= nulls[c] / n < 1 for c in df.columns):
        plan.append(Action("drop_high_missing_columns"))
    if texts:
        plan += [Action("strip_whitespace"), Action("standardize_values"), Action("auto_dtypes")]
        kinds = types.infer_types(df, profile.mixed_type_columns(df))
        for c, kind in kinds.items():
            e = kind.evidence
            if e and e["number"] > 0.8 * e["n"]:
                plan.append(Action("convert_types", [c], {"to": "numeric"}))
            elif e and e["dates"] + e["ambiguous"] > 0.8 * e["n"]:
                plan.append(Action("convert_types", [c], {"to": "datetime"}))
    if any(nulls.values()):
        plan.append(Action("fill_missing"))
    return [*plan, Action("handle_outliers", params={"method": "iqr", "factor": 1.5})]


def gate(actions: list[Action], df: DataFrame) -> list[Action]:
    """Of proposed actions, those whose targets exist, that are sure, and that leave identifiers and unclear dates alone."""
    kinds = types.infer_types(df)
    good = []
    for a in actions:
        targets = [c for c in a.columns if c in df.columns]
        if a.operation in ("auto_dtypes", "convert_types", "standardize_values"):
            targets = [c for c in targets if c not in kinds or kinds[c].type != "identifier"]
        if a.operation in ("normalize_dates", "convert_types"):
            targets = [c for c in targets if not (c in kinds and kinds[c].evidence.get("ambiguous") is True)]
        if a.confidence >= 0.85 and (targets or not a.columns):
            good.append(Action(a.operation, targets, a.params, a.confidence, a.reason))
    return good


def run(df: DataFrame, provider: Provider | None = None) -> Outcome:
    """Inspect, reshape, plan, repair, inspect again. Actions that a provider proposes replace the plan if any pass the gate.

    The reshaped table is written once, for the plan's counts and the repair. If reshaping only selected rows and left
    all of them, it is the table that was inspected, and so are its repeated rows.
    """
    began = time.monotonic()
    seen = profile.inspect(df)
    before, layout = seen["score"], structure.detect(df, {c: n for c, n in seen["unique"].items() if profile.exact_texts(df, c)})
    shaped, done = reshape_stage(df, layout)
    proposed = gate(provider.propose(shaped), shaped) if provider and provider.configured else []
    copy, state, uri = working_copy(shaped)
    if uri:
        atexit.register(delete, df.sparkSession, uri)
    same = set(done) <= SELECTIONS and state[0] == seen["rows"]
    result: Result = repair(copy, proposed or plan_stage(shaped, state, seen["duplicates"] if same else None), state)
    if uri and result.df is not copy:
        delete(df.sparkSession, uri)
    after = profile.inspect(result.df)["score"]
    out = Outcome(result.df, result.audits, before, after, layout.layout, round(time.monotonic() - began, 2))
    out.summary = [f"Layout: {layout.layout}", *(f"Reshaped: {x}" for x in done), *(f"{a.operation}: {a.rows_before} -> {a.rows_after} rows" for a in result.audits if a.success), f"Quality {before:.2f} -> {after:.2f}"]
    return out


# -- cleaning --------------------------------------------------------------------------------------------------

METHODS = {"fill_missing_numeric": ("mean", "median", "zero"), "fill_missing_categorical": ("mode", "missing"), "cast_type": ("numeric", "datetime", "category"), "cap_outliers": ("iqr",)}
CLEANING = {
    "drop_duplicates": lambda df, c, m: df.dropDuplicates(),
    "fill_missing_numeric": lambda df, c, m: missing.cleaning_fill(df, c, m or "median"),
    "fill_missing_categorical": lambda df, c, m: missing.cleaning_fill(df, c, m or "mode"),
    "drop_missing_column": lambda df, c, m: rows.remove_columns(df, [c]),
    "drop_missing_rows": lambda df, c, m: rows.drop_rows_null_in(df, [c]),
    "drop_constant_column": lambda df, c, m: rows.remove_columns(df, [c]),
    "strip_whitespace": lambda df, c, m: df.withColumn(c, ws_trim(c)),
    "standardize_categories": lambda df, c, m: df.withColumn(c, title_case(c)),
    "cap_outliers": lambda df, c, m: outliers.cleaning_cap(df, c),
    "cast_type": lambda df, c, m: types.simple_cast(df, c, m or "numeric"),
}


def check_cleaning(df: DataFrame, steps: list[dict[str, Any]]) -> list[str]:
    """What is wrong with a cleaning plan."""
    wrong = []
    for s in steps:
        op, column, method = s.get("operation"), s.get("column"), s.get("method")
        if op not in CLEANING:
            wrong.append(f"no such operation: {op}")
        elif op != "drop_duplicates" and column not in df.columns:
            wrong.append(f"{op}: no such column: {column}")
        elif method and op in METHODS and method not in METHODS[op]:
            wrong.append(f"{op}: no such method: {method}")
    return wrong


def clean(df: DataFrame, steps: list[dict[str, Any]]) -> tuple[DataFrame, dict[str, Any]]:
    """Carry out a cleaning plan; wrong steps are logged and skipped."""
    out, log = df, []
    for s in steps:
        try:
            if wrong := check_cleaning(out, [s]):
                raise PlanError(wrong[0])
            out = CLEANING[s["operation"]](out, s.get("column"), s.get("method"))
            log.append({**s, "done": True})
        except Exception as e:
            log.append({**s, "done": False, "error": str(e)})
    (n0, null0), (n1, null1) = rows.null_counts(df), rows.null_counts(out)
    return out, {"log": log, "rows": (n0, n1), "columns": (len(df.columns), len(out.columns)), "missing": (sum(null0.values()), sum(null1.values()))}


def cleaning_plan(df: DataFrame) -> list[dict[str, Any]]:
    """The plan without a provider: duplicates, constants, mostly missing columns, then fills."""
    n, nulls = rows.null_counts(df)
    unique = profile.distinct_counts(df)
    steps: list[dict[str, Any]] = [{"operation": "drop_duplicates"}] if duplicates.duplicate_count(df) else []
    for c in df.columns:
        if unique[c] <= 1:
            steps.append({"operation": "drop_constant_column", "column": c})
        elif nulls[c] / max(n, 1) > 0.6:
            steps.append({"operation": "drop_missing_column", "column": c})
        elif nulls[c]:
            steps.append({"operation": "fill_missing_numeric", "column": c, "method": "median"} if missing.is_numeric(df, c) else {"operation": "fill_missing_categorical", "column": c, "method": "mode"})
    return steps
