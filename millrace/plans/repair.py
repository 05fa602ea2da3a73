"""Repair orchestration: the closed list of operations, validation, audit, detection, history."""

from __future__ import annotations

import atexit
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.errors import RepairError
from millrace.functions.text import strip_collapse
from millrace.operators import duplicates, embedded, missing, outliers, reshape, rows, standardize, structure, types
from millrace.records import Action, Audit, Verdict
from millrace.stable import delete, write_table

STRUCTURAL = {
    "explode_multi_value_cells", "unpivot", "flatten_headers", "remove_repeated_headers", "remove_metadata_rows", "remove_spacer_rows_cols", "unpivot_horizontal_category_blocks",
    "remove_subtotal_elements", "auto_reconstruct_structure", "reconstruct_embedded_records",
}
#: Operations that only project: they cannot change the number of rows.
PROJECTIONS = {"rename_columns", "strip_whitespace", "standardize_values", "auto_dtypes", "normalize_dates", "convert_types", "handle_outliers", "drop_empty_columns", "drop_high_missing_columns", "remove_columns", "replace_values"}
LOSS, WARN, LEAK = 0.5, 0.2, 0.15


def strip_whitespace(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    texts = [c for c in columns or df.columns if missing.is_text(df, c)]
    return df.withColumns({c: strip_collapse(c) for c in texts}) if texts else df


def replace_values(df: DataFrame, columns: list[str], old: str, new: str) -> DataFrame:
    """Literal replacement; a column that was numeric stays so if no value is lost."""
    from millrace.functions.text import replace_literal

    out = df
    for c in columns:
        kind, new_text = df.schema[c].dataType, replace_literal(c, old, new)
        if missing.is_numeric(df, c) or missing.is_temporal(df, c):
            back = new_text.try_cast(kind)
            n, k = df.agg(F.count(c), F.count(back)).first()
            new_text = back if n == k else new_text
        out = out.withColumn(c, new_text)
    return out


def _convert(df: DataFrame, a: Action) -> DataFrame:
    to = a.params.get("to", "numeric")
    if to == "datetime":
        return types.normalize_dates(df, a.columns)[0]
    return types.to_numeric(df, a.columns)[0]


def _auto_reconstruct(df: DataFrame, a: Action) -> DataFrame:
    p = structure.plan(df)
    if p["operation"] == "none" or p["confidence"] < 0.85 or p["requires_approval"]:
        return df
    return OPERATIONS[p["operation"]](df, Action(p["operation"]))


def _dayfirst(a: Action) -> bool | None:
    named = {"DMY": True, "MDY": False}.get(a.params.get("convention", ""))
    return a.params.get("dayfirst", named)


OPERATIONS: dict[str, Callable[[DataFrame, Action], DataFrame]] = {
    "remove_duplicate_rows": lambda df, a: duplicates.remove_duplicates(df, a.params.get("subset"), a.params.get("keep", "first"), a.params.get("order_by")),
    "rename_columns": lambda df, a: reshape.fix_names(df),
    "drop_empty_rows": lambda df, a: rows.drop_empty_rows(df),
    "drop_empty_columns": lambda df, a: rows.drop_empty_columns(df),
    "convert_types": _convert,
    "fill_missing": lambda df, a: missing.fill_missing(df, a.columns or None, a.params.get("strategy", "auto"), a.params.get("value"), a.params.get("order_by"), tuple(a.params.get("identifiers", ())))[0],
    "drop_high_missing_columns": lambda df, a: rows.drop_high_missing(df, a.params.get("threshold", 0.8)),
    "handle_outliers": lambda df, a: outliers.handle_outliers(df, a.columns or None, a.params.get("method", "iqr"), a.params.get("action", "cap"), a.params.get("factor", 1.5))[0],
    "unpivot": lambda df, a: reshape.unpivot(df, **{k: v for k, v in a.params.items() if k in ("ids", "values", "var_name", "value_name", "drop_nulls", "split", "split_names")}),
    "flatten_headers": lambda df, a: reshape.flatten_headers(df, a.params.get("header_rows", 1), a.params.get("order_by")),
    "strip_whitespace": lambda df, a: strip_whitespace(df, a.columns or None),
    "standardize_values": lambda df, a: standardize.standardize(df, a.columns or None, a.params.get("min_confidence", 0.85), a.params.get("max_values", 150), a.params.get("mapping"))[0],
    "auto_dtypes": lambda df, a: types.auto_types(df, a.columns or None)[0],
    "normalize_dates": lambda df, a: types.normalize_dates(df, a.columns or None, _dayfirst(a))[0],
    "explode_multi_value_cells": lambda df, a: reshape.explode_packed(df, a.columns or None, a.params.get("delimiter")),
    "remove_repeated_headers": lambda df, a: rows.remove_repeated_headers(df),
    "remove_metadata_rows": lambda df, a: rows.remove_metadata_rows(df),
    "remove_spacer_rows_cols": lambda df, a: rows.remove_spacers(df),
    "unpivot_horizontal_category_blocks": lambda df, a: reshape.flatten_blocks(df, a.params.get("order_by")),
    "remove_subtotal_elements": lambda df, a: rows.remove_subtotals(df),
    "auto_reconstruct_structure": _auto_reconstruct,
    "reconstruct_embedded_records": lambda df, a: embedded.rebuild(df, *(a.columns[:1] or [None]), a.params.get("labels")),
    "remove_rows": lambda df, a: rows.remove_rows(df, a.params.get("rows", []), a.params.get("order_by")),
    "remove_columns": lambda df, a: rows.remove_columns(df, a.columns),
    "remove_rows_and_columns": lambda df, a: rows.remove_rows_and_columns(df, a.params.get("rows", []), a.columns, a.params.get("order_by")),
    "replace_values": lambda df, a: replace_values(df, a.columns, a.params["old"], a.params["new"]),
}
#: Declared, but without an implementation anywhere: asking for it is an error.
DECLARED = [*OPERATIONS, "remove_title_rows"]


def dispatch(df: DataFrame, action: Action) -> DataFrame:
    if action.operation not in OPERATIONS:
        raise RepairError(f"no such operation: {action.operation}")
    try:
        return OPERATIONS[action.operation](df, action)
    except RepairError:
        raise
    except Exception as e:
        raise RepairError(f"{action.operation} failed: {e}") from e


State = tuple[int, dict[str, int]]


def judge(before: State, columns: int, after: State, names: list[str], operation: str, asked: int | None = None) -> Verdict:
    """Accept or reject a result by losses of rows, columns and values. before, after: rows and nulls of each column.

    asked: how many rows the action was told to drop; any other loss is an error.
    """
    (n0, nulls0), (n1, nulls1) = before, after
    errors, warnings = [], []
    if n0 and not n1:
        errors.append("no rows are left")
    if not names:
        errors.append("no columns are left")
    if asked is not None and n0 - n1 != asked:
        errors.append(f"{n0 - n1} rows are lost instead of {asked}")
    if operation not in STRUCTURAL and n0:
        lost, gone = 1 - n1 / n0, 1 - len(nulls1) / max(columns, 1)
        if lost > LOSS:
            errors.append(f"{lost:.0%} of the rows are lost")
        elif lost > WARN:
            warnings.append(f"{lost:.0%} of the rows are lost")
        if gone > LOSS:
            errors.append(f"{gone:.0%} of the columns are lost")
    for c in nulls1.keys() & nulls0.keys():
        if n1 and nulls1[c] == n1 and nulls0[c] < n0:
            errors.append(f"{c} has no value left")
        elif operation in ("auto_dtypes", "normalize_dates") and n0 and (nulls1[c] - nulls0[c]) / n0 > LEAK:
            errors.append(f"{c} loses {(nulls1[c] - nulls0[c]) / n0:.0%} of its values")
    if len(set(names)) < len(names):
        warnings.append("names repeat")
    return Verdict(not errors, max(0.0, 1.0 - 0.05 * len(warnings) - 0.30 * len(errors)), errors, warnings)


def validate(before: State, after: DataFrame, operation: str) -> tuple[Verdict, State]:
    """judge() with one aggregate over the result."""
    state = rows.null_counts(after) if after.columns else (0, {})
    return judge(before, len(before[1]), state, after.columns, operation), state


@dataclass
class Result:
    df: DataFrame
    audits: list[Audit] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    state: State | None = None

    @property
    def success(self) -> bool:
        return any(a.success for a in self.audits) and not self.errors


#: Operations that look at one row at a time and need no job to be planned: they ride along with the write before them.
ROWWISE = {"strip_whitespace", "rename_columns", "remove_columns", "drop_empty_rows"}


def _observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The same table, which counts its rows and nulls while it is written."""
    seen, plain = Observation(), df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    counts = [F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in plain.columns]
    return plain.observe(seen, F.count(F.lit(1)).alias("n"), *counts).toDF(*df.columns), seen


def _state(names: list[str], seen: Observation) -> State:
    found = seen.get
    return found["n"], {c: found[f"c{i}"] for i, c in enumerate(names)}


@dataclass
class _Step:
    """An action that was planned: its result's names, and what its counts will be read from."""

    action: Action
    names: list[str]
    seen: Observation | None
    error: str = ""


def _asked(action: Action) -> int | None:
    return len(set(action.params.get("rows", []))) if action.operation in ("remove_rows", "remove_rows_and_columns") else None


def working_copy(df: DataFrame) -> tuple[DataFrame, State, str | None]:
    """A table as written in the shared folder, its rows and nulls, counted while it is written, and its folder."""
    if not df.columns:
        return df, (df.count(), {}), None
    observed, seen = _observed(df)
    table, uri = write_table(observed)
    return table, _state(df.columns, seen), uri


class _Work:
    """The newest committed table, as written, with its counts; older tables are deleted as they are replaced."""

    def __init__(self, df: DataFrame, state: State | None) -> None:
        self.df, self.state, self.uri = df, state, None
        if state is None:
            self.df, self.state, self.uri = working_copy(df)

    def attempt(self, actions: list[Action]) -> tuple[list[_Step], DataFrame, str | None]:
        """Plan some actions, one upon the other, and write what they come to in one job."""
        plan, steps = self.df, []
        for a in actions:
            try:
                candidate = dispatch(plan, a)
                if not candidate.columns:
                    steps.append(_Step(a, [], None))
                    break
                if candidate is plan:
                    steps.append(_Step(a, plan.columns, None))
                    continue
                plan, seen = _observed(candidate)
                steps.append(_Step(a, plan.columns, seen))
            except RepairError as e:
                steps.append(_Step(a, plan.columns, None, str(e)))
        if not any(s.seen for s in steps):
            return steps, self.df, None
        try:
            return steps, *write_table(plan)
        except Exception as e:  # a value that an expression can't take shows up only here
            if len(actions) > 1:
                raise _Retry from e
            return [_Step(actions[0], self.df.columns, None, f"{actions[0].operation} failed: {e}")], self.df, None

    def commit(self, df: DataFrame, uri: str | None, state: State) -> None:
        if self.uri and uri:
            delete(self.df.sparkSession, self.uri)
        self.df, self.uri, self.state = df, uri or self.uri, state


class _Retry(Exception):
    """Several actions were written at once and failed: they are tried one by one."""


def _record(out: Result, work: _Work, steps: list[_Step]) -> tuple[int, State]:
    """Audit steps in order up to the first that is rejected; returns how many were taken, and the counts after them."""
    state, names = work.state, work.df.columns
    for i, s in enumerate(steps):
        if s.error:
            out.errors.append(s.error)
            out.audits.append(Audit(s.action.operation, state[0], state[0], len(names), len(names), False, [s.error]))
            continue
        after = _state(s.names, s.seen) if s.seen else state if s.names else (0, {})
        verdict = judge(state, len(set(names)), after, s.names, s.action.operation, _asked(s.action))
        out.audits.append(Audit(s.action.operation, state[0], after[0], len(names), len(s.names), verdict.valid, verdict.warnings + verdict.errors, {"columns": s.action.columns, **s.action.params}, verdict.confidence))
        if not verdict.valid:
            out.errors += verdict.errors
            return i, state
        state, names = after, s.names
    return len(steps), state


def repair(df: DataFrame, actions: list[Action], state: State | None = None) -> Result:
    """Carry out actions in order: each result is validated, then committed or left; the others still run.

    df is read once, for a working copy in the shared folder that counts rows and nulls while it is written (give their
    counts as `state` for a table that is written already). Each action's result is written once too, and observed by
    the same job: its verdict needs no other pass. Actions that look at one row at a time are written together with the
    one before. A rejected result is deleted, and nothing after it has seen it.
    """
    out, work = Result(df), _Work(df, state)
    at, single = 0, False
    while at < len(actions):
        end = at + 1
        while not single and end < len(actions) and actions[end].operation in ROWWISE:
            end += 1
        try:
            steps, table, uri = work.attempt(actions[at:end])
        except _Retry:
            single = True
            continue
        audits, errors = len(out.audits), len(out.errors)
        taken, after = _record(out, work, steps)
        if taken == len(steps):
            work.commit(table, uri, after)
            at, single = at + taken, False
            continue
        if uri:
            delete(df.sparkSession, uri)
        if taken == 0:  # the table is still that of before
            at, single = at + 1, False
        else:  # the steps before the rejected one are written for themselves
            del out.audits[audits:], out.errors[errors:]
            single = True
    if not any(a.success for a in out.audits):
        if work.uri:
            delete(df.sparkSession, work.uri)
        return out
    out.df, out.state = work.df, work.state
    if work.uri:
        atexit.register(delete, df.sparkSession, work.uri)
    return out


def cell_evidence(df: DataFrame) -> dict[str, Any]:
    """What the row-local checks need, from one aggregate: rows, nulls and cells to strip by column, rows without a value."""
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    texts = [c for c in names if missing.is_text(plain, c)]
    none = reduce(and_, [F.col(c).isNull() for c in names], F.lit(True))
    exprs = [F.count(F.lit(1)).alias("rows"), F.count(F.when(none, 1)).alias("empty_rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null|{c}") for c in names]]
    exprs += [F.count(F.when(F.col(c) != strip_collapse(c), 1)).alias(f"strip|{c}") for c in texts]
    row = plain.agg(*exprs).first()
    by = lambda kind, some: {df.columns[int(c[1:])]: row[f"{kind}|{c}"] for c in some}
    return {"rows": row["rows"], "empty_rows": row["empty_rows"], "nulls": by("null", names), "strip": by("strip", texts)}


def detect_repairs(df: DataFrame) -> list[Action]:
    """Suggested actions, in the order in which they should run.

    All row-local checks share one aggregate; packed cells, repeated rows, spellings and types have evidence of their own.
    """
    seen = cell_evidence(df)
    n, nulls = seen["rows"], seen["nulls"]
    found: list[Action] = []
    if packed := reshape.detect_packed(df):
        found.append(Action("explode_multi_value_cells", packed["synchronized"], {"delimiter": packed["delimiter"]}, packed["confidence"]))
    if duplicates.duplicate_count(df):
        found.append(Action("remove_duplicate_rows", confidence=0.99))
    if any(reshape.N.is_unnamed(c) or c != c.strip() for c in df.columns) or len(set(df.columns)) < len(df.columns):
        found.append(Action("rename_columns", confidence=0.95))
    if seen["empty_rows"]:
        found.append(Action("drop_empty_rows", confidence=0.99))
    if any(nulls[c] == n for c in df.columns):
        found.append(Action("drop_empty_columns", confidence=0.99))
    if any(0.8 <= nulls[c] / max(n, 1) < 1 for c in df.columns):
        found.append(Action("drop_high_missing_columns", confidence=0.90))
    if any(seen["strip"].values()):
        found.append(Action("strip_whitespace", list(seen["strip"]), confidence=0.98))
    if odd := standardize.inconsistent_columns(df):
        found.append(Action("standardize_values", odd, confidence=0.88))
    if wrong := types.mistyped(df):
        found.append(Action("auto_dtypes", list(wrong), confidence=0.90))
    if some := [c for c in df.columns if 0 < nulls[c] < n]:
        found.append(Action("fill_missing", some, confidence=0.85))
    return found


def preview_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> dict[str, Any]:
    """Changed types, new nulls and changed cells of the columns that both have, joined by keys."""
    shared = [c for c in before.columns if c in after.columns and c not in keys]
    a, b = before.select(*keys, *[F.col(c).alias(f"a|{c}") for c in shared]), after.select(*keys, *[F.col(c).alias(f"b|{c}") for c in shared])
    both = a.join(b, keys)
    changed = [F.count(F.when(~F.col(f"a|{c}").cast("string").eqNullSafe(F.col(f"b|{c}").cast("string")), 1)).alias(f"c|{c}") for c in shared]
    lost = [F.count(F.when(F.col(f"a|{c}").isNotNull() & F.col(f"b|{c}").isNull(), 1)).alias(f"n|{c}") for c in shared]
    row = both.agg(*changed, *lost).first().asDict() if shared else {}
    types_of = lambda d: dict(d.dtypes)
    return {
        "type_changes": {c: (types_of(before)[c], types_of(after)[c]) for c in shared if types_of(before)[c] != types_of(after)[c]},
        "changed_cells": {c: row[f"c|{c}"] for c in shared}, "new_nulls": {c: row[f"n|{c}"] for c in shared},
        "columns_added": [c for c in after.columns if c not in before.columns], "columns_removed": [c for c in before.columns if c not in after.columns],
    }


class History:
    """An ordered log of audits, as a table too."""

    def __init__(self) -> None:
        self.audits: list[Audit] = []

    def add(self, result: Result) -> None:
        self.audits += result.audits

    def summary(self) -> dict[str, int]:
        return {"total": len(self.audits), "applied": sum(a.success for a in self.audits), "rejected": sum(not a.success for a in self.audits)}

    def table(self, df: DataFrame) -> DataFrame:
        schema = "step int, operation string, rows_before long, rows_after long, columns_before int, columns_after int, success boolean, confidence double, warnings string"
        return df.sparkSession.createDataFrame([(i, a.operation, a.rows_before, a.rows_after, a.columns_before, a.columns_after, a.success, a.confidence, "; ".join(a.warnings)) for i, a in enumerate(self.audits)], schema)


class Session:
    """A working table beside its original, with undo; a new table forgets everything that was derived."""

    def __init__(self, df: DataFrame) -> None:
        self.load(df)

    def load(self, df: DataFrame) -> None:
        self.original = self.current = df
        self.history, self.derived, self._undo, self._state = History(), {}, [], None

    def apply(self, actions: list[Action]) -> Result:
        """Repair the newest table; what a repair has written and counted is not copied again."""
        result = repair(self.current, actions, self._state)
        self.history.add(result)
        if result.success:
            self._undo.append((self.current, self._state))
            self.current, self._state, self.derived = result.df, result.state, {}
        return result

    def undo(self) -> DataFrame:
        if self._undo:
            (self.current, self._state), self.derived = self._undo.pop(), {}
        return self.current

    def reset(self) -> DataFrame:
        self.current, self.derived, self._undo, self._state = self.original, {}, [], None
        return self.current
