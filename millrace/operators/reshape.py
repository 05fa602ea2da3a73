"""Reshaping: packed cells, headers in rows, unpivoting, horizontal blocks, column renames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import RepairError
from millrace.functions import names as N
from millrace.functions.dates import classify_date
from millrace.functions.text import text, ws_trim
from millrace.operators.missing import is_numeric, is_text
from millrace.operators.rows import ROW_ID, SUBTOTALS, with_row_id

# Delimiters of packed cells, in order of preference.
DELIMITERS = ["|", ";", "\n", "\r\n", " / ", "•", " ~ ", "~"]


def _items(c: Column, delimiter: str) -> Column:
    """How many filled items a cell holds; 1 without the delimiter."""
    parts = F.filter(F.split(c, re.escape(delimiter), -1), lambda t: ws_trim(t) != "")
    return F.when(F.contains(c, F.lit(delimiter)), F.size(parts)).otherwise(1)


def detect_packed(df: DataFrame) -> dict | None:
    """Columns that hold several values in a cell: delimiter, columns, those in step with the first, confidence."""
    columns = [c for c in df.columns if is_text(df, c)]
    if not columns or len(df.columns) < 2:
        return None
    exprs = []
    for i, d in enumerate(DELIMITERS):
        for j, c in enumerate(columns):
            exprs += [F.count(F.when(F.contains(F.col(c), F.lit(d)), 1)).alias(f"h{i}_{j}"), F.max(_items(F.col(c), d)).alias(f"m{i}_{j}")]
    row = df.agg(*exprs, *[F.count(c).alias(f"n{j}") for j, c in enumerate(columns)]).first()
    best = None
    for i, d in enumerate(DELIMITERS):
        packed = [c for j, c in enumerate(columns) if row[f"n{j}"] and row[f"h{i}_{j}"] / row[f"n{j}"] >= 0.25 and row[f"m{i}_{j}"] > 1]
        if not packed:
            continue
        synced = [packed[0]]
        if len(packed) > 1:
            first, both = _items(F.col(packed[0]), d), lambda c: F.col(packed[0]).isNotNull() & F.col(c).isNotNull()  # noqa: E731, B023
            same = df.agg(*[F.avg(F.when(both(c), (first == _items(F.col(c), d)).cast("double"))).alias(str(k)) for k, c in enumerate(packed[1:])]).first()
            synced += [c for k, c in enumerate(packed[1:]) if (same[str(k)] or 0) >= 0.75]
        is_synced = len(synced) > 1
        score = (0.95 if is_synced else 0.80) * len(packed) / len(columns)
        if best is None or score > best["score"]:
            best = {"delimiter": d, "columns": packed, "synchronized": synced if is_synced else packed, "id_columns": [c for c in df.columns if c not in packed], "is_synchronized": is_synced, "score": score, "confidence": min(0.98 if is_synced else 0.85, score + 0.5)}
    return best


def explode_packed(df: DataFrame, columns: list[str] | None = None, delimiter: str | None = None, retype: bool = True) -> DataFrame:
    """One row for each item; columns go in step, shorter ones padded with null; empty items are null."""
    if columns is None:
        found = detect_packed(df)
        if not found:
            return df
        columns, delimiter = found["synchronized"], delimiter or found["delimiter"]
    columns = [c for c in columns if c in df.columns]
    if not columns:
        raise RepairError("none of the columns exist")
    delimiter = delimiter or "|"
    split = {c: F.transform(F.split(F.coalesce(text(c), F.lit("")), re.escape(delimiter), -1), lambda t: F.nullif(ws_trim(t), F.lit(""))).alias(f"__{i}") for i, c in enumerate(columns)}
    work = df.select(*[F.col(c) for c in df.columns if c not in split], *split.values())
    work = work.withColumn("__row", F.explode(F.arrays_zip(*[F.col(f"__{i}") for i in range(len(columns))])))
    out = work.select(*[F.col(f"__row.__{columns.index(c)}").alias(c) if c in split else F.col(c) for c in df.columns])
    return retype_numeric(out, columns) if retype else out


def retype_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns to double where every value is a number once commas and dollars are gone."""
    number = {c: F.translate(ws_trim(c), ",$", "").try_cast("double") for c in columns}
    row = df.agg(*[e for c, x in number.items() for e in (F.count(c).alias(f"{c}|n"), F.count(x).alias(f"{c}|k"))]).first()
    good = {c: x for c, x in number.items() if row[f"{c}|n"] and row[f"{c}|n"] == row[f"{c}|k"]}
    return df.withColumns(good) if good else df


def _cell(v: object) -> str:
    return "" if v is None or str(v) == "nan" else str(v).strip()


def _filled_forward(names: list[str]) -> list[str]:
    out, last = [], names[0] if names else ""
    for n in names:
        last = last if n.startswith("Unnamed:") or n.strip() == "" else n
        out.append(last)
    return out


def flatten_headers(df: DataFrame, header_rows: int = 1, order_by: list[str] | None = None) -> DataFrame:
    """Merged headers carried on and combined with the first row's labels; those rows go. Two rows reach the driver."""
    placed = df if ROW_ID in df.columns else with_row_id(df, order_by)
    columns = [c for c in placed.columns if c != ROW_ID]
    head = [list(r) for r in placed.orderBy(ROW_ID).select(*[F.col(f"`{c}`") for c in columns]).limit(3).collect()]
    if header_rows < 1 or header_rows >= max(len(head), 1):
        raise RepairError("header_rows does not fit the table")
    top = _filled_forward(columns) if any(c.startswith("Unnamed:") for c in columns) else columns
    new = []
    for i, (t, v) in enumerate(zip((x.strip() for x in top), head[0], strict=True)):
        sub = _cell(v)
        if t.isdigit() or t.startswith("Unnamed:") or t == "":
            new.append(sub or f"col_{i}")
        else:
            new.append(f"{t} - {sub}" if sub and not sub.isdigit() and not sub.startswith("Unnamed:") and sub != t else t)
    skip = header_rows
    if len(head) > 2 and header_rows == 1 and [i for i, v in enumerate(head[1]) if _cell(v)] == [0]:
        label = _cell(head[1][0])
        if len(label) < 40 and not label.startswith("Unnamed"):
            new[0], skip = label, 2
    return placed.filter(F.col(ROW_ID) >= skip).drop(ROW_ID).toDF(*new)


def unpivot(df: DataFrame, ids: list[str] | None = None, values: list[str] | None = None, var_name: str = "variable", value_name: str = "value", drop_nulls: bool = True, split: str | None = " - ", split_names: tuple[str, str] = ("Category_1", "Category_2"), parse_ids: bool = True) -> DataFrame:
    """Wide to long. Values become numbers; ids become dates if all of them are; hierarchical names are split in two."""
    ids = [c for c in (ids if ids is not None else df.columns[:1]) if c in df.columns]
    values = values or [c for c in df.columns if c not in ids]
    numeric = all(is_numeric(df, c) for c in values)
    work = df.select(*ids, *[F.col(c).cast("double" if numeric else "string").alias(c) for c in values])
    out = work.unpivot([F.col(c) for c in ids], [F.col(c) for c in values], var_name, value_name)
    if drop_nulls:
        out = out.filter(F.col(value_name).isNotNull())
    if not numeric:
        out = out.withColumn(value_name, F.col(value_name).try_cast("double"))
    if split and values and len(parts := values[0].split(split)) == 2:
        pieces = F.split(var_name, re.escape(split))
        out = out.withColumns({split_names[0]: pieces[0], split_names[1]: F.try_element_at(pieces, F.lit(2))}).drop(var_name)
        out = out.select(*ids, *split_names[: len(parts)], value_name)
    texts = [c for c in ids if is_text(df, c)] if parse_ids else []
    if texts:
        read = {c: classify_date(c)["ts"] for c in texts}
        row = df.agg(*[e for c in texts for e in (F.count(c).alias(f"{c}|n"), F.count(read[c]).alias(f"{c}|k"))]).first()
        out = out.withColumns({c: read[c] for c in texts if row[f"{c}|n"] and row[f"{c}|n"] == row[f"{c}|k"]} or {ids[0]: F.col(ids[0])})
    return out


def flatten_blocks(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Horizontal blocks: names as Group__Metric from headers and the first row; subtotal columns and that row go."""
    placed = df if ROW_ID in df.columns else with_row_id(df, order_by)
    columns = [c for c in placed.columns if c != ROW_ID]
    if len(columns) < 2:
        return df
    head = [list(r) for r in placed.orderBy(ROW_ID).select(*[F.col(f"`{c}`") for c in columns]).limit(1).collect()]
    if not head:
        return df
    sub, words = [_cell(v) for v in head[0]], [w for w in SUBTOTALS if w != "average"]
    new = []
    for t, s in zip(_filled_forward(columns), sub, strict=True):
        plain = re.sub(r"[>:;]+", "", t).strip()
        new.append(f"{plain}__{s}" if s and s.lower() != plain.lower() and not s.startswith("Unnamed:") else plain)
    keep = [i for i, c in enumerate(columns) if not any(w in c.lower() or w in sub[i].lower() for w in words)]
    by_place = placed.toDF(*[f"c{i}" if c != ROW_ID else ROW_ID for i, c in enumerate(placed.columns)])
    if any(sub):
        by_place = by_place.filter(F.col(ROW_ID) >= 1)
    return by_place.select(*[F.col(f"c{i}") for i in keep]).toDF(*N.unique([new[i].strip() for i in keep]))


# -- names -----------------------------------------------------------------------------------------------------


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename the first column of that name."""
    if old not in df.columns or not new.strip() or (new != old and new in df.columns):
        raise RepairError(f"can't rename {old} to {new}")
    at = df.columns.index(old)
    return df.toDF(*[new.strip() if i == at else c for i, c in enumerate(df.columns)])


def standardize_names(df: DataFrame, strategies: tuple[str, ...] = ("snake_case",)) -> DataFrame:
    return df.toDF(*N.unique([N.standard_name(c, list(strategies)) for c in df.columns]))


def fix_names(df: DataFrame) -> DataFrame:
    return df.toDF(*N.fixed(df.columns))


def duplicate_names(df: DataFrame) -> dict[str, list[int]]:
    return {c: at for c in dict.fromkeys(df.columns) if len(at := [i for i, x in enumerate(df.columns) if x == c]) > 1}


def resolve_duplicate_names(df: DataFrame) -> DataFrame:
    return df.toDF(*N.unique(df.columns, first=2))


def unnamed_columns(df: DataFrame, order_by: list[str] | None = None) -> dict[str, str]:
    """Of unnamed columns: empty, index (0..n-1 or 1..n in order) or data."""
    columns = [c for c in df.columns if N.is_unnamed(c)]
    if not columns:
        return {}
    placed = with_row_id(df, order_by)
    exprs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        number = x.try_cast("double") if not isinstance(df.schema[c].dataType, T.BooleanType) else F.lit(None).cast("double")
        exprs += [F.count(x).alias(f"n{i}"), *[F.bool_and(F.coalesce(number == F.col(ROW_ID) + k, F.lit(False))).alias(f"i{i}_{k}") for k in (0, 1)]]
    row = placed.agg(*exprs).first()
    return {c: "empty" if not row[f"n{i}"] else "index" if row[f"i{i}_0"] or row[f"i{i}_1"] else "data" for i, c in enumerate(columns)}


def name_suggestions(df: DataFrame) -> dict[str, str]:
    return {c: s for c in df.columns if (s := N.suggested(c)) != c}
