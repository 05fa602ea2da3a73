"""Row selection: predicates, positional removal, empty rows, headers and totals inside of data."""

from __future__ import annotations

import re
from functools import reduce
from operator import add, and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import RepairError
from millrace.functions.text import is_blank, text, ws_trim
from millrace.stable import scans_only, stable

ROW_ID = "_row_id"

# First-column beginnings of metadata rows; words of subtotals.
METADATA = ["total", "grand total", "subtotal", "summary", "total summary", "report generated", "page 1 of", "confidential", "source:", "source", "note:", "note", "notes:", "notes", "disclaimer"]
SUBTOTALS = ["total", "subtotal", "summary", "grand total", "average"]


def with_row_id(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Add the 0-based position of each row, without one task for all rows.

    Positions follow order_by if given, else the order of files by name and of rows inside of them, or of partitions
    where there are no files. A number of partition and row is written with each row, in the one job that decides where
    rows lie; files that are only filtered and projected lie the same in every job and need no writing. The sizes of
    pieces (parts of files, or partitions: one row each) then give each piece's offset, joined as a small table.
    Positions are dense and unique: a row whose piece has no offset is an error, never a null.
    """
    if order_by or not scans_only(df):
        return _placed(stable((df.orderBy(*order_by) if order_by else df).withColumn("__id", F.monotonically_increasing_id())), F.struct(F.shiftright("__id", 33)))
    numbered = df.withColumn("__id", F.monotonically_increasing_id())
    try:
        file = numbered.select("*", F.struct(F.length("_metadata.file_path"), "_metadata.file_path", "_metadata.file_block_start").alias("__file"))
    except AnalysisException:  # no files: ranges and literal rows
        return _placed(numbered, F.struct(F.shiftright("__id", 33)))
    return _placed(file, F.col("__file")).drop("__file")


def _placed(numbered: DataFrame, piece: Column) -> DataFrame:
    """Positions from pieces whose rows are consecutive numbers (__id), the pieces being in order of themselves."""
    cut = numbered.withColumn("__piece", piece)
    sizes = cut.groupBy("__piece").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each piece
    offsets = sizes.select(F.col("__piece").alias("__of"), (before - F.col("first")).alias("__shift"))
    joined = cut.join(offsets, F.col("__piece") == F.col("__of"), "left")
    known = F.coalesce("__shift", F.raise_error(F.lit("rows changed their partitions between two jobs")).cast("long"))
    return joined.withColumn(ROW_ID, known + F.col("__id")).drop("__id", "__piece", "__of", "__shift")


# -- predicates ------------------------------------------------------------------------------------------------


def predicate(column: str, op: str, value: str | None = None) -> Column:
    """null, not_null, equals, contains (a case-insensitive pattern), greater, less; never null itself."""
    c, plain = F.col(column), text(column)
    if op == "null":
        return is_blank(c)
    if op == "not_null":
        return ~is_blank(c)
    if op == "equals":
        found = ws_trim(c) == (value or "").strip()
    elif op == "contains":
        found = plain.rlike(f"(?i){value or ''}")
    elif op in ("greater", "less"):
        try:
            bound = float(value)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            return F.lit(False)
        number = c.try_cast("double")
        found = number > bound if op == "greater" else number < bound
    else:
        raise RepairError(f"no such predicate: {op}")
    return F.coalesce(found, F.lit(False))


def parse_ranges(spec: str, n_rows: int) -> list[tuple[int, int]]:
    """'0-5, 12, 20-25' as (first, last) ranges clipped to the table."""
    out = []
    for part in filter(None, (x.strip() for x in spec.split(","))):
        if not (m := re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)):
            raise RepairError(f"not a row range: {part}")
        first, last = int(m[1]), int(m[2] or m[1])
        if (last := min(last, n_rows - 1)) >= first:
            out.append((first, last))
    return out


def remove_rows(df: DataFrame, rows: list[int], order_by: list[str] | None = None, n_rows: int | None = None) -> DataFrame:
    """Drop rows by position; positions outside of the table are an error."""
    if not rows:
        raise RepairError("no rows are given")
    n = df.count() if n_rows is None else n_rows
    if bad := [r for r in rows if not 0 <= r < n]:
        raise RepairError(f"rows outside of the table: {bad[:5]}")
    placed = df if ROW_ID in df.columns else with_row_id(df, order_by)
    if len(rows) <= 1000:
        return placed.filter(~F.col(ROW_ID).isin(rows)).drop(ROW_ID)
    gone = df.sparkSession.createDataFrame([(r,) for r in sorted(set(rows))], f"{ROW_ID} long")
    return placed.join(gone, ROW_ID, "left_anti").drop(ROW_ID)


def remove_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if not columns:
        raise RepairError("no columns are given")
    if missing := [c for c in columns if c not in df.columns]:
        raise RepairError(f"no such columns: {missing}")
    return df.drop(*columns)


def remove_rows_and_columns(df: DataFrame, rows: list[int], columns: list[str], order_by: list[str] | None = None) -> DataFrame:
    """Both at once; nothing happens unless both are possible."""
    if not rows and not columns:
        raise RepairError("neither rows nor columns are given")
    if missing := [c for c in columns if c not in df.columns]:
        raise RepairError(f"no such columns: {missing}")
    out = remove_rows(df, rows, order_by) if rows else df
    return out.drop(*columns)


# -- nulls -----------------------------------------------------------------------------------------------------


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def drop_rows_null_in(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """(rows, nulls of each column) in one aggregate; columns are taken by position, so names may repeat."""
    names = [f"c{i}" for i in range(len(df.columns))]
    row = df.toDF(*names).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in names]).first()
    return row["n"], dict(zip(df.columns, (row[c] for c in names), strict=True))


def empty_columns(df: DataFrame) -> list[str]:
    n, nulls = null_counts(df)
    return [c for c in df.columns if n and nulls[c] == n]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))


def high_missing_columns(df: DataFrame, threshold: float = 0.8) -> list[str]:
    n, nulls = null_counts(df)
    return [c for c in df.columns if n and threshold <= nulls[c] / n < 1]


def drop_high_missing(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    return df.drop(*high_missing_columns(df, threshold))


def remove_spacers(df: DataFrame) -> DataFrame:
    """Rows that are empty over the original width, then columns that are empty."""
    return drop_empty_rows(df).drop(*empty_columns(df))


# -- headers and totals inside of data -------------------------------------------------------------------------


#: Types whose texts, numbers and times, hold a digit or are NaN or an infinity, without white space.
_FIGURES = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def figures(df: DataFrame, i: int) -> bool:
    """Whether a column, by its place, holds numbers or times, whose texts can't be words."""
    return isinstance(df.schema[i].dataType, _FIGURES)


def remove_repeated_headers(df: DataFrame) -> DataFrame:
    """Drop rows that repeat at least two column names, being 60% or more of their filled cells.

    Only cells that may be their column's name are trimmed, and filled cells are counted only in rows with two of them.
    """
    if not df.columns or df.limit(2).count() < 2:
        return df
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    cells = [F.col(f"`{c}`") for c in df.columns]
    filled = [~is_blank(x) & (text(x) != "nan") for x in cells]
    named = []
    for i, (c, x, f) in enumerate(zip(df.columns, cells, filled, strict=True)):
        name = c.strip().lower()
        word = not any(ch.isdigit() for ch in name) and name.lstrip("-") not in ("nan", "infinity")
        if name and not (word and figures(df, i)):
            named.append(F.contains(F.lower(text(x)), F.lit(name)) & (F.lower(ws_trim(x)) == name) & f)
    if len(named) < 2:
        return df
    n, same = reduce(add, map(flag, filled)), reduce(add, map(flag, named))
    return df.filter(~((same >= 2) & (10 * same >= 6 * n)))


def remove_metadata_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose first cell begins with a metadata word."""
    if not df.columns or figures(df, 0) or df.limit(2).count() < 2:
        return df
    first = F.lower(text(F.col(f"`{df.columns[0]}`")))
    return df.filter(~F.coalesce(first.rlike(r"(?U)^\s*(" + "|".join(map(re.escape, METADATA)) + ")"), F.lit(False)))


def subtotal_columns(names: list[str]) -> list[str]:
    return [c for c in names if any(w in c.lower() for w in SUBTOTALS)]


def remove_subtotals(df: DataFrame) -> DataFrame:
    """Drop columns whose name, and rows whose first cell, holds a word of totals; a null first cell stays."""
    if not df.columns:
        return df
    first = F.lower(text(F.col(f"`{df.columns[0]}`")))
    return df.filter(~F.coalesce(first.rlike("|".join(SUBTOTALS)), F.lit(False))).drop(*subtotal_columns(df.columns))


def head_rows(df: DataFrame, n: int) -> list[list]:
    """The first rows, as lists of values, for decisions on the driver."""
    return [list(r) for r in df.limit(n).collect()]


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)
