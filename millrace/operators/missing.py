"""Filling missing values: statistics become literals, order-dependent fills carry values across partitions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import RepairError
from millrace.operators.ranks import modes, quantiles
from millrace.operators.rows import ROW_ID, null_counts, with_row_id
from millrace.stable import stable

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC)


def is_temporal(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, TEMPORAL)


def is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def fill_value(df: DataFrame, column: str, strategy: str, value: Any = None) -> Any:
    """The literal that fills a column: median, mean, mode (the smallest of ties) or constant."""
    if strategy == "constant":
        return value
    if strategy in ("median", "mean"):
        if not is_numeric(df, column):
            raise RepairError(f"{column} is not numeric")
        return quantiles(df, {column: [0.5]})[column, 0.5] if strategy == "median" else df.agg(F.avg(column)).first()[0]
    if strategy == "mode":
        return modes(df, [column])[column]
    raise RepairError(f"no such strategy: {strategy}")


def fill_with(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Replace nulls by literals; a fractional value widens an integer column."""
    exprs = {}
    for c, v in values.items():
        if v is not None:
            kind = df.schema[c].dataType
            whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and isinstance(v, float) and v != int(v)
            column = F.col(c).cast("double") if whole else F.col(c)
            exprs[c] = F.coalesce(column, F.lit(v).cast("double" if whole else kind))
    return df.withColumns(exprs) if exprs else df


def fill_directed(df: DataFrame, columns: list[str], order_by: list[str], backward: bool = False) -> DataFrame:
    """Fill from the nearest row before (or behind) that has a value; there is no task for all rows.

    Rows are dealt by ranges of the order and written with their range's number, so that both passes see the same
    ranges. Inside a range a window carries values on; what each range gets from those before it is worked out on a
    table of one row for each range.
    """
    order = [F.col(c).desc_nulls_last() if backward else F.col(c).asc_nulls_first() for c in order_by]
    dealt = stable(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(*order)
    nearest = F.min_by if backward else F.max_by
    at = F.struct(*[F.col(o) for o in order_by])
    ends = dealt.groupBy("__part").agg(*[nearest(c, F.when(F.col(c).isNotNull(), at)).alias(f"__{c}") for c in columns])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = ends.select("__part", *[F.last(f"__{c}", ignorenulls=True).over(before).alias(f"__{c}") for c in columns])
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"__{c}")) for c in columns}
    return dealt.join(carried, "__part", "left").withColumns(filled).select(*df.columns)


def auto_strategy(df: DataFrame, column: str, null_ratio: float, non_null: int, identifier: bool = False) -> str | None:
    if identifier or null_ratio >= 0.5 or non_null < 3:
        return None
    return "median" if is_numeric(df, column) else "ffill" if is_temporal(df, column) else "mode"


def fill_missing(df: DataFrame, columns: list[str] | None = None, strategy: str = "auto", value: Any = None, order_by: list[str] | None = None, identifiers: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """Fill nulls of the columns that have any (or of those given); also returns the strategy of each."""
    n, nulls = null_counts(df)
    chosen = {}
    for c in columns or [c for c in df.columns if nulls[c]]:
        s = auto_strategy(df, c, nulls[c] / max(n, 1), n - nulls[c], c in identifiers) if strategy == "auto" else strategy
        if s and not (s in ("median", "mean") and not is_numeric(df, c)):
            chosen[c] = s
    literal = {c: s for c, s in chosen.items() if s in ("median", "mean", "mode", "constant")}
    of = lambda kind: [c for c, s in literal.items() if s == kind]
    found = {c: x for (c, _), x in quantiles(df, {c: [0.5] for c in of("median")}).items()} | modes(df, of("mode"))
    found |= df.agg(*[F.avg(c).alias(c) for c in of("mean")]).first().asDict() if of("mean") else {}
    out = fill_with(df, {c: value if s == "constant" else found[c] for c, s in literal.items()})
    for direction in ("ffill", "bfill"):
        if some := [c for c, s in chosen.items() if s == direction]:
            # Without an order the rows' own counts: their positions.
            rows = out if order_by else with_row_id(out)
            out = fill_directed(rows, some, order_by or [ROW_ID], direction == "bfill").select(*out.columns)
    return out, chosen


def cleaning_fill(df: DataFrame, column: str, method: str) -> DataFrame:
    """The smaller vocabulary: mean, zero or median of numbers; mode ('Unknown' if none) or 'Missing' of text."""
    if is_numeric(df, column):
        return fill_with(df, {column: 0 if method == "zero" else fill_value(df, column, "mean" if method == "mean" else "median")})
    if method == "mode":
        return fill_with(df, {column: fill_value(df, column, "mode") or "Unknown"})
    return fill_with(df, {column: "Missing"})
