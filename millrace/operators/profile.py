"""Column statistics, profiles and quality scores."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import text, value_class
from millrace.operators.duplicates import duplicate_count
from millrace.operators.missing import is_numeric, is_temporal, is_text
from millrace.operators.ranks import quantiles
from millrace.operators.rows import null_counts
from millrace.stable import spread

HIGH_CARDINALITY = 0.95


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def base_statistics(df: DataFrame) -> dict[str, dict[str, Any]]:
    """All columns' counts and, by kind, moments and quartiles or bounds: one aggregate, and one for quartiles."""
    quarters = quantiles(df, {c: [0.25, 0.5, 0.75] for c in df.columns if is_numeric(df, c)})
    exprs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        exprs.append(F.count(c).alias(f"{i}|count"))
        if is_numeric(df, c):
            x = _finite(c)
            exprs += [f.alias(f"{i}|{k}") for k, f in {
                "finite": F.count(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "std": F.stddev_samp(x), "skew": F.skewness(x),
                **{k: F.lit(quarters[c, p]).cast("double") for k, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}, "infinite": F.count(F.when(F.abs(F.col(c).cast("double")) == float("inf"), 1)),
            }.items()]
        elif is_temporal(df, c):
            exprs += [F.min(c).alias(f"{i}|min"), F.max(c).alias(f"{i}|max")]
        elif is_text(df, c):
            exprs.append(F.avg(F.length(c)).alias(f"{i}|length"))
    row = df.agg(*exprs).first().asDict()
    return {c: {"rows": row["rows"]} | {k.split("|")[1]: v for k, v in row.items() if k.startswith(f"{i}|")} for i, c in enumerate(df.columns)}


def frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n): one shuffle for all columns, combined before it."""
    columns = columns or df.columns
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns])).alias("x")
    return spread(df.select(*columns), len(columns)).select(pairs).select("x.*").filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(freq: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each column; ties by value."""
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def distinct_counts(df: DataFrame, approximate: bool = False) -> dict[str, int]:
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in df.columns]).first().asDict()
    found = {r["column"]: r["n"] for r in frequencies(df).groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(c, 0) for c in df.columns}


def adjusted_skewness(skew: float | None, n: int) -> float:
    """The sample-adjusted form of Spark's population skewness; 0 below three values."""
    return 0.0 if n < 3 or skew is None or math.isnan(skew) else skew * math.sqrt(n * (n - 1)) / (n - 2)


def numeric_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each numeric column: count, mean, median, std, min, max, skewness (adjusted)."""
    columns = columns or [c for c in df.columns if is_numeric(df, c)]
    x = {c: _finite(c) for c in columns}
    n = lambda c: F.count(x[c])
    middle = quantiles(df, {c: [0.5] for c in columns})
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), n(c).alias("n"), F.avg(x[c]).alias("mean"), F.lit(middle[c, 0.5]).cast("double").alias("median"), F.stddev_samp(x[c]).alias("std"), F.min(x[c]).alias("min"), F.max(x[c]).alias("max"),
            F.when(n(c) >= 3, F.skewness(x[c]) * F.sqrt(n(c) * (n(c) - 1)) / (n(c) - 2)).otherwise(0.0).alias("skewness"),
        )
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def categorical_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: count, distinct values, the most frequent one and its count."""
    freq = frequencies(df, columns)
    best = F.min(F.struct((-F.col("n")).alias("less"), "value"))
    return freq.groupBy("column").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_values"), best.alias("b")).select(F.col("column").alias("column_name"), "n", "distinct_values", F.col("b.value").alias("top"), (-F.col("b.less")).alias("top_count"))


def datetime_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.min(c).alias("first"), F.max(c).alias("last")) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


# -- profile ---------------------------------------------------------------------------------------------------


@dataclass
class ColumnProfile:
    name: str
    type: str
    count: int
    missing: int
    missing_pct: float
    unique: int
    unique_pct: float
    constant: bool
    possible_id: bool
    high_cardinality: bool
    statistics: dict[str, Any] = field(default_factory=dict)
    top: list[tuple[str, int]] = field(default_factory=list)


@dataclass
class Profile:
    rows: int
    columns: int
    duplicates: int
    duplicate_pct: float
    score: float
    status: str
    column_profiles: list[ColumnProfile]
    issues: list[dict]
    suspicious: list[str]


def friendly_type(df: DataFrame, c: str) -> str:
    kind = df.schema[c].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "Float"
    return "Boolean" if isinstance(kind, T.BooleanType) else "Datetime" if is_temporal(df, c) else "String/Text"


def possible_id(name: str, unique: int, rows: int, numeric: bool) -> bool:
    named = re.search(r"\bid\b|_id$|^id_|uuid|guid|index|code|number|no$", name.lower())
    return rows > 0 and bool((named and unique / rows >= 0.80) or (not numeric and unique / rows >= 0.98 and unique > 10))


def profile_table(df: DataFrame, top: int = 5) -> DataFrame:
    """One row for each column, as a table: counts, shares and finite numeric statistics, from three passes."""
    q = quantiles(df, {c: [0.25, 0.5, 0.75] for c in df.columns if is_numeric(df, c)})
    kinds = {c: "numeric" if is_numeric(df, c) else "datetime" if is_temporal(df, c) else "text" for c in df.columns}
    rows = []
    for c, kind in kinds.items():
        x = _finite(c) if kind == "numeric" else F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("row_count"), (F.count(F.lit(1)) - F.count(c)).alias("missing_count"),
                F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.round(F.avg(x), 4).alias("mean_value"), F.round(F.lit(q.get((c, 0.5))).cast("double"), 4).alias("median_value"),
                F.round(F.stddev_samp(x), 4).alias("std_value"), F.round(F.lit(q.get((c, 0.25))).cast("double"), 4).alias("q1"), F.round(F.lit(q.get((c, 0.75))).cast("double"), 4).alias("q3"),
            )
        )
    base = df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    distinct = frequencies(df).groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    return base.join(F.broadcast(distinct), F.col("column_name") == F.col("column"), "left").drop("column").withColumn("unique_count", F.coalesce("unique_count", F.lit(0).cast("long")))


def quality_issues(duplicates: int, duplicate_pct: float, columns: list[ColumnProfile]) -> list[dict]:
    issues = []
    if duplicates:
        issues.append({"issue": "duplicate_rows", "column": None, "severity": "critical" if duplicate_pct > 20 else "high" if duplicate_pct > 5 else "medium", "value": f"{duplicate_pct:.1f}%"})
    for c in columns:
        if c.missing:
            level = next(name for least, name in ((50, "critical"), (20, "high"), (5, "medium"), (-1, "low")) if c.missing_pct > least)
            issues.append({"issue": "missing_values", "column": c.name, "severity": level, "value": f"{c.missing_pct:.1f}%"})
        if c.constant:
            issues.append({"issue": "constant_column", "column": c.name, "severity": "high", "value": f"{c.unique} unique"})
        if c.high_cardinality:
            issues.append({"issue": "high_cardinality", "column": c.name, "severity": "medium", "value": f"{c.unique} unique"})
    return issues


def profile_score(rows: int, columns: int, missing: int, severe: int, duplicate_pct: float, constant: int, high_cardinality: int) -> tuple[float, str]:
    """0 to 100 with a band."""
    if not rows or not columns:
        return 0.0, "Critical"
    lost = min(35.0, min(30.0, 1.5 * 100 * missing / (rows * columns)) + min(15.0, 5.0 * severe))
    lost += min(25.0, 1.2 * duplicate_pct) + min(20.0, 5.0 * constant) + min(15.0, 3.0 * high_cardinality)
    score = round(max(0.0, 100.0 - lost), 1)
    return score, next(name for least, name in ((90, "Excellent"), (75, "Good"), (60, "Fair"), (40, "Poor"), (0, "Critical")) if score >= least)


def profile(df: DataFrame, approximate: bool = False) -> Profile:
    """The whole dataset profile."""
    if not df.columns or df.isEmpty():
        return Profile(0, len(df.columns), 0, 0.0, 0.0, "Critical", [], [{"issue": "empty_dataset", "column": None, "severity": "critical", "value": "0 rows"}], [])
    base, unique, duplicates = base_statistics(df), distinct_counts(df, approximate), duplicate_count(df)
    rows = base[df.columns[0]]["rows"]
    others = [c for c in df.columns if not is_numeric(df, c)]
    top: dict[str, list] = {c: [] for c in df.columns}
    for r in top_values(frequencies(df, others), 5).orderBy("column", "rank").collect() if others else []:  # five for each column
        top[r["column"]].append((r["value"], r["n"]))
    out = []
    for c in df.columns:
        b, u = base[c], unique[c]
        stats = {k: v if k in ("finite", "infinite") or not isinstance(v, float) else round(v, 4) for k, v in b.items() if k not in ("rows", "count", "skew", "length")}
        if stats.get("std") is None and b.get("finite") == 1:
            stats["std"] = 0.0
        missing = rows - b["count"]
        out.append(ColumnProfile(c, friendly_type(df, c), b["count"], missing, round(100 * missing / rows, 2), u, round(100 * u / rows, 2), u <= 1, possible_id(c, u, rows, is_numeric(df, c)), is_text(df, c) and u > 30 and u / rows >= 0.5, stats, top[c]))
    pct = round(100 * duplicates / rows, 2)
    score, status = profile_score(rows, len(out), sum(c.missing for c in out), sum(c.missing_pct > 50 for c in out), pct, sum(c.constant for c in out), sum(c.high_cardinality for c in out))
    suspicious = [c.name for c in out if c.missing == rows or c.statistics.get("infinite")]
    return Profile(rows, len(out), duplicates, pct, score, status, out, quality_issues(duplicates, pct, out), suspicious)


def validate_profile(p: Profile) -> list[str]:
    """What is out of range in a profile."""
    wrong = [f"{k} is negative" for k in ("rows", "columns", "duplicates") if getattr(p, k) < 0]
    wrong += [] if 0 <= p.score <= 100 else ["score is not within 0 and 100"]
    for c in p.column_profiles:
        wrong += [] if 0 <= c.missing_pct <= 100 and c.missing + c.count == p.rows else [f"{c.name}: missing counts do not add up"]
        wrong += [f"{c.name}: {k} is not finite" for k, v in c.statistics.items() if isinstance(v, float) and not math.isfinite(v)]
    return wrong


# -- inspection ------------------------------------------------------------------------------------------------


def sample_values(df: DataFrame, column: str, order_by: list[str], k: int = 5) -> list[Any]:
    """The first k distinct values in order."""
    seen = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order_by)).alias("first"))
    return [r[0] for r in seen.orderBy("first").limit(k).collect()]


def column_details(df: DataFrame, order_by: list[str] | None = None, samples: int = 5) -> DataFrame:
    """One row for each column: dtype, counts and shares of values, nulls and distinct values, flags, first distinct values.

    One scan: cells are counted by (column, value) with the first place of each value, combined before the shuffle; both
    summaries read that one exchange. Places are order_by, or numbers given in the same job, so they can't move. The
    first values of a column come from a ranking that every task cuts to `samples` before rows move.
    """
    place = F.struct(*order_by) if order_by else F.monotonically_increasing_id()
    cells = [F.struct(F.lit(i).alias("i"), text(F.col(f"`{c}`")).alias("value")) for i, c in enumerate(df.columns)]
    rows = F.struct(F.lit(-1).alias("i"), F.lit("").alias("value"))  # counts all rows
    counted = df.select(place.alias("place"), F.explode(F.array(rows, *cells)).alias("cell")).select("place", "cell.*").filter("value is not null")
    counted = counted.groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    sums = counted.groupBy("i").agg(F.sum("n").alias("non_null_count"), F.count(F.lit(1)).alias("unique_count"))
    first = Window.partitionBy("i").orderBy("first", "value")
    heads = counted.filter("i >= 0").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= samples)
    heads = heads.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("heads"))  # `samples` values
    kinds = [F.struct(F.lit(i).alias("i"), F.lit(c).alias("column_name"), F.lit(t).alias("dtype")) for i, (c, t) in enumerate(df.dtypes)]
    columns = df.sparkSession.range(1).select(F.explode(F.array(*kinds)).alias("c")).select("c.*")
    total = sums.filter("i = -1").select(F.col("non_null_count").alias("total"), F.lit(1).alias("one"))
    found = columns.join(sums, "i", "left").join(heads, "i", "left").withColumn("one", F.lit(1)).join(F.broadcast(total), "one", "left")  # one row of totals
    non_null, unique, n = F.coalesce("non_null_count", F.lit(0)), F.coalesce("unique_count", F.lit(0)), F.coalesce("total", F.lit(0))
    share = lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0))
    return found.select(
        "column_name", "dtype", non_null.alias("non_null_count"), (n - non_null).alias("null_count"), share(n - non_null).alias("null_share"), unique.alias("unique_count"), share(unique).alias("unique_share"),
        ((unique == n) & (n > 1)).alias("is_potential_id"), ((unique <= 1) & (non_null > 0)).alias("is_constant"),
        F.coalesce(F.transform("heads", lambda h: h["value"]), F.array().cast("array<string>")).alias("samples"),
    )


def mixed_type_columns(df: DataFrame, n: int = 100) -> list[str]:
    """Text columns whose first values look like several types."""
    return [c for c in df.columns if is_text(df, c) and df.filter(F.col(c).isNotNull()).limit(n).select(value_class(c).alias("k")).distinct().count() > 1]


def inspection_score(rows: int, missing_ratio: float, duplicates: int, empty_rows: int, empty_columns: int, constant: int, mixed: int, suspicious: int) -> tuple[float, list[str]]:
    """0 to 1 with notes."""
    parts = {
        "missing values": min(0.5 * missing_ratio, 0.3), "duplicate rows": min(0.3 * duplicates / max(rows, 1), 0.15), "empty rows": min(0.2 * empty_rows / max(rows, 1), 0.1),
        "empty columns": min(0.03 * empty_columns, 0.1), "constant columns": min(0.01 * constant, 0.05), "mixed types": min(0.03 * mixed, 0.1), "suspicious names": min(0.02 * suspicious, 0.1),
    }
    notes = [f"{k} (-{v:.2f})" for k, v in parts.items() if v > 0]
    return max(0.0, min(1.0, 1.0 - sum(parts.values()))), notes or ["No quality issues detected"]


def exact_texts(df: DataFrame, c: str) -> bool:
    """Whether different values of a column always have different texts, and equal ones the same: not so for -0.0."""
    kind = df.schema[c].dataType
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)) or kind == T.StringType()


def inspect(df: DataFrame) -> dict:
    """The second, independent report: missing, duplicates, empty, constant, mixed and suspicious columns, score.

    Where a column has as many distinct values as there are rows, no row can repeat; where one has no null, none is empty.
    """
    rows, nulls = null_counts(df)
    unique = distinct_counts(df)
    plain = len(set(df.columns)) == len(df.columns)
    keyed = plain and any(unique[c] == rows and exact_texts(df, c) for c in df.columns)
    duplicates = 0 if keyed else duplicate_count(df)
    some = df.columns and not (plain and any(nulls[c] == 0 for c in df.columns))
    empty = df.filter(F.expr(" and ".join(f"`{c}` is null" for c in df.columns))).count() if some else 0
    missing = sum(nulls.values()) / max(rows * len(df.columns), 1)
    lists = {
        "empty_columns": [c for c in df.columns if rows and nulls[c] == rows], "constant": [c for c in df.columns if unique[c] <= 1],
        "high_cardinality": [c for c in df.columns if is_text(df, c) and unique[c] > 10 and unique[c] / max(rows - nulls[c], 1) >= HIGH_CARDINALITY],
        "possible_ids": [c for c in df.columns if rows > 1 and unique[c] == rows and any(k in c.lower() for k in ("id", "key", "code", "uuid", "number"))],
        "mixed": mixed_type_columns(df), "suspicious_names": [c for c in df.columns if c.strip() != c or c == "" or c.startswith("Unnamed:") or df.columns.count(c) > 1],
    }
    score, notes = inspection_score(rows, missing, duplicates, empty, len(lists["empty_columns"]), len(lists["constant"]), len(lists["mixed"]), len(lists["suspicious_names"]))
    return {"rows": rows, "columns": len(df.columns), "missing_cells": sum(nulls.values()), "missing_ratio": missing, "duplicates": duplicates, "empty_rows": empty, "score": score, "notes": notes, "unique": unique} | lists


