"""Outlier bounds and capping; impossible values. All columns' statistics come from one aggregate each pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import RepairError
from millrace.operators.missing import is_numeric
from millrace.operators.ranks import quantiles


def bounds(df: DataFrame, columns: list[str], method: str = "iqr", factor: float = 1.5, least_rows: int = 10, approximate: bool = False) -> dict[str, tuple[float, float]]:
    """(low, high) of each column that has enough values and spread. approximate: percentile sketches for huge data."""
    tail = factor if method == "percentile" and factor < 0.5 else 0.01
    probs = {"iqr": [0.25, 0.75], "mad": [0.5], "percentile": [tail, 1 - tail], "zscore": []}.get(method)
    if probs is None:
        raise RepairError(f"no such method: {method}")

    def found(values: dict[str, Column]) -> dict[tuple[str, float], float | None]:
        if not approximate:
            return quantiles(df, {c: probs for c in values}, values)
        row = df.agg(*[F.percentile_approx(x, p, 10_000).alias(f"{c}|{p}") for c, x in values.items() for p in probs]).first().asDict()
        return {(c, p): row[f"{c}|{p}"] for c in values for p in probs}

    exprs = [e for c in columns for e in (F.avg(c).alias(f"{c}|a"), F.stddev_samp(c).alias(f"{c}|b"))] if method == "zscore" else []
    row = df.agg(*exprs, *[F.count(c).alias(f"{c}|n") for c in columns]).first().asDict() if columns else {}
    if probs and columns:
        for (c, p), x in found({c: F.col(c) for c in columns}).items():
            row[f"{c}|{'a' if p == probs[0] else 'b'}"] = x
    usable = [c for c in columns if row[f"{c}|n"] >= least_rows and row[f"{c}|a"] is not None]
    if method == "mad" and usable:
        spread = found({c: F.abs(F.col(c) - F.lit(row[f"{c}|a"])) for c in usable})
        row |= {f"{c}|b": spread[c, 0.5] * 1.4826 for c in usable}
    out = {}
    for c in usable:
        a, b = row[f"{c}|a"], row[f"{c}|b"]
        if b is None or (method in ("zscore", "mad") and b <= 0) or (method == "iqr" and least_rows and b - a <= 0):
            continue
        out[c] = (a - factor * (b - a), b + factor * (b - a)) if method == "iqr" else (a, b) if method == "percentile" else (a - factor * b, a + factor * b)
    return out


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null: least() and greatest() alone would put a bound in its place."""
    return F.when(c.isNotNull() & ~F.isnan(c.cast("double")), F.least(F.greatest(c.cast("double"), F.lit(float(low))), F.lit(float(high))))


def cap(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: clamp(F.col(c), *b) for c, b in limits.items()}) if limits else df


def outlier_counts(df: DataFrame, limits: dict[str, tuple[float, float]]) -> dict[str, int]:
    exprs = [F.count(F.when((F.col(c) < low) | (F.col(c) > high), 1)).alias(c) for c, (low, high) in limits.items()]
    return df.agg(*exprs).first().asDict() if exprs else {}


def handle_outliers(df: DataFrame, columns: list[str] | None = None, method: str = "iqr", action: str = "cap", factor: float = 1.5) -> tuple[DataFrame, dict]:
    """Cap or only report; returns the table and, by column, bounds (4 places) and how many values lie outside."""
    columns = [c for c in columns or df.columns if c in df.columns and is_numeric(df, c)]
    limits = bounds(df, columns, method, factor)
    counts = outlier_counts(df, limits)
    report = {c: {"low": round(b[0], 4), "high": round(b[1], 4), "outliers": counts[c]} for c, b in limits.items()}
    return (cap(df, {c: b for c, b in limits.items() if counts[c]}) if action == "cap" else df), report


def cleaning_cap(df: DataFrame, column: str) -> DataFrame:
    """IQR capping at 1.5 without minimum rows or spread."""
    return cap(df, bounds(df, [column], "iqr", 1.5, least_rows=0))


def impossible_values(df: DataFrame, columns: list[str] | None = None) -> list[dict]:
    """Infinities; negatives where 70% or more are not negative; over 100 where 70% or more are percentages."""
    columns = [c for c in columns or df.columns if is_numeric(df, c)]
    if not columns:
        return []
    inf = float("inf")
    exprs = []
    for c in columns:
        x = F.col(c).cast("double")
        known = x.isNotNull() & ~F.isnan(x)
        exprs += [F.count(F.when(k, 1)).alias(f"{c}|{n}") for n, k in (("n", known & (F.abs(x) != inf)), ("inf", F.abs(x) == inf), ("neg", known & (x < 0) & (x != -inf)), ("pct", known & (x <= 100) & (x != -inf)), ("over", known & (x > 100) & (x != inf)))]
    row, out = df.agg(*exprs).first().asDict(), []
    for c in columns:
        n, infinite, negative, percent, over = (row[f"{c}|{k}"] for k in ("n", "inf", "neg", "pct", "over"))
        if infinite:
            out.append({"column": c, "issue": "infinite", "count": infinite})
        if n and negative and (n - negative) / n >= 0.70:
            out.append({"column": c, "issue": "negative", "count": negative})
        if n and not negative and over and percent / n >= 0.70:
            out.append({"column": c, "issue": "over_100", "count": over})
    return out
