"""Exploratory statistics: correlations, distributions, histograms, trends."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.missing import is_numeric, is_text
from millrace.operators.profile import frequencies, numeric_statistics, top_values
from millrace.operators.ranks import quantiles


def correlations(df: DataFrame, columns: list[str] | None = None, least_rows: int = 3) -> DataFrame:
    """(feature_a, feature_b, correlation) of all pairs of numeric columns, rows with any null left out, 3 places."""
    columns = columns or [c for c in df.columns if is_numeric(df, c)]
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, correlation double")
    whole = df.select(*columns).dropna()
    rows = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.when(F.count(F.lit(1)) >= least_rows, F.round(F.corr(a, b), 3) + 0.0).alias("correlation")) for a, b in pairs]
    return whole.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*").filter("correlation is not null")


def strong_pairs(pairs: DataFrame, least: float = 0.35) -> DataFrame:
    return pairs.filter(F.abs("correlation") >= least).withColumn("strength", F.when(F.abs("correlation") >= 0.7, "strong").otherwise("moderate"))


def top_k(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return top_values(frequencies(df, [column]), k).select("value", "n", "rank")


def distribution(df: DataFrame, column: str) -> dict:
    """Numbers: bounds, mean, median and the first 1000 values; else the 20 most frequent values."""
    if is_numeric(df, column):
        row = (*df.agg(F.min(column), F.max(column), F.avg(column)).first(), quantiles(df, {column: [0.5]})[column, 0.5])
        return dict(zip(("min", "max", "mean", "median"), row, strict=True)) | {"values": [r[0] for r in df.select(column).dropna().limit(1000).collect()]}
    return {"top": [(r["value"], r["n"]) for r in top_k(df, column).orderBy("rank").collect()]}


def histogram(df: DataFrame, column: str, bins: int = 20, bounds: tuple[float, float] | None = None) -> DataFrame:
    """(bin, low, high, n): equal widths between the bounds, the last one closed; one partial-combined shuffle."""
    low, high = bounds or df.agg(F.min(F.col(column).cast("double")), F.max(F.col(column).cast("double"))).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col(column).cast("double") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = df.filter(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"), (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"), "n")


def box(df: DataFrame, column: str) -> DataFrame:
    q = quantiles(df, {column: [0.25, 0.5, 0.75]})
    middle = [F.lit(q[column, p]).cast("double").alias(name) for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high")).select("low", *middle, "high")


def trend(df: DataFrame, x: str, y: str, least_rows: int = 5) -> DataFrame:
    """Slope and intercept of the least-squares line, from five rows on."""
    n: Column = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    slope, intercept = F.regr_slope(F.col(y), F.col(x)), F.regr_intercept(F.col(y), F.col(x))
    return df.agg(n.alias("n"), F.when(n >= least_rows, slope).alias("slope"), F.when(n >= least_rows, intercept).alias("intercept"))


def summary(df: DataFrame) -> dict:
    """Statistics of up to 15 numeric and the top three of up to 10 text columns, and strong correlations."""
    numeric = [c for c in df.columns if is_numeric(df, c)]
    texts = [c for c in df.columns if is_text(df, c)]
    top: dict[str, list] = {}
    for r in top_values(frequencies(df, texts[:10]), 3).orderBy("column", "rank").collect() if texts else []:
        top.setdefault(r["column"], []).append((r["value"], r["n"]))
    stats = [r.asDict() for r in numeric_statistics(df, numeric[:15]).collect()] if numeric else []
    return {"numeric": stats, "categorical": top, "n_numeric": len(numeric), "n_categorical": len(texts), "correlations": [r.asDict() for r in strong_pairs(correlations(df, numeric)).collect()]}


def dataset_context(df: DataFrame) -> dict:
    """Facts for a conversation about a table: columns, top values, three rows."""
    return {"columns": dict(df.dtypes), "summary": summary(df), "rows": [r.asDict() for r in df.limit(3).collect()]}
