"""Duplicate rows: counting, removal, exact, near and identifier duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip_collapse
from millrace.operators.missing import is_text


def duplicate_count(df: DataFrame) -> int:
    """Rows that repeat an earlier one in all columns; nulls are equal. Partial counts are combined before the shuffle."""
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]


def remove_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str = "first", order_by: list[str] | None = None) -> DataFrame:
    """keep: first or last (by order_by) of each group, or none of a group of several."""
    if subset is None and keep in ("first", "last"):
        return df.dropDuplicates()
    keys = subset or df.columns
    # The best row of a key is an aggregate, combined before the shuffle, and no window over a hot key's rows.
    row = F.struct(*[F.col(c) for c in order_by or df.columns], *[F.col(c).alias(f"__v{i}") for i, c in enumerate(df.columns)])
    best = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg((F.max if keep == "last" else F.min)(row).alias("__r"), F.count(F.lit(1)).alias("__n"))
    best = best.filter("__n = 1") if keep == "none" else best
    return best.select(*[F.col(f"__r.__v{i}").alias(c) for i, c in enumerate(df.columns)])


def near_duplicate_count(df: DataFrame) -> int:
    """Like duplicate_count(), after texts are lower-cased, trimmed and collapsed; at any size."""
    return duplicate_count(df.select(*[F.lower(strip_collapse(c)).alias(c) if is_text(df, c) else F.col(c) for c in df.columns]))


def identifier_collisions(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Values of an identifier column that several rows have."""
    return {c: df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").count() for c in columns}


def detect_duplicates(df: DataFrame) -> dict:
    names = [c for c in df.columns if any(k in c.lower() for k in ("id", "code", "key", "number"))]
    exact, near = duplicate_count(df), near_duplicate_count(df)
    collisions = {c: n for c, n in identifier_collisions(df, names).items() if n}
    advice = "remove_duplicate_rows" if exact else "review" if near or collisions else "none"
    return {"exact": exact, "near": max(0, near - exact), "identifier_collisions": collisions, "recommendation": advice}
