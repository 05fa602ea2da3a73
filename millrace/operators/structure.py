"""Layout detection: fourteen rules over a schema, one aggregate and the first rows."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.dates import classify_date
from millrace.functions.text import text
from millrace.operators import embedded
from millrace.operators.missing import is_numeric, is_temporal, is_text
from millrace.operators.profile import frequencies
from millrace.operators.rows import SUBTOTALS, figures, head_rows
from millrace.records import Evidence
from millrace.stable import stable

THRESHOLD = 0.3


def name_similarity(names: list[str]) -> float:
    """How much columns look like categories: a shared first word, or names of nearly one length."""
    if len(names) < 3:
        return 0.0
    low = [n.lower().strip() for n in names]
    heads = Counter(p[0] for n in low if len(p := n.replace("-", "_").split("_")) > 1)
    most = max(heads.values(), default=0)
    if most >= 3 and most / len(names) > 0.4:
        return most / len(names)
    mean = sum(map(len, low)) / len(low)
    spread = sum((len(n) - mean) ** 2 for n in low) / len(low)
    return 0.3 if 0 < mean < 20 and spread < 4 else 0.0


def _number(v: object) -> bool:
    try:
        float(v)  # type: ignore[arg-type]
        return True
    except (TypeError, ValueError):
        return False


def header_likelihood(head: list[list]) -> float:
    """Whether the first row labels the second."""
    if len(head) < 2 or not head[0]:
        return 0.0
    score = 0.0
    for a, b in zip(head[0], head[1], strict=True):
        if isinstance(a, str):
            score += _number(b) + 0.3 * (len(a) < 30 and not _number(a))
    return min(1.0, score / len(head[0]))


@dataclass
class Facts:
    """What the rules look at, gathered in few aggregates."""

    df: DataFrame
    names: list[str] = field(default_factory=list)
    rows: int = 0
    head: list[list] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    temporal: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    row: dict = field(default_factory=dict)


def gather(df: DataFrame, unique: dict[str, int] | None = None) -> Facts:
    """unique: exact distinct counts of some columns, if they are known already."""
    unique = unique or {}
    f = Facts(df, df.columns, head=head_rows(df, 3), numeric=[c for c in df.columns if is_numeric(df, c)], temporal=[c for c in df.columns if is_temporal(df, c)], texts=[c for c in df.columns if is_text(df, c)])
    exprs = [F.count(F.lit(1)).alias("rows"), F.count(F.when(F.expr(" and ".join(f"`{c}` is null" for c in df.columns)), 1)).alias("empty_rows")]
    exprs += [F.count(F.col(f"`{c}`")).alias(f"n|{c}") for c in df.columns]
    for c in f.numeric[:20]:
        exprs += [F.min(c).cast("double").alias(f"lo|{c}"), F.max(c).cast("double").alias(f"hi|{c}"), F.approx_count_distinct(c).alias(f"d|{c}") if c != df.columns[0] else F.lit(0).alias(f"_|{c}")]
    subtotal = F.lit(False) if figures(df, 0) else F.lower(text(F.col(f"`{df.columns[0]}`"))).rlike("|".join(SUBTOTALS))
    exprs.append(F.count(F.when(subtotal, 1)).alias("subtotal_rows"))
    # Distinct values apart: beside other aggregates, each of them would carry the others' buffers (sketches too) through sorts.
    wanted = dict.fromkeys([df.columns[0], *f.temporal[:2], *f.texts[:1]])
    exact = [F.count_distinct(F.col(f"`{c}`")).alias(f"d|{c}") for c in wanted if c not in unique]
    f.row = df.agg(*exprs).first().asDict() | {f"d|{c}": unique[c] for c in wanted if c in unique}
    f.row |= df.agg(*exact).first().asDict() if exact else {}
    f.rows = f.row["rows"]
    return f


def _ratio(f: Facts, c: str) -> float:
    return f.row.get(f"d|{c}", 0) / max(f.row[f"n|{c}"], 1)


def numeric_share(df: DataFrame, column: str, n: int = 200) -> float:
    """Which share of a column's first n values reads as numbers."""
    head = df.filter(F.col(column).isNotNull()).select(text(column).try_cast("double").alias("x")).limit(n)
    return head.agg(F.coalesce(F.avg(F.col("x").isNotNull().cast("double")), F.lit(0.0))).first()[0]


def dominant_values(df: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """(column_name, share, dominant): the share of non-null values that the most frequent one has, and whether it is enough."""
    counted = frequencies(df, columns).groupBy("column").agg((F.max("n") / F.sum("n")).alias("share"))
    return counted.select(F.col("column").alias("column_name"), "share", (F.col("share") >= threshold).alias("dominant"))


def _kinds(f: Facts) -> int:
    booleans = [c for c, t in f.df.dtypes if t == "boolean"]
    return sum(bool(x) for x in (f.numeric, f.temporal, booleans, f.texts))


def _uniform(types: list[str]) -> float:
    return max(Counter(types).values(), default=0) / len(types) if types else 0.0


def _rule(name: str, layout: str, *parts: tuple[float, object, str]) -> Evidence:
    hit = [(w, text_) for w, test, text_ in parts if test]
    return Evidence(name, layout, max(0.0, min(1.0, round(sum(w for w, _ in hit), 4))), [t for _, t in hit])


# Fixed values in all rules below: weights, limits, words in names, and the layouts that the rules speak for.


def normal_table(f: Facts) -> Evidence:
    n = len(f.names)
    return _rule(
        "normal_table", "NORMAL_TABLE", (0.25, _kinds(f) >= 2, "several kinds of columns"), (0.2, 2 <= n <= 30, "a reasonable number of columns"), (0.2, name_similarity(f.names) < 0.2, "names are distinct"),
        (0.15, n and f.rows / n > 3, "many more rows than columns"), (0.1, header_likelihood(f.head) < 0.3, "no headers in rows"), (-0.15, len(f.temporal) == 1 and f.numeric and n <= 5, "may be a time series"),
    )


def wide_table(f: Facts) -> Evidence:
    n, types = len(f.names), [t for _, t in f.df.dtypes]
    spans = [(f.row[f"lo|{c}"], f.row[f"hi|{c}"]) for c in f.numeric[:20] if f.row.get(f"lo|{c}") is not None]
    many, alike = len(f.numeric) >= 5 and len(f.numeric) / n > 0.6, False
    if many and len(spans) >= 3:
        lows, highs = zip(*spans, strict=True)
        total = max(highs) - min(lows)
        alike = total > 0 and (max(lows) - min(lows) + max(highs) - min(highs)) / (2 * total) < 0.5
    return _rule(
        "wide_table", "WIDE_TABLE", (0.1, n >= 8, "many columns"), (0.1, n >= 20, "very many columns"), (0.25, name_similarity(f.names) > 0.3, "names follow a pattern"), (0.2, _uniform(types) > 0.7 and n >= 6, "columns of one type"),
        (0.15, alike, "similar ranges"), (0.1, many, "mostly numeric"), (0.15, n >= 5 and _ratio(f, f.names[0]) > 0.5 and len(set(types[1:])) == 1, "identifier, then values"),
    )


def long_table(f: Facts) -> Evidence:
    has = lambda words: any(w in c.lower() for c in f.names for w in words)
    return _rule(
        "long_table", "LONG_TABLE", (0.2, len(f.names) <= 5 and f.rows > 50, "narrow and long"), (0.25, has(["variable", "key", "metric", "measure", "attribute", "indicator"]), "a key column"),
        (0.2, has(["value", "amount", "count", "score", "result"]), "a value column"), (0.2, len(f.names) >= 2 and f.rows > 10 and _ratio(f, f.names[0]) < 0.3, "repeated identifiers"),
    )


def pivot_table(f: Facts) -> Evidence:
    n, first = len(f.names), f.names[0]
    if n < 3 or f.rows < 2:
        return Evidence("pivot_table", "PIVOT_TABLE", 0.0)
    rest, labelled = f.names[1:], first not in f.numeric
    mean = sum(map(len, rest)) / len(rest)
    return _rule(
        "pivot_table", "PIVOT_TABLE", (0.3, labelled and sum(c in f.numeric for c in rest) / len(rest) > 0.8, "labels, then numbers"), (0.15, labelled and _ratio(f, first) > 0.7, "row labels are unique"),
        (0.1, 1 < mean < 25, "label-like headers"), (0.1, f.rows < 100 and n > 3, "compact"), (0.1, _uniform([t for _, t in f.df.dtypes[1:]]) > 0.9, "values of one type"),
    )


def crosstab(f: Facts) -> Evidence:
    n, first = len(f.names), f.names[0]
    if n < 3 or f.rows < 2:
        return Evidence("crosstab", "CROSSTAB", 0.0)
    values = [c for c in f.numeric if c != first]
    whole = False
    if len(values) >= 2:
        row = f.df.select(*values).limit(50).agg(*[F.coalesce(F.bool_and(F.col(c) == F.floor(c)), F.lit(True)).alias(c) for c in values]).first()
        whole = all(row)
    return _rule("crosstab", "CROSSTAB", (0.3, whole, "whole counts"), (0.15, first not in f.numeric, "row labels"), (0.1, f.rows <= 50 and 3 <= n <= 30, "compact"), (0.15, name_similarity(f.names[1:]) > 0.2, "headers follow a pattern"))


def multi_header(f: Facts) -> Evidence:
    if f.rows < 3:
        return Evidence("multi_header", "MULTI_HEADER", 0.0)
    h, n = header_likelihood(f.head), len(f.names)
    short = sum(isinstance(v, str) and len(v) < 40 for v in f.head[0]) / n
    numbers = sum(v is not None and v == v and _number(v) for v in f.head[1]) / n
    return _rule(
        "multi_header", "MULTI_HEADER", (0.35, h > 0.5, "the first row is a header"), (0.15, 0.3 < h <= 0.5, "the first row may be a header"), (0.2, any(c.startswith("Unnamed:") or not c.strip() for c in f.names), "unnamed columns"),
        (0.2, short > 0.7, "short texts in the first row"), (0.15, numbers > 0.5 and short > 0.5, "types change after the first row"),
    )


def gap_kinds(df: DataFrame, column: str, approximate_order: bool = False) -> tuple[int, int, int]:
    """(gaps, positive gaps, distinct positive gaps) between neighbours in time.

    Neighbours come from windows over ranges of time; the few gaps across ranges are added from each range's ends.
    """
    ts = df.filter(F.col(column).isNotNull()).select(F.unix_micros(F.col(column).cast("timestamp")).alias("t"))
    dealt = stable(ts.repartitionByRange("t").withColumn("p", F.spark_partition_id()))  # all passes need the same ranges
    gaps = dealt.withColumn("g", F.col("t") - F.lag("t").over(Window.partitionBy("p").orderBy("t"))).filter("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    ends = sorted((r["lo"], r["hi"]) for r in dealt.groupBy("p").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect())  # one row for each range
    across = [b[0] - a[1] for a, b in zip(ends, ends[1:], strict=False)]
    row = gaps.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("g") > 0, F.col("n"))).alias("k"), F.count(F.when(F.col("g") > 0, 1)).alias("d")).first()
    new = {g for g in across if g > 0}
    extra = len(new) - (gaps.filter(F.col("g").isin(list(new))).count() if new else 0)
    return (row["n"] or 0) + len(across), (row["k"] or 0) + sum(g > 0 for g in across), (row["d"] or 0) + extra


def time_series(f: Facts) -> Evidence:
    parts: list[tuple[float, object, str]] = []
    if f.temporal:
        c = next((c for c in f.temporal[:2] if _ratio(f, c) > 0.6), None)
        if c:
            parts.append((0.3, True, f"{c} has distinct times"))
            n, positive, kinds = gap_kinds(f.df, c)
            if n >= 2 and positive >= 0.8 * n:
                parts += [(0.25, kinds <= 3, "regular intervals"), (0.15, 3 < kinds <= 10, "nearly regular intervals")]
        else:
            parts.append((0.05, True, "times repeat"))
    else:
        for c in f.texts:
            head = f.df.filter(F.col(c).isNotNull()).select(c).limit(100)
            row = head.agg(F.avg((classify_date(c)["status"] != "INVALID").cast("double")), F.try_divide(F.count_distinct(c).cast("double"), F.count(c))).first()
            if (row[0] or 0) > 0.8 and (row[1] or 0) > 0.6:
                parts.append((0.25, True, f"{c} reads as dates"))
                break
    so_far = sum(w for w, test, _ in parts if test)
    named = [c for c in f.names if any(k in c.lower() for k in ("date", "time", "timestamp", "year", "month", "day", "period"))]
    parts += [(0.2, so_far >= 0.3 and f.numeric, "metrics beside the time"), (0.15, so_far >= 0.3 and named, "names of time")]
    return _rule("time_series", "TIME_SERIES", *parts)


def survey(f: Facts) -> Evidence:
    n = len(f.names)
    likert = [c for c in f.numeric[:20] if f.row.get(f"lo|{c}") is not None and f.row.get(f"d|{c}", 99) <= 10 and f.row[f"lo|{c}"] >= 0 and f.row[f"hi|{c}"] <= 10]
    asked = [c for c in f.names if c.lower().startswith(("q", "question", "response", "answer", "rating", "satisfaction"))]
    return _rule("survey", "SURVEY", (0.1, n >= 10, "many columns"), (0.15, f.texts and len(f.texts) / n > 0.5, "mostly categories"), (0.25, len(likert) >= 3, "rating scales"), (0.2, len(asked) >= 3, "names of questions"))


def transactional(f: Facts) -> Evidence:
    has = lambda *words: any(w in c.lower() for c in f.names for w in words)
    return _rule(
        "transactional", "TRANSACTIONAL", (0.2, has("id", "transaction", "order", "invoice", "receipt"), "identifiers"), (0.2, has("amount", "total", "price", "cost", "revenue", "sales", "quantity"), "amounts"),
        (0.15, has("customer", "client", "user", "buyer", "seller", "vendor", "product"), "parties"), (0.15, f.temporal, "times"), (0.1, f.rows > 100, "many rows"), (0.1, _kinds(f) >= 3, "mixed types"),
    )


def repeated_blocks(f: Facts) -> Evidence:
    totals = [c for c in f.names if any(w in c.lower() for w in ("total", "subtotal", "sum", "grand total"))]
    unnamed = [c for c in f.names if c.startswith("Unnamed:") or not c.strip()]
    first = Counter(str(v).strip().lower() for v in (f.head[0] if f.head else []) if v is not None)
    return _rule(
        "repeated_blocks", "REPEATED_CATEGORY_BLOCKS", (0.35, len(totals) >= 2, "several total columns"), (0.25, len(unnamed) >= 2 and totals, "merged headers"), (0.3, any(k >= 2 for k in first.values()), "labels repeat in the first row")
    )


def spacers(f: Facts) -> Evidence:
    null = {c: 1 - f.row[f"n|{c}"] / max(f.rows, 1) for c in f.names}
    return _rule("spacers", "SPACER_ARTIFACTS", (0.4, any(v == 1 for v in null.values()), "empty columns"), (0.3, any(v > 0.9 and c.startswith("Unnamed:") for c, v in null.items()), "sparse unnamed columns"), (0.25, f.row["empty_rows"], "empty rows"))


def subtotals(f: Facts) -> Evidence:
    return _rule("subtotals", "SUBTOTAL_COLUMNS_ROWS", (0.4, any(w in c.lower() for c in f.names for w in SUBTOTALS), "total columns"), (0.4, f.row["subtotal_rows"], "total rows"))


def banners(f: Facts) -> Evidence:
    lone = [v[0] for row in f.head if len(v := [x for x in row if x is not None]) == 1 and isinstance(v[0], str)] if len(f.names) >= 2 and f.rows > 2 else []
    return _rule("banners", "METADATA_BANNERS", *[(0.35, len(t.strip()) > 5 and not t.strip().isdigit(), "a row of one text") for t in lone])


def embedded_records(f: Facts) -> Evidence:
    column = embedded.target_column(f.df)
    found = embedded.discover_labels(f.df, column) if column and column in f.texts else {"labels": [], "confidence": 0.0}
    sure = len(found["labels"]) >= 2 and found["confidence"] >= 0.5
    return Evidence("embedded_records", "EMBEDDED_STRUCTURED_RECORDS", found["confidence"] if sure else 0.0, found["labels"][:8] if sure else [])


RULES = [normal_table, wide_table, long_table, pivot_table, crosstab, multi_header, time_series, survey, transactional, repeated_blocks, spacers, subtotals, banners, embedded_records]


@dataclass
class Layout:
    layout: str
    confidence: float
    rules: list[Evidence]
    warnings: list[str] = field(default_factory=list)


def detect(df: DataFrame, unique: dict[str, int] | None = None) -> Layout:
    """The best rule's layout from 0.3 on, with a warning where the next one is close; the order of rules breaks ties.

    unique: as for gather().
    """
    if not df.columns or df.isEmpty():
        return Layout("UNKNOWN", 0.0, [])
    facts = gather(df, unique)
    found = sorted((rule(facts) for rule in RULES), key=lambda e: -e.score)
    if found[0].score < THRESHOLD:
        return Layout("UNKNOWN", 0.0, found)
    close = [e.layout for e in found[1:2] if found[0].score - e.score < 0.1 and e.score >= THRESHOLD]
    return Layout(found[0].layout, found[0].score, found, [f"close alternative: {x}" for x in close])


def plan(df: DataFrame) -> dict:
    """The first reshape that applies: records, blocks, headers, spacers, subtotals or none; with its cells."""
    f = gather(df)
    score = {e.rule: e for e in (rule(f) for rule in (embedded_records, repeated_blocks, multi_header, spacers, subtotals))}
    steps = [
        ("embedded_records", "reconstruct_embedded_records", 0.5), ("repeated_blocks", "unpivot_horizontal_category_blocks", 0.55), ("multi_header", "flatten_headers", 0.5),
        ("spacers", "remove_spacer_rows_cols", 0.25), ("subtotals", "remove_subtotal_elements", 0.4),
    ]
    for rule, operation, least in steps:
        if score[rule].score >= least:
            return {"issue": rule, "operation": operation, "confidence": score[rule].score, "evidence": score[rule].evidence, "requires_approval": rule == "subtotals" or score[rule].score < 0.85, "cells": f.rows * len(f.names)}
    return {"issue": "STANDARD_TABULAR", "operation": "none", "confidence": 1.0, "evidence": [], "requires_approval": False, "cells": f.rows * len(f.names)}
