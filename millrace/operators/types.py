"""Semantic type inference and safe conversion. All evidence of all columns comes from few aggregates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dates import classify_date, display_date
from millrace.functions.numbers import CURRENCY, FALSE_TOKENS, TRUE_TOKENS, explicit_number, parse_number, to_boolean
from millrace.functions.text import text, ws_trim
from millrace.operators.missing import is_text
from millrace.stable import stable

PARSE_THRESHOLD = 0.85


@dataclass
class Inferred:
    column: str
    type: str
    confidence: float
    evidence: dict = field(default_factory=dict)


def looks_like_identifier(head: list[str], unique_ratio: float) -> bool:
    """Codes and keys, by the first 100 values and the share of distinct values over all rows."""
    if not head or any(re.match(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}", v) for v in head[:10]):
        return False
    if any(len(v) > 1 and v[0] == "0" and v.isdigit() for v in head[:100]):
        return True
    if any(re.match(r"[A-Za-z0-9]+[-_][A-Za-z0-9-_]+$", v) and any(c.isalpha() for c in v) for v in head[:50]):
        return True
    first = head[:20]
    if unique_ratio < 0.85 or sum(v.count(" ") for v in first) / len(first) >= 2:
        return False
    return not any(mark in v.lower() for v in first for mark in CURRENCY) and any(c.isalpha() for v in first for c in v)


def text_evidence(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Counts by column: each value is parsed once for each distinct value, weighted by how often it occurs."""
    if not columns:
        return {}
    freq = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), ws_trim(c).alias("value")) for c in columns])).alias("x")).select("x.*")
    freq = freq.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    date, number = classify_date("value"), parse_number("value")
    read = freq.select("column", "value", "n", date.alias("date"), number.alias("number"))
    low, count = F.lower("value"), lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    known = F.col("value").isNotNull()
    currency = F.lit(False)
    for mark in CURRENCY:
        currency = currency | F.contains(low, F.lit(mark))
    status, convention = F.col("date.status"), F.col("date.convention")
    rows = read.groupBy("column").agg(
        F.sum("n").alias("rows"), count(known).alias("n"), F.count(F.when(known, 1)).alias("distinct"), count(known & low.isin(TRUE_TOKENS + FALSE_TOKENS)).alias("boolean"),
        count(known & F.col("number").isNotNull()).alias("number"), count(known & F.col("number").isNotNull() & (F.col("number") % 1 == 0)).alias("whole"), count(known & currency).alias("currency"),
        count(known & F.endswith("value", F.lit("%"))).alias("percent"), count(status == "UNAMBIGUOUS").alias("dates"), count(status == "AMBIGUOUS").alias("ambiguous"), count((status == "INVALID")).alias("invalid"),
        *[count((status == "UNAMBIGUOUS") & (convention == k)).alias(k.lower()) for k in ("DMY", "MDY", "ISO", "TEXT_MONTH")], count(F.col("date.has_time")).alias("has_time"), count(F.col("date.has_zone")).alias("has_zone"),
        (F.sum(F.when(known, F.length("value") * F.col("n"))) / F.greatest(count(known), F.lit(1))).alias("length"),
        (F.sum(F.when(known, F.size(F.split("value", r"\s+")) * F.col("n"))) / F.greatest(count(known), F.lit(1))).alias("words"),
    ).collect()  # fmt: skip  # one row for each column
    return {r["column"]: r.asDict() for r in rows}


def date_convention(column: str, e: dict) -> dict:
    """The convention of a date column from its evidence: name, dayfirst, ambiguity, confidence, parse ratio."""
    n, low = max(e["n"], 1), column.lower()
    hint_dmy, hint_mdy = any(h in low for h in ("dmy", "ddmmyy", "dd_mm", "dayfirst")), any(h in low for h in ("mdy", "mmddyy", "mm_dd", "monthfirst"))
    if not e["n"]:
        return {"convention": "EMPTY", "dayfirst": False, "ambiguous": False, "confidence": 0.0, "parse_ratio": 0.0}
    if e["dmy"] and e["mdy"]:
        out = ("MIXED", False, True, 0.65)
    elif e["dmy"] or e["mdy"]:
        out = ("DMY", True, False, 0.98) if e["dmy"] else ("MDY", False, False, 0.98)
    elif 2 * e["iso"] >= n:
        out = ("ISO", False, False, 0.99)
    elif 2 * e["text_month"] >= n:
        out = ("TEXT_MONTH", False, False, 0.98)
    elif hint_dmy != hint_mdy:
        out = ("DMY", True, False, 0.90) if hint_dmy else ("MDY", False, False, 0.90)
    elif e["ambiguous"] and not e["dates"]:
        out = ("AMBIGUOUS", False, True, 0.70)
    else:
        out = ("ISO" if e["iso"] else "MDY", False, e["ambiguous"] > 0, 0.80)
    parsed = e["dates"] + (0 if out[2] else e["ambiguous"])
    return dict(zip(("convention", "dayfirst", "ambiguous", "confidence"), out, strict=True)) | {"parse_ratio": round(parsed / n, 3)}


#: Distinct texts of a column, and their characters in all, up to which their readings are broadcast.
BROADCAST_TEXTS, BROADCAST_CHARS = 250_000, 8_000_000


def read_dates(df: DataFrame, column: str, name: str, dayfirst: bool = False) -> DataFrame:
    """Add classify_date() of a text column, each distinct text being read once.

    The readings are written, counted, and broadcast if they are few, else joined by a shuffle.
    """
    plain = text(column)
    seen = df.select(plain.alias("__text")).filter("__text is not null").distinct()
    table = stable(seen.withColumn(name, classify_date("__text", dayfirst)))
    n, chars = table.agg(F.count(F.lit(1)), F.sum(F.length("__text"))).first()
    small = F.broadcast(table) if n <= BROADCAST_TEXTS and (chars or 0) <= BROADCAST_CHARS else table
    missing = classify_date(F.lit(None).cast("string"))  # what null is read as
    out = df.withColumn("__of", plain).join(small, F.col("__of") == F.col("__text"), "left")
    return out.withColumn(name, F.coalesce(name, missing)).drop("__of", "__text")


def first_values(df: DataFrame, columns: list[str], n: int = 100) -> dict[str, list[str]]:
    """The first n non-null texts of each column, from one bounded read for each column."""
    return {c: [r[0] for r in df.filter(F.col(c).isNotNull()).select(ws_trim(c)).limit(n).collect()] for c in columns}


def infer_types(df: DataFrame, columns: list[str] | None = None) -> dict[str, Inferred]:
    """The semantic type of each text column (or of those given), with confidence and evidence."""
    columns = columns if columns is not None else [c for c in df.columns if is_text(df, c)]
    evidence, heads = text_evidence(df, columns), first_values(df, columns)
    return {c: decide_type(c, evidence.get(c), heads[c]) for c in columns}


def decide_type(column: str, e: dict | None, head: list[str]) -> Inferred:
    if not e or not e["n"]:
        return Inferred(column, "string", 0.5)
    n, dates = e["n"], date_convention(column, e)
    if looks_like_identifier(head, e["distinct"] / max(e["rows"], 1)):
        return Inferred(column, "identifier", 0.98, e)
    if e["boolean"] == n:
        return Inferred(column, "boolean", 0.99, e)
    if dates["parse_ratio"] >= PARSE_THRESHOLD:
        return Inferred(column, "datetime", dates["confidence"], e | dates)
    if e["number"] / n >= PARSE_THRESHOLD:
        kind = "currency" if e["currency"] / n >= 0.4 else "percentage" if e["percent"] / n >= 0.4 else "integer" if e["whole"] == e["number"] else "float"
        return Inferred(column, kind, 0.95, e)
    if e["length"] > 80 or e["words"] > 10:
        return Inferred(column, "text", 0.90, e)
    if e["distinct"] / n <= 0.60 or e["distinct"] <= 50:
        return Inferred(column, "categorical", 0.88, e)
    return Inferred(column, "string", 0.85, e)


def conversion(column: str, kind: str, dayfirst: bool = False) -> Column:
    if kind == "boolean":
        return to_boolean(column)
    if kind == "datetime":
        return classify_date(column, dayfirst)["ts"]
    return parse_number(column)


def safe_convert(df: DataFrame, kinds: dict[str, Inferred]) -> tuple[DataFrame, dict[str, str]]:
    """Convert columns of a type that loses no value; numbers become long if all are whole. Also says what was refused."""
    wanted = {c: i for c, i in kinds.items() if i.type in ("boolean", "datetime", "integer", "float", "currency", "percentage")}
    refused = {c: "ambiguous dates" for c, i in wanted.items() if i.type == "datetime" and i.evidence.get("ambiguous") is True}
    tries = {c: conversion(c, i.type, bool(i.evidence.get("dayfirst"))) for c, i in wanted.items() if c not in refused}
    if not tries:
        return df, refused
    exprs = [e for c, x in tries.items() for e in (F.count(F.when(ws_trim(c) != "", 1)).alias(f"{c}|n"), F.count(x).alias(f"{c}|k"))]
    exprs += [F.coalesce(F.bool_and(x % 1 == 0), F.lit(False)).alias(f"{c}|w") for c, x in tries.items() if wanted[c].type not in ("boolean", "datetime")]
    row, out = df.agg(*exprs).first().asDict(), {}
    for c, x in tries.items():
        if row[f"{c}|n"] != row[f"{c}|k"]:
            refused[c] = f"{row[f'{c}|n'] - row[f'{c}|k']} values would be lost"
        else:
            out[c] = x.cast("long") if row.get(f"{c}|w") else x
    return df.withColumns(out) if out else df, refused


def auto_types(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, dict[str, Inferred], dict[str, str]]:
    kinds = infer_types(df, columns)
    out, refused = safe_convert(df, kinds)
    return out, kinds, refused


def mistyped(df: DataFrame) -> dict[str, Inferred]:
    """Text columns that are numbers, booleans or dates with confidence."""
    return {c: i for c, i in infer_types(df).items() if i.confidence >= 0.85 and i.type in ("integer", "float", "currency", "percentage", "boolean", "datetime")}


def to_numeric(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    """Explicit conversion: what can't be read becomes null and is counted by class; whole numbers become long."""
    read = {c: explicit_number(c) for c in columns}
    exprs = []
    for c, (value, how) in read.items():
        exprs += [F.count(F.when(how == k, 1)).alias(f"{c}|{k}") for k in ("missing", "numeric_string", "formatted", "written", "unparseable")]
        exprs.append(F.coalesce(F.bool_and(value % 1 == 0), F.lit(False)).alias(f"{c}|whole"))
    row = df.agg(*exprs).first().asDict() if exprs else {}
    counts = {c: {k.split("|")[1]: v for k, v in row.items() if k.startswith(f"{c}|") and not k.endswith("|whole")} for c in columns}
    return df.withColumns({c: v.cast("long") if row[f"{c}|whole"] else v for c, (v, _) in read.items()}), counts


def unparseable_cells(df: DataFrame, column: str) -> DataFrame:
    """The lineage of an explicit conversion: the values that became null although they were not missing."""
    return df.filter(explicit_number(column)[1] == "unparseable").select(F.lit(column).alias("column"), text(column).alias("original_value"), F.lit("not reliably interpretable as numeric").alias("reason"))


def simple_cast(df: DataFrame, column: str, kind: str) -> DataFrame:
    c = F.col(column)
    new = {"numeric": lambda: c.try_cast("double"), "datetime": lambda: F.try_to_timestamp(text(c)), "category": lambda: text(c)}[kind]()
    return df.withColumn(column, new)


def normalize_dates(df: DataFrame, columns: list[str] | None = None, dayfirst: bool | None = None) -> tuple[DataFrame, dict[str, dict]]:
    """Text columns to timestamps by their convention, each with a {column}_display; also the analyses."""
    columns = columns if columns is not None else [c for c in df.columns if is_text(df, c)]
    evidence = text_evidence(df, columns)
    found = {c: date_convention(c, evidence[c]) | {k: evidence[c][k] for k in ("n", "dates", "ambiguous", "invalid", "has_time", "has_zone")} | {"is_ambiguous": date_convention(c, evidence[c])["ambiguous"]} for c in columns if c in evidence}
    out = df
    for c in columns:
        out = read_dates(out, c, "__date", found[c]["dayfirst"] if dayfirst is None else dayfirst).withColumn(c, F.col("__date.ts")).drop("__date")
    shown = {f"{c}_display": display_date(c) for c in columns}
    return out.withColumns(shown).select(*df.columns, *shown) if columns else df, found
