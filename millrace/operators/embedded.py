"""Records inside of text cells: finding labels, parsing, rebuilding a table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import is_blank, prose_signals, text, ws_trim
from millrace.operators.missing import is_text
from millrace.operators.reshape import retype_numeric
from millrace.operators.rows import ROW_ID, with_row_id

# Separators in order of preference.
SEPARATORS = [":", "=", "|", ";", ","]
LEFTOVER = "unclassified_text"
_LABEL = r"\b([A-Za-z0-9_\s]{1,30})"


def target_column(df: DataFrame) -> str | None:
    """The only column, or the text column with the longest average."""
    if len(df.columns) == 1:
        return df.columns[0]
    columns = [c for c in df.columns if is_text(df, c)]
    if not columns:
        return None
    row = df.agg(*[F.avg(F.length(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
    return max(enumerate(columns), key=lambda x: row[str(x[0])] or 0)[1]


def token_patterns(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k most frequent tokens and pairs of neighbours: (kind, token, n)."""
    tokens = F.filter(F.split(ws_trim(column), r"\s+"), lambda t: t != "")
    pairs = F.zip_with(tokens, F.slice(tokens, 2, F.size(tokens)), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    both = df.select(F.explode(F.concat(F.transform(tokens, lambda t: F.struct(F.lit("token").alias("kind"), t.alias("token"))), F.transform(F.array_compact(pairs), lambda t: F.struct(F.lit("bigram").alias("kind"), t.alias("token"))))).alias("x"))
    counted = both.select("x.*").groupBy("kind", "token").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind").orderBy(F.col("n").desc(), "token")
    return counted.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("kind", "token", "n")


def prose_likelihood(df: DataFrame, column: str) -> float:
    ends, word = prose_signals(column)
    row = df.filter(F.col(column).isNotNull()).select(column).limit(50).agg(F.avg(ends.cast("double")), F.avg(word.cast("double"))).first()
    return min(1.0, 0.5 * (row[0] or 0.0) + 0.5 * (row[1] or 0.0))


def _explicit(c: Column, sep: str) -> Column:
    """The labels of one row for a separator."""
    if sep in (":", "="):
        found = F.transform(F.regexp_extract_all(c, F.lit(_LABEL + sep), 1), ws_trim)
    else:
        parts = F.filter(F.transform(F.split(c, re.escape(sep), -1), ws_trim), lambda t: t != "")
        found = F.filter(parts, lambda t, i: (i % 2 == 0) & (F.length(t) < 30))
    return F.when(F.contains(c, F.lit(sep)), F.filter(found, lambda t: (t != "") & ~t.rlike(r"^\d+$"))).otherwise(F.array().cast("array<string>"))


def explicit_labels(df: DataFrame, column: str) -> dict | None:
    """Labels before separators, in rows' majority: the first separator that has two or more."""
    rows = df.filter(~is_blank(column)).select(text(column).alias("x"))
    n, *hits = rows.agg(F.count(F.lit(1)), *[F.count(F.when(F.size(_explicit(F.col("x"), sep)) > 0, 1)) for sep in SEPARATORS]).first()
    for sep, matched in zip(SEPARATORS, hits, strict=True) if n >= 2 else []:
        labels = _explicit(F.col("x"), sep)
        if matched / n < 0.25:
            continue
        counts = rows.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").count().filter(F.col("count") >= max(2, int(0.25 * n)))
        # A label is in a quarter of the rows, or two: there are four for each label of a row at most, and none is left out.
        valid = {r["label"]: r["count"] for r in counts.orderBy(F.desc("count"), "label").collect()}
        first = rows.filter(F.contains("x", F.lit(sep))).select(labels).limit(1).first()
        ordered = list(dict.fromkeys([x for x in (first[0] if first else []) if x in valid] + list(valid)))
        if len(ordered) >= 2:
            ratio = matched / n
            return {"labels": ordered, "separator": sep, "consistency": ratio, "confidence": min(0.95, 0.9 * ratio + 0.02 * len(ordered)), "counts": valid}
    return None


def implicit_labels(df: DataFrame, column: str) -> dict | None:
    """Labels in white-space records: tokens of many rows that are followed by values.

    Rows are counted for each token first, combined before the shuffle; only tokens of many rows are looked at further.
    """
    plain = df.filter(~is_blank(column)).select(text(column).alias("x"))
    tokens = F.filter(F.split(ws_trim("x"), r"\s+"), lambda t: t != "")
    n = plain.count()
    if n < 2:
        return None
    label_like = (F.length("token") >= 2) & ~F.col("token").rlike(r"^\d+$")
    found = plain.select(F.explode(F.array_distinct(tokens)).alias("token")).filter(label_like).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    many = [r["token"] for r in found.filter(F.col("n") >= max(2, int(0.30 * n))).collect()]  # each in three tenths of the rows, or two
    if len(many) < 2:
        return None
    rows = with_row_id(plain)
    pairs = F.transform(tokens, lambda t, i: F.struct(t.alias("token"), F.get(tokens, i + 1).alias("next")))
    placed = rows.select(ROW_ID, F.posexplode(pairs).alias("pos", "pair")).select(ROW_ID, "pos", "pair.*").filter(F.col("token").isin(many))
    near = placed.groupBy(ROW_ID, "token").agg(F.min_by(F.struct("pos", "next"), "pos").alias("at")).select(ROW_ID, "token", "at.*")
    stats = near.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("next").isNull(), 1)).alias("last"), F.avg("pos").alias("pos"), F.min(ROW_ID).alias("first"))
    often = stats.filter(F.col("n") >= max(2, int(0.30 * n))).orderBy(F.desc("n"), "first", "pos").collect()  # each in three tenths of the rows, or two
    inner = [r for r in often if r["last"] / r["n"] < 0.5]
    if len(inner) < 2:
        return None
    names = [r["token"] for r in inner]
    followed = near.filter(F.col("token").isin(names) & F.col("next").isin(names)).groupBy("token", "next").count().collect()  # labels only
    by: dict[str, dict[str, int]] = {}
    for r in followed:
        by.setdefault(r["token"], {})[r["next"]] = r["count"]
    fine = [r for r in inner if sum(by.get(r["token"], {}).values()) / r["n"] < 0.5]
    merged, skip = [], False
    for k, r in enumerate(fine):
        if skip:
            skip = False
            continue
        after = fine[k + 1]["token"] if k + 1 < len(fine) else None
        skip = after is not None and by.get(r["token"], {}).get(after, 0) / r["n"] >= 0.7
        merged.append((f"{r['token']} {after}" if skip else r["token"], r["pos"]))
    if len(merged) < 2:
        return None
    labels = [x for x, _ in sorted(merged, key=lambda x: x[1])]
    present = [F.col("x").rlike(rf"(?i)\b\Q{x}\E\b") for x in labels]
    row = rows.agg(*[F.avg(c.cast("double")) for c in (_fold(present, all), _fold(present, any))]).first()
    return {"labels": labels, "separator": " ", "consistency": row[1], "confidence": min(0.95, 0.6 * row[0] + 0.35 * row[1]), "counts": {r["token"]: r["n"] for r in fine}}


def _fold(conditions: list[Column], how: object) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c if how is all else out | c
    return out


def discover_labels(df: DataFrame, column: str) -> dict:
    """Explicit labels if sure, else the better of both; none in prose or in fewer than two rows."""
    none = {"labels": [], "separator": " ", "consistency": 0.0, "confidence": 0.0, "counts": {}}
    explicit = explicit_labels(df, column)
    if explicit and explicit["confidence"] >= 0.70:
        return explicit
    if prose_likelihood(df, column) > 0.65:
        return none
    implicit = implicit_labels(df, column)
    return max([x for x in (explicit, implicit) if x] or [none], key=lambda x: x["confidence"])


def parse_records(column: str, labels: list[str], separator: str = " ") -> dict[str, Column]:
    """label -> value expression, and the leftover. Labels may come in any order; repeats are joined by '; '."""
    tail = rf"\s*{re.escape(separator)}" if separator in SEPARATORS else r"\b"
    parts = "|".join(rf"\Q{x}\E" for x in sorted(labels, key=len, reverse=True))
    mark = rf"(?i)(?:\b|^)(?:{parts}){tail}"
    x = ws_trim(column)
    heads = F.transform(F.regexp_extract_all(x, F.lit(mark), 0), lambda h: F.lower(F.regexp_replace(h, rf"{tail if separator in SEPARATORS else ''}$", "")))
    bodies = F.split(x, mark, -1)
    clean = lambda v: F.regexp_replace(v, r"^[:=|;,\-\s]+|[:=|;,\-\s]+$", "")
    fields = F.zip_with(heads, F.slice(bodies, 2, F.size(bodies)), lambda h, b: F.struct(ws_trim(h).alias("label"), clean(b).alias("value")))
    out = {}
    for label in labels:
        values = F.transform(_of(fields, label), lambda f: f["value"])
        out[label] = F.when(F.size(values) > 0, F.array_join(values, "; "))
    first = F.element_at(bodies, 1)
    out[LEFTOVER] = F.when(ws_trim(first) != "", ws_trim(first))
    return out


def _of(fields: Column, label: str) -> Column:
    return F.filter(fields, lambda f: (f["label"] == label.lower()) & (f["value"] != ""))


def rebuild(df: DataFrame, column: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """The text column as one column for each label; other columns stay; a null cell gives nulls."""
    column = column or target_column(df)
    if column is None:
        return df
    found = discover_labels(df, column) if labels is None else {"labels": labels, "separator": " "}
    if len(found["labels"]) < 2:
        return df
    fields = parse_records(column, found["labels"], " ")
    out = df.select(*[e.alias(k) for k, e in fields.items()], *[F.col(c) for c in df.columns if c != column and c not in fields])
    if out.filter(F.col(LEFTOVER).isNotNull()).isEmpty():
        out = out.drop(LEFTOVER)
    return retype_numeric(out, found["labels"])


def value_label(values: DataFrame, column: str) -> str:
    """What the values of a field are: e-mail, URL, currency, percentage and so on, by ordered tests in one aggregate."""
    x = ws_trim(column)
    rows = values.filter(F.coalesce(x, F.lit("")) != "").select(x.alias("v"))
    v, low = F.col("v"), F.lower("v")
    number = F.regexp_replace(v, r"[$,\s]", "").try_cast("double")
    # Words of places, patterns of kinds of values, and the order and shares by which a kind is chosen.
    places = ["street", "st", "avenue", "ave", "road", "rd", "crescent", "plot", "block", "city", "state", "zip", "postal", "country", "suite", "apt", "number", "lagos", "karachi", "london", "york", "chicago"]
    tests = {
        "email": v.rlike(r"^[\w.-]+@[\w.-]+\.\w+$"), "url": low.rlike(r"^(https?://|www\.)"), "currency": v.rlike("[$€£¥₹₦]|USD|EUR|GBP"), "percent": v.endswith("%"),
        "phone": v.rlike(r"^\+?\d{1,4}?[\s.-]?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}$"), "place": low.rlike("|".join(places)), "words": v.rlike(r"\S\s+\S"),
        "date": v.rlike(r"\b(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b"), "time": v.rlike("[:T]"), "bool": low.isin("true", "false", "yes", "no", "y", "n", "t", "f", "1", "0"),
        "number": number.isNotNull(), "whole": number.isNotNull() & (number % 1 == 0), "id": v.rlike(r"(?i)^([A-Z0-9]{2,10}[-_][A-Z0-9]{2,10}|\d{4,12}|EMP-\d+|TX-\d+|ID-\d+)$"),
    }
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("distinct"), F.coalesce(F.bool_or(tests["date"] & tests["time"]), F.lit(False)).alias("stamped"), *[F.avg(c.cast("double")).alias(k) for k, c in tests.items()]).first().asDict()
    if not r["n"]:
        return "text"
    ladder = [
        ("email", r["email"] == 1), ("URL", r["url"] == 1), ("currency", r["currency"] > 0), ("percentage", r["percent"] == 1), ("phone number", r["phone"] >= 0.7),
        ("address/location", r["place"] >= 0.6 and r["words"] > 0), ("datetime" if r["stamped"] else "date", r["date"] >= 0.7), ("boolean", r["bool"] == 1 and r["n"] >= 2),
        ("integer" if r["whole"] >= 0.9 * r["number"] else "float", r["number"] >= 0.8), ("identifier", r["id"] == 1), ("categorical", r["distinct"] <= 15 and r["distinct"] / r["n"] < 0.4),
    ]
    return next((name for name, fits in ladder if fits), "text")


def profile_records(df: DataFrame, column: str | None = None) -> dict:
    """Density, lengths, labels and their kinds of a column that may hold records."""
    column = column or target_column(df)
    if column is None:
        return {"labels": [], "confidence": 0.0, "consistency": 0.0}
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.coalesce(ws_trim(column), F.lit("")) != "", 1)).alias("k"), F.avg(F.length(text(column))).alias("length")).first()
    found = discover_labels(df, column)
    kinds = {}
    if found["labels"]:
        head = df.limit(50).select(*[e.alias(k) for k, e in parse_records(column, found["labels"], found["separator"]).items()])
        kinds = {x: value_label(head, x) for x in found["labels"]}
    return found | {"column": column, "density": row["k"] / max(row["n"], 1), "average_length": row["length"] or 0.0, "kinds": kinds}
