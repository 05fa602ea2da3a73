"""Row-local text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a distinct entity, and words of running prose.
QUALIFIERS = [
    "ltd", "limited", "inc", "incorporated", "corp", "corporation", "co", "company", "store", "shop", "center", "centre", "mall", "outlet",
    "market", "mart", "plus", "pro", "max", "mini", "lite", "ultra", "standard", "premium", "north", "south", "east", "west", "central", "hq",
    "branch", "group", "division", "dept", "department", "service", "services", "solutions",
]
PROSE_WORDS = ["the", "is", "at", "which", "on", "and", "a", "an", "this", "that", "with", "from", "by", "for", "it", "because", "reported", "delay"]

#: Texts that are composed at a time.
TEXTS = 64


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def ws_trim(c: Column | str) -> Column:
    """Trim all Unicode white space at the edges."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def strip_collapse(c: Column | str) -> Column:
    """Trim, and make every run of white space one blank; null stays null."""
    return F.regexp_replace(ws_trim(c), r"(?U)\s+", " ")


def is_blank(c: Column | str) -> Column:
    """Null, or nothing but white space."""
    return ~F.coalesce(text(c).rlike(r"(?U)\S"), F.lit(False))


def title_case(c: Column | str) -> Column:
    """Upper-case every letter that follows no letter, lower-case the others."""
    chars = F.split(ws_trim(c), "")
    pairs = F.zip_with(F.concat(F.array(F.lit(" ")), chars), chars, lambda before, x: F.when(x.isNull(), "").when(before.rlike(r"\p{L}"), F.lower(x)).otherwise(F.upper(x)))
    return F.array_join(pairs, "")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _nfkc(c: Column) -> Column:
    """The only Python in this module: the JVM has no function for it, and Arrow's kernel leaves letters decomposed.

    A few texts at a time are Python objects, whatever the batch holds.
    """

    def run(values: pa.Array) -> pa.Array:
        pa.default_memory_pool().release_unused()  # what the batch before has left
        slices = [values.slice(i, TEXTS) for i in range(0, len(values), TEXTS)] or [values]
        return pa.concat_arrays([pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in s.to_pylist()], values.type) for s in slices])

    return F.arrow_udf(run, "string")(c)


def unicode_clean(c: Column | str) -> Column:
    """NFKC, without zero-width characters, white space collapsed. Only text beyond ASCII goes through Python."""
    plain = text(c)
    # Spark computes Python functions for all rows, whatever condition they stand under: ASCII goes there as null.
    composed = F.coalesce(_nfkc(F.when(plain.rlike(r"[^\x00-\x7F]"), plain)), plain)
    return strip_collapse(F.translate(composed, "​﻿‎ ", ""))


def ascii_clean(c: Column | str) -> Column:
    """unicode_clean() for values that are known to be composed: without NFKC, all in the JVM."""
    return strip_collapse(F.regexp_replace(F.regexp_replace(text(c), "[​﻿‎]", ""), " ", " "))


def canonical_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(ascii_clean(c)), "[^a-z0-9]", "")


def token_key(c: Column | str) -> Column:
    return F.array_sort(F.regexp_extract_all(F.lower(ascii_clean(c)), F.lit(r"\b[a-z0-9]+\b"), 0))


def words_of(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(ascii_clean(c)), F.lit(r"\b[a-z0-9]+\b"), 0))


def distinct_entities(a: Column, b: Column) -> Column:
    """Whether two values must never merge: they differ in a qualifier, or one is a word of the other's phrase."""
    x, y = words_of(a), words_of(b)
    differ = F.concat(F.array_except(x, y), F.array_except(y, x))
    lone = ((F.size(x) == 1) & (F.size(y) > 1) & (F.size(F.array_except(x, y)) == 0)) | ((F.size(y) == 1) & (F.size(x) > 1) & (F.size(F.array_except(y, x)) == 0))
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.arrays_overlap(differ, F.array(*map(F.lit, QUALIFIERS))) | lone)


def replace_literal(c: Column | str, old: str, new: str) -> Column:
    if old == "":
        raise ValueError("the text to replace is empty")
    return F.replace(text(c), F.lit(old), F.lit(new))


def value_class(c: Column | str) -> Column:
    """What a text looks like: int, float, bool, date or text; null for null."""
    x = ws_trim(c)
    return (
        F.when(x.isNull(), None).when(x.rlike(r"^[+-]?\d+$"), "int").when(x.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "float")
        .when(F.lower(x).isin("true", "false"), "bool").when(x.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?.*)?$"), "date").otherwise("text")
    )


def prose_signals(c: Column | str) -> tuple[Column, Column]:
    """(ends like a sentence, holds a common word) of one row."""
    x = text(c)
    return F.rtrim(x).rlike(r"[.?!]\s*$"), x.rlike(r"\b(" + "|".join(PROSE_WORDS) + r")\b")
