"""Number parsing as Column expressions: plain, written, abbreviated and formatted numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import bind, text, ws_trim

# Number words, scales, boolean tokens, currency markers, texts that mean "missing" in explicit conversion.
UNITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "a": 1, "an": 1,
}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
TRUE_TOKENS = ["true", "yes", "y", "1", "t", "on"]
FALSE_TOKENS = ["false", "no", "n", "0", "f", "off"]
CURRENCY = ["$", "€", "£", "¥", "₹", "₩", "₺", "₪", "฿", "₫", "rs.", "rs", "pkr", "usd", "eur", "gbp", "cad", "aud"]
MISSING = ["n/a", "na", "null", "none", "nan", "unavailable", "unknown", "missing", "-", "?", "#n/a", "#na", "#value!", "#ref!", "#error"]

_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def plain_number(c: Column | str) -> Column:
    """A number in digits, or null. The pattern keeps out what casts accept besides (such as 10d)."""
    x = ws_trim(c)
    return F.when(x.rlike(_FLOAT), x.try_cast("double"))


def magnitude(c: Column | str) -> Column:
    """50K, $1.5M, 2B PKR and the like."""
    pattern = r"^[$€£¥₹₦\s]*([0-9.,]+)\s*([kmbtKMBT])\b[\sA-Za-z]*$"

    def read(x: Column) -> Column:
        digits, unit = F.replace(F.regexp_extract(x, pattern, 1), F.lit(","), F.lit("")), F.lower(F.regexp_extract(x, pattern, 2))
        scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1e12)
        return F.when(x.rlike(pattern) & digits.rlike(_FLOAT), digits.try_cast("double") * scale)

    return bind(ws_trim(c), read)


def written_number(c: Column | str) -> Column:
    """Numbers in words, possibly with digits; null if any token is neither."""
    spaced = F.regexp_replace(F.lower(ws_trim(c)), r"[,\-_;]", " ")
    tokens = F.filter(F.split(spaced, r"\s+"), lambda t: t != "")
    table = lambda d: F.create_map(*[v for k, n in d.items() for v in (F.lit(k), F.lit(float(n)))])
    units, tens, scales = table(UNITS), table(TENS), table(SCALES)
    digits = lambda t: F.when(t.rlike(r"^(\d+\.?\d*|\.\d+)$"), t.try_cast("double"))
    get = F.try_element_at
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("part"), F.lit(False).alias("frac"), F.lit(0.1).alias("step"), F.lit(True).alias("ok"), F.lit(False).alias("word"))

    def step(s: Column, t: Column) -> Column:
        unit, ten, scale, number = get(units, t), get(tens, t), get(scales, t), digits(t)
        point, joiner = t.isin("point", "dot"), t == "and"
        small = F.coalesce(unit, number)
        first = F.when(s["part"] == 0, 1.0).otherwise(s["part"])
        known = unit.isNotNull() | ten.isNotNull() | scale.isNotNull() | (t == "hundred") | number.isNotNull() | point | joiner
        in_frac = s["frac"] & ~point & ~joiner
        ok = s["ok"] & known & (~in_frac | F.coalesce(small < 10, F.lit(False)))
        part = (
            F.when(joiner | point, s["part"]).when(in_frac, s["part"] + F.coalesce(small, F.lit(0.0)) * s["step"]).when(t == "hundred", first * 100.0)
            .when(scale.isNotNull(), 0.0).otherwise(s["part"] + F.coalesce(unit, ten, number, F.lit(0.0)))
        )
        total = F.when(scale.isNotNull() & ~in_frac, s["total"] + first * scale).otherwise(s["total"])
        return F.struct(
            total.alias("total"), part.alias("part"), (s["frac"] | point).alias("frac"), F.when(in_frac, s["step"] * 0.1).otherwise(s["step"]).alias("step"),
            ok.alias("ok"), (s["word"] | (~joiner & number.isNull() & known)).alias("word"),
        )

    found = F.aggregate(tokens, zero, step, lambda s: F.when(s["ok"] & s["word"], s["total"] + s["part"]))
    # The aggregation is costly: only texts of number words, digits and joiners get there.
    return F.when(F.size(tokens) > 0, F.when(spaced.rlike(r"[a-z]"), found))


_MARKS = "(?i)(" + "|".join("".join(f"[{ch}]" if not ch.isalnum() else ch for ch in mark) for mark in CURRENCY) + ")"


def _separated(digits: Column) -> Column:
    """A number of digits, commas and dots, by where they stand."""
    comma, dot = F.instr(digits, ","), F.instr(digits, ".")
    without = F.replace(digits, F.lit(","), F.lit(""))
    number = (
        F.when((comma > 0) & (dot > 0) & (comma < dot), without)
        .when((comma > 0) & (dot > 0), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(digits.rlike(r"^[^,]*,[^,]*$") & ~digits.rlike(r",.{3}$"), F.replace(digits, F.lit(","), F.lit(".")))
        .otherwise(without)
    )
    return bind(number, lambda n: F.when(n.rlike(r"^(\d+\.?\d*|\.\d+)$"), n.try_cast("double")))


def formatted_number(c: Column | str) -> Column:
    """Signs by parentheses or minus at either end, currency markers, percent, separators by locale."""

    def read(x: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(x, r"^\((.*)\)$|^(.*)-$|^[-+](.*)$", "$1$2$3"), _MARKS, "")
        value = bind(F.regexp_replace(body, r"[^\d.,]", ""), _separated)
        return F.when(x.rlike(r"^\(.*\)$|-$|^-"), -value).otherwise(value)

    return bind(ws_trim(c), read)


def parse_number(c: Column | str) -> Column:
    """Abbreviated, then written, then formatted number; null for anything else."""
    return F.coalesce(magnitude(c), written_number(c), formatted_number(c))


def _tag(how: str) -> Callable[[Column], Column]:
    return lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(how).alias("how")))


def _explicit(c: Column | str) -> Column:
    def read(x: Column) -> Column:
        missing = x.isNull() | (x == "") | F.lower(x).isin(MISSING)
        none = lambda how: F.struct(F.lit(None).cast("double").alias("value"), F.lit(how).alias("how"))
        kinds = ((plain_number, "numeric_string"), (magnitude, "formatted"), (written_number, "written"), (formatted_number, "formatted"))
        return F.when(missing, none("missing")).otherwise(F.coalesce(*[bind(f(x), _tag(how)) for f, how in kinds], none("unparseable")))

    return bind(ws_trim(c), read)


def explicit_number(c: Column | str) -> tuple[Column, Column]:
    """(value, how it was read): missing, numeric_string, formatted, written or unparseable."""
    found = _explicit(c)
    return found["value"], found["how"]


def to_boolean(c: Column | str) -> Column:
    x = F.lower(ws_trim(c))
    return F.when(x.isin(TRUE_TOKENS), True).when(x.isin(FALSE_TOKENS), False)


def finite(c: Column | str) -> Column:
    """A floating number, with NaN and the infinities as null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), x)


def pretty_bytes(c: Column | str) -> Column:
    """Bytes with a unit: 512.0 B, 1.5 KB and so on."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    out = F.format_string("%.1f TB", x / F.lit(1024.0**4))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(x < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", x / F.lit(1024.0**k))).otherwise(out)
    return out


def shortened(c: Column | str, most: int) -> Column:
    """A text of `most` characters at most, cut with an ellipsis."""
    x = text(c)
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x)
