"""Date parsing with ambiguity detection, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import bind, ws_trim

# Texts that mean "missing" in date columns; formats of the generic reader, in order.
MISSING = ["null", "none", "nan", "na", "n/a", "--", "?", "missing", "unknown"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_TAIL = r"(?:[T\s]+\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?\s*(?:[APap][Mm])?\s*(?:Z|[+-]\d{2}:?\d{2})?)?$"
_TIME = r"[T\s](\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?\s*([APap][Mm])?\s*(Z|[+-]\d{2}:?\d{2})?$"
#: Layouts in order: name, pattern, groups of year, month and day.
_LAYOUTS = [
    ("COMPACT", r"^(19\d{2}|20\d{2}|2100)(\d{2})(\d{2})$", (1, 2, 3)),
    ("YMD", r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TAIL, (1, 2, 3)),
    ("PREFIX", r"(?i)^" + _MONTH + r"\s+(\d{1,2}),?\s+(\d{4}|\d{2})" + _TAIL, (3, 1, 2)),
    ("SUFFIX", r"(?i)^(\d{1,2})[-/\s]" + _MONTH + r"[-/\s,]+(\d{4}|\d{2})" + _TAIL, (3, 2, 1)),
    ("SEP", r"^(\d{1,2})([/.\-])(\d{1,2})\2(\d{2,4})" + _TAIL, (4, 1, 3)),
    ("BARE", r"^((?:19|20)\d{2})$", (1, 0, 0)),
]
_CONVENTIONS = {"COMPACT": "ISO", "YMD": "ISO", "PREFIX": "TEXT_MONTH", "SUFFIX": "TEXT_MONTH", "BARE": "UNKNOWN"}


def _layout(x: Column) -> Column:
    """struct(layout, y, m, d) as texts; null for a text of none of the layouts."""
    out = F.lit(None).cast("struct<layout: string, y: string, m: string, d: string>")
    for name, pattern, groups in reversed(_LAYOUTS):
        y, m, d = (F.regexp_extract(x, pattern, g) if g else F.lit("1") for g in groups)
        out = F.when(x.rlike(pattern), F.struct(F.lit(name).alias("layout"), y.alias("y"), m.alias("m"), d.alias("d"))).otherwise(out)
    return out


def _numbers(p: Column) -> Column:
    """The layout with its parts as numbers; two digits of a year are of this century."""
    year, month = p["y"].try_cast("int"), F.lower(p["m"])
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(month, 1, 3)).cast("int")
    return F.struct(
        p["layout"].alias("layout"), F.when(year < 100, year + 2000).otherwise(year).alias("y"),
        F.when(month.rlike("[a-z]"), named).otherwise(month.try_cast("int")).alias("m"), p["d"].try_cast("int").alias("d"),
    )


def _moment(y: Column, m: Column, d: Column, x: Column) -> Column:
    """A timestamp of a day and the time that the text ends with, if it does; zones count as UTC offsets."""
    part = lambda k: F.coalesce(F.regexp_extract(x, _TIME, k).try_cast("int"), F.lit(0))
    half, zone = F.lower(F.regexp_extract(x, _TIME, 4)), F.regexp_extract(x, _TIME, 5)
    hour = part(1) + F.when((half == "pm") & (part(1) < 12), 12).when((half == "am") & (part(1) == 12), -12).otherwise(0)
    minutes = F.coalesce(F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, -2, 2).try_cast("int"), F.lit(0)) * F.when(zone.startswith("-"), -1).otherwise(1)
    local = F.try_make_timestamp(y, m, d, hour, part(2), part(3).cast("decimal(8,6)"))
    return (local - F.make_interval(mins=minutes)).cast("timestamp_ntz")


def classify_date(c: Column | str, dayfirst: bool | Column = False) -> Column:
    """struct(status, ts, convention, has_time, has_zone) of a text.

    status: MISSING, UNAMBIGUOUS, AMBIGUOUS (with a tentative reading) or INVALID. convention: ISO, TEXT_MONTH, DMY,
    MDY, IDENTICAL_DM, AMBIGUOUS or UNKNOWN. The clock is never asked: texts such as "now" are INVALID.
    """
    hint = dayfirst if isinstance(dayfirst, Column) else F.lit(dayfirst)
    norm = F.regexp_replace(F.regexp_replace(ws_trim(c), r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1"), r"\s+", " ")

    def read(x: Column, p: Column) -> Column:
        first, second = p["m"], p["d"]  # of SEP: the numbers as they stand
        sep = p["layout"] == "SEP"
        both = sep & first.between(1, 12) & second.between(1, 12)
        known = F.when(~sep, F.create_map(*[F.lit(v) for kv in _CONVENTIONS.items() for v in kv])[p["layout"]])
        convention = known
        convention = F.coalesce(convention, F.when(sep & (first > 12) & second.between(1, 12), "DMY").when(sep & first.between(1, 12) & (second > 12), "MDY").when(both & (first == second), "IDENTICAL_DM").when(both, "AMBIGUOUS"))

        def moment(k: Column) -> Column:
            swap = (k == "DMY") | ((k == "AMBIGUOUS") & hint)
            return F.struct(k.alias("k"), F.when(k.isNotNull(), _moment(p["y"], F.when(swap, second).otherwise(first), F.when(swap, first).otherwise(second), x)).alias("ts"))

        return bind(convention, moment)

    def finish(x: Column, r: Column) -> Column:
        missing = x.isNull() | (x == "") | F.lower(x).isin(MISSING)
        status = F.when(missing, "MISSING").when(r["k"] == "AMBIGUOUS", "AMBIGUOUS").when(r["ts"].isNotNull(), "UNAMBIGUOUS").otherwise("INVALID")
        kept = r["ts"].isNotNull() | (r["k"] == "AMBIGUOUS")
        return F.struct(
            status.alias("status"), F.when(~missing, r["ts"]).alias("ts"), F.when(~missing & kept, r["k"]).alias("convention"),
            F.coalesce(x.rlike(r"[T\s]\d{1,2}:\d{2}"), F.lit(False)).alias("has_time"), F.coalesce(x.rlike(r"[T\s]\d{1,2}:\d{2}(:\d{2})?(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})$"), F.lit(False)).alias("has_zone"),
        )

    return bind(norm, lambda x: bind(bind(bind(_layout(x), _numbers), lambda p: read(x, p)), lambda r: finish(x, r)))


def display_date(ts: Column | str, missing: str = "", pattern: str = "dd-MM-yy") -> Column:
    return F.coalesce(F.date_format(ts, pattern), F.lit(missing))


def date_features(ts: Column | str, reference: Column) -> dict[str, Column]:
    """year, month, day, dayofweek (Monday 0), hour and days elapsed to a reference."""
    t = F.col(ts) if isinstance(ts, str) else ts
    days = (F.unix_timestamp(reference) - F.unix_timestamp(t)) / 86400.0
    return {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "dayofweek": F.weekday(t), "hour": F.hour(t), "days_elapsed": days}
