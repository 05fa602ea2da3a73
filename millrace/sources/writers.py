"""Sinks: guarded export, CSV, Excel, previews, reports and JSON."""

from __future__ import annotations

import base64
import dataclasses
import datetime as dt
import enum
import json
import math
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import ExportError
from millrace.functions.names import export_names
from millrace.functions.text import text


def guard(df: object, original: DataFrame | None = None) -> DataFrame:
    """Refuse what is no table, has no columns or no rows (above all if the original had some)."""
    if not isinstance(df, DataFrame) or not df.columns:
        raise ExportError("nothing to export")
    if df.isEmpty():
        raise ExportError("all rows were lost" if original is not None and not original.isEmpty() else "the table has no rows")
    return df


def clean(df: DataFrame) -> DataFrame:
    """Without index columns (unless there are no others), with whole and unique names."""
    index = [i for i, c in enumerate(df.columns) if c.strip().lower() in ("unnamed: 0", "index")]
    keep = [i for i in range(len(df.columns)) if i not in index] or list(range(len(df.columns)))
    by_place = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[f"c{i}" for i in keep])
    return by_place.toDF(*export_names([df.columns[i] for i in keep]))


def write_csv(df: DataFrame, path: str, original: DataFrame | None = None) -> None:
    """UTF-8 with header, quotes doubled, dates as dd-MM-yy. As many files as partitions: nothing is gathered."""
    clean(guard(df, original)).write.mode("overwrite").options(header="true", escape="\"", timestampFormat="dd-MM-yy", timestampNTZFormat="dd-MM-yy", dateFormat="dd-MM-yy").csv(path)


def write_excel(df: DataFrame, path: str, most_rows: int = 1_048_575) -> None:
    """A sheet of at most the format's rows; larger tables are refused. Needs openpyxl."""
    try:
        import openpyxl
    except ImportError as e:
        raise ExportError("writing Excel files needs openpyxl, which is not installed") from e
    out = clean(guard(df))
    if out.count() > most_rows:
        raise ExportError("the table is too long for a sheet")
    book = openpyxl.Workbook()
    sheet = book.active
    sheet.title = "Cleaned Data"
    sheet.append(out.columns)
    for row in out.toLocalIterator():
        sheet.append(list(row))
    book.save(path)


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    """The first n rows (500 at most), with cells of no plain type as text."""
    plain = (T.NumericType, T.BooleanType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
    cells = [F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else text(F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields]
    return df.select(*cells).limit(min(n, 500))


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text for each row; NaN and the infinities are null."""
    safe = lambda f: F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
    return df.select(F.to_json(F.struct(*[safe(f) for f in df.schema.fields]), {"ignoreNullFields": "false"}).alias("json"))


def sanitize(x: Any, depth: int = 0, seen: tuple[int, ...] = ()) -> Any:
    """Anything as JSON values: dates in ISO form, NaN as null, cycles and depths over 50 marked."""
    if x is None or isinstance(x, (bool, int, str)):
        return x
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, Decimal):
        return sanitize(float(x))
    if isinstance(x, (dt.datetime, dt.date, dt.time)):
        return x.isoformat()
    if isinstance(x, dt.timedelta):
        return x.total_seconds()
    if isinstance(x, enum.Enum):
        return sanitize(x.value)
    if isinstance(x, bytes):
        try:
            return x.decode()
        except UnicodeDecodeError:
            return base64.b64encode(x).decode()
    if depth >= 50:
        return "<too deep>"
    if id(x) in seen:
        return "<cycle>"
    inner = (*seen, id(x))
    if isinstance(x, Row):
        return sanitize(x.asDict(True), depth, seen)
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return sanitize({f.name: getattr(x, f.name) for f in dataclasses.fields(x)}, depth, inner)
    if isinstance(x, dict):
        return {str(k): sanitize(v, depth + 1, inner) for k, v in x.items()}
    if isinstance(x, (list, tuple, set, frozenset)):
        return [sanitize(v, depth + 1, inner) for v in (sorted(x, key=str) if isinstance(x, (set, frozenset)) else x)]
    if isinstance(x, DataFrame):
        return [sanitize(r, depth + 1, inner) for r in preview(x, 500).collect()]
    if hasattr(x, "item"):
        return sanitize(x.item(), depth + 1, inner)
    return str(x)


def to_json(x: Any) -> str:
    return json.dumps(sanitize(x), ensure_ascii=False)
