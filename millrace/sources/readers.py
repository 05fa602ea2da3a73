"""Sources: CSV, Parquet and, where openpyxl is installed, Excel."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import UTC, datetime
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import LoadError, TableError

EXTENSIONS = (".csv", ".xlsx", ".xls", ".parquet")


@dataclass
class Metadata:
    name: str
    rows: int
    columns: int
    size: int
    names: list[str]
    types: dict[str, str]
    created: datetime = field(default_factory=lambda: datetime.now(UTC))
    sheet: dict = field(default_factory=dict)


def extension(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in EXTENSIONS:
        raise LoadError(f"unsupported extension {ext or '(none)'}: {path}")
    return ext


def read_csv(spark: SparkSession, path: str, infer: bool = True, **options: str) -> DataFrame:
    """With header and quoted line breaks. infer=False reads all columns as text, for the engine's own type inference."""
    return spark.read.options(**({"header": "true", "multiLine": "true", "escape": '"', "inferSchema": str(infer).lower()} | options)).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_excel(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The first sheet and its metadata: merged ranges, title, bounds. Needs openpyxl; a sheet is small by its format."""
    try:
        import openpyxl
    except ImportError as e:
        raise LoadError("reading Excel files needs openpyxl, which is not installed") from e
    book = openpyxl.load_workbook(path, data_only=True)
    sheet = book.worksheets[0]
    rows = [list(r) for r in sheet.iter_rows(values_only=True)]
    names = [str(v) if v is not None else f"Unnamed: {i}" for i, v in enumerate(rows[0] if rows else [])]
    text = [[None if v is None else str(v) for v in r] for r in rows[1:]]
    df = spark.createDataFrame(text, ", ".join(f"`{n}` string" for n in names))
    return df, {"title": sheet.title, "merged": [str(m) for m in sheet.merged_cells.ranges], "max_row": sheet.max_row, "max_column": sheet.max_column}


def validate(df: object) -> DataFrame:
    if not isinstance(df, DataFrame):
        raise TableError("not a table")
    if not df.columns:
        raise TableError("the table has no columns")
    if df.isEmpty():
        raise TableError("the table has no rows")
    return df


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def metadata(df: DataFrame, name: str, size: int = 0, sheet: dict | None = None) -> Metadata:
    return Metadata(name, df.count(), len(df.columns), size, df.columns, dict(df.dtypes), sheet=sheet or {})


def archive(spark: SparkSession, path: str, folder: str) -> str | None:
    """Copy the raw file as {time}_{name}; a failure is no error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = f"{folder.rstrip('/')}/{datetime.now(UTC):%Y%m%d_%H%M%S}_{os.path.basename(urlparse(path).path)}"
    try:
        a, b = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(target)
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    except Exception:
        return None
    return target


def load(spark: SparkSession, path: str, archive_to: str | None = None, infer: bool = True) -> tuple[DataFrame, Metadata]:
    """Check the extension, read, validate, describe, archive."""
    ext, sheet = extension(path), {}
    try:
        if ext == ".csv":
            df = read_csv(spark, path, infer)
        elif ext == ".parquet":
            df = read_parquet(spark, path)
        else:
            df, sheet = read_excel(spark, path)
    except LoadError:
        raise
    except Exception as e:
        raise LoadError(f"can't read {path}: {e}") from e
    validate(df)
    if archive_to:
        archive(spark, path, archive_to)
    return df, metadata(df, os.path.basename(path), file_size(spark, path), sheet)
