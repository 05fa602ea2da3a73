"""Row-local operators over streams: the same expressions run unchanged on streaming tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.dates import classify_date
from millrace.functions.numbers import parse_number
from millrace.functions.text import strip_collapse


def read_folder(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def repair_stream(df: DataFrame, strip: tuple[str, ...] = (), numbers: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> DataFrame:
    """Strip texts, parse numbers and dates of a stream (or a table); no state."""
    exprs = {c: strip_collapse(c) for c in strip} | {c: parse_number(c) for c in numbers} | {c: classify_date(c)["ts"] for c in dates}
    return df.withColumns(exprs) if exprs else df


def deduplicate_stream(df: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark: bounded state."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_profile(df: DataFrame, time: str, value: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts, nulls and moments of a value in windows of event time."""
    stamped = df.withWatermark(time, delay).groupBy(F.window(time, width))
    return stamped.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(value)).alias("missing"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
