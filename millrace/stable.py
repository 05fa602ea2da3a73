"""Where rows lie: written once for several jobs, spread over all cores."""

from __future__ import annotations

import atexit
import contextlib
import io
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession, name: str | None = None) -> str:
    """The folder that driver and executors share, or a new name below it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        root = context.getConf().get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="millrace-checkpoints-")
            atexit.register(shutil.rmtree, root, True)
        context.setCheckpointDir(root)
    root = context._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}" if name else root


def delete(spark: SparkSession, uri: str) -> None:
    """Delete a folder of any store that Spark can write to; one that is gone already is no error."""
    with contextlib.suppress(Exception):  # also runs when the driver ends, maybe after the session
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Write a table to the shared folder; returns it as read back, and its folder.

    Any names can be kept, repeated ones too, and columns without a type.
    """
    spark, uri = df.sparkSession, shared_folder(df.sparkSession, "table")
    void = [isinstance(f.dataType, T.NullType) for f in df.schema.fields]
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    plain.select(*(F.col(c).cast("string") if v else F.col(c) for c, v in zip(plain.columns, void, strict=True))).write.parquet(uri)
    back = spark.read.schema(T.StructType([T.StructField(f"c{i}", T.StringType() if v else f.dataType) for i, (f, v) in enumerate(zip(df.schema.fields, void, strict=True))])).parquet(uri)
    columns = [(F.lit(None) if v else F.col(f"c{i}")).alias(c) for i, (c, v) in enumerate(zip(df.columns, void, strict=True))]
    return back.select(*columns), uri


def stable(df: DataFrame) -> DataFrame:
    """The same rows in the same order however often they are read: a table in the shared folder, until the driver ends.

    Spark samples range boundaries and coalesces shuffled partitions anew in each job, so what one job finds out about
    partitions does not hold in the next. Numbers of partitions or rows must be columns of what is written.
    The folder is below spark.checkpoint.dir; only local masters get one of their own.
    """
    if not df.columns:
        return df
    back, uri = write_table(df)
    atexit.register(delete, df.sparkSession, uri)
    return back


@contextlib.contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """stable(), deleted when the block ends: for tables whose result goes to the driver inside of the block."""
    back, uri = write_table(df)
    try:
        yield back
    finally:
        delete(df.sparkSession, uri)


#: Nodes of plans that deal the same rows to the same partitions in each job: they depend on files or ranges alone.
_FIXED = {"Project", "Filter", "ColumnarToRow", "FileScan", "Range", "LocalTableScan"}
#: Functions whose value differs from job to job.
_MOVING = re.compile(r"\b(?:rand|randn|random|randstr|uniform|uuid|shuffle|now|current_\w+|localtimestamp|nonce)\(|\brand\b|Sample", re.IGNORECASE)


def scans_only(df: DataFrame) -> bool:
    """Whether df is files, with rows and columns picked by fixed expressions: partitions are then the same in each job."""
    with contextlib.redirect_stdout(said := io.StringIO()):
        df.explain(extended=True)
    logical, _, physical = said.getvalue().partition("== Physical Plan ==")
    nodes = re.findall(r"^[\s:+\-|]*(?:\*\(\d+\) )?\*?([A-Za-z]+)", physical, re.MULTILINE)
    return bool(nodes) and set(nodes) <= _FIXED and not _MOVING.search(logical)


def spread(df: DataFrame, times: int) -> DataFrame:
    """The same rows over all cores, if they come in fewer partitions, as a small file with one row group does.

    Only for work that makes `times` rows of each, more than four: less is done before a shuffle would be.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if times > 4 and df.rdd.getNumPartitions() < cores else df
