"""Positions, carried values and gaps of a million shuffled rows, in many range partitions."""

import pytest
from pyspark.sql import functions as F

from millrace import stable
from millrace.operators import missing, ranks, rows, structure
from millrace.plans import repair
from millrace.records import Action

N = 1_000_000


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "shuffled")
    at = F.col("id")
    spark.range(N).select(at.alias("k"), F.when(at % 7 == 3, at).alias("v"), F.timestamp_seconds(at + F.floor(at / 1000)).alias("t")).orderBy(F.xxhash64("k")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(params=["true", "false"])
def ranges(spark, request):
    keys = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": request.param}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_every_row_gets_its_position(shuffled, ranges):
    assert rows.with_row_id(shuffled, ["k"]).filter(F.col(rows.ROW_ID) != F.col("k")).count() == 0


def test_values_are_carried_across_ranges(shuffled, ranges):
    forward = F.when(F.col("k") < 3, None).otherwise(F.col("k") - F.pmod(F.col("k") - 3, F.lit(7)))
    last = N - 1 - (N - 1 - 3) % 7
    backward = F.when(F.col("k") <= last, F.col("k") + F.pmod(3 - F.col("k"), F.lit(7)))
    for back, want in ((False, forward), (True, backward)):
        got = missing.fill_directed(shuffled, ["v"], ["k"], back)
        assert got.filter(~F.col("v").eqNullSafe(want)).count() == 0 and got.count() == N


def test_gaps_across_ranges_count(shuffled, ranges):
    assert structure.gap_kinds(shuffled, "t") == (N - 1, N - 1, 2)


def test_percentiles_across_ranges(shuffled, ranges):
    got = ranks.quantiles(shuffled, {"k": [0.0, 0.25, 0.5, 1.0], "v": [0.5]})
    assert [got["k", p] for p in (0.0, 0.25, 0.5, 1.0)] == [0, 249_999.75, 499_999.5, N - 1] and got["v", 0.5] == 3 + 7 * ((N - 4) // 7) / 2


def test_percentiles_and_modes_of_few_values(spark):
    df = spark.createDataFrame([(1.0, "b"), (float("nan"), "a"), (4.0, "a"), (None, "b"), (float("inf"), None)], "x double, y string")
    got = ranks.quantiles(df, {"x": [0.5], "nothing": [0.5]}, {"nothing": F.lit(None)})
    assert got == {("x", 0.5): 2.5, ("nothing", 0.5): None}
    assert ranks.modes(df, ["y"]) == {"y": "a"} and ranks.modes(df.limit(0), ["y"]) == {"y": None}
    assert ranks.quantiles(df, {}) == {}


@pytest.fixture(scope="module")
def wide_file(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide") / "rows.parquet")
    df = spark.range(1_000_000).select("id", (F.col("id") % 9).alias("k"), F.concat(F.lit("some text of some length "), F.col("id")).alias("t"), (F.col("id") * 0.5).alias("x"))
    df.write.parquet(path)
    return path


@pytest.mark.parametrize("shape", ["scan", "repartition", "deduplicated", "joined"])
def test_positions_of_shuffled_rows_are_dense(spark, wide_file, shape):
    df = spark.read.parquet(wide_file)
    made = {
        "scan": df.filter("x >= 0").select("id", "t"), "repartition": df.repartition("id"), "deduplicated": df.dropDuplicates(["id"]),
        "joined": df.join(df.groupBy("k").count(), "k").join(df.select("id", F.col("x").alias("y")), "id"),
    }[shape]
    placed = rows.with_row_id(made)
    assert placed.columns == [*made.columns, rows.ROW_ID]
    got = placed.agg(F.count("*"), F.count_distinct(rows.ROW_ID), F.min(rows.ROW_ID), F.max(rows.ROW_ID), F.count_distinct("id")).first()
    assert tuple(got) == (1_000_000, 1_000_000, 0, 999_999, 1_000_000)
    assert rows.remove_rows(made, [0, 5, 999_999]).agg(F.count("*"), F.count_distinct("id")).first() == (999_997, 999_997)


def test_session_removes_just_the_rows_asked_for(spark, wide_file):
    result = repair.repair(spark.read.parquet(wide_file), [Action("remove_duplicate_rows", params={"subset": ["id"]}), Action("remove_rows", params={"rows": [0, 1, 2]})])
    assert result.success and result.df.count() == 999_997 and [a.rows_after for a in result.audits] == [1_000_000, 999_997]


def test_scans_are_told_from_shuffles(spark, wide_file):
    df = spark.read.parquet(wide_file)
    assert stable.scans_only(df) and stable.scans_only(df.filter("k > 3").select(F.upper("t").alias("t")))
    for other in (df.repartition(3), df.distinct(), df.orderBy("k"), df.limit(5), df.filter(F.rand() > 0.5), df.sample(0.5), df.filter(F.current_timestamp() > F.lit("2020-01-01").cast("timestamp")), df.join(df, "id")):
        assert not stable.scans_only(other)


def test_written_tables_keep_names_types_and_go_away(spark):
    df = spark.sql("select 1 as a, 'x' as `b c`, null as nothing, array(1.5d, null) as l, timestamp'2020-01-01 00:00:00' as t").select("*", F.lit(2).alias("a"))
    with stable.written(df) as back:
        assert back.dtypes == df.dtypes and back.collect() == df.collect()
        folder = back.inputFiles()[0]
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(folder).count()


def test_session_reads_its_source_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    source = spark.range(0, 1000, 1, 3).select("id", F.concat(F.lit(" a "), F.col("id") % 50).alias("t"), F.when(F.col("id") % 4 != 0, F.col("id") * 1.0).alias("x"), F.lit(1).alias("gone"))
    df = source.mapInArrow(count, source.schema)
    actions = [
        Action("strip_whitespace"), Action("fill_missing", ["x"], {"strategy": "median"}), Action("remove_columns", ["gone"]), Action("handle_outliers", ["x"]), Action("remove_duplicate_rows", params={"subset": ["t"]}), Action("remove_title_rows"),
    ]
    result = repair.repair(df, actions)
    assert read.value == 1000
    assert [(a.operation, a.success, a.rows_before, a.rows_after, a.columns_after) for a in result.audits] == [
        ("strip_whitespace", True, 1000, 1000, 4), ("fill_missing", True, 1000, 1000, 4), ("remove_columns", True, 1000, 1000, 3), ("handle_outliers", True, 1000, 1000, 3), ("remove_duplicate_rows", False, 1000, 50, 3), ("remove_title_rows", False, 1000, 1000, 3),
    ]
    assert result.df.columns == ["id", "t", "x"] and result.df.count() == 1000 and result.df.filter("x is null").isEmpty() and result.state == (1000, {"id": 0, "t": 0, "x": 0})


def test_rejection_in_the_middle_of_one_write(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 20, F.lit("a ")).alias("t"))
    result = repair.repair(df.select("*", F.lit(1).alias("u"), F.lit(2).alias("v")), [Action("rename_columns"), Action("remove_columns", ["t", "u", "v"]), Action("strip_whitespace")])
    assert [a.success for a in result.audits] == [True, False, True] and result.df.columns == ["id", "t", "u", "v"]
    assert result.df.select("t").distinct().count() == 2 and result.df.filter("t = 'a'").count() == 20


def test_values_that_fail_while_written_are_recorded(spark, monkeypatch):
    monkeypatch.setitem(repair.OPERATIONS, "rename_columns", lambda df, a: df.withColumn("n", F.raise_error(F.lit("no")).cast("int")))
    result = repair.repair(spark.range(5), [Action("strip_whitespace"), Action("rename_columns"), Action("drop_empty_rows")])
    assert [a.success for a in result.audits] == [True, False, True] and result.df.count() == 5


def test_sessions_undo_to_written_tables(spark):
    s = repair.Session(spark.range(10).select("id", F.concat(F.lit(" "), F.col("id")).alias("t")))
    s.apply([Action("strip_whitespace")])
    s.apply([Action("remove_rows", params={"rows": [0]})])
    assert s.current.count() == 9 and s.undo().count() == 10 and s.current.filter("t like ' %'").isEmpty() and s.undo().filter("t like ' %'").count() == 10


def test_positions_survive_working_copies(spark, tmp_path):
    """Files are read largest first, and small ones together: positions of a source's copy follow their names all the same."""
    df = spark.range(0, 10, 1, 1).union(spark.range(10, 4000, 1, 1)).union(spark.range(4000, 4300, 1, 2)).withColumn("t", F.concat(F.lit(" x"), F.col("id")))
    actions = [Action("remove_rows", params={"rows": [0, 1, 11, 4000]}), Action("strip_whitespace"), Action("remove_rows", params={"rows": [0, 4295], "order_by": ["id"]})]
    result = repair.repair(df, actions)
    assert result.success
    left = {r["id"] for r in result.df.select("id").collect()}
    assert set(range(4300)) - left == {0, 1, 11, 4000, 2, 4299}
    path = str(tmp_path / "files")
    df.write.parquet(path)
    placed = rows.with_row_id(spark.read.parquet(path).filter("id % 3 != 1").select("id"))
    assert [r["id"] for r in placed.orderBy(rows.ROW_ID).collect()] == [i for i in range(4300) if i % 3 != 1]
