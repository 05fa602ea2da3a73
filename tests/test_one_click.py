"""The one-click pipeline: what it has counted is not counted again, and cheap tests of cells find the same rows."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import duplicates, embedded, profile, rows, standardize, structure
from millrace.plans import pipeline


def orders(spark, n=60):
    k = F.col("key")
    return spark.range(n).select(F.col("id").alias("key")).select("key", F.when(k % 7 != 0, F.element_at(F.array(*map(F.lit, (" low", "middle ", "high"))), (k % 3 + 1).cast("int"))).alias("priority"), F.when(k % 5 != 0, k * 1.5).alias("price"), F.lit(None).cast("string").alias("nothing"))


def test_a_table_with_a_key_is_not_grouped_for_repeated_rows(spark, monkeypatch):
    def grouped(df):
        raise AssertionError("rows are grouped although a column has as many values as there are rows")

    df = orders(spark)
    for module in (profile, duplicates):
        monkeypatch.setattr(module, "duplicate_count", grouped)
    out = pipeline.run(df)
    assert [a.operation for a in out.audits if a.success and a.operation == "remove_duplicate_rows"] == []
    got = {r["key"]: (r["priority"], r["price"]) for r in out.df.collect()}
    assert len(got) == 60 and got[1] == ("middle", 1.5) and got[7] == ("high", 10.5) and got[5][1] is not None and "nothing" not in out.df.columns


def test_the_reshaped_table_is_computed_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)
    whole = []

    def remove_metadata_rows(df):
        def seen(batches):
            for b in batches:
                read.add(b.num_rows)
                yield b

        whole.append(df.count())
        return df.mapInArrow(seen, df.schema)

    monkeypatch.setattr(rows, "remove_metadata_rows", remove_metadata_rows)
    pipeline.run(orders(spark, 5000).repartition(4))
    assert whole == [5000]
    assert read.value < 2 * 5000 + 5000  # one whole pass, besides the first values of text columns


def test_repeated_rows_are_counted_again_if_reshaping_leaves_rows_out(spark):
    data = [("a", "x", 1.0)] * 3 + [("one", "two", None)] * 2 + [(f"b{i}", "y", float(i)) for i in range(20)]
    out = pipeline.run(spark.createDataFrame(data, "one string, two string, three double").coalesce(1))
    said = {a.operation: (a.rows_before, a.rows_after) for a in out.audits if a.success}
    assert said["remove_duplicate_rows"] == (23, 21)
    # The same without headers: what was inspected is known.
    out = pipeline.run(spark.createDataFrame([d for d in data if d[0] != "one"], "one string, two string, three double").coalesce(1))
    assert {a.operation: (a.rows_before, a.rows_after) for a in out.audits if a.success}["remove_duplicate_rows"] == (23, 21)


@pytest.mark.parametrize(("kind", "values", "repeated"), [("double", [0.0, -0.0, 1.0], 1), ("double", [1.0, 2.0, 2.0], 1), ("long", [1, 2, 3], 0), ("long", [1, 2, 2], 1), ("long", [1, None, None], 1), ("string", ["a", "b", None], 0), ("string", [], 0), ("double", [None, None], 1)])
def test_inspect_counts_repeated_and_empty_rows(spark, kind, values, repeated):
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    found = profile.inspect(df)
    assert found["duplicates"] == duplicates.duplicate_count(df) == repeated
    assert found["empty_rows"] == sum(v is None for v in values)


SPACE = re.compile(r"^\s+|\s+$")


def headers_left(names, data):
    """Rows that repeat at most a name, or have names in less than 60 % of their filled cells."""
    out = []
    for r in data:
        texts = [None if v is None else str(v) for v in r]
        filled = [t is not None and SPACE.sub("", t) != "" and t != "nan" for t in texts]
        same = sum(f and SPACE.sub("", t).lower() == c.strip().lower() for f, t, c in zip(filled, texts, names, strict=True))
        if not (same >= 2 and 10 * same >= 6 * sum(filled)):
            out.append(r)
    return out


def test_repeated_headers_of_any_names(spark):
    day = datetime.date(2020, 1, 2)
    names = ["Key", " City ", "nan", "7", "2020-01-02", "-5"]
    data = [
        (1, "city", "x", 7, day, 1), (7, " CITY　", "nan", 7, day, -5), (None, "city", " NaN ", None, None, None), (None, " ", "nan", 7, day, None), (5, "city of", "nan", 8, None, None),
        (None, " city", None, 7, None, None), (None, None, None, None, day, -5), (None, None, None, None, None, None), (2, "", "", 7, day, -5), (2, "cities", "na", 1, day, 3), (2, "cit", "nan ", 1, None, 3),
    ]
    df = spark.createDataFrame(data, "a long, b string, c string, d int, e date, f int").toDF(*names)
    got = sorted(map(tuple, rows.remove_repeated_headers(df).collect()), key=str)
    left = headers_left(names, data)
    assert got == sorted(left, key=str) and 0 < len(left) < len(data)


def test_numbers_and_times_are_not_searched_for_words(spark):
    df = spark.range(5).select("id", F.col("id").cast("double").alias("x"), F.current_timestamp().alias("t"), F.lit("v").alias("name"))
    assert rows.remove_repeated_headers(df) is df and rows.remove_metadata_rows(df) is df
    assert structure.gather(df).row["subtotal_rows"] == 0
    words = spark.createDataFrame([("  Total of all",), ("atotal",), ("Note: x",), (None,), ("",), ("\nsource",), ("plain",)], "a string")
    assert sorted(r[0] or "" for r in rows.remove_metadata_rows(words).collect()) == ["", "", "atotal", "plain"]


def test_cells_without_a_separator_are_not_searched_for_labels(spark):
    df = spark.createDataFrame([("Name: A | Age: 1",), ("Name: B | Age: 2",), (" 　",), (None,)], "x string")
    assert set(embedded.explicit_labels(df, "x")["labels"]) == {"Name", "Age"}
    plain = spark.createDataFrame([("abc",), ("​",), (" ",), (None,)], "x string")
    assert embedded.explicit_labels(plain, "x") is None
    found = plain.select(embedded._explicit(F.col("x"), ":").alias("l"))
    assert "slice" not in found._jdf.queryExecution().analyzed().toString().lower()


def test_proposals_of_few_and_many_values_are_the_same(spark, monkeypatch):
    values = ["New York", "new york", "NEW-YORK", "Los Angeles", "LA", "York New", "Boston", "Bostom", "Bos", "n/a", "CHI", "Chicago"]
    df = spark.createDataFrame([(v,) for i, v in enumerate(values) for _ in range(i + 1)], "c string")
    few = sorted(map(tuple, standardize.proposals(df, "c").collect()), key=str)
    monkeypatch.setattr(standardize, "VALUES", 2)
    assert few == sorted(map(tuple, standardize.proposals(df, "c").collect()), key=str) and len(few) > 5
