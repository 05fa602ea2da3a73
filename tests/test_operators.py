import datetime as dt

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from millrace.errors import ExportError, LoadError, PlanError, ProviderError, RepairError, TableError
from millrace.operators import duplicates, eda, embedded, missing, outliers, profile, reshape, rows, standardize, structure, types
from millrace.plans import catalog, ml, pipeline, provider, repair, report
from millrace.records import Action, band
from millrace.sources import readers, writers
from millrace.streaming import rowwise


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


def values(df, c, order=None):
    return [r[0] for r in (df.orderBy(order) if order else df).select(c).collect()]


def test_rows_by_position(spark):
    df = spark.range(100).repartition(7).withColumnRenamed("id", "k")
    placed = rows.with_row_id(df, ["k"])
    assert placed.filter(F.col(rows.ROW_ID) != F.col("k")).isEmpty()
    assert rows.parse_ranges("0-2, 98-200, 5", 100) == [(0, 2), (98, 99), (5, 5)]
    assert rows.remove_rows(df, [0, 99], ["k"]).count() == 98
    for bad in ([], [100]):
        with pytest.raises(RepairError):
            rows.remove_rows(df, bad, ["k"])
    with pytest.raises(RepairError):
        rows.remove_columns(df, ["nope"])


def test_empty_rows_and_columns(spark):
    df = table(spark, [(1, None, None), (None, None, None), (3, "x", None)], "a long, b string, c string")
    assert rows.drop_empty_columns(df).columns == ["a", "b"] and rows.drop_empty_rows(df).count() == 2
    assert rows.remove_spacers(df).columns == ["a", "b"] and rows.empty_columns(df.limit(0)) == []


def test_headers_and_totals(spark):
    df = table(spark, [("A", "1"), ("product", "PRICE"), ("Grand total", "9"), (None, "2")], "Product string, Price string")
    assert rows.remove_repeated_headers(df).count() == 3 and rows.remove_metadata_rows(df).count() == 3 and rows.remove_subtotals(df).count() == 3


def test_fills(spark):
    df = table(spark, [(1, 1.0, None), (2, None, "x"), (3, 3.0, None), (4, None, "y"), (5, 9.0, None)], "k long, v double, s string")
    assert values(missing.fill_missing(df, ["v"], "median")[0], "v", "k") == [1.0, 3.0, 3.0, 3.0, 9.0]
    assert values(missing.fill_missing(df, ["s"], "ffill", order_by=["k"])[0], "s", "k") == [None, "x", "x", "y", "y"]
    assert values(missing.fill_missing(df.repartition(5), ["s"], "bfill", order_by=["k"])[0], "s", "k") == ["x", "x", "y", "y", None]
    assert "s" not in missing.fill_missing(df)[1] and missing.fill_value(df, "s", "mode") == "x"
    with pytest.raises(RepairError):
        missing.fill_value(df, "s", "median")


@pytest.mark.parametrize("method,factor", [("iqr", 1.5), ("zscore", 3.0), ("mad", 3.0), ("percentile", 0.02)])
def test_outliers(spark, method, factor):
    df = table(spark, [(float(x % 10),) for x in range(50)] + [(500.0,), (None,)], "v double")
    out, found = outliers.handle_outliers(df, ["v"], method, "cap", factor)
    assert out.agg(F.max("v")).first()[0] < 500 and out.filter("v is null").count() == 1 and found["v"]["outliers"] >= 1


def test_impossible(spark):
    df = table(spark, [(30.0, 10.0), (-1.0, 150.0), (40.0, 20.0), (float("inf"), 30.0), (20.0, 5.0)], "age double, pct double")
    assert {(x["column"], x["issue"]) for x in outliers.impossible_values(df)} == {("age", "infinite"), ("age", "negative"), ("pct", "over_100")}


def test_duplicates(spark):
    df = table(spark, [(1, "Ann "), (1, "Ann "), (2, "ann"), (2, None), (2, None)], "id long, name string")
    found = duplicates.detect_duplicates(df)
    assert found["exact"] == 2 and found["identifier_collisions"] == {"id": 2}
    assert duplicates.remove_duplicates(df, ["id"], "none").count() == 0 and duplicates.remove_duplicates(df, ["id"], "last", ["name"]).count() == 2


def test_types(spark):
    df = table(spark, [(f"00{i}", f"${i},000.50", f"2024-01-{i + 10}", "yes" if i % 2 else "no", "word " * 20) for i in range(1, 9)], "zip string, price string, day string, flag string, prose string")
    out, kinds, _ = types.auto_types(df)
    assert {c: k.type for c, k in kinds.items()} == {"zip": "identifier", "price": "currency", "day": "datetime", "flag": "boolean", "prose": "text"}
    assert dict(out.dtypes) == {"zip": "string", "price": "double", "day": "timestamp_ntz", "flag": "boolean", "prose": "string"}


def test_lossy_conversions_are_refused(spark):
    df = table(spark, [(x,) for x in ["1", "2", "3", "4", "5", "6", "7", "8", "9", "oops"] * 3], "n string")
    out, _, refused = types.auto_types(df)
    assert dict(out.dtypes)["n"] == "string" and "n" in refused
    converted, counts = types.to_numeric(df, ["n"])
    assert dict(converted.dtypes)["n"] == "bigint" and counts["n"]["unparseable"] == 3 and types.unparseable_cells(df, "n").count() == 3


def test_date_columns(spark):
    df = table(spark, [("03/04/2024",), ("25/12/2023",), ("bad",), (None,)], "d string")
    out, found = types.normalize_dates(df)
    assert found["d"]["convention"] == "DMY" and sorted(values(out, "d_display")) == ["", "", "03-04-24", "25-12-23"]


def test_standardize(spark):
    said = ["Australia"] * 5 + ["Austrailia", " australia", "Singapore", "Singapore", "Singapore", "n/a"]
    df = table(spark, [(i, v) for i, v in enumerate(said)], "k long, v string")
    assert set(values(standardize.standardize(df, ["v"], order_by=["k"])[0], "v")) == {"Australia", "Singapore", None}
    companies = table(spark, [(v,) for v in ["ABC", "ABC Ltd", "ABC Store"] * 3], "v string")
    assert set(values(standardize.standardize(companies, ["v"])[0], "v")) == {"ABC", "ABC Ltd", "ABC Store"}


def test_closure():
    rows_ = [{"value": a, "canonical": b, "confidence": 0.9, "ambiguous": False, "step": 0} for a, b in (("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"))]
    assert standardize.closed_map(rows_)["a"] == "c"


def test_packed_cells(spark):
    df = table(spark, [(1, "a | b", "1 | $2"), (2, "c", "3"), (3, "d | e | ", "4 | 5")], "id long, items string, qty string")
    found = reshape.detect_packed(df)
    assert found["delimiter"] == "|" and found["is_synchronized"]
    out = reshape.explode_packed(df)
    assert out.columns == ["id", "items", "qty"] and out.count() == 6 and dict(out.dtypes)["qty"] == "double"


def test_unpivot_and_headers(spark):
    wide = table(spark, [("2024-01-01", 1.0, None), ("2024-01-02", 2.0, 3.0)], "day string, a double, b double")
    out = reshape.unpivot(wide)
    assert out.count() == 3 and dict(out.dtypes)["day"] == "timestamp_ntz"
    two = table(spark, [(0, "", "Sales", "Cost"), (1, "N", "1", "2"), (2, "S", "3", "4")], "o long, r string, q string, u string")
    flat = reshape.flatten_headers(rows.with_row_id(two, ["o"]).drop("o").toDF("Region", "Q1", "Unnamed: 2", rows.ROW_ID))
    assert flat.columns == ["Region", "Q1 - Sales", "Q1 - Cost"] and flat.count() == 2


def test_column_names(spark):
    df = table(spark, [(0, None, "x"), (1, None, "y")], "a long, b string, c string").toDF("Unnamed: 0", "Unnamed: 1", "c")
    assert reshape.unnamed_columns(df) == {"Unnamed: 0": "index", "Unnamed: 1": "empty"}
    assert reshape.duplicate_names(df.toDF("a", "a", "b")) == {"a": [0, 1]} and reshape.resolve_duplicate_names(df.toDF("a", "a", "b")).columns == ["a", "a_2", "b"]
    with pytest.raises(RepairError):
        reshape.rename_column(df, "c", "Unnamed: 0")


def test_embedded_records(spark):
    df = table(spark, [("Name: Ann | Age: 3 | City: Rome",), ("Age: 4 | Name: Bob",), ("Name: Cy | Age: 5 | City: Oslo",), (None,)], "record string")
    found = embedded.discover_labels(df, "record")
    assert set(found["labels"]) == {"Name", "Age", "City"} and found["confidence"] >= 0.7
    out = embedded.rebuild(df)
    assert out.filter("Name = 'Bob'").first()["Age"] == 4.0 and out.count() == 4
    prose = table(spark, [("The delay is on the road.",), ("It was reported by a user.",), ("This is the end.",)], "t string")
    assert embedded.discover_labels(prose, "t")["labels"] == []


def test_value_labels(spark):
    label = lambda *v: embedded.value_label(table(spark, [(x,) for x in v], "v string"), "v")
    assert label("a@b.co", "c@d.org") == "email" and label("$5", "x") == "currency" and label("2024-01-01", "2024-02-02") == "date" and label("1", "2.5", "3") == "float"


def test_profile(spark):
    df = table(spark, [(10.0, "red"), (20.0, "red"), (30.0, "blue"), (40.0, None), (50.0, "red")], "scores double, colour string")
    p = profile.profile(df)
    s = p.column_profiles[0].statistics
    assert (s["mean"], s["median"], s["q1"], s["q3"]) == (30.0, 30.0, 20.0, 40.0) and p.column_profiles[1].top[0] == ("red", 3) and p.column_profiles[1].missing_pct == 20.0
    assert profile.validate_profile(p) == [] and profile.profile(df.limit(0)).status == "Critical"
    odd = profile.profile(table(spark, [(1.0,), (float("nan"),), (float("inf"),), (5.0,)], "a double"))
    assert odd.suspicious == ["a"] and "NaN" not in writers.to_json(odd)


def test_inspection(spark):
    df = table(spark, [(1.0, "x", None, "c"), (1.0, "x", None, "c"), (None, None, None, None)], "a double, b string, e string, k string")
    found = profile.inspect(df)
    assert found["duplicates"] == 1 and found["empty_rows"] == 1 and found["empty_columns"] == ["e"] and found["score"] < 1


def test_eda(spark):
    df = table(spark, [(float(i), 2.0 * i, "ab"[i % 2]) for i in range(6)], "x double, y double, c string")
    assert eda.summary(df)["correlations"][0]["correlation"] == 1.0
    assert eda.trend(df, "x", "y").first()["slope"] == pytest.approx(2.0) and sum(values(eda.histogram(df, "x", 3), "n")) == 6
    assert eda.distribution(df, "c")["top"] == [("a", 3), ("b", 3)]


def test_layouts(spark):
    series = table(spark, [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(i), 2.0) for i in range(30)], "day timestamp_ntz, v double, w double")
    assert structure.detect(series).layout == "TIME_SERIES" and structure.gap_kinds(series, "day") == (29, 29, 1)
    assert structure.detect(series.limit(0)).layout == "UNKNOWN"
    pivot = table(spark, [(c, 1.5, 2.5, 3.5, 4.5) for c in "abcd"], "region string, q_one double, q_two double, q_three double, q_four double")
    assert {e.layout: e.score for e in structure.detect(pivot).rules}["PIVOT_TABLE"] >= 0.6
    assert structure.plan(table(spark, [("a", 1), ("Total", 2)], "d string, v long"))["operation"] == "remove_subtotal_elements"


def test_repair_session(spark):
    s = repair.Session(table(spark, [(1, " a "), (1, " a "), (2, "b")], "k long, v string"))
    result = s.apply([Action("remove_duplicate_rows"), Action("strip_whitespace")])
    assert result.success and s.current.count() == 2 and sorted(values(s.current, "v")) == ["a", "b"] and s.undo().count() == 3
    assert s.history.summary() == {"total": 2, "applied": 2, "rejected": 0} and s.history.table(s.current).count() == 2
    assert not repair.repair(s.original, [Action("remove_title_rows")]).success
    assert len(repair.DECLARED) == 27


def test_losses_are_rejected(spark):
    df = table(spark, [(i,) for i in range(10)], "k long")
    result = repair.repair(df, [Action("remove_rows", params={"rows": list(range(8)), "order_by": ["k"]})])
    assert not result.success and result.df.count() == 10


def test_replace_keeps_numbers(spark):
    out = repair.replace_values(table(spark, [(100.0, "a@b"), (205.5, None)], "n double, t string"), ["n", "t"], "0", "5")
    assert dict(out.dtypes)["n"] == "double" and values(out, "n")[1] == 255.5


def test_pipeline(spark):
    data = [(i, "x" if i % 3 else "y", float(i), None, 1.0 if i == 0 else None) for i in range(12)] + [(11, "x", 11.0, None, None)]
    df = table(spark, data, "u long, category string, v double, e string, h double").toDF("Unnamed: 0", "category", "num_val", "all_null", "high_null")
    out = pipeline.run(df)
    assert out.df.count() == 12 and "all_null" not in out.df.columns and out.after >= out.before
    assert repair.detect_repairs(df)


def test_cleaning(spark):
    df = table(spark, [(1, None, " a ", 7), (1, None, " a ", 7), (2, 2.0, "b", 7), (3, 4.0, "c", 7)], "id long, v double, t string, k long")
    steps = pipeline.cleaning_plan(df)
    out, found = pipeline.clean(df, [*steps, {"operation": "nope"}, {"operation": "strip_whitespace", "column": "t"}])
    assert out.count() == 3 and "k" not in out.columns and found["missing"][1] == 0 and found["log"][-2]["done"] is False


def test_provider(spark):
    assert provider.parse_json('<think>x</think> so: {"a": 1} done') == {"a": 1} and provider.parse_json("```json\n[1]\n```") == [1]
    with pytest.raises(PlanError):
        provider.parse_json("none")
    calls = []

    def call(model):
        calls.append(model)
        raise RuntimeError

    with pytest.raises(ProviderError):
        provider.with_retries(call, "a", "b", sleep=lambda s: None)
    assert calls == ["a", "a", "b"] and band(0.9) == "HIGH"
    df = table(spark, [(1,)], "k long")
    good, warnings = provider.checked_actions([{"operation": "fill_missing", "columns": ["k", "z"], "confidence": 7}, {"operation": "hack"}], df)
    assert good[0].columns == ["k"] and good[0].confidence == 1.0 and len(warnings) == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a\nb"\n2,c\n')
    df, meta = readers.load(spark, str(tmp_path / "a.csv"), str(tmp_path / "raw"))
    assert meta.rows == 2 and dict(df.dtypes)["x"] == "int" and len(list((tmp_path / "raw").glob("*_a.csv"))) == 1
    (tmp_path / "b.csv").write_text("x,y\n")
    with pytest.raises(TableError):
        readers.load(spark, str(tmp_path / "b.csv"))
    with pytest.raises(LoadError):
        readers.load(spark, "x.txt")
    writers.write_csv(df, str(tmp_path / "out"))
    assert any((tmp_path / "out").glob("part-*.csv"))
    with pytest.raises(ExportError):
        writers.guard(df.limit(0), df)


def test_sanitize():
    loop: dict = {}
    loop["self"] = loop
    assert writers.sanitize({"a": float("nan"), "b": {3, 1}, "c": dt.date(2024, 1, 2), "d": b"x"}) == {"a": None, "b": [1, 3], "c": "2024-01-02", "d": "x"}
    assert writers.sanitize(loop) == {"self": "<cycle>"}


def test_models(spark):
    df = table(spark, [(i, f"u{i}", float(i % 7), "ab"[i % 2], f"2024-01-{i % 28 + 1:02d}", int(i % 7 > 3)) for i in range(120)], "k long, user_id string, age double, plan string, joined string, churn long")
    roles = ml.feature_roles(df.drop("k"), "churn")
    assert roles["dropped"] == {"user_id": "identifier"} and roles["datetime"] == ["joined"] and roles["numeric"] == ["age"] and roles["categorical"] == ["plan"]
    t = ml.train(df, "churn", "k", trees=3, folds=2, only=["decision_tree"])
    assert t.task == "binary_classification" and t.leaderboard[0].metrics["accuracy"] > 0.9 and len(t.leaderboard[0].cross_validation) == 2
    assert "age" in t.importances[0][0] and "decision_tree" in report.markdown(df, "x", t) and ml.readiness(df, "churn")["ready"]
    assert not ml.target_quality(df.limit(5), "churn")["valid"] and ml.suggest_targets(df)[0] == "churn"


def test_automl_leaderboard_fits_all_candidates(spark, tmp_path, monkeypatch):
    rows = [(i, f"n{i % 5}", f"b{i % 3}", f"t{i % 4}", i * 7 % 50, 10.0 * abs(i * 7 % 50 - 25) + 100 * (i % 4 == 1)) for i in range(300)]
    table(spark, rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    train, seen = ml.train, []

    def smaller(df, target, key, **options):
        assert not options  # all candidates, 100 trees, 5 folds
        seen.append((df.columns, train(df, target, key, trees=4, folds=2)))
        return seen[-1][1]

    monkeypatch.setattr(ml, "train", smaller)
    got = {r["model"]: r["value"] for r in catalog.automl_leaderboard(spark, str(tmp_path)).collect()}
    columns, trained = seen[0]
    assert {"p_name", "p_type", "p_brand", "p_size"} < set(columns)
    assert set(got) == {"baseline", "ridge", "random_forest", "gradient_boosting", "histogram_boosting", "decision_tree"}
    assert all(not c.error and len(c.cross_validation) == (0 if c.baseline else 2) for c in trained.leaderboard)
    # The price is a V over the size: lines can't follow it, trees can.
    assert got["ridge"] < 0.6 < 0.8 < min(got[k] for k in ("gradient_boosting", "histogram_boosting", "decision_tree")) and got["baseline"] < 0.1 and got["random_forest"] > got["ridge"]


def test_many_skewed_classes_are_stratified_and_weighted(spark):
    df = table(spark, [(i, float(i % 25 if i < 100 else 0), f"c{i % 25 if i < 100 else 0}") for i in range(160)], "k long, x double, kind string")
    t = ml.train(df, "kind", "k", folds=0, only=["decision_tree"])
    assert t.task == "multiclass_classification" and t.primary == "f1" and any("imbalanced" in w for w in t.warnings)
    assert sum(ml.target_quality(df, "kind")["classes"].values()) == 160
    parted = ml.split(df, "k", "kind").filter("is_test")
    assert parted.select("kind").distinct().count() == 25 and t.model.transform(df.withColumn("label", F.lit(0.0))).count() == 160
    # Stratified, the test rows have each class once at least: the baseline is right in 13 of 37.
    assert abs(next(c for c in t.leaderboard if c.baseline).metrics["accuracy"] - 13 / 37) < 1e-9


def test_missing_categories_are_the_mode_of_the_fitted_rows(spark):
    df = table(spark, [(1, "b'", 0.0), (2, "b'", 0.0), (3, "a", 0.0), (4, None, 0.0)], "k long, c string, label double")
    roles = {"numeric": [], "categorical": ["c"], "datetime": [], "text": []}
    stages, _ = ml.prepare(ml._numbers(df, roles), roles)
    model = Pipeline(stages=stages).fit(ml._numbers(df, roles))
    got = {r["k"]: r["features"].toArray().tolist() for r in model.transform(ml._numbers(df.union(table(spark, [(5, "new", 0.0)], "k long, c string, label double")), roles)).collect()}
    assert got[4][:2] == got[1][:2] == [1.0, 0.0] and got[3][:2] == [0.0, 1.0] and got[5][:2] == [0.0, 0.0]


def test_multiclass_roc_auc_is_weighted_one_against_the_rest(spark):
    rows = [(0.0, [0.6, 0.3, 0.1]), (0.0, [0.3, 0.4, 0.3]), (1.0, [0.4, 0.5, 0.1]), (1.0, [0.2, 0.3, 0.5]), (1.0, [0.1, 0.8, 0.1]), (2.0, [0.2, 0.2, 0.6])]
    scored = spark.createDataFrame([(y, float(max(range(3), key=p.__getitem__)), Vectors.dense(p), Vectors.dense(p)) for y, p in rows], ["label", "prediction", "rawPrediction", "probability"])

    def auc(k):
        pairs = [(p[k], q[k]) for y, p in rows if y == k for z, q in rows if z != k]
        return sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)

    expected = sum(n * auc(k) for k, n in ((0, 2), (1, 3), (2, 1))) / 6
    assert abs(ml.evaluate(scored, "multiclass_classification")["roc_auc"] - expected) < 1e-9


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("c", F.col("id") % 3)
    a, b = (ml.split(df.repartition(n), "id", "c").filter("is_test") for n in (1, 8))
    assert set(values(a, "id")) == set(values(b, "id")) and a.count() == 102  # a fifth of 167, 167 and 166, rounded up


def test_streams(spark, tmp_path):
    df = table(spark, [(dt.datetime(2024, 1, 1), " a ", "$5"), (dt.datetime(2024, 1, 1), " a ", "$5")], "ts timestamp, t string, n string")
    df.write.parquet(str(tmp_path / "in"))
    stream = rowwise.repair_stream(rowwise.read_folder(spark, str(tmp_path / "in"), df.schema), ("t",), ("n",))
    q = rowwise.deduplicate_stream(stream, ["t"], "ts").writeStream.format("memory").queryName("streamed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r)[1:] for r in spark.table("streamed").collect()] == [("a", 5.0)]


def test_training_rows_are_dealt_by_their_number(spark, monkeypatch):
    """Boosting runs hundreds of jobs over the rows: as many tasks as shuffles have would be most of the time."""
    parts, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(ml, "cross_validate", lambda placed, *_: float(parts.append(placed.rdd.getNumPartitions()) or 0))
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 90 * 1.5).alias("y"))
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        ml.train(df, "y", "id", folds=2, only=["ridge"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert parts == [1, 1]


def test_layout_facts_keep_distinct_values_apart_from_sketches(spark, monkeypatch):
    df, said = spark.createDataFrame([(1, 2.0, "a"), (2, 2.0, "a"), (2, None, None)], "k int, x double, t string"), []
    agg = type(df).agg

    def noted(self, *exprs):
        out = agg(self, *exprs)
        said.append(out._jdf.queryExecution().analyzed().toString().lower())
        return out

    monkeypatch.setattr(type(df), "agg", noted)
    row = structure.gather(df).row
    assert (row["d|k"], row["d|x"], row["d|t"], row["rows"]) == (2, 1, 1, 3)
    assert [x for x in said if "count(distinct" in x] and not [x for x in said if "approx_count_distinct" in x and "count(distinct" in x]


def test_texts_without_frequent_tokens_need_no_positions(spark, monkeypatch):
    records = [(f"name {x} city {y}",) for x, y in [("ann", "bonn"), ("bob", "rome"), ("cy", "oslo"), ("name name", "bern")]]
    found = embedded.implicit_labels(spark.createDataFrame(records, "x string"), "x")
    assert found["labels"] == ["name", "city"] and found["counts"] == {"name": 4, "city": 4}
    monkeypatch.setattr(embedded, "with_row_id", lambda *_: pytest.fail("positions of all rows"))
    assert embedded.implicit_labels(spark.createDataFrame([("N",), ("O",), ("R",)], "x string"), "x") is None
