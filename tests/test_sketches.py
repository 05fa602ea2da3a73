"""Percentiles from sketches, near keys by pieces, folds by class, details of columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import profile, ranks, standardize
from millrace.plans import ml, provider


@pytest.mark.parametrize(("few", "sketch"), [(100_000, 2_000), (60, 20), (1, 8)])
def test_quantiles_are_exact(spark, monkeypatch, few, sketch):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "SKETCH", sketch)
    rng = random.Random(few)
    data = [(rng.gauss(0, 1), float(i), None if i % 3 else float(i % 2), rng.choice([0.0, 1.0, 1.0, rng.random()]), float("nan") if i % 5 == 0 else float("inf") if i % 5 == 1 else i * 2.0, None) for i in range(2000)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double, f double")
    probs = [0.0, 0.1, 0.5, 0.50013, 0.999, 1.0]
    got = ranks.quantiles(df, {c: probs for c in "abcdef"})
    for i, c in enumerate("abcdef"):
        values = [r[i] for r in data if r[i] is not None and np.isfinite(r[i])]
        for p in probs:
            assert got[c, p] == (pytest.approx(np.quantile(values, p), abs=1e-12) if values else None)
    assert ranks.quantiles(df, {}) == {} and ranks.quantiles(df.limit(0), {"a": [0.5]}) == {("a", 0.5): None}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, word, times):
    for _ in range(times):
        i, kind = rng.randrange(len(word) + 1), rng.choice("ids")
        word = word[:i] + ("" if kind == "d" else rng.choice("abc")) + word[i + (kind != "i") :]
    return word


def test_near_keys_find_all_pairs(spark):
    rng, keys = random.Random(4), set()
    for length in [*range(4, 11), *range(22, 31), 70]:
        base = "".join(rng.choices("abcdefgh", k=length))
        keys |= {base, *(edited(rng, base, k) for k in (1, 1, 2, 2, 2, 3))}
    keys = sorted(k for k in keys if len(k) >= 4)
    got = {(r["x"], r["y"]) for r in standardize.near_keys(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    near = {(a, b): distance(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]}
    assert all(near[p] <= 2 for p in got)
    assert {p for p, d in near.items() if d == 1 or (d == 2 and max(map(len, p)) >= 8)} <= got


def test_large_tables_get_the_same_typos(spark, monkeypatch):
    rng = random.Random(6)
    bases = ["".join(rng.choices("abcdefgh", k=rng.choice([5, 8, 12, 28]))) for _ in range(25)]
    words = sorted({w for b in bases for w in (b, edited(rng, b, 1), edited(rng, b, 2))})
    values = spark.createDataFrame([(w, rng.choice([1, 4, 20]), i) for i, w in enumerate(words)], "value string, n long, first long")
    canon = standardize.canonicals(values).persist()
    small = standardize.fuzzy_typos(canon).collect()
    monkeypatch.setattr(standardize, "VALUES", 3)
    assert small and sorted(standardize.fuzzy_typos(canon).collect()) == sorted(small)


def test_folds_differ_by_one_row_in_each_class(spark):
    df = spark.range(1013).select("id", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 7 == 0, None).otherwise("often").alias("c"))
    dealt = ml.assign_folds(df, "id", "c", 5)
    sizes = {}
    for r in dealt.groupBy("c", "fold").count().collect():
        sizes.setdefault(r["c"], []).append(r["count"])
    assert dealt.count() == 1013 and all(len(v) == 5 and max(v) - min(v) <= 1 for v in sizes.values())
    again = ml.assign_folds(df.repartition(3, "c"), "id", "c", 5)
    assert dealt.exceptAll(again.select(*dealt.columns)).isEmpty()


def test_column_details(spark):
    data = [(i, None if i % 4 == 0 else f"v{i % 7}", "one", None) for i in range(20)]
    df = spark.createDataFrame(data, "k long, t string, same string, nothing string")
    for got in (profile.column_details(df, ["k"]), profile.column_details(df.coalesce(1))):
        by = {r["column_name"]: r for r in got.collect()}
        assert list(by["t"]["samples"]) == ["v1", "v2", "v3", "v5", "v6"] and by["k"]["samples"] == ["0", "1", "2", "3", "4"] and by["nothing"]["samples"] == []
        assert (by["t"]["non_null_count"], by["t"]["null_count"], by["t"]["null_share"], by["t"]["unique_count"]) == (15, 5, 0.25, 7)
        assert by["k"]["is_potential_id"] and by["same"]["is_constant"] and not by["nothing"]["is_constant"] and not by["t"]["is_potential_id"]
    empty = profile.column_details(df.limit(0)).collect()
    assert len(empty) == 4 and all(r["non_null_count"] == 0 and r["samples"] == [] and not r["is_potential_id"] for r in empty)


def test_checked_groups_merge_and_reject(spark):
    values = spark.createDataFrame([("Red", 9), ("red ", 1), ("Redd", 2), ("North Shop", 5), ("South Shop", 6), ("Blue", 3)], "value string, n long")
    proposed = spark.createDataFrame(
        [("Red", "red ", 0.9), ("Redd", "Redd", 0.7), ("Red", "Redd", 0.8), ("North Shop", "South Shop", 0.9), ("Blue", "Bleu", 0.9), ("Blue", "Blue", 0.6)], "canonical string, value string, confidence double"
    )
    got = {r["canonical"]: (list(r["members"]), r["confidence"], r["accepted"]) for r in standardize.validated_groups(values, proposed).collect()}
    assert got["Red"] == (["Redd", "red "], 0.7, True) and got["Blue"] == (["Blue"], 0.6, True)
    assert got["North Shop"][2] is False and len(got) == 3
    assert standardize.validated_groups(values, proposed.limit(0)).count() == 0


def test_model_plans(spark):
    df = spark.createDataFrame([(i, float(i), "a", f"s{i % 3}", i * 2.5) for i in range(40)], "k long, price double, one string, kind string, x double")
    base = ml.plan(df)
    assert (base.target, base.task, base.metric, base.features, base.excluded["one"], base.confidence) == ("price", "regression", "r2", ["k", "kind", "x"], "has one value at most", 0.80)
    said = ml.plan(df, propose=lambda p: {"target": "kind", "features": ["x", "ghost", "kind"], "task": "multiclass_classification", "metric": "f1"})
    assert (said.target, said.features, said.metric, said.confidence) == ("kind", ["x"], "f1", 0.90)

    def fails(p):
        raise RuntimeError("no answer")

    assert ml.plan(df, propose=fails) == base and ml.plan(df, propose=lambda p: {"features": ["ghost"]}) == base and ml.plan(df, "x").target == "x"


def test_compact_profiles_hold_columns(spark):
    df = spark.createDataFrame([(i, f"${i}.50", None) for i in range(30)], "k long, price string, none string")
    p = provider.compact_profile(df)
    by = {c["column"]: c for c in p["column_profiles"]}
    assert p["rows"] == 30 and by["k"]["possible_id"] and by["none"]["null_percentage"] == 100.0 and len(by["price"]["sample_values"]) == 3 and by["price"]["semantic_type"] == "currency"
    assert provider.compact_profile(df.limit(0))["rows"] == 0
