import math

import pytest
from pyspark.sql import functions as F

from millrace.errors import RepairError
from millrace.functions import dates as D
from millrace.functions import names as N
from millrace.functions import numbers as U
from millrace.functions import text as X


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_white_space(spark):
    values = ["  a \t b\n", "　x ", None, "", "plain"]
    assert column(spark, values, X.strip_collapse("x")) == ["a b", "x", None, "", "plain"]
    assert column(spark, values, X.is_blank("x")) == [False, False, True, True, False]


def test_title_and_unicode(spark):
    assert column(spark, [" o'neil mc-donald ", "3rd floor", None], X.title_case("x")) == ["O'Neil Mc-Donald", "3Rd Floor", None]
    assert column(spark, ["ﬁne​  x", "ＡＢ", None, "a b"], X.unicode_clean("x")) == ["fine x", "AB", None, "a b"]


def test_keys(spark):
    assert column(spark, ["Credit-Card ", "N/A"], X.canonical_key("x")) == ["creditcard", "na"]
    assert column(spark, ["Card, Credit"], X.token_key("x")) == [["card", "credit"]]


def test_distinct_entities(spark):
    df = spark.createDataFrame([("ABC", "ABC Ltd"), ("Apple", "Apple Store"), ("Credit Card", "Card Credit"), ("USA", "US")], "a string, b string")
    assert [r[0] for r in df.select(X.distinct_entities(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


@pytest.mark.parametrize("meta", list(r".*+?[](){}^$|\\"))
def test_replacement_is_literal(spark, meta):
    assert column(spark, [f"a{meta}b", "ab"], X.replace_literal("x", meta, "-")) == ["a-b", "ab"]


def test_replacement_of_nothing():
    with pytest.raises(ValueError):
        X.replace_literal("x", "", "y")


def test_written_numbers(spark):
    said = {
        "one hundred": 100, "five hundred": 500, "one thousand two hundred fifty": 1250, "twenty five thousand": 25000, "twenty-five thousand": 25000, "two million": 2e6,
        "three point five": 3.5, "2 million": 2e6, "hundred": 100, "many reasons": None, "two people": None, "and": None, "12": None, None: None,
    }
    got = column(spark, list(said), U.written_number("x"))
    assert all(a is None if b is None else a is not None and math.isclose(a, b) for a, b in zip(got, said.values(), strict=True))


def test_formatted_numbers(spark):
    said = {
        "50K": 5e4, "1.5M": 1.5e6, "$50K": 5e4, "2B PKR": 2e9, "$1,234.56": 1234.56, "(789.10)": -789.1, "$50.00": 50, "(1,000.00)": -1000, "50-": -50, "-$50": -50, "+7": 7, "12.5%": 12.5,
        "1.234,56": 1234.56, "1,5": 1.5, "1,500": 1500, "Rs. 20": 20, "abc": None, "": None, None: None, "1.2.3": None,
    }
    got = column(spark, list(said), U.parse_number("x"))
    assert got == [None if v is None else float(v) for v in said.values()]


def test_explicit_numbers(spark):
    values = ["34", " N/A ", "$5", "ten", "blue", None, "10d", "1e3"]
    value, how = U.explicit_number("x")
    assert column(spark, values, how) == ["numeric_string", "missing", "formatted", "written", "unparseable", "missing", "formatted", "numeric_string"]
    assert column(spark, values, value)[:5] == [34.0, None, 5.0, 10.0, None]


def test_booleans(spark):
    assert column(spark, [" YES", "off", "t", "maybe", None], U.to_boolean("x")) == [True, False, True, None, None]


def dated(spark, values, dayfirst=False):
    return [(r[0]["status"], r[0]["convention"], str(r[0]["ts"])[:16] if r[0]["ts"] else None) for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x string").orderBy("i").select(D.classify_date("x", dayfirst)).collect()]


def test_dates(spark):
    got = dated(spark, ["2024-09-01", "20240901", "1st September 2024", "Sep 1, 2024 14:45", "01-Sep-24", "31/01/2024", "01/31/2024", "05/05/2025", "03/04/2024"])
    assert [g[1] for g in got] == ["ISO", "ISO", "TEXT_MONTH", "TEXT_MONTH", "TEXT_MONTH", "DMY", "MDY", "IDENTICAL_DM", "AMBIGUOUS"]
    assert [g[2][:10] for g in got[:5]] == ["2024-09-01"] * 5 and got[3][2].endswith("14:45")
    assert got[8] == ("AMBIGUOUS", "AMBIGUOUS", "2024-03-04 00:00") and dated(spark, ["03/04/2024"], True)[0][2] == "2024-04-03 00:00"


def test_odd_dates(spark):
    got = dated(spark, ["31/02/2025", "32/01/2025", "99/99/2025", "2025-15-40", "", None, "n/a", "now", "10:30", "2025", "2024-01-02T03:04:05+02:00", "1875-03-01"])
    assert [g[0] for g in got] == ["INVALID"] * 4 + ["MISSING"] * 3 + ["INVALID"] * 2 + ["UNAMBIGUOUS"] * 3
    assert got[10][2] == "2024-01-02 01:04" and got[11][2] == "1875-03-01 00:00"


def test_names():
    assert [N.snake_case(x) for x in ("camelCase", "HTTPServer Name", " a--b/c ", "§")] == ["camel_case", "http_server_name", "a_b_c", "column"]
    assert N.standard_name(" A  b! ", ["remove_whitespace", "replace_spaces", "remove_special_chars", "lowercase"]) == "a_b"
    assert N.unique(["a", "a", "a_1", "a"]) == ["a", "a_2", "a_1", "a_3"] and N.fixed(["", "Unnamed: 3", " x ", "x"]) == ["unnamed_0", "unnamed_1", "x", "x_1"]
    assert N.suggested("custNm") == "customer_name" and N.export_names(["Unnamed: 0", " n ", "nan"]) == ["col_1", "n", "col_3"]


def test_helpers(spark):
    assert column(spark, [512, 1536], U.pretty_bytes("x"), "long") == ["512.0 B", "1.5 KB"]
    assert column(spark, ["abcdefgh", "abc"], U.shortened("x", 6)) == ["abc...", "abc"]
    assert column(spark, [1.0, float("nan"), float("inf")], U.finite("x"), "double") == [1.0, None, None]


def test_errors_are_typed():
    assert issubclass(RepairError, Exception)


def test_ascii_text_does_not_go_through_python(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(X, "_nfkc", lambda c: sent.append(c) or c)
    assert column(spark, ["plain  text", "\u00e9", None, ""], X.unicode_clean("x")) == ["plain text", "\u00e9", None, ""]
    assert column(spark, ["plain  text", "\u00e9", None, ""], sent[0]) == [None, "\u00e9", None, None]


def test_composition_of_more_texts_than_a_slice(spark):
    texts = [f"e\u0301{i} \ufb01" if i % 3 else None for i in range(3 * X.TEXTS + 1)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").coalesce(1)
    assert [r[0] for r in df.orderBy("i").select(X.unicode_clean("x")).collect()] == [None if t is None else f"\u00e9{i} fi" for i, t in enumerate(texts)]
