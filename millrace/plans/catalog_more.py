"""Further registered queries: sources and sinks, previews and validation, small functions, names and standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import numbers as N
from millrace.functions import text as X
from millrace.operators import missing, outliers, reshape, rows, standardize, structure, types
from millrace.plans import repair, report
from millrace.plans.catalog import DIRTY_ORDERS_SQL, dirty_orders, one_row, query, read
from millrace.sources import readers, writers
from millrace.stable import shared_folder


def _rows(spark: SparkSession, schema: str, values: list[tuple]) -> DataFrame:
    """Several driver-side results as a table."""
    out = one_row(spark, schema, *values[0])
    for v in values[1:]:
        out = out.unionByName(one_row(spark, schema, *v))
    return out


# -- sources and sinks -----------------------------------------------------------------------------------------


@query("select * from nation")
def load_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.load(spark, f"{sf_dir}/nation.parquet")[0]


@query("select 'customer.parquet' as name, count(*) as n, 5 as n_columns, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' as names from customer")
def load_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = readers.load(spark, f"{sf_dir}/customer.parquet")[1]
    return one_row(spark, "name string, n bigint, n_columns int, names string", m.name, m.rows, m.columns, ",".join(m.names))


@query("select p_partkey::varchar as p_partkey, p_name || ', \"' || chr(10) || p_brand as shown, p_size::varchar as p_size from part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with quotes and line breaks in their texts, written as CSV and loaded again as text."""
    path = shared_folder(spark, "parts") + ".csv"
    df = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(', "\n'), "p_brand").alias("shown"), "p_size")
    writers.write_csv(df, path)
    return readers.load(spark, path, infer=False)[0]


@query("select 'unsupported extension' as what, true as refused union all select 'empty table', true union all select 'table', false")
def load_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "region")

    def refused(call: object) -> bool:
        try:
            call()
        except (readers.LoadError, readers.TableError):
            return True
        return False

    tests = [("unsupported extension", lambda: readers.load(spark, f"{sf_dir}/region.txt")), ("empty table", lambda: readers.validate(df.filter("false"))), ("table", lambda: readers.validate(df))]
    return _rows(spark, "what string, refused boolean", [(name, refused(call)) for name, call in tests])


@query("select n_nationkey, n_name from nation")
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.preview(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 50)


# -- rows, values and numbers ----------------------------------------------------------------------------------


@query("select o_orderkey, o_orderstatus from orders")
def remove_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.remove_columns(read(spark, sf_dir, "orders"), ["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])


@query("select * exclude r from (select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) - 1 as r from orders) where r not in (0, 5, 17, 1000)")
def remove_rows_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rows.remove_rows(df, [0, 5, 17, 1000], ["o_totalprice", "o_orderkey"])


@query(f"select o_orderkey, o_orderpriority, o_totalprice from {DIRTY_ORDERS_SQL} where o_orderpriority is not null and o_totalprice is not null")
def drop_rows_null_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.drop_rows_null_in(dirty_orders(spark, sf_dir), ["o_orderpriority", "o_totalprice"]).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("select p_partkey, p_name as shown from part")
def trim_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit(" \t "), "p_name", F.lit(" \n "))
    return read(spark, sf_dir, "part").select("p_partkey", X.ws_trim(padded).alias("shown"))


@query("select doc_id, trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')) as text from documents where regexp_full_match(text, '[\\x01-\\x7F\\s]*')")
def unicode_clean_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII texts need white space alone; what NFKC does is tested on literal rows."""
    df = read(spark, sf_dir, "documents").filter(F.col("text").rlike(r"^[\x01-\x7F]*$"))
    return df.select("doc_id", X.unicode_clean("text").alias("text"))


@query("select o_orderkey, case when o_orderkey % 4 != 0 then o_totalprice end as x from orders")
def simple_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice").cast("string")).otherwise("n/a").alias("x"))
    return types.simple_cast(df, "x", "numeric")


@query("select o_orderkey, case when b < 1024 then printf('%.1f B', b) when b < 1048576 then printf('%.1f KB', b / 1024) else printf('%.1f MB', b / 1048576) end as shown from (select o_orderkey, (o_orderkey % 5000)::double * 1000 + 1 as b from orders)")
def pretty_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", N.pretty_bytes((F.col("o_orderkey") % 5000).cast("double") * 1000 + 1).alias("shown"))


@query("select p_partkey, case when length(p_name) > 12 then substr(p_name, 1, 9) || '...' else p_name end as shown from part")
def shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", N.shortened("p_name", 12).alias("shown"))


@query("select 'o_orderkey' as column_name, 1.0::double as share union all select 'o_orderpriority', 0.0::double union all select 'o_orderstatus', 0.0::double")
def numeric_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders")
    return _rows(spark, "column_name string, share double", [(c, structure.numeric_share(df, c)) for c in ("o_orderkey", "o_orderpriority", "o_orderstatus")])


@query("select 'o_orderstatus' as column_name, round(max(n) / sum(n)::double, 9) as share, max(n) >= 0.4 * sum(n) as dominant from (select count(*) as n from orders group by o_orderstatus) union all select 'o_orderpriority', round(max(n) / sum(n)::double, 9), max(n) >= 0.4 * sum(n) from (select count(*) as n from orders group by o_orderpriority)")
def dominant_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.dominant_values(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], 0.4)
    return found.withColumn("share", F.round("share", 9))


@query("with q as (select quantile_cont(l_extendedprice, 0.25) as a, quantile_cont(l_extendedprice, 0.75) as b from lineitem) select round(a - 1.5 * (b - a), 4) as low, round(b + 1.5 * (b - a), 4) as high, (select count(*) from lineitem where l_extendedprice < a - 1.5 * (b - a) or l_extendedprice > b + 1.5 * (b - a)) as outliers from q")
def outlier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = outliers.handle_outliers(read(spark, sf_dir, "lineitem"), ["l_extendedprice"], action="report")[1]["l_extendedprice"]
    return one_row(spark, "low double, high double, outliers bigint", r["low"], r["high"], r["outliers"])


# -- positions at any size -------------------------------------------------------------------------------------

_GAPS_SQL = "(select event_id, case when event_id % 5 = 0 then value end as value from events)"


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("value"))


@query(f"select event_id, last_value(value ignore nulls) over (order by event_id rows between unbounded preceding and current row) as value from {_GAPS_SQL}")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.fill_directed(_gappy(spark, sf_dir), ["value"], ["event_id"])


@query(f"select event_id, first_value(value ignore nulls) over (order by event_id rows between current row and unbounded following) as value from {_GAPS_SQL}")
def carry_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.fill_directed(_gappy(spark, sf_dir), ["value"], ["event_id"], backward=True)


# -- names and standardisation ---------------------------------------------------------------------------------


@query("select n_nationkey as nation_id, n_name from nation")
def rename_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.rename_column(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", " nation_id ")


@query("select 'n_name' as name, '1,2' as places")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_name")
    return _rows(spark, "name string, places string", [(c, ",".join(map(str, at))) for c, at in reshape.duplicate_names(df).items()])


@query("select distinct c_mktsegment as value, 'Homes' as canonical, 1.0::double as confidence, 'user' as method, false as ambiguous from customer where c_mktsegment = 'HOUSEHOLD'")
def user_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value")).distinct()
    return standardize.user_mapping(values, {"Household": "Homes"})


@query("select distinct c_mktsegment as a, c_mktsegment || ' ltd' as b, true as apart from customer")
def distinct_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A qualifier keeps two names apart."""
    df = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("a"), F.concat("c_mktsegment", F.lit(" ltd")).alias("b")).distinct()
    return df.withColumn("apart", X.distinct_entities(F.col("a"), F.col("b")))


# -- repairs and reports ---------------------------------------------------------------------------------------


@query("select 'strip_whitespace' as operation, true as accepted, 1.0::double as confidence union all select 'drop_columns', false, 0.7::double union all select 'filter', true, 0.95::double")
def validate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unchanged table is accepted, one without most of its columns is not, one with 30 % fewer rows is with a warning."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    before = rows.null_counts(df)
    third = df.filter(F.pmod(F.xxhash64("o_orderkey"), F.lit(10)) >= 3)
    tests = [("strip_whitespace", df), ("drop_columns", df.select("o_orderkey")), ("filter", third)]
    found = [(name, repair.validate(before, after, name)[0]) for name, after in tests]
    return _rows(spark, "operation string, accepted boolean, confidence double", [(name, v.valid, v.confidence) for name, v in found])


@query("select count(*) filter (c_custkey % 3 = 0) as changed, count(*) filter (c_custkey % 7 = 0) as lost from customer")
def preview_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, before = F.col("c_custkey"), read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    after = before.withColumns({"c_name": F.when(k % 3 == 0, F.upper(F.concat("c_name", F.lit("x")))).otherwise(F.col("c_name")), "c_acctbal": F.when(k % 7 != 0, F.col("c_acctbal"))})
    found = repair.preview_changes(before, after, ["c_custkey"])
    return one_row(spark, "changed bigint, lost bigint", found["changed_cells"]["c_name"], found["new_nulls"]["c_acctbal"])


@query("select 0.9::double as none, 0.95::double as backed, 0.72::double as half, 'Medium' as level")
def evidence_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = read(spark, sf_dir, "orders").columns
    backed, bare = {"value": "12.5%", "column": "o_custkey"}, {"value": "many", "column": None}
    half = report.evidence_confidence([backed, bare], columns)
    return one_row(spark, "none double, backed double, half double, level string", report.evidence_confidence([], columns)[0], report.evidence_confidence([backed], columns)[0], half[0], half[1])
