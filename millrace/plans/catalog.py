"""The catalog of registered queries and their DuckDB oracles.

The tables are clean, so most queries make them dirty first: the same deterministic expression is written in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import numbers as N
from millrace.functions import text as X
from millrace.operators import duplicates, eda, embedded, missing, outliers, profile, reshape, rows, standardize, structure, types
from millrace.plans import ml, pipeline, repair
from millrace.records import Action
from millrace.sources import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def one_row(spark: SparkSession, schema: str, *values: object) -> DataFrame:
    """A driver-side result as a table: SQL literals, no Python on the executors."""
    names = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    return spark.range(1).select(*[F.lit(v).cast(t).alias(n) for (n, t), v in zip(names, values, strict=True)])


# -- dirt ------------------------------------------------------------------------------------------------------

DIRTY_ORDERS_SQL = """(select o_orderkey, case when o_orderkey % 7 = 0 then null else o_orderpriority end as o_orderpriority,
  case when o_orderkey % 5 = 0 then null else o_totalprice end as o_totalprice, case when o_orderkey % 3 = 0 then null else o_orderdate end as o_orderdate,
  o_orderstatus, 'x' as constant, cast(null as varchar) as nothing, case when o_orderkey % 10 = 0 then 1.0::double end as sparse from orders)"""


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 3 != 0, F.col("o_orderdate")).alias("o_orderdate"), "o_orderstatus", F.lit("x").alias("constant"), F.lit(None).cast("string").alias("nothing"), F.when(k % 10 == 0, F.lit(1.0)).alias("sparse"),
    )


DOUBLED_SQL = "(select c_custkey, c_name, c_mktsegment from customer union all select c_custkey, c_name, c_mktsegment from customer where c_custkey % 10 = 0)"


def doubled_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.unionByName(c.filter("c_custkey % 10 = 0"))


# -- profile ---------------------------------------------------------------------------------------------------

_LINEITEM = {"l_orderkey": 1, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 1, "l_extendedprice": 1, "l_discount": 1, "l_tax": 1, "l_returnflag": 0, "l_linestatus": 0, "l_shipdate": 2}


def _profile_sql(table: str, columns: dict[str, int]) -> str:
    def one(c: str, kind: int) -> str:
        stats = [f"min({c})::double", f"max({c})::double", f"round(avg({c}), 4)", f"round(median({c})::double, 4)", f"round(stddev_samp({c}), 4)", f"round(quantile_cont({c}, 0.25)::double, 4)", f"round(quantile_cont({c}, 0.75)::double, 4)"]
        names = ["min_value", "max_value", "mean_value", "median_value", "std_value", "q1", "q3"]
        cells = ", ".join(f"{s if kind == 1 else 'null::double'} as {n}" for s, n in zip(stats, names, strict=True))
        return f"select '{c}' as column_name, '{('text', 'numeric', 'datetime')[kind]}' as kind, count(*) as row_count, count(*) - count({c}) as missing_count, {cells}, count(distinct {c}) as unique_count from {table}"

    return " union all ".join(one(c, k) for c, k in columns.items())


@query(_profile_sql("lineitem", _LINEITEM))
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_table(read(spark, sf_dir, "lineitem").select(*_LINEITEM))


@query(_profile_sql("orders", {"o_orderkey": 1, "o_custkey": 1, "o_totalprice": 1}))
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_table(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))


@query("""select * from (select 'o_orderpriority' as column_name, o_orderpriority as value, count(*) as n, row_number() over (order by count(*) desc, o_orderpriority)::int as rank from orders group by 2
union all select 'o_orderstatus', o_orderstatus, count(*), row_number() over (order by count(*) desc, o_orderstatus)::int from orders group by 2) where rank <= 5""")
def profile_categorical_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = profile.frequencies(read(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])
    return profile.top_values(freq, 5).select(F.col("column").alias("column_name"), "value", "n", "rank")


@query(" union all ".join(f"select '{c}' as column_name, count(*) - count({c}) as missing, round(100.0 * (count(*) - count({c})) / count(*), 2)::double as pct from {DIRTY_ORDERS_SQL}" for c in ("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate", "o_orderstatus", "constant", "nothing", "sparse")))
def missing_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dirty_orders(spark, sf_dir)
    cells = [F.struct(F.lit(c).alias("column_name"), (F.count(F.lit(1)) - F.count(c)).alias("missing"), F.round(100.0 * (F.count(F.lit(1)) - F.count(c)) / F.count(F.lit(1)), 2).alias("pct")) for c in df.columns]
    return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@query(f"select count(*) - (select count(*) from (select distinct * from {DOUBLED_SQL})) as duplicates, count(*) as row_count from {DOUBLED_SQL}")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = doubled_customers(spark, sf_dir)
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum(F.col("n") - 1).alias("duplicates"), F.sum("n").alias("row_count"))


@query("select count(*) as empty_rows from (select case when o_orderkey % 4 = 0 then null else o_orderstatus end as a, case when o_orderkey % 6 = 0 then null else o_totalprice end as b from orders) where a is null and b is null")
def empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    df = read(spark, sf_dir, "orders").select(F.when(k % 4 != 0, F.col("o_orderstatus")).alias("a"), F.when(k % 6 != 0, F.col("o_totalprice")).alias("b"))
    return df.agg(F.count(F.when(F.col("a").isNull() & F.col("b").isNull(), 1)).alias("empty_rows"))


@query(f"""with d as (select count(*) as n, 8 * count(*) as cells, 8 * count(*) - count(o_orderkey) - count(o_orderpriority) - count(o_totalprice) - count(o_orderdate) - count(o_orderstatus) - count(constant) - count(nothing) - count(sparse) as missing from {DIRTY_ORDERS_SQL})
select missing::bigint as missing, round(1 - least(missing / cells * 0.5, 0.3) - 0.03 - 0.03, 4)::double as score from d""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties here: missing cells, one empty column, and three constant columns."""
    found = profile.inspect(dirty_orders(spark, sf_dir))
    return one_row(spark, "missing bigint, score double", found["missing_cells"], round(found["score"], 4))


@query(f"""with d as (select count(*) as n, count(*) * 8 - (count(o_orderkey) + count(o_orderpriority) + count(o_totalprice) + count(o_orderdate) + count(o_orderstatus) + count(constant) + count(nothing) + count(sparse)) as missing from {DIRTY_ORDERS_SQL})
select n as row_count, 0::bigint as duplicates, round(greatest(0, 100 - least(35, least(30, 1.5 * 100 * missing / (n * 8)) + least(15, 5 * 2)) - least(20, 5 * 3)), 1)::double as score from d""")
def profile_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.profile(dirty_orders(spark, sf_dir))
    return one_row(spark, "row_count bigint, duplicates bigint, score double", p.rows, p.duplicates, p.score)


@query(" union all ".join(f"select '{c}' as column_name, count({c}) as n, round(avg({c}), 4) as mean, round(median({c})::double, 4) as median, round(stddev_samp({c}), 4) as std, min({c})::double as min, max({c})::double as max, round(skewness({c}), 4) + 0.0::double as skewness from part" for c in ("p_partkey", "p_size", "p_retailprice")))
def numeric_stats_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.numeric_statistics(read(spark, sf_dir, "part"), ["p_partkey", "p_size", "p_retailprice"])
    return found.withColumns({c: F.round(c, 4) + 0.0 for c in ("mean", "median", "std", "skewness")})


@query(" union all ".join(f"select '{c}' as column_name, sum(n)::bigint as n, count(*) as distinct_values, arg_max(v, (n, -r)) as top, max(n) as top_count from (select {c} as v, count(*) as n, row_number() over (order by {c}) as r from customer group by {c})" for c in ("c_mktsegment", "c_name")))
def categorical_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.categorical_statistics(read(spark, sf_dir, "customer"), ["c_mktsegment", "c_name"])


@query("select 'ts' as column_name, count(ts) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last from events")
def datetime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.datetime_statistics(read(spark, sf_dir, "events"), ["ts"])
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]


@query("select * from (" + " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, round(corr({a}, {b}), 3) + 0.0::double as correlation from lineitem" for a, b in _PAIRS) + ") where correlation is not null")
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.correlations(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("select 'a' as feature_a, 'b' as feature_b, round(corr(l_quantity, l_quantity * 10000 + l_extendedprice), 3) as correlation, 'strong' as strength from lineitem")
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_quantity") * 10000 + F.col("l_extendedprice")).alias("b"))
    return eda.strong_pairs(eda.correlations(df))


@query("select p_type as value, count(*) as n, row_number() over (order by count(*) desc, p_type)::int as rank from part group by 1 order by 3 limit 20")
def distribution_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.top_k(read(spark, sf_dir, "part"), "p_type", 20)


@query("select least(floor((l_quantity - 0) / 5), 9)::int as bin, (least(floor(l_quantity / 5), 9) * 5)::double as low, ((least(floor(l_quantity / 5), 9) + 1) * 5)::double as high, count(*) as n from lineitem group by 1, 2, 3")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.histogram(read(spark, sf_dir, "lineitem"), "l_quantity", 10, (0.0, 50.0))


@query("select min(l_quantity) as low, quantile_cont(l_quantity, 0.25) as q1, median(l_quantity) as median, quantile_cont(l_quantity, 0.75) as q3, max(l_quantity) as high from lineitem")
def box_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.box(read(spark, sf_dir, "lineitem"), "l_quantity")


@query("select count(*) as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept from lineitem")
def ols_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.trend(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 2)})


_IMPOSSIBLE_SQL = "(select case when o_orderkey % 50 = 0 then -1.0 else 30.0 + o_orderkey % 40 end as age, case when o_orderkey % 40 = 0 then 150.0 else (o_orderkey % 90)::double end as discount from orders)"


@query(f"select 'age' as column_name, 'negative' as issue, count(*) filter (age < 0) as n from {_IMPOSSIBLE_SQL} union all select 'discount', 'over_100', count(*) filter (discount > 100) from {_IMPOSSIBLE_SQL}")
def impossible_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    df = read(spark, sf_dir, "orders").select(F.when(k % 50 == 0, -1.0).otherwise(30.0 + k % 40).alias("age"), F.when(k % 40 == 0, 150.0).otherwise((k % 90).cast("double")).alias("discount"))
    found = [(x["column"], x["issue"], x["count"]) for x in outliers.impossible_values(df)]
    parts = [one_row(spark, "column_name string, issue string, n bigint", *x) for x in found]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


# -- outliers and missing values -------------------------------------------------------------------------------


def _bounds(method: str, factor: float) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        low, high = outliers.bounds(read(spark, sf_dir, "lineitem"), ["l_extendedprice"], method, factor)["l_extendedprice"]
        return one_row(spark, "low double, high double", round(low, 4), round(high, 4))

    run.__name__ = f"outlier_bounds_{method}"
    return run


for _m, _f, _sql in (
    ("iqr", 1.5, "select q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high from (select quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem)"),
    ("zscore", 3.0, "select avg(l_extendedprice) - 3 * stddev_samp(l_extendedprice) as low, avg(l_extendedprice) + 3 * stddev_samp(l_extendedprice) as high from lineitem"),
    ("mad", 3.0, "select median(l_extendedprice) - 3 * 1.4826 * mad(l_extendedprice) as low, median(l_extendedprice) + 3 * 1.4826 * mad(l_extendedprice) as high from lineitem"),
    ("percentile", 0.02, "select quantile_cont(l_extendedprice, 0.02) as low, quantile_cont(l_extendedprice, 0.98) as high from lineitem"),
):
    query(f"select round(low, 4) as low, round(high, 4) as high from ({_sql})")(_bounds(_m, _f))

_SPIKED_SQL = "(select o_orderkey, case when o_orderkey % 100 = 0 then o_totalprice * 50 when o_orderkey % 7 = 0 then null else o_totalprice end as price from orders)"


def _spiked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 100 == 0, F.col("o_totalprice") * 50).when(k % 7 != 0, F.col("o_totalprice")).alias("price"))


@query(f"with b as (select quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.75) as q3 from {_SPIKED_SQL}) select o_orderkey, round(case when price is null then null else least(greatest(price, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) end, 4) as price from {_SPIKED_SQL}, b")
def cap_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.handle_outliers(_spiked(spark, sf_dir), ["price"])[0].withColumn("price", F.round("price", 4))


@query(f"with b as (select quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.75) as q3 from {_SPIKED_SQL}) select count(*) filter (price < q1 - 1.5 * (q3 - q1) or price > q3 + 1.5 * (q3 - q1)) as outliers from {_SPIKED_SQL}, b")
def flag_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = outliers.handle_outliers(_spiked(spark, sf_dir), ["price"], action="flag")[1]
    return one_row(spark, "outliers bigint", report["price"]["outliers"])


def _fill(strategy: str, column: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out, _ = missing.fill_missing(dirty_orders(spark, sf_dir), [column], strategy, "none", ["o_orderkey"])
        value = F.round(column, 4) if column == "o_totalprice" else F.date_format(column, "yyyy-MM-dd") if column == "o_orderdate" else F.col(column)
        return out.select("o_orderkey", value.alias("value"))

    run.__name__ = f"fill_{strategy}"
    return run


for _s, _c, _e in (
    ("median", "o_totalprice", f"round(coalesce(o_totalprice, (select median(o_totalprice) from {DIRTY_ORDERS_SQL})), 4)"),
    ("mean", "o_totalprice", f"round(coalesce(o_totalprice, (select avg(o_totalprice) from {DIRTY_ORDERS_SQL})), 4)"),
    ("mode", "o_orderpriority", f"coalesce(o_orderpriority, (select o_orderpriority from {DIRTY_ORDERS_SQL} where o_orderpriority is not null group by 1 order by count(*) desc, 1 limit 1))"),
    ("constant", "o_orderpriority", "coalesce(o_orderpriority, 'none')"),
    ("ffill", "o_orderdate", "strftime(last_value(o_orderdate ignore nulls) over (order by o_orderkey rows between unbounded preceding and current row), '%Y-%m-%d')"),
    ("bfill", "o_orderdate", "strftime(first_value(o_orderdate ignore nulls) over (order by o_orderkey rows between current row and unbounded following), '%Y-%m-%d')"),
):
    query(f"select o_orderkey, {_e} as value from {DIRTY_ORDERS_SQL}")(_fill(_s, _c))


@query(f"select o_orderkey, coalesce(o_orderpriority, (select o_orderpriority from {DIRTY_ORDERS_SQL} where o_orderpriority is not null group by 1 order by count(*) desc, 1 limit 1)) as o_orderpriority, round(coalesce(o_totalprice, (select median(o_totalprice) from {DIRTY_ORDERS_SQL})), 4) as o_totalprice, sparse from {DIRTY_ORDERS_SQL}")
def fill_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = missing.fill_missing(dirty_orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_totalprice", "sparse"))
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("select count(*) as n from (select case when o_orderkey % 4 = 0 then null else o_orderstatus end as a, case when o_orderkey % 6 = 0 then null else o_totalprice end as b from orders) where a is not null or b is not null")
def drop_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    df = read(spark, sf_dir, "orders").select(F.when(k % 4 != 0, F.col("o_orderstatus")).alias("a"), F.when(k % 6 != 0, F.col("o_totalprice")).alias("b"))
    return rows.drop_empty_rows(df).agg(F.count(F.lit(1)).alias("n"))


@query(f"select o_orderkey, o_orderpriority, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderstatus, constant, sparse from {DIRTY_ORDERS_SQL}")
def drop_empty_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.drop_empty_columns(dirty_orders(spark, sf_dir)).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(f"select o_orderkey, o_orderpriority, o_totalprice from {DIRTY_ORDERS_SQL}")
def drop_high_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.drop_high_missing(dirty_orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_totalprice", "sparse"))


@query("select o_orderkey, o_orderstatus as a from orders where o_orderkey % 9 != 0")
def remove_spacers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    df = read(spark, sf_dir, "orders").select(F.when(k % 9 != 0, k).alias("o_orderkey"), F.when(k % 9 != 0, F.col("o_orderstatus")).alias("a"), F.lit(None).cast("string").alias("Spacer"))
    return rows.remove_spacers(df)


# -- duplicates ------------------------------------------------------------------------------------------------


@query(f"select distinct * from {DOUBLED_SQL}")
def dedupe_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.remove_duplicates(doubled_customers(spark, sf_dir))


def _dedupe(keep: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
        return duplicates.remove_duplicates(df, ["o_custkey"], keep, ["o_orderkey"])

    run.__name__ = f"dedupe_keep_{keep}"
    return run


for _k, _q in (("first", "row_number() over (partition by o_custkey order by o_orderkey) = 1"), ("last", "row_number() over (partition by o_custkey order by o_orderkey desc) = 1"), ("none", "count(*) over (partition by o_custkey) = 1")):
    query(f"select o_orderkey, o_custkey, o_totalprice from orders qualify {_q}")(_dedupe(_k))

_NEAR_SQL = "(select c_name, c_mktsegment from customer union all select '  ' || upper(c_name) || ' ', lower(c_mktsegment) from customer where c_custkey % 8 = 0)"


@query(f"select count(*) - count(distinct (lower(trim(c_name)), lower(trim(c_mktsegment)))) as near_duplicates from {_NEAR_SQL}")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    df = c.select("c_name", "c_mktsegment").unionByName(c.filter("c_custkey % 8 = 0").select(F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")).alias("c_name"), F.lower("c_mktsegment").alias("c_mktsegment")))
    return one_row(spark, "near_duplicates bigint", duplicates.near_duplicate_count(df))


@query("select count(*) as collisions from (select o_custkey from orders group by 1 having count(*) > 1)")
def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_row(spark, "collisions bigint", duplicates.identifier_collisions(read(spark, sf_dir, "orders"), ["o_custkey"])["o_custkey"])


# -- predicates and removal ------------------------------------------------------------------------------------


def _filter(op: str, column: str, value: str | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dirty_orders(spark, sf_dir).filter(rows.predicate(column, op, value)).select("o_orderkey")

    run.__name__ = f"filter_{op}"
    return run


for _o, _c, _v, _w in (
    ("null", "o_orderpriority", None, "o_orderpriority is null or trim(o_orderpriority) = ''"), ("not_null", "o_orderpriority", None, "o_orderpriority is not null and trim(o_orderpriority) != ''"),
    ("equals", "o_orderpriority", " 1-URGENT ", "trim(o_orderpriority) = '1-URGENT'"), ("contains", "o_orderpriority", "urgent|low", "regexp_matches(o_orderpriority, '(?i)urgent|low')"),
    ("greater", "o_totalprice", "100000", "o_totalprice > 100000"), ("less", "o_totalprice", "100000", "o_totalprice < 100000"),
):
    query(f"select o_orderkey from {DIRTY_ORDERS_SQL} where {_w}")(_filter(_o, _c, _v))


@query("select o_orderkey, o_orderstatus from (select *, row_number() over (order by o_orderkey) - 1 as r from orders) where r not between 0 and 5 and r != 12 and r not between 20 and 25")
def remove_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    wanted = [r for a, b in rows.parse_ranges("0-5, 12, 20-25", df.count()) for r in range(a, b + 1)]
    return rows.remove_rows(df, wanted, ["o_orderkey"])


@query("select o_orderkey, o_orderstatus from (select *, row_number() over (order by o_orderkey) - 1 as r from orders) where r > 1")
def remove_rows_and_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return rows.remove_rows_and_columns(df, [0, 1], ["o_custkey"], ["o_orderkey"])


@query("select o_orderkey::varchar as o_orderkey, o_orderstatus as o_orderstatus from orders")
def repeated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus")
    return rows.remove_repeated_headers(df.unionByName(spark.range(3).select(F.lit(" O_ORDERKEY").alias("o_orderkey"), F.lit("o_orderstatus ").alias("o_orderstatus"))))


@query("select p_name as name, p_retailprice as price from part where p_partkey % 20 != 0")
def metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 40 == 0, F.lit(" Grand Total")).when(F.col("p_partkey") % 20 == 0, F.lit("Note: x")).otherwise(F.col("p_name")).alias("name"), F.col("p_retailprice").alias("price"))
    return rows.remove_metadata_rows(df)


@query("select p_name as name, p_retailprice as price from part where p_partkey % 20 != 0")
def subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 20 == 0, F.lit("Brand subtotal")).otherwise(F.col("p_name")).alias("name"), F.col("p_retailprice").alias("price"), F.lit(1).alias("Row Total"))
    return rows.remove_subtotals(df)


# -- text, numbers, dates --------------------------------------------------------------------------------------

_PADDED = "chr(9) || ' ' || replace(c_name, '#', '  ' || chr(10)) || '  '"


@query(f"select c_custkey, regexp_replace(regexp_replace({_PADDED}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') as name from customer")
def strip_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("\t "), F.replace("c_name", F.lit("#"), F.lit("  \n")), F.lit("  ")).alias("name"))
    return repair.strip_whitespace(df)


@query("select c_custkey, replace(c_name, '0', '[x]') as name, replace(c_custkey::varchar, '1', '7')::bigint as number from customer")
def replace_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_custkey").alias("number"))
    return repair.replace_values(repair.replace_values(df, ["name"], "0", "[x]"), ["number"], "1", "7")


@query("select c_custkey, round(c_acctbal, 2) as value from customer")
def parse_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.format_string("%,.2f", F.abs("c_acctbal"))
    k = F.col("c_custkey") % 3
    text = F.when(F.col("c_acctbal") >= 0, F.when(k == 0, F.concat(F.lit("$"), shown)).when(k == 1, F.concat(shown, F.lit(" EUR"))).otherwise(F.concat(F.lit("Rs. "), shown)))
    text = text.otherwise(F.when(k == 0, F.concat(F.lit("($"), shown, F.lit(")"))).when(k == 1, F.concat(F.lit("-"), shown)).otherwise(F.concat(shown, F.lit("-"))))
    df = read(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    return df.select("c_custkey", F.round(N.parse_number("text"), 2).alias("value"))


@query("select o_orderkey, (o_orderkey % 50 + 1) * (case o_orderkey % 3 when 0 then 1e3 when 1 then 1e6 else 1e9 end) as value from orders")
def parse_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    suffix = F.element_at(F.array(F.lit("K"), F.lit("m"), F.lit("B USD")), (k % 3 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", N.magnitude(F.concat(F.lit("$"), (k % 50 + 1).cast("string"), suffix)).alias("value"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then 25000.0 when 1 then 3.5 when 2 then 1250.0 else null end::double as value from orders")
def parse_written_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*map(F.lit, ("twenty-five thousand", "three point five", "one thousand two hundred and fifty", "two good reasons")))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(N.written_number(F.element_at(said, (F.col("o_orderkey") % 4 + 1).cast("int"))), 6).alias("value"))


@query("select how, count(*) as n from (select case o_orderkey % 5 when 0 then 'missing' when 1 then 'numeric_string' when 2 then 'formatted' when 3 then 'written' else 'unparseable' end as how from orders) group by 1")
def explicit_numeric_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*map(F.lit, (" N/A ", "12.5", "$1,200.50", "five hundred", "soon")))
    df = read(spark, sf_dir, "orders").select(F.element_at(said, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("x"))
    return df.groupBy(N.explicit_number("x")[1].alias("how")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then true when 1 then false when 2 then true else null end as value from orders")
def to_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*map(F.lit, (" YES ", "off", "1", "maybe")))
    return read(spark, sf_dir, "orders").select("o_orderkey", N.to_boolean(F.element_at(said, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("value"))


def _written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    shown = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "d MMMM yyyy")).when(k == 2, F.date_format(d, "yyyyMMdd")).when(k == 3, F.date_format(d, "MMM dd, yyyy HH:mm")).otherwise("31/02/2025")
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", shown.alias("shown"))


@query("select o_orderkey, case when o_orderkey % 5 = 4 then 'INVALID' else 'UNAMBIGUOUS' end as status, case when o_orderkey % 5 != 4 then strftime(o_orderdate, '%Y-%m-%d') end as day from orders")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_ = types.read_dates(_written_dates(spark, sf_dir), "shown", "d")
    return read_.select("o_orderkey", F.col("d.status").alias("status"), F.date_format("d.ts", "yyyy-MM-dd").alias("day"))


@query("select 'DMY' as convention, 0.98::double as confidence, count(*) as n, count(*) filter (day(o_orderdate) <= 12 and day(o_orderdate) != month(o_orderdate)) as ambiguous from orders")
def date_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("shown"))
    e = types.text_evidence(df, ["shown"])["shown"]
    c = types.date_convention("shown", e)
    return one_row(spark, "convention string, confidence double, n bigint, ambiguous bigint", c["convention"], c["confidence"], e["n"], e["ambiguous"])


@query("select o_orderkey, strftime(o_orderdate, '%d-%m-%y') as shown_display from orders")
def date_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("shown"))
    return types.normalize_dates(df, ["shown"])[0].select("o_orderkey", "shown_display")


@query("select event_id, year(ts)::int as year, month(ts)::int as month, day(ts)::int as day, (isodow(ts) - 1)::int as dayofweek, hour(ts)::int as hour, round((epoch((select max(ts) from events))::bigint - floor(epoch(ts))::bigint) / 86400.0::double, 8) as days_elapsed from events")
def date_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    last = df.agg(F.max("ts")).first()[0]
    f = D.date_features(F.col("ts").cast("timestamp"), F.lit(last).cast("timestamp"))
    return df.select("event_id", *[(F.round(e, 8) if k == "days_elapsed" else e).alias(k) for k, e in f.items()])


# -- types -----------------------------------------------------------------------------------------------------


@query("select * from (values ('code', 'identifier'), ('day', 'datetime'), ('flag', 'boolean'), ('price', 'currency'), ('qty', 'integer'), ('segment', 'categorical')) t(column_name, type)")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    df = read(spark, sf_dir, "customer").select(
        F.format_string("C-%05d", k).alias("code"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 500).cast("int")), "yyyy-MM-dd").alias("day"),
        F.when(k % 2 == 0, "yes").otherwise("no").alias("flag"), F.format_string("$%,.2f", F.abs("c_acctbal")).alias("price"), (k % 90 + 10).cast("string").alias("qty"), F.col("c_mktsegment").alias("segment"),
    )
    found = types.infer_types(df)
    parts = [one_row(spark, "column_name string, type string", c, i.type) for c, i in sorted(found.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("select c_custkey, round(abs(c_acctbal), 2) as price, (c_custkey % 90 + 10)::bigint as qty, c_custkey % 2 = 0 as flag from customer")
def auto_dtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    df = read(spark, sf_dir, "customer").select("c_custkey", F.format_string("$%,.2f", F.abs("c_acctbal")).alias("price"), (k % 90 + 10).cast("string").alias("qty"), F.when(k % 2 == 0, "Yes").otherwise("No").alias("flag"))
    return types.auto_types(df)[0].withColumn("price", F.round("price", 2))


@query("select c_custkey, case c_custkey % 3 when 0 then 1500 when 1 then 42 end::bigint as amount from customer")
def convert_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*map(F.lit, ("1.5K", "42", "unclear")))
    df = read(spark, sf_dir, "customer").select("c_custkey", F.element_at(said, (F.col("c_custkey") % 3 + 1).cast("int")).alias("amount"))
    return types.to_numeric(df, ["amount"])[0]


@query("select 'code' as column_name, true as identifier union all select 'zip', true union all select 'segment', false")
def identifier_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").select(F.format_string("INV-%05d", "c_custkey").alias("code"), F.format_string("%05d", F.col("c_custkey") % 700).alias("zip"), F.col("c_mktsegment").alias("segment"))
    found = types.infer_types(df)
    out = [one_row(spark, "column_name string, identifier boolean", c, i.type == "identifier") for c, i in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# -- standardisation -------------------------------------------------------------------------------------------


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in several spellings: by key, upper with blanks, misspelt, or missing."""
    k, s = F.col("c_custkey"), F.initcap("c_mktsegment")
    shown = F.when(k % 50 == 0, "N/A").when(k % 20 == 0, F.concat(F.lit(" "), F.upper(s), F.lit("  "))).when((k % 45 == 0) & (s == "Machinery"), "Machinerry").otherwise(s)
    return read(spark, sf_dir, "customer").select("c_custkey", shown.alias("segment"))


_MESSY_SQL = "(select c_custkey, case when c_custkey % 50 = 0 then 'N/A' when c_custkey % 20 = 0 then ' ' || upper(s) || '  ' when c_custkey % 45 = 0 and s = 'Machinery' then 'Machinerry' else s end as segment from (select c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as s from customer))"


@query(f"select segment as value, count(*) as n from {_MESSY_SQL} where lower(trim(segment)) = 'n/a' group by 1")
def null_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.null_sentinels(standardize.value_table(_messy(spark, sf_dir), "segment")).select("value", "n")


@query(f"""with v as (select segment as value, count(*) as n, regexp_replace(lower(segment), '[^a-z0-9]', '', 'g') as key from {_MESSY_SQL} where lower(trim(segment)) != 'n/a' group by 1),
c as (select *, first_value(value) over (partition by key order by n desc, case when regexp_matches(value, '^[A-Z][^A-Z]*$') then 2 else 1 end desc, value) as canonical from v)
select value, canonical, 0.98::double as confidence from c where value != canonical""")
def format_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.format_variants(standardize.value_table(_messy(spark, sf_dir), "segment")).select("value", "canonical", "confidence")


@query(f"select case when count(*) filter (segment = 'Machinery') >= 3 * count(*) filter (segment = 'Machinerry') then 'Machinerry' else 'Machinery' end as value, 'Machinery' as canonical from {_MESSY_SQL} having count(*) filter (segment = 'Machinerry') > 0")
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.fuzzy_typos(standardize.canonicals(standardize.value_table(_messy(spark, sf_dir), "segment"))).select("value", "canonical")


def _canon(spark: SparkSession, sf_dir: str, *values: str) -> DataFrame:
    """A value column over orders, the k-th value on every k-th key in turn."""
    said = F.array(*map(F.lit, values))
    df = read(spark, sf_dir, "orders").select(F.element_at(said, (F.col("o_orderkey") % len(values) + 1).cast("int")).alias("v"), "o_orderstatus")
    return standardize.canonicals(standardize.value_table(df, "v"))


@query("select 'Card, Credit' as value, 'Credit Card' as canonical where (select count(*) from orders where o_orderkey % 3 = 0) >= (select count(*) from orders where o_orderkey % 3 = 1)")
def token_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*map(F.lit, ("Credit Card", "Card, Credit", "Credit Card", "Cash")))
    df = read(spark, sf_dir, "orders").select(F.element_at(said, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("v"))
    return standardize.token_permutations(standardize.canonicals(standardize.value_table(df, "v"))).select("value", "canonical")


@query("select 'COD' as value, 'Cash On Delivery' as canonical, 'acronym' as method")
def acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.acronyms(_canon(spark, sf_dir, "Cash On Delivery", "COD", "Bank Transfer")).select("value", "canonical", "method")


@query("select 'Furn' as value, 'Furniture' as canonical, 'prefix' as method")
def prefix_abbrev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.prefixes(_canon(spark, sf_dir, "Furniture", "Furn", "Toys")).select("value", "canonical", "method")


@query("select 'Lhr' as value, 'Lahore' as canonical, 'skeleton' as method")
def skeleton_abbrev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.skeletons(_canon(spark, sf_dir, "Lahore", "Lhr", "Karachi")).select("value", "canonical", "method")


@query("""with s as (select c_mktsegment as v, list_distinct(list(n_name)) as l from customer join nation on c_nationkey = n_nationkey group by 1)
select a.v as a, b.v as b, round(len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))), 4)::double as score from s a join s b on a.v < b.v""")
def context_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_name")
    values = df.select("c_mktsegment").distinct()
    pairs = values.select(F.col("c_mktsegment").alias("a")).join(values.select(F.col("c_mktsegment").alias("b")), F.col("a") < F.col("b"))
    return standardize.context_scores(df, "c_mktsegment", pairs).withColumn("score", F.round("score", 4))


@query(f"select c_custkey, case when lower(trim(segment)) = 'n/a' then null when segment = 'Machinerry' then 'Machinery' else upper(trim(segment)[1]) || lower(trim(segment)[2:]) end as segment from {_MESSY_SQL}")
def standardize_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.standardize(_messy(spark, sf_dir), ["segment"])[0]


# -- reshape ---------------------------------------------------------------------------------------------------


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of each order in one cell, in two columns in step."""
    item = F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("part"), F.col("l_quantity").cast("int").cast("string").alias("qty"))
    few = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("i"))
    cell = lambda f: F.array_join(F.transform("i", lambda x: x[f]), " | ")
    return few.select("l_orderkey", F.concat(F.lit("p"), F.array_join(F.transform("i", lambda x: x["part"]), " | p")).alias("parts"), cell("qty").alias("quantities"))


@query("select l_orderkey, 'p' || l_partkey as parts, l_quantity::int::double as quantities from lineitem")
def explode_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.explode_packed(_packed(spark, sf_dir), ["parts", "quantities"], "|")


@query("select '|' as delimiter, 'parts,quantities' as columns, true as synchronized")
def detect_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reshape.detect_packed(_packed(spark, sf_dir))
    return one_row(spark, "delimiter string, columns string, synchronized boolean", found["delimiter"], ",".join(found["synchronized"]), found["is_synchronized"])


@query("select p_partkey, 'size' as variable, p_size::double as value from part union all select p_partkey, 'price', p_retailprice from part where p_partkey % 4 != 0")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("price"))
    return reshape.unpivot(df)


@query("select n_name as name, 'First Class' as Category_1, n_regionkey::double as value, 'Consumer' as Category_2 from nation union all select n_name, 'First Class', n_nationkey::double, 'Corporate' from nation")
def unpivot_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("First Class - Consumer"), F.col("n_nationkey").cast("double").alias("First Class - Corporate"))
    return reshape.unpivot(df)


@query("select n_name::varchar as \"Region\", n_nationkey::varchar as \"Q1 - Sales\", n_regionkey::varchar as \"Q1 - Cost\" from nation")
def flatten_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = spark.range(1).select(F.lit("").alias("Region"), F.lit("Sales").alias("Q1"), F.lit("Cost").alias("Unnamed: 2"), F.lit(-1).cast("long").alias("o"))
    body = read(spark, sf_dir, "nation").select(F.col("n_name").alias("Region"), F.col("n_nationkey").cast("string").alias("Q1"), F.col("n_regionkey").cast("string").alias("Unnamed: 2"), F.col("n_nationkey").cast("long").alias("o"))
    placed = rows.with_row_id(head.union(body), ["o"]).drop("o")
    return reshape.flatten_headers(placed)


@query("select n_name as \"Segment\", n_nationkey::varchar as \"Consumer__Sales\", n_regionkey::varchar as \"Consumer__Profit\" from nation")
def horizontal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Segment >>", "Consumer", "Unnamed: 2", "Consumer Total"]
    head = spark.range(1).select(F.lit("").alias("a"), F.lit("Sales").alias("b"), F.lit("Profit").alias("c"), F.lit("").alias("d"), F.lit(-1).cast("long").alias("o"))
    body = read(spark, sf_dir, "nation").select(F.col("n_name").alias("a"), F.col("n_nationkey").cast("string").alias("b"), F.col("n_regionkey").cast("string").alias("c"), F.lit("9").alias("d"), F.col("n_nationkey").cast("long").alias("o"))
    placed = rows.with_row_id(head.union(body), ["o"]).drop("o")
    return reshape.flatten_blocks(placed.toDF(*names, rows.ROW_ID))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    a, b = F.concat(F.lit("Name: "), F.translate("c_name", "#", "")), F.concat(F.lit("Key: "), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat_ws(" | ", a, b)).otherwise(F.concat_ws(" | ", b, a)).alias("record"))


@query("select c_custkey, replace(c_name, '#', '') as name, c_custkey::varchar as key from customer")
def parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = embedded.parse_records("record", ["Name", "Key"], ":")
    return _records(spark, sf_dir).select("c_custkey", fields["Name"].alias("name"), fields["Key"].alias("key"))


@query("select * from (values ('Name'), ('Key')) t(label)")
def record_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedded.explicit_labels(_records(spark, sf_dir).select("record"), "record")
    a, b = sorted(found["labels"])
    return one_row(spark, "label string", a).unionByName(one_row(spark, "label string", b))


_TOKENS = "select unnest(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) as token from documents"


@query(f"select 'token' as kind, token, count(*) as n from ({_TOKENS}) where token != '' group by 2 order by n desc, token limit 20")
def token_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded.token_patterns(read(spark, sf_dir, "documents").select(F.regexp_replace("text", r"\s+", " ").alias("text")), "text").filter("kind = 'token'")


@query("select r_regionkey as r_region_key, r_name as region_name from region")
def standardize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "region").toDF("r RegionKey", "Region-Name")
    return reshape.standardize_names(df)


@query("select r_regionkey as id, r_name as id_1, r_name as unnamed_0 from region")
def fix_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "region")
    return reshape.fix_names(df.select("r_regionkey", "r_name", F.col("r_name").alias("z")).toDF(" id", "id ", "Unnamed: 2"))


@query("select 'Unnamed: 0' as column_name, 'index' as kind union all select 'Unnamed: 1', 'empty' union all select 'Unnamed: 2', 'data'")
def unnamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("Unnamed: 0"), F.lit(None).cast("string").alias("Unnamed: 1"), F.col("n_name").alias("Unnamed: 2"), F.col("n_nationkey").alias("k"))
    found = reshape.unnamed_columns(df, ["k"])
    out = [one_row(spark, "column_name string, kind string", c, k) for c, k in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# -- structure, orchestration, models --------------------------------------------------------------------------


@query()
def structure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all layout rules over lineitem."""
    found = structure.detect(read(spark, sf_dir, "lineitem"))
    out = [one_row(spark, "rule string, layout string, score double", e.rule, e.layout, e.score) for e in found.rules]
    table = out[0]
    for o in out[1:]:
        table = table.unionByName(o)
    return table


@query("select count(*) as gaps, count(*) filter (g > 0) as positive, count(distinct case when g > 0 then g end) as kinds from (select epoch_us(ts) - lag(epoch_us(ts)) over (order by ts) as g from events) where g is not null")
def time_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_row(spark, "gaps bigint, positive bigint, kinds bigint", *structure.gap_kinds(read(spark, sf_dir, "events"), "ts"))


@query(f"with d as (select distinct c_custkey, trim(c_name) as c_name, c_mktsegment from {DOUBLED_SQL}) select c_custkey, c_name, c_mktsegment from d")
def repair_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(doubled_customers(spark, sf_dir), [Action("strip_whitespace"), Action("remove_duplicate_rows"), Action("no_such_operation")]).df


@query(f"select 'remove_duplicate_rows' as operation, (select count(*) from {DOUBLED_SQL}) as rows_before, (select count(*) from customer) as rows_after, true as success union all select 'remove_title_rows', (select count(*) from customer), (select count(*) from customer), false")
def repair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = repair.repair(doubled_customers(spark, sf_dir), [Action("remove_duplicate_rows"), Action("remove_title_rows")])
    out = [one_row(spark, "operation string, rows_before bigint, rows_after bigint, success boolean", a.operation, a.rows_before, a.rows_after, a.success) for a in result.audits]
    return out[0].unionByName(out[1])


@query()
def one_click_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The autonomous pipeline over dirty orders."""
    return pipeline.run(dirty_orders(spark, sf_dir).drop("o_orderdate")).df


@query(f"select o_orderkey, coalesce(o_orderpriority, (select o_orderpriority from {DIRTY_ORDERS_SQL} where o_orderpriority is not null group by 1 order by count(*) desc, 1 limit 1)) as o_orderpriority, coalesce(o_totalprice, 0) as o_totalprice from {DIRTY_ORDERS_SQL}")
def cleaning_executor(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dirty_orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_totalprice", "constant")
    steps = [{"operation": "drop_constant_column", "column": "constant"}, {"operation": "fill_missing_numeric", "column": "o_totalprice", "method": "zero"}, {"operation": "fill_missing_categorical", "column": "o_orderpriority", "method": "mode"}, {"operation": "unknown"}]
    return pipeline.clean(df, steps)[0]


@query("select 0::bigint as missing, count(*) as valid_count, count(distinct o_orderstatus) as classes from orders")
def target_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ml.target_quality(read(spark, sf_dir, "orders"), "o_orderstatus")
    return one_row(spark, "missing bigint, valid_count bigint, classes bigint", q["missing"], q["valid_count"], q["unique"])


@query("select * from (values ('c_acctbal', 'numeric'), ('c_custkey', 'numeric'), ('c_name', 'dropped'), ('c_nationkey', 'numeric')) t(column_name, role)")
def feature_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = ml.feature_roles(read(spark, sf_dir, "customer"), "c_mktsegment")
    flat = sorted([(c, k) for k, v in roles.items() for c in v])
    out = one_row(spark, "column_name string, role string", *flat[0])
    for x in flat[1:]:
        out = out.unionByName(one_row(spark, "column_name string, role string", *x))
    return out


@query("select o_orderstatus as label, ceil(0.2 * count(*))::bigint as test_rows from orders group by 1")
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = ml.split(read(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus")
    return parted.filter("is_test").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count(F.lit(1)).alias("test_rows"))


@query()
def automl_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline and all five candidates on the price of parts, with cross-validation."""
    df = read(spark, sf_dir, "part")
    return ml.leaderboard(ml.train(df, "p_retailprice", "p_partkey"), df)


@query("""select '{"k":' || r_regionkey || ',"name":"' || r_name || '"}' as json from region""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.json_rows(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))


@query("select r_regionkey::varchar as col_1, r_name as \"name\" from region")
def export_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "region").select(F.lit(0).alias("index"), F.col("r_regionkey").cast("string").alias("z"), F.col("r_name").alias("name"))
    return writers.clean(df.toDF("index", "Unnamed: 1", " name "))


@query("select c_custkey, case c_custkey % 3 when 0 then 'O''Neil Mc-Donald' when 1 then '3Rd Floor' else 'Plain' end as name from customer")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*map(F.lit, (" o'neil mc-donald ", "3rd floor", "PLAIN")))
    return read(spark, sf_dir, "customer").select("c_custkey", X.title_case(F.element_at(said, (F.col("c_custkey") % 3 + 1).cast("int"))).alias("name"))


# DuckDB composes by NFC alone: the same as NFKC for the letters in documents; the row added has characters that NFKC alone maps.
@query(r"select doc_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) as text from documents union all select -1, 'fine day ABC 1'")
def unicode_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFKC and white space of whole documents, and of a row with a ligature, wide letters and invisible characters."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(one_row(spark, "doc_id bigint, text string", -1, " \ufb01ne\u00a0 d\u200bay\n\uff21\uff22\uff23 \u2460\ufeff"))
    return docs.select("doc_id", X.unicode_clean("text").alias("text"))
