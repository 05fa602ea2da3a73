"""Registered queries over positions after shuffles, folds, column details, suggested repairs and layout rules.

A layout rule's score is checked by SQL that states the rule over the same table: what depends on rows is computed from
them, what depends on names and types alone is a number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import duplicates, missing, profile, rows, standardize
from millrace.plans import ml, provider, repair
from millrace.plans.catalog import _MESSY_SQL, DIRTY_ORDERS_SQL, DOUBLED_SQL, ORACLES, _messy, dirty_orders, doubled_customers, one_row, query, read

# -- positions after shuffles ----------------------------------------------------------------------------------


@query(f"select count(distinct c_custkey) - 3 as n, count(distinct c_custkey) - 3 as n_ids, true as dense from {DOUBLED_SQL}")
def remove_rows_after_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows by position, without an order, of a table that was deduplicated; what is left has dense positions."""
    left = rows.remove_rows(doubled_customers(spark, sf_dir).dropDuplicates(["c_custkey"]), [0, 1, 2])
    placed = rows.with_row_id(left.repartition("c_custkey"))
    return placed.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("n_ids"), ((F.min(rows.ROW_ID) == 0) & (F.max(rows.ROW_ID) == F.count(F.lit(1)) - 1) & (F.count_distinct(rows.ROW_ID) == F.count(F.lit(1)))).alias("dense"),
    )


@query(f"select o_orderkey, o_orderstatus, last_value(o_orderdate ignore nulls) over (order by o_orderkey) as o_orderdate from {DIRTY_ORDERS_SQL}")
def fill_after_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates carried forward over orders that were doubled, shuffled and deduplicated."""
    df = dirty_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderdate")
    once = df.unionByName(df.filter("o_orderkey % 2 = 0")).dropDuplicates(["o_orderkey"])
    return missing.fill_missing(once, ["o_orderdate"], "ffill", order_by=["o_orderkey"])[0]


@query(f"select c_custkey, c_name, c_mktsegment from {DOUBLED_SQL} group by all having count(*) = 1")
def dedupe_keep_none_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.remove_duplicates(doubled_customers(spark, sf_dir), ["c_custkey"], "none")


@query(f"""with s as (select distinct c_custkey, trim(c_name) as c_name, c_mktsegment from {DOUBLED_SQL})
select 'strip_whitespace' as operation, (select count(*) from {DOUBLED_SQL}) as rows_before, (select count(*) from {DOUBLED_SQL}) as rows_after, 3 as columns_after, true as success
union all select 'remove_duplicate_rows', (select count(*) from {DOUBLED_SQL}), count(*), 3, true from s union all select 'remove_rows', count(*), count(*) - 5, 3, true from s
union all select 'remove_columns', count(*) - 5, count(*) - 5, 2, true from s union all select 'remove_rows', count(*) - 5, count(*) - 5, 2, false from s""")
def observed_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits of five actions, each judged by what was counted while its result was written; the last asks for most rows to go."""
    actions = [
        repair.Action("strip_whitespace"), repair.Action("remove_duplicate_rows"), repair.Action("remove_rows", params={"rows": [0, 1, 2, 3, 4]}), repair.Action("remove_columns", ["c_mktsegment"]),
        repair.Action("remove_rows", params={"rows": [10**12]}),
    ]
    audits = repair.repair(doubled_customers(spark, sf_dir), actions).audits
    out = [one_row(spark, "operation string, rows_before bigint, rows_after bigint, columns_after int, success boolean", a.operation, a.rows_before, a.rows_after, a.columns_after, a.success) for a in audits]
    table = out[0]
    for o in out[1:]:
        table = table.unionByName(o)
    return table


# -- folds, details, evidence ----------------------------------------------------------------------------------


@query("select o_orderstatus as label, fold::int as fold, (n + 4 - fold) // 5 as n from (select o_orderstatus, count(*) as n from orders group by 1), range(5) as f(fold)")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each class in each of five folds."""
    dealt = ml.assign_folds(read(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", 5)
    return dealt.groupBy(F.col("o_orderstatus").alias("label"), "fold").agg(F.count(F.lit(1)).alias("n"))


def _details_sql(columns: dict[str, str]) -> str:
    def one(c: str, kind: str) -> str:
        first = f"(select coalesce(string_agg({c}::varchar, '|' order by place), '') from (select {c}, min(o_orderkey) as place from {DIRTY_ORDERS_SQL} where {c} is not null group by 1 order by place limit 5))"
        return f"""select '{c}' as column_name, '{kind}' as dtype, count({c}) as non_null_count, count(*) - count({c}) as null_count, round((count(*) - count({c}))::double / count(*), 9) as null_share,
            count(distinct {c}) as unique_count, round(count(distinct {c})::double / count(*), 9) as unique_share, count(distinct {c}) = count(*) and count(*) > 1 as is_potential_id,
            count(distinct {c}) <= 1 and count({c}) > 0 as is_constant, {first} as samples from {DIRTY_ORDERS_SQL}"""

    return " union all ".join(one(c, k) for c, k in columns.items())


_DETAILED = {"o_orderkey": "bigint", "o_orderpriority": "string", "o_orderstatus": "string", "constant": "string", "nothing": "string", "sparse": "double"}


@query(_details_sql(_DETAILED))
def column_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, shares, flags and the first five values of columns of dirty orders, in order of the key."""
    found = profile.column_details(dirty_orders(spark, sf_dir).select(*_DETAILED), ["o_orderkey"])
    return found.withColumns({"samples": F.array_join("samples", "|"), "null_share": F.round("null_share", 9), "unique_share": F.round("unique_share", 9)})


_PADDED_SQL = f"(select o_orderkey, case when o_orderkey % 11 = 0 then ' ' || o_orderstatus else o_orderstatus end as o_orderstatus, o_totalprice, nothing, sparse from {DIRTY_ORDERS_SQL})"


@query(f"""select 'rows' as what, count(*) as n from {_PADDED_SQL} union all select 'empty_rows', 0 union all select 'null|o_totalprice', count(*) - count(o_totalprice) from {_PADDED_SQL}
union all select 'null|nothing', count(*) from {_PADDED_SQL} union all select 'null|sparse', count(*) - count(sparse) from {_PADDED_SQL} union all select 'null|o_orderkey', 0 union all select 'null|o_orderstatus', 0
union all select 'strip|o_orderstatus', count(*) filter (o_orderstatus != trim(o_orderstatus)) from {_PADDED_SQL} union all select 'strip|nothing', 0""")
def repair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one aggregate tells the suggested repairs of padded, dirty orders."""
    status = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit(" "), "o_orderstatus")).otherwise(F.col("o_orderstatus"))
    seen = repair.cell_evidence(dirty_orders(spark, sf_dir).select("o_orderkey", status.alias("o_orderstatus"), "o_totalprice", "nothing", "sparse"))
    pairs = [("rows", seen["rows"]), ("empty_rows", seen["empty_rows"]), *((f"{k}|{c}", n) for k, some in (("null", seen["nulls"]), ("strip", seen["strip"])) for c, n in some.items())]
    cells = F.array(*[F.struct(F.lit(k).alias("what"), F.lit(n).cast("long").alias("n")) for k, n in pairs])
    return spark.range(1).select(F.explode(cells).alias("c")).select("c.*")


@query("""with v as (select distinct regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as k from part), e as (select k from v union select k || 'x' from v where length(k) >= 4)
select a.k as x, b.k as y from e a join e b on a.k < b.k and abs(length(a.k) - length(b.k)) <= 2 and levenshtein(a.k, b.k) <= 1 where length(a.k) >= 4""")
def near_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts one edit apart, beside names with a letter too many, found by an index of pieces."""
    names = read(spark, sf_dir, "part").select(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "").alias("key")).distinct()
    keys = names.unionByName(names.filter(F.length("key") >= 4).select(F.concat("key", F.lit("x")).alias("key"))).distinct().filter(F.length("key") >= 4)
    return standardize.near_keys(keys).filter(F.levenshtein("x", "y") <= 1)


# -- layout rules ----------------------------------------------------------------------------------------------


_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINEITEM = [*_NUMERIC, "l_returnflag", "l_linestatus", "l_shipdate"]


def _weighed(*parts: tuple[float, str]) -> str:
    """The score of a rule: weights of what holds, between 0 and 1."""
    total = " + ".join(f"{w} * coalesce(({test})::int, 0)" for w, test in parts)
    return f"round(greatest(0.0, least(1.0, {total})), 4)::double"


def _lineitem_rules() -> dict[str, tuple[str, str]]:
    """rule -> (layout, score over the one-row table f). All eleven names begin with l_, so they follow a pattern; eight
    columns are numbers, two texts and one a time; the two flags are short texts, but no headers."""
    spans = ", ".join(f"(lo_{c}, hi_{c})" for c in _NUMERIC)
    alike = f"(select (max(lo) - min(lo) + max(hi) - min(hi)) / (2 * (max(hi) - min(lo))) < 0.5 from (values {spans}) as s(lo, hi))"
    scales = " + ".join(f"(d_{c} <= 10 and lo_{c} >= 0 and hi_{c} <= 10)::int" for c in _NUMERIC)
    no, yes = "false", "true"
    return {
        "normal_table": ("NORMAL_TABLE", _weighed((0.25, yes), (0.2, yes), (0.2, no), (0.15, "n / 11.0 > 3"), (0.1, yes), (-0.15, no))),
        "wide_table": ("WIDE_TABLE", _weighed((0.1, yes), (0.1, no), (0.25, yes), (0.2, no), (0.15, alike), (0.1, yes), (0.15, no))),
        "long_table": ("LONG_TABLE", _weighed((0.2, no), (0.25, yes), (0.2, yes), (0.2, "n > 10 and d_l_orderkey / n_l_orderkey::double < 0.3"))),
        "pivot_table": ("PIVOT_TABLE", _weighed((0.3, no), (0.15, no), (0.1, yes), (0.1, "n < 100"), (0.1, no))),
        "crosstab": ("CROSSTAB", _weighed((0.3, no), (0.15, no), (0.1, "n <= 50"), (0.15, yes))),
        "multi_header": ("MULTI_HEADER", _weighed((0.35, no))),
        "time_series": ("TIME_SERIES", f"case when d_l_shipdate / n_l_shipdate::double <= 0.6 then {_weighed((0.05, yes))} end"),
        "survey": ("SURVEY", _weighed((0.1, yes), (0.15, no), (0.25, f"{scales} >= 3"), (0.2, no))),
        "transactional": ("TRANSACTIONAL", _weighed((0.2, yes), (0.2, yes), (0.15, no), (0.15, yes), (0.1, "n > 100"), (0.1, yes))),
        "repeated_blocks": ("REPEATED_CATEGORY_BLOCKS", _weighed((0.35, no), (0.25, no), (0.3, "(select count(*) > count(distinct v) from (select unnest(head) as v) where v is not null)"))),
        "spacers": ("SPACER_ARTIFACTS", _weighed((0.4, "least(" + ", ".join(f"n_{c}" for c in _LINEITEM) + ") = 0 and n > 0"), (0.3, no), (0.25, "empty > 0"))),
        "subtotals": ("SUBTOTAL_COLUMNS_ROWS", _weighed((0.4, no), (0.4, "totals > 0"))),
        "banners": ("METADATA_BANNERS", _weighed((0.35, no))),
        "embedded_records": ("EMBEDDED_STRUCTURED_RECORDS", _weighed((0.5, no))),
    }


_FACTS_SQL = "select count(*) as n, " + ", ".join([
    *(f"min({c})::double as lo_{c}, max({c})::double as hi_{c}, count(distinct {c}) as d_{c}" for c in _NUMERIC), "count(distinct l_shipdate) as d_l_shipdate", *(f"count({c}) as n_{c}" for c in _LINEITEM),
    "count(*) filter (" + " and ".join(f"{c} is null" for c in _LINEITEM) + ") as empty", "count(*) filter (regexp_matches(lower(l_orderkey::varchar), 'total|summary|average')) as totals",
    "(select [" + ", ".join(f"{c}::varchar" for c in _LINEITEM) + "] from lineitem limit 1) as head",
]) + " from lineitem"
ORACLES["structure_rules"] = f"with f as ({_FACTS_SQL}) " + " union all ".join(f"select '{rule}' as rule, '{layout}' as layout, {score} as score from f" for rule, (layout, score) in _lineitem_rules().items())


# -- plans and checked proposals -------------------------------------------------------------------------------


@query(f"""with v as (select segment as value, count(*) as n from {_MESSY_SQL} where lower(trim(segment)) != 'n/a' group by 1),
p as (select upper(trim(value)[1]) || lower(trim(value)[2:]) as canonical, value, 0.9 as confidence from v union all select 'Machinery', value, 0.8 from v where value = 'Machinerry')
select case when canonical = 'Machinerry' then 'Machinery' else canonical end as canonical, string_agg(distinct value, '|' order by value) as members, min(confidence)::double as confidence, true as accepted from p group by 1""")
def semantic_groups_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments grouped by their name, with a misspelling that joins two groups and a member that isn't there."""
    values = standardize.value_table(_messy(spark, sf_dir), "segment").filter("lower(trim(value)) != 'n/a'").select("value", "n")
    named = values.select(F.initcap(F.trim("value")).alias("canonical"), "value", F.lit(0.9).alias("confidence"))
    more = spark.sql("select * from values ('Machinery', 'Machinerry', 0.8d), ('Machinery', 'Not There', 0.1d) as t(canonical, value, confidence)")
    found = standardize.validated_groups(values, named.unionByName(more))
    return found.withColumn("members", F.array_join("members", "|"))


@query("""select 'o_orderstatus' as target, 'multiclass_classification' as task, 'accuracy' as metric,
(select string_agg(c, ',' order by k) from (values (0, 'o_orderkey', (select count(distinct o_orderkey) from orders)), (1, 'o_custkey', (select count(distinct o_custkey) from orders)), (3, 'o_totalprice', (select count(distinct o_totalprice) from orders)),
  (4, 'o_orderdate', (select count(distinct o_orderdate) from orders)), (5, 'o_orderpriority', (select count(distinct o_orderpriority) from orders)), (6, 'same', (select count(distinct 1) from orders))) as t(k, c, n) where n > 1) as features""")
def model_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan by rule for orders with a constant column: o_orderstatus is named like a target."""
    found = ml.plan(read(spark, sf_dir, "orders").withColumn("same", F.lit(1)))
    return one_row(spark, "target string, task string, metric string, features string", found.target, found.task, found.metric, ",".join(found.features))


@query(f"""select 'o_orderpriority' as column_name, count(*) - count(o_orderpriority) as null_count, round(100.0 * (count(*) - count(o_orderpriority)) / count(*), 2)::double as null_percentage, count(distinct o_orderpriority) as unique_count from {DIRTY_ORDERS_SQL}
union all select 'o_totalprice', count(*) - count(o_totalprice), round(100.0 * (count(*) - count(o_totalprice)) / count(*), 2)::double, count(distinct o_totalprice) from {DIRTY_ORDERS_SQL}
union all select 'nothing', count(*), 100.0::double, 0 from {DIRTY_ORDERS_SQL}""")
def compact_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a provider gets to see of three columns of dirty orders."""
    found = provider.compact_profile(dirty_orders(spark, sf_dir).select("o_orderpriority", "o_totalprice", "nothing"))
    cells = F.array(*[F.struct(F.lit(c["column"]).alias("column_name"), *[F.lit(c[k]).cast(t).alias(k) for k, t in (("null_count", "long"), ("null_percentage", "double"), ("unique_count", "long"))]) for c in found["column_profiles"]])
    return spark.range(1).select(F.explode(cells).alias("c")).select("c.*")
