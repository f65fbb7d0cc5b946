"""The catalogue of registered queries: each a function of (spark, sf_dir), with the SQL that it must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import TABLES, describe, join_to, load, reference, relation, schema_diff
from tessera.functions import arrays, expr, jsonfns, net, ranges, temporal, udf
from tessera.operators import aggregates, dml, windows
from tessera.plans.query import Query, dynamic_select, grouped_by, try_grouped_by
from tessera.sources import copy
from tessera.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return keep


def over_table(name: str, table: str, sql: str | None, build: Callable[[DataFrame], DataFrame]) -> None:
    """Register a query of one table."""
    query(name, sql)(lambda spark, d: build(load(spark, d, table)))


# ------------------------------------------------------------------ the flagship


@query(
    "revenue_by_segment",
    """SELECT c_mktsegment, count(DISTINCT o_orderkey) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
       FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
       WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY c_mktsegment""",
)
def revenue_by_segment(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").where(c("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    per_order = lines.groupBy("l_orderkey").agg(F.sum(c("l_extendedprice") * (1 - c("l_discount"))).alias("r"))
    joined = load(spark, d, "customer").join(load(spark, d, "orders"), c("c_custkey") == c("o_custkey")).join(per_order, c("o_orderkey") == c("l_orderkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n_orders"), F.round(F.sum("r"), 2).alias("revenue"))


# ------------------------------------------------------------------ scans, projection, predicates

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def orders_where(name: str, condition: Callable[[], Column], sql: str) -> None:
    over_table(name, "orders", f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders WHERE {sql}", lambda df: Query(df).filter(condition()).select(*ORDER_COLUMNS).run())


orders_where("filter_eq", lambda: c("o_orderstatus") == "F", "o_orderstatus = 'F'")
orders_where("filter_ne", lambda: c("o_orderstatus") != "F", "o_orderstatus <> 'F'")
orders_where("filter_gt_lt", lambda: (c("o_totalprice") > 1000) & (c("o_totalprice") < 90000), "o_totalprice > 1000 AND o_totalprice < 90000")
orders_where("filter_ge_le", lambda: (c("o_orderkey") >= 10) & (c("o_orderkey") <= 500), "o_orderkey >= 10 AND o_orderkey <= 500")
orders_where("filter_between", lambda: c("o_totalprice").between(20000, 50000), "o_totalprice BETWEEN 20000 AND 50000")
orders_where("filter_not_between", lambda: ~c("o_totalprice").between(20000, 200000), "o_totalprice NOT BETWEEN 20000 AND 200000")
orders_where("filter_in", lambda: expr.is_in(c("o_orderkey"), [1, 2, 3, 77, 99]), "o_orderkey IN (1, 2, 3, 77, 99)")
orders_where("filter_in_empty", lambda: expr.is_in(c("o_orderkey"), []), "false")
orders_where("filter_not_in", lambda: expr.not_in(c("o_orderstatus"), ["F", "O"]), "o_orderstatus NOT IN ('F', 'O')")
orders_where("filter_not_in_empty", lambda: expr.not_in(c("o_orderkey"), []), "true")
orders_where("filter_eq_any", lambda: expr.eq_any(c("o_custkey"), [1, 4, 7, None]), "coalesce(o_custkey = ANY([1, 4, 7, NULL]), false)")
orders_where("filter_ne_all", lambda: expr.ne_all(c("o_orderstatus"), ["F", "P"]), "o_orderstatus <> 'F' AND o_orderstatus <> 'P'")
orders_where("filter_is_null", lambda: F.when(c("o_orderkey") % 7 != 0, c("o_custkey")).isNull(), "CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END IS NULL")
orders_where("filter_is_not_null", lambda: F.when(c("o_orderkey") % 7 != 0, c("o_custkey")).isNotNull(), "CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END IS NOT NULL")
orders_where("null_safe_eq", lambda: F.nullif(c("o_orderkey") % 5, F.lit(0)).eqNullSafe(F.nullif(c("o_custkey") % 5, F.lit(0))), "nullif(o_orderkey % 5, 0) IS NOT DISTINCT FROM nullif(o_custkey % 5, 0)")
orders_where("is_distinct_from", lambda: expr.distinct_from(F.nullif(c("o_orderkey") % 5, F.lit(0)), F.nullif(c("o_custkey") % 5, F.lit(0))), "nullif(o_orderkey % 5, 0) IS DISTINCT FROM nullif(o_custkey % 5, 0)")
orders_where("filter_not", lambda: ~((c("o_orderstatus") == "O") & (c("o_totalprice") > 100000)), "NOT (o_orderstatus = 'O' AND o_totalprice > 100000)")
over_table("or_filter", "orders", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR o_custkey = 3", lambda df: Query(df).filter(c("o_orderstatus") == "F").filter(c("o_totalprice") > 100000).or_filter(c("o_custkey") == 3).select("o_orderkey").run())
over_table("find_pk", "orders", "SELECT * FROM orders WHERE o_orderkey = 7", lambda df: Query(df).find("o_orderkey", 7).run())
over_table("find_composite_pk", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1", lambda df: Query(df).find(("l_orderkey", "l_linenumber"), (7, 1)).select("l_orderkey", "l_linenumber", "l_partkey").run())
over_table("select_expression", "lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 4) AS charge FROM lineitem", lambda df: df.select("l_orderkey", "l_linenumber", F.round(c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax")), 4).alias("charge")))
query("select_without_table", "SELECT 1 + 2 AS three, 'a' AS a")(lambda spark, d: spark.range(1).select((F.lit(1) + 2).alias("three"), F.lit("a").alias("a")))
query("dynamic_select", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")(lambda spark, d: dynamic_select(load(spark, d, "nation"), [("n_nationkey", "bigint"), ("n_name", "string")]))
query("raw_sql_bind", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'")(lambda spark, d: spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > :low AND o_orderstatus = :status", args={"low": 150000, "status": "O"}, orders=load(spark, d, "orders")))
over_table("case_when", "part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, CASE WHEN p_size > 40 THEN 1 END AS huge FROM part", lambda df: df.select("p_partkey", expr.case((c("p_size") < 10, "small"), (c("p_size") < 30, "medium"), otherwise="large").alias("size_class"), expr.case((c("p_size") > 40, 1)).alias("huge")))
over_table("arithmetic", "part", "SELECT p_partkey, p_size + 3 AS a, p_size - 3 AS s, p_size * 3 AS m, CAST(p_size // 3 AS BIGINT) AS q, -p_size AS neg FROM part", lambda df: df.select("p_partkey", (c("p_size") + 3).alias("a"), (c("p_size") - 3).alias("s"), (c("p_size") * 3).alias("m"), expr.int_div(c("p_size"), F.lit(3)).cast("bigint").alias("q"), (-c("p_size")).alias("neg")))
over_table("nullable_arithmetic", "part", "SELECT p_partkey, nullif(p_size, 10) + 1 AS v FROM part", lambda df: df.select("p_partkey", (F.nullif(c("p_size"), F.lit(10)) + 1).alias("v")))
over_table("cast_infallible", "part", "SELECT p_partkey, CAST(p_size AS BIGINT) AS b, CAST(p_size AS DOUBLE) AS d, CAST(p_size AS VARCHAR) AS s, CAST(p_size % 2 AS BOOLEAN) AS f FROM part", lambda df: df.select("p_partkey", c("p_size").cast("bigint").alias("b"), c("p_size").cast("double").alias("d"), c("p_size").cast("string").alias("s"), (c("p_size") % 2).cast("boolean").alias("f")))
over_table("cast_fallible", "part", "SELECT p_partkey, TRY_CAST(substr(p_name, 1, 2) AS INTEGER) AS n, CAST(CAST(p_size AS VARCHAR) AS INTEGER) AS back FROM part", lambda df: df.select("p_partkey", F.substring("p_name", 1, 2).try_cast("int").alias("n"), c("p_size").cast("string").cast("int").alias("back")))
over_table("cast_rounded", "part", "SELECT p_partkey, CAST(round(p_retailprice) AS BIGINT) AS n FROM part", lambda df: df.select("p_partkey", expr.cast_rounded(c("p_retailprice"), "bigint").alias("n")))

# ------------------------------------------------------------------ order, limit, distinct, pages

over_table("topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", lambda df: Query(df).select("o_orderkey", "o_totalprice").order(c("o_totalprice").desc()).then_order_by(c("o_orderkey")).limit(25).run())
over_table("offset_only", "nation", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey OFFSET 10", lambda df: Query(df).select("n_nationkey", "n_name").order(c("n_nationkey")).offset(10).run())
over_table("limit_offset", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20", lambda df: Query(df).select("o_orderkey").order(c("o_orderkey")).limit(10).offset(20).run())
over_table("nulls_first", "part", "SELECT p_partkey, nullif(p_size, 7) AS s FROM part ORDER BY s ASC NULLS FIRST, p_partkey", lambda df: Query(df).select("p_partkey", F.nullif(c("p_size"), F.lit(7)).alias("s")).order(c("s").asc_nulls_first(), c("p_partkey")).run())
over_table("nulls_last", "part", "SELECT p_partkey, nullif(p_size, 50) AS s FROM part ORDER BY s DESC NULLS LAST, p_partkey", lambda df: Query(df).select("p_partkey", F.nullif(c("p_size"), F.lit(50)).alias("s")).order(c("s").desc_nulls_last(), c("p_partkey")).run())
over_table("nulls_first_whole", "part", "SELECT p_partkey, nullif(p_size, 7) AS s FROM part ORDER BY s ASC NULLS FIRST, p_partkey", lambda df: df.select("p_partkey", F.nullif(c("p_size"), F.lit(7)).alias("s")).orderBy(c("s").asc_nulls_first(), "p_partkey"))
over_table("nulls_last_whole", "part", "SELECT p_partkey, nullif(p_size, 50) AS s FROM part ORDER BY s DESC NULLS LAST, p_partkey", lambda df: df.select("p_partkey", F.nullif(c("p_size"), F.lit(50)).alias("s")).orderBy(c("s").desc_nulls_last(), "p_partkey"))
over_table("distinct", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", lambda df: Query(df).select("o_orderstatus", "o_orderpriority").distinct().run())
over_table("distinct_on", "orders", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey", lambda df: Query(df).select("o_custkey", "o_orderkey", "o_totalprice").distinct_on("o_custkey").order(c("o_custkey"), c("o_totalprice").desc(), c("o_orderkey")).run())
over_table("top_per_group", "orders", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2", lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy(c("o_totalprice").desc(), "o_orderkey"))).where("r <= 2").select("o_custkey", "o_orderkey"))
over_table("pagination_total", "orders", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10 OFFSET 10", lambda df: Query(df).filter(c("o_orderstatus") == "F").select("o_orderkey").order(c("o_orderkey")).paginate(2, 10))
over_table("count_query", "orders", "SELECT count(*) AS count FROM orders WHERE o_totalprice > 100000", lambda df: Query(df).filter(c("o_totalprice") > 100000).order(c("o_orderkey")).count())
over_table("exists_query", "orders", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000) AS \"exists\"", lambda df: Query(df).filter(c("o_totalprice") > 100000).exists())

# ------------------------------------------------------------------ joins and subqueries

query("inner_join_fk", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")(lambda s, d: Query(load(s, d, "orders")).inner_join(load(s, d, "customer"), c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name").run())
query("left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000")(lambda s, d: Query(load(s, d, "customer")).left_join(load(s, d, "orders"), (c("o_custkey") == c("c_custkey")) & (c("o_totalprice") > 200000)).select("c_custkey", "o_orderkey").run())
query("left_join_null_side", "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")(lambda s, d: load(s, d, "customer").join(load(s, d, "orders"), c("o_custkey") == c("c_custkey"), "left").where(c("o_orderkey").isNull()).select("c_custkey"))
query("multi_join", "SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")(lambda s, d: load(s, d, "orders").join(load(s, d, "customer"), c("o_custkey") == c("c_custkey")).join(load(s, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(load(s, d, "region"), c("n_regionkey") == c("r_regionkey")).where(c("r_name") == "ASIA").select("o_orderkey", "n_name", "r_name"))
query("self_join_alias", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")(lambda s, d: load(s, d, "nation").alias("a").join(load(s, d, "nation").alias("b"), (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("left_name"), c("b.n_name").alias("right_name")))
query("semi_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")(lambda s, d: expr.exists_in(load(s, d, "customer"), load(s, d, "orders").where("o_totalprice > 150000"), c("c_custkey") == c("o_custkey")).select("c_custkey", "c_name"))
query("anti_not_exists", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")(lambda s, d: expr.not_exists_in(load(s, d, "customer"), load(s, d, "orders"), c("c_custkey") == c("o_custkey")).select("c_custkey", "c_name"))
query("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")(lambda s, d: s.sql("SELECT o_orderkey FROM {o} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5D FROM {o})", o=load(s, d, "orders")))
query("correlated_scalar", "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation")(lambda s, d: load(s, d, "nation").join(load(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("k")), c("n_nationkey") == c("c_nationkey"), "left").select("n_name", F.coalesce("k", F.lit(0)).alias("n")))
query("association_children", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")(lambda s, d: grouped_by(load(s, d, "customer").select("c_custkey"), load(s, d, "orders").select("o_orderkey", "o_custkey"), "c_custkey", "o_custkey", "orders", "o_orderkey").select("c_custkey", F.size("orders").cast("bigint").alias("n"), arrays.to_string(F.transform("orders", lambda o: o["o_orderkey"]), ",").alias("keys")))

# ------------------------------------------------------------------ aggregates

over_table("agg_basic", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY ALL", lambda df: df.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last")))
over_table("agg_global_empty", "orders", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE false", lambda df: df.where(F.lit(False)).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"), F.max("o_orderkey").alias("m")))
over_table("agg_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag", lambda df: df.groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("n"), aggregates.distinct_sum(c("l_linenumber")).alias("s")))
over_table("agg_filter", "orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS open_sum FROM orders GROUP BY o_orderpriority", lambda df: df.groupBy("o_orderpriority").agg(aggregates.count_rows(c("o_orderstatus") == "F").alias("done"), F.round(aggregates.filtered(F.sum, c("o_totalprice"), c("o_orderstatus") == "O"), 2).alias("open_sum")))
over_table("agg_ordered", "orders", "SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderdate, o_orderkey) AS statuses FROM orders GROUP BY o_custkey", lambda df: df.groupBy("o_custkey").agg(aggregates.ordered_text(c("o_orderstatus"), "", c("o_orderdate"), c("o_orderkey")).alias("statuses")))
over_table("agg_ordered_by", "orders", "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderstatus DESC, nullif(o_orderpriority, '5-LOW') ASC NULLS FIRST, o_orderkey DESC) AS keys FROM orders GROUP BY o_custkey", lambda df: df.groupBy("o_custkey").agg(aggregates.ordered_text(c("o_orderkey").cast("string"), ",", aggregates.By(c("o_orderstatus"), descending=True), aggregates.By(F.nullif(c("o_orderpriority"), F.lit("5-LOW")), nulls_first=True), aggregates.By(c("o_orderkey"), descending=True)).alias("keys")))
over_table("group_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000", lambda df: Query(df).group_by("o_custkey").aggregate(F.count("*").alias("n"), F.max("o_totalprice").alias("m")).having(c("n") > 99).having((c("n") > 12) & (c("m") > 100000)).select("o_custkey", "n").run())
over_table("count_nullable", "part", "SELECT p_brand, count(nullif(p_size, 10)) AS n, count(*) AS all_rows FROM part GROUP BY p_brand", lambda df: df.groupBy("p_brand").agg(F.count(F.nullif(c("p_size"), F.lit(10))).alias("n"), F.count("*").alias("all_rows")))

# ------------------------------------------------------------------ windows


def by_customer() -> Window:
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
_WHOLE = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def windowed(name: str, build: Callable[[], Column], sql: str) -> None:
    over_table(f"win_{name}", "orders", f"SELECT o_orderkey, {sql} AS v FROM orders", lambda df: df.select("o_orderkey", build().alias("v")))


windowed("row_number", lambda: F.row_number().over(by_customer()).cast("bigint"), f"row_number() {_OVER}")
windowed("rank", lambda: F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderstatus")).cast("bigint"), "rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus)")
windowed("dense_rank", lambda: F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderstatus")).cast("bigint"), "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus)")
windowed("percent_rank", lambda: F.round(F.percent_rank().over(by_customer()), 8), f"round(percent_rank() {_OVER}, 8)")
windowed("cume_dist", lambda: F.round(F.cume_dist().over(by_customer()), 8), f"round(cume_dist() {_OVER}, 8)")
windowed("ntile", lambda: F.ntile(3).over(by_customer()).cast("bigint"), f"ntile(3) {_OVER}")
windowed("lag", lambda: F.lag("o_totalprice").over(by_customer()), f"lag(o_totalprice) {_OVER}")
windowed("lag_offset", lambda: F.lag("o_totalprice", 2).over(by_customer()), f"lag(o_totalprice, 2) {_OVER}")
windowed("lag_default", lambda: F.expr("lag(o_totalprice, 1, cast(o_orderkey as double))").over(by_customer()), f"lag(o_totalprice, 1, CAST(o_orderkey AS DOUBLE)) {_OVER}")
windowed("lead", lambda: F.lead("o_totalprice").over(by_customer()), f"lead(o_totalprice) {_OVER}")
windowed("lead_offset", lambda: F.lead("o_totalprice", 2).over(by_customer()), f"lead(o_totalprice, 2) {_OVER}")
windowed("lead_default", lambda: F.expr("lead(o_totalprice, 1, cast(o_orderkey as double))").over(by_customer()), f"lead(o_totalprice, 1, CAST(o_orderkey AS DOUBLE)) {_OVER}")
windowed("first_value", lambda: F.first_value("o_orderkey").over(by_customer()), f"first_value(o_orderkey) {_OVER}")
windowed("last_value", lambda: F.last_value("o_orderkey").over(by_customer().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), f"last_value(o_orderkey) {_WHOLE}")
windowed("nth_value", lambda: F.nth_value("o_orderkey", 3).over(by_customer()), f"nth_value(o_orderkey, 3) {_OVER}")
windowed("sum_partition", lambda: F.round(F.sum("o_totalprice").over(Window.partitionBy("o_custkey")), 2), "round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2)")
windowed("rows_between", lambda: F.round(F.sum("o_totalprice").over(by_customer().rowsBetween(-2, 1)), 2), "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2)")
windowed("range_between", lambda: F.count("*").over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-500, 500)), "count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING)")
windowed("filter", lambda: windows.window_filter(F.count, F.lit(1), c("o_orderstatus") == "F", by_customer()), f"count(*) FILTER (WHERE o_orderstatus = 'F') {_OVER}")
windowed("exclude_current_sum", lambda: F.round(windows.without_current(F.sum, windows.added, c("o_totalprice"), ["o_custkey"], [c("o_orderkey")]), 2), "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 2)")
over_table("win_groups", "lineitem", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_returnflag GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v FROM lineitem", lambda df: windows.groups_between(df, ["l_orderkey"], [c("l_returnflag")], -1, 0, "v", F.count("*")).select("l_orderkey", "l_linenumber", "v"))
for _kind, _sql in (("current", "CURRENT ROW"), ("group", "GROUP"), ("ties", "TIES"), ("no others", "NO OTHERS")):
    for _frame, _order, _start, _end in (("groups", "l_returnflag", -1, 1), ("rows", "l_returnflag, l_linenumber, l_partkey, l_extendedprice", -2, 1), ("range", "l_suppkey", -40, 40)):
        over_table(
            f"win_exclude_{_kind.replace(' ', '_')}" + ("" if _frame == "groups" else f"_{_frame}"),
            "lineitem",
            f"SELECT l_orderkey, l_linenumber, count(l_quantity) OVER w AS n, round(sum(l_quantity) OVER w, 2) AS s FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_order} {_frame} BETWEEN {-_start} PRECEDING AND {_end} FOLLOWING EXCLUDE {_sql})",
            lambda df, kind=_kind, frame=(_frame, _start, _end), order=_order: windows.excluding_sums(df, ["l_orderkey"], [c(o.strip()) for o in order.split(",")], frame, kind, c("l_quantity"), "n", "s").select("l_orderkey", "l_linenumber", "n", F.round("s", 2).alias("s")),
        )
over_table(
    "win_exclude_list",
    "lineitem",
    "SELECT l_orderkey, l_linenumber, array_to_string(list(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), ',') AS v FROM lineitem",
    lambda df: windows.excluding(df, ["l_orderkey"], [c("l_linenumber"), c("l_partkey")], ("rows", -2, 2), "current", c("l_partkey"), lambda a: F.when(F.size(a) > 0, arrays.to_string(a, ",")), "v").select("l_orderkey", "l_linenumber", "v"),
)

# ------------------------------------------------------------------ set operations


def both_sides(name: str, sql: str, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    query(f"set_{name}", f"SELECT c_nationkey AS k FROM customer {sql} SELECT s_nationkey AS k FROM supplier")(
        lambda s, d: combine(load(s, d, "customer").select(c("c_nationkey").alias("k")), load(s, d, "supplier").select(c("s_nationkey").alias("k")))
    )


both_sides("union", "UNION", lambda a, b: a.union(b).distinct())
both_sides("union_all", "UNION ALL", lambda a, b: a.union(b))
both_sides("intersect", "INTERSECT", lambda a, b: a.intersect(b))
both_sides("intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b))
both_sides("except", "EXCEPT", lambda a, b: a.subtract(b))
both_sides("except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b))


def whole_sides(name: str, sql: str, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    query(f"set_{name}_whole", f"SELECT c_custkey AS k, c_nationkey AS n FROM customer {sql} SELECT s_suppkey AS k, s_nationkey AS n FROM supplier")(
        lambda s, d: combine(load(s, d, "customer").select(c("c_custkey").alias("k"), c("c_nationkey").alias("n")), load(s, d, "supplier").select(c("s_suppkey").alias("k"), c("s_nationkey").alias("n")))
    )


whole_sides("union", "UNION", lambda a, b: a.union(b).distinct())
whole_sides("union_all", "UNION ALL", lambda a, b: a.union(b))
whole_sides("intersect", "INTERSECT", lambda a, b: a.intersect(b))
whole_sides("intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b))
whole_sides("except", "EXCEPT", lambda a, b: a.subtract(b))
whole_sides("except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b))
query("set_union_order_limit", "SELECT * FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier) ORDER BY k DESC LIMIT 5 OFFSET 2")(lambda s, d: load(s, d, "customer").select(c("c_nationkey").alias("k")).union(load(s, d, "supplier").select("s_nationkey")).distinct().orderBy(c("k").desc()).offset(2).limit(5))

# ------------------------------------------------------------------ text, dates


def parts_where(name: str, condition: Callable[[], Column], sql: str) -> None:
    over_table(name, "part", f"SELECT p_partkey, p_name FROM part WHERE {sql}", lambda df: df.where(condition()).select("p_partkey", "p_name"))


parts_where("like", lambda: c("p_name").like("%re%"), "p_name LIKE '%re%'")
parts_where("not_like", lambda: ~c("p_name").like("%re%"), "p_name NOT LIKE '%re%'")
parts_where("like_escape", lambda: expr.like(F.concat("p_brand", F.lit("_x%")), "%!_x!%", "!"), "p_brand || '_x%' LIKE '%!_x!%' ESCAPE '!'")
parts_where("ilike", lambda: expr.ilike(c("p_brand"), "brand#1%"), "p_brand ILIKE 'brand#1%'")
parts_where("not_ilike", lambda: ~expr.ilike(c("p_brand"), "brand#1%"), "p_brand NOT ILIKE 'brand#1%'")
parts_where("similar_to", lambda: expr.similar_to(c("p_brand"), "Brand#(1|2)%"), "regexp_full_match(p_brand, 'Brand#(1|2).*')")
parts_where("not_similar_to", lambda: ~expr.similar_to(c("p_brand"), "Brand#(1|2)_"), "NOT regexp_full_match(p_brand, 'Brand#(1|2).')")
parts_where("collate_nocase", lambda: F.collate(c("p_brand"), "UTF8_LCASE") == F.lit("BRAND#12"), "lower(p_brand) = 'brand#12'")
parts_where("collate_rtrim", lambda: F.collate(F.concat("p_brand", F.lit("  ")), "UTF8_BINARY_RTRIM") == F.lit("Brand#12"), "rtrim(p_brand || '  ') = 'Brand#12'")
over_table("text_concat", "part", "SELECT p_partkey, p_brand || ':' || nullif(p_type, 'x') AS v FROM part", lambda df: df.select("p_partkey", F.concat("p_brand", F.lit(":"), F.nullif(c("p_type"), F.lit("x"))).alias("v")))
over_table("binary_like", "part", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%'", lambda df: df.where(expr.binary_like(c("p_name").cast("binary"), "%a%")).select("p_partkey"))
over_table("date_functions", "orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderdate + INTERVAL 3 DAY AS later, o_orderdate + INTERVAL 2 MONTH AS months_on, o_orderdate - INTERVAL 90 MINUTE AS sooner, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders", lambda df: df.select("o_orderkey", temporal.date(c("o_orderdate")).alias("day"), (c("o_orderdate") + temporal.days(3)).alias("later"), (c("o_orderdate") + temporal.months(2)).alias("months_on"), (c("o_orderdate") - temporal.minutes(90)).alias("sooner"), temporal.date_minus_date(temporal.date(c("o_orderdate")), F.lit("1995-01-01").cast("date")).alias("days")))
over_table("bytes_concat", "part", "SELECT p_partkey, hex(encode(p_name) || encode(nullif(p_brand, 'Brand#12'))) AS v FROM part", lambda df: df.select("p_partkey", F.hex(expr.bytes_concat(c("p_name"), F.nullif(c("p_brand"), F.lit("Brand#12")))).alias("v")))
over_table("now_today", "orders", "SELECT o_orderkey, o_orderdate < CAST(now() AS TIMESTAMP) AS past, CAST(o_orderdate AS DATE) >= today() AS ahead, CAST(now() AS TIMESTAMP) >= CAST(today() AS TIMESTAMP) AS same FROM orders", lambda df: df.select("o_orderkey", (c("o_orderdate") < temporal.now()).alias("past"), (temporal.date(c("o_orderdate")) >= temporal.today()).alias("ahead"), (temporal.now() >= temporal.today().cast("timestamp_ntz")).alias("same")))
over_table("intervals", "orders", "SELECT o_orderkey, o_orderdate + (INTERVAL 3 DAY + INTERVAL 36 HOUR) AS a, o_orderdate - (INTERVAL 2 YEAR - INTERVAL 5 MONTH) AS b, o_orderdate + INTERVAL 2 WEEK + INTERVAL 90 SECOND AS w FROM orders", lambda df: df.select("o_orderkey", (c("o_orderdate") + temporal.intervals_added(temporal.days(3), temporal.hours(36))).alias("a"), (c("o_orderdate") - temporal.intervals_added(temporal.years(2), temporal.months(5), -1)).alias("b"), (c("o_orderdate") + temporal.weeks(2) + temporal.seconds(90)).alias("w")))
over_table("time_plus_interval", "events", "SELECT event_id, CAST(CAST(date_trunc('second', ts) AS TIME) + INTERVAL 400 MINUTE AS VARCHAR) AS v FROM events", lambda df: df.select("event_id", temporal.time_plus(temporal.time_of(c("ts")), temporal.minutes(400)).alias("v")))
over_table("date_plus_interval", "orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 36 HOUR AS v FROM orders", lambda df: df.select("o_orderkey", temporal.date_plus(temporal.date(c("o_orderdate")), temporal.hours(36)).alias("v")))
over_table("at_time_zone", "events", "SELECT event_id, (ts AT TIME ZONE 'Asia/Tokyo') AT TIME ZONE 'UTC' AS v FROM events", lambda df: df.select("event_id", temporal.at_time_zone(c("ts"), "Asia/Tokyo").alias("v")))

# ------------------------------------------------------------------ arrays

_LISTS = "(SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a, list(nullif(l_linenumber, 2) ORDER BY l_linenumber) AS b FROM lineitem GROUP BY l_orderkey)"


def lists(df: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list("l_linenumber"))
    return df.groupBy("l_orderkey").agg(ordered.alias("a")).withColumn("b", F.transform("a", lambda x: F.nullif(x, F.lit(2))))


def array_query(name: str, build: Callable[[], Column], sql: str, as_text: bool = False) -> None:
    shown = (lambda v: arrays.to_string(v, ",", "~")) if as_text else (lambda v: v)
    text = f"array_to_string([coalesce(CAST(x AS VARCHAR), '~') FOR x IN {sql}], ',')" if as_text else sql
    over_table(f"array_{name}", "lineitem", f"SELECT l_orderkey, {text} AS v FROM {_LISTS}", lambda df: lists(df).select("l_orderkey", shown(build()).alias("v")))


def ints(*values: int | None) -> Column:
    return F.array(*[F.lit(v).cast("int") for v in values])


#: Empty where an order has no line past the second.
_SOME, _some = "list_filter(a, lambda x: x > 2)", lambda: F.filter("a", lambda x: x > 2)
array_query("overlaps", lambda: arrays.overlaps(c("a"), ints(3, 9)), "list_has_any(a, [3, 9])")
array_query("contains", lambda: arrays.contains(c("a"), ints(1, 3)), "list_has_all(a, [1, 3])")
array_query("contained_by", lambda: arrays.contained_by(c("a"), ints(1, 2, 3)), "list_has_all([1, 2, 3], a)")
array_query("index", lambda: arrays.index(c("a"), 3), "a[3]")
array_query("slice", lambda: arrays.slice_(c("a"), 2, 3), "a[2:3]", True)
array_query("slice_from", lambda: arrays.slice_(c("a"), 2), "a[2:]", True)
array_query("slice_to", lambda: arrays.slice_(c("a"), None, 2), "a[:2]", True)
array_query("concat", lambda: arrays.concat(c("a"), c("b")), "list_concat(a, b)", True)
array_query("append", lambda: arrays.append(c("a"), F.lit(9)), "list_append(a, 9)", True)
array_query("prepend", lambda: arrays.prepend(F.lit(9), c("a")), "list_prepend(9, a)", True)
array_query("replace", lambda: arrays.replace(c("b"), F.lit(None), F.lit(0)), "[coalesce(x, 0) FOR x IN b]", True)
array_query("remove", lambda: arrays.remove(c("a"), F.lit(2)), "list_filter(a, lambda x: x <> 2)", True)
array_query("dims", lambda: arrays.dims(c("a")), "'[1:' || len(a) || ']'")
array_query("ndims", lambda: arrays.ndims(_some()), f"CASE WHEN len({_SOME}) > 0 THEN 1 END")
array_query("cardinality", lambda: arrays.cardinality(c("b")).cast("bigint"), "len(b)")
array_query("length", lambda: arrays.length(c("a")).cast("bigint"), "len(a)")
array_query("length_2", lambda: F.coalesce(arrays.length(_some(), 2), arrays.length(_some())).cast("bigint"), f"CAST(nullif(len({_SOME}), 0) AS BIGINT)")
array_query("lower", lambda: arrays.lower(_some()), f"CASE WHEN len({_SOME}) > 0 THEN 1 END")
array_query("upper", lambda: arrays.upper(c("a")).cast("bigint"), "len(a)")
array_query("trim", lambda: arrays.trim(c("a"), 1), "a[:len(a) - 1]", True)
array_query("fill", lambda: arrays.fill(F.lit(7), 3), "[7, 7, 7]", True)
array_query("position", lambda: arrays.position(c("a"), F.lit(3)).cast("bigint"), "CAST(nullif(list_position(a, 3), 0) AS BIGINT)")
array_query("position_null", lambda: arrays.position(c("b"), F.lit(None)).cast("bigint"), "CAST(list_filter(list_transform(b, lambda x, i: CASE WHEN x IS NULL THEN i END), lambda i: i IS NOT NULL)[1] AS BIGINT)")
array_query("position_from", lambda: arrays.position(F.concat("a", "a"), F.lit(1), 2).cast("bigint"), "CAST(list_filter(list_filter(list_transform(list_concat(a, a), lambda x, i: CASE WHEN x = 1 THEN i END), lambda i: i IS NOT NULL), lambda i: i >= 2)[1] AS BIGINT)")
array_query("positions", lambda: arrays.positions(F.concat("a", "a"), F.lit(1)), "list_filter(list_transform(list_concat(a, a), lambda x, i: CASE WHEN x = 1 THEN i END), lambda i: i IS NOT NULL)", True)
array_query("assign", lambda: arrays.assign(c("a"), 1, F.lit(5)), "list_prepend(5, a[2:])", True)
array_query("to_string", lambda: arrays.to_string(c("b"), "-"), "array_to_string(list_filter(b, lambda x: x IS NOT NULL), '-')")
array_query("to_string_null", lambda: arrays.to_string(c("b"), "-", "*"), "array_to_string([coalesce(CAST(x AS VARCHAR), '*') FOR x IN b], '-')")
array_query("to_json", lambda: arrays.to_json(c("b")), "CAST(to_json(b) AS VARCHAR)")
array_query("shuffle_sorted", lambda: F.array_sort(arrays.shuffle(c("a"))), "a", True)
array_query("sample_size", lambda: F.size(arrays.sample(c("a"), 2)).cast("bigint"), "CAST(least(len(a), 2) AS BIGINT)")

# ------------------------------------------------------------------ ranges


def range_query(name: str, build: Callable[[], Column], sql: str) -> None:
    """Over r = [p_size, p_size + 10] and q = [25, 35)."""
    over_table(f"range_{name}", "part", f"SELECT p_partkey, {sql} AS v FROM part", lambda df: df.withColumn("r", ranges.int_range(c("p_size"), c("p_size") + 10, "[]")).withColumn("q", ranges.int_range(F.lit(25), F.lit(35))).select("p_partkey", build().alias("v")))


_TEXT = lambda r: F.when(r["empty"], "empty").otherwise(F.concat(F.lit("["), r["lower"].cast("string"), F.lit(","), r["upper"].cast("string"), F.lit(")")))
#: By p_size % 4: (p_size,), [p_size,25] (empty past 25), [p_size,), (,p_size].
_mixed = lambda: F.when(c("p_size") % 4 == 0, ranges.make(c("p_size"), F.lit(None).cast("int"), "()")).when(c("p_size") % 4 == 1, ranges.make(c("p_size"), F.lit(25), "[]")).when(c("p_size") % 4 == 2, ranges.make(c("p_size"), F.lit(None).cast("int"))).otherwise(ranges.make(F.lit(None).cast("int"), c("p_size"), "(]"))
range_query("bounds", lambda: _TEXT(c("r")), "'[' || p_size || ',' || (p_size + 11) || ')'")
range_query("lower", lambda: ranges.lower(c("r")), "p_size")
range_query("upper", lambda: ranges.upper(c("r")), "p_size + 11")
range_query("lower_inc", lambda: ranges.lower_inc(_mixed()), "p_size % 4 NOT IN (0, 3) AND (p_size % 4 <> 1 OR p_size <= 25)")
range_query("upper_inc", lambda: ranges.upper_inc(_mixed()), "p_size % 4 = 1 AND p_size <= 25 OR p_size % 4 = 3")
range_query("lower_inf", lambda: ranges.lower_inf(_mixed()), "p_size % 4 = 3")
range_query("unbounded", lambda: ranges.upper_inf(_mixed()), "p_size % 4 IN (0, 2)")
range_query("overlaps_mixed", lambda: ranges.overlaps(_mixed(), ranges.make(F.lit(10), F.lit(25), "[]")), "CASE p_size % 4 WHEN 0 THEN p_size < 25 WHEN 1 THEN p_size <= 25 WHEN 2 THEN p_size <= 25 ELSE p_size >= 10 END")
range_query("contains_mixed", lambda: ranges.contains_range(_mixed(), c("q")), "CASE p_size % 4 WHEN 0 THEN p_size < 25 WHEN 1 THEN false WHEN 2 THEN p_size <= 25 ELSE p_size >= 35 END")
range_query("big", lambda: ranges.lower(ranges.int_range(c("p_partkey") * 4_000_000_000, c("p_partkey") * 5_000_000_000, "(]")), "CASE WHEN p_partkey > 0 THEN p_partkey * 4000000000 + 1 END")
range_query("numeric", lambda: ranges.contains(ranges.make(c("p_retailprice").cast("decimal(12,2)"), (c("p_retailprice") + 5).cast("decimal(12,2)"), "()"), F.lit("1000.00").cast("decimal(12,2)")), "CAST(p_retailprice AS DECIMAL(12,2)) < 1000 AND CAST(p_retailprice + 5 AS DECIMAL(12,2)) > 1000")
range_query("is_empty", lambda: ranges.is_empty(ranges.int_range(c("p_size"), F.lit(10))), "p_size >= 10")
range_query("contains", lambda: ranges.contains(c("r"), F.lit(30)), "30 BETWEEN p_size AND p_size + 10")
range_query("contains_range", lambda: ranges.contains_range(ranges.int_range(F.lit(20), F.lit(40)), c("r")), "p_size >= 20 AND p_size + 11 <= 40")
range_query("overlaps", lambda: ranges.overlaps(c("r"), c("q")), "p_size < 35 AND p_size + 11 > 25")
range_query("left_of", lambda: ranges.left_of(c("r"), c("q")), "p_size + 11 <= 25")
range_query("right_of", lambda: ranges.right_of(c("r"), c("q")), "p_size >= 35")
range_query("extends_right_to", lambda: ranges.extends_right_to(c("r"), c("q")), "p_size + 11 <= 35")
range_query("extends_left_to", lambda: ranges.extends_left_to(c("r"), c("q")), "p_size >= 25")
range_query("adjacent", lambda: ranges.adjacent(c("r"), c("q")), "p_size + 11 = 25 OR p_size = 35")
range_query("merge", lambda: _TEXT(ranges.merge(c("r"), c("q"))), "'[' || least(p_size, 25) || ',' || greatest(p_size + 11, 35) || ')'")
range_query("union", lambda: _TEXT(ranges.union(c("r"), ranges.int_range(c("p_size") + 5, c("p_size") + 20))), "'[' || p_size || ',' || (p_size + 20) || ')'")
range_query("intersection", lambda: _TEXT(ranges.intersection(c("r"), c("q"))), "CASE WHEN p_size < 35 AND p_size + 11 > 25 THEN '[' || greatest(p_size, 25) || ',' || least(p_size + 11, 35) || ')' ELSE 'empty' END")
range_query("difference", lambda: _TEXT(ranges.difference(c("r"), ranges.int_range(c("p_size") - 5, c("p_size") + 4))), "'[' || (p_size + 4) || ',' || (p_size + 11) || ')'")
range_query("multirange_merge", lambda: _TEXT(ranges.multirange_merge(F.array(ranges.int_range(F.lit(0), F.lit(1)), c("r")))), "'[0,' || (p_size + 11) || ')'")

over_table("range_dates", "orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 8 AS upper, CAST(o_orderdate AS DATE) <= DATE '1996-06-15' AND CAST(o_orderdate AS DATE) + 7 >= DATE '1996-06-15' AS holds FROM orders", lambda df: df.withColumn("r", ranges.date_range(temporal.date(c("o_orderdate")), F.date_add(temporal.date(c("o_orderdate")), 7), "[]")).select("o_orderkey", ranges.upper(c("r")).alias("upper"), ranges.contains(c("r"), F.lit("1996-06-15").cast("date")).alias("holds")))
over_table("range_times", "orders", "SELECT o_orderkey, o_orderdate <= TIMESTAMP '1996-06-15' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1996-06-15' AS v FROM orders", lambda df: df.select("o_orderkey", ranges.contains(ranges.make(c("o_orderdate"), c("o_orderdate") + temporal.days(30)), F.lit("1996-06-15").cast("timestamp_ntz")).alias("v")))
over_table("range_times_tz", "orders", "SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-06-15' AND o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1996-06-15' AS v FROM orders", lambda df: df.select("o_orderkey", ranges.contains(ranges.make(c("o_orderdate").cast("timestamp"), (c("o_orderdate") + temporal.days(30)).cast("timestamp"), "(]"), F.lit("1996-06-15").cast("timestamp_ntz").cast("timestamp")).alias("v")))

# ------------------------------------------------------------------ JSON



def json_query(name: str, build: Callable[[], Column], sql: str) -> None:
    over_table(f"json_{name}", "events", f"SELECT event_id, {sql} AS v FROM events", lambda df: df.select("event_id", build().alias("v")))


_DOC = lambda: F.concat(F.lit('{"id":'), c("event_id").cast("string"), F.lit(',"t":["'), c("event_type"), F.lit('",null,{"u":'), c("user_id").cast("string"), F.lit("}]}"))
_SQL_DOC = """('{"id":' || event_id || ',"t":["' || event_type || '",null,{"u":' || user_id || '}]}')"""
#: By event_id % 5: the object, its array, its number, a text, null.
_any = lambda: F.when(c("event_id") % 5 == 0, _DOC()).when(c("event_id") % 5 == 1, jsonfns.object_at(_DOC(), "t")).when(c("event_id") % 5 == 2, jsonfns.object_at(_DOC(), "id")).when(c("event_id") % 5 == 3, jsonfns.object_at(_DOC(), "t", 0)).otherwise("null")
json_query("text_at", lambda: jsonfns.text_at(_DOC(), "t", 0), f"json_extract_string({_SQL_DOC}, '$.t[0]')")
json_query("object_at", lambda: jsonfns.object_at(_DOC(), "t", 2), f"CAST(json_extract({_SQL_DOC}, '$.t[2]') AS VARCHAR)")
json_query("canonical", lambda: jsonfns.canonical(_DOC()), f"CAST(json({_SQL_DOC}) AS VARCHAR)")
json_query("is_json", lambda: jsonfns.is_json(c("props")) & ~jsonfns.is_json(c("event_type")), "json_valid(props) AND NOT json_valid(event_type)")
json_query("is_object", lambda: jsonfns.is_object(c("props")), "json_type(props) = 'OBJECT'")
json_query("is_array", lambda: jsonfns.is_array(_any()), "event_id % 5 = 1")
json_query("is_scalar", lambda: jsonfns.is_scalar(_any()), "event_id % 5 >= 2")
json_query("type_of", lambda: jsonfns.type_of(_any()), "list_extract(['object', 'array', 'number', 'string', 'null'], event_id % 5 + 1)")
json_query("has_key", lambda: jsonfns.has_key(_DOC(), "t"), f"list_contains(json_keys({_SQL_DOC}), 't')")
json_query("has_any_key", lambda: jsonfns.has_any_key(_any(), ["x", "id", "click"]), "event_id % 5 = 0 OR event_id % 5 IN (1, 3) AND event_type = 'click'")
json_query("has_all_keys", lambda: jsonfns.has_all_keys(_any(), ["t", "id"]), "event_id % 5 = 0")
json_query("has_key_array", lambda: jsonfns.has_key(_any(), "click"), "event_id % 5 IN (1, 3) AND event_type = 'click'")
json_query("is_not_json", lambda: ~jsonfns.is_json(F.when(c("event_id") % 2 == 0, c("props")).otherwise(c("event_type"))), "event_id % 2 <> 0")
json_query("is_not_object", lambda: ~jsonfns.is_object(_any()), "event_id % 5 <> 0")
json_query("contained_by", lambda: jsonfns.is_contained_by(F.concat(F.lit('{"u":'), (c("user_id") - c("event_id") % 2).cast("string"), F.lit("}")), jsonfns.object_at(_DOC(), "t", 2)), "event_id % 2 = 0")
json_query("contains_column", lambda: jsonfns.contains(_DOC(), F.concat(F.lit('{"id":'), (c("event_id") - c("event_id") % 2).cast("string"), F.lit("}"))), "event_id % 2 = 0")
json_query("concat_column", lambda: jsonfns.concat(F.concat(F.lit('{"a":'), c("event_id").cast("string"), F.lit("}")), F.concat(F.lit('{"b":'), c("user_id").cast("string"), F.lit("}"))), """'{"a":' || event_id || ',"b":' || user_id || '}'""")
json_query("merge_patch_column", lambda: jsonfns.merge_patch(F.lit('{"a":1,"b":2}'), F.concat(F.lit('{"a":null,"c":'), c("event_id").cast("string"), F.lit("}"))), """'{"b":2,"c":' || event_id || '}'""")
json_query("dotted_key", lambda: jsonfns.text_at(F.concat(F.lit('{"a.b":'), c("event_id").cast("string"), F.lit("}")), "a.b"), "CAST(event_id AS VARCHAR)")
json_query("integer_at", lambda: jsonfns.integer_at(_any(), "id"), "CASE WHEN event_id % 5 = 0 THEN event_id END")
json_query("double_at", lambda: jsonfns.double_at(F.concat(F.lit('{"x":'), (c("event_id") / 4).cast("string"), F.lit("}")), "x"), "event_id / 4")
json_query("insert_paths", lambda: jsonfns.insert_paths(_DOC(), ("$.id", "0"), ("$.t[#]", c("user_id").cast("string")), ("$.new", '"v"')), """'{"id":' || event_id || ',"new":"v","t":["' || event_type || '",null,{"u":' || user_id || '},' || user_id || ']}'""")
json_query("replace_paths", lambda: jsonfns.replace_paths(_DOC(), ("$.id", "0"), ("$.t[#-1].u", c("event_id").cast("string")), ("$.new", '"v"')), """'{"id":0,"t":["' || event_type || '",null,{"u":' || event_id || '}]}'""")
json_query("set_paths", lambda: jsonfns.set_paths(_DOC(), ("$.t[1]", c("user_id").cast("string")), ("$.new", "[]")), """'{"id":' || event_id || ',"new":[],"t":["' || event_type || '",' || user_id || ',{"u":' || user_id || '}]}'""")
json_query("remove_paths", lambda: jsonfns.remove_paths(_DOC(), "$.t[0]", "$.t[0]", "$.id", "$.none.x"), """'{"t":[{"u":' || user_id || '}]}'""")
json_query("set_create", lambda: jsonfns.set_at(_DOC(), ["new"], "1", create=False), """'{"id":' || event_id || ',"t":["' || event_type || '",null,{"u":' || user_id || '}]}'""")
json_query("insert_before", lambda: jsonfns.insert_at(F.concat(F.lit("["), c("event_id").cast("string"), F.lit("]")), [0], "7"), "'[7,' || event_id || ']'")
json_query("object_of_pairs", lambda: jsonfns.object_of_pairs(F.array(F.lit("a"), c("event_id").cast("string"), F.lit("b"), F.nullif(c("event_type"), F.lit("click")))), "CAST(json_object('a', CAST(event_id AS VARCHAR), 'b', nullif(event_type, 'click')) AS VARCHAR)")
json_query("scalar", lambda: jsonfns.scalar(F.nullif(c("event_type"), F.lit("click"))), "coalesce(CAST(to_json(nullif(event_type, 'click')) AS VARCHAR), 'null')")
json_query("pretty_indent", lambda: jsonfns.pretty(F.concat(F.lit("["), c("event_id").cast("string"), F.lit("]")), 2), "'[' || chr(10) || '  ' || event_id || chr(10) || ']'")
over_table("json_group_array", "events", "SELECT user_id, CAST(to_json(list(nullif(event_type, 'click') ORDER BY event_id)) AS VARCHAR) AS v, coalesce(CAST(to_json(list(event_id ORDER BY event_id) FILTER (WHERE event_type = 'view')) AS VARCHAR), '[]') AS w FROM events GROUP BY user_id", lambda df: df.groupBy("user_id").agg(jsonfns.group_array(F.nullif(c("event_type"), F.lit("click")), c("event_id")).alias("v"), jsonfns.group_array(c("event_id"), c("event_id"), where=c("event_type") == "view").alias("w")))
over_table("json_group_object", "events", "SELECT user_id, '{' || string_agg('\"' || event_id || '\":' || coalesce('\"' || nullif(event_type, 'click') || '\"', 'null'), ',' ORDER BY event_id) || '}' AS v FROM events GROUP BY user_id", lambda df: df.groupBy("user_id").agg(jsonfns.group_object(c("event_id"), F.nullif(c("event_type"), F.lit("click")), c("event_id")).alias("v")))
json_query("array_length", lambda: jsonfns.array_length(jsonfns.object_at(_DOC(), "t")).cast("bigint"), f"CAST(json_array_length({_SQL_DOC}, '$.t') AS BIGINT)")
json_query("build_array", lambda: jsonfns.build_array(c("event_id"), c("event_type"), F.lit(None).cast("int")), "CAST(json_array(event_id, event_type, NULL) AS VARCHAR)")
json_query("object_of", lambda: jsonfns.object_of(F.array(F.lit("a"), F.lit("b")), F.array(c("event_id"), c("user_id"))), "CAST(json_object('a', event_id, 'b', user_id) AS VARCHAR)")
json_query("row_to_json", lambda: jsonfns.row_to_json(c("event_id"), c("event_type")), "CAST(json_object('event_id', event_id, 'event_type', event_type) AS VARCHAR)")
json_query("populate", lambda: jsonfns.populate(_DOC(), "id BIGINT")["id"], "event_id")
json_query("merge_patch", lambda: jsonfns.merge_patch(_DOC(), '{"t": null, "z": {"y": 1}}'), """CAST(json_merge_patch('{"id":' || event_id || '}', '{"z":{"y":1}}') AS VARCHAR)""")
json_query("contains", lambda: jsonfns.contains(_DOC(), '{"t": ["click"]}'), "event_type = 'click'")
json_query("remove", lambda: jsonfns.remove(_DOC(), "t"), """'{"id":' || event_id || '}'""")
json_query("set_at", lambda: jsonfns.set_at(_DOC(), ["t"], "[1]"), """'{"id":' || event_id || ',"t":[1]}'""")
json_query("set_lax", lambda: jsonfns.set_lax(_DOC(), ["t"], None, "delete_key"), """'{"id":' || event_id || '}'""")
json_query("insert_at", lambda: jsonfns.text_at(jsonfns.insert_at(_DOC(), ["t", 0], '"new"', after=True), "t", 1), "'new'")
json_query("strip_nulls", lambda: jsonfns.strip_nulls(F.concat(F.lit('{"a":null,"b":'), c("event_id").cast("string"), F.lit("}"))), """'{"b":' || event_id || '}'""")
json_query("concat", lambda: jsonfns.concat(F.concat(F.lit('{"a":'), c("event_id").cast("string"), F.lit("}")), '{"b":2}'), """'{"a":' || event_id || ',"b":2}'""")
json_query("pretty", lambda: jsonfns.pretty(F.concat(F.lit('{"a":'), c("event_id").cast("string"), F.lit("}"))), """'{' || chr(10) || '    "a": ' || event_id || chr(10) || '}'""")
json_query("error_position", lambda: jsonfns.error_position(F.concat(F.lit("["), c("event_id").cast("string"), F.lit(",}"))), "CAST(length(CAST(event_id AS VARCHAR)) + 3 AS INTEGER)")

# ------------------------------------------------------------------ networks


def net_query(name: str, build: Callable[[Column], Column], sql: str, mixed: bool = False) -> None:
    """Over u = user_id % 200 and h = event_id % 250: 10.0.<u>.<h>/24, or, if mixed, fd00::<u>:1/64, 10.0.<u>.<h> and 10.0.<u>.<h>/20 by h % 3."""

    def address() -> Column:
        plain = F.concat_ws(".", F.lit("10.0"), (c("user_id") % 200).cast("string"), (c("event_id") % 250).cast("string"))
        if not mixed:
            return F.concat(plain, F.lit("/24"))
        kind = c("event_id") % 250 % 3
        six = F.concat(F.lit("fd00::"), (c("user_id") % 200).cast("string"), F.lit(":1/64"))
        return F.when(kind == 0, six).when(kind == 1, plain).otherwise(F.concat(plain, F.lit("/20")))

    over_table(f"net_{name}", "events", f"WITH e AS (SELECT event_id, user_id % 200 AS u, event_id % 250 AS h FROM events) SELECT event_id, {sql} AS v FROM e", lambda df: df.select("event_id", address().alias("a")).select("event_id", build(c("a")).alias("v")))


net_query("family", lambda a: net.family(a), "CASE WHEN h % 3 = 0 THEN 6 ELSE 4 END", mixed=True)
net_query("host", lambda a: net.host(a), "'10.0.' || u || '.' || h")
net_query("masklen", lambda a: net.masklen(a), "CASE h % 3 WHEN 0 THEN 64 WHEN 1 THEN 32 ELSE 20 END", mixed=True)
net_query("set_masklen", lambda a: net.set_masklen(a, 16), "'10.0.' || u || '.' || h || '/16'")
net_query("netmask", lambda a: net.netmask(a), "CASE h % 3 WHEN 0 THEN 'ffff:ffff:ffff:ffff::' WHEN 1 THEN '255.255.255.255' ELSE '255.255.240.0' END", mixed=True)
net_query("hostmask", lambda a: net.hostmask(a), "CASE h % 3 WHEN 0 THEN '::ffff:ffff:ffff:ffff' WHEN 1 THEN '0.0.0.0' ELSE '0.0.15.255' END", mixed=True)
net_query("network", lambda a: net.network(a), "'10.0.' || u || '.0/24'")
net_query("broadcast", lambda a: net.broadcast(a), "'10.0.' || u || '.255/24'")
net_query("abbrev", lambda a: net.abbrev(a), "'10.0.' || u || '.' || h || '/24'")
net_query("same_family", lambda a: net.same_family(a, F.lit("::1")), "h % 3 = 0", mixed=True)
net_query("contained", lambda a: net.contained(a, F.lit("10.0.0.0/17")), "u < 128")
net_query("contained_or_eq", lambda a: net.contained_or_eq(a, F.lit("10.0.7.0/24")), "u = 7")
net_query("contains", lambda a: net.contains(a, F.lit("10.0.7.3/32")), "u = 7")
net_query("contains_or_eq", lambda a: net.contains_or_eq(a, F.lit("10.0.7.0/24")), "u = 7")
net_query("overlaps", lambda a: net.overlaps(a, F.lit("10.0.64.0/18")), "u >= 64 AND u < 128")
net_query("merge", lambda a: net.merge(a, F.lit("10.1.0.0/16")), "'10.0.0.0/15'")
net_query("bit_and", lambda a: net.bit_and(a, F.lit("255.255.255.0")), "'10.0.' || u || '.0/32'")
net_query("bit_or", lambda a: net.bit_or(a, F.lit("0.0.0.255")), "'10.0.' || u || '.255/32'")
net_query("difference", lambda a: net.difference(a, F.lit("10.0.0.0")), "u * 256 + h")

# ------------------------------------------------------------------ changes of tables

_SHOWN = ("c_custkey", "c_name", "c_nationkey", "c_acctbal")
_OLD = "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer"
#: All customers again, every third of them under a key past the greatest.
_NEW = "SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1000000000000 ELSE c_custkey END AS c_custkey, c_name || '*' AS c_name, c_nationkey, c_acctbal + 1 AS c_acctbal FROM customer"


def changed(name: str, build: Callable[[DataFrame, DataFrame], dml.Change], sql: str, returning: bool = False) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        customer = load(s, d, "customer").select(*_SHOWN)
        moved = F.when(c("c_custkey") % 3 == 0, c("c_custkey") + 1_000_000_000_000).otherwise(c("c_custkey"))
        new = customer.select(moved.alias("c_custkey"), F.concat("c_name", F.lit("*")).alias("c_name"), "c_nationkey", (c("c_acctbal") + 1).alias("c_acctbal"))
        change = build(customer, new)
        return change.returning if returning else change.table

    query(f"dml_{name}", f"WITH o AS ({_OLD}), n AS ({_NEW}) {sql}")(run)


CUSTOMER = TABLES["customer"]
changed("insert", lambda o, n: dml.insert(o, n, CUSTOMER), "SELECT * FROM o UNION ALL SELECT * FROM n")
changed("insert_defaults", lambda o, n: dml.insert(o, n.select("c_custkey", "c_name"), CUSTOMER), "SELECT c_custkey, c_name, NULL AS c_nationkey, CAST(0 AS DOUBLE) AS c_acctbal FROM n", returning=True)
changed("insert_ignore", lambda o, n: dml.insert_or_ignore(o, n, CUSTOMER), "SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
changed("replace", lambda o, n: dml.replace(o, n, CUSTOMER), "SELECT * FROM n UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
changed("upsert", lambda o, n: dml.upsert(o, n, CUSTOMER, {"c_acctbal": c("old.c_acctbal") + c("excluded.c_acctbal"), "c_name": c("excluded.c_name")}), "SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(o.c_nationkey, n.c_nationkey) AS c_nationkey, CASE WHEN o.c_custkey IS NULL THEN n.c_acctbal WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE o.c_acctbal + n.c_acctbal END AS c_acctbal FROM o FULL JOIN n ON o.c_custkey = n.c_custkey")
changed("update", lambda o, n: dml.update(o, {"c_acctbal": c("c_acctbal") * 2, "c_name": c("c_acctbal").cast("int").cast("string")}, c("c_nationkey") == 3), "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN CAST(CAST(trunc(c_acctbal) AS INTEGER) AS VARCHAR) ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM o")
changed("update_returning", lambda o, n: dml.update(o, {"c_nationkey": c("c_nationkey") + 1}, c("c_acctbal") < 0), "SELECT c_custkey, c_name, c_nationkey + 1 AS c_nationkey, c_acctbal FROM o WHERE c_acctbal < 0", returning=True)
changed("update_batch", lambda o, n: dml.update_batch(o, n.select("c_custkey", F.when(c("c_custkey") % 2 == 0, c("c_name")).alias("c_name")), CUSTOMER), "SELECT o.c_custkey, CASE WHEN n.c_custkey % 2 = 0 THEN n.c_name ELSE o.c_name END AS c_name, o.c_nationkey, o.c_acctbal FROM o LEFT JOIN n ON o.c_custkey = n.c_custkey")
changed("delete", lambda o, n: dml.delete(o, c("c_acctbal") < 1000), "SELECT * FROM o WHERE NOT (c_acctbal < 1000)")
changed("delete_returning", lambda o, n: dml.delete(o, F.nullif(c("c_nationkey"), F.lit(3)) < 5), "SELECT * FROM o WHERE nullif(c_nationkey, 3) < 5", returning=True)

_TWICE = "SELECT * FROM n UNION ALL SELECT c_custkey, c_name || '!', c_nationkey, c_acctbal + 5 FROM n WHERE c_nationkey < 9"
twice = lambda n: n.unionByName(n.where("c_nationkey < 9").withColumn("c_name", F.concat("c_name", F.lit("!"))).withColumn("c_acctbal", c("c_acctbal") + 5))
changed("replace_last", lambda o, n: dml.replace(o, twice(n), CUSTOMER, order=c("c_acctbal")), f"SELECT * FROM (SELECT * FROM ({_TWICE}) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY c_acctbal DESC) = 1) UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
changed("upsert_where", lambda o, n: dml.upsert(o, n, CUSTOMER, {"c_acctbal": c("excluded.c_acctbal")}, target_where=c("c_nationkey") < 12, where=c("old.c_acctbal") > 0), "SELECT o.c_custkey, o.c_name, o.c_nationkey, CASE WHEN o.c_nationkey < 12 AND n.c_custkey IS NOT NULL AND o.c_acctbal > 0 THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal FROM o LEFT JOIN n ON o.c_custkey = n.c_custkey UNION ALL SELECT * FROM n WHERE NOT (c_nationkey < 12 AND c_custkey IN (SELECT c_custkey FROM o))")
changed("update_batch_null", lambda o, n: dml.update_batch(o, n.select("c_custkey", "c_name", "c_nationkey"), CUSTOMER, {"c_name": c("c_nationkey") == 4, "c_acctbal": c("c_nationkey") == 5}), "SELECT o.c_custkey, CASE WHEN n.c_nationkey = 4 THEN NULL ELSE coalesce(n.c_name, o.c_name) END AS c_name, coalesce(n.c_nationkey, o.c_nationkey) AS c_nationkey, CASE WHEN n.c_nationkey = 5 THEN NULL ELSE o.c_acctbal END AS c_acctbal FROM o LEFT JOIN n ON o.c_custkey = n.c_custkey")
changed("update_old", lambda o, n: _old_and_new(dml.update(o, {"c_acctbal": c("c_acctbal") * 2}, c("c_nationkey") == 3, keep_old=True)), "SELECT c_custkey, c_acctbal AS before, c_acctbal * 2 AS after FROM o WHERE c_nationkey = 3", returning=True)


def _old_and_new(change: dml.Change) -> dml.Change:
    return dml.Change(change.table, change.returning.select("c_custkey", c("old.c_acctbal").alias("before"), c("c_acctbal").alias("after")))


# ------------------------------------------------------------------ user functions, files, samples

over_table("udf_scalar", "part", "SELECT p_partkey, upper(substr(p_name, 1, 3)) AS v FROM part", lambda df: df.select("p_partkey", udf.scalar(lambda t: t[:3].upper(), "string")(c("p_name")).alias("v")))
over_table("udf_declared", "part", "SELECT p_partkey, left(p_name, 4) AS v FROM part", lambda df: df.select("p_partkey", udf.declared("left")(c("p_name"), F.lit(4)).alias("v")))
over_table("udaf_range_max", "lineitem", "SELECT l_returnflag, max(l_quantity) - min(l_quantity) AS v FROM lineitem GROUP BY l_returnflag", lambda df: udf.aggregate_by(df, ["l_returnflag"], c("l_quantity"), lambda: (float("inf"), float("-inf")), lambda s, v: (min(s[0], v), max(s[1], v)), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda s: s[1] - s[0], "double", "v"))
over_table("udaf_group", "orders", "SELECT o_custkey, CAST(bit_xor(o_orderkey) AS BIGINT) AS v FROM orders GROUP BY o_custkey", lambda df: df.groupBy("o_custkey").agg(udf.aggregate(lambda: 0, lambda s, v: s ^ v, lambda s: s, "bigint")(c("o_orderkey")).alias("v")))
over_table("udf_nulls", "part", "SELECT p_partkey, CASE WHEN p_size = 10 THEN 'none' ELSE 'n' || p_size END AS v FROM part", lambda df: df.select("p_partkey", udf.scalar(lambda n: "none" if n is None else f"n{n}", "string")(F.nullif(c("p_size"), F.lit(10))).alias("v")))
over_table("udf_constant", "part", "SELECT p_partkey, 42 AS v FROM part", lambda df: df.select("p_partkey", udf.constant(lambda: 42, "int", deterministic=True).alias("v")))


@query("udtf_words", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(range(len(string_split(p_name, ' ')))) AS n FROM part")
def udtf_words(spark: SparkSession, d: str) -> DataFrame:
    words = udf.table(lambda text: ((w, i) for i, w in enumerate(text.split(" "))), "word string, n bigint")
    return load(spark, d, "part").lateralJoin(words(c("p_name").outer())).select("p_partkey", "word", "n")


@query("udf_registered", "SELECT p_partkey, length(p_name) + 1 AS v FROM part")
def udf_registered(spark: SparkSession, d: str) -> DataFrame:
    udf.register(spark, "tessera_longer", udf.scalar(lambda t: len(t) + 1, "bigint"))
    return spark.sql("SELECT p_partkey, tessera_longer(p_name) AS v FROM {part}", part=load(spark, d, "part"))


@query("copy_csv_roundtrip", "SELECT r_regionkey, nullif(r_name, 'ASIA') AS r_name FROM region")
def copy_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path, options = f"{copy.shared_folder(spark)}/copy-{uuid.uuid4().hex}", copy.CopyOptions("csv", header=True, null="NULL")
    rows = load(spark, d, "region").select("r_regionkey", F.nullif(c("r_name"), F.lit("ASIA")).alias("r_name"))
    copy.copy_to(rows, path, options)
    return copy.copy_from(spark, path, rows.schema, options)


def copied(name: str, options: copy.CopyOptions, sql: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Rows written and read again with the same options."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = build(load(spark, d, "part"))
        path = f"{copy.shared_folder(spark)}/copy-{name}-{uuid.uuid4().hex}"
        copy.copy_to(rows, path, options)
        return copy.copy_from(spark, path, rows.schema, options)

    query(f"copy_{name}_roundtrip", sql)(run)


_ODD = lambda df: df.select("p_partkey", F.nullif(c("p_size"), F.lit(7)).alias("n"), F.concat(F.lit('a"b'), c("p_brand"), F.lit("\tc,d|e\\f")).alias("t"))
_ODD_SQL = "SELECT p_partkey, nullif(p_size, 7) AS n, 'a\"b' || p_brand || chr(9) || 'c,d|e\\f' AS t FROM part"
copied("text", copy.CopyOptions("text"), _ODD_SQL, _ODD)
copied("delimiter", copy.CopyOptions("csv", delimiter="|", quote="'", escape="'", null="-", header=True), _ODD_SQL, _ODD)
copied("binary", copy.CopyOptions("binary"), _ODD_SQL, _ODD)
copied("default", copy.CopyOptions("csv", default="DEFAULT", defaults={"t": "none given"}), "SELECT p_partkey, CASE WHEN p_size < 20 THEN 'none given' ELSE p_name END AS t FROM part", lambda df: df.select("p_partkey", F.when(c("p_size") < 20, "DEFAULT").otherwise(c("p_name")).alias("t")))


@query("snapshot_restore", "SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def snapshot_restore(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{copy.shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    copy.snapshot({t: load(spark, d, t) for t in ("nation", "region")}, folder)
    back = copy.restore(spark, folder, "nation", "region")
    return back["nation"].join(back["region"], reference("nation", "region")).select("n_nationkey", "n_name", "n_regionkey", "r_name")


@query("publish_latest", "SELECT s_suppkey, s_name || '?' AS s_name, s_nationkey, s_acctbal FROM supplier")
def publish_latest(spark: SparkSession, d: str) -> DataFrame:
    folder, table = f"{copy.shared_folder(spark)}/versions-{uuid.uuid4().hex}", load(spark, d, "supplier")
    dml.publish(dml.Change(table, table), folder, 1)
    dml.publish(dml.update(dml.latest(spark, folder), {"s_name": F.concat("s_name", F.lit("?"))}), folder, 2)
    return dml.latest(spark, folder)


@query("change_stream", "SELECT n_nationkey, n_name FROM nation")
def change_stream(spark: SparkSession, d: str) -> DataFrame:
    """What a handler of change events has put away."""
    folder = f"{copy.shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    nation = load(spark, d, "nation").select("n_nationkey", "n_name")
    nation.write.parquet(f"{folder}/in")
    stream = changes.change_stream(spark, f"{folder}/in", nation.schema)
    changes.on_change(stream, lambda batch, n: batch.write.parquet(f"{folder}/out/batch={n}"), f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("n_nationkey", "n_name")


@query("relation_named_late", "SELECT r_regionkey, r_name FROM region")
def relation_named_late(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "region").createOrReplaceTempView("tessera_late")
    return relation(spark, None, "tessera_late").select("r_regionkey", "r_name")


query("describe_view", "SELECT * FROM (VALUES ('n_nationkey', 'int', true), ('v', 'bigint', false)) AS t(name, type, nullable)")(lambda s, d: s.createDataFrame(describe(load(s, d, "nation").groupBy("n_nationkey").agg(F.count("*").alias("v"))), "name string, type string, nullable boolean"))
query("schema_diff", "SELECT * FROM (VALUES ('added', 'x'), ('changed', 'r_regionkey'), ('dropped', 'r_name')) AS t(change, name)")(lambda s, d: s.createDataFrame([(k, n) for k, names in schema_diff(load(s, d, "region"), load(s, d, "region").select(c("r_regionkey").cast("bigint"), F.lit(1).alias("x"))).items() for n in names], "change string, name string"))
query("join_inferred", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(lambda s, d: join_to(s, d, "orders", "customer", "nation", "region").select("o_orderkey", "c_name", "n_name", "r_name"))
query("try_grouped_by", "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")(lambda s, d: try_grouped_by(load(s, d, "customer").select("c_custkey"), load(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "c_custkey", "o_custkey", "orders", "o_orderkey").select("c_custkey", F.size("orders").cast("bigint").alias("n"), F.round(F.aggregate("orders", F.lit(0.0), lambda a, o: a + o["o_totalprice"]), 2).alias("total")))
over_table("assume_not_null", "part", "SELECT p_partkey, p_size + 1 AS v FROM part", lambda df: df.select("p_partkey", (expr.assume_not_null(c("p_size")) + 1).alias("v")))
over_table("tablesample", "orders", None, lambda df: copy.sample(df, 10, seed=7))
query("inherited_only", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")(lambda s, d: copy.only(copy.inherited(load(s, d, "nation").where("n_regionkey = 1").select("n_nationkey", "n_name"), child=load(s, d, "nation").where("n_regionkey = 2").select("n_nationkey", "n_name"))))
