"""Relational queries over the star schema: the plain operators at their usual scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.tables import read

#: Parts into which a hot key's rows go before they are added up.
SALTS = 16


def _money(c: str):
    return F.col(c).cast("decimal(18,4)")


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_shipdate").where("l_shipdate <= timestamp_ntz'2023-09-02 00:00:00'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum(_money("l_quantity")).cast("double").alias("sum_qty"), F.sum(_money("l_extendedprice")).cast("double").alias("sum_price"), F.count("*").alias("n"))


def no_urgent_order_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order that is open."""
    urgent = read(spark, d, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderstatus").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'")
    return read(spark, d, "customer", "c_custkey", "c_nationkey").join(urgent, "c_custkey", "left_anti")


def has_open_order(spark: SparkSession, d: str) -> DataFrame:
    open_ = read(spark, d, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderstatus").where("o_orderstatus = 'O'")
    return read(spark, d, "customer", "c_custkey", "c_mktsegment").join(open_, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def parts_not_shipped_lately(spark: SparkSession, d: str) -> DataFrame:
    """Parts of which no line item was shipped since September 2001."""
    shipped = read(spark, d, "lineitem", F.col("l_partkey").alias("p_partkey"), "l_shipdate").where("l_shipdate >= timestamp_ntz'2001-09-01 00:00:00'")
    return read(spark, d, "part", "p_partkey", "p_brand").join(shipped, "p_partkey", "left_anti")


def top_customers(spark: SparkSession, d: str) -> DataFrame:
    """The three customers of each nation that spent most."""
    o = read(spark, d, "orders", F.col("o_custkey").alias("c_custkey"), "o_totalprice").groupBy("c_custkey").agg(F.sum(_money("o_totalprice")).alias("spent"))
    c = read(spark, d, "customer", "c_custkey", "c_nationkey").join(o, "c_custkey")
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("spent"), "c_custkey")
    return c.withColumn("k", F.row_number().over(w)).where("k <= 3").select("c_nationkey", "c_custkey", F.col("spent").cast("double").alias("spent"), "k")


def running_orders(spark: SparkSession, d: str) -> DataFrame:
    """What each order leaves of its customer's running total, and the days since the order before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    total = F.sum(_money("o_totalprice")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lag(F.col("o_orderdate").cast("date")).over(w))
    return o.select("o_orderkey", total.alias("total"), days.cast("long").alias("days"))


def hot_key_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums by a key of few values, in two steps over salts, so that no task has all rows of one value."""
    o = read(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").withColumn("salt", F.pmod(F.xxhash64("o_orderkey"), F.lit(SALTS)))
    part = o.groupBy("o_orderstatus", "salt").agg(F.sum(_money("o_totalprice")).alias("s"), F.count("*").alias("n"))
    return part.groupBy("o_orderstatus").agg(F.sum("s").cast("double").alias("total"), F.sum("n").alias("n"))


def nation_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Lines sold from the suppliers of one nation to the customers of another, the 40 strongest pairs."""
    l = read(spark, d, "lineitem", "l_orderkey", "l_suppkey")  # noqa: E741
    s, o, c = read(spark, d, "supplier", F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), read(spark, d, "orders", F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), read(spark, d, "customer", F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    got = l.join(s, "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").where("s_nationkey <> c_nationkey")
    return got.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s_nationkey", "c_nationkey").limit(40)


def brand_union(spark: SparkSession, d: str) -> DataFrame:
    """Brands of small and of dear parts: both, and either."""
    p = read(spark, d, "part", "p_brand", "p_size", "p_retailprice")
    small, dear = p.where("p_size < 5").select("p_brand"), p.where("p_retailprice > 1500").select("p_brand")
    return small.intersect(dear).withColumn("in_set", F.lit("both")).unionByName(small.union(dear).distinct().withColumn("in_set", F.lit("either")))


QUERIES = {f.__name__: f for f in (pricing_summary, no_urgent_order_customers, has_open_order, parts_not_shipped_lately, top_customers, running_orders, hot_key_totals, nation_matrix, brand_union)}
SQL = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2023-09-02' GROUP BY ALL",
    "no_urgent_order_customers": "SELECT c_custkey, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')",
    "has_open_order": "SELECT c_mktsegment, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'O') GROUP BY ALL",
    "top_customers": "SELECT c_nationkey, c_custkey, CAST(spent AS DOUBLE) AS spent, k FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY spent DESC, c_custkey) AS k FROM (SELECT c_nationkey, c_custkey, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS spent FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)) WHERE k <= 3",
    "running_orders": "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total, date_diff('day', CAST(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE), CAST(o_orderdate AS DATE)) AS days FROM orders",
    "hot_key_totals": "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS n FROM orders GROUP BY ALL",
    "nation_matrix": "SELECT s_nationkey, c_nationkey, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey GROUP BY ALL ORDER BY n DESC, s_nationkey, c_nationkey LIMIT 40",
    "brand_union": "SELECT p_brand, 'both' AS in_set FROM (SELECT p_brand FROM part WHERE p_size < 5 INTERSECT SELECT p_brand FROM part WHERE p_retailprice > 1500) UNION ALL SELECT p_brand, 'either' FROM (SELECT p_brand FROM part WHERE p_size < 5 UNION SELECT p_brand FROM part WHERE p_retailprice > 1500)",
}
SQL["parts_not_shipped_lately"] = "SELECT p_partkey, p_brand FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l_shipdate >= TIMESTAMP '2001-09-01')"
