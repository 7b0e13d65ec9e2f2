"""Joins and aggregates over the star schema: extensions beyond the news tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.plans.base import query
from tidewire.session import table


@query(
    "region_rollup",
    """SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name)""",
)
def region_rollup(spark, sf_dir):
    """Orders by topic levels; the dimensions are small by nature and left to the planner."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "price_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""",
)
def price_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query(
    "brand_baselines",
    "SELECT p_brand, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
)
def brand_baselines(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p = F.percentile("l_extendedprice", F.array(F.lit(0.5), F.lit(0.95)))
    return j.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(p[0], 4).alias("p50"), F.round(p[1], 4).alias("p95"))
