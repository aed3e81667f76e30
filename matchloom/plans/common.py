"""Tables, and the scored pairs that stand for candidates: orders are targets, suppliers anchors, price is the score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = "SELECT l_orderkey AS tid, l_suppkey AS aid, max(floor(least(l_extendedprice / 120000.0, 0.999) * 10000) / 10000) AS p FROM lineitem GROUP BY l_orderkey, l_suppkey"
TRUTH = "SELECT l_orderkey AS tid, min(l_suppkey) AS aid FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey"
BEST = f"""SELECT tid, aid, p, coalesce(aid2, -1) AS aid2, coalesce(p2, 0.0) AS p2 FROM (
  SELECT tid, max(CASE WHEN r = 1 THEN aid END) AS aid, max(CASE WHEN r = 1 THEN p END) AS p, max(CASE WHEN r = 2 THEN aid END) AS aid2, max(CASE WHEN r = 2 THEN p END) AS p2
  FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p DESC, aid) AS r FROM ({PAIRS})) WHERE r <= 2 GROUP BY tid)"""
#: Decisions: best anchor, its score as probability, its lead as margin.
DECISIONS = f"SELECT tid, aid, p AS q, p - p2 AS margin FROM ({BEST})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor(F.least(F.col("l_extendedprice") / 120000.0, F.lit(0.999)) * 10000) / 10000
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tid"), F.col("l_suppkey").alias("aid")).agg(F.max(price).alias("p"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("tid")).agg(F.min("l_suppkey").alias("aid"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.operators.decide import best_two

    return best_two(pairs(spark, sf_dir)).select("tid", "aid", F.col("p").alias("q"), (F.col("p") - F.col("p2")).alias("margin"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("aid"), F.col("s_nationkey").alias("country"))
