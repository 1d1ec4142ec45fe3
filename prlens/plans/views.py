"""Views of the test tables as pull requests, repositories, users, commits and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pull requests: id, repository and author by customer, agent by priority, state by status."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repo_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("state"),
        F.col("o_orderpriority").alias("agent"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"),
    )


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as repositories: stars by balance, language by segment, owner by nation."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_acctbal").alias("stars"), F.col("c_mktsegment").alias("language"), F.col("c_nationkey").alias("owner"))


def closings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last shipment of each order as its closing."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("closed_at"))


def closed_pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests with ``closed_at`` (null if nothing was shipped) and ``merged`` (state F)."""
    return pull_requests(spark, sf_dir).join(closings(spark, sf_dir), "id", "left").withColumn("merged", F.col("state") == "F")
