"""Descriptive aggregates: counts, percentiles, histograms, cross-tables, shares."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequency(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """``column`` and ``n`` for all categories, in their order (``place``), 0 where none occurs."""
    dim = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(categories)], f"{column} string, place int")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(dim).join(counts, column, "left").select(column, "place", F.coalesce("n", F.lit(0)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str, categories: list[str]) -> DataFrame:
    """Counts of ``row`` by category, one column each, 0 where none occurs."""
    out = df.groupBy(row).pivot(column, categories).agg(F.count(F.lit(1)))
    return out.fillna(0, categories)


def top_n(df: DataFrame, column: str, n: int, first: str) -> DataFrame:
    """The ``n`` most frequent values and ``n`` rows; ties go to the value seen first, by ``first``."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("_f")).orderBy(F.desc("n"), "_f").limit(n).drop("_f")


def top_n_other(df: DataFrame, column: str, n: int, first: str) -> DataFrame:
    """The ``n`` most frequent values, all others as ``Other (k codes)`` with the number of different ones."""
    top = F.broadcast(top_n(df, column, n, first).select(F.col(column).alias("_top")))
    joined = df.where(F.col(column).isNotNull()).join(top, F.col(column) == F.col("_top"), "left")
    counts = joined.groupBy("_top", column).agg(F.count(F.lit(1)).alias("n")).groupBy("_top").agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("n"))
    return counts.select(F.coalesce(F.col("_top").cast("string"), F.concat(F.lit("Other ("), F.col("_k").cast("string"), F.lit(" codes)"))).alias("label"), "n")


def median_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact medians by key."""
    return df.groupBy(key).agg(F.median(value).alias("median"), F.count(value).alias("n"))


def nearest_rank(df: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.25, 0.75, 0.9), buckets: int = 64) -> DataFrame:
    """Values at the places ``min(int(n * p), n - 1)`` of each key's sorted values, with ``n``.

    Equal values are counted first. Ranks are running counts over a key's buckets, cut at approximate quantiles of its
    values, and inside each bucket, so no task gathers or sorts all values of a key.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    edges = counts.groupBy(F.col("_k").alias("_e_k")).agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 1000).alias("_e"))
    work = counts.join(edges, F.col("_k").eqNullSafe(F.col("_e_k"))).select("_k", "_v", "_c", F.size(F.filter("_e", lambda e: e < F.col("_v"))).alias("_b"))
    w = Window.partitionBy("_k")
    totals = work.groupBy("_k", "_b").agg(F.sum("_c").alias("_s"))
    totals = totals.select(F.col("_k").alias("_t_k"), F.col("_b").alias("_t_b"), F.coalesce(F.sum("_s").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_p"), F.sum("_s").over(w).alias("_n"))
    run = work.withColumn("_in", F.sum("_c").over(Window.partitionBy("_k", "_b").orderBy("_v"))).join(totals, F.col("_k").eqNullSafe(F.col("_t_k")) & (F.col("_b") == F.col("_t_b"))).withColumn("_hi", F.col("_p") + F.col("_in"))
    place = lambda p: F.least((F.col("_n") * F.lit(float(p))).cast("long"), F.col("_n") - 1)
    at = lambda p: F.max(F.when((F.col("_hi") > place(p)) & (F.col("_hi") - F.col("_c") <= place(p)), F.col("_v")))
    return run.groupBy(F.col("_k").alias(key)).agg(F.max("_n").alias("n"), *[at(p).alias(f"p{round(p * 100)}") for p in shares])


def log_histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 24, floor: float = 0.05) -> DataFrame:
    """Counts in bins of equal width on a log scale from ``low`` to ``high``; the last bin holds its upper edge."""
    a, b = math.log10(low), math.log10(high)
    x = F.log10(F.greatest(F.col(value), F.lit(floor)))
    return df.where(F.col(value).isNotNull()).groupBy(F.least(F.width_bucket(x, F.lit(a), F.lit(b), F.lit(bins)), F.lit(bins)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def duration_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Least, most, mean and number of values by key."""
    return df.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def shares(df: DataFrame, key: str) -> DataFrame:
    """Counts of each value and their share of all rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total), F.lit(True)).select(key, "n", (F.col("n") / F.col("_t")).alias("share"))


def multi_value_groups(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value, and how many."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1")


def dedupe_then_sum(df: DataFrame, keys: list[str], values: list[str], by: str) -> DataFrame:
    """Sums by ``by`` over rows that are distinct in keys and values."""
    return df.select(*keys, *values).distinct().groupBy(by).agg(*[F.sum(v).alias(v) for v in values])


def density(count: Column, size: Column, per: float = 1000.0) -> Column:
    """Counts per ``per`` units of size; null where size is 0."""
    return F.try_divide(count * F.lit(per), size)


def above_own_percentile(df: DataFrame, key: str, value: str, p: float, name: str) -> DataFrame:
    """``df`` with whether a value is at or above its key's percentile."""
    cut = df.groupBy(key).agg(F.percentile(value, F.lit(p)).alias("_cut"))
    return df.join(cut, key, "left").withColumn(name, F.col(value) >= F.col("_cut")).drop("_cut")


def modal(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; ties go to the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("o"), F.col(value).alias("v"))).alias("_m")).select(key, F.col("_m.v").alias(value))


def bus_factor(df: DataFrame, key: str, person: str, share: float = 0.5) -> DataFrame:
    """The fewest people of each key who together made at least ``share`` of its rows.

    People with equally many rows are counted together, so a running sum passes over a key's different numbers of rows
    (at most about the root of its rows), not over its people.
    """
    counts = df.groupBy(key, person).agg(F.count(F.lit(1)).alias("_n")).groupBy(key, "_n").agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(key)
    rows = F.col("_n") * F.col("_m")
    run = counts.withColumns({"_run": F.coalesce(F.sum(rows).over(w.orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_t": F.sum(rows).over(w)})
    need = F.least(F.col("_m"), F.ceil((F.col("_t") * F.lit(share) - F.col("_run")) / F.col("_n")))
    return run.groupBy(key).agg(F.sum(F.greatest(need, F.lit(0))).cast("long").alias("bus_factor"))


def composition(df: DataFrame, period: str, category: str) -> DataFrame:
    """Counts of categories in each period and their share of the period."""
    counts = df.groupBy(period, category).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(period).agg(F.sum("n").alias("_t"))
    return counts.join(totals, period).select(period, category, "n", (F.col("n") / F.col("_t")).alias("share"))


def dosage(df: DataFrame, key: str, category: str, categories: list[str]) -> DataFrame:
    """Counts by category as one column each, for use as covariates."""
    return df.groupBy(key).pivot(category, categories).agg(F.count(F.lit(1))).fillna(0, categories)


def process_metrics(prs: DataFrame, key: str, width: str = "30 days") -> DataFrame:
    """By repository and interval: pull requests, median size and latency (hours), reverts, and the share that names an issue.

    ``prs`` has created_at, closed_at, title, body and size.
    """
    late = (F.unix_micros(F.col("closed_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(3.6e9)
    out = prs.groupBy(key, F.window(F.col("created_at").cast("timestamp"), width).alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.median("size").alias("median_size"), F.median(late).alias("median_latency"),
        F.count_if(F.col("title").rlike(r"(?i)^revert\b")).alias("reverts"), F.avg(F.concat_ws(" ", "title", "body").rlike(r"#[0-9]+").cast("int")).alias("issue_ratio"),
    )
    return out.select(key, F.col("_w.start").alias("interval_start"), "n", "median_size", "median_latency", "reverts", "issue_ratio")


def quantiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """Median and 90th percentile by key, for heavy-tailed metrics."""
    return df.groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.9)).alias("p90"))


def change_rates(status: DataFrame) -> DataFrame:
    """From matched snapshots (status): entities kept, introduced and removed, with rates of introduction and removal."""
    c = status.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("kept", "introduced", "removed")])
    before, after = F.col("kept") + F.col("removed"), F.col("kept") + F.col("introduced")
    return c.select("*", F.try_divide("introduced", after).alias("introduction_rate"), F.try_divide("removed", before).alias("removal_rate"))
