"""Statistics: rank tests, corrections, segmented regression, before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before_value(df: DataFrame, order: str, sums: dict[str, str], buckets: int = 64) -> DataFrame:
    """``df`` with sums of columns over all rows with a smaller ``order`` value, for rows that are distinct in it.

    Values are cut into buckets at approximate quantiles (a bounded list); sums run over the buckets' totals and
    inside each bucket, so no task sorts all rows.
    """
    cuts = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else None
    bucket = F.size(F.filter(edges, lambda e: e < F.col(order))) if cuts else F.lit(0)
    work = df.withColumn("_bucket", bucket)
    past = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = work.groupBy("_bucket").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    totals = totals.select("_bucket", *[F.coalesce(F.sum(f"_s_{n}").over(past), F.lit(0)).alias(f"_p_{n}") for n in sums])
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    work = work.withColumns({f"_w_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(totals), "_bucket")
    return work.select(*df.columns, *[(F.col(f"_p_{n}") + F.col(f"_w_{n}")).alias(n) for n in sums])


def mann_whitney(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """One row: sizes, U of the first group, z with tie correction, two-sided p, and Cliff's delta.

    Values are counted by distinct value first; ranks are running counts over distinct values.
    """
    c = df.where(F.col(value).isNotNull() & F.col(group).isin(first, second)).groupBy(F.col(value).alias("_v")).agg(F.count_if(F.col(group) == first).alias("_a"), F.count_if(F.col(group) == second).alias("_b"))
    c = c.withColumn("_t", F.col("_a") + F.col("_b"))
    c = running_before_value(c, "_v", {"_before": "_t"}).withColumn("_rank", F.col("_before") + (F.col("_t") + 1) / 2)
    s = c.agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2"), F.sum(F.col("_a") * F.col("_rank")).alias("r1"), F.sum(F.pow("_t", F.lit(3.0)) - F.col("_t")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(u - n1 * n2 / 2, sd)
    return s.select("n1", "n2", u.alias("u"), z.alias("z"), _two_sided(z).alias("p"), (F.try_divide(2 * u, n1 * n2) - 1).alias("cliffs_delta"))


def _two_sided(z: Column) -> Column:
    """Two-sided p of a normal score, by a rational approximation of the error function (error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)


def bh_fdr(df: DataFrame, p: str = "p", name: str = "q") -> DataFrame:
    """``df`` with Benjamini-Hochberg adjusted values; for tables of tests, which are small."""
    total = df.agg(F.count(p).alias("_m"))
    ranked = df.where(F.col(p).isNotNull()).withColumn("_r", F.row_number().over(Window.orderBy(p))).join(F.broadcast(total), F.lit(True)).withColumn("_x", F.col(p) * F.col("_m") / F.col("_r"))
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min("_x").over(Window.orderBy(F.desc(p), F.desc("_r"))))).drop("_r", "_m", "_x")


def trend(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Slope and intercept of a line through each key's points."""
    return df.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def segmented_regression(df: DataFrame, y: str, time: str, event: str, covariates: tuple[str, ...] = (), unit: str | None = None, arm: str | None = None) -> DataFrame:
    """Interrupted time series: ``y ~ time + level + slope after the event + covariates``; columns ``term`` and ``estimate``.

    With ``unit``, all variables are taken as differences from their unit's mean (fixed effects stand in for random
    ones). With ``arm`` (0 or 1), the event terms are interacted with it: difference in differences. The normal
    equations are one aggregation; only their few sums reach the driver, which solves them.
    """
    import numpy as np

    terms = {"time": F.col(time).cast("double"), "level": (F.col(time) >= F.col(event)).cast("double"), "slope": F.greatest(F.lit(0.0), (F.col(time) - F.col(event)).cast("double"))}
    terms |= {c: F.col(c).cast("double") for c in covariates}
    if arm:
        terms |= {"arm": F.col(arm).cast("double"), "arm_level": F.col(arm) * terms["level"], "arm_slope": F.col(arm) * terms["slope"]}
    work = df.select(*([unit] if unit else []), F.col(y).cast("double").alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(terms.values())]).dropna()
    names = list(terms)
    cols = ["_y", *[f"_x{i}" for i in range(len(names))]]
    if unit:
        means = work.groupBy(unit).agg(*[F.avg(c).alias(f"m{c}") for c in cols])
        work = work.join(means, unit).select(*[(F.col(c) - F.col(f"m{c}")).alias(c) for c in cols])
        x = cols[1:]
    else:
        work = work.withColumn("_one", F.lit(1.0))
        x, names = ["_one", *cols[1:]], ["intercept", *names]
    sums = work.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if j >= i], *[F.sum(F.col(a) * F.col("_y")).alias(f"y{i}") for i, a in enumerate(x)]).first()
    k = len(x)
    m = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    b = np.array([sums[f"y{i}"] or 0.0 for i in range(k)])
    beta = np.linalg.lstsq(m, b, rcond=None)[0]
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, beta, strict=True)], "term string, estimate double")


def before_after(df: DataFrame, key: str, value: str, after: Column, order: str | None = None) -> DataFrame:
    """Means before and after an event by key, and their difference.

    A key's values are added one after another by ``order``, then by value: a sum of floating-point numbers depends on
    its order, and a mean that lies on a rounding limit must not depend on how the rows are split over tasks. A key's
    last row holds its means; a key's rows are sorted in one task, on disk if need be.
    """
    by = Window.partitionBy(key).orderBy(*([order] if order else []), value)
    past = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    work = df.withColumns({"_before": F.avg(F.when(~after, F.col(value))).over(past), "_after": F.avg(F.when(after, F.col(value))).over(past), "_more": F.lead(F.lit(True)).over(by)})
    return work.where(F.col("_more").isNull()).select(key, F.col("_before").alias("before"), F.col("_after").alias("after"), (F.col("_after") - F.col("_before")).alias("delta"))


def average_ranks(df: DataFrame, value: str, name: str = "avg_rank") -> DataFrame:
    """``df`` with ranks in which ties share their mean; ranks come from counts of distinct values."""
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_t"))
    ranks = running_before_value(c, "_v", {"_before": "_t"}).select("_v", (F.col("_before") + (F.col("_t") + 1) / 2).alias(name))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")
