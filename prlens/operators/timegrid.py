"""Time grids and the snapshot manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prlens.functions.timing import whole_days
from prlens.operators.joins import asof_backward

#: Days after which a snapshot counts as stale.
STALE_DAYS = 45


def monthly_grid(spark: SparkSession, start: str = "2022-01-01", end: str = "2026-03-31") -> DataFrame:
    """Month starts from ``start`` to ``end``: ``target_date``."""
    points = F.sequence(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)), F.expr("INTERVAL 1 MONTH"))
    return spark.range(1).select(F.explode(points).alias("target_date"))


def intervention_points(at: Column) -> Column:
    """Points around an instant: weeks up to 91 days before and after, and 4 to 12 months, each once, in order.

    Months keep the time of day and clamp to the month's last day.
    """
    at = at.cast("timestamp")
    weeks = F.transform(F.sequence(F.lit(-91), F.lit(91), F.lit(7)), lambda d: at + F.make_dt_interval(d))
    later = F.transform(F.sequence(F.lit(4), F.lit(12)), lambda m: at + F.make_ym_interval(F.lit(0), m))
    before = F.transform(F.sequence(F.lit(4), F.lit(12)), lambda m: at - F.make_ym_interval(F.lit(0), m))
    return F.array_sort(F.array_union(weeks, F.array_union(before, later)))


def manifest(repos: DataFrame, commits: DataFrame, start: str = "2022-01-01", end: str = "2026-03-31") -> DataFrame:
    """Every grid point of every repository with its last commit, staleness and flags; no row is dropped.

    ``repos`` has repo_id, full_name, language and intervention_date; ``commits`` repo_id, sha and commit_date.
    """
    base = repos.select("repo_id", "full_name", "language", F.col("intervention_date").cast("timestamp").alias("_at"))
    months = F.sequence(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)), F.expr("INTERVAL 1 MONTH"))
    a1 = base.select("repo_id", "full_name", "language", F.lit("A1").alias("track"), F.explode(months).alias("target_date"))
    a2 = base.select("repo_id", "full_name", "language", F.lit("A2").alias("track"), F.explode(intervention_points(F.col("_at"))).alias("target_date"))
    found = asof_backward(a1.unionByName(a2), commits, "repo_id", "target_date", "commit_date", ["sha"]).withColumnRenamed("sha", "commit_sha")
    return flagged(found)


def flagged(df: DataFrame) -> DataFrame:
    """Adds ``staleness_days``, ``is_stale`` and ``no_prior_commit``."""
    days = whole_days(F.col("commit_date"), F.col("target_date")).cast("int")
    return df.withColumns({"staleness_days": days, "is_stale": F.coalesce(days > STALE_DAYS, F.lit(False)), "no_prior_commit": F.col("commit_sha").isNull()})


def unique_commits(m: DataFrame) -> DataFrame:
    """Distinct resolved commits of a manifest."""
    return m.where("commit_sha IS NOT NULL").select("full_name", "language", "commit_sha").distinct()


def eligible(m: DataFrame, repo_pattern: str | None = None, limit: int = 0) -> DataFrame:
    """Rows to analyse, by name; ``repo_pattern`` is a regular expression, a limit of 0 is none."""
    out = m.where("NOT no_prior_commit AND commit_sha IS NOT NULL")
    if repo_pattern:
        out = out.where(F.col("full_name").rlike(repo_pattern))
    out = out.orderBy("full_name", "track", "target_date")
    return out.limit(limit) if limit else out


def snapshot_tag() -> Column:
    """``repo__track__YYYY-MM-DD``."""
    return F.concat_ws("__", F.replace(F.col("full_name"), F.lit("/"), F.lit("__")), "track", F.date_format("target_date", "yyyy-MM-dd"))


def months_since(at: Column, ts: Column) -> Column:
    """Whole months of 30.44 days from an event to a time, rounded down."""
    return F.floor((F.unix_micros(ts.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(30.44 * 86_400_000_000)).cast("long")


def month_sample(df: DataFrame, key: str, ts: str, order: list[str], most: int = 10, days: int | None = None) -> DataFrame:
    """Up to ``most`` first rows of each key and month (within its first ``days`` days, if given), with the month's ``n`` and ``under_sampled``."""
    from pyspark.sql import Window

    work = df.withColumn("month", F.date_format(ts, "yyyy-MM"))
    if days is not None:
        work = work.where(F.dayofmonth(ts) <= days)
    w = Window.partitionBy(key, "month")
    return work.withColumns({"_rn": F.row_number().over(w.orderBy(*order)), "n": F.count(F.lit(1)).over(w)}).where(F.col("_rn") <= most).withColumn("under_sampled", F.col("n") < most).drop("_rn")
