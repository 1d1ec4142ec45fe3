"""Repository selection: intervention points, summaries, stratified picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_in_group(df: DataFrame, key: str, order: list[str], flag: str = "is_first") -> DataFrame:
    """``df`` with a flag on the first row of each key, nulls last; rows without a key are never first.

    The first row is found by an aggregation, which combines before the shuffle, and joined back. Rows that tie in all
    order columns are told apart by a hash of the row; only rows equal in all columns are flagged together.
    """
    place = F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"_n{i}"), F.col(c).alias(f"_o{i}"))], F.xxhash64(*df.columns).alias("_h"))
    first = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(place).alias("_m"))
    return df.join(first, df[key] == first["_k"], "left").withColumn(flag, F.col("_k").isNotNull() & place.eqNullSafe(F.col("_m"))).drop("_k", "_m")


def pr_table(candidates: DataFrame, prs: DataFrame) -> DataFrame:
    """Pull requests of candidate repositories with the repository's columns and ``is_intervention_pr``, in order of repository and time."""
    c = candidates.withColumnRenamed("id", "repo_id")
    mine = prs.join(c.select("repo_id").distinct(), "repo_id", "left_semi")
    mine = mine.join(c.select("repo_id", *[x for x in ("full_name", "language", "stars") if x in c.columns]).dropDuplicates(["repo_id"]), "repo_id", "left")
    return first_in_group(mine, "repo_id", ["created_at", "id"], "is_intervention_pr").orderBy("repo_id", "created_at", "id")


def repo_summary(table: DataFrame) -> DataFrame:
    """One row a repository: pull requests, agents, their counts as a map, first and last dates."""
    per_agent = table.where("repo_id IS NOT NULL").groupBy("repo_id", "agent").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"),
        F.min_by(F.struct("full_name", "language", "stars"), F.struct("created_at", "id")).alias("meta"), F.min(F.struct("created_at", "id")).alias("at"),
    )
    ranked = F.transform(F.array_sort(F.collect_list(F.when(F.col("agent").isNotNull(), F.struct((-F.col("n")).alias("o"), "agent", "n")))), lambda x: F.struct(x["agent"], x["n"]))
    out = per_agent.groupBy("repo_id").agg(
        F.min_by("meta", "at").alias("meta"), F.sum("n").alias("agent_pr_count"), F.count("agent").alias("distinct_agents"),
        F.map_from_entries(ranked).alias("agent_breakdown"), F.min("first").alias("intervention_date"), F.max("last").alias("last_agent_pr_date"),
    )
    return out.select("repo_id", "meta.*", "agent_pr_count", "distinct_agents", "agent_breakdown", "intervention_date", "last_agent_pr_date").orderBy(F.desc("agent_pr_count"), "repo_id")


def suggest_pilot(summary: DataFrame, n: int = 5, strata: str = "language", order: tuple[str, ...] = ("Python", "C#"), size: str = "agent_pr_count", key: str = "repo_id") -> DataFrame:
    """``n`` repositories: from each stratum its share of ``n`` (half to even, one at least), the largest first.

    Strata are few and counted by an aggregation; the ranks need only the first ``n`` rows of each.
    """
    counts = summary.where(F.col(strata).isNotNull()).groupBy(strata).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    share = counts.join(F.broadcast(total), F.lit(True)).select(strata, F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("_n") / F.col("_t"), 0)).cast("int").alias("_take"))
    ranked = summary.withColumn("_rn", F.row_number().over(Window.partitionBy(strata).orderBy(F.desc(size), key)))
    place = F.coalesce(F.element_at(F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))]), F.col(strata)), F.lit(len(order))) if order else F.lit(0)
    return ranked.where(F.col("_rn") <= n).join(F.broadcast(share), strata).where("_rn <= _take").orderBy(place, strata, "_rn").limit(n).select(*summary.columns)
