"""The pull-request filter chain, and the three notions of a rejected pull request."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prlens.functions import text, timing


def rejected_by_state() -> Column:
    """Closed and never merged, by state."""
    return (F.col("state") == "closed") & F.col("merged_at").isNull()


def rejected_by_dates() -> Column:
    """Closed and never merged, by dates; an open one is not rejected."""
    return F.col("closed_at").isNotNull() & F.col("merged_at").isNull()


def rejected_or_open() -> Column:
    """Closed and never merged; null while open."""
    return F.when(F.col("closed_at").isNotNull(), F.col("merged_at").isNull())


def join_dimensions(prs: DataFrame, repos: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Pull requests with their repository (columns ``*_repo`` where names clash) and author (``*_user``).

    The joins are left joins on equal keys; Spark broadcasts a dimension that its statistics show to be small.
    """

    def prefixed(df: DataFrame, suffix: str, taken: list[str]) -> DataFrame:
        return df.select(*[F.col(c).alias(c + suffix if c in taken or c == "id" else c) for c in df.columns])

    out = prs.join(prefixed(repos, "_repo", prs.columns), F.col("repo_id") == F.col("id_repo"), "left")
    if users is not None:
        out = out.join(prefixed(users, "_user", out.columns), F.col("user_id") == F.col("id_user"), "left")
    return out


def filter_prs(
    prs: DataFrame, repos: DataFrame, users: DataFrame | None = None, *, rejected: bool = True, star_minimum: float = 100, language: str | None = None,
    agents: list[str] | None = None, user_minimum: float | None = None, forks_minimum: float | None = None, age_minimum: int | None = None, age_maximum: int | None = None,
    english_title: bool = True, require_body: bool = True, url_status: DataFrame | None = None, now: str | None = None,
) -> DataFrame:
    """Ids that pass all filters; every filter is part of one plan, so those on one table reach its scan.

    ``url_status`` (url, status) drops pull requests whose URL is known to be gone (404). ``now`` is the instant
    that ages refer to. A null in a compared column drops the row; an age bound drops rows without a valid date.
    """
    df = join_dimensions(prs, repos, users).where(F.col("stars") >= star_minimum)
    if rejected:
        df = df.where(rejected_by_state())
    if english_title:
        df = df.where(text.english_title(F.col("title")))
    if require_body:
        df = df.where(~text.is_blank(F.col("body")))
    if language is not None:
        df = df.where(F.col("language").isin([x.strip() for x in language.split(",")]))
    if agents:
        df = df.where(F.col("agent").isin(list(agents)))
    if user_minimum is not None:
        df = df.where(F.col("followers") >= user_minimum)
    if forks_minimum is not None:
        df = df.where(F.col("forks") >= forks_minimum)
    if age_minimum is not None or age_maximum is not None:
        created = F.try_to_timestamp(F.col("created_at").cast("string"))
        age = timing.whole_days(created, F.to_timestamp(F.lit(now)) if now else F.current_timestamp())
        df = df.where(age >= age_minimum if age_minimum is not None else F.lit(True)).where(age <= age_maximum if age_maximum is not None else F.lit(True)).where(age.isNotNull())
    if url_status is not None:
        df = drop_dead_urls(df, url_status)
    return df.select("id")


def drop_dead_urls(df: DataFrame, url_status: DataFrame, url: str = "html_url") -> DataFrame:
    """Rows whose URL is not known to be gone; an unknown status keeps the row."""
    dead = url_status.where("status = 404").select(F.col("url").alias(url)).distinct()
    return df.join(dead, url, "left_anti")


def probe_urls(urls: DataFrame, probe, workers: int = 16) -> DataFrame:  # noqa: ANN001
    """``url`` and ``status`` of distinct URLs, asked by ``probe(url) -> int | None`` with ``workers`` threads in a task."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        def ask(url: str) -> int | None:
            try:
                return probe(url)
            except Exception:  # any failure leaves the status unknown, which keeps the row
                return None

        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                b["status"] = pd.array(list(pool.map(ask, b["url"])), dtype="Int32")
                yield b[["url", "status"]]

    return urls.select("url").where("url IS NOT NULL").distinct().mapInPandas(run, "url string, status int")


def with_metadata(ids: DataFrame, prs: DataFrame, columns: list[str]) -> DataFrame:
    """Ids with pull-request columns, in the order of ``row_idx`` if ids have one; repeated and unknown ids stay."""
    keep = [c for c in columns if c != "id"]
    out = ids.join(prs.select("id", *keep), "id", "left")
    return out.orderBy("row_idx") if "row_idx" in ids.columns else out


def extract_repos(ids: DataFrame, prs: DataFrame, repos: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The repositories of the given pull requests, each once (its first row by ``row_idx`` if there is one)."""
    wanted = prs.join(ids.select("id").distinct(), "id", "left_semi").where("repo_id IS NOT NULL").select(F.col("repo_id").alias("id")).distinct()
    found = repos.join(wanted, "id", "left_semi")
    if "row_idx" in repos.columns:
        found = found.groupBy("id").agg(F.min_by(F.struct(*[c for c in repos.columns if c != "id"]), "row_idx").alias("r")).select("id", "r.*")
    else:
        found = found.dropDuplicates(["id"])
    return found.select(*columns) if columns else found


def contributor_floor(repos: DataFrame, least: int = 30, languages: tuple[str, ...] = ("Python", "C++", "C#")) -> DataFrame:
    """Repositories with more than ``least`` contributors in one of the languages."""
    return repos.where((F.col("contributors") > least) & F.col("language").isin(*languages))


def with_agent_config(repos: DataFrame, tree: DataFrame, paths: tuple[str, ...] = ("CLAUDE.md", ".github/copilot-instructions.md")) -> DataFrame:
    """Repositories with ``has_agent_config``: whether their tree (repo_id, path) holds a configuration file of an agent."""
    have = tree.where(F.col("path").isin(*paths)).select("repo_id").distinct().withColumn("_c", F.lit(True))
    return repos.join(have, repos["id"] == have["repo_id"], "left").select(*[repos[c] for c in repos.columns], F.coalesce("_c", F.lit(False)).alias("has_agent_config"))


def weigh_stale(snapshots: DataFrame, weight: float = 0.0) -> DataFrame:
    """Snapshots with a ``weight``: 1, or ``weight`` where they are stale or unresolved; 0 drops them at analysis time only."""
    return snapshots.withColumn("weight", F.when(F.col("is_stale") | F.col("no_prior_commit"), F.lit(float(weight))).otherwise(F.lit(1.0)))


def matched_arm(units: DataFrame, treated: str, strata: list[str], order: str, per_unit: int = 1) -> DataFrame:
    """Treated units and, of each stratum, as many untreated ones (times ``per_unit``), the first by ``order``."""
    from pyspark.sql import Window

    counts = units.where(F.col(treated)).groupBy(*strata).agg((F.count(F.lit(1)) * per_unit).alias("_n"))
    w = Window.partitionBy(*strata).orderBy(order)
    rest = units.where(~F.col(treated)).join(counts, strata).withColumn("_rn", F.row_number().over(w)).where("_rn <= _n")
    return units.where(F.col(treated)).unionByName(rest.select(*units.columns))
