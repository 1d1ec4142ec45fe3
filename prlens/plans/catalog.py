"""Registry of the reference-operator queries and their DuckDB oracles.

Each query is registered with the SQL that DuckDB runs on the same tables. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prlens.functions import text, timing
from prlens.operators import faults, filters, joins, metrics_code, metrics_pr, report, selection, stats, timegrid
from prlens.plans.views import closed_pull_requests, pull_requests, repositories, table
from prlens.sources import sinks
from prlens.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: The instant that ages refer to.
NOW = "2000-01-01 00:00:00"
#: Fixed value: the pattern of test file names is applied to part names here.
LEXICON = ["the", "and", "of", "is", "to"]


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query under its function's name, with its oracle."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


_CLOSED = "(SELECT o.o_orderkey AS id, o.o_custkey AS repo_id, o.o_orderstatus AS state, o.o_orderpriority AS agent, o.o_orderdate AS created_at, c.closed_at FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS closed_at FROM lineitem GROUP BY 1) c ON c.l_orderkey = o.o_orderkey)"


# ---- joins and filters -------------------------------------------------------------------------------------------


@query(
    "SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey "
    "WHERE o_orderstatus = 'F' AND c_acctbal >= 100 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderpriority IN ('1-URGENT', '2-HIGH')"
)
def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests joined to repositories and users, filtered by state, stars, language and agent."""
    prs, repos = pull_requests(spark, sf_dir).where("state = 'F'"), repositories(spark, sf_dir)
    return filters.filter_prs(prs, repos, rejected=False, star_minimum=100, language="BUILDING, MACHINERY", agents=["1-URGENT", "2-HIGH"], english_title=False, require_body=False)


@query(f"SELECT o_orderkey AS id, date_diff('microsecond', o_orderdate, TIMESTAMP '{NOW}') // 86400000000 AS age FROM orders WHERE date_diff('microsecond', o_orderdate, TIMESTAMP '{NOW}') // 86400000000 BETWEEN 365 AND 1460")
def age_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests of one to four years of age, with the age in whole days."""
    age = timing.whole_days(F.col("created_at"), F.to_timestamp(F.lit(NOW)))
    return pull_requests(spark, sf_dir).select("id", age.alias("age")).where(F.col("age").between(365, 1460))


@query(
    "SELECT doc_id FROM (SELECT doc_id, length(regexp_replace(t, '[^\\p{L}]', '', 'g')) AS l, length(regexp_replace(t, '[^\\p{Latin}]', '', 'g')) AS k "
    "FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Привет, ' || substr(text, 1, 9) ELSE text END AS t FROM documents)) WHERE l = 0 OR (l - k) / l <= 0.3"
)
def english_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with mostly Latin letters; every fourth begins with another script and is cut short."""
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Привет, "), F.substring("text", 1, 9))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").where(text.english_title(t)).select("doc_id")


@query("SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 1 AND regexp_matches(text, '[^\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}]')")
def nonblank_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that are not blank; every third is made so."""
    t = F.when(F.col("turn") % 3 == 1, F.lit(" \u00a0\u001c\n")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").where(~text.is_blank(t)).select("conv_id", "turn")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}]+'), lambda x: x <> ''))::BIGINT AS words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("SELECT i.id, i.row_idx, o.o_orderstatus AS state, o.o_orderpriority AS agent FROM (SELECT event_id * 7 AS id, event_id AS row_idx FROM events) i LEFT JOIN orders o ON o.o_orderkey = i.id")
def metadata_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of ids, one an event, with their metadata, unknown ids kept."""
    ids = table(spark, sf_dir, "events").select((F.col("event_id") * 7).alias("id"), F.col("event_id").alias("row_idx"))
    return filters.with_metadata(ids, pull_requests(spark, sf_dir), ["id", "state", "agent"])


@query("SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS language, c_acctbal AS stars FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def repo_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of pull requests in state P, each once."""
    prs = pull_requests(spark, sf_dir)
    return filters.extract_repos(prs.where("state = 'P'").select("id"), prs, repositories(spark, sf_dir), ["id", "full_name", "language", "stars"])


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_linenumber = 1)")
def todo_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no first line returned, as work not done."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"))
    return sinks.not_done(table(spark, sf_dir, "part").select("p_partkey", "p_name"), done, ["p_partkey"])


@query("SELECT page_id, url FROM pages WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT url AS u FROM pages WHERE page_id % 5 = 0) WHERE u = url)")
def dead_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose URL is not among those known to be gone (every fifth here)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    status = pages.select("url", F.when(F.col("page_id") % 5 == 0, 404).otherwise(200).alias("status"))
    return filters.drop_dead_urls(pages, status, "url")


@query("SELECT page_id, replace(replace(url, 'https://', ''), 'http://', '') AS short_url, regexp_matches(url, 'example\\.com') AS matched FROM pages")
def url_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs without their scheme, and whether they match a regular expression."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.replace(F.replace(u, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")).alias("short_url"), u.rlike(r"example\.com").alias("matched"))


# ---- selection -----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_custkey AS repo_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS is_intervention_pr FROM orders")
def first_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests with a flag on each repository's first."""
    return selection.first_in_group(pull_requests(spark, sf_dir), "repo_id", ["created_at", "id"], "is_intervention_pr").select("id", "repo_id", "is_intervention_pr")


@query(
    "SELECT o_custkey AS repo_id, c_name AS full_name, c_mktsegment AS language, round(c_acctbal, 2) AS stars, count(*) AS agent_pr_count, count(DISTINCT o_orderpriority) AS distinct_agents, "
    "strftime(min(o_orderdate), '%Y-%m-%d') AS intervention_date, strftime(max(o_orderdate), '%Y-%m-%d') AS last_agent_pr_date FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"
)
def repo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a repository: counts, agents, first and last dates."""
    t = selection.pr_table(repositories(spark, sf_dir), pull_requests(spark, sf_dir))
    s = selection.repo_summary(t)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return s.select("repo_id", "full_name", "language", F.round("stars", 2).alias("stars"), "agent_pr_count", "distinct_agents", day("intervention_date"), day("last_agent_pr_date"))


@query("SELECT o_custkey AS repo_id, o_orderpriority AS agent, count(*) AS n FROM orders GROUP BY ALL")
def agent_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's agent counts, one row an agent."""
    s = selection.repo_summary(selection.pr_table(repositories(spark, sf_dir), pull_requests(spark, sf_dir)))
    return s.select("repo_id", F.explode("agent_breakdown").alias("agent", "n"))


@query(
    "WITH s AS (SELECT c_custkey AS repo_id, c_mktsegment AS language, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), "
    "t AS (SELECT language, greatest(1, round_even(20 * count(*) / sum(count(*)) OVER (), 0))::INT AS take FROM s GROUP BY 1), "
    "r AS (SELECT s.*, row_number() OVER (PARTITION BY language ORDER BY n DESC, repo_id) AS rn FROM s) "
    "SELECT repo_id, language, n AS agent_pr_count FROM (SELECT r.*, take FROM r JOIN t USING (language) WHERE rn <= take ORDER BY CASE language WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, language, rn LIMIT 20)"
)
def stratified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty repositories, from each language its share."""
    s = selection.repo_summary(selection.pr_table(repositories(spark, sf_dir), pull_requests(spark, sf_dir))).select("repo_id", "language", "agent_pr_count")
    return selection.suggest_pilot(s, 20, order=("BUILDING", "MACHINERY"))


# ---- report ----------------------------------------------------------------------------------------------------------


@query("SELECT c.agent, c.place::INT AS place, count(o_orderkey) AS n FROM (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW','none']) AS agent, unnest(range(6)) AS place) c LEFT JOIN orders ON o_orderpriority = c.agent GROUP BY ALL")
def frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by agent in a fixed order, one that never occurs included."""
    return report.frequency(pull_requests(spark, sf_dir), "agent", [*PRIORITIES, "none"])


@query("WITH t AS (SELECT l_partkey AS v, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY 1 ORDER BY n DESC, f LIMIT 10) SELECT coalesce(v::VARCHAR, 'Other (' || count(DISTINCT l_partkey) || ' codes)') AS label, count(*) AS n FROM lineitem LEFT JOIN t ON l_partkey = t.v GROUP BY v")
def top_n_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent parts, the rest as Other."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("f"))
    return report.top_n_other(df, "v", 10, "f")


@query("SELECT o_custkey AS repo_id, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, min(o_orderkey) LIMIT 12")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve repositories with most pull requests."""
    return report.top_n(pull_requests(spark, sf_dir), "repo_id", 12, "id")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def month_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests by month and agent."""
    return report.crosstab(pull_requests(spark, sf_dir).select(timing.month(F.col("created_at")).alias("month"), "agent"), "month", "agent", PRIORITIES)


@query(f"SELECT agent, round(median(date_diff('microsecond', created_at, closed_at) / 3.6e9), 4) AS median, count(closed_at) AS n FROM {_CLOSED} GROUP BY 1")
def median_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median hours to closing by agent."""
    df = closed_pull_requests(spark, sf_dir).select("agent", timing.hours(F.col("created_at"), F.col("closed_at")).alias("h"))
    return report.median_by(df, "agent", "h").select("agent", F.round("median", 4).alias("median"), "n")


@query(
    "SELECT o_orderpriority AS agent, n, round(v[least(floor(n * 0.25::DOUBLE), n - 1)::INT + 1], 2) AS p25, round(v[least(floor(n * 0.75::DOUBLE), n - 1)::INT + 1], 2) AS p75, round(v[least(floor(n * 0.9::DOUBLE), n - 1)::INT + 1], 2) AS p90 "
    "FROM (SELECT o_orderpriority, count(o_totalprice) AS n, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1)"
)
def nearest_rank_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of the price by agent."""
    out = report.nearest_rank(pull_requests(spark, sf_dir), "agent", "price")
    return out.select("agent", "n", *[F.round(c, 2).alias(c) for c in ("p25", "p75", "p90")])


@query("SELECT least(floor((log10(greatest(l_extendedprice, 0.05)) - 2) / (4.0 / 24)) + 1, 24)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 100 AND 1000000 GROUP BY 1")
def log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in 24 bins on a log scale."""
    df = table(spark, sf_dir, "lineitem").where("l_extendedprice BETWEEN 100 AND 1000000")
    return report.log_histogram(df, "l_extendedprice", 100, 1e6)


@query("SELECT l_returnflag AS flag, round(min(l_quantity), 4) AS least, round(max(l_quantity), 4) AS most, round(avg(l_quantity), 4) AS mean, count(l_quantity) AS n FROM lineitem GROUP BY 1")
def duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, most, mean and number of quantities by flag."""
    out = report.duration_stats(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")
    return out.select(F.col("l_returnflag").alias("flag"), *[F.round(c, 4).alias(c) for c in ("least", "most", "mean")], "n")


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types and their shares."""
    return report.shares(table(spark, sf_dir, "events"), "event_type").select("event_type", "n", F.round("share", 6).alias("share"))


@query("SELECT strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_at, count(*) FILTER (o_orderstatus = 'F') AS finished, count(DISTINCT o_custkey) AS repos FROM orders")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last dates, finished pull requests and repositories."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return pull_requests(spark, sf_dir).agg(at(F.min("created_at")).alias("first_at"), at(F.max("created_at")).alias("last_at"), F.count_if(F.col("state") == "F").alias("finished"), F.countDistinct("repo_id").alias("repos"))


@query("SELECT o_custkey AS repo_id, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def multi_agent_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories with several agents."""
    return report.multi_value_groups(pull_requests(spark, sf_dir), "repo_id", "agent")


@query("SELECT agent, n, CASE WHEN h >= 24 THEN printf('%.1fd', h / 24) ELSE printf('%.1fh', h) END AS shown FROM (SELECT event_type AS agent, count(*) AS n, count(*) / 128.0::DOUBLE AS h FROM events GROUP BY 1)")
def humanised_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours as text, in days from one day on."""
    c = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("agent")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("agent", "n", timing.humanised(F.col("n") / F.lit(128.0)).alias("shown"))


@query("SELECT o_custkey AS repo_id, min(p) AS top_agent FROM (SELECT o_custkey, o_orderpriority AS p, rank() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC) AS r FROM orders GROUP BY 1, 2) WHERE r = 1 GROUP BY 1")
def modal_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repository's most frequent agent."""
    return report.modal(pull_requests(spark, sf_dir), "repo_id", "agent").withColumnRenamed("agent", "top_agent")


@query(
    "WITH c AS (SELECT p_brand AS key, l_suppkey AS s, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), "
    "r AS (SELECT key, coalesce(sum(n) OVER (PARTITION BY key ORDER BY n DESC, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, sum(n) OVER (PARTITION BY key) AS t FROM c) SELECT key, count(*) FILTER (run < t * 0.5) AS bus_factor FROM r GROUP BY 1"
)
def bus_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest suppliers that make half of each brand's lines."""
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("key"), "l_suppkey")
    return report.bus_factor(df, "key", "l_suppkey")


@query("SELECT p_brand AS key, p_partkey, p_size >= quantile_cont(p_size, 0.9) OVER (PARTITION BY p_brand) AS large FROM part")
def own_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts at or above their brand's 90th percentile of size."""
    df = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), "p_partkey", "p_size")
    return report.above_own_percentile(df, "key", "p_size", 0.9, "large").drop("p_size")


# ---- time -------------------------------------------------------------------------------------------------------------


@query("SELECT strftime(unnest(generate_series(TIMESTAMP '2022-01-01', TIMESTAMP '2026-03-31', INTERVAL 1 MONTH)), '%Y-%m-%d') AS target_date")
def monthly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month starts of the study window."""
    return timegrid.monthly_grid(spark).select(F.date_format("target_date", "yyyy-MM-dd").alias("target_date"))


_A2 = "list_distinct(list_concat(list_transform(generate_series(-91, 91, 7), lambda d: t0 + to_days(d::INT)), list_concat(list_transform(generate_series(4, 12), lambda m: t0 + to_months(m::INT)), list_transform(generate_series(4, 12), lambda m: t0 - to_months(m::INT)))))"


@query(f"SELECT repo_id, strftime(unnest({_A2}), '%Y-%m-%d %H:%M:%S') AS target_date FROM (SELECT o_custkey AS repo_id, min(o_orderdate) AS t0 FROM orders GROUP BY 1)")
def intervention_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points around each repository's first pull request."""
    at = pull_requests(spark, sf_dir).groupBy("repo_id").agg(F.min("created_at").alias("at"))
    return at.select("repo_id", F.explode(timegrid.intervention_points(F.col("at"))).alias("t")).select("repo_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("target_date"))


_COMMITS = "(SELECT o_custkey AS repo_id, l_shipdate AS commit_date, max(l_orderkey * 10 + l_linenumber) AS sha FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
_MANIFEST = (
    f"(SELECT g.repo_id, g.track, g.t, c.commit_date, c.sha FROM (SELECT o_custkey AS repo_id, 'A1' AS track, t FROM (SELECT DISTINCT o_custkey FROM orders) CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1997-03-31', INTERVAL 1 MONTH)) AS t) "
    f"UNION ALL SELECT repo_id, 'A2', unnest({_A2}) FROM (SELECT o_custkey AS repo_id, min(o_orderdate) AS t0 FROM orders GROUP BY 1)) g ASOF LEFT JOIN {_COMMITS} c ON g.repo_id = c.repo_id AND g.t >= c.commit_date)"
)


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    prs = pull_requests(spark, sf_dir)
    repos = prs.groupBy("repo_id").agg(F.min("created_at").cast("timestamp").alias("intervention_date")).withColumns({"full_name": F.concat(F.lit("owner/"), F.col("repo_id")), "language": F.lit("Python")})
    lines = table(spark, sf_dir, "lineitem").join(prs.select("id", "repo_id"), F.col("l_orderkey") == F.col("id"))
    commits = lines.groupBy("repo_id", F.col("l_shipdate").cast("timestamp").alias("commit_date")).agg(F.max(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sha"))
    return timegrid.manifest(repos, commits, "1995-01-01", "1997-03-31")


@query(
    f"SELECT repo_id, track, strftime(t, '%Y-%m-%d %H:%M:%S') AS target_date, sha AS commit_sha, strftime(commit_date, '%Y-%m-%d %H:%M:%S') AS commit_date, (date_diff('microsecond', commit_date, t) // 86400000000)::INT AS staleness_days, "
    f"coalesce(date_diff('microsecond', commit_date, t) // 86400000000 > 45, false) AS is_stale, sha IS NULL AS no_prior_commit FROM {_MANIFEST}"
)
def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot manifest: both grids, the last commit at or before each point, staleness flags."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return _manifest(spark, sf_dir).select("repo_id", "track", at("target_date"), "commit_sha", at("commit_date"), "staleness_days", "is_stale", "no_prior_commit")


@query(f"SELECT DISTINCT concat('owner/', repo_id) AS full_name, 'Python' AS language, sha AS commit_sha FROM {_MANIFEST} WHERE sha IS NOT NULL")
def distinct_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct commits of the manifest."""
    return timegrid.unique_commits(_manifest(spark, sf_dir))


@query(f"SELECT concat('owner__', repo_id, '__', track, '__', strftime(t, '%Y-%m-%d')) AS tag, count(*) AS n FROM {_MANIFEST} WHERE sha IS NOT NULL AND regexp_matches(concat('owner/', repo_id), '7$') GROUP BY 1")
def eligible_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the snapshots to analyse, of repositories whose name matches a pattern."""
    m = timegrid.eligible(_manifest(spark, sf_dir), "7$")
    return m.select(timegrid.snapshot_tag().alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT a.id, count(b.id) AS open_pr_num FROM {_CLOSED} a LEFT JOIN {_CLOSED} b ON a.repo_id = b.repo_id AND b.created_at < a.created_at AND (b.closed_at IS NULL OR b.closed_at > a.created_at) GROUP BY 1")
def open_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests of the same repository that are open at each one's start."""
    return joins.open_at(closed_pull_requests(spark, sf_dir), "repo_id", "created_at", "closed_at", "open_pr_num").select("id", "open_pr_num")


@query("SELECT a.o_orderkey AS id, count(b.o_orderkey) AS prev_pullreqs FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY 1")
def prior_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier pull requests of the same author."""
    return joins.prior_count(pull_requests(spark, sf_dir), "user_id", "created_at", "prev_pullreqs").select("id", "prev_pullreqs")


@query(f"SELECT a.id, round(count(b.id) FILTER (b.state = 'F') / nullif(count(b.id), 0), 6) AS success_rate FROM {_CLOSED} a LEFT JOIN {_CLOSED} b ON a.repo_id = b.repo_id AND b.closed_at < a.created_at GROUP BY 1")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an author's ended pull requests that were merged, before each start."""
    out = joins.success_before(closed_pull_requests(spark, sf_dir), "repo_id", "created_at", "closed_at", F.col("merged"))
    return out.select("id", F.round("success_rate", 6).alias("success_rate"))


@query(
    "SELECT o.o_orderkey AS id, count(DISTINCT l.l_suppkey) AS team_size FROM orders o LEFT JOIN (SELECT o_custkey AS c, l_suppkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey) l "
    "ON l.c = o.o_custkey AND l.l_shipdate < o.o_orderdate AND l.l_shipdate >= o.o_orderdate - INTERVAL 90 DAY GROUP BY 1"
)
def rolling_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct actors in the 90 days before each pull request."""
    prs = pull_requests(spark, sf_dir)
    acts = table(spark, sf_dir, "lineitem").join(prs.select("id", "repo_id"), F.col("l_orderkey") == F.col("id")).select("repo_id", F.col("l_suppkey").alias("actor"), F.col("l_shipdate").alias("at"))
    return joins.rolling_distinct(acts, prs, "repo_id", "at", "created_at", "actor", 90, "team_size").select("id", "team_size")


@query(
    "SELECT event_id, user_id, (rn - ev)::BIGINT AS \"offset\" FROM (SELECT *, min(CASE WHEN event_type = 'purchase' THEN rn END) OVER (PARTITION BY user_id) AS ev FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)) WHERE rn - ev BETWEEN -10 AND 10"
)
def event_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events up to ten places around each user's first purchase."""
    return joins.neighbours(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "user_id", "offset")


@query(
    "SELECT o_orderkey AS id, month, n, n < 10 AS under_sampled FROM (SELECT o_orderkey, c_mktsegment, strftime(o_orderdate, '%Y-%m') AS month, row_number() OVER w AS rn, count(*) OVER (PARTITION BY c_mktsegment, strftime(o_orderdate, '%Y-%m')) AS n "
    "FROM orders JOIN customer ON o_custkey = c_custkey WHERE day(o_orderdate) <= 2 WINDOW w AS (PARTITION BY c_mktsegment, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate, o_orderkey)) WHERE rn <= 10"
)
def month_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten pull requests of each language and month from its first two days."""
    df = pull_requests(spark, sf_dir).join(repositories(spark, sf_dir).select(F.col("id").alias("repo_id"), "language"), "repo_id")
    return timegrid.month_sample(df, "language", "created_at", ["created_at", "id"], 10, 2).select("id", "month", "n", "under_sampled")


@query("SELECT o_orderkey AS id, isodow(o_orderdate) = 5 AS friday, floor(date_diff('microsecond', first, o_orderdate) / (30.44 * 86400000000))::BIGINT AS months_since FROM (SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first FROM orders)")
def event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fridays, and months since the repository's first pull request."""
    prs = pull_requests(spark, sf_dir)
    first = prs.groupBy("repo_id").agg(F.min("created_at").alias("first"))
    return prs.join(first, "repo_id").select("id", timing.is_friday(F.col("created_at")).alias("friday"), timegrid.months_since(F.col("first"), F.col("created_at")).alias("months_since"))


# ---- metrics ---------------------------------------------------------------------------------------------------------


@query("SELECT o.o_orderkey AS pr_id, count(DISTINCT u) AS num_participants FROM orders o LEFT JOIN (SELECT l_orderkey AS k, l_suppkey AS u FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey, l_partkey FROM lineitem) c ON c.k = o.o_orderkey AND c.u <> o.o_custkey GROUP BY 1")
def participants_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct people over two channels, without the author."""
    lines = table(spark, sf_dir, "lineitem")
    prs = pull_requests(spark, sf_dir).select("id", F.col("user_id").cast("string").alias("user"))
    a = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("pr_id"), F.col("l_suppkey").cast("string").alias("user"))
    b = lines.select(F.col("l_orderkey").alias("pr_id"), F.col("l_partkey").cast("string").alias("user"))
    return metrics_pr.participants(prs, a, b)


@query("SELECT l_orderkey AS pr_id, round(sum(l_quantity), 4) AS additions, round(sum(l_tax), 4) AS deletions FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem) GROUP BY 1")
def dedupe_then_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over rows that are distinct by commit."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pr_id"), "l_linenumber", F.col("l_quantity").alias("additions"), F.col("l_tax").alias("deletions"))
    out = report.dedupe_then_sum(df, ["pr_id", "l_linenumber"], ["additions", "deletions"], "pr_id")
    return out.select("pr_id", F.round("additions", 4).alias("additions"), F.round("deletions", 4).alias("deletions"))


@query(
    "SELECT o_orderkey AS pr_id, CASE WHEN f IS NOT NULL THEN round(greatest(date_diff('microsecond', o_orderdate, f) / 6e7, 0), 4) END AS first_response_time FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey <> o_custkey GROUP BY 1) ON l_orderkey = o_orderkey"
)
def first_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes to the first act of someone else."""
    lines = table(spark, sf_dir, "lineitem")
    prs = pull_requests(spark, sf_dir).select("id", "created_at", F.col("user_id").cast("string").alias("user"))
    c = [lines.where(w).select(F.col("l_orderkey").alias("pr_id"), F.col("l_suppkey").cast("string").alias("user"), F.col("l_shipdate").alias("at")) for w in ("l_returnflag = 'R'", "l_returnflag <> 'R'")]
    return metrics_pr.first_response(prs, *c).select("pr_id", F.round("first_response_time", 4).alias("first_response_time"))


@query("SELECT o_orderkey AS pr_id, count(l_orderkey) FILTER (l_returnflag = 'N') + count(l_orderkey) FILTER (l_returnflag = 'A') - count(l_orderkey) FILTER (l_linestatus = 'F') AS interaction_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def interaction_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts in two channels less their mirrors."""
    lines = table(spark, sf_dir, "lineitem").withColumn("pr_id", F.col("l_orderkey"))
    return metrics_pr.interaction_count(pull_requests(spark, sf_dir), lines.where("l_returnflag = 'N'"), lines.where("l_returnflag = 'A'"), mirrored=lines.where("l_linestatus = 'F'"))


@query(
    "SELECT o_orderkey AS pr_id, count(DISTINCT l_linenumber) AS commits, count(DISTINCT l_partkey) AS files, count(DISTINCT l_partkey) FILTER (l_shipdate < o_orderdate + INTERVAL 30 DAY) AS files_early, coalesce(bool_or(l_linestatus = 'O'), false) AS has_open "
    "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
)
def size_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, files and early files of each pull request."""
    prs, lines = pull_requests(spark, sf_dir), table(spark, sf_dir, "lineitem")
    early = F.col("l_shipdate") < F.col("created_at") + F.expr("INTERVAL 30 DAYS")
    return prs.join(lines, F.col("id") == F.col("l_orderkey"), "left").groupBy(F.col("id").alias("pr_id")).agg(
        F.countDistinct("l_linenumber").alias("commits"), F.countDistinct("l_partkey").alias("files"), F.countDistinct(F.when(early, F.col("l_partkey"))).alias("files_early"), F.coalesce(F.bool_or(F.col("l_linestatus") == "O"), F.lit(False)).alias("has_open"),
    )


@query("SELECT conv_id, count(*) AS num_comments, count(*) FILTER (role = 'user') AS num_comments_con, count(*) > 0 AS has_comments, coalesce(bool_or(regexp_matches(text, '(?i)conflict')), false) AS comment_conflict FROM conversations GROUP BY 1")
def comment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments in all and by the author, and whether any speaks of a conflict."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pr_id"), F.col("role").alias("user"), F.col("text").alias("body"))
    prs = c.select(F.col("pr_id").alias("id")).distinct().withColumn("user", F.lit("user"))
    counts = metrics_pr.comment_counts(prs, c, c.limit(0))
    said = metrics_pr.comment_conflict(prs, c)
    return counts.join(said, "pr_id").select(F.col("pr_id").alias("conv_id"), "num_comments", "num_comments_con", "has_comments", "comment_conflict")


@query(
    "SELECT doc_id, regexp_matches(text, '(?:^|\\s)#[0-9]+') AS hash_tag, regexp_matches(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', ' ', 'g'), '(?:^|[^A-Za-z0-9_.@/])@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?') AS at_tag, regexp_matches(text, '(?i)conflict') AS conflict FROM documents"
)
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of issues, of users and of conflicts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body"))
    return metrics_pr.text_flags(docs).select(F.col("pr_id").alias("doc_id"), "hash_tag", "at_tag", "conflict")


@query(
    "SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: x IN ('the', 'and', 'of', 'is', 'to'))) / len(w) END, 6) AS density FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}]+'), lambda x: x <> '') AS w FROM documents)"
)
def keyword_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a lexicon's words in every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.keyword_density(F.col("text"), LEXICON), 6).alias("density"))


@query(
    "WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}]+'), lambda x: x <> '') AS w FROM conversations), "
    "g AS (SELECT conv_id, turn, unnest(list_distinct(list_concat(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]), list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS gram FROM w) "
    "SELECT gram, count(*) AS df FROM g GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.95 * (SELECT count(*) FROM conversations)"
)
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of two- and three-word runs over all turns."""
    return metrics_pr.vocabulary(table(spark, sf_dir, "conversations"), "text")


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' THEN 0 WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS loc, len(regexp_extract_all(text, '\\bassert\\w*\\b')) AS asserts FROM documents")
def code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and assertions of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", metrics_code.physical_lines(F.col("text")).alias("loc"), metrics_code.asserts(F.col("text")).alias("asserts"))


@query(
    "SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN 0 ELSE n END::BIGINT AS diffhunk_size, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 + n ELSE 0 END::BIGINT AS num_diffhunks "
    "FROM (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS n FROM documents WHERE text IS NOT NULL)"
)
def diffhunk_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines and hunks of patches made of documents: one hunk under a file header, a hunk a line, no hunk, no patch."""
    head, hunk = "--- a/x\n+++ b/x\n", "@@ -1 +1 @@\n"
    lines = lambda to: F.concat(F.lit(" "), F.regexp_replace("text", "\n", to))
    kind = F.col("doc_id") % 4
    patch = F.when(kind == 0, F.concat(F.lit(head + hunk), lines("\n+"))).when(kind == 1, F.concat(F.lit(hunk), lines("\n" + hunk + "-"))).when(kind == 2, F.concat(F.lit(head), lines("\n+ ")))
    df = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", patch.alias("patch"))
    return df.select("doc_id", text.changed_lines(F.col("patch")).alias("diffhunk_size"), text.diff_hunks(F.col("patch")).alias("num_diffhunks"))


@query("SELECT c_custkey AS id, c_acctbal >= 0 AS known, CASE WHEN n_name = 'GERMANY' THEN 'tool-a' WHEN n_name = 'FRANCE' THEN 'tool-b' END AS tool, CASE WHEN n_name NOT IN ('GERMANY', 'FRANCE') THEN 'no analyser for ' || n_name END AS error FROM customer JOIN nation ON c_nationkey = n_nationkey")
def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the tool of their language, or an error."""
    df = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = faults.dispatched(df.withColumn("language", F.col("n_name")), {"GERMANY": "tool-a", "FRANCE": "tool-b"})
    return out.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") >= 0).alias("known"), "tool", "error")


@query("SELECT event_type, CASE WHEN json_extract(props, '$.k')::INT % 2 = 0 THEN 'ok' ELSE 'error' END AS status, count(*) AS n FROM events GROUP BY ALL")
def guarded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that fails on odd rows: its results and its errors, counted."""

    def work(row: dict) -> str:
        import json

        k = json.loads(row["props"])["k"]
        if k % 2:
            raise ValueError("odd")
        return str(k)

    return faults.guarded(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), ["event_id", "event_type"], work).groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"))


# ---- statistics --------------------------------------------------------------------------------------------------------


_MW = (
    "WITH d AS (SELECT o_totalprice AS v, o_orderstatus AS g FROM orders WHERE o_orderstatus IN ('F', 'O')), r AS (SELECT v, g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM d) "
    "SELECT n1, n2, round(r1 - n1 * (n1 + 1) / 2.0, 1) AS u, round(2 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1, 6) AS cliffs_delta FROM (SELECT count(*) FILTER (g = 'F') AS n1, count(*) FILTER (g = 'O') AS n2, sum(rk) FILTER (g = 'F') AS r1 FROM r)"
)


@query(_MW)
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mann-Whitney U and Cliff's delta of prices between two states."""
    out = stats.mann_whitney(pull_requests(spark, sf_dir), "price", "state", "F", "O")
    return out.select("n1", "n2", F.round("u", 1).alias("u"), F.round("cliffs_delta", 6).alias("cliffs_delta"))


@query(
    "WITH p AS (SELECT p_brand AS test, (sum(p_size) % 97) / 97.0::DOUBLE AS p FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS k, count(*) OVER () AS m FROM p) "
    "SELECT test, round(p, 6) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC)), 6) AS q FROM r"
)
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benjamini-Hochberg values of a table of tests."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("test")).agg((F.sum("p_size") % 97 / F.lit(97.0)).alias("p"))
    return stats.bh_fdr(p).select("test", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query("SELECT key, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept, count(*) AS n FROM (SELECT p_brand AS key, p_size::DOUBLE AS x, p_retailprice AS y FROM part) GROUP BY 1")
def segmented_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line through each brand's sizes and prices."""
    df = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return stats.trend(df, "key", "x", "y").select("key", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


@query()
def interrupted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and slope after 1996 of monthly prices, within agents."""
    df = pull_requests(spark, sf_dir).select("agent", "price", F.months_between(F.col("created_at").cast("timestamp"), F.to_timestamp(F.lit("1992-01-01"))).alias("t"), F.lit(48.0).alias("event"))
    return stats.segmented_regression(df, "price", "t", "event", unit="agent").select("term", F.round("estimate", 4).alias("estimate"))


@query("SELECT o_custkey AS repo_id, round(avg(o_totalprice) FILTER (o_orderdate < DATE '1996-01-01'), 0) AS before, round(avg(o_totalprice) FILTER (o_orderdate >= DATE '1996-01-01'), 0) AS after, round(avg(o_totalprice) FILTER (o_orderdate >= DATE '1996-01-01') - avg(o_totalprice) FILTER (o_orderdate < DATE '1996-01-01'), 0) AS delta FROM orders GROUP BY 1")
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prices before and after an instant by repository."""
    out = stats.before_after(pull_requests(spark, sf_dir), "repo_id", "price", F.col("created_at") >= F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")), "id")
    return out.select("repo_id", *[F.round(c, 0).alias(c) for c in ("before", "after", "delta")])


@query("SELECT n_name, s_suppkey, rank() OVER (ORDER BY s_nationkey) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2.0::DOUBLE AS avg_rank FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the mean rank of their nation's key."""
    df = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey", "s_nationkey")
    return stats.average_ranks(df, "s_nationkey").drop("s_nationkey")


@query("WITH b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'introduced' WHEN a.k IS NULL THEN 'removed' ELSE 'kept' END AS status FROM b FULL JOIN a ON a.k = b.k")
def snapshot_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities kept, introduced or removed between two snapshots."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return joins.match_snapshots(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), ["k"])


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type; the aggregation that a stream runs with a watermark."""
    return streams.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT p_name, strlen(p_name) AS n, CASE p_type WHEN 'x' THEN 'y' ELSE regexp_replace(lower(trim(p_type)), '[^\\p{L}\\p{N}]', '', 'g') END AS tag FROM part")
def language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as tags."""
    return table(spark, sf_dir, "part").select("p_name", F.octet_length("p_name").cast("long").alias("n"), text.language_tag(F.col("p_type")).alias("tag"))


