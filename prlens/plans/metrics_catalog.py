"""Registered queries of the filters and metrics over views of the test tables that hold nulls, blanks and ties.

The views are written once as SQL that Spark and DuckDB both read, but for the few words that differ; the metrics are
the library's on one side and their definitions in SQL on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prlens.functions import text, timing
from prlens.operators import filters, joins, metrics_code, metrics_pr, report
from prlens.plans.catalog import NOW, query
from prlens.sources import readers

_HOURS = "to_hours(CAST({} AS BIGINT))"  # DuckDB's; Spark's is below
PR = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 50 END AS repo_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 300 END AS user_id,
CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('u', o_custkey % 300) END AS login, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN concat('u', o_custkey % 40) END AS merged_by,
CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state, o_orderpriority AS agent, o_orderkey % 4 = 0 AS is_external,
CASE o_orderkey % 8 WHEN 0 THEN 'Fix crash in `parser`' WHEN 1 THEN 'Привет мир' WHEN 2 THEN NULL WHEN 3 THEN 'Add `bug` view #12' WHEN 4 THEN 'Fix кириллица abc' WHEN 5 THEN '修复 crash' WHEN 6 THEN '' ELSE 'Docs for @alice' END AS title,
CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN 'Repairs a merge conflict' ELSE 'See #4' END AS body, concat('https://x/', o_orderkey % 500) AS html_url,
CASE o_orderkey % 17 WHEN 0 THEN 'OWNER' WHEN 1 THEN 'MEMBER' ELSE 'NONE' END AS author_association,
CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate + {made} END AS created_at, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + {done} END AS closed_at,
CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN o_orderdate + {done} END AS merged_at FROM orders"""
ACTS = """SELECT l_orderkey AS pr_id, l_orderkey * 10 + l_linenumber AS act_id, l_linenumber AS line, CASE WHEN l_partkey % 9 = 0 THEN 'x[bot]' WHEN l_partkey % 10 = 0 THEN NULL ELSE concat('u', l_suppkey * 3 % 300) END AS login,
CASE WHEN l_partkey % 12 = 0 THEN NULL ELSE l_shipdate END AS ts, concat('c', l_linenumber % 3) AS sha, l_returnflag AS flag, l_partkey AS part, l_suppkey % 50 AS repo_id,
CASE l_linenumber % 5 WHEN 0 THEN 'src/TestFoo.java' WHEN 1 THEN 'tests/a.py' WHEN 2 THEN 'src/a_test.go' WHEN 3 THEN 'src/main.py' ELSE '__tests__/x.js' END AS filename,
CAST(l_quantity AS BIGINT) AS additions, CAST(round(l_tax * 100) AS BIGINT) AS deletions, l_orderkey % 90 + l_linenumber % 3 AS commit_stats_additions, l_orderkey % 7 AS commit_stats_deletions,
CASE l_partkey % 6 WHEN 0 THEN 'Merge CONFLICT here' WHEN 1 THEN NULL ELSE 'Looks good' END AS body FROM lineitem"""


def _sql(made: str) -> str:
    return PR.format(made=made.format("o_orderkey % 24"), done=made.format("o_orderkey % 24 + o_orderkey % 40 * 30"))


_PR = f'pr AS (SELECT *, login AS "user" FROM ({_sql(_HOURS)}))'
_ACTS = f'acts AS (SELECT *, login AS "user" FROM ({ACTS}))'
_BOTH = f"WITH {_PR}, {_ACTS} "


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet")).withColumn("user", F.col("login"))


def prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pull requests."""
    return _view(spark, sf_dir, "orders", _sql("make_interval(0, 0, 0, 0, CAST({} AS INT))"))


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as what happens to pull requests."""
    return _view(spark, sf_dir, "lineitem", ACTS)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 9, None).otherwise(F.col("c_acctbal")).alias("stars"), F.col("c_nationkey").alias("forks"), F.col("c_mktsegment").alias("language"), F.col("c_name").alias("full_name"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("login"), F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_nationkey") * 10).alias("followers"))


_REPOS = "repos AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE c_acctbal END AS stars, c_nationkey AS forks, c_mktsegment AS language, c_name AS full_name FROM customer)"
_USERS = "users AS (SELECT c_custkey AS id, 'u' || c_custkey AS login, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey * 10 END AS followers FROM customer)"
_TITLE = r"coalesce(length(regexp_replace(title, '[^\p{L}]', '', 'g')), 0) = 0 OR (length(regexp_replace(title, '[^\p{L}]', '', 'g')) - length(regexp_replace(title, '[^\p{Latin}]', '', 'g'))) / length(regexp_replace(title, '[^\p{L}]', '', 'g')) <= 0.3"

# ---- filters --------------------------------------------------------------------------------------------------------


@query(f"WITH {_PR}, {_REPOS} SELECT pr.id FROM pr JOIN repos ON repo_id = repos.id WHERE stars >= 100 AND state = 'closed' AND merged_at IS NULL AND ({_TITLE}) AND trim(body) <> ''")
def filter_prs_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter chain with its default settings."""
    return filters.filter_prs(prs(spark, sf_dir), _repos(spark, sf_dir))


@query(
    f"WITH {_PR}, {_REPOS}, {_USERS}, dead AS (SELECT 'https://x/' || p_partkey AS url FROM part WHERE p_partkey % 6 = 0) SELECT pr.id FROM pr JOIN repos ON repo_id = repos.id JOIN users ON user_id = users.id "
    f"WHERE stars >= -500 AND language IN ('BUILDING', 'MACHINERY') AND agent IN ('1-URGENT', '2-HIGH', '5-LOW') AND followers >= 30 AND forks >= 2 AND date_diff('microsecond', created_at, TIMESTAMP '{NOW}') // 86400000000 BETWEEN 365 AND 2500 "
    f"AND NOT EXISTS (SELECT 1 FROM dead WHERE url = html_url) AND ({_TITLE})"
)
def filter_prs_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter chain with stars, languages, agents, followers, forks, ages and URLs, all states and bodies."""
    status = _table(spark, sf_dir, "part").select(F.concat(F.lit("https://x/"), F.col("p_partkey").cast("string")).alias("url"), F.when(F.col("p_partkey") % 6 == 0, 404).when(F.col("p_partkey") % 6 > 1, 200).alias("status"))
    return filters.filter_prs(
        prs(spark, sf_dir), _repos(spark, sf_dir), _users(spark, sf_dir), rejected=False, star_minimum=-500, language="BUILDING, MACHINERY", agents=["1-URGENT", "2-HIGH", "5-LOW"], user_minimum=30, forks_minimum=2,
        age_minimum=365, age_maximum=2500, require_body=False, url_status=status, now=NOW,
    )


@query(f"WITH {_PR} SELECT id, state = 'closed' AND merged_at IS NULL AS by_state, closed_at IS NOT NULL AND merged_at IS NULL AS by_dates, CASE WHEN closed_at IS NOT NULL THEN merged_at IS NULL END AS or_open FROM pr")
def rejected_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three notions of a rejected pull request."""
    return prs(spark, sf_dir).select("id", filters.rejected_by_state().alias("by_state"), filters.rejected_by_dates().alias("by_dates"), filters.rejected_or_open().alias("or_open"))


@query(f"WITH {_PR}, {_REPOS}, {_USERS} SELECT pr.id, repo_id, repos.id AS id_repo, full_name, users.id AS id_user, followers, pr.login, users.login AS login_user FROM pr LEFT JOIN repos ON repo_id = repos.id LEFT JOIN users ON user_id = users.id")
def dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests with their repository and author, null keys kept."""
    out = filters.join_dimensions(prs(spark, sf_dir), _repos(spark, sf_dir), _users(spark, sf_dir))
    return out.select("id", "repo_id", "id_repo", "full_name", "id_user", "followers", "login", "login_user")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 61 > 30 AND c_mktsegment IN ('BUILDING', 'FURNITURE')")
def contributor_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories with more than 30 contributors in two languages."""
    repos = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 61).alias("contributors"), F.col("c_mktsegment").alias("language"))
    return filters.contributor_floor(repos, 30, ("BUILDING", "FURNITURE")).select("id")


@query("SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 9 = 0) AS has_agent_config FROM customer")
def agent_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a repository's tree holds an agent's configuration."""
    tree = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo_id"), F.when(F.col("o_orderkey") % 9 == 0, "CLAUDE.md").otherwise("README.md").alias("path"))
    return filters.with_agent_config(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), tree)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 0.25 ELSE 1.0 END::DOUBLE AS weight FROM orders")
def stale_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that are stale or unresolved weigh less."""
    df = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 == 0).alias("is_stale"), (F.col("o_orderkey") % 5 == 0).alias("no_prior_commit"))
    return filters.weigh_stale(df, 0.25).select("id", "weight")


@query(
    "WITH u AS (SELECT c_custkey AS id, c_mktsegment AS s, c_custkey % 6 = 0 AS treated FROM customer), n AS (SELECT s, count(*) AS n FROM u WHERE treated GROUP BY 1), "
    "c AS (SELECT u.*, row_number() OVER (PARTITION BY s ORDER BY id) AS k FROM u WHERE NOT treated) SELECT id, s, treated FROM u WHERE treated UNION ALL SELECT id, s, treated FROM c JOIN n USING (s) WHERE k <= n.n * 2"
)
def matched_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treated units and two untreated ones for each, within strata."""
    u = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("s"), (F.col("c_custkey") % 6 == 0).alias("treated"))
    return filters.matched_arm(u, "treated", ["s"], "id", 2)


# ---- history and queues -----------------------------------------------------------------------------------------------


@query(
    f"WITH {_PR}, h AS (SELECT a.id, (SELECT count(*) FROM pr b WHERE b.user_id = a.user_id AND b.created_at < a.created_at) AS n, (SELECT count(*) FROM pr b WHERE b.user_id = a.user_id AND b.closed_at < a.created_at) AS e, "
    "(SELECT count(*) FROM pr b WHERE b.user_id = a.user_id AND b.closed_at < a.created_at AND b.merged_at IS NOT NULL) AS w FROM pr a) SELECT id AS pr_id, n AS prev_pullreqs, n = 0 AS first_pr, CASE WHEN e > 0 THEN round(w / e, 9) END AS requester_succ_rate FROM h"
)
def author_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier pull requests and success of each author; unknown authors and times have none."""
    return metrics_pr.history(prs(spark, sf_dir)).withColumn("requester_succ_rate", F.round("requester_succ_rate", 9))


@query(f"WITH {_PR} SELECT a.id AS pr_id, (SELECT count(*) FROM pr b WHERE b.repo_id = a.repo_id AND b.created_at < a.created_at AND (b.closed_at IS NULL OR b.closed_at > a.created_at)) AS open_pr_num FROM pr a")
def open_queue_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open pull requests of the repository at the start; unknown repositories and times have none."""
    return metrics_pr.open_queue(prs(spark, sf_dir))


@query(_BOTH + 'SELECT a.id AS pr_id, (SELECT count(DISTINCT r.pr_id) FROM acts r WHERE r."user" = a."user" AND r.line > 4 AND r.ts < a.created_at) AS prior_review_num FROM pr a')
def prior_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests that the author reviewed before."""
    return metrics_pr.prior_reviews(prs(spark, sf_dir), acts(spark, sf_dir).where("line > 4").withColumnRenamed("ts", "submitted_at"))


@query(_BOTH + "SELECT a.id AS pr_id, (SELECT count(DISTINCT login) FROM acts e WHERE e.repo_id = a.repo_id AND e.ts < a.created_at AND e.ts >= a.created_at - INTERVAL 90 DAY) AS team_size FROM pr a")
def team_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actors of the repository in the 90 days before."""
    return metrics_pr.team_size(prs(spark, sf_dir), acts(spark, sf_dir).withColumnRenamed("login", "actor").withColumnRenamed("ts", "at"))


@query(
    f"WITH {_PR} SELECT a.id AS pr_id, author_association IN ('OWNER', 'MEMBER') OR EXISTS (SELECT 1 FROM pr b WHERE b.repo_id = a.repo_id AND b.user_id = a.user_id AND b.merged_at < a.created_at AND b.merged_at >= a.created_at - INTERVAL 90 DAY) AS core_member FROM pr a"
)
def core_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the author belongs to the repository or had one merged there lately."""
    return metrics_pr.core_member(prs(spark, sf_dir))


@query(
    f"WITH {_PR}, w AS (SELECT a.id, count(b.id) AS n, count(b.id) FILTER (b.is_external) AS x FROM pr a LEFT JOIN pr b ON b.repo_id = a.repo_id AND b.merged_at < a.created_at AND b.merged_at >= a.created_at - INTERVAL 90 DAY GROUP BY 1) "
    "SELECT id AS pr_id, CASE WHEN n > 0 THEN round(x * 100.0 / n, 6)::DOUBLE END AS perc_external_contribs FROM w"
)
def external_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of outside contributions among the merged ones of the 90 days before."""
    return metrics_pr.external_share(prs(spark, sf_dir)).withColumn("perc_external_contribs", F.round("perc_external_contribs", 6))


@query(
    _BOTH + ", c AS (SELECT repo_id, login, count(*) AS n FROM acts GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, login NULLS FIRST) AS k FROM c), t AS (SELECT a.repo_id, a.ts FROM acts a JOIN b ON a.repo_id = b.repo_id AND a.login = b.login WHERE k <= 2) "
    "SELECT p.id AS pr_id, round(date_diff('microsecond', (SELECT max(ts) FROM t WHERE t.repo_id = p.repo_id AND t.ts < p.created_at), p.created_at) / 3.6e9, 6) AS integrator_availability FROM pr p"
)
def integrator_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours since the last act of the repository's two busiest people."""
    out = metrics_pr.integrator_availability(prs(spark, sf_dir), acts(spark, sf_dir).withColumnRenamed("login", "actor").withColumnRenamed("ts", "at"))
    return out.withColumn("integrator_availability", F.round("integrator_availability", 6))


@query(
    _BOTH + ", d AS (SELECT DISTINCT pr_id, filename FROM acts WHERE line < 3) SELECT p.id AS pr_id, (SELECT coalesce(sum(n), 0) FROM (SELECT d.filename, count(DISTINCT e.part) AS n FROM d JOIN acts e ON e.filename = d.filename AND e.repo_id = p.repo_id "
    "AND e.ts < p.created_at AND e.ts >= p.created_at - INTERVAL 90 DAY WHERE d.pr_id = p.id GROUP BY 1))::BIGINT AS commits_touched FROM pr p"
)
def commits_on_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of the 90 days before on the files that are touched."""
    a = acts(spark, sf_dir)
    return metrics_pr.commits_on_files(prs(spark, sf_dir), a.where("line < 3").select("pr_id", "filename"), a.select("repo_id", "filename", F.col("part").alias("sha"), F.col("ts").alias("at")))


@query(
    _BOTH + ", team AS (SELECT DISTINCT repo_id, login AS member FROM acts WHERE flag = 'R'), met AS (SELECT DISTINCT 'u' || (part % 300) AS u, login AS member FROM acts WHERE flag <> 'R'), n AS (SELECT repo_id, count(*) AS n FROM team GROUP BY 1) "
    'SELECT p.id AS pr_id, round((SELECT count(*) FROM team t JOIN met m ON m.member = t.member WHERE t.repo_id = p.repo_id AND m.u = p."user") / n.n, 9) AS social_strength FROM pr p LEFT JOIN n ON n.repo_id = p.repo_id'
)
def social_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the core team that the author has dealt with."""
    a = acts(spark, sf_dir)
    team = a.where("flag = 'R'").select("repo_id", F.col("login").alias("member"))
    met = a.where("flag <> 'R'").select(F.concat(F.lit("u"), (F.col("part") % 300).cast("string")).alias("user"), F.col("login").alias("member"))
    return metrics_pr.social_strength(prs(spark, sf_dir), team, met).withColumn("social_strength", F.round("social_strength", 9))


# ---- metrics of one pull request ---------------------------------------------------------------------------------------


_NAMED = "regexp_matches(filename, '(^|/)(tests?|specs?)/|_test\\.|\\.test\\.|Test.*\\.java')"


@query(
    _BOTH + f", d AS (SELECT a.*, a.ts < p.created_at AS early, {_NAMED} AS test, additions + deletions AS churn FROM acts a JOIN pr p ON p.id = a.pr_id), o AS (SELECT pr_id, sum(commit_stats_additions) AS a, sum(commit_stats_deletions) AS b FROM "
    "(SELECT DISTINCT pr_id, sha, commit_stats_additions, commit_stats_deletions FROM d WHERE early) GROUP BY 1) SELECT p.id AS pr_id, count(DISTINCT sha) AS num_commits_close, count(DISTINCT CASE WHEN early THEN sha END) AS num_commits_open, sum(churn)::BIGINT AS src_churn_close, "
    "sum(additions)::BIGINT AS churn_addition_close, sum(deletions)::BIGINT AS churn_deletion_close, count(DISTINCT filename) AS files_changed_close, count(DISTINCT CASE WHEN early THEN filename END) AS files_changed_open, sum(CASE WHEN test THEN churn ELSE 0 END)::BIGINT AS test_churn_close, "
    "sum(CASE WHEN test AND early THEN churn ELSE 0 END)::BIGINT AS test_churn_open, bool_or(test) AS test_inclusion_close, bool_or(test AND early) AS test_inclusion_open, sum(CASE line % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END)::BIGINT AS diffhunk_size, "
    "sum(line % 3)::BIGINT AS num_diffhunks, any_value(o.a)::BIGINT AS churn_addition_open, any_value(o.b)::BIGINT AS churn_deletion_open, any_value(o.a + o.b)::BIGINT AS src_churn_open, CASE WHEN sum(line % 3) > 0 THEN round(sum(CASE line % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END) / sum(line % 3), 9) END AS ave_diffhunk_size "
    "FROM pr p JOIN d ON d.pr_id = p.id LEFT JOIN o ON o.pr_id = p.id GROUP BY p.id"
)
def size_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, churn, files, tests and hunks of every pull request."""
    patch = F.when(F.col("line") % 3 == 1, "@@ -1,2 +1,2 @@\n-a\n+b\n c").when(F.col("line") % 3 == 2, "@@ -1 +1 @@\n+x\n@@ -9 +9 @@\n-y\n--- z")
    d = acts(spark, sf_dir).withColumn("patch", patch).withColumnRenamed("ts", "committed_at")
    return metrics_pr.size_metrics(prs(spark, sf_dir), d).where("num_commits_close IS NOT NULL").withColumn("ave_diffhunk_size", F.round("ave_diffhunk_size", 9))


@query(
    _BOTH + ", r AS (SELECT pr_id, CASE flag WHEN 'A' THEN 'success' WHEN 'R' THEN 'failure' ELSE 'skipped' END AS c, ts FROM acts WHERE line % 2 = 0 UNION ALL SELECT pr_id, CASE flag WHEN 'A' THEN 'success' ELSE 'error' END, ts FROM acts WHERE line % 4 = 1 AND flag <> 'N') "
    "SELECT p.id AS pr_id, count(r.pr_id) > 0 AS ci_exists, round(min(CASE WHEN ts >= created_at THEN date_diff('microsecond', created_at, ts) END) / 6e7, 6) AS ci_latency, bool_and(c IN ('success', 'neutral', 'skipped')) AS ci_test_passed FROM pr p LEFT JOIN r ON r.pr_id = p.id GROUP BY p.id"
)
def ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and statuses of continuous integration."""
    a = acts(spark, sf_dir)
    runs = a.where("line % 2 = 0").select("pr_id", F.expr("CASE flag WHEN 'A' THEN 'success' WHEN 'R' THEN 'failure' ELSE 'skipped' END").alias("conclusion"), F.col("ts").alias("completed_at"))
    statuses = a.where("line % 4 = 1").select("pr_id", F.expr("CASE flag WHEN 'A' THEN 'success' WHEN 'R' THEN 'error' ELSE 'pending' END").alias("state"), F.col("ts").alias("updated_at"))
    return metrics_pr.ci(prs(spark, sf_dir), runs, statuses).withColumn("ci_latency", F.round("ci_latency", 6))


@query(
    _BOTH + ", f AS (SELECT pr_id, min(ts) AS f FROM acts WHERE line > 3 GROUP BY 1), a AS (SELECT pr_id, ts FROM acts WHERE line <= 3 UNION ALL SELECT pr_id, ts FROM acts WHERE flag = 'R') "
    "SELECT p.id AS pr_id, CASE WHEN any_value(f.pr_id) IS NOT NULL THEN count(*) FILTER (a.ts > f.f) END AS rework FROM pr p LEFT JOIN f ON f.pr_id = p.id LEFT JOIN a ON a.pr_id = p.id GROUP BY p.id"
)
def rework(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits and forced pushes after the first review; unknown without one."""
    a = acts(spark, sf_dir)
    timeline = a.select("pr_id", F.when(F.col("flag") == "R", "head_ref_force_pushed").otherwise("labeled").alias("event"), F.col("ts").alias("created_at"))
    return metrics_pr.rework(prs(spark, sf_dir), a.where("line <= 3").withColumnRenamed("ts", "created_at"), a.where("line > 3").withColumnRenamed("ts", "submitted_at"), timeline)


@query(
    _BOTH + ", c AS (SELECT a.*, p.\"user\" AS author, a.line % 2 = 1 AS inl FROM acts a JOIN pr p ON p.id = a.pr_id WHERE a.login IS NULL OR a.login <> 'x[bot]') SELECT p.id AS pr_id, count(c.pr_id) FILTER (NOT inl) AS num_comments, count(*) FILTER (NOT inl AND login_ = author) AS num_comments_con, "
    "count(c.pr_id) FILTER (inl) AS num_code_comments, count(*) FILTER (inl AND login_ = author) AS num_code_comments_con, count(DISTINCT CASE WHEN inl THEN login_ END) AS part_num_code, count(c.pr_id) > 0 AS has_comments "
    "FROM pr p LEFT JOIN (SELECT *, login AS login_ FROM c) c ON c.pr_id = p.id GROUP BY p.id"
)
def comment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments and inline comments, in all and by the author, without bots."""
    a = acts(spark, sf_dir)
    reviews = a.where("line % 2 = 1").select(F.col("act_id").alias("id"), "pr_id").distinct()
    inline = metrics_pr.review_comments_of(a.where("line % 2 = 1").select(F.col("act_id").alias("pull_request_review_id"), "user"), reviews)
    return metrics_pr.comment_counts(prs(spark, sf_dir), a.where("line % 2 = 0"), inline)


@query(
    _BOTH + ", c AS (SELECT pr_id, bool_or(coalesce(regexp_matches(body, '(?i)conflict'), false)) AS c, bool_or(part % 8 = 0) AS d FROM acts GROUP BY 1) SELECT p.id AS pr_id, coalesce(c, false) AS comment_conflict, coalesce(c, false) OR coalesce(d, false) AS conflict FROM pr p LEFT JOIN c ON c.pr_id = p.id"
)
def comment_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether comments speak of a conflict, or the merge is dirty."""
    a = acts(spark, sf_dir)
    return metrics_pr.comment_conflict(prs(spark, sf_dir), a, a.select("pr_id", F.when(F.col("part") % 8 == 0, "dirty").otherwise("clean").alias("mergeable_state")))


@query(_BOTH + "SELECT p.id AS pr_id, EXISTS (SELECT 1 FROM acts a WHERE a.pr_id = p.id AND flag = 'R' AND line = 1) AS reopen_or_not FROM pr p")
def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a pull request was reopened."""
    return metrics_pr.reopened(prs(spark, sf_dir), acts(spark, sf_dir).select("pr_id", F.when((F.col("flag") == "R") & (F.col("line") == 1), "reopened").otherwise("closed").alias("event")))


@query(_BOTH + "SELECT p.id AS pr_id, count(DISTINCT part % 7) FILTER (line <> 2 AND (ts IS NULL OR ts > created_at)) AS linked_issues FROM pr p LEFT JOIN acts a ON a.pr_id = p.id GROUP BY p.id")
def linked_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that were linked after the start, or at an unknown time."""
    return metrics_pr.linked_issues(prs(spark, sf_dir), acts(spark, sf_dir).where("line <> 2").select("pr_id", (F.col("part") % 7).alias("issue"), F.col("ts").alias("linked_at")))


@query(_BOTH + "SELECT p.id AS pr_id, count(a.pr_id) AS rows_of, count(DISTINCT sha) AS commits_of, any_value(dayofweek(created_at) = 5) AS friday_effect FROM pr p LEFT JOIN acts a ON a.pr_id = p.id GROUP BY p.id")
def counts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct commits of every pull request, and whether it was opened on a Friday."""
    p, a = prs(spark, sf_dir), acts(spark, sf_dir)
    return metrics_pr.counts_of(p, a, "rows_of").join(metrics_pr.counts_of(p, a, "commits_of", "sha"), "pr_id").join(metrics_pr.friday(p), "pr_id")


@query(
    _BOTH + ", l AS (SELECT pr_id, bool_or(part % 50 = 0 OR (flag = 'R' AND line = 6)) AS hit FROM acts GROUP BY 1) SELECT p.id AS pr_id, "
    "coalesce(regexp_matches(lower(regexp_replace(concat_ws(' ', title, body), '`[^`]*`', ' ', 'g')), 'fix(e[sd])?|bug|defect|fault|error|crash|repair'), false) OR coalesce(hit, false) AS bug_fix FROM pr p LEFT JOIN l ON l.pr_id = p.id"
)
def bug_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether text outside code, a linked issue or a label speaks of a bug."""
    a = acts(spark, sf_dir)
    labels = a.select("pr_id", F.when(F.col("part") % 50 == 0, "Regression").otherwise("feature").alias("label"))
    timeline = a.select("pr_id", F.when(F.col("flag") == "R", "labeled").otherwise("unlabeled").alias("event"), F.when(F.col("line") == 6, "kind/bug").otherwise("docs").alias("label"))
    return metrics_pr.bug_fix(prs(spark, sf_dir), labels, timeline)


_COMPANY = "CASE c_custkey % 5 WHEN 0 THEN '@MSFT, Inc.' WHEN 1 THEN 'Acme GmbH' WHEN 2 THEN NULL WHEN 3 THEN ' ' ELSE 'Microsoft' END"


@query(
    f"WITH {_PR}, d AS (SELECT 'u' || c_custkey AS login, CASE c_custkey % 5 WHEN 0 THEN 'microsoft' WHEN 1 THEN 'acme' WHEN 4 THEN 'microsoft' WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE 'libreorg' END ELSE 'unknown' END AS a FROM customer) "
    'SELECT p.id AS pr_id, x.a AS contrib_affiliation, y.a AS inte_affiliation, nullif(x.a, \'unknown\') = nullif(y.a, \'unknown\') AS same_affiliation FROM pr p LEFT JOIN d x ON x.login = p."user" LEFT JOIN d y ON y.login = p.merged_by'
)
def affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations of authors and integrators, by company, else by e-mails, else unknown."""
    c = _table(spark, sf_dir, "customer")
    people = c.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("login"), F.expr(_COMPANY).alias("company"))
    mails = c.where("c_custkey % 5 <> 3").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("login"), F.explode(F.array(F.lit("a@gmail.com"), F.lit("b@gmail.com"), F.when(F.col("c_custkey") % 3 == 0, "c@outlook.com").otherwise("c@Libre.org"))).alias("email"))
    return metrics_pr.affiliations(prs(spark, sf_dir), people, mails)


@query(
    f"WITH {_PR}, {_USERS} SELECT p.id AS pr_id, followers, round(date_diff('microsecond', TIMESTAMP '1990-01-01' + to_days(u.id::INT), created_at) / (365.25 * 86400000000), 6) AS author_experience, CASE WHEN merged_at IS NOT NULL THEN p.\"user\" = merged_by END AS same_user, "
    "round(date_diff('microsecond', TIMESTAMP '1991-01-01' + to_days(c_custkey::INT), created_at) / (30.44 * 86400000000), 6) AS project_age FROM pr p LEFT JOIN users u ON p.user_id = u.id LEFT JOIN customer ON p.repo_id = c_custkey"
)
def author_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followers, experience, own merges and the age of the project."""
    at = lambda day: F.expr(f"TIMESTAMP_NTZ '{day}' + make_interval(0, 0, 0, CAST(id AS INT))")
    repos = _repos(spark, sf_dir).select("id", at("1991-01-01 00:00:00").alias("created_at"))
    out = metrics_pr.author_facts(prs(spark, sf_dir), _users(spark, sf_dir).withColumn("created_at", at("1990-01-01 00:00:00")), repos)
    return out.withColumns({c: F.round(c, 6) for c in ("author_experience", "project_age")})


_TF = (
    "WITH t AS (SELECT conv_id * 1000 + turn AS id, list_filter(regexp_split_to_array(lower(text), '[\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}]+'), lambda x: x <> '') AS w FROM conversations), "
    "g AS (SELECT id, unnest(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram FROM t), "
    "d AS (SELECT gram, count(DISTINCT id) AS df FROM g GROUP BY 1 HAVING df >= 5 AND df <= 0.95 * (SELECT count(*) FROM t)) "
)


@query(_TF + "SELECT id, gram, count(*) AS tf, round(count(*) * (ln((1.0 + (SELECT count(*) FROM t)) / (any_value(df) + 1)) + 1), 6) AS tf_idf FROM g JOIN d USING (gram) GROUP BY id, gram")
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the word pairs and triples of every turn."""
    texts = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return metrics_pr.tf_idf(texts, "id", "text").withColumn("tf_idf", F.round("tf_idf", 6))


# ---- reports -------------------------------------------------------------------------------------------------------------


@query(
    f"WITH {_PR}, {_ACTS}, x AS (SELECT p.*, coalesce(s.size, 0) AS size FROM pr p LEFT JOIN (SELECT pr_id, sum(additions) AS size FROM acts GROUP BY 1) s ON s.pr_id = p.id WHERE created_at IS NOT NULL) "
    "SELECT repo_id, strftime(TIMESTAMP '1970-01-01' + to_days(CAST(CAST(epoch(created_at) AS BIGINT) // 2592000 * 30 AS INT)), '%Y-%m-%d') AS interval_start, count(*) AS n, median(size)::DOUBLE AS median_size, round(median(date_diff('microsecond', created_at, closed_at) / 3.6e9), 6) AS median_latency, "
    "count(*) FILTER (regexp_matches(title, '(?i)^revert\\b')) AS reverts, round(avg(regexp_matches(concat_ws(' ', title, body), '#[0-9]+')::INT), 9) AS issue_ratio FROM x GROUP BY 1, 2"
)
def process_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, latency, reverts and issue references by repository and 30 days."""
    sizes = acts(spark, sf_dir).groupBy(F.col("pr_id").alias("id")).agg(F.sum("additions").alias("size"))
    p = prs(spark, sf_dir).where("created_at IS NOT NULL").join(sizes, "id", "left").fillna(0, ["size"])
    out = report.process_metrics(p, "repo_id")
    return out.select("repo_id", F.date_format("interval_start", "yyyy-MM-dd").alias("interval_start"), "n", F.col("median_size").cast("double").alias("median_size"), F.round("median_latency", 6).alias("median_latency"), "reverts", F.round("issue_ratio", 9).alias("issue_ratio"))


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.9), 6) AS p90 FROM part GROUP BY 1")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 90th percentile by brand."""
    return report.quantiles(_table(spark, sf_dir, "part"), "p_brand", "p_retailprice").select("p_brand", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"))


@query(
    "WITH b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linestatus = 'O'), j AS (SELECT a.k AS x, b.k AS y FROM b FULL JOIN a ON a.k = b.k) "
    "SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS kept, count(*) FILTER (y IS NULL) AS introduced, count(*) FILTER (x IS NULL) AS removed, count(*) FILTER (y IS NULL) / count(x) AS introduction_rate, count(*) FILTER (x IS NULL) / count(y) AS removal_rate FROM j"
)
def change_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of introduction and removal between two snapshots."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag", "l_linestatus")
    return report.change_rates(joins.match_snapshots(lines.where("l_returnflag = 'A'"), lines.where("l_linestatus = 'O'"), ["k"]))


@query("SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (o_orderpriority = '5-LOW') AS \"5-LOW\" FROM orders GROUP BY 1")
def dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests of two agents by repository, as covariates."""
    return report.dosage(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("SELECT m, a, n, n / sum(n) OVER (PARTITION BY m) AS share FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_orderpriority AS a, count(*) AS n FROM orders GROUP BY 1, 2)")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of agents in each month."""
    return report.composition(_table(spark, sf_dir, "orders").select(timing.month(F.col("o_orderdate")).alias("m"), F.col("o_orderpriority").alias("a")), "m", "a")


@query(
    "SELECT p_brand AS s, k AS kind, count(*) AS n, CASE WHEN k = 'architecture' THEN round(count(*) / any_value(c), 9) ELSE round(count(*) / (any_value(l) / 1000.0), 9)::DOUBLE END AS density FROM "
    "(SELECT p_brand, CASE WHEN p_partkey % 4 = 0 THEN 'architecture' ELSE 'design' END AS k FROM part) JOIN (SELECT p_brand, sum(p_size) AS l, count(DISTINCT p_type) AS c FROM part GROUP BY 1) USING (p_brand) GROUP BY 1, 2"
)
def smell_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smells per 1000 lines, or per component."""
    part = _table(spark, sf_dir, "part")
    smells = part.select(F.col("p_brand").alias("s"), F.when(F.col("p_partkey") % 4 == 0, "architecture").otherwise("design").alias("kind"))
    sizes = part.groupBy(F.col("p_brand").alias("s")).agg(F.sum("p_size").alias("lines"), F.countDistinct("p_type").alias("components"))
    return metrics_code.smell_density(smells, sizes, ["s"]).withColumn("density", F.round("density", 9))


# ---- code ----------------------------------------------------------------------------------------------------------------


@query(
    "WITH c AS (SELECT p_brand AS g, p_name AS name, p_size AS loc, p_partkey % 40 AS wmc, p_partkey % 9 AS atfd, (p_partkey % 10) / 10.0::DOUBLE AS tcc FROM part), q AS (SELECT g, quantile_cont(loc, 0.9) AS l, quantile_cont(wmc, 0.75) AS w FROM c GROUP BY 1) "
    "SELECT g, name, loc >= l AS large_class, atfd > 5 AND wmc >= w AND tcc < 1 / 3 AS god_object FROM c JOIN q USING (g)"
)
def class_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large classes and god objects, by the group's percentiles."""
    k = F.col("p_partkey")
    one = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("loc"), (k % 40).alias("wmc"), (k % 9).alias("atfd"), ((k % 10) / 10).alias("tcc"))
    return metrics_code.class_smells(_table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.array(one).alias("classes")), "g").select("g", "name", "large_class", "god_object")


_FILES = "SELECT p_brand AS s, {path} AS path, {code} AS text FROM part"
_PATHS = "CASE p_partkey % 6 WHEN 0 THEN 'tests/a.py' WHEN 1 THEN 'src/TestA.java' WHEN 2 THEN 'x.test.js' WHEN 3 THEN 'pkg/a_test.go' WHEN 4 THEN 'spec/a.rb' ELSE 'src/a.py' END"
_TEXTS = "CASE p_partkey % 6 WHEN 0 THEN concat('def test_a():', {n}, '    assert f()', {n}, '# note', {n}, 'def testb(): pass', {n}) WHEN 1 THEN concat('  @Test', {n}, 'Assert.equals(1)') WHEN 2 THEN concat('it(1)', {n}, 'test(2)', {n}, 'expect(3)') WHEN 3 THEN concat('func TestA()', {n}, {n}, 'func TestB()') WHEN 4 THEN concat('  it x', {n}, 'test y') ELSE concat('def test_a():', {n}, '    assert 1') END"


@query(
    "WITH f AS (SELECT p_brand AS s, p_partkey % 6 AS k FROM part), n AS (SELECT s, [4, 2, 3, 3, 2, 2][k + 1] AS loc, [3, 2, 3, 2, 2, 2][k + 1] AS sloc, [3, 2, 3, 2, 2, 0][k + 1] AS t, [1, 1, 2, 2, 2, 0][k + 1] AS c, [1, 1, 1, 0, 0, 0][k + 1] AS a FROM f) "
    "SELECT s, count(*) AS files, sum(loc)::BIGINT AS loc, sum(sloc)::BIGINT AS sloc, round(sum(t) * 1000.0 / sum(sloc), 6)::DOUBLE AS test_lines_per_kloc, round(sum(c) * 1000.0 / sum(sloc), 6)::DOUBLE AS test_cases_per_kloc, round(sum(a) * 1000.0 / sum(sloc), 6)::DOUBLE AS asserts_per_kloc FROM n GROUP BY 1"
)
def snapshot_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, test lines, test cases and assertions of snapshots of files in five languages."""
    files = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("s"), F.expr(_PATHS).alias("path"), F.expr(_TEXTS.format(n="chr(10)")).alias("text"))
    out = metrics_code.snapshot_covariates(files, ["s"])
    return out.select("s", "files", "loc", "sloc", *[F.round(c, 6).alias(c) for c in ("test_lines_per_kloc", "test_cases_per_kloc", "asserts_per_kloc")])


@query(
    "SELECT pr_id, count(*) AS found FROM (SELECT DISTINCT f.l_orderkey AS pr_id, f.l_partkey % 5 AS file, f.l_returnflag AS rule, f.l_quantity AS s, f.l_quantity + 3 AS e FROM lineitem f JOIN lineitem a ON f.l_orderkey = a.l_orderkey AND f.l_partkey % 5 = a.l_partkey % 5 "
    "AND a.l_linenumber % 2 = 1 AND a.l_linenumber * 5 <= f.l_quantity + 3 AND f.l_quantity <= a.l_linenumber * 5 + 6 WHERE f.l_linenumber % 2 = 0) GROUP BY 1"
)
def introduced_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that touch added lines, by pull request."""
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pr_id"), (F.col("l_partkey") % 5).alias("file"), "l_linenumber", F.col("l_returnflag").alias("rule"), F.col("l_quantity").alias("q"))
    findings = li.where("l_linenumber % 2 = 0").select("pr_id", "file", "rule", F.col("q").alias("start_line"), (F.col("q") + 3).alias("end_line"))
    added = li.where("l_linenumber % 2 = 1").select("pr_id", "file", (F.col("l_linenumber") * 5).alias("from_line"), (F.col("l_linenumber") * 5 + 6).alias("to_line"))
    return metrics_code.introduced_in(findings, added, ["pr_id", "file"], "found")


@query("SELECT coalesce(h.k, b.k) AS k, coalesce(h.v, 0) - coalesce(b.v, 0) AS net FROM (SELECT l_orderkey AS k, count(*) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) h FULL JOIN (SELECT l_orderkey AS k, count(*) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON h.k = b.k")
def net_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head minus base of a file metric."""
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit(1).cast("long").alias("v"), "l_returnflag")
    return metrics_code.net_change(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), "k", "v", "net")


@query("SELECT l_orderkey AS pr_id, count(*) AS num_threads FROM lineitem WHERE l_linenumber % 3 = 1 GROUP BY 1")
def inline_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of inline comments."""
    return metrics_pr.inline_threads(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pr_id"), F.when(F.col("l_linenumber") % 3 != 1, F.col("l_linenumber")).alias("in_reply_to_id")))


# ---- scalars and sources -----------------------------------------------------------------------------------------------


@query(
    "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE epoch_us(o_orderdate) - CASE WHEN o_orderkey % 6 = 1 THEN 7200000000 ELSE 0 END END AS any_us, CASE WHEN o_orderkey % 6 IN (0, 2, 3) THEN epoch_us(o_orderdate) WHEN o_orderkey % 6 = 1 THEN epoch_us(o_orderdate) - 7200000000 END AS lenient_us, "
    "o_orderkey % 3 = 0 AS bot, coalesce(o_orderpriority LIKE '%HIGH%' OR o_orderpriority LIKE '%LOW%', false) AS mentioned FROM orders"
)
def parsed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps in several forms, bots by login, phrases of a lexicon."""
    k, day = F.col("o_orderkey") % 6, F.date_format("o_orderdate", "yyyy-MM-dd")
    at = F.when(k == 0, F.concat(day, F.lit("T00:00:00Z"))).when(k == 1, F.concat(day, F.lit(" 00:00:00+02:00"))).when(k == 2, F.concat(day, F.lit(" 00:00:00"))).when(k == 3, F.concat(day, F.lit("T00:00:00.000Z"))).when(k == 4, " ").otherwise("soon")
    login = F.when(F.col("o_orderkey") % 3 == 0, "dependabot[bot]").when(F.col("o_orderkey") % 3 == 1, "bot").otherwise(None)
    df = _table(spark, sf_dir, "orders").withColumn("_at", at).withColumn("_login", login)
    return df.select(F.col("o_orderkey").alias("id"), timing.micros(timing.parse_any(F.col("_at"))).alias("any_us"), timing.micros(timing.parse_lenient(F.col("_at"))).alias("lenient_us"), text.is_bot(F.col("_login")).alias("bot"), text.mentions(F.col("o_orderpriority"), ["high", "low"]).alias("mentioned"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, o_totalprice > 1000 AND o_orderkey % 5 <> 0 AS dear FROM orders")
def nan_as_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN read as null, so that comparisons with it drop the row."""
    df = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("price"))
    return readers.nan_to_null(df).withColumn("dear", F.coalesce(F.col("price") > 1000, F.lit(False)))


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS id FROM orders")
def ids_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from text under the name that has a blank before it."""
    return readers.read_ids(_table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(F.col("o_orderkey").cast("string")).alias(" id")))
