"""Per-pull-request metrics over the supplied tables; each gives ``pr_id`` and its value.

Instants before a pull request's start are strictly before. Where a definition says that a value is unknown it is
null, not 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prlens.functions import text, timing
from prlens.operators.joins import channel_union, open_at, prior_count, rolling_distinct, success_before


def _pair(a: str, b: str) -> Column:
    """Two values as one key; null if either is."""
    return F.concat(F.col(a).cast("string"), F.lit("\u0001"), F.col(b).cast("string"))


def with_default(prs: DataFrame, metric: DataFrame, name: str, default: int | float | bool | None) -> DataFrame:
    """``pr_id`` and the metric for every pull request."""
    out = prs.select(F.col("id").alias("pr_id")).join(metric, "pr_id", "left")
    return out if default is None else out.withColumn(name, F.coalesce(name, F.lit(default)))


def review_comments_of(comments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Inline comments with their pull request, through their review."""
    return comments.join(reviews.select(F.col("id").alias("pull_request_review_id"), "pr_id"), "pull_request_review_id")


def bug_fix(prs: DataFrame, issue_labels: DataFrame | None = None, timeline: DataFrame | None = None) -> DataFrame:
    """Whether title or body outside code, a linked issue's label or a label put on the pull request (event ``labeled``) speaks of a bug."""
    said = F.lower(text.strip_code(F.concat_ws(" ", "title", "body"))).rlike(text.BUG_FIX)
    out = prs.select(F.col("id").alias("pr_id"), said.alias("bug_fix"))
    for labels in (issue_labels, timeline.where("event = 'labeled'") if timeline is not None else None):
        if labels is not None:
            hit = labels.where(F.lower("label").rlike(text.BUG_LABEL)).select("pr_id").distinct().withColumn("_l", F.lit(True))
            out = out.join(hit, "pr_id", "left").select("pr_id", (F.col("bug_fix") | F.coalesce("_l", F.lit(False))).alias("bug_fix"))
    return out


def text_flags(prs: DataFrame) -> DataFrame:
    """``hash_tag``, ``at_tag``, ``description_length`` and ``conflict`` of title and body."""
    bare = text.strip_code(F.concat_ws(" ", "title", "body"))
    return prs.select(
        F.col("id").alias("pr_id"), bare.rlike(text.HASH_TAG).alias("hash_tag"), F.regexp_replace(bare, text.EMAIL, " ").rlike(text.AT_TAG).alias("at_tag"),
        text.description_length(F.col("body")).alias("description_length"), bare.rlike(text.CONFLICT).alias("conflict"),
    )


def inline_threads(inline: DataFrame) -> DataFrame:
    """``pr_id`` and ``num_threads``: inline comments that start a thread (in_reply_to_id null)."""
    return inline.where("in_reply_to_id IS NULL").groupBy("pr_id").agg(F.count(F.lit(1)).alias("num_threads"))


def participants(prs: DataFrame, *channels: DataFrame, bots: tuple[str, ...] = ()) -> DataFrame:
    """Distinct people in the channels (pr_id, user), without the author and bots."""
    people = channel_union(*[c.select("pr_id", "user") for c in channels]).where(~text.is_bot(F.col("user"), bots))
    people = people.join(prs.select(F.col("id").alias("pr_id"), F.col("user").alias("_a")), "pr_id").where(~F.col("user").eqNullSafe(F.col("_a")))
    return with_default(prs, people.groupBy("pr_id").agg(F.countDistinct("user").alias("num_participants")), "num_participants", 0)


def ci(prs: DataFrame, runs: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """``ci_exists``, ``ci_latency`` (minutes to the first completion at or after the start) and ``ci_test_passed``; the last two null without runs.

    ``runs`` has pr_id, conclusion and completed_at; commit ``statuses`` (pr_id, state, updated_at) count as runs, but not while pending.
    """
    if statuses is not None:
        runs = runs.select("pr_id", "conclusion", "completed_at").unionByName(statuses.where("state <> 'pending'").select("pr_id", F.col("state").alias("conclusion"), F.col("updated_at").alias("completed_at")))
    r = runs.join(prs.select(F.col("id").alias("pr_id"), F.col("created_at").alias("_t0")), "pr_id")
    done = F.when(F.col("completed_at").cast("timestamp") >= F.col("_t0").cast("timestamp"), timing.minutes(F.col("_t0"), F.col("completed_at")))
    agg = r.groupBy("pr_id").agg(F.lit(True).alias("ci_exists"), F.min(done).alias("ci_latency"), F.bool_and(F.col("conclusion").isin("success", "neutral", "skipped")).alias("ci_test_passed"))
    return with_default(prs, agg, "ci_exists", False)


def comment_counts(prs: DataFrame, comments: DataFrame, inline: DataFrame, bots: tuple[str, ...] = ()) -> DataFrame:
    """Numbers of comments and inline comments, in all and by the author, and whether there are any; bots are left out."""
    both = comments.select("pr_id", "user", F.lit(0).alias("_inline")).unionByName(inline.select("pr_id", "user", F.lit(1).alias("_inline"))).where(~text.is_bot(F.col("user"), bots))
    both = both.join(prs.select(F.col("id").alias("pr_id"), F.col("user").alias("_a")), "pr_id")
    own = F.col("user") == F.col("_a")
    agg = both.groupBy("pr_id").agg(
        F.count_if(F.col("_inline") == 0).alias("num_comments"), F.count_if((F.col("_inline") == 0) & own).alias("num_comments_con"),
        F.count_if(F.col("_inline") == 1).alias("num_code_comments"), F.count_if((F.col("_inline") == 1) & own).alias("num_code_comments_con"),
        F.countDistinct(F.when(F.col("_inline") == 1, F.col("user"))).alias("part_num_code"),
    )
    names = ["num_comments", "num_comments_con", "num_code_comments", "num_code_comments_con", "part_num_code"]
    out = prs.select(F.col("id").alias("pr_id")).join(agg, "pr_id", "left").fillna(0, names)
    return out.withColumn("has_comments", F.col("num_comments") + F.col("num_code_comments") > 0)


def comment_conflict(prs: DataFrame, comments: DataFrame, mergeable: DataFrame | None = None) -> DataFrame:
    """Whether a comment speaks of a conflict, or the state of the merge is dirty."""
    said = comments.groupBy("pr_id").agg(F.bool_or(F.coalesce(F.col("body").rlike(text.CONFLICT), F.lit(False))).alias("comment_conflict"))
    out = with_default(prs, said, "comment_conflict", False)
    if mergeable is None:
        return out
    return out.join(mergeable.groupBy("pr_id").agg(F.bool_or(F.col("mergeable_state") == "dirty").alias("_d")), "pr_id", "left").select("pr_id", "comment_conflict", (F.col("comment_conflict") | F.coalesce("_d", F.lit(False))).alias("conflict"))


def reopened(prs: DataFrame, timeline: DataFrame) -> DataFrame:
    """Whether the timeline holds a reopening."""
    hit = timeline.where("event = 'reopened'").select("pr_id").distinct().withColumn("reopen_or_not", F.lit(True))
    return with_default(prs, hit, "reopen_or_not", False)


def rework(prs: DataFrame, commits: DataFrame, reviews: DataFrame, timeline: DataFrame | None = None) -> DataFrame:
    """Commits (and forced pushes) after the first review; null if there was none."""
    first = reviews.groupBy("pr_id").agg(F.min("submitted_at").alias("_first"))
    acts = commits.select("pr_id", F.col("created_at").alias("_at"))
    if timeline is not None:
        acts = acts.unionByName(timeline.where("event = 'head_ref_force_pushed'").select("pr_id", F.col("created_at").alias("_at")))
    after = first.join(acts, "pr_id", "left").groupBy("pr_id").agg(F.count_if(F.col("_at") > F.col("_first")).alias("rework"))
    return with_default(prs, after, "rework", None)


def friday(prs: DataFrame) -> DataFrame:
    """Whether it was opened on a Friday."""
    return prs.select(F.col("id").alias("pr_id"), timing.is_friday(F.col("created_at")).alias("friday_effect"))


def size_metrics(prs: DataFrame, details: DataFrame) -> DataFrame:
    """Commits, churn, files and tests, in all (``_close``) and before the start (``_open``).

    Commit totals repeat on every file row of a commit and are counted once a commit.
    """
    d = details.join(prs.select(F.col("id").alias("pr_id"), F.col("created_at").alias("_t0")), "pr_id").withColumn("_early", F.col("committed_at").cast("timestamp") < F.col("_t0").cast("timestamp"))
    churn = F.col("additions") + F.col("deletions")
    test = F.col("filename").rlike(text.TEST_FILE)
    files = d.groupBy("pr_id").agg(
        F.countDistinct("sha").alias("num_commits_close"), F.countDistinct(F.when(F.col("_early"), F.col("sha"))).alias("num_commits_open"),
        F.sum(churn).alias("src_churn_close"), F.sum("additions").alias("churn_addition_close"), F.sum("deletions").alias("churn_deletion_close"),
        F.countDistinct("filename").alias("files_changed_close"), F.countDistinct(F.when(F.col("_early"), F.col("filename"))).alias("files_changed_open"),
        F.sum(F.when(test, churn).otherwise(0)).alias("test_churn_close"), F.sum(F.when(test & F.col("_early"), churn).otherwise(0)).alias("test_churn_open"),
        F.bool_or(test).alias("test_inclusion_close"), F.bool_or(test & F.col("_early")).alias("test_inclusion_open"),
        F.sum(text.changed_lines(F.col("patch"))).alias("diffhunk_size"), F.sum(text.diff_hunks(F.col("patch"))).alias("num_diffhunks"),
    )
    once = d.where("_early").select("pr_id", "sha", "commit_stats_additions", "commit_stats_deletions").distinct().groupBy("pr_id").agg(
        F.sum("commit_stats_additions").alias("churn_addition_open"), F.sum("commit_stats_deletions").alias("churn_deletion_open"), F.sum(F.col("commit_stats_additions") + F.col("commit_stats_deletions")).alias("src_churn_open"),
    )
    out = prs.select(F.col("id").alias("pr_id")).join(files, "pr_id", "left").join(once, "pr_id", "left")
    return out.withColumn("ave_diffhunk_size", F.try_divide("diffhunk_size", "num_diffhunks"))


def first_response(prs: DataFrame, *channels: DataFrame) -> DataFrame:
    """Minutes to the first act of someone else in the channels (pr_id, user, at), at least 0; null if none."""
    acts = channels[0]
    for c in channels[1:]:
        acts = acts.unionByName(c)
    acts = acts.join(prs.select(F.col("id").alias("pr_id"), F.col("user").alias("_a"), F.col("created_at").alias("_t0")), "pr_id").where(~F.col("user").eqNullSafe(F.col("_a")) & ~text.is_bot(F.col("user")))
    first = acts.groupBy("pr_id").agg(F.min("at").alias("_f"), F.min("_t0").alias("_t0"))
    return with_default(prs, first.select("pr_id", F.greatest(timing.minutes(F.col("_t0"), F.col("_f")), F.lit(0.0)).alias("first_response_time")), "first_response_time", None)


def history(prs: DataFrame, key: str = "user_id") -> DataFrame:
    """``prev_pullreqs``, ``first_pr`` and ``requester_succ_rate`` (null without an earlier end) of each author."""
    base = prior_count(prs, key, "created_at", "prev_pullreqs")
    base = success_before(base, key, "created_at", "closed_at", F.col("merged_at").isNotNull(), "requester_succ_rate")
    return base.select(F.col("id").alias("pr_id"), "prev_pullreqs", (F.col("prev_pullreqs") == 0).alias("first_pr"), "requester_succ_rate")


def open_queue(prs: DataFrame) -> DataFrame:
    """Pull requests of the repository that are open at the start."""
    return open_at(prs, "repo_id", "created_at", "closed_at", "open_pr_num").select(F.col("id").alias("pr_id"), "open_pr_num")


def team_size(prs: DataFrame, acts: DataFrame, days: int = 90) -> DataFrame:
    """Distinct actors (repo_id, actor, at) in the ``days`` before the start."""
    return rolling_distinct(acts, prs, "repo_id", "at", "created_at", "actor", days, "team_size").select(F.col("id").alias("pr_id"), "team_size")


def prior_reviews(prs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Distinct pull requests that the author reviewed before the start.

    A reviewed pull request counts from its author's first review on, so this is a running count of those firsts.
    """
    firsts = reviews.where(F.col("user").isNotNull()).groupBy("user", "pr_id").agg(F.min("submitted_at").alias("_at"))
    points = prs.select(F.col("id").alias("pr_id"), "user", F.col("created_at").cast("timestamp").alias("_at"), F.lit(1).alias("_own"), F.lit(0).cast("long").alias("_n"))
    rows = points.unionByName(firsts.select(F.col("pr_id"), "user", F.col("_at").cast("timestamp"), F.lit(0).alias("_own"), F.lit(1).cast("long").alias("_n")))
    from prlens.operators.joins import running_before

    return running_before(rows, "user", "_at", {"prior_review_num": F.col("_n")}).where("_own = 1").select("pr_id", "prior_review_num")


def core_member(prs: DataFrame, days: int = 90) -> DataFrame:
    """Whether the author is an owner, member or collaborator, or had one merged in the repository in the ``days`` before."""
    merged = prs.where(F.col("merged_at").isNotNull()).select("repo_id", F.col("user").alias("_u"), F.col("merged_at").alias("_m"))
    keyed = prs.withColumn("_k", _pair("repo_id", "user"))
    won = merged.withColumn("_k", _pair("repo_id", "_u"))
    counts = rolling_distinct(won, keyed, "_k", "_m", "created_at", "_m", days, "_won")
    known = F.col("author_association").isin("OWNER", "MEMBER", "COLLABORATOR") if "author_association" in prs.columns else F.lit(False)
    return counts.select(F.col("id").alias("pr_id"), (F.coalesce(known, F.lit(False)) | (F.col("_won") > 0)).alias("core_member"))


def social_strength(prs: DataFrame, core: DataFrame, contacts: DataFrame) -> DataFrame:
    """Share of the repository's core team (repo_id, member) that the author (user, member) has dealt with; null without a team."""
    team = core.select("repo_id", "member").distinct()
    size = team.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_n"))
    met = prs.select("id", "repo_id", "user").join(team, "repo_id").join(contacts.select("user", "member").distinct(), ["user", "member"]).groupBy("id").agg(F.count(F.lit(1)).alias("_m"))
    out = prs.select("id", "repo_id").join(size, "repo_id", "left").join(met, "id", "left")
    return out.select(F.col("id").alias("pr_id"), F.try_divide(F.coalesce("_m", F.lit(0)), "_n").alias("social_strength"))


def affiliation_of(people: DataFrame, emails: DataFrame | None = None) -> DataFrame:
    """``login`` and ``affiliation``: the company, else the most frequent domain of the person's e-mails (login, email) that is no provider's, else unknown."""
    out = people.select("login", text.affiliation(F.col("company")).alias("_c"))
    if emails is None:
        return out.select("login", F.coalesce("_c", F.lit("unknown")).alias("affiliation"))
    domain = F.lower(F.substring_index("email", "@", -1))
    counts = emails.where(F.contains("email", F.lit("@")) & ~domain.isin(*text.PROVIDERS)).groupBy("login", domain.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    modal = counts.groupBy("login").agg(F.min(F.struct((-F.col("_n")).alias("o"), "_d")).alias("_m")).select("login", text.affiliation(F.col("_m._d")).alias("_e"))
    return out.join(modal, "login", "left").select("login", F.coalesce("_c", "_e", F.lit("unknown")).alias("affiliation"))


def affiliations(prs: DataFrame, people: DataFrame, emails: DataFrame | None = None) -> DataFrame:
    """``contrib_affiliation``, ``inte_affiliation`` and ``same_affiliation`` (null unless both are known); people (login, company)."""
    who = affiliation_of(people, emails)
    out = prs.join(who.select(F.col("login").alias("user"), F.col("affiliation").alias("contrib_affiliation")), "user", "left")
    out = out.join(who.select(F.col("login").alias("merged_by"), F.col("affiliation").alias("inte_affiliation")), "merged_by", "left")
    known = lambda c: F.nullif(F.col(c), F.lit("unknown"))
    return out.select(F.col("id").alias("pr_id"), "contrib_affiliation", "inte_affiliation", (known("contrib_affiliation") == known("inte_affiliation")).alias("same_affiliation"))


def author_facts(prs: DataFrame, users: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """``followers``, ``author_experience`` (years), ``same_user`` (null if unmerged) and, with repositories' dates, ``project_age`` (months)."""
    out = prs.join(users.select(F.col("id").alias("user_id"), "followers", F.col("created_at").alias("_since")), "user_id", "left")
    cols = [F.col("id").alias("pr_id"), "followers", timing.years(F.col("_since"), F.col("created_at")).alias("author_experience"), F.when(F.col("merged_at").isNotNull(), F.col("user") == F.col("merged_by")).alias("same_user")]
    if repos is not None:
        out = out.join(repos.select(F.col("id").alias("repo_id"), F.col("created_at").alias("_born")), "repo_id", "left")
        cols.append(timing.months(F.col("_born"), F.col("created_at")).alias("project_age"))
    return out.select(*cols)


def integrator_availability(prs: DataFrame, acts: DataFrame, top: int = 2) -> DataFrame:
    """Least hours since the last act (repo_id, actor, at) of the repository's ``top`` integrators before the start."""
    from prlens.operators.joins import asof_backward

    counts = acts.groupBy("repo_id", "actor").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.withColumn("_rn", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("_n"), "actor"))).where(F.col("_rn") <= top)
    theirs = acts.join(best.select("repo_id", "actor"), ["repo_id", "actor"], "left_semi").select("repo_id", F.col("at").cast("timestamp").alias("_last"))
    last = asof_backward(prs.select("id", "repo_id", (F.col("created_at").cast("timestamp") - F.expr("INTERVAL 0.000001 SECOND")).alias("_t")), theirs.withColumn("_x", F.lit(1)), "repo_id", "_t", "_last", ["_x"])
    return last.select(F.col("id").alias("pr_id"), ((F.unix_micros("_t") + 1 - F.unix_micros("_last")) / F.lit(3.6e9)).alias("integrator_availability"))


def external_share(prs: DataFrame, days: int = 90) -> DataFrame:
    """Per cent of the repository's merged pull requests of the ``days`` before that came from outside (``is_external``); null if none was merged."""
    span = days * timing.DAY
    from prlens.operators.joins import running_before

    won = prs.where(F.col("merged_at").isNotNull()).select("repo_id", F.col("merged_at").cast("timestamp").alias("_at"), F.lit(0).alias("_own"), F.lit(None).cast("bigint").alias("pr_id"), F.lit(1).cast("long").alias("_n"), F.when(F.col("is_external"), 1).otherwise(0).cast("long").alias("_e"))
    ask = lambda shift, own: prs.select("repo_id", F.timestamp_micros(F.unix_micros(F.col("created_at").cast("timestamp")) - shift).alias("_at"), F.lit(own).alias("_own"), F.col("id").alias("pr_id"), F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_e"))
    run = running_before(won.unionByName(ask(0, 1)).unionByName(ask(span, 2)), "repo_id", "_at", {"_cn": F.col("_n"), "_ce": F.col("_e")}).where("_own > 0")
    pick = lambda c: F.sum(F.when(F.col("_own") == 1, F.col(c)).otherwise(-F.col(c)))
    return run.groupBy("pr_id").agg(pick("_cn").alias("_m"), pick("_ce").alias("_x")).select("pr_id", F.try_divide(F.col("_x") * 100.0, F.col("_m")).alias("perc_external_contribs"))


def commits_on_files(prs: DataFrame, details: DataFrame, history_: DataFrame, days: int = 90) -> DataFrame:
    """Commits (repo_id, filename, sha, at) of the ``days`` before on the files that the pull request touches."""
    touched = prs.join(details.select(F.col("pr_id").alias("id"), "filename").distinct(), "id").withColumn("_k", _pair("repo_id", "filename"))
    acts = history_.withColumn("_k", _pair("repo_id", "filename"))
    per_file = rolling_distinct(acts, touched, "_k", "at", "created_at", "sha", days, "_n")
    return with_default(prs, per_file.groupBy(F.col("id").alias("pr_id")).agg(F.sum("_n").alias("commits_touched")), "commits_touched", 0)


def interaction_count(prs: DataFrame, *channels: DataFrame, mirrored: DataFrame | None = None) -> DataFrame:
    """Acts in all channels (pr_id) less the timeline's mirrors of them."""
    counts = None
    for c, sign in [*((c, 1) for c in channels), *([(mirrored, -1)] if mirrored is not None else [])]:
        part = c.select("pr_id", F.lit(sign).cast("long").alias("_n"))
        counts = part if counts is None else counts.unionByName(part)
    return with_default(prs, counts.groupBy("pr_id").agg(F.sum("_n").alias("interaction_count")), "interaction_count", 0)


def linked_issues(prs: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct linked issues; links (pr_id, issue, linked_at) made after the start where times are known."""
    j = links.join(prs.select(F.col("id").alias("pr_id"), F.col("created_at").alias("_t0")), "pr_id")
    if "linked_at" in links.columns:
        j = j.where(F.col("linked_at").isNull() | (F.col("linked_at").cast("timestamp") > F.col("_t0").cast("timestamp")))
    return with_default(prs, j.groupBy("pr_id").agg(F.countDistinct("issue").alias("linked_issues")), "linked_issues", 0)


def counts_of(prs: DataFrame, table: DataFrame, name: str, distinct: str | None = None) -> DataFrame:
    """Rows (or distinct values) of a table by pull request: commits, reviews, issues."""
    agg = F.countDistinct(distinct) if distinct else F.count(F.lit(1))
    return with_default(prs, table.groupBy("pr_id").agg(agg.alias(name)), name, 0)


def vocabulary(texts: DataFrame, column: str, n: tuple[int, ...] = (2, 3), least: int = 5, most: float = 0.95) -> DataFrame:
    """N-grams with the number of texts that hold them (``df``), pruned below ``least`` texts and above a share of ``most``."""
    tokens = text.words(F.lower(F.col(column)))
    grams = texts.select(F.explode(F.array_distinct(text.ngrams(tokens, *n))).alias("gram"))
    total = texts.count()
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= least) & (F.col("df") <= most * total))


def tf_idf(texts: DataFrame, key: str, column: str, n: tuple[int, ...] = (2, 3), least: int = 5, most: float = 0.95) -> DataFrame:
    """``key``, ``gram``, ``tf`` and ``tf_idf`` of the n-grams that the vocabulary keeps."""
    vocab = vocabulary(texts, column, n, least, most)
    total = texts.count()
    tokens = text.words(F.lower(F.col(column)))
    tf = texts.select(key, F.explode(text.ngrams(tokens, *n)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))
    return tf.join(vocab, "gram").select(key, "gram", "tf", (F.col("tf") * (F.log((F.lit(1.0) + total) / (F.col("df") + 1)) + 1)).alias("tf_idf"))


def flags(prs: DataFrame, condition: Column, name: str) -> DataFrame:
    """A condition on the pull request itself."""
    return prs.select(F.col("id").alias("pr_id"), condition.alias(name))
