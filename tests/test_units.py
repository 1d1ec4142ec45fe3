"""Helpers on small tables: white space, ties, elapsed days, months, running sums, patches, statistics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from prlens.functions import text, timing
from prlens.operators import faults, filters, joins, metrics_code, metrics_pr, report, selection, stats, timegrid
from prlens.sources import readers, sinks


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_descriptor_and_names():
    assert sinks.descriptor(star_minimum=500, language="Python, C#") == "500-pycsharp"
    assert sinks.descriptor(star_minimum=500, language="Python,C,C++") == "500-pyccpp"
    assert sinks.descriptor() == "default"
    assert sinks.descriptor(rejected=False, user_minimum=3) == "u3-allstates"
    assert sinks.output_name("2026-07-21", "500-pycsharp", 1434) == "07-21-500-pycsharp-1434.csv"


def test_text_functions(spark):
    df = spark.createDataFrame([("a  b\u2003c\x1cd",), ("",), (None,), ("\u00a0 ",)], "t string")
    assert [r[0] for r in df.select(text.word_count(F.col("t"))).collect()] == [4, 0, 0, 0]
    assert [r[0] for r in df.select(text.is_blank(F.col("t"))).collect()] == [False, True, True, True]
    titles = spark.createDataFrame([("Fix bug",), ("修复 错误",), ("123",), (None,), ("abc修",)], "t string")
    assert [r[0] for r in titles.select(text.english_title(F.col("t"))).collect()] == [True, False, True, True, True]
    md = spark.createDataFrame([("see [docs](http://x.y) `code` ```\nblock\n``` http://z end",)], "t string")
    assert md.select(text.description_length(F.col("t"))).first()[0] == 3


def test_time_functions(spark):
    df = spark.createDataFrame([(ts("2024-01-01T23:00:00"), ts("2024-01-02T22:59:59"))], "a timestamp, b timestamp")
    assert df.select(timing.whole_days(F.col("a"), F.col("b"))).first()[0] == 0
    p = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01 00:00:00",), ("x",), (" ",)], "t string").select(timing.parse_any(F.col("t")).alias("t"))
    assert [r[0] is not None for r in p.collect()] == [True, True, False, False]


def test_intervention_points(spark):
    df = spark.createDataFrame([(ts("2024-10-31T10:00:00"),)], "t timestamp").select(timegrid.intervention_points(F.col("t")).alias("p"))
    points = df.first()["p"]
    assert len(points) == 45 and ts("2025-02-28T10:00:00") in points and points == sorted(points)
    assert timegrid.monthly_grid(spark).count() == 51


def test_asof_and_staleness(spark):
    left = spark.createDataFrame([(1, ts("2024-03-01T00:00:00")), (1, ts("2023-01-01T00:00:00")), (2, ts("2024-01-01T00:00:00")), (None, ts("2024-01-01T00:00:00"))], "k int, t timestamp")
    right = spark.createDataFrame([(1, ts("2024-01-01T00:00:00"), "a"), (1, ts("2024-01-01T00:00:00"), "b"), (1, ts("2024-03-01T00:00:01"), "c"), (None, ts("2023-01-01T00:00:00"), "n")], "k int, commit_date timestamp, commit_sha string")
    out = timegrid.flagged(joins.asof_backward(left, right, "k", "t", "commit_date", ["commit_sha"]).withColumnRenamed("t", "target_date"))
    got = {(r["k"], str(r["target_date"])[:10]): (r["commit_sha"], r["staleness_days"], r["is_stale"], r["no_prior_commit"]) for r in out.collect()}
    assert got == {(1, "2024-03-01"): ("b", 60, True, False), (1, "2023-01-01"): (None, None, False, True), (2, "2024-01-01"): (None, None, False, True), (None, "2024-01-01"): (None, None, False, True)}


def test_open_and_history(spark):
    rows = [(1, 1, "2024-01-01", "2024-01-05"), (2, 1, "2024-01-02", None), (3, 1, "2024-01-05", "2024-01-05"), (4, 1, "2024-01-06", "2024-01-07"), (5, 2, "2024-01-06", None)]
    df = spark.createDataFrame([(i, k, ts(a), ts(b) if b else None) for i, k, a, b in rows], "id int, k int, a timestamp, b timestamp")
    assert {r["id"]: r["open_count"] for r in joins.open_at(df, "k", "a", "b").collect()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0}
    assert {r["id"]: r["prior_count"] for r in joins.prior_count(df, "k", "a").collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 0}
    won = joins.success_before(df, "k", "a", "b", F.col("id") == 1)
    assert {r["id"]: r["success_rate"] for r in won.collect()} == {1: None, 2: None, 3: None, 4: 0.5, 5: None}


def test_selection(spark):
    prs = spark.createDataFrame([(1, 10, "A", "2024-01-02", "open"), (2, 10, "B", "2024-01-01", "open"), (3, 10, "A", "2024-01-03", "open"), (4, 11, None, "2024-01-01", "open"), (5, None, "A", "2024-01-01", "open")], "id long, repo_id long, agent string, created_at string, state string")
    repos = spark.createDataFrame([(10, "o/a", "Python", 5.0), (11, "o/b", "C#", 7.0)], "id long, full_name string, language string, stars double")
    t = selection.pr_table(repos, prs)
    assert {r["id"] for r in t.where("is_intervention_pr").collect()} == {2, 4}
    s = {r["repo_id"]: r for r in selection.repo_summary(t).collect()}
    assert s[10]["agent_breakdown"] == {"A": 2, "B": 1} and s[10]["distinct_agents"] == 2 and s[11]["distinct_agents"] == 0
    pick = spark.createDataFrame([(i, "Python" if i < 156 else "C#", 1000 - i) for i in range(235)], "repo_id int, language string, agent_pr_count int")
    assert [r["repo_id"] for r in selection.suggest_pilot(pick, 5).collect()] == [0, 1, 2, 156, 157]


def test_filter_prs(spark):
    prs = spark.createDataFrame(
        [(1, 1, 1, "Fix it", "body", "A", "closed", "2024-01-01T00:00:00Z", None), (2, 1, 1, "Fix it", "  ", "A", "closed", "2024-01-01T00:00:00Z", None), (3, 1, 1, "Fix it", "b", "A", "open", "2024-01-01T00:00:00Z", None), (4, 2, 1, "Fix", "b", "A", "closed", "bad", None), (5, None, 1, "x", "b", "A", "closed", "2024-01-01T00:00:00Z", None)],
        "id long, repo_id long, user_id long, title string, body string, agent string, state string, created_at string, merged_at string",
    )
    repos = spark.createDataFrame([(1, 500.0, "Python"), (2, 500.0, "C#")], "id long, stars double, language string")
    ids = lambda **k: sorted(r["id"] for r in filters.filter_prs(prs, repos, **k).collect())
    assert ids() == [1, 4]
    assert ids(language="Python, Go") == [1]
    assert ids(age_minimum=0, now="2024-02-01") == [1]
    assert ids(rejected=False, require_body=False) == [1, 2, 3, 4]


def test_metrics(spark):
    prs = spark.createDataFrame([(1, "ann", ts("2024-01-05T00:00:00")), (2, "bob", ts("2024-01-06T00:00:00"))], "id long, user string, created_at timestamp")
    a = spark.createDataFrame([(1, "cy", ts("2024-01-05T01:00:00")), (1, "ann", ts("2024-01-05T00:10:00")), (1, "x[bot]", ts("2024-01-05T00:01:00")), (1, "cy", ts("2024-01-05T03:00:00"))], "pr_id long, user string, at timestamp")
    assert {r["pr_id"]: r["num_participants"] for r in metrics_pr.participants(prs, a).collect()} == {1: 1, 2: 0}
    assert {r["pr_id"]: r["first_response_time"] for r in metrics_pr.first_response(prs, a).collect()} == {1: 60.0, 2: None}
    assert [r["friday_effect"] for r in metrics_pr.friday(prs).orderBy("pr_id").collect()] == [True, False]
    reviews = spark.createDataFrame([(1, ts("2024-01-06T00:00:00"))], "pr_id long, submitted_at timestamp")
    commits = spark.createDataFrame([(1, ts("2024-01-05T12:00:00")), (1, ts("2024-01-07T00:00:00"))], "pr_id long, created_at timestamp")
    assert {r["pr_id"]: r["rework"] for r in metrics_pr.rework(prs, commits, reviews).collect()} == {1: 1, 2: None}


def test_code_metrics(spark):
    src = "class A(B):\n    def f(self, x):\n        y = 1\n        if x and self.a:\n            for i in x:\n                pass\n        return self.a\n"
    out = metrics_code.file_metrics(spark.createDataFrame([(1, src), (2, "def ("), (3, None)], "id int, text string"), ["id"])
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["cyclomatic"] == 4 and got[1]["nesting"] == 2 and got[1]["unused_vars"] == 2 and got[1]["classes"][0]["wmc"] == 4
    assert not got[2]["parsed"] and got[2]["error"].startswith("SyntaxError") and got[3]["parsed"]
    token = " ".join(f"t{i}" for i in range(60))
    dup = metrics_code.duplicate_code(spark.createDataFrame([(1, token), (2, "x " + token), (3, "other")], "id int, text string"), ["id"])
    assert dup.select("id").distinct().count() == 2


def test_report_and_stats(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", 1.0)], "g string, v double")
    got = {r["g"]: r for r in report.nearest_rank(df, "g", "v", (0.29, 0.9)).collect()}
    assert got["a"]["p29"] == 28.0 and got["a"]["p90"] == 90.0 and got["b"]["p90"] == 1.0
    q = {r["p"]: round(r["q"], 4) for r in stats.bh_fdr(spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double")).collect()}
    assert q == {0.01: 0.03, 0.04: 0.04, 0.03: 0.04}
    line = spark.createDataFrame([(t, 1.0 + 2 * t + (5 if t >= 5 else 0) + (3 * (t - 5) if t >= 5 else 0), 5) for t in range(12)], "t int, y double, e int")
    est = {r["term"]: round(r["estimate"], 6) for r in stats.segmented_regression(line, "y", "t", "e").collect()}
    assert est == {"intercept": 1.0, "time": 2.0, "level": 5.0, "slope": 3.0}


def test_faults(spark):
    df = spark.createDataFrame([(1, "Python"), (2, "Go"), (3, None)], "id int, language string")
    assert [r["error"] for r in faults.dispatched(df, {"Python": "dpy"}).orderBy("id").collect()] == [None, "no analyser for Go", "no analyser for null"]
    got = faults.guarded(df, ["id"], lambda r: 1 / (r["id"] - 2)).orderBy("id").collect()
    assert [r["status"] for r in got] == ["ok", "error", "ok"]
    assert {r["status"] for r in faults.guarded(df, ["id"], str, dry_run=True).collect()} == {"dry_run"}


def test_sources(spark, tmp_path):
    (tmp_path / "a-1.csv").write_text("\ufeff id,note\n7,\"x\ny\"\nz,q\n", encoding="utf-8")
    (tmp_path / "a-2.csv").write_text("pr_id\n9\n")
    assert readers.latest(spark, f"file://{tmp_path}/a-*.csv").endswith("a-2.csv")
    with pytest.raises(FileNotFoundError):
        readers.latest(spark, f"file://{tmp_path}/none-*.csv")
    ids = readers.read_ids(readers.read_csv(spark, f"file://{tmp_path}/a-1.csv"))
    assert [r["id"] for r in ids.collect()] == [7, None]
    nan = readers.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert nan.where("x >= 0").count() == 1


def test_stream(spark, tmp_path):
    from prlens.streaming import events

    rows = spark.createDataFrame([(ts("2024-01-01T00:10:00"), "a", 1.0), (ts("2024-01-01T00:50:00"), "a", 2.0), (ts("2024-01-01T02:00:00"), "b", 3.0)], "ts timestamp, event_type string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(events.read_events(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double"))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["event_type"], r["n"]) for r in spark.sql("SELECT * FROM counts").collect()} == {("a", 2), ("b", 1)}


def test_small_reports(spark):
    df = spark.createDataFrame([("p1", "a"), ("p1", "a"), ("p1", "b"), ("p2", "b")], "p string, c string")
    assert {(r["p"], r["c"]): round(r["share"], 3) for r in report.composition(df, "p", "c").collect()} == {("p1", "a"): 0.667, ("p1", "b"): 0.333, ("p2", "b"): 1.0}
    assert {r["p"]: (r["a"], r["b"]) for r in report.dosage(df, "p", "c", ["a", "b"]).collect()} == {"p1": (2, 1), "p2": (0, 1)}
    s = report.change_rates(spark.createDataFrame([("kept",), ("introduced",), ("removed",), ("kept",)], "status string")).first()
    assert (s["kept"], round(s["introduction_rate"], 3)) == (2, 0.333)
    units = spark.createDataFrame([(1, True, "x"), (2, False, "x"), (3, False, "x"), (4, False, "y")], "id int, t boolean, s string")
    assert sorted(r["id"] for r in filters.matched_arm(units, "t", ["s"], "id").collect()) == [1, 2]
    files = spark.createDataFrame([(1, "tests/test_a.py", "def test_a():\n    assert 1\n"), (1, "b.py", "# c\nx = 1\n\n")], "k int, path string, text string")
    c = metrics_code.snapshot_covariates(files, ["k"]).first()
    assert (c["files"], c["loc"], c["sloc"], round(c["asserts_per_kloc"])) == (2, 5, 3, 333)
    assert spark.createDataFrame([("Refactor this",), (None,)], "t string").select(text.mentions(F.col("t"), ["refactor"])).collect()[0][0]


def test_cli(spark, tmp_path):
    from prlens import cli

    spark.createDataFrame([(1, 1, "Fix", "b", "A", "closed", "2024-01-01T00:00:00Z", None)], "id long, repo_id long, title string, body string, agent string, state string, created_at string, merged_at string").write.parquet(str(tmp_path / "prs"))
    spark.createDataFrame([(1, 500.0, "Python")], "id long, stars double, language string").write.parquet(str(tmp_path / "repos"))
    cli.main(["filter", "--prs", str(tmp_path / "prs"), "--repos", str(tmp_path / "repos"), "--star-minimum", "500", "--language", "Python, C#", "--out", str(tmp_path / "out")])
    (found,) = (tmp_path / "out").iterdir()
    assert found.name.endswith("-500-pycsharp-deadlinks-1.csv")


def test_history_keeps_rows_without_key_or_time(spark):
    rows = [(1, 10, "2024-01-01", "2024-01-02"), (2, 10, "2024-01-03", None), (3, None, "2024-01-03", "2024-01-04"), (4, None, "2024-01-05", None), (5, 10, None, "2024-01-06"), (6, 10, None, None), (7, 11, "2024-01-01", "2024-01-01")]
    df = spark.createDataFrame(rows, "id long, k long, a string, b string").selectExpr("id", "k", "CAST(a AS timestamp) AS a", "CAST(b AS timestamp) AS b")
    assert {r["id"]: r["prior_count"] for r in joins.prior_count(df, "k", "a").collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    assert {r["id"]: r["open_count"] for r in joins.open_at(df, "k", "a", "b").collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    assert {r["id"]: r["success_rate"] for r in joins.success_before(df, "k", "a", "b", F.lit(True)).collect()} == {1: None, 2: 1.0, 3: None, 4: None, 5: None, 6: None, 7: None}
    seen = joins.rolling_distinct(df.where("a IS NOT NULL"), df, "k", "a", "a", "id", 90)
    assert {r["id"]: r["distinct_count"] for r in seen.collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    at = joins.asof_backward(df.select("id", "k", F.col("a").alias("t")), df.select("k", "a", F.col("id").alias("v")), "k", "t", "a", ["v"])
    assert {r["id"]: r["v"] for r in at.collect()} == {1: 1, 2: 2, 3: None, 4: None, 5: None, 6: None, 7: 7}


def test_rolling_distinct_equals_pairs(spark):
    import random

    rng = random.Random(4)
    events = [(rng.randrange(3), rng.randrange(4), rng.randrange(400)) for _ in range(200)]
    points = [(i, rng.randrange(3), rng.randrange(500)) for i in range(120)]
    day = "timestamp_seconds(d * 86400)"
    e = spark.createDataFrame(events, "k int, v int, d int").selectExpr("k", "v", f"{day} AS t")
    p = spark.createDataFrame(points, "id int, k int, d int").selectExpr("id", "k", f"{day} AS t")
    got = {r["id"]: r["n"] for r in joins.rolling_distinct(e, p, "k", "t", "t", "v", 90, "n").collect()}
    assert got == {i: len({v for k2, v, d2 in events if k2 == k and d - 90 <= d2 < d}) for i, k, d in points}


def test_first_in_group_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 5, None, "x"), (2, 5, 2, "y"), (3, 6, None, "z"), (4, 7, 1, "a"), (5, 7, 1, "b"), (6, None, 1, "c")], "id int, k int, o int, w string")
    got = {r["id"]: r["is_first"] for r in selection.first_in_group(df, "k", ["o"]).collect()}
    assert got[2] and not got[1] and got[3] and got[4] != got[5] and not got[6]


def test_fixed_patterns(spark):
    names = {"src/TestFoo.java": True, "FooTestCase.java": True, "tests/a.py": True, "spec/a.rb": True, "a_test.go": True, "x.test.js": True, "__tests__/x.js": False, "test_x.py": False, "src/latest.py": False}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["t"] for r in df.select("n", F.col("n").rlike(text.TEST_FILE).alias("t")).collect()} == names
    assert [r[0] for r in df.where("n IN ('a_test.go', 'spec/a.rb')").orderBy("n").select(metrics_code.language_of(F.col("n"))).collect()] == ["Go", "Ruby"]


def test_class_hierarchy(spark):
    src = "class A: pass\nclass B(A):\n    def f(self):\n        return A()\nclass C(B, Outside): pass\nclass D(Outside): pass\nclass E(E): pass\n"
    m = metrics_code.file_metrics(spark.createDataFrame([("s", src), ("t", "class A(B): pass\n")], "snap string, text string"), ["snap"])
    got = {(r["snap"], r["name"]): (r["dit"], r["fan_in"]) for r in metrics_code.class_hierarchy(m, ["snap"]).collect()}
    assert got == {("s", "A"): (0, 1), ("s", "B"): (1, 0), ("s", "C"): (2, 0), ("s", "D"): (1, 0), ("s", "E"): (1, 0), ("t", "A"): (1, 0)}


def test_reports_and_names(spark):
    df = spark.range(3)
    assert sinks.report({"Ids": df}, "Report").startswith("# Report\n\n## Ids\n\n| id |")
    with pytest.raises(ValueError):
        sinks.markdown_table(df, 2)
    with pytest.raises(TypeError):
        sinks.descriptor(stars=3)
    assert sinks.descriptor(agents=["Claude_Code", "Devin"], require_live_url=False, age_minimum=0) == "claudecodedevin-amin0-deadlinks"
    tags = spark.createDataFrame([("C++",), (" Python ",), ("Objective-C",)], "l string")
    assert [r[0] for r in tags.select(text.language_tag(F.col("l"))).collect()] == [sinks.language_tag(x) for x in ("C++", " Python ", "Objective-C")]


def test_eligible_and_faults(spark):
    m = spark.createDataFrame([("o/a", "A1", ts("2024-01-01T00:00:00"), "x", False), ("o/b", "A1", ts("2024-01-01T00:00:00"), None, True), ("p/c", "A2", ts("2024-01-01T00:00:00"), "y", False)], "full_name string, track string, target_date timestamp, commit_sha string, no_prior_commit boolean")
    assert [r["full_name"] for r in timegrid.eligible(m).collect()] == ["o/a", "p/c"]
    assert [r["full_name"] for r in timegrid.eligible(m, "^p/").collect()] == ["p/c"] and timegrid.eligible(m, limit=1).count() == 1
    have = spark.createDataFrame([("o/a",)], "full_name string")
    assert {r["full_name"]: r["error"] for r in faults.require_present(m, have, "full_name", "gone").collect()} == {"o/a": None, "o/b": "gone", "p/c": "gone"}
    urls = spark.createDataFrame([("u1",), ("u2",), (None,)], "url string")

    def probe(url):
        if url == "u2":
            raise OSError
        return 404

    assert {r["url"]: r["status"] for r in filters.probe_urls(urls, probe).collect()} == {"u1": 404, "u2": None}


def test_findings_and_versions(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"rule": "r", "line": 3}, {"rule": "q", "line": "no"}]')
    got = readers.read_findings(spark, f"file://{tmp_path}/f.json", "rule string, line int").collect()
    assert {r["rule"]: r["line"] for r in got} == {"r": 3, "q": None}
    spark.range(5).write.parquet(f"file://{tmp_path}/t")
    df = spark.read.parquet(f"file://{tmp_path}/t")
    assert readers.dataset_version(df).first()["files"] == len(df.inputFiles()) and "source_file" in readers.with_lineage(df).columns
    sinks.write_snapshots(spark.createDataFrame([("o/a", "s1", 1)], "repo string, commit_sha string, v int"), f"file://{tmp_path}/snap")
    assert (tmp_path / "snap").exists() and sinks.safe_name("o/a") == "o__a"
    ok, bad = sinks.split_errors(spark.createDataFrame([(1, None), (2, "x")], "id int, error string"))
    assert ok.count() == bad.count() == 1


def test_changed_lines(spark):
    """File headers, lines that start like one, carriage returns inside lines, no hunk, no patch."""
    patches = ["@@ -1,2 +1,3 @@\n a\n+b\n-c\n+d\n", None, "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-++x\n+y\n@@ -9 +9 @@\n+z\n--- q\n", "@@ -1 +1 @@\n+a\r+b -c\u0085@@ d", "--- a/x\n+++ b/x\n+b\n", ""]
    df = spark.createDataFrame(list(enumerate(patches)), "id int, patch string").orderBy("id")
    got = df.select(text.changed_lines(F.col("patch")), text.diff_hunks(F.col("patch"))).collect()
    assert [tuple(r) for r in got] == [(3, 1), (0, 0), (4, 2), (1, 1), (1, 0), (0, 0)]


def test_before_after_on_rounding_limits(spark, tmp_path):
    """Means that lie on x.5: as the SQL has them in order of ids, however the rows are split over files and tasks."""
    import random

    from prlens.plans import catalog

    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(7)
    prices = {}
    for side in range(2):
        for k in range(200):
            cents = [rng.randrange(100_000, 50_000_000) for _ in range(7)]
            cents.append(10_000_000 + (400 - 10_000_000 - sum(cents)) % 800)
            prices |= {(side * 8 + j) * 200 + k: (k, c / 100, ts("1995-06-01") if side == 0 else ts("1997-06-01")) for j, c in enumerate(cents)}
    rows = [(i, k, "F", p, t, "5-LOW") for i, (k, p, t) in sorted(prices.items())] + [(3200, None, "F", 2.0, ts("1997-06-01"), "x"), (3201, 200, "F", None, ts("1997-06-01"), "x"), (3202, 201, "F", 2.5, None, "x")]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR)")
    con.executemany("INSERT INTO orders VALUES (?, ?, ?, ?, ?, ?)", rows)
    want = sorted(map(repr, con.execute(catalog.ORACLES["before_after"]).fetchall()))
    assert len(want) == 203
    for n, dealt in enumerate((orders.repartitionByRange(6, "o_orderkey"), orders.repartition(9, "o_orderpriority", "o_orderkey"), orders.coalesce(1))):
        dealt.write.parquet(f"file://{tmp_path}/{n}/orders.parquet")
        got = catalog.before_after(spark, f"file://{tmp_path}/{n}").select("repo_id", "before", "after", "delta").collect()
        assert sorted(repr(tuple(r)) for r in got) == want
