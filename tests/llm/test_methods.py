"""The methods behind the operators: windows, cells, lattices and margins against plain versions."""

import itertools
import math
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F


def test_windows_decide_what_is_kept():
    from prlens.llm.html_extract import main_lines, main_text, page_lines

    para = "<p>" + "word " * 20 + "</p>"
    rest = "".join(f"<div>{w}</div>" for w in ("short", "lines", "of", "no", "weight"))
    links = "".join(f"<div><a href=x>link {i}</a></div>" for i in range(5))
    page = f"<body>{rest}{links}{para}<p><a href=y>a linked heading</a></p>{para}{links}{rest}</body>"
    text = main_text(page)
    assert text == "\n".join(["word " * 19 + "word", "a linked heading", "word " * 19 + "word"])  # surge, dive, links between
    lines = page_lines(page)
    assert main_lines(lines, window=1) != main_lines(lines, window=3)  # a window of one line dives at the linked heading
    assert main_lines(lines, surge=1) != main_lines(lines, surge=80)  # short lines are no surge
    assert main_text(page.replace("<p><a", "<aside class=ad><p>buy</p><p>this</p><p>now</p></aside><p><a")) == text  # noise parts no region


def test_extraction_equals_a_plain_walk():
    """Well-formed pages: the article's blocks as a tree walk by the standard parser gives them."""
    from html.parser import HTMLParser

    from prlens.llm.html_extract import main_text

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.part, self.skip, self.inside = [], "", 0, 0

        def end(self):
            if self.part.split() and self.inside:
                self.out.append(" ".join(self.part.split()))
            self.part = ""

        def handle_starttag(self, tag, attrs):
            if tag in ("p", "h2", "li", "ul", "div", "nav", "article", "aside"):
                self.end()
            self.inside += tag == "article"
            self.skip += tag in ("nav", "aside", "script")

        def handle_endtag(self, tag):
            if tag in ("p", "h2", "li", "ul", "div", "nav", "article", "aside"):
                self.end()
            self.inside -= tag == "article"
            self.skip -= tag in ("nav", "aside", "script")

        def handle_data(self, data):
            self.part += "" if self.skip else data

    gen = np.random.default_rng(6)
    for _ in range(60):
        blocks = ["<p>" + "begin " * 12 + "</p>"]
        for _ in range(int(gen.integers(1, 9))):
            words = " ".join(f"w{gen.integers(0, 50)}" + ("&amp;" if gen.random() < 0.1 else "") for _ in range(int(gen.integers(15, 40))))
            kind = gen.choice(["p", "h2", "aside", "ul", "div"])
            blocks.append(f"<ul><li>{words}</li><li><b>{words}</b></li></ul>" if kind == "ul" else f"<{kind}>{words} <i>x</i></{kind}>")
        page = f"<html><body><nav><p>menu</p></nav><article>{''.join(blocks)}<script>no()</script></article><div>foot</div></body></html>"
        walk = Walk()
        walk.feed(page)
        walk.end()
        assert main_text(page) == "\n".join(walk.out)


def test_long_broken_pages_take_linear_time():

    from prlens.llm.html_extract import main_text

    began = time.process_time()
    for page in ('<span class="ad">x ' * 20_000, "<div>" * 20_000 + "</b>" * 20_000, "<form><p>" * 10_000, "<li>" * 20_000):
        main_text(page)
    assert time.process_time() - began < 20


def test_many_cells_and_repeated_ids(spark, monkeypatch):
    from prlens.llm import knn

    monkeypatch.setattr(knn, "BLOCK_ROWS", 64)
    gen = np.random.default_rng(3)
    centres = gen.normal(0, 1, (12, 6))
    x = centres[gen.integers(0, 12, 1500)] + gen.normal(0, 0.03, (1500, 6))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(100, [float(v) for v in x[100]]), (100, [float(v) for v in x[100]]), (7, [float(v) for v in x[8]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in knn.voronoi_topk(df, F.col("vec_id") % 50 == 0).collect())
    monkeypatch.setattr(knn, "BLOCKS_TOGETHER", 2)  # a query's blocks in many tasks
    assert sorted(tuple(r) for r in knn.voronoi_topk(df, F.col("vec_id") % 50 == 0).collect()) == got
    ids = np.array([i for i, _ in rows])
    full = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    want = []
    for q in sorted({i for i in ids.tolist() if i % 50 == 0}):
        score = full @ full[np.flatnonzero(ids == q)[0]]
        best = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if i != q)[:5]
        want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == want


def test_raking_holds_margins_within_bounds(spark, monkeypatch):
    """Expected tokens of the sample meet all margins, no probability passes 1, and both ways of raking agree with a plain one."""
    from prlens.llm import mixing

    gen = np.random.default_rng(5)
    rows = [(f"s{a}", f"l{b}", f"t{c}", float(gen.integers(1, 1000) * (50 if a == 0 else 1))) for a in range(5) for b in range(3) for c in range(4) if gen.random() < 0.9]
    cells = spark.createDataFrame(rows, "s string, l string, t string, tokens double")
    margins = ("s", "l", "t")
    total = sum(r[3] for r in rows)
    target = {}
    for k, m in enumerate(margins):
        raised = {v: sum(r[3] for r in rows if r[k] == v) ** 0.5 for v in {r[k] for r in rows}}
        target[m] = {v: x / sum(raised.values()) for v, x in raised.items()}
    rate = min([0.5, *(sum(r[3] for r in rows if r[k] == v) / (share * total) for k, m in enumerate(margins) for v, share in target[m].items())])
    p = {r[:3]: 1.0 for r in rows}
    for _ in range(3000):  # plain: each value in turn is scaled by what it misses
        for k, m in enumerate(margins):
            for v, share in target[m].items():
                have = sum(r[3] * min(1.0, p[r[:3]]) for r in rows if r[k] == v)
                for key in p:
                    if key[k] == v:
                        p[key] *= share * rate * total / have
    results = []
    for most in (mixing.ARRAY_CELLS, 0):
        monkeypatch.setattr(mixing, "ARRAY_CELLS", most)
        got = {(r["s"], r["l"], r["t"]): r["probability"] for r in mixing.rake(cells, margins, close=1e-4).collect()}
        results.append(got)
        assert max(got.values()) <= 1 and sum(x > 0.999 for x in got.values()) > 0
        for k, m in enumerate(margins):
            for v, share in target[m].items():
                have = sum(r[3] * got[r[:3]] for r in rows if r[k] == v)
                assert abs(have / (share * rate * total) - 1) < 1e-3, (m, v)
        assert all(abs(got[key] - min(1.0, x)) < 5e-3 for key, x in p.items())
    assert all(abs(results[0][k] - results[1][k]) < 1e-3 for k in results[0])


def test_sample_keeps_to_its_probabilities(spark):
    from prlens.llm.mixing import mix_documents, mix_report

    gen = np.random.default_rng(9)
    rows = [(i, "word " * int(gen.integers(1, 30)), ["a", "b", "c"][int(gen.choice(3, p=[0.8, 0.15, 0.05]))], ["x", "y"][i % 2], str(i % 3)) for i in range(6000)]
    out = mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _topic string")).cache()
    drawn, wanted = out.selectExpr("sum(IF(selected, n_tokens, 0))", "sum(n_tokens * probability)").first()
    assert abs(drawn / wanted - 1) < 0.05
    again = {r["doc_id"] for r in mix_documents(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string, lang string, _topic string")).where("selected").collect()}
    assert again == {r["doc_id"] for r in out.where("selected").collect()}
    for r in mix_report(out, {"source": "source", "lang": "lang"}).collect():
        assert abs(r["expected_share"] - r["target_share"]) < 2e-3 and abs(r["sample_share"] - r["expected_share"]) < 0.04


def test_viterbi_equals_enumeration():
    from prlens.llm import toxicity as tox

    gen = np.random.default_rng(12)
    model = tox.CharModel.of(gen.integers(0, 50, 27**3).astype(float))
    place = {c: k for k, c in enumerate(" abcdefghijklmnopqrstuvwxyz")}

    def score(word, cost):
        s = "  " + word + " "
        return cost + sum(model.log[(place[s[i]] * 27 + place[s[i + 1]]) * 27 + place[s[i + 2]]] for i in range(len(s) - 2)) + tox.PER_LETTER * len(word)

    for _ in range(200):
        signs = "".join(gen.choice(list("abil10@$.*-tt"), int(gen.integers(1, 7))))
        runs = [(k, len(list(g))) for k, g in itertools.groupby(signs)]
        ways = {("".join(t for t, _ in way), sum(c for _, c in way)) for way in itertools.product(*[tox.readings(*r) for r in runs])}
        best = max(score(w, c) for w, c in ways)
        got = model.decode(signs)
        assert math.isclose(max(score(w, c) for w, c in ways if w == got), best, abs_tol=1e-9)
    assert len(model.decode("a.b-" * 50_000)) <= 100_000


def test_scores_of_odd_rows(spark):
    from prlens.llm.quality import QualityModel
    from prlens.llm.toxicity import ToxicityModel

    rows = [(i, ("bad words here " if i % 2 else "a calm and clear text ") * 20, "x", 1.0) for i in range(80)] + [(None, None, "x", 0.0), (200, "", None, 0.0), (201, "long text " * 200_000, "x", 0.0), (3, "bad words here " * 20, "x", 0.0), (3, "bad words here " * 20, "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string, score double")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    for model in (QualityModel.fit(docs, labels), ToxicityModel.fit(docs, labels)):
        got = model.score(docs, keep=("doc_id", "score")).collect()
        assert len(got) == 85 and all(0 <= r["score"] <= 1 for r in got)
        same = {r["score"] for r in got if r["doc_id"] == 3}
        assert len(same) == 1
        assert model.score(docs.limit(0)).count() == 0
    none = QualityModel.fit(docs, labels.limit(0)).score(docs).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]


def test_attention_equals_a_plain_version():
    """Training lowers the loss; scores and weights are those of gated attention written out for each bag."""
    from prlens.llm.quality import QualityModel, _train

    gen = np.random.default_rng(1)
    sizes = gen.integers(1, 6, 40)
    first = np.concatenate([[0], np.cumsum(sizes)])
    x = gen.normal(0, 1, (first[-1], 5)).astype(np.float32)
    y = np.array([float(x[a:b, 0].max() > 0.8) for a, b in itertools.pairwise(first)])
    losses = []
    for epochs in (1, 40, 160):
        m = QualityModel({"mean": np.zeros(5), "std": np.ones(5)} | _train(x, first, y, epochs, 6, 4, 3))
        p = np.clip(m.scores(x, first)[0], 1e-9, 1 - 1e-9)
        losses.append(float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()))
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.1
    att = m.scores(x, first)[1]
    assert np.allclose(np.add.reduceat(att, first[:-1]), 1)
    plain = []
    for a, b in itertools.pairwise(first):
        w = m.weights
        h = np.tanh(x[a:b] @ w["W"] + w["b"])
        e = np.exp((np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["w"])
        plain.append(1 / (1 + np.exp(-(((e / e.sum()) @ h) @ w["c"] + w["d"][0]))))
    assert np.allclose(plain, m.scores(x, first)[0], atol=1e-5)


def test_sanitised_tables_keep_their_columns(spark):
    from prlens.llm.pii import find_private, sanitize

    rows = [(1, "write to a.b@example.org now", "r1", "e1"), (1, "write to a.b@example.org now", "r1", "e1"), (2, None, "r2", "e2"), (None, "call +44 20 7946 0958", "r3", "e3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, email string")
    found = find_private(docs)
    assert found.count() == 4
    out = sanitize(docs, found)
    assert out.columns == docs.columns and sorted((r["row"], r["email"]) for r in out.collect()) == [("r1", "e1"), ("r1", "e1"), ("r2", "e2"), ("r3", "e3")]
    assert all("@" not in (r["text"] or "") and "7946" not in (r["text"] or "") for r in out.collect())
    assert find_private(docs.limit(0)).count() == 0


def test_contamination_does_not_depend_on_the_number_of_indexes(spark, monkeypatch):
    from prlens.llm import decontaminate

    gen = np.random.default_rng(4)
    word = lambda: f"w{int(gen.integers(0, 400))}"
    items = [(i, " ".join(word() for _ in range(14)) + ". " + " ".join(word() for _ in range(5)) + ".") for i in range(40)] + [(None, "no id"), (99, None), (98, "")]
    docs = []
    for d in range(60):
        filler = [" ".join(word() for _ in range(30)) for _ in range(3)]
        docs.append((d, " ".join([filler[0], items[d % 40][1] if d % 3 == 0 else filler[1], filler[2]])))
    docs += [(0, docs[0][1]), (None, docs[3][1]), (500, None), (501, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), tuple(r["items"]), round(r["best_score"], 9)) for r in decontaminate.find_contaminated(d, b).collect())
    planted = {i: (i % 40,) for i in range(60) if i % 3 == 0}
    assert all(x[1] == planted.get(x[0], ()) for x in one if x[0] not in (-1,)) and one[0][1] == (3,)
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 1000)
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), tuple(r["items"]), round(r["best_score"], 9)) for r in decontaminate.find_contaminated(d, b).collect()) == one
    assert decontaminate.find_contaminated(d.limit(0), b).count() == 0 and decontaminate.find_contaminated(d, b.limit(0)).where("contaminated").count() == 0


def test_disclosing_terms_equal_a_plain_count(spark, monkeypatch):
    """Document frequencies, PMI over IC and every occurrence, written out for entities of one and of many documents."""
    from collections import Counter

    import regex

    from prlens.llm import pii
    from prlens.llm.pii import find_private
    from test_operators import BASE, _valid

    gen = random.Random(21)
    words = ["Ünal", "zeta9", "ab", "kappa", "sigma", "omega", "Lambda", "delta", "Theta", "iota", "rho7x", "müller"]
    names = ["ann@x.org", "ANN@x.org", "bob@y.net", "+1 (017) 555-7713", "10.0.0.7", "4785380592391139"]
    rows = []
    for d in range(160):
        parts = gen.choices(words, k=gen.randint(1, 14)) + (gen.choices(names, k=gen.randint(1, 2)) if d % 3 == 0 else [])
        if "ann@x.org" in parts:
            parts.append("secret")
        gen.shuffle(parts)
        rows.append((d, gen.choice([" ", ", ", "-"]).join(parts)))
    rows += [(3, rows[3][1]), (500, None), (501, ""), (502, "secret words, no entity; Secret"), (503, "9 " * 700 + "lonely one@only.example")]
    word = regex.compile(r"(?<![\p{L}\p{N}])\p{L}{3,}+(?![\p{L}\p{N}])")
    held, bare = [], []
    for _, t in rows:
        t = t or ""
        spans = [(k, m.start(), m.end(), m[0]) for k, p in BASE.items() for m in re.finditer(p, t) if _valid(k, m[0])]
        held.append({k + ":" + (v.lower() if k == "email" else re.sub("[^0-9.]", "", v)) for k, _, _, v in spans})
        for _, s, e, _ in spans:
            t = t[:s] + " " * (e - s) + t[e:]
        bare.append(t)
    sets = [{m[0].lower() for m in word.finditer(t)} for t in bare]
    n, n_e, n_t = len(rows), Counter(e for h in held for e in h), Counter(w for s in sets for w in s)
    n_te = Counter((w, e) for s, h in zip(sets, held, strict=True) for w in s for e in h)
    for threshold in (0.8, 0.4):
        told = {w for (w, e), c in n_te.items() if math.log(c * n / (n_t[w] * n_e[e])) >= threshold * math.log(n / n_e[e]) - 1e-9}
        want = sorted((d, tuple(m.span() for m in word.finditer(t) if m[0].lower() in told)) for (d, _), t in zip(rows, bare, strict=True))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted((r["doc_id"], tuple((x["s"], x["e"]) for x in r["terms"])) for r in find_private(df, threshold=threshold).collect())
        assert got == want
        monkeypatch.setattr(pii, "BUCKETS", 2)  # fewer than told terms
        assert "lonely" in told and len(told) < len(n_t)


def test_very_many_matches_are_located(spark):
    from prlens.llm.pii import EMAIL, located

    text = " ".join(f"é{i} a{i}@b.cd" for i in range(3_000))
    began = time.monotonic()
    got = spark.createDataFrame([(text,), ("",), (None,), ("a@b.c",)], "t string").select(located(F.col("t"), EMAIL).alias("x")).collect()
    assert [(x["s"], x["e"], x["v"]) for x in got[0]["x"]] == [(*m.span(), m[0]) for m in re.finditer(r"[a-z0-9]+@b\.cd", text)]
    assert [r["x"] and len(r["x"]) for r in got[1:]] in ([[], None, 1], [[], [], 1])
    assert time.monotonic() - began < 60
