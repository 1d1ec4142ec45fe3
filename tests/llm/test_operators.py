"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(3)
WORDS = [a + b for a in ("ta", "re", "on", "li", "qu") for b in ("no", "ek", "ur", "is", "am", "ol")]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    base = [prose(rng.randint(30, 200)) for _ in range(24)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(6)]  # copies
    for i in range(8):  # near copies
        w = base[3].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "one two"), (303, "One  two"), (304, " \n "), (305, "é" * 60 + " " + base[5]), (306, base[0].upper()), (7, base[9]), (308, prose(30_000)), (309, "a " * 3000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS).repartition(3)


# ---- extraction -----------------------------------------------------------------------------------------------------


def test_main_text():
    from prlens.llm.html_extract import main_text

    long = "This is a paragraph of running text that is long enough to count as the main part of the page."
    page = f'<!doctype html><html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy now</div><div id="main"><h1>Title</h1><p>{long} &amp; more&nbsp;text<br>end<p>Short.<ul><li>point</ul></div><aside><p>{long}</p></aside><section id="comments"><p>{long} nice</p></section><form><label>Name</label></form><footer>&copy; x</footer>'
    assert main_text(page) == f"Title\n{long} & more text end\nShort.\npoint"
    assert main_text(None) == main_text("") == main_text("<p") == main_text("<!-- <p>x</p>") == ""
    assert main_text(f"<article><header><h1>H</h1></header><p>{long}</p><div class='share-buttons'>Share</div><p>End</p></article><p>{long}") == f"H\n{long}\nEnd"
    assert main_text("<p>tiny") == "tiny"
    assert main_text(f'<div class="has-sidebar"><p>{long}</p></div><div class="side-bar widget">{long}</div>') == long
    assert main_text(f'<div id="header"><p>{long}</p></div>') == long
    assert main_text('<div class="ad">Buy</div><article></article>') == ""
    assert main_text("<" * 50_000 + "<p>x") != "" and main_text("<p title='" * 20_000) is not None


def test_extract_frame(spark):
    from prlens.llm.html_extract import extract_main_text

    df = spark.createDataFrame([(1, "u", "<p>héé</p>", 5), (2, "u", None, 5)], "page_id long, url string, html string, text int")
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in extract_main_text(df).orderBy("page_id").collect()] == [(1, "héé", 3), (2, "", 0)]
    assert extract_main_text(df.limit(0)).count() == 0


# ---- classifiers -----------------------------------------------------------------------------------------------------


def _labelled(spark, bad):
    rows = [(i, bad(i) if i % 3 == 0 else prose(60)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(0, 240)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    return frame(spark, [*rows, (900, None), (901, ""), (None, "x y z")]), labels


def test_quality(spark):
    from prlens.llm.quality import QualityModel

    docs, labels = _labelled(spark, lambda i: " ".join(w + "%%%" for w in prose(60).split()))
    got = {r["doc_id"]: r for r in QualityModel.fit(docs, labels).score(docs).collect()}
    assert len(got) == 243 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [r for i, r in got.items() if r["held_out"] and i is not None and i < 240]
    assert len(held) > 20 and np.mean([r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held]) >= 0.95
    none = QualityModel.fit(docs, labels.limit(0)).score(docs.withColumn("score", F.lit(1)), keep=("doc_id", "score"))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert QualityModel.fit(docs, labels).score(docs.limit(0)).count() == 0


def test_toxicity(spark):
    from prlens.llm.toxicity import CharModel, Restorer, ToxicityModel

    docs, labels = _labelled(spark, lambda i: prose(25) + " grumblewort " + prose(25))
    model = ToxicityModel.fit(docs, labels)
    got = {r["doc_id"]: r for r in model.score(docs).collect()}
    held = [r for i, r in got.items() if r["held_out"] and i is not None and i < 240]
    assert len(got) == 243 and np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held]) >= 0.95
    hidden = frame(spark, [(1, prose(20) + " gr0mbl3 " + prose(20)), (2, prose(20) + " grumbl3w0rt " + prose(20)), (3, prose(20) + " g r u m b l e w o r t " + prose(20)), (4, prose(20) + " gruuuumblewooort " + prose(20))])
    assert [r["predicted"] for r in model.score(hidden).orderBy("doc_id").collect()] == [0, 1, 1, 1]
    counts = np.zeros(27**3)
    plain = Restorer(CharModel.of(counts, ["idiot", "clown"]))
    assert plain.text("an 1D10T, a cl0wn").split() == ["an", "idiot", ",", "a", "clown"] and plain.text(None) == "" and plain.text("call +1 (017) 555-7713") == "call +1 (017) 555-7713"
    assert {r["score"] for r in ToxicityModel.fit(docs, labels.limit(0)).score(docs).collect()} == {0.5}


# ---- search ------------------------------------------------------------------------------------------------------------


def test_no_candidate_is_skipped():
    from prlens.llm.toxicity import CANDIDATE, _may_hold_candidate

    own = random.Random(5)
    for signs in ("ab1€·-_* .!é", "aé·€ ", "ab*-_.", "a. \n0", "ab c“~^/,|Ա\U0001d400٣"):
        for _ in range(20_000):
            t = "".join(own.choice(signs) for _ in range(own.randint(0, 14)))
            assert not CANDIDATE.search(t) or _may_hold_candidate(t), t
    for t in ("path€tic", "i·d·i·o·t", "id**iot", "st--upid", "cl__own", "a\n“i d i o"):
        assert CANDIDATE.search(t) and _may_hold_candidate(t), t
    assert not _may_hold_candidate("plain words, a well-known one. and no more") and not _may_hold_candidate("")


def test_decontaminate(spark):
    from prlens.llm.decontaminate import BlockMaxIndex, find_contaminated

    items = [(i, prose(20) + ". " + prose(8)) for i in range(40)] + [(90, None), (91, ""), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, prose(300) + " " + items[3][1].upper() + " " + prose(50)), (2, prose(300)), (3, None), (4, ""), (5, items[5][1] + " " + items[6][1]), (6, items[7][1].rsplit(".", 1)[0]), (None, items[8][1])]
    got = {r["doc_id"]: r for r in find_contaminated(frame(spark, rows), bench).collect()}
    assert {i: r["items"] for i, r in got.items()} == {1: [3], 2: [], 3: [], 4: [], 5: [5, 6], 6: [], None: [8]}
    assert find_contaminated(frame(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    index = BlockMaxIndex([(i, t) for i, t in items if t])
    for _ in range(60):  # every item above the threshold, as scored one by one
        q = sorted({index.term[w] for w in prose(rng.randint(3, 60)).split() if w in index.term})
        for threshold in (0.02, 0.2, 0.6):
            score = {}
            for t in q:
                for k, x in zip(index.items[t], index.impacts[t], strict=True):
                    score[k] = score.get(k, 0) + x
            assert {k for k, s in score.items() if s >= threshold} == {k for k, _ in index.search(q, threshold)}


def test_topk(spark):
    from prlens.llm.knn import voronoi_topk

    gen = np.random.default_rng(1)
    x = gen.normal(0, 0.2, (600, 8))
    x[100:180] = x[7]  # many ties
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(1000, None, 0), (1001, [float("nan")] * 8, 0), (1002, [None] * 8, 0), (1050, [0.5, 0.25], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(4)
    got = [tuple(r) for r in voronoi_topk(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    full = {i: np.floor(256 * np.pad(np.array(v), (0, 8 - len(v)))).astype(int) for i, v, _ in rows if v and all(z is not None and np.isfinite(z) for z in v)}
    want = []
    for i in sorted(full):
        if i % 50 == 0:
            best = sorted((-int(full[i] @ full[j]), j) for j in full if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == want
    assert voronoi_topk(df.limit(0), F.lit(True)).count() == 0
    assert voronoi_topk(df.where("vec_id < 3"), F.lit(True)).count() == 6


# ---- repeats and groups -----------------------------------------------------------------------------------------------


def test_suffix_order():
    from prlens.llm.suffix import repeated_windows, suffix_order

    gen = np.random.default_rng(0)
    for trial in range(60):
        n = int(gen.integers(1, 150))
        t = gen.integers(0, int(gen.integers(1, 4)) + 1, n).astype(np.uint8)
        b = bytes(t.tolist())
        assert suffix_order(t, 300, budget=128 if trial % 2 else 1 << 20).tolist() == sorted(range(n), key=lambda i: b[i:])
        starts = np.arange(max(0, n - 9))
        owners = gen.integers(0, 3, len(starts))
        windows = [b[i : i + 10] for i in starts]
        want = [any(w == v and o > p for v, p in zip(windows, owners, strict=True)) for w, o in zip(windows, owners, strict=True)]
        assert repeated_windows(t, starts, owners, 10).tolist() == want


def test_remove_repeats(spark, corpus):
    from prlens.llm.suffix_dedup import remove_repeats

    def brute(rows):
        first = {}
        for d, t in rows:
            b = (t or "").encode()
            for i in range(len(b) - 49):
                first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
        out = []
        for d, t in rows:
            b = (t or "").encode()
            gone = np.zeros(len(b), bool)
            for i in range(len(b) - 49):
                if first.get(b[i : i + 50], d) < d:
                    gone[i : i + 50] = True
            kept = np.frombuffer(b, np.uint8)[~gone].tobytes() if b else b""
            out.append((d, len(b), int(gone.sum()), int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
        return sorted(out)

    got = sorted(tuple(r) for r in remove_repeats(frame(spark, corpus)).collect())
    assert got == brute(corpus)
    assert remove_repeats(frame(spark, corpus).limit(0)).count() == 0
    null = {r["n_removed"] for r in remove_repeats(frame(spark, [(None, "y" * 80), (1, "y" * 80)])).where("doc_id IS NULL").collect()}
    assert null == {80}


def test_remove_repeats_splits_hot_anchors(spark, monkeypatch):
    """Lines that all documents hold amid different text, with shards far smaller than one anchor's contexts."""
    from prlens.llm import suffix_dedup

    gen = np.random.default_rng(11)

    def text(n):
        return bytes(gen.integers(97, 123, n, dtype=np.uint8)).decode()

    lines = [text(n) for n in (26, 40, 49, 50, 90)]
    rows = [(d, "".join(text(int(gen.integers(3, 40))) + line for line in lines) + ("" if d % 7 else lines[4] * 3)) for d in gen.permutation(400).tolist()]
    rows += [(400 + d, rows[d][1][7:]) for d in range(20)] + [(500, None), (501, ""), (502, "short")]
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    want = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        want[d] = (int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    split = []
    written = suffix_dedup.written

    def watched(df, what, *more):
        out = written(df, what, *more)
        if what == "repeats-found":
            split.append(out.where("kind = 2").select("head").collect())
        return out

    monkeypatch.setattr(suffix_dedup, "written", watched)
    for size in (3000, suffix_dedup.SHARD_BYTES):
        got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(frame(spark, rows), shard_bytes=size).collect()}
        assert got == want
    small, large = (np.concatenate([suffix_dedup._unblob(r["head"], "<i8", "<i8", "<i4", "u1")[3] for r in s]) for s in split)
    assert (small == 1).mean() > 0.5 > (large == 1).mean()
    windows = gen.integers(0, 2, (300, 5)).astype(np.uint8)
    owners = gen.integers(0, 9, 300)
    _, larger = suffix_dedup.least_owners(windows, owners)
    assert larger.tolist() == [any((w == v).all() and o > p for v, p in zip(windows, owners, strict=True)) for w, o in zip(windows, owners, strict=True)]


def test_near_duplicates(spark, corpus):
    from prlens.llm.jaccard import block_links, near_duplicate_groups, one_of_each, pair_links

    def brute(rows, k, num, den):
        sets = []
        for d, t in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
            sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
        label = list(range(len(sets)))
        for i, (_, a) in enumerate(sets):
            for j, (_, b) in enumerate(sets[:i]):
                if a and b and den * len(a & b) >= num * len(a | b) and label[i] != label[j]:
                    old, new = label[i], label[j]
                    label = [new if x == old else x for x in label]
        return sorted((d, len(s), min(e for (e, _), y in zip(sets, label, strict=True) if y == x)) for (d, s), x in zip(sets, label, strict=True))

    for k, t in ((4, (85, 100)), (5, (80, 100))):
        groups = near_duplicate_groups(frame(spark, corpus), shingle=k, threshold=t)
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in groups.collect()) == brute(corpus, k, *t)
    stay = one_of_each(frame(spark, corpus), groups).collect()
    assert len(stay) == len({c for _, n, c in brute(corpus, 5, 80, 100) if n}) + sum(n == 0 for _, n, _ in brute(corpus, 5, 80, 100))
    assert near_duplicate_groups(frame(spark, corpus).limit(0)).count() == 0
    gen = np.random.default_rng(2)
    for _ in range(40):
        sets = [np.array(s) for s in {tuple(np.unique(gen.integers(0, 30, int(gen.integers(1, 25)))).tolist()) for _ in range(15)}]
        more = gen.integers(0, 4, len(sets))  # elements that no other set has
        sizes = np.array([len(s) for s in sets]) + more
        linked = [[10 * (o := len(np.intersect1d(a, b))) >= 7 * (n + m - o) for b, m in zip(sets, sizes, strict=True)] for a, n in zip(sets, sizes, strict=True)]
        want = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if linked[i][j]:
                    want = [want[j] if x == want[i] else x for x in want]
        have = block_links(sets, sizes, 30, 7, 10).tolist()
        assert [[x == y for x in want] for y in want] == [[x == y for x in have] for y in have]
        half = len(sets) // 2
        found = pair_links(sets[:half], sizes[:half], np.arange(half), sets[half:], sizes[half:], np.arange(half, len(sets)), 30, 7, 10)
        assert all(linked[i][half + j] for i, j in found)
        want, have = list(range(len(sets))), list(range(len(sets)))
        for i in range(half):
            for j in range(half, len(sets)):
                if linked[i][j]:
                    want = [want[j] if x == want[i] else x for x in want]
        for i, j in found:
            have = [have[half + j] if x == have[i] else x for x in have]
        assert [[x == y for x in want] for y in want] == [[x == y for x in have] for y in have]


def test_large_group_of_near_copies(spark, monkeypatch):
    """2000 copies of a text, exact and near, over many blocks: the links of all pairs, counted by shared n-grams."""
    from collections import Counter, defaultdict

    from prlens.llm import jaccard

    gen = np.random.default_rng(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for d in range(2000):
        w = list(base)
        for k in gen.choice(90, int(gen.integers(0, 7)) * (d % 2), replace=False):
            w[k] = f"x{gen.integers(0, 3000)}"
        rows.append((5000 - d, " ".join(w)))
    sets = {d: {tuple(t.split()[i : i + 4]) for i in range(87)} for d, t in rows}
    rep = {}
    for d in sorted(sets):
        rep.setdefault(frozenset(sets[d]), d)
    label = {d: d for d in rep.values()}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    holders = defaultdict(list)
    for d in rep.values():
        both = Counter(o for g in sets[d] for o in holders[g])
        for o, k in both.items():
            if 100 * k >= 85 * (len(sets[d]) + len(sets[o]) - k) and root(o) != root(d):
                label[max(root(o), root(d))] = min(root(o), root(d))
        for g in sets[d]:
            holders[g].append(d)
    want = sorted((d, root(rep[frozenset(s)])) for d, s in sets.items())
    assert len({c for _, c in want}) > 100
    for blocks in (256, 16):
        monkeypatch.setattr(jaccard, "BLOCK_SETS", blocks)
        got = jaccard.near_duplicate_groups(frame(spark, rows)).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == want


def test_near_duplicates_of_odd_rows(spark):
    from prlens.llm.jaccard import near_duplicate_groups, one_of_each

    same = " ".join(f"t{i}" for i in range(30))
    rows = [(None, same), (None, same), (3, same), (3, same), (3, "other words in a text of few"), (4, None), (5, ""), (6, same + " end"), (7, "one"), (8, "ONE"), (9, "long " * 300_000)]
    got = near_duplicate_groups(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got) == [(0, 27, 3), (0, 27, 3), (3, 4, 3), (3, 27, 3), (3, 27, 3), (4, 0, 4), (5, 0, 5), (6, 28, 3), (7, 1, 7), (8, 1, 7), (9, 1, 9)]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "1 AS n", "2 AS _row", "3 AS component_id")
    stay = one_of_each(docs, near_duplicate_groups(docs))
    assert stay.columns == docs.columns and sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in stay.collect()) == [(3, 28), (3, len(same)), (4, 0), (5, 0), (7, 3), (9, 1_500_000)]


def test_components(spark):
    from prlens.llm.components import components

    edges = [(i, i + 1) for i in range(0, 40) if i % 10] + [(100, 200), (200, 300), (5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got[9] == 1 and got[20] == 11 and got[300] == 100 and 5 in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- native operators ------------------------------------------------------------------------------------------------


def test_sharding(spark, corpus):
    import zlib

    from prlens.llm.sharding import shard_documents

    def jump(key, n):
        key &= 2**64 - 1
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    rows = [*corpus, (-5, "x"), (2**62 + 12345, "é"), (None, "n"), (1, corpus[1][1])]
    got = shard_documents(frame(spark, rows), 40).collect()
    assert sorted((r["doc_id"] or 0, r["shard"], r["grown_shard"]) for r in got) == sorted((d or 0, jump(d or 0, 40), jump(d or 0, 41)) for d, _ in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert shard_documents(frame(spark, rows).limit(0), 40).count() == 0
    plan = shard_documents(frame(spark, rows), 40)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        total = sum(x if i % 2 == 0 else x * 2 - 9 * (x * 2 > 9) for i, x in enumerate(map(int, d[::-1])))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_private_base(spark):
    from prlens.llm.pii import find_private, span_digest

    parts = ["a.b@c.d", "@", "x@y", "é", " ", "\n", ".", "-", "+", "1.2.3.4", "256.1.1.1", "4785380592391139", "4785 3805 9239 1139", "4111-1111-1111-1111", "+1 (017) 555-7713", "+12", "+1234567", "(", ")", "9", "00", "a@b.c%d@e.f", "1.2.3", "word", "%"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))) for i in range(400)] + [(900, None), (901, ""), (902, "1 " * 4000), (903, "a" * 20000), (904, "4111111111111111"), (904, "4111111111111111")]
    got = {r["doc_id"]: r for r in span_digest(find_private(frame(spark, rows))).collect()}
    for d, t in rows:
        spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if _valid(k, m[0])]
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert got[d]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), (t, base)
        assert got[d]["spans"].startswith(base) and got[d]["n_card"] == sum(k == "card" for k, _, _ in spans)


def test_private_terms(spark):
    from prlens.llm.pii import find_private, sanitize, span_digest

    rows = [(i, prose(40)) for i in range(120)] + [(200 + i, f"{prose(5)} zebulon mail zeb@mail.example.com {prose(5)}") for i in range(4)]
    docs = frame(spark, rows)
    found = find_private(docs)
    got = {r["doc_id"]: r for r in span_digest(found).collect()}
    texts = dict(rows)
    for i in range(200, 204):
        terms = {texts[i][s:e] for s, e in ((x["s"], x["e"]) for r in found.where(f"doc_id = {i}").collect() for x in r["terms"])}
        assert "zebulon" in terms and got[i]["n_email"] == 1 and ",term:" in got[i]["spans"]
    assert all(got[i]["spans"] == "" for i in range(120))
    clean = {r["doc_id"]: r["text"] for r in sanitize(docs, found).collect()}
    assert "[email]" in clean[200] and "zebulon" not in clean[200] and clean[5] == texts[5] and len(clean) == len(rows)


def test_private_terms_whole_corpus(spark):
    from prlens.llm.pii import find_private

    far = prose(6000)
    rows = [(i, prose(40)) for i in range(60)] + [(100, f"Zebulon é {far} x zeb@mail.example.com y Zebulon9 {far} zebulon."), (101, f"{prose(5)} (zebulon) quixote"), (102, None)]
    got = {r["doc_id"]: r["terms"] for r in find_private(frame(spark, rows), threshold=0.8).collect()}
    texts = dict(rows)
    for d, n in ((100, 2), (101, 1)):  # an entity of one document; far from it, and in a document without it
        assert [(x["s"], x["e"]) for x in got[d]] == [m.span() for m in re.finditer(r"\bzebulon\b", texts[d].lower())] and len(got[d]) == n
    assert not any(got[i] for i in range(60)) and not got[102]


def test_mixing(spark):
    from prlens.llm import mixing

    rows = [(i, prose(50 + 10 * (i % 7)), ["en", "de", None][i % 3], f"s{0 if i % 2 else i % 5}", 0) for i in range(600)] + [(900, None, "en", None, 0), (None, "", "de", "s9", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_documents(mixing.with_topic(docs))
    got = out.toPandas()
    assert len(got) == len(rows) and got.probability.between(0, 1).all() and 0 < got.selected.mean() < 1
    total = got.n_tokens.sum()
    for m in ("source", "lang", "_topic"):
        g = got.assign(k=got[m].fillna("-"), w=got.n_tokens * got.weight).groupby("k").agg(n=("n_tokens", "sum"), w=("w", "sum"))
        g = g[g.n > 0]
        assert np.allclose(g.w / total, g.n**0.5 / (g.n**0.5).sum(), atol=1e-6)
    assert sorted(map(str, out.where("selected").select("doc_id").toPandas().doc_id)) == sorted(map(str, mixing.mix_documents(mixing.with_topic(docs.repartition(5))).where("selected").toPandas().doc_id))
    assert mixing.mix_documents(mixing.with_topic(docs.limit(0))).count() == 0
    clash = mixing.mix_documents(mixing.with_topic(docs.withColumn("weight", F.lit(1))), prefix="_m_")
    assert "weight" in clash.columns and "_m_weight" in clash.columns


def test_mixing_sample_meets_margins(spark):
    from prlens.llm import mixing

    rows = [(i, prose(80), "en" if i % 3 else "de", "s0", 0) for i in range(600)] + [(1000 + i, prose(30), "es" if i % 2 else "en", "s1", 0) for i in range(6)]
    got = mixing.mix_documents(mixing.with_topic(spark.createDataFrame(rows, DOCS))).toPandas()
    assert got.weight.max() * 0.5 > 1 and got.probability.between(0, 1).all()
    for m in ("source", "lang", "_topic"):
        g = got.assign(p=got.n_tokens * got.probability).groupby(m).agg(n=("n_tokens", "sum"), p=("p", "sum"))
        assert np.allclose(g.p / g.p.sum(), g.n**0.5 / (g.n**0.5).sum(), atol=1e-4)


# ---- the pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = [(i, prose(60)) for i in range(200)]
    bad = [(500 + i, " ".join(w + "%%%" for w in prose(60).split())) for i in range(60)]
    items = [(i, prose(20) + ". " + prose(8)) for i in range(5)]
    near = [(700, good[0][1] + " end"), (701, good[1][1]), (702, prose(30) + " " + items[2][1])]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    frame(spark, [*good, *bad, *near]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not seen[0] & {i for i, _ in bad} and seen[0] >= {i for i, _ in good}
    assert seen[1] == seen[0] - {700, 701} and seen[2] == seen[1] - {702} and seen[3] <= seen[2] and seen[4] == seen[3]
    clash = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumns({c: F.lit(1) for c in ("score", "predicted", "label", "contaminated", "items", "weight", "selected")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        clash = stage(spark, clash, str(tmp_path))
        assert clash.columns[5:] == ["score", "predicted", "label", "contaminated", "items", "weight", "selected"] and clash.agg(F.min("score"), F.max("weight")).first() == (1, 1)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])
