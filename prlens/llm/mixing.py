"""Mixing sources to target weights by iterative proportional fitting, in built-in expressions only.

Documents are counted into cells of (source, language, topic) once; only that table is raked: each margin in turn
scales the cells' probabilities so that their expected tokens meet the target, until all margins hold. Probabilities are
raked under their bound of 1: a cell at the bound stays there and the rest make up for it. The rate is lowered only if a
value of a margin has fewer tokens than its target. A hash of a document's id decides by its cell's probability, so a
rerun or a retried task samples alike.

Defined results: null source, language or topic is a category of its own; a null or empty text has no tokens,
and a cell without tokens keeps weight 1; a null id is hashed like any value; repeated rows share their fate; an
empty table gives an empty table; other columns pass through, and the columns added can be given a prefix where
they would clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prlens.llm._arrow import discard, written

#: Cells that may be broadcast to the documents; more are joined by a shuffle.
BROADCAST_CELLS = 100_000
#: Cells that are raked as arrays in one row.
ARRAY_CELLS = 50_000


def n_tokens(text: str = "text") -> Column:
    """Words of a text as its blanks and line ends plus one; none for an empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.when(t == "", F.lit(0)).otherwise(F.octet_length(t) - F.octet_length(bare) + 1).cast("long")


def with_topic(docs: DataFrame, text: str = "text", name: str = "_topic") -> DataFrame:
    """Adds the text's form as its topic: tables, marked-up words, shouting, notes (under 60 words), essays (2,000 and more), prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    work = docs.withColumn("_words", n_tokens(text))  # counted once, used by each test below

    def share(*marks: str) -> Column:
        """Whether a mark of one length stands at more than a tenth of the words."""
        bare = t
        for m in marks:
            bare = F.replace(bare, F.lit(m), F.lit(""))
        return F.octet_length(t) - F.octet_length(bare) > 0.1 * len(marks[0]) * F.col("_words")

    topic = (
        F.when(F.col("_words") == 0, "empty").when(share(" | "), "table").when(share("$$$", "###", "&&&", "%%%", "***"), "marked")
        .when(share("!!"), "shouting").when(F.col("_words") < 60, "note").when(F.col("_words") >= 2000, "essay").otherwise("prose")
    )
    return work.withColumn(name, topic).drop("_words")


def rake(cells: DataFrame, margins: tuple[str, str, str], smooth: float = 0.5, targets: dict[str, DataFrame] | None = None, rate: float = 0.5, rounds: int = 60, most: int = 6, close: float = 1e-6) -> DataFrame:
    """``margins``, ``weight`` and ``probability`` for a table of ``margins`` and ``tokens``.

    A margin's target shares are ``targets[margin]`` (columns margin, ``share``), or its token shares to the power
    ``smooth``, normalised. ``rate`` of all tokens is wanted, or as much as every value of a margin has tokens for. A
    cell's probability is a product of one factor a margin, at most 1. Each step scales a margin's factors by what its
    expected tokens miss, with cells at their bound counted as such; ``rounds`` rounds are repeated until no margin misses
    its target by more than ``close``, ``most`` times at most: a target that bounds make impossible stays missed, which
    :func:`mix_report` shows. Up to ``ARRAY_CELLS`` cells the factors are arrays in one row and the rounds one fold; more
    cells are raked by aggregations, a table a round.
    """
    cells = cells.select(*margins, F.coalesce("tokens", F.lit(0)).cast("double").alias("tokens"))
    live = cells.where("tokens > 0")
    n, total = live.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if not n:
        return cells.select(*margins, F.lit(1.0).alias("weight"), F.lit(float(rate)).alias("probability"))
    shares, able = {}, [rate]
    for m in margins:
        sums = live.groupBy(m).agg(F.sum("tokens").alias("_has"))
        if targets and m in targets:
            known = targets[m].select(m, "share")
        else:
            raised = sums.select(m, F.pow("_has", F.lit(smooth)).alias("_p"))
            known = raised.join(F.broadcast(raised.agg(F.sum("_p").alias("_all"))), F.lit(True)).select(m, (F.col("_p") / F.col("_all")).alias("share"))
        shares[m] = written(known, f"target-{m}")
        able.append(sums.join(shares[m], m).where("share > 0").agg(F.min(F.col("_has") / (F.col("share") * total))).first()[0] or rate)
    rate = min(able)
    weights = (_rake_arrays if n <= ARRAY_CELLS else _rake_tables)(live, margins, shares, rate * total, rounds, most, close)
    mean = F.lit(float(rate))
    return cells.join(weights, list(margins), "left").select(*margins, F.coalesce(F.col("probability") / mean, F.lit(1.0)).alias("weight"), F.coalesce("probability", mean).alias("probability"))


def _rake_arrays(live: DataFrame, margins: tuple[str, str, str], shares: dict[str, DataFrame], wanted: float, rounds: int, most: int, close: float) -> DataFrame:
    """The fold: step 3r + m scales margin m's factors by target / expected tokens under all three margins' factors."""
    numbered = live
    row = None
    for x, m in zip("ijk", margins, strict=True):
        places = live.groupBy().agg(F.array_sort(F.collect_set(m)).alias("_a")).select(F.posexplode("_a").alias(x, m))
        numbered = numbered.join(F.broadcast(places), m)
    numbered = written(numbered, "cells-numbered")
    for x, m in zip("ijk", margins, strict=True):
        y, z = [v for v in "ijk" if v != x]
        lists = numbered.groupBy(x, m).agg(F.collect_list(F.struct(F.col(y).alias("y"), F.col(z).alias("z"), "tokens")).alias("c"))
        lists = lists.join(shares[m], m, "left").select(x, "c", (F.coalesce("share", F.lit(0.0)) * wanted).alias("want"))
        lists = lists.groupBy().agg(F.array_sort(F.collect_list(F.struct(x, "c", "want"))).alias(f"by_{x}"))
        row = lists if row is None else row.join(lists, F.lit(True))
    row = written(row, "cells-row")
    least, largest = F.lit(1e-300), F.lit(1e12)

    def expected(r: Column, own: Column, fy: Column, fz: Column) -> Column:
        return F.aggregate(r["c"], F.lit(0.0), lambda a, e: a + e["tokens"] * F.least(F.lit(1.0), own * F.get(fy, e["y"]) * F.get(fz, e["z"])))

    def fitted(x: str, fx: Column, fy: Column, fz: Column) -> Column:
        return F.zip_with(f"by_{x}", fx, lambda r, f: F.least(largest, F.greatest(least, f * F.coalesce(F.try_divide(r["want"], expected(r, f, fy, fz)), F.lit(0.0)))))

    def missed(x: str, fx: Column, fy: Column, fz: Column) -> Column:
        return F.array_max(F.zip_with(f"by_{x}", fx, lambda r, f: F.coalesce(F.abs(F.try_divide(expected(r, f, fy, fz), r["want"]) - 1), F.lit(0.0))))

    def step(s: Column, m: Column) -> Column:
        a = F.struct(fitted("i", s["i"], s["j"], s["k"]).alias("i"), s["j"].alias("j"), s["k"].alias("k"))
        b = F.struct(s["i"].alias("i"), fitted("j", s["j"], s["i"], s["k"]).alias("j"), s["k"].alias("k"))
        c = F.struct(s["i"].alias("i"), s["j"].alias("j"), fitted("k", s["k"], s["i"], s["j"]).alias("k"))
        return F.when(m % 3 == 0, a).when(m % 3 == 1, b).otherwise(c)

    ones = lambda x: F.transform(f"by_{x}", lambda _: F.lit(1.0)).alias(x)
    factors = row.withColumn("f", F.struct(*[ones(x) for x in "ijk"]))
    for k in range(most):
        factors = written(factors.select(*[f"by_{x}" for x in "ijk"], F.aggregate(F.sequence(F.lit(0), F.lit(3 * rounds - 1)), F.col("f"), step).alias("f")), f"factors-{k}")
        if factors.select(F.greatest(*[missed(x, F.col(f"f.{x}"), F.col(f"f.{y}"), F.col(f"f.{z}")) for x, y, z in ("ijk", "jik", "kij")])).first()[0] <= close:
            break
    for x in "ijk":
        numbered = numbered.join(F.broadcast(factors.select(F.posexplode(f"f.{x}").alias(x, f"f_{x}"))), x)
    return numbered.select(*margins, F.least(F.lit(1.0), F.col("f_i") * F.col("f_j") * F.col("f_k")).alias("probability"))


def _rake_tables(live: DataFrame, margins: tuple[str, str, str], shares: dict[str, DataFrame], wanted: float, rounds: int, most: int, close: float) -> DataFrame:
    """The same steps over tables; each round is written to the shared folder, which cuts the plan, and the round before goes."""
    now, before = live.withColumn("_f", F.lit(1.0)), None
    for k in range(rounds * most):
        missed = []
        for m in margins:
            sums = now.groupBy(m).agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("_f"))).alias("_sum"))
            scale = sums.join(shares[m], m, "left").select(m, F.coalesce(F.try_divide(F.col("share") * wanted, F.col("_sum")), F.lit(0.0)).alias(f"_s_{m}"))
            now = now.join(scale, m).withColumn("_f", F.least(F.lit(1e12), F.greatest(F.lit(1e-300), F.col("_f") * F.col(f"_s_{m}"))))
            missed.append(f"_s_{m}")
        table = written(now, f"rake-{k}")
        worst = table.agg(F.max(F.greatest(*[F.abs(F.lit(1.0) - F.col(c)) for c in missed]))).first()[0]
        now = table.drop(*missed)
        if before is not None:
            discard(before)
        before = table
        if worst <= close:
            break
    return now.select(*margins, F.least(F.lit(1.0), F.col("_f")).alias("probability"))


def mix_report(mixed: DataFrame, margins: dict[str, str], smooth: float = 0.5, prefix: str = "") -> DataFrame:
    """For each value of the margins (name: column) of a mixed table the shares of tokens: had, targeted, expected and drawn."""
    out = None
    for name, column in margins.items():
        t = F.col(prefix + "n_tokens")
        sums = mixed.groupBy(F.col(column).cast("string").alias("value")).agg(F.sum(t).alias("a"), F.sum(t * F.col(prefix + "probability")).alias("b"), F.sum(F.when(F.col(prefix + "selected"), t).otherwise(0)).alias("c")).withColumn("p", F.pow("a", F.lit(smooth)))
        all_ = sums.agg(*[F.sum(x).alias(f"_{x}") for x in "abcp"])
        part = sums.join(F.broadcast(all_), F.lit(True)).select(F.lit(name).alias("margin"), "value", *[F.try_divide(F.col(x), F.col(f"_{x}")).alias(n) for x, n in (("a", "share"), ("p", "target_share"), ("b", "expected_share"), ("c", "sample_share"))])
        out = part if out is None else out.unionByName(part)
    return out


def mix_documents(docs: DataFrame, source: str = "source", lang: str = "lang", topic: str = "_topic", key: str = "doc_id", text: str = "text", rate: float = 0.5, smooth: float = 0.5, prefix: str = "", seed: int = 11) -> DataFrame:
    """``docs`` with its tokens, the raked weight of its cell, its inclusion probability and whether it is selected.

    ``rate``: expected share of the tokens in the sample, or less where a value of a margin has not enough tokens for it.
    """
    named = docs.withColumns({f"_c{k}": F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for k, c in enumerate((source, lang, topic))}).withColumn(prefix + "n_tokens", n_tokens(text))
    margins = ("_c0", "_c1", "_c2")
    cells = written(named.groupBy(*margins).agg(F.sum(prefix + "n_tokens").alias("tokens")), "cells")
    weights = written(rake(cells, margins, smooth, rate=rate), "weights")
    if weights.count() <= BROADCAST_CELLS:
        weights = F.broadcast(weights)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) * (2.0**-53)
    out = named.join(weights.select(*margins, F.col("weight").alias("_weight"), F.col("probability").alias("_p")), list(margins), "left")
    return out.withColumns({prefix + "weight": F.col("_weight"), prefix + "probability": F.col("_p"), prefix + "selected": chance < F.col("_p")}).drop(*margins, "_weight", "_p")
