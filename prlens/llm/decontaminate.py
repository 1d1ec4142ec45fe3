"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Every document is cut into passages that overlap by half, long enough to hold any item. A passage's words are the
query, the items are the indexed documents, and an item's score is taken as a share of the score that the item
itself gets; all items above the threshold are retrieved. A retrieved item is verified on the words around the
passage: runs of words of its question and of its answer must be there.

Defined results: null and empty texts, and texts without words, are clean; items without words are never found;
items with equal words are all reported; a null id is carried; repeated rows get equal results; empty tables of
documents or items give an empty table and clean documents.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prlens.llm._arrow import small_batches, written

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Bytes of item text in one index; more items make more indexes, each broadcast on its own and searched in turn.
INDEX_BYTES = 32 << 20
#: Postings of a block, whose largest impact is stored.
BLOCK = 64
K1, B = 1.2, 0.75
#: Items of a block whose bounds decide whether a passage is searched at all.
NEAR = 4


def words_of(text: str | None) -> list[str]:
    """Lower-cased words."""
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words as a question and an answer: its last sentence, or the last third of its only one."""
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    if not parts:
        return [], []
    if len(parts) == 1:
        cut = len(parts[0]) - max(1, len(parts[0]) // 3)
        return parts[0][:cut] or parts[0], parts[0][cut:]
    return [w for p in parts[:-1] for w in p], parts[-1]


def _runs(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = max(1, min(n, len(words)))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


class BlockMaxIndex:
    """Items by word: for each word the items that hold it, with impacts as shares of the item's own score, in blocks."""

    def __init__(self, items: list[tuple[int, str]], run: int = 5, statistics: tuple[int, float, dict[str, int]] | None = None, longest: int | None = None):
        kept = [(i, t, words_of(t)) for i, t in items]
        kept = sorted((x for x in kept if x[2]), key=lambda x: (x[0] is None, x[0], x[1]))
        self.ids = [i for i, _, _ in kept]
        self.lengths = [len(w) for _, _, w in kept]
        self.longest = longest or max(self.lengths, default=1)
        qa = [question_and_answer(t) for _, t, _ in kept]
        self.question = [(len(q), _runs(q, run)) for q, _ in qa]
        self.answer = [(len(a), _runs(a, run)) for _, a in qa]
        self.whole = [_runs(w, run) for _, _, w in kept]
        self.run = run
        n, mean, held = statistics or (len(kept), sum(self.lengths) / max(1, len(kept)), Counter(w for _, _, ws in kept for w in set(ws)))
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in held.items()}
        lists: dict[str, list[tuple[int, float]]] = {}
        for k, (_, _, ws) in enumerate(kept):
            norm = K1 * (1 - B + B * len(ws) / mean)
            impact = {w: idf[w] * c * (K1 + 1) / (c + norm) for w, c in Counter(ws).items()}
            own = sum(impact.values())
            for w, x in impact.items():
                lists.setdefault(w, []).append((k, x / own))
        self.term = {w: t for t, w in enumerate(lists)}
        self.items = [[k for k, _ in p] for p in lists.values()]
        self.impacts = [[x for _, x in p] for p in lists.values()]
        self.block_max = [[max(p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)] for p in self.impacts]
        self.most = np.array([max(p) for p in self.impacts] or [0.0])
        self.best = self.most.tolist()
        # block bounds of all words in one array: for each word the blocks of items it occurs in, with its largest impact
        bounds: list[dict[int, float]] = []
        for ks, xs in zip(self.items, self.impacts, strict=True):
            top: dict[int, float] = {}
            for k, x in zip(ks, xs, strict=True):
                top[k // NEAR] = max(x, top.get(k // NEAR, 0.0))
            bounds.append(top)
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in bounds])]).astype(np.int64)
        self.flat_blocks = np.array([k for t in bounds for k in t], np.int64)
        self.flat_bounds = np.array([x for t in bounds for x in t.values()])

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for the query reaches the threshold, by block-max WAND."""
        n = len(self.ids)
        cursors = [[self.items[t][0], 0, t] for t in terms]  # item, place, term
        found: list[tuple[int, float]] = []
        while True:
            cursors = [c for c in cursors if c[0] < n]
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.best[c[2]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # the blocks that would hold the pivot item
            blocks, bound = [], 0.0
            for c in cursors[: pivot + 1]:
                at = bisect_left(self.items[c[2]], item, c[1])
                blocks.append(at)
                if at < len(self.items[c[2]]):
                    bound += self.block_max[c[2]][at // BLOCK]
            if bound < threshold:
                # no item up to the end of the first of these blocks can reach it
                ends = [self.items[c[2]][min(len(self.items[c[2]]), (at // BLOCK + 1) * BLOCK) - 1] + 1 for c, at in zip(cursors, blocks, strict=False) if at < len(self.items[c[2]])]
                to = min(ends, default=n)
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                to = max(to, item + 1)
                for c in cursors[: pivot + 1]:
                    self._move(c, to, n)
            elif cursors[0][0] == item:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                for c in cursors[: pivot + 1]:
                    self._move(c, item + 1, n)
            else:
                for c in cursors[: pivot + 1]:
                    if c[0] < item:
                        self._move(c, item, n)

    def _move(self, cursor: list[int], to: int, n: int) -> None:
        items = self.items[cursor[2]]
        cursor[1] = bisect_left(items, to, cursor[1])
        cursor[0] = items[cursor[1]] if cursor[1] < len(items) else n

    def verified(self, item: int, around: set[tuple[str, ...]], shorter: dict[int, set], words: list[str], overlap: float) -> bool:
        """Whether enough runs of the item's question and of its answer are among the words around a passage."""

        def share(part: tuple[int, set]) -> float:
            length, runs = part
            n = min(self.run, length)
            if n < self.run and n not in shorter:
                shorter[n] = _runs(words, n)
            have = around if n == self.run else shorter[n]
            return sum(r in have for r in runs) / max(1, len(runs))

        return share(self.question[item]) >= overlap and share(self.answer[item]) >= overlap

    def find(self, words: list[str], threshold: float, overlap: float) -> dict[int, float]:
        """Verified items of a document and their best scores."""
        terms = np.array([self.term.get(w, -1) for w in words], np.int64)
        step = self.longest
        known = np.flatnonzero(terms >= 0)
        if not len(known):
            return {}
        # a passage (two half passages) is searched if, in some block of items, its words' largest impacts reach the threshold
        pair = np.unique(known // step * len(self.most) + terms[known])
        term, half = pair % len(self.most), pair // len(self.most)
        n = self.first[term + 1] - self.first[term]
        place = np.repeat(self.first[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        blocks = -(-len(self.ids) // NEAR)
        key = np.repeat(half, n) * blocks + self.flat_blocks[place]
        key = np.concatenate([key + blocks, key])  # passages by their second half, from 0: the half is a first half, and a second one
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        bound = np.add.reduceat(np.tile(self.flat_bounds[place], 2)[order], starts)
        good = key[order][starts[bound >= threshold - 1e-9]] // blocks - 1
        out: dict[int, float] = {}
        for h in np.unique(np.maximum(good, 0)):
            start = int(h) * step
            query = sorted({int(t) for t in terms[start : start + 2 * step] if t >= 0})
            hits = self.search(query, threshold)
            if hits:
                near = words[max(0, start - step) : start + 3 * step]
                around, shorter = _runs(near, self.run) if len(near) >= self.run else set(), {}
                for item, score in hits:
                    if out.get(item, 0) < score and (item in out or self.verified(item, around, shorter, near, overlap)):
                        out[item] = score
        return out


def _statistics(items: DataFrame) -> tuple[int, float]:
    """Items with words, and their mean length, over the whole benchmark."""
    n, mean = items.where("length > 0").agg(F.count(F.lit(1)), F.avg("length")).first()
    return n, float(mean or 1)


def _indexed(items: DataFrame, held: DataFrame, part: Column, of: tuple[int, float, int]) -> BlockMaxIndex:
    """The index of one part of the items, at most about ``INDEX_BYTES``; words weigh as in the whole benchmark."""
    rows = items.where(part).select("id", "t").collect()
    words = items.where(part).select(F.explode(F.array_distinct("words")).alias("w")).distinct().join(held, "w").collect()
    return BlockMaxIndex([tuple(r) for r in rows], statistics=(of[0], of[1], {r["w"]: r["n"] for r in words}), longest=of[2])


def find_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = 0.6, overlap: float = 0.6, keep: tuple[str, ...] | None = None, prefix: str = "") -> DataFrame:
    """``key`` (or the columns in ``keep``), ``contaminated``, ``n_items``, ``items`` (ids, ascending) and ``best_score`` for every row. No shuffle.

    ``prefix`` goes before the names of the columns that are added, where they would clash. The items' bytes are measured
    first; each index holds at most about ``INDEX_BYTES`` of them (or one longer item) and is broadcast on its own. Passages
    and weights are those of the whole benchmark in every index, so results do not depend on the number of indexes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = tuple(keep) if keep is not None else (key,)
    wanted = benchmark.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([words_of(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    items = written(wanted.withColumn("words", split("t")).withColumn("length", F.size("words")), "benchmark-words")
    held = written(items.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")), "benchmark-held")
    size, longest = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.coalesce(F.max("length"), F.lit(1))).first()
    n, mean = _statistics(items)
    blocks = max(1, math.ceil(size / INDEX_BYTES))

    def found_by(b: int) -> Column:
        index = spark.sparkContext.broadcast(_indexed(items, held, F.pmod(F.xxhash64("id"), F.lit(blocks)) == b, (n, mean, longest)))

        @F.arrow_udf("array<struct<item: bigint, score: double>>")
        def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            ix = index.value
            kind = pa.list_(pa.struct([("item", pa.int64()), ("score", pa.float64())]))
            for texts in batches:
                hits = [ix.find(words_of(t), threshold, overlap) if t else {} for t in texts.to_pylist()]
                yield pa.array([[{"item": ix.ids[k], "score": s} for k, s in h.items()] for h in hits], kind)

        return find(docs[text])

    names = [f"_k{i}" for i in range(len(keep))]
    out = docs.select(*[docs[c].alias(n) for n, c in zip(names, keep, strict=True)], F.concat(*[found_by(b) for b in range(blocks)]).alias("_hits"))
    ids = F.array_sort(F.array_distinct(F.col("_hits.item")))
    found = {"contaminated": F.size("_hits") > 0, "n_items": F.size(ids).cast("long"), "items": ids, "best_score": F.coalesce(F.array_max(F.col("_hits.score")), F.lit(0.0))}
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *[c.alias(prefix + n) for n, c in found.items()])
