"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded; gated attention, learned from
the documents' labels alone, weighs the passages; the weighted representation is scored.

Defined results: a null or empty text is one empty passage and is scored like any other; all passages of a very long
text count; a null id is held out and scored; repeated rows get equal scores; without labelled rows of both kinds the
score is the share of label 1 (0.5 without any); an empty table gives an empty table; columns that are kept give way to
added ones of their names, unless these get a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prlens.llm._arrow import packs, small_batches
from prlens.llm.training import held_out, labelled_sample

#: Bytes of a passage; the whole text is covered, the last passage may be shorter.
PASSAGE = 384
PACK = 256 * 1024


def _byte_classes() -> np.ndarray:
    """A class for each byte: letters one by one, each ASCII mark, digits, capitals, white space, and four ranges beyond ASCII."""
    table = np.zeros(256, np.int64)
    seen: dict[str, int] = {}
    for b in range(256):
        c = chr(b)
        kind = c if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if c.isdigit() and b < 128 else "high" + str(b >> 4) if b >= 128 else "line" if b in (10, 13) else "space" if b in (9, 32) else "control" if b < 32 or b == 127 else c
        table[b] = seen.setdefault(kind, len(seen))
    return table


_CLASS = _byte_classes()
_CLASSES = int(_CLASS.max()) + 1
_MARKS = np.array([not chr(b).isalnum() and b < 128 and b > 32 and b != 127 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_EXTRA = 7
DIM = _CLASSES + _EXTRA
_ODD = np.uint64(0x9E3779B97F4A7C15)


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a pack of texts, and the first passage of each text (with the total at the end)."""
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-lengths // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)])
    total = int(first[-1])
    size = len(data)
    x = np.zeros((total, DIM), np.float32)
    if size:
        doc = np.repeat(np.arange(len(lengths)), lengths)
        passage = first[doc] + (np.arange(size) - offsets[doc]) // PASSAGE
        hist = np.bincount(passage * _CLASSES + _CLASS[data], minlength=total * _CLASSES).reshape(total, _CLASSES)
        n = np.maximum(1, hist.sum(1))
        x[:, :_CLASSES] = np.sqrt(hist / n[:, None])
        # words: runs of bytes other than white space; their hash is a sum of positioned bytes
        gap = (data <= 32)
        edge = gap.copy()
        edge[offsets[:-1][lengths > 0]] = True
        start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]) | (~gap & edge))
        if len(start):
            word = np.cumsum(np.bincount(start, minlength=size)) - 1
            inside = np.flatnonzero(~gap)
            w = word[inside]
            value = (data[inside].astype(np.uint64) + np.uint64(1)) * (((inside - start[w]).astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _ODD)
            value ^= value >> np.uint64(29)
            ends = np.searchsorted(w, np.arange(len(start)))
            hashes = np.add.reduceat(value, ends)
            wp = passage[start]
            words = np.bincount(wp, minlength=total)
            chars = np.bincount(passage[inside], minlength=total)
            marks = np.bincount(wp, weights=_MARKS[data[start]], minlength=total)
            last = np.concatenate([inside[ends[1:] - 1], inside[-1:]])
            ending = np.bincount(wp, weights=_MARKS[data[last]], minlength=total)
            upper = np.bincount(wp, weights=_UPPER[data[start]] & _UPPER[data[np.minimum(start + 1, size - 1)]], minlength=total)
            same = np.zeros(len(start))
            same[1:] = (hashes[1:] == hashes[:-1]) & (wp[1:] == wp[:-1])
            order = np.lexsort((hashes, wp))
            fresh = np.ones(len(start), bool)
            fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (wp[order][1:] != wp[order][:-1])
            distinct = np.bincount(wp[order], weights=fresh, minlength=total)
            n_words = np.maximum(1, words)
            x[:, _CLASSES] = distinct / n_words
            x[:, _CLASSES + 1] = np.bincount(wp, weights=same, minlength=total) / n_words
            x[:, _CLASSES + 2] = np.minimum(chars / n_words, 40) / 10
            x[:, _CLASSES + 3] = marks / n_words
            x[:, _CLASSES + 4] = ending / n_words
            x[:, _CLASSES + 5] = upper / n_words
            x[:, _CLASSES + 6] = np.log1p(words)
    return x, first


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _softmax_bags(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    starts = first[:-1]
    n = np.diff(first)
    top = np.repeat(np.maximum.reduceat(a, starts), n)
    e = np.exp(a - top)
    return e / np.repeat(np.add.reduceat(e, starts), n)


@dataclass
class QualityModel:
    """Gated attention over passages: h = tanh(xW), a = softmax(w . tanh(hV) * sigmoid(hU)), score = sigmoid(c . sum(a h))."""

    weights: dict[str, np.ndarray]
    base: float | None = None

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 4000, passages: int = 64, epochs: int = 160, hidden: int = 24, gate: int = 8, seed: int = 7) -> QualityModel:
        """Learn from at most ``rows`` labelled documents; of longer texts ``passages`` passages count, spread evenly over the whole text."""
        small_batches(docs.sparkSession)
        sample = labelled_sample(docs, labels, label, rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, data, offsets in packs(b, "text", PACK):
                    x, first = encode(data, offsets)
                    x = x.astype(np.float16)
                    rows_ = b.slice(part.start, part.stop - part.start)
                    counts = np.diff(first)
                    blobs = [x[first[i] + (np.arange(min(n, passages)) * n // min(n, passages))].tobytes() for i, n in enumerate(counts.tolist())]
                    yield pa.RecordBatch.from_arrays([rows_.column("doc_id"), rows_.column("label"), pa.array(blobs, pa.binary())], names=["doc_id", "label", "x"])

        got = sample.mapInArrow(run, "doc_id bigint, label double, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows).collect()
        y = np.array([r["label"] for r in got])
        if len(set(y)) < 2:
            return cls({}, float(y.mean()) if len(y) else 0.5)
        bags = [np.frombuffer(r["x"], np.float16).reshape(-1, DIM) for r in got]
        first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
        x = np.concatenate(bags).astype(np.float32)
        mean, std = x.mean(0), x.std(0) + 0.02
        return cls({"mean": mean, "std": std} | _train((x - mean) / std, first, y, epochs, hidden, gate, seed))

    def scores(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the bags, and the attention weight of each passage."""
        if self.base is not None:
            return np.full(len(first) - 1, self.base), np.ones(len(x))
        w = self.weights
        h = np.tanh(((x - w["mean"]) / w["std"]) @ w["W"] + w["b"])
        att = _softmax_bags((np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["w"], first)
        z = np.add.reduceat(h * att[:, None], first[:-1], axis=0)
        return _sigmoid(z @ w["c"] + w["d"]), att

    def score(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3, prefix: str = "") -> DataFrame:
        """``keep``, ``held_out``, ``score`` and ``predicted`` for every row. No shuffle.

        Kept columns of the names that are added give way, or the added ones get a ``prefix``.
        """
        added = [prefix + c for c in ("held_out", "score", "predicted")]
        keep = [c for c in keep if c not in added]
        out = docs.select(*[docs[c] for c in keep], held_out().alias(added[0]), self.score_of(docs, docs["text"]).alias(added[1]))
        return out.withColumn(added[2], (F.col(added[1]) >= threshold).cast("int"))

    def score_of(self, docs: DataFrame, text: Column) -> Column:
        """The score of a text column of ``docs``; only the text goes to Python, in batches of bounded bytes, and only the score comes back."""
        small_batches(docs.sparkSession)
        model = docs.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            m = model.value
            for texts in batches:
                batch = pa.RecordBatch.from_arrays([texts], names=["t"])
                found = [m.scores(*encode(data, offsets))[0] for _, data, offsets in packs(batch, "t", PACK)]
                yield pa.array(np.concatenate(found).astype(np.float64) if found else np.empty(0))

        return score(text)


def _train(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int, hidden: int, gate: int, seed: int) -> dict[str, np.ndarray]:
    """Adam on the log loss of whole batches, with weight decay; classes count alike up to a factor."""
    rng = np.random.default_rng(seed)
    p = {
        "W": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "b": np.zeros(hidden),
        "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "w": rng.normal(0, gate**-0.5, gate),
        "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    n_in = np.diff(first)
    starts = first[:-1]
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for t in range(1, epochs + 1):
        h = np.tanh(x @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        att = _softmax_bags((tv * su) @ p["w"], first)
        z = np.add.reduceat(h * att[:, None], starts, axis=0)
        out = _sigmoid(z @ p["c"] + p["d"])
        err = ((out - y) / len(y)).astype(np.float32)
        g = {"c": z.T @ err, "d": np.array([err.sum()])}
        dz = np.repeat(err[:, None] * p["c"], n_in, axis=0)
        dh = dz * att[:, None]
        da = (dz * h).sum(1)
        ds = att * (da - np.repeat(np.add.reduceat(att * da, starts), n_in))
        g["w"] = (tv * su).T @ ds
        dtv = ds[:, None] * p["w"] * su * (1 - tv**2)
        dsu = ds[:, None] * p["w"] * tv * su * (1 - su)
        g["V"], g["U"] = h.T @ dtv, h.T @ dsu
        dh += dtv @ p["V"].T + dsu @ p["U"].T
        dpre = dh * (1 - h**2)
        g["W"], g["b"] = x.T @ dpre, dpre.sum(0)
        rate = 0.02 * min(1, t / 10) * (1 - 0.8 * t / epochs)
        for k in p:
            grad = g[k] + 1e-4 * p[k]
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.99 * m2[k] + 0.01 * grad**2
            p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return p
