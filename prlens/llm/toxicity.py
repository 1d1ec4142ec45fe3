"""Toxicity by noisy-channel deobfuscation.

Words that look obfuscated (letters mixed with look-alike marks, single letters spaced out, letters repeated)
are candidates. Each becomes a lattice of characters: what every sign may stand for, what may be dropped. A
Viterbi search under a character trigram model, counted over all texts of the corpus, picks the likeliest plain
word. The restored text is scored by a logistic model over word beginnings learned from labelled rows.

Defined results: null and empty texts are scored like texts without any known word beginning; very long texts and very
long candidates are read as a whole; kept columns give way to added ones of their names; a null id is held out and scored; repeated rows get equal scores; without labelled rows of both kinds the score is the share of
label 1 (0.5 without any); an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prlens.llm._arrow import small_batches
from prlens.llm.training import held_out, labelled_sample

#: The letters that a look-alike sign may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "€": "e", "£": "l", "¥": "y", "§": "s", "¡": "i",
}
#: Cyrillic and Greek letters drawn like Latin ones.
HOMOGLYPHS = str.maketrans("асеорхуіјѕԁһԛԝкмтнвαοερινυκτ", "aceopxyijsdhqwkmthvaoepinukt")
#: Log probabilities of the channel, natural logarithm: a sign for a letter, a sign or a spacer put in, a letter doubled, a letter drawn out.
SUBSTITUTED, PUT_IN_SIGN, PUT_IN_SPACER, DOUBLED, DRAWN_OUT = -1.0, -4.0, -0.3, -3.0, -0.5
#: What a restored letter gains, so that longer readings are not held less likely for their length.
PER_LETTER = 2.3
_SIGNS = re.escape("".join(LOOK_ALIKES))
_SPACERS = r"[ .\-_*·,/~^]"
#: A word that holds letters and, between or before them, look-alikes or spacers; or letters one by one; or a letter three times in a row.
CANDIDATE = re.compile(
    rf"(?<![^\W_])(?:(?:[^\W\d_]|[{_SIGNS}]){_SPACERS}{{1,2}}){{3,}}(?:[^\W\d_]|[{_SIGNS}])(?![^\W_])"
    rf"|[^\W\d_]*+(?:[{_SIGNS}]{{1,6}}[^\W\d_]+)+[0-9@$€]{{0,2}}(?![^\W_])"
    rf"|[^\W\d_]+[*._\-][^\W\d_]*+(?:[*._\-][^\W\d_]+)+|[^\W\d_]+[*_][^\W\d_]+"
    rf"|(?<![^\W_])(?=([^\W\d_]))[^\W\d_]*?([^\W\d_])\2\2[^\W\d_]*"
)
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_N = 27
_INDEX = {c: k for k, c in enumerate(" " + _LETTERS)}
#: Bytes to letter classes: Latin letters without regard to case, all else a border.
_CLASS = np.zeros(256, np.int64)
for _k, _c in enumerate(_LETTERS, 1):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper())] = _k
#: Signs of a candidate that a task remembers; longer ones are decoded each time.
REMEMBERED = 64
#: Characters of word beginnings that are features, and whole words.
PREFIXES = (4, 5, 6)
_KIND = np.zeros(1 << 16, np.uint8)  # by character: 1 letter, 2 sign, 4 spacer, 8 mark inside a word
for _bit, _chars in ((1, r"[^\W\d_]"), (2, f"[{_SIGNS}]"), (4, _SPACERS), (8, r"[*._\-]")):
    for _m in re.finditer(_chars, "".join(map(chr, range(1 << 16)))):
        _KIND[_m.start()] |= _bit


def _may_hold_candidate(text: str) -> bool:
    """Whether a lower-cased text has any place where a candidate could be: true wherever CANDIDATE matches."""
    if text.isascii():
        b = np.frombuffer(text.encode(), np.uint8)
    else:
        b = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if (b >= len(_KIND)).any():  # beyond the table
            return True
    if len(b) < 3:
        b = np.append(b, np.full(3, 10, b.dtype))  # line ends, which no candidate holds
    k = np.append(_KIND[b], np.zeros(4, np.uint8))
    letter, mark = (k & 1) > 0, (k & 8) > 0
    if (((k[:-1] & 2) > 0) & letter[1:]).any():
        return True
    if ((b[:-2] == b[1:-1]) & (b[1:-1] == b[2:]) & letter[2 : len(b)]).any():
        return True
    if (letter[:-3] & mark[1:-2] & mark[2:-1] & letter[3:]).any():  # a doubled mark
        return True
    inside = np.flatnonzero(letter[:-2] & mark[1:-1] & letter[2:]) + 1
    if len(inside):
        if ((b[inside] == ord("*")) | (b[inside] == ord("_"))).any():
            return True
        others = np.cumsum(~letter)
        if (np.diff(others[inside]) == 1).any():  # two marks with letters only between them
            return True
    unit, spacer = (k & 3) > 0, (k & 4) > 0
    step = np.full(len(k), -1)  # to the unit after one or two spacers
    step[:-3] = np.where(unit[:-3] & spacer[1:-2], np.where(unit[2:-1], 2, np.where(spacer[2:-1] & unit[3:], 3, -1)), -1)
    at = np.flatnonzero(step > 0)
    for _ in range(3):
        at = at[step[at] > 0]
        at = at + step[at]
    return len(at) > 0


_RUN = re.compile(r"(.)\1*", re.S)
_WORD = re.compile(r"[^\W\d_]+")


def corpus_trigrams(docs: DataFrame) -> DataFrame:
    """``gram`` and ``n``: character trigram counts over all texts; each task sends at most 27**3 sums."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N**3, np.int64)
        for b in batches:
            data = ("\n".join(x for x in b.column("text").to_pylist() if x) + "\n").encode()
            for i in range(0, len(data), 1 << 18):
                c = _CLASS[np.frombuffer(data[max(0, i - 2) : i + (1 << 18)], np.uint8)]
                if len(c) > 2:
                    total += np.bincount((c[:-2] * _N + c[1:-1]) * _N + c[2:], minlength=_N**3)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class CharModel:
    """Log probabilities of a letter after two others, interpolated with shorter contexts."""

    log: list[float]

    @classmethod
    def of(cls, counts: np.ndarray, words: list[str] = (), share: float = 0.02) -> CharModel:
        """``words``: known words that are mixed in with ``share`` of the mass, so that rare ones are not unlikely."""
        c = counts.reshape(_N, _N, _N).astype(float) + 1e-3
        if words:
            extra = np.zeros((_N, _N, _N))
            for w in words:
                s = "  " + "".join(x if x in _INDEX else " " for x in w) + " "
                for i in range(len(s) - 2):
                    extra[_INDEX[s[i]], _INDEX[s[i + 1]], _INDEX[s[i + 2]]] += 1
            c = c + extra * (share * c.sum() / extra.sum())
        tri = c / c.sum(2, keepdims=True)
        bi = c.sum(0) / c.sum((0, 2))[:, None]
        uni = c.sum((0, 1)) / c.sum()
        return cls(np.log(0.8 * tri + 0.15 * bi[None] + 0.05 * uni[None, None]).ravel().tolist())

    def decode(self, signs: str) -> str:
        """The likeliest plain word of a candidate, by Viterbi search over its whole lattice; time and memory grow with its length."""
        log = self.log
        # state: the last two letters -> (log probability, what was read before and here)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for m in _RUN.finditer(signs):
            options = readings(m[1], len(m[0]))
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (p, path) in states.items():
                for text, cost in options:
                    q, u, v = p + cost, a, b
                    for x in text:
                        k = _INDEX[x]
                        q += log[(u * _N + v) * _N + k] + PER_LETTER
                        u, v = v, k
                    if (u, v) not in after or after[u, v][0] < q:
                        after[u, v] = (q, (path, text) if text else path)
            states = after
        path = max((p + log[(a * _N + b) * _N], k) for k, ((a, b), (p, _)) in enumerate(states.items()))[1]
        path = list(states.values())[path][1]
        out = []
        while path is not None:
            path, text = path
            out.append(text)
        return "".join(reversed(out))


def readings(sign: str, run: int) -> list[tuple[str, float]]:
    """What a sign that stands ``run`` times in a row may be read as, with the channel's log probabilities."""
    letters = [(sign, 0.0)] if sign in _INDEX and sign != " " else [(x, SUBSTITUTED) for x in LOOK_ALIKES.get(sign, "")]
    options = [("", (PUT_IN_SIGN if letters else PUT_IN_SPACER) * min(run, 2))] if not letters or sign not in _INDEX else []
    for x, cost in letters:
        options.append((x, cost + (0 if run == 1 else DOUBLED if run == 2 else DRAWN_OUT)))
        if run > 1:
            options.append((x + x, cost + (0 if run == 2 else DRAWN_OUT - 1)))
    return options


class Restorer:
    """Replaces the candidates of a text by what they decode to; decoded candidates are remembered up to a bound."""

    def __init__(self, model: CharModel, remember: int = 50_000):
        self.model, self.remember, self.known = model, remember, {}

    def word(self, signs: str) -> str:
        got = self.known.get(signs)
        if got is None and sum(c.isalpha() for c in signs) < 2:
            return signs
        if got is None:
            got = self.model.decode(signs)
            if len(self.known) < self.remember and len(signs) <= REMEMBERED:
                self.known[signs] = got
        return got

    def text(self, text: str | None) -> str:
        """The text in lower case with its candidates restored."""
        low = (text or "").lower()
        if not low.isascii():
            if re.search("[\uff01-\uff5e\U0001d400-\U0001d7ff]", low):  # full-width and mathematical letters
                low = unicodedata.normalize("NFKC", low).lower()
            low = low.translate(HOMOGLYPHS) if re.search("[Ͱ-ϿЀ-ӿԀ-ԯ]", low) else low
        if not _may_hold_candidate(low):
            return low
        return CANDIDATE.sub(lambda m: m[0] if m[0].isalpha() and not m[0].isascii() else " " + self.word(m[0]) + " " if not m[0].isalpha() else self.word(m[0]), low)


def beginnings(text: str) -> Counter:
    """Counts of the word beginnings (and whole words, with a trailing blank) of a restored text."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall(text)).items():
        if len(w) > 2:
            for g in [w + " ", *[w[:k] for k in PREFIXES if len(w) >= k]]:
                out[g] += n
    return out


@dataclass
class ToxicityModel:
    """The character model, the word beginnings that count, and their weights."""

    chars: CharModel | None
    features: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    base: float | None = None

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 6000, features: int = 400, longest: int = 20_000, epochs: int = 400) -> ToxicityModel:
        """Count trigrams over all texts; learn from at most ``rows`` labelled documents of at most ``longest`` bytes."""
        spark = docs.sparkSession
        small_batches(spark)
        counts = np.zeros(_N**3)
        for r in corpus_trigrams(docs).collect():  # at most 27**3 rows
            counts[r["gram"]] = r["n"]
        chars = CharModel.of(counts)
        model = spark.sparkContext.broadcast(chars)
        sample = labelled_sample(docs, labels, label, rows).where(F.octet_length("text") <= longest)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer = Restorer(model.value)
            seen: Counter = Counter()
            per = [Counter(), Counter()]
            for b in batches:
                for text, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                    seen[int(y)] += 1
                    per[int(y)].update(beginnings(restorer.text(text)).keys())
            grams = list(per[0].keys() | per[1].keys())
            rows_ = [("", seen[0], seen[1])] + [(g, per[0][g], per[1][g]) for g in grams]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["g", "n0", "n1"])

        grams = sample.mapInArrow(count, "g string, n0 bigint, n1 bigint").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("g = '' OR n1 >= 4")
        found = grams.collect()  # bounded by the sample
        t0, t1 = next(((r["n0"], r["n1"]) for r in found if r["g"] == ""), (0, 0))
        lift = lambda r: (r["n1"] / max(1, t1)) / ((r["n0"] + 1) / (t0 + 1))
        top = sorted((r for r in found if r["g"] and lift(r) > 1.5), key=lambda r: (-r["n1"] * math.log(lift(r)), r["g"]))[:features]
        names = [r["g"] for r in top]
        # strong whole words join the character model, so that their obfuscations decode to them; weights are learned on that model's restorations
        out = cls(CharModel.of(counts, [r["g"].strip() for r in top if r["n0"] == 0 and r["g"].isascii()][:100]), names)
        y, x = out._sample(sample, rows)
        if len(set(y)) < 2 or not names:
            return cls(None, base=float(y.mean()) if len(y) else 0.5)
        out.weights = _logistic(x, y, epochs)
        return out

    def vector(self, restored: str, index: dict[str, int]) -> np.ndarray:
        """Features of a restored text: damped count and share of its words for each known beginning, and its length."""
        k = len(index)
        v = np.zeros(2 * k + 2, np.float32)
        words = _WORD.findall(restored)
        n = max(1, len(words))
        for w, c in Counter(words).items():
            if len(w) > 2:
                for g in [w + " ", *[w[:p] for p in PREFIXES if len(w) >= p]]:
                    j = index.get(g)
                    if j is not None:
                        v[j] += c
        v[k : 2 * k] = np.minimum(v[:k] / n * 50, 3)
        v[:k] = np.minimum(np.log1p(v[:k]), 2)
        v[-2], v[-1] = math.log1p(n) / 8, 1
        return v

    def _sample(self, sample: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
        model = sample.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.value
            restorer, index = Restorer(m.chars), {g: k for k, g in enumerate(m.features)}
            for b in batches:
                blobs = [m.vector(restorer.text(t), index).astype(np.float16).tobytes() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(blobs, pa.binary())], names=["doc_id", "label", "x"])

        got = sample.mapInArrow(run, "doc_id bigint, label double, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows).collect()
        x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, 2))
        return np.array([r["label"] for r in got]), x

    def score(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5, prefix: str = "") -> DataFrame:
        """``keep``, ``held_out``, ``score``, ``predicted`` for every row. No shuffle.

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
            index = {g: k for k, g in enumerate(m.features)}
            restorer = Restorer(m.chars) if m.chars else None
            for texts in batches:
                if m.base is not None:
                    yield pa.array(np.full(len(texts), m.base))
                else:
                    x = np.stack([m.vector(restorer.text(t), index) for t in texts.to_pylist()]) if len(texts) else np.zeros((0, len(m.weights)), np.float32)
                    yield pa.array(1 / (1 + np.exp(-np.clip(x.astype(np.float64) @ m.weights, -30, 30))))

        return score(text)


def _logistic(x: np.ndarray, y: np.ndarray, epochs: int) -> np.ndarray:
    """Logistic regression with weight decay, by Adam on the whole sample."""
    w, m1, m2 = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = x.T @ ((p - y) / len(y)).astype(np.float32) + 2e-5 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= 0.05 * (1 - 0.8 * t / epochs) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return w
