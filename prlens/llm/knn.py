"""Exact top-k search by inner product: a Voronoi join in blocks.

Data and queries are grouped by pivots, which are as many for small tables as for large ones. Data of a Voronoi cell are
packed into blocks, each with a summary: its pivot's number and its largest distance from the pivot. From the summaries
of the cells each query group derives a bound: a score that its k best are sure to reach. A block goes to a query group
only if its own upper bound reaches that score for one of the group's queries. A query group is solved with a bounded
number of blocks at a time, in different tasks; the partial lists of a query are merged.

For a query q, a pivot p and a vector s of p's cell: <q,p> - |q||s-p| <= <q,s> <= <q,p> + |q||s-p|.

Defined results: null vectors, and vectors with null or non-finite components, take no part as query or
candidate; a vector with fewer components than another counts as padded with zeros; equal vectors are separate
candidates, ties go to the smaller id; candidates that repeat an id count once per row, equal rows of a query once, and
a query never meets rows of its own id; rows without an id take no part; other columns are not read; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prlens.llm._arrow import small_batches, written

#: Rows of a block of data, and of a group of queries.
BLOCK_ROWS, GROUP_ROWS = 4096, 256
#: Blocks, on average, that meet a copy of a query group in one task.
BLOCKS_TOGETHER = 64
#: Most pivots; they are a bounded sample of the data, and the only vectors that are broadcast.
PIVOTS = 128
_SLACK = 1e-6


def quantized(vector: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of each component as long, or null if any component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix, shorter rows padded with zeros."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values[offsets[0] : offsets[-1]]
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return (np.pad(a, ((0, 0), (0, d - a.shape[1]))) if a.shape[1] < d else a), (np.pad(b, ((0, 0), (0, d - b.shape[1]))) if b.shape[1] < d else b)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and the distance to it."""
    x, p = _same_width(x, pivots)
    cell = ((p**2).sum(1)[None] - 2 * (x @ p.T)).argmin(1)
    return cell, np.sqrt(((x - p[cell]) ** 2).sum(1))


def pivot_sample(vectors: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """At most ``n`` vectors, chosen by the hash of their values so that equal vectors give one pivot."""
    rows = vectors.select("v", F.xxhash64("v").alias("h")).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(n).collect()
    if not rows:
        return np.zeros((0, 1))
    d = max(len(r["v"]) for r in rows)
    return np.array([list(r["v"]) + [0] * (d - len(r["v"])) for r in rows], float)


def _pack(df: DataFrame, pivots: np.ndarray, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` rows: ``cell``, ``radius``, ``ids`` and ``vectors`` (binary), ``n``, ``width``; one Python task keeps one open block a cell."""
    small_batches(df.sparkSession, 4096)
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        open_: dict[int, list] = {}

        def block(c: int, parts: list) -> tuple:
            d = max(x.shape[1] for _, x, _ in parts)
            x = np.concatenate([np.pad(x, ((0, 0), (0, d - x.shape[1]))) for _, x, _ in parts])
            ids = np.concatenate([i for i, _, _ in parts])
            far = max(float(r.max()) for _, _, r in parts)
            kind = np.int16 if np.abs(x).max(initial=0) < 32000 else np.int64
            return c, far, ids.astype(np.int64).tobytes(), x.astype(kind).tobytes(), len(ids), d

        def batch(blocks: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), kinds, strict=True)], names=["cell", "radius", "ids", "vectors", "n", "width"])

        for b in batches:
            if not len(b):
                continue
            x, ids = _matrix(b.column("v")), b.column("id").to_numpy()
            cell, far = _nearest(x, p)
            order = np.argsort(cell, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                c = int(cell[part[0]])
                open_.setdefault(c, []).append((ids[part], x[part], far[part]))
                if sum(len(i) for i, _, _ in open_[c]) >= rows:
                    yield batch([block(c, open_.pop(c))])
        if open_:
            yield batch([block(c, parts) for c, parts in open_.items()])

    return df.mapInArrow(run, "cell int, radius double, ids binary, vectors binary, n int, width int")


def _vectors(blob: bytes, n: int, width: int) -> np.ndarray:
    kind = np.int16 if len(blob) == 2 * n * width else np.int64
    return np.frombuffer(blob, kind).reshape(n, width).astype(np.float64)


def voronoi_topk(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The ``k`` best candidates of each query by integer inner product: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = vectors.select(F.col(key).cast("long").alias("id"), quantized(F.col(vector), scale).alias("v"), is_query.alias("_q")).where("id IS NOT NULL AND v IS NOT NULL")
    schema = "query_id long, rank int, vec_id long, score long"
    pivots = pivot_sample(rows)
    if not len(pivots):
        return spark.createDataFrame([], schema)
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if("_q")).first()
    copies = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]  # a query may have to pass over so many rows of its own id
    # few small partitions are joined, so that blocks fill up; large inputs keep theirs
    data = written(_pack(rows.select("id", "v").coalesce(max(1, total // (4 * BLOCK_ROWS))), pivots, BLOCK_ROWS).withColumn("block", F.monotonically_increasing_id()), "knn-data")
    # queries near the same pivot share a group; there are fewer pivots for them, so that groups fill up
    asking = rows.where("_q").select("id", "v").distinct().repartition(max(1, asked // (8 * GROUP_ROWS)), "id")
    near = written(_pack(asking, pivots[: max(1, asked // GROUP_ROWS)], GROUP_ROWS).withColumn("group", F.monotonically_increasing_id()), "knn-queries")
    summary = data.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).orderBy("cell").collect()  # at most PIVOTS rows
    blocks = data.select("block", "cell", "radius", "n")
    known = spark.sparkContext.broadcast((pivots, [(r["cell"], r["radius"], r["n"]) for r in summary]))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query group, the largest radius of each cell's blocks below which a block cannot matter."""
        p, cells = known.value
        cell, radius, count = (np.array(x) for x in zip(*cells, strict=True))
        for b in batches:
            out: list[tuple] = []
            for i in range(len(b)):
                q = _vectors(b.column("vectors")[i].as_py(), b.column("n")[i].as_py(), b.column("width")[i].as_py())
                a, pv = _same_width(q, p)
                dots, norms = a @ pv[cell].T, np.sqrt((q**2).sum(1))
                low = dots - norms[:, None] * radius[None]
                # the score that k candidates besides the query's own rows reach for sure
                order = np.argsort(-low, axis=1)
                have = np.cumsum(count[order], axis=1)
                enough = (have >= k + copies).argmax(1)
                sure = np.where(have[:, -1] >= k + copies, low[np.arange(len(q)), order[np.arange(len(q)), enough]], -np.inf)
                need = ((sure[:, None] - dots) / np.maximum(norms, 1e-9)[:, None]).min(0) * (1 - _SLACK) - _SLACK
                out += [(b.column("group")[i].as_py(), int(c), float(x)) for c, x in zip(cell, need, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.float64()), strict=True)], names=["group", "cell", "need"])

    pairs = near.mapInArrow(wanted, "group bigint, cell int, need double").join(blocks, "cell").where("radius >= need").select("group", "block")
    # a group that needs very many blocks is copied for shares of them; a copy is small beside the blocks it meets
    total_blocks = blocks.count()
    pairs = written(pairs.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(max(1, total_blocks // BLOCKS_TOGETHER)))), "knn-pairs")
    copies_of = near.select("group", "ids", "vectors", "n", "width").join(pairs.select("group", "share").distinct(), "group")
    joined = (
        pairs.join(data.select("block", F.col("ids").alias("d_ids"), F.col("vectors").alias("d_vectors"), F.col("n").alias("d_n"), F.col("width").alias("d_width")), "block")
        .join(copies_of, ["group", "share"])
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each query among the blocks that came with its group, folded block by block."""
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def sent(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

        for b in batches:
            for r in b.to_pylist():
                q, x = _same_width(_vectors(r["vectors"], r["n"], r["width"]), _vectors(r["d_vectors"], r["d_n"], r["d_width"]))
                q_ids, ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["d_ids"], np.int64)
                if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2.0**52:
                    scores = q @ x.T  # whole numbers, exact in doubles
                else:
                    scores = q.astype(np.int64) @ x.astype(np.int64).T
                masked = np.where(q_ids[:, None] == ids[None], scores.min() - 1, scores)
                if len(ids) > k:  # the k-th best score of each row; all that reach it are looked at, so ties are whole
                    floor_ = -np.partition(-masked, k - 1, axis=1)[:, k - 1]
                    i, c = np.nonzero((masked >= floor_[:, None]) & (masked >= scores.min()))
                else:
                    i, c = np.nonzero(masked >= scores.min())
                found = (q_ids[i], ids[c], scores[i, c].astype(np.int64))
                if r["group"] in best:
                    found = tuple(np.concatenate(z) for z in zip(best[r["group"]], found, strict=True))
                order = np.lexsort((found[1], -found[2], found[0]))
                first = np.concatenate([[True], np.diff(found[0][order]) != 0]) if len(order) else np.empty(0, bool)
                place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
                order = order[place < k]
                best[r["group"]] = tuple(z[order] for z in found)
                if len(best) > 512:
                    yield sent(list(best.values()))
                    best = {}
        if best:
            yield sent(list(best.values()))

    part = joined.mapInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    # a query has at most one list for each share to merge
    final = part.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("l"))
    return final.select("query_id", F.posexplode("l").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
