"""Near-duplicate groups by a prefix-tree join of n-gram sets, exact at any size.

A document's set holds the hashes of its distinct word n-grams; documents with equal sets are one set. Two sets that
are similar enough share an n-gram in their prefixes, in any global order. The join runs in steps:

1. Prefixes in hash order, made longer so that several of their n-grams must be shared, are dealt by hash. Sets that
   share too few are left out; they link with nothing.
2. For the n-grams of the other sets the holders are counted. That gives the global order of the join: n-grams that
   few sets hold first. N-grams of one set are no longer needed; sets that have too many of them are left out.
3. Prefix n-grams in this order give groups of sets. Every set goes to one block of its largest group. A block keeps
   its sets in a trie and joins them exactly by traversals that share partial overlaps and prune subtrees by the
   overlap that the remaining lengths still allow, or whose sets are all in the same component.
4. Groups whose sets are in different components by then are joined in pairs of blocks, those of a group's main
   component only with others. No pairs of sets are made.

So two sets that share a prefix n-gram are either in one component or were compared; nothing is capped or sampled.
N-grams and sets are told apart by 64-bit hashes: among 2e10 different sets about ten pairs are expected to collide.

Defined results: null and empty texts, and texts without words, have no n-grams, are linked with nothing and are
their own component; texts with fewer words than n have their whole sequence as one n-gram; very long texts are sets
like others; rows that repeat an id share the results of their own text; a null id is larger than any other and takes
its component's smallest id; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prlens.llm._arrow import clean_memory, discard, fitting, packs, small_batches, written
from prlens.llm.components import components
from prlens.llm.suffix_dedup import _blob, _groups, _mixed, _power, _unblob

CHUNK, PACK = 192 << 10, 6 << 20
#: Bytes of text of a bucket of prefix n-grams, and that one task pre-aggregates; buckets at least, for parallel work.
BUCKET_BYTES, FLUSH, LEAST_BUCKETS = 64 << 20, 192 << 20, 24
#: Share of a set's size that the prefixes in hash order are longer than one common n-gram needs; as many more must be shared.
MORE = 0.15
#: Sets and n-grams of a block.
BLOCK_SETS, BLOCK_CELLS = 256, 4_000_000
_TABLE = np.random.default_rng(31).integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = np.random.default_rng(32).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _chunk_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct n-grams of each text of a chunk, in the order of row and hash."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~gap
    first[1:] &= gap[:-1]
    rows_at = offsets[:-1][np.diff(offsets) > 0]
    first[rows_at] = ~gap[rows_at]
    last = ~gap
    last[:-1] &= gap[1:]
    ends_at = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends_at] = ~gap[ends_at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[low] * up[:n], dtype=np.uint64)])
    word = _mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, "right") - 1
    m = len(word)
    if m >= k:
        gram = word[: m - k + 1] * _PLACE[0]
        for j in range(1, k):
            gram = gram + word[j : m - k + 1 + j] * _PLACE[j]
        whole = row[: m - k + 1] == row[k - 1 :]
        h, r = _mixed(gram[whole]), row[: m - k + 1][whole]
    else:
        h, r = np.empty(0, np.uint64), np.empty(0, np.int64)
    words = np.bincount(row, minlength=len(offsets) - 1)
    few = np.flatnonzero((words > 0) & (words < k))
    if len(few):
        begin = np.searchsorted(row, few)
        short = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            have = words[few] > j
            short[have] += word[begin[have] + j] * _PLACE[j]
        short = _mixed(short + words[few].astype(np.uint64) * _PLACE[63])
        h, r = np.concatenate([h, short]), np.concatenate([r, few])
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new]


def ngram_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram hashes of a pack of texts, one row after another, in ascending order; the size and the id of each row's set."""
    rows, hashes, i, n = [], [], 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1))
        r, h = _chunk_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
        rows.append(r + i)
        hashes.append(h)
        i = j
    row = np.concatenate(rows) if rows else np.empty(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    sizes = np.bincount(row, minlength=n)
    ids = np.zeros(n, np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
        m = _mixed(h ^ np.uint64(0xA0761D6478BD642F))
        ids[full] = _mixed(np.add.reduceat(m, starts) + sizes[full].astype(np.uint64) * _PLACE[62])
    return h, sizes, ids.view(np.int64)


class SetTrie:
    """Ordered sets in a path-compressed trie; the sets below a node are neighbours in the sorted order.

    ``sets``: ascending places of each set's n-grams in the global order, without those that no other set holds;
    ``sizes``: sizes with these.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i4").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.asarray(sizes)[self.order]
        self.lengths = np.array([len(s) for s in self.sets])
        self.nodes: list[tuple[int, int, int, np.ndarray, int, int, int, list[int]]] = []
        self.root = self._build()

    def _build(self) -> int:
        """Nodes: first set, last set, end of the path, path, smallest and largest size, longest set, children."""
        stack = [(0, len(self.sets), 0, -1)]
        while stack:
            lo, hi, depth, parent = stack.pop()
            a, b = self.sets[lo], self.sets[hi - 1]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:n] != b[depth:n])
            end = depth + int(differ[0]) if len(differ) else n
            me = len(self.nodes)
            self.nodes.append((lo, hi, end, a[depth:end], int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max()), int(self.lengths[lo:hi].max()), []))
            if parent >= 0:
                self.nodes[parent][7].append(me)
            if hi - lo > 1:
                i = lo
                while i < hi and self.lengths[i] == end:  # sets that end at this node come first
                    self.nodes.append((i, i + 1, end, a[:0], int(self.sizes[i]), int(self.sizes[i]), end, []))
                    self.nodes[me][7].append(len(self.nodes) - 1)
                    i += 1
                heads = np.array([self.sets[k][end] for k in range(i, hi)])
                cuts = [i, *(np.flatnonzero(np.diff(heads)) + i + 1).tolist(), hi] if i < hi else []
                stack += [(p, q, end, me) for p, q in zip(cuts, cuts[1:], strict=False)]
        return 0

    def links(self, x: np.ndarray, n: int, num: int, den: int, seen: np.ndarray, skip: np.ndarray) -> list[int]:
        """Sets, by their places in the sorted order, that the set ``x`` of size ``n`` links with, but those in ``skip``.

        ``seen`` is a scratch array of falses over all n-grams.
        """
        seen[x] = True
        least, found = -(-num * n // den), []
        stack = [(self.root, 0, 0)]  # node, overlap so far, elements of x not after the path
        while stack:
            k, overlap, passed = stack.pop()
            lo, hi, end, path, small, large, longest, children = self.nodes[k]
            if large < least or small * num > n * den or skip[lo:hi].all():
                continue
            if len(path):
                overlap += int(np.count_nonzero(seen[path]))
                passed = int(np.searchsorted(x, path[-1], "right"))
            # a set below shares at most this much more, and needs num/(num+den) of the sum of both sizes
            if (overlap + min(longest - end, len(x) - passed)) * (num + den) < num * (n + max(small, least)):
                continue
            if children:
                stack += [(c, overlap, passed) for c in children]
            elif hi - lo == 1 and overlap * (num + den) >= num * (n + int(self.sizes[lo])):
                found.append(lo)
        seen[x] = False
        return found


def local_order(grams: list[np.ndarray], held: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Each set's n-grams as ascending places in the global order (fewest holders first, then by hash) among those of the block."""
    every, first, back = np.unique(np.concatenate(grams), return_index=True, return_inverse=True)
    order = np.lexsort((every, np.concatenate(held)[first]))
    place = np.empty(len(every), np.int64)
    place[order] = np.arange(len(every))
    return [np.sort(p) for p in np.split(place[back], np.cumsum([len(g) for g in grams])[:-1])], len(every)


def block_links(sets: list[np.ndarray], sizes: np.ndarray, width: int, num: int, den: int) -> np.ndarray:
    """For each set of a block the place of a set that stands for its component."""
    trie = SetTrie(sets, sizes)
    seen = np.zeros(width, bool)
    component = np.arange(len(sets))  # by place in the trie
    for i in range(len(sets)):
        for j in trie.links(trie.sets[i], int(trie.sizes[i]), num, den, seen, component == component[i]):
            if component[j] != component[i]:
                component[component == component[j]] = component[i]
    order = np.array(trie.order)
    out = np.empty(len(sets), np.int64)
    out[order] = order[component]
    return out


def pair_links(queries: list[np.ndarray], n: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, of: np.ndarray, width: int, num: int, den: int) -> list[tuple[int, int]]:
    """Links (query, set) between different components, enough of them to join these; ``labels`` and ``of`` are what is known of the components."""
    trie = SetTrie(sets, sizes)
    seen = np.zeros(width, bool)
    names, back = np.unique(np.concatenate([labels, np.asarray(of)[trie.order]]), return_inverse=True)
    q, s = back[: len(queries)].copy(), back[len(queries) :].copy()
    out = []
    for i, x in enumerate(queries):
        for j in trie.links(x, int(n[i]), num, den, seen, s == q[i]):
            if s[j] != q[i]:
                out.append((i, trie.order[j]))
                old = s[j]
                s[s == old] = q[i]
                q[q == old] = q[i]
    return out


def _gathered(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``PACK`` bytes of text (or one longer row)."""
    for batch in batches:
        for part, data, offsets in packs(batch, text, PACK):
            yield batch.slice(part.start, part.stop - part.start), data, offsets


def _needed(n: str, num: int, den: int) -> Column:
    """The least overlap of a set of size ``n`` with any set that it links with."""
    return F.expr(f"({n} * {num} + {den - 1}) DIV {den}")


def near_duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id``, ``row`` (a hash of the text) and ``group`` (a name of the component, null without n-grams) for every row.

    Sets link when intersection / union is ``threshold`` or more.
    """
    spark = docs.sparkSession
    small_batches(spark)
    num, den = threshold
    t = F.coalesce(F.col(text), F.lit(""))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(t).alias("row"), t.cast("binary").alias("text"))

    entries = written(rows.mapInArrow(_prefix_writer(shingle, num, den, buckets), "bucket int, blob binary"), "ngram-prefixes")
    slim = written(entries.where("bucket = -1").mapInArrow(_unpacked_rows, "doc_id bigint, row bigint, set_id bigint, n bigint"), "ngram-rows")
    shared = entries.where("bucket <> -1").groupBy("bucket").applyInArrow(_shared_counts, "set_id bigint, n bigint, shared bigint")
    enough = F.least(F.floor(_needed("n", num, den) * F.lit(MORE)) + 1, _needed("n", num, den))
    live = shared.groupBy("set_id", "n").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= enough).select("set_id")
    every_set = slim.where("n > 0").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("holder"))
    copies = slim.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("copies"))
    wanted = live.join(every_set, "set_id").select("set_id", "holder.doc_id", "holder.row")
    wanted = written(wanted.join(copies, wanted["doc_id"].eqNullSafe(copies["doc_id"]) & (wanted["row"] == copies["row"])).select(wanted["set_id"], wanted["doc_id"].alias("_d"), wanted["row"].alias("_r"), "copies"), "ngram-wanted")
    discard(entries)

    # the sets that may link, each with its n-grams
    texts = rows.join(fitting(wanted), rows["doc_id"].eqNullSafe(F.col("_d")) & (rows["row"] == F.col("_r")))
    texts = texts.where("copies = 1").unionByName(texts.where("copies > 1").dropDuplicates(["set_id"]))

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, offsets in _gathered(batches, "text"):
            h, sizes, _ = ngram_sets(data, offsets, shingle)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("set_id"), pa.array(sizes.astype(np.int64)), lists], names=["doc_id", "set_id", "n", "grams"])

    sets = written(texts.select("doc_id", "set_id", "text").mapInArrow(grams_of, "doc_id bigint, set_id bigint, n bigint, grams array<bigint>"), "ngram-sets")
    node = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "set_id").alias("node")  # in the order of the ids
    grams = sets.select(node, "n", F.explode("grams").alias("gram"))
    held = grams.groupBy("gram").agg(F.count(F.lit(1)).cast("int").alias("held")).where("held > 1")
    ordered = grams.join(held, "gram").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("held", "gram"))).alias("g")).where(F.size("g") >= _needed("n", num, den))
    ordered = written(ordered.select("node", "n", F.size("g").cast("long").alias("size"), F.col("g.gram").alias("grams"), F.col("g.held").alias("held")), "ngram-ordered")
    for done in (sets, wanted):
        discard(done)
    clean_memory(spark)

    # prefixes: the smaller of two sets that link shares one of its first n-grams up to `inner`, the larger one up to `outer`
    own = F.col("n") - F.col("size")
    outer, inner = F.col("n") - _needed("n", num, den) + 1 - own, F.col("n") - _needed("n", 2 * num, num + den) + 1 - own
    places = ordered.select("node", "n", "size", inner.alias("inner"), F.posexplode(F.slice("grams", F.lit(1), outer.cast("int"))).alias("place", "gram"))
    groups = places.groupBy("gram").agg(
        F.count(F.lit(1)).alias("m"), F.sum("size").alias("cells"), F.bool_or(F.col("place") < F.col("inner")).alias("inner"),
        F.min(F.struct((F.col("n") - F.col("size")).alias("own"), "node")).alias("hub"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y"),
    ).where("m > 1 AND inner")
    groups = groups.groupBy("m", "x", "y").agg(F.min(F.struct("gram", "m", "cells", F.col("hub.node").alias("hub"))).alias("g")).select("g.*")  # groups of the same sets count once
    members = written(places.select("node", "gram", "size").join(groups, "gram"), "ngram-members")

    # first every set in one group, the largest; a group's blocks all hold its hub
    blocks = lambda m, cells: F.greatest(F.ceil(F.col(m) / BLOCK_SETS), F.ceil(F.col(cells) / BLOCK_CELLS)).cast("int")
    first = members.groupBy("node").agg(F.max(F.struct("m", "gram", "cells", "hub")).alias("g")).select("node", "g.*").withColumn("blocks", blocks("m", "cells"))
    hubs = groups.withColumn("blocks", blocks("m", "cells")).where("blocks > 1").select(F.col("hub").alias("node"), "gram", "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = first.select("node", "gram", "hub", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")).unionByName(hubs).distinct()
    in_blocks = dealt.join(ordered, "node").repartition("gram", "block").sortWithinPartitions("gram", "block")
    in_blocks = in_blocks.select("gram", "block", "node", (F.col("hub") == F.col("node")).alias("hub"), "n", "grams", "held")
    node_type = "struct<no:boolean,doc_id:bigint,set_id:bigint>"
    known = written(in_blocks.mapInArrow(_solve_blocks(num, den), f"node {node_type}, label {node_type}"), "ngram-known")
    labels = known.groupBy("node").agg(F.min("label").alias("label"))  # a hub has one in each block

    # then the groups whose sets are in different components: pairs of blocks, but for two blocks of the main component
    labelled = members.join(labels, "node", "left").select("node", "gram", "size", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("cells")).groupBy("gram").agg(
        F.count(F.lit(1)).alias("labels"), F.max(F.struct("c", "cells", "label")).alias("main"), F.sum("c").alias("m"), F.sum("cells").alias("cells"),
    ).where("labels > 1").select("gram", F.col("main.label").alias("main"), "main.c", F.col("main.cells").alias("main_cells"), (F.col("m") - F.col("main.c")).alias("rest"), (F.col("cells") - F.col("main.cells")).alias("rest_cells"))
    mixed = mixed.select("gram", "main", blocks("c", "main_cells").alias("mains"), blocks("rest", "rest_cells").alias("rests"))
    placed = labelled.join(mixed, "gram").withColumn("in_main", F.col("label") == F.col("main"))
    placed = placed.withColumn("b", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    to = lambda rest, i, j, query: F.struct(F.lit(rest).alias("rest"), i.cast("int").alias("i"), j.cast("int").alias("j"), query.alias("query"))
    b, others = F.col("b"), F.sequence(F.lit(0), F.col("rests") - 1)
    task = F.when(F.col("in_main"), F.transform(others, lambda i: to(False, i, b, F.lit(False)))).otherwise(F.concat(
        F.transform(others, lambda j: to(True, F.least(b, j), F.greatest(b, j), b <= j)), F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: to(False, b, j, F.lit(True)))))
    tasks = placed.select("node", "gram", "label", F.explode(task).alias("t")).select("node", "gram", "label", "t.*")
    pairs = tasks.join(ordered, "node").repartition("gram", "rest", "i", "j").sortWithinPartitions("gram", "rest", "i", "j")
    pairs = pairs.select("gram", "rest", "i", "j", "query", "node", "label", "n", "grams", "held")
    more = written(pairs.mapInArrow(_solve_pairs(num, den), f"u {node_type}, v {node_type}"), "ngram-more")
    links = known.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more)
    label_of = components(links)
    for done in (ordered, members, known, more):
        discard(done)
    clean_memory(spark)
    linked = label_of.select(F.col("node.set_id").alias("set_id"), F.col("label.doc_id").alias("linked"), F.col("label.set_id").alias("group"))
    own = every_set.select("set_id", F.col("holder.doc_id").alias("least")).join(linked, "set_id", "left")
    own = written(own.select("set_id", F.when(F.col("group").isNull(), F.col("least")).otherwise(F.col("linked")).alias("component_id"), F.coalesce("group", "set_id").alias("group")), "ngram-components")
    discard(label_of)
    out = slim.join(own, "set_id", "left")  # nothing else in its stage, so that Spark may split a set of very many copies
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row", "group")


def _prefix_writer(shingle: int, num: int, den: int, buckets: int):  # noqa: ANN202
    """Rows of two kinds: the documents' set ids and sizes (bucket -1), and prefix n-grams in hash order by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def row(bucket: int, blob: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

        def flush() -> Iterator[pa.RecordBatch]:
            """All that is held: an n-gram of several sets is counted for these here and sent once, however many hold it."""
            base = np.cumsum([0] + [len(x[0]) for x in held])
            sets, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            gram, of = np.concatenate([x[2] for x in held]), np.concatenate([x[3] + b for x, b in zip(held, base, strict=False)])
            held.clear()
            if not len(sets):
                return
            _, first, back = np.unique(sets, return_index=True, return_inverse=True)  # a set that several packs hold counts once
            keep = first[back][of] == of
            gram, of = gram[keep], of[keep]
            order = np.lexsort((of, gram))
            gram, of = gram[order], of[order]
            new = np.concatenate([[True], gram[1:] != gram[:-1]]) if len(gram) else np.empty(0, bool)
            start = np.flatnonzero(new)
            many = np.diff(np.append(start, len(gram))) > 1
            here = np.bincount(of[np.repeat(many, np.diff(np.append(start, len(gram))))], minlength=len(sets))
            some = np.flatnonzero(here)
            yield row(-2, _blob(sets[some], n[some].astype("<i4"), here[some].astype("<i4")))
            gram, of = gram[start], of[start]
            for b, k in _groups(((gram >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)):
                yield row(b, _blob(gram[k].astype("<u4"), sets[of[k]], n[of[k]].astype("<i4"), many[k].astype("u1")))

        for piece, data, offsets in _gathered(batches, "text"):
            h, sizes, sets = ngram_sets(data, offsets, shingle)
            ids, none = piece.column("doc_id"), np.asarray(piece.column("doc_id").is_null().to_numpy(zero_copy_only=False), "u1")
            yield row(-1, _blob(ids.fill_null(0).to_numpy(), piece.column("row").to_numpy(), none, sets, sizes.astype("<i4")))
            of = np.repeat(np.arange(len(sets)), sizes)
            place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            least = -(-num * sizes // den)
            prefix = place < (sizes - least + np.floor(sizes * MORE).astype(np.int64) + 1)[of]
            held.append((sets, sizes, h[prefix], of[prefix]))
            size += len(data)
            if size >= FLUSH:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


def _unpacked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.column("blob").to_pylist():
            ids, row, none, sets, sizes = _unblob(b, "<i8", "<i8", "u1", "<i8", "<i4")
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=none.astype(bool)), pa.array(row), pa.array(sets), pa.array(sizes.astype(np.int64))], names=["doc_id", "row", "set_id", "n"])


def _shared_counts(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set the number of a bucket's prefix n-grams that other sets hold too; bucket -2 has been counted before."""
    names = ["set_id", "n", "shared"]
    parts = []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if bucket == -2:
                s, n, c = _unblob(blob, "<i8", "<i4", "<i4")
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n.astype(np.int64)), pa.array(c.astype(np.int64))], names=names)
            else:
                parts.append(_unblob(blob, "<u4", "<i8", "<i4", "u1"))
    if not parts:
        return
    tag, s, n, many = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((s, tag))
    tag, s, n, many = tag[order], s[order], n[order], many[order]
    start = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]]))
    size = np.diff(np.append(start, len(tag)))
    shared = np.maximum.reduceat(many, start).astype(bool) | (s[start] != s[np.append(start[1:], len(tag)) - 1])
    mine = np.repeat(shared, size) & ~many.astype(bool)
    mine[1:] &= (tag[1:] != tag[:-1]) | (s[1:] != s[:-1]) | many[:-1].astype(bool)
    ids, first, count = np.unique(s[mine], return_index=True, return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[mine][first].astype(np.int64)), pa.array(count.astype(np.int64))], names=names)


def _runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, list]]:
    """Rows that agree in the first ``keys`` columns and come one after another, as columns; n-gram lists as arrays."""
    names: list[str] = []
    held: dict[str, list] = {}
    current = None
    for batch in batches:
        names = batch.schema.names
        columns = {c: [np.asarray(x.values) for x in batch.column(c)] if c in ("grams", "held") else batch.column(c).to_pylist() for c in names}
        for i, k in enumerate(zip(*(columns[c] for c in names[:keys]), strict=True)):
            if k != current:
                if held:
                    yield held
                current, held = k, {c: [] for c in names}
            for c in names:
                held[c].append(columns[c][i])
    if held:
        yield held


def _node_pairs(pairs: list[tuple[dict, dict]], names: tuple[str, str]) -> pa.RecordBatch:
    kind = pa.struct([("no", pa.bool_()), ("doc_id", pa.int64()), ("set_id", pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)], names=list(names))


def _solve_blocks(num: int, den: int):  # noqa: ANN202
    """Blocks of sets: each set with a set that stands for its component, the hub where it is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[dict, dict]] = []
        for block in _runs_of(batches, 2):
            sets, width = local_order(block["grams"], block["held"])
            of = block_links(sets, np.array(block["n"]), width, num, den)
            for i, hub in enumerate(block["hub"]):
                if hub:
                    of[of == of[i]] = i
            out += [(block["node"][i], block["node"][k]) for i, k in enumerate(of.tolist())]
            if len(out) > 10_000:
                yield _node_pairs(out, ("node", "label"))
                out = []
        yield _node_pairs(out, ("node", "label"))

    return run


def _solve_pairs(num: int, den: int):  # noqa: ANN202
    """Pairs of blocks: links between sets of different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[dict, dict]] = []
        for block in _runs_of(batches, 4):
            node, n = block["node"], np.array(block["n"])
            label = np.unique(np.array([x["set_id"] for x in block["label"]]), return_inverse=True)[1]
            query = np.array(block["query"])
            q = np.flatnonzero(query)
            s = q if block["rest"][0] and block["i"][0] == block["j"][0] else np.flatnonzero(~query)
            if not len(q) or not len(s):
                continue
            sets, width = local_order(block["grams"], block["held"])
            found = pair_links([sets[i] for i in q], n[q], label[q], [sets[i] for i in s], n[s], label[s], width, num, den)
            out += [(node[q[a]], node[s[b]]) for a, b in found]
            if len(out) > 10_000:
                yield _node_pairs(out, ("u", "v"))
                out = []
        yield _node_pairs(out, ("u", "v"))

    return run


def one_of_each(docs: DataFrame, groups: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id; all rows without n-grams.

    ``groups``: what :func:`near_duplicate_groups` gave for ``docs``. Rows that are equal in id and text count once.
    """
    rows = written(groups.select(F.col(key).alias("k"), "row", "n_shingles", "group").groupBy("k", "row").agg(F.min("n_shingles").alias("n"), F.min("group").alias("c"), F.count(F.lit(1)).alias("copies")), "ngram-groups")
    least = rows.where("n > 0").groupBy("c").agg(F.min(F.struct(F.col("k").isNull().alias("no"), "k", "row")).alias("m")).select(F.col("m.k").alias("_k"), F.col("m.row").alias("_r"))
    gone = rows.where("n > 0").join(least, rows["k"].eqNullSafe(F.col("_k")) & (rows["row"] == F.col("_r")), "left_anti")
    changed = written(gone.select("k", "row", F.lit(False).alias("_once")).unionByName(rows.join(least, rows["k"].eqNullSafe(F.col("_k")) & (rows["row"] == F.col("_r")), "left_semi").where("copies > 1").select("k", "row", F.lit(True).alias("_once"))).select(F.col("k").alias("_k"), F.col("row").alias("_r"), "_once"), "ngram-changed")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)], docs[key].cast("long").alias("_key"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("_row"))
    found = plain.join(fitting(changed), plain["_key"].eqNullSafe(F.col("_k")) & (plain["_row"] == F.col("_r")), "left")
    out = found.where("_once IS NULL").unionByName(found.where("_once").dropDuplicates(["_key", "_row"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
