"""Exact substring deduplication across documents by external suffix sorting.

A string of ``length`` bytes of a document goes if it also starts in a document with a smaller id. Only stretches
that can hold such strings are sorted:

1. Every string of ``length`` bytes chooses an anchor inside it, by its bytes alone, so equal strings choose equal
   anchors. Neighbouring strings mostly choose the same one; they form a run, and a run with the bytes it covers is
   its context. Per pack of texts, equal contexts are pre-aggregated to the smallest id.
2. Runs are dealt by their anchors' hashes. Equal contexts in several documents settle all of them but the smallest
   id's; what is left are anchors with several contexts.
3. The bytes of one copy of each of those contexts make a shard, which is suffix sorted (:mod:`prlens.llm.suffix`);
   windows with a common prefix of ``length`` stand together, and those of larger ids go. An anchor whose contexts
   alone outgrow a shard (a line of many documents amid different text) is split: its windows are dealt to several
   shards by their own bytes, so equal windows still meet, and equal windows of a part are pre-aggregated.

A sorted shard, a pack and a part of the documents have sizes that do not grow with the input. The second step holds
about 40 bytes for each run of an anchor, not its text; this grows with the documents that hold one anchor.

Defined results: null text is empty; texts shorter than ``length`` keep all bytes; a null id is larger than any;
rows that repeat an id do not count against each other; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prlens.llm._arrow import clean_memory, discard, packs, small_batches, written
from prlens.llm.suffix import repeated_windows

#: Bytes of text that are hashed at once, and that share a pre-aggregation.
CHUNK, PACK = 192 << 10, 6 << 20
#: Bytes of text per part of the documents, and per shard of anchors.
PART_BYTES, SHARD_BYTES = 3 << 20, 8 << 20
#: A longer text is hashed in pieces of this many bytes that overlap by ``length`` - 1.
PIECE = 4 << 20
#: Windows of split anchors that are compared at once.
SPLIT_WINDOWS = 1 << 17
_LOW = np.uint64((1 << 24) - 1)
_LAST = np.int64(2**63 - 1)
_TABLES = np.random.default_rng(20).integers(1, 2**63, (2, 256), dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def _range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, down: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * down[start]


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor: piece, first window (from the piece's start), windows, anchor hash, context hash."""
    gram = length // 2 + 1
    width = length - gram + 1
    n = len(data)
    empty = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    if n < length:
        return empty
    up, down = _power(n + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(_TABLES[0][data] * up[:n], dtype=np.uint64)])
    at = np.arange(n - gram + 1)
    h = _mixed((prefix[gram:] - prefix[: n - gram + 1]) * down[: n - gram + 1])
    key = (h & ~_LOW) | at.astype(np.uint64)
    span = 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if width > span:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    piece = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(key)]
    valid = np.arange(len(key)) + length <= offsets[piece + 1]
    new = valid.copy()
    new[1:] &= (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return empty
    counted = np.concatenate([[0], np.cumsum(valid)])
    windows = counted[np.append(first[1:], len(key))] - counted[first]
    anchor = (key[first] & _LOW).astype(np.int64)
    second = np.concatenate([[np.uint64(0)], np.cumsum(_TABLES[1][data] * up[:n], dtype=np.uint64)])
    context = _mixed(_range_hash(second, first, first + windows + length - 1, down) + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    p = piece[first]
    return p, first - offsets[p], windows, h[anchor], context


def _pieces(offsets: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(row, start, end) of the texts of a pack, longer ones cut into overlapping pieces."""
    out = []
    for i in range(len(offsets) - 1):
        n = int(offsets[i + 1] - offsets[i])
        if n >= length:
            out += [(i, s, min(n, s + PIECE + length - 1)) for s in range(0, max(1, n - length + 1), PIECE)]
    return out


def _pack_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of all texts of a pack: row, first window, windows, anchor, context."""
    found: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, int]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            ends = np.concatenate([[0], np.cumsum([e - s for _, s, e in group])])
            first, last = group[0], group[-1]
            whole = all(b[0] == a[0] + 1 and b[1] == 0 for a, b in zip(group, group[1:], strict=False)) and all(e == offsets[i + 1] - offsets[i] for i, _, e in group) and first[1] == 0
            joined = data[offsets[first[0]] : offsets[last[0] + 1]] if whole else np.concatenate([data[offsets[i] + s : offsets[i] + e] for i, s, e in group])
            piece, at, windows, anchor, context = anchor_runs(joined, ends, length)
            rows, starts = np.array([g[0] for g in group]), np.array([g[1] for g in group])
            found.append((rows[piece], at + starts[piece], windows, anchor, context))
            group.clear()
            size = 0

    for g in _pieces(offsets, length):
        if group and size + g[2] - g[1] > CHUNK:
            flush()
        group.append(g)
        size += g[2] - g[1]
    flush()
    if not found:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one compressed value."""
    return zstandard.compress(np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unblob(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _groups(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``key`` with its places, in their order."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cuts) if len(key) else []:
        yield int(key[part[0]]), part


def least_owners(windows: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each row of bytes, and whether an equal row has a smaller owner.

    Bytes are compared with those of the smallest owner under a hash; a row that only shares the hash is not decided.
    """
    n, width = windows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = windows
    h = np.zeros(n, np.uint64)
    for word in padded.view("<u8").T:
        h = _mixed((h ^ word) * np.uint64(_BASE))
    order = np.lexsort((owners, h))
    new = np.ones(n, bool)
    new[1:] = h[order][1:] != h[order][:-1]
    least = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    larger = np.zeros(n, bool)
    larger[order] = (owners[order] > owners[least]) & (windows[order] == windows[least]).all(axis=1)
    return h, larger


def _part_of(rid: np.ndarray, parts: int) -> np.ndarray:
    return ((rid.view(np.uint64) >> np.uint64(1)) % np.uint64(parts)).astype(np.int64)


def _mask_digest(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, maximal removed runs and the digest of what is left."""
    n = len(data)
    if not len(starts):
        return 0, 0, hashlib.sha256(data).hexdigest()
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + lengths, n), -1)
    gone = np.cumsum(change[:n]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` for every row; shards of about ``shard_bytes`` are sorted."""
    spark = docs.sparkSession
    small_batches(spark)
    t = F.coalesce(F.col(text), F.lit(""))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts, shards = max(1, -(-total // PART_BYTES)), max(1, -(-total // shard_bytes))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(int(_LAST))).alias("did"),
        F.xxhash64(F.col(key), t).alias("rid"), t.cast("binary").alias("text"),
    )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs by shard, pre-aggregated in a pack; what the pack settles goes with them. Runs: tag, context (48 bits), first window, windows, document."""

        def sent(dids: np.ndarray, rids: np.ndarray, texts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            found, base = [], 0
            for data, offsets in texts:
                r = _pack_runs(data, offsets, length)
                found.append((r[0] + base, *r[1:]))
                base += len(offsets) - 1
            row, at, windows, anchor, context = (np.concatenate(c) for c in zip(*found, strict=True))
            context &= np.uint64((1 << 48) - 1)
            order = np.lexsort((dids[row], context, anchor))
            new = np.ones(len(order), bool)
            new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (context[order][1:] != context[order][:-1])
            least = dids[row[order]][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else np.empty(0, np.int64)
            settled = order[dids[row[order]] > least]
            open_ = np.ones(len(row), bool)
            open_[settled] = False
            settled = np.sort(settled)
            shard = ((anchor >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
            out = []
            for s, k in _groups(shard[open_]):
                k = np.flatnonzero(open_)[k]
                docs_, n = np.unique(row[k], return_counts=True)
                blob = _blob(anchor[k].astype(np.uint32)) + b""
                step = np.diff(at[k], prepend=0)
                body = _blob(context[k].astype("<u4"), (context[k] >> np.uint64(32)).astype("<u2"), step.astype("<i4"), windows[k].astype("u1"))
                head = _blob(dids[docs_], rids[docs_], n.astype("<i4"))
                out.append((s, len(blob), len(body), blob + body + head))
            if len(settled):
                out.append((int(rids[0].view(np.uint64) % np.uint64(shards)), 0, 0, _blob(rids[row[settled]], at[settled].astype("<i4"), (windows[settled] + length - 1).astype("<i4"))))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)] if out else [pa.array([], k) for k in (pa.int32(), pa.int32(), pa.int32(), pa.binary())], names=["shard", "a", "b", "blob"])

        held: list = []
        size = 0
        for batch in batches:
            for part, data, offsets in packs(batch, "text", PACK):
                piece = batch.slice(part.start, part.stop - part.start)
                held.append((piece.column("did").to_numpy(), piece.column("rid").to_numpy(), (data, offsets)))
                size += len(data)
                if size >= PACK:
                    yield sent(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [h[2] for h in held])
                    held, size = [], 0
        if held:
            yield sent(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [h[2] for h in held])

    def settle(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard of anchors: larger ids with a context that a smaller id has; contexts that must be sorted."""
        tags, contexts, firsts, counts, owners, names, passed = [], [], [], [], [], [], []
        shard = 0
        for batch in batches:
            for s, a, b, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "a", "b", "blob")), strict=True):
                shard = s
                if not a:
                    passed.append(_unblob(blob, "<i8", "<i4", "<i4"))
                    continue
                (tag,) = _unblob(blob[:a], "<u4")
                low, high, step, windows = _unblob(blob[a : a + b], "<u4", "<u2", "<i4", "u1")
                dids, rids, n = _unblob(blob[a + b :], "<i8", "<i8", "<i4")
                tags.append(tag)
                contexts.append(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)))
                firsts.append(np.cumsum(step, dtype=np.int64))
                counts.append(windows.astype(np.int64))
                owners.append(np.repeat(dids, n))
                names.append(np.repeat(rids, n))
        rid_s, at_s, len_s = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (list(zip(*passed, strict=True)) or [[], [], []]))
        ask = spread = np.empty(0, np.int64)
        if tags:
            tag, context, first, windows, did, rid = (np.concatenate(c) for c in (tags, contexts, firsts, counts, owners, names))
            order = np.lexsort((did, context, tag))
            tag, context, first, windows, did, rid = (c[order] for c in (tag, context, first, windows, did, rid))
            k = np.arange(len(tag))
            new_tag = np.concatenate([[True], tag[1:] != tag[:-1]])
            new = new_tag | np.concatenate([[True], context[1:] != context[:-1]])
            settled = did > did[np.maximum.accumulate(np.where(new, k, 0))]
            rid_s, at_s, len_s = np.concatenate([rid_s, rid[settled]]), np.concatenate([at_s, first[settled]]), np.concatenate([len_s, windows[settled] + length - 1])
            # an anchor's contexts are sorted if there are several, in several documents
            starts = np.flatnonzero(new_tag)
            n = np.diff(np.append(starts, len(tag)))
            several = (np.add.reduceat(new.astype(np.int64), starts) > 1) & (np.minimum.reduceat(did, starts) != np.maximum.reduceat(did, starts))
            open_ = np.repeat(several, n) & ~settled
            ask = np.flatnonzero(open_)
            # into how many shards an anchor's windows are split: 1 leaves its contexts whole
            whole = np.add.reduceat(np.where(open_, windows + length - 1, 0), starts)
            apart = np.add.reduceat(np.where(open_, windows * length, 0), starts)
            spread = np.repeat(np.where(whole > shard_bytes, -(-apart // shard_bytes), 1), n)
        out = []
        by_part = [dict(_groups(_part_of(r, parts))) for r in (rid_s, rid[ask] if len(ask) else np.empty(0, np.int64))]
        for p in by_part[0].keys() | by_part[1].keys():
            i, j = by_part[0].get(p), by_part[1].get(p)
            gone = _blob(rid_s[i], at_s[i].astype("<i4"), len_s[i].astype("<i4")) if i is not None else None
            want = None
            if j is not None:
                j = ask[j]
                want = _blob(rid[j], did[j], first[j].astype("<i4"), windows[j].astype("u1"), spread[j].astype("<i4"))
            out.append((p, shard, gone, want))
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], k) for c, k in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "shard", "gone", "want"])

    settled = written(rows.mapInArrow(runs, "shard int, a int, b int, blob binary").groupBy("shard").applyInArrow(settle, "part int, shard int, gone binary, want binary"), "repeats-settled")
    clean_memory(spark)

    def digest(did_key, n_bytes, removed, spans, sha):  # noqa: ANN001, ANN202
        return pa.array(did_key, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())

    def fetch(_: tuple, texts: pa.Table, asked: pa.Table) -> pa.Table:
        """One part of the documents: finished rows, rows that wait for sorted shards, and the contexts those shards need."""
        gone = [_unblob(b, "<i8", "<i4", "<i4") for b in asked.column("gone").to_pylist() if b]
        g_rid, g_at, g_len = (np.concatenate(c) for c in zip(*gone, strict=True)) if gone else (np.empty(0, np.int64),) * 3
        want = [(s, *_unblob(b, "<i8", "<i8", "<i4", "u1", "<i4")) for s, b in zip(asked.column("shard").to_pylist(), asked.column("want").to_pylist(), strict=True) if b]
        doc_ids, rids, data = texts.column("doc_id").to_pylist(), texts.column("rid").to_numpy(), texts.column("text").to_pylist()
        waiting = {int(r) for w in want for r in np.unique(w[1])}
        where = {int(r): i for i, r in enumerate(rids)}
        sent: list[tuple[int, bytes, bytes]] = []
        for s, rid, did, first, windows, spread in want:
            windows = windows.astype(np.int64)

            def bytes_of(k: np.ndarray, rid=rid, first=first, windows=windows) -> bytes:  # noqa: ANN001
                return b"".join(data[where[r]][f : f + n] for r, f, n in zip(rid[k].tolist(), first[k].tolist(), (windows[k] + length - 1).tolist(), strict=True))

            k = np.flatnonzero(spread == 1)
            if len(k):
                sent.append((s, _blob(rid[k], did[k], first[k], windows[k].astype("u1")), bytes_of(k)))
            k = np.flatnonzero(spread > 1)
            for k in np.split(k, np.flatnonzero(np.diff(np.cumsum(windows[k]) // SPLIT_WINDOWS)) + 1) if len(k) else []:
                n = windows[k]
                run = np.repeat(np.arange(len(k)), n)
                inner = np.arange(len(run)) - (np.cumsum(n) - n)[run]
                begin = np.cumsum(n + length - 1) - (n + length - 1)
                rows_of = np.lib.stride_tricks.sliding_window_view(np.frombuffer(bytes_of(k), np.uint8), length)[begin[run] + inner]
                w_rid, w_did, w_at = rid[k][run], did[k][run], first[k][run].astype(np.int64) + inner
                h, larger = least_owners(rows_of, w_did)
                g_rid, g_at, g_len = np.append(g_rid, w_rid[larger]), np.append(g_at, w_at[larger]), np.append(g_len, np.full(larger.sum(), length))
                kept = np.flatnonzero(~larger)
                place = (s + (h[kept] % spread[k][run][kept].astype(np.uint64)).astype(np.int64)) % shards
                for p, m in _groups(place):
                    m = kept[m]
                    sent.append((p, _blob(w_rid[m], w_did[m], w_at[m].astype("<i4"), np.ones(len(m), "u1")), rows_of[m].tobytes()))
        order = np.argsort(g_rid, kind="stable")
        g_rid, g_at, g_len = g_rid[order], g_at[order].astype(np.int64), g_len[order].astype(np.int64)
        rows_: list[tuple] = []
        for i, r in enumerate(rids):
            lo, hi = np.searchsorted(g_rid, r), np.searchsorted(g_rid, r, "right")
            if int(r) in waiting:
                rows_.append((1, 0, doc_ids[i], int(r), None, None, None, None, _blob(g_at[lo:hi], g_len[lo:hi]), zstandard.compress(data[i], 1)))
            else:
                removed, spans, sha = _mask_digest(data[i], g_at[lo:hi], g_len[lo:hi])
                rows_.append((0, 0, doc_ids[i], int(r), len(data[i]), removed, spans, sha, None, None))
        part = int(_part_of(rids[:1], parts)[0]) if len(rids) else 0
        rows_ = [(k, part, *rest) for k, _, *rest in rows_]
        rows_ += [(2, s, None, None, None, None, None, None, head, zstandard.compress(body, 1)) for s, head, body in sent]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[c] for r in rows_], k) for c, k in enumerate(kinds)], names=["kind", "place", "doc_id", "rid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "head", "body"])

    text_parts = rows.select((F.shiftrightunsigned("rid", 1) % parts).cast("int").alias("part"), "doc_id", "rid", "text")
    found = written(
        text_parts.groupBy("part").cogroup(settled.groupBy("part")).applyInArrow(fetch, "kind int, place int, doc_id bigint, rid bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, head binary, body binary"),
        "repeats-found", ("kind",),
    )
    discard(settled)
    clean_memory(spark)

    def sort_shard(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Suffix sort a shard's contexts; windows that a smaller id has, by part of the documents."""
        heads, bodies = [], []
        for batch in batches:
            for h, b in zip(batch.column("head").to_pylist(), batch.column("body").to_pylist(), strict=True):
                heads.append(_unblob(h, "<i8", "<i8", "<i4", "u1"))
                bodies.append(zstandard.decompress(b))
        rid, did, first, windows = (np.concatenate(c) for c in zip(*heads, strict=True))
        windows = windows.astype(np.int64)
        text_ = np.frombuffer(b"".join(bodies), np.uint8)
        begin = np.concatenate([[0], np.cumsum(windows + length - 1)[:-1]])
        which = np.repeat(np.arange(len(windows)), windows)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = repeated_windows(text_, begin[which] + inner, did[which], length)
        w, i = which[hit], inner[hit]
        # windows next to each other make one stretch
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (i[1:] != i[:-1] + 1)
        s = np.flatnonzero(new)
        n = np.diff(np.append(s, len(w))) + length - 1
        out_rid, out_at = rid[w[s]], first[w[s]] + i[s]
        out = [(p, _blob(out_rid[k], out_at[k].astype("<i4"), n[k].astype("<i4"))) for p, k in _groups(_part_of(out_rid, parts))]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["part", "gone"])

    sorted_ = found.where("kind = 2").select(F.col("place").alias("shard"), "head", "body").groupBy("shard").applyInArrow(sort_shard, "part int, gone binary")

    def finish(_: tuple, texts: pa.Table, more: pa.Table) -> pa.Table:
        gone = [_unblob(b, "<i8", "<i4", "<i4") for b in more.column("gone").to_pylist() if b]
        g_rid, g_at, g_len = (np.concatenate(c) for c in zip(*gone, strict=True)) if gone else (np.empty(0, np.int64),) * 3
        order = np.argsort(g_rid, kind="stable")
        g_rid, g_at, g_len = g_rid[order], g_at[order].astype(np.int64), g_len[order].astype(np.int64)
        out = []
        for d, r, h, b in zip(*(texts.column(c).to_pylist() for c in ("doc_id", "rid", "head", "body")), strict=True):
            lo, hi = np.searchsorted(g_rid, r), np.searchsorted(g_rid, r, "right")
            at, n = _unblob(h, "<i8", "<i8")
            data = zstandard.decompress(b)
            out.append((d, len(data), *_mask_digest(data, np.concatenate([at, g_at[lo:hi]]), np.concatenate([n, g_len[lo:hi]]))))
        return pa.table(list(digest(*([o[c] for o in out] for c in range(5)))), names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    waiting = found.where("kind = 1").select(F.col("place").alias("part"), "doc_id", "rid", "head", "body")
    finished = waiting.groupBy("part").cogroup(sorted_.groupBy("part")).applyInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    done = found.where("kind = 0").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return done.unionByName(finished).withColumnRenamed("doc_id", key)
