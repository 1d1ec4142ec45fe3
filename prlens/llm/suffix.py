"""Suffix sorting by induced sorting with spillable bucket queues.

The order of the suffixes at left-most S positions is found first (by naming the substrings between them and
sorting tuples of names recursively, each round doubling the names a tuple covers), and induces the order of all
other suffixes: a first sweep from the smallest character up places L suffixes, a second from the largest down
places S suffixes. Sweeps work on whole buckets: a bucket's entries wait in a priority queue that is ordered by
character, and first in first out within one, since predecessors arrive in the order of their successors. The
queues move to disk when they outgrow their share of memory.
"""

from __future__ import annotations

import tempfile

import numpy as np


class BucketQueue:
    """A priority queue of (character, position) for arrivals that are in order within a character, kept on disk beyond ``budget`` bytes."""

    def __init__(self, budget: int = 128 << 20):
        self.budget, self.held, self.file = budget, 0, None
        self.buckets: dict[int, list] = {}

    def push(self, chars: np.ndarray, positions: np.ndarray) -> None:
        """Add positions at the ends of their characters' buckets, in the order given."""
        if not len(chars):
            return
        order = np.argsort(chars, kind="stable")
        chars, positions = chars[order], positions[order]
        cuts = np.flatnonzero(np.diff(chars)) + 1
        for part, first in zip(np.split(positions, cuts), np.concatenate([[0], cuts]), strict=True):
            self.buckets.setdefault(int(chars[first]), []).append(part)
        self.held += positions.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115  scratch of this task; it goes with the handle
        for c, parts in self.buckets.items():
            whole = [p for p in parts if isinstance(p, np.ndarray)]
            if whole:
                rows = np.concatenate(whole)
                at = self.file.seek(0, 2)
                rows.tofile(self.file)
                self.buckets[c] = [p for p in parts if not isinstance(p, np.ndarray)] + [(at, len(rows), rows.dtype)]
        self.held = 0

    def pop(self, c: int) -> np.ndarray | None:
        """All that waits for a character, in order of arrival."""
        parts = self.buckets.pop(c, None)
        if not parts:
            return None
        out = []
        for p in parts:
            if isinstance(p, tuple):
                self.file.seek(p[0])
                out.append(np.fromfile(self.file, p[2], p[1]))
            else:
                self.held -= p.nbytes
                out.append(p)
        return out[0] if len(out) == 1 else np.concatenate(out)


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S (smaller than its successor); the last, a sentinel, is."""
    n = len(s)
    change = np.flatnonzero(s[:-1] != s[1:])
    value = np.zeros(n, bool)
    value[change] = s[change] < s[change + 1]
    value[n - 1] = True
    ends = np.append(change, n - 1)
    return np.repeat(value[ends], np.diff(np.concatenate([[-1], ends])))


def _induce(s: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, budget: int) -> np.ndarray:
    """The suffix order that LMS suffixes in the order ``seeds`` induce."""
    chars = np.unique(s)
    waiting = BucketQueue(budget)
    by_char = BucketQueue(budget)
    by_char.push(s[seeds], seeds)
    placed_l: dict[int, list[np.ndarray]] = {}

    def before(cur: np.ndarray, want_s: bool) -> np.ndarray:
        prev = cur[cur > 0] - 1
        return prev[is_s[prev] == want_s]

    for c in chars.tolist():
        placed = []
        while (cur := waiting.pop(c)) is not None:
            placed.append(cur)
            prev = before(cur, False)
            waiting.push(s[prev], prev)
        placed_l[c] = placed
        if (cur := by_char.pop(c)) is not None:
            prev = before(cur, False)
            waiting.push(s[prev], prev)
    waiting = BucketQueue(budget)
    order: list[np.ndarray] = []
    n = len(s)
    for c in chars[::-1].tolist():
        down = []
        if c == s[n - 1]:
            waiting.push(s[n - 1 :], np.array([n - 1], seeds.dtype))
        while (cur := waiting.pop(c)) is not None:
            down.append(cur)
            prev = before(cur, True)
            waiting.push(s[prev], prev)
        ups = placed_l.pop(c)
        for cur in ups[::-1]:
            prev = before(cur[::-1], True)
            waiting.push(s[prev], prev)
        order += down + [u[::-1] for u in ups[::-1]]
    return np.concatenate(order)[::-1]


def suffix_order(text: np.ndarray, depth: int = 50, budget: int = 128 << 20) -> np.ndarray:
    """Positions of a text in an order in which suffixes with equal first ``depth`` characters stand together.

    ``text``: small non-negative integers. Suffixes are sorted fully up to ``depth`` characters at least.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    s = np.empty(n + 1, np.uint16)
    s[:n] = text
    s[:n] += 1
    s[n] = 0
    is_s = _types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    lms = lms.astype(np.int32 if n < 2**31 - 2 else np.int64)
    order = _induce(s, is_s, lms, budget)
    flag = np.zeros(n + 1, bool)
    flag[lms] = True
    by_rank = order[flag[order]]
    # names of LMS substrings: neighbours in the order are compared by a hash of their characters
    power = np.full(n + 2, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    table = np.random.default_rng(5).integers(1, 2**63, int(s.max()) + 1, dtype=np.uint64)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(table[s] * power[: n + 1], dtype=np.uint64)])
    nth = np.empty(n + 1, np.int64)
    nth[lms] = np.arange(len(lms))
    k = nth[by_rank]
    start = lms[k].astype(np.int64)
    end = np.append(lms[1:], n)[k].astype(np.int64) + 1
    length = end - start
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        a, b = slice(0, -1), slice(1, None)
        late, early = np.maximum(start[a], start[b]), np.minimum(start[a], start[b])
        ha, hb = prefix[end[a]] - prefix[start[a]], prefix[end[b]] - prefix[start[b]]
        h_early, h_late = np.where(start[a] < start[b], ha, hb), np.where(start[a] < start[b], hb, ha)
        same[1:] = (length[a] == length[b]) & (h_early * power[late - early] == h_late)
    names = np.empty(len(lms), np.int64)
    names[k] = np.cumsum(~same) - 1
    names = _sorted_names(names, depth)
    return _induce(s, is_s, lms[np.argsort(names, kind="stable")], budget)[1:].astype(np.int64)


def _sorted_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names, by tuples of names; each LMS substring covers two characters at least."""
    span = 1
    while span * 2 < depth + 2 and len(names) and names.max() + 1 < len(names):
        later = np.zeros(len(names), np.int64)
        later[: max(0, len(names) - span)] = names[span:] + 1
        key = names * (int(names.max()) + 2) + later
        order = np.argsort(key, kind="stable")
        rank = np.cumsum(np.concatenate([[False], np.diff(key[order]) != 0]))
        names = np.empty(len(key), np.int64)
        names[order] = rank
        span *= 2
    return names


def repeated_windows(text: np.ndarray, starts: np.ndarray, owners: np.ndarray, length: int = 50, budget: int = 128 << 20) -> np.ndarray:
    """For windows of ``length`` bytes at ``starts`` (of positions of ``text``): whether an equal window has a smaller owner.

    The suffix order brings equal windows together; neighbours' common prefix is measured up to ``length`` bytes.
    """
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    at = np.full(len(text), -1, np.int64)
    at[starts] = np.arange(len(starts))
    order = suffix_order(text, length, budget)
    order = at[order]
    order = order[order >= 0]
    p = starts[order]
    padded = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.ndarray((len(text) + 1,), "<u8", padded.tobytes(), 0, (1,))
    same = np.ones(len(p) - 1, bool)
    for o in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        live = np.flatnonzero(same)
        same[live] = words[p[live] + o] == words[p[live + 1] + o]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(owners[order], first)
    n = np.diff(np.append(first, len(p)))
    out[order] = owners[order] > np.repeat(least, n)
    return out
