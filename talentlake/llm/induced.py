"""Suffix array and longest common prefixes by induced sorting with disk-backed queues.

The order of the leftmost S-type suffixes (LMS) is found first: their substrings are sorted by one
round of induction, named, and the string of names is sorted by recursion (by prefix doubling once
the alphabet is larger than ``MAX_ALPHABET``).  Then all suffixes are induced: an ascending pass puts
the L-type, a descending one the S-type suffixes in order.

The priority queue of a pass is one first-in first-out run for each character, since sources are
visited in rank order.  Entries are (position, common prefix with the entry before); the common
prefix is 1 + the least one between the two sources, kept as a running minimum for each character.
Queues larger than ``memory`` bytes go to an unlinked temporary file of the task, like Spark's own
spill files, and are read back run by run.

Characters are handled in whole buckets with numpy.  Separators are 0 in the text; they are
pairwise different and in the order of their positions, so that no prefix crosses one.
"""

from __future__ import annotations

import tempfile

import numpy as np

MAX_ALPHABET = 2048


class RunQueue:
    """A first-in first-out run of (position, lcp) arrays for each character; large ones lie on disk."""

    def __init__(self, sigma: int, memory: int):
        self.runs: list[list] = [[] for _ in range(sigma)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.runs[c].append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for run in self.runs:
            for i, part in enumerate(run):
                if len(part) == 2:
                    pos, lcp = part
                    at = self.file.tell()
                    self.file.write(pos.tobytes() + lcp.tobytes())
                    run[i] = (at, len(pos), pos.dtype, lcp.dtype)
        self.held = 0

    def pop(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        got = []
        for part in self.runs[c]:
            if len(part) == 4:
                at, n, kind, small = part
                self.file.seek(at)
                raw = self.file.read(n * (kind.itemsize + small.itemsize))
                got.append((np.frombuffer(raw, kind, n), np.frombuffer(raw, small, n, n * kind.itemsize)))
            else:
                self.held -= part[0].nbytes + part[1].nbytes
                got.append(part)
        self.runs[c] = []
        if not got:
            return np.zeros(0, np.int32), np.zeros(0, np.uint16)
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


class _Pass:
    """Induction of one type: sources come in rank order, their left neighbours go to the queues."""

    def __init__(self, text: np.ndarray, sigma: int, cap: int, memory: int):
        self.text, self.cap = text, cap
        self.queue = RunQueue(sigma, memory)
        self.least = np.full(sigma, cap, np.uint16)  # least lcp of sources since the last entry
        self.begun = np.zeros(sigma, bool)

    def feed(self, src: np.ndarray, lcp: np.ndarray, wanted, stay: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Queue the left neighbours that ``wanted(char)`` takes; those of character ``stay`` are returned."""
        here = (np.zeros(0, np.int32), np.zeros(0, np.uint16))
        if not len(src):
            return here
        left = src - 1
        ch = self.text[left]  # left -1 reads the last character, a separator
        take = np.flatnonzero((left >= 0) & wanted(ch))
        chars = ch[take]
        order = np.argsort(chars, kind="stable")
        chars, take = chars[order], take[order]
        first = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]])) if len(take) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(take))
        low = lcp.min()
        untouched = np.ones(len(self.least), bool)
        for lo, hi in zip(first, ends):
            c, at = int(chars[lo]), take[lo:hi]
            untouched[c] = False
            # least lcp in (previous entry of the character, this one]
            cuts = np.concatenate([[0], at[:-1] + 1])
            mins = np.minimum.reduceat(lcp[:at[-1] + 1], cuts)
            mins[0] = min(mins[0], self.least[c])
            new = np.minimum(mins + 1, self.cap).astype(np.uint16)
            if not self.begun[c]:
                new[0], self.begun[c] = 0, True
            rest = lcp[at[-1] + 1:]
            self.least[c] = rest.min() if len(rest) else self.cap
            if c == stay:
                here = (left[at], new)
            else:
                self.queue.push(c, left[at], new)
        np.minimum(self.least, low, out=self.least, where=untouched)
        return here


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type (smaller than the next); separators are S."""
    n = len(text)
    up, level = np.ones(n, bool), np.zeros(n, bool)
    np.greater(text[1:], text[:-1], out=up[:-1])
    np.equal(text[1:], text[:-1], out=level[:-1])
    up[text == 0], level[text == 0] = True, False
    # an equal neighbour takes the type to its right
    at = np.where(level, np.int32(n), np.arange(n, dtype=np.int32))
    return up[np.minimum.accumulate(at[::-1])[::-1]]


def _runs(text: np.ndarray) -> np.ndarray:
    """Length of the run of equal characters that starts at each position."""
    n = len(text)
    at = np.arange(n, dtype=np.int32)
    last = np.where(np.concatenate([text[1:] != text[:-1], [True]]), at, np.int32(n))
    return np.minimum.accumulate(last[::-1])[::-1] - at + 1


def _induce(text: np.ndarray, sigma: int, lms: np.ndarray, lms_lcp: np.ndarray, cap: int, memory: int):
    """All suffixes in order with their lcp, from sorted LMS suffixes (separators first)."""
    run = np.minimum(_runs(text), cap).astype(np.uint16)
    bounds = np.searchsorted(text[lms], np.arange(sigma + 1))
    big, small, large = [None] * sigma, [None] * sigma, _Pass(text, sigma, cap, memory)
    cat = lambda parts: tuple(np.concatenate(p) for p in zip(*parts))
    for c in range(sigma):
        cur, got = large.queue.pop(c), []
        while len(cur[0]):
            got.append(cur)
            cur = large.feed(*cur, lambda ch: ch >= c, stay=c)
        big[c] = cat(got) if got else (np.zeros(0, np.int32), np.zeros(0, np.uint16))
        own, low = lms[bounds[c]:bounds[c + 1]], lms_lcp[bounds[c]:bounds[c + 1]].copy()
        if len(own):
            # the last L and the first S suffix of a bucket share the shorter run of its character
            low[0] = min(run[big[c][0][-1]], run[own[0]]) if len(big[c][0]) else 0
            large.feed(own, low, lambda ch: ch > c)
    less = _Pass(text, sigma, cap, memory)
    for c in range(sigma - 1, 0, -1):
        cur, got = less.queue.pop(c), []
        while len(cur[0]):
            got.append(cur)
            cur = less.feed(*cur, lambda ch: (ch <= c) & (ch > 0), stay=c)
        pos, low = cat(got) if got else (np.zeros(0, np.int32), np.zeros(0, np.uint16))
        small[c] = (pos, low)
        p, q = big[c]
        if len(p):
            # downwards: an entry's lcp is that with the entry above it
            down = np.concatenate([[0], q[:0:-1]]).astype(np.uint16)
            if len(pos):
                down[0] = min(run[pos[-1]], run[p[-1]])
            less.feed(p[::-1], down, lambda ch: (ch < c) & (ch > 0))
    out = [(lms[:bounds[1]], np.zeros(bounds[1], np.uint16))]
    for c in range(1, sigma):
        p, q = big[c]
        s, d = small[c]
        out.append((p, q))
        if len(s):
            up = np.concatenate([[0], d[:0:-1]]).astype(np.uint16)
            if len(p):
                up[0] = min(run[p[-1]], run[s[-1]])
            out.append((s[::-1], up))
    return tuple(np.concatenate(x) for x in zip(*out))


def _doubling(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``names`` and the lcp of neighbours in names, by prefix doubling."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    history, h = [rank], 1
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        if n < 2 or (sorted_rank[1:] != sorted_rank[:-1]).all():
            break
        nxt = np.zeros(n, np.int64)
        nxt[:n - h] = rank[h:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        history.append(rank)
        h *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(0, n - 1), np.int64)
    for j in range(len(history) - 2, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = history[j][a[inside]] == history[j][b[inside]]
        step = same * (1 << j)
        a, b, common = a + step, b + step, common + step
    return order, np.concatenate([[0], common]) if n else common


def suffix_array(text: np.ndarray, sigma: int, cap: int, memory: int = 64 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(positions in order, lcp with the one before, at most ``cap``) of a text that ends in 0."""
    n = len(text)
    stype = _types(text)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = stype[1:] & ~stype[:-1]
    is_lms[text == 0] = True
    lms = np.flatnonzero(is_lms).astype(np.int32)  # a text is at most 2 GB
    del stype
    ends = text[lms] == 0
    by_char = lms[np.argsort(text[lms], kind="stable")]
    # sort the LMS substrings: one induction from LMS suffixes sorted by their first character
    order, _ = _induce(text, sigma, by_char, np.zeros(len(lms), np.uint16), cap, memory)
    ranked = order[is_lms[order]]
    # names: equal substrings (up to and with the next LMS position) get one name
    nth = np.zeros(n + 1, np.int32)
    nth[lms] = np.arange(len(lms))
    length = np.append(np.diff(lms), 0) + 1
    a, b = ranked[:-1], ranked[1:]
    la, lb = length[nth[a]], length[nth[b]]
    differ = (la != lb) | (text[a] == 0) | (text[b] == 0)
    active, t = np.flatnonzero(~differ), 0
    while len(active):
        unequal = text[a[active] + t] != text[b[active] + t]
        differ[active[unequal]] = True
        # a substring that ends at a separator is its own: separators are pairwise different
        sep = ~unequal & (text[a[active] + t] == 0)
        differ[active[sep]] = True
        t += 1
        active = active[~unequal & ~sep & (la[active] > t)]
    names = np.empty(len(lms), np.int64)
    names[nth[ranked]] = np.concatenate([[0], np.cumsum(differ)])
    # separators are names 0, 1, ... in order; in the string of names they are separators again
    shorter = np.where(ends, 0, names - ends.sum() + 1)
    if names.max() + 1 < len(names) and shorter.max() < MAX_ALPHABET:
        low, common = suffix_array(shorter, int(shorter.max()) + 1, cap, memory)
        common = common.astype(np.int64)
    else:
        low, common = _doubling(names, cap)
    order = lms[low]
    # lcp in characters: the equal names, then character by character in the first that differ
    lcp = np.zeros(len(lms), np.int64)
    if len(lms) > 1:
        nxt = np.append(lms, n)
        i, j = np.minimum(low[:-1] + common[1:], len(lms)), np.minimum(low[1:] + common[1:], len(lms))
        got = nxt[i] - order[:-1]
        x, y = nxt[i].copy(), nxt[j].copy()
        active = np.flatnonzero((x < n) & (y < n) & (got < cap))
        while len(active):
            same = (text[x[active]] == text[y[active]]) & (text[x[active]] != 0)
            active = active[same]
            x[active] += 1
            y[active] += 1
            got[active] += 1
            active = active[(x[active] < n) & (y[active] < n) & (got[active] < cap)]
        lcp[1:] = np.minimum(got, cap)
    first = np.argsort(text[order], kind="stable")  # already in order but for separators, which are first
    order, lcp = order[first], lcp[first].astype(np.uint16)
    return _induce(text, sigma, order, lcp, cap, memory)
