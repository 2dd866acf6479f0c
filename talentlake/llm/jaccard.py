"""N-gram Jaccard join by PartEnum signatures.

A document's set holds 64-bit hashes of its distinct 5-word shingles.  Sets of at least similarity
0.8 differ little in size and in elements: of sizes a and b, at most (a + b) / 9 elements are in one
of them only.  Sets are put into size bands (a set near the top of its band joins the next one too),
and each band divides the feature domain into groups of ``n2`` partitions:

* At most k elements differ, so at most k // (k2 + 1) groups hold more than k2 differences.  In every
  other group some ``n2 - k2`` partitions agree wholly.
* A signature is the content of one such subset of partitions; all subsets are enumerated.  Two
  similar sets share one signature.
* Empty subsets say nothing and give no signature.  A band has more groups than needed, and a set
  with too many empty ones adds signatures under further divisions (``SALTS``) until it has enough:
  of a pair, both emit the first division in which either has enough, so no pair is lost.

Candidates are not all pairs of a signature's sets.  A set of which too many shingles are in no other set has no
partner and goes first.  Every set is compared with one hub, the best known
set with which it shares most signatures; then, in rounds, sets without link are compared with neighbours in
their signatures, so that families of like sets become components before any pairs are formed.  What is left is compared where signatures hold several
components: single sets with single sets, and any set with the hubs of other components, if they meet in
as many signatures as similar sets must.  Where a signature holds many single sets, they are not paired by it, but by the
rarest shingles in which they differ from one set that has it (see ``_around``).  A set that is not like a hub can be like one of the hub's
sets only if they share a shingle that the hub lacks (or by what both have of the hub, see
``_links``), so these are joined by such shingles, and no link is lost.

Scale: equal sets are one class (a hash of all shingles).  Signatures travel as packed arrays by
bucket, not as rows; the number of buckets follows the input.  Of a signature that occurs more
than ``HOT`` times in one map batch only one set goes on to the bucket, all are recorded
at once, so a hot signature brings a few entries per map batch.  Signatures of a bucket stay grouped in packed arrays
until no more sets can be ruled out; they become rows then.

Defined results: null and empty texts have no shingle and are linked with nothing; with fewer than
five words the whole sequence is the one shingle; a null doc_id is never a component_id unless all
ids of the component are null; repeated rows are in one component.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentlake.llm.common import Scratch
from talentlake.llm.hashing import U64, SubstringHashes, mix

WORDS = 5
#: similarity as a fraction: 100 * intersection >= 80 * union
NUM, DEN = 80, 100
SALTS = 16
HOT = 64
#: rounds in which sets without link are compared with neighbours before pairs are formed
ROUNDS = 3
#: single sets of one signature up to which they are paired by it
FEW = 6
#: hashed bits, one for each set, by which rows are chosen whose texts are fetched (8 MB)
MOST_BITS = 1 << 26
#: signature entries gathered before a batch is packed, and those of a bucket on average
FLUSH, BUCKET = 2_000_000, 1_500_000
#: sets in a row of grouped signatures, and of which the signatures are counted at once
GROUPED, COUNTED = 1 << 16, 1 << 20

_U = U64
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text in order; A-Z lower-cased, words split at ASCII white space."""
    data = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    return SubstringHashes(_LOWER[data], bases=1).of(0, start, end) + (end - start).astype(_U)


def shingles(text: str | bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles."""
    if not text:
        return np.zeros(0, _U)
    ids = word_hashes(text.encode() if isinstance(text, str) else text)
    if not len(ids):
        return ids
    if len(ids) < WORDS:
        whole = np.full(1, len(ids), _U)
        for w in ids:
            whole = mix(whole * _U(0x9E3779B97F4A7C15) + w)
        return whole
    n = len(ids) - WORDS + 1
    h = ids[:n]
    for j in range(1, WORDS):
        h = mix(h * _U(0x9E3779B97F4A7C15) + ids[j:j + n])
    return np.unique(h)


def fingerprint(h: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(h.tobytes()), ">i8")[0])


class Band:
    def __init__(self, number: int, low: int, high: int):
        self.number, self.low, self.high = number, low, high
        self.k = 2 * high * (DEN - NUM) // (DEN + NUM)
        # small bands: two of three partitions; large ones: single partitions, whose signatures are fewer
        self.n2, self.k2 = (3, 1) if high <= 128 else (1, 0)
        least = self.k // (self.k2 + 1) + 1
        self.spare = 0 if not self.k else max(1, int(0.3 * least))
        self.groups = least + self.spare
        if not self.k:
            self.n2, self.k2 = 1, 0
        self.subsets = list(itertools.combinations(range(self.n2), self.n2 - self.k2))


def bands(largest: int) -> list[Band]:
    out, low = [], 1
    while low <= largest:
        top = max(low + 1, -(-low * DEN * DEN // (NUM * NUM)))
        out.append(Band(len(out), low, top - 1))
        low = top
    return out


_BANDS = bands(1 << 31)


def _of_size(n: int) -> list[Band]:
    """The band of the size, and the next one if a set there can be similar."""
    own = next(b for b in _BANDS if n <= b.high)
    return [own, _BANDS[own.number + 1]] if n * DEN >= NUM * (own.high + 1) else [own]


def signatures(h: np.ndarray) -> np.ndarray:
    """All signatures of a set (sorted hashes)."""
    out = []
    for band in _of_size(len(h)) if len(h) else ():
        parts = band.groups * band.n2
        for salt in range(SALTS):
            x = h if salt == 0 else np.sort(mix(h + _U(salt)))
            at = ((x >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sums, filled = np.zeros(parts, _U), np.zeros(parts, bool)
            sums[at[first]] = np.add.reduceat(mix(x ^ _U(0x5851F42D4C957F2D)), first)
            filled[at[first]] = True
            sums, filled = sums.reshape(-1, band.n2), filled.reshape(-1, band.n2)
            empty = np.zeros(band.groups, bool)
            seed = _U((band.number * SALTS + salt) * 64)
            for i, subset in enumerate(band.subsets):
                some = filled[:, subset].any(1)
                empty |= ~some
                keep = some if salt < SALTS - 1 else np.ones_like(some)
                name = mix(np.arange(band.groups, dtype=_U)[keep] * _U(0x9E3779B97F4A7C15) + mix(np.atleast_1d(seed + _U(i))))
                out.append(mix(sums[keep][:, subset].sum(1, dtype=_U) + name))
            if empty.sum() <= band.spare:
                break
    return np.concatenate(out) if out else np.zeros(0, _U)


def empty_groups(h: np.ndarray) -> tuple[int, int]:
    """Groups with an empty subset in the first division of the set's own band and of the next (0 without)."""
    out = [0, 0]
    for i, band in enumerate(_of_size(len(h)) if len(h) else ()):
        filled = np.zeros(band.groups * band.n2, bool)
        filled[((h >> _U(32)) * _U(len(filled)) >> _U(32)).astype(np.int64)] = True
        empty = (~filled).reshape(-1, band.n2).sum(1)
        out[i] = int((empty >= band.n2 - band.k2).sum())
    return out[0], out[1]


def least_shared(a: int, b: int, empty_a: tuple[int, int], empty_b: tuple[int, int]) -> int:
    """How many signatures similar sets of these sizes share at least; 0 if the sizes rule a link out.

    Counted in the first division of the larger set's band: all groups but those with too many
    differences agree in some subset, which is empty at most as often as either set has empty ones.
    """
    small, large = min(a, b), max(a, b)
    if DEN * small < NUM * large:
        return 0
    band = _of_size(large)[0]
    empty = min(e[0] if n >= band.low else e[1] for n, e in ((a, empty_a), (b, empty_b)))
    differ = (a + b) * (DEN - NUM) // (DEN + NUM)
    return max(1, band.groups - differ // (band.k2 + 1) - empty)


def least_of(n: int, empty: tuple[int, int]) -> int:
    """Signatures that a set of this size shares with any similar set at least."""
    if not n:
        return 0
    own, out = _of_size(n)[0], []
    for size in {min(own.high, n * DEN // NUM), n * DEN // NUM}:
        band = _of_size(size)[0]
        differ = (n + size) * (DEN - NUM) // (DEN + NUM)
        out.append(band.groups - differ // (band.k2 + 1) - empty[0 if n >= band.low else 1])
    return max(1, min(out))


# --------------------------------------------------------------------------- tables
_BAND = ["n_shingles", "empty_own", "empty_next", "low", "groups", "per_group"]
#: by which the sets of a signature are put in order, a minimum hash for each round
_ORDERS = [f"order{i}" for i in range(ROUNDS)]


def _need(x: str, y: str) -> Column:
    """``least_shared`` of the sets x and y, given as structs of ``_BAND`` and ``common`` (the shingles that other sets
    have, too); null if the sizes, or the shingles that are a set's own, rule a link out."""
    a, b = F.col(x), F.col(y)
    first = a["n_shingles"] >= b["n_shingles"]
    large, small = (lambda c: F.when(first, a[c]).otherwise(b[c])), (lambda c: F.when(first, b[c]).otherwise(a[c]))
    empty = F.least(large("empty_own"), F.when(small("n_shingles") >= large("low"), small("empty_own")).otherwise(small("empty_next")))
    differ = F.floor((a["n_shingles"] + b["n_shingles"]) * (DEN - NUM) / (DEN + NUM))
    need = F.greatest(F.lit(1), large("groups") - F.floor(differ / large("per_group")) - empty)
    room = (DEN + NUM) * F.least(a["common"], b["common"]) >= NUM * (a["n_shingles"] + b["n_shingles"])
    return F.when((DEN * small("n_shingles") >= NUM * large("n_shingles")) & room, need)


def _enough(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of sets (a, b, shared) that share as many signatures as similar sets must."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("set").alias(side), F.struct(*_BAND, "common").alias(f"band_{side}")), side)
    return pairs.filter(F.col("shared") >= _need("band_a", "band_b")).select("a", "b")


_DESCRIBED = ["doc_id", "text_key", "n_shingles", "set", "empty_own", "empty_next", "least", "low", "groups", "per_group"]
_PACKED = pa.schema([("bucket", pa.int64()), ("sigs", pa.binary()), ("sets", pa.binary()), ("counts", pa.binary()),
                     *((c, pa.int64()) for c in _DESCRIBED)])


def _packed(buckets: int, most_hot: int, most: int):
    """(doc_id, text_key, text) -> a description of every row and, for each bucket, packed signatures.

    Packed are the sets, how many signatures of each follow, and the signatures; without these numbers there is one set
    for each signature, which is hot within the task.  Buckets below 0 hold what needs no meeting: descriptions, and
    all sets of signatures that are hot within the task.
    """

    def packed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), 16):
            cols = [*zip(*rows[i:i + 16])]
            n = len(cols[0])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, f.type) for c, f in zip(cols, _PACKED)), *(pa.nulls(n, pa.int64()) for _ in _DESCRIBED)], schema=_PACKED)

    def flush(sets: list[int], sigs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        owner = np.repeat(np.array(sets, np.int64), [len(s) for s in sigs])
        sig = np.concatenate(sigs)
        # hot here: one set goes on, the others are recorded with it at once
        order = np.argsort(sig, kind="stable")
        sig, owner = sig[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(first, len(sig)))
        hot = np.repeat(size > most_hot, size)
        rows = []
        if hot.any():
            rows.append((-1 - int(sig[hot][0] % _U(buckets)), sig[hot].tobytes(), owner[hot].tobytes(), b""))
            one = first[size > most_hot]
            bucket = (sig[one] % _U(buckets)).astype(np.int64)
            for b in np.unique(bucket):
                rows.append((int(b), sig[one[bucket == b]].tobytes(), owner[one[bucket == b]].tobytes(), b""))
            sig, owner = sig[~hot], owner[~hot]
        bucket = (sig % _U(buckets)).astype(np.int64)
        order = np.lexsort((owner, bucket))
        sig, owner, bucket = sig[order], owner[order], bucket[order]
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in range(buckets):
            lo, hi = ends[b], ends[b + 1]
            if lo < hi:
                names, counts = np.unique(owner[lo:hi], return_counts=True)
                rows.append((b, sig[lo:hi].tobytes(), names.tobytes(), counts.astype("<u4").tobytes()))
        yield from packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, sigs, total, seen = [], [], 0, set()
        for batch in batches:
            described = []
            for doc, key, t in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text")):
                h = shingles(t.as_py())
                name = fingerprint(h) if len(h) else None
                empty = empty_groups(h)
                band = _of_size(max(1, len(h)))[0]
                described.append((-1 - (key + (doc or 0)) % buckets, doc, key, len(h), name, *empty, least_of(len(h), empty), band.low, band.groups, band.k2 + 1))
                if name is None or name in seen:  # copies within the task
                    continue
                seen.add(name)
                if len(seen) > 1_000_000:
                    seen.clear()
                sigs.append(signatures(h))
                sets.append(name)
                total += len(sigs[-1])
                if total >= most:
                    yield from flush(sets, sigs)
                    sets, sigs, total = [], [], 0
            if described:
                cols = [pa.array(c, pa.int64()) for c in zip(*described)]
                none = [pa.nulls(len(described), pa.binary())] * 3
                yield pa.RecordBatch.from_arrays([cols[0], *none, *cols[1:]], schema=_PACKED)
        if sets:
            yield from flush(sets, sigs)

    return run


_OUT = pa.schema([("kind", pa.int64()), *((c, pa.int64()) for c in "abcdefghij"), *((c, pa.binary()) for c in ("sigs", "sizes", "sets"))])


def _out(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _OUT], schema=_OUT)


def _hot_rows(sig: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    return _out(len(sig), kind=pa.array(np.full(len(sig), 2)), a=pa.array(sig.view(np.int64)), b=pa.array(owner))


def _groups(sigs: np.ndarray, sizes: np.ndarray, sets: np.ndarray) -> Iterator[tuple[bytes, bytes, bytes]]:
    """Signatures, how many sets each has, and the sets, in whole signatures of some ``GROUPED`` sets."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    lo = 0
    while lo < len(sigs):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + GROUPED, "right")) - 1)
        yield sigs[lo:hi].tobytes(), sizes[lo:hi].astype("<u4").tobytes(), sets[ends[lo]:ends[hi]].tobytes()
        lo = hi


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(signatures, sizes, sets) of each row of ``_groups``."""
    for sigs, sizes, sets in zip(*(batch.column(c) for c in ("sigs", "sizes", "sets"))):
        yield np.frombuffer(sigs.as_py(), _U), np.frombuffer(sizes.as_py(), "<u4").astype(np.int64), np.frombuffer(sets.as_py(), np.int64)


def _met_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All packed rows of one bucket -> kind 0: groups of signatures that two sets have at least; kind 1: descriptions;
    kind 2: (signature, set), all rows of signatures that were hot in some task, which may repeat."""
    sig, owner, hot = [], [], [np.zeros(0, _U)]
    for batch in batches:
        b = batch.filter(batch.column("sigs").is_null())
        if b.num_rows:
            yield _out(b.num_rows, kind=pa.array(np.ones(b.num_rows, np.int64)), **{x: b.column(c) for x, c in zip("abcdefghij", _DESCRIBED)})
        for bucket, s, names, counts in zip(*(batch.column(c) for c in ("bucket", "sigs", "sets", "counts"))):
            if not s.is_valid:
                continue
            s, names, counts = np.frombuffer(s.as_py(), _U), np.frombuffer(names.as_py(), np.int64), np.frombuffer(counts.as_py(), "<u4")
            if bucket.as_py() < 0:
                yield _hot_rows(s, names)
            else:
                sig.append(s)
                owner.append(np.repeat(names, counts) if len(counts) else names)
                if not len(counts):
                    hot.append(s)
    if sig:
        sig, owner = np.concatenate(sig), np.concatenate(owner)
        order = np.lexsort((owner, sig))
        sig, owner = sig[order], owner[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])])  # copies of other tasks
        sig, owner = sig[new], owner[new]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(first, len(sig)))
        warm = np.isin(sig[first], np.concatenate(hot))
        at = np.repeat(warm, size)
        if at.any():
            yield _hot_rows(sig[at], owner[at])
        keep = (size > 1) & ~warm
        at = np.repeat(keep, size)
        rows = [*zip(*_groups(sig[first[keep]], size[keep], owner[at]))]
        if rows:
            n = len(rows[0])
            yield _out(n, kind=pa.array(np.zeros(n, np.int64)), **{c: pa.array(x, pa.binary()) for c, x in zip(("sigs", "sizes", "sets"), rows)})


_OWN = pa.schema([("bucket", pa.int64()), ("shingles", pa.binary()), ("sets", pa.binary()), ("counts", pa.binary()), ("set", pa.int64()),
                  *((c, pa.int64()) for c in _ORDERS)])


def _shingles_by_bucket(buckets: int, most: int):
    """(set, text) -> packed 32-bit shingle hashes with their sets by bucket, and (buckets below 0) a set's order keys."""

    def flush(sets: list[int], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        owner, h = np.repeat(np.array(sets, np.int64), [len(x) for x in found]), np.concatenate(found)
        bucket = (h.astype(_U) * _U(buckets) >> _U(32)).astype(np.int64)
        order = np.lexsort((owner, bucket))
        h, owner, bucket = h[order], owner[order], bucket[order]
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(ends)):
            lo, hi = ends[b], ends[b + 1]
            names, counts = np.unique(owner[lo:hi], return_counts=True)
            rows.append((int(b), h[lo:hi].tobytes(), names.tobytes(), counts.astype("<u4").tobytes()))
        for i in range(0, len(rows), 16):
            cols = [*zip(*rows[i:i + 16])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, _OWN)),
                                              *(pa.nulls(len(cols[0]), pa.int64()) for _ in range(1 + ROUNDS))], schema=_OWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, found, total = [], [], 0
        for batch in batches:
            keys = []
            for name, t in zip(batch.column("set").to_pylist(), batch.column("text")):
                h = shingles(t.as_py())
                least = [mix(h ^ mix(np.atleast_1d(_U(i + 1)))).min(initial=_U(2**64 - 1)) for i in range(ROUNDS)]
                keys.append((-1 - name % buckets, name, *np.array(least, _U).view(np.int64).tolist()))
                sets.append(name)
                found.append(np.unique((h >> _U(32)).astype(np.uint32)))
                total += len(found[-1])
                if total >= most:
                    yield from flush(sets, found)
                    sets, found, total = [], [], 0
            if keys:
                cols = [pa.array(c, pa.int64()) for c in zip(*keys)]
                yield pa.RecordBatch.from_arrays([cols[0], *[pa.nulls(len(keys), pa.binary())] * 3, *cols[1:]], schema=_OWN)
        if sets:
            yield from flush(sets, found)

    return run


def _own_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All packed rows of one bucket -> (set, own): how many of its shingles no other set has; and the order keys."""
    hashes, owners = [], []
    for batch in batches:
        b = batch.filter(batch.column("shingles").is_null())
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b.column("set"), pa.array(np.zeros(b.num_rows, np.int64)), *(b.column(c) for c in _ORDERS)],
                                             ["set", "own", *_ORDERS])
        for h, names, counts in zip(*(batch.column(c) for c in ("shingles", "sets", "counts"))):
            if h.is_valid:
                hashes.append(np.frombuffer(h.as_py(), np.uint32))
                owners.append(np.repeat(np.frombuffer(names.as_py(), np.int64), np.frombuffer(counts.as_py(), "<u4")))
    if hashes:
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        edge = np.concatenate([[True], h[1:] != h[:-1], [True]])
        names, own = np.unique(owner[edge[1:] & edge[:-1]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(own.astype(np.int64)), *(pa.nulls(len(names), pa.int64()) for _ in _ORDERS)],
                                         ["set", "own", *_ORDERS])


def _with_common(sets: DataFrame, texts: DataFrame, tmp: Scratch, name: str = "sets-common") -> DataFrame:
    """``sets`` that can have a partner by their shingles, with ``common`` and the order keys.

    What is similar shares at least ``NUM / DEN`` of a set's shingles, so a set with more shingles of its own has no
    partner.  Hashes of 32 bits only make a shingle of a set's own look common, and so keep a set."""
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, round(total / BUCKET))
    packed = texts.mapInArrow(_shingles_by_bucket(buckets, FLUSH), ", ".join(
        ["bucket long", "shingles binary", "sets binary", "counts binary", "set long", *(f"{c} long" for c in _ORDERS)]))
    found = packed.groupBy("bucket").applyInArrow(_own_shingles, ", ".join(f"{c} long" for c in ("set", "own", *_ORDERS)))
    per = found.groupBy("set").agg(F.sum("own").alias("own"), *[F.max(c).alias(c) for c in _ORDERS])
    common = F.col("n_shingles") - F.col("own")
    able = sets.join(per, "set").withColumn("common", common).drop("own").filter(DEN * F.col("common") >= NUM * F.col("n_shingles"))
    return tmp.write(able, name)


_PAIR = "a long, b long, linked boolean, size_a long, size_b long, common long, private array<long>"


def _verified(pairs: DataFrame, texts: DataFrame, private: bool = False, both_sides: bool = False) -> DataFrame:
    """Pairs of sets (a, b) with their sizes, what they have in common and whether they are linked.

    ``texts`` is (set, text).  ``private``: also the shingles of a that b does not have; with ``both_sides`` also those
    of b that a does not have.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("size_a", pa.int64()), ("size_b", pa.int64()),
                        ("common", pa.int64()), ("private", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, None
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b")):
                if b != last:  # rows come sorted by b
                    last, right = b, shingles(tb.as_py())
                left = shingles(ta.as_py())
                only = left[~np.isin(left, right, assume_unique=True)] if private else None
                both = len(left) + len(right)
                common = len(left) - len(only) if private else both - len(np.unique(np.concatenate([left, right])))
                if private and both_sides:
                    only = np.concatenate([only, right[~np.isin(right, left, assume_unique=True)]])
                out.append((a, b, DEN * common >= NUM * (both - common), len(left), len(right), common, only.view(np.int64) if private else None))
            for at in range(0, len(out), 1024):
                cols = zip(*out[at:at + 1024])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    left = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("set").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, _PAIR)


def components(edges: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """(node, root): the smallest node reachable.  Edges are (a, b); nodes without edge are not listed.

    Every round hooks each node to the smallest root among its neighbours and halves the paths; the
    number of rounds is logarithmic in the length of the longest chain.
    """
    both = tmp.write(edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
                     .union(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), f"{name}-edges")
    roots = tmp.write(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("root")), f"{name}-0")
    i = 0
    while True:
        i += 1
        # smallest root among the neighbours, given to the node and to its root
        near = both.join(roots, both.y == roots.node).groupBy("x").agg(F.min("root").alias("m"))
        low = roots.join(near, roots.node == near.x).select("node", "root", F.least("root", "m").alias("m"))
        offers = (low.select("node", "m").union(low.select(F.col("root").alias("node"), "m"))
                  .groupBy("node").agg(F.min("m").alias("m")))
        hooked = roots.join(offers, "node").select("node", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        hooked = tmp.write(hooked, f"{name}-h{i}")
        up = hooked.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        new = tmp.write(hooked.join(up, hooked.root == up.n2).select("node", F.col("r2").alias("root"), (F.col("old") != F.col("r2")).alias("moved")),
                        f"{name}-{i}")
        if new.filter("moved").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")


def _known(groups: DataFrame, hot: DataFrame) -> DataFrame:
    """(set, known): in how many signatures each set is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted():
            names, n = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(n.astype(np.int64))], ["set", "n"])

        sets, total = [], 0
        for batch in batches:
            for _, _, some in _unpacked(batch):
                sets.append(some)
                total += len(some)
                if total >= COUNTED:
                    yield counted()
                    sets, total = [], 0
        if total:
            yield counted()

    cold = groups.mapInArrow(run, "set long, n long")
    return cold.union(hot.groupBy(F.col("member").alias("set")).agg(F.count(F.lit(1)).alias("n"))).groupBy("set").agg(F.sum("n").alias("known"))


def _of_sets(groups: DataFrame, hot: DataFrame, sets: DataFrame, tmp: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(groups, hot) without most sets that are not among ``sets``, and without signatures that one set has then."""
    shared, bits = _bits(sets.select("set"), lambda df, bits: F.pmod(df["set"], F.lit(bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sigs, sizes, names in _unpacked(batch):
                k = names & (bits - 1)
                keep = (shared.value[k >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool)
                left = np.add.reduceat(keep, np.cumsum(sizes) - sizes, dtype=np.int64)
                stay = left > 1
                rows += _groups(sigs[stay], left[stay], names[keep & np.repeat(stay, sizes)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], ["sigs", "sizes", "sets"])

    return (tmp.write(groups.mapInArrow(run, "sigs binary, sizes binary, sets binary"), name),
            tmp.write(hot.join(sets.select(F.col("set").alias("member")), "member", "left_semi").select("sig", "member"), f"{name}-hot"))


def _alive(groups: DataFrame, hot: DataFrame, sets: DataFrame, tmp: Scratch, name: str = "alive", turns: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, hot, sets) of the sets that can have a partner, with ``known``, the signatures of a set.

    A set that shares fewer signatures with all others together than with a similar one has none; then
    signatures of one set alone go, which can rule out more sets.  The signatures stay grouped as their buckets left
    them, so they are not shuffled; a few other sets may stay in them.
    """
    for turn in range(turns + 1):
        sets = tmp.write(sets.drop("known").join(_known(groups, hot), "set").filter("known >= least"), f"{name}-sets{turn}")
        if turn < turns:
            groups, hot = _of_sets(groups, hot, sets, tmp, f"{name}{turn}")
        if turn:
            tmp.drop(f"{name}-sets{turn - 1}")
            if turn < turns:
                tmp.drop(f"{name}{turn - 1}")
                tmp.drop(f"{name}{turn - 1}-hot")
        tmp.release()
    return groups, hot, sets


def _rows(groups: DataFrame, hot: DataFrame) -> DataFrame:
    """(sig, member) of all signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sigs, sizes, names in _unpacked(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sigs, sizes).view(np.int64)), pa.array(names)], ["sig", "member"])

    return groups.mapInArrow(run, "sig long, member long").union(hot.select("sig", "member"))


def _around(met: DataFrame, texts: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links, pairs): of sets x noted with a set h (x, root, h), links, and pairs (a, b) of different roots that hold
    all other links among sets noted with one h.

    Let E be the shingles that only one of x and h has.  Where Ex and Ey agree, x and y agree, so they are similar if and
    only if ``2 * (DEN + NUM) * |Ex & Ey| >= ex + ey`` with ``e = (DEN + NUM) * |E| - (DEN - NUM) * n``.  Of sets that are
    not like h both e are large, so Ex and Ey must share many elements: one at least among the first ``|E| - t + 1`` of
    each, rarest first, if t is the least number that any partner calls for.  Elements that a whole family has are the last
    ones, so a family makes few pairs however large it is.  Sets that are like h are in its component: with one another they
    need no pair, and a set y that one of them is like without sharing an element is like the one with the least e."""
    seen = _verified(met.select(F.col("x").alias("a"), F.col("h").alias("b")), texts, private=True, both_sides=True)
    e = (DEN + NUM) * F.size("private") - (DEN - NUM) * F.col("size_a")
    seen = tmp.write(seen.select(F.col("a").alias("x"), F.col("b").alias("h"), "linked", F.col("size_a").alias("n"), F.col("common").alias("of_h"),
                                 e.alias("e"), F.size("private").alias("size"), "private").join(met, ["x", "h"]), "around")
    near, far, span = F.col("linked"), ~F.col("linked"), 2 * (DEN + NUM)
    per_hub = seen.groupBy("h").agg(
        F.min(F.when(far, F.col("e"))).alias("far_e"), F.min(F.when(near, F.struct("e", "x"))).alias("best"),
        F.max(F.when(far, (DEN + NUM) * F.col("of_h") - NUM * F.col("n"))).alias("room"), F.min(F.when(far, F.col("n"))).alias("least_n"))

    def least(other: Column) -> Column:
        return F.when(other.isNotNull(), F.greatest(F.lit(1), F.ceil((F.col("e") + other) / span)))

    each = seen.join(per_hub, "h").withColumns({"t_far": least(F.col("far_e")), "t_near": least(F.col("best.e"))})
    links = (seen.filter(near).select(F.col("x").alias("a"), F.col("h").alias("b"))
             .union(each.filter(far & (F.col("e") + F.col("best.e") <= 0)).select(F.col("x").alias("a"), F.col("best.x").alias("b"))))
    # of what one has alone, the first elements are those that h lacks
    rows = each.select(*[c for c in each.columns if c not in ("private", "best", "far_e")], F.posexplode("private").alias("at", "p"))
    often = rows.groupBy("h", "p").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("h", "x").orderBy("often", "p")
    rows = rows.join(often, ["h", "p"]).withColumns({"rank": F.row_number().over(order), "new": F.col("at") < F.col("n") - F.col("of_h")})
    rows = rows.filter("often > 1 AND (new OR rank <= size - least(t_far, t_near) + 1)").drop("at", "often")
    rows = tmp.write(rows, "around-first")

    def side(of: str, rows: DataFrame) -> DataFrame:
        return rows.select("h", "p", *[F.col(c).alias(f"{c}_{of}") for c in ("x", "root", "n", "of_h", "e", "size", "rank", "t_far")])

    fits = "root_a != root_b AND " + " AND ".join(f"{DEN} * n_{i} >= {NUM} * n_{j}" for i, j in ("ab", "ba"))
    first = " AND ".join(f"rank_{i} <= size_{i} - greatest(1, ceil((e_a + e_b) / {span})) + 1" for i in "ab")
    others = rows.filter(far)
    pairs = side("a", others.filter("rank <= size - t_far + 1")).join(side("b", others.filter("rank <= size - t_far + 1")), ["h", "p"])
    pairs = (pairs.filter(f"x_a < x_b AND {fits}").groupBy("h", "x_a", "x_b")
             .agg(F.count(F.lit(1)).alias("shared"), F.first(F.col("e_a") + F.col("e_b")).alias("e"), F.first(F.greatest("t_far_a", "t_far_b")).alias("t"))
             .filter(f"shared + t - 1 >= e / {span}"))
    # one of h's component and one that is not like h share what h lacks, or have enough of h both
    new = side("a", rows.filter(near & F.col("new"))).join(side("b", others.filter("new")), ["h", "p"]).filter(fits)
    small = rows.filter(near).filter(f"rank <= size - t_far + 1 AND {NUM} * n <= room AND {DEN + NUM} * of_h - {NUM} * n >= {NUM} * least_n")
    old = side("a", small).join(side("b", others.filter("rank <= size - t_near + 1")), ["h", "p"])
    old = old.filter(f"{fits} AND {first} AND {DEN + NUM} * least(of_h_a, of_h_b) >= {NUM} * (n_a + n_b)")
    pairs = pairs.select("x_a", "x_b").union(new.select("x_a", "x_b")).union(old.select("x_a", "x_b"))
    return links, pairs.select(F.least("x_a", "x_b").alias("a"), F.greatest("x_a", "x_b").alias("b")).distinct()


def _several(shared: DataFrame, info: DataFrame) -> DataFrame:
    """Rows of the signatures whose sets are in several components."""
    at = shared.select("sig", "member").join(info, "member")
    several = at.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("sig")
    return at.join(several, "sig", "left_semi")


def _neighbours(shared: DataFrame, info: DataFrame, links: DataFrame, texts: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shared, info, links), of ``shared`` the signatures of several components, after ``ROUNDS`` rounds in which sets without hub meet sets of other components.

    In a round the sets of a signature are put in order by a minimum hash of their shingles, which puts like sets
    side by side, and each is noted with the two after it: a few rows for each row of a signature, however many
    sets it has.  Every set without hub is compared with the two that it was noted with most.  What a family of
    like sets links becomes one component before any pairs of it are formed."""
    seen = None
    for turn, key in enumerate(_ORDERS):
        shared = tmp.write(_several(shared, info.select("member", "root")).select("sig", "member"), f"several{turn}")
        if turn:
            tmp.drop(f"several{turn - 1}")
        tmp.release()
        if shared.isEmpty():
            break
        rest = shared.join(info.select("member", "root", "single", "band", key), "member")
        rows = Window.partitionBy("sig").orderBy(key, "member")
        own = F.struct("member", "root", "single", "band")
        after = rest.select(own.alias("x"), *[F.lead(own, i).over(rows).alias(f"y{i}") for i in (1, 2)])
        after = after.select("x", F.explode(F.array("y1", "y2")).alias("y"))
        able = F.col("y").isNotNull() & (F.col("x.root") != F.col("y.root")) & (F.col("x.single") | F.col("y.single"))
        noted = (after.filter(able).filter(_need("x.band", "y.band").isNotNull())
                 .groupBy("x.member", "y.member", "x.single", "y.single").agg(F.count(F.lit(1)).alias("n")).toDF("x", "y", "sx", "sy", "n"))
        sides = noted.filter("sx").select("x", "y", "n").union(noted.filter("sy").select("y", "x", "n"))
        sides = sides.groupBy("x", "y").agg(F.sum("n").alias("n"))
        if seen is not None:
            both = seen.select(F.col("a").alias("x"), F.col("b").alias("y")).union(seen.select("b", "a"))
            sides = sides.join(both, ["x", "y"], "left_anti")
        best = Window.partitionBy("x").orderBy(F.desc("n"), "y")
        pairs = sides.withColumn("_i", F.row_number().over(best)).filter("_i <= 2").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        now = tmp.write(_verified(pairs, texts).select("a", "b", "linked"), f"neighbours{turn}")
        seen = now.select("a", "b") if seen is None else seen.union(now.select("a", "b"))
        if now.filter("linked").isEmpty():
            continue
        links = tmp.write(links.union(now.filter("linked").select("a", "b")), f"neighbour-links{turn}")
        roots = components(links, tmp, f"neighbour-components{turn}").select(F.col("node").alias("member"), F.col("root").alias("_root"))
        info = tmp.write(info.join(roots, "member", "left").withColumn("root", F.coalesce("_root", "root")).drop("_root"), f"info{turn}")
    return shared, info, links


def _links(shared: DataFrame, texts: DataFrame, sets: DataFrame, tmp: Scratch) -> DataFrame:
    """(a, b): links that connect exactly the sets that similar pairs connect."""
    # a signature's representative is its set with the most shared signatures: of an original and its
    # copies, which are more like it than like each other, that is the original
    hubs = shared.groupBy("sig").agg(F.max(F.struct("known", "member")).alias("hub")).select("sig", F.col("hub.member").alias("rep"))
    per_pair = (shared.select("sig", "member").join(hubs, "sig").filter("member != rep")
                .groupBy("member", "rep").agg(F.count(F.lit(1)).alias("n")))
    best = (per_pair.groupBy(F.col("member").alias("a")).agg(F.max(F.struct("n", "rep")).alias("best"))
            .select("a", F.col("best.rep").alias("b"), F.col("best.n").alias("shared")))
    # pairs that seem to share too few signatures here are met again below, with all they share
    first = tmp.write(_verified(_enough(best, sets), texts, private=True).filter("linked"), "verified1")
    links = first.select("a", "b")
    # every set with its component and its hub; a set that has and is no hub is single
    to = first.select(F.col("a").alias("member"), F.col("b").alias("hub"))
    info = sets.select(F.col("set").alias("member"), F.struct(*_BAND, "common").alias("band"), "least", *_ORDERS).join(to, "member", "left")
    if not links.isEmpty():
        roots = components(links, tmp, "components1").select(F.col("node").alias("member"), "root")
        info = info.join(roots, "member", "left")
    else:
        info = info.withColumn("root", F.lit(None).cast("long"))
    single = F.col("root").isNull()
    info = tmp.write(info.select("member", "band", "least", F.coalesce("hub", "member").alias("hub"),
                                 F.coalesce("root", "member").alias("root"), single.alias("single"), *_ORDERS), "info")
    tmp.release()
    shared, info, links = _neighbours(shared, info, links, texts, tmp)
    rest = tmp.write(_several(shared, info.drop(*_ORDERS)).distinct(), "rest")
    tmp.release()
    # two single sets of different components: in signatures of few of them by pairs, of like sizes, with as many
    # signatures in common as similar sets have; what meets in a signature of more by differences to one of its sets, that
    # of the most such signatures
    alone = rest.filter("single")
    several = alone.groupBy("sig").agg(F.count(F.lit(1)).alias("singles"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    alone = tmp.write(alone.join(several.select("sig", "singles"), "sig").select("sig", "member", "root", "band", "singles"), "alone")
    crowd = alone.filter(F.col("singles") > FEW)
    at = rest.select("sig", "member").join(crowd.select("sig").distinct(), "sig", "left_semi")
    most = at.join(at.groupBy("member").agg(F.count(F.lit(1)).alias("n")), "member")
    most = most.groupBy("sig").agg(F.max(F.struct("n", "member")).alias("most"))
    # any set does for a signature: that of the most in which this one is, too, so that a family has few
    over = at.join(most, "sig").groupBy(F.col("member").alias("h")).agg(F.max("most").alias("over"))
    over = over.select("h", F.col("over.member").alias("up")).join(most.select(F.col("most.member").alias("h")).distinct(), "h")
    over = tmp.write(over, "over")
    twice = over.join(over.select(F.col("h").alias("up"), F.col("up").alias("top")), "up").select("h", "top")
    most = most.select("sig", F.col("most.member").alias("h")).join(twice, "h").select("sig", F.col("top").alias("h"))
    crowd = crowd.join(most, "sig").filter("member != h")
    crowd = tmp.write(crowd.select(F.col("member").alias("x"), "root", "h").distinct(), "crowd")
    alone = alone.filter(F.col("singles") <= FEW)
    one = alone.select("sig", F.col("member").alias("a"), F.col("root").alias("root_a"), F.col("band").alias("x"))
    two = alone.select("sig", F.col("member").alias("b"), F.col("root").alias("root_b"), F.col("band").alias("y"))
    need = _need("x", "y")
    met = (one.join(two, "sig").filter((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & need.isNotNull()).groupBy("a", "b")
           .agg(F.count(F.lit(1)).alias("shared"), F.max(need).alias("need")).filter("shared >= need"))
    met = met.select("a", "b")
    if not crowd.isEmpty():
        found, pairs = _around(crowd, texts, tmp)
        links, met = links.union(tmp.write(found, "linked-around")), met.union(pairs).distinct()
    met = tmp.write(met, "met-single")
    links = links.union(tmp.write(_verified(met, texts).filter("linked").select("a", "b"), "linked-single"))
    # any set with the hub of another component: what is similar to one of the hub's sets meets them
    # in as many signatures
    of_hub = info.filter("NOT single").groupBy("hub").agg(F.min("least").alias("least_hub"))
    around = (rest.filter("NOT single").select("sig", "hub", F.col("root").alias("hub_root")).distinct()
              .join(of_hub, "hub").withColumnRenamed("hub", "h"))
    met = (rest.join(around, "sig").filter("root != hub_root").groupBy(F.col("member").alias("a"), F.col("h").alias("b"))
           .agg(F.count(F.lit(1)).alias("shared"), F.max(F.greatest("least", "least_hub")).alias("least")).filter("shared >= least"))
    met = tmp.write(met.select("a", "b"), "met-hub")
    tmp.release()
    second = tmp.write(_verified(met, texts, private=True), "verified2")
    links = links.union(second.filter("linked").select("a", "b"))
    # a set y that is not like hub h can be like a set x of h only if x and y share a shingle that h
    # does not have, or if what each has of h is enough: 9 * min >= 4 * (size of x + size of y)
    xs = first.select(F.col("b").alias("h"), F.col("a").alias("x"), F.col("size_a").alias("nx"), F.col("common").alias("hx"), F.col("private").alias("px"))
    ys = second.filter("NOT linked").select(F.col("b").alias("h"), F.col("a").alias("y"), F.col("size_a").alias("ny"), F.col("common").alias("hy"),
                                            F.col("private").alias("py"))
    cols_x, cols_y = ("h", "x", "nx", "hx"), ("h", "y", "ny", "hy")
    total = DEN + NUM  # similar: total * common >= NUM * (nx + ny)
    by_shingle = (xs.select(*cols_x, F.explode("px").alias("p")).join(ys.select(*cols_y, F.explode("py").alias("p")), ["h", "p"]))
    most_y = ys.groupBy("h").agg(F.max(total * F.col("hy") - NUM * F.col("ny")).alias("room_y"), F.min("ny").alias("least_y"))
    small_x = (xs.select(*cols_x).join(most_y, "h").filter(
        (NUM * F.col("nx") <= F.col("room_y")) & (total * F.col("hx") - NUM * F.col("nx") >= NUM * F.col("least_y"))).select(*cols_x))
    by_hub = small_x.join(ys.select(*cols_y), "h").filter(total * F.least("hx", "hy") >= NUM * (F.col("nx") + F.col("ny")))
    third = (by_shingle.select("x", "y", "nx", "ny").unionByName(by_hub.select("x", "y", "nx", "ny"))
             .filter((DEN * F.col("nx") >= NUM * F.col("ny")) & (DEN * F.col("ny") >= NUM * F.col("nx")))
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    third = _verified(tmp.write(third, "met-third"), texts).filter("linked").select("a", "b")
    return links.union(tmp.write(third, "verified3"))


def _bits(rows: DataFrame, place: Callable[[DataFrame, int], Column]):
    """A broadcast table of hashed bits, one for each row, ``MOST_BITS`` at most, and the number of bits."""
    bits = 1 << 15
    while bits < min(MOST_BITS, 16 * rows.count()):
        bits *= 2
    at = rows.select(place(rows, bits).alias("k"))
    found = at.groupBy(F.floor(F.col("k") / (1 << 15)).alias("block")).agg(F.bitmap_construct_agg(F.col("k") % (1 << 15)).alias("bits")).collect()
    table = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for r in found:
        table[r.block] = np.frombuffer(r.bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(table.ravel()), bits


def _maybe_in(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """``rows`` without most of those whose (doc_id, text_key) is not among the owners, so that few texts are shuffled for
    the join that follows.  One hashed bit for each owner; more owners than ``MOST_BITS`` let more rows through."""
    def place(df: DataFrame, bits: int) -> Column:
        return F.pmod(F.xxhash64(df["doc_id"], df["text_key"]), F.lit(bits))

    shared, bits = _bits(owners, place)

    @F.arrow_udf("boolean")
    def some(k: pa.Array) -> pa.Array:
        k = k.to_numpy()
        return pa.array((shared.value[k >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool))

    return rows.filter(some(place(rows, bits)))


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component (null without shingles), component_id.

    doc_id is an integer; ``text_key`` is xxhash64 of the text, with which rows of one doc_id can be
    told apart.
    """
    tmp = Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"),
                       F.col(f"`{text}`").alias("text"))
    # about one shingle in six bytes and four signatures in five shingles
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, round(0.8 * total / 6 / BUCKET))
    packed = rows.mapInArrow(_packed(buckets, HOT, FLUSH), ", ".join(
        ["bucket long", "sigs binary", "sets binary", "counts binary", *(f"{c} long" for c in _DESCRIBED)]))
    found = packed.groupBy("bucket").applyInArrow(_met_in_buckets, ", ".join(
        [*(f"{c} long" for c in ("kind", *"abcdefghij")), "sigs binary", "sizes binary", "sets binary"]))
    found = tmp.write(found, "signatures")
    del packed
    tmp.release()
    groups = found.filter("kind = 0").select("sigs", "sizes", "sets")
    hot = tmp.write(found.filter("kind = 2").select(F.col("a").alias("sig"), F.col("b").alias("member")).distinct(), "hot")
    described = tmp.write(found.filter("kind = 1").select(*[F.col(c).alias(n) for c, n in zip("abcdefghij", _DESCRIBED)]), "described")
    # the texts of sets that share a signature: one document each
    first = F.min(F.struct("doc_id", "text_key")).alias("o")
    sets = described.filter("set IS NOT NULL").groupBy("set").agg(first, *[F.min(c).alias(c) for c in (*_BAND, "least")])
    groups, hot, sets = _alive(groups, hot, sets, tmp)
    tmp.drop("signatures")
    tmp.drop("hot")
    owners = sets.select("set", "o.doc_id", "o.text_key")
    mine = _maybe_in(rows, owners).join(owners, rows.doc_id.eqNullSafe(owners.doc_id) & (rows.text_key == owners.text_key))
    texts = tmp.write(mine.select("set", "text").dropDuplicates(["set"]), "texts")
    tmp.release()
    # twice: without the sets that went, more shingles are a set's own
    for turn in range(2):
        sets = _with_common(sets.drop("common", "known", *_ORDERS), texts, tmp, f"sets-common{turn}")
        texts = tmp.write(texts.join(sets.select("set"), "set", "left_semi"), f"texts{turn}")
        tmp.drop("texts" if not turn else f"texts{turn - 1}")
        tmp.release()
    groups, hot = _of_sets(groups, hot, sets, tmp, "common")
    for name in ("alive1", "alive1-hot"):
        tmp.drop(name)
    groups, hot, sets = _alive(groups, hot, sets, tmp, "alive-common", 1)
    shared = tmp.write(_rows(groups, hot).join(sets.select(F.col("set").alias("member"), "known"), "member"), "shared")
    for name in ("common", "common-hot", "alive-common0", "alive-common0-hot"):
        tmp.drop(name)
    tmp.release()
    if shared.isEmpty():  # no two sets meet
        roots = docs.sparkSession.createDataFrame([], "set long, root long")
    else:
        roots = components(_links(shared, texts, sets, tmp), tmp, "components").withColumnRenamed("node", "set")
    placed = described.join(roots, "set", "left").withColumn("component", F.coalesce("root", "set"))
    placed = tmp.write(placed.select("doc_id", "text_key", "n_shingles", "component"), "placed")
    tmp.keep_only("placed")
    least = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "component", "left").select(
        "doc_id", "text_key", "n_shingles", "component", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (nulls last), then text key.

    Documents without shingles all stay, as do the columns and their order.
    """
    def row_key(of: Column, text_key: Column) -> Column:
        return F.concat_ws(":", F.coalesce(of.cast("string"), F.lit("-")), text_key.cast("string"))

    found = jaccard_components(docs, text, doc_id)
    first = (found.filter("component IS NOT NULL").groupBy("component")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("k")))
    stay = (first.select(row_key(F.col("k.doc_id"), F.col("k.text_key")).alias("_row"), F.lit(True).alias("_judged"))
            .unionByName(found.filter("component IS NULL").select(
                row_key(F.col("doc_id"), F.col("text_key")).alias("_row"), F.lit(False).alias("_judged")).distinct()))
    body, own = F.col(f"_doc.`{text}`"), F.col(f"_doc.`{doc_id}`")
    kept = docs.select(F.struct("*").alias("_doc")).withColumn("_row", row_key(own, F.xxhash64(body))).join(stay, "_row")
    # rows that repeat an id and a text are copies, too
    copy = F.row_number().over(Window.partitionBy("_row").orderBy("_judged"))
    return kept.withColumn("_n", copy).filter("_n = 1 OR NOT _judged").select("_doc.*")
