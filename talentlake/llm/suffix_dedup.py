"""Removal of repeated byte strings with suffix arrays (see ``induced.py``).

Every byte covered by a ``size``-byte string that also starts anywhere else, in the same document or
another, is removed.

1. Anchors: in each window of ``size`` bytes the ``GRAM``-byte string with the smallest hash (the
   leftmost of equals) is its anchor.  Equal windows have equal anchors at equal offsets, so windows
   need to be compared only within one anchor's string.  Consecutive windows with one anchor are a
   span, about a hundred windows for one row.
2. Anchors that occur once in the corpus are dropped.  Equal spans are merged (two 64-bit hashes of
   all their bytes); spans that occur twice are repeated as a whole.
3. Shards: the different spans of an anchor meet in one shard, whose texts are sorted by external
   induced sorting; suffixes whose common prefix with a neighbour is ``size`` are repeated windows.
4. The repeated windows go back to all occurrences and are cut out, document by document.

Scale: rows are shuffled by anchor, not by byte; the text itself moves twice, by document.  Before
any shuffle equal spans and anchors are counted on the map side.  An anchor with more than ``HOT``
different spans is not given to one shard: its windows are hashed one by one (two 64-bit hashes) and
counted, which Spark spreads over all tasks.

Defined results: null texts are empty; texts shorter than ``size`` keep all bytes; repeated rows
are occurrences of their own, so each removes the other; the kept bytes may cut a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.llm.common import Scratch
from talentlake.llm.hashing import U64, SubstringHashes, mix
from talentlake.llm.induced import suffix_array

SIZE = 400
GRAM = 128
#: bytes of spans that a shard has on average, and different spans of one anchor above which it is hot
SHARD_BYTES = 3 << 19
HOT = 4_000

_U = U64
_SEGMENT = 1 << 20


def spans(data: np.ndarray, size: int, gram: int) -> list[np.ndarray]:
    """[gram hash, first hash, second hash, start, windows] of the spans of one text."""
    found = []
    for at in range(0, max(0, len(data) - size + 1), _SEGMENT):
        part = data[at:at + _SEGMENT + size - 1]
        h, n = SubstringHashes(part), len(part)
        p = np.arange(n - gram + 1)
        grams = h.of(0, p, p + gram)
        # (hash, position) in one number; the least in every window, from block-wise running minima
        value = (grams & ~_U(_SEGMENT * 2 - 1)) | p.astype(_U)
        w, windows = size - gram + 1, n - size + 1
        blocks = -(-len(value) // w) * w
        padded = np.full(blocks, ~_U(0), _U)
        padded[:len(value)] = value
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        best = (np.minimum(behind[:windows], ahead[w - 1:w - 1 + windows]) & _U(_SEGMENT * 2 - 1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        count = np.diff(np.append(start, windows))
        end = start + count + size - 1
        place = mix(((best[start] - start) * 4096 + count).astype(_U))
        found.append([grams[best[start]], h.of(0, start, end) + place, h.of(1, start, end) + place, start + at, count])
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, _U)] * 3 + [np.zeros(0, np.int64)] * 2


_SPAN = "struct<gram: bigint, fp1: bigint, fp2: bigint, start: bigint, windows: bigint>"


def _span_column(text: Column, size: int, gram: int) -> Column:
    @F.arrow_udf(f"array<{_SPAN}>")
    def cut(texts: pa.Array) -> pa.Array:
        each = [spans(np.frombuffer((t.as_py() or "").encode(), np.uint8), size, gram) for t in texts]
        cols = [np.concatenate(x).view(np.int64) for x in zip(*each)] if each else [np.zeros(0, np.int64)] * 5
        offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in each])]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(c) for c in cols], ["gram", "fp1", "fp2", "start", "windows"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return cut(text)


def _shard_windows(size: int):
    """Spans of whole anchors -> the windows of each span that are repeated: (span, from, to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {}
        for b in batches:
            for key in zip(*(b.column(c).to_pylist() for c in ("gram", "fp1", "fp2", "bytes"))):
                rows[key[:3]] = key[3]  # a repeated row brings its span again
        keys = list(rows)
        raw = np.frombuffer(b"".join(rows[k] + b"\0" for k in keys), np.uint8)
        lengths = np.array([len(rows[k]) + 1 for k in keys])
        first = np.concatenate([[0], np.cumsum(lengths)])
        text = raw.astype(np.int16) + 1
        text[first[1:] - 1] = 0
        order, lcp = suffix_array(text, 257, size)
        long = lcp >= size
        both = long.copy()
        both[:-1] |= long[1:]
        repeated = np.zeros(len(text) + 1, bool)
        repeated[order[both]] = True
        edge = np.flatnonzero(repeated[1:] != repeated[:-1]) + 1
        if repeated[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        own = np.searchsorted(first, start, "right") - 1
        cols = [pa.array([keys[i][j] for i in own], pa.int64()) for j in range(3)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(start - first[own]), pa.array(end - first[own])],
                                         ["gram", "fp1", "fp2", "lo", "hi"])

    return run


def _window_hashes(size: int):
    """Spans of hot anchors -> one row for each window: its anchor, its offset there and two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for gram, fp1, fp2, n, raw in zip(*(b.column(c).to_pylist() for c in ("gram", "fp1", "fp2", "n", "bytes"))):
                data = np.frombuffer(raw, np.uint8)
                h, lo = SubstringHashes(data), np.arange(len(data) - size + 1)
                fill = lambda x: pa.array(np.full(len(lo), x, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [fill(gram), fill(fp1), fill(fp2), pa.array(lo), fill(n),
                     *(pa.array(h.of(i, lo, lo + size).view(np.int64)) for i in (0, 1))],
                    ["gram", "fp1", "fp2", "lo", "n", "w1", "w2"])

    return run


def _slices(spans_of: str = "spans"):
    """(text, spans) -> one row for each span with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, parts in zip(b.column("text"), b.column(spans_of)):
                raw, out = t.as_py().encode(), parts.as_py()
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x[k] for x in out], pa.int64()) for k in ("gram", "fp1", "fp2", "n")),
                     pa.array([raw[x["start"]:x["end"]] for x in out], pa.binary())], ["gram", "fp1", "fp2", "n", "bytes"])

    return run


def repeated_ranges(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(t1, t2, ranges): the byte ranges to remove of every keyed document that has some.

    ``docs`` is (t1, t2, text); t1 and t2 name a document by id and text.
    """
    tmp = Scratch(docs.sparkSession, "suffix-dedup")
    key = ["gram", "fp1", "fp2"]
    every = (docs.filter(F.octet_length("text") >= size)
             .select("t1", "t2", F.explode(_span_column(F.col("text"), size, gram)).alias("s")).select("t1", "t2", "s.*"))
    # written, so that the join has an exchange on both sides and a hot anchor can be split
    twice = tmp.write(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "twice")
    found = tmp.write(every.join(twice, "gram", "left_semi"), "spans")
    rep = F.min(F.struct("t1", "t2", "start", "windows")).alias("rep")
    different = tmp.write(found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), rep), "different")
    per_gram = different.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"), F.min("n").alias("least"))
    open_grams = per_gram.filter("texts > 1 AND least = 1").select("gram", "texts")
    # texts of the spans that need comparing, cut from one document each
    wanted = (different.join(open_grams, "gram").groupBy("rep.t1", "rep.t2").agg(F.collect_list(F.struct(
        *key, "n", F.col("rep.start").alias("start"),
        (F.col("rep.start") + F.col("rep.windows") + size - 1).alias("end"))).alias("spans")))
    pieces = (docs.join(wanted, ["t1", "t2"]).select("text", "spans")
              .mapInArrow(_slices(), "gram long, fp1 long, fp2 long, n long, bytes binary"))
    pieces = tmp.write(pieces, "pieces")
    many = open_grams.filter(F.col("texts") > hot).select("gram")
    shards = max(1, round((pieces.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0) / SHARD_BYTES))
    sharded = (pieces.join(many, "gram", "left_anti").withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))
               .groupBy("shard").applyInArrow(_shard_windows(size), "gram long, fp1 long, fp2 long, lo long, hi long"))
    hashed = (pieces.join(many, "gram", "left_semi").dropDuplicates(key)
              .mapInArrow(_window_hashes(size), "gram long, fp1 long, fp2 long, lo long, n long, w1 long, w2 long"))
    again = hashed.groupBy("gram", "w1", "w2").agg(F.sum("n").alias("times")).filter("times > 1").select("gram", "w1", "w2")
    counted = hashed.join(again, ["gram", "w1", "w2"], "left_semi").select(*key, "lo", (F.col("lo") + 1).alias("hi"))
    whole = different.filter("n > 1").select(*key, F.lit(0).cast("long").alias("lo"), F.col("rep.windows").alias("hi"))
    windows = tmp.write(sharded.unionByName(counted).unionByName(whole), "windows")
    return (found.join(windows, key).select("t1", "t2", (F.col("start") + F.col("lo")).alias("lo"),
                                            (F.col("start") + F.col("hi") + size - 1).alias("hi"))
            .groupBy("t1", "t2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without its text column but with ``repeats``: kept (bytes), n_bytes, n_removed, n_spans."""
    body, own = F.col(f"`{text}`"), F.col(f"`{doc_id}`").cast("string")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("doc"), body.alias("text"),
                        F.xxhash64(F.lit(1), own, body).alias("t1"), F.xxhash64(F.lit(2), body, own).alias("t2"))
    ranges = repeated_ranges(named.select("t1", "t2", "text"), **options)

    kind = pa.struct([("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])

    @F.arrow_udf("kept binary, n_bytes long, n_removed long, n_spans long")
    def cut(texts: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for t, p in zip(texts, parts):
            raw, at, kept, n_spans = (t.as_py() or "").encode(), 0, [], 0
            end = -1
            for r in sorted((r["lo"], r["hi"]) for r in (p.as_py() or ())):
                if r[0] > end:  # ranges that touch are one run
                    kept.append(raw[at:r[0]])
                    n_spans += 1
                end = at = max(end, r[1])
            kept.append(raw[at:])
            left = b"".join(kept)
            out.append({"kept": left, "n_bytes": len(raw), "n_removed": len(raw) - len(left), "n_spans": n_spans})
        return pa.array(out, kind)

    return named.join(ranges, ["t1", "t2"], "left").select("doc.*", cut("text", "ranges").alias("repeats"))
