"""Packing by non-negative least squares over a length histogram.

1. Documents are cut into whole windows of ``size`` tokens and a rest; the rests' lengths are
   counted (at most ``size`` numbers, whatever the input).
2. Shallow combinations of up to ``depth`` lengths that fill the window exactly are enumerated, and
   repeat counts x >= 0 are solved so that the combinations use up the histogram:
   min ||A x - h||.
3. The counts are rounded down, never beyond what is there; the residual lengths are packed
   greedily, longest first, each filled with the longest lengths that still fit.
4. The plan (rows of length, first rank, last rank, first sequence, offset) is joined with the
   pieces by length and rank.

Scale: the driver sees the histogram only.  Ranks of equal lengths come from counts per (length,
bucket) and a window inside a bucket, so a length that holds a third of all pieces is spread over
``buckets`` tasks.  No token ids are shuffled unless the caller keeps that column.

Defined results: null text counts as empty (one piece, the end id); repeated rows are packed each;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentlake.llm.common import Scratch

WINDOW = 1024
DEPTH = 3


def combinations(size: int, depth: int, present: np.ndarray) -> np.ndarray:
    """All sorted combinations of 1 to ``depth`` (at most 3) present lengths with sum ``size``.

    Rows of ``depth`` lengths, 0 where there are fewer.  ``present[l]`` says whether length l occurs.
    """
    found = []
    if present[size]:
        found.append(np.array([[size, 0, 0]]))
    if depth >= 2:
        a = np.arange(1, size // 2 + 1)
        a = a[present[a] & present[size - a]]
        found.append(np.stack([size - a, a, 0 * a], 1))
    if depth >= 3:
        for small in np.flatnonzero(present[1:size // 3 + 1]) + 1:
            mid = np.arange(small, (size - small) // 2 + 1)
            mid = mid[present[mid] & present[size - small - mid]]
            found.append(np.stack([size - small - mid, mid, np.full_like(mid, small)], 1))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return rows[:, :depth] if depth < 3 else rows


def solve_nnls(columns: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that minimises ||A x - h||; column j of A counts the lengths in ``columns[j]``.

    Accelerated projected gradient with restarts on the columns scaled to unit norm.  A has at most
    three entries a column, so a step costs three gathers and one weighted count.
    """
    n = len(histogram)
    scale = max(1.0, float(histogram.max()))
    h = histogram / scale
    used = columns > 0
    if not len(columns):
        return np.zeros(0)

    def times(x):
        return np.bincount(columns.ravel(), (x[:, None] * used).ravel(), n)

    def transposed(r):
        return (r[columns] * used).sum(1)

    # largest eigenvalue of A'A by power iteration
    v = np.ones(len(columns))
    for _ in range(12):
        v = transposed(times(v))
        bound = np.linalg.norm(v)
        v /= bound
    rate = 1 / (1.05 * bound)
    x = np.zeros(len(columns))
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * transposed(times(y) - h))
        if (y - new) @ (new - x) > 0:
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x * scale


def greedy(left: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """(lengths, repeats) that use up the residual histogram ``left`` (changed): longest first."""
    out = []
    longest = len(left) - 1
    while True:
        while longest > 0 and left[longest] == 0:
            longest -= 1
        if longest == 0:
            return out
        take, room = [], size
        count = left.copy()
        fits = longest
        while fits:
            n = min(room // fits, count[fits])
            take += [fits] * int(n)
            count[fits] -= n
            room -= n * fits
            below = np.flatnonzero(count[1:min(room, fits) + 1])
            fits = int(below[-1]) + 1 if len(below) else 0
        need = np.bincount(take, minlength=len(left))
        repeats = int((left[need > 0] // need[need > 0]).min())
        left -= repeats * need
        out.append((take, repeats))


def plan(histogram: np.ndarray, size: int, depth: int = DEPTH) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, offset) that place every piece once."""
    left = histogram.astype(np.int64).copy()
    columns = combinations(size, depth, left > 0)
    x = solve_nnls(columns, histogram.astype(float))
    chosen = []
    for j in np.argsort(-x, kind="stable"):
        repeats = int(x[j] + 1e-6)
        if repeats < 1:
            break
        need = np.bincount(columns[j][columns[j] > 0], minlength=len(left))
        repeats = min(repeats, int((left[need > 0] // need[need > 0]).min()))
        if repeats:
            left -= repeats * need
            chosen.append((columns[j][columns[j] > 0].tolist(), repeats))
    rows, rank, sequence = [], np.zeros(len(left), np.int64), 0
    for lengths, repeats in chosen + greedy(left, size):
        offset = 0
        for n in lengths:
            rows.append((n, int(rank[n]), int(rank[n]) + repeats, sequence, offset))
            rank[n] += repeats
            offset += n
        sequence += repeats
    return rows


def pack(pieces: DataFrame, size: int = WINDOW, depth: int = DEPTH, order: tuple[str, ...] = ("doc_id", "start"),
         buckets: int | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``length`` is a column from 1 to ``size``.

    ``order`` must tell apart all rows that differ: the ranks depend on it alone.
    """
    spark = pieces.sparkSession
    tmp = Scratch(spark, "packing")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = tmp.write(keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        histogram[r["length"]] = r["n"]
    rows = plan(histogram, size, depth)
    layout = F.broadcast(spark.createDataFrame(
        rows, "length long, _first long, _end long, _sequence long, offset long"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = (keyed.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["length", "_bucket"])
              .withColumn("_rank", F.col("_rank") + F.col("_start")))
    placed = ranked.join(layout, "length").filter("_rank >= _first AND _rank < _end")
    return placed.withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_first")).drop(
        "_bucket", "_rank", "_start", "_first", "_end", "_sequence")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                   end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, doc_tokens, ids_crc32,
    sequence_id, offset (and the ids with ``keep_ids``)."""
    from talentlake.llm.tokens import pieces

    cut = pieces(docs, tokenizer, size, text, (doc_id,), end_id).withColumn("ids_crc32", F.crc32("ids"))
    cut = Scratch(docs.sparkSession, "pieces").write(cut if keep_ids else cut.drop("ids"), "pieces")
    return pack(cut, size, order=(doc_id, "start", "length", "doc_tokens", "ids_crc32"))
