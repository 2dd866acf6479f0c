"""Vector best-fit packing of whole documents.

A sequence has three capacities: tokens, documents (pieces) and attention cost (the sum of squared piece
lengths, what block-diagonal attention over the sequence costs).  Pieces are placed longest first.  Of the
open sequences that can take a piece under every capacity, one is selected by what would be left of its
capacities, each as a share of the whole and weighted:

* ``norm``: the least Euclidean norm of the residual after the piece (the default), or
* ``dot``:  the largest dot product of the piece's demands and the residual before it.

Ties go to the oldest sequence; a new one is opened when none can take the piece.

Scale: pieces of one length have equal demands, and sequences of one history have equal residuals.  So the
selection runs on the driver over (length, count) and groups of like sequences, places whole counts at a
time, and gives what placing piece by piece would give (``place_one_by_one`` in the tests).  What the driver
holds is bounded by the number of lengths, at most ``capacity.tokens``, whatever the input.  Pieces get
their rank among those of their length from counts per (length, write partition), so a length that holds a
third of all pieces is ranked by as many tasks as wrote it; the plan is looked up by binary search.  Token
ids are shuffled only where the caller keeps them.

Defined results: null text counts as empty (one piece, the end id); repeated rows are packed each; an empty
table gives no rows; other columns of ``docs`` are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentlake.llm.common import Scratch
from talentlake.llm.tokens import encoder


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most.  The defaults for documents and attention follow from the tokens."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens ** 2], np.int64)


#: weights of tokens, documents and attention cost: tokens decide, the others tell apart what is close
WEIGHTS = (1.0, 0.05, 0.05)


def demand(length: int) -> np.ndarray:
    return np.array([length, 1, length * length], np.int64)


def select(residuals: np.ndarray, need: np.ndarray, whole: np.ndarray, weights: np.ndarray, score: str) -> int:
    """Row of ``residuals`` that takes ``need`` best; -1 where no row can take it."""
    fits = np.flatnonzero((residuals >= need).all(1))
    if not len(fits):
        return -1
    share = residuals[fits] / whole
    if score == "dot":
        value = -(share * (need / whole) * weights).sum(1)
    else:
        value = (((share - need / whole) * weights) ** 2).sum(1)
    return int(fits[np.argmin(value)])


def plan(histogram: np.ndarray, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = WEIGHTS,
         score: str = "norm") -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, offset) that place every piece once.

    ``histogram[l]`` counts the pieces of length l.  The pieces of a length from the row's first rank on (up
    to the next row's) go to the sequences from the first on, so many to each, one behind the other.
    """
    if score not in ("norm", "dot"):
        raise ValueError(f"score is norm or dot, not {score!r}")
    whole, w = capacity.vector(), np.array(weights)
    left = np.zeros((0, 3), np.int64)          # residual capacities of groups of like sequences
    span = np.zeros((0, 2), np.int64)          # first sequence and number of sequences of a group
    rows, opened = [], 0
    for length in np.flatnonzero(histogram)[::-1]:
        length, count, rank = int(length), int(histogram[length]), 0
        need = demand(length)
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens is beyond the capacity of an empty sequence")
        while count:
            g = select(left, need, whole, w, score)
            room = whole if g < 0 else left[g]
            # by norm, the sequence that took a piece stays the best for the next of that length; by dot
            # product its like come first, each with one piece
            each = int((room // need).min()) if g < 0 or score == "norm" else 1
            first, n = (opened, -(-count // each)) if g < 0 else (int(span[g, 0]), int(span[g, 1]))
            full = min(n, count // each)
            part = count - full * each if full < n else 0
            rows.append((length, rank, first, each, int(whole[0] - room[0])))
            rank += full * each + part
            count -= full * each + part
            # the group in up to three: full, part of it, untouched
            new = [(room - each * need, first, full), (room - part * need, first + full, 1 if part else 0),
                   (room, first + full + bool(part), n - full - bool(part) if g >= 0 else 0)]
            if g < 0:
                opened += n
            else:
                left, span = np.delete(left, g, 0), np.delete(span, g, 0)
            keep = [(r, (a, m)) for r, a, m in new if m and r[0] > 0 and r[1] > 0 and r[2] > 0]
            if keep:
                left = np.concatenate([left, [r for r, _ in keep]])
                span = np.concatenate([span, [s for _, s in keep]])
                order = np.argsort(span[:, 0], kind="stable")  # the oldest first: ties
                left, span = left[order], span[order]
    return np.array(rows, np.int64).reshape(-1, 5)


def look_up(rows: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by their length and rank."""
    at = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keys = (at[:, 0] << 44) | at[:, 1]
    hit = at[np.searchsorted(keys, (length << 44) | rank, side="right") - 1]
    inside = rank - hit[:, 1]
    return hit[:, 2] + inside // hit[:, 3], hit[:, 4] + inside % hit[:, 3] * length


def _placer(rows: np.ndarray):
    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = look_up(rows, length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                                          ["sequence_id", "offset"])

    return place


def cut(docs: DataFrame, path: str, size: int, text: str, doc_id: str, end_id: int, keep_ids: bool) -> DataFrame:
    """One row per piece: whole windows of ``size`` tokens, what is over in front of them."""
    fields = {"piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint"}
    fields |= {"ids": "binary"} if keep_ids else {}
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    kind = pa.list_(pa.struct([(n, arrow[t]) for n, t in fields.items()]))

    @F.arrow_udf(f"array<struct<{', '.join(f'{n}: {t}' for n, t in fields.items())}>>")
    def pieces(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(path)
        for texts in parts:
            out = []
            for t in texts:
                ids = np.array([*encode(t.as_py() or ""), end_id], "<u4")
                found, start, end = [], 0, len(ids) % size or size
                while start < len(ids):
                    raw = ids[start:end].tobytes()
                    found.append({"piece": len(found), "start": start, "length": end - start,
                                  "ids_crc32": zlib.crc32(raw), "doc_tokens": len(ids)} | ({"ids": raw} if keep_ids else {}))
                    start, end = end, end + size
                out.append(found)
            yield pa.array(out, kind)

    rows = docs.select(F.struct(F.col(f"`{doc_id}`").alias("id")).alias("doc"), F.col(f"`{text}`").alias("text"))
    return rows.select("doc", F.explode(pieces("text")).alias("p")).select(F.col("doc.id").alias(doc_id), "p.*")


def place(pieces: DataFrame, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = WEIGHTS,
          score: str = "norm") -> DataFrame:
    """``pieces`` (a column ``length`` from 1 to ``capacity.tokens``) with sequence_id and offset."""
    tmp = Scratch(pieces.sparkSession, "best-fit")
    # rows are numbered as they are written: the number tells repeated rows apart, its upper bits the task
    table = tmp.write(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    table = table.withColumn("_part", F.shiftright("_row", 33))
    counts = tmp.write(table.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(capacity.tokens + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``tokens`` rows
        histogram[r["length"]] = r["n"]
    rows = plan(histogram, capacity, weights, score)
    if not len(rows):
        return table.drop("_row", "_part").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_part").orderBy("_row")
    ranked = table.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["length", "_part"])
    at: Column = _placer(rows)("length", F.col("_rank") + F.col("_start"))
    return (ranked.withColumn("_at", at).select(*[f"`{c}`" for c in pieces.columns], "_at.sequence_id", "_at.offset"))


def pack_whole(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = WEIGHTS,
               score: str = "norm", doc_id: str = "doc_id", text: str = "text", end_id: int = 0,
               keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, doc_tokens, (ids,)
    sequence_id, offset.  Documents of more than ``capacity.tokens`` tokens are cut, the rest in front."""
    pieces = cut(docs, tokenizer, capacity.tokens, text, doc_id, end_id, keep_ids)
    return place(pieces, capacity, weights, score)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of ``pack_whole(..., keep_ids=True)``: its ids, where pieces start (with the end, as
    block-diagonal attention kernels take them), and its use of the three capacities."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # bounded by the capacity
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"),
        F.concat(F.col("p.offset"), F.array(F.element_at("p", -1)["offset"] + F.element_at("p", -1)["length"])).alias("starts"),
        F.size("p").alias("documents"),
        F.expr("aggregate(p, 0L, (a, x) -> a + x.length)").alias("tokens"),
        F.expr("aggregate(p, 0L, (a, x) -> a + x.length * x.length)").alias("attention"))
