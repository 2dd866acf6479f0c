"""Token ids in training order, as binary shards.

1. Documents become ids; every task strings its documents together (an end id after each) and cuts
   the string into sequences of ``length`` ids.  The last one of a task is filled with end ids.
2. Sequences are numbered by task and place.  A keyed Feistel permutation of the next power of four
   gives each its slot; numbers at or beyond the count walk on along their cycle until they are in
   range, so the slots are a permutation of 0 .. count-1.
3. Sequences are dealt by range of shard, sorted by slot and written as raw records of
   ``length`` * ``width`` bytes and a line feed: record i of a shard starts at i * (stride).

Shards are directories ``shard=k`` with one file, written through Spark's own writer to any file
system.  They are written in ``passes`` ranges of shards, each committed as a whole (a lost executor's files never
show) and each with its own exchange, which is freed before the next; then the table of payloads goes.  ``read_slots`` starts at any
slot and reads only its shards, so a training run resumes where it stopped.

The table of sequences is written before anything is numbered, so a repeated task cannot change it.

Defined results: null and empty texts are one end id; repeated rows are strung together each; an empty
table has no sequence and no shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentlake.llm.common import Scratch
from talentlake.llm.hashing import mix
from talentlake.llm.tokens import encoder

LENGTH = 4096
SHARD_SEQUENCES = 1024
ROUNDS = 6


def feistel_slots(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """A permutation of 0 .. count-1, chosen by ``key``, applied to ``numbers``."""
    half = np.uint64(max(1, (max(count - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = np.asarray(numbers).astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & mask
        for r in range(ROUNDS):
            seed = mix(np.array([(key * 0x9E3779B97F4A7C15 + r + 1) & 0xFFFFFFFFFFFFFFFF], np.uint64))
            left, right = right, left ^ (mix(right + seed) & mask)
        out[walk] = (left << half) | right
        walk = walk[out[walk] >= count]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Materialised:
    path: str
    count: int
    length: int
    width: int
    shard_sequences: int
    sequences: DataFrame

    @property
    def stride(self) -> int:
        return self.length * self.width + 1


_SEQUENCE = "part int, place long, n_tokens long, doc_ids array<long>, payload binary"


def _strings(path: str, length: int, width: int, end_id: int):
    kind = f"<u{width}"
    fields = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, pack = encoder(path), zstandard.ZstdCompressor(level=3)
        part, place, open_ids, owners = TaskContext.get().partitionId(), 0, np.zeros(0, kind), []
        # some hundred documents at a time: their ids and payloads are held until they are handed over
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), end_id], kind)
                open_ids = np.concatenate([open_ids, ids])
                owners.append(doc)
                at = 0
                while len(open_ids) - at >= length:
                    rows.append((part, place, length, owners, pack.compress(open_ids[at:at + length].tobytes())))
                    at, place = at + length, place + 1
                    owners = [doc] if at < len(open_ids) else []
                open_ids = open_ids[at:]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
        if len(open_ids):
            full = np.concatenate([open_ids, np.full(length - len(open_ids), end_id, kind)])
            row = (part, place, len(open_ids), owners, pack.compress(full.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, fields)], schema=fields)

    return run


def materialise(docs: DataFrame, tokenizer: str, key: int, length: int = LENGTH, width: int = 2, end_id: int = 0,
                shard_sequences: int = SHARD_SEQUENCES, passes: int = 4, doc_id: str = "doc_id", text: str = "text") -> Materialised:
    """Write the shards.  ``width`` is 2 or 4 bytes an id (2 holds vocabularies up to 65536)."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "training-order")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    table = tmp.write(rows.mapInArrow(_strings(tokenizer, length, width, end_id), _SEQUENCE), "sequences")
    # first number of each task: one row of 12 bytes for each, which is broadcast
    sizes = table.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    count = table.count()

    @F.arrow_udf("long")
    def slots(numbers: pa.Array) -> pa.Array:
        return pa.array(feistel_slots(numbers.to_numpy(zero_copy_only=False), count, key))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # the records are larger than their payloads
                part = batch.slice(at, 256)
                records = pa.array([unpack.decompress(p.as_py()) for p in part.column("payload")], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("shard"), records], ["shard", "record"])

    numbered = (table.join(F.broadcast(first), "part").withColumn("slot", slots(F.col("first") + F.col("place")))
                .withColumn("shard", F.floor(F.col("slot") / shard_sequences)))
    listed = tmp.write(numbered.select("slot", "shard", "n_tokens", "doc_ids"), "listed")
    shards = -(-count // shard_sequences)
    path = f"{tmp.root}/shards"
    bounds = [shards * i // passes for i in range(passes + 1)]
    for low, high in zip(bounds, bounds[1:]):
        if low < high:
            (numbered.filter(F.col("shard").between(low, high - 1)).select("shard", "slot", "payload")
             .repartitionByRange(min(high - low, 100_000), "shard").sortWithinPartitions("shard", "slot")
             .select("shard", "payload").mapInArrow(opened, "shard long, record binary")
             .select("shard", F.col("record").cast("string").alias("record"))
             .write.mode("append").partitionBy("shard").option("compression", "none").text(path))
            tmp.release()
    tmp.drop("sequences")
    return Materialised(path, count, length, width, shard_sequences, listed)


def read_slots(spark: SparkSession, made: Materialised, first: int = 0, end: int | None = None) -> DataFrame:
    """(slot, shard, ids) of the slots from ``first`` to ``end``, read from the shards that hold them."""
    end = made.count if end is None else min(end, made.count)
    kind = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("ids", pa.binary())])
    if not made.count:
        return spark.createDataFrame([], "slot long, shard long, ids binary")
    stride, per = made.stride, made.shard_sequences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                shard = int(path.as_py().split("shard=")[1].split("/")[0])
                raw, out = content.as_buffer(), []
                for i in range(len(raw) // stride):
                    if first <= (slot := shard * per + i) < end:
                        out.append((slot, shard, raw[i * stride:(i + 1) * stride - 1].to_pybytes()))
                for i in range(0, len(out), 512):
                    cols = zip(*out[i:i + 512])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind)], schema=kind)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(made.path)
    wanted = files.filter(F.col("shard").between(first // per, max(first, end - 1) // per))
    return wanted.select("path", "content").mapInArrow(run, "slot long, shard long, ids binary")
