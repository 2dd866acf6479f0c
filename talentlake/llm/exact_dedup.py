"""Exact deduplication by deterministic block naming (DataFrame functions only).

A text without white space is cut into fixed-size blocks.  The distinct blocks are sorted and get
integer names; then the names of neighbouring blocks are paired, the distinct pairs are sorted and
named again, and so on until each document has one name.  Two documents have the same
(number of blocks, name) if and only if their normalised texts are equal: names stand for whole
blocks or pairs that were compared, not for hashes of them.

A block's 64-bit key only finds its name: where two distinct blocks of the corpus share a key,
the block itself is compared (``_look_up``).

Scale: the text is shuffled once, after the map side has merged equal blocks; everything after
that is narrow (row, position, name).  A hot block or pair arrives as one row per map task, and
the joins that bring names back have an exchange on both sides, which AQE splits.

Defined results: null text counts as empty; empty texts are equal to each other; a null doc_id is
taken last among ties; repeated rows are rows of one group, of which one stays.  A carried column
with the name of a result column gives way to the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.llm.common import WHITESPACE, Scratch

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, "")


def _names(keys: DataFrame, *cols: str) -> DataFrame:
    """Distinct rows of ``cols``, sorted in their partition, each with an integer ``name``."""
    distinct = keys.groupBy(*cols).agg(F.count(F.lit(1)).alias("occurrences"))
    return distinct.sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())


def _look_up(blocks: DataFrame, tmp: Scratch, key: Callable[[Column], Column]) -> DataFrame:
    """(row_id, n_blocks, pos, name) of every block."""
    names = tmp.write(_names(blocks, "block").select(key(F.col("block")).alias("key"), "name"), "block_names")
    per_key = names.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    by_key = (blocks.select("row_id", "n_blocks", "pos", key(F.col("block")).alias("key"))
              .join(per_key, "key"))
    alone = by_key.filter("n = 1").select("row_id", "n_blocks", "pos", "name")
    shared = per_key.filter("n > 1").select("key")
    if shared.isEmpty():
        return alone
    # distinct blocks with one key: named by their text, below all other names
    same = blocks.withColumn("key", key(F.col("block"))).join(shared, "key")
    own = _names(same, "block").select("block", (-1 - F.col("name")).alias("name"))
    return alone.unionByName(same.join(own, "block").select("row_id", "n_blocks", "pos", "name"))


def name_documents(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES,
                   key: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame, Scratch]:
    """(documents, names): row_id and doc (a struct of all columns); row_id, n_points, text_sha256,
    n_blocks and name.

    ``n_blocks`` and ``name`` together are the identity.  ``key`` maps a block to the long by which
    its name is found.
    """
    tmp = Scratch(docs.sparkSession, "exact-dedup")
    table = tmp.write(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct("*").alias("doc")), "documents")
    body = F.col(f"doc.`{text}`")
    described = tmp.write(
        table.select("row_id", F.char_length(F.coalesce(body, F.lit(""))).cast("long").alias("n_points"), normalised(body).alias("norm"))
        .select("row_id", "n_points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
                F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / block_bytes)).cast("int").alias("n_blocks")), "described")
    cut = table.select("row_id", normalised(body).cast("binary").alias("bytes")).withColumn(
        "n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block_bytes)).cast("int"))
    blocks = cut.select("row_id", "n_blocks", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1),
        lambda i: F.substring("bytes", i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block"))
    level = tmp.write(_look_up(blocks, tmp, key), "level0")
    done, width, at = [], 1, 0
    tmp.release()
    most = described.agg(F.max("n_blocks")).first()[0] or 0
    while True:
        done.append(level.filter(F.col("n_blocks") <= width).select("row_id", "name"))
        if width >= most:
            break
        width, at = width * 2, at + 1
        even = F.col("pos") % 2 == 0
        pairs = (level.filter(F.col("n_blocks") > width // 2)
                 .groupBy("row_id", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("at"))
                 .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b")))
        # a last block without neighbour: a flag, since names may be any long
        pairs = tmp.write(pairs.select("row_id", "n_blocks", F.col("at").alias("pos"), "a",
                                       F.coalesce("b", F.lit(0)).alias("b"), F.col("b").isNull().alias("single")),
                          f"pairs{at}")
        named = pairs.join(_names(pairs, "a", "b", "single"), ["a", "b", "single"])
        level = tmp.write(named.select("row_id", "n_blocks", "pos", "name"), f"level{at}")
    identity = done[0]
    for part in done[1:]:
        identity = identity.unionByName(part)
    return table, described.join(identity, "row_id"), tmp


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = (),
                **options) -> DataFrame:
    """All documents with their group: keep_id, group_size, kept, text_sha256.

    Of equal texts (after deleting white space) the row with the most code points in the original
    text, then the smallest doc_id, stays.
    """
    own = tuple(dict.fromkeys((doc_id, *carry)))
    table, named, tmp = name_documents(docs.select(*[f"`{c}`" for c in dict.fromkeys((*own, text))]), text, **options)
    # the texts stay behind: groups are formed of narrow rows
    named = tmp.write(named.join(table.select("row_id", F.col("doc")[doc_id].alias("id")), "row_id"), "identities")
    best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("id").isNull().alias("no_id"), "id",
                          F.col("row_id").alias("row"))).alias("best")
    groups = named.groupBy("n_blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), best)
    results = {"keep_id": F.col("best.id"), "group_size": F.col("group_size"),
               "kept": F.col("row_id") == F.col("best.row"), "text_sha256": F.col("text_sha256"),
               "n_points": F.col("n_points"), "n_blocks": F.col("n_blocks")}
    decided = tmp.write(named.join(groups, ["n_blocks", "name"]).select("row_id", *[c.alias(n) for n, c in results.items()]), "decided")
    tmp.keep_only("documents", "decided")
    tmp.release()
    return table.select("row_id", F.struct(*[F.col("doc")[c].alias(c) for c in own]).alias("doc")).join(decided, "row_id").select(
        *[F.col("doc")[c].alias(c) for c in own if c not in results], *results)
