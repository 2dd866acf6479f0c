"""Documents as token ids: byte-level BPE from a tokenizer file, cut into pieces.

``encoder(path)`` reads the tokenizer's own JSON file.  Where the file describes a plain byte-level
BPE (no normaliser, the usual split pattern), tiktoken runs the same vocabulary, several times as
fast and with equal ids (tested); texts that hold an added token's string, and all other
tokenizers, go through the ``tokenizers`` library.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentlake.session import ship_package

#: fixed: the split pattern of byte-level BPE
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: a white-space run beyond this goes through ``tokenizers``: the pattern's look-ahead walks back over it
_LONG_SPACE = 10_000


def _byte_of() -> dict[str, int]:
    """The printable character by which a byte-level vocabulary writes each byte, inverted."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + i)] = b
    return out


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    """Loaded at the first text that needs it: it takes more memory than the fast encoder."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""
    def slow(text: str) -> list[int]:
        return _tokenizer(path).encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    if not (spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space") and split.get("use_regex", True) and spec["model"].get("dropout") is None):
        return slow
    import tiktoken

    added = [t["content"] for t in spec.get("added_tokens", [])]
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
    fast = tiktoken.Encoding("byte-level", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(t in text for t in added) or " " * _LONG_SPACE in text or "\n" * _LONG_SPACE in text:
            return slow(text)
        return fast.encode_ordinary(text)

    return encode


PIECE_SCHEMA = "start long, length long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, path: str, size: int, text: str = "text", keys: tuple[str, ...] = ("doc_id",),
           end_id: int = 0) -> DataFrame:
    """One row per piece: ``keys``, start, length, doc_tokens and ids (little-endian unsigned 32 bits).

    A document is its ids and ``end_id`` after them; null text counts as empty.  Pieces are whole
    windows of ``size`` tokens and what is left at the end.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("doc"), F.col(f"`{text}`").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]))

    @F.arrow_udf("array<struct<start: bigint, length: bigint, doc_tokens: bigint, ids: binary>>")
    def cut(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(path)
        for texts in parts:
            out = []
            for t in texts:
                ids = np.array([*encode(t.as_py() or ""), end_id], "<u4")
                out.append([{"start": i, "length": min(size, len(ids) - i), "doc_tokens": len(ids),
                             "ids": ids[i:i + size].tobytes()} for i in range(0, len(ids), size)])
            yield pa.array(out, kind)

    # a few hundred documents at a time keep the ids of a batch small
    return rows.select("doc", F.explode(cut("text")).alias("piece")).select(
        *[F.col("doc")[k].alias(k) for k in keys], "piece.*")
