"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces, scores and kinds come from a model file.  The text is prepared as the model says (marker in
front, spaces as markers), the trie gives all pieces that start at a character, and the path with the
largest sum of scores wins.  A character that starts no one-character piece costs ``UNKNOWN_PENALTY``
more than the worst piece and is written as its bytes.

No piece of the usual vocabularies holds a marker behind another character, so a text can be cut in
front of each run of markers without changing the best path; the parts (mostly words) are remembered
in a bounded cache.  Models with other pieces are encoded in one part.

Defined results: null and empty texts have no ids and decode to the empty string; ties go to the path
whose last piece starts first; scores are added in double precision.
"""

from __future__ import annotations

import regex
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.session import ship_package

#: fixed: the marker of a space, and what an unknown character costs beyond the worst piece
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 1_000_000
_LOW = float("-inf")


class DoubleArray:
    """Trie over UTF-8 bytes: child of node s by byte b is t = base[s] + b + 1 where check[t] == s."""

    def __init__(self, words: dict[bytes, int]):
        tree: dict = {}
        for word, value in words.items():
            node = tree
            for b in word:
                node = node.setdefault(b + 1, {})
            node[0] = value
        size = 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        free, queue = 1, deque([(0, tree)])
        while queue:
            at, node = queue.popleft()
            value[at] = node.get(0, -1)
            codes = np.array(sorted(c for c in node if c))
            if not len(codes):
                continue
            # first free base, many candidates at a time
            low = free
            while True:
                if low + 5000 >= len(base):
                    base, check, value = (np.concatenate([x, np.full(len(x), f, np.int32)])
                                          for x, f in ((base, 0), (check, -1), (value, -1)))
                cells = low + np.flatnonzero(check[low:low + 4096] < 0)
                bases = cells[cells > codes[0]] - codes[0]
                fits = np.flatnonzero((check[bases[:, None] + codes] < 0).all(1))
                if len(fits):
                    b = int(bases[fits[0]])
                    break
                low += 4096
            while check[free] >= 0:
                free += 1
            base[at] = b
            check[b + codes] = at
            queue.extend((b + int(c), node[int(c)]) for c in codes)
        last = int(np.flatnonzero(check >= 0).max()) + 258
        self.base, self.check, self.value = (x[:last].tolist() for x in (base, check, value))


def zipf_scores(pieces: list[tuple[str, float, str]]) -> list[tuple[str, float, str]]:
    """Normal pieces with log probabilities by Zipf's law, 1 / rank, in the order of their scores."""
    normal = sorted((i for i, p in enumerate(pieces) if p[2] == "normal"), key=lambda i: (-pieces[i][1], i))
    total = sum(1 / r for r in range(1, len(normal) + 1))
    score = {i: float(np.float32(-np.log(r * total))) for r, i in enumerate(normal, 1)}
    return [(p, score.get(i, s), kind) for i, (p, s, kind) in enumerate(pieces)]


class UnigramModel:
    def __init__(self, pieces: list[tuple[str, float, str]], add_prefix: bool = True):
        """``pieces``: (text, score, kind), kind one of normal, byte, unknown, control."""
        self.pieces, self.add_prefix = pieces, add_prefix
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == "unknown"), 0)
        normal = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind == "normal" and p}
        self.trie = DoubleArray(normal)
        self.scores = [s for _, s, _ in pieces]
        self.bad = min((pieces[i][1] for i in normal.values()), default=0.0) - UNKNOWN_PENALTY
        self.cuts = not any(MARKER in p.lstrip(MARKER) for p, _, kind in pieces if kind == "normal")
        self.out = [b"" if kind == "control" else bytes([int(p[3:5], 16)]) if kind == "byte"
                    else " ⁇ ".encode() if kind == "unknown" else p.replace(MARKER, " ").encode()
                    for p, _, kind in pieces]
        self.parts = _LINES if not any("\n" in p for p, _, kind in pieces if kind == "normal") else _PARTS
        self._cache: dict[str, bytes] = {}
        self._arrays = None

    def __getstate__(self):
        return {**self.__dict__, "_cache": {}, "_arrays": None}

    @classmethod
    def from_file(cls, path: str, ranked: bool = False) -> UnigramModel:
        """``ranked``: the file's scores are merge ranks, which become log scores (``zipf_scores``)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)

        def kind(i: int) -> str:
            return ("byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i)
                    else "control" if sp.is_control(i) or sp.is_unused(i) else "normal")

        pieces = [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]
        return cls(zipf_scores(pieces) if ranked else pieces)

    def viterbi(self, part: str) -> list[int]:
        data = part.encode()
        n = len(data)
        best, start, piece = [_LOW] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        at = 0
        while at < n:
            lead = data[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, one, single, node = best[at], at + width, False, 0
            # all pieces that start here: down the trie
            for i in range(at, n):
                b = base[node]
                nxt = b + data[i] + 1
                if not b or check[nxt] != node:
                    break
                node = nxt
                found = value[node]
                if found >= 0:
                    end = i + 1
                    score = here + scores[found]
                    if score > best[end]:
                        best[end], start[end], piece[end] = score, at, found
                    if end == one:
                        single = True
            if not single and here + self.bad > best[one]:
                best[one], start[one], piece[one] = here + self.bad, at, -1
            at = one
        out = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(data[start[n]:n])]
            elif not out or out[-1] != self.unknown:  # neighbouring unknown characters are one
                out.append(self.unknown)
            n = start[n]
        return out[::-1]

    def viterbi_many(self, parts: list[str]) -> list[bytes]:
        """``viterbi`` of many short parts at a time: one step of the trie for all of them."""
        if self._arrays is None:
            t = self.trie
            self._arrays = [np.array(x) for x in (t.base, t.check, t.value, self.scores)]
        base, check, value, scores = self._arrays
        raw = [p.encode() for p in parts]
        size = np.array([len(r) for r in raw])
        longest, n = int(size.max()), len(raw)
        chars = np.frombuffer(b"".join(r.ljust(longest, b"\0") for r in raw), np.uint8).reshape(n, longest).astype(np.int32)
        lead = chars & 0xC0 != 0x80
        width = 1 + (chars >= 0xC0) + (chars >= 0xE0) + (chars >= 0xF0)
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((n, longest + 1), np.int32), np.zeros((n, longest + 1), np.int32)
        for at in range(longest):
            rows = np.flatnonzero((size > at) & lead[:, at])
            single, one = np.zeros(n, bool), at + width[:, at]
            alive, node = rows, np.zeros(len(rows), np.int64)
            for i in range(at, longest):
                b = base[node]
                nxt = b + chars[alive, i] + 1
                ok = (b > 0) & (check[nxt] == node) & (size[alive] > i)
                alive, node = alive[ok], nxt[ok]
                if not len(alive):
                    break
                found = value[node]
                hit = found >= 0
                here, found = alive[hit], found[hit]
                single[here[one[here] == i + 1]] = True
                score = best[here, at] + scores[found]
                better = score > best[here, i + 1]
                here = here[better]
                best[here, i + 1], start[here, i + 1], piece[here, i + 1] = score[better], at, found[better]
            rows = rows[~single[rows]]
            score, end = best[rows, at] + self.bad, one[rows]
            better = score > best[rows, end]
            rows, end = rows[better], end[better]
            best[rows, end], start[rows, end], piece[rows, end] = score[better], at, -1
        # back from the ends, all at a time; parts with unknown characters one by one
        out, place, at = np.full((n, longest), -2, np.int64), np.full(n, longest), size.copy()
        while (open_ := np.flatnonzero(at > 0)).size:
            place[open_] -= 1
            out[open_, place[open_]] = piece[open_, at[open_]]
            at[open_] = start[open_, at[open_]]
        odd = (out == -1).any(1)
        ids = out.astype("<u4")
        return [np.array(self.viterbi(p), "<u4").tobytes() if odd[i] else ids[i, place[i]:].tobytes() for i, p in enumerate(parts)]

    def _solved(self, parts: list[str]) -> dict[str, bytes]:
        short = [p for p in parts if len(p) <= 16]
        out = {p: np.array(self.viterbi(p), "<u4").tobytes() for p in parts if len(p) > 16}
        for i in range(0, len(short), 20_000):
            block = short[i:i + 20_000]
            out.update(zip(block, self.viterbi_many(block)))
        return out

    def _prepared(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = (" " if self.add_prefix else "") + text
        if self.cuts and self.parts is _LINES and "  " not in text:
            # single spaces only: cut in front of each marker and around each line feed
            return text.replace(" ", f" {MARKER}").replace("\n", " \n ").split(" ")
        marked = text.replace(" ", MARKER)
        return self.parts.findall(marked) if self.cuts else [marked]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        cache = self._cache
        if len(cache) >= CACHE:
            cache.clear()
        cut = [self._prepared(t) for t in texts]
        cache[""] = b""
        new = self._solved([*set().union(*[set(parts).difference(cache) for parts in cut])])
        cache.update(new)
        out = [b"".join(map(cache.__getitem__, parts)) for parts in cut]
        for p in new:
            if len(p) > 64:  # hardly ever met again
                del cache[p]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        out = self.out
        raw = b"".join(map(out.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.add_prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


#: a run of markers and what follows up to the next one
_PARTS = regex.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")
#: where no piece holds a line feed it stands alone, too
_LINES = regex.compile(f"\n|{MARKER}*[^{MARKER}\n]+|{MARKER}+")
#: text that is cut into parts at a time
_BATCH_CHARS = 1_000_000


def encode_column(spark, model: UnigramModel, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        out, block, held = [], [], 0
        for t in texts:
            block.append(t.as_py())
            held += len(block[-1] or "")
            if held >= _BATCH_CHARS:
                out += shared.value.encode_many(block)
                block, held = [], 0
        return pa.array(out + shared.value.encode_many(block), pa.binary())

    return encode(text)


def decode_column(spark, model: UnigramModel, ids: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        return pa.array([shared.value.decode(r.as_py() or b"") for r in rows], pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, model: UnigramModel, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in ``out`` (binary, little-endian unsigned 32 bits)."""
    ship_package(docs.sparkSession)
    return docs.withColumn(out, encode_column(docs.sparkSession, model, F.col(f"`{text}`")))


def decode_documents(docs: DataFrame, model: UnigramModel, ids: str = "ids", out: str = "decoded") -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.withColumn(out, decode_column(docs.sparkSession, model, F.col(f"`{ids}`")))
