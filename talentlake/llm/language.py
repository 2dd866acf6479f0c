"""Language identification by compression.

Each language has a raw-content zstandard dictionary cut from training texts.  A text is cut into
blocks of ``BLOCK`` bytes; every block is compressed with every dictionary, and the language with
the smallest total wins: text that shares strings with a dictionary becomes shorter.  The blocks
keep the dictionary useful to the end of long texts, which would otherwise learn from themselves.

The score is a share: 2 ** -(bits more than the smallest, in parts of the sum) over all languages;
a text is ``rejected`` where the two smallest totals are closer than ``MARGIN``.

The dictionaries are fitted on a bounded hash sample (about ``SAMPLE_DOCS`` documents for each
language, ``DICTIONARY_BYTES`` kept); prediction reads every whole text.  A language with fewer or shorter
documents gives longer slices of each; one whose texts cannot fill a dictionary keeps its short one, and
its sizes are divided by its handicap (what the others lose on its texts when cut to its length), so
that the dictionaries of the others stay whole.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the
language with the most training rows; rows with null lang or null doc_id are never learned from.
Without any training row every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.session import ship_package

SAMPLE_DOCS = 300
DICTIONARY_BYTES = 32 * 1024
BLOCK = 2048
#: the first level whose match finder sees short matches; faster levels tell languages apart less well
LEVEL = 6
#: a lead of less than this share of the smallest size is a narrow margin
MARGIN = 0.01
#: lead (share of the total size) at which a language's share of the score halves
HALVES = 0.01
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")


class CompressionModel:
    """One dictionary for each language, in the order in which ties go; compressors are made once in each worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, block: int = BLOCK,
                 handicaps: dict[str, float] | None = None):
        self.languages = list(dictionaries)
        self.dictionaries = [dictionaries[x] for x in self.languages]
        self.level, self.block = level, block
        self.handicaps = np.array([(handicaps or {}).get(x, 1.0) for x in self.languages])
        self._compressors = None

    def __getstate__(self):
        return {**self.__dict__, "_compressors": None}

    def compressors(self):
        if self._compressors is None:
            self._compressors = []
            for raw in self.dictionaries:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._compressors.append(zstandard.ZstdCompressor(
                    dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self._compressors

    def sizes(self, text: bytes) -> np.ndarray:
        blocks = [text[i:i + self.block] for i in range(0, len(text), self.block)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.compressors()], float)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language or ``und``, score, rejected)"""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(text.lower().encode()) / self.handicaps
        best = int(sizes.argmin())
        share = 0.5 ** ((sizes - sizes[best]) / sizes[best] / HALVES)
        lead = np.partition(sizes, 1)[1] / sizes[best] - 1 if len(sizes) > 1 else 1.0
        return self.languages[best], float(share[best] / share.sum()), bool(lead < MARGIN)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def slice_length(lengths: list[int], total: int, least: int) -> int:
    """The smallest slice, from ``least`` up, with which documents of these lengths give ``total`` characters or all they have."""
    left, n = total, len(lengths)
    for length in sorted(lengths):
        if length * n >= left:
            return max(least, -(-left // n))
        left, n = left - length, n - 1
    return max([least, *lengths])


def short_handicaps(dictionaries: dict[str, bytes], **model) -> dict[str, float]:
    """For each dictionary shorter than the longest: how much larger its text gets, in the median, when the longest ones are cut to its length."""
    longest = max(map(len, dictionaries.values()), default=0)
    whole = {code: d for code, d in dictionaries.items() if len(d) >= 0.9 * longest}
    full, out = CompressionModel(whole, **model), {}
    for code, d in dictionaries.items():
        if code not in whole and d:
            cut = CompressionModel({x: w[:len(d)] for x, w in whole.items()}, **model)
            out[code] = max(1.0, float(np.median(cut.sizes(d) / full.sizes(d))))
    return out


def fit_language(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                 sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES, **model) -> CompressionModel:
    """Dictionaries from slices of the sampled documents of each language, equal but for shorter documents.

    A slice is taken from the middle of a document and ends up lower-case; the driver receives the lengths of
    the sampled documents and at most about ``dictionary_bytes`` characters a language.
    """
    ship_package(docs.sparkSession)
    own, name = F.col(f"`{doc_id}`"), F.col(f"`{lang}`")
    learn = docs.filter(own.isNotNull() & name.isNotNull() & F.col(f"`{text}`").isNotNull() & ~held_out(own))
    counts = {r[0]: r[1] for r in learn.groupBy(name.alias("lang")).count().collect()}
    if not counts:
        return CompressionModel({}, **model)
    share = F.lit(0.0)
    for code, n in counts.items():
        share = F.when(name == code, min(1.0, 1.2 * sample_docs / n)).otherwise(share)
    body = F.lower(F.col(f"`{text}`"))
    sampled = learn.filter(F.pmod(F.xxhash64(own, F.lit(4)), F.lit(1 << 30)) < share * (1 << 30))
    lengths: dict[str, list[int]] = {}
    for r in sampled.select(name.alias("lang"), F.char_length(body).alias("n")).collect():
        lengths.setdefault(r.lang, []).append(r.n)
    slice_chars = F.lit(0)
    for code, found in lengths.items():
        slice_chars = F.when(name == code, slice_length(found, dictionary_bytes, max(64, dictionary_bytes // sample_docs))).otherwise(slice_chars)
    start = F.greatest(F.lit(1), F.floor((F.char_length(body) - slice_chars) / 2).cast("int"))
    rows = sampled.select(name.alias("lang"), own.alias("id"), F.substring(body, start, slice_chars).alias("piece")).collect()
    pieces: dict[str, list[bytes]] = {code: [] for code in counts}
    for r in sorted(rows, key=lambda r: (r.lang, str(r.id))):
        pieces[r.lang].append(r.piece.encode())
    full = {code: b"\n".join(p)[:dictionary_bytes] for code, p in pieces.items() if p}
    common = sorted(full, key=lambda code: (-counts[code], code))
    return CompressionModel({code: full[code] for code in common}, handicaps=short_handicaps(full, **model), **model)


def identify_language(docs: DataFrame, model: CompressionModel, text: str = "text") -> DataFrame:
    """``docs`` with ``language`` (a struct: lang_pred, score, rejected), which replaces such a column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pa.Array) -> pa.Array:
        rows = [shared.value.predict(t.as_py()) for t in texts]
        return pa.array([dict(zip(("lang_pred", "score", "rejected"), r)) for r in rows], kind)

    return docs.withColumn("language", predict(F.col(f"`{text}`")))
