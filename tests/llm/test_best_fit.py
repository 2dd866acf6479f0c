"""Vector best-fit packing against placing piece by piece, and whole round trips."""

import zlib

import numpy as np
import pytest

from talentlake.llm import best_fit as B
from talentlake.llm import queries as Q
from talentlake.llm.tokens import encoder

SF = "/root/testdata/sf0.001"


def place_one_by_one(lengths, capacity, weights, score):
    """Residuals of all sequences after placing the pieces one by one, longest first."""
    whole, w, left = capacity.vector(), np.array(weights), np.zeros((0, 3), np.int64)
    for n in sorted(lengths, reverse=True):
        g = B.select(left, B.demand(int(n)), whole, w, score)
        if g < 0:
            left = np.concatenate([left, [whole - B.demand(int(n))]])
        else:
            left[g] -= B.demand(int(n))
    return left


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [B.Capacity(64), B.Capacity(64, 5), B.Capacity(64, attention=1700), B.Capacity(64, 4, 1700)])
@pytest.mark.parametrize("weights", [B.WEIGHTS, (1.0, 1.0, 1.0)])
def test_plan_equals_placing_one_by_one(score, capacity, weights):
    lengths = np.clip(np.random.default_rng(7).lognormal(2.3, 0.9, 400).astype(int), 1, 41)
    histogram = np.bincount(lengths, minlength=65)
    rows = B.plan(histogram, capacity, weights, score)
    placed = [B.look_up(rows, np.full(n, length), np.arange(n)) + (np.full(n, length),) for length, n in enumerate(histogram) if n]
    seq, offset, length = map(np.concatenate, zip(*placed))
    used = np.stack([np.bincount(seq, length), np.bincount(seq), np.bincount(seq, length * length)], 1).astype(np.int64)
    assert (used <= capacity.vector()).all()
    expected = place_one_by_one(lengths, capacity, weights, score)
    assert sorted(map(tuple, capacity.vector() - used)) == sorted(map(tuple, expected))
    at = np.lexsort((offset, seq))
    ends = np.r_[0, (offset + length)[at][:-1]]
    assert (offset[at] == np.where(np.r_[True, np.diff(seq[at]) > 0], 0, ends)).all()


def test_a_piece_beyond_the_capacity_is_refused():
    with pytest.raises(ValueError):
        B.plan(np.bincount([50]), B.Capacity(64, attention=2000))
    with pytest.raises(ValueError):
        B.plan(np.bincount([5]), B.Capacity(64), score="first")


def check_packed(rows, texts, size):
    """Pieces of every document in order, ids right, sequences without gaps."""
    encode = encoder(Q.tokenizer_path())
    expected = []
    for key, text in texts:
        ids = np.array([*encode(text or ""), 0], "<u4")
        first = len(ids) % size or size
        starts = [0, *range(first, len(ids), size)]
        expected += [(repr(key), i, s, e - s, zlib.crc32(ids[s:e].tobytes())) for i, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return by_sequence


def test_every_piece_of_the_table_is_placed_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = Q.op11_best_fit(spark, SF).collect()
    found = check_packed(rows, [(r.doc_id, r.text) for r in docs], 2048)
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(found) <= least + 1


def test_odd_rows_and_tight_capacities(spark):
    odd = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "word"), (5, "word"), (None, "word again"),
           (7, "long words " * 3_000), (8, "日本語 😀 é")] + [(100 + i, "same words") for i in range(40)]
    schema = "doc_id BIGINT, text STRING, length STRING, piece INT, sequence_id STRING, _row INT, offset INT"
    frame = spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in odd], schema).repartition(3)
    capacity = B.Capacity(128, 6)
    packed = B.pack_whole(frame, Q.tokenizer_path(), capacity, keep_ids=True)
    found = check_packed(packed.collect(), odd, 128)
    assert max(map(len, found.values())) <= 6
    rows = {r.sequence_id: r for r in B.sequences(packed).collect()}
    assert set(rows) == set(found)
    for key, parts in found.items():
        r = rows[key]
        assert list(r.starts) == [o for o, _ in sorted(parts)] + [sum(n for _, n in parts)]
        assert (len(r.ids) // 4, r.documents, r.attention) == (r.tokens, len(parts), sum(n * n for _, n in parts))
    nothing = B.pack_whole(frame.filter("false"), Q.tokenizer_path(), capacity)
    assert nothing.collect() == [] and nothing.columns == [c for c in packed.columns if c != "ids"]
