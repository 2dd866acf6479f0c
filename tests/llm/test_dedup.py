"""Exact copies, repeated passages and near copies against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talentlake.llm import jaccard as J
from talentlake.llm.exact_dedup import exact_dedup
from talentlake.llm.induced import suffix_array
from talentlake.llm.queries import op3_suffix_dedup
from talentlake.llm.suffix_dedup import remove_repeats

SCHEMA = "doc_id BIGINT, text STRING, name STRING, kept STRING, block STRING, row_id INT"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "n", "k", "b", 1) for i, t in rows], SCHEMA).repartition(parts)


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a long text and its near copy."""
    rng = random.Random(5)
    long = " ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randrange(500)) for _ in range(4000))
    return [(None, "lone words here now ok then"), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b c"), (5, "ab  c"), (6, "abc"), (6, "abc"),
            (7, long), (8, long + " tail"), (9, long.replace(" ", "\n")), (10, "é ü x"), (11, "éü x"), (None, "abc"), (12, "x" * 9000)]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3}, {"block_bytes": 4, "key": lambda b: F.octet_length(b).cast("long")}])
def test_exact_dedup(spark, options):
    rows = odd_rows()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    want = sorted(((i, min(groups[norm(t)])[3], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)
    out = exact_dedup(frame(spark, rows), carry=("name", "kept", "text"), **options).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == want
    assert sum(r.kept for r in out) == len(groups) and {r.name for r in out} == {"n"}


def test_exact_dedup_empty_table(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def cut_by_hand(rows, size):
    raw = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in raw:
        for p in range(len(b) - size + 1):
            seen[b[p:p + size]] = seen.get(b[p:p + size], 0) + 1
    out = []
    for (i, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - size + 1):
            if seen[b[p:p + size]] > 1:
                gone[p:p + size] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        starts = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0
        out.append((i, len(b), len(b) - len(kept), starts, kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [10_000, 0])
def test_repeats_are_cut(spark, hot):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(12)) for _ in range(4)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.3 else word() for _ in range(rng.randrange(0, 25)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "aaaaaaaaaaaaaaaaaaaaaaaaa"), (53, "short"), (54, rows[0][1]), (54, rows[0][1]), (None, rows[1][1]), (55, "äöü " * 20)]
    out = remove_repeats(frame(spark, rows), size=16, gram=5, hot=hot).select("doc_id", "repeats.*", "name").collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out), key=str)
    assert got == cut_by_hand(rows, 16)


def test_repeats_query_returns_what_stays(spark, tmp_path):
    """A reader sees from ``text`` which passages went; ``n_bytes`` is the input's length in every row."""
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(n))
    passage, short = words(60), words(60)[:399]
    rows = [(1, f"{words(20)}<{passage}>{words(20)}"), (2, f"{words(5)}({passage})"), (3, f"{words(9)}<{short}>"), (4, f"{words(7)}({short})"),
            (5, words(80)), (6, None), (7, ""), (8, f"é{passage[::-1]}é!"), (9, f"ä{passage[::-1]}è!"), (10, words(3)), (10, words(50))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = op3_suffix_dedup(spark, str(tmp_path)).collect()
    want = [(i, n, gone, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")) for i, n, gone, runs, kept in cut_by_hand(rows, 400)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    text = {r.doc_id: r.text for r in out}
    assert passage not in text[1] + text[2] and short in text[3] and short in text[4]
    assert text[5] == rows[4][1] and text[6] == text[7] == "" and text[8] == "é\ufffd!"


def test_repeats_empty_table(spark):
    assert remove_repeats(frame(spark, []), size=16, gram=5).count() == 0


def test_suffix_array_with_spilled_queues():
    rng = np.random.default_rng(2)
    for trial in range(60):
        sigma = int(rng.integers(2, 6))
        parts = [np.append(rng.integers(1, sigma, int(rng.integers(1, 40))) if trial % 4 else np.tile([1, sigma - 1], 15), 0) for _ in range(int(rng.integers(1, 5)))]
        text, cap = np.concatenate(parts).astype(np.int64), int(rng.integers(3, 40))
        ends = {p: i for i, p in enumerate(np.flatnonzero(text == 0))}

        def suffix(i):
            end = next(p for p in ends if p >= i)
            return [(1, int(c)) for c in text[i:end]] + [(0, ends[end])]

        want = sorted(range(len(text)), key=suffix)
        order, lcp = suffix_array(text, sigma, cap, memory=int(rng.choice([64, 1 << 20])))
        assert order.tolist() == want
        common = [0]
        for a, b in zip(want, want[1:]):
            x, y = suffix(a), suffix(b)
            common.append(min(cap, next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))))
        assert lcp.tolist() == common


def sets_of(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def components_by_hand(rows):
    sets, root = sets_of(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def near_rows():
    rng = random.Random(3)
    rows = odd_rows()
    for base in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 5, 6, 9, 14, 30, 80, 200]))]
        for copy in range(rng.randrange(1, 7)):
            mine = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
                mine[rng.randrange(len(mine))] = f"w{rng.randrange(3000)}"
            if rng.random() < 0.3:
                mine = mine[:-1] + [f"t{rng.randrange(9)}"]
            words = mine if rng.random() < 0.5 else words  # chains of copies
            rows.append((1000 + base * 10 + copy, " ".join(mine)))
    return rows


def test_jaccard_components(spark):
    rows = near_rows()
    out = J.jaccard_components(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == components_by_hand(rows)


def test_jaccard_hot_signatures_and_small_batches(spark, monkeypatch):
    # read where the plan is made and handed to the tasks
    monkeypatch.setattr(J, "HOT", 2)
    monkeypatch.setattr(J, "FLUSH", 300)
    monkeypatch.setattr(J, "BUCKET", 200)
    rows = near_rows()[15:80]
    out = J.jaccard_components(frame(spark, rows, 1)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == components_by_hand(rows)


def family(n, edits, seed, size=150):
    """Copies of one text with random edits: some pairs are linked, many sets have no partner."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    rows = []
    for i in range(n):
        mine = list(base)
        for _ in range(rng.choice(edits)):
            mine[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        cut = rng.choice([0, 0, 0, 20, 40])
        rows.append((i, " ".join(mine[:size - cut])))
    return rows


def test_jaccard_family_linked_in_some_pairs_only(spark):
    rows = family(120, [0, 1, 2, 3, 4, 5, 6, 7, 9], 1) + [(1000 + i, t) for i, t in family(60, [4, 5, 6], 2)]
    out = J.jaccard_components(frame(spark, rows)).collect()
    want = components_by_hand(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == want
    assert 5 < len({c for *_, c in want}) < 150


def test_shingles_of_a_sets_own_are_counted(spark):
    rows = family(30, [1, 2, 8, 20], 3)
    sets = {J.fingerprint(J.shingles(t)): J.shingles(t) for _, t in rows}
    texts = spark.createDataFrame([(J.fingerprint(J.shingles(t)), t) for _, t in dict.fromkeys(rows)], "set LONG, text STRING").dropDuplicates(["set"])
    described = spark.createDataFrame([(k, len(h)) for k, h in sets.items()], "set LONG, n_shingles LONG")
    held = {}
    for h in sets.values():
        for x in h.tolist():
            held[x] = held.get(x, 0) + 1
    common = {k: sum(held[x] > 1 for x in h.tolist()) for k, h in sets.items()}
    got = {r["set"]: r.common for r in J._with_common(described, texts, J.Scratch(spark, "t-common")).collect()}
    assert got == {k: n for k, n in common.items() if 100 * n >= 80 * len(sets[k])} and 0 < len(got) < len(sets)


def test_similar_sets_share_enough_signatures():
    rng = np.random.default_rng(4)
    for n in [1, 2, 3, 4, 5, 6, 8, 9, 10, 13, 21, 40, 90, 130, 300, 1000]:
        for _ in range(25):
            a = rng.integers(0, 2 ** 63, n, dtype=np.uint64)
            gone = int(rng.integers(0, n // 5 + 1))
            new = int(rng.integers(0, n // 5 + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2 ** 63, new, dtype=np.uint64)]))
            a = np.unique(a)
            common = len(np.intersect1d(a, b))
            if 100 * common < 80 * (len(a) + len(b) - common):
                continue
            shared = len(np.intersect1d(J.signatures(a), J.signatures(b)))
            need = J.least_shared(len(a), len(b), J.empty_groups(a), J.empty_groups(b))
            assert shared >= need >= 1
            for x in (a, b):
                assert shared >= J.least_of(len(x), J.empty_groups(x)) >= 1


def test_one_of_each_keeps_columns_and_lone_rows(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "other words stand here alone ok"), (4, ""), (4, ""), (5, None), (None, "a b c d e f")]
    out = J.one_of_each(frame(spark, rows))
    assert out.columns == [f.strip().split()[0] for f in SCHEMA.split(",")]
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, "a b c d e f"), (2, "other words stand here alone ok"), (4, ""), (4, ""), (5, "")]


def test_jaccard_empty_table(spark):
    assert J.jaccard_components(frame(spark, [])).count() == 0 and J.one_of_each(frame(spark, [])).count() == 0


def test_single_sets_of_a_large_family_are_paired_by_rare_differences(spark):
    # copies just below the threshold to their original, in groups that share their edits and so are like each other
    rng = random.Random(7)
    base, rows = [f"b{i}" for i in range(200)], []
    for group in range(60):
        mine = list(base)
        for at in rng.sample(range(0, 200, 12), 7):
            mine[at] = f"g{group}x{at}"
        for _ in range(rng.choice([1, 1, 1, 2])):
            one = list(mine)
            one[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(one)))
    want = components_by_hand(rows)
    out = J.jaccard_components(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == want
    assert 30 < len({c for *_, c in want}) < len(rows)


def test_sets_around_a_hub(spark):
    rows = family(90, [0, 2, 4, 5, 6, 7, 8], 5)
    sets = {J.fingerprint(J.shingles(t)): J.shingles(t) for _, t in rows}
    texts = spark.createDataFrame([(k, t) for k, t in {J.fingerprint(J.shingles(t)): t for _, t in rows}.items()], "set LONG, text STRING")

    def like(x, y):
        common = len(np.intersect1d(sets[x], sets[y]))
        return 100 * common >= 80 * (len(sets[x]) + len(sets[y]) - common)

    for hub in sorted(sets)[:2]:
        met = spark.createDataFrame([(x, x, hub) for x in sets if x != hub], "x LONG, root LONG, h LONG")
        links, pairs = J._around(met, texts, J.Scratch(spark, "t-around"))
        links = {(r.a, r.b) for r in links.collect()}
        assert all(like(a, b) for a, b in links)
        pairs = [(r.a, r.b) for r in pairs.collect()]
        links |= {(a, b) for a, b in pairs if like(a, b)}
        all_links = {(a, b) for a in sets for b in sets if a < b and like(a, b)}
        assert roots_of(sets, links) == roots_of(sets, all_links)
        assert len(pairs) < len(sets) * (len(sets) - 1) / 8  # and not all pairs


def roots_of(nodes, edges):
    root = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_rows_that_may_be_among_owners(spark):
    rows = spark.createDataFrame([(i if i % 7 else None, i * 31, f"t{i}") for i in range(5000)], "doc_id LONG, text_key LONG, text STRING")
    owners = rows.filter("text_key % 50 = 0").select("doc_id", "text_key")
    some = J._maybe_in(rows, owners)
    assert owners.exceptAll(some.select("doc_id", "text_key")).isEmpty() and some.count() < 700
    assert J._maybe_in(rows, owners.limit(0)).isEmpty()


def test_release_deletes_shuffle_files_of_the_last_step(spark):
    import time

    from talentlake.llm.common import Scratch

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for i in range(found.size()) if (x := found.apply(i).getName()).startswith("shuffle_")}

    tmp, old = Scratch(spark, "release"), files()
    for name in "ab":  # each step's own files, too, not only those of the step before
        tmp.write(spark.range(1000).repartition(3), name)
        assert files() - old
        tmp.release()
        until = time.time() + 4
        while files() - old and time.time() < until:
            time.sleep(0.1)
        assert not files() - old, name


def test_grouped_signatures_lose_sets_without_a_shuffle(spark):
    from talentlake.llm.common import Scratch

    rng = np.random.default_rng(4)
    met = {int(s): np.unique(rng.integers(-9, 9, int(rng.integers(2, 7)))) for s in range(400)}
    met = {s: x for s, x in met.items() if len(x) > 1}
    sigs, sizes = np.array([*met], np.uint64), np.array([len(x) for x in met.values()])
    packed = [*J._groups(sigs, sizes, np.concatenate([*met.values()]).astype(np.int64))]
    groups = spark.createDataFrame(packed, "sigs binary, sizes binary, sets binary")
    hot = spark.createDataFrame([(1000, int(s)) for s in range(-9, 9)], "sig long, member long")
    known = {r.set: r.known for r in J._known(groups, hot).collect()}
    assert known == {s: 1 + sum(s in x for x in met.values()) for s in range(-9, 9)}
    some = [-8, -1, 0, 3, 8]
    left, few = J._of_sets(groups, hot, spark.createDataFrame([(s,) for s in some], "set long"), Scratch(spark, "groups"), "left")
    rows = {(r.sig, r.member) for r in J._rows(left, few).collect()}
    kept = {s: set(x.tolist()) & set(some) for s, x in met.items()}
    assert rows == {(s, m) for s, x in kept.items() if len(x) > 1 for m in x} | {(1000, m) for m in some}
    assert "Exchange" not in J._rows(left, few)._jdf.queryExecution().toString()
    # a signature that is hot in one task and not in another has all its sets once
    none = [None] * len(J._DESCRIBED)
    far = [(0, np.uint64([7, 7, 8, 8]).tobytes(), np.int64([5, 6, 5, 6]).tobytes(), np.array([1, 1, 1, 1], "<u4").tobytes(), *none),
           (0, np.uint64([7]).tobytes(), np.int64([4]).tobytes(), b"", *none), (-1, np.uint64([7, 7]).tobytes(), np.int64([4, 5]).tobytes(), b"", *none)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*far), J._PACKED)], schema=J._PACKED)
    out = pa.Table.from_batches(J._met_in_buckets(iter([batch]))).to_pylist()
    assert {(r["a"], r["b"]) for r in out if r["kind"] == 2} == {(7, 4), (7, 5), (7, 6)}
    assert [r["sigs"] for r in out if r["kind"] == 0] == [np.uint64([8]).tobytes()]
