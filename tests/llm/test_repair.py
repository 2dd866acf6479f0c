"""Conversation repair: the search against all edits by dynamic programming, the query against a plain version."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from talentlake.llm import queries as Q
from talentlake.llm import repair as R

SF = "/root/testdata/sf0.01"
WORD = re.compile("(s?(ua)+)?")
BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")


def plain(rows):
    """(cost, audit, repaired rows) of rows (role, text, fault) by relaxing all edits until nothing changes."""
    n = len(rows)
    best = {(0, ""): (0, "", ())}  # (rows consumed, last two initials kept apart by what may follow) -> least
    changed = True
    while changed:
        changed = False
        for (i, out), (cost, audit, kept) in list(best.items()):
            options = [(5, "I", i, (r, "")) for r in ("user", "assistant")]
            if i < n:
                role, text, fault = rows[i]
                options.append((2, "D", i + 1, None))
                if fault not in ("blank", "duplicate"):
                    more = 5 if fault == "truncated" else 0
                    options.append((more, "K", i + 1, (role, text)))
                    options += [(1 + more, "R", i + 1, (r, text)) for r in ("user", "assistant")]
            for step, edit, at, row in options:
                word = out + ((row[0][:1] or "?") if row else "")
                # a start of s?(ua)+ is kept as its last initial
                if not re.fullmatch("s?(ua)*u?", (out and {"s": "s", "u": "u", "a": "ua"}[out]) + word[len(out):]):
                    continue
                node, new = (at, word[-1:]), (cost + step, audit + edit, kept + ((row,) if row else ()))
                if node not in best or new[:2] < best[node][:2]:
                    best[node] = new
                    changed = True
    return min((best[n, q] for q in ("", "a") if (n, q) in best), key=lambda x: x[:2])


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        fault = ("blank" if BLANK.match(text) else "duplicate" if (role, text) in seen
                 else None if text.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else "truncated")
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(table):
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            how = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            rows += [(turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        marked = faults_of(rows)
        turns = {r[0] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = ["".join(r[:1] for r in p) for p in itertools.pairwise(r[1] for r in rows)]
        cost, audit, kept = plain(marked)
        assert WORD.fullmatch("".join(r[:1] for r, _ in kept))
        count = [sum(f == kind for *_, f in marked) for kind in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=repr)


ROLE = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}


def as_rows(word):
    return [(ROLE.get(c.lower(), "user"), "t", "blank" if c == "-" else "truncated" if c.isupper() else None) for c in word]


@pytest.mark.parametrize("n", range(6))
def test_search_equals_all_edits_on_all_short_words(n):
    for word in itertools.product("suaxUA-" if n > 3 else "suaxSUAX-", repeat=n):
        word = "".join(word)
        if n < 4 or zlib.crc32(word.encode()) % 6 == 0:
            assert R.search(word, R.START, R.ENDS) == plain(as_rows(word))[:2], word


def test_search_and_segments_on_long_words():
    rng = random.Random(5)
    for n in (12, 25, 40, 90, 150):
        for _ in range(6):
            word = "".join(rng.choices("suaxSUAX-", (1, 6, 6, 1, 1, 3, 3, 1, 3), k=n))
            want = plain(as_rows(word))[:2]
            assert R.repair(word) == want, word
            for segment in (1, 7, 64):
                assert R.repair(word + "ua" * 40, segment) == R.search(word + "ua" * 40, R.START, R.ENDS)


ODD = [(1, t, "user", x) for t, x in enumerate(["Hi.", "", None, " \n", "No end", "Hi.", "日本 😀", "End! \t"])]
ODD += [(2, None, "assistant", "A."), (2, None, "assistant", "A."), (2, 4, "user", "b?"), (2, 4, None, "b?"), (2, 4, "user", "a!"), (2, 9, "", "z.")]
ODD += [(None, 0, "user", "Q?"), (None, 1, "assistant", "A."), (None, None, None, None), (3, None, "system", "S."), (4, 7, "user", "Q?"), (4, 7, "user", "Q?")]
ODD += [(5, t, ("user", "assistant")[t % 2], f"Turn {t % 70}" + ".!? "[t % 4]) for t in range(300)] + [(6, t, "system", "Same.") for t in range(90)]
ODD += [(c, t, r, f"{r} {t}.") for c in range(10, 60) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"][c % 2:])]
ODD += [(7, 0, "user", "long words. " * 30_000), (7, 1, "assistant", "long words " * 30_000)]
SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, audit INT, cost STRING, letter INT, digest STRING, nth INT, fault INT"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3, 4) for r in rows], SCHEMA).repartition(5)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_conversations_equal_the_plain_version(spark):
    got = tuples(R.damaged_and_repaired(frame(spark, ODD)).select(*Q.REPAIRED))
    assert got == expected(ODD)
    assert tuples(R.damaged_and_repaired(frame(spark, ODD), segment=16).select(*Q.REPAIRED)) == got


def test_the_whole_table_equals_the_plain_version(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert tuples(Q.op12_repair(spark, SF)) == expected(table)


def test_repaired_rows_are_the_text_of_the_hash(spark):
    done = R.repair_conversations(R.damage(frame(spark, ODD)))
    lines = {}
    for r in sorted(done.rows().collect(), key=lambda r: r.position):
        lines.setdefault(r.conv_id, []).append(r)
    for r in done.hashes().collect():
        mine = lines.get(r.conv_id, [])
        assert [x.position for x in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in mine).encode()).hexdigest() == r.repaired_sha256


def test_empty_table_and_other_keys(spark):
    assert R.damaged_and_repaired(frame(spark, [])).collect() == []
    named = frame(spark, ODD[:8]).withColumn("conv_id", __import__("pyspark").sql.functions.lit("c-1"))
    assert [r.conv_id for r in R.damaged_and_repaired(named).collect()] == ["c-1"]
