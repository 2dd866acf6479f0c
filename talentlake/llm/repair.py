"""Conversation structure repair by the cheapest edits.

A conversation is repaired when its role initials read ``(s?(ua)+)?``: nothing, or pairs of user and assistant
after at most one system row.  Edits of a row are Keep (0), Rerole to user or assistant (1) and Delete (2); an
empty-text user or assistant row can be inserted anywhere (5).  A blank row and a row whose role and text were
seen before have to go; a truncated row that stays costs 5 more.  The audit is the edits' initials in order;
of the cheapest audits the least in ASCII is taken.

The search is a bidirectional Dijkstra over the edit lattice, whose nodes are (rows consumed, last role): a
forward heap from the start and a reverse heap from the ends; when their tops together are beyond the best
crossing, every crossing of that cost is finished, and the least concatenation of a forward and a reverse audit
is the result.  Equally cheap audits to one node are never one the start of the other (the rest would be inserts
that cost), so each node needs its least audit only.

Scale: no text is held for a conversation.  Rows are reduced to one letter each (a role initial, and whether
the row must go or is truncated); repeated rows are found by a window over (conversation, role, text), so a long
conversation's rows spread over tasks.  Letters of a conversation come sorted to one task and are solved in
segments of ``SEGMENT`` rows for every role before and after, which a second search joins: memory is a letter a
row and one segment's heaps.  Audits go back to the rows in front of their conversation in one sorted stream,
and the repaired text is hashed as it passes.  What is sequential by definition (an audit, a SHA-256 over a
conversation) is done by one task as a stream; equal letter strings are solved once per task.

Defined results: a null role or text reads as one space (such a text is blank, such a role fits nowhere); rows
of equal turn follow by role, then the SHA-256 of their text; a null turn comes first; a null conv_id is a
conversation of its own; repeated rows are duplicates of each other; a conversation without rows after damage
has zeros, an empty audit and the hash of nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from talentlake.llm.common import Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SEGMENT = 2_000

#: role after which a row stands: nothing yet, system, user, assistant; what may follow
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)

# Letters of rows: s, u, a or x (any other role) for a sound row, upper case for a truncated one, - for one that must go.


def _edges() -> tuple[dict, dict, dict, dict]:
    """Edits by letter and state: of a row forward and backward, then inserts forward and backward."""
    forward: dict = {row: {q: [(DELETE, "D", q)] for q in FOLLOWS} for row in "suaxSUAX-"}
    inserts: dict = {q: [(INSERT, "I", to) for initial, to in after.items() if initial != "s"] for q, after in FOLLOWS.items()}
    for row in "suaxSUAX":
        more = TRUNCATED if row.isupper() else 0
        for q, after in FOLLOWS.items():
            for initial, to in after.items():
                forward[row][q] += [(KEEP + more, "K", to)] if row.lower() == initial else []
                forward[row][q] += [(REROLE + more, "R", to)] if initial != "s" else []

    def turned(edges: dict) -> dict:
        return {q: [(cost, edit, before) for before, found in edges.items() for cost, edit, to in found if to == q] for q in FOLLOWS}

    return forward, {row: turned(edges) for row, edges in forward.items()}, inserts, turned(inserts)


FORWARD, BACKWARD, INSERTS, INSERTS_BACK = _edges()


def search(letters: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest edits of all rows from one state to one of ``ends``."""
    n = len(letters)
    cost = [{(0, start): 0}, {(n, e): 0 for e in ends}]
    audit = [{(0, start): ""}, {(n, e): "" for e in ends}]
    # by cost, then by rows done: an edit without cost takes a row, so a node's audit is final when it is reached
    heaps = [[(0, 0, start)], [(0, 0, e) for e in ends]]
    done: list[set] = [set(), set()]
    best: tuple[int, str] | None = None

    def crossing(node: tuple[int, int]) -> None:
        nonlocal best
        if node in cost[0] and node in cost[1]:
            total = cost[0][node] + cost[1][node]
            if best is None or total <= best[0]:
                found = (total, audit[0][node] + audit[1][node])
                best = found if best is None else min(best, found)

    crossing((0, start))
    while heaps[0] and heaps[1]:
        # a path as cheap as the best crossing has its own crossing before both tops are beyond it
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best[0]:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        so_far, gone, state = heapq.heappop(heaps[side])
        i = gone if side == 0 else n - gone
        if (i, state) in done[side]:
            continue
        done[side].add((i, state))
        trail = audit[side][i, state]
        if side == 0:
            edges = [(c, e, i, q) for c, e, q in INSERTS[state]]
            edges += [(c, e, i + 1, q) for c, e, q in FORWARD[letters[i]][state]] if i < n else []
        else:
            edges = [(c, e, i, q) for c, e, q in INSERTS_BACK[state]]
            edges += [(c, e, i - 1, q) for c, e, q in BACKWARD[letters[i - 1]][state]] if i else []
        for step, edit, at, after in edges:
            node, new = (at, after), so_far + step
            path = trail + edit if side == 0 else edit + trail
            known = cost[side].get(node)
            if known is None or new < known or new == known and path < audit[side][node]:
                cost[side][node], audit[side][node] = new, path
                heapq.heappush(heaps[side], (new, at if side == 0 else n - at, after))
                crossing(node)
    return best


@functools.lru_cache(maxsize=1 << 16)
def _short(letters: str) -> tuple[int, str]:
    return search(letters, START, ENDS)


def repair(letters: str, segment: int = SEGMENT) -> tuple[int, str]:
    """(cost, audit) of a conversation."""
    if len(letters) <= 64:
        return _short(letters)
    if len(letters) <= segment:
        return search(letters, START, ENDS)
    # from the end: the least audit of the rest behind every state, segment by segment
    cuts = range(0, len(letters), segment)
    rest: dict[int, tuple[int, list[str]]] = {e: (0, []) for e in ENDS}
    for begin in reversed(cuts):
        part, new = letters[begin:begin + segment], {}
        for before in FOLLOWS if begin else (START,):
            found = [(c + rest[after][0], [a, *rest[after][1]]) for after in rest if (hit := search(part, before, (after,))) for c, a in [hit]]
            least = min((c for c, _ in found), default=None)
            same = [trail for c, trail in found if c == least]
            if same:
                # pieces are joined only where several rests cost the same
                new[before] = (least, same[0] if len(same) == 1 else [min(map("".join, same))])
        rest = new
    cost, trail = rest[START]
    return cost, "".join(trail)


# --------------------------------------------------------------------------- rows
SPACE = " \t\n\x0b\x0c\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its text,
    2 removes [.!?] from it, 3 repeats it, 4 sets role user.  Nulls read as one space."""
    def read(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    how = (F.crc32(F.concat(read("conv_id"), F.lit(":"), read("turn")).cast("binary")) % 20).cast("int")
    hit = rows.select("conv_id", "turn", read("role").alias("role"), read("text").alias("text"), how.alias("how")).filter("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, nth, fault (blank, duplicate, truncated or null), initial and letter of every row."""
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    narrow = rows.select("conv_id", "turn", "role", digest(F.col("text")).alias("digest"), last.alias("last"))
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    numbered = narrow.withColumn("nth", F.row_number().over(seen))
    fault = (F.when(F.col("last") == "", "blank").when(F.col("nth") > 1, "duplicate")
             .when(~F.col("last").isin(".", "!", "?"), "truncated"))
    initial = F.substring("role", 1, 1)
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    return numbered.withColumns({"fault": fault, "initial": initial}).withColumn(
        "letter", F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    ).drop("last")


def _solver(kind: pa.DataType, segment: int):
    schema = pa.schema([("conv_id", kind), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of conversations -> their faults, cost and audit."""
        out: list[dict] = []
        row: dict | None = None

        def close() -> None:
            cost, audit = repair("".join(word), segment)
            gaps = 0 if low is None else high - low + 1 - turns
            out.append(row | {"gaps": gaps, "cost": cost, "audit": audit})

        for batch in batches:
            for conv, turn, fault, letter, initial in zip(*[batch[c].to_pylist() for c in ("conv_id", "turn", "fault", "letter", "initial")]):
                if row is None or conv != row["conv_id"]:
                    if row is not None:
                        close()
                    row = {"conv_id": conv, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                    low, high, turns, word, before = None, None, 0, [], None
                if turn is not None and (high is None or turn > high):
                    low, high, turns = turn if low is None else low, turn, turns + 1
                if fault:
                    row[fault] += 1
                if before is not None and before + initial not in ("su", "ua", "au"):
                    row["illegal"] += 1
                before = initial
                word.append(letter)
            if len(out) >= 2048:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if row is not None:
            close()
        yield pa.RecordBatch.from_pylist(out, schema)

    return solve


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, role, text) of repaired rows, from rows that follow a row with their conversation's audit.

    An edit is applied as its row passes; inserts come when the next row (or the end) is reached.  A conversation
    starts with a row of role None."""
    audit, at, state, conv = "", 0, START, None

    def inserts() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = ASSISTANT if state == USER else USER
            at += 1
            yield conv, "assistant" if state == ASSISTANT else "user", ""

    for batch in batches:
        for key, plan, role, text in zip(*[batch[c].to_pylist() for c in ("conv_id", "audit", "role", "text")]):
            yield from inserts()
            if plan is not None:
                audit, at, state, conv = plan, 0, START, key
                yield key, None, None
                continue
            edit = audit[at]
            at += 1
            if edit == "K":
                state = FOLLOWS[state][role[0]]
                yield key, role, text
            elif edit == "R":
                state = ASSISTANT if state == USER else USER
                yield key, "assistant" if state == ASSISTANT else "user", text
    yield from inserts()


def _in_parts(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    while True:
        part = list(itertools.islice(rows, size))
        cols = zip(*part) if part else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
        if not part:
            return


def _hashes(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, SHA-256 of its ``role:text`` lines), hashed as the rows pass."""
    conv, running, lines = None, None, 0
    for key, role, text in rows:
        if role is None:
            if running is not None:
                yield conv, running.hexdigest()
            conv, running, lines = key, hashlib.sha256(), 0
            continue
        running.update((("\n" if lines else "") + role + ":" + text).encode())
        lines += 1
    if running is not None:
        yield conv, running.hexdigest()


def _positions(rows: Iterator[tuple]) -> Iterator[tuple]:
    at = 0
    for key, role, text in rows:
        if role is None:
            at = 0
            continue
        yield key, at, role, text
        at += 1


class Repaired:
    """Results of a repair: ``found`` (gaps, faults, cost and audit of each conversation), ``hashes()`` and ``rows()``."""

    def __init__(self, found: DataFrame, rows: DataFrame):
        self.found, self._rows = found, rows
        self._kind = rows.schema["conv_id"].dataType

    def _stream(self, fn, fields: tuple) -> DataFrame:
        no = F.lit(None).cast("string")
        plans = self.found.select("conv_id", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("turn"), "audit",
                                  no.alias("role"), no.alias("text"))
        both = plans.unionByName(self._rows.select("conv_id", F.lit(1).alias("_kind"), "turn", no.alias("audit"), "role", "text"))
        schema = pa.schema([("conv_id", to_arrow_type(self._kind)), *fields])
        names = {pa.int64(): "bigint", pa.string(): "string"}
        spark_schema = ", ".join([f"conv_id {self._kind.simpleString()}", *[f"{n} {names[t]}" for n, t in fields]])
        return (both.withColumn("_digest", digest(F.col("text"))).repartition("conv_id")
                .sortWithinPartitions(F.asc_nulls_first("conv_id"), "_kind", F.asc_nulls_first("turn"), "role", "_digest")
                .select("conv_id", "audit", "role", "text")
                .mapInArrow(lambda batches: _in_parts(fn(_edited(batches)), schema), spark_schema))

    def hashes(self) -> DataFrame:
        """conv_id, repaired_sha256 of the repaired ``role:text`` lines."""
        return self._stream(_hashes, (("repaired_sha256", pa.string()),))

    def rows(self) -> DataFrame:
        """conv_id, position, role, text of the repaired conversations."""
        return self._stream(_positions, (("position", pa.int64()), ("role", pa.string()), ("text", pa.string())))


def repair_conversations(rows: DataFrame, segment: int = SEGMENT) -> Repaired:
    """Repair every conversation of conv_id, turn, role, text."""
    space = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
                       F.coalesce("text", space).alias("text"))
    kind = rows.schema["conv_id"].dataType
    streamed = (faults(rows).repartition("conv_id")
                .sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "nth")
                .select("conv_id", "turn", "fault", "letter", "initial"))
    schema = f"conv_id {kind.simpleString()}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string"
    found = streamed.mapInArrow(_solver(to_arrow_type(kind), segment), schema)
    return Repaired(Scratch(rows.sparkSession, "repair").write(found, "found"), rows)


def damaged_and_repaired(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Every conv_id of the table: faults after damage, cost, audit and hash of the repaired conversation."""
    done = repair_conversations(damage(conversations), segment)
    named = conversations.select("conv_id").distinct()
    joined = (named.alias("n").join(done.found.alias("f"), F.col("n.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
              .join(done.hashes().alias("h"), F.col("n.conv_id").eqNullSafe(F.col("h.conv_id")), "left"))
    return joined.select("n.conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS],
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
