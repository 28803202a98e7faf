"""Repair of the turn structure of conversations at least cost.

A conversation's rows, in order, are edited until their role initials read
`(s?(ua)+)?`: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert
(an empty user or assistant row, anywhere) 5.  Blank and duplicate rows must
be deleted; a truncated row that stays costs 5 more.

The cheapest edits are a shortest path over a lattice of (rows read, what was
written last) with small integer costs, found by the auction algorithm: a path
grows from its origin along the arc that its end's price allows (extension) or
retreats and raises the end's price (contraction).  The lattice is solved in
blocks of rows from the end, each block's last prices being exact already, so
time is linear in the conversation's length.  Where prices have converged, an
arc lies on a cheapest path only if it is tight (price = cost + next price);
the edits are traced along tight arcs that lead to the end, the ASCII-least
letter (D, I, K, R) first.

Texts are shuffled once, sorted by conversation and order; the lattice is
solved on a second, slim frame of one code a row, and its edits travel back as
the conversation's first row, so a task holds one code and one letter a row of
a conversation, never its texts.  A conversation is one result row with a
letter for each edit and one hash over its repaired texts in order, so its
rows end in one task, as a stream.

Defined results: null conv_id and null turn are values of their own, turns
null first; rows of one turn stand in order of role, then of their text's
SHA-256; a null role or text is one space; a row whose role is empty has no
initial, so it must be deleted or rewritten, and makes a pair illegal.  Rows
that repeat are duplicates.  A conversation that loses all rows has zeros, no
edits and the hash of the empty string.  No rows give no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .frames import kept

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)  # what was written last
#: From each state: initials that a kept row may have, and the one that a rewritten or new row gets.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
WRITTEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
BLOCK = 8  # rows of the lattice solved at a time
BLANK, DUPLICATE, CUT = 1, 2, 3  # a row's first fault; 0: none
GAP, STOP, ENDING = r"[\x20\x09-\x0D]", "[.!?]", r"[.!?][\x20\x09-\x0D]*\z"


def as_text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with faults planted by
    crc32(`conv_id:turn`) % 20: 0 drops the row (it stays, marked `gone`), 1
    empties its text, 2 removes the text's [.!?], 3 repeats the row, 4 makes its
    role user.  A null role or text is one space, and so are nulls in the key."""
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", STOP, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def arcs(node: tuple[int, int], codes: tuple[tuple[str, int], ...]) -> list[tuple[str, int, tuple[int, int]]]:
    """(letter, cost, next node) of a lattice node: rows read, last written."""
    i, state = node
    written = WRITTEN[state]
    out = [("I", INSERT, (i, written))]
    if i < len(codes):
        initial, fault = codes[i]
        out.append(("D", DELETE, (i + 1, state)))
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            if initial in NEXT[state]:
                out.append(("K", KEEP + more, (i + 1, NEXT[state][initial])))
            out.append(("R", REROLE + more, (i + 1, written)))
    return out


def auction(codes: tuple[tuple[str, int], ...], last: tuple[int | None, ...]) -> dict[tuple[int, int], int]:
    """Prices of the lattice's nodes over the rows of `codes`.  last: what it
    costs from each state behind them (None: it cannot end there).  The prices
    of the four nodes before the first row come out exact, all others low
    enough; a node that is not listed has price 0."""
    price: dict[tuple[int, int], int] = {}
    end = len(codes)
    goal = (end + 1, 0)

    def leaving(node: tuple[int, int]) -> list[tuple[int, tuple[int, int]]]:
        out = [(cost, to) for _, cost, to in arcs(node, codes)]
        if node[0] == end and last[node[1]] is not None:
            out.append((last[node[1]], goal))
        return out

    for state in range(4):
        path = [(0, state)]
        while path[-1] != goal:
            node = path[-1]
            least, to = min((cost + price.get(n, 0), n) for cost, n in leaving(node))
            if price.get(node, 0) < least:  # contraction
                price[node] = least
                if len(path) > 1:
                    path.pop()
            else:                           # extension
                path.append(to)
    return price


@lru_cache(maxsize=1 << 13)
def block(codes: tuple[tuple[str, int], ...], last: tuple[int | None, ...]) -> tuple[dict[tuple[int, int], int], set[tuple[int, int]]]:
    """Prices, and the nodes from which tight arcs lead behind the block."""
    price, end = auction(codes, last), len(codes)
    live = {(end, s) for s in range(4) if last[s] is not None and price.get((end, s), 0) == last[s]}
    for i in range(end, -1, -1):
        for _ in range(4):  # new rows lead on within one place
            for s in range(4):
                if any(to in live and price.get((i, s), 0) == cost + price.get(to, 0) for _, cost, to in arcs((i, s), codes)):
                    live.add((i, s))
    return price, live


def walk(codes: tuple[tuple[str, int], ...], last: tuple[int | None, ...], state: int) -> tuple[list[str], int]:
    """The ASCII-least letters through a block from a state before it, and the
    state behind it.  A block without rows is walked to a state that may end."""
    price, live = block(codes, last)
    node, letters = (0, state), []
    while node[0] < len(codes) or not codes and price.get(node, 0) != last[node[1]]:
        tight = [(letter, to) for letter, cost, to in arcs(node, codes) if to in live and price.get(node, 0) == cost + price.get(to, 0)]
        letter, node = min(tight)
        letters.append(letter)
    return letters, node[1]


def cheapest(codes: list[tuple[str, int]]) -> tuple[int, str]:
    """The least cost of a conversation (initial, fault of each row) and the
    letters of its edits."""
    ends = (0, None, None, 0)
    price, _ = block((), ends)
    last, base, solved = tuple(price.get((0, s), 0) for s in range(4)), 0, []
    for first in range((len(codes) - 1) // BLOCK * BLOCK, -1, -BLOCK) if codes else ():
        rows = tuple(codes[first:first + BLOCK])
        solved.append((rows, last))
        price, _ = block(rows, last)
        exact = [price.get((0, s), 0) for s in range(4)]
        base += min(exact)
        last = tuple(x - min(exact) for x in exact)
    letters, state = [], START
    for rows, after in [*reversed(solved), ((), ends)]:
        more, state = walk(rows, after, state)
        letters += more
    return base + last[START], "".join(letters)


class Conversation:
    """What one task holds of a conversation while its rows go by in order."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.codes, self.before, self.turns, self.first_turn, self.turn = conv_id, [], None, 0, None, None
        self.illegal, self.faults = 0, [0, 0, 0, 0]

    def add(self, r: dict) -> None:
        if r["gone"]:
            return
        here = r["turn"], r["role"], r["tid"]
        first = r["first_turn"] == r["turn"] and self.before != here  # rows that share turn, role and text stand together
        fault = BLANK if r["blank"] else DUPLICATE if not first else CUT if r["cut"] else 0
        initial = r["role"][:1]
        if self.before is not None and (self.before[1][:1], initial) not in LEGAL:
            self.illegal += 1
        if r["turn"] is not None and r["turn"] != self.turn:
            self.turns += 1
            self.turn = r["turn"]
            self.first_turn = r["turn"] if self.first_turn is None else self.first_turn
        self.faults[fault] += 1
        self.before = here
        self.codes.append((initial, fault))

    def result(self) -> dict:
        cost, audit = cheapest(self.codes)
        gaps = self.turn - self.first_turn + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT], "illegal": self.illegal, "cost": cost, "audit": audit}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def solved(schema: pa.Schema):
    """mapInArrow body: slim rows in order -> a row of counts and edits per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if held is None or held.conv_id != r["conv_id"]:
                    done += [held.result()] if held else []
                    held = Conversation(r["conv_id"])
                held.add(r)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([held.result()], schema=schema)

    return run


def edited(schema: pa.Schema, digest: bool):
    """mapInArrow body: each conversation's edits, then its rows in order ->
    its repaired rows, or (digest) its counts, edits and their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, sha, place, at, state = None, None, 0, 0, START

        def written(r: dict | None) -> Iterator[dict]:
            """The rows that the next letters give: new ones up to the letter
            for row r, or to the end."""
            nonlocal at, place, state
            audit = told["audit"]
            while at < len(audit) and (r is None or audit[at] == "I"):
                state = WRITTEN[state]
                yield {"conv_id": told["conv_id"], "place": place, "role": ROLE[state], "text": ""}
                at, place = at + 1, place + 1
            if r is not None:
                letter = audit[at]
                at += 1
                if letter != "D":
                    state = WRITTEN[state] if letter == "R" else NEXT[state][r["role"][:1]]
                    yield {"conv_id": told["conv_id"], "place": place, "role": ROLE[state] if letter == "R" else r["role"], "text": r["text"]}
                    place += 1

        def hashed(rows: Iterator[dict]) -> Iterator[dict]:
            for r in rows:
                sha.update(f"{chr(10) if r['place'] else ''}{r['role']}:{r['text']}".encode())
            return iter(())

        def ended() -> Iterator[dict]:
            if told is None:
                return
            if not digest:
                yield from written(None)
            else:
                hashed(written(None))
                yield {k: told[k] for k in ("conv_id", *COUNTS, "audit")} | {"repaired_sha256": sha.hexdigest()}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["audit"] is not None:
                    out += ended()
                    told, sha, place, at, state = r, hashlib.sha256(), 0, 0, START
                else:
                    out += hashed(written(r)) if digest else written(r)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        yield pa.RecordBatch.from_pylist(list(ended()), schema=schema)

    return run


def repair(conversations: DataFrame, gone: Column | None = None, digest: bool = False) -> DataFrame:
    """The repaired rows (conv_id, place, role, text) of conversations(conv_id,
    turn, role, text); with digest, one row per conversation instead: its gaps,
    faults, cost, edits and the hash of its repaired rows.

    gone: condition of rows that are not there, but whose conversations are."""
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), as_text("role").alias("role"), as_text("text").alias("text"), gone.alias("gone"))
    rows = rows.withColumn("tid", F.unhex(F.sha2("text", 256)))
    slim = kept(rows.select("conv_id", "turn", "role", "tid", "gone", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(ENDING)).alias("cut")))
    least = F.when(F.max(F.col("turn").isNull()), F.lit(None)).otherwise(F.min("turn"))
    first = slim.filter("not gone").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("tid").alias("t")).agg(least.alias("first_turn"))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("tid") == F.col("t"))
    slim = slim.join(first, on, "left").drop("c", "r", "t")
    kind = rows.schema["conv_id"].dataType.simpleString()
    facts = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    order = ["conv_id", "turn", "role", "tid"]
    answers = slim.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(solved(arrow(facts)), facts)
    heads = answers.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("tid"), F.lit("").alias("text"), *COUNTS, "audit")
    body = rows.filter("not gone").select("conv_id", F.lit(1).alias("part"), "turn", "role", "tid", "text", *(F.lit(None).cast("long").alias(c) for c in COUNTS), F.lit(None).cast("string").alias("audit"))
    out = f"{facts}, repaired_sha256 string" if digest else f"conv_id {kind}, place long, role string, text string"
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", *order[1:])
    return both.mapInArrow(edited(arrow(out), digest), out)


def arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))
