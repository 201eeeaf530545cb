"""Repair of damaged conversations by depth-first branch and bound.

A conversation's rows, in order, are kept, given another role, deleted, and rows
without text are inserted, until roles read (system)? (user assistant)+ or nothing
is left. Of all ways of least cost the one whose edits' initials (the audit) come
first in ASCII order is wanted.

- A search node is (rows read, what may follow): at the start, after system, after
  user, after assistant. Its moves are tried in the order of their initials from an
  explicit stack, so prefixes come in ASCII order.
- A node's dominance table holds the lowest cost at which it was reached: a later
  prefix that is not cheaper is worse, since it comes later in ASCII order too.
- The suffix bound adds what faults cost in any case and, for every neighbouring
  pair of remaining rows that may not stay neighbours, the least share of an edit
  that parts them (an edit of a row is shared by its two pairs).
- The incumbent (cost, audit) starts from a straight dive. What cannot beat it is
  cut; the search ends when the stack is empty, which proves the incumbent best.

Conversations stream through a task in order, in blocks of ``BLOCK`` rows. A block is
searched from every state in which the rows before it may end, for every state in
which it may end itself; blocks chain by cost, then audit, and what all remaining ways
have in common is put out at once. So a conversation of any length takes little
memory; its audit is one value, and its hash runs over its rows in order, so the rows
of one conversation pass through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import ship_package

REROLE = 3  # to user or assistant
DELETE, INSERT, TRUNCATED = 4, 3, 3
BLANK, DUPLICATE, CUT = 1, 2, 3  # faults; 0: none
START, SYSTEM, USER, ASSISTANT = range(4)
BLOCK = 16  # rows; the search of a block grows with its square

#: what follows a state: a kept row by its role's initial, and the role that may be inserted or given
_KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: what a state can cost more than another one at most, whatever follows: after a turn of the
#: assistant a system row is deleted, a missing turn is inserted
_INSTEAD = ({ASSISTANT: DELETE}, {ASSISTANT: 0}, {ASSISTANT: INSERT}, {USER: INSERT})
_LEGAL = {"su", "ua", "au"}
_SPACES = " \t\n\x0b\x0c\r"

Row = tuple[str, int]  # initial of the role, fault


def bounds(rows: list[Row]) -> tuple[list[int], list[int], list[int]]:
    """For every suffix: what its faults cost at least, twice what its illegal
    pairs cost at least, and its first row that need not be deleted."""
    n = len(rows)
    faults, pairs, follows = [0] * (n + 1), [0] * (n + 1), [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        initial, fault = rows[i]
        after = follows[i + 1]
        if fault in (BLANK, DUPLICATE):
            faults[i], pairs[i], follows[i] = faults[i + 1] + DELETE, pairs[i + 1], after
            continue
        faults[i], follows[i], pairs[i] = faults[i + 1] + TRUNCATED * (fault == CUT), i, pairs[i + 1]
        if after < n and initial + rows[after][0] not in _LEGAL:
            pairs[i] += min(_extra(fault), _extra(rows[after][1]))
    return faults, pairs, follows


def _extra(fault: int) -> int:
    """The least that an edit of a row adds to what its fault costs anyhow."""
    return DELETE - TRUNCATED if fault == CUT else REROLE


def _dive(rows: list[Row], state: int, target: int) -> tuple[int, str] | None:
    """Cost and audit of a fair way to the target, without looking back."""
    if target == START:
        return (DELETE * len(rows), "D" * len(rows)) if state == START else None
    cost, audit = 0, []
    for initial, fault in rows:
        late = TRUNCATED * (fault == CUT)
        if fault not in (BLANK, DUPLICATE) and initial in _KEEP[state]:
            cost, state = cost + late, _KEEP[state][initial]
            audit.append("K")
        elif fault in (BLANK, DUPLICATE) or late:
            cost += DELETE
            audit.append("D")
        else:
            cost, state = cost + REROLE, _NEXT[state]
            audit.append("R")
    for _ in range(3):
        if state == target:
            return cost, "".join(audit)
        cost, state = cost + INSERT, _NEXT[state]
        audit.append("I")
    return None


def search(rows: list[Row], start: int, targets: set[int]) -> dict[int, tuple[int, str]]:
    """Least cost, and the first audit of that cost, of every target state that
    can be reached from ``start``."""
    n = len(rows)
    faults, pairs, follows = bounds(rows)
    best: dict[int, tuple[int, str]] = {}
    limit: dict[int, int] = {}  # a target's prefix that costs so much is cut
    for target in targets:
        if found := _dive(rows, start, target):
            best[target], limit[target] = found, found[0] + 1  # its cost may still have an earlier audit
    early = targets <= {START, SYSTEM}
    reached: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, int, int, tuple | None]] = [(0, start, 0, None)]
    while stack:
        i, state, cost, trail = stack.pop()
        if reached.get((i, state), cost + 1) <= cost or early and state in (USER, ASSISTANT):
            continue
        at = follows[i]
        enters = 0 if at == n or rows[at][0] in _KEEP[state] else _extra(rows[at][1])
        least = cost + faults[i] + (0 if early else (pairs[at] + enters + 1) // 2)
        if len(limit) == len(targets) and least >= max(limit.values()):
            continue
        reached[i, state] = cost
        if i == n and state in targets and cost < limit.get(state, cost + 1):
            audit, step = [], trail
            while step:
                audit.append(step[1])
                step = step[0]
            found = cost, "".join(reversed(audit))
            best[state] = min(best.get(state, found), found)
            limit[state] = cost  # a later prefix of this cost has a later audit
        moves = [(i, _NEXT[state], cost + INSERT, (trail, "I"))]
        if i < n:
            initial, fault = rows[i]
            if fault not in (BLANK, DUPLICATE):
                late = TRUNCATED * (fault == CUT)
                kept = [(i + 1, _KEEP[state][initial], cost + late, (trail, "K"))] if initial in _KEEP[state] else []
                moves = [(i + 1, _NEXT[state], cost + late + REROLE, (trail, "R")), *kept, *moves]
            moves.append((i + 1, state, cost + DELETE, (trail, "D")))
        stack += moves
    return best


def repaired(rows: list[Row]) -> tuple[int, str]:
    """Least cost and first audit for a whole conversation."""
    return min([*search(rows, START, {ASSISTANT}).values(), *search(rows, START, {START}).values()])


def edited(texts: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str, str]]:
    """role, text and edit of what an audit makes of rows (role, text)."""
    out, i = [], 0
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            out.append((_ROLE[state], "", edit))
            continue
        role, text = texts[i]
        i += 1
        if edit == "D":
            continue
        state = _KEEP[state][role[:1]] if edit == "K" else _NEXT[state]
        out.append((role if edit == "K" else _ROLE[state], text, edit))
    return out


# --- one conversation, in a stream ------------------------------------------------

@dataclass
class _Piece:
    """A block's edits and their result."""
    audit: str
    rows: list[tuple[str, str, str]]


@dataclass
class Conversation:
    """Takes rows in order; ``close`` gives the statistics."""
    conv_id: int | None
    gaps: list = field(default_factory=lambda: [None, None, 0])  # least, greatest, distinct turns
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])  # illegal pairs, then by fault
    last: str | None = None
    block: list[tuple[str, str, int]] = field(default_factory=list)
    ways: dict[int, tuple[int, list[_Piece]]] = field(default_factory=lambda: {START: (0, [])})
    audit: list[str] = field(default_factory=list)
    place: int = 0
    digest: object = field(default_factory=hashlib.sha256)

    def add(self, turn: int | None, role: str, text: str, again: bool) -> Iterator[tuple]:
        low, high, n = self.gaps
        if turn is not None and turn != high:
            self.gaps = [turn if low is None else low, turn, n + 1]
        kept = text.rstrip(_SPACES)
        fault = BLANK if not kept else DUPLICATE if again else CUT if kept[-1] not in ".!?" else 0
        initial = role[:1]
        if fault:
            self.counts[fault] += 1
        if self.last is not None and self.last + initial not in _LEGAL:
            self.counts[0] += 1
        self.last = initial
        if len(self.block) == BLOCK:
            yield from self._solve(False)
        self.block.append((role, text, fault))

    def _solve(self, final: bool) -> Iterator[tuple]:
        rows = [(role[:1], fault) for role, _, fault in self.block]
        texts = [(role, text) for role, text, _ in self.block]
        found: dict[int, list] = {}
        for state, (cost, pieces) in self.ways.items():
            for targets in ({START}, {ASSISTANT}) if final else ({START}, {SYSTEM}, {USER, ASSISTANT}):
                for end, way in search(rows, state, targets).items():
                    found.setdefault(ASSISTANT if final else end, []).append((cost + way[0], pieces, way[1], state))
        ways: dict[int, tuple[int, list[_Piece]]] = {}
        for end, some in found.items():
            least = min(f[0] for f in some)
            some = [f for f in some if f[0] == least]
            if len(some) > 1:
                some.sort(key=lambda f: "".join(p.audit for p in f[1]) + f[2])
            cost, pieces, audit, state = some[0]
            ways[end] = cost, [*pieces, _Piece(audit, edited(texts, audit, state))]
        ways = {s: w for s, w in ways.items() if not any(
            w[0] > ways[t][0] + more for t, more in _INSTEAD[s].items() if t in ways)}
        self.ways, self.block = ways, []
        while True:  # what all ways have in common is settled
            heads = [pieces[0] if pieces else None for _, pieces in ways.values()]
            if heads[0] is None or any(h is not heads[0] for h in heads):
                return
            for _, pieces in ways.values():
                del pieces[0]
            yield from self._settle(heads[0])

    def _settle(self, piece: _Piece) -> Iterator[tuple]:
        self.audit.append(piece.audit)
        for role, text, edit in piece.rows:
            self.digest.update((b"\n" if self.place else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield self.conv_id, self.place, role, text, edit
            self.place += 1

    def close(self) -> Iterator[tuple]:
        """The last repaired rows; ``summary`` is complete afterwards."""
        yield from self._solve(True)

    def summary(self) -> tuple:
        low, high, n = self.gaps
        illegal, blank, duplicate, cut = self.counts
        (cost, _), = self.ways.values()
        return (self.conv_id, high - low + 1 - n if n else 0, blank, duplicate, cut, illegal, cost,
                "".join(self.audit), self.digest.hexdigest())


# --- tables -----------------------------------------------------------------------

_SUMMARY = """conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,
    repaired_sha256 string"""
_TURNS = "conv_id long, place long, role string, text string, edit string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows as crc32(conv_id:turn) % 20 damages
    them. Dropped rows stay, marked, so that their conversation is not forgotten.
    A null is one space."""
    def spaced(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _streamed(rows: DataFrame, repaired: bool) -> DataFrame:
    """One shuffle by conversation serves the search for repeated rows and the
    order of turns (null first; at equal turns by role, then text)."""
    ship_package(rows.sparkSession)
    names = ["conv_id", "place", "role", "text", "edit"] if repaired else [
        part.split()[0] for part in _SUMMARY.split(",")]
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    narrow = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], "gone",
    )
    turn = F.col("turn").asc_nulls_first()
    same = Window.partitionBy("conv_id", "role", "text_a", "text_b").orderBy("gone", turn)
    marked = narrow.repartition("conv_id").withColumns({
        "text_a": F.xxhash64("text"), "text_b": F.xxhash64(F.lit(1), "text"),
    }).withColumn("again", F.row_number().over(same) > 1)
    ordered = marked.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "gone", turn, "role", "text")

    def work(batches):
        now: Conversation | None = None

        def result(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)), schema)

        for batch in batches:
            turns, summaries = [], []
            for conv, turn, role, text, gone, again in zip(*(
                batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "again")
            ), strict=True):
                if now is None or conv != now.conv_id:
                    if now:
                        turns += now.close()
                        summaries.append(now.summary())
                    now = Conversation(conv)
                if not gone:
                    turns += now.add(turn, role, text, again)
            out = turns if repaired else summaries
            if out:
                yield result(out)
        if now:
            turns = [*now.close()]
            out = turns if repaired else [now.summary()]
            if out:
                yield result(out)

    kinds = {"long": pa.int64(), "string": pa.string()}
    ddl = _TURNS if repaired else _SUMMARY
    schema = pa.schema([(n, kinds[part.split()[1]]) for n, part in zip(names, ddl.split(","), strict=True)])
    return ordered.select("conv_id", "turn", "role", "text", "gone", "again").mapInArrow(work, ddl)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256 (of the repaired ``role:text`` lines).

    ``rows``: conv_id, turn, role, text and, if given, gone (a row that only says
    that its conversation exists). A null role or text is one space; null ids are one
    conversation; a null turn comes first and makes no gap. A conversation without rows has zeros, an empty audit
    and the hash of nothing. An empty table gives no row; other columns take no part.
    """
    return _streamed(rows, False)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, edit
    (K kept, R given this role, I inserted)."""
    return _streamed(rows, True)
