"""Repair of turn order in conversations and their rendering, by minimum cost.

A legal conversation is an optional system turn, then user and assistant turns by turns, user first. A dynamic program over
the automaton of legal turns meets each turn of a conversation in order and gives it a role: its own, user or assistant (a relabel); as
a new turn, as part of the turn before (a merge), or after empty turns put in between (insertions). The least
total cost wins; of equal ones the one with fewest insertions, then fewest relabels, then the smallest earlier role at the last
difference, a merge before a new turn.

Turns are ordered by turn, then role, then text, nulls first. A conversation is read as a stream: where the best ways to all states
have one beginning in common, that beginning is settled and given out, so that memory is bounded for any length. No turn becomes a system turn that was none. Unknown
and null roles cost a relabel whatever they become; null text is empty. Null conversation ids make one conversation. Repeated rows are turns of their own.
An empty table has no conversations. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, partitions

ROLES = ("system", "user", "assistant")
_SYSTEM, _USER, _ASSISTANT, _START = range(4)
_NEXT = {_START: (_SYSTEM, _USER), _SYSTEM: (_USER,), _USER: (_ASSISTANT,), _ASSISTANT: (_USER,)}


def _between() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest empty turns that lead from a state to a new turn of a role."""
    out = {}
    for s in range(4):
        ways = [(s, ())]
        seen: set[int] = set()
        while ways:
            at, inserted = ways.pop(0)
            for r in _NEXT[at]:
                if r not in seen:
                    seen.add(r)
                    out[s, r] = inserted
                    ways.append((r, (*inserted, r)))
    return out


_BETWEEN = _between()


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    relabel: int = 2
    insert: int = 3


_BITS = 20


@dataclass
class Repair:
    """One conversation, turn by turn. settled() gives out what can no longer change."""

    costs: Costs = field(default_factory=Costs)

    def __post_init__(self):
        self.cost = {_START: 0}
        self.back: list[dict[int, tuple[int, bool]]] = []
        self.turns: list[tuple[int, str]] = []

    def _price(self, merge: int, relabel: int, insert: int) -> int:
        """Cost, then insertions, then relabels, as one number."""
        c = self.costs
        return (c.merge * merge + c.relabel * relabel + c.insert * insert << 80) + (insert << 40) + relabel

    def add(self, role: int, text: str) -> None:
        new: dict[int, int] = {}
        back: dict[int, tuple[int, bool]] = {}
        for r in range(3):
            if r == _SYSTEM != role:
                continue
            relabel = int(r != role)
            ways = [(self.cost[s] + self._price(int(m), relabel, 0 if m else len(_BETWEEN[s, r])), s, not m) for s in sorted(self.cost) for m in (True, False) if (s == r if m else (s, r) in _BETWEEN)]
            if ways:
                new[r], s, fresh = min(ways)
                back[r] = (s, fresh)
        self.cost = new
        self.back.append(back)
        self.turns.append((role, text))

    def _trace(self, state: int, n: int) -> list[tuple[int, int, bool]]:
        out = []
        for back in reversed(self.back[:n]):
            before, fresh = back[state]
            out.append((before, state, fresh))
            state = before
        return out[::-1]

    def _give(self, path: list[tuple[int, int, bool]]) -> Iterator[tuple[int, bool, int, str]]:
        """(role, whether a new turn begins, own role or -2 for an empty one, text)."""
        for (before, state, fresh), (role, text) in zip(path, self.turns, strict=False):
            if fresh:
                for r in _BETWEEN[before, state]:
                    yield r, True, -2, ""
            yield state, fresh, role, text

    def settled(self) -> list[tuple[int, bool, int, str]]:
        at = set(self.cost)
        for n in range(len(self.back), 0, -1):
            if len(at) == 1:
                out = list(self._give(self._trace(next(iter(at)), n)))
                self.back, self.turns = self.back[n:], self.turns[n:]
                return out
            at = {self.back[n - 1][s][0] for s in at}
        return []

    def finish(self) -> tuple[int, list[tuple[int, bool, int, str]]]:
        """The total cost and the rest."""
        ends = [(c + (self._price(0, 0, 1) if s == _SYSTEM else 0), s) for s, c in self.cost.items()]
        total, state = min(ends)
        out = list(self._give(self._trace(state, len(self.back))))
        if state == _SYSTEM:
            out.append((_USER, True, -2, ""))
        return total >> 80, out


#: A fixed format: how a turn is rendered.
OPEN, SEPARATE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
_SETTLE = 256


def _turns(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[tuple]:
    """(conversation, None or its total cost, part) in order; part as Repair gives it."""
    number = {r: i for i, r in enumerate(ROLES)}
    key: object = _turns
    repair = Repair(costs)
    for batch in batches:
        for conv, role, raw in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), as_bytes(batch["text"]), strict=True):
            if conv != key:
                if key is not _turns:
                    total, rest = repair.finish()
                    yield from ((key, None, x) for x in rest)
                    yield key, total, None
                key, repair = conv, Repair(costs)
            repair.add(number.get(role, -1), raw.decode())
            if len(repair.turns) >= _SETTLE:
                yield from ((key, None, x) for x in repair.settled())
    if key is not _turns:
        total, rest = repair.finish()
        yield from ((key, None, x) for x in rest)
        yield key, total, None


def _rendered(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[tuple]:
    """(conversation, None or (cost, source turns), rendered text, role, begins, own role)."""
    n, begun = 0, False
    for key, total, part in _turns(batches, costs):
        if part is None:
            yield key, (total, n), CLOSE if begun else "", None, False, None
            n, begun = 0, False
            continue
        role, fresh, own, text = part
        n += own != -2
        head = (CLOSE if begun else "") + OPEN + ROLES[role] + SEPARATE if fresh else "\n"
        begun = True
        yield key, None, head + text, role, fresh, own


_DIGEST = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("n_repaired", pa.int64()), ("cost", pa.int64()), ("n_merged", pa.int64()), ("n_relabelled", pa.int64()), ("n_inserted", pa.int64()), ("n_chars", pa.int64()), ("roles_sha256", pa.string()), ("rendered_sha256", pa.string())]
_PARTS = [("conv_id", pa.int64()), ("part", pa.int64()), ("role", pa.string()), ("begins", pa.bool_()), ("inserted", pa.bool_()), ("rendered", pa.string())]


def _batch(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def _digests(costs: Costs):
    def run(batches):
        rows, roles, text = [], hashlib.sha256(), hashlib.sha256()
        fresh_n = merged = relabelled = inserted = chars = 0
        for key, end, part, role, fresh, own in _rendered(batches, costs):
            text.update(part.encode())
            chars += len(part)
            if end is None:
                fresh_n += fresh
                merged += not fresh
                inserted += own == -2
                relabelled += own not in (-2, role)
                if fresh:
                    roles.update(ROLES[role][:1].encode())
                continue
            rows.append((key, end[1], fresh_n, end[0], merged, relabelled, inserted, chars, roles.hexdigest(), text.hexdigest()))
            roles, text = hashlib.sha256(), hashlib.sha256()
            fresh_n = merged = relabelled = inserted = chars = 0
            if len(rows) >= 4096:
                yield _batch(rows, _DIGEST)
                rows = []
        yield _batch(rows, _DIGEST)

    return run


def _parts(costs: Costs):
    def run(batches):
        rows, n = [], 0
        for key, end, part, role, fresh, own in _rendered(batches, costs):
            if part:
                rows.append((key, n, ROLES[role] if role is not None else None, bool(fresh), own == -2, part))
            n = 0 if end else n + 1
            if len(rows) >= 1024:
                yield _batch(rows, _PARTS)
                rows = []
        yield _batch(rows, _PARTS)

    return run


def _lined(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    n = partitions(conversations.sparkSession)
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_chat(conversations: DataFrame, costs: Costs | None = None) -> DataFrame:
    """The rendered conversations in parts: concatenating rendered by part gives a conversation's whole text.

    Columns conv_id, part, role, begins (a turn begins), inserted (an empty turn put in), rendered.
    """
    return _lined(conversations).mapInArrow(_parts(costs or Costs()), "conv_id long, part long, role string, begins boolean, inserted boolean, rendered string")


def chat_digests(conversations: DataFrame, costs: Costs | None = None) -> DataFrame:
    """Per conversation what its repair did, and digests of its roles (first letters) and rendered text."""
    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in _DIGEST)
    return _lined(conversations).mapInArrow(_digests(costs or Costs()), schema)
