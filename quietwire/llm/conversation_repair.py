"""Repair of the structure of conversations: a generalised LR parser over the grammar of roles, with weighted edits.

The grammar (an optional system turn, then pairs of user and assistant turns, or nothing) is compiled to LR tables. Turns are read in order; each may be
kept, deleted, or given another role, and empty user and assistant turns may be inserted anywhere. All parses run together on a graph-structured
stack: a parse is a link to its predecessor, so that common beginnings exist once, and parses whose stack tops are equal in all that may follow are merged, the
least (cost, audit) stays. The audit is the text of edits so far (K keep, R rerole, D delete, I insert). Merging is exact because of two beginnings of equal
cost over the same turns none is the beginning of the other. A parse that costs more than another one that could imitate all its ways on is dropped.

Turns reach their parser as a sorted stream, of which it holds the stack only: where all parses share a beginning, its edits and the digest of its repaired turns are
settled and the links dropped. So a conversation of any length takes memory for its audit and what is still open; a digest of a
conversation is sequential, and so is its parse.

Order within a conversation: turn (nulls first), then role, then text. Faults of a turn, the first counts: blank, duplicate (role and text seen before; the first
places come from an aggregation, salted, not from the stream), truncated.

Cases: null role and text count as one space; a null conv_id is a conversation of its own; repeated rows are duplicates of the first; texts of any length are read one
at a time; a conversation without turns gives zeros, an empty audit and the digest of nothing; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.llm.tables import with_group

#: Rules of the role grammar: what each sign may stand for. Small letters are initials of roles.
RULES = {"C": ("sT", "T", ""), "T": ("ua", "Tua")}
NAMES = {"u": "user", "a": "assistant"}
#: What edits cost; a kept or reroled truncated turn costs the last one more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns after which the stack looks for a settled beginning.
SETTLE = 256
#: Fixed value: the characters of ``[\\x20\\x09-\\x0D]``.
BLANKS = " \t\n\v\f\r"


class RoleTables:
    """LR(0) states of a grammar, with end-of-input decisions by an SLR look-ahead of the end only."""

    def __init__(self, rules: Mapping[str, Iterable[str]] = RULES, start: str = "C"):
        self.rules = {sign: tuple(bodies) for sign, bodies in rules.items()}
        self.shift: list[dict[str, int]] = []  # of each state, also over signs of the grammar
        self.reduce: list[tuple[str, int] | None] = []  # rule that is complete whatever follows
        self.at_end: list[list[tuple[str, int]]] = []
        first = self._closed({(start, body, 0) for body in self.rules[start]})
        states, self.start = [first], start
        for items in states:  # grows meanwhile
            moves: dict[str, set] = {}
            for sign, body, dot in items:
                if dot < len(body):
                    moves.setdefault(body[dot], set()).add((sign, body, dot + 1))
            row = {}
            for sign, kernel in sorted(moves.items()):
                after = self._closed(kernel)
                if after not in states:
                    states.append(after)
                row[sign] = states.index(after)
            done = [(sign, len(body)) for sign, body, dot in items if dot == len(body)]
            self.shift.append(row)
            self.reduce.append(done[0] if len(done) == 1 and not row and done[0][0] != start else None)
            self.at_end.append([d for d in done if d[0] == start])
        self.stacks = self._reachable()
        self.kind = self._kinds()
        self.imitation = self._imitations()

    def _closed(self, items: set) -> frozenset:
        while True:
            more = {(sign, body, 0) for _, rule, dot in items if dot < len(rule) for sign in rule[dot] if sign in self.rules for body in self.rules[sign]}
            if more <= items:
                return frozenset(items)
            items = items | more

    def settled(self, stack: tuple[int, ...]) -> tuple[int, ...]:
        """``stack`` after the reductions that do not depend on what follows."""
        while self.reduce[stack[-1]]:
            sign, size = self.reduce[stack[-1]]
            stack = stack[:len(stack) - size]
            stack += (self.shift[stack[-1]][sign],)
        return stack

    def next(self, stack: tuple[int, ...], role: str) -> tuple[int, ...] | None:
        state = self.shift[stack[-1]].get(role) if role not in self.rules else None
        return None if state is None else self.settled(stack + (state,))

    def accepts(self, stack: tuple[int, ...]) -> bool:
        return any(len(stack) - size == 1 for _, size in self.at_end[stack[-1]])

    def _reachable(self, most: int = 1000) -> list[tuple[int, ...]]:
        """All stacks between turns; the grammar must be left-recursive enough for these to be finitely many."""
        roles = sorted({r for row in self.shift for r in row if r not in self.rules})
        self.after: dict[tuple[int, ...], dict[str, tuple[int, ...]]] = {}
        stacks = [(0,)]
        for stack in stacks:  # grows meanwhile
            self.after[stack] = {r: s for r in roles if (s := self.next(stack, r))}
            stacks += [s for s in dict.fromkeys(self.after[stack].values()) if s not in stacks]
            if len(stacks) > most:
                raise ValueError("stacks of this grammar grow with the conversation")
        return stacks

    def _kinds(self) -> dict[tuple[int, ...], int]:
        """Equal numbers for stacks that accept the same roles to come: classes are refined until they are stable."""
        kind = {s: int(self.accepts(s)) for s in self.stacks}
        while True:
            finer = {s: (kind[s], *sorted((r, kind[t]) for r, t in self.after[s].items())) for s in self.stacks}
            number = {k: i for i, k in enumerate(dict.fromkeys(finer.values()))}
            if len(number) == len(set(kind.values())):
                return kind
            kind = {s: number[finer[s]] for s in self.stacks}

    def _imitations(self) -> dict[tuple[int, int], float]:
        """What it costs at most, beyond the other's price, to go on from one kind of stack as the other one does whatever comes: it may insert before, and delete
        what the other one takes."""
        one = {self.kind[s]: s for s in reversed(self.stacks)}
        price = {(b, a): 0.0 for b in one for a in one}
        while True:
            def response(b: int, a: int) -> float:
                worst = 0.0 if self.accepts(one[b]) or not self.accepts(one[a]) else float("inf")
                for role, stack in self.after[one[a]].items():
                    taken = self.after[one[b]].get(role)
                    worst = max(worst, min(DELETE + price[b, self.kind[stack]], price[self.kind[taken], self.kind[stack]] if taken else float("inf")))
                return worst

            direct = {(b, a): response(b, a) for b, a in price}
            for _ in one:  # insertions before
                direct = {(b, a): min([direct[b, a], *(INSERT + direct[self.kind[t], a] for r, t in self.after[one[b]].items() if r in NAMES)]) for b, a in direct}
            if direct == price or max(direct.values()) > 1000:
                return {pair: cost if cost <= 1000 else float("inf") for pair, cost in direct.items()}
            price = direct


TABLES = RoleTables()


@dataclass(slots=True)
class Parse:
    """A stack top: its stack of states, cost, the audit since the last settled beginning, and the last edit with a link to the one before."""

    stack: tuple[int, ...]
    cost: int
    audit: str
    link: tuple | None  # (link before, edit, role or None, text)


class Repair:
    """The graph-structured stack of one conversation and what is settled of it. ``emit`` is called with (edit, role, text) of settled edits, in order."""

    def __init__(self, emit: Callable[[str, str | None, str], None]):
        self.emit, self.turns = emit, 0
        self.settled_audit: list[str] = []
        self.tops: dict[int, Parse] = {}
        self._offer(self.tops, (0,), 0, "", None)

    @staticmethod
    def _offer(tops: dict[int, Parse], stack: tuple[int, ...], cost: int, audit: str, link: tuple | None) -> bool:
        """Merges a parse into ``tops``; whether it became the best of its top."""
        kind = TABLES.kind[stack]
        held = tops.get(kind)
        if held is not None and (held.cost, held.audit) <= (cost, audit):
            return False
        tops[kind] = Parse(stack, cost, audit, link)
        return True

    def _inserted(self) -> None:
        """Insertions before the next turn, until none is a gain."""
        queue = list(self.tops.values())
        for parse in queue:  # grows meanwhile
            if self.tops[TABLES.kind[parse.stack]] is not parse:
                continue
            for role, name in NAMES.items():
                stack = TABLES.next(parse.stack, role)
                if stack and self._offer(self.tops, stack, parse.cost + INSERT, parse.audit + "I", (parse.link, "I", name, "")):
                    queue.append(self.tops[TABLES.kind[stack]])

    def read(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        self._inserted()
        after: dict[int, Parse] = {}
        extra = TRUNCATED if truncated else 0
        for parse in self.tops.values():
            self._offer(after, parse.stack, parse.cost + DELETE, parse.audit + "D", (parse.link, "D", None, text))
            if must_go:
                continue
            kept = TABLES.next(parse.stack, role[:1])
            if kept:
                self._offer(after, kept, parse.cost + KEEP + extra, parse.audit + "K", (parse.link, "K", role, text))
            for initial, name in NAMES.items():
                changed = TABLES.next(parse.stack, initial)
                if changed:
                    self._offer(after, changed, parse.cost + REROLE + extra, parse.audit + "R", (parse.link, "R", name, text))
        self.tops = {a: parse for a, parse in after.items() if not any(other.cost + TABLES.imitation[b, a] < parse.cost for b, other in after.items())}
        self.turns += 1
        if self.turns % SETTLE == 0:
            self._settle(list(after.values()))

    def _settle(self, parses: list[Parse]) -> None:
        """Emits the edits that all ``parses`` share and cuts the links there."""
        paths = []
        for parse in parses:
            path, link = [], parse.link
            while link is not None:
                path.append(link)
                link = link[0]
            paths.append(path[::-1])
        shared = 0
        while all(len(p) > shared and p[shared] is paths[0][shared] for p in paths):
            shared += 1
        if not shared:
            return
        for _, edit, role, text in paths[0][:shared]:
            self.emit(edit, role, text)
        self.settled_audit.append(parses[0].audit[:shared])
        for parse, path in zip(parses, paths):
            link = None
            for _, *edit in path[shared:]:
                link = (link, *edit)
            parse.audit, parse.link = parse.audit[shared:], link
        self._share(parses)

    @staticmethod
    def _share(parses: list[Parse]) -> None:
        """Makes equal beginnings of relinked parses one object again."""
        known: dict[tuple, tuple] = {}
        for parse in parses:
            path, link = [], parse.link
            while link is not None:
                path.append(link)
                link = link[0]
            link = None
            for part in path[::-1]:
                link = known.setdefault((id(link), *part[1:3], id(part[3])), (link, *part[1:]))
            parse.link = link

    def end(self) -> tuple[int, str]:
        """(cost, audit) of the best parse of the whole conversation; its edits are emitted."""
        self._inserted()
        best = min((p for p in self.tops.values() if TABLES.accepts(p.stack)), key=lambda p: (p.cost, p.audit))
        self._settle([best])
        return best.cost, "".join(self.settled_audit)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the damaged rows, and ``absent`` for rows that were dropped and only name their conversation.

    By the crc32 of ``conv_id:turn`` divided by 20: 0 drops the row, 1 empties its text, 2 takes its sentence ends away, 3 repeats it, 4 makes its role user.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    marked = conversations.select("conv_id", "turn", "role", "text", kind.alias("_kind"))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_time")
    return marked.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        (F.col("_kind") == 0).alias("absent"), times).drop("_time")


@dataclass(slots=True)
class _State:
    """What is known of a conversation so far."""

    conv_id: Any
    repair: Repair = None
    digest: Any = field(default_factory=hashlib.sha256)
    kept: int = 0
    before: tuple | None = None
    initial: str | None = None
    turns: list = field(default_factory=lambda: [None, None, 0])  # first, last, how many different ones
    faults: dict = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))
    rows: list = field(default_factory=list)
    given: int = 0  # rows that were handed on

    def take(self, edit: str, role: str | None, text: str) -> None:
        if role is not None:
            self.digest.update(f"{chr(10) if self.kept else ''}{role}:{text}".encode())
            self.kept += 1
        self.rows.append((self.conv_id, edit, role, text if role is not None else None))

    def read(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            if turn != self.turns[1]:
                self.turns[2] += 1
            self.turns[:2] = [turn if self.turns[0] is None else self.turns[0], turn]
        seen = seen or self.before == (turn, role, text)
        end = text.rstrip(BLANKS)[-1:]
        blank, truncated = not end, end not in (".", "!", "?")
        fault = "blank" if blank else "duplicate" if seen else "truncated" if truncated else None
        if fault:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.faults["illegal"] += 1
        self.before, self.initial = (turn, role, text), role[:1]
        self.repair.read(role, text, blank or seen, truncated)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "conv_id long, place long, edit string, role string, text string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_State, bool]]:
    """(conversation, whether it ended) after each batch and each conversation of a sorted stream of rows."""
    state: _State | None = None

    def opened(conv_id: Any) -> _State:
        made = _State(conv_id)
        made.repair = Repair(made.take)
        return made

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "absent", "seen")]
        for conv_id, turn, role, text, absent, seen in zip(*columns):
            if state is None or state.conv_id != conv_id:
                if state is not None:
                    yield state, True
                state = opened(conv_id)
            if not absent:
                state.read(turn, role, text, seen)
        if state is not None:
            yield state, False
    if state is not None:
        yield state, True


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in (p.split()[0] for p in REPORT.split(", "))])
    out: list[tuple] = []
    for state, ended in _read(batches):
        if ended:
            cost, audit = state.repair.end()
            first, last, many = state.turns
            gaps = last - first + 1 - many if many else 0
            out.append((state.conv_id, gaps, *state.faults.values(), cost, audit, state.digest.hexdigest()))
        state.rows.clear()
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    for state, ended in _read(batches):
        if ended:
            state.repair.end()
        if state.rows:
            ids, edits, roles, texts = zip(*state.rows)
            state.given += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(range(state.given - len(ids), state.given), pa.int64()), pa.array(edits), pa.array(roles, pa.string()),
                                              pa.array(texts, pa.string())], schema=schema)
            state.rows.clear()


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out by conversation and sorted within, with ``seen``: role and text stand at an earlier turn."""
    known = F.coalesce(F.col("absent"), F.lit(False)) if "absent" in rows.columns else F.lit(False)
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), known.alias("absent"))
    place: Column = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    keyed = plain.withColumn("_key", F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256)).withColumn("_place", F.when(~F.col("absent"), place))
    grouped = with_group(keyed, "_key", "turn", _first=(F.min("_place"), F.min))
    seen = F.coalesce(F.col("_first") < F.col("_place"), F.lit(False))
    return grouped.select("conv_id", "turn", "role", "text", "absent", seen.alias("seen")).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, maybe ``absent``): gaps, faults, cost and audit of the cheapest repair, digest of the result."""
    return _ordered(rows).mapInArrow(_report, REPORT)


def repaired(rows: DataFrame) -> DataFrame:
    """The edits of every conversation in order (conv_id, place, edit, role, text); without the deleted ones (null role) these are the repaired turns."""
    return _ordered(rows).mapInArrow(_edits, EDITS)
