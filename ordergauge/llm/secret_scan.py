"""Secret scans: all rules as one automaton, one pass over the bytes of a text.

The rule patterns become NFAs, a subset construction over all of them at once gives one deterministic automaton, and
minimisation merges its equal states. What is left is an array: next state by state and byte. A text is scanned once,
whatever the number of rules; states in which some rule has matched are numbered last, so that the loop tests one
number. Where a match ends, the rule's reversed automaton walks back to its start.

The automaton searches as a leftmost, longest regular expression does: a rule in a match starts no other, and the next
match begins at or after the end of the last. Rules must stay in accepting states until their match ends, and a later
start must not match before an earlier one; ``compile_rules`` refuses others.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import same_schema, small, with_arrays


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and how many bytes ``group`` of a match needs at least."""

    kind: str
    pattern: bytes
    least: int = 1
    group: int = 0


BASE_RULES = (
    Rule(
        "assign",
        rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
        2,
    ),
    Rule("access", rb"AKIA[A-Z0-9]+", 16),
    Rule("hex", rb"[0-9a-f]{32,}", 32),
)
OWN_RULES = (
    Rule("private_key", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repository_token", rb"gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("chat_token", rb"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("payment_key", rb"sk_live_[A-Za-z0-9]+", 24),
    Rule("web_token", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + OWN_RULES


class Nfa:
    """Thompson's automaton of a pattern: empty moves and moves on byte sets, from state 0 to ``end``."""

    def __init__(self, pattern: bytes):
        self.empty: list[set[int]] = [set()]
        self.moves: list[list[tuple[frozenset[int], int]]] = [[]]
        self.end = self._add(parser.parse(pattern), 0, False)

    def _state(self) -> int:
        self.empty.append(set())
        self.moves.append([])
        return len(self.moves) - 1

    def _on(self, codes: set[int], at: int, fold: bool) -> int:
        if fold:
            codes = {x for c in codes for x in bytes([c]).lower() + bytes([c]).upper()}
        self.moves[at].append((frozenset(codes), to := self._state()))
        return to

    def _add(self, tree, at: int, fold: bool) -> int:
        for kind, value in tree:
            if kind is op.LITERAL:
                at = self._on({value}, at, fold)
            elif kind is op.IN:
                codes: set[int] = set()
                for part, x in value:
                    if part is op.LITERAL:
                        codes.add(x)
                    elif part is op.RANGE:
                        codes.update(range(x[0], x[1] + 1))
                    else:
                        raise ValueError(f"not supported in a class: {part}")
                at = self._on(codes, at, fold)
            elif kind is op.SUBPATTERN:
                at = self._add(value[3], at, fold or bool(value[1] & re.IGNORECASE))
            elif kind is op.BRANCH:
                to = self._state()
                for branch in value[1]:
                    self.empty[self._add(branch, at, fold)].add(to)
                at = to
            elif kind is op.MAX_REPEAT:
                low, high, body = value
                for _ in range(low):
                    at = self._add(body, at, fold)
                if high is op.MAXREPEAT:
                    self.empty[at].add(loop := self._state())
                    self.empty[self._add(body, loop, fold)].add(loop)
                    at = loop
                else:
                    to = self._state()
                    for _ in range(high - low):
                        self.empty[at].add(to)
                        at = self._add(body, at, fold)
                    self.empty[at].add(to)
                    at = to
            else:
                raise ValueError(f"not supported: {kind}")
        return at

    def reversed(self) -> Nfa:
        back = object.__new__(Nfa)
        n = len(self.moves)
        back.empty, back.moves, back.end = [set() for _ in range(n + 1)], [[] for _ in range(n + 1)], n
        number = lambda s: 0 if s == self.end else n if s == 0 else s
        for s in range(n):
            for to in self.empty[s]:
                back.empty[number(to)].add(number(s))
            for codes, to in self.moves[s]:
                back.moves[number(to)].append((codes, number(s)))
        return back

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for to in self.empty[todo.pop()] - seen:
                seen.add(to)
                todo.append(to)
        return frozenset(seen)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({to for s in states for codes, to in self.moves[s] if byte in codes})


class Search:
    """The states of a leftmost search for one rule: (in a match, sets of NFA states by age of their start)."""

    def __init__(self, rule: Rule):
        self.rule, self.nfa = rule, Nfa(rule.pattern)
        self.first = (False, ())
        self.start = self.nfa.closure({0})
        self.step = lru_cache(None)(self.nfa.step)
        if self.nfa.end in self.start:
            raise ValueError(f"{rule.kind} matches the empty text")

    def advance(self, state, byte: int):
        matched, sets = state
        moved = self._moved(sets if matched else (*sets, self.start), byte)
        if matched and not moved:
            matched, moved = False, self._moved((self.start,), byte)
        done = [self.nfa.end in x for x in moved]
        if matched and not done[0] or any(done) and not done[0]:
            raise ValueError(f"{self.rule.kind}: a match must stay one until it ends, the leftmost first")
        return (True, moved[:1]) if any(done) else (False, moved)

    def _moved(self, sets, byte: int) -> tuple[frozenset[int], ...]:
        out: list[frozenset[int]] = []
        seen: set[int] = set()
        for states in sets:
            if new := self.step(states, byte) - seen:
                out.append(new)
                seen |= new
        return tuple(out)


@dataclass(frozen=True)
class Automaton:
    """``table[state + byte]`` is the next state; states count in steps of 256 and those from ``hot`` on have matches."""

    rules: tuple[Rule, ...]
    table: bytes
    hot: int
    matches: dict[int, tuple[int, ...]]
    backwards: tuple[tuple[list[dict[int, int]], list[bool]], ...]

    @property
    def states(self) -> int:
        return len(self.table) // 1024


def _classes(rules: list[Nfa]) -> tuple[list[int], list[int]]:
    """One byte of each class of bytes that no move tells apart, and the class of each byte."""
    sets = {codes for nfa in rules for moves in nfa.moves for codes, _ in moves}
    kinds: dict[tuple[bool, ...], int] = {}
    of = [kinds.setdefault(tuple(b in x for x in sets), len(kinds)) for b in range(256)]
    return [of.index(k) for k in range(len(kinds))], of


def _minimised(table: np.ndarray, accepted: list[tuple[int, ...]]) -> np.ndarray:
    """The class of each state after refining the classes by what their states accept and where they lead."""
    kinds = {x: i for i, x in enumerate(sorted(set(accepted)))}
    part, count = np.array([kinds[x] for x in accepted]), 0
    while count != (count := part.max() + 1):
        _, part = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        part = part.reshape(-1)
        if part.max() + 1 == count:
            break
    return part


def _backwards(nfa: Nfa) -> tuple[list[dict[int, int]], list[bool]]:
    back = nfa.reversed()
    numbers, todo = {back.closure({0}): 0}, [back.closure({0})]
    moves: list[dict[int, int]] = []
    for states in todo:
        row = {}
        for byte in range(256):
            if new := back.step(states, byte):
                if new not in numbers:
                    numbers[new] = len(numbers)
                    todo.append(new)
                row[byte] = numbers[new]
        moves.append(row)
    return moves, [back.end in x for x in todo]


@lru_cache(8)
def compile_rules(rules: tuple[Rule, ...] = RULES) -> Automaton:
    """One minimal automaton for all rules."""
    searches = [Search(r) for r in rules]
    letters, of = _classes([s.nfa for s in searches])
    first = tuple(s.first for s in searches)
    numbers, todo, rows = {first: 0}, [first], []
    advance = [lru_cache(None)(s.advance) for s in searches]
    for state in todo:
        row = []
        for byte in letters:
            new = tuple(go(x, byte) for go, x in zip(advance, state, strict=True))
            if new not in numbers:
                numbers[new] = len(numbers)
                todo.append(new)
            row.append(numbers[new])
        rows.append(row)
    accepted = [tuple(i for i, x in enumerate(state) if x[0]) for state in todo]
    table = np.array(rows)
    part = _minimised(table, accepted)

    # the first state is 0, those with matches come last
    one = {k: s for s, k in reversed(list(enumerate(part)))}
    order = sorted(one, key=lambda k: (bool(accepted[one[k]]), k != part[0], k))
    number = {k: 256 * i for i, k in enumerate(order)}
    full = np.array([[number[k] for k in part[table[one[k]]]] for k in order], dtype="<u4")[:, of]
    matches = {number[k]: accepted[one[k]] for k in order if accepted[one[k]]}
    return Automaton(
        rules, full.tobytes(), min(matches, default=256 * len(order)), matches, tuple(_backwards(s.nfa) for s in searches)
    )


class Scanner:
    """Finds the spans of a text, as (start, rule number, end) in bytes."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.table = np.frombuffer(automaton.table, dtype="<u4").tolist()
        self.checks = [re.compile(r.pattern, re.DOTALL) for r in automaton.rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        table, hot, state, found = self.table, self.automaton.hot, 0, []
        for at, byte in enumerate(data):
            state = table[state + byte]
            if state >= hot:
                found.append((at, state))
        return self._spans(data, found) if found else []

    def _spans(self, data: bytes, found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        ends: dict[int, list[int]] = defaultdict(list)
        for at, state in found:
            for rule in self.automaton.matches[state]:
                if ends[rule] and ends[rule][-1] == at:
                    ends[rule][-1] = at + 1
                else:
                    ends[rule].append(at + 1)
        out = []
        for rule, stops in ends.items():
            floor, (least, group) = 0, (self.automaton.rules[rule].least, self.automaton.rules[rule].group)
            for end in stops:
                start = self._start(data, rule, floor, end)
                floor = end
                if len(self.checks[rule].fullmatch(data, start, end)[group]) >= least:
                    out.append((start, rule, end))
        return sorted(out)

    def _start(self, data: bytes, rule: int, floor: int, end: int) -> int:
        moves, done = self.automaton.backwards[rule]
        state, start, at = 0, end, end
        while at > floor and (state := moves[state].get(data[at - 1], -1)) >= 0:
            at -= 1
            if done[state]:
                start = at
        return start


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with offsets in code points: those of the marks are counted from one to the next."""
    marks = sorted({x for s, _, e in spans for x in (s, e)})
    at, chars, of = 0, 0, {}
    for mark in marks:
        chars += len(data[at:mark].decode())
        at, of[mark] = mark, chars
    return [(of[s], rule, of[e]) for s, rule, e in spans]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents with a column ``secrets``: array of (kind, start, end), by start, then in the order of the rules.

    Offsets are code points, ends exclusive. Row by row, without a shuffle: repeated rows get equal results, extra
    columns pass through (one named ``secrets`` is replaced), an empty table stays empty. Null and empty texts have an
    empty array. A text is scanned whole, however long.
    """
    automaton = compile_rules(tuple(rules))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(automaton)
        for batch in small(batches, text):
            found = []
            for value in batch.column(text).cast(pa.binary()).to_pylist():
                spans = in_code_points(value, scanner.spans(value)) if value else []
                found.append([{"kind": automaton.rules[r].kind, "start": s, "end": e} for s, r, e in spans])
            yield with_arrays(batch, secrets=pa.array(found, kind))

    return docs.mapInArrow(run, same_schema(docs, secrets="array<struct<kind:string,start:bigint,end:bigint>>"))
