"""Secrets in texts, by one automaton for all rules.

Each rule is a regular expression; its positions are followed by subset construction, in the order in which they began, so
that a state knows the leftmost match alone and ends it as late as it can.  The rules' machines run side by side as one
machine, which is minimised and laid out as arrays of transitions over classes of bytes.  A batch of texts is one buffer of
bytes, cut into lanes of one length that all step together; a lane starts in the state that the bytes before it lead to,
and is run again if the lane before it ends in another one.  So one pass finds every match's end for all rules, and the
reversed rule finds the start behind it.

Defined results: a null text is an empty one and has no spans; matches of one kind never overlap, those of different kinds
may; a match whose last repeat is too short is dropped after it was found, and what it covers isn't searched again; rows
that repeat, or have no id, each come out; an empty table gives an empty result; other columns are not read.  Texts are
read whole; memory is some bytes for each byte of an Arrow batch and of a block.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import named, small_batches

#: Bytes that one set of lanes covers, the bytes of a lane, and those before it that lead to its first state.
BLOCK, LANE, LEAD = 1 << 22, 1024, 64
#: Stands between texts; no byte of UTF-8.
BETWEEN = 0xFF
#: States of the machine at most; rules that need more are refused.
MAX_STATES = 60_000


@dataclass(frozen=True)
class Rule:
    """Matches of a pattern, leftmost and as long as they can be, whose last + has repeated at least so often."""

    kind: str
    pattern: str
    least: int = 1


BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Kinds beside the base ones: what its form alone gives away.
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 20),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", 16),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)


class Positions:
    """A rule's positions: edges over sets of bytes, and empty ones; 0 is the start, ``good`` and ``short`` are ends."""

    def __init__(self, rule: Rule):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []
        self.start, self.good, self.short = (self._new() for _ in range(3))
        tree = list(parser.parse(rule.pattern.encode()))
        last = tree[-1]
        if last[0] is op.MAX_REPEAT and last[1][:2] == (1, op.MAXREPEAT) and rule.least > 1:
            at = self._all(tree[:-1], self.start, 0)
            for i in range(rule.least):
                at = self._all(list(last[1][2]), at, 0)
                self.empty[at].append(self.good if i == rule.least - 1 else self.short)
            self.empty[self._all(list(last[1][2]), at, 0)].append(at)
        else:
            self.empty[self._all(tree, self.start, 0)].append(self.good)

    def _new(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def _all(self, items: list, at: int, flags: int) -> int:
        for item in items:
            at = self._one(item, at, flags)
        return at

    def _one(self, item: tuple, at: int, flags: int) -> int:
        kind, what = item
        end = self._new()
        if kind in (op.LITERAL, op.NOT_LITERAL, op.IN, op.ANY):
            self.edges[at].append((_bytes_of(kind, what, flags), end))
        elif kind is op.SUBPATTERN:
            self.empty[self._all(list(what[3]), at, flags | what[1])].append(end)
        elif kind is op.BRANCH:
            for branch in what[1]:
                self.empty[self._all(list(branch), at, flags)].append(end)
        elif kind is op.MAX_REPEAT:
            low, high, body = what
            for _ in range(low):
                at = self._all(list(body), at, flags)
            if high is op.MAXREPEAT:
                loop = self._new()
                self.empty[at].append(loop)
                self.empty[self._all(list(body), loop, flags)].append(loop)
                at = loop
            else:
                for _ in range(high - low):
                    self.empty[at].append(end)
                    at = self._all(list(body), at, flags)
            self.empty[at].append(end)
        else:
            raise ValueError(f"a rule can't have {str(kind).lower()}")
        return end

    def closed(self, places: set[int]) -> frozenset[int]:
        """The places and all that no byte leads to from them."""
        found, new = set(places), list(places)
        while new:
            for p in self.empty[new.pop()]:
                if p not in found:
                    found.add(p)
                    new.append(p)
        return frozenset(found)

    def step(self, places: frozenset[int], byte: int) -> frozenset[int]:
        return self.closed({to for p in places for allowed, to in self.edges[p] if byte in allowed})

    def reversed(self) -> Positions:
        """The same words, read from their ends."""
        back = object.__new__(Positions)
        back.edges, back.empty = [[] for _ in self.edges], [[] for _ in self.empty]
        for p, edges in enumerate(self.edges):
            for allowed, to in edges:
                back.edges[to].append((allowed, p))
        for p, empty in enumerate(self.empty):
            for to in empty:
                back.empty[to].append(p)
        back.start, back.good, back.short = self.good, self.start, self.start
        back.empty[self.good] = [*back.empty[self.good], self.short]
        return back


def _bytes_of(kind: object, what: object, flags: int) -> frozenset[int]:
    """The bytes that an item of one byte stands for."""
    if kind is op.ANY:
        return frozenset(range(BETWEEN)) - {10}
    chosen: set[int] = set()
    negative = kind is op.NOT_LITERAL
    for k, x in [(op.LITERAL, what)] if kind is not op.IN else what:
        if k is op.NEGATE:
            negative = True
        elif k is op.LITERAL:
            chosen.add(x)
        elif k is op.RANGE:
            chosen.update(range(x[0], x[1] + 1))
        else:
            raise ValueError("a rule's sets are written out in bytes and ranges")
    if flags & re.IGNORECASE.value:
        chosen |= {ord(c) for b in chosen if b < 128 for c in (chr(b).lower(), chr(b).upper())}
    return frozenset(range(BETWEEN)) - chosen if negative else frozenset(chosen)


#: Bits of a transition, by rule: a match ended before this byte; and it was long enough.
ENDED, GOOD = 1, 2


def _explored(first: object, symbols: range, step) -> tuple[np.ndarray, np.ndarray]:
    """(states, symbols) next states and outputs of all states that can be reached; step gives (state, output)."""
    known, order, rows = {first: 0}, [first], []
    for state in order:
        row = []
        for symbol in symbols:
            to, out = step(state, symbol)
            if to not in known:
                known[to] = len(order)
                order.append(to)
            row.append((known[to], out))
        rows.append(row)
        if len(order) > MAX_STATES:
            raise ValueError("these rules need too many states together")
    table = np.array(rows, np.int64)
    return table[:, :, 0], table[:, :, 1]


def minimised(nexts: np.ndarray, outs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine with states that no input tells apart made one; the first state stays the first."""
    _, group = np.unique(outs, axis=0, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[nexts]]), axis=0, return_inverse=True)
        if finer.max() == group.max():
            break
        group = finer
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    order = np.argsort(first)  # groups by their first state, so that state 0 is in group 0
    place = np.argsort(order)
    return place[group][nexts[first[order]]], outs[first[order]]


def _machine(rule: Rule, classes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The rule's own machine over one byte of each class: a state is what is alive, by where it began."""
    positions = Positions(rule)
    begin = positions.closed({positions.start})
    ends = {positions.good, positions.short}
    if begin & ends:
        raise ValueError(f"{rule.kind}: a rule may not match nothing")

    def alive(threads: tuple, symbol: int) -> tuple:
        seen: set[int] = set()
        out = []
        for i, places in enumerate([*threads, begin]):
            left = positions.step(places, classes[symbol]) - seen
            if left & ends:
                if out:
                    raise ValueError(f"{rule.kind}: a later match may end before an earlier one does")
                return (left,)
            if i == 0 and threads and threads[0] & ends and left:
                raise ValueError(f"{rule.kind}: what follows a match may be no match")
            if left:
                out.append(left)
                seen |= left
        return tuple(out)

    def step(threads: tuple, symbol: int) -> tuple[tuple, int]:
        if threads and threads[0] & ends and not positions.step(threads[0], classes[symbol]):
            return alive((), symbol), ENDED | (GOOD if positions.good in threads[0] else 0)
        return alive(threads, symbol), 0

    return minimised(*_explored((), range(len(classes)), step))


class Automaton:
    """All rules as one machine: ``nexts`` has the next state times the number of classes, and ``outs`` two bits a rule."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.kinds = [r.kind for r in rules]
        positions = [Positions(r) for r in rules]
        sets = list({s for p in positions for edges in p.edges for s, _ in edges})
        member = np.array([[b in s for s in sets] for b in range(256)])
        _, first, self.classes = np.unique(member, axis=0, return_index=True, return_inverse=True)
        self.classes = self.classes.ravel()
        own = [_machine(r, first.tolist()) for r in rules]
        tables = [(n.tolist(), o.tolist()) for n, o in own]

        def step(state: tuple, symbol: int) -> tuple[tuple, int]:
            out = 0
            for k, (s, (_, outs)) in enumerate(zip(state, tables, strict=True)):
                out |= outs[s][symbol] << 2 * k
            return tuple(nexts[s][symbol] for s, (nexts, _) in zip(state, tables, strict=True)), out

        nexts, outs = minimised(*_explored((0,) * len(rules), range(len(first)), step))
        self.width = nexts.shape[1]
        self.nexts, self.outs = (nexts * self.width).astype(np.int32).ravel(), outs.astype(np.uint32).ravel()
        self.back = [self._backward(p.reversed(), first.tolist()) for p in positions]

    @staticmethod
    def _backward(positions: Positions, classes: list[int]) -> tuple[list[list[int]], list[bool]]:
        """The reversed rule's machine, from the end of a match: next states, -1 for none, and which ones are a start."""
        known = {positions.closed({positions.start}): 0}
        order, rows = list(known), []
        for places in order:
            row = []
            for byte in classes:
                to = positions.step(places, byte)
                if to and to not in known:
                    known[to] = len(order)
                    order.append(to)
                row.append(known[to] if to else -1)
            rows.append(row)
        return rows, [positions.good in places for places in order]

    def _run(self, lanes: np.ndarray, start: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Step all lanes (bytes, lanes) from their states: (last states, transitions)."""
        state, taken = start, np.empty(lanes.shape, np.int32) if keep else None
        for i, row in enumerate(lanes):
            at = state + row
            state = self.nexts[at]
            if keep:
                taken[i] = at
        return state, taken

    def outputs(self, data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """The outputs of every byte, from a state on, and the state behind the last."""
        whole = len(data) // LANE * LANE
        outs = np.empty(len(data), np.uint32)
        if whole:
            lanes = np.ascontiguousarray(self.classes[data[:whole]].reshape(-1, LANE).T.astype(np.int32))
            start = np.zeros(lanes.shape[1], np.int32)
            start[1:] = self._run(lanes[-LEAD:, :-1], start[1:], False)[0]
            start[0] = state
            ends, taken = self._run(lanes, start, True)
            while True:
                wrong = 1 + np.flatnonzero(start[1:] != ends[:-1])
                if not len(wrong):
                    break
                start[wrong] = ends[wrong - 1]
                ends[wrong], taken[:, wrong] = self._run(lanes[:, wrong], start[wrong], True)
            outs[:whole] = self.outs[taken.T.ravel()]
            state = int(ends[-1])
        for i in range(whole, len(data)):
            at = state + int(self.classes[data[i]])
            outs[i], state = self.outs[at], int(self.nexts[at])
        return outs, state

    def _start(self, kind: int, data: bytes, end: int, least: int) -> int:
        """Where the match that ends here starts: as far to the left as one can be."""
        rows, starts = self.back[kind]
        state, found = 0, end
        for at in range(end - 1, least - 1, -1):
            state = rows[state][self.classes[data[at]]]
            if state < 0:
                break
            if starts[state]:
                found = at
        return found

    def matches(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(rule, start, end) in bytes of all matches that are long enough, in texts between separators."""
        buffer, state = np.frombuffer(data, np.uint8), 0
        before = [0] * len(self.kinds)  # where each rule's last match ended in earlier blocks
        for begin in range(0, len(buffer), BLOCK):
            outs, state = self.outputs(buffer[begin : begin + BLOCK], state)
            at = np.flatnonzero(outs)
            outs, at = outs[at], at + begin
            for kind in range(len(self.kinds)):
                ended = at[(outs >> 2 * kind) & ENDED > 0]
                good = at[(outs >> 2 * kind) & GOOD > 0]
                place = np.searchsorted(ended, good)
                for end, i in zip(good.tolist(), place.tolist()):
                    least = int(ended[i - 1]) if i else before[kind]
                    yield kind, self._start(kind, data, end, least), end
                if len(ended):
                    before[kind] = int(ended[-1])


@functools.lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> Automaton:
    return Automaton(rules)


def _spans(automaton: Automaton, texts: pa.Array) -> Iterator[list[tuple[int, int, int]]]:
    """Of every text its spans (start, end, rule) in code points, by start and then rule."""
    texts = [t.encode() for t in pc.fill_null(texts.cast(pa.string()), "").to_pylist()]
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    data = b"".join(t + bytes([BETWEEN]) for t in texts)
    found = sorted((start, end, kind) for kind, start, end in automaton.matches(data))
    points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) if found else None
    place = lambda p: int(points[p - 1]) if p else 0  # noqa: E731  code points before a byte
    owner = np.searchsorted(first, [s for s, _, _ in found], "right") - 1 if found else []
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (start, end, kind), text in zip(found, owner):
        out[text].append((place(start) - place(first[text]), place(end) - place(first[text]), kind))
    yield from (sorted(x, key=lambda s: (s[0], s[2])) for x in out)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The id, ``spans`` as an array of (kind, start, end) in code points, by start and then in the order of the rules."""
    small_batches(docs.sparkSession)
    automaton = compiled(rules)
    span = T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType())
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("spans", T.ArrayType(span))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": automaton.kinds[k], "start": s, "end": e} for s, e, k in found] for found in _spans(automaton, batch.column(1))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(named(id_col), named(text_col).cast("string")).mapInArrow(scan, out)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the number of spans of each base kind, the digest of the base spans and all spans as a string."""
    base = [r.kind for r in BASE]
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = find(docs, id_col, text_col, rules)
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(of(base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every run of overlapping spans replaced by the kind of its first in angle brackets; null stays null."""
    small_batches(docs.sparkSession)
    automaton = compiled(rules)
    where = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where)
            out = []
            for text, spans in zip(texts.to_pylist(), _spans(automaton, texts)):
                parts, at = [], 0
                for start, end, kind in spans:
                    if start >= at:
                        parts += [text[at:start], f"<{automaton.kinds[kind]}>"]
                    at = max(at, end)
                out.append(None if text is None else "".join([*parts, text[at:]]))
            arrays = [pa.array(out, batch.schema.field(i).type) if i == where else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)
