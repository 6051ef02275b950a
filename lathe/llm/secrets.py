"""Secret scans: all rules in one byte pass of a combined, minimised deterministic automaton.

Rules are regular expressions over bytes (literals, classes, groups,
alternatives, ?, *, +, {m}, {m,}, {m,n}), parsed here, turned into one NFA and
from there by subset construction and partition refinement into a transition
array over byte classes. The text is passed over once, whatever the number of
rules; the pass notes the stretches in which a rule is in a matching state. A
match ends in such a stretch, and only there the rule's own automata go over
the bytes again: backwards to the leftmost start, and from there forwards to
the longest end. For rules of which no match begins inside an unfinished
earlier one these are the leftmost, non-overlapping, greedy matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

#: The rules in the order in which kinds are listed. The last value is the least length of the part after the sign, or 0.
RULES = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=\-]+", 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0),
    ("hex", r"[0-9a-f]{24,}", 0),
    ("github", r"gh[oprsu]_[A-Za-z0-9]{36}", 0),
    ("jwt", r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}", 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9\-]{10,}", 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
)
#: Rules whose words are matched in either case.
EITHER_CASE = ("assign",)
BASE = ("assign", "access", "hex")


class _Parser:
    """A regular expression as a tree: ('set', mask), ('cat', ...), ('alt', ...), ('rep', node, low, high)."""

    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def _byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def alternatives(self):
        out = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("alt", *out)

    def sequence(self):
        out = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            out.append(self.repeated())
        return ("cat", *out)

    def repeated(self):
        node = self.atom()
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            self.i += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[c]
            if c == "{":
                end = self.p.index("}", self.i)
                a, comma, b = self.p[self.i : end].partition(",")
                low, high, self.i = int(a), int(b) if b else None if comma else int(a), end + 1
            node = ("rep", node, low, high)
        return node

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            node = self.alternatives()
            self.i += 1
            return node
        if c == "[":
            self.i += 1
            mask = 0
            while self.p[self.i] != "]":
                a = b = self._byte()
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    b = self._byte()
                for x in range(a, b + 1):
                    mask |= 1 << x
            self.i += 1
            return ("set", mask)
        b = self._byte()
        mask = 1 << b
        if self.fold and chr(b).isalpha():
            mask |= 1 << (b ^ 32)
        return ("set", mask)


def _reversed(node):
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", _reversed(node[1]), *node[2:])
    parts = [_reversed(x) for x in node[1:]]
    return (kind, *(parts[::-1] if kind == "cat" else parts))


def _relaxed(node):
    """A superset of what the node matches, without counts: two or more become one or more."""
    if node[0] == "set":
        return node
    if node[0] == "rep":
        return ("rep", _relaxed(node[1]), min(node[2], 1), None if node[2] > 1 else node[3])
    return (node[0], *map(_relaxed, node[1:]))


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """Adds what the node matches from start on; returns the state in which it ends."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            if self.moves[start] is not None:
                fresh = self.state()
                self.empty[start].append(fresh)
                start = fresh
            self.moves[start] = (node[1], end)
            return end
        if kind == "cat":
            for x in node[1:]:
                nxt = self.state()
                self.empty[start].append(nxt)
                start = self.add(x, nxt)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1:]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.add(x, begin)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(("cat", inner), start)
        if high is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.add(("cat", inner), loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(("cat", inner), start)
        self.empty[start].append(end)
        return end


class Automaton:
    """A minimal deterministic automaton of one or more rules.

    classes maps a byte to its class, table[state * width + class] gives the
    next state times width; states from first_accepting on (times width) end a
    match, of the rules in accepts. Searching automata keep looking for a start
    everywhere; others are anchored and fall into the state dead.
    """

    def __init__(self, trees: list, search: bool):
        nfa = _Nfa()
        root = nfa.state()
        ends = {}
        for k, tree in enumerate(trees):
            begin = nfa.state()
            nfa.empty[root].append(begin)
            ends[nfa.add(tree, begin)] = k
        masks = sorted({m[0] for m in nfa.moves if m})
        keys = [tuple(m >> b & 1 for m in masks) for b in range(256)]
        order = {key: i for i, key in enumerate(dict.fromkeys(keys))}
        self.classes, self.width = bytes(order[k] for k in keys), len(order)
        sample = [keys.index(k) for k in order]

        @cache
        def closed(state: int) -> frozenset[int]:
            seen, todo = {state}, [state]
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(x for x in seen if nfa.moves[x] or x in ends)

        start = closed(root)
        states, rows, todo = {start: 0}, [], [start]
        for now in todo:
            row = []
            for b in sample:
                parts = [closed(nfa.moves[x][1]) for x in now if nfa.moves[x] and nfa.moves[x][0] >> b & 1]
                nxt = frozenset().union(*parts, *([start] if search else []))
                if nxt not in states:
                    states[nxt] = len(states)
                    todo.append(nxt)
                row.append(states[nxt])
            rows.append(row)
        marks = [sum(1 << ends[x] for x in s if x in ends) for s in states]
        # Partition refinement: states stay together while their marks and their successors' parts agree.
        part = {m: i for i, m in enumerate(dict.fromkeys(marks))}
        block = [part[m] for m in marks]
        while True:
            signs = [(block[i], *(block[j] for j in rows[i])) for i in range(len(rows))]
            names = {s: i for i, s in enumerate(dict.fromkeys(signs))}
            fresh = [names[s] for s in signs]
            if len(names) == len(set(block)):
                break
            block = fresh
        first = {}
        for i, b in enumerate(block):
            first.setdefault(b, i)
        ranked = sorted(first, key=lambda b: (marks[first[b]] != 0, b))
        place = {b: i for i, b in enumerate(ranked)}
        self.table = [place[block[j]] * self.width for b in ranked for j in rows[first[b]]]
        self.accepts = [marks[first[b]] for b in ranked]
        self.first_accepting = sum(m == 0 for m in self.accepts) * self.width
        self.start = place[block[0]] * self.width
        dead = [i * self.width for i in range(len(ranked)) if not self.accepts[i] and all(t == i * self.width for t in self.table[i * self.width : (i + 1) * self.width])]
        self.dead = dead[0] if dead else -1

    @property
    def size(self) -> int:
        return len(self.accepts)


class Scanner:
    """All rules of a catalogue, compiled once per process."""

    def __init__(self, rules=RULES, either_case=EITHER_CASE):
        trees = [_Parser(p, kind in either_case).alternatives() for kind, p, _ in rules]
        self.rules = rules
        # Rules with more than one part run without their counts here: the product of many counters would be large, and their spans are located exactly anyway.
        loose = [_relaxed(t) if len(t) > 2 else t for t in trees]
        self.combined = Automaton(loose, True)
        self.each = [(Automaton([t], True), Automaton([_reversed(x)], False), Automaton([_reversed(t)], False), Automaton([t], False)) for t, x in zip(trees, loose, strict=True)]

    def stretches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, first, last): where a rule is in a matching state without a break, by the bytes after which it is; in one pass."""
        a, out = self.combined, []
        table, accepting, state, accepts, width = a.table, a.first_accepting, a.start, a.accepts, a.width
        open_: dict[int, list[int]] = {}
        rules = {m: [k for k in range(len(self.rules)) if m >> k & 1] for m in set(accepts)}
        for i, c in enumerate(data.translate(a.classes)):
            state = table[state + c]
            if state >= accepting:
                for k in rules[accepts[state // width]]:
                    now = open_.get(k)
                    if now and now[1] == i - 1:
                        now[1] = i
                    else:
                        if now:
                            out.append((k, *now))
                        open_[k] = [i, i]
        out += [(k, *now) for k, now in open_.items()]
        return sorted(out)

    def spans(self, rule: int, data: bytes, first: int, last: int, at: int) -> list[tuple[int, int]]:
        """The rule's matches that end in a stretch, as byte offsets, leftmost first, without overlaps and from at on."""
        search, loose, back, ahead = self.each[rule]
        out = []
        # The stretch's matches begin no earlier than the leftmost loose match that ends with its first byte.
        state, low = loose.start, first + 1
        for i in range(first, at - 1, -1):
            state = loose.table[state + loose.classes[data[i]]]
            if state >= loose.first_accepting:
                low = i
            elif state == loose.dead:
                break
        at = max(at, low)
        while at <= last:
            state, table, accepting, classes, end = search.start, search.table, search.first_accepting, search.classes, -1
            for i in range(at, last + 1):
                state = table[state + classes[data[i]]]
                if state >= accepting:
                    end = i + 1
                    break
            if end < 0:
                break
            state, start = back.start, end
            for i in range(end - 1, at - 1, -1):
                state = back.table[state + back.classes[data[i]]]
                if state >= back.first_accepting:
                    start = i
                elif state == back.dead:
                    break
            state = ahead.start
            for i in range(start, len(data)):
                state = ahead.table[state + ahead.classes[data[i]]]
                if state >= ahead.first_accepting:
                    end = i + 1
                elif state == ahead.dead:
                    break
            out.append((start, end))
            at = end
        return out

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """All secrets as (start, rule, end) in code points, in order of start and rule."""
        out, at = [], [0] * len(self.rules)
        for rule, first, last in self.stretches(data):
            if last >= at[rule]:
                for start, end in self.spans(rule, data, first, last, at[rule]):
                    at[rule] = end
                    if _value_length(data[start:end]) >= self.rules[rule][2]:
                        out.append((start, rule, end))
        if not out:
            return out
        points, at, n = {}, 0, 0
        for offset in sorted({x for s, _, e in out for x in (s, e)}):
            n += len(data[at:offset].decode("utf-8", "replace"))
            points[offset], at = n, offset
        return sorted((points[s], rule, points[e]) for s, rule, e in out)


def _value_length(match: bytes) -> int:
    """Length of what follows the first sign of an assignment, blanks and a quote; of the whole without a sign."""
    rest = match[min((i for i in (match.find(b":"), match.find(b"=")) if i >= 0), default=-1) + 1 :].lstrip(b" ")
    return len(rest[1:] if rest[:1] in (b'"', b"'") else rest)


@cache
def scanner() -> Scanner:
    return Scanner()


FOUND = "doc_id long, kinds array<string>, starts array<int>, ends array<int>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = scanner()
    for batch in pieces(batches):
        found = [s.scan(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        columns = [[[s.rules[r][0] for _, r, _ in f] for f in found], [[a for a, _, _ in f] for f in found], [[b for _, _, b in f] for f in found]]
        types = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "kinds", "starts", "ends"])


def secrets(docs: DataFrame) -> DataFrame:
    """The secrets of every text, one row per row of docs: doc_id, kinds, starts, ends (code points, end exclusive).

    A null text counts as empty. The lists are in order of start, then of
    kind as in RULES, and empty without secrets. A text of any length is scanned
    as a whole, in one pass. Repeated rows give repeated results, an empty
    table an empty one; columns other than doc_id and text are ignored.
    """
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_scan, FOUND)


DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for kinds, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("kinds", "starts", "ends")), strict=True):
            texts = [(k, f"{k}:{a}:{b}") for k, a, b in zip(kinds, starts, ends, strict=True)]
            base = ",".join(t for k, t in texts if k in BASE)
            rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), ",".join(t for _, t in texts)))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of the secrets of every text."""
    return secrets(docs).mapInArrow(_digest, DIGEST)
