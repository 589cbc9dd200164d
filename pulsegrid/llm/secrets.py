"""Secret scan: all rules in one minimised automaton over the bytes of a text.

Each rule is a head and a tail pattern.  Subset construction gives each rule's states: the sets of NFA
states of its live threads in the order of their start, so that "leftmost, longest, not overlapping"
is part of the state.  The product of all rules is built from these, and Moore's algorithm merges
equal states.  One pass over the bytes then follows a transition array; states that end a match have
the highest numbers, so that a single comparison finds them.  The start of the rare match is read
backwards from its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import row_slices

@dataclass(frozen=True)
class Rule:
    """``head`` then ``tail``; a match counts if it and its tail have the least lengths.

    Shorter matches are dropped, but the text that they cover is used up.  Once a thread accepts, it
    must accept until it ends; the compiler refuses other rules.
    """

    kind: str
    head: str
    tail: str
    any_case: bool = False
    min_tail: int = 1
    min_total: int = 1


#: The rules of the contract, in its order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", any_case=True, min_tail=12),
    Rule("access", "AKIA", "[A-Z0-9]+", min_total=18),
    Rule("hex", "", "[0-9a-f]{16,}", min_total=16),
)
#: Public token formats that the operator finds besides.
MORE_RULES = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", min_tail=36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", min_tail=10),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", min_tail=35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]+", min_tail=10),
    Rule("pem", "-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?", "PRIVATE KEY-----"),
)
ALL_RULES = BASE_RULES + MORE_RULES


class _Nfa:
    """Thompson's construction of one pattern over bytes."""

    def __init__(self, pattern: str, any_case: bool) -> None:
        self.free: list[set[int]] = []
        self.arcs: list[list[tuple[frozenset[int], int]]] = []
        self._p, self._i, self._fold = pattern, 0, any_case
        self.start, self.end = self._either()
        if self._i != len(pattern):
            raise ValueError(f"cannot read {pattern!r} at {self._i}")

    def _node(self) -> int:
        self.free.append(set())
        self.arcs.append([])
        return len(self.free) - 1

    def _peek(self) -> str:
        return self._p[self._i] if self._i < len(self._p) else ""

    def _either(self) -> tuple[int, int]:
        a, b = self._node(), self._node()
        while True:
            s, e = self._row()
            self.free[a].add(s)
            self.free[e].add(b)
            if self._peek() != "|":
                return a, b
            self._i += 1

    def _row(self) -> tuple[int, int]:
        start = at = self._node()
        while self._peek() not in ("", "|", ")"):
            s, e = self._repeat()
            self.free[at].add(s)
            at = e
        return start, at

    def _repeat(self) -> tuple[int, int]:
        begin = self._i
        s, e = self._atom()
        mark = self._peek()
        if mark == "?":
            low, high = 0, 1
        elif mark == "*":
            low, high = 0, None
        elif mark == "+":
            low, high = 1, None
        elif mark == "{":
            stop = self._p.index("}", self._i)
            parts = self._p[self._i + 1 : stop].split(",")
            low = int(parts[0])
            high = low if len(parts) == 1 else int(parts[1]) if parts[1] else None
            self._i = stop
        else:
            return s, e
        stop = self._i + 1
        pieces = [(s, e)]
        while len(pieces) < max(low, high or 1, 1):
            self._i = begin
            pieces.append(self._atom())
        self._i = stop
        a, b = self._node(), self._node()
        at = a
        for k, (s, e) in enumerate(pieces):
            if k >= low:
                self.free[at].add(b)
            self.free[at].add(s)
            at = e
        self.free[at].add(b)
        if high is None:
            self.free[pieces[-1][1]].add(pieces[-1][0])
        return a, b

    def _byte(self) -> int:
        c = self._p[self._i]
        self._i += 1
        if c != "\\":
            return ord(c)
        c = self._p[self._i]
        self._i += 1
        if c == "x":
            self._i += 2
            return int(self._p[self._i - 2 : self._i], 16)
        return ord(c)

    def _atom(self) -> tuple[int, int]:
        c = self._peek()
        if c == "(":
            self._i += 1
            s, e = self._either()
            self._i += 1
            return s, e
        if c == "[":
            self._i += 1
            got: set[int] = set()
            while self._peek() != "]":
                low = self._byte()
                if self._peek() == "-" and self._p[self._i + 1] != "]":
                    self._i += 1
                    got |= set(range(low, self._byte() + 1))
                else:
                    got.add(low)
            self._i += 1
        else:
            got = {self._byte()}
        if self._fold:
            got |= {ord(chr(b).swapcase()) for b in got if chr(b).isalpha()}
        s, e = self._node(), self._node()
        self.arcs[s].append((frozenset(got), e))
        return s, e

    def closure(self, nodes: set[int]) -> frozenset[int]:
        todo, seen = list(nodes), set(nodes)
        while todo:
            for y in self.free[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return frozenset(x for x in seen if self.arcs[x] or x == self.end)

    def move(self, nodes: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({to for x in nodes for on, to in self.arcs[x] if byte in on})


class _Tracker:
    """One rule as a minimised automaton over byte classes: which of its matches end, and which are open."""

    def __init__(self, rule: Rule, nfa: _Nfa, sample: list[int]) -> None:
        self._rule, self._nfa, self._sample = rule, nfa, sample
        self._first = nfa.closure({nfa.start})
        self._moved: dict[tuple[frozenset[int], int], frozenset[int]] = {}
        start: tuple[tuple, bool] = ((), False)
        number, order, table = {start: 0}, [start], []
        for live, _ in order:
            row = [self._step(live, k) for k in range(len(sample))]
            for to in row:
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
            table.append([number[to] for to in row])
        ended = np.array([e for _, e in order], dtype=np.int64)
        open_ = np.array([bool(live) and nfa.end in live[0] for live, _ in order], dtype=np.int64)
        block = _equivalent(np.array(table), 2 * ended + open_)
        first = np.unique(block, return_index=True)[1]
        self.start, self.table = int(block[0]), block[np.array(table)[first]]
        self.ended, self.open = ended[first], open_[first]

    def _threads(self, live: tuple, k: int) -> tuple:
        """Every thread after one byte; states that an earlier thread has go from later ones."""
        seen: set[int] = set()
        out = []
        for g in live:
            if (g, k) not in self._moved:
                self._moved[g, k] = self._nfa.move(g, self._sample[k])
            if nodes := self._moved[g, k] - seen:
                seen |= nodes
                out.append(nodes)
        takes = [self._nfa.end in g for g in out]
        if any(takes):
            if not takes[0]:
                raise ValueError(f"{self._rule.kind}: a later thread accepts before an earlier one")
            del out[1:]
        return tuple(out)

    def _step(self, live: tuple, k: int) -> tuple[tuple, bool]:
        accepts = bool(live) and self._nfa.end in live[0]
        new = self._threads(live if accepts else (*live, self._first), k)
        if accepts and new and self._nfa.end not in new[0]:
            raise ValueError(f"{self._rule.kind}: it must accept until it ends")
        ended = accepts and not new
        return (self._threads((self._first,), k) if ended else new), ended


def _equivalent(table: np.ndarray, output: np.ndarray) -> np.ndarray:
    """The block of each state after Moore's refinement: states of a block have equal outputs and go to equal blocks.

    A round tells states apart by a 64-bit mix of their successors' blocks; the result is checked exactly.
    """
    rng = np.random.default_rng(1)
    factors = rng.integers(1, 1 << 63, table.shape[1] + 1, dtype=np.uint64) | np.uint64(1)
    block, count = np.unique(output, return_inverse=True)[1].ravel(), 0
    while block.max() + 1 != count:
        count = int(block.max()) + 1
        mixed = rng.integers(0, 1 << 63, count, dtype=np.uint64)
        signs = (mixed[block[table]] * factors[:-1]).sum(axis=1, dtype=np.uint64) + mixed[block] * factors[-1]
        block = np.unique(signs, return_inverse=True)[1].ravel()
    first = np.unique(block, return_index=True)[1]
    if (block[table] != block[table[first]][block]).any() or (output != output[first][block]).any():
        raise ValueError("two different states were taken for one")
    return block


class Automaton:
    """The minimised product of the rules' automata; see the module's text.

    A row of the transition array has a place for each class of bytes that no rule tells apart, and
    ``classes`` translates bytes to classes: some tens of places instead of 256.
    """

    _rows: list[list[int]] | None = None

    def __init__(self, rules: tuple[Rule, ...] = ALL_RULES) -> None:
        self.rules = rules
        self._whole = [_Nfa(r.head + r.tail, r.any_case) for r in rules]
        self._head = [_Nfa(r.head, r.any_case) if r.head else None for r in rules]
        kinds: dict[tuple, int] = {}
        sets = [on for n in self._whole for arcs in n.arcs for on, _ in arcs]
        self.classes = bytes(kinds.setdefault(tuple(b in on for on in sets), len(kinds)) for b in range(256))
        sample = [self.classes.index(k) for k in range(len(kinds))]
        parts = [_Tracker(rule, nfa, sample) for rule, nfa in zip(rules, self._whole, strict=True)]
        # A product state is a number with a digit for each rule's state.
        sizes = [len(p.table) for p in parts]
        if np.prod([float(x) for x in sizes]) >= 1 << 62:
            raise ValueError("too many rules for one automaton")
        weights = [int(np.prod([1, *sizes[:r]], dtype=np.int64)) for r in range(len(parts))]

        def after(states: np.ndarray) -> np.ndarray:
            return sum(p.table[states // w % n] * w for p, w, n in zip(parts, weights, sizes, strict=True))

        fresh = known = np.array([sum(p.start * w for p, w in zip(parts, weights, strict=True))])
        while len(fresh):
            fresh = np.setdiff1d(after(fresh), known)
            known = np.union1d(known, fresh)
        table = np.searchsorted(known, after(known))
        bits = lambda name: sum(getattr(p, name)[known // w % n] << r for r, (p, w, n) in enumerate(zip(parts, weights, sizes, strict=True)))
        ends, last = bits("ended"), bits("open")
        self.raw_states = len(known)
        block = _equivalent(table, ends << len(rules) | last)
        first = np.unique(block, return_index=True)[1]
        begin = block[int(np.searchsorted(known, sum(p.start * w for p, w in zip(parts, weights, strict=True))))]
        # The first state is 0; those that end a match come last.
        order = np.lexsort((np.arange(len(first)), np.arange(len(first)) != begin, ends[first] != 0))
        rank = np.empty(len(first), dtype=np.int64)
        rank[order] = np.arange(len(first))
        self.table = rank[block[table[first[order]]]].astype(np.int32)
        self.ends, self.last = ends[first[order]].tolist(), last[first[order]].tolist()
        self.states = len(first)
        self.hot = next((i for i, e in enumerate(self.ends) if e), self.states)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_rows"}

    def _begin(self, r: int, data: bytes, low: int, end: int) -> int:
        """The leftmost start of the rule's match that ends at ``end``, not before ``low``."""
        nfa = self._whole[r]
        back: dict[int, list[tuple[frozenset[int] | None, int]]] = {}
        for x, arcs in enumerate(nfa.arcs):
            for on, to in arcs:
                back.setdefault(to, []).append((on, x))
        for x, free in enumerate(nfa.free):
            for to in free:
                back.setdefault(to, []).append((None, x))

        def close(nodes: set[int]) -> set[int]:
            todo = list(nodes)
            while todo:
                for on, x in back.get(todo.pop(), ()):
                    if on is None and x not in nodes:
                        nodes.add(x)
                        todo.append(x)
            return nodes

        now, found, i = close({nfa.end}), end, end
        while now and i > low:
            i -= 1
            now = close({x for y in now for on, x in back.get(y, ()) if on is not None and data[i] in on})
            if nfa.start in now:
                found = i
        return found

    def _kept(self, r: int, data: bytes, start: int, end: int) -> bool:
        rule, tail = self.rules[r], start
        if end - start < rule.min_total:
            return False
        if rule.min_tail > 1 and self._head[r]:
            nfa = self._head[r]
            now = nfa.closure({nfa.start})
            for i in range(start, end - 1):
                now = nfa.move(now, data[i])
                if not now:
                    break
                if nfa.end in now:
                    tail = i + 1
        return end - tail >= rule.min_tail

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, sorted."""
        if self._rows is None:
            numbers = list(range(self.states))  # one object for each state, whatever the rows that name it
            self._rows = [[numbers[x] for x in row] for row in self.table.tolist()]
        table, hot, state = self._rows, self.hot, 0
        found: list[tuple[int, int]] = []
        for i, b in enumerate(data.translate(self.classes)):
            state = table[state][b]
            if state >= hot:
                found.append((i, state))
        ended = [(i, r) for i, s in found for r in range(len(self.rules)) if self.ends[s] >> r & 1]
        ended += [(len(data), r) for r in range(len(self.rules)) if self.last[state] >> r & 1]
        low, out = [0] * len(self.rules), []
        for end, r in ended:
            start = self._begin(r, data, low[r], end)
            low[r] = end
            if self._kept(r, data, start, end):
                out.append((start, r, end))
        return sorted(out)

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then the rules' order."""
        found = self.scan(data)
        at, points, before = {}, 0, 0
        for x in sorted({x for s, _, e in found for x in (s, e)}):
            points += len(data[before:x].decode("utf-8", "replace"))
            at[x], before = points, x
        return [(self.rules[r].kind, at[s], at[e]) for s, r, e in found]


_compiled: dict[tuple[Rule, ...], Automaton] = {}


def automaton(rules: tuple[Rule, ...] = ALL_RULES) -> Automaton:
    """The rules' automaton, compiled once in each Python process."""
    if rules not in _compiled:
        _compiled[rules] = Automaton(rules)
    return _compiled[rules]


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "spans", rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """``docs`` with an array of (kind, start, end) of all rules; code points, end exclusive.

    A null or empty text has an empty array.  Repeated rows are scanned each, other columns pass
    through; a column named ``out_col`` is replaced.  A map over rows: nothing is shuffled, and a
    lost task is scanned again.
    """
    return _mapped(docs, text_col, out_col, rules, False)


def redact_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``[kind]``; overlapping ones become one mark.

    Columns stay as they are; a text without a secret, null included, is left as it is.
    """
    return _mapped(docs, text_col, None, rules, True)


def _masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _mapped(docs: DataFrame, text_col: str, out_col: str | None, rules: tuple[Rule, ...], mask: bool) -> DataFrame:
    keep = [c for c in docs.columns if c != out_col]
    place = keep.index(text_col)

    # The transition array is fixed by the rules (some 2 MB), whatever the input.
    sent = docs.sparkSession.sparkContext.broadcast(automaton(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for batch in (part for whole in batches for part in row_slices(whole, place)):
            texts = batch.column(place).cast(pa.binary())
            columns, names = list(batch.columns), list(batch.schema.names)
            found = [scanner.spans(t.as_py() or b"") for t in texts]
            if mask:
                columns[place] = pa.array([None if not t.is_valid else _masked(t.as_py().decode("utf-8", "replace"), s) if s else t.as_py().decode("utf-8", "replace") for t, s in zip(texts, found, strict=True)], pa.string())
            else:
                columns.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], _SPANS_ARROW))
                names.append(out_col)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([docs.schema[c] for c in keep] + ([] if mask else [T.StructField(out_col, _SPANS)]))
    return docs.select(*keep).mapInArrow(run, schema)


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans as text."""
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*(r.kind for r in BASE_RULES)))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = find_secrets(docs.select(F.col(id_col), F.col(text_col)), text_col)
    return found.select(id_col, *(count(r.kind) for r in BASE_RULES), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
