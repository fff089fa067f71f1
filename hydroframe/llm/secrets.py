"""Secret scans with one deterministic automaton for all rules.

The rules' regular expressions become one automaton over bytes by subset construction, the automaton
is minimised, and its transitions lie in one array of states by byte classes. Texts are scanned once,
byte by byte, for all rules at the same time: the bytes of a batch are cut into lanes of equal length
that take their steps together, and a lane whose start state was assumed wrongly is run again until
it falls in step. A position in an accepting state names the rules that match up to there. The texts
so named get the spans of the named rules cut by an automaton of each rule that starts at a given
byte; no regular expression is matched in any other way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.shared import bounded_batches, portions, table, text_of

#: Name, pattern for the scan, pattern of the spans, the part before what is measured, least length of
#: what is measured, bytes that must not stand before a span. The first three are the base rules.
#: Counted runs over the same characters multiply the automaton's states, so that the scan counts no
#: further than sets rare texts apart; the spans are measured in full.
HEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
RULES = [
    ("assign", HEAD + r"[A-Za-z0-9+/_.=-]{6,}", HEAD + r"[A-Za-z0-9+/_.=-]+", HEAD, 6, None),
    ("access", r"AKIA[A-Z0-9]{4,}", r"AKIA[A-Z0-9]+", None, 20, None),
    ("hex", r"[0-9a-f]{12,}", r"[0-9a-f]+", None, 24, None),
    ("pem", r"-----BEGIN[A-Z ]+PRIVATE KEY-----", r"-----BEGIN[A-Z ]+PRIVATE KEY-----", None, 1, None),
    ("github", r"gh[pousr]_", r"gh[pousr]_[A-Za-z0-9]{20,}", None, 1, None),
    ("slack", r"xox[abprs]-", r"xox[abprs]-[A-Za-z0-9-]{10,}", None, 1, None),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", None, 1, r"[A-Za-z0-9_-]"),
]
BASE = ("assign", "access", "hex")
#: Rules whose ASCII letters match in either case where the pattern has them in a group.
EITHER_CASE = {"assign"}
#: Lanes of a scan, and the bytes that are scanned at a time.
LANES, BLOCK = 4096, 8_000_000


class Nfa:
    """Thompson's construction for literals, classes, groups, ``|``, ``?``, ``*``, ``+`` and ``{n,}``."""

    def __init__(self):
        self.on: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.on.append([])
        self.free.append([])
        return len(self.on) - 1

    def add(self, pattern: str, either_case: bool) -> tuple[int, int]:
        self.text, self.at, self.either_case, self.depth = pattern, 0, either_case, 0
        return self._choice()

    def _choice(self) -> tuple[int, int]:
        branches = [self._chain()]
        while self.at < len(self.text) and self.text[self.at] == "|":
            self.at += 1
            branches.append(self._chain())
        if len(branches) == 1:
            return branches[0]
        first, last = self.state(), self.state()
        for a, b in branches:
            self.free[first].append(a)
            self.free[b].append(last)
        return first, last

    def _chain(self) -> tuple[int, int]:
        first = last = self.state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            begin = self.at
            a, b = self._atom()
            end = self.at
            mark = self.text[end] if end < len(self.text) else ""
            if mark == "?":
                self.at += 1
                self.free[a].append(b)
            elif mark == "*":
                self.at += 1
                self.free[b].append(a)
                self.free[a].append(b)
            elif mark == "+":
                self.at += 1
                self.free[b].append(a)
            elif mark == "{":
                least, stop = re.match(r"\{(\d+),\}", self.text[end:]).group(1), self.text.index("}", end) + 1
                for _ in range(int(least) - 1):
                    self.at = begin
                    c, d = self._atom()
                    self.free[b].append(c)
                    b, loop = d, c
                self.free[b].append(loop if int(least) > 1 else a)
                self.at = stop
            self.free[last].append(a)
            last = b
        return first, last

    def _atom(self) -> tuple[int, int]:
        c = self.text[self.at]
        if c == "(":
            self.at, self.depth = self.at + 1, self.depth + 1
            found = self._choice()
            self.at, self.depth = self.at + 1, self.depth - 1
            return found
        if c == "[":
            stop = self.text.index("]", self.at + 1)
            found = {b for b in range(128) if re.match(self.text[self.at : stop + 1], chr(b))}
            self.at = stop + 1
        elif c == "\\":
            body = re.match(r"\\x[0-9a-f]{2}|\\.", self.text[self.at :]).group()
            found = {b for b in range(128) if re.fullmatch(body, chr(b))}
            self.at += len(body)
        else:
            found = {ord(c)}
            self.at += 1
            if self.either_case and self.depth and c.isalpha():
                found = {ord(c.lower()), ord(c.upper())}
        a, b = self.state(), self.state()
        self.on[a].append((frozenset(found), b))
        return a, b


def subsets(rules: list[tuple[str, str]], anywhere: bool = True) -> tuple[list[list[int]], list[int], list[int]]:
    """Transitions by state and class, the rules accepted in each state as bits, and byte classes; state 0 is the start.

    ``rules`` has names and patterns. With ``anywhere`` the start is part of every state, so that a
    match may begin at any byte.
    """
    nfa = Nfa()
    start = nfa.state()
    ends = {}
    for k, (name, pattern) in enumerate(rules):
        a, b = nfa.add(pattern, name in EITHER_CASE)
        nfa.free[start].append(a)
        ends[b] = 1 << k
    kinds: dict[tuple, int] = {}
    sets = list({s for on in nfa.on for s, _ in on})
    classes = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
    sample = [classes.index(k) for k in range(len(kinds))]

    @lru_cache(None)
    def closure(n: int) -> frozenset[int]:
        found, todo = {n}, [n]
        while todo:
            for m in nfa.free[todo.pop()]:
                if m not in found:
                    found.add(m)
                    todo.append(m)
        return frozenset(found)

    # states without a way by a byte matter only where they accept
    slim = lambda s: frozenset(n for n in s if nfa.on[n] or n in ends)
    first = slim(closure(start))
    step = [[[slim(closure(m)) for s, m in on if b in s] for b in sample] for on in nfa.on]
    number, order, table_ = {first: 0}, [first], []
    while len(table_) < len(order):
        here = order[len(table_)]
        row = []
        for k in range(len(sample)):
            to = (first if anywhere else frozenset()).union(*[t for n in here for t in step[n][k]])
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        table_.append(row)
    accepts = [sum({ends[n] for n in s if n in ends}) for s in order]
    return table_, accepts, classes


def minimise(table_: list[list[int]], accepts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no continuation tells apart, by refining the partition until it stands."""
    t, block = np.asarray(table_), np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = block
        for column in t.T:  # one class of bytes after the other, so that numbers stay small
            finer = np.unique(finer * len(t) + block[column], return_inverse=True)[1]
        if finer.max() == block.max():
            break
        block = finer
    # the start comes first
    number = np.full(block.max() + 1, -1)
    number[block[0]] = 0
    number[number < 0] = np.arange(1, len(number))
    block = number[block]
    out, acc = np.zeros((block.max() + 1, t.shape[1]), np.int32), np.zeros(block.max() + 1, np.int64)
    out[block], acc[block] = block[t], accepts
    return out, acc


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat transitions whose states are multiplied by the number of classes, accepted rules by state, byte classes."""
    table_, accepts, classes = subsets([r[:2] for r in RULES])
    t, acc = minimise(table_, accepts)
    return (t * t.shape[1]).astype(np.int32).ravel(), acc, np.asarray(classes, np.int32)


def scan(data: np.ndarray, compiled: tuple[np.ndarray, np.ndarray, np.ndarray], lanes: int = LANES, state: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """One pass over ``data`` (bytes) from ``state``: the positions that end matches, the rules there as bits, and the last state.

    A byte that stands in no rule brings every state back to the start, so texts are parted by 0xFF.
    """
    t, acc, classes = compiled
    width = len(t) // len(acc)
    lanes = max(1, min(lanes, len(data) // 64 or 1))
    steps = -(-len(data) // lanes)
    padded = np.full(lanes * steps, 0xFF, np.uint8)
    padded[: len(data)] = data
    kinds = classes[padded.reshape(lanes, steps).T]
    states = np.empty((steps, lanes), np.int32)
    now = np.zeros(lanes, np.int32)
    for k in range(steps):
        now = np.take(t, now + kinds[k])
        states[k] = now
    begin = np.zeros(lanes, np.int32)  # the state with which each lane has been run
    while True:
        due = np.concatenate([np.array([state], np.int32), states[-1, :-1]])
        again = np.nonzero(due != begin)[0]
        if not len(again):
            break
        begin[again] = due[again]
        now, k = due[again], 0
        while len(again) and k < steps:
            now = np.take(t, now + kinds[k, again])
            apart = now != states[k, again]
            again, now = again[apart], now[apart]
            states[k, again] = now
            k += 1
    hit = acc[states // width]
    step, lane = np.nonzero(hit)
    at = lane * steps + step
    order = np.argsort(at, kind="stable")
    last = len(data) - 1
    return at[order], hit[step, lane][order], int(states[last % steps, last // steps])


class Cutter:
    """The leftmost longest non-overlapping matches of a pattern, by an automaton from a given byte on."""

    def __init__(self, name: str, pattern: str, apart: str | None = None):
        table_, accepts, classes = subsets([(name, pattern)], anywhere=False)
        rows, acc = minimise(table_, accepts)
        self.rows, self.accepts, self.classes = rows.tolist(), [bool(x) for x in acc], classes
        # from a dead state no byte leads out, and it accepts nothing
        self.dead = {k for k, row in enumerate(self.rows) if not acc[k] and set(row) == {k}}
        self.first = np.array([self.rows[0][c] not in self.dead for c in classes])
        self.apart = np.array([bool(apart and b < 128 and re.match(apart, chr(b))) for b in range(256)])

    def end(self, raw: bytes, at: int) -> int:
        """Where the longest match from ``at`` ends, or -1."""
        state, found, n = 0, -1, len(raw)
        while at < n:
            state = self.rows[state][self.classes[raw[at]]]
            if state in self.dead:
                break
            at += 1
            if self.accepts[state]:
                found = at
        return found

    def spans(self, raw: bytes) -> list[tuple[int, int]]:
        data, out, free = np.frombuffer(raw, np.uint8), [], 0
        for lo in range(0, len(data), BLOCK):
            begins = self.first[data[lo : lo + BLOCK]]
            begins[1:] &= ~self.apart[data[lo : lo + BLOCK - 1]][: len(begins) - 1]
            if lo and self.apart[data[lo - 1]]:
                begins[0] = False
            for at in (np.flatnonzero(begins) + lo).tolist():
                if at >= free and (end := self.end(raw, at)) > at:
                    out.append((at, end))
                    free = end
        return out


@lru_cache(1)
def cutters() -> list[tuple[Cutter, Cutter | None, int]]:
    """Of each rule: its spans, what stands before the measured part, and that part's least length."""
    return [(Cutter(name, spans, apart), head and Cutter(name, head), least) for name, _, spans, head, least, apart in RULES]


def cut_spans(raw: bytes, rules: int) -> list[tuple[int, int, str, int]]:
    """Start, number and name of the rule and end of each span of the rules named by bits, in order; places in code points."""
    found = []
    for k, (cutter, head, least) in enumerate(cutters()):
        if rules >> k & 1:
            found += [(a, k, RULES[k][0], b) for a, b in cutter.spans(raw) if b - (head.end(raw, a) if head else a) >= least]
    # bytes that begin a code point, counted from one place to the next
    data, points, last = np.frombuffer(raw, np.uint8), {0: 0}, 0
    for at in sorted({x for f in found for x in (f[0], f[3])}):
        points[at] = points[last] + int(np.count_nonzero((data[last:at] & 0xC0) != 0x80))
        last = at
    return sorted((points[a], k, name, points[b]) for a, k, name, b in found)


def find_secrets(documents: DataFrame) -> DataFrame:
    """Per document doc_id and spans, an array of (start, kind_no, kind, end) in order.

    A null or empty text has no spans. Spans of different rules may overlap; those of one don't. Rows
    that repeat are scanned each for itself; an empty table gives an empty result; other columns are
    ignored.
    """
    compiled = automaton()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            every = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for at, stop in portions(texts, BLOCK):
                own = offsets[at : stop + 1] - offsets[at]
                data = np.insert(every[offsets[at] : offsets[stop]], own[1:], 0xFF)
                ends = own[1:] + np.arange(1, len(own))
                named, state = np.zeros(stop - at, np.int64), 0
                for lo in range(0, len(data), BLOCK):
                    where, rules, state = scan(data[lo : lo + BLOCK], compiled, state=state)
                    np.bitwise_or.at(named, np.searchsorted(ends, where + lo, side="right"), rules)
                found = [cut_spans(every[offsets[at + d] : offsets[at + d + 1]].tobytes(), n) if n else [] for d, n in enumerate(named.tolist())]
                flat = [x for f in found for x in f]
                kinds = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int64()))]
                counts = np.cumsum([0, *map(len, found)])
                spans = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(kinds, ["start", "kind_no", "kind", "end"]))
                yield pa.RecordBatch.from_arrays([names.slice(at, stop - at), spans], ["doc_id", "spans"])

    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<start: long, kind_no: int, kind: string, end: long>>")


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
