"""Secret scans by one combined deterministic automaton.

``compile_rules`` turns byte-level regular expressions into one unanchored automaton of all rules, read from the end of the text
to its start: Thompson construction, reversal, subset construction over byte classes, refinement of the partition of
states, flat transition arrays. One pass over the bytes of a whole buffer of documents gives, for every rule at once, the
places where a match starts. From the leftmost start the rule's own small automaton reads on to the longest end, and the
next start is looked for behind it, so spans are leftmost, longest and non-overlapping for each rule. No other matcher
takes part.

``Automaton.scan`` cuts the buffer into equal lanes that step together; a lane whose assumed start state differs from the
state in which the lane before it ended is run again, until all agree, so the result is that of one sequential pass. A state
that lasts (inside a long run) is tried for twice as many lanes in each turn.

A null text is the empty text, without spans. Offsets count code points, ends are exclusive. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """kind; head and tail: a match is the one followed by the other (a subset of regular expressions, see :class:`_Parser`);
    least: the least length of the tail, or without a head of the match, for it to count. A shorter one is taken, then dropped."""

    kind: str
    head: str
    tail: str
    least: int = 0


#: The first three are the base kinds, in the order in which ties are listed. A run of hex digits is one match if it has 24.
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", r"", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"", r"[0-9a-f]{24,}"),
    Rule("private_key", r"", r"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\x09-\x0d\x20]+-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("web_token", r"", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"", r"[a-z][a-z0-9+.-]+://[A-Za-z0-9._-]+:[A-Za-z0-9._~!$*+=-]{3,}@"),
    Rule("prefixed_key", r"", r"(ghp_|gho_|xoxb-|xoxp-|sk_live_|AIza)[A-Za-z0-9_-]{16,}"),
)
BASE = ("assign", "access", "hex")
#: Between documents: a byte that no UTF-8 text and no rule holds.
GAP = b"\xff"


class _Parser:
    """Literals, escapes, [classes], (groups), |, ?, *, +, {n}, {n,}, {n,m} and a leading (?i), over bytes, to an NFA."""

    def __init__(self, text: str):
        self.fold = text.startswith("(?i)")
        self.t, self.i = text[4:] if self.fold else text, 0
        self.eps: list[list[int]] = []
        self.move: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.move.append(None)
        return len(self.eps) - 1

    def parse(self) -> tuple[int, int]:
        out = self.either()
        if self.i != len(self.t):
            raise ValueError(f"at {self.i} of {self.t}")
        return out

    def either(self):
        a, b = self.state(), self.state()
        while True:
            s, e = self.run()
            self.eps[a].append(s)
            self.eps[e].append(b)
            if self.i < len(self.t) and self.t[self.i] == "|":
                self.i += 1
                continue
            return a, b

    def run(self):
        start = end = self.state()
        while self.i < len(self.t) and self.t[self.i] not in "|)":
            at = self.i
            s, e = self.atom()
            low, high = self.times()
            after, self.i = self.i, at
            first, last = self.state(), None
            last = first
            for k in range(max(low, 1 if high is None else high)):
                self.i = at
                s, e = self.atom()
                self.eps[last].append(s)
                if k >= low:
                    self.eps[last].append(e)
                last = e
            if high is None:
                if low:
                    self.eps[last].append(s)
                else:
                    self.eps[e].append(s)
                    self.eps[first].append(e)
            self.i = after
            self.eps[end].append(first)
            end = last
        return start, end

    def times(self):
        c = self.t[self.i : self.i + 1]
        if c and c in "?*+":
            self.i += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if m := re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.t, self.i):
            self.i = m.end()
            return int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1])
        return 1, 1

    def byte(self) -> int:
        c = self.t[self.i]
        self.i += 1
        if c == "\\":
            c = self.t[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.t[self.i - 2 : self.i], 16)
        return ord(c)

    def atom(self):
        c = self.t[self.i]
        if c == "(":
            self.i += 1
            out = self.either()
            self.i += 1
            return out
        if c == "[":
            self.i += 1
            found: set[int] = set()
            while self.t[self.i] != "]":
                a = b = self.byte()
                if self.t[self.i] == "-" and self.t[self.i + 1] != "]":
                    self.i += 1
                    b = self.byte()
                found |= set(range(a, b + 1))
            self.i += 1
        else:
            found = {self.byte()}
        if self.fold:
            found |= {x ^ 32 for x in found if chr(x).isascii() and chr(x).isalpha()}
        s, e = self.state(), self.state()
        self.move[s] = (frozenset(found), e)
        return s, e


class Automaton:
    """Flat transitions ``next[state * classes + class_of[byte]]``; ``fires[state]``: bit mask of rules that end there."""

    def __init__(self, table: np.ndarray, class_of: np.ndarray, fires: np.ndarray):
        self.classes, self.class_of, self.fires, self.table = table.shape[1], class_of, fires, table
        self.next = (table.astype(np.int32) * self.classes).ravel()
        # For short runs: rows of successors by byte, and states from which nothing fires any more.
        self.dead = next((i for i, row in enumerate(table.tolist()) if not fires[i] and set(row) == {i}), -1)

    def run(self, data: bytes, state: int = 0) -> list[tuple[int, int]]:
        """(position, mask) of every byte after which rules fire: the plain sequential pass, for tests."""
        out = []
        for i, b in enumerate(data):
            state = int(self.table[state, self.class_of[b]])
            if self.fires[state]:
                out.append((i, int(self.fires[state])))
        return out

    @property
    def rows(self) -> list[list[int]]:
        if not hasattr(self, "_rows"):
            self._rows = self.table[:, self.class_of].tolist()
        return self._rows

    def longest(self, data: bytes, start: int, stop: int) -> int:
        """The end of the longest match that begins at ``start``, -1 for none (of an anchored automaton)."""
        rows, fires, state, end = self.rows, self.fires, 0, start if self.fires[0] else -1
        for i in range(start, stop):
            state = rows[state][data[i]]
            if state == self.dead:
                break
            if fires[state]:
                end = i + 1
        return end

    def scan(self, data: np.ndarray, lane: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(positions, masks) of every byte of ``data`` after which rules fire."""
        n = len(data)
        lanes = max(1, -(-n // lane))
        codes = np.zeros(lanes * lane, np.uint8)
        codes[:n] = self.class_of[data]
        codes[n:] = self.class_of[10]
        steps = np.ascontiguousarray(codes.reshape(lanes, lane).T)
        hot = np.zeros(len(self.next), bool)
        hot[np.flatnonzero(self.fires) * self.classes] = True
        start, todo = np.zeros(lanes, np.int32), np.arange(lanes)
        end = np.zeros(lanes, np.int32)
        hits: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        run_of = np.zeros(lanes, np.int32)
        turn = 0
        while len(todo):
            turn += 1
            run_of[todo] = turn
            state, whole = start[todo], len(todo) == lanes
            for i in range(lane):
                state = self.next[state + (steps[i] if whole else steps[i][todo])]
                h = hot[state]
                if h.any():
                    w = np.flatnonzero(h)
                    found.append((todo[w] * lane + i, state[w], np.full(len(w), turn, np.int32)))
            end[todo] = state
            want = np.concatenate((np.zeros(1, np.int32), end[:-1]))
            todo = np.flatnonzero(want != start)
            new = want
            if turn > 3 and len(todo):
                # A state that outlasts its lane is tried for the lanes after it, too: in vain at worst.
                first, ahead = todo[0], 1 << min(turn - 2, 20)
                new = want.copy()
                new[first : first + ahead] = want[first]
                todo = np.flatnonzero(new != start)
            start = new
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at, state, turns = (np.concatenate(x) for x in zip(*found))
        valid = (turns == run_of[at // lane]) & (at < n)
        at, state = at[valid], state[valid]
        order = np.argsort(at, kind="stable")
        return at[order], self.fires[state[order] // self.classes]


def _determinise(nfas: list[tuple[_Parser, int, int]], backwards: bool) -> Automaton:
    """Subset construction. backwards: of the reversed languages, and a match may begin at any byte."""
    eps: dict[int, list[int]] = {}
    move: dict[int, list[tuple[frozenset[int], int]]] = {}
    accept, begin, at = {}, [], 0
    for k, (p, s, e) in enumerate(nfas):
        for i, (xs, m) in enumerate(zip(p.eps, p.move)):
            for x in xs:
                a, b = (x + at, i + at) if backwards else (i + at, x + at)
                eps.setdefault(a, []).append(b)
            if m:
                a, b = (m[1] + at, i + at) if backwards else (i + at, m[1] + at)
                move.setdefault(a, []).append((m[0], b))
        first, last = (e, s) if backwards else (s, e)
        accept[last + at] = 1 << k
        begin.append(first + at)
        at += len(p.eps)
    sets = list({m[0] for ms in move.values() for m in ms})
    key = [tuple(b in s for s in sets) for b in range(256)]
    numbers = {k: i for i, k in enumerate(dict.fromkeys(key))}
    class_of = np.array([numbers[k] for k in key], np.uint8)
    sample = [int(np.flatnonzero(class_of == c)[0]) for c in range(len(numbers))]

    words = -(-at // 64)

    def bits(states) -> np.ndarray:
        out = np.zeros(words, np.uint64)
        for x in states:
            out[x >> 6] |= np.uint64(1 << (x & 63))
        return out

    def closure(s: int) -> set[int]:
        seen, todo = {s}, [s]
        while todo:
            for x in eps.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return {x for x in seen if x in move or x in accept}

    closed = {d: bits(closure(d)) for ms in move.values() for _, d in ms}
    # after[s, c]: the set, as bits, that state s goes to by a byte of class c.
    after = np.zeros((at, len(sample), words), np.uint64)
    for s, ms in move.items():
        for m, d in ms:
            for c, b in enumerate(sample):
                if b in m:
                    after[s, c] |= closed[d]
    first = bits(set().union(*map(closure, begin)))
    base = first if backwards else np.zeros(words, np.uint64)
    ids, todo, rows = {first.tobytes(): 0}, [first], []
    members = lambda now: np.flatnonzero(np.unpackbits(now.view(np.uint8), bitorder="little"))
    for now in todo:
        new = np.bitwise_or.reduce(after[members(now)], axis=0, initial=np.uint64(0)) | base
        row = []
        raw, size = new.tobytes(), 8 * words
        for c in range(len(sample)):
            mark = raw[c * size : (c + 1) * size]
            if mark not in ids:
                ids[mark] = len(ids)
                todo.append(new[c])
            row.append(ids[mark])
        rows.append(row)
    fires = np.array([sum({accept[s] for s in members(now).tolist() if s in accept}) for now in todo], np.uint64)
    return _minimise(np.array(rows), class_of, fires)


def _minimise(table: np.ndarray, class_of: np.ndarray, fires: np.ndarray) -> Automaton:
    """Refines the partition by accepted rules until successors agree; one state is kept of each part."""
    part = np.unique(fires, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack((part, part[table])), axis=0, return_inverse=True)[1].ravel()
        if new.max() == part.max():
            break
        part = new
    _, one, _ = np.unique(part, return_index=True, return_inverse=True)
    rename = np.argsort(np.argsort(one))  # the start state stays number 0
    order = np.sort(one)
    return Automaton(rename[part[table[order]]], class_of, fires[order])


@dataclass(frozen=True)
class Compiled:
    """starts: all rules at once, from the end; whole, heads: each rule's own, anchored."""

    rules: tuple[Rule, ...]
    starts: Automaton
    whole: tuple[Automaton, ...]
    heads: tuple[Automaton | None, ...]

    def spans(self, texts: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """By number of the text, (start, rule number, end) in code points of all matches, in order."""
        buffer = GAP.join(texts)
        data = np.frombuffer(buffer, np.uint8)
        at, masks = self.starts.scan(data[::-1])
        at, masks = len(data) - 1 - at[::-1], masks[::-1]
        bounds = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(bounds, at, side="right")
        out: dict[int, list[tuple[int, int, int]]] = {}
        for k, rule in enumerate(self.rules):
            mine = np.flatnonzero(masks >> np.uint64(k) & np.uint64(1))
            places, docs, i, done = at[mine], doc[mine], 0, 0
            while i < len(places):
                s, d = int(places[i]), int(docs[i])
                e = self.whole[k].longest(buffer, s, int(bounds[d]) - 1)
                tail = self.heads[k].longest(buffer, s, e) if self.heads[k] else s
                if e - tail >= rule.least:
                    out.setdefault(d, []).append((s, k, e))
                done = max(e, s + 1)
                i = i + 1 if i + 1 >= len(places) or places[i + 1] >= done else int(np.searchsorted(places, done))
        for d, found in out.items():
            first = int(bounds[d]) - len(texts[d]) - 1
            text = data[first : first + len(texts[d])]
            ends = np.array([(s - first, e - first) for s, _, e in found])
            if not texts[d].isascii():  # bytes to code points: those that begin one are counted
                count = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
                ends = count[ends]
            out[d] = sorted((s, k, e) for (s, e), (_, k, _) in zip(ends.tolist(), found))
        return out


@lru_cache(maxsize=8)
def compile_rules(rules: tuple[Rule, ...] = RULES) -> Compiled:
    def nfa(text: str) -> tuple[_Parser, int, int]:
        p = _Parser(text)
        return (p, *p.parse())

    def joined(r: Rule) -> tuple[_Parser, int, int]:
        p, s, e = nfa(r.tail)
        if not r.head:
            return p, s, e
        h, a, b = nfa(r.head)
        at = len(h.eps)
        h.eps += [[x + at for x in xs] for xs in p.eps]
        h.move += [m and (m[0], m[1] + at) for m in p.move]
        h.eps[b].append(s + at)
        return h, a, e + at

    return Compiled(rules, _determinise([joined(r) for r in rules], True), tuple(_determinise([joined(r)], False) for r in rules), tuple(_determinise([nfa(r.head)], False) if r.head else None for r in rules))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: list[str] | None = None) -> DataFrame:
    """(doc_id[, carried columns], found: array of (kind, start, end)) for every row of ``docs``; a narrow map, no shuffle."""
    carry = carry or []
    # Built once, on the driver: some MB of transitions, whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast(compile_rules(rules))

    def work(batches):
        import pyarrow as pa

        common.claim("secrets")

        auto = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = common.utf8(batch.column(batch.num_columns - 1))
            for a, b in common.text_batches(texts, 8 << 20):
                hit = auto.spans([t or b"" for t in texts[a:b]])
                found = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in hit.get(i, ())] for i in range(b - a)]
                cols = [batch.column(j).slice(a, b - a) for j in range(batch.num_columns - 1)]
                names = ["doc_id", *carry]
                if "text" in carry:
                    cols, names = [*cols, batch.column(batch.num_columns - 1).slice(a, b - a)], [x for x in names if x != "text"] + ["text"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found, kind)], names=[*names, "found"])

    others = [c for c in carry if c != "text"]
    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in others), *(["text string"] if "text" in carry else []), "found array<struct<kind:string,start:bigint,end:bigint>>"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *others, F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span of a secret in ``text`` replaced by ``[kind]``; all columns and rows kept. Overlaps merge."""
    shared = docs.sparkSession.sparkContext.broadcast(compile_rules(rules))

    def work(batches):
        import pyarrow as pa

        common.claim("secrets")

        auto = shared.value
        for batch in batches:
            j = batch.schema.get_field_index("text")
            texts = common.utf8(batch.column(j))
            new: list[str | None] = []
            for a, b in common.text_batches(texts, 8 << 20):
                hit = auto.spans([t or b"" for t in texts[a:b]])
                for i, t in enumerate(texts[a:b]):
                    if t is None:
                        new.append(None)
                        continue
                    text = t.decode()
                    if i in hit:
                        out, done = [], 0
                        for s, k, e in hit[i]:
                            if s >= done:
                                out += [text[done:s], f"[{rules[k].kind}]"]
                            done = max(done, e)
                        text = "".join([*out, text[done:]])
                    new.append(text)
            cols = [pa.array(new, pa.string()) if c == j else batch.column(c) for c in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(work, docs.withColumn("text", F.col("text").cast("string")).schema)


def op4_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; base kinds counted and digested, all spans listed."""
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long")
    base = F.filter("found", lambda s: s.kind.isin(*BASE))
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in BASE), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


def digest(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()
