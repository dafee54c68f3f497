"""Secret scan by one deterministic automaton for all rules.

The rule patterns are compiled on the driver: pattern -> position automaton over bytes -> subset
construction -> minimisation -> one transition array. Each task then reads every byte of a text once,
for all rules together. Where the automaton accepts, a backward automaton of the single rule finds
where the match begins.

Cases: a null text counts as empty; a null doc_id keeps its row; repeated rows give repeated results;
other columns of the input are ignored; an empty table gives an empty result. Texts are read whole.
Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kind, pattern of the part in front, pattern of the rest, least length, and whether only
# the rest counts for that length (letters in front are then taken in either case).
KEYWORDS = "(password|passwd|secret|token|api_?key)"
ASSIGN_HEAD = KEYWORDS + "[\"']? *[:=] *[\"']?"
BASE_RULES = (
    ("assign", ASSIGN_HEAD, "[A-Za-z0-9+/_.=-]+", 12, True),
    ("access", "AKIA", "[A-Z0-9]+", 18, False),
    ("hex", "", "[0-9a-f]{16}[0-9a-f]*", 16, False),
)
MORE_RULES = (
    ("github", "gh[oprsu]_", "[A-Za-z0-9]+", 40, False),
    ("slack", "xox[abprs]-", "[A-Za-z0-9-]+", 15, False),
    ("google", "AIza", "[A-Za-z0-9_-]+", 39, False),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "", 0, False),
)


class Rule(NamedTuple):
    """``head`` then ``tail``; ``least`` counts the tail if ``tail_only``, else the whole match."""

    kind: str
    head: str
    tail: str
    least: int
    tail_only: bool

    @property
    def fold_case(self) -> bool:
        return self.tail_only


RULES = tuple(Rule(*r) for r in BASE_RULES + MORE_RULES)
BASE_KINDS = frozenset(r[0] for r in BASE_RULES)


# --- patterns to position automata -------------------------------------------------------------


class Piece(NamedTuple):
    """A sub-pattern: its byte positions that can come first and last, and whether it may be empty."""

    first: frozenset
    last: frozenset
    empty: bool


class Positions:
    """Position (Glushkov) automaton of a pattern built from literals, classes, ``()|?*+{n}``."""

    def __init__(self) -> None:
        self.sets: list[frozenset] = []
        self.follow: list[set] = []

    def byte_set(self, values: frozenset) -> Piece:
        self.sets.append(values)
        self.follow.append(set())
        one = frozenset([len(self.sets) - 1])
        return Piece(one, one, False)

    def then(self, a: Piece, b: Piece) -> Piece:
        for p in a.last:
            self.follow[p] |= b.first
        return Piece(
            a.first | b.first if a.empty else a.first,
            a.last | b.last if b.empty else b.last,
            a.empty and b.empty,
        )

    def repeated(self, a: Piece) -> Piece:
        for p in a.last:
            self.follow[p] |= a.first
        return a

    def parse(self, pattern: str, fold_case: bool) -> Piece:
        piece, rest = self._choice(pattern, 0, fold_case)
        if rest != len(pattern):
            raise ValueError(f"unbalanced pattern: {pattern}")
        return piece

    def _choice(self, s: str, i: int, fold: bool) -> tuple[Piece, int]:
        found, i = self._row(s, i, fold)
        while i < len(s) and s[i] == "|":
            other, i = self._row(s, i + 1, fold)
            found = Piece(found.first | other.first, found.last | other.last, found.empty or other.empty)
        return found, i

    def _row(self, s: str, i: int, fold: bool) -> tuple[Piece, int]:
        found = Piece(frozenset(), frozenset(), True)
        while i < len(s) and s[i] not in "|)":
            begin = i
            piece, i = self._atom(s, i, fold)
            end = i
            if i < len(s) and s[i] in "?*+":
                if s[i] in "*+":
                    piece = self.repeated(piece)
                if s[i] in "?*":
                    piece = piece._replace(empty=True)
                i += 1
            elif i < len(s) and s[i] == "{":
                close = s.index("}", i)
                for _ in range(int(s[i + 1 : close]) - 1):
                    found = self.then(found, piece)
                    piece, _ = self._atom(s[:end], begin, fold)
                i = close + 1
            found = self.then(found, piece)
        return found, i

    def _atom(self, s: str, i: int, fold: bool) -> tuple[Piece, int]:
        if s[i] == "(":
            piece, i = self._choice(s, i + 1, fold)
            return piece, i + 1
        if s[i] == "[":
            values, i = set(), i + 1
            while s[i] != "]":
                if i + 2 < len(s) and s[i + 1] == "-" and s[i + 2] != "]":
                    values |= set(range(ord(s[i]), ord(s[i + 2]) + 1))
                    i += 3
                else:
                    values.add(ord(s[i]))
                    i += 1
            return self.byte_set(frozenset(values)), i + 1
        if s[i] == "\\":
            i += 1
        letters = {s[i].lower(), s[i].upper()} if fold else {s[i]}
        return self.byte_set(frozenset(map(ord, letters))), i + 1


# --- position automata to one transition array ---------------------------------------------------


class Automaton(NamedTuple):
    """``table[state + byte]`` is the next state; states are multiples of 256.

    States from ``hot`` on accept; ``accepts`` names the rules that each of them accepts.
    """

    table: list
    start: int
    hot: int
    accepts: dict


def compile_rules(patterns: list[tuple[str, str, bool]], anywhere: bool, backward: bool = False) -> Automaton:
    """Minimal automaton for (name, pattern, fold case) triples.

    ``anywhere`` lets a match begin at every byte; ``backward`` reads patterns from their end.
    """
    positions, starts, accept = Positions(), set(), {}
    for name, pattern, fold in patterns:
        piece = positions.parse(pattern, fold)
        first, last = (piece.last, piece.first) if backward else (piece.first, piece.last)
        starts |= first
        for p in last:
            accept[p] = name
    follow = positions.follow
    if backward:
        turned: list[set] = [set() for _ in follow]
        for p, nexts in enumerate(follow):
            for q in nexts:
                turned[q].add(p)
        follow = turned

    # subset construction; a subset holds the positions just read
    begin: frozenset = frozenset()
    seen, todo, moves = {begin: 0}, [begin], []
    while todo:
        subset = todo.pop(0)
        options = set(starts) if anywhere or subset is begin else set()
        for p in subset:
            options |= follow[p]
        row = []
        by_byte: list[set] = [set() for _ in range(256)]
        for p in options:
            for b in positions.sets[p]:
                by_byte[b].add(p)
        for after in by_byte:
            key = frozenset(after)
            if not key and not anywhere:
                row.append(-1)
                continue
            if key not in seen:
                seen[key] = len(seen)
                todo.append(key)
            row.append(seen[key])
        moves.append(row)
    names = [frozenset(accept[p] for p in subset if p in accept) for subset in seen]

    # minimisation: split blocks until all states of a block move alike
    block = {n: k for k, n in enumerate(sorted(set(names), key=sorted))}
    of = [block[n] for n in names]
    while True:
        signature = [(of[s], tuple(-1 if t < 0 else of[t] for t in moves[s])) for s in range(len(moves))]
        fresh: dict = {}
        new = [fresh.setdefault(x, len(fresh)) for x in signature]
        if len(fresh) == len(set(of)):
            break
        of = new
    of = new
    member = {}
    for state, k in enumerate(of):
        member.setdefault(k, state)
    order = sorted(member, key=lambda k: (bool(names[member[k]]), k))  # accepting states last
    place = {k: n * 256 for n, k in enumerate(order)}
    table, accepts = [], {}
    for k in order:
        state = member[k]
        table += [-1 if t < 0 else place[of[t]] for t in moves[state]]
        if names[state]:
            accepts[place[k]] = tuple(sorted(names[state]))
    hot = min(accepts, default=len(table))
    return Automaton(table, place[of[0]], hot, accepts)


class Scanner:
    """All rules as one automaton, and each rule alone forward and backward for its match bounds."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = {r.kind: r for r in rules}
        self.rank = {r.kind: k for k, r in enumerate(rules)}
        # a match is first seen at the first byte of a one-or-more tail
        text = {r.kind: r.head + r.tail for r in rules}
        self.all = compile_rules([(r.kind, text[r.kind], r.fold_case) for r in rules], anywhere=True)
        self.alone = {r.kind: compile_rules([(r.kind, text[r.kind], r.fold_case)], True) for r in rules}
        self.back = {r.kind: compile_rules([(r.kind, text[r.kind], r.fold_case)], False, True) for r in rules}
        self.head = {
            r.kind: compile_rules([(r.kind, r.head, r.fold_case)], False) for r in rules if r.tail_only
        }

    def runs(self, data: bytes) -> dict[str, list[list[int]]]:
        """Per rule the stretches [first, end) of bytes at which a match of the rule ends."""
        table, hot, accepts, state = self.all.table, self.all.hot, self.all.accepts, self.all.start
        found: dict[str, list[list[int]]] = {}
        for i, byte in enumerate(data):
            state = table[state + byte]
            if state >= hot:
                for kind in accepts[state]:
                    runs = found.setdefault(kind, [])
                    if runs and runs[-1][1] == i:
                        runs[-1][1] = i + 1
                    else:
                        runs.append([i, i + 1])
        return found

    def _begin(self, kind: str, data: bytes, at: int, least: int) -> int | None:
        """Leftmost begin, not before ``least``, of a match that ends with byte ``at``."""
        auto, best = self.back[kind], None
        state = auto.start
        for i in range(at, least - 1, -1):
            state = auto.table[state + data[i]]
            if state < 0:
                break
            if state >= auto.hot:
                best = i
        return best

    def _next_end(self, kind: str, data: bytes, begin: int, end: int) -> int | None:
        auto = self.alone[kind]
        state = auto.start
        for i in range(begin, end):
            state = auto.table[state + data[i]]
            if state >= auto.hot:
                return i
        return None

    def _head_length(self, kind: str, data: bytes, begin: int, end: int) -> int:
        auto, length = self.head[kind], 0
        state = auto.start
        for i in range(begin, end):
            state = auto.table[state + data[i]]
            if state < 0:
                break
            if state >= auto.hot:
                length = i + 1 - begin
        return length

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """Leftmost, non-overlapping matches per rule that are long enough: (kind, begin, end) in bytes."""
        out = []
        for kind, runs in self.runs(data).items():
            rule, last = self.rules[kind], 0
            for first, end in runs:
                at: int | None = first
                while at is not None:
                    begin = self._begin(kind, data, at, last)
                    if begin is not None:
                        counted = end - begin
                        if rule.tail_only:
                            counted -= self._head_length(kind, data, begin, end)
                        if counted >= rule.least:
                            out.append((kind, begin, end))
                        last = end
                        break
                    # this stretch began inside the match before: look again from that match's end
                    at = self._next_end(kind, data, last, end)
        out.sort(key=lambda x: (x[1], self.rank[x[0]]))
        return out


def to_code_points(data: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte offsets as code points; spans come ordered by their begin."""
    if data.isascii():
        return spans
    ends = sorted({x for _, a, b in spans for x in (a, b)})
    at, points, before = {}, 0, 0
    for end in ends:
        points += len(data[before:end].decode("utf-8", "ignore"))
        at[end], before = points, end
    return [(kind, at[a], at[b]) for kind, a, b in spans]


FINDINGS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: counts of the base kinds, digest of the base spans, and all spans."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))  # transition arrays of about 1 MB

    def scan(texts: pd.Series) -> pd.DataFrame:
        find, rows = scanner.value, []
        for text in texts:
            data = text.encode("utf-8")
            spans = to_code_points(data, find.spans(data))
            base = [s for s in spans if s[0] in BASE_KINDS]
            kinds = [s[0] for s in base]
            digest = hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest()
            counts = (kinds.count("assign"), kinds.count("access"), kinds.count("hex"))
            rows.append((*counts, digest, ",".join("%s:%d:%d" % s for s in spans)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FINDINGS.split(", ")])

    found = F.pandas_udf(scan, FINDINGS)(F.coalesce("text", F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found")).select("doc_id", "found.*")
