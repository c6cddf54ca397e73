"""Secret scans: one deterministic automaton for all rules, one pass over a text's bytes.

Rule regexes are parsed into byte-set automata, made deterministic by subset construction and
minimised into one transition array. The subsets are kept in order of where a match began, so the
automaton itself follows the leftmost match of each rule; where it ends, the rule's reversed
automaton, built the same way, walks back to its start.

Rules may use literals, escapes, classes, groups, ``|``, ``? * + {n} {n,} {n,m}`` and ``(?i:...)``.
A rule whose match, once complete, could pause and become complete again is refused with
ValueError: following it would need a second look at bytes already read.

Defined cases: null and empty texts have no spans; offsets count code points, ends are exclusive;
matches of one kind do not overlap, those of different kinds may; repeated rows give repeated
rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_task, id_and_text, slices


@dataclass(frozen=True)
class Rule:
    """``least`` bounds the whole match, or the value that follows ``head`` if that is given."""

    kind: str
    regex: str
    least: int = 1
    head: str | None = None


# Fixed patterns.
HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
RULES = (
    Rule("assign", HEAD + r"[A-Za-z0-9+/_.=-]+", 6, HEAD),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    # A run of hex digits shorter than 24 is dropped whole, so the bound can stand in the automaton.
    Rule("hex", r"[0-9a-f]{24,}", 24),
)

_ESCAPES = {"d": "0-9", "w": "A-Za-z0-9_", "s": "\t-\r ", "n": "\n", "t": "\t", "r": "\r"}


class _Parser:
    """A regex as nested tuples: ('set', byte mask), ('cat', ...), ('alt', ...), ('rep', x, lo, hi)."""

    def __init__(self, regex: str):
        self.s, self.i, self.fold = regex, 0, False

    def tree(self):
        out = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"unbalanced ) in {self.s}")
        return out

    def alternatives(self):
        options = [self.sequence()]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", *options)

    def sequence(self):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", *parts)

    def repeated(self, node):
        found = re.compile(r"[?*+]|\{(\d+)(,?)(\d*)\}").match(self.s, self.i)
        if not found:
            return node
        self.i = found.end()
        if found[0] in "?*+":
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[found[0]]
        else:
            low = int(found[1])
            high = int(found[3]) if found[3] else None if found[2] else low
        return ("rep", node, low, high)

    def atom(self):
        c = self.s[self.i]
        self.i += 1
        if c == "(":
            before, flags = self.fold, re.compile(r"\?(i?):").match(self.s, self.i)
            if flags:
                self.i = flags.end()
                self.fold = self.fold or bool(flags[1])
            node = self.alternatives()
            if self.s[self.i : self.i + 1] != ")":
                raise ValueError(f"missing ) in {self.s}")
            self.i += 1
            self.fold = before
            return node
        if c == "[":
            return ("set", self.folded(self.char_class()))
        if c == ".":
            return ("set", ((1 << 256) - 1) & ~(1 << 10))
        if c == "\\":
            return ("set", self.folded(self.escape()))
        parts = [("set", self.folded(1 << b)) for b in c.encode()]
        return parts[0] if len(parts) == 1 else ("cat", *parts)

    def escape(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return 1 << int(self.s[self.i - 2 : self.i], 16)
        return _ranges(_ESCAPES[c]) if c in _ESCAPES else 1 << ord(c)

    def char_class(self) -> int:
        negated = self.s[self.i] == "^"
        self.i += negated
        mask, first = 0, True
        while first or self.s[self.i] != "]":
            first = False
            low = self.class_member()
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]" and low.bit_count() == 1:
                self.i += 1
                high = self.class_member().bit_length()
                low = (1 << high) - low
            mask |= low
        self.i += 1
        return ((1 << 256) - 1) & ~mask if negated else mask

    def class_member(self) -> int:
        if self.s[self.i] == "\\":
            self.i += 1
            return self.escape()
        self.i += 1
        return 1 << ord(self.s[self.i - 1])

    def folded(self, mask: int) -> int:
        if not self.fold:
            return mask
        letters = ((1 << 26) - 1) << 65
        return mask | (mask & letters) << 32 | (mask >> 32) & letters


def _ranges(spec: str) -> int:
    found = re.findall(r"(.)-(.)|(.)", spec, re.S)
    return sum(((1 << ord(b) + 1) - (1 << ord(a))) if a else 1 << ord(c) for a, b, c in found)


class _Nfa:
    """Thompson automaton of a tree; state 1 accepts."""

    def __init__(self, tree, backwards: bool = False):
        self.moves: list[list[tuple[int, int]]] = [[], []]
        self.skips: list[list[int]] = [[], []]
        self.backwards = backwards
        self.add(tree, 0, 1)

    def state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def add(self, node, start: int, end: int) -> None:
        kind, *rest = node
        if kind == "set":
            self.moves[start].append((rest[0], end))
        elif kind == "alt":
            for option in rest:
                self.add(option, start, end)
        elif kind == "cat":
            for part in reversed(rest) if self.backwards else rest:
                middle = self.state()
                self.add(part, start, middle)
                start = middle
            self.skips[start].append(end)
        else:
            part, low, high = rest
            for _ in range(low):
                middle = self.state()
                self.add(part, start, middle)
                start = middle
            if high is None:
                loop = self.state()
                self.skips[start].append(loop)
                self.add(part, loop, loop)
                self.skips[loop].append(end)
            else:
                for _ in range(high - low):
                    self.skips[start].append(end)
                    middle = self.state()
                    self.add(part, start, middle)
                    start = middle
                self.skips[start].append(end)

    def closed(self, states) -> frozenset[int]:
        seen, left = set(states), list(states)
        while left:
            for t in self.skips[left.pop()]:
                if t not in seen:
                    seen.add(t)
                    left.append(t)
        return frozenset(seen)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closed({t for s in states for mask, t in self.moves[s] if mask >> byte & 1})


class _Leftmost:
    """One rule's states: subsets in order of their start, or the subset of the running match."""

    def __init__(self, rule: Rule):
        self.rule, self.nfa = rule, _Nfa(_Parser(rule.regex).tree())
        self.begin = self.nfa.closed({0})
        if 1 in self.begin:
            raise ValueError(f"rule {rule.kind} matches the empty string")
        self.initial: tuple[frozenset[int], ...] = ()

    def accepts(self, state) -> bool:
        return bool(state) and 1 in state[-1]

    def step(self, state, byte: int):
        if self.accepts(state):
            longer = self.nfa.step(state[-1], byte)
            if longer:
                if 1 not in longer:
                    raise ValueError(f"rule {self.rule.kind}: a complete match may become incomplete")
                return (longer,)
            state = ()
            if 1 in self.nfa.step(self.begin, byte):
                raise ValueError(f"rule {self.rule.kind}: two matches may touch")
        out: list[frozenset[int]] = []
        seen: set[int] = set()
        for group in (*state, self.begin):
            now = self.nfa.step(group, byte) - seen
            if now:
                if 1 in now and out:
                    raise ValueError(f"rule {self.rule.kind}: a later match may complete first")
                out.append(frozenset(now))
                seen |= now
                if 1 in now:
                    break
        return tuple(out)


def _minimal(table: np.ndarray, output: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Merge states with equal outputs for all continuations (partition refinement)."""
    block = np.unique(output, return_inverse=True)[1]
    while True:
        signature = np.column_stack([block, block[table]])
        finer = np.unique(signature, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    return block[table[first]], output[first], int(block[start])


def _explored(initial, step, output):
    """All states reachable from ``initial``: (table of 256 columns, outputs)."""
    numbers, order, rows = {initial: 0}, [initial], []
    for state in order:
        row, seen = [], {}
        for byte in range(256):
            following = step(state, byte)
            if following not in numbers:
                numbers[following] = len(order)
                order.append(following)
            row.append(numbers[following])
        rows.append(row)
    return np.array(rows, dtype=np.int64), np.array([output(s) for s in order], dtype=np.int64)


def _byte_classes(masks: list[int]) -> list[int]:
    """For each byte a byte that no mask tells from it."""
    kinds: dict[tuple[int, ...], int] = {}
    return [kinds.setdefault(tuple(m >> b & 1 for m in masks), b) for b in range(256)]


def _memo(step, classes: list[int]):
    known: dict = {}

    def cached(state, byte: int):
        key = (state, classes[byte])
        if key not in known:
            known[key] = step(*key)
        return known[key]

    return cached


@dataclass(frozen=True)
class Automaton:
    """``forward[s + byte]`` is the next state times 256; states from ``accepting`` on complete a rule.

    ``matched[s / 256]`` has a bit for each rule. ``backward``: per rule, the reversed automaton's
    (transitions, start, dead state, accepting flags).
    """

    rules: tuple[Rule, ...]
    forward: list[int]
    start: int
    accepting: int
    matched: list[int]
    backward: list[tuple[list[int], int, int, list[bool]]]


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Automaton:
    parts = [_Leftmost(r) for r in rules]
    classes = _byte_classes([m for p in parts for moves in p.nfa.moves for m, _ in moves])
    steps = [_memo(p.step, classes) for p in parts]
    joint = _memo(lambda state, b: tuple(f(s, b) for f, s in zip(steps, state, strict=True)), classes)
    table, output = _explored(
        tuple(p.initial for p in parts),
        joint,
        lambda state: sum(p.accepts(s) << k for k, (p, s) in enumerate(zip(parts, state, strict=True))),
    )
    table, output, start = _minimal(table, output, 0)
    rank = np.argsort(np.argsort(output > 0, kind="stable"), kind="stable")
    order = np.argsort(rank)
    forward = (rank[table[order]] * 256).reshape(-1).tolist()
    backward = []
    for rule in rules:
        nfa = _Nfa(_Parser(rule.regex).tree(), backwards=True)
        begin = nfa.closed({0})
        back, done = _explored(begin, _memo(nfa.step, classes), lambda s: 1 in s)
        back, done, first = _minimal(back, done, 0)
        dead = next((i for i in range(len(back)) if not done[i] and (back[i] == i).all()), -1)
        backward.append(((back * 256).reshape(-1).tolist(), first * 256, dead * 256, [bool(x) for x in done]))
    return Automaton(
        tuple(rules),
        forward,
        int(rank[start]) * 256,
        int((output == 0).sum()) * 256,
        output[order].tolist(),
        backward,
    )


def match_ends(data: bytes, machine: Automaton) -> list[tuple[int, int]]:
    """(rule, end) of every match, in one pass over the bytes."""
    forward, accepting, matched = machine.forward, machine.accepting, machine.matched
    found, s, live = [], machine.start, 0
    walk = enumerate(data)
    for _, byte in walk:
        s = forward[s + byte]
        if s < accepting:
            continue
        live = matched[s >> 8]
        for i, byte in walk:
            s = forward[s + byte]
            now = matched[s >> 8]
            if over := live & ~now:
                found += [(k, i) for k in range(len(machine.rules)) if over >> k & 1]
            live = now
            if not live:
                break
    return found + [(k, len(data)) for k in range(len(machine.rules)) if live >> k & 1]


def _start_of(data: bytes, end: int, low: int, back: tuple[list[int], int, int, list[bool]]) -> int:
    table, s, dead, done = back
    best = end
    for i in range(end - 1, low - 1, -1):
        s = table[s + data[i]]
        if s == dead:
            break
        if done[s >> 8]:
            best = i
    return best


def find_secrets(data: bytes, machine: Automaton, heads: list) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes, ordered; ``heads``: compiled head pattern of each rule or None."""
    spans, low = [], [0] * len(machine.rules)
    for k, end in match_ends(data, machine):
        start = _start_of(data, end, low[k], machine.backward[k])
        low[k] = end
        value = heads[k].match(data, start, end).end() if heads[k] else start
        if end - value >= machine.rules[k].least:
            spans.append((start, k, end))
    return sorted(spans)


def _head_patterns(rules: tuple[Rule, ...]) -> list:
    return [re.compile(r.head.encode()) if r.head else None for r in rules]


def _points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as code points."""
    if not spans or data.isascii():
        return spans
    head = np.frombuffer(data, dtype=np.uint8) & 0xC0 != 0x80
    before = np.concatenate([[0], np.cumsum(head)])
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, and ``secrets``, an array of (kind, start, end)."""
    machine = compile_rules(rules)

    def run(parts):
        heads = _head_patterns(machine.rules)
        for part in parts:
            out = []
            for text in part.column("text").to_pylist():
                data = text.encode()
                spans = _points(data, find_secrets(data, machine, heads))
                out.append(
                    [{"kind": machine.rules[k].kind, "start": a, "end": b} for a, k, b in spans]
                )
            yield {"doc_id": part.column("doc_id"), "secrets": out}

    return by_task(
        id_and_text(docs, id_col, text_col),
        run,
        "doc_id long, secrets array<struct<kind: string, start: long, end: long>>",
    )


def masked(
    docs: DataFrame,
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    mask: str = "[{kind}]",
    length_col: str | None = None,
) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; all rows stay.

    Overlapping spans are replaced together, under the kind of the first. Null texts stay null.
    ``length_col`` gets the number of code points of the texts that are changed.
    """
    machine, names = compile_rules(rules), docs.columns
    at = names.index(text_col)
    counted = names.index(length_col) if length_col else None

    def task(batches):
        return run(slices(batches))

    def run(batches):
        heads = _head_patterns(machine.rules)
        for batch in batches:
            texts, changed = [], {}
            for row, text in enumerate(batch.column(at).to_pylist()):
                if text is not None:
                    data = text.encode()
                    pieces, done = [], 0
                    for start, k, end in find_secrets(data, machine, heads):
                        if start >= done:
                            pieces += [data[done:start], mask.format(kind=machine.rules[k].kind).encode()]
                        done = max(done, end)
                    if pieces:
                        text = b"".join([*pieces, data[done:]]).decode()
                        changed[row] = len(text)
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            if counted is not None and changed:
                lengths = columns[counted].to_pylist()
                for row, length in changed.items():
                    lengths[row] = length
                columns[counted] = pa.array(lengths, type=batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(task, docs.schema)


def digests(spans: list[tuple[str, int, int]]) -> tuple[str, str]:
    """The spans as ``kind:start:end``, comma-joined, and their SHA-256."""
    text = ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)
    return text, hashlib.sha256(text.encode()).hexdigest()
