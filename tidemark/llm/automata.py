"""Regular expressions over bytes as minimal deterministic automata in flat transition arrays.

The syntax: literals, ``.``-free; ``[...]`` with ranges and ``^``; ``(...)`` and ``(?i:...)``;
``|``; ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``; escapes of one character and ``\\xHH``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Node = tuple


class Parser:
    """A pattern as a tree of ('set', bytes), ('cat', nodes), ('alt', nodes) and ('rep', node, least, most)."""

    def __init__(self, pattern: str) -> None:
        self.p, self.i, self.fold = pattern, 0, False

    def parse(self) -> Node:
        node = self._alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unbalanced ) at {self.i} in {self.p!r}")
        return node

    def _peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def _alternatives(self) -> Node:
        options = [self._sequence()]
        while self._peek() == "|":
            self.i += 1
            options.append(self._sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def _sequence(self) -> Node:
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated())
        return ("cat", parts)

    def _repeated(self) -> Node:
        node = self._atom()
        while (c := self._peek()) and c in "?*+{":
            self.i += 1
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                least, most = int(low), int(high) if high else None if comma else int(low)
                self.i = end + 1
            node = ("rep", node, least, most)
        return node

    def _atom(self) -> Node:
        c = self._peek()
        if c == "(":
            self.i += 1
            outer = self.fold
            if self.p.startswith("?i:", self.i):
                self.fold = True
                self.i += 3
            node = self._alternatives()
            self.fold = outer
            self.i += 1
            return node
        if c == "[":
            return ("set", self._folded(self._class()))
        return ("set", self._folded({self._one()}))

    def _folded(self, members: set[int]) -> frozenset[int]:
        if not self.fold:
            return frozenset(members)
        return frozenset({ord(x) for b in members for c in [chr(b)] for x in ((c.lower(), c.upper()) if c.isascii() else (c,))})

    def _one(self) -> int:
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

    def _class(self) -> set[int]:
        self.i += 1
        negated = self._peek() == "^"
        self.i += negated
        members: set[int] = set()
        while self._peek() != "]":
            low = self._one()
            if self._peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                members.update(range(low, self._one() + 1))
            else:
                members.add(low)
        self.i += 1
        return set(range(256)) - members if negated else members


def backwards(node: Node) -> Node:
    """The tree of the same matches, read from their last byte to their first."""
    if node[0] == "cat":
        return ("cat", [backwards(n) for n in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [backwards(n) for n in node[1]])
    if node[0] == "rep":
        return ("rep", backwards(node[1]), *node[2:])
    return node


class Nfa:
    """Thompson construction: moves on sets of bytes, and empty moves."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, node: Node, start: int) -> int:
        """The state after ``node`` when read from ``start``."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for option in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(option, first)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start)
        end = self.state()
        self.empty[start].append(end)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            after = self.add(inner, loop)
            self.empty[after] += [loop, end]
        else:
            for _ in range(most - least):
                start = self.add(inner, start)
                self.empty[start].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """State 0 is the start. next[state * width + group[byte]] is the next state; accept[state] has bit r set if rule r ends there."""

    next: np.ndarray
    group: np.ndarray
    accept: np.ndarray
    width: int

    def resets(self) -> np.ndarray:
        """Of each byte, whether it leads to the start from every state, so that no match can hold it."""
        table = self.next.reshape(-1, self.width)
        return (table == 0).all(axis=0)[self.group]

    def shortest(self) -> int:
        """Fewest bytes that lead to an accepting state."""
        reached, seen, n = {0}, {0}, 0
        while reached and not any(self.accept[s] for s in reached):
            reached = {int(t) for s in reached for t in self.next[s * self.width : (s + 1) * self.width]} - seen
            seen |= reached
            n += 1
        return n


def compile_rules(patterns: list[str], anywhere: bool, reverse: bool = False) -> Dfa:
    """One minimal automaton for all patterns; with ``anywhere`` a match may start at every byte, with ``reverse`` it reads them from the end.

    Without it, state 0 is the start and one state without a way out is reached when no
    match can follow.
    """
    nfa = Nfa()
    start = nfa.state()
    ends: dict[int, int] = {}
    for rule, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.empty[start].append(first)
        tree = Parser(pattern).parse()
        ends[nfa.add(backwards(tree) if reverse else tree, first)] = rule
    if anywhere:
        nfa.moves[start].append((frozenset(range(256)), start))

    # bytes that no set tells apart share a column
    kinds = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    signature: dict[tuple[bool, ...], int] = {}
    group = np.array([signature.setdefault(tuple(b in s for s in kinds), len(signature)) for b in range(256)], dtype=np.uint8)
    sample = [int(np.argmax(group == g)) for g in range(len(signature))]
    width = len(sample)

    # subset construction
    first = nfa.closure({start})
    number, order, table = {first: 0}, [first], []
    for subset in order:
        row = []
        for b in sample:
            to = nfa.closure({t for s in subset for held, t in nfa.moves[s] if b in held})
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        table.append(row)
    following = np.array(table, dtype=np.int64)
    accept = np.array([sum(1 << ends[s] for s in subset if s in ends) for subset in order], dtype=np.int64)

    # minimisation: split the classes of states until all of a class move to the same classes
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        rows = np.concatenate([block[:, None], block[following]], axis=1)
        finer = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    rename = np.full(block.max() + 1, -1)
    member = []
    for s in [0, *range(len(order))]:
        if rename[block[s]] < 0:
            rename[block[s]] = len(member)
            member.append(s)
    small = rename[block[following[member]]]
    return Dfa(small.astype(np.int32).reshape(-1), group, accept[member].astype(np.int32), width)
