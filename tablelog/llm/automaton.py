"""Regular expressions to one minimal deterministic automaton over bytes.

The grammar is the part of regular expressions that scan rules need: literals,
escapes (``\\xHH``, ``\\.``), classes, groups, ``|``, ``?``, ``*``, ``+``,
``{n}``, ``{n,}`` and ``{n,m}``; ``(?i:...)`` matches ASCII letters in either case.
"""

from __future__ import annotations

import re
from collections import defaultdict

END = None


class _Parser:
    """Recursive descent; a node is ('set', frozenset), ('cat', [..]), ('alt', [..]) or ('rep', node, low, high)."""

    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self, s: str) -> bool:
        if self.p.startswith(s, self.i):
            self.i += len(s)
            return True
        return False

    def parse(self):
        node = self.alternatives()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i:]!r}")
        return node

    def alternatives(self):
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        node = self.atom()
        while True:
            if self.take("?"):
                node = ("rep", node, 0, 1)
            elif self.take("*"):
                node = ("rep", node, 0, END)
            elif self.take("+"):
                node = ("rep", node, 1, END)
            elif m := re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.p, self.i):
                self.i = m.end()
                low = int(m[1])
                node = ("rep", node, low, low if not m[2] else int(m[3]) if m[3] else END)
            else:
                return node

    def atom(self):
        if self.take("("):
            outer = self.fold
            if self.take("?i:"):
                self.fold = True
            else:
                self.take("?:")
            node = self.alternatives()
            self.fold = outer
            if not self.take(")"):
                raise ValueError("missing )")
            return node
        if self.take("["):
            negated, found = self.take("^"), set()
            while not self.take("]"):
                low = self.byte()
                if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] != "]":
                    self.i += 1
                    found |= set(range(low, self.byte() + 1))
                else:
                    found.add(low)
            found = self.folded(found)
            return ("set", frozenset(range(256)) - found if negated else frozenset(found))
        return ("set", frozenset(self.folded({self.byte()})))

    def byte(self) -> int:
        c = self.peek()
        self.i += 1
        if c == "\\":
            c = self.peek()
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        if ord(c) > 127:
            raise ValueError("rules are over ASCII")
        return ord(c)

    def folded(self, found: set[int]) -> set[int]:
        if not self.fold:
            return found
        return found | {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}


def _reversed(node):
    if node[0] == "cat":
        return ("cat", [_reversed(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [_reversed(x) for x in node[1]])
    if node[0] == "rep":
        return ("rep", _reversed(node[1]), *node[2:])
    return node


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.on: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append(None)
        return len(self.free) - 1

    def add(self, node, start: int) -> int:
        """Attach ``node`` behind ``start`` and return the state where it ends."""
        kind = node[0]
        if kind == "set":
            mid, end = self.state(), self.state()
            self.free[start].append(mid)
            self.on[mid] = (node[1], end)
            return end
        if kind == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(x, begin)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start)
        end = self.state()
        if high is END:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            self.free[loop].append(end)
        else:
            self.free[start].append(end)
            for _ in range(high - low):
                start = self.add(inner, start)
                self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def _byte_classes(sets) -> list[int]:
    """Number of the class of each byte: bytes that no set tells apart share one."""
    key = [tuple(b in s for s in sets) for b in range(256)]
    number = {k: n for n, k in enumerate(dict.fromkeys(key))}
    return [number[k] for k in key]


def _minimal(rows: list[list[int]], masks: list[int]) -> tuple[list[list[int]], list[int]]:
    """Partition refinement from the accept masks; state 0 stays the start."""
    block = list(masks)
    count = len(set(block))
    while True:
        names: dict = {}
        block = [names.setdefault((block[s], *(block[t] for t in row)), len(names)) for s, row in enumerate(rows)]
        if len(names) == count:
            break
        count = len(names)
    first = {}
    for s, b in enumerate(block):
        first.setdefault(b, s)
    return [[block[t] for t in rows[first[b]]] for b in range(count)], [masks[first[b]] for b in range(count)]


class Automaton:
    """Transition arrays of all patterns together.

    ``table[state + byte]`` is the next state; states are multiples of 256, and
    those that accept some pattern are ``hot`` or more.  ``masks[state >> 8]``
    has bit k set where pattern k ends.  With ``anywhere`` a match may begin at
    any byte; else only at the first, and ``dead`` is the state of no return.
    """

    def __init__(self, patterns: list[str], anywhere: bool = True, backwards: bool = False):
        nfa, begin, ends = _Nfa(), [], {}
        for k, p in enumerate(patterns):
            node = _Parser(p).parse()
            s = nfa.state()
            begin.append(s)
            ends[nfa.add(_reversed(node) if backwards else node, s)] = 1 << k
        of_byte = _byte_classes({x[0] for x in nfa.on if x})
        samples = [of_byte.index(c) for c in range(max(of_byte) + 1)]
        start = nfa.closure(begin)
        number, todo, rows = {start: 0}, [start], []
        while todo:
            states, row = todo.pop(0), []
            for b in samples:
                after = {x[1] for s in states if (x := nfa.on[s]) and b in x[0]}
                after = nfa.closure(after | set(begin) if anywhere else after)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row.append(number[after])
            rows.append(row)
        masks = [0] * len(number)
        for states, n in number.items():
            for s, bit in ends.items():
                masks[n] |= bit * (s in states)
        rows, masks = _minimal(rows, masks)
        order = [0, *sorted(range(1, len(rows)), key=lambda s: (masks[s] != 0, s))]
        place = {s: n for n, s in enumerate(order)}
        self.masks = [masks[s] for s in order]
        self.hot = 256 * next((n for n, m in enumerate(self.masks) if m and n), len(rows))
        self.table = [256 * place[rows[s][of_byte[b]]] for s in order for b in range(256)]
        self.dead = next(
            (256 * n for n, s in enumerate(order) if not masks[s] and all(t == s for t in rows[s])), -1
        )
        self.n_states = len(rows)

    def ends(self, data: bytes) -> dict[int, list[int]]:
        """End of each maximal match by pattern, in one pass over the bytes."""
        table, hot, s, hits = self.table, self.hot, 0, []
        for i, b in enumerate(data):
            s = table[s + b]
            if s >= hot:
                hits.append((i, s))
        found: dict[int, list[int]] = defaultdict(list)
        for i, s in hits:
            mask, k = self.masks[s >> 8], 0
            while mask:
                if mask & 1:
                    ends = found[k]
                    if ends and ends[-1] == i:
                        ends[-1] = i + 1
                    else:
                        ends.append(i + 1)
                mask >>= 1
                k += 1
        return found

    def longest_back(self, data: bytes, end: int, least: int) -> int:
        """Smallest start >= ``least`` of a match of this backwards automaton that ends at ``end``; -1 if none."""
        s, start = 0, -1
        for i in range(end - 1, least - 1, -1):
            s = self.table[s + data[i]]
            if s >= self.hot:
                start = i
            elif s == self.dead:
                break
        return start
