"""Regular expressions over bytes to minimal deterministic automata: parse, subset construction, minimisation.

The syntax is the usual one for literals, ``.``, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``,
``{m,n}``, ``\\xHH``, ``\\n \\t \\r`` and escaped punctuation. Matching is leftmost-longest.
"""

from __future__ import annotations

from itertools import count


class _Parser:
    """Pattern -> nested tuples: ("set", frozenset), ("cat", parts), ("alt", parts), ("rep", part, low, high)."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def parse(self):
        node = self.either()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} of {self.text!r}")
        return node

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def either(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            node = self.atom()
            while (c := self.peek()) and c in "?*+{":
                self.at += 1
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
                if c == "{":
                    end = self.text.index("}", self.at)
                    low_, comma, high_ = self.text[self.at : end].partition(",")
                    low, high = int(low_), int(high_) if high_ else None if comma else int(low_)
                    self.at = end + 1
                node = ("rep", node, low, high)
            parts.append(node)
        return ("cat", parts)

    def atom(self):
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            node = self.either()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.text!r}")
            self.at += 1
            return node
        if c == "[":
            return ("set", self.members())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", frozenset([self.escape() if c == "\\" else ord(c)]))

    def escape(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def members(self) -> frozenset[int]:
        negated = self.peek() == "^"
        self.at += negated
        found: set[int] = set()
        while (c := self.text[self.at]) != "]":
            self.at += 1
            low = self.escape() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                c = self.text[self.at]
                self.at += 1
                high = self.escape() if c == "\\" else ord(c)
            found |= set(range(low, high + 1))
        self.at += 1
        return frozenset(range(256)) - found if negated else frozenset(found)


def _reversed(node):
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", _reversed(node[1]), *node[2:])
    parts = [_reversed(x) for x in node[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def build(self, node, start: int) -> int:
        """Adds ``node`` from ``start``; its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.build(part, first)].append(end)
            return end
        _, part, low, high = node
        for _ in range(low):
            start = self.build(part, start)
        end = self.state()
        self.empty[start].append(end)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            last = self.build(part, loop)
            self.empty[last] += [loop, end]
        else:
            for _ in range(high - low):
                start = self.build(part, start)
                self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


class Dfa:
    """Minimal automaton. ``classes`` maps a byte to its class (for bytes.translate); ``step[state * width + class]`` is
    the next state times ``width``; states from ``first_hit`` on accept; ``hits[state // width]`` names what they accept."""

    def __init__(self, patterns: list[str], search: bool = False, backwards: bool = False):
        nfa = _Nfa()
        root, ends = nfa.state(), {}
        for k, pattern in enumerate(patterns):
            node = _Parser(pattern).parse()
            first = nfa.state()
            nfa.empty[root].append(first)
            ends[nfa.build(_reversed(node) if backwards else node, first)] = k
        sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
        kinds: dict[tuple, int] = {}
        of = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
        sample = [of.index(k) for k in range(len(kinds))]
        start = nfa.closure([root])
        full = [nfa.closure([x]) for x in range(len(nfa.empty))]
        # where an NFA state gets by each class, closed under empty moves
        goes = [[frozenset().union(*(full[x] for s, x in moves if b in s)) for b in sample] for moves in nfa.moves]
        again = start if search else frozenset()
        known, rows, accepts = {start: 0}, [], []
        todo = [start]
        for now in todo:
            accepts.append(frozenset(ends[x] for x in now if x in ends))
            live = [goes[x] for x in now if nfa.moves[x]]
            row = []
            for c in range(len(sample)):
                to = again.union(*(g[c] for g in live if g[c]))
                if to not in known:
                    known[to] = len(known)
                    todo.append(to)
                row.append(known[to])
            rows.append(row)
        block = self._minimise(rows, accepts)
        n, width = max(block) + 1, len(kinds)
        one = [block.index(b) for b in range(n)]
        order = sorted(range(n), key=lambda b: (bool(accepts[one[b]]), one[b]))
        place = {b: i for i, b in enumerate(order)}
        self.width, self.classes, self.start = width, bytes(of), place[block[0]] * width
        self.step = [place[block[rows[one[b]][c]]] * width for b in order for c in range(width)]
        self.hits = [tuple(sorted(accepts[one[b]])) for b in order]
        self.first_hit = next((i for i, h in enumerate(self.hits) if h), n) * width
        # from a dead state nothing is accepted any more
        self.dead = {i * width for i in range(n) if not self.hits[i] and all(self.step[i * width + c] == i * width for c in range(width))}

    @staticmethod
    def _minimise(rows: list[list[int]], accepts: list[frozenset]) -> list[int]:
        """Moore's refinement: the block of each state."""
        names: dict = {}
        block = [names.setdefault(a, len(names)) for a in accepts]
        while True:
            names, fresh = {}, count()
            new = []
            for s, row in enumerate(rows):
                key = (block[s], *[block[x] for x in row])
                if key not in names:
                    names[key] = next(fresh)
                new.append(names[key])
            if len(names) == len(set(block)):
                return new
            block = new

    def longest(self, data: bytes, start: int, step: int = 1, stop: int | None = None) -> int | None:
        """Where the longest match that begins at ``start`` ends (for step -1: the one that ends there begins)."""
        s, found = self.start, None
        at = start if step > 0 else start - 1
        stop = (len(data) if step > 0 else 0) if stop is None else stop
        if s >= self.first_hit:
            found = start
        while at < stop if step > 0 else at >= stop:
            s = self.step[s + self.classes[data[at]]]
            if s >= self.first_hit:
                found = at + 1 if step > 0 else at
            elif s in self.dead:
                break
            at += step
        return found
