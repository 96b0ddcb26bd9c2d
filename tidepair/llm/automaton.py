"""Byte rules to one minimal deterministic automaton: parse, subset construction, minimisation.

A rule is a regular expression over bytes: literals, classes, groups, ``|``, ``? * + {m} {m,}
{m,n}`` and ``(?i)`` in front. The result is a flat transition array over byte classes.
"""

from __future__ import annotations

from collections import deque

_META = frozenset("|()[]{}?*+\\.")
_NAMED = {"d": "0-9", "w": "0-9A-Za-z_", "s": " \t\n\x0b\f\r"}


class _Parser:
    """Recursive descent over one rule; builds nodes ("set", bytes), ("cat", ..), ("alt", ..), ("rep", ..)."""

    def __init__(self, rule: str):
        self.fold = rule.startswith("(?i)")
        self.rule, self.at = rule.removeprefix("(?i)"), 0

    def peek(self) -> str:
        return self.rule[self.at] if self.at < len(self.rule) else ""

    def take(self) -> str:
        self.at += 1
        return self.rule[self.at - 1]

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return ("alt", options) if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        node = self.atom()
        while self.peek() and self.peek() in "?*+{":
            mark = self.take()
            if mark == "{":
                body = ""
                while self.peek() != "}":
                    body += self.take()
                self.take()
                low, comma, high = body.partition(",")
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[mark])
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            node = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.rule!r}")
            return node
        if c == "[":
            return ("set", self.members())
        if c == "\\":
            return ("set", self.escaped(self.take()))
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        if c in _META:
            raise ValueError(f"unexpected {c!r} in {self.rule!r}")
        return ("set", self.folded({ord(c)}))

    def escaped(self, c: str) -> frozenset:
        if c == "x":
            return frozenset({int(self.take() + self.take(), 16)})
        if c in _NAMED:
            return self.ranges(_NAMED[c])
        return self.folded({ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))})

    def ranges(self, text: str) -> frozenset:
        inner = _Parser(text + "]")
        return inner.members()

    def folded(self, codes: set) -> frozenset:
        if self.fold:
            codes = {x for c in codes for x in (ord(chr(c).lower()), ord(chr(c).upper())) if c < 128}
        return frozenset(codes)

    def members(self) -> frozenset:
        inverted = self.peek() == "^"
        if inverted:
            self.take()
        codes: set = set()
        while self.peek() != "]":
            low = self.take()
            if low == "\\":
                got = self.escaped(self.take())
                if len(got) > 1 or self.peek() != "-":
                    codes |= got
                    continue
                low = chr(min(got))
            if self.peek() == "-" and self.rule[self.at + 1] != "]":
                self.take()
                high = self.take()
                high = chr(min(self.escaped(self.take()))) if high == "\\" else high
                codes |= set(range(ord(low), ord(high) + 1))
            else:
                codes.add(ord(low))
        self.take()
        codes = set(self.folded(codes))
        return frozenset(range(256)) - codes if inverted else frozenset(codes)


class _Graph:
    """Thompson construction: empty moves and moves on byte sets."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """Wires ``node`` after ``start``; returns its end."""
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
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop, end = self.state(), self.state()
            self.empty[start] += [loop, end]
            self.empty[self.add(inner, loop)] += [loop, end]
            return end
        ends = [start]
        for _ in range(high - low):
            start = self.add(inner, start)
            ends.append(start)
        end = self.state()
        for e in ends:
            self.empty[e].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton:
    """Minimal automaton of several rules.

    ``classes`` maps each byte to a class (a 256-byte translation table), ``table`` holds the
    next state times ``width`` at state * width + class, ``accepts[state]`` is the set of
    rules matched on arrival. State 0 is the start; accepting states come last, from
    ``first_accept`` (times ``width``) on. With ``search`` the rules may begin
    anywhere; without, a state from which no match can come is ``dead``.
    """

    def __init__(self, rules: list[str], search: bool):
        graph = _Graph()
        start = graph.state()
        final = {}
        for i, rule in enumerate(rules):
            parser = _Parser(rule)
            first = graph.state()
            graph.empty[start].append(first)
            end = graph.add(parser.alternatives(), first)
            if parser.at != len(parser.rule):
                raise ValueError(f"unread rest of {rule!r}")
            final[end] = i
        sets = {s for moves in graph.moves for s, _ in moves}
        member = {b: tuple(b in s for s in sorted(sets, key=sorted)) for b in range(256)}
        names = {m: k for k, m in enumerate(dict.fromkeys(member.values()))}
        self.classes = bytes(names[member[b]] for b in range(256))
        self.width = len(names)
        sample = {k: self.classes.index(k) for k in range(self.width)}
        states = {graph.closure([start]): 0}
        todo, rows = deque(states), []
        while todo:
            held = todo.popleft()
            row = []
            for k in range(self.width):
                to = {t for s in held for chars, t in graph.moves[s] if sample[k] in chars}
                nxt = graph.closure(to | ({start} if search else set()))
                if nxt not in states:
                    states[nxt] = len(states)
                    todo.append(nxt)
                row.append(states[nxt])
            rows.append(row)
        marks = [frozenset(final[s] for s in held if s in final) for held in states]
        block = self._minimal(rows, marks)
        first_of = {}
        for s, b in enumerate(block):
            first_of.setdefault(b, s)
        kept = sorted(first_of.values(), key=lambda s: bool(marks[s]))
        order = {block[s]: k for k, s in enumerate(kept)}
        self.accepts = [marks[s] for s in kept]
        self.first_accept = next((k for k, a in enumerate(self.accepts) if a), len(kept)) * self.width
        self.table = [order[block[t]] * self.width for s in kept for t in rows[s]]
        self.dead = next((k for k, s in enumerate(kept) if not marks[s] and all(block[t] == block[s] for t in rows[s])), -1)

    @staticmethod
    def _minimal(rows: list[list[int]], marks: list[frozenset]) -> list[int]:
        """Coarsest partition in which states of a block accept alike and move alike."""
        names = {m: i for i, m in enumerate(dict.fromkeys(marks))}
        block, count = [names[m] for m in marks], len(names)
        while True:
            keys = [(block[s], *(block[t] for t in row)) for s, row in enumerate(rows)]
            names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            block = [names[k] for k in keys]
            if len(names) == count:
                return block
            count = len(names)

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that starts at ``at`` (``data`` in byte classes); -1 if none."""
        table, dead, good = self.table, self.dead * self.width, self.first_accept
        state, end = 0, -1
        for i in range(at, len(data)):
            state = table[state + data[i]]
            if state == dead:
                break
            if state >= good:
                end = i + 1
        return end
