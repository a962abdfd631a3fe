"""Packrat parsing-expression grammars over token kinds, and what can be derived from them.

A grammar is text, one rule a line: ``name = expression``. Terminals are quoted or bare kinds,
rules start with a capital letter. ``a b`` is a sequence, ``a | b`` an ordered choice, ``a* a+ a?`` repetition,
``&a`` and ``!a`` look ahead, ``%a`` looks ahead and emits what it meets, ``^'('`` is a bracket with all that stands
up to its partner, ``.`` is any token, ``(`` and ``)`` group. ``\\`` at a line's end continues it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

#: Calls that one token can add to the depth of a match, and calls below the first.
CALLS_A_TOKEN, CALLS_BELOW = 200, 6000

_PART = re.compile(r"\s*(?:'([^']+)'|([A-Za-z_]\w*)|([|()*+?&!.^%]))")

#: Partners of brackets, and groups that are skipped by them, under this key of a memo.
PARTNER = "partner"


@contextmanager
def _room(tokens: int) -> Iterator[None]:
    """Lets a match go as deep as its tokens can take it. Calls from Python to Python use no machine stack."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, CALLS_BELOW + CALLS_A_TOKEN * tokens))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def partners(kinds: Sequence[str], close: dict[str, str]) -> dict[int, int]:
    """Place of each opening bracket -> place of its closing one; brackets without partner are left out."""
    out: dict[int, int] = {}
    opened = {v: k for k, v in close.items()}
    stack: list[tuple[str, int]] = []
    for i, k in enumerate(kinds):
        if k in close:
            stack.append((k, i))
        elif k in opened and stack:
            if stack[-1][0] == opened[k]:
                out[stack.pop()[1]] = i
            elif any(x[0] == opened[k] for x in stack):
                while stack[-1][0] != opened[k]:
                    stack.pop()
                out[stack.pop()[1]] = i
    return out


def _parse(text: str, terminals: set[str]):
    """Expression text to nested tuples."""
    parts = []
    at = 0
    text = text.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"bad grammar near {text[at:at + 30]!r}")
        at = m.end()
        parts.append(("t", m[1]) if m[1] else ("n", m[2]) if m[2] and m[2][0].isupper() else ("t", m[2]) if m[2] else ("o", m[3]))
    pos = 0

    def choice():
        nonlocal pos
        options = [sequence()]
        while pos < len(parts) and parts[pos] == ("o", "|"):
            pos += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("alt", *options)

    def sequence():
        items = []
        while pos < len(parts) and parts[pos] not in (("o", "|"), ("o", ")")):
            items.append(prefixed())
        return items[0] if len(items) == 1 else ("seq", *items)

    def prefixed():
        nonlocal pos
        if parts[pos][0] == "o" and parts[pos][1] in "&!%^":
            kind = {"&": "and", "!": "not", "%": "ahead", "^": "jump"}[parts[pos][1]]
            pos += 1
            return (kind, prefixed())
        return suffixed()

    def suffixed():
        nonlocal pos
        kind, value = parts[pos]
        pos += 1
        if (kind, value) == ("o", "("):
            e = choice()
            pos += 1
        elif (kind, value) == ("o", "."):
            e = ("any",)
        elif kind == "n":
            e = ("rule", value)
        else:
            terminals.add(value)
            e = ("term", value)
        while pos < len(parts) and parts[pos][0] == "o" and parts[pos][1] in "*+?":
            e = ({"*": "star", "+": "plus", "?": "opt"}[parts[pos][1]], e)
            pos += 1
        return e

    return choice()


class Grammar:
    """A compiled grammar. ``match(rule, kinds, at)`` gives the end of the match or -1."""

    def __init__(self, text: str) -> None:
        self.terminals: set[str] = set()
        lines = re.sub(r"\\\n", " ", text).splitlines()
        self.rules = {}
        for line in lines:
            line = line.strip()
            if line and not line.startswith("--"):
                name, _, body = line.partition(" = ")
                self.rules[name.strip()] = _parse(body, self.terminals)
        self._held: dict[frozenset[str], frozenset[str]] = {}
        self._parts: dict[int, Callable] = {}  # expressions live as long as the grammar, so their ids stand for them
        self._quiet: dict[tuple[int, int], bool] = {}
        self._made: dict[str, Callable] = {}
        self._null = self._nullable()
        self._firsts = self._edges(True)
        for name in self.rules:
            self._made[name] = self._compile_rule(name)

    def __reduce__(self):
        raise TypeError("grammars are made where they are used")

    # What a rule can match.

    def _nullable(self) -> set[str]:
        null: set[str] = set()
        while True:
            more = {n for n, e in self.rules.items() if n not in null and self._empty(e, null)}
            if not more:
                return null
            null |= more

    def _empty(self, e, null) -> bool:
        kind = e[0]
        if kind in ("star", "opt", "and", "not", "ahead"):
            return True
        if kind == "rule":
            return e[1] in null
        if kind == "plus":
            return self._empty(e[1], null)
        if kind == "alt":
            return any(self._empty(x, null) for x in e[1:])
        if kind == "seq":
            return all(self._empty(x, null) for x in e[1:])
        return False

    def _edges(self, first: bool) -> dict[str, set[str]]:
        """Kinds that a rule's matches can begin (or end) with."""
        sets: dict[str, set[str]] = {n: set() for n in self.rules}
        changed = True
        while changed:
            changed = False
            for n, e in self.rules.items():
                new = self._edge(e, sets, first)
                if not new <= sets[n]:
                    sets[n] |= new
                    changed = True
        return sets

    def _edge(self, e, sets, first: bool) -> set[str]:
        kind = e[0]
        if kind == "term":
            return {e[1]}
        if kind == "any":
            return {"*"}
        if kind == "rule":
            return sets[e[1]]
        if kind in ("and", "not", "ahead"):
            return set()
        if kind in ("star", "plus", "opt", "jump"):
            return self._edge(e[1], sets, first)
        if kind == "alt":
            return set().union(*(self._edge(x, sets, first) for x in e[1:]))
        out: set[str] = set()
        for x in e[1:] if first else reversed(e[1:]):
            out |= self._edge(x, sets, first)
            if not self._empty(x, self._null):
                break
        return out

    def pairs(self) -> set[tuple[str, str]]:
        """All pairs of kinds that can stand next to each other inside a match of any rule."""
        firsts, lasts = self._firsts, self._edges(False)
        out: set[tuple[str, str]] = set()

        def walk(e) -> None:
            if e[0] in ("star", "plus"):
                out.update((a, b) for a in self._edge(e[1], lasts, False) for b in self._edge(e[1], firsts, True))
            if e[0] == "seq":
                for i in range(1, len(e)):
                    for j in range(i + 1, len(e)):
                        if e[j][0] not in ("and", "not", "ahead"):
                            out.update((a, b) for a in self._edge(e[i], lasts, False) for b in self._edge(e[j], firsts, True))
                        if not self._empty(e[j], self._null):
                            break
            for x in e[1:]:
                if isinstance(x, tuple):
                    walk(x)

        for e in self.rules.values():
            walk(e)
        return out

    # Matching.

    def _compile_rule(self, name: str) -> Callable:
        body = self._compile(self.rules[name])
        first = None if name in self._null or "*" in self._firsts[name] else frozenset(self._firsts[name])

        def run(k: Sequence[str], i: int, memo: dict) -> int:
            if first is not None and k[i] not in first:
                return -1
            key = (name, i)
            got = memo.get(key)
            if got is None:
                memo[key] = -1
                got = memo[key] = body(k, i, memo)
            return got

        return run

    def _compile(self, e) -> Callable:
        kind = e[0]
        if kind == "term":
            t = e[1]
            return lambda k, i, m: i + 1 if k[i] == t else -1
        if kind == "any":
            return lambda k, i, m: i + 1 if k[i] != "$end" else -1
        if kind == "rule":
            made, name = self._made, e[1]
            if name not in self.rules:
                raise ValueError(f"no rule {name}")
            return lambda k, i, m: made[name](k, i, m)
        if kind == "jump":
            t = e[1][1]

            def jump(k, i, m):
                return m[PARTNER].get(i, -2) + 1 if k[i] == t else -1

            return jump
        if kind in ("and", "ahead"):
            f = self._compile(e[1])
            return lambda k, i, m: i if f(k, i, m) >= 0 else -1
        if kind == "not":
            f = self._compile(e[1])
            return lambda k, i, m: -1 if f(k, i, m) >= 0 else i
        if kind == "opt":
            f = self._compile(e[1])

            def opt(k, i, m):
                j = f(k, i, m)
                return j if j >= 0 else i

            return opt
        if kind in ("star", "plus"):
            f = self._compile(e[1])
            least = kind == "plus"

            def many(k, i, m):
                j = f(k, i, m)
                if j < 0:
                    return -1 if least else i
                while j >= 0 and j > i:
                    i = j
                    j = f(k, i, m)
                return max(i, j)

            return many
        if kind == "alt":
            options = [(self._compile(x), None if self._empty(x, self._null) or "*" in (s := self._edge(x, self._firsts, True)) else frozenset(s)) for x in e[1:]]
            plain = [x[1] for x in e[1:]] if all(x[0] == "term" for x in e[1:]) else None
            if plain:
                own = frozenset(plain)
                return lambda k, i, m: i + 1 if k[i] in own else -1

            def alt(k, i, m):
                t = k[i]
                for f, first in options:
                    if first is None or t in first:
                        j = f(k, i, m)
                        if j >= 0:
                            return j
                return -1

            return alt
        parts = [self._compile(x) for x in e[1:]]

        def seq(k, i, m):
            for f in parts:
                i = f(k, i, m)
                if i < 0:
                    return -1
            return i

        return seq

    def match(self, rule: str, kinds: Sequence[str], at: int = 0, memo: dict | None = None) -> int:
        """``kinds`` must end with ``$end``. However deep brackets and statements nest, the match is followed to its end."""
        with _room(len(kinds)):
            return self._made[rule](kinds, at, {} if memo is None else memo)

    def accepts(self, rule: str, kinds: Sequence[str]) -> bool:
        k = [*kinds, "$end"]
        return self.match(rule, k) == len(k) - 1

    def tree(self, rule: str, kinds: Sequence[str], keep: frozenset[str], pairs: dict[int, int] | None = None) -> list[tuple] | None:
        """Nodes ``(name, start, end, children)`` of the kept rules in the parse of ``kinds``, or None.

        The parse is followed once more along the memo, so only what was accepted is emitted.
        ``pairs`` are the partners of the brackets, where the grammar jumps to them.
        """
        k = [*kinds, "$end"]
        memo: dict = {PARTNER: pairs or {}}
        if self.match(rule, k, 0, memo) < 0:
            return None
        if keep not in self._held:
            self._held[keep] = self._holders(keep)
        out: list[tuple] = []
        with _room(len(k)):
            self._follow(("rule", rule), k, 0, memo, keep, self._held[keep], out)
        return out

    def _holders(self, keep: frozenset[str]) -> frozenset[str]:
        """Rules in whose matches a kept rule can occur."""
        got = set(keep)
        while True:
            more = {n for n, e in self.rules.items() if n not in got and any(r in got for r in self._names(e))}
            if not more:
                return frozenset(got)
            got |= more

    def _names(self, e) -> set[str]:
        return {e[1]} if e[0] == "rule" else set().union(*(self._names(x) for x in e[1:] if isinstance(x, tuple)), set())

    def _follow(self, e, k, i, memo, keep, holds, out) -> int:
        kind = e[0]
        if kind != "rule" and self._silent(e, holds):
            return self._part(e)(k, i, memo)
        if kind == "rule":
            end = self._made[e[1]](k, i, memo)
            if end < 0 or e[1] not in holds:
                return end
            if e[1] in keep:
                inner: list[tuple] = []
                self._follow(self.rules[e[1]], k, i, memo, keep, holds, inner)
                out.append((e[1], i, end, inner))
            else:
                self._follow(self.rules[e[1]], k, i, memo, keep, holds, out)
            return end
        if kind == "seq":
            mark = len(out)
            for x in e[1:]:
                i = self._follow(x, k, i, memo, keep, holds, out)
                if i < 0:
                    del out[mark:]
                    return -1
            return i
        if kind == "alt":
            for x in e[1:]:
                mark = len(out)
                j = self._follow(x, k, i, memo, keep, holds, out)
                if j >= 0:
                    return j
                del out[mark:]
            return -1
        if kind == "ahead":
            return i if self._follow(e[1], k, i, memo, keep, holds, out) >= 0 else -1
        if kind in ("star", "plus", "opt"):
            n = 0
            while True:
                mark = len(out)
                j = self._follow(e[1], k, i, memo, keep, holds, out)
                if j < 0:
                    del out[mark:]
                    break
                n += 1
                if j == i or kind == "opt":
                    i = j
                    break
                i = j
            return -1 if kind == "plus" and not n else i
        return self._part(e)(k, i, memo)

    def _part(self, e) -> Callable:
        part = self._parts.get(id(e))
        if part is None:
            part = self._parts[id(e)] = self._compile(e)
        return part

    def _silent(self, e, holds: frozenset[str]) -> bool:
        """Whether no kept rule can occur in the matches of an expression."""
        got = self._quiet.get((id(e), id(holds)))
        if got is None:
            got = self._quiet[id(e), id(holds)] = not self._names(e) & holds
        return got
