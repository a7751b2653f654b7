"""Generalised LL recognition with a graph-structured stack, for several dialects of a grammar at once.

A grammar is given in a small EBNF. Each alternative may be limited to some dialects; a descriptor carries the set of
dialects (bits) for which it still holds, so one run over an input answers for all of them. Stack nodes are shared per
(nonterminal, position), and a one-symbol lookahead drops alternatives that can't start there.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

_EBNF = re.compile(r"'([^']+)'|([A-Za-z_]\w*)|([\[\]()*+|])|@(\d+)")


class Grammar:
    """rules: {nonterminal: EBNF}. 'x' is a terminal, [x] optional, (x)* and (x)+ repeat, | separates, and @n before an
    alternative limits it to the dialects whose bits are in n. terminals: {name in the EBNF: symbol in the input}."""

    def __init__(self, rules: dict[str, str], terminals: dict[str, str], dialects: int):
        self.all = dialects
        self.names: list[str] = []
        self._ids: dict[str, int] = {}
        self._terminals = terminals
        #: by nonterminal: (dialects, first slot) of each alternative
        self.alts: list[list[tuple[int, int]]] = []
        #: by slot: a nonterminal's number, a terminal's symbol, or None at the end of an alternative
        self.at: list[int | str | None] = []
        for name in rules:
            self._nonterminal(name)
        for name, ebnf in rules.items():
            self._define(self._ids[name], ebnf)
        self._find_firsts()

    def number(self, name: str) -> int:
        return self._ids[name]

    def _nonterminal(self, name: str) -> int:
        if name not in self._ids:
            self._ids[name] = len(self.names)
            self.names.append(name)
            self.alts.append([])
        return self._ids[name]

    def _add(self, head: int, dialects: int, symbols: list[int | str]) -> None:
        self.alts[head].append((dialects, len(self.at)))
        self.at += [*symbols, None]

    def _define(self, head: int, ebnf: str) -> None:
        tokens = [m.groups() for m in _EBNF.finditer(ebnf)]
        end = self._alternatives(head, tokens, 0)
        if end != len(tokens):
            raise ValueError(f"unbalanced: {ebnf}")

    def _alternatives(self, head: int, tokens: list[tuple], i: int) -> int:
        dialects, symbols = self.all, []
        while i < len(tokens):
            terminal, name, mark, only = tokens[i]
            i += 1
            if terminal:
                symbols.append(self._terminals[terminal])
            elif name:
                symbols.append(self._nonterminal(name))
            elif only:
                dialects = int(only)
            elif mark == "|":
                self._add(head, dialects, symbols)
                dialects, symbols = self.all, []
            elif mark in "[(":
                inner = self._nonterminal(f"{self.names[head]}.{len(self.names)}")
                i = self._alternatives(inner, tokens, i) + 1
                after = tokens[i][2] if mark == "(" and i < len(tokens) else None
                if mark == "[":
                    self._add(inner, self.all, [])
                elif after in ("*", "+"):
                    i += 1
                    again = self._nonterminal(f"{self.names[head]}.{len(self.names)}")
                    self._add(again, self.all, [inner, again])
                    self._add(again, self.all, [])
                    if after == "+":
                        symbols.append(inner)
                    inner = again
                symbols.append(inner)
            elif mark in "])":
                self._add(head, dialects, symbols)
                return i - 1
        self._add(head, dialects, symbols)
        return i

    def _find_firsts(self) -> None:
        n = len(self.names)
        nullable, firsts, changed = [False] * n, [set() for _ in range(n)], True

        def of(slot: int) -> tuple[set, bool]:
            found: set = set()
            while (x := self.at[slot]) is not None:
                if isinstance(x, str):
                    return found | {x}, False
                found |= firsts[x]
                if not nullable[x]:
                    return found, False
                slot += 1
            return found, True

        while changed:
            changed = False
            for head, alts in enumerate(self.alts):
                for _, slot in alts:
                    found, empty = of(slot)
                    if not found <= firsts[head] or empty and not nullable[head]:
                        firsts[head] |= found
                        nullable[head] |= empty
                        changed = True
        #: by slot: the symbols that can come next there, or None if the rest may be empty
        self.ahead = [None if (x := of(s))[1] else frozenset(x[0]) for s in range(len(self.at))]

    def recognise(
        self, starts: Sequence[int], text: Sequence[str], dialects: Sequence[dict[str, int]] | None = None
    ) -> tuple[dict[int, int], int]:
        """({start: dialects in which the whole text derives from it}, the furthest position reached).

        text: one string per position, each of its characters being a symbol that may stand there. dialects: by
        position, the dialects in which each of those holds; all if not given.
        """
        at, ahead, alts, n = self.at, self.ahead, self.alts, len(text)
        #: stack nodes: (nonterminal, position) -> [dialects entered, {(return slot, parent): dialects}, {end: dialects}]
        stack: dict[tuple[int, int], list] = {}
        seen: dict[tuple, int] = {}
        todo: list[tuple[int, tuple[int, int], int, int]] = []
        furthest = 0

        def enter(node: tuple[int, int], mask: int) -> None:
            entry = stack[node]
            new = mask & ~entry[0]
            if not new:
                return
            entry[0] |= new
            i = node[1]
            here = text[i] if i < n else ""
            for only, slot in alts[node[0]]:
                may = ahead[slot]
                if new & only and (may is None or not may.isdisjoint(here)):
                    todo.append((slot, node, i, new & only))

        for start in starts:
            stack[start, 0] = [0, {}, {}]
            enter((start, 0), self.all)
        while todo:
            slot, node, i, mask = todo.pop()
            key = (slot, node, i)
            had = seen.get(key, 0)
            mask &= ~had
            if not mask:
                continue
            seen[key] = had | mask
            symbol = at[slot]
            while symbol.__class__ is str:
                if i >= n or symbol not in text[i]:
                    break
                if dialects is not None:
                    mask &= dialects[i].get(symbol, self.all)
                    if not mask:
                        break
                slot += 1
                i += 1
                symbol = at[slot]
            else:
                if i > furthest:
                    furthest = i
                if symbol is None:
                    _, edges, ends = stack[node]
                    new = mask & ~ends.get(i, 0)
                    if new:
                        ends[i] = ends.get(i, 0) | new
                        for (back, parent), holds in edges.items():
                            if new & holds and ((may := ahead[back]) is None or not may.isdisjoint(text[i] if i < n else "")):
                                todo.append((back, parent, i, new & holds))
                    continue
                child = (symbol, i)
                if child not in stack:
                    stack[child] = [0, {}, {}]
                entry = stack[child]
                edge = (slot + 1, node)
                old = entry[1].get(edge, 0)
                if mask & ~old:
                    entry[1][edge] = old | mask
                    may = ahead[slot + 1]
                    for end, holds in list(entry[2].items()):
                        if mask & holds and (may is None or not may.isdisjoint(text[end] if end < n else "")):
                            todo.append((slot + 1, node, end, mask & holds))
                enter(child, mask)
                continue
            if i > furthest:
                furthest = i
        return {s: m for s in starts if (m := stack[s, 0][2].get(n, 0))}, furthest
