"""An error-correcting chart parser for extended context-free grammars.

A grammar's right-hand sides are regular expressions over tokens and bracketed groups, and a group's content is
again a nonterminal, so nesting is context-free while each level is regular. The chart is filled bottom-up: a
cell is the span of a bracket pair (or of an indented block) and holds the set of nonterminals that derive its
content at cost 0, computed by lazily built automata; cells with equal content share one entry. A cell that no
nonterminal derives is repaired by insertions, deletions and replacements of tokens, searched by rising cost
around each point where its derivation stops.
Brackets themselves are repaired by closing or dropping the fewest. The cost of a text is the sum; a text is
valid if and only if its cost is 0. The search is bounded by the values below; :mod:`cairn.llm.least` finds the
least costs of invalid texts without bounds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: A repair dearer than this is reported as this much; the text is flagged either way.
MAX_COST = 8
#: From this total on, further cells count 1 each without a search for their cheapest repair.
ENOUGH = 24
#: Tokens that may be edited before an error, tokens that must be derived behind a repair, and first edits
#: that a second one is tried on.
BACK, CLEAR, TRIED = 4, 6, 24
_PIECE = re.compile(r"'[^']+'|[({\[<]\w+[)}\]>]|[A-Za-z_]\w*|[()|*+?~]")


class Automaton:
    """The automaton of one nonterminal, determinised as far as inputs reach."""

    def __init__(self, grammar: Grammar, name: str):
        self.grammar, self.eps, self.arcs = grammar, [], []
        self.start, self.final = self._rule(name, ())
        self._follow: dict[int, list[str]] = {}
        first = self._closure((self.start,))
        self.sets, self.index, self.table, self.accepts = [first], {first: 0}, [{}], [self.final in first]

    def _state(self) -> int:
        self.eps.append([])
        self.arcs.append([])
        return len(self.eps) - 1

    def _rule(self, name: str, within: tuple[str, ...]) -> tuple[int, int]:
        if name in within:
            raise ValueError(f"rule {name} calls itself outside a group")
        pieces, at = self.grammar.pieces[name], 0

        def alternatives():
            nonlocal at
            options = [sequence()]
            while at < len(pieces) and pieces[at] == "|":
                at += 1
                options.append(sequence())
            if len(options) == 1:
                return options[0]
            a, b = self._state(), self._state()
            for x, y in options:
                self.eps[a].append(x)
                self.eps[y].append(b)
            return a, b

        def sequence():
            nonlocal at
            a = b = self._state()
            while at < len(pieces) and pieces[at] not in ("|", ")"):
                x, y = item()
                self.eps[b].append(x)
                b = y
            return a, b

        def item():
            nonlocal at
            p = pieces[at]
            at += 1
            if p == "(":
                x, y = alternatives()
                if at >= len(pieces) or pieces[at] != ")":
                    raise ValueError(f"unbalanced rule {name}")
                at += 1
            elif p in self.grammar.pieces and p not in self.grammar.tokens:
                x, y = self._rule(p, (*within, name))
            else:
                x, y = self._state(), self._state()
                self.arcs[x].append((self.grammar.label(p), y))
            while at < len(pieces) and pieces[at] in ("*", "+", "?", "~"):
                if pieces[at] == "~":  # one or more x, separated by what follows
                    at += 1
                    u, v = item()
                    self.eps[y].append(u)
                    self.eps[v].append(x)
                    continue
                a, b = self._state(), self._state()
                self.eps[a].append(x)
                self.eps[y].append(b)
                if pieces[at] in "*+":
                    self.eps[y].append(x)
                if pieces[at] in "*?":
                    self.eps[a].append(b)
                x, y = a, b
                at += 1
            return x, y

        return alternatives()

    def _closure(self, states) -> frozenset[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo += self.eps[s]
        return frozenset(s for s in out if self.arcs[s] or s == self.final)

    def _step(self, at: int, char: str) -> int:
        matches = self.grammar.matches
        to = {t for s in self.sets[at] for label, t in self.arcs[s] if matches(label, char)}
        if not to:
            self.table[at][char] = -1
            return -1
        new = self._closure(to)
        if new not in self.index:
            self.index[new] = len(self.sets)
            self.sets.append(new)
            self.table.append({})
            self.accepts.append(self.final in new)
        self.table[at][char] = self.index[new]
        return self.index[new]

    def derives(self, text: str) -> bool:
        at, table = 0, self.table
        for c in text:
            to = table[at].get(c)
            if to is None:
                to = self._step(at, c)
            if to < 0:
                return False
            at = to
        return self.accepts[at]

    def reach(self, text: str) -> int:
        """How many tokens of ``text`` begin something derivable."""
        at = 0
        for n, c in enumerate(text):
            to = self.table[at].get(c)
            if to is None:
                to = self._step(at, c)
            if to < 0:
                return n
            at = to
        return len(text)

    def _next(self, at: int, char: str) -> int:
        to = self.table[at].get(char)
        return self._step(at, char) if to is None else to

    def _expected(self, at: int) -> list[str]:
        """Tokens and groups that may follow in a state."""
        if at not in self._follow:
            labels = {label for s in self.sets[at] for label, _ in self.arcs[s]}
            self._follow[at] = sorted(x if isinstance(x, str) else self.grammar.group(x[0], x[1] or 1) for x in labels)
        return self._follow[at]

    def _advance(self, text: str, i: int, at: int) -> tuple[int, int]:
        """As far as ``text`` goes from position i in state ``at``; one past the end where it is accepted."""
        n = len(text)
        while i < n:
            to = self._next(at, text[i])
            if to < 0:
                return i, at
            i, at = i + 1, to
        return (n + 1 if self.accepts[at] else n), at

    def repair(self, text: str, most: int = MAX_COST) -> tuple[int, list[int]]:
        """Least edits that make ``text`` derivable, at most ``most``, and the token positions of the edits.

        Errors are met left to right. Around each, edit sequences are tried by rising cost, one edit and then
        two, each a deletion, insertion or replacement within a few tokens before the farthest point; the
        cheapest counts that derives CLEAR more tokens or reaches the end. Where no two edits do, the run of
        deletions that lets the derivation go on is taken.
        """
        n, i, at, cost, edits = len(text), 0, 0, 0, []
        while cost < most:
            trail = [(i, at)]
            while i < n and (to := self._next(at, text[i])) >= 0:
                i, at = i + 1, to
                trail.append((i, at))
                if len(trail) > BACK + 1:
                    trail.pop(0)
            if i == n and self.accepts[at]:
                return cost, edits
            goal = min(n + 1, i + CLEAR) if i < n else n + 1
            frontier, found = [(p, q, ()) for p, q in reversed(trail)], None
            for depth in (1, 2):
                reached = []
                for p, q, done in frontier:
                    options = [(p + 1, q)] if p < n else []
                    for c in self._expected(q):
                        to = self._next(q, c)
                        options.append((p, to))
                        if p < n:
                            options.append((p + 1, to))
                    for p2, q2 in options:
                        r, q3 = self._advance(text, p2, q2)
                        node = (r, q3, (*done, p))
                        if r >= goal:
                            found = node
                            break
                        if r > p or p >= n:
                            reached.append(node)
                    if found:
                        break
                if found or depth == 2:
                    break
                reached.sort(key=lambda x: -x[0])
                frontier = [(r, q, done) for r, q, done in reached[:TRIED] if r <= n]
            if found:
                r, at, done = found
                cost += len(done)
                edits += done
                if r > n:
                    return min(cost, most), edits
                i = r
                continue
            skip = next((k for k in range(i + 1, min(n, i + most + 1)) if any(self._advance(text, k, q)[0] >= min(n + 1, k + CLEAR) for _, q in trail[-2:])), None)
            if skip is None:
                return most, [*edits, i]
            at = max((self._advance(text, skip, q)[0], q) for _, q in trail[-2:])[1]
            cost += skip - i
            edits.append(i)
            i = skip
        return most, edits


class Grammar:
    """Rules by name; ``contents`` lists, per opening bracket, the nonterminals a group may be. ``(any)``,
    ``{any}``, ``[any]`` match every balanced group. A word that is one of ``tokens`` is that token, not the
    rule of that name, which then is only a group's content."""

    def __init__(self, rules: dict[str, str], contents: dict[str, list[str]], start: str = "file", collapse=None, tokens: frozenset[str] = frozenset()):
        self.tokens = tokens
        self.pieces = {k: self._pieces(k, v) for k, v in rules.items()}
        self.contents, self.start, self.collapse = contents, start, collapse
        self.bits = {(o, n): 1 << i for o, names in contents.items() for i, n in enumerate(names)}
        self.chars: dict[str, str] = {}
        self.groups: dict[str, tuple[str, int]] = {}
        self._group_chars: dict[tuple[str, int], str] = {}
        self.automata: dict[str, Automaton] = {}
        self.cells: dict[tuple[str, str], tuple[str, int, list[int]]] = {}

    @staticmethod
    def _pieces(name: str, text: str) -> list[str]:
        out = _PIECE.findall(text)
        if "".join(out) != re.sub(r"\s", "", text):
            raise ValueError(f"rule {name} can't be read")
        return [p[1:-1] if p[0] == "'" and len(p) > 2 and p[1:-1] not in ("(", ")", "|", "*", "+", "?", "~") else ("\0" + p[1:-1] if p[0] == "'" else p) for p in out]

    def char(self, token: str) -> str:
        if token not in self.chars:
            self.chars[token] = chr(0xE000 + len(self.chars))
        return self.chars[token]

    def label(self, piece: str):
        if len(piece) > 2 and piece[0] in "({[<" and piece[-1] in ")}]>" and piece[1].isalpha():
            name = piece[1:-1]
            bracket = piece[0] if piece[0] != "<" else "<|" if ("<|", name) in self.bits else "<l|"
            return (bracket, 0 if name == "any" else self.bits[bracket, name])
        return self.char(piece.lstrip("\0"))

    def matches(self, label, char: str) -> bool:
        if isinstance(label, str):
            return label == char
        group = self.groups.get(char)
        return group is not None and group[0] == label[0] and (not label[1] or bool(group[1] & label[1]))

    def group(self, bracket: str, mask: int) -> str:
        if (bracket, mask) not in self._group_chars:
            c = chr(0xF0000 + len(self._group_chars))
            self._group_chars[bracket, mask] = c
            self.groups[c] = (bracket, mask)
        return self._group_chars[bracket, mask]

    def automaton(self, name: str) -> Automaton:
        if name not in self.automata:
            self.automata[name] = Automaton(self, name)
        return self.automata[name]

    def cell(self, bracket: str, text: str, search: bool = True) -> tuple[str, int, list[int]]:
        """The group's character, cost and edit positions; equal contents are parsed once."""
        got = self.cells.get((bracket, text))
        if got is None:
            flat = self.collapse(self, text) if self.collapse else text
            mask = 0
            for name in self.contents[bracket]:
                if self.automaton(name).derives(flat):
                    mask |= self.bits[bracket, name]
            if mask or not self.contents[bracket]:
                got = (self.group(bracket, mask), 0, [])
            elif not search:
                return self.group(bracket, (1 << len(self.contents[bracket])) - 1), 1, [0]
            else:
                got = (self.group(bracket, (1 << len(self.contents[bracket])) - 1), *self._best(self.contents[bracket], flat))
            if len(self.cells) > 200_000:
                self.cells.clear()
            self.cells[bracket, text] = got
        return got

    def _best(self, names: list[str], flat: str) -> tuple[int, list[int]]:
        ranked = sorted(names, key=lambda n: -self.automaton(n).reach(flat))
        best = (MAX_COST, [self.automaton(ranked[0]).reach(flat)])
        for n in ranked[:2]:
            cost, at = self.automaton(n).repair(flat, best[0])
            if cost < best[0]:
                best = (cost, at)
        return max(1, best[0]), best[1]


@dataclass
class Parse:
    """``capped``: the cost is a least one, because the search for a repair stopped at a bound, or groups are open at
    the end, whose content is not examined."""

    cost: int = 0
    capped: bool = False
    lines: list[int] = field(default_factory=list)
    open_at_end: int = 0
    last_line: int = 1


_CLOSE = {")": "(", "]": "[", "}": "{", ">|": "<|", "l|>": "<l|"}
_OPEN = frozenset(_CLOSE.values())


def parse(grammar: Grammar, tokens) -> Parse:
    """``tokens``: (name, line), with brackets under their own names and ``error`` for what is no token."""
    out = Parse()
    stack: list[tuple[str, int, list[str], list[int]]] = []
    seg: list[str] = []
    at: list[int] = []
    bracket, opened, line = "", 1, 1
    char = grammar.char

    def close() -> None:
        nonlocal seg, at, bracket, opened
        search = out.cost < ENOUGH
        c, cost, edits = grammar.cell(bracket, "".join(seg), search)
        if cost:
            out.capped |= not search or cost >= MAX_COST
            out.cost += cost
            out.lines += [at[min(e, len(at) - 1)] if at else line for e in edits]
        begun = opened
        bracket, opened, seg, at = stack.pop()
        seg.append(c)
        at.append(begun)

    known, brackets = grammar.chars, _OPEN | _CLOSE.keys()
    for name, line in tokens:
        if name not in brackets:
            seg.append(known.get(name) or char(name))
            at.append(line)
        elif name in _OPEN:
            stack.append((bracket, opened, seg, at))
            bracket, opened, seg, at = name, line, [], []
        else:
            o = _CLOSE[name]
            if bracket == o:
                close()
            else:
                deep = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == o), 0)
                out.cost += 1
                out.lines.append(line)
                if deep and len(stack) - deep <= 2:  # cheaper to close what is open in between
                    out.cost += len(stack) - deep - 1
                    while bracket != o:
                        close()
                    close()
    out.last_line, out.open_at_end = line, len(stack)
    if stack:
        out.capped = True
        out.cost += len(stack)
        out.lines += [line] * len(stack)
        return out  # what is open has no end: its cells can't be filled
    text = "".join(seg)
    flat = grammar.collapse(grammar, text) if grammar.collapse else text
    if not grammar.automaton(grammar.start).derives(flat):
        cost, edits = grammar._best([grammar.start], flat) if out.cost < ENOUGH else (1, [0])
        out.capped |= out.cost >= ENOUGH or cost >= MAX_COST
        out.cost += cost
        out.lines += [at[min(e, len(at) - 1)] if at else line for e in edits]
    return out
