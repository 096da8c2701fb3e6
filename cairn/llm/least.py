"""Least repairs of texts that do not parse, without bounds on their cost, their number or their distance.

The bounded search of :mod:`cairn.llm.chart` tells whether a text is valid. Here the content of every group of an
invalid text is put against all nonterminals that its bracket may hold at once: their automata, determinised and
minimised together, are run over the tokens with the least cost of each state beside it. These costs, taken
relative to the smallest one, are again states of an automaton that is built as far as inputs reach, so a token
costs one look-up where the text goes on as known.
"""

from __future__ import annotations

import numpy as np

from cairn.llm.chart import _CLOSE, _OPEN, MAX_COST, Automaton, Grammar, Parse

#: Kept states, beyond which they are built anew, and tokens between places that are kept to find the edits.
KEPT, STRIDE = 20_000, 512
_INVERSE = {o: c for c, o in _CLOSE.items()}


def _bits(mask: int):
    digits = bin(mask)[:1:-1]
    at = digits.find("1")
    while at >= 0:
        yield at
        at = digits.find("1", at + 1)


class Union:
    """The minimal automaton of several nonterminals, whose labels are its letters."""

    def __init__(self, grammar: Grammar, names: list[str]):
        self.grammar = grammar
        rows: list[dict] = []
        finals: list[bool] = []
        starts: list[int] = []
        made: dict = grammar.__dict__.setdefault("_determined", {})
        for pieces in dict.fromkeys(tuple(self._pieces(grammar, n)) for n in names):
            if pieces not in made:
                made[pieces] = self._determine(grammar.automaton(next(n for n in names if tuple(self._pieces(grammar, n)) == pieces)))
            base = len(rows)
            starts.append(base)
            rows += [{label: base + t for label, t in row.items()} for row in made[pieces][0]]
            finals += made[pieces][1]
        kind = self._minimise(rows, finals)
        n = max(kind) + 1
        self.start = self.final = 0
        self.out, self.into = [0] * n, [0] * n  # per state: the states behind any label, and before any
        self.on: dict[object, dict[int, int]] = {}  # label -> state -> state behind
        self.off: dict[object, dict[int, int]] = {}  # label -> state -> states before
        for s in starts:
            self.start |= 1 << kind[s]
        seen = [False] * n
        for s, row in enumerate(rows):
            k = kind[s]
            if seen[k]:
                continue
            seen[k] = True
            self.final |= finals[s] << k
            for label, t in row.items():
                t = kind[t]
                self.out[k] |= 1 << t
                self.into[t] |= 1 << k
                self.on.setdefault(label, {})[k] = t
                before = self.off.setdefault(label, {})
                before[t] = before.get(t, 0) | 1 << k
        self.sources = {label: self._mask(to) for label, to in self.on.items()}
        self.targets = {label: self._mask(to) for label, to in self.off.items()}
        self.all = (1 << n) - 1
        self._labels: dict[str, list] = {}
        self._nodes: dict[tuple, tuple] = {}
        self._masks: dict[int, int] = {}
        self._moved: dict[tuple[int, str], int] = {}
        self._edited: dict[int, int] = {}
        self._came: dict[tuple[int, str], int] = {}
        self._before: dict[int, int] = {}

    @staticmethod
    def _mask(states) -> int:
        out = 0
        for s in states:
            out |= 1 << s
        return out

    @staticmethod
    def _pieces(grammar: Grammar, name: str) -> list[str]:
        """A rule without the names that only stand for another rule."""
        pieces = grammar.pieces[name]
        while len(pieces) == 1 and pieces[0] in grammar.pieces and pieces[0] not in grammar.tokens:
            pieces = grammar.pieces[pieces[0]]
        return pieces

    @staticmethod
    def _determine(a: Automaton) -> tuple[list[dict], list[bool]]:
        rows, finals = [], []
        closures: dict[int, frozenset[int]] = {}
        known: dict[frozenset[int], int] = {}
        first = a._closure((a.start,))
        index, sets = {first: 0}, [first]
        for states in sets:  # grows meanwhile
            by: dict[object, list[int]] = {}
            for s in states:
                for label, t in a.arcs[s]:
                    by.setdefault(label, []).append(t)
            row = {}
            for label, to in by.items():
                key = frozenset(to)
                if key not in known:
                    for t in to:
                        if t not in closures:
                            closures[t] = a._closure((t,))
                    new = frozenset().union(*(closures[t] for t in to))
                    if new not in index:
                        index[new] = len(sets)
                        sets.append(new)
                    known[key] = index[new]
                row[label] = known[key]
            rows.append(row)
            finals.append(a.final in states)
        return rows, finals

    @staticmethod
    def _minimise(rows: list[dict], finals: list[bool]) -> list[int]:
        """Classes of states with equal languages, by refinement: marks of 64 bits stand for the sets of arcs."""
        labels = {label: i for i, label in enumerate(dict.fromkeys(x for row in rows for x in row))}
        source = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        target = np.array([t for r in rows for t in r.values()], np.int64)
        label = np.array([labels[x] for r in rows for x in r], np.int64)
        rng = np.random.default_rng(7)
        of_label = rng.integers(1 << 62, size=len(labels) + 1, dtype=np.uint64)
        of_kind = rng.integers(1 << 62, size=len(rows) + 2, dtype=np.uint64)
        kind, n = np.array(finals, np.int64), len(set(finals))
        while True:
            mark = (of_label[label] + of_kind[kind[target]]) * np.uint64(0x9E3779B97F4A7C15)
            mark = (mark ^ (mark >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mark ^= mark >> np.uint64(32)
            total = of_kind[kind] * np.uint64(3)
            np.add.at(total, source, mark)
            kind = np.unique(total, return_inverse=True)[1].reshape(-1)
            if kind.max(initial=-1) + 1 == n:
                return kind.tolist()
            n = int(kind.max()) + 1

    def _letters(self, char: str) -> list:
        if char not in self._labels:
            self._labels[char] = [x for x in self.on if self.grammar.matches(x, char)]
        return self._labels[char]

    def _move(self, mask: int, char: str) -> int:
        """States behind ``char``."""
        got = self._moved.get((mask, char))
        if got is None:
            got = 0
            for label in self._letters(char):
                on = self.on[label]
                for s in _bits(mask & self.sources[label]):
                    got |= 1 << on[s]
            self._moved[mask, char] = got
        return got

    def _edit(self, mask: int) -> int:
        """States behind any token or group."""
        got = self._edited.get(mask)
        if got is None:
            got = 0
            for s in _bits(mask):
                got |= self.out[s]
            self._edited[mask] = got
        return got

    def _unmove(self, mask: int, char: str) -> int:
        got = self._came.get((mask, char))
        if got is None:
            got = 0
            for label in self._letters(char):
                off = self.off[label]
                for s in _bits(mask & self.targets[label]):
                    got |= off[s]
            self._came[mask, char] = got
        return got

    def _unedit(self, mask: int) -> int:
        got = self._before.get(mask)
        if got is None:
            got = 0
            for s in _bits(mask):
                got |= self.into[s]
            self._before[mask] = got
        return got

    def _node(self, left: int, pending: dict[int, int]):
        """``(cost that is left, ((cost, states that cost at most that), ...), arcs)`` for states by cost, with what
        insertions reach from them; costs are relative to the smallest. None if nothing is within ``left``."""
        layers, all_ = [], 0
        while pending and (cost := min(pending)) <= left:
            added = pending.pop(cost) & ~all_
            if added:
                all_ |= added
                all_ = self._masks.setdefault(all_, all_)
                layers.append((cost, all_))
                if cost < left:
                    pending[cost + 1] = pending.get(cost + 1, 0) | self._edit(added)
        if not layers:
            return None
        least = layers[0][0]
        key = left - least, tuple((c - least, m) for c, m in layers)
        node = self._nodes.get(key)
        if node is None:
            node = self._nodes[key] = (*key, {})
        return node

    def _follow(self, node, char: str, left: int):
        pending: dict[int, int] = {}
        lower = 0
        for cost, mask in node[1]:
            added, lower = mask & ~lower, mask
            moved = self._move(added, char)
            if moved:
                pending[cost] = pending.get(cost, 0) | moved
            if cost < left:
                pending[cost + 1] = pending.get(cost + 1, 0) | added | self._edit(added)  # deletion, replacement
        node[2][char, left] = got = self._node(left, pending)
        return got

    @staticmethod
    def _within(place, cost: int) -> int:
        """States that a node reaches at ``cost`` or less, counted from the text's beginning."""
        (_, layers, _), base = place
        got = 0
        for c, mask in layers:
            if base + c > cost:
                break
            got = mask
        return got

    def _ahead(self, text: str) -> list[int]:
        """Per position, edits that the rest of ``text`` takes at least: pieces of it, counted from the end, that no
        derivation holds (the last one: ends with). Each takes an edit inside."""
        out, count, states = [0], 0, self.final
        for c in reversed(text):
            states = self._unmove(states, c)
            if not states:
                count, states = count + 1, self.all
            out.append(count)
        return out[::-1]

    def least(self, text: str, known: tuple[int, list[int]] | None = None) -> tuple[int, list[int]]:
        """Least cost and positions of edits, as late as they can be. ``known`` is some repair."""
        ahead, more = self._ahead(text), 0
        while True:
            limit = ahead[0] + more
            if known and limit >= known[0]:
                return known[0] > ahead[0] and self.repair(text, known[0] - 1, ahead) or known
            got = self.repair(text, limit, ahead)
            if got:
                return got
            more = 2 * more + 1

    def repair(self, text: str, limit: int, ahead: list[int]) -> tuple[int, list[int]] | None:
        """:meth:`least`; None if the cost is above ``limit``. States that cannot lead to less are left out."""
        place, marks = (self._node(limit - ahead[0], {0: self.start}), 0), []
        for k in range(0, len(text), STRIDE):
            self._trim()
            marks.append(((*place[0][:2], {}), place[1]))  # without its arcs, which hold what follows
            for place in self._run(place, text, ahead, k):
                pass
            if place is None:
                return None
        cost = next((place[1] + c for c, mask in place[0][1] if mask & self.final), None)
        if cost is None:
            return None
        trail, first, i, left, states, edits = [place], len(text), len(text), cost, self.final, []
        while i or left:
            if i == first and i:  # the places before are run again
                self._trim()
                first = (i - 1) // STRIDE * STRIDE
                trail = [marks[first // STRIDE], *self._run(marks[first // STRIDE], text, ahead, first)]
            if left:
                before = self._unedit(states)
                inserted = before & self._within(trail[i - first], left - 1)
                if inserted:
                    states, left = inserted, left - 1
                    edits.append(i)
                    continue
                changed = (before | states) & self._within(trail[i - 1 - first], left - 1) if i else 0
                if changed:
                    states, left, i = changed, left - 1, i - 1
                    edits.append(i)
                    continue
            states = self._unmove(states, text[i - 1]) & self._within(trail[i - 1 - first], left)
            i -= 1
        return cost, edits[::-1]

    def _trim(self) -> None:
        for kept in (self._nodes, self._masks, self._moved, self._edited, self._came, self._before):
            if len(kept) > KEPT:
                kept.clear()

    def _run(self, place, text: str, ahead: list[int], k: int):
        """Places (node, cost so far) behind the next STRIDE tokens from k; None and no more where nothing is left."""
        node, base = place
        for i in range(k, min(k + STRIDE, len(text))):
            left = node[0] + ahead[i] - ahead[i + 1]
            to = node[2].get((text[i], left), 0)
            node = self._follow(node, text[i], left) if to == 0 else to
            if node is None:
                yield None
                return
            base += left - node[0]
            yield node, base


def settle(grammar: Grammar, bracket: str, text: str) -> tuple[str, int, list[int]]:
    """:meth:`Grammar.cell` with the least cost; the empty bracket stands for the whole text."""
    kept: dict = grammar.__dict__.setdefault("_settled", {})
    got = kept.get((bracket, text))
    if got is not None:
        return got
    flat = grammar.collapse(grammar, text) if grammar.collapse else text
    names = grammar.contents[bracket] if bracket else [grammar.start]
    if bracket:
        char, cost, edits = grammar.cell(bracket, text)
    else:
        char, (cost, edits) = "", (0, []) if grammar.automaton(grammar.start).derives(flat) else grammar._best(names, flat)
    if cost > 1:
        unions: dict = grammar.__dict__.setdefault("_unions", {})
        if bracket not in unions:
            unions[bracket] = Union(grammar, names)
        cost, edits = unions[bracket].least(flat, (cost, edits) if cost < MAX_COST else None)
    if len(kept) > KEPT:
        kept.clear()
    kept[bracket, text] = got = char, cost, edits
    return got


def _unpaired(tokens: list[tuple[str, int]]) -> tuple[set[int], set[int]]:
    """Indexes of the fewest opening and closing brackets without which all others pair up.

    Neighbours that pair up stay; over what is left, which takes the square of its number in memory and the cube in
    time, the fewest of every span are found from those of shorter ones."""
    left: list[int] = []
    for i, (name, _) in enumerate(tokens):
        if name in _OPEN or name in _CLOSE:
            if left and tokens[left[-1]][0] == _CLOSE.get(name):
                left.pop()
            else:
                left.append(i)
    opening, closing = {i for i in left if tokens[i][0] in _OPEN}, {i for i in left if tokens[i][0] in _CLOSE}
    if not opening or not closing or min(opening) > max(closing):
        return opening, closing
    core = [i for i in left if min(opening) <= i <= max(closing)]
    names, n = [tokens[i][0] for i in core], len(core)
    partners = {o: [k for k in range(n) if names[k] == c] for o, c in _INVERSE.items()}
    fewest = np.zeros((n + 1, n + 1), np.int16 if n < 32_000 else np.int32)
    for i in range(n - 1, -1, -1):
        row, inside = fewest[i], fewest[i + 1]
        row[i + 1 :] = inside[i + 1 :] + 1
        for k in partners.get(names[i], ()):
            if k > i:
                np.minimum(row[k + 1 :], fewest[k + 1, k + 1 :] + inside[k], out=row[k + 1 :])
    todo = [(0, n)]
    while todo:
        i, j = todo.pop()
        while i < j:
            k = next((k for k in partners.get(names[i], ()) if i < k < j and fewest[i, j] == fewest[i + 1, k] + fewest[k + 1, j]), None)
            if k is None:
                i += 1
                continue
            opening.discard(core[i])
            closing.discard(core[k])
            todo.append((i + 1, k))
            i = k + 1
    return opening, closing


def least(grammar: Grammar, tokens) -> Parse:
    """:func:`cairn.llm.chart.parse` without bounds. The fewest brackets are closed or dropped: a group that is not
    closed ends where the one around it does, at last with the text. Then the content of every group, also of one
    that was open, takes its least edits."""
    tokens, out = list(tokens), Parse()
    opening, closing = _unpaired(tokens)
    stack: list[tuple[str, int, list[str], list[int], bool]] = []
    seg: list[str] = []
    at: list[int] = []
    bracket, opened, line, loose = "", 1, 1, False

    def settled(end: bool) -> str:
        c, cost, edits = settle(grammar, bracket, "".join(seg))
        out.cost += cost
        out.lines += [at[e] if e < len(at) else at[-1] if at and not end else line for e in edits]
        return c

    def close(end: bool = False) -> None:
        nonlocal seg, at, bracket, opened, loose
        if loose:
            out.cost += 1
            out.lines.append(line)
        c, begun = settled(end), opened
        bracket, opened, seg, at, loose = stack.pop()
        seg.append(c)
        at.append(begun)

    for i, (name, line) in enumerate(tokens):
        if name in _OPEN:
            stack.append((bracket, opened, seg, at, loose))
            bracket, opened, seg, at, loose = name, line, [], [], i in opening
        elif i in closing:
            out.cost += 1
            out.lines.append(line)
        elif name in _CLOSE:
            while loose:
                close()
            close()
        else:
            seg.append(grammar.char(name))
            at.append(line)
    out.last_line, out.open_at_end = line, len(stack)
    while stack:
        close(True)
    settled(out.open_at_end > 0)
    return out
