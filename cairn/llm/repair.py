"""Re-Pair grammars of token sequences, and locally consistent rules that agree between files."""

from __future__ import annotations

import re
import zlib

import numpy as np

_TRIPLE = r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''"
_SHORT = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
#: A literal in plain quotes whose lines, as of wrapped data, hold no blanks but their indentation.
_WRAPPED = r"\"(?:[^\"\s]*\r?\n[ \t]*)+[^\"\s]*\"|'(?:[^'\s]*\r?\n[ \t]*)+[^'\s]*'"
_BACKTICK = r"`(?:[^`\\]|\\.)*`"
_REST = r"|[^\W\d]\w*|\d[\w.]*|[^\w\s]"
_NOTE = r"//[^\n]*|/\*.*?\*/|(?:(?<=\n)|^)[ \t]*#(?!include|define|if|else|endif|pragma|\[|!)[^\n]*"
#: By whether the language has literals in backticks: comments and literals as they follow each other, and tokens.
_SCAN = {t: re.compile("|".join([_NOTE, _TRIPLE, _SHORT, _WRAPPED, *[_BACKTICK] * t]), re.S) for t in (False, True)}
_TOKEN = {t: re.compile("|".join([_TRIPLE, _SHORT, _WRAPPED, *[_BACKTICK] * t]) + _REST, re.S) for t in (False, True)}
#: The same in one pass, for texts without literals in three quotes: comments leave the group empty.
_PLAIN = {t: re.compile(f"{_NOTE}|({'|'.join([_SHORT, _WRAPPED, *[_BACKTICK] * t])}{_REST})", re.S) for t in (False, True)}
_BACKTICKED = frozenset(("javascript", "jsx", "typescript", "tsx", "go"))
_DIGITS = re.compile(r"\d+")


def _documents(before: str, near: int = 64) -> bool:
    """A string after this text, which is free of comments, is the first statement of a module, class or function.
    That takes the last lines, ``near`` at first and all where the statement before begins further up."""
    lines = before.rsplit("\n", near)
    whole = len(lines) <= near
    own = lines.pop()
    if own.strip(" \trRuUbBfF"):
        return bool(re.search(r"@\w*doc\s+(?:~[sS])?$", own))
    while lines and not lines[-1].strip():
        lines.pop()
    if not whole and len(lines) < 2:
        return _documents(before, near * 16)
    if not lines:
        return True
    head, depth = re.sub(r"#[^\"']*$", "", lines[-1]).rstrip(), 0
    if not head.endswith(":"):
        return False
    for line in reversed([*lines[:-1], head]):  # back to the line on which the statement begins
        depth += sum(line.count(c) for c in ")]}") - sum(line.count(c) for c in "([{")
        if depth <= 0:
            return bool(re.match(r"\s*(?:async\s+def|def|class)\b", line))
    return not whole and _documents(before, near * 16)


def code_tokens(text: str, language: str | None = None) -> list[str]:
    """Tokens without comments and docstrings; a literal is one token, however many lines it has."""
    ticks = language in _BACKTICKED
    if '"""' not in text and "'''" not in text:
        return list(filter(None, _PLAIN[ticks].findall(text)))
    kept: list[str] = []
    at = 0
    for m in _SCAN[ticks].finditer(text):
        found = m.group()
        if found[0] in "\"'`" and not (found[:3] in ('"""', "'''") and _documents("".join(kept) + text[at : m.start()])):
            continue
        kept += [text[at : m.start()], " "]
        at = m.end()
    return _TOKEN[ticks].findall("".join(kept) + text[at:])


def unify(token: str) -> str:
    """The token with numbers and numbering in names unified: what a template leaves alike."""
    return "0" if token[0].isdigit() else '""' if token[0] in "\"'`" else _DIGITS.sub("0", token)


def re_pair(tokens: list[str], least: int = 2) -> tuple[int, int, list[int]]:
    """``(length of the final sequence, number of rules, uses of each rule)`` of the grammar that replaces the
    most frequent pairs by rules until none occurs ``least`` times. Pairs of equal count go in one round. Rules
    that are used twice leave length + 2 * rules as it is, so for that sum 3 is as good as 2."""
    names = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    seq = np.array([names[t] for t in tokens], np.int64)
    top, uses = len(names), []
    while len(seq) > 1:
        pairs = (seq[:-1] << 32) | seq[1:]
        order = pairs.argsort(kind="stable")
        ranked = pairs[order]
        starts = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1])
        counts = np.diff(starts, append=len(pairs))
        most = int(counts.max())
        if most < least:
            break
        begin = starts[counts == most]
        at = order[(begin[:, None] + np.arange(most)).ravel()]
        which = np.repeat(np.arange(len(begin)), most)
        by_place = at.argsort()
        at, which = at[by_place], which[by_place]
        if (at[1:] - at[:-1] == 1).any():  # left to right, without overlaps
            keep, last = np.ones(len(at), bool), -2
            for k, p in enumerate(at.tolist()):
                keep[k] = p > last + 1
                if keep[k]:
                    last = p
            at, which = at[keep], which[keep]
        n = np.bincount(which, minlength=len(begin))
        used = n >= 2
        chosen = used[which]
        at, which = at[chosen], which[chosen]
        if not len(at):
            break
        seq[at] = (top + np.cumsum(used) - 1)[which]
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq = seq[stays]
        top += int(used.sum())
        uses += n[used].tolist()
    return len(seq), len(uses), uses


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shared_rules(tokens: list[str], least: int = 24) -> list[tuple[int, int]]:
    """:func:`shared_rules_of` of one file."""
    return shared_rules_of([tokens], least)[0]


def shared_rules_of(files: list[list[str]], least: int = 24) -> list[list[tuple[int, int]]]:
    """Per file ``(rule hash, tokens)`` of the rules that expand to at least ``least`` tokens, for a grammar whose
    choices depend on neighbouring symbols only: at every level a block starts at a local minimum of the
    symbols' hashes. Equal passages therefore get equal rules, in whichever file they stand. The files of a
    batch go through each level together; a file is done once most of its blocks are that long."""
    known: dict[str, int] = {}
    for t in files:
        for w in t:
            if w not in known:
                known[w] = zlib.crc32(w.encode())
    long = [k for k, t in enumerate(files) if len(t) >= least]
    owner = np.repeat(np.array(long, np.int64), [len(files[k]) for k in long])
    seq = _mix(np.array([known[w] for k in long for w in files[k]], np.uint64))
    size = np.ones(len(seq), np.int64)
    found: list[dict[int, int]] = [{} for _ in files]
    for _ in range(16):
        first = np.ones(len(seq), bool)
        first[1:] = owner[1:] != owner[:-1]
        many = np.bincount(owner, minlength=len(files)) >= 3
        live = many[owner] if len(owner) else first
        seq, size, owner, first = seq[live], size[live], owner[live], first[live]
        if not len(seq):
            break
        starts = first.copy()
        inner = ~(first[1:-1] | first[2:])  # neither the first nor the last symbol of its file
        starts[1:-1] |= inner & (seq[1:-1] < seq[:-2]) & (seq[1:-1] <= seq[2:])
        start = np.flatnonzero(starts)
        with np.errstate(over="ignore"):
            position = np.arange(len(seq)) - np.repeat(start, np.diff(start, append=len(seq)))
            part = _mix(seq + position.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            seq, size, owner = _mix(np.add.reduceat(part, start)), np.add.reduceat(size, start), owner[start]
        done = size >= least
        for k, h, n in zip(owner[done].tolist(), seq[done].view(np.int64).tolist(), size[done].tolist()):
            found[k].setdefault(h, n)
        blocks, ready = np.bincount(owner, minlength=len(files)), np.bincount(owner[done], minlength=len(files))
        live = ((ready < blocks) & (ready <= 0.6 * blocks))[owner]
        seq, size, owner = seq[live], size[live], owner[live]
    return [list(x.items()) for x in found]
