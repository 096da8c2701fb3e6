"""Outlines of languages without a grammar: candidates by line, extents from one pass over the file.

Every extent a candidate may have - to the closing brace, to the end of the indented lines, to the paired word,
to the next heading of its level - follows from a stack that one pass over the lines fills, so a file costs its
length, however its declarations nest. Candidates inside the extent of an earlier one of their list are passed
over.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cached_property

# Declaration words, in the order in which they are tried.
KOTLIN = (
    "private suspend fun ", "suspend fun ", "private fun ", "public fun ", "internal fun ", "protected fun ", "fun ",
    "private data class ", "data class ", "private sealed class ", "sealed class ", "private abstract class ", "abstract class ",
    "private class ", "public class ", "internal class ", "class ", "private open class ", "open class ",
    "private object ", "public object ", "internal object ", "object ", "private companion object ", "companion object ",
    "private interface ", "public interface ", "internal interface ", "interface ",
    "private enum ", "public enum ", "internal enum ", "enum ", "typealias ", "private val ", "val ", "private var ", "var ",
)
GLEAM = ("pub fn ", "fn ", "pub type ", "type ", "pub opaque type ", "opaque type ", "pub const ", "const ", "pub enum ", "enum ", "import ")
DOT, DOT_DEFAULTS = ("digraph ", "graph ", "subgraph "), ("node ", "edge ")
STYLE = ("@mixin ", "@function ")
# Characters that begin a style rule, and those that end a rule's name and a declaration's name.
RULE_SIGNS, RULE_ENDS, NAME_ENDS = ".#@%", " {:[", " ({:<=\t"

#: (name, kind, first line, last line), lines from 0.
Span = tuple[str, str, int, int]


class Lines:
    """The lines of a file, and where what begins on each of them ends."""

    def __init__(self, lines: list[str]):
        self.raw, self.text = lines, [s.strip() for s in lines]
        self.width = [len(s) - len(s.lstrip()) for s in lines]

    @cached_property
    def brace(self) -> list[int]:
        """Per line the line on which the braces it leaves open are closed; the line itself where it leaves none."""
        out, open_lines, level = list(range(len(self.text))), [], 0
        for i, s in enumerate(self.text):
            before, level = level, level + s.count("{") - s.count("}")
            while open_lines and open_lines[-1][0] >= level:
                out[open_lines.pop()[1]] = i
            if level > before:
                open_lines.append((before, i))
        for _, i in open_lines:
            out[i] = len(out) - 1
        return out

    @cached_property
    def indent(self) -> list[int]:
        """Per line the last line that belongs to it by being indented deeper, or by beginning with a dot."""
        out, stack, last = list(range(len(self.text))), [], 0
        for i, s in enumerate(self.text):
            if not s:
                continue
            if not s.startswith("."):
                while stack and self.width[stack[-1]] >= self.width[i]:
                    out[stack.pop()] = last
            stack.append(i)
            if s.startswith("."):  # ends nothing, so the stack need not rise with the widths
                stack.sort(key=lambda j: (self.width[j], j))
            last = i
        for i in stack:
            out[i] = max(last, i)
        return out

    def paired(self, opener: str, closer: str) -> list[int]:
        """Per line that begins with ``opener`` the line that begins with its ``closer``."""
        out, stack = list(range(len(self.text))), []
        for i, s in enumerate(self.text):
            if s.startswith(opener):
                stack.append(i)
            elif s.startswith(closer) and stack:
                out[stack.pop()] = i
        for i in stack:
            out[i] = len(out) - 1
        return out

    def block(self, i: int) -> int | None:
        """The end of the braces that begin on line i or alone on the next; None where there are none."""
        if "{" in self.text[i]:
            return self.brace[i]
        return self.brace[i + 1] if i + 1 < len(self.text) and self.text[i + 1] == "{" else None


def outermost(candidates: list[Span]) -> list[Span]:
    out, free = [], 0
    for c in candidates:
        if c[2] >= free:
            out.append(c)
            free = c[3] + 1
    return out


def declarations(f: Lines, words: tuple[str, ...], whole_words: bool) -> list[Span]:
    """Lines that begin with one of the words. A word is passed over where a letter or digit follows it, so that
    only nameless declarations are found, unless ``whole_words`` asks for named ones."""
    out = []
    for i, s in enumerate(f.text):
        for w in words:
            if not s.startswith(w):
                continue
            rest = s[len(w) :]
            if not whole_words and rest[:1].isalnum():
                continue
            end = f.block(i)
            if end is None:
                end = f.indent[i] if i + 1 < len(f.raw) and f.raw[i + 1].startswith(" ") else i
            out.append((re.split(f"[{re.escape(NAME_ENDS)}]", rest, maxsplit=1)[0], w.split()[0], i, end))
            break
    return outermost(out)


def rules(f: Lines) -> list[Span]:
    """Style rules by their first sign; the name is the first simple selector, of more than one character."""
    out = []
    for i, s in enumerate(f.text):
        if s[:1] and s[0] in RULE_SIGNS:
            name = re.split(f"[{re.escape(RULE_ENDS)}]", s, maxsplit=1)[0]
            if len(name.encode()) > 1:
                end = f.block(i)
                out.append((name, "css-rule", i, i if end is None else end))
    return outermost(out)


def functions(f: Lines) -> list[Span]:
    ends = f.paired("function", "end")
    return outermost([(s.split()[1], "function", i, ends[i]) for i, s in enumerate(f.text) if s.startswith("function ")])


def headings(f: Lines) -> list[Span]:
    """Starred headings, indented or not; one reaches to the next of its level or above."""
    out, open_heads = [], []
    for i, s in enumerate(f.text):
        level = len(s) - len(s.lstrip("*"))
        if level:
            while open_heads and open_heads[-1][0] >= level:
                out.append((*open_heads.pop()[1:], i - 1))
            if name := s[level:].strip():
                open_heads.append((level, name, f"h{level}", i))
    out += [(*h[1:], len(f.text) - 1) for h in open_heads]
    return outermost(sorted(out, key=lambda h: h[2]))


def tables(f: Lines) -> list[Span]:
    heads = [(i, n) for i, s in enumerate(f.text) if s.startswith("[") and s.endswith("]") and (n := s.strip("[]").strip()) and all(c.isalnum() or c in "._-\"' " for c in n)]
    ends = [i - 1 for i, _ in heads[1:]] + [len(f.text) - 1]
    return [(n, "table", i, max(i, e)) for (i, n), e in zip(heads, ends)]


def outline(language: str, lines: list[str], whole_words: bool = False) -> list[list[Span]]:
    """The lists of spans of a language, in the order in which they are reported."""
    f = Lines(lines)
    words = lambda *some: [declarations(f, w, whole_words) for w in some]
    return {
        "kotlin": lambda: words(KOTLIN), "gleam": lambda: words(GLEAM), "dot": lambda: words(DOT, DOT_DEFAULTS),
        "scss": lambda: [*words(STYLE), rules(f)], "less": lambda: [*words(STYLE), rules(f)],
        "fish": lambda: [functions(f)], "org": lambda: [headings(f)], "toml": lambda: [tables(f)],
    }.get(language, list)()


def enclosing(lists: list[list[Span]]) -> list[tuple[Span, Span | None]]:
    """Each span with the first one that begins before it and holds it; within a list none holds another."""
    starts = [[s[2] for s in spans] for spans in lists]

    def holder(s: Span) -> Span | None:
        for at, spans in zip(starts, lists):
            j = bisect_left(at, s[2]) - 1
            if j >= 0 and spans[j][3] >= s[3]:
                return spans[j]
        return None

    return [(s, holder(s)) for spans in lists for s in spans]
