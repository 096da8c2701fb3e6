"""Splitting oversized items at natural boundaries.

Separators form a hierarchy: section, paragraph, line, sentence, word, character. An item is cut into units
that fit, coarsest separator first, recursing only where a unit is still too long, so a line within the limit
is never broken. Units are packed greedily up to the limit; within a full piece the cut falls on the strongest
boundary of its second half, or on an earlier end of a line rather than inside one. Neighbours share the last
``overlap`` lines of the earlier piece as far as that leaves room for new text; inside a line that alone is too
long they share its trailing words instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 800, 2
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_SENTENCE = re.compile(r"(?<=[.!?;。！？；])\s*|(?<= \|)\s")
_WORD = re.compile(r"(?<=\s)(?=\S)")
_SECTION = re.compile(r"\s{0,3}(?:#{1,6}\s|={3,}|-{3,}|class\b|def\b|fn\b|func\b|function\b)")
#: Strength of a boundary after a unit.
SECTION, PARAGRAPH, LINE, SENTENCE, WORD, CHARACTER = 6, 5, 4, 3, 2, 1


def _cut_long(text: str, limit: int) -> list[tuple[str, int]]:
    """Units of a line longer than ``limit``, with the strength of the boundary after each."""
    for pattern, strength in ((_SENTENCE, SENTENCE), (_WORD, WORD)):
        at = [0, *[m.end() for m in pattern.finditer(text) if 0 < m.end() < len(text)], len(text)]
        parts = [text[a:b] for a, b in zip(at, at[1:]) if b > a]
        if len(parts) > 1:
            out: list[tuple[str, int]] = []
            for p in parts:
                if len(p) <= limit:
                    out.append((p, strength))
                else:
                    out += _cut_long(p, limit)[:-1] + [(_cut_long(p, limit)[-1][0], strength)] if pattern is _SENTENCE else _characters(p, limit, strength)
            return out
    return _characters(text, limit, WORD)


def _characters(text: str, limit: int, last: int) -> list[tuple[str, int]]:
    step = max(1, limit // 8)
    parts = [text[i : i + step] for i in range(0, len(text), step)]
    return [(p, CHARACTER) for p in parts[:-1]] + [(parts[-1], last)]


def units(text: str, limit: int) -> list[tuple[str, int, int]]:
    """``(text, line number from 0, strength of the boundary after it)``; joined they are the text."""
    lines = [m for m in _LINE.findall(text) if m]
    out = []
    for n, line in enumerate(lines):
        following = lines[n + 1] if n + 1 < len(lines) else ""
        strength = SECTION if _SECTION.match(following) else PARAGRAPH if not line.strip() and following.strip() else LINE
        if len(line) <= limit:
            out.append((line, n, strength))
        else:
            parts = _cut_long(line, limit)
            out += [(p, n, s) for p, s in parts[:-1]] + [(parts[-1][0], n, strength)]
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int, int, int]]:
    """``(text, first line, last line, shared characters)`` of each piece; lines from 0.

    A piece without its shared head, joined to its predecessors, gives back the text. An item within the
    limit is one piece, an empty one is none.
    """
    if not text:
        return []
    if len(text) <= limit:
        return [(text, 0, max(0, sum(1 for m in _LINE.findall(text) if m) - 1), 0)]
    us, out, start, i = units(text, limit), [], 0, 0
    while True:  # us[start:i] is the shared head, us[i:] is new
        size, j = sum(len(u[0]) for u in us[start:i]), i
        head = size
        while j < len(us) and size + len(us[j][0]) <= limit:
            size += len(us[j][0])
            j += 1
        if j < len(us):
            best, at, run = 0, j, head
            for k in range(i, j):
                run += len(us[k][0])
                if (run >= limit // 2 or k == j - 1) and us[k][2] >= best:
                    best, at = us[k][2], k + 1
            if best < LINE:
                at = next((k + 1 for k in range(j - 1, i - 1, -1) if us[k][2] >= LINE), at)
            j = at
        out.append(("".join(u[0] for u in us[start:j]), us[start][1], us[j - 1][1], head))
        if j >= len(us):
            return out
        first, i, start, room = i, j, j, limit - len(us[j][0])
        if us[j - 1][2] >= LINE:  # share whole lines
            lines: list[int] = []
            for k in range(j - 1, first, -1):
                n = us[k][1]
                if n not in lines:
                    if len(lines) == overlap:
                        break
                    lines.append(n)
                room -= len(us[k][0])
                if room < 0:
                    break
                if us[k - 1][1] != n:
                    start = k
        else:  # inside a long line: trailing words
            room = min(room, limit // 4)
            for k in range(j - 1, first, -1):
                room -= len(us[k][0])
                if room < 0 or us[k][1] != us[j - 1][1] or j - k > 2:
                    break
                start = k


def line_range(start, end, n_lines: int) -> tuple[int | None, int | None]:
    """Lines of an item with ``n_lines`` lines: swapped bounds are put right; 0, NULL and negative ones are
    missing and derived from the other one; None where both are missing."""
    s = int(start) if start is not None and start == start and start > 0 else None
    e = int(end) if end is not None and end == end and end > 0 else None
    if s is None and e is None:
        return None, None
    if s is None:
        return max(1, e - n_lines + 1), e
    if e is None:
        return s, s + n_lines - 1
    return min(s, e), max(s, e)


def split_items(df: DataFrame, *, keys: tuple[str, str] = ("symbol_id", "chunk_index"), text: str = "embed_text", start: str = "start_line", end: str = "end_line", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every item longer than ``limit`` code points.

    Columns: the group key, ``parent_index`` (the item's old index), ``piece`` (from 0), ``text``,
    ``start_line``, ``end_line``. Lines are anchored at the item's end, where its text ends, and kept within
    its own lines; both are NULL if the item has none. Items within the limit, empty and NULL texts give
    nothing; repeated rows count once; extra columns are ignored, whatever their names. The length filter
    runs in the JVM before anything is shuffled or handed to Python.
    """
    group, index = keys
    long = df.where(F.char_length(F.col(text)) > limit).select(F.col(group).alias("g"), F.col(index).alias("i"), F.col(text).alias("t"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"))
    long = long.dropDuplicates(["g", "i"])
    kinds = dict(df.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for g, i, t, s, e in zip(p.g, p.i, p.t, p.s, p.e):
                cut = pieces(t, limit, overlap)
                lo, hi = line_range(s, e, cut[-1][2] + 1)
                for n, (body, a, b, _) in enumerate(cut):
                    last = cut[-1][2]
                    first = None if hi is None else min(hi, max(lo, hi - (last - a)))
                    until = None if hi is None else min(hi, max(lo, hi - (last - b)))
                    rows.append((g, i, n, body, first, until))
            out = pd.DataFrame(rows, columns=["g", "i", "piece", "text", "start_line", "end_line"])
            out[["start_line", "end_line"]] = out[["start_line", "end_line"]].astype("Int64")
            yield out

    got = long.mapInPandas(run, f"g {kinds[group]}, i {kinds[index]}, piece int, text string, start_line long, end_line long")
    return got.select(F.col("g").alias(group), F.col("i").alias("parent_index"), "piece", "text", "start_line", "end_line")


def renumber(split: DataFrame, group: str = "symbol_id", out: str = "chunk_index") -> DataFrame:
    """New consecutive indexes: each piece moves up by the pieces its group gained before it. Items that were not
    split move with them, see :func:`shift_unsplit`.

    Only rows of split items take part; the window streams over a group in order, whatever its size.
    """
    w = Window.partitionBy(group).orderBy("parent_index", "piece")
    gained = F.row_number().over(w) - F.dense_rank().over(Window.partitionBy(group).orderBy("parent_index"))
    return split.withColumn(out, (F.col("parent_index") + gained).cast("long"))


def shift_unsplit(split: DataFrame, df: DataFrame, keys: tuple[str, str] = ("symbol_id", "chunk_index")) -> DataFrame:
    """``<group>, old_index, <index>``: the items of groups with pieces that were not split themselves, and their new
    index, which is past the pieces gained before them; with the pieces of :func:`renumber` no two are alike.
    Repeated rows count once; NULL groups and NULL indexes are left out."""
    group, index = keys
    gained = split.groupBy(group, F.col("parent_index").alias("old_index")).agg((F.count(F.lit(1)) - 1).alias("_more"))
    whole = df.select(group, F.col(index).alias("old_index")).where("old_index is not null").distinct().join(gained.select(group).distinct(), group, "left_semi")
    w = Window.partitionBy(group).orderBy("old_index").rowsBetween(Window.unboundedPreceding, -1)
    moved = whole.join(gained, [group, "old_index"], "left").withColumn(index, (F.col("old_index") + F.coalesce(F.sum("_more").over(w), F.lit(0))).cast("long"))
    return moved.where("_more is null").select(group, "old_index", index)
