"""Source files that do not parse in the language of their path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.language import detect
from cairn.llm.chart import parse
from cairn.llm.grammars import grammar_of
from cairn.llm.least import least

#: Line starts of merge conflict markers.
CONFLICT = ("<<<<<<<", "=======", ">>>>>>>", "|||||||")
#: Share of lines with edits, and least cost a line, from which a text is in another language.
FOREIGN = 0.2


def examine(path: str | None, content: str | None) -> tuple[str | None, bool, bool, int, int | None, str | None]:
    """:func:`judge` without its last part."""
    return judge(path, content)[:6]


def judge(path: str | None, content: str | None, exact: bool = False) -> tuple[str | None, bool, bool, int, int | None, str | None, bool]:
    """``(language, checked, invalid, cost, first edited line, cause, capped)``.

    cost is that of the cheapest repair found (at least 1 where one is needed). The cause follows from where
    the edits lie: ``conflict`` at merge markers, ``truncation`` at the end with open groups, ``mismatch``
    all over the text or from its first line on, ``local`` otherwise. Empty or blank content is valid, except
    as JSON; NULL content and languages without a grammar are not checked. ``capped`` tells that the cost is a
    least one: the search stopped at a bound, or groups are open at the end. With ``exact`` an invalid text goes
    through :func:`least`, which has no bounds and examines open groups too; nothing is capped then.
    """
    language = detect(path)
    made = grammar_of(language) if language else None
    if made is None or content is None:
        return language, False, False, 0, None, None, False
    lexer, grammar = made
    text = content.replace("\r\n", "\n").replace("\r", "\n")
    if not text.strip() and language != "json":
        return language, True, False, 0, None, None, False
    got = parse(grammar, lexer(text))
    if not got.cost:
        return language, True, False, 0, None, None, False
    if exact:
        got = least(grammar, lexer(text))
    lines, edited = text.split("\n"), sorted(set(got.lines))
    first = edited[0] if edited else 1
    if any(lines[n - 1].startswith(CONFLICT) for k in edited for n in range(max(1, k - 2), min(len(lines), k + 2) + 1)):
        cause = "conflict"
    elif got.open_at_end and edited[-1] >= got.last_line - 1 and len(edited) <= 2:
        cause = "truncation"
    elif first <= 2 or len(edited) > FOREIGN * len(lines):
        cause = "mismatch"
    elif first >= len(lines) - 2:
        cause = "truncation"
    else:
        cause = "local"
    return language, True, True, got.cost, first, cause, got.capped


def flag_files(df: DataFrame, *, key: str = "file_id", path: str = "path", content: str = "content") -> DataFrame:
    """One row per key: key, path, repo (first step of the path), language, checked, invalid, cost, line, cause, capped.

    Costs are exact, so ``capped`` is false. Markdown and plain text have no grammar. Repeated rows are flagged alike and count once; extra columns
    are ignored. Contents never leave their partition: only the narrow result is shuffled, to drop repeats.
    """
    kind = dict(df.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, q, q.partition("/")[0] if q else None, *judge(q, c, exact=True)) for k, q, c in zip(p.k, p.p, p.c)]
            out = pd.DataFrame(rows, columns=["k", "path", "repo", "language", "checked", "invalid", "cost", "line", "cause", "capped"])
            out["line"] = out["line"].astype("Int64")
            yield out

    got = df.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(content).alias("c")).mapInPandas(run, f"k {kind}, path string, repo string, language string, checked boolean, invalid boolean, cost long, line long, cause string, capped boolean")
    return got.dropDuplicates(["k"]).withColumnRenamed("k", key)


def rates(flags: DataFrame) -> DataFrame:
    """Files checked, invalid ones and their rate, per repository and per language (grouping names which)."""
    some = flags.where("checked")
    sets = some.groupingSets([["repo"], ["language"]], "repo", "language") if hasattr(some, "groupingSets") else some.cube("repo", "language")
    got = sets.agg(F.count(F.lit(1)).alias("files"), F.count_if("invalid").alias("invalid"), F.grouping_id().alias("_g"))
    got = got.where("_g in (1, 2)")
    return got.select(F.when(F.col("_g") == 1, "repo").otherwise("language").alias("grouping"), F.coalesce("repo", "language").alias("name"), "files", F.col("invalid").cast("long").alias("invalid"), F.round(F.col("invalid") / F.col("files"), 6).alias("rate"))
