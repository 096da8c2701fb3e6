"""Generated, minified and vendored source files, and data saved as code.

Every file's tokens (without comments) go through two grammars. A Re-Pair grammar of their shape - numbers and
numbering in names unified - measures rule reuse: text that a template wrote collapses to a grammar of nearly
constant size. A locally consistent grammar yields rules whose hashes agree between files; a file most of
whose long rules also occur in other repositories is a copy. Literals that a Re-Pair grammar cannot shorten
are blobs, and code without white space is squeezed. Path and header serve as further evidence: for files
without content, to confirm what the grammars suggest, and for copies in vendor folders of which no other
repository has the original. ``evidence`` tells for each file which kind of it decided.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.language import detect, detect_doc
from cairn.llm.repair import code_tokens, re_pair, shared_rules_of, unify
from cairn.session import cut

#: Directories that package managers and custom reserve for copies of other projects.
VENDOR = frozenset("vendor _vendor third_party 3rdparty Pods external extern node_modules bower_components deps".split())
#: Directories for what tools write.
OUTPUT = frozenset("dist build out gen generated target".split())
_MARK = re.compile(r"@generated\b|<auto-generated|auto-?generated\s*\(|code generated by\b|generated (?:on build )?by \w+,|machine-written by|automatically (?:produced|generated) by|do not edit\b|do not modify manually|changes will be lost", re.I)
_COMMENT_LINE = re.compile(r"\s*(?://|#|/\*|\*|--|;|<!--)")
_BUNDLE = re.compile(r"(?:\.min|\.bundle|-[0-9a-f]{8})\.\w+$|\.lock\.json$|(?:^|/)package-lock\.json$")
_WRAP = re.compile(r"\\?\r?\n[ \t]*")
#: Tokens that may stand between the pieces of one literal, and between the items of a list.
_JOINERS = frozenset([*"+.\\()", *"rRuUbBfF", "rb", "br", "Rb", "bR", "rB", "Br", "RB", "BR"])
_LISTED = frozenset(",[]{}")
_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:[ \t].*)?\r?\n?", re.M)
_DATED = re.compile(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d", re.M)
#: A template's grammar has this many symbols, plus this share of the tokens; JSON, whose configuration repeats
#: its keys' shape, must also shrink to a fifth.
GRAMMAR_BASE, GRAMMAR_SHARE, GRAMMAR_RATIO = 55, 0.03, 0.4
SQUEEZED, BLOB_SHARE = 0.10, 0.6
#: A copy has this share of its long rules, and at least so many tokens in them, in other repositories too.
COPIED_SHARE, COPIED_TOKENS = 0.5, 64
OVERSIZED = 1_000_000
#: Characters from which a literal is examined, and about as many that go through one grammar.
LITERAL, BLOCK = 160, 4000
#: Characters of files that go through the shared rules together.
TOGETHER = 1 << 20
#: Characters from which items of a list that are all equally long, but for the last one, are lines of wrapped data.
WRAPPED_LINE = 32


def literals(tokens: list[str]) -> list[str]:
    """The literals' characters without quotes, wrapping and indentation. Pieces that are joined are one literal,
    and so are the lines of wrapped data in a list."""
    out: list[list[str]] = []
    joined = listed = False
    for t in tokens:
        if len(t) > 1 and t[0] in "\"'`":
            n = 3 if t[:3] in ('"""', "'''") and len(t) >= 6 else 1
            s = _WRAP.sub("", t[n:-n])
            wrapped = listed and len(s) <= len(out[-1][-1]) == len(out[-1][0]) >= WRAPPED_LINE
            if not (joined or wrapped):
                out.append([])
            out[-1].append(s)
            joined = listed = True
        elif t not in _JOINERS:
            joined, listed = False, listed and t in _LISTED
    return ["".join(x) for x in out]


def dense(s: str) -> int:
    """Characters of the literal in blocks without blanks that a grammar can't shorten; every block is examined."""
    k = max(1, round(len(s) / BLOCK))
    ends = [len(s) * i // k for i in range(k + 1)]
    found = 0
    for a, b in zip(ends, ends[1:]):
        block = s[a:b]
        if sum(c.isspace() for c in block) * 50 < len(block):
            left, rules, _ = re_pair(list(block), 3)
            if left + 2 * rules > 0.6 * len(block):
                found += len(block)
    return found


def blob_share(tokens: list[str], counts: Counter[str]) -> float:
    """Share of the token characters in numbers and in literals that a grammar can't shorten; 0 where all numbers
    and literals together are below BLOB_SHARE."""
    total = numbers = quoted = 0
    for t, n in counts.items():
        size = len(_WRAP.sub("", t)) if "\n" in t else len(t)
        total += n * size
        if t[0].isdigit():
            numbers += n * size
        elif t[0] in "\"'`":
            quoted += n * size
    if numbers + quoted < BLOB_SHARE * total:
        return 0.0
    strings = sum(dense(s) for s in literals(tokens) if len(s) >= LITERAL)
    return (numbers + strings) / (total or 1)


def tabular(text: str) -> bool:
    """Log or delimited lines: nine of ten begin with a time, or have as many commas and no brackets."""
    lines = [s for s in text.splitlines() if s.strip()]
    if len(lines) < 10:
        return False
    if len(_DATED.findall(text.replace("\r", "\n"))) >= 0.9 * len(lines):
        return True
    if text.count(",") < 1.8 * len(lines):
        return False
    commas = sorted(s.count(",") for s in lines)
    usual = commas[len(commas) // 2]
    return usual >= 2 and sum(s.count(",") == usual and not re.search(r"[()\[\]{};]", s) for s in lines) >= 0.9 * len(lines)


def tokens_of(path: str, content: str | None) -> list[str]:
    """The tokens that count: none of documentation files, and what a merge left behind is nobody's writing."""
    return [] if not content or detect_doc(path) else code_tokens(_CONFLICT.sub("", content), detect(path))


def examine(path: str, content: str | None, size: int | None = None, tokens: list[str] | None = None) -> tuple[str | None, str | None]:
    """``(kind, evidence)``; the kind is generated, minified, data, vendored (by its folder, where there is no
    content), or None as far as the file alone tells. ``tokens`` are those of :func:`tokens_of`."""
    parts = path.split("/")
    folders, language = set(parts[1:-1]), detect(path)
    if content is None:
        if folders & VENDOR:
            return "vendored", "path"
        if _BUNDLE.search(path) or folders & OUTPUT:
            return "minified", "path"
        if language and (size or 0) >= OVERSIZED:
            return "minified", "size"
        return None, None
    if detect_doc(path) or not content.strip():
        return None, None
    content = _CONFLICT.sub("", content)
    tokens = tokens_of(path, content) if tokens is None else tokens
    if language:
        n = len(tokens)
        counts = Counter(tokens)
        shapes = {t: unify(t) for t in counts}
        marked = any(_MARK.search(s) for s in content.splitlines() if _COMMENT_LINE.match(s))
        # a grammar has at least as many symbols as there are different tokens, so most files need none
        most = min((0.2 if language == "json" else GRAMMAR_RATIO) * n, max(GRAMMAR_BASE + GRAMMAR_SHARE * n, 2 * GRAMMAR_BASE * marked))
        blank = sum(map(content.count, " \t\r\n")) / len(content)
        blob = blob_share(tokens, counts)
        if language != "json" and blob >= BLOB_SHARE:
            return "data", "literals"
        if language != "json" and tabular(content):
            return "data", "delimited lines"
        if n >= 60 and blank < SQUEEZED and language != "json" and len(content) > 250 and max(map(len, content.splitlines())) > 120:
            return "minified", "white space"
        left, made, uses = re_pair([shapes[t] for t in tokens], 3) if n >= 40 and len(set(shapes.values())) < most else (n, 0, [])
        if max(uses, default=0) >= 4 and left + 2 * made < most:
            return "generated", "rule reuse"
        if marked and n < 40:
            return "generated", "header"
        if language == "json" and _BUNDLE.search(path):
            return "generated", "path"
    return None, None


def find_foreign(contents: DataFrame, files: DataFrame | None = None, *, key: str = "file_id", path: str = "path", content: str = "content", size: str = "size") -> DataFrame:
    """``(key, path, kind, evidence, copied_share)`` of the files nobody wrote by hand for their repository.

    kind: generated, minified, data or vendored; evidence: rule reuse, literals, delimited lines, white space,
    header or shared rules by the content, folder for a copy that only its vendor folder tells, and path or size
    where there is no content; copied_share: share of the tokens in long rules that lie in rules other
    repositories have too. Empty and blank files are judged by their path alone; files with NULL content by path
    and by ``size`` in ``files``. Rows with NULL path or key are no files; repeated rows count once; extra columns
    are ignored. Contents stay in their partition; hashes of long rules, about one per 32 tokens, are grouped
    map-side first, and whether a rule is shared needs two strings per rule, however many files have it.
    """
    kind_of = dict(contents.dtypes)[key]
    c = contents.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(content).alias("c")).where("k is not null and p is not null")
    here = c.where("c is not null").withColumn("s", F.lit(None).cast("long"))
    gone = c.where("c is null")
    if files is not None:
        gone = gone.join(files.select(F.col(key).alias("k"), F.col(size).cast("long").alias("s")).groupBy("k").agg(F.max("s").alias("s")), "k", "left")
    else:
        gone = gone.withColumn("s", F.lit(None).cast("long"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows, group, held = [], [], 0

            def judge() -> None:
                tokens = [tokens_of(q, text) for _, q, text, _ in group]
                for (k, q, text, s), own, rules in zip(group, tokens, shared_rules_of(tokens)):
                    folder = bool(VENDOR & set(q.split("/")[1:-1]))
                    rows.append((k, q, q.partition("/")[0], *examine(q, text, None if s is None or s != s else int(s), own), folder, [h for h, _ in rules], [n for _, n in rules], sum(n for _, n in rules)))
                group.clear()

            for row in zip(p.k, p.p, p.c, p.s):
                group.append(row)
                held += len(row[2] or "")
                if held >= TOGETHER:
                    judge()
                    held = 0
            judge()
            yield pd.DataFrame(rows, columns=["k", "p", "repo", "kind", "evidence", "folder", "hashes", "sizes", "covered"])

    seen = cut(here.unionByName(gone).mapInPandas(run, f"k {kind_of}, p string, repo string, kind string, evidence string, folder boolean, hashes array<long>, sizes array<long>, covered long"))
    seen = seen.dropDuplicates(["k"])
    rules = seen.where("kind is null").select("k", "repo", F.explode(F.arrays_zip("hashes", "sizes")).alias("r")).select("k", "repo", F.col("r.hashes").alias("h"), F.col("r.sizes").alias("n"))
    everywhere = seen.select("repo", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a <> b").select("h")
    shared = rules.join(everywhere, "h", "left_semi").groupBy("k").agg(F.sum("n").alias("shared"))
    judged = seen.select("k", "p", "kind", "evidence", "folder", "covered").join(shared, "k", "left").withColumn("share", F.when(F.col("covered") > 0, F.coalesce("shared", F.lit(0)) / F.col("covered")).otherwise(0.0))
    copied = (F.col("share") >= COPIED_SHARE) & (F.col("shared") >= COPIED_TOKENS)
    evidence = F.when(F.col("kind").isNotNull(), F.col("evidence")).when(copied, "shared rules").when(F.col("folder"), "folder")
    kind = F.coalesce("kind", F.when(copied | F.col("folder"), "vendored"))
    return judged.withColumn("evidence", evidence).withColumn("kind", kind).where("kind is not null").select(F.col("k").alias(key), F.col("p").alias(path), "kind", "evidence", F.round("share", 6).alias("copied_share"))
