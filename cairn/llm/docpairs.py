"""Functions paired with their documentation.

Candidate documentation is every comment of the file that is stored with a symbol, of whatever kind, and in
languages that put it there the string at the head of a body. Functions and comments of a file form a
bipartite graph: a function is linked with its own comments, and with comments of other symbols within a few
lines: those whose parameter tags or leading name point to it and not to the symbol they are stored with, and
the nearest ones. Edges weigh closeness, names, parameter tags and information; the assignment of greatest
total weight gives each function at most one comment and each comment at most one function. Links by
distance alone are implausible and rejected; a pair whose text is uninformative for its function is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.language import detect

#: Kinds that are functions or methods.
FUNCTION_KINDS = frozenset("function_item function_declaration function_definition function function_static_declaration method_definition method_declaration method singleton_method constructor_declaration destructor_declaration local_function_statement local_function_declaration method_signature secondary_constructor".split())
#: Lines of a file that are matched together; a longer file is cut into such windows, which share NEAR lines.
WINDOW = 4096
#: Lines that may lie between a function and a comment that is stored with another symbol.
NEAR = 4
#: Weights of an edge: a comment of the function's own, one that other tags contradict, information, the head of
#: the body, a name in the text, a leading name, a parameter tag of an own and of another symbol's comment.
OWN, CONTRADICTED, TELLS, HEAD, NAMED, LED, OWN_TAG, TAG = 6.0, -5.0, 4.0, 0.5, 1.0, 3.0, 0.5, 2.0

_PY_HEAD = re.compile(r"\s*(?:async\s+)?def\b[^\n]*?\(", re.S)
_PY_STRING = re.compile(r"\s*(?:#[^\n]*\n\s*)*[rRuUbBfF]{0,2}(\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"([^\"\n]*)\"|'([^'\n]*)')", re.S)
_FUNCTION = {
    "python": re.compile(r"\s*(?:@[^\n]*\n\s*)*(?:async\s+)?def\s+\w+\s*[(\[]"),
    "rust": re.compile(r"\s*(?:#\[[^\n]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+\w+"),
    "go": re.compile(r"\s*func\s*(?:\([^)]*\)\s*)?\w+\s*[(\[]"),
    "typescript": re.compile(r"\s*(?:@[^\n]*\n\s*)*(?:export\s+)?(?:default\s+)?(?:(?:(?:public|private|protected|static|abstract|override|readonly|async|get|set)\s+)*(?:async\s+)?function\b|(?:(?:public|private|protected|static|abstract|override|async|get|set)\s+)*\*?(?!(?:if|for|while|switch|catch|return|import|class|const|let|var|new)\b)[#$\w]+\s*(?:<[^>{}]*>)?\([^;]*?\)\s*(?::[^{;=]+)?\{|(?:const|let|var)\s+[$\w]+\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^={]+)?=>|[$\w]+\s*=>))"),
    "java": re.compile(r"\s*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^>]*>\s*)?(?!(?:new|return|throw|class|interface|enum|record|package|import|else)\b)(?:[\w.$]+(?:<[^;{}()]*>)?(?:\[\])*\s+)?\w+\s*\([^;{}=]*\)\s*(?:throws\s+[\w.,\s]+)?\s*(?:\{|$)"),
    "c": re.compile(r"\s*(?!(?:typedef|return|else|if|for|while|switch)\b)(?:[A-Za-z_]\w*[\s*]+)+[A-Za-z_]\w*\s*\([^;{}]*\)\s*(?:\{|$)"),
}
_FUNCTION["tsx"] = _FUNCTION["cpp"] = _FUNCTION["typescript"]
_FUNCTION["cpp"] = _FUNCTION["c"]
_ANY_FUNCTION = re.compile(r"\s*(?:[\w@]+\s+)*(?:def|fn|func|fun|function|sub|proc)\s+\w+")


def is_function(kind: str | None, path: str | None, signature: str | None, body: str | None) -> bool:
    """By kind or, where that is missing or ``unknown``, by the code."""
    if kind and kind != "unknown":
        return kind in FUNCTION_KINDS
    code = body if body and body.strip() else signature or ""
    return bool(_FUNCTION.get(detect(path) or "", _ANY_FUNCTION).match(code))


def head_documentation(path: str | None, body: str | None) -> str | None:
    """The string at the head of a Python function's body."""
    if not body or detect(path) != "python":
        return None
    start = re.search(r"\b(?:def|class)\b", body)
    if not start:
        return None
    depth, i, n = 0, start.end(), len(body)
    while i < n:  # to the colon that ends the head
        c = body[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c in "\"'":
            end = re.compile(rf"{c}(?:[^{c}\\\n]|\\.)*{c}").match(body, i)
            i = end.end() - 1 if end else i
        elif c == ":" and depth <= 0:
            break
        i += 1
    m = _PY_STRING.match(body, i + 1)
    return next((g for g in m.groups()[1:] if g is not None), None) if m else None


# ------------------------------------------------------------------ informative or trivial

_WORD = re.compile(r"[^\W\d_]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|_|(?<=\D)(?=\d)")
_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|///?!?|//!?|#+'?!?|\*(?!\*)|--+|;+|<!--|\"\"\"|''')\s?|\s*(?:\*+/|-->|\"\"\"|''')\s*$")
#: Directives to tools, which say nothing about a function.
_DIRECTIVE = re.compile(r"(?:pylint:\s*\S+|prettier-ignore|noqa(?::\s*[A-Z]+\d+(?:,\s*[A-Z]+\d+)*)?|nolint:\S+|NOLINT\w*(?:\([^)]*\))?|istanbul ignore \w+|fmt:\s*\w+|yapf:\s*\w+|@ts-\w+|eslint-[\w-]+(?:\s+(?:@?\w+/)?\w+(?:-\w+)+)?|pragma:\s*no cover|type:\s*ignore\S*|clang-format \w+|rustfmt::skip|go:\w+|@formatter:\w+|mypy:\s*\S+|isort:\s*\S+|coverage:\s*ignore|c8 ignore \w+|@suppress\S*)", re.I)
_TODO = re.compile(r"\b(?:TODO|FIXME|XXX|TBD|WIP|HACK)\b(?:\([^)]*\))?(?::\s*(?:rename|document|docs?|write docs?|add docs?|describe|fix|refactor|clean ?up|implement)\b[^.\n]*)?[.:]?", re.I)
_LICENCE = re.compile(r"(?:copyright\b|\(c\)\s*\d{4}|©|licen[sc]ed under|all rights reserved|spdx-license|use of this source (?:code )?is governed)[^\n]*", re.I)
_TAG = re.compile(r"[@\\](?:param|arg|argument|tparam|typeparam)\s+(?:\{[^}]*\}\s*)?(\w+)[ \t]*[-:]?|:param\s+(?:\w+\s+)?(\w+):|[@\\](?:returns?|throws|exception|raises?)\b|:(?:returns?|rtype|raises?)\b[^:\n]*:|[@\\](?:author|since|version|see)\b[^\n]*|[@\\](?:internal|override|deprecated|public|private|protected|api|hidden|inheritdoc|brief|summary)\b|\{@\w+\}|\[\w+\]", re.I)
_ARGS = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|errors|example|examples)\s*:?\s*$|^\s*#+\s*(?:errors|arguments|returns|examples?|panics|safety)\s*$", re.I)
_ARG_LIST = re.compile(r"\b(?:Args|Arguments|Parameters|Params|Inputs)\s*:\s*((?:\w+\s*,\s*)*\w+)\s*\.?\s*$")
_CODE = re.compile(r"^\s*(?:return\s+[\w.]+\(.*\)\s*;?|(?:if|for|while|switch|return|elif|else|try|with)\b[^.!?]*[({:].*|(?:(?:const|let|var|int|auto|final)\s+)?[\w.\[\]]+\s*(?:[-+*/|&]?=|:=)\s*\S.*[;)\]}]?|[\w.]+\([^()]*(?:\([^()]*\)[^()]*)*\)\s*;?|[{}();]+)\s*$")
_RULE = re.compile(r"^[\W_]*$|^\s*([-=~*#+_/.<>|])(?:\s*\1){1,}\s*[^\n]{0,60}?\s*(?:\1\s*){2,}$|^\s*(?:end)?region\b[^\n]{0,60}$|^\s*MARK:[^\n]*$", re.I)
#: Words that carry no behaviour by themselves.
FILLER = frozenset(
    "a an the this that these it its is are be of to for in on with and or from by as at into we you your our function functions func fn method methods helper utility util routine procedure constructor getter setter implementation "
    "wrapper class object instance value values result results return returns returned parameter parameters param params argument arguments arg args input inputs output outputs description docstring documentation doc docs comment comments "
    "placeholder todo fixme tbd wip xxx fill me here goes add write describe summary brief some text stub auto generated override overrides overridden inherit inherited see also none null void self cls used use does do performs perform "
    "given specified current new main internal private public static version since author name type string int integer bool boolean list dict map array str number data item items simple simply just no not yet pending undocumented documented above below later missing".split()
)


def stem(word: str) -> str:
    w = word.lower()
    for end in ("ations", "ation", "ings", "ing", "iers", "ier", "ies", "ied", "ers", "er", "ors", "or", "es", "ed", "s", "y", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def split_words(text: str) -> list[str]:
    return [w for part in re.findall(r"\w+", text) for w in _CAMEL.split(part) if w and not w.isdigit()]


def clean(text: str) -> list[str]:
    """Lines without comment marks."""
    return [_MARKS.sub("", _MARKS.sub("", s)).strip() for s in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]


def tags(text: str) -> list[str]:
    return [a or b for a, b in _TAG.findall(text) if a or b]


def is_trivial(text: str | None, name: str | None, signature: str | None) -> bool:
    """The text, comment marks aside, tells nothing about behaviour beyond name and signature.

    Left aside are rules and banners, directives to tools, licences, open to-dos, tags without a description,
    code that was commented out, and words that repeat the name or the signature.
    """
    if not text or not text.strip():
        return True
    known = {stem(w) for w in split_words(f"{name or ''} {signature or ''}")} | {(name or "").lower()}
    rest = []
    for raw, line in zip(re.split(r"\r\n|\r|\n", text), clean(text)):
        bare = re.sub(r"^\s*(?:/\*+|\*(?!\*)|///?|//|#(?!#))?\s*|\s*(?:\*+/)?\s*$", "", raw)
        if not line or _RULE.match(bare) or _RULE.match(line) or _ARGS.match(line):
            continue
        line = _LICENCE.sub(" ", _DIRECTIVE.sub(" ", line))
        line = _TODO.sub(" ", line).strip()
        if not line or _RULE.match(line) or _CODE.match(line):
            continue
        rest.append(_ARG_LIST.sub(" ", _TAG.sub(" ", line)))
    body = " ".join(rest)
    told = [w for w in split_words(body) if w.lower() not in FILLER and stem(w) not in known]
    far = [w for w in told if ord(w[0]) > 0x24F]
    if far:  # scripts without the filler words
        return sum(map(len, far)) < 4
    return sum(len(w) > 1 for w in told) < 1


# ------------------------------------------------------------------ assignment


def _hungarian(cost: list[list[float]]) -> list[int]:
    """Column of each row in the cheapest complete assignment; rows are at most as many as columns."""
    n, m = len(cost), len(cost[0])
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[j0]:
            used[j0] = True
            i0, delta, j1 = owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    slack = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if slack < least[j]:
                        least[j], way[j] = slack, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def settle(weights: dict[tuple[int, int], float]) -> tuple[dict[int, int], dict[tuple[int, int], float]]:
    """``(links, edges left)``: links that some assignment of greatest weight holds. Such is an edge that weighs as
    much as the best other edges of its function and of its comment together: exchanging these two for it loses
    nothing. Settled ends are taken out, which may settle their neighbours."""
    of_f: dict[int, dict[int, float]] = {}
    of_c: dict[int, dict[int, float]] = {}
    for (f, c), w in weights.items():
        of_f.setdefault(f, {})[c] = w
        of_c.setdefault(c, {})[f] = w
    out, todo = {}, sorted(of_f, reverse=True)
    while todo:
        f = todo.pop()
        edges = of_f.get(f)
        if not edges:
            continue
        c = max(edges, key=lambda c: (edges[c], -c))
        w = edges[c]
        if w < max((x for d, x in edges.items() if d != c), default=0.0) + max((x for g, x in of_c[c].items() if g != f), default=0.0):
            continue
        out[f] = c
        freed = {g for d in edges for g in of_c[d] if g != f} | {g for g in of_c[c] if g != f}
        for d in of_f.pop(f):
            of_c[d].pop(f, None)
        for g in of_c.pop(c):
            of_f[g].pop(c, None)
        todo += sorted(freed & of_f.keys(), reverse=True)
    return out, {(f, c): w for f, edges in of_f.items() for c, w in edges.items()}


def assign(weights: dict[tuple[int, int], float]) -> dict[int, int]:
    """Comment of each function in the assignment of greatest total weight (weights are positive): what
    :func:`settle` leaves open is solved component by component of the graph."""
    out, weights = settle(weights)
    near: dict[tuple[str, int], list[tuple[str, int]]] = {}
    for f, c in weights:
        near.setdefault(("f", f), []).append(("c", c))
        near.setdefault(("c", c), []).append(("f", f))
    seen = set()
    for start in sorted(near):
        if start in seen:
            continue
        part, todo = [], [start]
        seen.add(start)
        while todo:
            x = todo.pop()
            part.append(x)
            for y in near[x]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        fs, cs = sorted(i for k, i in part if k == "f"), sorted(i for k, i in part if k == "c")
        cost = [[-weights.get((f, c), 0.0) for c in cs] + [0.0] * len(fs) for f in fs]  # a function may stay alone at no gain
        for f, j in zip(fs, _hungarian(cost)):
            if j < len(cs) and (f, cs[j]) in weights:
                out[f] = cs[j]
    return out


def graph(rows: list[tuple]) -> tuple[list[tuple], list[int], dict[tuple[int, int], float], set[tuple[int, int]]]:
    """``(comments, functions, weights, plausible and informative edges)`` of one window; an edge is (place in
    functions, place in comments), a comment (row, place, text, line, tags, leading word).

    A comment is linked with its own function, with functions nearby that its tags or its leading word point
    to, and by distance alone with the nearest function below and above; a link by distance alone competes in the
    assignment, but is implausible.
    """
    comments, functions = [], []
    for i, (_, _, _, _, above, head, start, _, yes) in enumerate(rows):
        for where, text in (("above", above), ("head", head)):
            if text and text.strip():
                line = None if start is None else start if where == "above" else start + 2
                comments.append((i, where, text, line, set(tags(text)), leading_word(text)))
        if yes:
            functions.append(i)
    place = {i: f for f, i in enumerate(functions)}
    words = [set(re.findall(r"\w+", rows[i][3] or "")) for i in functions]
    ends: list[tuple[int, int]] = []  # where a comment right above and one right below a function belong
    by_word: dict[str, list[tuple[int, int]]] = {}  # the same by the function's name and parameters
    for f, i in enumerate(functions):
        start, end = rows[i][6], rows[i][7]
        if start is not None:
            at = [(x, f) for x in {start, max(end or start, start) + 2}]
            ends += at
            for w in words[f] | {rows[i][1]}:
                by_word.setdefault(w, []).extend(at)
    for at in (ends, *by_word.values()):
        at.sort()
    weights, plausible = {}, set()

    def edge(f: int, c: int, weight: float) -> None:
        i, text = functions[f], comments[c][2]
        if not is_trivial(text, rows[i][1], rows[i][3]):
            plausible.add((f, c))
            weight += TELLS
        weights[f, c] = weight

    for c, (i, where, text, line, named, led) in enumerate(comments):
        f, name = place.get(i), rows[i][1]
        fits = len(named & (words[f] if f is not None else set(re.findall(r"\w+", rows[i][3] or ""))))
        near: dict[int, int] = {}
        if line is not None:
            k = bisect_left(ends, (line,))
            some = [*ends[max(0, k - 1) : k], *ends[k : k + 2]]
            for w in {*named, led} - {None}:
                at = by_word.get(w, ())
                some += at[bisect_left(at, (line - NEAR,)) : bisect_right(at, (line + NEAR, len(functions)))]
            for x, g in some:
                if g != f and abs(line - x) <= NEAR:
                    near[g] = min(abs(line - x), near.get(g, NEAR))
        pointed = False
        for g, gap in near.items():
            own, match = rows[functions[g]][1], len(named & words[g])
            by_tags, by_name = match and not fits and 2 * match > len(named), led is not None and led == own and own != name and not (name and name in text)
            close = 1 - gap / (NEAR + 1)
            if by_tags or by_name:
                pointed = True
                edge(g, c, close + TAG * min(match, 3) * bool(by_tags) + LED * by_name)
            else:
                weights[g, c] = close
        if f is not None:
            edge(f, c, OWN + CONTRADICTED * pointed + HEAD * (where == "head") + NAMED * bool(name and name in text) + OWN_TAG * min(fits, 4))
    return comments, functions, weights, plausible


def match_window(rows: list[tuple]) -> list[tuple]:
    """``(symbol key, documentation, place, key of the symbol the comment is stored with, its line, weight)`` of the
    functions in one window; rows are (key, name, path, signature, doc_comment, head, start_line, end_line, is
    function). place: above or head, or near for another symbol's comment."""
    comments, functions, weights, plausible = graph(rows)
    got = []
    for f, c in assign(weights).items():
        if (f, c) in plausible:
            owner, where, text, line, _, _ = comments[c]
            i = functions[f]
            got.append((rows[i][0], text, where if owner == i else "near", rows[owner][0], where, line, weights[f, c]))
    return got


def leading_word(text: str) -> str | None:
    """The identifier a comment begins with, comment marks aside."""
    first = next((s for s in clean(text) if s), "")
    m = re.match(r"`?([^\W\d]\w*)`?(?:\(\))?(?=[\s:,.]|$)", first)
    return m.group(1) if m else None


def whole_signature(signature: str | None, body: str | None) -> str:
    """The signature, completed from the body where it is missing or was cut within its brackets."""
    if signature and signature.count("(") <= signature.count(")"):
        return signature
    head, depth, seen = [], 0, False
    for line in (body or "").split("\n"):
        if not head and line.lstrip().startswith("@"):
            continue
        depth += line.count("(") - line.count(")")
        seen = seen or "(" in line
        head.append(line)
        if depth <= 0 and (seen or "{" in line):
            break
    text = " ".join(head)
    close = text.rfind(")") if seen else -1
    brace = text.find("{", max(close, 0))
    return f"{signature or ''} {text[:brace] if brace >= 0 else text}".strip()


def pair_documentation(df: DataFrame, *, key: str = "symbol_id") -> DataFrame:
    """``(key, documentation, place)``: every function or method with a body that has documentation, once.

    place: above or head for its own comment or the head of its body, near for a comment stored with another
    symbol. Needs path, name, kind, signature, doc_comment, body_text, start_line, end_line; other columns are
    ignored. Empty and NULL bodies and trivial documentation give nothing; symbols without lines, or with lines
    below 1, are linked with their own comments only; repeated rows count once. Bodies are not shuffled. Rows
    are grouped by file and window of lines, so a long file is many groups, each read sorted as a stream;
    windows share the lines around their border, and a comment that two windows gave away stays with the
    heavier link.
    """
    kind_of = dict(df.dtypes)[key]
    may = F.col("kind").isNull() | F.col("kind").isin("unknown", *FUNCTION_KINDS)
    some = df.where(F.col(key).isNotNull() & (F.col("doc_comment").rlike(r"\S") | (may & F.col("body_text").rlike(r"\S"))))
    body = F.when(may & F.col("body_text").rlike(r"\S"), F.col("body_text"))
    some = some.select(F.col(key).alias("k"), "name", "kind", "path", "signature", "doc_comment", body.alias("body"), F.col("start_line").cast("long").alias("a"), F.col("end_line").cast("long").alias("b"))

    def narrow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for k, name, kind, path, signature, above, body, a, b in p.itertuples(index=False, name=None):
                yes = body is not None and is_function(kind, path, signature, body)
                head = head_documentation(path, body) if yes else None
                if yes or above and above.strip():
                    rows.append((k, name, path, whole_signature(signature, body) if yes else signature, above, head, a if a > 0 else None, b if b > 0 else None, yes))
            out = pd.DataFrame(rows, columns=["k", "name", "path", "signature", "above", "head", "a", "b", "yes"])
            out[["a", "b"]] = out[["a", "b"]].astype("Int64")
            yield out

    near = some.mapInPandas(narrow, f"k {kind_of}, name string, path string, signature string, above string, head string, a long, b long, yes boolean")
    home = F.floor(F.coalesce("a", F.lit(0)) / WINDOW)
    reach = NEAR + 2
    near = near.withColumn("home", home).withColumn("w", F.explode(F.array_distinct(F.array("home", F.floor(F.greatest(F.coalesce("a", F.lit(0)) - reach, F.lit(0)) / WINDOW), F.floor((F.coalesce("a", F.lit(0)) + reach) / WINDOW)))))

    columns = ["k", "documentation", "place", "owner", "at", "weight"]

    def match(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, group, mine, last = None, [], set(), None

        def done():
            for k, text, place, owner, where, line, weight in match_window(group):
                if k in mine:
                    border = line is not None and min(line % WINDOW, -line % WINDOW) <= reach
                    yield (k, text, place, owner if border else k, where if border else "", weight)

        for p in parts:
            got = []
            for path, w, home, k, name, signature, above, head, a, b, yes in p[["path", "w", "home", "k", "name", "signature", "above", "head", "a", "b", "yes"]].itertuples(index=False, name=None):
                if (path, w) != held:
                    got += done()
                    held, group, mine, last = (path, w), [], set(), None
                if k == last:
                    continue  # repeated rows are neighbours
                last = k
                if home == w:
                    mine.add(k)
                group.append((k, name, path, signature, above, head, None if a != a else int(a), None if b != b else int(b), yes))
            yield pd.DataFrame(got, columns=columns)
        yield pd.DataFrame(list(done()), columns=columns)

    ordered = near.repartition(F.col("path"), F.col("w")).sortWithinPartitions("path", "w", "a", "k")
    found = ordered.mapInPandas(match, f"k {kind_of}, documentation string, place string, owner {kind_of}, at string, weight double")
    once = Window.partitionBy("owner", "at").orderBy(F.col("weight").desc(), "k")
    best = found.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return best.select(F.col("k").alias(key), "documentation", "place")


def pairs_with_code(df: DataFrame, *, key: str = "symbol_id") -> DataFrame:
    """The pairs together with name, path, signature and body_text; one row per function."""
    code = df.dropDuplicates([key]).select(key, "path", "name", "signature", "body_text")
    return pair_documentation(df, key=key).join(code, key).select(key, "path", "name", "signature", "body_text", "documentation", "place")
