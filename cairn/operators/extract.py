"""Extraction: one file to its symbols and calls.

Languages are covered in tiers: documentation and TOML natively (``sections``), HTML with its scripts and
styles by the standard parser, Python by its syntax tree, and the brace languages by a scanner that knows
strings and comments, finds declarations by patterns and their extent by brackets. Further languages are
scanned by the patterns and block ends of ``languages``, and those of ``scanners`` by line. The rest yields
one symbol for the whole file. Symbol kinds follow the vocabulary of the languages' grammars.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.language import base_name, detect
from cairn.operators.languages import CALLING, LANGUAGES, scan
from cairn.operators.scanners import enclosing, outline

SYMBOL = "name string, kind string, parent_context string, signature string, doc_comment string, body_text string, start_line long, start_col long, end_line long, end_col long"
SCHEMA = f"struct<language:string,symbols:array<struct<{SYMBOL.replace(' ', ':').replace(',:', ',')}>>,calls:array<struct<from_name:string,to_name:string,from_line:long>>,error:string>"
SIGNATURE, IMPORT_SIGNATURE, COMMENT = 80, 100, 80


def clip(text: str, n: int) -> str:
    """Cut after n characters if the text has more than n bytes."""
    return text if len(text.encode()) <= n else text[:n] + "..."


def symbol(name, kind, start, end, lines, *, parent=None, signature=None, doc=None, cols=(1, 1), body=True) -> dict:
    return {"name": name, "kind": kind, "parent_context": parent, "signature": signature, "doc_comment": doc, "body_text": "\n".join(lines[start - 1 : end]) if body else None, "start_line": start, "start_col": cols[0], "end_line": end, "end_col": cols[1]}


#: Documentation lines by how they begin: their signs, which may be repeated, and what is told behind them.
_DOC_LINE = re.compile(r"(?:///)+(?://!)*(?P<line>.*)|(?://!)+(?P<inner>.*)|(?:(?:/\*\*)+|(?:/\*!)+|(?=\* ))\**(?P<block>.*)|\*{1,2}/(?P<close>)$|(?:# )+(?:#')*(?P<hash>.*)|(?:#')+(?P<quote>.*)")


def comment_above(lines: list[str], start: int) -> str | None:
    """Documentation directly above line ``start``, joined by spaces in source order: lines of ``///``, ``//!``,
    ``# `` and ``#'``, and blocks of ``/**`` or ``/*!`` whose lines begin with a star. A line of a block that also
    closes one is the last."""
    got = []
    for i in range(start - 2, -1, -1):
        m = _DOC_LINE.match(lines[i].strip())
        if not m:
            break
        if m.lastgroup != "close":
            got.append(m.group(m.lastgroup).strip())
        if m.lastgroup == "block" and "*/" in lines[i]:
            break
    return " ".join(reversed(got)) if got else None


def import_name(statement: str, last_segment: bool = False) -> str:
    """The word behind the first one, or the last segment of a path of ``::``."""
    if last_segment:
        return statement.rsplit("::", 1)[-1].rstrip(";").strip()
    words = statement.split(None, 2)
    return words[1] if len(words) > 1 else statement


# ---------------------------------------------------------------- Python

_PY_KINDS = {ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition"}


def parse_python(content: str) -> tuple[list[dict], list[dict], str | None]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [], [], f"{type(e).__name__}: {str(e)[:200]}"
    lines, out, calls = content.split("\n"), [], []

    def visit(node, parents: list[str], owner: str | None):
        for child in ast.iter_child_nodes(node):
            kind, inside, own = _PY_KINDS.get(type(child)), parents, owner
            if kind:
                out.append(symbol(child.name, kind, child.lineno, child.end_lineno, lines, parent=" > ".join(parents) or None, signature=clip(lines[child.lineno - 1].strip(), SIGNATURE), doc=comment_above(lines, min([child.lineno, *[d.lineno for d in child.decorator_list]])), cols=(child.col_offset + 1, child.end_col_offset + 1)))
                if isinstance(child, ast.ClassDef):
                    inside = [*parents, f"class:{child.name}"]
                else:
                    own = child.name
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                out.append(symbol(import_name("\n".join(lines[child.lineno - 1 : child.end_lineno])), "import", child.lineno, child.end_lineno, lines, signature=clip(lines[child.lineno - 1].strip(), IMPORT_SIGNATURE), cols=(child.col_offset + 1, child.end_col_offset + 1)))
            elif isinstance(child, ast.Call) and owner:
                name = ast.unparse(child.func) if isinstance(child.func, (ast.Name, ast.Attribute)) else None
                if name and name != owner:
                    calls.append({"from_name": owner, "to_name": name, "from_line": child.lineno})
            visit(child, inside, own)

    visit(tree, [], None)
    out.sort(key=lambda s: (s["start_line"], s["start_col"]))
    return out, calls, None


# ---------------------------------------------------------------- brace languages

_WORD = r"[^\W\d]\w*"
_BRACE = {
    "rust": [("function_item", rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+({_WORD})"), ("struct_item", rf"(?:pub(?:\([^)]*\))?\s+)?struct\s+({_WORD})"), ("enum_item", rf"(?:pub(?:\([^)]*\))?\s+)?enum\s+({_WORD})"), ("trait_item", rf"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+({_WORD})"), ("impl_item", rf"(?:unsafe\s+)?impl(?:\s*<[^{{]*?>)?\s+(?:[\w:<>, &']+\s+for\s+)?({_WORD})"), ("mod_item", rf"(?:pub\s+)?mod\s+({_WORD})"), ("type_item", rf"(?:pub\s+)?type\s+({_WORD})"), ("const_item", rf"(?:pub(?:\([^)]*\))?\s+)?const\s+({_WORD})\s*:"), ("static_item", rf"(?:pub\s+)?static\s+(?:mut\s+)?({_WORD})"), ("macro_definition", rf"macro_rules!\s*({_WORD})"), ("import", r"(?:pub\s+)?use\s+([\w:]+)")],
    "go": [("method_declaration", rf"func\s*\([^)]*\)\s*({_WORD})"), ("function_declaration", rf"func\s+({_WORD})"), ("type_declaration", rf"type\s+({_WORD})"), ("const_declaration", rf"const\s+({_WORD})"), ("var_declaration", rf"var\s+({_WORD})"), ("import", r"import\s*\(?\s*(?:[\w.]+\s+)?\"?([\w./-]*)")],
    "java": [("import", r"import\s+(?:static\s+)?([\w.*]+)"), ("interface_declaration", rf"(?:[\w@]+\s+)*interface\s+({_WORD})"), ("enum_declaration", rf"(?:[\w@]+\s+)*enum\s+({_WORD})"), ("record_declaration", rf"(?:[\w@]+\s+)*record\s+({_WORD})\s*\("), ("class_declaration", rf"(?:[\w@]+\s+)*class\s+({_WORD})"), ("method_declaration", rf"(?!(?:return|new|throw|else|if|for|while|switch|catch|try|do|case|synchronized|super|this)\b)(?:[\w.<>\[\],?@&]+\s+)+({_WORD})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?\s*[{{;]"), ("constructor_declaration", rf"(?:(?:public|private|protected)\s+)({_WORD})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?\s*{{")],
    "c": [("struct_specifier", rf"(?:typedef\s+)?struct\s+({_WORD})\s*{{"), ("enum_specifier", rf"(?:typedef\s+)?enum\s+({_WORD})\s*{{"), ("function_definition", rf"(?!(?:return|else|if|for|while|switch|do|case|typedef|goto|sizeof)\b)(?:{_WORD}[\s*]+)+({_WORD})\s*\([^;{{}}]*\)\s*{{")],
    "typescript": [("import", r"import\s+(?:type\s+)?(?:\{\s*)?([\w$*]+|[\"'][^\"']+[\"'])"), ("class_declaration", rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_WORD})"), ("interface_declaration", rf"(?:export\s+)?(?:declare\s+)?interface\s+({_WORD})"), ("enum_declaration", rf"(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+({_WORD})"), ("type_alias_declaration", rf"(?:export\s+)?(?:declare\s+)?type\s+({_WORD})"), ("function_declaration", rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*({_WORD})"), ("lexical_declaration", r"(?:export\s+)?(?:const|let|var)\s+([\w$]+)"), ("method_definition", r"(?!(?:if|for|while|switch|catch|return|function|new|do|else|super)\b)(?:(?:public|private|protected|static|async|get|set|override|readonly|abstract)\s+)*\*?([#\w$]+)\s*(?:<[^>{}]*>)?\([^;{}]*\)\s*(?::[^{;=]+)?\{")],
}
_BRACE["tsx"] = _BRACE["typescript"]
_BRACE["cpp"] = [("class_specifier", rf"class\s+({_WORD})[^;{{]*{{"), ("namespace_definition", rf"namespace\s+({_WORD})\s*{{"), *_BRACE["c"]]
_BRACE["c-sharp"] = [("namespace_declaration", r"namespace\s+([\w.]+)"), ("struct_declaration", rf"(?:[\w@]+\s+)*struct\s+({_WORD})"), *[x for x in _BRACE["java"] if x[0] != "import"]]
_BRACE["swift"] = [(k, rf"(?:(?:public|private|internal|open|fileprivate|static|final|override)\s+)*{w}\s+({_WORD})") for k, w in (("function_declaration", "func"), ("class_declaration", "(?:class|struct|enum|actor|extension)"), ("protocol_declaration", "protocol"), ("typealias_declaration", "typealias"))]
_BRACE["php"] = [(k, rf"(?:(?:public|private|protected|static|final|abstract)\s+)*{w}\s+({_WORD})") for k, w in (("function_definition", "function"), ("class_declaration", "class"), ("interface_declaration", "interface"), ("trait_declaration", "trait"))]
_BRACE["scala"] = [(k, rf"(?:(?:private|protected|final|sealed|case|implicit|override|abstract|lazy)\s+)*{w}\s+({_WORD})") for k, w in (("function_definition", "def"), ("class_definition", "class"), ("object_definition", "object"), ("trait_definition", "trait"), ("val_definition", "val"))]
for _extra in ("cuda", "objc", "glsl", "hlsl"):
    _BRACE[_extra] = _BRACE["c"]
_COMPILED = {lang: [(k, re.compile(p)) for k, p in rules] for lang, rules in _BRACE.items()}
#: Kinds that contain others, and their short names.
CONTAINERS = {"class_declaration": "class", "class_definition": "class", "class_specifier": "class", "struct_item": "struct", "struct_specifier": "struct", "struct_declaration": "struct", "enum_item": "enum", "enum_declaration": "enum", "enum_specifier": "enum", "trait_item": "trait", "trait_declaration": "trait", "trait_definition": "trait", "impl_item": "impl", "interface_declaration": "interface", "protocol_declaration": "protocol", "mod_item": "module", "object_definition": "object", "record_declaration": "record", "namespace_declaration": "namespace_declaration", "namespace_definition": "namespace_definition"}
_FUNCTIONS = frozenset("function_item function_declaration function_definition method_declaration method_definition constructor_declaration".split())
_MASK = re.compile(r"//[^\n]*|/\*.*?\*/|r(#*)\".*?\"\1|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|`(?:[^`\\]|\\.)*`", re.S)
_ARROW = re.compile(r"[^;]*?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^={]+)?=>|[\w$]+\s*=>)")
_CALL = re.compile(r"(?<![\w.$])([A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)\s*\(")
_NOT_CALLS = frozenset("if for while switch catch return function fn func match loop sizeof super new await do else throw in of typeof".split())


def _masked(content: str) -> str:
    """Comments and strings blanked, so brackets and words in them don't count; lines stay."""
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), content)


#: Lines without an open bracket that a declaration's head may take up to its name; within brackets there is no bound.
HEAD_LINES = 16


def _head_ends(code: str, starts: list[int]) -> list[int]:
    """Per line where the head of a declaration that begins on it ends at the latest: behind HEAD_LINES lines on
    its own level of round and square brackets. One pass from the last line up."""
    n, depth, level = len(starts), 0, []
    for a, b in zip(starts, [*starts[1:], len(code) + 1]):
        level.append(depth)
        line = code[a:b]
        depth += line.count("(") + line.count("[") - line.count(")") - line.count("]")
    out, open_lines = [len(code)] * n, []  # per level the lines behind, nearest last
    for i in range(n - 1, -1, -1):
        while open_lines and open_lines[-1][0] > level[i]:
            open_lines.pop()
        if not open_lines or open_lines[-1][0] < level[i]:
            open_lines.append((level[i], []))
        behind = open_lines[-1][1]
        if len(behind) >= HEAD_LINES:
            out[i] = starts[behind[-HEAD_LINES]]
        behind.append(i)
    return out


class _Open:
    """Declarations by their lines, asked for in rising order of lines: those that are open where one begins."""

    def __init__(self, kinds):
        self.kinds, self.some = kinds, []

    def at(self, line: int) -> list[tuple[int, int, dict]]:
        self.some = [x for x in self.some if x[1] >= line]
        return self.some

    def add(self, declaration: tuple[int, int, dict]) -> None:
        if declaration[2]["kind"] in self.kinds:
            self.some.append(declaration)


def calls_in(masked: list[str], found: list[tuple[int, int, dict]]) -> list[dict]:
    """Calls by the innermost function they stand in; calls outside functions and of the function itself are none."""
    calls, owners, k = [], _Open(_FUNCTIONS), 0
    for n, text in enumerate(masked, 1):
        while k < len(found) and found[k][0] <= n:
            owners.add(found[k])
            k += 1
        if "(" not in text:
            continue
        owner = owners.at(n)
        for m in _CALL.finditer(text) if owner else ():
            if m.group(1) not in _NOT_CALLS and owner[-1][2]["name"] != m.group(1):
                calls.append({"from_name": owner[-1][2]["name"], "to_name": m.group(1), "from_line": n})
    return calls


def parse_braces(language: str, content: str) -> tuple[list[dict], list[dict], str | None]:
    code = _masked(content)
    starts = [0, *[m.end() for m in re.finditer("\n", code)]]
    lines, masked = content.split("\n"), code.split("\n")
    found: list[tuple[int, int, dict]] = []
    line, head_ends = 1, _head_ends(code, starts)
    while line <= len(masked):
        text = masked[line - 1]
        indent = len(text) - len(text.lstrip())
        at, until = starts[line - 1] + indent, head_ends[line - 1]
        got = next(((k, m) for k, p in _COMPILED[language] if (m := p.match(code, at, until))), None) if text.strip() else None
        if not got:
            line += 1
            continue
        kind, m = got
        end = _extent(code, at + len(m.group().rstrip("{;")), kind)
        last = bisect_right(starts, end)
        name = import_name(content[at:end], language == "rust") if kind == "import" else m.group(1)
        limit = IMPORT_SIGNATURE if kind == "import" else SIGNATURE
        found.append((line, last, symbol(name, kind, line, last, lines, signature=clip(lines[line - 1].strip(), limit), doc=None if kind == "import" else comment_above(lines, line), cols=(len(lines[line - 1][:indent].encode()) + 1, end - starts[last - 1] + 1))))
        if kind == "lexical_declaration" and _ARROW.match(code, at, until):
            found.append((line, last, found[-1][2] | {"kind": "function_declaration"}))
        line = last + 1 if kind == "import" else bisect_right(starts, m.start(1)) + 1
    out, containers, functions = [], _Open(CONTAINERS), _Open(_FUNCTIONS)
    for a, b, s in found:
        s["parent_context"] = " > ".join(f"{CONTAINERS[p['kind']]}:{p['name']}" for x, y, p in containers.at(a) if x < a and y >= b) or None
        inner = any(x < a and y >= b for x, y, _ in functions.at(a))
        if not (inner and s["kind"] in ("lexical_declaration", "var_declaration", "const_declaration", "method_definition")):
            out.append(s)
        containers.add((a, b, s))
        functions.add((a, b, s))
    return out, calls_in(masked, found), None


def _extent(code: str, at: int, kind: str) -> int:
    """End of a declaration: the bracket that closes its first brace, or its semicolon or line."""
    depth = 0
    for i in range(at, len(code)):
        c = code[i]
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if depth <= 0 and c == "}":
                return i + 1 if depth == 0 else i
            if depth < 0:
                return i
        elif depth == 0 and (c == ";" or (c == "\n" and kind in ("import", "type_declaration", "const_declaration", "var_declaration", "type_alias_declaration", "lexical_declaration") and not code[at:i].rstrip().endswith(("=", "(", ",")))):
            return i + (c == ";")
    return len(code)


# ---------------------------------------------------------------- outlines without a grammar


def parse_fallback(language: str, path: str, content: str, whole_words: bool = False) -> list[dict]:
    """The spans of ``scanners``; where there are none, one symbol for the whole file."""
    lines = content.split("\n")[:-1] if content.endswith("\n") else content.split("\n")
    found = enclosing(outline(language, lines, whole_words)) or [((base_name(path), "file", 0, max(0, len(lines) - 1)), None)]
    out = []
    for (name, kind, a, b), parent in found:
        first, last = (lines[a] if a < len(lines) else ""), (lines[b] if b < len(lines) else "")
        context = f"{parent[1]}:{parent[0]}" if parent else None
        out.append(symbol(name, kind, a + 1, b + 1, lines, parent=context, signature=first.strip() or None, cols=(len(first.encode()) - len(first.lstrip().encode()) + 1, len(last.encode()) + 1), body=b > a))
    return out


def parse_scanned(language: str, content: str) -> tuple[list[dict], list[dict]]:
    """Symbols of the languages in ``languages``, with the enclosing ones as context, and calls where the
    language's grammar has call expressions."""
    lines, found, around = content.split("\n"), [], []
    got, masked = scan(language, content)
    for name, kind, a, b, col in got:
        around = [x for x in around if x[1] >= a]
        parents = [f"{CONTAINERS.get(q, q)}:{n}" for x, y, q, n in around if x < a and y >= b]
        found.append((a, b, symbol(name, kind, a, b, lines, parent=" > ".join(parents) or None, signature=clip(lines[a - 1].strip(), SIGNATURE), doc=comment_above(lines, a), cols=(col, len(lines[b - 1].encode()) + 1))))
        around.append((a, b, kind, name))
    return [s for _, _, s in found], calls_in(masked, found) if language in CALLING else []


# ---------------------------------------------------------------- HTML


class _Html(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self, content: str):
        super().__init__(convert_charrefs=False)
        self.lines, self.out, self.calls, self.open, self.raw = content.split("\n"), [], [], [], None

    def _add(self, name, kind, start, cols=(1, 1), **more):
        self.out.append(symbol(name, kind, start, start, self.lines, cols=cols, **more))
        return self.out[-1]

    def handle_starttag(self, tag, attrs):
        line, col = self.getpos()
        a, made = dict(attrs), None
        if a.get("id"):
            made = self._add(a["id"], "element", line, (col + 1, 1), signature=clip(self.get_starttag_text() or "", SIGNATURE))
        elif a.get("class"):
            made = self._add(f"{tag}.{a['class']}", "element", line, (col + 1, 1), signature=clip(self.get_starttag_text() or "", SIGNATURE))
        if tag not in self.VOID:
            self.open.append((tag, made))
        if tag in ("script", "style"):
            self.raw = tag

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        line, col = self.getpos()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                made = self.open[k][1]
                if made:
                    made |= {"end_line": line, "end_col": col + len(tag) + 4, "body_text": "\n".join(self.lines[made["start_line"] - 1 : line])}
                del self.open[k:]
                break
        self.raw = None

    def handle_comment(self, data):
        line, col = self.getpos()
        text = data.strip()
        if text:
            s = self._add(clip(text.split("\n")[0].strip(), COMMENT), "section", line, (col + 1, 1))
            s["end_line"] = line + data.count("\n")

    def handle_data(self, data):
        if self.raw and data.strip():
            line, _ = self.getpos()
            (self._script if self.raw == "script" else self._style)(data, line - 1)

    def _shift(self, found, offset, parent):
        for s in found:
            s["start_line"] += offset
            s["end_line"] += offset
            s["parent_context"] = f"{parent} > {s['parent_context']}" if s["parent_context"] else parent
            if s["kind"] == "import":
                s["doc_comment"] = None
            self.out.append(s)

    def _script(self, data, offset):
        symbols, calls, _ = parse_braces("typescript", data)
        self._shift(symbols, offset, "script")
        self.calls += [c | {"from_line": c["from_line"] + offset} for c in calls]
        for m in re.finditer(r"//([^\n]*)|/\*(.*?)\*/", data, re.S):
            text = (m.group(1) or m.group(2) or "").strip(" *\n\t")
            if text.strip("-= \t"):
                n = data.count("\n", 0, m.start()) + 1 + offset
                self._add(clip(text.split("\n")[0], COMMENT), "section", n, parent="script")

    def _style(self, data, offset):
        for m in re.finditer(r"([^{}]+)\{([^{}]*)\}", re.sub(r"/\*.*?\*/", lambda c: re.sub(r"[^\n]", " ", c.group()), data, flags=re.S)):
            lead = len(m.group(1)) - len(m.group(1).lstrip())
            a = data.count("\n", 0, m.start() + lead) + 1 + offset
            b = data.count("\n", 0, m.end()) + 1 + offset
            name = " ".join(m.group(1).split())
            s = self._add(name, "keyframes_statement" if name.startswith("@keyframes") else "media_statement" if name.startswith("@media") else "rule_set", a, parent="style")
            s |= {"end_line": b, "body_text": "\n".join(self.lines[a - 1 : b])}


def parse_html(content: str) -> tuple[list[dict], list[dict]]:
    """Elements, comments, scripts and styles, and the calls of the scripts."""
    p = _Html(content)
    p.feed(content)
    p.close()
    return sorted(p.out, key=lambda s: (s["start_line"], s["start_col"])), p.calls


# ---------------------------------------------------------------- dispatch


def parse_file(path: str | None, content: str | None, whole_words: bool = False) -> dict:
    """``language, symbols, calls, error`` of one file. Unknown languages and NULL content are errors."""
    language = detect(path)
    none = {"language": language, "symbols": [], "calls": [], "error": None}
    if language is None:
        return none | {"error": f"unknown language: {path}"}
    if content is None:
        return none | {"error": "no content"}
    text = content.replace("\r\n", "\n")
    if language == "python":
        symbols, calls, error = parse_python(text)
    elif language == "html":
        (symbols, calls), error = parse_html(text), None
    elif language in _COMPILED:
        symbols, calls, error = parse_braces(language, text)
    elif language in LANGUAGES:
        (symbols, calls), error = parse_scanned(language, text), None
    else:
        symbols, calls, error = parse_fallback(language, path, text, whole_words), [], None
    return {"language": language, "symbols": symbols, "calls": calls, "error": error}


def parse_udf(whole_words: bool = False):
    @F.pandas_udf(SCHEMA)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for paths, contents in parts:
            yield pd.DataFrame([parse_file(p, c, whole_words) for p, c in zip(paths, contents)], columns=["language", "symbols", "calls", "error"])

    return run


def parse(files: DataFrame, path: str = "path", content: str = "content", whole_words: bool = False) -> DataFrame:
    """``files`` with ``parsed``."""
    return files.withColumn("parsed", parse_udf(whole_words)(F.col(path), F.col(content)))


def symbols_of(parsed: DataFrame, path: str = "path") -> DataFrame:
    return parsed.select(F.col(path).alias("path"), F.posexplode("parsed.symbols").alias("ordinal", "s")).select("path", F.col("ordinal").cast("long").alias("ordinal"), "s.*")


def calls_of(parsed: DataFrame, path: str = "path") -> DataFrame:
    return parsed.select(F.col(path).alias("path"), F.explode("parsed.calls").alias("c")).select("path", "c.*")
