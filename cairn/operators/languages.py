"""Declarations of further languages, by patterns and the way their extent ends.

Each language lists (kind, pattern with the name as its last group) and a mode: ``brace`` to the closing
brace, ``end`` to the closing word at the same depth, ``indent`` to the next line that is not indented
deeper, ``paren`` to the closing parenthesis, ``dot`` to the line that ends a clause, ``line`` for the line
alone. Comments and strings are blanked first where the language's comment sign is known.
"""

from __future__ import annotations

import re

_W = r"([^\W\d][\w!?']*)"
_LISP = r"([^\s()\[\]\"]+)"
# Openers and closers of languages whose blocks end with a word.
_END = {
    "ruby": (r"^\s*(?:class|module|def|if|unless|case|while|until|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$", r"^\s*end\b"),
    "lua": (r"\b(?:function|do|then|repeat)\b(?!.*\bend\b)", r"^\s*(?:end|until)\b"),
    "elixir": (r"\bdo\s*$|\bfn\b(?!.*\bend\b)", r"^\s*end\b"),
    "julia": (r"^\s*(?:function|macro|module|struct|mutable\s+struct|if|for|while|let|begin|quote|try|abstract\s+type)\b(?!.*\bend\b)", r"^\s*end\b"),
    "matlab": (r"^\s*(?:function|if|for|while|switch|classdef|methods|properties|parfor|try)\b", r"^\s*end\b"),
    "fortran": (r"(?i)^\s*(?:(?:recursive|pure|elemental|integer|real|logical)\s+)*(?:subroutine|function|module(?!\s+procedure)|program|interface)\b", r"(?i)^\s*end\s*(?:subroutine|function|module|program|interface)\b|^\s*end\s*$"),
    "ada": (r"(?i)\b(?:is|then|loop|record|begin)\s*$|^\s*(?:package|procedure|function)\b.*\bis\b", r"(?i)^\s*end\b"),
    "vhdl": (r"(?i)^\s*(?:entity|architecture|package|process|component)\b.*\bis\b|\bprocess\b", r"(?i)^\s*end\b"),
    "verilog": (r"^\s*(?:module|function|task|package|interface|class)\b", r"^\s*end(?:module|function|task|package|interface|class)\b"),
    "cmake": (r"(?i)^\s*(?:function|macro)\s*\(", r"(?i)^\s*end(?:function|macro)\s*\("),
}
_END["systemverilog"] = _END["verilog"]

_RULES: dict[str, tuple[str, str, list[tuple[str, str]]]] = {
    # language: (mode, comment signs, rules)
    "ruby": ("end", "#", [("class", rf"class\s+(?:\w+::)*{_W}"), ("module", rf"module\s+(?:\w+::)*{_W}"), ("singleton_method", rf"def\s+self\.{_W}"), ("method", rf"def\s+{_W}")]),
    "lua": ("end", "--", [("function_declaration", r"(?:local\s+)?function\s+([\w.:]+)"), ("function_declaration", r"(?:local\s+)?([\w.]+)\s*=\s*function\b")]),
    "elixir": ("end", "#", [("module", r"defmodule\s+([\w.]+)"), ("function", rf"(?:defp?|defmacrop?|defguard)\s+{_W}"), ("protocol_declaration", r"defprotocol\s+([\w.]+)")]),
    "julia": ("end", "#", [("function_definition", r"function\s+([\w.!]+)"), ("struct_definition", rf"(?:mutable\s+)?struct\s+{_W}"), ("module_definition", rf"module\s+{_W}"), ("abstract_definition", rf"abstract\s+type\s+{_W}"), ("macro_definition", rf"macro\s+{_W}")]),
    "matlab": ("end", "%", [("class_definition", rf"classdef\s+{_W}"), ("function_definition", rf"function\s+(?:.*=\s*)?{_W}")]),
    "fortran": ("end", "!", [("module", rf"(?i:module)\s+(?!procedure){_W}"), ("function", rf"(?:[\w()]+\s+)*(?i:function)\s+{_W}"), ("function", rf"(?:\w+\s+)*(?i:subroutine)\s+{_W}"), ("module", rf"(?i:program)\s+{_W}")]),
    "ada": ("end", "--", [("module", r"(?i:package)\s+(?:(?i:body)\s+)?([\w.]+)"), ("function_declaration", rf"(?i:procedure|function)\s+{_W}"), ("type_declaration", rf"(?i:type)\s+{_W}")]),
    "vhdl": ("end", "--", [("module", rf"(?i:entity|package)\s+(?:(?i:body)\s+)?{_W}"), ("module", rf"(?i:architecture)\s+{_W}"), ("function_declaration", rf"(?i:function|procedure)\s+{_W}")]),
    "verilog": ("end", "//", [("module", rf"module\s+{_W}"), ("function_declaration", rf"(?:function|task)\s+(?:automatic\s+)?(?:\[[^\]]*\]\s*|\w+\s+)*?{_W}\s*[;(]"), ("class_declaration", rf"class\s+{_W}"), ("interface_declaration", rf"interface\s+{_W}")]),
    "cmake": ("end", "#", [("function_definition", r"(?i:function|macro)\s*\(\s*(\w+)")]),
    "bash": ("brace", "#", [("function_definition", r"(?:function\s+)?([\w:-]+)\s*\(\)\s*\{?"), ("function_definition", r"function\s+([\w:-]+)\s*\{?")]),
    "powershell": ("brace", "#", [("function_definition", r"(?i:function|filter)\s+([\w:-]+)"), ("class_definition", rf"(?i:class|enum)\s+{_W}")]),
    "r": ("brace", "#", [("function_definition", r"([\w.]+)\s*(?:<-|=)\s*function\b")]),
    "dart": ("brace", "//", [("class_definition", rf"(?:abstract\s+)?(?:class|mixin)\s+{_W}"), ("enum_declaration", rf"enum\s+{_W}"), ("extension_declaration", rf"extension\s+{_W}"), ("function_definition", rf"(?!(?:return|if|for|while|switch|else|new|await|throw|import|export)\b)(?:[\w<>?,\[\]]+\s+)+{_W}\s*\([^;{{}}]*\)\s*(?:async\s*)?[{{=]")]),
    "zig": ("brace", "//", [("function_declaration", rf"(?:pub\s+)?(?:export\s+|inline\s+|extern\s+)?fn\s+{_W}"), ("struct_declaration", rf"(?:pub\s+)?const\s+{_W}\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)\b"), ("const_declaration", rf"(?:pub\s+)?(?:const|var)\s+{_W}")]),
    "odin": ("brace", "//", [("function_declaration", rf"{_W}\s*::\s*(?:#\w+\s+)?proc\b"), ("struct_declaration", rf"{_W}\s*::\s*(?:struct|enum|union)\b")]),
    "d": ("brace", "//", [("class_declaration", rf"(?:\w+\s+)*class\s+{_W}"), ("struct_declaration", rf"(?:\w+\s+)*struct\s+{_W}"), ("interface_declaration", rf"interface\s+{_W}"), ("enum_declaration", rf"enum\s+{_W}"), ("function_declaration", rf"(?!(?:return|if|for|while|foreach|switch|else|import)\b)(?:[\w!\[\]*]+\s+)+{_W}\s*\([^;{{}}]*\)[\w\s@]*\{{")]),
    "solidity": ("brace", "//", [("class_declaration", rf"(?:abstract\s+)?(?:contract|library)\s+{_W}"), ("interface_declaration", rf"interface\s+{_W}"), ("function_definition", rf"(?:function|modifier)\s+{_W}"), ("event_declaration", rf"event\s+{_W}"), ("struct_declaration", rf"struct\s+{_W}"), ("enum_declaration", rf"enum\s+{_W}")]),
    "proto": ("brace", "//", [("struct_declaration", rf"message\s+{_W}"), ("enum_declaration", rf"enum\s+{_W}"), ("interface_declaration", rf"service\s+{_W}"), ("method_declaration", rf"rpc\s+{_W}")]),
    "graphql": ("brace", "#", [("type_declaration", rf"(?:extend\s+)?(?:type|input|union|scalar)\s+{_W}"), ("interface_declaration", rf"interface\s+{_W}"), ("enum_declaration", rf"enum\s+{_W}"), ("function_definition", rf"(?:query|mutation|subscription|fragment)\s+{_W}")]),
    "hcl": ("brace", "#", [("declaration", r"(?:resource|data)\s+\"[^\"]*\"\s+\"([^\"]*)\""), ("declaration", r"(?:variable|output|module|provider)\s+\"([^\"]*)\""), ("declaration", r"(locals|terraform)\s*\{")]),
    "prisma-io": ("brace", "//", [("struct_declaration", rf"(?:model|type|view)\s+{_W}"), ("enum_declaration", rf"enum\s+{_W}"), ("declaration", rf"(?:datasource|generator)\s+{_W}")]),
    "bicep": ("brace", "//", [("declaration", rf"(?:resource|module|param|var|output)\s+{_W}")]),
    "slint": ("brace", "//", [("class_declaration", rf"(?:export\s+)?(?:component|global)\s+{_W}"), ("struct_declaration", rf"(?:export\s+)?struct\s+{_W}")]),
    "llvm": ("brace", ";", [("function_definition", r"define\b[^@]*@([\w.$]+)")]),
    "css": ("brace", "", [("keyframes_statement", r"@keyframes\s+([\w-]+)"), ("media_statement", r"(@media[^{]*?)\s*\{"), ("rule_set", r"([^{};@][^{};]*?)\s*\{")]),
    "nginx": ("brace", "#", [("declaration", r"(server|http|events|upstream\s+\S+|location\s+[^{]+?)\s*\{")]),
    "nix": ("line", "#", [("declaration", r"([\w.-]+)\s*=\s")]),
    "nickel": ("line", "#", [("declaration", r"(?:let\s+)?([\w-]+)\s*(?:\|[^=]*)?=\s")]),
    "haskell": ("indent", "--", [("data_type", r"data\s+([A-Z]\w*)"), ("newtype", r"newtype\s+([A-Z]\w*)"), ("type", r"type\s+([A-Z]\w*)"), ("class", r"class\s+(?:.*=>\s*)?([A-Z]\w*)"), ("function", rf"{_W}\s*::")]),
    "elm": ("indent", "--", [("type_declaration", r"type\s+(?:alias\s+)?([A-Z]\w*)"), ("value_declaration", rf"{_W}\s*:(?!:)")]),
    "agda": ("indent", "--", [("data_type", rf"(?:data|record)\s+{_W}"), ("function", r"([^\s(){};]+)\s+:\s")]),
    "ocaml": ("indent", "", [("value_definition", rf"let\s+(?:rec\s+)?{_W}"), ("type", rf"type\s+(?:'\w+\s+|\([^)]*\)\s+)?{_W}"), ("module_definition", rf"module\s+(?:type\s+)?{_W}"), ("value_declaration", rf"val\s+{_W}")]),
    "fsharp": ("indent", "//", [("value_declaration", rf"let\s+(?:inline\s+|rec\s+|mutable\s+)*{_W}"), ("type_declaration", rf"type\s+{_W}"), ("module", r"module\s+([\w.]+)"), ("method_declaration", rf"(?:static\s+)?member\s+(?:\w+\.)?{_W}")]),
    "commonlisp": ("paren", ";", [("function_definition", rf"\((?i:defun|defmacro|defmethod|defgeneric)\s+{_LISP}"), ("class_definition", rf"\((?i:defclass|defstruct)\s+\(?{_LISP}"), ("var_definition", rf"\((?i:defvar|defparameter|defconstant)\s+{_LISP}")]),
    "clojure": ("paren", ";", [("function_definition", rf"\((?:defn-?|defmacro|defmulti|defmethod)\s+(?:\^\S+\s+)*{_LISP}"), ("type_declaration", rf"\((?:defrecord|deftype|defprotocol)\s+{_LISP}"), ("var_definition", rf"\(def\s+{_LISP}"), ("module", rf"\(ns\s+{_LISP}")]),
    "scheme": ("paren", ";", [("function_definition", rf"\(define(?:-syntax|-record-type)?\s+\(*{_LISP}")]),
    "erlang": ("dot", "%", [("module", r"-module\((\w+)\)"), ("function", r"([a-z]\w*)\([^)]*\)\s*(?:when\b.*)?->")]),
    "prolog": ("dot", "%", [("function", r"([a-z]\w*)\s*\(")]),
    "make": ("indent", "#", [("declaration", r"([\w./%-]+)\s*:(?!=)")]),
    "asm": ("line", ";", [("declaration", r"([\w.$]+):")]),
    "ini": ("section", ";", [("section", r"\[([^\]]+)\]")]),
    "yaml": ("indent", "#", [("declaration", r"([\w.-]+):(?:\s|$)")]),
    "properties": ("line", "#", [("declaration", r"([\w.-]+)\s*[=:]")]),
    "kconfig": ("indent", "#", [("declaration", r"(?:menu)?config\s+(\w+)")]),
    "sparql": ("brace", "#", [("declaration", r"(?i:(select|construct|ask|describe|insert|delete))\b")]),
    "xml": ("line", "", [("element", r"<[\w:.-]+[^>]*\b(?:id|name)=\"([^\"]+)\"")]),
}
_RULES["systemverilog"], _RULES["racket"] = _RULES["verilog"], _RULES["scheme"]
_RULES["objc"] = ("brace", "//", [("class_declaration", rf"@(?:interface|implementation|protocol)\s+{_W}"), ("method_definition", rf"[-+]\s*\([^)]*\)\s*{_W}"), ("function_definition", rf"(?:\w[\w\s*]*?\s)\*?{_W}\s*\([^;{{}}]*\)\s*\{{")])
_COMPILED = {k: (mode, sign, [(kind, re.compile(p)) for kind, p in rules]) for k, (mode, sign, rules) in _RULES.items()}
LANGUAGES = frozenset(_COMPILED)
#: Languages whose grammars know call expressions under that name.
CALLING = frozenset(("zig", "odin", "d", "solidity", "julia", "objc"))
#: Modes and kinds whose declarations stand at the left margin only.
_MARGIN = frozenset(("haskell", "elm", "agda", "ocaml", "erlang", "prolog", "make", "yaml", "asm", "ini", "properties"))


def _blank(language: str, sign: str, content: str) -> str:
    """Comments and strings blanked; lines stay."""
    parts = [r"\"(?:[^\"\\\n]|\\.)*\""] if language not in ("yaml", "ini", "properties", "make", "xml", "hcl") else []
    if language in ("bash", "ruby", "lua", "powershell", "prolog"):
        parts.append(r"'[^'\n]*'")
    if sign:
        parts.append(re.escape(sign) + r"[^\n]*" if language not in ("css", "yaml", "make", "properties", "ini", "kconfig", "bash") else rf"(?:^|(?<=\s)){re.escape(sign)}[^\n]*")
    if sign == "//" or language == "css":
        parts.append(r"/\*.*?\*/")
    return re.sub("|".join(parts), lambda m: re.sub(r"[^\n]", " ", m.group()), content, flags=re.S | re.M) if parts else content


def _end(language: str, mode: str, lines: list[str], i: int, brackets) -> int:
    """Index of a declaration's last line."""
    n = len(lines)
    width = lambda s: len(s) - len(s.lstrip())
    if mode == "line":
        return i
    if mode in ("brace", "paren"):
        opener, closer = brackets
        depth, seen = 0, False
        for j in range(i, n):
            for c in lines[j]:
                if c == opener:
                    depth, seen = depth + 1, True
                elif c == closer:
                    depth -= 1
                    if seen and depth <= 0:
                        return j
                elif c == ";" and not seen and mode == "brace":
                    return j
            if not seen and j > i + 3:
                return i
        return n - 1 if seen else i
    if mode == "end":
        start, stop = _END[language]
        depth = 0
        for j in range(i, n):
            if re.search(stop, lines[j]) and j > i:
                depth -= 1
                if depth <= 0:
                    return j
            elif re.search(start, lines[j]):
                depth += 1
            if j == i and not depth:
                return i
        return n - 1
    if mode == "dot":
        return next((j for j in range(i, n) if lines[j].rstrip().endswith(".")), n - 1)
    if mode == "section":
        return next((j - 1 for j in range(i + 1, n) if lines[j].lstrip().startswith("[")), n - 1)
    last = i
    for j in range(i + 1, n):
        if lines[j].strip():
            if width(lines[j]) <= width(lines[i]):
                break
            last = j
    return last


def scan(language: str, content: str) -> tuple[list[tuple[str, str, int, int, int]], list[str]]:
    """``(name, kind, first line, last line, column)``, lines and columns from 1, in order, and the lines without
    comments and strings."""
    mode, sign, rules = _COMPILED[language]
    lines, out, seen = _blank(language, sign, content).split("\n"), [], set()
    original = content.split("\n")
    for i, text in enumerate(lines):
        indent = len(text) - len(text.lstrip())
        if not text.strip() or (indent and language in _MARGIN):
            continue
        source = original[i][indent:] if language == "hcl" else text[indent:]
        got = next(((kind, m) for kind, p in rules if (m := p.match(source))), None)
        if got is None:
            continue
        name = next(g for g in reversed(got[1].groups()) if g is not None).strip()
        if language in ("erlang", "prolog") and name in seen:
            continue  # further clauses
        seen.add(name)
        last = _end(language, mode, lines, i, "()" if mode == "paren" else "{}")
        out.append((name, got[0], i + 1, last + 1, indent + 1))
    return out, lines
