"""Lexers and grammars of the languages whose syntax is checked.

The grammars are written for this parser: operators are kept flat, because precedence does not decide
validity, and everything between brackets is a group. Where a language leaves room (macros, attributes), any
balanced group is accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from cairn.llm.chart import Grammar

# ---------------------------------------------------------------- lexing


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def _op(*ops: str) -> str:
    return "|".join(re.escape(o) for o in sorted(ops, key=len, reverse=True))


class Lexer:
    """Tokens ``(name, line)`` by one regular expression. Keywords and operators are their own names. A match goes
    on over the blanks behind its token, but not over an indentation that counts (``indents``)."""

    def __init__(self, parts: list[tuple[str, str]], ops: str, keywords: str, id_pattern: str = r"[^\W\d]\w*", kinds: dict[str, str] | None = None, newline=None, indents: bool = False):
        body = "|".join(f"(?P<{n}>{p})" for n, p in parts)
        blanks = "[ \\t\\f\\v\\u00a0\\ufeff]"
        self.pattern = re.compile(f"(?P<blank>{blanks}+)|(?P<nl>\\n){'' if indents else blanks + '*'}|(?:{body}|(?P<id>{id_pattern})|(?P<op>{_op(*ops.split())})|(?P<error>.)){blanks}*", re.S)
        self.keywords, self.kinds, self.newline = {k: k for k in keywords.split()} | (kinds or {}), kinds or {}, newline

    def __call__(self, text: str) -> Iterator[tuple[str, int]]:
        out, line, known, newline, last, pending = [], 1, self.keywords, self.newline, "", 0
        for m in self.pattern.finditer(text):
            kind = m.lastgroup
            if kind == "blank":
                continue
            if kind == "nl":
                pending = line
                line += 1
                continue
            value = m[m.lastindex]
            if kind == "skip":
                if (n := value.count("\n")) and not value.startswith("#"):
                    pending = line
                line += n
                continue
            name = known.get(value, "id") if kind == "id" else value if kind == "op" else kind
            if pending and newline and newline(last, name):
                out.append(("nl", pending))
            pending = 0
            out.append((name, line))
            last = name
            if kind not in ("id", "op"):
                line += value.count("\n")
        if newline and newline(last, ""):
            out.append(("nl", line))
        return out


_C_COMMENT = r"//[^\n]*|/\*(?s:.*?)\*/"
_OPEN_COMMENT = r"/\*(?s:.*)"


# ---------------------------------------------------------------- C

_C_OPS = "( ) [ ] { } ; , . -> ++ -- + - * / % & | ^ ~ ! = == != < > <= >= << >> && || += -= *= /= %= &= |= ^= <<= >>= ? : :: ... #"
_c_lexer = Lexer(
    [("skip", rf"{_C_COMMENT}|(?m:^)[ \t]*#(?:[^\n\\]|\\\n|\\.)*|\\\n"), ("badcomment", _OPEN_COMMENT), ("str", r'(?:L|u8?|U)?"(?:[^"\\\n]|\\.|\\\n)*"'), ("chr", r"(?:L|u8?|U)?'(?:[^'\\\n]|\\.)+'"), ("num", r"\.?\d(?:[eEpP][+-]|[\w.']) *".replace(") *", ")*"))],
    _C_OPS,
    "if else for while do switch case default return break continue goto struct union enum typedef sizeof",
    r"[^\W\d]\w*",
    {k: "qual" for k in "static const extern inline volatile register unsigned signed restrict _Noreturn _Thread_local auto __inline __inline__ __restrict __const constexpr".split()} | {k: "type" for k in "int char void long short float double _Bool bool _Complex".split()},
)

C_RULES = {
    "unary": "'!' | '~' | '-' | '+' | '*' | '&' | '++' | '--' | sizeof | (cast)",
    "primary": "id | num | ( str | chr ) ( str | id )* | (expr) | (cast) {init} | sizeof (cast)",
    "postfix": "(args) | [index] | '.' id | '->' id | '++' | '--'",
    "operand": "unary* primary postfix*",
    "binop": "'+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '&&' | '||' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>='",
    "tern": "operand ~ ( binop | '?' ( operand ~ ( binop | '?' | ':' ) )? ':' )",
    "exprs": "tern ~ ','",
    "tag": "( struct | union | enum ) ( id? ( {fields} | {enumerators} ) | id )",
    "spec": "qual* ( type ( type | qual )* | tag | id | qual+ id? ) qual*",
    "suffix": "[index] | [none] | (params) | (args)",
    "pointer": "( '*' qual* )*",
    "declarator": "pointer ( id | (declarator) ) suffix* ( ':' num )?",
    "abstract": "pointer ( (declarator) )? suffix*",
    "decl": "typedef? spec ( ( declarator ( '=' ( tern | {init} ) )? ) ~ ',' )?",
    "cond": "(expr)",
    "head": "for (for) | while cond | if cond | case tern ( '...' tern )? ':' | default ':' | id ':'",
    "closed": "( exprs | return ( exprs | {init} )? | break | continue | goto id | decl )? ';' | {block} | do ( {block} | exprs ';' ) while cond ';' | switch cond {block} | id (args)",
    "stmt": "( head* closed ) ~ else | ( case tern ( '...' tern )? | default | id ) ':'",
    "block": "stmt*",
    "for": "( exprs | spec ( ( declarator ( '=' ( tern | {init} ) )? ) ~ ',' ) )? ';' exprs? ';' exprs? | spec pointer id ':' exprs",
    "expr": "exprs",
    "args": "( ( tern | cast | {block} ) ~ ',' )?",
    "cast": "spec abstract",
    "index": "exprs",
    "none": "qual*",
    "params": "( ( spec ( declarator | abstract ) ) ~ ',' ( ',' '...' )? | id ~ ',' )?",
    "fields": "( spec ( ( declarator? ( ':' num )? ) ~ ',' )? ';' | id (args) ';'? | ';' )*",
    "enumerators": "( ( id ( '=' tern )? ) ~ ',' ','? )?",
    "init": "( ( ( ( '.' id | [index] )+ '=' | id ':' )? ( tern | {init} ) ) ~ ',' ','? )?",
    "function": "( qual | id (args) )* ( spec pointer )? declarator ( id (args) )? {block}",
    "file": "( decl ';' | function | ';' | qual str ( {file} | decl ';' | function ) | id (args) ';'? )*",
}
_C_CONTENTS = {"(": ["expr", "args", "params", "cast", "for", "declarator"], "[": ["index", "none"], "{": ["block", "init", "fields", "enumerators", "file"]}

# ---------------------------------------------------------------- Java

_JAVA_OPS = "( ) [ ] { } ; , . ... -> :: ++ -- + - * / % & | ^ ~ ! = == != < > <= >= << && || += -= *= /= %= &= |= ^= <<= ? : @"
_JAVA_MODS = "public private protected static final abstract native synchronized transient volatile strictfp default"
_java_lexer = Lexer(
    [("skip", _C_COMMENT), ("badcomment", _OPEN_COMMENT), ("str", r'"""[ \t\f]*\n(?s:(?:[^\\]|\\.)*?)"""|"(?:[^"\\\n]|\\.)*"'), ("chr", r"'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'"), ("num", r"\.?\d(?:[eEpP][+-]|[\w.])*")],
    _JAVA_OPS,
    "if else for while do switch case default return break continue throw try catch finally new instanceof class interface enum extends implements import package throws this super assert synchronized",
    r"[^\W\d][\w$]*|\$[\w$]*",
    {k: "mod" for k in "public private protected static final abstract native transient volatile strictfp".split()} | {k: "prim" for k in "int char void long short float double boolean byte".split()} | {k: "id" for k in "true false null".split()},
)


def _collapse(before: str, inside: str, braces: bool = False):
    """Replaces balanced ``< ... >`` at the beginning of a level or behind ``before`` tokens (and braced groups)
    by one token ``generic``, inner ones first."""

    def run(grammar: Grammar, text: str) -> str:
        lt, gt = grammar.char("<"), grammar.char(">")
        if lt not in text:
            return text
        made = grammar.__dict__.setdefault("_collapse", {})
        if made.get("key") != len(grammar.groups):
            inner = "".join(grammar.char(t) for t in inside.split()) + "".join(grammar.groups)
            first = "".join(grammar.char(t) for t in before.split()) + "".join(c for c, (o, _) in grammar.groups.items() if braces and o == "{")
            made["key"], made["re"] = len(grammar.groups), re.compile(f"(?:(?<=[{first}])|^){lt}[{inner}]*{gt}")
        generic = grammar.char("generic")
        while True:
            new = made["re"].sub(generic, text)
            if new == text:
                return text
            text = new

    return run


_java_collapse = _collapse("id mod . :: new , ; ) }", "id , . ? & extends super prim generic @ mod", braces=True)

JAVA_RULES = {
    "qname": "id ~ '.'",
    "annotation": "'@' qname ( (args) )?",
    "mods": "( mod | annotation | default | synchronized )*",
    "dims": "( [none] | annotation )*",
    "type": "annotation* ( prim | ( annotation* id generic? ) ~ '.' ) dims",
    "created": "new annotation* ( prim | ( id generic? ) ~ '.' ) ( (args) ( {members} )? | ( [index] | [none] )+ ( {array} )? )",
    "lambda": "( id | (names) | (params) ) '->'",
    "primary": "id generic? | num | str | chr | this | super | (expr) | created | prim dims ( '.' class )? | switch (expr) {cases}",
    "postfix": "(args) | [index] | '.' generic? ( id | class | this | super | created ) | '::' ( id | new ) | '++' | '--' | [none]",
    "binop": "'+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '&&' | '||' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>='",
    "operand": "( '!' | '~' | '-' | '+' | '++' | '--' | (cast) | lambda )* ( primary postfix* | lambda {block} ) ( instanceof mod? type ( id | (pattern) )? )?",
    "tern": "operand ~ ( binop | '?' ( operand ~ ( binop | '?' | ':' ) ) ':' )",
    "terns": "tern ~ ','",
    "varinit": "id dims ( '=' ( tern | {array} ) )?",
    "local": "mods type ( varinit ~ ',' )",
    "head": "for (for) | while (expr) | if (expr) | case terns ':' | default ':' | id ':'",
    "trystmt": "try ( (resources) )? {block} ( catch (catch) {block} )* ( finally {block} )?",
    "closed": "( ( return | throw | id )? tern | local | return | break id? | continue id? | assert tern ( ':' tern )? )? ';' | {block} | trystmt | switch (expr) ( {cases} | {block} ) | synchronized (expr) {block} | do ( {block} | tern ';' ) while (expr) ';' | typedecl",
    "stmt": "( head* closed ) ~ else | ( case terns | default ) ':'",
    "block": "stmt*",
    "cases": "( ( case terns | default ) '->' ( throw? tern ';' | {block} ) | stmt )*",
    "for": "( local | terns )? ';' tern? ';' terns? | mods type id ':' tern",
    "expr": "tern",
    "args": "( ( ( id '=' )? ( tern | {array} | annotation ) ) ~ ',' )?",
    "cast": "type ~ '&'",
    "pattern": "( ( mods type id ) ~ ',' )?",
    "names": "( id ~ ',' )?",
    "params": "( ( mods type '...'? ( id | this ) dims ) ~ ',' )?",
    "resources": "( local | tern ) ~ ';' ';'?",
    "catch": "mods ( type ~ '|' ) id",
    "index": "tern",
    "none": "",
    "array": "( ( tern | {array} | annotation ) ~ ',' )? ','?",
    "types": "type ~ ','",
    "method": "mods generic? annotation* type? id (params) dims ( throws types )? ( {block} | default ( tern | {array} ) ';' | ';' )",
    "field": "local ';'",
    "typedecl": "mods ( ( class | interface ) id generic? ( ( extends | implements | id ) types )* {members} | enum id ( implements types )? {enum} | '@' interface id {members} | id id generic? (params) ( implements types )? {members} )",
    "member": "method | field | typedecl | mods id? {block} | ';'",
    "members": "member*",
    "enum": "( ( annotation* id ( (args) )? ( {members} )? ) ~ ',' )? ','? ( ';' member* )?",
    "file": "( annotation* package qname ';' )? ( import mod? id ( '.' ( id | '*' ) )* ';' | ';' )* ( typedecl | ';' )*",
}
_JAVA_CONTENTS = {"(": ["expr", "args", "params", "cast", "for", "names", "resources", "catch", "pattern"], "[": ["index", "none"], "{": ["block", "members", "cases", "array", "enum"]}

# ---------------------------------------------------------------- JavaScript and TypeScript

_TS_KEYWORDS = "if else for while do switch case default return break continue throw try catch finally new instanceof class extends import export function var const typeof void delete in this super async await yield let of enum interface"


def _ts_newline(last: str, following: str) -> bool:
    """Where a line end closes a statement: the line could end there and the next one cannot go on."""
    ends = last in ("id", "num", "str", "tpl", "rx", ")", "]", "}", "this", "super", "return", "break", "continue", "++", "--", "of", "async", "let", "enum", "interface", "generic", ">", "default", "yield", "await", "!", "void", "typeof", "in")
    goes_on = following in (".", "?.", ",", ")", "]", "?", ":", "*", "/", "%", "=", "<", ">", "==", "===", "!=", "!==", "&&", "||", "??", "|", "&", "^", "=>", "(", "[", "+", "-", "instanceof", "in", "else", "catch", "finally", ";", "+=", "-=", "*=", "/=", "<=", ">=", "**", "tpl") and following != "["
    if last in ("!", "void", "typeof", "in"):
        return False
    return ends and not goes_on


class _TsLexer:
    """Adds what a regular expression can't: regular expression literals, nested templates."""

    def __init__(self):
        self.inner = Lexer([("skip", rf"{_C_COMMENT}|\A#![^\n]*"), ("badcomment", _OPEN_COMMENT), ("str", r'"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\''), ("num", r"(?:0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?")], "( ) [ ] { } ; , . ... ?. => ++ -- + - * ** / % & | ^ ~ ! = == === != !== < > <= >= << && || ?? += -= *= **= /= %= &= |= ^= <<= &&= ||= ??= ? : @ #", _TS_KEYWORDS, r"#?[^\W\d][\w$]*|#?\$[\w$]*|\\u[0-9a-fA-F]{4}\w*", newline=_ts_newline)
        self.regex = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
        self.template = re.compile(r"[^`\\$]+|\\[\s\S]|\$(?!\{)")

    def _template_end(self, text: str, at: int) -> int:
        while at < len(text):
            if m := self.template.match(text, at):
                at = m.end()
            elif text[at] == "`":
                return at + 1
            else:  # ${ ... }
                depth, at = 1, at + 2
                while at < len(text) and depth:
                    c = text[at]
                    if c == "`":
                        at = self._template_end(text, at + 1)
                        if at < 0:
                            return -1
                        continue
                    if c in "'\"" and (m := re.compile(rf"{c}(?:[^{c}\\\n]|\\.)*{c}").match(text, at)):
                        at = m.end()
                        continue
                    depth += (c == "{") - (c == "}")
                    at += 1
        return -1

    def __call__(self, text: str):
        out, line, at, last, pending = [], 1, 0, "", 0
        pattern, known = self.inner.pattern, self.inner.keywords
        before_regex = {"", "(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "return", "typeof", "case", "in", "of", "do", "else", "+", "-", "*", "%", "<", ">", "<=", ">=", "==", "===", "!=", "!==", "&&", "||", "??", "throw", "new", "delete", "void", "+=", "await", "yield", "...", "~", "^", "-=", "nl"}
        n = len(text)
        while at < n:
            c = text[at]
            if c == "`":
                end = self._template_end(text, at + 1)
                name, stop = ("tpl", end) if end > 0 else ("error", n)
            elif c == "/" and last in before_regex and (m := self.regex.match(text, at)):
                name, stop = "rx", m.end()
            else:
                m = pattern.match(text, at)
                kind, stop = m.lastgroup, m.end()
                if kind == "blank":
                    at = stop
                    continue
                if kind == "nl":
                    pending = line
                    line += 1
                    at = stop
                    continue
                if kind == "skip":
                    if k := text.count("\n", at, stop):
                        pending = line
                        line += k
                    at = stop
                    continue
                value = m[m.lastindex]
                name = known.get(value, "id") if kind == "id" else value if kind == "op" else kind
            if (pending or name == "}") and _ts_newline(last, name):
                out.append(("nl", pending or line))
            pending = 0
            out.append((name, line))
            last = name
            line += text.count("\n", at, stop)
            at = stop
        if _ts_newline(last, ""):
            out.append(("nl", line))
        return out


_ts_collapse = _collapse("id function class . new ) import interface generic", "id , . ? & | extends num str generic tpl typeof void this in => = [ ] : super const")

TS_RULES = {
    "name": "id | of | async | let | enum | interface | await | yield",
    "anyname": "name | this | if | else | for | while | do | switch | case | default | return | break | continue | throw | try | catch | finally | new | instanceof | class | extends | import | export | function | var | const | typeof | void | delete | in | super",
    "decorator": "'@' id ( '.' anyname )* ( (args) )?",
    "tatom": "( id | this | void | '-'? num | str | tpl | await | async | of | new | const | function ) ( '.' anyname )* generic? | {tmembers} | [types] | ( generic? | new ) (params) '=>' | (types) | import (args) ( '.' anyname )* generic?",
    "tone": "( id | typeof )* tatom [types]* ( id tatom )?",
    "type": "( '|' | '&' )? ( tone ~ ( '|' | '&' | extends | '?' | ':' | in )? )",
    "ann": "':' type",
    "fn": "async? function '*'? name? generic? (params) ann? {block}",
    "arrow": "async? ( name | generic? (params) ann? ) '=>'",
    "base": "name generic? ( (args) | [index] | '.' anyname generic? )*",
    "classhead": "class name? generic? ( extends base )? ( id types )? {members}",
    "primary": "name generic? | num | str | tpl | rx | this | super | (expr) | [array] | {object} | fn | classhead | import ( (args) | '.' id ) | new '.' id",
    "postfix": "(args) | [index] | '.' anyname generic? | '?.' ( anyname generic? | (args) | [index] ) | '++' | '--' | tpl | '!' | generic (args)",
    "binop": "'+' | '-' | '*' | '**' | '/' | '%' | '&' | '|' | '^' | '==' | '===' | '!=' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '&&' | '||' | '??' | '=' | '+=' | '-=' | '*=' | '**=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '&&=' | '||=' | '??=' | in | instanceof",
    "unary": "'!' | '~' | '-' | '+' | '++' | '--' | typeof | void | delete | await | new | yield '*'? | generic | '<' id '>' | arrow",
    "operand": "unary* ( primary postfix* | arrow {block} | yield ) ( id ( tone ~ ( '|' | '&' ) ) )*",
    "tern": "operand ~ ( binop | '?' ( operand ~ ( binop | '?' | ':' ) ) ':' )",
    "exprs": "tern ~ ','",
    "binding": "( name | [array] | {object} ) '!'? ann? ( '=' tern )?",
    "vars": "( const | let | var ) ( binding ~ ',' )",
    "end": "';' | nl",
    "fndecl": "async? function '*'? name? generic? (params) ann? ( {block} | end )",
    "simple": "exprs | vars | ( return | throw ) exprs | return | ( break | continue ) id? | id id generic? '=' type | import id? ( str | ( id ','? )? ( {names} | '*' id id )? id str | id ) | import id '=' base",
    "declx": "fndecl | decorator* nl? id? classhead | interface id generic? ( extends types )? {tmembers} | const? enum id {enum} | id ( str | id ~ '.' ) {file} | id {file}",
    "exportx": "export default? ( id? {names} ( id str )? end | '*' ( id name )? id str end | '=' exprs end )",
    "head": "for await? (for) | while (expr) | if (expr) nl? | ( case exprs | default | id ) ':' nl? | export default? id?",
    "closed": "simple? end | {block} nl? | try {block} nl? ( catch ( (params) )? {block} nl? )? ( finally {block} nl? )? | switch (expr) {block} nl? | do ( {block} nl? | exprs end ) while (expr) end? | id? declx nl? | exportx",
    "stmt": "( head* closed ) ~ else | ( case exprs | default ) ':' nl?",
    "block": "stmt*",
    "for": "( vars | exprs )? ';' exprs? ';' exprs? | ( const | let | var )? binding ( of | in ) exprs",
    "expr": "exprs",
    "args": "( ( '...'? tern ) ~ ',' ','? )?",
    "params": "( ( decorator* id* '...'? ( name | this | [array] | {object} ) '?'? ann? ( '=' tern )? ) ~ ',' ','? )?",
    "index": "exprs",
    "array": "','* ( ( '...'? tern ) ~ ( ',' ','* ) ','* )?",
    "key": "anyname | str | num | [index]",
    "object": "( ( key ( ':' tern )? ( '=' tern )? | '...' tern | ( async | id )* '*'? key generic? (params) ann? {block} ) ~ ( ',' ) ','? )? nl?",
    "members": "( decorator nl? | id* async? '*'? id* key ( '?' | '!' )? ( generic? (params) ann? ( {block} | ';' | nl ) | ann? ( '=' tern )? ( ';' | nl ) ) | ';' | nl | id {block} | id* [types] ann ( ';' | nl ) )*",
    "tmember": "new? id* '-'? ( key | [types] )? '-'? '?'? generic? ( (params) )? ann?",
    "tmembers": "( tmember ~ ( ';' | ',' | nl ) )?",
    "types": "( ( '...'? ( id ':' )? type '?'? ) ~ ',' ','? )?",
    "names": "( ( id? ( anyname | str ) ( id anyname )? ) ~ ',' ','? )? nl?",
    "enum": "( ( ( id | str ) ( '=' tern )? ) ~ ',' ','? )? nl?",
    "file": "block",
}
_TS_CONTENTS = {"(": ["expr", "args", "params", "for", "types"], "[": ["index", "array", "types"], "{": ["block", "object", "members", "tmembers", "names", "enum", "file"]}

# ---------------------------------------------------------------- Go


def _go_newline(last: str, following: str) -> bool:
    return last in ("id", "num", "str", "chr", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}")


class _GoLexer:
    """A line end is a semicolon; so is a missing one before a closing brace, but not in literals."""

    def __init__(self, inner: Lexer):
        self.inner = inner

    def __call__(self, text: str):
        out, last, stack = [], ("", 0), []
        for token in self.inner(text):
            name = token[0]
            if name in ("}", ")") and stack and stack[-1] and _go_newline(last[0], name) and last[0] != "nl":
                out.append(("vnl", token[1]))
            if name in ("(", "[", "{"):
                words = name == "(" and last[0] in ("import", "var", "const", "type")
                stack.append(words or name == "{" and _go_block(out))
            elif name in ("}", ")", "]") and stack:
                stack.pop()
            out.append(token)
            last = token
        return out


def _go_block(out: list) -> bool:
    """A brace after a statement's header, a result or a type keyword opens a block; behind a type it opens a literal."""
    k, seen = len(out) - 1, ""
    while k >= 0 and out[k][0] not in ("nl", ";", "{", "}"):
        if out[k][0] in ("if", "for", "switch", "select", "func", "struct", "interface", "else"):
            return True
        k -= 1
    return k < 0 or k == len(out) - 1 or out[k][0] == ";" and any(t[0] in ("if", "for", "switch") for t in out[max(0, k - 40) : k])


_go_inner = Lexer(
    [("skip", _C_COMMENT), ("badcomment", _OPEN_COMMENT), ("str", r'"(?:[^"\\\n]|\\.)*"|`[^`]*`'), ("chr", r"'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))'"), ("num", r"\.?\d(?:[eEpP][+-]|[\w.])*")],
    "( ) [ ] { } ; , . ... := <- ++ -- + - * / % & | ^ &^ ! = == != < > <= >= << >> && || += -= *= /= %= &= |= ^= <<= >>= &^= : ~",
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    newline=_go_newline,
)
_go_lexer = _GoLexer(_go_inner)
GO_RULES = {
    "qid": "id ( '.' id )? ( [types] )?",
    "typepre": "'*' | [length] | map [types] | chan '<-'? | '<-' chan",
    "named": "qid | struct {fields} | interface {methods}",
    "ty": "typepre* ( named | func (params) result? | (types) )",
    "result": "typepre* named | (params) | typepre* func (params)",
    "unary": "'+' | '-' | '!' | '^' | '*' | '&' | '<-'",
    "fntype": "func (params) result?",
    "primary": "id | num | str | chr | (expr) | (types) | fntype {block} | typepre+ ( named | fntype ) ( {lit} | (args) ) | ( struct {fields} | interface {methods} | fntype ) ( {lit} | (args) )",
    "plainpost": "(args) | [index] | '.' id | '.' (types) | '.' (typeword)",
    "operand": "unary* primary ( plainpost | {lit} )*",
    "plain": "unary* ( id | num | str | chr | (expr) | (types) | fntype {block} | typepre+ named ( {lit} | (args) ) ) plainpost*",
    "binop": "'+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&^' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '&&' | '||'",
    "flat": "operand ~ binop",
    "pflat": "plain ~ binop",
    "exprs": "flat ~ ','",
    "assignop": "'=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='",
    "simple": "exprs ( assignop exprs | '++' | '--' | '<-' flat )?",
    "psimple": "( pflat ~ ',' ) ( assignop ( ( range? pflat ) ~ ',' ) | '++' | '--' )?",
    "end": "';' | nl | vnl",
    "vardecl": "( id ~ ',' ) ( ty ( '=' exprs )? | '=' exprs )",
    "constdecl": "( id ~ ',' ) ( ty? '=' exprs )?",
    "typedecl": "id ( [tparams] )? '='? ty",
    "decl": "var ( vardecl | (vars) ) | const ( constdecl | (consts) ) | type ( typedecl | (typedecls) )",
    "header": "( if | for | switch | select ) ( psimple? ';' ( psimple? ( ';' psimple? )? ) | psimple | range pflat )? ( {block} | {cases} )",
    "plainstmt": "simple | decl | return exprs? | ( break | continue ) id? | goto id | fallthrough | ( go | defer ) flat | header ( else header )* ( else {block} )? | {block}",
    "stmt": "( id ':' nl? )* plainstmt? end",
    "block": "stmt*",
    "cases": "( ( case ( simple | ty ~ ',' ) | default ) ':' nl? | stmt )*",
    "expr": "exprs | ty",
    "args": "( ( flat | ty ) ~ ',' '...'? ','? )?",
    "params": "( ( ( id ~ ',' )? '...'? ty ) ~ ',' ','? )?",
    "types": "( ty ~ ( ',' | '|' ) ','? )?",
    "typeword": "type",
    "tparams": "( ( id ~ ',' ) ( ( '~'? ty ) ~ '|' ) ) ~ ','",
    "length": "( flat | '...' )?",
    "index": "exprs | ty ~ ',' | flat? ':' flat? ( ':' flat )?",
    "lit": "( ( ( flat | {lit} ) ~ ':' ) ~ ',' ','? )? vnl?",
    "fields": "( ( ( id ~ ',' ) ty | '*'? qid ) str? end )*",
    "methods": "( ( id (params) result? | ( '~'? ty ) ~ '|' ) end )*",
    "vars": "( vardecl end )*",
    "consts": "( constdecl end )*",
    "typedecls": "( typedecl end )*",
    "importspec": "( id | '.' )? str",
    "imports": "( importspec end )*",
    "funcdecl": "func ( (params) )? id ( [tparams] )? (params) result? ( {block} )?",
    "file": "end* package id end ( import ( importspec | (imports) ) end )* ( ( decl | funcdecl ) end | ';' )*",
}
_GO_CONTENTS = {"(": ["args", "params", "expr", "types", "imports", "vars", "consts", "typedecls", "typeword"], "[": ["index", "length", "types", "tparams"], "{": ["block", "lit", "fields", "methods", "cases"]}

# ---------------------------------------------------------------- Rust

_rust_inner = Lexer(
    [("skip", r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?s:.*?)\*/)*\*/|\A#![^\n\[][^\n]*"), ("badcomment", _OPEN_COMMENT), ("str", r'[bc]?r(#*)"(?s:.*?)"\2|[bc]?"(?:[^"\\]|\\[\s\S])*"'.replace(r"\2", r"(?P=hash)").replace("(#*)", "(?P<hash>#*)")), ("chr", r"b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.))'"), ("life", r"'[^\W\d]\w*(?!')"), ("num", r"\d(?:[eE][+-](?=\d)|\w|\.(?=\d))*(?:\.(?![.\w]))?")],
    "( ) [ ] { } ; , . .. ... ..= :: : -> => # $ ? @ ! != == = <= >= < > + - * / % ^ & | && || += -= *= /= %= ^= &= |= << <<= ~",
    "as break const continue crate else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type unsafe use where while dyn async await yield",
    r"(?:r#)?[^\W\d]\w*",
)
class _RustLexer:
    """Contents of macro calls, macro definitions and attributes are token trees: balanced, but free."""

    def __init__(self, inner: Lexer):
        self.inner = inner

    def __call__(self, text: str):
        tokens, out, i = self.inner(text), [], 0
        while i < len(tokens):
            name, line = tokens[i]
            out.append(tokens[i])
            i += 1
            if name not in ("(", "[", "{"):
                continue
            back = [t[0] for t in out[-4:-1]]
            if back[-2:] == ["id", "!"] or back == ["id", "!", "id"] or back[-1:] == ["#"] or back[-2:] == ["#", "!"]:
                stack, j = [name], i
                while j < len(tokens) and stack:
                    t = tokens[j][0]
                    if t in ("(", "[", "{"):
                        stack.append(t)
                    elif t in (")", "]", "}"):
                        if {")": "(", "]": "[", "}": "{"}[t] != stack.pop():
                            break
                    elif t in ("error", "badcomment"):
                        break
                    j += 1
                if not stack:
                    out += [("opaque", line), tokens[j - 1]]
                    i = j
        return out


_rust_lexer = _RustLexer(_rust_inner)
_rust_collapse = _collapse("id :: fn impl for", "id life , :: & && * mut dyn impl -> = + ? ! for generic num const : as chr - crate . str fn unsafe extern")

RUST_RULES = {
    "attr": "'#' '!'? [tt]",
    "attrs": "attr*",
    "vis": "( pub ( (types) | (visin) )? | crate )?",
    "seg": "( id | crate ) generic? ( (types) ( '->' tone0 )? )? | generic",
    "path": "'::'? ( seg ~ '::' )",
    "ppath": "'::'? ( ( id | crate | generic ) generic? ) ~ '::'",
    "tpre": "'&' life? mut? | '&&' life? mut? | '*' ( const | mut ) | dyn | impl | for generic",
    "tone0": "tpre* ( ppath | (types) | [array] | '!' )",
    "tone": "tpre* ( path ( '!' ( (tt) | [tt] | {tt} ) )? | (types) | [array] | '!' | unsafe? ( extern str? )? fn (params) ( '->' tone0 )? )",
    "bound": "'?'? ( life | ( for generic )? tone )",
    "ty": "tone ( '+' bound )*",
    "bounds": "( bound ~ '+' )? '+'?",
    "literal": "num | str | chr",
    "pone": "( '&' mut? | '&&' mut? | ref | mut | id '@' | '-' )* ( literal | ppath ( (pats) | {fields} | '!' (tt) )? | (pats) | [pats] | '..' | {block} ) ( ( '..=' | '...' | '..' ) ( '-'? ( literal | ppath ) )? )? | ( '..=' | '..' ) '-'? ( literal | ppath )",
    "pat": "'|'? ( pone ~ '|' )",
    "macro": "ppath '!' ( (tt) | [tt] | {tt} )",
    "closure": "async? move? ( '||' | '|' ( ( attrs pone ( ':' tone )? ) ~ ',' ','? )? '|' ) ( '->' tone0 )?",
    "unary": "'-' | '!' | '*' | '&' mut? | '&&' mut? | '&' id ( const | mut ) | closure",
    "postfix": "(args) | [index] | '.' ( id ( '::' generic )? | num | await ) | '?' | as tone0",
    "binop": "'+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '>' '>=' | '..' | '..='",
    "cond": "( ( let pat '=' )? ( '..' | '..=' )? unary* ( literal | ppath | macro | (expr) | [array] ) postfix* ( '..' )? ) ~ binop",
    "blockx": "( life ':' )? ( ( ( if | while | match | for pat in ) ( cond | match cond {arms} ) | loop | unsafe | async move? | const )? ( {block} | {arms} ) ) ~ else",
    "jump": "return | ( break | continue ) life? | yield",
    "operand": "( unary | jump )* ( ( literal | ppath ( {init} )? | macro | (expr) | [array] | blockx ) postfix* | jump | '..' ) '..'? ",
    "flat": "'..='? ( operand ~ binop )",
    "expr": "attrs flat",
    "letstmt": "let pat ( ':' ty )? ( '=' flat ( else {block} )? )? ';'",
    "block": "attr* ( ';' | attrs letstmt | attrs flat ';' | attrs blockx postfix* | item | macro )* ( attrs flat )?",
    "arms": "attr* ( attrs pat ( if cond )? '=>' ( flat ',' | blockx ','? ) )* ( attrs pat ( if cond )? '=>' flat )?",
    "args": "( ( attrs flat ) ~ ',' ','? )?",
    "array": "( ( attrs flat ) ~ ',' ','? | ( flat | ty ) ';' flat | ty )?",
    "index": "flat",
    "pats": "( ( attrs pat ) ~ ',' ','? )?",
    "fields": "( ( attrs ( ( id | num ) ':' pat | ref? mut? id | '..' ) ) ~ ',' ','? )?",
    "init": "( ( attrs ( ( id | num ) ( ':' flat )? | '..' flat? ) ) ~ ',' ','? )?",
    "types": "( ty ~ ',' ','? )?",
    "params": "( ( attrs ( pat ':' ( ty | '...' ) | ( '&' life? )? mut? id ( ':' ty )? | ty | '...' ) ) ~ ',' ','? )?",
    "wherex": "where ( ( ( life | ( for generic )? tone ) ':' bounds ) ~ ',' ','? )?",
    "fnitem": "( const | async | unsafe | extern str? )* fn id generic? (params) ( '->' ty )? wherex? ( {block} | ';' )",
    "sfields": "( ( attrs vis id ':' ty ) ~ ',' ','? )?",
    "tfields": "( ( attrs vis ty ) ~ ',' ','? )?",
    "structitem": "struct id generic? ( wherex? {sfields} | ( (tfields) )? wherex? ';' )",
    "variants": "( ( attrs vis id ( {sfields} | (tfields) )? ( '=' flat )? ) ~ ',' ','? )?",
    "implitem": "unsafe? impl generic? ( '!'? tone for )? tone wherex? {items}",
    "traititem": "unsafe? trait id generic? ( ':' bounds )? wherex? {items}",
    "typeitem": "type id generic? ( ':' bounds )? wherex? ( '=' ty )? wherex? ';'",
    "constitem": "( const | static mut? ) id ':' ty ( '=' flat )? ';'",
    "tree": "'::'? ( ( ( id | crate ) ~ '::' ) ( '::' ( '*' | {uses} ) )? | '*' | {uses} ) ( as id )?",
    "uses": "( tree ~ ',' ','? )?",
    "item": "attrs vis ( fnitem | structitem | enum id generic? wherex? {variants} | implitem | traititem | typeitem | constitem | use tree ';' | unsafe? mod id ( {file} | ';' ) | unsafe? extern ( crate id ( as id )? ';' | str? {items} ) | id id generic? {sfields} ) | attrs id '!' id {tt}",
    "items": "attr* ( item | macro ';'? )*",
    "visin": "in path",
    "tt": "opaque?",
    "file": "items",
}
_RUST_CONTENTS = {"(": ["tt", "visin", "expr", "args", "params", "types", "pats", "tfields"], "[": ["tt", "array", "index", "pats"], "{": ["tt", "block", "init", "arms", "fields", "sfields", "variants", "items", "uses", "file"]}

# ---------------------------------------------------------------- JSON (strictly)

_json_lexer = Lexer([("str", r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"'), ("num", r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])")], "( ) { } [ ] , :", "", kinds={k: "word" for k in ("true", "false", "null")})
JSON_RULES = {
    "value": "str | num | word | {object} | [array]",
    "object": "( str ':' value ( ',' str ':' value )* )?",
    "array": "( value ( ',' value )* )?",
    "none": "error",
    "file": "value",
}
_JSON_CONTENTS = {"{": ["object"], "[": ["array"], "(": ["none"]}

# ---------------------------------------------------------------- Python

_PY_KEYWORDS = "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"


class _PyLexer:
    """A logical line is a group ``<l| ... l|>``, an indented block a group ``<| ... >|``."""

    def __init__(self):
        prefix = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"
        self.inner = Lexer([("skip", r"#[^\n]*|\\\n"), ("str", rf'{prefix}(?:"""(?:[^\\]|\\[\s\S])*?"""|\'\'\'(?:[^\\]|\\[\s\S])*?\'\'\'|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\')'), ("num", r"(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])|0(?:_?0)*(?![\d.])|[1-9](?:_?\d)*)(?!\d)")], "( ) [ ] { } ; , . ... := -> + - * ** / // % @ & | ^ ~ = == != < > <= >= << >> += -= *= **= /= //= %= @= &= |= ^= <<= >>= :", _PY_KEYWORDS, indents=True)

    def __call__(self, text: str):
        pattern, known = self.inner.pattern, self.inner.keywords
        out, line, depth, indents, fresh, width = [], 1, 0, [0], True, 0
        for m in pattern.finditer(text):
            kind = m.lastgroup
            if kind == "blank":
                if fresh and not depth:
                    for c in m.group():
                        width = (width // 8 + 1) * 8 if c == "\t" else 0 if c in "\f﻿" else width + 1
                continue
            if kind == "nl":
                if not depth and not fresh:
                    out.append(("l|>", line))
                if not depth:
                    fresh, width = True, 0
                line += 1
                continue
            value = m[m.lastindex]
            if kind == "skip":
                line += value.count("\n")
                continue
            if fresh and not depth:
                fresh = False
                if width > indents[-1]:
                    indents.append(width)
                    out.append(("<|", line))
                else:
                    while width < indents[-1]:
                        indents.pop()
                        out.append((">|", line))
                    if width != indents[-1]:
                        out.append(("error", line))
                out.append(("<l|", line))
            name = known.get(value, "id") if kind == "id" else value if kind == "op" else "num" if value == "..." and (not out or out[-1][0] not in ("from", "dots", ".")) else "dots" if value == "..." else kind
            if kind == "op":
                depth += (value in "([{") - (value in ")]}")
                depth = max(0, depth)
            elif kind == "num" and text[m.end(kind) : m.end(kind) + 1].isidentifier() and not re.match(r"(?:and|else|for|if|in|is|or|not)\b", text[m.end(kind) : m.end(kind) + 5]):
                name = "error"
            out.append((name, line))
            if kind not in ("id", "op"):
                line += value.count("\n")
        if depth:
            return out
        if not fresh:
            out.append(("l|>", line))
        return out + [(">|", line)] * (len(indents) - 1)


PY_RULES = {
    "trailer": "'.' id | (args) | [subscript]",
    "atom": "id | num | str+ | (tuple) | [list] | {dict}",
    "lambdahead": "lambda ( ( id ( '=' ( ( not | '-' | '+' | '~' )* atom trailer* ) ~ binop )? | '*' id? | '**' id | '/' ) ~ ',' ','? )? ':'",
    "operand": "( not | '-' | '+' | '~' | await | lambdahead )* atom trailer*",
    "binop": "'+' | '-' | '*' | '**' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' | '==' | '!=' | '<' | '>' | '<=' | '>=' | and | or | in | not in | in | is | is not",
    "disj": "operand ~ binop",
    "expr": "operand ~ ( binop | if ( operand ~ binop ) else )",
    "named": "( id ':=' )? expr",
    "exprlist": "( '*'? expr ) ~ ',' ','?",
    "yieldx": "yield ( from expr | exprlist )?",
    "rhs": "exprlist | yieldx",
    "targetatom": "await? ( id | (tuple) | [list] | atom trailer* ( '.' id | [subscript] ) )",
    "targets": "( '*'? targetatom ) ~ ',' ','?",
    "augop": "'+=' | '-=' | '*=' | '**=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>='",
    "dotted": "id ~ '.'",
    "nameas": "id ( as id )?",
    "simple": "( targets '=' )* rhs | targetatom ( augop rhs | ':' expr ( '=' rhs )? ) | return exprlist? | raise ( expr ( from expr )? )? | pass | break | continue | del exprlist | assert expr ( ',' expr )? | ( global | nonlocal ) ( id ~ ',' ) | import ( ( dotted ( as id )? ) ~ ',' ) | from ( '.' | dots )* dotted? import ( '*' | (imports) | nameas ~ ',' ) | id id ( [subscript] )? '=' expr",
    "line": "simple ~ ';' ';'?",
    "iftail": "named ':'",
    "if": "if iftail", "elif": "elif iftail", "else": "else ':'", "while": "while iftail", "try": "try ':'", "finally": "finally ':'",
    "lfor": "async? for targets in exprlist ':'",
    "for": "lfor", "lexcept": "except '*'? ( expr ( as id | ( ',' expr )+ )? )? ':'",
    "except": "lexcept", "lwith": "async? with ( ( expr ( as targetatom )? ) ~ ',' | (items) ) ':'",
    "with": "lwith", "ldef": "async? def id ( [subscript] )? (params) ( '->' expr )? ':'",
    "def": "ldef", "class": "lclass", "lclass": "class id ( [subscript] )? ( (args) )? ':'",
    "match": "id exprlist ':'",
    "case": "id ( ( '*'? ( '-'? num | ( id | str+ ) ( '.' id )* ( (args) )? | (args) | [list] | {dict} ) ) ~ ( '|' | as | ',' | '+' | '-' ) ) ','? ( if named )? ':'",
    "decorator": "'@' named",
    "one": "if iftail line", "onelif": "elif iftail line", "onelse": "else ':' line", "oneloop": "( while iftail | lfor ) line", "onetry": "try ':' line", "onexcept": "lexcept line", "onefinally": "finally ':' line", "onedef": "( ldef | lclass ) line", "onewith": "lwith line",
    "elses": "( <else> <block> | <onelse> )",
    "excepts": "( <except> <block> | <onexcept> )",
    "ends": "( <finally> <block> | <onefinally> )",
    "stmt": "<line> | ( <if> <block> | <one> ) ( <elif> <block> | <onelif> )* elses? | ( ( <while> | <for> ) <block> | <oneloop> ) elses? | ( <try> <block> | <onetry> ) ( excepts+ elses? ends? | ends ) | <with> <block> | <onewith> | <decorator>* ( ( <def> | <class> ) <block> | <onedef> ) | <match> <cases>",
    "block": "stmt+",
    "onecase": "case line",
    "cases": "( <case> <block> | <onecase> )+",
    "compfor": "( async? for targets in disj ( if ( operand ~ ( binop | if ( operand ~ binop ) else ) ) )* )+",
    "tuple": "( ( '*' disj | named ) ~ ',' ','? | named compfor | yieldx )?",
    "args": "( ( named compfor? | id '=' expr | '*' expr | '**' expr | named as id | named ( '|' named )+ ) ~ ',' ','? )?",
    "params": "( ( id ( ':' '*'? expr )? ( '=' expr )? | '*' ( id ( ':' '*'? expr )? )? | '**' id ( ':' expr )? | '/' ) ~ ',' ','? )?",
    "imports": "nameas ~ ',' ','?",
    "items": "( expr ( as targetatom )? ) ~ ',' ','?",
    "list": "( ( '*' disj | named ) ~ ',' ','? | named compfor )?",
    "subscript": "( expr? ':' expr? ( ':' expr? )? | named | '*' disj ) ~ ',' ','?",
    "dict": "( ( expr ':' expr | '**' disj ) ~ ',' ','? | expr ':' expr compfor | ( '*' disj | named ) ~ ',' ','? | named compfor )?",
    "file": "stmt*",
}
_PY_CONTENTS = {"(": ["tuple", "args", "params", "imports", "items"], "[": ["list", "subscript"], "{": ["dict"], "<|": ["block", "cases"], "<l|": ["line", "if", "elif", "else", "while", "for", "try", "except", "finally", "with", "def", "class", "decorator", "match", "case", "one", "onelif", "onelse", "oneloop", "onetry", "onexcept", "onefinally", "onedef", "onewith", "onecase"]}

_SPECS = {
    "c": (_c_lexer, C_RULES, _C_CONTENTS, None),
    "java": (_java_lexer, JAVA_RULES, _JAVA_CONTENTS, _java_collapse),
    "typescript": (_TsLexer(), TS_RULES, _TS_CONTENTS, _ts_collapse),
    "go": (_go_lexer, GO_RULES, _GO_CONTENTS, None),
    "rust": (_rust_lexer, RUST_RULES, _RUST_CONTENTS, _rust_collapse),
    "json": (_json_lexer, JSON_RULES, _JSON_CONTENTS, None),
    "python": (_PyLexer(), PY_RULES, _PY_CONTENTS, None),
}
_KEYWORDS = {k: frozenset(getattr(getattr(v[0], "inner", v[0]), "keywords").values()) for k, v in _SPECS.items()}
_made: dict[str, tuple] = {}


def grammar_of(language: str):
    """``(lexer, grammar)``, built once per process; None for languages without one."""
    if language not in _SPECS:
        return None
    if language not in _made:
        lexer, rules, contents, collapse = _SPECS[language]
        _made[language] = (lexer, Grammar(rules, contents, "file", collapse, _KEYWORDS[language]))
    return _made[language]
