"""Text functions as Column builders: identifier words, query tokens, path names, boosts, lines.

Everything is built from native expressions, so it stays in the JVM. NULL input gives NULL unless said
otherwise; lengths are in characters, or in UTF-8 bytes where a name says so.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that query tokens leave out, and words that full-text terms leave out.
TOKEN_STOPWORDS = ("the", "and", "for", "with")
TERM_STOPWORDS = ("the", "and", "for", "with", "this", "that", "does", "how", "what", "where", "when", "which", "code", "file")
MAX_TERMS, SPLIT_BYTES = 12, 400

NOT_WORD = r"[^\p{L}\p{N}]+"
CAMEL = r"(?<=[^\p{Lu}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def runs(text: Column) -> Column:
    """Maximal runs of letters and digits, in order."""
    return F.filter(F.split(text, NOT_WORD), lambda r: r != "")


def split_camel_run(run: Column) -> Column:
    """Cut before a capital that follows a non-capital, or that begins a capitalised word."""
    return F.split(run, CAMEL)


def identifier_words(identifier: Column) -> Column:
    """Lower-case words of at least two characters, distinct, in order of appearance."""
    words = F.flatten(F.transform(runs(identifier), lambda r: F.transform(split_camel_run(r), F.lower)))
    return F.array_distinct(F.filter(words, lambda w: F.char_length(w) >= 2))


def identifier_word_string(identifier: Column) -> Column:
    """The words joined, NULL where they add nothing to the identifier."""
    w = identifier_words(identifier)
    return F.when((F.size(w) > 1) | ((F.size(w) == 1) & (F.get(w, F.lit(0)) != F.lower(identifier))), F.array_join(w, " "))


def body_split_words(text: Column, max_bytes: int = SPLIT_BYTES) -> Column:
    """Words of the runs that have an inner capital, distinct; stops before the first word beyond ``max_bytes``."""
    inner = F.filter(runs(text), lambda r: r.rlike(CAMEL))
    words = F.array_distinct(F.flatten(F.transform(inner, identifier_words)))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def add(acc: Column, w: Column) -> Column:
        longer = F.when(acc["out"] == "", w).otherwise(F.concat(acc["out"], F.lit(" "), w))
        full = acc["full"] | (F.octet_length(longer) > max_bytes)
        return F.struct(F.when(full, acc["out"]).otherwise(longer).alias("out"), full.alias("full"))

    return F.aggregate(words, start, add, lambda acc: acc["out"])


def query_tokens(query: Column) -> Column:
    """Lower-case tokens of at least three bytes without stop words. Repeated words stay repeated."""
    return F.filter(F.transform(runs(query), F.lower), lambda t: (F.octet_length(t) >= 3) & ~t.isin(*TOKEN_STOPWORDS))


def match_terms(query: Column) -> Column:
    """Full-text terms: runs of letters, digits and ``_ - .``, trimmed, at least two characters, at most twelve
    distinct ones. Stop words go, except inside identifiers. A term that holds separators is a phrase."""
    trimmed = F.transform(F.split(query, r"[^\p{L}\p{N}_.-]+"), lambda r: F.regexp_replace(r, r"^[_.-]+|[_.-]+$", ""))
    kept = F.filter(trimmed, lambda r: (F.char_length(r) >= 2) & (r.rlike("[_.-]") | ~F.lower(r).isin(*TERM_STOPWORDS)))
    return F.slice(F.array_distinct(kept), 1, MAX_TERMS)


def required_matches(n: Column, least: int | Column = 2) -> Column:
    """How many of ``n`` tokens a purely lexical hit must hold: ``least``, capped by n, raised to half of n."""
    least = F.lit(least) if isinstance(least, int) else least
    return F.greatest(F.least(least, n), F.ceil(n / 2), F.lit(1)).cast("int")


def base_lower(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def stem_of(base: Column) -> Column:
    """Without the last extension; a name that only begins with a dot has none."""
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def lexical_boost(tokens: Column, name: Column, path: Column) -> Column:
    """The best layer: 0.25 a token is the file's name or stem, 0.15 it is the symbol's name, 0.10 one holds
    the other. An empty name holds in everything."""
    n, base = F.lower(name), base_lower(path)
    stem = stem_of(base)
    either = lambda t, x: F.contains(t, x) | F.contains(x, t)
    return (
        F.when(F.exists(tokens, lambda t: (t == base) | (t == stem)), 0.25)
        .when(F.exists(tokens, lambda t: t == n), 0.15)
        .when(F.exists(tokens, lambda t: either(t, n) | either(t, base) | either(t, stem)), 0.10)
        .otherwise(0.0)
    )


def is_test_file(path: Column) -> Column:
    p, base = F.lower(path), base_lower(path)
    return F.contains(base, F.lit(".test.")) | F.contains(base, F.lit(".spec.")) | F.endswith(base, F.lit("_test.rs")) | F.endswith(base, F.lit("_tests.rs")) | F.contains(p, F.lit("/tests/")) | F.contains(p, F.lit("/__tests__/"))


def is_test_symbol(name: Column) -> Column:
    n = F.lower(name)
    return F.startswith(n, F.lit("test_")) | F.endswith(n, F.lit("_test")) | F.endswith(n, F.lit("_tests")) | (n == "tests")


def has_evidence(tokens: Column, name: Column, path: Column, text: Column, least: int = 2) -> Column:
    """A lexical hit stands alone if a token is its name or file, or enough tokens are words of its text."""
    base = base_lower(path)
    exact = F.exists(tokens, lambda t: (t == F.lower(name)) | (t == base) | (t == stem_of(base)))
    words = F.transform(runs(text), F.lower)
    found = F.size(F.filter(tokens, lambda t: F.array_contains(words, t)))
    return exact | (found >= required_matches(F.size(tokens), least))


def fold_ascii(c: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same_name(a: Column, b: Column | str) -> Column:
    """Equal but for the case of ASCII letters."""
    return fold_ascii(a) == fold_ascii(F.lit(b) if isinstance(b, str) else b)


def content_hash(text: Column) -> Column:
    """A 64-bit content hash in lower hex, not padded."""
    return F.lower(F.hex(F.xxhash64(text)))


def oversize_hash(length: Column, mtime: Column) -> Column:
    return F.concat_ws(":", F.lit("oversized"), length.cast("string"), mtime.cast("string"))


def lines(text: Column) -> Column:
    """Lines as an editor counts them: a final line end adds none, empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"))


def _diacritics() -> tuple[str, str]:
    """Letters whose decomposition begins with one base letter, by the rule of Unicode, and these letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0].lower()) for r in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(*r) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), *_diacritics())


def index_tokens(text: Column) -> Column:
    """Tokens of the full-text index: folded runs; inner capitals do not separate."""
    return F.coalesce(runs(fold(text)), F.array().cast("array<string>"))


def cut_bytes(text: Column, most: int) -> Column:
    """Text of at most ``most`` bytes, as it is, or its longest beginning of so many bytes, cut between characters,
    with a note behind it."""
    # continuation bytes, 0x80 to 0xBF, do not begin a character: cut before the character that the bound splits
    raw = F.encode(text, "UTF-8")
    begins = lambda n: F.conv(F.hex(F.substring(raw, most + 1 - n, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) != 0x80
    keep = F.when(begins(0), most).when(begins(1), most - 1).when(begins(2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), keep), "UTF-8"), F.lit("\n... (truncated)")))


def nonblank(c: Column) -> Column:
    """Trimmed text, NULL where nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
