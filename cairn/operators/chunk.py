"""Chunking and document construction: headers, overlapping line slices, full-text fields, locale copy."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import body_split_words, identifier_word_string, identifier_words, lines, nonblank, stem_of
from cairn.session import broadcast_checked

BODY_CHARS, OVERLAP_LINES, I18N_BYTES, KEY_BYTES = 800, 2, 400, 128
# Kinds without retrievable content, and names that tell nothing in short texts.
NON_RETRIEVABLE = ("import", "property_signature", "field_declaration", "property_declaration")
GENERIC = ("props", "children", "id", "key", "value", "classname", "class_name", "name", "type", "data", "item", "items", "index", "i", "x", "y", "_")


def embedding_text(kind: Column, name: Column, parent: Column, doc: Column, body: Column) -> Column:
    """``kind: name | context: parent | doc | body``, each part trimmed, empty ones left out."""
    head = F.concat(kind, F.lit(": "), name)
    return F.concat_ws(" | ", head, F.concat(F.lit("context: "), nonblank(parent)), nonblank(doc), nonblank(F.substring(nonblank(body), 1, BODY_CHARS)))


def worth_embedding(kind: Column, name: Column, text: Column) -> Column:
    """Not an import or a field, at least 40 bytes, and at least 120 under a generic name."""
    n = F.octet_length(text)
    return ~kind.isin(*NON_RETRIEVABLE) & (n >= 40) & ~(F.lower(name).isin(*GENERIC) & (n < 120))


def path_terms(path: Column) -> Column:
    """Base name, stem, words of the stem and of the last three directories (nearest first), distinct."""
    base = F.substring_index(path, "/", -1)
    stem = stem_of(base)
    dirs = F.slice(F.reverse(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))), 1, 3)
    return F.array_join(F.array_distinct(F.concat(F.array(base, stem), identifier_words(stem), F.flatten(F.transform(dirs, identifier_words)))), " ")


def slices(body: Column, limit: int = BODY_CHARS, overlap: int = OVERLAP_LINES) -> Column:
    """``array<struct<first:int,last:int>>`` of line ranges (from 0) of at most ``limit`` characters, a line
    counting one more, at least one line each; a range begins ``overlap`` lines before its predecessor's end,
    but at least one line after its beginning. Native: one pass over the lines with an accumulator."""
    rows = F.transform(body, lambda s, i: F.struct(i.cast("int").alias("i"), (F.char_length(s) + 1).alias("n")))
    start = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("out"), F.lit(0).alias("first"), F.array().cast("array<int>").alias("sizes"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)

    def close(acc: Column, r: Column) -> Column:
        over = (F.size(acc["sizes"]) > 0) & (total(acc["sizes"]) + r["n"] > limit)
        first = F.greatest(r["i"] - overlap, acc["first"] + 1)
        kept = F.slice(acc["sizes"], first - acc["first"] + 1, F.greatest(r["i"] - first, F.lit(0)))
        return F.struct(
            F.when(over, F.array_append(acc["out"], F.struct(acc["first"].alias("first"), (r["i"] - 1).alias("last")))).otherwise(acc["out"]).alias("out"),
            F.when(over, first).otherwise(acc["first"]).alias("first"),
            F.when(over, kept).otherwise(acc["sizes"]).alias("sizes"),
        )

    def add(acc: Column, r: Column) -> Column:
        # a line too long for the shared lines closes a range for each of them
        state = F.array(acc)
        for _ in range(overlap + 1):
            state = F.transform(state, lambda x: close(x, r))
        done = F.transform(state, lambda x: F.struct(x["out"].alias("out"), x["first"].alias("first"), F.array_append(x["sizes"], r["n"]).alias("sizes")))
        return F.get(done, F.lit(0))

    done = lambda acc: F.when(F.size(acc["sizes"]) > 0, F.array_append(acc["out"], F.struct(acc["first"].alias("first"), (acc["first"] + F.size(acc["sizes"]) - 1).alias("last")))).otherwise(acc["out"])
    return F.aggregate(rows, start, add, done)


def chunk_symbols(symbols: DataFrame, i18n: dict[str, str] | DataFrame | None = None, *, limit: int = BODY_CHARS, overlap: int = OVERLAP_LINES, key: str = "symbol_id") -> DataFrame:
    """The chunks of every symbol: its columns, chunk_index, start_line, end_line, embed_text, fts_name,
    fts_path, fts_body.

    The header repeats in every chunk. Lines are anchored at the symbol's end. Blank slices are dropped; a
    symbol without body is one chunk of its header over all its lines. ``i18n`` maps locale keys to copy: a
    table of ``key, value`` of any size, which is joined by ``key`` of the symbols and chunk, or a dictionary,
    which goes to every task. Needs kind, name, path, parent_context, doc_comment, body_text, start_line,
    end_line.
    """
    s = symbols.withColumn("_words", identifier_word_string(F.col("name"))).withColumn("_doc", nonblank(F.col("doc_comment")))
    stem = F.nullif(stem_of(F.substring_index("path", "/", -1)), F.lit(""))
    title = F.when(F.col("_words").isNotNull(), F.concat("kind", F.lit(": "), "name", F.lit(" ("), "_words", F.lit(")"))).otherwise(F.concat("kind", F.lit(": "), "name"))
    header = F.concat_ws(" | ", title, F.concat(F.lit("file: "), stem), F.concat(F.lit("context: "), nonblank(F.col("parent_context"))), F.col("_doc"))
    body = F.regexp_replace(F.coalesce("body_text", F.lit("")), r"\s+\z", "")
    s = s.withColumn("_header", header).withColumn("_lines", F.when(nonblank(body).isNull(), F.array().cast("array<string>")).otherwise(lines(body)))
    s = s.withColumn("_ranges", F.when(F.size("_lines") > 0, slices(F.col("_lines"), limit, overlap)).otherwise(F.array(F.struct(F.lit(0).alias("first"), F.lit(-1).alias("last")))))
    anchor = F.greatest(F.col("end_line") - F.size("_lines") + 1, F.col("start_line"))
    text = lambda r: F.array_join(F.slice("_lines", r["first"] + 1, r["last"] - r["first"] + 1), "\n")
    parts = F.filter(F.transform("_ranges", lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), F.when(r["last"] >= 0, F.coalesce(nonblank(text(r)), F.lit(""))).otherwise("").alias("slice"))), lambda p: (p["last"] < 0) | nonblank(p["slice"]).isNotNull())
    each = s.withColumn("_first", anchor).select("*", F.posexplode(parts).alias("chunk_index", "_p"))
    whole = F.col("_p.last") < 0
    split = body_split_words(F.col("_p.slice"))
    if isinstance(i18n, DataFrame):
        copy = joined_copy(each.select(key, "chunk_index", F.col("_p.slice").alias("_text")), i18n, [key, "chunk_index"], "_text")
        each = each.join(copy.withColumnRenamed("copy", "_copy"), [key, "chunk_index"], "left").withColumn("_copy", F.coalesce("_copy", F.lit("")))
    else:
        each = each.withColumn("_copy", locale_copy(F.col("_p.slice"), i18n) if i18n else F.lit(""))
    out = each.select(
        *symbols.drop("start_line", "end_line").columns,
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.when(whole, F.col("start_line")).otherwise(F.col("_first") + F.col("_p.first")).cast("long").alias("start_line"),
        F.when(whole, F.col("end_line")).otherwise(F.col("_first") + F.col("_p.last")).cast("long").alias("end_line"),
        F.concat_ws(" | ", "_header", F.nullif(F.col("_p.slice"), F.lit("")), F.concat(F.lit("i18n: "), F.nullif("_copy", F.lit("")))).alias("embed_text"),
        F.when(F.col("_words").isNotNull(), F.concat_ws(" ", "name", "_words")).otherwise(F.col("name")).alias("fts_name"),
        path_terms(F.col("path")).alias("fts_path"),
        F.concat_ws("\n", "_doc", F.nullif(F.col("_p.slice"), F.lit("")), F.nullif("_copy", F.lit("")), F.nullif(split, F.lit(""))).alias("fts_body"),
    )
    return out


# ---------------------------------------------------------------- locale copy

_KEY = re.compile(r"[A-Za-z0-9._-]+")


def quoted_keys(text: str) -> list[str]:
    """The quoted literals of a text that may be keys, in order; a quote that is not closed begins nothing."""
    got, i = [], 0
    while (i := min((x for x in (text.find("\"", i), text.find("'", i)) if x >= 0), default=-1)) >= 0:
        end = text.find(text[i], i + 1)
        if end >= 0:
            if 0 < end - i - 1 <= KEY_BYTES and _KEY.fullmatch(text, i + 1, end):
                got.append(text[i + 1 : end])
            i = end
        i += 1
    return got


def resolve_keys(text: str, copy: dict[str, str]) -> str:
    """Values of the quoted keys in a text, distinct, in order; stops once they have 400 bytes."""
    got: dict[str, None] = {}
    total = 0
    for key in quoted_keys(text):
        if total >= I18N_BYTES:
            break
        value = copy.get(key)
        if value is not None and value not in got:
            total += len(value.encode()) + 1
            got[value] = None
    return " ".join(got)


def joined_copy(texts: DataFrame, copy: DataFrame, key: list[str], text: str) -> DataFrame:
    """``<key>, copy``: the same from a table of ``key, value``, by a join; rows without a known key are left out."""

    @F.pandas_udf("array<string>")
    def keys(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: quoted_keys(t) if t else [])

    asked = texts.where(F.col(text).rlike("[\"']")).select(*key, F.posexplode(keys(F.col(text))).alias("_pos", "_key"))
    found = asked.join(broadcast_checked(copy.select(F.col("key").alias("_key"), "value")), "_key").where("value is not null")
    values = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "value"))), lambda x: x["value"]))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"))
    add = lambda acc, v: F.struct(F.when(acc["n"] < I18N_BYTES, F.array_append(acc["out"], v)).otherwise(acc["out"]).alias("out"), (acc["n"] + F.octet_length(v) + 1).alias("n"))
    return found.groupBy(*key).agg(values.alias("_v")).select(*key, F.array_join(F.aggregate("_v", start, add, lambda acc: acc["out"]), " ").alias("copy"))


def locale_copy(text: Column, copy: dict[str, str]) -> Column:
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: resolve_keys(t, copy) if t else "")

    return run(text)


def flatten_json(value, prefix: str = "") -> dict[str, str]:
    """Nested objects as dotted keys; strings that are not blank only; arrays are passed over."""
    out: dict[str, str] = {}
    if isinstance(value, dict):
        for k, v in value.items():
            key = f"{prefix}.{k}" if prefix else k
            if isinstance(v, str):
                if v.strip():
                    out[key] = v
            else:
                out |= flatten_json(v, key)
    return out


_ANDROID = re.compile(r"<string\s+name=\"([^\"]+)\"[^>]*>(.*?)</string>", re.S)
_PAIR = re.compile(r"[\"']([A-Za-z0-9._-]+)[\"']\s*[:=]\s*[\"']((?:[^\"'\\\n]|\\.)+)[\"']")


def locale_entries(path: str, content: str | None) -> dict[str, str]:
    """Entries of one locale file: JSON and ARB, Android XML, or quoted pairs."""
    low = path.lower()
    if not content:
        return {}
    if low.endswith((".json", ".arb")):
        try:
            return flatten_json(json.loads(content))
        except ValueError:
            return {}
    if low.endswith(".xml"):
        return {k: v.strip() for k, v in _ANDROID.findall(content) if v.strip()}
    return {k: v for k, v in _PAIR.findall(content) if v.strip()}


#: Lower-case paths of locale resources: by folder and suffix, ARB and .strings files, Android values.
LOCALE = r"(?:^|/)(?:locales|locale|i18n|l10n|translations|lang)/.*\.(?:ts|tsx|js|json)$|\.(?:arb|strings)$|(?:^|/)values.*strings\.xml$"


def is_locale_file(path: Column) -> Column:
    return F.lower(path).rlike(LOCALE)


def is_english(path: Column) -> Column:
    p = F.lower(path)
    base = F.substring_index(p, "/", -1)
    return base.startswith("en") | F.contains(base, F.lit("_en.")) | F.contains(base, F.lit("-en.")) | F.contains(p, F.lit("/en.lproj/")) | p.endswith("/values/strings.xml")


def locale_dictionary(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``key, value``: entries of all locale files; English ones win, among equals the later path and place."""

    @F.pandas_udf("array<struct<key:string,value:string>>")
    def entries(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, c in parts:
            yield pd.Series([[{"key": k, "value": v} for k, v in locale_entries(x, y).items()] for x, y in zip(p, c)], dtype=object)

    some = files.where(is_locale_file(F.col(path)))
    rows = some.select(F.col(path).alias("path"), is_english(F.col(path)).alias("english"), F.posexplode(entries(F.col(path), F.col(content))).alias("pos", "e"))
    return rows.groupBy(F.col("e.key").alias("key")).agg(F.max_by(F.col("e.value"), F.struct("english", "path", "pos")).alias("value"))
