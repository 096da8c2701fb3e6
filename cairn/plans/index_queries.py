"""Queries over the index's maintenance operators, and their SQL. Where the test tables lack an operator's input, a
query derives one from what they have, and its SQL derives the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn.functions import text, vector
from cairn.functions.language import language_column
from cairn.operators import chunk, graph, sections, vectors
from cairn.plans.queries import _symbols
from cairn.plans.sql import _CHUNK_SQL, _CODE, _DOC, _EMBED_TEXT, GENERIC, NON_RETRIEVABLE, SYM, _in
from cairn.session import dedupe, ensure_checkpoint_dir, table
from cairn.sources.workspace import MAX_BYTES, is_indexable, is_watch_ignored
from cairn.store import Store, scan_records


def _contents(spark, d):
    return dedupe(table(spark, d, "file_contents"), "file_id")


def _paths(spark, d):
    """Each path under several folders and names, so every rule of a path predicate meets some."""
    p = dedupe(table(spark, d, "files"), "file_id").select("file_id", "path")
    base = F.substring_index("path", "/", -1)
    forms = [F.col("path"), F.concat(F.lit("i18n/"), "path"), F.concat(F.lit("App/Locales/EN-us/"), base), F.concat(F.lit("x/lang/"), base, F.lit("_en.json")), F.concat(F.lit("res/values/"), F.lit("strings.xml")), F.concat(F.lit("a/en.lproj/"), base, F.lit(".strings")), F.concat(F.lit("node_modules/"), "path"), F.concat(F.lit("a/.cache/"), base), F.concat(F.lit("b/target/"), base), F.concat("path", F.lit(".arb"))]
    return p.select("file_id", F.posexplode(F.array(*forms)).alias("form", "path"))


def locale_flags(spark, d):
    """Locale resources and English ones among the paths."""
    return _paths(spark, d).select("file_id", F.col("form").cast("long").alias("form"), chunk.is_locale_file(F.col("path")).alias("locale"), chunk.is_english(F.col("path")).alias("english"))


def watch_filter(spark, d):
    """What live updates take and what they pass over."""
    @F.pandas_udf("struct<indexable:boolean,ignored:boolean>")
    def flags(p):
        import pandas as pd

        return pd.DataFrame({"indexable": p.map(is_indexable), "ignored": p.map(is_watch_ignored)})

    return _paths(spark, d).select("file_id", F.col("form").cast("long").alias("form"), flags(F.col("path")).alias("f")).select("file_id", "form", "f.*")


def locale_dictionary(spark, d):
    """Copy of the configuration files, as if they lay in locale folders, English ones with an even id."""
    c = _contents(spark, d).where(F.col("path").endswith(".json") & F.col("content").isNotNull())
    folder = F.when(F.col("file_id") % 2 == 0, "i18n/en/en-").otherwise("i18n/de/")
    return chunk.locale_dictionary(c.select(F.concat(folder, F.substring_index("path", "/", -1)).alias("path"), "content"))


def i18n_copy(spark, d):
    """Copy for the quoted keys of each body; every second quoted literal of the table is a key."""
    s = _symbols(spark, d).where("body_text is not null").select("symbol_id", "body_text")
    literals = F.regexp_extract_all(F.col("body_text"), F.lit("\"([^\"]*)\"|'[^']*'"), F.lit(0))
    keys = s.select(F.explode(literals).alias("q")).select(F.expr("substring(q, 2, length(q) - 2)").alias("key")).distinct().where("length(key) % 2 = 0")
    return chunk.joined_copy(s, keys.withColumn("value", F.concat(F.lit("copy of "), F.upper("key"))), ["symbol_id"], "body_text")


def content_groups(spark, d):
    """Files with equal contents, by the content hash."""
    c = _contents(spark, d).where("content is not null")
    return c.groupBy(text.content_hash(F.col("content")).alias("h")).agg(F.min("file_id").alias("first"), F.count(F.lit(1)).alias("files")).drop("h")


def vector_functions(spark, d):
    """Dot product with a rotated vector, norm, similarity to an axis, and a masked mean of three vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding").withColumn("turned", F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1)))
    e = vectors.similarity(e, [1.0] + [0.0] * 63).withColumnRenamed("cosine", "axis")
    pooled = vector.mean_pool(F.array("embedding", "turned", F.reverse("embedding")), F.array(F.lit(1), F.col("vec_id") % 2, F.col("vec_id") % 3))
    short = vector.dot(F.col("embedding"), F.slice("turned", 1, 3))
    r = lambda c: F.round(c, 5)
    return e.select("vec_id", r(vector.dot(F.col("embedding"), F.col("turned"))).alias("dot"), r(vector.norm(F.col("embedding"))).alias("norm"), r(F.col("axis")).alias("axis"), short.isNull().alias("unequal"), r(F.get(pooled, F.lit(0))).alias("pooled_first"), r(vector.dot(pooled, pooled)).alias("pooled_square"))


def toml_tables(spark, d):
    """Tables of a TOML text made of each file's symbols."""
    s = _symbols(spark, d)
    block = F.concat(F.when(F.col("symbol_id") % 3 == 0, F.concat(F.lit("[["), "name", F.lit("]]"))).otherwise(F.concat(F.lit("  [tool."), "name", F.lit("]"))), F.lit("\nkind = '"), "kind", F.lit("'\nv = [\n[1, 2],\n]"))
    listed = s.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", block.alias("b")))).alias("l"))  # a file's symbols
    return sections.toml_tables(listed.select("path", F.array_join(F.transform("l", lambda x: x["b"]), "\n").alias("content")))


def _scan(spark, d):
    """A scan as the workspace source gives it: bytes, some of them no text, none above the size that is read."""
    c = _contents(spark, d)
    pad = F.when(F.col("file_id") % 7 == 0, F.unhex(F.lit("ff"))).otherwise(F.unhex(F.lit("")))
    raw = F.when(F.col("file_id") % 5 != 0, F.concat(F.coalesce("content", F.lit("")).cast("binary"), pad))
    length = F.when(F.col("file_id") % 5 != 0, F.octet_length(raw)).otherwise(F.lit(MAX_BYTES + 1) + F.col("file_id"))
    return c.select("path", length.cast("long").alias("length"), F.col("file_id").alias("mtime"), raw.alias("content"))


def scan_files(spark, d):
    """Records of a scan: text files, stubs of oversized ones, and none of what is no text."""
    r = scan_records(_scan(spark, d))
    return r.select("path", "language", F.col("hash").startswith("oversized:").alias("oversized"), F.when(F.col("content").isNull(), F.col("hash")).alias("pseudo"), "last_modified", "size", "stub")


def snippets(spark, d):
    """Lines of each hit's file, at most 40 lines and 300 bytes."""
    h = dedupe(table(spark, d, "search_hits"), "hit_id").select("hit_id", F.col("file_path").alias("path"), "start_line", "end_line")
    c = _contents(spark, d).where("content is not null").select("path", F.regexp_replace("content", "\r\n|\r", "\n").alias("content"))
    wanted = F.greatest(F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(40)), F.lit(0)).cast("int")
    part = F.array_join(F.slice(text.lines(F.col("content")), F.greatest(F.col("start_line"), F.lit(1)).cast("int"), wanted), "\n")
    return h.join(c, "path").select("hit_id", text.cut_bytes(part, 300).alias("snippet"))


def gated_chunks(spark, d):
    """Chunks of the symbols that are worth a vector."""
    s = _symbols(spark, d)
    t = chunk.embedding_text(F.col("kind"), F.col("name"), F.col("parent_context"), F.col("doc_comment"), F.col("body_text"))
    kept = s.where(chunk.worth_embedding(F.col("kind"), F.col("name"), t))
    got = chunk.chunk_symbols(kept.select("symbol_id", "name", "kind", "path", "parent_context", "doc_comment", "body_text", "start_line", "end_line"))
    return got.select("symbol_id", "chunk_index", "start_line", "end_line", "embed_text")


def _store(spark, d):
    """A store after a scan, changes to some files, deletions and a prune, in the shared folder."""
    c = _contents(spark, d).where("content is not null").where(language_column(F.col("path")).isNull() | (F.col("file_id") % 10 == 0))
    c = c.withColumn("content", F.regexp_replace("content", "\r\n|\r", "\n"))
    scan = lambda x: scan_records(x.select("path", F.octet_length("content").cast("long").alias("length"), F.lit(1).cast("long").alias("mtime"), F.col("content").cast("binary").alias("content")))
    s = Store(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}", buckets=8)
    s.apply(scan(c))
    s.apply(scan(c.where("file_id % 3 = 0").withColumn("content", F.concat(F.lit("# Added\nnew words to be found\n"), "content"))), gone=c.where("file_id % 4 = 1").select("path"))
    s.apply(scan(c.limit(0)), keep=c.where("file_id % 11 != 5").select("path"))
    return s


def store_files(spark, d):
    """Files and sizes after the updates, and their sections."""
    s = _store(spark, d)
    docs = s.read("symbols").where("kind = 'doc_section'").groupBy("path").agg(F.count(F.lit(1)).alias("sections"), F.min_by("name", "ordinal").alias("first"))
    return s.read("files").join(docs, "path", "left").select("path", "language", "size", F.coalesce("sections", F.lit(0)).alias("sections"), "first")


def store_lengths(spark, d):
    """What the index knows of each documentation file: chunks, their tokens, and those of their postings."""
    s = _store(spark, d)
    keys = s.read("chunks").where(F.col("path").rlike(r"\.(?:md|mdx|txt)$")).select("path", "chunk_key")
    post = s.read("postings").groupBy("chunk_key").agg(F.sum("tf").alias("tf"))
    return keys.join(s.read("lengths").select("chunk_key", "dl"), "chunk_key").join(post, "chunk_key").groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), (F.sum("dl") == F.sum("tf")).alias("agree"))


QUERIES = {f.__name__: f for f in (locale_flags, watch_filter, locale_dictionary, i18n_copy, content_groups, vector_functions, toml_tables, scan_files, snippets, gated_chunks, store_files, store_lengths)}

_FORMS = r"""b AS (SELECT DISTINCT file_id, path, regexp_extract(path, '[^/]*$') AS base FROM files),
f AS (SELECT file_id, unnest([path, 'i18n/' || path, 'App/Locales/EN-us/' || base, 'x/lang/' || base || '_en.json', 'res/values/strings.xml', 'a/en.lproj/' || base || '.strings', 'node_modules/' || path, 'a/.cache/' || base, 'b/target/' || base, path || '.arb']) AS path, unnest(range(10)) AS form FROM b),
g AS (SELECT *, '/' || lower(path) AS p, regexp_extract(lower(path), '[^/]*$') AS base FROM f)"""
_TURNED = "[embedding[(i % 64) + 1]::DOUBLE FOR i IN range(1, 65)]"
_AXIS = "[" + ", ".join(["1.0"] + ["0.0"] * 63) + "]::DOUBLE[]"
_STORE = rf"""c0 AS (SELECT DISTINCT file_id, path, regexp_replace(content, '\r\n|\r', chr(10), 'g') AS content FROM file_contents WHERE content IS NOT NULL AND ({_CODE} IS NULL OR file_id % 10 = 0)),
c1 AS (SELECT *, CASE WHEN file_id % 3 = 0 THEN '# Added' || chr(10) || 'new words to be found' || chr(10) || content ELSE content END AS now,
  {_CODE} AS code, {_DOC} AS doc FROM c0 WHERE file_id % 4 <> 1 AND file_id % 11 <> 5),
h AS (SELECT *, list_filter(string_split(now, chr(10)), lambda s: regexp_full_match(s, '#{{1,6}}\s+.+')) AS heads FROM c1)"""

SQL = {
    "locale_flags": rf"""WITH {_FORMS} SELECT file_id, form,
  (regexp_matches(p, '/(locales|locale|i18n|l10n|translations|lang)/') AND (suffix(p, '.ts') OR suffix(p, '.tsx') OR suffix(p, '.js') OR suffix(p, '.json'))) OR suffix(p, '.arb') OR suffix(p, '.strings') OR (suffix(p, 'strings.xml') AND contains(p, '/values')) AS locale,
  prefix(base, 'en') OR contains(base, '_en.') OR contains(base, '-en.') OR contains(p, '/en.lproj/') OR suffix(p, '/values/strings.xml') AS english FROM g""",
    "watch_filter": rf"""WITH {_FORMS} SELECT file_id, form, {_CODE} IS NOT NULL OR {_DOC} IS NOT NULL AS indexable,
  len(list_filter(string_split(path, '/'), lambda s: prefix(s, '.') OR s IN ('node_modules', 'dist', 'target'))) > 0 AS ignored FROM f""",
    "locale_dictionary": r"""WITH c AS (SELECT DISTINCT file_id, CASE WHEN file_id % 2 = 0 THEN 'i18n/en/en-' ELSE 'i18n/de/' END || regexp_extract(path, '[^/]*$') AS path, content FROM file_contents WHERE suffix(path, '.json') AND content IS NOT NULL AND json_valid(content)),
t AS (SELECT file_id % 2 = 0 AS english, c.path, j.id AS pos, j.type, j.fullkey, j.atom ->> '$' AS value FROM c, json_tree(content) j)
SELECT regexp_replace(substr(fullkey, 3), '"', '', 'g') AS key, arg_max(value, struct_pack(e := english, p := path, i := pos)) AS value FROM t
WHERE type = 'VARCHAR' AND NOT contains(fullkey, '[') AND trim(value) <> '' GROUP BY 1""",
    "i18n_copy": rf"""WITH {SYM}, l AS (SELECT symbol_id, regexp_extract_all(body_text, '"[^"]*"|''[^'']*''') AS qs FROM sym WHERE body_text IS NOT NULL),
q AS (SELECT symbol_id, unnest(qs)[2:-2] AS k, generate_subscripts(qs, 1) AS i FROM l),
v AS (SELECT symbol_id, 'copy of ' || upper(k) AS value, min(i) AS i FROM q WHERE length(k) % 2 = 0 AND regexp_full_match(k, '[A-Za-z0-9._-]{{1,128}}') GROUP BY ALL),
w AS (SELECT *, sum(octet_length(encode(value)) + 1) OVER (PARTITION BY symbol_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM v)
SELECT symbol_id, string_agg(value, ' ' ORDER BY i) AS copy FROM w WHERE coalesce(upto, 0) < 400 GROUP BY symbol_id""",
    "content_groups": "SELECT min(file_id) AS first, count(DISTINCT file_id) AS files FROM file_contents WHERE content IS NOT NULL GROUP BY content",
    "vector_functions": f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a, {_TURNED} AS b, list_reverse(embedding)::DOUBLE[] AS c FROM embeddings),
m AS (SELECT *, 1 + vec_id % 2 + CASE WHEN vec_id % 3 > 0 THEN 1 ELSE 0 END AS n FROM e),
p AS (SELECT *, [(a[i] + CASE WHEN vec_id % 2 > 0 THEN b[i] ELSE 0 END + CASE WHEN vec_id % 3 > 0 THEN c[i] ELSE 0 END) / n FOR i IN range(1, 65)] AS s FROM m)
SELECT vec_id, round(list_dot_product(a, b), 5) AS dot, round(sqrt(list_dot_product(a, a)), 5) AS norm, round(greatest(0.0, least(1.0, list_dot_product(a, {_AXIS}))), 5) AS axis, true AS unequal,
  round(s[1] / sqrt(list_dot_product(s, s)), 5) AS pooled_first, round(1.0::DOUBLE, 5) AS pooled_square FROM p""",
    "toml_tables": f"""WITH {SYM}, o AS (SELECT path, CASE WHEN symbol_id % 3 = 0 THEN name ELSE 'tool.' || name END AS name, row_number() OVER (PARTITION BY path ORDER BY ordinal) - 1 AS i, count(*) OVER (PARTITION BY path) AS n FROM sym)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS ordinal, trim(name) AS name, 'table' AS kind, 5 * i + 1 AS start_line, coalesce(5 * lead(i) OVER (PARTITION BY path ORDER BY i), 5 * n) AS end_line
FROM o WHERE regexp_full_match(name, '[\\p{{L}}\\p{{N}}._\\-"'' ]+')""",
    "scan_files": rf"""WITH c AS (SELECT DISTINCT file_id, path, coalesce(content, '') AS content FROM file_contents),
r AS (SELECT *, octet_length(encode(content)) AS n, CASE WHEN file_id % 5 = 0 THEN 'oversized:' || (1500001 + file_id) || ':' || file_id END AS pseudo FROM c WHERE file_id % 5 = 0 OR file_id % 7 <> 0)
SELECT path, coalesce({_CODE}, {_DOC}) AS language, pseudo IS NOT NULL AS oversized, pseudo, file_id AS last_modified, CASE WHEN file_id % 5 = 0 THEN 1500001 + file_id ELSE n END AS size,
  pseudo IS NOT NULL OR ({_CODE} IS NOT NULL AND n >= 50000 AND n // greatest(length(content) - length(replace(content, chr(10), '')) + CASE WHEN content = '' OR suffix(content, chr(10)) THEN 0 ELSE 1 END, 1) > 300) AS stub FROM r""",
    "snippets": r"""WITH h AS (SELECT DISTINCT hit_id, file_path, start_line, end_line FROM search_hits), c AS (SELECT DISTINCT path, regexp_replace(content, '\r\n|\r', chr(10), 'g') AS c FROM file_contents WHERE content IS NOT NULL),
l AS (SELECT hit_id, start_line, end_line, CASE WHEN c = '' THEN [] ELSE string_split(CASE WHEN suffix(c, chr(10)) THEN left(c, length(c) - 1) ELSE c END, chr(10)) END AS ls FROM h JOIN c ON path = file_path),
t AS (SELECT hit_id, coalesce(array_to_string(ls[greatest(start_line, 1):greatest(start_line, 1) + greatest(least(end_line - start_line + 1, 40), 0) - 1], chr(10)), '') AS t FROM l)
SELECT hit_id, CASE WHEN octet_length(encode(t)) <= 300 THEN t ELSE left(t, list_max(list_filter(range(0, 301), lambda n: octet_length(encode(left(t, n))) <= 300))) || chr(10) || '... (truncated)' END AS snippet FROM t""",
    "gated_chunks": f"""WITH {SYM}, g AS (SELECT symbol_id, kind, name, octet_length(encode({_EMBED_TEXT})) AS bytes FROM sym), x AS ({_CHUNK_SQL})
SELECT symbol_id, chunk_index, start_line, end_line, embed_text FROM x WHERE symbol_id IN (SELECT symbol_id FROM g WHERE kind NOT IN {_in(NON_RETRIEVABLE)} AND bytes >= 40 AND NOT (lower(name) IN {_in(GENERIC)} AND bytes < 120))""",
    "store_files": rf"""WITH {_STORE} SELECT path, coalesce(code, doc) AS language, octet_length(encode(now)) AS size, CASE WHEN doc IS NULL OR code IS NOT NULL THEN 0 WHEN len(heads) = 0 THEN 1 ELSE len(heads) END AS sections,
  CASE WHEN doc IS NULL OR code IS NOT NULL THEN NULL WHEN len(heads) = 0 THEN regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\.[^.]*$', '\1') ELSE trim(regexp_extract(heads[1], '^#{{1,6}}\s+(.+)$', 1)) END AS first FROM h""",
}
