"""SQL of the engine's queries, for an independent engine over the same tables."""

from __future__ import annotations

import unicodedata

from cairn.functions.language import BY_EXTENSION, BY_NAME, DOC_EXTENSIONS

# Fixed values, stated here once more so that a wrong list in the engine shows.
TOKEN_STOPWORDS = "the and for with".split()
TERM_STOPWORDS = "the and for with this that does how what where when which code file".split()
NON_RETRIEVABLE = "import property_signature field_declaration property_declaration".split()
GENERIC = "props children id key value classname class_name name type data item items index i x y _".split()
#: Latin letters with marks, and the letters they are written with: what a canonical decomposition begins with.
_MARKED = {c: unicodedata.decomposition(c) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])}


def _letter(c: str) -> str:
    parts = _MARKED.get(c, "").split()
    return _letter(chr(int(parts[0], 16))) if parts and not parts[0].startswith("<") else c


FROM = "".join(c for c in _MARKED if _letter(c) != c)
TO = "".join(_letter(c).lower() for c in FROM)
NW = r"[^\p{L}\p{N}]+"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _runs(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{NW}'), lambda r: r <> '')"


def _distinct(x: str) -> str:
    """Distinct in order; ``x`` is a column."""
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


def _camel(x: str) -> str:
    a = rf"regexp_replace({x}, '{NW}', ' ', 'g')"
    b = rf"regexp_replace({a}, '([^\p{{Lu}}])(\p{{Lu}})', '\1 \2', 'g')"
    c = rf"regexp_replace({b}, '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
    return f"list_filter(list_transform(string_split_regex({c}, ' +'), lambda w: lower(w)), lambda w: length(w) >= 2)"


def _tokens(x: str) -> str:
    return f"list_filter(list_transform({_runs(x)}, lambda t: lower(t)), lambda t: octet_length(encode(t)) >= 3 AND t NOT IN {_in(TOKEN_STOPWORDS)})"


def _index(x: str) -> str:
    return f"""coalesce({_runs(f"translate(lower({x}), '{FROM}', '{TO}')")}, [])"""


BASE = "regexp_extract({0}, '[^/]*$')"
_TERMS = rf"list_filter(list_transform(regexp_split_to_array(query_text, '[^\p{{L}}\p{{N}}_.\-]+'), lambda r: regexp_replace(r, '^[_.\-]+|[_.\-]+$', '', 'g')), lambda r: length(r) >= 2 AND (regexp_matches(r, '[_.\-]') OR lower(r) NOT IN {_in(TERM_STOPWORDS)}))"
Q = "q AS (SELECT DISTINCT * FROM search_queries)"
SYM = "sym AS (SELECT DISTINCT ON (symbol_id) * FROM symbols)"
HITS = "hits AS (SELECT DISTINCT ON (hit_id) * FROM search_hits)"
CH = "ch AS (SELECT DISTINCT ON (symbol_id, chunk_index) *, printf('%012d-%06d', symbol_id, chunk_index) AS chunk_key FROM symbol_chunks)"
STEM = r"regexp_replace({0}, '^(.+)\.[^.]*$', '\1')"


def _boost(tokens: str, name: str, path: str) -> str:
    base = f"lower({BASE.format(path)})"
    stem = STEM.format(base)
    n = f"lower({name})"
    either = lambda x: f"contains(t, {x}) OR contains({x}, t)"
    any_of = lambda c: f"len(list_filter({tokens}, lambda t: {c})) > 0"
    return f"CASE WHEN {any_of(f't = {base} OR t = {stem}')} THEN 0.25 WHEN {any_of(f't = {n}')} THEN 0.15 WHEN {any_of(f'{either(n)} OR {either(base)} OR {either(stem)}')} THEN 0.10 ELSE 0.0 END::DOUBLE"


def _evidence(tokens: str, name: str, path: str, text: str) -> str:
    base = f"lower({BASE.format(path)})"
    return f"""(len(list_filter({tokens}, lambda t: t = lower({name}) OR t = {base} OR t = {STEM.format(base)})) > 0
      OR len(list_filter({tokens}, lambda t: list_contains(list_transform({_runs(text)}, lambda w: lower(w)), t))) >= greatest(least(2, len({tokens})), ceil(len({tokens}) / 2), 1))"""


def _test_file(p: str) -> str:
    base = f"lower({BASE.format(p)})"
    return f"(contains({base}, '.test.') OR contains({base}, '.spec.') OR suffix({base}, '_test.rs') OR suffix({base}, '_tests.rs') OR contains(lower({p}), '/tests/') OR contains(lower({p}), '/__tests__/'))"


def _test_symbol(n: str) -> str:
    return f"(prefix(lower({n}), 'test_') OR suffix(lower({n}), '_test') OR suffix(lower({n}), '_tests') OR lower({n}) = 'tests')"


def _bm25(docs: str, key: str, fields: list[tuple[str, float]]) -> str:
    """CTEs up to ``scored(query_id, <key>, bm25)``."""
    post = " UNION ALL ".join(f"SELECT {key}, {i} AS field, {w}::DOUBLE AS w, unnest({_index(f)}) AS token, generate_subscripts({_index(f)}, 1) AS pos FROM {docs}" for i, (f, w) in enumerate(fields))
    dl = " + ".join(f"len({_index(f)})" for f, _ in fields)
    return f"""
post AS ({post}),
dl AS (SELECT {key}, {dl} AS dl FROM {docs}),
st AS (SELECT count(*) AS n, avg(dl) AS avg_len FROM dl),
t0 AS (SELECT query_id, {_TERMS} AS l FROM q),
t1 AS (SELECT query_id, unnest(list_slice({_distinct("l")}, 1, 12)) AS term FROM t0),
t2 AS (SELECT query_id, term, {_index("term")} AS toks FROM t1),
t3 AS (SELECT query_id, term, len(toks) AS n, unnest(toks) AS token, generate_subscripts(toks, 1) AS place FROM t2),
m AS (SELECT t3.query_id, t3.term, {key}, field, w, pos - place AS at, t3.n FROM post JOIN t3 USING (token)
      GROUP BY ALL HAVING count(DISTINCT place) = t3.n),
tf AS (SELECT query_id, term, {key}, sum(w) AS tf FROM m GROUP BY ALL),
df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
scored AS (SELECT query_id, {key}, round(sum(greatest(ln((st.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 9) AS bm25
           FROM tf JOIN df USING (query_id, term) JOIN dl USING ({key}), st GROUP BY ALL)"""


def _leg(own: bool) -> str:
    """The lexical leg with 50 candidates and scores of six decimals, or with each query's own number."""
    b, k = ("bm25", "k_candidates") if own else ("round(bm25, 6)", "50")
    return f"""
c1 AS (SELECT query_id, chunk_key, {b} AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY {b} DESC, chunk_key) AS r FROM scored),
c2 AS (SELECT query_id, chunk_key, bm25, symbol_id, {k} AS k FROM c1 JOIN q USING (query_id) JOIN ch USING (chunk_key) WHERE r <= 2 * {k} QUALIFY row_number() OVER (PARTITION BY query_id, symbol_id ORDER BY r) = 1),
lex AS (SELECT query_id, symbol_id, chunk_key, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_key) AS rank FROM c2 QUALIFY rank <= k)"""


_CHUNK_FIELDS = [("fts_name", 3.0), ("fts_path", 2.0), ("fts_body", 1.0)]
_EMB = """
e AS (SELECT DISTINCT ON (symbol_id, chunk_index) * FROM symbol_embeddings),
qv AS (SELECT query_id, arg_min(embedding, hit_id)::DOUBLE[] AS vec FROM hits JOIN (SELECT * FROM e WHERE chunk_index = 0 AND len(embedding) = 64) USING (symbol_id) GROUP BY 1),
v0 AS (SELECT query_id, symbol_id, chunk_index, e.start_line, e.end_line, round(greatest(0.0, least(1.0, list_dot_product(embedding::DOUBLE[], vec))), 9) AS cosine
       FROM (SELECT * FROM e WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x)))) e, (SELECT * FROM qv WHERE NOT list_bool_or(list_transform(vec, lambda x: isnan(x)))) qv),
v1 AS (SELECT * FROM v0 WHERE cosine >= 0.4 QUALIFY row_number() OVER (PARTITION BY query_id, symbol_id ORDER BY cosine DESC, start_line, chunk_index) = 1),
sem AS (SELECT query_id, symbol_id, v1.start_line, v1.end_line, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, symbol_id) AS rank FROM v1 JOIN q USING (query_id) QUALIFY rank <= k_candidates)"""


def _rrf(b: str) -> str:
    return f"CASE WHEN w_vector + w_bm25 > 0 THEN (coalesce(w_vector / (rrf_k + sem.rank), 0) + coalesce(w_bm25 / (rrf_k + {b}.rank), 0)) / ((w_vector + w_bm25) / (rrf_k + 1)) ELSE 0 END"


def _fuse(semantic: bool) -> str:
    none = "sem AS (SELECT 0::BIGINT AS query_id, 0::BIGINT AS symbol_id, 0::BIGINT AS start_line, 0::BIGINT AS end_line, 0::BIGINT AS rank WHERE false)"
    return f"""{_EMB if semantic else none},
qt AS (SELECT query_id, {_tokens("query_text")} AS toks FROM q),
b0 AS (SELECT lex.query_id, lex.symbol_id, lex.rank, ch.start_line, ch.end_line, concat_ws(' ', ch.fts_name, ch.fts_path, ch.fts_body) AS txt FROM lex JOIN ch USING (chunk_key)),
b1 AS (SELECT b0.* FROM b0 JOIN qt USING (query_id) JOIN sym USING (symbol_id) LEFT JOIN sem ON sem.query_id = b0.query_id AND sem.symbol_id = b0.symbol_id
       WHERE sem.symbol_id IS NOT NULL OR {_evidence("toks", "sym.name", "sym.path", "txt")}),
b2 AS (SELECT query_id, symbol_id, start_line, end_line, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM b1),
f0 AS (SELECT query_id, symbol_id, {_rrf("b2")} AS rrf,
              sem.rank AS rv, b2.rank AS rb, CASE WHEN sem.rank IS NULL THEN b2.start_line ELSE sem.start_line END AS cs, CASE WHEN sem.rank IS NULL THEN b2.end_line ELSE sem.end_line END AS ce
       FROM sem FULL JOIN b2 USING (query_id, symbol_id) JOIN q USING (query_id)),
f1 AS (SELECT query_id, symbol_id, path AS file_path, CASE WHEN rv IS NOT NULL AND rb IS NOT NULL THEN 'hybrid' WHEN rv IS NOT NULL THEN 'semantic' ELSE 'lexical' END AS match_type,
              CASE WHEN cs > 0 THEN cs ELSE start_line END AS start_line, CASE WHEN cs > 0 THEN ce ELSE end_line END AS end_line,
              greatest(0.0, least(1.0, rrf + {_boost("toks", "name", "path")} - CASE WHEN kind = 'doc_section' THEN 0.12 ELSE 0 END::DOUBLE
                - CASE WHEN {_test_file("path")} OR {_test_symbol("name")} THEN 0.10 ELSE 0 END::DOUBLE)) AS score
       FROM f0 JOIN qt USING (query_id) JOIN sym USING (symbol_id)),
f2 AS (SELECT * FROM f1 WHERE score >= 0.35 QUALIFY row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, symbol_id) <= 3),
fin AS (SELECT f2.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) AS position FROM f2 JOIN q USING (query_id) QUALIFY position <= greatest(max_hits, 1))"""


_HYBRID = f"WITH {Q}, {SYM}, {HITS}, {CH}, {_bm25('ch', 'chunk_key', _CHUNK_FIELDS)}, {_leg(True)}, {_fuse(True)}"
_LEGS = f"""WITH {Q}, {SYM}, {HITS}, {CH},
v AS (SELECT * FROM hits WHERE cosine >= 0.4 AND NOT isnan(cosine) QUALIFY row_number() OVER (PARTITION BY query_id, symbol_id ORDER BY cosine DESC, hit_id) = 1),
sem AS (SELECT query_id, symbol_id, start_line, end_line, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, symbol_id) AS rank FROM v QUALIFY rank <= 50),
b AS (SELECT * FROM hits WHERE bm25 IS NOT NULL AND NOT isnan(bm25) QUALIFY row_number() OVER (PARTITION BY query_id, symbol_id ORDER BY bm25, hit_id) = 1),
lex AS (SELECT query_id, symbol_id, start_line, end_line, row_number() OVER (PARTITION BY query_id ORDER BY bm25, symbol_id) AS rank FROM b QUALIFY rank <= 50)"""


def _language(p: str) -> str:
    base, ext = BASE.format(p), rf"regexp_extract({BASE.format(p)}, '^.+\.([^.]*)$', 1)"
    case = lambda x, d: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + " END"
    return f"coalesce({case(base, BY_NAME)}, {case(ext, BY_EXTENSION)})", case(ext, DOC_EXTENSIONS)


def _nonblank(x: str) -> str:
    return rf"nullif(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '')"


_EMBED_TEXT = f"concat_ws(' | ', kind || ': ' || name, 'context: ' || {_nonblank('parent_context')}, {_nonblank('doc_comment')}, {_nonblank('left(' + _nonblank('body_text') + ', 800)')})"
_CODE, _DOC = _language("path")
_LAST = "last AS (SELECT path, arg_max(hash, ingested_at) AS hash, arg_max(struct_pack(m := last_modified, s := size), ingested_at) AS x FROM file_scans WHERE hash IS NOT NULL GROUP BY path)"

_CHUNK_SQL = rf"""WITH RECURSIVE {SYM},
n0 AS (SELECT *, {_camel("name")} AS l, {BASE.format("path")} AS base, string_split(path, '/') AS dirs FROM sym),
n1 AS (SELECT *, {_distinct("l")} AS wl, {STEM.format("base")} AS stem, {_nonblank("doc_comment")} AS doc, regexp_replace(coalesce(body_text, ''), '\s+$', '') AS body FROM n0),
n2 AS (SELECT *, CASE WHEN len(wl) > 1 OR (len(wl) = 1 AND wl[1] <> lower(name)) THEN array_to_string(wl, ' ') END AS words,
  [base, stem] || {_camel("stem")} || flatten(list_transform(list_reverse(dirs[greatest(len(dirs) - 3, 1):len(dirs) - 1]), lambda x: {_camel("x")})) AS pt,
  CASE WHEN {_nonblank("body")} IS NULL THEN [] ELSE string_split_regex(body, '\r?\n') END AS ls FROM n1),
n3 AS (SELECT *, concat_ws(' | ', CASE WHEN words IS NULL THEN kind || ': ' || name ELSE kind || ': ' || name || ' (' || words || ')' END, 'file: ' || nullif(stem, ''), 'context: ' || {_nonblank("parent_context")}, doc) AS header,
  array_to_string({_distinct("pt")}, ' ') AS fts_path, CASE WHEN words IS NULL THEN name ELSE name || ' ' || words END AS fts_name FROM n2),
pre AS (SELECT symbol_id, k, sum(length(x) + 1) OVER (PARTITION BY symbol_id ORDER BY k) AS upto FROM (SELECT symbol_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS k FROM n3)),
p AS (SELECT symbol_id, list(upto ORDER BY k) AS upto, count(*) AS n FROM pre GROUP BY 1),
c(symbol_id, i, j) AS (SELECT symbol_id, 1::BIGINT, greatest(1, len(list_filter(upto, lambda u: u <= 800)))::BIGINT FROM p
  UNION ALL SELECT x.symbol_id, x.i, greatest(x.i, len(list_filter(p.upto, lambda u: u <= p.upto[x.i - 1] + 800)))::BIGINT
  FROM (SELECT symbol_id, greatest(j - 1, i + 1) AS i, j FROM c) x JOIN p USING (symbol_id) WHERE x.j < p.n),
g AS (SELECT n3.*, i, j, {_nonblank("array_to_string(ls[i:j], chr(10))")} AS slice FROM c JOIN n3 USING (symbol_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY i) - 1 AS chunk_index FROM g WHERE slice IS NOT NULL),
b0 AS (SELECT symbol_id, chunk_index, flatten(list_transform(list_filter({_runs("slice")}, lambda r: regexp_matches(r, '[^\p{{Lu}}]\p{{Lu}}|\p{{Lu}}\p{{Lu}}\p{{Ll}}')), lambda x: {_camel("x")})) AS l FROM h),
b1 AS (SELECT symbol_id, chunk_index, {_distinct("l")} AS l FROM b0),
b2 AS (SELECT symbol_id, chunk_index, unnest(l) AS w, generate_subscripts(l, 1) AS k FROM b1),
b3 AS (SELECT *, sum(octet_length(encode(w))) OVER (PARTITION BY symbol_id, chunk_index ORDER BY k) + k - 1 AS n FROM b2),
b AS (SELECT symbol_id, chunk_index, string_agg(w, ' ' ORDER BY k) AS split FROM b3 WHERE n <= 400 GROUP BY ALL)
SELECT symbol_id, chunk_index, (greatest(end_line - len(ls) + 1, start_line) + i - 1)::BIGINT AS start_line, (greatest(end_line - len(ls) + 1, start_line) + j - 1)::BIGINT AS end_line,
  header || ' | ' || slice AS embed_text, fts_name, fts_path, concat_ws(chr(10), doc, slice, split) AS fts_body FROM h LEFT JOIN b USING (symbol_id, chunk_index)
UNION ALL SELECT symbol_id, 0, start_line, end_line, header, fts_name, fts_path, coalesce(doc, '') FROM n3 WHERE len(ls) = 0"""

_CALLS = r"""c AS (SELECT repo, name AS f, unnest(regexp_extract_all(body_text, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS t FROM sym WHERE body_text IS NOT NULL),
first AS (SELECT repo, name, min(symbol_id) AS id FROM sym GROUP BY repo, name),
rel AS (SELECT a.id AS from_id, b.id AS to_id FROM c JOIN first a ON a.repo = c.repo AND a.name = f JOIN first b ON b.repo = c.repo AND b.name = t WHERE f <> t)"""
_HERE = f"""l0 AS (SELECT path, arg_max({{'h': hash}}, ingested_at) AS x FROM file_scans GROUP BY path),
here AS (SELECT path FROM l0 WHERE x.h IS NOT NULL AND ({_CODE} IS NOT NULL OR {_DOC} IS NOT NULL))"""

SQL = {
    "chunk_symbols": _CHUNK_SQL,
    "identifier_split": f"""WITH n AS (SELECT DISTINCT name FROM symbols), w AS (SELECT name, {_camel("name")} AS l FROM n), d AS (SELECT name, {_distinct("l")} AS l FROM w)
SELECT name, array_to_string(l, ' ') AS words, CASE WHEN len(l) > 1 OR (len(l) = 1 AND l[1] <> lower(name)) THEN array_to_string(l, ' ') END AS word_string FROM d""",
    "body_split_words": rf"""WITH {SYM}, r AS (SELECT symbol_id, list_filter({_runs("coalesce(body_text, '')")}, lambda r: regexp_matches(r, '[^\p{{Lu}}]\p{{Lu}}|\p{{Lu}}\p{{Lu}}\p{{Ll}}')) AS rs FROM sym),
w AS (SELECT symbol_id, flatten(list_transform(rs, lambda x: {_camel("x")})) AS l FROM r), d AS (SELECT symbol_id, {_distinct("l")} AS l FROM w),
u AS (SELECT symbol_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM d),
c AS (SELECT symbol_id, w, i, sum(octet_length(encode(w))) OVER (PARTITION BY symbol_id ORDER BY i) + i - 1 AS n FROM u),
a AS (SELECT symbol_id, string_agg(w, ' ' ORDER BY i) AS words FROM c WHERE n <= 400 GROUP BY 1)
SELECT symbol_id, coalesce(words, '') AS words FROM d LEFT JOIN a USING (symbol_id)""",
    "query_terms": f"""WITH {Q}, t AS (SELECT query_id, {_tokens("query_text")} AS toks, {_TERMS} AS l FROM q)
SELECT query_id, array_to_string(toks, ' ') AS tokens, array_to_string(list_slice({_distinct("l")}, 1, 12), ' OR ') AS terms,
       greatest(least(2, len(toks)), ceil(len(toks) / 2), 1)::BIGINT AS required FROM t""",
    "language_detect": f"SELECT DISTINCT file_id, {_CODE} AS code_language, {_DOC} AS doc_language FROM files",
    "test_flags": f"SELECT DISTINCT symbol_id, {_test_file('path')} AS test_file, {_test_symbol('name')} AS test_symbol FROM symbols",
    "lexical_boost_layers": f"WITH {Q}, {HITS}, t AS (SELECT query_id, {_tokens('query_text')} AS toks FROM q) SELECT hit_id, {_boost('toks', 'name', 'file_path')} AS lexical_boost FROM hits JOIN t USING (query_id)",
    "minified_detect": r"""SELECT DISTINCT file_id, octet_length(encode(content)) >= 50000 AND octet_length(encode(content)) // greatest(len(content) - len(replace(content, chr(10), ''))
       + CASE WHEN content = '' OR suffix(content, chr(10)) THEN 0 ELSE 1 END, 1) > 300 AS minified FROM file_contents WHERE content IS NOT NULL""",
    "embed_gate": f"""WITH {SYM}, t AS (SELECT symbol_id, kind, name, octet_length(encode({_EMBED_TEXT})) AS bytes FROM sym)
SELECT symbol_id, bytes, kind NOT IN {_in(NON_RETRIEVABLE)} AND bytes >= 40 AND NOT (lower(name) IN {_in(GENERIC)} AND bytes < 120) AS worth FROM t""",
    "path_terms": f"""WITH f AS (SELECT DISTINCT file_id, path, {BASE.format("path")} AS base, string_split(path, '/') AS p FROM files),
g AS (SELECT file_id, [base, {STEM.format("base")}] || {_camel(STEM.format("base"))} || flatten(list_transform(list_reverse(p[greatest(len(p) - 3, 1):len(p) - 1]), lambda x: {_camel("x")})) AS l FROM f)
SELECT file_id, array_to_string({_distinct("l")}, ' ') AS terms FROM g""",
    "doc_sections": rf"""WITH f AS (SELECT DISTINCT path, regexp_replace(content, '\r\n|\r', chr(10), 'g') AS c FROM file_contents WHERE content IS NOT NULL AND {_DOC} IS NOT NULL),
l AS (SELECT path, c, CASE WHEN c = '' THEN [] ELSE string_split(CASE WHEN suffix(c, chr(10)) THEN left(c, length(c) - 1) ELSE c END, chr(10)) END AS ls FROM f),
h AS (SELECT path, ls, unnest(list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '^#{{1,6}}\s+.+$'))) AS i FROM l),
n AS (SELECT path, ls, i, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS ordinal, coalesce(lead(i) OVER (PARTITION BY path ORDER BY i), len(ls) + 1) AS nxt FROM h)
SELECT path, ordinal, trim(regexp_extract(ls[i], '^#{{1,6}}\s+(.+)$', 1)) AS name, 'doc_section' AS kind, path AS parent_context,
       {_nonblank("left(" + _nonblank("array_to_string(ls[i + 1:nxt - 1], chr(10))") + ", 800)")} AS body_text, i::BIGINT AS start_line, (nxt - 1)::BIGINT AS end_line FROM n
UNION ALL
SELECT path, 0, {STEM.format(BASE.format("path"))}, 'doc_section', path, {_nonblank("left(c, 800)")}, 1, greatest(len(ls), 1) FROM l WHERE path NOT IN (SELECT path FROM h)""",
    "bm25_chunks_topk": f"WITH {Q}, {CH}, {_bm25('ch', 'chunk_key', _CHUNK_FIELDS)}, {_leg(False)} SELECT query_id, symbol_id, chunk_key, bm25, rank FROM lex",
    "code_search": f"WITH {Q}, {SYM}, {_bm25('sym', 'symbol_id', [('name', 1.0), ('signature', 1.0)])} SELECT query_id, symbol_id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, symbol_id) AS rank FROM scored QUALIFY rank <= 20",
    "vector_topk": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS symbol_id, round(greatest(0.0, least(1.0, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9) AS cosine
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
SELECT query_id, symbol_id, round(cosine, 5) AS cosine FROM s WHERE cosine >= 0.15 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, symbol_id) <= 10""",
    "hybrid_search": f"{_HYBRID} SELECT query_id, position, symbol_id, match_type, round(score, 5) AS score, file_path, start_line, end_line FROM fin",
    "hybrid_lexical_only": f"WITH {Q}, {SYM}, {CH}, {_bm25('ch', 'chunk_key', _CHUNK_FIELDS)}, {_leg(True)}, {_fuse(False)} SELECT query_id, position, symbol_id, match_type, round(score, 5) AS score FROM fin",
    "rrf_fusion": f"""{_LEGS} SELECT query_id, symbol_id, round({_rrf("lex")}, 6) AS rrf, sem.rank AS r_vector, lex.rank AS r_bm25,
  CASE WHEN sem.rank IS NULL THEN lex.start_line ELSE sem.start_line END AS start_line, CASE WHEN sem.rank IS NULL THEN lex.end_line ELSE sem.end_line END AS end_line FROM sem FULL JOIN lex USING (query_id, symbol_id) JOIN q USING (query_id)""",
    "evidence_gate": f"""{_LEGS}, qt AS (SELECT query_id, {_tokens("query_text")} AS toks FROM q),
x AS (SELECT lex.query_id, lex.symbol_id, lex.rank, toks, sym.name, sym.path, coalesce(concat_ws(' ', ch.fts_name, ch.fts_path, ch.fts_body), '') AS txt, sem.symbol_id AS seen FROM lex JOIN qt USING (query_id) JOIN sym ON sym.symbol_id = lex.symbol_id
  LEFT JOIN ch ON ch.symbol_id = lex.symbol_id AND ch.chunk_index = 0 LEFT JOIN sem ON sem.query_id = lex.query_id AND sem.symbol_id = lex.symbol_id)
SELECT query_id, symbol_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM x WHERE seen IS NOT NULL OR {_evidence("toks", "name", "path", "txt")}""",
    "per_file_cap": f"""WITH {HITS}, o AS (SELECT * FROM hits WHERE score IS NOT NULL AND NOT isnan(score) QUALIFY row_number() OVER (PARTITION BY query_id, symbol_id ORDER BY score DESC, hit_id) = 1)
SELECT query_id, symbol_id, file_path, score FROM o QUALIFY row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, symbol_id) <= 3""",
    "known_item_eval": f"""{_HYBRID}, g AS (SELECT DISTINCT query_id, symbol_id FROM judgments WHERE grade = 3), b AS (SELECT query_id, min(position) AS best FROM fin JOIN g USING (query_id, symbol_id) GROUP BY 1),
w AS (SELECT query_id, best FROM (SELECT DISTINCT query_id FROM g) LEFT JOIN b USING (query_id))
SELECT count(*) AS queries, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END), 4) AS top_1, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0.0 END), 4) AS top_3, round(avg(CASE WHEN best <= 15 THEN 1.0 ELSE 0.0 END), 4) AS top_15 FROM w""",
    "identifier_eval": f"""WITH {SYM}, q AS (SELECT symbol_id AS query_id, name AS query_text, 15 AS max_hits, 60.0::DOUBLE AS rrf_k, 1.0::DOUBLE AS w_vector, 1.0::DOUBLE AS w_bm25, 50 AS k_candidates FROM sym WHERE symbol_id % 20 = 0 AND kind NOT LIKE 'import%' AND kind <> 'use_declaration'),
{CH}, {_bm25('ch', 'chunk_key', _CHUNK_FIELDS)}, {_leg(True)}, {_fuse(False)},
b AS (SELECT query_id, min(position) AS best FROM fin JOIN sym USING (symbol_id) JOIN q USING (query_id) WHERE lower(name) = lower(query_text) GROUP BY 1)
SELECT count(*) AS queries, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END), 4) AS top_1, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0.0 END), 4) AS top_3 FROM q LEFT JOIN b USING (query_id)""",
    "symbol_lookup_nocase": f"""WITH {Q}, {SYM}, n AS (SELECT query_id, query_text AS t FROM q UNION ALL SELECT -min(symbol_id), translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM sym GROUP BY name)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY path, start_line, symbol_id) AS position, symbol_id, name, kind, path AS file_path, start_line, signature
FROM sym JOIN n ON translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') QUALIFY position <= 20""",
    "file_outline": f"WITH {SYM} SELECT path, row_number() OVER (PARTITION BY path ORDER BY start_line, ordinal) AS position, symbol_id, name, kind, start_line, end_line FROM sym",
    "call_resolution": f"WITH {SYM}, {_CALLS} SELECT from_id, to_id, 'calls' AS kind, count(*) AS times FROM rel GROUP BY ALL",
    "callers_by_name": f"""WITH {SYM}, {_CALLS}, asked AS (SELECT name, min(path) AS exclude_path, min(symbol_id) AS query_id FROM sym GROUP BY name)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY w.path, w.start_line, w.symbol_id) AS position, w.symbol_id, w.name, w.path AS file_path, w.start_line
FROM rel JOIN sym t ON t.symbol_id = rel.to_id JOIN asked ON asked.name = t.name JOIN sym w ON w.symbol_id = rel.from_id WHERE w.path <> exclude_path QUALIFY position <= 50""",
    "index_stats": f"""WITH {SYM}, f AS (SELECT DISTINCT ON (file_id) * FROM files), e AS (SELECT DISTINCT ON (symbol_id, chunk_index) * FROM symbol_embeddings)
SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM sym) AS symbols, (SELECT count(*) FROM e WHERE embedding IS NOT NULL) AS embeddings, (SELECT count(*) FROM f WHERE embed_hash IS NULL OR embed_hash <> hash) AS pending""",
    "embedding_pending": "SELECT DISTINCT file_id, path, hash, embed_hash FROM files WHERE embed_hash IS NULL OR embed_hash <> hash",
    "unchanged_skip": f"WITH {_LAST} SELECT path, hash FROM last WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.path = last.path AND f.hash = last.hash)",
    "prune_anti_join": f"WITH {SYM}, {_HERE} SELECT symbol_id, path FROM sym WHERE path IN (SELECT path FROM here)",
    "cascade_delete": f"""WITH {_HERE}, gone AS (SELECT path FROM files WHERE path NOT IN (SELECT path FROM here)),
e AS (SELECT 'symbols' AS tab, symbol_id, 0 AS chunk_index, path FROM symbols UNION SELECT 'symbol_chunks', symbol_id, chunk_index, path FROM symbol_chunks UNION SELECT 'symbol_embeddings', symbol_id, chunk_index, path FROM symbol_embeddings)
SELECT tab, symbol_id, count(*) AS n FROM e WHERE path NOT IN (SELECT path FROM gone) GROUP BY ALL""",
    "upsert_files": f"""WITH {_LAST}, f AS (SELECT DISTINCT ON (path) * FROM files)
SELECT path, CASE WHEN last.hash IS NOT NULL THEN {_CODE} ELSE f.language END AS language, CASE WHEN last.hash IS NOT NULL THEN last.hash ELSE f.hash END AS hash,
  CASE WHEN last.hash IS NOT NULL THEN last.x.m ELSE f.last_modified END AS last_modified, CASE WHEN last.hash IS NOT NULL THEN last.x.s ELSE f.size END AS size, f.embed_hash FROM f FULL JOIN last USING (path)""",
    "change_feed_debounce": """WITH RECURSIVE b AS (SELECT user_id, min(ts) AS s FROM events WHERE ts IS NOT NULL GROUP BY user_id
  UNION ALL SELECT e.user_id, min(e.ts) FROM b JOIN events e ON e.user_id = b.user_id AND e.ts >= b.s + INTERVAL 1 HOUR GROUP BY e.user_id, b.s),
w AS (SELECT e.*, b.s FROM events e JOIN b ON b.user_id = e.user_id AND e.ts >= b.s AND e.ts < b.s + INTERVAL 1 HOUR)
SELECT user_id, epoch_us(s) AS batch, count(*) AS events, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type FROM w GROUP BY user_id, s""",
}
