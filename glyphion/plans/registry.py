"""All queries of the engine's own operators, with their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphion.functions import text as T
from glyphion.functions.languages import BY_EXTENSION, NAMES, detect_language
from glyphion.operators import chat, code_graph, graph, overview, retrieval, rules, tables
from glyphion.operators import search as find
from glyphion.plans import twins as W
from glyphion.sources import chunks as C
from glyphion.sources import extract
from glyphion.sources import files as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

SEARCHES = {1: "the of and", 2: "le de", 3: "der und", 4: "of zzqx", 5: "Étions dans"}
LANGUAGE_OF = {1: "en", 2: "fr", 3: "de", 4: "en", 5: "fr"}
NOW = "2024-01-20 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


PATH = "source || '/' || lang || '/doc_' || doc_id"


def _docs(spark, sf):
    return _t(spark, sf, "documents").withColumn("file_path", F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id"))))


def _values(spark, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _pick(values: list[str], n):
    return F.get(F.array(*map(F.lit, values)), F.pmod(n, F.lit(len(values))).cast("int"))


def _path(key):
    """As twins.path_sql."""
    return F.concat(_pick(W.DIRECTORIES, key), F.lit("/"), F.replace(_pick(W.FILE_NAMES, key), F.lit("{}"), key.cast("string")))


def _paths(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", _path(F.col("doc_id")).alias("path"))


_PATHS = f"(SELECT doc_id, {W.path_sql()} AS path FROM documents)"


def _plain(spark, sf):
    """Turns of conversations in ASCII, where both engines agree on the bounds of words."""
    return _t(spark, sf, "conversations").select("conv_id", "turn", "role", F.regexp_replace("text", "[^\\x00-\\x7F]", "").alias("q"))


_PLAIN = "(SELECT conv_id, turn, role, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS q FROM conversations)"


# --- retrieval ---------------------------------------------------------------------------------

_BM25 = W.bm25("documents", "doc_id", f"concat_ws(' ', {PATH}, text)", SEARCHES)
_RANKED = ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits WHERE matched = n_terms)"


def _keyword(spark, sf, limit=10, relaxed=False):
    return retrieval.keyword_search(_docs(spark, sf), SEARCHES, limit, relaxed, file="file_path")


@query(_BM25 + _RANKED + " SELECT query_id::BIGINT AS query_id, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def q_bm25_topk(spark, sf):
    return _keyword(spark, sf).select("query_id", "doc_id", "score", "rank")


@query(_BM25 + """, a AS (SELECT *, bool_or(matched = n_terms) OVER (PARTITION BY query_id) AS full_hit FROM hits),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM a WHERE matched = n_terms OR (NOT full_hit AND n_terms >= 2))
SELECT query_id::BIGINT AS query_id, doc_id, score, matched::BIGINT AS matched, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def q_keyword_or_fallback(spark, sf):
    return _keyword(spark, sf, relaxed=True).select("query_id", "doc_id", "score", "matched", "rank")


_COSINE = """round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"""
_VECTORS = "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, " + _COSINE + " AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0{}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10"


def _vectors(spark, sf, where=None):
    """Queries: the rows whose id is divisible by 20, against all rows."""
    rows = _t(spark, sf, "embeddings")
    wanted = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.vector_search(rows, wanted, 10, where).select("query_id", "vec_id", "score", "rank")


@query(_VECTORS.format(""))
def q_vector_topk(spark, sf):
    return _vectors(spark, sf)


@query(_VECTORS.format(" AND e.label = 3"))
def q_vector_topk_filtered(spark, sf):
    return _vectors(spark, sf, F.col("label") == 3)


def _centres(spark, sf):
    """The mean vector of each label, which stands for the query of that number."""
    rows = _t(spark, sf, "embeddings").where(F.col("label").isin(list(SEARCHES))).select("label", F.posexplode("embedding").alias("i", "x"))
    mean = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("query"))


_CENTRES = f"""m AS (SELECT label::BIGINT AS query_id, i, avg(embedding[i]::DOUBLE) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE label IN ({', '.join(map(str, SEARCHES))})) GROUP BY ALL),
c AS (SELECT query_id, list(x ORDER BY i) AS embedding FROM m GROUP BY 1)"""
_FUSED = _BM25 + f""", k AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS kr FROM hits WHERE matched = n_terms QUALIFY kr <= 50),
{_CENTRES}, v AS (SELECT q.query_id, e.vec_id AS doc_id, {_COSINE} AS score FROM embeddings e, c q),
s AS (SELECT query_id, doc_id, score AS raw, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS sr FROM v QUALIFY sr <= 50),
f AS (SELECT query_id, doc_id, kr, sr, raw, round(coalesce(1.0::DOUBLE / (60 + kr), 0) + coalesce(1.0::DOUBLE / (60 + sr), 0), 9) AS score FROM k FULL JOIN s USING (query_id, doc_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kr NULLS LAST, sr NULLS LAST, doc_id)::INTEGER AS rank FROM f)"""


def _hybrid(spark, sf):
    near = retrieval.vector_search(_t(spark, sf, "embeddings"), _centres(spark, sf), 50).withColumnRenamed("vec_id", "doc_id")
    return retrieval.rrf(_keyword(spark, sf, 50), near), near


@query(_FUSED + " SELECT query_id::BIGINT AS query_id, doc_id, score, rank FROM g WHERE rank <= 10")
def q_hybrid_search(spark, sf):
    return _hybrid(spark, sf)[0].where("rank <= 10").select("query_id", "doc_id", "score", "rank")


_EXPLAINED = f"CASE WHEN regexp_matches(path, '(^|/)(\\.next|dist|build|coverage|node_modules)/.|\\.min\\.js$') THEN 0.42::DOUBLE ELSE 1.0::DOUBLE END"


@query(_FUSED + f""" SELECT query_id::BIGINT AS query_id, doc_id, kr::INTEGER AS keyword_rank, sr::INTEGER AS semantic_rank, raw AS semantic_raw, score AS score_before_path,
{_EXPLAINED} AS path_multiplier, round(score * {_EXPLAINED}, 9) AS final_score FROM g JOIN {_PATHS} USING (doc_id) WHERE rank <= 10""")
def q_search_explain(spark, sf):
    fused, near = _hybrid(spark, sf)
    raw = near.select("query_id", "doc_id", F.col("score").alias("semantic_raw"))
    top = fused.where("rank <= 10").join(raw, ["query_id", "doc_id"], "left").join(_paths(spark, sf).select("doc_id", F.col("path").alias("file")), "doc_id")
    return find.explained(top).select("query_id", "doc_id", "keyword_rank", "semantic_rank", "semantic_raw", "score_before_path", "path_multiplier", "final_score")


@query("""WITH a AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20),
b AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rank FROM documents QUALIFY rank <= 20)
SELECT query_id, doc_id, a.rank::INTEGER AS keyword_rank, b.rank::INTEGER AS semantic_rank, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score FROM a FULL JOIN b USING (query_id, doc_id)""")
def q_rrf(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("source").alias("query_id"), "doc_id", "n_chars")
    first = retrieval.ranked(docs.withColumn("score", F.col("n_chars")), 20)
    last = retrieval.ranked(docs.withColumn("score", F.col("doc_id")), 20)
    return retrieval.rrf(first, last).select("query_id", "doc_id", "keyword_rank", "semantic_rank", "score")


@query(_BM25 + """, f AS (SELECT h.*, source FROM hits h JOIN documents USING (doc_id) WHERE matched = n_terms),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) = 1)
SELECT query_id::BIGINT AS query_id, source AS file_path, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM b QUALIFY rank <= 5""")
def q_dedupe_by_file(spark, sf):
    hits = retrieval.bm25(_docs(spark, sf), SEARCHES, file="file_path").where("matched = n_terms")
    hits = hits.join(_t(spark, sf, "documents").select("doc_id", F.col("source").alias("file_path")), "doc_id")
    return retrieval.dedupe_by_file(hits, 5).select("query_id", "file_path", "doc_id", "score", "rank")


@query(f"SELECT doc_id, path, {_EXPLAINED} AS score FROM {_PATHS}")
def q_path_quality(spark, sf):
    return _paths(spark, sf).select("doc_id", "path", T.path_quality(F.col("path"), F.lit(1.0)).alias("score"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Z]\\w+ing\\b'))::BIGINT AS matches, regexp_replace(text, '([A-Z]\\w+ing\\b)', '**\\1**', 'g') AS highlighted FROM documents WHERE regexp_matches(text, '[A-Z]\\w+ing\\b')")
def q_regex_search(spark, sf):
    return retrieval.regex_search(_t(spark, sf, "documents"), r"[A-Z]\w+ing\b").select("doc_id", "matches", "highlighted")


@query("""SELECT c.conv_id AS file_path, c.turn::BIGINT AS hit_index, min(o.turn)::BIGINT AS start_line, max(o.turn)::BIGINT AS end_line,
CASE WHEN length(string_agg(o.text, chr(10) ORDER BY o.turn)) > 8000 THEN left(string_agg(o.text, chr(10) ORDER BY o.turn), 8000) || '…' ELSE string_agg(o.text, chr(10) ORDER BY o.turn) END AS content
FROM conversations c JOIN conversations o ON c.conv_id = o.conv_id AND o.turn BETWEEN c.turn - 1 AND c.turn + 1 GROUP BY 1, 2""")
def q_expand_context(spark, sf):
    c = _t(spark, sf, "conversations").select(F.col("conv_id").alias("file_path"), F.col("turn").cast("long").alias("chunk_index"), F.col("turn").cast("long").alias("start_line"), F.col("turn").cast("long").alias("end_line"), F.col("text").alias("content"))
    return retrieval.expand_context(c.select("file_path", "chunk_index"), c, 1)


_WANTED = "SELECT CASE lang " + " ".join(f"WHEN '{v}' THEN {k}" for k, v in LANGUAGE_OF.items() if k < 4) + " END::BIGINT AS case_id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND lang IN ('en', 'fr', 'de')"


@query(_BM25 + _RANKED + f""", e AS ({_WANTED}), ww AS (SELECT case_id, count(DISTINCT doc_id) AS want FROM e GROUP BY 1),
h AS (SELECT e.case_id, count(*) AS n, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN e ON r.query_id = e.case_id AND r.doc_id = e.doc_id WHERE rank <= 10 GROUP BY 1)
SELECT case_id, round(coalesce(n / want, 0), 6)::DOUBLE AS recall, round(coalesce(1 / first, 0), 6)::DOUBLE AS mrr,
round(coalesce(dcg / list_sum(list_transform(range(1, least(want, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6)::DOUBLE AS ndcg FROM ww LEFT JOIN h USING (case_id)""")
def q_retrieval_metrics(spark, sf):
    """Keyword search judged by the good documents of the query's language."""
    case = F.coalesce(*(F.when(F.col("lang") == v, F.lit(k).cast("long")) for k, v in LANGUAGE_OF.items() if k < 4))
    wanted = _t(spark, sf, "documents").select("doc_id", case.alias("case_id")).where("case_id is not null").join(_t(spark, sf, "labels").where("quality = 1"), "doc_id")
    found = _keyword(spark, sf).select(F.col("query_id").alias("case_id"), "rank", F.col("doc_id").alias("file"))
    return retrieval.retrieval_metrics(found, wanted.select("case_id", F.col("doc_id").alias("file")), 10)


@query(_BM25 + f""", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits WHERE matched = n_terms QUALIFY rank <= 50),
h AS (SELECT 'search' || query_id || '.ts' AS file, path AS "similar", min(rank) AS rank FROM r JOIN {_PATHS} USING (doc_id) WHERE NOT regexp_matches(path, 'noext|unknown|[.]gz|[.]tmp') GROUP BY ALL)
SELECT file, "similar", row_number() OVER (PARTITION BY file ORDER BY CASE WHEN suffix("similar", '.ts') THEN 0 ELSE 1 END, rank, "similar")::INTEGER AS "at" FROM h QUALIFY "at" <= 5""")
def q_similar_files(spark, sf):
    hits = _keyword(spark, sf, 50).join(_paths(spark, sf), "doc_id")
    hits = hits.select(F.concat(F.lit("search"), F.col("query_id"), F.lit(".ts")).alias("file"), F.col("path").alias("similar"), detect_language(F.col("path")).alias("language"), "rank")
    return overview.similar_files(hits.select("file"), hits)


# --- scalar functions --------------------------------------------------------------------------

@query("SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS plain FROM documents")
def q_normalize_query(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.normalize_query(F.col("text")).alias("plain"))


_MODE = """CASE WHEN regexp_matches(trim(q), '^/(.+)/([gimsuy]*)$') THEN 'regex'
WHEN length(trim(q)) < 40 AND len(list_filter(regexp_split_to_array(trim(q), '\\s+'), lambda w: w <> '')) <= 3 AND regexp_matches(trim(q), '[\\\\/]|\\.[a-zA-Z0-9]{1,8}\\b|\\b[a-z][a-z0-9]*[A-Z][a-zA-Z0-9]*\\b|\\b[a-zA-Z]+_[a-zA-Z_]+\\b') THEN 'keyword'
WHEN regexp_matches(q, '(?i)\\b(how|where|what|why|when|which|explain|describe|implement|does|is there)\\b') OR length(trim(q)) > 80 OR len(list_filter(regexp_split_to_array(trim(q), '\\s+'), lambda w: w <> '')) >= 4 THEN 'hybrid' ELSE 'keyword' END"""


@query(f"SELECT conv_id, turn, {_MODE} AS mode FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN q WHEN 1 THEN left(q, 12) WHEN 2 THEN '/' || left(q, 9) || '/gi' ELSE left(q, 20) || '_b' END AS q FROM {_PLAIN})")
def q_route_mode(spark, sf):
    cut = F.when(F.col("turn") % 4 == 0, F.col("q")).when(F.col("turn") % 4 == 1, F.substring("q", 1, 12)).when(F.col("turn") % 4 == 2, F.concat(F.lit("/"), F.substring("q", 1, 9), F.lit("/gi"))).otherwise(F.concat(F.substring("q", 1, 20), F.lit("_b")))
    return _plain(spark, sf).withColumn("q", cut).select("conv_id", "turn", T.route_mode(F.col("q")).alias("mode"))


def _kinds(types):
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{p}') THEN '{k}'" for k, p in types) + " ELSE 'general' END"


@query(f"SELECT conv_id, turn, {_kinds(T.TASK_TYPES)} AS kind, {_kinds(T.CONTEXT_TASK_TYPES)} AS context_kind FROM {_PLAIN}")
def q_task_type(spark, sf):
    return _plain(spark, sf).select("conv_id", "turn", T.task_type(F.col("q")).alias("kind"), T.task_type(F.col("q"), T.CONTEXT_TASK_TYPES).alias("context_kind"))


_WRONG = "|".join(T.MISSPELLINGS)
_THRICE = "len(list_filter(range(1, length(q) - 1), lambda i: substr(q, i, 1) = substr(q, i + 1, 1) AND substr(q, i, 1) = substr(q, i + 2, 1) AND substr(q, i, 1) NOT IN (chr(10), chr(13)))) > 0"


@query(f"SELECT conv_id, turn, length(q) >= 3 AND ({_THRICE} OR len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: length(w) > 15)) > 0 OR regexp_matches(q, '{_WRONG}')) AS wrong FROM (SELECT conv_id, turn, left(q, (turn * 40 + 20)::INTEGER) || CASE turn % 3 WHEN 0 THEN ' teh' ELSE '' END AS q FROM {_PLAIN})")
def q_detect_typos(spark, sf):
    q = F.concat(F.expr("left(q, cast(turn * 40 + 20 as int))"), F.when(F.col("turn") % 3 == 0, " teh").otherwise(""))
    return _plain(spark, sf).select("conv_id", "turn", T.detect_typos(q).alias("wrong"))


@query(f"SELECT conv_id, turn, regexp_extract(q, '^/(.+)/([gimsuy]*)$', 1) AS pattern, CASE WHEN regexp_extract(q, '^/(.+)/([gimsuy]*)$', 2) = '' THEN 'i' ELSE regexp_extract(q, '^/(.+)/([gimsuy]*)$', 2) END AS flags FROM (SELECT conv_id, turn, '/' || left(q, 9) || CASE turn % 3 WHEN 0 THEN '/' WHEN 1 THEN '/gm' ELSE '' END AS q FROM {_PLAIN}) WHERE regexp_matches(trim(q), '^/(.+)/([gimsuy]*)$')")
def q_parse_regex(spark, sf):
    q = F.concat(F.lit("/"), F.substring("q", 1, 9), F.when(F.col("turn") % 3 == 0, "/").when(F.col("turn") % 3 == 1, "/gm").otherwise(""))
    return _plain(spark, sf).select("conv_id", "turn", T.regex_parts(q).alias("r")).where("r is not null").select("conv_id", "turn", "r.pattern", "r.flags")


@query("SELECT conv_id, turn, CASE WHEN len(w) >= 2 THEN array_to_string(w, ' OR ') END AS either FROM (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations)")
def q_or_expression(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", T.or_expression(F.col("text")).alias("either"))


_STOP = ", ".join(f"'{w}'" for w in T.TASK_STOP_WORDS)


@query(f"""WITH w AS (SELECT conv_id, turn, i, x FROM (SELECT conv_id, turn, regexp_split_to_array(regexp_replace(lower(text), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+') AS l, unnest(range(1, len(l) + 1)) AS i, l[i] AS x FROM conversations)
WHERE length(x) > 2 AND x NOT IN ({_STOP})), f AS (SELECT conv_id, turn, x, min(i) AS i FROM w GROUP BY ALL)
SELECT c.conv_id, c.turn, coalesce(array_to_string(list_slice(list(x ORDER BY i) FILTER (WHERE x IS NOT NULL), 1, 10), ' '), '') AS keywords FROM conversations c LEFT JOIN f ON c.conv_id = f.conv_id AND c.turn = f.turn GROUP BY c.conv_id, c.turn""")
def q_extract_keywords(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.extract_keywords(F.col("text")), " ").alias("keywords"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '…' ELSE text END AS shown FROM documents")
def q_snippet(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.snippet(F.col("text")).alias("shown"))


@query("SELECT a.p_partkey, round(1 - levenshtein(a.p_name, a.p_type)::DOUBLE / greatest(length(a.p_name), length(a.p_type)), 6) AS similarity FROM part a")
def q_levenshtein(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.round(T.levenshtein_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("SELECT doc_id, sha1(text) AS hash FROM documents")
def q_file_hash(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("hash"))


@query("SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS content FROM documents")
def q_lines(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "content")).withColumn("line", (F.col("line") + 1).cast("long"))


_CASES = " ".join(f"WHEN n = '{k}' THEN '{v}'" for k, v in NAMES.items()) + " " + " ".join(f"WHEN e = '{k}' THEN '{v}'" for k, v in BY_EXTENSION.items())


_LANGUAGE = f"CASE {_CASES} ELSE 'text' END"
_NAMES_OF = f"(SELECT doc_id, path, regexp_extract(path, '[^/]*$') AS n, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]*)$', 1)) AS e FROM {_PATHS})"


@query(f"SELECT doc_id, path, {_LANGUAGE} AS language FROM {_NAMES_OF}")
def q_detect_language(spark, sf):
    return _paths(spark, sf).select("doc_id", "path", detect_language(F.col("path")).alias("language"))


_IGNORED = ["# note", "", "logs/", "*.tmp", "docs/*/*.md", "x/*.go"]


@query(f"SELECT doc_id, path FROM {_PATHS} WHERE NOT (regexp_matches(path, '(^|/)logs/') OR regexp_matches(path, '\\.tmp(/|$)') OR regexp_matches(path, '^docs/[^/]*/[^/]*\\.md$') OR regexp_matches(path, '^x/[^/]*\\.go$'))")
def q_ignore_filter(spark, sf):
    return _paths(spark, sf).where(~F.col("path").rlike(T.ignore_regex(_IGNORED)))


@query("SELECT p_partkey, p_name FROM part WHERE p_name GLOB '*a*e*'")
def q_glob_sql(spark, sf):
    return _t(spark, sf, "part").where(F.col("p_name").rlike(T.glob_regex("*a*e*", "sql"))).select("p_partkey", "p_name")


@query(f"SELECT doc_id, path FROM {_PATHS} WHERE regexp_matches(path, '(?i)^.*/[^/]*\\.min\\.js$')")
def q_glob_simple(spark, sf):
    return _paths(spark, sf).where(F.col("path").rlike(T.glob_regex("**/*.MIN.js", "simple")))


@query(f"SELECT doc_id, path FROM {_PATHS} WHERE prefix(path, 'lib/')")
def q_glob_prefix(spark, sf):
    return find.filtered(_paths(spark, sf).withColumnRenamed("path", "file"), file_pattern="lib/*/x*", dialect="prefix").withColumnRenamed("file", "path")


@query(f"SELECT doc_id, path FROM {_PATHS} WHERE regexp_matches(path, '^(.*/)?[^/]*[.]test[.][^/]s$')")
def q_glob_segments(spark, sf):
    return _paths(spark, sf).where(F.col("path").rlike(T.glob_regex("**/*.test.?s")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.page') AS page FROM events")
def q_json_props(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.page").alias("page"))


_SECRETS = f"(SELECT doc_id, text || chr(10) || [{', '.join(map(W.lit, W.RISKY))}][(doc_id % {len(W.RISKY)})::INTEGER + 1] AS t FROM documents)"


@query(f"SELECT doc_id, {W.redacted('t')} AS shown FROM {_SECRETS}")
def q_redact(spark, sf):
    said = F.concat(F.col("text"), F.lit("\n"), _pick(W.RISKY, F.col("doc_id")))
    return _t(spark, sf, "documents").select("doc_id", T.redact(said).alias("shown"))


@query("SELECT n_nationkey, 'v_' || regexp_replace(n_name, '[^a-zA-Z0-9_]', '_', 'g') || CASE WHEN n_regionkey = 1 THEN '' ELSE '_' || left(sha256('p' || n_regionkey), 12) END AS name FROM nation")
def q_namespace(spark, sf):
    profile = F.when(F.col("n_regionkey") != 1, F.concat(F.lit("p"), F.col("n_regionkey")))
    return _t(spark, sf, "nation").select("n_nationkey", T.namespace(F.col("n_name"), "v_", profile).alias("name"))


@query("SELECT p_partkey, p_name || '|q|auto|10|language=' || p_brand || '|' || CASE WHEN p_size % 2 = 0 THEN 'size=' || p_size || '|' ELSE '' END || 'type=' || p_type AS key FROM part")
def q_cache_key(spark, sf):
    filters = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")), F.lit("language"), F.col("p_brand"))
    return _t(spark, sf, "part").select("p_partkey", find.cache_key_of([F.col("p_name"), F.lit("q"), F.lit("auto"), F.lit("10")], filters).alias("key"))


@query(f"SELECT doc_id, array_to_string(list_filter(string_split(replace(path, '/x', '/x/..'), '/'), lambda p: p NOT IN ('.', '..', 'x')), '/') AS path FROM (SELECT doc_id, path FROM {_PATHS} WHERE prefix(path, 'build/x') OR prefix(path, 'src/'))")
def q_normalize_path(spark, sf):
    rows = _paths(spark, sf).where(F.col("path").startswith("build/x") | F.col("path").startswith("src/"))
    return rows.select("doc_id", T.normalize_path(F.replace(F.replace("path", F.lit("/x"), F.lit("/x/..")), F.lit("src/"), F.lit(".\\src\\"))).alias("path"))


@query("SELECT conv_id, turn, 'File: f' || conv_id || CASE WHEN conv_id % 2 = 0 THEN '.ts' ELSE '.py' END AS file, CASE WHEN conv_id % 2 = 0 THEN 'File: f' || conv_id || '.ts' || chr(10) || 'Lines: ' || turn || '-' || (turn + 3) || chr(10) || text ELSE text END AS said FROM conversations")
def q_embedding_text(spark, sf):
    file = F.concat(F.lit("f"), F.col("conv_id"), F.when(F.col("conv_id") % 2 == 0, ".ts").otherwise(".py"))
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("File: "), file).alias("file"), C.embedding_text(file, F.col("turn"), F.col("turn") + 3, F.col("text")).alias("said"))


# --- statistics and maintenance ----------------------------------------------------------------


def _as_chunks(spark, sf):
    return _docs(spark, sf).select(F.col("source").alias("project"), "file_path", F.col("lang").alias("language"), F.size(F.split("text", "\n", -1)).alias("end_line"))


@query("SELECT lang AS language, count(DISTINCT doc_id) AS files, count(*) AS chunks FROM documents GROUP BY 1")
def q_lang_breakdown(spark, sf):
    return tables.language_breakdown(_as_chunks(spark, sf))


@query("SELECT source AS project, count(DISTINCT doc_id) AS files, count(*) AS chunks, sum(len(string_split(text, chr(10))))::BIGINT AS total_lines, floor(count(*) / count(DISTINCT doc_id) * 10 + 0.5) / 10 AS chunks_per_file FROM documents GROUP BY 1")
def q_project_stats(spark, sf):
    return tables.project_stats(_as_chunks(spark, sf))


@query("SELECT source AS dir, count(DISTINCT doc_id) AS files FROM documents GROUP BY 1")
def q_dir_tree(spark, sf):
    return tables.dir_tree(_docs(spark, sf).select(F.col("file_path").alias("file")))


_WAS = "SELECT doc_id::VARCHAR AS file, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha1(text) END AS hash FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT 'gone-' || c_custkey, 'x' FROM customer"


@query(f"SELECT coalesce(n.file, w.file) AS file, CASE WHEN w.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'deleted' WHEN n.hash <> w.hash THEN 'changed' ELSE 'unchanged' END AS status FROM (SELECT doc_id::VARCHAR AS file, sha1(text) AS hash FROM documents) n FULL JOIN ({_WAS}) w ON n.file = w.file")
def q_change_detect(spark, sf):
    now = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), F.sha1(F.col("text").cast("binary")).alias("hash"), "doc_id")
    was = now.where("doc_id % 5 <> 0").select("file", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    was = was.unionByName(_t(spark, sf, "customer").select(F.concat(F.lit("gone-"), F.col("c_custkey")).alias("file"), F.lit("x").alias("hash")))
    return tables.changes(now.select("file", "hash"), was)


@query(f"SELECT w.file FROM ({_WAS}) w WHERE w.file NOT IN (SELECT doc_id::VARCHAR FROM documents)")
def q_deleted_files(spark, sf):
    return q_change_detect(spark, sf).where("status = 'deleted'").select("file")


@query("SELECT o_orderkey, 0::DOUBLE AS o_totalprice FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, o_totalprice::DOUBLE FROM orders WHERE o_orderstatus <> 'O'")
def q_upsert(spark, sf):
    old = _t(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus")
    new = old.where("o_orderstatus = 'O'").select("o_orderkey", F.lit(0.0).alias("o_totalprice"))
    return tables.upsert(old.drop("o_orderstatus"), new, ["o_orderkey"])


@query("SELECT l_orderkey, arg_max(l_partkey, l_shipdate::VARCHAR || lpad(l_linenumber::VARCHAR, 9, '0')) AS l_partkey FROM lineitem GROUP BY 1")
def q_insert_latest(spark, sf):
    # arg_max keeps the first row of equal ones, in the table's order
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_linenumber", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return tables.latest(rows, ["l_orderkey"], ["l_shipdate", "l_linenumber"], ["_file", "_at"]).select("l_orderkey", "l_partkey")


@query("SELECT doc_id, doc_id % 3 = 0 AS gone FROM documents")
def q_delete_files(spark, sf):
    rows = _t(spark, sf, "documents").select(F.col("source").alias("project"), F.col("doc_id").alias("file"))
    kept, gone = tables.delete_files(rows, rows.where("file % 3 = 0"))
    return kept.select(F.col("file").alias("doc_id"), F.lit(False).alias("gone")).union(gone.select("file", F.lit(True)))


@query("SELECT 'chunks' AS held, count(*) AS n FROM documents WHERE source <> 'src3' UNION ALL SELECT 'pages', count(*) FROM pages WHERE page_id % 4 <> 0")
def q_delete_project(spark, sf):
    held = {"chunks": _t(spark, sf, "documents").select(F.col("source").alias("project")), "pages": _t(spark, sf, "pages").select(F.when(F.col("page_id") % 4 == 0, "src3").otherwise("other").alias("project"))}
    left = tables.delete_project(held, "src3")
    return left["chunks"].agg(F.count("*").alias("n")).select(F.lit("chunks").alias("held"), "n").union(left["pages"].agg(F.count("*").alias("n")).select(F.lit("pages"), "n"))


@query("SELECT c_custkey AS project, CASE WHEN c_mktsegment = 'BUILDING' THEN 'incremental' ELSE 'rebuild' END AS action FROM customer")
def q_profile_gate(spark, sf):
    return tables.profile_gate(_t(spark, sf, "customer").select(F.col("c_custkey").alias("project"), F.col("c_mktsegment").alias("profile")), "BUILDING")


@query("SELECT coalesce(c.project, v.project) AS project, coalesce(chunks, 0) AS chunks, coalesce(vectors, 0) AS vectors, CASE WHEN coalesce(chunks, 0) = coalesce(vectors, 0) THEN 'match' ELSE 'mismatch' END AS relation FROM (SELECT source AS project, count(*) AS chunks FROM documents GROUP BY 1) c FULL JOIN (SELECT 'src' || (vec_id % 25) AS project, count(*) AS vectors FROM embeddings GROUP BY 1) v ON c.project = v.project")
def q_index_parity(spark, sf):
    vectors = _t(spark, sf, "embeddings").select(F.concat(F.lit("src"), F.col("vec_id") % 25).alias("project"))
    return overview.index_parity(_t(spark, sf, "documents").select(F.col("source").alias("project")), vectors)


@query("SELECT doc_id AS file, CASE WHEN doc_id % 5 = 0 THEN 'missing_or_excluded' WHEN doc_id % 7 = 0 THEN 'unverified' WHEN doc_id % 3 = 0 THEN 'stale' ELSE 'fresh' END AS freshness FROM documents")
def q_freshness(spark, sf):
    rows = _t(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.sha1(F.col("text").cast("binary")).alias("hash"))
    indexed = rows.where("file % 7 <> 0").withColumn("hash", F.when(F.col("file") % 3 == 0, "old").otherwise(F.col("hash")))
    return overview.freshness(rows.select("file"), rows.where("file % 5 <> 0"), indexed)


@query("SELECT event_type, quantile_disc(value, 0.95) AS value, count(*) AS n FROM events GROUP BY 1")
def q_p95(spark, sf):
    return tables.percentile(_t(spark, sf, "events"), "value", 0.95, ["event_type"])


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def q_timings(spark, sf):
    return tables.timings(_t(spark, sf, "events"), ["event_type"], "value")


@query("SELECT source AS file FROM documents UNION SELECT url FROM pages")
def q_project_files_union(spark, sf):
    return _t(spark, sf, "documents").select(F.col("source").alias("file")).union(_t(spark, sf, "pages").select("url")).distinct()


_SYMBOLS = "(SELECT p_partkey::VARCHAR AS id, replace(p_name, ' ', '_') AS name, ['function', 'class', 'method', 'variable'][(p_partkey % 4)::INTEGER + 1] AS kind, 'f' || p_size || '.ts' AS file, (p_partkey % 400)::BIGINT AS line, p_partkey % 2 = 0 AS exported FROM part)"


def _symbols(spark, sf):
    k = F.col("p_partkey")
    return _t(spark, sf, "part").select(k.cast("string").alias("id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), _pick(["function", "class", "method", "variable"], k).alias("kind"), F.concat(F.lit("f"), F.col("p_size"), F.lit(".ts")).alias("file"), (k % 400).alias("line"), (k % 2 == 0).alias("exported"))


@query(f"SELECT id, name, file, line FROM {_SYMBOLS} WHERE contains(lower(name), 'red_bolt') ORDER BY CASE WHEN lower(name) = 'red_bolt' THEN 0 ELSE 1 END, file, line, id LIMIT 50")
def q_symbol_lookup(spark, sf):
    return tables.symbol_lookup(_symbols(spark, sf), "RED_bolt").select("id", "name", "file", "line")


@query(f"SELECT kind, count(*) AS n FROM (SELECT kind FROM {_SYMBOLS} UNION ALL SELECT 'export' FROM {_SYMBOLS} WHERE exported) GROUP BY 1")
def q_symbol_kind_counts(spark, sf):
    return tables.symbol_kind_counts(_symbols(spark, sf))


@query(f"""WITH m AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN lower(name) = 'bolt' THEN 0 ELSE 1 END, file, line, id) AS place FROM {_SYMBOLS} WHERE contains(lower(name), 'bolt') QUALIFY place <= 200),
c AS (SELECT DISTINCT file, line // 40 AS chunk_index FROM {_SYMBOLS}), p AS (SELECT m.*, chunk_index FROM m JOIN c ON m.file = c.file AND m.line // 40 = chunk_index QUALIFY row_number() OVER (PARTITION BY m.file ORDER BY place) = 1)
SELECT file, chunk_index, name AS symbol, 1 / row_number() OVER (ORDER BY place) AS score FROM p QUALIFY row_number() OVER (ORDER BY place) <= 10""")
def q_symbol_search(spark, sf):
    symbols = _symbols(spark, sf)
    chunks = symbols.select("file", F.floor(F.col("line") / 40).alias("chunk_index")).distinct().withColumns({"start_line": F.col("chunk_index") * 40, "end_line": F.col("chunk_index") * 40 + 39})
    return find.symbol_search(symbols, chunks, "bolt").select("file", "chunk_index", "symbol", "score")


@query(f"SELECT file, string_agg(name, ',' ORDER BY line, name) AS names FROM (SELECT * FROM {_SYMBOLS} ORDER BY file, line, name LIMIT 30) GROUP BY file ORDER BY file LIMIT 20")
def q_exports_by_file(spark, sf):
    return overview.exports_by_file(_symbols(spark, sf)).select("file", F.array_join("names", ",").alias("names"))


@query("SELECT doc_id, source AS file FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def q_symbol_kind_semi(spark, sf):
    good = _t(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("file"), F.lit("good").alias("kind"), F.lit(True).alias("exported"))
    hits = _t(spark, sf, "documents").select(F.col("doc_id").alias("file"), "source")
    return tables.symbol_kind_filter(hits, good, "good").select(F.col("file").alias("doc_id"), F.col("source").alias("file"))


_SPANS = "SELECT l_orderkey AS file, l_linenumber AS chunk_index, l_linenumber * 10 AS start_line, l_linenumber * 10 + 15 AS end_line FROM lineitem"


@query(f"SELECT p.file, p.line, min(c.chunk_index)::BIGINT AS chunk_index FROM (SELECT o_orderkey AS file, (o_custkey % 80)::BIGINT AS line FROM orders) p LEFT JOIN ({_SPANS}) c ON p.file = c.file AND p.line BETWEEN start_line AND end_line GROUP BY 1, 2")
def q_symbol_chunk_range(spark, sf):
    spans = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("chunk_index"), (F.col("l_linenumber") * 10).cast("long").alias("start_line"), (F.col("l_linenumber") * 10 + 15).cast("long").alias("end_line"))
    points = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 80).cast("long").alias("line"))
    return tables.chunk_of_line(points, spans)


@query("SELECT h.l_orderkey AS file, h.l_linenumber AS chunk_index, n.l_orderkey || ':' || n.l_linenumber AS node_id FROM lineitem h JOIN lineitem n ON h.l_orderkey = n.l_orderkey AND h.l_linenumber * 50 <= n.l_partkey % 300 + n.l_linenumber * 30 AND n.l_partkey % 300 <= h.l_linenumber * 50 + 70")
def q_overlap_join(spark, sf):
    rows = _t(spark, sf, "lineitem")
    n = F.col("l_linenumber").cast("long")
    hits = rows.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("chunk_index"), (n * 50).alias("start_line"), (n * 50 + 70).alias("end_line"))
    nodes = rows.select(F.col("l_orderkey").alias("file"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_partkey") % 300).alias("start_line"), (F.col("l_partkey") % 300 + n * 30).alias("end_line"))
    return tables.overlaps(hits, nodes).select("file", "chunk_index", "node_id")


@query("SELECT query_id, doc_id, used FROM (SELECT source AS query_id, doc_id, sum(length(text) // 4) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used FROM documents) WHERE used <= 4000")
def q_token_budget(spark, sf):
    rows = _t(spark, sf, "documents").select(F.col("source").alias("query_id"), "doc_id", F.floor(F.length("text") / 4).alias("tokens"))
    return tables.token_budget(rows, 4000, "doc_id").select("query_id", "doc_id", "used")


@query(f"SELECT doc_id, arg_max(project, length(root)) AS project FROM (SELECT doc_id, {PATH} AS path FROM documents) LEFT JOIN (SELECT DISTINCT 'p:' || source AS project, source AS root FROM documents UNION ALL SELECT DISTINCT 'l:' || source, source || '/en' FROM documents) ON path = root OR starts_with(path, root || '/') GROUP BY 1")
def q_workspace_resolve(spark, sf):
    docs = _docs(spark, sf)
    sources = docs.select("source").distinct()
    roots = sources.select(F.concat(F.lit("p:"), F.col("source")).alias("project"), F.col("source").alias("root")).union(sources.select(F.concat(F.lit("l:"), F.col("source")), F.concat(F.col("source"), F.lit("/en"))))
    return tables.workspace_resolve(docs.select(F.col("file_path").alias("path")), roots).join(docs.select("doc_id", F.col("file_path").alias("path")), "path").select("doc_id", "project")


@query(f"SELECT DISTINCT path AS file FROM (SELECT CASE doc_id % 6 WHEN 0 THEN 'src/index.ts' WHEN 1 THEN 'cmd/m' || doc_id || '/main.go' WHEN 2 THEN 'lib/app.ts' WHEN 3 THEN 'manage.py' WHEN 4 THEN 'src/server.jsx' ELSE 'src/lib.rs' || doc_id END AS path FROM documents) WHERE path IN ('src/index.ts', 'manage.py', 'src/server.jsx') OR (prefix(path, 'cmd/') AND suffix(path, '.go'))")
def q_entry_points(spark, sf):
    k = F.col("doc_id")
    named = F.when(k % 6 == 0, F.lit("src/index.ts")).when(k % 6 == 1, F.concat(F.lit("cmd\\m"), k, F.lit("\\main.go"))).when(k % 6 == 2, F.lit("lib/app.ts")).when(k % 6 == 3, F.lit("manage.py")).when(k % 6 == 4, F.lit("src/server.jsx")).otherwise(F.concat(F.lit("src/lib.rs"), k))
    return overview.entry_points(_t(spark, sf, "documents").select(named.alias("file")))


def _said(pairs, test) -> str:
    return " ".join(f"WHEN {test(names)} THEN {W.lit(said)}" for names, said in pairs)


_PURPOSE = (
    "CASE " + _said(overview.DIRECTORY_PURPOSES, lambda n: f"d IN ({', '.join(map(W.lit, n))})") + " " + _said(overview.NAME_PURPOSES, lambda n: " OR ".join(f"contains(lower(n), {W.lit(x)})" for x in n))
    + " WHEN c AND f THEN 'Module with classes and utility functions.' WHEN c THEN 'Class definitions.' WHEN f THEN 'Function library.' ELSE language || ' module.' END"
)


@query(f"SELECT path AS file, {_PURPOSE} AS purpose FROM (SELECT path, n, regexp_extract(lower(path), '(?:^|/)([^/]*)/[^/]*$', 1) AS d, {_LANGUAGE} AS language, bool_or(doc_id % 3 = 0) AS c, bool_or(doc_id % 3 = 1) AS f FROM {_NAMES_OF} GROUP BY path, n, e)")
def q_infer_purpose(spark, sf):
    rows = _paths(spark, sf).select("doc_id", F.col("path").alias("file"), detect_language(F.col("path")).alias("language"))
    exports = rows.where("doc_id % 3 < 2").select("file", F.when(F.col("doc_id") % 3 == 0, "class").otherwise("function").alias("kind"))
    return overview.infer_purposes(rows.select("file", "language").distinct(), exports)


@query("""WITH f AS (SELECT 'src/m' || doc_id || '.ts' AS file FROM documents UNION ALL SELECT 'src/m' || doc_id || '.test.ts' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'src/m' || doc_id || '.spec.js' FROM documents WHERE doc_id % 5 = 0),
t AS (SELECT 'src/m' || doc_id || '.ts' AS file, 'src/m' || doc_id AS base FROM documents), e AS (SELECT 'src/__tests__/t' || doc_id || '.ts' AS test, 'src/m' || (doc_id // 20) || '.ts' AS file FROM documents),
a AS (SELECT t.file, f.file AS test, 0 AS p FROM t JOIN f ON f.file IN (base || '.test.ts', base || '.spec.js') UNION ALL SELECT e.file, test, 1 FROM e JOIN t USING (file))
SELECT file, test, row_number() OVER (PARTITION BY file ORDER BY p, test)::INTEGER AS "at" FROM a QUALIFY "at" <= 10""")
def q_test_files(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id")
    name = lambda head, tail, k="doc_id": F.concat(F.lit(head), F.col(k), F.lit(tail)).alias("file")
    targets = docs.select(name("src/m", ".ts"))
    files = targets.union(docs.where("doc_id % 3 = 0").select(name("src/m", ".test.ts"))).union(docs.where("doc_id % 5 = 0").select(name("src/m", ".spec.js")))
    edges = docs.withColumn("d", F.floor(F.col("doc_id") / 20)).select(name("src/__tests__/t", ".ts").alias("source"), name("src/m", ".ts", "d").alias("target"))
    return overview.test_files(targets, files, edges)


@query("SELECT c_custkey, 'react,p' || (c_custkey % 3) || CASE WHEN c_custkey % 3 = 1 THEN ',vitest' ELSE ',vitest,p1' END AS stack FROM customer")
def q_tech_stack(spark, sf):
    manifest = F.concat(F.lit('{"dependencies":{"react":"^18","p'), F.col("c_custkey") % 3, F.lit('":"1"},"devDependencies":{"vitest":"1","react":"2","p1":"3"}}'))
    return _t(spark, sf, "customer").select("c_custkey", F.array_join(overview.tech_stack(manifest), ",").alias("stack"))


_LOCATED = {1: "doc_17", 2: "src3\\\\en\\\\doc_3", 3: "red_bolt", 4: "the of and"}


@query(_BM25 + _RANKED + f""", asked AS (SELECT * FROM {W.values(list(_LOCATED.items()), 'query_id, query')}),
files AS (SELECT doc_id, {PATH} AS file FROM documents),
every AS (SELECT query_id, file, 1::BIGINT AS line, NULL AS symbol, 'file' AS origin, 0 AS s, 0 AS o FROM asked JOIN files ON file = replace(query, chr(92), '/') OR regexp_extract(file, '[^/]*$') = query
UNION ALL SELECT query_id, file, line, name, 'symbol_index', 1, CASE WHEN lower(name) = lower(query) THEN 0 ELSE 1 END FROM asked JOIN {_SYMBOLS} ON contains(lower(name), lower(query)) WHERE regexp_matches(query, '^[a-zA-Z0-9_$]+$')
UNION ALL SELECT 4, file, 1, NULL, 'keyword', 2, rank FROM r JOIN files USING (doc_id) WHERE query_id = 1 AND rank <= 50),
kept AS (SELECT query_id, file, line, symbol, origin, min(o) AS o FROM every WHERE (query_id, s) IN (SELECT (query_id, min(s)) FROM every GROUP BY query_id) GROUP BY ALL)
SELECT query_id::BIGINT AS query_id, file, line, symbol, origin, row_number() OVER (PARTITION BY query_id ORDER BY o, file, line, symbol)::INTEGER AS "at" FROM kept QUALIFY "at" <= 8""")
def q_locate(spark, sf):
    docs = _docs(spark, sf)
    words = retrieval.keyword_search(docs, {4: SEARCHES[1]}, 50, False, file="file_path").join(docs.select("doc_id", F.col("file_path").alias("file")), "doc_id").withColumn("line", F.lit(1))
    asked = _values(spark, "query_id long, query string", list(_LOCATED.items()))
    return overview.locate(asked, docs.select(F.col("file_path").alias("file")), _symbols(spark, sf), words).select("query_id", "file", "line", "symbol", "origin", "at")


@query("SELECT file, CASE WHEN score <= 5 THEN 'Low' WHEN score <= 15 THEN 'Medium' WHEN score <= 30 THEN 'High' ELSE 'Very High' END AS level, score FROM (SELECT doc_id AS file, (2 * (doc_id % 4) + doc_id % 3 + floor(len(string_split(text, chr(10))) / 50) + 1)::BIGINT AS score FROM documents)")
def q_file_complexity(spark, sf):
    files = _t(spark, sf, "documents").select(F.col("doc_id").alias("file"), (F.col("doc_id") % 4).alias("exports"), (F.col("doc_id") % 3).alias("imports"), F.size(F.split("text", "\n", -1)).alias("lines"), F.lit(1).alias("chunks"))
    return tables.file_complexity(files).select("file", "level", "score")


# --- graphs ------------------------------------------------------------------------------------


def _edges(spark, sf):
    """Nations import their region, customers their nation, orders their customer."""
    n = _t(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("source"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("target"))
    c = _t(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("source"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("target"))
    o = _t(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("source"), F.concat(F.lit("c"), F.col("o_custkey")).alias("target"))
    return n.union(c).union(o)


_EDGES = "edges AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"


@query(f"WITH {_EDGES} SELECT target, source FROM edges WHERE source IN (SELECT 'c' || c_custkey FROM customer)")
def q_dependencies(spark, sf):
    return graph.dependencies(_edges(spark, sf), _t(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("file"))).select("target", "source")


@query(f"WITH {_EDGES} SELECT target, source FROM edges WHERE target IN ('n1', 'n2', 'c5')")
def q_dependents(spark, sf):
    return graph.dependents(_edges(spark, sf), _values(spark, "file string", [("n1",), ("n2",), ("c5",)])).select("target", "source")


@query(f"WITH RECURSIVE {_EDGES}, walk AS (SELECT 'r1' AS file, 0 AS depth UNION SELECT e.source, w.depth + 1 FROM walk w JOIN edges e ON e.target = w.file WHERE w.depth < 3) SELECT file, min(depth)::INTEGER AS depth FROM walk WHERE depth > 0 GROUP BY file")
def q_impact_bfs(spark, sf):
    return graph.impact(_edges(spark, sf), _values(spark, "file string", [("r1",)]), 3)


@query(f"WITH {_EDGES} SELECT e.source, e.target, n.n_name AS target_name FROM edges e JOIN nation n ON e.target = 'n' || n.n_nationkey")
def q_callers(spark, sf):
    nodes = _t(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"))
    edges = _edges(spark, sf).withColumn("kind", F.when(F.col("target").startswith("n"), "CALLS").otherwise("IMPORTS"))
    return graph.callers(edges, nodes, ["CALLS"]).select("source", "target", "target_name")


@query(f"WITH {_EDGES} SELECT e.source, e.target, n.c_name AS target_name FROM edges e LEFT JOIN customer n ON e.target = 'c' || n.c_custkey WHERE prefix(e.target, 'c')")
def q_references(spark, sf):
    nodes = _t(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"))
    edges = _edges(spark, sf).withColumn("kind", F.when(F.col("target").startswith("c"), "REFERENCES").otherwise("CALLS"))
    return graph.callers(edges, nodes, ["REFERENCES"]).select("source", "target", "target_name")


def _placed(spark, sf):
    """Nodes and edges of the star with places; an edge stands at its source."""
    e = _edges(spark, sf)
    edges = e.select(F.concat_ws(">", "source", "target").alias("id"), F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("CALLS").alias("kind"), F.col("source").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.col("target").alias("target_name"), F.lit("resolved").alias("resolution"))
    nodes = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    return nodes.select("id", F.col("id").alias("file"), F.col("id").alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit(1).alias("column"), F.lit("").alias("signature")), edges


@query(f"WITH {_EDGES} SELECT source || '>' || target AS id, source AS file FROM edges WHERE source IN ('n3', 'c7') OR target IN ('n3', 'c7') ORDER BY source, target LIMIT 60")
def q_graph_edges(spark, sf):
    _, edges = _placed(spark, sf)
    return code_graph.find_edges(edges, _values(spark, "id string", [("n3",), ("c7",)]), limit=60).select("id", "file")


@query(f"WITH {_EDGES} SELECT DISTINCT n AS id FROM (SELECT source AS n FROM edges UNION SELECT target FROM edges) WHERE n = 'n3'")
def q_graph_nodes(spark, sf):
    return code_graph.find_nodes(_placed(spark, sf)[0], symbol="n3").select("id")


@query(f"WITH {_EDGES}, near AS (SELECT source || '>' || target AS id, source, row_number() OVER (ORDER BY source, target) AS place FROM edges WHERE source = 'n1' OR target = 'n1') SELECT id, (SELECT count(*) FROM near) > 39 AS truncated FROM near WHERE place <= 39")
def q_graph_traverse(spark, sf):
    """All edges of one nation, each with another end: with the nation itself, forty nodes."""
    nodes, edges = _placed(spark, sf)
    _, met, truncated = code_graph.traverse(nodes, edges, _values(spark, "id string", [("n1",)]), 1)
    return _values(spark, "id string, truncated boolean", [(e.id, truncated) for e in met])


@query(f"WITH RECURSIVE {_EDGES}, walk AS (SELECT 'n1' AS file, 0 AS depth UNION SELECT e.source, w.depth + 1 FROM walk w JOIN edges e ON e.target = w.file WHERE w.depth < 3) SELECT file, min(depth)::INTEGER AS depth FROM walk GROUP BY file")
def q_impact_set(spark, sf):
    return overview.impact_set(_edges(spark, sf), _values(spark, "file string", [("n1",)]))


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM nation) AS nodes, count(*) AS edges, count(*) FILTER (WHERE target IS NULL) AS unresolved FROM edges")
def q_graph_counts(spark, sf):
    return graph.graph_counts(_t(spark, sf, "nation"), _edges(spark, sf))


_ASKED_IMPORTS = """(SELECT 'src/n' || c_nationkey || '/c' || c_custkey || '.ts' AS source, CASE c_custkey % 6 WHEN 0 THEN './c' || (c_custkey + 25) WHEN 1 THEN '../n' || ((c_nationkey + 1) % 25) || '/c' || (c_custkey + 1) || '.js'
WHEN 2 THEN './lib' WHEN 3 THEN 'react' WHEN 4 THEN './none' ELSE './c' || c_custkey || '.ts' END AS specifier FROM customer)"""


@query(f"""WITH i AS (SELECT source, specifier, CASE WHEN prefix(specifier, './') THEN regexp_extract(source, '^(.*)/', 1) || substr(specifier, 2) ELSE 'src' || substr(specifier, 3) END AS whole, prefix(specifier, '.') AS near FROM {_ASKED_IMPORTS}),
f AS (SELECT 'src/n' || c_nationkey || '/c' || c_custkey || '.ts' AS file FROM customer UNION SELECT 'src/n' || n_nationkey || '/lib/index.ts' FROM nation UNION SELECT 'src/n' || n_nationkey || '/lib.jsx' FROM nation WHERE n_nationkey % 2 = 0),
t AS (SELECT *, regexp_replace(whole, '[.]js$', '') AS stem, ['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs'] AS x FROM i WHERE near),
u AS (SELECT source, specifier, flatten([[whole, stem], flatten(list_transform(x, lambda e: [stem || e, whole || e])), flatten(list_transform(x, lambda e: [whole || '/index' || e, stem || '/index' || e]))]) AS tried FROM t),
v AS (SELECT source, specifier, unnest(tried) AS file, generate_subscripts(tried, 1) AS place FROM u), b AS (SELECT source, specifier, arg_min(file, place) AS target FROM v WHERE file IN (SELECT file FROM f) GROUP BY 1, 2)
SELECT i.source, i.specifier, target FROM i LEFT JOIN b ON i.source = b.source AND i.specifier = b.specifier""")
def q_resolve_import(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    source = F.concat(F.lit("src/n"), n, F.lit("/c"), k, F.lit(".ts"))
    asked = F.when(k % 6 == 0, F.concat(F.lit("./c"), k + 25)).when(k % 6 == 1, F.concat(F.lit("../n"), (n + 1) % 25, F.lit("/c"), k + 1, F.lit(".js"))).when(k % 6 == 2, F.lit("./lib")).when(k % 6 == 3, F.lit("react")).when(k % 6 == 4, F.lit("./none")).otherwise(F.concat(F.lit("./c"), k, F.lit(".ts")))
    customers, nations = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    index = lambda end: F.concat(F.lit("src/n"), F.col("n_nationkey"), F.lit(end)).alias("file")
    files = customers.select(source.alias("file")).union(nations.select(index("/lib/index.ts"))).union(nations.where("n_nationkey % 2 = 0").select(index("/lib.jsx")))
    return graph.resolve_imports(customers.select(source.alias("source"), asked.alias("specifier")), files).select("source", "specifier", "target")


def _sources(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{k}"), k.cast("string")), F.lit("{n}"), n.cast("string"))
    by = lambda f: F.coalesce(*(F.when(k % 4 == i, f(v)) for i, v in W.SOURCES.items()))
    named = by(lambda v: F.concat(F.lit("m"), n, F.lit("/f"), k, F.lit("." + v[1])))
    return _t(spark, sf, "customer").select(named.alias("file"), by(lambda v: F.lit(v[0])).alias("language"), by(lambda v: fill(v[2])).alias("text"))


_SOURCE_LINES = f"WITH src AS ({W.sources_sql()}), l AS (SELECT file, language, unnest(range(1, len(string_split(text, chr(10))) + 1))::BIGINT AS line, unnest(string_split(text, chr(10))) AS raw, trim(unnest(string_split(text, chr(10))), ' \t') AS s FROM src)"


def _when(pattern: str, then: str, c: str = "s") -> str:
    return f"WHEN regexp_matches({c}, {W.lit(pattern)}) THEN {then}"


def _got(pattern: str, n: int = 1, c: str = "s") -> str:
    return f"regexp_extract({c}, {W.lit(pattern)}, {n})"


@query(_SOURCE_LINES + f""", i AS (SELECT file, line, CASE WHEN language = 'python' THEN CASE {_when(extract.PYTHON_FROM, _got(extract.PYTHON_FROM))} {_when(extract.PYTHON_IMPORT, _got(extract.PYTHON_IMPORT))} END
WHEN language = 'rust' THEN CASE {_when(extract.RUST_USE, "regexp_replace(" + _got(extract.RUST_USE) + ", '::$', '')")} {_when(extract.RUST_MOD, _got(extract.RUST_MOD))} END
WHEN language = 'java' THEN CASE {_when(extract.JAVA_IMPORT, _got(extract.JAVA_IMPORT))} END END AS specifier,
CASE WHEN language = 'python' AND regexp_matches(s, {W.lit(extract.PYTHON_FROM)}) THEN list_transform(string_split({_got(extract.PYTHON_FROM, 2)}, ','), lambda x: regexp_replace(trim(x), ' as .*', ''))
WHEN language = 'rust' AND {_got(extract.RUST_USE, 2)} <> '' THEN list_transform(string_split({_got(extract.RUST_USE, 2)}, ','), lambda x: trim(x)) END AS names FROM l)
SELECT file, line, specifier, array_to_string(names, ',') AS names, 'static' AS kind FROM i WHERE specifier IS NOT NULL
UNION ALL SELECT file, NULL, unnest(list_concat(regexp_extract_all(text, {W.lit(extract.GO_IMPORT)}, 1), regexp_extract_all(regexp_extract(text, {W.lit(extract.GO_BLOCK)}, 1), '"([^"]+)"', 1))), NULL, 'static' FROM src WHERE language = 'go'""")
def q_parse_imports(spark, sf):
    return extract.parse_imports(_sources(spark, sf)).withColumn("names", F.array_join("names", ","))


_EXPORT_CASES = " ".join(f"WHEN language = '{lang}' THEN CASE {' '.join(_when(p, f'[{W.lit(kind)}, {_got(p)}]') for kind, p in forms)} END" for lang, forms in extract.EXPORTS.items())


@query(_SOURCE_LINES + f""", e AS (SELECT file, line, CASE WHEN language = 'python' AND NOT regexp_matches(raw, '^[ \t]') THEN CASE {_when(extract.PYTHON_DEF, f"['function', {_got(extract.PYTHON_DEF)}]")} {_when(extract.PYTHON_CLASS, f"['class', {_got(extract.PYTHON_CLASS)}]")} END {_EXPORT_CASES} END AS x FROM l)
SELECT file, x[2] AS name, x[1] AS kind, line FROM e WHERE x IS NOT NULL AND NOT (prefix(x[2], '_') AND suffix(file, '.py'))""")
def q_parse_exports(spark, sf):
    return extract.parse_exports(_sources(spark, sf))


@query(_SOURCE_LINES + f""", e AS (SELECT file, line, s, CASE {_when(extract.PYTHON_DEF, f"['function', {_got(extract.PYTHON_DEF)}]")} {_when(extract.PYTHON_CLASS, f"['class', {_got(extract.PYTHON_CLASS)}]")} END AS x FROM l WHERE language = 'python' AND NOT regexp_matches(raw, '^[ \t]'))
SELECT sha256('p|' || file || '|' || x[2] || '|' || line || '|' || x[1]) AS id, file, x[2] AS name, x[1] AS kind, line, s AS signature, true AS exported FROM e WHERE x IS NOT NULL""")
def q_symbols(spark, sf):
    return extract.extract_symbols(_sources(spark, sf), "p").select("id", "file", "name", "kind", "line", "signature", "exported")


@query()
def q_code_graph(spark, sf):
    """All edges of the symbol graph of the derived sources."""
    return code_graph.analyse(_sources(spark, sf))[1]


@query("SELECT source AS project, count(*) AS files, bit_xor(('0x' || substr(sha256(doc_id::VARCHAR || '|' || sha1(text)), 1, 15))::BIGINT) AS mark FROM documents GROUP BY 1")
def q_fingerprint(spark, sf):
    rows = _t(spark, sf, "documents").select(F.col("source").alias("project"), F.col("doc_id").cast("string").alias("file"), F.sha1(F.col("text").cast("binary")).alias("hash"))
    return graph.fingerprint(rows, "project")


# --- rules, conversations, events, commits, chunks ---------------------------------------------


def _risky(spark, sf):
    """Documents, pages, and files of customers on which rules fire."""
    docs = _t(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("file"), "text")
    pages = _t(spark, sf, "pages").select(F.concat(F.lit("page/"), F.col("page_id")).alias("file"), F.col("html").alias("text"))
    k = F.col("c_custkey")
    made = _t(spark, sf, "customer").select(F.concat(F.lit("app/"), k, F.when(k % 9 == 0, ".pem").otherwise(".py")).alias("file"), F.concat(F.lit("first\n"), _pick(W.RISKY, k), F.lit("\nlast "), F.col("c_name")).alias("text"))
    return docs.union(pages).union(made)


_RISKY = f"SELECT 'doc/' || doc_id AS file, text FROM documents UNION ALL SELECT 'page/' || page_id, html FROM pages UNION ALL SELECT 'app/' || c_custkey || CASE WHEN c_custkey % 9 = 0 THEN '.pem' ELSE '.py' END, 'first' || chr(10) || [{', '.join(map(W.lit, W.RISKY))}][(c_custkey % {len(W.RISKY)})::INTEGER + 1] || chr(10) || 'last ' || c_name FROM customer"
_FOUND = W.rule_hits(_RISKY)


@query(_FOUND + " SELECT rule || ':' || file || ':' || line AS id, file, line::BIGINT AS line, category, rule, CASE kind WHEN 'candidate' THEN 'needs_review' ELSE kind END AS status, priority FROM found")
def q_security_scan(spark, sf):
    return rules.scan(_risky(spark, sf)).select("id", "file", "line", "category", "rule", "status", "priority")


_SCORED = " + ".join(f"CASE WHEN contains(lower(concat_ws(' ', file, category, title, {W.redacted('s')})), '{w}') THEN 20 ELSE 0 END" for w in rules.query_words("Password token boundary"))


@query(_FOUND.replace("SELECT file, line, rule, category, priority, kind", "SELECT file, line, rule, category, priority, kind, s") + f", f AS (SELECT found.*, title FROM found JOIN {W.values([(r[0], r[3]) for r in rules.RULES], 'rule, title')} USING (rule) WHERE prefix(file, 'app/')), g AS (SELECT file, 'first' || chr(10) || s || chr(10) AS s, line, rule, category, title, priority FROM f WHERE line = 2) SELECT file, rule, (priority + {_SCORED})::BIGINT AS score FROM g")
def q_security_rank(spark, sf):
    """Scores over the derived files, whose second lines the rules meet; their names hold no query word."""
    found = rules.scan(_risky(spark, sf), file_pattern="app/**").where("line = 2")
    return rules.scored(found, "Password token boundary").select("file", "rule", "score")


_STEPS = W.values([(r[1], s) for r in rules.RULES for s in r[7]], "category, step")


@query(_FOUND + f", n AS (SELECT category, count(*) AS steps FROM {_STEPS} GROUP BY 1) SELECT category, count(*) AS evidence, count(DISTINCT file) AS files, max(priority) AS score, any_value(steps)::INTEGER AS steps, false AS executed FROM found JOIN n USING (category) GROUP BY 1")
def q_security_plan(spark, sf):
    return rules.plan(rules.scan(_risky(spark, sf))).select("category", "evidence", "files", "score", F.size("validation").alias("steps"), "executed")


@query(f"SELECT count(*) AS indexed_files, count(*) AS scoped_files, count(*) FILTER (WHERE NOT suffix(file, '.pem')) AS scanned_files, count(*) FILTER (WHERE suffix(file, '.pem')) AS skipped_files, sum(CASE WHEN suffix(file, '.pem') THEN 0 ELSE len(string_split(text, chr(10))) END)::BIGINT AS lines, sum(CASE WHEN suffix(file, '.pem') THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda s: length(s) > 16000)) END)::BIGINT AS long_lines, sum(CASE WHEN suffix(file, '.pem') THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda s: length(s) > 16000)) END) > 0 AS truncated FROM ({_RISKY})")
def q_security_coverage(spark, sf):
    return rules.coverage(_risky(spark, sf))


def _entries(spark, sf):
    return _t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("thread"), F.col("event_type").alias("project"), F.lit("tool-auto").alias("source"), F.lit("system").alias("role"), F.col("props").alias("content"), F.col("ts").alias("created_at"))


@query("SELECT sha256('p|' || conv_id || '|' || turn || '|' || role || '|' || text) AS id, conv_id AS thread, turn, CASE WHEN role = 'user' THEN 'user-message' ELSE 'ai-response' END AS source, role FROM conversations")
def q_chat_ingest(spark, sf):
    rows = _t(spark, sf, "conversations").select(F.col("conv_id").alias("thread"), "turn", "role", F.col("text").alias("content"), F.lit(None).cast("timestamp").alias("created_at"))
    return chat.ingest(rows, "p").select("id", "thread", "turn", "source", "role")


@query(f"SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 168 HOUR")
def q_chat_recent(spark, sf):
    return chat.recent(_entries(spark, sf), F.to_timestamp(F.lit(NOW)), 168).select("id")


@query(f"SELECT event_id AS id, event_type = 'error' AND ts < TIMESTAMP '{NOW}' - INTERVAL 48 HOUR AS gone FROM events")
def q_chat_clear(spark, sf):
    kept, gone = chat.cleared(_entries(spark, sf), "error", F.to_timestamp(F.lit(NOW)), hours=48)
    return kept.select("id", F.lit(False).alias("gone")).union(gone.select("id", F.lit(True)))


@query("SELECT event_type AS project, arg_max(user_id, (epoch_us(ts), user_id)) AS thread FROM (SELECT event_type, user_id, max(ts) AS ts FROM events GROUP BY 1, 2) GROUP BY 1 HAVING epoch_us(TIMESTAMP '2024-01-31 00:00:00') - max(epoch_us(ts)) < 3600000000 * 6")
def q_latest_thread(spark, sf):
    rows = _entries(spark, sf)
    # A thread belongs to one project; here users have one thread in each.
    own = rows.withColumn("thread", F.concat_ws("|", F.lpad(F.col("thread").cast("string"), 9, "0"), "project"))
    out = chat.latest_thread(own, F.to_timestamp(F.lit("2024-01-31 00:00:00")), 3600 * 6)
    return out.select("project", F.substring_index("thread", "|", 1).cast("long").alias("thread"))


@query("SELECT conv_id, count(*) AS messages, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def q_thread_stats(spark, sf):
    return tables.thread_stats(_t(spark, sf, "conversations"))


@query("SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS at FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)")
def q_chat_load(spark, sf):
    return tables.load_thread(_t(spark, sf, "conversations"), 3).select("conv_id", "turn", "text", "at")


@query("""WITH g AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1), t AS (SELECT conv_id FROM g QUALIFY row_number() OVER (PARTITION BY conv_id % 9 ORDER BY last DESC, conv_id) <= 5)
SELECT c.conv_id, c.turn, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM conversations c JOIN t ON c.conv_id = t.conv_id QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY turn DESC) <= 20""")
def q_chat_preview(spark, sf):
    start = F.to_timestamp(F.lit(NOW))
    rows = _t(spark, sf, "conversations").select(F.col("turn").alias("id"), F.col("conv_id").alias("thread"), (F.col("conv_id") % 9).alias("project"), "role", F.col("text").alias("content"), F.timestamp_add("SECOND", F.col("turn"), start).alias("created_at"))
    out = chat.preview(rows)
    return out.join(tables.load_thread(_t(spark, sf, "conversations"), 20).select(F.col("conv_id").alias("thread"), "turn", "at"), ["thread", "at"]).select(F.col("thread").alias("conv_id"), "turn", "preview")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS far FROM events),
s AS (SELECT *, sum(far) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, epoch_us(min(ts))::BIGINT AS first_us, epoch_us(max(ts))::BIGINT AS last_us, count(*) AS n FROM s GROUP BY user_id, s.n""")
def q_debounce_sessions(spark, sf):
    out = tables.debounce(_t(spark, sf, "events"), 3600, "user_id")
    return out.select("user_id", F.unix_micros(F.col("first_at").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_at").cast("timestamp")).alias("last_us"), "n")


_LOG = """(SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'broken|' || o_orderkey ELSE 'h' || o_orderkey || '|A' || o_custkey || '|a@x|' || strftime(o_orderdate, '%Y-%m-%d') || '|fix: a|b ' || o_orderpriority || chr(10) || 'src/f' || (o_custkey % 50) || '.ts' || chr(10) || chr(10) || ' src/g' || (o_orderkey % 30) || '.ts' END AS block FROM orders)"""
_COMMITS = f"""WITH b AS (SELECT string_split(trim(block), chr(10)) AS l FROM {_LOG}), h AS (SELECT string_split(l[1], '|') AS f, list_filter(list_transform(l[2:], lambda x: trim(x)), lambda x: x <> '') AS files FROM b),
commits AS (SELECT f[1] AS hash, f[2] AS author, f[4] AS date, array_to_string(f[5:], '|') AS message, files FROM h WHERE len(f) >= 5)"""


def _commits(spark, sf):
    k = F.col("o_orderkey")
    block = F.concat(F.lit("h"), k, F.lit("|A"), F.col("o_custkey"), F.lit("|a@x|"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("|fix: a|b "), F.col("o_orderpriority"), F.lit("\nsrc/f"), F.col("o_custkey") % 50, F.lit(".ts\n\n src/g"), k % 30, F.lit(".ts"))
    return S.parse_git_log(_t(spark, sf, "orders").select(F.when(k % 10 == 0, F.concat(F.lit("broken|"), k)).otherwise(block).alias("block")))


@query(_COMMITS + " SELECT hash, author, date, message, array_to_string(files, ',') AS files FROM commits")
def q_git_parse(spark, sf):
    return _commits(spark, sf).withColumn("files", F.array_join("files", ","))


@query(_COMMITS + ", e AS (SELECT hash, unnest(files) AS file FROM commits) SELECT hash, count(*) FILTER (WHERE regexp_matches(file, '^src/f([0-9]|1[0-9]|2[0-4])[.]ts$')) AS indexed, count(*) FILTER (WHERE NOT regexp_matches(file, '^src/f([0-9]|1[0-9]|2[0-4])[.]ts$')) AS not_indexed FROM e GROUP BY 1")
def q_recent_changes(spark, sf):
    files = _t(spark, sf, "nation").select(F.concat(F.lit("src/f"), F.col("n_nationkey"), F.lit(".ts")).alias("file"))
    return S.recent_changes(_commits(spark, sf), files)


@query(_COMMITS + " SELECT hash, date FROM commits WHERE list_contains(files, 'src/f7.ts') ORDER BY date DESC, hash LIMIT 10")
def q_file_history(spark, sf):
    return S.file_history(_commits(spark, sf), "src/f7.ts").select("hash", "date")


@query(_COMMITS + " SELECT hash FROM commits WHERE date >= '1998-01-02'")
def q_commits_since(spark, sf):
    return S.since(_commits(spark, sf), F.to_date(F.lit("1998-02-01")), 30).select("hash")


@query()
def q_chunk_documents(spark, sf):
    return C.chunks(_docs(spark, sf).select(F.col("file_path").alias("file"), "text"))


_SIM = "1 - levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1}))"


@query(f"""WITH q AS (SELECT unnest(['red', 'bolts']) AS a), w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS b FROM part),
m AS (SELECT p_partkey, max({_SIM.format('a', 'b')}) AS best FROM w, q WHERE length(b) >= 2 GROUP BY 1)
SELECT p_partkey, round(p_retailprice * (1 + 0.5 * greatest(best, {_SIM.format("'red bolts'", 'lower(left(p_name, 200))')})), 6) AS score FROM part JOIN m USING (p_partkey)""")
def q_fuzzy_boost(spark, sf):
    hits = _t(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("score"), F.col("p_name").alias("text"))
    return retrieval.fuzzy_boost("red bolts", hits).select("p_partkey", "score")
