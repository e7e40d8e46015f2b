"""Keyword, vector and hybrid retrieval over many queries at once.

Queries are a dict of id and text: they are the request, not data, and become literals of the plan.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from glyphion.functions import text as T
from glyphion.functions.stem import fold, stems
from glyphion.storage import Scratch, durable

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _query_terms(spark: SparkSession, queries: dict[int, str]) -> DataFrame:
    """query_id, n_terms, stem of each distinct stem of a query."""
    rows = spark.createDataFrame([(int(i), q) for i, q in queries.items()], "query_id long, query string")
    each = rows.select("query_id", F.explode(F.array_distinct(stems(T.tokens(fold(F.col("query")))))).alias("stem"))
    return each.join(each.groupBy("query_id").agg(F.count("*").cast("int").alias("n_terms")), "query_id")


def _beginnings(stem: str) -> list[str]:
    """What a word with this stem begins with: the stem, or all but its last letter and what a rule put another letter for."""
    head, last = re.escape(stem[:-1]), stem[-1]
    other = "y" if last == "i" else "[aioy]" if last == "e" and len(stem) > 2 else "i" if stem.endswith("bl") else ""
    return [re.escape(stem), *([head + other] if other and head else [])]


def bm25(docs: DataFrame, queries: dict[int, str], text: str = "text", key: str = "doc_id", file: str | None = None) -> DataFrame:
    """query_id, key, score, matched, n_terms for documents with any of a query's terms.

    Terms are Porter stems of words without accents, of the file path (where there is one) and the
    text together. Statistics cover all documents, whatever is filtered later. One pass over the
    documents gives all counts: each sends its length under an empty term, beside the occurrences
    of the queries' stems.
    """
    wanted = _query_terms(docs.sparkSession, queries)
    asked = wanted.collect()  # the request: a few words a query
    wanted_stems = sorted({r.stem for r in asked})
    if not wanted_stems:
        return docs.select(F.lit(0).cast("long").alias("query_id"), key, F.lit(0).alias("n_terms"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched")).where("false")
    # Most occurrences are of words that are their own stems; only the other words that could have a stem asked for are stemmed.
    one = docs.sparkSession.range(1).select(F.lit(wanted_stems).alias("w")).select("w", stems(F.col("w")).alias("s")).first()
    own = [w for w, s in zip(one.w, one.s) if w == s]
    begins = "^(?:" + "|".join(b for s in wanted_stems for b in _beginnings(s)) + ")"
    whole = F.col(text) if file is None else F.concat_ws(" ", F.col(file), F.col(text))
    other = lambda t: ~t.isin(own) & (F.length(t) > 2) & t.rlike(begins)
    # Bound to a variable, so that texts are cut into words once.
    bound = F.transform(F.array(T.tokens(fold(whole))), lambda t: F.struct(F.size(t).cast("long").alias("n"), F.filter(t, lambda w: w.isin(own)).alias("own"), F.filter(t, other).alias("other")))
    held = docs.select(key, F.element_at(bound, 1).alias("_x")).select(key, F.col("_x.n").alias("_len"), F.col("_x.own").alias("_own"), F.col("_x.other").alias("_other"))
    asked_for = F.concat("_own", F.filter(stems(F.col("_other")), lambda w: w.isin(wanted_stems)))
    each = held.select(key, "_len", F.explode(F.concat(F.array(F.lit("")), asked_for)).alias("stem"))
    # Stored: statistics and scores read these few counts, not the documents again.
    tf = durable(each.groupBy(key, "stem").agg(F.count("*").alias("_tf"), F.first("_len").alias("_len")))
    df = F.broadcast(tf.groupBy("stem").agg(F.count("*").alias("_df"), F.sum("_len").alias("_sum")))
    stats = F.broadcast(df.where("stem = ''").select(F.col("_df").alias("_docs"), (F.col("_sum") / F.col("_df")).alias("_mean")))
    idf = F.greatest(F.log((F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_len") / F.col("_mean")))
    scored = tf.join(df.drop("_sum"), "stem").join(F.broadcast(wanted), "stem").join(stats)
    return scored.groupBy("query_id", key, "n_terms").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("matched"))


def ranked(hits: DataFrame, limit: int, key: str = "doc_id", score: str = "score") -> DataFrame:
    """The best of each query; every task first cuts its own rows to the limit."""
    by = Window.partitionBy("query_id").orderBy(F.desc(score), key)
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def keyword_search(docs: DataFrame, queries: dict[int, str], limit: int = 10, relaxed: bool = True, text: str = "text", key: str = "doc_id", file: str | None = None) -> DataFrame:
    """Documents with all terms; with `relaxed`, those with any term where no document has all of two or more."""
    hits = bm25(docs, queries, text, key, file)
    whole = F.col("matched") == F.col("n_terms")
    if not relaxed:
        return ranked(hits.where(whole), limit, key)
    met = hits.groupBy("query_id").agg(F.max(whole).alias("_any"))  # one row a query
    some = hits.join(F.broadcast(met), "query_id")
    return ranked(some.where(whole | (~F.col("_any") & (F.col("n_terms") >= 2))).drop("_any"), limit, key)


def cosine(a: Column, b: Column) -> Column:
    add = lambda s, x: s + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), add))
    return dot / (norm(a) * norm(b))


def vector_search(rows: DataFrame, queries: DataFrame, limit: int = 10, where: Column | None = None, queries_a_pass: int = 4000) -> DataFrame:
    """query_id, vec_id, score, rank: the nearest rows (vec_id, embedding) by cosine of each of queries (query_id, query), filtered first.

    Queries go out in passes of about queries_a_pass rows, so what is broadcast is bounded; with
    several, each pass's result is stored before the next. Tasks hold matrices and return their best
    rows of each query. Null vectors, those of another length and those of length zero score nothing.
    """
    rows = (rows if where is None else rows.where(where)).where("embedding is not null").select("vec_id", "embedding")
    spark = rows.sparkSession
    passes = max(1, -(-queries.count() // queries_a_pass))
    scratch, found = Scratch(), None
    ids = [rows.schema["vec_id"], queries.schema["query_id"]]
    schema = StructType([StructField("query_id", ids[1].dataType), StructField("vec_id", ids[0].dataType), StructField("score", DoubleType())])
    for p in range(passes):
        mine = queries.where("query is not null").where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).select("query_id", "query").collect()
        held = spark.sparkContext.broadcast([(r[0], np.array(r[1], dtype=np.float64)) for r in mine])
        part = rows.mapInArrow(_nearest(held, limit), schema)
        if passes > 1:
            part = scratch.durable(ranked(part, limit, "vec_id").drop("rank"))
            held.destroy()
        found = part if found is None else found.unionByName(part)
    best = ranked(found, limit, "vec_id")
    return best if passes == 1 else scratch.finish(best)


def _nearest(held, limit: int):
    def search(batches):
        by_length: dict[int, tuple[list, np.ndarray]] = {}
        for n in {len(v) for _, v in held.value}:
            own = [(i, v) for i, v in held.value if len(v) == n and v.any()]
            if own:
                matrix = np.stack([v for _, v in own])
                by_length[n] = [i for i, _ in own], matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))
        for batch in batches:
            ids, column = batch.column("vec_id").to_pylist(), batch.column("embedding")
            lengths = np.diff(np.asarray(column.offsets))
            flat = np.asarray(column.values.fill_null(float("nan")), dtype=np.float64)
            out: list[tuple] = []
            for n, (query_ids, q) in by_length.items():
                at = np.flatnonzero(lengths == n)
                if not len(at):
                    continue
                v = flat[np.asarray(column.offsets)[:-1][at][:, None] + np.arange(n)]
                with np.errstate(invalid="ignore", divide="ignore"):
                    v = v / np.sqrt((v * v).sum(1, keepdims=True))
                at, v = at[~np.isnan(v).any(1)], v[~np.isnan(v).any(1)]
                for a in range(0, len(query_ids), 256):
                    scores = np.round(q[a : a + 256] @ v.T, 6)
                    for k, row in enumerate(scores):
                        # Ties at the cut all stay; the merge orders them by id.
                        best = np.flatnonzero(row >= np.partition(row, -limit)[-limit]) if len(row) > limit else np.arange(len(row))
                        out += [(query_ids[a + k], ids[at[j]], float(row[j])) for j in best]
            yield pa.RecordBatch.from_pydict({"query_id": [o[0] for o in out], "vec_id": [o[1] for o in out], "score": pa.array([o[2] for o in out], pa.float64())})

    return search


def rrf(keyword: DataFrame, semantic: DataFrame, key: str = "doc_id", k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (query_id, key, rank); ties: keyword rank, then semantic rank."""
    a = keyword.select("query_id", key, F.col("rank").alias("keyword_rank"))
    b = semantic.select("query_id", key, F.col("rank").alias("semantic_rank"))
    one = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    fused = a.join(b, ["query_id", key], "full_outer").withColumn("score", F.round(one("keyword_rank") + one("semantic_rank"), 9))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("keyword_rank").asc_nulls_last(), F.col("semantic_rank").asc_nulls_last(), key)
    return fused.withColumn("rank", F.row_number().over(by))


def dedupe_by_file(hits: DataFrame, limit: int = 10, file: str = "file_path", key: str = "doc_id") -> DataFrame:
    """The best hit of each file, then the best of those."""
    first = Window.partitionBy("query_id", file).orderBy(F.desc("score"), key)
    return ranked(hits.withColumn("_at", F.row_number().over(first)).where("_at = 1").drop("_at", *(["rank"] if "rank" in hits.columns else [])), limit, key)


def regex_search(rows: DataFrame, pattern: str, text: str = "text", every: bool = True) -> DataFrame:
    """Rows with matches, their number, and the text with matches in bold; `every` is the g flag."""
    found = rows.where(F.col(text).rlike(pattern))
    count = F.regexp_count(F.col(text), F.lit(pattern)) if every else F.lit(1)
    shown = F.regexp_replace(text, pattern, "**$0**") if every else F.concat(F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1), F.lit("**"), F.regexp_extract(text, f"({pattern})", 1), F.lit("**"), F.regexp_replace(text, f"(?s)^.*?(?:{pattern})", ""))
    return found.withColumn("matches", count.cast("long")).withColumn("highlighted", shown)


def expand_context(hits: DataFrame, chunks: DataFrame, reach: int, most: int = 8000) -> DataFrame:
    """Each hit (file_path, chunk_index) with its file's chunks up to `reach` before and after, joined by line ends.

    The band is expanded on the hits' side, so the join is on equal (file, index).
    """
    around = hits.select("file_path", F.col("chunk_index").alias("hit_index"), F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)).alias("chunk_index"))
    met = around.join(chunks, ["file_path", "chunk_index"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"])
    return met.groupBy("file_path", "hit_index").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), T.snippet(F.array_join(parts, "\n"), most).alias("content"))


def fuzzy_boost(query: str, hits: DataFrame, text: str = "text") -> DataFrame:
    """score * (1 + 0.5 * best), best: the closest pair of query and content words, or query and the text's first 200 characters."""
    words = F.array(*(F.lit(w) for w in query.lower().split() if len(w) >= 2)) if query.split() else F.array().cast("array<string>")
    own = F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) >= 2))
    near = F.array_max(F.transform(words, lambda q: F.array_max(F.transform(own, lambda w: T.levenshtein_similarity(q, w)))))
    head = T.levenshtein_similarity(F.lit(query.lower()), F.substring(F.lower(text), 1, 200))
    best = F.greatest(F.coalesce(near, F.lit(0.0)), head)
    return hits.withColumn("score", F.round(F.col("score") * (1 + 0.5 * best), 6))


def retrieval_metrics(found: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """case_id, recall, mrr, ndcg at k. found: case_id, rank (from 1), file; expected: case_id, file."""
    hits = found.where(F.col("rank") <= k).join(expected.distinct(), ["case_id", "file"])
    per = hits.groupBy("case_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    want = expected.distinct().groupBy("case_id").agg(F.count("*").alias("want"))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.col("want"), F.lit(k).cast("long"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = want.join(per, "case_id", "left")
    return out.select("case_id", *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n) for n, c in (("recall", F.col("n") / F.col("want")), ("mrr", 1 / F.col("first")), ("ndcg", F.col("dcg") / ideal))))
