"""Exact top-k search by inner product with MaxScore.

Dimensions are terms, a vector's components are their weights. Within a shard each component is
shifted to a contribution of zero or more, so that a query's score is a constant plus what its terms
add, and each term has an upper bound. Terms are sorted by bound; those whose bounds together
can't lift a vector over the query's current k-th score are non-essential. The postings of the
essential terms are traversed for all vectors of the block; the others are probed, largest bound
first, only for vectors that are still competitive. Shards' results are merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphion.llm.common import Scratch, table

NONE = np.iinfo(np.int64).min


class Top:
    """The k best (score, id) of each query so far: higher scores first, ties to smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.id = k, np.full((queries, k), NONE), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], scores]), np.concatenate([self.id[q], ids])
        best = np.lexsort((i, -s.astype(np.float64) if s.min() == NONE else -s))[: self.k]
        self.score[q], self.id[q] = s[best], i[best]


def search_block(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, top: Top) -> int:
    """Merges the block's vectors into top; gives the number of components read beyond the essential ones."""
    low, high = vectors.min(0), vectors.max(0)
    probed = 0
    bound = np.where(queries > 0, queries * (high - low), queries * (low - high))  # what a term can add, at most
    base = np.where(queries > 0, queries * low, queries * high).sum(1)  # of every vector
    order = np.argsort(-bound, axis=1, kind="stable")
    exact = vectors.astype(np.float64) if np.abs(vectors).max(initial=0) < 2**20 else vectors
    for q in range(len(queries)):
        need, by = top.score[q, -1], order[q]
        rest = np.concatenate([np.cumsum(bound[q, by][::-1])[::-1], [0]])  # what the terms from each on can add
        essential = len(by) if need == NONE else int(np.searchsorted(-(base[q] + rest), -need, side="right"))
        if essential == 0 and need != NONE and base[q] + rest[0] < need:
            continue
        terms = by[:essential]
        weight = queries[q].astype(exact.dtype)
        score = exact[:, terms] @ weight[terms]
        left = np.arange(len(ids))
        floor = np.where(queries[q] > 0, queries[q] * low, queries[q] * high)
        at = essential
        while at < len(by):
            may = score + (floor[by[at:]].sum() + rest[at])
            keep = may >= need
            left, score = left[keep], score[keep]
            if not len(left):
                break
            step = by[at : at + 8]
            probed += len(left) * len(step)
            score = score + exact[np.ix_(left, step)] @ weight[step]
            at += 8
        fit = (score >= need) & (ids[left] != query_ids[q])
        left, score = left[fit], score[fit].astype(np.int64)
        if len(left) > 4 * top.k:
            cut = np.partition(score, len(score) - top.k)[len(score) - top.k]
            left, score = left[score >= cut], score[score >= cut]
        if len(left):
            top.add(q, score, ids[left])
    return probed


def quantised(vector):
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v: quantised vectors, without those that are null or hold null or non-finite components."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists and their values end to end."""
    offsets = np.asarray(column.offsets)
    return np.diff(offsets), np.asarray(column.values)[offsets[0] : offsets[-1]]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, queries_a_pass: int = 10_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of vectors (vec_id, v) for each of queries (vec_id, v).

    v: whole numbers. Candidates of a query: rows of its own length with another vec_id. Rows
    without an id take no part; repeated rows are candidates each. Queries travel to the tasks in
    passes of about queries_a_pass rows, whatever their number; with several passes each one's
    result is stored, and what was broadcast for it freed, before the next. Empty vectors score 0.
    An empty table gives an empty result.
    """
    scratch = Scratch()
    vectors, queries = vectors.where("vec_id is not null"), queries.where("vec_id is not null")
    passes = max(1, -(-queries.count() // queries_a_pass))
    parts = []
    for p in range(passes):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).dropDuplicates(["vec_id", "v"]).collect()
        sets = {}
        for n in sorted({len(r["v"]) for r in mine}):
            rows = [r for r in mine if len(r["v"]) == n]
            sets[n] = (np.array([r["vec_id"] for r in rows], dtype=np.int64), np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), n))
        held = vectors.sparkSession.sparkContext.broadcast(sets)

        def search(batches, held=held):
            best = {n: Top(len(ids), k) for n, (ids, _) in held.value.items()}
            for batch in batches:
                ids = np.asarray(batch.column("vec_id"))
                lengths, flat = _matrix(batch.column("v"))
                begin = np.cumsum(lengths) - lengths
                for n, (query_ids, q) in held.value.items():
                    rows = np.flatnonzero(lengths == n)
                    for a in range(0, len(rows), block):
                        part = rows[a : a + block]
                        search_block(q, query_ids, ids[part], flat[begin[part][:, None] + np.arange(n)], best[n])
            for n, (query_ids, _) in held.value.items():
                at, rank = np.nonzero(best[n].score > NONE)
                cols = [query_ids[at], best[n].id[at, rank], best[n].score[at, rank]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

        part = _best(vectors.select("vec_id", "v").mapInArrow(search, "query_id long, vec_id long, score long"), k)
        if passes == 1:
            return part
        parts.append(scratch.durable(part))
        held.destroy()
    found = parts[0]
    for x in parts[1:]:
        found = found.unionAll(x)
    return scratch.finish(found)


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors of each vector whose id is divisible by 50."""
    rows = whole_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q, e c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
