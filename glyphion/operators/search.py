"""One search over an index of chunks: mode, fetch limits, fallbacks, fusion and what follows, in fixed order.

Each step is a DataFrame; the driver only decides which branch to take, from whether few rows are
there at all. Scores of a reranker are asked for on the driver, for a pool of at most 200 rows.
"""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphion.functions import text as T
from glyphion.operators import retrieval, tables

# Fetch limits, the rerank pool, text sizes, and the life of cached results.
RRF_K = 60
RERANK_POOL = 50
RERANK_CHARS = 8000
CONTENT_CHARS = 2000
CACHE_ENTRIES, CACHE_SECONDS = 100, 300.0
SYMBOL_KINDS = ["function", "class", "method", "interface", "type", "variable", "enum", "export"]


def keyword_fetch(limit: int, dedupe: bool) -> int:
    return min(300, max(40, limit * 25)) if dedupe else max(20, limit)


def relaxed_fetch(fetch: int) -> int:
    return min(400, max(fetch * 2, fetch + 20))


def semantic_fetch(limit: int, dedupe: bool, target: int) -> int:
    return min(200, max(limit * 20, limit)) if dedupe else target


def rerank_pool(limit: int, pool: int = RERANK_POOL) -> int:
    return max(limit, min(pool, limit * 5))


@dataclass
class Index:
    """chunks: id, file, chunk_index, start_line, end_line, content, language. vectors: id, vector. symbols: as extract_symbols gives them."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    symbols: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    rerank: Callable[[str, list[str]], list[float]] | None = None
    version: str = ""


@dataclass
class Found:
    hits: DataFrame
    mode: str
    warnings: list[str] = field(default_factory=list)
    cached: bool = False


class Cache:
    """Rows of recent searches: the least recently used go first, and old ones expire."""

    def __init__(self, entries: int = CACHE_ENTRIES, seconds: float = CACHE_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self._held: OrderedDict[str, tuple[float, object]] = OrderedDict()

    def get(self, key: str):
        held = self._held.get(key)
        if held is None or self.clock() - held[0] > self.seconds:
            self._held.pop(key, None)
            return None
        self._held.move_to_end(key)
        return held[1]

    def put(self, key: str, value) -> None:
        if key not in self._held and len(self._held) >= self.entries:
            self._held.popitem(last=False)
        self._held[key] = self.clock(), value

    def drop(self, project: str | None = None) -> None:
        for key in [k for k in self._held if project is None or k.startswith(project + "|")]:
            del self._held[key]

    def __len__(self) -> int:
        return len(self._held)


def cache_key(project: str, query: str, mode: str, limit: int, **filters) -> str:
    named = "|".join(f"{k}={v}" for k, v in sorted(filters.items()) if v is not None)
    return "|".join([project, query, mode, str(limit), named])


def cache_key_of(head: list[Column], filters: Column) -> Column:
    """cache_key for rows: head columns, then the sorted entries of a map without nulls."""
    entries = F.filter(F.map_entries(filters), lambda e: e["value"].isNotNull())
    named = F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return F.concat_ws("|", *head, named)


def filtered(chunks: DataFrame, language: str | None = None, file_pattern: str | None = None, dialect: str = "sql") -> DataFrame:
    """chunks under the filters that are set. Dialect `prefix` takes the pattern up to its first star as a path's beginning."""
    if language:
        chunks = chunks.where(F.lower("language") == language.lower())
    if file_pattern and dialect == "prefix":
        chunks = chunks.where(F.col("file").startswith(file_pattern.split("*")[0]))
    elif file_pattern:
        chunks = chunks.where(F.col("file").rlike(T.glob_regex(file_pattern, dialect)))
    return chunks


def symbol_search(symbols: DataFrame, chunks: DataFrame, name: str, limit: int = 10, language: str | None = None, file_pattern: str | None = None, dedupe: bool = True) -> DataFrame:
    """Chunks that hold symbols whose name contains `name`: exact names first, then by place; the score is 1 / position."""
    met = tables.symbol_lookup(filtered(symbols, None, file_pattern), name, 200)
    if language and "language" in symbols.columns:
        met = met.where(F.lower("language") == language.lower())
    points = met.select("id", "name", "file", F.col("line").cast("long").alias("line"))
    spans = chunks.select("file", "chunk_index", "start_line", "end_line")
    placed = tables.chunk_of_line(points, spans).where("chunk_index is not null")
    exact = F.when(F.lower("name") == name.lower(), 0).otherwise(1)
    order = Window.partitionBy(F.lit(0)).orderBy(exact, "file", "line", "id")  # at most 200 rows
    placed = placed.withColumn("_at", F.row_number().over(order))
    if dedupe:
        placed = placed.withColumn("_f", F.row_number().over(Window.partitionBy("file").orderBy("_at"))).where("_f = 1")
    placed = placed.withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_at"))).where(F.col("_at") <= limit)
    out = placed.select("file", "chunk_index", F.col("name").alias("symbol"), (1 / F.col("_at")).alias("score"))
    return out.join(chunks, ["file", "chunk_index"]).withColumn("match_type", F.lit("symbol"))


def kind_filtered(hits: DataFrame, symbols: DataFrame, kind: str) -> DataFrame:
    """Hits whose file has a symbol of the kind; an unknown kind filters nothing."""
    return tables.symbol_kind_filter(hits, symbols, kind.lower()) if kind.lower() in SYMBOL_KINDS else hits


def reranked(hits: DataFrame, query: str, score: Callable[[str, list[str]], list[float]] | None, pool: int = 200) -> tuple[DataFrame, str]:
    """hits (id, file, content, score) with a reranker's scores, and what happened: disabled, insufficient_candidates, applied or fallback.

    The scorer gets the query and a text a hit. What it gives must be one finite number a hit; any
    failure leaves the hits as they were. At most `pool` rows reach the driver.
    """
    if score is None:
        return hits, "disabled"
    rows = hits.orderBy(F.desc("score"), "id").limit(pool).select("id", "file", F.substring("content", 1, RERANK_CHARS).alias("c")).collect()
    if len(rows) < 2:
        return hits, "insufficient_candidates"
    try:
        given = list(score(query, [f"File: {r.file}\n{r.c}" for r in rows]))
        if len(given) != len(rows) or not all(isinstance(x, int | float) and math.isfinite(x) for x in given):
            return hits, "fallback"
    except Exception:  # whatever an outside service raises, the order it was to improve stays
        return hits, "fallback"
    new = hits.sparkSession.createDataFrame([(r.id, float(x)) for r, x in zip(rows, given)], hits.select("id").schema.add("_new", "double"))
    return hits.join(F.broadcast(new), "id").withColumn("score", F.col("_new")).drop("_new"), "applied"


def overlap_scorer(query: str, documents: list[str]) -> list[float]:
    """A reranker without a service: the share of the query's words that a document holds."""
    words = set(query.lower().split())
    return [len(words & set(d.lower().split())) / max(1, len(words)) for d in documents]


def explained(hits: DataFrame) -> DataFrame:
    """hits (file, score) with path_multiplier and final_score beside score_before_path."""
    many = T.path_quality(F.col("file"), F.lit(1.0))
    return hits.select(*[c for c in hits.columns if c != "score"], F.col("score").alias("score_before_path"), many.alias("path_multiplier"), F.round(F.col("score") * many, 9).alias("final_score"))


def _top(hits: DataFrame, limit: int, *ties: str) -> DataFrame:
    return hits.orderBy(F.desc("score"), *ties, "id").limit(limit)


def _one_per_file(hits: DataFrame, limit: int) -> DataFrame:
    best = Window.partitionBy("file").orderBy(F.desc("score"), "id")
    return _top(hits.withColumn("_f", F.row_number().over(best)).where("_f = 1").drop("_f"), limit)


def _semantic(index: Index, query: str, fetch: int, language: str | None, file_pattern: str | None) -> DataFrame:
    """id, score, semantic_rank by cosine with the embedded query; filters come first."""
    rows = index.vectors
    if language or file_pattern:
        rows = rows.join(filtered(index.chunks, language, file_pattern, "prefix").select("id"), "id", "left_semi")
    asked = rows.sparkSession.createDataFrame([(1, [float(x) for x in index.embed(query)])], "query_id long, query array<double>")
    near = retrieval.vector_search(rows.select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding")), asked, fetch)
    return near.select(F.col("vec_id").alias("id"), "score", F.col("rank").alias("semantic_rank"))


def _keyword(index: Index, query: str, fetch: int, language: str | None, file_pattern: str | None, warnings: list[str]) -> DataFrame:
    """id, score, keyword_rank. Statistics cover the whole index; filters apply to the hits."""
    hits = retrieval.bm25(index.chunks, {1: query}, "content", "id", "file")
    if language or file_pattern:
        hits = hits.join(filtered(index.chunks, language, file_pattern).select("id"), "id", "left_semi")
    whole = retrieval.ranked(hits.where("matched = n_terms"), fetch, "id")
    if whole.isEmpty():
        some = retrieval.ranked(hits.where("n_terms >= 2"), relaxed_fetch(fetch), "id")
        if not some.isEmpty():
            warnings.append("relaxed to any word")
            whole = some
    return whole.select("id", "score", F.col("rank").alias("keyword_rank"))


def search(
    index: Index, query: str, mode: str | None = None, limit: int = 10, language: str | None = None, file_pattern: str | None = None, symbol_kind: str | None = None,
    dedupe_by_file: bool = True, deprioritize: bool = True, rerank: bool = True, fuzzy: bool = False, explain: bool = False, expand: int = 0,
    cache: Cache | None = None, project: str = "", seconds: float | None = 60.0, fall_back: bool = True,
) -> Found:
    """The best chunks for a query: id, file, chunk_index, start_line, end_line, language, content, score, match_type, rank.

    mode: keyword, semantic, hybrid, regex, symbol, or auto (and None) to go by the query. Hybrid
    becomes keyword, with a warning, where no embedder or vectors are there or embedding fails;
    keyword without hits becomes semantic. Then follow, in this order: the filter by symbol kind,
    the fuzzy boost, the paths' quality, reranking, the limit. Finished rows are cached, but not
    those of regex, explained or expanded searches or of ones with warnings.
    """
    mode = _mode(index, query) if mode in (None, "auto") else mode
    key = cache_key(project, query, mode, limit, language=language, file=file_pattern, kind=symbol_kind, dedupe=dedupe_by_file, rerank=rerank, fuzzy=fuzzy, deprioritize=deprioritize, version=index.version)
    may_cache = cache is not None and mode != "regex" and not explain and not expand
    if may_cache and (rows := cache.get(key)):
        return Found(index.chunks.sparkSession.createDataFrame(*rows), mode, cached=True)
    warnings: list[str] = []
    with _deadline(index.chunks.sparkSession, seconds):
        hits, mode = _find(index, query, mode, limit, language, file_pattern, dedupe_by_file, rerank and index.rerank is not None, fall_back, warnings)
        if symbol_kind and index.symbols is not None:
            hits = kind_filtered(hits, index.symbols, symbol_kind)
        if fuzzy and mode != "regex":
            hits = retrieval.fuzzy_boost(query, hits, "content")
        if explain:
            hits = explained(hits).withColumn("score", F.col("final_score" if deprioritize else "score_before_path"))
        elif deprioritize:
            hits = hits.withColumn("score", F.round(T.path_quality(F.col("file"), F.col("score")), 9))
        if rerank and mode not in ("symbol", "regex"):
            hits, _ = reranked(hits, query, index.rerank)
        ties = [c for c in ("keyword_rank", "semantic_rank") if c in hits.columns]
        hits = hits.orderBy(F.desc("score"), *(F.col(c).asc_nulls_last() for c in ties), "id").limit(limit)
        at = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), *(F.col(c).asc_nulls_last() for c in ties), "id")  # at most `limit` rows
        hits = hits.withColumn("rank", F.row_number().over(at))
        if expand:
            around = retrieval.expand_context(hits.select(F.col("file").alias("file_path"), "chunk_index"), index.chunks.withColumnRenamed("file", "file_path"), expand, min(8000, 3 * CONTENT_CHARS))
            around = around.select(F.col("file_path").alias("file"), F.col("hit_index").alias("chunk_index"), "start_line", "end_line", "content")
            hits = hits.drop("start_line", "end_line", "content").join(around, ["file", "chunk_index"])
        if may_cache and not warnings:
            rows = hits.collect()  # at most `limit` rows
            if rows:
                cache.put(key, (rows, hits.schema))
    return Found(hits, mode, warnings)


def _mode(index: Index, query: str) -> str:
    return index.chunks.sparkSession.range(1).select(T.route_mode(F.lit(query)).alias("m")).first().m


class _deadline:
    """Cancels the Spark jobs of the block after some seconds."""

    def __init__(self, spark, seconds: float | None):
        self.spark, self.seconds, self.tag = spark, seconds, f"search-{uuid.uuid4().hex}"

    def __enter__(self):
        if self.seconds:
            self.spark.addTag(self.tag)
            self.timer = threading.Timer(self.seconds, self.spark.interruptTag, [self.tag])
            self.timer.daemon = True
            self.timer.start()

    def __exit__(self, *_):
        if self.seconds:
            self.timer.cancel()
            self.spark.removeTag(self.tag)


def _find(index: Index, query: str, mode: str, limit: int, language, file_pattern, dedupe: bool, reranks: bool, fall_back: bool, warnings: list[str]) -> tuple[DataFrame, str]:
    target = rerank_pool(limit) if reranks else limit
    cut = (lambda h: _one_per_file(h, target)) if dedupe else (lambda h: _top(h, target))
    chunks = index.chunks
    if mode == "symbol":
        if index.symbols is None:
            raise ValueError("the index has no symbols")
        return symbol_search(index.symbols, chunks, query.strip(), target, language, file_pattern, dedupe), mode
    if mode == "regex":
        pattern, flags = T.parse_regex(query) or (query, "i")
        inline = "".join(f for f in "ims" if f in flags)
        met = retrieval.regex_search(filtered(chunks, language, file_pattern, "simple"), (f"(?{inline})" if inline else "") + pattern, "content", "g" in flags)
        met = met.withColumn("score", F.col("matches").cast("double")).withColumn("content", F.col("highlighted")).drop("matches", "highlighted").withColumn("match_type", F.lit("regex"))
        order = Window.partitionBy("file").orderBy(F.desc("score"), "chunk_index")
        met = met.withColumn("_f", F.row_number().over(order)).where("_f = 1").drop("_f") if dedupe else met
        return met.orderBy(F.desc("score"), "file", "chunk_index").limit(target), mode
    fetch = keyword_fetch(target, dedupe)
    can = index.vectors is not None and index.embed is not None
    wide = semantic_fetch(limit, dedupe, target)
    words = near = None
    if mode in ("keyword", "hybrid"):
        words = _keyword(index, query, fetch if mode == "keyword" else max(20, target, fetch), language, file_pattern, warnings)
        if mode == "keyword" and fall_back and can and words.isEmpty():
            mode = "semantic"
            warnings.append("no keyword hits: semantic instead")
    if mode in ("semantic", "hybrid"):
        if not can:
            if mode == "semantic":
                raise ValueError("the index has no vectors or no embedder")
            mode = "keyword"
            warnings.append("no vectors: keyword only")
        else:
            try:
                near = _semantic(index, query, max(20, target, wide) if mode == "hybrid" else wide, language, file_pattern)
            except Exception as e:  # the embedder is an outside service
                if mode == "semantic":
                    raise
                mode = "keyword"
                warnings.append(f"semantic search failed: {type(e).__name__}")
    if mode == "hybrid":
        both = retrieval.rrf(words.select(F.lit(1).alias("query_id"), "id", F.col("keyword_rank").alias("rank")), near.select(F.lit(1).alias("query_id"), "id", F.col("semantic_rank").alias("rank")), "id", RRF_K)
        raw = near.select("id", F.col("score").alias("semantic_raw"))
        both = both.where(F.col("rank") <= (fetch if dedupe else target)).drop("query_id", "rank").join(raw, "id", "left")
        hits = both.join(chunks, "id").withColumn("match_type", F.lit("hybrid")).withColumn("rrf", F.col("score"))
    else:
        hits = (words if mode == "keyword" else near).join(chunks, "id").withColumn("match_type", F.lit(mode))
    return cut(hits), mode
