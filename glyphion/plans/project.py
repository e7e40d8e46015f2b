"""A project's index as a whole: built, kept up to date, swapped, searched, evaluated and described."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphion.functions import text as T
from glyphion.functions.languages import detect_language
from glyphion.operators import code_graph, graph, overview, retrieval, tables
from glyphion.operators import search as find
from glyphion.sources import chunks as C
from glyphion.sources import embeddings, extract
from glyphion.storage import delete, shared_dir

PENDING = "pending:"


@dataclass
class Profile:
    """What the rows of an index depend on: another profile means that all must be made anew."""

    name: str = "hashed"
    dimensions: int = 256
    chunk_size: int = 60
    overlap: int = 5
    by_syntax: bool = True
    embedder: Callable | None = field(default=None, compare=False)

    def key(self) -> str:
        return f"{self.name}:{self.dimensions}:{self.by_syntax}:{self.chunk_size}:{self.overlap}"


def build(files: DataFrame, project: str, profile: Profile) -> dict[str, DataFrame]:
    """All tables of files (file, text): files, chunks, vectors, dependencies, exports, symbols. Imports are resolved against all files given."""
    files = files.select("file", "text", detect_language(F.col("file")).alias("language"), F.sha1(F.col("text").cast("binary")).alias("hash"))
    cut = C.chunks(files, profile.chunk_size, profile.overlap, profile.by_syntax).join(files.select("file", "language", "hash"), "file")
    out = {"files": files, "chunks": cut, "exports": extract.parse_exports(files), "symbols": extract.extract_symbols(files, project)}
    brought = extract.parse_imports(files).withColumnRenamed("file", "source")
    target = graph.resolve_imports(brought.select("source", "specifier").distinct(), files)
    out["dependencies"] = brought.join(target, ["source", "specifier"], "left").select(F.col("source").alias("file"), F.coalesce("target", "specifier").alias("target"), "specifier", "names", "kind", F.col("target").isNotNull().alias("resolved"))
    said = cut.select("id", "file", C.embedding_text(F.col("file"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("text"))
    vectors = embeddings.embedded(said, profile.embedder or embeddings.hashed_ngrams(profile.dimensions), profile.dimensions)
    out["vectors"] = vectors.join(said.select("id", "file"), "id")
    return {name: t.withColumn("project", F.lit(project)) for name, t in out.items()}


def update(held: dict[str, DataFrame], files: DataFrame, project: str, profile: Profile, held_profile: str | None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The index after files (file, text) were scanned anew, and the status of each file.

    Only new and changed files are read again; deleted ones leave every table. With another
    profile, or after a run that didn't end, all files are.
    """
    own = {n: t.where(F.col("project") == project) for n, t in held.items()}
    now = files.select("file", F.sha1(F.col("text").cast("binary")).alias("hash"))
    status = tables.changes(now, own["files"].select("file", "hash"))
    if held_profile != profile.key():
        status = status.withColumn("status", F.when(F.col("status") == "unchanged", "changed").otherwise(F.col("status")))
    fresh = build(files.join(status.where("status in ('new', 'changed')").select("file"), "file", "left_semi"), project, profile)
    gone = status.where("status <> 'unchanged'").select(F.lit(project).alias("project"), "file")
    kept = {n: t.join(gone, ["project", "file"], "left_anti") for n, t in held.items()}
    return {n: t.unionByName(fresh[n]) if n in fresh else t for n, t in kept.items()}, status


class Store:
    """Tables under a folder, a version at a time: a new version is written whole, then the pointer moves, so that readers never see half of one."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"

    def write(self, held: dict[str, DataFrame], profile: str = "") -> str:
        version, before = uuid.uuid4().hex, self.version()
        for name, t in held.items():
            t.write.parquet(f"{self.path}/{version}/{name}")
        self._point({"version": version, "profile": profile, "tables": sorted(held)})
        if before:
            delete(self.spark, f"{self.path}/{before['version']}")
        return version

    def start(self) -> None:
        """Marks that a run began; until write() has ended, all counts as out of date."""
        now = self.version() or {"version": None, "tables": []}
        self._point({**now, "profile": PENDING + now.get("profile", "").removeprefix(PENDING)})

    def _point(self, state: dict) -> None:
        rows = self.spark.createDataFrame([(json.dumps(state), time.time())], "state string, at double")
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")

    def version(self) -> dict | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointer")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        rows = self.spark.read.schema("state string, at double").parquet(f"{self.path}/pointer")
        return json.loads(rows.agg(F.max_by("state", "at")).first()[0])

    def read(self) -> dict[str, DataFrame]:
        now = self.version()
        return {} if not now or not now["version"] else {name: self.spark.read.parquet(f"{self.path}/{now['version']}/{name}") for name in now["tables"]}


def index_of(held: dict[str, DataFrame], profile: Profile, rerank=None, version: str = "") -> find.Index:
    embed = profile.embedder or embeddings.hashed_ngrams(profile.dimensions)
    return find.Index(held["chunks"], held.get("vectors"), held.get("symbols"), lambda q: list(embed([q])[0]), rerank, version)


def evaluate(index: find.Index, cases: list[tuple[str, list[str], str]], k: int = 5) -> dict:
    """Searches one to a hundred cases (query, expected files, mode) and reports recall, MRR and nDCG at k, their means, and the p95 of the times.

    Cases that fail are reported and left out of the means.
    """
    if not 1 <= len(cases) <= 100 or any(not q.strip() or not files for q, files, _ in cases):
        raise ValueError("give 1 to 100 cases with a query and expected files")
    k, rows, spark = max(1, min(50, k)), [], index.chunks.sparkSession
    for query, files, mode in cases:
        began = time.monotonic()
        try:
            hits = find.search(index, query, mode, limit=k)
            ranked = [r.file for r in hits.hits.orderBy("rank").select("file").collect()]  # at most k rows
            error = None
        except Exception as e:
            ranked, error = [], f"{type(e).__name__}: {e}"
        took = time.monotonic() - began
        names = list(dict.fromkeys(f.replace("\\", "/") for f in ranked))[:k]
        found = spark.createDataFrame([("c", i + 1, f) for i, f in enumerate(names)], "case_id string, rank int, file string")
        wanted = spark.createDataFrame([("c", f.replace("\\", "/")) for f in files], "case_id string, file string")
        score = retrieval.retrieval_metrics(found, wanted, k).first()
        rows.append({"query": query, "mode": mode, "files": names, "recall": score.recall, "mrr": score.mrr, "ndcg": score.ndcg, "seconds": took, "error": error})
    fine = [r for r in rows if r["error"] is None]
    times = sorted(r["seconds"] for r in fine)
    mean = {m: sum(r[m] for r in fine) / len(fine) if fine else 0.0 for m in ("recall", "mrr", "ndcg")}
    return {**mean, "p95": times[math.ceil(len(times) * 0.95) - 1] if times else None, "cases": rows}


def benchmark(index: find.Index, queries: list[str], runs: int = 3, mode: str = "keyword") -> DataFrame:
    """n, mean, least and most seconds of each query, each run without a cache."""
    took = []
    for query in queries:
        for _ in range(runs):
            began = time.monotonic()
            find.search(index, query, mode).hits.collect()
            took.append((query, time.monotonic() - began))
    return tables.timings(index.chunks.sparkSession.createDataFrame(took, "query string, seconds double"), ["query"])


def session(held: dict[str, DataFrame], task: str, targets: list[str], profile: Profile) -> dict:
    """What work on a task starts from: its type and keywords, the target files and those that search finds, tests, importers and frameworks."""
    spark = held["files"].sparkSession
    told = spark.range(1).select(T.task_type(F.lit(task)).alias("kind"), T.extract_keywords(F.lit(task)).alias("words")).first()
    hits = find.search(index_of(held, profile), " ".join(told.words) or task, "hybrid", limit=8)
    near = [r.file for r in hits.hits.orderBy("rank").select("file").collect()]
    core = list(dict.fromkeys([*targets, *near]))[:10]
    seeds = spark.createDataFrame([(f,) for f in targets or near[:3]], "file string")
    edges = held["dependencies"].select(F.col("file").alias("source"), "target")
    frameworks = overview.frameworks(held["files"].select("project", "file", "text")).orderBy("at").collect()
    return {
        "type": told.kind, "keywords": list(told.words), "core_files": core, "directories": sorted({f.rsplit("/", 1)[0] for f in core if "/" in f})[:8],
        "tests": [r.test for r in overview.test_files(seeds, held["files"], edges).orderBy("file", "at").limit(10).collect()],
        "affected": [r.file for r in graph.impact(edges, seeds, 3).orderBy("depth", "file").limit(100).collect()],
        "frameworks": [r.framework for r in frameworks], "languages": {r.language: r["count"] for r in held["files"].groupBy("language").count().collect()},
    }


def symbol_graph(held: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """graph_nodes, graph_edges and graph_warnings of an index's files."""
    files = held["files"].select("file", "text")
    return dict(zip(("graph_nodes", "graph_edges", "graph_warnings"), code_graph.analyse(files)))


def diagnostics(held: dict[str, DataFrame]) -> list:
    """Whether each project has as many vectors as chunks."""
    return overview.index_parity(held["chunks"], held["vectors"]).orderBy("project").collect()
