"""Dependency and symbol graphs: edges, impact, callers, traversal, import resolution, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Extensions tried for an import, in order.
IMPORT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def dependencies(edges: DataFrame, files: DataFrame) -> DataFrame:
    """What each of files (file) imports."""
    return edges.join(files.select(F.col("file").alias("source")).distinct(), "source", "left_semi")


def dependents(edges: DataFrame, files: DataFrame) -> DataFrame:
    """What imports each of files (file)."""
    return edges.join(files.select(F.col("file").alias("target")).distinct(), "target", "left_semi")


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """file, depth: all that reaches seeds (file) over edges (source, target), by the least number of steps."""
    back = edges.select("source", "target").distinct()
    frontier = seeds.select("file").distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for d in range(1, depth + 1):
        step = frontier.join(back, F.col("file") == F.col("target")).select(F.col("source").alias("file")).distinct()
        frontier = step.join(seen.select("file"), "file", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def callers(edges: DataFrame, nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges of the kinds with the names of both ends; unresolved targets stay null."""
    name = lambda c: nodes.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    return edges.where(F.col("kind").isin(kinds)).join(name("source"), "source", "left").join(name("target"), "target", "left")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges"), F.count_if(F.col("target").isNull()).alias("unresolved")))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (source, specifier) with target: the first existing candidate of a relative specifier, else null.

    Candidates: the path itself; without .js; with each extension for the stem and the full path;
    then index files of the full path and the stem.
    """
    relative = F.col("specifier").startswith(".")
    parts = F.concat(F.slice(F.split("source", "/"), 1, F.greatest(F.size(F.split("source", "/")) - 1, F.lit(0))), F.split("specifier", "/"))
    popped = lambda s: F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when((p == ".") | (p == ""), s).when(p == "..", popped(s)).otherwise(F.concat(s, F.array(p))))
    full, stem = F.col("_full"), F.regexp_replace("_full", r"\.js$", "")
    tried = [full, stem, *(F.concat(b, F.lit(e)) for e in IMPORT_EXTENSIONS for b in (stem, full)), *(F.concat(b, F.lit("/index" + e)) for e in IMPORT_EXTENSIONS for b in (full, stem))]
    each = imports.select("source", "specifier").distinct().where(relative).withColumn("_full", F.array_join(walked, "/"))
    each = each.select("source", "specifier", F.posexplode(F.array(*tried)).alias("_at", "file"))
    best = each.join(files.select("file").distinct(), "file").groupBy("source", "specifier").agg(F.min_by("file", "_at").alias("target"))
    return imports.join(best, ["source", "specifier"], "left")


def fingerprint(sources: DataFrame, by: str) -> DataFrame:
    """A hash of all (file, hash) of each `by`, independent of row order; files are hashed in groups first, so no list holds them all."""
    line = F.sha2(F.concat_ws("|", "file", "hash"), 256)
    return sources.withColumn("_l", F.conv(F.substring(line, 1, 15), 16, 10).cast("long")).groupBy(by).agg(F.count("*").alias("files"), F.bit_xor("_l").alias("mark"))
