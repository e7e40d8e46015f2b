"""Incremental maintenance and statistics of tables of files, chunks, symbols and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], order: list[str], ties: list[str] | None = None) -> DataFrame:
    """One row a key, the last one in order: what remains when rows are written one after the other.

    Of rows equal in keys and order, the one that is least by ties; any of them without ties.
    """
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys, *order).agg(F.min_by(F.struct(*rest), F.struct(*ties)).alias("_r")) if ties else rows.withColumn("_r", F.struct(*rest))
    best = one.groupBy(*keys).agg(F.max_by("_r", F.struct(*order)).alias("_r"))
    return best.select(*keys, *(F.col("_r").getField(c).alias(c) for c in rest)).select(rows.columns)


def delete_files(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays and what goes when files (project, file) leave a table (project, file, ...)."""
    gone = files.select("project", "file").distinct()
    return rows.join(gone, ["project", "file"], "left_anti"), rows.join(gone, ["project", "file"], "left_semi")


def delete_project(held: dict[str, DataFrame], project: str) -> dict[str, DataFrame]:
    """All tables of an index, conversations included, without a project's rows."""
    return {name: rows.where(~F.col("project").eqNullSafe(F.lit(project))) for name, rows in held.items()}


def upsert_vectors(old: DataFrame, new: DataFrame, dimensions: int) -> DataFrame:
    """Vectors (id, vector) after an upsert; a vector of another length, null or with parts that aren't finite is an error."""
    fine = (F.size("vector") == dimensions) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    checked = new.withColumn("vector", F.when(fine, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit(f"a vector needs {dimensions} finite parts: "), F.col("id").cast("string"))).cast(new.schema["vector"].dataType)))
    return upsert(old, checked, ["id"])


def profile_gate(projects: DataFrame, profile: str) -> DataFrame:
    """project, action: whether files may be added one by one (`incremental`) or all must be embedded anew (`rebuild`).

    projects: project, profile. A profile that begins with `pending:` is of a run that didn't end.
    """
    same = F.col("profile").eqNullSafe(F.lit(profile))
    return projects.select("project", F.when(same, "incremental").otherwise("rebuild").alias("action"))


def changes(scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    """file, status: new, changed, unchanged or deleted, by content hash of (file, hash)."""
    a, b = scanned.select("file", F.col("hash").alias("now")), indexed.select("file", F.col("hash").alias("was"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("was"), "changed").otherwise("unchanged")
    return a.join(b, "file", "full_outer").select("file", status.alias("status"))


def language_breakdown(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("language").agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks"))


def project_stats(chunks: DataFrame) -> DataFrame:
    """Per project: files, chunks, total_lines (the sum of end lines) and chunks a file, rounded half up to one place."""
    out = chunks.groupBy("project").agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks"), F.coalesce(F.sum("end_line"), F.lit(0)).cast("long").alias("total_lines"))
    return out.withColumn("chunks_per_file", F.when(F.col("files") == 0, F.lit(0.0)).otherwise(F.floor(F.col("chunks") / F.col("files") * 10 + 0.5) / 10))


def dir_tree(files: DataFrame) -> DataFrame:
    """Files of each top directory; those at the root under '.'."""
    return files.select("file").distinct().groupBy(F.when(F.instr("file", "/") > 0, F.split("file", "/")[0]).otherwise(".").alias("dir")).agg(F.count("*").alias("files"))


def symbol_lookup(symbols: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Symbols whose name holds `name` in any case; exact names first, then by file and line."""
    own, want = F.lower("name"), name.lower()
    by = (F.when(own == want, 0).otherwise(1), "file", "line", "id")
    return symbols.where(F.instr(own, want) > 0).orderBy(*by).limit(min(limit, 200))


def symbol_kind_filter(hits: DataFrame, symbols: DataFrame, kind: str) -> DataFrame:
    """Hits whose file has a symbol of the kind; `export` means any exported symbol."""
    fit = symbols.where(F.col("exported") if kind == "export" else F.col("kind") == kind)
    return hits.join(fit.select("file").distinct(), "file", "left_semi")


def symbol_kind_counts(symbols: DataFrame) -> DataFrame:
    """Symbols by kind, and exported ones under `export`."""
    kinds = F.explode(F.array_compact(F.array(F.col("kind"), F.when(F.col("exported"), "export")))).alias("kind")
    return symbols.select(kinds).groupBy("kind").agg(F.count("*").alias("n"))


def chunk_of_line(points: DataFrame, chunks: DataFrame, span: int = 64) -> DataFrame:
    """points (file, line) with the first chunk (file, chunk_index, start_line, end_line) that holds the line.

    Chunks are keyed by the blocks of `span` lines they touch, so the range join is an equi join.
    """
    keyed = chunks.select("file", "chunk_index", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / span), F.floor(F.col("end_line") / span))).alias("_b"))
    met = points.select("file", "line").distinct().withColumn("_b", F.floor(F.col("line") / span)).join(keyed, ["file", "_b"]).where("start_line <= line and line <= end_line")
    return points.join(met.groupBy("file", "line").agg(F.min("chunk_index").alias("chunk_index")), ["file", "line"], "left")


def overlaps(hits: DataFrame, nodes: DataFrame, span: int = 64) -> DataFrame:
    """Pairs of hits and nodes of one file whose line ranges meet.

    Both are keyed by the blocks of `span` lines they touch; a pair is taken in the first block
    that they share, so it comes once.
    """
    blocks = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / span), F.floor(F.col(b) / span)))
    b = nodes.select("file", F.col("id").alias("node_id"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e")).withColumn("_b", blocks("_s", "_e"))
    met = hits.withColumn("_b", blocks("start_line", "end_line")).join(b, ["file", "_b"]).where("start_line <= _e and _s <= end_line")
    return met.where(F.col("_b") == F.floor(F.greatest("start_line", "_s") / span)).drop("_s", "_e", "_b")


def percentile(rows: DataFrame, value: str, share: float, by: list[str]) -> DataFrame:
    """The nearest-rank percentile of each group: the least value that a share of all reach."""
    return rows.groupBy(*by).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})").alias("value"), F.count("*").alias("n"))


def timings(rows: DataFrame, by: list[str], seconds: str = "seconds") -> DataFrame:
    """n, mean, least and most of each group's times."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(seconds), 6).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"))


def token_budget(rows: DataFrame, budget: int, order: str, tokens: str = "tokens", by: str = "query_id", buckets: int = 1024) -> DataFrame:
    """The longest prefix of each group, in the order of a whole number, whose tokens fit the budget.

    Groups are dealt by equal steps of the order, so that no task holds a whole group: the steps'
    sums tell where each begins, and steps that begin beyond the budget are dropped before rows
    are sorted.
    """
    ends = rows.groupBy(by).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    step = F.floor((F.col(order) - F.col("_lo")) * buckets / (F.col("_hi") - F.col("_lo") + 1)).cast("int")
    dealt = rows.join(ends, by).withColumn("_b", step).drop("_lo", "_hi")
    sums = dealt.groupBy(by, "_b").agg(F.sum(tokens).alias("_t"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows a group
    begins = sums.withColumn("_from", F.coalesce(F.sum("_t").over(before), F.lit(0))).where(F.col("_from") <= budget).drop("_t")
    within = Window.partitionBy(by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(begins, [by, "_b"]).withColumn("used", F.col("_from") + F.sum(tokens).over(within)).where(F.col("used") <= budget).drop("_b", "_from")


def thread_stats(entries: DataFrame) -> DataFrame:
    return entries.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length("text")).cast("long").alias("chars"))


def load_thread(entries: DataFrame, limit: int = 20) -> DataFrame:
    """The last `limit` entries of each thread, oldest first by `at`."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    out = entries.withColumn("_b", F.row_number().over(last)).where(F.col("_b") <= limit)
    return out.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("_b")


def debounce(events: DataFrame, gap_seconds: float, key: str, at: str = "ts") -> DataFrame:
    """Bursts of each key's events that are at most a gap apart: key, first, last, number."""
    own = Window.partitionBy(key).orderBy(at, "event_id")
    seconds = lambda c: c.cast("timestamp").cast("double")
    far = (seconds(F.col(at)) - seconds(F.lag(at).over(own))) > gap_seconds
    numbered = events.withColumn("_s", F.sum(F.when(far, 1).otherwise(0)).over(own))
    return numbered.groupBy(key, "_s").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n")).drop("_s")


def workspace_resolve(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Each path with the longest root (project, root) that it lies in, by whole segments."""
    ups = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split(F.col("path"), "/"), 1, i), "/"))
    met = paths.select("path", F.explode(ups).alias("root")).join(roots, "root")
    return paths.join(met.groupBy("path").agg(F.max_by("project", F.length("root")).alias("project")), "path", "left")


def file_complexity(files: DataFrame) -> DataFrame:
    """files (file, exports, imports, lines, chunks) with a score and its level."""
    score = 2 * F.col("exports") + F.col("imports") + F.floor(F.col("lines") / 50) + F.col("chunks")
    level = F.when(F.col("score") <= 5, "Low").when(F.col("score") <= 15, "Medium").when(F.col("score") <= 30, "High").otherwise("Very High")
    return files.withColumn("score", score.cast("long")).withColumn("level", level)
