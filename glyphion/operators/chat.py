"""Conversations as tables: entries come in, threads are derived, old ones go; loading by time or by meaning.

entries: id, thread, project, source, role, content, created_at. Counters are derived, not stored.
Ages are measured from a moment that is passed in, so results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphion.functions.text import snippet
from glyphion.operators import retrieval


def source_of(role: Column) -> Column:
    """Messages of users, and those of assistants; tools' own entries are named when they are made."""
    return F.when(role == "user", "user-message").otherwise("ai-response")


def ingest(messages: DataFrame, project: str) -> DataFrame:
    """Entries of messages (thread, turn, role, content, created_at); ids are hashes, so that a second run makes the same."""
    id_ = F.sha2(F.concat_ws("|", F.lit(project), "thread", "turn", "role", "content"), 256)
    return messages.select(id_.alias("id"), "thread", F.lit(project).alias("project"), "turn", source_of(F.col("role")).alias("source"), "role", "content", "created_at")


def track(tool: str, query: str, hits: DataFrame) -> str:
    """A tool's entry: its query and the places of its five best hits (file, start_line, score)."""
    rows = hits.orderBy(F.desc("score")).limit(5).select("file", "start_line", "score").collect()
    if not rows:
        return f'[{tool}] "{query}": no results'
    return f'[{tool}] "{query}": {len(rows)} results\n' + "\n".join(f"  {r.file}:{r.start_line} [{r.score:.3f}]" for r in rows)


def threads(entries: DataFrame) -> DataFrame:
    """Of each thread: project, messages, chars, created_at, updated_at."""
    return entries.groupBy("thread").agg(
        F.min("project").alias("project"), F.count("*").alias("messages"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("chars"),
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"),
    )


def with_titles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Titles (thread, title) after an update: a new title takes the old one's place unless it is null."""
    a, b = old.select("thread", F.col("title").alias("_old")), new.select("thread", F.col("title").alias("_new"))
    return a.join(b, "thread", "full_outer").select("thread", F.coalesce("_new", "_old").alias("title"))


def latest_thread(entries: DataFrame, now: Column, seconds: float = 3600.0) -> DataFrame:
    """Of each project the thread that was last added to, if that was less than `seconds` ago."""
    per = threads(entries)
    best = per.groupBy("project").agg(F.max_by(F.struct("thread", "updated_at"), F.struct("updated_at", "thread")).alias("t")).select("project", "t.thread", "t.updated_at")
    return best.where(_seconds(now) - _seconds(F.col("updated_at")) < seconds)


def _seconds(c: Column) -> Column:
    return c.cast("timestamp").cast("double")


def recent(entries: DataFrame, now: Column, hours: float | None) -> DataFrame:
    """Entries of the last hours; None keeps all, and those without a time are none of the last."""
    return entries if hours is None else entries.where(_seconds(F.col("created_at")) >= _seconds(now) - 3600 * hours)


def load(entries: DataFrame, now: Column, limit: int = 20, hours: float | None = 168.0, thread: str | None = None, source: str | None = None) -> DataFrame:
    """The last `limit` entries of each project that pass the filters that are set, numbered `at` from the oldest."""
    out = recent(entries, now, hours)
    out = out if thread is None else out.where(F.col("thread") == thread)
    out = out if source is None else out.where(F.col("source") == source)
    last = Window.partitionBy("project").orderBy(F.desc("created_at"), F.desc("id"))
    out = out.withColumn("_b", F.row_number().over(last)).where(F.col("_b") <= limit)
    return out.withColumn("at", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("_b")))).drop("_b")


def recall(entries: DataFrame, vectors: DataFrame, query: list[float], now: Column, limit: int = 20, hours: float | None = 168.0) -> DataFrame:
    """The entries nearest to a query vector (vectors: id, vector), newest first by `at`; chronological where no vector answers."""
    asked = vectors.sparkSession.createDataFrame([(1, [float(x) for x in query])], "query_id long, query array<double>")
    near = retrieval.vector_search(vectors.select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding")), asked, limit).select(F.col("vec_id").alias("id"), "score")
    met = recent(entries, now, hours).join(F.broadcast(near), "id")  # at most `limit` rows
    if met.isEmpty():
        return load(entries, now, limit, hours)
    return met.withColumn("at", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("created_at"), F.desc("id"))))


def cleared(entries: DataFrame, project: str, now: Column, thread: str | None = None, hours: float | None = None) -> tuple[DataFrame, DataFrame]:
    """What stays and what goes when a project's entries, of one thread or older than some hours, are cleared."""
    goes = F.col("project") == project
    if thread is not None:
        goes = goes & (F.col("thread") == thread)
    if hours is not None:
        goes = goes & (_seconds(F.col("created_at")) < _seconds(now) - 3600 * hours)
    goes = F.coalesce(goes, F.lit(False))
    return entries.where(~goes), entries.where(goes)


def preview(entries: DataFrame, most_threads: int = 5, most_entries: int = 20, chars: int = 200) -> DataFrame:
    """Of each project's last threads the last entries, oldest first by `at`, and their beginnings."""
    order = Window.partitionBy("project").orderBy(F.desc("updated_at"), "thread")
    top = threads(entries).withColumn("_t", F.row_number().over(order)).where(F.col("_t") <= most_threads).select("thread", "project")
    last = Window.partitionBy("thread").orderBy(F.desc("created_at"), F.desc("id"))
    rows = entries.join(top, ["thread", "project"], "left_semi").withColumn("_b", F.row_number().over(last)).where(F.col("_b") <= most_entries)
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("thread").orderBy(F.desc("_b"))))
    shown = F.when(F.length("content") > chars, F.concat(F.substring("content", 1, chars), F.lit("..."))).otherwise(F.col("content"))
    return rows.select("project", "thread", "at", "role", shown.alias("preview"))


def shortened(entries: DataFrame, most: int = 2000) -> DataFrame:
    return entries.withColumn("content", snippet(F.col("content"), most))
