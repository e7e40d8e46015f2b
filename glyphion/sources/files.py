"""Files and commit logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphion.functions.languages import detect_language
from glyphion.functions.text import ignore_regex

# Directories and files that a scan skips.
SKIPPED_DIRS = [
    "node_modules", ".git", "dist", "build", "out", ".next", ".nuxt", "__pycache__", ".venv", "venv", "env", "target", "vendor", "coverage", ".nyc_output",
    ".cache", ".parcel-cache", ".idea", ".vscode", ".vs", "bin", "obj", ".svn", ".hg", "bower_components", ".gradle", ".terraform", ".tox", ".mypy_cache",
    ".pytest_cache", ".eggs", "Pods", ".dart_tool",
]
SKIPPED_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock", "Pipfile.lock", "bun.lockb"]


def fit_for_index(files: DataFrame, ignore: list[str] = (), most_bytes: int = 1 << 20) -> DataFrame:
    """files (file, content as bytes) without skipped, hidden, ignored, empty, large or binary ones."""
    parts = F.split("file", "/")
    dirs, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    keep = ~F.exists(dirs, lambda d: d.isin(SKIPPED_DIRS) | d.startswith(".")) & ~name.isin(SKIPPED_FILES)
    size = F.octet_length("content")
    keep &= (size > 0) & (size <= most_bytes) & (F.expr("position(X'00' IN substring(content, 1, 8192))") == 0)
    if ignore:
        keep &= ~F.col("file").rlike(ignore_regex(list(ignore)))
    return files.where(keep)


def scan_files(spark: SparkSession, root: str, ignore: list[str] = (), most_bytes: int = 1 << 20) -> DataFrame:
    """project files under root: file (relative), text, language, hash. Size limits reach the listing, before contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where((F.col("length") > 0) & (F.col("length") <= most_bytes))
    at = F.regexp_replace("path", "^file:/*", "/")
    files = raw.select(F.regexp_replace(at, "^" + root.rstrip("/").replace(".", r"\.") + "/", "").alias("file"), "content")
    kept = fit_for_index(files, ignore, most_bytes)
    return kept.select("file", F.decode("content", "UTF-8").alias("text"), detect_language(F.col("file")).alias("language"), F.sha1("content").alias("hash"))


def parse_git_log(blocks: DataFrame) -> DataFrame:
    """Commits (hash, author, date, message, files) of log blocks: a header hash|author|email|date|message, then file lines."""
    lines = F.split(F.trim("block"), "\n")
    head = F.split(lines[0], r"\|")
    names = F.filter(F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x)), lambda x: x != "")
    return blocks.where(F.size(head) >= 5).select(head[0].alias("hash"), head[1].alias("author"), head[3].alias("date"), F.array_join(F.slice(head, 5, F.size(head)), "|").alias("message"), names.alias("files"))


def recent_changes(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Each commit with how many of its files are indexed and how many are not."""
    each = commits.select("hash", F.explode("files").alias("file")).join(files.select("file").distinct().withColumn("_in", F.lit(True)), "file", "left")
    return each.groupBy("hash").agg(F.count_if(F.col("_in")).alias("indexed"), F.count_if(F.col("_in").isNull()).alias("not_indexed"))


def file_history(commits: DataFrame, file: str, limit: int = 10) -> DataFrame:
    """The last commits (as parse_git_log gives them) that touch a file."""
    return commits.where(F.array_contains("files", file)).orderBy(F.desc("date"), "hash").limit(limit)


def since(commits: DataFrame, today: Column, days: int) -> DataFrame:
    """Commits of the last days."""
    return commits.where(F.to_date("date") >= F.date_sub(today, days))


def readable(files: DataFrame, ignore: list[str] = (), most_bytes: int = 1 << 16) -> DataFrame:
    """files (file relative to the root, content as bytes) that may be read again: not ignored, not above the root, not too large, without NUL."""
    keep = ~F.col("file").startswith("/") & ~F.col("file").rlike(r"(^|/)\.\.(/|$)")
    keep &= (F.octet_length("content") <= most_bytes) & (F.expr("position(X'00' IN content)") == 0)
    if ignore:
        keep &= ~F.col("file").rlike(ignore_regex(list(ignore)))
    return files.where(keep)
