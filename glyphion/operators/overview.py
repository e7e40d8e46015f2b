"""What a project is made of: entry points, frameworks, purposes, tests, similar files, and texts composed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphion.functions.text import basename
from glyphion.operators import graph, tables

# Paths at which programs begin.
ENTRY_POINTS = [
    r"^(src/)?index\.[jt]sx?$",
    r"^(src/)?main\.[jt]sx?$",
    r"^(src/)?app\.[jt]sx?$",
    r"^(src/)?server\.[jt]sx?$",
    r"^main\.py$",
    r"^app\.py$",
    r"^manage\.py$",
    r"^main\.go$",
    r"^cmd/.*\.go$",
    r"^src/main\.rs$",
    r"^src/lib\.rs$",
]
# Packages that name a framework, whether its version is shown, and the package that also gives one.
FRAMEWORK_PACKAGES = [
    ("react", "React", True),
    ("next", "Next.js", True),
    ("vue", "Vue.js", False),
    ("svelte", "Svelte", False),
    ("express", "Express.js", False),
    ("fastify", "Fastify", False),
    ("@nestjs/core", "NestJS", False),
    ("@angular/core", "Angular", False),
    ("@prisma/client", "Prisma", True),
    ("tailwindcss", "Tailwind CSS", True),
    ("turbo", "Turborepo", True),
    ("nx", "Nx", True),
    ("vitest", "Vitest (testing)", False),
    ("jest", "Jest (testing)", False),
    ("typescript", "TypeScript", False),
]
# Files that tell a package manager (the first one counts), and files that tell other things.
LOCK_FILES = [("pnpm-lock.yaml", "Package manager: pnpm (lockfile)"), ("yarn.lock", "Package manager: Yarn (lockfile)"), ("package-lock.json", "Package manager: npm (lockfile)")]
MARK_FILES = [
    (["pnpm-workspace.yaml", "lerna.json"], "Monorepo (workspace root)"),
    (["requirements.txt", "pyproject.toml"], "Python project"),
    (["go.mod"], "Go module"),
    (["Cargo.toml"], "Rust/Cargo"),
    (["pom.xml"], "Maven (Java)"),
    (["build.gradle", "build.gradle.kts"], "Gradle"),
    (["Dockerfile", "docker-compose.yml"], "Docker"),
]
# What a file is for, by its directory, then by its name.
DIRECTORY_PURPOSES = [
    (["services", "service"], "Service layer — business logic and data access."),
    (["tools", "handlers"], "Tool/handler — processes requests and returns responses."),
    (["routes", "api"], "API route — defines HTTP endpoints."),
    (["models", "entities"], "Data model — defines data structures and schema."),
    (["utils", "helpers"], "Utility functions — shared helper logic."),
    (["middleware"], "Middleware — request/response processing pipeline."),
    (["components"], "UI component."),
    (["hooks"], "React hook — reusable stateful logic."),
    (["tests", "__tests__"], "Test file."),
]
NAME_PURPOSES = [
    (["config"], "Configuration — environment variables and settings."),
    (["type", "interface"], "Type definitions — shared interfaces and types."),
    (["index"], "Entry point / barrel file — re-exports and initialization."),
    (["test", "spec"], "Test file."),
    (["schema"], "Schema definition."),
    (["migration"], "Database migration."),
]
# Names of test files and of their directories.
TEST_FILE = r"\.(test|spec)\.(ts|tsx|js|jsx|py|go|rs|java|rb)$"
TEST_DIRECTORY = r"__(tests|specs)__"
TEST_ENDINGS = [".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx", ".test.js", ".spec.js"]
# Manifests and documents that a workspace is introduced by, and how many characters of each.
MANIFESTS = [("package.json", 1600), ("README.md", 1000), ("README", 1000), ("pyproject.toml", 1000), ("Cargo.toml", 1000), ("AGENTS.md", 1000), ("CLAUDE.md", 1000)]


def _slashed(c: str = "file") -> Column:
    return F.translate(F.col(c), "\\", "/")


def entry_points(files: DataFrame) -> DataFrame:
    """Files (file) at which a program begins."""
    return files.select(_slashed().alias("file")).distinct().where(F.col("file").rlike("|".join(ENTRY_POINTS)))


def is_test(file: Column) -> Column:
    return file.rlike(TEST_FILE) | file.rlike(TEST_DIRECTORY)


def purpose(file: Column, language: Column, has_classes: Column, has_functions: Column) -> Column:
    """What a file seems to be for: by its directory, its name, then what it exports."""
    parts = F.split(F.lower(F.translate(file, "\\", "/")), "/")
    name, directory = F.element_at(parts, -1), F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise("")
    out = None
    tests = [(directory.isin(d), t) for d, t in DIRECTORY_PURPOSES] + [(name.rlike("|".join(n)), t) for n, t in NAME_PURPOSES]
    tests += [(has_classes & has_functions, "Module with classes and utility functions."), (has_classes, "Class definitions."), (has_functions, "Function library.")]
    for test, said in tests:
        out = F.when(test, said) if out is None else out.when(test, said)
    return out.otherwise(F.concat(language, F.lit(" module.")))


def infer_purposes(files: DataFrame, exports: DataFrame) -> DataFrame:
    """file, purpose of files (file, language), with exports (file, kind)."""
    kinds = exports.groupBy("file").agg(F.bool_or(F.col("kind") == "class").alias("_c"), F.bool_or(F.col("kind") == "function").alias("_f"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return files.join(kinds, "file", "left").select("file", purpose(F.col("file"), F.col("language"), no("_c"), no("_f")).alias("purpose"))


def dependencies_of(manifest: Column) -> Column:
    """name -> version of all dependencies in a package.json text, those for development included; null where it isn't JSON."""
    parsed = F.from_json(manifest, "dependencies map<string,string>, devDependencies map<string,string>")
    none = F.from_json(F.lit("{}"), "map<string,string>")
    a, b = F.coalesce(parsed["dependencies"], none), F.coalesce(parsed["devDependencies"], none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def tech_stack(manifest: Column, most: int = 40) -> Column:
    """Names of dependencies, then of those for development, each once."""
    parsed = F.from_json(manifest, "dependencies map<string,string>, devDependencies map<string,string>")
    keys = lambda c: F.coalesce(F.map_keys(parsed[c]), F.array().cast("array<string>"))
    return F.slice(F.array_union(keys("dependencies"), keys("devDependencies")), 1, most)


def frameworks(files: DataFrame) -> DataFrame:
    """project, framework: what package.json (project, file, text) and the names of files tell. In the order of the lists by `at`."""
    rows = files.select("project", _slashed().alias("file"), "text")
    manifest = rows.where("file = 'package.json'").select("project", dependencies_of(F.col("text")).alias("_d"), F.get_json_object("text", "$.type").alias("_type"))
    marks = sorted({f for f, _ in LOCK_FILES} | {f for n, _ in MARK_FILES for f in n} | {"prisma/schema.prisma", "nx.json", "turbo.json", "components.json"})
    have = rows.groupBy("project").agg(F.collect_set(F.when(F.col("file").isin(marks), F.col("file"))).alias("_files")).join(manifest, "project", "left")
    has = lambda f: F.array_contains("_files", f)
    dep = lambda p: F.coalesce(F.map_contains_key("_d", F.lit(p)), F.lit(False))
    shown = lambda name, version: F.when(version.isNull(), F.lit(name)).otherwise(F.concat(F.lit(name + " ("), version, F.lit(")")))
    found = []
    for package, name, versioned in FRAMEWORK_PACKAGES:
        there, version = dep(package), F.try_element_at("_d", F.lit(package))
        if package == "@prisma/client":
            there, version = there | (has("prisma/schema.prisma") & F.col("_d").isNotNull()), F.coalesce(version, F.try_element_at("_d", F.lit("prisma")))
        if package == "nx":
            there = there | (has("nx.json") & F.col("_d").isNotNull())
        found.append(F.when(there, shown(name, version) if versioned else F.lit(name)))
        if package == "nx":
            found.append(F.when(has("components.json") & F.col("_d").isNotNull(), "shadcn/ui (components.json)"))
    found.append(F.when(F.col("_type") == "module", "ESM modules"))
    found.append(F.coalesce(*(F.when(has(f), t) for f, t in LOCK_FILES)))
    found.append(F.when(has("turbo.json") & ~dep("turbo"), "Turborepo (turbo.json)"))
    found.append(F.when(has("nx.json") & F.col("_d").isNull(), "Nx (nx.json)"))
    for names, said in MARK_FILES:
        there = has(names[0])
        for n in names[1:]:
            there = there | has(n)
        found.append(F.when(there, said))
    return have.select("project", F.posexplode(F.array_compact(F.array(*found))).alias("at", "framework"))


def exports_by_file(exports: DataFrame, rows: int = 30, files: int = 20) -> DataFrame:
    """file, names: the first exports (file, name, line) by place, grouped, for the first files."""
    first = exports.orderBy("file", "line", "name").limit(rows)
    names = F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda x: x["name"])
    return first.groupBy("file").agg(names.alias("names")).orderBy("file").limit(files)


def test_files(targets: DataFrame, files: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """file, test: existing files (file) named as tests of each target (file), and its importers (edges: source, target) that are tests."""
    base = F.regexp_replace("file", r"\.[^.]+$", "")
    named = F.array(*(F.concat(base, F.lit(e)) for e in TEST_ENDINGS), F.concat(F.lit("__tests__/"), basename(F.col("file"))))
    wanted = targets.select("file").distinct().select("file", F.explode(named).alias("test"))
    there = wanted.join(files.select(F.col("file").alias("test")).distinct(), "test", "left_semi").select("file", "test", F.lit(0).alias("_p"))
    importers = edges.join(targets.select(F.col("file").alias("target")).distinct(), "target").where(is_test(F.col("source")))
    both = there.unionByName(importers.select(F.col("target").alias("file"), F.col("source").alias("test"), F.lit(1).alias("_p"))).groupBy("file", "test").agg(F.min("_p").alias("_p"))
    order = Window.partitionBy("file").orderBy("_p", "test")
    return both.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).drop("_p")


def similar_files(targets: DataFrame, hits: DataFrame, most: int = 5) -> DataFrame:
    """file, similar, at: of each target's hits (file, similar, language, rank) those with its extension first, then the rest; no text files, no file twice."""
    ext = lambda c: F.lower(F.element_at(F.split(c, r"\."), -1))
    rows = hits.join(targets.select("file").distinct(), "file", "left_semi").where("language <> 'text' and similar <> file")
    best = rows.groupBy("file", "similar").agg(F.min("rank").alias("rank"))
    same = F.when(F.col("similar").endswith(F.concat(F.lit("."), ext(F.col("file")))), 0).otherwise(1)
    order = Window.partitionBy("file").orderBy(same, "rank", "similar")
    return best.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).select("file", "similar", "at")


def freshness(located: DataFrame, live: DataFrame, indexed: DataFrame) -> DataFrame:
    """located (file, ...) with freshness: live (file, hash) against indexed (file, hash) hashes: fresh, stale, unverified or missing_or_excluded."""
    now, was = live.select("file", F.col("hash").alias("_now")), indexed.select("file", F.col("hash").alias("_was"))
    status = F.when(F.col("_now").isNull(), "missing_or_excluded").when(F.col("_was").isNull(), "unverified").when(F.col("_now") == F.col("_was"), "fresh").otherwise("stale")
    return located.join(now, "file", "left").join(was, "file", "left").withColumn("freshness", status).drop("_now", "_was")


def locate(queries: DataFrame, files: DataFrame, symbols: DataFrame, keyword: DataFrame, limit: int = 8) -> DataFrame:
    """query_id, file, line, symbol, origin, at: the places of each query (query_id, query), by the first strategy that has any.

    Files whose path or name the query is; else, for a query that is one name, symbols (file,
    name, line) that contain it, exact names first; else the keyword hits (query_id, file, line, rank).
    """
    asked = queries.select("query_id", F.trim("query").alias("query"))
    none = F.lit(None).cast("string")
    path = F.translate("query", "\\", "/")
    own = files.select("file").distinct()
    by_path = asked.select("query_id", path.alias("file")).join(own, "file", "left_semi").select("query_id", "file")
    by_name = asked.join(own.select("file", basename(F.col("file")).alias("query")), "query").select("query_id", "file")
    by_file = by_path.union(by_name).distinct().select("query_id", "file", F.lit(1).cast("long").alias("line"), none.alias("symbol"), F.lit("file").alias("origin"), F.lit(0).alias("_s"), F.lit(0).cast("long").alias("_o"))
    names = asked.where(F.col("query").rlike(r"^[\w$]+$"))
    # A few queries are the request; symbols meet them where they are.
    met = symbols.select("file", "name", "line").join(F.broadcast(names), F.contains(F.lower("name"), F.lower("query")))
    by_symbol = met.select("query_id", "file", F.col("line").cast("long").alias("line"), F.col("name").alias("symbol"), F.lit("symbol_index").alias("origin"), F.lit(1).alias("_s"), F.when(F.lower("name") == F.lower("query"), 0).otherwise(1).cast("long").alias("_o"))
    by_word = keyword.select("query_id", "file", F.col("line").cast("long").alias("line"), none.alias("symbol"), F.lit("keyword").alias("origin"), F.lit(2).alias("_s"), F.col("rank").cast("long").alias("_o"))
    every = by_file.unionByName(by_symbol).unionByName(by_word)
    first = every.groupBy("query_id").agg(F.min("_s").alias("_s"))
    kept = every.join(F.broadcast(first), ["query_id", "_s"]).groupBy("query_id", "file", "line", "symbol", "origin").agg(F.min("_o").alias("_o"))
    order = Window.partitionBy("query_id").orderBy("_o", "file", "line", "symbol")
    return kept.withColumn("at", F.row_number().over(order)).where(F.col("at") <= limit).drop("_o")


def excerpt(files: DataFrame, located: DataFrame, before: int = 1, after: int = 5, most: int = 700) -> DataFrame:
    """located (file, line) with the lines around each place, from files (file, text)."""
    lines = files.select("file", F.split("text", "\n", -1).alias("_l"))
    first = F.greatest(F.col("line") - before, F.lit(1)).cast("int")
    shown = F.substring(F.array_join(F.slice("_l", first, (F.col("line") + after - first).cast("int")), "\n"), 1, most)
    return located.join(lines, "file", "left").withColumn("excerpt", shown).drop("_l")


def impact_set(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """The seeds (file) and all that reaches them, in the order of names by `at` (None for no order at scale)."""
    return seeds.select("file", F.lit(0).alias("depth")).unionByName(graph.impact(edges, seeds, depth).select("file", "depth"))


def index_parity(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """project, chunks, vectors, relation: whether each project has as many vectors as chunks."""
    a, b = chunks.groupBy("project").agg(F.count("*").alias("chunks")), vectors.groupBy("project").agg(F.count("*").alias("vectors"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = a.join(b, "project", "full_outer").select("project", none("chunks"), none("vectors"))
    return out.withColumn("relation", F.when(F.col("chunks") == F.col("vectors"), "match").otherwise("mismatch"))


def overview(name: str, chunks: DataFrame, files: DataFrame, exports: DataFrame) -> str:
    """A text about a project: structure, languages, entry points, frameworks and exports. chunks: project, file_path, language, end_line; files: project, file, text."""
    stats = tables.project_stats(chunks).first()
    dirs = tables.dir_tree(files).orderBy(F.desc("files"), "dir").limit(50).collect()
    languages = tables.language_breakdown(chunks).orderBy(F.desc("chunks"), "language").limit(100).collect()
    entries = [r.file for r in entry_points(files).orderBy("file").limit(50).collect()]
    found = [r.framework for r in frameworks(files).orderBy("at").collect()]
    offered = exports_by_file(exports).collect()
    part = lambda title, rows, none: ["", f"### {title}", *(rows or [f"_{none}_"])]
    return "\n".join([
        f"## Project: {name}",
        *part("Structure", [f"  {'(root)' if r.dir == '.' else r.dir + '/'}: {r.files}" for r in dirs], "no files"),
        *part("Languages", [f"| {r.language} | {r.files} | {r.chunks} |" for r in languages], "none"),
        "", f"{stats.files if stats else 0} files, {stats.chunks if stats else 0} chunks, {stats.total_lines if stats else 0} lines",
        *part("Entry points", [f"- {e}" for e in entries], "none detected"), *part("Patterns", [f"- {f}" for f in found], "none detected"),
        *part("Exports", [f"- {r.file}: {', '.join(r.names)}" for r in offered], "none indexed"),
    ])


def briefing_key(files: int, chunks: int, indexed_at: str, head: str | None) -> str:
    return f"{files}|{chunks}|{indexed_at}|{head or ''}"


def briefing(name: str, key: str, held: dict[str, tuple[str, str]], chunks: DataFrame, files: DataFrame, exports: DataFrame, again: bool = False) -> tuple[str, bool]:
    """A project's introduction, and whether it came from `held` (name -> key, text), which is kept up to date."""
    if not again and held.get(name, ("", ""))[0] == key:
        return held[name][1], True
    docs = {r.file: r.text for r in manifests(files).collect()}
    stack = files.where("file = 'package.json'").select(tech_stack(F.col("text")).alias("t")).first()
    said = [f"### {f}\n{docs[f]}" for f, _ in MANIFESTS if f in docs]
    text = "\n\n".join([f"# Project briefing: {name}", *said, *([f"Stack: {', '.join(stack.t[:30])}"] if stack and stack.t else []), overview(name, chunks, files, exports)])
    held[name] = key, text
    return text, False


def manifests(files: DataFrame) -> DataFrame:
    """The beginnings of manifests and documents at a project's root."""
    shown = F.coalesce(*(F.when(F.col("file") == f, F.substring("text", 1, n)) for f, n in MANIFESTS))
    return files.where(F.col("file").isin([f for f, _ in MANIFESTS])).select("file", shown.alias("text"))


def smart_context(file: str, chunks: DataFrame, edges: DataFrame, exports: DataFrame, files: DataFrame, task: str | None = None, kind: str = "general", most_chars: int = 25_000) -> str:
    """A text about one file: its first chunks, imports, importers, exports, and for a task its tests and what a change reaches."""
    first = chunks.where(F.col("file") == file).orderBy("chunk_index").limit(5 if task else 3).collect()
    if not first:
        raise LookupError(f"{file!r} isn't indexed")
    seed = chunks.sparkSession.createDataFrame([(file,)], "file string")
    take = lambda df, c, n: [r[0] for r in df.select(c).distinct().orderBy(c).limit(n).collect()]
    part = lambda title, rows: [f"### {title}", *(f"- {r}" for r in rows), ""] if rows else []
    body = "\n".join(r.content for r in first)
    out = [f"## File: {file}" + (f" (task: {task}, {kind})" if task else ""), "```", body[:most_chars] if most_chars else body, "```", ""]
    out += part("Imports", take(graph.dependencies(edges, seed), "target", 30 if task else 15))
    out += part("Depended on by", take(graph.dependents(edges, seed), "source", 20 if task else 10))
    out += part("Exports", [f"{r.name} ({r.kind}, line {r.line})" for r in exports.where(F.col("file") == file).orderBy("line").limit(20).collect()])
    if task and kind in ("refactor", "debug"):
        out += part("Impact", take(graph.impact(edges, seed, 3), "file", 200))
    if task:
        out += part("Tests", [r.test for r in test_files(seed, files, edges).orderBy("at").collect()])
    return "\n".join(out)
