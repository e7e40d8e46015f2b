"""The symbol graph of source files: nodes, edges, look-ups, bounded traversal, context.

Files are parsed one by one in Arrow batches; what reaches beyond a file is resolved by joins of
requests (module, parent, name) with the files that imports lead to and the nodes in them; a whole
package answers by the names that it has once, never file by file. A name that several nodes could
mean stays unresolved. Edges are told apart where they are parsed, so only requests, resolved ones
and imports are shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphion.functions.languages import graph_language
from glyphion.functions.text import normalize_path
from glyphion.operators.graph import resolve_imports
from glyphion.parsing.units import candidates, parse
from glyphion.storage import durable

KINDS = ["CALLS", "REFERENCES", "IMPORTS", "DEFINES"]
NODE = "id string, file string, name string, kind string, start_line int, end_line int, column int, parent_id string, signature string, exported boolean"
EDGE = "id string, source_id string, target_id string, kind string, file string, line int, column int, target_name string, resolution string"
_FACT = (
    "what string, file string, language string, namespace string, id string, name string, kind string, start_line int, end_line int, column int, parent_id string, parent string,"
    " signature string, exported boolean, target_id string, module string, want_parent string, want_name string, tried array<string>, again boolean"
)


def _digest(*parts) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode("utf-8", "surrogatepass")).hexdigest()


def _facts(batches):
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, types[t]) for n, t in (f.split() for f in _FACT.split(", "))])
    for batch in batches:
        rows = []
        for file, text, language in zip(*(batch.column(c).to_pylist() for c in ("file", "text", "language"))):
            u = parse(text, language)
            file_id = _digest("file", file)
            ids = [_digest(file, n.start_line, n.column, n.kind, n.name) for n in u.nodes]
            at = lambda k: ids[k] if k >= 0 else file_id  # noqa: E731, B023
            common = {"file": file, "language": language, "namespace": u.namespace}
            rows.append({**common, "what": "node", "id": file_id, "name": file, "kind": "file", "start_line": 1, "end_line": (text or "").count("\n") + 1, "column": 1, "signature": "", "exported": False})
            defined = set()
            for k, n in enumerate(u.nodes):
                again = (ids[k], at(n.parent)) in defined
                defined.add((ids[k], at(n.parent)))
                rows.append({
                    **common, "what": "node", "again": again, "id": ids[k], "name": n.name, "kind": n.kind, "start_line": n.start_line, "end_line": n.end_line, "column": n.column,
                    "parent_id": at(n.parent), "parent": u.nodes[n.parent].name if n.parent >= 0 else None, "signature": n.signature, "exported": n.exported,
                })
            called = {(at(x.owner), x.line, x.column, ids[x.target]) for x in u.uses if x.call and x.target >= 0}
            used = set()
            for x in u.uses:
                key = (at(x.owner), x.call, x.line, x.column, x.name)
                if key in used or not x.call and x.target >= 0 and (at(x.owner), x.line, x.column, ids[x.target]) in called:  # a call is a reference too
                    continue
                used.add(key)
                kind = u.nodes[x.target].kind if x.target >= 0 else None
                rows.append({
                    **common, "what": "call" if x.call else "reference", "parent_id": at(x.owner), "name": x.name, "start_line": x.line, "column": x.column,
                    "target_id": ids[x.target] if x.target >= 0 else None, "kind": kind, "module": x.module, "want_parent": x.want_parent, "want_name": x.want_name,
                })
            for i in {(i.module, i.line, i.column): i for i in u.imports}.values():
                rows.append({**common, "what": "import", "parent_id": file_id, "name": i.module, "module": i.module, "start_line": i.line, "column": i.column, "tried": candidates(i.module, file, language)})
            rows += [{**common, "what": "warning", "name": w} for w in u.warnings]
        yield pa.RecordBatch.from_pydict({c: [r.get(c) for r in rows] for c in schema.names}, schema=schema)


def analyse(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (NODE), edges (EDGE) and warnings (file, warning) of files (file, text) in the languages of the graph.

    Files of other languages and null texts give nothing. What was parsed is stored, since it is
    read several times.
    """
    rows = files.where("text is not null").select("file", "text", graph_language(F.col("file")).alias("language")).where("language is not null")
    facts = durable(rows.mapInArrow(_facts, _FACT))
    nodes = facts.where("what = 'node'")
    imports = facts.where("what = 'import'")
    packages = _packages(imports)
    bound = _imported_files(imports, nodes, packages)
    found = facts.where("what in ('call', 'reference')").select("what", "file", "language", "namespace", "parent_id", "name", "start_line", "column", "kind", "target_id", "module", "want_parent", "want_name")
    own, asking = found.where("target_id is not null or want_name is null"), found.where("target_id is null and want_name is not null")
    asking = asking.withColumn("_use", F.sha2(F.concat_ws("|", "file", "parent_id", "what", "start_line", "column", "name"), 256))
    asked = asking.select("_use", "file", "language", "namespace", "module", "want_parent", F.col("want_name").alias("_name"))
    answered = asking.drop("kind", "target_id").join(_answers(asked, bound, packages, nodes), "_use", "left").withColumnsRenamed({"_kind": "kind", "_target": "target_id"})
    cols = ["what", "file", "parent_id", "name", "start_line", "column", F.when((F.col("what") == "reference") | F.col("kind").isin("function", "method", "class"), F.col("target_id")).alias("_t")]
    own, answered = own.select(cols), answered.select(cols)
    calls = lambda uses: uses.where("what = 'call'").select(*_edge("CALLS", F.col("_t"), F.col("name")))
    refers = lambda uses: uses.where("_t is not null").select(*_edge("REFERENCES", F.col("_t"), F.col("name")))
    defines = nodes.where("kind <> 'file' and not again").select(*_edge("DEFINES", F.col("id"), F.col("name")))
    brought = imports.select("file", "module", "start_line", "column").join(bound, ["file", "module"], "left").withColumn("parent_id", F.sha2(F.concat_ws("|", F.lit("file"), "file"), 256))
    brings = brought.select(*_edge("IMPORTS", F.col("_to_id"), F.col("module")))
    # Within a file, edges are told apart as they are parsed; what joins answer may lead twice to one target.
    joined = calls(answered).unionByName(refers(answered)).unionByName(brings)
    edges = calls(own).unionByName(refers(own)).unionByName(defines).unionByName(joined.where("target_id is null"))
    edges = edges.unionByName(joined.where("target_id is not null").dropDuplicates(["id"]))
    if not nodes.where("kind = 'file'").groupBy("file").count().where("count > 1").isEmpty():
        edges = edges.dropDuplicates(["id"])  # a path comes with several rows
    return nodes.select(*(c.split()[0] for c in NODE.split(", "))), edges, facts.where("what = 'warning'").select("file", F.col("name").alias("warning"))


def _edge(kind: str, target: Column, name: Column) -> list[Column]:
    key = F.sha2(F.concat_ws("|", F.col("parent_id"), F.coalesce(target, name), F.lit(kind), F.col("file"), F.col("start_line"), F.col("column")), 256)
    return [
        key.alias("id"), F.col("parent_id").alias("source_id"), target.alias("target_id"), F.lit(kind).alias("kind"), "file", F.col("start_line").alias("line"), "column", name.alias("target_name"),
        F.when(target.isNotNull(), "resolved").otherwise("unresolved").alias("resolution"),
    ]


def _packages(imports: DataFrame) -> DataFrame:
    """file, module, _dir: the folder of the Go package that an import leads to."""
    go = imports.where("language = 'go'").where(F.col("module").startswith(".")).select("file", "module").distinct()
    return go.select("file", "module", F.coalesce(F.nullif(normalize_path(F.concat(_dir("file"), F.lit("/"), "module")), F.lit("")), F.lit(".")).alias("_dir"))


def _imported_files(imports: DataFrame, nodes: DataFrame, packages: DataFrame) -> DataFrame:
    """file, module, _to, _to_id: the files that each import leads to; several only for a Go package."""
    files = nodes.where("kind = 'file'").select(F.col("file").alias("_to"), F.col("id").alias("_to_id"), F.col("language").alias("_lang"), F.col("namespace").alias("_space"))
    each = imports.select("file", "language", "module", "tried").distinct()
    paths = each.select("file", "module", "language", F.explode("tried").alias("_to")).join(files, "_to")
    alike = (F.col("language") == F.col("_lang")) | (F.col("language").isin("c", "cpp") & F.col("_lang").isin("c", "cpp"))
    paths = paths.where(alike).groupBy("file", "module").agg(F.count("*").alias("n"), F.first("_to").alias("_to"), F.first("_to_id").alias("_to_id")).where("n = 1").drop("n")
    script = resolve_imports(each.where("language = 'script'").select(F.col("file").alias("source"), F.col("module").alias("specifier")), files.select(F.col("_to").alias("file")))
    script = script.where("target is not null").select(F.col("source").alias("file"), F.col("specifier").alias("module"), F.col("target").alias("_to")).distinct().join(files.select("_to", "_to_id"), "_to")
    named = nodes.where("kind in ('class', 'interface', 'function')").select(
        F.concat_ws(".", F.nullif("namespace", F.lit("")), "name").alias("_q"), F.col("language").alias("_lang"), F.col("file").alias("_to")).distinct()
    named = named.groupBy("_q", "_lang").agg(F.count("*").alias("n"), F.first("_to").alias("_to")).where("n = 1").drop("n")
    asked = each.where("language in ('java', 'php', 'kotlin', 'csharp', 'scala')").withColumn("_q", F.translate("module", "\\/", ".."))
    whole = asked.join(named, (F.col("language") == F.col("_lang")) & (asked["_q"] == named["_q"])).select("file", "module", "_to").join(files.select("_to", "_to_id"), "_to")
    go = packages.join(files.where("_lang = 'go'").withColumn("_dir", _dir("_to")), "_dir")
    cols = ["file", "module", "_to", "_to_id"]
    return paths.select(cols).unionByName(script.select(cols)).unionByName(whole.select(cols)).unionByName(go.select(cols)).distinct()


def _dir(file: str) -> Column:
    return F.when(F.instr(file, "/") > 0, F.regexp_replace(file, "/[^/]*$", "")).otherwise(".")


def _answers(asked: DataFrame, bound: DataFrame, packages: DataFrame, nodes: DataFrame) -> DataFrame:
    """_use, _target, _kind where exactly one node answers.

    A Go package is asked as a whole: its nodes are counted by name first, so the work doesn't
    grow with requests times files.
    """
    held = nodes.where("kind <> 'file'").select("language", "namespace", F.col("file").alias("_to"), F.col("name").alias("_name"), F.col("parent").alias("_parent"), F.col("id").alias("_target"), F.col("kind").alias("_kind"))
    by_module = asked.where("module not in ('*', '.') and language <> 'go'").join(bound.select("file", "module", "_to"), ["file", "module"])
    included = asked.where("module = '*'").drop("module").join(bound.select("file", "_to"), "file")
    cols = ["_use", "_to", "_name", "want_parent"]
    wanted = by_module.select(cols).unionByName(included.select(cols)).distinct()
    met = wanted.join(held.drop("language", "namespace"), ["_to", "_name"]).where(F.col("_parent").eqNullSafe(F.col("want_parent")))
    met = met.groupBy("_use").agg(F.count("*").alias("_n"), F.first("_target").alias("_target"), F.first("_kind").alias("_kind")).where("_n = 1").drop("_n")
    go = held.where("language = 'go'").withColumn("_dir", _dir("_to"))
    once = lambda *keys: go.groupBy(*keys, "_name", "_parent").agg(F.count("*").alias("_n"), F.first("_target").alias("_target"), F.first("_kind").alias("_kind")).where("_n = 1")
    same = F.col("_parent").eqNullSafe(F.col("want_parent"))
    near = asked.where("module = '.'").withColumn("_dir", _dir("file")).join(once("_dir", "namespace"), ["_dir", "namespace", "_name"]).where(same)
    far = asked.where("module not in ('*', '.') and language = 'go'").join(packages, ["file", "module"]).join(once("_dir"), ["_dir", "_name"]).where(same)
    cols = ["_use", "_target", "_kind"]
    return met.select(cols).unionByName(near.select(cols)).unionByName(far.select(cols)).dropDuplicates(["_use"])


def find_nodes(nodes: DataFrame, symbol: str | None = None, file: str | None = None, line: int | None = None, limit: int = 21) -> DataFrame:
    """Nodes by name (files aside), file and first line, in order of place."""
    out = nodes
    if symbol is not None:
        out = out.where((F.col("name") == symbol) & (F.col("kind") != "file"))
    if file is not None:
        out = out.where(F.col("file") == file.replace("\\", "/"))
    if line is not None:
        out = out.where(F.col("start_line") == line)
    return out.orderBy("file", "start_line", "column", "id").limit(limit)


def find_edges(edges: DataFrame, ids: DataFrame, direction: str = "both", kinds: list[str] = KINDS, limit: int | None = None) -> DataFrame:
    """Edges at the nodes ids (id): incoming, outgoing or both; in order of place where there is a limit."""
    seeds = ids.select(F.col("id").alias("_seed")).distinct()
    mine = edges.where(F.col("kind").isin(kinds))
    sides = [F.col("target_id")] * (direction != "outgoing") + [F.col("source_id")] * (direction != "incoming")
    out = None
    for side in sides:
        met = mine.join(seeds, side == F.col("_seed"), "left_semi")
        out = met if out is None else out.unionByName(met)
    out = out.dropDuplicates(["id"])
    return out if limit is None else out.orderBy("file", "line", "column", "kind", "id").limit(limit)


def relations(nodes: DataFrame, edges: DataFrame, symbol: str, kind: str, file: str | None = None, line: int | None = None, limit: int = 50) -> DataFrame:
    """Where a symbol is called (CALLS) or referred to: file, line, column, source, target. The symbol must be the only one of its name."""
    at = find_nodes(nodes, symbol, file, line, 21).select("id", "name", "file", "start_line").collect()  # at most 21 rows
    if len(at) != 1:
        raise LookupError(f"{symbol!r} isn't in the graph" if not at else f"{symbol!r} is ambiguous: " + ", ".join(f"{r.file}:{r.start_line}" for r in at[:20]))
    met = edges.where((F.col("target_id") == at[0].id) & (F.col("kind") == kind)).orderBy("file", "line", "column", "id").limit(max(1, min(200, limit)))
    return met.join(nodes.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id", "left").select("file", "line", "column", "source", F.lit(symbol).alias("target"))


def traverse(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 1, most_nodes: int = 40, most_edges: int = 200, direction: str = "both") -> tuple[list, list, bool]:
    """Nodes and edges around seeds (id), level by level within the caps, and whether a cap cut anything.

    An edge is taken in order of place if its new ends fit. Each level reads at most most_edges + 1
    edges, so what the driver holds is bounded by the caps: 100 nodes, 500 edges, 3 levels.
    """
    most_nodes, most_edges, depth = max(1, min(100, most_nodes)), max(1, min(500, most_edges)), max(0, min(3, depth))
    spark = nodes.sparkSession
    first = nodes.join(seeds.select("id").distinct(), "id", "left_semi").orderBy("file", "start_line", "column", "id").limit(most_nodes + 1).collect()
    truncated = len(first) > most_nodes
    have = {r.id: r for r in first[:most_nodes]}
    taken: dict[str, object] = {}
    frontier = list(have)
    for _ in range(depth):
        if not frontier:
            break
        ids = spark.createDataFrame([(i,) for i in frontier], "id string")
        met = find_edges(edges, ids, direction, KINDS, most_edges + 1).collect()
        ends = {i for e in met for i in (e.source_id, e.target_id) if i is not None and i not in have}
        known = {r.id: r for r in nodes.join(F.broadcast(spark.createDataFrame([(i,) for i in ends], "id string")), "id", "left_semi").collect()} if ends else {}
        fresh: dict[str, object] = {}
        for e in met:
            if len(taken) >= most_edges:
                truncated = True
                break
            new = [i for i in dict.fromkeys((e.source_id, e.target_id)) if i is not None and i not in have]
            if len(have) + len(new) > most_nodes:
                truncated = True
                continue
            taken[e.id] = e
            for i in new:
                if i in known:
                    have[i] = fresh[i] = known[i]
        frontier = list(fresh)
    return list(have.values()), list(taken.values()), truncated


def fitting(pieces: list[str], budget: int, count) -> tuple[list[str], int]:
    """The pieces that fit a token budget when added one after the other, and how many were left out."""
    out, omitted = [], 0
    for p in pieces:
        if count("\n\n".join([*out, p])) <= budget:
            out.append(p)
        else:
            omitted += 1
    return out, omitted


def context(nodes: DataFrame, edges: DataFrame, files: DataFrame, seeds: DataFrame, budget: int = 4000, count=lambda s: len(s) // 4, **bounds) -> str:
    """A text about the graph around seeds (id): edges with their lines, then excerpts of up to 80 lines, within a token budget."""
    budget = max(256, min(20_000, budget))
    near, met, truncated = traverse(nodes, edges, seeds, **bounds)
    if not near:
        return "No graph seeds found."
    wanted = sorted({n.file for n in near} | {e.file for e in met})  # bounded by the traversal's caps
    lines = {r.file: (r.text or "").split("\n") for r in files.where(F.col("file").isin(wanted)).select("file", "text").collect()}
    by_id = {n.id: n for n in near}
    parts = ["Code graph context" + ("; traversal truncated" if truncated else "")]
    for e in sorted(met, key=lambda e: (e.kind == "DEFINES")):
        own = lines.get(e.file, [])
        said = own[e.line - 1].strip()[:250] if e.line <= len(own) else ""
        source = by_id[e.source_id].name if e.source_id in by_id else "<file>"
        target = by_id[e.target_id].name if e.target_id in by_id else e.target_name
        parts.append(f"{e.file}:{e.line}:{e.column} {source} {e.kind} {target} [{e.resolution}]" + (f"\n  {said}" if said else ""))
    for n in near:
        if n.kind != "file":
            end = min(n.end_line, n.start_line + 79)
            parts.append(f"{n.name} {n.file}:{n.start_line}-{end}\n{n.signature}\n" + "\n".join(lines.get(n.file, [])[n.start_line - 1 : end]))
    kept, omitted = fitting(parts, budget, count)
    return "\n\n".join(kept) + (f"\n\n{omitted} entries omitted" if omitted else "")


def refresh(sources: DataFrame, fingerprint: str | None, version: str = "1") -> tuple[str, bool]:
    """The fingerprint of sources (file, text) and whether the graph must be built anew."""
    line = F.sha2(F.concat_ws("|", "file", F.sha2("text", 256)), 256)
    rows = sources.agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(line, 1, 15), 16, 10).cast("long")).alias("a"), F.bit_xor(F.conv(F.substring(line, 16, 15), 16, 10).cast("long")).alias("b")).first()
    now = f"{version}|{rows.n}|{rows.a}|{rows.b}"
    return now, now != fingerprint


def graph_seeds(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """The declarations that search hits (file, start_line, end_line) overlap."""
    own = nodes.where("kind <> 'file'").select("id", "file", F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    return hits.join(own, "file").where("_e >= start_line and _s <= end_line").select("id").distinct()
