"""Imports, exports and symbols of source files (file, text, language).

Line-based languages are read with column functions in the JVM; the JavaScript family needs a
reader of nested text and goes through Arrow batches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphion.parsing.script import Script

SCRIPTS = ["typescript", "javascript", "tsx", "jsx"]
IMPORT = "struct<specifier:string,names:array<string>,kind:string>"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _lines(files: DataFrame, languages: list[str]) -> DataFrame:
    rows = files.where(F.lower("language").isin(languages) & F.col("text").isNotNull())
    out = rows.select("file", F.lower("language").alias("language"), F.posexplode(F.split("text", "\n", -1)).alias("_at", "_raw"))
    return out.select("file", "language", (F.col("_at") + 1).cast("long").alias("line"), "_raw", _trimmed(F.col("_raw")).alias("_l"))


def _group(pattern: str, n: int = 1, of: str = "_l") -> Column:
    """The n-th group where the pattern matches, else null."""
    return F.when(F.col(of).rlike(pattern), F.regexp_extract(of, pattern, n))


def _listed(c: Column, alias: str | None = None) -> Column:
    one = lambda s: _trimmed(s) if alias is None else F.split(_trimmed(s), alias)[0]
    return F.filter(F.transform(F.split(c, ","), one), lambda s: s != "")


# The import and export forms that are read, line by line.
PYTHON_FROM = r"^from\s+([\w.]+)\s+import\s+(.+)"
PYTHON_IMPORT = r"^import\s+([\w.]+)(?:\s+as\s+\w+)?$"
GO_IMPORT = r'import\s+"([^"]+)"'
GO_BLOCK = r"import\s*\(([\s\S]*?)\)"
RUST_USE = r"^use\s+([\w:]+)(?:::\{([^}]*)\})?;"
RUST_MOD = r"^(?:pub\s+)?mod\s+(\w+);"
JAVA_IMPORT = r"^import\s+(?:static\s+)?([\w.]+(?:\.\*)?);"
PYTHON_DEF = r"^def\s+(\w+)\s*\("
PYTHON_CLASS = r"^class\s+(\w+)"
EXPORTS = {
    "go": [("function", r"^func\s+([A-Z]\w*)\s*\("), ("type", r"^type\s+([A-Z]\w*)\s+"), ("variable", r"^(?:var|const)\s+([A-Z]\w*)")],
    "rust": [
        ("function", r"^pub\s+(?:async\s+)?fn\s+(\w+)"),
        ("class", r"^pub\s+struct\s+(\w+)"),
        ("enum", r"^pub\s+enum\s+(\w+)"),
        ("interface", r"^pub\s+trait\s+(\w+)"),
    ],
}


def parse_imports(files: DataFrame) -> DataFrame:
    """file, line, specifier, names, kind (static, dynamic, require, type-only) of imports.

    names: what is imported by its original name; null where a whole module is. line is null for
    Go, whose imports are matched over lines. Null texts and other languages have no imports.
    """
    none = F.lit(None).cast("array<string>")
    # The list in braces ends the path, so the colons before it belong to neither.
    use = F.regexp_replace(_group(RUST_USE), r"::$", "")
    said = lambda spec, names: F.struct(spec.alias("specifier"), names.alias("names"))
    python = F.coalesce(
        F.when(F.col("_l").rlike(PYTHON_FROM), said(_group(PYTHON_FROM), _listed(_group(PYTHON_FROM, 2), r"\s+as\s+"))),
        F.when(F.col("_l").rlike(PYTHON_IMPORT), said(_group(PYTHON_IMPORT), none)),
    )
    rust = F.coalesce(
        F.when(F.col("_l").rlike(RUST_USE), said(use, F.when(F.nullif(_group(RUST_USE, 2), F.lit("")).isNotNull(), _listed(_group(RUST_USE, 2))))),
        F.when(F.col("_l").rlike(RUST_MOD), said(_group(RUST_MOD), none)),
    )
    java = F.when(F.col("_l").rlike(JAVA_IMPORT), said(_group(JAVA_IMPORT), none))
    by_line = F.when(F.col("language") == "python", python).when(F.col("language") == "rust", rust).otherwise(java)
    lines = _lines(files, ["python", "rust", "java", "kotlin"]).withColumn("_i", by_line).where("_i is not null")
    out = lines.select("file", "line", "_i.specifier", "_i.names", F.lit("static").alias("kind"))
    go = files.where((F.lower("language") == "go") & F.col("text").isNotNull())
    block = F.regexp_extract("text", GO_BLOCK, 1)
    found = F.concat(F.regexp_extract_all("text", F.lit(GO_IMPORT), 1), F.regexp_extract_all(block, F.lit('"([^"]+)"'), 1))
    out = out.unionByName(go.select("file", F.lit(None).cast("long").alias("line"), F.explode(found).alias("specifier"), none.alias("names"), F.lit("static").alias("kind")))
    return out.unionByName(_from_scripts(files, _script_imports, "line long, specifier string, names array<string>, kind string"))


def parse_exports(files: DataFrame) -> DataFrame:
    """file, name, kind, line of what files offer: public top-level Python, capitalised Go, pub Rust, exported scripts."""
    first = F.col("_raw").rlike(r"^[ \t]")
    public = lambda p: F.when(~_group(p).startswith("_"), _group(p))
    named = lambda kind, name: F.when(name.isNotNull(), F.struct(F.lit(kind).alias("kind"), name.alias("name")))
    python = F.when(~first, F.coalesce(named("function", public(PYTHON_DEF)), named("class", public(PYTHON_CLASS))))
    others = {k: F.coalesce(*(named(kind, _group(p)) for kind, p in v)) for k, v in EXPORTS.items()}
    found = F.when(F.col("language") == "python", python).when(F.col("language") == "go", others["go"]).otherwise(others["rust"])
    # Python's patterns apply to the line as it is; trimming its ends changes nothing where it isn't indented.
    lines = _lines(files, ["python", "go", "rust"]).withColumn("_e", found).where("_e is not null")
    out = lines.select("file", "_e.name", "_e.kind", "line")
    return out.unionByName(_from_scripts(files, _script_exports, "name string, kind string, line long"))


def symbol_id(project: Column) -> Column:
    return F.sha2(F.concat_ws("|", project, "file", "name", F.col("line").cast("string"), "kind"), 256)


def extract_symbols(files: DataFrame, project: str = "") -> DataFrame:
    """id, file, name, kind, line, signature, parent, exported: top-level Python defs and classes, and all declarations of scripts."""
    lines = _lines(files, ["python"]).where(~F.col("_raw").rlike(r"^[ \t]"))
    kind = F.when(F.col("_l").rlike(PYTHON_DEF), "function").when(F.col("_l").rlike(PYTHON_CLASS), "class")
    name = F.coalesce(_group(PYTHON_DEF), _group(PYTHON_CLASS))
    signature = F.when(F.length("_l") > 200, F.concat(F.substring("_l", 1, 197), F.lit("..."))).otherwise(F.col("_l"))
    out = lines.where(kind.isNotNull()).select("file", name.alias("name"), kind.alias("kind"), "line", signature.alias("signature"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("exported"))
    out = out.unionByName(_from_scripts(files, _script_symbols, "name string, kind string, line long, signature string, parent string, exported boolean"))
    return out.select(symbol_id(F.lit(project)).alias("id"), *out.columns)


def _script_imports(s: Script) -> list[tuple]:
    return [(s.line(s.tokens[at].start), spec, names, kind) for spec, names, kind, at, _ in s.imports()]


def _script_exports(s: Script) -> list[tuple]:
    return [(name, kind, line) for name, kind, line in s.exports()]


def _script_symbols(s: Script) -> list[tuple]:
    return [(d.name, d.kind, d.start_line, d.signature, s.declarations[d.parent].name if d.parent >= 0 else None, d.exported) for d in s.declarations]


def _from_scripts(files: DataFrame, read, schema: str) -> DataFrame:
    whole = files.select("file").schema["file"]

    def run(batches):
        for batch in batches:
            rows = [(f, *r) for f, t in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()) for r in read(Script(t))]
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType([whole, *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)
    names, types = arrow.names, arrow.types
    rows = files.where(F.lower("language").isin(SCRIPTS) & F.col("text").isNotNull()).select("file", "text")
    return rows.mapInArrow(run, out)
