"""Line rules over source text: evidence, priority, coverage and a plan by category."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from glyphion.functions.text import glob_regex, redact
from glyphion.operators.search import reranked

# Rule id, category, CWE, title, kind, priority, pattern, steps that validate a finding.
RULES = [
    ("sql-concat", "injection", "CWE-89", "SQL statement assembled with interpolation/concatenation", "candidate", 80, r"""(?i)\b(?:SELECT|INSERT|UPDATE|DELETE)\b.*(?:\$\{|["'`]\s*\+|%\s*[\w(]|\.format\s*\()""",
     ["Trace each interpolated value to its input and any parameter binding.", "Add a regression test that treats input as data and verifies query parameters."]),
    ("shell", "command_execution", "CWE-78", "Shell or dynamic code execution boundary", "candidate", 90, r"""\b(?:eval|exec|execSync|os\.system)\s*\(|shell\s*[:=]\s*(?:true|True)\b""",
     ["Trace command/code input and check whether a shell interprets it.", "Use a sandboxed test with harmless input; verify argument separation and allowlists."]),
    ("html", "xss", "CWE-79", "HTML rendering sink", "candidate", 80, r"""dangerouslySetInnerHTML|\.innerHTML\s*=|\b(?:mark_safe|Html\.Raw)\s*\(""",
     ["Trace HTML provenance and sanitization through the rendering boundary.", "Add a browser regression test asserting untrusted markup cannot execute."]),
    ("outbound", "ssrf", "CWE-918", "Outbound request boundary", "candidate", 65, r"""\b(?:fetch|requests\.(?:get|post)|axios\.(?:get|post)|httpx\.(?:get|post))\s*\(""",
     ["Trace URL, redirects, DNS resolution and destination allowlists.", "Use a controlled local HTTP fixture to verify restricted destinations and redirect handling."]),
    ("file-access", "path_traversal", "CWE-22", "Filesystem access boundary", "candidate", 65, r"""\b(?:readFile(?:Sync)?|writeFile(?:Sync)?|sendFile|send_file|open|extractall)\s*\(""",
     ["Trace filename/archive entries and verify canonical paths remain inside the intended root.", "Add a temporary-directory test covering parent traversal and symlink escape."]),
    ("deserialize", "deserialization", "CWE-502", "Potentially unsafe object deserialization", "candidate", 85, r"""\b(?:pickle\.loads?|yaml\.load|unserialize|ObjectInputStream)\s*\(""",
     ["Determine whether serialized bytes can be attacker-controlled and which constructors are enabled.", "Verify a safe parser/schema with a benign malformed-input regression test."]),
    ("weak-crypto", "crypto", "CWE-327", "Weak algorithm or disabled token verification", "candidate", 75, r"""(?i)\b(?:md5|sha1)\s*\(|createHash\s*\(\s*["'](?:md5|sha1)["']|verify_signature["']?\s*[:=]\s*(?:false|False)""",
     ["Identify the security purpose; non-security checksums are not vulnerabilities.", "Verify appropriate password hashing, token signature/algorithm checks or integrity protection."]),
    ("credential", "secrets", "CWE-798", "Credential-like literal (value redacted)", "candidate", 100, r"""(?i)(?:api[_-]?key|secret|password|access[_-]?token)\s*[:=]\s*["'][^"'\r\n]{8,}["']|\b(?:sk-[\w-]{20,}|AKIA[A-Z0-9]{16}|gh[pousr]_[\w]{20,})\b|BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY""",
     ["Check locally whether the value is an example/fixture or a deployed credential; do not reveal it.", "For a real exposed credential, rotate/revoke it and replace literals with secret injection."]),
    ("debug-tls", "configuration", "CWE-16", "Debug or transport verification override", "candidate", 75, r"""\bDEBUG\s*[:=]\s*(?:true|True)|rejectUnauthorized\s*:\s*false|verify\s*=\s*False|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*["']?0""",
     ["Check the effective deployed configuration, environment overrides and trust boundary.", "Assert secure production defaults and explicit local-development opt-ins."]),
    ("auth", "authentication", "CWE-287", "Authentication/session entry point", "surface", 60, r"""(?i)\b(?:login|authenticate|verifyToken|requireAuth|jwt\.verify|check_password|set_cookie)\s*\(""",
     ["Map token/session creation, verification, expiry and recovery flows.", "Test invalid, expired and revoked credentials and rate limits with owned test accounts."]),
    ("route", "authorization", "CWE-862", "Route or access-control boundary", "surface", 60, r"""\b(?:app|router)\.(?:get|post|put|patch|delete|use)\s*\(|permission_classes|has_permission|IsAuthenticated|@(?:login_required|permission_required)""",
     ["Trace caller identity, role, tenant and object ownership from route to data access.", "Use two owned test accounts to verify denied cross-user/tenant access and privileged actions."]),
    ("dependency", "dependencies", "CWE-1395", "Dependency manifest for version/advisory review", "surface", 40, r"""["'](?:dependencies|devDependencies)["']\s*:|^\s*[\w.-]+\s*(?:==|>=|~=)""",
     ["Resolve installed versions from lockfiles and compare with current authoritative advisories.", "Assess reachability and configuration before assigning a finding; this tool does not query advisory feeds."]),
]
# Bare credentials, which the rule `credential` also takes, and files that hold nothing else.
BARE_CREDENTIAL = r"""(?i)^\s*[\w.-]*(?:password|passwd|secret|api[_-]?key|access[_-]?token)[\w.-]*\s*[:=]\s*[^\s"'`]{8,}"""
CONTAINERS = r"(?i)(^|/)(?:\.env(?:\..*)?|\.mcp\.json|\.npmrc|\.pypirc|\.netrc)$|\.(?:pem|key|p12|pfx)$"
DEFAULT_QUERY = "Review source security boundaries and prioritize evidence for manual validation"
LONG_LINE, EXCERPT, REACH, QUERY_WORDS = 16_000, 1400, 2, 40


def _path(files: DataFrame) -> Column:
    return F.col("file").cast("string")


def scan(files: DataFrame, file_pattern: str | None = None, categories: list[str] | None = None, rules: list[tuple] = RULES) -> DataFrame:
    """id, file, line, category, rule, cwe, title, status, priority, excerpt, hash of each rule that a line meets. files: file, text.

    Files that only hold credentials are left out, and so are lines over 16,000 characters; both
    are counted by coverage(). The excerpt has two lines more on both sides, from the text as
    redacted as a whole, and up to 1,400 characters of them. Null texts have no lines. A file's
    lines are judged in its own row, so nothing is shuffled.
    """
    mine = [r for r in rules if not categories or r[1] in categories]
    scoped = _scoped(files, file_pattern).where(~_path(files).rlike(CONTAINERS))
    met = lambda line: F.array_compact(F.array(*(F.when(_meets(r, line), F.lit(i)) for i, r in enumerate(mine)))) if mine else F.array().cast("array<int>")
    judged = F.transform("_lines", lambda c: F.struct(c["at"].alias("at"), F.when(F.length(c["line"]) <= LONG_LINE, met(c["line"])).alias("r")))
    # What an explode gives is made once a row, before the next step asks for it: hits, and the redacted text of files that have any.
    hits = _likely(scoped, mine).select("file", "text", F.explode(F.array(F.filter(judged, lambda h: F.size(h["r"]) > 0))).alias("_hits")).where(F.size("_hits") > 0)
    shown = hits.select("file", F.sha1(F.col("text").cast("binary")).alias("hash"), "_hits", F.explode(F.array(F.split(redact(F.col("text")), "\n", -1))).alias("_shown"))
    first = lambda at: F.greatest(at + 1 - REACH, F.lit(1))
    cut = lambda at: F.substring(F.array_join(F.slice(F.col("_shown"), first(at), at + 2 + REACH - first(at)), "\n"), 1, EXCERPT)
    each = shown.select("file", "hash", F.explode(F.transform("_hits", lambda h: F.struct(h["at"].alias("at"), h["r"].alias("r"), cut(h["at"]).alias("excerpt")))).alias("h"))
    each = each.select("file", "hash", (F.col("h.at") + 1).cast("long").alias("line"), "h.excerpt", F.explode("h.r").alias("_i"))
    named = F.array(*(F.struct(F.lit(r[1]).alias("category"), F.lit(r[0]).alias("rule"), F.lit(r[2]).alias("cwe"), F.lit(r[3]).alias("title"), F.lit("needs_review" if r[4] == "candidate" else "surface").alias("status"), F.lit(r[5]).alias("priority")) for r in mine))
    out = each.withColumn("r", F.get(named, F.col("_i"))) if mine else each.withColumn("r", F.lit(None).cast("struct<category:string,rule:string,cwe:string,title:string,status:string,priority:int>"))
    return out.select(F.concat_ws(":", "r.rule", "file", "line").alias("id"), "file", "line", "r.*", "excerpt", "hash")


def _meets(rule: tuple, line: Column) -> Column:
    return line.rlike(rule[6]) | (line.rlike(BARE_CREDENTIAL) if rule[0] == "credential" else F.lit(False))


def _wide(pattern: str) -> str:
    """One of the patterns above, for bytes and any line of a text, as an expression of RE2 that meets whatever the pattern meets, and some more.

    Bounds of words go, since Java knows other letters; `.` takes all but a new line and white space
    the vertical tab, as they do there.
    """
    flags, body = ("im", pattern.removeprefix("(?i)")) if pattern.startswith("(?i)") else ("m", pattern)
    return f"(?{flags}:" + body.replace(r"\b", "").replace(".*", r"[^\n]*").replace(r"\s*", r"[\s\v]*") + ")"


def _likely(files: DataFrame, rules: list[tuple]) -> DataFrame:
    """files with _lines, the lines (at, line) that a rule may meet; files without any are left out.

    One automaton for all rules reads the texts, and then the lines of those that it meets. Only
    the patterns of RULES are known to have a wider form; with other ones every line may be met.
    """
    if not {r[6] for r in rules} <= {r[6] for r in RULES}:
        return files.withColumn("_lines", F.transform(F.split("text", "\n", -1), lambda line, at: F.struct(at.alias("at"), line.alias("line"))))
    any_of = "|".join(_wide(p) for r in rules for p in ([r[6], BARE_CREDENTIAL] if r[0] == "credential" else [r[6]])) or r"\b\B"
    names, at = files.columns, files.columns.index("text")

    def run(batches):
        meets = lambda a: pc.fill_null(pc.match_substring_regex(a.cast(pa.binary()), any_of), False)
        for batch in batches:
            kept = batch.filter(meets(batch.column(at)))
            lines = pc.split_pattern(kept.column(at), "\n")
            flat, row = lines.flatten(), pc.list_parent_indices(lines).to_numpy()
            place = np.arange(len(row)) - np.searchsorted(row, row)
            fit = meets(flat)
            there = fit.to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[there], minlength=kept.num_rows))])
            pairs = pa.StructArray.from_arrays([pa.array(place[there], pa.int32()), flat.filter(fit)], ["at", "line"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], [*names, "_lines"])

    return files.mapInArrow(run, StructType([*files.schema.fields]).add("_lines", ArrayType(StructType().add("at", IntegerType()).add("line", StringType()))))


def _scoped(files: DataFrame, file_pattern: str | None) -> DataFrame:
    rows = files.select("file", "text")
    return rows if file_pattern is None else rows.where(_path(rows).rlike(glob_regex(file_pattern)))


def coverage(files: DataFrame, file_pattern: str | None = None) -> DataFrame:
    """One row: indexed, scoped, scanned and skipped files, lines read, long lines left out, and whether any were."""
    inside = F.lit(True) if file_pattern is None else _path(files).rlike(glob_regex(file_pattern))
    skipped = inside & (_path(files).rlike(CONTAINERS) | F.col("text").isNull())
    sizes = F.transform(F.split("text", "\n", -1), F.length)
    lines, long_ = F.size(sizes), F.size(F.filter(sizes, lambda n: n > LONG_LINE))
    read = inside & ~skipped
    one = files.select(
        inside.alias("_in"), skipped.alias("_skip"), F.when(read, lines).otherwise(0).alias("_lines"), F.when(read, long_).otherwise(0).alias("_long"))
    out = one.agg(
        F.count("*").alias("indexed_files"), F.count_if("_in").alias("scoped_files"), F.count_if(F.col("_in") & ~F.col("_skip")).alias("scanned_files"), F.count_if("_skip").alias("skipped_files"),
        F.coalesce(F.sum("_lines"), F.lit(0)).cast("long").alias("lines"), F.coalesce(F.sum("_long"), F.lit(0)).cast("long").alias("long_lines"),
    )
    return out.withColumn("truncated", F.col("long_lines") > 0)


def query_words(query: str | None) -> list[str]:
    """Distinct words of three letters, digits or _ or more, lower-cased, the first forty."""
    import re

    return list(dict.fromkeys(re.findall(r"\w{3,}", (query or DEFAULT_QUERY).lower())))[:QUERY_WORDS]


def scored(evidence: DataFrame, query: str | None = None) -> DataFrame:
    """evidence with score: the rule's priority and 20 for each query word in file, category, title or excerpt."""
    said = F.lower(F.concat_ws(" ", F.col("file").cast("string"), "category", "title", "excerpt"))
    bonus = sum((F.when(F.contains(said, F.lit(w)), 20).otherwise(0) for w in query_words(query)), F.lit(0))
    return evidence.withColumn("score", (F.col("priority") + bonus).cast("long"))


def audit(files: DataFrame, query: str | None = None, limit: int = 20, rerank: Callable[[str, list[str]], list[float]] | None = None, pool: int = 50, **scope) -> tuple[DataFrame, str]:
    """The best evidence, ranked by score, file, line and rule, and what reranking did. The pool has at most 200 rows."""
    limit = max(1, min(100, limit))
    top = scored(scan(files, **scope), query).orderBy(F.desc("score"), "file", "line", "rule").limit(min(200, max(limit, pool)))
    hits, status = reranked(top.withColumn("content", F.concat(F.col("category"), F.lit(": "), F.col("title"), F.lit("\n"), F.col("excerpt"))), query or DEFAULT_QUERY, rerank)
    return hits.drop("content").orderBy(F.desc("score"), "file", "line", "rule").limit(limit), status


def plan(evidence: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """category, evidence, files, score (the best priority) and validation steps of each category that has evidence; nothing is executed."""
    steps = {}
    for r in rules:
        steps[r[1]] = list(dict.fromkeys(steps.get(r[1], []) + r[7]))
    known = F.create_map(*(x for c, v in steps.items() for x in (F.lit(c), F.array(*map(F.lit, v)))))
    out = evidence.groupBy("category").agg(F.count("*").alias("evidence"), F.countDistinct("file").alias("files"), F.max("priority").alias("score"))
    return out.select("category", "evidence", "files", "score", F.try_element_at(known, F.col("category")).alias("validation"), F.lit(False).alias("executed"))
