"""Single functions on small cases."""

import pytest
from pyspark.sql import functions as F

from glyphion.functions import text as T
from glyphion.operators import graph, retrieval, rules, tables
from glyphion.sources import chunks as C
from glyphion.sources import files as S


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column).first()[0]


@pytest.mark.parametrize("q, mode", [("/a+b/i", "regex"), ("src/app.ts", "keyword"), ("where is the login", "hybrid"), ("error", "keyword"), ("one two three four", "hybrid")])
def test_route(spark, q, mode):
    assert one(spark, T.route_mode(F.col("q")), q=q) == mode


def test_redaction_keeps_lines(spark):
    text = "a\n-----BEGIN RSA PRIVATE KEY-----\nxx\nyy\n-----END RSA PRIVATE KEY-----\npassword = 'abcdefgh'\nhttp://u:p@h/"
    out = one(spark, T.redact(F.col("t")), t=text)
    assert out.count("\n") == text.count("\n") and "xx" not in out and "abcdefgh" not in out and "u:p" not in out


def test_rules(spark):
    key = "token = 'gh" + "p_" + "a1" * 12 + "'"
    rows = [("a.py", "x = 1\ncursor.execute('SELECT * FROM t WHERE a=' + a)\neval(x)\n"), ("b", None), ("app/.env", "password = 'longenough'"), ("k.ts", key), ("w.js", "a" * 16_001 + " eval("), ("s.ts", "db.get('SELECT 1', [x])")]
    files = spark.createDataFrame(rows, "file string, text string")
    found = {(r.file, r.line, r.rule): r for r in rules.scan(files).collect()}
    assert {("a.py", 3, "shell"), ("a.py", 2, "sql-concat"), ("k.ts", 1, "credential")} == set(found)
    assert found["k.ts", 1, "credential"].excerpt == 'token = [REDACTED]' or "a1a1" not in found["k.ts", 1, "credential"].excerpt
    assert found["a.py", 3, "shell"].excerpt.startswith("x = 1") and found["a.py", 3, "shell"].status == "needs_review"
    got = rules.coverage(files).first()
    assert (got.indexed_files, got.scanned_files, got.skipped_files, got.long_lines, got.truncated) == (6, 4, 2, 1, True)
    assert rules.scan(files, categories=["injection"]).count() == 1 and rules.scan(files, file_pattern="*.ts").count() == 1
    best, status = rules.audit(files, "shell eval", 2)
    assert [r.rule for r in best.collect()] == ["shell", "sql-concat"] and status == "disabled"
    checks = {r.category: r for r in rules.plan(rules.scan(files)).collect()}
    assert checks["command_execution"].executed is False and len(checks["injection"].validation) == 2


def test_chunks_cover_all_lines(spark):
    lines = [f"line {i}" if i % 37 else "def f():" for i in range(400)]
    got = C.chunk_lines(lines)
    assert got[0][0] == 1 and got[-1][1] == 400 and all(b[0] <= a[1] + 1 for a, b in zip(got, got[1:]))
    assert C.chunk_lines(["a", "b"]) == [(1, 2)] and C.ranges_of("x", None) == [(1, 1)]
    files = spark.createDataFrame([("a.txt", "\n".join(lines)), ("b", None)], "file string, text string")
    rows = C.chunks(files).orderBy("file", "chunk_index").collect()
    assert [(r.start_line, r.end_line) for r in rows if r.file == "a.txt"] == got
    assert all(r.content == "\n".join(lines[r.start_line - 1 : r.end_line]) for r in rows if r.file == "a.txt") and rows[-1].content == ""


def test_breaks_before_a_declaration():
    lines = ["let a = 1"] * 55 + ["function late() {"] + ["  x()"] * 40 + ["}"]
    assert C.chunk_lines(lines)[1][0] == 56 - 5


def test_script_chunks_follow_declarations():
    body = "".join(f"  const v{i} = {i}\n" for i in range(40))
    text = f"function first() {{\n{body}}}\n// about second\nfunction second() {{\n{body}}}"
    lines, ranges = text.split("\n"), C.ranges_of("a.ts", text)
    assert ranges == [(1, 42), (43, 85)] and "\n".join(x for a, b in ranges for x in lines[a - 1 : b][:]) == text
    long = "function only() {\n" + "  go()\n" * 180 + "}"
    cut = C.ranges_of("a.js", long)
    assert all(b - a < 60 for a, b in cut) and cut[0][0] == 1 and cut[-1][1] == 182 and all(x[1] + 1 == y[0] for x, y in zip(cut, cut[1:]))
    assert C.ranges_of("a.js", long + "}") == C.chunk_lines((long + "}").split("\n"))


def test_scan_files(spark, tmp_path):
    for name, data in {"a.py": b"x", "node_modules/b.js": b"y", "c.bin": b"a\0b", "d/e.md": b"# t", ".h/f": b"z", "skip.log": b"l"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.file: r.language for r in S.scan_files(spark, str(tmp_path), ["*.log"]).collect()}
    assert got == {"a.py": "python", "d/e.md": "markdown"}


def test_impact_counts_least_depth(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("a", "c"), ("d", "c")], "source string, target string")
    got = {r.file: r.depth for r in graph.impact(edges, spark.createDataFrame([("a",)], "file string"), 3).collect()}
    assert got == {"b": 1, "c": 1, "d": 2}


def test_rrf_is_symmetric_in_ranks(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, doc_id int, rank int")
    assert [r.doc_id for r in retrieval.rrf(a, b).orderBy("rank").collect()] == [11, 10, 12]


def test_changes(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "file string, hash string")
    was = spark.createDataFrame([("b", "3"), ("c", "4")], "file string, hash string")
    assert {r.file: r.status for r in tables.changes(now, was).collect()} == {"a": "new", "b": "changed", "c": "deleted"}


def test_rules_judge_lines_in_place(spark):
    """The automaton that picks lines leaves none out, and nothing is shuffled."""
    import itertools

    from glyphion.operators import rules
    from glyphion.plans.twins import RISKY

    odd = [
        "SELECT a\u000b FROM t\u2028 x ${y}", "éselect 1 %\u000b x", "delete é" + "ö" * 30 + ".format\u000b(", "eval\u000b(", "éexec(x)", "ſelect ${", "SHELL = true", "shell\t:\ttrue", "PASSWORD: 'éöüéöüéö'", "password: 'éöüéöüé'",
        "sk-" + "a" * 19 + "-é", "sk-" + "a" * 20 + "é", "AKIA" + "Z" * 16, "\u000b a.b-c == 1", "numpy\u000b>=1", "x = secret_key: \u000babcdefgh", "my.api-key=\u2028abcdefg8", "verify=\u000bFalse", "BEGIN PRIVATE KEY", "jwt.verify\u000b (", "@login_required",
    ]
    lines = [*odd, *RISKY, "plain", ""]
    texts = ["\n".join(p) for p in itertools.permutations(lines[:12], 2)] + ["\r\n".join(lines), "\n".join(lines), "\n" * 5 + "open(" + "x" * 16_000 + "\nopen(y)\n", "", "\n", None, "eval(" + "x" * 15_995, "eval(" + "x" * 15_996]
    rows = [*((f"f{k}", t) for k, t in enumerate(texts)), ("f1", "changed\nopen(x)"), ("f2", texts[2]), ("x.pem", "eval(x)"), (None, "eval(x)")]
    files = spark.createDataFrame(rows, "file string, text string").repartition(3)
    never = ("none", "none", "", "", "candidate", 1, "(?!)", [])
    by_lines, by_automaton = rules.scan(files, rules=[*rules.RULES, never]), rules.scan(files)
    got = sorted(map(tuple, by_automaton.collect()))
    assert got == sorted(map(tuple, by_lines.collect())) and len({r[4] for r in got}) == len(rules.RULES)
    assert [r[2] for r in got if r[1] == f"f{texts.index(chr(10) * 5 + 'open(' + 'x' * 16_000 + chr(10) + 'open(y)' + chr(10))}"] == [7]
    assert rules.scan(files, categories=["none"]).count() == 0 and rules.scan(files, categories=["injection"]).count() == sum(r[4] == "sql-concat" for r in got)
    small = spark.createDataFrame([("a.py", "eval(x)"), ("b.py", "plain")], "file string, text string")
    assert "Exchange" not in rules.scan(small)._jdf.queryExecution().executedPlan().toString()


def test_plan_joins_nothing(spark):
    from glyphion.operators import rules

    plan = rules.plan(rules.scan(spark.createDataFrame([("a.py", "eval(x)\neval(y)"), ("b.py", "plain")], "file string, text string")))
    assert [(r.category, r.evidence, r.files, r.score) for r in plan.collect()] == [("command_execution", 2, 1, 90)]
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
