"""Readers of source files, and the graph that is built from them."""

import pytest

from glyphion.operators import code_graph as G
from glyphion.parsing.script import Script
from glyphion.parsing.units import parse
from glyphion.sources import extract


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, text string")


def test_script_imports():
    text = """
import one from 'one';
import two, { a, b as c, type D } from "two"
import * as three from 'three';
import type { E } from './e';
import './side';
export { f as g } from '../f';
export * from './all';
const h = require('h'), i = await import('i');
// import fake from 'fake'
const s = "import x from 'x'", r = /require('y')/, t = `require('z')`;
"""
    got = [(spec, names, kind) for spec, names, kind, _, _ in Script(text).imports()]
    assert got == [
        ("one", ["default"], "static"), ("two", ["default", "a", "b", "D"], "static"), ("three", None, "static"), ("./e", ["E"], "type-only"), ("./side", None, "static"),
        ("../f", ["f"], "static"), ("./all", None, "static"), ("h", None, "require"), ("i", None, "dynamic"),
    ]


def test_script_exports_and_declarations():
    text = """export function one(a: number): string { return inner(a) }
export async function two() {}
export class Three extends Base<X> { private n = 1; static make(): Three { return new Three() } get size() { return 2 } run = async () => { go() }; }
export const FOUR = 4, five = (x) => x;
export type Six = { url: string };
export interface Seven { handle(): void; name?: string }
export enum Eight { A, B }
export default class Nine {}
const ten = 10;
export { ten as eleven, type Six };
function hidden() { function nested() {} }
namespace Space { export const inside = 1 }
"""
    s = Script(text)
    assert s.exports() == [
        ("one", "function", 1), ("two", "function", 2), ("Three", "class", 3), ("FOUR", "variable", 4), ("five", "variable", 4), ("Six", "type", 5), ("Seven", "interface", 6), ("Eight", "enum", 7),
        ("default", "default", 8), ("eleven", "variable", 10), ("Six", "type", 10),
    ]
    kinds = {(d.name, d.kind, d.start_line, s.declarations[d.parent].name if d.parent >= 0 else None, d.exported) for d in s.declarations}
    assert kinds >= {
        ("one", "function", 1, None, True), ("Three", "class", 3, None, True), ("n", "variable", 3, "Three", False), ("make", "method", 3, "Three", False), ("size", "method", 3, "Three", False),
        ("run", "method", 3, "Three", False), ("FOUR", "variable", 4, None, True), ("five", "function", 4, None, True), ("url", "variable", 5, "Six", False), ("handle", "method", 6, "Seven", False),
        ("name", "variable", 6, "Seven", False), ("Eight", "enum", 7, None, True), ("hidden", "function", 11, None, False), ("nested", "function", 11, "hidden", False), ("inside", "variable", 12, "Space", True),
    }
    assert [d.signature for d in s.declarations if d.name == "one"] == ["export function one(a: number): string"]


def test_imports_and_exports_by_line(spark):
    rows = [
        ("a.py", "python", "import os\nfrom a.b import c, d as e\nimport x, y\ndef go():\n  pass\nclass K:\n  def m(self): pass\ndef _no(): pass\n"), ("b.go", "go", 'import "fmt"\nimport (\n "os"\n)\nfunc Go() {}\nfunc no() {}\ntype T struct {}\n'),
        ("c.rs", "rust", "use std::io::Read;\nuse a::{B, C};\nmod d;\npub async fn e() {}\npub trait F {}\n"), ("D.java", "java", "import java.util.*;\n"), ("e.md", "markdown", "import os"), ("f.ts", "typescript", "import { q } from './q';\nexport const z = 1"), ("g.py", "python", None),
    ]
    table = spark.createDataFrame(rows, "file string, language string, text string")
    got = {(r.file, r.specifier, tuple(r.names) if r.names is not None else None) for r in extract.parse_imports(table).collect()}
    assert got == {
        ("a.py", "os", None), ("a.py", "a.b", ("c", "d")), ("b.go", "fmt", None), ("b.go", "os", None), ("c.rs", "std::io::Read", None), ("c.rs", "a", ("B", "C")), ("c.rs", "d", None),
        ("D.java", "java.util.*", None), ("f.ts", "./q", ("q",)),
    }
    assert {(r.file, r.name, r.kind, r.line) for r in extract.parse_exports(table).collect()} == {
        ("a.py", "go", "function", 4), ("a.py", "K", "class", 6), ("b.go", "Go", "function", 5), ("b.go", "T", "type", 7), ("c.rs", "e", "function", 4), ("c.rs", "F", "interface", 5), ("f.ts", "z", "variable", 2),
    }
    assert {(r.name, r.kind) for r in extract.extract_symbols(table).collect()} == {("go", "function"), ("K", "class"), ("_no", "function"), ("z", "variable")}


SINGLE = [
    ("s.py", "def goal():\n    return 1\ndef user():\n    return goal()\n", 4), ("s.php", "<?php\nfunction goal() { return 1; }\nfunction user() { return goal(); }\n", 3),
    ("s.go", "package s\nfunc goal() int { return 1 }\nfunc user() int { return goal() }\n", 3), ("S.java", "class S {\n static int goal() { return 1; }\n static int user() { return goal(); }\n}\n", 3),
    ("s.c", "int goal() { return 1; }\nint user() { return goal(); }\n", 2), ("s.cpp", "int goal() { return 1; }\nint user() { return goal(); }\n", 2),
    ("S.cs", "class S {\n static int goal() { return 1; }\n static int user() { return goal(); }\n}\n", 3), ("s.rs", "fn goal() -> i32 { 1 }\nfn user() -> i32 { goal() }\n", 2),
    ("s.rb", "def goal\n  1\nend\ndef user\n  goal()\nend\n", 5), ("s.kt", "fun goal(): Int = 1\nfun user(): Int = goal()\n", 2), ("s.swift", "func goal() -> Int { return 1 }\nfunc user() -> Int { return goal() }\n", 2),
    ("s.scala", "object S {\n def goal(): Int = 1\n def user(): Int = goal()\n}\n", 3), ("s.lua", "function goal() return 1 end\nfunction user() return goal() end\n", 2), ("s.ts", "export function goal() { return 1 }\nexport function user() { return goal() }\n", 2),
]
OWN = [
    ("o.py", "class S:\n def goal(self): return 1\n def user(self): return self.goal()\n", 3), ("o.php", "<?php\nclass S { function goal() { return 1; }\nfunction user() { return $this->goal(); } }", 3),
    ("O.java", "class S { int goal() { return 1; }\nint user() { return this.goal(); } }", 2), ("o.cpp", "class S { int goal() { return 1; }\nint user() { return this->goal(); } };", 2),
    ("o.rb", "class S\n def goal\n  1\n end\n def user\n  self.goal()\n end\nend", 6), ("o.go", "package o\ntype S struct {}\nfunc (s *S) goal() int { return 1 }\nfunc (s *S) user() int { return s.goal() }", 4),
    ("o.ts", "class S { goal() { return 1 }\nuser() { return this.goal() } }", 2),
]


@pytest.mark.parametrize("file, text, line", SINGLE + OWN, ids=[f for f, _, _ in SINGLE + OWN])
def test_calls_within_a_file(file, text, line):
    end = file.rsplit(".")[-1]
    from glyphion.functions.languages import GRAPH_LANGUAGES

    u = parse(text, GRAPH_LANGUAGES.get(end, "script"))
    names = [n.name for n in u.nodes]
    calls = [(names[c.owner], names[c.target], c.line) for c in u.uses if c.call and c.target >= 0]
    assert calls == [("user", "goal", line)] and not u.warnings


def edges_of(spark, *rows):
    nodes, edges, warnings = G.analyse(files(spark, *rows))
    name = {n.id: (n.file, n.name) for n in nodes.collect()}
    return [(e.kind, e.file, e.line, name[e.source_id][1], name.get(e.target_id), e.target_name, e.resolution) for e in edges.collect()], [w.file for w in warnings.collect()]


def test_edges_between_files(spark):
    got, warnings = edges_of(
        spark,
        ("util.py", "def goal():\n return 1\n"), ("other.py", "def goal():\n return 2\n"), ("main.py", "from util import goal as chosen\nimport util\ndef user():\n return chosen()\ndef more():\n util()\n return util.goal()\n"),
        ("p/util.go", "package p\nfunc Goal() int { return 1 }"), ("p/same.go", "package p\nfunc near() int { return Goal() }"), ("main.go", 'package main\nimport u "./p"\nfunc far() int { return u.Goal() }'),
        ("q/Tools.java", "package q; public class Tools { public static int goal() { return 1; } }"), ("App.java", "import q.Tools; class App { int user() { return Tools.goal(); } }"),
        ("Tools.php", "<?php namespace App; class Tools { static function goal() { return 1; } }"), ("Service.php", "<?php namespace App; use App\\Tools as T; function user() { return T::goal(); }"),
        ("api.h", "int goal(void);\n"), ("main.c", '#include "api.h"\nint user(void) { return goal(); }\n'),
        ("src/util.ts", "export function goal() { return 1 }"), ("src/main.ts", "import { goal as g } from './util';\nimport * as all from './util';\nfunction user() { g(); return all.goal() }"), ("broken.py", "def goal(:\n return 1\n"),
    )
    calls = {(file, line, target) for kind, file, line, _, target, _, _ in got if kind == "CALLS"}
    assert calls == {
        ("main.py", 4, ("util.py", "goal")), ("main.py", 6, None), ("main.py", 7, ("util.py", "goal")), ("p/same.go", 2, ("p/util.go", "Goal")), ("main.go", 3, ("p/util.go", "Goal")), ("App.java", 1, ("q/Tools.java", "goal")),
        ("Service.php", 1, ("Tools.php", "goal")), ("main.c", 2, ("api.h", "goal")), ("src/main.ts", 3, ("src/util.ts", "goal")),
    }
    brings = {(file, target[0] if target else None) for kind, file, _, _, target, _, _ in got if kind == "IMPORTS"}
    assert brings >= {("main.py", "util.py"), ("main.go", "p/util.go"), ("main.go", "p/same.go"), ("App.java", "q/Tools.java"), ("Service.php", "Tools.php"), ("main.c", "api.h"), ("src/main.ts", "src/util.ts")}
    assert all((k != "CALLS") or (r == "resolved") == (t is not None) for k, _, _, _, t, _, r in got) and warnings == ["broken.py"]


def test_what_stays_unresolved(spark):
    got, _ = edges_of(
        spark,
        ("a.py", "def goal(): return 1\nclass S:\n def goal(self): pass\ndef user(thing, outer):\n thing.goal()\n outside()\n outer()\ndef outer(): pass\n"),
        ("b.py", '# def fake():\ntext = "fake()"\ndef real():\n return 1\n'), ("c.cpp", "class S { public: int goal(); };\nint S::goal() { return 1; }\n"),
    )
    assert [(f, t, r) for k, f, _, _, t, _, r in got if k == "CALLS"] == [("a.py", None, "unresolved")] * 3
    assert not any(k == "REFERENCES" and line == 5 and t for k, _, line, _, t, _, _ in got)
    assert not any("fake" in (n, t and t[1]) for _, _, _, n, t, _, _ in got)
    assert ("DEFINES", "c.cpp", 2, "S", ("c.cpp", "goal"), "goal", "resolved") in got


def test_lookups_and_bounds(spark):
    source = files(spark, ("main.ts", "import { target } from './util';\nfunction entry() { return target() }\nfunction other() { return entry() }"), ("util.ts", "export function target() { return 1 }"))
    nodes, edges, _ = G.analyse(source)
    nodes, edges = nodes.persist(), edges.persist()
    assert [(r.file, r.line, r.source) for r in G.relations(nodes, edges, "target", "CALLS").collect()] == [("main.ts", 2, "entry")]
    with pytest.raises(LookupError):
        G.relations(nodes, edges, "absent", "CALLS")
    seeds = G.find_nodes(nodes, "entry").select("id")
    near, met, truncated = G.traverse(nodes, edges, seeds, 3, 2)
    assert len({n.id for n in near}) <= 2 and truncated
    near, met, truncated = G.traverse(nodes, edges, seeds, 1)
    assert not truncated and {n.name for n in near} >= {"entry", "target", "other"}
    text = G.context(nodes, edges, source, seeds)
    assert "CALLS target [resolved]" in text and "function entry()" in text and "omitted" in G.context(nodes, edges, source, seeds, budget=256, count=len)
    first, again = G.refresh(source, None)
    assert again and G.refresh(source, first) == (first, False) and G.refresh(source.limit(1), first)[1]
    left = G.analyse(source.where("file <> 'util.ts'"))[1].where("kind = 'CALLS' and line = 2").first()
    assert left.resolution == "unresolved" and left.target_id is None
    assert {r.id for r in G.graph_seeds(spark.createDataFrame([("main.ts", 2, 2)], "file string, start_line int, end_line int"), nodes).collect()} == {seeds.first().id}


def _shuffled(spark) -> int:
    """Records shuffled by all stages so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_package_of_many_files(spark):
    """Requests to a Go package are answered by its names; what is shuffled doesn't grow with requests times files."""
    n = 400
    rows = [(f"p/f{k}.go", f"package p\nfunc Own{k}() int {{ return Own{(k + 1) % n}() + twice() + absent() }}\n" + ("func twice() int { return 1 }\n" if k < 2 else "")) for k in range(n)]
    rows += [("p/other.go", "package q\nfunc Own0() int { return 2 }\nfunc lone() int { return Own0() + Own1() }"), ("main.go", 'package main\nimport u "./p"\nfunc far() int { return u.Own5() + u.Own0() }')]
    before = _shuffled(spark)
    got, _ = edges_of(spark, *rows)
    shuffled = _shuffled(spark) - before
    calls = {(file, said): target for kind, file, _, _, target, said, _ in got if kind == "CALLS"}
    own = {(f"p/f{k}.go", f"Own{(k + 1) % n}"): (f"p/f{(k + 1) % n}.go", f"Own{(k + 1) % n}") for k in range(n)}
    assert {k: t for k, t in calls.items() if k in own} == own
    assert {t for (file, said), t in calls.items() if said == "absent" or (said == "twice" and file not in ("p/f0.go", "p/f1.go"))} == {None}
    assert calls["p/other.go", "Own0"] == ("p/other.go", "Own0") and calls["p/other.go", "Own1"] is None
    assert calls["main.go", "Own5"] == ("p/f5.go", "Own5") and calls["main.go", "Own0"] is None  # two files of the folder have it
    assert shuffled < 60 * n


def test_repeated_files_give_edges_once(spark):
    rows = [("a.py", "import os\ndef goal(): return 1\ndef user(): return goal()\n"), ("b.py", "from a import goal\ndef more(): return goal()\n")]
    once, twice = (sorted((e.id, e.kind) for e in G.analyse(files(spark, *r))[1].collect()) for r in (rows, [*rows, rows[1]]))
    assert once == twice and len({i for i, _ in once}) == len(once)


def test_many_functions_in_one_file():
    text = "".join(f'def helper_{i}():\n    """Texte accentué."""\n    return {i}\n' for i in range(700)) + "def user():\n return helper_5()\n"
    u = parse(text, "python")
    assert not u.warnings and [u.nodes[c.target].name for c in u.uses if c.call] == ["helper_5"]
