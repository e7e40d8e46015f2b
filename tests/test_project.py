"""An index from its files to its evaluation."""

import pytest
from pyspark.sql import functions as F

from glyphion.plans import project as P
from glyphion.sources import embeddings as E

FILES = [
    ("src/index.ts", "import { login } from './auth';\nexport function start() { return login('me') }\n"), ("src/auth.ts", "export function login(name: string) { return name }\n"),
    ("src/auth.test.ts", "import { login } from './auth';\ntest('login', () => login('x'))\n"), ("tool.py", "import os\ndef run():\n    return os.getcwd()\n"), ("README.md", "All about logging in\n"),
]


@pytest.fixture(scope="module")
def store(spark):
    profile = P.Profile(dimensions=32)
    store = P.Store(spark)
    store.write(P.build(spark.createDataFrame(FILES, "file string, text string"), "p", profile), profile.key())
    return store, profile


def test_build(store):
    held = store[0].read()
    assert {r.file: r.target for r in held["dependencies"].where("resolved").collect()} == {"src/index.ts": "src/auth.ts", "src/auth.test.ts": "src/auth.ts"}
    assert {(r.file, r.name) for r in held["exports"].collect()} == {("src/index.ts", "start"), ("src/auth.ts", "login"), ("tool.py", "run")}
    assert [(r.project, r.chunks, r.vectors, r.relation) for r in P.diagnostics(held)] == [("p", 5, 5, "match")]


def test_update_reads_only_what_changed(spark, store):
    held, seen = store[0].read(), []
    now = [("src/auth.ts", "export function signIn() {}\n"), *[f for f in FILES if f[0] not in ("src/auth.ts", "tool.py")], ("new.py", "def fresh(): pass\n")]
    files = spark.createDataFrame(now, "file string, text string")
    profile = P.Profile(dimensions=32)
    after, status = P.update(held, files, "p", profile, store[0].version()["profile"])
    assert {r.file: r.status for r in status.collect()} == {"src/auth.ts": "changed", "tool.py": "deleted", "new.py": "new", "src/index.ts": "unchanged", "src/auth.test.ts": "unchanged", "README.md": "unchanged"}
    assert {r.name for r in after["exports"].collect()} == {"signIn", "start", "fresh"} and after["vectors"].count() == 5 and not seen
    _, status = P.update(held, files, "p", P.Profile(dimensions=16), store[0].version()["profile"])
    assert status.where("status = 'unchanged'").count() == 0


def test_versions(spark, store):
    s = P.Store(spark)
    assert s.version() is None and s.read() == {}
    first = s.write({"t": spark.range(3)}, "a")
    s.start()
    assert s.version()["profile"] == "pending:a" and s.read()["t"].count() == 3
    assert s.write({"t": spark.range(5)}, "b") != first and s.read()["t"].count() == 5 and s.version()["profile"] == "b"


def test_evaluation_and_session(store):
    held = {n: t.persist() for n, t in store[0].read().items()}
    index = P.index_of(held, store[1])
    report = P.evaluate(index, [("login", ["src/auth.ts"], "keyword"), ("start", ["src/index.ts"], "symbol"), ("(", ["tool.py"], "regex")], 3)
    assert [r["recall"] for r in report["cases"][:2]] == [1.0, 1.0] and report["cases"][2]["error"] and report["recall"] == 1.0 and report["p95"] > 0
    with pytest.raises(ValueError):
        P.evaluate(index, [])
    told = P.session(held, "fix the login crash", ["src/auth.ts"], store[1])
    assert told["type"] == "debug" and "login" in told["keywords"] and told["tests"] == ["src/auth.test.ts"] and set(told["affected"]) == {"src/index.ts", "src/auth.test.ts"}
    assert P.symbol_graph(held)["graph_edges"].where("kind = 'CALLS' and resolution = 'resolved'").count() >= 2
    assert P.benchmark(index, ["login"], 1).first().n == 1


def test_embedder(spark):
    waits, calls = [], []

    def busy(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise E.Busy("429", 1.5 if len(calls) == 1 else None)
        return [[1.0, 2.0]] * len(texts)

    assert E.ask(busy, ["a"], 2, 2, waits.append) == [[1.0, 2.0]] and waits == [1.5, 0.5]
    with pytest.raises(E.Busy):
        E.ask(lambda t: (_ for _ in ()).throw(E.Busy("x", 60)), ["a"], 2)
    for wrong in ([[1.0]], [], [[1.0, float("nan")]]):
        with pytest.raises(ValueError):
            E.checked(wrong, 1, 2)
    assert E.in_order([(1, [2.0]), (0, [1.0])], 2) == [[1.0], [2.0]]
    with pytest.raises(ValueError):
        E.in_order([(0, [1.0]), (0, [1.0])], 2)
    rows = spark.createDataFrame([("a", "some text"), ("b", None), ("c", "some text")], "id string, text string")
    got = {r.id: r.vector for r in E.embedded(rows, E.hashed_ngrams(8), 8, batch=2).collect()}
    assert got["a"] == got["c"] and all(len(v) == 8 for v in got.values()) and abs(sum(x * x for x in got["a"]) - 1) < 1e-5
    assert rows.select(F.count("*")).first()[0] == 3
