"""Search over a small index: modes, fallbacks, order of what follows, caching; conversations and overviews."""

import pytest
from pyspark.sql import functions as F

from glyphion.functions.stem import fold, stems
from glyphion.operators import chat, overview, retrieval, tables
from glyphion.operators import search as S
from glyphion.streaming.watch import apply_changes

CHUNKS = [
    ("c1", "src/auth.ts", 0, 1, 30, "function authenticateUser(name) { return login(name) }", "typescript"), ("c2", "src/api/payment.ts", 0, 1, 20, "async function processPayment(order) { charging orders }", "typescript"),
    ("c3", "src/utils.py", 0, 1, 15, "def authenticate_request(req): charge", "python"), ("c4", "src/utils.py", 1, 12, 30, "authenticate again and again, user", "python"), ("c5", "web/dist/auth.js", 0, 1, 9, "authenticateUser authenticateUser", "javascript"),
]


@pytest.fixture(scope="module")
def index(spark):
    chunks = spark.createDataFrame(CHUNKS, "id string, file string, chunk_index int, start_line int, end_line int, content string, language string")
    axis = {"c1": [1.0, 0.0], "c2": [0.0, 1.0], "c3": [0.9, 0.1], "c4": [0.5, 0.5], "c5": [0.2, 0.9]}
    vectors = spark.createDataFrame(list(axis.items()), "id string, vector array<double>")
    symbols = spark.createDataFrame([("s1", "authenticateUser", "function", "src/auth.ts", 2, True), ("s2", "authenticate_request", "function", "src/utils.py", 13, True), ("s3", "Pay", "class", "src/api/payment.ts", 3, False)], "id string, name string, kind string, file string, line long, exported boolean")
    return S.Index(chunks, vectors, symbols, lambda q: [1.0, 0.0])


def ids(found):
    return [r.id for r in found.hits.orderBy("rank").collect()]


def test_stems_and_accents(spark):
    said = "caresses ponies cats feed agreed plastered motoring sing conflated hopping falling hissing failing filing happy sky relational conditional digitizer operator feudalism hopefulness formality triplicate electrical goodness revival adjustable replacement adoption communism effective rate controlling roll yes of nation running connections"
    want = "caress poni cat feed agre plaster motor sing conflat hop fall hiss fail file happi sky relat condit digit oper feudal hope formal triplic electr good reviv adjust replac adopt commun effect rate control roll ye of nation run connect"
    rows = spark.createDataFrame([(said.split(),), ([None, "a"],), (None,)], "w array<string>")
    assert [r[0] for r in rows.select(stems(F.col("w"))).collect()] == [want.split(), [None, "a"], None]
    assert spark.range(1).select(fold(F.lit("éÀñüßőạ x"))).first()[0] == "eAnußoa x"


def test_keyword_and_filters(index):
    assert ids(S.search(index, "charge", "keyword", fall_back=False)) == ["c3", "c2"]
    assert set(ids(S.search(index, "authenticate", "keyword", language="python"))) == {"c3"}
    assert S.search(index, "authenticate", "keyword", language="go", fall_back=False).hits.count() == 0
    assert ids(S.search(index, "payment", "keyword", file_pattern="src/api/*")) == ["c2"]


def test_relaxation_and_fallback(index):
    found = S.search(index, "charge zzqqx", "keyword")
    assert set(ids(found)) == {"c2", "c3"} and found.warnings == ["relaxed to any word"]
    found = S.search(index, "zzqqx", "keyword")
    assert found.mode == "semantic" and ids(found)[0] == "c1" and found.warnings
    assert S.search(index, "zzqqx", "keyword", fall_back=False).hits.count() == 0


def test_semantic_and_hybrid(index):
    assert ids(S.search(index, "anything", "semantic"))[:2] == ["c1", "c3"]
    found = S.search(index, "charge", "hybrid", explain=True)
    best = found.hits.orderBy("rank").collect()
    assert best[0].id == "c3" and best[0].keyword_rank == 1 and best[0].semantic_rank == 2 and best[0].rrf == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)
    assert {r.id: r.path_multiplier for r in best}["c5"] == 0.42
    bare = S.Index(index.chunks)
    assert S.search(bare, "charge", "hybrid").mode == "keyword"
    failing = S.Index(index.chunks, index.vectors, None, lambda q: 1 / 0)
    assert S.search(failing, "charge", "hybrid").warnings == ["semantic search failed: ZeroDivisionError"]
    with pytest.raises(ZeroDivisionError):
        S.search(failing, "charge", "semantic")


def test_regex_and_symbols(index):
    found = S.search(index, "/AUTHENTICATE/gi", dedupe_by_file=False)
    rows = found.hits.orderBy("rank").collect()
    assert found.mode == "regex" and [r.id for r in rows] == ["c1", "c3", "c4", "c5"] and rows[0].content.startswith("function **authenticate**User")
    found = S.search(index, "authenticate", "symbol")
    assert [(r.file, r.symbol, r.score) for r in found.hits.orderBy("rank").collect()] == [("src/auth.ts", "authenticateUser", 1.0), ("src/utils.py", "authenticate_request", 0.5)]
    assert set(ids(S.search(index, "anything", "semantic", symbol_kind="class"))) == {"c2"} and len(ids(S.search(index, "anything", "semantic", symbol_kind="unknown"))) == 4


def test_rerank_fuzzy_expand(index):
    prefers = lambda q, docs: [float("payment.ts" in d) for d in docs]
    ranked = S.Index(index.chunks, index.vectors, index.symbols, index.embed, prefers)
    assert ids(S.search(ranked, "anything", "semantic", limit=1)) == ["c2"]
    for broken in (lambda q, d: [1.0], lambda q, d: [float("nan")] * len(d), lambda q, d: 1 / 0):
        assert ids(S.search(S.Index(index.chunks, index.vectors, None, index.embed, broken), "anything", "semantic", limit=1)) == ["c1"]
    assert S.search(index, "authenticate", "keyword", fuzzy=True).hits.count() > 0
    row = S.search(index, "again", "keyword", expand=1).hits.first()
    assert (row.start_line, row.end_line) == (1, 30) and row.content.startswith("def ")
    assert S.overlap_scorer("a b", ["a c", "x"]) == [0.5, 0.0]


def test_cache_and_limits(index):
    now = [0.0]
    cache = S.Cache(2, 10, lambda: now[0])
    first = S.search(index, "anything", "semantic", cache=cache, project="p")
    again = S.search(index, "anything", "semantic", cache=cache, project="p")
    assert not first.cached and again.cached and ids(first) == ids(again)
    now[0] = 11
    assert not S.search(index, "anything", "semantic", cache=cache, project="p").cached
    cache.put("q|x", 1), cache.put("q|y", 2)
    assert cache.get("q|x") == 1 and len(cache) == 2
    cache.drop("q")
    assert len(cache) == 0
    assert S.cache_key("p", "q", "m", 5, b=1, a=None, c="x") == "p|q|m|5|b=1|c=x"
    assert (S.keyword_fetch(10, True), S.keyword_fetch(10, False), S.relaxed_fetch(250), S.semantic_fetch(10, True, 10), S.rerank_pool(10)) == (250, 20, 400, 200, 50)


def test_vector_search_in_passes(spark):
    rows = spark.createDataFrame([(i, [float((i * 7 + k) % 11 - 5) for k in range(4)]) for i in range(60)] + [(70, None), (71, [0.0] * 4), (72, [1.0, None, 0.0, 0.0]), (73, [1.0])], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    one, many = (sorted(map(tuple, retrieval.vector_search(rows, asked, 3, queries_a_pass=n).collect())) for n in (100, 2))
    assert one == many and len(one) == 27


def test_conversations(spark):
    rows = [(i, "t1" if i < 6 else "t2", "p", "user" if i % 2 else "assistant", f"text {i}", f"2024-01-{i + 1:02d} 00:00:00") for i in range(9)]
    entries = chat.ingest(spark.createDataFrame(rows, "turn int, thread string, x string, role string, content string, at string").withColumn("created_at", F.to_timestamp("at")), "p")
    now = F.to_timestamp(F.lit("2024-01-09 00:30:00"))
    got = chat.load(entries, now, limit=3).orderBy("at").collect()
    assert [r.content for r in got] == ["text 6", "text 7", "text 8"]
    assert chat.load(entries, now, hours=24.6).count() == 2 and chat.load(entries, now, hours=None, thread="t1").count() == 6
    assert chat.latest_thread(entries, now).first().thread == "t2" and chat.latest_thread(entries, now, 60).count() == 0
    kept, gone = chat.cleared(entries, "p", now, hours=72)
    assert kept.count() + gone.count() == 9 and gone.agg(F.max("turn")).first()[0] == 5
    vectors = entries.select("id", F.when(F.col("turn") == 7, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vector"))
    assert chat.recall(entries, vectors, [1.0, 0.0], now, 1).first().content == "text 7"
    titles = chat.with_titles(spark.createDataFrame([("t1", "old"), ("t2", "kept")], "thread string, title string"), spark.createDataFrame([("t1", "new"), ("t2", None)], "thread string, title string"))
    assert {r.thread: r.title for r in titles.collect()} == {"t1": "new", "t2": "kept"}
    assert chat.preview(entries, 1, 2).count() == 2 and "no results" in chat.track("search", "q", spark.createDataFrame([], "file string, start_line int, score double"))


def test_project_texts(spark):
    manifest = '{"name":"x","type":"module","dependencies":{"react":"^18","next":"14"},"devDependencies":{"vitest":"1"}}'
    files = spark.createDataFrame([("p", "package.json", manifest), ("p", "src/index.ts", "x"), ("p", "yarn.lock", ""), ("p", "README.md", "About x"), ("p", "go.mod", ""), ("p", "turbo.json", "{}")], "project string, file string, text string")
    got = [r.framework for r in overview.frameworks(files).orderBy("at").collect()]
    assert got == ["React (^18)", "Next.js (14)", "Vitest (testing)", "ESM modules", "Package manager: Yarn (lockfile)", "Turborepo (turbo.json)", "Go module"]
    chunks = spark.createDataFrame([("p", "src/index.ts", "src/index.ts", "typescript", 0, 30, "import x")], "project string, file_path string, file string, language string, chunk_index int, end_line int, content string")
    exports = spark.createDataFrame([("src/index.ts", "go", "function", 3)], "file string, name string, kind string, line int")
    held: dict = {}
    key = overview.briefing_key(6, 1, "t", None)
    text, cached = overview.briefing("p", key, held, chunks, files, exports)
    assert not cached and "About x" in text and "- src/index.ts: go" in text and overview.briefing("p", key, held, chunks, files, exports) == (text, True)
    edges = spark.createDataFrame([("a.ts", "src/index.ts"), ("src/__tests__/i.ts", "src/index.ts")], "source string, target string")
    said = overview.smart_context("src/index.ts", chunks, edges, exports, files, "fix it", "debug")
    assert "### Impact" in said and "- src/__tests__/i.ts" in said and "go (function, line 3)" in said
    located = overview.excerpt(spark.createDataFrame([("f", "a\nb\nc\nd")], "file string, text string"), spark.createDataFrame([("f", 2), ("g", 1)], "file string, line int"))
    assert {r.file: r.excerpt for r in located.collect()} == {"f": "a\nb\nc\nd", "g": None}


def test_table_maintenance(spark):
    rows = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("q", "a", 3)], "project string, file string, v int")
    changed = spark.createDataFrame([("p", "a", "changed"), ("p", "b", "deleted")], "project string, file string, kind string")
    out = apply_changes({"rows": rows}, changed, lambda files: {"rows": files.withColumn("v", F.lit(9))})
    assert sorted(map(tuple, out["rows"].collect())) == [("p", "a", 9), ("q", "a", 3)]
    old = spark.createDataFrame([("x", [1.0, 2.0])], "id string, vector array<double>")
    assert tables.upsert_vectors(old, spark.createDataFrame([("x", [3.0, 4.0])], old.schema), 2).first().vector == [3.0, 4.0]
    with pytest.raises(Exception, match="finite parts"):
        tables.upsert_vectors(old, spark.createDataFrame([("y", [3.0])], old.schema), 2).collect()
    many = spark.createDataFrame([("q", i, 10 + i % 3) for i in range(500)], "query_id string, doc_id long, tokens long")
    assert tables.token_budget(many, 1000, "doc_id", buckets=7).agg(F.max("used"), F.count("*")).first() == tables.token_budget(many, 1000, "doc_id", buckets=1).agg(F.max("used"), F.count("*")).first()
