"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import re
from collections import Counter, defaultdict

import numpy as np
import zstandard
import pytest
from pyspark.sql import functions as F

from glyphion.llm import decontaminate as D
from glyphion.llm import ecoc_language as E
from glyphion.llm import jaccard_join as J
from glyphion.llm import kd_sharding as K
from glyphion.llm import line_dedup as L
from glyphion.llm import maxscore as M
from glyphion.llm import pii_disclosure as P
from glyphion.llm import sentencepiece_viterbi as V
from glyphion.llm import substring_dedup as R
from glyphion.llm import token_counts as N

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _keys string, shard string"
PASSAGE = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"x{i % 977}" for i in range(40_000))
TEXTS = [
    (1, f"Alpha line is long enough\n{PASSAGE}\nend"), (2, f"  alpha LINE is long enough\t\nother {PASSAGE} tail"), (3, None), (4, ""), (5, LONG), (6, LONG + " more"),
    (7, "mail me@ex.org or +49 (30) 1234567 at 10.0.0.1 and 999.1.1.1, card 4111 1111 1111 1111"), (8, "été ñandú 你好 ▁blank   x\r\ny\0z"), (9, "a a a a a a a a a a a a a a a a a a a a a a a a a"),
    (10, f"Alpha line is long enough\n{PASSAGE}\nend"), (None, "no id here but a long enough line"), (12, "no id here but a long enough line"), (12, "no id here but a long enough line"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", None, "k", "c") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_line_dedup(docs, empty, limit):
    holders = defaultdict(set)
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate(str.maketrans(L.UPPER, L.LOWER))
    who = lambda i: L.NO_ID if i is None else i
    for i, t in TEXTS:
        for x in (t or "").split("\n"):
            holders[key(x)].add(who(i))
    want = Counter()
    for i, t in TEXTS:
        kept = [x for x in (t or "").split("\n") if len(key(x)) < 10 or min(holders[key(x)]) == who(i)]
        want[i, "\n".join(kept), (t or "").count("\n") + 1] += 1
    out = L.dedup_lines(docs, broadcast_bytes=limit)
    assert Counter((r.doc_id, r.text or "", r._n_lines) for r in out.collect()) == want
    assert out.columns[: len(docs.columns)] == docs.columns and L.dedup_lines(empty).count() == 0


def test_perfect_hash_finds_all_and_only_its_keys():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(0, 2**63, 5000, dtype=np.uint64)
    s = L.Shard(L.build_shard(a, b, np.arange(5000), np.ones(5000)))
    assert (s.keeper[s.find(a, b)] == np.arange(5000)).all()
    assert (s.find(a + np.uint64(1), b) == -1).all()


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_decontamination(spark, docs, empty, block):
    bench = spark.createDataFrame([(1, PASSAGE[:80]), (2, "W20 w21-w22 w23"), (3, None), (4, "nowhere to be seen"), (5, "été")], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate(str.maketrans(L.UPPER, L.LOWER)))
    want = []
    for i, t in TEXTS:
        w, hit, items = low(t), set(), set()
        for r in bench.collect():
            b = low(r.text)
            n = min(10, len(b))
            for k in range(len(b) - n + 1 if b else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[k : k + n]:
                        hit |= set(range(p, p + n))
                        items.add(str(r.item_id))
        want.append((i, len(w), len(hit), sorted(items)))
    got = D.find_benchmark(docs, bench, block_bytes=block).collect()
    assert sorted((str(r.doc_id), r._n_words, r._n_hit, r._items) for r in got) == sorted((str(i), a, b, c) for i, a, b, c in want)
    assert D.find_benchmark(empty, bench).count() == 0 and D.decontaminate(docs, bench.limit(0)).count() == len(TEXTS)


def test_pii(docs, empty):
    text = dict(TEXTS)[7]
    rows = P.find_pii(docs).collect()
    got = {r.doc_id: [(s.kind, text[s.a : s.b]) for s in r.spans] for r in rows if r.doc_id == 7}
    assert got[7] == [("email", "me@ex.org"), ("phone", "+49 (30) 1234567"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111")]
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in TEXTS) and all(not r.spans for r in rows if r.doc_id != 7)
    assert P.redact("ab cd", [("x", 0, 2)]) == "[X] cd" and P.redact(None, []) is None and P.find_pii(empty).count() == 0


PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    """The contract's patterns as they stand."""
    fit = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "phone": lambda m: 9 <= sum(c.isdigit() for c in m) <= 15,
        "card": lambda m: 12 <= len(d := [int(c) for c in m if c in "0123456789"]) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0,
    }
    return sorted(((k, m.start(), m.end()) for k, p in PLAIN.items() for m in p.finditer(text or "") if fit[k](m[0])), key=lambda s: (s[1], list(PLAIN).index(s[0])))


def test_pii_query_against_brute_force(spark):
    """All columns on supplied texts: the patterns as they stand, terms counted with sets."""
    import hashlib

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    base = {i: plain_spans(t) for i, t in texts.items()}

    def outside(i):
        t, out, at = texts[i], [], 0
        for _, a, b in (*base[i], ("", len(texts[i]), 0)):
            out += [(m[0].lower(), m.start(), m.end()) for m in re.compile(r"[^\W\d_]+").finditer(t, at, a)] if a > at else []
            at = max(at, b)
        return out

    words = {i: outside(i) for i in texts}
    n, m, marks = Counter(), Counter(), defaultdict(set)
    for i, found in words.items():
        for w in {w for w, _, _ in found}:
            n[w] += 1
            if base[i]:
                m[w] += 1
                marks[w].add(P.entity_mark(texts[i], base[i]))
    said = [i for i in texts if texts[i]]
    rate = sum(bool(base[i]) for i in said) / len(said)
    terms = {w for w in m if len(marks[w]) >= 8 and m[w] / n[w] >= 0.5 and np.log2(m[w] / n[w] / rate) >= 3}
    assert "token" in terms
    order = [*PLAIN, "term"]
    for r in P.op4_pii_disclosure(spark, sf).collect():
        mine = sorted(base[r.doc_id] + [("term", a, b) for w, a, b in words[r.doc_id] if w in terms], key=lambda s: (s[1], order.index(s[0]), s[2]))
        join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.spans == join(mine) and r.base_sha256 == hashlib.sha256(join(base[r.doc_id]).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base[r.doc_id]) for k in PLAIN]


def test_email_spans_as_the_pattern():
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for t in ("a@b.c@d.e", "@x.y", "a@b", "x a.b+c@d-e.f.g.", "a@@b.c", "a@b.c.d@e.f", "a@.b c@d..e"):
        assert P.emails(t) == [m.span() for m in plain.finditer(t)]


def test_disclosing_terms(spark):
    rows = [(i, f"contact zorbinax at user{i}@ex.org now") for i in range(12)] + [(i, "contact at now plain words here " * 20) for i in range(12, 200)]
    rows += [(300 + i, "copied rarely one@ex.org") for i in range(20)]  # copies are no evidence
    out = P.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), bits=2.0).collect()
    assert all(("term", 8, 16) in [(s.kind, s.a, s.b) for s in r.spans] for r in out if r.doc_id < 12)
    assert not any(s.kind == "term" for r in out if r.doc_id >= 12 for s in r.spans)


@pytest.mark.parametrize("block", [4 << 20, 1])
def test_terms_away_from_entities(spark, docs, empty, block):
    rows = [(i, f"contact zorbinax Quelvane at user{i}@ex.org now") for i in range(12)] + [(i, "contact at now plain words here " * 20) for i in range(12, 200)]
    rows += [(250, "Ask Zorbinax, or QUELVANE zorbinaxes."), (251, "zorbinax@ex.org zorbinax" + " far" * 9 + " zorbinax"), (252, None), (252, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = P.find_pii(table, block_bytes=block).collect()
    got = {r.doc_id: [(s.kind, s.a, s.b) for s in r.spans] for r in out}
    assert len(out) == len(rows) and got[250] == [("term", 4, 12), ("term", 17, 25)] and got[252] == [] == got[12]
    assert got[251] == [("email", 0, 15), ("term", 16, 24), ("term", 61, 69)]
    said = {r.doc_id: r.text for r in P.sanitised(table, block_bytes=block).collect() if r.doc_id in (3, 12, 250, 251)}
    assert said == {3: "contact [TERM] [TERM] at [EMAIL] now", 12: dict(rows)[12], 250: "Ask [TERM], or [TERM] zorbinaxes.", 251: "[EMAIL] [TERM]" + " far" * 9 + " [TERM]"}
    if block > 1:
        clean = P.sanitised(docs)
        assert clean.columns == docs.columns and clean.count() == len(TEXTS) and P.sanitised(empty).count() == 0


def test_near_duplicates(spark, docs, empty):
    base = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i, k in enumerate(range(5, 250, 20))] + [(90, "other words entirely " + PASSAGE), (91, None), (92, None), (93, "a b"), (94, "A  b\n")]
    out = {r.doc_id: r for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {out[i].class_id for i in range(13)} == {0} and out[90].class_id == 90 and out[91].class_id == 91 and out[94].class_id == 93 and out[94].n_copies == 1
    kept = sorted(r.doc_id for r in J.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [0, 90, 91, 92, 93]
    assert J.near_duplicates(docs).count() == len(TEXTS) and J.drop_near_duplicates(docs).columns == docs.columns and J.near_duplicates(empty).count() == 0


def links_of(rows):
    """Of each text: the different texts that it is linked to, and the least id of its class, by brute force."""
    sets = {i: frozenset(J.shingle_sets([t])[0].tolist()) for i, t in rows}
    links, root = defaultdict(set), {i: i for i in sets}
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a != b and n and sets[a] != sets[b] and 5 * n >= 4 * len(sets[a] | sets[b]):
                links[a].add(sets[b])
    while True:
        new = {a: min([root[a], *(root[b] for b in sets if sets[a] and (sets[b] in links[a] or sets[b] == sets[a]))]) for a in sets}
        if new == root:
            return sets, links, root
        root = new


@pytest.mark.parametrize("block, small", [(2048, 8), (16, 2)])
def test_classes_of_a_crowd(spark, monkeypatch, block, small):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "SMALL", small)
    rng = np.random.default_rng(11)
    rows = []
    for g in range(3):  # a group whose members lie at, above and below the threshold from each other
        base = [f"g{g}w{i}" for i in range(150)]
        for m in range(60):
            words = list(base)
            for at in rng.integers(0, 150, rng.integers(0, 7)):
                words[at] = f"e{rng.integers(0, 10**9)}"
            rows.append((g * 100 + m, " ".join(words)))
    sets, links, root = links_of(rows)
    out = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in out} == root
    assert all(bool(links[r.doc_id]) == bool(r.n_links) and r.n_links <= len(links[r.doc_id]) for r in out)
    assert {r.doc_id: r.n_texts for r in out} == {i: len({sets[j] for j in sets if root[j] == root[i]}) for i in sets}


@pytest.mark.parametrize("seed", range(3))
def test_copy_among_texts_that_quote_it(spark, seed):
    """A pair that meets in buckets of two, while its texts share other buckets with several texts that hold a long run of them."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(260)]
    rows = [(k, " ".join([f"q{k}x{i}" for i in range(45)] + base[30 * k : 30 * k + 170 - 20 * (k % 2)] + [f"r{k}x{i}" for i in range(45)])) for k in range(5)]
    rows += [(10, " ".join(base)), (11, " ".join(base[: (at := int(rng.integers(20, 240)))] + ["new"] + base[at + 1 :]))]
    _, links, root = links_of(rows)
    assert links[10] and root[11] == 10
    assert {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {i: (root[i], len(links[i])) for i in root}


def test_pairs_across_classes(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"n{k}"] + base[k + 1 :]) for k in range(20, 80, 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sigs = spark.createDataFrame([(i, J.signature(s).tobytes(), len(t)) for i, (s, t) in enumerate(zip(J.shingle_sets(texts), texts))], "node long, sig binary, size long")
    nodes = docs.select(docs.doc_id.alias("node"), *J.text_key("text")).join(sigs, "node")
    crowded = spark.createDataFrame([(7, i, 12, 0) for i in range(12)], "bucket long, node long, n long, pivot long")
    roots = spark.createDataFrame([(i, 0) for i in range(6)], "node long, root long")
    for n in (12, 7):
        held = crowded if n == 12 else spark.createDataFrame([(b, i, 7, 3) for b in (7, 8) for i in range(3, 10)], crowded.schema)
        scratch = J.Scratch()
        links = J.across_classes(docs, held, nodes, roots, None, 1e-6, scratch)
        got = {(r.node, r.root) for r in J.components(links.union(spark.createDataFrame([(0, i) for i in range(1, 6)], "a long, b long")), scratch).collect()}
        assert got == {(i, 0) for i in range(12 if n == 12 else 10)}


@pytest.mark.parametrize("block", [2048, 16])
def test_all_links_of_a_crowd(spark, monkeypatch, block):
    """Near copies, some of them copied: every pair at the threshold counts, not only those with the pivots."""
    monkeypatch.setattr(J, "BLOCK", block)
    rng = np.random.default_rng(23)
    rows = [(900, "alone " + PASSAGE), (901, None), (902, "a b"), (903, "a  B"), (904, " ".join(f"p{i}" for i in range(90))), (905, " ".join(f"p{i}" for i in range(91)))]
    for g, n in enumerate((3, 5, 70)):
        base = [f"g{g}w{i}" for i in range(150)]
        for m in range(n):
            words = list(base)
            for at in rng.integers(0, 150, rng.integers(0, 6)):
                words[at] = f"e{rng.integers(0, 10**9)}"
            rows += [(g * 200 + m, " ".join(words))] + [(g * 200 + 100 + m, " ".join(words).upper())] * (m % 7 == 0)
    _, links, root = links_of(rows)
    assert max(map(len, links.values())) > 2 * J.PIVOTS
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (root[i], len(links[i])) for i in root}


def test_rows_that_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (1, "quite another text of some words", "b"), (2, text + " more", "c"), (3, "x", "d"), (3, "x", "e"), (None, text, "f"), (None, "only here and not elsewhere", "g"), (None, None, "h"), (4, None, "i")]
    table = spark.createDataFrame(rows, "doc_id long, text string, class string")
    kept = [r["class"] for r in J.drop_near_duplicates(table).collect()]
    assert sorted(x for x in kept if x not in "de") == ["a", "b", "g", "h", "i"] and sum(x in "de" for x in kept) == 1


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 16).astype(np.float32)]) for i in range(300)]
    rows += [(300, None), (301, [None] * 16), (302, [float("nan")] * 16), (None, rows[0][1]), (303, rows[7][1]), (304, rows[7][1]), (350, [1.0, 2.0])]
    v = {i: np.floor(np.array(x, dtype=np.float32).astype(float) * 256).astype(int) for i, x in rows if i is not None and x and None not in x and x[0] == x[0]}
    want = []
    for q in (i for i in v if i % 50 == 0):
        best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q and len(v[i]) == len(v[q]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    t = M.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    for block, a_pass in ((4096, 50_000), (32, 2)):
        got = M.top_k(t, t.where("vec_id % 50 = 0"), block=block, queries_a_pass=a_pass).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    none = t.where("vec_id < 0")
    assert M.top_k(none, none).count() == 0 and M.top_k(t, none).count() == 0
    blank = spark.createDataFrame([(1, []), (2, []), (3, [])], "vec_id long, v array<long>")
    assert sorted(map(tuple, M.top_k(blank, blank.where("vec_id = 2")).collect())) == [(2, 1, 1, 0), (2, 2, 3, 0)]


def test_pieces(spark, docs, empty):
    v = V.vocabulary()
    out = V.decode(V.encode(docs, v), v)
    assert all(r.text == r._text for r in out.collect()) and V.encode(empty, v).count() == 0
    score = {p: s for p, _, s in v.words}
    for text in ("hello worlds", "ñandú", " a  b", "zzqqxx"):
        ids = v.viterbi(text)
        seen, best = text.replace(" ", V.BLANK), [0.0]
        for end in range(1, len(seen) + 1):
            best.append(max([best[end - 1] + V.UNCOVERED] + [best[a] + score[seen[a:end]] for a in range(end) if seen[a:end] in score]))
        got = sum(score.get(v.pieces[i], 0) for i in ids)
        assert got == pytest.approx(best[-1]) or best[-1] < V.UNCOVERED / 2


@pytest.mark.parametrize("crowd", [R.CROWD, 1])
def test_substring_dedup(docs, empty, crowd):
    words = {k: (t or "").split() for k, (_, t) in enumerate(TEXTS)}
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", TEXTS[k][1] or "") for k in words}
    place = lambda k: L.NO_ID if TEXTS[k][0] is None else TEXTS[k][0]
    first = {}
    for k, w in words.items():
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            first[g] = min(first.get(g, (2**64, 0)), (place(k), s))
    want = Counter()
    for k, w in words.items():
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (place(k), s):
                gone |= set(range(s, s + 20))
        want[TEXTS[k][0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in R.dedup_substrings(docs, hits_a_shard=50, crowd=crowd).collect())
    assert got == want and R.dedup_substrings(empty).count() == 0


def test_texts_without_repeats_are_not_shuffled(spark, docs):
    """Rows are parted by whether they may be wanted: none is lost or doubled, all wanted ones are met, and most others aren't."""
    rows = spark.range(0, 4000, 1, 7).select((F.col("id") % 7 * 2**33 + F.col("id")).alias("_row"), F.col("id").alias("n"))
    keys = rows.where("n % 20 = 0").select("_row")
    met, rest = ([r.n for r in x.collect()] for x in R._parted(rows, keys))
    assert sorted(met + rest) == list(range(4000)) and set(range(0, 4000, 20)) <= set(met) and len(met) < 800
    met, rest = R._parted(rows, keys.limit(0))
    assert met.count() == 0 and rest.count() == 4000


def test_kept_words_are_bytes_between_ascii_space():
    text = "a\x0bb\x0c c\u00a0d\u2003e \x1cf\0g\r\n\x85h"
    assert text.encode().split() == R.Words([text], "space").text_of(0, 6) == [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text)]


def test_anchors_of_long_texts():
    words = np.random.default_rng(0).integers(0, 2**63, 3000, dtype=np.uint64)
    assert (R.anchors(words) == R.anchors(words, step=64)).all() and len(R.anchors(words[:19])) == 0 and len(R.anchors(words[:20])) == 1


def test_automaton_judges_every_window():
    """Matching statistics and earliest places of an automaton against all substrings."""
    rng = np.random.default_rng(4)
    said = [(d, d, 0, " ".join(map(str, rng.integers(0, 2, 60))).encode()) for d in range(6)]
    first = {}
    for doc, _, _, words in said:
        w = words.split()
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (doc, k))
    want = {(d, p) for d, _, _, words in said for k in range(41) if first[tuple(words.split()[k : k + 20])] != (d, k) for p in range(k, k + 20)}
    assert {(row, p) for row, a, b in R.judge(said) for p in range(a, b)} == want


@pytest.mark.parametrize("shards", [1, 7])
def test_kd_shards(spark, docs, empty, shards):
    import zlib

    raw = lambda t: (t or "").encode()
    got = K.kd_shards(docs, shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t in TEXTS) and K.kd_shards(empty, shards).count() == 0
    at = defaultdict(list)
    for r in got:
        at[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in at.values()) and set(at) <= set(range(shards))
    copies = [(5000 + i, "the same text", "en", "s") for i in range(1500)] + [(9000 + i, f"group {i % 30} " * 9, None, f"s{i}") for i in range(300)]
    many = [(i, f"text {i} " * (i % 17), "en", f"s{i % 5}") for i in range(3000)] + copies
    size, where = Counter(), defaultdict(set)
    texts = {i: t for i, t, _, _ in many}
    for r in K.kd_shards(spark.createDataFrame(many, "doc_id long, text string, lang string, source string"), shards).collect():
        size[r.shard] += r.size
        where[texts[r.doc_id]].add(r.shard)
    assert max(size.values()) <= 1.02 * min(size.values())
    assert all(len(v) == 1 for t, v in where.items() if t != "the same text" or 1500 * 29 <= sum(size.values()) / shards)


def test_kd_splits_against_brute_force():
    """Heavy points: each side of a node holds its share of the bytes to within one point, and no point is lost."""
    rng = np.random.default_rng(8)
    for leaves in (2, 3, 5, 40):
        points = [K.Heavy(g, [int(x) << K.TIE_BITS for x in rng.integers(0, 99, 3)], int(w)) for g, w in enumerate(rng.integers(1, 1000, 60))]
        left, right = K._deal(points, 1, (leaves // 2) / leaves)
        total = sum(p.weight for p in points)
        assert {p.group for p in left} | {p.group for p in right} == set(range(60)) and len(left) + len(right) == 60
        assert abs(sum(p.weight for p in left) - total * (leaves // 2) / leaves) <= min(p.weight for p in right)


def test_token_counts(spark, docs, empty):
    import public_tokenizers

    path = N.tokenizer_file("byte_bpe_50k.tiktoken")
    enc = N.encoder(N.load_ranks(path), public_tokenizers.PATTERN, path)
    want = Counter((i, len(enc.encode_ordinary(t or ""))) for i, t in TEXTS)
    for block in (1 << 18, 64):
        out = N.count_tokens(N.scan_blocks(N.flat_blocks(docs, path, public_tokenizers.PATTERN, 50256, block), 50256))
        assert Counter((r.doc_ids[r.ordinal], r.n_tokens) for r in out.collect()) == want
    assert N.count_tokens(N.scan_blocks(N.flat_blocks(empty, path, public_tokenizers.PATTERN, 50256), 50256)).count() == 0


def test_flat_files(spark, tmp_path):
    ids = np.array([5, 6, 9, 9, 7, 8, 1, 9, 3], dtype=np.uint16)
    ids.tofile(tmp_path / "a.bin")
    blocks = N.read_blocks(spark, str(tmp_path), 2, 2)
    out = N.count_tokens(N.scan_blocks(blocks, 9)).orderBy("start").collect()
    assert [(r.start, r.n_tokens) for r in out] == [(0, 2), (3, 0), (4, 3)]


def test_language(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = E.fit(table)
    out = E.predict(table.where(E.held_out()), model).collect()
    assert sum(r._lang_pred == r.lang for r in out) / len(out) > 0.97 and all(0 <= r._lang_score <= 1 for r in out)
    odd = {r.doc_id: r._lang_pred for r in E.predict(docs, model).collect()}
    assert odd[3] == odd[4] == "und" and E.predict(empty, model).count() == 0
    assert E.fit(empty).predict(["a"])[0] == ["und"] and set(E.codewords(12).ravel()) == {-1, 1}


def test_pipeline_against_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d).collect()
    texts = {r.doc_id: r.text for r in L.dedup_lines(E.keep_identified(spark.read.parquet(f"{d}/documents.parquet"))).collect()}
    sets = {i: set(J.shingle_sets([t])[0].tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 5 * n >= 4 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    dirty = {r.doc_id for r in D.find_benchmark(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), bench).where("_n_hit > 0").collect()}
    kept = {i for i in ids if find(i) == i}
    clean = {r.doc_id for r in D.decontaminate(spark.createDataFrame([(i, texts[i]) for i in sorted(kept)], "doc_id long, text string"), bench).collect()}
    assert {r.doc_id for r in out} == clean and all(r.round_trip for r in out) and kept - clean <= dirty
