"""Pieces of SQL for DuckDB that say what the engine's expressions say: words, Porter stems, redaction, rules, derived inputs."""

from __future__ import annotations

from glyphion.functions import stem as S
from glyphion.functions import text as T
from glyphion.operators import rules


def lit(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({names})"


def folded(c: str) -> str:
    marked, bare = S._accents()
    return f"translate({c}, '{marked}', '{bare}')"


def tokens(c: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"


def _cut(suffix: str, to: str = "") -> str:
    return f"left(w, greatest(length(w) - {len(suffix)}, 0))" + (f" || '{to}'" if to else "")


def _is(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {lit(pattern)})"


def _rules(table: dict[str, str], measure: str) -> str:
    cases = []
    for s in sorted(table, key=len, reverse=True):
        fits = _is(_cut(s), measure) + (f" AND {_is(_cut(s), '[st]$')}" if s == "ion" else "")
        cases.append(f"WHEN suffix(w, '{s}') THEN CASE WHEN {fits} THEN {_cut(s, table[s])} ELSE w END")
    return "CASE " + " ".join(cases) + " ELSE w END"


def stems(words: str) -> str:
    """CTEs up to `stems` (word, stem) for a relation of words (word)."""
    ends = lambda s: f"suffix(w, '{s}')"
    steps = [
        f"CASE WHEN {ends('sses')} OR {ends('ies')} THEN {_cut('es')} WHEN {ends('ss')} THEN w WHEN {ends('s')} THEN {_cut('s')} ELSE w END",
        f"CASE WHEN {ends('eed')} THEN ' ' || CASE WHEN {_is(_cut('eed'), S.ONE_OR_MORE)} THEN {_cut('d')} ELSE w END WHEN {ends('ed')} AND {_is(_cut('ed'), S.HAS_VOWEL)} THEN {_cut('ed')} WHEN {ends('ing')} AND {_is(_cut('ing'), S.HAS_VOWEL)} THEN {_cut('ing')} ELSE ' ' || w END",
        f"CASE WHEN prefix(w, ' ') THEN substr(w, 2) WHEN {ends('at')} OR {ends('bl')} OR {ends('iz')} THEN w || 'e' WHEN {_is('w', S.DOUBLE)} THEN {_cut('x')} WHEN {_is('w', S.SHORT_END)} THEN w || 'e' ELSE w END",
        f"CASE WHEN {ends('y')} AND {_is(_cut('y'), S.HAS_VOWEL)} THEN {_cut('y', 'i')} ELSE w END",
        _rules(S.STEP_2, S.ONE_OR_MORE), _rules(S.STEP_3, S.ONE_OR_MORE), _rules(dict.fromkeys(S.STEP_4, ""), S.TWO_OR_MORE),
        f"CASE WHEN {ends('e')} AND ({_is(_cut('e'), S.TWO_OR_MORE)} OR ({_is(_cut('e'), S.EXACTLY_ONE)} AND NOT {_is(_cut('e'), S.SHORT_END)})) THEN {_cut('e')} ELSE w END",
        f"CASE WHEN {ends('ll')} AND {_is('w', S.TWO_OR_MORE)} THEN {_cut('l')} ELSE w END",
    ]
    out = [f"z0 AS (SELECT word, CASE WHEN prefix(word, 'y') THEN 'Y' || substr(word, 2) ELSE word END AS w FROM (SELECT DISTINCT word FROM ({words})))"]
    out += [f"z{i} AS (SELECT word, {s} AS w FROM z{i - 1})" for i, s in enumerate(steps, 1)]
    return ", ".join([*out, f"stems AS (SELECT word, CASE WHEN length(word) < 3 THEN word ELSE lower(w) END AS stem FROM z{len(steps)})"])


def bm25(docs: str, key: str, said: str, searches: dict[int, str]) -> str:
    """CTEs up to hits (query_id, key, n_terms, matched, score) over a relation of documents."""
    asked = values(list(searches.items()), "query_id, query")
    return f"""
WITH d AS (SELECT {key}, {tokens(folded(said))} AS t FROM {docs}),
w AS (SELECT {key}, len(t) AS dl, unnest(t) AS word FROM d),
qw AS (SELECT query_id, unnest({tokens(folded("query"))}) AS word FROM {asked}),
{stems("SELECT word FROM w UNION SELECT word FROM qw")},
q AS (SELECT DISTINCT query_id, stem FROM qw JOIN stems USING (word)),
qn AS (SELECT query_id, count(*) AS n_terms FROM q GROUP BY 1),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
tf AS (SELECT {key}, stem, count(*) AS tf, any_value(dl) AS dl FROM w JOIN stems USING (word) WHERE stem IN (SELECT stem FROM q) GROUP BY ALL),
df AS (SELECT stem, count(*) AS df FROM tf GROUP BY 1),
hits AS (SELECT query_id, {key}, n_terms, count(*) AS matched,
  round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM tf JOIN df USING (stem) JOIN q USING (stem) JOIN qn USING (query_id), st GROUP BY query_id, {key}, n_terms)"""


def redacted(c: str) -> str:
    """The redaction without look-ahead and back references: a quoted value ends with the quote it began with."""
    key, shown = lit(T.PRIVATE_KEY), lit(T.PRIVATE_KEY_SHOWN)
    masked = f"array_to_string(list_transform(string_split(p[2], chr(10)), lambda z: {shown}), chr(10))"
    out = f"array_to_string(list_transform(list_zip(string_split_regex({c}, {key}), regexp_extract_all({c}, {key})), lambda p: p[1] || coalesce({masked}, '')), '')"
    out = f"CASE WHEN regexp_matches({c}, {key}) THEN {out} ELSE {c} END"
    for pattern, to in T.REDACTIONS:
        pattern = pattern.replace("([\"'`])[^\"'`\\r\\n]*\\2", "(?:\"[^\"'`\\r\\n]*\"|'[^\"'`\\r\\n]*'|`[^\"'`\\r\\n]*`)").replace("(?![\"'`])[^\\r\\n]+", "[^\"'`\\r\\n][^\\r\\n]*")
        flags = "g"
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(to.replace('$1', chr(92) + '1'))}, '{flags}')"
    return out


def rule_hits(files: str) -> str:
    """CTEs up to found (file, line, rule, category, priority, kind) for a relation of files (file, text)."""
    table = values([(r[0], r[1], r[4], r[5]) for r in rules.RULES], "rule, category, kind, priority")
    test = " ".join(f"WHEN {lit(r[0])} THEN regexp_matches(s, {lit(r[6])})" + (f" OR regexp_matches(s, {lit(rules.BARE_CREDENTIAL)})" if r[0] == "credential" else "") for r in rules.RULES)
    return f"""WITH files AS ({files}),
lines AS (SELECT file, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS s FROM files WHERE NOT regexp_matches(file, {lit(rules.CONTAINERS)})),
found AS (SELECT file, line, rule, category, priority, kind FROM lines, {table} WHERE length(s) <= {rules.LONG_LINE} AND CASE rule {test} END)"""


#: Source files made from customers, a language by key: what the parsers read.
SOURCES = {
    0: ("python", "py", "# def fake{k}():\nimport os\nfrom pkg.m{n} import alpha, beta as b\nimport a, b\n\ndef run_{k}(x):\n    return alpha(x)\n\nclass C{k}:\n    def inner(self):\n        return 1\n\ndef _hidden{k}():\n    pass\n"),
    1: ("go", "go", 'package p{n}\nimport "fmt"\nimport (\n\t"os"\n\tx "net/m{n}"\n)\nfunc Run{k}(x int) int { return x }\nfunc hidden() {}\ntype T{k} struct {}\nvar V{k} = 1\n'),
    2: ("rust", "rs", "use std::io::{Read, Write};\nuse crate::m{n}::Item;\nmod part_{k};\npub fn run_{k}() {}\npub struct S{k} {}\n  pub enum E{k} { A }\npub trait Q{k} {}\nfn hidden() {}\n"),
    3: ("java", "java", "package p.m{n};\nimport java.util.List;\nimport static a.b.C{n}.*;\nclass J{k} {}\n"),
}
#: Files that rules fire on, a kind by key.
RISKY = [
    'q = "SELECT * FROM t WHERE a=" + x', "os.system(cmd)", "el.innerHTML = x", "requests.get(url)", "open(path)", "pickle.loads(b)", "h = md5(x)", "password = 'hunter2hunter2'",
    "DEBUG = True", "login(user)", "app.get('/x', f)", "flask==1.0", "api_key: abcdefgh12345", "plain words", "-----BEGIN PRIVATE KEY-----\nAAA\n-----END PRIVATE KEY-----",
    "Authorization: Bearer abc.def", "url https://me:pw@host/x", 'token = "sk-abcdefghijklmnopqrstuvwx"',
]
DIRECTORIES = ["src", "web/dist/js", "lib/services", "a/node_modules/b", "build/x", ".next/y", "coverage", "docs/api", "logs/a", "x/logs", "tests", "cmd/x"]
FILE_NAMES = ["{}.ts", "{}.min.js", "{}.PY", "{}.go", "Dockerfile", "{}.rs", "{}.md", "{}.unknown", "a{}.tar.gz", "noext{}", "config{}.js", "{}.test.ts", ".gitignore", "index.ts", "main.py", "{}.tmp"]


def path_sql(key: str = "doc_id") -> str:
    """A path for each key: its directory and name go by the key's remainders."""
    dirs = "[" + ", ".join(map(lit, DIRECTORIES)) + "]"
    names = "[" + ", ".join(map(lit, FILE_NAMES)) + "]"
    return f"{dirs}[({key} % {len(DIRECTORIES)})::INTEGER + 1] || '/' || replace({names}[({key} % {len(FILE_NAMES)})::INTEGER + 1], '{{}}', {key}::VARCHAR)"


def filled(template: str, k: str, n: str) -> str:
    return f"replace(replace({lit(template)}, '{{k}}', {k}::VARCHAR), '{{n}}', {n}::VARCHAR)"


def sources_sql() -> str:
    text = " ".join(f"WHEN {i} THEN {filled(t, 'c_custkey', 'c_nationkey')}" for i, (_, _, t) in SOURCES.items())
    name = " ".join(f"WHEN {i} THEN 'm' || c_nationkey || '/f' || c_custkey || '.{e}'" for i, (_, e, _) in SOURCES.items())
    language = " ".join(f"WHEN {i} THEN '{lang}'" for i, (lang, _, _) in SOURCES.items())
    return f"SELECT CASE c_custkey % 4 {name} END AS file, CASE c_custkey % 4 {language} END AS language, CASE c_custkey % 4 {text} END AS text FROM customer"
