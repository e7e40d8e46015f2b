"""Column functions over query strings, paths and source text. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of task keywords.
TASK_STOP_WORDS = ["the", "and", "for", "with", "that", "this", "from", "have", "does", "what", "should", "would", "will"]

# Task types by the words that name them, tried in order.
TASK_TYPES = [
    ("refactor", "refactor|restructure|reorganize|migrate"),
    ("debug", "debug|fix|bug|error|crash|broken"),
    ("add-feature", "add|create|implement|build|new feature"),
    ("explain", "explain|understand|how does|what is|document"),
    ("optimize", "optimize|performance|speed|slow|faster"),
    ("test", "test|coverage|spec"),
]

# The other set of task types, for context around a file.
CONTEXT_TASK_TYPES = [
    ("refactor", r"\brefactor\b|\brewrite\b|\brestructure\b|\bclean\s*up\b"),
    ("debug", r"\bdebug\b|\bfix\b|\bbug\b|\bissue\b|\berror\b|\bcrash\b"),
    ("add-feature", r"\badd\b|\bcreate\b|\bimplement\b|\bfeature\b|\bbuild\b"),
    ("explain", r"\bexplain\b|\bunderstand\b|\bhow\b|\bwhat\b|\bwhy\b|\bdocument\b"),
]

# Misspellings that betray a typing error.
MISSPELLINGS = [
    r"\bie\b.*\bie\b",
    r"\bteh\b",
    r"\bfucntion\b",
    r"\breutrn\b",
    r"\bretrun\b",
    r"\bconosle\b",
    r"\bconsle\b",
    r"\bimprot\b",
    r"\bexpot\b",
    r"\bdocumnet\b",
]

# What is redacted, in this order.
PRIVATE_KEY = r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----[\s\S]*?(?:-----END (?:[A-Z ]+ )?PRIVATE KEY-----|\z)"
PRIVATE_KEY_SHOWN = "[REDACTED PRIVATE KEY]"
REDACTIONS = [
    (r"""\b(?:sk-[\w-]{20,}|gh[pousr]_[\w]{20,}|AKIA[A-Z0-9]{16}|eyJ[\w-]+\.[\w-]+\.[\w-]+)\b""", "[REDACTED]"),
    (r"""(?i)(\b\w*(?:password|passwd|secret|api[_-]?key|access[_-]?token|authorization)\w*["']?\s*[:=]\s*)(["'`])[^"'`\r\n]*\2""", '$1"[REDACTED]"'),
    (r"""(?im)^(\s*[\w.-]*(?:password|passwd|secret|api[_-]?key|access[_-]?token|authorization)[\w.-]*\s*[:=]\s*)(?!["'`])[^\r\n]+""", "$1[REDACTED]"),
    (r"""(?i)(\bBearer\s+)[\w.+/=-]+""", "$1[REDACTED]"),
    (r"""(\w+://)[^\s/:@]+:[^\s/@]+@""", "$1[REDACTED]@"),
]

# Paths that rank lower, and by how much.
LOW_RANKED = ["**/.next/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/*.min.js", "**/node_modules/**"]
LOW_RANK_FACTOR = 0.42

# Patterns of the search mode router.
PATH_LIKE = r"[\\/]|\.[a-zA-Z0-9]{1,8}\b|\b[a-z][a-z0-9]*[A-Z][a-zA-Z0-9]*\b|\b[a-zA-Z]+_[a-zA-Z_]+\b"
QUESTION = r"(?i)\b(how|where|what|why|when|which|explain|describe|implement|does|is there)\b"
REGEX_QUERY = r"^/(.+)/([gimsuy]*)$"


def normalize_query(q: Column) -> Column:
    """Letters and digits stay; every other run becomes one space."""
    return F.trim(F.regexp_replace(F.coalesce(q, F.lit("")), r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for null or wordless text."""
    return F.filter(F.split(normalize_query(F.lower(text)), " "), lambda w: w != "")


def or_expression(q: Column) -> Column:
    """The tokens joined by OR; null below two tokens."""
    words = F.filter(F.split(normalize_query(q), " "), lambda w: w != "")
    return F.when(F.size(words) >= 2, F.array_join(words, " OR "))


def snippet(text: Column, most: int = 2000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def extract_keywords(task: Column, most: int = 10) -> Column:
    """Up to `most` distinct words of three letters or more that aren't stop words, in order."""
    words = F.split(F.regexp_replace(F.lower(task), r"[^A-Za-z0-9_\s]", " "), r"\s+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(TASK_STOP_WORDS))), 1, most)


def task_type(task: Column, types: list[tuple[str, str]] = TASK_TYPES) -> Column:
    """The first kind whose pattern the task meets, else general; null and empty tasks are general."""
    out = F.lit("general")
    for kind, pattern in reversed(types):
        out = F.when(F.lower(task).rlike(pattern), kind).otherwise(out)
    return out


def detect_typos(query: Column) -> Column:
    """Whether a query of three letters or more has a letter three times running, a word over 15 letters or a known misspelling."""
    long_word = F.exists(F.split(query, r"\s+"), lambda w: F.length(w) > 15)
    wrong = query.rlike(r"(.)\1{2,}") | long_word | query.rlike("|".join(MISSPELLINGS))
    return F.coalesce((F.length(query) >= 3) & wrong, F.lit(False))


def parse_regex(query: str) -> tuple[str, str] | None:
    """Pattern and flags of a /pattern/flags query; without flags, case doesn't count."""
    m = re.match(REGEX_QUERY, query.strip())
    return (m[1], m[2] or "i") if m else None


def regex_parts(query: Column) -> Column:
    """struct(pattern, flags) of a /pattern/flags query, else null."""
    q = F.trim(query)
    flags = F.regexp_extract(q, REGEX_QUERY, 2)
    return F.when(q.rlike(REGEX_QUERY), F.struct(F.regexp_extract(q, REGEX_QUERY, 1).alias("pattern"), F.when(flags == "", "i").otherwise(flags).alias("flags")))


def namespace(project: Column, prefix: str, profile: Column) -> Column:
    """The name of a project's vector collection: letters, digits and _ of the project, and 12 hex digits of the embedding profile's hash unless it is null."""
    mark = F.when(profile.isNull(), "").otherwise(F.concat(F.lit("_"), F.substring(F.sha2(profile, 256), 1, 12)))
    return F.concat(F.lit(prefix), F.regexp_replace(project, "[^a-zA-Z0-9_]", "_"), mark)


def normalize_path(path: Column) -> Column:
    """Forward slashes, without . and with .. taken back where a part is left to take."""
    popped = lambda s: F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))
    parts = F.split(F.translate(path, "\\", "/"), "/")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when((p == ".") | (p == ""), s).when(p == "..", popped(s)).otherwise(F.concat(s, F.array(p))))
    return F.array_join(walked, "/")


def route_mode(query: Column) -> Column:
    """The search mode that `auto` means for a query: regex, keyword or hybrid."""
    q = F.trim(query)
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    short = (F.length(q) < 40) & (words <= 3)
    return (
        F.when(q.rlike(REGEX_QUERY) & (F.length(q) >= 3), "regex")
        .when(short & q.rlike(PATH_LIKE), "keyword")
        .when((words > 6) | q.rlike(QUESTION) | (F.length(q) > 80) | (words >= 4), "hybrid")
        .otherwise("keyword")
    )


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last dot and what follows, lower-cased; '' if there is none or the name only begins with it."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def glob_regex(glob: str, dialect: str = "segments") -> str:
    """A glob as an anchored regular expression.

    Dialects: `sql` (* crosses /, case counts), `simple` (* stays in a segment, ** crosses, no
    case), `segments` (* and ? stay in a segment, **/ may match nothing, dot files included).
    """
    out, i = [], 0
    while i < len(glob):
        c, two = glob[i], glob[i : i + 2] == "**"
        if dialect == "sql":
            piece, step = (".*" if c == "*" else "." if c == "?" else re.escape(c)), 1
        elif dialect == "simple":
            piece, step = (".*", 2) if two else ("[^/]*" if c == "*" else "." if c == "?" else re.escape(c), 1)
        elif two and glob[i + 2 : i + 3] == "/":
            piece, step = "(?:.*/)?", 3
        elif two:
            piece, step = ".*", 2
        else:
            piece, step = ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), 1
        out.append(piece)
        i += step
    return ("(?i)" if dialect == "simple" else "") + "^" + "".join(out) + "$"


def ignore_regex(patterns: list[str]) -> str:
    """One expression for an ignore file's lines: a trailing / means a tree, no / any segment, else a glob from the root."""
    parts = []
    for line in (p.strip() for p in patterns):
        if not line or line.startswith("#"):
            continue
        if line.endswith("/"):
            body = glob_regex(line.rstrip("/").lstrip("/"))[1:-1]
            parts.append(f"^(?:.*/)?{body}/.*$" if "/" not in line.strip("/") else f"^{body}/.*$")
        elif "/" not in line:
            parts.append(f"(?:^|/){glob_regex(line)[1:-1]}(?:/|$)")
        else:
            parts.append(glob_regex(line.lstrip("/")))
    return "|".join(parts) if parts else r"^\b$"


def path_quality(path: Column, score: Column) -> Column:
    low = "|".join(glob_regex(g) for g in LOW_RANKED)
    return score * F.when(path.rlike(low), F.lit(LOW_RANK_FACTOR)).otherwise(F.lit(1.0))


def redact(text: Column) -> Column:
    """Private keys (line count kept), token shapes, quoted and bare credentials, bearer tokens and URL credentials."""
    blocks, between = F.regexp_extract_all(text, F.lit(f"({PRIVATE_KEY})"), 1), F.split(text, PRIVATE_KEY, -1)
    hidden = F.transform(blocks, lambda b: F.array_join(F.transform(F.split(b, "\n", -1), lambda _: F.lit(PRIVATE_KEY_SHOWN)), "\n"))
    out = F.when(F.size(blocks) > 0, F.array_join(F.zip_with(between, hidden, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(text)
    for pattern, to in REDACTIONS:
        out = F.regexp_replace(out, pattern, to)
    return out
