"""Personal data: fixed patterns, and terms that corpus co-occurrence shows to reveal them.

One pass over the texts counts, for every word of the corpus, the documents that hold it and those
of them that also hold a protected entity, and with how many different entities it was met. A
term's disclosure is the chance that a document with it holds an entity, and the information (in
bits) that the term gives about that. Copies of one document bring one entity, so the words they
share don't pass for evidence. A second pass marks the base spans and all occurrences of the terms
above the thresholds, wherever they stand; both are generalised.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphion.llm.common import carry, durable, pieces, restore, table

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate((*KINDS, "term"))}
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't start inside a run of digits, since the run's start would match; so runs are taken whole.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Kind, start and end of the base entities, by start and kind."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def words_outside(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    """The different words (lower-cased) outside all spans, which come by start."""
    out, at = set(), 0
    for _, a, b in (*spans, ("", len(text), len(text))):
        if at < a:
            out.update(WORD.findall(text, at, a))
        at = max(at, b)
    return {w.lower() for w in out}


def entity_mark(text: str, spans: list[tuple[str, int, int]]) -> int:
    """One hash for a document's entities: the least, so that copies and most near copies have the same."""
    return min(int.from_bytes(hashlib.blake2b(f"{k}:{text[a:b]}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for k, a, b in spans)


SPANS = "array<struct<kind:string,a:long,b:long>>"
SPAN = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))


def _scan(held_terms: int):
    def scan(batches):
        held: Counter = Counter()  # documents a word
        met: Counter = Counter()  # documents with an entity a word and the entity's mark

        def counted():
            terms, marks = [*held, *(t for t, _ in met)], [*([None] * len(held)), *(m for _, m in met)]
            n, with_ = [*held.values(), *([0] * len(met))], [*([0] * len(held)), *met.values()]
            held.clear(), met.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((terms, pa.string()), (marks, pa.int64()), (n, pa.int64()), (with_, pa.int64()))], names=["term", "mark", "n", "m"])

        for batch in pieces(batches):
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                words = words_outside(text, spans) | {""}
                held.update(words)
                if spans:
                    mark = entity_mark(text, spans)
                    met.update((w, mark) for w in words)
                if len(held) + len(met) > held_terms:
                    yield counted()
        yield counted()

    return scan


def disclosure(docs: DataFrame, held_terms: int = 400_000) -> DataFrame:
    """Of each word of the corpus: n documents that hold it outside entities, m of them with an entity, v different entity marks among these."""
    scanned = docs.select("text").mapInArrow(_scan(held_terms), "term string, mark long, n long, m long")
    each = scanned.groupBy("term", "mark").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return each.groupBy("term").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("mark").alias("v"))


def disclosing_terms(docs: DataFrame, least: int, share: float, bits: float, held_terms: int) -> DataFrame:
    """The terms above the thresholds of find_pii."""
    counts = durable(disclosure(docs, held_terms).where(F.col("v") >= F.when(F.col("term") == "", 0).otherwise(least)))
    every = counts.where("term = ''").first()  # all documents with a text count under an empty word
    rate = every["m"] / every["n"] if every and every["m"] else 1.0
    chance = F.col("m") / F.col("n")
    return counts.where("term <> ''").where(chance >= share).where(F.log2(chance / F.lit(rate)) >= bits).select("term")


def occurrences(text: str, spans: list[tuple[str, int, int]], terms: frozenset[str]) -> list[tuple[str, int, int]]:
    """All occurrences of the terms outside the spans, which come by start."""
    out, at = [], 0
    for _, a, b in (*spans, ("", len(text), len(text))):
        if at < a and not terms.isdisjoint(w.lower() for w in WORD.findall(text, at, a)):
            out += [("term", m.start(), m.end()) for m in WORD.finditer(text, at, a) if m[0].lower() in terms]
        at = max(at, b)
    return out


def _mark(held, keep: list[str]):
    def mark(batches):
        terms = held.value
        for batch in pieces(batches):
            out = []
            for text, had in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                spans = base_spans(text) if had is None else [(s["kind"], s["a"], s["b"]) for s in had]
                if text and terms:
                    spans += occurrences(text, [s for s in spans if s[0] != "term"], terms)
                out.append([{"kind": k, "a": a, "b": b} for k, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))])
            yield pa.RecordBatch.from_arrays([pa.array(out, SPAN) if c == "spans" else batch.column(c) for c in keep], names=keep)

    return mark


def marked(rows: DataFrame, terms: DataFrame, keep: list[str], block_bytes: int) -> DataFrame:
    """The columns keep of rows (text and others) and spans; terms go out in blocks, a pass each."""
    terms = durable(terms)
    blocks = max(1, -(-(terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0) // block_bytes))
    out = rows.withColumn("spans", F.lit(None).cast(SPANS))
    for k in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).collect()
        held = rows.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in mine))
        last = k + 1 == blocks
        names = [*keep, "spans"] if last else out.columns
        out = out.mapInArrow(_mark(held, names), out.select(*names).schema)
        if not last:
            out = durable(out)
            held.destroy()
    return out


def find_pii(docs: DataFrame, least: int = 8, share: float = 0.5, bits: float = 3.0, held_terms: int = 400_000, block_bytes: int = 4 << 20) -> DataFrame:
    """_row, doc_id, spans (kind, a, b: base entities and terms) of each document; spans by start and kind, in code points.

    Terms: runs of letters, lower-cased, outside entities. A term discloses if a `share` of the
    documents that hold it hold an entity too, with at least `least` different ones, and if the
    information log2(P(entity | term) / P(entity)) is `bits` or more. All its occurrences outside
    entities, in all documents, become spans of kind term. Null texts are empty; rows are judged
    one by one, repeated ids included. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("_row", F.monotonically_increasing_id())
    return marked(rows, disclosing_terms(docs, least, share, bits, held_terms), ["_row", "doc_id"], block_bytes)


def sanitised(docs: DataFrame, least: int = 8, share: float = 0.5, bits: float = 3.0, held_terms: int = 400_000, block_bytes: int = 4 << 20) -> DataFrame:
    """docs with each span of find_pii replaced by its kind in text; all columns stay."""

    def run(batches):
        for batch in batches:
            texts = zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
            said = [redact(t, [(s["kind"], s["a"], s["b"]) for s in spans]) for t, spans in texts]
            yield pa.RecordBatch.from_arrays([batch.column("_all"), pa.array(said, pa.string())], names=["_all", "text"])

    terms = disclosing_terms(docs, least, share, bits, held_terms)
    work = marked(carry(docs, "text"), terms, ["_all", "text"], block_bytes)
    return restore(work.mapInArrow(run, work.select("_all", "text").schema), docs, "text")


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind; overlapping spans become one, named after the first."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op4_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    out = find_pii(table(spark, sf_dir, "documents"))
    said = lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return out.select(
        "doc_id", *(F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", said), ",").alias("spans"),
    )
