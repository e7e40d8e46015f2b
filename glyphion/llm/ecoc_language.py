"""Language identification with error-correcting output codes over byte n-grams.

Each language has a codeword. For each bit a binary naive-Bayes classifier over hashed byte
trigrams tells the languages with a one from those with a zero. A text's bit margins are compared
with every codeword under a logistic loss, each bit weighted by how well its classifier does on
that language's training rows; the codeword of least loss wins, and a small lead flags ambiguity.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphion.llm.common import carry, durable, extended, pieces, restore, slices, table

DIMS = 4096
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not (97 <= i <= 122 or 65 <= i <= 90)]] = 32
_rng = np.random.default_rng(7)
_A, _B, _C = (_rng.integers(1, 2**32, 256, dtype=np.uint32)[_FOLD] for _ in range(3))


def histograms(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed byte trigrams, a row for each text; all but ASCII letters and non-ASCII bytes count as blanks."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"  ".join(parts) + b"  ", dtype=np.uint8)
    grams = (_A[data[:-2]] + _B[data[1:-1]] + _C[data[2:]]) >> np.uint32(20) if len(data) > 2 else np.empty(0, np.uint32)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]]).astype(np.int64)
    out = np.zeros((len(parts), DIMS), dtype=np.float32)
    for i, (a, n) in enumerate(zip(begin.tolist(), sizes.tolist())):
        if n > 2:
            out[i] = np.bincount(grams[a : a + n - 2], minlength=DIMS)
    return out


def codewords(languages: int) -> np.ndarray:
    """Codewords of +1 and -1: all splits into two sides for up to seven languages, else the best of some random codes."""
    if languages < 2:
        return np.ones((languages, 1), dtype=np.int8)
    if languages <= 7:
        cols = [[1] + [1 if (m >> i) & 1 else -1 for i in range(languages - 1)] for m in range(2 ** (languages - 1) - 1)]
        return np.array(cols, dtype=np.int8).T
    rng, bits, best, found = np.random.default_rng(11), int(np.ceil(10 * np.log2(languages))), -1, None
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), (languages, bits))
        far = (bits - code.astype(int) @ code.T.astype(int)) // 2 + bits * np.eye(languages, dtype=int)
        if far.min() > best:
            best, found = far.min(), code
    return found


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + 0.05) / (counts + 0.05).sum(1, keepdims=True)
        ones = self.code > 0
        logs = [np.log(share[ones[:, j]].mean(0)) - np.log(share[~ones[:, j]].mean(0)) if 0 < ones[:, j].sum() < len(languages) else np.zeros(DIMS) for j in range(self.code.shape[1])]
        self.weights = np.stack(logs, 1).astype(np.float32)
        self.trust = np.full(self.code.shape, 1 / self.code.shape[1])

    def margins(self, texts: list[str | None]) -> np.ndarray:
        h = histograms(texts)
        n = h.sum(1, keepdims=True)
        return (h @ self.weights) / np.maximum(n, 1) * np.minimum(n, 64)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """The weighted loss of each text (row) under each language's codeword."""
        out = np.empty((len(margins), len(self.languages)))
        for i, word in enumerate(self.code):
            out[:, i] = np.logaddexp(0, -margins * word) @ self.trust[i]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        loss = self.losses(self.margins(texts))
        order = np.argsort(loss, axis=1, kind="stable")
        best = loss[np.arange(len(loss)), order[:, 0]]
        with np.errstate(over="ignore"):
            score = 1 / np.exp(best[:, None] - loss).sum(1) if len(loss) else best
        lead = loss[np.arange(len(loss)), order[:, 1]] - best if len(self.languages) > 1 else np.full(len(best), np.inf)
        said = [t is not None and LETTER.search(t) is not None for t in texts]
        return (
            [self.languages[k] if ok else UNKNOWN for k, ok in zip(order[:, 0], said)],
            [float(s) if ok else 0.0 for s, ok in zip(score, said)],
            [not ok or bool(x < 0.1) for x, ok in zip(lead, said)],
        )


def held_out():
    """crc32 of doc_id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, fit_rows: int = 60_000, parts: int = 32, most_languages: int = 2000) -> Model:
    """Learns from text and non-null lang of rows that aren't held out.

    The sample: about `fit_rows` rows at most, those of one residue of a hash of doc_id. Rows
    without an id, text or lang teach nothing; without any rows every text is `und`.
    """
    known = docs.where("doc_id is not null and lang is not null").where(~held_out())
    every = max(1, -(-known.select("doc_id").count() // fit_rows))
    rows = known.where((F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(every)) == 0) & F.col("text").isNotNull())
    sample = durable(rows.select("text", "lang").repartition(parts))
    kinds = sorted(r[0] for r in sample.select("lang").distinct().limit(most_languages + 1).collect())
    if len(kinds) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    number = {k: i for i, k in enumerate(kinds)}

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in pieces(batches):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in slices(texts, 1 << 20):
                h = histograms(texts[a:b])
                for lang in set(langs[a:b]):
                    mine = h[[x == lang for x in langs[a:b]]].sum(0, dtype=np.float64)
                    total[lang] = total.get(lang, 0) + mine
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["lang", "v"])

    counts = np.zeros((len(kinds), DIMS))
    for r in sample.mapInArrow(count, "lang string, v binary").collect():
        counts[number[r["lang"]]] += np.frombuffer(r["v"])
    model = Model(kinds, counts)
    if len(kinds) > 1:
        held = docs.sparkSession.sparkContext.broadcast(model)

        def judge(batches):
            good, seen = np.zeros(model_shape), np.zeros((model_shape[0], 1))
            for batch in pieces(batches):
                texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
                for a, b in slices(texts, 1 << 20):
                    at = np.array([number[x] for x in langs[a:b]])
                    right = (held.value.margins(texts[a:b]) * held.value.code[at]) > 0
                    np.add.at(good, at, right)
                    np.add.at(seen, at, 1)
            yield pa.RecordBatch.from_arrays([pa.array([good.tobytes()]), pa.array([seen.tobytes()])], names=["good", "seen"])

        model_shape = model.code.shape
        good, seen = np.full(model_shape, 0.5), np.ones((model_shape[0], 1))
        for r in sample.mapInArrow(judge, "good binary, seen binary").collect():
            good += np.frombuffer(r["good"]).reshape(model_shape)
            seen += np.frombuffer(r["seen"]).reshape(-1, 1)
        trust = np.maximum(good / seen - 0.5, 1e-3)
        model.trust = trust / trust.sum(1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _lang_pred, _lang_score (0 to 1) and _ambiguous, from text alone.

    A null text, or one without a letter, is `und` with score 0; whole texts count, of any length.
    """
    work = carry(docs, "text")
    names = work.columns
    fields = extended(work.schema, "_lang_pred string, _lang_score double, _ambiguous boolean")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in pieces(batches):
            texts = batch.column(names.index("text")).to_pylist()
            got: list[list] = [[], [], []]
            for a, b in slices(texts, 1 << 20):
                for k, v in enumerate(held.value.predict(texts[a:b])):
                    got[k] += v
            fresh = [pa.array(v, t) for v, t in zip(got, (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *fresh], names=[*names, "_lang_pred", "_lang_score", "_ambiguous"])

    return restore(work.mapInArrow(judge, fields), docs, "_lang_pred", "_lang_score", "_ambiguous")


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """docs without those whose language can't be told: `und`, or no codeword has half of the score."""
    told = predict(docs, fit(docs.select("doc_id", "text", "lang")))
    return told.where((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") >= least_score)).select(*docs.columns)


def op2_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"), F.col("_ambiguous").alias("ambiguous"))
