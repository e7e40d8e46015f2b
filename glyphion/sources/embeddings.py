"""Vectors for texts: a plug for any embedder, in batches, with retries and checks; and one that needs no service."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

# Texts a request, attempts after a failure, and the longest wait that a service may ask for.
BATCH, RETRIES, MOST_WAIT = 32, 2, 10.0


class Busy(Exception):
    """What an embedder raises for a failure that may pass; after: the seconds that the service asks to wait, if any."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


def checked(vectors: Sequence[Sequence[float]], texts: int, dimensions: int) -> list[list[float]]:
    """The vectors, if there is one of the right length and finite numbers for each text."""
    if len(vectors) != texts:
        raise ValueError(f"{len(vectors)} vectors for {texts} texts")
    for v in vectors:
        if len(v) != dimensions or not all(isinstance(x, int | float) and math.isfinite(x) for x in v):
            raise ValueError(f"a vector needs {dimensions} finite numbers")
    return [[float(x) for x in v] for v in vectors]


def in_order(rows: list[tuple[int, Sequence[float]]], texts: int) -> list[Sequence[float]]:
    """Vectors that a service gave with the number of their text, in the order of the texts."""
    if sorted(i for i, _ in rows) != list(range(texts)):
        raise ValueError("each text needs one vector")
    return [v for _, v in sorted(rows, key=lambda r: r[0])]


def ask(embedder: Callable[[list[str]], Sequence], texts: list[str], dimensions: int, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """One request, repeated while the service is busy; longer pauses than it may ask for are failures."""
    for attempt in range(retries + 1):
        try:
            return checked(embedder(texts), len(texts), dimensions)
        except Busy as e:
            pause = 0.25 * 2**attempt if e.after is None else e.after
            if attempt == retries or pause > MOST_WAIT:
                raise
            wait(pause)
    raise AssertionError("unreachable")


def embedded(rows: DataFrame, embedder: Callable[[list[str]], Sequence], dimensions: int, batch: int = BATCH, retries: int = RETRIES) -> DataFrame:
    """id, vector of rows (id, text). The embedder travels to the tasks; null texts count as empty ones."""

    def run(batches):
        for part in batches:
            texts = [t or "" for t in part.column("text").to_pylist()]
            found = [v for a in range(0, len(texts), batch) for v in ask(embedder, texts[a : a + batch], dimensions, retries)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.list_(pa.float32()))], names=["id", "vector"])

    whole = rows.select("id", "text")
    return whole.mapInArrow(run, f"id {whole.schema['id'].dataType.simpleString()}, vector array<float>")


def hashed_ngrams(dimensions: int = 256, n: int = 3) -> Callable[[list[str]], list[list[float]]]:
    """An embedder without a service: counts of hashed letter n-grams, of length one."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimensions
            said = f" {' '.join(text.lower().split())} "
            for i in range(max(1, len(said) - n + 1)):
                h = int.from_bytes(hashlib.blake2b(said[i : i + n].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return embed
