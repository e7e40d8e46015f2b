"""Helpers shared by the corpus operators: table access, checkpoints and vectorised word scanning.

The word scanner works on the UTF-8 bytes of a whole Arrow batch at once. Word identity is a
64-bit polynomial hash over a fixed table of random byte values, so equal words get equal hashes
and the hashes are the same on every executor.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphion.storage import Scratch, delete, durable, shared_dir  # noqa: F401  for the operators

_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
GRAM = np.uint64(0xD6E8FEB86659FD93)

#: bytes that separate words, by name of the word rule
_ASCII_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_CODES = np.arange(256)
_ALNUM = (_CODES >= 0x80) | ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A))
WORD_BYTES = {"space": ~_ASCII_SPACE, "alnum": _ALNUM}

_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_join(rows: DataFrame, side: DataFrame, key: str, by: Column, counts: DataFrame, total: int) -> DataFrame:
    """rows joined to side, which has one row a key; keys with very many rows meet it in several tasks.

    counts: key and n, its rows. by: what tells the rows of one key apart. Keys with more than
    1,000 rows and a 50,000th of all are split, so at most 50,000 of them are broadcast.
    """
    most = max(1000, total // 50_000)
    hot = F.broadcast(counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("_parts")))
    left = rows.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), "_parts").cast("int"), F.lit(0))).drop("_parts")
    right = side.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def wanted_only(rows: DataFrame, keys: DataFrame, key: str, most_bits: int = 1 << 28, others: bool = False) -> DataFrame:
    """Those of rows whose hash `key` (a long) may be among keys; a few others pass too. others: all rows that don't pass instead.

    A bitmap of 16 bits a key goes out as rows of 4 KB, 32 MB of them at most, so that rows are
    dropped where they are read; with more keys more other rows pass.
    """
    bits = min(most_bits, max(1 << 15, 1 << (16 * keys.count()).bit_length()))
    at = F.pmod(F.col(key), F.lit(bits))
    maps = keys.select(F.shiftright(at, 15).alias("_block"), at.bitwiseAND(32767).alias("_at"))
    maps = maps.groupBy("_block").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    out = rows.withColumns({"_block": F.shiftright(at, 15), "_at": at.bitwiseAND(32767).cast("int")}).join(F.broadcast(maps), "_block", "left" if others else "inner")
    may = F.expr("getbit(cast(conv(hex(substring(_bits, shiftright(_at, 3) + 1, 1)), 16, 10) as int), _at & 7) = 1")
    return out.where(~F.coalesce(may, F.lit(False)) if others else may).drop("_block", "_at", "_bits")


def carry(docs: DataFrame, *needed: str) -> DataFrame:
    """All columns packed in _all, and those an operator reads, so that no column's name can clash with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"), *needed)


def restore(out: DataFrame, docs: DataFrame, *computed: str) -> DataFrame:
    """The columns of docs in their order, then computed ones; a computed column takes the place of one of its name."""
    mine = [F.col(c) if c in computed else F.col("_all").getField(c).alias(c) for c in docs.columns]
    return out.select(*mine, *(c for c in computed if c not in docs.columns))


def extended(schema: StructType, ddl: str) -> StructType:
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        filled = 1
        with np.errstate(over="ignore"):
            while filled < size:
                step = out[filled - 1] * base
                out[filled : 2 * filled] = out[:filled] * step
                filled *= 2
        _powers[kind] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """Words of many texts: hash, byte span and text number of each, in order.

    data: the joined UTF-8 bytes (lower-cased A-Z if asked), a zero byte after each text.
    first: the index of each text's first word, one more entry at the end.
    """

    def __init__(self, texts: list[str | None], rule: str, lower: bool = False, hashes: bool = True):
        parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        data = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data, ends = data, np.cumsum(sizes + 1)
        inside = WORD_BYTES[rule][data]
        inside[ends[sizes >= 0] - 1] = False
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        self.count = np.diff(self.first)
        if hashes:
            with np.errstate(over="ignore"):
                acc = np.empty(len(data) + 1, dtype=np.uint64)
                acc[0] = 0
                np.cumsum(BYTE_VALUES[data] * _power("up", BASE, len(data)), out=acc[1:])
                self.hash = mix((acc[self.end] - acc[self.start]) * _power("down", BASE_INV, len(data))[self.start])

    def text_of(self, word_from: int, word_to: int) -> list[bytes]:
        d = self.data
        return [d[s:e].tobytes() for s, e in zip(self.start[word_from:word_to], self.end[word_from:word_to])]


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive words from each index; the last n-1 indices have none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, dtype=np.uint64)
        for k in range(n):
            out *= GRAM
            out += words[k : k + m]
    return mix(out)


def pieces(batches, rows: int = 512):
    """Batches in pieces of a few rows, so that Python holds few texts at a time; freed memory goes back between batches."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()
        if trim is not None:
            trim(0)


def slices(texts: list[str | None], most: int = 2 << 20):
    """(from, to) of runs of texts with about `most` characters, so that arrays stay bounded."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)
