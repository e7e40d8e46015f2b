"""Removal of lines that several documents share, by a sharded minimal perfect hash.

Lines are normalised and hashed to 128 bits in the JVM and pre-aggregated by key, so a line that
a third of all documents hold is one row a task. The keys found in two documents or more are cut
into shards of bounded size; each becomes a minimal perfect hash (levels of bit arrays) over
arrays of fingerprints, keepers and counts. Documents probe those arrays. An index below
`broadcast_bytes` goes to every executor and texts are never shuffled; a larger one stays
distributed, and hashes of lines are routed to its shards.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphion.llm.common import carry, durable, extended, mix, pieces, restore, table

STRIPPED = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = 2**63 - 1
GAMMA, LEVELS = 2, 40


def _mixed(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h1 + mix(h2) * np.uint64(3))


def _seat(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys + np.uint64(level + 1) * np.uint64(0xA0761D6478BD642F)) % np.uint64(size)).astype(np.int64)


def build_shard(h1: np.ndarray, h2: np.ndarray, keeper: np.ndarray, count: np.ndarray) -> bytes:
    """One shard of the index. Keys that still collide after the last level lie in a sorted rest."""
    keys, left, bits, order = _mixed(h1, h2), np.arange(len(h1)), [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, GAMMA * len(left))
        seat = _seat(keys[left], level, size)
        alone = np.bincount(seat, minlength=size)[seat] == 1
        mask = np.zeros(size, dtype=bool)
        mask[seat[alone]] = True
        bits.append(mask)
        order.append(left[alone][np.argsort(seat[alone], kind="stable")])
        left = left[~alone]
    left = left[np.lexsort((h2[left], h1[left]))]
    at = np.concatenate([*order, left]).astype(np.int64) if len(h1) else np.empty(0, np.int64)
    head = struct.pack(f"<III{len(bits)}I", len(h1), len(left), len(bits), *map(len, bits))
    body = [np.packbits(b).tobytes() for b in bits] + [h1[left].tobytes(), h2[at].tobytes(), keeper[at].tobytes(), count[at].astype(np.int32).tobytes()]
    return head + b"".join(body)


class Shard:
    """A shard as arrays; find() gives the index of each key, or -1."""

    def __init__(self, blob: bytes):
        n, rest, levels = struct.unpack_from("<III", blob)
        sizes = struct.unpack_from(f"<{levels}I", blob, 12)
        at = 12 + 4 * levels
        self.bits, self.base, seen = [], [], 0
        for size in sizes:
            mask = np.unpackbits(np.frombuffer(blob, np.uint8, (size + 7) // 8, at), count=size).astype(bool)
            self.bits.append(mask)
            self.base.append((np.cumsum(mask) - 1 + seen).astype(np.int32))
            seen, at = seen + int(mask.sum()), at + (size + 7) // 8
        self.rest_from, self.rest = seen, np.frombuffer(blob, np.uint64, rest, at)
        at += 8 * rest
        self.mark = np.frombuffer(blob, np.uint64, n, at)
        self.keeper = np.frombuffer(blob, np.int64, n, at + 8 * n)
        self.count = np.frombuffer(blob, np.int32, n, at + 16 * n)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, todo, keys = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1)), _mixed(h1, h2)
        for level, mask in enumerate(self.bits):
            seat = _seat(keys[todo], level, len(mask))
            here = mask[seat]
            out[todo[here]] = self.base[level][seat[here]]
            todo = todo[~here]
        out[out >= 0] = np.where(self.mark[out[out >= 0]] == h2[out >= 0], out[out >= 0], -1)
        for i in todo if len(self.rest) else ():
            lo, hi = np.searchsorted(self.rest, h1[i], "left"), np.searchsorted(self.rest, h1[i], "right")
            for j in range(lo, hi):
                if self.mark[self.rest_from + j] == h2[i]:
                    out[i] = self.rest_from + j
        return out


def line_keys(text: Column) -> Column:
    """The normalised lines of a text."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.translate(F.btrim(x, F.lit(STRIPPED)), UPPER, LOWER))


def _hashes(docs: DataFrame, least: int) -> DataFrame:
    """docs with _keys: a hash pair for each line; null where the line is too short to be judged."""
    pair = lambda x: F.when(F.length(x) >= least, F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(71)).alias("b")))
    return docs.withColumn("_keys", F.transform(line_keys(F.col("text")), pair))


def build_index(docs: DataFrame, least: int = 10, keys_a_shard: int = 1 << 16) -> tuple[DataFrame, int, int]:
    """(rows shard, blob), number of shards, number of keys."""
    who = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    lines = _hashes(docs.select("doc_id", "text"), least).select(who.alias("doc"), F.explode(F.array_distinct("_keys")).alias("k")).where("k is not null")
    shared = lines.groupBy(F.col("k.a").alias("a"), F.col("k.b").alias("b")).agg(F.min("doc").alias("keeper"), F.max("doc").alias("_last"), F.count("*").alias("n"))
    shared = durable(shared.where("keeper < _last").drop("_last"))
    total = shared.count()
    shards = max(1, -(-total // keys_a_shard))

    def build(pdf):
        blob = build_shard(*(pdf[c].to_numpy().view(np.uint64) for c in ("a", "b")), pdf["keeper"].to_numpy(), pdf["n"].to_numpy())
        return type(pdf)({"shard": [int(pdf["shard"].iloc[0])], "blob": [blob]})

    index = shared.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, blob binary")
    return durable(index), shards, total


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an array-of-struct column: row and hashes of the lines that have some, and their flat index; null lines are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, flat = np.asarray(column.offsets), column.values
    flat = flat.slice(0, offsets[-1])
    rows = np.repeat(np.arange(len(column)), np.diff(offsets))
    at = np.flatnonzero(np.asarray(flat.is_valid())[offsets[0] : offsets[-1]]) + offsets[0]
    a, b = (np.asarray(flat.field(i).fill_null(0)).astype(np.int64).view(np.uint64)[at] for i in (0, 1))
    return rows[at - offsets[0]], a, b, at - offsets[0]


def _rewritten(texts: list, dropped_at: list[list[int]]) -> tuple[list, list, list]:
    out, n_lines, n_dropped = [], [], []
    for text, gone in zip(texts, dropped_at):
        n_lines.append((text or "").count("\n") + 1)
        n_dropped.append(len(gone))
        if gone:
            gone = set(gone)
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        out.append(text)
    return out, n_lines, n_dropped


def _replaced(batch: pa.RecordBatch, texts: list, n_lines: list, n_dropped: list, without: str) -> pa.RecordBatch:
    named = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != without}
    named |= {"text": pa.array(texts, pa.string()), "_n_lines": pa.array(n_lines, pa.int64()), "_n_dropped": pa.array(n_dropped, pa.int64())}
    return pa.RecordBatch.from_pydict(named)


def dedup_lines(docs: DataFrame, least: int = 10, broadcast_bytes: int = 64 << 20, probes_a_task: int = 200_000) -> DataFrame:
    """docs with text less its repeated lines, and _n_lines (before) and _n_dropped.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of
    `least` code points or more that two documents hold lose their lines everywhere but in the
    smallest doc_id. A null text counts as one empty line and stays null. Null ids count as one
    document after all others; rows with one id count as one document. Other columns stay.
    """
    index, shards, total = build_index(docs, least)
    size = index.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0))).first()[0]
    work = carry(docs, "doc_id", "text")
    hashed = _hashes(work, least)
    fields = extended(work.schema, "_n_lines bigint, _n_dropped bigint")
    back = ("text", "_n_lines", "_n_dropped")
    if size <= broadcast_bytes:
        held = docs.sparkSession.sparkContext.broadcast({r["shard"]: r["blob"] for r in index.collect()})
        loaded: dict[int, Shard] = {}

        def probe(batches):
            for s, blob in held.value.items():
                if s not in loaded:
                    loaded[s] = Shard(blob)
            for batch in pieces(batches):
                rows, a, b, at = _flat(batch.column("_keys"))
                ids = np.asarray(batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID))[rows]
                gone = np.zeros(len(rows), dtype=bool)
                part = (a.view(np.int64) % shards).astype(np.int64)
                for s, shard in loaded.items():
                    mine = np.flatnonzero(part == s)
                    found = shard.find(a[mine], b[mine])
                    hit = found >= 0
                    gone[mine[hit]] = shard.keeper[found[hit]] != ids[mine[hit]]
                first = np.concatenate([[0], np.cumsum(np.diff(np.asarray(batch.column("_keys").offsets)))])
                drops: list[list[int]] = [[] for _ in range(batch.num_rows)]
                for r, i in zip(rows[gone].tolist(), at[gone].tolist()):
                    drops[r].append(i - int(first[r]))
                yield _replaced(batch, *_rewritten(batch.column("text").to_pylist(), drops), "_keys")

        return restore(hashed.mapInArrow(probe, fields), docs, *back)

    # routed: only hashes travel; crowded shards are copied to as many tasks as their probes need
    who = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    key = hashed.withColumns({"_who": who, "_text": F.xxhash64("text")})
    probes = key.select("_who", "_text", F.posexplode("_keys").alias("line", "k")).where("k is not null")
    probes = probes.select("_who", "_text", "line", F.col("k.a").alias("a"), F.col("k.b").alias("b"), F.pmod("k.a", F.lit(shards)).cast("int").alias("shard"))
    load = index.join(probes.groupBy("shard").agg(F.ceil(F.count("*") / probes_a_task).cast("int").alias("copies")), "shard")
    spread = load.select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), "blob")
    crowd = probes.join(load.select("shard", "copies"), "shard").withColumn("salt", F.pmod(F.xxhash64("_who", "line"), F.col("copies")).cast("int"))
    both = spread.select("shard", "salt", F.lit(0).cast("long").alias("_who"), F.lit(0).cast("long").alias("_text"), F.lit(-1).alias("line"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "blob")
    both = both.unionByName(crowd.select("shard", "salt", "_who", "_text", "line", "a", "b", F.lit(None).cast("binary").alias("blob")))

    def look_up(batches):
        now, shard = None, None
        for pdf in batches:
            for at, part in pdf.groupby(["shard", "salt"], sort=False):
                head = part[part["line"] < 0]
                if at != now:
                    now, shard = at, Shard(head["blob"].iloc[0])
                part = part[part["line"] >= 0]
                found = shard.find(*(part[c].to_numpy().view(np.uint64) for c in "ab"))
                hit = found >= 0
                hit[hit] = shard.keeper[found[hit]] != part["_who"].to_numpy()[hit].astype(np.int64)
                yield part.loc[hit, ["_who", "_text", "line"]].astype("int64")

    dropped = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "line").mapInPandas(look_up, "_who long, _text long, line long")
    dropped = dropped.groupBy("_who", "_text").agg(F.collect_set("line").alias("_gone"))
    joined = key.drop("_keys").join(dropped, ["_who", "_text"], "left").drop("_who", "_text")

    def cut(batches):
        for batch in pieces(batches):
            gone = [x or [] for x in batch.column("_gone").to_pylist()]
            yield _replaced(batch, *_rewritten(batch.column("text").to_pylist(), gone), "_gone")

    return restore(joined.select(*work.columns, "_gone").mapInArrow(cut, fields), docs, *back)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines less those that an earlier document holds."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_STRIP_SQL = "trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"
ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, n, x, translate({_STRIP_SQL}, '{UPPER}', '{LOWER}') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)),
shared AS (SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT l.*, s.keeper IS NOT NULL AND s.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
