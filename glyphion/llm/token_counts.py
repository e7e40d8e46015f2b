"""Token counts of documents in flat token files without an index.

A file is a run of fixed-width token ids in which an end-of-document id follows each document. It
is read in blocks that know nothing of documents. A vectorised search finds the end ids of each
block; a prefix scan over the blocks' sizes and last end positions then gives, for every end id,
where the document began, be it many blocks before.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphion.llm.common import pieces, slices, table

BLOCK_TOKENS = 1 << 18


def read_blocks(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, data: flat token files (each below 2 GB) in blocks of block_tokens ids of `width` bytes."""
    step = width * block_tokens
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", F.col("length"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step)))).alias("block")
    return files.select("file", at, "content").select("file", "block", F.expr(f"substring(content, cast(block * {step} + 1 as int), {step})").alias("data"))


def _ends(data: bytes, end_id: int, width: int) -> tuple[int, np.ndarray]:
    ids = np.frombuffer(data, dtype={2: "<u2", 4: "<u4"}[width])
    return len(ids), np.flatnonzero(ids == end_id).astype(np.int32)


def scan_blocks(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """Size and end positions of each block, besides the block's other columns."""
    kept = [f for f in blocks.schema if f.name != "data"]
    names = [f.name for f in kept]

    def scan(batches):
        for batch in pieces(batches):
            found = [_ends(d, end_id, width) for d in batch.column(batch.schema.get_field_index("data")).to_pylist()]
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            cols += [pa.array([n for n, _ in found], pa.int64()), pa.array([e for _, e in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "size", "ends"])

    return blocks.mapInArrow(scan, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", size long, ends array<int>")


def stitch(scanned: DataFrame) -> DataFrame:
    """Adds to blocks (file, block, size, ends) where they begin and the last end before them (-1: none)."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = scanned.withColumn("_begin", F.coalesce(F.sum("size").over(before), F.lit(0)))
    last = begun.withColumn("_last", F.when(F.size("ends") > 0, F.col("_begin") + F.element_at("ends", -1)))
    return last.withColumn("_before", F.coalesce(F.max("_last").over(before), F.lit(-1).cast("long"))).drop("_last")


def count_tokens(scanned: DataFrame) -> DataFrame:
    """file, block, ordinal (in the block), start (of the document in the file) and n_tokens, a row for each end id.

    Tokens after a file's last end id belong to no document. A file without any gives no row.
    """
    ends = stitch(scanned).select("*", F.posexplode("ends").alias("ordinal", "_end"))
    start = F.when(F.col("ordinal") == 0, F.col("_before")).otherwise(F.col("_begin") + F.get("ends", F.col("ordinal") - 1)) + 1
    return ends.withColumn("start", start).withColumn("n_tokens", F.col("_begin") + F.col("_end") - F.col("start")).drop("ends", "_end", "_begin", "_before", "size")


_encoders: dict = {}


def encoder(ranks: dict[bytes, int], pattern: str, key: str):
    if key not in _encoders:
        import tiktoken

        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def flat_blocks(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Texts as flat token files, one a partition: file, block, data, and doc_ids of the documents that end in the block.

    Null texts have no tokens, only the end id. doc_ids is the sidecar list by which counts find
    their documents; the token data itself has no index.
    """
    held = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def write(batches):
        from pyspark import TaskContext

        file, block, ids, ended, room = f"part-{TaskContext.get().partitionId():06d}", 0, [], [], 0

        def flushed(last):
            nonlocal block, ids, ended, room
            flat = np.concatenate(ids) if ids else np.empty(0, np.uint16)
            ends, at, out = np.array([e for _, e in ended], dtype=np.int64), 0, []
            while len(flat) - at >= block_tokens or (last and at < len(flat)):
                to = min(at + block_tokens, len(flat))
                mine = range(*np.searchsorted(ends, [at, to]).tolist())
                out.append((file, block, flat[at:to].tobytes(), [ended[i][0] for i in mine]))
                block, at = block + 1, to
            ids, room = [flat[at:]], len(flat) - at
            ended = [(d, e - at) for d, e in ended if e >= at]
            return out

        def batch_of(rows):
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            types = (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["file", "block", "data", "doc_ids"])

        encode = encoder(held.value, pattern, ranks_path).encode_ordinary
        for batch in pieces(batches):
            texts, who = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices(texts, 1 << 20):
                for i in range(a, b):
                    one = np.array([*(encode(texts[i]) if texts[i] else ()), end_id], dtype=np.uint16)
                    ids.append(one)
                    room += len(one)
                    ended.append((who[i], room - 1))
                if room >= block_tokens:
                    yield batch_of(flushed(False))
        yield batch_of(flushed(True))

    return docs.select("doc_id", "text").mapInArrow(write, "file string, block long, data binary, doc_ids array<long>")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by its end id in flat files of a byte-level BPE with 50,256 ranks."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks = flat_blocks(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)
    out = count_tokens(scan_blocks(blocks, 50256))
    return out.select(F.get("doc_ids", F.col("ordinal")).alias("doc_id"), "n_tokens", "file", "start")
