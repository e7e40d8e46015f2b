"""Benchmark decontamination with suffix arrays over shards of the training text.

Each slice of training text is a shard. Its suffix array holds the word suffixes that begin like
some test window (no other suffix can match), sorted by their first `window` words. Every test
suffix is binary-searched in every shard; the ranges give all verbatim occurrences, and runs on
one diagonal give the longest match and its place. The benchmark is handed out in blocks of a
checked size, one pass of the documents a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphion.llm.common import Scratch, Words, carry, extended, gram_hash, pieces, restore, slices, table

FILTER_BITS = 22


def _keys(words: np.ndarray, starts: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """The first `depth` words from each start as one byte string that sorts like the word sequence; zeros after stop."""
    out = np.zeros((len(starts), depth), dtype=">u8")
    for k in range(depth):
        at = starts + k
        ok = at < stop
        out[ok, k] = words[at[ok]]
    return out.view(f"S{8 * depth}").reshape(-1)


class TestSuffixes:
    """The windows of a block of test items, sorted, and filters on their leading words."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window, self.ids = window, [i for i, _ in items]
        w = Words([t for _, t in items], "alnum", lower=True)
        starts, stops, owner = [], [], []
        for i, (a, n) in enumerate(zip(w.first[:-1], w.count)):
            s = np.arange(a, a + max(0, n - window) + 1) if n else np.empty(0, np.int64)
            starts.append(s)
            stops.append(np.minimum(s + window, a + n))
            owner.append(np.full(len(s), i))
        empty = np.empty(0, np.int64)
        self.start = np.concatenate([empty, *starts]).astype(np.int64)
        stop = np.concatenate([empty, *stops]).astype(np.int64)
        self.owner = np.concatenate([empty, *owner]).astype(np.int64)
        self.length = stop - self.start
        self.at = self.start - w.first[self.owner] if len(self.owner) else self.start
        low = _keys(w.hash, self.start, stop, window)
        self.low = low
        high = np.full((len(low), window), 2**64 - 1, dtype=">u8")
        short = low.view(">u8").reshape(-1, window)
        for k in range(window):
            high[self.length > k, k] = short[self.length > k, k]
        self.high = high.view(f"S{8 * window}").reshape(-1)
        self.lead = {}
        for n in (1, 2, 3):
            mine = self.start[self.length == n] if n < 3 else self.start[self.length >= 3]
            if len(mine):
                g = np.unique(gram_hash(w.hash, n)[mine])
                seen = np.zeros(1 << FILTER_BITS, dtype=bool)
                seen[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
                self.lead[n] = (g, seen)

    def candidates(self, words: np.ndarray) -> np.ndarray:
        out = [np.empty(0, np.int64)]
        for n, (grams, seen) in self.lead.items():
            g = gram_hash(words, n)
            at = np.flatnonzero(seen[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            found = np.minimum(np.searchsorted(grams, g[at]), len(grams) - 1)
            out.append(at[grams[found] == g[at]])
        return np.unique(np.concatenate(out))

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list]]:
        """The index of each text's first word; which words are hit; of each text: items, longest match
        (words, its place, its item, its place there)."""
        w = Words(texts, "alnum", lower=True)
        docs = len(texts)
        suffix = self.candidates(w.hash) if len(self.start) else np.empty(0, np.int64)
        stop = w.first[1:][np.searchsorted(w.first, suffix, "right") - 1] if len(suffix) else suffix
        keys = _keys(w.hash, suffix, stop, self.window)
        order = np.argsort(keys, kind="stable")
        array, keys = suffix[order], keys[order]
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = np.maximum(hi - lo, 0)
        test = np.repeat(np.arange(len(n)), n)
        at = array[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)] if n.sum() else np.empty(0, np.int64)
        size = self.length[test] if len(test) else at
        edge = np.zeros(len(w.hash) + 1, dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        hit = np.cumsum(edge[:-1]) > 0
        out: list[list] = [[[], 0, -1, None, -1] for _ in range(docs)]
        if len(at):
            doc = np.searchsorted(w.first, at, "right") - 1
            owner, pos = self.owner[test], self.at[test]
            for d, o in np.unique(np.stack([doc, owner], 1), axis=0).tolist():
                out[d][0].append(self.ids[o])
            diagonal = at - pos
            by = np.lexsort((at, diagonal, owner, doc))
            d, o, g, p, s, q = doc[by], owner[by], diagonal[by], at[by], size[by], pos[by]
            new = np.ones(len(by), dtype=bool)
            new[1:] = (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | (g[1:] != g[:-1]) | (p[1:] != p[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(by)]]) - 1
            run = p[last] + s[last] - p[first]
            for k in np.lexsort((o[first], p[first], -run)).tolist():
                i, r = int(d[first[k]]), int(run[k])
                if r > out[i][1]:
                    out[i][1:] = [r, int(p[first[k]] - w.first[i]), self.ids[o[first[k]]], int(q[first[k]])]
        return w.first, hit, out


ADDED = {
    "_n_words": pa.int64(), "_n_hit": pa.int64(), "_items": pa.list_(pa.string()),
    "_longest": pa.int64(), "_longest_at": pa.int64(), "_longest_item": pa.string(), "_longest_item_at": pa.int64(), "_mask": pa.binary(),
}
ADDED_SQL = "_n_words bigint, _n_hit bigint, _items array<string>, _longest bigint, _longest_at bigint, _longest_item string, _longest_item_at bigint, _mask binary"


def test_blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """The benchmark in blocks of about block_bytes, each small enough to hand to every task."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "text"), F.lit(blocks)) == b)
        yield TestSuffixes([(r["i"] if r["i"] is not None else "", r["text"]) for r in part.collect()], window), b + 1 == blocks


def _merged(block: TestSuffixes, texts: list, before: list[tuple] | None, last: bool) -> list[list]:
    first, hit, found = block.search(texts)
    rows = []
    for i, (items, *longest) in enumerate(found):
        mine = hit[first[i] : first[i + 1]]
        if before:
            _, _, old_items, *old_longest, mask = before[i]
            mine = mine | np.unpackbits(np.frombuffer(mask, np.uint8), count=len(mine)).astype(bool)
            items = old_items + items
            longest = max(old_longest, longest, key=lambda x: (x[0], -x[1]))
        rows.append([len(mine), int(mine.sum()), sorted(set(items)), *longest, None if last else np.packbits(mine).tobytes()])
    return rows


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """docs with the columns of ADDED (but _mask): verbatim matches of benchmark (item_id, text) windows in text.

    Words are runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased. A window
    is `window` consecutive words of an item; an item of fewer words, but not none, is one window.
    Null texts have no words; null item ids count as ''; items with one id count as one. An empty
    benchmark hits nothing. Rows are judged one by one, so repeated rows get equal results.
    """
    out = work = carry(docs, "text")
    names, scratch, stored = work.columns, Scratch(), []
    for k, (block, last) in enumerate(test_blocks(benchmark, window, block_bytes)):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches, held=held, again=k > 0, last=last):
            for batch in pieces(batches):
                texts = batch.column(names.index("text")).to_pylist()
                old = list(zip(*(batch.column(len(names) + i).to_pylist() for i in range(len(ADDED))))) if again else None
                rows = [r for a, b in slices(texts) for r in _merged(held.value, texts[a:b], old[a:b] if old else None, last)]
                fresh = [pa.array([r[i] for r in rows], t) for i, t in enumerate(ADDED.values())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *fresh], names=[*names, *ADDED])

        out = out.mapInArrow(search, extended(work.schema, ADDED_SQL))
        if not last:  # one block of the benchmark at a time is out
            out = scratch.durable(out)
            scratch.drop(*stored)
            stored = [out]
            held.destroy()
    return restore(out, docs, *list(ADDED)[:-1])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without those in which a benchmark window occurs."""
    return find_benchmark(docs, benchmark, window).where("_n_hit = 0").select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    out = find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(TEXT, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.replace("TEXT", _LOWER)} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.replace("TEXT", _LOWER)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, CASE WHEN len(w) >= 10 THEN 10 ELSE len(w) END AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
