"""Removal of repeated passages by suffix automata over reference shards.

Only stretches that may repeat are looked at. The least hash of the 8-word grams in a window is the
window's anchor, and equal windows have equal anchors; a window can repeat only if its anchor does.
Stretches that share an anchor form the reference: a suffix automaton is built of them, whose states
know their earliest occurrence, and the stretches are streamed through it. Where the matching
statistic reaches the window length, the earliest occurrence tells whether the window goes. Every
window that goes is judged so, in up to three rounds, each of which sends on only what is left:
among a few hundred documents inside a task, so that a passage that a third of all documents hold
leaves each task once; then, for anchors that are still in very many stretches, among some two
thousand stretches each; then among all stretches of an anchor, which are dealt by anchor to
reference shards of bounded size.

A shard's automaton isn't sent to all documents, since the reference is the corpus itself and
grows with it; the stretches come to the automaton instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphion.llm.common import Scratch, Words, gram_hash, pieces, slices, spread_join, table, wanted_only

WINDOW, GRAM = 20, 8
SPAN = WINDOW - GRAM + 1  # grams in a window
PLACE = np.uint64(2**26 - 1)
NO_ID = 2**63 - 1
REFERENCE_WORDS = 50_000
CROWD = 2000  # stretches of an anchor that are judged together before the last round


def anchors(words: np.ndarray, step: int = int(PLACE)) -> np.ndarray:
    """Of each window of the word hashes, in order, the index of its anchor gram: the least hash, leftmost of equal ones.

    Long texts go by overlapping steps, since a place has as many bits as the key can spare.
    """
    grams = gram_hash(words, GRAM)
    parts = [np.empty(0, dtype=np.int64)]
    for a in range(0, len(grams) - SPAN + 1, step - SPAN + 1):
        parts.append(_anchors(grams[a : a + step]) + a)
    return np.concatenate(parts)


def _anchors(grams: np.ndarray) -> np.ndarray:
    key = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, low = 1, key
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SPAN - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    return (low & PLACE).astype(np.int64)


def runs(mask: np.ndarray) -> np.ndarray:
    """Beginnings and ends of the runs of true values, alternating."""
    padded = np.concatenate([[False], mask, [False]])
    return np.flatnonzero(padded[1:] != padded[:-1]).astype(np.int32)


def spread(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n words the windows from these starts cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def settle(texts: list[str | None], ids: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: words, runs covered by windows that begin earlier among these texts, and the anchors of the rest (hash, word)."""
    w = Words(texts, "space")
    n = len(w.hash) - WINDOW + 1
    doc = np.repeat(np.arange(len(texts)), w.count)
    at = head = np.empty(0, np.int64)
    gone = np.zeros(max(n, 0), dtype=bool)
    if n > 0:
        start = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
        anchor = anchors(w.hash)[start]
        grams = gram_hash(w.hash, GRAM).view(np.int64)
        at = np.unique(anchor)
        value, which, times = np.unique(grams[at], return_inverse=True, return_counts=True)
        met = at[times[which] > 1]
        if len(met):
            low, high = start[np.searchsorted(anchor, met, "left")], start[np.searchsorted(anchor, met, "right") - 1] + 1
            data, order = w.data.tobytes(), np.argsort(grams[met], kind="stable")
            i = doc[low]
            keys = zip(*(x[order].tolist() for x in (grams[met], ids[i], i, low - w.first[i], w.start[low], w.end[high + WINDOW - 2])))
            for k, a, b in judged((h, d, r, s, data[x:y]) for h, d, r, s, x, y in keys):
                gone[w.first[k] + a : w.first[k] + b - WINDOW + 1] = True
            at = np.unique(anchor[~gone[start]])
        head = grams[at]
    covered = spread(np.flatnonzero(gone), len(doc)) if len(doc) else np.empty(0, bool)
    cut = np.searchsorted(at, w.first)
    out = []
    for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
        mine = slice(cut[i], cut[i + 1])
        out.append((int(b - a), runs(covered[a:b]), head[mine], (at[mine] - a).astype(np.int32)))
    return out


def _seen(batches):
    pack = zstandard.ZstdCompressor(level=3)
    for batch in pieces(batches):
        ids = np.asarray(batch.column("doc_id").fill_null(NO_ID))
        texts = batch.column("text").to_pylist()
        found, packed = [], []
        for a, b in slices(texts):
            found += settle(texts[a:b], ids[a:b])
            packed += [None if t is None else pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts[a:b]]
        n, gone, head, at = ([f[k] for f in found] for k in range(4))
        cols = [
            batch.column("_row"), batch.column("doc_id"), pa.array(packed, pa.binary()), pa.array(n, pa.int64()),
            pa.array(gone, pa.list_(pa.int32())), pa.array(head, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["_row", "doc_id", "packed", "n", "gone", "head", "at"])


STRETCH = np.dtype([("head", "<i8"), ("part", "<i4"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i4"), ("bytes", "<i4")])


def _stretches(shards: int):
    """For each hit, the words of all windows left whose anchor it is; packed by shard, so that they compress.

    hits: the anchor's word and the part of its crowd (0 but for crowded anchors before the last
    round). cut: words covered by windows that are gone; those windows are left out.
    """

    def run(batches):
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for batch in pieces(batches):
            parts: dict[int, tuple[list, list]] = {}
            rows, ids = batch.column("_row").to_pylist(), batch.column("doc_id").fill_null(NO_ID).to_pylist()
            for row, doc, packed, hits, cut in zip(rows, ids, batch.column("packed"), batch.column("hits").to_pylist(), batch.column("cut").to_pylist()):
                w = Words([unpack.decompress(packed.as_py()).decode("utf-8", "surrogatepass")], "space")
                anchor, grams = anchors(w.hash), gram_hash(w.hash, GRAM).view(np.int64)
                left = np.ones(len(anchor), dtype=bool)
                for c in cut or ():
                    left[c["a"] : c["b"] - WINDOW + 1] = False
                data = w.data.tobytes()
                for hit in sorted(hits, key=lambda h: h["at"]):
                    a, b = np.searchsorted(anchor, hit["at"], "left"), np.searchsorted(anchor, hit["at"], "right")
                    head = int(grams[hit["at"]])
                    keys, words = parts.setdefault((head ^ (hit["part"] * 0x9E3779B97F4A7C15)) % shards, ([], []))
                    for x, y in runs(left[a:b]).reshape(-1, 2).tolist():
                        low, high = int(w.start[a + x]), int(w.end[a + y + WINDOW - 2])
                        keys.append((head, hit["part"], doc, row, int(a) + x, high - low))
                        words.append(data[low:high])
            parts = {k: v for k, v in parts.items() if v[0]}
            cols = [list(parts), [pack.compress(np.array(k, dtype=STRETCH).tobytes()) for k, _ in parts.values()], [pack.compress(b"".join(t)) for _, t in parts.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()))], names=["shard", "keys", "words"])

    return run


class Automaton:
    """A suffix automaton of several word sequences. first: of each state the least end (document, word) of its strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [None]

    def add(self, words: list, ends: list) -> None:
        nxt, link, size, first = self.next, self.link, self.size, self.first
        last = 0
        for c, end in zip(words, ends):
            q = nxt[last].get(c)
            if q is not None and size[q] == size[last] + 1:
                last = q
                if end < first[q]:
                    first[q] = end
                continue
            if q is None:
                now = len(nxt)
                nxt.append({}), link.append(0), size.append(size[last] + 1), first.append(end)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = now
                    p = link[p]
                if p >= 0:
                    link[now] = self._split(p, c, nxt[p][c], end)
                last = now
            else:
                last = self._split(last, c, q, end)

    def _split(self, p: int, c, q: int, end) -> int:
        nxt, link, size, first = self.next, self.link, self.size, self.first
        if size[q] == size[p] + 1:
            if end < first[q]:
                first[q] = end
            return q
        twin = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), size.append(size[p] + 1), first.append(min(first[q], end))
        link[q] = twin
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        return twin

    def close(self) -> None:
        """Hands earliest ends up the suffix links."""
        for v in sorted(range(1, len(self.next)), key=self.size.__getitem__, reverse=True):
            u = self.link[v]
            if u > 0 and self.first[v] < self.first[u]:
                self.first[u] = self.first[v]

    def earliest(self, words: list, length: int) -> list:
        """For each word, the earliest end of the `length` words that end there, or None where the match is shorter."""
        nxt, link, size, first = self.next, self.link, self.size, self.first
        out, at, matched = [], 0, 0
        for c in words:
            while at and c not in nxt[at]:
                at = link[at]
                matched = size[at]
            if c in nxt[at]:
                at, matched = nxt[at][c], matched + 1
            while at and size[link[at]] >= length:
                at = link[at]
                matched = size[at]
            out.append(first[at] if matched >= length else None)
        return out


def judge(stretches: list[tuple[int, int, int, bytes]]):
    """(row, from, to): words covered by windows that begin earlier elsewhere. stretches: (doc, row, start, words) that share anchors."""
    held: dict[bytes, list] = {}
    for doc, row, start, words in stretches:
        held.setdefault(b" ".join(words.split()), []).append(((doc << 32) + start, row))  # places in order of document, then word
    machine = Automaton()
    split = {text: text.split(b" ") for text in held}
    for text, places in held.items():
        first = min(places)[0]
        machine.add(split[text], range(first, first + len(split[text])))
    machine.close()
    for text, places in held.items():
        ends = machine.earliest(split[text], WINDOW)
        for first, row in places:
            start, since = first & (2**32 - 1), None
            for k in range(WINDOW - 1, len(ends)):
                if ends[k] is not None and ends[k] < first + k:
                    if since is None:
                        since = start + k - WINDOW + 1
                elif since is not None:
                    yield row, since, start + k
                    since = None
            if since is not None:
                yield row, since, start + len(ends)


def judged(stretches):
    """What judge finds among stretches (head, doc, row, start, words), which come by head; several heads share an automaton up to REFERENCE_WORDS."""
    group, size, last = [], 0, None
    for head, *stretch in stretches:
        if size >= REFERENCE_WORDS and head != last:
            yield from judge(group)
            group, size = [], 0
        group.append(stretch)
        size += len(stretch[3]) // 6
        last = head
    if group:
        yield from judge(group)


def _judge_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    unpack = zstandard.ZstdDecompressor()
    keys = np.concatenate([np.frombuffer(unpack.decompress(k), dtype=STRETCH) for k in pdf["keys"]])
    words = b"".join(unpack.decompress(k) for k in pdf["words"])
    end = np.cumsum(keys["bytes"], dtype=np.int64)
    order = np.lexsort((keys["part"], keys["head"]))
    cols = [keys[c][order].tolist() for c in ("head", "part", "doc", "row", "start")]
    spans = zip((end - keys["bytes"])[order].tolist(), end[order].tolist())
    found = list(judged(((h, p), d, r, s, words[x:y]) for h, p, d, r, s, (x, y) in zip(*cols, spans)))
    return pd.DataFrame(np.array(found, dtype=np.int64).reshape(-1, 3), columns=["_row", "a", "b"])


def _kept(batches):
    unpack = zstandard.ZstdDecompressor()
    for batch in pieces(batches):
        out, removed = [], []
        for packed, gone, cut in zip(batch.column("packed"), batch.column("gone").to_pylist(), batch.column("cut").to_pylist()):
            text = packed.as_py()
            kept = [] if text is None else unpack.decompress(text).split()  # bytes are split at ASCII white space, as Words does
            mask = np.zeros(len(kept), dtype=bool)
            for a, b in [*zip((gone or [])[0::2], (gone or [])[1::2]), *((c["a"], c["b"]) for c in cut or [])]:
                mask[a:b] = True
            if mask.any():
                kept = [x for x, m in zip(kept, mask.tolist()) if not m]
            out.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            removed.append(int(mask.sum()))
        cols = [batch.column("_row"), batch.column("doc_id"), batch.column("n"), pa.array(removed, pa.int64()), pa.array(out, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=["_row", "doc_id", "n_words", "n_removed", "kept"])


def dedup_substrings(docs: DataFrame, hits_a_shard: int = 60_000, crowd: int = CROWD) -> DataFrame:
    """_row, doc_id, n_words, n_removed and kept (the words left, joined by one space) of each document.

    Words are what ASCII white space leaves, unchanged. Each word covered by a window of 20 words
    whose sequence also begins earlier (smaller doc_id, or same doc_id and earlier word) goes.
    Windows are judged on the input. Null texts have no words. Null ids come after all others as
    one document; rows that share an id are one document too, in which equal starts don't count
    as earlier.
    """
    scratch = Scratch()
    rows = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("_row", F.monotonically_increasing_id())
    seen = scratch.durable(rows.mapInArrow(_seen, "_row long, doc_id long, packed binary, n long, gone array<int>, head array<long>, at array<int>"))
    each = seen.select("_row", F.explode(F.arrays_zip("head", "at")).alias("x")).select("_row", "x.head", "x.at")
    counts = scratch.durable(each.groupBy("head").agg(F.count("*").alias("n")).where("n > 1"))
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    again = spread_join(each, counts, "head", F.col("_row"), counts, total)
    part = F.when(F.col("n") > crowd, 1 + F.pmod(F.xxhash64("_row"), F.ceil(F.col("n") / crowd))).otherwise(0).cast("int")
    hits = scratch.durable(again.groupBy("_row").agg(F.collect_list(F.struct("at", part.alias("part"))).alias("hits")))
    texts = seen.select("_row", "doc_id", "packed")
    found = [_judged(hits.select("_row", F.filter("hits", lambda h: h["part"] > 0).alias("hits")).where("size(hits) > 0"), texts, None, total, hits_a_shard, scratch)] if (most or 0) > crowd else []
    last = hits.select("_row", F.transform("hits", lambda h: F.struct(h["at"].alias("at"), F.lit(0).alias("part"))).alias("hits"))
    found.append(_judged(last, texts, found[0] if found else None, total, hits_a_shard, scratch))
    gone = found[0] if len(found) == 1 else found[0].unionByName(found[1]).groupBy("_row").agg(F.flatten(F.collect_list("cut")).alias("cut"))
    scratch.drop(counts, hits)  # the texts stay for the result, which is made of them when it is read
    met, rest = _parted(seen.select("_row", "doc_id", "packed", "n", "gone"), gone)
    kept = met.join(gone, "_row", "left").unionByName(rest, allowMissingColumns=True)
    return kept.mapInArrow(_kept, "_row long, doc_id long, n_words long, n_removed long, kept string")


def _parted(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose _row may be among keys, and the others, which need no shuffle to meet them."""
    marked = keys.select(F.xxhash64("_row").alias("_h"))
    rows = rows.withColumn("_h", F.xxhash64("_row"))
    return tuple(wanted_only(rows, marked, "_h", others=o).drop("_h") for o in (False, True))


def _judged(hits: DataFrame, texts: DataFrame, gone: DataFrame | None, total: int, hits_a_shard: int, scratch: Scratch) -> DataFrame:
    """_row, cut: words covered by windows that begin earlier among the stretches of their anchor and part."""
    shards = max(1, -(-total // hits_a_shard))
    own = hits.join(_parted(texts, hits)[0], "_row")
    own = own.withColumn("cut", F.lit(None).cast("array<struct<a:bigint,b:bigint>>")) if gone is None else own.join(gone, "_row", "left")
    dealt = own.select("_row", "doc_id", "packed", "hits", "cut").mapInArrow(_stretches(shards), "shard int, keys binary, words binary")
    found = dealt.groupBy("shard").applyInPandas(_judge_shard, "_row long, a long, b long")
    return scratch.durable(found.groupBy("_row").agg(F.collect_list(F.struct("a", "b")).alias("cut")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that occur earlier."""
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
judged AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS gone FROM win),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM judged WHERE gone),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
marked AS (SELECT words.doc_id, words.p, x, covered.p IS NOT NULL AS gone FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id AND words.p = covered.p),
kept AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
