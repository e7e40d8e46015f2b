"""Near-duplicate join on word shingles: MinHash buckets, Bayesian pruning, exact verification.

Texts with equal shingle sets are one node. Nodes meet in the buckets of 32 bands of four MinHash
values (a pair at the threshold misses all of them with a chance below 1e-7). First each node meets
the pivots that it shares most buckets with, so that a group of n near copies makes O(n) pairs and
never n squared. Pairs compare MinHash values step by step and are dropped once the posterior chance
of reaching the threshold falls below the tolerance; the rest are verified on their whole texts.
Classes are the connected components of verified links.

A second round compares all pairs of different classes that share a bucket, two-member buckets
included. In buckets of few nodes the values compared first are the buckets themselves: how many of
them a pair shares decides whether its posterior chance is enough to go on. In larger buckets the
nodes outside the bucket's largest class meet all its nodes, block against block inside a task;
those with a competitive partner bring their texts to a second such task, which verifies them.

Both rounds leave out pairs within a class that need not be known to unite it. A third step counts
all links: every class with pairs that aren't verified brings its whole texts, block against block
inside a task, where all its pairs are compared exactly and each text's links are counted.

Signatures keep the low 16 bits of each MinHash value. Texts are never stored: those of surviving
pairs are fetched from docs by two 64-bit hashes of the text.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphion.llm.common import Scratch, Words, carry, gram_hash, mix, pieces, restore, slices, spread_join, table, wanted_only

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 8
SMALL = 8  # the largest bucket whose pairs are listed
PIVOTS = 2
BLOCK, BLOCK_BYTES = 2048, 8 << 20  # nodes and text bytes of a block
NO_ID = 2**63 - 1
_rng = np.random.default_rng(5)
MULTIPLY = _rng.integers(1, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
TEXT_KEY = ["t1", "t2"]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of five words; fewer words, but not none, are one shingle."""
    w = Words(texts, "space", lower=True)
    grams = gram_hash(w.hash, WORDS)
    out = []
    for a, n in zip(w.first[:-1].tolist(), w.count.tolist()):
        out.append(np.unique(grams[a : a + n - WORDS + 1] if n >= WORDS else gram_hash(w.hash[a : a + n], n) if n else grams[:0]))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least value of each hash function; unequal values agree in them once in 65,536 times."""
    low = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    x = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(x), 512):
        part = x[a : a + 512, None]
        with np.errstate(over="ignore"):
            h = part * MULTIPLY + ADD
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
        np.minimum(low, h.min(0), out=low)
    return low.astype(np.uint16)


def _least(log_chances, tolerance: float) -> int:
    """The least m whose posterior chance P(s >= threshold | m) under a flat prior reaches the tolerance; log_chances gives log P(m | s) for s on a grid."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    m = 0
    while True:
        log = log_chances(m, grid)
        p = np.exp(log - log.max())
        if p[grid >= THRESHOLD].sum() / p.sum() >= tolerance:
            return m
        m += 1


@functools.cache
def least_matches(tolerance: float) -> list[int]:
    """For 8, 16, ... compared values the least matches that keep a pair."""
    return [_least(lambda m, s, n=n: m * np.log(s) + (n - m) * np.log1p(-s), tolerance) for n in range(STEP, HASHES + 1, STEP)]


@functools.cache
def least_buckets(tolerance: float) -> int:
    """The least shared buckets, of BANDS, that keep a pair."""
    return max(1, _least(lambda m, s: m * ROWS * np.log(s) + (BANDS - m) * np.log1p(-(s**ROWS)), tolerance))


def _signed(docs: DataFrame) -> DataFrame:
    """Of each document: _row, doc_id, the two hashes of its text, the 128-bit key of its shingle set (null without words), signature, text bytes."""

    def run(batches):
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            k1, k2, sigs, size, seen = [], [], [], [], {}
            for a, b in slices(texts, 2 << 20):
                for text, s in zip(texts[a:b], shingle_sets(texts[a:b])):
                    if not len(s):
                        for c in (k1, k2, sigs, size):
                            c.append(None)
                        continue
                    with np.errstate(over="ignore"):
                        key = tuple(int(mix(s ^ np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for c in (1, 2))
                    first = key not in seen  # a copy in the same batch brings only its key
                    seen[key] = True
                    k1.append(key[0]), k2.append(key[1])
                    sigs.append(signature(s).tobytes() if first else None)
                    size.append(len(text))
            new = (pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(size, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "doc_id", *TEXT_KEY)), *new], names=["_row", "doc_id", *TEXT_KEY, "k1", "k2", "sig", "size"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), *text_key("text"), "text")
    return rows.mapInArrow(run, "_row long, doc_id long, t1 long, t2 long, k1 long, k2 long, sig binary, size long")


def text_key(column: str) -> list:
    return [F.xxhash64(column).alias("t1"), F.xxhash64(F.lit(1), column).alias("t2")]


def _bands(batches):
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in pieces(batches):
        sig = _signatures(batch.column("sig")).view(np.uint64)  # four values are one word
        bucket = mix(sig ^ salt).reshape(-1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.repeat(np.asarray(batch.column("node")), BANDS))], names=["bucket", "node"])


def shared_buckets(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """bucket, node, n and pivot of all buckets with several nodes (node, sig): their number and the least."""
    rows = nodes.select("node", "sig").mapInArrow(_bands, "bucket long, node long")
    crowds = scratch.durable(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1"))
    total = crowds.agg(F.sum("n")).first()[0] or 0
    held = scratch.durable(spread_join(rows, crowds, "bucket", F.col("node"), crowds.select("bucket", "n"), total))
    scratch.drop(crowds)
    return held


def proposed_pairs(held: DataFrame) -> DataFrame:
    """Pairs a < b: each node with the PIVOTS pivots that it shares most buckets with. The second round makes up for the rest."""
    met = held.where("node <> pivot").groupBy("node").agg(F.collect_list("pivot").alias("p"))  # one a band at most
    times = F.transform(F.array_distinct("p"), lambda x: F.struct((-F.size(F.filter("p", lambda y: y == x))).alias("n"), x.alias("a")))
    return met.select("node", F.explode(F.slice(F.array_sort(times), 1, PIVOTS)).alias("x")).select(F.col("x.a").alias("a"), F.col("node").alias("b"))


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, HASHES)


def competitive(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, keep: list[int]) -> np.ndarray:
    """Which pairs (x[i], y[j]) of signatures outlast the pruning."""
    left = np.arange(len(i))
    matches = np.zeros(len(i), dtype=np.int64)
    for k, least in enumerate(keep):
        part = slice(STEP * k, STEP * (k + 1))
        matches[left] += (x[i[left], part] == y[j[left], part]).sum(1)
        left = left[matches[left] >= least]
    return left


def _prune(tolerance: float):
    keep = least_matches(tolerance)

    def run(batches):
        for batch in pieces(batches, 4096):
            each = np.arange(batch.num_rows)
            left = pa.array(competitive(_signatures(batch.column("sig_a")), _signatures(batch.column("sig_b")), each, each, keep))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(left) for c in ("a", "b")], names=["a", "b"])

    return run


def _with_sides(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with the column of both nodes; a pivot of very many pairs is met in several tasks."""
    total = pairs.count()
    for own, other in (("a", "b"), ("b", "a")):
        side = nodes.select(F.col("node").alias(own), F.col(column).alias(f"{column}_{own}"))
        pairs = spread_join(pairs, side, own, F.col(other), pairs.groupBy(own).agg(F.count("*").alias("n")), total)
    return pairs


def pruned(pairs: DataFrame, nodes: DataFrame, tolerance: float) -> DataFrame:
    """Those of the stored pairs (a, b) that outlast the pruning."""
    return _with_sides(pairs, nodes, "sig").select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(tolerance), "a long, b long")


def _verify(batches):
    for batch in pieces(batches):
        held: dict[int, np.ndarray] = {}
        ok, chars = [], 0
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), batch.column("text_a"), batch.column("text_b")):
            if len(held) > 2000 or chars > 4 << 20:
                held, chars = {}, 0
            for node, text in ((a, x), (b, y)):
                if node not in held:
                    said = text.as_py()
                    held[node], chars = shingle_sets([said])[0], chars + len(said)
            s, t = held[a], held[b]
            both = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(both * 5 >= 4 * (len(s) + len(t) - both))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])


def fetched(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """node, text of the wanted nodes (node), from docs by the hashes of their texts."""
    keys = scratch.durable(wanted.distinct().join(nodes.select("node", *TEXT_KEY), "node"))
    rows = wanted_only(docs.where("text is not null").select(*text_key("text"), "text"), keys, "t1")
    # Always by merging: a plan that broadcasts few keys would not tell how it grows.
    return scratch.durable(rows.join(keys.hint("merge"), TEXT_KEY).groupBy("node").agg(F.first("text").alias("text")))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the stored pairs (a, b) whose whole texts (node, text) reach the threshold."""
    return _with_sides(pairs, texts, "text").select("a", "b", "text_a", "text_b").sortWithinPartitions("a").mapInArrow(_verify, "a long, b long")


def _least_neighbours(rows: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with m: the least v of each u."""
    low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return spread_join(rows, low.select("u", "m"), "u", F.col("v"), low.select("u", "n"), total)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for the nodes of links (a, b): the least node that it reaches. Alternates large and small stars."""
    edges = scratch.durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark, total = None, 2 * edges.count()
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.durable(_least_neighbours(both, total).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        scratch.drop(edges)
        joined = _least_neighbours(large, total)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(large.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        edges = scratch.durable(small)
        scratch.drop(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def shared(x: list[np.ndarray], y: list[np.ndarray], tile: int = 1024) -> np.ndarray:
    """How many shingles each set of x has in common with each set of y: products of 0-1 matrices."""
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    _, column = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    of_x = row < len(x)
    times = [np.bincount(column[side], minlength=int(column.max()) + 1) for side in (of_x, ~of_x)]
    common = (times[0] > 0) & (times[1] > 0)
    kept = common[column]
    row, column = row[kept], (np.cumsum(common) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    for at in range(0, int(common.sum()), tile):
        a, b = np.searchsorted(column, [at, at + tile])
        dense = np.zeros((len(x) + len(y), tile), dtype=np.float32)
        dense[row[a:b], column[a:b] - at] = 1
        out += dense[: len(x)] @ dense[len(x) :].T
    return out


def _apart(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of a task's two blocks, and which of their pairs are to be compared: of different classes, each once."""
    left, node, root = (np.asarray(group.column(c)) for c in ("left", "node", "root"))
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    both_minor = root[y] != np.asarray(group.column("big"))[y]
    once = ~both_minor[None, :] | (node[x][:, None] < node[y][None, :])
    return x, y, once & (root[x][:, None] != root[y][None, :])


def _survivors(tolerance: float):
    """A task of two blocks: its rows that have a competitive partner."""
    keep = least_matches(tolerance)

    def run(group: pa.Table) -> pa.Table:
        x, y, apart = _apart(group)
        sig, stay = _signatures(group.column("sig")), np.zeros(group.num_rows, dtype=bool)
        for at in range(0, len(x), 128):
            i, j = np.nonzero(apart[at : at + 128])
            i, j = x[at + i], y[j]
            left = competitive(sig, sig, i, j, keep)
            stay[i[left]] = stay[j[left]] = True
        return group.filter(pa.array(stay)).drop_columns(["sig"])

    return run


def _unite(group: pa.Table) -> pa.Table:
    """A task of two blocks: verified links that unite its classes, at most one for each class that is united."""
    x, y, apart = _apart(group)
    out: list[tuple[int, int]] = []
    if apart.any():
        node, root, texts = np.asarray(group.column("node")), np.asarray(group.column("root")), group.column("text")
        of_x, of_y = ([s for a in range(0, len(at), 64) for s in shingle_sets([texts[int(k)].as_py() for k in at[a : a + 64]])] for at in (x, y))
        size_x, size_y = (np.array([len(s) for s in z], dtype=np.int64) for z in (of_x, of_y))
        linked = apart & (shared(of_x, of_y).astype(np.int64) * 9 >= 4 * (size_x[:, None] + size_y[None, :]))
        over: dict[int, int] = {}

        def top(r: int) -> int:
            while r in over:
                r = over[r]
            return r

        for i, j in zip(*np.nonzero(linked)):
            p, q = int(x[i]), int(y[j])
            r, t = top(int(root[p])), top(int(root[q]))
            if r != t:
                over[max(r, t)] = min(r, t)
                out.append((min(node[p], node[q]), max(node[p], node[q])))
    return pa.table({c: pa.array([o[k] for o in out], pa.int64()) for k, c in enumerate("ab")})


def across_classes(docs: DataFrame, held: DataFrame, nodes: DataFrame, roots: DataFrame, done: DataFrame | None, tolerance: float, scratch: Scratch) -> DataFrame:
    """Links a, b that unite all classes (node, root) with a verified link between nodes that share a bucket. done: pairs compared before."""
    own = held.select("bucket", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(nodes.select("node", "size"), "node")
    own = scratch.durable(own)
    classes = own.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    crowds = classes.groupBy("bucket").agg(
        F.max_by("root", F.struct("c", "root")).alias("big"), F.sum("c").alias("_n"), F.max("c").alias("top"), F.sum("s").alias("bytes"), F.max_by("s", F.struct("c", "root")).alias("top_bytes"), F.count("*").alias("k")
    ).where("k > 1")
    block = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_BYTES), F.lit(1)).cast("int")
    crowds = crowds.select("bucket", "big", "_n", block(F.col("_n") - F.col("top"), F.col("bytes") - F.col("top_bytes")).alias("minor"), block(F.col("_n"), F.col("bytes")).alias("all"))
    crowds = scratch.durable(crowds)
    total = crowds.agg(F.sum("_n")).first()[0] or 0
    left = scratch.durable(spread_join(own, crowds.drop("_n"), "bucket", F.col("node"), crowds.select("bucket", F.col("_n").alias("n")), total))
    scratch.drop(own, crowds)

    order = Window.partitionBy("bucket").orderBy("node")
    before = F.array_compact(F.array(*(F.lag(F.struct("node", "root"), k).over(order) for k in range(1, SMALL))))
    few = left.where(F.col("n") <= SMALL).select("node", "root", before.alias("others")).select("node", "root", F.explode("others").alias("o"))
    few = few.where("o.root <> root").groupBy(F.col("o.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
    few = few.where(F.col("n") >= least_buckets(tolerance)).select("a", "b")  # pairs that also share a larger bucket are compared there
    few = scratch.durable(few if done is None else few.join(done, ["a", "b"], "left_anti"))
    few = scratch.durable(pruned(few, nodes, tolerance))

    many = left.where(F.col("n") > SMALL)
    hashed = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    upto = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    minor = many.where("root <> big").select("bucket", "node", "root", "big", F.lit(True).alias("left"), hashed("minor").alias("i"), upto("all").alias("j"))
    every = many.select("bucket", "node", "root", "big", F.lit(False).alias("left"), hashed("all").alias("j"), upto("minor").alias("i")).select(minor.columns)
    dealt = minor.unionByName(every).join(nodes.select("node", "sig"), "node")
    schema = "bucket long, node long, root long, big long, left boolean, i int, j int"
    stay = scratch.durable(dealt.select(*minor.columns, "sig").groupBy("bucket", "i", "j").applyInArrow(_survivors(tolerance), schema))
    texts = fetched(docs, nodes, few.select("a").union(few.select("b")).union(stay.select("node")).toDF("node"), scratch)
    links = stay.join(texts, "node").groupBy("bucket", "i", "j").applyInArrow(_unite, "a long, b long")
    return verified(few, texts).union(links).distinct()


def _counted(group: pa.Table) -> pa.Table:
    """A task of two blocks of a class, or of one with itself: how many texts of the other block each text is linked to."""
    left, node, texts = np.asarray(group.column("left")), np.asarray(group.column("node")), group.column("text")
    sides = [np.flatnonzero(left), np.flatnonzero(~left)]
    sets = [[s for a in range(0, len(at), 64) for s in shingle_sets([texts[int(k)].as_py() for k in at[a : a + 64]])] for at in sides]
    size_x, size_y = (np.array([len(s) for s in z], dtype=np.int64) for z in sets)
    linked_x, linked_y = (np.zeros(len(z), dtype=np.int64) for z in sets)
    if len(sides[0]) and len(sides[1]):
        linked = shared(*sets).astype(np.int64) * 9 >= 4 * (size_x[:, None] + size_y[None, :])
        linked_x, linked_y = linked.sum(1), linked.sum(0)
    elif len(sides[0]):
        value, times = np.unique(np.concatenate(sets[0]), return_counts=True)
        value = value[times > 1]  # a text's own shingles unite it with no other
        some = [s[np.isin(s, value, assume_unique=True)] for s in sets[0]]
        if len(value):
            linked = shared(some, some).astype(np.int64) * 9 >= 4 * (size_x[:, None] + size_x[None, :])
            np.fill_diagonal(linked, False)
            linked_x = linked.sum(1)
    return pa.table({"node": pa.array(np.concatenate([node[at] for at in sides])), "n": pa.array(np.concatenate([linked_x, linked_y]).astype(np.int64))})


def link_counts(docs: DataFrame, nodes: DataFrame, texts: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, n_links of the texts (node, root) with links (a, b): all the links of each.

    All links of a text lie in its class. A class whose pairs are all verified is done; the pairs
    of the others are compared on their whole texts, none left out. A pair of blocks is a task,
    and what leaves it are counts.
    """
    own = scratch.durable(texts.select("node", "root").join(nodes.select("node", "size"), "node"))
    links = scratch.durable(links)
    classes = own.groupBy("root").agg(F.count("*").alias("c"), F.sum("size").alias("s")).where("c > 2")
    known = links.join(own.select(F.col("node").alias("a"), "root"), "a").groupBy("root").agg(F.count("*").alias("k"))
    parts = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("s") / BLOCK_BYTES), F.lit(1)).cast("int").alias("parts")
    several = scratch.durable(classes.join(known, "root").where("k < c * (c - 1) / 2").select("root", "c", parts))
    total = several.agg(F.sum("c")).first()[0] or 0
    members = scratch.durable(spread_join(own.select("node", "root"), several.select("root", "parts"), "root", F.col("node"), several.select("root", F.col("c").alias("n")), total))
    dealt = members.withColumn("h", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("node", "root", F.least("h", "o").alias("i"), F.greatest("h", "o").alias("j"), (F.col("h") <= F.col("o")).alias("left"))
    said = fetched(docs, nodes, members.select("node"), scratch)
    counted = dealt.join(said, "node").groupBy("root", "i", "j").applyInArrow(_counted, "node long, n long")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).join(members.select("node"), "node", "left_anti").withColumn("n", F.lit(1).cast("long"))
    return scratch.durable(counted.unionByName(ends).groupBy("node").agg(F.sum("n").alias("n_links")))


def joined(docs: DataFrame, tolerance: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows of docs with their keys; k1, k2, root, copies, least row of each different text; the links a, b that unite texts; the texts' nodes."""
    seen = scratch.durable(_signed(docs))
    worded = seen.where("k1 is not null")
    least = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), *TEXT_KEY)
    texts = worded.groupBy("k1", "k2").agg(F.min("_row").alias("node"), F.count("*").alias("copies"), F.min(least).alias("least"))
    texts = scratch.durable(texts)
    nodes = scratch.durable(worded.select(F.col("_row").alias("node"), *TEXT_KEY, "sig", "size").join(texts.select("node"), "node"))
    held = shared_buckets(nodes, scratch)
    pairs = scratch.durable(proposed_pairs(held))
    maybe = scratch.durable(pruned(pairs, nodes, tolerance))
    said = fetched(docs, nodes, maybe.select("a").union(maybe.select("b")).toDF("node"), scratch)
    links = scratch.durable(verified(maybe, said))
    scratch.drop(maybe, said)
    roots = components(links, scratch)
    more = scratch.durable(across_classes(docs, held, nodes, roots, pairs, tolerance, scratch))
    if more.limit(1).count():
        links = links.unionByName(more)
        roots = components(links, scratch)
    return seen, texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), links, nodes


def _classes(docs: DataFrame, tolerance: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows of docs with class (the least row's doc_id, t1, t2), n_texts, n_copies, root and node; null without words. And texts, links and nodes."""
    seen, texts, links, nodes = joined(docs, tolerance, scratch)
    texts = scratch.durable(texts)
    classes = texts.groupBy("root").agg(F.min("least").alias("class"), F.count("*").alias("n_texts"))
    total = seen.count()
    of_root = texts.groupBy("root").agg(F.count("*").alias("n"))
    known = spread_join(texts.drop("least"), classes, "root", F.col("node"), of_root, total).select("k1", "k2", "node", "class", "n_texts", (F.col("copies") - 1).alias("n_copies"))
    # Rows without words have null keys and stay with a join on the set's first key; the second tells apart what shares it.
    keyed = lambda t: t.withColumn("_k", F.struct("k1", "k2"))
    worded = keyed(seen.where("k1 is not null").select("_row", "doc_id", *TEXT_KEY, "k1", "k2")).drop("k1", "k2")
    counts = keyed(texts).select("_k", F.col("copies").alias("n"))
    out = spread_join(worded, keyed(known).drop("k1", "k2"), "_k", F.col("_row"), counts, total).drop("_k")
    bare = seen.where("k1 is null").select("_row", "doc_id", *TEXT_KEY)
    return out.unionByName(bare, allowMissingColumns=True), texts, links, nodes


def near_duplicates(docs: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """doc_id, class_id, n_links, n_texts, n_copies of each row of docs, by five-word shingles and similarity 0.8 or more.

    Words: whatever ASCII white space leaves, A-Z lower-cased. class_id: the least doc_id of the
    class, a connected component of all pairs at the threshold. n_links: how many different texts
    reach the threshold with the row's text, all of its class counted. n_texts: different texts
    of the class; n_copies: other rows with the same shingle set. Null or wordless texts link to
    nothing; their class is their own id. Null ids come last and a class of only such rows has
    a null id. Repeated rows are copies.
    """
    scratch = Scratch()
    rows, texts, links, nodes = _classes(docs, tolerance, scratch)
    ends = link_counts(docs, nodes, texts, links, scratch)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    id_ = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("class.doc_id"), F.lit(NO_ID)))
    out = rows.join(ends, "node", "left").select("doc_id", id_.alias("class_id"), zero("n_links"), F.coalesce("n_texts", F.lit(1).cast("long")).alias("n_texts"), zero("n_copies"))
    return scratch.finish(out)


def drop_near_duplicates(docs: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """docs with one row of each class, that with the least doc_id (nulls last); all of its columns stay.

    Rows without words stay, each of them. Rows that share an id are judged by their texts; of rows
    equal in id and text one stays.
    """
    scratch = Scratch()
    rows, *_ = _classes(docs, tolerance, scratch)
    key = ["_id", *TEXT_KEY]
    named = rows.where("class is not null").withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))).select(*key, "class")
    gone = scratch.finish(named.withColumn("_first", F.col("class") == F.struct(F.col("_id").alias("doc_id"), *TEXT_KEY)).groupBy(*key).agg(F.any_value("_first").alias("_first"), F.count("*").alias("n")))
    work = carry(docs).withColumns({"_id": F.coalesce(F.col("_all.doc_id").cast("long"), F.lit(NO_ID)), "t1": F.xxhash64("_all.text"), "t2": F.xxhash64(F.lit(1), "_all.text")})
    kept = work.join(gone.where("not _first").select(*key), key, "left_anti")
    if gone.where("_first and n > 1").limit(1).count():
        again = gone.where("_first and n > 1").select(*key)
        one = kept.join(again, key, "left_semi").groupBy(*key).agg(F.first("_all").alias("_all"))
        kept = kept.join(again, key, "left_anti").select("_all").unionByName(one.select("_all"))
    return restore(kept, docs)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, with its links."""
    return near_duplicates(table(spark, sf_dir, "documents"))
