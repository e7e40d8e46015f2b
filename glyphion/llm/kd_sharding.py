"""K-d tree partitioning of rows into shards of near-equal bytes, with DataFrame functions only.

Points are groups of equal texts, so copies stay in one shard. A node that holds k shards splits
its points at the weighted (by bytes) quantile floor(k/2)/k along its widest dimension, until each
leaf is one shard. Light points are cut where a few distributed histograms find the quantile: one of
4,096 bins over the key's next twelve bits, then a finer one inside the bin that holds it. Heavy
points, of more than a hundredth of a shard, are at most a hundred a shard, so the driver knows them and
deals them itself: in the order of the dimension up to the same quantile, then the next ones that
still fit; the light points' quantile makes up for what is left. No rows are sorted to find a cut
and no group meets in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphion.llm.common import Scratch, spread_join, table

TIE_BITS = 31
KEY_BITS = 62
STEP_BITS = 12


@dataclass
class Heavy:
    group: int
    keys: list[int]
    weight: int


@dataclass
class Node:
    """below: light bytes left of the cell (prefix, shift) that holds the cut; aim: light bytes that go left."""

    leaves: int
    shard: int
    heavy: list[Heavy]
    light: int = 0
    ends: list[tuple[int, int]] = field(default_factory=list)
    dim: int = 0
    aim: float = 0
    cut: int = 0
    prefix: int = 0
    shift: int = KEY_BITS
    below: int = 0
    open: bool = False
    sides: tuple[list[Heavy], list[Heavy]] = ((), ())


def _of(values: list, node: Column) -> Column:
    """The value of a row's node, from a literal array with an entry a node.

    element_at isn't taken for a cheap expression, so levels aren't written into each other.
    """
    return F.try_element_at(F.lit([int(v) for v in values]).cast("array<long>"), (node + 1).cast("int"))


def _deal(points: list[Heavy], dim: int, share: float) -> tuple[list[Heavy], list[Heavy]]:
    """Heavy points split near a share of their bytes: in the order of a dimension, then whichever still fit."""
    aim, left, right = share * sum(p.weight for p in points), [], []
    for p in sorted(points, key=lambda p: (p.keys[dim], p.group)):
        if p.weight <= aim:
            left.append(p)
            aim -= p.weight
        else:
            right.append(p)
    if right and (least := min(right, key=lambda p: p.weight)).weight < 2 * aim:  # it overshoots by less than what is missing
        left.append(least)
        right.remove(least)
    return left, right


def kd_tree(light: DataFrame, heavy: list[Heavy], dims: list[str], weight: str, tie: str, shards: int, tolerance: float) -> tuple[DataFrame, dict[int, int]]:
    """light with `shard`, and the shard of each heavy point. dims and tie: whole numbers from 0 to 2**31-1, equal ties staying together."""
    keys = [F.shiftleft(F.col(d).cast("long"), TIE_BITS) + F.col(tie).cast("long") for d in dims]
    placed = light.withColumns({"_keys": F.array(*keys), "_node": F.lit(0).cast("int")})
    level, spans, slack = [Node(shards, 0, heavy)], None, 1
    while any(n.leaves > 1 for n in level):
        _measure(placed, level, dims, weight)
        if spans is None:
            spans = [max(1, hi - lo) for lo, hi in level[0].ends]
            slack = max(1, int(tolerance * (level[0].light + sum(p.weight for p in heavy)) / shards))
        for n in level:
            if n.leaves > 1:
                _aim(n, spans)
        while any(n.open for n in level):
            shift, prefix = _of([n.shift for n in level], F.col("_node")).cast("int"), _of([n.prefix if n.open else -1 for n in level], F.col("_node"))
            key = F.try_element_at("_keys", (_of([n.dim for n in level], F.col("_node")) + 1).cast("int"))
            inside = placed.select("_node", weight, key.alias("_key"), shift.alias("_shift"), prefix.alias("_prefix"))
            # Not a filter, which would be pushed below and written out level within level: keys elsewhere share a null bin.
            bin_ = F.expr(f"CASE WHEN shiftright(_key, _shift) = _prefix THEN shiftright(_key, greatest(_shift - {STEP_BITS}, 0)) END").alias("_bin")
            bins: dict[int, list] = {}
            for r in inside.groupBy("_node", bin_).agg(F.sum(weight).alias("w"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).collect():
                if r["_bin"] is not None:
                    bins.setdefault(r["_node"], []).append((r["_bin"], int(r["w"]), r["lo"] == r["hi"]))
            for i, n in enumerate(level):
                if n.open:
                    _narrow(n, sorted(bins.get(i, [])), slack)
        first, below = [], []
        for n in level:
            first.append(len(below))
            if n.leaves == 1:
                below.append(Node(1, n.shard, n.heavy))
            else:
                k = n.leaves // 2
                below += [Node(k, n.shard, n.sides[0]), Node(n.leaves - k, n.shard + k, n.sides[1])]
        node = F.col("_node")
        right = (F.try_element_at("_keys", (_of([n.dim for n in level], node) + 1).cast("int")) >= _of([n.cut if n.leaves > 1 else 2**63 - 1 for n in level], node)).cast("int")
        placed, level = placed.withColumn("_node", _of(first, node).cast("int") + right), below
    out = placed.withColumn("shard", _of([n.shard for n in level], F.col("_node")).cast("int")).drop("_node", "_keys")
    return out, {p.group: n.shard for n in level for p in n.heavy}


def _measure(placed: DataFrame, level: list[Node], dims: list[str], weight: str) -> None:
    """Light bytes and the ends of all dimensions of each node."""
    ends = [f(F.col(d).cast("long")).alias(f"{name}{i}") for i, d in enumerate(dims) for name, f in (("lo", F.min), ("hi", F.max))]
    found = {r["_node"]: r for r in placed.groupBy("_node").agg(F.sum(weight).alias("_w"), *ends).collect()}
    for k, n in enumerate(level):
        r = found.get(k)
        n.light = int(r["_w"]) if r else 0
        n.ends = []
        for i in range(len(dims)):
            seen = [p.keys[i] >> TIE_BITS for p in n.heavy] + ([r[f"lo{i}"], r[f"hi{i}"]] if r else [])
            n.ends.append((min(seen, default=0), max(seen, default=0)))


def _aim(n: Node, spans: list[int]) -> None:
    share = (n.leaves // 2) / n.leaves
    n.dim = max(range(len(n.ends)), key=lambda i: ((n.ends[i][1] - n.ends[i][0]) / spans[i], -i))
    n.sides = _deal(n.heavy, n.dim, share)
    whole = n.light + sum(p.weight for p in n.heavy)
    n.aim = min(max(whole * share - sum(p.weight for p in n.sides[0]), 0), n.light)
    n.open, n.below = n.light > 0, 0
    low, high = n.ends[n.dim][0] << TIE_BITS, (n.ends[n.dim][1] + 1 << TIE_BITS) - 1
    n.shift = (low ^ high).bit_length()  # the bits above are the same in all of the node's keys
    n.prefix = low >> n.shift
    n.cut = 0


def _narrow(n: Node, bins: list[tuple[int, int, bool]], slack: int) -> None:
    """Finds the bin in which the node's quantile lies: cuts there if it is light or one point, else looks into it."""
    shift = max(0, n.shift - STEP_BITS)
    for at, w, single in bins:
        if n.below + w < n.aim and at != bins[-1][0]:
            n.below += w
            continue
        if w <= slack or single or shift == 0:
            n.cut, n.open = (at + 1 if n.below + w - n.aim < n.aim - n.below else at) << shift, False
        else:
            n.prefix, n.shift = at, shift
        return
    n.open = False


def kd_shards(docs: DataFrame, shards: int = 40, tolerance: float = 0.002, heavy: float = 0.01, rows_a_bucket: int = 5000) -> DataFrame:
    """Puts documents (doc_id, text, lang, source) into `shards` shards of near-equal bytes.

    A point of the tree is a group of equal texts, with the group's size, least lang and least
    source as dimensions, so copies stay in one shard; only a group of more bytes than a whole
    shard should have is split, by row. The size of a row is the UTF-8 bytes of its text and 16
    more. Null texts count as empty ones, null lang and source as ''. Repeated rows and null ids
    are rows like others. An empty table gives an empty result.
    Columns: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard, by doc_id within buckets of rows).
    """
    scratch = Scratch()
    text = F.coalesce(F.col("text"), F.lit(""))
    code = lambda c: F.shiftright(F.crc32(F.coalesce(c, F.lit("")).cast("binary")), 1)
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_group"),
        F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source"),
    )
    rows = scratch.durable(rows.withColumn("_row", F.monotonically_increasing_id()))
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(2**31)).cast("long")
    groups = rows.groupBy("_group").agg(F.count("*").alias("n"), F.sum("size").alias("_bytes"), F.max("size").alias("_size"), F.min("_lang").alias("_l"), F.min("_source").alias("_s"))
    groups = scratch.durable(groups.select("_group", "n", "_bytes", F.least("_size", F.lit(2**31 - 1)).alias("_d_size"), code(F.col("_l")).alias("_d_lang"), code(F.col("_s")).alias("_d_source")))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("b")).first()
    dims, share = ["_d_size", "_d_lang", "_d_source"], total["b"] / shards
    whole = (F.col("_bytes") > heavy * share) & (F.col("_bytes") <= share)
    known = groups.where(whole).select("_group", hashed(F.col("_group")).alias("t"), "_bytes", *dims).collect()  # at most shards / heavy of them
    points = [Heavy(r["_group"], [(r[d] << TIE_BITS) + r["t"] for d in dims], int(r["_bytes"])) for r in known]
    held = spread_join(rows.drop("_lang", "_source"), groups.drop("n"), "_group", F.col("_row"), groups.select("_group", "n"), total["n"])
    held = scratch.durable(held)
    light = held.where(~whole).withColumn("_tie", F.when(F.col("_bytes") > share, hashed(F.col("_row"))).otherwise(hashed(F.col("_group"))))
    tree, at = kd_tree(light, points, dims, "size", "_tie", shards, tolerance)
    cols = ["doc_id", "size", "text_crc32", "_row", "shard"]
    placed = tree.select(cols)
    if at:
        of = F.broadcast(_relation(docs.sparkSession, "_group, shard", list(at.items())))  # as few as the heavy points
        placed = placed.unionByName(held.where(whole).join(of, "_group").withColumn("shard", F.col("shard").cast("int")).select(cols))
    buckets = max(1, math.ceil(total["n"] / (shards * rows_a_bucket)))
    placed = scratch.durable(placed.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int")))
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "_row")
    numbered = placed.withColumn("_at", F.row_number().over(within) - 1)
    return scratch.finish(numbered.join(offsets, ["shard", "_bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_offset") + F.col("_at")).alias("slot")))


def _relation(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A few rows of whole numbers as a literal relation."""
    values = ", ".join("(" + ", ".join(f"CAST('{int(v)}' AS BIGINT)" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law `bytes`."""
    out = kd_shards(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
