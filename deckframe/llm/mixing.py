"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sources ranked by code point get weights in turn; targets share ``ratio`` of all words by
   weight, stop at ``cap`` times their source's words, and the excess is shared again by weight.
2. A record's permutation key is a hash of its id and text; a *block* is one of 256 (more for
   over 64 shards) equal ranges of the key, so blocks in key order are a random permutation of the source. A source is
   taken in whole passes, then up to a threshold key found by a three-level histogram (a radix
   select): no source is ever sorted or gathered as a whole. One record whose size is nearest to
   what is then missing (or too much) is taken besides (or left out).
3. The blocks that each source gives are exact quotas. A binary tree over the output shards splits
   the vector of quotas at each node by a multivariate-hypergeometric draw, so all shards get the
   same number of blocks (to one) in random proportions, and blocks of different shards are disjoint.
4. Within a shard records are ordered by another hash.

Everything on the path is a DataFrame expression; what is gathered in one task is one row for a
source, or at most 1,024 histogram rows of one source.

Defined cases: null texts have no words; records without words are taken in whole passes only;
null sources form one source, ranked last; records that agree in id and text are taken together;
an empty table gives an empty result; a text of any length is one record of its size, taken whole or
not at all; other columns are carried by ``draw`` and ignored by ``plan``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deckframe.llm.common import cut, let, same, text_of, word_count

SEED = 7_919
#: Bits of the number of blocks of a source: at least 256 blocks, and 4 for each shard.
BLOCK_BITS = 8
_BIN_BITS = 10


def _key(seed: int) -> Column:
    """63 bits, uniform: the record's place in the permutation of its source."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", text_of()), 1)


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size (words), key."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(seed).alias("key"))


def targets(sources: DataFrame, weights: Sequence[float], ratio: float, cap: int) -> DataFrame:
    """rank, weight and target for one row a source (source, source_size)."""
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("_ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("_ratio", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    base = (
        sources.withColumn("rank", F.row_number().over(ranked).cast("long"))
        .withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1))
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
    )
    level = (F.sum("source_size").over(every) * F.lit(float(ratio)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    filled = base.withColumn("_level", level)
    rate = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every)
    return filled.withColumn("_rate", rate).select(
        "source", "source_size", "rank", "weight",
        F.least("_cap", F.coalesce(F.col("_rate") * F.col("weight"), F.col("_cap"))).alias("target"),
    )


def _thresholds(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """For each source the largest key of the last, partial pass (-1: none of it).

    ``goal``: source, rest (words of the partial pass). Bins of 10 bits, then 10 bits more inside
    the bin that holds the edge, then single keys inside that.
    """
    bin1 = F.shiftrightunsigned(F.col("key"), 63 - _BIN_BITS)
    bin2 = F.shiftrightunsigned(F.col("key"), 63 - 2 * _BIN_BITS).bitwiseAND(F.lit((1 << _BIN_BITS) - 1))

    def edge(bins: DataFrame, goal: DataFrame, name: str) -> DataFrame:
        """The first bin whose running sum passes the rest, and the rest without the bins before it."""
        run = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        over = bins.withColumn("after", run).join(goal.select(F.col("source").alias("_s"), "rest"), same(F.col("source"), F.col("_s")))
        first = F.min(F.when(F.col("after") > F.col("rest"), F.struct("bin", (F.col("rest") - F.col("after") + F.col("words")).alias("left"))))
        return over.groupBy("source").agg(first.alias("e")).where("e is not null").select("source", F.col("e.bin").alias(name), F.col("e.left").alias("rest"))

    def inside(rows: DataFrame, edges: DataFrame, *names: str) -> DataFrame:
        b = edges.select(F.col("source").alias("_s"), *names)
        return rows.join(b, same(F.col("source"), F.col("_s"))).drop("_s")

    first = cut(edge(rows.groupBy("source", bin1.alias("bin")).agg(F.sum("size").alias("words")), goal, "bin1"), "mix-edge1")
    near = inside(rows, first, "bin1").where(bin1 == F.col("bin1"))
    second = cut(
        edge(near.groupBy("source", bin2.alias("bin")).agg(F.sum("size").alias("words")), first, "bin2")
        .join(first.select(F.col("source").alias("_s"), "bin1"), same(F.col("source"), F.col("_s"))).drop("_s"),
        "mix-edge2",
    )
    last = inside(rows, second, "bin1", "bin2", "rest").where((bin1 == F.col("bin1")) & (bin2 == F.col("bin2")))
    keys = last.groupBy("source", "key", "rest").agg(F.sum("size").alias("words"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("key"))
    fits = F.when(run - F.col("words") / 2 <= F.col("rest"), F.col("key"))
    below = F.shiftleft(F.col("bin1"), 63 - _BIN_BITS) + F.shiftleft(F.col("bin2"), 63 - 2 * _BIN_BITS) - 1
    found = keys.withColumn("fits", fits).groupBy("source").agg(F.max("fits").alias("fits"))
    return second.join(found.select(F.col("source").alias("_s"), "fits"), same(F.col("source"), F.col("_s")), "left").select(
        "source", F.coalesce("fits", below).alias("last_key")
    )


def _corrections(rows: DataFrame, per: DataFrame) -> DataFrame:
    """source, fix_key: the record that brings the partial pass nearest to its rest, where one brings it nearer.

    ``per``: source, rest, last_key. An aggregation with partial results; each task keeps one row a source.
    """
    side = per.select(F.col("source").alias("_s"), "rest", "last_key")
    own = rows.join(side, same(F.col("source"), F.col("_s"))).drop("_s")
    taken = own.groupBy("source").agg(F.sum(F.when(F.col("key") <= F.col("last_key"), F.col("size")).otherwise(0)).alias("got"))
    gap = per.join(taken.withColumnRenamed("source", "_s"), same(F.col("source"), F.col("_s"))).select(F.col("source").alias("_s"), "last_key", (F.col("rest") - F.col("got")).alias("gap"))
    gap = cut(gap, "mix-gap")
    fits = rows.where("size > 0").join(gap, same(F.col("source"), F.col("_s")))
    fits = fits.where((F.col("gap") > 0) & (F.col("key") > F.col("last_key")) | (F.col("gap") < 0) & (F.col("key") <= F.col("last_key")))
    off = F.abs(F.col("size") - F.abs("gap"))
    best = fits.where(off < F.abs("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "key")).alias("k"))
    return best.select("source", F.col("k.key").alias("fix_key"))


def _hypergeometric(quota: Column, share: Column, node: Column, seed: int) -> Column:
    """array<long>: what the left child gets of the quotas, ``share`` blocks in all.

    One draw without replacement for every block of the node: the exact law of the split.
    """
    n = F.aggregate(quota, F.lit(0).cast("long"), lambda a, x: a + x)

    def of_source(state: Column, source: Column) -> Column:
        q = F.get(quota, source)
        blocks = F.when(q > 0, F.sequence(F.lit(1).cast("long"), q)).otherwise(F.array().cast("array<bigint>"))

        def draw(s: Column, i: Column) -> Column:
            left = _uniform(F.lit(seed), node, source, i) * s["all"] < s["left"]
            return F.struct((s["all"] - 1).alias("all"), (s["left"] - left.cast("long")).alias("left"), (s["got"] + left.cast("long")).alias("got"))

        begin = F.struct(state["all"].alias("all"), state["left"].alias("left"), F.lit(0).cast("long").alias("got"))
        return let(F.aggregate(blocks, begin, draw), lambda s: F.struct(
            s["all"].alias("all"), s["left"].alias("left"), F.concat(state["out"], F.array(s["got"])).alias("out"),
        ))

    start = F.struct(n.alias("all"), share.alias("left"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(quota) - 1), start, of_source, lambda s: s["out"])


def split_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """rank, ends: for each source (rank, blocks) the running sums of its blocks over the shards."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "blocks")))
    level = quotas.groupBy().agg(ordered.alias("q")).where(F.size("q") > 0).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.transform("q", lambda x: x["blocks"]).alias("quota"),
    )
    for _ in range(max(0, shards - 1).bit_length()):
        lo, hi, quota = F.col("lo"), F.col("hi"), F.col("quota")
        mid = lo + F.floor((hi - lo) / 2).cast("int")
        total = F.aggregate(quota, F.lit(0).cast("long"), lambda a, x: a + x)
        share = F.floor((total * (mid - lo)) / (hi - lo) + 0.5).cast("long")
        left = _hypergeometric(quota, share, lo * 65_537 + hi, seed)
        halves = let(left, lambda got: F.array(
            F.struct(lo.alias("lo"), mid.alias("hi"), got.alias("quota")),
            F.struct(mid.alias("lo"), hi.alias("hi"), F.zip_with(quota, got, lambda a, b: a - b).alias("quota")),
        ))
        whole = F.array(F.struct("lo", "hi", "quota"))
        level = level.select(F.explode(F.when(hi - lo > 1, halves).otherwise(whole)).alias("n")).select("n.*")
    leaf = level.select(F.col("lo").alias("shard"), F.posexplode("quota").alias("at", "got"))
    sums = F.aggregate(
        F.sort_array(F.collect_list(F.struct("shard", "got"))), F.array().cast("array<bigint>"),
        lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(0).cast("long")), a), -1), F.lit(0)) + x["got"])),
    )
    return leaf.groupBy("at").agg(sums.alias("ends")).select((F.col("at") + 1).cast("long").alias("rank"), "ends")


@dataclass(frozen=True)
class Mix:
    """The decided mix: one row a source, and the records' sizes and keys."""

    sources: DataFrame
    rows: DataFrame
    shards: int
    seed: int
    bits: int = BLOCK_BITS


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), ratio: float = 1.5, cap: int = 2, shards: int = 8, seed: int = SEED) -> Mix:
    """Decide how often each record is taken. ``cap``: whole passes over a source at most."""
    if cap != int(cap) or cap < 1:
        raise ValueError("cap must be a whole number of passes")
    bits = max(BLOCK_BITS, (4 * shards - 1).bit_length())
    blocks = 1 << bits
    rows = cut(sized(docs, seed), "mix-sized")
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    full = F.least(F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0), F.lit(cap)).cast("long")
    per = targets(per, weights, ratio, cap).withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    per = cut(per, "mix-targets")
    ends = cut(_thresholds(rows, per.where("rest > 0")), "mix-thresholds")
    per = per.join(ends.withColumnRenamed("source", "_s"), same(F.col("source"), F.col("_s")), "left").drop("_s")
    per = cut(per.withColumn("last_key", F.coalesce("last_key", F.lit(-1).cast("long"))), "mix-passes")
    fix = _corrections(rows, per.where("rest > 0"))
    per = per.join(fix.withColumnRenamed("source", "_s"), same(F.col("source"), F.col("_s")), "left").drop("_s")
    extra = F.when(F.col("last_key") >= 0, F.shiftrightunsigned(F.col("last_key"), 63 - bits) + 1).when(F.col("fix_key").isNotNull(), 1).otherwise(0)
    per = cut(per.withColumn("blocks", (F.col("full") * blocks + extra).cast("long")), "mix-blocks")
    tree = split_tree(per.select("rank", "blocks"), shards, seed)
    return Mix(cut(per.join(tree, "rank"), "mix-sources"), rows, shards, seed, bits)


def _takes(rows: DataFrame, mix: Mix, key: str, pre: str) -> DataFrame:
    """Adds the source's columns, named with the prefix ``pre``, and ``shards``: the shard of every take of the record."""
    src = mix.sources.select(*(F.col(c).alias(f"{pre}{c}") for c in mix.sources.columns))
    k, of = F.col(key), lambda c: F.col(f"{pre}{c}")
    blocks = 1 << mix.bits
    block = F.shiftrightunsigned(k, 63 - mix.bits)
    turn = F.pmod(block * 167 + F.pmod(of("rank") * 61, F.lit(blocks)), F.lit(blocks))
    indexes = F.concat(
        F.transform(F.slice(F.sequence(F.lit(0).cast("long"), of("full")), F.lit(1), of("full").cast("int")), lambda c: c * blocks + turn),
        # a record taken as a correction counts to the source's last block
        F.when((k <= of("last_key")) != same(k, of("fix_key")), F.array(F.least(of("full") * blocks + block, of("blocks") - 1))).otherwise(F.array().cast("array<bigint>")),
    )
    shard_of = F.transform(indexes, lambda i: F.size(F.filter(of("ends"), lambda e: e <= i)))
    return rows.join(src, same(F.col("source"), of("source"))).withColumn(f"{pre}shards", shard_of)


def decisions(mix: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, shards for every record, taken or not."""
    out = _takes(mix.rows, mix, "key", "_mix_")
    return out.select(
        "doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
        (F.col("size") * F.size("_mix_shards")).alias("taken"), "source", F.col("_mix_shards").alias("shards"),
    )


def draw(docs: DataFrame, mix: Mix, keep_shard: bool = False) -> DataFrame:
    """The mixed records themselves, a row for every take, dealt by shard and shuffled within it."""
    pre = "_mix_"
    while any(c.lower().startswith(pre) for c in docs.columns):
        pre = f"_{pre}"
    key, shard, place, take = (f"{pre}{x}" for x in ("k", "shard", "place", "take"))
    taken = _takes(docs.withColumn(key, _key(mix.seed)), mix, key, pre)
    taken = taken.select(*docs.columns, key, F.posexplode(f"{pre}shards").alias(take, shard))
    taken = taken.withColumn(place, F.xxhash64(F.lit(mix.seed + 1), shard, key, take))
    slice_ = F.shiftrightunsigned(F.col(place), 44)  # a shard is dealt in up to 2**20 parts
    out = taken.repartition(shard, slice_).sortWithinPartitions(shard, slice_, place)
    return out.select(*docs.columns, *([F.col(shard).alias("shard")] if keep_shard else []))
