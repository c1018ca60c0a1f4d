"""Near-duplicates by ProbMinHash, banding and verification.

Sketch. Every shingle (five words) of a document is the source of a Poisson process whose rate is
the shingle's weight; each arrival falls into one of ``REGISTERS`` registers. A register keeps the
shingle of its earliest arrival. Two documents agree in a register with just the probability
Jaccard similarity of their weighted shingles. Every shingle of the set weighs the same here, so that
is the plain Jaccard similarity which verification computes, however often passages repeat. Arrivals are drawn in rounds, and a shingle is
dropped once its next arrival is later than the latest register's, so a long document costs about
one draw a shingle.

Bands. Registers are grouped into bands; documents that agree in a whole band are candidates. At
similarity 0.8 the chance to share none of 24 bands of 4 is 3e-6.

Verification. A candidate pair is a link if the Jaccard similarity of the two sets of shingles is
at least ``THRESHOLD``, computed from the texts.

No bucket is expanded into all its pairs. Equal texts are one node from the start. In the first
round every bucket tests its members against one hub, the member that meets most others in all its
buckets: in a group of edited copies that is the text they were made from. Verified links join
nodes into classes. A bucket whose members are all in one class has nothing more to say.

In the buckets that are left, an exact bound leaves out what cannot link. Of a node's n shingles
let c occur in another open node too. What two nodes share is at most the smaller c, so a link
needs (1 + t) min(c, c') >= t (n + n') at threshold t, and so c >= t n of each. Texts that merely
share a passage, or copies edited too often, fail that alone. Among the rest 16, then 256, then
4,096 members (and so on, until all) are hubs in turn, and only pairs from different classes that
meet the bound and were not tested before are tested. Two more bounds spare tests: Jaccard distance
is a metric, so two texts whose similarities to one hub differ by more than 1 - t are no link; and
two plain MinHash signatures of 256 that agree in fewer places than 5 standard deviations below 256 t
are none either (which errs for 3 in 10 million links). So no pair of candidates that could join two
classes is left out, and a large group of copies costs about a test a member.

Defined cases: a null text is a class of its own; equal texts, also without words, are one class; a
text of one to four words is one shingle; a class is named by its smallest doc_id (null if it has
none); repeated rows share their class, and ``deduplicated`` keeps one of them; an empty table
gives an empty result; other columns are ignored or, in ``deduplicated``, carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckframe.llm.common import cut, free_name, rest, same

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Places of the signatures that spare tests, 16 bits each.
SIGN = 256
#: Rows up to which a table of keys is broadcast (24 bytes each); beyond it the join is by shuffle.
BROADCAST_ROWS = 500_000
#: Hubs of an unsettled bucket grow by this factor from round to round.
FACTOR = 16
#: By how much the size bounds are loosened, so that rounding loses no pair at exactly the threshold.
SLACK = 1e-6
KEPT_WORDS = 200_000
#: Members of a bucket that one task compares with the bucket's hubs.
SALT = 256

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output looks random."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """word -> 64-bit hash, kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: Words, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for every shingle, in order; one for a shorter text that has words."""
    own = text.encode("utf-8", "surrogatepass").split()
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = _mix((out + _GOLD) ^ h[k : k + n])
    return out


def sketch(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: the element of the earliest arrival in each register."""
    time = np.full(registers, np.inf)
    winner = np.zeros(registers, np.uint64)
    now, h, w = np.zeros(len(elements)), elements, weights
    step = 1
    while len(h):
        many = max(1, -(-2 * registers // len(h)))  # few elements draw several arrivals at once
        turn = np.arange(step, step + many, dtype=np.uint64)
        step += many
        x = _mix(h[:, None] + turn[None, :] * _GOLD)
        wait = -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w[:, None]
        wait[:, 0] += now
        at = np.cumsum(wait, axis=1)
        flat, register = at.ravel(), (_mix(x ^ _M1) % np.uint64(registers)).astype(np.int64).ravel()
        limit = time.max()
        early = np.flatnonzero(flat < limit)
        early = early[np.argsort(-flat[early], kind="stable")]  # the earliest is written last
        best, who = np.full(registers, np.inf), np.zeros(registers, np.uint64)
        best[register[early]] = flat[early]
        who[register[early]] = h[early // many]
        better = best < time
        time[better], winner[better] = best[better], who[better]
        now = at[:, -1]
        going = now < time.max()
        h, w, now = h[going], w[going], now[going]
    return winner


def bands(text: str, words: Words, n_bands: int = BANDS, rows: int = ROWS) -> tuple[int, np.ndarray]:
    """(number of different shingles, a hash for every band)."""
    found = np.unique(shingles(text, words))
    if not len(found):
        return 0, np.empty(0, np.int64)
    got = sketch(found, np.ones(len(found)), n_bands * rows).reshape(n_bands, rows)
    out = _mix(np.arange(1, n_bands + 1, dtype=np.uint64) * _M2)
    for k in range(rows):
        out = _mix((out + _GOLD) ^ got[:, k])
    return len(found), out.view(np.int64)


def node_of(text: Column) -> Column:
    """16 bytes that name a text; null for null."""
    return F.unhex(F.md5(text))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, node, n (different shingles), bands of every row."""
    rows = docs.select("doc_id", node_of(F.col("text")).alias("node"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            n, ends, out = [], [0], []
            for value in batch.column(2):
                count, b = bands(value.as_py() or "", words)
                n.append(count)
                out.append(b)
                ends.append(ends[-1] + len(b))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), lists], names=["doc_id", "node", "n", "bands"])
        rest()

    return rows.mapInArrow(run, f"doc_id {kind}, node binary, n int, bands array<bigint>")


def _fewer(keys: DataFrame) -> DataFrame:
    """``keys`` to be broadcast if they are few enough, else joined by shuffle."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set (sorted 64-bit hashes, packed) of the texts that ``nodes`` names."""
    rows = docs.select(node_of(F.col("text")).alias("node"), "text").join(_fewer(nodes), "node", "left_semi")
    rows = rows.groupBy("node").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingles(x.as_py(), words)).tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "set"])
        rest()

    return rows.mapInArrow(run, "node binary, set binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough, and their similarity."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([
                jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ])
            keep = pa.array(score >= threshold) if len(score) else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["a", "b", "similarity"]).filter(keep)
        rest()

    return with_b.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """node, root: the connected component of every linked node, named by its smallest node.

    Every vertex moves to its smallest neighbour, edges follow, and what is left of them is a
    smaller graph; the number of rounds is logarithmic in the longest chain.
    """
    edges = cut(links.select("a", "b"), "cc-edges")
    label = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "cc-moved")
        if label is None:
            label = moved.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            step = moved.select(F.col("a").alias("root"), "to")
            label = cut(label.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "cc-label")
        a = moved.select("a", F.col("to").alias("ta"))
        b = moved.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        edges = edges.join(a, "a").join(b, "b").where("ta <> tb")
        edges = cut(edges.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "cc-edges")
        if edges.isEmpty():
            return label


@dataclass(frozen=True)
class Classes:
    """rows: doc_id, node of every row. nodes: node, class_id, keeper (the node that stays). links: a, b, similarity of different texts."""

    rows: DataFrame
    nodes: DataFrame
    links: DataFrame


def _met(left: DataFrame, right: DataFrame, columns: Sequence[str], threshold: float) -> tuple[DataFrame, Column]:
    """Members of ``left`` beside those of ``right`` in each bucket, columns named _x and _y, and whether classes differ and sizes and shared shingles allow the threshold.

    A bucket of more than ``SALT`` members is dealt to as many tasks as it has times that: each of
    ``right`` goes to one of them by its hash, the few of ``left`` to all.
    """
    side = lambda df, k: df.select("band", "salt", *(F.col(c).alias(f"{c}_{k}") for c in columns))
    parts = F.ceil(F.col("size") / SALT).cast("int")
    few = left.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    many = right.withColumn("salt", F.pmod(F.xxhash64("node"), parts).cast("int"))
    most = F.least("common_x", "common_y", "n_x", "n_y")
    fits = (F.col("class_x") != F.col("class_y")) & ((1 + threshold) * most >= threshold * (F.col("n_x") + F.col("n_y")) - SLACK)
    return side(few, "x").join(side(many, "y"), ["band", "salt"]), fits


def _hub_pairs(ranked: DataFrame, threshold: float) -> DataFrame:
    """a, b: every member of a bucket with the bucket's hub, each pair once."""
    hubs = ranked.groupBy("band").agg(F.max("rank").alias("rank"))
    met, fits = _met(ranked.join(hubs, ["band", "rank"], "left_semi"), ranked, ["node", "n", "class", "common"], threshold)
    return met.where(fits).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _further_pairs(open_: DataFrame, hubs: int, threshold: float) -> DataFrame:
    """a, b: pairs of the first ``hubs`` members of each bucket with the others, that no bound excludes.

    A pair comes out once, in the first bucket that it shares; pairs of earlier rounds' hubs do not.
    """
    columns = ["node", "n", "class", "common", "turn", "anchor", "near", "bands", "sign"]
    met, fits = _met(open_.where(F.col("turn") < hubs), open_, columns, threshold)
    before = hubs / FACTOR if hubs > FACTOR else 0
    once = ((F.col("turn_y") >= hubs) | (F.col("node_x") < F.col("node_y"))) & (F.least("turn_x", "turn_y") >= before)
    metric = (F.col("anchor_x") != F.col("anchor_y")) | (F.abs(F.col("near_x") - F.col("near_y")) <= 1 - threshold + 1e-9)
    first = F.get(F.filter(F.zip_with("bands_x", "bands_y", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), F.lit(0)) == F.col("band")
    agree = F.aggregate(F.zip_with("sign_x", "sign_y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    least = SIGN * threshold - 5 * (SIGN * threshold * (1 - threshold)) ** 0.5
    met = met.where(fits & once & metric & first & (agree >= least))
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))


def _signatures(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, sign: a plain MinHash signature of each node's shingles, 16 bits a place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _mix(np.arange(1, SIGN + 1, dtype=np.uint64) * _M1)
        for batch in batches:
            out = []
            for packed in batch.column(1):
                own = np.frombuffer(packed.as_buffer(), np.uint64)
                out.append(np.array([_mix(own ^ s).min() for s in seeds]).view(np.int64).astype(np.int16))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, SIGN * len(out) + 1, SIGN, dtype=np.int32)), pa.array(np.concatenate(out) if out else np.empty(0, np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "sign"])

    return sets.join(_fewer(nodes), "node", "left_semi").select("node", "set").mapInArrow(run, "node binary, sign array<short>")


def _anchors(scored: DataFrame, ranks: DataFrame) -> DataFrame:
    """node, anchor, near: of the hubs that a node was tested against the highest ranked, and the similarity to it."""
    both = scored.select(F.col("a").alias("node"), F.col("b").alias("hub"), "similarity").unionByName(scored.select(F.col("b").alias("node"), F.col("a").alias("hub"), "similarity"))
    best = both.join(ranks.select(F.col("node").alias("hub"), "rank"), "hub").groupBy("node").agg(F.max(F.struct("rank", "hub", "similarity")).alias("k"))
    best = best.join(ranks, "node").select("node", F.when(F.col("rank") > F.col("k.rank"), F.struct(F.col("node").alias("hub"), F.lit(1.0).alias("s"))).otherwise(F.struct("k.hub", F.col("k.similarity").alias("s"))).alias("k"))
    return best.select("node", F.col("k.hub").alias("anchor"), F.col("k.s").alias("near"))


def _common(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """who (hash of the node), alone: how many shingles of each of ``nodes`` no other of them has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for who, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(packed.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), who)), pa.array(own)], names=["who", "shingle"])

    rows = sets.join(_fewer(nodes), "node", "left_semi").select(F.xxhash64("node").alias("who"), "set")
    each = rows.mapInArrow(run, "who long, shingle long")
    once = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("who").alias("who")).where("times = 1")
    return once.groupBy("who").agg(F.count(F.lit(1)).alias("alone"))


def _linkable(open_: DataFrame, threshold: float) -> DataFrame:
    """Rows of buckets in which some pair of different classes may still meet the bound."""
    alive = open_.where(F.col("common") >= threshold * F.col("n") - SLACK)
    least = alive.groupBy("band").agg(F.min("n").alias("least"), F.min(F.xxhash64("class")).alias("lo"), F.max(F.xxhash64("class")).alias("hi"))
    least = cut(least.where("lo <> hi").select("band", "least"), "nd-least")
    return alive.join(least, "band").where((1 + threshold) * F.col("common") >= threshold * (F.col("n") + F.col("least")) - SLACK).drop("least")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> Classes:
    rows = cut(sketched(docs), "nd-sketch")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = cut(nodes, "nd-nodes")
    posts = nodes.select(F.explode("bands").alias("band"), "node", "n")
    # what is counted for buckets is written before members are joined with it: a join whose sides come
    # straight from a shuffle or a file can be split where a bucket is large, or needs no shuffle at all
    shared = cut(posts.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "nd-shared")
    met = cut(posts.join(shared, "band"), "nd-buckets")
    links, label = None, None
    if not met.isEmpty():
        sets = cut(_shingle_sets(docs, met.select("node").distinct()), "nd-sets")
        # nodes ranked by how many others they meet, with hash bits to tell equal ones apart
        rank = (F.sum("size") * (1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))).alias("rank")
        ranks = cut(met.groupBy("node").agg(rank), "nd-ranks")
        ranked = met.join(ranks, "node").withColumn("common", F.col("n")).withColumn("class", F.col("node"))
        scored = cut(_verified(_hub_pairs(ranked, threshold), sets, 0.0), "nd-scored")
        links = scored.where(F.col("similarity") >= threshold)
        label = None if links.isEmpty() else components(links)

        def classed(df: DataFrame) -> DataFrame:
            if label is None:
                return df.withColumn("class", F.col("node"))
            return df.join(label, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")

        one = F.xxhash64("class")
        named = classed(met)
        unsettled = cut(named.groupBy("band").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo <> hi").select("band"), "nd-bands")
        named = cut(named.join(unsettled, "band", "left_semi"), "nd-unsettled")
        alone = _common(sets, named.select("node").distinct())
        named = named.withColumn("who", F.xxhash64("node")).join(alone, "who", "left")
        named = named.withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0))).drop("who", "alone")
        open_ = cut(_linkable(named, threshold), "nd-open")
        if not open_.isEmpty():
            still = open_.select("node").distinct()
            more = _signatures(sets, still).join(nodes.select("node", "bands"), "node").join(_anchors(scored, ranks), "node", "left")
            turn = F.pmod(F.xxhash64("node", "band"), F.lit(1 << 30)) * F.lit(2.0**-30) * F.col("size")
            more = more.withColumn("anchor", F.coalesce("anchor", "node")).withColumn("near", F.coalesce("near", F.lit(1.0)))
            open_ = cut(open_.join(more, "node").withColumn("turn", turn), "nd-open")
        tested, hubs = scored.select("a", "b"), 1
        while (most := open_.agg(F.max("size").alias("m")).first().m) is not None and hubs < most:
            hubs *= FACTOR
            pairs = cut(_further_pairs(open_, hubs, threshold).join(tested, ["a", "b"], "left_anti"), "nd-pairs")
            found = cut(_verified(pairs, sets, threshold), "nd-links")
            tested = tested.unionByName(pairs)
            if not found.isEmpty():
                links = links.unionByName(found)
                label = components(links)
            open_ = cut(_linkable(classed(open_.drop("class")), threshold), "nd-open")
    if links is None:
        links = docs.sparkSession.createDataFrame([], "a binary, b binary, similarity double")
    rooted = nodes.select("node", "first_id", *([] if label is not None else [F.col("node").alias("root")]))
    if label is not None:
        rooted = rooted.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = cut(rooted, "nd-rooted")
    # nulls sort first in a struct, so a class is named by an id if any of its rows has one
    best = F.min(F.struct(F.col("first_id").isNull().alias("no"), "first_id", "node"))
    named = rooted.groupBy("root").agg(best.alias("k")).select("root", F.col("k.first_id").alias("class_id"), F.col("k.node").alias("keeper"))
    return Classes(rows.select("doc_id", "node"), cut(rooted.join(named, "root").select("node", "class_id", "keeper"), "nd-classes"), links)


def labelled(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, is_kept for every row: is_kept marks the class's smallest doc_id."""
    c = classes(docs, threshold)
    out = c.rows.join(c.nodes, "node", "left")
    own = F.coalesce("class_id", F.when(F.col("node").isNull(), F.col("doc_id")))
    stays = F.col("node").isNull() | ((F.col("node") == F.col("keeper")) & same(F.col("doc_id"), F.col("class_id")))
    return out.select("doc_id", own.alias("class_id"), F.coalesce(stays, F.lit(False)).alias("is_kept"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with one row a class: that of the smallest doc_id.

    What goes is joined away, as it is the smaller part; texts are shuffled only if that part is
    too large to broadcast, and otherwise only those of repeated rows.
    """
    c = classes(docs, threshold)
    node, doc = free_name(docs, "_nd_node"), free_name(docs, "_nd_doc")
    each = c.rows.where("node is not null").groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("copies")).join(c.nodes, "node")
    stays = (F.col("node") == F.col("keeper")) & same(F.col("doc_id"), F.col("class_id"))
    each = cut(each.select(F.col("doc_id").alias(doc), F.col("node").alias(node), "copies", stays.alias("stays")), "nd-rows")
    gone = each.where(~F.col("stays")).select(doc, node)
    repeated = each.where(F.col("stays") & (F.col("copies") > 1)).select(doc, node)
    key = free_name(docs, "_nd_key")
    named = docs.withColumn(key, node_of(F.col("text")))
    match = lambda k: (F.col(key) == k[node]) & same(F.col("doc_id"), k[doc])
    left = named.join(k := _fewer(gone), match(k), "left_anti")
    if not repeated.isEmpty():
        k = _fewer(repeated)
        twice = left.join(k, match(k), "left_semi").dropDuplicates([key, "doc_id"])
        left = left.join(k, match(k), "left_anti").unionByName(twice)
    return left.select(*docs.columns)
