"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order of distance. It is posted in the inverted
file of its first ``post`` pivots; a query opens the files of its first ``probe`` pivots, ranks
what is posted there by the footrule distance between permutations (the sum over pivots of how far
their places differ, a pivot beyond the prefix counting as last), and computes true distances for
the best ``share`` of each file. The ten nearest of all files are the result. Shares and neighbours
are counted in ids, and an id counts by its best row, so rows that share an id take one place.

Pivots are a bounded sample: those distinct vectors whose hashes are smallest. Every vector is
indexed. Files are salted into parts of about ``CELL`` vectors and queries into blocks of about
``QUERIES``, so a pivot or a vector that holds a third of all rows is many tasks, not one.

A query that finds fewer than it must (few rows, or empty files) is asked again with all files
open and every posted vector reranked, which is exact.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite number take no part,
nor do those whose length is not the most common one (the larger on ties); nor do null ids. All rows
with the query's own id are left out of its result. Ties go to the smaller id, and rows that repeat
an id keep their nearest. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deckframe.llm.common import cut

PIVOTS, PREFIX, POST, PROBE, SHARE = 128, 128, 2, 48, 0.2
CELL, QUERIES, LEAST = 20_000, 4_000, 128
SEED = 31_337


def usable(column: str = "embedding") -> Column:
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    rows = table.where(F.col("vec_id").isNotNull() & usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    best = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("v") == (best.dim if best else 0))


def pivots(rows: DataFrame, n: int = PIVOTS, seed: int = SEED) -> np.ndarray:
    """At most ``n`` distinct vectors, the same for the same rows however they are stored."""
    h = F.xxhash64(F.lit(seed), "v")
    least = [r.h for r in rows.select(h.alias("h")).distinct().orderBy("h").limit(n).collect()]
    found = rows.where(h.isin(least)).groupBy(h.alias("h")).agg(F.min("v").alias("v")).orderBy("h").collect() if least else []
    return np.array([r.v for r in found], float)


def permuted(rows: DataFrame, piv: np.ndarray, prefix: int) -> DataFrame:
    """vec_id, v, perm: the numbers of the nearest pivots, nearest first, ties to the smaller number."""
    k = min(prefix, len(piv))
    square = (piv**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(1))
                near = np.argsort(square - 2 * (x @ piv.T), axis=1, kind="stable")[:, :k].astype(np.int16)
                perm = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, k, dtype=np.int32)), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), perm], names=["vec_id", "v", "perm"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, perm array<short>")


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _parts(counts: dict[int, int], size: int, n: int) -> Column:
    """For each pivot into how many parts it is salted."""
    return F.array(*(F.lit(max(1, -(-counts.get(p, 0) // size))) for p in range(n)))


def _search(found: DataFrame, ask: DataFrame, n_pivots: int, prefix: int, probe: int, post: int, share: float, k: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest of every file that a query opens."""
    posted = found.select("vec_id", "v", "perm", F.explode(F.slice("perm", 1, post)).alias("pivot"))
    opened = ask.select(F.col("vec_id").alias("query_id"), F.col("v").alias("x"), F.col("perm").alias("order"), F.explode(F.slice("perm", 1, probe)).alias("pivot"))
    sizes = {r.pivot: r["count"] for r in found.select(F.explode(F.slice("perm", 1, post)).alias("pivot")).groupBy("pivot").count().collect()}
    loads = {r.pivot: r["count"] for r in ask.select(F.explode(F.slice("perm", 1, probe)).alias("pivot")).groupBy("pivot").count().collect()}
    salts, blocks = _parts(sizes, CELL, n_pivots), _parts(loads, QUERIES, n_pivots)
    part = lambda a, hashed: F.pmod(F.xxhash64(hashed), F.get(a, F.col("pivot")))
    every = lambda a: F.explode(F.sequence(F.lit(0).cast("long"), F.get(a, F.col("pivot")).cast("long") - 1))
    # salted by vector and id, so copies of one vector and rows of one id spread too
    left = posted.withColumn("salt", part(salts, F.xxhash64("vec_id", "v"))).withColumn("block", every(blocks))
    right = opened.withColumn("block", part(blocks, F.col("query_id"))).withColumn("salt", every(salts))

    def run(cell: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(cell) and len(queries):
            order = np.argsort(cell["vec_id"].to_numpy(), kind="stable")
            ids = cell["vec_id"].to_numpy()[order]
            v, perm = _matrix(cell["v"])[order], _matrix(cell["perm"])[order]
            places = np.full((len(ids), n_pivots), prefix, np.int16)
            np.put_along_axis(places, perm.astype(np.int64), np.arange(perm.shape[1], dtype=np.int16)[None, :].repeat(len(ids), 0), 1)
            places = np.ascontiguousarray(places.T)
            asked, own = _matrix(queries["x"]), _matrix(queries["order"]).astype(np.int64)
            # rows of one id stand together; ``start`` is where each id's begin
            start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            owner = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(ids)]))
            keep = max(LEAST, int(np.ceil(share * len(start))))
            at = np.arange(own.shape[1], dtype=np.int16)[:, None]
            for q, (name, x) in enumerate(zip(queries["query_id"].to_numpy(), asked, strict=True)):
                near = np.arange(len(ids))
                if keep < len(start):
                    got = places[own[q]]
                    # pivots in both prefixes count once; what is left of the sum is the same for all
                    footrule = np.abs(got - at).sum(0, dtype=np.int64) - (prefix - got).sum(0, dtype=np.int64)
                    least = np.minimum.reduceat(footrule, start)
                    chosen = np.zeros(len(start), bool)
                    chosen[np.argpartition(least * len(start) + np.arange(len(start)), keep - 1)[:keep]] = True
                    near = np.flatnonzero(chosen[owner])
                near = near[ids[near] != name]
                score = np.sqrt(((v[near] - x) ** 2).sum(1))
                best = np.lexsort((ids[near], score))
                near, score = near[best], score[best]
                _, first = np.unique(ids[near], return_index=True)
                first = np.sort(first)[:k]
                out.append((np.full(len(first), name), ids[near[first]], score[first]))
        cat = lambda i, t: np.concatenate([x[i] for x in out]).astype(t) if out else np.empty(0, t)
        return pa.table({"query_id": cat(0, np.int64), "vec_id": cat(1, np.int64), "score": cat(2, np.float64)})

    keys = ("pivot", "salt", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(table: DataFrame, queries: Column, k: int = 10, n_pivots: int = PIVOTS, prefix: int = PREFIX, probe: int = PROBE, post: int = POST, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``table`` (vec_id, embedding) that ``queries`` selects by vec_id."""
    rows = vectors(table)
    piv = pivots(rows, n_pivots)
    if not len(piv):
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    prefix = min(prefix, len(piv))
    indexed = cut(permuted(rows.distinct(), piv, prefix), "ann-index")
    ask = indexed.where(queries)
    found = cut(_search(indexed, ask, len(piv), prefix, min(probe, prefix), min(post, prefix), share, k), "ann-found")
    have = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k)
    short = ask.join(have, ask["vec_id"] == have["query_id"], "left_anti")
    if not short.isEmpty():
        # the whole permutation, so that every file is opened
        again = short.withColumn("perm", F.concat("perm", F.array_except(F.array(*(F.lit(p).cast("short") for p in range(len(piv)))), F.col("perm"))))
        found = found.unionByName(_search_all(indexed, again, len(piv), k))
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return one.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_all(indexed: DataFrame, ask: DataFrame, n_pivots: int, k: int) -> DataFrame:
    """The exact search: every vector in one file, every file open, every vector reranked."""
    return _search(indexed, ask, n_pivots, n_pivots, n_pivots, 1, 1.0, k)
