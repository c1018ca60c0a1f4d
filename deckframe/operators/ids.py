"""Entity kinds, id offsets, and the resolution of references as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: entity kinds and the offset of an included file that shifts their ids.
BUCKETS = {
    "Node": "idnoff", "Element": "ideoff", "Part": "idpoff",
    "NodeSet": "idsoff", "PartSet": "idsoff", "SegmentSet": "idsoff", "ShellSet": "idsoff", "SolidSet": "idsoff", "BeamSet": "idsoff", "DiscreteSet": "idsoff",
    "Curve": "idfoff",
    "Material": "idmoff", "ThermalMaterial": "idmoff", "Eos": "idmoff",
    "Box": "iddoff", "Coord": "iddoff", "Vector": "iddoff", "Transform": "iddoff", "Define": "iddoff",
    "Section": "idroff", "Hourglass": "idroff", "Sensor": "idroff",
}
OFFSETS = ("idnoff", "ideoff", "idpoff", "idmoff", "idsoff", "idfoff", "iddoff", "idroff")


def shifted(raw: Column, offset: Column) -> Column:
    """An id moved away from zero by an offset, its sign kept; 0 stays 0."""
    return F.when(raw == 0, F.lit(0).cast("long")).otherwise((F.signum(raw).cast("long") * (F.abs(raw) + offset)).cast("long"))


def offset_of(kind: Column, offsets: Column) -> Column:
    """The offset of a kind from a struct of the eight offsets."""
    out = F.lit(0).cast("long")
    for bucket in OFFSETS:
        kinds = [k for k, b in BUCKETS.items() if b == bucket]
        out = F.when(kind.isin(kinds), offsets[bucket]).otherwise(out)
    return out


def shift(raw: int, offset: int) -> int:
    """``shifted`` for plain numbers."""
    return 0 if raw == 0 else (abs(raw) + offset) * (1 if raw > 0 else -1)


#: Rows of ids up to which they are sent to all tasks (some 40 bytes each).
FEW = 500_000
#: Rows of ids up to which they pass through the driver, which keeps the plans behind them small.
LOCAL = 10_000


#: Frames of ids that are kept until ``forget``.
_kept: list[DataFrame] = []


def keep(ids: DataFrame) -> DataFrame:
    """``ids``, computed once, for frames that are read several times."""
    _kept.append(ids.persist())
    return ids


def few_or_not(ids: DataFrame) -> DataFrame:
    """``ids``, computed: a local frame if it is very few rows, else kept, to be broadcast if it is few and joined by shuffle if it is not."""
    some = ids.limit(LOCAL + 1).toArrow()
    if some.num_rows <= LOCAL:
        return F.broadcast(ids.sparkSession.createDataFrame(some))
    return F.broadcast(ids) if keep(ids).count() <= FEW else ids


def forget() -> None:
    """Lets go of all frames that are kept; one that is asked for again is computed again."""
    while _kept:
        _kept.pop().unpersist()


def dangling(refs: DataFrame, defs: DataFrame, scope: Sequence[str] = (), few: bool = False, tracked: DataFrame | None = None) -> DataFrame:
    """References (kind, id, ...) to one kind each that nothing defines.

    A left-anti join on (scope, kind, id), trying also the id without its sign. Conservative: a kind
    of which the scope defines nothing is not judged. The distinct ids are resolved first, so the
    many rows that refer to one entity are joined once, by the few ids that fail. With ``few`` those
    ids are computed first and counted, and if they are few the references are not shuffled.
    ``tracked`` (scope, kind) spares a look at all definitions, where it is known otherwise.
    """
    on = [*scope, "kind"]
    known = defs.select(*on, "id").distinct()
    tracked = known.select(*on).distinct() if tracked is None else tracked
    if not scope:
        tracked = F.broadcast(tracked)  # a row a kind
    asked = refs.select(*on, "id").distinct().join(tracked, on, "left_semi")
    failed = asked.join(known, [*on, "id"], "left_anti")
    again = failed.where("id < 0").withColumn("_signed", F.col("id")).withColumn("id", -F.col("id"))
    saved = again.join(known, [*on, "id"], "left_semi").select(*on, F.col("_signed").alias("id"))
    left = failed.join(saved, [*on, "id"], "left_anti")
    return refs.join(few_or_not(left) if few else left, [*on, "id"], "left_semi")


def dangling_any(refs: DataFrame, defs: DataFrame, key: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """References that may name any of several kinds: ``candidates`` array<struct<kind, id>>.

    One is flagged if some candidate's kind is tracked and no candidate is defined. ``key`` names a
    reference; candidates are exploded, joined, and folded to one row a reference.
    """
    on = [*scope, "kind"]
    known = defs.select(*on, "id").distinct().withColumn("_hit", F.lit(1))
    tracked = defs.select(*on).distinct().withColumn("_tracked", F.lit(1))
    each = refs.select(*scope, *key, F.explode("candidates").alias("c")).select(*scope, *key, "c.kind", "c.id")
    both = each.select("*", F.explode(F.array_distinct(F.array("id", F.abs("id")))).alias("_try")).drop("id").withColumnRenamed("_try", "id")
    found = both.join(known, [*on, "id"], "left").join(tracked, on, "left")
    fold = found.groupBy(*scope, *key).agg(F.max("_hit").alias("_hit"), F.max("_tracked").alias("_tracked"))
    bad = fold.where("_hit is null and _tracked = 1").select(*scope, *key)
    return refs.join(bad, [*scope, *key], "left_semi")


def duplicates(defs: DataFrame, scope: Sequence[str] = (), sites: Sequence[str] = ("file_idx", "block_idx")) -> DataFrame:
    """Definitions whose (scope, kind, id) is defined more than once, every site with the count ``n``."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*scope, "kind", "id"))
    return defs.select(*scope, "kind", "id", *sites).withColumn("n", n).where("n > 1")


def unreferenced(defs: DataFrame, refs: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Definitions that no reference names, with or without its sign."""
    used = refs.select(*scope, "kind", F.abs("id").alias("id")).distinct()
    return defs.withColumn("_abs", F.abs("id")).join(used.withColumnRenamed("id", "_abs"), [*scope, "kind", "_abs"], "left_anti").drop("_abs")


def first_sites(defs: DataFrame, order: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """One definition for each (scope, kind, id): the first in order."""
    w = Window.partitionBy(*scope, "kind", "id").orderBy(*order)
    return defs.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def census(defs: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """How many different ids each kind has, most first."""
    return defs.groupBy(*scope, "kind").agg(F.count_distinct("id").alias("n")).orderBy(*scope, F.desc("n"), "kind")


def deck_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """kind, n_a, n_b: two censuses side by side, 0 where a kind is missing."""
    left, right = a.select("kind", F.col("n").alias("n_a")), b.select("kind", F.col("n").alias("n_b"))
    return left.join(right, "kind", "full_outer").select("kind", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
