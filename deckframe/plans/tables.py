"""The operators over the star-schema tables.

Series are ``events`` by user (1 ms a sample); entities are the dimension tables; connectivity is
``lineitem``; a tensor is six numbers of a ``lineitem`` row, its state the line number, its part
the supplier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckframe.functions import filters, injury, series, shell, tensor, text
from deckframe.operators import ids, predicates, reductions
from deckframe.operators.predicates import all_, any_, field, not_

DT = 1e-3
#: Fixed value: no product of it with a few decimals ends in a 5 that rounding could take either way.
SCALE = 0.7390851332151607
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return series.indexed(e, ["user_id"], "ts", "event_id").select("user_id", "i", "value", "event_type")


def _round(name: str, digits: int = 6) -> F.Column:  # type: ignore[name-defined]
    return F.round(name, digits).alias(name)


def _kind(df: DataFrame, kind: str, column: str, shift: int = 0) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), (F.col(column) + shift).cast("long").alias("id"))


def _defs(spark: SparkSession, sf: str) -> DataFrame:
    out = _kind(_t(spark, sf, "orders"), "Order", "o_orderkey")
    for table, kind, key in (("part", "Part", "p_partkey"), ("supplier", "Supplier", "s_suppkey"), ("customer", "Customer", "c_custkey")):
        out = out.unionByName(_kind(_t(spark, sf, table), kind, key))
    return out


# references ---------------------------------------------------------------------------------


@_query
def references_resolve(spark: SparkSession, sf: str) -> DataFrame:
    refs = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit("Order").alias("kind"), (F.col("l_orderkey") + 100).alias("id"))
    return ids.dangling(refs, _defs(spark, sf)).select("l_orderkey", "l_linenumber", "kind", "id")


@_query
def references_resolve_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    cell = lambda kind, col, add: F.struct(F.lit(kind).alias("kind"), (F.col(col) + add).cast("long").alias("id"))
    refs = _t(spark, sf, "lineitem").select(F.posexplode(F.array(cell("Order", "l_orderkey", 100), cell("Part", "l_partkey", 50), cell("Supplier", "l_suppkey", 0))).alias("pos", "ref"))
    bad = ids.dangling(refs.select("pos", "ref.kind", "ref.id"), _defs(spark, sf))
    return bad.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n_refs"))


@_query
def references_polymorphic(spark: SparkSession, sf: str) -> DataFrame:
    own = (F.col("l_partkey") + F.col("l_suppkey")).cast("long")
    refs = _t(spark, sf, "lineitem").select(own.alias("ref_id")).distinct()
    cells = [F.struct(F.lit(k).alias("kind"), F.col("ref_id").alias("id")) for k in ("Part", "Customer", "Widget")]
    return ids.dangling_any(refs.withColumn("candidates", F.array(*cells)), _defs(spark, sf), ["ref_id"]).select("ref_id")


@_query
def references_untracked_kind(spark: SparkSession, sf: str) -> DataFrame:
    refs = _t(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") == 1, "Order").otherwise("Widget").alias("kind"), (F.col("l_orderkey") + 100).alias("id"))
    bad = ids.dangling(refs, _defs(spark, sf))
    return bad.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@_query
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    defs = _t(spark, sf, "lineitem").select(F.concat_ws(":", F.lit("Line"), F.col("l_linenumber").cast("string")).alias("kind"), F.col("l_orderkey").alias("id"), "l_partkey")
    return ids.duplicates(defs, sites=["l_partkey"])


@_query
def unreferenced_entities(spark: SparkSession, sf: str) -> DataFrame:
    refs = _kind(_t(spark, sf, "lineitem").where("l_quantity >= 48"), "Part", "l_partkey")
    return ids.unreferenced(_kind(_t(spark, sf, "part"), "Part", "p_partkey"), refs)


@_query
def first_site_wins(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part").select(F.lit("Brand").alias("kind"), F.col("p_brand").alias("id"), "p_partkey", "p_name")
    return ids.first_sites(p, ["p_partkey"]).select("id", "p_partkey", "p_name")


@_query
def definition_census(spark: SparkSession, sf: str) -> DataFrame:
    return ids.census(_defs(spark, sf))


@_query
def deck_diff(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda seg: ids.census(_t(spark, sf, "customer").where(F.col("c_mktsegment") == seg).select(F.col("c_nationkey").cast("string").alias("kind"), F.col("c_custkey").alias("id")))
    return ids.deck_diff(one("BUILDING"), one("MACHINERY"))


@_query
def include_transform_apply(spark: SparkSession, sf: str) -> DataFrame:
    offsets = F.struct(*(F.lit(1000 * (k + 1)).cast("long").alias(o) for k, o in enumerate(ids.OFFSETS)))
    kind = F.element_at(F.array(*(F.lit(k) for k in ("Node", "Part", "Curve", "Section", "NodeSet", "Material"))), F.pmod(F.col("c_custkey"), F.lit(6)).cast("int") + 1)
    raw = (F.col("c_custkey") - 700).cast("long")
    return _t(spark, sf, "customer").select("c_custkey", kind.alias("kind"), ids.shifted(raw, ids.offset_of(kind, offsets)).alias("logical_id"))


# rules --------------------------------------------------------------------------------------


def _where(df: DataFrame, p: predicates.Predicate) -> DataFrame:
    return df.where(predicates.over_columns(p, dict(df.dtypes)))


@_query
def predicate_tree(spark: SparkSession, sf: str) -> DataFrame:
    p = all_(any_(field("l_quantity", ">=", 45), field("l_discount", "<", 0.01)), not_(field("l_linestatus", "==", "O")), not_(field("missing", ">", 1)))
    return _where(_t(spark, sf, "lineitem"), p).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


# text ---------------------------------------------------------------------------------------


@_query
def table_fixed_reparse(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part")
    line = F.format_string("%8d%16.6f%8d", "p_partkey", "p_retailprice", "p_size")
    cards = p.select(line.alias("line"))
    return cards.select(
        F.coalesce(text.int_of(F.substring("line", 1, 8)), F.lit(0)).alias("nid"),
        F.coalesce(text.float_of(F.substring("line", 9, 16)), F.lit(0.0)).alias("x"),
        F.coalesce(text.int_of(F.substring("line", 25, 8)), F.lit(0)).alias("tc"),
    )


@_query
def table_free_reparse(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "supplier").select(F.concat_ws(",", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.lit("abc")).alias("line"))
    token = F.split("line", ",")
    return s.select(*(F.coalesce(text.int_of(F.get(token, F.lit(k))), F.lit(0)).alias(n) for k, n in enumerate(("id", "nation", "text", "absent"))))


@_query
def fortran_float_parse(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("n_nationkey"), F.pmod(F.col("n_nationkey"), F.lit(5))
    mantissa = F.concat(n.cast("string"), F.lit(".25"))
    spelled = (
        F.when(k == 0, F.concat(mantissa, F.lit("-2"))).when(k == 1, F.concat(mantissa, F.lit("D+3")))
        .when(k == 2, F.concat(F.lit(" -"), mantissa, F.lit("d-2 "))).when(k == 3, F.concat(mantissa, F.lit("d"))).otherwise(F.concat(mantissa, F.lit("+1")))
    )
    return _t(spark, sf, "nation").select("n_nationkey", F.round(text.float_of(spelled), 6).alias("x"))


@_query
def canonical_base(spark: SparkSession, sf: str) -> DataFrame:
    k = F.pmod(F.col("p_partkey"), F.lit(4))
    name = F.concat(F.translate(F.lower("p_type"), " ", "_"), F.when(k == 0, "_title").when(k == 1, "_ID_TITLE").when(k == 2, "_id").otherwise(""))
    return _t(spark, sf, "part").select("p_partkey", text.base_of(name).alias("base"))


# series -------------------------------------------------------------------------------------


@_query
def integrate(spark: SparkSession, sf: str) -> DataFrame:
    return series.integrate(_samples(spark, sf), "value", DT, ["user_id"]).select("user_id", "i", _round("integral"))


@_query
def integrate_over(spark: SparkSession, sf: str) -> DataFrame:
    t = _samples(spark, sf).withColumn("t", F.col("i") * DT + F.col("i") * F.col("i") * 1e-5)
    return series.integrate_over(t, "t", "value", ["user_id"]).select("user_id", "i", _round("integral", 8))


@_query
def differentiate(spark: SparkSession, sf: str) -> DataFrame:
    return series.differentiate(_samples(spark, sf), "value", DT, ["user_id"]).select("user_id", "i", _round("derivative", 4))


@_query
def decimate(spark: SparkSession, sf: str) -> DataFrame:
    return series.decimate(_samples(spark, sf), 4).select("user_id", "i", "value")


@_query
def resample_linear(spark: SparkSession, sf: str) -> DataFrame:
    return series.resample_linear(_samples(spark, sf), "value", 1.0, 2.5, ["user_id"]).select("user_id", "i", _round("value"))


@_query
def clip_3ms(spark: SparkSession, sf: str) -> DataFrame:
    return injury.clip(_samples(spark, sf), "value", DT, ["user_id"], 0.003)


@_query
def severity_index(spark: SparkSession, sf: str) -> DataFrame:
    return injury.severity_index(_samples(spark, sf), "value", DT, ["user_id"]).select("user_id", _round("severity_index", 4))


@_query
def hic15(spark: SparkSession, sf: str) -> DataFrame:
    return injury.hic15(_samples(spark, sf), "value", DT, ["user_id"]).select("user_id", _round("hic15", 4))


@_query
def vc(spark: SparkSession, sf: str) -> DataFrame:
    scaled = _samples(spark, sf).withColumn("value", F.col("value") * SCALE)
    return injury.vc(scaled, "value", DT, ["user_id"], 1.0, 0.229).select("user_id", _round("vc", 5))


@_query
def nic(spark: SparkSession, sf: str) -> DataFrame:
    two = _samples(spark, sf).withColumn("head", F.col("value") * 0.5)
    return injury.nic(two, "value", "head", DT, ["user_id"]).select("user_id", _round("nic"))


def _loads(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").select(
        "l_suppkey", (F.col("l_quantity") - 25).alias("fx"), (F.col("l_extendedprice") / 10 - 2500).alias("fz"), (F.col("l_discount") * 1000 - 50).alias("my"), (F.col("l_tax") * 1000).alias("mx"),
    )


@_query
def nij(spark: SparkSession, sf: str) -> DataFrame:
    return injury.nij(_loads(spark, sf), "fx", "fz", "my", ["l_suppkey"], 0.0178, 6806.0, -6160.0, 310.0, -135.0).select("l_suppkey", _round("nij"))


@_query
def tibia_index(spark: SparkSession, sf: str) -> DataFrame:
    return injury.tibia_index(_loads(spark, sf), "mx", "my", "fz", ["l_suppkey"], 225.0, -35900.0).select("l_suppkey", _round("tibia_index"))


@_query
def bric(spark: SparkSession, sf: str) -> DataFrame:
    return injury.bric(_loads(spark, sf), ["fx", "my", "mx"], [66.25, 56.45, 42.87], ["l_suppkey"]).select("l_suppkey", _round("bric"))


@_query
def ubric(spark: SparkSession, sf: str) -> DataFrame:
    return injury.ubric(_loads(spark, sf), ["fx", "my", "mx"], ["fz", "fx", "my"], [66.25, 56.45, 42.87], [12000.0, 50.0, 40.0], ["l_suppkey"]).select("l_suppkey", _round("ubric"))


@_query
def resultant(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(tensor.resultant(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")), 6).alias("resultant"))


@_query
def time_series_extract(spark: SparkSession, sf: str) -> DataFrame:
    out = series.extract(_samples(spark, sf).withColumn("t", F.col("i") * DT), "t", "value", ["user_id"])
    return out.select("user_id", *(_round(c) for c in ("last", "first", "max", "min", "abs_max", "mean", "integral")))


@_query
def filtfilt_cfc(spark: SparkSession, sf: str) -> DataFrame:
    return filters.cfc(_samples(spark, sf).select("user_id", "i", "value"), ["value"], ["user_id"], 60.0, DT).select("user_id", "i", _round("value"))


# tensors and parts --------------------------------------------------------------------------


def _tensors(spark: SparkSession, sf: str) -> DataFrame:
    q, e, d, t = (F.col(f"l_{x}") for x in ("quantity", "extendedprice", "discount", "tax"))
    return _t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        q.alias("xx"), (e / 2000).alias("yy"), (d * 200).alias("zz"), (t * 100).alias("xy"), ((q - 25) * d).alias("yz"), (e / 10000 * t).alias("zx"),
    )


def _six() -> list:
    return [F.col(c) for c in ("xx", "yy", "zz", "xy", "yz", "zx")]


@_query
def von_mises(spark: SparkSession, sf: str) -> DataFrame:
    return _tensors(spark, sf).select("l_orderkey", "l_linenumber", F.round(tensor.von_mises(*_six()), 6).alias("von_mises"))


@_query
def pressure(spark: SparkSession, sf: str) -> DataFrame:
    return _tensors(spark, sf).select("l_orderkey", "l_linenumber", F.round(tensor.pressure(*_six()[:3]), 6).alias("pressure"))


@_query
def triaxiality(spark: SparkSession, sf: str) -> DataFrame:
    return _tensors(spark, sf).select("l_orderkey", "l_linenumber", F.round(tensor.triaxiality(*_six()), 6).alias("triaxiality"))


@_query
def principal(spark: SparkSession, sf: str) -> DataFrame:
    out = tensor.with_principal(_tensors(spark, sf), [c * SCALE for c in _six()], ("l1", "l2", "l3"))
    return out.select("l_orderkey", "l_linenumber", *(_round(c, 5) for c in ("l1", "l2", "l3")))


@_query
def max_shear(spark: SparkSession, sf: str) -> DataFrame:
    out = tensor.with_principal(_tensors(spark, sf), [c * SCALE for c in _six()], ("l1", "l2", "l3"))
    return out.select("l_orderkey", "l_linenumber", F.round(tensor.half_range("l1", "l3"), 5).alias("max_shear"))


@_query
def part_max_history(spark: SparkSession, sf: str) -> DataFrame:
    out = reductions.part_max(_tensors(spark, sf), tensor.von_mises(*_six()), ["l_suppkey", "l_linenumber"])
    return out.select("l_suppkey", "l_linenumber", _round("value"))


@_query
def part_percentile_history(spark: SparkSession, sf: str) -> DataFrame:
    out = reductions.part_percentile(_tensors(spark, sf), F.col("yy"), 95.0, ["l_suppkey", "l_linenumber"])
    return out.select("l_suppkey", "l_linenumber", _round("value", 8))


@_query
def part_failure_fraction(spark: SparkSession, sf: str) -> DataFrame:
    out = reductions.part_fraction(_tensors(spark, sf), F.col("yy"), 20.0, ["l_suppkey", "l_linenumber"])
    return out.select("l_suppkey", "l_linenumber", _round("value", 9))


@_query
def part_argmax(spark: SparkSession, sf: str) -> DataFrame:
    out = reductions.part_argmax(_tensors(spark, sf), F.col("xx"), "l_partkey", ["l_suppkey", "l_linenumber"])
    return out.select("l_suppkey", "l_linenumber", "l_partkey", "value")


@_query
def shell_layer_max(spark: SparkSession, sf: str) -> DataFrame:
    layout = shell.ShellLayout(n_layers=8, stride=8)
    v = F.col("embedding").cast("array<double>")
    return _t(spark, sf, "embeddings").select(
        "vec_id", F.round(shell.shell_von_mises(v, layout), 6).alias("worst"), F.round(shell.shell_von_mises(v, layout, shell.TOP), 6).alias("top"),
        F.round(shell.shell_plastic_strain(v, layout), 6).alias("strain"),
    )


@_query
def state_matrix_pivot(spark: SparkSession, sf: str) -> DataFrame:
    e = _samples(spark, sf)
    out = reductions.state_matrix(e, "i", "event_type", F.col("value"), ["click", "error", "purchase", "view"])
    return out.select("i", *(F.round(c, 6).alias(c) for c in ("click", "error", "purchase", "view")))


# grouping beyond what decks need ------------------------------------------------------------


@_query
def census_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Grouping sets over (segment, nation), as a census of several decks at once would take."""
    cube = _t(spark, sf, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("n_ids"))
    return cube.select(F.coalesce("c_mktsegment", F.lit("all")).alias("c_mktsegment"), F.coalesce("c_nationkey", F.lit(-1)).alias("c_nationkey"), "n", "n_ids")


# order and sets -----------------------------------------------------------------------------


@_query
def top_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """The ten largest samples, ties to the smaller user and index: a partial top-k in every task."""
    s = _samples(spark, sf).select("user_id", "i", "value")
    return s.orderBy(F.desc("value"), "user_id", "i").limit(10)


@_query
def ids_intersect(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that returned lines and open lines have in common."""
    one = lambda column, flag: _t(spark, sf, "lineitem").where(F.col(column) == flag).select("l_partkey")
    return one("l_returnflag", "R").intersect(one("l_linestatus", "O"))


@_query
def ids_except(spark: SparkSession, sf: str) -> DataFrame:
    """Parts without a line of large quantity, as a set difference."""
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id")).exceptAll(_t(spark, sf, "lineitem").where("l_quantity >= 48").select(F.col("l_partkey").alias("id")).distinct())


@_query
def files_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct hosts of pages, with how many pages each has."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return _t(spark, sf, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"))
