"""The deck and result-file operators over files that are written from the tables first.

A deck: nodes from ``orders``, shells from ``lineitem``, parts from ``part``, sections from part
sizes and ``region``, materials from ``supplier`` (included at an offset), constraints from
``customer``; some ids have no definition. Result files hold aggregates of ``events`` and
``lineitem``. Files are written once for each session and table folder, below the folder that the
session names in ``spark.checkpoint.dir``, and read by the operators themselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckframe import author, library, rules
from deckframe.deck import Deck, parse_deck, parse_keyword_file
from deckframe.functions import tensor
from deckframe.operators.predicates import field
from deckframe.plans.tables import QUERIES as TABLE_QUERIES
from deckframe.plans.tables import Query, _t
from deckframe.sources import lsda
from deckframe.sources.binout import Binout, append
from deckframe.sources.d3plot import D3plot, Writer
from deckframe.streaming import results
from deckframe.workspace import Workspace

QUERIES: dict[str, Query] = {}
_made: dict[tuple, object] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _once(what: str, spark: SparkSession, sf: str, make):  # noqa: ANN001, ANN202
    """What ``make`` gives for a new folder, kept for the session and the tables."""
    key = (what, spark.sparkContext.applicationId, sf)
    if key not in _made:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="deckframe-")
        folder = f"{shared.rstrip('/').removeprefix('file://').removeprefix('file:')}/{what}-{uuid.uuid4().hex}"
        os.makedirs(folder)
        _made[key] = make(folder)
    return _made[key]


def _write(path: str, text: str) -> None:
    with open(path, "w") as f:
        f.write(text)


def _include(paths: list[str], folder: str) -> str:
    return "".join(f"*INCLUDE\n{os.path.relpath(p, folder)}\n" for p in paths)


def _tens(*cells: str) -> F.Column:  # type: ignore[name-defined]
    return F.format_string("%10d" * len(cells), *(F.expr(c).cast("long") for c in cells))


# one deck of everything -----------------------------------------------------------------------


def _deck(spark: SparkSession, sf: str) -> Deck:
    def make(folder: str) -> Deck:
        order = _t(spark, sf, "orders").select("o_orderkey", F.concat_ws(",", F.col("o_orderkey") + 1, "o_totalprice", F.col("o_custkey").cast("double"), F.col("o_custkey") / 4.0).alias("value"))
        nodes = author.write_lines(order, f"{folder}/nodes", ["o_orderkey"], "*KEYWORD\n*NODE")
        k = F.col("l_orderkey")
        part = F.col("l_partkey") + 1 + F.when(F.col("l_linenumber") == 7, 50).otherwise(0)
        keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
        shell = _t(spark, sf, "lineitem").select(*keys, F.concat_ws(",", k * 10 + F.col("l_linenumber"), part, k + 1, k + 2, k + 51, k + 101).alias("value"))
        shells = author.write_lines(shell, f"{folder}/shells", keys, "*KEYWORD\n*ELEMENT_SHELL")
        card = F.concat(F.lit("*PART\n"), "p_name", F.lit("\n"), _tens("p_partkey + 1", "p_size", "1000 + p_partkey % 120 + 1"))
        parts = author.write_lines(_t(spark, sf, "part").select("p_partkey", card.alias("value")), f"{folder}/parts", ["p_partkey"])
        section = _t(spark, sf, "part").where("p_size <= 40").select(F.col("p_size").cast("long").alias("id")).distinct()
        section = section.unionByName(_t(spark, sf, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id")))
        section = section.select("id", F.concat(F.lit("$ a section\n*SECTION_SHELL\n"), _tens("id", "2")).alias("value"))
        sections = author.write_lines(section, f"{folder}/sections", ["id"])
        times = F.explode(F.when(F.col("s_suppkey") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k")
        name = F.when((F.col("k") == 1) | (F.col("s_nationkey") < 5), F.lit("*MAT_RIGID\n")).otherwise(F.concat(F.lit("*MAT_ELASTIC_TITLE\n"), "s_name", F.lit("\n")))
        mat = _t(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_name", times)
        mats = author.write_lines(mat.select("s_suppkey", "k", F.concat(name, _tens("s_suppkey + 1"), F.lit("   7.8e-9")).alias("value")), f"{folder}/mats", ["s_suppkey", "k"])
        spc = F.concat(F.lit("*BOUNDARY_SPC_NODE\n"), _tens("c_custkey * 11 + 1", "0", "c_nationkey % 3"), F.lit("\n*CONSTRAINED_RIGID_BODIES\n"), _tens("c_custkey + 1", "(c_custkey % 50 + 1) * if(c_custkey % 2 = 0, -1, 1)"))
        spcs = author.write_lines(_t(spark, sf, "customer").select("c_custkey", spc.alias("value")), f"{folder}/spcs", ["c_custkey"])
        zeros = "".join(f"{x:>10}" for x in (0, 0, 0, 1000, 0, 0, 0)) + f"\n{0:>10}\n"
        moved = "".join(f"*INCLUDE_TRANSFORM\n{os.path.relpath(p, folder)}\n{zeros}" for p in mats)
        _write(f"{folder}/root.k", "*KEYWORD\n*CONTROL_TERMINATION\n      10.0\n" + _include(nodes + shells + parts + sections, folder) + moved + _include(spcs, folder) + "*INCLUDE\nmissing.k\n*END\n")
        return parse_deck(spark, f"{folder}/root.k")

    return _once("deck", spark, sf, make)


def _found(spark: SparkSession, sf: str, *of: rules.Rule) -> DataFrame:
    """The findings of rules, with how often each message comes."""
    return rules.validate(_deck(spark, sf), list(of)).groupBy("rule", "severity", "keyword", "message").agg(F.count(F.lit(1)).alias("n"))


@_query
def deck_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _deck(spark, sf).table("NODE").select("nid", "x", "y", "z")


@_query
def deck_shells(spark: SparkSession, sf: str) -> DataFrame:
    return _deck(spark, sf).table("ELEMENT_SHELL").select("eid", "pid", "n1", "n2", "n3", "n4", "n5")


@_query
def deck_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _deck(spark, sf).table("PART").select("heading", "pid", "secid", "mid", "eosid")


@_query
def deck_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """A table of many keywords of one card each."""
    return _deck(spark, sf).table("BOUNDARY_SPC_NODE").select("nid", "cid", "dofx")


@_query
def deck_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords by name, apart from those that each file has."""
    own = _deck(spark, sf).blocks.where(~F.col("base").isin("KEYWORD", "INCLUDE", "INCLUDE_TRANSFORM", "END", "NODE", "ELEMENT_SHELL"))
    return own.groupBy("name", "base", "title_offset").agg(F.count(F.lit(1)).alias("n"))


@_query
def deck_definition_census(spark: SparkSession, sf: str) -> DataFrame:
    return _deck(spark, sf).definition_counts()


@_query
def deck_references(spark: SparkSession, sf: str) -> DataFrame:
    """References of cards at their offsets, by keyword and field."""
    each = _deck(spark, sf).references.select("keyword", F.upper("field").alias("field"), F.col("candidates")[0].alias("c"))
    return each.groupBy("keyword", "field", "c.kind").agg(F.count(F.lit(1)).alias("n"), F.sum("c.id").alias("ids"))


@_query
def deck_first_sites(spark: SparkSession, sf: str) -> DataFrame:
    return _deck(spark, sf).sites.where("kind = 'Material'").select("id", "phys_id", "keyword")


@_query
def rule_references_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, rules.references_resolve())


@_query
def rule_references_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, rules.references_resolve(connectivity=True))


@_query
def rule_duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, rules.duplicate_ids())


@_query
def rule_unreferenced_entities(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, rules.unreferenced_entities(["Section", "Material"]))


@_query
def rigid_context(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, rules.rigid_context())


@_query
def keyword_forbidden(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, rules.keyword_forbidden("mat_elastic"))


@_query
def field_forbidden_values(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, rules.field_forbidden_values("BOUNDARY_SPC_NODE", "dofx", [2, 7]))


@_query
def field_required_when(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, rules.field_required("PART", field("secid", "<=", 30), when=field("MID", ">", 1060)))


@_query
def rule_include_missing(spark: SparkSession, sf: str) -> DataFrame:
    found = rules.validate(_deck(spark, sf), [rules.include_missing()])
    return found.select("keyword", "line", F.regexp_extract("message", "^(.*: )", 1).alias("said"))


@_query
def file_scope_only(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, rules.keyword_forbidden("PART").only_in("/PARTS/"), rules.keyword_forbidden("SECTION_SHELL").only_in("/parts/"))


@_query
def file_scope_except(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, rules.keyword_forbidden("PART").except_in("/parts/"), rules.keyword_forbidden("SECTION_SHELL").except_in("/PARTS/"))


@_query
def severity_report(spark: SparkSession, sf: str) -> DataFrame:
    own = [rules.duplicate_ids(), rules.unreferenced_entities(["Section"]), rules.keyword_forbidden("MAT_RIGID").with_severity(rules.INFO)]
    return rules.counts(rules.validate(_deck(spark, sf), own)).withColumnRenamed("count", "n")


@_query
def deck_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What the deck itself counts, beside what its frame of files says."""
    deck = _deck(spark, sf)
    own = deck.files.agg(F.count(F.lit(1)).alias("files"), F.sum("byte_count").alias("bytes"))
    return own.select((F.col("files") == deck.total_files).alias("files"), (F.col("bytes") == deck.total_bytes).alias("bytes"), F.lit(len(deck.missing_includes())).cast("long").alias("missing"))


@_query
def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Sections by navigation: a keyword's handle, its id and a field. A deck has few of them."""
    rows = [(k.id, k.field("ELFORM").as_int()) for k in _deck(spark, sf).entities("Section")]
    return spark.createDataFrame(rows, "id long, elform long")


@_query
def reference_follow(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with the keyword of the material that their reference resolves to, as a join of references and sites."""
    deck = _deck(spark, sf)
    at = ["file_idx", "block_idx"]
    part = deck.definitions.where("kind = 'Part'").select(*at, F.col("id").alias("pid"))
    mid = deck.references.where("keyword = 'PART' and field = 'mid'").select(*at, F.col("candidates")[0]["id"].alias("id"))
    return part.join(mid, at).join(deck.sites.where("kind = 'Material'").select("id", "keyword"), "id").select("pid", F.col("id").alias("mid"), "keyword")


# a tree of includes ---------------------------------------------------------------------------


def _tree(spark: SparkSession, sf: str) -> Deck:
    """A file for each region and, below, for each nation, with a node each, at added offsets: two small tables."""
    def make(folder: str) -> Deck:
        def moved(name: str, offset: int) -> str:
            return f"*INCLUDE_TRANSFORM\n{name}\n{offset:>10}" + f"{0:>10}" * 6 + f"\n{0:>10}\n"

        regions = sorted(r.r_regionkey for r in _t(spark, sf, "region").select("r_regionkey").collect())
        nations = sorted((r.n_regionkey, r.n_nationkey) for r in _t(spark, sf, "nation").select("n_regionkey", "n_nationkey").collect())
        os.makedirs(f"{folder}/sub")
        _write(f"{folder}/root.k", "*KEYWORD\n*INCLUDE_PATH_RELATIVE\nsub\n" + "".join(moved(f"region_{r}.k", 10_000 * (r + 1)) for r in regions) + "*END\n")
        for r in regions:
            _write(f"{folder}/sub/region_{r}.k", "*KEYWORD\n" + "".join(moved(f"nation_{n}.k", 100 * (n + 1)) for q, n in nations if q == r))
        for _, n in nations:
            _write(f"{folder}/sub/nation_{n}.k", f"*KEYWORD\n$ a node\n*NODE\n{n + 1},{n}.5,0,0\n$ and what refers to it\n*BOUNDARY_SPC_NODE\n{n + 1:>10}{0:>10}{1:>10}\n\n*BOUNDARY_SPC_NODE\n{77:>10}{0:>10}{n:>10}\n")
        return parse_deck(spark, f"{folder}/root.k")

    return _once("tree", spark, sf, make)


@_query
def include_tree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Files with what includes them."""
    own = _tree(spark, sf).files
    name = F.element_at(F.split("path", "/"), -1)
    up = own.select(F.col("file_idx").alias("parent_idx"), name.alias("parent"))
    return own.join(up, "parent_idx", "left").select(name.alias("name"), "parent", "depth", "kind", F.col("offsets.idnoff").alias("idnoff"))


@_query
def include_directives(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf).includes.groupBy("kind", "raw_path", "is_there").agg(F.count(F.lit(1)).alias("n"))


@_query
def include_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """A definition's line is its keyword's, plus its place among the data lines."""
    return _tree(spark, sf).definitions.select("kind", "id", "phys_id", "line")


@_query
def block_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every keyword with its line and its place in its file."""
    deck = _tree(spark, sf)
    return deck.blocks.where("base in ('NODE', 'BOUNDARY_SPC_NODE')").select(F.element_at(F.split("path", "/"), -1).alias("name"), "base", "block_idx", "line")


@_query
def finding_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = rules.validate(_tree(spark, sf), [rules.references_resolve()])
    return found.select(F.element_at(F.split("file", "/"), -1).alias("name"), "line", "message")


@_query
def set_field(spark: SparkSession, sf: str) -> DataFrame:
    """A field of every constraint of a file is set, the file written and read again."""
    deck = _tree(spark, sf)

    def make(folder: str) -> Deck:
        path = next(n.path for n in deck.nodes if n.path.endswith("/nation_0.k"))
        for k in deck.keywords("BOUNDARY_SPC_NODE"):
            if k.path == path:
                deck.set_field(k, "DOFZ", 7)
        deck.write(path, f"{folder}/out.k")
        deck.edits.clear()
        return parse_keyword_file(spark, f"{folder}/out.k")

    return _once("edited", spark, sf, make).table("BOUNDARY_SPC_NODE").select("nid", "dofx", "dofy", "dofz")


@_query
def write_keyword_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A frame is written as a deck of many files and read back."""
    def make(folder: str) -> Deck:
        lines = _t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("x"), F.max("l_tax").alias("y"), F.count(F.lit(1)).alias("z"))
        author.write_frame(lines.withColumn("l_partkey", F.col("l_partkey") + 1), folder, "NODE", ["l_partkey"])
        return parse_deck(spark, f"{folder}/root.k")

    return _once("written", spark, sf, make).table("NODE").select("nid", "x", "y", "z")


# layouts of one's own -------------------------------------------------------------------------

_LINK = library.schema("VENDOR_LINK", [[library.Field("wid"), library.Field("of", refs=("Part", "Material")), library.Field("load", library.FLOAT, 10, 2), library.Field("tag", library.STR)]])


def _linked(spark: SparkSession, sf: str) -> Deck:
    def make(folder: str) -> Deck:
        link = F.concat(F.lit("*VENDOR_LINK\n"), _tens("s_suppkey", "s_suppkey * 3 + 1"), F.format_string("%10.2f%10.2f%10s", F.col("s_acctbal"), F.col("s_nationkey").cast("double"), F.concat(F.lit("t"), F.col("s_nationkey").cast("string"))))
        links = author.write_lines(_t(spark, sf, "supplier").select("s_suppkey", link.alias("value")), f"{folder}/links", ["s_suppkey"])
        part = F.concat(F.lit("*PART\n"), "p_name", F.lit("\n"), _tens("p_partkey + 1", "0", "0"))
        parts = author.write_lines(_t(spark, sf, "part").where("p_size > 10").select("p_partkey", part.alias("value")), f"{folder}/parts", ["p_partkey"])
        _write(f"{folder}/root.k", "*KEYWORD\n" + _include(links + parts, folder) + "*END\n")
        deck = parse_deck(spark, f"{folder}/root.k")
        deck.register_schema(_LINK)
        return deck

    return _once("linked", spark, sf, make)


@_query
def user_schema(spark: SparkSession, sf: str) -> DataFrame:
    own = _linked(spark, sf).table_with(_LINK)
    return own.select("wid", "of", F.col("load")[0].alias("first"), F.col("load")[1].alias("second"), "tag")


@_query
def user_schema_polymorphic(spark: SparkSession, sf: str) -> DataFrame:
    """References that may name a part or a material (of which there is none)."""
    return rules.validate(_linked(spark, sf), [rules.references_resolve()]).select("keyword", "message")


# batches --------------------------------------------------------------------------------------


def _batch(spark: SparkSession, sf: str) -> Workspace:
    """A deck for each region, all over the same nodes, at an offset of their own for every second one."""
    def make(folder: str) -> Workspace:
        node = _t(spark, sf, "customer").select("c_custkey", F.concat_ws(",", F.col("c_custkey") + 1, "c_acctbal", F.lit("0,0")).alias("value"))
        nodes = author.write_lines(node, f"{folder}/nodes", ["c_custkey"], "*KEYWORD\n*NODE")
        _write(f"{folder}/mesh.k", "*KEYWORD\n" + _include(nodes, folder) + "*END\n")
        roots = []
        for r in sorted(x.r_regionkey for x in _t(spark, sf, "region").select("r_regionkey").collect()):
            zeros = f"{5000 * (r % 2):>10}" + f"{0:>10}" * 6 + f"\n{0:>10}\n"
            ids = (r * 40 + 1, 5000 + r * 40 + 1, 900_000 + r)
            spc = "".join(f"*BOUNDARY_SPC_NODE\n{i:>10}{0:>10}{1:>10}\n" for i in ids)
            curve = f"*DEFINE_CURVE\n{7:>10}\n" * (r + 1)
            _write(f"{folder}/main_{r}.k", f"*KEYWORD\n{spc}{curve}*INCLUDE_TRANSFORM\nmesh.k\n{zeros}*END\n")
            roots.append(f"{folder}/main_{r}.k")
        w = Workspace(spark)
        w.parse_decks(roots)
        return w

    return _once("batch", spark, sf, make)


@_query
def batch_dangling(spark: SparkSession, sf: str) -> DataFrame:
    return _batch(spark, sf).dangling().select("deck_id", "keyword", "field", "kind", "id")


@_query
def batch_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return _batch(spark, sf).duplicates().groupBy("deck_id", "kind", "id", "n").agg(F.count(F.lit(1)).alias("sites"))


@_query
def batch_census(spark: SparkSession, sf: str) -> DataFrame:
    return _batch(spark, sf).census()


@_query
def batch_validate(spark: SparkSession, sf: str) -> DataFrame:
    found = _batch(spark, sf).validate_decks([rules.references_resolve(), rules.duplicate_ids(), rules.keyword_forbidden("DEFINE_CURVE")])
    return found.groupBy("deck_id", "rule_seq", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@_query
def batch_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Files read, and used again, over files in all decks."""
    w = _batch(spark, sf)
    files = sum(d.total_files for d in w.decks)
    return spark.createDataFrame([(w.stats.files_parsed == len({n.path for d in w.decks for n in d.nodes}), w.stats.files_parsed + w.stats.files_reused == files)], "parsed boolean, uses boolean")


# time histories -------------------------------------------------------------------------------

_TYPES = ("click", "error", "purchase", "view")


def _binout(spark: SparkSession, sf: str) -> Binout:
    """Days by event type: how many, the largest value; and over all types the number of users."""
    def make(folder: str) -> Binout:
        day = F.date_format("ts", "yyyy-MM-dd").alias("day")
        e = _t(spark, sf, "events")
        n = e.groupBy(day).pivot("event_type", list(_TYPES)).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).na.fill(0).orderBy("day").collect()
        users = {r.day: r.u for r in e.groupBy(day).agg(F.count_distinct("user_id").alias("u")).collect()}
        count = np.array([[float(r[f"{t}_n"] or 0) for t in _TYPES] for r in n])
        peak = np.array([[float(r[f"{t}_peak"] or 0) for t in _TYPES] for r in n])
        own = lsda.build_series("days", range(len(n)), {"count": count, "peak value": peak, "users": np.array([float(users[r.day]) for r in n])}, (11, 12, 13, 14), _TYPES, "events by day")
        own.set(("total", "time"), np.arange(len(n), dtype=float))
        own.set(("total", "users"), np.array([users[r.day] for r in n], np.int64))
        own.write(f"{folder}/binout")
        return Binout(spark, f"{folder}/binout*", "run1")

    return _once("binout", spark, sf, make)


@_query
def binout_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _binout(spark, sf).wide("days")


@_query
def binout_long(spark: SparkSession, sf: str) -> DataFrame:
    return _binout(spark, sf).long("days", ["count", "users"]).select("state", "time", "col", "entity_id", "legend", "var", "value")


@_query
def binout_selected(spark: SparkSession, sf: str) -> DataFrame:
    return _binout(spark, sf).series("days", "peak value", names=["view", "click"])


@_query
def binout_time_series(spark: SparkSession, sf: str) -> DataFrame:
    return _binout(spark, sf).time_series("total", "users")


@_query
def binout_append(spark: SparkSession, sf: str) -> DataFrame:
    """The sink's table read back."""
    paths = _once("sink", spark, sf, lambda folder: append(_binout(spark, sf), folder))
    return spark.read.parquet(paths[0]).select("state", "id", "count", "users")


@_query
def binout_metadata(spark: SparkSession, sf: str) -> DataFrame:
    b = _binout(spark, sf)
    return spark.createDataFrame([(i, name, b.title("days"), v) for i, name in zip(b.ids("days"), b.legend("days"), strict=True) for v in b.channels("days", b.states("days")[0])], "id long, legend string, title string, channel string")


# state files ----------------------------------------------------------------------------------


def _plot(spark: SparkSession, sf: str) -> D3plot:
    """States are line numbers, elements quantities (1 to 50), parts quantities modulo 5; words are whole numbers below 2**24."""
    def make(folder: str) -> D3plot:
        li = _t(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("s"), F.col("l_quantity").cast("int").alias("q"))
        got = {(r.s, r.q): r for r in li.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("l_partkey") % 1000).alias("p"), F.max(F.col("l_suppkey") % 1000).alias("u"), F.min(F.col("l_orderkey") % 1000).alias("o")).collect()}
        at = np.array([[q, 2 * q, 0] for q in range(1, 51)], float)
        solids = np.array([[*([q] * 8), q % 5 + 1] for q in range(1, 51)])
        w = Writer(at, solids=solids, ids={"node": range(1001, 1051), "solid": range(501, 551), "part": (70, 71, 72, 73, 74)}, title="lines")
        for s in range(1, 8):
            words = [(got[s, q].n, got[s, q].p, got[s, q].u, got[s, q].o, s, q, got[s, q].n % 7) if (s, q) in got else (0, 0, 0, 0, s, q, 0) for q in range(1, 51)]
            w.add_state(s / 2, at + [0, s, 2 * s], velocity=np.full((50, 3), s), solid=np.array(words, float))
        w.write(f"{folder}/d3plot")
        return D3plot(spark, f"{folder}/d3plot")

    return _once("plot", spark, sf, make)


def _word() -> F.Column:  # type: ignore[name-defined]
    return F.get(F.col("vars"), F.lit(0))


@_query
def plot_elements(spark: SparkSession, sf: str) -> DataFrame:
    out = _plot(spark, sf).elements("solid")
    return out.select("state", "time", "element_id", "part_index", "part_id", *(F.col("vars")[k].alias(f"w{k}") for k in range(7)))


@_query
def plot_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _plot(spark, sf).nodes()


@_query
def plot_displacement(spark: SparkSession, sf: str) -> DataFrame:
    return _plot(spark, sf).displacement_magnitude().select("state", "entity", F.round("value", 9).alias("value"))


@_query
def plot_velocity(spark: SparkSession, sf: str) -> DataFrame:
    return _plot(spark, sf).block("velocity", [0, -1]).select("state", "entity", F.col("vars")[2].alias("vz"))


@_query
def plot_part_max(spark: SparkSession, sf: str) -> DataFrame:
    return _plot(spark, sf).part_max_history("solid", _word(), part_id=72)


@_query
def plot_part_von_mises(spark: SparkSession, sf: str) -> DataFrame:
    out = _plot(spark, sf).part_max_history("solid", tensor.stress_von_mises(F.col("vars")), part_index=2)
    return out.select("state", F.round("value", 6).alias("value"))


@_query
def plot_part_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return _plot(spark, sf).part_percentile_history("solid", _word(), 75.0, part_index=1).select("state", F.round("value", 8).alias("value"))


@_query
def plot_part_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return _plot(spark, sf).part_failure_fraction("solid", F.get(F.col("vars"), F.lit(6)), 3.0, part_id=74).select("state", F.round("value", 9).alias("value"))


@_query
def plot_part_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return _plot(spark, sf).part_argmax("solid", F.get(F.col("vars"), F.lit(6)), part_id=73)


@_query
def plot_part_elements(spark: SparkSession, sf: str) -> DataFrame:
    return _plot(spark, sf).part_elements("solid", tensor.effective_plastic_strain(F.col("vars")), part_index=5)


# streams --------------------------------------------------------------------------------------


def _drained(frame: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """What a stream gives once everything that is there has gone through."""
    name = f"stream_{uuid.uuid4().hex}"
    frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    def make(folder: str) -> str:
        _t(spark, sf, "events").repartition(4).write.parquet(f"{folder}/parts")
        return f"{folder}/parts"

    return spark.readStream.schema(_t(spark, sf, "events").schema).option("maxFilesPerTrigger", 2).parquet(_once("stream", spark, sf, make))


@_query
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling hours by type of a stream of files, to its end."""
    return _drained(results.windowed(_events(spark, sf), late="400 days"), spark, "complete").select(F.col("start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "peak")


@_query
def stream_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """The last state of every series."""
    rows = _drained(results.running_peaks(_events(spark, sf)), spark, "update")
    return rows.groupBy("user_id").agg(F.max("n").alias("n"), F.max("peak").alias("peak"))


@_query
def stream_states(spark: SparkSession, sf: str) -> DataFrame:
    """States of a family's members as they appear."""
    plot = _plot(spark, sf)

    def make(folder: str) -> str:
        with open(plot.files[0], "rb") as f:
            data = f.read()
        first, size = plot.states[0][1], plot.control.state_bytes
        for k in range(len(plot.states)):
            with open(f"{folder}/d3plot{k + 1:02d}", "wb") as f:
                f.write(data[first + k * size : first + (k + 1) * size])
        return folder

    rows = _drained(results.new_states(spark, _once("members", spark, sf, make), "d3plot*", plot.control, "solid"), spark, "append")
    return rows.select(F.regexp_extract("file", "(d3plot[0-9]+)$", 1).alias("file"), "time", "entity", F.col("vars")[0].alias("n"))


assert not set(QUERIES) & set(TABLE_QUERIES)
