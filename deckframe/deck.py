"""A deck: its files, blocks, typed tables, ids and keywords, as DataFrames with thin handles.

Content (blocks, ids) is keyed by file, and read once for each distinct file; ``files`` maps it into
the deck, where offsets of included files shift ids. Order is always explicit: (file_idx,
block_idx, pos or row).
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckframe import includes
from deckframe.functions.text import canonical_base, parse_id, parse_int, parse_plain
from deckframe.library import Field, Library, Schema, definition_of, is_known
from deckframe.operators import ids as ops
from deckframe.sources import cards, files
from deckframe.sources import keyword as source

_OFFSETS = "struct<" + ",".join(f"{o}:bigint" for o in ops.OFFSETS) + ">"


def parse_deck(spark: SparkSession, root: str, library: Library | None = None) -> Deck:
    """Walks the includes of a root file. A missing root is an OSError."""
    nodes = includes.walk(os.fspath(root), functools.partial(includes.scan_all, spark=spark))
    return Deck(spark, nodes, library or Library())


def parse_keyword_file(spark: SparkSession, path: str, library: Library | None = None) -> Deck:
    """One file alone, its includes listed but not visited."""
    path = files.real(os.fspath(path))
    size, raw = includes.scan(path) or (0, [])
    own = [includes.Directive(k, r, p := includes.resolve(r, os.path.dirname(path), ()), files.exists(p), o) for k, r, o in raw]
    return Deck(spark, [includes.FileNode(path, byte_count=size, includes=own)], library or Library())


class Deck:
    def __init__(self, spark: SparkSession, nodes: Sequence[includes.FileNode], library: Library, content: Content | None = None) -> None:
        self.spark, self.nodes, self.library = spark, list(nodes), library
        self.content = content or Content(spark, sorted({(n.path, n.byte_count) for n in nodes}), library)
        #: Columns of ``files`` that ids are resolved within; a batch of decks has its ``deck_id`` here.
        self.scope: tuple[str, ...] = ()
        self.edits: dict[tuple[str, int], bytes] = {}

    # what the walk found --------------------------------------------------------------------

    @functools.cached_property
    def files(self) -> DataFrame:
        """file_idx, path, parent_idx, kind, depth, byte_count, offsets."""
        rows = [(i, n.path, n.parent, n.kind, n.depth, n.byte_count, n.offsets) for i, n in enumerate(self.nodes)]
        return self.spark.createDataFrame(rows, f"file_idx int, path string, parent_idx int, kind string, depth int, byte_count long, offsets {_OFFSETS}")

    def _with_files(self, content: DataFrame, *columns: str, on: str = "path") -> DataFrame:
        """``content`` in the deck's files. The files are sent to all tasks as long as they are a bounded number, so content stays where it is."""
        own = self.files.select(on, *columns, *(c for c in self.scope if c not in content.columns))
        return content.join(F.broadcast(own) if len(self.nodes) <= source.BROADCAST_ROWS else own, on)

    @functools.cached_property
    def includes(self) -> DataFrame:
        """file_idx, seq, kind, raw_path, resolved_path, is_there, offsets of every directive."""
        rows = [(i, k, d.kind, d.raw_path, d.resolved_path, d.exists, d.offsets) for i, n in enumerate(self.nodes) for k, d in enumerate(n.includes)]
        return self.spark.createDataFrame(rows, f"file_idx int, seq int, kind string, raw_path string, resolved_path string, is_there boolean, offsets {_OFFSETS}")

    @property
    def total_files(self) -> int:
        return len(self.nodes)

    @property
    def total_bytes(self) -> int:
        return sum(n.byte_count for n in self.nodes)

    def missing_includes(self) -> list[str]:
        return [d.resolved_path for n in self.nodes for d in n.includes if not d.exists]

    def tree(self) -> dict:
        return includes.tree(self.nodes)

    # content --------------------------------------------------------------------------------

    @functools.cached_property
    def blocks(self) -> DataFrame:
        """Every block in the deck's order keys (file_idx, block_idx); a file included twice counts twice."""
        return self._with_files(self.content.blocks, "file_idx")

    def table(self, name: str) -> DataFrame:
        """The rows of a keyword by its library layout. The exact name counts: a ``_TITLE`` form is another table."""
        layout = self.library.find(name)
        if layout is None:
            raise KeyError(f"*{name.upper()} is known, but has no layout here: register one" if is_known(name) else f"no keyword is called *{name.upper()}")
        return self.table_with(Schema(name, layout.cards, layout.repeat))

    def table_with(self, schema: Schema) -> DataFrame:
        rows = source.rows(self.content.context, schema, self.content.n_ranges)
        return self._with_files(rows, "file_idx").select("file_idx", "block_idx", "pos", *(c for c, _ in schema.columns()))

    def columns(self, name: str) -> dict:
        """The table as numpy arrays, in the deck's order."""
        rows = self.table(name).orderBy("file_idx", "block_idx", "pos").toPandas()
        return {c: rows[c].to_numpy() for c in rows.columns if c not in ("file_idx", "block_idx", "pos")}

    def register_schema(self, schema: Schema) -> None:
        """Adds or replaces a layout. Its references are checked like any other's."""
        self.library.register(schema)
        self.content.forget_ids()
        for name in ("definitions", "references", "sites"):
            self.__dict__.pop(name, None)

    # ids ------------------------------------------------------------------------------------

    def _logical(self, ids: DataFrame) -> DataFrame:
        """Joins content with the deck's files and shifts ids; candidates: one (kind, id) for each kind that the id may have."""
        own = self._with_files(ids.withColumnRenamed("id", "phys_id"), "file_idx", "offsets")
        shifted = F.transform("kinds", lambda k: F.struct(k.alias("kind"), ops.shifted(F.col("phys_id"), ops.offset_of(k, F.col("offsets"))).alias("id")))
        return own.withColumn("candidates", shifted).drop("offsets", "path")

    def _placed(self, ids: DataFrame) -> DataFrame:
        """The same for ids of one kind: kind and id as plain columns, which stay in generated code."""
        own = self._with_files(ids.withColumnRenamed("id", "phys_id"), "file_idx", "offsets")
        own = own.withColumn("kind", F.col("kinds")[0])
        return own.withColumn("id", ops.shifted(F.col("phys_id"), ops.offset_of(F.col("kind"), F.col("offsets")))).drop("offsets")

    @functools.cached_property
    def definitions(self) -> DataFrame:
        """kind, id (logical), phys_id, file_idx, block_idx, row, line, keyword, per_line."""
        return self._placed(self.content.ids.where("role = 'def'")).select(*self.scope, "kind", "id", "phys_id", "path", "file_idx", "block_idx", "row", "line", "keyword", "per_line")

    @functools.cached_property
    def references(self) -> DataFrame:
        """candidates, phys_id, file_idx, block_idx, row, line, keyword, field of cards that are not element lines."""
        return self._logical(self.content.ids.where("role = 'ref'")).drop("role", "per_line")

    def dangling_connectivity(self) -> DataFrame:
        """The same columns for element lines whose nodes or parts are not defined.

        Tasks first reduce each range of a file to the different ids it refers to; those are joined.
        Lines are read in place only in ranges that hold an id that failed.
        """
        defs = self.definitions.select(*self.scope, "kind", "id")
        asked = self._placed(self.content.distinct).select(*self.scope, "file_idx", "path", "chunk", "kind", "id")
        failed = ops.keep(ops.dangling(asked, defs, self.scope, few=True, tracked=self._tracked()))
        lines = self._placed(self.content.lines(failed.select("path", "chunk").distinct()))
        return lines.join(ops.few_or_not(failed.select("file_idx", "chunk", "kind", "id")), ["file_idx", "chunk", "kind", "id"], "left_semi")

    @functools.cached_property
    def sites(self) -> DataFrame:
        """The first block that defines each (kind, id), of kinds that are not defined by line."""
        return ops.first_sites(self.definitions.where("not per_line"), ["file_idx", "block_idx", "row"], self.scope)

    def definition_counts(self) -> DataFrame:
        return ops.census(self.definitions, self.scope)

    def _tracked(self) -> DataFrame:
        """The kinds of which something is defined: a look at the packed ids, not at each."""
        own = self.content.packed.where((F.col("role") == "def") & (F.size("id") > 0)).select("path", F.col("kinds")[0].alias("kind")).distinct()
        return self._with_files(own).select(*self.scope, "kind").distinct()

    def dangling(self, connectivity: bool = False) -> DataFrame:
        """References that nothing in the deck defines: kinds, phys_id, file_idx, block_idx, row, line, keyword, field.

        References to one kind are an anti-join of ids; the few that may be of several kinds are folded.
        """
        names = [*self.scope, "kinds", "phys_id", "file_idx", "block_idx", "row", "line", "keyword", "field"]
        defs = self.definitions.select(*self.scope, "kind", "id")
        one = self._placed(self.content.ids.where((F.col("role") == "ref") & (F.size("kinds") == 1))).select(*names, "kind", "id")
        many = self.references.where(F.size("kinds") > 1)
        key = ["file_idx", "block_idx", "row", "field", "phys_id"]
        found = ops.dangling(one, defs, self.scope, few=True, tracked=self._tracked()).select(*names)
        if any(len(f.refs) > 1 for s in self.library.all() for c in s.cards for f in c.fields):
            found = found.unionByName(ops.dangling_any(many, defs, key, self.scope).select(*names))
        return found.unionByName(self.dangling_connectivity().select(*names)) if connectivity else found

    # navigation -----------------------------------------------------------------------------

    def _handles(self, found: DataFrame) -> list[Keyword]:
        rows = found.select("file_idx", "path", "block_idx", "name", "body_start", "span_end", "line", "format").orderBy("file_idx", "block_idx").collect()
        return [Keyword(self, r.file_idx, r.path, r.block_idx, r.name, r.body_start, r.span_end, r.line, r.format) for r in rows]

    def keywords(self, name: str) -> list[Keyword]:
        """Keywords of a canonical name, so also those with ``_TITLE`` or ``_ID``."""
        return self._handles(self.blocks.where(F.col("base") == canonical_base(name)))

    def file(self, suffix: str) -> list[Keyword]:
        """All keywords of the files whose path ends with the given components."""
        want = [p for p in suffix.split("/") if p]
        hits = [i for i, n in enumerate(self.nodes) if n.path.split("/")[-len(want) :] == want]
        return self._handles(self.blocks.where(F.col("file_idx").isin(hits))) if hits else []

    def get(self, kind: str, id_: int) -> Keyword | None:
        """The keyword that defines an entity; failing that, the one of the id without its sign."""
        found = self.sites.where((F.col("kind") == kind) & F.col("id").isin([id_, abs(id_)])).select("id", "file_idx", "block_idx").collect()
        best = next((r for want in (id_, abs(id_)) for r in found if r.id == want), None)
        if best is None:
            return None
        return self._handles(self.blocks.where((F.col("file_idx") == best.file_idx) & (F.col("block_idx") == best.block_idx)))[0]

    def part(self, id_: int) -> Keyword | None:
        return self.get("Part", id_)

    def material(self, id_: int) -> Keyword | None:
        return self.get("Material", id_)

    def section(self, id_: int) -> Keyword | None:
        return self.get("Section", id_)

    def curve(self, id_: int) -> Keyword | None:
        return self.get("Curve", id_)

    def entities(self, kind: str) -> list[Keyword]:
        """The keywords that define a kind, by id."""
        at = self.sites.where(F.col("kind") == kind).select("id", "file_idx", "block_idx").collect()
        place = {(r.file_idx, r.block_idx): r.id for r in at}
        if not place:
            return []
        sel = self.sites.where(F.col("kind") == kind).select("file_idx", "block_idx").distinct()
        return sorted(self._handles(self.blocks.join(sel, ["file_idx", "block_idx"], "left_semi")), key=lambda k: place[k.file_idx, k.block_idx])

    # editing --------------------------------------------------------------------------------

    def _block(self, path: str, block_idx: int) -> tuple[cards.Block, bytes]:
        data = source.read_range(path)
        b = cards.split_blocks(data)[block_idx]
        return b, self.edits.get((path, block_idx), data[b.start : b.end])

    def set_field(self, keyword: Keyword, field: str, value: object, row: int | None = None) -> str | None:
        """Writes one field, found by its name; reads see it only after ``write``. Returns how, or None if there is no such field."""
        at = keyword.locate(field, row)
        if at is None:
            return None
        b, own = self._block(keyword.path, keyword.block_idx)
        line, column, widths = at
        done = cards.set_field(own, line, column, widths, cards.edit_text(value), b.fmt)
        if done is None:
            return None
        self.edits[keyword.path, keyword.block_idx] = done[0]
        return done[1]

    def replace(self, keyword: Keyword, name: str, rows: Sequence[Sequence[object]], options: Sequence[str] = ()) -> None:
        """Writes a keyword anew, in free format, below its comments; reads see it only after ``write``."""
        data = source.read_range(keyword.path)
        b = cards.split_blocks(data)[keyword.block_idx]
        new = {"name": name, "options": list(options), "cards": [[cards.edit_text(v) for v in r] for r in rows]}
        self.edits[keyword.path, keyword.block_idx] = cards.set_keyword(data, b, new)

    def owned(self, keyword: Keyword) -> dict:
        """A keyword as name, options and rows of text, split without a layout."""
        data = source.read_range(keyword.path)
        return cards.keyword_of(data, cards.split_blocks(data)[keyword.block_idx])

    def write(self, path: str, to: str | None = None) -> bytes:
        """The bytes of a file with its edits, written to ``to`` if given. Without edits exactly the file's."""
        data = source.read_range(path)
        own = {k: v for (p, k), v in self.edits.items() if p == path}
        out = cards.apply_edits(data, cards.split_blocks(data), own) if own else data
        if to is not None:
            with open(to, "wb") as f:
                f.write(out)
        return out


class Content:
    """What files hold, whatever decks include them: persisted, so that each is read once."""

    def __init__(self, spark: SparkSession, sizes: Sequence[tuple[str, int]], library: Library) -> None:
        """``sizes``: (path, bytes) of the files."""
        self.spark, self.sizes, self.library = spark, list(sizes), library

    @functools.cached_property
    def _found(self) -> tuple[DataFrame, int]:
        found, n = source.scanned(self.spark, self.sizes)
        return found.persist(), n

    @property
    def n_ranges(self) -> int:
        return self._found[1]

    @functools.cached_property
    def context(self) -> DataFrame:
        """A row a range; it says what a task must know to read the range."""
        return source.contexts(self._found[0], self.sizes, self.n_ranges).persist()

    @functools.cached_property
    def blocks(self) -> DataFrame:
        return source.blocks(self._found[0], F.broadcast(self.context) if self.n_ranges <= source.BROADCAST_ROWS else self.context)

    @functools.cached_property
    def packed(self) -> DataFrame:
        """Definitions, and references of cards."""
        return source.packed_ids(self.context, self.library, self.n_ranges).persist()

    @property
    def ids(self) -> DataFrame:
        return source.unpacked(self.packed)

    @property
    def distinct(self) -> DataFrame:
        """The different ids that the element lines of each range refer to."""
        return source.unpacked(source.packed_ids(self.context, self.library, self.n_ranges, "distinct"))

    def lines(self, places: DataFrame) -> DataFrame:
        """References of the element lines in some ranges (path, chunk)."""
        few = F.broadcast(places) if self.n_ranges <= source.BROADCAST_ROWS else places
        return source.unpacked(source.packed_ids(self.context.join(few, ["path", "chunk"], "left_semi"), self.library, self.n_ranges, "conn"))

    def forget_ids(self) -> None:
        """After a change of layouts; what was found without them stays."""
        if "packed" in self.__dict__:
            self.__dict__.pop("packed").unpersist()

    def unpersist(self) -> None:
        ops.forget()
        self.forget_ids()
        for name in ("context", "_found"):
            if name in self.__dict__:
                kept = self.__dict__.pop(name)
                (kept[0] if name == "_found" else kept).unpersist()
        self.__dict__.pop("blocks", None)


@dataclass
class Keyword:
    """One keyword of a deck; its cards are read when asked for."""

    deck: Deck
    file_idx: int
    path: str
    block_idx: int
    name: str
    body_start: int
    span_end: int
    line: int
    format: str

    @functools.cached_property
    def lines(self) -> list[bytes]:
        """Data lines, without the title."""
        found = cards.lines(source.read_range(self.path, self.body_start, self.span_end))
        return found[1:] if self.name.upper().endswith("_TITLE") else found

    @property
    def base(self) -> str:
        return canonical_base(self.name)

    @property
    def title(self) -> str | None:
        if not self.name.upper().endswith("_TITLE"):
            return None
        found = cards.lines(source.read_range(self.path, self.body_start, self.span_end))
        return cards.text(found[0]) if found else None

    def _card(self, row: int) -> tuple[Field, ...] | None:
        layout = self.deck.library.find(self.name)
        if layout is None:
            return None
        d = definition_of(self.base)
        tile = (d and d.per_line) or (self.base in self.deck.library.own and layout.repeat and len(layout.cards) == 1)
        row = 0 if tile else row
        return layout.cards[row].fields if row < len(layout.cards) else None

    def rows(self) -> Iterator[CardRow]:
        for k, line in enumerate(self.lines):
            yield CardRow(line, self._card(k), self.format)

    def card(self, row: int) -> CardRow | None:
        return CardRow(self.lines[row], self._card(row), self.format) if row < len(self.lines) else None

    def field(self, name: str, row: int | None = None) -> Value | None:
        """The field of the first card that has it, whatever the case of its name; None if the line is missing."""
        for k in range(len(self.lines)) if row is None else (row,):
            c = self.card(k)
            if c is not None and (v := c.field(name)) is not None:
                return v
        return None

    def locate(self, name: str, row: int | None = None) -> tuple[int, int, list[int]] | None:
        """(data line of the block, column, widths in the file) of a field."""
        title = int(self.name.upper().endswith("_TITLE"))
        scale = 2 if self.format == cards.LONG else 1
        for k in range(len(self.lines)) if row is None else (row,):
            at = 0
            fields = self._card(k) or ()
            for f in fields:
                if f.name.lower() == name.lower():
                    return k + title, at, [g.width * scale for g in fields for _ in range(g.count)]
                at += f.count
        return None

    @property
    def kind(self) -> str | None:
        d = definition_of(self.base)
        return d.kind if d else None

    @property
    def id(self) -> int | None:
        """The logical id that this keyword defines, None for those that define by line or nothing."""
        d = definition_of(self.base)
        if d is None or d.per_line or d.card >= len(self.lines) or self._card(d.card) is None:
            return None
        raw = parse_id(self.card(d.card).at(0).raw)
        return None if raw is None else ops.shift(raw, self.offset(d.kind))

    def offset(self, kind: str) -> int:
        return self.deck.nodes[self.file_idx].offsets[ops.OFFSETS.index(ops.BUCKETS[kind])]

    def reference(self, name: str) -> Keyword | None:
        """The keyword that a field refers to; of several possible kinds the first that resolves."""
        v = self.field(name)
        if v is None or v.spec is None or not (raw := v.as_id()):
            return None
        return next((k for kind in v.spec.refs if (k := self.deck.get(kind, ops.shift(raw, self.offset(kind))))), None)

    def reference_to(self, kind: str) -> Keyword | None:
        """The keyword of a kind that the first field of that kind refers to."""
        for k in range(len(self.lines)):
            for f in self._card(k) or ():
                if kind in f.refs and (raw := self.card(k).field(f.name).as_id()):
                    return self.deck.get(kind, ops.shift(raw, self.offset(kind)))
        return None

    def material(self) -> Keyword | None:
        return self.reference_to("Material")

    def section(self) -> Keyword | None:
        return self.reference_to("Section")

    def eos(self) -> Keyword | None:
        return self.reference_to("Eos")

    def hourglass(self) -> Keyword | None:
        return self.reference_to("Hourglass")


@dataclass
class CardRow:
    """One data line of a keyword."""

    line: bytes
    fields: tuple[Field, ...] | None
    format: str

    def raw(self) -> list[str]:
        """All fields as text; without a layout a fixed line is split at blanks."""
        if self.fields is None:
            if cards.is_free(self.line, self.format):
                return [cards.text(x) for x in self.line.split(b",")]
            return [cards.text(x) for x in self.line.split()]
        widths = [f.width for f in self.fields for _ in range(f.count)]
        return [cards.text(x) for x in cards.slices(self.line, widths, self.format)]

    def at(self, k: int) -> Value | None:
        raw = self.raw()
        spec = None
        if self.fields is not None:
            flat = [f for f in self.fields for _ in range(f.count)]
            spec = flat[k] if k < len(flat) else None
        return Value(raw[k], spec) if k < len(raw) else None

    def field(self, name: str) -> Value | None:
        at = 0
        for f in self.fields or ():
            if f.name.lower() == name.lower():
                return self.at(at)
            at += f.count
        return None


@dataclass(frozen=True)
class Value:
    """A field's text, read as navigation reads it: no D exponents, None where there is no number."""

    raw: str
    spec: Field | None = None

    def as_int(self) -> int | None:
        return parse_int(self.raw)

    def as_id(self) -> int | None:
        return parse_id(self.raw)

    def as_float(self) -> float | None:
        return parse_plain(self.raw)

    def value(self) -> int | float | str:
        whole, number = self.as_int(), self.as_float()
        return whole if whole is not None else number if number is not None else self.raw
