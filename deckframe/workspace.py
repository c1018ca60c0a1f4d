"""Many decks over one set of files.

Decks of a batch share their content: each distinct file is split into blocks and searched for ids
once, whatever decks include it and with whatever offsets, because offsets are applied when content
is joined with a deck's files. All decks are validated by one set of joins with ``deck_id`` in every
key, so neither the plan nor the number of jobs grows with the number of decks.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckframe import includes, rules
from deckframe.deck import Content, Deck
from deckframe.library import Library
from deckframe.operators import ids as ops
from deckframe.sources import files
from deckframe.sources import keyword as source


@dataclass(frozen=True)
class Stats:
    """Files that had to be read, and uses of files that were already there."""

    files_parsed: int
    files_reused: int


class Workspace:
    def __init__(self, spark: SparkSession, library: Library | None = None) -> None:
        self.spark, self.library = spark, library or Library()
        self.decks: list[Deck] = []
        self._scans: dict[tuple[str, int, int], tuple] = {}
        self._uses = 0

    def _scan(self, paths: Sequence[str]) -> list:
        """Directives by path, size and time of change, so an unchanged file is scanned once."""
        def key(p: str) -> tuple[str, int, int]:
            if files.is_uri(p):
                return p, files.size(p), 0
            s = os.stat(p)
            return p, s.st_size, s.st_mtime_ns

        keys = [key(p) if files.exists(p) else (p, -1, -1) for p in paths]
        new = list(dict.fromkeys(k for k in keys if k not in self._scans))
        self._scans |= dict(zip(new, includes.scan_all([k[0] for k in new], self.spark), strict=True))
        self._uses += len(keys)
        return [self._scans[k] for k in keys]

    def parse_deck(self, root: str) -> Deck:
        return self.parse_decks([root])[0]

    def parse_decks(self, roots: Sequence[str]) -> list[Deck]:
        """Adds decks. Content of all decks so far is one set of frames."""
        walked = [includes.walk(os.fspath(r), self._scan) for r in roots]
        old = self.decks[0].content if self.decks else None
        sizes = sorted({(n.path, n.byte_count) for nodes in [*walked, *(d.nodes for d in self.decks)] for n in nodes})
        if old is None or sizes != old.sizes:
            if old is not None:
                old.unpersist()
            content = Content(self.spark, sizes, self.library)
            for d in self.decks:
                d.content = content
                for name in ("blocks", "definitions", "references", "sites"):
                    d.__dict__.pop(name, None)
        else:
            content = old
        made = [Deck(self.spark, nodes, self.library, content) for nodes in walked]
        self.decks += made
        return made

    @property
    def stats(self) -> Stats:
        return Stats(len(self._scans), self._uses - len(self._scans))

    # all decks at once ----------------------------------------------------------------------

    @property
    def batch(self) -> Batch:
        """All decks as one, whose ids are resolved within each."""
        return Batch(self)

    def _instances(self) -> tuple[DataFrame, DataFrame]:
        """Files at their offsets, each once (inst, path, offsets), and which decks have them (deck_id, inst, file_idx of the batch)."""
        number: dict[tuple, int] = {}
        uses, at = [], 0
        for k, d in enumerate(self.decks):
            for n in d.nodes:
                uses.append((k, number.setdefault((n.path, n.offsets), len(number)), at))
                at += 1
        inst = self.spark.createDataFrame([(i, p, o) for (p, o), i in number.items()], "inst int, path string, offsets struct<" + ",".join(f"{o}:bigint" for o in ops.OFFSETS) + ">")
        few = lambda df: F.broadcast(df) if at <= source.BROADCAST_ROWS else df
        return few(inst), few(self.spark.createDataFrame(uses, "deck_id int, inst int, file_idx int"))

    def _placed(self, content: DataFrame, inst: DataFrame) -> DataFrame:
        """Content at the offsets of each instance: the candidates for each kind, and kind and id of the first."""
        own = content.withColumnRenamed("id", "phys_id").join(inst, "path")
        shifted = F.transform("kinds", lambda k: F.struct(k.alias("kind"), ops.shifted(F.col("phys_id"), ops.offset_of(k, F.col("offsets"))).alias("id")))
        kind = F.col("kinds")[0]
        return own.withColumn("candidates", shifted).withColumn("kind", kind).withColumn("id", ops.shifted(F.col("phys_id"), ops.offset_of(kind, F.col("offsets")))).drop("offsets")

    def dangling(self, connectivity: bool = False) -> DataFrame:
        """deck_id, path, keyword, field, kinds, kind, id, phys_id, file_idx, block_idx, row, line of references that their deck does not define.

        What a file defines itself is settled once, for all decks that have the file at these
        offsets. Only ids that are left are taken to the decks, and only definitions of such ids,
        so the work hardly grows with the number of decks. References that may be of several kinds
        are few; they are folded within each deck.
        """
        content, (inst, uses) = self.decks[0].content, self._instances()
        names = ["deck_id", "path", "keyword", "field", "kinds", "kind", "id", "phys_id", "file_idx", "block_idx", "row", "line"]
        defs = self._placed(content.ids.where("role = 'def'"), inst).select("inst", "kind", "id")
        cards = content.ids.where("role = 'ref'")
        one, many = self._placed(cards.where(F.size("kinds") == 1), inst), self._placed(cards.where(F.size("kinds") > 1), inst)
        asked = one.select("inst", "kind", "id")
        lines = self._placed(content.distinct, inst).select("inst", "path", "chunk", "kind", "id") if connectivity else None
        if lines is not None:
            ops.keep(lines)  # read for what is left and for where it is
            asked = asked.unionByName(lines.select("inst", "kind", "id"))
        left = ops.few_or_not(asked.distinct().join(defs, ["inst", "kind", "id"], "left_anti"))
        each = many.select(F.explode("candidates").alias("c")).select("c.kind", "c.id")
        wanted = left.select("kind", "id").unionByName(each)
        wanted = ops.few_or_not(wanted.select("kind", F.explode(F.array("id", F.abs("id"))).alias("id")).distinct())
        known = defs.join(wanted, ["kind", "id"], "left_semi").distinct().join(uses, "inst").select("deck_id", "kind", "id")
        kinds = content.packed.where((F.col("role") == "def") & (F.size("id") > 0)).select("path", F.col("kinds")[0].alias("kind")).distinct()
        tracked = kinds.join(inst, "path").join(uses, "inst").select("deck_id", "kind").distinct()
        # a row of a kind that only marks it as tracked lets the shared operators judge
        known = known.unionByName(tracked.withColumn("id", F.lit(None).cast("long")))
        bad = ops.dangling(left.join(uses, "inst"), known, ["deck_id"], tracked=tracked).select("deck_id", "inst", "file_idx", "kind", "id")
        bad = ops.few_or_not(bad)
        out = one.join(bad, ["inst", "kind", "id"]).select(*names)
        if lines is not None:
            places = lines.join(bad.select("inst", "kind", "id").distinct(), ["inst", "kind", "id"], "left_semi").select("path", "chunk").distinct()
            out = out.unionByName(self._placed(content.lines(places), inst).join(bad, ["inst", "kind", "id"]).select(*names))
        if any(len(f.refs) > 1 for s in self.library.all() for c in s.cards for f in c.fields):
            several = ops.dangling_any(many.join(uses, "inst"), known, ["file_idx", "block_idx", "row", "field", "phys_id"], ["deck_id"])
            out = out.unionByName(several.select(*names))
        return out

    def duplicates(self) -> DataFrame:
        """deck_id, kind, id, path, block_idx, keyword, n of ids that several keywords of a deck define."""
        return ops.duplicates(self.batch.definitions.where("not per_line"), ["deck_id"], ["path", "block_idx", "keyword"])

    def census(self) -> DataFrame:
        """deck_id, kind, n."""
        return self.batch.definition_counts()

    def validate_decks(self, of: Sequence[rules.Rule]) -> DataFrame:
        """deck_id and the findings of every deck: what validating each alone gives. One plan, whatever the number of decks."""
        return rules.validate(self.batch, of)


class Batch(Deck):
    """All decks of a workspace as one deck: file_idx counts on, and every resolution is within a deck_id."""

    def __init__(self, of: Workspace) -> None:
        super().__init__(of.spark, [n for d in of.decks for n in d.nodes], of.library, of.decks[0].content)
        self.of, self.scope = of, ("deck_id",)

    @functools.cached_property
    def files(self) -> DataFrame:
        rows = [(at, k) for at, k in enumerate(k for k, d in enumerate(self.of.decks) for _ in d.nodes)]
        return super().files.join(F.broadcast(self.spark.createDataFrame(rows, "file_idx int, deck_id int")) if len(rows) <= source.BROADCAST_ROWS else self.spark.createDataFrame(rows, "file_idx int, deck_id int"), "file_idx")

    def dangling(self, connectivity: bool = False) -> DataFrame:
        return self.of.dangling(connectivity)
