"""Validation rules: each gives a DataFrame of findings.

Findings have rule, severity, keyword, file, line and message. ``validate`` unions the rules in
order, with rule_seq.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckframe.deck import Deck
from deckframe.functions.text import canonical_base
from deckframe.operators import ids as ops
from deckframe.operators.predicates import Predicate, number_text
from deckframe.sources import keyword as source

ERROR, WARNING, INFO = "Error", "Warning", "Info"
FINDINGS = "rule string, severity string, keyword string, file string, line long, message string"
#: Fixed value: kinds whose definitions should be used by something.
LIBRARY_KINDS = (
    "Material", "ThermalMaterial", "Section", "Eos", "Hourglass", "Curve", "Coord", "Vector", "Box", "Transform",
    "NodeSet", "PartSet", "SegmentSet", "ShellSet", "SolidSet", "BeamSet", "DiscreteSet", "Sensor", "Define",
)
#: Fixed value: keywords that act on rigid bodies, and their fields that name parts.
RIGID_FIELDS = {
    "LOAD_RIGID_BODY": ("PID",), "CONSTRAINED_RIGID_BODIES": ("PIDL", "PIDC"), "CONSTRAINED_EXTRA_NODES_NODE": ("PID",),
    "CONSTRAINED_EXTRA_NODES_SET": ("PID",), "CONSTRAINED_RIGID_BODY_STOPPERS": ("PID",), "BOUNDARY_PRESCRIBED_MOTION_RIGID": ("PID",),
}
RIGID_MATERIALS = ("MAT_RIGID", "MAT_020", "MAT_20")


@dataclass(frozen=True)
class Rule:
    """A check and where it applies: ``only`` and ``skip`` are parts of file paths, in any case."""

    name: str
    check: Callable[[Deck], DataFrame]
    severity: str | None = None
    only: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()

    def with_severity(self, severity: str) -> Rule:
        return replace(self, severity=severity)

    def only_in(self, *parts: str) -> Rule:
        return replace(self, only=parts)

    def except_in(self, *parts: str) -> Rule:
        return replace(self, skip=parts)

    def run(self, deck: Deck) -> DataFrame:
        out = self.check(deck)
        path = F.lower("file")
        inside = lambda parts: functools.reduce(lambda a, p: a | path.contains(p.lower()), parts, F.lit(False))
        if self.only:
            out = out.where(inside(self.only))
        if self.skip:
            out = out.where(~inside(self.skip))
        return out.withColumn("severity", F.lit(self.severity)) if self.severity else out


def validate(deck: Deck, rules: Sequence[Rule]) -> DataFrame:
    """All findings, with rule_seq to order them by rule, and for a batch with deck_id."""
    if not rules:
        return deck.spark.createDataFrame([], f"{'deck_id int, ' if deck.scope else ''}rule_seq int, {FINDINGS}")
    found = [r.run(deck).select(*deck.scope, F.lit(k).alias("rule_seq"), "rule", "severity", "keyword", "file", "line", "message") for k, r in enumerate(rules)]
    return functools.reduce(DataFrame.unionByName, found)


def is_clean(findings: DataFrame) -> bool:
    """Whether there is no error."""
    return findings.where(F.col("severity") == ERROR).isEmpty()


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").count()


def custom(name: str, check: Callable[[Deck], DataFrame]) -> Rule:
    """A rule of one's own: any function from a deck to findings."""
    return Rule(name, check)


def _findings(df: DataFrame, deck: Deck, rule: str, severity: str, message: object) -> DataFrame:
    """Findings of rows that have file_idx, keyword and line."""
    named = deck._with_files(df.drop("path"), "path", on="file_idx").withColumnRenamed("path", "file")
    return named.select(*deck.scope, F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "keyword", "file", F.col("line").cast("long").alias("line"), message.alias("message"))


def keyword_forbidden(keyword: str) -> Rule:
    base, name = canonical_base(keyword), f"keyword_forbidden({keyword})"

    def check(deck: Deck) -> DataFrame:
        found = deck.blocks.where(F.col("base") == base).withColumn("keyword", F.lit(base))
        return _findings(found, deck, name, ERROR, F.lit(f"keyword *{base} is not allowed here"))

    return Rule(name, check)


def _block_fields(deck: Deck, base: str, fields: Sequence[str]) -> DataFrame:
    """One row for each keyword of a base: its order keys and, for every field, the text in the first card that has it (null if missing)."""
    found = source.fields(deck.content.context, deck.library, base, list(dict.fromkeys(f.lower() for f in fields)), deck.content.n_ranges)
    return deck._with_files(found, "file_idx").withColumn("keyword", F.lit(base))


def _number(name: str):  # noqa: ANN202
    """A field as navigation reads numbers: no D exponents."""
    c = F.col(f"f_{name.lower()}")
    return F.when(~F.rlike(c, F.lit("[dDfF]")), c.try_cast("double"))


def _text(name: str):  # noqa: ANN202
    return F.col(f"f_{name.lower()}")


def _shown(name: str):  # noqa: ANN202
    """A field's value as messages show it (see ``number_text``): numbers without an exponent, whole ones without a point, other text as it is."""
    n, raw = _number(name), _text(name)
    fraction = F.regexp_replace(F.regexp_replace(n.cast("decimal(38,17)").cast("string"), "0+$", ""), r"\.$", "")
    plain = F.when(n == F.floor(n), n.cast("decimal(38,0)").cast("string")).otherwise(fraction)
    return F.when(F.isnan(n), F.lit("NaN")).when(F.abs(n) == float("inf"), F.when(n > 0, "inf").otherwise("-inf")).when(n.isNotNull(), plain).otherwise(raw)


def field_forbidden_values(keyword: str, field: str, values: Sequence[object]) -> Rule:
    base, name = canonical_base(keyword), f"field_forbidden_values({keyword}.{field})"

    def check(deck: Deck) -> DataFrame:
        rows = _block_fields(deck, base, [field])
        hit, shown = F.lit(False), F.lit(None).cast("string")
        for v in values:
            same = Predicate.of(field, "==", v).column(_number, _text)
            hit, shown = hit | same, F.coalesce(shown, F.when(same, F.lit(number_text(v))))
        bad = rows.withColumn("shown", shown).where(hit)
        return _findings(bad, deck, name, ERROR, F.concat(F.lit(f"{field} = "), F.col("shown"), F.lit(" is forbidden")))

    return Rule(name, check)


def field_required(keyword: str, require: Predicate, when: Predicate | None = None) -> Rule:
    base, name = canonical_base(keyword), f"field_required({keyword})"

    def check(deck: Deck) -> DataFrame:
        rows = _block_fields(deck, base, [*require.fields(), *(when.fields() if when else [])])
        bad = ~require.column(_number, _text)
        if when is not None:
            bad = bad & when.column(_number, _text)
        said = f"requires {require.describe()}" + (f" when {when.describe()}" if when else "")
        message = F.lit(said)
        if require.kind == "field":
            message = F.concat(message, F.coalesce(F.concat(F.lit(", got "), _shown(require.field)), F.lit("")))
        return _findings(rows.where(bad), deck, name, ERROR, message)

    return Rule(name, check)


def include_missing() -> Rule:
    """Every directive is tested, also those that name search directories."""
    def check(deck: Deck) -> DataFrame:
        bad = deck.includes.where("not is_there").withColumn("keyword", F.lit("INCLUDE")).withColumn("line", F.lit(0))
        return _findings(bad, deck, "include_missing", ERROR, F.concat(F.lit("include '"), F.col("raw_path"), F.lit("' resolves to a missing file: "), F.col("resolved_path")))

    return Rule("include_missing", check)


def references_resolve(connectivity: bool = False) -> Rule:
    def check(deck: Deck) -> DataFrame:
        bad = deck.dangling(connectivity)
        target = F.when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise(F.concat(F.lit("["), F.concat_ws(", ", "kinds"), F.lit("]")))
        message = F.concat("keyword", F.lit("."), F.upper("field"), F.lit(" references "), target, F.lit(" "), F.col("phys_id").cast("string"), F.lit(" — not defined in the deck"))
        return _findings(bad, deck, "references_resolve", ERROR, message)

    return Rule("references_resolve", check)


def duplicate_ids() -> Rule:
    """Every keyword of an id that several keywords define."""
    def check(deck: Deck) -> DataFrame:
        bad = ops.duplicates(deck.definitions.where("not per_line"), deck.scope, sites=["file_idx", "block_idx", "line", "keyword", "row"])
        message = F.concat(F.lit("duplicate "), "kind", F.lit(" id "), F.col("id").cast("string"), F.lit(" — defined by "), F.col("n").cast("string"), F.lit(" keywords in the deck"))
        return _findings(_at_keyword(bad, deck), deck, "duplicate_ids", ERROR, message)

    return Rule("duplicate_ids", check)


def _at_keyword(df: DataFrame, deck: Deck) -> DataFrame:
    """Replaces the line of a card by that of its keyword."""
    return df.drop("line").join(deck.blocks.select("file_idx", "block_idx", "line"), ["file_idx", "block_idx"])


def unreferenced_entities(kinds: Sequence[str] = LIBRARY_KINDS) -> Rule:
    def check(deck: Deck) -> DataFrame:
        refs = deck.references.select(*deck.scope, F.explode("candidates").alias("c")).select(*deck.scope, "c.kind", "c.id")
        bad = ops.unreferenced(deck.sites.where(F.col("kind").isin(list(kinds))), refs, deck.scope)
        message = F.concat("kind", F.lit(" "), F.col("id").cast("string"), F.lit(" is defined but never referenced"))
        return _findings(_at_keyword(bad, deck), deck, "unreferenced_entities", WARNING, message)

    return Rule("unreferenced_entities", check)


def _resolved(df: DataFrame, key: str, site: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """``df`` with the site of its ids; an id that has none falls back to the one without a sign, as in ``Deck.get``."""
    known = site.select(*scope, F.col("id").alias(key), F.col("id").alias("known"))
    return df.join(known, [*scope, key], "left").withColumn("id", F.coalesce("known", F.abs(key))).drop("known").join(site, [*scope, "id"]).drop("id")


def rigid_context() -> Rule:
    """Keywords for rigid bodies whose part resolves to a material that is not rigid: two hops over references and sites."""
    def check(deck: Deck) -> DataFrame:
        scope = deck.scope
        fields = functools.reduce(lambda a, b: a | b, ((F.col("keyword") == k) & F.upper("field").isin(list(f)) for k, f in RIGID_FIELDS.items()))
        asked = deck.references.where(fields & F.array_contains("kinds", "Part")).select(*scope, "file_idx", "block_idx", "keyword", "field", F.col("candidates")[0]["id"].alias("pid"))
        site = deck.sites.select(*scope, "kind", "id", F.col("file_idx").alias("sf"), F.col("block_idx").alias("sb"), F.col("keyword").alias("sk"))
        part = _resolved(asked, "pid", site.where("kind = 'Part'").select(*scope, "id", "sf", "sb"), scope)
        mid = deck.references.where(F.array_contains("kinds", "Material") & (F.col("keyword") == "PART")).select(F.col("file_idx").alias("sf"), F.col("block_idx").alias("sb"), F.col("candidates")[0]["id"].alias("mid"))
        mats = site.where("kind = 'Material'").select(*scope, "id", F.col("sk").alias("material"))
        bad = _resolved(part.join(mid, ["sf", "sb"]), "mid", mats, scope).where(~F.col("material").isin(list(RIGID_MATERIALS)))
        message = F.concat("keyword", F.lit("."), F.upper("field"), F.lit(" references part "), F.col("pid").cast("string"), F.lit(", whose material *"), "material", F.lit(" is not *MAT_RIGID"))
        return _findings(_at_keyword(bad.withColumn("line", F.lit(0)), deck), deck, "rigid_context", ERROR, message)

    return Rule("rigid_context", check)
