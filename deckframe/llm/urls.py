"""URL filters: host-suffix and path-prefix expressions joined on short digest prefixes.

Every URL is expanded into the expressions *host suffix + path prefix* that could equal a rule:
only suffixes with as many labels and prefixes with as many characters as some rule has, so the
expansion is bounded by the rule list, not by the URL. An expression's SHA-256 digest is joined
with the rules on its first 32 bits; the full digest then confirms the hit, and the longest rule
(by host plus path, then by host) decides.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule;
repeated rows are all returned; an empty table gives an empty result; a URL of any length is judged
whole, as only prefixes as long as some rule's are hashed; other columns are ignored.
Of two rules with the same host and path, ``block`` wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest prefix that is joined on.
SHORT = 8
#: A rule table over this many rules is joined by shuffle instead of being sent to every task.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host with its subdomains, below a path prefix."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end of the URL; empty where there is no host part."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def _expressions(shapes: Sequence[tuple[int, int]]) -> Column:
    """array<string>: the URL's expressions of the given shapes (labels of the host, characters of the path).

    Shapes are one constant array, so the plan has the same size for any number of rules.
    """
    known = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in shapes))
    fits = F.filter(known, lambda s: (F.size("labels") >= s["k"]) & (F.length("path") >= s["n"]))
    return F.array_distinct(F.transform(fits, lambda s: F.concat(F.array_join(F.slice("labels", -s["k"], s["k"]), "."), F.substr("path", F.lit(1), s["n"]))))


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``rules``: a list, or a frame of any size (verdict, host, path). Of a frame the driver gathers
    only the different shapes, at most the labels times the path lengths that there are.

    One shuffle of (page_id, url): equal rows are counted before it, and the rule join and the
    choice of the longest rule keep its partitioning.
    """
    spark = pages.sparkSession
    given = rules if isinstance(rules, DataFrame) else spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    shapes = sorted((r.k, r.n) for r in given.select(F.size(F.split("host", r"\.")).alias("k"), F.length("path").alias("n")).distinct().collect())
    distinct = pages.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    hosts = distinct.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    if not shapes:
        best = hosts.select("page_id", "host", "path", "copies", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    else:
        table = given.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), F.col("verdict").alias("rule_verdict")).distinct()
        table = table.withColumn("rule_digest", F.sha2("rule", 256)).withColumn("short", F.substring("rule_digest", 1, SHORT))
        few = (len(rules) if not isinstance(rules, DataFrame) else rules.count()) <= BROADCAST_RULES
        hosts = hosts.withColumn("labels", F.split("host", r"\."))
        spread = hosts.withColumn("expression", F.explode_outer(_expressions(shapes)))
        spread = spread.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, SHORT))
        hit = spread.join(F.broadcast(table) if few else table, "short", "left")
        confirmed = F.when(
            F.col("digest") == F.col("rule_digest"),
            F.struct(F.length("rule").alias("chars"), "host_chars", F.col("rule_verdict").alias("verdict"), "rule"),
        )
        best = (
            hit.groupBy("page_id", "url")
            .agg(F.max(confirmed).alias("best"), F.first("host").alias("host"), F.first("path").alias("path"), F.first("copies").alias("copies"))
            .select("page_id", "host", "path", "copies", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
        )
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("page_id", "host", "path", "rule", "verdict")
