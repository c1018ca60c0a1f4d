"""Quality rules by weak supervision.

Every rule votes on a document: 1 (good), -1 (bad) or 0 (abstains). Documents with equal votes
form a pattern; there are at most 3**rules patterns whatever the corpus, so the estimate works on
their counts. Expectation-maximisation fits, for either class, how likely each rule casts each
vote (its accuracy there) and how common the class is; the posterior probability that a document
is good replaces "all rules must pass". The whole fit is one SQL expression over the patterns.

A start is needed that says which class is which: a pattern without a bad vote begins as good.

Base measures come with every result: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
and base_failed (under 50 words, or more than half of them in repeated 3-word windows). A document
is kept if it did not fail the base and its posterior is 0.5 or more.

Defined cases: a null text has no words and fails the base; repeated rows are judged alike and all
returned; an empty table gives an empty result; a text of any length is measured whole, in n log n
time at most; columns of any other name pass through unread.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckframe.llm.common import WORD, cut, free_name, let, words_of

MIN_WORDS = 50
ROUNDS = 25
#: Added to every count of votes, so that no estimate is 0 or 1.
SMOOTH = 0.5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_letters")


def _repeat_words(hashes: Column) -> Column:
    """int: words inside 3-word windows that occur at least twice, from the words' hashes.

    Where all windows differ the answer is 0 after one linear pass. Else windows are sorted by
    (hash, place); those equal to a neighbour are repeats, and each covers three words less what
    the next one covers too. That is n log n for any text.
    """
    n = F.size(hashes)
    windows = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))
    )).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            def repeated(x: Column, k: Column) -> Column:
                near = lambda j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
                return near(k + 1) | F.when(k > 0, near(k - 1)).otherwise(False)
            return F.array_sort(F.transform(F.filter(p, repeated), lambda x: x["i"]))

        def total(at: Column) -> Column:
            step = lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))
            return F.aggregate(F.transform(at, step), F.lit(0), lambda a, x: a + x)

        return let(pairs, lambda p: let(places(p), total))

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))


def measures(text: Column) -> Column:
    """struct<MEASURES: long> of one text."""
    def lines(t: Column) -> Column:
        return let(F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(WORD))), lambda x: F.struct(
            F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        ))

    def words(t: Column) -> Column:
        return let(F.transform(words_of(t), lambda w: F.xxhash64(w)), lambda h: F.struct(
            F.size(h).alias("n_words"), F.size(F.array_distinct(h)).alias("n_distinct"), _repeat_words(h).alias("n_repeat_words"),
        ))

    def parts(t: Column) -> Column:
        return let(F.struct(words(t).alias("w"), lines(t).alias("l")), lambda p: F.struct(*(x.cast("long").alias(name) for name, x in {
            "n_words": p["w"]["n_words"],
            "word_chars": F.length(F.regexp_replace(t, F.lit(r"[\x20\x09-\x0D]+"), F.lit(""))),
            "n_symbols": F.length(t) - F.length(F.regexp_replace(t, F.lit(r"[#*$%&|<>]+"), F.lit(""))),
            "n_dup_lines": p["l"]["n_dup_lines"],
            "n_repeat_words": p["w"]["n_repeat_words"],
            "n_lines": p["l"]["n_lines"],
            "n_distinct": p["w"]["n_distinct"],
            "n_letters": F.length(F.regexp_replace(t, F.lit(r"[^\p{L}]+"), F.lit(""))),
        }.items())))

    return let(F.coalesce(text, F.lit("")), parts)


@dataclass(frozen=True)
class Rule:
    """Votes bad or good where its condition on the measures holds, else abstains."""

    name: str
    bad: str
    good: str


#: Bounds lie far outside what ordinary prose of any length shows, so a bad vote means something.
RULES = (
    Rule("symbols", "n_symbols > 0.2 * n_words", "n_symbols <= 0.02 * n_words"),
    Rule("letters", "n_letters < 0.8 * word_chars", "n_letters >= 0.9 * word_chars"),
    Rule("word_length", "word_chars > 12 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    Rule("lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines", "n_dup_lines = 0"),
    Rule("windows", "5 * n_repeat_words > 2 * n_words", "10 * n_repeat_words < n_words"),
    Rule("variety", "n_words >= 50 and 20 * n_distinct < n_words", "4 * n_distinct > n_words"),
    Rule("length", "n_words < 10", "n_words >= 50"),
)


def voted(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", measured: str = "_quality", votes: str = "_votes") -> DataFrame:
    """``docs`` with the struct of measures and the array of votes."""
    out = docs.withColumn(measured, measures(F.col(text)))
    vote = [F.expr(f"case when {_on(r.bad, measured)} then -1 when {_on(r.good, measured)} then 1 else 0 end").cast("int") for r in rules]
    return out.withColumn(votes, F.array(*vote))


def _on(condition: str, measured: str) -> str:
    for name in sorted(MEASURES, key=len, reverse=True):
        condition = condition.replace(name, f"{measured}.{name}")
    return condition


def fit(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """One row (prior, rate): rate[3 * rule + vote + 1] is struct(good, bad), the chance of the vote in either class.

    ``patterns``: votes, n. All patterns meet in one row: at most 3**n_rules of them.
    """
    cells = [(r, v) for r in range(n_rules) for v in (-1, 0, 1)]

    def step(p: Column, post: Column) -> Column:
        """The model that fits posteriors ``post`` of the patterns ``p``."""
        both = F.zip_with(p, post, lambda x, g: F.struct(x["votes"].alias("votes"), (x["n"] * g).alias("good"), (x["n"] * (1 - g)).alias("bad")))

        def made(b: Column) -> Column:
            add = lambda side, keep: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.when(keep(x), x[side]).otherwise(0.0))
            sums = F.struct(add("good", lambda x: F.lit(True)).alias("good"), add("bad", lambda x: F.lit(True)).alias("bad"))
            return let(sums, lambda t: F.struct(
                ((t["good"] + SMOOTH) / (t["good"] + t["bad"] + 2 * SMOOTH)).alias("prior"),
                F.array(*(
                    let(F.struct(F.lit(r).alias("r"), F.lit(v).alias("v")), lambda c: F.struct(
                        ((add("good", lambda x: F.get(x["votes"], c["r"]) == c["v"]) + SMOOTH) / (t["good"] + 3 * SMOOTH)).alias("good"),
                        ((add("bad", lambda x: F.get(x["votes"], c["r"]) == c["v"]) + SMOOTH) / (t["bad"] + 3 * SMOOTH)).alias("bad"),
                    ))
                    for r, v in cells
                )).alias("rate"),
            ))

        return let(both, made)

    def expect(p: Column, model: Column) -> Column:
        return F.transform(p, lambda x: posterior(x["votes"], model["prior"], model["rate"]))

    start = F.transform("p", lambda x: F.when(F.array_contains(x["votes"], -1), F.lit(0.2)).otherwise(F.lit(0.95)))
    p = F.col("p")
    model = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), step(p, start), lambda m, _: step(p, expect(p, m)))
    # a fixed order of patterns, so that sums of doubles do not depend on arrival
    gathered = patterns.groupBy().agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("p"))
    return gathered.select(model.alias("m")).select("m.prior", "m.rate")


def posterior(votes: Column, prior: Column, rate: Column) -> Column:
    """The probability that a document with these votes is good."""
    cell = lambda v, i: F.get(rate, 3 * i + v + 1)
    odds = F.aggregate(F.transform(votes, lambda v, i: let(cell(v, i), lambda c: F.log(c["good"] / c["bad"]))), F.log(prior / (1 - prior)), lambda a, x: a + x)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, rounds: int = ROUNDS, text: str = "text", carry: bool = False) -> DataFrame:
    """``docs`` (or, without ``carry``, its doc_id) with the measures, base_failed, posterior, votes and kept.

    Texts are measured once: measures and votes, and with ``carry`` the rows too, are written to
    the shared folder, from where both the fit and the result read. No row is shuffled.
    """
    measured, votes = free_name(docs, "_quality"), free_name(docs, "_votes")
    own = docs if carry else docs.select("doc_id", text)
    marked = voted(own, rules, text, measured, votes)
    marked = cut(marked if carry else marked.drop(text), "quality")
    patterns = marked.groupBy(F.col(votes).alias("votes")).agg(F.count(F.lit(1)).alias("n"))
    model = fit(patterns, len(rules), rounds).first()
    rate = F.array(*(F.struct(F.lit(x.good).alias("good"), F.lit(x.bad).alias("bad")) for x in model.rate))
    good = posterior(F.col(votes), F.lit(model.prior), rate)
    m = F.col(measured)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    named = [c for c in marked.columns if c not in (measured, votes)]
    out = marked.select(*named, measured, votes, failed.alias(free_name(marked, "base_failed")), good.alias(free_name(marked, "posterior")))
    failed_name, good_name = out.columns[-2:]
    kept = ~F.col(failed_name) & (F.col(good_name) >= 0.5)
    if carry:
        return out.withColumn(free_name(out, "kept"), kept)
    return out.select("doc_id", *(F.col(measured)[x].alias(x) for x in MEASURES), failed_name, kept.alias("kept"), good_name, F.col(votes).alias("votes"))


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with just its columns."""
    out = judge(docs, carry=True)
    return out.where(F.col(out.columns[-1])).select(*docs.columns)
