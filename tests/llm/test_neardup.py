import itertools
import random

import numpy as np
import pytest

from deckframe.llm import neardup as nd


def brute(texts, t=0.8):
    """doc -> smallest doc of its class; None texts alone."""
    sets = {}
    for i, x in texts.items():
        w = (x or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        alike = texts[a] is not None and texts[a] == texts[b] or x and y and len(x & y) >= t * len(x | y)
        if alike:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in texts}


def words(rng, n, pool=4000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def edited(rng, w, k, pool=None):
    w = list(w)
    for i in rng.sample(range(len(w)), k):
        w[i] = rng.choice(pool) if pool else f"e{rng.random()}"
    return w


def group(seed, copies, edits, pool=None):
    rng = random.Random(seed)
    base = words(rng, 120)
    return [" ".join(edited(rng, base, rng.randint(0, edits), pool)) for _ in range(copies)]


def run(spark, texts, **extra):
    df = spark.createDataFrame([(i, x) for i, x in texts.items()], "doc_id long, text string")
    return df, {r.doc_id: r.class_id for r in nd.labelled(df, **extra).collect()}


@pytest.mark.parametrize("seed, edits, pool", [(1, 6, None), (2, 10, ["x", "y", "z"]), (3, 4, ["x"])])
def test_classes_equal_brute_force(spark, seed, edits, pool):
    texts = dict(enumerate(group(seed, 40, edits, pool) + [" ".join(words(random.Random(seed + 9), 80))] + group(seed + 50, 6, 2)))
    assert run(spark, texts)[1] == brute(texts)


def test_a_text_and_its_extension_at_exactly_the_threshold(spark):
    texts = {}
    for g in (7, 14, 23, 28, 33):  # 4g and 5g shingles
        w = words(random.Random(g), 5 * g + 4, 10**9)
        texts |= {10 * g: " ".join(w[: 4 * g + 4]), 10 * g + 1: " ".join(w)}
    assert run(spark, texts)[1] == brute(texts) == {i: i // 10 * 10 for i in texts}


def test_equal_sets_share_every_band_however_often_a_passage_repeats():
    rng = random.Random(5)
    passage, tail = words(rng, 50, 10**9), words(rng, 100, 10**9)
    n, few = nd.bands(" ".join(passage * 2 + tail), nd.Words())
    m, many = nd.bands(" ".join(passage * 1000 + tail), nd.Words())
    assert n == m and (few == many).all()


def test_edges(spark):
    texts = {5: None, 6: None, 7: "", 8: "", 9: "a b", 10: "a  b", 11: "a b c", 12: " \n", 13: "x " * 50_000, 14: "x " * 50_001}
    _, got = run(spark, texts)
    assert got == {5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 9, 11: 11, 12: 12, 13: 13, 14: 13}


def test_deduplicated_keeps_one_row_a_class_and_all_columns(spark):
    rows = [(1, "a b c d e f", "k", 1), (1, "a b c d e f", "k", 1), (2, "a b c d e f", "k", 2), (None, "q r s t u", "k", 3), (None, "q r s t u", "k", 4), (4, None, None, 5), (4, None, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _nd_node string, class_id int")
    out = nd.deduplicated(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert got == [(0, "q r s t u"), (1, "a b c d e f"), (4, ""), (4, "")]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nd.labelled(df).collect() == [] and nd.deduplicated(df).collect() == []


def test_registers_agree_as_often_as_probability_jaccard_says():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    wx, wy = rng.uniform(0.5, 3, 200), rng.uniform(0.5, 3, 200)
    x, y = dict(zip(e[:200].tolist(), wx, strict=True)), dict(zip(e[100:].tolist(), wy, strict=True))
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in set(x) | set(y)) for i in set(x) & set(y))
    m = 20_000
    got = np.mean(nd.sketch(e[:200], wx, m) == nd.sketch(e[100:], wy, m))
    assert abs(got - want) < 5 * (want * (1 - want) / m) ** 0.5


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in nd.components(links).collect()}
    assert set(got.values()) == {b"\x00", b"\xf0"} and len(got) == 43
