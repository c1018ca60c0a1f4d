"""Mixing, quality rules, URL filters, sharding and nearest neighbours against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deckframe.llm import ann, mixing, quality, sharding, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, shard int"


def measured(t):
    w = WORD.findall(t)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    count, covered = collections.Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rng = random.Random(1)
    texts = ["", " \n\t", "a", "a b a b a b", "x x x x", "é😀 b\u00a0c\u0085d", "l\nl\n\n l\nl", "# * $%&|<> a#", "a\r\nb\r\na\r\n"]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in (3, 4, 10, 50)] + ["\n".join(" ".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30)) for _ in range(20)] + ["w " * 30_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("m", quality.measures(F.col("text")))
    for r in df.collect():
        m = r.m
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == measured(texts[r.i]), texts[r.i][:50]


def prose(rng, n=200, mark=""):
    return "\n".join(" ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) + mark for _ in range(10)) for _ in range(n // 10))


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng), 1) for i in range(300)] + [(1000 + i, prose(rng, mark=rng.choice(("###", "$$$"))), 0) for i in range(40)]
    rows += [(2000 + i, "one two three four five six seven\n" * 30, 0) for i in range(20)] + [(3000 + i, "too short", 0) for i in range(10)]
    return spark.createDataFrame([(i, t, "s", q) for i, t, q in rows], DOCS), {i: q for i, _, q in rows}


def test_quality_verdicts(graded):
    df, want = graded
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert {i: int(r.kept) for i, r in got.items()} == want
    assert all(not r.kept or not r.base_failed for r in got.values())
    assert {r.doc_id for r in quality.filtered(df).collect()} == {i for i, q in want.items() if q} and quality.filtered(df).columns == df.columns


def test_fit_is_expectation_maximisation(spark):
    """The SQL fit equals a plain loop."""
    patterns = [((1, 1, 0), 50.0), ((1, -1, 0), 8.0), ((-1, -1, 1), 20.0), ((0, 1, -1), 5.0)]
    good = [0.2 if -1 in v else 0.95 for v, _ in patterns]

    def step(g):
        total = [sum(n * x for (_, n), x in zip(patterns, g, strict=True)), sum(n * (1 - x) for (_, n), x in zip(patterns, g, strict=True))]
        rate = {(r, v, c): (sum(n * (x if c == 0 else 1 - x) for (p, n), x in zip(patterns, g, strict=True) if p[r] == v) + 0.5) / (total[c] + 1.5) for r in range(3) for v in (-1, 0, 1) for c in (0, 1)}
        return (total[0] + 0.5) / (sum(total) + 1.0), rate

    prior, rate = step(good)
    for _ in range(7):
        good = []
        for v, _n in patterns:
            a = prior * np.prod([rate[r, x, 0] for r, x in enumerate(v)])
            b = (1 - prior) * np.prod([rate[r, x, 1] for r, x in enumerate(v)])
            good.append(a / (a + b))
        prior, rate = step(good)
    got = quality.fit(spark.createDataFrame([(list(v), int(n)) for v, n in patterns], "votes array<int>, n long"), 3, 7).first()
    assert got.prior == pytest.approx(prior) and all(got.rate[3 * r + v + 1][c] == pytest.approx(x) for (r, v, c), x in rate.items())


def test_quality_edges(spark):
    rows = [(None, None, None, 1), (1, "", None, 2), (1, "", None, 2)]
    df = spark.createDataFrame([(*r, "clash", True) for r in rows], DOCS + ", _quality string, kept boolean")
    assert [r.kept for r in quality.judge(df).collect()] == [False] * 3 and quality.filtered(df).columns == df.columns
    assert quality.judge(df.limit(0)).collect() == [] and quality.filtered(df.limit(0)).collect() == []


def test_verdicts_agree_with_labels(spark):
    """Held-out accuracy: the labels are never read by the fit."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    good, bad = n.get((1, True), 0), n.get((0, False), 0)
    assert good / (good + n.get((1, False), 0)) >= 0.98 and bad / max(1, bad + n.get((0, True), 0)) >= 0.98


# mixing -------------------------------------------------------------------------------------


def water(sizes, weights, ratio, cap):
    """Shares by weight, what passes the cap shared again."""
    target, left, open_ = dict.fromkeys(sizes, 0.0), ratio * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / total
        left = sum(max(0.0, target[s] - cap * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                target[s] = float(cap * sizes[s])
                open_.discard(s)
    return target


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        s = "src0" if i % 3 == 0 else rng.choice(["src1", "src10", "src2", "é", None])
        rows.append((i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), s, 1))
    df = spark.createDataFrame(rows, DOCS)
    return rows, df, mixing.plan(df, shards=8)


def test_mix_meets_its_targets(mixed):
    rows, _, mix = mixed
    got = mixing.decisions(mix).collect()
    size = {i: len(WORD.findall(t)) for i, t, *_ in rows}
    sizes = collections.Counter()
    for i, _, s, _ in rows:
        sizes[s] += size[i]
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = water(dict(sizes), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    taken = collections.Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 3 for s in sizes)
    assert mixing.decisions(mixed[2]).exceptAll(mixing.decisions(mixing.plan(mixed[1], shards=8))).isEmpty()


def test_draw_is_what_was_decided(mixed):
    rows, df, mix = mixed
    drawn = mixing.draw(df, mix)
    assert drawn.columns == df.columns
    times = {r.doc_id: len(r.shards) for r in mixing.decisions(mix).collect()}
    got = collections.Counter(r.doc_id for r in drawn.collect())
    assert got == collections.Counter({i: n for i, n in times.items() if n})


def test_many_shards_all_get_records(spark):
    df = spark.createDataFrame([(i, "w " * (i % 5 + 1), "s", 1) for i in range(6000)], DOCS)
    got = mixing.decisions(mixing.plan(df, shards=300)).collect()
    assert {s for r in got for s in r.shards} == set(range(300))


def test_tree_splits_exactly_and_fairly(spark):
    q = spark.createDataFrame([(1, 100), (2, 7), (3, 0), (4, 41)], "rank long, blocks long")
    for shards in (1, 2, 5, 8):
        ends = {r["rank"]: r.ends for r in mixing.split_tree(q, shards, seed=1).collect()}
        assert [ends[k][-1] for k in (1, 2, 3, 4)] == [100, 7, 0, 41]
        per = np.sum([np.diff([0, *e]) for e in ends.values()], axis=0)
        assert per.sum() == 148 and per.max() - per.min() <= max(1, shards.bit_length() - 1)
    # the hypergeometric law of the first source in the left half
    q = spark.createDataFrame([(1, 6), (2, 10)], "rank long, blocks long")
    left = [next(r.ends[0] for r in mixing.split_tree(q, 2, seed=s).collect() if r["rank"] == 1) for s in range(25)]
    assert 2.0 < np.mean(left) < 4.0 and len(set(left)) > 2


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(120_000))
    df = spark.createDataFrame([(1, long, "a", 0), (2, long + " x", "a", 0), (3, "a b c", "b", 0)], DOCS)
    assert {r.doc_id: r.n_words for r in quality.judge(df).collect()} == {1: 120_000, 2: 120_001, 3: 3}
    assert {r.doc_id: r.size for r in mixing.decisions(mixing.plan(df)).collect()} == {1: 120_000, 2: 120_001, 3: 3}
    assert {r.doc_id: r.size for r in sharding.shard(df, 2)[0].collect()} == {1: len(long) + 1, 2: len(long) + 3, 3: 6}
    url = "http://a.net/" + "x" * 500_000
    assert urls.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), RULES).first().rule == "net/"


def test_mix_edges(spark):
    df = spark.createDataFrame([(None, None, None, 1, 5), (1, "", "a", 1, 6), (2, "x y", "a", 1, 7), (2, "x y", "a", 1, 7)], DOCS + ", _mix_k int")
    got = mixing.decisions(mixing.plan(df)).collect()
    assert len(got) == 4 and sum(r.taken for r in got) in (4, 8) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.draw(df, mixing.plan(df)).columns == df.columns
    empty = df.limit(0)
    assert mixing.decisions(mixing.plan(empty)).collect() == [] and mixing.draw(empty, mixing.plan(empty)).collect() == []
    with pytest.raises(ValueError):
        mixing.plan(df, cap=0)


# urls ---------------------------------------------------------------------------------------

RULES = [urls.Rule("block", "net"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/"), urls.Rule("block", "a.b.org", "/f")]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


URL = st.builds("".join, st.tuples(st.sampled_from(["http://", "https://", "", "x://y://"]), st.sampled_from(["net", "Example.NET", "a.example.com", "b.org", "x.a.b.org", ".net", "knet", "É.net", "net:80", ""]), st.sampled_from(["", "/", "/en/1", "/de/", "/fr/x", "/f", "/EN/"]), st.sampled_from(["", "?q=/en/", "#/en/"])))


def test_urls(spark):
    found = set()

    @settings(max_examples=400, deadline=None, database=None)
    @given(URL)
    def gather(u):
        found.add(u)

    gather()
    pages = [(i % 7, u) for i, u in enumerate(sorted(found))] + [(1, None), (1, None), (None, "http://a.net/")] * 2
    got = urls.judge(spark.createDataFrame([(*p, "host") for p in pages], "page_id long, url string, host string"), RULES)
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(key((i, *judged(u))) for i, u in pages)
    frame = spark.createDataFrame([(r.verdict, r.host, r.path) for r in RULES], "verdict string, host string, path string")
    assert urls.judge(spark.createDataFrame(pages, "page_id long, url string"), frame).exceptAll(got).isEmpty()
    assert urls.judge(got.select("page_id", F.col("host").alias("url")).limit(0), RULES).collect() == []
    assert urls.judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), []).first().verdict == "allow"


# sharding -----------------------------------------------------------------------------------


def test_shards(spark):
    rng = random.Random(2)
    rows = [(i if i % 5 else None, None if i % 11 == 0 else "é" * rng.randint(0, 300), "s", 9) for i in range(3000)] + [(7, "same", "s", 9)] * 5
    placed, stored = sharding.shard(spark.createDataFrame(rows, DOCS), 8)
    got = placed.collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    loads, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert set(loads) == set(range(8)) and max(loads.values()) - min(loads.values()) < 700
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and {r.law for r in got} == {"bytes"}
    first = sharding.SlotMap.from_frame(stored, 1)
    second = sharding.grow(first)
    moved = [i for i in range(len(first.shard)) if first.shard[i] != second.shard[i]]
    assert moved and all(second.shard[i] == 8 for i in moved) and max(second.loads()) - min(second.loads()) < 1500 and second.version == 2
    again = sharding.SlotMap.from_frame(second.to_frame(spark), 2)
    assert again == second
    assert sharding.shard(spark.createDataFrame([], DOCS), 8)[0].collect() == []


# nearest neighbours -------------------------------------------------------------------------


def search(rows, is_query, k=10):
    valid = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = max(collections.Counter(len(v) for _, v in valid).items(), key=lambda x: (x[1], x[0]))[0]
    valid = [(i, np.array(v, float)) for i, v in valid if len(v) == dim]
    out = {}
    for q, x in valid:
        if is_query(q):
            best = {}
            for i, v in valid:
                if i != q:
                    best[i] = min(best.get(i, np.inf), float(np.sqrt(((v - x) ** 2).sum())))
            out[q] = [(i, s) for i, s in sorted(best.items(), key=lambda p: (p[1], p[0]))[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=16).astype(np.float32).tolist()) for i in range(1200)]
    rows += [(2000 + i, [1.0] + [0.0] * 15) for i in range(30)] + [(5000, [0.0] * 16), (5001, None), (5002, [float("nan")] * 16), (5003, [None] + [1.0] * 15), (None, [1.0] * 16), (5100, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, v int")
    want = search(rows, lambda i: i % 100 == 0)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hit = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert hit >= 0.9
    assert got[2000] == [(2000 + i, 0.0) for i in range(1, 11)]
    for q, near in got.items():
        assert near == sorted(near, key=lambda p: (p[1], p[0])) and all(s == pytest.approx(dict(search(rows, lambda i, q=q: i == q, 2000)[q])[i], abs=1e-12) for i, s in near[:2])


@pytest.mark.parametrize("spread", [0.0, 1e-4])
def test_rows_of_one_id_take_one_place(spark, spread):
    rng = np.random.default_rng(6)
    rows = [(int(i) + 1, [10.0, 0.0] + (0.1 * rng.normal(size=2)).tolist()) for i in range(300)]
    rows += [(10_000 + int(i), [0.0, 10.0] + rng.normal(size=2).tolist()) for i in range(300)]
    rows += [(999, [10.0, 0.0, spread * float(rng.normal()), 0.0]) for _ in range(400)] + [(5000, [10.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = search(rows, lambda i: i == 5000)[5000]
    got = ann.nearest(df, F.col("vec_id") == 5000, n_pivots=2, prefix=2, probe=2, share=1.0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for i, _ in want]


def test_few_vectors_are_all_found(spark):
    rows = [(100 * i, [float(i), 1.0]) for i in range(6)] + [(0, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert all(sum(r.query_id == 100 * i for r in got) == 5 for i in range(6))
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert ann.nearest(df.limit(1), F.col("vec_id") % 100 == 0).collect() == []


def test_hot_files_are_salted(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 20)
    monkeypatch.setattr(ann, "QUERIES", 2)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist() if i % 2 else [1.0, 1.0, 0.0, 0.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = search(rows, lambda i: i % 50 == 0)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, n_pivots=8, prefix=8, probe=8, share=1.0).orderBy("rank").collect():
        got[r.query_id].append((r.vec_id, pytest.approx(r.score)))
    assert dict(got) == want


def test_the_map_lasts_and_is_edited(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 7), "s", 9) for i in range(2000)]
    df, path = spark.createDataFrame(rows, DOCS), str(tmp_path / "map")
    first = {(r.doc_id, r.shard) for r in sharding.shard(df, 4, map_path=path)[0].collect()}
    again, table = sharding.shard(df, 4, map_path=path)
    assert {(r.doc_id, r.shard) for r in again.collect()} == first and [r.version for r in table.select("version").distinct().collect()] == [1]
    planned = sharding.with_next(again, path).collect()
    assert {r.next_shard for r in planned} == set(range(5)) and all(r.next_shard in (r.shard, 4) for r in planned)
    grown, table = sharding.shard(df, 6, map_path=path)
    assert {r.map_version for r in grown.collect()} == {3} and sorted(r.n_shards for r in table.select("version", "n_shards").distinct().collect()) == [4, 5, 6]
    loads = collections.Counter()
    for r in grown.collect():
        loads[r.shard] += r.size
    assert max(loads.values()) < 1.2 * min(loads.values())
    with pytest.raises(ValueError):
        sharding.shard(df, 3, map_path=path)


def test_a_row_that_is_there_often_spreads(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 64)
    rows = [(7, "same", "s", 9)] * 3000 + [(None, None, None, 1)] * 500 + [(i, "x" * 50, "s", 9) for i in range(500)] + [(9, "long " * 400_000, "s", 9)]
    placed = sharding.shard(spark.createDataFrame(rows, DOCS).repartition(8), 8)[0].collect()
    assert collections.Counter(r.doc_id for r in placed) == collections.Counter(r[0] for r in rows)
    assert max(collections.Counter(r.vslot for r in placed).values()) < 20
    places = collections.defaultdict(list)
    for r in placed:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
