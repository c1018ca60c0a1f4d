"""The pipeline against brute force, stage by stage, on a small corpus."""

import random
import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from deckframe.llm import mixing


def prose(rng, n=120):
    return "\n".join(" ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(10)) for _ in range(n // 10))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = {i: prose(rng) for i in range(60)}
    rows[60] = rows[3]
    words = rows[4].split(" ")
    words[50] = "changed"
    rows[61] = " ".join(words)
    rows[62] = "### " * 100
    rows[63] = "short"
    rows[64] = "one two three four five\n" * 40
    rows[65] = rows[5] + '\ntoken = "' + "0123456789abcdef" * 2 + '"'
    rows[66] = None
    folder = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame([(i, t, "en", ("a", "b", None)[i % 3], len(t) if t else None) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(folder / "documents.parquet"))
    return rows, str(folder)


def test_stages(spark, corpus):
    rows, sf = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[1] == "near-duplicates"
    kept = {i: t for i, t in rows.items() if i not in (62, 63, 64, 66)}
    unique = {i: t for i, t in kept.items() if i not in (60, 61, 65)}  # 65 differs from 5 in its last line only
    stage = dict(corpus_pipeline.STAGES)
    docs = stage["quality rules"](spark, docs, sf)
    assert {r.doc_id: r.text for r in docs.collect()} == kept
    docs = stage["near-duplicates"](spark, docs, sf)
    assert {r.doc_id: r.text for r in docs.collect()} == unique
    docs = stage["secret scan"](spark, docs, sf)
    assert {r.doc_id: r.text for r in docs.collect()} == unique and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    mixed = stage["mixing"](spark, docs, sf)
    times = {r.doc_id: len(r.shards) for r in mixing.decisions(mixing.plan(docs)).collect()}
    got = [r.doc_id for r in mixed.collect()]
    assert sorted(got) == sorted(i for i, n in times.items() for _ in range(n)) and mixed.columns == docs.columns
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = stage["sentencepiece"](spark, mixed, sf).collect()
    assert len(out) == len(got) and all(r.pieces == library.encode(unique[r.doc_id]) and r.round_trip for r in out)


def test_run(spark, corpus):
    rows, sf = corpus
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} <= set(range(60)) and all(r.round_trip for r in out)


def test_secrets_are_masked(spark):
    df = spark.createDataFrame([(1, 'x token = "' + "0f" * 20 + '" y', "en", "a", 60)], "doc_id long, text string, lang string, source string, n_chars long")
    (r,) = corpus_pipeline.secret_scan(spark, df, "").collect()
    assert re.fullmatch(r'x \[SECRET\]" y', r.text) and r.n_chars == len(r.text)
