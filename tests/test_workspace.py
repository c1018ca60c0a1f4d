import json

import pytest
from pyspark.sql import functions as F

from deckframe import author, rules
from deckframe.__main__ import main
from deckframe.deck import parse_deck
from deckframe.library import Library
from deckframe.workspace import Stats, Workspace

SHARED = "*KEYWORD\n*MAT_ELASTIC\n         1\n*SECTION_SHELL\n         1\n*NODE\n1,0,0,0\n2,0,0,0\n3,0,0,0\n*END\n"
PART = "*KEYWORD\n*PART\np\n{:>10}{:>10}{:>10}\n*INCLUDE\n../shared.k\n*END\n"


@pytest.fixture
def variants(tmp_path):
    (tmp_path / "shared.k").write_text(SHARED)
    for name, part in (("a", (10, 1, 1)), ("b", (20, 1, 99))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "main.k").write_text(PART.format(*part))
    return [tmp_path / n / "main.k" for n in "ab"]


def test_a_batch_reads_shared_files_once(spark, variants):
    w = Workspace(spark)
    a, b = w.parse_decks(variants)
    assert w.stats == Stats(3, 1)
    assert [(r.deck_id, r.kind, r.phys_id) for r in w.dangling().collect()] == [(1, "Material", 99)]
    assert {(r.deck_id, r.kind): r.n for r in w.census().collect()}[1, "Node"] == 3


def test_a_batch_finds_what_decks_alone_find(spark, variants):
    own = [rules.references_resolve(), rules.duplicate_ids(), rules.unreferenced_entities()]
    w = Workspace(spark)
    w.parse_decks(variants)
    got = {(r.deck_id, r.message, r.line) for r in w.validate_decks(own).collect()}
    alone = {(k, r.message, r.line) for k, v in enumerate(variants) for r in rules.validate(parse_deck(spark, v), own).collect()}
    assert got == alone and any("99" in m for _, m, _ in got)


def test_decks_added_later_share_content(spark, variants):
    w = Workspace(spark)
    w.parse_deck(variants[0])
    w.parse_deck(variants[1])
    assert w.stats == Stats(3, 1) and w.decks[0].definition_counts().count() == 4 and w.duplicates().count() == 0


def test_author_and_read_back(spark, tmp_path):
    author.write_keyword(tmp_path / "n.k", "NODE", {"nid": [1, 2], "x": [0.5, 1e-9], "y": [2.0, 3.0], "z": [0.0, 1e20]})
    c = parse_deck(spark, tmp_path / "n.k").columns("NODE")
    assert c["nid"].tolist() == [1, 2] and c["x"].tolist() == [0.5, 1e-9] and c["z"].tolist() == [0.0, 1e20]
    with pytest.raises(ValueError):
        author.write_keyword(tmp_path / "m.k", "NODE", {"a": [1], "b": []})


def test_author_a_frame(spark, tmp_path):
    author.write_frame(author.generate_table(spark, 5000).repartition(4), str(tmp_path), "NODE", ["nid"])
    d = parse_deck(spark, tmp_path / "root.k")
    c = d.columns("NODE")
    assert d.total_files > 1 and c["nid"].tolist() == list(range(1, 5001)) and c["x"][-1] == 4999 * 1.5


def test_command_line(tmp_path, capsys):
    assert main(["generate", str(tmp_path / "g"), "--depth", "1", "--breadth", "4", "--nodes", "3"]) == 0
    assert "5 files" in capsys.readouterr().out
    assert main(["parse", "--json", str(tmp_path / "g" / "root.k")]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["total_files"] == 5 and [c["kind"] for c in out["tree"]["children"]] == ["include", "include_transform", "include", "include"]
    assert main(["parse", str(tmp_path / "g" / "root.k")]) == 0 and "5 files" in capsys.readouterr().out
    assert main(["parse", str(tmp_path / "none.k")]) == 1


def test_layouts_from_json(spark, tmp_path):
    lib = Library()
    lib.load_json(json.dumps({"VENDOR_LINK": [[{"name": "WID", "type": "integer", "width": 10}, {"name": "MID", "type": "integer", "width": 10, "link": 14}, {"name": "F", "type": "real", "width": 10}]]}))
    (tmp_path / "r.k").write_text("*KEYWORD\n*MAT_ELASTIC\n         1\n*VENDOR_LINK\n         1         1       2.5\n         2        99\n")
    d = parse_deck(spark, tmp_path / "r.k", lib)
    assert d.columns("VENDOR_LINK")["f"].tolist() == [2.5, 0.0]
    assert [r.message for r in rules.validate(d, [rules.references_resolve()]).collect()] == ["VENDOR_LINK.MID references Material 99 — not defined in the deck"]


def test_streams(spark, tmp_path):
    import numpy as np

    from deckframe.sources.d3plot import D3plot, Writer
    from deckframe.streaming import results

    w = Writer(np.zeros((4, 3)))
    for k in range(2):
        w.add_state(float(k), np.full((4, 3), k))
    w.write(tmp_path / "d3plot")
    p = D3plot(spark, str(tmp_path / "d3plot"))
    _, at, _ = p.states[0]
    (tmp_path / "live").mkdir()
    (tmp_path / "live" / "d3plot01").write_bytes((tmp_path / "d3plot").read_bytes()[at:])
    q = results.new_states(spark, str(tmp_path / "live"), "d3plot*", p.control, "displacement").writeStream.format("memory").queryName("live").start()
    q.processAllAvailable()
    (tmp_path / "live" / "d3plot02").write_bytes((tmp_path / "d3plot").read_bytes()[at : at + p.control.state_bytes])
    q.processAllAvailable()
    q.stop()
    assert spark.table("live").count() == 12 and spark.table("live").agg(F.max("time")).first()[0] == 1.0

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "ev").mkdir()
    events.repartition(3).write.parquet(str(tmp_path / "ev" / "e"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev" / "e"))
    q = results.running_peaks(stream).writeStream.format("memory").queryName("peaks").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("peaks").groupBy("user_id").agg(F.max("n").alias("n"), F.max("peak").alias("peak"))
    want = events.groupBy("user_id").agg(F.count("value").alias("n"), F.max("value").alias("peak"))
    assert last.exceptAll(want).isEmpty() and want.exceptAll(last).isEmpty()
    q = results.windowed(stream, late="40 days").writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == events.count()
