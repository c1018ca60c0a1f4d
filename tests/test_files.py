"""Decks and results by URI, as a shared store gives them."""

import numpy as np

from deckframe import rules
from deckframe.deck import parse_deck
from deckframe.sources import files, lsda
from deckframe.sources.binout import Binout
from deckframe.sources.d3plot import D3plot, Writer


def test_ranged(tmp_path):
    data = bytes(range(256)) * 20
    (tmp_path / "f").write_bytes(data)
    for path in (str(tmp_path / "f"), f"file://{tmp_path}/f"):
        with files.Ranged(path) as r:
            r.BLOCK = 100
            assert len(r) == len(data) and all(r[a:b] == data[a:b] for a, b in ((0, 8), (90, 300), (10, 20), (5100, 9999), (7, 7), (0, 5120)))


def test_deck_by_uri(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "mesh.k").write_text("*KEYWORD\n*NODE\n1,0,0,0\n2,1,0,0\n")
    (tmp_path / "root.k").write_text("*KEYWORD\n*BOUNDARY_SPC_NODE\n         1\n*BOUNDARY_SPC_NODE\n         9\n*INCLUDE\nsub/../sub/mesh.k\n*INCLUDE\ngone.k\n")
    d = parse_deck(spark, f"file://{tmp_path}/root.k")
    assert [n.path for n in d.nodes] == [f"file://{tmp_path}/root.k", f"file://{tmp_path}/sub/mesh.k"] and len(d.missing_includes()) == 1
    assert d.columns("NODE")["x"].tolist() == [0.0, 1.0]
    assert [r.message for r in rules.validate(d, [rules.references_resolve()]).collect()] == ["BOUNDARY_SPC_NODE.NID references Node 9 — not defined in the deck"]


def test_results_by_uri(spark, tmp_path):
    lsda.build_series("nodout", [0.0, 0.5], {"x": np.array([[1.0, 2], [3, 4]])}, [7, 8]).write(tmp_path / "binout0000")
    b = Binout(spark, f"file://{tmp_path}/binout*")
    assert b.matrix("nodout", "x", id=8)[1].tolist() == [2, 4]
    w = Writer(np.zeros((3, 3)))
    w.add_state(0.0, np.ones((3, 3)))
    w.write(tmp_path / "d3plot")
    assert D3plot(spark, f"file://{tmp_path}/d3plot").nodes().where("x = 1").count() == 3
