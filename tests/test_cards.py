import pytest

from deckframe.functions.text import canonical_base, parse_float, parse_id, parse_int
from deckframe.sources import cards


@pytest.mark.parametrize("raw, value", [("1.5D+3", 1500.0), ("1.234-5", 1.234e-5), ("1.234+5", 1.234e5), ("-2.0d-2", -0.02), ("", None), ("abc", None), (" +3. ", 3.0), ("1.5d", None), (".5", 0.5)])
def test_floats(raw, value):
    assert parse_float(raw) == value


def test_ints_and_ids():
    assert (parse_int(" +7 "), parse_int("7.0"), parse_int("x")) == (7, None, None)
    assert (parse_id("7.0"), parse_id("-7.9"), parse_id("")) == (7, -7, None)


def test_canonical_base():
    assert [canonical_base(x) for x in ("mat_elastic_TITLE", "CONTACT_X_ID", "A_ID_TITLE", "A_TITLE_ID")] == ["MAT_ELASTIC", "CONTACT_X", "A", "A_TITLE"]


TEXTS = [b"*KEYWORD\n*NODE\n1,2\n", b"*KEYWORD\r\n$ c\r\n\r\n*NODE\r\n1\r\n", b"*NODE\n1,2", b"preamble\n$x\n*A\n", b"no keyword\n", b"", b"*A\n$ trivia\n\n*B opt LONG\n$in\n 5\n"]


@pytest.mark.parametrize("data", TEXTS)
def test_blocks_tile_the_file(data):
    blocks = cards.split_blocks(data)
    assert cards.apply_edits(data, blocks, {}) == data
    assert b"".join(data[b.start : b.end] for b in blocks) == (data if blocks else b"")


def test_trivia_belongs_to_the_keyword_below():
    a, b = cards.split_blocks(TEXTS[6])
    assert TEXTS[6][b.start : b.name_start] == b"$ trivia\n\n" and b.name == "B" and b.options == ("opt", "LONG") and (a.line, b.line) == (1, 4)


@pytest.mark.parametrize("head, fmt", [(b"*KEYWORD LONG=Y", "long"), (b"*keyword long = s", "long"), (b"*KEYWORD", "fixed"), (b"*KEYWORD LONG=N", "fixed"), (b"*NODE LONG=Y", "fixed")])
def test_long_format(head, fmt):
    assert {b.fmt for b in cards.split_blocks(head + b"\n*NODE\n1\n")} == {fmt}


@pytest.mark.parametrize("head, kind", [(b"*INCLUDE", "include"), (b"*include \r\n", "include"), (b"*INCLUDE_PATH_RELATIVE", "include_path_relative"), (b"*INCLUDE_TRANSFORM", "include_transform"), (b"*INCLUDES", None), (b"*INCLUDE_X", None), (b"*NODE", None)])
def test_include_kinds(head, kind):
    assert cards.include_kind(head) == kind


def test_file_names_continue():
    assert cards.file_name(b"$ c\ninclu +\n  des.k\n") == "includes.k"
    assert cards.file_name(b"plain.k\r\nnext\n") == "plain.k"
    assert cards.file_name(b"") is None and cards.file_name(b"$ only\n") is None


def test_cards_without_layout():
    assert list(cards.cards(b"$c\n 1,2 ,a\n       1       2\n\n  $ kept\n")) == [["1", "2", "a"], ["1", "2"], ["$ kept"]]


BLOCK = b"$ t\n*MAT_ELASTIC\n$#     mid\n         1   7.85e-9   210000.\n"


def edit(block, *args):
    return cards.set_field(block, *args)


def test_field_edit_keeps_every_other_byte():
    out, how = edit(BLOCK, 0, 2, [10] * 3, "3.5")
    assert how == "in_place" and out == BLOCK.replace(b"  210000.", b"      3.5")


def test_field_edit_pads_short_lines_and_keeps_line_ends():
    out, _ = edit(b"*A\r\n         1\r\n", 0, 2, [10] * 3, "9")
    assert out == b"*A\r\n         1                   9\r\n"


def test_field_edit_overflow_and_free():
    out, how = edit(BLOCK, 0, 1, [10] * 8, "123456789012")
    assert how == "reflowed" and out.endswith(b"\n1,123456789012,210000.\n")
    assert edit(b"*A\n1,2,3\n", 0, 1, [], "x") == (b"*A\n1,x,3\n", "in_place")
    assert edit(b"*A\n1\n", 0, 9, [10], "x") is None and edit(b"*A\n1\n", 4, 0, [10], "x") is None
    assert edit(b"*A\n1,2\n", 0, 4, [], "x") == (b"*A\n1,2,,,x\n", "in_place")


def test_set_keyword():
    data = b"$ t\n*A\n 1\n"
    assert cards.set_keyword(data, cards.split_blocks(data)[0], {"name": "B", "options": ["X=1"], "cards": [["1", "2"], ["3"]]}) == b"$ t\n*B X=1\n1,2\n3\n"


def test_edit_text():
    assert [cards.edit_text(x) for x in (7, 210000.0, 7.85e-9, 0.5, "a")] == ["7", "2.1e5", "7.85e-9", "0.5", "a"]


@pytest.mark.parametrize("chunk", [1, 5, 1 << 20])
@pytest.mark.parametrize("data", TEXTS)
def test_ranges_note_what_the_whole_file_holds(tmp_path, monkeypatch, data, chunk):
    from deckframe.sources import keyword as source

    monkeypatch.setattr(source, "CHUNK", chunk)
    path = tmp_path / "x.k"
    path.write_bytes(data)
    notes = [source._note(j) for j in source.ranges([(str(path), len(data))])]
    jobs = source.context_of(notes, len(data))
    want = cards.split_blocks(data)
    found = [r for j in jobs for r in source.heads(source.Part(j)).to_pylist() if r["n"] >= 0]
    assert [(r["name"], tuple(r["options"])) for r in found] == [(b.name, b.options) for b in want]
    assert sum(n["own"] for n in notes) == len(want) and sum(n["lines"] for n in notes) == data.count(b"\n")
    lines = [line for j in jobs for line in source.Part(j).block_line()[1:].tolist()]
    assert lines == [b.line for b in want]
