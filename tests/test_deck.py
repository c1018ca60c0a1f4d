import pytest

from deckframe import library, rules
from deckframe.deck import parse_deck, parse_keyword_file
from deckframe.operators.predicates import all_, any_, field, not_

MESH = "*KEYWORD\n*NODE\n1,0.,0.,0.\n2,1.,0.,0.\n3,0.,1.,0.\n*END\n"


def spc(*ids):
    return "".join(f"*BOUNDARY_SPC_NODE\n{i:>10}{0:>10}{1:>10}\n" for i in ids)


def transform(name, *offsets):
    o = list(offsets) + [0] * (8 - len(offsets))
    return f"*INCLUDE_TRANSFORM\n{name}\n" + "".join(f"{x:>10}" for x in o[:7]) + f"\n{o[7]:>10}\n"


@pytest.fixture
def deck(spark, tmp_path):
    def make(**files):
        for name, text in files.items():
            path = tmp_path / (name.replace("__", "/") + ".k")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
        return parse_deck(spark, tmp_path / "root.k")

    return make


def messages(d, *r):
    return sorted(x.message for x in rules.validate(d, r).collect())


def dangling_nodes(d):
    return sorted(int(m.split("references Node ")[1].split()[0]) for m in messages(d, rules.references_resolve()))


def test_offsets_shift_a_namespace(deck):
    d = deck(root="*KEYWORD\n" + spc(1, 1000001) + transform("mesh.k", 1000000) + "*END\n", mesh=MESH)
    assert dangling_nodes(d) == [1]


def test_two_instances(deck):
    d = deck(root="*KEYWORD\n" + spc(1003, 2003, 9999) + transform("mesh.k", 1000) + transform("mesh.k", 2000), mesh=MESH)
    assert d.total_files == 3 and dangling_nodes(d) == [9999]
    assert {r.kind: r.n for r in d.definition_counts().collect()} == {"Node": 6}


def test_same_offsets_are_one_file(deck):
    d = deck(root="*KEYWORD\n" + transform("mesh.k", 5) * 2 + "*INCLUDE\nmesh.k\n", mesh=MESH)
    assert d.total_files == 3


def test_cycle_ends(deck):
    d = deck(root="*KEYWORD\n" + transform("b.k", 100), b="*KEYWORD\n" + transform("root.k", 100) + MESH[9:])
    assert d.total_files == 2


def test_sets_take_the_set_offset(deck):
    part_set = "*KEYWORD\n*SET_PART_LIST\n         1\n*END\n"
    user = library.schema("USES_SET", [[library.Field("sid", refs=("PartSet",))]])
    d = deck(root="*KEYWORD\n*USES_SET\n       501\n*USES_SET\n       101\n*USES_SET\n         1\n" + transform("s.k", 0, 0, 100, 0, 500), s=part_set)
    d.register_schema(user)
    bad = messages(d, rules.references_resolve())
    assert [m.split(" ")[3] for m in bad] == ["1", "101"]


def test_search_dirs_apply_in_any_order(deck):
    for text in ("*INCLUDE_PATH_RELATIVE\nsub\n*INCLUDE\ninner.k\n", "*INCLUDE\ninner.k\n*INCLUDE_PATH_RELATIVE\nsub\n"):
        assert deck(root=text, sub__inner=MESH).total_files == 2


def test_missing_include(deck):
    d = deck(root="*KEYWORD\n*INCLUDE\ngone.k\n")
    (f,) = rules.validate(d, [rules.include_missing()]).collect()
    assert f.message.startswith("include 'gone.k' resolves to a missing file: ") and (f.line, f.keyword) == (0, "INCLUDE")
    assert len(d.missing_includes()) == 1 and d.tree()["children"] == []


LIB = """*KEYWORD
*PART
first
         3         1         1
*PART
second
         3         1         1
*MAT_ELASTIC
         1   7.8e-9
*MAT_ELASTIC_TITLE
named
         1   7.8e-9
*SECTION_SOLID
         1         1
*END
"""


def test_duplicates(deck):
    m = messages(deck(root=LIB), rules.duplicate_ids())
    assert len(m) == 4 and m[0] == "duplicate Material id 1 — defined by 2 keywords in the deck" and sum("Part id 3" in x for x in m) == 2


def test_unreferenced(deck):
    d = deck(root="*KEYWORD\n*PART\np\n         1         1         1\n*SECTION_SOLID\n         1\n*MAT_ELASTIC\n         1\n*MAT_ELASTIC\n        99\n*DEFINE_CURVE\n         7\n*END\n")
    f = rules.validate(d, [rules.unreferenced_entities()])
    assert sorted(x.message for x in f.collect()) == ["Curve 7 is defined but never referenced", "Material 99 is defined but never referenced"]
    assert rules.is_clean(f) and {r.severity: r["count"] for r in rules.counts(f).collect()} == {"Warning": 2}
    assert messages(d, rules.unreferenced_entities(["Curve"])) == ["Curve 7 is defined but never referenced"]


RIGID = """*KEYWORD
*SECTION_SHELL
         1
*MAT_RIGID
         1   7.8e-9
*MAT_ELASTIC
         2   7.8e-9
*PART
rigid
        10         1         1
*PART
soft
        20         1         2
*LOAD_RIGID_BODY
        10         1
*LOAD_RIGID_BODY
        20         1
*CONSTRAINED_RIGID_BODIES
        10        20
*LOAD_RIGID_BODY
        77         1
*END
"""


def test_rigid_context(deck):
    assert messages(deck(root=RIGID), rules.rigid_context()) == [
        "CONSTRAINED_RIGID_BODIES.PIDC references part 20, whose material *MAT_ELASTIC is not *MAT_RIGID",
        "LOAD_RIGID_BODY.PID references part 20, whose material *MAT_ELASTIC is not *MAT_RIGID",
    ]


def test_rigid_context_falls_back_to_the_id_without_a_sign(deck):
    signed = RIGID.replace("*LOAD_RIGID_BODY\n        20", "*LOAD_RIGID_BODY\n       -20").replace("        20         1         2\n", "        20         1        -2\n")
    assert messages(deck(root=signed), rules.rigid_context()) == [
        "CONSTRAINED_RIGID_BODIES.PIDC references part 20, whose material *MAT_ELASTIC is not *MAT_RIGID",
        "LOAD_RIGID_BODY.PID references part -20, whose material *MAT_ELASTIC is not *MAT_RIGID",
    ]


def test_untracked_kinds_are_not_judged(deck):
    d = deck(root="*KEYWORD\n*PART\np\n         1         1        99\n*SECTION_SOLID\n         2\n*END\n")
    assert messages(d, rules.references_resolve()) == ["PART.SECID references Section 1 — not defined in the deck"]


def test_sensor(deck):
    d = deck(root="*KEYWORD\n*SENSOR_DEFINE_NODE\n         5         0         0\n*SENSOR_SWITCH\n         1    SENSOR         5\n*SENSOR_SWITCH\n         2    SENSOR        99\n")
    assert messages(d, rules.references_resolve()) == ["SENSOR_SWITCH.SENSID references Sensor 99 — not defined in the deck"]


def test_connectivity(deck):
    shell = "*ELEMENT_SHELL\n" + "".join(f"{x:>8}" for x in (1, 1, 1, 2, 3, 999)) + "\n" + "".join(f"{x:>8}" for x in (2, 1, 1, 2, 3, 3)) + "\n"
    d = deck(root=MESH.replace("*END\n", shell))
    assert messages(d, rules.references_resolve()) == []
    (f,) = rules.validate(d, [rules.references_resolve(connectivity=True)]).collect()
    assert f.message == "ELEMENT_SHELL.N4 references Node 999 — not defined in the deck" and f.line == 6


def test_line_numbers_in_a_deck_of_many_blocks(deck):
    n = 3000
    nodes = "".join(f"{i},0.,0.,0.\n" for i in range(1, n + 1))
    d = deck(root="*KEYWORD\n*NODE\n" + nodes + "".join(f"*BOUNDARY_SPC_NODE\n{i},0,1\n" for i in [*range(1, n), n + 1]))
    (f,) = rules.validate(d, [rules.references_resolve()]).collect()
    assert f.line == n + 2 + 2 * (n - 1) + 1


def test_high_ids(deck):
    d = deck(root="*KEYWORD\n" + spc(3000000001, 3000000009) + transform("mesh.k", 3000000000), mesh=MESH)
    assert dangling_nodes(d) == [3000000009]


def test_field_rules_and_scope(deck):
    text = "*KEYWORD\n*CONTROL_TERMINATION\n      10.0         0\n*MAT_ELASTIC\n         1   7.8e-9   210000.       0.3\n*MAT_RIGID\n         2   1.0\n"
    d = deck(root=text + "*INCLUDE\nvendor__x.k\n".replace("__", "/"), vendor__x="*KEYWORD\n*MAT_RIGID\n         3   2.0\n")
    assert messages(d, rules.field_forbidden_values("MAT_ELASTIC", "e", [1, 210000])) == ["e = 210000 is forbidden"]
    assert messages(d, rules.field_required("CONTROL_TERMINATION", field("endtim", "<=", 5))) == ["requires endtim <= 5, got 10"]
    assert messages(d, rules.field_required("MAT_ELASTIC", all_(field("pr", "<", 0.5), not_(field("nope", "==", 1))))) == []
    assert messages(d, rules.field_required("MAT_ELASTIC", any_(), when=field("e", ">", 1))) == ["requires any() when e > 1"]
    assert len(messages(d, rules.keyword_forbidden("mat_rigid"))) == 2
    assert len(messages(d, rules.keyword_forbidden("MAT_RIGID").only_in("VENDOR"))) == 1
    assert len(messages(d, rules.keyword_forbidden("MAT_RIGID").except_in("vendor"))) == 1
    assert {f.severity for f in rules.validate(d, [rules.keyword_forbidden("MAT_RIGID").with_severity("Info")]).collect()} == {"Info"}


def test_tables(deck):
    fixed = "*KEYWORD\n*NODE\n$ c\n       1             1.5             2.           -3.0       1\n\n       2           1.0D1         1.5-2\n3, 7., 8.,\n*NODE\n4,1,2,3\n"
    c = deck(root=fixed).columns("node")
    assert c["nid"].tolist() == [1, 2, 3, 4] and c["x"].tolist() == [1.5, 10.0, 7.0, 1.0] and c["y"].tolist() == [2.0, 0.015, 8.0, 2.0]
    assert c["z"].tolist() == [-3.0, 0.0, 0.0, 3.0] and c["tc"].tolist() == [1, 0, 0, 0]


def test_table_of_several_cards_and_long_format(deck):
    d = deck(root="*KEYWORD LONG=Y\n*PART\nthe heading\n" + "".join(f"{x:>20}" for x in (1, 2, 3)) + "\nrest is cut\n")
    c = d.columns("PART")
    assert c["heading"].tolist() == ["the heading"] and c["pid"].tolist() == [1] and c["mid"].tolist() == [3]
    with pytest.raises(KeyError):
        d.table("NO_SUCH")


def test_user_schema_with_arrays(deck):
    class Widget:
        wid: int = library.col(10)
        load: float = library.col(10, count=3)
        tag: str = library.col(10)

    schema = library.keyword("VENDOR_WIDGET")(Widget).schema
    d = deck(root="*VENDOR_WIDGET\n         1       1.0       2.0       3.0       abc\n2,4,5,6,de\n")
    rows = d.table_with(schema).orderBy("pos").collect()
    assert [(r.wid, r.load, r.tag) for r in rows] == [(1, [1.0, 2.0, 3.0], "abc"), (2, [4.0, 5.0, 6.0], "de")]


def test_navigation(deck):
    d = deck(root=RIGID.replace("*MAT_ELASTIC\n", "*MAT_ELASTIC_TITLE\nsteel\n"))
    part = d.part(20)
    assert part.field("PID").as_int() == 20 and part.card(0).field("heading").raw == "soft"
    assert part.material().name == "MAT_ELASTIC_TITLE" and part.material().id == 2 and part.material().title == "steel"
    assert part.section().kind == "Section" and part.eos() is None and part.reference("mid").id == 2
    assert [k.id for k in d.entities("Part")] == [10, 20] and d.get("Part", -10).id == 10 and d.part(5) is None
    assert len(d.keywords("MAT_ELASTIC")) == 1 and len(d.file("root.k")) == 11
    assert d.material(2).field("ro").value() == 7.8e-9 and d.material(2).field("nope") is None


def test_edits(deck, tmp_path):
    d = deck(root=RIGID)
    path = d.nodes[0].path
    assert d.write(path) == RIGID.encode()
    assert d.set_field(d.material(2), "e", 210000.0) == "in_place"
    assert d.material(2).field("e").raw == ""
    out = d.write(path, tmp_path / "out.k")
    assert out.decode().count("2.1e5") == 1 and parse_keyword_file(d.spark, tmp_path / "out.k").material(2).field("e").value() == 2.1e5
    assert d.set_field(d.material(2), "nope", 1) is None


def test_replace_a_keyword(deck, tmp_path):
    d = deck(root="*KEYWORD\n$ note\n*MAT_ELASTIC opt\n         1   7.8e-9\n*END\n")
    k = d.keywords(library.Names.MAT_ELASTIC)[0]
    assert d.owned(k) == {"name": "MAT_ELASTIC", "options": ["opt"], "cards": [["1", "7.8e-9"]]} or d.owned(k)["options"] == ["opt"]
    d.replace(k, "MAT_RIGID", [[1, 0.5], ["a"]], ["X=1"])
    assert d.write(k.path) == b"*KEYWORD\n$ note\n*MAT_RIGID X=1\n1,0.5\na\n*END\n"


def test_chunks_of_a_block_meet_at_lines(deck, monkeypatch):
    from deckframe.sources import keyword as source

    d = deck(root="*KEYWORD\n*NODE\n" + "".join(f"{i},{i}.5,0,0\n" for i in range(1, 2001)))
    monkeypatch.setattr(source, "CHUNK", 777)
    c = d.columns("NODE")
    assert c["nid"].tolist() == list(range(1, 2001)) and c["x"][-1] == 2000.5


PREAMBLE = "no keyword here\n$ c\n*KEYWORD\n"
MIXED = PREAMBLE + "$ above\n\n*PART_TITLE opt A\nname\nfirst\n         3         1         1\n$ in between\n*PART\nsecond\n$ c\n\n         4         1         1\nthird\n         5         2         9\n" + (
    "*NODE\n" + "".join(f"{i:>8}{i * 1.5:>16.3f}{0:>16}{0:>16}\n$ {i}\n" for i in range(1, 40)) + "*MAT_ELASTIC_TITLE\nsteel\n         1   7.8e-9  210000.\n*SECTION_SHELL\n         1\n 1.,2.,\n*SET_PART_LIST\n         8\n         3         4         5         6\n"
    "*ELEMENT_SHELL\n" + "".join(f"{i},{3 + i % 4},{i},{i + 1},{i + 2},{i + 3}\n" for i in range(1, 45)) + "\n$ trailing\n*BOUNDARY_SPC_NODE\n        99         0         1\n*END"
)


@pytest.mark.parametrize("chunk", [23, 333, 1 << 20])
def test_ranges_of_any_size_give_the_same(deck, monkeypatch, chunk):
    from deckframe.operators.predicates import field as of
    from deckframe.sources import cards
    from deckframe.sources import keyword as source

    monkeypatch.setattr(source, "CHUNK", chunk)
    d = deck(root=MIXED)
    data = MIXED.encode()
    by_windows = source.windowed_contexts(d.content._found[0], d.spark.createDataFrame(d.content.sizes, "path string, byte_count long"))
    key = lambda df: sorted(df.select([c.split()[0] for c in source.CONTEXT_SCHEMA.split(", ")]).collect(), key=lambda r: r.chunk)
    assert key(by_windows) == key(d.content.context)
    names = ("start", "end", "name_start", "body_start", "line", "name", "options", "fmt")
    own = ("span_start", "span_end", "name_start", "body_start", "line", "name", "options", "format")
    want = [tuple(getattr(b, n) if n != "options" else list(b.options) for n in names) for b in cards.split_blocks(data)]
    assert [tuple(r[n] for n in own) for r in d.blocks.orderBy("block_idx").collect()] == want
    node = d.columns("NODE")
    assert node["nid"].tolist() == list(range(1, 40)) and node["x"].tolist() == [i * 1.5 for i in range(1, 40)]
    assert d.columns("PART")["pid"].tolist() == [4, 5] and d.columns("PART")["heading"].tolist() == ["second", "third"]
    assert d.columns("ELEMENT_SHELL")["n4"].tolist() == [i + 3 for i in range(1, 45)]
    line = {(b.name, n): b.line for n, b in enumerate(cards.split_blocks(data))}
    at = {name: line[name, n] for name, n in line}
    assert sorted((r.kind, r.id, r.line) for r in d.definitions.where("kind in ('Part', 'Material', 'PartSet')").collect()) == [
        ("Material", 1, at["MAT_ELASTIC_TITLE"] + 1), ("Part", 3, at["PART_TITLE"] + 2), ("Part", 4, at["PART"] + 1), ("PartSet", 8, at["SET_PART_LIST"])]
    found = sorted(r.message for r in rules.validate(d, [rules.references_resolve(connectivity=True), rules.field_required("MAT_ELASTIC", of("e", "<", 5)), rules.field_required("SECTION_SHELL", of("t2", ">", 2))]).collect())
    assert found == sorted([
        *(f"ELEMENT_SHELL.N{k} references Node {i} — not defined in the deck" for k, top in ((1, 44), (2, 45), (3, 46), (4, 47)) for i in range(40, top + 1)),
        *(f"ELEMENT_SHELL.PID references Part {p} — not defined in the deck" for i in range(1, 45) if (p := 3 + i % 4) > 4),
        "BOUNDARY_SPC_NODE.NID references Node 99 — not defined in the deck", *(f"SET_PART_LIST.PID{k} references Part {k + 2} — not defined in the deck" for k in (3, 4)),
        "requires e < 5, got 210000", "requires t2 > 2, got 2",
    ])


def test_small_frames_are_sent_and_content_stays(deck):
    """Neither reading nor resolving deals content by file."""
    d = deck(root=MIXED)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (d.table("NODE"), d.definitions, d.references, d.dangling()):
        text = plan(df).split("InMemoryRelation")[0]
        assert "SortMergeJoin" not in text or "hashpartitioning(path" not in text, text
    assert "hashpartitioning(path#" not in plan(d.definitions).split("InMemoryRelation")[0]


def test_source(spark, tmp_path):
    from deckframe.sources.keyword import KeywordSource

    (tmp_path / "a.k").write_text(MESH)
    spark.dataSource.register(KeywordSource)
    df = spark.read.format("keyword").option("keyword", "NODE").load(str(tmp_path / "a.k"))
    assert sorted(r.nid for r in df.collect()) == [1, 2, 3]
    (tmp_path / "b.k").write_text(MIXED.replace("*END", "*VENDOR_LINK\n         1         2       2.5\n*INCLUDE\na.k\n"))
    df = spark.read.format("keyword").option("keyword", "PART").load(str(tmp_path / "b.k"))
    assert [(r.heading, r.pid) for r in df.orderBy("pos").collect()] == [("second", 4), ("third", 5)]
    layouts = '{"VENDOR_LINK": [[{"name": "WID", "type": "integer", "width": 10}, {"name": "MID", "type": "integer", "width": 10}, {"name": "F", "type": "real", "width": 10}]]}'
    df = spark.read.format("keyword").option("keyword", "VENDOR_LINK").option("layouts", layouts).load(str(tmp_path / "b.k"))
    assert [(r.wid, r.mid, r.f) for r in df.collect()] == [(1, 2, 2.5)]
    assert spark.read.format("keyword").option("keyword", "NODE").option("includes", "true").load(str(tmp_path / "b.k")).count() == 42
