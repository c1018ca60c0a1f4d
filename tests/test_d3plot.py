import numpy as np
import pytest
from pyspark.sql import functions as F

from deckframe.functions import shell, tensor
from deckframe.sources.d3plot import WORDS, BadHeader, D3plot, Editor, Unsupported, Writer

CUBE = np.array([[x, y, z] for z in (0, 1) for y in (0, 1) for x in (0, 1)], float)


@pytest.fixture
def plot(spark, tmp_path):
    w = Writer(CUBE, solids=np.array([[*range(1, 9), 1], [*range(1, 9), 2]]), shells=np.array([[1, 2, 4, 3, 2]]), title="run", ids={"node": range(11, 19), "solid": [70, 80], "part": [7, 9]}, shell_layers=2)
    layers = np.array([[10, 0, 0, 0, 0, 0, 0.1, 0, 0, 0, 30, 0, 0, 0.2]], float)
    for k in range(3):
        solid = np.array([[100.0 * k, 0, 0, 0, 0, 0, 0.1 * k], [0, 0, 0, 50.0, 0, 0, 0.3]])
        w.add_state(k * 0.5, CUBE + [k, 0, 0], velocity=np.full((8, 3), k), solid=solid, shell=layers)
    w.write(tmp_path / "d3plot")
    return D3plot(spark, str(tmp_path / "d3plot"))


def values(df, *order):
    return [r.value for r in df.orderBy(*(order or ("state",))).collect()]


def test_hand_made_bytes(spark, tmp_path):
    w = np.zeros(64, "<i4")
    w[[15, 16, 20]] = 4, 2, 1
    states = [np.array([t, *range(6)], "<f4") for t in (0.0, 0.25)]
    (tmp_path / "p").write_bytes(w.tobytes() + np.arange(6, dtype="<f4").tobytes() + b"".join(s.tobytes() for s in states) + np.array([-999999], "<f4").tobytes())
    p = D3plot(spark, str(tmp_path / "p"))
    assert [t for *_, t in p.states] == [0.0, 0.25] and p.node_coordinates().tolist() == [[0, 1, 2], [3, 4, 5]] and p.ids("node").tolist() == [1, 2]
    assert p.blocks() == ["displacement"] and p.max_final_displacement() == 0.0


def test_header_errors(spark, tmp_path):
    (tmp_path / "x").write_bytes(bytes(400))
    with pytest.raises(BadHeader):
        D3plot(spark, str(tmp_path / "x"))
    w = np.zeros(64, "<i4")
    w[[15, 16]] = 4, 2
    (tmp_path / "y").write_bytes(w.tobytes())
    with pytest.raises(Unsupported):
        D3plot(spark, str(tmp_path / "y"))


def test_geometry(plot):
    assert plot.blocks() == ["displacement", "velocity", "solid", "shell"]
    nodes, parts = plot.connectivity("solid")
    assert nodes[0].tolist() == list(range(1, 9)) and parts.tolist() == [1, 2] and plot.connectivity("shell")[1].tolist() == [2]
    assert plot.ids("node").tolist() == list(range(11, 19)) and plot.ids("solid").tolist() == [70, 80] and plot.ids("part").tolist() == [7, 9]
    assert plot.part_titles() == {}


def test_states(plot):
    assert plot.block("velocity", 1).where("vars[0] = 1").count() == 8
    assert plot.nodes([-1]).where("node_id = 12").select("x", "time").first() == (3.0, 1.0)
    assert plot.max_final_displacement() == 2.0
    assert plot.element("solid", -1, 0)[0] == 200.0
    for bad in (3, -4):
        with pytest.raises(IndexError):
            plot.block("solid", bad)
    with pytest.raises(Unsupported):
        plot.block("beam")
    with pytest.raises(Unsupported):
        plot.global_history("kinetic_energy")


def test_part_reductions(plot):
    vm = tensor.stress_von_mises(F.col("vars"))
    assert values(plot.part_max_history("solid", vm, part_index=1)) == pytest.approx([0, 100, 200])
    assert values(plot.part_max_history("solid", vm, part_id=9)) == pytest.approx([3**0.5 * 50] * 3)
    strain = tensor.effective_plastic_strain(F.col("vars"))
    assert values(plot.part_failure_fraction("solid", strain, 0.15, part_index=1)) == [0, 0, 1]
    assert values(plot.part_percentile_history("solid", strain, 50, part_index=2)) == pytest.approx([0.3] * 3)
    assert values(plot.part_max_history("solid", vm, part_index=5)) == [0, 0, 0]
    assert [(r.entity, r.value) for r in plot.part_argmax("solid", strain, part_index=2).orderBy("state").collect()] == [(1, pytest.approx(0.3))] * 3
    assert plot.part_elements("solid", vm, part_index=1).count() == 3


def test_shell_layers(plot):
    layout = plot.shell_layout()
    assert (layout.n_layers, layout.stride) == (2, 7)
    v, at = F.col("vars"), plot.elements("shell", 0)
    row = at.select(shell.shell_von_mises(v, layout), shell.shell_von_mises(v, layout, "bottom"), shell.shell_von_mises(v, layout, "top"), shell.shell_plastic_strain(v, layout), shell.shell_plastic_strain(v, layout, 9)).first()
    assert list(row) == pytest.approx([3**0.5 * 30, 10, 3**0.5 * 30, 0.2, 0.2])


def test_family_and_edit(spark, plot, tmp_path):
    first, offset, _ = plot.states[0]
    data = open(plot.files[0], "rb").read()
    (tmp_path / "d3plot02").write_bytes(data[offset : offset + plot.control.state_bytes])
    (tmp_path / "d3plot10").write_bytes(data[offset : offset + plot.control.state_bytes])
    p = D3plot(spark, str(tmp_path / "d3plot"))
    assert len(p.states) == 5 and [f.rsplit("/", 1)[1] for f in p.files] == ["d3plot", "d3plot02", "d3plot10"]
    e = Editor(p)
    e.set_block("velocity", -1, np.full((8, 3), 42))
    (tmp_path / "copy").mkdir()
    copy = D3plot(spark, e.write(tmp_path / "copy")[0])
    assert copy.block("velocity", -1).first().vars == [42.0] * 3 and copy.block("velocity", 0).first().vars == [0.0] * 3
    with pytest.raises(Unsupported):
        e.set_block("velocity", 0, np.zeros(3))


def test_interface_forces(spark, tmp_path):
    segments = np.array([[1, 2, 4, 3, 1], [5, 6, 8, 7, 1]])
    w = Writer(CUBE, shells=segments, interface={"pressure": 1, "force": 3})
    w.add_state(0.0, CUBE, shell=[[1, 2, 3, 4], [5, 6, 7, 8]])
    w.write(tmp_path / "intfor")
    p = D3plot(spark, str(tmp_path / "intfor"))
    assert p.is_intfor and not p.is_fsifor and p.interface_fields()["force"] == (1, 3)
    assert [r.vars for r in p.interface("force").orderBy("segment").collect()] == [[2, 3, 4], [6, 7, 8]]
    with pytest.raises(Unsupported):
        p.interface("gap")
    w = Writer(CUBE, shells=segments, fsifor=2)
    w.add_state(0.0, CUBE, shell=[[1, 2], [3, 4]])
    w.write(tmp_path / "fsi")
    p = D3plot(spark, str(tmp_path / "fsi"))
    assert p.is_fsifor and values(p.fsifor(1), "segment") == [2, 4]


def test_writer_checks():
    w = Writer(CUBE)
    w.add_state(0.0, CUBE)
    with pytest.raises(Unsupported):
        w.add_state(1.0, CUBE, velocity=CUBE)
    with pytest.raises(ValueError):
        w.add_state(1.0, CUBE[:2].ravel()[:5])


def section(kind, *values):
    return np.array(values, {"i": "<i4", "f": "<f4"}[kind]).tobytes()


@pytest.fixture
def rich(spark, tmp_path):
    """A file with nodal fields, element deletion, SPH, airbag particles, a rigid body, and part titles."""
    w = np.zeros(64, "<i4")
    for k, v in {"ndim": 8, "numnp": 3, "it": 13, "iu": 1, "idtdt": 11, "nel8": 2, "nv3d": 1, "maxint": -10_001, "nmsph": 2, "npefg": 2, "nmmat": 2}.items():
        w[WORDS[k]] = v
    sph = [11, 1, 1, 6, 1, 1, 0, 1, 6, 1, 2]
    bag = [1, 2, 3, 1]
    coords, solids = np.arange(9), [1, 2, 3, 1, 1, 1, 1, 1, 1, 1, 2, 3, 1, 1, 1, 1, 1, 2]
    geometry = section("i", *sph) + section("i", *bag) + bytes(4 * 9 * 4) + section("f", *coords) + section("i", *solids)
    geometry += section("i", 1) + section("i", 1, 2, 5, 6, 0)  # a rigid body: its number, its nodes, and no active ones
    geometry += section("i", 1, 1, 2, 1) + section("i", 7, 8)  # SPH nodes with materials, words of the bags
    n_sph = 1 + 1 + 6 + 1 + 1 + 0 + 1 + 6 + 1 + 2 + 1
    parts = [("displacement", 9), ("temperature", 9), ("heat_flux", 9), ("mass_scaling", 3), ("temperature_gradient", 3), ("residual_force", 9), ("residual_moment", 9), ("solid", 2)]
    parts += [("solid_alive", 2), ("sph", 2 * n_sph), ("airbag", 2 * 1), ("airbag_particle", 3 * 2), ("rigid_body", 24)]
    states, want = b"", []
    for s in range(2):
        own = {name: np.arange(size) + 1000 * k + 100 * s for k, (name, size) in enumerate(parts)}
        own["solid_alive"] = np.array([1, s])
        want.append(own)
        states += section("f", s / 2) + b"".join(section("f", *own[name]) for name, _ in parts)
    titles = section("f", -999999.0) + section("i", 90000) + b"the run".ljust(72) + section("i", 90001, 2) + b"".join(section("i", i) + t.ljust(72) for i, t in ((41, b"left wheel"), (42, b"right"))) + section("i", 0)
    (tmp_path / "rich").write_bytes(w.tobytes() + geometry + titles)
    (tmp_path / "rich01").write_bytes(states)
    return D3plot(spark, str(tmp_path / "rich")), want, n_sph


def test_sections_beyond_nodes_and_elements(rich):
    plot, want, n_sph = rich
    assert [t for *_, t in plot.states] == [0.0, 0.5] and plot.control.sph_vars == n_sph and plot.control.rigids == 1
    assert plot.node_coordinates().ravel().tolist() == list(range(9)) and plot.part_titles() == {41: "left wheel", 42: "right"}
    for name, k in (("temperature", 3), ("heat_flux", 3), ("mass_scaling", 1), ("temperature_gradient", 1), ("residual_force", 3), ("residual_moment", 3), ("sph", n_sph), ("airbag", 1), ("airbag_particle", 2), ("rigid_body", 24)):
        for s in (0, 1):
            got = [r.vars for r in plot.block(name, s).orderBy("entity").collect()]
            assert got == np.array(want[s][name], float).reshape(-1, k).tolist(), name
    assert [(r.state, r.alive) for r in plot.alive("solid").orderBy("state", "entity").collect()] == [(0, True), (0, False), (1, True), (1, True)]


def test_entities_in_ranges(plot, monkeypatch):
    from deckframe.sources import d3plot

    monkeypatch.setattr(d3plot, "ENTITIES", 1)
    assert [(r.element_id, r.part_index, r.part_id, r.vars[0]) for r in plot.elements("solid", -1).orderBy("entity").collect()] == [(70, 1, 7, 200.0), (80, 2, 9, 0.0)]
    assert plot.nodes(0).orderBy("node_id").first().node_id == 11 and plot.max_final_displacement() == 2.0
    assert values(plot.part_max_history("solid", F.col("vars")[3], part_id=9)) == [50.0] * 3
    text = plot._part("solid", None, 9)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text


def test_many_files_are_indexed_by_tasks(spark, plot, tmp_path, monkeypatch):
    from deckframe.sources import d3plot

    monkeypatch.setattr(d3plot, "FILES", 1)
    first, offset, _ = plot.states[0]
    data = open(plot.files[0], "rb").read()
    (tmp_path / "d3plot02").write_bytes(data[offset : offset + 2 * plot.control.state_bytes])
    p = D3plot(spark, str(tmp_path / "d3plot"))
    assert [(k, t) for k, _, t in p.states] == [(0, 0.0), (0, 0.5), (0, 1.0), (1, 0.0), (1, 0.5)]


def test_geometry_past_the_end(spark, tmp_path):
    w = np.zeros(64, "<i4")
    w[[15, 16, 20]] = 4, 2_000_000, 1
    (tmp_path / "z").write_bytes(w.tobytes())
    with pytest.raises(BadHeader):
        D3plot(spark, str(tmp_path / "z"))
