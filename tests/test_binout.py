import numpy as np
import pytest
from pyspark.sql import functions as F

from deckframe.functions import filters, injury
from deckframe.sources import lsda
from deckframe.sources.binout import Binout, append

T, IDS = 7, [101, 205, 309]


@pytest.fixture
def files(tmp_path):
    time = np.arange(T) * 0.5
    x = np.arange(T * 3, dtype=float).reshape(T, 3)
    e = lsda.build_series("nodout", time, {"x acc": x.astype(np.float32), "energy": np.arange(T) * 10.0, "ragged": np.ones((T, 3))}, IDS, ["left", "right", "head"], "a title")
    for k in range(T):
        e.set(("nodout", f"d{k + 1:06d}", "ragged"), np.ones(k + 1))
    e.set(("glob", "time"), time)
    e.set(("glob", "force"), time * 2)
    e.write(tmp_path / "binout")
    return e, x, time, str(tmp_path / "binout*")


def test_tree_round_trip(files, tmp_path):
    e, *_ = files
    back = lsda.Editor.load(str(tmp_path / "binout"))
    assert back.paths() == e.paths() and all(np.array_equal(back.get(*p), e.get(*p)) for p in e.paths())
    assert back.to_bytes() == e.to_bytes()
    assert back.get("nodout", "d000001", "x acc").dtype == np.float32
    assert back.remove("nodout", "d000003") and not back.remove("nope")
    with pytest.raises(ValueError):
        back.set(("a",), np.array([1j]))


def test_every_type(tmp_path):
    e = lsda.Editor()
    for code, kind in lsda.TYPES.items():
        e.set(("t", str(code)), "text" if code == 11 else np.array([1, 2, 3]).astype(kind))
    e.write(tmp_path / "b")
    back = lsda.Editor.load(str(tmp_path / "b"))
    assert all(np.array_equal(back.get(*p), e.get(*p)) for p in e.paths())


def test_reading(spark, files):
    _, x, time, pattern = files
    b = Binout(spark, pattern, "run1")
    assert b.read() == ["glob", "nodout"] and b.ids("nodout") == IDS and b.legend("nodout") == ["left", "right", "head"] and b.title("nodout") == "a title"
    t, m = b.matrix("nodout", "x acc")
    assert np.array_equal(t, time) and np.array_equal(m, x)
    assert np.array_equal(b.matrix("nodout", "x acc", id=205)[1], x[:, 1]) and np.array_equal(b.matrix("nodout", "x acc", names=["head", "left"])[1], x[:, [2, 0]])
    with pytest.raises(ValueError):
        b.matrix("nodout", "x acc", id=1, name="a")
    with pytest.raises(KeyError):
        b.matrix("nodout", "x acc", id=1)
    assert [tuple(r) for r in b.time_series("glob", "force").orderBy("i").collect()] == [(i, v, 2 * v) for i, v in enumerate(time)]
    assert b.leaves.where("state is not null").count() == T * 4


def test_reading_by_branch_and_variable(spark, files):
    _, x, _, pattern = files
    b = Binout(spark, pattern)
    assert b.read("nodout") == ["energy", "ragged", "time", "x acc"] and "d000001" in b.channels("nodout")
    assert np.array_equal(b.read("nodout", "x acc"), x) and b.read("nodout", "energy").tolist() == [10.0 * k for k in range(T)]
    assert np.array_equal(b.read("nodout", "x acc", id=205), x[:, 1]) and np.array_equal(b.read("nodout", "x acc", names=["left", "head"]), x[:, [0, 2]])
    assert b.read("nodout", "d000002", "x acc").tolist() == x[1].tolist()
    with pytest.raises(KeyError):
        b.read("nodout", "nope")
    with pytest.raises(ValueError):
        b.read("nodout", id=205)


def test_later_files_override(spark, files, tmp_path):
    more = lsda.Editor({("glob", "force"): np.array([9.0]), ("extra", "y"): np.array([1])})
    more.write(tmp_path / "binout%001")
    b = Binout(spark, str(tmp_path / "binout"))
    assert b.read_f64("glob", "force").tolist() == [9.0] and b.read() == ["extra", "glob", "nodout"]


def test_wide_and_sink(spark, files, tmp_path):
    *_, pattern = files
    b = Binout(spark, pattern, "run1")
    w = b.wide("nodout")
    assert w.columns == ["run_id", "state", "time", "id", "entity_id", "x_acc", "energy"]
    assert w.count() == T * 3 and w.where("energy = 20").select(F.sum("x_acc")).first()[0] == 6 + 7 + 8
    (path,) = append(b, str(tmp_path / "out"))
    append(Binout(spark, pattern, "run2"), str(tmp_path / "out"))
    assert spark.read.parquet(path).groupBy("run_id").count().count() == 2


def test_filter_then_criterion(spark):
    n, dt = 801, 1e-4
    t = np.arange(n) * dt
    pulse = 80 * np.sin(np.pi * t / 0.08)
    assert injury.hic_kernel(pulse, dt, 0.036) == pytest.approx(1667.462731, abs=1e-4)
    t2 = np.arange(1401) * 5e-5
    haversine = np.where(t2 <= 0.03, 100 * np.sin(np.pi * t2 / 0.03) ** 2, 0.0)
    assert injury.hic_kernel(haversine, 5e-5, 0.036) == pytest.approx(908.805760, abs=1e-4)
    assert injury.hic_kernel(np.full(500, 50.0), dt, 0.036) == pytest.approx(0.036 * 50**2.5)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(pulse)], "s int, i long, a double")
    out = injury.hic36(filters.cfc(df, ["a"], ["s"], 1000.0, dt), "a", dt, ["s"]).first()
    assert out.hic36 == pytest.approx(1667.46, rel=2e-3)
