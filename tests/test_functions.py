"""Series, criteria, tensors and filters on cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckframe.functions import filters, injury, series, tensor, text
from deckframe.operators import predicates
from deckframe.operators.predicates import all_, any_, field, not_


def frame(spark, *channels, names="abc"):
    n = min(map(len, channels))
    return spark.createDataFrame([(1, i, *(float(c[i]) for c in channels)) for i in range(n)], "s int, i long, " + ", ".join(f"{names[k]} double" for k in range(len(channels))))


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_integrals_and_slopes(spark):
    x = np.array([0.0, 1, 4, 9, 16])
    df = frame(spark, x)
    assert column(series.integrate(df, "a", 0.5, ["s"]), "integral") == pytest.approx([0, 0.25, 1.5, 4.75, 11.0])
    assert column(series.integrate_over(df.withColumn("t", F.col("i") * 0.5), "t", "a", ["s"]), "integral") == pytest.approx([0, 0.25, 1.5, 4.75, 11.0])
    assert column(series.differentiate(df, "a", 1.0, ["s"]), "derivative") == pytest.approx(np.gradient(x))
    assert column(series.differentiate(frame(spark, [3.0]), "a", 1.0, ["s"]), "derivative") == [0.0]


def test_resampling(spark):
    ramp = 2 + 3 * np.arange(11) * 0.1
    out = series.resample_linear(frame(spark, ramp), "a", 0.1, 0.04, ["s"])
    assert column(out, "a") == pytest.approx(2 + 3 * np.arange(26) * 0.04) and column(out, "i") == list(range(26))
    assert column(series.resample_linear(frame(spark, ramp), "a", 0.1, 0.25, ["s"]), "a") == pytest.approx([2, 2.75, 3.5, 4.25, 5.0])
    assert column(series.resample_linear(frame(spark, [5.0]), "a", 0.1, 0.25, ["s"]), "a") == [5.0]
    assert column(series.decimate(frame(spark, ramp), 4), "a") == pytest.approx(ramp[::4]) and series.decimate(frame(spark, ramp), 1).count() == 11


def test_scalars_of_a_series(spark):
    r = series.extract(frame(spark, [1.0, -5, 3]).withColumn("t", F.col("i") * 2.0), "t", "a", ["s"]).first()
    assert (r["last"], r["first"], r["max"], r["min"], r.abs_max, r.integral) == (3, 1, 3, -5, 5, -6) and r["mean"] == pytest.approx(-1 / 3)


def test_clip_and_severity(spark):
    a = [1, 5, 6, 7, 2, 9, 9, 1]
    assert injury.clip(frame(spark, a), "a", 1e-3, ["s"], 0.003).first().clip == 5
    assert injury.clip(frame(spark, a), "a", 1e-3, ["s"], 1.0).first().clip == 1
    si = injury.severity_index(frame(spark, [-3.0, 4, 4]), "a", 0.1, ["s"]).first().severity_index
    assert si == pytest.approx(0.1 * (16 + 32))
    assert injury.severity_index(frame(spark, [4.0]), "a", 0.1, ["s"]).first().severity_index == 0


def test_hic_is_the_best_of_all_windows():
    rng = np.random.default_rng(1)
    for n in (2, 3, 30):
        a, dt = rng.uniform(-20, 80, n), 1e-3
        v = np.concatenate([[0], np.cumsum((a[1:] + a[:-1]) / 2 * dt)])
        want = max([(j - i) * dt * (max(0, v[j] - v[i]) / ((j - i) * dt)) ** 2.5 for i in range(n) for j in range(i + 1, min(n, i + 16))])
        assert injury.hic_kernel(a, dt, 0.015) == pytest.approx(want)
    assert injury.hic_kernel(np.array([1.0]), 1e-3, 0.015) == 0 and injury.hic_kernel(np.ones(5), 0.0, 1) == 0


def test_other_criteria(spark):
    df = frame(spark, [66.25, -1], [-56.45, 2], [42.87, 0])
    assert injury.bric(df, list("abc"), [66.25, 56.45, 42.87], ["s"]).first().bric == pytest.approx(math.sqrt(3))
    u = injury.ubric(df, list("abc"), list("abc"), [66.25, 56.45, 42.87], [66.25, 56.45, 42.87], ["s"]).first().ubric
    assert u == pytest.approx(math.sqrt(3))
    limits = {"distance": 0.0, "tension": 6806.0, "compression": -6160.0, "flexion": 310.0, "extension": -135.0}
    nij = lambda fz, my: injury.nij(frame(spark, [0.0], [fz], [my]), "a", "b", "c", ["s"], **limits).first().nij
    assert nij(6806.0, 310.0) == pytest.approx(2) and nij(-6160.0, -1.0) == pytest.approx(1 + 1 / 135) and nij(-6160.0, -135.0) == pytest.approx(2)
    y = 0.01 * np.arange(10)
    assert injury.vc(frame(spark, y), "a", 0.1, ["s"], 1.0, 0.229).first().vc == pytest.approx(y[7] / 0.229 * 0.1)
    assert injury.vc(frame(spark, y[:4]), "a", 0.1, ["s"]).first().vc == 0
    assert injury.tibia_index(frame(spark, [3.0], [4.0], [-10.0]), "a", "b", "c", ["s"], 5.0, -20.0).first().tibia_index == pytest.approx(1.5)
    assert injury.nic(frame(spark, [5.0, 5], [0.0, 0]), "a", "b", 1.0, ["s"]).first().nic == pytest.approx(0.2 * 5 + 25)


def test_filters(spark):
    b, a = filters.cfc_coefficients(60, 1e-4)
    assert sum(b) / sum(a) == pytest.approx(1) and a[0] == 1
    assert filters.filtfilt(b, a, np.full(50, 3.0)) == pytest.approx(np.full(50, 3.0))
    t = np.arange(2000) * 1e-4
    slow, fast = np.sin(2 * np.pi * 5 * t), np.sin(2 * np.pi * 2000 * t)
    y = filters.filtfilt(b, a, slow + fast)
    assert np.abs(y - slow)[100:-100].max() < 0.01
    assert filters.filtfilt(b, a, np.array([7.0])).tolist() == [7.0]
    ramp = np.linspace(0, 1, 2000)
    assert np.abs(filters.filtfilt(b, a, ramp) - ramp)[400:-400].max() < 1e-6
    out = filters.cfc(frame(spark, slow + fast), ["a"], ["s"], 60, 1e-4)
    assert column(out, "a") == pytest.approx(y)
    for order in (1, 2, 3, 4):
        for band, low, high in (("low", 1.0, 0.0), ("high", 0.0, 1.0)):
            b, a = filters.butterworth_coefficients(order, 100, 1000, band)
            gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 1000)) / np.polyval(a, np.exp(2j * np.pi * f / 1000)))  # noqa: B023, E731
            assert gain(1e-6) == pytest.approx(low, abs=1e-6) and gain(499.999) == pytest.approx(high, abs=1e-4) and gain(100) == pytest.approx(math.sqrt(0.5))
    for bad in ((2, 600, 1000), (0, 10, 1000)):
        with pytest.raises(ValueError):
            filters.butterworth_coefficients(*bad)


def test_tensors(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, r)) for r in rng.normal(size=(40, 6))] + [(3.0, 1.0, 2.0, 0.0, 0.0, 0.0), (0.0,) * 6, (5.0, 5.0, 5.0, 0.0, 0.0, 0.0), (1.0,) * 6]
    df = spark.createDataFrame(rows, "xx double, yy double, zz double, xy double, yz double, zx double")
    c = [F.col(x) for x in df.columns]
    got = df.select("*", tensor.principal(*c).alias("p"), tensor.von_mises(*c).alias("vm"), tensor.triaxiality(*c).alias("t"), tensor.max_shear(*c).alias("s"), tensor.pressure(*c[:3]).alias("q")).collect()
    for r in got:
        m = np.array([[r.xx, r.xy, r.zx], [r.xy, r.yy, r.yz], [r.zx, r.yz, r.zz]])
        e = np.sort(np.linalg.eigvalsh(m))[::-1]
        assert r.p == pytest.approx(e, abs=1e-6) and r.s == pytest.approx((e[0] - e[2]) / 2, abs=1e-6) and r.q == pytest.approx(-np.trace(m) / 3)
        dev = m - np.eye(3) * np.trace(m) / 3
        vm = math.sqrt(1.5 * (dev * dev).sum())
        assert r.vm == pytest.approx(vm, abs=1e-9) and r.t == pytest.approx(np.trace(m) / 3 / vm if vm > 1e-9 else 0, abs=1e-6)


def test_text_columns_agree_with_functions(spark):
    raw = ["1", " +7 ", "7.0", "-7.9", "1.5D+3", "1.234-5", "1.234+5", "-2.0d-2", "", "abc", "1.5d", "1.5f", ".5", "3.", "1e5", "99999999999999999999", "- 1", "1-", "1_0"]
    got = spark.createDataFrame([(x,) for x in raw], "r string").select("r", text.int_of(F.col("r")).alias("i"), text.float_of(F.col("r")).alias("f"), text.id_of(F.col("r")).alias("d"), text.base_of(F.col("r")).alias("b")).collect()
    for r in got:
        assert (r.i, r.f) == (text.parse_int(r.r), text.parse_float(r.r)), r
        assert r.d == text.parse_id(r.r), r
        assert r.b == text.canonical_base(r.r)


def test_predicates_are_two_valued(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "5"), (5.0, None)], "n double, t string")
    count = lambda p: df.where(predicates.over_columns(p, dict(df.dtypes))).count()
    assert count(field("n", ">", 0)) == 2 and count(not_(field("n", ">", 0))) == 1
    assert count(field("t", "==", 5)) == 1 and count(field("t", "==", "a")) == 1 and count(field("t", "<", "b")) == 0
    assert count(field("gone", "!=", 1)) == 0 and count(not_(field("gone", "!=", 1))) == 3
    assert count(all_()) == 3 and count(any_()) == 0
    assert (all_(field("a", "==", 1.0), not_(field("b", "<", 0.5))) | field("c", ">=", 1e21)).describe() == "any(all(a == 1, not(b < 0.5)), c >= 1000000000000000000000)"
    with pytest.raises(ValueError):
        field("a", "~", 1)
