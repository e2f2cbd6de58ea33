"""Periodogram powers against direct sums over all points and frequencies."""

import numpy as np
import pytest

from skysift.operators import periodogram


@pytest.mark.parametrize("n, count", [(1, 500), (40, 500), (3000, 500), (200, 37)])
def test_even_sums(n, count):
    rng = np.random.default_rng(n)
    t, terms = rng.uniform(0, 900, n), rng.normal(size=(2, n))
    found = periodogram.even_sums(t, terms, 1 / 900, 0.7 / count, count)
    want = terms @ np.exp(2j * np.pi * np.outer(t, 1 / 900 + 0.7 / count * np.arange(count)))
    assert np.abs(found - want).max() < 1e-9 * np.abs(terms).sum()
    assert np.allclose(periodogram.direct_sums(t, terms, np.array([0.1, 0.2])), terms @ np.exp(2j * np.pi * np.outer(t, [0.1, 0.2])))


def plain_power(points, frequencies):
    """Least squares of a sine with an offset, weighted by errors: the share of the scatter that it takes away."""
    t, y, e = np.array(points).T
    w = 1 / e**2
    w /= w.sum()
    y = y - (w * y).sum()
    out = []
    for f in frequencies:
        x = np.column_stack([np.ones_like(t), np.cos(2 * np.pi * f * t), np.sin(2 * np.pi * f * t)]) * np.sqrt(w)[:, None]
        rest = np.linalg.lstsq(x, y * np.sqrt(w), rcond=None)[0]
        out.append(1 - ((y * np.sqrt(w) - x @ rest) ** 2).sum() / (w * y * y).sum())
    return np.array(out)


@pytest.mark.parametrize("chunk, slice_", [(1 << 16, 1024), (16, 2)])
def test_powers(spark, chunk, slice_, monkeypatch):
    monkeypatch.setattr(periodogram, "CHUNK", chunk)
    monkeypatch.setattr(periodogram, "SLICE", slice_)
    rng = np.random.default_rng(5)
    series, asked = {}, {1: [17.0, 30.0, 7.7, 365.25, 2.5], 2: [11.0], 3: [5.0], 4: [5.0], 5: [5.0]}
    for key in (1, 2):
        t = np.sort(rng.uniform(50000, 50400, 90))
        series[key] = [(a, 3 * np.sin(2 * np.pi * a / 17) * (key == 1) + rng.normal(), rng.uniform(0.5, 2)) for a in t]
    series[3] = [(50000.0 + i, 1.0, 1.0) for i in range(9)]
    series[4] = [(50000.0, float(i), 1.0) for i in range(20)]
    rows = [(k, float(t), float(y), float(e), "clash") for k, v in series.items() for t, y, e in v] + [(1, 50001.5, None, 1.0, "x"), (1, 50001.5, 3.0, 0.0, "x"), (1, None, 3.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "name int, mjd double, res double, unc double, period string").repartition(3)
    periods = spark.createDataFrame([(k, p) for k, v in asked.items() for p in v] + [(1, 17.0), (1, None), (1, -3.0)], "name int, period double")
    found = {(r["name"], r["period"]): r for r in periodogram.power_at_periods(df, periods, "name", "mjd", "res", "unc").collect()}
    assert set(found) == {(k, p) for k in (1, 2) for p in asked[k]}
    for key in (1, 2):
        t = np.array([p[0] for p in series[key]])
        grid = plain_power(series[key], np.linspace(1 / (t.max() - t.min()), 0.5 / np.median(np.diff(t)), 500))
        for p in asked[key]:
            power = plain_power(series[key], [1 / p])[0]
            assert found[key, p]["power"] == pytest.approx(power, abs=1e-8)
            assert found[key, p]["ratio"] == pytest.approx(power / np.median(grid), rel=1e-6)
    assert found[1, 17.0]["ratio"] > 5 > found[1, 7.7]["ratio"]
    assert periodogram.power_at_periods(df.where("false"), periods, "name", "mjd", "res", "unc").collect() == []
