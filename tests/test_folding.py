"""The box search against sums over all points at each trial period, and on planted dips."""

import numpy as np
import pytest

from skysift.operators import folding, timeseries


def plain_drift(row, trial, levels):
    """Bins by which a row is shifted at a trial, from the bits of the row's number."""
    return sum(((row >> (k - 1)) & 1) * (((trial >> (levels - k)) + 1) >> 1) for k in range(1, levels + 1))


def plain_search(points, key):
    """Each point meets each trial period and each box that can hold it."""
    t, x = (np.array(c) for c in zip(*sorted(p for p in points[key] if None not in p)))
    n, span = len(t), t.max() - t.min()
    cadence = np.median(np.diff(t))
    low, high = max(10 * cadence, 0.5), span / 2
    if low >= high:
        low, high = 0.05 * span, 0.5 * span
    brief = max(2 * cadence, 0.005 * low)
    unit = (min(max(min(0.15 * low, 0.05 * span), 2 * brief), 0.9 * low) - brief) / 9
    width, bins = max(int(np.floor(brief / unit + 0.5)), 1), int(span // unit) + 1
    at = np.minimum(((t - t.min()) / unit).astype(int), bins - 1)
    stride, y, best = max(width // 3, 1), x - x.mean(), None
    for period in range(int(np.ceil(low / unit)), int(high // unit) + 1, stride):
        rows = int(np.ceil(bins / period))
        levels = int(np.ceil(np.log2(rows)))
        for trial in range(max(1, 2**levels - 1)):
            shift = np.array([stride * plain_drift(r, trial, levels) for r in at // period])
            phase = (at - shift) % period
            for w in range(width, width + 10):
                inside = (phase[None, :] - np.arange(period)[:, None]) % period < w
                k, total = inside.sum(axis=1), inside @ y
                fit = (k >= 3) & (k < n) & (total < 0)
                power = (total[fit] ** 2 * n / (k[fit] * (n - k[fit]))).max(initial=0)
                if power > (best[0] + 1e-12 if best else 0):
                    best = power, (period + stride * trial / max(2**levels - 1, 1)) * unit, w * unit
    return best


@pytest.fixture(scope="module")
def curves():
    rng = np.random.default_rng(11)
    out = {}
    for key in range(3):
        t = np.sort(rng.uniform(0, 60, 70)) if key else np.arange(0, 60, 0.9)
        x = 1 + rng.normal(size=len(t)) * 0.002 - 0.02 * ((t - 1) % 9.37 < 1.1)
        out[key] = list(zip(t.tolist(), x.tolist()))
    out[9] = [(float(t), 1.0) for t in range(19)]
    out[10] = [(5.0, 1.0 + i) for i in range(30)]
    out[11] = [(t, 1.0) for t, _ in out[0]]
    out[0] += [(3.3, None), (None, 1.0)]
    return out


def test_matches_sums_over_all_points(spark, curves):
    df = spark.createDataFrame([(k, t, x, "clash") for k, v in curves.items() for t, x in v], "target_id int, time double, flux double, period string").repartition(3)
    found = {r["target_id"]: r for r in folding.box_search(df, "target_id", "time", "flux").collect()}
    assert set(found) == {0, 1, 2}
    for key, r in found.items():
        power, period, duration = plain_search(curves, key)
        assert r["power"] == pytest.approx(power, rel=1e-9)
        assert r["depth"] == pytest.approx(0.02, rel=0.5)
    assert folding.box_search(df.where("false"), "target_id", "time", "flux").collect() == []


def test_parts_of_a_long_series(spark, curves, monkeypatch):
    """Base periods dealt to several tasks give the same box."""
    df = spark.createDataFrame([(k, t, x) for k in (1, 2) for t, x in curves[k]], "target_id int, time double, flux double")
    whole = sorted(folding.box_search(df, "target_id", "time", "flux").collect())
    monkeypatch.setattr(folding, "WORK", 2000)
    assert sorted(folding.box_search(df, "target_id", "time", "flux").collect()) == whole


@pytest.mark.parametrize("period", [7.3, 23.456, 61.7, 148.9])
def test_planted_periods(spark, period):
    """Dips of a long series are found at any period, as every one lies within a drift of a third of a box of some trial."""
    t = np.arange(0, 400, 0.4)
    x = 1 + np.sin(t * 7919.0) * 2e-4 - 0.05 * (t % period < 1.1)
    df = spark.createDataFrame([(1, a, b) for a, b in zip(t.tolist(), x.tolist())], "target_id int, time double, flux double")
    found = folding.box_search(df, "target_id", "time", "flux")
    best = found.first()
    ratio = best["period"] / period
    assert min(abs(ratio - k) / k for k in (1 / 3, 0.5, 1, 2, 3)) < 0.002
    assert best["depth"] == pytest.approx(0.05, rel=0.35)
    assert timeseries.dip_shape(df, "target_id", "time", "flux", found).first()["depth_snr"] > 3


def test_few_boxes_are_looked_at_one_by_one(monkeypatch):
    rng = np.random.default_rng(5)
    count = (rng.uniform(size=2000) < 0.2).astype(float)
    total, looked, rint = count * rng.normal(size=2000), [], np.rint
    monkeypatch.setattr(folding.np, "rint", lambda x, *a, **k: looked.append(np.size(x)) or rint(x, *a, **k))
    periods, widths, n = range(60, 1000, 3), range(9, 19), int(count.sum())
    found = folding.strongest(total, count, n, iter(periods), 3, widths)
    boxes, best = 0, 0.0
    for period in periods:
        profiles, rows = folding.folded(np.stack([total, count]), period, 3)
        profiles = np.concatenate([profiles, profiles[..., : widths[-1]]], axis=-1)[:, : max(1, rows - 1)]
        for width in widths:
            dip, k = np.lib.stride_tricks.sliding_window_view(profiles, width, axis=-1).sum(axis=-1)[..., :period]
            fit = (dip < 0) & (k > 2.5) & (k < n - 0.5)
            boxes, best = boxes + dip.size, max(best, (dip[fit] ** 2 * n / (k[fit] * (n - k[fit]))).max(initial=0))
    assert found[0] == pytest.approx(best, rel=1e-9)
    assert sum(looked) < boxes / 20


def test_series_searched_together_equal_each_alone(monkeypatch):
    """Series of other lengths, spans and counts, one without a dip and one with copies of a bin; and few calls for many of them."""
    rng = np.random.default_rng(8)
    series, calls, fold = [], [], folding.folded
    for i in range(12):
        bins = 900 + 37 * i
        count = rng.poisson(0.2 if i % 3 else 3.0, bins).astype(float)
        total = count * rng.normal(size=bins) - 4 * count * (np.arange(bins) % 71 < 5) if i else np.zeros(bins)
        series.append((total - count * total.sum() / count.sum(), count, int(count.sum()), range(50 + i % 2, bins // 2, 3)))
    alone = [folding.strongest(*s, 3, range(9, 19)) for s in series]
    monkeypatch.setattr(folding, "folded", lambda *a: calls.append(1) or fold(*a))
    assert folding.strongest_of(series, 3, range(9, 19)) == alone
    assert alone[0] is None and all(alone[1:])
    assert len(calls) < sum(len(s[3]) for s in series) / 2
