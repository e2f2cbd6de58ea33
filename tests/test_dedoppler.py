"""Drift search and hit merging against plain loops."""

import numpy as np
import pytest

from skysift.operators import dedoppler


@pytest.mark.parametrize("times, channels, reach", [(1, 40, 3), (2, 50, 9), (7, 60, 20), (16, 300, 400)])
def test_track_sums(times, channels, reach):
    rng = np.random.default_rng(times)
    pad = reach + 1
    cells = np.pad(rng.integers(-50, 50, (times, channels)).astype(float), ((0, 0), (pad, pad)))
    rates = np.linspace(-1, 1, 41)
    shifts = np.rint(rates[:, None] * np.arange(times) / max(1, times - 1) * reach).astype(int) + (times > 5)
    found = dedoppler.track_sums(cells, shifts)
    for r in range(41):
        assert (found[r, pad:-pad] == sum(cells[k, pad + s : pad + s + channels] for k, s in enumerate(shifts[r]))).all()


def some_cells(seed, channels=400, times=12):
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(channels):
        for t in range(times):
            power = int(rng.integers(40, 60)) + 40 * ((f - 3 * t) % 97 == 0) + 25 * (f == 211)
            if rng.random() < 0.9:
                rows.append((f + 5, t, 20.0 * t, float(power) if rng.random() > 0.01 else None, bool(rng.random() < 0.05 or f in (70, 71)), "clash"))
    return rows


def plain_search(rows, hz, limit):
    good = [(f, t, p) for f, _, t, p, m, _ in rows if not m and p is not None]
    med = np.median([p for *_, p in good])
    sigma = 1.4826 * np.median(np.abs(np.array([p for *_, p in good]) - med))
    low, top, out = min(r[0] for r in rows), max(r[0] for r in rows), {}
    masked = {}
    for f, _, _, p, m, _ in rows:
        masked.setdefault(f, []).append(m or p is None)
    for i in range(201):
        rate, sums = -10 + 20 * i / 200, {}
        for f, t, p in good:
            c = f - int(np.rint(rate * t / hz))
            sums.setdefault(c, []).append(p - med)
        for c, v in sums.items():
            snr = sum(v) / (sigma * np.sqrt(len(v)))
            if low <= c <= top and c in masked and (c not in out or snr > out[c][0] + 1e-12):
                out[c] = (snr, rate, sum(masked[c]) * 2 > len(masked[c]))
    return {c: v for c, v in out.items() if v[0] >= limit}


@pytest.mark.parametrize("narrow", [False, True])
def test_drift_search(spark, narrow, monkeypatch):
    """One tile, and tiles hardly wider than their halo."""
    if narrow:
        monkeypatch.setattr(dedoppler, "CELLS", 12)
        monkeypatch.setattr(dedoppler, "NARROWEST", 16)
    rows = some_cells(4)
    df = spark.createDataFrame(rows, "f_idx long, t_idx int, t_sec double, power double, masked boolean, snr string").repartition(3)
    found = {r["channel"]: (r["snr"], r["drift"], r["is_rfi"]) for r in dedoppler.drift_search(df, 30.0, min_snr=6.0).collect()}
    want = plain_search(rows, 30.0, 6.0)
    assert set(found) == set(want) and len(want) > 5
    for c, (snr, drift, rfi) in want.items():
        assert found[c][0] == pytest.approx(snr) and found[c][2] == rfi
    assert all(found[c][1] == want[c][1] for c in want) and any(abs(v[1]) > 1 for v in want.values())


def test_nothing_to_search(spark):
    df = spark.createDataFrame([], "f_idx long, t_idx int, t_sec double, power double, masked boolean")
    assert dedoppler.drift_search(df, 3.0).collect() == []
    one = spark.createDataFrame([(1, 0, 0.0, 5.0, False), (2, 0, 0.0, 9.0, False)], df.schema)
    assert dedoppler.drift_search(one, 3.0).collect() == []


def plain_merge(hits):
    out, current = [], None
    for h in sorted(hits):
        if current and h[0] - current[0] <= 3 and abs(h[2] - current[2]) < 1.0:
            current = h if h[1] > current[1] else current
        else:
            out += [current] if current else []
            current = h
    return sorted(out + ([current] if current else []))


@pytest.mark.parametrize("stretch", [4, 7, 50, 1 << 16])
def test_merge(spark, stretch):
    rng = np.random.default_rng(6)
    channels = sorted({int(c) for c in np.concatenate([rng.integers(-20, 700, 260), np.arange(300, 420)])})
    hits = [(c, float(rng.integers(10, 30)), float(rng.integers(0, 4)) * 0.6, False, "x") for c in channels]
    df = spark.createDataFrame(hits, "channel long, snr double, drift double, is_rfi boolean, _all string").repartition(3)
    found = dedoppler.merge_hits(df, stretch=stretch)
    assert found.columns == df.columns
    assert sorted(tuple(r) for r in found.collect()) == plain_merge(hits)
    assert dedoppler.merge_hits(df.where("false"), stretch=stretch).collect() == []


def test_merge_of_a_million_hits(spark):
    """One dense stretch, in bounded tasks."""
    from pyspark.sql import functions as F

    df = spark.range(1_000_000).select(F.col("id").alias("channel"), (10 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 100).alias("snr"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30)) / 20).alias("drift"))
    found = dedoppler.merge_hits(df)
    assert found.rdd.getNumPartitions() > 1
    hits = [tuple(r) for r in df.collect()]
    assert sorted(tuple(r) for r in found.collect()) == plain_merge(hits)


@pytest.mark.parametrize("times,steps", [(16, 201), (5000, 201), (1, 1)])
def test_tiles_are_bounded_by_sums_and_cells(times, steps):
    width = dedoppler.tile_width(100, times, steps)
    assert width * times <= dedoppler.CELLS and width * steps <= dedoppler.CELLS
    assert dedoppler.tile_width(10**6, times, steps) >= 10**6
