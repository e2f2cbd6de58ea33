"""Periodogram power of unevenly sampled series on a frequency grid and at given periods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.operators.ordered import neighbours, quantiles, with_position

#: Points of a chunk and given periods of a slice that one task takes at once.
CHUNK, SLICE = 1 << 16, 1024
#: Grid cells on each side that a point is spread to, for an error of about 1e-11, and points that direct sums take at once.
SPREAD, DIRECT = 12, 1 << 12
FEWEST = 10


def even_sums(t: np.ndarray, terms: np.ndarray, first: float, step: float, count: int) -> np.ndarray:
    """Sums of ``terms * exp(2 pi i f t)`` at ``count`` even frequencies from ``first`` on, for each row of terms.

    Each point is spread by a Gaussian onto a periodic grid twice as fine as needed; one FFT then gives all frequencies, and
    the Gaussian's own transform is divided out.
    """
    half = (count + 1) // 2
    modes, cells = 2 * half, 4 * half
    turn = 2 * np.pi * step * t
    angle = np.mod(turn, 2 * np.pi)
    moved = terms * np.exp(1j * (2 * np.pi * first * t + half * turn))
    width, tau = 2 * np.pi / cells, np.pi * SPREAD / (modes * modes * 3.0)
    home = np.floor(angle / width).astype(np.int64)
    grid = np.zeros((len(terms), cells), complex)
    for near in range(1 - SPREAD, SPREAD + 1):
        cell = home + near
        weight = np.exp(-((angle - width * cell) ** 2) / (4 * tau))
        for row, values in zip(grid, moved):
            row += np.bincount(cell % cells, (values.real * weight), cells) + 1j * np.bincount(cell % cells, (values.imag * weight), cells)
    mode = np.arange(-half, half)
    found = np.fft.ifft(grid, axis=-1)[:, mode] * (np.sqrt(np.pi / tau) * np.exp(mode * mode * tau))
    return found[:, :count]


def direct_sums(t: np.ndarray, terms: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    out = np.zeros((len(terms), len(frequencies)), complex)
    for at in range(0, len(t), DIRECT):
        out += terms[:, at : at + DIRECT] @ np.exp(2j * np.pi * np.outer(t[at : at + DIRECT], frequencies))
    return out


def power_of(sums: np.ndarray, yy: float) -> np.ndarray:
    """Normalised power with a floating mean from sums of w, w y at a frequency and w at twice the frequency; weights add up to one."""
    w, wy, twice = sums
    cc, ss, cs = (1 + twice.real) / 2 - w.real**2, (1 - twice.real) / 2 - w.imag**2, twice.imag / 2 - w.real * w.imag
    det = cc * ss - cs * cs
    usable = (np.abs(det) > 1e-12) & (yy > 0)
    top = ss * wy.real**2 + cc * wy.imag**2 - 2 * cs * wy.real * wy.imag
    return np.where(usable, top / np.where(usable, det, 1) / (yy if yy > 0 else 1), np.nan)


def power_at_periods(df: DataFrame, periods: DataFrame, key: str, time: str, value: str, err: str, count: int = 500) -> DataFrame:
    """``key``, ``period``, ``power``, ``median_power`` and ``ratio`` of both for each distinct row ``key``, ``period`` of ``periods``.

    The median is that of ``count`` even frequencies from one a span to half the inverse of the median step. Powers are weighted by errors, with a
    floating mean. Series of fewer than ten points, without length or with a median step of zero give no row, nor do null or
    non-positive periods; points with a null or an error that isn't positive don't count. The ratio is 0 where the median is.

    A series is cut into chunks of points; a chunk's sums at all frequencies are one row, and sums of chunks add up. No point
    meets a frequency as a row.
    """
    rows = df.where((F.col(err) > 0) & F.col(value).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("k"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("y"), (1.0 / (F.col(err) * F.col(err))).alias("w"))
    wanted = periods.where("period > 0").select(F.col(key).alias("k"), F.col("period").cast("double").alias("period")).distinct()
    rows = rows.join(wanted.select("k").distinct(), "k", "left_semi")
    near = neighbours(with_position(rows.select("k", "t"), "k", "t"), ["k"], {"before": ("t", -1)})
    step = quantiles(near.withColumn("d", F.col("t") - F.col("before")), ["k"], "d", {"step": 0.5})
    plan = rows.groupBy("k").agg(
        F.count("*").alias("n"), F.min("t").alias("start"), (F.max("t") - F.min("t")).alias("span"), F.sum("w").alias("all"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean"),
    ).where(f"n >= {FEWEST} AND span > 0").join(step.where("step > 0"), "k")
    low, high = 1.0 / F.col("span"), 0.5 / F.col("step")
    plan = plan.select("k", "start", "all", "mean", low.alias("low"), ((high - low) / (count - 1)).alias("by"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    # periods of a key are numbered by hash into slices; most keys have one
    sliced = wanted.join(wanted.groupBy("k").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")), "k").join(plan.select("k", "chunks"), "k")
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    none = F.lit(None).cast("double")
    asked = sliced.select("k", every.alias("chunk"), F.pmod(F.xxhash64("period"), F.col("slices")).cast("int").alias("slice"), F.col("period").alias("t"), none.alias("y"), none.alias("w"), none.alias("low"), none.alias("by"))
    points = rows.join(plan, "k").join(sliced.select("k", "slices").distinct(), "k")
    points = points.select(
        "k", F.pmod(F.xxhash64("t", "y"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
        (F.col("t") - F.col("start")).alias("t"), (F.col("y") - F.col("mean")).alias("y"), (F.col("w") / F.col("all")).alias("w"), "low", "by",
    )

    def summed(table: pa.Table) -> pa.Table:
        t, y, w, first, by = (table.column(c).to_numpy() for c in ("t", "y", "w", "low", "by"))
        given = np.isnan(w)
        asked_, point = np.sort(t[given]), ~given
        if not point.any():
            return pa.table({"k": table.column("k").slice(0, 0), "slice": pa.array([], pa.int32()), "yy": pa.array([], pa.float64()), "periods": pa.array([], pa.binary()), "grid": pa.array([], pa.binary()), "at": pa.array([], pa.binary())})
        t, y, w = t[point], y[point], w[point]
        one, two = np.array([w, w * y]), np.array([w])
        grid = b""
        if table.column("slice")[0].as_py() == 0:
            f, d = first[point][0], by[point][0]
            grid = np.concatenate([even_sums(t, one, f, d, count), even_sums(t, two, 2 * f, 2 * d, count)]).tobytes()
        at = np.concatenate([direct_sums(t, one, 1 / asked_), direct_sums(t, two, 2 / asked_)]).tobytes()
        return pa.table({"k": table.column("k").slice(0, 1), "slice": table.column("slice").slice(0, 1), "yy": [float((w * y * y).sum())], "periods": pa.array([asked_.tobytes()], pa.binary()), "grid": pa.array([grid], pa.binary()), "at": pa.array([at], pa.binary())})

    kind = dict(wanted.dtypes)["k"]
    sums = points.unionByName(asked).groupBy("k", "chunk", "slice").applyInArrow(summed, f"k {kind}, slice int, yy double, periods binary, grid binary, at binary")

    def finished(table: pa.Table) -> pa.Table:
        slices: dict = {}
        for number, yy, given, grid, at in zip(*(table.column(c).to_pylist() for c in ("slice", "yy", "periods", "grid", "at"))):
            row = slices.setdefault(number, [0.0, np.frombuffer(given), 0, 0])
            row[0] += yy
            row[2] = row[2] + np.frombuffer(grid, complex)
            row[3] = row[3] + np.frombuffer(at, complex)
        yy = slices[0][0]
        powers = power_of(slices[0][2].reshape(3, -1), yy)
        median = float(np.median(powers[~np.isnan(powers)])) if (~np.isnan(powers)).any() else None
        given = np.concatenate([row[1] for row in slices.values()])
        power = np.concatenate([power_of(row[3].reshape(3, -1), yy) for row in slices.values()])
        ratio = [p / median if median and median > 0 else 0.0 for p in power.tolist()]
        missing = np.isnan(power)
        return pa.table({"k": pa.array([table.column("k")[0].as_py()] * len(given), table.schema.field("k").type), "period": given, "power": pa.array(power, mask=missing), "median_power": pa.array([median] * len(given), pa.float64()), "ratio": pa.array(np.array(ratio, float), mask=missing)})

    found = sums.groupBy("k").applyInArrow(finished, f"k {kind}, period double, power double, median_power double, ratio double")
    return found.withColumnRenamed("k", key)
