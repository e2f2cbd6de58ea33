"""Drifting narrow-band signals in a spectrogram, and the merging of neighbouring hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.operators import timeseries as T
from skysift.session import cut

#: Cells, or sums of all rates, of a tile, its halo left out; least channels of one. Channels of hits that are merged at once.
CELLS, NARROWEST, STRETCH = 1 << 22, 256, 1 << 16


def track_sums(cells: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Sums along tracks: entry [r, c] adds ``cells[k, c + shifts[r, k]]`` over the times k, for all c of which no track leaves the cells.

    Times are halved again and again. Within a part only a track's shifts relative to the part's first one matter, and rates
    that agree in these share one sum; each part's sums are made of its halves', so early levels have few and late ones few parts.
    """

    def part(first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the part's distinct tracks, and which of them each rate takes."""
        if last - first == 1:
            return cells[first : first + 1], np.zeros(len(shifts), np.int64)
        middle = (first + last) // 2
        (one, of_one), (two, of_two) = part(first, middle), part(middle, last)
        made, which = np.unique(np.column_stack([of_one, of_two, shifts[:, middle] - shifts[:, first]]), axis=0, return_inverse=True)
        total = one[made[:, 0]].copy()
        for row, (_, late, by) in zip(total, made.tolist()):
            add_shifted(row, two[late], by)
        return total, which.ravel()

    sums, which = part(0, shifts.shape[1])
    out = np.zeros((len(shifts), cells.shape[1]))
    for row, k, by in zip(out, which.tolist(), shifts[:, 0].tolist()):
        add_shifted(row, sums[k], by)
    return out


def add_shifted(row: np.ndarray, values: np.ndarray, by: int) -> None:
    """Adds ``values[c + by]`` to ``row[c]`` where there is such a place."""
    width = len(row)
    if abs(by) >= width:
        return
    if by >= 0:
        row[: width - by] += values[by:]
    else:
        row[-by:] += values[:by]


def tile_width(halo: int, times: int, steps: int) -> int:
    """Channels of a tile: neither its cells nor its sums, one a channel and rate, are more than CELLS unless it is as narrow as may be."""
    return max(NARROWEST, halo, CELLS // max(times, steps))


def drift_search(cells: DataFrame, channel_hz: float, max_drift: float = 10.0, steps: int = 201, min_snr: float = 10.0) -> DataFrame:
    """``channel``, ``snr``, ``drift`` and ``is_rfi`` of each start channel whose best track reaches ``min_snr``.

    ``cells``: ``f_idx``, ``t_idx``, ``t_sec``, ``power``, ``masked``. Noise is the robust deviation of all cells that aren't masked; masked cells are
    missing from tracks. Of equal signals the lowest rate counts. A channel is interference where more than half of its cells are masked.

    Channels are dealt in tiles with a halo as wide as the largest drift, so a cell is copied to its tile and at most its halo's neighbours,
    not to every rate. A tile's size is bounded by cells and by its sums, one a channel and rate. Tracks leave the band only at its ends. Null powers count as masked; several cells of one place add up.
    """
    cells = cut(cells.select("f_idx", "t_sec", "power", (F.col("masked") | F.col("power").isNull()).alias("masked")))
    good = cells.where(~F.col("masked"))
    noise = T.robust_sigma(good, [], "power").select("med", "sigma").first()
    ends = cells.agg(F.min("t_sec").alias("start"), F.max("t_sec").alias("stop"), F.min("f_idx").alias("low"), F.max("f_idx").alias("top"), F.count_distinct("t_sec").alias("times")).first()
    shape = "channel bigint, snr double, drift double, is_rfi boolean"
    if noise is None or not noise["sigma"] or ends["stop"] <= ends["start"]:
        return cells.sparkSession.createDataFrame([], shape)
    rates = np.array([-max_drift + 2 * max_drift * i / (steps - 1) for i in range(steps)])
    halo = int(np.rint(max_drift * (ends["stop"] - ends["start"]) / channel_hz)) + 1
    width = tile_width(halo, ends["times"], steps)
    start, low, top, med, sigma = ends["start"], ends["low"], ends["top"], noise["med"], noise["sigma"]
    first = F.greatest(F.floor((F.col("f_idx") - halo - low) / width), F.lit(0))
    last = F.least(F.floor((F.col("f_idx") + halo - low) / width), F.lit((top - low) // width))
    dealt = cells.withColumn("tile", F.explode(F.sequence(first, last)))

    def search(table: pa.Table) -> pa.Table:
        at, f, t, power, masked = (table.column(c).to_numpy() for c in ("tile", "f_idx", "t_sec", "power", "masked"))
        begin = int(low + at[0] * width)
        seconds, k = np.unique(t, return_inverse=True)
        c, ok, wide = f - (begin - halo), ~masked.astype(bool), width + 2 * halo
        shape_ = (len(seconds), wide)
        where = k * wide + c
        total = np.bincount(where[ok], power[ok] - med, len(seconds) * wide).reshape(shape_)
        count = np.bincount(where[ok], minlength=len(seconds) * wide).astype(float).reshape(shape_)
        shifts = np.rint(rates[:, None] * (seconds - start)[None, :] / channel_hz).astype(np.int64)
        sums, counts = (track_sums(x, shifts)[:, halo : halo + width] for x in (total, count))
        snr = np.where(counts > 0, sums / (sigma * np.sqrt(np.maximum(counts, 1))), -np.inf)
        best = snr.argmax(axis=0)
        value = snr[best, np.arange(width)]
        rows, blocked = np.bincount(c, minlength=wide)[halo : halo + width], np.bincount(c[~ok], minlength=wide)[halo : halo + width]
        hit = np.flatnonzero((value >= min_snr) & (rows > 0))
        return pa.table({"channel": begin + hit, "snr": value[hit], "drift": rates[best[hit]], "is_rfi": 2 * blocked[hit] > rows[hit]})

    return dealt.groupBy("tile").applyInArrow(search, shape)


def merge_hits(hits: DataFrame, near: int = 3, drift_limit: float = 1.0, stretch: int = STRETCH) -> DataFrame:
    """Chains of neighbouring hits with like drift, the strongest kept.

    In order of channels, a hit joins the current one where it is at most ``near`` channels beyond it and drifts alike by less than
    ``drift_limit``; the stronger of both, the earlier of equals, is current then. Else the current one is final. ``hits`` has one row a channel, with
    ``snr`` and ``drift`` not null; other columns go along.

    Channels are cut into stretches. What a stretch does depends only on the hit that is current at its beginning, which is one of the
    ``near`` channels before it or none: each stretch states what it hands on for each of these, one row each; a pass over these rows
    gives the true ones, and every stretch is then merged with it. No task holds more than a stretch, however dense the hits.
    """
    names = hits.columns
    home = F.floor(F.col("channel") / stretch)
    inner = F.col("channel") - home * stretch
    places = F.array_compact(F.array(home, F.when(inner < near, home - 1), F.when(inner >= stretch - near, home + 1)))
    dealt = cut(hits.withColumn("_home", home).withColumn("_stretch", F.explode(places)))

    def scan(channel, snr, drift, begin: int, end: int, current: int | None):
        """Which rows become final in [begin, end), and the row handed on: the one before is current, or none."""
        final = []
        for i in range(begin, end):
            if current is None:
                current = i
            elif channel[i] - channel[current] <= near and abs(drift[i] - drift[current]) < drift_limit:
                current = i if snr[i] > snr[current] else current
            else:
                final.append(current)
                current = i
        if current is not None and not (end < len(channel) and channel[end] - channel[current] <= near):
            final.append(current)
            current = None
        return final, current

    def opened(table: pa.Table):
        table = table.sort_by("channel")
        channel, snr, drift = (table.column(c).to_pylist() for c in ("channel", "snr", "drift"))
        own = [i for i, (a, b) in enumerate(zip(table.column("_home").to_pylist(), table.column("_stretch").to_pylist())) if a == b]
        return table, channel, snr, drift, own[0], own[-1] + 1

    def handed(table: pa.Table) -> pa.Table:
        at = table.column("_stretch")[0].as_py()
        if at not in table.column("_home").to_pylist():
            return pa.table({"_stretch": pa.array([], pa.int64()), "before": pa.array([], pa.int64()), "after": pa.array([], pa.int64())})
        table, channel, snr, drift, begin, end = opened(table)
        out = [(None, scan(channel, snr, drift, begin, end, None)[1]), *((channel[i], scan(channel, snr, drift, begin, end, i)[1]) for i in range(begin))]
        return pa.table({"_stretch": [at] * len(out), "before": pa.array([b for b, _ in out], pa.int64()), "after": pa.array([None if a is None else channel[a] for _, a in out], pa.int64())})

    def carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The true current channel at the beginning of each stretch, from the rows of all in order."""
        current, at, before, ways = None, None, None, {}
        for batch in batches:
            out = []
            for k, b, a in zip(batch["_stretch"], batch["before"], batch["after"]):
                b, a = (None if pd.isna(x) else int(x) for x in (b, a))
                if k != at:
                    current = ways.get(current, ways.get(None)) if at is not None and k == at + 1 else None
                    at, ways = k, {}
                    out.append((k, current))
                ways[b] = a
            yield pd.DataFrame({"_stretch": [k for k, _ in out], "_current": pd.array([c for _, c in out], "Int64")})

    def merged(table: pa.Table) -> pa.Table:
        if table.column("_stretch")[0].as_py() not in table.column("_home").to_pylist():
            return table.select(names).slice(0, 0)
        table, channel, snr, drift, begin, end = opened(table)
        current = table.column("_current")[0].as_py()
        final, _ = scan(channel, snr, drift, begin, end, None if current is None else channel.index(current))
        return table.select(names).take(pa.array(final, pa.int64()))

    ways = cut(dealt.groupBy("_stretch").applyInArrow(handed, "_stretch bigint, before bigint, after bigint"))
    # a few rows for each stretch, so this one ordered pass is small
    carry = ways.coalesce(1).sortWithinPartitions("_stretch").mapInPandas(carried, "_stretch bigint, _current bigint")
    return dealt.join(cut(carry), "_stretch", "left").groupBy("_stretch").applyInArrow(merged, hits.schema)
