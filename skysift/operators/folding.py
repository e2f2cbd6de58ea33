"""Periodic box dips by fast folding: trial periods share their sums through a tree of shifted additions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.operators.ordered import neighbours, quantiles, with_position

#: Trial box durations, and bins of the shortest one.
DURATIONS = 10
#: Additions that one task does for one series before its base periods are split up.
WORK = 2 * 10**8
#: Bins of all series that are searched in one array.
TOGETHER = 1 << 15
#: Points needed, least period (days, cadences), share of the span, and bounds of the durations.
FEWEST, LEAST_DAYS, LEAST_CADENCES = 20, 0.5, 10.0
FOUND = ("power", "period", "duration", "depth", "t0")


def search_plan(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Period range, bin width and widths of boxes of each series that is long enough.

    Periods reach from ten cadences (half a day at least) to half the span. Durations are ten even steps between
    two cadences and 0.15 of the least period; a bin is one such step.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(time).isNotNull()).select(key, time)
    near = neighbours(with_position(rows, key, time), [key], {"_before": (time, -1)})
    step = quantiles(near.withColumn("_d", F.col(time) - F.col("_before")), [key], "_d", {"cadence": 0.5})
    plan = rows.groupBy(key).agg(F.min(time).alias("start"), (F.max(time) - F.min(time)).alias("span"), F.count("*").alias("n")).where(f"n >= {FEWEST} AND span > 0").join(step, key)
    plan = plan.withColumn("low", F.greatest(LEAST_CADENCES * F.col("cadence"), F.lit(LEAST_DAYS))).withColumn("high", F.col("span") / 2)
    short = F.col("low") >= F.col("high")
    plan = plan.withColumns({"low": F.when(short, 0.05 * F.col("span")).otherwise(F.col("low")), "high": F.when(short, 0.5 * F.col("span")).otherwise(F.col("high"))})
    plan = plan.withColumn("brief", F.greatest(2.0 * F.col("cadence"), 0.005 * F.col("low")))
    longest = F.greatest(F.least(0.15 * F.col("low"), 0.05 * F.col("span")), 2.0 * F.col("brief"))
    plan = plan.withColumn("bin", (F.least(longest, 0.9 * F.col("low")) - F.col("brief")) / (DURATIONS - 1)).where("bin > 0")
    plan = plan.withColumns({
        "width": F.greatest(F.round(F.col("brief") / F.col("bin")), F.lit(1)).cast("int"), "bins": (F.floor(F.col("span") / F.col("bin")) + 1).cast("bigint"),
        "first": F.greatest(F.ceil(F.col("low") / F.col("bin")), F.lit(2)).cast("bigint"), "last": F.floor(F.col("high") / F.col("bin")).cast("bigint"),
    })
    return plan.where("last >= first").select(key, "start", "bin", "width", "bins", "first", "last")


def folded(values: np.ndarray, period: int, stride: int) -> tuple[np.ndarray, int]:
    """Profiles of a binned series at all trial periods from ``period`` bins on: row s is the one that drifts by about s * ``stride`` bins from first to last row.

    The series' rows of ``period`` bins are added in pairs, pairs of pairs and so on; each level makes twice as many trials of half as
    many blocks, so a trial costs log2 of the rows, not their number. Returns the profiles and the number of rows.
    """
    rows = 1 << max(0, int(-(-values.shape[-1] // period) - 1).bit_length())
    blocks = np.zeros((*values.shape[:-1], rows * period), values.dtype)
    blocks[..., : values.shape[-1]] = values
    blocks = blocks.reshape(*values.shape[:-1], rows, 1, period)
    size = 1
    while size < rows:
        early, late = blocks[..., 0::2, :, :], blocks[..., 1::2, :, :]
        reach = stride * size
        wrapped = np.concatenate([late, late[..., :reach]], axis=-1) if reach <= period else late[..., np.arange(period + reach) % period]
        # trials 2j and 2j + 1 take row j drifted by j and j + 1 strides: windows of the wrapped row, not copies of it
        wrapped = np.ascontiguousarray(wrapped)
        *outer, row, bin_ = wrapped.strides
        drifted = np.ndarray((*late.shape[:-1], 2, period), wrapped.dtype, wrapped, 0, (*outer, row + stride * bin_, stride * bin_, bin_))
        blocks = (early[..., None, :] + drifted).reshape(*late.shape[:-2], 2 * size, period)
        size *= 2
    return blocks[..., 0, :, :], rows


def least_ahead(values: np.ndarray, near: int, far: int, length: int) -> np.ndarray:
    """Entry s: the least of ``values`` from s + ``near`` to s + ``far``, on the last axis, for ``length`` places."""
    low, size, count = values[..., near:], 1, far - near + 1
    while 2 * size <= count:
        low = np.minimum(low[..., :-size], low[..., size:])
        size *= 2
    return np.minimum(low[..., :length], low[..., count - size : count - size + length])


def strongest(total: np.ndarray, count: np.ndarray, n: int, periods: Iterable[int], stride: int, widths: range) -> tuple[float, float, int, int, float] | None:
    """The best box: power, period (bins), width, first bin and depth. ``total``: sums of deviations from the mean per bin.

    A box holds three points or more and not all. Among equal powers the least period, then width, then bin wins.
    """
    return strongest_of([(total, count, n, periods)], stride, widths)[0]


def strongest_of(series: list[tuple[np.ndarray, np.ndarray, int, Iterable[int]]], stride: int, widths: range) -> list[tuple[float, float, int, int, float] | None]:
    """``strongest`` of several series (total, count, n, periods) at once: those that meet a period with as many rows are folded in one array.

    Boxes that begin at one bin are bounded together first, in single precision with its rounding allowed for, sums and counts as one complex number: none dips
    below the least of their sums, and their counts lie between the narrowest's and the widest's. Only bins whose bound reaches the series' best power so far
    are looked at width by width in double precision, so no box that could win is left out.
    """
    reach, boxes, longest = widths[-1], np.array(widths), max(len(total) for total, *_ in series)
    totals, both = np.zeros((len(series), longest)), np.zeros((len(series), longest), np.complex64)
    for i, (total, count, *_) in enumerate(series):
        totals[i, : len(total)], both[i, : len(total)] = total, total + 1j * count
    size = np.array([n for _, _, n, _ in series], float)
    best, found = [(0.0,) for _ in series], [None for _ in series]
    met: dict[tuple[int, int], list[int]] = {}
    for i, (total, _, _, periods) in enumerate(series):
        for period in periods:
            met.setdefault((period, int(-(-len(total) // period) - 1).bit_length()), []).append(i)

    def running_sums(values: np.ndarray, period: int) -> tuple[np.ndarray, int]:
        profiles, rows = folded(values, period, stride)
        profiles = profiles[..., : max(1, rows - 1), :]
        sums = np.empty((*profiles.shape[:-1], 1 + period + reach), values.dtype)
        sums[..., 0] = 0
        np.cumsum(profiles, axis=-1, out=sums[..., 1 : 1 + period])
        # a box may end beyond the last bin, in the first ones
        np.add(sums[..., 1 : 1 + reach], sums[..., period : period + 1], out=sums[..., 1 + period :])
        return sums, rows

    for (period, levels), held_by in sorted(met.items()):
        some = np.array(held_by)
        spans = min(longest, period << levels)
        sums, rows = running_sums(both[some, :spans], period)
        dips, points = np.ascontiguousarray(sums.real), np.ascontiguousarray(sums.imag)
        n, least = size[some], np.array([-best[i][0] for i in some])
        n1 = n.astype(np.float32)[:, None, None]
        deepest = least_ahead(dips, widths[0], reach, period) - dips[..., :period]
        # what single precision may have lost in the folds and the running sums
        lost = (period + reach + 2 * rows) * 2.0**-22 * np.maximum(dips.max(axis=(1, 2)), -dips.min(axis=(1, 2)))
        deepest -= (lost + 1e-30).astype(np.float32)[:, None, None]
        np.minimum(deepest, 0, out=deepest)
        fewest = points[..., widths[0] : widths[0] + period] - points[..., :period]
        np.maximum(fewest, 3, out=fewest)
        spread = n1 - fewest
        spread *= fewest
        most = points[..., reach : reach + period] - points[..., :period]
        crowded = 2 * most.max(axis=(1, 2)) > n
        if crowded.any():
            held = np.clip(most[crowded], 3, n1[crowded] - 1)
            spread[crowded] = np.minimum(spread[crowded], held * (n1[crowded] - held))
        # a hair lower, so that rounding excludes none
        spread *= (least * (1 - 1e-5) / n).astype(np.float32)[:, None, None]
        deepest *= deepest
        which, trials, firsts = np.unravel_index(np.flatnonzero((deepest >= spread).ravel()), spread.shape)
        if not len(firsts):
            continue
        ends, base = firsts[:, None] + boxes, ((which * dips.shape[1] + trials) * dips.shape[2])[:, None]
        dip = np.minimum(dips.ravel()[base + ends] - dips.ravel()[base + firsts[:, None]] - lost[which, None], 0.0)
        held = np.rint(points.ravel()[base + ends] - points.ravel()[base + firsts[:, None]]).astype(np.int64)
        whole = n[which].astype(np.int64)[:, None]
        fit = (held >= 3) & (held < whole)
        near = (fit & (dip * dip * whole >= (least[which] * (1 - 1e-5))[:, None] * (held * (whole - held)))).any(axis=1)
        if not near.any():
            continue
        trials, firsts, ends, held, fit, whole = (x[near] for x in (trials, firsts, ends, held, fit, whole))
        taken, which = np.unique(which[near], return_inverse=True)
        some = some[taken]
        dips, _ = running_sums(totals[some, :spans], period)
        dip = np.minimum(dips[which[:, None], trials[:, None], ends] - dips[which, trials, firsts][:, None], 0.0)
        power = np.where(fit, dip * dip * (whole / np.where(fit, held * (whole - held), 1)), 0.0)
        cuts = np.searchsorted(which, np.arange(len(some) + 1))
        for at, i in enumerate(some):
            own = slice(cuts[at], cuts[at + 1])
            top = float(power[own].max(initial=0.0))
            if top == 0 or top < -best[i][0]:
                continue
            for row, box in zip(*(x.tolist() for x in np.nonzero(power[own] == top))):
                row += cuts[at]
                length, width, first = period + stride * int(trials[row]) / max(rows - 1, 1), widths[box], int(firsts[row])
                rank = (-top, length, width, first)
                if rank < best[i]:
                    inner, of = int(held[row, box]), series[i][2]
                    best[i], found[i] = rank, (top, length, width, first, -float(dip[row, box]) * of / (inner * (of - inner)))
    return found


def _base(batch: pa.RecordBatch, i: int, names: list[str]) -> int:
    """The first base period of a row's part."""
    first, part, stride = (batch.column(names.index(c))[i].as_py() for c in ("first", "part", "stride"))
    return first + part * stride


def _together(rows: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Rows (bins, place) in runs of at most TOGETHER bins, or one row."""
    some, held = [], 0
    for bins, i in rows:
        if some and held + bins > TOGETHER:
            yield some
            some, held = [], 0
        some.append(i)
        held += bins
    yield some


def box_search(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Strongest periodic box dip of each series: ``key``, power, period, duration, depth and t0 (middle of a dip).

    Points are added up in bins of a tenth of the range of durations, so that a series that has a third of all points is small before it is dealt.
    Base periods are ``stride`` bins apart, and the trials between two of them differ by a drift of so many bins over the whole
    span, a third of the shortest duration: no dip falls between two trials. Base periods of a long series are dealt to several tasks. A
    task searches one series' bins at a time, or those of several short series. Series of less than 20 points or no length give no row; null times and values don't count.
    """
    plan = search_plan(df, key, time, value)
    rows = df.where(F.col(value).isNotNull() & F.col(time).isNotNull()).join(plan, key)
    at = F.least(F.floor((F.col(time) - F.col("start")) / F.col("bin")), F.col("bins") - 1)
    binned = rows.groupBy(key, at.alias("at")).agg(F.sum(F.col(value).cast("double")).alias("total"), F.count("*").alias("count"))
    series = binned.groupBy(key).agg(F.collect_list("at").alias("at"), F.collect_list("total").alias("total"), F.collect_list("count").alias("count")).join(plan, key)
    stride = F.greatest(F.floor(F.col("width") / 3), F.lit(1))
    parts = F.greatest(F.ceil((F.col("last") - F.col("first") + 1) / stride * F.col("bins") * 40 / WORK), F.lit(1)).cast("int")
    dealt = series.withColumn("stride", stride.cast("int")).withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = [key, "start", "bin", "width", "bins", "first", "last", "stride", "parts", "part", "at", "total", "count"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, alike = [], {}
            for i in range(batch.num_rows):
                bins, stride, parts = (batch.column(names.index(c))[i].as_py() for c in ("bins", "stride", "parts"))
                width, base = batch.column(names.index("width"))[i].as_py(), _base(batch, i, names)
                alike.setdefault((stride, parts, width, base % (stride * parts)), []).append((bins, i))
            for (stride, parts, width, _), rows in alike.items():
                for some in _together(sorted(rows)):
                    held, series = [dict(zip(names, (batch.column(c)[i].as_py() for c in range(len(names))))) for i in some], []
                    for i, row in zip(some, held):
                        counts = np.array(row["count"])
                        n, mean = int(counts.sum()), sum(row["total"]) / counts.sum()
                        count, total = np.zeros(row["bins"]), np.zeros(row["bins"])
                        count[row["at"]] = counts
                        total[row["at"]] = np.array(row["total"]) - counts * mean
                        series.append((total, count, n, range(_base(batch, i, names), row["last"] + 1, stride * parts)))
                    for row, got in zip(held, strongest_of(series, stride, range(width, width + DURATIONS))):
                        if got:
                            power, period, wide, first, depth = got
                            out.append((row[key], power, period * row["bin"], wide * row["bin"], depth, row["start"] + (first + wide / 2) * row["bin"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema.field(0).type), *(pa.array([r[c] for r in out], pa.float64()) for c in range(1, 6))], [key, *FOUND])

    # a stated number, as rows are few and each is a lot of arithmetic: small partitions must not be put together
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = dealt.select(*names).repartition(tasks, key, "part").mapInArrow(search, f"{key} {dict(df.dtypes)[key]}, {', '.join(f'{c} double' for c in FOUND)}")
    best = F.max(F.struct("power", (-F.col("period")).alias("p"), (-F.col("duration")).alias("d"), "period", "duration", "depth", "t0")).alias("b")
    return found.groupBy(key).agg(best).select(key, *(F.col(f"b.{c}").alias(c) for c in FOUND))
