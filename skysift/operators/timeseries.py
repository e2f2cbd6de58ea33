"""Time-series measures per source. Series are long tables; none is collected into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.operators.ordered import neighbours, quantiles, ranked, running, with_position
from skysift.session import cut

DAYS_PER_YEAR = 365.25
MAD_TO_SIGMA = 1.4826


def sessions(df: DataFrame, key: str, time: str, gap: float, name: str = "session") -> DataFrame:
    """Number the runs of points not separated by more than ``gap``, from 0 per key."""
    rows = neighbours(with_position(df, key, time), [key], {"_before": (time, -1)})
    new = F.when(F.col(time) - F.col("_before") > gap, 1).otherwise(0)
    return running(rows, [key], {name: (new, "sum")}).drop("_before", "pos")


def _valid(value: str, err: str) -> Column:
    return F.col(value).isNotNull() & (F.col(err) > 0)


def pass_means(df: DataFrame, key: str = "target_id", time: str = "mjd", gap: float = 30.0,
               bands: Sequence[str] = ("w1", "w2")) -> DataFrame:
    """Inverse-variance means of each sky pass; passes with fewer than two good first-band points are dropped."""
    rows = sessions(df, key, time, gap, "pass")
    aggs = [F.count("*").alias("n"), F.avg(time).alias(time)]
    for b in bands:
        ok, w = _valid(b, f"{b}_err"), 1.0 / (F.col(f"{b}_err") * F.col(f"{b}_err"))
        aggs += [F.count_if(ok).alias(f"_n_{b}"), F.sum(F.when(ok, w)).alias(f"_w_{b}"), F.sum(F.when(ok, w * F.col(b))).alias(f"_s_{b}")]
    out = rows.groupBy(key, "pass").agg(*aggs).filter((F.col("n") >= 2) & (F.col(f"_n_{bands[0]}") >= 2))
    for b in bands:
        ok = F.col(f"_n_{b}") >= 2
        out = out.withColumn(b, F.when(ok, F.col(f"_s_{b}") / F.col(f"_w_{b}"))).withColumn(f"{b}_err", F.when(ok, 1.0 / F.sqrt(f"_w_{b}")))
    return out.select(key, "pass", "n", time, *[c for b in bands for c in (b, f"{b}_err")])


def weighted_trend(df: DataFrame, key: str, time: str, value: str, err: str, prefix: str, least: int = 5) -> DataFrame:
    """Weighted slope per year and slope over its error, from five sums; zero below ``least`` points."""
    ok = df.filter(_valid(value, err))
    start = ok.groupBy(key).agg(F.min(time).alias("_t0"))
    rows = ok.join(start, key)
    x, y = (F.col(time) - F.col("_t0")) / DAYS_PER_YEAR, F.col(value)
    w = 1.0 / (F.col(err) * F.col(err))
    s = rows.groupBy(key).agg(F.count("*").alias("_n"), F.sum(w).alias("_s"), F.sum(w * x).alias("_sx"), F.sum(w * y).alias("_sy"),
                              F.sum(w * x * x).alias("_sxx"), F.sum(w * x * y).alias("_sxy"))
    det = F.col("_s") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    usable = (F.col("_n") >= least) & (F.abs(det) >= 1e-30)
    slope = F.when(usable, F.try_divide(F.col("_s") * F.col("_sxy") - F.col("_sx") * F.col("_sy"), det)).otherwise(F.lit(0.0))
    error = F.sqrt(F.try_divide(F.col("_s"), det))
    sigma = F.when(usable, slope / F.greatest(error, F.lit(1e-15))).otherwise(F.lit(0.0))
    return s.select(key, F.col("_n").alias(f"{prefix}_n"), slope.alias(f"{prefix}_slope"), sigma.alias(f"{prefix}_sigma"))


def monotonicity(df: DataFrame, key: str, time: str, value: str, name: str, bins: int = 5, shortest_years: float = 0.5) -> DataFrame:
    """Share of bin-to-bin steps of the median that go the same way."""
    ok = df.filter(F.col(value).isNotNull()).select(key, time, value)
    span = ok.groupBy(key).agg(F.min(time).alias("_a"), F.max(time).alias("_b"), F.count("*").alias("_n"))
    span = span.filter((F.col("_n") >= 2 * bins) & ((F.col("_b") - F.col("_a")) / DAYS_PER_YEAR >= shortest_years))
    width = (F.col("_b") + 1e-10 - F.col("_a")) / bins
    rows = ok.join(span, key).withColumn("_bin", F.least(F.lit(bins - 1), F.floor((F.col(time) - F.col("_a")) / width)))
    mid = quantiles(rows, [key, "_bin"], value, {"_m": 0.5}, size="_k").filter("_k >= 2")
    w = Window.partitionBy(key).orderBy("_bin")  # at most `bins` rows
    step = F.col("_m") - F.lag("_m").over(w)
    s = mid.withColumn("_d", step).groupBy(key).agg(F.count("_d").alias("_k"), F.count_if(F.col("_d") > 0).alias("_up"), F.count_if(F.col("_d") < 0).alias("_down"))
    share = F.when(F.col("_k") >= 2, F.greatest("_up", "_down") / F.col("_k")).otherwise(F.lit(0.0))
    return s.select(key, share.alias(name))


def halves_shift(df: DataFrame, key: str, order: Sequence[str], value: str, name: str = "shift") -> DataFrame:
    """Median of the later half minus median of the earlier half, in order of time."""
    rows = ranked(df.filter(F.col(value).isNotNull()).select(key, *order, value), [key], order, "_rank", "_size")
    late = rows.withColumn("_late", F.col("_rank") > F.floor(F.col("_size") / 2))
    mid = quantiles(late, [key, "_late"], value, {"_m": 0.5}, size="_k")
    return mid.groupBy(key).agg((F.max(F.when(F.col("_late"), F.col("_m"))) - F.max(F.when(~F.col("_late"), F.col("_m")))).alias(name),
                                F.sum("_k").alias(f"{name}_n"))


def robust_sigma(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and robust deviation per key (standard deviation when the MAD is zero)."""
    keys = list(keys)
    mid = quantiles(df, keys, value, {"med": 0.5})
    off = (df.select(*keys, value).join(mid, keys) if keys else df.select(value).crossJoin(F.broadcast(mid))).withColumn("_off", F.abs(F.col(value) - F.col("med")))
    mad = quantiles(off, keys, "_off", {"_mad": 0.5})
    std = df.groupBy(*keys).agg(F.stddev_pop(value).alias("_std"), F.count("*").alias("n"))
    both = (lambda a, b: a.join(b, keys)) if keys else (lambda a, b: a.crossJoin(F.broadcast(b)))  # one row each without keys
    out = both(both(mid, mad), std)
    return out.withColumn("sigma", F.when(F.col("_mad") > 0, F.col("_mad") * MAD_TO_SIGMA).otherwise(F.col("_std"))).drop("_mad", "_std")


# Tier name, bin (s), cadence must be below, span must reach.
TIERS = (("1-second", 1.0, 1.0, 30.0), ("10-second", 10.0, 10.0, 300.0), ("1-minute", 60.0, 60.0, 600.0))


def resolution_tiers(df: DataFrame, key: str, time: str, value: str, sigma: float = 5.0) -> DataFrame:
    """Outliers of binned means at every usable time resolution; times are seconds."""
    ok = df.filter(F.col(value).isNotNull() & F.col(time).isNotNull()).select(key, F.col(time).alias("_t"), F.col(value).alias("_x"))
    span = ok.groupBy(key).agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.count("*").alias("_n")).filter("_n >= 10")
    length = F.col("_b") - F.col("_a")
    cadence = length / (F.col("_n") - 1)
    tiers = [F.when((cadence < below) & (length >= reach), F.struct(F.lit(i).alias("order"), F.lit(name).alias("tier"), F.lit(size).alias("size")))
             for i, (name, size, below, reach) in enumerate(TIERS)]
    full = F.struct(F.lit(len(TIERS)).alias("order"), F.lit("full-integration").alias("tier"), F.greatest(length / 10, cadence * 10).alias("size"))
    plan = span.withColumn("_tier", F.explode(F.array_compact(F.array(*tiers, full))))
    plan = plan.select(key, "_a", "_b", F.col("_tier.order").alias("tier_order"), F.col("_tier.tier").alias("tier"),
                       F.greatest(F.floor(length / F.col("_tier.size")), F.lit(1)).alias("_bins"))
    rows = ok.join(plan, key).withColumn("_bin", F.floor((F.col("_t") - F.col("_a")) / ((F.col("_b") - F.col("_a")) / F.col("_bins"))))
    means = rows.filter("_bin < _bins").groupBy(key, "tier_order", "tier", "_bin").agg(F.avg("_x").alias("_m"))
    keys = [key, "tier_order", "tier"]
    noise = robust_sigma(means, keys, "_m")
    z = means.join(noise, keys).withColumn("_z", F.when((F.col("n") >= 5) & (F.col("sigma") > 0), F.abs(F.col("_m") - F.col("med")) / F.col("sigma")))
    return z.groupBy(*keys).agg(F.count("*").alias("n_bins"), F.count_if(F.col("_z") > sigma).alias("n_anomalies"), F.coalesce(F.max("_z"), F.lit(0.0)).alias("peak"))


def tier_disagreement(tiers: DataFrame, key: str) -> DataFrame:
    """Signals seen only at the finest or only at the coarsest resolution."""
    s = tiers.groupBy(key).agg(F.count("*").alias("n_tiers"), F.min_by("n_anomalies", "tier_order").alias("_fine"), F.max_by("n_anomalies", "tier_order").alias("_coarse"))
    two = F.col("n_tiers") >= 2
    return s.select(key, "n_tiers", (two & (F.col("_fine") > 0) & (F.col("_coarse") == 0)).alias("transient_only"),
                    (two & (F.col("_coarse") > 0) & (F.col("_fine") == 0)).alias("persistent_only"))


def window_features(df: DataFrame, key: str, time: str, value: str, size: int = 50, step: int = 10) -> DataFrame:
    """Moments of sliding windows by count. Each point is copied to the few windows that hold it."""
    rows = ranked(df.select(key, F.col(time).alias("t"), F.col(value).alias("x")), [key], ["t"], "_rank", "_size")
    i = F.col("_rank") - 1
    width = F.when(F.col("_size") >= size, F.lit(size)).otherwise(F.greatest(F.floor(F.col("_size") / 2), F.lit(5)))
    hop = F.when(F.col("_size") >= size, F.lit(step)).otherwise(F.greatest(F.lit(1), F.floor(F.col("_w") / 5)))
    rows = rows.withColumn("_w", width).withColumn("_h", hop)
    first = F.greatest(F.lit(0), F.ceil((i - F.col("_w") + 1) / F.col("_h")))
    last = F.least(F.floor(i / F.col("_h")), F.floor((F.col("_size") - F.col("_w")) / F.col("_h")))
    rows = rows.withColumn("_i", i).withColumn("_f", first.cast("bigint")).withColumn("_l", last.cast("bigint")).filter("_l >= _f")
    rows = rows.withColumn("window", F.explode(F.sequence("_f", "_l")))
    # A window holds at most `size` points, so its list is small.
    g = rows.groupBy(key, "window").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"), F.skewness("x").alias("_skew"),
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("x", "t").alias("_x0"), F.max_by("x", "t").alias("_x1"),
        F.sort_array(F.collect_list("x")).alias("_xs"), F.first("_w").alias("_w"))
    n = F.size("_xs")
    g = g.withColumn("_med", (F.get("_xs", F.floor((n - 1) / 2).cast("int")) + F.get("_xs", F.floor(n / 2).cast("int"))) / 2)
    deep = F.size(F.filter("_xs", lambda v: v < F.col("_med") - 2.0 * F.col("std"))) / F.col("_w")
    dt = F.col("t1") - F.col("t0")
    return g.select(key, "window", "mean", "std", "low", "high", (1.0 - F.col("low")).alias("depth"),
                    F.when(F.col("std") > 0, F.col("_skew")).otherwise(F.lit(0.0)).alias("skew"),
                    F.when(dt > 0, (F.col("_x1") - F.col("_x0")) / dt).otherwise(F.lit(0.0)).alias("slope"), deep.alias("deep_share"),
                    ((F.col("t0") + F.col("t1")) / 2).alias("centre"), "t0", "t1")


def islands(df: DataFrame, key: str, time: str, mask: Column, value: str) -> DataFrame:
    """Runs of consecutive points that satisfy a mask: start, end, depth, length and asymmetry."""
    return _runs(with_position(df.select(key, time, value, mask.alias("_on")), key, time), key, time, value)


def _runs(rows: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Runs of positioned rows whose ``_on`` is true."""
    rows = neighbours(rows, [key], {"_was": ("_on", -1)})
    start = F.col("_on") & ~F.coalesce("_was", F.lit(False))
    rows = running(rows, [key], {"island": (start.cast("int"), "sum")}).filter("_on")
    span = rows.groupBy(key, "island").agg(F.min("pos").alias("_p0"), F.count("*").alias("n"))
    rows = rows.join(span, [key, "island"])
    left = F.col("pos") - F.col("_p0") < F.floor(F.col("n") / 2)
    g = rows.groupBy(key, "island").agg(
        F.first("n").alias("n"), F.min(time).alias("start"), F.max(time).alias("end"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.avg(F.when(left, F.col(value))).alias("_a"), F.avg(F.when(~left, F.col(value))).alias("_b"))
    asym = F.when(F.col("n") >= 2, F.least(F.lit(1.0), F.abs(F.col("_a") - F.col("_b")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-10)))).otherwise(F.lit(0.0))
    return g.select(key, "island", "n", "start", "end", (1.0 - F.col("_lo")).alias("depth"), (F.col("end") - F.col("start")).alias("duration"), asym.alias("asymmetry"))


def with_steps(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Positioned series with the difference to the point before. Written once, as callers read it often."""
    rows = neighbours(with_position(df.select(key, time, value), key, time), [key], {"_before": (value, -1)})
    return cut(rows.withColumn("_diff", F.col(value) - F.col("_before")).drop("_before"))


def difference_noise(steps: DataFrame, key: str, value: str) -> DataFrame:
    """Noise of a series from the robust deviation of its first differences."""
    diff = steps.filter("_diff IS NOT NULL")
    mid = quantiles(diff, [key], "_diff", {"_m": 0.5})
    off = diff.join(mid, key).withColumn("_off", F.abs(F.col("_diff") - F.col("_m")))
    mad = quantiles(off, [key], "_off", {"_mad": 0.5})
    std = steps.groupBy(key).agg(F.stddev_pop(value).alias("std"), F.max(F.abs("_diff")).alias("max_jump"))
    noise = F.when(F.col("_mad") > 0, F.col("_mad") * MAD_TO_SIGMA / F.sqrt(F.lit(2.0))).otherwise(F.col("std"))
    return mad.join(std, key).select(key, F.when(noise > 0, noise).otherwise(F.lit(1e-6)).alias("noise"), "std", "max_jump")


def dips(df: DataFrame, key: str, time: str, value: str, sigma: float = 3.0) -> DataFrame:
    """Dip share, deepest dip, jumps and sustained runs of each series."""
    steps = with_steps(df, key, time, value)
    base = cut(quantiles(steps, [key], value, {"med": 0.5}).join(difference_noise(steps, key, value), key))
    rows = steps.join(base, key).withColumn("_on", F.coalesce(F.col(value) < F.col("med") - sigma * F.col("noise"), F.lit(False)))
    s = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if("_on").alias("n_dips"), (F.first("med") - F.min(value)).alias("deepest"), F.first("noise").alias("noise"),
        F.count_if(F.abs("_diff") / F.col("noise") > 5 * sigma).alias("n_jumps"), F.regr_slope(F.col(value), F.col(time)).alias("trend"))
    runs = _runs(rows.select(key, time, value, "pos", "_on"), key, time, value).groupBy(key).agg(F.count_if(F.col("n") >= 3).alias("n_sustained"))
    out = s.join(runs, key, "left").filter("n >= 20")
    return out.select(key, "n", "n_dips", (F.col("n_dips") / F.col("n")).alias("dip_share"), (F.col("deepest") / F.col("noise")).alias("dip_sigma"),
                      "n_jumps", F.coalesce("n_sustained", F.lit(0)).alias("n_sustained"), "trend")


def dip_shape(df: DataFrame, key: str, time: str, value: str, found: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Symmetry, depth and duration scatter and box residual of the dips a box search found, as one score."""
    noise = difference_noise(with_steps(df, key, time, value), key, value)
    rows = df.select(key, F.col(time).alias("_t"), F.col(value).alias("_x")).join(found, key).join(noise.select(key, "noise"), key)
    turn = (F.col("_t") - F.col("t0")) / F.col("period")
    rows = rows.withColumn("_epoch", F.round(turn)).withColumn("_phase", turn - F.round(turn))
    half = F.col("duration") / F.col("period")
    # Mirror-image bins around the centre are compared to measure asymmetry.
    near = rows.filter(F.abs("_phase") <= F.greatest(half * 3, F.lit(0.05))).withColumn("_b", F.floor(F.abs("_phase") / F.greatest(half * 3, F.lit(0.05)) * 10))
    mirror = near.groupBy(key, "_b").agg(F.avg(F.when(F.col("_phase") < 0, F.col("_x"))).alias("_l"), F.avg(F.when(F.col("_phase") > 0, F.col("_x"))).alias("_r"), F.max("_x").alias("_hi"), F.min("_x").alias("_lo"))
    gap = F.col("_l") - F.col("_r")
    sym = mirror.groupBy(key).agg(F.least(F.lit(1.0), F.sqrt(F.avg(gap * gap)) / F.greatest(F.max("_hi") - F.min("_lo"), F.lit(1e-10))).alias("symmetry"))
    each = rows.filter(F.abs(F.col("_phase")) * F.col("period") <= F.col("duration") * 0.75).groupBy(key, "_epoch").agg(
        F.count("*").alias("_k"), (1.0 - F.min("_x")).alias("_d"), (F.max("_t") - F.min("_t")).alias("_len")).filter("_k >= 3 AND _d > 0")

    def scatter(c):
        return F.when((F.count("*") >= 2) & (F.avg(c) != 0), F.least(F.lit(1.0), F.stddev_pop(c) / F.abs(F.avg(c)))).otherwise(F.lit(0.0))

    vary = each.groupBy(key).agg(F.count("*").alias("n_dips"), scatter("_d").alias("depth_scatter"), scatter("_len").alias("duration_scatter"))
    model = F.when(F.abs(F.col("_phase")) <= half / 2, 1.0 - F.col("depth")).otherwise(F.lit(1.0))
    shape = rows.groupBy(key).agg(F.least(F.lit(1.0), F.sqrt(F.avg((F.col("_x") - model) * (F.col("_x") - model))) / F.first("depth")).alias("shape_residual"),
                                  (F.first("depth") / F.first("noise")).alias("depth_snr"), F.first("period").alias("period"), F.first("depth").alias("depth"))
    out = shape.join(sym, key, "left").join(vary, key, "left").na.fill(0.0)
    parts = [F.col(c) for c in ("symmetry", "depth_scatter", "duration_scatter", "shape_residual")]
    mean = 0.30 * parts[0] + 0.30 * parts[1] + 0.15 * parts[2] + 0.25 * parts[3]
    composite = 0.6 * mean + 0.4 * F.greatest(*parts)
    damped = F.when((F.col("depth_scatter") < 0.1) & (F.col("n_dips") >= 3), composite * (0.4 + 6.0 * F.col("depth_scatter"))).otherwise(composite)
    score = F.when(F.col("depth_snr") < sigma, F.lit(0.0)).otherwise(F.least(F.lit(1.0), damped))
    return out.withColumn("score", score).withColumn("is_anomalous", F.col("score") > 0.6 / sigma)
