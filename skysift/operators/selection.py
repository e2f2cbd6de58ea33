"""Row selection rules, cleaning and quotas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions import photometry as P
from skysift.functions import sphere as S
from skysift.functions.numeric import col
from skysift.operators.ordered import join_keys, quantiles, ranked
from skysift.session import cut

# Habitable-zone limits (insolation, equilibrium temperature).
HZ_INSOLATION = (0.25, 1.75)
HZ_TEMPERATURE = (180, 310)
# Epochs before the first day are dropped; in the gap the second band is not used.
FIRST_GOOD_DAY = 56700
SECOND_BAND_GAP = (57000, 57071)
MAD_TO_SIGMA = 1.4826
#: Most rows of a key whose clipping is a window.
WINDOW_ROWS = 1 << 18


def habitable_zone(insolation, temperature) -> Column:
    i, t = col(insolation), col(temperature)
    return F.coalesce(i.between(*HZ_INSOLATION), F.lit(False)) | F.coalesce(i.isNull() & t.between(*HZ_TEMPERATURE), F.lit(False))


def messages(*rules: tuple[Column, Column | str]) -> Column:
    """Array of the texts whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in rules]))


def target_warnings(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row per fault of a target row."""
    required = [(F.col(c).isNull(), f"missing {c}") for c in ("target_id", "host_star", "ra", "dec")]
    expected = F.col("expected_channels")
    bad_names = F.transform(F.filter(F.map_keys(expected), lambda k: ~k.isin(*channels)), lambda k: F.concat(F.lit("unknown channel "), k))
    bad_values = F.transform(
        F.filter(F.map_values(expected), lambda v: ~v.isin("positive", "negative", "neutral")), lambda v: F.concat(F.lit("unknown expectation "), v))
    fixed = messages(*required, (~F.col("ra").between(0, 360), "ra out of range"), (~F.col("dec").between(-90, 90), "dec out of range"),
                     (F.col("distance_pc") <= 0, "distance not positive"))
    none = F.array().cast("array<string>")
    every = F.concat(fixed, F.coalesce(bad_names, none), F.coalesce(bad_values, none))
    return df.select("target_id", F.explode(every).alias("warning"))


def clean_epochs(df: DataFrame) -> DataFrame:
    """Drop early epochs; keep rows of the gap but without their second band."""
    gap = F.col("mjd").between(*SECOND_BAND_GAP)
    return df.filter(F.col("mjd") >= FIRST_GOOD_DAY).withColumns({c: F.when(~gap, F.col(c)) for c in ("w2", "w2_err")})


def _clipped(df: DataFrame, keys: Sequence[str], value: str, k: float, middle: str | None) -> DataFrame:
    """Rows of keys of bounded size within k robust deviations, and the median of what is left: one shuffle and one sort."""
    w = Window.partitionBy(*keys)
    spread = F.when(F.col("_mad") > 0, F.col("_mad") * MAD_TO_SIGMA).otherwise(F.col("_std"))
    v = F.col(value).cast("double")
    rows = df.withColumns({"_med": F.percentile(v, F.lit(0.5)).over(w), "_std": F.stddev_pop(value).over(w)}).withColumn("_off", F.abs(F.col(value) - F.col("_med")))
    kept = rows.withColumn("_mad", F.percentile("_off", F.lit(0.5)).over(w)).filter((F.col("_off") < k * spread) | (F.col("_off") == 0))
    return kept.withColumns({middle: F.percentile(v, F.lit(0.5)).over(w)} if middle else {}).drop("_med", "_std", "_off", "_mad")


def _clipped_in_order(df: DataFrame, keys: Sequence[str], value: str, k: float, middle: str | None) -> DataFrame:
    """The same for keys of any size: quantiles come from ranges of the sorted values, which many tasks share."""
    off = join_keys(df, quantiles(df, keys, value, {"_med": 0.5}), keys).withColumn("_off", F.abs(F.col(value) - F.col("_med")))
    spread = join_keys(quantiles(off, keys, "_off", {"_mad": 0.5}), df.groupBy(*keys).agg(F.stddev_pop(value).alias("_std")), keys)
    sigma = F.when(F.col("_mad") > 0, F.col("_mad") * MAD_TO_SIGMA).otherwise(F.col("_std"))
    kept = join_keys(off, spread, keys).filter((F.col("_off") < k * sigma) | (F.col("_off") == 0)).drop("_med", "_off", "_mad", "_std")
    if middle is None:
        return kept
    kept = cut(kept)
    return join_keys(kept, quantiles(kept, keys, value, {middle: 0.5}), keys)


def sigma_clip(df: DataFrame, keys: Sequence[str], value: str, k: float, middle: str | None = None) -> DataFrame:
    """Rows within k robust deviations of their key's median (standard deviation when the MAD is zero); ``middle``: a column with the median of those.

    Keys of at most WINDOW_ROWS rows are windows, larger ones go by ranges of their sorted values.
    """
    keys = list(keys)
    large = cut(df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > WINDOW_ROWS).select(*[F.col(c).alias(f"_r_{c}") for c in keys]))
    if large.isEmpty():
        return _clipped(df, keys, value, k, middle)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys])
    wide = cut(df.join(large, same, "left_semi"))
    return _clipped(df.join(large, same, "left_anti"), keys, value, k, middle).unionByName(_clipped_in_order(wide, keys, value, k, middle))


def clean_lightcurve(df: DataFrame, keys: Sequence[str], k: float = 5.0) -> DataFrame:
    """Drop nulls and outliers, then divide by the median of what is left."""
    kept = sigma_clip(cut(df.filter(F.col("flux").isNotNull())), keys, "flux", k, "_m")
    return kept.withColumn("flux_norm", F.col("flux") / F.col("_m")).drop("_m")


def stride_sample(df: DataFrame, key: str, order: Sequence[str], limit: int) -> DataFrame:
    """Every n-th point of series longer than ``limit``, n at least 2; shorter series stay whole."""
    rows = ranked(df, [key], order, rank="_rank", size="_size")
    step = F.greatest(F.lit(2), F.ceil(F.col("_size") / F.lit(limit)))
    return rows.filter((F.col("_size") <= limit) | ((F.col("_rank") - 1) % step == 0)).drop("_rank", "_size")


def search_radius(distance_pc, pmra, pmdec, epoch: float = 2010.0, base: float = 5.0) -> Column:
    """Radius (arcsec) that still holds a source after its motion since 2000."""
    pm = F.sqrt(col(pmra) * col(pmra) + col(pmdec) * col(pmdec)) / 1000.0
    guess = F.least(5.0 / col(distance_pc), F.lit(10.0))
    wide = base + F.coalesce(pm, guess) * abs(epoch - 2000.0) * 1.5
    return F.when(col(distance_pc) > 0, F.least(wide, F.lit(300.0))).otherwise(F.lit(float(base)))


def volume_limited(df: DataFrame, max_pc: float, max_g: float, min_snr: float = 10.0) -> DataFrame:
    return df.filter((F.col("parallax") > 1000.0 / max_pc) & (F.col("parallax") / F.col("parallax_error") > min_snr) & (F.col("g") < max_g))


def white_dwarf_locus(g="g", parallax="parallax", colour="bp_rp", faintest: float = 10.0, reddest: float = 1.5) -> Column:
    return (P.absolute_magnitude(g, parallax) > faintest) & (col(colour) < reddest)


def back_propagated_separation(ra, dec, pmra, pmdec, target_ra, target_dec, epoch: float = 2016.0) -> Column:
    """Flat distance (arcsec) of a candidate moved back to 2000, on the target's declination."""
    step = 2000.0 - epoch
    move = [F.coalesce(F.when(col(pmra).isNotNull() & col(pmdec).isNotNull(), col(c)), F.lit(0.0)) / 3.6e6 * step for c in (pmra, pmdec)]
    dra = (col(ra) + move[0] / F.cos(F.radians(col(dec))) - col(target_ra)) * F.cos(F.radians(col(target_dec)))
    dd = col(dec) + move[1] - col(target_dec)
    return F.sqrt(dra * dra + dd * dd) * 3600


def first_by_rank(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of the whole frame; each task sends at most n rows."""
    return df.orderBy(*order).limit(n)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in an order fixed by the key and a seed, the same on any layout of the data."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def galactic_filled(df: DataFrame) -> DataFrame:
    return df.withColumn("b_gal", F.coalesce("b_gal", S.galactic_latitude("ra", "dec")))
