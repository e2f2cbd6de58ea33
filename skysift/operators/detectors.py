"""Per-source detectors as column pipelines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions import numeric as N
from skysift.functions import photometry as P
from skysift.functions import sphere as S
from skysift.operators.ordered import neighbours, quantiles, running, with_position
from skysift.operators import timeseries as T
from skysift.session import cut

# Effective wavelengths (micron).
MICRON = {"G": 0.622, "BP": 0.511, "RP": 0.777, "J": 1.235, "H": 1.662, "Ks": 2.159, "W3": 11.561, "W4": 22.088}
FIT_BANDS = ("G", "BP", "RP", "J", "H", "Ks")
NEAR_INFRARED = ("J", "H", "Ks")
MODEL_FLOOR, MODEL_MAG_ERROR, BEST_FIT_LIMIT = 0.02, 0.054, 25.0
TEFF_RANGE = (2000.0, 60000.0)


def _grid(low: float, high: float, count: int) -> list[float]:
    step = (math.log(high) - math.log(low)) / (count - 1)
    return [math.exp(math.log(low) + step * i) for i in range(count)]


COARSE = _grid(*TEFF_RANGE, 80)
FINE = [math.exp((i - 10) / 10 * math.log(COARSE[1] / COARSE[0])) for i in range(21)]


def _planck(micron: float, teff: float) -> float:
    w = micron * 1e-6
    x = min(P.PLANCK * P.LIGHT / P.BOLTZMANN / (w * teff), 500.0)
    return 2 * P.PLANCK * P.LIGHT / w ** 3 / (math.exp(x) - 1.0) * 1e12


def _best_temperature(rows: DataFrame, key: str, radiance: dict[str, Column]) -> DataFrame:
    """Least chi-square over the candidate temperatures of each source (columns teff and _f_, _e_ per band).

    The scale of the model is linear, so at each temperature it has a closed form. A missing
    band has a null error and adds nothing to any sum.
    """
    rows = rows.withColumns({f"_b_{b}": c for b, c in radiance.items()})
    zero = F.lit(0.0)

    def total(term):
        return sum((F.coalesce(term(F.col(f"_f_{b}") / F.col(f"_e_{b}"), F.col(f"_b_{b}") / F.col(f"_e_{b}")), zero) for b in FIT_BANDS), zero)

    rows = rows.withColumns({"_mm": total(lambda f, m: m * m), "_fm": total(lambda f, m: f * m), "_ff": total(lambda f, m: f * f)})
    rows = rows.withColumn("_chi2", F.col("_ff") - F.col("_fm") * F.col("_fm") / F.col("_mm"))
    return rows.groupBy(key).agg(F.min_by("teff", "_chi2").alias("teff_fit"), F.min("_chi2").alias("_chi2"), F.min_by(F.col("_fm") / F.col("_mm"), F.col("_chi2")).alias("_scale"))


def infrared_excess(df: DataFrame, key: str = "target_id", sigma: float = 3.0) -> DataFrame:
    """Blackbody fit of the short bands and the excess it leaves in the two longest.

    Each source meets a coarse temperature grid with tabulated radiances, then a finer one
    around the best value; the least chi-square is found before any shuffle.
    """
    flux, err = {}, {}
    for b in FIT_BANDS:
        e = F.lit(P.DEFAULT_MAG_ERROR[b])
        if f"{b}_err" in df.columns:
            e = F.when(F.col(f"{b}_err") > 0, F.col(f"{b}_err")).otherwise(e)
        flux[f"_f_{b}"] = F.lit(P.ZERO_POINT_JY[b]) * F.pow(F.lit(10.0), -0.4 * F.col(b))
        err[f"_e_{b}"] = F.col(f"_f_{b}") * F.sqrt(e * e * (0.4 * P.LN10) ** 2 + MODEL_FLOOR ** 2)
    n = sum((F.col(b).isNotNull().cast("int") for b in FIT_BANDS), F.lit(0))
    base = df.withColumn("n_bands", n).filter("n_bands >= 2").withColumns(flux).withColumns(err)
    slim = base.select(key, *flux, *err)
    coarse = F.array(*[F.struct(F.lit(t).alias("teff"), *[F.lit(_planck(MICRON[b], t)).alias(b) for b in FIT_BANDS]) for t in COARSE])
    first = slim.withColumn("_g", F.explode(coarse)).withColumn("teff", F.col("_g.teff"))
    first = _best_temperature(first, key, {b: F.col(f"_g.{b}") for b in FIT_BANDS}).select(key, F.col("teff_fit").alias("_t0"))
    near = slim.join(first, key).withColumn("_r", F.explode(F.array(*[F.lit(r) for r in FINE])))
    near = near.withColumn("teff", F.least(F.lit(TEFF_RANGE[1]), F.greatest(F.lit(TEFF_RANGE[0]), F.col("_t0") * F.col("_r"))))
    best = _best_temperature(near, key, {b: P.planck(F.lit(MICRON[b] * 1e-6), "teff") * 1e12 for b in FIT_BANDS})
    out = base.join(best, key).withColumn("chi2_red", F.col("_chi2") / F.greatest(F.col("n_bands") - 2, F.lit(1)))
    for b in ("W3", "W4"):
        model = F.col("_scale") * P.planck(F.lit(MICRON[b] * 1e-6), "teff_fit") * 1e12
        err = F.when(F.col(f"{b}_err") > 0, F.col(f"{b}_err")).otherwise(F.lit(P.DEFAULT_MAG_ERROR[b]))
        out = out.withColumn(f"excess_{b}", F.col(b) + 2.5 * F.log10(model / P.ZERO_POINT_JY[b]))
        out = out.withColumn(f"sigma_{b}", F.abs(f"excess_{b}") / F.sqrt(err * err + MODEL_MAG_ERROR ** 2))
    strong = F.coalesce((F.col("excess_W3") < 0) & (F.col("sigma_W3") >= sigma), F.lit(False)) | F.coalesce((F.col("excess_W4") < 0) & (F.col("sigma_W4") >= sigma), F.lit(False))
    anchored = F.coalesce(*[F.col(b) for b in NEAR_INFRARED]).isNotNull()
    flagged = F.coalesce(F.substring("cc_flags", 3, 2).rlike("[^0]"), F.lit(False)) | F.coalesce(F.col("ext_flg") > 0, F.lit(False))
    shift = centroid_shift()
    out = out.withColumn("is_candidate", strong & (F.col("chi2_red") <= BEST_FIT_LIMIT) & anchored & ~flagged & ~F.coalesce(shift >= 3.0, F.lit(False)))
    return out.select(key, "n_bands", "teff_fit", "chi2_red", "excess_W3", "excess_W4", "sigma_W3", "sigma_W4", "is_candidate")


def centroid_shift() -> Column:
    """Offset (arcsec) between the short-wave and the long-wave position."""
    def first(*bands):
        return F.coalesce(*[F.when(F.col(f"{b}_ra").isNotNull() & F.col(f"{b}_dec").isNotNull(), F.struct(F.col(f"{b}_ra").alias("ra"), F.col(f"{b}_dec").alias("dec"))) for b in bands])

    short, long = first("w1", "w2"), first("w3", "w4")
    return S.separation_flat(short["ra"], short["dec"], long["ra"], long["dec"]) * 3600


def infrared_variability(epochs: DataFrame, key: str = "target_id") -> DataFrame:
    """Excess scatter, trends on points and on passes, monotonicity, colour change and one score."""
    span = epochs.groupBy(key).agg(F.count("*").alias("n"), F.min("mjd").alias("_a"), F.max("mjd").alias("_b")).filter("n >= 15").filter((F.col("_b") - F.col("_a")) / T.DAYS_PER_YEAR >= 3)
    good = cut(epochs.join(span.select(key), key, "left_semi"))  # read many times below
    ok2 = good.filter("w2 IS NOT NULL AND w2_err IS NOT NULL")
    out = span.select(key, "n")
    for b, rows in (("w1", good), ("w2", ok2)):
        scatter = rows.groupBy(key).agg(F.stddev_pop(b).alias("_sd"), F.count(b).alias("_k"))
        err = quantiles(rows, [key], f"{b}_err", {"_e": 0.5})
        part = scatter.join(err, key).select(key, F.when(F.col("_k") >= 15, F.col("_sd") / F.greatest("_e", F.lit(1e-6)) - 1).alias(f"{b}_excess"))
        out = out.join(part, key, "left").join(T.weighted_trend(rows, key, "mjd", b, f"{b}_err", b), key, "left").join(T.monotonicity(rows, key, "mjd", b, f"{b}_mono"), key, "left")
    passes = T.pass_means(good, key)
    enough = passes.join(passes.groupBy(key).agg(F.count("*").alias("_p"), F.count("w2").alias("_p2")), key).filter("_p >= 6")
    out = out.join(T.weighted_trend(enough, key, "mjd", "w1", "w1_err", "p1"), key, "left").join(T.weighted_trend(enough.filter("_p2 >= 6"), key, "mjd", "w2", "w2_err", "p2"), key, "left")
    colour = good.filter("w1_err IS NOT NULL AND w2 IS NOT NULL AND w2_err IS NOT NULL").withColumn("_c", F.col("w1") - F.col("w2"))
    out = out.join(T.halves_shift(colour, key, ["mjd", "epoch_id"], "_c", "colour_shift"), key, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = out.withColumn("_s1", F.greatest(F.abs(z("w1_sigma")), F.abs(z("p1_sigma")))).withColumn("_s2", F.greatest(F.abs(z("w2_sigma")), F.abs(z("p2_sigma"))))
    consistent = (F.abs(z("w1_sigma")) > 2) & (F.abs(z("w2_sigma")) > 2) & (F.signum(z("w1_slope")) == F.signum(z("w2_slope")))
    out = out.withColumn("consistent", consistent).withColumn("sigma", F.greatest("_s1", "_s2")).withColumn("mono", F.greatest(z("w1_mono"), z("w2_mono")))
    bright = ((z("w1_slope") < 0) & (F.col("_s1") > 3)) | ((z("w2_slope") < 0) & (F.col("_s2") > 3) & F.col("consistent"))
    out = out.withColumn("is_brightening", bright).withColumn("colour_changed", F.coalesce((F.abs("colour_shift") > 0.02) & (F.col("colour_shift_n") >= 15), F.lit(False)))
    bonus = lambda c, f: F.when(c, F.lit(f)).otherwise(F.lit(1.0))
    secular = F.when(F.col("sigma") > 3, F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("sigma") / 10) * bonus(F.col("mono") > 0.8, 1.5) * bonus(F.col("consistent"), 1.3) * bonus(F.col("is_brightening"), 1.2) * bonus(F.col("colour_changed"), 1.2))).otherwise(F.lit(0.0))
    excess = F.greatest(z("w1_excess"), z("w2_excess"))
    mixed = 0.4 * N.clip(excess / 10, 0, 1) + 0.6 * N.clip(F.col("sigma") / 10, 0, 1)
    out = out.withColumn("excess", excess).withColumn("score", F.greatest(mixed, secular))
    active = (F.col("excess") > 3) | (F.col("sigma") > 5)
    return out.withColumn("is_anomalous", (F.col("score") > 0.3) & active)


def uv_score() -> dict[str, Column]:
    """Ultraviolet colour and residual against the expected near-ultraviolet magnitude."""
    colour, resid = F.col("fuv") - F.col("nuv"), F.col("nuv") - (F.col("g") + 1.5 + 2.0 * F.col("bp_rp"))
    ramp = lambda x, w: F.least(F.lit(1.0), x / w)
    c = F.when(colour < 0.5, ramp(0.5 - colour, 2.0)).when(colour > 4, ramp(colour - 4, 3.0))
    r = F.when(resid > 2, ramp(resid - 2, 3.0)).when(resid < -2, ramp(-resid - 2, 3.0))
    score = F.when(F.col("nuv").isNull(), F.lit(None).cast("double")).when(~F.col("uv_clean"), F.lit(0.0)).otherwise(F.coalesce(F.greatest(c, r), F.lit(0.0)))
    return {"uv_score": score, "uv_active": F.coalesce(colour < 1, F.lit(False)) & F.col("nuv").isNotNull(), "uv_deficit": F.coalesce(resid > 2, F.lit(False))}


def radio_score(peak: str, snr: str, sep: str, min_flux=1.0, max_sep=10.0) -> Column:
    seen = (F.col(peak) >= min_flux) & (F.col(sep) <= max_sep)
    s = 0.6 * (1.0 - F.exp(-F.col(peak) / 5.0)) + 0.3 * F.least(F.lit(1.0), F.col(snr) / 10.0) + 0.1 * (1.0 - F.col(sep) / max_sep)
    return F.when(F.col(peak).isNull(), F.lit(None).cast("double")).when(seen, N.clip(s, 0, 1)).otherwise(F.lit(0.0))


def ridge_outlier(df: DataFrame) -> DataFrame:
    """Distance from the main-sequence ridge in scatters, and its score outside known branches."""
    out = df.withColumn("abs_g", P.absolute_magnitude("g", "parallax")).withColumn("ms_sigma", (F.col("abs_g") - P.ridge_magnitude("bp_rp")) / P.RIDGE_SCATTER)
    dwarf, giant = (F.col("abs_g") > 10) & (F.col("bp_rp") < 1.5), (F.col("abs_g") < 3) & (F.col("bp_rp") > 0.8)
    s = F.abs("ms_sigma")
    base = F.when(dwarf | giant | (s < 1.5), F.lit(0.0)).otherwise(1.0 - F.exp(-(s - 1.5) / 2.0))
    poor = (F.col("ms_sigma") > 1.5) & (F.coalesce(F.col("mh"), F.lit(0.0)) < -0.5)
    return out.withColumn("hr_score", F.when(F.col("ms_sigma").isNotNull(), N.clip(F.when(poor, base * 0.5).otherwise(base), 0, 1)))


def polynomial_outlier(df: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Deviation from the main-sequence polynomial and the kind of outlier."""
    ok = df.filter((F.col("parallax") > 0) & F.col("bp_rp").between(-0.5, 5.0))
    out = ok.withColumn("abs_g", P.absolute_magnitude("g", "parallax"))
    out = out.withColumn("deviation", F.col("abs_g") - P.sequence_magnitude("bp_rp")).withColumn("deviation_sigma", F.abs("deviation") / P.sequence_scatter("bp_rp"))
    odd = (F.col("deviation_sigma") > sigma) & ~P.on_giant_branch("bp_rp", "abs_g")
    kind = F.when(~odd, "normal").when((F.col("ruwe") > 1.4) & (F.col("deviation_sigma") > 5), "wrong_color").when(F.col("deviation") < 0, "too_bright").otherwise("too_dim")
    return out.withColumn("is_anomalous", odd).withColumn("kind", kind)


def motion_consistency(df: DataFrame) -> DataFrame:
    """Two proper-motion measurements compared per axis, with systematic floors."""
    total = F.sqrt(F.col("pmra") * F.col("pmra") + F.col("pmdec") * F.col("pmdec"))
    faint = F.when(F.col("g") > 15, 3.0 * F.pow(F.lit(10.0), 0.3 * (F.col("g") - 15.0))).otherwise(F.lit(3.0))
    floor = F.greatest(F.lit(3.0), faint, 0.05 * total)
    out = df.withColumn("_total", total).withColumn("floor", floor)

    def axis(a):
        e1, e2 = F.greatest(F.col(f"{a}_error"), F.lit(0.02)), F.greatest(F.col(f"w{a}_error"), F.col("floor"))
        d = F.col(a) - F.col(f"w{a}")
        return d, d * d / (e1 * e1 + e2 * e2)

    (da, ca), (dd, cd) = axis("pmra"), axis("pmdec")
    out = out.withColumn("_chi2", ca + cd).withColumn("_delta", F.sqrt(da * da + dd * dd))
    out = out.withColumn("is_systematic", (F.col("_total") > 50) & (F.col("_delta") > 0.3 * F.col("_total")))
    chi2 = F.when(F.col("is_systematic"), F.lit(0.0)).otherwise(F.col("_chi2"))
    out = out.withColumn("chi2", chi2).withColumn("pm_p", F.exp(-F.col("chi2") / 2))
    far = F.sqrt(F.col("chi2") + 2.0 * math.log(2.0))
    s = F.when(F.col("pm_p") >= 1, F.lit(0.0)).when(F.col("pm_p") > N.P_FLOOR, F.greatest(F.lit(0.0), N.normal_tail_inverse(F.col("pm_p") / 2))).otherwise(far)
    return out.withColumn("pm_sigma", F.least(s, F.lit(50.0))).withColumn("is_discrepant", F.col("chi2") > 13.82).drop("_total", "_chi2", "_delta")


# Abundance ratio, natural range, flag above, flag below, weight.
ABUNDANCES = (
    ("eu_fe", -0.2, 0.4, 0.8, None, 1.0), ("ni_fe", -0.2, 0.2, 0.4, None, 0.6), ("p_fe", -0.1, 0.4, 1.0, None, 0.8),
    ("co_ni", -0.1, 0.1, 0.3, -0.3, 0.5), ("li_a", 0.5, 2.5, 3.5, None, 0.7), ("ce_fe", -0.2, 0.3, 0.6, None, 0.8),
)


def abundance_outliers(long: DataFrame, key: str = "target_id") -> DataFrame:
    """Flagged ratios per source, from (key, ratio, value) rows and the small table of limits."""
    limits = long.sparkSession.createDataFrame(ABUNDANCES, "ratio string, low double, high double, above double, below double, weight double")
    rows = long.join(F.broadcast(limits), "ratio")  # fixed size
    width = F.greatest(F.col("high") - F.col("low"), F.lit(0.01))
    off = F.when(F.col("value") > F.col("above"), F.col("value") - F.col("above")).when(F.col("value") < F.col("below"), F.col("below") - F.col("value"))
    rows = rows.withColumn("off", off / width * F.col("weight"))
    g = rows.groupBy(key).agg(F.count("*").alias("n_checked"), F.count("off").alias("n_flagged"), F.coalesce(F.max("off"), F.lit(0.0)).alias("worst"),
                              F.max_by(F.when(F.col("off").isNotNull(), F.col("ratio")), F.coalesce("off", F.lit(-1.0))).alias("worst_ratio"))
    k, base = F.col("n_flagged"), F.least(F.lit(1.0), 0.3 + 0.1 * F.col("worst"))
    score = F.when(k == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), base * (1.0 + 0.2 * (k - 1))))
    p = F.when(k == 0, F.lit(1.0)).when(k == 1, F.lit(0.05)).when(k == 2, F.lit(0.0025)).otherwise(F.pow(F.lit(0.001), F.least(k - 2, F.lit(3)).cast("double")))
    return g.withColumn("score", score).withColumn("p", p)


def vanished_class(df: DataFrame, high: float = 0.4, trend_limit: float = 5.0, scatter_limit: float = 3.0) -> DataFrame:
    """Class and priority of sources that vanished in the optical, from their infrared and radio remains."""
    seen, radio, wise = F.col("ir_seen"), F.col("radio_seen"), F.col("wise_seen")
    strongest = F.greatest(F.abs("w1_sigma"), F.abs("w2_sigma"))
    bright = seen & ((F.col("w1_sigma") < -trend_limit) | (F.col("w2_sigma") < -trend_limit))
    add = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(F.lit(0.0))
    score = (add(seen, F.lit(0.3)) + F.when(bright, F.least(F.lit(0.3), 0.1 * strongest / trend_limit)).otherwise(add(seen & (F.abs("w1_sigma") < 1), F.lit(0.05)))
             + add(seen & (F.col("scatter") > scatter_limit), F.lit(0.1)) + add(wise, F.lit(0.1)) + add(wise & (F.col("w1_w3") > 2), F.lit(0.05))
             + add(radio, F.lit(0.05)) + add(radio & seen, F.lit(0.05)))
    out = df.withColumn("score", F.least(F.lit(1.0), score)).withColumn("is_brightening", bright)
    b, s = F.col("is_brightening"), F.col("score")
    ladder = [(seen & b & ~radio, "BRIGHTENING_IR", "CRITICAL"), (seen & b & radio, "BRIGHTENING_IR", "HIGH"), (seen & ~radio & (s > high), "DYSON_CANDIDATE", "HIGH"),
              (seen & radio, "AGN_LIKELY", "MODERATE"), (seen, "PERSISTENT_IR", "MODERATE"), ((F.col("ir_source") == "none") & radio, "RADIO_ONLY", "LOW"),
              (F.col("ir_source") == "none", "NO_DETECTION", "LOW")]
    fading = seen & (F.greatest("w1_sigma", "w2_sigma") > trend_limit)
    verdict = F.when(fading, F.struct(F.lit("FADING_SOURCE").alias("c"), F.lit("LOW").alias("p")))
    for cond, c, p in ladder:
        verdict = verdict.when(cond, F.struct(F.lit(c).alias("c"), F.lit(p).alias("p")))
    verdict = verdict.otherwise(F.struct(F.lit("INSUFFICIENT_DATA").alias("c"), F.lit("LOW").alias("p")))
    return out.withColumn("_v", verdict).withColumn("source_class", F.col("_v.c")).withColumn("priority", F.col("_v.p")).drop("_v")


def far_infrared_class() -> dict[str, Column]:
    w, c = F.col("w4_mjy") / F.col("pacs_70"), F.col("spire_250") / F.col("pacs_70")
    late = (F.col("pacs_70") > 0) & c.isNotNull()
    kind = (F.when(F.col("pacs_70").isNull() & F.col("pacs_100").isNull(), "unclassified").when(late & (c > 3), "galaxy_like").when(late & (c > 1), "cold_dust")
            .when(w > 2, "dyson_consistent").when((w > 0.5) & (w <= 2), "dust_disk").otherwise("unclassified"))
    conf = F.when(kind == "galaxy_like", 0.6).when(kind == "cold_dust", 0.4).when(kind == "dyson_consistent", F.least(F.lit(0.5), w / 10)).when(kind == "dust_disk", 0.3).otherwise(0.0)
    return {"sed_class": kind, "confidence": conf}


# Known interference bands (MHz) for the derived spectrogram.
KNOWN_BANDS = ((1400.00000, 1400.0000045), (1400.000120, 1400.000126))


def interference_mask(cells: DataFrame, bands=KNOWN_BANDS, sigma: float = 3.0) -> DataFrame:
    """Flags for each (frequency, time) cell: known band, broadband burst, persistent channel."""
    cells = cut(cells)  # read many times below

    def profile(rows, key, name):
        mid = cut(quantiles(rows, [key], "power", {"_m": 0.5}))  # one row per channel or time step
        noise = T.robust_sigma(mid, [], "_m").select(F.col("med").alias("_g"), "sigma")
        loud = mid.crossJoin(F.broadcast(noise))  # one row
        return loud.select(key, (F.col("_m") > F.col("_g") + sigma * F.col("sigma")).alias(name))

    known = F.lit(False)
    for lo, hi in bands:
        known = known | F.col("freq_mhz").between(lo, hi)
    rows = cells.withColumn("known", known).join(profile(cells, "t_idx", "broadband"), "t_idx")
    clean = rows.filter(~F.col("known") & ~F.col("broadband"))
    out = rows.join(profile(clean, "f_idx", "persistent"), "f_idx", "left").withColumn("persistent", F.coalesce("persistent", F.lit(False)))
    return out.withColumn("masked", F.col("known") | F.col("broadband") | F.col("persistent"))


def profile_scores() -> dict[str, Column]:
    """Infrared, dimming, radio and astrometry scores of a wide profile row."""
    top = F.greatest(F.coalesce("sigma_w3", F.lit(0.0)), F.coalesce("sigma_w4", F.lit(0.0)))
    zero = F.lit(0.0)
    ruwe = F.when(F.col("ruwe") > 1.4, N.clip((F.col("ruwe") - 1.4) / 1.6 * 0.5 + 0.5, 0, 1)).otherwise(zero)
    frac = F.try_divide(F.col("parallax_error"), F.col("parallax"))
    poor = F.when((F.col("parallax") > 0) & (frac > 0.2), N.clip(frac, 0, 0.5)).otherwise(zero)
    noise = F.when(F.col("aen") > 1, N.clip(F.col("aen") / 5, 0, 1)).otherwise(zero)
    return {"ir": N.clip(top / 6.0, 0, 1), "dimming": N.clip(F.col("dimming_score"), 0, 1), "radio": F.when(F.col("n_radio_hits") > 0, N.clip(F.col("hit_snr") / 30.0, 0, 1)).otherwise(F.lit(0.05)),
            "astrometry": F.greatest(ruwe, poor, noise)}


def validation_status(detection: Column, natural: Column, instrumental: Column, limit: float = 0.5) -> Column:
    return (F.when((detection > limit) & (natural < 0.5) & (instrumental < 0.3), "UNEXPLAINED").when(natural >= 0.5, "CONFIRMED_NATURAL")
            .when(instrumental >= 0.5, "CONFIRMED_ARTIFACT").otherwise("INCONCLUSIVE"))
