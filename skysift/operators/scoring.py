"""From channel measurements to one ranked score with false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions import numeric as N
from skysift.operators import stats as A
from skysift.operators.ordered import ranked
from skysift.session import cut

PRIOR = "habitable_zone_planet"
DETECTION_CHANNELS = (
    "ir_excess", "transit_anomaly", "radio_anomaly", "gaia_photometric_anomaly", "proper_motion_anomaly",
    "ir_variability", "uv_anomaly", "radio_emission", "hr_anomaly", "abundance_anomaly",
)


def _ir_excess() -> Column:
    side = lambda b: F.when(F.col(f"excess_{b}") < 0, F.col(f"sigma_{b}"))
    top = F.greatest(side("w3"), side("w4"))
    return F.when(F.col("ir_candidate") & top.isNotNull(), N.saturate(top, 5.0)).otherwise(F.lit(0.0))


def _radio() -> Column:
    n, snr = F.col("n_radio_hits"), F.col("hit_snr")
    return F.when((n == 0) & (snr <= 0), F.lit(0.0)).otherwise(0.4 * (1.0 - F.exp(-n / 3.0)) + 0.6 * (1.0 - F.exp(-snr / 20.0)))


def _photometric() -> Column:
    v = N.saturate(F.abs("variability"), 0.05)
    n = F.when(F.col("n_epochs") > 0, F.col("n_epochs")).otherwise(F.lit(50))
    return F.when(F.col("variability").isNotNull(), v * F.least(F.lit(1.0), n / 10.0))


def _astrometric() -> Column:
    return F.coalesce(F.greatest(F.when(F.col("ruwe") > 1, N.saturate(F.col("ruwe") - 1.0, 1.0)), F.when(F.col("aen_sig") > 0, N.saturate("aen_sig", 5.0)),
                                 F.when(F.col("pm_sigma") > 0, N.saturate("pm_sigma", 4.0))), F.lit(0.0))


# One expression per channel over a wide row; a null score means the source has no data there.
EXTRACTORS = {
    "ir_excess": _ir_excess,
    "transit_anomaly": lambda: N.clip(F.col("dimming_score"), 0, 1),
    "radio_anomaly": _radio,
    "gaia_photometric_anomaly": _photometric,
    "habitable_zone_planet": lambda: F.when(F.col("n_hz") >= 2, 0.6).when(F.col("n_hz") == 1, 0.5).otherwise(0.0),
    "proper_motion_anomaly": _astrometric,
    "ir_variability": lambda: F.when(F.col("ir_var_source") == "real", N.clip(F.coalesce(F.col("ir_var_score"), F.lit(0.0)), 0, 1)),
    "uv_anomaly": lambda: F.col("uv_score"),
    "radio_emission": lambda: F.col("radio_score"),
    "hr_anomaly": lambda: F.col("hr_score"),
    "abundance_anomaly": lambda: F.col("abundance_score"),
}


def channel_scores(wide: DataFrame, key: str = "target_id", keep=(), extractors=None) -> DataFrame:
    """Long table of channel scores from one wide row per source."""
    items = [F.struct(F.lit(c).alias("channel"), make().cast("double").alias("score")) for c, make in (extractors or EXTRACTORS).items()]
    return wide.select(key, *keep, F.explode(F.array(*items)).alias("s")).select(key, *keep, "s.channel", "s.score")


def motion_weight() -> dict[str, Column]:
    """How far a proper-motion offset may be the infrared excess seen twice, and the weight left to it."""
    clean = ~((F.coalesce(F.col("ruwe"), F.lit(0.0)) > 1.4) | (F.coalesce(F.col("aen_sig"), F.lit(0.0)) > 5))
    top = F.greatest(F.coalesce("sigma_w3", F.lit(0.0)), F.coalesce("sigma_w4", F.lit(0.0)))
    both = clean & (F.col("pm_sigma") > 2) & (top > 5)
    steep = F.coalesce(F.col("sigma_w4") > 3 * F.col("sigma_w3"), F.lit(False))
    c = F.least(F.lit(1.0), 0.3 + 0.1 * top / 10 + 0.1 * F.col("pm_sigma") / 5)
    c = F.when(steep, F.least(F.lit(1.0), c + 0.2)).otherwise(c)
    corr = F.when(F.coalesce(both, F.lit(False)), c).otherwise(F.lit(0.0))
    return {"correlation": corr, "weight": F.when(corr > 0, F.greatest(F.lit(0.1), 1.0 - corr)).otherwise(F.lit(1.0))}


def convergence(scores: DataFrame, key: str = "target_id", threshold: float = 0.3, priority: bool = False) -> DataFrame:
    """Total score per source: geometric mean of active channels, bonus, prior and coverage penalty."""
    detection = F.col("channel") != PRIOR
    active = detection & (F.col("score") > threshold)
    possible = len(DETECTION_CHANNELS)
    g = scores.groupBy(key).agg(
        F.count_if(active).alias("n_active"), F.count_if(detection & F.col("score").isNotNull()).alias("n_data"), F.avg(F.when(active, F.log("score"))).alias("_log"),
        F.max(F.when(~detection & (F.col("score") > threshold), F.col("score"))).alias("_prior"))
    k = F.col("n_active")
    base = 4.0 if priority else 2.0
    bonus = F.when(k == 0, F.lit(0.0)).when((k == 1) & F.lit(priority), F.lit(0.25)).otherwise(F.pow(F.lit(base), (k - 1).cast("double")))
    geo = F.coalesce(F.exp("_log"), F.lit(0.0))
    penalty = F.least(F.lit(1.0), F.sqrt(F.col("n_data") / possible))
    total = geo * bonus * (1.0 + F.coalesce("_prior", F.lit(0.0))) * penalty
    return g.select(key, "n_active", "n_data", geo.alias("geo_mean"), bonus.alias("bonus"), penalty.alias("coverage_penalty"), total.alias("total_score"))


def combined_p(scores: DataFrame, controls: DataFrame, key: str = "target_id", threshold: float = 0.3) -> DataFrame:
    """Calibrated p-values and their two combinations per source."""
    p = A.empirical_p(scores.filter(F.col("channel") != PRIOR), controls, ["channel"])
    known = controls.select("channel").distinct().withColumn("_known", F.lit(True))
    p = p.join(known, "channel", "left").withColumn("p", F.when(F.col("_known"), F.col("p")))
    p = p.withColumn("_active_p", F.when(F.col("score") > threshold, F.col("p"))).withColumn("_all_p", F.when(F.col("_known"), F.coalesce("p", F.lit(1.0))))
    fx, fk = A.fisher("_active_p")
    total, squares, ones = A.stouffer("_all_p")
    g = p.groupBy(key).agg(fx.alias("_x"), fk.alias("_k"), total.alias("_t"), F.count("_all_p").alias("_m"), ones.alias("_o"), F.min("p").alias("_least"), F.count_if(F.col("score") > threshold).alias("_a"))
    stouffer = F.when(F.col("_m") > 0, A.stouffer_p(F.col("_t"), F.col("_m").cast("double"), F.col("_o")))
    return g.select(key, F.when(F.col("_k") > 0, A.fisher_p(F.col("_x"), F.col("_k"))).alias("fisher_p"), stouffer.alias("stouffer_p"),
                    F.coalesce((F.col("_least") < 0.001) & (F.col("_a") <= 1), F.lit(False)).alias("single_channel_extreme"))


def survey(scores: DataFrame, controls: DataFrame, key: str = "target_id", threshold: float = 0.3, priority: bool = False,
           population: str | None = None) -> DataFrame:
    """Scored, ranked and corrected targets."""
    out = convergence(scores, key, threshold, priority).join(combined_p(scores, controls, key, threshold), key)
    groups = []
    if population:
        tags = scores.select(key, population).distinct()
        out, groups = out.join(tags, key), [population]
    out = ranked(out, [], [F.desc("total_score"), F.desc("n_active"), F.desc("geo_mean"), F.col(key)], "rank", "n_tested")
    # Written once: both corrections below read it several times.
    out = cut(out.withColumn("_ps", F.coalesce("stouffer_p", F.lit(1.0))).withColumn("_pf", F.coalesce("fisher_p", F.lit(1.0))))
    q1, q2 = A.q_values(out, "_ps", groups), A.q_values(out, "_pf", groups, q="q_fisher")
    out = out.join(q1, [*groups, "_ps"]).join(q2, [*groups, "_pf"])
    out = out.withColumn("is_significant", F.col("q_value") <= 0.05).withColumn("is_significant_fisher", F.col("q_fisher") <= 0.05)
    base = F.coalesce("stouffer_p", "fisher_p")
    return out.withColumn("global_p", F.when(F.col("n_tested") > 1, N.sidak(base, F.col("n_tested")))).drop("_ps", "_pf")
