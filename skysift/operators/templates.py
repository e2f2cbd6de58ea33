"""Known scenarios matched against the channel pattern of a source, inside one row each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.operators.scoring import PRIOR


@dataclass(frozen=True)
class Scenario:
    """Channels a scenario predicts (with strength), forbids, and sees together (with weight)."""

    name: str
    predicted: dict[str, float]
    forbidden: tuple[str, ...] = ()
    together: tuple[tuple[str, str, float], ...] = ()
    single_only: bool = False
    notes: str = field(default="", compare=False)


# The scenarios and their strengths and weights.
SCENARIOS = (
    Scenario("binary_system", {"proper_motion_anomaly": 0.9, "ir_excess": 0.3, "transit_anomaly": 0.4, "gaia_photometric_anomaly": 0.5}, ("radio_anomaly",),
             (("proper_motion_anomaly", "ir_excess", 1.5), ("proper_motion_anomaly", "transit_anomaly", 1.3))),
    Scenario("debris_disk", {"ir_excess": 0.9, "transit_anomaly": 0.4, "gaia_photometric_anomaly": 0.3}, ("proper_motion_anomaly", "radio_anomaly"),
             (("ir_excess", "transit_anomaly", 1.5),)),
    Scenario("young_stellar_object", {"ir_excess": 0.9, "ir_variability": 0.7, "gaia_photometric_anomaly": 0.8, "proper_motion_anomaly": 0.5, "transit_anomaly": 0.5, "uv_anomaly": 0.6, "hr_anomaly": 0.5},
             ("radio_anomaly",), (("ir_excess", "gaia_photometric_anomaly", 1.8), ("ir_excess", "proper_motion_anomaly", 1.3), ("ir_excess", "transit_anomaly", 1.3), ("ir_excess", "uv_anomaly", 1.5))),
    Scenario("background_contamination", {"ir_excess": 0.9, "proper_motion_anomaly": 0.4}, ("transit_anomaly", "radio_anomaly", "gaia_photometric_anomaly"),
             (("ir_excess", "proper_motion_anomaly", 1.5),)),
    Scenario("active_flare_star", {"gaia_photometric_anomaly": 0.9, "radio_anomaly": 0.4, "radio_emission": 0.5, "transit_anomaly": 0.3, "uv_anomaly": 0.6}, ("ir_excess", "proper_motion_anomaly"),
             (("gaia_photometric_anomaly", "radio_anomaly", 1.5), ("gaia_photometric_anomaly", "transit_anomaly", 1.3), ("gaia_photometric_anomaly", "uv_anomaly", 1.4))),
    Scenario("instrumental_systematic", {"ir_excess": 0.5, "transit_anomaly": 0.5, "radio_anomaly": 0.5, "gaia_photometric_anomaly": 0.5, "proper_motion_anomaly": 0.5}, single_only=True),
    Scenario("rs_cvn_active_binary", {"ir_excess": 0.6, "proper_motion_anomaly": 0.7, "radio_emission": 0.8, "gaia_photometric_anomaly": 0.7, "uv_anomaly": 0.5}, ("radio_anomaly",),
             (("radio_emission", "gaia_photometric_anomaly", 1.6), ("radio_emission", "uv_anomaly", 1.5), ("proper_motion_anomaly", "ir_excess", 1.4), ("radio_emission", "proper_motion_anomaly", 1.3))),
    Scenario("spectroscopic_binary", {"ir_excess": 0.6, "proper_motion_anomaly": 0.5, "hr_anomaly": 0.5, "transit_anomaly": 0.3, "gaia_photometric_anomaly": 0.4}, ("radio_anomaly",),
             (("ir_excess", "hr_anomaly", 1.5), ("proper_motion_anomaly", "hr_anomaly", 1.4))),
    Scenario("face_on_binary", {"ir_excess": 0.7, "gaia_photometric_anomaly": 0.3, "hr_anomaly": 0.4}, ("proper_motion_anomaly", "transit_anomaly"), (("ir_excess", "gaia_photometric_anomaly", 1.3),)),
)
N_DETECTION = 10


def source_patterns(scores: DataFrame, key: str = "target_id", threshold: float = 0.3) -> DataFrame:
    """One row per source with a score column per detection channel and the array of active ones."""
    channels = sorted({c for s in SCENARIOS for c in s.predicted} | {"abundance_anomaly"})
    # Maxima in one hash aggregate: a pivot groups by source and channel first and sorts its rows.
    wide = scores.filter(F.col("channel") != PRIOR).groupBy(key).agg(*[F.max(F.when(F.col("channel") == c, F.col("score"))).alias(c) for c in channels])
    active = F.array_compact(F.array(*[F.when(F.col(c) > threshold, F.lit(c)) for c in channels]))
    return wide.withColumn("active", active).withColumn("n_active", F.size("active"))


def _parts(s: Scenario) -> dict[str, Column]:
    """Raw fit, penalty for what is missing, and explained channels of one scenario."""
    on = lambda c: F.col(f"_on_{c}")
    one, zero = F.lit(1.0), F.lit(0.0)
    fit_sum, named, n_named, missing, anti, bonus = zero, zero, F.lit(0), one, one, one
    explained = []
    for c, strength in s.predicted.items():
        over = F.greatest(zero, 1.0 - 0.3 * (F.col(c) / (strength + 0.01) - 1.0))
        fit = F.when(F.col(c) <= strength, one).otherwise(over)
        fit_sum = fit_sum + F.when(on(c), fit * strength).otherwise(zero)
        named = named + F.when(on(c), F.lit(strength)).otherwise(zero)
        n_named = n_named + on(c).cast("int")
        explained.append(F.when(on(c) & (fit > 0.3), F.lit(c)))
        if strength >= 0.5:
            missing = missing * F.when(on(c), one).otherwise(F.lit(1.0 - 0.4 * strength))
    for c in s.forbidden:
        anti = anti * F.when(on(c), F.greatest(F.lit(0.1), 1.0 - F.col(c))).otherwise(one)
    for a, b, w in s.together:
        bonus = bonus * F.when(on(a) & on(b), F.lit(w)).otherwise(one)
    weight = named + 0.1 * (F.col("n_active") - n_named)
    raw = fit_sum / weight / F.col("n_active") * anti * F.least(bonus, F.lit(3.0))
    none = F.col("n_active") > 1 if s.single_only else F.lit(False)
    listed = F.when(none, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*explained)))
    return {"raw": F.when(none, zero).otherwise(raw), "missing": F.greatest(F.lit(0.2), missing), "explained": listed}


def _conflicts(s: Scenario, threshold: float) -> tuple[Column, Column]:
    """Numbers of strong and moderate contradictions between a scenario and the scores."""
    score = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    strong: dict[str, Column] = {}
    moderate: dict[str, Column] = {}
    if s.name in ("binary_system", "spectroscopic_binary") and s.predicted.get("proper_motion_anomaly", 0) >= 0.5:
        strong["proper_motion_anomaly"] = score("proper_motion_anomaly") < threshold
    if s.name == "face_on_binary" and "proper_motion_anomaly" in s.forbidden:
        strong["proper_motion_anomaly"] = score("proper_motion_anomaly") >= threshold
    if s.name == "young_stellar_object":
        strong["gaia_photometric_anomaly"] = score("gaia_photometric_anomaly") < threshold
        moderate["ir_variability"] = score("ir_variability") < threshold
    for c, strength in s.predicted.items():
        if strength >= 0.5:
            near_zero = F.coalesce(F.col(c) < 0.1, F.lit(False)) & ~F.col(f"_on_{c}")
            flagged = strong.get(c, F.lit(False)) | moderate.get(c, F.lit(False))
            moderate[c] = moderate.get(c, F.lit(False)) | (near_zero & ~flagged)
    count = lambda d: sum((v.cast("int") for v in d.values()), F.lit(0))
    return count(strong), count(moderate)


def match_scenarios(patterns: DataFrame, scenarios=SCENARIOS, threshold: float = 0.3) -> DataFrame:
    """All scenarios of sources with at least two active channels, best fit first. Nothing is shuffled."""
    used = sorted({c for s in scenarios for c in (*s.predicted, *s.forbidden)})
    rows = patterns.filter("n_active >= 2").withColumns({f"_on_{c}": F.coalesce(F.col(c) > threshold, F.lit(False)) for c in used})
    parts, items = {}, []
    for i, s in enumerate(scenarios):
        strong, moderate = _conflicts(s, threshold)
        parts |= {f"_{n}_{i}": c for n, c in {**_parts(s), "strong": strong, "moderate": moderate}.items()}
    rows = rows.withColumns(parts)
    rows = rows.withColumns({f"_fit_{i}": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(f"_raw_{i}") * F.size(f"_explained_{i}"))) * F.col(f"_missing_{i}") for i in range(len(scenarios))})
    for i, s in enumerate(scenarios):
        items.append(F.struct((-F.col(f"_fit_{i}")).alias("order"), F.lit(i).alias("nth"), F.lit(s.name).alias("name"), F.col(f"_fit_{i}").alias("fit"),
                              *[F.col(f"_{n}_{i}").alias(n) for n in ("explained", "strong", "moderate")]))
    return rows.select(*patterns.columns, F.array_sort(F.array(*items)).alias("fits"))


def unexplained(patterns: DataFrame, scenarios=SCENARIOS, threshold: float = 0.3, key: str = "target_id") -> DataFrame:
    """How much of each source's pattern the scenarios leave unexplained."""
    m = match_scenarios(patterns, scenarios, threshold).withColumn("best", F.col("fits")[0])
    good = F.filter("fits", lambda f: f["fit"] > 0.3)
    m = m.withColumn("residual", F.array_except("active", F.flatten(F.transform(good, lambda f: f["explained"]))))
    # Of the best and its three runners-up within 70 % of its fit, the first with fewest conflicts counts.
    close = F.filter(F.slice("fits", 1, 4), lambda f: f["fit"] >= F.col("best.fit") * 0.7)
    ranked_ = F.array_sort(F.transform(close, lambda f: F.struct((f["strong"] + f["moderate"]).alias("n"), f["order"].alias("order"), f["nth"].alias("nth"), f["strong"].alias("s"), f["moderate"].alias("m"))))
    m = m.withColumn("conflict", ranked_[0])
    channels = [c for c in patterns.columns if c not in (key, "active", "n_active")]
    n = F.size("residual")
    strength = sum((F.when(F.array_contains("residual", c), F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.lit(0.0)) for c in channels), F.lit(0.0))
    mean = F.when(n > 0, strength / n).otherwise(F.lit(0.0))
    bonus = F.when(n >= 3, 1.5).when(n >= 2, 1.2).otherwise(1.0)
    base = (0.35 * n / F.col("n_active") + 0.25 * mean + 0.25 * (1.0 - F.col("best.fit")) + 0.15 * n / N_DETECTION) * bonus
    score = F.least(F.lit(1.0), F.least(F.lit(1.0), base) + 0.15 * F.col("conflict.s") + 0.08 * F.col("conflict.m"))
    multi = m.select(key, "n_active", F.col("best.name").alias("best_scenario"), F.col("best.fit").alias("fit"), n.alias("n_residual"), (F.col("conflict.s") + F.col("conflict.m")).alias("n_conflicts"), score.alias("unexplained"))
    multi = multi.withColumn("verdict", F.when(F.col("unexplained") < 0.2, "EXPLAINED").when(F.col("unexplained") < 0.5, "PARTIALLY_EXPLAINED").otherwise("UNEXPLAINED"))
    few = patterns.filter("n_active < 2")
    top = F.coalesce(F.greatest(*[F.when(F.array_contains("active", c), F.col(c)) for c in channels]), F.lit(0.0))
    choice = F.lit("instrumental_systematic")
    fit = F.lit(0.5)
    for c in channels:
        options = [(s.predicted[c], s.name) for s in scenarios if not s.single_only and s.predicted.get(c, 0) > 0.3]
        if options:
            best = max(options, key=lambda o: o[0])
            choice = F.when(F.array_contains("active", c), F.lit(best[1])).otherwise(choice)
            fit = F.when(F.array_contains("active", c), F.lit(max(best[0], 0.5))).otherwise(fit)
    none = F.col("n_active") == 0
    one = few.select(key, "n_active", F.when(none, "none").otherwise(choice).alias("best_scenario"), F.when(none, 1.0).otherwise(fit).alias("fit"), F.lit(0).alias("n_residual"), F.lit(0).alias("n_conflicts"),
                     F.when(none, 0.0).otherwise(F.least(F.lit(0.3), 0.1 * top)).alias("unexplained"), F.lit("EXPLAINED").alias("verdict"))
    return multi.unionByName(one)
