"""Rule ladders that try to explain an anomaly away. All of them work inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions import sphere as S

def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _ladder(*rules: tuple[Column, float | Column], default: float = 0.0) -> Column:
    """First rule that holds gives the value."""
    out = None
    for cond, value in rules:
        v = value if isinstance(value, Column) else F.lit(float(value))
        out = F.when(_yes(cond), v) if out is None else out.when(_yes(cond), v)
    return out.otherwise(F.lit(float(default)))


def _worst(*rules: tuple[Column, float]) -> Column:
    """Largest value among the rules that hold."""
    return F.greatest(F.lit(0.0), *[F.when(_yes(c), F.lit(float(v))).otherwise(F.lit(0.0)) for c, v in rules])


def _has(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


# Infrared colour limits of active nuclei, galaxies and stars.
AGN_W12, STAR_W12, GALAXY_W23, GALAXY_W34 = 0.8, 0.3, 2.0, 1.5


def galaxy_contamination(infrared_selected: bool = False) -> Column:
    """Score of a background galaxy in the beam: the largest indicator plus 0.3 of each other."""
    w12, w23, w34 = F.col("W1") - F.col("W2"), F.col("W2") - F.col("W3"), F.col("W3") - F.col("W4")
    lat = S.galactic_latitude("ra", "dec")
    parts = [
        F.when(w12 > AGN_W12, 0.8).when(w12 > STAR_W12, 0.3), F.when(w23 > GALAXY_W23, 0.5), F.when((w34 > GALAXY_W34) & F.lit(not infrared_selected), 0.4),
        F.when(F.col("ext_flg") > 0, 0.7), F.when(F.col("n_beam") > 0, F.least(F.lit(0.6), 0.3 * F.col("n_beam"))), F.when(F.abs(lat) < 10, 0.3),
        F.when((F.col("sigma_w4") > 3) & (F.col("sigma_w3").isNull() | (F.col("sigma_w3") < 2)), 0.6),
    ]
    ordered = F.sort_array(F.array_compact(F.array(*[p.cast("double") for p in parts])), asc=False)
    rest = F.aggregate(F.slice(ordered, 2, len(parts)), F.lit(0.0), lambda a, x: a + 0.3 * x)
    score = F.when(F.size(ordered) > 0, F.least(F.lit(1.0), ordered[0] + rest)).otherwise(F.lit(0.0))
    return F.when(F.col("W1").isNotNull() | F.col("W2").isNotNull(), score)


# Type codes (upper case) of binaries, young stars and variables.
BINARY_TYPES = ("SB*", "EB*", "**", "SB1", "SB2", "ECLBIN", "SPECTROBIN")
YOUNG_TYPES = ("TTAU", "YSO", "PMS", "HAEBE", "HERBIG")
VARIABLE_TYPES = ("V*", "RRCLY", "CEPHEID", "MIRA", "LPV", "BYDR", "RSCV")


def risks() -> dict[str, Column]:
    """Risk of each falsification check; a null means the check does not apply."""
    g, lat = F.col, F.abs(S.galactic_latitude("ra", "dec"))
    kind = F.upper(F.coalesce("otype", F.lit("")))
    strong = _yes((g("sigma_w3") > 5) & (g("sigma_w4") > 5))
    infrared = _worst(((g("sigma_w4") > 3) & (g("sigma_w3").isNull() | (g("sigma_w3") < 2)), 0.6),
                      (~_yes(g("sigma_w4") > 3) & (g("sigma_w3") > 3) & (g("sigma_w3") < 5), 0.4), ((lat < 10) & (g("sigma_w3") > 3), 0.5))
    far = F.when(_yes(g("parallax_error") / F.when(g("parallax") > 0, g("parallax")) > 0.2), 0.5).otherwise(0.3)
    quality = _ladder((g("verdict") == "EXPLAINED", 0.7), (g("verdict") == "PARTIALLY_EXPLAINED", 0.4), (g("verdict") == "UNEXPLAINED", 0.1))
    quality = F.when(g("is_fdr"), F.greatest(F.lit(0.0), quality - 0.1)).otherwise(quality)
    return {
        "known_object_type": _worst((_has(kind, BINARY_TYPES), 0.8), (_has(kind, YOUNG_TYPES), 0.7), (_has(kind, VARIABLE_TYPES), 0.6),
                                    ((g("logg") < 3) & (g("sigma_w3") > 5), 0.6), (g("nss") > 0, 0.8), ((g("teff") < 3500) & (g("variability") > 0.1), 0.5)),
        "ruwe_context": _ladder((g("ruwe").isNull(), 0), (g("g") < 6, 0.6), (g("bp_rp") > 3, 0.4), ((g("ruwe") > 1.4) & (g("ruwe") < 2), 0.3), (g("ruwe") > 4, 0.1)),
        "ir_excess_context": F.when(strong, F.least(infrared, F.lit(0.2))).otherwise(infrared),
        "galactic_contamination": _ladder((lat < 5, 0.7), (lat < 15, 0.4), (lat < 30, 0.15)),
        "photometric_reliability": _worst((g("n_obs") < 20, 0.4), ((g("phot_excess") > 1.5) | (g("phot_excess") < 0.7), 0.5), (g("multi_peak") > 10, 0.6), (g("g") > 18, 0.4), (g("g") < 4, 0.5)),
        "pm_consistency": _ladder((g("is_discrepant") & (g("pm_sigma") > 5), 0.1), (g("is_discrepant") & (g("pm_sigma") > 3), 0.3)),
        "chance_alignment": _ladder((g("chance_p") > 0.01, 0.5), (g("chance_p") > 0.001, 0.3)),
        "single_channel": _ladder((g("n_active") <= 1, 0.6), ((g("n_active") == 2) & g("pair_is_known"), 0.4), (g("n_active") == 2, 0.1)),
        "distance_bias": _ladder((g("distance_pc") < 3, 0.5), (g("distance_pc") < 5, 0.3), (g("distance_pc") > 100, far)),
        "convergence_quality": F.when(g("n_active") < 2, F.lit(0.0)).otherwise(quality),
        "xray_activity": _ladder((g("xray") > 1e-12, 0.8), (g("xray") > 1e-13, 0.6), (g("xray") > 0, 0.2)),
        # An unknown reddening gives no row; an unknown position or distance gives a gap row of no risk.
        "dust_extinction": F.when(g("distance_pc").isNull(), F.lit(0.0)).when(g("ebv").isNotNull(), _ladder((g("ebv") >= 0.3, 0.6), (g("ebv") >= 0.05, 0.3), (g("ebv") >= 0.01, 0.1))),
        "binary_orbit": _ladder((g("orbit_match"), 0.9)),
        "object_catalog": F.coalesce(g("object_risk"), F.lit(0.0)),
    }


def overall_risk(df: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """Weighted risk of all checks, its level, a recommendation, the number of flags and the top risk."""
    checks = checks or risks()
    item = [F.when(c.isNotNull(), F.struct(c.cast("double").alias("risk"), F.lit(-i).alias("nth"), F.lit(n).alias("name"))) for i, (n, c) in enumerate(checks.items())]
    out = df.withColumn("checks", F.sort_array(F.array_compact(F.array(*item)), asc=False))
    r = lambda i: F.get(F.col("checks"), F.lit(i))["risk"]
    n = F.size("checks")
    rest = F.aggregate(F.slice("checks", 4, len(checks)), F.lit(0.0), lambda a, x: a + x["risk"]) / F.greatest(n - 3, F.lit(1))
    risk = F.when(n >= 3, 0.40 * r(0) + 0.25 * r(1) + 0.15 * r(2) + 0.20 * rest).when(n == 2, 0.55 * r(0) + 0.45 * r(1)).when(n == 1, r(0)).otherwise(F.lit(0.0))
    out = out.withColumn("risk", F.least(F.lit(1.0), risk))
    level = F.when((r(0) >= 0.9) | (F.col("risk") >= 0.75), "CRITICAL").when(F.col("risk") >= 0.5, "HIGH").when(F.col("risk") >= 0.3, "MODERATE").otherwise("LOW")
    out = out.withColumn("risk_level", level)
    advice = F.when(F.col("risk_level") == "CRITICAL", "DEMOTE").when(F.col("risk_level").isin("HIGH", "MODERATE"), "MONITOR").otherwise("ESCALATE")
    return out.withColumn("recommendation", advice).withColumn("n_flags", F.size(F.filter("checks", lambda c: c["risk"] > 0.5))).withColumn(
        "top_risk", F.when(r(0) > 0.3, F.get(F.col("checks"), F.lit(0))["name"]))


def certificate(df: DataFrame) -> DataFrame:
    """Eight criteria, the number passed and the grade."""
    g = F.col
    rules = {
        "real_data_only": (g("n_real") >= 2) & (g("n_simulated") == 0), "multi_channel": g("n_active") >= 2, "significant": g("stouffer_p") < 0.01, "unexplained": g("unexplained") > 0.3,
        "survives_review": g("recommendation") == "ESCALATE", "no_dominance": g("top_share") <= 0.8, "distance_known": (g("distance_pc") > 0) & (g("distance_pc") <= 2000), "replicated": g("n_runs") >= 2,
    }
    out = df.withColumn("criteria", F.array(*[F.struct(F.lit(n).alias("name"), _yes(c).alias("passed")) for n, c in rules.items()]))
    passed = F.size(F.filter("criteria", lambda c: c["passed"]))
    needed = F.forall("criteria", lambda c: c["passed"] | (c["name"] == "replicated"))
    grade = F.when(passed == len(rules), "CERTIFIED").when(needed, "PROVISIONAL").when(passed >= len(rules) * 0.75, "PARTIAL").otherwise("FAIL")
    return out.withColumn("n_passed", passed).withColumn("grade", grade)


# Class of each scenario, tier of each class, channel sets that mean a binary or a disk.
SCENARIO_CLASS = {
    "binary_system": "BINARY", "spectroscopic_binary": "BINARY", "face_on_binary": "BINARY", "young_stellar_object": "YSO", "debris_disk": "CIRCUMSTELLAR",
    "active_flare_star": "ACTIVE_STAR", "background_contamination": "CONTAMINATION", "instrumental_systematic": "SINGLE_CHANNEL",
}
CLASS_TIER = {
    "GATHERED": "NOISE", "SINGLE_CHANNEL": "NOISE", "HZ_PRIOR": "NOISE", "BINARY": "EXPLAINED", "YSO": "EXPLAINED", "CIRCUMSTELLAR": "EXPLAINED", "ACTIVE_STAR": "EXPLAINED",
    "CONTAMINATION": "EXPLAINED", "PARTIALLY_EXPLAINED": "BORDERLINE", "UNEXPLAINED": "ANOMALOUS", "UNCLASSIFIED": "UNKNOWN",
}
BINARY_PATTERNS = (
    ("proper_motion_anomaly", "ir_excess"), ("proper_motion_anomaly", "hr_anomaly"), ("proper_motion_anomaly", "hr_anomaly", "uv_anomaly"), ("proper_motion_anomaly", "ir_excess", "hr_anomaly"),
    ("proper_motion_anomaly", "ir_excess", "uv_anomaly"), ("proper_motion_anomaly", "hr_anomaly", "uv_anomaly", "ir_excess"), ("uv_anomaly", "hr_anomaly"), ("proper_motion_anomaly", "uv_anomaly"),
)
DISK_PATTERNS = (("ir_excess", "transit_anomaly"),)


def taxonomy(active: Column, prior_active: Column, scenario: Column, unexplained: Column, text: Column) -> Column:
    """Class of a source from its active detection channels, scenario, unexplained share and notes."""
    n = F.size(active)
    pattern = F.concat_ws("|", F.array_sort(active))
    same = lambda sets: pattern.isin(*["|".join(sorted(s)) for s in sets])
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in SCENARIO_CLASS.items() for x in kv]), F.coalesce(scenario, F.lit("")))
    given = scenario.isNotNull() & (F.lower(scenario) != "none")
    by_share = F.when(unexplained >= 0.5, "UNEXPLAINED").when(unexplained >= 0.2, "PARTIALLY_EXPLAINED")
    notes = F.lower(F.coalesce(text, F.lit("")))
    words = (F.when(notes.contains("binary") & (notes.contains("explained") | notes.contains("template")), "BINARY").when(notes.contains("yso") | notes.contains("young stellar"), "YSO")
             .when(notes.contains("debris") | notes.contains("circumstellar") | notes.contains("disk"), "CIRCUMSTELLAR").otherwise("UNCLASSIFIED"))
    fallback = F.when(same(BINARY_PATTERNS), "BINARY").when(same(DISK_PATTERNS), "CIRCUMSTELLAR").otherwise(words)
    return (F.when(n == 0, F.when(prior_active, "HZ_PRIOR").otherwise("GATHERED")).when(n == 1, "SINGLE_CHANNEL").when(by_share.isNotNull(), by_share)
            .when(given & mapped.isNotNull(), mapped).when(given & unexplained.isNotNull(), "UNCLASSIFIED").otherwise(fallback))


def class_tier(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_TIER.items() for x in kv]), name)


def natural_tests() -> Column:
    """Ordered natural explanations with verdict and confidence."""
    g = F.col

    def test(name, *rules, default=0.8):
        verdict, conf = F.lit("ruled_out"), F.lit(float(default)) if not isinstance(default, Column) else default
        for cond, v, c in reversed(rules):
            verdict, conf = F.when(_yes(cond), v).otherwise(verdict), F.when(_yes(cond), F.lit(float(c))).otherwise(conf)
        return F.struct(F.lit(name).alias("name"), verdict.alias("verdict"), conf.alias("confidence"))

    return F.array(
        test("yso_disk", ((g("teff") < 4000) & (g("logg") < 3.5), "plausible", 0.7), default=0.85),
        test("debris_disk", ((g("sigma_w4") > 3) & (g("sigma_w3").isNull() | (g("sigma_w3") < 3)), "plausible", 0.75), (g("teff") > 6500, "inconclusive", 0.5)),
        test("agb_dust", (g("logg") < 2, "plausible", 0.9), default=F.when(g("logg").isNotNull(), F.lit(0.9)).otherwise(F.lit(0.5))),
        test("galaxy_contamination", (g("cc_flags") != "0000", "plausible", 0.85), (g("chi2_red") > 50, "inconclusive", 0.6)),
        test("instrumental_artifact", (g("chi2_red") > 100, "inconclusive", 0.6), default=0.85),
        test("variable_star", (g("variability") > 0.05, "plausible", 0.7)),
        test("stellar_activity", (g("ruwe") > 2, "inconclusive", 0.5), default=0.75),
    )


def follow_up(n_surveys: Column, rv_variable: Column, spectral_type: Column, fe_h: Column, active: Column) -> Column:
    """What the archive of spectra says should happen next."""
    kind = F.lower(F.coalesce(spectral_type, F.lit("")))
    motion_only = F.concat_ws("|", F.array_sort(active)).isin("proper_motion_anomaly", "ir_excess|proper_motion_anomaly")
    giant = kind.contains("iii") | kind.contains("iv") | kind.contains("ii")
    return (F.when(n_surveys == 0, "NEEDS_FOLLOWUP").when(_yes(rv_variable) & motion_only, "SKIP").when(giant & F.array_contains(active, "ir_excess"), "SKIP")
            .when(_yes(F.abs(fe_h) > 1) | kind.contains("e"), "HIGH_PRIORITY").otherwise("ARCHIVE_SUFFICIENT"))


def display_unexplained(active: Column, ruwe: Column, given: Column) -> Column:
    """Estimate from the active channels for display, never above the computed value."""
    has = lambda *cs: F.arrays_overlap(active, F.array(*[F.lit(c) for c in cs]))
    n = F.size(active)
    ir, pm, hr, uv = has("ir_excess"), has("proper_motion_anomaly"), has("hr_anomaly"), has("uv_anomaly")
    radio, phot = has("radio_anomaly", "radio_emission"), has("gaia_photometric_anomaly")
    guess = (F.when(n == 1, F.when(ir, 0.20).otherwise(0.10)).when(pm & hr & ~ir & ~radio, 0.05).when(pm & uv & hr & ~ir, 0.05).when(pm & phot & ~ir & ~radio, 0.08).when((n == 2) & ~ir, 0.15)
             .when(ir & pm & (n == 2), F.when(_yes(ruwe > 4), 0.15).otherwise(0.35)).when(ir & pm & hr & ~radio & ~uv, 0.15).when(ir & radio, F.when(n >= 3, 0.85).otherwise(0.70)).when(ir & pm & uv, 0.75)
             .when(ir & (n >= 3), 0.60).when(n >= 3, 0.45).otherwise(0.25))
    return F.when(n == 0, given).otherwise(F.least(guess, given))


# --- adversarial review -------------------------------------------------------------------

OK, DOUBT, BAD, OPEN = "CONFIRMED", "CHALLENGED", "REFUTED", "INCONCLUSIVE"
# Saturation limits (mag) and object types that explain a multi-channel anomaly.
SATURATION = {"W1": 8.1, "W2": 6.7, "W3": 3.8, "W4": -0.4}
RISKY_TYPES = ("YSO", "Y*O", "CV*", "QSO", "AGN", "Sy*", "Em*", "WR*", "Be*", "AB*", "SB*", "EB*")


def _verdict(known: Column, *rules: tuple[Column, str], default: str = OK) -> Column:
    out = F.when(~_yes(known), OPEN)
    for cond, v in rules:
        out = out.when(_yes(cond), v)
    return out.otherwise(default)


def _count(*conds: Column) -> Column:
    return sum((_yes(c).cast("int") for c in conds), F.lit(0))


def review_checks() -> dict[str, dict[str, tuple[Column, str]]]:
    """Group -> check -> (verdict, severity)."""
    g, lat = F.col, F.abs(S.galactic_latitude("ra", "dec"))
    infrared = g("W1").isNotNull()
    quality = F.transform(F.split("ph_qual", ""), lambda q: F.when(q.isin("U", "X"), 1).otherwise(0))
    n_quality = F.aggregate(quality, F.lit(0), lambda a, x: a + x)
    n_confused = F.length(F.regexp_replace("cc_flags", "[0-]", ""))
    n_flags = n_quality + n_confused + _count(g("ext_flg") > 0, g("epochs_ir") < 3)
    faint = lambda b, e: F.abs(g("W1") - g(b)) / F.greatest(F.coalesce(g(f"{b}_err"), F.lit(e)), F.lit(0.05))
    side = lambda a, e: F.pow(g(a) - g(f"w{a}"), F.lit(2)) / (F.pow(F.hypot(g(f"{a}_error"), g(f"w{a}_error")), F.lit(2)) + e * e)
    pm_p = F.exp(-(side("pmra", 3.0) + side("pmdec", 3.0)) / 2)
    n_astro = _count(g("ruwe") > 1.4, g("aen_sig") > 5, g("harmonic") > 0.1, g("parallax") / g("parallax_error") < 5, g("n_params") < 31)
    binary = 0.3 * _count(g("ruwe") > 1.4) + 0.15 * _count(g("aen") > 2) + 0.4 * _count(g("nss") > 0) + 0.1 * _count((F.abs(g("W1") - g("W3")) > 0.5) & (F.abs(g("W1") - g("W2")) > 0.3))
    young = 0.2 * _count(g("logg") < 3.5) + 0.2 * _count(lat < 10) - 0.1 * _count(lat > 30) + 0.3 * _count(g("W1") - g("W4") > 3)
    chance = g("n_radio_wide") / 0.08726646259971647 * F.pow(g("radio_offset") / 3600, F.lit(2)) * 3.141592653589793
    index = F.log(g("radio_mjy") / g("flux_low")) / F.log(F.lit(3 / 1.4))
    w3, w4 = F.col("sigma_w3"), F.col("sigma_w4")
    return {
        "identity": {
            "A1": (F.when(_yes(g("star_offset").isNotNull()), OK).otherwise(BAD), "critical"), "A2": (_verdict(g("star_offset").isNotNull(), (g("star_offset") >= 2.5, DOUBT)), "warning"),
            "A3": (_verdict(infrared, ((F.abs(g("k_w1")) > 0.3) | g("ph_qual").rlike("[UXZ]"), DOUBT)), "warning"), "B5": (_verdict(g("Ks").isNotNull() & infrared, (F.abs(g("Ks") - g("W1")) > 0.5, DOUBT)), "warning"),
        },
        "infrared": {
            "B1": (_verdict(infrared, (n_flags > 2, BAD), (n_flags > 0, DOUBT)), "critical"), "B2": (_verdict(infrared & g("W3").isNotNull(), (faint("W3", 0.2) > 3, OK), default=DOUBT), "warning"),
            "B3": (F.when(g("n_ir_near") > 1, DOUBT).otherwise(OK), "warning"), "B4": (_verdict(infrared, (_count(*[g(b) < x for b, x in SATURATION.items()]) > 0, DOUBT)), "critical"),
            "F1": (_verdict(w3.isNotNull() | w4.isNotNull(), ((w3 > 3) | (w4 > 3), OK), default=DOUBT), "warning"), "F2": (F.when(g("epochs_ir") > 20, OK).otherwise(OPEN), "info"), "F3": (F.lit(OPEN), "info"),
        },
        "astrometry": {
            "C1": (_verdict(g("ruwe").isNotNull(), (n_astro > 2, BAD), (n_astro > 0, DOUBT)), "warning"), "C2": (F.when(pm_p < 0.05, OK).otherwise(DOUBT), "warning"),
            "C3": (_verdict(infrared, ((g("W1") < 8) | (g("W1") > 16) | (g("wpmra_error") > 10), DOUBT)), "warning"), "C4": (F.when(g("nss") > 0, BAD).otherwise(OK), "critical"),
        },
        "radio": {
            "D1": (F.when(g("flux_low").isNotNull(), OK).when(g("dec") < -40, OK).otherwise(OPEN), "info"),
            "D2": (_verdict(g("radio_offset").isNotNull(), ((g("radio_offset") < 2) & (g("radio_snr") < 5), "DETECTED"), (g("radio_offset") < 2, OK), default=DOUBT), "warning"),
            "D3": (_verdict(g("radio_offset").isNotNull(), (chance < 0.001, OK), default=DOUBT), "warning"), "D4": (_verdict(g("radio_mjy").isNotNull() & g("flux_low").isNotNull() & (g("radio_mjy") > 0), (index < -1, DOUBT)), "info"),
        },
        "alternatives": {
            "E1": (F.when(binary >= 0.5, DOUBT).when(binary >= 0.3, OPEN).otherwise(OK), "warning"), "E2": (F.when(young >= 0.4, DOUBT).otherwise(OK), "warning"),
            "E3": (F.when((g("n_ir_near") > 3) | _yes(g("otype").isin("QSO", "GALAXY")), DOUBT).otherwise(OK), "warning"), "E4": (_verdict(g("otype").isNotNull(), (_has(g("otype"), RISKY_TYPES), BAD)), "critical"),
            "E5": (F.lit(OPEN), "info"), "E6": (F.when(_yes(g("xray") > 0), DOUBT).otherwise(OK), "warning"), "E7": (F.when(g("nuv").isNotNull(), OK).otherwise(OPEN), "info"),
        },
        "environment": {
            "G1": (F.when(lat < 5, DOUBT).otherwise(OK), "warning"), "G2": (_verdict(g("ebv").isNotNull(), (g("ebv") > 0.5, DOUBT)), "warning"), "G3": (F.when(g("n_stars_near") > 10, DOUBT).otherwise(OK), "warning"),
            "G4": (F.when(g("n_ir_near") > 2, DOUBT).otherwise(OK), "warning"), "H1": (F.when(g("spectrum_offset") < 1.5, BAD).otherwise(OK), "warning"), "H2": (F.when(g("teff").isNotNull(), OK).otherwise(OPEN), "info"),
            "H3": (F.when(g("dec") < -31, OPEN).otherwise(OK), "info"), "H4": (_verdict(g("variability").isNotNull(), (g("variability") > 0.19, BAD), (g("variability") > 0.15, DOUBT)), "warning"),
            "H5": (F.when(_yes(g("orbit_match")), BAD).otherwise(OK), "warning"),
        },
    }


def review(df: DataFrame, key: str = "target_id", groups=None) -> DataFrame:
    """One row per source and check."""
    items = [F.struct(F.lit(name).alias("check"), v.alias("verdict"), F.lit(sev).alias("severity"))
             for group, checks in review_checks().items() if groups is None or group in groups for name, (v, sev) in checks.items()]
    return df.select(key, F.explode(F.array(*items)).alias("r")).select(key, "r.*")


def review_verdict(checks: DataFrame, key: str = "target_id") -> DataFrame:
    v = F.col("verdict")
    g = checks.groupBy(key).agg(F.count("*").alias("n"), F.count_if(v == BAD).alias("refuted"), F.count_if((v == BAD) & (F.col("severity") == "critical")).alias("critical"),
                                F.count_if(v == DOUBT).alias("challenged"), F.count_if(v == OK).alias("confirmed"))
    overall = F.when(F.col("critical") > 0, "REJECTED").when((F.col("refuted") > 0) | (F.col("challenged") > 3), "WEAKENED").otherwise("SURVIVES")
    conf = F.when(F.col("critical") > 0, 0.9).when(F.col("refuted") > 0, 0.6).when(F.col("challenged") > 3, 0.5).otherwise(F.col("confirmed") / F.col("n"))
    return g.withColumn("overall", overall).withColumn("confidence", conf)

