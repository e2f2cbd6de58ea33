"""Row selections, cleaning rules and quotas over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions.photometry import absolute_magnitude
from skysift.operators import selection as L
from skysift.operators.skyjoin import ARCSEC, best_per_group, pairs, without_nearby
from skysift.plans import sqltext as Q
from skysift.plans.catalogs import TYPE_EXPR
from skysift.plans.registry import query
from skysift.plans.tables import CHANNELS


def r6(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


@query("hz_flag", "SELECT host_id, coalesce(insol >= 0.25 AND insol <= 1.75, false) OR (insol IS NULL AND eq_temp >= 180 AND eq_temp <= 310) AS hz_flag FROM fx_hosts")
def _(t):
    return t.hosts.select("host_id", L.habitable_zone("insol", "eq_temp").alias("hz_flag"))


@query("hz_targets_by_distance", """SELECT host_star, distance_pc FROM fx_hosts WHERE (coalesce(insol BETWEEN 0.25 AND 1.75, false) OR (insol IS NULL AND eq_temp BETWEEN 180 AND 310)) AND distance_pc <= 100""")
def _(t):
    return t.hosts.filter(L.habitable_zone("insol", "eq_temp") & (F.col("distance_pc") <= 100)).select("host_star", "distance_pc").orderBy("distance_pc", "host_star")


@query("distinct_hosts", "SELECT nation, min(host_star) AS host_star, arg_min(host_id, host_star) AS host_id FROM fx_hosts GROUP BY nation")
def _(t):
    # The kept row of each key is the smallest one, so the result does not depend on row order.
    best = t.hosts.groupBy("nation").agg(F.min(F.struct("host_star", "host_id")).alias("b"))
    return best.select("nation", "b.host_star", "b.host_id").orderBy("host_star")


_BROKEN = {
    "target_id": "CAST(o_orderkey AS STRING)", "host_star": "CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE o_orderpriority END",
    "ra": "o_custkey*3e-1 - 5e0", "dec": "(o_custkey % 200) - 9.9e1", "distance_pc": "(o_orderkey % 7) - 1e0",
}


@query("target_validation", "WITH b AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _BROKEN.items()) + """, CASE WHEN o_orderkey % 4 = 0 THEN 'bad_channel' ELSE 'ir_excess' END AS ch, CASE WHEN o_orderkey % 6 = 0 THEN 'maybe' ELSE 'positive' END AS ex FROM orders)
    SELECT target_id, 'missing host_star' AS warning FROM b WHERE host_star IS NULL UNION ALL SELECT target_id, 'ra out of range' FROM b WHERE ra < 0 OR ra > 360
    UNION ALL SELECT target_id, 'dec out of range' FROM b WHERE dec < -90 OR dec > 90 UNION ALL SELECT target_id, 'distance not positive' FROM b WHERE distance_pc <= 0
    UNION ALL SELECT target_id, 'unknown channel bad_channel' FROM b WHERE ch = 'bad_channel' UNION ALL SELECT target_id, 'unknown expectation maybe' FROM b WHERE ex = 'maybe'""")
def _(t):
    df = t.orders.selectExpr(*[f"{e} AS {c}" for c, e in _BROKEN.items()],
                             "map(CASE WHEN o_orderkey % 4 = 0 THEN 'bad_channel' ELSE 'ir_excess' END, CASE WHEN o_orderkey % 6 = 0 THEN 'maybe' ELSE 'positive' END) AS expected_channels")
    return L.target_warnings(df, CHANNELS)


@query("target_enrichment", f"""SELECT t.target_id, coalesce(CASE WHEN t.target_id % 3 = 0 THEN NULL ELSE t.g END, p.g) AS g, coalesce(CASE WHEN t.target_id % 4 = 0 THEN NULL ELSE t.bp_rp END, p.bp_rp) AS bp_rp,
    round({Q.gal_lat('t.ra', 't.dec')}, 6) AS b_gal FROM fx_targets t LEFT JOIN fx_pool p ON p.source_id = t.target_id""")
def _(t):
    x = t.targets.select("target_id", "ra", "dec", F.when(F.col("target_id") % 3 != 0, F.col("g")).alias("g"), F.when(F.col("target_id") % 4 != 0, F.col("bp_rp")).alias("bp_rp"),
                         F.lit(None).cast("double").alias("b_gal"))
    stars = t.pool.select(F.col("source_id").alias("target_id"), F.col("g").alias("g2"), F.col("bp_rp").alias("c2"))
    out = L.galactic_filled(x.join(stars, "target_id", "left"))
    return out.select("target_id", F.coalesce("g", "g2").alias("g"), F.coalesce("bp_rp", "c2").alias("bp_rp"), r6("b_gal", "b_gal"))


@query("high_energy_events", "SELECT event_id, energy_gev FROM fx_neutrinos WHERE energy_gev >= 1e5")
def _(t):
    return t.neutrinos.filter("energy_gev >= 1e5").select("event_id", "energy_gev").orderBy(F.desc("energy_gev"), "event_id")


@query("unidentified_sources", "SELECT source_id, name FROM fx_gamma WHERE source_class IN ('', 'unk')")
def _(t):
    return t.gamma.filter(F.trim(F.lower("source_class")).isin("", "unk")).select("source_id", "name")


@query("epoch_quality", "SELECT epoch_id, flux, flux_err FROM fx_optical_epochs WHERE band = 'G' AND abs(flux) > 0 AND abs(flux_err)/abs(flux) < 0.2")
def _(t):
    ok = (F.col("band") == "G") & (F.abs("flux") > 0) & (F.abs("flux_err") / F.abs("flux") < 0.2)
    return t.optical_epochs.filter(ok).select("epoch_id", "flux", "flux_err")


@query("bad_epochs", "SELECT epoch_id, mjd, CASE WHEN mjd BETWEEN 57000 AND 57071 THEN NULL ELSE w2 END AS w2, CASE WHEN mjd BETWEEN 57000 AND 57071 THEN NULL ELSE w2_err END AS w2_err FROM fx_ir_epochs WHERE mjd >= 56700")
def _(t):
    return L.clean_epochs(t.ir_epochs).select("epoch_id", "mjd", "w2", "w2_err")


def clip_sql(src, key, value, k, keep="*"):
    return (f"SELECT {keep} FROM (SELECT s.*, abs({value} - med) AS off_, median(abs({value} - med)) OVER (PARTITION BY {key}) AS mad_, stddev_pop({value}) OVER (PARTITION BY {key}) AS std_ "
            f"FROM (SELECT *, median({value}) OVER (PARTITION BY {key}) AS med FROM {src}) s) WHERE off_ = 0 OR off_ < {k}*(CASE WHEN mad_ > 0 THEN 1.4826e0*mad_ ELSE std_ END)")


@query("mad_sigma_clip", clip_sql("fx_ir_epochs", "target_id", "w1", 3, "target_id, epoch_id, w1"))
def _(t):
    return L.sigma_clip(t.ir_epochs, ["target_id"], "w1", 3.0).select("target_id", "epoch_id", "w1")


@query("lightcurve_clean", f"WITH c AS ({clip_sql('fx_lightcurve', 'target_id', 'flux', 5, 'target_id, time, flux')}) SELECT target_id, time, round(flux/median(flux) OVER (PARTITION BY target_id), 6) AS flux_norm FROM c")
def _(t):
    return L.clean_lightcurve(t.lightcurve, ["target_id"]).select("target_id", "time", r6("flux_norm", "flux_norm"))


@query("lightcurve_stitch", f"WITH c AS (SELECT *, concat(target_id, '_', sector) AS ts FROM fx_lightcurve), d AS ({clip_sql('c', 'ts', 'flux', 5, 'target_id, sector, time, flux')}) SELECT target_id, sector, time, round(flux/median(flux) OVER (PARTITION BY target_id, sector), 6) AS flux_norm FROM d")
def _(t):
    return L.clean_lightcurve(t.lightcurve, ["target_id", "sector"]).select("target_id", "sector", "time", r6("flux_norm", "flux_norm"))


@query("stride_downsample", """WITH r AS (SELECT target_id, time, flux, row_number() OVER (PARTITION BY target_id ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY target_id) AS n FROM fx_lightcurve)
    SELECT target_id, time, flux FROM r WHERE n <= 200 OR i % greatest(2, ceil(n/200e0))::BIGINT = 0""")
def _(t):
    return L.stride_sample(t.lightcurve, "target_id", ["time"], 200).select("target_id", "time", "flux")


@query("adaptive_search_radius", """SELECT target_id, round(CASE WHEN distance_pc > 0 THEN least(300e0, 5e0 + coalesce(sqrt(pmra*pmra + pmdec*pmdec)/1e3, least(5e0/distance_pc, 10e0))*15e0) ELSE 5e0 END, 6) AS radius
    FROM (SELECT target_id, distance_pc, CASE WHEN target_id % 2 = 0 THEN pmra END AS pmra, pmdec FROM fx_targets)""")
def _(t):
    df = t.targets.withColumn("pmra", F.when(F.col("target_id") % 2 == 0, F.col("pmra")))
    return df.select("target_id", r6(L.search_radius("distance_pc", "pmra", "pmdec"), "radius"))


@query("best_counterpart", f"""WITH c AS ({Q.cone('fx_targets', 'fx_shifted', '5.5e0/3.6e3', 'target_id', 'a.target_id, a.ra AS tra, a.dec AS tdec, b.source_id, b.ra AS sra, b.dec AS sdec, b.pmra, b.pmdec')}),
    d AS (SELECT target_id, source_id, 3600*sqrt(pow((sra - 16*pmra/3.6e6/cos(radians(sdec)) - tra)*cos(radians(tdec)), 2) + pow(sdec - 16*pmdec/3.6e6 - tdec, 2)) AS s FROM c)
    SELECT target_id, source_id, round(s, 6) AS sep_arcsec FROM d QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY s, source_id) = 1""")
def _(t):
    found = pairs(t.targets.select("target_id", "ra", "dec"), t.shifted.select("source_id", "ra", "dec", "pmra", "pmdec"), 5.5 * ARCSEC)
    sep = L.back_propagated_separation("r_ra", "r_dec", "r_pmra", "r_pmdec", "ra", "dec")
    best = found.groupBy("target_id").agg(F.min(F.struct(sep.alias("s"), "r_source_id")).alias("b"))
    return best.select("target_id", F.col("b.r_source_id").alias("source_id"), r6("b.s", "sep_arcsec"))


@query("volume_limited", "SELECT source_id, g, parallax::DOUBLE AS parallax FROM fx_pool WHERE parallax > 20 AND parallax/parallax_error > 10 AND g < 14")
def _(t):
    return L.volume_limited(t.pool, 50, 14).select("source_id", "g", F.col("parallax").cast("double").alias("parallax"))


@query("white_dwarf_locus", "SELECT source_id FROM fx_pool WHERE g + 5*log10(parallax) - 10 > 10 AND bp_rp < 1.5")
def _(t):
    return t.pool.filter(L.white_dwarf_locus()).select("source_id")


# Declination bands of the astrometric scan.
SCAN_BANDS = (-90, -60, -30, -15, 0, 15, 30, 60)
_BAND_SQL = "CASE " + " ".join(f"WHEN dec >= {b} THEN {i}" for i, b in reversed(list(enumerate(SCAN_BANDS)))) + " END"


def astrometric_outliers(stars, low, high, per_band, max_g=15.0, min_snr=10.0):
    """The strongest outliers of each declination band."""
    ok = (F.col("ruwe") > low) & (F.col("ruwe") < high) & (F.col("parallax") / F.col("parallax_error") > min_snr) & (F.col("g") < max_g)
    return best_per_group(stars.filter(ok).withColumn("band", F.expr(_BAND_SQL)), ["band"], [F.desc("ruwe"), F.col("source_id")], per_band)


@query("astrometric_outliers", f"""SELECT band, source_id, ruwe FROM (SELECT *, {_BAND_SQL} AS band FROM fx_pool WHERE ruwe > 1.4 AND ruwe < 4 AND parallax/parallax_error > 10 AND g < 15)
    QUALIFY row_number() OVER (PARTITION BY band ORDER BY ruwe DESC, source_id) <= 20""")
def _(t):
    return astrometric_outliers(t.pool, 1.4, 4.0, 20).select("band", "source_id", "ruwe")


@query("fgk_dwarf_cut", "SELECT target_id FROM fx_targets WHERE teff BETWEEN 4000 AND 7000 AND logg > 4 AND ruwe < 1.4 AND parallax > 0")
def _(t):
    return t.targets.filter(F.col("teff").between(4000, 7000) & (F.col("logg") > 4) & (F.col("ruwe") < 1.4) & (F.col("parallax") > 0)).select("target_id")


@query("control_sample", f"""WITH near AS (SELECT DISTINCT source_id FROM ({Q.cone('fx_pool', 'fx_targets', '5e0/3.6e3', 'source_id', 'a.source_id')})),
    c AS (SELECT * FROM fx_pool WHERE source_id NOT IN (SELECT source_id FROM near))
    SELECT floor(teff/1e3)::BIGINT AS teff_k, floor(1e3/parallax/1e2)::BIGINT AS d_bin, count(*) AS n FROM c GROUP BY ALL""")
def _(t):
    # Strata of the field around which controls are drawn, after taking out the listed positions.
    free = without_nearby(t.pool, t.targets.select("target_id", "ra", "dec"), 5 * ARCSEC, left_key="source_id")
    return free.groupBy(F.floor(F.col("teff") / 1e3).alias("teff_k"), F.floor(1e3 / F.col("parallax") / 1e2).alias("d_bin")).agg(F.count("*").alias("n"))


@query("seeded_control_draw")
def _(t):
    free = without_nearby(t.pool, t.targets.select("target_id", "ra", "dec"), 5 * ARCSEC, left_key="source_id")
    return L.hash_sample(free, "source_id", 100).select("source_id", "ra", "dec", "teff")


TIER_SQL = "CASE WHEN W1 - W2 > 0.1 OR (W3 IS NOT NULL AND (W3_err IS NULL OR W3_err = 0 OR W3/W3_err > 3)) THEN 'ir_excess_candidate' WHEN W1 IS NOT NULL THEN 'wise_detected' ELSE 'gaia_only' END"


def excess_tier():
    seen = F.col("W3").isNotNull() & (F.col("W3_err").isNull() | (F.col("W3_err") == 0) | (F.col("W3") / F.col("W3_err") > 3))
    return F.when(F.coalesce(F.col("W1") - F.col("W2") > 0.1, F.lit(False)) | seen, "ir_excess_candidate").when(F.col("W1").isNotNull(), "wise_detected").otherwise("gaia_only")


@query("excess_tier_quota", f"""SELECT target_id, tier FROM (SELECT p.target_id, {TIER_SQL} AS tier, t.distance_pc FROM fx_photometry p JOIN fx_targets t USING (target_id) WHERE t.distance_pc IS NOT NULL)
    ORDER BY CASE tier WHEN 'ir_excess_candidate' THEN 0 WHEN 'wise_detected' THEN 1 ELSE 2 END, distance_pc, target_id LIMIT 200""")
def _(t):
    d = t.targets.filter("distance_pc IS NOT NULL").select("target_id", "distance_pc")
    df = t.photometry.join(d, "target_id").select("target_id", "distance_pc", excess_tier().alias("tier"))
    rank = F.when(F.col("tier") == "ir_excess_candidate", 0).when(F.col("tier") == "wise_detected", 1).otherwise(2)
    return L.first_by_rank(df, [rank, F.col("distance_pc"), F.col("target_id")], 200).select("target_id", "tier")


@query("boundary_candidates", "SELECT row_id, total_score, CASE WHEN total_score >= 2.95 THEN 'just below threshold' ELSE 'near threshold' END AS reason FROM fx_report_rows WHERE total_score >= 2.9 AND total_score < 3")
def _(t):
    from skysift.sources.sinks import boundary_rows
    return boundary_rows(t.report_rows, "total_score", 3.0, 0.1).select("row_id", "total_score", "reason")


def escalation_reasons(score_min):
    return L.messages(
        (F.col("total_score") >= score_min, "score"), (F.col("ruwe") > 1.4, "ruwe"), (F.col("pm_sigma") > 3, "pm_discrepancy"), (F.col("n_active") >= 2, "convergent"),
        (F.col("is_fdr"), "fdr_significant"), (F.col("unexplainability") >= 0.5, "UNEXPLAINED"),
        ((F.col("unexplainability") >= 0.2) & (F.col("unexplainability") < 0.5), "partial_unexplained"))


@query("escalation_list", """SELECT row_id, total_score, list_filter([CASE WHEN total_score >= 4.5 THEN 'score' END, CASE WHEN ruwe > 1.4 THEN 'ruwe' END, CASE WHEN pm_sigma > 3 THEN 'pm_discrepancy' END,
    CASE WHEN n_active >= 2 THEN 'convergent' END, CASE WHEN is_fdr THEN 'fdr_significant' END, CASE WHEN unexplainability >= 0.5 THEN 'UNEXPLAINED' WHEN unexplainability >= 0.2 THEN 'partial_unexplained' END], lambda x: x IS NOT NULL) AS reasons
    FROM fx_report_rows WHERE total_score >= 4.5 OR ruwe > 1.4 OR pm_sigma > 3 OR n_active >= 2 OR is_fdr OR unexplainability >= 0.2 ORDER BY total_score DESC, row_id LIMIT 50""")
def _(t):
    df = t.report_rows.withColumn("reasons", escalation_reasons(4.5)).filter(F.size("reasons") > 0)
    return L.first_by_rank(df, [F.desc("total_score"), F.col("row_id")], 50).select("row_id", "total_score", "reasons")


@query("name_search", """WITH m AS (SELECT target_id, report, row_id, total_score FROM fx_report_rows r JOIN fx_targets t USING (target_id) WHERE contains(lower(host_star), '0012'))
    SELECT * FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY report DESC, row_id) = 1) ORDER BY target_id LIMIT 20""")
def _(t):
    hit = t.targets.filter(F.lower("host_star").contains("0012")).select("target_id")
    rows = t.report_rows.join(hit, "target_id").select("target_id", "report", "row_id", "total_score")
    return best_per_group(rows, ["target_id"], [F.desc("report"), F.col("row_id")]).orderBy("target_id").limit(20)


# Object types of each calibration population.
POPULATIONS = {
    "binary": ("**", "SB*", "EB*", "RS*"), "disk": ("Be*", "Ae*", "TT*"), "yso": ("Y*O", "Y*?"),
    "giant": ("RG*", "AB*", "C*"), "extragalactic": ("QSO", "AGN", "G"),
}
_POP_SQL = "CASE " + " ".join(f"WHEN otype IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in POPULATIONS.items()) + " END"


@query("object_type_populations", f"""WITH o AS (SELECT *, {TYPE_EXPR} AS otype FROM fx_shifted), p AS (SELECT source_id, {_POP_SQL} AS population, parallax FROM o WHERE parallax > 10)
    SELECT population, source_id, parallax::DOUBLE AS parallax FROM p WHERE population IS NOT NULL QUALIFY row_number() OVER (PARTITION BY population ORDER BY parallax DESC, source_id) <= 40""")
def _(t):
    ladder = None
    for k, v in POPULATIONS.items():
        ladder = (F.when if ladder is None else ladder.when)(F.col("otype").isin(*v), k)
    df = t.shifted.withColumn("otype", F.expr(TYPE_EXPR)).filter("parallax > 10").withColumn("population", ladder).filter("population IS NOT NULL")
    df = best_per_group(df, ["population"], [F.desc("parallax"), F.col("source_id")], 40)
    return df.select("population", "source_id", F.col("parallax").cast("double").alias("parallax"))


@query("unknown_nature_nearby", "SELECT p.source_id, p.parallax::DOUBLE AS parallax FROM fx_shifted s JOIN fx_pool p USING (source_id) WHERE s.kind = 'SMALL' AND p.parallax > 10 AND p.parallax/p.parallax_error > 3 ORDER BY p.parallax DESC, source_id LIMIT 100")
def _(t):
    kinds = t.shifted.filter("kind = 'SMALL'").select("source_id")
    df = t.pool.join(kinds, "source_id").filter("parallax > 10 AND parallax/parallax_error > 3")
    return L.first_by_rank(df, [F.desc("parallax"), F.col("source_id")], 100).select("source_id", F.col("parallax").cast("double").alias("parallax"))


@query("control_subsets", "SELECT target_id, 'positive' AS subset FROM fx_outcomes WHERE expected = 'positive' UNION ALL SELECT target_id, 'negative' FROM fx_outcomes WHERE expected = 'negative'")
def _(t):
    flags = t.outcomes.select("target_id", (F.col("expected") == "positive").alias("is_positive_control"), (F.col("expected") == "negative").alias("is_negative_control"))
    return flags.select("target_id", F.when(F.col("is_positive_control"), "positive").when(F.col("is_negative_control"), "negative").alias("subset")).filter("subset IS NOT NULL")


@query("strip_simulated", "SELECT report, target_id, count(*) AS n FROM fx_report_rows WHERE data_source <> 'simulated' GROUP BY ALL")
def _(t):
    kept = t.report_rows.filter(F.col("data_source") != "simulated")
    return kept.groupBy("report", "target_id").agg(F.count("*").alias("n"))


@query("target_detail", "SELECT s.channel, s.score, r.report, r.total_score FROM fx_scores s JOIN (SELECT * FROM fx_report_rows WHERE target_id = 7 ORDER BY report DESC, row_id LIMIT 1) r USING (target_id)")
def _(t):
    newest = best_per_group(t.report_rows.filter("target_id = 7"), ["target_id"], [F.desc("report"), F.col("row_id")])
    return t.scores.filter("target_id = 7").join(newest.select("target_id", "report", "total_score"), "target_id").select("channel", "score", "report", "total_score")


@query("display_projection", """SELECT row_id AS id, total_score AS score, n_active AS channels, CASE WHEN unexplainability < 0.15 THEN 'HIGH' WHEN unexplainability < 0.3 THEN 'MODERATE' WHEN unexplainability < 0.6 THEN 'LOW' END AS risk,
    data_source = 'real' AS overlay FROM fx_report_rows""")
def _(t):
    u = F.col("unexplainability")
    return t.report_rows.select(F.col("row_id").alias("id"), F.col("total_score").alias("score"), F.col("n_active").alias("channels"),
                                F.when(u < 0.15, "HIGH").when(u < 0.3, "MODERATE").when(u < 0.6, "LOW").alias("risk"), (F.col("data_source") == "real").alias("overlay"))


@query("white_dwarf_targets", """SELECT concat('WD_', source_id) AS target_id, round(1e3/parallax, 6) AS distance_pc, round(g + 5*log10(parallax) - 10, 6) AS abs_mag FROM fx_pool
    WHERE g + 5*log10(parallax) - 10 > 10 AND bp_rp < 1 AND parallax > 20 AND parallax/parallax_error > 10""")
def _(t):
    df = t.pool.filter(L.white_dwarf_locus(reddest=1.0) & F.expr("parallax > 20 AND parallax/parallax_error > 10"))
    return df.select(F.concat(F.lit("WD_"), "source_id").alias("target_id"), r6(1e3 / F.col("parallax"), "distance_pc"), r6(absolute_magnitude("g", "parallax"), "abs_mag"))
