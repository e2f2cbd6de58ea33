"""Vetting rules, review, certificates and taxonomy over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import skysift.plans.scoring  # noqa: F401  its SQL is named below

from skysift.operators import detectors as D
from skysift.operators import vetting as V
from skysift.operators.ordered import ranked
from skysift.operators.skyjoin import ARCSEC, count_within, nearest, pairs
from skysift.operators.templates import source_patterns
from skysift.plans import sqltext as Q
from skysift.plans.associations import MESSENGER_RADII, NEAR, messengers
from skysift.plans.catalogs import SPECTRA_EXPR, near_sql
from skysift.plans.detectors import PM_SQL
from skysift.plans.registry import ORACLES, QUERIES, query


def r6(c, name):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name)


LAT = Q.gal_lat("ra", "dec")
_PHOT = ("W1", "W2", "W3", "W4", "W3_err", "W4_err", "Ks", "cc_flags", "ext_flg", "ph_qual")
_VERD = ("n_active", "pair_is_known", "verdict", "is_fdr", "chance_p", "orbit_match", "object_risk", "n_real", "n_simulated", "stouffer_p", "unexplained", "recommendation", "top_share", "n_runs", "chi2_red")


def cases(t):
    """Everything the rules read, one row per target."""
    m = D.motion_consistency(t.signals)
    return m.join(t.photometry.select("target_id", *_PHOT), "target_id").join(t.verdicts.select("target_id", *_VERD), "target_id")


CASE_SQL = f"{PM_SQL}, cs AS (SELECT m.*, chi2 > 13.82 AS is_discrepant, {', '.join('p.' + c for c in _PHOT)}, {', '.join('v.' + c for c in _VERD)} FROM pm4 m JOIN fx_photometry p USING (target_id) JOIN fx_verdicts v USING (target_id))"


@query("galaxy_contamination", f"""WITH nb AS (SELECT target_id, count(*) AS n FROM ({Q.cone('fx_targets', 'fx_shifted', '2.5e0/3.6e3', 'target_id', 'a.target_id')}) GROUP BY 1), c AS (SELECT s.target_id, s.sigma_w3, s.sigma_w4, p.*, {LAT.replace('radians(ra', 'radians(s.ra').replace('radians(dec', 'radians(s.dec')} AS lat, coalesce(n, 0) AS nb FROM fx_signals s JOIN fx_photometry p USING (target_id) LEFT JOIN nb USING (target_id)),
    l AS (SELECT target_id, list_reverse_sort(list_filter([CASE WHEN W1 - W2 > 0.8 THEN 0.8 WHEN W1 - W2 > 0.3 THEN 0.3 END, CASE WHEN W2 - W3 > 2 THEN 0.5 END, CASE WHEN W3 - W4 > 1.5 THEN 0.4 END, CASE WHEN ext_flg > 0 THEN 0.7 END, CASE WHEN nb > 0 THEN least(0.6, 0.3*nb) END, CASE WHEN abs(lat) < 10 THEN 0.3 END, CASE WHEN sigma_w4 > 3 AND (sigma_w3 IS NULL OR sigma_w3 < 2) THEN 0.6 END]::DOUBLE[], lambda x: x IS NOT NULL)) AS c FROM c)
    SELECT target_id, round(CASE WHEN len(c) = 0 THEN 0 ELSE least(1, c[1] + 0.3*coalesce(list_sum(c[2:]), 0)) END, 6)::DOUBLE AS score FROM l""")
def _(t):
    near = count_within(t.signals.select("target_id", "ra", "dec"), t.shifted.select("ra", "dec"), 2.5 * ARCSEC, left_key="target_id", name="n_beam").select("target_id", "n_beam")
    df = t.signals.select("target_id", "ra", "dec", "sigma_w3", "sigma_w4").join(t.photometry.select("target_id", "W1", "W2", "W3", "W4", "ext_flg"), "target_id").join(near, "target_id")
    return df.select("target_id", r6(V.galaxy_contamination(), "score"))


def _w(*rules):
    return "greatest(0, " + ", ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for c, v in rules) + ")"


def _in(words, c="upper(coalesce(otype, ''))"):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_IR = _w(("sigma_w4 > 3 AND (sigma_w3 IS NULL OR sigma_w3 < 2)", 0.6), ("coalesce(sigma_w4 <= 3, true) AND sigma_w3 > 3 AND sigma_w3 < 5", 0.4), (f"abs({LAT}) < 10 AND sigma_w3 > 3", 0.5))
RISK_SQL = {
    "known_object_type": _w((_in(V.BINARY_TYPES), 0.8), (_in(V.YOUNG_TYPES), 0.7), (_in(V.VARIABLE_TYPES), 0.6), ("logg < 3 AND sigma_w3 > 5", 0.6), ("nss > 0", 0.8), ("teff < 3500 AND variability > 0.1", 0.5)),
    "ruwe_context": "CASE WHEN g < 6 THEN 0.6 WHEN bp_rp > 3 THEN 0.4 WHEN ruwe > 1.4 AND ruwe < 2 THEN 0.3 WHEN ruwe > 4 THEN 0.1 ELSE 0 END",
    "ir_excess_context": f"CASE WHEN sigma_w3 > 5 AND sigma_w4 > 5 THEN least(0.2, {_IR}) ELSE {_IR} END",
    "galactic_contamination": f"CASE WHEN abs({LAT}) < 5 THEN 0.7 WHEN abs({LAT}) < 15 THEN 0.4 WHEN abs({LAT}) < 30 THEN 0.15 ELSE 0 END",
    "photometric_reliability": _w(("n_obs < 20", 0.4), ("phot_excess > 1.5 OR phot_excess < 0.7", 0.5), ("multi_peak > 10", 0.6), ("g > 18", 0.4), ("g < 4", 0.5)),
    "pm_consistency": "CASE WHEN is_discrepant AND pm_sigma > 5 THEN 0.1 WHEN is_discrepant AND pm_sigma > 3 THEN 0.3 ELSE 0 END",
    "chance_alignment": "CASE WHEN chance_p > 0.01 THEN 0.5 WHEN chance_p > 0.001 THEN 0.3 ELSE 0 END",
    "single_channel": "CASE WHEN n_active <= 1 THEN 0.6 WHEN n_active = 2 AND pair_is_known THEN 0.4 WHEN n_active = 2 THEN 0.1 ELSE 0 END",
    "distance_bias": "CASE WHEN distance_pc < 3 THEN 0.5 WHEN distance_pc < 5 THEN 0.3 WHEN distance_pc > 100 THEN (CASE WHEN parallax > 0 AND parallax_error/parallax > 0.2 THEN 0.5 ELSE 0.3 END) ELSE 0 END",
    "convergence_quality": "CASE WHEN n_active < 2 THEN 0 ELSE greatest(0, (CASE verdict WHEN 'EXPLAINED' THEN 0.7 WHEN 'PARTIALLY_EXPLAINED' THEN 0.4 ELSE 0.1 END) - (CASE WHEN is_fdr THEN 0.1 ELSE 0 END)) END",
    "xray_activity": "CASE WHEN xray > 1e-12 THEN 0.8 WHEN xray > 1e-13 THEN 0.6 WHEN xray > 0 THEN 0.2 ELSE 0 END",
    "dust_extinction": "CASE WHEN distance_pc IS NULL THEN 0 WHEN ebv IS NULL THEN NULL WHEN ebv >= 0.3 THEN 0.6 WHEN ebv >= 0.05 THEN 0.3 WHEN ebv >= 0.01 THEN 0.1 ELSE 0 END",
    "binary_orbit": "CASE WHEN orbit_match THEN 0.9 ELSE 0 END",
    "object_catalog": "coalesce(object_risk, 0)",
}


def _risk_query(name, checks):
    @query(name, f"WITH {CASE_SQL} SELECT target_id, " + ", ".join(f"round({RISK_SQL[c]}, 6)::DOUBLE AS {c}" for c in checks) + " FROM cs")
    def _(t):
        r = V.risks()
        return cases(t).select("target_id", *[r6(r[c].cast("double"), c) for c in checks])


_risk_query("object_type_risk", ("known_object_type",))
_risk_query("astrometry_context_risk", ("ruwe_context",))
_risk_query("infrared_context_risk", ("ir_excess_context",))
_risk_query("crowding_risk", ("galactic_contamination",))
_risk_query("photometric_reliability_risk", ("photometric_reliability",))
_risk_query("statistical_risks", ("pm_consistency", "chance_alignment", "single_channel", "distance_bias", "convergence_quality"))
_risk_query("catalog_risks", ("xray_activity", "dust_extinction", "binary_orbit", "object_catalog"))

_LIST = ", ".join(f"({c})::DOUBLE" for c in RISK_SQL.values())
OVERALL_SQL = f"""{CASE_SQL}, rl AS (SELECT target_id, list_reverse_sort(list_filter([{_LIST}], lambda x: x IS NOT NULL)) AS r FROM cs), ov AS (SELECT target_id, r, least(1, 0.4*r[1] + 0.25*r[2] + 0.15*r[3] + 0.2*list_sum(r[4:])/(len(r) - 3)) AS risk FROM rl),
    lv AS (SELECT *, CASE WHEN r[1] >= 0.9 OR risk >= 0.75 THEN 'CRITICAL' WHEN risk >= 0.5 THEN 'HIGH' WHEN risk >= 0.3 THEN 'MODERATE' ELSE 'LOW' END AS risk_level FROM ov)"""


@query("overall_risk", f"WITH {OVERALL_SQL} SELECT target_id, round(risk, 6)::DOUBLE AS risk, risk_level, CASE risk_level WHEN 'CRITICAL' THEN 'DEMOTE' WHEN 'LOW' THEN 'ESCALATE' ELSE 'MONITOR' END AS recommendation, len(list_filter(r, lambda x: x > 0.5))::INT AS n_flags FROM lv")
def _(t):
    return V.overall_risk(cases(t)).select("target_id", r6("risk", "risk"), "risk_level", "recommendation", "n_flags")


@query("verdict_ordering", f"WITH {OVERALL_SQL} SELECT target_id, round(risk, 6)::DOUBLE AS risk FROM lv ORDER BY round(risk, 9), target_id LIMIT 50")
def _(t):
    return V.overall_risk(cases(t)).orderBy(F.round("risk", 9), "target_id").limit(50).select("target_id", r6("risk", "risk"))


_CRIT = ("n_real >= 2 AND n_simulated = 0", "n_active >= 2", "stouffer_p < 0.01", "unexplained > 0.3", "recommendation = 'ESCALATE'", "top_share <= 0.8", "distance_pc > 0 AND distance_pc <= 2000", "n_runs >= 2")
CERT_SQL = f"{CASE_SQL}, ce AS (SELECT target_id, " + " + ".join(f"coalesce({c}, false)::INT" for c in _CRIT) + " AS n_passed, " + " AND ".join(f"coalesce({c}, false)" for c in _CRIT[:-1]) + " AS needed FROM cs)"


@query("candidate_certificate", f"WITH {CERT_SQL} SELECT target_id, n_passed::INT AS n_passed, CASE WHEN n_passed = 8 THEN 'CERTIFIED' WHEN needed THEN 'PROVISIONAL' WHEN n_passed >= 6 THEN 'PARTIAL' ELSE 'FAIL' END AS grade FROM ce")
def _(t):
    return V.certificate(cases(t)).select("target_id", "n_passed", "grade")


_MAP = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.SCENARIO_CLASS.items())
_TIER = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CLASS_TIER.items())
_bp = ", ".join("'" + "|".join(sorted(p)) + "'" for p in V.BINARY_PATTERNS)
_dp = ", ".join("'" + "|".join(sorted(p)) + "'" for p in V.DISK_PATTERNS)
TAX_SQL = f"""a AS (SELECT target_id, count(*) FILTER (channel <> 'habitable_zone_planet' AND score > 0.7) AS n, bool_or(channel = 'habitable_zone_planet' AND coalesce(score, 0) > 0.7) AS hz, array_to_string(list_sort(list(channel) FILTER (channel <> 'habitable_zone_planet' AND score > 0.7)), '|') AS pat FROM fx_scores GROUP BY 1),
    r AS (SELECT target_id, template, CASE WHEN row_id % 3 = 0 THEN unexplainability END AS u, risk_text AS txt FROM fx_report_rows QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY report DESC, row_id) = 1),
    x AS (SELECT a.*, r.template, r.u, coalesce(lower(txt), '') AS txt FROM a JOIN r USING (target_id)),
    tx AS (SELECT target_id, CASE WHEN n = 0 THEN (CASE WHEN hz THEN 'HZ_PRIOR' ELSE 'GATHERED' END) WHEN n = 1 THEN 'SINGLE_CHANNEL' WHEN u >= 0.5 THEN 'UNEXPLAINED' WHEN u >= 0.2 THEN 'PARTIALLY_EXPLAINED' WHEN template IS NOT NULL AND template <> 'none' THEN coalesce(CASE template {_MAP} END, 'UNCLASSIFIED')
    WHEN pat IN ({_bp}) THEN 'BINARY' WHEN pat IN ({_dp}) THEN 'CIRCUMSTELLAR' WHEN contains(txt, 'binary') AND (contains(txt, 'explained') OR contains(txt, 'template')) THEN 'BINARY' WHEN contains(txt, 'yso') OR contains(txt, 'young stellar') THEN 'YSO' WHEN contains(txt, 'debris') OR contains(txt, 'circumstellar') OR contains(txt, 'disk') THEN 'CIRCUMSTELLAR' ELSE 'UNCLASSIFIED' END AS class FROM x)"""


@query("taxonomy", f"WITH {TAX_SQL}, o AS (SELECT target_id, 'UNCLASSIFIED' AS forced FROM fx_targets WHERE bp_rp > 4.5) SELECT target_id, coalesce(forced, class) AS class, CASE coalesce(forced, class) {_TIER} END AS tier FROM tx LEFT JOIN o USING (target_id)")
def _(t):
    p = source_patterns(t.scores, threshold=0.7).select("target_id", "active")
    prior = t.scores.filter("channel = 'habitable_zone_planet'").select("target_id", F.coalesce(F.col("score") > 0.7, F.lit(False)).alias("prior"))
    newest = t.report_rows.groupBy("target_id").agg(F.max(F.struct("report", (-F.col("row_id")).alias("r"), "template", F.when(F.col("row_id") % 3 == 0, F.col("unexplainability")).alias("u"), "risk_text")).alias("n")).select("target_id", "n.template", "n.u", "n.risk_text")
    df = p.join(prior, "target_id").join(newest, "target_id")
    df = df.withColumn("class", V.taxonomy(F.col("active"), F.col("prior"), F.col("template"), F.col("u"), F.col("risk_text")))
    forced = t.targets.filter("bp_rp > 4.5").select("target_id", F.lit("UNCLASSIFIED").alias("forced"))
    df = df.join(forced, "target_id", "left").withColumn("class", F.coalesce("forced", "class"))
    return df.select("target_id", "class", V.class_tier(F.col("class")).alias("tier"))


@query("natural_explanations", f"""WITH {CASE_SQL} SELECT target_id, CASE WHEN logg < 2 THEN 'agb_dust' WHEN cc_flags <> '0000' THEN 'galaxy_contamination' END AS resolved_by, (teff < 4000 AND logg < 3.5)::INT + coalesce(sigma_w4 > 3 AND (sigma_w3 IS NULL OR sigma_w3 < 3), false)::INT + (logg < 2)::INT + (cc_flags <> '0000')::INT + coalesce(variability > 0.05, false)::INT AS n_plausible FROM cs""")
def _(t):
    df = cases(t).withColumn("tests", V.natural_tests())
    hit = F.filter("tests", lambda x: (x["verdict"] == "plausible") & (x["confidence"] >= 0.8))
    return df.select("target_id", F.get(hit, F.lit(0))["name"].alias("resolved_by"), F.size(F.filter("tests", lambda x: x["verdict"] == "plausible")).alias("n_plausible"))


_SP = f"(SELECT source_id, ra, dec, {SPECTRA_EXPR} AS survey, (size*7 % 60)*1e0 AS rv, CASE WHEN size % 4 = 0 THEN 'K2III' WHEN size % 4 = 1 THEN 'G5V' WHEN size % 4 = 2 THEN 'Be' END AS sp, (size % 20)/8e0 - 1e0 AS fe_h FROM fx_shifted)"


@query("spectroscopic_follow_up", f"""WITH m AS (SELECT * FROM ({Q.cone('fx_targets', _SP, '4.5e0/3.6e3', 'target_id', 'a.target_id, b.source_id, b.survey, b.rv, b.sp, b.fe_h')}) QUALIFY row_number() OVER (PARTITION BY target_id, survey ORDER BY sep_deg, source_id) = 1), s AS (SELECT target_id, count(*) AS n, max(rv) - min(rv) > 10 AS var, arg_min(sp, survey) FILTER (sp IS NOT NULL) AS sp, arg_min(fe_h, survey) AS fe_h FROM m GROUP BY 1),
    a AS (SELECT target_id, coalesce(array_to_string(list_sort(list(channel) FILTER (channel <> 'habitable_zone_planet' AND score > 0.7)), '|'), '') AS pat FROM fx_scores GROUP BY 1)
    SELECT target_id, CASE WHEN s.n IS NULL THEN 'NEEDS_FOLLOWUP' WHEN var AND pat IN ('proper_motion_anomaly', 'ir_excess|proper_motion_anomaly') THEN 'SKIP' WHEN contains(lower(coalesce(sp, '')), 'ii') AND contains(pat, 'ir_excess') THEN 'SKIP' WHEN abs(fe_h) > 1 OR contains(lower(coalesce(sp, '')), 'e') THEN 'HIGH_PRIORITY' ELSE 'ARCHIVE_SUFFICIENT' END AS decision FROM a LEFT JOIN s USING (target_id)""")
def _(t):
    sp = t.shifted.selectExpr("source_id", "ra", "dec", f"{SPECTRA_EXPR} AS survey", "(size*7 % 60)*1e0 AS rv", "CASE WHEN size % 4 = 0 THEN 'K2III' WHEN size % 4 = 1 THEN 'G5V' WHEN size % 4 = 2 THEN 'Be' END AS sp", "(size % 20)/8e0 - 1e0 AS fe_h")
    near = nearest(t.targets.select("target_id", "ra", "dec"), sp, 4.5 * ARCSEC, left_key="target_id", right_key="source_id", by=["survey"])
    s = near.groupBy("target_id").agg(F.count("*").alias("n"), (F.max("r_rv") - F.min("r_rv") > 10).alias("var"), F.min_by("r_sp", F.when(F.col("r_sp").isNotNull(), F.col("r_survey"))).alias("sp"), F.min_by("r_fe_h", "r_survey").alias("fe_h"))
    df = source_patterns(t.scores, threshold=0.7).join(s, "target_id", "left")
    return df.select("target_id", V.follow_up(F.coalesce("n", F.lit(0)), F.col("var"), F.col("sp"), F.col("fe_h"), F.col("active")).alias("decision"))


def review_rows(t):
    """The cases with offsets to and counts of neighbouring catalog sources."""
    pos = t.targets.select("target_id", "ra", "dec")
    star = nearest(pos, t.shifted.select("source_id", "ra", "dec", "flux"), 4.5 * ARCSEC, left_key="target_id", right_key="source_id")
    star = star.select("target_id", (F.col("sep_deg") * 3600).alias("star_offset"), F.col("r_flux").alias("flux_low"))
    north = t.shifted.filter("survey = 'north'").select("source_id", "ra", "dec")
    radio = nearest(pos, north, 30.0 * ARCSEC, left_key="target_id", right_key="source_id").select("target_id", (F.col("sep_deg") * 3600).alias("radio_offset"))
    n = lambda cat, r, name: count_within(pos, cat, r * ARCSEC, left_key="target_id", name=name).select("target_id", name)
    out = cases(t)
    for part in (star, radio):
        out = out.join(part, "target_id", "left")
    for part in (n(t.shifted.select("ra", "dec"), 15.5, "n_ir_near"), n(t.pool.select("ra", "dec"), 3600.0, "n_stars_near"), n(north, 600.5, "n_radio_wide")):
        out = out.join(part, "target_id")
    return out.withColumn("spectrum_offset", F.col("star_offset"))


_C = lambda cat, r, z: f"SELECT target_id, count(*) AS n FROM ({Q.cone('fx_targets', cat, r, 'target_id', 'a.target_id', zone=z)}) GROUP BY 1"
REVIEW_CTE = f"""{CASE_SQL}, no AS (SELECT * FROM fx_shifted WHERE survey = 'north'), n1 AS ({near_sql('b.flux AS flux', 4.5)}), n2 AS ({near_sql('1', 30, right='no')}), c1 AS ({_C('fx_shifted', '15.5e0/3.6e3', 0.1)}), c2 AS ({_C('fx_pool', '1e0', 1)}), c3 AS ({_C('no', '600.5e0/3.6e3', 0.2)}),
    rv AS (SELECT cs.*, n1.sep_deg*3600 AS star_offset, n1.flux AS flux_low, n1.sep_deg*3600 AS spectrum_offset, n2.sep_deg*3600 AS radio_offset, coalesce(c1.n, 0) AS n_ir_near, coalesce(c2.n, 0) AS n_stars_near, coalesce(c3.n, 0) AS n_radio_wide, {LAT.replace('radians(ra', 'radians(cs.ra').replace('radians(dec', 'radians(cs.dec')} AS lat
    FROM cs LEFT JOIN n1 USING (target_id) LEFT JOIN n2 USING (target_id) LEFT JOIN c1 USING (target_id) LEFT JOIN c2 USING (target_id) LEFT JOIN c3 USING (target_id))"""
_i = lambda c: f"coalesce({c}, false)::INT"
_NF = f"(length(regexp_replace(ph_qual, '[^UX]', '', 'g')) + length(regexp_replace(cc_flags, '[0-]', '', 'g')) + {_i('ext_flg > 0')} + {_i('epochs_ir < 3')})"
_NA = f"({_i('ruwe > 1.4')} + {_i('aen_sig > 5')} + {_i('harmonic > 0.1')} + {_i('parallax/parallax_error < 5')} + {_i('n_params < 31')})"
_BI = f"(0.3*{_i('ruwe > 1.4')} + 0.15*{_i('aen > 2')} + 0.4*{_i('nss > 0')} + 0.1*{_i('abs(W1 - W3) > 0.5 AND abs(W1 - W2) > 0.3')})::DOUBLE"
_YO = f"(0.2*{_i('logg < 3.5')} + 0.2*{_i('abs(lat) < 10')} - 0.1*{_i('abs(lat) > 30')} + 0.3*{_i('W1 - W4 > 3')})::DOUBLE"
_PM = "exp(-(pow(pmra - wpmra, 2)/(pmra_error*pmra_error + wpmra_error*wpmra_error + 9) + pow(pmdec - wpmdec, 2)/(pmdec_error*pmdec_error + wpmdec_error*wpmdec_error + 9))/2)"
_SAT = " OR ".join(f"{b} < {x}" for b, x in V.SATURATION.items())
REVIEW_SQL = {
    "identity": {"A1": "CASE WHEN star_offset IS NOT NULL THEN 'CONFIRMED' ELSE 'REFUTED' END", "A2": "CASE WHEN star_offset IS NULL THEN 'INCONCLUSIVE' WHEN star_offset >= 2.5 THEN 'CHALLENGED' ELSE 'CONFIRMED' END",
                 "A3": "CASE WHEN W1 IS NULL THEN 'INCONCLUSIVE' WHEN abs(k_w1) > 0.3 OR regexp_matches(ph_qual, '[UXZ]') THEN 'CHALLENGED' ELSE 'CONFIRMED' END", "B5": "CASE WHEN Ks IS NULL OR W1 IS NULL THEN 'INCONCLUSIVE' WHEN abs(Ks - W1) > 0.5 THEN 'CHALLENGED' ELSE 'CONFIRMED' END"},
    "infrared": {"B1": f"CASE WHEN W1 IS NULL THEN 'INCONCLUSIVE' WHEN {_NF} > 2 THEN 'REFUTED' WHEN {_NF} > 0 THEN 'CHALLENGED' ELSE 'CONFIRMED' END", "B2": "CASE WHEN W3 IS NULL OR W1 IS NULL THEN 'INCONCLUSIVE' WHEN abs(W1 - W3)/greatest(coalesce(W3_err, 0.2e0), 0.05) > 3 THEN 'CONFIRMED' ELSE 'CHALLENGED' END",
                 "B3": "CASE WHEN n_ir_near > 1 THEN 'CHALLENGED' ELSE 'CONFIRMED' END", "B4": f"CASE WHEN W1 IS NULL THEN 'INCONCLUSIVE' WHEN {_SAT} THEN 'CHALLENGED' ELSE 'CONFIRMED' END",
                 "F1": "CASE WHEN sigma_w3 IS NULL AND sigma_w4 IS NULL THEN 'INCONCLUSIVE' WHEN sigma_w3 > 3 OR sigma_w4 > 3 THEN 'CONFIRMED' ELSE 'CHALLENGED' END", "F2": "CASE WHEN epochs_ir > 20 THEN 'CONFIRMED' ELSE 'INCONCLUSIVE' END", "F3": "'INCONCLUSIVE'"},
    "astrometry": {"C1": f"CASE WHEN {_NA} > 2 THEN 'REFUTED' WHEN {_NA} > 0 THEN 'CHALLENGED' ELSE 'CONFIRMED' END", "C2": f"CASE WHEN {_PM} < 0.05 THEN 'CONFIRMED' ELSE 'CHALLENGED' END",
                   "C3": "CASE WHEN W1 IS NULL THEN 'INCONCLUSIVE' WHEN W1 < 8 OR W1 > 16 OR wpmra_error > 10 THEN 'CHALLENGED' ELSE 'CONFIRMED' END", "C4": "CASE WHEN nss > 0 THEN 'REFUTED' ELSE 'CONFIRMED' END"},
    "radio": {"D1": "CASE WHEN flux_low IS NOT NULL OR dec < -40 THEN 'CONFIRMED' ELSE 'INCONCLUSIVE' END", "D2": "CASE WHEN radio_offset IS NULL THEN 'INCONCLUSIVE' WHEN radio_offset < 2 AND radio_snr < 5 THEN 'DETECTED' WHEN radio_offset < 2 THEN 'CONFIRMED' ELSE 'CHALLENGED' END",
              "D3": "CASE WHEN radio_offset IS NULL THEN 'INCONCLUSIVE' WHEN n_radio_wide/0.08726646259971647e0*pow(radio_offset/3600, 2)*pi() < 0.001 THEN 'CONFIRMED' ELSE 'CHALLENGED' END", "D4": "CASE WHEN radio_mjy IS NULL OR flux_low IS NULL OR radio_mjy <= 0 THEN 'INCONCLUSIVE' WHEN ln(radio_mjy/flux_low)/ln(3e0/1.4e0) < -1 THEN 'CHALLENGED' ELSE 'CONFIRMED' END"},
    "alternatives": {"E1": f"CASE WHEN {_BI} >= 0.5 THEN 'CHALLENGED' WHEN {_BI} >= 0.3 THEN 'INCONCLUSIVE' ELSE 'CONFIRMED' END", "E2": f"CASE WHEN {_YO} >= 0.4 THEN 'CHALLENGED' ELSE 'CONFIRMED' END", "E3": "CASE WHEN n_ir_near > 3 OR coalesce(otype IN ('QSO', 'GALAXY'), false) THEN 'CHALLENGED' ELSE 'CONFIRMED' END",
                     "E4": f"CASE WHEN otype IS NULL THEN 'INCONCLUSIVE' WHEN {_in(V.RISKY_TYPES, 'otype')} THEN 'REFUTED' ELSE 'CONFIRMED' END", "E5": "'INCONCLUSIVE'", "E6": "CASE WHEN xray > 0 THEN 'CHALLENGED' ELSE 'CONFIRMED' END", "E7": "CASE WHEN nuv IS NOT NULL THEN 'CONFIRMED' ELSE 'INCONCLUSIVE' END"},
    "environment": {"G1": "CASE WHEN abs(lat) < 5 THEN 'CHALLENGED' ELSE 'CONFIRMED' END", "G2": "CASE WHEN ebv IS NULL THEN 'INCONCLUSIVE' WHEN ebv > 0.5 THEN 'CHALLENGED' ELSE 'CONFIRMED' END", "G3": "CASE WHEN n_stars_near > 10 THEN 'CHALLENGED' ELSE 'CONFIRMED' END", "G4": "CASE WHEN n_ir_near > 2 THEN 'CHALLENGED' ELSE 'CONFIRMED' END",
                    "H1": "CASE WHEN spectrum_offset < 1.5 THEN 'REFUTED' ELSE 'CONFIRMED' END", "H2": "CASE WHEN teff IS NOT NULL THEN 'CONFIRMED' ELSE 'INCONCLUSIVE' END", "H3": "CASE WHEN dec < -31 THEN 'INCONCLUSIVE' ELSE 'CONFIRMED' END",
                    "H4": "CASE WHEN variability IS NULL THEN 'INCONCLUSIVE' WHEN variability > 0.19 THEN 'REFUTED' WHEN variability > 0.15 THEN 'CHALLENGED' ELSE 'CONFIRMED' END", "H5": "CASE WHEN coalesce(orbit_match, false) THEN 'REFUTED' ELSE 'CONFIRMED' END"},
}
_CRITICAL = ("A1", "B1", "B4", "C4", "E4")


def _review_query(name, group):
    rows = ", ".join(f"('{c}', {sql})" for c, sql in REVIEW_SQL[group].items())

    @query(name, f'WITH {REVIEW_CTE} SELECT target_id, u.c AS "check", u.v AS verdict FROM rv, LATERAL (VALUES {rows}) u(c, v)')
    def _(t):
        return V.review(review_rows(t), groups=(group,)).select("target_id", "check", "verdict")


_review_query("review_identity", "identity")
_review_query("review_infrared", "infrared")
_review_query("review_astrometry", "astrometry")
_review_query("review_radio", "radio")
_review_query("review_alternatives", "alternatives")
_review_query("review_environment", "environment")

_ALL = ", ".join(f"('{c}', {sql}, {str(c in _CRITICAL).lower()})" for g in REVIEW_SQL.values() for c, sql in g.items())


@query("review_verdict", f"""WITH {REVIEW_CTE}, a AS (SELECT target_id, u.* FROM rv, LATERAL (VALUES {_ALL}) u(c, v, crit)), s AS (SELECT target_id, count(*) AS n, count(*) FILTER (v = 'REFUTED') AS bad, count(*) FILTER (v = 'REFUTED' AND crit) AS crit, count(*) FILTER (v = 'CHALLENGED') AS ch, count(*) FILTER (v = 'CONFIRMED') AS ok FROM a GROUP BY 1)
    SELECT target_id, bad AS refuted, ch AS challenged, ok AS confirmed, CASE WHEN crit > 0 THEN 'REJECTED' WHEN bad > 0 OR ch > 3 THEN 'WEAKENED' ELSE 'SURVIVES' END AS overall, round(CASE WHEN crit > 0 THEN 0.9 WHEN bad > 0 THEN 0.6 WHEN ch > 3 THEN 0.5 ELSE ok/n END, 6)::DOUBLE AS confidence FROM s""")
def _(t):
    return V.review_verdict(V.review(review_rows(t))).select("target_id", "refuted", "challenged", "confirmed", "overall", r6("confidence", "confidence"))


@query("display_unexplained", """WITH a AS (SELECT target_id, count(*) FILTER (score > 0.6) AS n, bool_or(channel = 'ir_excess' AND coalesce(score, 0) > 0.6) AS ir, bool_or(channel = 'proper_motion_anomaly' AND coalesce(score, 0) > 0.6) AS pm, bool_or(channel = 'hr_anomaly' AND coalesce(score, 0) > 0.6) AS hr, bool_or(channel = 'uv_anomaly' AND coalesce(score, 0) > 0.6) AS uv, bool_or(channel IN ('radio_anomaly', 'radio_emission') AND coalesce(score, 0) > 0.6) AS rd, bool_or(channel = 'gaia_photometric_anomaly' AND coalesce(score, 0) > 0.6) AS ph FROM fx_scores WHERE channel <> 'habitable_zone_planet' GROUP BY 1)
    SELECT target_id, (CASE WHEN n = 0 THEN v.unexplained ELSE least(v.unexplained, CASE WHEN n = 1 THEN (CASE WHEN ir THEN 0.2 ELSE 0.1 END) WHEN pm AND hr AND NOT ir AND NOT rd THEN 0.05 WHEN pm AND uv AND hr AND NOT ir THEN 0.05 WHEN pm AND ph AND NOT ir AND NOT rd THEN 0.08 WHEN n = 2 AND NOT ir THEN 0.15 WHEN ir AND pm AND n = 2 THEN (CASE WHEN s.ruwe > 4 THEN 0.15 ELSE 0.35 END) WHEN ir AND pm AND hr AND NOT rd AND NOT uv THEN 0.15
    WHEN ir AND rd THEN (CASE WHEN n >= 3 THEN 0.85 ELSE 0.7 END) WHEN ir AND pm AND uv THEN 0.75 WHEN ir AND n >= 3 THEN 0.6 WHEN n >= 3 THEN 0.45 ELSE 0.25 END) END)::DOUBLE AS unexplained FROM a JOIN fx_verdicts v USING (target_id) JOIN fx_signals s USING (target_id)""")
def _(t):
    df = source_patterns(t.scores, threshold=0.6).select("target_id", "active").join(t.verdicts.select("target_id", "unexplained"), "target_id").join(t.signals.select("target_id", "ruwe"), "target_id")
    return df.select("target_id", V.display_unexplained(F.col("active"), F.col("ruwe"), F.col("unexplained")).alias("unexplained"))


TIER_ORDER = {"A": 0, "D": 1, "B": 2, "C": 3}
_TIER_SQL = "CASE WHEN n_active >= 4 THEN 'A' WHEN is_fdr THEN 'B' WHEN n_active >= 2 THEN 'C' ELSE 'D' END"


@query("tiered_targets", f"SELECT row_id, {_TIER_SQL} AS tier FROM fx_report_rows ORDER BY CASE {_TIER_SQL} WHEN 'A' THEN 0 WHEN 'D' THEN 1 WHEN 'B' THEN 2 ELSE 3 END, n_active DESC, ruwe, row_id LIMIT 100")
def _(t):
    tier = F.when(F.col("n_active") >= 4, "A").when(F.col("is_fdr"), "B").when(F.col("n_active") >= 2, "C").otherwise("D")
    order = F.element_at(F.create_map(*[F.lit(x) for kv in TIER_ORDER.items() for x in kv]), F.col("tier"))
    return t.report_rows.withColumn("tier", tier).orderBy(order, F.desc("n_active"), "ruwe", "row_id").limit(100).select("row_id", "tier")


@query("top_events", "SELECT event_id, energy_gev FROM fx_neutrinos ORDER BY energy_gev DESC, event_id LIMIT 500")
def _(t):
    return t.neutrinos.orderBy(F.desc("energy_gev"), "event_id").limit(500).select("event_id", "energy_gev")


#: The place is the order in which zones are shown: most signals first, then the highest score.
@query("convergence_zones", "WITH c AS (SELECT target_id, count(*) FILTER (score > 0.6) AS n FROM fx_scores GROUP BY 1), "
       + ", ".join(f"m_{m} AS (SELECT DISTINCT target_id FROM ({Q.cone('fx_targets', src, f'{MESSENGER_RADII[m]}e0', 'target_id', 'a.target_id', zone=1.5)}))" for m, src in NEAR.items())
       + ", z AS (SELECT target_id, n + " + " + ".join(f"(target_id IN (SELECT target_id FROM m_{m}))::INT" for m in NEAR) + " AS n_signals FROM c), "
       + f"sc AS ({ORACLES['convergence_score']}), ux AS ({ORACLES['unexplainability']}), rk AS ({ORACLES['overall_risk']}), "
       + """y AS (SELECT z.target_id, n_signals::BIGINT AS n_signals, total_score, coalesce(unexplained < 0.2, false) OR coalesce(risk_level IN ('HIGH', 'CRITICAL'), false) AS is_explained
           FROM z LEFT JOIN sc USING (target_id) LEFT JOIN ux USING (target_id) LEFT JOIN rk USING (target_id) WHERE n_signals >= 2)
       SELECT *, row_number() OVER (ORDER BY n_signals DESC, coalesce(total_score, 0) DESC, target_id) AS place FROM y""")
def _(t):
    active = t.scores.filter("score > 0.6").groupBy("target_id").agg(F.collect_set("channel").alias("signals"))  # at most one entry per channel
    out = t.scores.select("target_id").distinct().join(active, "target_id", "left").withColumn("signals", F.coalesce("signals", F.array().cast("array<string>")))
    for name, df in messengers(t).items():
        near = pairs(t.targets.select("target_id", "ra", "dec"), df.select("ra", "dec"), MESSENGER_RADII[name], cell=1.5).select("target_id").distinct().withColumn("hit", F.lit(name))
        out = out.join(near, "target_id", "left").withColumn("signals", F.array_union("signals", F.array_compact(F.array("hit")))).drop("hit")
    zones = out.filter(F.size("signals") >= 2).select("target_id", F.size("signals").cast("bigint").alias("n_signals"))
    for name, column in (("convergence_score", "total_score"), ("unexplainability", "unexplained"), ("overall_risk", "risk_level")):
        zones = zones.join(QUERIES[name](t).select("target_id", column), "target_id", "left")
    explained = F.coalesce(F.col("unexplained") < 0.2, F.lit(False)) | F.coalesce(F.col("risk_level").isin("HIGH", "CRITICAL"), F.lit(False))
    zones = zones.select("target_id", "n_signals", "total_score", explained.alias("is_explained"))
    order = (F.col("n_signals").desc(), F.coalesce("total_score", F.lit(0.0)).desc(), F.col("target_id"))
    return ranked(zones, [], order, rank="place", size=None)
