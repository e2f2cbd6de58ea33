"""Detectors over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions import numeric as N
from skysift.functions import photometry as P
from skysift.operators import detectors as D
from skysift.operators import timeseries as T
from skysift.operators.associations import epoch_changes
from skysift.operators.dedoppler import drift_search, merge_hits
from skysift.operators.forest import isolation_scores
from skysift.operators.skyjoin import ARCSEC
from skysift.operators.stats import benjamini_hochberg
from skysift.plans import sqltext as Q
from skysift.plans.matches import CHANGES_SQL, FLUX_CORRECTION
from skysift.plans.populations import bh_sql
from skysift.plans.registry import query
from skysift.plans.scalars import MS_POLY, RIDGE_SQL
from skysift.plans.series import PASS_SQL, HALF_SQL, mono_sql, trend_sql


def r6(c, name):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name)


_FIT = ", ".join(f"('{b}', \"{b}\", {D.MICRON[b]!r}::DOUBLE*1e-6, {P.ZERO_POINT_JY[b]!r}::DOUBLE, {P.DEFAULT_MAG_ERROR[b]!r}::DOUBLE)" for b in D.FIT_BANDS)
_HC, _HCK = 2 * P.PLANCK * P.LIGHT, P.PLANCK * P.LIGHT / P.BOLTZMANN


def _b(w, teff):
    return f"({_HC!r}::DOUBLE/({w}*{w}*{w})/(exp(least({_HCK!r}::DOUBLE/({w}*{teff}), 500e0)) - 1)*1e12)"


_TEFFS = ", ".join(f"({x!r}::DOUBLE)" for x in D.COARSE)
_RATIOS = ", ".join(f"({x!r}::DOUBLE)" for x in D.FINE)
SHIFT_SQL = f"3600*{Q.flat('w1_ra', 'w1_dec', 'coalesce(CASE WHEN w3_dec IS NOT NULL THEN w3_ra END, CASE WHEN w4_dec IS NOT NULL THEN w4_ra END)', 'coalesce(w3_dec, w4_dec)')}"


@query("infrared_excess", f"""WITH f AS (SELECT target_id, u.w, u.zp*pow(10e0, -0.4e0*u.mag) AS flux, u.zp*pow(10e0, -0.4e0*u.mag)*sqrt(pow(u.err*0.4e0*ln(10e0), 2) + 4e-4) AS err FROM fx_photometry, LATERAL (VALUES {_FIT}) u(band, mag, w, zp, err) WHERE u.mag IS NOT NULL),
    c AS (SELECT target_id, t, count(*) AS n, sum(flux*flux/(err*err)) - pow(sum(flux*{_b('w', 't')}/(err*err)), 2)/sum(pow({_b('w', 't')}/err, 2)) AS chi2 FROM f, (VALUES {_TEFFS}) g(t) GROUP BY 1, 2), c1 AS (SELECT target_id, arg_min(t, chi2) AS t0 FROM c GROUP BY 1),
    d AS (SELECT target_id, least(60000e0, greatest(2000e0, t0*r)) AS t FROM c1, (VALUES {_RATIOS}) g(r)), e AS (SELECT target_id, t, count(*) AS n, sum(flux*flux/(err*err)) - pow(sum(flux*{_b('w', 't')}/(err*err)), 2)/sum(pow({_b('w', 't')}/err, 2)) AS chi2, sum(flux*{_b('w', 't')}/(err*err))/sum(pow({_b('w', 't')}/err, 2)) AS sc FROM f JOIN (SELECT DISTINCT * FROM d) d USING (target_id) GROUP BY 1, 2),
    b AS (SELECT target_id, arg_min(t, chi2) AS t, min(chi2) AS chi2, arg_min(sc, chi2) AS sc, max(n) AS n FROM e GROUP BY 1), x AS (SELECT p.*, b.t, b.n, b.chi2/greatest(n - 2, 1) AS chi2_red, W3 + 2.5e0*log10(sc*{_b('11.561e-6', 't')}/31.674e0) AS x3, W4 + 2.5e0*log10(sc*{_b('22.088e-6', 't')}/8.363e0) AS x4, {SHIFT_SQL} AS shift FROM fx_photometry p JOIN b USING (target_id)),
    s AS (SELECT *, abs(x3)/sqrt(pow(coalesce(W3_err, 0.15e0), 2) + pow(0.054e0, 2)) AS s3, abs(x4)/sqrt(pow(coalesce(W4_err, 0.3e0), 2) + pow(0.054e0, 2)) AS s4 FROM x)
    SELECT target_id, n::INT AS n_bands, round(t, 4) AS teff_fit, round(x3, 5) AS excess_w3, round(s4, 4) AS sigma_w4, (coalesce(x3 < 0 AND s3 >= 3, false) OR coalesce(x4 < 0 AND s4 >= 3, false)) AND chi2_red <= 25 AND coalesce(J, H, Ks) IS NOT NULL AND substr(cc_flags, 3, 2) = '00' AND ext_flg = 0 AND coalesce(shift < 3, true) AS is_candidate FROM s""")
def _(t):
    df = D.infrared_excess(t.photometry)
    return df.select("target_id", "n_bands", F.round("teff_fit", 4).alias("teff_fit"), F.round("excess_W3", 5).alias("excess_w3"), F.round("sigma_W4", 4).alias("sigma_w4"), "is_candidate")


@query("centroid_shift", f"SELECT target_id, round({SHIFT_SQL}, 4) AS shift_arcsec, CASE WHEN {SHIFT_SQL} >= 3 THEN 'contaminated' WHEN {SHIFT_SQL} >= 2 THEN 'warning' ELSE 'clean' END AS verdict FROM fx_photometry")
def _(t):
    s = D.centroid_shift()
    return t.photometry.select("target_id", F.round(s, 4).alias("shift_arcsec"), F.when(s >= 3, "contaminated").when(s >= 2, "warning").otherwise("clean").alias("verdict"))


@query("infrared_variability", f"""WITH sp AS (SELECT target_id, count(*) AS n FROM fx_ir_epochs GROUP BY 1 HAVING count(*) >= 15 AND (max(mjd) - min(mjd))/365.25 >= 3), {PASS_SQL}, {trend_sql('fx_ir_epochs', 'w1', 'w1_err', 'a1')}, {trend_sql('fx_ir_epochs', 'w2', 'w2_err', 'a2')}, {mono_sql('w1', 'm1')}, {mono_sql('w2', 'm2')},
    pk AS (SELECT target_id FROM passes GROUP BY 1 HAVING count(*) >= 6), pk2 AS (SELECT target_id FROM passes GROUP BY 1 HAVING count(*) >= 6 AND count(w2) >= 6), q1 AS (SELECT * FROM passes WHERE target_id IN (SELECT target_id FROM pk)), q2 AS (SELECT * FROM passes WHERE target_id IN (SELECT target_id FROM pk2)), {trend_sql('q1', 'w1', 'w1_err', 'b1')}, {trend_sql('q2', 'w2', 'w2_err', 'b2')},
    ex AS (SELECT target_id, stddev_pop(w1)/median(w1_err) - 1 AS e1, CASE WHEN count(w2) >= 15 THEN stddev_pop(w2)/median(w2_err) - 1 ELSE 0 END AS e2 FROM fx_ir_epochs GROUP BY 1), cc AS (SELECT target_id, epoch_id, mjd, w1 - w2 AS c FROM fx_ir_epochs WHERE w2 IS NOT NULL), hh AS ({HALF_SQL.format(v='c', src='cc')}), co AS (SELECT target_id, median(v) FILTER (late) - median(v) FILTER (NOT late) AS shift, count(*) AS n FROM hh GROUP BY 1),
    j AS (SELECT sp.target_id, sp.n, greatest(abs(a1.sigma), coalesce(abs(b1.sigma), 0)) AS s1, greatest(abs(a2.sigma), coalesce(abs(b2.sigma), 0)) AS s2, a1.slope AS l1, a2.slope AS l2, abs(a1.sigma) > 2 AND abs(a2.sigma) > 2 AND sign(a1.slope) = sign(a2.slope) AS cons, greatest(coalesce(m1.mono, 0), coalesce(m2.mono, 0)) AS mono, greatest(e1, e2, 0) AS ex, coalesce(abs(co.shift) > 0.02 AND co.n >= 15, false) AS col
    FROM sp JOIN a1 USING (target_id) JOIN a2 USING (target_id) LEFT JOIN b1 USING (target_id) LEFT JOIN b2 USING (target_id) LEFT JOIN m1 USING (target_id) LEFT JOIN m2 USING (target_id) JOIN ex USING (target_id) LEFT JOIN co USING (target_id)),
    k AS (SELECT *, greatest(s1, s2) AS s, (l1 < 0 AND s1 > 3) OR (l2 < 0 AND s2 > 3 AND cons) AS br FROM j), v AS (SELECT *, greatest(0.4*least(1, greatest(0, ex/10)) + 0.6*least(1, greatest(0, s/10)), CASE WHEN s > 3 THEN least(1, least(1, s/10)*(CASE WHEN mono > 0.8 THEN 1.5 ELSE 1 END)*(CASE WHEN cons THEN 1.3 ELSE 1 END)*(CASE WHEN br THEN 1.2 ELSE 1 END)*(CASE WHEN col THEN 1.2 ELSE 1 END)) ELSE 0 END) AS score FROM k)
    SELECT target_id, n, round(ex, 5) AS excess, round(s, 4) AS sigma, br AS is_brightening, round(score, 5) AS score, score > 0.3 AND (ex > 3 OR s > 5) AS is_anomalous FROM v""")
def _(t):
    df = D.infrared_variability(t.ir_epochs)
    return df.select("target_id", "n", F.round(F.greatest("excess", F.lit(0.0)), 5).alias("excess"), F.round("sigma", 4).alias("sigma"), "is_brightening", F.round("score", 5).alias("score"), "is_anomalous")


UV_SCORE_SQL = """CASE WHEN nuv IS NULL THEN NULL WHEN NOT uv_clean THEN 0 ELSE coalesce(greatest(CASE WHEN fuv - nuv < 0.5 THEN least(1, (0.5 - (fuv - nuv))/2) WHEN fuv - nuv > 4 THEN least(1, (fuv - nuv - 4)/3) END,
    CASE WHEN nuv - (g + 1.5 + 2*bp_rp) > 2 THEN least(1, (nuv - (g + 1.5 + 2*bp_rp) - 2)/3) WHEN nuv - (g + 1.5 + 2*bp_rp) < -2 THEN least(1, (-(nuv - (g + 1.5 + 2*bp_rp)) - 2)/3) END), 0) END"""
RADIO_SCORE_SQL = """CASE WHEN radio_mjy IS NULL THEN NULL WHEN radio_mjy >= 1 AND radio_sep <= 10 THEN least(1, greatest(0, 0.6*(1 - exp(-radio_mjy/5)) + 0.3*least(1, radio_snr/10) + 0.1*(1 - radio_sep/10))) ELSE 0 END"""
HR_SQL = f"""a AS (SELECT target_id, bp_rp, mh, g + 5*log10(CASE WHEN parallax > 0 THEN parallax END) - 10 AS m FROM fx_signals), b AS (SELECT *, (m - {RIDGE_SQL})/0.75 AS s FROM a)"""
HR_SCORE_SQL = """CASE WHEN s IS NULL THEN NULL ELSE (CASE WHEN (m > 10 AND bp_rp < 1.5) OR (m < 3 AND bp_rp > 0.8) OR abs(s) < 1.5 THEN 0 ELSE 1 - exp(-(abs(s) - 1.5)/2) END)*(CASE WHEN s > 1.5 AND mh < -0.5 THEN 0.5 ELSE 1 END) END"""


@query("uv_anomaly", f"""SELECT target_id, round({UV_SCORE_SQL}, 6)::DOUBLE AS uv_score, coalesce(fuv - nuv < 1, false) AND nuv IS NOT NULL AS uv_active FROM fx_signals""")
def _(t):
    s = D.uv_score()
    return t.signals.select("target_id", r6(s["uv_score"], "uv_score"), s["uv_active"].alias("uv_active"))


@query("radio_emission", f"""SELECT target_id, round({RADIO_SCORE_SQL}, 6)::DOUBLE AS score,
    round(CASE WHEN radio_mjy >= 1 AND radio_sep <= 10 THEN radio_mjy*distance_pc*distance_pc END, 4) AS luminosity_proxy FROM fx_signals""")
def _(t):
    seen = (F.col("radio_mjy") >= 1) & (F.col("radio_sep") <= 10)
    return t.signals.select("target_id", r6(D.radio_score("radio_mjy", "radio_snr", "radio_sep"), "score"), F.round(F.when(seen, F.col("radio_mjy") * F.col("distance_pc") * F.col("distance_pc")), 4).alias("luminosity_proxy"))


@query("hr_outlier_ridge", f"""WITH {HR_SQL}
    SELECT target_id, round(s, 6) AS ms_sigma, round({HR_SCORE_SQL}, 6)::DOUBLE AS hr_score FROM b""")
def _(t):
    return D.ridge_outlier(t.signals).select("target_id", r6("ms_sigma", "ms_sigma"), r6("hr_score", "hr_score"))


@query("hr_outlier_polynomial", f"""WITH a AS (SELECT *, g + 5*log10(parallax) - 10 AS m FROM fx_signals WHERE parallax > 0 AND bp_rp BETWEEN -0.5 AND 5), b AS (SELECT *, abs(m - {MS_POLY})/(0.4e0 + 0.1e0*abs(bp_rp)) AS s, bp_rp >= 0.8e0 AND m < -2 + 2.5e0*bp_rp + 1 AS giant FROM a)
    SELECT target_id, round(s, 6) AS deviation_sigma, CASE WHEN s <= 3 OR giant THEN 'normal' WHEN ruwe > 1.4 AND s > 5 THEN 'wrong_color' WHEN m < {MS_POLY} THEN 'too_bright' ELSE 'too_dim' END AS kind FROM b""")
def _(t):
    return D.polynomial_outlier(t.signals).select("target_id", r6("deviation_sigma", "deviation_sigma"), "kind")


PM_SQL = f"""pm0 AS (SELECT *, sqrt(pmra*pmra + pmdec*pmdec) AS tot, greatest(3, CASE WHEN g > 15 THEN 3*pow(10e0, 0.3*(g - 15)) ELSE 3 END, 0.05*sqrt(pmra*pmra + pmdec*pmdec)) AS fl FROM fx_signals),
    pm1 AS (SELECT *, pow(pmra - wpmra, 2)/(pow(greatest(pmra_error, 0.02), 2) + pow(greatest(wpmra_error, fl), 2)) + pow(pmdec - wpmdec, 2)/(pow(greatest(pmdec_error, 0.02), 2) + pow(greatest(wpmdec_error, fl), 2)) AS c, tot > 50 AND sqrt(pow(pmra - wpmra, 2) + pow(pmdec - wpmdec, 2)) > 0.3*tot AS sys FROM pm0),
    pm2 AS (SELECT *, CASE WHEN sys THEN 0e0 ELSE c END AS chi2 FROM pm1), pm3 AS (SELECT *, exp(-chi2/2) AS pm_p, exp(-chi2/2)/2 AS hp FROM pm2), pm4 AS (SELECT *, least(50, CASE WHEN pm_p >= 1 THEN 0 ELSE greatest(0, {Q.normal_tail_inverse('hp')}) END) AS pm_sigma FROM pm3)"""


@query("motion_consistency", f"WITH {PM_SQL} SELECT target_id, round(chi2, 6) AS chi2, round(pm_p, 6) AS pm_p, round(pm_sigma, 5)::DOUBLE AS pm_sigma, sys AS is_systematic, chi2 > 13.82 AS is_discrepant FROM pm4")
def _(t):
    return D.motion_consistency(t.signals).select("target_id", r6("chi2", "chi2"), r6("pm_p", "pm_p"), F.round("pm_sigma", 5).alias("pm_sigma"), "is_systematic", "is_discrepant")


_AB = ", ".join(f"('{a[0]}', {a[0]}, {a[1]!r}::DOUBLE, {a[2]!r}::DOUBLE, {a[3]!r}::DOUBLE, {'NULL' if a[4] is None else repr(a[4])}::DOUBLE, {a[5]!r}::DOUBLE)" for a in D.ABUNDANCES)


ABUNDANCE_SQL = f"""v AS (SELECT target_id, u.ratio, CASE WHEN u.v > u.ab THEN (u.v - u.ab)/greatest(u.hi - u.lo, 0.01)*u.w WHEN u.v < u.be THEN (u.be - u.v)/greatest(u.hi - u.lo, 0.01)*u.w END AS off FROM fx_signals, LATERAL (VALUES {_AB}) u(ratio, v, lo, hi, ab, be, w) WHERE u.v IS NOT NULL),
    g AS (SELECT target_id, count(*) AS n_checked, count(off) AS k, coalesce(max(off), 0) AS worst FROM v GROUP BY 1)"""
ABUNDANCE_SCORE_SQL = """CASE WHEN k = 0 THEN 0 ELSE least(1, least(1, 0.3 + 0.1*worst)*(1 + 0.2*(k - 1))) END"""


def abundance_rows(t):
    items = F.explode(F.array(*[F.struct(F.lit(a[0]).alias("ratio"), F.col(a[0]).cast("double").alias("value")) for a in D.ABUNDANCES]))
    return t.signals.select("target_id", items.alias("x")).select("target_id", "x.ratio", "x.value").filter("value IS NOT NULL")


@query("abundance_outliers", f"""WITH {ABUNDANCE_SQL} SELECT target_id, n_checked, k AS n_flagged, round({ABUNDANCE_SCORE_SQL}, 6)::DOUBLE AS score, (CASE WHEN k = 0 THEN 1 WHEN k = 1 THEN 0.05 WHEN k = 2 THEN 0.0025 ELSE round(pow(0.001e0, least(k - 2, 3)), 12) END)::DOUBLE AS p FROM g""")
def _(t):
    return D.abundance_outliers(abundance_rows(t)).select("target_id", "n_checked", "n_flagged", r6("score", "score"), F.round("p", 12).alias("p"))


@query("vanished_source_class", f"""WITH {trend_sql('fx_ir_epochs', 'w1', 'w1_err', 'a1')}, {trend_sql('fx_ir_epochs', 'w2', 'w2_err', 'a2')}, ex AS (SELECT target_id, stddev_pop(w1)/median(w1_err) - 1 AS scatter, count(*) AS n FROM fx_ir_epochs GROUP BY 1),
    x AS (SELECT s.target_id, coalesce(ex.n >= 60, false) AS seen, CASE WHEN ex.n >= 60 THEN 'real' WHEN ex.n IS NOT NULL THEN 'insufficient' ELSE 'none' END AS src, coalesce(a1.sigma, 0) AS s1, coalesce(a2.sigma, 0) AS s2, ex.scatter, s.radio_mjy IS NOT NULL AND s.radio_mjy > 3 AS radio, p.W3 IS NOT NULL AS wise, p.W1 - p.W3 AS w13 FROM fx_signals s JOIN fx_photometry p USING (target_id) LEFT JOIN ex USING (target_id) LEFT JOIN a1 USING (target_id) LEFT JOIN a2 USING (target_id)),
    y AS (SELECT *, seen AND (s1 < -5 OR s2 < -5) AS br FROM x), z AS (SELECT *, least(1, 0.3*seen::INT + CASE WHEN br THEN least(0.3, 0.1*greatest(abs(s1), abs(s2))/5) WHEN seen AND abs(s1) < 1 THEN 0.05 ELSE 0 END + 0.1*coalesce(seen AND scatter > 3, false)::INT + 0.1*wise::INT + 0.05*coalesce(wise AND w13 > 2, false)::INT + 0.05*radio::INT + 0.05*(radio AND seen)::INT) AS score FROM y)
    SELECT target_id, round(score, 5)::DOUBLE AS score, CASE WHEN seen AND greatest(s1, s2) > 5 THEN 'FADING_SOURCE' WHEN seen AND br THEN 'BRIGHTENING_IR' WHEN seen AND NOT radio AND score > 0.4 THEN 'DYSON_CANDIDATE' WHEN seen AND radio THEN 'AGN_LIKELY' WHEN seen THEN 'PERSISTENT_IR' WHEN src = 'none' AND radio THEN 'RADIO_ONLY' WHEN src = 'none' THEN 'NO_DETECTION' ELSE 'INSUFFICIENT_DATA' END AS source_class FROM z""")
def _(t):
    from skysift.operators.ordered import quantiles
    e = t.ir_epochs
    err = quantiles(e, ["target_id"], "w1_err", {"_e": 0.5})
    ex = e.groupBy("target_id").agg(F.stddev_pop("w1").alias("_sd"), F.count("*").alias("n")).join(err, "target_id").select("target_id", (F.col("_sd") / F.col("_e") - 1).alias("scatter"), "n")
    base = t.signals.select("target_id", F.coalesce(F.col("radio_mjy") > 3, F.lit(False)).alias("radio_seen"))
    df = base.join(t.photometry.select("target_id", F.col("W3").isNotNull().alias("wise_seen"), (F.col("W1") - F.col("W3")).alias("w1_w3")), "target_id").join(ex, "target_id", "left")
    for b in ("w1", "w2"):
        df = df.join(T.weighted_trend(e, "target_id", "mjd", b, f"{b}_err", b), "target_id", "left").withColumn(f"{b}_sigma", F.coalesce(f"{b}_sigma", F.lit(0.0)))
    df = df.withColumn("ir_seen", F.coalesce(F.col("n") >= 60, F.lit(False))).withColumn("ir_source", F.when(F.col("n") >= 60, "real").when(F.col("n").isNotNull(), "insufficient").otherwise("none"))
    return D.vanished_class(df).select("target_id", F.round("score", 5).alias("score"), "source_class")


@query("flux_changes", f"WITH {CHANGES_SQL} SELECT id, change_type, round(flux_ratio, 6) AS flux_ratio, round(sigma_change, 5) AS sigma_change FROM changes")
def _(t):
    return epoch_changes(t.epoch1, t.epoch2, 15.5 * ARCSEC, FLUX_CORRECTION).select("id", "change_type", r6("flux_ratio", "flux_ratio"), F.round("sigma_change", 5).alias("sigma_change"))


def _profile_sql(key, src, name):
    return f"{name}_p AS (SELECT {key}, median(power) AS m FROM {src} GROUP BY 1), {name}_g AS (SELECT median(m) AS g, stddev_pop(m) AS sd FROM {name}_p), {name}_n AS (SELECT g, CASE WHEN (SELECT median(abs(m - g)) FROM {name}_p, {name}_g) > 0 THEN 1.4826*(SELECT median(abs(m - g)) FROM {name}_p, {name}_g) ELSE sd END AS s FROM {name}_g), {name} AS (SELECT {key}, m > g + 3*s AS loud FROM {name}_p, {name}_n)"


_KNOWN = " OR ".join(f"freq_mhz BETWEEN {lo!r} AND {hi!r}" for lo, hi in D.KNOWN_BANDS)
def mask_sql(source: str) -> str:
    return f"""{_profile_sql('t_idx', source, 'bb')}, cl AS (SELECT s.*, ({_KNOWN}) AS known, bb.loud AS broadband FROM {source} s JOIN bb USING (t_idx)), cc AS (SELECT * FROM cl WHERE NOT known AND NOT broadband), {_profile_sql('f_idx', 'cc', 'pe')},
    mask AS (SELECT cl.*, coalesce(pe.loud, false) AS persistent, known OR broadband OR coalesce(pe.loud, false) AS masked FROM cl LEFT JOIN pe USING (f_idx))"""


MASK_SQL = mask_sql("fx_spectrogram")


@query("interference_mask", f"WITH {MASK_SQL} SELECT f_idx, t_idx, known, broadband, persistent, masked FROM mask")
def _(t):
    return D.interference_mask(t.spectrogram, sigma=3.0).select("f_idx", "t_idx", "known", "broadband", "persistent", "masked")


DRIFT_SQL = f"""{mask_sql('fx_wide_spectrogram')}, gd AS (SELECT * FROM mask WHERE NOT masked), gm AS (SELECT median(power) AS med, stddev_pop(power) AS sd FROM gd),
    ga AS (SELECT median(abs(power - med)) AS mad FROM gd, gm), gn AS (SELECT med, CASE WHEN mad > 0 THEN 1.4826*mad ELSE sd END AS sg FROM gm, ga),
    tr AS (SELECT f_idx - round_even(d*(t_sec - (SELECT min(t_sec) FROM mask))/3e0, 0)::BIGINT AS channel, d AS drift, power FROM gd, (SELECT -10 + 20e0*i/200 AS d FROM range(0, 201) r(i))),
    sn AS (SELECT channel, drift, sum(power - med)/(max(sg)*sqrt(count(*))) AS snr FROM tr, gn GROUP BY 1, 2),
    share AS (SELECT f_idx AS channel, avg(masked::INT) > 0.5 AS is_rfi FROM mask GROUP BY 1),
    best AS (SELECT channel, max(snr) AS snr, arg_max(drift, (snr, -drift)) AS drift FROM sn GROUP BY 1),
    hits AS (SELECT channel, snr, drift, is_rfi FROM best JOIN share USING (channel) WHERE snr >= 10)"""
MERGE_SQL = """placed AS (SELECT *, row_number() OVER (ORDER BY channel) AS i FROM hits),
    walk AS (SELECT i, channel, snr, drift, NULL::BIGINT AS final FROM placed WHERE i = 1 UNION ALL
        SELECT p.i, CASE WHEN j.joined AND p.snr <= w.snr THEN w.channel ELSE p.channel END, CASE WHEN j.joined AND p.snr <= w.snr THEN w.snr ELSE p.snr END,
            CASE WHEN j.joined AND p.snr <= w.snr THEN w.drift ELSE p.drift END, CASE WHEN NOT j.joined THEN w.channel END
        FROM walk w JOIN placed p ON p.i = w.i + 1, LATERAL (SELECT p.channel - w.channel <= 3 AND abs(p.drift - w.drift) < 1 AS joined) j),
    kept AS (SELECT final AS channel FROM walk WHERE final IS NOT NULL UNION ALL SELECT arg_max(channel, i) FROM walk HAVING count(*) > 0)"""


def drift_hits(t):
    return drift_search(D.interference_mask(t.wide_spectrogram, sigma=3.0), 3.0)


@query("drift_search", f"WITH {DRIFT_SQL} SELECT channel, round(snr, 5) AS snr, round(drift, 6) AS drift, is_rfi FROM hits")
def _(t):
    return drift_hits(t).select("channel", F.round("snr", 5).alias("snr"), r6("drift", "drift"), "is_rfi")


@query("merged_hits", f"WITH RECURSIVE {DRIFT_SQL}, {MERGE_SQL} SELECT channel, round(snr, 5) AS snr, round(drift, 6) AS drift, is_rfi FROM kept JOIN hits USING (channel)")
def _(t):
    return merge_hits(drift_hits(t)).select("channel", F.round("snr", 5).alias("snr"), r6("drift", "drift"), "is_rfi")


@query("far_infrared_class", """SELECT target_id, CASE WHEN pacs_70 IS NULL AND pacs_100 IS NULL THEN 'unclassified' WHEN spire_250/pacs_70 > 3 THEN 'galaxy_like' WHEN spire_250/pacs_70 > 1 THEN 'cold_dust' WHEN w4_mjy/pacs_70 > 2 THEN 'dyson_consistent' WHEN w4_mjy/pacs_70 > 0.5 THEN 'dust_disk' ELSE 'unclassified' END AS sed_class FROM fx_signals""")
def _(t):
    return t.signals.select("target_id", D.far_infrared_class()["sed_class"].alias("sed_class"))


@query("xray_activity", "SELECT target_id, coalesce(xray > 1e-13, false) AS is_active FROM fx_signals")
def _(t):
    return t.signals.select("target_id", F.coalesce(F.col("xray") > 1e-13, F.lit(False)).alias("is_active"))


@query("profile_scores", """WITH s AS (SELECT target_id, least(1, greatest(coalesce(sigma_w3, 0), coalesce(sigma_w4, 0))/6) AS ir, dimming_score AS dimming, CASE WHEN n_radio_hits > 0 THEN least(1, hit_snr/30) ELSE 0.05 END AS radio,
    greatest(CASE WHEN ruwe > 1.4 THEN least(1, (ruwe - 1.4)/1.6*0.5 + 0.5) ELSE 0 END, CASE WHEN parallax > 0 AND parallax_error/parallax > 0.2 THEN least(0.5, parallax_error/parallax) ELSE 0 END, CASE WHEN aen > 1 THEN least(1, aen/5) ELSE 0 END) AS astrometry FROM fx_signals)
    SELECT target_id, round(ir, 6)::DOUBLE AS ir, round(dimming, 6)::DOUBLE AS dimming, round(radio, 6)::DOUBLE AS radio, round(astrometry, 6)::DOUBLE AS astrometry, (ir >= 0.5)::INT + (dimming >= 0.5)::INT + (radio >= 0.5)::INT + (astrometry >= 0.5)::INT AS n_flagged FROM s""")
def _(t):
    s = D.profile_scores()
    n = sum(((c >= 0.5).cast("int") for c in s.values()), F.lit(0))
    return t.signals.select("target_id", *[r6(c, k) for k, c in s.items()], n.alias("n_flagged"))


def lightcurve_moments(t):
    # Kurtosis of the reference is the raw fourth moment, so three is added back.
    g = t.lightcurve.groupBy("target_id").agg(F.count("*").alias("n"), F.stddev_pop("flux").alias("std"), (F.max("flux") - F.min("flux")).alias("range"), (1 - F.min("flux")).alias("depth"),
                                              F.skewness("flux").alias("skew"), (F.kurtosis("flux") + 3).alias("kurtosis"))
    return g.filter("n >= 20 AND std > 0")


@query("channel_features", "WITH m AS (SELECT *, avg(flux) OVER p AS mu, stddev_pop(flux) OVER p AS sd FROM fx_lightcurve WINDOW p AS (PARTITION BY target_id)) SELECT target_id, round(max(sd), 6) AS std, round(max(flux) - min(flux), 6) AS range, round(1 - min(flux), 6) AS depth, round(avg(pow((flux - mu)/sd, 3)), 4) AS skew, round(avg(pow((flux - mu)/sd, 4)), 4) AS kurtosis FROM m GROUP BY 1 HAVING count(*) >= 20 AND max(sd) > 0")
def _(t):
    return lightcurve_moments(t).select("target_id", r6("std", "std"), r6("range", "range"), r6("depth", "depth"), F.round("skew", 4).alias("skew"), F.round("kurtosis", 4).alias("kurtosis"))


@query("colour_features", "SELECT target_id, round(J - Ks, 6) AS j_ks, round(Ks - W1, 6) AS ks_w1, round(W1 - W2, 6) AS w1_w2, round(W1 - W3, 6) AS w1_w3, round(coalesce(W3 - W4, 0), 6) AS w3_w4, round(Ks - W3, 6) AS ks_w3 FROM fx_photometry WHERE J IS NOT NULL AND Ks IS NOT NULL AND W1 IS NOT NULL AND W3 IS NOT NULL")
def _(t):
    return colour_features(t).select("target_id", *[r6(c, c) for c in COLOURS])


COLOURS = ("j_ks", "ks_w1", "w1_w2", "w1_w3", "w3_w4", "ks_w3")


def colour_features(t):
    ok = t.photometry.filter("J IS NOT NULL AND Ks IS NOT NULL AND W1 IS NOT NULL AND W3 IS NOT NULL")
    return ok.selectExpr("target_id", "J - Ks AS j_ks", "Ks - W1 AS ks_w1", "W1 - W2 AS w1_w2", "W1 - W3 AS w1_w3", "coalesce(W3 - W4, 0D) AS w3_w4", "Ks - W3 AS ks_w3")


def channel_tables(t):
    """Feature table and feature names of each of five channels; channels of fewer than five usable rows are left out."""
    optical = t.targets.filter("g IS NOT NULL").selectExpr("target_id", "CAST(g AS DOUBLE) AS g", "coalesce(bp_rp, 0D) AS bp_rp", "coalesce(teff, 5000D) AS teff", "CASE WHEN coalesce(logg, 0D) = 0 THEN 4D ELSE logg END AS logg")
    astrometry = t.targets.filter("ruwe IS NOT NULL").selectExpr("target_id", "ruwe", "coalesce(CAST(parallax AS DOUBLE), 0D) AS parallax", "coalesce(parallax_error, 0D) AS parallax_error", "coalesce(aen, 0D) AS aen")
    mags = t.optical_epochs.filter("mag IS NOT NULL").groupBy("target_id").agg(F.count("*").alias("n"), F.stddev_pop("mag").alias("std"), (F.max("mag") - F.min("mag")).alias("range"), F.skewness("mag").alias("skew"))
    epochs = mags.filter("n >= 10").select("target_id", "std", "range", F.when(F.col("std") > 0, F.col("skew")).otherwise(F.lit(0.0)).alias("skew"))
    tables = {
        "optical": (optical, ("g", "bp_rp", "teff", "logg")), "infrared": (colour_features(t), COLOURS),
        "lightcurve": (lightcurve_moments(t).drop("n"), ("std", "range", "depth", "skew", "kurtosis")),
        "astrometry": (astrometry, ("ruwe", "parallax", "parallax_error", "aen")), "epochs": (epochs, ("std", "range", "skew")),
    }
    tables = {name: (df, feats, df.count()) for name, (df, feats) in tables.items()}
    return {name: table for name, table in tables.items() if table[2] >= 5}


_FEATURES_SQL = {
    "optical": "SELECT target_id, g, coalesce(bp_rp, 0) AS bp_rp, coalesce(teff, 5000) AS teff, CASE WHEN coalesce(logg, 0) = 0 THEN 4 ELSE logg END AS logg FROM fx_targets WHERE g IS NOT NULL",
    "infrared": "SELECT target_id, J - Ks AS j_ks, Ks - W1 AS ks_w1, W1 - W2 AS w1_w2, W1 - W3 AS w1_w3, coalesce(W3 - W4, 0) AS w3_w4, Ks - W3 AS ks_w3 FROM fx_photometry WHERE J IS NOT NULL AND Ks IS NOT NULL AND W1 IS NOT NULL AND W3 IS NOT NULL",
    "lightcurve": """SELECT target_id, max(sd) AS std, max(flux) - min(flux) AS range, 1 - min(flux) AS depth, avg(pow((flux - mu)/sd, 3)) AS skew, avg(pow((flux - mu)/sd, 4)) AS kurtosis
        FROM (SELECT *, avg(flux) OVER p AS mu, stddev_pop(flux) OVER p AS sd FROM fx_lightcurve WINDOW p AS (PARTITION BY target_id)) GROUP BY 1 HAVING count(*) >= 20 AND max(sd) > 0""",
    "astrometry": "SELECT target_id, ruwe, coalesce(parallax, 0) AS parallax, coalesce(parallax_error, 0) AS parallax_error, coalesce(aen, 0) AS aen FROM fx_targets WHERE ruwe IS NOT NULL",
    "epochs": """SELECT target_id, max(sd) AS std, max(mag) - min(mag) AS range, CASE WHEN max(sd) > 0 THEN avg(pow((mag - mu)/sd, 3)) ELSE 0 END AS skew
        FROM (SELECT *, avg(mag) OVER p AS mu, stddev_pop(mag) OVER p AS sd FROM fx_optical_epochs WHERE mag IS NOT NULL WINDOW p AS (PARTITION BY target_id)) GROUP BY 1 HAVING count(*) >= 10""",
}
_FEATURE_NAMES = {"optical": ("g", "bp_rp", "teff", "logg"), "infrared": ("j_ks", "ks_w1", "w1_w2", "w1_w3", "w3_w4", "ks_w3"), "lightcurve": ("std", "range", "depth", "skew", "kurtosis"),
                  "astrometry": ("ruwe", "parallax", "parallax_error", "aen"), "epochs": ("std", "range", "skew")}


@query("channel_feature_tables", "WITH " + ", ".join(f"f_{c} AS ({sql})" for c, sql in _FEATURES_SQL.items()) + " "
       + " UNION ALL ".join(f"SELECT '{c}' AS channel, target_id, '{f}' AS feature, round(({f})::DOUBLE, 4) AS value FROM f_{c} WHERE (SELECT count(*) FROM f_{c}) >= 5" for c, feats in _FEATURE_NAMES.items() for f in feats))
def _(t):
    found = None
    for name, (df, feats, _) in channel_tables(t).items():
        items = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in feats))).alias("x")
        rows = df.select(F.lit(name).alias("channel"), F.col("target_id").cast("bigint").alias("target_id"), items).select("channel", "target_id", "x.feature", F.round("x.value", 4).alias("value"))
        found = rows if found is None else found.unionByName(rows)
    return found


def stacked_anomalies(tables):
    """Targets that outlier models of several channels mark: ``k`` channels, and the mean score over the model's limit times 10^(k - 1).

    ``tables``: name to (frame with ``target_id``, features, number of rows). A model's share of outliers is one in n, held between 1 % and 5 %.
    """
    stacked = None
    for name, (df, feats, n) in tables.items():
        marks = isolation_scores(df.withColumn("target_id", F.col("target_id").cast("bigint")), "target_id", feats, contamination=min(0.05, max(0.01, 1.0 / n))).withColumn("channel", F.lit(name))
        stacked = marks if stacked is None else stacked.unionByName(marks)
    g = stacked.filter("is_outlier").groupBy("target_id").agg(F.count("*").alias("k"), F.avg(F.least("excess", F.lit(1.0))).alias("mean"), F.array_sort(F.collect_set("channel")).alias("channels"))
    return g.withColumn("convergence", F.col("mean") * F.pow(F.lit(10.0), (F.col("k") - 1).cast("double")))


@query("anomaly_stacking")
def _(t):
    return stacked_anomalies(channel_tables(t)).orderBy(F.desc("k"), F.desc("convergence"), "target_id")


@query("radio_candidate_validation", f"""WITH x AS (SELECT target_id, hit_snr AS snr, n_radio_hits AS n, (hit_snr/4) AS z, ruwe FROM fx_signals WHERE n_radio_hits > 0), p AS (SELECT *, {Q.normal_tail('z')} AS p1 FROM x), d AS (SELECT *, 1 - exp(-snr/20) AS det, CASE WHEN ruwe < 2 THEN 0.4 ELSE 0.1 END AS nat, least(1, greatest(0, 0.4*(n % 3)/n + 0.2 + 0.2*exp(-snr/20))) AS ins FROM p)
    SELECT target_id, round(det, 6) AS detection, round(1 - pow(1 - p1, 1000), 6) AS p, CASE WHEN det > 0.5 AND nat < 0.5 AND ins < 0.3 THEN 'UNEXPLAINED' WHEN nat >= 0.5 THEN 'CONFIRMED_NATURAL' WHEN ins >= 0.5 THEN 'CONFIRMED_ARTIFACT' ELSE 'INCONCLUSIVE' END AS status FROM d""")
def _(t):
    x = t.signals.filter("n_radio_hits > 0").select("target_id", F.col("hit_snr").alias("snr"), F.col("n_radio_hits").alias("n"), "ruwe")
    det = 1.0 - F.exp(-F.col("snr") / 20.0)
    nat = F.when(F.col("ruwe") < 2, F.lit(0.4)).otherwise(F.lit(0.1))
    ins = N.clip(0.4 * (F.col("n") % 3) / F.col("n") + 0.2 + 0.2 * (1.0 - det), 0, 1)
    p = N.sidak(N.normal_tail(F.col("snr") / 4), 1000)
    return x.select("target_id", r6(det, "detection"), r6(p, "p"), D.validation_status(det, nat, ins).alias("status"))


_VAL = "(SELECT row_id, total_score/5 AS det, unexplainability AS nat, pm_sigma/10 AS ins, stouffer_p FROM fx_report_rows)"


@query("validation_status", f"WITH v AS (SELECT *, CASE WHEN det > 0.5 AND nat < 0.5 AND ins < 0.3 THEN 'UNEXPLAINED' WHEN nat >= 0.5 THEN 'CONFIRMED_NATURAL' WHEN ins >= 0.5 THEN 'CONFIRMED_ARTIFACT' ELSE 'INCONCLUSIVE' END AS st FROM {_VAL}), q AS ({bh_sql('v', 'stouffer_p')}) SELECT row_id, CASE WHEN st = 'UNEXPLAINED' AND q_value > 0.2 THEN 'BOUNDARY' ELSE st END AS status FROM q")
def _(t):
    v = t.report_rows.select("row_id", "stouffer_p", D.validation_status(F.col("total_score") / 5, F.col("unexplainability"), F.col("pm_sigma") / 10).alias("st"))
    v = benjamini_hochberg(v, "stouffer_p", alpha=0.2)
    return v.select("row_id", F.when((F.col("st") == "UNEXPLAINED") & ~F.col("is_significant"), "BOUNDARY").otherwise(F.col("st")).alias("status"))


@query("secular_trend_scan", f"WITH {trend_sql('fx_ir_epochs', 'w1', 'w1_err', 'tr')}, {mono_sql('w1', 'mo')} SELECT count(*) AS n, count(*) FILTER (abs(sigma) > 3) AS n_trend, count(*) FILTER (mono >= 0.75) AS n_monotone, count(*) FILTER (sigma < -3) AS n_brightening FROM tr LEFT JOIN mo USING (target_id)")
def _(t):
    tr = T.weighted_trend(t.ir_epochs, "target_id", "mjd", "w1", "w1_err", "w1").join(T.monotonicity(t.ir_epochs, "target_id", "mjd", "w1", "mono"), "target_id", "left")
    return tr.agg(F.count("*").alias("n"), F.count_if(F.abs("w1_sigma") > 3).alias("n_trend"), F.count_if(F.col("mono") >= 0.75).alias("n_monotone"), F.count_if(F.col("w1_sigma") < -3).alias("n_brightening"))
