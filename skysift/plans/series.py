"""Time series: passes, trends, windows, dips, periodic signals and outlier models."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions import numeric as N
from skysift.operators import temporal as J
from skysift.operators import timeseries as T
from skysift.operators.folding import box_search
from skysift.operators.forest import isolation_scores
from skysift.operators.periodogram import power_at_periods
from skysift.operators.skyjoin import pairs
from skysift.operators.stats import spearman
from skysift.plans import sqltext as Q
from skysift.plans.associations import ASOF_SQL, band_series
from skysift.plans.registry import query
from skysift.plans.scalars import SHAPIRO_US, shapiro_delay_us
from skysift.session import cut


def r6(c, name):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name)


PASS_SQL = """ps AS (SELECT *, sum(new_) OVER (PARTITION BY target_id ORDER BY mjd, epoch_id) AS pass FROM (SELECT *, coalesce((mjd - lag(mjd) OVER (PARTITION BY target_id ORDER BY mjd, epoch_id) > 30)::INT, 0) AS new_ FROM fx_ir_epochs)),
    passes AS (SELECT target_id, pass, count(*) AS n, avg(mjd) AS mjd, sum(w1/pow(w1_err, 2))/sum(1/pow(w1_err, 2)) AS w1, 1/sqrt(sum(1/pow(w1_err, 2))) AS w1_err,
    CASE WHEN count(w2) >= 2 THEN sum(w2/pow(w2_err, 2))/sum(1/pow(w2_err, 2)) END AS w2, CASE WHEN count(w2) >= 2 THEN 1/sqrt(sum(1/pow(w2_err, 2))) END AS w2_err FROM ps GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("sky_passes", f"WITH {PASS_SQL} SELECT target_id, pass::BIGINT AS pass, n, round(mjd, 4) AS mjd, round(w1, 6) AS w1, round(w1_err, 6) AS w1_err, round(w2, 6) AS w2, round(w2_err, 6) AS w2_err FROM passes")
def _(t):
    return T.pass_means(t.ir_epochs).select("target_id", "pass", "n", F.round("mjd", 4).alias("mjd"), *[r6(c, c) for c in ("w1", "w1_err", "w2", "w2_err")])


def trend_sql(src, v, e, name, key="target_id"):
    return f"""{name}_x AS (SELECT {key}, (mjd - min(mjd) OVER (PARTITION BY {key}))/365.25e0 AS x, {v} AS y, 1/pow({e}, 2) AS w FROM {src} WHERE {v} IS NOT NULL AND {e} > 0),
    {name}_s AS (SELECT {key}, count(*) AS n, sum(w) AS s, sum(w*x) AS sx, sum(w*y) AS sy, sum(w*x*x) AS sxx, sum(w*x*y) AS sxy FROM {name}_x GROUP BY 1),
    {name} AS (SELECT {key}, n, CASE WHEN n >= 5 AND abs(s*sxx - sx*sx) >= 1e-30 THEN (s*sxy - sx*sy)/(s*sxx - sx*sx) ELSE 0e0 END AS slope, CASE WHEN n >= 5 AND abs(s*sxx - sx*sx) >= 1e-30 THEN (s*sxy - sx*sy)/(s*sxx - sx*sx)/greatest(sqrt(s/(s*sxx - sx*sx)), 1e-15) ELSE 0e0 END AS sigma FROM {name}_s)"""


@query("weighted_trend", f"WITH {trend_sql('fx_ir_epochs', 'w1', 'w1_err', 'tr')} SELECT target_id, n, round(slope, 6) AS slope, round(sigma, 4) AS sigma FROM tr")
def _(t):
    df = T.weighted_trend(t.ir_epochs, "target_id", "mjd", "w1", "w1_err", "w1")
    return df.select("target_id", F.col("w1_n").alias("n"), r6("w1_slope", "slope"), F.round("w1_sigma", 4).alias("sigma"))


def mono_sql(v, name, src="fx_ir_epochs"):
    return f"""{name}_a AS (SELECT target_id, min(mjd) AS a, max(mjd) AS b FROM {src} WHERE {v} IS NOT NULL GROUP BY 1 HAVING count(*) >= 10 AND (max(mjd) - min(mjd))/365.25 >= 0.5),
    {name}_m AS (SELECT e.target_id, least(4, floor((mjd - a)/((b + 1e-10 - a)/5))) AS bin, median({v}) AS m FROM {src} e JOIN {name}_a USING (target_id) WHERE {v} IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
    {name}_d AS (SELECT target_id, m - lag(m) OVER (PARTITION BY target_id ORDER BY bin) AS d FROM {name}_m), {name} AS (SELECT target_id, CASE WHEN count(d) >= 2 THEN greatest(count(*) FILTER (d > 0), count(*) FILTER (d < 0))/count(d) ELSE 0e0 END AS mono FROM {name}_d GROUP BY 1)"""


@query("binned_monotonicity", f"WITH {mono_sql('w1', 'mo')} SELECT target_id, round(mono, 6) AS mono FROM mo")
def _(t):
    return T.monotonicity(t.ir_epochs, "target_id", "mjd", "w1", "mono").select("target_id", r6("mono", "mono"))


_TICKS = "(SELECT event_type AS series, epoch(ts)/1e3 AS t, avg(value) AS x FROM events GROUP BY 1, 2)"


def ticks(t):
    secs = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.groupBy(F.col("event_type").alias("series"), (secs / 1e3).alias("t")).agg(F.avg("value").alias("x"))


TIER_SQL = """sp AS (SELECT series, min(t) AS a, max(t) AS b, (max(t) - min(t))/(count(*) - 1) AS cad FROM tk GROUP BY 1 HAVING count(*) >= 10),
    pl AS (SELECT series, a, b, tier, ord, greatest(floor((b - a)/size), 1) AS nb FROM (SELECT series, a, b, '1-second' AS tier, 0 AS ord, 1e0 AS size FROM sp WHERE cad < 1 AND b - a >= 30 UNION ALL SELECT series, a, b, '10-second', 1, 10e0 FROM sp WHERE cad < 10 AND b - a >= 300
    UNION ALL SELECT series, a, b, '1-minute', 2, 60e0 FROM sp WHERE cad < 60 AND b - a >= 600 UNION ALL SELECT series, a, b, 'full-integration', 3, greatest((b - a)/10, cad*10) FROM sp)),
    bn AS (SELECT series, tier, ord, floor((t - a)/((b - a)/nb)) AS bin, avg(x) AS m FROM tk JOIN pl USING (series) WHERE floor((t - a)/((b - a)/nb)) < nb GROUP BY 1, 2, 3, 4), md AS (SELECT *, median(m) OVER (PARTITION BY series, tier) AS med, count(*) OVER (PARTITION BY series, tier) AS n, stddev_pop(m) OVER (PARTITION BY series, tier) AS sd FROM bn),
    ma AS (SELECT *, median(abs(m - med)) OVER (PARTITION BY series, tier) AS mad FROM md), z AS (SELECT *, CASE WHEN n >= 5 THEN abs(m - med)/nullif(CASE WHEN mad > 0 THEN 1.4826*mad ELSE sd END, 0) END AS z FROM ma),
    tiers AS (SELECT series, tier, ord, count(*) AS n_bins, count(*) FILTER (z > 3) AS n_anomalies, coalesce(max(z), 0) AS peak FROM z GROUP BY 1, 2, 3)"""


@query("multi_resolution_outliers", f"WITH tk AS {_TICKS}, {TIER_SQL} SELECT series, tier, n_bins, n_anomalies, round(peak, 6) AS peak FROM tiers")
def _(t):
    return T.resolution_tiers(ticks(t), "series", "t", "x", sigma=3.0).select("series", "tier", "n_bins", "n_anomalies", r6("peak", "peak"))


@query("resolution_disagreement", f"WITH tk AS {_TICKS}, {TIER_SQL}, s AS (SELECT series, count(*) AS n_tiers, arg_min(n_anomalies, ord) AS f, arg_max(n_anomalies, ord) AS c FROM tiers GROUP BY 1) SELECT series, n_tiers, n_tiers >= 2 AND f > 0 AND c = 0 AS transient_only, n_tiers >= 2 AND c > 0 AND f = 0 AS persistent_only FROM s")
def _(t):
    return T.tier_disagreement(T.resolution_tiers(ticks(t), "series", "t", "x", sigma=3.0), "series")


@query("channel_integrated_series", f"WITH tk AS (SELECT 'all' AS series, t_sec AS t, avg(power) AS x FROM fx_spectrogram GROUP BY t_sec), {TIER_SQL} SELECT series, tier, n_bins, n_anomalies, round(peak, 6) AS peak FROM tiers")
def _(t):
    series = t.spectrogram.groupBy(F.lit("all").alias("series"), F.col("t_sec").alias("t")).agg(F.avg("power").alias("x"))
    return T.resolution_tiers(series, "series", "t", "x", sigma=3.0).select("series", "tier", "n_bins", "n_anomalies", r6("peak", "peak"))


WINDOW_SQL = """r AS (SELECT target_id, time AS t, flux AS x, row_number() OVER (PARTITION BY target_id ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY target_id) AS n FROM fx_lightcurve), q AS (SELECT *, CASE WHEN n >= 50 THEN 50 ELSE greatest(n//2, 5) END AS w FROM r),
    h AS (SELECT *, CASE WHEN n >= 50 THEN 10 ELSE greatest(1, w//5) END AS h FROM q), e AS (SELECT *, unnest(range(greatest(0, ceil((i - w + 1)/h))::BIGINT, least(i//h, (n - w)//h)::BIGINT + 1)) AS win FROM h),
    m AS (SELECT *, avg(x) OVER p AS mu, stddev_pop(x) OVER p AS sd, median(x) OVER p AS med FROM e WINDOW p AS (PARTITION BY target_id, win))"""


@query("sliding_window_features", f"""WITH {WINDOW_SQL} SELECT target_id, win AS "window", round(max(mu), 6) AS mean, round(max(sd), 6) AS std, round(1 - min(x), 6) AS depth, round(CASE WHEN max(sd) > 0 THEN avg(pow((x - mu)/nullif(sd, 0), 3)) ELSE 0 END, 4) AS skew,
    round((arg_max(x, t) - arg_min(x, t))/(max(t) - min(t)), 8) AS slope, round(count(*) FILTER (x < med - 2*sd)/max(w), 6) AS deep_share FROM m GROUP BY 1, 2""")
def _(t):
    df = T.window_features(t.lightcurve, "target_id", "time", "flux")
    return df.select("target_id", "window", r6("mean", "mean"), r6("std", "std"), r6("depth", "depth"), F.round("skew", 4).alias("skew"), F.round("slope", 8).alias("slope"), r6("deep_share", "deep_share"))


ISLAND_SQL = """o AS (SELECT target_id, time AS t, flux AS x, flux < 0.985 AS on_, row_number() OVER (PARTITION BY target_id ORDER BY time) AS i FROM fx_lightcurve), k AS (SELECT *, i - row_number() OVER (PARTITION BY target_id ORDER BY t) AS g FROM o WHERE on_),
    j AS (SELECT *, row_number() OVER (PARTITION BY target_id, g ORDER BY t) - 1 AS p, count(*) OVER (PARTITION BY target_id, g) AS n FROM k)"""


@query("dimming_events", f"""WITH {ISLAND_SQL} SELECT target_id, max(n) AS n, round(min(t), 6) AS start, round(1 - min(x), 6) AS depth, round(max(t) - min(t), 6) AS duration,
    round(CASE WHEN max(n) >= 2 THEN least(1, abs(avg(x) FILTER (p < n//2) - avg(x) FILTER (p >= n//2))/greatest(max(x) - min(x), 1e-10)) ELSE 0 END, 6) AS asymmetry FROM j GROUP BY target_id, g""")
def _(t):
    df = T.islands(t.lightcurve, "target_id", "time", F.col("flux") < 0.985, "flux")
    return df.select("target_id", "n", r6("start", "start"), r6("depth", "depth"), r6("duration", "duration"), r6("asymmetry", "asymmetry"))


@query("dip_detection", """WITH d AS (SELECT target_id, time AS t, flux AS x, flux - lag(flux) OVER (PARTITION BY target_id ORDER BY time) AS df, row_number() OVER (PARTITION BY target_id ORDER BY time) AS i FROM fx_lightcurve), m AS (SELECT *, median(df) OVER p AS md, median(x) OVER p AS med, stddev_pop(x) OVER p AS sd FROM d WINDOW p AS (PARTITION BY target_id)),
    a AS (SELECT *, median(abs(df - md)) OVER (PARTITION BY target_id) AS mad FROM m), n AS (SELECT *, CASE WHEN (CASE WHEN mad > 0 THEN 1.4826*mad/sqrt(2) ELSE sd END) > 0 THEN (CASE WHEN mad > 0 THEN 1.4826*mad/sqrt(2) ELSE sd END) ELSE 1e-6 END AS noise FROM a),
    r AS (SELECT target_id, count(*) FILTER (k >= 3) AS s FROM (SELECT target_id, g, count(*) AS k FROM (SELECT target_id, i - row_number() OVER (PARTITION BY target_id ORDER BY t) AS g FROM n WHERE x < med - 1.5*noise) GROUP BY 1, 2) GROUP BY 1)
    SELECT n.target_id, count(*) AS n, count(*) FILTER (x < med - 1.5*noise) AS n_dips, round((max(med) - min(x))/max(noise), 6) AS dip_sigma, count(*) FILTER (abs(df)/noise > 7.5) AS n_jumps, coalesce(max(r.s), 0) AS n_sustained, round(regr_slope(x, t), 9) AS trend FROM n LEFT JOIN r USING (target_id) GROUP BY 1 HAVING count(*) >= 20""")
def _(t):
    df = T.dips(t.lightcurve, "target_id", "time", "flux", sigma=1.5)
    return df.select("target_id", "n", "n_dips", r6("dip_sigma", "dip_sigma"), "n_jumps", "n_sustained", F.round("trend", 9).alias("trend"))


@query("phase_folded_transits")
def _(t):
    found = box_search(t.lightcurve, "target_id", "time", "flux")
    return T.dip_shape(t.lightcurve, "target_id", "time", "flux", found)


_WINDOW_FEATURES = ("mean", "std", "low", "high", "depth", "skew", "slope", "deep_share")


@query("irregular_dimming")
def _(t):
    feats = cut(T.window_features(t.lightcurve, "target_id", "time", "flux").withColumn("row", F.concat_ws("-", "target_id", "window")))
    marks = isolation_scores(feats, "row", _WINDOW_FEATURES, contamination=0.05)
    odd = feats.join(marks.filter("is_outlier"), "row").select("target_id", "t0", "t1", "isolation")
    # Overlapping odd windows become one stretch of time, so that points are only marked once.
    runs = T.sessions(odd.withColumnRenamed("t0", "mjd"), "target_id", "mjd", 0.0, "run")
    rows = runs.groupBy("target_id").agg(F.count("*").alias("n_windows"), F.avg("isolation").alias("score"), F.min("mjd").alias("start"), F.max("t1").alias("end"))
    return rows


def power_sql(periods: str) -> str:
    """Powers at a grid of 500 frequencies and at the periods of a query (k, period), each from sums over all points."""
    return f"""wp AS (SELECT DISTINCT k, period FROM ({periods}) WHERE period > 0), b AS (SELECT pulsar_id AS k, mjd AS t, residual_us AS y, 1/pow(uncertainty_us, 2) AS w, mjd - lag(mjd) OVER (PARTITION BY pulsar_id ORDER BY mjd) AS d FROM fx_residuals WHERE pulsar_id IN (SELECT k FROM wp)),
    s AS (SELECT k, min(t) AS t0, max(t) - min(t) AS span, median(d) AS step, sum(w) AS sw, sum(w*y)/sum(w) AS mu FROM b GROUP BY 1 HAVING count(*) >= 10),
    fr AS (SELECT k, 1/span + (0.5/step - 1/span)*i/499e0 AS f, NULL AS period FROM s, range(0, 500) r(i) UNION ALL SELECT k, 1/period, period FROM s JOIN wp USING (k)),
    x AS (SELECT k, f, period, w/sw AS w, y - mu AS y, cos(f*(t - t0)*2*pi()) AS c, sin(f*(t - t0)*2*pi()) AS s FROM b JOIN s USING (k) JOIN fr USING (k)),
    m AS (SELECT k, f, period, sum(w*y*y) AS yy, sum(w*y*c) AS yc, sum(w*y*s) AS ys, sum(w*c*c) - pow(sum(w*c), 2) AS cc, sum(w*s*s) - pow(sum(w*s), 2) AS ss, sum(w*c*s) - sum(w*c)*sum(w*s) AS cs FROM x GROUP BY ALL),
    p AS (SELECT k, period, (ss*yc*yc + cc*ys*ys - 2*cs*yc*ys)/(cc*ss - cs*cs)/yy AS p FROM m), pm AS (SELECT k, median(p) AS median_power FROM p WHERE period IS NULL GROUP BY 1)"""


@query("power_at_known_period", f"WITH {power_sql('SELECT pulsar_id AS k, 365.25e0 AS period FROM fx_residuals')} SELECT k AS pulsar_id, round(p, 6) AS power, round(p/median_power, 4) AS ratio FROM p JOIN pm USING (k) WHERE period IS NOT NULL")
def _(t):
    wanted = t.residuals.select("pulsar_id", F.lit(365.25).alias("period"))
    df = power_at_periods(t.residuals, wanted, "pulsar_id", "mjd", "residual_us", "uncertainty_us")
    return df.select("pulsar_id", r6("power", "power"), F.round("ratio", 4).alias("ratio"))


HALF_SQL = "SELECT target_id, {v} AS v, row_number() OVER (PARTITION BY target_id ORDER BY mjd, epoch_id) > count(*) OVER (PARTITION BY target_id)//2 AS late FROM {src}"


@query("early_late_shift", f"WITH h AS ({HALF_SQL.format(v='mag', src='fx_optical_epochs')}) SELECT target_id, round(median(v) FILTER (late) - median(v) FILTER (NOT late), 6) AS shift, abs(median(v) FILTER (late) - median(v) FILTER (NOT late)) > 3*stddev_pop(v)/sqrt(count(*)//2) AS is_significant FROM h GROUP BY 1")
def _(t):
    spread = t.optical_epochs.groupBy("target_id").agg(F.stddev_pop("mag").alias("std"), F.floor(F.count("mag") / 2).alias("half"))
    shift = T.halves_shift(t.optical_epochs, "target_id", ["mjd", "epoch_id"], "mag").join(spread, "target_id")
    significant = F.when(F.col("half") > 0, F.abs("shift") > 3.0 * F.col("std") / F.sqrt("half"))
    return shift.select("target_id", r6("shift", "shift"), significant.alias("is_significant"))


@query("colour_evolution", f"WITH c AS (SELECT target_id, epoch_id, mjd, w1 - w2 AS c FROM fx_ir_epochs WHERE w2 IS NOT NULL), h AS ({HALF_SQL.format(v='c', src='c')}) SELECT target_id, round(median(v) FILTER (late) - median(v) FILTER (NOT late), 6) AS shift, abs(median(v) FILTER (late) - median(v) FILTER (NOT late)) > 0.02 AS is_real FROM h GROUP BY 1")
def _(t):
    c = t.ir_epochs.filter("w2 IS NOT NULL").withColumn("c", F.col("w1") - F.col("w2"))
    return T.halves_shift(c, "target_id", ["mjd", "epoch_id"], "c").select("target_id", r6("shift", "shift"), (F.abs("shift") > 0.02).alias("is_real"))


@query("epoch_linear_trend", "SELECT target_id, round(regr_slope(mag, mjd)*(max(mjd) - min(mjd)), 6) AS change, abs(regr_slope(mag, mjd)*(max(mjd) - min(mjd))) > 1*stddev_pop(mag) AS is_trend FROM fx_optical_epochs GROUP BY 1 HAVING count(*) >= 10")
def _(t):
    change = F.regr_slope(F.col("mag"), F.col("mjd")) * (F.max("mjd") - F.min("mjd"))
    df = t.optical_epochs.groupBy("target_id").agg(F.count("*").alias("n"), change.alias("c"), F.stddev_pop("mag").alias("s")).filter("n >= 10")
    return df.select("target_id", r6("c", "change"), (F.abs("c") > F.col("s")).alias("is_trend"))


@query("seasonal_anticorrelation", f"""WITH {ASOF_SQL}, m AS (SELECT target_id, t, v, ov FROM matched WHERE abs(ot - t) <= 30), s AS (SELECT *, floor((t - min(t) OVER (PARTITION BY target_id))/180) AS season FROM m), y AS (SELECT target_id, season, corr(v, ov) AS r FROM s GROUP BY 1, 2 HAVING count(*) >= 3),
    g AS (SELECT target_id, count(*) AS n, corr(v, ov) AS r FROM m GROUP BY 1 HAVING count(*) >= 10) SELECT target_id, n, round(r, 6) AS r, round(greatest(0, -atanh(r)*sqrt(n - 3)), 6) AS anti_sigma, coalesce((SELECT count(*) FROM y WHERE y.target_id = g.target_id AND y.r < 0 AND g.n >= 6), 0) AS n_seasons FROM g""")
def _(t):
    opt, ir = band_series(t)
    m = J.nearest_in_time(ir, opt, "target_id", 30.0)
    start = m.groupBy("target_id").agg(F.min("t").alias("t0"))
    seasons = m.join(start, "target_id").groupBy("target_id", F.floor((F.col("t") - F.col("t0")) / 180).alias("season")).agg(N.correlation("v", "other_v").alias("r"), F.count("*").alias("k"))
    anti = seasons.filter("k >= 3").groupBy("target_id").agg(F.count_if(F.col("r") < 0).alias("n_seasons"))
    g = m.groupBy("target_id").agg(F.count("*").alias("n"), N.correlation("v", "other_v").alias("r")).filter("n >= 10")
    return g.join(anti, "target_id", "left").select("target_id", "n", r6("r", "r"), r6(F.greatest(F.lit(0.0), -F.atanh("r") * F.sqrt(F.col("n") - 3.0)), "anti_sigma"), F.coalesce("n_seasons", F.lit(0)).alias("n_seasons"))


@query("matched_rank_correlation", f"""WITH {ASOF_SQL}, m AS (SELECT target_id, v, ov FROM matched WHERE abs(ot - t) <= 30), r AS (SELECT target_id, rank() OVER (PARTITION BY target_id ORDER BY v) + (count(*) OVER (PARTITION BY target_id, v) - 1)/2 AS a, rank() OVER (PARTITION BY target_id ORDER BY ov) + (count(*) OVER (PARTITION BY target_id, ov) - 1)/2 AS b FROM m)
    SELECT target_id, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1 HAVING count(*) > 10""")
def _(t):
    opt, ir = band_series(t)
    return spearman(J.nearest_in_time(ir, opt, "target_id", 30.0), ["target_id"], "v", "other_v").select("target_id", "n", r6("rho", "rho"))


@query("flux_variability", "SELECT target_id, count(*) AS n, round(stddev_pop(pow(10e0, -0.4e0*mag))/avg(pow(10e0, -0.4e0*mag)), 6) AS variability FROM fx_optical_epochs WHERE band = 'G' GROUP BY 1 HAVING count(*) > 2")
def _(t):
    f = F.pow(F.lit(10.0), -0.4 * F.col("mag"))
    df = t.optical_epochs.filter("band = 'G'").groupBy("target_id").agg(F.count("*").alias("n"), (F.stddev_pop(f) / F.avg(f)).alias("v")).filter("n > 2")
    return df.select("target_id", "n", r6("v", "variability"))


@query("scatter_chi_square", """WITH m AS (SELECT target_id, w1, w1_err, avg(w1) OVER (PARTITION BY target_id) AS mu FROM fx_ir_epochs), s AS (SELECT target_id, count(*) AS n, sum(pow((w1 - mu)/w1_err, 2)) AS x FROM m GROUP BY 1), z AS (SELECT *, sqrt(x) AS z, (n - 1)//2 AS k FROM s)
    SELECT target_id, n, round(x, 4) AS chi2, round(CASE WHEN (n - 1) % 2 = 0 THEN """ + Q.even_chi_square_tail("x", "k") + f""" ELSE 2*{Q.normal_tail('z')} + coalesce(list_sum(list_transform(range(1, k + 1), lambda i: exp(-x/2 + (i - 0.5e0)*ln(x/2) - lgamma(i + 0.5e0)))), 0e0) END, 9) AS p FROM z""")
def _(t):
    mean = t.ir_epochs.groupBy("target_id").agg(F.avg("w1").alias("mu"))
    z = (F.col("w1") - F.col("mu")) / F.col("w1_err")
    s = t.ir_epochs.join(mean, "target_id").groupBy("target_id").agg(F.count("*").alias("n"), F.sum(z * z).alias("x"))
    return s.select("target_id", "n", F.round("x", 4).alias("chi2"), F.round(N.chi_square_tail(F.col("x"), F.col("n") - 1), 9).alias("p"))


@query("isolation_forest_scores")
def _(t):
    vec = t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return isolation_scores(vec, "vec_id", [f"e{i}" for i in range(64)], contamination=0.05)


@query("pulsar_line_of_sight", f"""WITH los AS ({Q.cone('fx_pulsars', 'fx_hosts', '1e0', 'pulsar_id', 'a.pulsar_id, a.rms_us, b.host_id, b.st_mass, b.period_days', zone=1)}),
    {power_sql('SELECT pulsar_id AS k, period_days AS period FROM los')}, best AS (SELECT k, max(p/median_power) AS ratio, arg_max(period, (p/median_power, -period)) AS period FROM p JOIN pm USING (k) WHERE period IS NOT NULL GROUP BY 1),
    d AS (SELECT pulsar_id, count(*) AS n_hosts, max(rms_us) AS rms, max(greatest(0e0, {SHAPIRO_US!r}::DOUBLE*st_mass*ln(2/greatest(radians(sep_deg), 1e-10)))) AS delay FROM los GROUP BY 1)
    SELECT pulsar_id, n_hosts, round(delay, 6) AS max_delay_us, round(ratio, 4) AS periodic_significance, round(period, 6) AS periodic_period_days, coalesce(ratio >= 5, false) OR coalesce(delay > 0.1*rms, false) AS is_candidate FROM d LEFT JOIN best ON k = pulsar_id""")
def _(t):
    los = cut(pairs(t.pulsars.select("pulsar_id", "ra", "dec", "rms_us"), t.hosts.select("host_id", "ra", "dec", "st_mass", "period_days"), 1.0))
    powers = power_at_periods(t.residuals, los.select("pulsar_id", F.col("r_period_days").alias("period")), "pulsar_id", "mjd", "residual_us", "uncertainty_us")
    best = powers.groupBy("pulsar_id").agg(F.max(F.struct("ratio", (-F.col("period")).alias("_p"), "period")).alias("b"))
    delay = shapiro_delay_us(F.col("r_st_mass"), F.col("sep_deg"))
    agg = los.groupBy("pulsar_id").agg(F.count("*").alias("n_hosts"), F.max(delay).alias("d"), F.max("rms_us").alias("rms")).join(best, "pulsar_id", "left")
    candidate = F.coalesce(F.col("b.ratio") >= 5.0, F.lit(False)) | F.coalesce(F.col("d") > 0.1 * F.col("rms"), F.lit(False))
    return agg.select("pulsar_id", "n_hosts", r6("d", "max_delay_us"), F.round("b.ratio", 4).alias("periodic_significance"), r6("b.period", "periodic_period_days"), candidate.alias("is_candidate"))
