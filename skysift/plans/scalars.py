"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions import numeric as N
from skysift.functions import photometry as P
from skysift.functions import sphere as S
from skysift.functions import text as T
from skysift.plans import sqltext as Q
from skysift.plans.registry import query


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("angular_separation", f"""SELECT target_id, round({Q.sep('ra', 'dec', '180e0', '10e0')}, 6) AS haversine,
    round({Q.sep('ra', 'dec', '180e0', '10e0')}, 6) AS stable FROM fx_targets""")
def _(t):
    there = (F.lit(180.0), F.lit(10.0))
    return t.targets.select("target_id", r6(S.separation("ra", "dec", *there), "haversine"),
                            r6(S.separation_stable("ra", "dec", *there), "stable"))


@query("flat_separation", f"SELECT target_id, round({Q.flat('w1_ra', 'w1_dec', 'w4_ra', 'w4_dec')}*3600, 6) AS sep_arcsec FROM fx_photometry")
def _(t):
    return t.photometry.select("target_id", r6(S.separation_flat("w1_ra", "w1_dec", "w4_ra", "w4_dec") * 3600, "sep_arcsec"))


@query("proper_motion_propagation", f"""SELECT target_id,
    round({Q.mod360('ra + pmra/3.6e6*(-16e0)/cos(radians(dec))')}, 6) AS ra_2000,
    round(dec - 16e0*pmdec/3.6e6, 6) AS dec_2000 FROM fx_targets""")
def _(t):
    ra, dec = S.propagate("ra", "dec", "pmra", "pmdec", F.lit(2016.0), F.lit(2000.0))
    return t.targets.select("target_id", r6(ra, "ra_2000"), r6(dec, "dec_2000"))


@query("galactic_coordinates", f"""SELECT target_id, round({Q.gal_lat('ra', 'dec')}, 6) AS lat,
    round({Q.mod360('122.932e0 - degrees(atan2(cos(radians(dec))*sin(radians(ra-192.8595e0)), sin(radians(dec))*cos(radians(27.1284e0)) - cos(radians(dec))*sin(radians(27.1284e0))*cos(radians(ra-192.8595e0))))')}, 6) AS lon
    FROM fx_targets""")
def _(t):
    return t.targets.select("target_id", r6(S.galactic_latitude("ra", "dec"), "lat"), r6(S.galactic_longitude("ra", "dec"), "lon"))


@query("cartesian_position", """SELECT target_id, round(distance_pc*cos(radians(dec))*cos(radians(ra)), 6) AS x,
    round(distance_pc*cos(radians(dec))*sin(radians(ra)), 6) AS y, round(distance_pc*sin(radians(dec)), 6) AS z FROM fx_targets""")
def _(t):
    x, y, z = S.cartesian("ra", "dec", "distance_pc")
    return t.targets.select("target_id", r6(x, "x"), r6(y, "y"), r6(z, "z"))


@query("unit_sphere_chord", """SELECT host_id, round(cos(radians(dec))*cos(radians(ra)), 6) AS ux, round(cos(radians(dec))*sin(radians(ra)), 6) AS uy,
    round(sin(radians(dec)), 6) AS uz, round(2*sin(radians(period_days)/2), 6) AS chord FROM fx_hosts""")
def _(t):
    x, y, z = S.unit_vector("ra", "dec")
    return t.hosts.select("host_id", r6(x, "ux"), r6(y, "uy"), r6(z, "uz"), r6(S.chord("period_days"), "chord"))


@query("ecliptic_to_equatorial", f"""SELECT event_id,
    round({Q.mod360('degrees(atan2(sin(radians(ra))*cos(radians(23.4393e0)) - tan(radians(dec))*sin(radians(23.4393e0)), cos(radians(ra))))')}, 6) AS eq_ra,
    round(degrees(asin(sin(radians(dec))*cos(radians(23.4393e0)) + cos(radians(dec))*sin(radians(23.4393e0))*sin(radians(ra)))), 6) AS eq_dec
    FROM fx_neutrinos""")
def _(t):
    ra, dec = S.ecliptic_to_equatorial("ra", "dec")
    return t.neutrinos.select("event_id", r6(ra, "eq_ra"), r6(dec, "eq_dec"))


_HMS = "concat(CAST(CAST(p_partkey % 24 AS INT) AS STRING), ':', CAST(CAST(p_partkey*7 % 60 AS INT) AS STRING), ':', CAST(CAST(p_size AS INT) AS STRING), '.5')"
_DMS = "concat(CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '+' END, CAST(CAST(p_partkey % 90 AS INT) AS STRING), ' ', CAST(CAST(p_size AS INT) AS STRING), ' ', CAST(CAST(p_partkey % 60 AS INT) AS STRING))"


@query("sexagesimal_to_degrees", """SELECT p_partkey, round(15e0*(p_partkey % 24 + (p_partkey*7 % 60)/6e1 + (p_size + 0.5e0)/3.6e3), 6) AS ra,
    round((CASE WHEN p_partkey % 2 = 0 THEN -1e0 ELSE 1e0 END)*(p_partkey % 90 + p_size/6e1 + (p_partkey % 60)/3.6e3), 6) AS dec FROM part""")
def _(t):
    df = t.part.selectExpr("p_partkey", f"{_HMS} AS ra_text", f"{_DMS} AS dec_text")
    return df.select("p_partkey", r6(S.from_sexagesimal("ra_text", True), "ra"), r6(S.from_sexagesimal("dec_text", False), "dec"))


_BANDS = ", ".join(f"('{b}', \"{b}\")" for b in P.ZERO_POINT_JY)
_ZP = ", ".join(f"('{b}', {P.ZERO_POINT_JY[b]!r}, {P.DEFAULT_MAG_ERROR[b]!r}, {P.EXTINCTION[b]!r})" for b in P.ZERO_POINT_JY)
LONG_SQL = "SELECT target_id, u.band, u.mag FROM fx_photometry, LATERAL (VALUES " + _BANDS + ") u(band, mag) WHERE u.mag IS NOT NULL"


def long_bands(df, bands=tuple(P.ZERO_POINT_JY), key="target_id"):
    """One row per target and band with a magnitude."""
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("mag")) for b in bands]))
    return df.select(key, rows.alias("p")).select(key, "p.band", "p.mag").filter(F.col("mag").isNotNull())


@query("magnitude_flux", f"""WITH b AS ({LONG_SQL}), z(band, zp, err, ext) AS (VALUES {_ZP})
    SELECT target_id, band, round(zp*pow(10e0, -0.4e0*mag), 9) AS flux, round(mag, 6) AS mag_back,
    round(zp*pow(10e0, -0.4e0*mag)*ln(10e0)*0.4e0*err, 9) AS flux_err FROM b JOIN z USING (band)""")
def _(t):
    f = P.mag_to_flux("mag", "band")
    return long_bands(t.photometry).select(
        "target_id", "band", F.round(f, 9).alias("flux"), r6(P.flux_to_mag(f, "band"), "mag_back"),
        F.round(P.flux_error("mag", P.default_error("band"), "band"), 9).alias("flux_err"))


@query("planck_radiance", """SELECT target_id, round(2*6.62607015e-34*2.99792458e8/pow(4.603e-6, 3)/(exp(least(500e0, 6.62607015e-34*2.99792458e8/(4.603e-6*1.380649e-23*teff))) - 1)*1e12, 6) AS radiance FROM fx_targets""")
def _(t):
    return t.targets.select("target_id", r6(P.planck(F.lit(4.603e-6), "teff") * 1e12, "radiance"))


@query("extinction_per_band", f"""WITH z(band, zp, err, ext) AS (VALUES {_ZP}), e AS (SELECT source_id, (size*7 % 50)/1e2*(size % 3)/2e0 AS ebv FROM fx_pool)
    SELECT source_id, band, round(ext*ebv, 6) AS extinction,
    CASE WHEN ebv < 0.01 THEN 'NEGLIGIBLE' WHEN ebv < 0.05 THEN 'LOW' WHEN ebv < 0.3 THEN 'MODERATE' ELSE 'HIGH' END AS concern FROM e, z""")
def _(t):
    df = t.pool.selectExpr("source_id", "(size*7 % 50)/1e2*(size % 3)/2e0 AS ebv")
    df = df.withColumn("band", F.explode(F.array(*[F.lit(b) for b in P.EXTINCTION])))
    return df.select("source_id", "band", r6(P.extinction("band", "ebv"), "extinction"), P.extinction_concern("ebv").alias("concern"))


_RIDGE_ROWS = ", ".join(f"({a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE)" for a, b in zip(P.RIDGE, P.RIDGE[1:]))
RIDGE_SQL = f"(SELECT min(y0 + (bp_rp - x0)/(x1 - x0)*(y1 - y0)) FROM (VALUES {_RIDGE_ROWS}) k(x0, y0, x1, y1) WHERE bp_rp BETWEEN x0 AND x1)"


@query("main_sequence_ridge", f"SELECT target_id, round({RIDGE_SQL}, 6) AS ridge FROM fx_targets")
def _(t):
    return t.targets.select("target_id", r6(P.ridge_magnitude("bp_rp"), "ridge"))


MS_POLY = "(1e0 + 4.2e0*bp_rp - 0.6e0*pow(bp_rp, 2) + 0.15e0*pow(bp_rp, 3) - 0.01e0*pow(bp_rp, 4))"


@query("main_sequence_polynomial", f"""SELECT target_id, round({MS_POLY}, 6) AS expected, round(0.4e0 + 0.1e0*abs(bp_rp), 6) AS scatter,
    bp_rp >= 0.8e0 AND g + 5*log10(parallax) - 10 < -2 + 2.5e0*bp_rp + 1 AS is_giant FROM fx_targets""")
def _(t):
    return t.targets.select(
        "target_id", r6(P.sequence_magnitude("bp_rp"), "expected"), r6(P.sequence_scatter("bp_rp"), "scatter"),
        P.on_giant_branch("bp_rp", P.absolute_magnitude("g", "parallax")).alias("is_giant"))


@query("saturation_score", "SELECT target_id, round(least(1e0, greatest(0e0, 1 - exp(-(ruwe - 1)/1e0))), 6) AS ruwe_score, round(least(1e0, greatest(0e0, 1 - exp(-aen_sig/5e0))), 6) AS noise_score FROM fx_targets")
def _(t):
    return t.targets.select("target_id", r6(N.saturate(F.col("ruwe") - 1.0, 1.0), "ruwe_score"), r6(N.saturate("aen_sig", 5.0), "noise_score"))


@query("normal_tail_functions", f"""WITH x AS (SELECT o_orderkey, (o_orderkey*37 % 1600)/1e2 - 8e0 AS z, (1 + o_orderkey*61 % 99998)/1e5 AS p FROM orders)
    SELECT o_orderkey, round({Q.normal_tail('z')}, 9) AS tail, round({Q.normal_tail_inverse('p')}, 6) AS inverse, round({Q.sigma_of_p('p')}, 6) AS sigma FROM x""")
def _(t):
    df = t.orders.selectExpr("o_orderkey", "(o_orderkey*37 % 1600)/1e2 - 8e0 AS z", "(1 + o_orderkey*61 % 99998)/1e5 AS p")
    return df.select("o_orderkey", F.round(N.normal_tail(F.col("z")), 9).alias("tail"),
                     r6(N.normal_tail_inverse(F.col("p")), "inverse"), r6(N.sigma_of_p(F.col("p")), "sigma"))


def _digits(p, small):
    """Nine digits, and seven where the SQL adds up hundreds of terms and more."""
    return F.when(small, F.round(p, 9)).otherwise(F.round(p, 7))


@query("poisson_tail", f"""WITH x AS (SELECT c_custkey, c_custkey % 25 AS n, (c_custkey*7 % 200)/1e1 AS rate FROM customer),
    y AS (SELECT c_custkey, 1000 + c_custkey*13 % 5000 AS n, 1000 + c_custkey*13 % 5000 + (c_custkey % 9 - 4)*3e1 AS rate FROM customer)
    SELECT c_custkey, n, round({Q.poisson_tail('n', 'rate')}, CASE WHEN n < 1000 THEN 9 ELSE 7 END) AS p FROM (FROM x UNION ALL FROM y)""")
def _(t):
    df = t.customer.selectExpr("c_custkey", "c_custkey % 25 AS n", "(c_custkey*7 % 200)/1e1 AS rate")
    large = t.customer.selectExpr("c_custkey", "1000 + c_custkey*13 % 5000 AS n", "1000 + c_custkey*13 % 5000 + (c_custkey % 9 - 4)*3e1 AS rate")
    return df.unionByName(large).select("c_custkey", "n", _digits(N.poisson_tail(F.col("n"), F.col("rate")), F.col("n") < 1000).alias("p"))


@query("chi_square_tail_even", f"""WITH x AS (SELECT c_custkey, 1 + c_custkey % 10 AS pairs, (c_custkey*7 % 600)/1e1 AS x FROM customer),
    y AS (SELECT c_custkey, 100 + c_custkey*13 % 3000 AS pairs, 200 + 2*(c_custkey*13 % 3000) + (c_custkey % 9 - 4)*3e1 AS x FROM customer)
    SELECT c_custkey, pairs, round({Q.even_chi_square_tail('x', 'pairs')}, CASE WHEN pairs < 100 THEN 9 ELSE 7 END) AS p FROM (FROM x UNION ALL FROM y)""")
def _(t):
    df = t.customer.selectExpr("c_custkey", "1 + c_custkey % 10 AS pairs", "(c_custkey*7 % 600)/1e1 AS x")
    large = t.customer.selectExpr("c_custkey", "100 + c_custkey*13 % 3000 AS pairs", "200 + 2*(c_custkey*13 % 3000) + (c_custkey % 9 - 4)*3e1 AS x")
    return df.unionByName(large).select("c_custkey", "pairs", _digits(N.chi_square_tail(F.col("x"), F.col("pairs") * 2), F.col("pairs") < 100).alias("p"))


@query("chi_square_tail_odd", f"""WITH x AS (SELECT c_custkey, c_custkey % 10 AS m, (1 + c_custkey*7 % 600)/1e1 AS x FROM customer), y AS (SELECT *, sqrt(x) AS z FROM x)
    SELECT c_custkey, round(2*{Q.normal_tail('z')} + coalesce(list_sum(list_transform(range(1, m + 1), lambda i: exp(-x/2 + (i - 0.5e0)*ln(x/2) - lgamma(i + 0.5e0)))), 0e0), 9) AS p FROM y""")
def _(t):
    df = t.customer.selectExpr("c_custkey", "c_custkey % 10 AS m", "(1 + c_custkey*7 % 600)/1e1 AS x")
    return df.select("c_custkey", F.round(N.chi_square_tail(F.col("x"), F.col("m") * 2 + 1), 9).alias("p"))


@query("trial_corrections", """WITH x AS (SELECT target_id, (1 + target_id*61 % 9999)/1e7 AS p FROM fx_targets), n AS (SELECT count(*) AS n FROM x)
    SELECT target_id, round(1 - pow(1 - p, n), 6) AS sidak, round(least(1e0, p*n), 6) AS bonferroni FROM x, n""")
def _(t):
    df = t.targets.selectExpr("target_id", "(1 + target_id*61 % 9999)/1e7 AS p")
    df = df.crossJoin(F.broadcast(t.customer.agg(F.count("*").alias("n"))))  # one row
    return df.select("target_id", r6(N.sidak(F.col("p"), F.col("n")), "sidak"), r6(N.bonferroni(F.col("p"), F.col("n")), "bonferroni"))


# Gravitational constant, solar mass, speed of light.
SHAPIRO_US = 2 * 6.674e-11 * 1.989e30 / 2.998e8 ** 3 * 1e6


def shapiro_delay_us(mass, sep_deg):
    phi = F.greatest(F.radians(sep_deg), F.lit(1e-10))
    return F.greatest(F.lit(0.0), F.lit(SHAPIRO_US) * mass * F.log(2.0 / phi))


def orbit_radius_au(period_days, mass):
    years = period_days / 365.25
    return F.pow(mass * years * years, F.lit(1 / 3))


@query("shapiro_delay", f"SELECT host_id, round(greatest(0e0, {SHAPIRO_US!r}::DOUBLE*st_mass*ln(2/greatest(radians(insol/10), 1e-10))), 6) AS delay_us FROM fx_hosts")
def _(t):
    return t.hosts.select("host_id", F.when(F.col("insol").isNull(), F.lit(SHAPIRO_US * 1.0) * F.col("st_mass") * F.log(F.lit(2 / 1e-10)))
                          .otherwise(shapiro_delay_us(F.col("st_mass"), F.col("insol") / 10)).alias("d")).select("host_id", r6(F.col("d"), "delay_us"))


@query("orbit_radius", "SELECT host_id, round(pow(st_mass*pow(period_days/365.25e0, 2), 1e0/3), 6) AS radius_au FROM fx_hosts")
def _(t):
    return t.hosts.select("host_id", r6(orbit_radius_au(F.col("period_days"), F.col("st_mass")), "radius_au"))


HARMONIC_SQL = """SELECT key, arg_min(n, (resid, side, absn)) AS harmonic, min(resid) AS resid FROM (
    SELECT key, n, abs(n) AS absn, CASE WHEN n > 0 THEN 0 ELSE 1 END AS side,
    abs((CASE WHEN n > 0 THEN interval_d/period_d ELSE period_d/interval_d END) - abs(n))/abs(n) AS resid
    FROM h, (SELECT unnest(range(1, 11)) AS n UNION ALL SELECT -unnest(range(1, 11))) k) GROUP BY key"""


@query("harmonic_period_match", f"""WITH h AS (SELECT o_orderkey AS key, 1e0 + (o_orderkey*7 % 1000)/7e0 AS interval_d, 1e0 + (o_orderkey*11 % 500)/3e0 AS period_d FROM orders),
    m AS ({HARMONIC_SQL})
    SELECT key AS o_orderkey, CASE WHEN resid < 1 THEN harmonic ELSE 0 END AS harmonic, round(least(resid, 1e0), 6) AS residual, resid < 0.05 AS is_match FROM m""")
def _(t):
    df = t.orders.selectExpr("o_orderkey", "1e0 + (o_orderkey*7 % 1000)/7e0 AS i", "1e0 + (o_orderkey*11 % 500)/3e0 AS p")
    df = df.withColumn("m", N.harmonic_match(F.col("i"), F.col("p")))
    return df.select("o_orderkey", F.col("m.harmonic").cast("bigint").alias("harmonic"), r6(F.col("m.residual"), "residual"), F.col("m.is_match").alias("is_match"))


@query("safe_number", """SELECT event_id, TRY_CAST(txt AS DOUBLE) AS value FROM (SELECT event_id,
    CASE event_id % 4 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE '1.5e1' END AS txt FROM events)""")
def _(t):
    df = t.events.selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE '1.5e1' END AS txt")
    return df.select("event_id", N.safe_number("txt").alias("value"))


@query("catalog_names", """SELECT pulsar_id, regexp_replace(lower(trim(name)), '^[jb]+', '') AS bare_name,
    printf('%02d%02d%s%02d%02d', floor(ra/15)::BIGINT, floor((ra/15 - floor(ra/15))*60)::BIGINT, CASE WHEN dec >= 0 THEN '+' ELSE '-' END,
    floor(abs(dec))::BIGINT, floor((abs(dec) - floor(abs(dec)))*60)::BIGINT) AS position_name FROM fx_pulsars""")
def _(t):
    return t.pulsars.select("pulsar_id", T.pulsar_key("name").alias("bare_name"), T.position_name("ra", "dec").alias("position_name"))


_PATH = "concat('/data/quick_run_2024', lpad(CAST(1 + o_orderkey % 12 AS STRING), 2, '0'), lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'), '_', lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), '3015', CASE WHEN o_orderkey % 10 = 0 THEN '.txt' ELSE '.json' END)"


@query("report_timestamp", f"""SELECT o_orderkey, CAST(strptime(nullif(regexp_extract({_PATH}, 'quick_run_(\\d{{8}}_\\d{{6}})\\.json', 1), ''), '%Y%m%d_%H%M%S') AS STRING) AS stamp FROM orders""")
def _(t):
    return t.orders.selectExpr("o_orderkey", f"{_PATH} AS path").select("o_orderkey", F.date_format(T.report_time("path"), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("explanation_patterns", """SELECT row_id, template AS template_name, unexplainability AS unexplained FROM (SELECT row_id, template, unexplainability FROM fx_report_rows)""")
def _(t):
    df = t.report_rows.select("row_id", F.array(
        F.lit("no match here"),
        F.coalesce(F.concat(F.lit("matches '"), "template", F.lit("' template")), F.lit("none at all")),
        F.concat(F.lit("unexplainability="), F.format_string("%.3f", "unexplainability")),
    ).alias("texts"))
    return df.select("row_id", T.first_match("texts", T.TEMPLATE_NAME).alias("template_name"),
                     T.first_match("texts", T.UNEXPLAINED_NUMBER).try_cast("double").alias("unexplained"))


@query("observing_run_label", """SELECT event_id, CASE WHEN gps BETWEEN 1126051217 AND 1137254417 THEN 'O1' WHEN gps BETWEEN 1164556817 AND 1187733618 THEN 'O2'
    WHEN gps BETWEEN 1238112018 AND 1253977218 THEN 'O3a' WHEN gps BETWEEN 1256655618 AND 1269363618 THEN 'O3b' WHEN gps > 1269363618 THEN 'O4+' END AS run FROM fx_gw""")
def _(t):
    return t.gw.select("event_id", T.observing_run("gps").alias("run"))


@query("active_channel_map", """SELECT target_id, list_sort(list(channel) FILTER (score > 0.3)) AS active, count(*) FILTER (score > 0.3) AS n_active, max(score) AS top_score
    FROM fx_scores GROUP BY target_id""")
def _(t):
    # A target has at most one row per channel, so its map is small.
    m = t.scores.filter("score IS NOT NULL").groupBy("target_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", "score"))).alias("m"))
    active = F.map_filter("m", lambda k, v: v > 0.3)
    return m.select("target_id", F.when(F.size(active) > 0, F.array_sort(F.map_keys(active))).alias("active"), F.size(active).cast("bigint").alias("n_active"),
                    F.array_max(F.map_values("m")).alias("top_score"))
