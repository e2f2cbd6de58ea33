"""Associations of events with hosts, merged target lists and joins in time."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skysift.functions import numeric as N
from skysift.operators import associations as A
from skysift.operators import temporal as T
from skysift.operators.skyjoin import ARCSEC, pairs
from skysift.plans import sqltext as Q
from skysift.plans.registry import query
from skysift.plans.scalars import HARMONIC_SQL


def r6(c, name):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name)


@query("gamma_host_association", f"""WITH s AS (SELECT source_id, ra, dec, (err_major_deg + err_minor_deg)*3e1 AS err FROM fx_gamma),
    p AS ({Q.cone('s', 'fx_hosts', 'greatest(1e1, a.err)/6e1', 'source_id', 'a.source_id, a.ra, a.dec, a.err, b.host_id', zone=1)}),
    u AS (SELECT DISTINCT source_id, ra, dec FROM p), d AS (SELECT source_id, count(*)/(pi()*25) AS density FROM ({Q.cone('u', 'fx_hosts', '5e0', 'source_id', 'a.source_id', zone=5)}) GROUP BY 1),
    q AS (SELECT p.*, density, 1 - exp(-pi()*density/3.6e3*pow(sep_deg*6e1, 2)) AS p_chance, (SELECT count(*) FROM fx_gamma)*(SELECT count(*) FROM fx_hosts) AS n FROM p JOIN d USING (source_id))
    SELECT source_id, host_id, round(sep_deg*6e1, 6) AS sep_arcmin, round(sep_deg*6e1/err, 6) AS sep_sigma, round(density, 6) AS density, round(p_chance, 6) AS p_chance, round(least(1e0, p_chance*n), 6) AS p_corrected,
    least(1e0, p_chance*n) < 0.01 AND sep_deg*6e1/err < 3 AS escalate FROM q""")
def _(t):
    df = A.gamma_hosts(t.gamma, t.hosts)
    return df.select("source_id", "host_id", *[r6(c, c) for c in ("sep_arcmin", "sep_sigma", "density", "p_chance", "p_corrected")], "escalate")


@query("neutrino_host_excess", f"""WITH c AS (SELECT host_id, count(*) FILTER (sep_deg <= 2) AS n_observed, count(*) FILTER (sep_deg > 4) AS n_ring FROM ({Q.cone('fx_hosts', 'fx_neutrinos', '1e1', 'host_id', 'a.host_id', zone=10)}) GROUP BY 1),
    e AS (SELECT *, CASE WHEN n_ring > 5 THEN n_ring/(pi()*84)*(pi()*4) ELSE (SELECT count(*) FROM fx_neutrinos)/41253e0*(pi()*4) END AS n_expected FROM c WHERE n_observed > 0), p AS (SELECT *, {Q.poisson_tail('n_observed', 'n_expected')} AS p FROM e)
    SELECT host_id, n_observed, n_ring, round(n_expected, 6) AS n_expected, round(p, 6) AS p, round({Q.sigma_of_p('p')}, 5) AS sigma, least(1e0, p*(SELECT count(*) FROM fx_hosts)) < 0.0027 AS significant FROM p""")
def _(t):
    df = A.neutrino_excess(t.hosts, t.neutrinos)
    return df.select("host_id", "n_observed", "n_ring", r6("n_expected", "n_expected"), r6("p", "p"), F.round("sigma", 5).alias("sigma"), "significant")


_GW = "(SELECT event_id, ra, dec, CASE WHEN area > 0 THEN area ELSE pi()*100 END AS used, CASE WHEN area > 0 THEN sqrt(area/pi()) ELSE 1e1 END AS radius FROM fx_gw)"


@query("merger_host_coincidence", f"""SELECT event_id, host_id, round(sep_deg, 6) AS sep_deg, round(1 - pow(1 - used/41253e0, (SELECT count(*) FROM fx_hosts)), 6) AS p_any, round((SELECT count(*) FROM fx_hosts)*used/41253e0, 6) AS n_expected,
    1 - pow(1 - used/41253e0, (SELECT count(*) FROM fx_hosts)) < 0.01 AS low_fa FROM ({Q.cone(_GW, 'fx_hosts', 'a.radius', 'event_id', 'a.event_id, a.used, b.host_id', zone=30)})""")
def _(t):
    return A.merger_hosts(t.gw, t.hosts).select("event_id", "host_id", r6("sep_deg", "sep_deg"), r6("p_any", "p_any"), r6("n_expected", "n_expected"), "low_fa")


@query("merger_excess_ratio", f"""WITH m AS ({Q.cone(_GW, 'fx_hosts', 'a.radius', 'event_id', 'a.event_id', zone=30)}) SELECT count(*) AS n_observed,
    round((SELECT sum((SELECT count(*) FROM fx_hosts)*used/41253e0) FROM {_GW} g), 6) AS n_expected, round(count(*)/(SELECT sum((SELECT count(*) FROM fx_hosts)*used/41253e0) FROM {_GW} g), 6) AS ratio FROM m""")
def _(t):
    n_obs = A.one_row(A.merger_hosts(t.gw, t.hosts), n_observed=F.count("*"))
    area = F.when(F.col("area") > 0, F.col("area")).otherwise(F.lit(math.pi * 100.0))
    total = t.gw.agg(F.sum(area).alias("area")).crossJoin(A.one_row(t.hosts, n=F.count("*"))).crossJoin(n_obs)
    expected = F.col("n") * F.col("area") / A.FULL_SKY
    return total.select("n_observed", r6(expected, "n_expected"), r6(F.col("n_observed") / expected, "ratio"))


def _bursts(t):
    return t.ir_epochs.select(F.col("target_id").alias("source_id"), "mjd")


_BURST_SQL = f"""b AS (SELECT target_id AS source_id, (max(mjd) - min(mjd))/(count(*) - 1) AS mi FROM fx_ir_epochs GROUP BY 1 HAVING count(*) > 1),
    p AS (SELECT c.*, b.mi FROM ({Q.cone('fx_bursts', 'fx_hosts', '1e1/6e1', 'source_id', 'a.source_id, b.host_id, b.period_days, b.st_mass', zone=1)}) c JOIN b USING (source_id)),
    h AS (SELECT source_id*100000 + host_id AS key, mi AS interval_d, period_days AS period_d FROM p), k AS ({HARMONIC_SQL})"""


@query("burst_orbit_match", f"""WITH {_BURST_SQL} SELECT source_id, host_id, round(sep_deg*6e1, 6) AS sep_arcmin, round(mi, 6) AS mean_interval, CASE WHEN resid < 1 THEN harmonic ELSE 0 END AS harmonic,
    round(least(1e0, resid), 6) AS residual, resid < 0.05 AS is_match, round(pow(st_mass*pow(mi/365.25e0, 2), 1e0/3), 6) AS radius_au FROM p JOIN k ON k.key = source_id*100000 + host_id""")
def _(t):
    df = A.burst_orbits(t.bursts, _bursts(t), t.hosts)
    return df.select("source_id", "host_id", r6("sep_arcmin", "sep_arcmin"), r6("mean_interval", "mean_interval"), F.col("harmonic").cast("bigint").alias("harmonic"),
                     r6("residual", "residual"), "is_match", r6("radius_au", "radius_au"))


@query("burst_orbit_significance", f"""WITH {_BURST_SQL}, c AS (SELECT count(*) FILTER (resid < 0.05) AS n_matches, count(*) AS n_spatial, 0.1e0*(SELECT count(*) FROM fx_bursts)*pi()*pow(1e1/6e1, 2)*(SELECT count(*) FROM fx_hosts)/41253e0 AS expected FROM p JOIN k ON k.key = source_id*100000 + host_id)
    SELECT n_matches, n_spatial, round(expected, 6) AS expected, round({Q.poisson_tail('n_matches', 'expected')}, 9) AS p FROM c""")
def _(t):
    found = A.burst_orbits(t.bursts, _bursts(t), t.hosts).agg(F.count_if("is_match").alias("n_matches"), F.count("*").alias("n_spatial"))
    one = found.crossJoin(A.one_row(t.bursts, b=F.count("*"))).crossJoin(A.one_row(t.hosts, h=F.count("*")))
    # One spatial coincidence in ten is expected to agree in period by chance.
    expected = 0.1 * F.col("b") * math.pi * (10 / 60) ** 2 * F.col("h") / A.FULL_SKY
    one = one.withColumn("e", expected)
    return one.select("n_matches", "n_spatial", r6("e", "expected"), F.round(N.poisson_tail(F.col("n_matches"), F.col("e")), 9).alias("p"))


@query("burst_intervals", "SELECT source_id, mjd, round(mjd - prev, 5) AS interval FROM (SELECT target_id AS source_id, mjd, lag(mjd) OVER (PARTITION BY target_id ORDER BY mjd) AS prev FROM fx_ir_epochs) WHERE prev IS NOT NULL")
def _(t):
    return A.intervals(_bursts(t), "source_id", "mjd").select("source_id", "mjd", F.round("interval", 5).alias("interval"))


# Search radii (degrees) of each messenger.
MESSENGER_RADII = {"gamma": 0.3, "neutrino": 1.5, "burst": 0.8, "pulsar": 0.1}


def messengers(t):
    return {"gamma": t.gamma, "neutrino": t.neutrinos, "burst": t.bursts, "pulsar": t.pulsars}


NEAR = {"gamma": "fx_gamma", "neutrino": "fx_neutrinos", "burst": "fx_bursts", "pulsar": "fx_pulsars"}


@query("gamma_neighbourhood_targets", f"""WITH u AS (SELECT source_id AS gid, ra, dec, greatest(err_major_deg, 5e-2) AS rad FROM fx_gamma WHERE source_class IN ('', 'unk') AND err_major_deg <= 0.15)
    SELECT gid, arg_min(target_id, (g, target_id)) AS target_id FROM ({Q.cone('u', 'fx_targets', '1e1*a.rad', 'gid', 'a.gid, b.target_id, b.g, b.parallax, b.parallax_error', zone=1.5)}) WHERE parallax/parallax_error > 5 GROUP BY gid""")
def _(t):
    u = t.gamma.filter(F.col("source_class").isin("", "unk") & (F.col("err_major_deg") <= 0.15)).select(
        F.col("source_id").alias("gid"), "ra", "dec", (F.greatest("err_major_deg", F.lit(0.05)) * 10.0).alias("rad"))
    stars = t.targets.filter("parallax/parallax_error > 5").select("target_id", "ra", "dec", "g")
    df = pairs(u, stars, F.col("rad"), cell=1.5)
    return df.groupBy("gid").agg(F.min(F.struct("r_g", "r_target_id")).alias("b")).select("gid", F.col("b.r_target_id").alias("target_id"))


HOT_SQL = """bins AS (SELECT floor(ra/10)::INT AS bi, floor((dec + 90)/10)::INT AS bj, count(*) AS n FROM fx_neutrinos WHERE energy_gev >= 1e4 GROUP BY 1, 2),
    dens AS (SELECT *, n/greatest(cos(radians(bj*10 - 85e0)), 0.01e0) AS density FROM bins), st AS (SELECT avg(density) AS m, stddev_pop(density) AS s FROM dens)"""


def hotspots(events, min_energy, size, sigma):
    """Sky bins whose event density stands out from the other bins."""
    bins = events.filter(F.col("energy_gev") >= min_energy).groupBy(
        F.floor(F.col("ra") / size).cast("int").alias("bi"), F.floor((F.col("dec") + 90) / size).cast("int").alias("bj")).agg(F.count("*").alias("n"))
    middle = F.col("bj") * size - 90.0 + size / 2
    dens = bins.withColumn("density", F.col("n") / F.greatest(F.cos(F.radians(middle)), F.lit(0.01)))
    stats = A.one_row(dens, mean=F.avg("density"), std=F.stddev_pop("density"), n_bins=F.count("*"))
    return dens.crossJoin(stats).withColumn("is_hot", (F.col("density") > F.col("mean") + sigma * F.col("std")) & (F.col("n_bins") >= 10))


@query("sky_hotspots", f"WITH {HOT_SQL} SELECT bi, bj, n, round(density, 6) AS density, density > m + 1*s AS is_hot FROM dens, st")
def _(t):
    return hotspots(t.neutrinos, 1e4, 10.0, 1.0).select("bi", "bj", "n", r6("density", "density"), "is_hot")


@query("hotspot_targets", f"""WITH {HOT_SQL}, hot AS (SELECT bi*100 + bj AS spot, bi*10e0 + 5 AS ra, bj*10e0 - 85 AS dec, density FROM dens, st WHERE density > m + 1*s ORDER BY density DESC, spot LIMIT 30)
    SELECT spot, arg_min(target_id, (g, target_id)) AS target_id FROM ({Q.cone('hot', 'fx_targets', '5e0', 'spot', 'a.spot, b.target_id, b.g', zone=5)}) GROUP BY spot""")
def _(t):
    hot = hotspots(t.neutrinos, 1e4, 10.0, 1.0).filter("is_hot").select(
        (F.col("bi") * 100 + F.col("bj")).alias("spot"), (F.col("bi") * 10.0 + 5).alias("ra"), (F.col("bj") * 10.0 - 85).alias("dec"), "density")
    hot = hot.orderBy(F.desc("density"), "spot").limit(30)
    df = pairs(hot, t.targets.select("target_id", "ra", "dec", "g"), 5.0)
    return df.groupBy("spot").agg(F.min(F.struct("r_g", "r_target_id")).alias("b")).select("spot", F.col("b.r_target_id").alias("target_id"))


_LISTS = """l AS (SELECT target_id*4 AS id, ra, dec, distance_pc, 'stars' AS channel FROM fx_targets UNION ALL SELECT source_id*4 + 1, ra, dec, 1e3/parallax, 'radio' FROM fx_shifted UNION ALL SELECT host_id*4 + 2, ra, dec, distance_pc, 'planets' FROM fx_hosts)"""


def channel_lists(t):
    """Target lists of all discovery channels, concatenated."""
    a = t.targets.selectExpr("target_id*4 AS id", "ra", "dec", "distance_pc", "'stars' AS channel")
    b = t.shifted.selectExpr("source_id*4 + 1 AS id", "ra", "dec", "1e3/parallax AS distance_pc", "'radio' AS channel")
    c = t.hosts.selectExpr("host_id*4 + 2 AS id", "ra", "dec", "distance_pc", "'planets' AS channel")
    return a.unionByName(b).unionByName(c, allowMissingColumns=True)


@query("union_channel_lists", f"WITH {_LISTS} SELECT channel, count(*) AS n, count(distance_pc) AS n_distance FROM l GROUP BY 1")
def _(t):
    return channel_lists(t).groupBy("channel").agg(F.count("*").alias("n"), F.count("distance_pc").alias("n_distance"))


@query("merge_channel_lists", f"""WITH RECURSIVE {_LISTS}, e AS (SELECT id AS x, id2 AS y FROM ({Q.cone('l', 'l', '5.5e0/3.6e3', 'id', 'a.id, b.id AS id2')})),
    r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), g AS (SELECT x AS id, min(y) AS group_id FROM r GROUP BY x)
    SELECT group_id, count(*) AS n, list_sort(list(DISTINCT channel)) AS channels, round(min(distance_pc), 6) AS distance_pc FROM g JOIN l USING (id) GROUP BY group_id""")
def _(t):
    df = A.merge_nearby(channel_lists(t), 5.5 * ARCSEC)
    return df.groupBy(F.col("label").alias("group_id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("channel")).alias("channels"), r6(F.min("distance_pc"), "distance_pc"))


_IR = "(SELECT target_id, mjd AS t, w1 AS v FROM fx_ir_epochs)"
_OPT = "(SELECT target_id, mjd AS t, mag AS v FROM fx_optical_epochs)"


def band_series(t):
    ir = t.ir_epochs.select("target_id", F.col("mjd").alias("t"), F.col("w1").alias("v"))
    opt = t.optical_epochs.select("target_id", F.col("mjd").alias("t"), F.col("mag").alias("v"))
    return opt, ir


ASOF_SQL = f"""b AS (SELECT i.target_id, i.t, i.v, o.t AS bt, o.v AS bv FROM {_IR} i ASOF LEFT JOIN {_OPT} o ON i.target_id = o.target_id AND i.t >= o.t),
    c AS (SELECT b.*, o.t AS at_, o.v AS av FROM b ASOF LEFT JOIN {_OPT} o ON b.target_id = o.target_id AND b.t < o.t),
    matched AS (SELECT target_id, t, v, CASE WHEN at_ IS NULL OR t - bt <= at_ - t THEN bt ELSE at_ END AS ot, CASE WHEN at_ IS NULL OR t - bt <= at_ - t THEN bv ELSE av END AS ov FROM c)"""


@query("nearest_in_time", f"WITH {ASOF_SQL} SELECT target_id, t, v, ot AS other_t, ov AS other_v FROM matched WHERE abs(ot - t) <= 30")
def _(t):
    opt, ir = band_series(t)
    return T.nearest_in_time(ir, opt, "target_id", 30.0)


@query("common_grid_correlation", f"""WITH o AS (SELECT target_id, t, pow(10e0, -0.4e0*(v - 14)) AS v FROM {_OPT} x), i AS (SELECT * FROM {_IR} x), s AS (SELECT target_id, count(*) AS n1, min(t) AS a1, max(t) AS b1 FROM o GROUP BY 1), u AS (SELECT target_id, count(*) AS n2, min(t) AS a2, max(t) AS b2 FROM i GROUP BY 1),
    k AS (SELECT target_id, greatest(a1, a2) AS a, least(b1, b2) AS b, least(100, n1, 5*n2) AS n FROM s JOIN u USING (target_id) WHERE n1 >= 10 AND n2 >= 5), g AS (SELECT target_id, a + (b - a)*q/(n - 1) AS t FROM (SELECT *, unnest(range(0, n)) AS q FROM k WHERE b > a)),
    x1 AS (SELECT g.*, o.t AS t0, o.v AS v0 FROM g ASOF LEFT JOIN o ON g.target_id = o.target_id AND g.t >= o.t), x2 AS (SELECT x1.*, o.t AS t1, o.v AS v1 FROM x1 ASOF LEFT JOIN o ON x1.target_id = o.target_id AND x1.t < o.t),
    x3 AS (SELECT x2.*, i.t AS t2, i.v AS v2 FROM x2 ASOF LEFT JOIN i ON x2.target_id = i.target_id AND x2.t >= i.t), x4 AS (SELECT x3.*, i.t AS t3, i.v AS v3 FROM x3 ASOF LEFT JOIN i ON x3.target_id = i.target_id AND x3.t < i.t),
    z AS (SELECT target_id, CASE WHEN t = t0 THEN v0 ELSE v0 + (v1 - v0)/(t1 - t0)*(t - t0) END AS p, CASE WHEN t = t2 THEN v2 ELSE v2 + (v3 - v2)/(t3 - t2)*(t - t2) END AS q FROM x4)
    SELECT target_id, count(*) AS n, round(corr(p, q), 6) AS r FROM z WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY 1""")
def _(t):
    opt, ir = band_series(t)
    flux = opt.withColumn("v", F.pow(F.lit(10.0), -0.4 * (F.col("v") - 14)))
    return T.correlation_summary(T.on_common_grid(flux, ir, "target_id"), "target_id").select("target_id", "n", r6("r", "r"))
