"""Sky joins: cones, nearest neighbours, exclusion, two epochs and wide profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions import sphere as S
from skysift.operators.associations import epoch_changes
from skysift.operators.skyjoin import ARCSEC, best_within, counts_within, nearest, pairs, tasks_for, without_nearby
from skysift.plans import sqltext as Q
from skysift.plans.catalogs import near_sql
from skysift.plans.registry import query
from skysift.sources.readers import layer


def r6(c, name):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name)


@query("sky_cone_join", f"SELECT host_id, event_id, round(sep_deg, 6) AS sep_deg FROM ({Q.cone('fx_hosts', 'fx_neutrinos', '2e0', 'host_id', 'a.host_id, b.event_id', zone=2)})")
def _(t):
    df = pairs(t.hosts.select("host_id", "ra", "dec"), t.neutrinos.select("event_id", "ra", "dec"), 2.0)
    return df.select("host_id", F.col("r_event_id").alias("event_id"), r6("sep_deg", "sep_deg"))


@query("nearest_match", f"SELECT target_id, r_key AS source_id, round(sep_deg*3600, 4) AS sep_arcsec FROM ({near_sql('1', 3.5)})")
def _(t):
    near = nearest(t.targets.select("target_id", "ra", "dec"), t.shifted.select("source_id", "ra", "dec"), 3.5 * ARCSEC, left_key="target_id", right_key="source_id")
    return near.select("target_id", F.col("r_source_id").alias("source_id"), F.round(F.col("sep_deg") * 3600, 4).alias("sep_arcsec"))


def _moved(df, key, epoch_from, epoch_to):
    ra, dec = S.propagate("ra", "dec", "pmra", "pmdec", F.lit(epoch_from), F.lit(epoch_to))
    return df.select(key, ra.alias("ra"), dec.alias("dec"))


_MOVE = "SELECT {k}, " + Q.mod360("ra + pmra/3.6e6*{dt}/cos(radians(dec))").replace("{", "{") + " AS ra, dec + pmdec/3.6e6*{dt} AS dec FROM {src}"


@query("epoch_propagated_match", "WITH a AS (" + _MOVE.format(k="target_id", dt="1e1", src="fx_targets") + "), b AS (" + _MOVE.format(k="source_id", dt="1.5e1", src="fx_shifted")
       + f") SELECT target_id, r_key AS source_id, round(sep_deg*3600, 4) AS sep_arcsec FROM ({near_sql('1', 5.5, left='a', right='b')})")
def _(t):
    a = _moved(t.targets, "target_id", 2016.0, 2026.0)
    b = _moved(t.shifted, "source_id", 2011.0, 2026.0)
    near = nearest(a, b, 5.5 * ARCSEC, left_key="target_id", right_key="source_id")
    return near.select("target_id", F.col("r_source_id").alias("source_id"), F.round(F.col("sep_deg") * 3600, 4).alias("sep_arcsec"))


_POINT = Q.sep("45e0", "2e1", "ra", "dec")


@query("position_in_catalogs", f"""WITH c AS (SELECT 'targets' AS catalog, target_id AS id, {_POINT} AS s FROM fx_targets UNION ALL SELECT 'pool', source_id, {_POINT} FROM fx_pool UNION ALL SELECT 'hosts', host_id, {_POINT} FROM fx_hosts)
    SELECT catalog, arg_min(id, (s, id)) AS id, round(min(s), 6) AS sep_deg, min(s) <= 1.5 AS matched FROM c GROUP BY catalog""")
def _(t):
    parts = [("targets", t.targets, "target_id"), ("pool", t.pool, "source_id"), ("hosts", t.hosts, "host_id")]
    union = None
    for name, df, key in parts:
        rows = df.select(F.lit(name).alias("catalog"), F.col(key).alias("id"), S.separation(F.lit(45.0), F.lit(20.0), "ra", "dec").alias("s"))
        union = rows if union is None else union.unionByName(rows)
    best = union.groupBy("catalog").agg(F.min(F.struct("s", "id")).alias("b"))
    return best.select("catalog", F.col("b.id").alias("id"), r6("b.s", "sep_deg"), (F.col("b.s") <= 1.5).alias("matched"))


@query("batch_catalog_match", f"""WITH c AS (SELECT source_id, ra, dec, survey AS catalog FROM fx_shifted UNION ALL SELECT source_id, ra, dec, 'gamma' FROM fx_gamma),
    m AS ({Q.cone('fx_targets', 'c', '4.5e0/3.6e3', 'target_id', 'a.target_id, b.source_id, b.catalog')}) SELECT target_id, catalog, arg_min(source_id, (sep_deg, source_id)) AS source_id FROM m GROUP BY ALL""")
def _(t):
    stacked = t.shifted.select("source_id", "ra", "dec", F.col("survey").alias("catalog")).unionByName(t.gamma.select("source_id", "ra", "dec", F.lit("gamma").alias("catalog")))
    near = nearest(t.targets.select("target_id", "ra", "dec"), stacked, 4.5 * ARCSEC, left_key="target_id", right_key="source_id", by=["catalog"])
    return near.select("target_id", F.col("r_catalog").alias("catalog"), F.col("r_source_id").alias("source_id"))


_ERR_A = "(1e1 + (target_id % 30)*4e1)"


@query("uncertainty_aware_match", f"""WITH a AS (SELECT target_id, ra, dec, {_ERR_A} AS err_a FROM fx_targets), m AS ({Q.cone('a', 'fx_shifted', '1e1/3.6e3', 'target_id', 'a.target_id, a.err_a, b.source_id, b.err_mas')})
    SELECT target_id, arg_min(source_id, (sep_deg, source_id)) AS source_id FROM m WHERE sep_deg*3600 <= greatest(1.5e0, 3*sqrt(err_a*err_a + err_mas*err_mas)/1e3) GROUP BY target_id""")
def _(t):
    a = t.targets.selectExpr("target_id", "ra", "dec", f"{_ERR_A} AS err_a")
    found = pairs(a, t.shifted.select("source_id", "ra", "dec", "err_mas"), 10.0 * ARCSEC)
    both = F.sqrt(F.col("err_a") * F.col("err_a") + F.col("r_err_mas") * F.col("r_err_mas"))
    ok = found.filter(F.col("sep_deg") * 3600 <= F.greatest(F.lit(1.5), 3.0 * both / 1000.0))
    return ok.groupBy("target_id").agg(F.min(F.struct("sep_deg", "r_source_id")).alias("b")).select("target_id", F.col("b.r_source_id").alias("source_id"))


FLUX_CORRECTION = (3.0 / 1.4) ** -0.7
CHANGES_SQL = f"""m AS (SELECT * FROM ({Q.cone('fx_epoch1', 'fx_epoch2', '15.5e0/3.6e3', 'id', 'a.*, b.id AS id2, b.flux AS flux2, b.flux_err AS err2')}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY sep_deg, id2) = 1),
    s AS (SELECT *, flux*{FLUX_CORRECTION!r}::DOUBLE AS f1, coalesce(flux_err, 0.5)*{FLUX_CORRECTION!r}::DOUBLE AS e1, coalesce(err2, 0.3)::DOUBLE AS e2 FROM m WHERE flux > 0),
    changes AS (SELECT id2 AS id, CASE WHEN flux2 > f1 THEN 'brightened' ELSE 'dimmed' END AS change_type, flux2/f1 AS flux_ratio, (flux2 - f1)/sqrt(e1*e1 + e2*e2) AS sigma_change FROM s WHERE abs((flux2 - f1)/sqrt(e1*e1 + e2*e2)) >= 3
    UNION ALL SELECT id, 'appeared', NULL, NULL FROM fx_epoch2 WHERE id NOT IN (SELECT id2 FROM m) UNION ALL SELECT id, 'disappeared', NULL, NULL FROM fx_epoch1 WHERE id NOT IN (SELECT id FROM m))"""


@query("appeared_disappeared", f"WITH {CHANGES_SQL} SELECT change_type, count(*) AS n FROM changes GROUP BY 1")
def _(t):
    return epoch_changes(t.epoch1, t.epoch2, 15.5 * ARCSEC, FLUX_CORRECTION).groupBy("change_type").agg(F.count("*").alias("n"))


@query("changes_near_hosts", f"""WITH {CHANGES_SQL}, p AS (SELECT c.*, e.ra, e.dec FROM changes c JOIN (SELECT id, ra, dec FROM fx_epoch1 UNION SELECT id, ra, dec FROM fx_epoch2) e USING (id)),
    h AS (SELECT id, arg_min(host_star, (sep_deg, host_id)) AS host FROM ({Q.cone('p', 'fx_hosts', '1e0', 'id', 'a.id, b.host_id, b.host_star', zone=1)}) GROUP BY id)
    SELECT p.id, p.change_type, h.host IS NOT NULL AS near_host, h.host FROM p LEFT JOIN h USING (id)""")
def _(t):
    changes = epoch_changes(t.epoch1, t.epoch2, 15.5 * ARCSEC, FLUX_CORRECTION)
    where = t.epoch1.select("id", "ra", "dec").unionByName(t.epoch2.select("id", "ra", "dec")).dropDuplicates(["id"])
    tasks = tasks_for(t.epoch1, t.epoch2)
    placed = changes.repartition(tasks, "id").join(where.repartition(tasks, "id"), "id")
    near = nearest(placed, t.hosts.select("host_id", "ra", "dec", "host_star"), 1.0, left_key="id", right_key="host_id", keep_unmatched=True, tasks=tasks)
    return near.select("id", "change_type", F.col("r_host_id").isNotNull().alias("near_host"), F.col("r_host_star").alias("host"))


@query("target_exclusion", """WITH hit AS (SELECT DISTINCT s.source_id FROM fx_shifted s, (VALUES (-1), (0), (1)) o(k), fx_hosts h WHERE floor((h.dec + 90)/0.1) = floor((s.dec + 90)/0.1) + o.k
    AND abs(s.dec - h.dec) < 5.5e0/3.6e3 AND least(abs(s.ra - h.ra), 360 - abs(s.ra - h.ra))*greatest(cos(radians(h.dec)), 0.1e0) < 5.5e0/3.6e3)
    SELECT source_id FROM fx_shifted WHERE source_id NOT IN (SELECT host_id FROM fx_hosts WHERE host_id IS NOT NULL) AND source_id NOT IN (SELECT source_id FROM hit)""")
def _(t):
    by_id = t.shifted.join(t.hosts.select(F.col("host_id").alias("source_id")), "source_id", "left_anti")
    # The exclusion zone is a box, so candidates come from the circle around it.
    close = pairs(t.hosts.select("host_id", "ra", "dec"), by_id.select("source_id", "ra", "dec"), 60.0 * ARCSEC)
    dra = F.abs(F.col("ra") - F.col("r_ra"))
    box = (F.abs(F.col("dec") - F.col("r_dec")) < 5.5 * ARCSEC) & (F.least(dra, 360.0 - dra) * F.greatest(F.cos(F.radians("dec")), F.lit(0.1)) < 5.5 * ARCSEC)
    hit = close.filter(box).select(F.col("r_source_id").alias("source_id")).distinct()
    return by_id.join(hit, "source_id", "left_anti").select("source_id")


@query("sky_anti_join", f"SELECT source_id FROM fx_pool WHERE source_id NOT IN (SELECT source_id FROM ({Q.cone('fx_pool', 'fx_hosts', '3e0', 'source_id', 'a.source_id', zone=3)}))")
def _(t):
    return without_nearby(t.pool, t.hosts.select("ra", "dec"), 3.0, left_key="source_id").select("source_id")


@query("wide_profile", f"""WITH uv AS ({near_sql('b.flux AS v', 3.5)}), ir AS (SELECT target_id, count(*) AS n_epochs, round(avg(w1), 6) AS mean_w1 FROM fx_ir_epochs GROUP BY 1)
    SELECT t.target_id, p.W1 IS NOT NULL AS has_photometry, u.v AS uv_flux, i.n_epochs, i.mean_w1,
    list_filter([CASE WHEN p.W1 IS NOT NULL THEN 'photometry' END, CASE WHEN t.parallax IS NOT NULL THEN 'astrometry' END, CASE WHEN u.v IS NOT NULL THEN 'ultraviolet' END, CASE WHEN i.n_epochs IS NOT NULL THEN 'infrared_series' END], lambda x: x IS NOT NULL) AS layers
    FROM fx_targets t LEFT JOIN fx_photometry p USING (target_id) LEFT JOIN uv u USING (target_id) LEFT JOIN ir i USING (target_id)""")
def _(t):
    profile = wide_profile(t)
    return profile.select("target_id", F.col("photometry").isNotNull().alias("has_photometry"), F.col("ultraviolet.uv_flux").alias("uv_flux"),
                          F.col("infrared_series.n_epochs").alias("n_epochs"), F.col("infrared_series.mean_w1").alias("mean_w1"), "layers")


def wide_profile(t):
    """One row per target with a struct per wavelength layer and the list of layers it has."""
    uv = layer(t.targets, t.shifted, 3.5, {"uv_flux": "flux"})
    ir = t.ir_epochs.groupBy("target_id").agg(F.count("*").alias("n_epochs"), r6(F.avg("w1"), "mean_w1"))

    def packed(df, name):
        return df.select("target_id", F.struct(*[c for c in df.columns if c != "target_id"]).alias(name))

    out = t.targets.select("target_id", "ra", "dec")
    parts = {
        "photometry": t.photometry.select("target_id", "G", "J", "W1", "W2", "W3", "W4"),
        "astrometry": t.targets.select("target_id", "parallax", "pmra", "pmdec", "ruwe"),
        "ultraviolet": uv, "infrared_series": ir,
    }
    for name, df in parts.items():
        out = out.join(packed(df, name), "target_id", "left")
    layers = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), n) for n in parts]))
    return out.withColumn("layers", layers)


@query("attach_verdicts", "SELECT r.row_id, r.total_score, v.risk FROM fx_report_rows r LEFT JOIN (SELECT target_id, CASE WHEN ruwe > 4 THEN 'HIGH' ELSE 'LOW' END AS risk FROM fx_targets WHERE aen_sig > 2) v USING (target_id)")
def _(t):
    verdicts = t.targets.filter("aen_sig > 2").select("target_id", F.when(F.col("ruwe") > 4, "HIGH").otherwise("LOW").alias("risk"))
    return t.report_rows.join(verdicts, "target_id", "left").select("row_id", "total_score", "risk")


@query("bulk_catalog_match", f"SELECT source_id, r_key AS star_id, round(sep_deg*3600, 4) AS sep_arcsec FROM ({near_sql('1', 4.5, left='fx_shifted', right='fx_targets', lk='source_id', rk='target_id')})")
def _(t):
    near = nearest(t.shifted.select("source_id", "ra", "dec"), t.targets.select("target_id", "ra", "dec"), 4.5 * ARCSEC, left_key="source_id", right_key="target_id")
    return near.select("source_id", F.col("r_target_id").alias("star_id"), F.round(F.col("sep_deg") * 3600, 4).alias("sep_arcsec"))


@query("listed_positions", f"WITH m AS ({near_sql('b.g AS star_g', 6.5, left='fx_hosts', lk='host_id', right='fx_targets', rk='target_id').replace('a.*', 'a.host_id')}) SELECT h.host_id, m.r_key AS star_id, m.star_g FROM fx_hosts h LEFT JOIN m USING (host_id)")
def _(t):
    near = nearest(t.hosts.select("host_id", "ra", "dec"), t.targets.select("target_id", "ra", "dec", "g"), 6.5 * ARCSEC, left_key="host_id", right_key="target_id", keep_unmatched=True)
    return near.select("host_id", F.col("r_target_id").alias("star_id"), F.col("r_g").alias("star_g"))


@query("flat_cone", f"""SELECT host_id, event_id, round(s, 6) AS sep_deg FROM (SELECT a.host_id, b.event_id, {Q.flat('a.ra', 'a.dec', 'b.ra', 'b.dec')} AS s FROM fx_hosts a, (VALUES (-1), (0), (1)) o(k), fx_neutrinos b
    WHERE floor((b.dec + 90)/2.2) = floor((a.dec + 90)/2.2) + o.k AND abs(a.dec) < 80) WHERE s <= 2""")
def _(t):
    df = pairs(t.hosts.filter("abs(dec) < 80").select("host_id", "ra", "dec"), t.neutrinos.select("event_id", "ra", "dec"), 2.0, metric="flat", cell=2.2)
    return df.select("host_id", F.col("r_event_id").alias("event_id"), r6("sep_deg", "sep_deg"))


@query("top_sources_per_position", f"SELECT host_id, source_id, g FROM ({Q.cone('fx_hosts', 'fx_pool', '8e0', 'host_id', 'a.host_id, b.source_id, b.g', zone=8)}) QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY g, source_id) <= 5")
def _(t):
    df = best_within(t.hosts.select("host_id", "ra", "dec"), t.pool.select("source_id", "ra", "dec", "g"), 8.0, 5, left_key="host_id", order=["g", "source_id"])
    return df.select("host_id", F.col("r_source_id").alias("source_id"), F.col("r_g").alias("g"))


@query("batched_positions", f"SELECT host_id AS position_id, count(*) AS n_sources FROM ({Q.cone('fx_hosts', 'fx_pool', '6e0', 'host_id', 'a.host_id', zone=6)}) GROUP BY 1")
def _(t):
    return counts_within(t.hosts.select(F.col("host_id").alias("position_id"), "ra", "dec"), t.pool.select("ra", "dec"), {"n_sources": 6.0}, left_key="position_id")
