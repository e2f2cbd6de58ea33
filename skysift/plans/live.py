"""Streams over reports, and named tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.operators import detectors as D
from skysift.operators.registries import run_named
from skysift.operators.spatial import morans_i
from skysift.plans import sqltext as Q
from skysift.plans.catalogs import write_reports
from skysift.plans.populations import POINTS_SQL, scored_points
from skysift.plans.registry import query
from skysift.plans.scalars import MS_POLY
from skysift.session import scratch_path
from skysift.streaming import watch as W


def _folder(t):
    path = scratch_path(t.spark, "arriving")
    write_reports(t, path)
    return path


@query("report_watcher", "SELECT CAST(report AS STRING) AS report, target_id, total_score, n_active FROM fx_report_rows WHERE n_active >= 2 AND (unexplainability > 0.5 OR is_fdr)")
def _(t):
    found = W.drain(W.candidates(W.report_stream(t.spark, _folder(t))), t.spark, "watched")
    return found.select("report", "target_id", "total_score", "n_active")


@query("live_progress", "SELECT CAST(report AS STRING) AS report, count(*) AS gathered, count(*) AS total, max(total_score) AS best FROM fx_report_rows GROUP BY 1")
def _(t):
    sizes = t.report_rows.groupBy(F.col("report").cast("string").alias("report")).agg(F.count("*").alias("total"))
    return W.live_progress(W.report_stream(t.spark, _folder(t)), sizes, t.spark)


@query("cross_poll_dedup", "SELECT DISTINCT o_custkey AS target_id FROM orders")
def _(t):
    schema = t.orders.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(t.folder)
    stream = stream.select(F.col("o_custkey").alias("target_id"), F.col("o_orderdate").cast("timestamp").alias("seen_at"))
    return W.drain(W.first_seen(stream, "target_id", "seen_at", "5000 days"), t.spark, "first-seen").select("target_id")


# Method name -> one-row table with its detection score.
VALIDATORS = {
    "ir_excess": lambda t: t.signals.agg((0.5 * F.avg((F.col("sigma_w3") > 3).cast("int")) + 0.5 * (1.0 - F.exp(-F.avg("sigma_w3") / 6.0))).alias("detection")),
    "radio_search": lambda t: t.signals.filter("n_radio_hits > 0").agg((1.0 - F.exp(-F.max("hit_snr") / 20.0)).alias("detection")),
    "dimming": lambda t: t.signals.agg(F.avg("dimming_score").alias("detection")),
}
_NAMES = ("ir_excess", "radio_search", "dimming", "not_registered")


@query("validator_registry", """WITH d(name, detection) AS (SELECT 'ir_excess', 0.5*avg((sigma_w3 > 3)::INT) + 0.5*(1 - exp(-avg(sigma_w3)/6)) FROM fx_signals UNION ALL SELECT 'radio_search', 1 - exp(-max(hit_snr)/20) FROM fx_signals WHERE n_radio_hits > 0 UNION ALL SELECT 'dimming', avg(dimming_score) FROM fx_signals UNION ALL SELECT 'not_registered', NULL)
    SELECT name, round(detection, 6) AS detection, CASE WHEN detection > 0.5 THEN 'UNEXPLAINED' ELSE 'INCONCLUSIVE' END AS status FROM d""")
def _(t):
    return run_named(VALIDATORS, _NAMES, t, t.signals).withColumn("detection", F.round("detection", 6))


HYPOTHESES = {
    "stellar_outliers": lambda t: D.polynomial_outlier(t.signals).agg(F.avg(F.col("is_anomalous").cast("int")).alias("detection")),
    "missing_infrared": lambda t: t.signals.filter("sigma_w3 IS NOT NULL").agg(F.avg(((F.col("excess_w3") > 0) & (F.col("sigma_w3") > 3)).cast("int")).alias("detection")),
    "clustered_scores": lambda t: morans_i(scored_points(t), "score").select(F.greatest(F.lit(0.0), F.col("morans_i") - F.col("expected_i")).alias("detection")),
}


@query("hypothesis_registry", f"""WITH a AS (SELECT g + 5*log10(parallax) - 10 AS m, bp_rp FROM fx_signals WHERE parallax > 0 AND bp_rp BETWEEN -0.5 AND 5), {POINTS_SQL}, c AS (SELECT ra, dec, score - avg(score) OVER () AS z, count(*) OVER () AS n, var_pop(score) OVER () AS v FROM pts), w AS (SELECT sum(1/greatest(d, 0.01)) AS w, sum(z1*z2/greatest(d, 0.01)) AS wz FROM (SELECT a.z AS z1, b.z AS z2, {Q.sep('a.ra', 'a.dec', 'b.ra', 'b.dec')} AS d FROM c a, c b) WHERE d > 0),
    d(name, detection) AS (SELECT 'stellar_outliers', avg((abs(m - {MS_POLY})/(0.4e0 + 0.1e0*abs(bp_rp)) > 3 AND NOT (bp_rp >= 0.8e0 AND m < -2 + 2.5e0*bp_rp + 1))::INT) FROM a UNION ALL SELECT 'missing_infrared', avg((excess_w3 > 0 AND sigma_w3 > 3)::INT) FROM fx_signals WHERE sigma_w3 IS NOT NULL
    UNION ALL SELECT 'clustered_scores', greatest(0, wz/(w*(SELECT max(v) FROM c)) + 1e0/((SELECT max(n) FROM c) - 1)) FROM w) SELECT name, round(detection, 6) AS detection FROM d""")
def _(t):
    return run_named(HYPOTHESES, tuple(HYPOTHESES), t, t.signals).select("name", F.round("detection", 6).alias("detection"))
