"""Sources and sinks: catalogs cut to targets, event tables, reports and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions import sphere as S
from skysift.operators.ordered import ranked
from skysift.operators.skyjoin import ARCSEC, nearest
from skysift.plans import sqltext as Q
from skysift.plans.registry import query
from skysift.session import scratch_path
from skysift.sources import readers as R
from skysift.sources import sinks as K


def r6(c, name):
    return F.round(c, 6).alias(name)


def near_sql(columns: str, radius: float, left="fx_targets", right="fx_shifted", lk="target_id", rk="source_id", extra="") -> str:
    """Nearest right row per left row within a radius in arcsec; right columns are named in `columns`."""
    inner = Q.cone(left, right, f"{radius}e0/3.6e3", lk, f"a.*, b.{rk} AS r_key, {columns}")
    return f"SELECT * FROM ({inner}) {extra} QUALIFY row_number() OVER (PARTITION BY {lk} ORDER BY sep_deg, r_key) = 1"


@query("campaign_targets", """SELECT population AS campaign, CAST(target_id AS STRING) AS target_id, CASE WHEN target_id % 3 = 0 THEN CAST(target_id AS STRING) ELSE host_star END AS host_star,
    round(ra, 6) AS ra, round(dec, 6) AS dec, distance_pc, bp_rp < 1 AS hz_flag, g AS phot_g_mean_mag, pmra AS pmra_mas FROM fx_targets""")
def _(t):
    path = scratch_path(t.spark, "campaigns")
    rows = t.targets.select(
        F.col("target_id").cast("string").alias("target_id"), F.when(F.col("target_id") % 3 != 0, F.col("host_star")).alias("host_star"),
        "ra", "dec", "distance_pc", (F.col("bp_rp") < 1).alias("hz_flag"), F.col("g").alias("phot_g_mean_mag"), F.col("pmra").alias("pmra_mas"), "population")
    K.write_campaign(rows, path, F.col("population"))
    got = R.campaign_targets(R.campaigns(t.spark, path))
    return got.select("campaign", "target_id", "host_star", r6(F.col("ra"), "ra"), r6(F.col("dec"), "dec"), "distance_pc", "hz_flag", "phot_g_mean_mag", "pmra_mas")


def write_reports(t, path):
    """Run reports of bounded size as JSON lines, with some broken lines between them."""
    rows = t.report_rows.select(
        F.col("report").cast("string").alias("report"), "row_id", F.struct(
            "target_id", "total_score", "n_active", "stouffer_p", "is_fdr", "unexplainability", "template", "data_source").alias("s"))
    packed = rows.groupBy("report", F.floor(F.col("row_id") / 1000).alias("part")).agg(F.collect_list("s").alias("list"))
    even = F.col("report").cast("int") % 2 == 0
    lines = packed.select(F.to_json(F.struct(
        "report", F.size("list").alias("n_targets"), F.when(even, F.col("list")).alias("all_scored"),
        F.when(~even, F.col("list")).alias("top_targets"))).alias("value"))
    broken = t.region.select(F.concat(F.lit("{broken "), "r_name").alias("value"))
    lines.union(broken).write.text(path)


@query("scored_report_reader", """SELECT CAST(report AS STRING) AS report, target_id, round(total_score, 6) AS total_score, n_active, round(stouffer_p, 6) AS stouffer_p, is_fdr, template FROM fx_report_rows""")
def _(t):
    path = scratch_path(t.spark, "reports")
    write_reports(t, path)
    rows = R.scored_rows(R.reports(t.spark, path))
    return rows.select("report", "target_id", r6(F.col("total_score"), "total_score"), "n_active", r6(F.col("stouffer_p"), "stouffer_p"), "is_fdr", "template")


@query("exoplanet_host_table", """SELECT host_star, planet_name, distance_pc, insol AS insolation, coalesce(insol BETWEEN 0.25 AND 1.75, false) OR (insol IS NULL AND eq_temp BETWEEN 180 AND 310) AS hz_flag FROM fx_hosts""")
def _(t):
    from skysift.operators.selection import habitable_zone
    names = {"host_star": "host_star", "planet_name": "planet_name", "distance_pc": "distance_pc", "insol": "insolation", "eq_temp": "eq_temp_k"}
    df = R.snapshot(t.hosts, names, ("distance_pc", "insolation", "eq_temp_k"))
    return df.withColumn("hz_flag", habitable_zone("insolation", "eq_temp_k")).drop("eq_temp_k")


@query("star_catalog_by_zone", "SELECT source_id, round(ra, 6) AS ra, round(dec, 6) AS dec, g, parallax FROM fx_pool WHERE dec >= 10 AND dec < 30")
def _(t):
    path = scratch_path(t.spark, "stars")
    t.pool.withColumn("zone", F.floor(F.col("dec") / 10).cast("int")).write.partitionBy("zone").parquet(path)
    # The zone filter prunes folders before any file is opened.
    df = t.spark.read.parquet(path).filter(F.col("zone").between(1, 2) & (F.col("dec") >= 10) & (F.col("dec") < 30))
    return df.select("source_id", r6(F.col("ra"), "ra"), r6(F.col("dec"), "dec"), "g", F.col("parallax").cast("double").alias("parallax"))


@query("infrared_photometry_merge", f"""WITH a AS ({near_sql('b.flux AS v', 4.5)}), n AS (SELECT * FROM fx_shifted WHERE survey = 'north'), s AS (SELECT * FROM fx_shifted WHERE survey = 'south'),
    b AS ({near_sql('b.g AS v', 3.5, right='n')}), c AS ({near_sql('b.bp_rp AS v', 2.5, right='s')})
    SELECT t.target_id, a.v AS j_mag, b.v AS w1_mag, c.v AS cat_mag, round(a.sep_deg*3600, 4) AS sep_j FROM fx_targets t LEFT JOIN a USING (target_id) LEFT JOIN b USING (target_id) LEFT JOIN c USING (target_id)""")
def _(t):
    j = R.layer(t.targets, t.shifted, 4.5, {"j_mag": "flux"}).withColumnRenamed("sep_arcsec", "sep_j")
    w = R.layer(t.targets, t.shifted.filter("survey = 'north'"), 3.5, {"w1_mag": "g"}).drop("sep_arcsec")
    c = R.layer(t.targets, t.shifted.filter("survey = 'south'"), 2.5, {"cat_mag": "bp_rp"}).drop("sep_arcsec")
    out = t.targets.select("target_id").join(j, "target_id", "left").join(w, "target_id", "left").join(c, "target_id", "left")
    return out.withColumn("sep_j", F.round("sep_j", 4))


@query("infrared_epoch_table", "SELECT target_id, epoch_id, mjd, w1, w1_err, w2, w2_err, qual FROM fx_ir_epochs WHERE w1 IS NOT NULL AND qual > 0")
def _(t):
    df = t.ir_epochs.filter("w1 IS NOT NULL AND qual > 0")
    return df.select("target_id", "epoch_id", "mjd", "w1", "w1_err", "w2", "w2_err", "qual")


# Artifact bits that spoil an ultraviolet measurement.
BAD_ARTIFACTS = 2 | 4 | 32 | 512


@query("ultraviolet_match", f"""SELECT target_id, r_key AS source_id, round(sep_deg*3600, 4) AS sep_arcsec, (fuv & {BAD_ARTIFACTS}) = 0 AND (nuv & {BAD_ARTIFACTS}) = 0 AS artifact_clean
    FROM ({near_sql('(b.source_id % 64)::INT AS fuv, (b.size*13 % 600)::INT AS nuv', 3.5)})""")
def _(t):
    cat = t.shifted.selectExpr("source_id", "ra", "dec", "CAST(source_id % 64 AS INT) AS fuv", "CAST(size*13 % 600 AS INT) AS nuv")
    df = R.layer(t.targets, cat, 3.5, {"source_id": "source_id", "fuv": "fuv", "nuv": "nuv"})
    ok = [(F.col(c).bitwiseAND(F.lit(BAD_ARTIFACTS)) == 0) for c in ("fuv", "nuv")]
    return df.select("target_id", "source_id", F.round("sep_arcsec", 4).alias("sep_arcsec"), (ok[0] & ok[1]).alias("artifact_clean"))


def radio_continuum(targets, first, second, radius_arcsec=15.0, first_above=-10.5, second_above=-40.0):
    """The survey that covers the declination wins; the second fills in where it reaches."""
    a = R.layer(targets.filter(F.col("dec") > first_above), first, radius_arcsec, {"source_id": "source_id", "flux": "flux"})
    b = R.layer(targets.filter(F.col("dec") > second_above), second, radius_arcsec, {"source_id": "source_id", "flux": "flux"})
    a = a.select("target_id", F.struct(F.lit("first").alias("survey"), "sep_arcsec", "source_id", "flux").alias("a"))
    b = b.select("target_id", F.struct(F.lit("second").alias("survey"), "sep_arcsec", "source_id", "flux").alias("b"))
    return a.join(b, "target_id", "full").select("target_id", F.coalesce("a", "b").alias("m")).select("target_id", "m.*")


@query("radio_continuum_priority", f"""WITH n AS (SELECT * FROM fx_shifted WHERE survey = 'north'), s AS (SELECT * FROM fx_shifted WHERE survey = 'south'),
    a AS (SELECT * FROM ({near_sql('b.flux AS flux', 15.5, right='n')}) WHERE dec > -10.5), b AS (SELECT * FROM ({near_sql('b.flux AS flux', 15.5, right='s')}) WHERE dec > -40)
    SELECT target_id, CASE WHEN a.r_key IS NOT NULL THEN 'first' ELSE 'second' END AS survey, coalesce(a.r_key, b.r_key) AS source_id, round(coalesce(a.flux, b.flux), 6) AS flux
    FROM a FULL JOIN b USING (target_id)""")
def _(t):
    s = t.shifted
    df = radio_continuum(t.targets, s.filter("survey = 'north'"), s.filter("survey = 'south'"), 15.5)
    return df.select("target_id", "survey", "source_id", r6(F.col("flux"), "flux"))


@query("xray_match", f"SELECT target_id, r_key AS source_id, round(flux*1e-13, 18) AS flux_band FROM ({near_sql('b.flux AS flux', 2.5)})")
def _(t):
    df = R.layer(t.targets, t.shifted, 2.5, {"source_id": "source_id", "flux": "flux"})
    return df.select("target_id", "source_id", F.round(F.col("flux") * 1e-13, 18).alias("flux_band"))


FAR_BANDS = (("pacs_70", 0), ("pacs_100", 1), ("pacs_160", 2), ("spire_250", 3))


@query("far_infrared_bands", "WITH c AS (SELECT *, size % 4 AS band FROM fx_shifted), " + ", ".join(
    f"b{i} AS ({near_sql('b.flux AS flux, b.band AS band', 4.5, right=f'(SELECT * FROM c WHERE band = {i})')})" for _, i in FAR_BANDS)
    + " SELECT t.target_id, " + ", ".join(f"round(b{i}.flux, 6) AS {n}" for n, i in FAR_BANDS) + " FROM fx_targets t "
    + " ".join(f"LEFT JOIN b{i} USING (target_id)" for _, i in FAR_BANDS) + " WHERE coalesce(b0.flux, b1.flux, b2.flux, b3.flux) IS NOT NULL")
def _(t):
    names = F.create_map(*[F.lit(x) for n, i in FAR_BANDS for x in (i, n)])
    cat = t.shifted.select("source_id", "ra", "dec", "flux", F.element_at(names, F.col("size") % 4).alias("band"))
    near = nearest(t.targets.select("target_id", "ra", "dec"), cat, 4.5 * ARCSEC, left_key="target_id", right_key="source_id", by=["band"])
    wide = near.groupBy("target_id").pivot("r_band", [n for n, _ in FAR_BANDS]).agg(F.min("r_flux"))
    return wide.select("target_id", *[r6(F.col(n), n) for n, _ in FAR_BANDS])


@query("binary_orbit_match", f"SELECT target_id, r_key AS orbit_id, round(1 + flux*7, 6) AS period_days FROM ({near_sql('b.flux AS flux', 3.5, left='fx_hosts', lk='host_id').replace('a.*', 'a.host_id AS target_id, a.host_id')})")
def _(t):
    cat = t.shifted.select("source_id", "ra", "dec", (1 + F.col("flux") * 7).alias("period"))
    df = R.layer(t.hosts.withColumnRenamed("host_id", "target_id"), cat, 3.5, {"orbit_id": "source_id", "period_days": "period"})
    return df.select("target_id", "orbit_id", r6(F.col("period_days"), "period_days"))


# Codes of object types that explain an anomaly, and how far (0 to 1); texts are ours.
OBJECT_TYPES = {
    "YSO": (0.9, "young stellar object"),
    "Y*O": (0.9, "young stellar object"),
    "TT*": (0.8, "T Tauri star"),
    "Or*": (0.8, "Orion variable"),
    "Ae*": (0.7, "Herbig Ae/Be star"),
    "CV*": (0.9, "cataclysmic variable"),
    "No*": (0.8, "nova"),
    "SN*": (0.8, "supernova"),
    "QSO": (0.95, "quasar"),
    "AGN": (0.95, "active nucleus"),
    "Sy*": (0.9, "Seyfert galaxy"),
    "Bla": (0.95, "blazar"),
    "rG": (0.9, "radio galaxy"),
    "IG": (0.8, "interacting galaxy"),
    "GiC": (0.7, "galaxy in cluster"),
    "BiC": (0.7, "brightest galaxy in cluster"),
    "GiG": (0.7, "galaxy in group"),
    "GiP": (0.7, "galaxy in pair"),
    "G": (0.7, "galaxy"),
    "Em*": (0.5, "emission-line star"),
    "Be*": (0.5, "Be star"),
    "WR*": (0.7, "Wolf-Rayet star"),
    "PN": (0.8, "planetary nebula"),
    "pA*": (0.6, "post-AGB star"),
    "AB*": (0.6, "AGB star"),
    "Mi*": (0.5, "Mira variable"),
    "LP*": (0.4, "long-period variable"),
    "RS*": (0.6, "RS CVn variable"),
    "BY*": (0.5, "BY Dra variable"),
    "Fl*": (0.5, "flare star"),
    "SB*": (0.7, "spectroscopic binary"),
    "**": (0.5, "multiple star"),
    "EB*": (0.7, "eclipsing binary"),
    "Al*": (0.6, "Algol binary"),
    "bL*": (0.6, "beta Lyrae binary"),
    "WU*": (0.6, "W UMa binary"),
    "El*": (0.5, "ellipsoidal variable"),
    "SB": (0.7, "spectroscopic binary"),
    "EB": (0.7, "eclipsing binary"),
    "PM*": (0.1, "high proper motion"),
    "HV*": (0.1, "high velocity"),
    "*": (0.0, "star"),
}
# Catalog rows stand in for typed objects: each code in turn, and one that no table has.
TYPE_CODES = "YSO Y*O TT* Or* Ae* CV* No* SN* QSO AGN Sy* Bla rG IG GiC BiC GiG GiP G Em* Be* WR* PN pA* AB* Mi* LP* RS* BY* Fl* SB* ** EB* Al* bL* WU* El* SB EB PM* HV* * Pul"
CODE_EXPR = "split('" + TYPE_CODES + "', ' ')[source_id % 43]"
# Part types stand in for object types in the populations.
KIND_TO_TYPE = {"ECONOMY": "**", "STANDARD": "QSO", "PROMO": "EB*", "SMALL": "*", "LARGE": "RS*", "MEDIUM": "G"}
TYPE_EXPR = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND_TO_TYPE.items()) + " ELSE 'Be*' END"


def object_type_risk(df, otype="otype"):
    """Attach the explanation and risk of an object type; unknown types carry no risk."""
    pairs = [x for k, (risk, why) in OBJECT_TYPES.items() for x in (F.lit(k), F.struct(F.lit(risk).alias("risk"), F.lit(why).alias("why")))]
    hit = F.element_at(F.create_map(*pairs), F.col(otype))
    return df.withColumn("risk", F.coalesce(hit["risk"], F.lit(0.0))).withColumn("explanation", hit["why"])


@query("object_type_match", f"""WITH m AS ({near_sql('b.source_id AS sid', 4.5)}), o AS (SELECT target_id, string_split('{TYPE_CODES}', ' ')[sid % 43 + 1] AS otype FROM m)
    SELECT target_id, otype, CASE
        WHEN otype IN ('QSO', 'AGN', 'Bla') THEN 0.95e0 WHEN otype IN ('YSO', 'Y*O', 'CV*', 'Sy*', 'rG') THEN 0.9e0
        WHEN otype IN ('TT*', 'Or*', 'No*', 'SN*', 'IG', 'PN') THEN 0.8e0
        WHEN otype IN ('Ae*', 'GiC', 'BiC', 'GiG', 'GiP', 'G', 'WR*', 'SB*', 'EB*', 'SB', 'EB') THEN 0.7e0
        WHEN otype IN ('pA*', 'AB*', 'RS*', 'Al*', 'bL*', 'WU*') THEN 0.6e0
        WHEN otype IN ('Em*', 'Be*', 'Mi*', 'BY*', 'Fl*', '**', 'El*') THEN 0.5e0
        WHEN otype = 'LP*' THEN 0.4e0 WHEN otype IN ('PM*', 'HV*') THEN 0.1e0 ELSE 0e0 END AS risk, otype <> 'Pul' AS explained FROM o""")
def _(t):
    df = R.layer(t.targets, t.shifted.selectExpr("source_id", "ra", "dec", f"{CODE_EXPR} AS otype"), 4.5, {"otype": "otype"})
    return object_type_risk(df).select("target_id", "otype", "risk", F.col("explanation").isNotNull().alias("explained"))


@query("gamma_source_catalog", "SELECT source_id, name, round(ra, 6) AS ra, round(dec, 6) AS dec, round((err_major_deg + err_minor_deg)/2, 6) AS mean_err, source_class IN ('', 'unk') AS is_unidentified FROM fx_gamma")
def _(t):
    return t.gamma.select("source_id", "name", r6(F.col("ra"), "ra"), r6(F.col("dec"), "dec"),
                          r6((F.col("err_major_deg") + F.col("err_minor_deg")) / 2, "mean_err"), F.col("source_class").isin("", "unk").alias("is_unidentified"))


@query("neutrino_event_csv", "SELECT event_id, round(mjd, 4) AS mjd, round(ra, 4) AS ra, round(dec, 4) AS dec, round(energy_gev, 2) AS energy_gev, angular_err FROM fx_neutrinos")
def _(t):
    path = scratch_path(t.spark, "neutrinos")
    t.neutrinos.select("event_id", F.col("mjd").alias("Time"), F.col("ra").alias("RA[deg]"), F.col("dec").alias("Dec[deg]"),
                       F.when(F.col("energy_gev") == 0, float("-inf")).otherwise(F.log10("energy_gev")).alias("log10(E/GeV)"), F.col("angular_err").alias("AngErr")).write.option("header", True).csv(path)
    df = R.event_csv(t.spark, path, keep=["event_id"])
    return df.select(F.col("event_id").cast("bigint").alias("event_id"), F.round("mjd", 4).alias("mjd"), F.round("ra", 4).alias("ra"),
                     F.round("dec", 4).alias("dec"), F.round("energy_gev", 2).alias("energy_gev"), "angular_err")


@query("merger_event_json", """SELECT o_orderkey AS event_id, o_totalprice AS distance_mpc, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice/1e3 END AS snr,
    1.1e9 + o_orderkey*1e4 AS gps, CASE WHEN 1.1e9 + o_orderkey*1e4 BETWEEN 1126051217 AND 1137254417 THEN 'O1' WHEN 1.1e9 + o_orderkey*1e4 BETWEEN 1164556817 AND 1187733618 THEN 'O2'
    WHEN 1.1e9 + o_orderkey*1e4 BETWEEN 1238112018 AND 1253977218 THEN 'O3a' ELSE 'O3' END AS run FROM orders WHERE 1.1e9 + o_orderkey*1e4 < 1.25e9""")
def _(t):
    path = scratch_path(t.spark, "mergers")
    o = t.orders.filter("1.1e9 + o_orderkey*1e4 < 1.25e9")
    flat = F.create_map(F.lit("GPS"), 1.1e9 + F.col("o_orderkey") * 1e4, F.lit("DL"), F.col("o_totalprice"),
                        F.lit("SNR"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") / 1e3))
    nested = F.create_map(F.lit("A-1"), F.struct(F.create_map(F.lit("GPS"), F.lit(0.0)).alias("parameters")), F.lit("B-2"), F.struct(flat.alias("parameters")))
    even = F.col("o_orderkey") % 2 == 0
    o.select(F.col("o_orderkey").cast("string").alias("name"), F.lit("GWTC-O3").alias("catalog"),
             F.when(even, flat).alias("params"), F.when(~even, nested).alias("events")).write.json(path)
    df = R.merger_events(t.spark, path)
    return df.select(F.col("name").cast("bigint").alias("event_id"), "distance_mpc", "snr", "gps", "run")


@query("burst_repeaters", "SELECT user_id AS source_id, count(*) AS n_bursts, round(min(m), 6) AS first_mjd, round(max(m), 6) AS last_mjd, round(sum(m), 2) AS mjd_sum FROM (SELECT target_id AS user_id, mjd AS m FROM fx_ir_epochs) GROUP BY 1")
def _(t):
    # Repeaters are stored in blocks of at most 1000 bursts, and read back as single bursts.
    numbered = ranked(t.ir_epochs.select("target_id", "epoch_id", "mjd"), ["target_id"], ["mjd", "epoch_id"], "nth", None)
    blocks = numbered.groupBy("target_id", F.floor((F.col("nth") - 1) / 1000).alias("block")).agg(F.sort_array(F.collect_list("mjd")).alias("burst_mjds"))
    path = scratch_path(t.spark, "repeaters")
    blocks.write.parquet(path)
    bursts = t.spark.read.parquet(path).select(F.col("target_id").alias("source_id"), F.explode("burst_mjds").alias("m"))
    return bursts.groupBy("source_id").agg(F.count("*").alias("n_bursts"), r6(F.min("m"), "first_mjd"), r6(F.max("m"), "last_mjd"), F.round(F.sum("m"), 2).alias("mjd_sum"))


@query("pulsar_timing_tables", """SELECT p.name, p.period_ms, p.dm, count(*) AS n_toas, round(max(r.mjd) - min(r.mjd), 6) AS span_days, round(sqrt(avg(r.residual_us*r.residual_us)), 6) AS rms_us
    FROM fx_pulsars p JOIN fx_residuals r USING (pulsar_id) GROUP BY ALL""")
def _(t):
    agg = t.residuals.groupBy("pulsar_id").agg(F.count("*").alias("n_toas"), r6(F.max("mjd") - F.min("mjd"), "span_days"),
                                               r6(F.sqrt(F.avg(F.col("residual_us") * F.col("residual_us"))), "rms_us"))
    return t.pulsars.drop("rms_us").join(agg, "pulsar_id").select("name", "period_ms", "dm", "n_toas", "span_days", "rms_us")


@query("lightcurve_sectors", "SELECT target_id, list_sort(list(DISTINCT sector)) AS sectors, count(*) AS n_points FROM fx_lightcurve GROUP BY target_id")
def _(t):
    return t.lightcurve.groupBy("target_id").agg(F.array_sort(F.collect_set("sector")).alias("sectors"), F.count("*").alias("n_points"))


@query("abundance_match", f"""WITH m AS ({near_sql('b.size AS size', 3.5)}), r AS (SELECT target_id, unnest([{{'r': 'Eu_Fe', 'v': (size % 12)/1e1}}, {{'r': 'Ni_Fe', 'v': (size % 7)/1e1}}, {{'r': 'Li_A', 'v': (size % 40)/1e1}}]) AS x FROM m)
    SELECT target_id, x.r AS ratio, x.v::DOUBLE AS value FROM r WHERE x.v > 0""")
def _(t):
    cat = t.shifted.selectExpr("source_id", "ra", "dec", "map('Eu_Fe', (size % 12)/1e1, 'Ni_Fe', (size % 7)/1e1, 'Li_A', (size % 40)/1e1) AS ratios")
    cat = cat.withColumn("ratios", F.map_entries(F.map_filter("ratios", lambda k, v: v > 0)))
    df = R.layer(t.targets, cat, 3.5, {"ratios": "ratios"})
    return df.select("target_id", F.explode("ratios").alias("x")).select("target_id", F.col("x.key").alias("ratio"), F.col("x.value").alias("value"))


@query("spectrogram_table", "SELECT f_idx, t_idx, round(freq_mhz, 9) AS freq_mhz, t_sec, power FROM fx_spectrogram")
def _(t):
    return t.spectrogram.select("f_idx", "t_idx", F.round("freq_mhz", 9).alias("freq_mhz"), "t_sec", "power")


@query("report_sink", "SELECT target_id, CASE WHEN target_id % 5 = 0 THEN NULL ELSE g END AS g, population, ruwe AS first_value, CASE WHEN target_id % 5 = 0 THEN NULL ELSE g END AS second_value FROM fx_targets")
def _(t):
    path = scratch_path(t.spark, "report")
    bad = F.when(F.col("target_id") % 10 == 0, F.lit(float("nan"))).when(F.col("target_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("g"))
    readings = F.array(F.struct(F.lit("ruwe").alias("name"), F.col("ruwe").alias("value")), F.struct(F.lit("g").alias("name"), bad.alias("value")))
    K.write_report(t.targets.select("target_id", bad.alias("g"), "population", readings.alias("readings")), path)
    found = t.spark.read.schema("target_id bigint, g double, population string, readings array<struct<name:string,value:double>>").json(path)
    return found.select("target_id", "g", "population", F.col("readings")[0]["value"].alias("first_value"), F.col("readings")[1]["value"].alias("second_value"))


@query("evidence_bundles", "SELECT report AS run_id, target_id, count(*) AS n, round(max(total_score), 6) AS best FROM fx_report_rows WHERE report = 1997 GROUP BY ALL")
def _(t):
    path = scratch_path(t.spark, "evidence")
    K.append_evidence(t.report_rows.withColumnRenamed("report", "run_id"), path)
    df = K.evidence_of(t.spark, path, 1997)
    return df.groupBy("run_id", "target_id").agg(F.count("*").alias("n"), r6(F.max("total_score"), "best"))


@query("retention_log", """SELECT CASE WHEN total_score >= 1.9 THEN 'just below threshold' ELSE 'near threshold' END AS reason, count(*) AS n FROM fx_report_rows WHERE total_score >= 1.8 AND total_score < 2 GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "retention")
    for status in ("n_active < 2", "n_active >= 2"):
        K.append_retention(K.boundary_rows(t.report_rows.filter(status), "total_score", 2.0, 0.2), path)
    return t.spark.read.parquet(path).groupBy("reason").agg(F.count("*").alias("n"))


@query("earlier_epoch_radio", "SELECT id, round(ra, 6) AS ra, round(dec, 6) AS dec, flux, flux_err, 'second' AS release FROM fx_epoch2 WHERE dec > 20 AND dec < 60 UNION ALL SELECT id, round(ra, 6), round(dec, 6), flux, flux_err, 'first' FROM fx_epoch1 WHERE dec > 20 AND dec < 60")
def _(t):
    stacked = t.epoch1.withColumn("release", F.lit("first")).unionByName(t.epoch2.withColumn("release", F.lit("second")))
    return stacked.filter("dec > 20 AND dec < 60").select("id", r6(F.col("ra"), "ra"), r6(F.col("dec"), "dec"), "flux", "flux_err", "release")


SPECTRA = ("north_low", "north_high", "south_low", "south_high")
SPECTRA_EXPR = "concat(survey, CASE WHEN size < 25 THEN '_low' ELSE '_high' END)"


def spectra(t):
    """Four spectroscopic surveys with one schema, stacked."""
    return t.shifted.selectExpr("source_id", "ra", "dec", f"{SPECTRA_EXPR} AS survey", "4e3 + source_id % 4000 AS teff",
                                "CASE WHEN size % 3 = 0 THEN NULL ELSE (size % 50)/1e1 END AS logg", "(size % 20)/1e1 - 1e0 AS fe_h", "(size % 9)/1e0 AS rv_scatter")


@query("spectroscopic_surveys", f"""WITH s AS (SELECT source_id, ra, dec, {SPECTRA_EXPR} AS survey FROM fx_shifted), m AS ({Q.cone('fx_targets', 's', '4.5e0/3.6e3', 'target_id', 'a.target_id, b.source_id, b.survey')})
    SELECT target_id, survey, arg_min(source_id, (sep_deg, source_id)) AS source_id FROM m GROUP BY target_id, survey""")
def _(t):
    near = nearest(t.targets.select("target_id", "ra", "dec"), spectra(t), 4.5 * ARCSEC, left_key="target_id", right_key="source_id", by=["survey"])
    return near.select("target_id", F.col("r_survey").alias("survey"), F.col("r_source_id").alias("source_id"))


@query("campaign_listing", "SELECT population AS campaign, count(*) AS n_targets FROM fx_targets GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "campaigns")
    K.write_campaign(t.targets.select("target_id", "host_star", "ra", "dec", "population"), path, F.col("population"))
    per_file = R.campaigns(t.spark, path).groupBy("file", "campaign").agg(F.sum(F.size("targets")).alias("n"))
    return per_file.groupBy("campaign").agg(F.sum("n").alias("n_targets"))


@query("candidate_list_csv", """SELECT p_partkey AS candidate, round(15e0*(p_partkey % 24 + (p_partkey*7 % 60)/6e1 + p_size/3.6e3), 6) AS ra, round(-1e0*(p_partkey % 90 + p_size/6e1), 6) AS dec, p_name AS host_star FROM part""")
def _(t):
    path = scratch_path(t.spark, "candidates")
    t.part.select("p_partkey", F.format_string("%d %d %d", F.col("p_partkey") % 24, F.col("p_partkey") * 7 % 60, "p_size").alias("RAJ2000"),
                  F.format_string("-%d %d 0", F.col("p_partkey") % 90, "p_size").alias("DEJ2000"), F.col("p_name").alias("Name")).write.option("header", True).csv(path)
    raw = t.spark.read.schema("p_partkey bigint, RAJ2000 string, DEJ2000 string, Name string").option("header", True).csv(path)
    return raw.select(F.col("p_partkey").alias("candidate"), r6(S.from_sexagesimal("RAJ2000", True), "ra"), r6(S.from_sexagesimal("DEJ2000", False), "dec"), F.col("Name").alias("host_star"))
