"""Readers: campaign files, run reports, catalogs and event tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions.numeric import clean
from skysift.functions.text import observing_run
from skysift.operators.skyjoin import ARCSEC, nearest

RAW_TARGET = (
    "target_id string, host_star string, ra double, dec double, distance_pc double, hz_flag boolean, "
    "expected_channels map<string,string>, is_positive_control boolean, is_negative_control boolean, "
    "phot_g_mean_mag double, bp_rp double, b_gal double, pmra_mas double, pmdec_mas double"
)
SCORED = (
    "target_id:bigint,total_score:double,n_active:int,stouffer_p:double,is_fdr:boolean,"
    "unexplainability:double,template:string,data_source:string"
)
REPORT_SCHEMA = (
    f"report string, n_targets bigint, all_scored array<struct<{SCORED}>>, "
    f"top_targets array<struct<{SCORED}>>, _corrupt string"
)


def campaign_schema() -> str:
    fields = RAW_TARGET.replace("map<string,string>", "map<string|string>").split(",")
    inner = ",".join(":".join(f.strip().split(" ")) for f in fields).replace("|", ",")
    return f"campaign string, description string, phase string, targets array<struct<{inner}>>"


def campaigns(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Campaign records; ``whole_file`` reads one pretty-printed document per file."""
    return (
        spark.read.schema(campaign_schema()).option("multiLine", whole_file).json(path)
        .withColumn("file", F.col("_metadata.file_name"))
    )


def campaign_targets(records: DataFrame) -> DataFrame:
    """One normalised row per target of a campaign record."""
    rows = records.select("campaign", "phase", F.posexplode("targets").alias("i", "t"))
    ident = F.coalesce("t.target_id", F.format_string("custom_target_%03d", "i"))
    false = F.lit(False)
    return rows.select(
        "campaign", "phase", ident.alias("target_id"), F.coalesce("t.host_star", ident).alias("host_star"),
        clean("t.ra").alias("ra"), clean("t.dec").alias("dec"), clean("t.distance_pc").alias("distance_pc"),
        F.coalesce("t.hz_flag", false).alias("hz_flag"),
        F.coalesce("t.expected_channels", F.create_map().cast("map<string,string>")).alias("expected_channels"),
        F.coalesce("t.is_positive_control", false).alias("is_positive_control"),
        F.coalesce("t.is_negative_control", false).alias("is_negative_control"),
        *[clean(f"t.{c}").alias(c) for c in ("phot_g_mean_mag", "bp_rp", "b_gal", "pmra_mas", "pmdec_mas")],
    )


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Run reports; records that are not JSON are skipped."""
    return (
        spark.read.schema(REPORT_SCHEMA).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").json(path)
        .withColumn("file", F.col("_metadata.file_name"))
        .filter(F.col("_corrupt").isNull()).drop("_corrupt")
    )


def scored_rows(records: DataFrame) -> DataFrame:
    """One row per (report, target): the full list when present, else the top list."""
    return records.select("report", F.explode(F.coalesce("all_scored", "top_targets")).alias("s")).select("report", "s.*")


def snapshot(df: DataFrame, names: Mapping[str, str], numbers: Sequence[str] = ()) -> DataFrame:
    """Catalog snapshot with survey column names mapped to ours; NaN and infinities become null."""
    out = df.select(*[F.col(old).alias(new) for old, new in names.items()])
    return out.withColumns({c: clean(c) for c in numbers})


# Header spellings accepted for event tables.
EVENT_HEADERS = {
    "mjd": ("mjd", "time", "t"),
    "ra": ("ra", "ra[deg]", "ra_deg", "right_ascension"),
    "dec": ("dec", "dec[deg]", "dec_deg", "declination"),
    "energy": ("log10(e/gev)", "loge", "log10e", "logenergy", "energy"),
    "angular_err": ("angerr", "angerr[deg]", "angular_err", "sigma"),
}


def event_csv(spark: SparkSession, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """Event table from CSV with any accepted header. Energies below 20 are decimal logarithms, minus infinity that of zero."""
    raw = spark.read.option("header", True).option("comment", "#").csv(path)
    by_name = {c.strip().lower().replace(" ", "_"): c for c in raw.columns}
    found = {t: by_name[n] for t, ns in EVENT_HEADERS.items() for n in reversed(ns) if n in by_name}
    missing = [c for c in ("mjd", "ra", "dec") if c not in found]
    if missing:
        raise ValueError(f"no column for {missing} among {raw.columns}")

    def number(t, default):
        return clean(F.col(f"`{found[t]}`").try_cast("double")) if t in found else F.lit(default)

    e = number("energy", 0.0)
    if "energy" in found:
        zero = F.col(f"`{found['energy']}`").try_cast("double") == float("-inf")
    return raw.select(
        *keep, number("mjd", None).alias("mjd"), number("ra", None).alias("ra"), number("dec", None).alias("dec"),
        F.when(zero, 0.0).when(e < 20, F.pow(F.lit(10.0), e)).otherwise(e).alias("energy_gev") if "energy" in found else e.alias("energy_gev"),
        number("angular_err", 1.0).alias("angular_err"),
    )


# Parameter spellings accepted in merger event records.
MERGER_FIELDS = {
    "gps": ("GPS", "gps", "tc", "geocent_time"),
    "sky_area": ("sky_area_90", "sky90", "area90", "skyarea", "sky_area", "90cr_area"),
    "mass1": ("mass_1_source", "mass1", "m1"),
    "mass2": ("mass_2_source", "mass2", "m2"),
    "distance_mpc": ("luminosity_distance", "distance", "DL", "luminosity_distance_Mpc"),
    "snr": ("network_matched_filter_snr", "snr", "SNR"),
}


def merger_events(spark: SparkSession, path: str) -> DataFrame:
    """Merger events from JSON with parameters flat or under events.<catalog>.parameters.

    Of several catalogs the last name in alphabetical order is used.
    """
    raw = spark.read.schema(
        "name string, catalog string, params map<string,double>, "
        "events map<string,struct<parameters:map<string,double>>>"
    ).json(path)
    last = F.element_at("events", F.array_max(F.map_keys("events")))["parameters"]
    raw = raw.withColumn("p", F.coalesce(last, F.col("params")))

    def first_of(names) -> Column:
        return clean(F.coalesce(*[F.element_at("p", F.lit(n)) for n in names]))

    out = raw.select("name", "catalog", *[first_of(ns).alias(c) for c, ns in MERGER_FIELDS.items()])
    by_catalog = (
        F.when(F.col("catalog").contains("O1") | F.col("catalog").contains("O2"), "O1/O2")
        .when(F.col("catalog").contains("O3"), "O3").when(F.col("catalog").contains("O4"), "O4")
    )
    return out.withColumn("run", F.coalesce(observing_run("gps"), by_catalog))


def layer(targets: DataFrame, catalog: DataFrame, radius_arcsec: float, columns: Mapping[str, Column | str],
          key: str = "target_id", catalog_key: str = "source_id") -> DataFrame:
    """One catalog cut to the nearest source of each target: key, separation and chosen columns."""
    near = nearest(targets.select(key, "ra", "dec"), catalog, radius_arcsec * ARCSEC,
                   left_key=key, right_key=catalog_key)
    picked = [(F.col(f"r_{c}") if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    return near.select(key, (F.col("sep_deg") * 3600).alias("sep_arcsec"), *picked)
