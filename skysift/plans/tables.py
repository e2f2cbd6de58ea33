"""Survey-shaped tables derived from the given ones.

A derived table is a list of scalar expressions over one given table. The text is valid in
both Spark SQL and DuckDB, so that a query and the SQL it is checked against read the same
rows. ``{us:c}`` stands for the microseconds of a timestamp column.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions.libm import libm_asin
from skysift.functions.photometry import ZERO_POINT_JY

GIVEN = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

CHANNELS = (
    "ir_excess", "transit_anomaly", "radio_anomaly", "gaia_photometric_anomaly",
    "habitable_zone_planet", "proper_motion_anomaly", "ir_variability", "uv_anomaly",
    "radio_emission", "hr_anomaly", "abundance_anomaly",
)
CALIBRATED = (
    "ir_excess", "transit_anomaly", "gaia_photometric_anomaly", "proper_motion_anomaly",
    "ir_variability", "hr_anomaly",
)
MICRON = {
    "G": 0.622, "BP": 0.511, "RP": 0.777, "J": 1.235, "H": 1.662, "Ks": 2.159,
    "W1": 3.353, "W2": 4.603, "W3": 11.561, "W4": 22.088,
}


def ra_of(k: str) -> str:
    return f"(CAST({k} AS BIGINT)*137507764 % 360000000)/1e6"


def dec_of(k: str) -> str:
    return f"degrees(asin(2e0*(CAST({k} AS BIGINT)*61803 % 100003)/100003e0 - 1e0))"


def mjd_of(ts: str) -> str:
    return f"56700e0 + 6e1*({{us:{ts}}} - 1704067200000000)/8.64e10"


_K = "c_custkey"
_PARALLAX = f"(1e0 + {_K}*7919 % 199)"
_G = f"(8e0 + ({_K}*37 % 900)/1e2)"


def _blackbody_mag(band: str, noise: int) -> str:
    teff = f"(3500e0 + {_K}*71 % 6000)"

    def light(b):
        w = MICRON[b]
        return f"(1e0/({w ** 3:.9e}*(exp(14387.77e0/({w}e0*{teff})) - 1e0)*{ZERO_POINT_JY[b]}e0))"

    return f"{_G} - 2.5e0*log10({light(band)}/{light('G')}) + (({_K}*{noise} % 21) - 10)/1e3"


_EXCESS = f"(CASE WHEN {_K} % 7 = 0 THEN ({_K} % 5)*3e-1 ELSE 0e0 END)"

# name -> (source, {column: expression}, filter or None)
SCALAR = {
    "targets": ("customer", {
        "target_id": _K, "host_star": "c_name", "ra": ra_of(_K), "dec": dec_of(_K),
        "g": _G, "bp_rp": f"({_K}*31 % 480)/1e2 - 2e-1", "parallax": _PARALLAX,
        "parallax_error": f"5e-2 + ({_K}*11 % 100)/2e2",
        "pmra": f"({_K}*29 % 400) - 2e2", "pmdec": f"({_K}*43 % 300) - 1.5e2",
        "pmra_error": f"1e-2 + ({_K} % 10)/1e2", "pmdec_error": f"1e-2 + ({_K} % 7)/1e2",
        "ruwe": f"8e-1 + ({_K}*53 % 400)/1e2", "aen": f"({_K}*17 % 300)/1e2",
        "aen_sig": f"({_K}*17 % 120)/1e1", "teff": f"3e3 + {_K}*71 % 6000",
        "logg": f"1e0 + ({_K}*13 % 400)/1e2", "mh": f"({_K}*19 % 200)/1e2 - 1.5e0",
        "distance_pc": f"CASE WHEN {_K} % 11 = 0 THEN NULL ELSE 1e3/{_PARALLAX} END",
        "population": "c_mktsegment", "nation": "c_nationkey", "balance": "c_acctbal",
    }, None),
    "photometry": ("customer", {
        "target_id": _K, "ra": ra_of(_K), "dec": dec_of(_K), "G": _G,
        "BP": _blackbody_mag("BP", 5), "RP": _blackbody_mag("RP", 7),
        "J": f"CASE WHEN {_K} % 23 = 0 THEN NULL ELSE {_blackbody_mag('J', 11)} END",
        "H": _blackbody_mag("H", 13), "Ks": _blackbody_mag("Ks", 17),
        "W1": _blackbody_mag("W1", 19), "W2": _blackbody_mag("W2", 23),
        "W3": f"CASE WHEN {_K} % 19 = 0 THEN NULL ELSE {_blackbody_mag('W3', 29)} - {_EXCESS} END",
        "W4": f"CASE WHEN {_K} % 17 = 0 THEN NULL ELSE {_blackbody_mag('W4', 31)} - 2e0*{_EXCESS} END",
        "W1_err": "2e-2", "W2_err": "2e-2",
        "W3_err": f"CASE WHEN {_K} % 4 = 0 THEN NULL ELSE 3e-2 + ({_K} % 8)/1e2 END",
        "W4_err": f"CASE WHEN {_K} % 3 = 0 THEN NULL ELSE 8e-2 + ({_K} % 9)/1e2 END",
        "cc_flags": f"CASE {_K} % 9 WHEN 0 THEN '00D0' WHEN 1 THEN '000H' WHEN 2 THEN 'dd00' ELSE '0000' END",
        "ext_flg": f"CASE WHEN {_K} % 13 = 0 THEN 1 ELSE 0 END",
        "ph_qual": f"CASE {_K} % 8 WHEN 0 THEN 'AAUB' WHEN 1 THEN 'AAAX' WHEN 2 THEN 'AABU' ELSE 'AAAA' END",
        "w1_ra": ra_of(_K), "w1_dec": dec_of(_K),
        "w2_ra": ra_of(_K), "w2_dec": f"{dec_of(_K)} + ({_K} % 3)/7.2e3",
        "w3_ra": ra_of(_K), "w3_dec": f"CASE WHEN {_K} % 6 = 0 THEN NULL ELSE {dec_of(_K)} + ({_K} % 5)/3.6e3 END",
        "w4_ra": ra_of(_K), "w4_dec": f"CASE WHEN {_K} % 10 = 0 THEN NULL ELSE {dec_of(_K)} + ({_K} % 6)/3.6e3 END",
    }, None),
    "hosts": ("supplier", {
        "host_id": "s_suppkey", "host_star": "s_name", "planet_name": "concat(s_name, ' b')",
        "ra": ra_of("15*s_suppkey"),
        "dec": f"greatest(-89.9e0, least(89.9e0, {dec_of('15*s_suppkey')})) + (s_suppkey % 10)/3.6e3",
        "distance_pc": "CASE WHEN s_suppkey % 12 = 0 THEN NULL ELSE 5e0 + s_suppkey*13 % 200 END",
        "period_days": "1e0 + (s_suppkey*17 % 300)/3e0", "st_mass": "3e-1 + (s_suppkey % 15)/1e1",
        "insol": "CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE (s_suppkey*7 % 300)/1e2 END",
        "eq_temp": "1.5e2 + s_suppkey*11 % 250", "nation": "s_nationkey",
    }, None),
    "pool": ("part", {
        "source_id": "p_partkey", "ra": ra_of("p_partkey + 500000"), "dec": dec_of("p_partkey + 500000"),
        "g": "8e0 + (p_partkey*37 % 900)/1e2", "bp_rp": "(p_partkey*31 % 480)/1e2 - 2e-1",
        "parallax": "1e0 + p_partkey*7919 % 199", "parallax_error": "5e-2 + (p_partkey*11 % 100)/2e2",
        "pmra": "(p_partkey*29 % 400) - 2e2", "pmdec": "(p_partkey*43 % 300) - 1.5e2",
        "ruwe": "8e-1 + (p_partkey*53 % 400)/1e2", "teff": "3e3 + p_partkey*71 % 6000",
        "logg": "1e0 + (p_partkey*13 % 400)/1e2", "brand": "p_brand", "kind": "p_type", "size": "p_size",
    }, None),
    # The same sky as the targets, moved by 0 to 4 arcsec: a second catalog with known matches.
    "shifted": ("part", {
        "source_id": "p_partkey", "ra": ra_of("p_partkey"),
        "dec": f"{dec_of('p_partkey')} + (p_partkey % 5)/3.6e3", "g": "8e0 + (p_partkey*41 % 900)/1e2",
        "parallax": "1e0 + p_partkey*7919 % 199", "bp_rp": "(p_partkey*31 % 480)/1e2 - 2e-1",
        "pmra": "(p_partkey*23 % 400) - 2e2", "pmdec": "(p_partkey*47 % 300) - 1.5e2",
        "err_mas": "(p_partkey % 40)*3e1", "flux": "p_retailprice/1e2", "kind": "p_type",
        "survey": "CASE WHEN p_size % 2 = 0 THEN 'north' ELSE 'south' END", "size": "p_size",
    }, None),
    "ir_epochs": ("events", {
        "target_id": "user_id", "epoch_id": "event_id", "mjd": mjd_of("ts"), "w1": "1.2e1 + value/1e3",
        "w1_err": "2e-2 + (event_id % 10)/1e3",
        "w2": "CASE WHEN event_type = 'error' THEN NULL ELSE 1.19e1 + value/1e3 - (event_id % 7)/1e3 END",
        "w2_err": "CASE WHEN event_type = 'error' THEN NULL ELSE 2.5e-2 + (event_id % 9)/1e3 END",
        "qual": "CAST(event_id % 11 AS INT)",
    }, None),
    "optical_epochs": ("events", {
        "target_id": "user_id", "epoch_id": "event_id", "mjd": mjd_of("ts"), "mag": "1.4e1 + value/5e2",
        "flux": "1e2 + value", "flux_err": "1e0 + (event_id % 60)",
        "band": "CASE WHEN event_type = 'view' THEN 'G' ELSE 'BP' END",
    }, "event_type IN ('view', 'click')"),
    "neutrinos": ("events", {
        "event_id": "event_id", "ra": ra_of("event_id"), "dec": dec_of("event_id"),
        "mjd": mjd_of("ts"), "energy_gev": "value*2e3", "angular_err": "2e-1 + (event_id % 20)/1e1",
    }, None),
    "gamma": ("part", {
        "source_id": "p_partkey", "name": "p_name", "ra": ra_of("15*p_partkey"),
        "dec": f"greatest(-89e0, least(89e0, {dec_of('15*p_partkey')} + p_size/6e1))",
        "err_major_deg": "5e-2 + p_size/5e2", "err_minor_deg": "4e-2 + p_size/6e2",
        "flux": "p_retailprice/1e3", "source_class": "CASE WHEN p_size % 2 = 1 THEN '' WHEN p_size % 3 = 0 THEN 'unk' ELSE 'psr' END",
    }, None),
    "gw": ("nation", {
        "event_id": "n_nationkey", "name": "n_name", "ra": ra_of("n_nationkey*40"), "dec": dec_of("n_nationkey*40"),
        "area": "CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE 1e2 + 5e1*n_nationkey END",
        "gps": "1.126e9 + n_nationkey*1e7", "catalog": "CASE WHEN n_regionkey = 0 THEN 'confident' ELSE 'marginal' END",
    }, None),
    "epoch1": ("orders", {
        "id": "o_orderkey", "ra": ra_of("o_orderkey"), "dec": dec_of("o_orderkey"), "flux": "o_totalprice/1e3",
        "flux_err": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1e0 + o_totalprice/1e4 END",
    }, "o_orderpriority <> '5-LOW'"),
    "epoch2": ("orders", {
        "id": "o_orderkey", "ra": ra_of("o_orderkey"), "dec": dec_of("o_orderkey"),
        "flux": "o_totalprice/1e3*(5.4e-1 + (o_orderkey % 5)/1e1)",
        "flux_err": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 5e-1 + o_totalprice/2e4 END",
    }, "o_orderpriority <> '1-URGENT'"),
    # One row per (report, target): several reports may hold one target.
    "report_rows": ("orders", {
        "row_id": "o_orderkey", "target_id": "o_custkey", "report": "CAST(year(o_orderdate) AS INT)",
        "total_score": "floor(o_totalprice/1e1)/1e4", "n_active": "CAST(o_orderkey % 5 AS INT)",
        "ruwe": "8e-1 + (o_orderkey*53 % 400)/1e2", "aen_sig": "(o_orderkey*17 % 120)/1e1",
        "pm_sigma": "(o_orderkey*7 % 60)/1e1", "unexplainability": "(o_orderkey*61 % 1000)/1e3",
        "stouffer_p": "(1 + o_orderkey*97 % 1000)/1e3", "is_fdr": "o_orderkey*97 % 1000 < 50",
        "template": "CASE o_orderkey % 6 WHEN 0 THEN 'binary_system' WHEN 1 THEN 'debris_disk' WHEN 2 THEN 'young_stellar_object' WHEN 3 THEN 'face_on_binary' WHEN 4 THEN 'none' ELSE NULL END",
        "data_source": "CASE o_orderstatus WHEN 'F' THEN 'real' WHEN 'O' THEN 'simulated' ELSE 'none' END",
        "hz_score": "CASE WHEN o_orderkey % 4 = 0 THEN 5e-1 ELSE 0e0 END",
        "risk_text": "CASE o_orderkey % 9 WHEN 0 THEN 'known spectroscopic binary' WHEN 1 THEN 'dust disk' ELSE 'none' END",
    }, None),
    "pulsars": ("supplier", {
        "pulsar_id": "s_suppkey", "name": "concat(CASE WHEN s_suppkey % 2 = 0 THEN 'J' ELSE 'B' END, s_name)",
        "ra": ra_of("15*s_suppkey + 1"), "dec": dec_of("15*s_suppkey"), "period_ms": "1e0 + s_suppkey % 30",
        "dm": "1e1 + s_suppkey % 90", "rms_us": "1e-1 + (s_suppkey % 20)/1e1",
    }, None),
    # Further measurements of the targets, with gaps.
    "signals": ("customer", {
        "target_id": _K, "ra": ra_of(_K), "dec": dec_of(_K), "g": _G, "bp_rp": f"({_K}*31 % 480)/1e2 - 2e-1",
        "parallax": f"CASE WHEN {_K} % 13 = 0 THEN NULL ELSE {_PARALLAX} END", "parallax_error": f"5e-2 + ({_K}*11 % 100)/2e2",
        "ruwe": f"8e-1 + ({_K}*53 % 400)/1e2", "aen": f"({_K}*17 % 300)/1e2", "aen_sig": f"({_K}*17 % 120)/1e1",
        "teff": f"3e3 + {_K}*71 % 6000", "logg": f"1e0 + ({_K}*13 % 400)/1e2", "mh": f"({_K}*19 % 200)/1e2 - 1.5e0",
        "distance_pc": f"CASE WHEN {_K} % 11 = 0 THEN NULL ELSE 1e3/{_PARALLAX} END",
        "fuv": f"CASE WHEN {_K} % 6 = 0 THEN NULL ELSE 1.4e1 + ({_K}*17 % 800)/1e2 END",
        "nuv": f"CASE WHEN {_K} % 9 = 0 THEN NULL ELSE 1.2e1 + ({_K}*23 % 900)/1e2 END", "uv_clean": f"{_K} % 7 <> 0",
        "radio_mjy": f"CASE WHEN {_K} % 5 = 0 THEN NULL ELSE ({_K}*19 % 300)/5e1 END", "radio_sep": f"({_K}*7 % 140)/1e1", "radio_snr": f"({_K}*11 % 200)/1e1",
        "pmra": f"({_K}*29 % 400) - 2e2", "pmdec": f"({_K}*43 % 300) - 1.5e2", "pmra_error": f"1e-2 + ({_K} % 10)/1e2", "pmdec_error": f"1e-2 + ({_K} % 7)/1e2",
        "wpmra": f"({_K}*29 % 400) - 2e2 + (({_K}*3 % 90) - 45)*7e-1", "wpmdec": f"({_K}*43 % 300) - 1.5e2 + (({_K}*7 % 80) - 40)*6e-1",
        "wpmra_error": f"1e0 + ({_K} % 40)/4e0", "wpmdec_error": f"1e0 + ({_K} % 30)/3e0",
        "eu_fe": f"CASE WHEN {_K} % 4 = 0 THEN NULL ELSE ({_K}*7 % 140)/1e2 - 2e-1 END", "ni_fe": f"({_K}*11 % 70)/1e2 - 2e-1",
        "p_fe": f"CASE WHEN {_K} % 5 = 0 THEN NULL ELSE ({_K}*13 % 150)/1e2 - 1e-1 END", "co_ni": f"({_K}*17 % 90)/1e2 - 4.5e-1",
        "li_a": f"({_K}*19 % 400)/1e2", "ce_fe": f"CASE WHEN {_K} % 3 = 0 THEN NULL ELSE ({_K}*23 % 100)/1e2 - 2e-1 END",
        "pacs_70": f"CASE WHEN {_K} % 4 = 1 THEN NULL ELSE 1e0 + ({_K}*7 % 90) END", "pacs_100": f"CASE WHEN {_K} % 8 = 1 THEN NULL ELSE 1e0 + ({_K}*11 % 90) END",
        "spire_250": f"CASE WHEN {_K} % 5 = 2 THEN NULL ELSE ({_K}*13 % 160)*1e0 END", "w4_mjy": f"CASE WHEN {_K} % 6 = 3 THEN NULL ELSE ({_K}*17 % 140)*1e0 END",
        "xray": f"CASE WHEN {_K} % 3 = 0 THEN NULL ELSE ({_K}*13 % 400)*1e-14 END", "ebv": f"CASE WHEN {_K} % 8 = 0 THEN NULL ELSE ({_K}*29 % 60)/1e2*({_K} % 2) END",
        "sigma_w3": f"CASE WHEN {_K} % 10 = 0 THEN NULL ELSE ({_K}*31 % 120)/1e1 END", "sigma_w4": f"CASE WHEN {_K} % 12 = 0 THEN NULL ELSE ({_K}*37 % 150)/1e1 END",
        "excess_w3": f"(({_K}*41 % 60) - 40)/2e1", "excess_w4": f"(({_K}*47 % 70) - 45)/2e1", "ir_candidate": f"{_K} % 3 <> 1",
        "n_obs": f"CAST({_K}*3 % 120 AS INT)", "phot_excess": f"5e-1 + ({_K}*17 % 140)/1e2", "multi_peak": f"CAST({_K}*5 % 25 AS INT)", "nss": f"CASE WHEN {_K} % 14 = 0 THEN 1 ELSE 0 END",
        "harmonic": f"({_K}*3 % 30)/1e2", "n_params": f"CASE WHEN {_K} % 4 = 0 THEN 31 ELSE 5 END",
        "otype": f"CASE {_K} % 12 WHEN 0 THEN 'SB*' WHEN 1 THEN 'QSO' WHEN 2 THEN 'TTau*' WHEN 3 THEN 'V*' WHEN 4 THEN 'EB*' WHEN 5 THEN NULL ELSE '*' END",
        "dimming_score": f"({_K}*59 % 100)/1e2", "n_radio_hits": f"CAST({_K}*3 % 7 AS INT)", "hit_snr": f"({_K}*5 % 400)/1e1",
        "variability": f"CASE WHEN {_K} % 6 = 5 THEN NULL ELSE ({_K}*7 % 200)/1e3 END", "n_epochs": f"CAST({_K}*13 % 40 AS INT)",
        "n_hz": f"CAST({_K} % 4 AS INT)", "ir_var_score": f"CASE WHEN {_K} % 7 = 2 THEN NULL ELSE ({_K}*67 % 100)/1e2 END", "ir_var_source": f"CASE {_K} % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'simulated' ELSE 'real' END",
        "k_w1": f"CASE WHEN {_K} % 9 = 4 THEN NULL ELSE ({_K}*3 % 160)/1e2 - 8e-1 END", "epochs_ir": f"CAST({_K}*7 % 60 AS INT)",
    }, None),
    # Earlier verdicts on the targets, for the vetting rules.
    "verdicts": ("customer", {
        "target_id": _K, "n_active": f"CAST({_K} % 5 AS INT)", "pair_is_known": f"{_K} % 2 = 0", "verdict": f"CASE {_K} % 3 WHEN 0 THEN 'EXPLAINED' WHEN 1 THEN 'PARTIALLY_EXPLAINED' ELSE 'UNEXPLAINED' END",
        "is_fdr": f"{_K} % 7 = 0", "chance_p": f"CASE WHEN {_K} % 4 = 0 THEN NULL ELSE ({_K}*61 % 1000)/4e4 END", "orbit_match": f"CASE WHEN {_K} % 6 = 0 THEN NULL ELSE {_K} % 17 = 1 END",
        "object_risk": f"CASE WHEN {_K} % 5 = 2 THEN NULL ELSE ({_K} % 10)/1e1 END", "n_real": f"CAST({_K}*3 % 6 AS INT)", "n_simulated": f"CASE WHEN {_K} % 11 = 3 THEN 1 ELSE 0 END",
        "stouffer_p": f"CASE WHEN {_K} % 13 = 5 THEN NULL ELSE ({_K}*97 % 1000)/2e4 END", "unexplained": f"({_K}*71 % 100)/1e2", "recommendation": f"CASE WHEN {_K} % 3 = 0 THEN 'ESCALATE' WHEN {_K} % 3 = 1 THEN 'MONITOR' ELSE 'DEMOTE' END",
        "top_share": f"({_K}*43 % 100)/1e2", "n_runs": f"CAST({_K} % 4 AS INT)", "chi2_red": f"({_K}*59 % 130)*1e0",
    }, None),
    "outcomes": ("labels", {
        "target_id": "doc_id", "expected": "CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END",
        "observed": "toxic", "score": "(doc_id*37 % 100)/1e2",
    }, None),
}

_CHANNEL_ROWS = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CHANNELS, 1))
_CALIBRATED_ROWS = ", ".join(f"({CHANNELS.index(c) + 1}, '{c}')" for c in CALIBRATED)
_SCORE = (
    "CASE WHEN (c_custkey + no) % 5 = 0 THEN NULL "
    "ELSE ((c_custkey*(101 + 17*no)) % 1000)/1e3 END"
)
_CONTROL = "((p_partkey*(89 + 13*no)) % 1000)/1e3"
_POWER = "sum(l_quantity)"
# Narrow-band signals that drift by five channels a step.
_DRIFTING = "CASE WHEN (l_partkey - 5*(l_suppkey % 16)) % 97 = 0 THEN 2e2 ELSE 0e0 END"
# One point per (source, time): several line items may share both.
GROUPED = {
    "lightcurve": ("lineitem", {
        "target_id": "l_suppkey", "time": "({us:l_shipdate} - 694224000000000)/8.64e10 + l_linenumber/1e1",
        "sector": "CAST(year(l_shipdate) AS INT)",
    }, {"flux": "max(1e0 - l_discount/5e0 + (l_orderkey % 13)/1e4)", "flux_err": "max(1e-3 + l_tax/1e1)"}),
    "residuals": ("lineitem", {
        "pulsar_id": "l_suppkey", "mjd": "5e4 + ({us:l_shipdate} - 694224000000000)/8.64e10 + l_linenumber/1e1",
    }, {"residual_us": "max((l_extendedprice - 1e3*floor(l_extendedprice/1e3))/1e2 - 5e0)",
        "uncertainty_us": "max(5e-1 + l_tax*1e1)"}),
}
GROUPED_SQL = {
    "scores": f"SELECT c_custkey AS target_id, c_mktsegment AS population, channel, {_SCORE} AS score "
              f"FROM customer, (VALUES {_CHANNEL_ROWS}) v(no, channel)",
    "controls": f"SELECT p_partkey AS control_id, channel, {_CONTROL} AS score "
                f"FROM part, (VALUES {_CALIBRATED_ROWS}) v(no, channel)",
    "spectrogram": f"SELECT l_partkey % 64 AS f_idx, l_suppkey % 16 AS t_idx, {_POWER} AS power, "
                   "1.4e3 + 3e-6*(l_partkey % 64) AS freq_mhz, 2e1*(l_suppkey % 16) AS t_sec "
                   "FROM lineitem GROUP BY ALL",
    "wide_spectrogram": f"SELECT l_partkey AS f_idx, l_suppkey % 16 AS t_idx, {_POWER} + {_DRIFTING} AS power, "
                        "1.4e3 + 3e-6*l_partkey AS freq_mhz, 2e1*(l_suppkey % 16) AS t_sec "
                        "FROM lineitem GROUP BY l_partkey, l_suppkey % 16",
    "bursts": f"SELECT user_id AS source_id, {ra_of('15*user_id')} AS ra, {dec_of('15*user_id')} + 5e-2 AS dec, "
              "count(*) AS n_bursts FROM events GROUP BY user_id",
}
# Tables whose positions are whole arcseconds or arcminutes apart: their declinations are the database's to the last digit.
PLACED = ("customer", "part", "supplier")
_US = re.compile(r"\{us:(\w+)\}")
_FX = re.compile(r"\bfx_(\w+)\b")


def _fixture_sql(name: str) -> str:
    if name in GROUPED_SQL:
        return GROUPED_SQL[name]
    if name in GROUPED:
        source, keys, values = GROUPED[name]
        items = ", ".join(f"{_US.sub(r'epoch_us(\1)', e)} AS {c}" for c, e in {**keys, **values}.items())
        return f"SELECT {items} FROM {source} GROUP BY ALL"
    source, columns, where = SCALAR[name]
    items = ", ".join(f"{_US.sub(r'epoch_us(\1)', e)} AS {c}" for c, e in columns.items())
    return f"SELECT {items} FROM {source}" + (f" WHERE {where}" if where else "")


def with_fixtures(sql: str) -> str:
    """Put the definitions of all fx_ tables a statement names in front of it."""
    names = list(dict.fromkeys(_FX.findall(sql)))
    if not names:
        return sql
    head = ",\n".join(f"fx_{n} AS ({_fixture_sql(n)})" for n in names)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {head},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {head},\n{body[4:].lstrip()}"
    return f"WITH {head}\n{body}"


class Tables:
    """Given and derived tables of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.udf.register("libm_asin", libm_asin)
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self._build(name)
        self.__dict__[name] = df
        return df

    def _build(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in SCALAR:
            source, columns, where = SCALAR[name]
            df = getattr(self, source)
            if where:
                df = df.filter(where)
            as_micros = r"unix_micros(CAST(\1 AS TIMESTAMP))"
            if source in PLACED:
                columns = {c: e.replace("asin(", "libm_asin(") for c, e in columns.items()}
            return df.selectExpr(*[f"{_US.sub(as_micros, e)} AS {c}" for c, e in columns.items()])
        if name in GROUPED:
            source, keys, values = GROUPED[name]
            as_micros = r"unix_micros(CAST(\1 AS TIMESTAMP))"
            by = [F.expr(_US.sub(as_micros, e)).alias(c) for c, e in keys.items()]
            return getattr(self, source).groupBy(*by).agg(*[F.expr(e).alias(c) for c, e in values.items()])
        if name in ("scores", "controls", "spectrogram", "wide_spectrogram", "bursts"):
            return getattr(self, f"_{name}")()
        raise AttributeError(name)

    def _per_channel(self, df: DataFrame, channels) -> DataFrame:
        pairs = [F.struct(F.lit(CHANNELS.index(c) + 1).alias("no"), F.lit(c).alias("channel")) for c in channels]
        return df.withColumn("v", F.explode(F.array(*pairs))).select("*", "v.no", "v.channel")

    def _scores(self) -> DataFrame:
        df = self._per_channel(self.customer, CHANNELS)
        return df.selectExpr("c_custkey AS target_id", "c_mktsegment AS population", "channel", f"{_SCORE} AS score")

    def _controls(self) -> DataFrame:
        df = self._per_channel(self.part, CALIBRATED)
        return df.selectExpr("p_partkey AS control_id", "channel", f"{_CONTROL} AS score")

    def _spectrogram(self) -> DataFrame:
        df = self.lineitem.selectExpr("l_partkey % 64 AS f_idx", "l_suppkey % 16 AS t_idx", "l_quantity")
        return df.groupBy("f_idx", "t_idx").agg(F.sum("l_quantity").alias("power")).selectExpr(
            "f_idx", "t_idx", "power", "1.4e3 + 3e-6*f_idx AS freq_mhz", "2e1*t_idx AS t_sec")

    def _wide_spectrogram(self) -> DataFrame:
        df = self.lineitem.groupBy("l_partkey", F.expr("l_suppkey % 16 AS l_suppkey")).agg(F.sum("l_quantity").alias("power"))
        return df.selectExpr("l_partkey AS f_idx", "l_suppkey AS t_idx", f"power + {_DRIFTING} AS power",
                             "1.4e3 + 3e-6*l_partkey AS freq_mhz", "2e1*l_suppkey AS t_sec")

    def _bursts(self) -> DataFrame:
        df = self.events.groupBy("user_id").agg(F.count("*").alias("n_bursts"))
        return df.selectExpr("user_id AS source_id", f"{ra_of('15*user_id')} AS ra",
                             f"{dec_of('15*user_id')} + 5e-2 AS dec", "n_bursts")
