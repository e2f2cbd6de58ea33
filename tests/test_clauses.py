"""Clauses of single operators on small inputs."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from skysift.functions import numeric as N
from skysift.operators import spatial, stats
from skysift.operators.templates import source_patterns
from skysift.plans.detectors import stacked_anomalies
from skysift.plans.registry import ORACLES, QUERIES
from skysift.plans.tables import Tables, with_fixtures
from skysift.sources import readers
from skysift.sources.sinks import without_nan


def test_nested_numbers_are_cleaned(spark):
    nan, inf = float("nan"), float("inf")
    schema = "id int, x double, xs array<struct<a:double,b:string>>, m map<string,array<float>>, s struct<p:struct<q:double>,r:int>"
    rows = [(1, nan, [(nan, "u"), (2.0, None), None], {"k": [inf, 1.5, None]}, ((-inf,), 3)), (2, 1.0, None, None, None), (3, None, [], {}, (None, None))]
    found = [tuple(r) for r in without_nan(spark.createDataFrame(rows, schema)).orderBy("id").collect()]
    assert found[0] == (1, None, [(None, "u"), (2.0, None), None], {"k": [None, 1.5, None]}, ((None,), 3))
    assert found[1] == (2, 1.0, None, None, None) and found[2] == (3, None, [], {}, (None, None))
    assert without_nan(spark.createDataFrame(rows, schema)).schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()


def test_excess_strength(spark):
    rows = [("a", v, True) for v in (1.0, 4.0, 5.0, 9.0, None)] + [("a", 50.0, False), ("b", 0.5, True)]
    df = spark.createDataFrame(rows, "f string, v double, t boolean")
    found = {r["f"]: r for r in stats.excess_strength(df, ["f"], "v", F.col("t")).collect()}
    assert found["a"]["share_above"] == 0.75 and found["a"]["strength"] == pytest.approx(1 - math.exp(-5 / 6))
    assert found["a"]["detection"] == pytest.approx(0.375 + 0.5 * (1 - math.exp(-5 / 6)))
    assert (found["b"]["share_above"], found["b"]["strength"], found["b"]["detection"]) == (0.0, 0.0, 0.0)


def test_stacking_counts_channels(spark):
    """A target that is odd in two channels comes before those that are odd in one, by a power of ten."""
    one = spark.createDataFrame([(i, (i * 37 % 100) / 100, (i * 61 % 100) / 100) for i in range(300)] + [(999, 9.0, -9.0)], "target_id long, a double, b double")
    two = spark.createDataFrame([(i, (i * 17 % 100) / 100) for i in range(200)] + [(999, 7.0), (998, -6.0)], "target_id long, c double")
    rows = stacked_anomalies({"one": (one, ("a", "b"), 301), "two": (two, ("c",), 202)}).orderBy(F.desc("k"), F.desc("convergence")).collect()
    assert rows[0]["target_id"] == 999 and rows[0]["k"] == 2 and rows[0]["channels"] == ["one", "two"]
    assert rows[0]["convergence"] == pytest.approx(rows[0]["mean"] * 10) and all(r["k"] == 1 for r in rows[1:])
    assert 1 <= len(rows) <= 301 * 0.01 + 202 * 0.01 + 3


def test_exact_enrichment(spark):
    """Against exact fractions of binomial coefficients, at ends, at ties and far out; counts of a million stay quick."""
    from fractions import Fraction
    from math import comb

    rows = [(n, m, d, k) for n, m, d in ((20, 7, 9), (777, 7, 53), (50, 25, 25), (30, 28, 20), (5, 0, 3), (400, 200, 150)) for k in range(max(0, m + d - n) - 1, min(m, d) + 2)]
    rows += [(10**6, 5 * 10**5, 10**5, 50_000 + x) for x in (-900, 0, 10, 700)]
    df = spark.createDataFrame(rows, "n long, m long, d long, k long")
    h = N.Hypergeometric(F.col("n"), F.col("m"), F.col("d"))
    k = F.col("k").cast("double")
    for r in df.select("n", "m", "d", "k", h.share(k).alias("share"), h.at_least(k).alias("tail"), h.two_sided(k).alias("fisher"), h.mean.alias("mean"), h.variance.alias("variance")).collect():
        if r["n"] == 10**6:
            z = (r["k"] - 0.5 - r["mean"]) / math.sqrt(r["variance"])
            assert r["tail"] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=2e-2, abs=1e-6)
            continue
        whole = comb(r["n"], r["d"])
        every = {i: Fraction(comb(r["m"], i) * comb(r["n"] - r["m"], r["d"] - i), whole) for i in range(max(0, r["m"] + r["d"] - r["n"]), min(r["m"], r["d"]) + 1)}
        here = every.get(r["k"], Fraction(0))
        assert r["share"] == pytest.approx(float(here), rel=1e-9, abs=1e-300)
        assert r["tail"] == pytest.approx(float(sum(v for i, v in every.items() if i >= r["k"])), rel=1e-8, abs=1e-15)
        assert r["fisher"] == pytest.approx(float(sum(v for v in every.values() if v <= here)) if here else 0.0, rel=1e-6, abs=1e-12)
        mean = sum(i * v for i, v in every.items())
        assert r["mean"] == pytest.approx(float(mean)) and r["variance"] == pytest.approx(float(sum(i * i * v for i, v in every.items()) - mean * mean), abs=1e-9)


def test_positions_are_the_databases(spark, tmp_path):
    """Declinations of all residues of the formula, to the last digit: catalogs lie whole arcseconds apart, at the limits of queries."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS c_custkey, 'x' AS c_name, 0 AS c_nationkey, 0e0 AS c_acctbal, 'y' AS c_mktsegment FROM range(100003)) TO '{tmp_path}/customer.parquet'")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    wanted = con.execute(with_fixtures("SELECT dec, w3_dec FROM fx_photometry ORDER BY target_id")).fetchall()
    assert [tuple(r) for r in Tables(spark, str(tmp_path)).photometry.orderBy("target_id").select("dec", "w3_dec").collect()] == wanted


def test_event_without_energy(spark, tmp_path):
    """The decimal logarithm of a zero energy is minus infinity."""
    (tmp_path / "events.csv").write_text("Time,RA[deg],Dec[deg],log10(E/GeV)\n57000,1,2,-Infinity\n57001,3,4,2\n57002,5,6,\n57003,7,8,NaN\n")
    assert [r["energy_gev"] for r in readers.event_csv(spark, str(tmp_path / "events.csv")).orderBy("mjd").collect()] == [0.0, 100.0, None, None]


def test_wide_scores_take_one_hash_aggregate(spark):
    """Channels become columns without a second grouping and without sorted rows, which are kept in a task's memory."""
    rows = [(1, "ir_excess", 0.5), (1, "ir_excess", 0.7), (1, "uv_anomaly", None), (2, "hr_anomaly", 0.2), (2, "habitable_zone_planet", 0.9)]
    wide = source_patterns(spark.createDataFrame(rows, "target_id int, channel string, score double"))
    plan = spark._jvm.PythonSQLUtils.explainString(wide._jdf.queryExecution(), "simple")
    found = {r["target_id"]: r for r in wide.collect()}
    assert (found[1]["ir_excess"], found[1]["uv_anomaly"], found[1]["active"], found[2]["hr_anomaly"], found[2]["n_active"]) == (0.7, None, ["ir_excess"], 0.2, 0)
    assert plan.count("Exchange") == 1 and "Sort" not in plan


def test_coverage_table_takes_one_hash_aggregate(spark):
    table = QUERIES["data_coverage_table"](Tables(spark, "/root/testdata/sf0.001"))
    plan = spark._jvm.PythonSQLUtils.explainString(table._jdf.queryExecution(), "simple")
    assert plan.count("Exchange") == 1 and "Sort" not in plan


@pytest.mark.parametrize("metric", ["sphere", "flat"])
def test_morans_i_by_groups(spark, monkeypatch, metric):
    """Many groups, copies of a place, places closer than the floor and at a pole, against all pairs one by one."""
    monkeypatch.setattr(spatial, "GROUP", 30)
    rng = random.Random(3)
    rows = [(rng.uniform(0, 360), rng.uniform(-90, 90), rng.random()) for _ in range(150)] + [(10.0, 20.0, 0.9)] * 70
    rows += [(10.0 + 1e-7 * i, 20.0, 0.8) for i in range(20)] + [(5.0, 90.0, 0.1), (200.0, 90.0, 0.3), (None, 1.0, 0.5), (1.0, 1.0, None)]
    got = spatial.morans_i(spark.createDataFrame(rows, "ra double, dec double, s double"), "s", metric).first()
    known = [r for r in rows if None not in r]
    mean = sum(s for *_, s in known) / len(known)
    total = product = 0.0
    for i, (r1, d1, s1) in enumerate(known):
        for j, (r2, d2, s2) in enumerate(known):
            a, b = math.radians(d1), math.radians(d2)
            h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(r2 - r1) / 2) ** 2
            d = math.hypot(r1 - r2, d1 - d2) if metric == "flat" else math.degrees(2 * math.asin(min(1.0, math.sqrt(h))))
            if i != j and d > 0:
                total += 1 / max(d, 0.01)
                product += (s1 - mean) * (s2 - mean) / max(d, 0.01)
    variance = sum((s - mean) ** 2 for *_, s in known) / len(known)
    assert got["n"] == len(known) and got["morans_i"] == pytest.approx(product / (total * variance), abs=1e-9)


def test_tails_take_rows_in_batches_and_keep_nulls(spark):
    rows = [(float(n), r) for n in (0, 1, 3, 99, 100, 101, 5000) for r in (0.5, 90.0, 4900.0, 5100.0)] + [(2.0, None)]
    df = spark.createDataFrame(rows, "n double, r double")
    tails = df.select("n", "r", N.poisson_tail(F.col("n"), F.col("r")).alias("p"), N.chi_square_tail(F.col("r"), F.col("n")).alias("q"))
    plan = tails._jdf.queryExecution().toString()
    assert "aggregate(" not in plan and "ArrowEvalPython" in plan
    for n, r, p, q in tails.collect():
        if r is None:
            assert p is None and q is None
            continue
        mine = 1.0 if n == 0 else -math.expm1(math.log(max(1e-300, sum(math.exp(i * math.log(r) - r - math.lgamma(i + 1)) for i in range(int(n))))))
        assert abs(p - mine) < 2e-9, (n, r)
        if n % 2 == 0 and n:
            want = sum(math.exp(i * math.log(r / 2) - r / 2 - math.lgamma(i + 1)) for i in range(int(n) // 2))
            assert abs(q - want) < 2e-9, (n, r)


def _lattice(n):
    return [(i, float(i % 9), float(i // 9 % 9), float(i // 81 % 3), random.Random(i).choice([0.1, 0.4, 0.8, 0.9])) for i in range(n)]


def test_shell_sums_bound_every_ball(monkeypatch):
    """No ball exceeds its centre's bound, also where distances fall on the shells' edges, and the bound follows the strengths."""
    monkeypatch.setattr(spatial, "BINNED", 1 << 12)
    rng = np.random.default_rng(2)
    far = rng.normal(size=(9000, 3)) * 30
    for places in (np.array([r[1:4] for r in _lattice(200)]), far, np.zeros((70, 3))):
        near = dict(zip("xyz", places.T), s=rng.uniform(size=len(places)) ** 3, key=np.arange(len(places)))
        mean, var = near["s"].mean(), near["s"].var()
        centres = {c: v[:40] for c, v in near.items()}
        bound, strengths = spatial._most(centres, near, near["s"] - mean, var, 6.0, 3), []
        for i in range(40):
            rows, _ = spatial._ordered(tuple(centres[c][i] for c in "xyz"), near, 6.0)
            k = np.arange(1, len(rows) + 1)
            total = np.cumsum(near["s"][rows] - mean)
            strengths.append((np.maximum(total, 0) ** 2 / (2 * var * k))[2:].max(initial=0))
        assert (bound >= strengths).all()
        assert len(places) < 9000 or np.corrcoef(bound, strengths)[0, 1] > 0.7


def test_scan_copies_points_a_few_times_a_core(spark):
    """However many tasks a shuffle has, and however many points lie in a cell."""
    df = spark.createDataFrame([(i, x / 9, y / 9, z / 9, s) for i, x, y, z, s in _lattice(4000)], "key long, x double, y double, z double, s double")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        sides, _ = spatial._dealt(df, 6.0)
        own, near = (sides.where(w).agg(F.sum(F.size("x"))).first()[0] for w in ("own", "NOT own"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert own == 4000 and near <= 4000 * 5 * spark.sparkContext.defaultParallelism


def test_scan_equals_all_balls_and_settles(spark):
    rows = _lattice(240)
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, s double")
    mean = sum(r[4] for r in rows) / len(rows)
    var = sum((r[4] - mean) ** 2 for r in rows) / len(rows)
    best = max((max((sum(s - mean for *_, s in ball[:k]) / k > 0) * k * (sum(s for *_, s in ball[:k]) / k - mean) ** 2 / (2 * var) for k in range(3, len(ball) + 1))
                for c in rows for ball in [sorted((math.dist(c[1:4], r[1:4]), r[0], r[4]) for r in rows if math.dist(c[1:4], r[1:4]) <= 4.0)]))
    whole = spatial.scan_statistic(df, "id", "s", 4.0, permutations=99).first()
    assert whole["lr"] == pytest.approx(best, rel=1e-9)
    part = spatial.scan_statistic(df, "id", "s", 4.0, permutations=99, settled=0.02).first()
    assert part[:4] == whole[:4] and (part["p"] >= 0.02) == (whole["p"] >= 0.02) and part["p"] <= whole["p"]


def test_morans_i_by_far_cells(spark, monkeypatch):
    """Cells that meet through their nodes against all pairs, with copies of a place, a pole, places closer than the floor and opposite ones."""
    rng = np.random.default_rng(4)
    ra, dec = rng.uniform(0, 360, 2400), np.degrees(np.arcsin(rng.uniform(-1, 1, 2400)))
    ra, dec = np.concatenate([ra, ra[:300] + 180, ra[:50] + 1e-4, ra[50:90], [5.0, 200.0]]), np.concatenate([dec, -dec[:300], dec[:90], [90.0, 90.0]])
    ra %= 360
    s = 0.2 * np.sin(np.radians(ra)) * np.cos(np.radians(dec)) + rng.normal(size=len(ra))
    every = spatial._with_vectors(ra, dec, s - s.mean())
    weight, product = spatial._squares(every, every, "sphere", 0.01)
    monkeypatch.setattr(spatial, "PART", 40)
    df = spark.createDataFrame(pd.DataFrame({"ra": ra, "dec": dec, "z": s - s.mean()}))
    known = len(spatial._near_cells(8)), (6 * 64) * (6 * 64 + 1) / 2
    assert known[0] < 0.3 * known[1]
    total = spatial._sums_by_cells(df, 180_000, 0.01, 8).agg(F.sum("w"), F.sum("wz")).first()  # cells of 8 x 8 a face
    assert total[0] == pytest.approx(weight, rel=1e-9)
    assert abs(total[1] - product) < 1e-9 * weight
    monkeypatch.setattr(spatial, "FAR_FROM", 1000)
    got = spatial.morans_i(df.withColumnRenamed("z", "s"), "s").first()
    assert got["morans_i"] == pytest.approx(product / (weight * s.var()), abs=1e-9)


def test_hypothesis_registry_by_far_cells_matches_sql(spark, monkeypatch):
    monkeypatch.setattr(spatial, "FAR_FROM", 100)
    called, whole = [], spatial._sums_by_cells
    monkeypatch.setattr(spatial, "_sums_by_cells", lambda *a: called.append(1) or whole(*a))
    folder = "/root/testdata/sf0.001"
    assert compare(QUERIES["hypothesis_registry"](Tables(spark, folder)), connect(folder), with_fixtures(ORACLES["hypothesis_registry"])) == ""
    assert called
