"""Edges and planted signals, worked out by hand or by brute force."""

import math
import statistics

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skysift.functions import numeric as N
from skysift.functions import photometry as P
from skysift.functions import sphere as S
from skysift.operators import associations, detectors, ordered, scoring, skyjoin, spatial, stats, timeseries
from skysift.operators.forest import isolation_scores
from skysift.operators.selection import hash_sample


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def sky(spark, n, seed, key):
    return spark.createDataFrame(
        [(i, (i * 137.507764 + seed) % 360, math.degrees(math.asin(2 * ((i * 61803 + seed * 7919) % 100003) / 100003 - 1))) for i in range(n)], f"{key} long, ra double, dec double")


@pytest.mark.parametrize("radius", [0.5, 4.0, 50.0])
def test_cone_join_equals_brute_force_with_split_cells(spark, radius):
    a, b = sky(spark, 400, 1, "a"), sky(spark, 500, 5, "b")
    got = values(skyjoin.pairs(a, b, radius, hot_rows=5), "a", "r_b")
    other = b.toDF("r_b", "r_ra", "r_dec")
    want = values(a.join(other, F.lit(True)).filter(S.separation("ra", "dec", "r_ra", "r_dec") <= radius), "a", "r_b")
    assert got == want and len(got) == len(set(got))


def test_cone_join_at_wrap_and_poles(spark):
    a = spark.createDataFrame([(1, 359.999, 0.0), (2, 10.0, 90.0), (3, 200.0, -89.9995)], "a int, ra double, dec double")
    b = spark.createDataFrame([(1, 0.001, 0.0), (2, 190.0, 89.9995), (3, 20.0, -90.0)], "b int, ra double, dec double")
    assert values(skyjoin.pairs(a, b, 0.0025), "a", "r_b") == [(1, 1), (2, 2), (3, 3)]


def test_nearest_with_piled_up_copies_and_empty_side(spark):
    a = spark.createDataFrame([(i, 10.0, 10.0) for i in range(30)], "a long, ra double, dec double")
    b = spark.createDataFrame([(i, 10.0, 10.0002) for i in range(40)], "b long, ra double, dec double")
    near = skyjoin.nearest(a, b, 0.001, left_key="a", right_key="b", hot_rows=3)
    assert values(near, "a", "r_b") == [(i, 0) for i in range(30)]
    assert skyjoin.nearest(a, b.limit(0), 0.001, left_key="a", right_key="b").count() == 0
    assert skyjoin.nearest(a, b.limit(0), 0.001, left_key="a", right_key="b", keep_unmatched=True).count() == 30


def test_ordered_operators_equal_windows_on_a_hot_key(spark):
    rows = [(0 if i % 3 else i % 5, float((i * 7919) % 101), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, v double, id long")
    p = ordered.with_position(df, "k", "v", "id")
    p = ordered.running(p, ["k"], {"total": (F.col("v"), "sum"), "top": (F.col("v"), "max")}, chunk=32)
    p = ordered.running(p, ["k"], {"left": (F.lit(1), "sum")}, reverse=True, chunk=32)
    p = ordered.neighbours(p, ["k"], {"before": ("v", -1), "later": ("v", 2)}, chunk=32)
    w = Window.partitionBy("k").orderBy("v", "id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    p = (p.withColumn("t2", F.sum("v").over(up)).withColumn("b2", F.lag("v").over(w)).withColumn("l2", F.lead("v", 2).over(w))
         .withColumn("left2", F.count("*").over(w.rowsBetween(0, Window.unboundedFollowing))))
    assert p.count() == 600
    assert p.filter("abs(total - t2) > 1e-6 OR NOT before <=> b2 OR NOT later <=> l2 OR left <> left2 OR top <> v").count() == 0
    assert sorted(r["pos"] for r in p.select("pos").collect()) == list(range(600))


def test_quantiles_interpolate_and_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", None), ("b", 5.0), ("c", None)], "k string, v double")
    got = {r["k"]: (r["m"], r["q"]) for r in ordered.quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.25}).collect()}
    assert got == {"a": (2.0, 1.5), "b": (5.0, 5.0)}
    assert ordered.quantiles(df.filter("v > 100"), ["k"], "v", {"m": 0.5}).count() == 0


def test_special_functions(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first()["x"]
    assert pick(N.normal_tail(F.lit(1.5))) == pytest.approx(1 - statistics.NormalDist().cdf(1.5), rel=1e-12)
    assert pick(N.normal_tail_inverse(F.lit(0.003))) == pytest.approx(-statistics.NormalDist().inv_cdf(0.003), rel=1e-12)
    assert pick(N.sigma_of_p(F.lit(1.0))) == 0.0 and pick(N.sigma_of_p(F.lit(0.0))) == 10.0
    assert pick(N.poisson_tail(F.lit(0), F.lit(0.0))) == 1.0 and pick(N.poisson_tail(F.lit(2), F.lit(0.0))) == 1e-30
    assert pick(N.chi_square_tail(F.lit(3.0), F.lit(1))) == pytest.approx(0.0832645166635504, rel=1e-9)
    assert pick(N.student_tail(F.lit(2.0), F.lit(7))) == pytest.approx(0.0856, abs=1e-4)
    assert pick(N.student_tail(F.lit(2.0), F.lit(10))) == pytest.approx(0.07339, abs=1e-4)
    assert pick(N.binomial_tail(F.lit(0), F.lit(10), F.lit(0.2))) == 1.0
    assert pick(N.safe_number(F.lit("nan"))) is None and pick(N.safe_number(F.lit(" 7 "))) == 7.0


def test_false_discovery_by_hand_and_empty(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.04), (4, 0.9), (5, 0.0)], "id int, p double")
    q = {r["id"]: round(r["q_value"], 6) for r in stats.benjamini_hochberg(df, "p").collect()}
    assert q == {5: 0.0, 1: 0.025, 2: 0.05, 3: 0.05, 4: 0.9}
    assert stats.benjamini_hochberg(df.limit(0), "p").count() == 0


def test_empirical_p_counts_ties_and_missing_controls(spark):
    t = spark.createDataFrame([(1, "x", 0.5), (2, "x", 0.9), (3, "y", 0.1), (4, "x", None)], "id int, channel string, score double")
    c = spark.createDataFrame([("x", 0.5), ("x", 0.7), ("x", 0.2)], "channel string, score double")
    assert values(stats.empirical_p(t, c, ["channel"]).filter("p IS NOT NULL"), "id", "p") == [(1, 0.6), (2, 0.2), (3, 1.0)]
    assert values(stats.empirical_p(t, c, ["channel"], strict=True).filter("id = 1"), "p") == [(0.4,)]


def test_one_certain_null_forces_combined_p_to_one(spark):
    df = spark.createDataFrame([("a", 1e-6), ("a", 1.0), ("b", 1e-6), ("b", 1e-6), ("c", None)], "k string, p double")
    total, squares, ones = stats.stouffer("p")
    got = {r["k"]: r["p"] for r in df.groupBy("k").agg(total.alias("t"), squares.alias("s"), ones.alias("o")).select("k", stats.stouffer_p(F.col("t"), F.col("s"), F.col("o")).alias("p")).collect()}
    assert got["a"] == 1.0 and got["b"] < 1e-9 and got["c"] == 1.0


def test_score_at_the_threshold_is_inactive(spark):
    df = spark.createDataFrame([(1, "ir_excess", 0.3), (1, "uv_anomaly", 0.31), (2, "ir_excess", None), (2, "habitable_zone_planet", 0.5)], "target_id int, channel string, score double")
    got = {r["target_id"]: r for r in scoring.convergence(df).collect()}
    assert got[1]["n_active"] == 1 and got[1]["total_score"] == pytest.approx(0.31 * math.sqrt(0.2))
    assert got[2]["n_active"] == 0 and got[2]["total_score"] == 0.0


def test_matched_controls_equal_brute_force(spark):
    t = spark.createDataFrame([(i, (i * 37 % 100) / 10, (i * 61 % 100) / 10, float(i % 7)) for i in range(40)], "t long, a double, b double, c double")
    p = spark.createDataFrame([(i, (i * 41 % 100) / 9, (i * 67 % 100) / 11, float(i % 5)) for i in range(300)] + [(999, None, 1.0, 1.0)], "p long, a double, b double, c double")
    got = stats.matched_controls(t, p, ("a", "b", "c"), 5, target_key="t", pool_key="p")
    z = stats.z_scores(t.selectExpr("t AS id", "a", "b", "c", "0 AS side").union(p.filter("a IS NOT NULL").selectExpr("p", "a", "b", "c", "1")), ("a", "b", "c"))
    left, right = z.filter("side = 0"), z.filter("side = 1").selectExpr("id AS p", "z_a AS a2", "z_b AS b2", "z_c AS c2")
    d = F.sqrt(F.pow(F.col("z_a") - F.col("a2"), F.lit(2)) + F.pow(F.col("z_b") - F.col("b2"), F.lit(2)) + F.pow(F.col("z_c") - F.col("c2"), F.lit(2)))
    want = skyjoin.best_per_group(left.join(right, F.lit(True)).withColumn("d", d), ["id"], [F.col("d"), F.col("p")], 5)
    assert [round(x[1], 9) for x in values(got, "t", "distance")] == [round(x[1], 9) for x in values(want, "id", "d")]


def test_chains_merge_into_one_group(spark):
    step = 4 / 3600
    rows = [(i, 50.0, i * step) for i in range(20)] + [(100 + i, 50.0, 5.0) for i in range(30)] + [(200, 80.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, ra double, dec double")
    got = {r["id"]: r["label"] for r in associations.merge_nearby(df, 5 / 3600).collect()}
    assert {got[i] for i in range(20)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[200] == 200


def test_scan_finds_a_planted_cluster(spark):
    rows = [(i, float(i % 10), float(i // 10 % 10), float(i % 3), 0.9 if i % 10 < 3 and i // 10 % 10 < 3 else 0.1 + (i % 7) / 100) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, s double")
    ball = spatial.scan_statistic(df, "id", "s", 6.0)
    best = ball.first()
    assert best["p"] <= 0.01 and best["members"] >= 8
    flat = df.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0)
    assert spatial.scan_statistic(flat, "id", "s", 6.0, permutations=199).first()["p"] > 0.05
    assert spatial.scan_statistic(df.withColumn("s", F.lit(1.0)), "id", "s", 6.0, permutations=9).collect() == []
    assert spatial.cluster_members(df, "id", ball).count() == best["members"]


def test_forest_ranks_a_planted_outlier_first(spark):
    rows = [(i, (i * 37 % 100) / 100, (i * 61 % 100) / 100) for i in range(500)] + [(999, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    top = isolation_scores(df, "id", ("a", "b"), trees=50).orderBy(F.desc("isolation")).first()
    assert top["id"] == 999


def test_sun_sits_on_the_ridge(spark):
    df = spark.createDataFrame([(1, 4.67, 0.82, 100.0, 0.0)], "target_id int, g double, bp_rp double, parallax double, mh double")
    assert detectors.ridge_outlier(df).first()["hr_score"] == 0.0
    assert spark.range(1).select(P.ridge_magnitude(F.lit(9.0)).alias("x")).first()["x"] is None


def test_results_do_not_depend_on_partitions(spark):
    df = sky(spark, 300, 3, "id")
    assert values(hash_sample(df.repartition(1), "id", 20), "id") == values(hash_sample(df.repartition(7), "id", 20), "id")
    near = [values(skyjoin.pairs(df.repartition(n), df.repartition(n + 2), 5.0, right_key="id"), "id", "r_id") for n in (1, 7)]
    assert near[0] == near[1]


def _terms(first_ratio_up, first_ratio_down, mode, low, high, start):
    """Share of a distribution's mass at `start` and above, from ratios of neighbouring terms around its mode."""
    below = above = 0.0
    term, i = 1.0, mode
    values = {mode: 1.0}
    while i < high and term > 1e-25:
        i += 1
        term *= first_ratio_up(i)
        values[i] = term
    term, i = 1.0, mode
    while i > low and term > 1e-25:
        term *= first_ratio_down(i)
        i -= 1
        values[i] = term
    total = math.fsum(values.values())
    below, above = math.fsum(v for k, v in values.items() if k < start), math.fsum(v for k, v in values.items() if k >= start)
    assert below + above == pytest.approx(total)
    return above / total


@pytest.mark.parametrize("rate", [1.0, 10.0, 99.0, 100.0, 101.0, 1e3, 1e4, 1e5, 1e6])
def test_tails_hold_at_any_count(spark, rate):
    starts = sorted({max(1, int(rate + z * math.sqrt(rate))) for z in (-4, -1, -0.1, 0, 0.3, 1, 3, 5)})
    rows = spark.createDataFrame([(n, rate) for n in starts], "n long, rate double").select("n", N.poisson_tail(F.col("n"), F.col("rate")).alias("p"), N.chi_square_tail(F.col("rate") * 2, F.col("n") * 2).alias("q")).collect()
    mode = int(rate)
    for r in rows:
        p = _terms(lambda i: rate / i, lambda i: i / rate, mode, 0, 1 << 60, r["n"])
        assert r["p"] == pytest.approx(p, rel=2e-9)
        assert r["q"] == pytest.approx(1 - p, rel=2e-9, abs=1e-12)


@pytest.mark.parametrize(("n", "share"), [(50, 0.3), (1000, 0.05), (1000, 0.5), (10_000, 0.001), (200_000, 0.4), (1_000_000, 0.02), (150, 0.95)])
def test_binomial_tail_at_any_count(spark, n, share):
    s = math.sqrt(n * share * (1 - share))
    starts = sorted({min(n, max(1, int(n * share + z * s))) for z in (-4, -1, 0, 0.5, 2, 5)})
    rows = spark.createDataFrame([(k, n, share) for k in starts], "k long, n long, s double").select("k", N.binomial_tail(F.col("k"), F.col("n"), F.col("s")).alias("p")).collect()
    odds = share / (1 - share)
    for r in rows:
        p = _terms(lambda i: (n - i + 1) / i * odds, lambda i: i / ((n - i + 1) * odds), int(n * share), 0, n, r["k"])
        assert r["p"] == pytest.approx(p, rel=2e-8, abs=1e-12)


def test_student_tail_joins_smoothly(spark):
    """The two forms agree where they meet, and many degrees of freedom approach the normal tail."""
    row = spark.range(1).select(*[N.student_tail(F.lit(t), F.lit(v)).alias(f"p{v}_{i}") for v in (199, 200, 201, 202, 10_000_000) for i, t in enumerate((0.5, 2.0, 6.0))], *[(2 * N.normal_tail(F.lit(t))).alias(f"z{i}") for i, t in enumerate((0.5, 2.0, 6.0))]).first()
    for i in range(3):
        a, b, c, d = (row[f"p{v}_{i}"] for v in (199, 200, 201, 202))
        assert a > b > c > d and (b - c) == pytest.approx((a - b + c - d) / 2, rel=0.02, abs=1e-12)
        assert row[f"p10000000_{i}"] == pytest.approx(row[f"z{i}"], rel=1e-5)


def test_ordered_work_with_a_hot_key_and_value(spark):
    """A third of all rows on one key and one value, null keys and null values; every result as a plain computation has it."""
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", None if i % 11 == 0 else 5.0 if i % 3 == 1 else float(i % 97), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double, id long")
    held = {}
    for k, v, _ in rows:
        held.setdefault(k, []).append(v)
    for r in ordered.quantiles(df, ["k"], "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}, size="n").collect():
        values = sorted(v for v in held[r["k"]] if v is not None)
        assert r["n"] == len(values)
        for name, p in (("q1", 0.25), ("q2", 0.5), ("q9", 0.9)):
            at = (len(values) - 1) * p
            low = values[int(at)]
            high = values[min(int(at) + 1, len(values) - 1)]
            assert r[name] == pytest.approx(low + (high - low) * (at - int(at)))
    ranks = ordered.ranked(df, ["k"], ["v", "id"], "rank").collect()
    assert len(ranks) == 3000
    for key, values in held.items():
        mine = [r for r in ranks if r["k"] == key]
        assert sorted(r["rank"] for r in mine) == list(range(1, len(values) + 1)) and {r["n"] for r in mine} == {len(values)}
    assert ordered.quantiles(df.filter("false"), [], "v", {"q": 0.5}).collect() == []


def test_a_cell_hot_on_both_sides_is_split(spark):
    left = spark.createDataFrame([(i, 10.0 + i * 1e-6, 5.0) for i in range(40)], "id long, ra double, dec double")
    right = spark.createDataFrame([(i, 10.0 + i * 1e-6, 5.0) for i in range(60)], "key long, ra double, dec double")
    plain = sorted((r["id"], r["r_key"]) for r in skyjoin.pairs(left, right, 0.00002, right_key="key").collect())
    split = sorted((r["id"], r["r_key"]) for r in skyjoin.pairs(left, right, 0.00002, right_key="key", hot_rows=7).collect())
    assert plain == split == sorted((i, j) for i in range(40) for j in range(60) if abs(i - j) * 1e-6 * math.cos(math.radians(5.0)) <= 0.00002)


def test_spearman_never_sends_exploded_rows_to_the_driver(spark):
    rows = spark.range(300).withColumn("k", F.explode(F.array(*(F.lit(i) for i in range(3)))))
    df = rows.selectExpr("CASE k WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS grp", "id*37 % 11 AS x", "CASE k WHEN 0 THEN id % 7 WHEN 1 THEN 5 END AS y").unionByName(rows.selectExpr("'a' AS grp", "NULL AS x", "id AS y"))
    found = stats.spearman(df, ["grp"], "x", "y")
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    xs, ys = pd.Series([i * 37 % 11 for i in range(300)]).rank(), pd.Series([i % 7 for i in range(300)]).rank()
    got = {r["grp"]: (r["rho"], r["n"]) for r in found.collect()}
    assert got == {"a": (pytest.approx(xs.corr(ys), abs=1e-12), 300), "b": (None, 300)}


def test_tasks_of_epoch_changes_go_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(skyjoin, "TASK_ROWS", 40)
    one = sky(spark, 400, 1, "id").withColumns({"flux": F.lit(1.0) + F.col("id") % 3, "flux_err": F.lit(0.1)})
    two = one.filter("id % 5 <> 0").withColumn("flux", F.col("flux") * 9)
    changes = associations.epoch_changes(one, two, 0.01, 1.0)
    assert changes.rdd.getNumPartitions() >= 18
    assert values(changes.groupBy("change_type").count(), "change_type", "count") == [("brightened", 320), ("disappeared", 80)]


@pytest.mark.parametrize("rows", [1 << 18, 40, 0])
def test_clipping_by_windows_and_in_order(spark, monkeypatch, rows):
    """Small keys as windows, large ones in order, a null key like any other, a key of equal values, null values dropped; windows take few jobs."""
    from skysift.operators import selection

    monkeypatch.setattr(selection, "WINDOW_ROWS", rows)
    data = [(k, None if i % 17 == 16 else 50.0 if i % 19 == 3 else 2.0 if k == 3 else 1.0 + (i * 37 % 23) / 100) for k, n in ((1, 60), (2, 9), (3, 30), (None, 45), (4, 1)) for i in range(n)]
    expected = []
    for k in {k for k, _ in data}:
        v = [x for key, x in data if key == k and x is not None]
        med = statistics.median(v)
        mad = statistics.median(abs(x - med) for x in v)
        bound = 5 * (1.4826 * mad if mad > 0 else statistics.pstdev(v))
        kept = [x for x in v if abs(x - med) < bound or x == med]
        expected += [(str(k), x, round(x / statistics.median(kept), 9)) for x in kept]
    frame = spark.createDataFrame(data, "k int, flux double").repartition(3)
    spark.sparkContext.setJobGroup(group := f"clip-{rows}", "")
    found = selection.clean_lightcurve(frame, ["k"]).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((str(r["k"]), r["flux"], round(r["flux_norm"], 9)) for r in found) == sorted(expected) and len(expected) < len(data)
    assert rows < 60 or len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 8


def test_forest_reads_its_input_once(spark):
    """Features that are dear to compute are computed once, whatever is asked of them afterwards."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    frame = spark.range(400).selectExpr("id", "double(id % 20) AS a", "double(IF(id = 7, 900, id % 13)) AS b")
    marks = isolation_scores(frame.mapInPandas(seen, frame.schema), "id", ("a", "b"), trees=20, contamination=0.05)
    assert marks.orderBy(F.desc("isolation")).first()["id"] == 7 and marks.filter("is_outlier").count() <= 20
    assert read.value == 400
