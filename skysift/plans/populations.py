"""Grouped tests, calibrations, population reports and spatial statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions import numeric as N
from skysift.functions import sphere as S
from skysift.operators import spatial as X
from skysift.operators import stats as A
from skysift.operators.ordered import quantiles
from skysift.operators.skyjoin import best_per_group
from skysift.plans import sqltext as Q
from skysift.plans.registry import query
from skysift.plans.tables import CHANNELS


def r6(c, name):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name)


BH_SQL = "min(least(1e0, {p}*m_/k_)) OVER ({part} ORDER BY {p} DESC ROWS UNBOUNDED PRECEDING)"


def bh_sql(src, p, part="", keep="*", q="q_value"):
    over = f"PARTITION BY {part}" if part else ""
    return (f"SELECT {keep}, min(raw_) OVER ({over + ' ' if over else ''}ORDER BY k_ DESC ROWS UNBOUNDED PRECEDING) AS {q} FROM (SELECT *, least(1e0, {p}*count(*) OVER ({over})/k_) AS raw_ "
            f"FROM (SELECT *, row_number() OVER ({over + ' ' if over else ''}ORDER BY {p}) AS k_ FROM {src}))")


@query("false_discovery_rate", f"SELECT row_id, round(q_value, 6) AS q_value, q_value <= 0.05 AS is_significant FROM ({bh_sql('fx_report_rows', 'stouffer_p')})")
def _(t):
    return A.benjamini_hochberg(t.report_rows, "stouffer_p").select("row_id", r6("q_value", "q_value"), "is_significant")


@query("false_discovery_by_group", f"SELECT row_id, round(q_value, 6) AS q_value, q_value <= 0.05 AS is_significant FROM ({bh_sql('fx_report_rows', 'stouffer_p', 'report')})")
def _(t):
    return A.benjamini_hochberg(t.report_rows, "stouffer_p", ["report"]).select("row_id", r6("q_value", "q_value"), "is_significant")


_P = "(1 + c_custkey*(61 + no) % 999)/1e3"
_PSQL = "pv AS (SELECT target_id, channel, CASE WHEN score IS NULL THEN NULL ELSE greatest(1e-3, 1 - score) END AS p, score FROM fx_scores)"


def p_values(t):
    return t.scores.withColumn("p", F.when(F.col("score").isNotNull(), F.greatest(F.lit(1e-3), 1 - F.col("score"))))


@query("fisher_combination", f"WITH {_PSQL}, s AS (SELECT target_id, sum(-2*ln(p)) AS x, count(p) AS k FROM pv GROUP BY 1) SELECT target_id, round(CASE WHEN k = 0 THEN 1 WHEN k = 1 THEN exp(-x/2) ELSE {Q.even_chi_square_tail('x', 'k')} END, 6) AS p FROM s")
def _(t):
    x, k = A.fisher("p")
    return p_values(t).groupBy("target_id").agg(x.alias("x"), k.alias("k")).select("target_id", r6(A.fisher_p(F.col("x"), F.col("k")), "p"))


@query("stouffer_combination", f"WITH {_PSQL}, s AS (SELECT target_id, count(*) FILTER (p >= 1) AS ones, sum(CASE WHEN p < 1 THEN score*({Q.normal_tail_inverse('p')}) END)/sqrt(sum(score*score)) AS z FROM pv WHERE p IS NOT NULL GROUP BY 1) SELECT target_id, round(CASE WHEN ones > 0 THEN 1 ELSE {Q.normal_tail('z')} END, 6) AS p FROM s")
def _(t):
    total, squares, ones = A.stouffer("p", F.col("score"))
    agg = p_values(t).filter("p IS NOT NULL").withColumn("score", F.when((F.col("p") >= 1) & (F.col("score") <= 0), F.lit(1e-9)).otherwise(F.col("score")))
    agg = agg.groupBy("target_id").agg(total.alias("a"), squares.alias("b"), ones.alias("c"))
    return agg.select("target_id", r6(A.stouffer_p(F.col("a"), F.col("b"), F.col("c")), "p"))


EMP_SQL = """emp AS (SELECT s.target_id, s.population, s.channel, s.score, CASE WHEN s.score IS NULL THEN NULL WHEN c.n IS NULL THEN 1e0 ELSE (coalesce(ge.k, 0) + 1)/(c.n + 2e0) END AS p FROM fx_scores s
    LEFT JOIN (SELECT channel, count(*) AS n FROM fx_controls GROUP BY 1) c USING (channel)
    LEFT JOIN (SELECT d.channel, d.score, count(k.score) AS k FROM (SELECT DISTINCT channel, score FROM fx_scores WHERE score IS NOT NULL) d JOIN fx_controls k ON k.channel = d.channel AND k.score {op} d.score GROUP BY 1, 2) ge ON ge.channel = s.channel AND ge.score = s.score)"""


@query("empirical_p_value", f"WITH {EMP_SQL.format(op='>=')} SELECT target_id, channel, round(p, 6) AS p FROM emp")
def _(t):
    return A.empirical_p(t.scores, t.controls, ["channel"]).select("target_id", "channel", r6("p", "p"))


@query("batch_calibration", f"WITH {EMP_SQL.format(op='>')} SELECT target_id, channel, round(p, 6) AS p FROM emp")
def _(t):
    return A.empirical_p(t.scores, t.controls, ["channel"], strict=True).select("target_id", "channel", r6("p", "p"))


_KS_FEATURES = "SELECT 'g' AS feature, g AS v, true AS a FROM fx_targets UNION ALL SELECT 'g', g, false FROM fx_pool UNION ALL SELECT 'bp_rp', bp_rp, true FROM fx_targets UNION ALL SELECT 'bp_rp', bp_rp, false FROM fx_pool UNION ALL SELECT 'ruwe', ruwe, true FROM fx_targets UNION ALL SELECT 'ruwe', ruwe, false FROM fx_pool"


@query("two_sample_ks", f"""WITH u AS ({_KS_FEATURES}), c AS (SELECT feature, v, sum(a::INT) AS x, sum((NOT a)::INT) AS y FROM u GROUP BY 1, 2), r AS (SELECT feature, sum(x) OVER w AS cx, sum(y) OVER w AS cy, sum(x) OVER (PARTITION BY feature) AS nx, sum(y) OVER (PARTITION BY feature) AS ny FROM c WINDOW w AS (PARTITION BY feature ORDER BY v)),
    d AS (SELECT feature, max(abs(cx/nx - cy/ny)) AS d, max(nx)*max(ny)/(max(nx) + max(ny)) AS ne FROM r GROUP BY 1)
    SELECT feature, round(d, 6) AS d, round(CASE WHEN ne*d*d < 0.04 THEN 1 ELSE greatest(0, least(1, 2*list_sum(list_transform(range(1, 61), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)*exp(-2e0*k*k*ne*d*d))))) END, 6) AS p FROM d""")
def _(t):
    both = t.targets.select("g", "bp_rp", "ruwe", F.lit(True).alias("a")).unionByName(t.pool.select("g", "bp_rp", "ruwe", F.lit(False).alias("a")))
    long = both.select("a", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in ("g", "bp_rp", "ruwe")])).alias("f")).select("a", "f.feature", "f.v")
    return A.two_sample_ks(long, ["feature"], "v", F.col("a")).select("feature", r6("d", "d"), r6("p", "p"))


N_DATASETS = len(CHANNELS)


@query("coverage_matrix", """WITH c AS (SELECT DISTINCT target_id, channel FROM fx_scores WHERE score IS NOT NULL), t AS (SELECT target_id, count(*) AS n FROM c GROUP BY 1) SELECT target_id, n AS n_present, round(n/11e0, 6) AS completeness, round(sqrt(n/11e0), 6) AS penalty FROM t""")
def _(t):
    n = F.count_distinct("channel")
    return t.scores.filter("score IS NOT NULL").groupBy("target_id").agg(n.alias("n_present")).select(
        "target_id", "n_present", r6(F.col("n_present") / N_DATASETS, "completeness"), r6(F.sqrt(F.col("n_present") / N_DATASETS), "penalty"))


@query("coverage_summary", "SELECT channel, count(DISTINCT target_id) AS n_targets FROM fx_scores WHERE score IS NOT NULL GROUP BY 1")
def _(t):
    return t.scores.filter("score IS NOT NULL").groupBy("channel").agg(F.count_distinct("target_id").alias("n_targets"))


@query("data_coverage_table", "SELECT target_id, " + ", ".join(f"max((channel = '{c}' AND score IS NOT NULL)::INT) AS {c}" for c in CHANNELS) + " FROM fx_scores GROUP BY 1")
def _(t):
    has = F.col("score").isNotNull().cast("int")
    return t.scores.groupBy("target_id").agg(*[F.max(F.when(F.col("channel") == c, has)).alias(c) for c in CHANNELS])


_FEATURES = ("g", "bp_rp", "ruwe")


@query("matched_controls", """WITH b AS (SELECT g, bp_rp, ruwe FROM fx_targets UNION ALL SELECT g, bp_rp, ruwe FROM fx_pool), s AS (SELECT stddev_pop(g) AS sg, stddev_pop(bp_rp) AS sb, stddev_pop(ruwe) AS sr FROM b),
    d AS (SELECT t.target_id, p.source_id, sqrt(pow((t.g - p.g)/sg, 2) + pow((t.bp_rp - p.bp_rp)/sb, 2) + pow((t.ruwe - p.ruwe)/sr, 2)) AS d FROM fx_targets t, fx_pool p, s)
    SELECT target_id, round(max(d), 6) AS worst, count(*) AS n FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY d, source_id) <= 10) GROUP BY 1""")
def _(t):
    near = A.matched_controls(t.targets, t.pool, _FEATURES, 10, target_key="target_id", pool_key="source_id")
    return near.groupBy("target_id").agg(r6(F.max("distance"), "worst"), F.count("*").alias("n"))


RATES_SQL = "rates AS (SELECT population, channel, count(score) AS n_data, count(*) FILTER (score > 0.3) AS n_active, count(*) FILTER (score > 0.3)/count(score) AS rate FROM fx_scores GROUP BY 1, 2)"


def activation_rates(t):
    active = F.count_if(F.col("score") > 0.3)
    return t.scores.groupBy("population", "channel").agg(F.count("score").alias("n_data"), active.alias("n_active"), (active / F.count("score")).alias("rate"))


@query("activation_rates", f"WITH {RATES_SQL} SELECT population, channel, n_data, n_active, round(rate, 6) AS rate FROM rates")
def _(t):
    return activation_rates(t).withColumn("rate", F.round("rate", 6))


@query("information_content", f"WITH {RATES_SQL} SELECT channel, round(CASE WHEN median(rate) > 0 THEN -log2(median(rate)) END, 6) AS bits FROM rates WHERE n_data >= 10 GROUP BY 1")
def _(t):
    # One rate per population, so the groups are small whatever the size of the survey.
    mid = F.percentile("rate", F.lit(0.5))
    return activation_rates(t).filter("n_data >= 10").groupBy("channel").agg(mid.alias("m")).select("channel", r6(F.when(F.col("m") > 0, -F.log2("m")), "bits"))


@query("channel_correlations", """WITH p AS (SELECT concat(a.channel, '~', b.channel) AS pair, a.score AS x, b.score AS y FROM fx_scores a JOIN fx_scores b ON a.target_id = b.target_id AND a.channel < b.channel WHERE a.score IS NOT NULL AND b.score IS NOT NULL),
    r AS (SELECT pair, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1)/2 AS rx, rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1)/2 AS ry FROM p)
    SELECT pair, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY pair HAVING count(*) > 10""")
def _(t):
    # At most one row per channel and target, so a target yields at most 55 pairs.
    wide = t.scores.filter("score IS NOT NULL").groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("channel", "score"))).alias("s"))
    a = wide.select("s", F.posexplode("s").alias("i", "a"))
    pairs = a.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")).select(
        F.concat("a.channel", F.lit("~"), "b.channel").alias("pair"), F.col("a.score").alias("x"), F.col("b.score").alias("y"))
    return A.spearman(pairs, ["pair"], "x", "y").select("pair", r6("rho", "rho"), "n")


@query("fisher_calibration", f"""WITH {_PSQL}, f AS (SELECT target_id, sum(-2*ln(p)) AS x, count(p) AS k FROM pv WHERE p > 0 GROUP BY 1), o AS (SELECT x, k, row_number() OVER (PARTITION BY k ORDER BY x) AS i, count(*) OVER (PARTITION BY k) AS n FROM f WHERE k >= 2),
    c AS (SELECT *, 1 - {Q.even_chi_square_tail('x', 'k')} AS cdf FROM o)
    SELECT 2*k AS dof, max(n) AS n, round(avg(x), 6) AS observed_mean, round(stddev_pop(x), 6) AS observed_std, round(avg(x)/(2*k), 6) AS inflation, round(max(greatest(i/n - cdf, cdf - (i - 1)/n)), 6) AS ks_d FROM c GROUP BY k""")
def _(t):
    x, k = A.fisher("p")
    stat = p_values(t).groupBy("target_id").agg(x.alias("x"), k.alias("k")).filter("k >= 2").withColumn("dof", F.col("k") * 2)
    moments = stat.groupBy("dof").agg(r6(F.avg("x"), "observed_mean"), r6(F.stddev_pop("x"), "observed_std"), r6(F.avg("x") / F.first("dof"), "inflation"))
    ks = A.one_sample_ks(stat, ["dof"], "x", 1.0 - N.chi_square_tail(F.col("x"), F.col("dof")))
    return moments.join(ks, "dof").select("dof", "n", "observed_mean", "observed_std", "inflation", r6("d", "ks_d"))


@query("false_positive_rate", "SELECT report, round(avg((total_score > 2)::INT), 6) AS share_scored, round(avg((stouffer_p < 0.05)::INT), 6) AS share_significant, round(quantile_cont(total_score, 0.5), 6) AS p50, round(quantile_cont(total_score, 0.9), 6) AS p90, round(quantile_cont(total_score, 0.95), 6) AS p95, round(quantile_cont(total_score, 0.99), 6) AS p99 FROM fx_report_rows GROUP BY 1")
def _(t):
    shares = t.report_rows.groupBy("report").agg(r6(F.avg((F.col("total_score") > 2).cast("int")), "share_scored"), r6(F.avg((F.col("stouffer_p") < 0.05).cast("int")), "share_significant"))
    q = quantiles(t.report_rows, ["report"], "total_score", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return shares.join(q, "report").select("report", "share_scored", "share_significant", *[r6(c, c) for c in ("p50", "p90", "p95", "p99")])


def best_rows(t):
    """Highest-scored row of each target over all reports."""
    cols = [c for c in t.report_rows.columns if c != "target_id"]
    best = t.report_rows.groupBy("target_id").agg(F.max(F.struct("total_score", (-F.col("row_id")).alias("_r"), *[c for c in cols if c != "total_score"])).alias("b"))
    return best.select("target_id", *[F.col(f"b.{c}").alias(c) for c in cols])


BEST_SQL = "best AS (SELECT * FROM fx_report_rows QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY total_score DESC, row_id) = 1)"


@query("best_per_target", f"WITH {BEST_SQL} SELECT target_id, row_id, report, total_score FROM best")
def _(t):
    return best_rows(t).select("target_id", "row_id", "report", "total_score")


_BIN = "(ruwe > 1.4 OR aen_sig > 5 OR pm_sigma > 3 OR coalesce(template = 'binary_system', false) OR contains(risk_text, 'binary'))"


def binary_reasons():
    from skysift.operators.selection import messages
    return messages((F.col("ruwe") > 1.4, "ruwe"), (F.col("aen_sig") > 5, "excess_noise"), (F.col("pm_sigma") > 3, "pm_discrepancy"),
                    (F.col("template") == "binary_system", "template"), (F.lower("risk_text").contains("binary") | F.lower("risk_text").contains("companion"), "risk_flag"))


@query("subset_statistics", f"""WITH b AS (SELECT *, {_BIN} AS is_binary FROM fx_report_rows) SELECT is_binary, count(*) AS n, count(*) FILTER (n_active >= 2) AS n2, count(*) FILTER (n_active >= 3) AS n3, min(total_score) AS low, max(total_score) AS high,
    list_sort(list(total_score))[count(*)//2 + 1] AS upper_median FROM b GROUP BY 1""")
def _(t):
    df = t.report_rows.withColumn("is_binary", F.size(binary_reasons()) > 0)
    agg = df.groupBy("is_binary").agg(F.count("*").alias("n"), F.count_if(F.col("n_active") >= 2).alias("n2"), F.count_if(F.col("n_active") >= 3).alias("n3"), F.min("total_score").alias("low"), F.max("total_score").alias("high"))
    return agg.join(A.upper_median(df, ["is_binary"], "total_score", "upper_median"), "is_binary")


@query("prior_boost", """SELECT hz_score > 0 AS prior_active, n_active, count(*) AS n, round(avg(total_score/(1 + hz_score)), 6) AS mean_without, round(avg(100*(total_score - total_score/(1 + hz_score))/(total_score/(1 + hz_score))), 6) AS inflation_pct,
    count(*) FILTER (total_score > 1 AND total_score/(1 + hz_score) <= 1) AS only_by_prior FROM fx_report_rows GROUP BY 1, 2""")
def _(t):
    bare = F.col("total_score") / (1 + F.col("hz_score"))
    return t.report_rows.groupBy((F.col("hz_score") > 0).alias("prior_active"), "n_active").agg(
        F.count("*").alias("n"), r6(F.avg(bare), "mean_without"), r6(F.avg(100 * (F.col("total_score") - bare) / bare), "inflation_pct"),
        F.count_if((F.col("total_score") > 1) & (bare <= 1)).alias("only_by_prior"))


@query("run_comparison", """WITH o AS (SELECT target_id, max(total_score) AS s FROM fx_report_rows WHERE report <= 1997 GROUP BY 1), n AS (SELECT target_id, max(total_score) AS s FROM fx_report_rows WHERE report > 1997 GROUP BY 1), d AS (SELECT n.s - o.s AS d FROM o JOIN n USING (target_id))
    SELECT count(*) AS common, round(avg(d), 6) AS mean_change, round(median(d), 6) AS median_change, round(max(d), 6) AS max_increase, round(min(d), 6) AS max_decrease, count(*) FILTER (d > 0.01) AS improved, count(*) FILTER (d < -0.01) AS degraded, count(*) FILTER (abs(d) <= 0.01) AS unchanged FROM d""")
def _(t):
    old = t.report_rows.filter("report <= 1997").groupBy("target_id").agg(F.max("total_score").alias("o"))
    new = t.report_rows.filter("report > 1997").groupBy("target_id").agg(F.max("total_score").alias("s"))
    d = old.join(new, "target_id").select((F.col("s") - F.col("o")).alias("d"))
    agg = d.agg(F.count("*").alias("common"), r6(F.avg("d"), "mean_change"), r6(F.max("d"), "max_increase"), r6(F.min("d"), "max_decrease"),
                F.count_if(F.col("d") > 0.01).alias("improved"), F.count_if(F.col("d") < -0.01).alias("degraded"), F.count_if(F.abs("d") <= 0.01).alias("unchanged"))
    return agg.crossJoin(F.broadcast(quantiles(d, [], "d", {"m": 0.5}).select(r6("m", "median_change"))))  # one row each


OUTCOME_SQL = "CASE WHEN expected = 'neutral' OR score IS NULL THEN 'NEUTRAL' WHEN NOT has_data THEN 'NOT_EVALUATED' WHEN expected = 'positive' AND score > 0.3 THEN 'TRUE_POSITIVE' WHEN expected = 'positive' THEN 'FALSE_NEGATIVE' WHEN score > 0.3 THEN 'FALSE_POSITIVE' ELSE 'TRUE_NEGATIVE' END"


def channel_outcome(threshold=0.3):
    hit = F.col("score") > threshold
    return (F.when((F.col("expected") == "neutral") | F.col("score").isNull(), "NEUTRAL").when(~F.col("has_data"), "NOT_EVALUATED")
            .when(F.col("expected") == "positive", F.when(hit, "TRUE_POSITIVE").otherwise("FALSE_NEGATIVE"))
            .when(F.col("expected") == "negative", F.when(hit, "FALSE_POSITIVE").otherwise("TRUE_NEGATIVE")).otherwise("NEUTRAL"))


_OUT = "(SELECT channel, score, (target_id % 9) > 0 AS has_data, CASE target_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS expected FROM fx_scores)"


def outcomes(t):
    e = F.col("target_id") % 3
    df = t.scores.select("channel", "score", (F.col("target_id") % 9 > 0).alias("has_data"), F.when(e == 0, "positive").when(e == 1, "negative").otherwise("neutral").alias("expected"))
    return df.withColumn("outcome", channel_outcome())


@query("expected_observed_matrix", f"SELECT channel, outcome, count(*) AS n FROM (SELECT channel, {OUTCOME_SQL} AS outcome FROM {_OUT}) GROUP BY 1, 2")
def _(t):
    return outcomes(t).groupBy("channel", "outcome").agg(F.count("*").alias("n"))


@query("calibration_run_summary", f"WITH o AS (SELECT channel, {OUTCOME_SQL} AS outcome FROM {_OUT}) SELECT channel, count(*) FILTER (outcome IN ('TRUE_POSITIVE', 'TRUE_NEGATIVE')) AS passed, count(*) FILTER (outcome IN ('FALSE_POSITIVE', 'FALSE_NEGATIVE')) AS failed, round(count(*) FILTER (outcome LIKE 'TRUE%')/count(*) FILTER (outcome LIKE 'TRUE%' OR outcome LIKE 'FALSE%'), 6) AS pass_rate FROM o GROUP BY 1")
def _(t):
    good, bad = F.count_if(F.col("outcome").startswith("TRUE")), F.count_if(F.col("outcome").startswith("FALSE"))
    return outcomes(t).groupBy("channel").agg(good.alias("passed"), bad.alias("failed"), r6(good / (good + bad), "pass_rate"))


@query("campaign_summary", "SELECT report, count(*) AS n, count(*) FILTER (n_active >= 2) AS convergent, count(*) FILTER (data_source = 'real') AS with_data, count(*) FILTER (is_fdr) AS n_fdr FROM fx_report_rows GROUP BY 1")
def _(t):
    return t.report_rows.groupBy("report").agg(F.count("*").alias("n"), F.count_if(F.col("n_active") >= 2).alias("convergent"), F.count_if(F.col("data_source") == "real").alias("with_data"), F.count_if("is_fdr").alias("n_fdr"))


@query("mann_whitney", f"""WITH u AS (SELECT 'g' AS f, g AS v, true AS a FROM fx_targets UNION ALL SELECT 'g', g, false FROM fx_pool UNION ALL SELECT 'ruwe', ruwe, true FROM fx_targets UNION ALL SELECT 'ruwe', ruwe, false FROM fx_pool),
    r AS (SELECT *, rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1)/2 AS rk, count(*) OVER (PARTITION BY f, v) AS tie FROM u), s AS (SELECT f, sum(rk) FILTER (a) AS r1, count(*) FILTER (a)::DOUBLE AS n1, count(*) FILTER (NOT a)::DOUBLE AS n2, sum(tie::DOUBLE*tie - 1) AS ties FROM r GROUP BY 1),
    z AS (SELECT f, r1 - n1*(n1 + 1)/2 AS u, (r1 - n1*(n1 + 1)/2 - n1*n2/2 - 0.5)/sqrt(n1*n2/12*((n1 + n2 + 1) - ties/((n1 + n2)*(n1 + n2 - 1)))) AS z FROM s), h AS (SELECT f, avg((v > 3)::INT) AS share, coalesce(1 - exp(-median(v) FILTER (v > 3)/6), 0) AS strength FROM u WHERE a AND v IS NOT NULL GROUP BY 1)
    SELECT f AS feature, u, round(z, 6) AS z, round({Q.normal_tail('z')}, 6) AS p, round(share, 6) AS share_above, round(strength, 6) AS strength, round(0.5*share + 0.5*strength, 6) AS detection FROM z JOIN h USING (f)""")
def _(t):
    both = t.targets.select("g", "ruwe", F.lit(True).alias("a")).unionByName(t.pool.select("g", "ruwe", F.lit(False).alias("a")))
    long = both.select("a", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in ("g", "ruwe")])).alias("f")).select("a", "f.feature", "f.v")
    strong = A.excess_strength(long, ["feature"], "v", F.col("a"))
    tested = A.mann_whitney(long, ["feature"], "v", F.col("a")).join(strong, "feature")
    return tested.select("feature", "u", *(r6(c, c) for c in ("z", "p", "share_above", "strength", "detection")))


_SHARE = "exp(lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(pop - marked + 1) - lgamma(drawn - i + 1) - lgamma(pop - marked - drawn + i + 1) - lgamma(pop + 1) + lgamma(drawn + 1) + lgamma(pop - drawn + 1))"


@query("enrichment_tests", f"""WITH s AS (SELECT nation AS grp, count(*) AS drawn, count(*) FILTER (ruwe > 3) AS k FROM fx_targets GROUP BY 1), n AS (SELECT sum(drawn)::BIGINT AS pop, sum(k)::BIGINT AS marked FROM s), x AS (SELECT * FROM s, n),
    e AS (SELECT x.*, i, {_SHARE} AS share FROM x, LATERAL (SELECT unnest(range(greatest(0, drawn + marked - pop), least(drawn, marked) + 1)) AS i) r),
    h AS (SELECT grp, k, drawn, pop, marked, max(share) FILTER (i = k) AS p_exact, sum(share) FILTER (i >= k) AS p_hyper, sum(share*i) AS mean, sum(share*i*i) - pow(sum(share*i), 2) AS variance FROM e GROUP BY ALL),
    f AS (SELECT e.grp, sum(share) FILTER (share <= p_exact*(1 + 1e-7)) AS p_fisher FROM e JOIN h USING (grp) GROUP BY 1)
    SELECT grp, k, drawn, round(p_exact, 9) AS p_exact, round(p_hyper, 9) AS p_hyper, round(least(1, p_fisher), 7) AS p_fisher, round(least(1, 6*p_hyper), 8) AS p_corrected, round(mean, 6) AS mean, round(variance, 6) AS variance, round((k - mean)/sqrt(variance), 6) AS sigma,
    round(list_sum(list_transform(range(k, drawn + 1), lambda i: exp(lgamma(drawn + 1) - lgamma(i + 1) - lgamma(drawn - i + 1) + i*ln(marked/pop) + (drawn - i)*ln(1 - marked/pop)))), 6) AS p_binom FROM h JOIN f USING (grp)""")
def _(t):
    per = t.targets.groupBy(F.col("nation").alias("grp")).agg(F.count("*").alias("drawn"), F.count_if(F.col("ruwe") > 3).alias("k"))
    total = F.broadcast(t.targets.agg(F.count("*").alias("pop"), F.count_if(F.col("ruwe") > 3).alias("marked")))  # one row
    x = per.crossJoin(total)
    k, d, pop, m = (F.col(c) for c in ("k", "drawn", "pop", "marked"))
    h = N.Hypergeometric(pop, m, d)
    return x.select("grp", "k", "drawn", F.round(h.share(k.cast("double")), 9).alias("p_exact"), F.round(h.at_least(k), 9).alias("p_hyper"), F.round(h.two_sided(k), 7).alias("p_fisher"),
                    F.round(N.bonferroni(h.at_least(k), 6.0), 8).alias("p_corrected"), r6(h.mean, "mean"), r6(h.variance, "variance"), r6((k - h.mean) / F.sqrt(h.variance), "sigma"), r6(N.binomial_tail(k, d, m / pop), "p_binom"))


@query("variable_excess", f"""WITH d AS (SELECT a.id, abs(b.flux - a.flux)/sqrt(pow(coalesce(a.flux_err, 0.5), 2) + pow(coalesce(b.flux_err, 0.3), 2)) AS s, b.flux > a.flux AS up FROM fx_epoch1 a JOIN fx_epoch2 b USING (id)),
    c AS (SELECT count(*) AS n, count(*) FILTER (s > 3) AS k, count(*) FILTER (s > 3 AND up) AS n_up FROM d), q AS (SELECT *, 3e0 AS z FROM c), r AS (SELECT *, {Q.normal_tail('z')} AS f FROM q)
    SELECT n, k AS n_variable, n_up, round(list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i*ln(f) + (n - i)*ln(1 - f)))), 6) AS p, n_up > 0 AND n_up < k AS both_ways FROM r""")
def _(t):
    b = t.epoch2.select("id", F.col("flux").alias("flux2"), F.col("flux_err").alias("err2"))
    s = F.abs(F.col("flux2") - F.col("flux")) / F.sqrt(F.pow(F.coalesce("flux_err", F.lit(0.5)), F.lit(2)) + F.pow(F.coalesce("err2", F.lit(0.3)), F.lit(2)))
    d = t.epoch1.join(b, "id").select(s.alias("s"), (F.col("flux2") > F.col("flux")).alias("up"))
    c = d.agg(F.count("*").alias("n"), F.count_if(F.col("s") > 3).alias("n_variable"), F.count_if((F.col("s") > 3) & F.col("up")).alias("n_up"))
    p = N.binomial_tail(F.col("n_variable"), F.col("n"), N.normal_tail(F.lit(3.0)))
    return c.select("n", "n_variable", "n_up", r6(p, "p"), ((F.col("n_up") > 0) & (F.col("n_up") < F.col("n_variable"))).alias("both_ways"))


@query("method_performance", """WITH m AS (SELECT template AS method, count(*) AS total, count(*) FILTER (data_source = 'real') AS interesting, count(*) FILTER (data_source <> 'real') AS dead, count(*) FILTER (data_source = 'none') AS fp, count(*) FILTER (unexplainability >= 0.5) AS unexplained FROM fx_report_rows WHERE template IS NOT NULL GROUP BY 1),
    w AS (SELECT *, CASE WHEN total >= 2 AND dead/total > 0.5 THEN greatest(0.5, 0.1) ELSE 1 END AS w1 FROM m) SELECT method, total, interesting, dead, round(fp/total, 6) AS fp_rate, round(CASE WHEN unexplained > 0 THEN least(w1*1.25, 3) ELSE w1 END, 6)::DOUBLE AS weight, (CASE WHEN fp/total > 0.3 THEN 3.5 WHEN fp/total < 0.05 THEN 2.75 ELSE 3 END)::DOUBLE AS sigma FROM w""")
def _(t):
    real = F.col("data_source") == "real"
    m = t.report_rows.filter("template IS NOT NULL").groupBy(F.col("template").alias("method")).agg(
        F.count("*").alias("total"), F.count_if(real).alias("interesting"), F.count_if(~real).alias("dead"), F.count_if(F.col("data_source") == "none").alias("fp"), F.count_if(F.col("unexplainability") >= 0.5).alias("unexplained"))
    return method_weights(m).select("method", "total", "interesting", "dead", r6("fp_rate", "fp_rate"), r6("weight", "weight"), "sigma")


def method_weights(m, weight=1.0, sigma=3.0):
    """New strategy weights and detection threshold from the outcome counts of each method."""
    halved = F.when((F.col("total") >= 2) & (F.col("dead") / F.col("total") > 0.5), F.greatest(F.lit(weight * 0.5), F.lit(0.1))).otherwise(F.lit(weight))
    new = F.when(F.col("unexplained") > 0, F.least(halved * 1.25, F.lit(3.0))).otherwise(halved)
    rate = F.col("fp") / F.col("total")
    limit = F.when(rate > 0.3, F.lit(sigma + 0.5)).when(rate < 0.05, F.greatest(F.lit(sigma - 0.25), F.lit(2.0))).otherwise(F.lit(sigma))
    return m.withColumn("fp_rate", rate).withColumn("weight", new).withColumn("sigma", limit)


def graded(value, yellow, red=None, below=False):
    """GREEN, YELLOW or RED by one or two limits."""
    beyond = (lambda v, x: v < x) if below else (lambda v, x: v > x)
    ladder = F.when(F.coalesce(beyond(value, red), F.lit(False)), "RED") if red is not None else F.when(F.lit(False), "RED")
    return ladder.when(F.coalesce(beyond(value, yellow), F.lit(False)), "YELLOW").otherwise("GREEN")


@query("data_quality_sentinels", """WITH r AS (SELECT count(*) FILTER (pm_sigma > 2)/nullif(count(*) FILTER (pm_sigma > 3), 0) AS ratio, count(*) FILTER (data_source = 'simulated')/count(*) AS rfi, count(*) FILTER (is_fdr AND n_active = 0) AS unbiased, count(*) FILTER (template IS NULL)/count(*) AS orphan FROM fx_report_rows),
    l AS (SELECT count(*) FILTER (flux < 0.98) AS transient, count(*) FILTER (flux_err < 0.008)/count(*) AS coverage FROM fx_lightcurve), f AS (SELECT avg(b.flux/a.flux) AS q FROM fx_epoch1 a JOIN fx_epoch2 b USING (id))
    SELECT 'threshold_sensitivity' AS sentinel, round(ratio, 6) AS value, CASE WHEN ratio > 100 THEN 'RED' WHEN ratio > 20 THEN 'YELLOW' ELSE 'GREEN' END AS status FROM r UNION ALL SELECT 'rfi_share', round(rfi, 6), CASE WHEN rfi > 0.95 THEN 'RED' WHEN rfi > 0.8 THEN 'YELLOW' ELSE 'GREEN' END FROM r
    UNION ALL SELECT 'unsupervised_only', unbiased::DOUBLE, CASE WHEN unbiased > 0 THEN 'YELLOW' ELSE 'GREEN' END FROM r UNION ALL SELECT 'transient_only', transient::DOUBLE, CASE WHEN transient > 0 THEN 'RED' ELSE 'GREEN' END FROM l
    UNION ALL SELECT 'orphan_share', round(orphan, 6), CASE WHEN orphan > 0.3 THEN 'YELLOW' ELSE 'GREEN' END FROM r UNION ALL SELECT 'band_coverage', round(coverage, 6), CASE WHEN coverage < 0.5 THEN 'RED' WHEN coverage < 0.8 THEN 'YELLOW' ELSE 'GREEN' END FROM l UNION ALL SELECT 'flux_ratio_offset', round(abs(q - 1), 6), CASE WHEN abs(q - 1) > 0.5 THEN 'YELLOW' ELSE 'GREEN' END FROM f""")
def _(t):
    n2, n3 = F.count_if(F.col("pm_sigma") > 2), F.count_if(F.col("pm_sigma") > 3)
    r = t.report_rows.agg(
        F.try_divide(n2, n3).alias("ratio"), (F.count_if(F.col("data_source") == "simulated") / F.count("*")).alias("rfi"),
        F.count_if(F.col("is_fdr") & (F.col("n_active") == 0)).cast("double").alias("unbiased"), (F.count_if(F.col("template").isNull()) / F.count("*")).alias("orphan"))
    lc = t.lightcurve.agg(F.count_if(F.col("flux") < 0.98).cast("double").alias("transient"), (F.count_if(F.col("flux_err") < 0.008) / F.count("*")).alias("coverage"))
    f2 = t.epoch2.select("id", F.col("flux").alias("flux2"))
    f = t.epoch1.join(f2, "id").agg(F.abs(F.avg(F.col("flux2") / F.col("flux")) - 1).alias("offset"))
    v = r.crossJoin(lc).crossJoin(f)  # one row each
    rows = [("threshold_sensitivity", "ratio", 20, 100, False), ("rfi_share", "rfi", 0.8, 0.95, False), ("unsupervised_only", "unbiased", 0, None, False),
            ("transient_only", "transient", 0, 0, False), ("orphan_share", "orphan", 0.3, None, False), ("band_coverage", "coverage", 0.8, 0.5, True), ("flux_ratio_offset", "offset", 0.5, None, False)]
    checks = F.explode(F.array(*[F.struct(F.lit(n).alias("sentinel"), F.round(c, 6).alias("value"), graded(F.col(c), y, red, b).alias("status")) for n, c, y, red, b in rows]))
    return v.select(checks.alias("c")).select("c.*")


_TRIALS = "(SELECT channel, (target_id % 20) + 1 AS snr, coalesce(score, 0)*(target_id % 20 + 1)/12e0 AS s FROM fx_scores)"
CURVE_SQL = f"curve AS (SELECT channel, snr, avg((s > 0.3)::INT) AS rate, avg(s) AS mean, stddev_pop(s) AS std FROM {_TRIALS} GROUP BY 1, 2)"


def recovery_curve(t):
    s = F.coalesce("score", F.lit(0.0)) * (F.col("target_id") % 20 + 1) / 12.0
    trials = t.scores.select("channel", (F.col("target_id") % 20 + 1).alias("snr"), s.alias("s"))
    return trials.groupBy("channel", "snr").agg(F.avg((F.col("s") > 0.3).cast("int")).alias("rate"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"))


@query("recovery_curve", f"WITH {CURVE_SQL} SELECT channel, snr, round(rate, 6) AS rate, round(mean, 6) AS mean, round(std, 6) AS std, rate > 0.5 AS detectable FROM curve")
def _(t):
    return recovery_curve(t).select("channel", "snr", r6("rate", "rate"), r6("mean", "mean"), r6("std", "std"), (F.col("rate") > 0.5).alias("detectable"))


CROSS_SQL = """nxt AS (SELECT channel, snr, rate, lead(snr) OVER w AS snr2, lead(rate) OVER w AS rate2, first(rate) OVER w AS r0, first(snr) OVER w AS s0 FROM curve WINDOW w AS (PARTITION BY channel ORDER BY snr ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    lim AS (SELECT channel, coalesce(arg_min(CASE WHEN rate < 0.5 AND rate2 >= 0.5 THEN snr + (0.5 - rate)/(rate2 - rate)*(snr2 - snr) END, CASE WHEN rate < 0.5 AND rate2 >= 0.5 THEN snr END), max(CASE WHEN r0 >= 0.5 THEN s0 END)) AS snr50,
    coalesce(arg_min(CASE WHEN rate < 0.9 AND rate2 >= 0.9 THEN snr + (0.9 - rate)/(rate2 - rate)*(snr2 - snr) END, CASE WHEN rate < 0.9 AND rate2 >= 0.9 THEN snr END), max(CASE WHEN r0 >= 0.9 THEN s0 END)) AS snr90, min(CASE WHEN rate >= 1 THEN snr END)::DOUBLE AS snr100 FROM nxt GROUP BY 1)"""


def recovery_limits(curve):
    """Signal strength where a curve first rises through one half and nine tenths, and where it is first complete."""
    from pyspark.sql import Window
    w = Window.partitionBy("channel").orderBy("snr")  # one row per tested strength
    rows = curve.withColumn("snr2", F.lead("snr").over(w)).withColumn("rate2", F.lead("rate").over(w)).withColumn("first", F.row_number().over(w) == 1)

    def crossing(level):
        up = (F.col("rate") < level) & (F.col("rate2") >= level)
        at = F.col("snr") + (level - F.col("rate")) / (F.col("rate2") - F.col("rate")) * (F.col("snr2") - F.col("snr"))
        return F.coalesce(F.min_by(F.when(up, at), F.when(up, F.col("snr"))), F.max(F.when(F.col("first") & (F.col("rate") >= level), F.col("snr"))).cast("double"))

    return rows.groupBy("channel").agg(crossing(0.5).alias("snr50"), crossing(0.9).alias("snr90"), F.min(F.when(F.col("rate") >= 1, F.col("snr"))).cast("double").alias("snr100"))


# Distances (pc) of the sensitivity table and the reference distance.
SENSITIVITY_PC = (10, 25, 50, 100, 200, 500)
REFERENCE_PC = 10.0


@query("recovery_thresholds", f"WITH {CURVE_SQL}, {CROSS_SQL} SELECT channel, d.pc AS distance_pc, round(snr50*pc/10e0, 6) AS snr50, round(snr90*pc/10e0, 6) AS snr90, snr100 FROM lim, (VALUES {', '.join(f'({d})' for d in SENSITIVITY_PC)}) d(pc)")
def _(t):
    lim = recovery_limits(recovery_curve(t)).withColumn("distance_pc", F.explode(F.array(*[F.lit(d) for d in SENSITIVITY_PC])))
    scale = F.col("distance_pc") / F.lit(REFERENCE_PC)
    return lim.select("channel", "distance_pc", r6(F.col("snr50") * scale, "snr50"), r6(F.col("snr90") * scale, "snr90"), "snr100")


POINTS_SQL = "pts AS (SELECT t.target_id, distance_pc*cos(radians(t.dec))*cos(radians(t.ra)) AS x, distance_pc*cos(radians(t.dec))*sin(radians(t.ra)) AS y, distance_pc*sin(radians(t.dec)) AS z, s.score, t.ra, t.dec FROM fx_targets t JOIN (SELECT target_id, max(score) AS score FROM fx_scores GROUP BY 1) s USING (target_id) WHERE distance_pc > 0)"


def scored_points(t):
    x, y, z = S.cartesian("ra", "dec", "distance_pc")
    best = t.scores.groupBy("target_id").agg(F.max("score").alias("score"))
    return t.targets.filter("distance_pc > 0").select("target_id", "ra", "dec", x.alias("x"), y.alias("y"), z.alias("z")).join(best, "target_id")


@query("morans_i", f"""WITH {POINTS_SQL}, c AS (SELECT ra, dec, score - avg(score) OVER () AS z, count(*) OVER () AS n, var_pop(score) OVER () AS v FROM pts), w AS (SELECT sum(1/greatest(d, 0.01)) AS w, sum(z1*z2/greatest(d, 0.01)) AS wz FROM (SELECT a.z AS z1, b.z AS z2, {Q.sep('a.ra', 'a.dec', 'b.ra', 'b.dec')} AS d FROM c a, c b) WHERE d > 0)
    SELECT (SELECT max(n) FROM c) AS n, round(wz/(w*(SELECT max(v) FROM c)), 6) AS morans_i, round(-1e0/((SELECT max(n) FROM c) - 1), 6) AS expected_i FROM w""")
def _(t):
    return X.morans_i(scored_points(t), "score").select("n", r6("morans_i", "morans_i"), r6("expected_i", "expected_i"))


@query("ripleys_k", f"""WITH {POINTS_SQL}, b AS (SELECT (max(x) - min(x))*(max(y) - min(y))*(max(z) - min(z)) AS vol, least(max(x) - min(x), max(y) - min(y), max(z) - min(z))/2 AS r_max FROM pts), h AS (SELECT * FROM pts WHERE score >= 0.95), n AS (SELECT count(*) AS n FROM h),
    d AS (SELECT sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2) + pow(a.z - c.z, 2)) AS d FROM h a, h c WHERE a.target_id <> c.target_id), g AS (SELECT i AS bin, r_max*i/20 AS r, vol, n FROM b, n, range(1, 21) r(i)), k AS (SELECT bin, r, vol, n, (SELECT count(*) FROM d WHERE d > 0 AND d <= r) AS pairs FROM g)
    SELECT bin::INT AS bin, round(r, 6) AS r, pairs, round(pow(vol/(n*n)*pairs*3/(4*pi()), 1e0/3) - r, 4) AS l_excess, round(max(pow(vol/(n*n)*pairs*3/(4*pi()), 1e0/3) - r) OVER (), 4) AS max_excess FROM k""")
def _(t):
    return X.ripleys_k(scored_points(t), "score", 0.95).select("bin", r6("r", "r"), "pairs", F.round("l_excess", 4).alias("l_excess"), F.round("max_excess", 4).alias("max_excess"))


@query("spatial_scan", f"""WITH {POINTS_SQL}, s AS (SELECT avg(score) AS m, var_pop(score) AS v, count(*) AS n FROM pts), d AS (SELECT a.target_id AS centre, b.score, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d, b.target_id AS other FROM pts a, pts b WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 40),
    g AS (SELECT centre, d, row_number() OVER w AS k, avg(score) OVER w AS inside FROM d WINDOW w AS (PARTITION BY centre ORDER BY d, other ROWS UNBOUNDED PRECEDING)), l AS (SELECT centre, d, k, k*pow(inside - m, 2)/(2*v) AS lr FROM g, s WHERE k >= 3 AND inside > m)
    SELECT centre, round(lr, 6) AS lr, round(d, 6) AS radius, k::INT AS members FROM l ORDER BY lr DESC, centre LIMIT 1""")
def _(t):
    best = X.scan_statistic(scored_points(t), "target_id", "score", 40.0, permutations=0)
    return best.select("centre", r6("lr", "lr"), r6("radius", "radius"), "members")


@query("spatial_scan_significance")
def _(t):
    return X.scan_statistic(scored_points(t), "target_id", "score", 40.0).select("centre", "lr", "radius", "members", "p")


@query("spatial_summary")
def _(t):
    pts = scored_points(t)
    ball = X.scan_statistic(pts, "target_id", "score", 40.0, settled=0.05)  # the level of cluster_members
    inside = X.cluster_members(pts, "target_id", ball).select("target_id", F.lit(True).alias("in_ball"))
    active = t.scores.groupBy("target_id").agg(F.count_if(F.col("score") > 0.3).alias("k"))
    df = pts.join(inside, "target_id", "left").join(active, "target_id")
    return df.agg(F.count("*").alias("n_3d"), F.count_if("in_ball").alias("n_in_ball"), F.count_if(F.col("k") >= 2).alias("n_multi_channel"))


@query("residual_structure", """WITH s AS (SELECT target_id, min(w1) AS lo, max(w1) AS hi, count(*) AS n, stddev_pop(w1) AS sd FROM fx_ir_epochs GROUP BY 1), h AS (SELECT e.target_id, least(19, floor((w1 - lo)/((hi - lo)/20)))::INT AS b, count(*) AS k, max(n) AS n, max((hi - lo)/20) AS w FROM fx_ir_epochs e JOIN s USING (target_id) GROUP BY 1, 2),
    e AS (SELECT target_id, sum(-(k/n/w)*log2(k/n/w)*w) AS entropy FROM h GROUP BY 1), l AS (SELECT target_id, corr(w1, nx) AS lag1 FROM (SELECT target_id, w1, lead(w1) OVER (PARTITION BY target_id ORDER BY mjd, epoch_id) AS nx FROM fx_ir_epochs) GROUP BY 1)
    SELECT target_id, s.n, round(entropy, 6) AS entropy, round(0.5*log2(2*pi()*exp(1e0)*sd*sd), 6) AS gaussian_entropy, round(lag1, 6) AS lag1, abs(lag1) > 0.3 AS is_structured FROM s JOIN e USING (target_id) JOIN l USING (target_id) WHERE s.n >= 20""")
def _(t):
    df = A.residual_structure(t.ir_epochs, ["target_id"], ["mjd", "epoch_id"], "w1")
    return df.select("target_id", "n", r6("entropy", "entropy"), r6("gaussian_entropy", "gaussian_entropy"), r6("lag1", "lag1"), "is_structured")


@query("negative_excess_share", "SELECT population, round(avg((score < 0.2)::INT), 6) AS share FROM fx_scores WHERE channel = 'ir_excess' AND score IS NOT NULL GROUP BY 1")
def _(t):
    df = t.scores.filter("channel = 'ir_excess' AND score IS NOT NULL")
    return df.groupBy("population").agg(r6(F.avg((F.col("score") < 0.2).cast("int")), "share"))


@query("temporal_clustering", """WITH o AS (SELECT target_id, mjd, row_number() OVER w AS i, count(*) OVER (PARTITION BY target_id) AS n, min(mjd) OVER (PARTITION BY target_id) AS a, max(mjd) OVER (PARTITION BY target_id) AS b, mjd - lag(mjd) OVER w AS gap FROM fx_ir_epochs WINDOW w AS (PARTITION BY target_id ORDER BY mjd)),
    d AS (SELECT target_id, max(n) AS n, max(b - a) AS span, avg(gap) AS mean_gap, min(gap) AS min_gap, max(greatest(i/n - (mjd - a)/(b - a), (mjd - a)/(b - a) - (i - 1)/n)) AS d FROM o WHERE b > a GROUP BY 1)
    SELECT target_id, n, round(span, 5) AS span, round(mean_gap, 5) AS mean_gap, round(min_gap, 5) AS min_gap, round(d, 6) AS ks_d FROM d WHERE n >= 3""")
def _(t):
    from skysift.operators.associations import intervals
    rows = t.ir_epochs.select("target_id", "mjd")
    span = rows.groupBy("target_id").agg(F.min("mjd").alias("a"), F.max("mjd").alias("b"))
    scaled = rows.join(span, "target_id").filter("b > a").select("target_id", ((F.col("mjd") - F.col("a")) / (F.col("b") - F.col("a"))).alias("u"))
    ks = A.one_sample_ks(scaled, ["target_id"], "u", F.col("u")).filter("n >= 3")
    gaps = intervals(rows, "target_id", "mjd").groupBy("target_id").agg(F.avg("interval").alias("mean_gap"), F.min("interval").alias("min_gap"))
    return ks.join(span, "target_id").join(gaps, "target_id").select("target_id", "n", F.round(F.col("b") - F.col("a"), 5).alias("span"), F.round("mean_gap", 5).alias("mean_gap"), F.round("min_gap", 5).alias("min_gap"), r6("d", "ks_d"))


@query("discovery_scan", """SELECT row_id, total_score FROM fx_report_rows WHERE n_active >= 2 AND (unexplainability > 0.5 OR is_fdr)""")
def _(t):
    return t.report_rows.filter("n_active >= 2 AND (unexplainability > 0.5 OR is_fdr)").select("row_id", "total_score")


_RAW_EVENTS = "SELECT row_id, target_id AS name, data_source AS catalog, (template IS NOT NULL)::INT + (n_active > 1)::INT + (ruwe > 2)::INT + (pm_sigma > 1)::INT AS filled FROM fx_report_rows"


@query("event_versions", f"SELECT name, row_id, quality FROM (SELECT *, filled + CASE WHEN catalog = 'real' THEN 10 ELSE 0 END AS quality FROM ({_RAW_EVENTS})) QUALIFY row_number() OVER (PARTITION BY name ORDER BY quality DESC, row_id) = 1")
def _(t):
    filled = sum((c.cast("int") for c in (F.col("template").isNotNull(), F.col("n_active") > 1, F.col("ruwe") > 2, F.col("pm_sigma") > 1)), F.lit(0))
    q = filled + F.when(F.col("data_source") == "real", 10).otherwise(0)
    best = t.report_rows.groupBy(F.col("target_id").alias("name")).agg(F.max(F.struct(q.alias("q"), -F.col("row_id"))).alias("b"))
    return best.select("name", (-F.col("b.col2")).alias("row_id"), F.col("b.q").alias("quality"))


@query("binary_subtraction", f"SELECT report, count(*) AS n, count(*) FILTER ({_BIN}) AS n_binary, round(count(*) FILTER ({_BIN})/count(*), 6) AS share, max(total_score) FILTER (NOT {_BIN}) AS best_clean FROM fx_report_rows GROUP BY 1")
def _(t):
    df = t.report_rows.withColumn("is_binary", F.size(binary_reasons()) > 0)
    return df.groupBy("report").agg(F.count("*").alias("n"), F.count_if("is_binary").alias("n_binary"), r6(F.avg(F.col("is_binary").cast("int")), "share"), F.max(F.when(~F.col("is_binary"), F.col("total_score"))).alias("best_clean"))


@query("transit_ir_correlation", """WITH p AS (SELECT a.population AS grp, a.score AS x, b.score AS y FROM fx_scores a JOIN fx_scores b USING (target_id) WHERE a.channel = 'transit_anomaly' AND b.channel = 'ir_excess' AND a.score IS NOT NULL AND b.score IS NOT NULL),
    r AS (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1)/2 AS rx, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1)/2 AS ry FROM p) SELECT grp, round(corr(rx, ry), 6) AS rho, count(*) AS n, round(avg((y > 0.6)::INT), 6) AS share_anomalous FROM r GROUP BY 1""")
def _(t):
    a = t.scores.filter("channel = 'transit_anomaly'").select("target_id", F.col("population").alias("grp"), F.col("score").alias("x"))
    b = t.scores.filter("channel = 'ir_excess'").select("target_id", F.col("score").alias("y"))
    p = a.join(b, "target_id").filter("x IS NOT NULL AND y IS NOT NULL")
    share = p.groupBy("grp").agg(r6(F.avg((F.col("y") > 0.6).cast("int")), "share_anomalous"))
    return A.spearman(p, ["grp"], "x", "y", least=2).join(share, "grp").select("grp", r6("rho", "rho"), "n", "share_anomalous")


# Which channels each population should, may and should not fire.
EXPECTATIONS = {
    "BUILDING": {"should": ("proper_motion_anomaly", "gaia_photometric_anomaly"), "may": ("ir_excess",), "should_not": ("radio_anomaly",)},
    "MACHINERY": {"should": ("ir_excess",), "may": ("transit_anomaly",), "should_not": ("radio_anomaly", "proper_motion_anomaly")},
}
_EXP = [(p, kind, c) for p, m in EXPECTATIONS.items() for kind, cs in m.items() for c in cs]


@query("expected_behaviour", f"""WITH {RATES_SQL} SELECT population, kind, channel, round(rate, 6) AS rate, CASE WHEN kind = 'should' AND rate < 0.2 THEN 'LOW' WHEN kind = 'should_not' AND rate > 0.2 THEN 'HIGH' WHEN kind = 'should_not' AND rate < 0.05 THEN 'OK' WHEN kind = 'should' AND rate > 0.5 THEN 'OK' ELSE '' END AS status
    FROM rates JOIN (VALUES {', '.join(str(e) for e in _EXP)}) e(population, kind, channel) USING (population, channel)""")
def _(t):
    table = F.broadcast(t.spark.createDataFrame(_EXP, "population string, kind string, channel string"))  # fixed size
    df = activation_rates(t).join(table, ["population", "channel"])
    status = (F.when((F.col("kind") == "should") & (F.col("rate") < 0.2), "LOW").when((F.col("kind") == "should_not") & (F.col("rate") > 0.2), "HIGH")
              .when((F.col("kind") == "should_not") & (F.col("rate") < 0.05), "OK").when((F.col("kind") == "should") & (F.col("rate") > 0.5), "OK").otherwise(""))
    return df.select("population", "kind", "channel", r6("rate", "rate"), status.alias("status"))


@query("method_data_assembly", "SELECT 'ir_excess' AS method, count(*) AS n, round(avg(W1 - W3), 6) AS mean FROM fx_photometry WHERE W3 IS NOT NULL UNION ALL SELECT 'lightcurve', count(*), round(avg(flux), 6) FROM fx_lightcurve UNION ALL SELECT 'flux_pairs', count(*), round(avg(b.flux - a.flux), 6) FROM fx_epoch1 a JOIN fx_epoch2 b USING (id)")
def _(t):
    a = t.photometry.filter("W3 IS NOT NULL").select(F.lit("ir_excess").alias("method"), (F.col("W1") - F.col("W3")).alias("v"))
    b = t.lightcurve.select(F.lit("lightcurve").alias("method"), F.col("flux").alias("v"))
    c = t.epoch1.join(t.epoch2.select("id", F.col("flux").alias("f2")), "id").select(F.lit("flux_pairs").alias("method"), (F.col("f2") - F.col("flux")).alias("v"))
    return a.unionByName(b).unionByName(c).groupBy("method").agg(F.count("*").alias("n"), r6(F.avg("v"), "mean"))


@query("score_histogram", "WITH s AS (SELECT min(total_score) AS lo, max(total_score) AS hi FROM fx_report_rows) SELECT least(19, floor((total_score - lo)/((hi - lo)/20)))::INT AS bin, count(*) AS n FROM fx_report_rows, s GROUP BY 1")
def _(t):
    span = F.broadcast(t.report_rows.agg(F.min("total_score").alias("lo"), F.max("total_score").alias("hi")))  # one row
    return t.report_rows.crossJoin(span).groupBy(A.equal_bins("total_score", "lo", "hi", 20).alias("bin")).agg(F.count("*").alias("n"))


@query("tuning_thresholds", "SELECT count(*) AS n, round(avg((unexplainability > 0.5)::INT), 6) AS detected_share, (CASE WHEN avg((unexplainability > 0.5)::INT) > 0.5 THEN 0.5 ELSE 0.3 END)::DOUBLE AS high_score_limit FROM fx_report_rows WHERE report <= 1997")
def _(t):
    agg = t.report_rows.filter("report <= 1997").agg(F.count("*").alias("n"), F.avg((F.col("unexplainability") > 0.5).cast("int")).alias("s"))
    return agg.select("n", r6("s", "detected_share"), F.when(F.col("s") > 0.5, 0.5).otherwise(0.3).alias("high_score_limit"))


@query("physical_reach", f"""WITH {CURVE_SQL}, {CROSS_SQL} SELECT channel, d.pc AS distance_pc, round(4.74*(snr50*pc/10e0*1.5)/1e3*pc, 6) AS velocity_kms, round(4.83 + 5*log10(pc/10e0), 6) AS solar_v_mag,
    CASE channel WHEN 'ir_excess' THEN 3.3 + 5*log10(pc/10e0) <= 14.6 WHEN 'proper_motion_anomaly' THEN pc <= 200 WHEN 'transit_anomaly' THEN 4.83 + 5*log10(pc/10e0) <= 16 WHEN 'radio_anomaly' THEN coalesce(snr50*pc/10e0*0.12 <= 10, true) ELSE true END AS reachable FROM lim, (VALUES {', '.join(f'({d})' for d in SENSITIVITY_PC)}) d(pc)""")
def _(t):
    lim = recovery_limits(recovery_curve(t)).withColumn("distance_pc", F.explode(F.array(*[F.lit(d) for d in SENSITIVITY_PC])))
    pc = F.col("distance_pc")
    snr = F.col("snr50") * pc / REFERENCE_PC
    modulus = 5 * F.log10(pc / 10.0)
    ok = (F.when(F.col("channel") == "ir_excess", 3.3 + modulus <= 14.6).when(F.col("channel") == "proper_motion_anomaly", pc <= 200)
          .when(F.col("channel") == "transit_anomaly", 4.83 + modulus <= 16).when(F.col("channel") == "radio_anomaly", F.coalesce(snr * 0.12 <= 10, F.lit(True))).otherwise(F.lit(True)))
    return lim.select("channel", "distance_pc", r6(4.74 * (snr * 1.5) / 1e3 * pc, "velocity_kms"), r6(4.83 + modulus, "solar_v_mag"), ok.alias("reachable"))


@query("detection_difference", "SELECT DISTINCT target_id FROM fx_report_rows WHERE is_fdr AND target_id NOT IN (SELECT target_id FROM fx_report_rows WHERE n_active >= 4)")
def _(t):
    found = t.report_rows.filter("is_fdr").select("target_id").distinct()
    return found.join(t.report_rows.filter("n_active >= 4").select("target_id").distinct(), "target_id", "left_anti")


@query("run_intersection", "SELECT target_id FROM fx_report_rows WHERE report = 1996 INTERSECT SELECT target_id FROM fx_report_rows WHERE report = 1999")
def _(t):
    return t.report_rows.filter("report = 1996").select("target_id").intersect(t.report_rows.filter("report = 1999").select("target_id"))


@query("report_union", "SELECT target_id, row_id, report FROM (SELECT *, 0 AS live FROM fx_report_rows WHERE data_source = 'real' UNION ALL SELECT *, 1 AS live FROM fx_report_rows WHERE data_source = 'none') QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY live, report DESC, row_id) = 1")
def _(t):
    done = t.report_rows.filter("data_source = 'real'").withColumn("live", F.lit(0))
    live = t.report_rows.filter("data_source = 'none'").withColumn("live", F.lit(1))
    return best_per_group(done.unionByName(live), ["target_id"], [F.col("live"), F.desc("report"), F.col("row_id")]).select("target_id", "row_id", "report")
