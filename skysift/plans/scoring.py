"""Channel scores, convergence, combination, ranking and scenario matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.operators import detectors as D
from skysift.operators import scoring as C
from skysift.operators import templates as M
from skysift.operators.ordered import ranked
from skysift.plans import sqltext as Q
from skysift.plans.detectors import ABUNDANCE_SCORE_SQL, ABUNDANCE_SQL, HR_SCORE_SQL, HR_SQL, PM_SQL, RADIO_SCORE_SQL, UV_SCORE_SQL, abundance_rows
from skysift.plans.populations import EMP_SQL, bh_sql
from skysift.plans.registry import query
from skysift.plans.tables import CALIBRATED


def r6(c, name):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name)


def measured(t):
    """One wide row per target with everything the channel extractors read."""
    df = D.motion_consistency(t.signals)
    df = D.ridge_outlier(df.withColumn("uv_score", D.uv_score()["uv_score"]).withColumn("radio_score", D.radio_score("radio_mjy", "radio_snr", "radio_sep")))
    ab = D.abundance_outliers(abundance_rows(t)).select("target_id", F.col("score").alias("abundance_score"))
    return df.join(ab, "target_id", "left")


@query("channel_score_extractors", f"""WITH {PM_SQL}, {HR_SQL}, {ABUNDANCE_SQL} SELECT target_id, 'ir_excess' AS channel, round(CASE WHEN ir_candidate AND (excess_w3 < 0 AND sigma_w3 IS NOT NULL OR excess_w4 < 0 AND sigma_w4 IS NOT NULL) THEN 1 - exp(-greatest(CASE WHEN excess_w3 < 0 THEN sigma_w3 END, CASE WHEN excess_w4 < 0 THEN sigma_w4 END)/5) ELSE 0 END, 6) AS score FROM pm4
    UNION ALL SELECT target_id, 'radio_anomaly', round(CASE WHEN n_radio_hits = 0 AND hit_snr <= 0 THEN 0 ELSE 0.4*(1 - exp(-n_radio_hits/3e0)) + 0.6*(1 - exp(-hit_snr/20)) END, 6) FROM pm4
    UNION ALL SELECT target_id, 'gaia_photometric_anomaly', round((1 - exp(-abs(variability)/0.05))*least(1, CASE WHEN n_epochs > 0 THEN n_epochs ELSE 50 END/10e0), 6) FROM pm4
    UNION ALL SELECT target_id, 'habitable_zone_planet', CASE WHEN n_hz >= 2 THEN 0.6 WHEN n_hz = 1 THEN 0.5 ELSE 0 END FROM pm4
    UNION ALL SELECT target_id, 'proper_motion_anomaly', round(coalesce(greatest(CASE WHEN ruwe > 1 THEN 1 - exp(-(ruwe - 1)) END, CASE WHEN aen_sig > 0 THEN 1 - exp(-aen_sig/5) END, CASE WHEN pm_sigma > 0 THEN 1 - exp(-pm_sigma/4) END), 0), 6) FROM pm4
    UNION ALL SELECT target_id, 'ir_variability', CASE WHEN ir_var_source = 'real' THEN coalesce(ir_var_score, 0) END FROM pm4 UNION ALL SELECT target_id, 'transit_anomaly', round(greatest(0, least(1, dimming_score)), 6) FROM pm4
    UNION ALL SELECT target_id, 'uv_anomaly', round({UV_SCORE_SQL}, 6)::DOUBLE FROM fx_signals UNION ALL SELECT target_id, 'radio_emission', round({RADIO_SCORE_SQL}, 6)::DOUBLE FROM fx_signals
    UNION ALL SELECT target_id, 'hr_anomaly', round({HR_SCORE_SQL}, 6)::DOUBLE FROM b
    UNION ALL SELECT s.target_id, 'abundance_anomaly', CASE WHEN k IS NOT NULL THEN round({ABUNDANCE_SCORE_SQL}, 6)::DOUBLE END FROM fx_signals s LEFT JOIN g USING (target_id)""")
def _(t):
    df = C.channel_scores(measured(t))
    return df.select("target_id", "channel", r6("score", "score"))


CONV_SQL = """cv AS (SELECT target_id, count(*) FILTER (channel <> 'habitable_zone_planet' AND score > {thr}) AS n_active, count(score) FILTER (channel <> 'habitable_zone_planet') AS n_data, coalesce(exp(avg(ln(score)) FILTER (channel <> 'habitable_zone_planet' AND score > {thr})), 0) AS geo, max(score) FILTER (channel = 'habitable_zone_planet' AND score > {thr}) AS prior FROM fx_scores GROUP BY 1),
    tot AS (SELECT target_id, n_active, n_data, geo, geo*{bonus}*(1 + coalesce(prior, 0))*least(1, sqrt(n_data/10)) AS total FROM cv)"""
STANDARD = CONV_SQL.format(thr=0.3, bonus="(CASE WHEN n_active = 0 THEN 0 ELSE pow(2e0, n_active - 1) END)")
PRIORITY = CONV_SQL.format(thr=0.25, bonus="(CASE WHEN n_active = 0 THEN 0 WHEN n_active = 1 THEN 0.25 ELSE pow(4e0, n_active - 1) END)")


@query("convergence_score", f"WITH {STANDARD} SELECT target_id, n_active, n_data, round(geo, 6) AS geo_mean, round(total, 6) AS total_score FROM tot")
def _(t):
    return C.convergence(t.scores).select("target_id", "n_active", "n_data", r6("geo_mean", "geo_mean"), r6("total_score", "total_score"))


@query("convergence_priority_score", f"WITH {PRIORITY} SELECT target_id, n_active, round(total, 6) AS total_score FROM tot")
def _(t):
    return C.convergence(t.scores, threshold=0.25, priority=True).select("target_id", "n_active", r6("total_score", "total_score"))


_CAL = ", ".join(f"'{c}'" for c in CALIBRATED)
COMB_SQL = f"""{EMP_SQL.format(op='>=')}, ep AS (SELECT target_id, channel, score, CASE WHEN channel IN ({_CAL}) THEN p END AS p, CASE WHEN channel IN ({_CAL}) THEN coalesce(p, 1) END AS ap FROM emp WHERE channel <> 'habitable_zone_planet'),
    cs AS (SELECT target_id, sum(-2*ln(p)) FILTER (score > 0.3) AS x, count(p) FILTER (score > 0.3) AS k, sum(CASE WHEN ap < 1 THEN {Q.normal_tail_inverse('ap')} END)/sqrt(count(ap)) AS z, count(*) FILTER (ap >= 1) AS ones, count(ap) AS m, min(p) AS least_p, count(*) FILTER (score > 0.3) AS a FROM ep GROUP BY 1),
    cp AS (SELECT target_id, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN exp(-x/2) ELSE {Q.even_chi_square_tail('x', 'k')} END AS fisher_p, CASE WHEN m = 0 THEN NULL WHEN ones > 0 THEN 1e0 ELSE {Q.normal_tail('z')} END AS stouffer_p, least_p < 0.001 AND a <= 1 AS extreme FROM cs)"""


@query("calibrated_combination", f"WITH {COMB_SQL} SELECT target_id, round(fisher_p, 6) AS fisher_p, round(stouffer_p, 6) AS stouffer_p, coalesce(extreme, false) AS single_channel_extreme FROM cp")
def _(t):
    return C.combined_p(t.scores, t.controls).select("target_id", r6("fisher_p", "fisher_p"), r6("stouffer_p", "stouffer_p"), "single_channel_extreme")


SURVEY_SQL = f"""{STANDARD}, {COMB_SQL}, sv AS (SELECT *, coalesce(stouffer_p, 1) AS ps, coalesce(fisher_p, 1) AS pf, row_number() OVER (ORDER BY round(total, 12) DESC, n_active DESC, round(geo, 12) DESC, target_id) AS rank FROM tot JOIN cp USING (target_id))"""


@query("survey_ranking", f"WITH {SURVEY_SQL}, q1 AS ({bh_sql('sv', 'ps')}), q2 AS ({bh_sql('sv', 'pf', keep='target_id AS t2', q='q_fisher')}) SELECT target_id, rank, round(total, 6) AS total_score, round(q_value, 6) AS q_value, round(q_fisher, 6) AS q_fisher, round(1 - pow(1 - coalesce(stouffer_p, fisher_p), (SELECT count(*) FROM sv)), 6) AS global_p FROM q1 JOIN q2 ON t2 = target_id")
def _(t):
    return C.survey(t.scores, t.controls).select("target_id", "rank", r6("total_score", "total_score"), r6("q_value", "q_value"), r6("q_fisher", "q_fisher"), r6("global_p", "global_p"))


@query("population_fdr", f"WITH {SURVEY_SQL}, sp AS (SELECT sv.*, p.population FROM sv JOIN (SELECT DISTINCT target_id, population FROM fx_scores) p USING (target_id)), q1 AS ({bh_sql('sp', 'ps', 'population')}) SELECT target_id, population, round(q_value, 6) AS q_value, q_value <= 0.05 AS is_significant FROM q1")
def _(t):
    return C.survey(t.scores, t.controls, population="population").select("target_id", "population", r6("q_value", "q_value"), "is_significant")


@query("top_scored", f"WITH {SURVEY_SQL} SELECT target_id, rank, round(total, 6) AS total_score, n_active FROM sv WHERE rank <= 20")
def _(t):
    return C.survey(t.scores, t.controls).filter("rank <= 20").select("target_id", "rank", r6("total_score", "total_score"), "n_active").orderBy("rank")


@query("rank_with_ties", "SELECT row_id, row_number() OVER (ORDER BY total_score DESC, n_active DESC, ruwe DESC, row_id) AS rank FROM fx_report_rows")
def _(t):
    return ranked(t.report_rows, [], [F.desc("total_score"), F.desc("n_active"), F.desc("ruwe"), F.col("row_id")], "rank", None).select("row_id", "rank")


@query("rescoring", f"WITH {STANDARD}, o AS (SELECT target_id, total AS t0, row_number() OVER (ORDER BY round(total, 12) DESC, target_id) AS r0 FROM tot), " + PRIORITY.replace("cv AS", "cv2 AS").replace("FROM cv)", "FROM cv2)").replace("tot AS", "tot2 AS")
       + ", n AS (SELECT target_id, total AS t1, row_number() OVER (ORDER BY round(total, 12) DESC, target_id) AS r1 FROM tot2) SELECT target_id, round(t1 - t0, 6) AS change, r0 - r1 AS rank_gain FROM o JOIN n USING (target_id)")
def _(t):
    tie = lambda df: df.withColumn("_t", F.round("total_score", 12))
    old = ranked(tie(C.convergence(t.scores)), [], [F.desc("_t"), F.col("target_id")], "r0", None).select("target_id", F.col("total_score").alias("t0"), "r0")
    new = ranked(tie(C.convergence(t.scores, threshold=0.25, priority=True)), [], [F.desc("_t"), F.col("target_id")], "r1", None).select("target_id", F.col("total_score").alias("t1"), "r1")
    return old.join(new, "target_id").select("target_id", r6(F.col("t1") - F.col("t0"), "change"), (F.col("r0") - F.col("r1")).alias("rank_gain"))


@query("motion_down_weight", f"""WITH {PM_SQL}, m AS (SELECT target_id, sigma_w3, sigma_w4, pm_sigma, greatest(coalesce(sigma_w3, 0), coalesce(sigma_w4, 0)) AS top, NOT (ruwe > 1.4 OR aen_sig > 5) AS clean FROM pm4), c AS (SELECT target_id, CASE WHEN clean AND pm_sigma > 2 AND top > 5 THEN least(1, least(1, 0.3 + 0.1*top/10 + 0.1*pm_sigma/5) + CASE WHEN sigma_w4 > 3*sigma_w3 THEN 0.2 ELSE 0 END) ELSE 0 END AS corr FROM m)
    SELECT target_id, round(corr, 5)::DOUBLE AS correlation, round(CASE WHEN corr > 0 THEN greatest(0.1, 1 - corr) ELSE 1 END, 5)::DOUBLE AS weight FROM c""")
def _(t):
    w = C.motion_weight()
    return D.motion_consistency(t.signals).select("target_id", F.round(w["correlation"], 5).alias("correlation"), F.round(w["weight"], 5).alias("weight"))


_TPL = ", ".join(f"('{s.name}', {i}, {str(s.single_only).lower()})" for i, s in enumerate(M.SCENARIOS))
_PRED = ", ".join(f"('{s.name}', '{c}', {w!r}::DOUBLE)" for s in M.SCENARIOS for c, w in s.predicted.items())
_ANTI = ", ".join(f"('{s.name}', '{c}')" for s in M.SCENARIOS for c in s.forbidden)
_PAIR = ", ".join(f"('{s.name}', '{a}', '{b}', {w!r}::DOUBLE)" for s in M.SCENARIOS for a, b, w in s.together)
FIT_SQL = f"""tpl(t, ord, single) AS (VALUES {_TPL}), pred(t, c, s) AS (VALUES {_PRED}), forb(t, c) AS (VALUES {_ANTI}), pr(t, a, b, w) AS (VALUES {_PAIR}),
    act AS (SELECT target_id, channel AS c, score AS o, count(*) OVER (PARTITION BY target_id) AS n FROM fx_scores WHERE channel <> 'habitable_zone_planet' AND score > 0.3), multi AS (SELECT * FROM act WHERE n >= 2),
    cf AS (SELECT m.target_id, tpl.t, tpl.ord, tpl.single, m.c, m.n, m.o, coalesce(p.s, 0.1) AS w, CASE WHEN p.s IS NULL THEN 0 WHEN m.o <= p.s THEN 1 ELSE greatest(0, 1 - 0.3*(m.o/(p.s + 0.01) - 1)) END AS fit, CASE WHEN a.c IS NOT NULL THEN ln(greatest(0.1, 1 - m.o)) ELSE 0 END AS la FROM multi m CROSS JOIN tpl LEFT JOIN pred p ON p.t = tpl.t AND p.c = m.c LEFT JOIN forb a ON a.t = tpl.t AND a.c = m.c),
    g AS (SELECT target_id, t, ord, max(n) AS n, bool_or(single) AS single, sum(fit*w)/sum(w) AS base, count(*) FILTER (fit > 0.3) AS ne, exp(sum(la)) AS pen, list(c) FILTER (fit > 0.3) AS expl FROM cf GROUP BY 1, 2, 3),
    ms AS (SELECT d.target_id, p.t, greatest(0.2, exp(sum(CASE WHEN a.c IS NULL AND p.s >= 0.5 THEN ln(1 - 0.4*p.s) ELSE 0 END))) AS miss FROM (SELECT DISTINCT target_id FROM multi) d CROSS JOIN pred p LEFT JOIN multi a ON a.target_id = d.target_id AND a.c = p.c GROUP BY 1, 2),
    bo AS (SELECT x.target_id, pr.t, exp(sum(ln(pr.w))) AS bonus FROM pr JOIN multi x ON x.c = pr.a JOIN multi y ON y.c = pr.b AND y.target_id = x.target_id GROUP BY 1, 2),
    fits AS (SELECT g.target_id, g.t, g.ord, g.n, CASE WHEN single THEN 0 ELSE least(1, greatest(0, base*ne/g.n*pen*least(3, coalesce(bonus, 1))))*miss END AS fit, CASE WHEN single THEN [] ELSE coalesce(expl, []) END AS expl FROM g JOIN ms USING (target_id, t) LEFT JOIN bo USING (target_id, t))"""


@query("scenario_match", f"WITH {FIT_SQL} SELECT target_id, t AS scenario, round(fit, 6)::DOUBLE AS fit, len(expl) AS n_explained FROM fits")
def _(t):
    m = M.match_scenarios(M.source_patterns(t.scores)).select("target_id", F.explode("fits").alias("f"))
    return m.select("target_id", F.col("f.name").alias("scenario"), r6("f.fit", "fit"), F.size("f.explained").cast("bigint").alias("n_explained"))


CONF_SQL = """sw AS (SELECT target_id, max(score) FILTER (channel = 'proper_motion_anomaly') AS pm, max(score) FILTER (channel = 'gaia_photometric_anomaly') AS ph, max(score) FILTER (channel = 'ir_variability') AS iv FROM fx_scores GROUP BY 1),
    cx AS (SELECT f.target_id, f.t, f.ord, f.n, f.fit, (f.t IN ('binary_system', 'spectroscopic_binary') AND coalesce(pm, 0) < 0.3)::INT + (f.t = 'face_on_binary' AND coalesce(pm, 0) >= 0.3)::INT + (f.t = 'young_stellar_object' AND coalesce(ph, 0) < 0.3)::INT AS strong,
      (f.t = 'young_stellar_object' AND coalesce(iv, 0) < 0.3)::INT + (SELECT count(*) FROM pred p JOIN fx_scores s ON s.channel = p.c AND s.target_id = f.target_id WHERE p.t = f.t AND p.s >= 0.5 AND s.score < 0.1
        AND NOT (f.t IN ('binary_system', 'spectroscopic_binary') AND p.c = 'proper_motion_anomaly') AND NOT (f.t = 'young_stellar_object' AND p.c IN ('gaia_photometric_anomaly', 'ir_variability'))) AS moderate FROM fits f JOIN sw USING (target_id)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(fit, 12) DESC, ord) AS i, max(fit) OVER (PARTITION BY target_id) AS bf FROM cx), ch AS (SELECT * FROM rk WHERE i <= 4 AND fit >= 0.7*bf QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY strong + moderate, i) = 1)"""


@query("scenario_conflicts", f"WITH {FIT_SQL}, {CONF_SQL} SELECT target_id, t AS scenario, strong::INT AS strong, moderate::INT AS moderate FROM cx")
def _(t):
    m = M.match_scenarios(M.source_patterns(t.scores)).select("target_id", F.explode("fits").alias("f"))
    return m.select("target_id", F.col("f.name").alias("scenario"), F.col("f.strong").alias("strong"), F.col("f.moderate").alias("moderate"))


@query("residual_channels", f"WITH {FIT_SQL}, e AS (SELECT DISTINCT target_id, unnest(expl) AS c FROM fits WHERE fit > 0.3) SELECT target_id, c AS channel FROM multi m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.target_id = m.target_id AND e.c = m.c)")
def _(t):
    m = M.match_scenarios(M.source_patterns(t.scores))
    explained = F.flatten(F.transform(F.filter("fits", lambda f: f["fit"] > 0.3), lambda f: f["explained"]))
    return m.select("target_id", F.explode(F.array_except("active", explained)).alias("channel"))


UNEX_SQL = f"""{FIT_SQL}, {CONF_SQL}, ex2 AS (SELECT DISTINCT target_id, unnest(expl) AS c FROM fits WHERE fit > 0.3), rs AS (SELECT m.target_id, max(m.n) AS n, count(*) FILTER (e.c IS NULL) AS nr, coalesce(avg(m.o) FILTER (e.c IS NULL), 0) AS st FROM multi m LEFT JOIN ex2 e ON e.target_id = m.target_id AND e.c = m.c GROUP BY 1),
    um AS (SELECT rs.target_id, rs.n, nr, least(1, least(1, (0.35*nr/rs.n + 0.25*st + 0.25*(1 - ch.bf) + 0.15*nr/10)*(CASE WHEN nr >= 3 THEN 1.5 WHEN nr >= 2 THEN 1.2 ELSE 1 END)) + 0.15*strong + 0.08*moderate) AS u, strong + moderate AS nc FROM rs JOIN ch USING (target_id)),
    ua AS (SELECT target_id, n AS n_active, nr AS n_residual, u FROM um UNION ALL SELECT target_id, n, 0, least(0.3, 0.1*o) FROM act WHERE n = 1 UNION ALL SELECT DISTINCT target_id, 0, 0, 0 FROM fx_scores WHERE target_id NOT IN (SELECT target_id FROM act))"""


@query("unexplainability", f"WITH {UNEX_SQL} SELECT target_id, n_active::INT AS n_active, n_residual::INT AS n_residual, round(u, 6)::DOUBLE AS unexplained, CASE WHEN n_active < 2 OR u < 0.2 THEN 'EXPLAINED' WHEN u < 0.5 THEN 'PARTIALLY_EXPLAINED' ELSE 'UNEXPLAINED' END AS verdict FROM ua")
def _(t):
    return M.unexplained(M.source_patterns(t.scores)).select("target_id", "n_active", "n_residual", r6("unexplained", "unexplained"), "verdict")


@query("custom_scenarios", "WITH act AS (SELECT target_id, channel AS c, score AS o, count(*) OVER (PARTITION BY target_id) AS n FROM fx_scores WHERE channel <> 'habitable_zone_planet' AND score > 0.3) SELECT target_id, round(coalesce(sum(CASE WHEN c = 'uv_anomaly' THEN (CASE WHEN o <= 0.8 THEN 1 ELSE greatest(0, 1 - 0.3*(o/0.81 - 1)) END)*0.8 END), 0)/sum(CASE WHEN c = 'uv_anomaly' THEN 0.8 ELSE 0.1 END)*count(*) FILTER (c = 'uv_anomaly')/max(n)*(CASE WHEN count(*) FILTER (c = 'uv_anomaly') > 0 THEN 1 ELSE 0.68 END), 6)::DOUBLE AS fit FROM act WHERE n >= 2 GROUP BY 1")
def _(t):
    # The scenarios are an argument, so a caller can bring its own.
    own = (M.Scenario("hot_companion", {"uv_anomaly": 0.8}),)
    m = M.match_scenarios(M.source_patterns(t.scores), own)
    return m.select("target_id", r6(F.col("fits")[0]["fit"], "fit"))


@query("channel_extractor_registry", "SELECT target_id, 'transit_anomaly' AS channel, round(dimming_score, 6) AS score FROM fx_signals UNION ALL SELECT target_id, 'double_dimming', round(least(1, 2*dimming_score), 6)::DOUBLE FROM fx_signals")
def _(t):
    # Channels are a mapping of names to expressions; new ones need no change elsewhere.
    own = {"transit_anomaly": C.EXTRACTORS["transit_anomaly"], "double_dimming": lambda: F.least(F.lit(1.0), 2.0 * F.col("dimming_score"))}
    return C.channel_scores(t.signals, extractors=own).select("target_id", "channel", r6("score", "score"))
