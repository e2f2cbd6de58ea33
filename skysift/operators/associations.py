"""Association of event catalogs with hosts, with chance statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions import numeric as N
from skysift.operators.ordered import neighbours, with_position
from skysift.operators.skyjoin import ARCMIN, collapse_copies, count_within, counts_within, nearest, pairs, tasks_for
from skysift.session import cut

FULL_SKY = 41253.0  # square degrees
ESCALATION_P = 0.01


def one_row(df: DataFrame, **totals: Column) -> DataFrame:
    """A one-row frame of totals, safe to broadcast."""
    return F.broadcast(df.agg(*[c.alias(n) for n, c in totals.items()]))


def gamma_hosts(sources: DataFrame, hosts: DataFrame, max_arcmin: float = 10.0, density_deg: float = 5.0,
                largest_error_deg: float = 1.0) -> DataFrame:
    """Source-host pairs with their chance probability given the local host density."""
    err = (F.col("err_major_deg") + F.col("err_minor_deg")) / 2 * 60
    src = sources.withColumn("err_arcmin", F.when(err > 0, err))
    radius = F.greatest(F.lit(max_arcmin), F.coalesce("err_arcmin", F.lit(0.0))) * ARCMIN
    slim = src.select("source_id", "ra", "dec", "err_arcmin")
    found = pairs(slim, hosts.select("host_id", "ra", "dec"), radius, cell=largest_error_deg)
    dense = count_within(found.select("source_id", "ra", "dec").distinct(), hosts.select("ra", "dec"), density_deg,
                         left_key="source_id", name="n_local").select("source_id", "n_local")
    trials = one_row(sources, n_src=F.count("*")).crossJoin(one_row(hosts, n_host=F.count("*")))
    area = math.pi * density_deg ** 2
    sep = F.col("sep_deg") * 60
    density = F.col("n_local") / F.lit(area)
    p = -F.expm1(-F.lit(math.pi) * density / 3600.0 * sep * sep)
    out = (
        found.join(dense, "source_id").crossJoin(F.broadcast(trials))
        .withColumn("sep_arcmin", sep).withColumn("sep_sigma", sep / F.col("err_arcmin"))
        .withColumn("density", density).withColumn("p_chance", p)
        .withColumn("p_corrected", N.bonferroni(F.col("p_chance"), F.col("n_src") * F.col("n_host")))
    )
    inside = F.col("sep_sigma").isNull() | (F.col("sep_sigma") < 3)
    return out.withColumn("escalate", (F.col("p_corrected") < ESCALATION_P) & inside).select(
        "source_id", F.col("r_host_id").alias("host_id"), "sep_arcmin", "sep_sigma", "density", "p_chance", "p_corrected", "escalate")


def neutrino_excess(hosts: DataFrame, events: DataFrame, radius: float = 2.0) -> DataFrame:
    """Event counts around each host against a ring of two to five radii, in one aggregate."""
    found = counts_within(hosts.select("host_id", "ra", "dec"), events.select("ra", "dec"), {"n_observed": radius, "_inner": 2 * radius, "_outer": 5 * radius}, left_key="host_id")
    counts = found.select("host_id", "n_observed", (F.col("_outer") - F.col("_inner")).alias("n_ring"))
    totals = one_row(events, n_events=F.count("*")).crossJoin(one_row(hosts, n_hosts=F.count("*")))
    area, ring = math.pi * radius ** 2, math.pi * (25 - 4) * radius ** 2
    expected = F.when(F.col("n_ring") > 5, F.col("n_ring") / F.lit(ring) * area).otherwise(F.col("n_events") / F.lit(FULL_SKY) * area)
    return (
        counts.filter("n_observed > 0").crossJoin(F.broadcast(totals)).withColumn("n_expected", expected)
        .withColumn("p", N.poisson_tail(F.col("n_observed"), F.col("n_expected")))
        .withColumn("sigma", N.sigma_of_p(F.col("p"))).withColumn("p_corrected", N.bonferroni(F.col("p"), F.col("n_hosts")))
        .withColumn("significant", F.col("p_corrected") < 0.0027)
        .select("host_id", "n_observed", "n_ring", "n_expected", "p", "sigma", "p_corrected", "significant")
    )


def merger_radius() -> Column:
    return F.when(F.col("area") > 0, F.sqrt(F.col("area") / F.lit(math.pi))).otherwise(F.lit(10.0))


def merger_hosts(events: DataFrame, hosts: DataFrame, low_fa: float = 0.01, cell: float = 5.0) -> DataFrame:
    """Hosts inside each localisation, with the chance of any host there."""
    ev = events.filter("ra IS NOT NULL AND dec IS NOT NULL")
    ev = ev.withColumn("radius", merger_radius()).withColumn("used_area", F.when(F.col("area") > 0, F.col("area")).otherwise(F.lit(math.pi * 100.0)))
    n = one_row(hosts, n_hosts=F.count("*"))
    found = pairs(ev.select("event_id", "ra", "dec", "radius", "used_area"), hosts.select("host_id", "ra", "dec"), F.col("radius"), cell=cell)
    p_any = -F.expm1(F.col("n_hosts") * F.log1p(-F.col("used_area") / FULL_SKY))
    return found.crossJoin(n).withColumn("p_any", p_any).select(
        "event_id", F.col("r_host_id").alias("host_id"), "sep_deg", "p_any",
        (F.col("n_hosts") * F.col("used_area") / FULL_SKY).alias("n_expected"), (F.col("p_any") < low_fa).alias("low_fa"))


def mean_intervals(series: DataFrame, key: str, time: str) -> DataFrame:
    """Number of events and mean time between neighbours: the span over the number of gaps."""
    agg = series.groupBy(key).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    return agg.withColumn("mean_interval", F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / (F.col("n") - 1)))


def intervals(series: DataFrame, key: str, time: str) -> DataFrame:
    """Successive differences of the sorted times of each key."""
    rows = neighbours(with_position(series.select(key, time), key, time), [key], {"_before": (time, -1)})
    return rows.withColumn("interval", F.col(time) - F.col("_before")).filter("interval IS NOT NULL").drop("_before", "pos")


def burst_orbits(repeaters: DataFrame, bursts: DataFrame, hosts: DataFrame, max_arcmin: float = 10.0) -> DataFrame:
    """Repeaters near hosts whose mean burst interval is a small-integer multiple of the orbit."""
    near = pairs(repeaters.select("source_id", "ra", "dec"), hosts.select("host_id", "ra", "dec", "period_days", "st_mass"), max_arcmin * ARCMIN)
    rows = near.join(mean_intervals(bursts, "source_id", "mjd"), "source_id").filter("mean_interval IS NOT NULL AND r_period_days > 0")
    m = N.harmonic_match(F.col("mean_interval"), F.col("r_period_days"))
    rows = rows.withColumn("m", m)
    years = F.col("mean_interval") / 365.25
    return rows.select("source_id", F.col("r_host_id").alias("host_id"), (F.col("sep_deg") * 60).alias("sep_arcmin"), "mean_interval",
                       F.col("m.harmonic").alias("harmonic"), F.col("m.residual").alias("residual"), F.col("m.is_match").alias("is_match"),
                       F.pow(F.coalesce("r_st_mass", F.lit(1.0)) * years * years, F.lit(1 / 3)).alias("radius_au"))


def epoch_changes(first: DataFrame, second: DataFrame, radius: float, correction: float, sigma: float = 3.0,
                  default_errors=(0.5, 0.3)) -> DataFrame:
    """Sources that appeared, disappeared, brightened or dimmed between two epochs.

    Every step takes a number of tasks that goes with the rows, so a task's memory does not grow with the epochs.
    """
    tasks = tasks_for(first, second)
    match = nearest(first, second, radius, left_key="id", right_key="id", tasks=tasks)
    e1 = F.coalesce("flux_err", F.lit(default_errors[0])) * abs(correction)
    e2 = F.coalesce("r_flux_err", F.lit(default_errors[1]))
    scaled = F.col("flux") * correction
    change = (F.col("r_flux") - scaled) / F.sqrt(e1 * e1 + e2 * e2)
    changed = (
        match.filter("flux > 0 AND r_flux IS NOT NULL").withColumn("sigma_change", change).filter(F.abs("sigma_change") >= sigma)
        .select("r_id", F.when(F.col("sigma_change") > 0, "brightened").otherwise("dimmed").alias("change_type"),
                (F.col("r_flux") / (F.col("flux") * correction)).alias("flux_ratio"), "sigma_change").withColumnRenamed("r_id", "id")
    )
    none = F.lit(None).cast("double")

    def unmatched(side, seen, label):
        return side.repartition(tasks, "id").join(seen.repartition(tasks, "id"), "id", "left_anti").select("id", F.lit(label).alias("change_type"), none.alias("flux_ratio"), none.alias("sigma_change"))

    gone = unmatched(first, match.select("id"), "disappeared")
    new = unmatched(second, match.select(F.col("r_id").alias("id")).distinct(), "appeared")
    return changed.unionByName(gone).unionByName(new)


def merge_nearby(points: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """Group label for points linked by chains of steps below ``radius``: the smallest key of the chain.

    Exact copies of a position are one node, so a pile of copies yields no pairs.
    """
    nodes = collapse_copies(points.select(key, "ra", "dec"), key)
    near = pairs(nodes, nodes, radius, right_key=key, prefix="o_").select(F.col(key).alias("a"), F.col(f"o_{key}").alias("b")).filter("a <> b")
    edges = cut(near)
    labels = cut(nodes.select(F.col(key).alias("node"), F.col(key).alias("label")))
    while True:
        best = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("other"))
        step = labels.join(best, labels.node == best.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("other", "label")).alias("label"))
        # Jumping to the label of the label halves the remaining length of a chain.
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = cut(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = step.select("node", "label")
        if step.filter("old <> label").limit(1).count() == 0:
            break
    anchor = nodes.select("ra", "dec", F.col(key).alias("node")).join(labels, "node").drop("node")
    return points.join(anchor, ["ra", "dec"])
