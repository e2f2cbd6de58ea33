"""Grouped tests, combinations and calibrations. Every ranking is spread over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions import numeric as N
from skysift.operators.ordered import join_keys, neighbours, quantiles, running, value_counts, with_position
from skysift.operators.skyjoin import best_per_group
from skysift.session import cut


def q_values(df: DataFrame, p: str, keys: Sequence[str] = (), q: str = "q_value") -> DataFrame:
    """False-discovery q-value of every distinct p-value per group.

    Tied p-values share a q-value, so the work is done on distinct values with counts.
    """
    keys = list(keys)
    values = value_counts(df, keys, p, {"_n": F.lit(1)})
    total = df.groupBy(*keys).agg(F.count("*").alias("_m"))
    values = values.join(total, keys) if keys else values.crossJoin(F.broadcast(total))  # one row
    raw = F.least(F.lit(1.0), F.col(p) * F.col("_m") / F.col("cum__n"))
    return running(values, keys, {q: (raw, "min")}, reverse=True).select(*keys, p, q)


def benjamini_hochberg(df: DataFrame, p: str, keys: Sequence[str] = (), alpha: float = 0.05,
                       q: str = "q_value", flag: str = "is_significant") -> DataFrame:
    """Attach q-values per group and whether they pass ``alpha``."""
    return df.join(q_values(df, p, keys, q), [*keys, p]).withColumn(flag, F.col(q) <= alpha)


def fisher(p: str) -> tuple[Column, Column]:
    """Aggregates of valid p-values: minus twice the log sum, and their number."""
    ok = (F.col(p) > 0) & (F.col(p) <= 1)
    return (
        F.sum(F.when(ok, -2.0 * F.log(F.greatest(F.col(p), F.lit(N.P_FLOOR))))), F.count_if(ok))


def fisher_p(statistic: Column, k: Column) -> Column:
    return (
        F.when(k == 0, F.lit(1.0)).when(k == 1, F.exp(-statistic / 2))
        .otherwise(N.clip(N.chi_square_tail(statistic, k * 2), N.P_FLOOR, 1))
    )


def stouffer(p: str, weight: Column | None = None) -> tuple[Column, Column, Column]:
    """Aggregates for a weighted sum of normal scores: sum, sum of squared weights, number of p = 1."""
    given = F.col(p).isNotNull()
    w = F.when(given, F.greatest(F.lit(0.0), weight) if weight is not None else F.lit(1.0))
    c = F.when(given, F.greatest(F.col(p), F.lit(N.P_FLOOR)))
    return F.sum(F.when(c < 1, w * N.normal_tail_inverse(c))), F.sum(w * w), F.count_if((c >= 1) & (w > 0))


def stouffer_p(total: Column, squares: Column, ones: Column) -> Column:
    z = F.when(squares > 0, F.coalesce(total, F.lit(0.0)) / F.sqrt(squares))
    return F.when(ones > 0, F.lit(1.0)).when(squares > 0, N.clip(N.normal_tail(z), N.P_FLOOR, 1)).otherwise(F.lit(1.0))


def empirical_p(targets: DataFrame, controls: DataFrame, keys: Sequence[str], score: str = "score",
                strict: bool = False, name: str = "p") -> DataFrame:
    """(controls at or above the score + 1) / (controls + 2); strictly above when ``strict``.

    Scores without controls in their group get 1. Null scores stay null.
    """
    keys = list(keys)
    both = targets.select(*keys, score, F.lit(0).alias("_c")).unionByName(controls.select(*keys, score, F.lit(1).alias("_c")))
    values = value_counts(both.filter(F.col(score).isNotNull()), keys, score, {"_k": F.col("_c")})
    size = controls.filter(F.col(score).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    values = values.join(size, keys, "left")
    above = F.col("_n") - F.col("cum__k") + (F.lit(0) if strict else F.col("_k"))
    p = F.when(F.col("_n").isNull(), F.lit(1.0)).otherwise((above + 1) / (F.col("_n") + 2.0))
    return targets.join(values.select(*keys, score, p.alias(name)), [*keys, score], "left")


def two_sample_ks(df: DataFrame, keys: Sequence[str], value: str, in_first: Column) -> DataFrame:
    """Largest distance of two empirical distributions per key, with the limiting p-value."""
    keys = list(keys)
    values = value_counts(df.filter(F.col(value).isNotNull()), keys, value,
                          {"_a": F.when(in_first, 1).otherwise(0), "_b": F.when(in_first, 0).otherwise(1)})
    sizes = values.groupBy(*keys).agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2"))
    gap = F.abs(F.col("cum__a") / F.col("n1") - F.col("cum__b") / F.col("n2"))
    out = values.join(sizes, keys).filter("n1 > 0 AND n2 > 0").groupBy(*keys).agg(F.max(gap).alias("d"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    return out.withColumn("p", N.kolmogorov_tail(F.col("d"), F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))))


def one_sample_ks(df: DataFrame, keys: Sequence[str], value: str, cdf: Column) -> DataFrame:
    """Largest distance of an empirical distribution from a given one (a column over the value and keys)."""
    keys = list(keys)
    values = value_counts(df, keys, value, {"_n": F.lit(1)})
    sizes = values.groupBy(*keys).agg(F.sum("_n").alias("n"))
    values = values.join(sizes, keys).withColumn("_f", cdf)
    gap = F.greatest(F.col("cum__n") / F.col("n") - F.col("_f"), F.col("_f") - (F.col("cum__n") - F.col("_n")) / F.col("n"))
    out = values.groupBy(*keys).agg(F.max(gap).alias("d"), F.first("n").alias("n"))
    return out.withColumn("p", N.kolmogorov_tail(F.col("d"), F.col("n").cast("double")))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 10) -> DataFrame:
    """Rank correlation per key over rows that have both values.

    Equal pairs of values are counted first, and the ranks of values meet these counts by sorting: Spark takes rows that were made by
    exploding lists for few and would send all of them to the driver for a broadcast.
    """
    keys = list(keys)
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    joint = cut(both.groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_c")))
    for v in ("_x", "_y"):
        ranks = value_counts(joint.select(*keys, v, "_c"), keys, v, {"_t": F.col("_c")})
        ranks = join_keys(ranks, ranks.groupBy(*keys).agg(F.sum("_t").alias("_n")), keys)
        # distance of the average rank from the middle one: half integers, so these are exact
        off = F.col("cum__t") - F.col("_t") + (F.col("_t") - F.col("_n")) / 2.0
        joint = join_keys(joint, ranks.select(*keys, v, off.alias(f"_off{v}")).hint("merge"), [*keys, v])
    a, b, c = F.col("_off_x"), F.col("_off_y"), F.col("_c")
    sums = joint.groupBy(*keys).agg(F.sum(c * a * b).alias("_ab"), F.sum(c * a * a).alias("_aa"), F.sum(c * b * b).alias("_bb"), F.sum(c).alias("n"))
    out = sums.filter(F.col("n") > least).withColumn("rho", F.try_divide(F.col("_ab"), F.sqrt("_aa") * F.sqrt("_bb"))).select(*keys, "rho", "n")
    return out.withColumn("p", N.correlation_p(F.col("rho"), F.col("n")))


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str, is_target: Column) -> DataFrame:
    """One-sided rank-sum test (targets larger), normal form with tie and continuity corrections."""
    keys = list(keys)
    values = value_counts(df.filter(F.col(value).isNotNull()), keys, value, {"_t": F.when(is_target, 1).otherwise(0), "_n": F.lit(1)})
    mid = F.col("cum__n") - F.col("_n") + (F.col("_n") + 1) / 2.0
    n = F.col("_n").cast("double")
    out = values.groupBy(*keys).agg(
        F.sum(mid * F.col("_t")).alias("_r"), F.sum("_t").alias("n1"), (F.sum("_n") - F.sum("_t")).alias("n2"), F.sum(n * n * n - n).alias("_ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("_r") - n1 * (n1 + 1) / 2
    total = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * ((total + 1) - F.col("_ties") / (total * (total - 1))))
    z = (F.col("u") - n1 * n2 / 2 - 0.5) / F.col("_sd")
    out = out.withColumn("u", u).withColumn("_sd", sd).withColumn("z", z)
    return out.withColumn("p", N.normal_tail(F.col("z"))).drop("_r", "_ties", "_sd")


def excess_strength(df: DataFrame, keys: Sequence[str], value: str, is_target: Column, sigma: float = 3.0) -> DataFrame:
    """Share of targets above ``sigma``, how strong these are (1 - exp(-median / 2 sigma), 0 without any) and the detection score of both."""
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull() & is_target)
    share = rows.groupBy(*keys).agg(F.avg((F.col(value) > sigma).cast("int")).alias("share_above"))
    middle = quantiles(rows.filter(F.col(value) > sigma), keys, value, {"_m": 0.5})
    strength = F.coalesce(1.0 - F.exp(-F.col("_m") / (2.0 * sigma)), F.lit(0.0))
    out = share.join(middle, keys, "left").withColumn("strength", strength)
    return out.withColumn("detection", N.clip(0.5 * F.col("share_above") + 0.5 * F.col("strength"), 0, 1)).drop("_m")


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The element at index n // 2 of the sorted values."""
    keys = list(keys)
    rows = with_position(df.filter(F.col(value).isNotNull()).select(*keys, value), *keys, value)
    spans = rows.groupBy(*keys).agg((F.min("pos") + F.floor(F.count("*") / 2)).alias("_at"))
    return spans.join(rows.select(F.col("pos").alias("_at"), F.col(value).alias(name)), "_at").select(*keys, name)


def equal_bins(value: str, low: str, high: str, bins: int) -> Column:
    """Zero-based equal-width bin; the top edge belongs to the last bin."""
    w = (F.col(high) - F.col(low)) / bins
    return F.when(w > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col(low)) / w).cast("int"))).otherwise(F.lit(0))


def residual_structure(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bins: int = 20) -> DataFrame:
    """Histogram entropy against the Gaussian one, and the correlation of neighbours in order."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))
    rows = df.select(*keys, *order, value).join(span, keys)
    hist = rows.groupBy(*keys, equal_bins(value, "_lo", "_hi", bins).alias("_bin")).agg(F.count("*").alias("_k"), F.first("n").alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    density = F.col("_k") / F.col("n") / width
    entropy = hist.groupBy(*keys).agg(F.sum(-density * F.log2(density) * width).alias("entropy"))
    near = neighbours(with_position(df.select(*keys, *order, value), *keys, *order), keys, {"_next": (value, 1)})
    lagged = near.groupBy(*keys).agg(N.correlation(value, "_next").alias("lag1"))
    gauss = 0.5 * F.log2(F.lit(2 * 3.141592653589793 * 2.718281828459045) * F.col("std") * F.col("std"))
    out = span.filter("n >= 20 AND _hi > _lo").join(entropy, keys).join(lagged, keys)
    return out.select(*keys, "n", "entropy", gauss.alias("gaussian_entropy"), "lag1", (F.abs("lag1") > 0.3).alias("is_structured"))


def z_scores(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features on the scale of the whole frame (population deviation; a constant feature keeps scale one)."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    scaled = {f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in features}
    return out.withColumns(scaled).drop(*[f"_{n}_{c}" for c in features for n in "ms"])


def matched_controls(targets: DataFrame, pool: DataFrame, features: Sequence[str], k: int, *, target_key: str, pool_key: str,
                     first_width: float = 0.25) -> DataFrame:
    """The k pool rows nearest to each target in scaled feature space.

    Candidates come from grid cells on the first two features. A target is settled once its
    k-th distance is within one cell width, since nothing outside its nine cells can be closer;
    the others are retried on a grid of four times the width.
    """
    finite = [N.clean(c).isNotNull() for c in features]
    ok = finite[0]
    for f in finite[1:]:
        ok = ok & f
    both = z_scores(
        targets.filter(ok).select(F.col(target_key).alias("_id"), *features, F.lit(True).alias("_t"))
        .unionByName(pool.filter(ok).select(F.col(pool_key).alias("_id"), *features, F.lit(False).alias("_t"))), features)
    zs = [f"z_{c}" for c in features]
    grid = zs[:2]
    t = both.filter("_t").select(F.col("_id").alias(target_key), *zs)
    # Of rows with the same features only the first k can be among the k nearest.
    p = best_per_group(both.filter("NOT _t").select(F.col("_id").alias(pool_key), *zs), zs, [F.col(pool_key)], k)
    t, p = cut(t), cut(p)
    box = p.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in grid for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if not box["n"]:
        return t.select(target_key, F.lit(None).cast("bigint").alias(pool_key), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("nth")).limit(0)
    reach = t.agg(*[F.greatest(F.max(F.abs(F.col(c) - box[f"lo_{c}"])), F.max(F.abs(F.col(c) - box[f"hi_{c}"]))).alias(c) for c in grid]).first()
    farthest = max([0.0, *(reach[c] or 0.0 for c in grid)])
    width, done = first_width, None
    while True:
        cells = [F.floor(F.col(c) / F.lit(width)).alias(f"_g{i}") for i, c in enumerate(grid)]
        here = p.select(pool_key, *[F.col(z).alias(f"p_{z}") for z in zs], *cells)
        around = t.select("*", *cells)
        for i in range(len(grid)):
            around = around.withColumn(f"_g{i}", F.explode(F.array(*[F.col(f"_g{i}") + d for d in (-1, 0, 1)])))
        d2 = sum(((F.col(z) - F.col(f"p_{z}")) * (F.col(z) - F.col(f"p_{z}")) for z in zs), F.lit(0.0))
        found = around.join(here, [f"_g{i}" for i in range(len(grid))]).select(target_key, pool_key, F.sqrt(d2).alias("distance"))
        last = width > farthest
        if not last:
            found = found.filter(F.col("distance") <= width)  # only these can settle a target
        near = best_per_group(found, [target_key], [F.col("distance"), F.col(pool_key)], k)
        if not last:
            settled = near.groupBy(target_key).agg(F.count("*").alias("_k")).filter(F.col("_k") >= k).select(target_key)
            near = near.join(settled, target_key, "left_semi")
        near = cut(near)
        done = near if done is None else done.unionByName(near)
        if last:
            return done
        t = cut(t.join(near.select(target_key).distinct(), target_key, "left_anti"))
        if t.limit(1).count() == 0:
            return done
        width *= 4
