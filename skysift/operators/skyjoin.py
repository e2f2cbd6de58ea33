"""Joins on the sphere.

Every sky join is an equi-join on cells: declination zones cut into right-ascension buckets.
The left side, which should be the smaller one, is copied into all cells its search circle
touches; the right side stays in its own cell, so each pair meets exactly once. Cells that
hold more than ``hot_rows`` rows of a side are split into parts of that side, and each pair of
a left and a right part meets in its own group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions import sphere
from skysift.operators.ordered import with_position
from skysift.session import cut

ARCSEC = 1 / 3600.0
ARCMIN = 1 / 60.0
HOT_ROWS = 1_000_000
#: Rows of a side that meet in one group of ``counts_within``, pairs compared at once there, and a hair (degrees) around a cone that is compared exactly.
ZONE_ROWS, AT_ONCE, HAIR = 1 << 18, 1 << 20, 2e-6
#: First candidates of ``best_within``, and how much more each further tier holds.
FIRST_TIER, TIER_GROWTH = 4096, 8
#: Rows of both sides for one task of a join that states its number of tasks.
TASK_ROWS = 250_000


def _zone(dec: Column, cell: float) -> Column:
    # A propagated position may step over a pole, so the zone is held inside the sphere.
    zone = F.floor((dec + 90.0) / F.lit(cell))
    return F.least(F.lit(int(180.0 // cell)), F.greatest(F.lit(0), zone)).cast("int")


def _buckets_in(zone: Column, cell: float) -> Column:
    middle = (zone + 0.5) * F.lit(cell) - 90.0
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(middle)) / F.lit(cell))).cast("int")


def _bucket(ra: Column, count: Column) -> Column:
    return F.least(F.floor(F.pmod(ra, F.lit(360.0)) / 360.0 * count).cast("int"), count - 1)


def cell_size(radius: float) -> float:
    return min(30.0, max(float(radius), 0.1))


def in_cells(df: DataFrame, ra: str, dec: str, cell: float) -> DataFrame:
    """Add the cell (zone, bucket) a position lies in."""
    return df.withColumn("_zone", _zone(F.col(dec), cell)).withColumn(
        "_bucket", _bucket(F.col(ra), _buckets_in(F.col("_zone"), cell))
    )


def over_cells(df: DataFrame, ra: str, dec: str, radius: Column, cell: float) -> DataFrame:
    """Copy each position into every cell its search circle touches."""
    d, r = F.col(dec), F.least(radius, F.lit(180.0))
    low, high = _zone(d - r, cell), _zone(d + r, cell)
    reach = F.when(
        F.abs(d) + r < 89.9999,
        F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(r)) / F.cos(F.radians(d))))) + 1e-9,
    ).otherwise(F.lit(180.0))
    rows = df.withColumn("_reach", reach).withColumn("_zone", F.explode(F.sequence(low, high)))
    rows = rows.withColumn("_count", _buckets_in(F.col("_zone"), cell))
    first = F.floor((F.col(ra) - F.col("_reach")) / 360.0 * F.col("_count")).cast("int")
    last = F.floor((F.col(ra) + F.col("_reach")) / 360.0 * F.col("_count")).cast("int")
    full = last - first + 1 >= F.col("_count")
    span = F.when(full, F.sequence(F.lit(0), F.col("_count") - 1)).otherwise(F.sequence(first, last))
    return (
        rows.withColumn("_step", F.explode(span))
        .withColumn("_bucket", F.pmod(F.col("_step"), F.col("_count")))
        .drop("_reach", "_count", "_step")
    )


def _split_hot(left: DataFrame, right: DataFrame, hot_rows: int):
    """Parts of cells that are hot on either side: a row has its own part of its side and meets all parts of the other."""
    cell = ["_zone", "_bucket"]
    rows = left.select(*cell, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*cell, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counts = rows.groupBy(*cell).agg(F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr"))
    hot = counts.filter((F.col("_nl") > hot_rows) | (F.col("_nr") > hot_rows)).select(
        *cell, F.ceil(F.col("_nl") / F.lit(hot_rows)).cast("int").alias("_left_parts"), F.ceil(F.col("_nr") / F.lit(hot_rows)).cast("int").alias("_right_parts")
    )

    def dealt(side: DataFrame, own: str, other: str, key: Column) -> DataFrame:
        mine = F.when(F.coalesce(F.col(f"_{own}_parts"), F.lit(1)) <= 1, 0).otherwise(F.pmod(key, F.col(f"_{own}_parts")).cast("int"))
        every = F.sequence(F.lit(0), F.greatest(F.coalesce(F.col(f"_{other}_parts"), F.lit(1)), F.lit(1)) - 1)
        return side.join(hot, cell, "left").withColumn(f"_{own}_part", mine).withColumn(f"_{other}_part", F.explode(every)).drop("_left_parts", "_right_parts")

    return dealt(left, "left", "right", F.xxhash64("_lra", "_ldec", "_salt")), dealt(right, "right", "left", F.xxhash64("_rra", "_rdec", "_rkey"))


def pairs(left: DataFrame, right: DataFrame, radius: float | Column, *,
          left_pos: tuple[str, str] = ("ra", "dec"), right_pos: tuple[str, str] = ("ra", "dec"),
          right_key: str | None = None, cell: float | None = None, metric: str = "sphere",
          hot_rows: int = HOT_ROWS, sep: str = "sep_deg", prefix: str = "r_", tasks: int | None = None) -> DataFrame:
    """All (left, right) pairs within ``radius`` degrees.

    ``tasks``: so many tasks for the join, in place of the session's number.

    ``radius`` is a number or a column of the left side (then give ``cell``). Columns of the
    right side get ``prefix``. With ``metric='flat'`` the small-angle distance is used.
    """
    constant = not isinstance(radius, Column)
    cell = cell or cell_size(radius)
    r = F.lit(float(radius)) if constant else radius
    # The flat metric overstates no distance by more than a hair near the poles, so look wider there.
    reach = r if metric == "sphere" else r * 1.05 + 1e-6
    renamed = right.select(*[F.col(c).alias(f"{prefix}{c}") for c in right.columns])
    rra, rdec = (f"{prefix}{c}" for c in right_pos)
    rkey = F.col(f"{prefix}{right_key}") if right_key else F.lit(0)
    rr = in_cells(
        renamed.withColumn("_rra", F.col(rra)).withColumn("_rdec", F.col(rdec)).withColumn("_rkey", rkey)
        .filter(F.col("_rra").isNotNull() & F.col("_rdec").isNotNull()),
        "_rra", "_rdec", cell,
    )
    ll = over_cells(
        left.withColumn("_radius", r)
        .filter(F.col(left_pos[0]).isNotNull() & F.col(left_pos[1]).isNotNull() & (F.col("_radius") >= 0)),
        *left_pos, reach, cell,
    )
    ll = ll.withColumns({"_lra": F.col(left_pos[0]), "_ldec": F.col(left_pos[1]), "_salt": F.xxhash64(*[c for c, t in left.dtypes if "map<" not in t])})
    ll, rr = _split_hot(ll, rr, hot_rows)
    distance = {"sphere": sphere.separation, "flat": sphere.separation_flat}[metric]
    if tasks:
        ll, rr = (side.repartition(tasks, "_zone", "_bucket", "_left_part", "_right_part") for side in (ll, rr))
    return (
        ll.join(rr, ["_zone", "_bucket", "_left_part", "_right_part"])
        .withColumn(sep, distance(left_pos[0], left_pos[1], "_rra", "_rdec"))
        .filter(F.col(sep) <= F.col("_radius"))
        .drop("_zone", "_bucket", "_left_part", "_right_part", "_lra", "_ldec", "_salt", "_rra", "_rdec", "_rkey", "_radius")
    )


def tasks_for(*sides: DataFrame) -> int:
    """Tasks for joins of the sides: TASK_ROWS rows each, and the session's number at least. Counts the sides."""
    return max(int(sides[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(sum(side.count() for side in sides) / TASK_ROWS))


def collapse_copies(df: DataFrame, key: str, pos: tuple[str, str] = ("ra", "dec"), tasks: int | None = None) -> DataFrame:
    """Keep the row with the smallest key at each exact position."""
    others = [c for c in df.columns if c not in pos]
    df = df.repartition(tasks, *pos) if tasks else df
    best = df.groupBy(*pos).agg(F.min(F.struct(key, *[c for c in others if c != key])).alias("_b"))
    return best.select(*[F.col(c) if c in pos else F.col(f"_b.{c}") for c in df.columns])


def nearest(left: DataFrame, right: DataFrame, radius: float | Column, *, left_key: str,
            right_key: str, keep_unmatched: bool = False, by: Sequence[str] = (), **options) -> DataFrame:
    """Each left row with its single nearest right row inside ``radius``.

    Ties go to the smaller right key. ``by`` adds right columns that get one match each
    (for several catalogs stacked in one frame). Copies at one position meet as one row. With ``tasks`` every step has so many
    tasks (``tasks_for``): a large catalog's share of a task does not grow with it.
    """
    prefix, sep = options.get("prefix", "r_"), options.get("sep", "sep_deg")
    right_pos = options.get("right_pos", ("ra", "dec"))
    if not by and not any("map<" in t for _, t in right.dtypes):
        right = collapse_copies(right, right_key, right_pos, options.get("tasks"))
    rcols = [f"{prefix}{c}" for c in right.columns]
    bykeys = [f"{prefix}{c}" for c in by]
    lpos = options.get("left_pos", ("ra", "dec"))
    slim = left.select(*dict.fromkeys([left_key, *lpos, *options.pop("left_columns", [])]))
    found = pairs(slim, right, radius, right_key=right_key, **options)
    if tasks := options.get("tasks"):
        left, found = left.repartition(tasks, left_key), found.repartition(tasks, left_key)
    ordered = [sep, f"{prefix}{right_key}", *[c for c in rcols if c != f"{prefix}{right_key}" and c not in bykeys]]
    best = found.groupBy(left_key, *bykeys).agg(F.min(F.struct(*ordered)).alias("_b"))
    best = best.select(left_key, *bykeys, *[F.col(f"_b.{c}").alias(c) for c in ordered])
    return left.join(best, left_key, "left" if keep_unmatched else "inner")


def without_nearby(left: DataFrame, right: DataFrame, radius: float, *, left_key: str) -> DataFrame:
    """Left rows with no right row inside ``radius``. The left side, a large catalog, stays in its cells; the right one is copied."""
    close = pairs(right.select("ra", "dec"), left.select(left_key, "ra", "dec"), radius, right_key=left_key)
    return left.join(close.select(F.col(f"r_{left_key}").alias(left_key)).distinct(), left_key, "left_anti")


def count_within(left: DataFrame, right: DataFrame, radius: float | Column, *, left_key: str,
                 name: str = "n_near", **options) -> DataFrame:
    """Number of right rows inside ``radius`` of every left row, zero included."""
    lpos = options.get("left_pos", ("ra", "dec"))
    extra = options.pop("left_columns", [])
    found = pairs(left.select(*dict.fromkeys([left_key, *lpos, *extra])), right, radius, **options)
    counts = found.groupBy(left_key).agg(F.count("*").alias(name))
    return left.join(counts, left_key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def best_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First k rows of each key. Spark keeps only k rows per task and key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def best_within(left: DataFrame, right: DataFrame, radius: float, k: int, *, left_key: str, order: Sequence[str], prefix: str = "r_") -> DataFrame:
    """The first k rows of the right side inside ``radius`` of each left key, in the order of the columns ``order``; pairs, as ``pairs`` gives them.

    The right side is put in order once. Left keys meet its first rows only; those that find fewer than k go on to a tier TIER_GROWTH
    times as long, in the end to all. So pairs grow with left keys times k, not with both sides. Rows without a position are left out.
    """
    rows = cut(with_position(right.filter("ra IS NOT NULL AND dec IS NOT NULL"), *order, name="_place"))
    n, length, found = rows.count(), FIRST_TIER, None
    by = [F.col(f"{prefix}{o}") for o in order]
    while True:
        met = pairs(left, rows.filter(F.col("_place") < length), radius, prefix=prefix)
        met = cut(best_per_group(met, [left_key], by, k).drop(f"{prefix}_place"))
        if length >= n:
            return found.unionByName(met) if found is not None else met
        done = met.groupBy(left_key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= k).select(left_key)
        kept = met.join(done, left_key, "left_semi")
        found = kept if found is None else found.unionByName(kept)
        left = cut(left.join(done, left_key, "left_anti"))
        if left.isEmpty():
            return found
        length *= TIER_GROWTH


def _half_width(cos_r: float, dec0: np.ndarray, dec: np.ndarray) -> np.ndarray:
    """Degrees of right ascension that a cone around ``dec0`` spans to each side at ``dec``; -1 where it does not reach."""
    at = (cos_r - np.sin(dec0) * np.sin(dec)) / np.maximum(np.cos(dec0) * np.cos(dec), 1e-300)
    return np.where(at > 1, -1.0, np.degrees(np.arccos(np.clip(at, -1, 1))))


def _zone_counts(ra: np.ndarray, dec: np.ndarray, ra0: np.ndarray, dec0: np.ndarray, radius: float) -> np.ndarray:
    """How many of the points (``ra`` sorted, 0 to 360) lie within ``radius`` of each centre: ranges that are inside as a whole at once, their fringes one by one."""
    n = len(ra)
    around = np.concatenate([ra - 360.0, ra, ra + 360.0])
    low, high, d0 = np.radians(dec.min()), np.radians(dec.max()), np.radians(dec0)
    if radius < 90:
        cos_r = np.cos(np.radians(radius))
        widest = np.arcsin(np.clip(np.sin(d0) / cos_r, -1, 1))
        ends = [_half_width(cos_r, d0, x) for x in (low, high)]
        inner = np.minimum(*ends) - HAIR
        outer = np.maximum(np.maximum(*ends), _half_width(cos_r, d0, np.clip(widest, low, high))) + HAIR
    else:
        inner, outer = np.full(len(ra0), -1.0), np.full(len(ra0), 180.0)
    inside = np.maximum(inner, 0.0)
    a, b = np.searchsorted(around, ra0 - inside, "left"), np.searchsorted(around, ra0 + inside, "right")
    b = np.where(inner > 0, b, a)
    b = np.where(inner >= 180 - 2 * HAIR, a, b)  # nearly whole circles are compared one by one
    total = b - a
    every = (outer >= 180) | (inner >= 180 - 2 * HAIR)
    first, last = np.searchsorted(around, ra0 - outer, "left"), np.searchsorted(around, ra0 + outer, "right")
    starts = np.concatenate([np.where(every, b, first), b])
    stops = np.concatenate([np.where(every, a + n, a), np.where(every, b, last)])
    sizes = np.where(np.tile(outer, 2) > 0, np.maximum(stops - starts, 0), 0)
    sizes = np.minimum(sizes, n)
    who = np.tile(np.arange(len(ra0)), 2)
    edges = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(edges, (edges[at - 1] if at else 0) + AT_ONCE, "right")))
        part = sizes[at:end]
        i = np.repeat(who[at:end], part)
        j = (np.repeat(starts[at:end] - np.concatenate(([0], np.cumsum(part)[:-1])), part) + np.arange(part.sum())) % n
        d1, d2 = d0[i], np.radians(dec[j])
        h = np.sin((d2 - d1) / 2) ** 2 + np.cos(d1) * np.cos(d2) * np.sin((np.radians(ra[j]) - np.radians(ra0[i])) / 2) ** 2
        near = np.degrees(2.0 * np.arcsin(np.sqrt(np.minimum(1.0, h)))) <= radius
        total = total + np.bincount(i[near], minlength=len(ra0))
        at = end
    return total


def counts_within(left: DataFrame, right: DataFrame, radii: dict[str, float], *, left_key: str) -> DataFrame:
    """``left_key`` and for each name of ``radii`` the number of right rows inside that radius (degrees); keys with none inside the largest are left out.

    The right side is dealt into declination zones, narrower the more rows it has, and each left row is copied to the zones its largest cone
    reaches. In a zone sorted by right ascension a cone holds one range; only the points at its fringe are compared one by one, so pairs are never
    rows and a left row's work grows with the square root of the right side's density. Crowded zones are dealt into several groups.
    """
    spark = left.sparkSession
    right = right.select((F.pmod("ra", F.lit(360.0))).alias("_rra"), F.col("dec").alias("_rdec"), F.lit(0).alias("_rkey")).dropna()
    left = left.select(F.col(left_key).alias("_key"), F.pmod("ra", F.lit(360.0)).alias("_lra"), F.col("dec").alias("_ldec")).filter("_lra IS NOT NULL AND _ldec IS NOT NULL")
    zones = int(min(1800, max(30, right.count() ** 0.5 / 4)))
    height, reach = 180.0 / zones, max(radii.values())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rr = right.withColumn("_zone", _zone(F.col("_rdec"), height)).withColumn("_bucket", F.lit(0))
    spread = F.sequence(_zone(F.col("_ldec") - reach - 1e-6, height), _zone(F.col("_ldec") + reach + 1e-6, height))
    ll = left.withColumn("_zone", F.explode(spread)).withColumn("_bucket", F.lit(0)).withColumn("_salt", F.xxhash64("_key"))
    ll, rr = _split_hot(ll, rr, ZONE_ROWS)
    group = ["_zone", "_left_part", "_right_part"]
    ll = ll.select(*group, "_key", "_lra", "_ldec").repartition(tasks, *group)
    rr = rr.select(*[F.col(c).alias(c) for c in (*group, "_rra", "_rdec")]).repartition(tasks, *group)

    def counted(hosts: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"_key": hosts["_key"]})
        points = points.sort_values("_rra")
        ra, dec = points["_rra"].to_numpy(float), points["_rdec"].to_numpy(float)
        for name, radius in radii.items():
            known = len(ra) and len(hosts)
            out[name] = _zone_counts(ra, dec, hosts["_lra"].to_numpy(float), hosts["_ldec"].to_numpy(float), radius) if known else 0
        return out[(out[list(radii)] > 0).any(axis=1)]

    shape = f"_key {dict(left.dtypes)['_key']}, " + ", ".join(f"`{c}` bigint" for c in radii)
    found = ll.groupBy(*group).cogroup(rr.groupBy(*group)).applyInPandas(counted, shape)
    return found.groupBy(F.col("_key").alias(left_key)).agg(*[F.sum(c).alias(c) for c in radii])
