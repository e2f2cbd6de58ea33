"""Cone searches that never write the pairs down, against the plain join."""

import random

import pytest
from pyspark.sql import functions as F

from skysift.operators import skyjoin


@pytest.fixture
def sky(spark):
    rng = random.Random(3)
    edge = [(0, 0.0, 90.0), (1, 359.999, -89.9), (2, 0.001, 89.0), (3, 180.0, 0.0), (4, 0.0, 0.0), (5, 10.0, -90.0)]
    spots = [(10 + i, rng.uniform(0, 360), rng.uniform(-90, 90)) for i in range(60)]
    points = [(i, rng.uniform(0, 360), rng.choice([rng.uniform(-90, 90), 88.5, 0.0]), rng.randrange(4)) for i in range(1500)]
    points += [(2000 + i, 40.0 * i, 90.0, 1) for i in range(9)] + [(3000 + i, 359.9995, 0.0, 2) for i in range(20)] + [(4000, None, 1.0, 0)]
    left = spark.createDataFrame(edge + spots + [(99, None, 5.0)], "id long, ra double, dec double")
    return left, spark.createDataFrame(points, "p long, ra double, dec double, g long")


def test_counts_are_those_of_all_pairs(sky, monkeypatch):
    monkeypatch.setattr(skyjoin, "ZONE_ROWS", 20)
    monkeypatch.setattr(skyjoin, "AT_ONCE", 64)
    left, right = sky
    near = skyjoin.pairs(left, right, 30.0).groupBy("id").agg(*[F.count_if(F.col("sep_deg") <= r).alias(n) for n, r in (("a", 0.5), ("b", 7.0), ("c", 30.0))])
    want = sorted(tuple(r) for r in near.collect())
    monkeypatch.setattr(skyjoin, "pairs", None)
    got = skyjoin.counts_within(left, right, {"a": 0.5, "b": 7.0, "c": 30.0}, left_key="id").collect()
    assert sorted(tuple(r) for r in got) == want and len(want) > 50


def test_first_in_a_cone_are_found_tier_by_tier(sky, monkeypatch):
    left, right = sky
    order = [F.col("r_g"), F.col("r_p")]
    want = skyjoin.best_per_group(skyjoin.pairs(left, right, 12.0), ["id"], order, 5).select("id", "r_p").collect()
    monkeypatch.setattr(skyjoin, "FIRST_TIER", 50)
    got = skyjoin.best_within(left, right, 12.0, 5, left_key="id", order=["g", "p"]).select("id", "r_p").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 100
