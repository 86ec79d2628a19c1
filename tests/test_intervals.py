"""Interval merges, joins and sweeps on keys of any size, against loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from seqlens.operators import intervals as I

ROWS = "key string, part int, start int, end int, label string"


def _rows(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.randrange(0, 5000)
        size = rng.choice([0, 1, 1, 2, 3, 17, 64, 65, 400, 3000])
        # one key holds nearly all rows
        rows.append((rng.choice(["hot"] * 9 + ["a", None]), rng.randrange(2), a, a + size, f"m{i % 7}"))
    return rows + rows[:9]


def _merged(items):
    out = []
    for a, b in sorted(set(items)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("parts", [1, 7])
def test_spread_merge_equals_a_loop(spark, parts):
    rows = [r for r in _rows(1) if r[2] < r[3]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, ROWS).repartition(parts)
        got = sorted(((r.key or "", r.part, r.start, r.end) for r in I.merge_intervals(df, ["key", "part"], spread=True).collect()))
        assert sorted(((r.key or "", r.part, r.start, r.end) for r in I.merge_intervals(df, ["key", "part"]).collect())) == got
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [(k or "", p, a, b) for k, p in {(r[0], r[1]) for r in rows} for a, b in _merged([(r[2], r[3]) for r in rows if (r[0], r[1]) == (k, p)])]
    assert got == sorted(want)


def test_an_island_may_lie_in_many_partitions(spark):
    rows = [("k", 0, 10 * i, 10 * i + 12, "x") for i in range(4000)] + [("k", 0, 50_000, 50_001, "x"), ("j", 0, 5, 6, "x")]
    got = I.merge_spread(spark.createDataFrame(rows, ROWS), ["key"]).collect()
    assert sorted((r.key, r.start, r.end) for r in got) == [("j", 5, 6), ("k", 0, 40_002), ("k", 50_000, 50_001)]


def test_intersections_equal_a_loop(spark):
    left, right = _rows(2), _rows(3, 200)
    got = I.intersect_intervals(spark.createDataFrame(left, ROWS), spark.createDataFrame(right, ROWS).select("key", "start", "end"), ["key"])
    assert got.columns == ["key", "part", "start", "end", "label", "overlap_start", "overlap_end"]
    want = [(*x, max(x[2], y[2]), min(x[3], y[3])) for x in left for y in right if x[0] is not None and x[0] == y[0] and x[2] < y[3] and x[3] > y[2] and x[2] < x[3] and y[2] < y[3]]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    none = spark.createDataFrame([], ROWS)
    assert I.intersect_intervals(none, none, ["key"]).count() == 0


def test_sweep_equals_a_loop(spark):
    rows = [r for r in _rows(4, 120) if r[0] is not None]
    got = {(r.key, r.seg_start, r.seg_end): r.members for r in I.sweep_segments(spark.createDataFrame(rows, ROWS), ["key"], "label").collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        ends = sorted({x for r in mine for x in r[2:4]})
        for a, b in zip(ends, ends[1:]):
            if active := sorted({r[4] for r in mine if r[2] <= a and r[3] >= b}):
                want[key, a, b] = active
    assert got == want


def test_a_million_intervals_of_one_key(spark):
    """One accession with all rows: a join in bins and a merge by ranges take seconds, where meeting by key alone takes 10**11 pairs."""
    many = spark.range(500_000).select(F.lit("k").alias("key"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 4).alias("end"))
    other = spark.range(500_000).select(F.lit("k").alias("key"), (F.col("id") * 10 + 3).alias("start"), (F.col("id") * 10 + 9).alias("end"))
    began = time.time()
    assert I.intersect_intervals(many, other, ["key"]).agg(F.count(F.lit(1)), F.sum(F.col("overlap_end") - F.col("overlap_start"))).first()[:] == (500_000, 500_000)
    assert I.merge_spread(many.unionByName(other), ["key"]).agg(F.count(F.lit(1)), F.sum(F.col("end") - F.col("start"))).first()[:] == (500_000, 4_500_000)
    assert time.time() - began < 300
