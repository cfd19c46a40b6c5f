"""Interval operators against quadratic brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.operators import intervals as I
from tidemark.plans import queries as plans


def some(n, seed, keys=3, span=300):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randrange(span)
        out.append((f"k{r.randrange(keys)}", i, a, a + r.randrange(1, 12)))
    return out


def test_bins_of_edges(spark):
    df = spark.createDataFrame([(0, 50), (0, 51), (100, 100), (30, 10), (None, 5)], "start long, stop long")
    got = [r.bin for r in I.bin_intervals(df, 50, explode=False).collect()]
    assert got == [[0], [0, 50], [], [], []]


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_nearest(spark, k, seed):
    a, b = some(40, seed), some(30, seed + 10)
    fa = spark.createDataFrame(a, "chrom string, a_id long, a_start long, a_stop long")
    fb = spark.createDataFrame(b, "chrom string, b_id long, b_start long, b_stop long")

    def dist(x, y):
        if y[2] < x[3] and x[2] < y[3]:
            return 0
        return y[2] - x[3] + 1 if y[2] >= x[3] else -(x[2] - y[3] + 1)

    want = set()
    for x in a:
        ds = [(dist(x, y), y[1]) for y in b if y[0] == x[0]]
        for d, y in ds:
            if sum(abs(e) < abs(d) for e, _ in ds) < k:
                want.add((x[1], y, d))
    got = I.nearest(fa, fb, "chrom", k, bucket=16).collect()
    assert {(r.a_id, r.b_id, r.distance) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("bucket", [None, 20])
def test_merge(spark, bucket):
    a = some(60, 5)
    got = sorted(tuple(r) for r in I.merge_intervals(spark.createDataFrame(a, "chrom string, id long, start long, stop long"), "chrom", bucket=bucket).collect())
    want = []
    for key in sorted({x[0] for x in a}):
        now = None
        for s, e in sorted((x[2], x[3]) for x in a if x[0] == key):
            if now and s <= now[1] + 1:
                now = [now[0], max(now[1], e), now[2] + 1]
            else:
                if now:
                    want.append((key, *now))
                now = [s, e, 1]
        want.append((key, *now))
    assert got == sorted(want)


def test_subset_intersections_of_many_groups(spark):
    r = random.Random(4)
    groups = [f"g{i}" for i in range(16)]
    rows = [(k, g) for k in range(300) for g in groups if r.random() < 0.7]
    got = {x.mask: x.n for x in I.subset_intersections(spark.createDataFrame(rows, "k long, g string"), ["k"], "g", groups).collect()}
    masks = Counter()
    for k in range(300):
        masks[sum(1 << groups.index(g) for q, g in rows if q == k)] += 1
    assert len(got) == 2**16 - 1
    for mask in [1, 2**16 - 1, *(r.randrange(1, 2**16) for _ in range(300))]:
        assert got[mask] == sum(n for m, n in masks.items() if m & mask == mask)


def test_substrings_over_chunks(spark):
    r = random.Random(5)
    seqs = {c: "".join(r.choice("ACGT") for _ in range(n)) for c, n in (("a", 1000), ("b", 37), ("c", 0))}
    rows = [(i, r.choice("abcd"), s := r.randrange(0, 1100), s + r.choice([0, 1, 5, 300])) for i in range(300)] + [(500, "a", 3, 9), (500, "a", 3, 9)]
    got = I.interval_substring(spark.createDataFrame(rows, "i int, c string, start int, stop int"), spark.createDataFrame(list(seqs.items()), "c string, seq string"), "c", chunk=16).collect()
    assert sorted((x.i, x.c, x.start, x.stop, x.fragment) for x in got) == sorted((*x, seqs[x[1]][x[2] : x[3]]) for x in rows if x[1] in seqs)


def test_subset_intersections(spark):
    r = random.Random(3)
    rows = [(i, g) for i in range(50) for g in "abcd" if r.random() < 0.5]
    got = {x.groups: x.n for x in I.subset_intersections(spark.createDataFrame(rows, "k long, g string"), ["k"], "g", list("abcd")).collect()}
    by = {i: {g for k, g in rows if k == i} for i in range(50)}
    assert len(got) == 15
    for names, n in got.items():
        assert n == sum(set(names.split(",")) <= s for s in by.values())


def test_overlap_join(spark):
    a, b = some(40, 7), some(40, 8)
    fa = spark.createDataFrame(a, "chrom string, i long, s1 long, e1 long")
    fb = spark.createDataFrame(b, "chrom string, j long, s2 long, e2 long")
    got = sorted((r.i, r.j) for r in I.overlap_join(fa, fb, "chrom", 8, ("s1", "e1", "s2", "e2")).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])


def test_rows_collapse_without_a_row_for_each_bin(spark, data):
    df = spark.createDataFrame([(1, 10, 160), (1, 300, 310), (2, 5, 5), (None, 7, 60)], "k int, start long, stop long")
    rows = I.collapse(I.bin_intervals(df, explode=False).drop("start", "stop"), ["k"], keep_rows=True)
    assert sorted(((r.k, r.start, r.stop) for r in rows.collect()), key=str) == sorted([(1, 0, 350), (1, 0, 350), (None, 0, 100)], key=str)
    each = I.collapse(I.bin_intervals(df).drop("start", "stop"), ["k"])
    assert sorted(each.collect(), key=str) == sorted(I.collapse(I.bin_intervals(df, explode=False).drop("start", "stop"), ["k"]).collect(), key=str)
    plan = plans.QUERIES["collapse_on_rows"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_mask_regions_against_sets_of_bins(spark):
    r = np.random.default_rng(8)
    rows = [(int(k), int(g), int(s), int(s + n)) for k, g, s, n in zip(r.integers(0, 3, 300), r.choice([0, 3, 61], 300), r.integers(-4000, 4000, 300), r.integers(0, 40, 300))]
    rows += [(9, 0, -1000, 1001), (9, 61, 295, 300), (9, 61, 300, 301), (9, 3, 5, 5), (None, 3, 0, 1)]  # long, at a border, empty, without key
    got = I.mask_regions(spark.createDataFrame(rows, "k long, at int, start long, stop long").repartition(5), "k", "at", 5)
    bins = {}
    for k, g, s, e in rows:
        for b in range(s // 5, -(-e // 5) if e > s else s // 5):
            bins[k, b] = bins.get((k, b), 0) | 1 << g
    want = []
    for (k, b), m in sorted(bins.items(), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1])):
        if want and want[-1][:2] == (k, m) and want[-1][3] == b * 5:
            want[-1] = (k, m, want[-1][2], b * 5 + 5)
        else:
            want.append((k, m, b * 5, b * 5 + 5))
    assert Counter(map(tuple, got.select("k", "mask", "start", "stop").collect())) == Counter(want)
    # an interval is a row for each stretch of bins, not for each bin
    from jobs import region_atlas

    iv = spark.createDataFrame([("x", "a", 0, 6 * 10**7)], "key string, group string, start long, stop long")
    (only,) = region_atlas.masks_of(iv, ["a"], 5).collect()
    assert tuple(only) == ("x", 1, 0, 6 * 10**7)
