import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrine.operators import sampling as sa


def serial_balanced(sizes, target):
    live = [g for g, n in sizes.items() if n > 0]
    q = dict.fromkeys(sizes, 0)
    if target >= sum(sizes.values()):
        return dict(sizes)
    for g in live:
        q[g] = min(sizes[g], target // len(live))
    while sum(q.values()) < target:
        for g in sorted(live, key=lambda g: (-(sizes[g] - q[g]), g)):
            if q[g] < sizes[g] and sum(q.values()) < target:
                q[g] += 1
    return q


@pytest.mark.parametrize("target", [0, 1, 7, 20, 33, 60, 100])
def test_balanced_quotas(spark, target):
    sizes = {"a": 30, "b": 2, "c": 11, "d": 0, "e": 17}
    got = sa.balanced_quotas(spark.createDataFrame(list(sizes.items()), "group string, count long"), target)
    assert {r.group: r.quota for r in got.collect()} == serial_balanced(sizes, target)


@pytest.mark.parametrize("target", [1, 7, 20, 60])
def test_proportional_quotas(spark, target):
    sizes = {"a": 30, "b": 2, "c": 11, "e": 17}
    q = {r.group: r.quota for r in sa.proportional_quotas(spark.createDataFrame(list(sizes.items()), "group string, count long"), target).collect()}
    assert sum(q.values()) == target and all(0 <= q[g] <= sizes[g] and abs(q[g] - sizes[g] * target / 60) < 1 for g in q)


@pytest.mark.parametrize(("n", "target", "strata"), [(4, 9, 3), (50, 9, 3), (50, 10, 3), (23, 7, 4), (11, 10, 3), (5, 4, 7), (40, 1, 3)])
def test_stratified_pick(spark, n, target, strata):
    dist = np.random.default_rng(n).random(n)
    d = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(dist)], "g int, r long, d double")
    got = sorted(r.r for r in sa.stratified_pick(d, "g", "r", "d", target, strata).collect())
    order = np.argsort(dist, kind="stable")
    want = set()
    if n <= target:
        want = set(range(n))
    else:
        s = min(strata, n)
        for b, part in enumerate(np.array_split(order, s)):
            q = target // s + (b < target % s)
            if q:
                want |= set(map(int, part if len(part) <= q else part[np.linspace(0, len(part) - 1, q, dtype=np.int32)]))
    assert got == sorted(want)


def test_unit_hash(spark):
    ids = [f"q{i}" for i in range(50)]
    got = {r.i: r.h for r in spark.createDataFrame([(i,) for i in ids], "i string").select("i", sa.unit_hash(F.col("i")).alias("h")).collect()}
    assert got == {i: int(hashlib.sha256(i.encode()).hexdigest()[:16], 16) / 2**64 for i in ids}


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_split_is_whole_and_disjoint(spark, n):
    d = spark.createDataFrame([(f"q{i}",) for i in range(n)] * 2 + [(None,)], "k string")
    got = sa.split_rows(d, F.col("k"), 0.3, 2, 2, 7).toPandas()
    assert len(got) == n and set(got.role) <= {"calibration", "evaluation"}
    if n == 40:
        assert (got.role == "calibration").sum() == 12


@pytest.mark.parametrize("size", [0, 3, 5, 9, 20])
def test_prefix_for_size(spark, size):
    core = [2, 4, 5, 11]
    got = sa.prefix_for_size(spark.createDataFrame([(c,) for c in core], "offset long"), size).first().prefix_end
    if size >= len(core):
        want = next(p for p in range(100) if len(set(range(p)) | set(core)) >= size)
        assert (got or 0) == want


def test_ranges_and_aliases(spark):
    d = spark.createDataFrame([("s", x) for x in (1, 2, 4, 9, 10, 30)], "g string, r long")
    got = sa.merge_ranges(d, "g", "r", 2).toPandas()
    assert sorted(zip(got["first"], got["last"], got["rows"])) == [(1, 4, 3), (9, 10, 2), (30, 30, 1)]
    a = spark.createDataFrame([("d7",), ("D7",), ("7",), (" x ",), ("",)], "i string")
    assert [r.a for r in a.select(sa.id_aliases(F.col("i")).alias("a")).collect()] == [["d7", "7"], ["D7", "7", "d7"], ["7", "d7"], ["x"], []]


def test_terciles_of_few_rows(spark):
    d = spark.createDataFrame([(1, 0.1), (2, 0.2)], "i int, s double")
    assert {r.difficulty for r in sa.terciles(d, "s").collect()} == {"mid"}


def test_fingerprint_changes_with_order(spark):
    f = lambda rows: sa.fingerprint(spark.createDataFrame(rows, "k string, o long"), F.col("k"), F.col("o")).first().sha256
    assert f([("a", 0), ("b", 1)]) == f([("b", 1), ("a", 0)]) != f([("a", 1), ("b", 0)])


def test_places_and_quantiles_without_a_global_sort(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.round(rng.standard_normal(500), 3), np.full(200, 0.25), [1e9, -1e9]])
    d = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(5)
    s = np.sort(x)
    ranks = [0, 1, 250, 400, 500, 700, len(x) - 1]
    assert sa.at_ranks(d, "v", ranks, most=20, bins=16) == [s[r] for r in ranks]
    assert sa.quantiles(d, "v", (0.0, 1 / 3, 0.5, 0.95, 1.0)) == pytest.approx(list(np.quantile(x, (0.0, 1 / 3, 0.5, 0.95, 1.0))))
    assert sa.quantiles(d.filter("v is null"), "v", (0.5,)) == [None]


def test_global_index(spark):
    rows = [(i * 37 % 101, i % 3) for i in range(101)]
    d = spark.createDataFrame(rows, "a long, b int").repartition(6)
    got = [(r.b, r.a) for r in sa.global_index(d, F.desc("b"), "a").orderBy("index").collect()]
    assert got == sorted(((b, a) for a, b in rows), key=lambda x: (-x[0], x[1]))
    assert sa.global_index(d.filter("a < 0"), "a").count() == 0


@pytest.mark.parametrize("core,size", [([0, 1, 2, 9], 7), ([5, 6, 7], 3), ([], 4), ([100, 200], 50), ([3], 1)])
def test_prefix_for_size(spark, core, size):
    c = spark.createDataFrame([(o,) for o in core + core[:1]], "offset long")
    want = next(p for p in range(1000) if len(set(range(p)) | set(core)) >= size)
    assert sa.prefix_for_size(c, size).first()[0] == want
