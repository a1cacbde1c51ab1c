import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrine.llm.varied_subset import SubsetConfig, quotas, varied_subset


def test_quotas_are_used_up_and_never_exceed_sizes(rng):
    for kind in ("sqrt", "equal"):
        for _ in range(200):
            sizes = rng.integers(0, 50, rng.integers(1, 12))
            target = int(rng.integers(0, sizes.sum() + 5))
            q = quotas(sizes, target, kind)
            assert q.sum() == min(target, sizes.sum()) and (q <= sizes).all() and (q >= 0).all()
    assert quotas([100, 100, 1], 21, "equal").tolist() == [10, 10, 1]


def test_small_groups_and_strays_are_covered_and_copies_are_not_repeated(spark, vectors, rng):
    c = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    rows, n = [], 0
    for g, size in enumerate((900, 60, 12)):
        for _ in range(size):
            rows.append((n, c[g] + 0.08 * rng.standard_normal(64)))
            n += 1
    clump = c[0] + 0.08 * rng.standard_normal(64)
    rows += [(n + i, clump * (1 + i % 3)) for i in range(400)]  # a third of all rows is one vector
    n += 400
    stray = list(range(n, n + 6))
    rows += [(i, c[20 + k]) for k, i in enumerate(stray)]
    got = varied_subset(vectors(rows), F.col("id"), F.col("v"), count=70, cfg=SubsetConfig(clusters=6, stray=0.45)).toPandas()
    assert len(got) == 70 and got.id.is_unique
    ids = set(got.id)
    # their shares by size would be 0.6 and 3; square roots give about 2.5 and 6
    assert len(ids & set(range(960, 972))) >= 2 and len(ids & set(range(900, 960))) >= 5
    assert len(ids & set(range(972, 1372))) <= 6
    assert len(ids & set(stray)) >= 3


def test_unusable_repeated_and_missing_rows(spark, vectors):
    good = [(i, np.eye(64)[i % 5]) for i in range(10)]
    bad = [(20, None), (21, np.zeros(64)), (22, np.ones(3)), (23, [float("nan")] * 64), (24, [None] * 64), (None, np.ones(64))]
    got = varied_subset(vectors(good + good + bad), F.col("id"), F.col("v"), count=50).toPandas()
    assert sorted(got.id) == list(range(10))
    assert varied_subset(vectors([]), F.col("id"), F.col("v"), share=0.5).count() == 0
    assert varied_subset(vectors(bad), F.col("id"), F.col("v"), share=0.5).count() == 0
    a = varied_subset(vectors(good), F.col("id"), F.col("v"), share=0.35).toPandas()
    assert len(a) == 4 and sorted(a.id) == sorted(varied_subset(vectors(good).repartition(7), F.col("id"), F.col("v"), share=0.35).toPandas().id)


@pytest.mark.parametrize("kind", ["sqrt", "equal"])
def test_both_kinds(spark, vectors, rng, kind):
    rows = [(i, rng.standard_normal(64)) for i in range(100)]
    assert varied_subset(vectors(rows), F.col("id"), F.col("v"), share=0.1, cfg=SubsetConfig(quota=kind)).count() == 10
