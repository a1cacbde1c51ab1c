import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrine.llm.packing import PackConfig, fill_containers, nnls, plan


def test_nnls_against_the_conditions_of_the_optimum(rng):
    for _ in range(20):
        a, b = rng.random((8, 15)), rng.standard_normal(8)
        x = nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g <= 1e-6).all() and np.abs(g[x > 1e-9]).max(initial=0) < 1e-6


def run(spark, sizes, cfg=PackConfig()):
    d = spark.createDataFrame([(i, None if s is None else int(s)) for i, s in sizes], "doc long, n long").withColumns({"size": F.lit(1), "salt": F.lit(0), "at": F.lit(0)})
    return fill_containers(d, F.col("doc"), F.col("n"), cfg).toPandas()


@pytest.mark.parametrize("kind", ["skewed", "large", "equal", "mixed"])
def test_containers_hold_everything_and_waste_little(spark, rng, kind):
    n = 1500
    s = {"skewed": np.minimum(6000, rng.lognormal(5.3, 1.2, n)), "large": rng.integers(600, 1400, n), "equal": np.full(n, 700), "mixed": np.where(rng.random(n) < 0.34, 300, rng.integers(0, 3000, n))}[kind].astype(int)
    got = run(spark, list(enumerate(s)))
    per = got.groupby("container")["size"].sum()
    assert per.max() <= 2048 and got.groupby("id")["size"].sum().reindex(range(n)).tolist() == s.tolist()
    assert (got[got.id.isin(np.flatnonzero(s <= 2048))].piece_no == 0).all()
    assert sorted(set(got.container)) == list(range(got.container.max() + 1))
    for i, g in got[got.id.isin(np.flatnonzero(s > 2048)[:20])].groupby("id"):
        g = g.sort_values("piece_no")
        assert g.start.tolist() == (np.arange(len(g)) * 2048).tolist() and (g["size"].iloc[:-1] == 2048).all()
    used = s.sum() / 2048 / len(per)
    assert used > {"skewed": 0.99, "large": 0.85, "equal": 0.67, "mixed": 0.97}[kind]


def test_odd_rows(spark):
    got = run(spark, [(1, None), (2, -5), (3, 0), (4, 2048), (4, 2048), (5, 4096), (None, 10)])
    assert got.groupby("container")["size"].sum().max() <= 2048 and len(got) == 8
    assert len(run(spark, [])) == 0
    assert run(spark, [(1, 0), (2, None)]).container.tolist() == [0, 0]


def test_the_plan_places_each_position_once(rng):
    counts = np.zeros(2049, int)
    counts[1:] = rng.integers(0, 5, 2048)
    p = plan(counts, PackConfig())
    seen = np.zeros(2049, int)
    for s, first, items, _, _ in sorted(p.segments):
        assert first == seen[s]
        seen[s] += items
    assert (seen == counts).all()
