import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrine.llm.capping import cap_per_contributor, contributor_key


def serial(rows, cap):
    best = {}
    for c, r, q in rows:
        if r is not None:
            q = None if q is None or np.isnan(q) else q
            old = best.get((c, r))
            best[c, r] = q if old is None else old if q is None else max(q, old)
    out = {}
    for (c, r), q in best.items():
        out.setdefault(c, []).append((q is None, -(q or 0), r))
    kept = set()
    for c, v in out.items():
        kept |= {(c, x[2]) for x in (sorted(v) if c is None else sorted(v)[:cap])}
    return kept, set(best) - kept


def run(spark, rows, **how):
    d = spark.createDataFrame(rows, "source string, rec long, q double").withColumns({"salt": F.lit("x"), "rank": F.lit(1), "contributor": F.lit("clash"), "pre": F.lit(0)})
    got = cap_per_contributor(d, F.col("source"), F.col("rec"), F.col("q"), **how).toPandas().astype(object)
    pairs = [(None if c is None else c, r, bool(k)) for c, r, k in zip(got.contributor, got.record, got.kept)]
    assert len(pairs) == len({p[:2] for p in pairs})
    return {p[:2] for p in pairs if p[2]}, {p[:2] for p in pairs if not p[2]}


@pytest.mark.parametrize("cap", [1, 3, 10])
def test_equals_the_serial_cap_with_a_dominant_contributor(spark, rng, cap):
    rows = [("hot" if rng.random() < 0.5 else f"s{rng.integers(20)}", int(i), [None, float("nan"), 0.5, 0.5, float(rng.random())][rng.integers(5)]) for i in range(600)]
    rows += rows[:40] + [(None, 10_001, 0.1), (None, 10_002, 0.2), ("hot", None, 1.0)]
    assert run(spark, rows, max_count=cap) == serial(rows, cap)


def test_share_and_empty_table(spark):
    rows = [("a", i, 0.0) for i in range(8)] + [("b", 9, 0.0), ("c", 10, 0.0)]
    kept, lost = run(spark, rows, max_share=0.3)
    assert {r for c, r in kept if c == "a"} == {0, 1, 2} and len(lost) == 5
    assert run(spark, [], max_count=3) == (set(), set())
    with pytest.raises(ValueError):
        run(spark, rows)


@pytest.mark.parametrize("cap", [1, 50, 250])
def test_ranks_over_ranges(spark, rng, cap):
    """A contributor with a third of the rows and more, and a cap that keeps much of it."""
    rows = [("hot" if rng.random() < 0.5 else f"s{rng.integers(5)}", int(i), [None, 0.5, 0.5, float(rng.random())][rng.integers(4)]) for i in range(800)] + [(None, 9000, 0.5)]
    assert run(spark, rows + rows[:50], max_count=cap, task_rows=0) == serial(rows, cap)
    kept, _ = run(spark, rows, max_share=0.25, task_rows=0)
    assert sum(c == "hot" for c, _ in kept) == min(200, sum(r[0] == "hot" for r in rows))


def test_spellings_of_a_source(spark):
    rows = [(" d7\t", "x"), ("7", "x"), ("D7", "x"), (None, "D7::p3"), ("", "7::p1"), (None, "u1"), (None, None), (" D7 ", None)]
    d = spark.createDataFrame(rows, "s string, d string")
    assert [r.k for r in d.select(contributor_key(F.col("s"), F.col("d")).alias("k")).collect()] == ["D7"] * 5 + [None, None, "D7"]
