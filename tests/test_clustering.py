import numpy as np
import pytest

from vectrine.operators import clustering as cl

RNG = np.random.default_rng(3)


def serial_margin(cost, capacity):
    n, k = cost.shape
    pref = np.argsort(cost, axis=1, kind="stable")
    best = cost[np.arange(n), pref[:, 0]]
    margin = np.round(cost[np.arange(n), pref[:, 1]] - best, 9)
    room, out = [capacity] * k, {}
    for i in sorted(range(n), key=lambda i: (-margin[i], best[i], i)):
        for c in pref[i]:
            if room[c]:
                room[c] -= 1
                out[i] = int(c)
                break
    return out


def serial_repair(cost, labels, capacity):
    n, k = cost.shape
    now, moved = list(labels), set()
    for delta, i, dst in sorted((round(cost[i, d] - cost[i, labels[i]], 9), i, d) for i in range(n) for d in range(k) if d != labels[i]):
        size = np.bincount(now, minlength=k)
        if i not in moved and size[now[i]] > capacity and size[dst] < capacity:
            now[i] = dst
            moved.add(i)
    return dict(enumerate(map(int, now)))


def frame(spark, cost):
    return spark.createDataFrame([(i, c, float(x)) for i, r in enumerate(cost) for c, x in enumerate(r)], "doc_idx long, cluster_id int, cost double")


@pytest.mark.parametrize("ties", [False, True])
def test_balanced_assignment_equals_the_serial_order(spark, ties):
    cost = RNG.integers(1, 5, (24, 4)).astype(float) if ties else np.round(RNG.random((24, 4)), 6)
    got = {r.doc_idx: r.cluster_id for r in cl.balanced_assignment(frame(spark, cost), 6).collect()}
    assert got == serial_margin(cost, 6)


def test_places_in_narrow_bins_and_few_choices(spark, monkeypatch):
    """Bins of few places are refined, and a document whose first choices are full ranks more."""
    monkeypatch.setattr(cl, "PLACE_BINS", 3)
    monkeypatch.setattr(cl, "FIRST_CHOICES", 1)
    cost = np.round(RNG.random((40, 5)), 6)
    got = {r.doc_idx: r.cluster_id for r in cl.balanced_assignment(frame(spark, cost), 8).collect()}
    assert got == serial_margin(cost, 8)
    x, c = RNG.standard_normal((30, 4)), RNG.standard_normal((5, 4))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_idx long, v array<double>")
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster_id long, center array<double>")
    got = {r.doc_idx: r.cluster_id for r in cl.balanced_partition(d, t, 6).collect()}
    assert sorted(np.bincount(list(got.values()))) == [6] * 5
    monkeypatch.setattr(cl, "FIRST_CHOICES", 5)
    want = serial_margin(np.round(np.linalg.norm(x[:, None] - c[None], axis=2), 9), 6)
    assert {r.doc_idx: r.cluster_id for r in cl.balanced_partition(d, t, 6).collect()} == want


@pytest.mark.parametrize("ties", [False, True])
def test_capacity_repair_equals_the_heap_order(spark, ties):
    cost = RNG.integers(1, 5, (20, 4)).astype(float) if ties else np.round(RNG.random((20, 4)), 6)
    cost[:, 0] -= 0.3
    labels = cost.argmin(1)
    start = spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "doc_idx long, cluster_id int")
    got = {r.doc_idx: r.cluster_id for r in cl.capacity_repair(frame(spark, cost), start, 5).collect()}
    assert got == serial_repair(cost, labels, 5)


def test_spherical_kmeans_separates_groups(spark):
    c = np.eye(8)[:3]
    x = np.concatenate([c[i] + 0.05 * RNG.standard_normal((20, 8)) for i in range(3)])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_idx long, v array<double>")
    for seed in range(20):
        got = [r.cluster_id for r in cl.spherical_kmeans(d, 3, seed, 8).orderBy("doc_idx").collect()]
        if all(len(set(got[i * 20 : i * 20 + 20])) == 1 for i in range(3)) and len(set(got)) == 3:
            break
    else:
        raise AssertionError("no seed found the groups")


def test_surrogate_falls_back_to_the_overall_quantile(spark):
    routed = spark.createDataFrame([(1, 0), (2, 0)], "query_id long, cluster_id int")
    ideal = spark.createDataFrame([(1, 0.1), (2, 0.3)], "query_id long, ideal_r_max double")
    clusters = spark.createDataFrame([(0,), (1,)], "cluster_id int")
    got = {r.cluster_id: (r.anchors, r.raw, r.r_max) for r in cl.r_max_surrogate(routed, ideal, clusters).collect()}
    assert got[0] == (2, 0.12, 0.12) and got[1] == (0, 0.12, 0.12)
    low = {r.cluster_id: r.r_max for r in cl.r_max_surrogate(routed, ideal, clusters, normal_min=3, soft_min=1).collect()}
    assert low == {0: 0.06, 1: 0.0}


def test_violations_of_a_partition(spark):
    docs = spark.range(4).withColumnRenamed("id", "doc_idx")
    a = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (9, 1)], "doc_idx long, cluster_id int")
    c = spark.createDataFrame([(0, 0.1, 0.2, 0.1), (1, 0.3, 0.2, None), (2, 0.1, 0.2, 0.0)], "cluster_id int, r_k double, r_fixed double, r_max double")
    got = {(r.rule, r.cluster_id, r.detail) for r in cl.contract_violations(docs, a, c, 2).collect()}
    assert got == {("unassigned", None, "2"), ("unassigned", None, "3"), ("assigned_twice", 0, "1"), ("unknown_doc", 1, "9"), ("empty_cluster", 2, "0"), ("bad_radius", 1, None), ("radii_out_of_order", 1, "0.2")}


def brute_j(x, labels, source, simhash, core):
    names = sorted(set(labels))
    rows, centers = [], []
    for c in names:
        at = [i for i, y in enumerate(labels) if y == c]
        center = x[at].mean(0)
        center /= np.linalg.norm(center)
        d = np.sort(np.round(np.linalg.norm(x[at] - center, axis=1), 9))
        near, far, n = np.percentile(d[:core], 95), np.percentile(d, 95), len(at)
        count = lambda v: np.unique([v[i] for i in at], return_counts=True)[1]
        k = count([h >> 48 for h in simhash])
        rows.append([near, max(far - near, 0), count(source).max() / n, (k * (k - 1) / 2).sum() / (n * (n - 1) / 2)])
        centers.append(center)
    m, s = np.mean(rows, 0), np.mean([np.linalg.norm(a - b) for i, a in enumerate(centers) for b in centers[i + 1 :]])
    return (s / (1 + s) + 1 / (1 + m[0]) + 1 / (1 + m[1]) + 1 - m[2] + 1 - m[3]) / 5, dict(zip(names, centers))


def test_swaps_are_the_first_that_gain(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((18, 6))
    labels, source, simhash = [i % 3 for i in range(18)], [f"s{i % 4}" for i in range(18)], [int(i % 5) << 48 for i in range(18)]
    d = spark.createDataFrame([(i, v.tolist(), source[i], simhash[i]) for i, v in enumerate(x)], "doc_idx long, v array<double>, source string, simhash long")
    got, history = cl.refine_by_swaps(d, spark.createDataFrame(list(enumerate(labels)), "doc_idx long, cluster_id long"), 3, 2, boundary=3)
    want = list(labels)
    j, centers = brute_j(x, want, source, simhash, 3)
    steps = [j]
    for _ in range(2):
        edge = {c: sorted((i for i, y in enumerate(want) if y == c), key=lambda i: (-round(float(np.linalg.norm(x[i] - centers[c])), 9), i))[:3] for c in centers}
        for a, b, i, k in ((a, b, i, k) for a in range(3) for b in range(a + 1, 3) for i in edge[a] for k in edge[b]):
            trial = list(want)
            trial[i], trial[k] = b, a
            new, c = brute_j(x, trial, source, simhash, 3)
            if new > steps[-1] + 1e-9:
                want, centers = trial, c
                steps.append(new)
                break
    assert {r.doc_idx: r.cluster_id for r in got.collect()} == dict(enumerate(want)) and history == pytest.approx(steps) and len(steps) > 1


def test_partitions_need_clusters_times_capacity(spark):
    cost = frame(spark, RNG.random((7, 2)))
    with pytest.raises(ValueError):
        cl.balanced_assignment(cost, 3)
    with pytest.raises(ValueError):
        cl.capacity_repair(cost, spark.createDataFrame([(i, 0) for i in range(7)], "doc_idx long, cluster_id int"), 4)


def test_seeds_are_spread(spark):
    x = np.concatenate([np.eye(6)[i] + 0.01 * RNG.standard_normal((30, 6)) for i in range(6)])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_idx long, v array<double>")
    s = cl.seed_centers(d, 6, 4, 6)
    assert s.shape == (6, 6) and len(set(s.argmax(1))) == 6
    assert len(cl.seed_centers(d.limit(2), 5, 4, 6)) == 2
    got = [r.cluster_id for r in cl.spherical_kmeans(d, 6, 4, 6).orderBy("doc_idx").collect()]
    assert all(len(set(got[i * 30 : i * 30 + 30])) == 1 for i in range(6)) and len(set(got)) == 6


def test_a_sweep_computes_its_documents_once(spark):
    """Rounds of all seeds read one table: what makes the documents runs once, and each seed settles as it does alone."""
    x = RNG.standard_normal((24, 6))
    d = spark.createDataFrame([(i, v.tolist(), f"s{i % 3}", int(i % 5) << 48) for i, v in enumerate(x)], "doc_idx long, v array<double>, source string, simhash long")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = cl.seed_sweep(d.mapInArrow(counted, d.schema), 3, range(2), 6, 4).collect()
    assert seen.value == 24
    assert sorted(r.seed for r in got) == [0, 1] and sum(r.best for r in got) == 1
    rows = d.select("doc_idx", "v").coalesce(1)
    both = cl.settled_centers(rows, 3, [0, 1], 6)
    for s in (0, 1):
        assert np.array_equal(both[s], cl.settled_centers(rows, 3, [s], 6)[s])
    assert not np.allclose(both[0], both[1])
