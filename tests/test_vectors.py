import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrine.functions import vectors as ve
from vectrine.operators import crypto, knn, metrics, preparation, privacy, routing
from vectrine.plans import queries

RNG = np.random.default_rng(5)


def table(spark, rows, names="doc_idx long, v array<double>"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], names)


def brute(docs, queries, k):
    out = []
    for q, x in queries:
        t = sorted((round(math.acos(max(-1, min(1, round(float(np.dot(x, v)) / (np.linalg.norm(x) * np.linalg.norm(v)), 12)))), 9), i) for i, v in docs)
        out += [(q, r + 1, i, a) for r, (a, i) in enumerate(t[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [65536, 4])
def test_exact_knn_with_ties_repeats_and_unusable_rows(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "QUERY_BLOCK", block)
    docs = [(i, RNG.standard_normal(8)) for i in range(60)]
    docs += [(100 + i, docs[3][1] * (i + 1)) for i in range(5)]
    queries = [(i, RNG.standard_normal(8)) for i in range(9)] + [(50, docs[3][1])]
    bad = [(900, None), (901, [0] * 8), (902, [1, 2]), (903, [float("nan")] * 8)]
    d, q = table(spark, docs + docs[:10] + bad).repartition(3), table(spark, queries + bad, "query_id long, qv array<double>")
    got = knn.exact_knn(d, F.col("doc_idx"), F.col("v"), q, F.col("query_id"), F.col("qv"), 7, 8)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, queries, 7)


def test_knn_of_few_or_no_documents(spark):
    q = table(spark, [(1, [1, 0])], "query_id long, qv array<double>")
    got = knn.exact_knn(table(spark, [(5, [1, 0])]), F.col("doc_idx"), F.col("v"), q, F.col("query_id"), F.col("qv"), 3, 2)
    assert [tuple(r) for r in got.collect()] == [(1, 1, 5, 0.0)]
    assert knn.exact_knn(table(spark, []), F.col("doc_idx"), F.col("v"), q, F.col("query_id"), F.col("qv"), 3, 2).count() == 0


def test_plan_limits_the_ranking_before_the_shuffle(spark):
    d, q = table(spark, [(i, RNG.standard_normal(4)) for i in range(20)]), table(spark, [(1, [1, 0, 0, 0])], "query_id long, qv array<double>")
    plan = knn.exact_knn(d, F.col("doc_idx"), F.col("v"), q, F.col("query_id"), F.col("qv"), 3, 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize(("keep", "metric", "block"), [(None, "theta", 65536), (2, "theta", 65536), (2, "l2", 2), (None, "l2", 65536)])
def test_against_centers(spark, monkeypatch, keep, metric, block):
    monkeypatch.setattr(knn, "CENTER_BLOCK", block)
    rows, cs = [(i, RNG.standard_normal(5)) for i in range(12)], [(i, RNG.standard_normal(5)) for i in range(5)]
    got = knn.against_centers(table(spark, rows), F.col("doc_idx"), F.col("v"), table(spark, cs, "cluster_id long, center array<double>"), keep, metric)
    want = set()
    for i, v in rows:
        f = (lambda c: round(float(np.linalg.norm(v - c)), 9)) if metric == "l2" else (lambda c: brute([(0, c)], [(0, v)], 1)[0][3])
        order = sorted((f(c), j) for j, c in cs)
        want |= {(i, j, r + 1, x) for r, (x, j) in enumerate(order[: keep or len(cs)])}
    assert {(r.id, r.cluster_id, r.rank, r.value) for r in got.collect()} == want


def test_vector_expressions(spark):
    d = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = d.select(ve.norm(F.col("a")).alias("n"), ve.cosine(F.col("a"), F.col("b")).alias("c"), ve.cosine(F.col("a"), F.col("z")).alias("cz"), ve.l2(F.col("a"), F.col("b")).alias("l"), ve.normalize(F.col("z")).alias("nz"), ve.theta(F.col("a"), F.col("a")).alias("t")).first()
    assert (r.n, round(r.c, 12), r.cz, r.nz, r.t) == (5.0, 0.96, None, [0.0, 0.0], 0.0) and abs(r.l - math.sqrt(2)) < 1e-12
    q = spark.createDataFrame([([-1.0, 0.0, 1.0],)], "v array<double>").select(ve.quantize_byte(F.col("v")).alias("b"), ve.fixed_point(F.col("v"), 5000).alias("f")).first()
    assert q.b == [0, 128, 255] and q.f == [-5000, 0, 5000]


def test_epsilon_is_clipped_only_between_good_bounds(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(5.0, 1.0, 3.0), (0.5, 1.0, 3.0), (2.0, 1.0, 3.0), (5.0, 3.0, 1.0), (5.0, 0.0, 3.0), (5.0, -1.0, 3.0), (5.0, 1.0, inf), (5.0, nan, 3.0), (5.0, None, 3.0)]
    d = spark.createDataFrame(rows, "e double, lo double, hi double")
    assert [r.x for r in d.select(routing.clip_epsilon(F.col("e"), F.col("lo"), F.col("hi")).alias("x")).collect()] == [3.0, 1.0, 2.0] + [5.0] * 6


def test_gap_ladder(spark):
    rows = [(1, c, t, r) for r, (c, t) in enumerate([(4, 0.1), (2, 0.12), (0, 0.15), (1, 0.5)], 1)]
    d = spark.createDataFrame(rows, "query_id long, cluster_id long, theta double, rank int")
    ids = lambda x: [r.cluster_id for r in x.orderBy("rank").collect()]
    assert ids(routing.route_gap_ladder(d, 0.03)) == [4, 2]
    assert ids(routing.route_gap_ladder(d, 0.03, 0.06)) == [4, 2, 0]
    assert ids(routing.route_gap_ladder(d, 0.03, 0.06, 0.5)) == [4, 2, 0, 1]
    assert ids(routing.route_gap_ladder(d, 0.01, 1.0, 1.0)) == [4]
    assert ids(routing.route_boundary(d, 0.03, 3)) == [4, 2, 0] and ids(routing.route_boundary(d, 0.01, 3)) == [4]


def test_noise(spark):
    rng = privacy.stream(1, "q")
    r = [privacy.chi_radius(0.5, 16, rng) for _ in range(3000)]
    assert abs(np.mean(np.square(r)) - 0.25 * 16) < 0.15
    held = [privacy.chi_radius(0.5, 16, rng, 2.0, 2.2) for _ in range(200)]
    assert 2.0 <= min(held) and max(held) <= 2.2
    assert privacy.chi_radius(0.5, 16, rng, 2.0, 2.0) == 2.0
    with pytest.raises(ValueError):
        privacy.chi_radius(0.5, 16, rng, 2.0, 1.0)
    q = spark.createDataFrame([(i, [float(x) for x in RNG.standard_normal(16)], 9.0) for i in range(30)], "query_id long, qv array<double>, r_max double")
    one = {r.query_id: r for r in privacy.perturb_rdp(q, 2.0, 4.0, 16).collect()}
    two = {r.query_id: r for r in privacy.perturb_rdp(q.repartition(5), 2.0, 4.0, 16).collect()}
    for i, v in [(r.query_id, r.qv) for r in q.collect()]:
        move = np.linalg.norm(np.array(one[i].perturbed) - v)
        assert abs(move - one[i].radius) < 1e-5 and 2.0 <= one[i].radius <= 9.0 and one[i] == two[i]
        assert abs(one[i].delta_alpha - math.atan(one[i].radius / np.linalg.norm(v))) < 1e-6
    still = privacy.perturb_rdp(q, 2.0, 4.0, 16, forced_radius=0.0).collect()
    assert all(r.radius == 0 for r in still)
    clipped = privacy.perturb_rdp(q, 2.0, 4.0, 16, forced_radius=20.0, clip_forced=True).collect()
    assert all(r.radius == 9.0 for r in clipped)
    g = [r.radius for r in privacy.perturb_distance(q, 8.0, 16).collect()]
    assert 1.2 < np.mean(g) < 2.8


def test_candidates_of_a_perturbed_query(spark):
    s = spark.createDataFrame([(1, r, r, 0.1 * r) for r in range(1, 11)], "query_id long, doc_idx long, rank int, theta double")
    n = lambda shift, **k: privacy.distance_candidates(s, spark.createDataFrame([(1, shift)], "query_id long, delta_alpha double"), 3, **k).count()
    assert (n(0.0), n(0.2), n(5.0), n(5.0, cap=7)) == (3, 5, 10, 7)


@pytest.fixture
def tied(tmp_path, spark):
    """Tables of 400 vectors, a third of which equal the query's."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((400, 64))
    v[1:134] = v[0]
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_more_ties_at_the_kth_place_than_places(spark, tied):
    got = queries.QUERIES["relaxed_positives"](spark, tied).collect()
    assert len({r.doc_idx for r in got if r.query_id == 0}) == len([r for r in got if r.query_id == 0]) == 134


def test_more_candidates_than_a_hundred(spark, tied):
    got = [r.doc_idx for r in queries._distance_candidates(spark, tied)[0].collect() if r.query_id == 0]
    assert len(got) == len(set(got)) and set(got) >= set(range(134))


def test_transfer_of_whole_texts(spark, tied):
    """Document 3 has no row, 4 a null text."""
    texts = [(i, None if i == 4 else "é" * 500) for i in range(400) if i != 3]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tied}/documents.parquet")
    got = {r.query_id: r for r in queries.QUERIES["oblivious_transfer"](spark, tied).collect()}
    assert got[0].received == 5 and 8 * 1000 < got[0].payload_bytes < 8 * 1000 + 10 * 40


def test_encrypted_and_plain_integers_rank_alike(spark, tied):
    """The vectors differ in length, so that the integers move documents into the top five."""
    key = lambda name: {(r.query_id, r["rank"], r.doc_idx) for r in queries.QUERIES[name](spark, tied).collect()}
    assert key("encrypted_ranking") == key("integer_ranking")


def test_quality_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10), (3, 1, 99)], "query_id long, rank int, doc_idx long")
    qrels = spark.createDataFrame([(1, 12), (1, 50), (1, 12), (3, 98)], "query_id long, doc_idx long")
    got = {r.query_id: (r.positives, r.hits, r.hit, r.recall, r.first_rank) for r in metrics.hit_and_recall(ranked, qrels, 3).collect()}
    assert got == {1: (2, 1, 1, 0.5, 3), 2: (0, 0, 0, 0.0, None), 3: (1, 0, 0, 0.0, None)}
    t = spark.createDataFrame([(1, 1, 10), (1, 2, 12)], "query_id long, rank int, doc_idx long")
    r = metrics.exact_recall(ranked, t, 2).first()
    assert (r.overlap, r.recall, r.same_order) == (2, 1.0, False)
    d = spark.createDataFrame([("1.5ms",), ("2s",), ("3us",), ("4µs",), ("5min",), ("x",)], "t string")
    assert [r.s for r in d.select(metrics.duration_seconds(F.col("t")).alias("s")).collect()] == [0.0015, 2.0, pytest.approx(3e-6), pytest.approx(4e-6), None, None]
    assert metrics.docs_touched(10**6, 300) == 640 and metrics.docs_touched(100, 300) == 100 and metrics.io_bytes(10**6, 300, 1024) == 2621440


def test_paillier_and_transfer(spark):
    import random

    k, rng = crypto.key_pair(128, 3), random.Random(1)
    for m in (0, 1, -1, 12345, -98765):
        c = k.public.encrypt(m, rng)
        assert k.decrypt(c) == m and k.decrypt(k.public.add_plain(c, 7)) == m + 7 and k.decrypt(k.public.times(c, -3)) == -3 * m and k.decrypt(k.public.add(c, c)) == 2 * m
    p = spark.createDataFrame([(1, 2, [3, 0, -2], [5, 9, 4]), (1, 3, [3, 0, -2], [-1, 1, 1])], "query_id long, doc_idx long, q array<long>, d array<long>")
    got = {r.doc_idx: r.distance for r in crypto.decrypt_scores(crypto.encrypted_scores(p, k.public, 100, 1), k, 100).collect()}
    assert got == {2: (100 - 7) / 100, 3: (100 + 5) / 100}
    t = crypto.Transfer(crypto.prime(64, rng))
    loads = [f"payload {i}".encode() for i in range(6)]
    got, sent = t.run(loads, {1, 4}, rng)
    assert got == {1: loads[1], 4: loads[4]} and sent > sum(map(len, loads))
    assert [crypto.integer_bytes(x) for x in (0, 255, 256)] == [1, 1, 2]


def test_message_sizes():
    assert preparation.message_bytes(1024, 10_000) == 4 and preparation.message_bytes(1, 2) == 2
    assert preparation.most_points(64, 1000, 8192) == 8192 // (64 + 2 * preparation.message_bytes(64, 1000))
    assert preparation.ring_degree(64, 1000, 10) == 2048 and preparation.ring_degree(64, 1000, 10**6) == 8192


def test_query_sets_are_disjoint(spark):
    rows = [(i, i % 3, bool(i % 2), True, i % 5 == 0, float(i), float(i)) for i in range(30)]
    a = spark.createDataFrame(rows, "query_id long, g int, cover_fixed_full boolean, is_real boolean, single_cluster boolean, ideal_r_max double, semantic_score double").withColumn("cover_cluster_full", F.col("cover_fixed_full"))
    s = preparation.balanced_sets(a, "g", 2, 3, 7).toPandas()
    assert s.query_id.is_unique and (s.role == "calibration").sum() == 6 and (s.role == "evaluation").sum() == 9
    f = preparation.fast_sets(a, 4, 5).toPandas()
    assert f.query_id.is_unique and f[f.role == "calibration"].query_id.tolist() == [29, 27, 25, 23]
    ev = spark.createDataFrame([(29,)], "query_id long")
    for target, clusters in ((7, 3), (2, 3), (9, 1), (60, 3), (0, 3)):
        c = preparation.calibration_after_evaluation(a, ev, "g", target, clusters).toPandas()
        assert len(c) == min(target, 29) and c.query_id.is_unique and 29 not in set(c.query_id)
    # with fewer places than clusters each cluster still gives one, and the last are cut
    assert set(preparation.calibration_after_evaluation(a, ev, "g", 2, 3).toPandas().query_id) == {27, 25}


def test_pool_growth(spark):
    pool = spark.createDataFrame([("a", "known text")], "query_id string, text string")
    extra = spark.createDataFrame([("a", "new one"), ("b", "known text"), ("c", "word"), ("d", "fresh text"), ("e", "fresh text"), ("f", "not judged"), ("g", "other text")], "query_id string, text string")
    qrels = spark.createDataFrame([(x, "1") for x in "abcdeg"], "query_id string, doc_id string")
    assert {r.query_id for r in preparation.grow_pool(pool, extra, qrels, 10, 1).collect()} == {"d", "g"}
    assert preparation.grow_pool(pool, extra, qrels, 2, 1).count() == 1


def test_joint_scan_equals_filtered_search(spark):
    rng = np.random.default_rng(2)
    v, c = rng.standard_normal((200, 8)), rng.standard_normal((6, 8))
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_idx long, v array<double>").repartition(5)
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cluster_id long, center array<double>")
    q = spark.createDataFrame([(i, j, rng.standard_normal(8).tolist()) for i in range(5) for j in (i, (i + 1) % 6)], "query_id long, cluster_id long, qv array<double>")
    support = knn.against_centers(d, F.col("doc_idx"), F.col("v"), t, 2).select(F.col("id").alias("doc_idx"), "cluster_id")
    key = lambda f: {tuple(r) for r in f.collect()}
    assert key(knn.supported_knn(d, t, 2, q, 4, 8)) == key(knn.filtered_knn(d, q, support, 4))


def test_signs_find_most_neighbours_and_the_rest_is_refilled(spark):
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((40, 32))
    v = np.concatenate([centers[i % 40] + 0.4 * rng.standard_normal((1, 32)) for i in range(4000)])
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_idx long, v array<double>")
    q = spark.createDataFrame([(i, (v[i] + 0.1 * rng.standard_normal(32)).tolist()) for i in range(50)] + [(99, (100 * rng.standard_normal(32)).tolist())], "query_id long, qv array<double>")
    got = {(r.query_id, r.doc_idx) for r in knn.lsh_knn(d, q, 5, 32).collect()}
    want = {(r.query_id, r.doc_idx) for r in knn.exact_knn(d, F.col("doc_idx"), F.col("v"), q, F.col("query_id"), F.col("qv"), 5, 32).collect()}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_lattice_accounting(spark):
    from pyspark.errors import PySparkException

    d = spark.createDataFrame([(2.9,), (-3.2,), (5.0,)], "x double")
    assert [r.n for r in d.select(crypto.rounded_integers(F.col("x")).alias("n")).collect()] == [3, -3, 5]
    with pytest.raises(PySparkException):
        spark.createDataFrame([(2.5,)], "x double").select(crypto.rounded_integers(F.col("x"))).collect()
    with pytest.raises(ValueError):
        crypto.Lattice(degree=64).check(33)
