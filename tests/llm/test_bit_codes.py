import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectrine.functions.arrow_vectors import list_column
from vectrine.llm import bit_codes
from vectrine.llm.bit_codes import BitCodeConfig, byte_tables, encode, estimates, most_similar, rotation, routed_similar


def brute(docs, queries, k):
    out = set()
    for q, x in queries:
        c = sorted((-round(float(np.dot(x, v) / np.linalg.norm(x) / np.linalg.norm(v)), 12), i) for i, v in docs)
        out |= {(q, r + 1, i) for r, (_, i) in enumerate(c[:k])}
    return out


@pytest.mark.parametrize("block", [131072, 8])
def test_against_brute_force_with_ties_and_repeats(spark, vectors, rng, block):
    docs = [(i, rng.standard_normal(64).astype(np.float32)) for i in range(400)]
    docs += [(1000 + i, docs[i % 7][1] * np.float32(2 ** (i % 3))) for i in range(200)]  # a third are copies, some of other lengths
    queries = [(i, rng.standard_normal(64).astype(np.float32)) for i in range(20)] + [(100, docs[0][1])]
    bad = [(7000, None), (7001, np.zeros(64)), (7002, np.ones(2)), (7003, [float("nan")] * 64), (None, np.ones(64))]
    got = most_similar(vectors(docs + docs[:100] + bad).repartition(5), F.col("id"), F.col("v"), vectors(queries + queries[:3] + bad), F.col("id"), F.col("v"), BitCodeConfig(query_block=block)).collect()
    assert {(r["query"], r["rank"], r["neighbour"]) for r in got} == brute(docs, queries, 5)


@pytest.mark.parametrize("block", [131072, 8])
def test_a_share_searched_first_loses_nothing(spark, vectors, rng, block):
    """So many rows for their sample that the k best of a share of them raise the floor; some queries meet copies only."""
    docs = [(i, rng.standard_normal(64).astype(np.float32)) for i in range(900)]
    docs += [(2000 + i, docs[i % 3][1] * np.float32(2 ** (i % 3))) for i in range(300)]
    queries = [(i, rng.standard_normal(64).astype(np.float32)) for i in range(20)] + [(100 + i, docs[i][1]) for i in range(4)]
    cfg = BitCodeConfig(query_block=block, sample_rows=8)
    assert len(docs) > cfg.sample_rows * bit_codes.SHARE * 4
    got = most_similar(vectors(docs + docs[:100]).repartition(5), F.col("id"), F.col("v"), vectors(queries), F.col("id"), F.col("v"), cfg).collect()
    assert {(r["query"], r["rank"], r["neighbour"]) for r in got} == brute(docs, queries, 5)


def test_a_scan_takes_the_time_of_a_product_and_memory_by_queries_alone(rng):
    """Every pair is met, so a pair must cost little; and queries by the thousands fit a task."""
    cfg = BitCodeConfig()
    x, q = (rng.standard_normal((n, 64)).astype(np.float32) for n in (8192, 8192))
    norm = lambda m: np.sqrt((m.astype(float) ** 2).sum(1))
    ux, uq = x / norm(x)[:, None].astype(np.float32), q / norm(q)[:, None].astype(np.float32)
    codes, s = encode(ux, rotation(64, cfg.seed))
    floor = np.partition(uq @ ux.T, -5, axis=1)[:, -5] - 1e-5
    block = SimpleNamespace(value=(np.arange(len(q)), q, norm(q), floor.astype(float)))
    cols = [pa.array(np.arange(len(x))), list_column(x.ravel(), np.full(len(x), 64), pa.float32()), pa.array([c.tobytes() for c in codes]), pa.array(s.astype(np.float32))]
    batch = pa.record_batch(cols, ["id", "v", "code", "s"])

    def seconds(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    scan = lambda: sum(b.num_rows for b in bit_codes._scan(cfg, block)([batch]))
    plain = seconds(lambda: [ux[a : a + 512] @ uq[b : b + 1024].T for a in range(0, 8192, 512) for b in range(0, 8192, 1024)])
    assert seconds(scan) < 5 * plain
    tracemalloc.start()
    assert scan() == 5 * len(q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6


def test_few_documents_and_empty_tables(spark, vectors):
    d, q = vectors([(1, np.ones(64)), (2, -np.ones(64))]), vectors([(5, np.ones(64))])
    assert [(r["neighbour"], r["cosine"]) for r in most_similar(d, F.col("id"), F.col("v"), q, F.col("id"), F.col("v")).orderBy("rank").collect()] == [(1, 1.0), (2, -1.0)]
    assert most_similar(vectors([]), F.col("id"), F.col("v"), q, F.col("id"), F.col("v")).count() == 0
    assert most_similar(d, F.col("id"), F.col("v"), vectors([]), F.col("id"), F.col("v")).count() == 0


def test_the_estimate_and_its_bound(rng):
    r = rotation(64, 1)
    assert np.allclose(r @ r.T, np.eye(64))
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x[0] + 0.5 * x[1]
    q /= np.linalg.norm(q)
    codes, s = encode(x, r)
    assert codes.shape == (3000, 8)
    y = (r.astype(np.float32) @ q)[None]
    assert np.allclose(estimates(codes, byte_tables(y))[:, 0], (np.unpackbits(codes, axis=1) * 2.0 - 1) @ y[0] / 8, atol=1e-5)
    est = estimates(codes, byte_tables(y))[:, 0] / s
    err = est - x @ q
    bound = np.sqrt((1 - s * s) / (s * s) / 63)
    assert abs(err.mean()) < 0.01 and (np.abs(err) <= 3 * bound).mean() > 0.995


def test_recall_of_routed_queries(spark, vectors, rng):
    """Groups and strays, every tenth row asks; a part of a list is small, so long lists are split."""
    centers = rng.standard_normal((30, 64))
    docs = [(i, centers[i % 30] + (3.0 if i % 5 == 0 else 0.9) * rng.standard_normal(64)) for i in range(6000)]
    d = vectors(docs)
    cfg = BitCodeConfig(part_rows=100)
    got = {(r["query"], r["neighbour"]) for r in routed_similar(d, F.col("id"), F.col("v"), d.filter("id % 10 = 0"), F.col("id"), F.col("v"), cfg).collect()}
    x = np.array([v for _, v in docs], np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {(q, int(j)) for q in range(0, 6000, 10) for j in np.argsort(-(x @ x[q]), kind="stable")[:5]}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9
    assert routed_similar(vectors([]), F.col("id"), F.col("v"), d, F.col("id"), F.col("v")).count() == 0
    bad = vectors([(1, None), (2, np.zeros(64)), (3, np.ones(3)), (None, np.ones(64))])
    assert routed_similar(d.limit(20), F.col("id"), F.col("v"), bad, F.col("id"), F.col("v")).count() == 0
    few = routed_similar(vectors([(1, np.ones(64)), (2, -np.ones(64)), (2, -np.ones(64))]), F.col("id"), F.col("v"), vectors([(5, np.ones(64))]), F.col("id"), F.col("v")).orderBy("rank").collect()
    assert [(r["neighbour"], r["cosine"]) for r in few] == [(1, 1.0), (2, -1.0)]
