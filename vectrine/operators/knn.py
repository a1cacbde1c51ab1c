"""Exact nearest neighbours by angle.

The order is always: smaller angle first, then smaller document index.  Vectors
stay where they are scanned; queries are sent to them in blocks of a fixed
size, one pass a block, and each partition returns its k best of each query, so
what is shuffled is k rows a query and partition.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions.arrow_vectors import take, usable
from vectrine.functions.vectors import theta
from vectrine.plans.materialize import Scratch

#: Queries that are broadcast at a time (4 * dim bytes each).
QUERY_BLOCK = 65536


def rounded_angles(c: np.ndarray) -> np.ndarray:
    return np.round(np.arccos(np.clip(np.round(c, 12), -1, 1)), 9)


@dataclass
class _Block:
    ids: np.ndarray
    unit: np.ndarray
    group: np.ndarray | None


def query_blocks(queries: DataFrame, dim: int | None, group: bool = False):
    """The queries (id, v[, group]) in blocks of bounded size, as arrays on the driver."""
    n = max(1, -(-queries.count() // (QUERY_BLOCK * 3 // 4)))
    cut = queries.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(n)))
    for i in range(n):
        t = cut.filter(F.col("_b") == i).drop("_b").toArrow()
        at, m, norms = usable(t.column("v"), dim)
        if len(at):
            yield _Block(t.column("id").to_numpy()[at], m.astype(np.float64) / norms[:, None], t.column("group").to_numpy()[at] if group else None)


def _keep(q, i, t, k):
    """The k best rows of each query, by angle and index; repeats of an index count once."""
    order = np.lexsort((i, t, q))
    q, i, t = q[order], i[order], t[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
    q, i, t = q[new], i[new], t[new]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate([start, [len(q)]])))
    keep = rank < k
    return q[keep], i[keep], t[keep]


def _scan(shared, k: int, dim: int | None, grouped: bool, near: tuple[np.ndarray, np.ndarray, int] | None = None):
    """``near``: the ids and unit centers of groups, and how many groups a document belongs to, in place of a column of groups."""

    def run(batches):
        blk = shared.value
        q = i = np.empty(0, np.int64)
        t = np.empty(0)

        def meet(asked: np.ndarray, ids: np.ndarray, unit: np.ndarray) -> None:
            """Hold some queries of the block against some documents, and keep the best."""
            nonlocal q, i, t
            for lo in range(0, len(asked), 1024):
                part = asked[lo : lo + 1024]
                c = blk.unit[part] @ unit.T
                kk = min(k, c.shape[1])
                low = np.partition(c, c.shape[1] - kk, axis=1)[:, c.shape[1] - kk]
                at = np.flatnonzero(c >= (low - 1e-8)[:, None])
                qi, di = at // c.shape[1], at % c.shape[1]
                q, i, t = np.concatenate([q, part[qi]]), np.concatenate([i, ids[di]]), np.concatenate([t, rounded_angles(c[qi, di])])
            if len(q) > 4 * k * len(blk.ids):
                q, i, t = _keep(q, i, t, k)

        everyone = np.arange(len(blk.ids))
        by_group = {g: np.flatnonzero(blk.group == g) for g in np.unique(blk.group)} if grouped else {}
        for b in batches:
            rows, m, norms = usable(b.column(1), dim)
            if len(rows) == 0:
                continue
            ids = take(b.column(0), rows).to_numpy()
            unit = m.astype(np.float64) / norms[:, None]
            if not grouped:
                meet(everyone, ids, unit)
                continue
            if near is None:
                sides = take(b.column(2), rows).to_numpy()[:, None]
            else:
                names, centers, many = near
                sides = names[np.argsort(rounded_angles(unit @ centers.T), axis=1, kind="stable")[:, :many]]  # centers stand by id, so ties do too
            for side in sides.T:
                for g in np.unique(side):
                    if g in by_group:
                        own = side == g
                        meet(by_group[g], ids[own], unit[own])
        q, i, t = _keep(q, i, t, k)
        if len(q):
            cols = {"query_id": pa.array(blk.ids[q]), "doc_idx": pa.array(i), "theta": pa.array(t)}
            if grouped:
                cols["cluster_id"] = pa.array(blk.group[q])
            yield pa.RecordBatch.from_pydict(cols)

    return run


def exact_knn(docs: DataFrame, doc: Column, vector: Column, queries: DataFrame, query: Column, query_vector: Column, k: int, dim: int | None = None, doc_group: Column | None = None, query_group: Column | None = None) -> DataFrame:
    """(query_id, rank, doc_idx, theta): the k nearest documents of each query.

    With groups (columns of both sides), a query sees the documents of its own
    group only; it may stand once a group, and the result has ``cluster_id``
    too.  Fewer than k documents give all of them.  Unusable vectors and null
    ids take no part.
    """
    spark = docs.sparkSession
    grouped = doc_group is not None
    rows = docs.select(doc.cast("long").alias("id"), vector.alias("v"), *([doc_group.cast("long").alias("g")] if grouped else [])).filter("id is not null and v is not null")
    asked = queries.select(query.cast("long").alias("id"), query_vector.alias("v"), *([query_group.cast("long").alias("group")] if grouped else [])).filter("id is not null and v is not null")
    keys = ["query_id", *(["cluster_id"] if grouped else [])]
    schema = "query_id long, doc_idx long, theta double" + (", cluster_id long" if grouped else "")
    parts = []
    for blk in query_blocks(asked, dim, grouped):
        parts.append(rows.mapInArrow(_scan(spark.sparkContext.broadcast(blk), k, dim, grouped), schema))
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    w = Window.partitionBy(*keys).orderBy("theta", "doc_idx")
    return out.dropDuplicates([*keys, "doc_idx"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*keys, "rank", "doc_idx", "theta")


def supported_knn(docs: DataFrame, centers: DataFrame, c: int, queries: DataFrame, k: int, dim: int | None = None) -> DataFrame:
    """(query_id, cluster_id, rank, doc_idx, theta): the k nearest documents within each cluster that a query is routed to, a document belonging to its ``c`` nearest centers.

    docs(doc_idx, v), centers(cluster_id, center), queries(query_id,
    cluster_id, qv).  Each partition finds its documents' clusters and meets
    their queries in one pass, so no document moves.  The centers, one row a
    cluster, go to the workers (``CENTER_BLOCK`` at most).
    """
    spark = docs.sparkSession
    t = centers.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("center").cast("array<double>").alias("center")).orderBy("cluster_id").toArrow()
    at, m, norms = usable(t.column("center"), dim)
    if len(at) > CENTER_BLOCK:
        raise ValueError(f"more than {CENTER_BLOCK} centers")
    near = (t.column("cluster_id").to_numpy()[at], m.astype(np.float64) / norms[:, None], c)
    rows = docs.select(F.col("doc_idx").cast("long").alias("id"), "v").filter("id is not null and v is not null")
    asked = queries.select(F.col("query_id").cast("long").alias("id"), F.col("qv").alias("v"), F.col("cluster_id").cast("long").alias("group")).filter("id is not null and v is not null")
    schema = "query_id long, doc_idx long, theta double, cluster_id long"
    parts = [rows.mapInArrow(_scan(spark.sparkContext.broadcast(blk), k, dim, True, near), schema) for blk in query_blocks(asked, dim, True)]
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id", "cluster_id").orderBy("theta", "doc_idx")
    ranked = out.dropDuplicates(["query_id", "cluster_id", "doc_idx"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "cluster_id", "rank", "doc_idx", "theta")


def _scan_within(shared, dim: int | None):
    def run(batches):
        blk = shared.value
        low = np.cos(np.clip(blk.group, 0, np.pi)) - 1e-8
        for b in batches:
            rows, m, norms = usable(b.column(1), dim)
            if len(rows) == 0:
                continue
            ids = take(b.column(0), rows).to_numpy()
            unit = m.astype(np.float64) / norms[:, None]
            for lo in range(0, len(low), 1024):
                q, d = np.nonzero((c := blk.unit[lo : lo + 1024] @ unit.T) >= low[lo : lo + 1024, None])
                t = rounded_angles(c[q, d])
                near = t <= blk.group[lo + q]
                q, d, t = lo + q[near], d[near], t[near]
                if len(q):
                    yield pa.record_batch([pa.array(blk.ids[q]), pa.array(ids[d]), pa.array(t)], ["query_id", "doc_idx", "theta"])

    return run


def docs_within(docs: DataFrame, doc: Column, vector: Column, queries: DataFrame, query: Column, query_vector: Column, limit: Column, dim: int | None = None) -> DataFrame:
    """(query_id, rank, doc_idx, theta): all documents within each query's angle ``limit``, however many; ranks by :func:`exact_knn`'s order."""
    spark = docs.sparkSession
    rows = docs.select(doc.cast("long").alias("id"), vector.alias("v")).filter("id is not null and v is not null")
    asked = queries.select(query.cast("long").alias("id"), query_vector.alias("v"), limit.cast("double").alias("group")).filter("id is not null and v is not null and group is not null")
    schema = "query_id long, doc_idx long, theta double"
    parts = [rows.mapInArrow(_scan_within(spark.sparkContext.broadcast(b), dim), schema) for b in query_blocks(asked, dim, True)]
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy("theta", "doc_idx")
    return out.groupBy("query_id", "doc_idx").agg(F.min("theta").alias("theta")).withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "doc_idx", "theta")


#: Centers that a pass holds.
CENTER_BLOCK = 65536


def _against(ids: np.ndarray, unit: np.ndarray, raw: np.ndarray, dim: int | None, keep: int | None, metric: str):
    def run(batches):
        for b in batches:
            rows, m, norms = usable(b.column(1), dim)
            names = take(b.column(0), rows)
            # differences are formed for distances, as a product of norms would lose the small ones
            step = max(1, (1 << 22) // max(1, raw.size)) if metric == "l2" else 4096
            for lo in range(0, len(m), step):
                part = m[lo : lo + step].astype(np.float64)
                if metric == "l2":
                    value = np.round(np.sqrt(((part[:, None] - raw[None]) ** 2).sum(2)), 9)
                else:
                    value = rounded_angles((part / norms[lo : lo + step, None]) @ unit.T)
                k = len(ids) if keep is None else min(keep, len(ids))
                order = np.argsort(value, axis=1, kind="stable")[:, :k]  # centers stand by id, so ties do too
                n = len(part)
                yield pa.record_batch(
                    [names.take(pa.array(np.repeat(np.arange(lo, lo + n), k))), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(value, order, 1).ravel()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n))],
                    ["id", "cluster_id", "value", "rank"],
                )

    return run


def against_centers(rows: DataFrame, record: Column, vector: Column, centers: DataFrame, keep: int | None = None, metric: str = "theta") -> DataFrame:
    """(id, cluster_id, value, rank): each row's ``keep`` nearest centers (all, if None), by angle or Euclidean distance, ties by cluster id.

    centers(cluster_id, center) go to the rows in blocks of a fixed size, so
    neither side is shuffled; with one block the ranks are final.
    """
    spark = rows.sparkSession
    t = centers.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("center").cast("array<double>").alias("center")).orderBy("cluster_id")
    r = rows.select(record.cast("long").alias("id"), vector.alias("v")).filter("id is not null and v is not null")
    schema = "id long, cluster_id long, value double, rank int"
    n, parts = centers.count(), []
    blocks = max(1, -(-n // CENTER_BLOCK))
    for i in range(blocks):
        part = t if blocks == 1 else t.filter(F.pmod(F.xxhash64("cluster_id"), F.lit(blocks)) == i)
        a = part.toArrow()
        at, m, norms = usable(a.column("center"), None)
        if len(at):
            raw = np.array(a.column("center").to_pylist(), float)[at]
            parts.append(r.mapInArrow(_against(a.column("cluster_id").to_numpy()[at], raw / np.linalg.norm(raw, axis=1, keepdims=True), raw, m.shape[1], keep, metric), schema))
    if not parts:
        return spark.createDataFrame([], schema)
    if len(parts) == 1:
        return parts[0]
    w = Window.partitionBy("id").orderBy("value", "cluster_id")
    out = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w))
    return out if keep is None else out.filter(F.col("rank") <= keep)


def _pairs(shared, dim: int | None):
    def run(batches):
        blk = shared.value
        for b in batches:
            rows, m, norms = usable(b.column(1), dim)
            names = take(b.column(0), rows).to_numpy()
            for lo in range(0, len(m), 256):
                u = m[lo : lo + 256].astype(np.float64) / norms[lo : lo + 256, None]
                c = u @ blk.unit.T
                n = len(u)
                yield pa.record_batch([pa.array(np.tile(blk.ids, n)), pa.array(np.repeat(names[lo : lo + n], len(blk.ids))), pa.array(c.ravel())], ["query_id", "doc_idx", "cosine"])

    return run


def score_matrix(docs: DataFrame, doc: Column, vector: Column, queries: DataFrame, query: Column, query_vector: Column, dim: int | None = None) -> DataFrame:
    """(query_id, doc_idx, cosine) of every query with every document, in blocks."""
    spark = docs.sparkSession
    rows = docs.select(doc.cast("long").alias("id"), vector.alias("v")).filter("id is not null and v is not null")
    asked = queries.select(query.cast("long").alias("id"), query_vector.alias("v")).filter("id is not null and v is not null")
    schema = "query_id long, doc_idx long, cosine double"
    parts = [rows.mapInArrow(_pairs(spark.sparkContext.broadcast(b), dim), schema) for b in query_blocks(asked, dim)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def rank_pairs(pairs: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), score: str = "theta", tie: str = "doc_idx") -> DataFrame:
    """Rank scored pairs within ``by`` and keep the k best."""
    w = Window.partitionBy(*by).orderBy(score, tie)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pair_angles(pairs: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Angles of given (query_id, doc_idx) pairs: docs(doc_idx, v), queries(query_id, qv)."""
    return pairs.join(docs, "doc_idx").join(queries, "query_id").withColumn("theta", theta(F.col("qv"), F.col("v"))).drop("v", "qv")


def rerank_exact(candidates: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, doc_idx) ranked again by the exact angle to the original query."""
    return rank_pairs(pair_angles(candidates.select("query_id", "doc_idx").distinct(), docs, queries), k)


def filtered_knn(docs: DataFrame, queries: DataFrame, support: DataFrame, k: int) -> DataFrame:
    """(query_id, cluster_id, rank, doc_idx, theta): the k nearest documents within each supported cluster of a query.

    docs(doc_idx, v), queries(query_id, cluster_id, qv), support(cluster_id,
    doc_idx).  A document is moved once a cluster that supports it, and not
    once a query.
    """
    rows = support.select("doc_idx", "cluster_id").join(docs, "doc_idx")
    return exact_knn(rows, F.col("doc_idx"), F.col("v"), queries, F.col("query_id"), F.col("qv"), k, None, F.col("cluster_id"), F.col("cluster_id")).select("query_id", "cluster_id", "rank", "doc_idx", "theta")


def relaxed_positives(scored: DataFrame, k: int, slack: float = 1e-8) -> DataFrame:
    """Pairs (query_id, doc_idx, score) whose score reaches the query's k-th best less ``slack``."""
    top = rank_pairs(scored.withColumn("_neg", -F.col("score")), k, score="_neg").groupBy("query_id").agg(F.min("score").alias("kth"))
    return scored.join(top, "query_id").filter(F.col("score") >= F.col("kth") - slack).select("query_id", "doc_idx", "score")


def ivf_knn(docs: DataFrame, queries: DataFrame, assignment: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """Approximate: the k nearest documents within the clusters that a query is routed to.

    docs(doc_idx, v), queries(query_id, qv), assignment(doc_idx, cluster_id), routed(query_id, cluster_id).
    """
    near = filtered_knn(docs, queries.join(routed.select("query_id", "cluster_id"), "query_id"), assignment, k)
    return rank_pairs(near.select("query_id", "doc_idx", "theta").distinct(), k)


def _sign_bands(dim: int, bits: int, bands: int, seed: int, probes: int):
    """The bands of each row, and with ``probes`` also those that differ in one of the bits nearest to zero."""

    def run(batches):
        planes = np.random.default_rng(seed).standard_normal((dim, bits * bands))
        power = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            rows, m, _ = usable(b.column(1), dim)
            if len(rows) == 0:
                continue
            side = (m @ planes).reshape(len(rows), bands, bits)
            key = ((side > 0) @ power) | (np.arange(bands, dtype=np.int64) << bits)
            close = np.argsort(np.abs(side), axis=2)[:, :, : min(probes, bits)]
            keys = np.concatenate([key[:, :, None], key[:, :, None] ^ power[close]], 2).reshape(len(rows), -1)
            yield pa.record_batch([pa.array(np.repeat(take(b.column(0), rows).to_numpy(), keys.shape[1])), pa.array(keys.ravel())], ["id", "band"])

    return run


#: Documents that a band of signs holds, about.
BAND_ROWS = 64


def lsh_knn(docs: DataFrame, queries: DataFrame, k: int, dim: int, bits: int | None = None, bands: int = 24, probes: int = 3, seed: int = 7) -> DataFrame:
    """Approximate: the k nearest documents among those that share a band of random sign bits.  docs(doc_idx, v), queries(query_id, qv).

    A band has as many bits as leave about ``BAND_ROWS`` documents in it,
    however many there are.  A query also looks into the bands next to its own;
    one that finds fewer than k documents is answered exactly.
    """
    scratch = Scratch(docs.sparkSession)
    if bits is None:
        bits = max(4, min(40, round(np.log2(max(2, docs.count() / BAND_ROWS)))))
    d = docs.select(F.col("doc_idx").alias("id"), "v").mapInArrow(_sign_bands(dim, bits, bands, seed, 0), "id long, band long").withColumnRenamed("id", "doc_idx")
    q = queries.select(F.col("query_id").alias("id"), F.col("qv").alias("v")).mapInArrow(_sign_bands(dim, bits, bands, seed, probes), "id long, band long").withColumnRenamed("id", "query_id")
    found = scratch.cut(rank_pairs(pair_angles(d.join(q, "band").select("query_id", "doc_idx").distinct(), docs, queries), k))
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    short = queries.join(full, "query_id", "left_anti")
    refill = exact_knn(docs, F.col("doc_idx"), F.col("v"), short, F.col("query_id"), F.col("qv"), k, dim)
    return found.join(full, "query_id", "left_semi").select("query_id", "rank", "doc_idx", "theta").unionByName(refill)


def payload(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, rank, doc_idx, score, doc_id, text, v): what is sent for found documents (query_id, rank, doc_idx, theta): docs(doc_idx, doc_id, text, v)."""
    return found.join(docs, "doc_idx").select("query_id", "rank", "doc_idx", F.cos("theta").alias("score"), "doc_id", "text", "v")


def cluster_payload(routed: DataFrame, assignment: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, place, doc_idx, doc_id, text, v): the documents of all clusters that a query is routed to, each once, by index."""
    pairs = routed.select("query_id", "cluster_id").join(assignment, "cluster_id").select("query_id", "doc_idx").distinct()
    w = Window.partitionBy("query_id").orderBy("doc_idx")
    return pairs.withColumn("place", F.row_number().over(w) - 1).join(docs, "doc_idx").select("query_id", "place", "doc_idx", "doc_id", "text", "v")
