"""Anchors: the vectors from which a cluster's r_max is calibrated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.operators.routing import center_angles
from vectrine.operators.sampling import group_index, stratified_pick

#: How anchors may be chosen.
POLICIES = ("calibration_query_only", "calibration_query_plus_docs", "docs_only")


def query_anchors(queries: DataFrame, centers: DataFrame, target: int, strata: int, least: int = 0, enforce: bool = False) -> DataFrame:
    """(query_id, cluster_id): of the queries nearest to each center, ``target`` spread over ``strata`` bins of their angles; with ``enforce``, a cluster with fewer than ``least`` is an error."""
    owner = center_angles(queries, centers, 1)
    picked = stratified_pick(owner, "cluster_id", "query_id", "theta", target, strata)
    if enforce:
        n = centers.select("cluster_id").join(picked.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "cluster_id", "left")
        few = n.filter(F.coalesce("n", F.lit(0)) < least).limit(5).collect()
        if few:
            raise ValueError(f"clusters {[r['cluster_id'] for r in few]} have fewer than {least} anchors")
    return picked.select("query_id", "cluster_id")


def docs_anchors(angles: DataFrame, target: int) -> DataFrame:
    """(doc_idx, cluster_id): ``target`` members of each cluster at evenly spaced places of the order by angle (doc_idx, cluster_id, theta), all of a smaller one."""
    r = group_index(angles.select("doc_idx", "cluster_id", "theta"), "cluster_id", "theta", "doc_idx").withColumnRenamed("index", "i")
    take = F.least(F.col("n"), F.lit(max(1, target)))
    # the places are floor(j * (n - 1) / (take - 1)); of the j whose place may be i, the first is enough
    j = F.ceil(F.col("i") * (take - 1) / (F.col("n") - 1))
    hit = F.when(take >= F.col("n"), True).when(take == 1, F.col("i") == 0).otherwise((F.floor(j * (F.col("n") - 1) / (take - 1)) == F.col("i")) & (j < take))
    return r.filter(hit).select("doc_idx", "cluster_id")


def anchors(policy: str, queries: DataFrame, docs: DataFrame, centers: DataFrame, angles: DataFrame, target: int, strata: int) -> DataFrame:
    """(anchor, qv, cluster_id): anchors by policy.

    'calibration_query_only': query anchors of each cluster; with '_plus_docs',
    all documents too, without a cluster of their own; 'docs_only': documents
    spread over each cluster.  Ids are 'q' or 'd' and the number.
    queries(query_id, qv), docs(doc_idx, v), angles(doc_idx, cluster_id, theta).
    """
    name = lambda kind, c: F.concat(F.lit(kind), c.cast("string")).alias("anchor")
    if policy not in POLICIES:
        raise ValueError(f"{policy} is none of {POLICIES}")
    if policy == "docs_only":
        return docs.join(docs_anchors(angles, target), "doc_idx").select(name("d", F.col("doc_idx")), F.col("v").alias("qv"), "cluster_id")
    picked = queries.join(query_anchors(queries, centers, target, strata), "query_id")
    plus = policy == "calibration_query_plus_docs"
    own: Column = F.lit(None).cast("long") if plus else F.col("cluster_id").cast("long")
    out = picked.select(name("q", F.col("query_id")), "qv", own.alias("cluster_id"))
    return out.unionByName(docs.select(name("d", F.col("doc_idx")), F.col("v").alias("qv"), F.lit(None).cast("long").alias("cluster_id"))) if plus else out
