"""Whole pipelines, composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.operators import clustering, knn, metrics, privacy, routing
from vectrine.plans.config import Settings
from vectrine.plans.materialize import Scratch


@dataclass
class Offline:
    """What the offline stage leaves: a partition, its clusters and their radii."""

    assignment: DataFrame
    clusters: DataFrame


def offline(docs: DataFrame, anchors: DataFrame, assignment: DataFrame, s: Settings) -> Offline:
    """Centers, radii and the r_max of each cluster from anchor queries.

    docs(doc_idx, v), anchors(query_id, qv), assignment(doc_idx, cluster_id).
    The anchors are an input, so the split comes first and no pass depends on
    what an earlier one left behind.
    """
    scratch = Scratch(docs.sparkSession)
    centers = scratch.cut(clustering.centroids(docs.join(assignment, "doc_idx").select("cluster_id", "v"), s.dim).coalesce(1))
    radii = clustering.profile(clustering.member_angles(docs, assignment, centers), s.eval_k, s.fixed_k)
    routed = scratch.cut(routing.center_angles(anchors, centers, s.top_c))
    near = scratch.cut(knn.supported_knn(docs, centers, s.top_c, anchors.join(routed.select("query_id", "cluster_id"), "query_id"), s.fixed_k, s.dim))
    truth = knn.exact_knn(docs, F.col("doc_idx"), F.col("v"), anchors, F.col("query_id"), F.col("qv"), s.eval_k, s.dim)
    ideal = clustering.covered_r_max(routed, near, truth, s.eval_k)
    r_max = clustering.r_max_surrogate(routed, ideal, centers, s.gamma)
    clusters = centers.join(radii.drop("size"), "cluster_id").join(r_max, "cluster_id")
    return Offline(assignment, scratch.cut(clusters))


def online(docs: DataFrame, queries: DataFrame, state: Offline, s: Settings, noise: str = "rdp") -> DataFrame:
    """One row a query: gate, routing, radius, recall of the re-ranked answer, bytes.

    Gate by the nearest cluster, perturb with the largest r_max of the routed
    clusters as bound, search all documents by the perturbed query, re-rank by
    the original one.  ``noise`` 'none' forces the radius to 0.
    docs(doc_idx, v, doc_id, text), queries(query_id, qv).
    """
    scratch = Scratch(docs.sparkSession)
    gated = scratch.cut(routing.gate(queries, state.clusters, s.alpha, s.epsilon, s.dim))
    routed = routing.center_angles(queries, state.clusters, s.top_c)
    bound = routed.join(state.clusters.select("cluster_id", "r_max"), "cluster_id").groupBy("query_id").agg(F.max("r_max").alias("r_max"), F.sort_array(F.collect_list("cluster_id")).alias("routed"))
    dense = gated.filter("track = 'dense_rdp'").select("query_id")
    asked = queries.join(bound, "query_id").join(dense, "query_id", "left_semi")
    sent = scratch.cut(privacy.perturb_rdp(asked, s.alpha, s.epsilon, s.dim, s.seed, forced_radius=0.0 if noise == "none" else None))
    got = knn.exact_knn(docs, F.col("doc_idx"), F.col("v"), sent, F.col("query_id"), F.col("perturbed"), s.fixed_k, s.dim)
    got = scratch.cut(got)
    answer = scratch.cut(knn.rerank_exact(got, docs.select("doc_idx", "v"), queries, s.eval_k))
    truth = scratch.cut(knn.exact_knn(docs, F.col("doc_idx"), F.col("v"), queries, F.col("query_id"), F.col("qv"), s.eval_k, s.dim))
    recall = metrics.exact_recall(answer, truth, s.eval_k).select("query_id", F.col("recall").alias("exact_recall"))
    inclusion = metrics.exact_recall(got, truth, s.eval_k).select("query_id", F.col("recall").alias("inclusion_recall"))
    load = metrics.response_bytes(got.join(docs.select("doc_idx", "doc_id", "text"), "doc_idx"), s.dim)
    return (
        gated.join(bound.select("query_id", "routed", F.col("r_max").alias("bound")), "query_id").join(sent.select("query_id", "radius"), "query_id", "left")
        .join(recall, "query_id", "left").join(inclusion, "query_id", "left").join(load, "query_id", "left")
        .select("query_id", "cluster_id", "track", "r_bar", "r_max", "bound", F.array_join(F.transform("routed", lambda x: x.cast("string")), ",").alias("routed"), "radius",
                F.when(F.col("track") == "dense_rdp", F.col("exact_recall")).alias("exact_recall"), F.when(F.col("track") == "dense_rdp", F.col("inclusion_recall")).alias("inclusion_recall"),
                F.lit(4 * s.dim).alias("request_bytes"), "response_bytes")
    )
