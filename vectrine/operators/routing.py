"""Routing queries to clusters and the privacy gate.

Centers are a small table (one row a cluster); they go to the queries in blocks,
and the angles are computed a block at a time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.functions.vectors import dot
from vectrine.operators.knn import against_centers


def center_angles(queries: DataFrame, centers: DataFrame, keep: int | None = None) -> DataFrame:
    """(query_id, cluster_id, theta, rank): the ``keep`` nearest centers (every one, if None) by angle, ties by the smaller cluster id."""
    near = against_centers(queries, F.col("query_id"), F.col("qv"), centers, keep)
    return near.select(F.col("id").alias("query_id"), "cluster_id", F.col("value").alias("theta"), "rank")


def route_top_c(ranked: DataFrame, c: int) -> DataFrame:
    """The c nearest clusters of each query."""
    return ranked.filter(F.col("rank") <= c)


def gaps(ranked: DataFrame) -> DataFrame:
    """(query_id, gap2, gap3, gap4): how much farther the next clusters are than the nearest; null where there are fewer."""
    at = lambda r: F.min(F.when(F.col("rank") == r, F.col("theta")))
    return ranked.groupBy("query_id").agg(*(F.round(at(r) - at(1), 9).alias(f"gap{r}") for r in (2, 3, 4)))


def route_gap_ladder(ranked: DataFrame, threshold2: float, threshold3: float | None = None, threshold4: float | None = None, top_m: int = 4) -> DataFrame:
    """The nearest cluster, and the second to fourth as long as each gap in turn is within its threshold (the one before, where it has none)."""
    t3 = threshold2 if threshold3 is None else threshold3
    t4 = t3 if threshold4 is None else threshold4
    g2, g3, g4 = F.col("gap2") <= threshold2, F.col("gap3") <= t3, F.col("gap4") <= t4
    n = 1 + F.when(g2 & g3 & g4, 3).when(g2 & g3, 2).when(g2, 1).otherwise(0)
    return ranked.join(gaps(ranked).select("query_id", F.least(n, F.lit(top_m)).alias("_n")), "query_id").filter(F.col("rank") <= F.col("_n")).drop("_n")


def route_boundary(ranked: DataFrame, threshold: float, top_m: int) -> DataFrame:
    """The ``top_m`` nearest clusters if the second is within ``threshold`` of the first, else the nearest."""
    n = F.when(F.col("gap2") <= threshold, top_m).otherwise(1)
    return ranked.join(gaps(ranked).select("query_id", n.alias("_n")), "query_id").filter(F.col("rank") <= F.col("_n")).drop("_n")


def skip_gate(queries: DataFrame, clusters: DataFrame, epsilon: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """As ``gate`` without noise: sigma and the mean radius are 0, and every query passes."""
    near = center_angles(queries, clusters, 1).select("query_id", "cluster_id", F.col("theta").alias("center_theta"))
    e = clip_epsilon(F.lit(float(epsilon)), F.lit(low).cast("double"), F.lit(high).cast("double"))
    out = near.join(clusters.select("cluster_id", "r_k", "r_fixed", "r_max"), "cluster_id").withColumns({"epsilon_used": e, "sigma": F.lit(0.0), "r_bar": F.lit(0.0)})
    return out.withColumns({"track": F.lit("dense_rdp"), "margin": F.col("r_max")})


def center_cosines(queries: DataFrame, centers: DataFrame) -> DataFrame:
    """(query_id, cluster_id, cosine): inner products with unit centers, neither side normalised, clipped to [-1, 1]; centers are a small table."""
    c = centers.select("cluster_id", "center")
    return queries.join(c, F.lit(True)).select("query_id", "cluster_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("qv"), F.col("center")))).alias("cosine"))


def dense_only(gated: DataFrame) -> DataFrame:
    """Queries that the gate lets pass."""
    return gated.filter("track = 'dense_rdp'")


def track_counts(gated: DataFrame, by: str | None = None) -> DataFrame:
    """(track[, by], n): how many queries are on each track."""
    return gated.groupBy("track", *([by] if by else [])).agg(F.count(F.lit(1)).alias("n"))


def sigma(alpha: float, epsilon: Column) -> Column:
    """Noise scale sqrt(alpha / (2 epsilon))."""
    return F.sqrt(F.lit(float(alpha)) / (2 * epsilon))


def r_bar(alpha: float, epsilon: Column, dim: int) -> Column:
    """Mean noise radius sigma * sqrt(dim)."""
    return sigma(alpha, epsilon) * math.sqrt(dim)


def clip_epsilon(epsilon: Column, low: Column, high: Column) -> Column:
    """Epsilon within [low, high], if both bounds are positive, finite and in order; else as it is."""
    inf = F.lit(float("inf"))
    fine = low.isNotNull() & high.isNotNull() & ~F.isnan(low) & ~F.isnan(high) & (low < inf) & (high < inf) & (low > 0) & (high > 0) & (low <= high)
    return F.when(fine, F.greatest(low, F.least(high, epsilon))).otherwise(epsilon)


def track(radius: Column, r_max: Column) -> Column:
    """'dense_rdp' where the cluster admits the radius."""
    return F.when(r_max >= radius, "dense_rdp").otherwise("out_of_scope")


def gate(queries: DataFrame, clusters: DataFrame, alpha: float, epsilon: float, dim: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """One row a query: nearest cluster, its radii, the epsilon in use, sigma, mean radius, track and margin.

    clusters(cluster_id, center, r_k, r_fixed, r_max).
    """
    near = center_angles(queries, clusters, 1).select("query_id", "cluster_id", F.col("theta").alias("center_theta"))
    e = clip_epsilon(F.lit(float(epsilon)), F.lit(low).cast("double"), F.lit(high).cast("double"))
    return (
        near.join(clusters.select("cluster_id", "r_k", "r_fixed", "r_max"), "cluster_id")
        .withColumns({"epsilon_used": e, "sigma": sigma(alpha, e), "r_bar": r_bar(alpha, e, dim)})
        .withColumns({"track": track(F.col("r_bar"), F.col("r_max")), "margin": F.col("r_max") - F.col("r_bar")})
    )
