"""Noise on queries.  Every query has its own random stream, from the seed and its id, so results hang neither on order nor on partitions."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.functions.arrow_vectors import list_column, take, usable

MOST_TRIALS = 300_000


def stream(seed: int, query_id: object) -> np.random.Generator:
    """The random stream of one query."""
    return np.random.default_rng(np.frombuffer(hashlib.sha256(f"{seed}::{query_id}".encode()).digest(), np.uint32))


def sphere(dim: int, rng: np.random.Generator) -> np.ndarray:
    """A direction, uniform on the sphere."""
    while True:
        v = rng.standard_normal(dim)
        if (n := np.linalg.norm(v)) > 1e-12:
            return v / n


def chi_radius(scale: float, dim: int, rng: np.random.Generator, low: float | None = None, high: float | None = None) -> float:
    """scale * chi(dim), held to [low, high] by rejection; equal bounds give the bound, reversed ones are an error."""
    if low is None or high is None:
        return scale * math.sqrt(rng.chisquare(dim))
    if high < low:
        raise ValueError("the upper bound is below the lower")
    if high == low:
        return low
    left = MOST_TRIALS
    while left > 0:
        n = min(left, 4096)
        r = scale * np.sqrt(rng.chisquare(dim, n))
        good = r[(r >= low) & (r <= high)]
        if len(good):
            return float(good[0])
        left -= n
    raise ValueError("no radius within the bounds was drawn")


def angular_shift(radius: Column, query_norm: Column) -> Column:
    """atan(r / |q|)."""
    return F.atan(radius / query_norm)


def _perturb(kind: str, dim: int, scale: float, low: float, seed: int, forced: float | None, clip: bool):
    def run(batches):
        for b in batches:
            rows, m, norms = usable(b.column(1), dim)
            if len(rows) == 0:
                continue
            ids = take(b.column(0), rows)
            high = take(b.column(2), rows).to_numpy(zero_copy_only=False)
            out, radius = np.empty((len(rows), dim)), np.empty(len(rows))
            for n, i in enumerate(ids.to_pylist()):
                rng = stream(seed, i)
                if forced is not None:
                    r = min(forced, high[n]) if clip else forced
                elif kind == "gamma":
                    r = rng.gamma(dim, scale)
                else:
                    r = chi_radius(scale, dim, rng, low, float(high[n]))
                radius[n] = r
                out[n] = m[n] + r * sphere(dim, rng)
            cols = [ids, list_column(out.ravel(), np.full(len(rows), dim), pa.float64()), pa.array(radius), pa.array(np.arctan(radius / norms))]
            yield pa.record_batch(cols, ["query_id", "perturbed", "radius", "delta_alpha"])

    return run


_SCHEMA = "query_id long, perturbed array<double>, radius double, delta_alpha double"


def perturb_rdp(queries: DataFrame, alpha: float, epsilon: float, dim: int, seed: int = 42, forced_radius: float | None = None, clip_forced: bool = False) -> DataFrame:
    """q + r v, not normalised again: v uniform on the sphere, r = sigma chi(dim) held to [mean radius, r_max].

    queries(query_id, qv, r_max); unusable vectors are left out.
    """
    s = math.sqrt(alpha / (2 * epsilon))
    return queries.select("query_id", "qv", F.col("r_max").cast("double")).mapInArrow(_perturb("chi", dim, s, s * math.sqrt(dim), seed, forced_radius, clip_forced), _SCHEMA)


def perturb_distance(queries: DataFrame, epsilon: float, dim: int, seed: int = 42) -> DataFrame:
    """q + r v with r from Gamma(dim, 1 / epsilon).  queries(query_id, qv)."""
    return queries.select("query_id", "qv", F.lit(0.0).alias("r_max")).mapInArrow(_perturb("gamma", dim, 1 / epsilon, 0.0, seed, None, False), _SCHEMA)


def distance_candidates(scored: DataFrame, shifts: DataFrame, k: int, cap: int | None = None) -> DataFrame:
    """Candidates of a perturbed query: as many documents, nearest first, as lie within the k-th angle plus the query's shift.

    scored(query_id, doc_idx, rank, theta) by the perturbed query, shifts(query_id, delta_alpha); at least k, at most ``cap``.
    """
    kth = scored.filter(F.col("rank") == k).select("query_id", F.col("theta").alias("kth"))
    n = (
        scored.join(kth, "query_id").join(shifts, "query_id")
        .groupBy("query_id").agg(F.count_if(F.col("theta") <= F.col("kth") + F.col("delta_alpha") + 1e-12).alias("n"))
        .select("query_id", F.greatest(F.lit(k), F.least(F.col("n"), F.lit(cap)) if cap else F.col("n")).alias("n_candidates"))
    )
    return scored.join(n, "query_id").filter(F.col("rank") <= F.col("n_candidates"))
