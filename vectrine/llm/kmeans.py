"""Mini-batch k-means by angle, and the bounded samples that models are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.functions.arrow_vectors import usable

#: Most rows that a model is fitted on.
SAMPLE_ROWS = 16384


def bounded_sample(df: DataFrame, record: Column, vector: Column, dim: int, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, int]:
    """Record ids and unit vectors of at most ``rows`` records, and the number of all rows.

    The records of the smallest hashes are taken, so the choice depends on
    neither file order nor partitions.  Only fitting uses the sample; whatever
    is fitted is then applied to every row.
    """
    total = df.count()
    h = F.xxhash64(record)
    picked = df.select(record.cast("long").alias("id"), vector.alias("v"), h.alias("h")).filter("id is not null and v is not null")
    if total > 2 * rows:
        share = 2 * rows / total
        picked = picked.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    t = picked.orderBy(F.pmod("h", F.lit(1 << 30)), "id").limit(rows).select("id", "v").toArrow()
    at, m, norms = usable(t.column("v"), dim)
    ids = t.column("id").to_numpy()[at]
    ids, first = np.unique(ids, return_index=True)
    m, norms = m[first], norms[first]
    return ids, (m / norms[:, None]).astype(np.float32), total


def mini_batch_kmeans(x: np.ndarray, k: int, seed: int = 42, batch: int = 1024, rounds: int = 60) -> np.ndarray:
    """Unit-length centers of at most ``k`` clusters of unit vectors.

    Seeds are spread by squared distance on one batch; each round then moves
    the centers towards the mean of a random batch, by a rate that falls with
    the number of rows a center has seen.
    """
    rng = np.random.default_rng(seed)
    n = len(x)
    k = min(k, n)
    if k == 0:
        return np.empty((0, x.shape[1]), np.float32)
    pool = x[rng.choice(n, min(n, max(4 * k, batch)), replace=False)]
    centers = np.empty((k, x.shape[1]), np.float32)
    centers[0] = pool[0]
    far = np.maximum(0, 2 - 2 * pool @ centers[0])
    for j in range(1, k):
        total = far.sum()
        pick = rng.choice(len(pool), p=far / total) if total > 1e-9 else rng.integers(len(pool))
        centers[j] = pool[pick]
        far = np.minimum(far, np.maximum(0, 2 - 2 * pool @ centers[j]))
    seen = np.ones(k)
    for _ in range(rounds):
        b = x[rng.choice(n, min(n, max(batch, 2 * k)), replace=False)]
        label = (b @ centers.T).argmax(1)
        count = np.bincount(label, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, label, b)
        seen += count
        hit = count > 0
        rate = (count[hit] / seen[hit])[:, None]
        moved = centers[hit] * (1 - rate) + total[hit] / count[hit][:, None] * rate
        centers[hit] = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
    return centers
