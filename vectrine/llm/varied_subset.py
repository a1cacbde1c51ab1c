"""Choosing a varied subset.

Method: mini-batch k-means over the vectors, square-root (or equal) quotas per
cluster, and sampling within the quotas; slots that a small cluster can't use
go to the others.  Two refinements serve strays and near-copies.  With a
``stray`` bound, the rows of a cluster that are far from its center are a
stratum of their own, each of them a group of one.  And within a stratum, rows
that share a sign code (equal vectors and many near-copies do) have one row
that stands for them; no code gets a second row before each has had one.  The
size of a stratum is its number of codes, so a clump of copies is no large
group; only when every code is served, the other rows get slots.  Codes get
longer with the number of rows, so their number has no ceiling.

A stratum's sample is its rows of smallest hash.  How far the hashes go is read
off a histogram; only the rows of one bin are put in order, so no task sees a
whole stratum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions.arrow_vectors import take, usable
from vectrine.llm.kmeans import SAMPLE_ROWS, bounded_sample, mini_batch_kmeans
from vectrine.plans.materialize import Scratch


@dataclass(frozen=True)
class SubsetConfig:
    """``clusters`` and ``fit_rows`` bound the model; every row is then assigned."""

    dim: int = 64
    clusters: int = 256
    fit_rows: int = SAMPLE_ROWS
    quota: str = "sqrt"  # or "equal"
    #: Rows whose cosine with their center is below this are strays; none are, if None.
    stray: float | None = None
    #: Bits of a sign code at least; one more for each time the rows double beyond 2 ** code_bits.
    code_bits: int = 16
    seed: int = 42


def quotas(sizes: np.ndarray, target: int, kind: str, singles: np.ndarray | None = None) -> np.ndarray:
    """Slots of each stratum: in proportion to the square root of its size (or equal), never above its size; what a stratum can't use is dealt again.

    With square roots, a stratum marked in ``singles`` holds groups of one and
    counts with its whole size.
    """
    sizes = np.asarray(sizes, np.int64)
    target = int(min(target, sizes.sum()))
    if target <= 0:
        return np.zeros(len(sizes), np.int64)
    want = np.sqrt(sizes) if kind == "sqrt" else np.ones(len(sizes))
    if kind == "sqrt" and singles is not None:
        want = np.where(singles, sizes, want)
    out = np.zeros(len(sizes), np.int64)
    while (left := target - out.sum()) > 0:
        room = out < sizes
        share = np.where(room, want, 0)
        share = share / share.sum() * left
        add = np.minimum(np.floor(share).astype(np.int64), sizes - out)
        if add.sum() == 0:  # less than one slot each: the largest remainders, then the larger strata
            order = np.lexsort((np.arange(len(sizes)), -sizes, -share))
            order = order[room[order]][:left]
            add[order] = 1
        out += add
    return out


def _assign(cfg: SubsetConfig, centers: np.ndarray, bits: int):
    planes = np.random.default_rng(cfg.seed).standard_normal((cfg.dim, bits)).astype(np.float32)
    power = (1 << np.arange(bits)).astype(np.int64)

    def run(batches):
        for b in batches:
            rows, m, norms = usable(b.column(1), cfg.dim)
            if len(rows) == 0:
                continue
            u = (m / norms[:, None]).astype(np.float32)
            s = u @ centers.T
            best = s.argmax(1)
            far = s[np.arange(len(u)), best] < (-2 if cfg.stray is None else cfg.stray)
            code = ((u @ planes) > 0) @ power
            # strata: 2c near the center c, 2c + 1 far from it
            yield pa.record_batch([take(b.column(0), rows), pa.array((2 * best + far).astype(np.int32)), pa.array(code)], ["id", "stratum", "code"])

    return run


#: Bins of the histogram of hashes of a stratum.
BINS = 1 << 12


def _smallest(rows: DataFrame, slots: dict[int, int]) -> DataFrame:
    """Of rows (id, stratum, h), those of smallest h of each stratum, as many as it has slots."""
    spark = rows.sparkSession
    quota = F.broadcast(spark.createDataFrame(list(slots.items()), "stratum int, quota long"))  # at most two rows a cluster
    binned = rows.withColumn("bin", F.shiftrightunsigned("h", 64 - BINS.bit_length() + 1).cast("int"))
    upto = Window.partitionBy("stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    last = bins.join(quota, "stratum").filter((F.col("before") < F.col("quota")) & (F.col("before") + F.col("n") >= F.col("quota"))).select("stratum", F.col("bin").alias("last"), (F.col("quota") - F.col("before")).alias("left"))
    cut = binned.join(F.broadcast(last), "stratum")
    w = Window.partitionBy("stratum").orderBy("h", "id")  # one bin of a stratum
    edge = cut.filter(F.col("bin") == F.col("last")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.col("left"))
    return cut.filter(F.col("bin") < F.col("last")).select("id", "stratum").unionByName(edge.select("id", "stratum"))


def varied_subset(df: DataFrame, record: Column, vector: Column, share: float | None = None, count: int | None = None, cfg: SubsetConfig = SubsetConfig()) -> DataFrame:
    """(id, cluster, stray): ``count`` records, or the ``share`` of all usable ones rounded half up, that cover the variety of the vectors.

    Vectors that are null, all zero, of the wrong length or not finite can't be
    chosen; a repeated id counts once; rows without an id are left out.  If
    fewer records are usable than asked for, all are chosen.  An empty table
    gives an empty result.  The choice is the same in every run.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(record.cast("long").alias("id"), vector.alias("v")).filter("id is not null and v is not null")
    _, sample, total = bounded_sample(rows, F.col("id"), F.col("v"), cfg.dim, cfg.fit_rows)
    if len(sample) == 0:
        return spark.createDataFrame([], "id long, cluster int, stray boolean")
    centers = mini_batch_kmeans(sample, cfg.clusters, cfg.seed)
    bits = min(62, max(cfg.code_bits, int(total).bit_length()))
    placed = rows.mapInArrow(_assign(cfg, centers, bits), "id long, stratum int, code long").groupBy("id").agg(F.min_by("stratum", F.struct("stratum", "code")).alias("stratum"), F.min_by("code", F.struct("stratum", "code")).alias("code"))
    placed = scratch.cut(placed.withColumn("h", F.xxhash64("id", F.lit(cfg.seed))))
    codes = scratch.cut(placed.groupBy("stratum", "code").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "id")).alias("x")).select("stratum", "n", "x.h", "x.id"))
    sizes = codes.groupBy("stratum").agg(F.count(F.lit(1)).alias("codes"), F.sum("n").alias("n")).orderBy("stratum").toArrow()  # at most two rows a cluster
    n, variety = sizes.column("n").to_numpy(), sizes.column("codes").to_numpy()
    target = count if count is not None else int(np.floor(share * n.sum() + 0.5))
    slots = quotas(variety, target, cfg.quota, sizes.column("stratum").to_numpy() % 2 == 1)
    more = quotas(n - variety, target - slots.sum(), cfg.quota)
    names = sizes.column("stratum").to_pylist()
    out = _smallest(codes.select("id", "stratum", "h"), dict(zip(names, map(int, slots))))
    if more.sum():  # every code is served
        rest = placed.join(codes.select("id"), "id", "left_anti").select("id", "stratum", "h")
        out = out.unionByName(_smallest(rest, dict(zip(names, map(int, more)))))
    return out.select("id", F.shiftright("stratum", 1).alias("cluster"), (F.col("stratum") % 2 == 1).alias("stray"))
