"""Worksets: which units of a corpus become the searched collection, and what they look like.

Units are rows (ord, source, v): a dense order, the source document and the
vector.  The selectors see documents only, never queries or judgements.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions.vectors import dot, l2, norm
from vectrine.operators import clustering as cl
from vectrine.operators.knn import against_centers
from vectrine.operators.sampling import global_index, hash_sample, proportional_quotas, quantiles
from vectrine.operators.text import duplicate_ids, passages, simhash64, tokens, two_tier_dedup
from vectrine.plans.materialize import Scratch

# Fixed values of the main configuration.
COARSE_CLUSTERS = 64
POOL_LEAST = 100_000


def coarse_clusters(units: int, most: int = COARSE_CLUSTERS) -> int:
    """Clusters of the coarse partition: sqrt(n / 2), at least 4, at most ``most`` and n."""
    return min(most, max(4, round(math.sqrt(units / 2))), units)


def pool_size(target: int, total: int, least: int = POOL_LEAST) -> int:
    """Units that are encoded before the selection."""
    return min(total, max(target, least))


def first_units(units: DataFrame, n: int) -> DataFrame:
    """The pool of the first n units in their order."""
    return units.orderBy("ord").limit(n)


def reusable_prefix(units: DataFrame, cache: DataFrame) -> int:
    """How many of the first units, in their order from 0, a cache (ord, doc_id) of encoded units still fits."""
    both = units.select("ord", F.col("doc_id").alias("a")).join(cache.select("ord", F.col("doc_id").alias("b")), "ord", "full")
    first = both.filter(~F.col("a").eqNullSafe(F.col("b"))).agg(F.min("ord")).first()[0]
    return int(first) if first is not None else units.count()


def unit_pool(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, what the removal of near-duplicates found): units(ord, doc_id, source, text, simhash) of corpus(doc_id, text).

    Documents are cut into passages, and near-duplicates go, within a source
    and then over all.  A source id that stands twice is an error.
    """
    scratch = Scratch(corpus.sparkSession)
    if not duplicate_ids(corpus, F.col("doc_id")).isEmpty():
        raise ValueError("a source document stands more than once")
    cut = scratch.cut(passages(corpus, F.col("doc_id"), F.col("text")).select("doc_id", F.col("source_doc_id").alias("source"), "unit_no", "text"))
    ranked = scratch.cut(global_index(cut, "source", "unit_no").withColumnRenamed("index", "ord").select("ord", "doc_id", "source", "text"))
    hashes = simhash64(ranked, F.col("ord"), tokens(F.col("text"))).withColumnRenamed("id", "ord")
    full = scratch.cut(ranked.join(hashes, "ord"))
    removed = scratch.cut(two_tier_dedup(full.select("ord", "source", "simhash")))
    return full.join(removed.filter("removed is null").select("ord"), "ord", "left_semi"), removed


def geometry_sample(units: DataFrame, labels: DataFrame, centers: DataFrame, target: int, cap: int = 0) -> DataFrame:
    """(ord, cluster_id, fill): ``target`` units that keep the shares of the coarse clusters, nearest to the centers first, at most ``cap`` of a source (0: no limit).

    Clusters take their quotas in turn, so what an earlier cluster took counts
    towards a source's cap.  If units are missing then, they are taken in the
    order of clusters and distances, first within the cap (``fill`` 1), then
    beyond it (``fill`` 2).  Fewer than ``target`` units are an error.
    """
    spark, scratch = units.sparkSession, Scratch(units.sparkSession)
    d = units.join(labels.select("ord", "cluster_id"), "ord").join(centers.select("cluster_id", "center"), "cluster_id")
    rows = scratch.cut(d.select("ord", "source", "cluster_id", F.round(l2(F.col("v"), F.col("center")), 9).alias("d")))
    n = rows.count()
    if n < target:
        raise ValueError(f"{target} units were asked for, and there are {n}")
    if n == target:
        return rows.select("ord", "cluster_id", F.lit(0).alias("fill"))
    quota = scratch.cut(proportional_quotas(rows.groupBy(F.col("cluster_id").alias("group")).count(), target).select(F.col("group").alias("cluster_id"), "quota"))
    within, of_source = Window.partitionBy("cluster_id").orderBy("d", "ord"), Window.partitionBy("cluster_id", "source").orderBy("d", "ord")
    ranked = scratch.cut(rows.join(quota, "cluster_id").withColumn("nth", F.row_number().over(of_source)))
    used = spark.createDataFrame([], f"cluster_id {rows.schema['cluster_id'].dataType.simpleString()}, source {rows.schema['source'].dataType.simpleString()}, used long")
    before = Window.partitionBy("source").orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    last = None
    while True:
        # what the clusters before took of a source, as far as known: right for one more cluster each round
        open_rows = ranked.join(used, (ranked["cluster_id"] == used["cluster_id"]) & ranked["source"].eqNullSafe(used["source"]), "left").select(ranked["*"], F.coalesce("used", F.lit(0)).alias("used"))
        if cap > 0:
            open_rows = open_rows.filter(F.col("nth") + F.col("used") <= cap)
        picked = scratch.cut(open_rows.withColumn("r", F.row_number().over(within)).filter(F.col("r") <= F.col("quota")).select("ord", "source", "cluster_id"))
        state = picked.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("ord"))).first()
        if cap <= 0 or state == last:
            break
        last = state
        taken = picked.groupBy("source", "cluster_id").agg(F.count(F.lit(1)).alias("k"))
        grid = ranked.select("source", "cluster_id").distinct().join(taken.withColumnsRenamed({"source": "s", "cluster_id": "c"}), (F.col("c") == F.col("cluster_id")) & F.col("s").eqNullSafe(F.col("source")), "left")
        used = scratch.cut(grid.select("cluster_id", "source", F.coalesce(F.sum(F.coalesce("k", F.lit(0))).over(before), F.lit(0)).alias("used")).filter("used > 0"))
    out = picked.select("ord", "cluster_id", F.lit(0).alias("fill"))
    have = picked
    for fill in (1, 2):
        missing = target - have.count()
        if missing <= 0:
            break
        left = rows.join(have.select("ord"), "ord", "left_anti")
        if fill == 1:
            if cap <= 0:
                continue
            took = have.groupBy("source").agg(F.count(F.lit(1)).alias("used")).withColumnRenamed("source", "s")
            w = Window.partitionBy("source").orderBy("cluster_id", "d", "ord")
            left = left.withColumn("nth", F.row_number().over(w)).join(took, F.col("s").eqNullSafe(F.col("source")), "left").filter(F.col("nth") + F.coalesce("used", F.lit(0)) <= cap)
        more = scratch.cut(left.orderBy("cluster_id", "d", "ord").limit(missing).select("ord", "source", "cluster_id"))
        out = out.unionByName(more.select("ord", "cluster_id", F.lit(fill).alias("fill")))
        have = scratch.cut(have.unionByName(more))
    return out


def sample_shares(labels: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: L1 and largest difference between the clusters' shares of all units and of the sample, and its largest source share."""
    full = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    part = sample.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("m"))
    both = full.join(part, "cluster_id", "left").select("n", F.coalesce("m", F.lit(0)).alias("m"))
    total = both.agg(F.sum("n").alias("tn"), F.sum("m").alias("tm"))
    gap = F.abs(F.col("m") / F.greatest("tm", F.lit(1)) - F.col("n") / F.greatest("tn", F.lit(1)))
    return both.crossJoin(total).agg(F.round(F.sum(gap), 9).alias("l1"), F.round(F.max(gap), 9).alias("linf"))  # one row


def core_selection(units: DataFrame, labels: DataFrame, centers: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """(chosen(ord, cluster_id, similarity), one row of scores): the ``capacity`` units of each cluster most similar to its center.

    Scores: whether every cluster has that many, the mean similarity, the
    smallest, middle and largest cluster, the mean margin to the next center,
    and the mean distance of the chosen units' mean directions.
    """
    scratch = Scratch(units.sparkSession)
    c = centers.select("cluster_id", "center")
    near = against_centers(units, F.col("ord"), F.col("v"), c)
    own = near.join(labels.select(F.col("ord").alias("id"), F.col("cluster_id").alias("own")), "id").withColumn("s", F.cos("value"))
    per = own.groupBy("id").agg(F.max(F.when(F.col("cluster_id") == F.col("own"), F.col("s"))).alias("similarity"), F.max(F.when(F.col("cluster_id") != F.col("own"), F.col("s"))).alias("next"), F.first("own").alias("cluster_id"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    chosen = scratch.cut(per.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= capacity))
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    means = cl.centroids(chosen.select(F.col("id").alias("ord"), "cluster_id").join(units.select("ord", "v"), "ord").select("cluster_id", "v"), len(units.select("v").first()["v"]))
    support = sizes.agg(F.min("n").alias("support_min"), F.percentile("n", F.lit(0.5)).alias("support_p50"), F.max("n").alias("support_max"))
    core = chosen.agg(F.round(F.avg("similarity"), 6).alias("core_similarity"), F.round(F.avg(F.col("similarity") - F.col("next")), 6).alias("margin"))
    scores = support.crossJoin(core).crossJoin(cl.center_separation(means).select(F.col("separation_mean").alias("separation"))).withColumn("feasible", F.col("support_min") >= capacity)  # one row each
    return chosen.select(F.col("id").alias("ord"), "cluster_id", "similarity"), scores


def best_core(scores: DataFrame) -> DataFrame:
    """(seed, ..., best): the feasible seed of the largest similarity, then smallest and middle cluster, then margin; the first of equals wins."""
    key = F.struct("feasible", "core_similarity", "support_min", "support_p50", "margin", (-F.col("seed")).alias("first"))
    top = scores.filter("feasible").agg(F.max(key).alias("top"))
    return scores.crossJoin(top).withColumn("best", F.coalesce(-F.col("top.first") == F.col("seed"), F.lit(False))).drop("top")  # one row a seed


def core_seed_sweep(units: DataFrame, clusters: int, capacity: int, seeds: range, dim: int) -> tuple[DataFrame, DataFrame]:
    """(chosen(ord, cluster_id, similarity), scores by seed): the best of the core selections over k-means partitions of several seeds; none feasible is an error."""
    spark, scratch = units.sparkSession, Scratch(units.sparkSession)
    found, rows = {}, None
    docs = units.select(F.col("ord").alias("doc_idx"), "v")
    for s in seeds:
        labels = scratch.cut(cl.spherical_kmeans(docs, clusters, s, dim).withColumnRenamed("doc_idx", "ord"))
        centers = scratch.cut(cl.centroids(units.select("ord", "v").join(labels, "ord").select("cluster_id", "v"), dim))
        found[s], score = core_selection(units, labels, centers, capacity)
        score = score.select(F.lit(s).alias("seed"), "*")
        rows = score if rows is None else rows.unionByName(score)
    scores = scratch.cut(best_core(scratch.cut(rows)))
    best = scores.filter("best").select("seed").first()
    if best is None:
        raise ValueError(f"no seed gives {clusters} clusters of {capacity}")
    return found[best["seed"]], scores


def geometry_summary(units: DataFrame, pairs: int = 20_000, seed: int = 42) -> DataFrame:
    """One row: norms of the vectors, and inner products of ``pairs`` random pairs of different units by a seeded hash: smallest, quantiles, mean, largest.

    ``ord`` is dense from 0, so a pair is two hashed numbers.
    """
    spark, scratch = units.sparkSession, Scratch(units.sparkSession)
    n = units.count()
    m = min(pairs, max(1, n * (n - 1) // 2))
    pick = lambda side: F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"), F.lit(f":{side}")), 256), 1, 15), 16, 10).cast("long"), F.lit(max(1, n)))
    p = spark.range(m).select(pick("a").alias("a"), pick("b").alias("b")).filter("a <> b")
    u = units.select("ord", "v")
    met = p.join(u.select(F.col("ord").alias("a"), F.col("v").alias("x")), "a").join(u.select(F.col("ord").alias("b"), F.col("v").alias("y")), "b")
    out = None
    for name, t in (("norm", units.select(norm(F.col("v")).alias("x"))), ("pair", met.select(dot(F.col("x"), F.col("y")).alias("x")))):
        t = scratch.cut(t)
        mid, high = quantiles(t, "x", (0.5, 0.95))
        row = t.agg(F.count(F.lit(1)).alias(f"{name}s"), *(F.round(f("x"), 6).alias(f"{name}_{f.__name__.replace('avg', 'mean')}") for f in (F.min, F.avg, F.max)))
        row = row.withColumns({f"{name}_p50": F.round(F.lit(mid).cast("double"), 6), f"{name}_p95": F.round(F.lit(high).cast("double"), 6)})
        out = row if out is None else out.crossJoin(row)  # one row each
    return out


@dataclass
class Workset:
    """The chosen units (doc_idx, doc_id, source, text, v), their coarse clusters, and what was left on the way."""

    docs: DataFrame
    clusters: DataFrame
    counts: dict[str, int]


def build_workset(units: DataFrame, target: int, dim: int, mode: str = "geometry", clusters: int = 0, cap: int = 0, seeds: range = range(1), least_pool: int = POOL_LEAST) -> Workset:
    """From units without near-duplicates (ord, doc_id, source, text, v) to a workset of ``target`` documents, numbered in the order of the units.

    The pool is the first units by their order ('core'), or by stable hash
    ('geometry').  'geometry' keeps the shares of a coarse partition; 'core'
    takes the cores of ``clusters`` clusters of the best seed.
    """
    scratch = Scratch(units.sparkSession)
    total = units.count()
    n = pool_size(target, total, least_pool)
    if mode == "core":
        pool = scratch.cut(first_units(units, n))
        chosen, _ = core_seed_sweep(pool, clusters, target // clusters, seeds, dim)
    elif mode == "geometry":
        keep = hash_sample(units, F.col("doc_id"), F.col("source"), n).withColumnRenamed("record", "doc_id")
        pool = scratch.cut(units.join(keep, "doc_id", "left_semi") if n < total else units)
        docs = pool.select(F.col("ord").alias("doc_idx"), "v")
        labels = scratch.cut(cl.spherical_kmeans(docs, coarse_clusters(n), 42, dim).withColumnRenamed("doc_idx", "ord"))
        centers = cl.centroids(pool.join(labels, "ord").select("cluster_id", "v"), dim)
        chosen = geometry_sample(pool, labels, scratch.cut(centers), target, cap)
    else:
        raise ValueError(f"unknown mode {mode}")
    chosen = scratch.cut(chosen.select("ord", "cluster_id"))
    docs = scratch.cut(global_index(pool.join(chosen, "ord").select("ord", "doc_id", "source", "text", "v", "cluster_id"), "ord").withColumnRenamed("index", "doc_idx"))
    return Workset(docs.select("doc_idx", "doc_id", "source", "text", "v"), docs.select("doc_idx", "cluster_id"), {"units": total, "pool": n, "docs": docs.count()})


def source_summary(docs: DataFrame) -> DataFrame:
    """One row: sources, smallest, middle, 90 % and largest number of documents of a source, and the largest one's share."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    mid, high = quantiles(n, "n", (0.5, 0.9))
    return n.agg(F.count(F.lit(1)).alias("sources"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.round(F.max("n") / F.sum("n"), 9).alias("dominance")).withColumns({"p50": F.lit(mid).cast("double"), "p90": F.lit(high).cast("double")})


def subset_by_offsets(parent: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_idx, offset, ...): the rows of a parent (offset, ...) that ``wanted`` (offset, place) names, numbered by their place; an offset that the parent lacks is an error."""
    missing = wanted.join(parent.select("offset"), "offset", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"the parent has no offsets {[r['offset'] for r in missing]}")
    return wanted.select("offset", F.col("place").alias("doc_idx")).join(parent, "offset")


def local_offsets(hits: DataFrame, limit: int) -> DataFrame:
    """(query_id, offsets): the different offsets below ``limit`` of each query's list, in its order: hits(query_id, offsets)."""
    return hits.select("query_id", F.array_distinct(F.filter("offsets", lambda x: x.isNotNull() & (x >= 0) & (x < limit))).alias("offsets"))


def first_offsets(hits: DataFrame, n: int) -> DataFrame:
    """(query_id, place, offset): the first n offsets of each query, a row each."""
    return hits.select("query_id", F.posexplode(F.slice("offsets", 1, n)).alias("place", "offset"))


def offset_id(offset: Column, prefix: str = "offset_") -> Column:
    """The document id of an offset."""
    return F.concat(F.lit(prefix), offset.cast("string"))
