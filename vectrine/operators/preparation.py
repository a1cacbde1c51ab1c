"""Query sets and worksets: annotation, ordering, selection, growth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions.arrow_vectors import list_column
from vectrine.operators.privacy import stream
from vectrine.operators.sampling import first_of, unit_hash

#: Weight of the nearest document's angle in the semantic score.
DOC_WEIGHT = 0.35


def annotate(queries: DataFrame, ranked_centers: DataFrame, truth: DataFrame, assignment: DataFrame, near: DataFrame, eval_k: int) -> DataFrame:
    """One row a query: nearest cluster and document, semantic score, majority cluster of the exact neighbours, coverage and ideal r_max.

    ranked_centers(query_id, cluster_id, theta, rank), truth(query_id, rank,
    doc_idx, theta) (the exact eval_k), assignment(doc_idx, cluster_id),
    near(query_id, doc_idx, theta) (the fixed_k nearest in the nearest cluster).
    """
    center = ranked_centers.filter("rank = 1").select("query_id", F.col("cluster_id").alias("nearest_cluster_id"), F.col("theta").alias("nearest_center_theta"))
    gt = truth.join(assignment, "doc_idx")
    doc = truth.filter("rank = 1").select("query_id", F.col("theta").alias("nearest_doc_theta"))
    top = gt.filter("rank = 1").select("query_id", F.col("cluster_id").alias("top1_cluster_id"))
    major = first_of(gt.groupBy("query_id", "cluster_id").agg(F.count(F.lit(1)).alias("n")), ("query_id",), F.desc("n"), F.asc("cluster_id")).select("query_id", F.col("cluster_id").alias("majority_cluster_id"), F.col("n").alias("majority_count"))
    worst = truth.groupBy("query_id").agg(F.max("theta").alias("worst"))
    inside = gt.join(center, "query_id").groupBy("query_id").agg(F.count_if(F.col("cluster_id") == F.col("nearest_cluster_id")).alias("in_cluster"))
    hits = near.join(truth.select("query_id", "doc_idx"), ["query_id", "doc_idx"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    edge = near.groupBy("query_id").agg(F.max("theta").alias("edge"))
    q = queries.select("query_id").join(center, "query_id").join(doc, "query_id").join(top, "query_id").join(major, "query_id").join(worst, "query_id")
    q = q.join(inside, "query_id", "left").join(hits, "query_id", "left").join(edge, "query_id", "left")
    full = F.coalesce("hits", F.lit(0)) == eval_k
    return q.select(
        "query_id", "nearest_cluster_id", "nearest_center_theta", "nearest_doc_theta", F.round(F.col("nearest_center_theta") + DOC_WEIGHT * F.col("nearest_doc_theta"), 9).alias("semantic_score"),
        "top1_cluster_id", "majority_cluster_id", (F.col("majority_count") == eval_k).alias("single_cluster"),
        (F.coalesce("hits", F.lit(0)) / F.lit(eval_k)).alias("cover_fixed"), full.alias("cover_fixed_full"),
        (F.coalesce("in_cluster", F.lit(0)) / F.lit(eval_k)).alias("cover_cluster"), (F.coalesce("in_cluster", F.lit(0)) == eval_k).alias("cover_cluster_full"),
        F.round(F.when(full, F.tan(F.greatest((F.col("edge") - F.col("worst")) / 2, F.lit(0.0)))).otherwise(0.0), 9).alias("ideal_r_max"),
    )


def calibration_order() -> tuple[Column, ...]:
    """Covered queries first, then real ones, larger ideal r_max, lower score, id."""
    return (F.desc("cover_fixed_full"), F.desc("cover_cluster_full"), F.desc("is_real"), F.desc("ideal_r_max"), F.asc("semantic_score"), F.asc("query_id"))


def evaluation_order(seed: int | None = None) -> tuple[Column, ...]:
    """With a seed, real queries by stable hash; else by coverage, consistency and score."""
    if seed is not None:
        return (F.desc("is_real"), unit_hash(F.concat(F.lit(f"{seed}::"), F.col("query_id").cast("string"))).asc(), F.asc("query_id"))
    return (F.desc("is_real"), F.desc("cover_cluster_full"), F.desc("single_cluster"), F.asc("semantic_score"), F.asc("query_id"))


def top_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def balanced_sets(annotated: DataFrame, group: str, calibration: int, evaluation: int, seed: int | None = None) -> DataFrame:
    """(query_id, role): per cluster, the first calibration queries, then the first evaluation queries among the rest."""
    cal = top_per_group(annotated, group, calibration, *calibration_order()).select("query_id", F.lit("calibration").alias("role"))
    rest = annotated.join(cal, "query_id", "left_anti")
    return cal.unionByName(top_per_group(rest, group, evaluation, *evaluation_order(seed)).select("query_id", F.lit("evaluation").alias("role")))


def fast_sets(annotated: DataFrame, calibration: int, evaluation: int, seed: int | None = None) -> DataFrame:
    """(query_id, role) over all clusters at once."""
    cal = annotated.orderBy(*calibration_order()).limit(calibration).select("query_id", F.lit("calibration").alias("role"))
    rest = annotated.join(cal, "query_id", "left_anti")
    return cal.unionByName(rest.orderBy(*evaluation_order(seed)).limit(evaluation).select("query_id", F.lit("evaluation").alias("role")))


def calibration_after_evaluation(annotated: DataFrame, excluded: DataFrame, group: str, target: int, clusters: int) -> DataFrame:
    """(query_id): of each of ``clusters`` clusters the first ceil(target / clusters) queries in calibration order, without the excluded ones.

    What exceeds ``target`` is cut at the end of the order (cluster,
    calibration order); what is missing comes from the best of the rest.
    """
    each = max(1, -(-target // max(1, clusters)))
    pool = annotated.join(excluded.select("query_id"), "query_id", "left_anti")
    ranked = pool.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*calibration_order()))).filter(F.lit(target) > 0)
    first = ranked.filter(F.col("_r") <= each).orderBy(group, "_r").limit(max(0, target)).select("query_id")
    short = target - first.count()
    if short <= 0:
        return first
    return first.unionByName(ranked.filter(F.col("_r") > each).orderBy(*calibration_order()).limit(short).select("query_id"))


def random_real_set(candidates: DataFrame, target: int, seed: int, sourced: bool = True) -> DataFrame:
    """(query_id): the first ``target`` real candidates by stable hash, then id; ``sourced``: only those with a source query.

    candidates(query_id, is_real, source_query_id).  None at all is an error.
    """
    real = candidates.filter("is_real")
    if sourced:
        real = real.filter(F.trim("source_query_id") != "")
    key = unit_hash(F.concat(F.lit(f"{seed}::"), F.col("query_id").cast("string")))
    out = real.orderBy(key, "query_id").limit(target).select("query_id")
    if out.isEmpty():
        raise ValueError("no real candidates to choose from")
    return out


def calibration_only(candidates: DataFrame, target: int, forbidden: DataFrame | None = None) -> DataFrame:
    """(query_id): the first ``target`` candidates in calibration order that aren't forbidden."""
    pool = candidates if forbidden is None else candidates.join(forbidden.select("query_id"), "query_id", "left_anti")
    return pool.orderBy(*calibration_order()).limit(max(0, target)).select("query_id")


def first_n_sets(queries: DataFrame, calibration: int, evaluation: int, seed: int) -> DataFrame:
    """(query_id, role): by seeded hash, the first ``calibration`` queries and the next ``evaluation``; too few are an error."""
    top = queries.select("query_id").distinct().withColumn("h", F.sha2(F.concat(F.lit(f"{seed}::"), F.col("query_id").cast("string")), 256)).orderBy("h", "query_id").limit(calibration + evaluation)
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy("h", "query_id")))  # as many rows as are chosen
    if ranked.count() < calibration + evaluation:
        raise ValueError(f"fewer than {calibration + evaluation} queries")
    return ranked.select("query_id", F.when(F.col("r") <= calibration, "calibration").otherwise("evaluation").alias("role"))


def supported_examples(examples: DataFrame, locale: str, small_version: bool) -> DataFrame:
    """Examples of a locale with a query, a product and a label, of the small version only if asked for: examples(query_id, query, product_id, locale, label, small_version)."""
    filled = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "" for c in ("query", "product_id", "label")]
    kept = examples.filter((F.col("locale") == locale) & filled[0] & filled[1] & filled[2])
    return kept.filter("small_version = 1") if small_version else kept


def first_products(products: DataFrame, chosen: DataFrame, locale: str, order: str) -> DataFrame:
    """The first row of each chosen product of a locale, in the order of ``order``: products(product_id, locale, ...)."""
    rows = products.filter(F.col("locale") == locale).join(chosen.select("product_id"), "product_id", "left_semi")
    return first_of(rows, ("product_id",), F.asc(order))


def grow_pool(pool: DataFrame, extra: DataFrame, qrels: DataFrame, target: int, seed: int, words: tuple[int, int] = (2, 24)) -> DataFrame:
    """Rows (query_id, text) of ``extra`` that bring the pool to ``target``: judged, new in id and in text, of 2 to 24 words, in hash order."""
    n = F.size(F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != ""))
    new = extra.filter(n.between(*words)).join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    new = new.join(pool.select("query_id"), "query_id", "left_anti").join(pool.select("text"), "text", "left_anti")
    one = first_of(new, ("text",), F.asc("query_id"))
    need = max(0, target - pool.count())
    return one.orderBy(unit_hash(F.concat(F.lit(f"{seed}::"), F.col("query_id").cast("string"))), "query_id").limit(need).select("query_id", "text")


def product_support(judgements: DataFrame) -> DataFrame:
    """(product_id, support): how many judgements name a product; judgements(query_id, product_id, positive)."""
    return judgements.groupBy("product_id").agg(F.count(F.lit(1)).alias("support"))


def query_support(judgements: DataFrame) -> DataFrame:
    """(query_id, rows, positives) of each query."""
    return judgements.groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.when(F.col("positive"), F.col("product_id"))).alias("positives"))


def select_products(support: DataFrame, products: DataFrame, n: int) -> DataFrame:
    """(product_id, support): the n products of most support, ties by id; products without judgements fill what is left."""
    fill = products.select("product_id").distinct().join(support, "product_id", "left_anti").select("product_id", F.lit(0).cast("long").alias("support"))
    return support.select("product_id", "support").unionByName(fill).orderBy(F.desc("support"), "product_id").limit(n)


def select_queries_by_overlap(judgements: DataFrame, chosen: DataFrame, n: int, seed: int) -> DataFrame:
    """(query_id, overlap, positives): queries with most positives among the chosen products, then most positives, then by hash."""
    pos = judgements.filter("positive").select("query_id", "product_id").distinct()
    hit = pos.join(chosen.select("product_id"), "product_id", "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("overlap"))
    t = hit.join(pos.groupBy("query_id").agg(F.count(F.lit(1)).alias("positives")), "query_id")
    key = F.sha2(F.concat(F.lit(f"{seed}::"), F.col("query_id").cast("string")), 256)
    return t.orderBy(F.desc("overlap"), F.desc("positives"), key, "query_id").limit(n)


def workset_positives(qrels: DataFrame, docs: DataFrame, aliases) -> DataFrame:
    """(query_id, doc_id): documents of the workset whose source has an alias that the judgements name.  qrels(query_id, source_id), docs(doc_id, source_id)."""
    a = docs.select("doc_id", F.explode(aliases(F.col("source_id"))).alias("source_id"))
    return qrels.select("query_id", F.explode(aliases(F.col("source_id"))).alias("source_id")).join(a, "source_id").select("query_id", "doc_id").distinct()


def _mixes(dim: int, seed: int):
    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            ids, no = b.column(0).to_pylist(), b.column(1).to_pylist()
            x = np.array(b.column(2).to_pylist(), float)
            y = np.array(b.column(3).to_pylist(), float)
            lam = np.array([stream(seed, f"{i}:{n}").uniform(0.1, 0.9) for i, n in zip(ids, no)])[:, None]
            m = lam * x + (1 - lam) * y
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            yield pa.record_batch([b.column(0), b.column(1), list_column(m.ravel(), np.full(len(m), dim), pa.float64())], ["doc_idx", "copy_no", "v"])

    return run


def grow_by_mixing(docs: DataFrame, neighbours: DataFrame, copies: int, dim: int, seed: int = 42) -> DataFrame:
    """(doc_idx, copy_no, v): synthetic vectors, each a random convex mix of a document and a neighbour within its cluster, normalised.

    docs(doc_idx, v), neighbours(doc_idx, other, rank) with ranks from 1; copy i takes the neighbour of rank i modulo their number.
    """
    n = neighbours.groupBy("doc_idx").agg(F.max("rank").alias("n"))
    want = docs.select("doc_idx", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy_no")).join(n, "doc_idx").withColumn("rank", F.col("copy_no") % F.col("n") + 1)
    pair = want.join(neighbours, ["doc_idx", "rank"]).join(docs, "doc_idx").join(docs.select(F.col("doc_idx").alias("other"), F.col("v").alias("w")), "other")
    return pair.select("doc_idx", "copy_no", "v", "w").mapInArrow(_mixes(dim, seed), "doc_idx long, copy_no int, v array<double>")


def sub_clusters(assignment: DataFrame, most_points: int) -> DataFrame:
    """(doc_idx, cluster_id, sub, stash): members cut into runs of ``most_points`` by index; a run that isn't full is stash."""
    w = Window.partitionBy("cluster_id").orderBy("doc_idx")
    r = assignment.select("doc_idx", "cluster_id").withColumn("sub", F.floor((F.row_number().over(w) - 1) / most_points))
    full = r.groupBy("cluster_id", "sub").agg(F.count(F.lit(1)).alias("n"))
    return r.join(full, ["cluster_id", "sub"]).select("doc_idx", "cluster_id", "sub", (F.col("n") < most_points).alias("stash"))


def url_batches(docs: DataFrame, order: str, size: int) -> DataFrame:
    """(order, batch, slot): consecutive batches of ``size`` by a dense order column that starts at 0."""
    return docs.withColumns({"batch": F.floor(F.col(order) / size), "slot": F.col(order) % size})


def pad_batches(batches: DataFrame, item: str, size: int) -> DataFrame:
    """(batch, slot, item): every batch with ``size`` slots, the empty ones holding the batch's first item."""
    first = batches.groupBy("batch").agg(F.min_by(item, "slot").alias("_f"))
    slots = first.select("batch", "_f", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    return slots.join(batches.select("batch", "slot", item), ["batch", "slot"], "left").select("batch", "slot", F.coalesce(item, "_f").alias(item))


def fetch_one_batch(ranked: DataFrame, batches: DataFrame) -> DataFrame:
    """(query_id, rank, doc_idx): the ranked documents that lie in the batch of the query's first one."""
    at = batches.select("doc_idx", "batch")
    top = ranked.filter("rank = 1").join(at, "doc_idx").select("query_id", "batch")
    return ranked.join(at, "doc_idx").join(top, ["query_id", "batch"]).select("query_id", "rank", "doc_idx")


def message_bytes(dims: int, docs: int) -> int:
    """Bytes that hold the largest squared byte distance or index: ceil(log256(max(dims * 255^2, docs - 1) + 1))."""
    top, n = max(dims * 255 * 255, docs - 1) + 1, 0
    while 256**n < top:
        n += 1
    return n


def most_points(dims: int, docs: int, degree: int) -> int:
    """Points of a sub-cluster that fit a ring of ``degree``, at least one."""
    return max(1, degree // (dims + 2 * message_bytes(dims, docs)))


def ring_degree(dims: int, docs: int, points: int, degrees: tuple[int, ...] = (2048, 4096, 8192, 16384), default: int = 8192) -> int:
    """The smallest degree that fits ``points`` points, or the default if none does."""
    return min((d for d in degrees if most_points(dims, docs, d) >= points), default=default)
