"""What belongs to one run: bundles of assets, cached runs, exports for other systems, and the stages of preparation by name."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.operators import comparison, knn, preparation, worksets
from vectrine.operators.metrics import bytes_or_mib
from vectrine.plans import pipelines
from vectrine.plans.config import Settings
from vectrine.sources import readers, writers


def prewarm(docs: DataFrame, rounds: int = 3) -> tuple[DataFrame, float]:
    """The documents kept in memory, and the seconds of the last of some searches that no measurement counts."""
    kept = docs.persist()
    probe = kept.limit(1).select(F.lit(0).alias("query_id"), F.col("v").alias("qv"))
    took = 0.0
    for _ in range(rounds):
        began = time.perf_counter()
        knn.exact_knn(kept, F.col("doc_idx"), F.col("v"), probe, F.col("query_id"), F.col("qv"), 1).count()
        took = time.perf_counter() - began
    return kept, took


def prewarm_clusters(docs: DataFrame, assignment: DataFrame) -> DataFrame:
    """The documents of each cluster together, and kept so."""
    return docs.join(assignment, "doc_idx").repartition("cluster_id").persist()


def bundle_path(spark: SparkSession, own: str, parent: str | None) -> str:
    """The query bundle of a workset: its parent's, if it has one; one that doesn't exist is an error."""
    path = parent or own
    if readers.missing_paths(spark, [f"{path}/queries"]):
        raise ValueError(f"{path} has no queries")
    return path


def load_bundle(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, queries, qrels) of a written bundle, the first ``limit`` queries by id and their judgements."""
    docs, queries = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/queries")
    if limit is not None:
        queries = queries.orderBy("query_id").limit(limit)
    return docs, queries, readers.restrict_qrels(readers.read_qrels_strict(spark, f"{path}/qrels"), queries, docs)


def cached_vectors(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame | None, str]:
    """Cached vectors (v) and how that went: 'loaded', 'missing', 'empty' or 'wrong_length'."""
    if readers.missing_paths(spark, [path]):
        return None, "missing"
    df = spark.read.parquet(path)
    low, high = df.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low is None:
        return None, "empty"
    return (df, "loaded") if low == high == dim else (None, "wrong_length")


def run_configuration(docs: int, dim: int, clusters: int, k: int, selected: int | None = None, degree: int | None = None) -> dict[str, int]:
    """The settings of a multi-party run: what fits a ring, and how many clusters are looked into."""
    largest = -(-docs // max(1, clusters))
    degree = degree or preparation.ring_degree(dim, docs, largest)
    return {
        "docs": docs, "dim": dim, "clusters": clusters, "k": min(k, docs), "degree": degree,
        "selected": min(clusters, selected or max(1, round(clusters**0.5))),
        "most_points": preparation.most_points(dim, docs, degree), "message_bytes": preparation.message_bytes(dim, docs),
    }


def export_assets(docs: DataFrame, assignment: DataFrame, queries: DataFrame, config: dict[str, int], path: str) -> dict[str, int]:
    """Quantised documents and queries, sub-clusters with their stash, and the header of a run; gives their numbers."""
    writers.write_matrix_text(docs, "v", f"{path}/docs", quantize=True)
    writers.write_matrix_text(queries, "qv", f"{path}/queries", quantize=True)
    sub = preparation.sub_clusters(assignment, config["most_points"])
    sub.write.mode("overwrite").parquet(f"{path}/sub_clusters")
    spark = docs.sparkSession
    spark.createDataFrame([(writers.bridge_header(config),)], "t string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    back = spark.read.parquet(f"{path}/sub_clusters").agg(F.count_distinct("cluster_id", "sub").alias("s"), F.count_if("stash").alias("t")).first()
    return {"docs": spark.read.text(f"{path}/docs").count(), "queries": spark.read.text(f"{path}/queries").count(), "sub_clusters": back["s"], "stash": back["t"]}


def run_summary(metrics: DataFrame, dataset: str) -> DataFrame:
    """(dataset, latency_total_sec_avg, comm_total_bytes): a row a log of a run, from its last times and bytes (file, total_ms, total_mb)."""
    return metrics.select("file", F.lit(dataset).alias("dataset"), (F.col("total_ms") / 1000).alias("latency_total_sec_avg"), bytes_or_mib(F.lit(None), F.col("total_mb")).alias("comm_total_bytes"))


def clean_measurement(docs: DataFrame, queries: DataFrame, state: pipelines.Offline, s: Settings, path: str) -> tuple[DataFrame, bool]:
    """(summary, reused): the online summary of a run without gate and noise; one that was written before is taken as it is."""
    spark = docs.sparkSession
    if not readers.missing_paths(spark, [path]):
        return spark.read.parquet(path), True
    open_gate = state.clusters.withColumn("r_max", F.lit(float("inf")))  # every query passes
    run = pipelines.online(docs, queries, pipelines.Offline(state.assignment, open_gate), s, "none")
    comparison.online_summary(run.select("query_id", "track", "exact_recall", "inclusion_recall")).write.parquet(path)
    return spark.read.parquet(path), False


#: The stages of preparation, by dataset family and name.
STAGES: dict[tuple[str, str], Callable] = {
    ("passages", "units"): worksets.unit_pool,
    ("passages", "workset"): worksets.build_workset,
    ("products", "support"): preparation.product_support,
    ("products", "select"): preparation.select_products,
    ("offsets", "local"): worksets.local_offsets,
    ("offsets", "subset"): worksets.subset_by_offsets,
}


def run_stage(dataset: str, stage: str, *args, **how):
    """Run a stage by its names; unknown ones are an error that lists what there is."""
    if (dataset, stage) not in STAGES:
        raise ValueError(f"no stage {dataset}/{stage} among {sorted('/'.join(k) for k in STAGES)}")
    return STAGES[dataset, stage](*args, **how)
