"""The registered queries of bundles and stages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrine.functions.vectors import norm, normalize_strict
from vectrine.operators import knn, worksets
from vectrine.plans import bundles, pipelines
from vectrine.plans.config import SMALL
from vectrine.plans.materialize import Scratch
from vectrine.plans.queries import _BASE, DIM, SQL, asked, docs, parts, query, read
from vectrine.plans.source_queries import _QRELS, _folder, _log, _qrels
from vectrine.sources import readers as rd
from vectrine.sources import writers as wr


@query(SQL["knn_top10"])
def prewarmed_search(spark, sf):
    kept, took = bundles.prewarm(docs(spark, sf), 1)
    found = Scratch(spark).cut(knn.exact_knn(kept, F.col("doc_idx"), F.col("v"), asked(spark, sf), F.col("query_id"), F.col("qv"), 10, DIM))
    kept.unpersist()
    return found if took > 0 else found.limit(0)


@query("SELECT label AS cluster_id, count(*) AS docs, 1 AS partitions FROM embeddings GROUP BY 1")
def prewarmed_clusters(spark, sf):
    """Each cluster is kept in one partition."""
    kept = bundles.prewarm_clusters(docs(spark, sf), parts(spark, sf))
    out = kept.withColumn("p", F.spark_partition_id()).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("p").cast("int").alias("partitions"))
    out = Scratch(spark).cut(out)
    kept.unpersist()
    return out


@query("SELECT (SELECT count(*) FROM documents) AS unchanged, 40 AS changed_at_40, 7 AS cut_at_7")
def reusable_prefixes(spark, sf):
    u = read(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("u"), "doc_id").alias("doc_id"))
    at_40 = u.withColumn("doc_id", F.when(F.col("ord") == 40, "other").otherwise(F.col("doc_id")))
    low = u.agg(F.min("ord")).first()[0]
    u0, c0 = u.withColumn("ord", F.col("ord") - low), at_40.withColumn("ord", F.col("ord") - low)
    rows = [(worksets.reusable_prefix(u0, u0), worksets.reusable_prefix(u0, c0) + low, worksets.reusable_prefix(u0, u0.filter("ord < 7")))]
    return spark.createDataFrame(rows, "unchanged long, changed_at_40 int, cut_at_7 int")


def _bundle(spark, sf) -> str:
    at = _folder(spark)
    q = _qrels(spark, sf)
    wr.write_bundle(q.select("doc_id").distinct(), q.select("query_id").distinct(), q, f"{at}/parent")
    return at


@query(f"SELECT * FROM ({_QRELS}) WHERE query_id IN (SELECT DISTINCT query_idx::VARCHAR FROM gt_topk ORDER BY 1 LIMIT 3)")
def bundle_of_parent(spark, sf):
    """A nested workset takes its parent's queries; the first three by id and their judgements are loaded."""
    at = _bundle(spark, sf)
    return bundles.load_bundle(spark, bundles.bundle_path(spark, f"{at}/own", f"{at}/parent"), 3)[2]


@query("SELECT * FROM (VALUES ('a', 'loaded'), ('b', 'missing'), ('c', 'wrong_length'), ('d', 'empty')) t(name, status)")
def cached_vectors(spark, sf):
    at = _folder(spark)
    v = docs(spark, sf).select("v")
    v.write.parquet(f"{at}/a")
    v.select(F.slice("v", 1, 5).alias("v")).write.parquet(f"{at}/c")
    v.limit(0).write.parquet(f"{at}/d")
    return spark.createDataFrame([(n, bundles.cached_vectors(spark, f"{at}/{n}", DIM)[1]) for n in "abcd"], "name string, status string")


@query("SELECT 1000000 AS docs, 64 AS dim, 1000 AS clusters, 10 AS k, 8192 AS degree, 32 AS selected, 117 AS most_points, 3 AS message_bytes")
def run_configuration(spark, sf):
    c = bundles.run_configuration(1_000_000, 64, 1000, 10)
    return spark.createDataFrame([tuple(c.values())], ", ".join(f"{k} int" for k in c))


@query("WITH s AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16 AS sub FROM embeddings), g AS (SELECT label, sub, count(*) AS n FROM s GROUP BY ALL) SELECT (SELECT count(*) FROM embeddings) AS docs, (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) AS queries, (SELECT count(*) FROM g) AS sub_clusters, coalesce((SELECT sum(n) FROM g WHERE n < 16), 0)::BIGINT AS stash")
def exported_assets(spark, sf):
    config = bundles.run_configuration(read(spark, sf, "embeddings").count(), DIM, 10, 10) | {"most_points": 16}
    n = bundles.export_assets(docs(spark, sf), parts(spark, sf), asked(spark, sf), config, _folder(spark))
    return spark.createDataFrame([tuple(n.values())], ", ".join(f"{k} long" for k in n))


@query("SELECT 'log' || n_regionkey AS file, 'nations' AS dataset, (max(n_nationkey) + 0.5::DOUBLE) / 1000 AS latency_total_sec_avg, (max(n_nationkey) + 1) * 1048576.0::DOUBLE AS comm_total_bytes FROM nation GROUP BY n_regionkey")
def run_summaries(spark, sf):
    return bundles.run_summary(rd.last_metric(_log(spark, sf), **rd.COMMON_METRICS), "nations")


@query(_BASE + "SELECT count(*) AS num_queries, count(*) AS num_dense, 1::DOUBLE AS exact_recall_avg, 1::DOUBLE AS inclusion_recall_avg, true AS reused FROM q")
def clean_measurement(spark, sf):
    """A run without gate and noise, measured once and then reused."""
    at = f"{_folder(spark)}/clean"
    d = docs(spark, sf)
    full = d.withColumns({"doc_id": F.col("doc_idx").cast("string"), "text": F.lit("")})
    state = pipelines.offline(d, asked(spark, sf), parts(spark, sf), SMALL)
    bundles.clean_measurement(full, asked(spark, sf), state, SMALL, at)
    again, reused = bundles.clean_measurement(full, asked(spark, sf), state, SMALL, at)
    return again.select("num_queries", "num_dense", "exact_recall_avg", "inclusion_recall_avg", F.lit(reused).alias("reused"))


@query("SELECT l_partkey AS product_id, count(*) AS support FROM lineitem GROUP BY 1")
def dispatched_stage(spark, sf):
    j = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("product_id"))
    return bundles.run_stage("products", "support", j)


@query("SELECT vec_id, true AS unit FROM embeddings")
def strict_units(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", (F.abs(norm(normalize_strict(F.col("embedding"))) - 1) < 1e-9).alias("unit"))


@query("SELECT '<f4' AS kind, (SELECT count(*) FROM embeddings) AS rows, 64 AS dim, 1 AS source")
def matrix_header(spark, sf):
    """The header of a written matrix, and the first of two sources that can be read."""
    at = _folder(spark)
    wr.write_npy(read(spark, sf, "embeddings"), "vec_id", "embedding", f"{at}/m.npy")
    content = spark.read.format("binaryFile").load(f"{at}/m.npy").select("content").first()[0]
    kind, shape = rd.npy_header(bytes(content[:256]))
    _, source = rd.read_first(lambda: spark.read.parquet(f"{at}/none"), lambda: spark.read.parquet(f"{sf}/embeddings.parquet"))
    return spark.createDataFrame([(kind, *shape, source)], "kind string, rows long, dim int, source int")
