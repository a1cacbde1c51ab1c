"""Retrieval quality, latency and communication in one schema of comparison rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Candidates that an index search touches at least.
LEAST_TOUCHED = 640
MIB = 1048576


def hit_and_recall(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, positives, hits, hit, recall, first_rank) at k; queries without judgements have hit and recall 0, and first_rank is null without a hit.

    ranked(query_id, rank, doc_idx), qrels(query_id, doc_idx).
    """
    rel = qrels.select("query_id", "doc_idx").distinct().withColumn("rel", F.lit(1))
    pos = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("positives"))
    r = ranked.filter(F.col("rank") <= k).join(rel, ["query_id", "doc_idx"], "left")
    per = r.groupBy("query_id").agg(F.count_distinct(F.when(F.col("rel") == 1, F.col("doc_idx"))).alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rank"))
    p = F.coalesce("positives", F.lit(0))
    return per.join(pos, "query_id", "left").select(
        "query_id", p.alias("positives"), "hits", F.when(F.col("hits") > 0, 1).otherwise(0).alias("hit"), F.when(p > 0, F.col("hits") / p).otherwise(0.0).alias("recall"), "first_rank"
    )


def exact_recall(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, overlap, recall, same_order): the share of the exact k that the k best, or all candidates, hold, and whether the order agrees."""
    t = truth.filter(F.col("rank") <= k)
    hit = t.select("query_id", "doc_idx", F.col("rank").alias("tr")).join(ranked.select("query_id", "doc_idx", "rank"), ["query_id", "doc_idx"], "left")
    return hit.groupBy("query_id").agg(F.count("rank").alias("overlap")).select("query_id", "overlap", (F.col("overlap") / F.lit(k)).alias("recall")).join(
        hit.groupBy("query_id").agg(F.bool_and(F.coalesce(F.col("rank") == F.col("tr"), F.lit(False))).alias("same_order")), "query_id"
    )


def penalised_rank(first_rank: Column, k: int) -> Column:
    """k + 1 where there is no relevant document; keep the null one too."""
    return F.coalesce(first_rank, F.lit(k + 1))


def request_bytes(vector: Column) -> Column:
    return 4 * F.size(vector)


def response_bytes(payload: DataFrame, dim: int) -> DataFrame:
    """(query_id, rows, response_bytes): 4 an index, 4 a score, 4 * dim a vector, and the UTF-8 of ids and texts.  payload(query_id, doc_id, text)."""
    size = F.octet_length(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) + F.octet_length(F.coalesce("text", F.lit("")))
    return payload.groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(size + 8 + 4 * dim).alias("response_bytes"))


def docs_touched(total: int, fixed_k: int) -> int:
    return min(total, max(fixed_k, LEAST_TOUCHED))


def io_bytes(total: int, fixed_k: int, dim: int) -> int:
    return docs_touched(total, fixed_k) * 4 * dim


def mib(b: Column) -> Column:
    return b / F.lit(float(MIB))


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def duration_seconds(text: Column) -> Column:
    """Seconds of '1.2ms', '3us', '3µs' or '4s'; null for other units."""
    v = F.regexp_extract(text, r"^\s*([0-9.]+)\s*(µs|us|ms|s)\s*$", 1)
    u = F.regexp_extract(text, r"^\s*([0-9.]+)\s*(µs|us|ms|s)\s*$", 2)
    scale = F.when(u == "s", 1.0).when(u == "ms", 1e-3).when(u.isin("us", "µs"), 1e-6)
    return v.try_cast("double") * scale


def bytes_or_mib(b: Column, m: Column) -> Column:
    return F.coalesce(b.cast("double"), m * MIB)


def direct_or_oblivious(alpha_k: Column, k: int, dim: int, epsilon: float) -> Column:
    """'direct' where atan(tan(alpha_k) / sqrt(k)) >= dim / epsilon, else 'oblivious'."""
    return F.when(F.atan(F.tan(alpha_k) / F.sqrt(F.lit(float(k)))) >= dim / epsilon, "direct").otherwise("oblivious")


def summary(rows: DataFrame, metrics: tuple[str, ...], by: tuple[str, ...] = (), dense: str | None = None) -> DataFrame:
    """Mean, smallest, largest and sum of each metric; with ``dense``, also the mean over the rows of the dense track."""
    out = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        out += [F.round(F.avg(m), 9).alias(f"{m}_mean"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.round(F.sum(m), 9).alias(f"{m}_sum")]
        if dense:
            out.append(F.round(F.avg(F.when(F.col(dense) == "dense_rdp", F.col(m))), 9).alias(f"{m}_dense_mean"))
    return rows.groupBy(*by).agg(*out)


#: One row a comparator; every metric may be null.
CONTRACT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("system", "variant", "dataset", "run_label", "comparison_axis", "retrieval_mode")]
    + [T.StructField(n, T.LongType()) for n in ("num_docs", "num_queries", "num_clusters", "dim", "top_k", "fixed_k", "docs_touched")]
    + [T.StructField(n, T.DoubleType()) for n in ("epsilon", "exact_recall", "exact_topk_overlap_mean", "inclusion_recall", "hit_rate", "qrels_recall", "first_rank_mean", "penalised_rank_mean",
                                                  "client_ms", "server_ms", "recover_ms", "total_ms", "request_bytes", "response_bytes", "total_bytes")]
    + [T.StructField("notes", T.ArrayType(T.StringType()))]
)


def contract_rows(df: DataFrame) -> DataFrame:
    """The columns of the comparison schema, missing ones as nulls; totals from their parts where they are missing."""
    have = {c.lower() for c in df.columns}
    row = df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CONTRACT))
    ms = F.coalesce("total_ms", F.col("client_ms") + F.col("server_ms") + F.col("recover_ms"))
    return row.withColumns({"total_ms": ms, "total_bytes": F.coalesce("total_bytes", F.col("request_bytes") + F.col("response_bytes"))})


def coverage_by_cluster(truth: DataFrame, assignment: DataFrame, routed: DataFrame) -> DataFrame:
    """(query_id, covered, first_covered): whether the routed clusters hold all exact neighbours, and whether the first one's does."""
    a = truth.join(assignment, "doc_idx").join(routed.select("query_id", "cluster_id").distinct().withColumn("in", F.lit(True)), ["query_id", "cluster_id"], "left")
    c = F.coalesce("in", F.lit(False))
    return a.groupBy("query_id").agg(F.bool_and(c).alias("covered"), F.bool_or(c & (F.col("rank") == 1)).alias("first_covered"))


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, ties by the smaller value."""
    n = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))).filter("r = 1").drop("r")
