"""Comparison of retrieval systems: roll-ups of runs, and rows of one common schema.

A run's summary is a table with one row a run and one column a figure; columns
that a run doesn't have count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrine.operators.knn import rank_pairs
from vectrine.operators.metrics import MIB, penalised_rank

# The columns of the common schema, in order.
_TEXT = ("baseline_slug", "baseline_display_name", "paper_url", "contract_version", "comparison_axis", "run_label")
_COUNTS = ("num_docs", "num_clusters", "num_queries", "top_k")
_FIGURES = (
    "latency_total_sec_avg", "latency_client_generate_sec_avg", "latency_server_query_sec_avg", "latency_client_recover_sec_avg",
    "comm_request_bytes_avg", "comm_response_bytes_avg", "comm_downstream_bytes_avg",
    "mean_first_relevant_rank", "top1_hit_rate", "exact_topk_overlap_mean", "exact_topk_order_match_rate", "candidate_cover_rate",
    "direct_retrieve_rate", "ot_retrieve_rate", "real_cluster_hit_rate",
)
_SOURCES = ("source_summary_json", "source_rows_jsonl")
ROW = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXT] + [T.StructField(n, T.LongType()) for n in _COUNTS] + [T.StructField(n, T.DoubleType()) for n in _FIGURES]
    + [T.StructField(n, T.StringType()) for n in _SOURCES] + [T.StructField("notes", T.ArrayType(T.StringType()))]
)


def first_of_keys(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that a row has a value for; null if the table has none of them."""
    have = set(df.columns)
    found = [F.col(f"`{n}`") for n in names if n in have]
    return F.coalesce(*found) if found else F.lit(None)


def _zero(df: DataFrame, name: str) -> Column:
    return F.coalesce(first_of_keys(df, name).cast("double"), F.lit(0.0))


def _bytes(df: DataFrame, byte_key: str, mib_key: str) -> Column:
    return F.coalesce(first_of_keys(df, byte_key).cast("double"), first_of_keys(df, mib_key).cast("double") * MIB)


def rows(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows of the common schema from the given columns; the others come from ``df`` where it has them, and are null otherwise."""
    out = []
    for f in ROW:
        c = columns.get(f.name, F.lit("v1") if f.name == "contract_version" else first_of_keys(df, f.name))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def total_latency(df: DataFrame) -> Column:
    """The total by the first key that is there, else the sum of the three stages."""
    stages = _zero(df, "time_client_generate_query_sec_avg") + _zero(df, "time_server_query_sec_avg") + _zero(df, "time_client_recover_docs_sec_avg")
    return F.coalesce(first_of_keys(df, "latency_total_sec_avg", "time_total_sec_avg", "time_three_stage_total_sec_avg").cast("double"), stages)


def plain_rows(df: DataFrame) -> DataFrame:
    """Rows of runs of the same pipeline without gate and noise."""
    return rows(
        df,
        comparison_axis=F.coalesce(first_of_keys(df, "comparison_axis"), F.lit("qrels_bundle")),
        latency_total_sec_avg=total_latency(df),
        latency_client_generate_sec_avg=_zero(df, "time_client_generate_query_sec_avg"),
        latency_server_query_sec_avg=_zero(df, "time_server_query_sec_avg"),
        latency_client_recover_sec_avg=_zero(df, "time_client_recover_docs_sec_avg"),
        comm_request_bytes_avg=first_of_keys(df, "comm_client_generate_query_mb_avg").cast("double") * MIB,
        comm_response_bytes_avg=first_of_keys(df, "comm_server_query_mb_avg").cast("double") * MIB,
        exact_topk_overlap_mean=_zero(df, "avg_exact_recall_at_k"),
        direct_retrieve_rate=F.lit(1.0),
        ot_retrieve_rate=F.lit(0.0),
    )


def scaling_rows(sizes: DataFrame, summaries: DataFrame, prefix: str) -> DataFrame:
    """Rows of runs over collections of several sizes: sizes(num_docs, num_clusters), summaries with ``num_docs``; a size without a summary is an error."""
    missing = sizes.join(summaries.select("num_docs"), "num_docs", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"no summary for {[r['num_docs'] for r in missing]} documents")
    both = summaries.drop("num_clusters").join(sizes.select("num_docs", "num_clusters"), "num_docs")
    named = both.withColumns({"comparison_axis": F.lit("database_size"), "run_label": F.concat(F.lit(f"{prefix}_n"), F.col("num_docs").cast("string"))})
    return plain_rows(named)


def distance_rows(df: DataFrame) -> DataFrame:
    """Rows of runs with distance noise, encrypted scores and two ways of retrieval: mode counts become rates."""
    n = F.greatest(_zero(df, "num_queries"), F.lit(1.0))
    client, server, recover = _zero(df, "time_client_encrypt_query_sec_avg"), _zero(df, "time_server_phe_score_sec_avg"), _zero(df, "time_client_decrypt_sort_sec_avg")
    k = first_of_keys(df, "top_k").cast("double")
    return rows(
        df,
        num_clusters=F.lit(None),
        latency_total_sec_avg=client + server + recover,
        latency_client_generate_sec_avg=client,
        latency_server_query_sec_avg=server,
        latency_client_recover_sec_avg=recover,
        comm_request_bytes_avg=_zero(df, "comm_client_encrypt_query_bytes_avg") + _zero(df, "comm_retrieve_request_bytes_avg"),
        comm_response_bytes_avg=_zero(df, "comm_server_score_response_bytes_avg"),
        comm_downstream_bytes_avg=_zero(df, "comm_retrieve_response_bytes_avg"),
        exact_topk_overlap_mean=F.when(k > 0, _zero(df, "mean_exact_topk_overlap_count") / k),
        exact_topk_order_match_rate=_zero(df, "exact_topk_order_match_rate"),
        candidate_cover_rate=_zero(df, "module1_candidate_cover_rate"),
        direct_retrieve_rate=_zero(df, "direct_queries") / n,
        ot_retrieve_rate=_zero(df, "oblivious_queries") / n,
    )


def lattice_rows(ranking: DataFrame, documents: DataFrame, exact: DataFrame) -> DataFrame:
    """Rows of runs with a ranking service and a document service: their stages and bytes add up; exact(run_label, ...) has the figures of ``exact_rates``."""
    url = documents.select("run_label", *(F.col(c) for c in documents.columns if c != "run_label" and c not in ranking.columns))
    df = ranking.join(url, "run_label").join(exact, "run_label", "left")
    client = _zero(df, "time_client_encrypt_query_sec_avg") + _zero(df, "time_client_build_pir_sec_avg")
    server = _zero(df, "time_server_rank_cluster_sec_avg") + _zero(df, "time_server_process_pir_sec_avg")
    recover = _zero(df, "time_client_decrypt_scores_sec_avg") + _zero(df, "time_client_recover_pir_sec_avg")
    return rows(
        df,
        comparison_axis=F.lit("qrels_bundle"),
        latency_total_sec_avg=client + server + recover,
        latency_client_generate_sec_avg=client,
        latency_server_query_sec_avg=server,
        latency_client_recover_sec_avg=recover,
        comm_request_bytes_avg=_zero(df, "mean_encrypted_query_token_bytes") + _zero(df, "mean_pir_request_bytes"),
        comm_response_bytes_avg=_zero(df, "mean_encrypted_scores_bytes"),
        comm_downstream_bytes_avg=_zero(df, "mean_pir_response_bytes"),
        mean_first_relevant_rank=_zero(df, "mean_first_relevant_rank"),
        top1_hit_rate=_zero(df, "top1_hit_rate"),
        exact_topk_overlap_mean=first_of_keys(df, "exact_recall"),
        exact_topk_order_match_rate=first_of_keys(df, "order_match_rate"),
        candidate_cover_rate=first_of_keys(df, "cover_rate"),
        direct_retrieve_rate=F.lit(1.0),
        ot_retrieve_rate=F.lit(0.0),
        real_cluster_hit_rate=first_of_keys(df, "cluster_hit_rate"),
    )


def multi_party_rows(df: DataFrame, judged: bool) -> DataFrame:
    """Rows of multi-party runs, whose figures go by several keys; ``judged``: against judgements, else against exact neighbours."""
    part = lambda *keys: first_of_keys(df, *keys).cast("double")
    client, server, recover = (
        part("latency_client_generate_sec_avg", "time_client_generate_query_sec_avg"),
        part("latency_server_query_sec_avg", "time_server_query_sec_avg"),
        part("latency_client_recover_sec_avg", "time_client_recover_docs_sec_avg"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    overlap = part("exact_topk_overlap_mean", "candidate_overlap_mean") if judged else part("exact_recall_at_k", "recall_at_k", "exact_topk_overlap_mean")
    return rows(
        df,
        comparison_axis=F.coalesce(first_of_keys(df, "comparison_axis"), F.lit("qrels_bundle" if judged else "ann_benchmark_dataset")),
        latency_total_sec_avg=F.coalesce(part("latency_total_sec_avg", "time_total_sec_avg"), zero(client) + zero(server) + zero(recover)),
        latency_client_generate_sec_avg=client,
        latency_server_query_sec_avg=server,
        latency_client_recover_sec_avg=recover,
        comm_request_bytes_avg=_bytes(df, "comm_request_bytes_avg", "comm_request_mb_avg"),
        comm_response_bytes_avg=_bytes(df, "comm_response_bytes_avg", "comm_response_mb_avg"),
        comm_downstream_bytes_avg=_bytes(df, "comm_downstream_bytes_avg", "comm_downstream_mb_avg"),
        mean_first_relevant_rank=part("mean_first_relevant_rank") if judged else F.lit(None),
        top1_hit_rate=part("top1_hit_rate", "strict_hit_rate_at_1", "top1_strict_hit_rate") if judged else part("top1_hit_rate"),
        exact_topk_overlap_mean=overlap,
        direct_retrieve_rate=F.lit(None),
        ot_retrieve_rate=F.lit(None),
    )


def exact_rates(ranked: DataFrame, truth: DataFrame, assignment: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """One row: exact recall, rate of queries in the exact order, rate of those whose chosen cluster holds all exact neighbours, and the first.

    ranked and truth(query_id, rank, doc_idx), assignment(doc_idx, cluster_id), chosen(query_id, cluster_id).
    """
    t = truth.filter(F.col("rank") <= k).join(assignment, "doc_idx").join(chosen.select("query_id", F.col("cluster_id").alias("at")), "query_id", "left")
    r = ranked.filter(F.col("rank") <= k).select("query_id", "doc_idx", F.col("rank").alias("got"))
    per = t.join(r, ["query_id", "doc_idx"], "left").groupBy("query_id").agg(
        (F.count("got") / F.lit(k)).alias("recall"),
        F.bool_and(F.coalesce(F.col("got") == F.col("rank"), F.lit(False))).cast("double").alias("order"),
        F.bool_and(F.col("at") == F.col("cluster_id")).cast("double").alias("cover"),
        F.bool_or((F.col("at") == F.col("cluster_id")) & (F.col("rank") == 1)).cast("double").alias("hit"),
    )
    return per.agg(*(F.round(F.avg(a), 9).alias(b) for a, b in (("recall", "exact_recall"), ("order", "order_match_rate"), ("cover", "cover_rate"), ("hit", "cluster_hit_rate"))))


def ranking_rollup(per_query: DataFrame, k: int) -> DataFrame:
    """One row over the queries of ``metrics.hit_and_recall``: counts, hit rates, recall, first relevant rank (missing counts as k + 1), first places."""
    judged = F.col("positives") > 0
    return per_query.agg(
        F.count(F.lit(1)).alias("num_queries"), F.count_if(judged).alias("num_judged"),
        F.round(F.avg("hit"), 9).alias("hit_rate"), F.round(F.avg(F.when(judged, F.col("hit"))), 9).alias("hit_rate_judged"),
        F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg(F.when(judged, F.col("recall"))), 9).alias("recall_judged"),
        F.round(F.avg(F.when(judged, penalised_rank(F.col("first_rank"), k))), 9).alias("mean_first_relevant_rank"),
        F.round(F.avg(F.coalesce(F.col("first_rank") == 1, F.lit(False)).cast("int")), 9).alias("top1_hit_rate"),
    )


#: Figures of the online summary.
ONLINE_FIGURES = ("exact_recall", "inclusion_recall", "r_max", "margin", "routed_r_max", "returned", "docs_touched", "client_sec", "server_sec", "recover_sec", "request_mb", "response_mb", "io_mb")


def online_summary(queries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by track, and of each figure the mean, sum, smallest and largest over all queries and its mean and sum over the dense ones; stage and byte totals.

    queries(query_id, track, and the ``ONLINE_FIGURES`` that were measured).
    """
    dense = F.col("track") == "dense_rdp"
    have = [m for m in ONLINE_FIGURES if m in queries.columns]
    q = queries
    for total, parts in (("three_stage_sec", ("client_sec", "server_sec", "recover_sec")), ("two_stage_mb", ("request_mb", "response_mb")), ("system_mb", ("request_mb", "io_mb", "response_mb"))):
        if all(p in have for p in parts):
            q = q.withColumn(total, sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0))))
            have.append(total)
    out = [F.count(F.lit(1)).alias("num_queries"), F.count_if(dense).alias("num_dense"), F.count_if(~dense).alias("num_out_of_scope")]
    for m in have:
        only = F.when(dense, F.col(m))
        out += [F.round(f(m), 9).alias(f"{m}_{n}") for n, f in (("avg", F.avg), ("sum", F.sum), ("min", F.min), ("max", F.max))]
        out += [F.round(F.avg(only), 9).alias(f"{m}_avg_dense"), F.round(F.sum(only), 9).alias(f"{m}_sum_dense"), F.count(only).alias(f"{m}_n_dense")]
    return q.groupBy(*by).agg(*out)


def by_size(queries: DataFrame) -> DataFrame:
    """The means of a run's per-query figures by collection size: queries(num_docs, exact_recall, latency_sec, request_bytes, response_bytes)."""
    return queries.groupBy("num_docs").agg(F.count(F.lit(1)).alias("num_queries"), *(F.round(F.avg(c), 9).alias(f"{c}_avg") for c in ("exact_recall", "latency_sec", "request_bytes", "response_bytes")))


# What a table of selected settings must have.
SELECTION = ("variant", "num_docs", "num_clusters", "fixed_k", "top_k")


def selection_table(spark, settings: list[tuple]) -> DataFrame:
    """Selected settings (variant, num_docs, num_clusters, fixed_k, top_k)."""
    return spark.createDataFrame(settings, "variant string, num_docs long, num_clusters long, fixed_k long, top_k long")


def is_selection(df: DataFrame) -> bool:
    """Whether a table has all columns of a selection."""
    return set(SELECTION) <= set(df.columns)


def clean_run(summary: DataFrame, selection: DataFrame, variant: str) -> DataFrame:
    """A run's summary with what its selected setting says, and totals from their parts."""
    if not is_selection(selection):
        raise ValueError(f"a selection needs {SELECTION}")
    chosen = selection.filter(F.col("variant") == variant)
    if chosen.count() != 1:
        raise ValueError(f"the selection has no single {variant}")
    s = summary.drop(*SELECTION).crossJoin(chosen)  # one row a run
    return s.withColumns({"time_three_stage_total_sec_avg": total_latency(s), "comm_total_mb_avg": _zero(s, "comm_client_generate_query_mb_avg") + _zero(s, "comm_server_query_mb_avg")})


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): how many items of each cluster, source, or both."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def workset_stats(docs: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: documents, dimension, queries and judgements of a workset: docs(doc_id, v)."""
    d = docs.agg(F.count(F.lit(1)).alias("num_docs"), F.max(F.size("v")).alias("dim"))
    q = queries.select("query_id").distinct().agg(F.count(F.lit(1)).alias("num_queries"))
    j = qrels.select("query_id", "doc_id").distinct().agg(F.count(F.lit(1)).alias("num_qrels"), F.count_distinct("query_id").alias("num_judged"))
    return d.crossJoin(q).crossJoin(j)  # one row each


def in_range(ranked: DataFrame, docs: int) -> DataFrame:
    """Ranked indices that exist, ranked again without gaps."""
    kept = ranked.filter((F.col("doc_idx") >= 0) & (F.col("doc_idx") < docs)).withColumnRenamed("rank", "given")
    return rank_pairs(kept, 1 << 30, score="given").select("query_id", "rank", "doc_idx")
