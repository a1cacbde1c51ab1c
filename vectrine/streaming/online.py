"""Queries and metrics as streams; documents and clusters are static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.functions.vectors import theta


#: Clusters that a row of a stream is held against.
MOST_CLUSTERS = 4096


def stream_gate(queries: DataFrame, clusters: DataFrame, r_bar: float) -> DataFrame:
    """(query_id, cluster_id, center_theta, r_max, track): the gate for each query of a stream.

    The clusters are folded into one array row first, so each query meets them
    in one expression and the stream needs no state.
    """
    if clusters.count() > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters: route by the batch operators")
    table = clusters.agg(F.sort_array(F.collect_list(F.struct("cluster_id", "center", "r_max"))).alias("clusters"))  # one row a cluster
    scored = F.transform("clusters", lambda c: F.struct(theta(F.col("qv"), c["center"]).alias("theta"), c["cluster_id"].alias("cluster_id"), c["r_max"].alias("r_max")))
    best = queries.crossJoin(F.broadcast(table)).withColumn("best", F.array_min(scored))
    return best.select("query_id", F.col("best.cluster_id").alias("cluster_id"), F.col("best.theta").alias("center_theta"), F.col("best.r_max").alias("r_max"), F.when(F.col("best.r_max") >= r_bar, "dense_rdp").otherwise("out_of_scope").alias("track"))


def stream_metrics(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Count, sum and mean of events by window and type; events later than ``late`` are dropped.  events(ts, event_type, value)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total", "mean")


def stream_sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each user: events with pauses shorter than ``gap``."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there, append its finished rows to a table, and give that table: state behind the watermark is dropped, and nothing is collected."""
    df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_retrieval(queries: DataFrame, search, sink: str, checkpoint: str):
    """Start a stream that answers each micro-batch of queries by ``search`` (DataFrame to DataFrame) and appends to ``sink``."""

    def batch(df: DataFrame, number: int) -> None:
        search(df).withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
