"""Writers.  Everything is written by the executors, a file a partition."""

from __future__ import annotations

import hashlib
import io
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.functions.vectors import quantize_byte
from vectrine.operators.clustering import contract_violations
from vectrine.operators.metrics import contract_rows
from vectrine.sources.readers import restrict_qrels


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_contract_csv(df: DataFrame, path: str) -> None:
    """Comparison rows with the union of all columns; notes joined by bars."""
    contract_rows(df).withColumn("notes", F.concat_ws("|", "notes")).write.mode("overwrite").csv(path, header=True)


def write_contract_jsonl(df: DataFrame, path: str) -> None:
    contract_rows(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_topk_tsv(ranked: DataFrame, qrels: DataFrame, path: str) -> None:
    """query_id, rank, doc_idx, relevant."""
    rel = qrels.select("query_id", "doc_idx").distinct().withColumn("relevant", F.lit(1))
    write_tsv(ranked.join(rel, ["query_id", "doc_idx"], "left").select("query_id", "rank", "doc_idx", F.coalesce("relevant", F.lit(0)).alias("relevant")), path)


def write_cluster_artifact(assignment: DataFrame, clusters: DataFrame, meta: dict, path: str) -> None:
    """A partition as two tables and one JSON row of settings; every document has its cluster."""
    assignment.write.mode("overwrite").parquet(f"{path}/assignment")
    clusters.write.mode("overwrite").parquet(f"{path}/clusters")
    spark = assignment.sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def write_queries(df: DataFrame, path: str) -> None:
    """Query rows in a folder a role."""
    df.write.mode("overwrite").partitionBy("split_role").parquet(path)


def write_json(row: DataFrame, path: str) -> None:
    """A summary of one row as one JSON line."""
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_cluster_artifact(spark, path: str, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(assignment, clusters, settings) of a written partition; one that breaks its contract is an error."""
    assignment, clusters = spark.read.parquet(f"{path}/assignment"), spark.read.parquet(f"{path}/clusters")
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    known = assignment.select("doc_idx").distinct() if docs is None else docs.select("doc_idx")
    bad = contract_violations(known, assignment, clusters).limit(5).collect()
    if bad:
        raise ValueError(f"the partition is broken: {[tuple(b) for b in bad]}")
    return assignment, clusters, meta


def write_query_artifacts(queries: DataFrame, truth: DataFrame, qrels: DataFrame, meta: dict, path: str) -> None:
    """Queries with vectors by role, their exact neighbours, judgements and settings: queries(query_id, split_role, text, v)."""
    queries.write.mode("overwrite").partitionBy("split_role").parquet(f"{path}/queries")
    truth.write.mode("overwrite").parquet(f"{path}/exact_topk")
    write_jsonl(queries.select("query_id", "split_role", "text"), f"{path}/texts")
    write_tsv(qrels.select("query_id", "doc_id").distinct(), f"{path}/qrels")
    queries.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def write_audit(clusters: DataFrame, path: str) -> None:
    """A row a cluster as CSV, as JSON lines and as a table."""
    plain = clusters.select(*(c for c, t in clusters.dtypes if not t.startswith(("array", "map", "struct"))))
    plain.write.mode("overwrite").csv(f"{path}/csv", header=True)
    plain.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/json")
    clusters.write.mode("overwrite").parquet(f"{path}/table")


def write_bundle(docs: DataFrame, queries: DataFrame, qrels: DataFrame, path: str) -> None:
    """Documents and queries as they are, and the judgements among them: docs(doc_id, ...), queries(query_id, ...)."""
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    queries.write.mode("overwrite").parquet(f"{path}/queries")
    write_tsv(restrict_qrels(qrels, queries, docs), f"{path}/qrels")


def cache_matches(meta: dict, docs: int, digest: str) -> bool:
    """Whether a cache was made of these documents: their number, and the digest of their ids."""
    return meta.get("num_docs") == docs and meta.get("doc_ids_sha256") == digest


def settings_signature(settings: dict) -> str:
    """A digest of settings, whatever the order of their names."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def manifest(name: str, stages: list[tuple[str, str]]) -> str:
    """The stages (name, module) of an implementation as JSON."""
    return json.dumps({"name": name, "stages": [{"name": n, "module": m} for n, m in stages]}, indent=2)


def write_npy(df: DataFrame, order: str, vector: str, path: str) -> None:
    """A .npy matrix of float32 rows in the order of a column.

    The rows pass through the driver a partition at a time: the format is one
    file.  For what is read often, use parquet.
    """
    spark = df.sparkSession
    n, dim = df.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": "<f4", "fortran_order": False, "shape": (n, dim or 0)})
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(head.getvalue()))
        block = []
        for row in df.orderBy(order).select(vector).toLocalIterator():
            block.append(row[0])
            if len(block) == 4096:
                out.write(bytearray(np.asarray(block, "<f4").tobytes()))
                block = []
        if block:
            out.write(bytearray(np.asarray(block, "<f4").tobytes()))
    finally:
        out.close()


def append_missing(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table doesn't have yet, so that a run that was cut short can go on."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path).select(key)
        df = df.join(have, key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    df.write.mode("append").parquet(path)


def write_matrix_text(df: DataFrame, vector: str, path: str, quantize: bool = False) -> None:
    """One line a vector, values separated by blanks, optionally as bytes 0 to 255."""
    v = quantize_byte(F.col(vector)) if quantize else F.col(vector)
    df.select(F.concat_ws(" ", F.transform(v, lambda x: x.cast("string")))).write.mode("overwrite").text(path)


def quantized_bytes(df: DataFrame, record: str, vector: str) -> DataFrame:
    """(record, bytes): vectors as little-endian 32-bit unsigned integers of 0 to 255, for binary export."""

    def run(frames):
        for f in frames:
            yield f.assign(bytes=[np.asarray(x, "<u4").tobytes() for x in f["q"]])[[record, "bytes"]]

    kind = df.schema[record].dataType.simpleString()
    return df.select(record, quantize_byte(F.col(vector)).alias("q")).mapInPandas(run, f"{record} {kind}, bytes binary")


def bridge_header(values: dict[str, int]) -> str:
    """A C header of constants."""
    body = "\n".join(f"constexpr int k{k} = {v};" for k, v in values.items())
    return f"#pragma once\n{body}\n"
