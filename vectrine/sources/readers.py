"""Readers that bring the accepted file shapes to one table shape."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrine.functions.arrow_vectors import list_column
from vectrine.operators.sampling import canonical_query_id
from vectrine.operators.text import clean_text

# The names under which ids and texts may come, in order.
DOC_IDS = ("doc_id", "id", "_id")
TEXTS = ("text", "contents", "content", "body")
QUERY_IDS = ("query_id", "id", "_id")
QUERY_TEXTS = ("text", "query", "contents", "content")


def first_present(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the named columns that a row has; null if the table has none of them."""
    have = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{have[n]}`").cast("string") for n in names if n in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines, gzipped or not, in a file, folder or pattern, also below it; blank lines are skipped."""
    r = spark.read.option("recursiveFileLookup", True).option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r).json(path)


def read_corpus(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """(doc_id, text): cleaned texts; rows without an id or a text are skipped."""
    df = read_jsonl(spark, path, schema)
    return df.select(first_present(df, DOC_IDS).alias("doc_id"), clean_text(first_present(df, TEXTS)).alias("text")).filter("doc_id <> '' and text <> ''")


def read_queries(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """(query_id, source_query_id, text) with the columns that are there."""
    df = read_jsonl(spark, path, schema)
    return df.select(first_present(df, QUERY_IDS).alias("query_id"), first_present(df, ("source_query_id",)).alias("source_query_id"), clean_text(first_present(df, QUERY_TEXTS)).alias("text")).filter("query_id <> '' and text <> ''")


def read_embedded_queries(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, text, embedding): from *queries*.jsonl and .jsonl.gz below ``root``; the first of an id wins, rows without a vector are dropped."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*queries*.jsonl*").json(root).withColumn("_f", F.input_file_name())
    rows = df.select(first_present(df, ("_id", "id", "query_id")).alias("query_id"), first_present(df, QUERY_TEXTS).alias("text"), F.col("emb").cast("array<float>").alias("embedding"), "_f", F.monotonically_increasing_id().alias("_n"))
    w = Window.partitionBy("query_id").orderBy("_f", "_n")
    return rows.filter("query_id is not null and embedding is not null").withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("query_id", "text", "embedding")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id), distinct: a two-column table, or lines of three and more fields of which the first and third count; a header is skipped."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(f.alias("f"))
    two = rows.select(F.col("f")[0].alias("query_id"), F.when(F.size("f") >= 3, F.col("f")[2]).otherwise(F.get("f", F.lit(1))).alias("doc_id"))
    return two.filter("doc_id is not null and not lower(query_id) in ('query_id', 'query-id')").distinct()


def read_qrels_strict(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id) of a tab-separated file whose header is exactly that; any other header is an error."""
    df = spark.read.csv(path, sep="\t", header=True)
    if df.columns != ["query_id", "doc_id"]:
        raise ValueError(f"expected the header query_id, doc_id and not {df.columns}")
    return df.distinct()


def restrict_qrels(qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Judgements whose query and document are among the allowed ones, each once."""
    return qrels.join(queries.select("query_id").distinct(), "query_id", "left_semi").join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("query_id", "doc_id").distinct()


def read_query_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of lines ``id<tab>text``; the first of an id wins."""
    rows = lines(spark, path).select(F.split("value", "\t", 2).alias("f"), "line_no").filter(F.size("f") == 2)
    return rows.groupBy(F.trim(F.col("f")[0]).alias("query_id")).agg(F.min_by(clean_text(F.col("f")[1]), "line_no").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): text lines in the order of each file."""
    t = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
    return t


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first): distinct keys with the place where each comes first."""
    return df.groupBy(key).agg(F.min(order).alias("first"))


def read_parquet_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns, in whatever case the files spell them; others aren't read."""
    df = spark.read.parquet(path)
    have = {c.lower(): c for c in df.columns}
    if missing := [c for c in columns if c.lower() not in have]:
        raise ValueError(f"no column {missing} in {path}")
    return df.select(*(F.col(f"`{have[c.lower()]}`").alias(c) for c in columns))


def npy_header(content: bytes) -> tuple[str, tuple[int, ...]]:
    """(type, shape) from the first bytes of a .npy file of version 1 or 2; columns in front of rows are an error."""
    data = io.BytesIO(content)
    version = np.lib.format.read_magic(data)
    if version not in ((1, 0), (2, 0)):
        raise ValueError(f"version {version} of .npy isn't read")
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(data)
    if fortran:
        raise ValueError("a matrix must be in row order")
    return kind.str, shape


def read_first(*attempts) -> tuple[DataFrame, int]:
    """The first source (a function without arguments) that can be read, and its number; if none can, the last one's error."""
    for i, attempt in enumerate(attempts):
        try:
            return attempt(), i
        except Exception as e:  # noqa: BLE001 - whatever the format raises
            last = e
    raise last


def _matrices(batches):
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            m = np.load(io.BytesIO(content), allow_pickle=False)
            if m.ndim != 2 or np.isfortran(m):
                raise ValueError(f"{path} isn't a matrix in row order")
            for lo in range(0, len(m), 8192):
                p = m[lo : lo + 8192].astype(np.float32)
                yield pa.record_batch([pa.array([path] * len(p)), pa.array(np.arange(lo, lo + len(p))), list_column(p.ravel(), np.full(len(p), p.shape[1]), pa.float32())], ["path", "row", "v"])


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, v): rows of .npy matrices, one task a file; .npy is for import, parquet for what is read often."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInArrow(_matrices, "path string, row long, v array<float>")


def read_offsets(spark: SparkSession, path: str, prefix_end: int = 0, expected: int | None = None) -> DataFrame:
    """(offset): distinct offsets of a text file and all below ``prefix_end``; another number than ``expected`` is an error."""
    core = spark.read.text(path).select(F.trim("value").try_cast("long").alias("offset")).filter("offset is not null")
    out = core.unionByName(spark.range(prefix_end).withColumnRenamed("id", "offset")).distinct()
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} offsets, and {expected} were expected")
    return out


def read_rankings(spark: SparkSession, path: str, kind: str, ids: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, doc_id) of an external ranking: 'jsonl' (a list of ids or indices a query), 'json' (such lists as the rows of one document), 'tsv' (query, document[, rank]), or 'npy' (one row a query, of indices).

    Indices are turned to ids by ``ids`` (doc_idx, doc_id); a missing rank is
    the line's place; a repeated document keeps its first rank.
    """
    if kind in ("jsonl", "json"):
        df = spark.read.json(path) if kind == "jsonl" else spark.read.option("multiLine", True).json(path).select(F.explode("rows").alias("r")).select("r.*")
        items = next(c for c in ("doc_ids", "ranked_doc_ids", "doc_indices") if c in df.columns)
        r = df.select(first_present(df, ("query_id", "query_index")).alias("query_id"), F.posexplode(F.col(items).cast("array<string>")).alias("rank", "doc_id")).withColumn("rank", F.col("rank") + 1)
        by_index = items == "doc_indices"
    elif kind == "tsv":
        f = F.split("value", "\t")
        r = lines(spark, path).select(f[0].alias("query_id"), F.get(f, F.lit(1)).alias("doc_id"), F.get(f, F.lit(2)).try_cast("int").alias("given"), "line_no").filter("query_id <> 'query_id' and doc_id is not null")
        w = Window.partitionBy("query_id").orderBy(F.coalesce("given", "line_no"), "line_no")
        r, by_index = r.withColumn("rank", F.row_number().over(w)), False
    elif kind == "npy":
        r = read_matrices(spark, path).select(F.col("row").cast("string").alias("query_id"), F.posexplode("v").alias("rank", "d")).select("query_id", F.col("rank") + 1, F.col("d").cast("long").cast("string").alias("doc_id")).toDF("query_id", "rank", "doc_id")
        by_index = True
    else:
        raise ValueError(f"unknown kind {kind}")
    if by_index and ids is not None:
        r = r.join(ids.select(F.col("doc_idx").cast("string").alias("_i"), F.col("doc_id").alias("_d")), F.col("doc_id") == F.col("_i")).select("query_id", "rank", F.col("_d").alias("doc_id"))
    return r.groupBy("query_id", "doc_id").agg(F.min("rank").cast("int").alias("rank")).select("query_id", "rank", "doc_id")


def last_metric(log: DataFrame, **patterns: str) -> DataFrame:
    """(file, a column a pattern): the last match of each pattern's first group in each log; log(file, line_no, value)."""
    last = lambda p: F.max_by(F.regexp_extract("value", p, 1), F.when(F.col("value").rlike(p), F.col("line_no")))
    return log.groupBy("file").agg(*(last(p).try_cast("double").alias(n) for n, p in patterns.items()))


# The lines of the comparator's log.
COMMON_METRICS = {"total_ms": r"Total time:\s*([0-9.]+)\s*ms", "total_mb": r"Total comm:\s*([0-9.]+)\s*MB"}
NEIGHBOUR_LINE = r"k-NNs IDs:\s*\(([^)]*)\)"


def neighbour_ids(log: DataFrame, k: int) -> DataFrame:
    """(file, ids): the first k ids of the last neighbour line."""
    hit = log.filter(F.col("value").rlike(NEIGHBOUR_LINE))
    ids = F.filter(F.split(F.regexp_extract("value", NEIGHBOUR_LINE, 1), r"[,\s]+"), lambda x: x != "")
    return hit.groupBy("file").agg(F.max_by(ids, "line_no").alias("ids")).select("file", F.slice(F.transform("ids", lambda x: x.try_cast("long")), 1, k).alias("ids"))


def sections(log: DataFrame, header: str) -> DataFrame:
    """Each line with the section it stands in: the last header (first group of the pattern) before it in its file."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("section", F.last(F.when(F.col("value").rlike(header), F.regexp_extract("value", header, 1)), ignorenulls=True).over(w))


def synthetic_ids(docs: DataFrame, prefix: str) -> DataFrame:
    """doc_id as ``prefix_<index>`` and a placeholder text, for worksets without either."""
    d = F.concat(F.lit(f"{prefix}_"), F.col("doc_idx").cast("string"))
    return docs.withColumns({"doc_id": d, "text": F.concat(F.lit("[synthetic] "), d)})


def coerce_sequence(value: Column) -> Column:
    """The items of a string, between commas or blanks."""
    return F.filter(F.split(F.trim(value), r"[,\s]+"), lambda x: x != "")


def allowed_only(items: Column, allowed: list) -> Column:
    """The first occurrences of the items that are allowed, in their order."""
    return F.array_distinct(F.filter(items, lambda x: F.array_contains(F.array(*map(F.lit, allowed)), x)))


def read_offset_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(offset): of a JSON document with ``offsets`` and their ``count``; another number is an error."""
    m = spark.read.option("multiLine", True).json(path).select(F.explode("offsets").alias("offset"), F.col("count").alias("_n")).select(F.col("offset").cast("long").alias("offset"), "_n").distinct()
    found, said = m.agg(F.count(F.lit(1)), F.max("_n")).first()
    if found != said:
        raise ValueError(f"{found} offsets, and {said} were expected")
    return m.select("offset")


def read_calibration_rows(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text): JSON lines, those that can't be parsed or lack an id or a text left out; of rows with one canonical id the first wins."""
    df = spark.read.schema("query_id string, source_query_id string, split_role string, text string, bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)
    rows = df.withColumn("line_no", F.monotonically_increasing_id()).filter("bad is null").select(canonical_query_id(F.col("query_id"), F.col("source_query_id")).alias("query_id"), clean_text(F.col("text")).alias("text"), "split_role", "line_no")
    rows = rows.filter("query_id <> '' and text <> '' and (split_role is null or lower(trim(split_role)) = 'calibration')")
    return rows.groupBy("query_id").agg(F.min_by("text", "line_no").alias("text"))


def first_aliases(df: DataFrame, canonical: str, *aliases: str) -> DataFrame:
    """(alias, canonical): every spelling of an id with its canonical one; of several the first in the order of the columns, then the smallest, wins."""
    rows = df.select(F.col(canonical).cast("string").alias("canonical"), F.posexplode(F.array(*(F.trim(F.col(a).cast("string")) for a in aliases))).alias("place", "alias")).filter("alias <> '' and canonical is not null")
    return rows.groupBy("alias").agg(F.min(F.struct("place", "canonical")).alias("x")).select("alias", F.col("x.canonical").alias("canonical"))


def load_workset(docs: DataFrame, ids: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """docs(doc_idx, v) with ids(doc_idx, doc_id) and texts(doc_idx, text); tables of other lengths, or numbers that don't match, are an error."""
    n, m = docs.count(), ids.count()
    if n != m or (texts is not None and texts.count() != n):
        raise ValueError(f"{n} vectors, and {m} ids")
    out = docs.join(ids, "doc_idx")
    out = out if texts is None else out.join(texts, "doc_idx")
    if out.count() != n:
        raise ValueError("vectors, ids and texts are numbered differently")
    return out


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(f.getPath().toString() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or [])


def resolve_variant(spark: SparkSession, root: str, stem: str, ext: str, required: bool = True) -> str | None:
    """``root/stem.ext``, else the one path ``root/stem*.ext``; several are an error, and none is if it is required."""
    found = _listed(spark, f"{root}/{stem}{ext}") or _listed(spark, f"{root}/{stem}*{ext}")
    if len(found) > 1 or (required and not found):
        raise ValueError(f"{root}/{stem}*{ext} names {len(found)} paths")
    return found[0] if found else None


def missing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that don't exist."""
    return [p for p in paths if not _listed(spark, p)]


def ready_worksets(spark: SparkSession, root: str, needed: tuple[str, ...], wanted: list[str] | None = None) -> list[str]:
    """Folders below ``root`` that have all needed files; a wanted one that hasn't is an error."""
    names = [p.rpartition("/")[2] for p in _listed(spark, f"{root}/*")]
    ready = [n for n in names if not missing_paths(spark, [f"{root}/{n}/{f}" for f in needed])]
    if wanted is None:
        return ready
    if lacking := [n for n in wanted if n not in ready]:
        raise ValueError(f"{lacking} aren't ready")
    return list(wanted)


def resolve(spark: SparkSession, pattern: str) -> str:
    """The one path that a pattern names; none or several are an error."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    if len(found) != 1:
        raise ValueError(f"{pattern} names {len(found)} paths")
    return found[0].getPath().toString()
