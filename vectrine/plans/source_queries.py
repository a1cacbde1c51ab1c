"""The registered queries of readers and writers: tables are written in a file shape, read back, and compared with the SQL of the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrine.operators import clustering as cl
from vectrine.operators import metrics, sampling
from vectrine.plans.materialize import Scratch
from vectrine.plans.queries import _BASE, _CLEAN, DIM, EVAL_K, centers, cluster_profile, docs, joined, parts, query, r_max_surrogate, read, truth
from vectrine.sources import readers as rd
from vectrine.sources import writers as wr


def _folder(spark) -> str:
    return Scratch(spark).root


_TEXTS = f"SELECT doc_id::VARCHAR AS doc_id, {_CLEAN('text')} AS text FROM documents WHERE {_CLEAN('text')} <> ''"


@query(_TEXTS)
def corpus_lines(spark, sf):
    """JSON lines, compressed, in folders below each other; the first present names of id and text count."""
    at = _folder(spark)
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("_id"), "text", F.col("source"))
    d.filter("_id % 2 = 0").write.option("compression", "gzip").json(f"{at}/a/deep")
    wr.write_jsonl(d.filter("_id % 2 = 1").select(F.col("_id").cast("string").alias("id"), F.col("text").alias("contents")), f"{at}/b")
    return rd.read_corpus(spark, at, "_id long, id string, text string, contents string")


@query("SELECT vec_id::VARCHAR AS query_id, 'label ' || label AS text, len(embedding) AS dim, round(embedding[1], 6) AS first FROM embeddings")
def embedded_queries(spark, sf):
    """From files named after queries anywhere below a folder; the first row of an id wins, rows without a vector are dropped."""
    at = _folder(spark)
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("_id"), F.concat(F.lit("label "), "label").alias("text"), F.col("embedding").alias("emb"))
    again = e.withColumn("text", F.lit("again"))
    none = e.select(F.col("_id") + 1_000_000, "text", F.lit(None).cast("array<float>").alias("emb")).toDF("_id", "text", "emb")
    lines = e.withColumn("p", F.lit(0)).unionByName(again.withColumn("p", F.lit(1))).unionByName(none.withColumn("p", F.lit(2))).orderBy("p", "_id").coalesce(1).drop("p")
    lines.write.option("compression", "gzip").json(f"{at}/parts")
    moved = f"{at}/set/x_queries.jsonl.gz"
    _rename(spark, f"{at}/parts", moved)
    q = rd.read_embedded_queries(spark, f"{at}/set")
    return q.select("query_id", "text", F.size("embedding").cast("long").alias("dim"), F.round(F.col("embedding")[0], 6).alias("first"))


def _rename(spark, folder: str, path: str) -> None:
    """The one data file of a folder under another name."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    source = rd.resolve(spark, f"{folder}/part-*")
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    fs.rename(hadoop.Path(source), target)


_QRELS = "SELECT DISTINCT query_idx::VARCHAR AS query_id, doc_idx::VARCHAR AS doc_id FROM gt_topk"


def _qrels(spark, sf):
    return read(spark, sf, "gt_topk").select(F.col("query_idx").cast("string").alias("query_id"), F.col("doc_idx").cast("string").alias("doc_id"))


@query(_QRELS)
def qrels_strict(spark, sf):
    at = _folder(spark)
    wr.write_tsv(_qrels(spark, sf), at)
    return rd.read_qrels_strict(spark, at)


@query(_QRELS)
def qrels_detected(spark, sf):
    """Lines of four fields, and lines of two with a header."""
    at = _folder(spark)
    q = _qrels(spark, sf)
    q.filter("cast(doc_id as long) % 2 = 0").select(F.concat_ws(" ", "query_id", F.lit("0"), "doc_id", F.lit("1"))).write.text(f"{at}/four")
    wr.write_tsv(q.filter("cast(doc_id as long) % 2 = 1"), f"{at}/two")
    return rd.read_qrels(spark, f"{at}/four").unionByName(rd.read_qrels(spark, f"{at}/two"))


@query(f"SELECT * FROM ({_QRELS}) WHERE query_id::BIGINT % 2 = 0 AND doc_id::BIGINT % 3 > 0")
def qrels_restricted(spark, sf):
    q = _qrels(spark, sf)
    return rd.restrict_qrels(q, q.filter("cast(query_id as long) % 2 = 0"), q.filter("cast(doc_id as long) % 3 > 0"))


@query(_QRELS.replace("query_idx::VARCHAR AS query_id, doc_idx::VARCHAR AS doc_id", "query_idx::VARCHAR AS query_id"))
def judged_queries(spark, sf):
    """The queries that judgements allow."""
    at = _folder(spark)
    wr.write_tsv(_qrels(spark, sf), at)
    return rd.read_qrels(spark, at).select("query_id").distinct()


@query("SELECT p_partkey::VARCHAR AS query_id, trim(p_name) AS text FROM part")
def query_lines(spark, sf):
    """Lines of an id and a text; the first of an id wins."""
    at = _folder(spark)
    p = read(spark, sf, "part").select("p_partkey", F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name").alias("value"))
    lines = p.withColumn("o", F.lit(0)).unionByName(p.select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit("\tlater")).alias("value"), F.lit(1).alias("o")))
    lines.orderBy("o", "p_partkey").coalesce(1).select("value").write.text(at)
    return rd.read_query_tsv(spark, at)


@query("SELECT l_suppkey, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1")
def first_seen(spark, sf):
    li = read(spark, sf, "lineitem").withColumn("place", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rd.first_seen(li, "l_suppkey", "place")


@query('SELECT o_orderkey AS "O_OrderKey", o_custkey FROM orders')
def projected_columns(spark, sf):
    return rd.read_parquet_columns(spark, f"{sf}/orders.parquet", ["O_OrderKey", "o_custkey"])


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def matrix_rows(spark, sf):
    at = f"{_folder(spark)}/m.npy"
    wr.write_npy(read(spark, sf, "embeddings"), "vec_id", "embedding", at)
    return rd.read_matrices(spark, at).select("row", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query('SELECT o_orderkey AS "offset" FROM orders UNION SELECT unnest(range(50))')
def text_offsets(spark, sf):
    at = _folder(spark)
    o = read(spark, sf, "orders").select("o_orderkey")
    o.select(F.col("o_orderkey").cast("string")).write.text(at)
    n = o.unionByName(spark.range(50).toDF("o_orderkey")).distinct().count()
    return rd.read_offsets(spark, at, 50, n)


@query('SELECT o_orderkey AS "offset" FROM orders')
def manifest_offsets(spark, sf):
    at = _folder(spark)
    o = read(spark, sf, "orders").agg(F.collect_set("o_orderkey").alias("offsets")).withColumn("count", F.size("offsets"))  # a manifest is one document
    wr.write_json(o, at)
    return rd.read_offset_manifest(spark, at)


def _ranked(spark, sf):
    return read(spark, sf, "gt_topk").select(F.col("query_idx").alias("query_id"), "rank", "doc_idx").distinct()


def _lists(spark, sf):
    """A list a query, dense from rank 1, so a place in it is a rank."""
    r = _ranked(spark, sf).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_idx"))).alias("l"))
    return r.select("query_id", F.transform("l", lambda x: x["doc_idx"]).alias("doc_indices"))


_DENSE = "WITH g AS (SELECT DISTINCT query_idx, rank, doc_idx FROM gt_topk), r AS (SELECT query_idx, doc_idx, row_number() OVER (PARTITION BY query_idx ORDER BY rank, doc_idx) AS rank FROM g)"
_BY_LIST = _DENSE + " SELECT query_idx::VARCHAR AS query_id, min(rank)::INT AS rank, 'd' || doc_idx AS doc_id FROM r GROUP BY query_idx, doc_idx"


def _names(spark, sf):
    return read(spark, sf, "gt_topk").select("doc_idx").distinct().withColumn("doc_id", F.concat(F.lit("d"), "doc_idx"))


@query(_BY_LIST)
def rankings_jsonl(spark, sf):
    at = _folder(spark)
    wr.write_jsonl(_lists(spark, sf), at)
    return rd.read_rankings(spark, at, "jsonl", _names(spark, sf))


@query(_BY_LIST)
def rankings_json(spark, sf):
    at = _folder(spark)
    wr.write_json(_lists(spark, sf).agg(F.collect_list(F.struct("query_id", "doc_indices")).alias("rows")), at)  # one document, as such files are
    return rd.read_rankings(spark, at, "json", _names(spark, sf))


@query(_BY_LIST)
def rankings_tsv(spark, sf):
    """Lines in no order of their ranks, which are counted from 1 when read."""
    at = _folder(spark)
    lines = _ranked(spark, sf).select("query_id", F.concat(F.lit("d"), "doc_idx").alias("doc_id"), "rank", "doc_idx")
    wr.write_tsv(lines.orderBy("doc_idx").coalesce(1).drop("doc_idx"), at)
    return rd.read_rankings(spark, at, "tsv")


@query(_DENSE + " , q AS (SELECT query_idx, row_number() OVER (ORDER BY query_idx) - 1 AS i FROM (SELECT query_idx FROM r GROUP BY 1 HAVING count(*) >= 5)) SELECT i::VARCHAR AS query_id, min(rank)::INT AS rank, 'd' || doc_idx AS doc_id FROM r JOIN q USING (query_idx) WHERE rank <= 5 GROUP BY i, doc_idx")
def rankings_npy(spark, sf):
    at = f"{_folder(spark)}/r.npy"
    full = _lists(spark, sf).filter(F.size("doc_indices") >= 5).select("query_id", F.slice("doc_indices", 1, 5).cast("array<float>").alias("v"))
    wr.write_npy(full, "query_id", "v", at)
    return rd.read_rankings(spark, at, "npy", _names(spark, sf))


_LOG = """WITH l AS (SELECT n_nationkey AS k, n_name, n_regionkey AS g FROM nation)"""


def _log(spark, sf):
    """One log a region: sections with phases, times, bytes and neighbours."""
    at = _folder(spark)
    n = read(spark, sf, "nation")
    rows = n.select("n_regionkey", (F.col("n_nationkey") * 10).alias("o"), F.explode(F.array(
        F.struct(F.lit(0).alias("p"), F.concat(F.lit("== section "), "n_name", F.lit(" ==")).alias("value")),
        F.struct(F.lit(1).alias("p"), F.lit("phase: query").alias("value")),
        F.struct(F.lit(2).alias("p"), F.concat(F.lit("Total time: "), F.col("n_nationkey").cast("string"), F.lit(".5 ms, rest")).alias("value")),
        F.struct(F.lit(3).alias("p"), F.concat(F.lit("Total comm: "), (F.col("n_nationkey") + 1).cast("string"), F.lit(" MB")).alias("value")),
        F.struct(F.lit(4).alias("p"), F.concat(F.lit("k-NNs IDs: ("), F.col("n_nationkey").cast("string"), F.lit(", 7 9,x)")).alias("value")),
        F.struct(F.lit(5).alias("p"), F.lit("took 1.5ms").alias("value")),
    )).alias("x")).select("n_regionkey", "o", "x.p", "x.value")
    for g in range(5):
        rows.filter(F.col("n_regionkey") == g).orderBy("o", "p").coalesce(1).select("value").write.text(f"{at}/log{g}")
    return rd.lines(spark, f"{at}/log*").withColumn("file", F.regexp_extract("file", r"/(log\d)/", 1))


@query(_LOG + " SELECT 'log' || g AS file, max(k) + 0.5::DOUBLE AS total_ms, (max(k) + 1)::DOUBLE AS total_mb FROM l GROUP BY g")
def log_metrics(spark, sf):
    return rd.last_metric(_log(spark, sf), **rd.COMMON_METRICS)


@query(_LOG + " SELECT 'log' || g AS file, max(k) || ',7,9' AS ids FROM l GROUP BY g")
def log_neighbours(spark, sf):
    ids = rd.neighbour_ids(_log(spark, sf), 4)
    return ids.withColumn("ids", joined("ids"))


@query(_LOG + " SELECT 'log' || g AS file, n_name AS section, 'query' AS phase, 0.0015::DOUBLE AS seconds, k + 0.5::DOUBLE AS total_ms FROM l")
def log_sections(spark, sf):
    """The section and phase that each line stands in, carried forward, and the figures of each section."""
    s = rd.sections(_log(spark, sf), r"^== section (.*) ==$").withColumnRenamed("section", "s")
    s = rd.sections(s, r"^phase: (\w+)$").withColumnsRenamed({"section": "phase", "s": "section"})
    took = F.regexp_extract("value", r"^took (\S+)$", 1)
    total = F.regexp_extract("value", rd.COMMON_METRICS["total_ms"], 1).try_cast("double")
    return s.filter("phase is not null").groupBy("file", "section").agg(F.max("phase").alias("phase"), F.round(F.max(metrics.duration_seconds(took)), 9).alias("seconds"), F.max(total).alias("total_ms"))


@query("SELECT vec_id AS doc_idx, 'ws_' || vec_id AS doc_id, '[synthetic] ws_' || vec_id AS text FROM embeddings")
def synthetic_ids(spark, sf):
    return rd.synthetic_ids(docs(spark, sf), "ws").select("doc_idx", "doc_id", "text")


@query("SELECT n_nationkey, 'a,b,' || n_name AS parts, CASE WHEN n_name = 'FRANCE' THEN 'b,a,FRANCE' ELSE 'b,a' END AS kept FROM (SELECT n_nationkey, split_part(n_name, ' ', 1) AS n_name FROM nation)")
def coerced_lists(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", F.split_part("n_name", F.lit(" "), F.lit(1)).alias("n"))
    text = F.concat(F.lit(" a, b  "), "n")
    return n.select("n_nationkey", rd.coerce_sequence(text).alias("parts"), rd.allowed_only(F.array(F.lit("b"), F.lit("a"), F.lit("b"), "n"), ["a", "b", "FRANCE"]).alias("kept")).withColumns({"parts": joined("parts"), "kept": joined("kept")})


@query(f"SELECT coalesce(nullif(trim(source_query_id), ''), trim(query_id)) AS query_id, min({_CLEAN('text')}) AS text FROM workset_queries WHERE {_CLEAN('text')} <> '' AND lower(trim(split_role)) = 'calibration' GROUP BY 1")
def calibration_rows(spark, sf):
    """JSON lines with some that can't be parsed; of one id the smallest text comes first here."""
    at = _folder(spark)
    q = read(spark, sf, "workset_queries").filter("lower(trim(split_role)) = 'calibration'").select("query_id", "source_query_id", "split_role", F.trim("text").alias("text"))
    tidy = q.select("query_id", "source_query_id", "split_role", F.regexp_replace("text", r"[\s\p{Z}\x0b\x85\x1c-\x1f]+", " ").alias("text"))
    lines = tidy.select(F.to_json(F.struct("*")).alias("value"), F.trim("text").alias("t"))
    bad = spark.createDataFrame([("{not json", ""), ("", "")], "value string, t string")
    lines.unionByName(bad).orderBy("t").coalesce(1).select("value").write.text(at)
    return rd.read_calibration_rows(spark, at)


@query("WITH a AS (SELECT p_partkey::VARCHAR AS canonical, unnest([p_partkey::VARCHAR, 'p' || p_partkey, p_brand]) AS alias, unnest([0, 1, 2]) AS place FROM part) SELECT alias, arg_min(canonical, (place, canonical)) AS canonical FROM a GROUP BY alias")
def first_aliases(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.concat(F.lit("p"), "p_partkey").alias("b"), F.col("p_brand").alias("c"))
    return rd.first_aliases(p, "p_partkey", "p_partkey", "b", "c")


@query("SELECT vec_id AS doc_idx, 'ws_' || vec_id AS doc_id FROM embeddings")
def loaded_workset(spark, sf):
    named = rd.synthetic_ids(docs(spark, sf).select("doc_idx"), "ws")
    return rd.load_workset(docs(spark, sf), named.select("doc_idx", "doc_id"), named.select("doc_idx", "text")).select("doc_idx", "doc_id")


@query("SELECT * FROM (VALUES ('exact', 'docs.npy'), ('variant', 'ids_v2.npy'), ('ready', 'a'), ('missing', 'b/ids.npy'), ('error', 'several')) t(kind, name)")
def resolved_paths(spark, sf):
    """An exact name, a variant of it, folders that have all files, what is missing, and a name that is no longer unique."""
    at = _folder(spark)
    one = spark.range(1).select(F.lit("x")).coalesce(1)
    for name in ("w/docs.npy", "w/docs_old.npy", "w/ids_v2.npy", "s/a/docs.npy", "s/a/ids.npy", "s/b/docs.npy", "t/q_1.npy", "t/q_2.npy"):
        one.write.text(f"{at}/{name}")
    tail = lambda p: p.rpartition("/")[2]
    try:
        several = tail(rd.resolve_variant(spark, f"{at}/t", "q", ".npy"))
    except ValueError:
        several = "several"
    missing = rd.missing_paths(spark, [f"{at}/s/{n}/{f}" for n in "ab" for f in ("docs.npy", "ids.npy")])
    rows = [("exact", tail(rd.resolve_variant(spark, f"{at}/w", "docs", ".npy"))), ("variant", tail(rd.resolve_variant(spark, f"{at}/w", "ids", ".npy"))), ("ready", ",".join(rd.ready_worksets(spark, f"{at}/s", ("docs.npy", "ids.npy")))),
            ("missing", ",".join("/".join(m.split("/")[-2:]) for m in missing)), ("error", several)]
    return spark.createDataFrame(rows, "kind string, name string")


# --- writers -----------------------------------------------------------------


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, NULL::VARCHAR AS note FROM events")
def json_summary(spark, sf):
    at = _folder(spark)
    wr.write_json(read(spark, sf, "events").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).withColumn("note", F.lit(None).cast("string")), at)
    return spark.read.schema("n long, mean double, note string").json(at)


_CONTRACT = "SELECT 'run' || n_nationkey AS run_label, n_nationkey AS num_docs, 3.0::DOUBLE AS total_ms, %s AS notes FROM nation"


def _contract(spark, sf):
    one = [F.lit(1).alias(f"{s}_ms") for s in ("client", "server", "recover")]
    return read(spark, sf, "nation").select(F.concat(F.lit("run"), "n_nationkey").alias("run_label"), F.col("n_nationkey").alias("num_docs"), *one, F.array(F.lit("a"), F.lit("b")).alias("notes"))


@query(_CONTRACT % "'a|b'")
def contract_csv(spark, sf):
    at = _folder(spark)
    wr.write_contract_csv(_contract(spark, sf), at)
    return spark.read.csv(at, header=True, inferSchema=True).select("run_label", F.col("num_docs").cast("long").alias("num_docs"), F.col("total_ms").cast("double").alias("total_ms"), "notes")


@query(_CONTRACT % "'a,b'")
def contract_jsonl(spark, sf):
    at = _folder(spark)
    wr.write_contract_jsonl(_contract(spark, sf), at)
    return spark.read.json(at).select("run_label", "num_docs", F.col("total_ms").cast("double").alias("total_ms"), joined("notes").alias("notes"))


@query(_BASE + f"SELECT query_id, rank, doc_idx, (doc_idx % 2 = 0)::INT AS relevant FROM t WHERE rank <= {EVAL_K}")
def topk_lines(spark, sf):
    at = _folder(spark)
    t = truth(spark, sf)
    wr.write_topk_tsv(t, t.filter("doc_idx % 2 = 0").select("query_id", "doc_idx"), at)
    return spark.read.csv(at, sep="\t", header=True, schema="query_id long, rank int, doc_idx long, relevant int")


@query("SELECT label AS cluster_id, count(*) AS members, 'balanced' AS method FROM embeddings GROUP BY label")
def cluster_artifact(spark, sf):
    """A partition with radii, written, loaded and held against its contract."""
    at = _folder(spark)
    clusters = cluster_profile(spark, sf).select("cluster_id", "r_k", "r_fixed").join(r_max_surrogate(spark, sf).select("cluster_id", "r_max"), "cluster_id").join(centers(spark, sf).select("cluster_id", "center"), "cluster_id")
    wr.write_cluster_artifact(parts(spark, sf), clusters, {"method": "balanced", "dim": DIM}, at)
    a, c, meta = wr.read_cluster_artifact(spark, at, docs(spark, sf))
    return a.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members")).join(c.select("cluster_id"), "cluster_id").withColumn("method", F.lit(meta["method"]))


@query(_BASE + f"SELECT CASE WHEN query_id % 200 = 0 THEN 'calibration' ELSE 'evaluation' END AS split_role, count(DISTINCT query_id) AS queries, count(*) AS neighbours, count(*) AS judged, 'set' AS name FROM t WHERE rank <= {EVAL_K} GROUP BY 1")
def query_artifacts(spark, sf):
    """Queries by role with vectors, texts, neighbours, judgements and settings, written and read again."""
    at = _folder(spark)
    e = read(spark, sf, "embeddings").filter("vec_id % 100 = 0")
    q = e.select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 200 == 0, "calibration").otherwise("evaluation").alias("split_role"), F.lit("text").alias("text"), F.col("embedding").alias("v"))
    t = truth(spark, sf)
    wr.write_query_artifacts(q, t, t.select("query_id", F.col("doc_idx").alias("doc_id")), {"name": "set"}, at)
    back, exact, qrels = spark.read.parquet(f"{at}/queries"), spark.read.parquet(f"{at}/exact_topk"), rd.read_qrels_strict(spark, f"{at}/qrels")
    meta = spark.read.json(f"{at}/meta").select(F.col("name"))
    j = back.select("query_id", "split_role")
    near = j.join(exact, "query_id").groupBy("split_role").agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"))
    judged = j.join(qrels.select(F.col("query_id").cast("long").alias("query_id"), "doc_id"), "query_id").groupBy("split_role").agg(F.count(F.lit(1)).alias("judged"))
    return near.join(judged, "split_role").crossJoin(meta).select("split_role", "queries", "neighbours", "judged", "name")  # one row of settings


@query("SELECT label AS cluster_id, count(*) AS size FROM embeddings GROUP BY 1")
def audit_rows(spark, sf):
    """A row a cluster, the same in all three shapes."""
    at = _folder(spark)
    wr.write_audit(centers(spark, sf).select("cluster_id", "size", "center"), at)
    shapes = (spark.read.csv(f"{at}/csv", header=True, schema="cluster_id long, size long"), spark.read.json(f"{at}/json"), spark.read.parquet(f"{at}/table"))
    out = None
    for s in shapes:
        s = s.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("size").cast("long").alias("size"))
        out = s if out is None else out.intersect(s)
    return out


@query("SELECT vec_id, len(embedding) AS dim FROM embeddings")
def resumed_cache(spark, sf):
    """A cache of vectors that was cut short, and then completed without writing a row twice."""
    at = _folder(spark)
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    wr.append_missing(e.filter("vec_id % 3 = 0"), at, "vec_id")
    wr.append_missing(e, at, "vec_id")
    return spark.read.parquet(at).select("vec_id", F.size("embedding").cast("long").alias("dim"))


@query("SELECT true AS same, false AS other, false AS shorter")
def cache_checks(spark, sf):
    d = docs(spark, sf)
    digest = lambda x: sampling.id_digest(x, F.col("doc_idx"), F.col("doc_idx")).first()[0]
    meta = {"num_docs": d.count(), "doc_ids_sha256": digest(d)}
    less = d.filter("doc_idx > 0")
    rows = [(wr.cache_matches(meta, d.count(), digest(d)), wr.cache_matches(meta, d.count(), digest(less)), wr.cache_matches(meta, less.count(), digest(d)))]
    return spark.createDataFrame(rows, "same boolean, other boolean, shorter boolean")


@query("SELECT vec_id, 4 * len(embedding) AS bytes, list_sum(list_transform(embedding, lambda x: greatest(0, least(255, round_even((x::DOUBLE + 1) * 127.5, 0)::INT))))::BIGINT AS total FROM embeddings")
def exported_bytes(spark, sf):
    """Vectors as 32-bit unsigned integers, and what they add up to when read from the text form."""
    at = _folder(spark)
    e = read(spark, sf, "embeddings")
    b = wr.quantized_bytes(e, "vec_id", "embedding").select("vec_id", F.octet_length("bytes").alias("bytes"), F.hex("bytes").alias("h"))
    wr.write_matrix_text(e, "embedding", at, quantize=True)
    four = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.conv(F.substring("h", i * 8 + 1, F.lit(2)), 16, 10).cast("long"))
    same = spark.read.text(at).count() == e.count()
    total = F.aggregate(four, F.lit(0).cast("long"), lambda s, x: s + x)
    return b.select("vec_id", "bytes", (total if same else F.lit(-1)).alias("total"))


@query(f"SELECT * FROM ({_QRELS}) WHERE query_id::BIGINT % 2 = 0 AND doc_id::BIGINT % 3 > 0")
def bundle(spark, sf):
    at = _folder(spark)
    q = _qrels(spark, sf)
    wr.write_bundle(q.filter("cast(doc_id as long) % 3 > 0").select("doc_id").distinct(), q.filter("cast(query_id as long) % 2 = 0").select("query_id").distinct(), q, at)
    return rd.read_qrels_strict(spark, f"{at}/qrels").join(spark.read.parquet(f"{at}/docs"), "doc_id", "left_semi").join(spark.read.parquet(f"{at}/queries"), "query_id", "left_semi").select("query_id", "doc_id")


@query("SELECT 64 AS signature_length, true AS order_free, true AS differs, 2 AS header_constants, 3 AS manifest_stages")
def signatures(spark, sf):
    import json

    a, b, c = wr.settings_signature({"k": 5, "dim": 64}), wr.settings_signature({"dim": 64, "k": 5}), wr.settings_signature({"k": 6, "dim": 64})
    header = wr.bridge_header({"Dim": 64, "TopK": 10}).count("constexpr")
    stages = json.loads(wr.manifest("search", [("a", "x"), ("b", "y"), ("c", "z")]))["stages"]
    return spark.createDataFrame([(len(a), a == b, a != c, header, len(stages))], "signature_length int, order_free boolean, differs boolean, header_constants int, manifest_stages int")


@query("SELECT doc_id AS doc_idx, doc_id // 100 AS cluster_id FROM documents")
def sequential_chunks(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("doc_idx"))
    return cl.sequential_partition(d, 100, 0.1).select("doc_idx", "cluster_id")
