"""The queries of this subpackage over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrine.functions.vectors import normalize
from vectrine.llm.bit_codes import BitCodeConfig, most_similar, routed_similar
from vectrine.llm.capping import cap_per_contributor, contributor_key
from vectrine.llm.near_duplicates import NearDuplicateConfig, near_duplicates
from vectrine.llm.packing import PackConfig, fill_containers
from vectrine.llm.repetition import repetition
from vectrine.llm.similarity_groups import similarity_groups
from vectrine.llm.split_overlap import ROLL_BASE, ROLL_PRIME, split_overlaps
from vectrine.llm.splitting import split_oversized
from vectrine.llm.tokenizer import TokenizerFile, encode_corpus, token_counts
from vectrine.llm.varied_subset import SubsetConfig, varied_subset
from vectrine.operators.clustering import centroids
from vectrine.operators.knn import against_centers
from vectrine.plans.materialize import Scratch

#: What TESTDATA.md states of problem 4.
PASSAGES = NearDuplicateConfig(width=3, least_words=8, similarity=0.6)


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _capped(spark: SparkSession, sf: str) -> DataFrame:
    units = _read(spark, sf, "retrieval_units")
    return cap_per_contributor(units, contributor_key(F.col("source_doc_id"), F.col("doc_id")), F.col("unit_id"), F.col("quality"), max_count=10)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _capped(spark, sf).filter(~F.col("kept")).select(F.col("record").alias("unit_id"))


def p1_contributors(spark: SparkSession, sf: str) -> DataFrame:
    return _capped(spark, sf).groupBy("contributor").agg(F.count(F.lit(1)).alias("units"), F.count_if("kept").alias("kept"))


def p2_subset(spark: SparkSession, sf: str) -> DataFrame:
    return varied_subset(_read(spark, sf, "workset_docs"), F.col("doc_idx"), F.col("embedding"), share=0.05, cfg=SubsetConfig(stray=0.45)).withColumnRenamed("id", "doc_idx")


def p2_checks(spark: SparkSession, sf: str) -> DataFrame:
    """How many were chosen, and whether they are different and usable."""
    chosen = p2_subset(spark, sf)
    docs = _read(spark, sf, "workset_docs").filter(F.size("embedding") == 64).select("doc_idx").distinct().withColumn("known", F.lit(True))
    return chosen.join(docs, "doc_idx", "left").agg(F.count(F.lit(1)).alias("chosen"), (F.count_distinct("doc_idx") == F.count("known")).alias("different_and_usable"))


def _groups(spark: SparkSession, sf: str):
    return similarity_groups(_read(spark, sf, "workset_docs"), F.col("doc_idx"), F.col("embedding"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf).members.select(F.col("id").alias("doc_idx"), "group_idx")


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Size, radius (the member farthest from the mean direction), share of members by the graph's communities, and the five most typical docs of each group."""
    g = _groups(spark, sf).degrees()
    size = g.groupBy("group_idx").agg(F.count(F.lit(1)).alias("size"), F.acos(F.least(F.lit(1.0), F.min("cosine"))).alias("r_max"), F.avg(F.col("by_graph").cast("double")).alias("by_graph"))
    w = Window.partitionBy("group_idx").orderBy(F.desc("degree"), "id")
    top = g.withColumn("r", F.row_number().over(w)).filter("r <= 5").groupBy("group_idx").agg(F.sort_array(F.collect_list(F.struct("r", "id"))).alias("t"))
    return size.join(top, "group_idx").select("group_idx", "size", "r_max", "by_graph", F.col("t.id").alias("typical"))


def p3_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the groups are what their definition says: large enough, each member near its own mean direction and far from the others, each other vector far from all."""
    scratch = Scratch(spark)
    groups = scratch.cut(p3_found(spark, sf))
    v = _read(spark, sf, "workset_docs").dropDuplicates(["doc_idx"]).select("doc_idx", F.col("embedding").alias("v")).filter("size(v) = 64")
    unit = v.join(groups, "doc_idx").select(F.col("group_idx").alias("cluster_id"), normalize(F.col("v")).alias("v"))
    means = scratch.cut(centroids(unit, 64))
    near = against_centers(v, F.col("doc_idx"), F.col("v"), means, 2)
    per = near.groupBy(F.col("id").alias("doc_idx")).agg(F.max(F.when(F.col("rank") == 1, F.col("cluster_id"))).alias("best"), F.cos(F.max(F.when(F.col("rank") == 1, F.col("value")))).alias("first"), F.coalesce(F.cos(F.max(F.when(F.col("rank") == 2, F.col("value")))), F.lit(-1.0)).alias("second"))
    all_rows = per.join(groups, "doc_idx", "left")
    member = F.col("group_idx").isNotNull()
    ok = all_rows.agg(
        F.bool_and(~member | ((F.col("best") == F.col("group_idx")) & (F.col("first") >= 0.48 - 1e-6))).alias("members_near"),
        F.bool_and(~member | (F.col("second") < 0.45 + 1e-6)).alias("others_far"),
        (F.count_if(~member & (F.col("first") >= 0.45 + 1e-6)) <= 0.02 * F.count_if(member)).alias("strays_far"),
    )
    return ok.crossJoin(means.agg((F.min("size") >= 10).alias("large")))  # one row each


def _passages(spark: SparkSession, sf: str):
    return near_duplicates(_read(spark, sf, "retrieval_units"), F.col("unit_id"), F.col("text"), PASSAGES)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _passages(spark, sf).expanded().select(F.col("a").alias("unit_id_a"), F.col("b").alias("unit_id_b"))


def p4_links(spark: SparkSession, sf: str) -> DataFrame:
    return _passages(spark, sf).links().withColumnRenamed("id", "unit_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    role = F.lower(F.regexp_replace("split_role", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    queries = _read(spark, sf, "workset_queries").filter(role.isin("calibration", "evaluation"))
    hits = most_similar(_read(spark, sf, "workset_docs"), F.col("doc_idx"), F.col("embedding"), queries, F.col("query_idx"), F.col("embedding"), BitCodeConfig(k=5))
    return hits.select(F.col("query").alias("query_idx"), F.col("neighbour").alias("doc_idx"))


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 most similar others of every doc whose doc_idx is divisible by 100, among all docs, by lists."""
    docs = _read(spark, sf, "workset_docs")
    asked = docs.filter("doc_idx % 100 = 0")
    hits = routed_similar(docs, F.col("doc_idx"), F.col("embedding"), asked, F.col("doc_idx"), F.col("embedding"), BitCodeConfig(k=6))
    w = Window.partitionBy("query").orderBy("rank")
    others = hits.filter("query <> neighbour").withColumn("rank", F.row_number().over(w)).filter("rank <= 5")
    return others.select(F.col("query").alias("doc_idx"), "rank", F.col("neighbour").alias("neighbour_idx"), F.round("cosine", 9).alias("cosine"))


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    q = _read(spark, sf, "workset_queries")
    return split_overlaps(q, F.col("query_idx"), F.coalesce("source_query_id", "query_id"), F.col("split_role"), F.col("text"), F.col("embedding"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _overlaps(spark, sf).pairs().select(F.least("train_id", "held_id").alias("query_idx_a"), F.greatest("train_id", "held_id").alias("query_idx_b"))


def p6_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each held-out row: whether a train row agrees with it, and the share of its text in chunks that train rows have."""
    return _overlaps(spark, sf).records().withColumnRenamed("held_id", "query_idx").withColumn("overlap", F.round("overlap", 9))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out rows by the kind of their overlap, and the mean share of their text that train rows have, of each split and dataset."""
    role = F.lower(F.regexp_replace("split_role", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    rows = _read(spark, sf, "workset_queries").select(F.col("query_idx").alias("held_id"), role.alias("split"), "dataset").dropDuplicates(["held_id"])
    flags = ("by_id", "by_text", "by_vector")
    count = [F.count_if(f).alias(f"rows_{f}") for f in flags]
    of = _overlaps(spark, sf).records().join(rows, "held_id").groupBy("split", "dataset")
    return of.agg(F.count(F.lit(1)).alias("held_out_rows"), F.count_if(F.expr(" or ".join(flags))).alias("overlapping_rows"), *count, F.round(F.avg("overlap"), 6).alias("mean_overlap"))


def _body(df: DataFrame):
    blank = F.regexp_replace("text", r"[\s\p{Z}]+", "") == ""
    return F.when(F.col("text").isNull() | blank, F.col("contents")).otherwise(F.col("text"))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    raw = _read(spark, sf, "raw_corpus")
    return split_oversized(raw.withColumn("body", _body(raw)), F.col("doc_id"), F.col("body"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).filter("piece_no > 0").select(F.col("id").alias("doc_id")).distinct()


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every different text of a document; redelivered rows with the same text count once."""
    raw = _read(spark, sf, "raw_corpus")
    raw = raw.select("row_no", "doc_id", _body(raw).alias("body"))
    once = raw.groupBy("doc_id", F.sha2("body", 256).alias("h")).agg(F.min("row_no").alias("row_no")).select("row_no")
    kept = raw.join(once, "row_no", "left_semi")
    pieces = split_oversized(kept, F.col("row_no"), F.col("body"))
    names = kept.select(F.col("row_no").cast("string").alias("id"), "row_no", "doc_id")
    return pieces.join(names, "id").select("doc_id", "row_no", "piece_no", "start", "end", "piece")


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document: whether its pieces keep the limit, cover its texts without a gap, and end where the text does."""
    raw = _read(spark, sf, "raw_corpus")
    body = F.trim(F.regexp_replace(F.coalesce(_body(raw), F.lit("")), r"[\s\p{Z}\x0b\x85\x1c-\x1f]+", " "))
    size = raw.select("row_no", F.length(body).alias("chars"))
    w = Window.partitionBy("row_no").orderBy("piece_no")
    p = p7_pieces(spark, sf).join(size, "row_no").withColumn("gap", F.col("start") > F.coalesce(F.lag("end").over(w), F.lit(0)))
    row = p.groupBy("doc_id", "row_no").agg((F.max(F.length("piece")) <= 2000).alias("within"), (~F.bool_or("gap") & (F.min("start") == 0)).alias("covered"), (F.max("end") == F.first("chars")).alias("to_the_end"))
    return row.groupBy("doc_id").agg(*(F.bool_and(c).alias(c) for c in ("within", "covered", "to_the_end")))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(_read(spark, sf, "documents"), F.col("doc_id"), F.col("text"), TokenizerFile("byte_bpe_50k.tiktoken")).withColumnRenamed("id", "doc_id")


def _containers(spark: SparkSession, sf: str) -> DataFrame:
    n = token_counts(_read(spark, sf, "documents"), F.col("doc_id"), F.col("text"), TokenizerFile("byte_bpe_50k.tiktoken"))
    return fill_containers(n, F.col("id"), F.col("n"), PackConfig(capacity=2048))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _containers(spark, sf).select(F.col("container").alias("container_id"), F.col("id").alias("doc_id"), "piece_no", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"))


def p9_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether containers keep their capacity, documents are whole, only those beyond the capacity are divided, and hardly any space is unused."""
    n = token_counts(_read(spark, sf, "documents"), F.col("doc_id"), F.col("text"), TokenizerFile("byte_bpe_50k.tiktoken"))
    c = Scratch(spark).cut(p9_containers(spark, sf))
    fits = c.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg((F.max("used") <= 2048).alias("fits"), (F.sum("used") >= 0.95 * 2048 * (F.count(F.lit(1)) - 1)).alias("full"))
    whole = c.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces")).join(n.select(F.col("id").alias("doc_id"), "n"), "doc_id", "full")
    return fits.crossJoin(whole.agg(F.bool_and(F.coalesce(F.col("placed") == F.col("n"), F.lit(False))).alias("whole"), F.bool_and((F.col("pieces") == 1) | (F.col("n") > 2048)).alias("divided_if_needed")))  # one row each


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    d = _read(spark, sf, "documents")
    return repetition(d, F.col("doc_id"), F.col("text"), F.col("lang")).filter("share >= 0.25").select(F.col("id").alias("doc_id"))


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = _read(spark, sf, "documents")
    return repetition(d, F.col("doc_id"), F.col("text"), F.col("lang")).select(F.col("id").alias("doc_id"), F.round("share", 9).alias("share"))


def p10_bands(spark: SparkSession, sf: str) -> DataFrame:
    d = _read(spark, sf, "documents")
    return repetition(d, F.col("doc_id"), F.col("text"), F.col("lang")).select(F.col("id").alias("doc_id"), "perplexity", "verdict")


QUERIES = {f.__name__: f for f in (p1_found, p1_contributors, p2_subset, p2_checks, p3_found, p3_groups, p3_checks, p4_found, p4_links, p5_found, p5_neighbours, p6_found, p6_records, p6_report, p7_found, p7_pieces, p7_checks, p8_ids, p9_containers, p9_checks, p10_found, p10_scores, p10_bands)}

_WHITE = r"[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]"
_TRIM = lambda c: f"regexp_replace({c}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"
_USABLE = "SELECT {id}, any_value(embedding::DOUBLE[]) AS v FROM {t} WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 {more} GROUP BY {id}"
_CAPPED = f"""
WITH u AS (
  SELECT unit_id, max(quality) AS q,
    any_value(coalesce(nullif(upper({_TRIM('source_doc_id')}), ''), CASE WHEN contains(doc_id, '::') THEN upper({_TRIM("split_part(doc_id, '::', 1)")}) END)) AS s
  FROM retrieval_units GROUP BY unit_id
), k AS (SELECT unit_id, q, CASE WHEN regexp_matches(s, '^[0-9]+$') THEN 'D' || s ELSE s END AS contributor FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY contributor ORDER BY q DESC NULLS LAST, unit_id) AS rank FROM k)
"""
_PASSAGES = """
WITH u AS (SELECT unit_id, any_value(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM retrieval_units WHERE text IS NOT NULL GROUP BY unit_id),
s AS (SELECT DISTINCT unit_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM u WHERE len(w) >= 8),
n AS (SELECT unit_id, count(*) AS n FROM s GROUP BY unit_id),
c AS (SELECT a.unit_id AS a, b.unit_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.unit_id < b.unit_id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN n x ON x.unit_id = a JOIN n y ON y.unit_id = b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9)
"""
_OVERLAPS = f"""
WITH q AS (
  SELECT query_idx AS i, any_value(lower({_TRIM('coalesce(source_query_id, query_id)')})) AS k, any_value(lower({_TRIM('split_role')})) AS r, any_value(dataset) AS dataset,
    any_value(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS w, any_value(embedding::DOUBLE[]) AS v
  FROM workset_queries GROUP BY query_idx
), t AS (SELECT * FROM q WHERE r = 'train'), h AS (SELECT * FROM q WHERE r IN ('calibration', 'evaluation')),
g AS (SELECT DISTINCT i, r, unnest(list_transform(range(1, length(w) - 1), lambda j: substr(w, j, 3))) AS x FROM q WHERE w <> ''),
m AS (SELECT i, count(*) AS n FROM g GROUP BY i),
c AS (SELECT a.i AS a, b.i AS b, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.r = 'train' AND b.r IN ('calibration', 'evaluation') GROUP BY ALL),
ok AS (SELECT * FROM q WHERE len(v) = 64 AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))) AND list_dot_product(v, v) > 0),
f AS (
  SELECT t.i AS train_id, h.i AS held_id, true AS by_id, false AS by_text, false AS by_vector FROM t JOIN h ON t.k = h.k AND t.k <> ''
  UNION ALL SELECT a, b, false, true, false FROM c JOIN m x ON x.i = a JOIN m y ON y.i = b WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9
  UNION ALL SELECT a.i, b.i, false, false, true FROM ok a JOIN ok b ON a.r = 'train' AND b.r IN ('calibration', 'evaluation') AND list_cosine_similarity(a.v, b.v) >= 0.97
), o AS (SELECT train_id, held_id, bool_or(by_id) AS by_id, bool_or(by_text) AS by_text, bool_or(by_vector) AS by_vector FROM f GROUP BY ALL)
"""
_ROLL = " + ".join(f"ascii(substr(w, e - {7 - j}, 1)) * {pow(ROLL_BASE, 7 - j, ROLL_PRIME)}::HUGEINT" for j in range(8))
_RECORDS = (
    _OVERLAPS
    + f""", x AS (SELECT DISTINCT w FROM q WHERE w <> '' AND r IN ('train', 'calibration', 'evaluation')),
y AS (SELECT w, list_concat(list_filter(range(8, length(w)), lambda e: ({_ROLL}) % {ROLL_PRIME} % 16 = 0), [length(w)]) AS cuts FROM x),
ch AS (SELECT w, unnest(list_transform(range(1, len(cuts) + 1), lambda i: substr(w, CASE WHEN i = 1 THEN 1 ELSE cuts[i - 1] + 1 END, cuts[i] - CASE WHEN i = 1 THEN 0 ELSE cuts[i - 1] END))) AS chunk FROM y),
tc AS (SELECT DISTINCT chunk FROM ch WHERE w IN (SELECT w FROM t)),
fr AS (SELECT w, round(sum(CASE WHEN chunk IN (SELECT chunk FROM tc) THEN length(chunk) ELSE 0 END) / sum(length(chunk)), 9) AS overlap FROM ch GROUP BY w),
hr AS (SELECT held_id, bool_or(by_id) AS by_id, bool_or(by_text) AS by_text, bool_or(by_vector) AS by_vector FROM o GROUP BY held_id),
z AS (
  SELECT h.i AS query_idx, h.r AS split, dataset, coalesce(by_id, false) AS by_id, coalesce(by_text, false) AS by_text, coalesce(by_vector, false) AS by_vector, fr.overlap
  FROM h LEFT JOIN hr ON held_id = h.i LEFT JOIN fr ON fr.w = h.w
)
"""
)
_MEASURED = lambda c: _TRIM(f"regexp_replace({c}, '{_WHITE}+', ' ', 'g')")
_SHARES = f"""
WITH t AS (SELECT doc_id, lower({_MEASURED('text')}) AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, length(t) - 29 AS n, unnest(list_transform(range(1, length(t) - 28), lambda i: substr(t, i, 30))) AS w FROM t WHERE length(t) >= 100),
s AS (SELECT doc_id, 1 - count(DISTINCT w) / n AS share FROM w GROUP BY doc_id, n)
"""

SQL = {
    "p1_found": _CAPPED + "SELECT unit_id FROM r WHERE rank > 10 AND contributor IS NOT NULL",
    "p1_contributors": _CAPPED + "SELECT contributor, count(*) AS units, count(*) FILTER (WHERE rank <= 10 OR contributor IS NULL) AS kept FROM r GROUP BY contributor",
    "p2_checks": f"SELECT floor(0.05 * count(*) + 0.5)::BIGINT AS chosen, true AS different_and_usable FROM ({_USABLE.format(id='doc_idx', t='workset_docs', more='')})",
    "p4_links": _PASSAGES
    + """, k AS (SELECT unit_id, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY unit_id), c0 AS (SELECT unit_id, min(unit_id) OVER (PARTITION BY h) AS class_id FROM k),
l AS (SELECT u AS unit_id, count(*) AS n FROM (SELECT a AS u FROM p UNION ALL SELECT b FROM p) GROUP BY u) SELECT unit_id, class_id, coalesce(n, 0) AS links FROM c0 LEFT JOIN l USING (unit_id)""",
    "p5_neighbours": f"""
WITH d AS ({_USABLE.format(id='doc_idx', t='workset_docs', more='')})
SELECT q.doc_idx, row_number() OVER (PARTITION BY q.doc_idx ORDER BY round(list_cosine_similarity(q.v, d.v), 12) DESC, d.doc_idx) AS rank, d.doc_idx AS neighbour_idx, round(list_cosine_similarity(q.v, d.v), 9) AS cosine
FROM d q, d WHERE q.doc_idx % 100 = 0 AND q.doc_idx <> d.doc_idx QUALIFY rank <= 5""",
    "p3_checks": "SELECT true AS members_near, true AS others_far, true AS strays_far, true AS large",
    "p4_found": _PASSAGES + "SELECT a AS unit_id_a, b AS unit_id_b FROM p",
    "p5_found": f"""
WITH d AS ({_USABLE.format(id='doc_idx', t='workset_docs', more='')}),
q AS ({_USABLE.format(id='query_idx', t='workset_queries', more=f"AND lower({_TRIM('split_role')}) IN ('calibration', 'evaluation')")})
SELECT query_idx, doc_idx FROM q, d
QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY round(list_cosine_similarity(q.v, d.v), 12) DESC, doc_idx) <= 5""",
    "p6_found": _OVERLAPS + "SELECT least(train_id, held_id) AS query_idx_a, greatest(train_id, held_id) AS query_idx_b FROM o",
    "p6_records": _RECORDS + "SELECT query_idx, by_id, by_text, by_vector, overlap FROM z",
    "p6_report": _RECORDS
    + """SELECT split, dataset, count(*) AS held_out_rows, count(*) FILTER (WHERE by_id OR by_text OR by_vector) AS overlapping_rows, count(*) FILTER (WHERE by_id) AS rows_by_id,
  count(*) FILTER (WHERE by_text) AS rows_by_text, count(*) FILTER (WHERE by_vector) AS rows_by_vector, round(avg(overlap), 6) AS mean_overlap FROM z GROUP BY split, dataset""",
    "p7_found": f"""
SELECT DISTINCT doc_id FROM raw_corpus
WHERE length({_MEASURED(f"CASE WHEN text IS NULL OR regexp_replace(text, '{_WHITE}+', '', 'g') = '' THEN contents ELSE text END")}) > 2000""",
    "p7_checks": f"""SELECT DISTINCT doc_id, true AS within, true AS covered, true AS to_the_end FROM raw_corpus
WHERE {_MEASURED(f"CASE WHEN text IS NULL OR regexp_replace(text, '{_WHITE}+', '', 'g') = '' THEN contents ELSE text END")} <> ''""",
    "p9_checks": "SELECT true AS fits, true AS full, true AS whole, true AS divided_if_needed",
    "p10_found": _SHARES + "SELECT doc_id FROM s WHERE share >= 0.25",
    "p10_scores": _SHARES + "SELECT doc_id, round(share, 9) AS share FROM t LEFT JOIN s USING (doc_id) WHERE t <> ''",
}
