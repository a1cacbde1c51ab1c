"""The registered queries of the core operators, and their SQL.

Vectors: ``embeddings`` (the whole table as documents, its label as partition,
the rows whose id is divisible by 100 as queries).  Worksets, judgements and
texts: the retrieval tables.  Relational helpers: the star schema.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrine.functions.vectors import dot, fixed_point, l2, norm, normalize, quantize_byte, theta
from vectrine.operators import clustering as cl
from vectrine.operators import comparison, crypto, knn, metrics, preparation, privacy, routing, sampling
from vectrine.operators import text as tx
from vectrine.plans import pipelines
from vectrine.plans.config import SMALL
from vectrine.plans.materialize import Scratch, sized
from vectrine.streaming import online as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIM, EVAL_K, FIXED_K, TOP_C = 64, 5, 50, 7


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_idx"), F.col("embedding").alias("v"))


def asked(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def parts(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_idx"), F.col("label").alias("cluster_id"))


def centers(spark, sf) -> DataFrame:
    """One row a cluster, computed once."""
    c = cl.centroids(read(spark, sf, "embeddings").select(F.col("label").alias("cluster_id"), F.col("embedding").alias("v")), DIM)
    return Scratch(spark).cut(c.coalesce(1))


def ranked_centers(spark, sf, keep: int | None = None) -> DataFrame:
    return routing.center_angles(asked(spark, sf), centers(spark, sf), keep)


def truth(spark, sf, k: int = EVAL_K) -> DataFrame:
    return knn.exact_knn(docs(spark, sf), F.col("doc_idx"), F.col("v"), asked(spark, sf), F.col("query_id"), F.col("qv"), k, DIM)


_COS = "list_dot_product({a}, {b}) / greatest(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 1e-12)"
_ANGLE = lambda c: f"round(acos(greatest(-1, least(1, round({c}, 12)))), 9)"
_THETA = lambda a, b: _ANGLE(_COS.format(a=a, b=b))
_BASE = f"""
WITH d AS (SELECT vec_id AS doc_idx, embedding::DOUBLE[] AS v, label AS cluster_id FROM embeddings),
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT query_id, doc_idx, {_THETA('qv', 'v')} AS theta FROM q, d),
t AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY theta, doc_idx) AS rank, doc_idx, theta FROM p),
m AS (SELECT label AS cluster_id, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
c AS (SELECT cluster_id, list(round(x / n, 9) ORDER BY i) AS center FROM (SELECT *, greatest(sqrt(sum(x * x) OVER (PARTITION BY cluster_id)), 1e-12) AS n FROM m) GROUP BY cluster_id),
a AS (SELECT query_id, cluster_id, theta, row_number() OVER (PARTITION BY query_id ORDER BY theta, cluster_id) AS rank FROM (SELECT query_id, cluster_id, {_THETA('qv', 'center')} AS theta FROM q, c)),
k AS (SELECT doc_idx, cluster_id, theta, row_number() OVER (PARTITION BY cluster_id ORDER BY theta, doc_idx) AS rank FROM (SELECT d.doc_idx, d.cluster_id, {_THETA('v', 'center')} AS theta FROM d JOIN c USING (cluster_id))),
s AS (SELECT doc_idx, cluster_id, theta, row_number() OVER (PARTITION BY doc_idx ORDER BY theta, cluster_id) AS rank FROM (SELECT d.doc_idx, c.cluster_id, {_THETA('v', 'center')} AS theta FROM d, c)),
f AS (SELECT cluster_id, count(*) AS size, max(theta) FILTER (WHERE rank <= {EVAL_K}) AS r_k, max(theta) FILTER (WHERE rank <= {FIXED_K}) AS r_fixed, min(theta) AS theta_min,
  quantile_cont(theta, 0.5) AS theta_p50, round(avg(theta), 9) AS theta_mean, max(theta) AS theta_max FROM k GROUP BY cluster_id),
n AS (SELECT a.query_id, a.cluster_id, s.doc_idx, p.theta, row_number() OVER (PARTITION BY a.query_id, a.cluster_id ORDER BY p.theta, s.doc_idx) AS rank
  FROM a JOIN s ON a.cluster_id = s.cluster_id JOIN p ON p.query_id = a.query_id AND p.doc_idx = s.doc_idx WHERE a.rank <= {TOP_C} AND s.rank <= {TOP_C})
"""


# --- vectors -----------------------------------------------------------------


@query(_BASE + "SELECT query_id, rank, doc_idx, theta FROM t WHERE rank <= 10")
def knn_top10(spark, sf):
    return truth(spark, sf, 10)


@query(_BASE + f"SELECT query_id, doc_idx, round({_COS.format(a='qv', b='v')}, 9) AS cosine FROM q, d")
def pair_scores(spark, sf):
    m = knn.score_matrix(docs(spark, sf), F.col("doc_idx"), F.col("v"), asked(spark, sf), F.col("query_id"), F.col("qv"), DIM)
    return m.select("query_id", "doc_idx", F.round("cosine", 9).alias("cosine"))


@query(_BASE + "SELECT t.query_id, t.doc_idx, round(list_dot_product(qv, v), 9) AS dot, round(list_distance(qv, v), 6) AS l2, theta FROM t JOIN q USING (query_id) JOIN d USING (doc_idx) WHERE rank BETWEEN 2 AND 40")
def pair_measures(spark, sf):
    near = truth(spark, sf, 40).filter("rank >= 2").select("query_id", "doc_idx")
    p = near.join(asked(spark, sf), "query_id").join(docs(spark, sf), "doc_idx")
    q, v = F.col("qv"), F.col("v")
    return p.select("query_id", "doc_idx", F.round(dot(q, v), 9).alias("dot"), F.round(l2(q, v), 6).alias("l2"), theta(q, v).alias("theta"))


@query("SELECT vec_id, round(sqrt(list_dot_product(v, v)), 9) AS norm, round(list_sum(v) / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS unit_sum FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def normalized(spark, sf):
    e = read(spark, sf, "embeddings")
    return e.select("vec_id", F.round(norm(F.col("embedding")), 9).alias("norm"), F.round(F.aggregate(normalize(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 6).alias("unit_sum"))


@query(_BASE + "SELECT query_id, min(theta) AS nearest_doc_theta FROM p GROUP BY query_id")
def nearest_doc_angle(spark, sf):
    return truth(spark, sf, 1).groupBy("query_id").agg(F.min("theta").alias("nearest_doc_theta"))


@query(_BASE + f"SELECT query_id, doc_idx FROM (SELECT query_id, doc_idx, round(cos(theta), 9) AS score FROM p) QUALIFY score >= max(score) FILTER (WHERE true) OVER (PARTITION BY query_id) - 2 AND score >= nth_value(score, {EVAL_K}) OVER (PARTITION BY query_id ORDER BY score DESC, doc_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - 1e-8")
def relaxed_positives(spark, sf):
    kth = truth(spark, sf).groupBy("query_id").agg(F.max("theta").alias("kth"))
    limit = F.acos(F.greatest(F.lit(-1.0), F.cos("kth") - 2e-8)) + 1e-8  # a little more than the slack, which is applied to the scores
    near = knn.docs_within(docs(spark, sf), F.col("doc_idx"), F.col("v"), asked(spark, sf).join(kth, "query_id"), F.col("query_id"), F.col("qv"), limit, DIM)
    return knn.relaxed_positives(near.withColumn("score", F.round(F.cos("theta"), 9)), EVAL_K).select("query_id", "doc_idx")


@query(_BASE + "SELECT query_id, cluster_id, rank, doc_idx, theta FROM (SELECT p.query_id, d.cluster_id, p.doc_idx, p.theta, row_number() OVER (PARTITION BY p.query_id, d.cluster_id ORDER BY p.theta, p.doc_idx) AS rank FROM p JOIN d USING (doc_idx)) WHERE rank <= 3")
def knn_per_cluster(spark, sf):
    e = read(spark, sf, "embeddings")
    q = asked(spark, sf).join(ranked_centers(spark, sf).select("query_id", "cluster_id"), "query_id")  # a row a cluster
    return knn.exact_knn(e, F.col("vec_id"), F.col("embedding"), q, F.col("query_id"), F.col("qv"), 3, DIM, F.col("label"), F.col("cluster_id"))


@query(_BASE + f"SELECT query_id, cluster_id, rank, doc_idx, theta FROM n WHERE rank <= {EVAL_K}")
def filtered_knn(spark, sf):
    c = centers(spark, sf)
    routed = routing.center_angles(asked(spark, sf), c, TOP_C).select("query_id", "cluster_id")
    return knn.supported_knn(docs(spark, sf), c, TOP_C, asked(spark, sf).join(routed, "query_id"), EVAL_K, DIM)


@query(_BASE + f", u AS (SELECT DISTINCT query_id, doc_idx, theta FROM n WHERE rank <= {EVAL_K}) SELECT query_id, doc_idx, theta, row_number() OVER (PARTITION BY query_id ORDER BY theta, doc_idx) AS rank FROM u QUALIFY rank <= {EVAL_K}")
def rerank_union(spark, sf):
    return knn.rerank_exact(filtered_knn(spark, sf), docs(spark, sf), asked(spark, sf), EVAL_K).select("query_id", "doc_idx", "theta", "rank")


@query(_BASE + f", u AS (SELECT query_id, p.doc_idx, p.theta FROM a JOIN d USING (cluster_id) JOIN p USING (query_id, doc_idx) WHERE a.rank <= 3) SELECT query_id, doc_idx, theta, row_number() OVER (PARTITION BY query_id ORDER BY theta, doc_idx) AS rank FROM u QUALIFY rank <= {EVAL_K}")
def ivf_top5(spark, sf):
    return knn.ivf_knn(docs(spark, sf), asked(spark, sf), parts(spark, sf), ranked_centers(spark, sf, 3), EVAL_K).select("query_id", "doc_idx", "theta", "rank")


@query()
def lsh_top5(spark, sf):
    return knn.lsh_knn(docs(spark, sf), asked(spark, sf), EVAL_K, DIM).select("query_id", "rank", "doc_idx", "theta")


@query("SELECT true AS enough")
def lsh_recall(spark, sf):
    """Whether the search by sign bands finds at least 0.9 of the exact neighbours."""
    return metrics.exact_recall(lsh_top5(spark, sf), truth(spark, sf), EVAL_K).agg((F.avg("recall") >= 0.9).alias("enough"))


@query(_BASE + "SELECT query_id, count(DISTINCT doc_idx) AS docs FROM a JOIN d USING (cluster_id) WHERE rank <= 3 GROUP BY query_id")
def union_payload(spark, sf):
    r = ranked_centers(spark, sf, 3).select("query_id", "cluster_id")
    return r.join(parts(spark, sf), "cluster_id").groupBy("query_id").agg(F.count_distinct("doc_idx").alias("docs"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: greatest(0, least(255, round_even((x::DOUBLE + 1) * 127.5, 0)::INT))))::BIGINT AS byte_sum, list_sum(list_transform(embedding, lambda x: round_even(x::DOUBLE * 5000, 0)::BIGINT))::BIGINT AS fixed_sum FROM embeddings")
def quantized(spark, sf):
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return read(spark, sf, "embeddings").select("vec_id", add(quantize_byte(F.col("embedding"))).alias("byte_sum"), add(fixed_point(F.col("embedding"), 5000)).alias("fixed_sum"))


# --- clusters ----------------------------------------------------------------


@query(_BASE + "SELECT cluster_id, i - 1 AS pos, round(center[i], 6) AS value FROM c, range(1, 65) r(i)")
def centroid_values(spark, sf):
    return centers(spark, sf).select("cluster_id", F.posexplode("center").alias("pos", "value")).select("cluster_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(_BASE + "SELECT * FROM f")
def cluster_profile(spark, sf):
    return cl.profile(cl.member_angles(docs(spark, sf), parts(spark, sf), centers(spark, sf)), EVAL_K, FIXED_K)


@query(_BASE + "SELECT cluster_id, r_k, r_fixed, round(tan(greatest((r_fixed - r_k) / 2, 0)), 9) AS r_max FROM f")
def docs_only_r_max(spark, sf):
    return cl.docs_only_r_max(cluster_profile(spark, sf)).select("cluster_id", "r_k", "r_fixed", "r_max")


@query(_BASE + "SELECT doc_idx, cluster_id, rank FROM s WHERE rank <= 3")
def top_c_support(spark, sf):
    return cl.top_c_support(docs(spark, sf), centers(spark, sf), 3).select("doc_idx", "cluster_id", "rank")


def _state(spark, sf):
    scratch = Scratch(spark)
    c = centers(spark, sf)
    routed = scratch.cut(routing.center_angles(asked(spark, sf), c, TOP_C).select("query_id", "cluster_id"))
    near = scratch.cut(knn.supported_knn(docs(spark, sf), c, TOP_C, asked(spark, sf).join(routed, "query_id"), FIXED_K, DIM))
    return c, routed, near


_IDEAL = _BASE + f"""
, e AS (SELECT query_id, max(theta) AS edge FROM n WHERE rank <= {FIXED_K} GROUP BY query_id),
h AS (SELECT query_id, count(DISTINCT doc_idx) AS hits FROM n JOIN t USING (query_id, doc_idx) WHERE n.rank <= {FIXED_K} AND t.rank <= {EVAL_K} GROUP BY query_id),
w AS (SELECT query_id, max(theta) AS worst FROM t WHERE rank <= {EVAL_K} GROUP BY query_id),
i AS (SELECT query_id, coalesce(hits, 0) / {EVAL_K} AS coverage, coalesce(hits, 0) = {EVAL_K} AS covered,
  round(CASE WHEN coalesce(hits, 0) = {EVAL_K} THEN tan(greatest((edge - worst) / 2, 0)) ELSE 0 END, 9) AS ideal_r_max FROM w LEFT JOIN e USING (query_id) LEFT JOIN h USING (query_id))
"""
_SURROGATE = _IDEAL + """
, x AS (SELECT cluster_id, ideal_r_max FROM a JOIN i USING (query_id) WHERE rank <= 7),
g AS (SELECT coalesce(quantile_cont(ideal_r_max, 0.1), 0) AS g FROM x),
y AS (SELECT cluster_id, count(*) AS n, quantile_cont(ideal_r_max, 0.1) AS q FROM x GROUP BY cluster_id),
z AS (SELECT c.cluster_id, coalesce(n, 0) AS anchors, coalesce(q, g) AS raw, g, greatest(0.15, coalesce(n, 0) / (coalesce(n, 0) + 24)) AS b FROM c LEFT JOIN y USING (cluster_id), g),
sur AS (SELECT cluster_id, anchors, round(raw, 9) AS raw, round(greatest(b * raw + (1 - b) * g, 0), 9) AS r_max FROM z)
"""


@query(_IDEAL + "SELECT * FROM i")
def ideal_r_max(spark, sf):
    _, routed, near = _state(spark, sf)
    return cl.covered_r_max(routed, near, truth(spark, sf), EVAL_K)


@query(_SURROGATE + "SELECT * FROM sur")
def r_max_surrogate(spark, sf):
    c, routed, near = _state(spark, sf)
    return cl.r_max_surrogate(routed, cl.covered_r_max(routed, near, truth(spark, sf), EVAL_K), c)


@query(_BASE + ", b AS (SELECT doc_idx, cluster_id AS x FROM s WHERE rank = 1), j AS (SELECT d.cluster_id AS b, b.x AS a FROM d JOIN b USING (doc_idx)), e AS (SELECT b AS cluster_id, a, b FROM j UNION ALL SELECT a, a, b FROM j WHERE a <> b) SELECT cluster_id, count(*) FILTER (WHERE b = cluster_id) AS size_before, count(*) FILTER (WHERE a = cluster_id) AS size_after, count(*) FILTER (WHERE a = cluster_id AND b = cluster_id) AS stayed, count(*) FILTER (WHERE b = cluster_id AND a <> cluster_id) AS moved_out, count(*) FILTER (WHERE a = cluster_id AND b <> cluster_id) AS moved_in FROM e GROUP BY cluster_id")
def alignment(spark, sf):
    after = cl.top_c_support(docs(spark, sf), centers(spark, sf), 1).select("doc_idx", "cluster_id")
    return cl.alignment(parts(spark, sf), after)


def _capacity(spark, sf):
    """All vectors in as many clusters of equal size as there are labels."""
    n, k = read(spark, sf, "embeddings").agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    return k, n // k


_COST = _BASE + """, e AS (SELECT d.doc_idx, c.cluster_id, round(list_distance(v, center), 9) AS cost FROM d, c),
pf AS (SELECT doc_idx, list(cluster_id ORDER BY cost, cluster_id) AS pref, list(cost ORDER BY cost, cluster_id) AS l, list(cost ORDER BY cluster_id) AS by_id FROM e GROUP BY doc_idx),
cap AS (SELECT (SELECT count(*) FROM d) // (SELECT count(*) FROM c) AS n, (SELECT list(cluster_id ORDER BY cluster_id) FROM c) AS ids)"""
_BALANCED = (
    _COST.replace("WITH d AS", "WITH RECURSIVE d AS")
    + """, o AS (SELECT doc_idx, pref, row_number() OVER (ORDER BY round(l[2] - l[1], 9) DESC, l[1], doc_idx) AS i FROM pf),
g AS (SELECT 0::BIGINT AS i, list_transform(ids, lambda x: n) AS room, NULL::BIGINT AS doc_idx, NULL::BIGINT AS cluster_id FROM cap
  UNION ALL SELECT i, list_transform(room, lambda x, j: CASE WHEN ids[j] = cid THEN x - 1 ELSE x END), doc, cid FROM (
    SELECT o.i, g.room, o.doc_idx AS doc, ids, list_filter(o.pref, lambda p: g.room[list_position(ids, p)] > 0)[1] AS cid FROM g JOIN o ON o.i = g.i + 1, cap))"""
)


@query(_BALANCED + " SELECT doc_idx, cluster_id FROM g WHERE i > 0")
def balanced_assignment(spark, sf):
    _, capacity = _capacity(spark, sf)
    return cl.balanced_partition(docs(spark, sf), centers(spark, sf), capacity)


def _repaired(spark, sf):
    _, capacity = _capacity(spark, sf)
    cost = Scratch(spark).cut(cl.costs(docs(spark, sf), centers(spark, sf)))
    nearest = sampling.first_of(cost, ("doc_idx",), F.asc("cost"), F.asc("cluster_id")).select("doc_idx", "cluster_id")
    return cost, cl.capacity_repair(cost, nearest, capacity)


_REPAIRED = (
    _COST.replace("WITH d AS", "WITH RECURSIVE d AS")
    + """, nat AS (SELECT doc_idx, pref[1] AS src, l[1] AS own FROM pf),
mv AS (SELECT e.doc_idx, src, e.cluster_id AS dst, row_number() OVER (ORDER BY round(cost - own, 9), e.doc_idx, e.cluster_id) AS i FROM e JOIN nat USING (doc_idx) WHERE e.cluster_id <> src),
sz AS (SELECT list(coalesce(k, 0) ORDER BY c.cluster_id) AS sizes FROM c LEFT JOIN (SELECT src, count(*) AS k FROM nat GROUP BY src) ON src = c.cluster_id),
g AS (SELECT 0::BIGINT AS i, sizes, []::BIGINT[] AS moved, NULL::BIGINT AS doc_idx, NULL::BIGINT AS dst FROM sz
  UNION ALL SELECT i, CASE WHEN ok THEN list_transform(sizes, lambda x, j: CASE WHEN ids[j] = src THEN x - 1 WHEN ids[j] = t THEN x + 1 ELSE x END) ELSE sizes END, CASE WHEN ok THEN list_append(moved, doc) ELSE moved END, CASE WHEN ok THEN doc END, CASE WHEN ok THEN t END FROM (
    SELECT mv.i, g.sizes, g.moved, mv.doc_idx AS doc, src, mv.dst AS t, ids, NOT list_contains(g.moved, mv.doc_idx) AND g.sizes[list_position(ids, src)] > n AND g.sizes[list_position(ids, mv.dst)] < n AS ok FROM g JOIN mv ON mv.i = g.i + 1, cap)),
rep AS (SELECT nat.doc_idx, coalesce(m.dst, src) AS cluster_id FROM nat LEFT JOIN (SELECT doc_idx, dst FROM g WHERE doc_idx IS NOT NULL) m USING (doc_idx))"""
)


@query(_REPAIRED + " SELECT doc_idx, cluster_id FROM rep")
def capacity_repair(spark, sf):
    return _repaired(spark, sf)[1]


@query(_REPAIRED + " SELECT round(sum(cost), 6) AS total, round(avg(cost), 6) AS mean FROM rep JOIN e USING (doc_idx, cluster_id)")
def repaired_cost(spark, sf):
    return cl.assignment_cost(*_repaired(spark, sf))


@query()
def spherical_kmeans(spark, sf):
    return cl.spherical_kmeans(docs(spark, sf), 10, 42, DIM)


@query()
def seed_sweep(spark, sf):
    k, _ = _capacity(spark, sf)
    return cl.seed_sweep(_described(spark, sf), k, range(3), DIM, FIXED_K)


@query("SELECT 0 AS swaps, true AS gains UNION ALL SELECT 1, true UNION ALL SELECT 2, true")
def boundary_swaps(spark, sf):
    """Two swaps between a partition's clusters, and whether J grew by each."""
    start = docs(spark, sf).select("doc_idx", F.pmod("doc_idx", F.lit(5)).alias("cluster_id"))
    _, j = cl.refine_by_swaps(_described(spark, sf), start, FIXED_K // 2, 2, 3)
    return spark.createDataFrame([(i, i == 0 or j[i] > j[i - 1]) for i in range(len(j))], "swaps int, gains boolean")


@query("SELECT cluster_id, string_agg(doc_idx::VARCHAR, ',' ORDER BY doc_idx) AS members FROM (SELECT vec_id AS doc_idx, label AS cluster_id FROM embeddings) GROUP BY cluster_id")
def member_lists(spark, sf):
    return cl.member_lists(parts(spark, sf)).withColumn("members", joined("members"))


def joined(items: str):
    """A list as one string."""
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


@query(_BASE + ", b AS (SELECT c.cluster_id, list_transform(range(1, 65), lambda i: list_avg(list_transform(l, lambda z: z[i]))) AS m FROM c JOIN (SELECT k.cluster_id, list(d.v) AS l FROM k JOIN d USING (doc_idx) WHERE rank <= 20 GROUP BY k.cluster_id) USING (cluster_id)) SELECT cluster_id, round(list_cosine_similarity(m, center), 4) AS core_cosine FROM b JOIN c USING (cluster_id)")
def core_centers(spark, sf):
    return cl.core_centers(docs(spark, sf), parts(spark, sf), centers(spark, sf), 20, DIM).select("cluster_id", F.round("core_cosine", 4).alias("core_cosine"))


_CHUNKS = "SELECT cluster_id, unnest(chunk) AS doc_idx FROM cluster_info"


@query(f"WITH a AS ({_CHUNKS}) SELECT cluster_id, min(doc_idx::VARCHAR) AS min_doc_id, sha1(string_agg(doc_idx::VARCHAR, chr(10) ORDER BY doc_idx::VARCHAR)) AS membership_sha1, row_number() OVER (ORDER BY min(doc_idx::VARCHAR), sha1(string_agg(doc_idx::VARCHAR, chr(10) ORDER BY doc_idx::VARCHAR)), cluster_id) - 1 AS new_cluster_id FROM a GROUP BY cluster_id")
def canonical_clusters(spark, sf):
    a = read(spark, sf, "cluster_info").select("cluster_id", F.explode("chunk").alias("doc_idx"))
    return cl.canonical_ids(a, F.col("doc_idx"))


@query(f"WITH a AS ({_CHUNKS}) SELECT cluster_id, count(*) AS n, min(doc_idx) AS first, max(doc_idx) AS last, (sum(doc_idx) % 1000000007)::BIGINT AS checksum FROM a GROUP BY cluster_id")
def chunk_signatures(spark, sf):
    return cl.chunk_signature(read(spark, sf, "cluster_info").select("cluster_id", F.explode("chunk").alias("doc_idx")))


@query(f"""
WITH a AS ({_CHUNKS}), w AS (SELECT DISTINCT doc_idx FROM workset_docs), i AS (SELECT cluster_id, cluster_r_k AS r_k, cluster_r_fixed AS r_fixed, cluster_r_max AS r_max FROM cluster_info)
SELECT 'unassigned' AS rule, (-1)::BIGINT AS cluster_id, doc_idx::VARCHAR AS detail FROM w WHERE doc_idx NOT IN (SELECT doc_idx FROM a)
UNION ALL SELECT 'assigned_twice', min(cluster_id), doc_idx::VARCHAR FROM a GROUP BY doc_idx HAVING count(*) > 1
UNION ALL SELECT 'unknown_doc', cluster_id, doc_idx::VARCHAR FROM a WHERE doc_idx NOT IN (SELECT doc_idx FROM w)
UNION ALL SELECT 'empty_cluster', cluster_id, '0' FROM i WHERE cluster_id NOT IN (SELECT cluster_id FROM a)
UNION ALL SELECT 'bad_radius', cluster_id, r_max::VARCHAR FROM i WHERE r_k IS NULL OR r_fixed IS NULL OR r_max IS NULL OR r_max < 0
UNION ALL SELECT 'radii_out_of_order', cluster_id, r_fixed::VARCHAR FROM i WHERE r_fixed < r_k""")
def partition_violations(spark, sf):
    info = read(spark, sf, "cluster_info")
    a = info.select("cluster_id", F.explode("chunk").alias("doc_idx"))
    radii = info.select("cluster_id", F.col("cluster_r_k").alias("r_k"), F.col("cluster_r_fixed").alias("r_fixed"), F.col("cluster_r_max").alias("r_max"))
    found = cl.contract_violations(read(spark, sf, "workset_docs").select("doc_idx").distinct(), a, radii)
    return found.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1).cast("long")))


def _described(spark, sf) -> DataFrame:
    """Vectors with the source and a hash of the document of the same number, where there is one."""
    v = docs(spark, sf)
    mine = sized(v.select(F.col("doc_idx").alias("doc_id")), v.count())
    d = read(spark, sf, "documents").join(mine, "doc_id", "left_semi")  # no text is hashed that no vector asks for
    h = tx.simhash64(d, F.col("doc_id"), tx.tokens(F.col("text"))).withColumnRenamed("id", "doc_idx")
    both = d.select(F.col("doc_id").alias("doc_idx"), "source").join(h, "doc_idx")
    return v.join(both, "doc_idx", "left").withColumn("simhash", F.coalesce("simhash", F.lit(0).cast("long")))


_SIMHASH_OF = lambda key, table: f"""SELECT k.{key}, coalesce(o.simhash, 0) AS simhash FROM (SELECT DISTINCT {key} FROM {table}) k LEFT JOIN (
  SELECT {key}, sum(CASE WHEN s < 0 THEN 0::HUGEINT WHEN i = 63 THEN -(1::HUGEINT << 63) ELSE 1::HUGEINT << i::INT END)::BIGINT AS simhash FROM (
    SELECT {key}, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN n ELSE -n END) AS s FROM (
      SELECT {key}, w, count(*) AS n, ('0x' || substr(sha1(w), 1, 16))::UBIGINT AS h FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce(any_value(text), '')), '[a-z0-9]+')) AS w FROM {table} GROUP BY {key}) GROUP BY ALL), range(64) r(i) GROUP BY ALL) GROUP BY {key}) o USING ({key})"""  # noqa: E731
_QUALITY = _BASE + f"""
, sh AS ({_SIMHASH_OF("doc_id", "documents")}),
o2 AS (SELECT d.*, coalesce(x.source, '') AS source, coalesce(sh.simhash, 0) AS h FROM d LEFT JOIN documents x ON x.doc_id = d.doc_idx LEFT JOIN sh ON sh.doc_id = d.doc_idx),
u AS (SELECT o2.*, round(list_distance(v, center), 9) AS e FROM o2 JOIN c USING (cluster_id)),
v1 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY e, doc_idx) AS r FROM u),
r1 AS (SELECT cluster_id, count(*) AS n, round(quantile_cont(e, 0.95) FILTER (WHERE r <= {FIXED_K // 2}), 6) AS core_radius, round(quantile_cont(e, 0.95), 6) AS tail_radius FROM v1 GROUP BY cluster_id),
s1 AS (SELECT cluster_id, max(k) AS top FROM (SELECT cluster_id, source, count(*) AS k FROM u GROUP BY ALL) GROUP BY cluster_id),
d1 AS (SELECT cluster_id, sum(k * (k - 1) / 2) AS pairs FROM (SELECT cluster_id, h >> 48 AS b, count(*) AS k FROM u GROUP BY ALL) GROUP BY cluster_id),
met AS (SELECT cluster_id, n, core_radius, tail_radius, round(greatest(tail_radius - core_radius, 0), 6) AS tail_inflation, round(top / n, 9) AS source_dominance, round(pairs / greatest(n * (n - 1) / 2, 1), 9) AS duplicate_density FROM r1 JOIN s1 USING (cluster_id) JOIN d1 USING (cluster_id)),
sep AS (SELECT round(coalesce(sum(x), 0), 6) AS separation_sum, round(coalesce(avg(x), 0), 6) AS separation_mean FROM (SELECT list_distance(a.center, b.center) AS x FROM c a JOIN c b ON a.cluster_id < b.cluster_id))
"""


@query(_QUALITY + "SELECT * FROM met")
def cluster_quality(spark, sf):
    return cl.quality_metrics(_described(spark, sf), parts(spark, sf), centers(spark, sf), FIXED_K // 2)


@query(_QUALITY + "SELECT * FROM sep")
def center_separation(spark, sf):
    return cl.center_separation(centers(spark, sf))


@query(_QUALITY + """, j AS (SELECT round(greatest(separation_mean, 0) / (1 + greatest(separation_mean, 0)), 6) AS j_separation, round(1 / (1 + greatest(avg(core_radius), 0)), 6) AS j_core, round(1 / (1 + greatest(avg(tail_inflation), 0)), 6) AS j_tail,
 round(1 - greatest(0, least(1, avg(source_dominance))), 6) AS j_source, round(1 - greatest(0, least(1, avg(duplicate_density))), 6) AS j_duplicates FROM met, sep GROUP BY separation_mean) SELECT *, round((j_separation + j_core + j_tail + j_source + j_duplicates) / 5, 6) AS j FROM j""")
def j_score(spark, sf):
    return cl.j_score(cluster_quality(spark, sf), center_separation(spark, sf))


@query("SELECT vec_id AS doc_idx, (vec_id // 50)::BIGINT AS cluster_id, 0.05::DOUBLE AS r_max FROM embeddings")
def sequential_partition(spark, sf):
    return cl.sequential_partition(docs(spark, sf), 50, 0.05)


@query("WITH r AS (SELECT doc_idx, cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY doc_idx) - 1) // 16 AS sub FROM (SELECT vec_id AS doc_idx, label AS cluster_id FROM embeddings)) SELECT doc_idx, cluster_id, sub, count(*) OVER (PARTITION BY cluster_id, sub) < 16 AS stash FROM r")
def sub_clusters(spark, sf):
    return preparation.sub_clusters(parts(spark, sf), 16)


# --- routing and gate --------------------------------------------------------


@query(_BASE + "SELECT query_id, cluster_id, rank, theta FROM a WHERE rank <= 7")
def route_top_c(spark, sf):
    return ranked_centers(spark, sf, TOP_C).select("query_id", "cluster_id", "rank", "theta")


_GAPS = _BASE + ", g AS (SELECT query_id, round(min(theta) FILTER (WHERE rank = 2) - min(theta) FILTER (WHERE rank = 1), 9) AS gap2, round(min(theta) FILTER (WHERE rank = 3) - min(theta) FILTER (WHERE rank = 1), 9) AS gap3, round(min(theta) FILTER (WHERE rank = 4) - min(theta) FILTER (WHERE rank = 1), 9) AS gap4 FROM a GROUP BY query_id)"


@query(_GAPS + "SELECT query_id, a.cluster_id, a.rank FROM a JOIN g USING (query_id) WHERE rank <= 1 + CASE WHEN gap2 <= 0.05 THEN 1 + CASE WHEN gap3 <= 0.08 THEN 1 + CASE WHEN gap4 <= 0.1 THEN 1 ELSE 0 END ELSE 0 END ELSE 0 END")
def route_gap_ladder(spark, sf):
    return routing.route_gap_ladder(ranked_centers(spark, sf), 0.05, 0.08, 0.1).select("query_id", "cluster_id", "rank")


@query(_GAPS + "SELECT query_id, a.cluster_id, a.rank FROM a JOIN g USING (query_id) WHERE rank <= CASE WHEN gap2 <= 0.03 THEN 2 ELSE 1 END")
def route_boundary(spark, sf):
    return routing.route_boundary(ranked_centers(spark, sf), 0.03, 2).select("query_id", "cluster_id", "rank")


def _gate(spark, sf, epsilon):
    c = centers(spark, sf)
    t = docs_only_r_max(spark, sf).join(c, "cluster_id")
    g = routing.gate(asked(spark, sf), t, 2.0, epsilon, DIM, 100.0, 200000.0)
    return g.select("query_id", "cluster_id", "center_theta", "epsilon_used", F.round("sigma", 9).alias("sigma"), F.round("r_bar", 9).alias("r_bar"), "r_max", "track", F.round("margin", 9).alias("margin"))


_GATE = lambda e: _BASE + f""", z AS (SELECT cluster_id, round(tan(greatest((r_fixed - r_k) / 2, 0)), 9) AS r_max FROM f), b AS (SELECT greatest(100.0, least(200000.0, {e}::DOUBLE)) AS e)
SELECT query_id, a.cluster_id, a.theta AS center_theta, e AS epsilon_used, round(sqrt(2 / (2 * e)), 9) AS sigma, round(sqrt(2 / (2 * e)) * sqrt(64), 9) AS r_bar, r_max,
 CASE WHEN r_max >= sqrt(2 / (2 * e)) * sqrt(64) THEN 'dense_rdp' ELSE 'out_of_scope' END AS track, round(r_max - sqrt(2 / (2 * e)) * sqrt(64), 9) AS margin FROM a JOIN z USING (cluster_id), b WHERE a.rank = 1"""  # noqa: E731


@query(_GATE(1048576))
def gate_open(spark, sf):
    return _gate(spark, sf, 1048576.0)


@query(_GATE(10))
def gate_closed(spark, sf):
    return _gate(spark, sf, 10.0)


@query("SELECT event_id, CASE WHEN value < 20 THEN value ELSE greatest(20, least(60, value)) END AS epsilon FROM events")
def clipped_epsilon(spark, sf):
    low = F.when(F.col("value") >= 20, F.lit(20.0))  # no bound: no clipping
    return read(spark, sf, "events").select("event_id", routing.clip_epsilon(F.col("value"), low, F.lit(60.0)).alias("epsilon"))


@query("SELECT event_id, round(sqrt(2 / (2 * (abs(value) + 1))), 9) AS sigma, round(sqrt(2 / (2 * (abs(value) + 1))) * sqrt(64), 9) AS r_bar, round(atan(abs(value) / 2), 9) AS shift FROM events")
def noise_scales(spark, sf):
    e = F.abs("value") + 1
    return read(spark, sf, "events").select("event_id", F.round(routing.sigma(2.0, e), 9).alias("sigma"), F.round(routing.r_bar(2.0, e, 64), 9).alias("r_bar"), F.round(privacy.angular_shift(F.abs("value"), F.lit(2.0)), 9).alias("shift"))


@query("SELECT vec_id AS query_id, true AS within, true AS moved, true AS turned FROM embeddings WHERE vec_id % 100 = 0")
def perturbed_queries(spark, sf):
    """What must hold of every perturbed query: its radius lies between the mean radius and r_max, it moved by just that, and the angle follows."""
    q = asked(spark, sf).withColumn("r_max", F.lit(1.0))
    p = privacy.perturb_rdp(q, 2.0, 175000.0, DIM).join(asked(spark, sf), "query_id")
    least = routing.r_bar(2.0, F.lit(175000.0), DIM)
    near = lambda a, b: F.abs(a - b) < 1e-6
    return p.select("query_id", F.col("radius").between(least - 1e-12, F.lit(1.0)).alias("within"), near(l2(F.col("qv"), F.col("perturbed")), F.col("radius")).alias("moved"), near(F.col("delta_alpha"), F.atan(F.col("radius") / norm(F.col("qv")))).alias("turned"))


@query("SELECT vec_id AS query_id, true AS enough, true AS dense, true AS within FROM embeddings WHERE vec_id % 100 = 0")
def distance_candidates(spark, sf):
    """What must hold of each candidate set: k documents or more, ranks without gaps, the last within the k-th angle and the shift."""
    c, bound = _distance_candidates(spark, sf)
    per = c.groupBy("query_id").agg((F.count(F.lit(1)) >= EVAL_K).alias("enough"), (F.max("rank") == F.count(F.lit(1))).alias("dense"), F.max("theta").alias("last"))
    return per.join(bound, "query_id").select("query_id", "enough", "dense", (F.col("last") <= F.col("bound") + 1e-8).alias("within"))


def _distance_candidates(spark, sf):
    q = privacy.perturb_distance(asked(spark, sf), 6400.0, DIM)
    near = knn.exact_knn(docs(spark, sf), F.col("doc_idx"), F.col("v"), q, F.col("query_id"), F.col("perturbed"), EVAL_K, DIM)
    kth = near.filter(F.col("rank") == EVAL_K).select("query_id", F.col("theta").alias("kth"))
    scored = knn.docs_within(docs(spark, sf), F.col("doc_idx"), F.col("v"), q.join(kth, "query_id"), F.col("query_id"), F.col("perturbed"), F.col("kth") + F.col("delta_alpha") + 2e-9, DIM)
    bound = kth.join(q, "query_id").select("query_id", (F.col("kth") + F.col("delta_alpha")).alias("bound"))
    return privacy.distance_candidates(scored, q.select("query_id", "delta_alpha"), EVAL_K).select("query_id", "rank", "doc_idx", "theta"), bound


# --- texts -------------------------------------------------------------------

_WHITE = r"[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]"
_CLEAN = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{_WHITE}+', ' ', 'g'))"


@query(f"SELECT doc_id, length({_CLEAN('text')}) AS chars, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS tokens, strlen(coalesce(text, '')) AS bytes FROM documents")
def text_sizes(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.length(tx.clean_text(F.col("text"))).cast("long").alias("chars"), F.size(tx.tokens(F.col("text"))).cast("long").alias("tokens"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))


def _sentence_sql() -> str:
    """The sentence rules without look-behind: a digit after a letter is hidden while numbers are folded, and sentence ends are marked before the split."""
    t = f"regexp_replace({_CLEAN('text')}, '(?i)\\bstep\\s+\\d+[.:)]?\\s*', '. ', 'g')"
    for n in range(10):
        t = f"regexp_replace({t}, '([A-Za-z]){n}', '\\1' || chr({0xE000 + n}), 'g')"
    t = f"regexp_replace({t}, '\\d+[.)]?\\s+', '. ', 'g')"
    for n in range(10):
        t = f"replace({t}, chr({0xE000 + n}), '{n}')"
    t = f"string_split(regexp_replace({t}, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"SELECT doc_id, s.i - 1 AS pos, s.x AS sentence FROM (SELECT doc_id, unnest(list_transform(list_filter(list_transform({t}, lambda x: trim(trim(x), ' -;:,')), lambda x: x <> ''), lambda x, i: {{'x': x, 'i': i}})) AS s FROM documents)"


@query(_sentence_sql())
def sentence_rows(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def _raw_once(spark, sf) -> DataFrame:
    """One text a source document: the last delivered."""
    raw = read(spark, sf, "raw_corpus")
    body = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", F.col("contents")).otherwise(F.col("text"))
    return raw.groupBy("doc_id").agg(F.max_by(F.struct(body.alias("text"), "dataset"), F.struct("loaded_at", "row_no")).alias("x")).select("doc_id", "x.text", "x.dataset")


@query()
def passage_units(spark, sf):
    return tx.passages(_raw_once(spark, sf), F.col("doc_id"), F.col("text"))


@query("SELECT doc_id, count(*) AS n FROM raw_corpus GROUP BY doc_id HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return tx.duplicate_ids(read(spark, sf, "raw_corpus"), F.col("doc_id"))


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM documents),
h AS (SELECT doc_id, w, count(*) AS n, ('0x' || substr(sha1(w), 1, 16))::UBIGINT AS h FROM w GROUP BY ALL),
b AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN n ELSE -n END) AS s FROM h, range(64) r(i) GROUP BY ALL),
o AS (SELECT doc_id, sum(CASE WHEN s < 0 THEN 0::HUGEINT WHEN i = 63 THEN -(1::HUGEINT << 63) ELSE 1::HUGEINT << i::INT END)::BIGINT AS simhash FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(simhash, 0) AS simhash FROM documents d LEFT JOIN o USING (doc_id)""")
def simhash_docs(spark, sf):
    return tx.simhash64(read(spark, sf, "documents"), F.col("doc_id"), tx.tokens(F.col("text"))).withColumnRenamed("id", "doc_id")


def _units(spark, sf) -> DataFrame:
    """(ord, source, simhash) of all units, each once, hashed from their texts: the delivered hashes are partly missing and partly stale."""
    u = read(spark, sf, "retrieval_units").dropDuplicates(["unit_id"])
    src = F.upper(F.regexp_replace(F.coalesce("source_doc_id", F.split_part("doc_id", F.lit("::"), F.lit(1))), r"^D|\s+", ""))
    h = tx.simhash64(u, F.col("unit_id"), tx.tokens(F.col("text"))).withColumnRenamed("id", "ord")
    return Scratch(spark).cut(u.select(F.col("unit_id").alias("ord"), F.regexp_replace(src, "^D", "").alias("source")).join(h, "ord"))


_UNITS = rf"""WITH RECURSIVE sh AS ({_SIMHASH_OF("unit_id", "retrieval_units")}),
u AS (SELECT unit_id AS ord, any_value(regexp_replace(upper(regexp_replace(coalesce(source_doc_id, split_part(doc_id, '::', 1)), '^D|\s+', '', 'g')), '^D', '')) AS source, any_value(sh.simhash) AS simhash FROM retrieval_units JOIN sh USING (unit_id) GROUP BY unit_id)"""


@query(_UNITS + " SELECT x.ord AS a, y.ord AS b FROM u x JOIN u y ON x.source = y.source AND x.ord < y.ord WHERE bit_count(xor(x.simhash, y.simhash)) <= 3")
def hamming_within_source(spark, sf):
    return tx.hamming_pairs(_units(spark, sf), 3, "source")


@query(_UNITS + " SELECT x.ord AS a, y.ord AS b FROM u x JOIN u y ON x.ord < y.ord AND ((x.simhash >> 48) & 65535) = ((y.simhash >> 48) & 65535) WHERE bit_count(xor(x.simhash, y.simhash)) <= 2")
def hamming_by_prefix(spark, sf):
    return tx.hamming_pairs(_units(spark, sf), 2, None, 16)


_GREEDY = lambda name, rows, most, same: f"""{name}_p AS (SELECT y.ord, list(x.ord) AS before FROM {rows} x JOIN {rows} y ON x.ord < y.ord AND bit_count(xor(x.simhash, y.simhash)) <= {most} AND {same} GROUP BY y.ord),
{name}_o AS (SELECT ord, before, row_number() OVER (ORDER BY ord) AS i FROM {name}_p),
{name}_g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL SELECT o.i, CASE WHEN len(list_filter(o.before, lambda b: NOT list_contains(g.gone, b))) > 0 THEN list_append(g.gone, o.ord) ELSE g.gone END FROM {name}_g g JOIN {name}_o o ON o.i = g.i + 1),
{name}_r AS (SELECT unnest(gone) AS ord FROM (SELECT gone FROM {name}_g ORDER BY i DESC LIMIT 1))"""  # noqa: E731


@query(_UNITS + ", " + _GREEDY("a", "u", 3, "x.source IS NOT DISTINCT FROM y.source") + ", k AS (SELECT * FROM u WHERE ord NOT IN (SELECT ord FROM a_r)), " + _GREEDY("b", "k", 2, "((x.simhash >> 48) & 65535) = ((y.simhash >> 48) & 65535)") + " SELECT ord, CASE WHEN ord IN (SELECT ord FROM a_r) THEN 'within_source' WHEN ord IN (SELECT ord FROM b_r) THEN 'global' END AS removed FROM u")
def near_dup_removed(spark, sf):
    return tx.two_tier_dedup(_units(spark, sf))


@query("SELECT p_partkey, concat_ws(chr(10) || chr(10), nullif(trim(p_name), ''), nullif(trim(p_brand), ''), nullif(trim(p_type), '')) AS text FROM part")
def composed_text(spark, sf):
    return read(spark, sf, "part").select("p_partkey", tx.compose(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("text"))


# --- hashes, splits, quotas --------------------------------------------------

_UNIT = lambda x: f"(('0x' || substr(sha256({x}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


@query(f"SELECT doc_id, {_UNIT('doc_id::VARCHAR')} AS h FROM documents")
def unit_hashes(spark, sf):
    return read(spark, sf, "documents").select("doc_id", sampling.unit_hash(F.col("doc_id").cast("string")).alias("h"))


_CANON = "coalesce(nullif(trim(source_query_id), ''), trim(query_id))"


@query(f"SELECT query_idx, any_value({_CANON}) AS canonical_id FROM workset_queries GROUP BY query_idx")
def canonical_ids(spark, sf):
    q = read(spark, sf, "workset_queries")
    return q.select("query_idx", sampling.canonical_query_id(F.col("query_id"), F.col("source_query_id")).alias("canonical_id")).distinct()


@query(f"""WITH k AS (SELECT DISTINCT {_CANON} AS key FROM workset_queries), r AS (SELECT key, row_number() OVER (ORDER BY {_UNIT("'7::' || key")}, key) AS r, count(*) OVER () AS n FROM k)
SELECT key, CASE WHEN r <= greatest(8, least(round_even(0.3 * n, 0), n - 8)) THEN 'calibration' ELSE 'evaluation' END AS role FROM r""")
def protocol_split(spark, sf):
    return sampling.split_rows(canonical_ids(spark, sf), F.col("canonical_id"), 0.3, 8, 8, 7)


@query(r"""WITH s AS (SELECT DISTINCT split_part(doc_id, '::', 1) AS s FROM workset_docs)
SELECT s AS source_id, unnest(CASE WHEN regexp_matches(s, '^d[0-9]+$') THEN [s, s[2:]] WHEN regexp_matches(s, '^D[0-9]+$') THEN [s, s[2:], 'd' || s[2:]] WHEN regexp_matches(s, '^[0-9]+$') THEN [s, 'd' || s] ELSE [s] END) AS alias FROM s""")
def id_aliases(spark, sf):
    s = read(spark, sf, "workset_docs").select(F.split_part("doc_id", F.lit("::"), F.lit(1)).alias("source_id")).distinct()
    return s.select("source_id", F.explode(sampling.id_aliases(F.col("source_id"))).alias("alias"))


@query("SELECT doc_id::VARCHAR AS record FROM documents ORDER BY sha1(coalesce(source, doc_id::VARCHAR) || '::' || doc_id), doc_id::VARCHAR LIMIT 300")
def hash_sample(spark, sf):
    return sampling.hash_sample(read(spark, sf, "documents"), F.col("doc_id"), F.col("source"), 300)


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source) AS f FROM documents) SELECT doc_id AS record, source, turn FROM r ORDER BY turn, f LIMIT 300")
def round_robin(spark, sf):
    return sampling.round_robin(read(spark, sf, "documents"), F.col("doc_id"), F.col("source"), 300)


_LANGS = "WITH c AS (SELECT coalesce(lower(lang), '') AS g, count(*) AS n FROM documents GROUP BY 1)"


def _langs(spark, sf):
    return read(spark, sf, "documents").groupBy(F.coalesce(F.lower("lang"), F.lit("")).alias("group")).count()


@query(_LANGS + """, e AS (SELECT g, n, least(floor(n * 333.0::DOUBLE / sum(n) OVER ()), n)::BIGINT AS f, round(n * 333.0::DOUBLE / sum(n) OVER () - floor(n * 333.0::DOUBLE / sum(n) OVER ()), 12) AS rest FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY f >= n, rest DESC, n - f DESC, g) AS r, 333 - sum(f) OVER () AS spare FROM e) SELECT g AS "group", n AS count, f + CASE WHEN r <= spare AND f < n THEN 1 ELSE 0 END AS quota FROM o""")
def proportional_quotas(spark, sf):
    return sampling.proportional_quotas(_langs(spark, sf), 333)


@query(_LANGS + """, s AS (SELECT g, n, unnest(range(1, least(n, 200) + 1)) AS i, 200 // (SELECT count(*) FROM c WHERE n > 0) AS base FROM c),
t AS (SELECT *, greatest(0, i - base) AS turn FROM s), r AS (SELECT *, row_number() OVER (ORDER BY turn, CASE WHEN turn > 0 THEN i - n ELSE 0 END, g, i) AS r FROM t)
SELECT c.g AS "group", c.n AS count, count(r.i) AS quota FROM c LEFT JOIN (SELECT * FROM r WHERE r <= 200) r ON r.g = c.g GROUP BY ALL""")
def balanced_quotas(spark, sf):
    return sampling.balanced_quotas(_langs(spark, sf), 200)


_SCORED = "WITH s AS (SELECT doc_id, n_chars::DOUBLE AS score FROM documents WHERE n_chars IS NOT NULL), q AS (SELECT quantile_cont(score, 1/3) AS a, quantile_cont(score, 2/3) AS b FROM s), d AS (SELECT doc_id, score, CASE WHEN score <= a THEN 'easy' WHEN score <= b THEN 'mid' ELSE 'hard' END AS difficulty FROM s, q)"


def _scored(spark, sf):
    return sampling.terciles(read(spark, sf, "documents").filter("n_chars is not null").select("doc_id", F.col("n_chars").cast("double").alias("score")), "score")


@query(_SCORED + " SELECT * FROM d")
def difficulty_terciles(spark, sf):
    return _scored(spark, sf)


@query(_SCORED + ", p AS (SELECT *, CASE difficulty WHEN 'mid' THEN 0 WHEN 'easy' THEN 1 WHEN 'hard' THEN 2 ELSE 3 END AS place FROM d) SELECT *, row_number() OVER (PARTITION BY place ORDER BY score, doc_id) AS turn FROM p")
def difficulty_turns(spark, sf):
    return sampling.interleave(_scored(spark, sf), "score", "doc_id")


# --- offsets and ranges ------------------------------------------------------


@query("WITH c AS (SELECT DISTINCT o_orderkey AS o FROM orders), p AS (SELECT unnest(range(0, (SELECT max(o) + count(*) + 200 FROM c))) AS p), u AS (SELECT p, p + (SELECT count(*) FROM c) - (SELECT count(*) FROM c WHERE o < p) AS n FROM p) SELECT min(p) AS prefix_end FROM u WHERE n >= (SELECT count(*) + 100 FROM c)")
def prefix_for_size(spark, sf):
    core = read(spark, sf, "orders").select(F.col("o_orderkey").alias("offset"))
    return sampling.prefix_for_size(core, core.distinct().count() + 100)


@query("SELECT 500 + count(DISTINCT o_orderkey) FILTER (WHERE o_orderkey >= 500) AS size FROM orders")
def union_size(spark, sf):
    return sampling.union_size(read(spark, sf, "orders").select(F.col("o_orderkey").alias("offset")), 500)


@query("WITH d AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), n AS (SELECT s, p, CASE WHEN p - lag(p) OVER (PARTITION BY s ORDER BY p) <= 8 THEN 0 ELSE 1 END AS x FROM d), r AS (SELECT s, p, sum(x) OVER (PARTITION BY s ORDER BY p) AS run FROM n) SELECT s AS l_suppkey, min(p) AS first, max(p) AS last, count(*) AS rows FROM r GROUP BY s, run")
def merged_ranges(spark, sf):
    return sampling.merge_ranges(read(spark, sf, "lineitem"), "l_suppkey", "l_partkey", 8)


@query("WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT g AS o_orderpriority, count(*) AS n, min(v) AS smallest, max(v) FILTER (WHERE i = floor(0.5 * (n - 1))) AS p50, max(v) FILTER (WHERE i = floor(0.95 * (n - 1))) AS p95, max(v) AS largest, round(avg(v), 6) AS mean FROM r GROUP BY g")
def nearest_ranks(spark, sf):
    return sampling.nearest_rank(read(spark, sf, "orders").select("o_orderpriority", "o_totalprice"), "o_totalprice", {"p50": 0.5, "p95": 0.95}, ("o_orderpriority",))


@query("WITH h AS (SELECT l_suppkey, count(*) AS hits FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT count(*) FILTER (WHERE hits >= 1) AS at_least_1, count(*) FILTER (WHERE hits >= 100) AS at_least_100, count(*) FILTER (WHERE hits >= 160) AS at_least_160 FROM h")
def support_counts(spark, sf):
    h = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("hits"))
    return sampling.support_counts(h, (1, 100, 160))


@query("WITH n AS (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN n_regionkey END AS v FROM nation) SELECT n_nationkey, last_value(v IGNORE NULLS) OVER (ORDER BY n_nationkey) AS v FROM n")
def carried_forward(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 4 == 0, F.col("n_regionkey")).alias("v"))
    return sampling.carry_forward(n, "n_nationkey", "v")


_SHARDS = "WITH h AS (SELECT s_nationkey AS shard_idx, count(*) AS num_rows FROM supplier GROUP BY 1), c AS (SELECT shard_idx, num_rows, (sum(num_rows) OVER (ORDER BY shard_idx) - num_rows)::BIGINT AS global_start, (sum(num_rows) OVER (ORDER BY shard_idx))::BIGINT AS global_end FROM h)"


def _shards(spark, sf):
    return sampling.shard_catalogue(read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("shard_idx")).agg(F.count(F.lit(1)).alias("num_rows")))


@query(_SHARDS + " SELECT * FROM c")
def shard_catalogue(spark, sf):
    return _shards(spark, sf)


@query(_SHARDS + " SELECT s_suppkey AS \"offset\", shard_idx, s_suppkey - global_start AS local_row FROM supplier JOIN c ON s_suppkey >= global_start AND s_suppkey < global_end")
def located_offsets(spark, sf):
    return sampling.locate_offsets(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("offset")), _shards(spark, sf))


@query("WITH r AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM (SELECT DISTINCT s_nationkey AS s FROM supplier)) SELECT count(*) FILTER (WHERE s = i) AS prefix FROM r")
def contiguous_prefix(spark, sf):
    return sampling.contiguous_prefix(read(spark, sf, "supplier").select(F.col("s_nationkey").alias("shard_idx")))


@query("SELECT sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id)) AS sha256 FROM documents")
def id_fingerprint(spark, sf):
    return sampling.id_digest(read(spark, sf, "documents"), F.col("doc_id"), F.col("doc_id"))


@query("SELECT 64 AS length")
def long_fingerprint(spark, sf):
    return sampling.fingerprint(read(spark, sf, "documents"), F.col("doc_id"), F.col("doc_id")).select(F.length("sha256").alias("length"))


# --- query sets and worksets -------------------------------------------------


def _annotated(spark, sf):
    scratch = Scratch(spark)
    c = centers(spark, sf)
    nearest = scratch.cut(routing.center_angles(asked(spark, sf), c, 1))
    near = scratch.cut(knn.supported_knn(docs(spark, sf), c, TOP_C, asked(spark, sf).join(nearest.select("query_id", "cluster_id"), "query_id"), FIXED_K, DIM))
    return preparation.annotate(asked(spark, sf), nearest, scratch.cut(truth(spark, sf)), parts(spark, sf), near, EVAL_K)


_ANNOTATED = _BASE + f"""
, o AS (SELECT query_id, cluster_id AS nearest_cluster_id, theta AS nearest_center_theta FROM a WHERE rank = 1),
g AS (SELECT t.*, d.cluster_id FROM t JOIN d USING (doc_idx) WHERE rank <= {EVAL_K}),
j AS (SELECT query_id, cluster_id, count(*) AS n, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, cluster_id) AS r FROM g GROUP BY query_id, cluster_id),
h AS (SELECT n.query_id, count(*) FILTER (WHERE n.doc_idx IN (SELECT doc_idx FROM g WHERE g.query_id = n.query_id)) AS hits, max(theta) AS edge FROM n JOIN o ON o.query_id = n.query_id AND o.nearest_cluster_id = n.cluster_id WHERE rank <= {FIXED_K} GROUP BY n.query_id),
b AS (SELECT g.query_id, count(*) FILTER (WHERE cluster_id = nearest_cluster_id) AS inside, max(theta) AS worst, min(theta) AS best, min(cluster_id) FILTER (WHERE rank = 1) AS top1 FROM g JOIN o USING (query_id) GROUP BY g.query_id)
SELECT query_id, nearest_cluster_id, nearest_center_theta, best AS nearest_doc_theta, round(nearest_center_theta + 0.35 * best, 9) AS semantic_score, top1 AS top1_cluster_id, j.cluster_id AS majority_cluster_id, j.n = {EVAL_K} AS single_cluster,
 hits / {EVAL_K} AS cover_fixed, hits = {EVAL_K} AS cover_fixed_full, inside / {EVAL_K} AS cover_cluster, inside = {EVAL_K} AS cover_cluster_full, round(CASE WHEN hits = {EVAL_K} THEN tan(greatest((edge - worst) / 2, 0)) ELSE 0 END, 9) AS ideal_r_max
FROM o JOIN b USING (query_id) JOIN h USING (query_id) JOIN j USING (query_id) WHERE j.r = 1"""


@query(_ANNOTATED)
def annotated_queries(spark, sf):
    return _annotated(spark, sf)


def _pool(spark, sf):
    return _annotated(spark, sf).withColumn("is_real", F.lit(True))


_BY_CAL = "cover_fixed_full DESC, cover_cluster_full DESC, ideal_r_max DESC, semantic_score, query_id"
_BY_EVAL = "cover_cluster_full DESC, single_cluster DESC, semantic_score, query_id"
_SETS = f"WITH an AS ({_ANNOTATED})"


@query(_SETS + f", cs AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY nearest_cluster_id ORDER BY {_BY_CAL}) <= 1), es AS (SELECT * FROM an WHERE query_id NOT IN (SELECT query_id FROM cs) QUALIFY row_number() OVER (PARTITION BY nearest_cluster_id ORDER BY {_BY_EVAL}) <= 1) SELECT query_id, 'calibration' AS role FROM cs UNION ALL SELECT query_id, 'evaluation' FROM es")
def balanced_query_sets(spark, sf):
    return preparation.balanced_sets(Scratch(spark).cut(_pool(spark, sf)), "nearest_cluster_id", 1, 1)


@query(_SETS + f", cs AS (SELECT query_id FROM an ORDER BY {_BY_CAL} LIMIT 2), es AS (SELECT query_id FROM an WHERE query_id NOT IN (SELECT query_id FROM cs) ORDER BY ('0x' || substr(sha256('7::' || query_id), 1, 16))::UBIGINT, query_id LIMIT 2) SELECT query_id, 'calibration' AS role FROM cs UNION ALL SELECT query_id, 'evaluation' FROM es")
def fast_query_sets(spark, sf):
    return preparation.fast_sets(Scratch(spark).cut(_pool(spark, sf)), 2, 2, 7)


_AFTER = lambda n: _SETS + f""", c1 AS (SELECT query_id FROM an ORDER BY {_BY_CAL} LIMIT 1), ex AS (SELECT query_id FROM an WHERE query_id NOT IN (SELECT query_id FROM c1) ORDER BY {_BY_EVAL} LIMIT 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY nearest_cluster_id ORDER BY {_BY_CAL}) AS r FROM an WHERE query_id NOT IN (SELECT query_id FROM ex)),
fs AS (SELECT query_id FROM rk WHERE r <= greatest(1, ceil({n} / 10)) ORDER BY nearest_cluster_id, r LIMIT {n}), lf AS (SELECT query_id FROM rk WHERE r > greatest(1, ceil({n} / 10)) ORDER BY {_BY_CAL} LIMIT (SELECT {n} - count(*) FROM fs))
SELECT query_id FROM fs UNION ALL SELECT query_id FROM lf"""  # noqa: E731


def _after(spark, sf, target):
    pool = Scratch(spark).cut(_pool(spark, sf))
    return preparation.calibration_after_evaluation(pool, preparation.fast_sets(pool, 1, 1).filter("role = 'evaluation'"), "nearest_cluster_id", target, 10)


@query(_AFTER(3))
def calibration_after_evaluation(spark, sf):
    return _after(spark, sf, 3)


@query(_AFTER(4000))
def calibration_of_all_others(spark, sf):
    return _after(spark, sf, 4000)


@query(_SETS + " SELECT query_id FROM an WHERE query_id % 200 = 0 ORDER BY ('0x' || substr(sha256('7::' || query_id), 1, 16))::UBIGINT, query_id LIMIT 3")
def random_real_set(spark, sf):
    source = F.when(F.col("query_id") % 200 == 0, F.concat(F.lit("q"), "query_id"))
    return preparation.random_real_set(_pool(spark, sf).withColumn("source_query_id", source), 3, 7)


@query(_SETS + f", fo AS (SELECT query_id FROM an WHERE query_id % 300 = 0) SELECT query_id FROM an WHERE query_id NOT IN (SELECT query_id FROM fo) ORDER BY {_BY_CAL} LIMIT 4")
def calibration_only(spark, sf):
    pool = Scratch(spark).cut(_pool(spark, sf))
    return preparation.calibration_only(pool, 4, pool.filter("query_id % 300 = 0").select("query_id"))


@query("WITH r AS (SELECT query_idx AS query_id, row_number() OVER (ORDER BY sha256('7::' || query_idx), query_idx) AS r FROM (SELECT DISTINCT query_idx FROM workset_queries)) SELECT query_id, CASE WHEN r <= 10 THEN 'calibration' ELSE 'evaluation' END AS role FROM r WHERE r <= 25")
def first_n_sets(spark, sf):
    return preparation.first_n_sets(read(spark, sf, "workset_queries").select(F.col("query_idx").alias("query_id")), 10, 15, 7)


_JUDGED = "WITH j AS (SELECT l_suppkey AS query_id, l_partkey AS product_id, l_returnflag = 'R' AS positive FROM lineitem)"


def _judged(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("product_id"), (F.col("l_returnflag") == "R").alias("positive"))


@query(_JUDGED + " SELECT query_id, count(*) AS rows, count(DISTINCT product_id) FILTER (WHERE positive) AS positives FROM j GROUP BY query_id")
def query_support(spark, sf):
    return preparation.query_support(_judged(spark, sf))


_CHOSEN = _JUDGED + ", s AS (SELECT product_id, count(*) AS support FROM j GROUP BY 1 UNION ALL SELECT p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT product_id FROM j)), c AS (SELECT * FROM s ORDER BY support DESC, product_id LIMIT 250)"


def _chosen(spark, sf):
    return preparation.select_products(preparation.product_support(_judged(spark, sf)), read(spark, sf, "part").select(F.col("p_partkey").alias("product_id")), 250)


@query(_CHOSEN + " SELECT * FROM c")
def selected_products(spark, sf):
    return _chosen(spark, sf)


@query(_CHOSEN + ", p AS (SELECT DISTINCT query_id, product_id FROM j WHERE positive), o AS (SELECT query_id, count(*) AS positives, count(*) FILTER (WHERE product_id IN (SELECT product_id FROM c)) AS overlap FROM p GROUP BY 1) SELECT query_id, overlap, positives FROM o WHERE overlap > 0 ORDER BY overlap DESC, positives DESC, sha256('11::' || query_id), query_id LIMIT 20")
def selected_queries(spark, sf):
    return preparation.select_queries_by_overlap(_judged(spark, sf), _chosen(spark, sf), 20, 11)


@query("""WITH d AS (SELECT DISTINCT doc_idx, doc_id, split_part(doc_id, '::', 1) AS s FROM workset_docs), al AS (SELECT doc_id, unnest(CASE WHEN regexp_matches(s, '^D[0-9]+$') THEN [s, s[2:], 'd' || s[2:]] ELSE [s] END) AS x FROM d),
q AS (SELECT DISTINCT g.query_idx AS query_id, lower(d.s) AS s FROM gt_topk g JOIN d USING (doc_idx)), qa AS (SELECT query_id, unnest(CASE WHEN regexp_matches(s, '^d[0-9]+$') THEN [s, s[2:]] ELSE [s] END) AS x FROM q)
SELECT DISTINCT query_id, doc_id FROM qa JOIN al USING (x)""")
def workset_positives(spark, sf):
    d = read(spark, sf, "workset_docs").select("doc_idx", "doc_id", F.split_part("doc_id", F.lit("::"), F.lit(1)).alias("source_id")).distinct()
    q = read(spark, sf, "gt_topk").join(d, "doc_idx").select(F.col("query_idx").alias("query_id"), F.lower("source_id").alias("source_id")).distinct()
    return preparation.workset_positives(q, d.select("doc_id", "source_id"), sampling.id_aliases)


@query("SELECT vec_id AS doc_idx, unnest(range(3))::INT AS copy_no, true AS unit, true AS between FROM embeddings")
def mixed_vectors(spark, sf):
    """What must hold of each mixed vector: unit length, and no farther from its two parents than they are apart."""
    e = read(spark, sf, "embeddings")
    near = knn.exact_knn(e, F.col("vec_id"), F.col("embedding"), e, F.col("vec_id"), F.col("embedding"), 4, DIM, F.col("label"), F.col("label"))
    near = near.filter("query_id <> doc_idx").select(F.col("query_id").alias("doc_idx"), F.col("doc_idx").alias("other"), "rank")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("doc_idx").orderBy("rank")))
    near = Scratch(spark).cut(near)
    mixed = preparation.grow_by_mixing(docs(spark, sf), near, 3, DIM)
    n = near.groupBy("doc_idx").agg(F.max("rank").alias("n"))
    unit = docs(spark, sf).select("doc_idx", normalize(F.col("v")).alias("x"))
    of = mixed.join(n, "doc_idx").withColumn("rank", F.col("copy_no") % F.col("n") + 1).join(near, ["doc_idx", "rank"]).join(unit, "doc_idx").join(unit.select(F.col("doc_idx").alias("other"), F.col("x").alias("y")), "other")
    apart = theta(F.col("x"), F.col("y")) + 1e-6
    return of.select("doc_idx", "copy_no", (F.abs(norm(F.col("v")) - 1) < 1e-6).alias("unit"), ((theta(F.col("v"), F.col("x")) <= apart) & (theta(F.col("v"), F.col("y")) <= apart)).alias("between"))


@query("SELECT doc_id AS doc_idx, doc_id // 32 AS batch, doc_id % 32 AS slot, substr(coalesce(text, ''), 1, 200) AS snippet FROM documents")
def url_batches(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("doc_idx"), F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("snippet"))
    return preparation.url_batches(d, "doc_idx", 32)


@query("WITH b AS (SELECT doc_id // 32 AS batch, doc_id % 32 AS slot, doc_id FROM documents), f AS (SELECT batch, arg_min(doc_id, slot) AS f FROM b GROUP BY batch) SELECT f.batch, r.i AS slot, coalesce(b.doc_id, f.f) AS doc_idx FROM f CROSS JOIN range(32) r(i) LEFT JOIN b ON b.batch = f.batch AND b.slot = r.i")
def padded_batches(spark, sf):
    b = preparation.url_batches(read(spark, sf, "documents").select(F.col("doc_id").alias("doc_idx")), "doc_idx", 32)
    return preparation.pad_batches(b, "doc_idx", 32).withColumn("slot", F.col("slot").cast("long"))


@query(_BASE + ", b AS (SELECT query_id, doc_idx // 32 AS b FROM t WHERE rank = 1) SELECT query_id, rank, doc_idx FROM t JOIN b USING (query_id) WHERE rank <= 100 AND doc_idx // 32 = b")
def one_batch(spark, sf):
    b = preparation.url_batches(docs(spark, sf).select("doc_idx"), "doc_idx", 32)
    return preparation.fetch_one_batch(truth(spark, sf, 100), b)


# --- metrics -----------------------------------------------------------------


@query(_BASE + """, r AS (SELECT q.query_id, d.doc_idx FROM q JOIN d x ON x.doc_idx = q.query_id JOIN d ON d.cluster_id = x.cluster_id),
h AS (SELECT t.query_id, count(r.doc_idx) AS hits, min(t.rank) FILTER (WHERE r.doc_idx IS NOT NULL) AS first_rank FROM t LEFT JOIN r USING (query_id, doc_idx) WHERE t.rank <= 10 GROUP BY 1), n AS (SELECT query_id, count(*) AS positives FROM r GROUP BY 1)
SELECT query_id, positives, hits, CASE WHEN hits > 0 THEN 1 ELSE 0 END AS hit, hits / positives AS recall, first_rank FROM h JOIN n USING (query_id)""".replace(", n AS (", ", n2 AS (").replace("JOIN n USING", "JOIN n2 USING"))
def hit_and_recall(spark, sf):
    e = parts(spark, sf)
    q = asked(spark, sf).select("query_id").join(e.withColumnRenamed("doc_idx", "query_id"), "query_id")
    return metrics.hit_and_recall(truth(spark, sf, 10), q.join(e, "cluster_id").select("query_id", "doc_idx"), 10)


_HELD = "lower(trim(split_role)) IN ('calibration', 'evaluation')"
_OK = "len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0"


@query(f"""
WITH d AS (SELECT doc_idx, any_value(embedding::DOUBLE[]) AS v FROM workset_docs WHERE {_OK} GROUP BY 1), q AS (SELECT query_idx, any_value(embedding::DOUBLE[]) AS v FROM workset_queries WHERE {_OK} AND query_idx IN (SELECT query_idx FROM gt_topk) GROUP BY 1),
t AS (SELECT query_idx, doc_idx FROM (SELECT query_idx, doc_idx, {_THETA('q.v', 'd.v')} AS theta FROM q, d) QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY theta, doc_idx) <= 5)
SELECT query_idx, count(g.doc_idx) AS overlap, count(g.doc_idx) / 5 AS recall FROM t LEFT JOIN (SELECT DISTINCT query_idx, doc_idx FROM gt_topk) g USING (query_idx, doc_idx) GROUP BY query_idx""")
def old_run_recall(spark, sf):
    gt = read(spark, sf, "gt_topk").select("query_idx", "doc_idx").distinct()
    q = read(spark, sf, "workset_queries").join(gt.select("query_idx").distinct(), "query_idx", "left_semi").dropDuplicates(["query_idx"])
    w = read(spark, sf, "workset_docs")
    t = knn.exact_knn(w, F.col("doc_idx"), F.col("embedding"), q, F.col("query_idx"), F.col("embedding"), 5, DIM).withColumnRenamed("query_id", "query_idx")
    hit = t.join(gt.withColumn("g", F.lit(1)), ["query_idx", "doc_idx"], "left")
    return hit.groupBy("query_idx").agg(F.count("g").alias("overlap")).withColumn("recall", F.col("overlap") / 5)


@query(_BASE + "SELECT query_id, count(*) AS rows, sum(strlen(doc_idx::VARCHAR) + strlen(coalesce(x.text, '')) + 8 + 256)::BIGINT AS response_bytes FROM t LEFT JOIN documents x ON x.doc_id = t.doc_idx WHERE rank <= 50 GROUP BY query_id")
def response_bytes(spark, sf):
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("doc_idx"), "text")
    return metrics.response_bytes(truth(spark, sf, 50).join(texts, "doc_idx", "left").withColumn("doc_id", F.col("doc_idx")), DIM)


@query("SELECT event_id, value::DECIMAL(18,3)::VARCHAR || u AS text, round(value::DECIMAL(18,3)::DOUBLE * CASE u WHEN 's' THEN 1 WHEN 'ms' THEN 1e-3 WHEN 'us' THEN 1e-6 END, 12) AS seconds FROM (SELECT event_id, abs(value) AS value, ['s', 'ms', 'us', 'min'][(event_id % 4 + 1)::INT] AS u FROM events)")
def durations(spark, sf):
    u = F.element_at(F.array(*map(F.lit, ("s", "ms", "us", "min"))), (F.col("event_id") % 4 + 1).cast("int"))
    t = F.concat(F.abs("value").cast("decimal(18,3)").cast("string"), u)
    return read(spark, sf, "events").select("event_id", t.alias("text")).withColumn("seconds", F.round(metrics.duration_seconds(F.col("text")), 12))


@query("SELECT event_type, count(*) AS n, round(avg(value), 9) AS value_mean, min(value) AS value_min, max(value) AS value_max, round(sum(value), 4) AS value_sum, round(avg(value) FILTER (WHERE value >= 50), 9) AS value_dense_mean FROM events GROUP BY event_type")
def metric_summary(spark, sf):
    e = read(spark, sf, "events").withColumn("track", F.when(F.col("value") >= 50, "dense_rdp"))
    return metrics.summary(e, ("value",), ("event_type",), "track").withColumn("value_sum", F.round("value_sum", 4))


@query(_BASE + """, x AS (SELECT t.query_id, t.rank, a.query_id IS NOT NULL AS hit FROM t JOIN d USING (doc_idx) LEFT JOIN a ON a.query_id = t.query_id AND a.cluster_id = d.cluster_id AND a.rank <= 3 WHERE t.rank <= 5)
SELECT query_id, bool_and(hit) AS covered, bool_or(hit AND rank = 1) AS first_covered FROM x GROUP BY query_id""")
def cluster_coverage(spark, sf):
    return metrics.coverage_by_cluster(truth(spark, sf), parts(spark, sf), ranked_centers(spark, sf, 3))


@query(_BASE + "SELECT query_id, CASE WHEN atan(tan(theta) / sqrt(5)) >= 64 / 640.0 THEN 'direct' ELSE 'oblivious' END AS mode FROM t WHERE rank = 5")
def retrieval_mode(spark, sf):
    return truth(spark, sf).filter("rank = 5").select("query_id", metrics.direct_or_oblivious(F.col("theta"), 5, 64, 640.0).alias("mode"))


@query("SELECT 'exact' AS system, count(*) AS num_docs, 64 AS dim, 10 AS top_k, 640 AS docs_touched, 256.0::DOUBLE AS request_bytes, 256.0::DOUBLE AS response_bytes, 512.0::DOUBLE AS total_bytes, 3.0::DOUBLE AS total_ms FROM embeddings")
def contract_row(spark, sf):
    r = read(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("num_docs")).withColumns({"system": F.lit("exact"), "dim": F.lit(64), "top_k": F.lit(10), "docs_touched": F.lit(metrics.docs_touched(10**6, 300)), "request_bytes": F.lit(256), "response_bytes": F.lit(256), "client_ms": F.lit(1), "server_ms": F.lit(1), "recover_ms": F.lit(1)})
    return metrics.contract_rows(r).select("system", "num_docs", "dim", "top_k", "docs_touched", "request_bytes", "response_bytes", "total_bytes", "total_ms")


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang NULLS FIRST) AS r FROM documents GROUP BY source, lang) WHERE r = 1")
def majority_language(spark, sf):
    return metrics.majority(read(spark, sf, "documents"), "source", "lang")


# --- encrypted comparison ----------------------------------------------------


def _integer_pairs(spark, sf, k):
    """Integer vectors of each query and its k candidates."""
    p = truth(spark, sf, k).select("query_id", "doc_idx").join(asked(spark, sf), "query_id").join(docs(spark, sf), "doc_idx")
    return p.select("query_id", "doc_idx", fixed_point(F.col("qv"), 5000).alias("q"), fixed_point(F.col("v"), 5000).alias("d"))


@query(_BASE + ", z AS (SELECT t.query_id, t.doc_idx, list_sum(list_transform(range(1, 65), lambda i: round_even(qv[i] * 5000, 0)::BIGINT * round_even(v[i] * 5000, 0)::BIGINT))::BIGINT AS score FROM t JOIN q USING (query_id) JOIN d USING (doc_idx) WHERE rank <= 50) SELECT query_id, doc_idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_idx) AS rank FROM z QUALIFY rank <= 5")
def integer_ranking(spark, sf):
    return crypto.plain_integer_ranking(_integer_pairs(spark, sf, 50), EVAL_K)


@query(_BASE + ", z AS (SELECT t.query_id, t.doc_idx, (25000000 - list_sum(list_transform(range(1, 65), lambda i: round_even(qv[i] * 5000, 0)::BIGINT * round_even(v[i] * 5000, 0)::BIGINT))::BIGINT) / 25000000 AS distance FROM t JOIN q USING (query_id) JOIN d USING (doc_idx) WHERE rank <= 50) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_idx) AS rank, doc_idx, round(distance, 6) AS distance FROM z QUALIFY rank <= 5")
def encrypted_ranking(spark, sf):
    keys = crypto.key_pair(512, 7)
    c = crypto.encrypted_scores(_integer_pairs(spark, sf, FIXED_K), keys.public, 5000**2, 7)
    return knn.rank_pairs(crypto.decrypt_scores(c, keys, 5000**2), EVAL_K, score="distance").select("query_id", "rank", "doc_idx", F.round("distance", 6).alias("distance"))


def _payloads(spark, sf):
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("doc_idx"), "text")
    t = truth(spark, sf, 10).join(texts, "doc_idx", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return t.select("query_id", (F.col("rank") - 1).alias("position"), crypto.payload_json(F.col("doc_idx"), F.col("text")).alias("payload"), (F.col("rank") <= 5).alias("wanted"))


_PAYLOADS = _BASE + ", y AS (SELECT query_id, rank, strlen(to_json({'doc_idx': t.doc_idx, 'text': coalesce(x.text, '')})::VARCHAR) AS bytes FROM t LEFT JOIN documents x ON x.doc_id = t.doc_idx WHERE rank <= 10)"


@query(_PAYLOADS + " SELECT query_id, 5 AS received, sum(bytes)::BIGINT AS payload_bytes FROM y GROUP BY query_id")
def oblivious_transfer(spark, sf):
    return crypto.oblivious_transfer(_payloads(spark, sf), 256, 7).select("query_id", "received", "payload_bytes")


@query(_PAYLOADS + " SELECT query_id, sum(bytes)::BIGINT AS bytes FROM y WHERE rank <= 5 GROUP BY query_id")
def direct_bytes(spark, sf):
    return crypto.direct_bytes(_payloads(spark, sf))


@query(_BASE + f"SELECT t.query_id, t.doc_idx, round(list_dot_product(qv, v), 6) AS score, 4096 AS slots, {2 * 8192 * 140 // 8} AS request_bytes, {2 * 8192 * 100 // 8} AS response_bytes FROM t JOIN q USING (query_id) JOIN d USING (doc_idx) WHERE rank <= 20")
def lattice_scores(spark, sf):
    p = truth(spark, sf, 20).select("query_id", "doc_idx").join(asked(spark, sf), "query_id").join(docs(spark, sf), "doc_idx")
    lattice = crypto.Lattice()
    return lattice.scores(p, DIM).select("query_id", "doc_idx", F.round("score", 6).alias("score"), F.lit(lattice.degree // 2).alias("slots"), F.lit(lattice.message_bytes).alias("request_bytes"), F.lit(lattice.answer_bytes).alias("response_bytes"))


@query("SELECT event_id, round_even(value, 0)::BIGINT AS n FROM events")
def rounded_integers(spark, sf):
    off = F.rint("value") + 0.2 * F.sin("event_id")  # what an approximate product may leave
    return read(spark, sf, "events").select("event_id", crypto.rounded_integers(off).alias("n"))


# --- pipelines and streams ---------------------------------------------------


def _online(spark, sf, noise):
    d = docs(spark, sf)
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("doc_idx"), "text")
    full = d.join(texts, "doc_idx", "left").withColumn("doc_id", F.col("doc_idx").cast("string"))
    state = pipelines.offline(d, asked(spark, sf), parts(spark, sf), SMALL)
    return pipelines.online(full, asked(spark, sf), state, SMALL, noise)


_ONLINE = _SURROGATE + """
, rb AS (SELECT sqrt(2 / (2 * 175000.0::DOUBLE)) * 8 AS r_bar),
gt AS (SELECT query_id, a.cluster_id, r_max, r_bar, CASE WHEN r_max >= r_bar THEN 'dense_rdp' ELSE 'out_of_scope' END AS track FROM a JOIN sur USING (cluster_id), rb WHERE a.rank = 1),
ro AS (SELECT query_id, string_agg(cluster_id::VARCHAR, ',' ORDER BY cluster_id) AS routed, max(r_max) AS bound FROM a JOIN sur USING (cluster_id) WHERE rank <= 7 GROUP BY query_id),
lo AS (SELECT query_id, sum(strlen(t.doc_idx::VARCHAR) + strlen(coalesce(w.text, '')) + 8 + 256)::BIGINT AS response_bytes FROM t LEFT JOIN documents w ON w.doc_id = t.doc_idx WHERE rank <= 50 GROUP BY query_id)
"""


@query(_ONLINE + """SELECT query_id, cluster_id, track, r_bar, r_max, routed, CASE WHEN track = 'dense_rdp' THEN 0::DOUBLE END AS radius, CASE WHEN track = 'dense_rdp' THEN 1::DOUBLE END AS exact_recall,
 CASE WHEN track = 'dense_rdp' THEN 1::DOUBLE END AS inclusion_recall, 256 AS request_bytes, CASE WHEN track = 'dense_rdp' THEN response_bytes END AS response_bytes FROM gt JOIN ro USING (query_id) JOIN lo USING (query_id)""")
def online_noise_free(spark, sf):
    return _online(spark, sf, "none").drop("bound")


@query(_ONLINE + "SELECT query_id, cluster_id, track, routed, true AS radius_in_bounds, true AS recalls_in_order FROM gt JOIN ro USING (query_id)")
def online_private(spark, sf):
    """What is certain of a noisy run: the gate, the routing, a radius between the mean radius and the largest r_max, and an answer within the candidates."""
    o = _online(spark, sf, "rdp")
    dense = F.col("track") == "dense_rdp"
    inside = F.col("radius").between(F.col("r_bar") - 1e-9, F.col("bound") + 1e-9)
    order = F.col("exact_recall").between(0, F.col("inclusion_recall") + 1e-9) & (F.col("inclusion_recall") <= 1)
    return o.select("query_id", "cluster_id", "track", "routed", F.coalesce(F.when(dense, inside), F.col("radius").isNull()).alias("radius_in_bounds"), F.coalesce(F.when(dense, order), F.lit(True)).alias("recalls_in_order"))


@query(_ONLINE + """, zz AS (SELECT track = 'dense_rdp' AS dense, gt.r_max, r_bar, bound, response_bytes, 256 AS request_bytes FROM gt JOIN ro USING (query_id) JOIN lo USING (query_id))
SELECT count(*) AS num_queries, count(*) FILTER (WHERE dense) AS num_dense, count(*) FILTER (WHERE NOT dense) AS num_out_of_scope, round(avg(CASE WHEN dense THEN 1::DOUBLE END), 9) AS exact_recall_avg, round(avg(r_max), 9) AS r_max_avg, round(max(r_max), 9) AS r_max_max,
 round(avg(r_max - r_bar), 9) AS margin_avg, round(avg(bound), 9) AS routed_r_max_avg, round(sum(CASE WHEN dense THEN response_bytes END) / 1048576.0, 6) AS response_mb_sum_dense, round(avg(request_bytes / 1048576.0), 9) AS request_mb_avg FROM zz""")
def online_totals(spark, sf):
    """Some figures of the online summary of a run without noise."""
    o = _online(spark, sf, "none")
    q = o.select("query_id", "track", "exact_recall", "inclusion_recall", "r_max", (F.col("r_max") - F.col("r_bar")).alias("margin"), F.col("bound").alias("routed_r_max"), metrics.mib(F.col("request_bytes")).alias("request_mb"), metrics.mib(F.col("response_bytes")).alias("response_mb"))
    return comparison.online_summary(q).select("num_queries", "num_dense", "num_out_of_scope", "exact_recall_avg", "r_max_avg", "r_max_max", "margin_avg", "routed_r_max_avg", F.round("response_mb_sum_dense", 6).alias("response_mb_sum_dense"), "request_mb_avg")


def _events(spark, sf):
    schema = read(spark, sf, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    # times without a zone are taken as UTC, whatever the session's zone
    return s.withColumn("ts", F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp"))


def _run_stream(df: DataFrame) -> DataFrame:
    """Run a stream over what is there, into a table of the shared folder, and give its rows."""
    root = Scratch(df.sparkSession).root
    return stream.run_to_table(df, f"{root}/rows", f"{root}/checkpoint")


@query("WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY ALL) SELECT * FROM w WHERE \"end\" <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_windows(spark, sf):
    """Windows that the watermark has closed."""
    out = _run_stream(stream.stream_metrics(_events(spark, sf), "6 hours", "1 day"))
    return out.select(_utc("start"), _utc("end"), "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


def _utc(c: str):
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(c).cast("timestamp_ntz")).alias(c)


@query("WITH s AS (SELECT unnest([time_bucket(INTERVAL 6 HOURS, ts), time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 3 HOURS, time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 3 HOURS]) AS start, ts, event_type, value FROM events), w AS (SELECT start, start + INTERVAL 6 HOURS AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM s WHERE ts >= start AND ts < start + INTERVAL 6 HOURS GROUP BY ALL) SELECT * FROM w WHERE \"end\" <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_sliding(spark, sf):
    out = _run_stream(stream.stream_metrics(_events(spark, sf), "6 hours", "1 day", "3 hours"))
    return out.select(_utc("start"), _utc("end"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS x FROM events), s AS (SELECT user_id, ts, sum(x) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS \"end\", count(*) AS n FROM s GROUP BY user_id, s")
def user_sessions(spark, sf):
    return stream.stream_sessions(read(spark, sf, "events"), "2 hours", "1 day")


@query(SQL["user_sessions"] + " HAVING max(ts) + INTERVAL 2 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_sessions(spark, sf):
    """Sessions that the watermark has closed."""
    out = _run_stream(stream.stream_sessions(_events(spark, sf), "2 hours", "1 day"))
    return out.select("user_id", _utc("start"), _utc("end"), "n")


def _stream_queries(spark, sf):
    schema = read(spark, sf, "embeddings").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "embeddings.parquet").parquet(sf)
    return e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


@query(_SURROGATE + "SELECT query_id, a.cluster_id, theta AS center_theta, r_max, CASE WHEN r_max >= 0.02 THEN 'dense_rdp' ELSE 'out_of_scope' END AS track FROM a JOIN sur USING (cluster_id) WHERE a.rank = 1")
def stream_gate(spark, sf):
    clusters = Scratch(spark).cut(r_max_surrogate(spark, sf).select("cluster_id", "r_max").join(centers(spark, sf), "cluster_id"))
    return _run_stream(stream.stream_gate(_stream_queries(spark, sf), clusters, 0.02))


@query(SQL["knn_top10"])
def stream_retrieval(spark, sf):
    root = Scratch(spark).root
    search = lambda q: knn.exact_knn(docs(spark, sf), F.col("doc_idx"), F.col("v"), q, F.col("query_id"), F.col("qv"), 10, DIM)
    stream.stream_retrieval(_stream_queries(spark, sf), search, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/rows").select("query_id", "rank", "doc_idx", "theta")
