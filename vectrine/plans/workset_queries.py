"""The registered queries of worksets, anchors and comparison rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrine.functions.vectors import normalize
from vectrine.operators import anchors as an
from vectrine.operators import clustering as cl
from vectrine.operators import comparison as cp
from vectrine.operators import knn, metrics, preparation, routing, sampling, worksets
from vectrine.operators.text import clean_text, simhash64, whitespace_tokens
from vectrine.plans.queries import _BASE, _SIMHASH_OF, DIM, EVAL_K, _raw_once, asked, centers, docs, joined, parts, query, ranked_centers, read, truth

# --- worksets ----------------------------------------------------------------

_SOURCED = _BASE + ", so AS (SELECT doc_idx AS ord, cluster_id, (doc_idx * 7 // 3) % 40 AS source, round(list_distance(v, center), 9) AS dist FROM d JOIN c USING (cluster_id))"


def _units(spark, sf):
    """The vectors as units (ord, source, v): about forty sources."""
    return docs(spark, sf).select(F.col("doc_idx").alias("ord"), (F.floor(F.col("doc_idx") * 7 / 3) % 40).alias("source"), "v")


def _labels(spark, sf):
    return parts(spark, sf).withColumnRenamed("doc_idx", "ord")


_QUOTED = """, qn AS (SELECT cluster_id, count(*) AS n FROM so GROUP BY 1), e AS (SELECT cluster_id, n, least(floor(n * 100.0::DOUBLE / sum(n) OVER ()), n)::BIGINT AS f, round(n * 100.0::DOUBLE / sum(n) OVER () - floor(n * 100.0::DOUBLE / sum(n) OVER ()), 12) AS rest FROM qn),
eo AS (SELECT *, row_number() OVER (ORDER BY f >= n, rest DESC, n - f DESC, cluster_id) AS r, 100 - sum(f) OVER () AS spare FROM e), qu AS (SELECT cluster_id, f + CASE WHEN r <= spare AND f < n THEN 1 ELSE 0 END AS quota FROM eo),
sq AS (SELECT so.*, quota, row_number() OVER (ORDER BY cluster_id, dist, ord) AS i FROM so JOIN qu USING (cluster_id)),
g AS (SELECT 0::BIGINT AS i, list_transform(range(40), lambda x: 0::BIGINT) AS used, list_transform(range(1000), lambda x: 0::BIGINT) AS took, NULL::BIGINT AS ord
  UNION ALL SELECT i, CASE WHEN ok THEN list_transform(used, lambda x, j: CASE WHEN j = source + 1 THEN x + 1 ELSE x END) ELSE used END, CASE WHEN ok THEN list_transform(took, lambda x, j: CASE WHEN j = cluster_id + 1 THEN x + 1 ELSE x END) ELSE took END, CASE WHEN ok THEN o END FROM (
    SELECT sq.i, g.used, g.took, source, cluster_id, sq.ord AS o, g.used[source + 1] < %CAP AND g.took[cluster_id + 1] < quota AS ok FROM g JOIN sq ON sq.i = g.i + 1)),
p0 AS (SELECT ord FROM g WHERE ord IS NOT NULL), u1 AS (SELECT source, count(*) AS k FROM so JOIN p0 USING (ord) GROUP BY source),
f1 AS (SELECT ord FROM (SELECT so.*, row_number() OVER (PARTITION BY so.source ORDER BY cluster_id, dist, so.ord) AS nth FROM so WHERE ord NOT IN (SELECT ord FROM p0)) x LEFT JOIN u1 USING (source) WHERE nth + coalesce(k, 0) <= %CAP ORDER BY cluster_id, dist, ord LIMIT (SELECT 100 - count(*) FROM p0)),
f2 AS (SELECT ord FROM so WHERE ord NOT IN (SELECT ord FROM p0) AND ord NOT IN (SELECT ord FROM f1) ORDER BY cluster_id, dist, ord LIMIT (SELECT 100 - (SELECT count(*) FROM p0) - (SELECT count(*) FROM f1)))
SELECT ord, cluster_id, 0 AS fill FROM so JOIN p0 USING (ord) UNION ALL SELECT ord, cluster_id, 1 FROM so JOIN f1 USING (ord) UNION ALL SELECT ord, cluster_id, 2 FROM so JOIN f2 USING (ord)"""
_GEOMETRY = lambda cap: _SOURCED.replace("WITH d AS", "WITH RECURSIVE d AS") + _QUOTED.replace("%CAP", str(cap))


@query(_GEOMETRY(4))
def geometry_sample(spark, sf):
    return worksets.geometry_sample(_units(spark, sf), _labels(spark, sf), centers(spark, sf), 100, 4)


@query(_GEOMETRY(2))
def geometry_sample_refilled(spark, sf):
    """Sources that may give two units each can't fill the sample, so the rest comes from beyond the cap."""
    return worksets.geometry_sample(_units(spark, sf), _labels(spark, sf), centers(spark, sf), 100, 2)


@query(f"WITH s AS ({_GEOMETRY(4)}), a AS (SELECT label AS cluster_id, count(*) AS n FROM embeddings GROUP BY 1), b AS (SELECT cluster_id, count(*) AS m FROM s GROUP BY 1), x AS (SELECT abs(coalesce(m, 0) / (SELECT count(*) FROM s) - n / (SELECT count(*) FROM embeddings)) AS gap FROM a LEFT JOIN b USING (cluster_id)) SELECT round(sum(gap), 9) AS l1, round(max(gap), 9) AS linf FROM x")
def sample_shares(spark, sf):
    return worksets.sample_shares(_labels(spark, sf), geometry_sample(spark, sf))


_CORE = _BASE + """, si AS (SELECT d.doc_idx AS ord, d.cluster_id, c.cluster_id = d.cluster_id AS own, cos(s.theta) AS x FROM d JOIN s ON s.doc_idx = d.doc_idx JOIN c ON c.cluster_id = s.cluster_id),
pe AS (SELECT ord, cluster_id, max(x) FILTER (WHERE own) AS similarity, max(x) FILTER (WHERE NOT own) AS nxt FROM si GROUP BY ord, cluster_id),
ch AS (SELECT * FROM pe QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY round(similarity, 9) DESC, ord) <= 20)"""


@query(_CORE + " SELECT ord, cluster_id FROM ch")
def core_selection(spark, sf):
    return worksets.core_selection(_units(spark, sf), _labels(spark, sf), centers(spark, sf), 20)[0].select("ord", "cluster_id")


@query(_CORE + ", sz AS (SELECT cluster_id, count(*) AS n FROM d GROUP BY 1) SELECT (SELECT min(n) FROM sz) AS support_min, (SELECT quantile_cont(n, 0.5) FROM sz) AS support_p50, (SELECT max(n) FROM sz) AS support_max, round(avg(similarity), 6) AS core_similarity, round(avg(similarity - nxt), 6) AS margin, (SELECT min(n) FROM sz) >= 20 AS feasible FROM ch")
def core_scores(spark, sf):
    return worksets.core_selection(_units(spark, sf), _labels(spark, sf), centers(spark, sf), 20)[1].drop("separation")


@query("SELECT seed, feasible, core_similarity::DOUBLE AS core_similarity, support_min, support_p50::DOUBLE AS support_p50, margin::DOUBLE AS margin, best FROM (VALUES (3, true, 0.9, 20, 30.0::DOUBLE, 0.1, false), (1, true, 0.9, 21, 30.0, 0.1, true), (2, true, 0.9, 21, 30.0, 0.1, false), (0, false, 0.99, 2, 9.0, 0.5, false)) t(seed, feasible, core_similarity, support_min, support_p50, margin, best)")
def best_core(spark, sf):
    rows = [(3, True, 0.9, 20, 30.0, 0.1), (1, True, 0.9, 21, 30.0, 0.1), (2, True, 0.9, 21, 30.0, 0.1), (0, False, 0.99, 2, 9.0, 0.5)]
    return worksets.best_core(spark.createDataFrame(rows, "seed int, feasible boolean, core_similarity double, support_min int, support_p50 double, margin double"))


@query("SELECT true AS enough, 1 AS best")
def core_seed_sweep(spark, sf):
    """Whether the best of two seeds gives ten units of each of five clusters."""
    chosen, scores = worksets.core_seed_sweep(_units(spark, sf), 5, 10, range(2), DIM)
    full = chosen.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).agg(((F.min("n") == 10) & (F.max("n") == 10) & (F.count(F.lit(1)) == 5)).alias("enough"))
    return full.crossJoin(scores.agg(F.count_if("best").cast("int").alias("best")))  # one row each


_PICK = lambda side: f"('0x' || substr(sha256('42:' || i || ':{side}'), 1, 15))::BIGINT % (SELECT count(*) FROM u)"


@query(f"""WITH u AS (SELECT vec_id AS ord, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT {_PICK('a')} AS a, {_PICK('b')} AS b FROM (SELECT unnest(range(least(2000, (SELECT count(*) * (count(*) - 1) // 2 FROM u)))) AS i)), n AS (SELECT sqrt(list_dot_product(v, v)) AS x FROM u),
t AS (SELECT list_dot_product(x.v, y.v) AS x FROM p JOIN u x ON x.ord = a JOIN u y ON y.ord = b WHERE a <> b)
SELECT * FROM (SELECT count(*) AS norms, round(min(x), 6) AS norm_min, round(avg(x), 6) AS norm_mean, round(max(x), 6) AS norm_max, round(quantile_cont(x, 0.5), 6) AS norm_p50, round(quantile_cont(x, 0.95), 6) AS norm_p95 FROM n),
 (SELECT count(*) AS pairs, round(min(x), 6) AS pair_min, round(avg(x), 6) AS pair_mean, round(max(x), 6) AS pair_max, round(quantile_cont(x, 0.5), 6) AS pair_p50, round(quantile_cont(x, 0.95), 6) AS pair_p95 FROM t)""")
def geometry_summary(spark, sf):
    dense = sampling.global_index(docs(spark, sf), "doc_idx").select(F.col("index").alias("ord"), "v")
    return worksets.geometry_summary(dense, 2000, 42)


@query("SELECT n, least(n, greatest(4, round_even(sqrt(n / 2), 0)::INT), 64)::INT AS clusters, least(n, greatest(5000, 100000))::INT AS pool FROM (SELECT unnest([1, 3, 40, 300, 20000, 3000000]) AS n)")
def pool_sizes(spark, sf):
    return spark.createDataFrame([(n, worksets.coarse_clusters(n), worksets.pool_size(5000, n)) for n in (1, 3, 40, 300, 20000, 3000000)], "n int, clusters int, pool int")


@query("SELECT count(*) AS sources, min(n) AS fewest, max(n) AS most, round(max(n) / sum(n), 9) AS dominance, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90 FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def source_summary(spark, sf):
    return worksets.source_summary(read(spark, sf, "documents"))


@query("SELECT true AS dense, true AS from_pool, true AS numbered_in_order, 40 AS docs, true AS kept_cap UNION ALL SELECT true, true, true, 50, true")
def workset_builds(spark, sf):
    """What must hold of a workset built either way: as many documents as asked for, from the pool, numbered densely in its order."""
    u = _units(spark, sf).withColumns({"doc_id": F.concat(F.lit("u"), "ord"), "text": F.lit("t"), "source": F.col("source").cast("string")})
    out = None
    for built in (worksets.build_workset(u, 40, DIM, "geometry", cap=9, least_pool=200), worksets.build_workset(u, 50, DIM, "core", clusters=5, least_pool=400)):
        d = built.docs.join(u.select("doc_id", "ord"), "doc_id", "left")
        in_order = sampling.global_index(d.select("ord", "doc_idx"), "ord").agg(F.bool_and(F.col("index") == F.col("doc_idx")).alias("numbered_in_order"))
        most = d.groupBy("source").count().agg((F.max("count") <= 9).alias("kept_cap")) if built.docs.count() == 40 else spark.range(1).select(F.lit(True).alias("kept_cap"))
        row = d.agg((F.max("doc_idx") == F.count(F.lit(1)) - 1).alias("dense"), F.bool_and(F.col("ord").isNotNull()).alias("from_pool"), F.count(F.lit(1)).cast("int").alias("docs")).crossJoin(in_order).crossJoin(most)  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT count(DISTINCT doc_id) AS sources, true AS units_in_order, true AS each_source_left FROM raw_corpus WHERE length(trim(regexp_replace(CASE WHEN coalesce(trim(text), '') = '' THEN coalesce(contents, '') ELSE text END, '[\\s\\p{Z}\\x{0b}\\x{85}\\x{1c}-\\x{1f}]+', ' ', 'g'))) > 0 AND (doc_id, loaded_at, row_no) IN (SELECT doc_id, max(loaded_at), arg_max(row_no, (loaded_at, row_no)) FROM raw_corpus GROUP BY doc_id)")
def unit_pool(spark, sf):
    """From source documents to units without near-duplicates: dense numbers, and at least one unit of each source unless all went as global copies."""
    units, removed = worksets.unit_pool(_raw_once(spark, sf))
    total = removed.agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("last"))
    return units.agg(F.count_distinct("source").alias("left")).crossJoin(total).crossJoin(removed.agg(F.count_if(F.col("removed") == "global").alias("g"))).crossJoin(_sources(spark, sf)).select(
        "sources", (F.col("last") == F.col("n") - 1).alias("units_in_order"), (F.col("left") >= F.col("sources") - F.col("g")).alias("each_source_left")
    )  # one row each


def _sources(spark, sf):
    return _raw_once(spark, sf).filter(clean_text(F.col("text")) != "").agg(F.count_distinct("doc_id").alias("sources"))


@query("SELECT o_orderkey AS \"offset\", row_number() OVER (ORDER BY o_orderkey) - 1 AS doc_idx, o_custkey FROM orders WHERE o_orderkey % 5 = 0")
def subset_by_offsets(spark, sf):
    parent = read(spark, sf, "orders").select(F.col("o_orderkey").alias("offset"), "o_custkey")
    wanted = sampling.global_index(parent.filter("offset % 5 = 0").select("offset"), "offset").withColumnRenamed("index", "place")
    return worksets.subset_by_offsets(parent, wanted)


_LISTS = "WITH l AS (SELECT query_idx AS query_id, list(doc_idx ORDER BY rank) AS offsets FROM (SELECT DISTINCT query_idx, rank, doc_idx FROM gt_topk) GROUP BY 1), o AS (SELECT query_id, list_filter(offsets, lambda x: x < 1000) AS kept FROM l), k AS (SELECT query_id, list_filter(kept, lambda x, i: list_position(kept, x) = i) AS offsets FROM o)"


def _lists(spark, sf):
    g = read(spark, sf, "gt_topk").select("query_idx", "rank", "doc_idx").distinct().groupBy(F.col("query_idx").alias("query_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "doc_idx"))).alias("l"))
    return g.select("query_id", F.transform("l", lambda x: x["doc_idx"]).alias("offsets"))


@query(_LISTS + " SELECT query_id, array_to_string(offsets, ',') AS offsets FROM k")
def local_offsets(spark, sf):
    return worksets.local_offsets(_lists(spark, sf), 1000).withColumn("offsets", joined("offsets"))


@query(_LISTS + " SELECT query_id, i - 1 AS place, offsets[i] AS \"offset\", 'offset_' || offsets[i] AS doc_id FROM k, range(1, 4) r(i) WHERE i <= len(offsets)")
def first_offsets(spark, sf):
    f = worksets.first_offsets(worksets.local_offsets(_lists(spark, sf), 1000), 3)
    return f.withColumn("place", F.col("place").cast("long")).withColumn("doc_id", worksets.offset_id(F.col("offset")))


@query("SELECT event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND value >= 20")
def supported_examples(spark, sf):
    e = read(spark, sf, "events")
    first = e.agg(F.min("event_type")).first()[0]
    x = e.select("event_id", F.lit("q").alias("query"), F.col("user_id").alias("product_id"), F.col("event_type").alias("locale"), F.lit("E").alias("label"), (F.col("value") >= 20).cast("int").alias("small_version"))
    return preparation.supported_examples(x, first, True).select("event_id")


@query("SELECT l_partkey AS product_id, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 3 = 0 GROUP BY 1")
def first_products(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_returnflag").alias("locale"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    chosen = li.filter("product_id % 3 = 0").select("product_id").distinct()
    return preparation.first_products(li, chosen, "A", "ord").select("product_id", "ord")


@query("SELECT d.vec_id AS doc_idx, coalesce(source, split_part('S' || (vec_id % 7) || '::p' || vec_id, '::', 1)) AS source FROM embeddings d LEFT JOIN (SELECT doc_id, source FROM documents) x ON x.doc_id = d.vec_id")
def doc_sources(spark, sf):
    """The source that the corpus names, or what stands before '::' in the document's own id."""
    own = F.concat(F.lit("S"), (F.col("doc_idx") % 7).cast("string"), F.lit("::p"), F.col("doc_idx").cast("string"))
    known = read(spark, sf, "documents").select(F.col("doc_id").alias("doc_idx"), "source")
    return docs(spark, sf).select("doc_idx").join(known, "doc_idx", "left").select("doc_idx", F.coalesce("source", F.split_part(own, F.lit("::"), F.lit(1))).alias("source"))


# --- anchors -----------------------------------------------------------------


_STRATA = _BASE + """, x AS (SELECT cluster_id, doc_idx, row_number() OVER (PARTITION BY cluster_id ORDER BY theta, doc_idx) - 1 AS i, count(*) OVER (PARTITION BY cluster_id) AS n FROM k),
y AS (SELECT *, least(3, n) AS s, n // least(3, n) AS size, n % least(3, n) AS more FROM x), z AS (SELECT *, CASE WHEN i < more * (size + 1) THEN i // (size + 1) ELSE more + (i - more * (size + 1)) // size END AS b FROM y),
w AS (SELECT *, CASE WHEN b < more THEN size + 1 ELSE size END AS len, i - CASE WHEN b < more THEN b * (size + 1) ELSE more * (size + 1) + (b - more) * size END AS ofs, 18 // s + CASE WHEN b < 18 % s THEN 1 ELSE 0 END AS q FROM z)
SELECT cluster_id, doc_idx FROM w WHERE n <= 18 OR len <= q OR (q = 1 AND ofs = 0) OR (q > 1 AND list_contains(list_transform(range(q), lambda j: floor(j * (len - 1) / (q - 1))::BIGINT), ofs))"""


@query(_STRATA)
def stratified_anchors(spark, sf):
    a = cl.member_angles(docs(spark, sf), parts(spark, sf), centers(spark, sf))
    return sampling.stratified_pick(a, "cluster_id", "doc_idx", "theta", 18, 3)


_EVEN = ", x AS (SELECT cluster_id, doc_idx, rank - 1 AS i, count(*) OVER (PARTITION BY cluster_id) AS n FROM k), ev AS (SELECT doc_idx, cluster_id FROM x WHERE n <= 12 OR list_contains(list_transform(range(12), lambda j: floor(j * (n - 1) / 11)::BIGINT), i))"


@query(_BASE + _EVEN + " SELECT doc_idx, cluster_id FROM ev")
def docs_anchors(spark, sf):
    return an.docs_anchors(cl.member_angles(docs(spark, sf), parts(spark, sf), centers(spark, sf)), 12)


_OWNED = _BASE + ", ow AS (SELECT query_id, cluster_id FROM a WHERE rank = 1)"


@query(_OWNED + " SELECT query_id, cluster_id FROM ow QUALIFY count(*) OVER (PARTITION BY cluster_id) <= 1000")
def query_anchors(spark, sf):
    return an.query_anchors(asked(spark, sf), centers(spark, sf), 1000, 3)


def _anchors(spark, sf, policy):
    c = centers(spark, sf)
    angles = cl.member_angles(docs(spark, sf), parts(spark, sf), c)
    return an.anchors(policy, asked(spark, sf), docs(spark, sf), c, angles, 12, 3).select("anchor", F.col("cluster_id").cast("long").alias("cluster_id"))


@query(_BASE + _EVEN + " SELECT 'd' || doc_idx AS anchor, cluster_id FROM ev")
def anchors_docs_only(spark, sf):
    return _anchors(spark, sf, "docs_only")


@query(_OWNED + " SELECT 'q' || query_id AS anchor, NULL::BIGINT AS cluster_id FROM ow UNION ALL SELECT 'd' || doc_idx, NULL FROM d")
def anchors_with_docs(spark, sf):
    c = centers(spark, sf)
    angles = cl.member_angles(docs(spark, sf), parts(spark, sf), c)
    return an.anchors("calibration_query_plus_docs", asked(spark, sf), docs(spark, sf), c, angles, 1000, 3).select("anchor", "cluster_id")


@query(_BASE + ", z AS (SELECT cluster_id, r_k, r_fixed, round(tan(greatest((r_fixed - r_k) / 2, 0)), 9) AS r_max FROM f) SELECT query_id, a.cluster_id, theta AS center_theta, 5000.0::DOUBLE AS epsilon_used, 0.0::DOUBLE AS sigma, 0.0::DOUBLE AS r_bar, r_k, r_fixed, r_max, 'dense_rdp' AS track, r_max AS margin FROM a JOIN z USING (cluster_id) WHERE a.rank = 1")
def skip_gate(spark, sf):
    c = centers(spark, sf)
    t = cl.docs_only_r_max(cl.profile(cl.member_angles(docs(spark, sf), parts(spark, sf), c), EVAL_K, 50)).join(c, "cluster_id")
    return routing.skip_gate(asked(spark, sf), t, 5000.0)


@query(_BASE + ", z AS (SELECT cluster_id, round(tan(greatest((r_fixed - r_k) / 2, 0)), 9) AS r_max FROM f) SELECT CASE WHEN r_max >= sqrt(1.0::DOUBLE / 2000) * 8 THEN 'dense_rdp' ELSE 'out_of_scope' END AS track, count(*) AS n FROM a JOIN z USING (cluster_id) WHERE a.rank = 1 GROUP BY 1")
def track_counts(spark, sf):
    c = centers(spark, sf)
    t = cl.docs_only_r_max(cl.profile(cl.member_angles(docs(spark, sf), parts(spark, sf), c), EVAL_K, 50)).join(c, "cluster_id")
    return routing.track_counts(routing.gate(asked(spark, sf), t, 2.0, 2000.0, DIM))


@query(_BASE + "SELECT query_id, cluster_id, round(greatest(-1, least(1, list_dot_product(qv, center))), 9) AS cosine FROM q, c")
def center_cosines(spark, sf):
    return routing.center_cosines(asked(spark, sf), centers(spark, sf)).withColumn("cosine", F.round("cosine", 9))


# --- payloads ----------------------------------------------------------------


def _full(spark, sf):
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("doc_idx"), "text")
    return docs(spark, sf).join(texts, "doc_idx", "left").withColumn("doc_id", F.concat(F.lit("u"), F.col("doc_idx").cast("string")))


@query(_BASE + "SELECT query_id, rank, doc_idx, round(cos(theta), 9) AS score, 'u' || doc_idx AS doc_id, coalesce(length(x.text), -1) AS chars, 64 AS dim FROM t LEFT JOIN documents x ON x.doc_id = t.doc_idx WHERE rank <= 30")
def fixed_budget_payload(spark, sf):
    p = knn.payload(truth(spark, sf, 30), _full(spark, sf))
    return p.select("query_id", "rank", "doc_idx", F.round("score", 9).alias("score"), "doc_id", F.coalesce(F.length("text"), F.lit(-1)).alias("chars"), F.size("v").alias("dim"))


_CLUSTER_PAYLOAD = lambda n: _BASE + f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_idx) - 1 AS place, doc_idx, 'u' || doc_idx AS doc_id FROM (SELECT DISTINCT query_id, doc_idx FROM a JOIN d USING (cluster_id) WHERE rank <= {n})"


@query(_CLUSTER_PAYLOAD(3))
def union_cluster_payload(spark, sf):
    return knn.cluster_payload(ranked_centers(spark, sf, 3), parts(spark, sf), _full(spark, sf)).select("query_id", "place", "doc_idx", "doc_id")


@query(_CLUSTER_PAYLOAD(1))
def whole_cluster_payload(spark, sf):
    return knn.cluster_payload(ranked_centers(spark, sf, 1), parts(spark, sf), _full(spark, sf)).select("query_id", "place", "doc_idx", "doc_id")


@query(_BASE + "SELECT query_id, cluster_id, doc_idx, theta, row_number() OVER (PARTITION BY query_id ORDER BY theta, doc_idx) AS rank FROM (SELECT p.query_id, d.cluster_id, p.doc_idx, p.theta FROM a JOIN d USING (cluster_id) JOIN p USING (query_id, doc_idx) WHERE a.rank = 1) QUALIFY rank <= 10")
def nearest_cluster_ranking(spark, sf):
    """The ranking within each query's nearest cluster only."""
    near = knn.filtered_knn(docs(spark, sf), asked(spark, sf).join(ranked_centers(spark, sf, 1).select("query_id", "cluster_id"), "query_id"), parts(spark, sf), 10)
    return near.select("query_id", "cluster_id", "doc_idx", "theta", "rank")


@query("WITH b AS (SELECT cluster_id, len(chunk) AS members, center FROM cluster_info) SELECT cluster_id, members, center IS NOT NULL AS has_center FROM b")
def shard_manifest(spark, sf):
    """Members of each cluster, and whether its center is delivered."""
    return read(spark, sf, "cluster_info").select("cluster_id", F.size("chunk").cast("long").alias("members"), F.col("center").isNotNull().alias("has_center"))


@query(_BASE + "SELECT cluster_id, round(CASE WHEN cluster_id % 2 = 0 THEN center[1] ELSE 1.0::DOUBLE / 8 END, 6) AS first_value FROM c")
def centers_or_means(spark, sf):
    """The given center of a cluster, else the mean of its members."""
    given = centers(spark, sf).select("cluster_id", F.when(F.col("cluster_id") % 2 == 1, F.array_repeat(F.lit(0.125), DIM)).alias("given"))
    both = centers(spark, sf).select("cluster_id", "center").join(given, "cluster_id").select("cluster_id", F.coalesce("given", "center").alias("center"))
    return both.select("cluster_id", F.round(normalize(F.col("center"))[0], 6).alias("first_value"))


# --- comparison rows ---------------------------------------------------------


@query(_BASE + f"""SELECT round(avg(recall), 9) AS exact_recall, round(avg(ordered), 9) AS order_match_rate, round(avg(cover), 9) AS cover_rate, round(avg(hit), 9) AS cluster_hit_rate FROM (
 SELECT t.query_id, count(r.doc_idx) / {EVAL_K} AS recall, bool_and(coalesce(r.rank = t.rank, false))::INT AS ordered, bool_and(o.cluster_id = d.cluster_id)::INT AS cover, bool_or(o.cluster_id = d.cluster_id AND t.rank = 1)::INT AS hit
 FROM t JOIN d USING (doc_idx) JOIN (SELECT query_id, cluster_id FROM a WHERE rank = 1) o USING (query_id) LEFT JOIN (
   SELECT query_id, doc_idx, row_number() OVER (PARTITION BY query_id ORDER BY p.theta, doc_idx) AS rank FROM p JOIN d USING (doc_idx) JOIN (SELECT query_id, cluster_id FROM a WHERE rank = 1) USING (query_id, cluster_id) QUALIFY rank <= {EVAL_K}) r USING (query_id, doc_idx)
 WHERE t.rank <= {EVAL_K} GROUP BY t.query_id)""")
def exact_rates(spark, sf):
    got = nearest_cluster_ranking(spark, sf)
    return cp.exact_rates(got, truth(spark, sf), parts(spark, sf), ranked_centers(spark, sf, 1), EVAL_K)


@query("""WITH j AS (SELECT query_idx AS q, rank, doc_idx FROM (SELECT DISTINCT query_idx, rank, doc_idx FROM gt_topk)), r AS (SELECT q, doc_idx FROM j WHERE doc_idx % 3 = 0),
h AS (SELECT j.q, count(DISTINCT r.doc_idx) AS hits, min(j.rank) FILTER (WHERE r.doc_idx IS NOT NULL) AS f FROM j LEFT JOIN r USING (q, doc_idx) WHERE rank <= 5 GROUP BY j.q), p AS (SELECT q, count(DISTINCT doc_idx) AS pos FROM r GROUP BY q), x AS (SELECT h.*, coalesce(pos, 0) AS pos FROM h LEFT JOIN p USING (q))
SELECT count(*) AS num_queries, count(*) FILTER (WHERE pos > 0) AS num_judged, round(avg((hits > 0)::INT), 9) AS hit_rate, round(avg((hits > 0)::INT) FILTER (WHERE pos > 0), 9) AS hit_rate_judged, round(avg(CASE WHEN pos > 0 THEN hits / pos ELSE 0 END), 9) AS recall,
 round(avg(hits / pos) FILTER (WHERE pos > 0), 9) AS recall_judged, round(avg(coalesce(f, 6)) FILTER (WHERE pos > 0), 9) AS mean_first_relevant_rank, round(avg(coalesce(f = 1, false)::INT), 9) AS top1_hit_rate FROM x""")
def ranking_rollup(spark, sf):
    ranked = read(spark, sf, "gt_topk").select(F.col("query_idx").alias("query_id"), "rank", "doc_idx").distinct()
    return cp.ranking_rollup(metrics.hit_and_recall(ranked, ranked.filter("doc_idx % 3 = 0").select("query_id", "doc_idx"), 5), 5)


_RUNS = "WITH r AS (SELECT n_nationkey AS k, n_regionkey AS g FROM nation)"
_SHOWN = ("run_label", "comparison_axis", "num_docs", "latency_total_sec_avg", "comm_request_bytes_avg", "comm_response_bytes_avg", "comm_downstream_bytes_avg", "exact_topk_overlap_mean", "direct_retrieve_rate", "ot_retrieve_rate")


def _runs(spark, sf):
    """A summary a nation: keys that some runs have and others don't."""
    n = read(spark, sf, "nation")
    return n.select(
        F.concat(F.lit("run"), "n_nationkey").alias("run_label"), (F.col("n_nationkey") * 100).cast("long").alias("num_docs"), F.lit(10).cast("long").alias("top_k"), F.lit(8).cast("long").alias("num_queries"),
        F.when(F.col("n_regionkey") == 0, F.lit(9.5)).alias("latency_total_sec_avg"), F.when(F.col("n_regionkey") <= 1, F.lit(7.5)).alias("time_total_sec_avg"),
        F.lit(1.0).alias("time_client_generate_query_sec_avg"), F.col("n_regionkey").cast("double").alias("time_server_query_sec_avg"), F.lit(0.25).alias("time_client_recover_docs_sec_avg"),
        F.lit(2.0).alias("comm_client_generate_query_mb_avg"), F.lit(0.5).alias("comm_server_query_mb_avg"), F.lit(0.75).alias("avg_exact_recall_at_k"),
        F.lit(0.5).alias("time_client_encrypt_query_sec_avg"), F.lit(0.125).alias("time_server_phe_score_sec_avg"), F.lit(100.0).alias("comm_client_encrypt_query_bytes_avg"), F.lit(20.0).alias("comm_retrieve_request_bytes_avg"),
        F.lit(64.0).alias("comm_retrieve_response_bytes_avg"), F.lit(6.0).alias("mean_exact_topk_overlap_count"), (F.col("n_nationkey") % 9).alias("direct_queries"), (8 - F.col("n_nationkey") % 9).alias("oblivious_queries"),
        F.when(F.col("n_regionkey") == 2, F.lit(4096.0)).alias("comm_request_bytes_avg"), F.lit(3.0).alias("comm_request_mb_avg"), F.when(F.col("n_regionkey") != 3, F.lit(0.5)).alias("exact_recall_at_k"), F.lit(0.25).alias("recall_at_k"), F.lit(0.9).alias("candidate_overlap_mean"),
    )


@query(_RUNS + " SELECT 'run' || k AS run_label, 'qrels_bundle' AS comparison_axis, k * 100 AS num_docs, (CASE WHEN g = 0 THEN 9.5 WHEN g = 1 THEN 7.5 ELSE 1.25 + g END)::DOUBLE AS latency_total_sec_avg, 2097152.0::DOUBLE AS comm_request_bytes_avg, 524288.0::DOUBLE AS comm_response_bytes_avg, NULL::DOUBLE AS comm_downstream_bytes_avg, 0.75::DOUBLE AS exact_topk_overlap_mean, 1.0::DOUBLE AS direct_retrieve_rate, 0.0::DOUBLE AS ot_retrieve_rate FROM r")
def plain_rows(spark, sf):
    return cp.plain_rows(_runs(spark, sf)).select(*_SHOWN)


@query(_RUNS + " SELECT 'exact_n' || (k * 100) AS run_label, 'database_size' AS comparison_axis, k * 100 AS num_docs, k + 1 AS num_clusters, 0.75::DOUBLE AS exact_topk_overlap_mean FROM r WHERE g = 2")
def scaling_rows(spark, sf):
    sizes = read(spark, sf, "nation").filter("n_regionkey = 2").select((F.col("n_nationkey") * 100).cast("long").alias("num_docs"), (F.col("n_nationkey") + 1).cast("long").alias("num_clusters"))
    return cp.scaling_rows(sizes, _runs(spark, sf), "exact").select("run_label", "comparison_axis", "num_docs", "num_clusters", "exact_topk_overlap_mean")


@query(_RUNS + " SELECT 'run' || k AS run_label, NULL::VARCHAR AS comparison_axis, k * 100 AS num_docs, 0.625::DOUBLE AS latency_total_sec_avg, 120.0::DOUBLE AS comm_request_bytes_avg, 0.0::DOUBLE AS comm_response_bytes_avg, 64.0::DOUBLE AS comm_downstream_bytes_avg, 0.6::DOUBLE AS exact_topk_overlap_mean, (k % 9) / 8 AS direct_retrieve_rate, (8 - k % 9) / 8 AS ot_retrieve_rate FROM r")
def distance_rows(spark, sf):
    return cp.distance_rows(_runs(spark, sf)).select(*_SHOWN)


@query(_RUNS + " SELECT 'run' || k AS run_label, 'ann_benchmark_dataset' AS comparison_axis, k * 100 AS num_docs, (CASE WHEN g = 0 THEN 9.5 WHEN g = 1 THEN 7.5 ELSE 1.25 + g END)::DOUBLE AS latency_total_sec_avg, (CASE WHEN g = 2 THEN 4096 ELSE 3145728 END)::DOUBLE AS comm_request_bytes_avg, NULL::DOUBLE AS comm_response_bytes_avg, NULL::DOUBLE AS comm_downstream_bytes_avg, (CASE WHEN g <> 3 THEN 0.5 ELSE 0.25 END)::DOUBLE AS exact_topk_overlap_mean, NULL::DOUBLE AS direct_retrieve_rate, NULL::DOUBLE AS ot_retrieve_rate FROM r")
def multi_party_rows(spark, sf):
    return cp.multi_party_rows(_runs(spark, sf), False).select(*_SHOWN)


@query(_RUNS + " SELECT 'run' || k AS run_label, 'qrels_bundle' AS comparison_axis, k * 100 AS num_docs, (0.5 + 0.125 + 2.5)::DOUBLE AS latency_total_sec_avg, 1280.0::DOUBLE AS comm_request_bytes_avg, 2048.0::DOUBLE AS comm_response_bytes_avg, 4096.0::DOUBLE AS comm_downstream_bytes_avg, 0.8::DOUBLE AS exact_topk_overlap_mean, 1.0::DOUBLE AS direct_retrieve_rate, 0.0::DOUBLE AS ot_retrieve_rate FROM r")
def lattice_rows(spark, sf):
    ranking = _runs(spark, sf).select("run_label", "num_docs", "time_client_encrypt_query_sec_avg", F.lit(0.125).alias("time_server_rank_cluster_sec_avg"), F.lit(1024.0).alias("mean_encrypted_query_token_bytes"), F.lit(2048.0).alias("mean_encrypted_scores_bytes"))
    documents = ranking.select("run_label", F.lit(2.5).alias("time_server_process_pir_sec_avg"), F.lit(256.0).alias("mean_pir_request_bytes"), F.lit(4096.0).alias("mean_pir_response_bytes"))
    return cp.lattice_rows(ranking, documents, ranking.select("run_label", F.lit(0.8).alias("exact_recall"))).select(*_SHOWN)


@query(_RUNS + " SELECT 'run' || k AS run_label, 'main' AS variant, 500 AS num_docs, (CASE WHEN g = 0 THEN 9.5 WHEN g = 1 THEN 7.5 ELSE 1.25 + g END)::DOUBLE AS time_three_stage_total_sec_avg, 2.5::DOUBLE AS comm_total_mb_avg FROM r")
def clean_runs(spark, sf):
    chosen = cp.selection_table(spark, [("main", 500, 10, 50, 5), ("large", 5000, 20, 300, 5)])
    return cp.clean_run(_runs(spark, sf), chosen, "main").select("run_label", "variant", "num_docs", "time_three_stage_total_sec_avg", "comm_total_mb_avg")


@query("SELECT o_orderpriority::VARCHAR AS num_docs, count(*) AS num_queries, round(avg(o_custkey), 9) AS exact_recall_avg, round(avg(o_totalprice), 4) AS latency_sec_avg FROM orders GROUP BY 1")
def by_size(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").cast("string").alias("num_docs"), F.col("o_custkey").cast("double").alias("exact_recall"), F.col("o_totalprice").cast("double").alias("latency_sec"), F.lit(1).alias("request_bytes"), F.lit(2).alias("response_bytes"))
    return cp.by_size(o).select("num_docs", "num_queries", "exact_recall_avg", F.round("latency_sec_avg", 4).alias("latency_sec_avg"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def counts_by(spark, sf):
    return cp.counts_by(read(spark, sf, "documents"), "source", "lang")


@query("SELECT (SELECT count(*) FROM embeddings) AS num_docs, 64 AS dim, (SELECT count(DISTINCT query_idx) FROM workset_queries) AS num_queries, count(*) AS num_qrels, count(DISTINCT query_idx) AS num_judged FROM (SELECT DISTINCT query_idx, doc_idx FROM gt_topk)")
def workset_stats(spark, sf):
    q = read(spark, sf, "workset_queries").select(F.col("query_idx").alias("query_id"))
    j = read(spark, sf, "gt_topk").select(F.col("query_idx").alias("query_id"), F.col("doc_idx").alias("doc_id"))
    return cp.workset_stats(docs(spark, sf), q, j)


@query("SELECT query_idx AS query_id, row_number() OVER (PARTITION BY query_idx ORDER BY rank, doc_idx) AS rank, doc_idx FROM (SELECT DISTINCT query_idx, rank, doc_idx FROM gt_topk) WHERE doc_idx < 1000")
def in_range(spark, sf):
    return cp.in_range(read(spark, sf, "gt_topk").select(F.col("query_idx").alias("query_id"), "rank", "doc_idx").distinct(), 1000)


@query("SELECT event_id, value * 1048576 AS bytes, abs(value) / 1048576 AS mib, coalesce(CASE WHEN value < 50 THEN event_id % 9 END, 10) AS penalised, least(1000000, greatest(300, 640)) * 4 * 64 AS io_bytes FROM events")
def accounting(spark, sf):
    e = read(spark, sf, "events")
    rank = F.when(F.col("value") < 50, F.col("event_id") % 9)
    return e.select("event_id", metrics.bytes_or_mib(F.lit(None), F.col("value")).alias("bytes"), metrics.mib(F.abs("value")).alias("mib"), metrics.penalised_rank(rank, 9).alias("penalised"), F.lit(metrics.io_bytes(1_000_000, 300, 64)).alias("io_bytes"))


@query("SELECT 64 AS dims, 1000000 AS docs, 3 AS message_bytes, 117 AS points, 8192 AS degree")
def ring_sizes(spark, sf):
    return spark.createDataFrame([(64, 1_000_000, preparation.message_bytes(64, 1_000_000), preparation.most_points(64, 1_000_000, 8192), preparation.ring_degree(64, 1_000_000, 100))], "dims int, docs int, message_bytes int, points int, degree int")


@query("SELECT s_suppkey, 10 // 3 + CASE WHEN s_suppkey % 3 < 10 % 3 THEN 1 ELSE 0 END AS quota, sha256('7::' || s_suppkey) AS key FROM supplier")
def even_quotas(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", sampling.even_quota(10, 3, F.col("s_suppkey") % 3).alias("quota"), sampling.seeded_key(7, F.col("s_suppkey").cast("string")).alias("key"))


@query("""WITH q AS (SELECT query_idx AS id, any_value(trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}\\x{0b}\\x{85}\\x{1c}-\\x{1f}]+', ' ', 'g'))) AS text FROM workset_queries GROUP BY 1), po AS (SELECT * FROM q WHERE id % 2 = 0 AND text <> ''), ju AS (SELECT DISTINCT id FROM q WHERE id % 3 <> 0),
n AS (SELECT text, min(id) AS id FROM q WHERE len(string_split(text, ' ')) BETWEEN 2 AND 24 AND text <> '' AND id IN (SELECT id FROM ju) AND id NOT IN (SELECT id FROM po) AND text NOT IN (SELECT text FROM po) GROUP BY text)
SELECT id AS query_id, text FROM n ORDER BY ('0x' || substr(sha256('7::' || id), 1, 16))::UBIGINT, id LIMIT 30""")
def grown_pool(spark, sf):
    q = read(spark, sf, "workset_queries").groupBy(F.col("query_idx").alias("query_id")).agg(F.max(clean_text(F.col("text"))).alias("text")).filter("text <> ''")
    pool = q.filter("query_id % 2 = 0")
    return preparation.grow_pool(pool, q, q.filter("query_id % 3 <> 0").select("query_id"), pool.count() + 30, 7)


@query(f"SELECT doc_id, simhash FROM ({_SIMHASH_OF('doc_id', '(SELECT p_partkey AS doc_id, p_name AS text FROM part)')})")
def whitespace_simhash(spark, sf):
    """Over what white space separates; part names have no other signs."""
    return simhash64(read(spark, sf, "part"), F.col("p_partkey"), whitespace_tokens(F.col("p_name"))).withColumnRenamed("id", "doc_id")
