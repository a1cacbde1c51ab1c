"""Balanced partitions, their geometry and their quality.

Tables: docs(doc_idx, v), assignment(doc_idx, cluster_id), centers(cluster_id,
center).  The balanced assignments are sequential by nature, yet each has an
equal form in rounds of windows (documents propose, clusters keep their best),
so no step walks over documents one by one.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions.arrow_vectors import take, usable
from vectrine.functions.vectors import dot, l2, mean_vector, norm, normalize, theta
from vectrine.operators.knn import against_centers
from vectrine.operators.sampling import at_fraction, global_index, group_index
from vectrine.plans.config import Settings
from vectrine.plans.materialize import Scratch


def centroids(members: DataFrame, dim: int) -> DataFrame:
    """(cluster_id, center, size): normalised mean of the members (cluster_id, v), rounded to 9 places."""
    m = members.groupBy("cluster_id").agg(mean_vector(F.col("v"), dim).alias("m"), F.count(F.lit(1)).alias("size"))
    return m.select("cluster_id", F.transform(normalize(F.col("m")), lambda x: F.round(x, 9)).alias("center"), "size")


def member_angles(docs: DataFrame, assignment: DataFrame, centers: DataFrame) -> DataFrame:
    """(doc_idx, cluster_id, theta, rank, n) of each document to its own center, and the size of its cluster."""
    angles = docs.join(assignment, "doc_idx").join(centers.select("cluster_id", "center"), "cluster_id").select("doc_idx", "cluster_id", theta(F.col("v"), F.col("center")).alias("theta"))
    return group_index(angles, "cluster_id", "theta", "doc_idx").select("doc_idx", "cluster_id", "theta", (F.col("index") + 1).alias("rank"), "n")


def profile(angles: DataFrame, eval_k: int, fixed_k: int) -> DataFrame:
    """Radii of each cluster: the eval_k-th and fixed_k-th smallest angle (the last, where there are fewer), smallest, median, mean and largest."""
    at = lambda k: F.max(F.when(F.col("rank") <= k, F.col("theta")))
    return angles.withColumn("index", F.col("rank") - 1).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), at(eval_k).alias("r_k"), at(fixed_k).alias("r_fixed"), F.min("theta").alias("theta_min"),
        at_fraction(F.col("theta"), 0.5, F.col("n")).alias("theta_p50"), F.round(F.avg("theta"), 9).alias("theta_mean"), F.max("theta").alias("theta_max"),
    )


def docs_only_r_max(profiles: DataFrame) -> DataFrame:
    """r_max = tan(max((r_fixed - r_k) / 2, 0))."""
    return profiles.withColumn("r_max", F.round(F.tan(F.greatest((F.col("r_fixed") - F.col("r_k")) / 2, F.lit(0.0))), 9))


def top_c_support(docs: DataFrame, centers: DataFrame, c: int) -> DataFrame:
    """(doc_idx, cluster_id, rank): each document under its c nearest centers."""
    near = against_centers(docs, F.col("doc_idx"), F.col("v"), centers, c)
    return near.select(F.col("id").alias("doc_idx"), "cluster_id", "rank")


def costs(docs: DataFrame, centers: DataFrame) -> DataFrame:
    """(doc_idx, cluster_id, cost): Euclidean distance of each document to each center, rounded to 9 places."""
    return against_centers(docs, F.col("doc_idx"), F.col("v"), centers, None, "l2").select(F.col("id").alias("doc_idx"), "cluster_id", F.col("value").alias("cost"))


def check_capacity(cost: DataFrame, capacity: int) -> None:
    """An error unless the documents are clusters * ``capacity``."""
    docs, clusters = cost.agg(F.count_distinct("doc_idx"), F.count_distinct("cluster_id")).first()
    Settings.check_partition(clusters, capacity, docs)


def preferences(docs: DataFrame, centers: DataFrame, keep: int | None = None) -> DataFrame:
    """(doc_idx, pref, cost): the ``keep`` nearest clusters of each document (all, if None), by distance, ties by id, in one row."""
    near = against_centers(docs, F.col("doc_idx"), F.col("v"), centers, keep, "l2")
    l = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "cluster_id", "value"))).alias("l"))
    return l.select(F.col("id").alias("doc_idx"), F.transform("l", lambda x: x["cluster_id"]).alias("pref"), F.transform("l", lambda x: x["value"]).alias("cost"))


#: Bins of the order in which a cluster's last document is sought.
PLACE_BINS = 4096


def _places(chosen: DataFrame, full: dict[int, int], width: int) -> dict[int, int]:
    """The place of the so-manieth document, in order, that chose each cluster: chosen(place, cluster_id)."""
    rows = chosen.filter(F.col("cluster_id").isin(list(full)))
    count = rows.groupBy("cluster_id", F.floor(F.col("place") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("cluster_id", "bin").collect()  # PLACE_BINS rows a cluster
    at, left = {}, dict(full)
    for r in count:
        if r["cluster_id"] not in at:
            if r["n"] >= left[r["cluster_id"]]:
                at[r["cluster_id"]] = r["bin"]
            else:
                left[r["cluster_id"]] -= r["n"]
    if width == 1:
        return at
    inside = F.lit(False)
    for c, b in at.items():
        inside = inside | ((F.col("cluster_id") == c) & (F.floor(F.col("place") / width) == b))
    low = {c: b * width for c, b in at.items()}
    base = F.element_at(F.create_map(*(F.lit(x) for c, v in low.items() for x in (int(c), int(v)))), F.col("cluster_id"))
    found = _places(rows.filter(inside).select("cluster_id", (F.col("place") - base).alias("place")), left, max(1, -(-width // PLACE_BINS)))
    return {c: low[c] + p for c, p in found.items()}


def assign_by_preference(prefs: DataFrame, capacity: int) -> DataFrame:
    """(doc_idx, cluster_id): documents in order of falling margin (second best less best cost) take the nearest cluster with room; null for one whose clusters are all full.

    Each document stands at a place of that order.  A cluster that more choose
    than it holds is closed behind the place of its last one; whoever stands
    behind looks further.  The closed places are all that changes, so a round
    is one count over the documents, and none of them moves.
    """
    scratch = Scratch(prefs.sparkSession)
    margin = F.round(F.coalesce(F.get("cost", F.lit(1)) - F.get("cost", F.lit(0)), F.lit(1.0)), 9)
    order = prefs.select("doc_idx", "pref", margin.alias("margin"), F.col("cost")[0].alias("best"))
    rows = scratch.cut(global_index(order, F.desc("margin"), "best", "doc_idx").select("doc_idx", "pref", F.col("index").alias("place")))
    n = rows.count()
    closed: dict[int, int] = {}
    while True:
        if closed:
            last = F.create_map(*(F.lit(x) for c, p in closed.items() for x in (int(c), int(p))))  # one entry a cluster
            open_to = F.filter("pref", lambda c: F.coalesce(F.col("place") <= F.element_at(last, c), F.lit(True)))
        else:
            open_to = F.col("pref")
        chosen = rows.select("doc_idx", "place", F.get(open_to, F.lit(0)).alias("cluster_id"))
        over = chosen.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > capacity) & F.col("cluster_id").isNotNull()).collect()  # one row a cluster at most
        if not over:
            return chosen.select("doc_idx", "cluster_id")
        closed |= _places(chosen.select("place", "cluster_id"), {r["cluster_id"]: capacity for r in over}, max(1, -(-n // PLACE_BINS)))


#: Clusters that a document ranks at first.
FIRST_CHOICES = 16


def balanced_partition(docs: DataFrame, centers: DataFrame, capacity: int) -> DataFrame:
    """(doc_idx, cluster_id): as ``balanced_assignment``, from vectors: a document ranks its nearest clusters only, and more of them if those are all full."""
    scratch = Scratch(docs.sparkSession)
    n, k = docs.count(), centers.count()
    Settings.check_partition(k, capacity, n)
    keep = min(k, max(2, FIRST_CHOICES))  # the margin needs two
    while True:
        out = scratch.cut(assign_by_preference(scratch.cut(preferences(docs, centers, keep)), capacity))
        if keep == k or out.filter("cluster_id is null").isEmpty():
            return out
        keep = min(k, 4 * keep)


def balanced_assignment(cost: DataFrame, capacity: int) -> DataFrame:
    """(doc_idx, cluster_id): documents in order of falling margin (second best less best cost) take the nearest cluster with room.

    cost(doc_idx, cluster_id, cost) of all documents and clusters.  Documents
    that aren't as many as clusters * ``capacity`` are an error.
    """
    scratch = Scratch(cost.sparkSession)
    cost = scratch.cut(cost)
    check_capacity(cost, capacity)
    l = cost.groupBy("doc_idx").agg(F.sort_array(F.collect_list(F.struct("cost", "cluster_id"))).alias("l"))
    return assign_by_preference(l.select("doc_idx", F.transform("l", lambda x: x["cluster_id"]).alias("pref"), F.transform("l", lambda x: x["cost"]).alias("cost")), capacity)


def _ends(ends: dict[int, int], cluster: Column, place: Column) -> Column:
    """Whether a cluster still takes or gives at a place: it isn't among the ended ones, or ends there or later."""
    if not ends:
        return F.lit(True)
    last = F.create_map(*(F.lit(x) for c, p in ends.items() for x in (int(c), int(p))))  # one entry a cluster
    return F.coalesce(place <= F.element_at(last, cluster.cast("int")), F.lit(True))


def _first_end(ahead: DataFrame, give: dict[int, int], take: dict[int, int], low: int, width: int, bins: int) -> tuple[int | None, dict[int, int], dict[int, int]]:
    """The first place at which a cluster gives or takes its last document, and what all still give and take behind it; None if none does: ahead(place, src, dst)."""
    count = ahead.groupBy(F.floor((F.col("place") - low) / width).alias("bin"), "src", "dst").agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # bins times pairs of clusters
    for b, part in groupby(count, key=lambda r: r["bin"]):
        g, t = dict(give), dict(take)
        for r in part:
            g[r["src"]] -= r["n"]
            t[r["dst"]] -= r["n"]
        if min([*g.values(), *t.values()]) <= 0:
            at = low + b * width
            if width == 1:
                return at, g, t
            return _first_end(ahead.filter((F.col("place") >= at) & (F.col("place") < at + width)), give, take, at, max(1, -(-width // bins)), bins)
        give, take = g, t
    return None, give, take


def capacity_repair(cost: DataFrame, labels: DataFrame, capacity: int) -> DataFrame:
    """(doc_idx, cluster_id): documents of overfull clusters move, cheapest first, to clusters with room.

    A move costs cost(new) - cost(initial); a document moves once.  Each move
    stands at a place of the order (cost, doc, cluster), and moves are made in
    it until a cluster is full or gives no more; that place ends the cluster.
    The ends are all that changes: from one to the next, each document counts
    with its first move to a cluster that still takes.  If moves end before the
    sizes are even, documents are assigned by margin instead.  Documents that
    aren't as many as clusters * ``capacity`` are an error.
    """
    scratch = Scratch(cost.sparkSession)
    cost = scratch.cut(cost)
    check_capacity(cost, capacity)
    size = {r["cluster_id"]: 0 for r in cost.select("cluster_id").distinct().collect()}  # one row a cluster, as below
    size |= {r["cluster_id"]: r["count"] for r in labels.groupBy("cluster_id").count().collect()}
    give, take = {c: n - capacity for c, n in size.items() if n > capacity}, {c: capacity - n for c, n in size.items() if n < capacity}
    if not give:
        return labels.select("doc_idx", "cluster_id")
    own = labels.withColumnRenamed("cluster_id", "src").filter(F.col("src").isin(list(give))).join(cost.select("doc_idx", F.col("cluster_id").alias("src"), F.col("cost").alias("own")), ["doc_idx", "src"])
    moves = cost.filter(F.col("cluster_id").isin(list(take))).join(own, "doc_idx").select("doc_idx", "src", F.col("cluster_id").alias("dst"), F.round(F.col("cost") - F.col("own"), 9).alias("delta"))
    placed = global_index(moves, "delta", "doc_idx", "dst").groupBy("doc_idx", "src").agg(F.sort_array(F.collect_list(F.struct(F.col("index").alias("place"), "dst"))).alias("m"), F.count(F.lit(1)).alias("n"))
    rows = scratch.cut(placed)
    bins = max(64, (1 << 18) // (len(give) * max(1, len(take))))
    width = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // bins))
    full, empty, frontier = {}, {}, -1

    def chosen() -> DataFrame:
        first = F.get(F.filter("m", lambda x: _ends(full, x["dst"], x["place"])), F.lit(0))
        return rows.select("doc_idx", "src", first.alias("x")).select("doc_idx", "src", "x.place", "x.dst").filter(_ends(empty, F.col("src"), F.col("place")))

    while True:
        end, give, take = _first_end(chosen().filter(F.col("place") > frontier), give, take, 0, width, bins)
        if end is None:
            break
        frontier = end
        empty |= {c: end for c, n in give.items() if n == 0}
        full |= {c: end for c, n in take.items() if n == 0}
        give, take = {c: n for c, n in give.items() if n}, {c: n for c, n in take.items() if n}
        if not give or not take:
            break
    moved = scratch.cut(chosen().filter("dst is not null").select("doc_idx", "dst"))
    if give:
        return balanced_assignment(cost, capacity)
    return labels.join(moved, "doc_idx", "left").select("doc_idx", F.coalesce("dst", "cluster_id").alias("cluster_id"))


def _labels(centers: np.ndarray):
    """Labels of the vectors."""

    def run(batches):
        for b in batches:
            rows, m, norms = usable(b.column(1), centers.shape[1])
            if len(rows):
                u = m.astype(np.float64) / norms[:, None]
                yield pa.record_batch([take(b.column(0), rows), pa.array(np.round(u @ centers.T, 12).argmax(1))], ["doc_idx", "cluster_id"])

    return run


def _sums(centers: dict[int, np.ndarray], dim: int):
    """Sums of the vectors by label with the farthest rows, under each run's centers."""

    def run(batches):
        total = {r: np.zeros_like(c) for r, c in centers.items()}
        n = {r: np.zeros(len(c), np.int64) for r, c in centers.items()}
        far = {r: [] for r in centers}
        for b in batches:
            rows, m, norms = usable(b.column(1), dim)
            if len(rows) == 0:
                continue
            u = m.astype(np.float64) / norms[:, None]
            ids = take(b.column(0), rows).to_numpy()
            for r, own in centers.items():
                c = np.round(u @ own.T, 12)
                label = c.argmax(1)
                np.add.at(total[r], label, u)
                n[r] += np.bincount(label, minlength=len(own))
                best = c[np.arange(len(u)), label]
                order = np.lexsort((ids, best))[: len(own)]
                far[r] = sorted([*far[r], *((best[i], int(ids[i]), u[i].tolist()) for i in order)], key=lambda x: x[:2])[: len(own)]
        for r in centers:
            kind, key = [0] * len(n[r]) + [1] * len(far[r]), [*range(len(n[r])), *(f[1] for f in far[r])]
            value = pa.array([*map(float, n[r]), *(f[0] for f in far[r])])
            yield pa.record_batch([pa.array([r] * len(kind)), pa.array(kind), pa.array(key), value, pa.array([*total[r].tolist(), *(f[2] for f in far[r])], pa.list_(pa.float64()))], ["run", "kind", "key", "n", "v"])

    return run


#: Documents among which the seeds of k-means are drawn.
SEED_ROWS = 16384


def seed_centers(docs: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """Unit vectors of ``k`` documents: the first of the smallest seeded hash, each next one drawn with a chance in proportion to its squared distance from the nearest seed so far.

    They are drawn among the ``SEED_ROWS`` documents of the smallest hashes;
    the clusters themselves are then found over all documents.
    """
    t = docs.select("doc_idx", "v", F.xxhash64("doc_idx", F.lit(seed)).alias("h")).orderBy("h", "doc_idx").limit(max(SEED_ROWS, k)).select("v").toArrow()
    _, m, norms = usable(t.column("v"), dim)
    pool = m.astype(np.float64) / norms[:, None]
    rng, picked = np.random.default_rng(seed), [0] if len(pool) else []
    near = ((pool - pool[0]) ** 2).sum(1) if picked else np.empty(0)
    while len(picked) < min(k, len(pool)):
        total = near.sum()
        i = int(rng.choice(len(pool), p=near / total)) if total > 1e-12 else int(rng.integers(len(pool)))
        picked.append(i)
        near = np.minimum(near, ((pool - pool[i]) ** 2).sum(1))
    return pool[picked]


def _moved(centers: np.ndarray, t) -> np.ndarray:
    """The centers of the next round from the sums of one; an empty cluster takes the document farthest from its center that no other empty cluster took."""
    new, used = centers.copy(), set()
    far = t[t["kind"] == 1].sort_values(["n", "key"])
    for c in range(len(centers)):
        own = t[(t["kind"] == 0) & (t["key"] == c)]
        if own["n"].sum() > 0:
            new[c] = np.sum(own["v"].tolist(), axis=0)
        else:
            pick = next((r for r in far.itertuples() if r.key not in used), None)
            if pick is not None:
                used.add(pick.key)
                new[c] = pick.v
        new[c] /= max(np.linalg.norm(new[c]), 1e-12)
    return new


def settled_centers(rows: DataFrame, k: int, seeds: list[int], dim: int, most_rounds: int = 50) -> dict[int, np.ndarray]:
    """Centers of k-means by angle from the seeds of ``seed_centers``, of each seed until they stay.

    A round is one pass for all seeds that still move, and returns one sum a
    seed, cluster and partition; only the centers are on the driver.  Each
    round reads ``rows`` anew, so they should be a table and not a computation.
    """
    centers = {s: seed_centers(rows, k, s, dim) for s in seeds}
    moving = list(centers)
    for _ in range(most_rounds):
        if not moving:
            break
        t = rows.mapInArrow(_sums({s: centers[s] for s in moving}, dim), "run long, kind long, key long, n double, v array<double>").toArrow().to_pandas()
        new = {s: _moved(centers[s], t[t["run"] == s]) for s in moving}
        moving = [s for s in moving if np.abs(new[s] - centers[s]).max() >= 1e-9]
        centers |= {s: new[s] for s in moving}
    return centers


def spherical_kmeans(docs: DataFrame, k: int, seed: int, dim: int, most_rounds: int = 50) -> DataFrame:
    """(doc_idx, cluster_id): the nearest of the ``settled_centers`` of one seed."""
    rows = docs.select("doc_idx", "v")
    return rows.mapInArrow(_labels(settled_centers(rows, k, [seed], dim, most_rounds)[seed]), "doc_idx long, cluster_id long")


def core_centers(docs: DataFrame, assignment: DataFrame, centers: DataFrame, core: int, dim: int) -> DataFrame:
    """(cluster_id, core_center, core_cosine): the center of the ``core`` nearest members and its cosine with the full one."""
    near = member_angles(docs, assignment, centers).filter(F.col("rank") <= core).join(docs, "doc_idx")
    c = centroids(near.select("cluster_id", "v"), dim).select("cluster_id", F.col("center").alias("core_center"))
    return c.join(centers, "cluster_id").select("cluster_id", "core_center", F.round(dot(F.col("core_center"), F.col("center")) / (norm(F.col("core_center")) * norm(F.col("center"))), 6).alias("core_cosine"))


def alignment(before: DataFrame, after: DataFrame) -> DataFrame:
    """Members of each cluster before and after, those that stayed, left and came."""
    both = before.select("doc_idx", F.col("cluster_id").alias("b")).join(after.select("doc_idx", F.col("cluster_id").alias("a")), "doc_idx")
    side = both.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("cluster_id"), "a", "b")
    is_a, is_b = F.col("a") == F.col("cluster_id"), F.col("b") == F.col("cluster_id")
    return side.groupBy("cluster_id").agg(
        F.count_if(is_b).alias("size_before"), F.count_if(is_a).alias("size_after"), F.count_if(is_a & is_b).alias("stayed"), F.count_if(is_b & ~is_a).alias("moved_out"), F.count_if(is_a & ~is_b).alias("moved_in")
    )


def canonical_ids(assignment: DataFrame, doc_id: Column) -> DataFrame:
    """(cluster_id, new_cluster_id, min_doc_id, membership_sha1): clusters numbered by smallest member id, then the digest of their sorted ids.

    The digest is over one long string a cluster, which must fit a task; for a
    cluster too large for that, compare minima and counts instead.
    """
    g = assignment.select("cluster_id", doc_id.cast("string").alias("d")).groupBy("cluster_id").agg(
        F.min("d").alias("min_doc_id"), F.sha1(F.concat_ws("\n", F.sort_array(F.collect_list("d")))).alias("membership_sha1")
    )
    w = Window.orderBy("min_doc_id", "membership_sha1", "cluster_id")  # one row a cluster
    return g.withColumn("new_cluster_id", F.row_number().over(w) - 1)


def chunk_signature(assignment: DataFrame) -> DataFrame:
    """(cluster_id, n, first, last, checksum) of the sorted member indices; the checksum is their sum modulo 1e9 + 7."""
    return assignment.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_idx").alias("first"), F.max("doc_idx").alias("last"), (F.sum("doc_idx") % 1_000_000_007).alias("checksum"))


def quality_metrics(docs: DataFrame, assignment: DataFrame, centers: DataFrame, core: int) -> DataFrame:
    """Per cluster: 95 % radius of the core and of all members, their difference, share of the largest source, density of pairs that share 16 simhash bits.

    docs(doc_idx, v, source, simhash).
    """
    m = docs.join(assignment, "doc_idx").join(centers.select("cluster_id", "center"), "cluster_id").select("doc_idx", "cluster_id", "source", "simhash", F.round(l2(F.col("v"), F.col("center")), 9).alias("d"))
    m = Scratch(docs.sparkSession).cut(group_index(m, "cluster_id", "d", "doc_idx"))
    near = at_fraction(F.col("d"), 0.95, F.least(F.col("n"), F.lit(core)))
    radius = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.round(near, 6).alias("core_radius"), F.round(at_fraction(F.col("d"), 0.95, F.col("n")), 6).alias("tail_radius"))
    top = lambda key: m.groupBy("cluster_id", key.alias("k")).agg(F.count(F.lit(1)).alias("c")).groupBy("cluster_id")
    source = top(F.coalesce(F.col("source"), F.lit(""))).agg(F.max("c").alias("top"))
    dup = top(F.shiftrightunsigned("simhash", 48)).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"))
    n = F.col("n")
    return radius.join(source, "cluster_id").join(dup, "cluster_id").select(
        "cluster_id", n, "core_radius", "tail_radius", F.round(F.greatest(F.col("tail_radius") - F.col("core_radius"), F.lit(0.0)), 6).alias("tail_inflation"),
        F.round(F.col("top") / n, 9).alias("source_dominance"), F.round(F.col("pairs") / F.greatest(n * (n - 1) / 2, F.lit(1)), 9).alias("duplicate_density"),
    )


def center_separation(centers: DataFrame) -> DataFrame:
    """One row: sum and mean of the distances between centers (one row a cluster, so the pairs are few)."""
    a, b = centers.select(F.col("cluster_id").alias("i"), F.col("center").alias("x")), centers.select(F.col("cluster_id").alias("j"), F.col("center").alias("y"))
    d = a.join(b, F.col("i") < F.col("j")).select(l2(F.col("x"), F.col("y")).alias("d"))
    return d.agg(F.round(F.coalesce(F.sum("d"), F.lit(0.0)), 6).alias("separation_sum"), F.round(F.coalesce(F.avg("d"), F.lit(0.0)), 6).alias("separation_mean"))


def j_score(metrics: DataFrame, separation: DataFrame) -> DataFrame:
    """One row: the five components, each squashed to [0, 1], and their mean."""
    m = metrics.agg(*(F.avg(c).alias(c) for c in ("core_radius", "tail_inflation", "source_dominance", "duplicate_density")))
    pos = lambda c: F.greatest(F.col(c), F.lit(0.0))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    parts = {
        "j_separation": pos("separation_mean") / (1 + pos("separation_mean")),
        "j_core": 1 / (1 + pos("core_radius")),
        "j_tail": 1 / (1 + pos("tail_inflation")),
        "j_source": 1 - unit("source_dominance"),
        "j_duplicates": 1 - unit("duplicate_density"),
    }
    row = m.crossJoin(separation).select(*(F.round(v, 6).alias(k) for k, v in parts.items()))  # one row each
    return row.withColumn("j", F.round(reduce(Column.__add__, (F.col(k) for k in parts)) / 5, 6))


def best_seed(scores: DataFrame) -> DataFrame:
    """(seed, j, best): the largest score wins, ties by the smaller seed."""
    w = Window.orderBy(F.desc("j"), "seed")
    return scores.withColumn("best", F.row_number().over(w) == 1)


def seed_sweep(docs: DataFrame, k: int, seeds: range, dim: int, core: int) -> DataFrame:
    """Scores of balanced spherical partitions by seed: docs(doc_idx, v, source, simhash), which are computed once."""
    rows, spark, scratch = [], docs.sparkSession, Scratch(docs.sparkSession)
    docs = scratch.cut(docs)
    vectors, capacity = docs.select("doc_idx", "v"), docs.count() // k
    for s, settled in settled_centers(vectors, k, list(seeds), dim).items():
        labels = scratch.cut(vectors.mapInArrow(_labels(settled), "doc_idx long, cluster_id long"))
        start = scratch.cut(centroids(vectors.join(labels, "doc_idx").select("cluster_id", "v"), dim))
        fixed = scratch.cut(capacity_repair(costs(vectors, start), labels, capacity))
        c = scratch.cut(centroids(docs.join(fixed, "doc_idx").select("cluster_id", "v"), dim))
        rows.append((s, j_score(quality_metrics(docs, fixed, c, core), center_separation(c)).first()["j"]))
    return best_seed(spark.createDataFrame(rows, "seed int, j double"))


def assignment_cost(cost: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row: (total, mean) cost of an assignment."""
    own = cost.join(assignment, ["doc_idx", "cluster_id"])
    return own.agg(F.round(F.sum("cost"), 6).alias("total"), F.round(F.avg("cost"), 6).alias("mean"))


def member_lists(assignment: DataFrame) -> DataFrame:
    """(cluster_id, members): the sorted documents of each cluster, which must fit a row: a partition's clusters have a fixed capacity."""
    return assignment.groupBy("cluster_id").agg(F.sort_array(F.collect_list("doc_idx")).alias("members"))


def _swap_metrics(core: int):
    """Metrics of a cluster as it is, and with each of its boundary documents exchanged for each other cluster's."""

    def run(key, own: pa.Table, others: pa.Table) -> pa.Table:
        ids = own.column("doc_idx").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        x = np.array(own.column("v").to_pylist(), float)[order]
        src = np.array([s or "" for s in own.column("source").to_pylist()])[order]
        bits = own.column("simhash").to_numpy()[order] >> 48
        edge = np.flatnonzero(own.column("edge").to_numpy()[order])
        n = len(x)
        total = x.sum(0)

        def measure(rows, sources, marks, total):
            c = total / n
            c = c / max(np.linalg.norm(c), 1e-12)
            d = np.sort(np.round(np.linalg.norm(rows - c, axis=1), 9))
            near, far = np.percentile(d[:core], 95), np.percentile(d, 95)
            top = np.unique(sources, return_counts=True)[1].max()
            k = np.unique(marks, return_counts=True)[1]
            return [near, max(far - near, 0.0), top / n, (k * (k - 1) / 2).sum() / max(n * (n - 1) / 2, 1)], c

        out = [(-1, -1, -1, *measure(x, src, bits, total))]
        ids_b = others.column("o_doc_idx").to_numpy()
        at = np.lexsort((ids_b, others.column("o_cluster_id").to_numpy()))
        names, where, vb = ids_b[at], others.column("o_cluster_id").to_numpy()[at], np.array(others.column("o_v").to_pylist(), float)[at] if len(ids_b) else np.empty((0, x.shape[1]))
        sb, hb = [others.column("o_source").to_pylist()[i] or "" for i in at], others.column("o_simhash").to_numpy()[at] >> 48
        for i in edge:
            for j in range(len(names)):
                rows, sources, marks = x.copy(), src.astype(object), bits.copy()
                rows[i], sources[i], marks[i] = vb[j], sb[j], hb[j]
                out.append((int(where[j]), int(ids[i]), int(names[j]), *measure(rows, sources.astype(str), marks, total - x[i] + vb[j])))
        a = int(own.column("cluster_id")[0].as_py())
        return pa.table(
            {
                "a": pa.array([a] * len(out), pa.int64()), "b": pa.array([o[0] for o in out], pa.int64()), "out": pa.array([o[1] for o in out], pa.int64()), "in": pa.array([o[2] for o in out], pa.int64()),
                "m": pa.array([list(map(float, o[3])) for o in out], pa.list_(pa.float64())), "center": pa.array([o[4].tolist() for o in out], pa.list_(pa.float64())),
            }
        )

    return run


def _score(m: np.ndarray, centers: np.ndarray) -> float:
    """J of clusters' metrics (core radius, tail inflation, source dominance, duplicate density) and centers."""
    i, j = np.triu_indices(len(centers), 1)
    apart = np.linalg.norm(centers[i] - centers[j], axis=1).mean() if len(i) else 0.0
    core, tail, source, dup = m.mean(0)
    return float((apart / (1 + apart) + 1 / (1 + max(core, 0)) + 1 / (1 + max(tail, 0)) + 1 - min(max(source, 0), 1) + 1 - min(max(dup, 0), 1)) / 5)


def refine_by_swaps(docs: DataFrame, assignment: DataFrame, core: int, most_swaps: int, boundary: int = 10, least_gain: float = 1e-9) -> tuple[DataFrame, list[float]]:
    """(assignment, J before and after each swap): exchanges boundary documents of two clusters as long as J gains more than ``least_gain``.

    A swap is sought among the ``boundary`` documents farthest from the center
    of each cluster, and the first in the order of clusters and distances that
    gains is made.  All swaps of a round are measured in one pass, a task a
    cluster (clusters have a fixed capacity); the driver sees their metrics,
    at most boundary^2 * clusters^2 rows.  docs(doc_idx, v, source, simhash).
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.cut(docs.select("doc_idx", "v", "source", "simhash"))
    now, history = scratch.cut(assignment.select("doc_idx", "cluster_id")), []
    while True:
        full = rows.join(now, "doc_idx")
        centers = full.groupBy("cluster_id").agg(mean_vector(F.col("v"), len(rows.select("v").first()["v"])).alias("m")).select("cluster_id", normalize(F.col("m")).alias("center"))
        far = full.join(centers, "cluster_id").withColumn("d", F.round(l2(F.col("v"), F.col("center")), 9))
        w = Window.partitionBy("cluster_id").orderBy(F.desc("d"), "doc_idx")
        marked = scratch.cut(far.withColumn("place", F.row_number().over(w)).withColumn("edge", F.col("place") <= boundary).drop("center"))
        edge = marked.filter("edge").select("doc_idx", "place")
        clusters = marked.select(F.col("cluster_id").alias("to")).distinct()
        far = marked.filter("edge").select(*(F.col(c).alias(f"o_{c}") for c in ("doc_idx", "v", "source", "simhash", "cluster_id")))
        others = scratch.cut(far.join(clusters, F.col("to") != F.col("o_cluster_id")))  # boundary rows a cluster, for each other cluster
        schema = "a long, b long, out long, in long, m array<double>, center array<double>"
        t = marked.select("doc_idx", "v", "source", "simhash", "cluster_id", "edge", F.col("cluster_id").alias("to")).groupBy("to").cogroup(others.groupBy("to")).applyInArrow(_swap_metrics(core), schema).toArrow().to_pandas()
        base = t[t["b"] < 0].sort_values("a")
        names = base["a"].tolist()
        at = {c: i for i, c in enumerate(names)}
        m, c = np.array(base["m"].tolist()), np.array(base["center"].tolist())
        best = _score(m, c)
        history.append(best)
        if len(history) > most_swaps:
            return now, history
        place = {r["doc_idx"]: r["place"] for r in edge.select("doc_idx", "place").collect()}
        moves = t[t["b"] >= 0]
        half = {(a, o, i): (x, y) for a, o, i, x, y in zip(*(moves[n] for n in ("a", "out", "in", "m", "center")))}
        pairs = sorted(((a, b, place[o], place[i], o, i) for a, b, o, i in zip(moves["a"], moves["b"], moves["out"], moves["in"]) if a < b))
        found = None
        for a, b, _, _, o, i in pairs:
            mm, cc = m.copy(), c.copy()
            (mm[at[a]], cc[at[a]]), (mm[at[b]], cc[at[b]]) = half[a, o, i], half[b, i, o]
            if _score(mm, cc) > best + least_gain:
                found = (a, b, o, i)
                break
        if found is None:
            return now, history
        a, b, o, i = found
        now = scratch.cut(now.withColumn("cluster_id", F.when(F.col("doc_idx") == int(o), F.lit(int(b))).when(F.col("doc_idx") == int(i), F.lit(int(a))).otherwise(F.col("cluster_id")).cast(now.schema["cluster_id"].dataType)))


def covered_r_max(routed: DataFrame, near: DataFrame, truth: DataFrame, eval_k: int, per_cluster: bool = False) -> DataFrame:
    """Ideal r_max of each anchor: tan(max((theta_b - theta_gt) / 2, 0)) if the routed clusters cover its exact neighbours, else 0.

    routed(query_id, cluster_id), near(query_id, cluster_id, doc_idx, theta)
    (the fixed_k nearest in each routed cluster), truth(query_id, doc_idx,
    theta) (the exact eval_k).  theta_b is the largest angle among ``near``.
    """
    keys = ["query_id", "cluster_id"] if per_cluster else ["query_id"]
    edge = near.groupBy(*keys).agg(F.max("theta").alias("edge"))
    hit = near.select(*keys, "doc_idx").distinct().join(truth.select("query_id", "doc_idx"), ["query_id", "doc_idx"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
    worst = truth.groupBy("query_id").agg(F.max("theta").alias("worst"), F.count(F.lit(1)).alias("n"))
    base = routed.select(*keys).distinct().join(edge, keys, "left").join(hit, keys, "left").join(worst, "query_id")
    full = F.coalesce("hits", F.lit(0)) == F.col("n")
    r = F.tan(F.greatest((F.col("edge") - F.col("worst")) / 2, F.lit(0.0)))
    return base.select(*keys, (F.coalesce("hits", F.lit(0)) / F.lit(eval_k)).alias("coverage"), full.alias("covered"), F.round(F.when(full, r).otherwise(0.0), 9).alias("ideal_r_max"))


def r_max_surrogate(routed: DataFrame, ideal: DataFrame, clusters: DataFrame, gamma: float = 0.10, tau: float = 24.0, least_blend: float = 0.15, shrink: bool = True, normal_min: int | None = None, soft_min: int = 0, soft_scale: float = 0.5, hard_value: float = 0.0) -> DataFrame:
    """(cluster_id, anchors, raw, r_max): the gamma-quantile of the ideal r_max of the anchors routed to each cluster, shrunk to the overall quantile.

    A cluster without anchors takes the overall quantile.  With ``normal_min``,
    clusters of fewer anchors are scaled by ``soft_scale``, and those of fewer
    than ``soft_min`` take ``hard_value``.
    """
    on = ["query_id", "cluster_id"] if "cluster_id" in ideal.columns else ["query_id"]
    vals = routed.select("query_id", "cluster_id").join(ideal, on).select("cluster_id", "ideal_r_max")
    overall = vals.agg(F.coalesce(F.percentile("ideal_r_max", F.lit(gamma)), F.lit(0.0)).alias("g"))
    per = vals.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("anchors"), F.percentile("ideal_r_max", F.lit(gamma)).alias("q"))
    t = clusters.select("cluster_id").join(per, "cluster_id", "left").crossJoin(overall)  # one row
    n = F.coalesce("anchors", F.lit(0))
    raw = F.coalesce("q", "g")
    blend = F.greatest(F.lit(least_blend), n / (n + tau)) if shrink else F.lit(1.0)
    value = F.greatest(blend * raw + (1 - blend) * F.col("g"), F.lit(0.0))
    if normal_min is not None:
        value = F.when(n < soft_min, hard_value).when(n < normal_min, value * soft_scale).otherwise(value)
    return t.select("cluster_id", n.alias("anchors"), F.round(raw, 9).alias("raw"), F.round(value, 9).alias("r_max"))


def sequential_partition(docs: DataFrame, capacity: int, r_max: float) -> DataFrame:
    """(doc_idx, cluster_id, r_max): documents cut into runs of ``capacity`` by index, with one radius."""
    return docs.select("doc_idx", F.floor(F.col("doc_idx") / capacity).alias("cluster_id"), F.lit(r_max).alias("r_max"))


def contract_violations(docs: DataFrame, assignment: DataFrame, clusters: DataFrame, capacity: int | None = None) -> DataFrame:
    """(rule, cluster_id, detail): what is wrong with a partition; empty if nothing is."""
    n = assignment.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    row = lambda df, rule, detail: df.select(F.lit(rule).alias("rule"), F.col("cluster_id").cast("long").alias("cluster_id"), detail.cast("string").alias("detail"))
    parts = [
        row(docs.join(assignment, "doc_idx", "left_anti").withColumn("cluster_id", F.lit(None)), "unassigned", F.col("doc_idx")),
        row(assignment.groupBy("doc_idx").agg(F.count(F.lit(1)).alias("n"), F.min("cluster_id").alias("cluster_id")).filter("n > 1"), "assigned_twice", F.col("doc_idx")),
        row(assignment.join(docs, "doc_idx", "left_anti"), "unknown_doc", F.col("doc_idx")),
        row(clusters.join(n, "cluster_id", "left_anti"), "empty_cluster", F.lit("0")),
        row(clusters.filter("r_k is null or r_fixed is null or r_max is null or r_max < 0"), "bad_radius", F.col("r_max")),
        row(clusters.filter("r_fixed < r_k"), "radii_out_of_order", F.col("r_fixed")),
    ]
    if capacity is not None:
        parts.append(row(n.filter(F.col("n") != capacity), "wrong_size", F.col("n")))
    return reduce(DataFrame.unionByName, parts)


