"""Near-duplicate records with small edits.

Method: min-max hashing.  Each permutation of the shingle hashes is evaluated
once and gives two signature values, its minimum and its maximum.  The values
are banded; records that share a band are candidates, and every candidate pair
is checked by the exact Jaccard similarity of its shingle sets.

Records with equal shingle sets are one class, and only the class's smallest id
takes part in banding, so a text that a third of all rows repeat is hashed into
its bands once.  The two lists that are small in ordinary data (records that
repeat another one, and records that are in a candidate pair) are counted, and
broadcast only if their size allows.

Bands miss a pair at the least similarity with a small probability.  With
``exact``, the pairs of a prefix filter are checked too, which loses none: of
two similar sets, the rarest shingles of one and of the other share one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions.arrow_vectors import flat, list_column, take
from vectrine.llm.text import U64, mix, shingles, slices, words
from vectrine.plans.materialize import Scratch, sized


#: Rows of bands that a partition of their join holds, about.
PARTITION_ROWS = 1 << 19


@dataclass(frozen=True)
class NearDuplicateConfig:
    """``width`` words a shingle; records of fewer than ``least_words`` are left out.

    A pair of similarity s shares a band with probability
    1 - (1 - s ** band_rows) ** bands: at the defaults 0.996 for s = 0.6 and
    0.9999 for s = 0.7.
    """

    width: int = 5
    least_words: int = 5
    similarity: float = 0.8
    bands: int = 40
    band_rows: int = 4
    #: Lose no pair, at the cost of a join of about (1 - similarity) of all shingles.
    exact: bool = False
    seed: int = 42

    @property
    def permutations(self) -> int:
        return -(-self.bands * self.band_rows // 2)


def _batch_texts(batch: pa.RecordBatch) -> list[str | None]:
    return flat(batch.column(1)).to_pylist()


def _class_keys(cfg: NearDuplicateConfig):
    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 1)):
            h, counts = words(_batch_texts(b))
            owner, s, rows = shingles(h, counts, cfg.width, cfg.least_words)
            if len(rows) == 0:
                continue
            at = np.searchsorted(owner, rows)
            with np.errstate(over="ignore"):
                a, c = np.add.reduceat(s, at), np.add.reduceat(mix(s ^ U64(0x5851F42D4C957F2D)), at)
            yield pa.record_batch([take(b.column(0), rows), pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], ["id", "k1", "k2"])

    return run


def min_max(shingle: np.ndarray, at: np.ndarray, permutations: int, seed: int) -> np.ndarray:
    """Minimum and maximum of each permutation over each run of shingles: one row a run, two columns a permutation."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 1 << 63, permutations, dtype=np.uint64) * U64(2) + U64(1)
    flip = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
    out = np.empty((len(at), 2 * permutations), np.uint64)
    with np.errstate(over="ignore"):
        for p in range(permutations):
            y = (shingle ^ flip[p]) * mult[p]
            y ^= y >> U64(32)
            out[:, 2 * p] = np.minimum.reduceat(y, at)
            out[:, 2 * p + 1] = np.maximum.reduceat(y, at)
    return out


def _band_keys(cfg: NearDuplicateConfig):
    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 1)):
            h, counts = words(_batch_texts(b))
            owner, s, rows = shingles(h, counts, cfg.width, cfg.least_words)
            if len(rows) == 0:
                continue
            sig = min_max(s, np.searchsorted(owner, rows), cfg.permutations, cfg.seed)
            keys = np.empty((len(rows), cfg.bands), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(cfg.bands):
                    x = np.full(len(rows), k + 1, np.uint64)
                    for j in range(cfg.band_rows):
                        x = mix(x * U64(3) + sig[:, k * cfg.band_rows + j])
                    keys[:, k] = x
            yield pa.record_batch([take(b.column(0), rows), list_column(keys.view(np.int64).ravel(), np.full(len(rows), cfg.bands), pa.int64())], ["id", "keys"])

    return run


def _shingle_rows(cfg: NearDuplicateConfig):
    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 1)):
            owner, s, rows = shingles(*words(_batch_texts(b)), cfg.width, cfg.least_words)
            if len(rows):
                n = np.bincount(owner)[owner]
                yield pa.record_batch([take(b.column(0), owner), pa.array(n), pa.array(s.view(np.int64))], ["id", "n", "s"])

    return run


def _prefix_pairs(texts: DataFrame, cfg: NearDuplicateConfig, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of records of which the rarest shingles share one."""
    rows = scratch.cut(texts.mapInArrow(_shingle_rows(cfg), "id long, n long, s long"))
    rarest = Window.partitionBy("id").orderBy("count", "s")
    place = rows.join(rows.groupBy("s").count(), "s").withColumn("r", F.row_number().over(rarest))
    pre = scratch.cut(place.filter(F.col("r") <= F.col("n") - F.ceil(cfg.similarity * F.col("n") - 1e-9) + 1).select("id", "n", "s"))
    left, right = pre.select(F.col("id").alias("a"), F.col("n").alias("x"), "s"), pre.select(F.col("id").alias("b"), F.col("n").alias("y"), "s")
    return left.hint("merge").join(right, "s").filter((F.col("a") < F.col("b")) & (F.least("x", "y") >= cfg.similarity * F.greatest("x", "y") - 1e-9)).select("a", "b")


def _check(cfg: NearDuplicateConfig):
    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 2, 3)):
            n = b.num_rows
            both = flat(b.column(2)).to_pylist() + flat(b.column(3)).to_pylist()
            h, counts = words(both)
            owner, s, _ = shingles(h, counts, cfg.width, cfg.least_words)
            size = np.bincount(owner, minlength=2 * n)
            pair = owner % n
            order = np.lexsort((s, pair))
            p, v = pair[order], s[order]
            shared = np.bincount(p[1:][(p[1:] == p[:-1]) & (v[1:] == v[:-1])], minlength=n)
            union = size[:n] + size[n:] - shared
            jac = shared / np.maximum(union, 1)
            # compared as integers would be: similarity * union, without a division's error
            good = np.flatnonzero((shared >= cfg.similarity * union - 1e-9) & (union > 0))
            yield pa.record_batch([take(b.column(0), good), take(b.column(1), good), pa.array(jac[good])], ["a", "b", "similarity"])

    return run


@dataclass
class NearDuplicates:
    """``members``: (id, representative) of every record that takes part;
    ``pairs``: (a, b, similarity) of representatives, a < b."""

    members: DataFrame
    pairs: DataFrame

    def expanded(self) -> DataFrame:
        """(a, b) for all pairs of records: pairs of representatives with all their members, and pairs within classes."""
        m = self.members
        left = m.select(F.col("id").alias("ia"), F.col("representative").alias("a"))
        right = m.select(F.col("id").alias("ib"), F.col("representative").alias("b"))
        across = self.pairs.select("a", "b").join(left, "a").join(right, "b").select("ia", "ib")
        # only classes with a second member have pairs within
        again = m.filter("id <> representative").select(F.col("representative").alias("a")).distinct()
        within = left.join(again, "a", "left_semi").join(right, F.col("a") == F.col("b")).filter("ia < ib").select("ia", "ib")
        return across.unionByName(within).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))

    def links(self) -> DataFrame:
        """(id, class_id, links): one row a record; links counts the other records it is similar to, through no third one."""
        size = self.members.groupBy("representative").agg(F.count(F.lit(1)).alias("n"))
        both = self.pairs.select(F.col("a").alias("representative"), F.col("b").alias("other")).unionByName(
            self.pairs.select(F.col("b").alias("representative"), F.col("a").alias("other"))
        )
        others = both.join(size.withColumnsRenamed({"representative": "other", "n": "m"}), "other").groupBy("representative").agg(F.sum("m").alias("m"))
        return (
            self.members.join(size, "representative")
            .join(others, "representative", "left")
            .select("id", F.col("representative").alias("class_id"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"))
        )


def near_duplicates(df: DataFrame, record: Column, text: Column, cfg: NearDuplicateConfig = NearDuplicateConfig()) -> NearDuplicates:
    """Pairs of records whose sets of word shingles have a Jaccard similarity of at least ``cfg.similarity``.

    Words are runs of ``[a-z0-9]`` in the lower-cased text.  Null, empty and
    short texts take no part, nor do rows without an id.  Rows that repeat an
    id with the same text count once.  An id names one text; of an id with
    several, each is banded and one of them is compared, and it is never paired
    with itself.  An empty table gives empty results.  Texts are processed
    whole, however long.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(record.cast("long").alias("id"), text.alias("text")).filter("id is not null and text is not null")
    keyed = scratch.cut(rows.mapInArrow(_class_keys(cfg), "id long, k1 long, k2 long").dropDuplicates(["id", "k1", "k2"]))
    classes = keyed.groupBy("k1", "k2").agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("n"))
    repeated = scratch.cut(keyed.join(classes.filter("n > 1"), ["k1", "k2"]).filter("id <> representative").select("id", "representative"))
    again = repeated.count()
    distinct = rows.join(sized(repeated.select("id").distinct(), again), "id", "left_anti")
    band_rows = distinct.mapInArrow(_band_keys(cfg), "id long, keys array<long>").select("id", F.explode("keys").alias("key"))
    one, two = band_rows.select(F.col("id").alias("a"), "key"), band_rows.select(F.col("id").alias("b"), "key")
    # a sort-merge join: a hot band is split between tasks by adaptive execution, no task gathers it
    candidates = one.hint("merge").join(two, "key").filter("a < b").select("a", "b")
    if cfg.exact:
        candidates = candidates.unionByName(_prefix_pairs(distinct.dropDuplicates(["id"]), cfg, scratch))
    candidates = scratch.cut(candidates.distinct(), partitions=-(-(keyed.count() - again) * cfg.bands // PARTITION_ROWS))
    touched = scratch.cut(candidates.select(F.col("a").alias("id")).unionByName(candidates.select(F.col("b").alias("id"))).distinct())
    texts = rows.join(sized(touched, touched.count()), "id", "left_semi").dropDuplicates(["id"])
    pairs = (
        candidates.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
        .mapInArrow(_check(cfg), "a long, b long, similarity double")
    )
    members = keyed.select("id").join(repeated, "id", "left").select("id", F.coalesce("representative", "id").alias("representative"))
    return NearDuplicates(members, scratch.cut(pairs))
