"""The k most similar vectors of each query, by randomly rotated one-bit codes.

A unit vector o is rotated and kept as the signs of its D coordinates, packed
in D/8 bytes, and one correction scalar s = <x, R o>, where x is the sign
vector over sqrt(D).  For a rotated unit query y, <x, y> / s estimates the
cosine without bias, with an error of at most
error * sqrt((1 - s^2) / s^2 / (D - 1)) but for a vanishing share.  <x, y> is
read off the packed bytes: a query has a table of the 256 sums of each byte, so
an estimate takes D/8 additions.  Vectors whose upper bound reaches the k-th
best cosine known so far are reranked by their exact cosine.

Two ways lead from the queries to the vectors.  ``most_similar`` holds a query
set against all rows and misses nothing: vectors are never shuffled, the
queries go to them in blocks of fixed size, one pass a block, and each partition
returns at most k rows a query.  There every pair is met, and products of
blocks of the vectors themselves are faster than sums read off the codes, so no
codes are used.  ``routed_similar`` serves a query set that is itself large:
codes lie in lists by their nearest center, long lists in parts, and a query is
sent to the parts of its nearest lists only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions.arrow_vectors import flat, list_column, take, usable
from vectrine.llm.kmeans import bounded_sample, mini_batch_kmeans
from vectrine.plans.materialize import Scratch


@dataclass(frozen=True)
class BitCodeConfig:
    """``query_block`` queries (4 * dim bytes each) are broadcast at a time: 32 MB at 64 dimensions.

    Routed queries visit ``probes`` of about sqrt(rows) lists, ``most_lists``
    at most; a part of a list has about ``part_rows`` codes.
    """

    dim: int = 64
    k: int = 5
    error: float = 3.0
    query_block: int = 131072
    sample_rows: int = 8192
    most_lists: int = 4096
    probes: int = 48
    part_rows: int = 65536
    #: Decimals that decide whether two cosines are equal.
    decimals: int = 12
    seed: int = 42


#: Queries of a table of sums; twice as many codes meet them at a time, so that what is added up stays in the cache.
BLOCK = 256


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalars of unit vectors."""
    x = unit @ rot.T.astype(np.float32)
    return np.packbits(x > 0, axis=1), np.abs(x).sum(1) / np.sqrt(unit.shape[1])


def byte_tables(y: np.ndarray) -> np.ndarray:
    """By byte of the code, its value, and query: the sum of the rotated queries' (rows of ``y``) coordinates with the signs of that byte, over sqrt(D)."""
    n, dim = y.shape
    padded = np.zeros((n, -(-dim // 8) * 8), np.float32)
    padded[:, :dim] = y / np.float32(np.sqrt(dim))
    sign = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1
    return np.einsum("bs,qjs->jbq", sign, padded.reshape(n, -1, 8), optimize=True).astype(np.float32)


def estimates(codes: np.ndarray, tables: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """<x, y> of each code with each query, added to ``start``."""
    out = np.zeros((len(codes), tables.shape[2]), np.float32) if start is None else start
    held = np.empty_like(out)
    for table, byte in zip(tables, codes.T):
        table.take(byte, axis=0, out=held, mode="clip")  # without bounds to check, nothing is buffered
        out += held
    return out


def exact_cosines(m: np.ndarray, norms: np.ndarray, q: np.ndarray, qn: np.ndarray) -> np.ndarray:
    """Cosines of row pairs, each computed alike wherever its rows stand."""
    return np.einsum("ij,ij->i", m.astype(np.float64), q.astype(np.float64)) / (norms * qn)


class Best:
    """The k best different vectors of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.q = self.i = np.empty(0, np.int64)
        self.c = np.empty(0)
        self.kth = np.full(queries, -2.0)

    def add(self, q: np.ndarray, i: np.ndarray, c: np.ndarray) -> None:
        if len(q) == 0:
            return
        q, i, c = np.concatenate([self.q, q]), np.concatenate([self.i, i]), np.concatenate([self.c, c])
        order = np.lexsort((i, -c, q))
        q, i, c = q[order], i[order], c[order]
        # a redelivered row has the same cosine, so its repeats are neighbours
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
        q, i, c = q[new], i[new], c[new]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate([start, [len(q)]])))
        keep = rank < self.k
        self.q, self.i, self.c = q[keep], i[keep], c[keep]
        full = rank == self.k - 1
        self.kth[q[full]] = c[full]


class _Search:
    """A set of queries and the best vectors they have met."""

    def __init__(self, cfg: BitCodeConfig, ids: np.ndarray, raw: np.ndarray, norm: np.ndarray, floor: np.ndarray):
        self.cfg, self.ids, self.raw, self.norm, self.floor = cfg, ids, raw, norm, floor
        self.unit = (raw / norm[:, None]).astype(np.float32)
        y = self.unit @ rotation(cfg.dim, cfg.seed).T.astype(np.float32)
        self.tables = [byte_tables(y[a : a + BLOCK]) for a in range(0, len(y), BLOCK)]
        self.best = Best(len(raw), cfg.k)

    def meet(self, ids: np.ndarray, m: np.ndarray, norms: np.ndarray, codes: np.ndarray, s: np.ndarray) -> None:
        cfg = self.cfg
        s = s.astype(np.float32)
        unit = (m / norms[:, None]).astype(np.float32)
        slack = (cfg.error * np.sqrt(np.maximum(0, 1 - s * s) / (cfg.dim - 1)) + 1e-5).astype(np.float32)
        for lo in range(0, len(m), 4096):
            low = np.maximum(self.best.kth, self.floor) - 10.0**-cfg.decimals
            least = -low.astype(np.float32)
            found = [], [], []
            for a in range(lo, min(lo + 4096, len(m)), 2 * BLOCK):
                part = slice(a, min(a + 2 * BLOCK, lo + 4096))
                for n, table in enumerate(self.tables):
                    ql = n * BLOCK
                    # estimate + error >= the k-th best
                    above = estimates(codes[part], table, np.multiply.outer(s[part], least[ql : ql + BLOCK])) >= -slack[part, None]
                    d, q = np.divmod(np.flatnonzero(above), above.shape[1])
                    d, q = d + a, q + ql
                    good = np.einsum("ij,ij->i", unit[d], self.unit[q]) >= low[q] - 1e-5
                    d, q = d[good], q[good]
                    for to, what in zip(found, (q, ids[d], np.round(exact_cosines(m[d], norms[d], self.raw[q], self.norm[q]), cfg.decimals))):
                        to.append(what)
            self.best.add(*map(np.concatenate, found))

    def found(self) -> pa.RecordBatch:
        b = self.best
        return pa.record_batch([pa.array(self.ids[b.q], pa.int64()), pa.array(b.i, pa.int64()), pa.array(b.c, pa.float64())], ["query", "neighbour", "cosine"])


#: Vectors and queries whose products are formed at a time; they stay in the cache.
TILE = 512, 512

#: One of so many rows is searched first, where rows are many.
SHARE = 16

_HITS = "query long, neighbour long, cosine double"


def _packed(codes: np.ndarray) -> pa.Array:
    n, width = codes.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(codes).tobytes())])


def _unpacked(col) -> np.ndarray:
    arr = flat(col)
    off = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1]
    return np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(len(arr), -1)


def _encode(cfg: BitCodeConfig, centers: np.ndarray, parts: np.ndarray):
    """(id, vector, code, scalar, part of a list) of each usable vector."""

    def run(batches):
        rot = rotation(cfg.dim, cfg.seed)
        for b in batches:
            rows, m, norms = usable(b.column(1), cfg.dim)
            if len(rows) == 0:
                continue
            unit = (m / norms[:, None]).astype(np.float32)
            codes, s = encode(unit, rot)
            ids = take(b.column(0), rows)
            own = (unit @ centers.T).argmax(1)
            h = (ids.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = (np.cumsum(parts) - parts)[own] + (h % parts[own].astype(np.uint64)).astype(np.int64)
            yield pa.record_batch([ids, take(b.column(1), rows), _packed(codes), pa.array(s.astype(np.float32)), pa.array(part)], ["id", "v", "code", "s", "part"])

    return run


class _Dense:
    """A set of queries and the best vectors they have met, by products of blocks; nothing that reaches the k-th best is passed over."""

    def __init__(self, cfg: BitCodeConfig, ids: np.ndarray, raw: np.ndarray, norm: np.ndarray, floor: np.ndarray):
        self.cfg, self.ids, self.raw, self.norm, self.floor = cfg, ids, raw, norm, floor
        self.unit = (raw / norm[:, None]).astype(np.float32)
        self.best = Best(len(raw), cfg.k)
        self.found, self.waiting = [], 0
        self.held, self.above = np.empty(TILE[0] * TILE[1], np.float32), np.zeros(TILE[0] * TILE[1], bool)
        self._raise()

    def _raise(self) -> None:
        self.low = (np.maximum(self.best.kth, self.floor) - 10.0**-self.cfg.decimals - 1e-5).astype(np.float32)

    def _settle(self) -> None:
        if self.waiting:
            self.best.add(*map(np.concatenate, zip(*self.found)))
            self.found, self.waiting = [], 0
            self._raise()

    def _reached(self, x: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``x`` and queries, from ``lo`` on, of the pairs that reach what is low."""
        y = self.unit[lo : lo + TILE[1]]
        n = len(x) * len(y)
        s = np.matmul(x, y.T, out=self.held[:n].reshape(len(x), len(y)))
        np.greater_equal(s, self.low[lo : lo + TILE[1]], out=self.above[:n].reshape(s.shape))
        self.above[n:] = False
        some = np.flatnonzero(self.above.view(np.uint64))  # few are, so eight at a time
        of, bit = np.nonzero(self.above.reshape(-1, 8)[some])
        d, q = np.divmod(some[of] * 8 + bit, len(y))
        return d, q + lo

    def meet(self, ids: np.ndarray, m: np.ndarray, norms: np.ndarray) -> None:
        unit = (m / norms[:, None]).astype(np.float32)
        pairs, n = [], 0
        for a in range(0, len(m), TILE[0]):
            for lo in range(0, len(self.unit), TILE[1]):
                d, q = self._reached(unit[a : a + TILE[0]], lo)
                if len(d):
                    pairs.append((d + a, q))
                    n += len(d)
                if n >= 1 << 15:
                    self._weigh(ids, m, norms, pairs)
                    pairs, n = [], 0
        self._weigh(ids, m, norms, pairs)

    def _weigh(self, ids: np.ndarray, m: np.ndarray, norms: np.ndarray, pairs: list) -> None:
        if not pairs:
            return
        ds, qs = map(np.concatenate, zip(*pairs))
        for lo in range(0, len(ds), 1 << 15):
            d, q = ds[lo : lo + (1 << 15)], qs[lo : lo + (1 << 15)]
            self.found.append((q, ids[d], np.round(exact_cosines(m[d], norms[d], self.raw[q], self.norm[q]), self.cfg.decimals)))
        self.waiting += len(ds)
        # sorting costs as much as the best that are kept, so hits wait until they are as many
        if self.waiting >= max(1 << 15, len(self.best.q)):
            self._settle()

    def hits(self) -> pa.RecordBatch:
        self._settle()
        b = self.best
        return pa.record_batch([pa.array(self.ids[b.q], pa.int64()), pa.array(b.i, pa.int64()), pa.array(b.c, pa.float64())], ["query", "neighbour", "cosine"])


def _scan(cfg: BitCodeConfig, block):
    def run(batches):
        search = None
        for b in batches:
            rows, m, norms = usable(b.column(1), cfg.dim)
            if len(rows):
                search = search or _Dense(cfg, *block.value)
                search.meet(b.column(0).to_numpy()[rows], m, norms)
        if search:
            yield search.hits()

    return run


def _floor(ids: np.ndarray, sample: np.ndarray, unit: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each query's k-th best cosine: that within the sample."""
    out = np.full(len(unit), -2.0)
    if len(ids) >= k:
        for lo in range(0, len(unit), 2048):
            s = unit[lo : lo + 2048] @ sample.T
            out[lo : lo + 2048] = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] - 1e-5
    return out


def _rows(df: DataFrame, record: Column, vector: Column) -> DataFrame:
    return df.select(record.cast("long").alias("id"), vector.alias("v")).filter("id is not null and v is not null")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    # each partition gives its k best, so repeats of an id from two partitions go first
    return hits.dropDuplicates(["query", "neighbour"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "rank", "neighbour", "cosine")


def most_similar(
    docs: DataFrame, doc: Column, vector: Column, queries: DataFrame, query: Column, query_vector: Column, cfg: BitCodeConfig = BitCodeConfig()
) -> DataFrame:
    """(query, rank, neighbour, cosine): the ``cfg.k`` different vectors of highest cosine for each query, among all vectors.

    Of cosines that agree in ``cfg.decimals`` decimals the smaller id goes
    first.  Vectors and queries that are null, all zero, of the wrong length or
    not finite take no part, nor do rows without an id; a repeated id counts
    once.  A query with fewer than k vectors gets all of them.  Empty tables
    give an empty result.
    """
    spark = docs.sparkSession
    rows, asked = _rows(docs, doc, vector), _rows(queries, query, query_vector)
    ids, sample, total = bounded_sample(rows, F.col("id"), F.col("v"), cfg.dim, cfg.sample_rows)
    blocks = max(1, -(-asked.count() // (cfg.query_block * 3 // 4)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    if blocks > 1:  # read once, whatever the number of passes
        rows = Scratch(spark).cut(rows)
    out = None
    for n in range(blocks):
        t = asked.filter(F.col("block") == n).select("id", "v").toArrow()
        at, raw, norm = usable(t.column("v"), cfg.dim)
        qid, first = np.unique(t.column("id").to_numpy()[at], return_index=True)
        raw, norm = raw[first], norm[first]
        if len(qid) == 0:
            continue
        floor = _floor(ids, sample, (raw / norm[:, None]).astype(np.float32), cfg.k)
        if total > cfg.sample_rows * SHARE * 4:
            # each partition returns what reaches the floor, which the k best of a share of all rows raise
            share = rows.filter(F.pmod(F.xxhash64("id"), F.lit(SHARE)) == 0).coalesce(max(1, spark.sparkContext.defaultParallelism * 2))
            block = spark.sparkContext.broadcast((qid, raw, norm, floor))
            t = _ranked(share.mapInArrow(_scan(cfg, block), _HITS), cfg.k).filter(F.col("rank") == cfg.k).select("query", "cosine").toArrow()
            block.unpersist()
            of = np.searchsorted(qid, t.column("query").to_numpy())
            floor[of] = np.maximum(floor[of], t.column("cosine").to_numpy())
        block = spark.sparkContext.broadcast((qid, raw, norm, floor))
        top = _ranked(rows.mapInArrow(_scan(cfg, block), _HITS), cfg.k)
        out = top if out is None else out.unionByName(top)
    return out if out is not None else spark.createDataFrame([], "query long, rank int, neighbour long, cosine double")


def _route(cfg: BitCodeConfig, centers: np.ndarray, parts: np.ndarray):
    """Each query with the parts of its nearest lists."""
    first = np.cumsum(parts) - parts

    def run(batches):
        for b in batches:
            rows, m, norms = usable(b.column(1), cfg.dim)
            if len(rows) == 0:
                continue
            s = (m / norms[:, None]).astype(np.float32) @ centers.T
            n = min(cfg.probes, len(centers))
            near = np.argpartition(-s, n - 1, axis=1)[:, :n]
            count = parts[near].sum(1)
            lists = near.ravel()
            place = np.arange(count.sum()) - np.repeat(np.cumsum(parts[lists]) - parts[lists], parts[lists])
            targets = np.repeat(first[lists], parts[lists]) + place
            yield pa.record_batch([take(b.column(0), rows), take(b.column(1), rows), list_column(targets, count, pa.int64())], ["id", "v", "parts"])

    return run


def _visit(cfg: BitCodeConfig):
    def run(key, codes: pa.Table, asked: pa.Table) -> pa.Table:
        if codes.num_rows == 0 or asked.num_rows == 0:
            return pa.table({"query": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        at, raw, norm = usable(asked.column("v"), cfg.dim)
        qid, first = np.unique(asked.column("id").to_numpy()[at], return_index=True)
        search = _Search(cfg, qid, raw[first], norm[first], np.full(len(qid), -2.0))
        _, m, norms = usable(codes.column("v"), cfg.dim)
        search.meet(codes.column("id").to_numpy(), m, norms, _unpacked(codes.column("code")), codes.column("s").to_numpy())
        return pa.Table.from_batches([search.found()])

    return run


def routed_similar(
    docs: DataFrame, doc: Column, vector: Column, queries: DataFrame, query: Column, query_vector: Column, cfg: BitCodeConfig = BitCodeConfig()
) -> DataFrame:
    """(query, rank, neighbour, cosine): as ``most_similar``, among the vectors of the query's ``cfg.probes`` nearest lists.

    The centers are fitted on a bounded sample (``cfg.sample_rows``); every row
    is then in a list.  Neither rows nor queries pass through the driver.  What
    a query's other lists hold is not seen, so a neighbour may be missed; a
    test measures the recall.
    """
    rows, asked = _rows(docs, doc, vector), _rows(queries, query, query_vector)
    _, sample, total = bounded_sample(rows, F.col("id"), F.col("v"), cfg.dim, cfg.sample_rows)
    if len(sample) == 0:
        return docs.sparkSession.createDataFrame([], "query long, rank int, neighbour long, cosine double")
    centers = mini_batch_kmeans(sample, int(min(cfg.most_lists, max(1, np.sqrt(total)))), cfg.seed)
    share = np.bincount((sample @ centers.T).argmax(1), minlength=len(centers)) / len(sample)
    parts = np.maximum(1, np.ceil(share * total / cfg.part_rows)).astype(np.int64)
    kind = rows.schema["v"].dataType.simpleString()
    codes = rows.mapInArrow(_encode(cfg, centers, parts), f"id long, v {kind}, code binary, s float, part long")
    sent = asked.mapInArrow(_route(cfg, centers, parts), f"id long, v {asked.schema['v'].dataType.simpleString()}, parts array<long>").select("id", "v", F.explode("parts").alias("part"))
    return _ranked(codes.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(_visit(cfg), _HITS), cfg.k)
