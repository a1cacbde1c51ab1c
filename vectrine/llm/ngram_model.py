"""A modified Kneser-Ney model of token n-grams, counted by Spark over a whole corpus.

Every order from 5 to 1 is used: the highest by its counts, the lower ones by
the number of different tokens that precede them, each interpolated with the
next by the three discounts of its order, and order 1 with the same chance for
every token.  Each language has a model of its own, and the discounts are those
of the whole language.

The n-grams meet in buckets by the token before the last, so a bucket holds all
that orders 5 to 2 need of its n-grams; a token with more n-grams than a bucket
should hold is split by the token before it, and its order 2 is added up over
the buckets.  A bucket is kept as sorted arrays in one row.  What the buckets
can't know (order 1, and order 2 of split tokens) is a table of its own: an
n-gram's probability is ``alpha + beta * low``, with ``low`` from that table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.functions.arrow_vectors import flat, take
from vectrine.llm.text import U64, collapse, mix, slices, span_hashes
from vectrine.plans.materialize import Scratch

ORDER = 5
#: n-grams of the model that a partition of its join holds at most, about: tens of MB.
HASHED_ROWS = 1 << 20
#: Rows of the table of low orders up to which it is broadcast (16 bytes each); beyond, it is joined.
BROADCAST_ROWS = 1 << 21
#: Bytes of text that a worker takes apart at a time; it holds some hundred times as much.
SLICE = 1 << 18
_HALF = U64(0xFFFFFFFF)
_UP = U64(32)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0 for white space and controls, 1 for what makes up words, 2 for ideographs and kana, 3 for the rest, of the first 65,536 characters."""
    t = np.full(1 << 16, 3, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isspace() or c < 32:
            t[c] = 0
        elif ch.isalnum() or 0x300 <= c < 0x370:
            t[c] = 1
    for a, b in ((0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00)):
        t[a:b] = 2
    return t


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all tokens and the number of tokens of each text: pieces of words of up to 8 characters, single ideographs and signs."""
    data = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    kind = np.full(len(data), 3, np.uint8)
    low = data < (1 << 16)
    kind[low] = _kinds()[data[low]]
    at = np.arange(len(data))
    fresh = np.ones(len(data), bool)
    fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] != 1)
    run = np.maximum.accumulate(np.where(fresh, at, 0))
    begin = (kind != 0) & (fresh | ((kind == 1) & ((at - run) % 8 == 0)))
    start = np.flatnonzero(begin)
    stop = np.empty_like(start)
    if len(start):
        stop[:-1], stop[-1] = start[1:], len(data)
        # a token ends before white space: of a word piece, count its characters up to the next start
        word = kind[start] == 1
        inside = np.concatenate([[0], np.cumsum(kind == 1)])
        stop = np.where(word, start + inside[stop] - inside[start], start + 1)
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    return (span_hashes(data, start, stop) >> _UP).astype(np.uint64), counts


def grams(texts: list[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, tokens 1 and 2, tokens 3 and 4, model and token 5) of the n-gram that ends at each token; texts begin with four marks."""
    t, counts = tokens(texts)
    pad = ORDER - 1
    total = counts + pad
    owner = np.repeat(np.arange(len(texts)), total)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(total) - total, total)
    padded = np.ones(len(owner), np.uint64)
    padded[place >= pad] = t
    end = np.flatnonzero(place >= pad)
    g = [padded[end - j] for j in range(pad, -1, -1)]
    owner = owner[end]
    return owner, (g[0] << _UP) | g[1], (g[2] << _UP) | g[3], (model.astype(np.uint64)[owner] << _UP) | g[4]


def _hash(*parts: np.ndarray) -> np.ndarray:
    h = mix(parts[0] + U64(len(parts)))
    for p in parts[1:]:
        h = mix(h + p)
    return h


def _texts(col) -> list[str]:
    return [collapse(t).lower() for t in flat(col).to_pylist()]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys, places in it where a new key begins)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)


def _before_last(cd: np.ndarray, le: np.ndarray) -> np.ndarray:
    """Model and token 4."""
    return (le & ~_HALF) | (cd & _HALF)


def _is_split(split: np.ndarray, cd: np.ndarray, le: np.ndarray) -> np.ndarray:
    return np.isin(_before_last(cd, le), split)


def _count_tokens(batches):
    for b in (part for whole in batches for part in slices(whole, 1, size=SLICE)):
        t, counts = tokens(_texts(b.column(1)))
        if len(t):
            owner = np.repeat(b.column(0).to_numpy().astype(np.uint64), counts)
            k, n = np.unique((owner << _UP) | t, return_counts=True)
            yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(n)], ["token", "n"])


def _count(buckets: int, split: np.ndarray):
    """n-grams with their counts, added up within a slice of the texts, by bucket."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 1, size=SLICE)):
            _, ab, cd, le = grams(_texts(b.column(1)), b.column(0).to_numpy())
            if len(ab) == 0:
                continue
            order, at = _runs(_hash(ab, cd, le))
            n = np.diff(np.concatenate([at, [len(ab)]])).astype(np.int32)
            first = order[at]
            ab, cd, le = ab[first], cd[first], le[first]
            bucket = mix(_before_last(cd, le) + np.where(_is_split(split, cd, le), mix(cd >> _UP), U64(0))) % U64(buckets)
            yield pa.record_batch([pa.array(bucket.astype(np.int32)), pa.array(ab.view(np.int64)), pa.array(cd.view(np.int64)), pa.array(le.view(np.int64)), pa.array(n)], ["bucket", "ab", "cd", "le", "n"])

    return run


class _Level:
    """The n-grams of one order in a bucket: their counts, models, contexts, and the rows of the order above that end in them."""

    def __init__(self, key: np.ndarray, context: np.ndarray, le: np.ndarray, n: np.ndarray, above: np.ndarray | None):
        self.key, self.context, self.model, self.n, self.above = key, context, (le >> _UP).astype(np.int64), n, above

    def chances(self, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own share, weight of the order below) of each n-gram; discount: by model and count."""
        d = discount[self.model, np.minimum(self.n, 3) - 1]
        inv = np.unique(self.context, return_inverse=True)[1]
        total, spare = np.bincount(inv, weights=self.n), np.bincount(inv, weights=d)
        return (self.n - d) / total[inv], (spare / total)[inv]


def _levels(ab: np.ndarray, cd: np.ndarray, le: np.ndarray, n: np.ndarray) -> tuple[list[_Level], np.ndarray]:
    """Orders 5 to 2 of a bucket, and the row of an n-gram of order 5 for each of order 2."""
    lang = le & ~_HALF
    out = [_Level(np.arange(len(ab)), _hash(ab, cd, lang), le, n, None)]
    row = np.arange(len(ab))
    for parts in ((ab & _HALF, cd), (cd,), (cd & _HALF,)):
        parts = [p[row] for p in parts]
        names, first, inv = np.unique(_hash(*parts, le[row]), return_index=True, return_inverse=True)
        context = _hash(*(p[first] for p in parts), lang[row[first]])
        row = row[first]
        out.append(_Level(names, context, le[row], np.bincount(inv), inv))
    return out, row


_KEPT = "kind int, low long, d long, le long, n long, ab binary, cd binary, les binary, ns binary"


def _types(split: np.ndarray):
    """One bucket as sorted arrays (kind 0), and what is added up over the buckets: numbers of n-grams by order and count (kind 1), tokens by what precedes them (kind 2), order 2 of split tokens (kind 3)."""

    def run(t: pa.Table) -> pa.Table:
        ab, cd, le, n = (t.column(c).to_numpy() for c in ("ab", "cd", "le", "n"))
        ab, cd, le = ab.view(np.uint64), cd.view(np.uint64), le.view(np.uint64)
        order, at = _runs(_hash(ab, cd, le))
        first = order[at]
        n = np.add.reduceat(n[order].astype(np.int64), at)
        ab, cd, le = ab[first], cd[first], le[first]
        levels, row = _levels(ab, cd, le, n)
        cut = _is_split(split, cd[row], le[row])
        kind, low, d, e, many = [0], [0], [0], [0], [0]
        for k, level in enumerate(levels):
            keep = level.n <= 4
            if k == 3:
                keep &= ~cut
            key, c = np.unique((level.model[keep] * 8 + k) * 8 + level.n[keep], return_counts=True)
            kind += [1] * len(key)
            low += key.tolist()
            d += [0] * len(key)
            e += [0] * len(key)
            many += c.tolist()
        last = levels[3]
        key, c = np.unique(le[row[~cut]], return_counts=True)
        at = np.flatnonzero(cut)
        kind += [2] * len(key) + [3] * len(at)
        low += key.view(np.int64).tolist() + (last.key[at] | U64(1 << 63)).view(np.int64).tolist()
        d += [0] * len(key) + (cd[row[at]] & _HALF).astype(np.int64).tolist()
        e += key.view(np.int64).tolist() + le[row[at]].view(np.int64).tolist()
        many += c.tolist() + last.n[at].tolist()
        blobs = [pa.array([x.tobytes()] + [None] * (len(kind) - 1), pa.binary()) for x in (ab, cd, le, n.astype(np.int32))]
        cols = [pa.array(kind, pa.int32()), *(pa.array(x, pa.int64()) for x in (low, d, e, many)), *blobs]
        return pa.table(cols, names=["kind", "low", "d", "le", "n", "ab", "cd", "les", "ns"])

    return run


def discounts(t: np.ndarray) -> np.ndarray:
    """The three discounts of modified Kneser-Ney, by the numbers of n-grams that occur once to four times (last axis); held within (0, count)."""
    t = np.maximum(t.astype(float), 1)
    y = t[..., 0] / (t[..., 0] + 2 * t[..., 1])
    d = [i - (i + 1) * y * t[..., i] / t[..., i - 1] for i in (1, 2, 3)]
    return np.stack([np.clip(v, 0.1, i - 0.05) for v, i in zip(d, (1, 2, 3))], -1)


def _model(discount: np.ndarray, split: np.ndarray):
    """A bucket's n-grams: their keys, ``alpha`` and ``beta``, and the key of the low order they build on."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ab, cd, le = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in range(3))
                n = np.frombuffer(b.column(3)[i].as_buffer(), np.int32).astype(np.int64)
                levels, row = _levels(ab, cd, le, n)
                cut = _is_split(split, cd[row], le[row])
                own, weight = levels[3].chances(discount[3])
                alpha, beta = np.where(cut, 0, own), np.where(cut, 1, weight)
                low = np.where(cut, levels[3].key | U64(1 << 63), le[row])
                for k in (2, 1, 0):
                    up = levels[k + 1].above
                    own, weight = levels[k].chances(discount[k])
                    alpha, beta, low = own + weight * alpha[up], weight * beta[up], low[up]
                for a in range(0, len(ab), 1 << 16):
                    s = slice(a, a + (1 << 16))
                    key = _hash(ab[s], cd[s], le[s])
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(alpha[s]), pa.array(beta[s]), pa.array(low[s].view(np.int64))], ["key", "alpha", "beta", "low"])

    return run


def _lookups(batches):
    for b in (part for whole in batches for part in slices(whole, 2, size=SLICE)):
        owner, ab, cd, le = grams(_texts(b.column(2)), b.column(1).to_numpy())
        if len(owner) == 0:
            continue
        key = _hash(ab, cd, le)
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        at = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])]))
        n = np.diff(np.concatenate([at, [len(owner)]])).astype(np.int32)
        yield pa.record_batch([take(b.column(0), owner[at]), pa.array(key[at].view(np.int64)), pa.array(n)], ["row", "key", "n"])


def _low_orders(kept: DataFrame, scratch: Scratch, models: int) -> tuple[DataFrame, np.ndarray]:
    """(low, p): order 1 by token and order 2 of split tokens; and the discounts by order (5 to 2), model and count."""
    spark = kept.sparkSession
    sums = scratch.cut(kept.filter("kind > 0").groupBy("kind", "low", "d", "le").agg(F.sum("n").alias("n")))
    pairs = sums.filter("kind = 3")
    singles = scratch.cut(sums.filter("kind = 2").select("le", "n").unionByName(pairs.select("le", F.lit(1).cast("long").alias("n"))).groupBy("le").agg(F.sum("n").alias("n")))
    model = F.shiftright("le", 32).alias("model")
    ones = lambda t: t.groupBy(model, F.least("n", F.lit(5)).alias("r")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("total"))
    seen = np.zeros((5, models, 5), np.int64)  # orders 5 to 1, model, counts 1 to 4 and more
    for r in sums.filter("kind = 1").select("low", "n").collect():  # at most 16 rows a model
        seen[(r.low >> 3) & 7, r.low >> 6, (r.low & 7) - 1] += r.n
    total = np.zeros(models)
    for k, t in ((3, pairs), (4, singles)):
        for r in ones(t).collect():  # at most 5 rows a model
            seen[k, r.model, r.r - 1] += r.types
            if k == 4:
                total[r.model] += r.total
    d = discounts(seen[:, :, :4])
    kinds = np.stack([seen[4, :, 0], seen[4, :, 1], seen[4, :, 2:].sum(1)], 1)
    spare = (d[4] * kinds).sum(1) / np.maximum(total, 1) / np.maximum(kinds.sum(1), 1)
    rows = [(m, *map(float, d[3, m]), *map(float, d[4, m]), float(total[m]), float(spare[m])) for m in range(models)]
    table = F.broadcast(spark.createDataFrame(rows, "model long, x1 double, x2 double, x3 double, y1 double, y2 double, y3 double, total double, spare double"))
    pick = lambda a, n: F.when(F.col(n) == 1, F.col(f"{a}1")).when(F.col(n) == 2, F.col(f"{a}2")).otherwise(F.col(f"{a}3"))
    one = singles.withColumn("model", model).join(table, "model").select("le", ((F.col("n") - pick("y", "n")) / F.col("total") + F.col("spare")).alias("p"))
    two = pairs.withColumn("model", model).join(table, "model").withColumn("x", pick("x", "n"))
    context = two.groupBy("model", "d").agg(F.sum("n").alias("sum"), F.sum("x").alias("left"))  # one row a split token
    two = two.join(context, ["model", "d"]).join(one.withColumnRenamed("p", "p1"), "le")
    two = two.select("low", ((F.col("n") - F.col("x") + F.col("left") * F.col("p1")) / F.col("sum")).alias("p"))
    low = scratch.cut(one.select(F.col("le").alias("low"), "p").unionByName(two))
    return (F.broadcast(low) if low.count() <= BROADCAST_ROWS else low), d[:4]


def perplexities(df: DataFrame, record: Column, text: Column, model: Column, models: int, bucket_rows: int = 1 << 17) -> DataFrame:
    """(row, perplexity): of each id's text under the model of all texts with the same number ``model`` (0 to ``models`` - 1); ids whose texts have no token are left out."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(record.alias("row"), model.cast("int").alias("model"), text.alias("t")).filter("t is not null and row is not null")
    said = scratch.cut(rows.select("model", "t").mapInArrow(_count_tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total = said.agg(F.sum("n")).first()[0]
    if not total:
        return rows.select("row", F.lit(None).cast("double").alias("perplexity")).filter("false")
    hot = max(bucket_rows, total >> 16)  # so at most 65,536 tokens are split
    split = said.filter(F.col("n") > hot).select("token").toArrow().column("token").to_numpy().view(np.uint64)
    buckets = max(8, -(-total // bucket_rows))
    counted = rows.select("model", "t").mapInArrow(_count(buckets, split), "bucket int, ab long, cd long, le long, n int")
    kept = scratch.cut(counted.groupBy("bucket").applyInArrow(_types(split), _KEPT))
    low, discount = _low_orders(kept, scratch, models)
    chances = kept.filter("kind = 0").select("ab", "cd", "les", "ns").mapInArrow(_model(discount, split), "key long, alpha double, beta double, low long")
    chances = chances.join(low, "low").select("key", F.log(F.col("alpha") + F.col("beta") * F.col("p")).alias("logp"))
    kind = rows.schema["row"].dataType.simpleString()
    asked = rows.mapInArrow(_lookups, f"row {kind}, key long, n int")
    # the model's keys are unique hashes, so its partitions are even, and small enough to be hashed; a hot n-gram is one row a document on the other side, which only streams by
    scored = asked.join(chances.hint("shuffle_hash"), "key").groupBy("row").agg(F.sum(F.col("logp") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    return scratch.cut(scored.select("row", F.exp(-F.col("s") / F.col("n")).alias("perplexity")), partitions=-(-total // HASHED_ROWS))
