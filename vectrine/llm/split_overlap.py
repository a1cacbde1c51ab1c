"""Same or near-same records across splits.

Method, for texts: content-defined chunks.  A rolling hash of the last few
characters of the normalised record decides the cuts, so an edit changes the
chunks around it and no others.  Chunk digests are joined across the splits:
the lengths of a held-out record's chunks that any train record has add up to
its overlap fraction.

For pairs, only the rarest chunks of a record are joined, as many as it takes
that the rest is shorter than the least overlap: a pair with that overlap
shares one of them.  Pairs whose shared length can't reach the least overlap
any more, or whose numbers of trigrams are too far apart, end there; the others
are checked by the exact similarity of their trigrams.

A similarity of trigrams doesn't imply that overlap (short texts with an edit in
every chunk have none), so the texts are also held against each other by a
prefix filter that loses no pair: the held-out texts go to the train texts in
blocks, and a pair is checked if so many of the rarest trigrams of both agree
that the rest can still make it similar.

Equal ids are joined.  Near-equal vectors share a band of random sign bits with
probability above 0.9999 and are checked by their exact cosine.

Equal texts, and equal vectors, are one class that takes part once, however
many rows it has; record pairs are made of class pairs only if asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions.arrow_vectors import flat, list_column, take, usable
from vectrine.llm.text import U64, mix, slices, span_hashes
from vectrine.plans.materialize import Scratch


#: The rolling hash is a polynomial over the characters, modulo a prime.
ROLL_BASE = 1_000_003
ROLL_PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class OverlapConfig:
    dim: int = 64
    cosine: float = 0.97
    similarity: float = 0.7
    #: Characters that the rolling hash covers; one place in ``divisor`` is a cut.
    roll: int = 8
    divisor: int = 16
    #: Least share of the longer record's text in shared chunks that makes a candidate.
    least_overlap: float = 0.3
    #: Held-out texts, and their characters, that are broadcast at a time, about.
    block_texts: int = 65536
    block_chars: int = 1 << 23
    bits: int = 20
    bands: int = 44
    seed: int = 42


def chunk_spans(texts: list[str], cfg: OverlapConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, digest, length) of the content-defined chunks of ASCII texts."""
    data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    starts = ends - np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    h = np.zeros(len(data), np.uint64)
    for j in range(cfg.roll if len(data) >= cfg.roll else 0):
        h[cfg.roll - 1 :] = (h[cfg.roll - 1 :] * U64(ROLL_BASE) + data[j : len(data) - cfg.roll + 1 + j].astype(np.uint64)) % U64(ROLL_PRIME)
    cut = h % U64(cfg.divisor) == 0
    owner = np.repeat(np.arange(len(texts)), ends - starts)
    at = np.arange(len(data))
    cut &= (at - starts[owner] >= cfg.roll - 1) & (at < ends[owner] - 2)  # a cut comes after its place, within the text
    begin = np.zeros(len(data), bool)
    begin[starts] = True
    begin[np.flatnonzero(cut) + 1] = True
    s = np.flatnonzero(begin)
    o = owner[s]
    e = np.concatenate([s[1:], [len(data)]])
    e = np.minimum(e, ends[o] - 1)
    full = e > s
    return o[full], span_hashes(data, s[full], e[full]), (e - s)[full]


def _chunks(cfg: OverlapConfig):
    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 1)):
            texts = flat(b.column(1)).to_pylist()
            owner, digest, length = chunk_spans(texts, cfg)
            if len(owner) == 0:
                continue
            # a repeated chunk of a record is one digest with the lengths added up
            order = np.lexsort((digest, owner))
            owner, digest, length = owner[order], digest[order], length[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
            at = np.flatnonzero(new)
            grams = trigrams(texts)[2]
            yield pa.record_batch(
                [take(b.column(0), owner[at]), take(b.column(2), owner[at]), take(b.column(3), owner[at]), pa.array(digest[at].view(np.int64)), pa.array(np.add.reduceat(length, at)), pa.array(grams[owner[at]])],
                ["class", "train", "held", "digest", "length", "grams"],
            )

    return run


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of ASCII texts: text numbers, codes, and the number of each text."""
    data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    inside = (owner[:-2] == owner[2:]) & (data[2:] != 10)
    both = np.sort(owner[:-2][inside] << 24 | code[inside])
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    o = both >> 24
    return o, both & 0xFFFFFF, np.bincount(o, minlength=len(texts))


def _check_texts(cfg: OverlapConfig):
    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 2, 3)):
            n = b.num_rows
            left, right = flat(b.column(2)).to_pylist(), flat(b.column(3)).to_pylist()
            owner, code, size = trigrams(left + right)
            both = np.sort((owner % n) << 24 | code)
            shared = np.bincount(both[1:][both[1:] == both[:-1]] >> 24, minlength=n)
            union = size[:n] + size[n:] - shared
            jac = shared / np.maximum(union, 1)
            good = np.flatnonzero((shared >= cfg.similarity * union - 1e-9) & (union > 0))
            yield pa.record_batch([take(b.column(0), good), take(b.column(1), good), pa.array(jac[good])], ["a", "b", "similarity"])

    return run


def _vector_keys(cfg: OverlapConfig):
    def run(batches):
        for b in batches:
            rows, m, norms = usable(b.column(1), cfg.dim)
            if len(rows) == 0:
                continue
            u = np.round(m.astype(np.float64) / norms[:, None], 6)  # scaled copies agree
            w = np.random.default_rng(cfg.seed).integers(1, 1 << 62, cfg.dim, dtype=np.int64).view(np.uint64) | U64(1)
            with np.errstate(over="ignore"):
                key = mix(((u * 1e6).astype(np.int64).view(np.uint64) * w).sum(1))
            v = np.ascontiguousarray((m / norms[:, None]).astype(np.float32))
            size = cfg.dim * 4
            raw = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(np.arange(0, (len(v) + 1) * size, size, dtype=np.int32).tobytes()), pa.py_buffer(v.tobytes())])
            yield pa.record_batch([take(b.column(0), rows), take(b.column(2), rows), take(b.column(3), rows), pa.array(key.view(np.int64)), raw], ["id", "train", "held", "key", "v"])

    return run


def _vectors(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(flat(col).to_pylist()), np.float32).reshape(-1, dim)


def _vector_bands(cfg: OverlapConfig):
    def run(batches):
        planes = np.random.default_rng(cfg.seed + 1).standard_normal((cfg.dim, cfg.bits * cfg.bands)).astype(np.float32)
        power = (1 << np.arange(cfg.bits)).astype(np.int64)
        for b in batches:
            if b.num_rows == 0:
                continue
            bit = (_vectors(b.column(3), cfg.dim) @ planes > 0).reshape(b.num_rows, cfg.bands, cfg.bits)
            keys = (bit @ power) | (np.arange(cfg.bands, dtype=np.int64) << cfg.bits)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), list_column(keys.ravel(), np.full(b.num_rows, cfg.bands), pa.int64())], ["vector_id", "train", "held", "keys"])

    return run


def _check_vectors(cfg: OverlapConfig):
    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            x, y = _vectors(b.column(2), cfg.dim).astype(np.float64), _vectors(b.column(3), cfg.dim).astype(np.float64)
            c = np.einsum("ij,ij->i", x, y) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            good = np.flatnonzero(c >= cfg.cosine)
            yield pa.record_batch([take(b.column(0), good), take(b.column(1), good), pa.array(c[good])], ["a", "b", "cosine"])

    return run


def normal_words(text: Column) -> Column:
    """The words (runs of ``[a-z0-9]`` of the lower-cased text) joined by one blank; null for wordless texts."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(""))


def _classes(rows: DataFrame, key: str, carry: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(classes of equal ``key`` with their sides and smallest id, members)."""
    side = [F.max("train").alias("train"), F.max("held").alias("held"), *(F.first(c).alias(c) for c in carry)]
    classes = scratch.cut(rows.groupBy(key).agg(F.min("id").alias("class"), *side))
    members = rows.select("id", "train", "held", key).join(classes.select(key, "class"), key).select("id", "train", "class")
    return classes, members


def _expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Record pairs of class pairs (a, b): those of different sides."""
    one = members.select(F.col("id").alias("x"), F.col("train").alias("tx"), F.col("class").alias("a"))
    two = members.select(F.col("id").alias("y"), F.col("train").alias("ty"), F.col("class").alias("b"))
    return pairs.join(one, "a").join(two, "b").filter("tx <> ty").select(F.when(F.col("tx"), F.col("x")).otherwise(F.col("y")).alias("train_id"), F.when(F.col("tx"), F.col("y")).otherwise(F.col("x")).alias("held_id"))


def _likely(rare: DataFrame, cfg: OverlapConfig) -> DataFrame:
    """Pairs of classes that may reach the least overlap, by the summed lengths of the rare chunks they share and what is left of each."""
    side = lambda s: rare.filter(s).select("digest", *(F.col(c).alias(f"{c}_{s}") for c in ("class", "length", "total", "rest", "last", "grams")))
    pair = side("train").hint("merge").join(side("held"), "digest").filter("class_train <> class_held")
    low, high = (lambda c: F.least(f"{c}_train", f"{c}_held")), (lambda c: F.greatest(f"{c}_train", f"{c}_held"))
    pair = pair.filter(low("grams") >= cfg.similarity * high("grams"))
    # a shared chunk that isn't in both prefixes lies in the rest of the one that ends first
    rest = F.when(F.col("last_train") <= F.col("last_held"), F.col("rest_train")).otherwise(F.col("rest_held"))
    shared = pair.groupBy("class_train", "class_held").agg(F.sum(low("length")).alias("shared"), F.first(rest).alias("rest"), F.first(high("total")).alias("total"))
    likely = shared.filter(F.col("shared") + F.col("rest") >= cfg.least_overlap * F.col("total"))
    return likely.select(low("class").alias("a"), high("class").alias("b")).distinct()


@dataclass
class _TextBlock:
    """Held-out texts by their trigrams, rarest of the block first: places of ``codes`` in ``tokens``, one text after the other; ``posts`` has the texts with a trigram in their prefix, one trigram after the other."""

    ids: np.ndarray
    size: np.ndarray
    rest: np.ndarray
    codes: np.ndarray
    place: np.ndarray
    tokens: np.ndarray
    begin: np.ndarray
    posts: np.ndarray
    posts_at: np.ndarray


def _prefix(size: np.ndarray, similarity: float) -> np.ndarray:
    """Length of the prefix of which similar sets share a trigram."""
    return np.minimum(size, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1)


def text_block(ids: np.ndarray, texts: list[str], cfg: OverlapConfig) -> _TextBlock | None:
    owner, code, size = trigrams(texts)
    if len(owner) == 0:
        return None
    codes, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    place = np.empty(len(codes), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(codes))
    token = place[inverse]
    order = np.lexsort((token, owner))
    owner, token = owner[order], token[order]
    begin = np.concatenate([[0], np.cumsum(size)])
    prefix = _prefix(size, cfg.similarity)
    near = np.arange(len(owner)) - begin[owner] < prefix[owner]
    o, t = owner[near], token[near]
    order = np.argsort(t, kind="stable")
    return _TextBlock(ids, size, size - prefix, codes, place, token, begin, o[order], np.searchsorted(t[order], np.arange(len(codes) + 1)))


def similar_texts(blk: _TextBlock, ids: np.ndarray, texts: list[str], cfg: OverlapConfig) -> tuple[list[int], list[int], list[float]]:
    """All (id, id of the block, similarity) of different ids that are similar by their trigrams."""
    owner, code, size = trigrams(texts)
    at = np.minimum(np.searchsorted(blk.codes, code), len(blk.codes) - 1)
    token = np.where(blk.codes[at] == code, blk.place[at], -1)  # what the block lacks is rarest
    order = np.lexsort((token, owner))
    token = token[order]
    begin, prefix = np.concatenate([[0], np.cumsum(size)]), _prefix(size, cfg.similarity)
    mine = np.zeros(len(blk.codes), bool)
    left, right, found = [], [], []
    for i in np.flatnonzero(size):
        own = token[begin[i] : begin[i + 1]]
        own, rare, n = own[own >= 0], own[: prefix[i]], size[i]
        hits = np.zeros(len(blk.ids), np.int64)
        for t in rare[rare >= 0]:
            hits[blk.posts[blk.posts_at[t] : blk.posts_at[t + 1]]] += 1  # a text stands once a trigram
        c = np.flatnonzero(hits)
        least = cfg.similarity / (1 + cfg.similarity) * (n + blk.size[c]) - 1e-6
        close = np.minimum(n, blk.size[c]) >= cfg.similarity * np.maximum(n, blk.size[c]) - 1e-9
        c = c[close & (hits[c] + np.maximum(n - prefix[i], blk.rest[c]) >= least) & (blk.ids[c] != ids[i])]
        if len(c) == 0:
            continue
        mine[own] = True
        shared = np.array([np.count_nonzero(mine[blk.tokens[blk.begin[j] : blk.begin[j + 1]]]) for j in c])
        mine[own] = False
        union = n + blk.size[c] - shared
        good = shared >= cfg.similarity * union - 1e-9
        left += [int(ids[i])] * int(good.sum())
        right += blk.ids[c[good]].tolist()
        found += (shared[good] / union[good]).tolist()
    return left, right, found


def _scan_texts(shared, cfg: OverlapConfig):
    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 1)):
            a, c, _ = similar_texts(shared.value, flat(b.column(0)).to_numpy(), flat(b.column(1)).to_pylist(), cfg)
            yield pa.record_batch([pa.array(np.minimum(a, c).astype(np.int64)), pa.array(np.maximum(a, c).astype(np.int64))], ["a", "b"])

    return run


def similar_classes(classes: DataFrame, cfg: OverlapConfig) -> DataFrame:
    """(a, b): all pairs of a class with train rows and another with held-out ones, smaller first, whose texts are similar."""
    spark = classes.sparkSession
    train, held = classes.filter("train").select("class", "words"), classes.filter("held").select("class", "words")
    n, chars = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    blocks = max(1, -(-n // (cfg.block_texts * 3 // 4)), -(-chars // (cfg.block_chars * 3 // 4)))
    train = train.repartition(2 * spark.sparkContext.defaultParallelism)  # few bytes and much work
    out = spark.createDataFrame([], "a long, b long")
    for i in range(blocks):
        t = held.filter(F.pmod(F.xxhash64("class"), F.lit(blocks)) == i).toArrow()
        blk = text_block(t.column("class").to_numpy(), t.column("words").to_pylist(), cfg)
        if blk:
            out = out.unionByName(train.mapInArrow(_scan_texts(spark.sparkContext.broadcast(blk), cfg), "a long, b long"))
    return out


def _across(rows: DataFrame, key: str) -> DataFrame:
    """Pairs of different classes that share a key, of which one has train rows and the other held-out ones, smaller class first."""
    left = rows.filter("train").select(F.col("class").alias("t"), key)
    right = rows.filter("held").select(F.col("class").alias("h"), key)
    return left.hint("merge").join(right, key).filter("t <> h").select(F.least("t", "h").alias("a"), F.greatest("t", "h").alias("b")).distinct()


@dataclass
class Overlaps:
    """Overlaps between the train split and the held-out ones, by classes of equal texts and vectors.

    ``rows``: (id, same, train, held); ``text_pairs`` and ``vector_pairs``:
    (a, b) of similar classes, a = b for one that both sides have; the members
    of classes; ``chunks`` of the classes of texts.
    """

    rows: DataFrame
    text_pairs: DataFrame
    text_members: DataFrame
    vector_pairs: DataFrame
    vector_members: DataFrame
    chunks: DataFrame

    def pairs(self) -> DataFrame:
        """(train_id, held_id, by_id, by_text, by_vector): all pairs of rows, and why."""
        ids = self.rows.filter("same is not null")
        by_id = ids.filter("train").select(F.col("id").alias("train_id"), "same").join(ids.filter("held").select(F.col("id").alias("held_id"), "same"), "same")
        found = (by_id, _expand(self.text_pairs, self.text_members), _expand(self.vector_pairs, self.vector_members))
        flags = ("by_id", "by_text", "by_vector")
        parts = [p.select("train_id", "held_id", *(F.lit(f == g).alias(g) for g in flags)) for f, p in zip(flags, found)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("train_id", "held_id").agg(*(F.max(f).alias(f) for f in flags))

    def records(self) -> DataFrame:
        """(held_id, by_id, by_text, by_vector, overlap): every held-out row, whether a train row agrees with it, and the share of its text in chunks that train rows have (null without a text).

        No pair of rows is formed, so a value that most rows have costs no more
        than any other.
        """
        held = self.rows.filter("held").select(F.col("id").alias("held_id"), "same")
        same = self.rows.filter("train and same is not null").select("same", F.lit(True).alias("by_id")).distinct()
        out = held.join(same, "same", "left")
        for flag, pairs, members in (("by_text", self.text_pairs, self.text_members), ("by_vector", self.vector_pairs, self.vector_members)):
            trained = members.filter("train").select(F.col("class").alias("other"))
            both = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("other")))
            hit = both.join(trained, "other", "left_semi").select("class", F.lit(True).alias(flag)).distinct()
            out = out.join(members.filter("not train").join(hit, "class").select(F.col("id").alias("held_id"), flag), "held_id", "left")
        seen = self.chunks.filter("train").select("digest", F.lit(True).alias("seen")).distinct()
        share = self.chunks.filter("held").join(seen, "digest", "left").groupBy("class").agg((F.sum(F.when(F.col("seen"), F.col("length")).otherwise(0)) / F.sum("length")).alias("overlap"))
        share = self.text_members.filter("not train").join(share, "class").select(F.col("id").alias("held_id"), "overlap")
        flags = (F.coalesce(f, F.lit(False)).alias(f) for f in ("by_id", "by_text", "by_vector"))
        return out.join(share, "held_id", "left").select("held_id", *flags, "overlap")


def split_overlaps(df: DataFrame, record: Column, same_id: Column, split: Column, text: Column, vector: Column, cfg: OverlapConfig = OverlapConfig(), train: str = "train", held_out: tuple[str, ...] = ("calibration", "evaluation")) -> Overlaps:
    """Train rows and held-out rows that are the same or almost the same, by id, text or vector.

    Splits and ids are compared trimmed and without regard to case; rows of
    other or null splits take no part, nor do rows without an id; a repeated id
    counts once.  Null and blank ids, null and wordless texts and unusable
    vectors (null, all zero, wrong length, not finite) agree with nothing.
    Texts of fewer than three characters have no trigram and are similar to
    nothing.  Empty tables give an empty result.
    """
    scratch = Scratch(df.sparkSession)
    tidy = lambda c: F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    role = tidy(split)
    rows = df.select(
        record.cast("long").alias("id"),
        F.nullif(tidy(same_id), F.lit("")).alias("same"),
        (role == train).alias("train"),
        role.isin(*held_out).alias("held"),
        normal_words(text).alias("words"),
        vector.alias("v"),
    ).filter("id is not null and (train or held)")
    plain = scratch.cut(rows.select("id", "same", "train", "held", "words").dropDuplicates(["id"]))
    # texts
    classes, members = _classes(plain.filter("words is not null"), "words", [], scratch)
    chunks = scratch.cut(classes.select("class", "words", "train", "held").mapInArrow(_chunks(cfg), "class long, train boolean, held boolean, digest long, length long, grams long"))
    seen = chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("class").orderBy("n", "digest")
    whole = Window.partitionBy("class")
    rare = (
        chunks.join(seen, "digest")
        .withColumn("sum", F.sum("length").over(order))
        .withColumn("total", F.sum("length").over(whole))
        .filter(F.col("sum") - F.col("length") <= (1 - cfg.least_overlap) * F.col("total"))
        .withColumn("rest", F.col("total") - F.max("sum").over(whole))
        .withColumn("last", F.max(F.struct("n", "digest")).over(whole))
    )
    names = classes.select("class", "words")
    pairs = (
        _likely(rare, cfg)
        .join(names.select(F.col("class").alias("a"), F.col("words").alias("wa")), "a")
        .join(names.select(F.col("class").alias("b"), F.col("words").alias("wb")), "b")
        .select("a", "b", "wa", "wb")
        .mapInArrow(_check_texts(cfg), "a long, b long, similarity double")
    )
    equal = classes.filter((F.length("words") >= 3) & F.col("train") & F.col("held")).select(F.col("class").alias("a"), F.col("class").alias("b"))
    text_pairs = scratch.cut(pairs.select("a", "b").unionByName(similar_classes(classes, cfg)).distinct().unionByName(equal))
    # vectors
    keyed = scratch.cut(rows.select("id", "v", "train", "held").mapInArrow(_vector_keys(cfg), "id long, train boolean, held boolean, key long, v binary").dropDuplicates(["id"]))
    vclasses, vmembers = _classes(keyed, "key", ["v"], scratch)
    bands = vclasses.select("class", "train", "held", "v").mapInArrow(_vector_bands(cfg), "class long, train boolean, held boolean, keys array<long>").select("class", "train", "held", F.explode("keys").alias("band"))
    near = (
        _across(bands, "band")
        .join(vclasses.select(F.col("class").alias("a"), F.col("v").alias("va")), "a")
        .join(vclasses.select(F.col("class").alias("b"), F.col("v").alias("vb")), "b")
        .select("a", "b", "va", "vb")
        .mapInArrow(_check_vectors(cfg), "a long, b long, cosine double")
    )
    equal = vclasses.filter("train and held").select(F.col("class").alias("a"), F.col("class").alias("b"))
    vector_pairs = scratch.cut(near.select("a", "b").unionByName(equal))
    return Overlaps(plain.select("id", "same", "train", "held"), text_pairs, members, vector_pairs, vmembers, chunks)
