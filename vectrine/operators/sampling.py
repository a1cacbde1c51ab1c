"""Stable hashes, splits, quotas, orders and offset arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.plans.materialize import Scratch


def unit_hash(text: Column) -> Column:
    """The first 64 bits of SHA-256 as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def seeded_key(seed: int, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}::"), text), 256)


def canonical_query_id(raw: Column, source: Column) -> Column:
    """The trimmed source id, or the trimmed raw id where there is none."""
    return F.coalesce(F.nullif(F.trim(source), F.lit("")), F.trim(raw))


def id_aliases(doc_id: Column) -> Column:
    """The spellings of a document id: ``dN``, ``DN`` and ``N``, the given one first."""
    s = F.trim(doc_id)
    tail = F.substring(s, 2, 1 << 20)
    rest = F.when(s.rlike("^d[0-9]+$"), F.array(s, tail)).when(s.rlike("^D[0-9]+$"), F.array(s, tail, F.concat(F.lit("d"), tail))).when(s.rlike("^[0-9]+$"), F.array(s, F.concat(F.lit("d"), s)))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.coalesce(rest, F.array(s)))


def global_index(df: DataFrame, *order: Column | str) -> DataFrame:
    """``index``: the place of each row, from 0, in the order of all rows; a range of the order is a partition, so no task sees them all."""
    scratch = Scratch(df.sparkSession)
    spread = scratch.cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    count = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = spread.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return local.join(F.broadcast(count), "_part").withColumn("index", F.col("_i") + F.col("_before") - 1).drop("_part", "_i", "_before")


def group_index(df: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """``index`` (from 0) of each row within its group, and the group's size ``n``: by ranges of the whole order, so a group may span partitions."""
    r = global_index(df, group, *order)
    first = r.groupBy(group).agg(F.min("index").alias("_first"), F.count(F.lit(1)).alias("n"))
    return r.join(first, group).withColumn("index", F.col("index") - F.col("_first")).drop("_first")


def at_fraction(value: Column, fraction: float, size: Column) -> Column:
    """Aggregate over the rows of ``group_index``: the quantile of the ``size`` first values, interpolated between the two nearest places."""
    at = F.lit(fraction) * (size - 1)
    low = F.max(F.when(F.col("index") == F.floor(at), value))
    high = F.max(F.when(F.col("index") == F.ceil(at), value))
    part = F.max(at - F.floor(at))
    return low + part * (high - low)


def at_ranks(df: DataFrame, value: str, ranks: list[int], most: int = 65536, bins: int = 4096) -> list[float]:
    """The values at some places (from 0) of the ascending order of a column's non-null values.

    The span around each place is narrowed by counts in equal bins until few
    enough values are left to sort, or all that are left are equal.
    """
    v = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    low, high = v.agg(F.min("v"), F.max("v")).first()
    out = []
    for rank in ranks:
        a, b, skipped = low, high, 0
        while True:
            inside = v.filter((F.col("v") >= a) & (F.col("v") <= b))
            width = (b - a) / bins
            if width <= 0 or a + width == a or inside.count() <= most:
                break
            bin_of = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.lit(a)) / F.lit(width)))
            seen = skipped
            for r in inside.groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect():
                if seen + r.n > rank:
                    a, b, skipped = r.low, r.high, seen
                    break
                seen += r.n
        out.append(a if a == b else inside.orderBy("v").limit(rank - skipped + 1).agg(F.max("v")).first()[0])
    return out


def quantiles(df: DataFrame, value: str, fractions: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles of a column, interpolated between the two nearest places; nulls without values."""
    n = df.filter(F.col(value).isNotNull()).count()
    if n == 0:
        return [None] * len(fractions)
    at = [f * (n - 1) for f in fractions]
    found = at_ranks(df, value, sorted({int(x) + d for x in at for d in (0, 1) if int(x) + d < n}))
    place = dict(zip(sorted({int(x) + d for x in at for d in (0, 1) if int(x) + d < n}), found))
    return [place[int(x)] + (x - int(x)) * (place[min(int(x) + 1, n - 1)] - place[int(x)]) for x in at]


def split_rows(df: DataFrame, key: Column, ratio: float, least_calibration: int, least_evaluation: int, seed: int) -> DataFrame:
    """(key, role): 'calibration' for the first round-half-even(ratio * n) of the distinct keys by hash, held to the least counts; else 'evaluation'."""
    keys = df.select(key.cast("string").alias("key")).filter("key is not null").distinct().withColumn("h", unit_hash(F.concat(F.lit(f"{seed}::"), F.col("key"))))
    n = keys.count()
    ratio = min(0.95, max(0.05, ratio))
    low, high = max(1, least_calibration), max(1, least_evaluation)
    if low + high > n:
        low = max(1, min(low, n // 2))
        high = max(1, n - low)
    cut = max(low, min(round(ratio * n), n - high))
    if cut >= n:
        return keys.select("key", F.lit("calibration").alias("role"))
    # the hash at the cut comes from counts; only keys of that very hash are put in order
    edge = at_ranks(keys, "h", [cut - 1])[0]
    left = cut - keys.filter(F.col("h") < edge).count()
    last = keys.filter(F.col("h") == edge).orderBy("key").limit(left).agg(F.max("key")).first()[0]
    role = F.when((F.col("h") < edge) | ((F.col("h") == edge) & (F.col("key") <= last)), "calibration").otherwise("evaluation")
    return keys.select("key", role.alias("role"))


def hash_sample(df: DataFrame, record: Column, source: Column, n: int) -> DataFrame:
    """(record): the n records of smallest SHA-1 over source and record, ties by record."""
    r = df.select(record.cast("string").alias("record"), F.coalesce(source.cast("string"), record.cast("string")).alias("s"))
    return r.withColumn("h", F.sha1(F.concat("s", F.lit("::"), "record"))).orderBy("h", "record").limit(n).select("record")


def round_robin(df: DataFrame, record: Column, source: Column, n: int) -> DataFrame:
    """(record, source, turn): the first n records when sources take turns, in order of their first record."""
    r = df.select(record.alias("record"), source.alias("source"))
    w = Window.partitionBy("source").orderBy("record")
    turns = r.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n)
    first = r.groupBy("source").agg(F.min("record").alias("first"))
    both = turns.join(first, turns["source"].eqNullSafe(first["source"])).select("record", turns["source"], "turn", "first")
    return both.orderBy("turn", "first").limit(n).select("record", "source", "turn")


def proportional_quotas(counts: DataFrame, target: int) -> DataFrame:
    """(group, count, quota): shares of ``target`` in proportion to counts(group, count), by largest remainder, never above the count."""
    t = counts.agg(F.sum("count").alias("total"))
    e = F.col("count") * F.lit(float(target)) / F.col("total")
    q = counts.crossJoin(t).withColumns({"floor": F.least(F.floor(e), F.col("count")), "rest": F.round(e - F.floor(e), 12)})
    spare = F.lit(target) - F.sum("floor").over(Window.partitionBy())
    order = Window.orderBy((F.col("floor") >= F.col("count")), F.desc("rest"), F.desc(F.col("count") - F.col("floor")), "group")
    q = q.withColumns({"spare": spare, "r": F.row_number().over(order)})
    return q.select("group", "count", (F.col("floor") + F.when((F.col("r") <= F.col("spare")) & (F.col("floor") < F.col("count")), 1).otherwise(0)).alias("quota"))


def balanced_quotas(counts: DataFrame, target: int) -> DataFrame:
    """(group, count, quota): equal shares of ``target``, capped by the count; what small groups leave goes to those with most left, one each in turn.

    Each slot of a group is a row with the turn in which it is dealt; the first
    ``target`` slots are taken.  There is one row a slot, ``target`` a group at most.
    """
    active = counts.filter("count > 0")
    base = target // max(1, active.count())
    slot = active.select("group", "count", F.explode(F.sequence(F.lit(1), F.least(F.col("count").cast("int"), F.lit(max(1, target))))).alias("i"))
    turn = F.greatest(F.lit(0), F.col("i") - base)
    order = Window.orderBy(turn, F.when(turn > 0, F.col("i") - F.col("count")).otherwise(F.lit(0)), "group", "i")
    taken = slot.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= target).groupBy("group").agg(F.count(F.lit(1)).alias("quota"))
    return counts.join(taken, "group", "left").select("group", "count", F.coalesce("quota", F.lit(0)).alias("quota"))


def even_quota(total: int, groups: int, index: Column) -> Column:
    """The quota of group ``index`` (from 0) when ``total`` is shared evenly, the remainder going to the first."""
    return F.lit(total // groups) + F.when(index < total % groups, 1).otherwise(0)


def terciles(df: DataFrame, score: str) -> DataFrame:
    """``difficulty``: 'easy', 'mid' or 'hard' by the terciles of the score; 'mid' for fewer than three rows."""
    a, b = quantiles(df, score, (1 / 3, 2 / 3))
    if a is None or df.count() < 3:
        return df.withColumn("difficulty", F.lit("mid"))
    return df.withColumn("difficulty", F.when(F.col(score) <= a, "easy").when(F.col(score) <= b, "mid").otherwise("hard"))


def interleave(df: DataFrame, score: str, key: str) -> DataFrame:
    """``turn`` and ``place``: the order in which mid, easy, hard and other rows take turns, each by score and key."""
    place = F.when(F.col("difficulty") == "mid", 0).when(F.col("difficulty") == "easy", 1).when(F.col("difficulty") == "hard", 2).otherwise(3)
    r = global_index(df.withColumn("place", place), "place", score, key)
    first = r.groupBy("place").agg(F.min("index").alias("_first"))  # four rows at most
    return r.join(F.broadcast(first), "place").withColumn("turn", (F.col("index") - F.col("_first") + 1).cast("int")).drop("index", "_first")


def stratified_pick(df: DataFrame, group: str, record: str, distance: str, target: int, strata: int) -> DataFrame:
    """(group, record): ``target`` records of each group, spread over equal bins of the distance order and evenly within each bin.

    Groups of ``target`` or fewer give all.  Bins differ by one row at most,
    the larger first; within a bin the places are evenly spaced, cut to whole
    numbers.
    """
    r = group_index(df.select(group, record, distance), group, distance, record).withColumnRenamed("index", "i")
    s = F.least(F.lit(strata), F.col("n"))
    size, more = F.floor(F.col("n") / s), F.col("n") % s
    edge = more * (size + 1)
    b = F.when(F.col("i") < edge, F.floor(F.col("i") / (size + 1))).otherwise(more + F.floor((F.col("i") - edge) / size))
    r = r.withColumn("s", s).withColumn("b", b).withColumn("len", size + F.when(F.col("b") < more, 1).otherwise(0)).withColumn("at", F.col("i") - F.when(F.col("b") < more, F.col("b") * (size + 1)).otherwise(edge + (F.col("b") - more) * size))
    q = F.floor(F.lit(target) / F.col("s")) + F.when(F.col("b") < F.lit(target) % F.col("s"), 1).otherwise(0)
    r = r.withColumn("q", q)
    step = F.col("len") - 1
    # the place is picked if some j of the q places, floor(j * step / (q - 1)), is this one
    j = F.ceil(F.col("at") * (F.col("q") - 1) / step)
    hit = F.when(F.col("len") <= F.col("q"), True).when(F.col("q") <= 0, False).when(F.col("q") == 1, F.col("at") == 0).otherwise((F.floor(j * step / (F.col("q") - 1)) == F.col("at")) & (j < F.col("q")))
    return r.filter((F.col("n") <= target) | hit).select(group, record)


def prefix_for_size(core: DataFrame, size: int) -> DataFrame:
    """(prefix_end): the smallest p for which the offsets below p and the core offsets make ``size`` different ones; core(offset)."""
    r = global_index(core.select("offset").distinct(), "offset")
    m = r.count()
    # p and the core make p + (core offsets from p on); with i core offsets below p that is p + m - i, and it grows with p
    inside = r.filter(F.col("offset") - F.col("index") >= size - m).agg((F.lit(size - m) + F.min("index")).alias("p"))
    return inside.select(F.greatest(F.lit(0), F.coalesce("p", F.lit(size))).cast("long").alias("prefix_end"))


def union_size(core: DataFrame, prefix_end: int) -> DataFrame:
    """(size): different offsets in the prefix and the core together."""
    return core.select("offset").distinct().agg((F.lit(prefix_end) + F.count_if(F.col("offset") >= prefix_end)).alias("size"))


def merge_ranges(df: DataFrame, group: str, row: str, most_gap: int) -> DataFrame:
    """(group, first, last, rows): runs of rows whose gaps are at most ``most_gap``."""
    w = Window.partitionBy(group).orderBy(row)
    d = df.select(group, row).distinct().withColumn("new", F.when(F.col(row) - F.lag(row).over(w) <= most_gap, 0).otherwise(1))
    return d.withColumn("run", F.sum("new").over(w)).groupBy(group, "run").agg(F.min(row).alias("first"), F.max(row).alias("last"), F.count(F.lit(1)).alias("rows")).drop("run")


def nearest_rank(df: DataFrame, value: str, fractions: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Values at the place floor(f * (n - 1)) of the order, with count, smallest, largest and mean."""
    w = Window.partitionBy(*by).orderBy(value)
    all_ = Window.partitionBy(*by)
    r = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(all_)})
    at = [F.max(F.when(F.col("_i") == F.floor(F.lit(f) * (F.col("_n") - 1)), F.col(value))).alias(name) for name, f in fractions.items()]
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("smallest"), *at, F.max(value).alias("largest"), F.round(F.avg(value), 6).alias("mean"))


def support_counts(hits: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """One row: how many queries (query_id, hits) reach each threshold."""
    return hits.agg(*(F.count_if(F.col("hits") >= t).alias(f"at_least_{t}") for t in thresholds))


def carry_forward(df: DataFrame, order: str, value: str) -> DataFrame:
    """``value`` with gaps filled by the last one before, along ``order`` (a small table)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def shard_catalogue(shards: DataFrame) -> DataFrame:
    """(shard_idx, num_rows, global_start, global_end): row ranges by running sums; one row a shard."""
    w = Window.orderBy("shard_idx").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("num_rows").over(w)
    return shards.select("shard_idx", "num_rows", (end - F.col("num_rows")).alias("global_start"), end.alias("global_end"))


def locate_offsets(offsets: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(offset, shard_idx, local_row): the shard of each offset; the catalogue has one row a shard."""
    o = F.col("offset")
    return offsets.join(catalogue, (o >= F.col("global_start")) & (o < F.col("global_end"))).select("offset", "shard_idx", (o - F.col("global_start")).alias("local_row"))


def contiguous_prefix(shards: DataFrame) -> DataFrame:
    """(prefix): how many shards there are from number 0 on without a gap."""
    r = shards.select("shard_idx").distinct().withColumn("i", F.row_number().over(Window.orderBy("shard_idx")) - 1)
    return r.agg(F.count_if(F.col("shard_idx") == F.col("i")).alias("prefix"))


def first_of(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """The first row of each key by the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def id_digest(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """(sha256): of the keys in order, joined by newlines: one long string, so the list must fit a task (``fingerprint`` is for longer ones)."""
    keys = df.agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), key.cast("string").alias("k")))).alias("l"))
    return keys.select(F.sha2(F.array_join(F.transform("l", lambda x: x["k"]), "\n"), 256).alias("sha256"))


def fingerprint(df: DataFrame, key: Column, order: Column, buckets: int = 4096) -> DataFrame:
    """(sha256): a digest of the keys in order.

    Keys are digested in runs of consecutive hash buckets first and the digests
    then digested, so no task holds the whole list; it changes whenever a key
    or a place does.
    """
    r = df.select(key.cast("string").alias("k"), order.alias("o")).withColumn("b", F.pmod(F.xxhash64("o"), F.lit(buckets)))
    part = r.groupBy("b").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat(F.col("o").cast("string"), F.lit(":"), F.col("k"))))), 256).alias("h"))
    return part.agg(F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])), 256).alias("sha256"))


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
