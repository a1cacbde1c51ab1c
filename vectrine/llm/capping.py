"""Capping records per dominant contributor.

Method: rank the records of a contributor by quality and identifier and keep
the ranks up to the cap.  A contributor may hold a third of all rows, so its
records are ranked first within salts of the record id, whose number grows with
the rows; only the records that survive there, at most ``cap`` a salt, meet in
the second ranking.

A cap that is itself a share of all rows lets every record of a salt survive.
Then the survivors are ranked over ranges instead: a range of the order
(contributor, quality, record) is a partition, so a dominant contributor spans
as many as it needs, and the ranks within a range are moved on by what the
ranges before it hold of the contributor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.plans.materialize import Scratch

#: Salts of the first ranking at least, and the records of all contributors a salt holds at most about.
SALTS, SALT_ROWS = 32, 1 << 22
#: Survivors of a contributor that one task ranks at most.
TASK_ROWS = 1 << 20


def contributor_key(source: Column, doc_id: Column) -> Column:
    """One spelling for a source id: upper case, trimmed, with its letter ``D``.

    A null or blank source is taken from ``doc_id`` before ``::``; without
    either, the result is null.
    """
    clean = lambda c: F.upper(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    own = F.nullif(clean(source), F.lit(""))
    from_doc = F.when(doc_id.contains("::"), F.nullif(clean(F.split_part(doc_id, F.lit("::"), F.lit(1))), F.lit("")))
    key = F.coalesce(own, from_doc)
    return F.when(key.rlike("^[0-9]+$"), F.concat(F.lit("D"), key)).otherwise(key)


def _ranked_by_range(rows: DataFrame, order: tuple[Column, ...]) -> DataFrame:
    """``rank`` of each row (contributor, quality, record) within its contributor, however many it has."""
    scratch = Scratch(rows.sparkSession)
    spread = scratch.cut(rows.repartitionByRange("contributor", *order).withColumn("part", F.spark_partition_id()))
    count = spread.groupBy("part", "contributor").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("contributor").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = count.select("part", "contributor", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    local = spread.withColumn("rank", F.row_number().over(Window.partitionBy("part", "contributor").orderBy(*order)))
    return local.join(before, ["part", "contributor"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("int")).drop("part", "before")


def cap_per_contributor(
    df: DataFrame,
    contributor: Column,
    record: Column,
    quality: Column,
    max_count: int | None = None,
    max_share: float | None = None,
    salts: int = SALTS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(contributor, record, quality, rank, kept): every record, and whether it stays.

    The order within a contributor is quality from high to low, nulls and NaN
    last, then the smaller record id.  ``max_share`` limits a contributor to
    that share of all distinct records, rounded down, but never below one; with
    both limits the smaller holds.  ``rank`` is null for records that are
    beyond the cap already within their salt.

    A record that is repeated counts once, with its best quality.  Records
    without a contributor aren't capped: they are kept with a null rank.  Rows
    without a record id are left out.  An empty table gives an empty result.
    Other columns of ``df`` play no part, whatever their names.
    """
    if max_count is None and max_share is None:
        raise ValueError("give max_count or max_share")
    q = quality.cast("double")
    rows = df.select(contributor.alias("contributor"), record.alias("record"), F.when(~F.isnan(q), q).alias("quality"))
    rows = rows.filter(F.col("record").isNotNull())
    cap = max_count
    if max_share is not None:
        total = rows.select(F.count_distinct("contributor", "record")).first()[0]
        share = max(1, int(max_share * total))
        cap = share if cap is None else min(cap, share)
    salts = max(salts, df.count() // SALT_ROWS)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(salts)).cast("int"))
    # one exchange serves the removal of repeats and the first ranking
    once = rows.repartition("contributor", "salt").groupBy("contributor", "salt", "record").agg(F.max("quality").alias("quality"))
    order = (F.col("quality").desc_nulls_last(), F.col("record").asc())
    pre = once.withColumn("pre", F.row_number().over(Window.partitionBy("contributor", "salt").orderBy(*order)))
    named = pre.filter(F.col("contributor").isNotNull())
    live = named.filter(F.col("pre") <= cap).select("contributor", "record", "quality")
    if cap * salts <= task_rows:
        live = live.withColumn("rank", F.row_number().over(Window.partitionBy("contributor").orderBy(*order)))
    else:
        live = _ranked_by_range(live, order)
    out = live.select("contributor", "record", "quality", "rank", (F.col("rank") <= cap).alias("kept"))
    lost = named.filter(F.col("pre") > cap).select("contributor", "record", "quality", F.lit(None).cast("int").alias("rank"), F.lit(False).alias("kept"))
    free = once.filter(F.col("contributor").isNull()).select("contributor", "record", "quality", F.lit(None).cast("int").alias("rank"), F.lit(True).alias("kept"))
    return out.unionByName(lost).unionByName(free)
