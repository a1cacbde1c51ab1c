"""Repetition inside a single document.

Method: n-gram perplexity.  Each document gets its perplexity under a modified
Kneser-Ney model of its language, counted over the whole corpus (ngram_model);
a document outside its language's band is rejected.  A document that says the
same over and over has seen its own n-grams before, so its perplexity is low.

No perplexity bounds the share of a text that is repetition, so the share of
repeated character windows is measured exactly, for every text, whatever its
verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.functions.arrow_vectors import flat, take
from vectrine.llm.ngram_model import SLICE, perplexities
from vectrine.llm.text import collapse, slices, span_hashes
from vectrine.plans.materialize import Scratch


@dataclass(frozen=True)
class RepetitionConfig:
    """A document is rejected if the logarithm of its perplexity is further than ``spread`` deviations from its language's median.

    The deviation is 1.4826 times the median distance from the median, so a
    band rejects few, however many documents are odd.  A language of fewer than
    ``least_documents`` different texts, or beyond the ``most_languages`` of
    most texts, shares one model and band with its like; 0 gives each of the
    most common languages its own.  Windows are of ``window`` characters; texts
    of fewer than ``least_chars`` have no share.
    """

    spread: float = 3.0
    least_documents: int = 50
    most_languages: int = 1024
    window: int = 30
    least_chars: int = 100
    #: n-grams a bucket of the model holds, about.
    bucket_rows: int = 1 << 17


def repeated_share(text: str | None, window: int = 30, least: int = 100) -> float | None:
    """1 - distinct / all windows of consecutive characters of the lower-cased text with single blanks; None below ``least`` characters."""
    plain = collapse(text).lower()
    if len(plain) < max(least, window):
        return None
    data = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(data) - window + 1
    at = np.arange(n)
    h = np.sort(span_hashes(data, at, at + window))
    return 1 - (1 + int((h[1:] != h[:-1]).sum())) / n


def _shares(cfg: RepetitionConfig):
    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 1, size=SLICE)):
            texts = flat(b.column(1)).to_pylist()
            said = np.flatnonzero([bool(collapse(t)) for t in texts])
            share = [repeated_share(texts[i], cfg.window, cfg.least_chars) for i in said]
            yield pa.record_batch([take(b.column(0), said), pa.array(share, pa.float64())], ["rep", "share"])

    return run


def repetition(df: DataFrame, record: Column, text: Column, lang: Column, cfg: RepetitionConfig = RepetitionConfig()) -> DataFrame:
    """(id, perplexity, verdict, share): one row a document with a text.

    ``verdict`` is 'low', 'high' or 'kept' by the band of the document's
    language (spelling aside; null is a language of its own), null for a text
    without a token; ``share`` is the repeated share of every document, null
    for short texts only.  Copies of a text are one text, in the language that
    its smallest id names.  Null, empty and blank texts, and rows without an
    id, are left out.  Ids should be unique.  An empty table gives an empty
    result.  Texts are read whole.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(record.alias("id"), text.alias("t"), F.coalesce(F.lower(F.trim(lang)), F.lit("")).alias("lang")).filter("t is not null and id is not null").withColumn("key", F.sha2("t", 256))
    texts = scratch.cut(rows.groupBy("key").agg(F.min("id").alias("rep"), F.first("t").alias("t"), F.min_by("lang", "id").alias("lang")))
    own = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= cfg.least_documents).orderBy(F.desc("n"), "lang").limit(cfg.most_languages).collect()
    table = F.broadcast(spark.createDataFrame([(r.lang, i + 1) for i, r in enumerate(own)], "lang string, model int"))
    texts = texts.join(table, "lang", "left").select("key", "rep", "t", F.coalesce("model", F.lit(0)).alias("model"))
    kind = rows.schema["id"].dataType.simpleString()
    shares = texts.select("rep", "t").mapInArrow(_shares(cfg), f"rep {kind}, share double")
    scores = perplexities(texts, F.col("rep"), F.col("t"), F.col("model"), len(own) + 1, cfg.bucket_rows).select(F.col("row").alias("rep"), F.log("perplexity").alias("p"))
    measured = scratch.cut(texts.select("key", "rep", "model").join(shares, "rep").join(scores, "rep", "left"))
    middle = measured.groupBy("model").agg(F.percentile_approx("p", 0.5, 10000).alias("m"))  # one row a model, as below
    off = measured.join(F.broadcast(middle), "model").withColumn("off", F.col("p") - F.col("m"))
    wide = off.groupBy("model").agg(F.percentile_approx(F.abs("off"), 0.5, 10000).alias("d"))
    far = cfg.spread * 1.4826 * F.col("d")
    verdict = F.when(F.col("off") < -far, "low").when(F.col("off") > far, "high").when(F.col("off").isNotNull(), "kept")
    judged = off.join(F.broadcast(wide), "model").select("key", F.exp("p").alias("perplexity"), verdict.alias("verdict"), "share")
    return rows.select("id", "key").join(judged, "key").select("id", "perplexity", "verdict", "share")
