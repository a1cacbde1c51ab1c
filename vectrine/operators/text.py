"""Text preparation: cleaning, sentences, passages, 64-bit similarity hashes and their near-duplicates."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.functions.arrow_vectors import flat
from vectrine.plans.materialize import Scratch

#: What counts as white space, also beyond ASCII.
WHITE = r"[\s\p{Z}\x0b\x85\x1c-\x1f]"

# The patterns that fold step marks and list numbers into
# sentence ends, that end sentences, and the signs that are stripped from them.
STEP_MARK = r"(?i)\bstep\s+\d+[.:)]?\s*"
LIST_NUMBER = r"(?<![A-Za-z])\d+[.)]?\s+"
SENTENCE_END = r"(?<=[.!?;])\s+"
STRIPPED = " -;:,"


def clean_text(text: Column) -> Column:
    """White-space runs as one blank, none at the ends; an empty string for null."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE}+", " "))


def clean_lines(text: Column) -> Column:
    """Line ends as line feeds, and no white space at the ends; an empty string for null."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), f"^{WHITE}+|{WHITE}+$", "")


def tokens(text: Column) -> Column:
    """Runs of ``[a-z0-9]`` in the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """The sentences of a text, cleaned; step marks and list numbers end a sentence."""
    folded = F.regexp_replace(F.regexp_replace(clean_text(text), STEP_MARK, ". "), LIST_NUMBER, ". ")
    return F.filter(F.transform(F.split(folded, SENTENCE_END), lambda s: F.btrim(clean_text(s), F.lit(STRIPPED))), lambda s: s != "")


def compose(*parts: Column, separator: str = "\n\n") -> Column:
    """The parts that aren't empty, cleaned and joined."""
    return F.concat_ws(separator, *(F.nullif(clean_lines(p), F.lit("")) for p in parts))


@dataclass(frozen=True)
class PassageConfig:
    """The window sizes of the main configuration."""

    min_tokens: int = 96
    target_tokens: int = 192
    max_tokens: int = 256
    min_sentences: int = 3
    max_sentences: int = 6
    stride: int = 2
    overlap_tokens: int = 40


def windows(sizes: list[int], cfg: PassageConfig) -> list[tuple[int, int]]:
    """Sentence windows [first, end) over sentences of the given token counts.

    A window closes at the sentence count limit, at the token target (once the
    least sentences and tokens are in), or before a sentence that would exceed
    the token limit.  The next one starts where about ``overlap_tokens`` before
    the end begin, but at least ``stride`` sentences on.
    """
    n, first, out = len(sizes), 0, []
    least = max(1, cfg.min_sentences)
    step = max(2, cfg.stride)
    floor = max(8, cfg.min_tokens)
    target = max(floor, cfg.target_tokens)
    top = max(target, cfg.max_tokens)
    while first < n:
        total, end = sizes[first], first + 1
        closed = end - first >= least and total >= target
        while not closed and end < min(n, first + max(least, cfg.max_sentences)):
            if end - first >= least and total + sizes[end] > top:
                break
            total += sizes[end]
            end += 1
            closed = end - first >= least and total >= target
        out.append((first, end))
        if end >= n:
            break
        back, held = end, 0
        while back > first and held < cfg.overlap_tokens:
            back -= 1
            held += sizes[back]
        at = max(back, first + step)
        first = at if at < end else min(n, first + step)
    return out


_TOKEN = re.compile("[a-z0-9]+")


def _passages(cfg: PassageConfig):
    def run(batches):
        for b in batches:
            ids, nos, texts = [], [], []
            for i, whole, parts in zip(*(flat(b.column(c)).to_pylist() for c in range(3))):
                parts = parts or [whole]
                seen: dict[str, None] = {}
                for a, z in windows([max(1, len(_TOKEN.findall(p.lower()))) for p in parts], cfg):
                    seen[" ".join(parts[a:z]).strip()] = None
                kept = [t for t in seen if t] or [whole]
                ids += [i] * len(kept)
                nos += range(len(kept))
                texts += kept
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(nos, pa.int32()), pa.array(texts, pa.string())], ["source_doc_id", "unit_no", "text"])

    return run


def passages(df: DataFrame, doc_id: Column, text: Column, cfg: PassageConfig = PassageConfig()) -> DataFrame:
    """(doc_id, source_doc_id, unit_no, text): sentence windows of each document; a repeated window counts once; empty documents give none."""
    rows = df.select(doc_id.cast("string").alias("d"), clean_text(text).alias("t")).filter("d is not null and t <> ''").withColumn("s", sentences(F.col("t")))
    out = rows.mapInArrow(_passages(cfg), "source_doc_id string, unit_no int, text string")
    return out.select(F.concat("source_doc_id", F.lit("::p"), F.col("unit_no").cast("string")).alias("doc_id"), "source_doc_id", "unit_no", "text")


def duplicate_ids(df: DataFrame, doc_id: Column) -> DataFrame:
    """(doc_id, n): ids that stand more than once."""
    return df.groupBy(doc_id.alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@lru_cache(maxsize=1 << 20)
def _token_hash(token: str) -> int:
    return int.from_bytes(hashlib.sha1(token.encode()).digest()[:8], "big")


def simhashes(lists: list[list[str] | None]) -> np.ndarray:
    """64-bit similarity hashes as signed numbers: a bit is set where the tokens' hashes have it at least as often as not; 0 without tokens."""
    counts = np.array([len(w or []) for w in lists], np.int64)
    out = np.zeros(len(lists), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        h = np.fromiter((_token_hash(w) for i in full for w in lists[i]), np.uint64, counts.sum())
        at = np.cumsum(counts[full]) - counts[full]
        for bit in range(64):
            ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), at)
            out[full] |= (2 * ones >= counts[full]).astype(np.uint64) << np.uint64(bit)
    return out.view(np.int64)


def simhash(words: list[str]) -> int:
    return int(simhashes([words])[0])


def _simhashes(batches):
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array(simhashes(flat(b.column(1)).to_pylist()), pa.int64())], ["id", "simhash"])


def simhash64(df: DataFrame, record: Column, words: Column) -> DataFrame:
    """(id, simhash) of each row's tokens (``tokens`` or ``whitespace_tokens``)."""
    rows = df.select(record.alias("id"), words.alias("w"))
    return rows.mapInArrow(_simhashes, f"id {rows.schema['id'].dataType.simpleString()}, simhash long")


def whitespace_tokens(text: Column) -> Column:
    """What white space separates, lower-cased."""
    return F.filter(F.split(F.lower(clean_text(text)), " "), lambda w: w != "")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_pairs(df: DataFrame, most: int, within: str | None = None, prefix_bits: int = 0) -> DataFrame:
    """(a, b): records (ord, simhash[, within]), a before b, whose hashes differ in at most ``most`` bits.

    The hash is cut into most + 1 parts: hashes that differ in ``most`` bits
    agree in one of them, so pairs are met by joins on a part, never by a cross
    of a group.  With ``prefix_bits``, the first bits must agree.
    """
    rest, parts = 64 - prefix_bits, most + 1
    edges = [rest * i // parts for i in range(parts + 1)]
    part = [F.shiftrightunsigned("simhash", lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:])]
    keys = ["no", "part", *([within] if within else [])]
    rows = df.select("ord", "simhash", *([within] if within else []), F.posexplode(F.array(*part)).alias("no", "part"))
    if prefix_bits:
        rows = rows.withColumn("prefix", F.shiftrightunsigned("simhash", rest))
        keys.append("prefix")
    a = rows.select(F.col("ord").alias("a"), F.col("simhash").alias("ha"), *keys)
    b = rows.select(F.col("ord").alias("b"), F.col("simhash").alias("hb"), *keys)
    return a.join(b, keys).filter((F.col("a") < F.col("b")) & (hamming(F.col("ha"), F.col("hb")) <= most)).select("a", "b").distinct()


def keep_first(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ord): records that survive when, in order, each goes if an earlier survivor is its pair.

    ids(ord), pairs(a, b), a before b.  In rounds: a record without an earlier
    open pair stays, and what follows a staying record goes.
    """
    scratch = Scratch(ids.sparkSession)
    open_pairs = scratch.cut(pairs)
    gone = None
    while True:
        # sure to stay: the first of some pair, and the second of none that is open
        stays = open_pairs.select(F.col("a").alias("ord")).distinct().join(open_pairs.select(F.col("b").alias("ord")), "ord", "left_anti")
        goes = scratch.cut(open_pairs.join(stays.withColumnRenamed("ord", "a"), "a", "left_semi").select(F.col("b").alias("ord")).distinct())
        if goes.isEmpty():
            break
        if gone is None:
            gone = goes
        else:
            before, gone = gone, scratch.cut(gone.unionByName(goes))
            scratch.free(before)
        left = open_pairs.join(goes.withColumnRenamed("ord", "a"), "a", "left_anti").join(goes.withColumnRenamed("ord", "b"), "b", "left_anti")
        before, open_pairs = open_pairs, scratch.cut(left)
        scratch.free(before)
    return ids.select("ord") if gone is None else ids.select("ord").join(gone, "ord", "left_anti")


def two_tier_dedup(df: DataFrame, within_bits: int = 3, global_bits: int = 2, prefix_bits: int = 16) -> DataFrame:
    """(ord, removed): near-duplicates within a source, then among the rest with equal first bits; ``removed`` is 'within_source', 'global' or null.

    df(ord, source, simhash), one row a record.  Records of equal hash are
    settled first (the earliest stays), so only different hashes are joined.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.cut(df.select("ord", "source", "simhash"))
    one = scratch.cut(rows.groupBy("source", "simhash").agg(F.min("ord").alias("ord")))
    kept = scratch.cut(one.join(keep_first(one, hamming_pairs(one, within_bits, "source")), "ord", "left_semi"))
    first = kept.groupBy("simhash").agg(F.min("ord").alias("ord"))
    final = scratch.cut(keep_first(first, hamming_pairs(first, global_bits, None, prefix_bits)))
    k = kept.select("ord", F.lit(1).alias("k"))
    f = final.select("ord", F.lit(1).alias("f"))
    return rows.join(k, "ord", "left").join(f, "ord", "left").select("ord", F.when(F.col("k").isNull(), "within_source").when(F.col("f").isNull(), "global").alias("removed"))
