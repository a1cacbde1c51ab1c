import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrine.llm.ngram_model import perplexities, tokens
from vectrine.llm.repetition import RepetitionConfig, repeated_share, repetition


def brute_share(t):
    t = " ".join(t.split()).lower()
    w = [t[i : i + 30] for i in range(len(t) - 29)]
    return None if len(t) < 100 else 1 - len(set(w)) / len(w)


def corpus(rng):
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 10))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    rows, want = [], set()
    for i in range(160):
        t = say(rng.integers(30, 120))
        if i % 8 == 0:
            s = say(12) + ". "
            t = t + " " + s * 12
        rows.append((i, t, ["en", "EN", "de", None][i % 4]))
    rows += [(500, "spam " * 100, "en"), (501, "価格靴台所窓家" * 30, "ja"), (502, "x" * 3000, "en")]
    return rows


def test_found_documents_against_brute_force(spark, rng):
    rows = corpus(rng)
    extra = [(900, None, "en"), (901, "", "en"), (902, "  \n", None), (None, "text without an id " * 20, "en"), (903, "short", "en")]
    d = spark.createDataFrame(rows + extra, "doc long, text string, lang string").withColumns({"id": F.lit("x"), "n": F.lit(1), "share": F.lit(2)})
    got = repetition(d, F.col("doc"), F.col("text"), F.col("lang"), RepetitionConfig(bucket_rows=500)).toPandas()
    assert got.id.is_unique and not set(got.id) & {900, 901, 902} and got.id.notna().all()
    assert set(got[got.share >= 0.25].id) == {i for i, t, _ in rows if (brute_share(t) or 0) >= 0.25}
    for r in got[got.share.notna()].itertuples():
        assert r.share == pytest.approx(brute_share(dict((a, b) for a, b, _ in rows)[r.id]))


def test_copies_hide_no_repetitive_document(spark, rng):
    """Half of the language's rows are copies of a repetitive text; a tokenless one repeats too."""
    rows = [(i, t, "en") for i, t, _ in corpus(rng) if i < 500]
    rows += [(1000 + i, rows[8][1], "en") for i in range(200)] + [(2000, "\x01" * 200, "en")]
    d = spark.createDataFrame(rows, "doc long, text string, lang string")
    got = repetition(d, F.col("doc"), F.col("text"), F.col("lang"), RepetitionConfig(bucket_rows=500)).toPandas()
    assert set(got[got.share >= 0.25].id) == {i for i, t, _ in rows if brute_share(t) >= 0.25}
    assert set(got[got.verdict == "low"].id) >= {1000 + i for i in range(200)}


def test_kept_documents_have_a_share(spark, rng):
    rows = corpus(rng)
    d = spark.createDataFrame(rows, "doc long, text string, lang string")
    got = repetition(d, F.col("doc"), F.col("text"), F.col("lang"), RepetitionConfig(bucket_rows=500)).toPandas().set_index("id")
    assert (got.verdict == "kept").any()
    assert got.share.to_dict() == pytest.approx({i: brute_share(t) for i, t, _ in rows})


def test_shares_by_their_definition():
    for t in ("ab " * 50, "word " * 200, "x" * 500, "Abc dEf\n" * 40, "é日" * 80, "short", ""):
        assert repeated_share(t) == (None if brute_share(t) is None else pytest.approx(brute_share(t)))
    assert repeated_share(None) is None


class BruteModel:
    """Modified Kneser-Ney of orders 5 to 1, by its definition, with strings and dictionaries."""

    def __init__(self, texts):
        self.counts = [Counter() for _ in range(5)]  # orders 1 to 5
        for t in texts:
            w = ["^"] * 4 + t.split()
            for i in range(4, len(w)):
                self.counts[4][tuple(w[i - 4 : i + 1])] += 1
        for k in (3, 2, 1, 0):
            for g in self.counts[k + 1]:
                self.counts[k][g[1:]] += 1
        self.d = []
        for c in self.counts:
            n = [max(1, sum(v == r for v in c.values())) for r in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            self.d.append([0, *(min(max(r - (r + 1) * y * n[r] / n[r - 1], 0.1), r - 0.05) for r in (1, 2, 3))])
        self.after = [{} for _ in range(5)]
        for k, c in enumerate(self.counts):
            for g, v in c.items():
                self.after[k].setdefault(g[:-1], []).append(v)

    def chance(self, g):
        k = len(g) - 1
        if k < 0:
            return 1 / len(self.counts[0])
        here, d, v = self.after[k][g[:-1]], self.d[k], self.counts[k][g]
        return (v - d[min(v, 3)]) / sum(here) + sum(d[min(x, 3)] for x in here) / sum(here) * self.chance(g[1:])

    def perplexity(self, t):
        w = ["^"] * 4 + t.split()
        return math.exp(-sum(math.log(self.chance(tuple(w[i - 4 : i + 1]))) for i in range(4, len(w))) / (len(w) - 4))


@pytest.mark.parametrize("bucket_rows", [40, 1 << 18])
def test_perplexities_against_brute_force(spark, rng, bucket_rows):
    """Small buckets split the frequent words; both languages have a model of their own."""
    vocab = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(60)]
    chance = 1 / np.arange(1, 61)
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(1, 60), p=chance / chance.sum())), i % 2) for i in range(80)]
    d = spark.createDataFrame(rows + [(90, "", 0), (91, None, 1)], "i long, t string, m int")
    got = perplexities(d, F.col("i"), F.col("t"), F.col("m"), 2, bucket_rows).toPandas().set_index("row").perplexity.to_dict()
    models = [BruteModel([t for _, t, m in rows if m == k]) for k in (0, 1)]
    assert got == pytest.approx({i: models[m].perplexity(t) for i, t, m in rows})
    for g in list(models[0].after[2])[:50]:  # the chances after a context add up to one
        assert sum(models[0].chance((*g, w)) for (w,) in models[0].counts[0] ) == pytest.approx(1)


def test_bands_reject_few(spark, rng):
    rows = corpus(rng)
    d = spark.createDataFrame(rows, "doc long, text string, lang string")
    got = repetition(d, F.col("doc"), F.col("text"), F.col("lang"), RepetitionConfig(least_documents=20)).toPandas()
    assert 0 < (got.verdict != "kept").mean() < 0.3


def test_empty_corpus_and_tokens(spark):
    d = spark.createDataFrame([], "i long, t string, l string")
    assert repetition(d, F.col("i"), F.col("t"), F.col("l")).count() == 0
    t, n = tokens(["hello, internationalisation 日本", "", "a1"])
    assert n.tolist() == [7, 0, 1] and len(t) == 8


def test_languages_of_few_texts_and_null_columns(spark):
    """Every label is odd: one model serves them all; a text without tokens has no verdict."""
    rows = [(i, f"some words of text number {i} and a few more", f"l{i}") for i in range(12)] + [(50, "\x01\x02", None), (51, None, None), (None, None, None)]
    d = spark.createDataFrame(rows, "doc long, text string, lang string").withColumns({"model": F.lit(1), "rep": F.lit("x"), "key": F.lit(2)})
    for least in (0, 50):
        got = repetition(d, F.col("doc"), F.col("text"), F.col("lang"), RepetitionConfig(least_documents=least)).toPandas().set_index("id")
        assert set(got.index) == {*range(12), 50} and got.loc[range(12), "perplexity"].notna().all() and got.share.isna().all()
        assert got.loc[50, "verdict"] is None or got.loc[50, "verdict"] != got.loc[50, "verdict"] or got.loc[50, "perplexity"] > 0
