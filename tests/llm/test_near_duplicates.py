import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrine.llm.near_duplicates import NearDuplicateConfig, min_max, near_duplicates
from vectrine.llm.text import shingles, words

CFG = NearDuplicateConfig(width=3, least_words=8, similarity=0.6)


def brute(rows, cfg):
    sh = {}
    for i, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if i is not None and len(w) >= max(cfg.least_words, cfg.width):
            sh[i] = set(zip(*(w[j:] for j in range(cfg.width))))
    ids = sorted(sh)
    return sh, {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sh[a] & sh[b]) >= cfg.similarity * len(sh[a] | sh[b])}


def corpus(rng):
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(40):
        t = list(rng.choice(vocab, rng.integers(8, 60)))
        for _ in range(rng.integers(1, 5)):
            u = list(t)
            for _ in range(rng.integers(0, 4)):
                u[rng.integers(len(u))] = str(rng.choice(vocab))
            rows.append((len(rows), " ".join(u)))
    hot = " ".join(rng.choice(vocab, 30))
    rows += [(len(rows) + i, hot.upper() if i % 2 else f"<b>{hot}</b>".replace("b", "")) for i in range(60)]
    return rows


@pytest.mark.parametrize("cfg", [CFG, NearDuplicateConfig()])
def test_pairs_and_links_against_brute_force(spark, rng, cfg):
    rows = corpus(rng) + [(5000, None), (5001, ""), (5002, "too short"), (None, "a b c d e f g h i"), (5003, "é日本 " * 50)]
    d = spark.createDataFrame(rows + rows[:20], "id long, text string").withColumns({"a": F.lit(1), "key": F.lit("x"), "representative": F.lit(0)})
    nd = near_duplicates(d, F.col("id"), F.col("text"), cfg)
    sh, want = brute(rows, cfg)
    got = [(r.a, r.b) for r in nd.expanded().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = {r.id: r.links for r in nd.links().collect()}
    assert links == {i: sum(i in p for p in want) for i in sh}


def test_very_long_text_and_empty_table(spark):
    long = " ".join(f"t{i}" for i in range(200_000))
    d = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x " * 10)], "id long, text string")
    assert [(r.a, r.b) for r in near_duplicates(d, F.col("id"), F.col("text"), CFG).expanded().collect()] == [(1, 2)]
    assert near_duplicates(d.filter("id > 9"), F.col("id"), F.col("text"), CFG).expanded().count() == 0


def test_min_and_max_estimate_the_similarity(rng):
    a, b = rng.integers(0, 1 << 63, 300, dtype=np.uint64), rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    x, y = np.concatenate([a, b[:50]]), np.concatenate([a, b[50:]])
    s = min_max(np.concatenate([x, y]), np.array([0, len(x)]), 400, 1)
    assert abs((s[0] == s[1]).mean() - 300 / 400) < 0.06


def test_words_by_their_definition():
    texts = ["Hello, World! 42", None, "", "İstanbul K9 straße", "a" * 1000, "x-y_z"]
    h, n = words(texts)
    want = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    assert n.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(h.tolist())) == len(set(flat)) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    o, s, r = shingles(*words(["a b c a b c a b c"]), 3, 3)
    assert len(s) == 3 and r.tolist() == [0]


def test_the_exact_way_finds_what_bands_miss(spark, rng):
    """With a single band of many rows hardly any pair is a candidate."""
    rows = corpus(rng)
    d = spark.createDataFrame(rows, "id long, text string")
    poor = {"width": 3, "least_words": 8, "similarity": 0.6, "bands": 1, "band_rows": 40}
    got = {k: {(r.a, r.b) for r in near_duplicates(d, F.col("id"), F.col("text"), NearDuplicateConfig(exact=k, **poor)).expanded().collect()} for k in (False, True)}
    assert got[False] < got[True] == brute(rows, CFG)[1]
