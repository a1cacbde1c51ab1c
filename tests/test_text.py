import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrine.operators import text as tx


def test_windows_cover_all_sentences_and_overlap():
    cfg = tx.PassageConfig()
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(1, 90, rng.integers(1, 40)).tolist()
        w = tx.windows(sizes, cfg)
        assert w[0][0] == 0 and w[-1][1] == len(sizes)
        assert all(b > a for a, b in w) and all(y[0] > x[0] and y[0] <= x[1] for x, y in zip(w, w[1:]))
        assert all(b - a <= cfg.max_sentences for a, b in w)


def test_cleaning_and_sentences(spark):
    t = "  Step 3: mix it. Then wait; 2) pour\n\nit! A12 stays - "
    d = spark.createDataFrame([(t,), (None,), ("",), ("\t \n",)], "t string")
    got = [r.s for r in d.select(tx.sentences(F.col("t")).alias("s")).collect()]
    assert got[0][:3] == [".", "mix it.", "Then wait"] or got[0][0].startswith("mix")
    assert got[1:] == [[], [], []]
    assert [r.c for r in d.select(tx.clean_text(F.col("t")).alias("c")).collect()][1:] == ["", "", ""]


def test_simhash_by_its_definition():
    import hashlib

    def plain(words):
        v = [0] * 64
        for w in words:
            h = int.from_bytes(hashlib.sha1(w.encode()).digest()[:8], "big")
            for b in range(64):
                v[b] += 1 if h >> b & 1 else -1
        u = sum(1 << b for b in range(64) if v[b] >= 0) if words else 0
        return u - (1 << 64) if u >> 63 else u

    for words in ([], ["a"], ["a", "b"], "the quick brown fox the fox".split()):
        assert tx.simhash(words) == plain(words)


@pytest.mark.parametrize("seed", range(3))
def test_two_tiers_equal_the_serial_order(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 6)
    rows = []
    for i in range(80):
        h = int(base[rng.integers(6)])
        for _ in range(rng.integers(0, 4)):
            h ^= 1 << int(rng.integers(0, 63))
        rows.append((i, f"s{rng.integers(3)}", h))
    kept, hashes, want = [], {}, {}
    for i, s, h in rows:
        if any((h ^ p).bit_count() <= 3 for p in hashes.setdefault(s, [])):
            want[i] = "within_source"
        else:
            hashes[s].append(h)
            if any(h >> 48 == p >> 48 and (h ^ p).bit_count() <= 2 for p in kept):
                want[i] = "global"
            else:
                kept.append(h)
                want[i] = None
    got = {r.ord: r.removed for r in tx.two_tier_dedup(spark.createDataFrame(rows, "ord long, source string, simhash long")).collect()}
    assert got == want


def test_passages_of_empty_and_long_texts(spark):
    long = "One sentence of some words here. " * 400
    d = spark.createDataFrame([("a", long), ("b", None), ("c", " "), ("d", "word")], "d string, t string")
    got = tx.passages(d, F.col("d"), F.col("t")).toPandas()
    assert set(got.source_doc_id) == {"a", "d"}
    assert (got.doc_id == got.source_doc_id + "::p" + got.unit_no.astype(str)).all()
    assert got[got.source_doc_id == "a"].text.map(lambda x: len(re.findall("[a-z0-9]+", x.lower()))).max() <= 256


def test_compose_leaves_out_empty_parts(spark):
    d = spark.createDataFrame([("a ", None, "\r\nb")], "x string, y string, z string")
    assert d.select(tx.compose(F.col("x"), F.col("y"), F.col("z")).alias("t")).first().t == "a\n\nb"
