import re

import numpy as np
from pyspark.sql import functions as F

from vectrine.llm.split_overlap import OverlapConfig, chunk_spans, similar_classes, split_overlaps

SCHEMA = "i long, q string, s string, split string, text string, v array<float>, train string, digest int"


def run(spark, rows):
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = split_overlaps(d, F.col("i"), F.coalesce("s", "q"), F.col("split"), F.col("text"), F.col("v")).pairs().collect()
    return {(r.train_id, r.held_id): (r.by_id, r.by_text, r.by_vector) for r in got}


def brute(rows):
    tidy = lambda x: (x or "").strip().lower()
    gram = lambda t: {w[j : j + 3] for w in [" ".join(re.findall("[a-z0-9]+", (t or "").lower()))] for j in range(len(w) - 2)}
    ok = lambda v: v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v)
    one = {r[0]: r for r in rows if r[0] is not None}
    out = {}
    for a in one.values():
        for b in one.values():
            if tidy(a[3]) == "train" and tidy(b[3]) in ("calibration", "evaluation"):
                ia, ib, ga, gb = tidy(a[2] if a[2] is not None else a[1]), tidy(b[2] if b[2] is not None else b[1]), gram(a[4]), gram(b[4])
                f = (ia == ib != "", bool(ga | gb) and len(ga & gb) >= 0.7 * len(ga | gb), bool(ok(a[5]) and ok(b[5]) and np.dot(a[5], b[5]) >= 0.97 * np.linalg.norm(a[5]) * np.linalg.norm(b[5])))
                if any(f):
                    out[a[0], b[0]] = f
    return out


def test_against_brute_force(spark, rng):
    vocab = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(300)]
    rows = []
    for base in range(60):
        t = list(rng.choice(vocab, rng.integers(4, 12)))
        v = rng.standard_normal(64)
        for c in range(3):
            u = list(t)
            if c:
                k = rng.integers(len(u))
                u[k] = u[k][:-1] + "z" if rng.random() < 0.7 else str(rng.choice(vocab))
            split = str(rng.choice(["train", " Train ", "EVALUATION", "calibration\t"]))
            rows.append((len(rows), f"q{len(rows)}", f" Q{base}" if rng.random() < 0.2 else None, split, " ".join(u), (v + rng.choice([0, 0.15, 0.5]) * rng.standard_normal(64)).tolist()))
    rows += [(900, "a", None, None, "same text here", None), (901, None, None, "train", None, None), (902, None, None, "evaluation", "", [0.0] * 64), (903, "", None, "train", "!!", [1.0] * 5), (904, "", None, "evaluation", "??", None), (None, "q1", None, "train", rows[0][4], None)]
    hot = "how to clean the very old copper kettle"
    rows += [(1000 + i, f"h{i}", None, "train" if i % 5 else "evaluation", hot.title() if i % 2 else hot, np.eye(64)[3].tolist()) for i in range(60)]
    assert run(spark, rows + rows[:10]) == brute(rows)


def test_records_against_brute_force(spark, rng):
    vocab = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(40)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    shared = [say(8) for _ in range(5)]
    rows = [(i, f"q{i}", f"s{i % 11}" if i % 4 == 0 else None, ("train", "evaluation", None)[i % 3], f"{say(6)} {shared[i % 5]} {say(6)}" if i % 7 else None, rng.standard_normal(64).tolist()) for i in range(90)]
    rows += [(200 + i, f"h{i}", "hot", "train" if i % 2 else "calibration", "copied", None) for i in range(40)]
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    o = split_overlaps(d, F.col("i"), F.coalesce("s", "q"), F.col("split"), F.col("text"), F.col("v"))
    got = {r.held_id: r for r in o.records().collect()}
    pairs = brute(rows)
    assert set(got) == {r[0] for r in rows if r[3] in ("calibration", "evaluation")}
    for i, r in got.items():
        mine = [f for (_, b), f in pairs.items() if b == i]
        assert (r.by_id, r.by_text, r.by_vector) == tuple(any(f[k] for f in mine) for k in range(3))

    def chunks(t):
        o, k, n = chunk_spans([t or ""], OverlapConfig())
        return list(zip(k.tolist(), n.tolist()))

    train = {k for r in rows if r[3] == "train" for k, _ in chunks(r[4])}
    for r in rows:
        if r[0] in got:
            c = chunks(r[4])
            assert (got[r[0]].overlap is None) if not c else abs(got[r[0]].overlap - sum(n for k, n in c if k in train) / sum(n for _, n in c)) < 1e-9
    assert any(0 < (r.overlap or 0) < 1 for r in got.values())


def test_empty_table_and_long_texts(spark):
    assert run(spark, []) == {}
    d = spark.createDataFrame([(1, None, None, "evaluation", None, None, "t", 1), (None, "q", None, "train", "text", None, "t", 1)], SCHEMA)
    for t in (d, d.limit(0)):
        o = split_overlaps(t, F.col("i"), F.coalesce("s", "q"), F.col("split"), F.col("text"), F.col("v"))
        assert [(r.held_id, r.by_id, r.by_text, r.by_vector, r.overlap) for r in o.records().collect()] == [(1, False, False, False, None)][: t.count() // 2]
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, "a", None, "train", long, None), (2, "b", None, "evaluation", long.replace("word77 ", "other "), None)]
    assert run(spark, rows) == {(1, 2): (False, True, False)}


def test_chunks_make_up_the_text_and_survive_edits():
    cfg = OverlapConfig()
    a = "how to polish a dusty copper kettle before the winter starts in may and what to do with the old lid when all of the polish is gone by june"
    b = a.replace("dusty", "rusty")
    o, d, n = chunk_spans([a, "", b], cfg)
    assert n[o == 0].sum() == len(a) and n[o == 2].sum() == len(b) and not (o == 1).any()
    shared = set(d[o == 0]) & set(d[o == 2])
    assert n[(o == 0) & np.isin(d, list(shared))].sum() >= 0.4 * len(a)
    assert 10 <= n.mean() <= 30


def test_edits_in_every_chunk_hide_no_pair(spark, rng):
    """Copies with a few characters changed all over: little of them lies in shared chunks."""
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows = []
    for base in range(150):
        t = "".join(rng.choice(letters + [" "], 60))
        for split in ("train", "evaluation"):
            u = list(t)
            for place in rng.choice(60, 2, replace=False):
                u[place] = str(rng.choice(letters))
            rows.append((len(rows), f"q{len(rows)}", None, split, "".join(u), None))
    want = brute(rows)
    assert len(want) > 20
    assert run(spark, rows) == want


def test_similar_texts_of_several_blocks(spark):
    words = [f"clean the copper kettle number {i} before winter" for i in range(40)]
    classes = spark.createDataFrame([(i, w, i % 2 == 0, i % 3 == 0) for i, w in enumerate(words)], "class long, words string, train boolean, held boolean")
    got = similar_classes(classes, OverlapConfig(block_texts=8, block_chars=200)).distinct().collect()
    gram = [{w[j : j + 3] for j in range(len(w) - 2)} for w in words]
    want = {(min(a, b), max(a, b)) for a in range(0, 40, 2) for b in range(0, 40, 3) if a != b and len(gram[a] & gram[b]) >= 0.7 * len(gram[a] | gram[b])}
    assert {(r.a, r.b) for r in got} == want
