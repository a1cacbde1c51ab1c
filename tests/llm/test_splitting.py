import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectrine.llm.splitting import SplitConfig, normalise, split, split_oversized


def check(text, cfg):
    p = split(text, cfg)
    if not text or not text.strip():
        assert p == []
        return
    plain, _ = normalise(text.strip())
    assert " ".join(plain.split()) == " ".join(text.split())
    starts = [x[0] for x in p] + [len(plain)]
    assert starts[0] == 0 and "".join(plain[a:b] for a, b in zip(starts, starts[1:])) == plain
    assert (len(p) == 1) == (len(plain) <= cfg.limit)
    for core, start, end, piece in p:
        assert piece == plain[start:end] and 0 < len(piece) <= cfg.limit and 0 <= core - start <= cfg.overlap


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n\t。 ", max_size=400), st.sampled_from([SplitConfig(40, 8), SplitConfig(25, 0), SplitConfig(12, 5)]))
def test_pieces_make_up_the_text(text, cfg):
    check(text, cfg)


@pytest.mark.parametrize("text", ["x" * 9000, "word " * 3000, "One sentence here. " * 500, "para one.\n\n" * 700, "", "   ", "日本語。" * 2000, "a" * 2000, "a" * 2001])
def test_kinds_of_texts(text):
    check(text, SplitConfig())


def test_cuts_are_at_paragraphs_where_there_are_any():
    paragraph = " ".join(["Some words make a sentence."] * 30)
    text = "\n\n".join([paragraph] * 9)
    plain, strong = normalise(text)
    p = split(text)
    assert len(p) > 2 and all(c in strong for c, *_ in p[1:])
    assert all(100 < c - s <= 200 for c, s, *_ in p[1:])
    words = split("word " * 3000)
    assert all(x[3].startswith("word") and x[3].endswith("word") for x in words)


def test_over_a_table(spark):
    d = spark.createDataFrame([("a", "w " * 1500), ("a", "w " * 1500), ("b", None), (None, "short"), ("c", "")], "d string, t string").withColumn("id", F.lit(1))
    got = split_oversized(d, F.col("d"), F.col("t")).toPandas()
    assert got.id.isna().sum() == 1 and set(got.id.dropna()) == {"a"} and (got.piece_no > 0).sum() >= 2
    assert split_oversized(d.filter("d = 'z'"), F.col("d"), F.col("t")).count() == 0
