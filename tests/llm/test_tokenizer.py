import base64
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vectrine.llm.tokenizer import DEFAULT_FOLDER, PATTERN, BytePairEncoder, TokenizerFile, build, encode_corpus, token_counts

TEXTS = ["", "Hello, world! It's 2024.", "<|endoftext|>", " lead  and   trail  ", "naïve café é", "日本語 עברית 👩‍👩‍👧", "a" * 5000, "0123456789" * 200, "\x1c\x1d\x85 \t\n x", "def f(x):\n    return x**2\n"]


@pytest.fixture(scope="module")
def coder():
    return build(*TokenizerFile().read())


def test_equals_the_libraries(coder):
    import tiktoken
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{DEFAULT_FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(DEFAULT_FOLDER, "byte_bpe_50k.tiktoken").open("rb"))}
    k = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    more = ["".join(rng.choice("ab é日1.\x1c\x85 \n'sT") for _ in range(40)) for _ in range(500)]
    for x in TEXTS + more:
        assert coder.encode(x) == t.encode(x, add_special_tokens=False).ids == k.encode_ordinary(x)
        assert coder.decode(coder.encode(x)) == x


def test_merges_by_rank_and_then_by_place():
    file = b"\n".join(base64.b64encode(s) + b" " + str(i).encode() for i, s in enumerate([b"a", b"b", b"aa", b"ab", b"aab"]))
    e = BytePairEncoder(file, r"[\s\S]+")
    assert e.encode("aaa") == [2, 0] and e.encode("aab") == [4] and e.encode("abab") == [3, 3] and e.encode(None) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_every_row_gives_a_row(spark, name):
    rows = [(1, "some text"), (1, "some text"), (2, None), (3, ""), (None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "ids": F.lit(0)})
    got = encode_corpus(d, F.col("doc_id"), F.col("text"), TokenizerFile(name)).collect()
    assert sorted((r.id or 0, len(r.ids)) for r in got) == sorted((r.id or 0, r.n) for r in token_counts(d, F.col("doc_id"), F.col("text"), TokenizerFile(name)).collect())
    assert [len(r.ids) for r in got if r.id in (2, 3)] == [0, 0] and len(got) == 5
    assert encode_corpus(d.filter("doc_id > 9"), F.col("doc_id"), F.col("text"), TokenizerFile(name)).count() == 0
