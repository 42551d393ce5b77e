import random

import pytest
import tiktoken

from poolcraft.llm import tokens


@pytest.fixture(scope="module")
def coder():
    return tokens.encoder(tokens.default_vocabulary())


def texts():
    rng = random.Random(0)
    letters = [*map(chr, range(32, 127)), "é", "ß", "Ж", "日", "😀", "\n", " ", " ", "­", "\t"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)] + ["", " ", "\n\n", "<|endoftext|>", "a" * 30_000, "don't we'll", "naïve  café 12345"]


def test_same_as_public_encoder(coder):
    public = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    given = texts()
    assert coder.encode(given) == [public.encode_ordinary(t) for t in given]


def test_round_trip(coder):
    back = {i: t for t, i in coder.ranks.items()}
    given = texts()
    assert [b"".join(back[i] for i in ids).decode() for ids in coder.encode(given)] == given


def test_hash_is_minimal_and_perfect(coder):
    assert sorted(coder.hash.slot_of.tolist()) == list(range(len(coder.ranks)))
    assert tokens.PerfectHash([b"x"]).slot_of.tolist() == [0]


def test_documents(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x")], "doc_id bigint, text string").selectExpr("*", "1 AS ids")
    rows = tokens.encode_documents(df).collect()
    assert len(rows) == 5 and {r.doc_id: len(r.ids) for r in rows} == {1: 2, 2: 0, 3: 0, None: 1} and dict(tokens.encode_documents(df).dtypes)["ids"] == "array<int>"
    assert tokens.encode_documents(df.limit(0)).count() == 0
    counts = df.select("doc_id", tokens.token_counts(spark, df.text).alias("n")).collect()
    assert sum(r.n for r in counts) == 5
