import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import dicts
from sedgework.llm import tokenizing as T

pytestmark = pytest.mark.skipif(not os.path.isdir(T.TOKENIZERS), reason="no vocabularies here")


@pytest.mark.parametrize("seed", range(12))
def test_tree_equals_plain_encoding(seed):
    rng = random.Random(seed)
    plain = T.encoder()
    parts = ["word", " ", "  ", "\n", "don't", "'s", "'re", "1234", "…", "倉庫。", "é", "\u0301", "👍🏽", "\u200b", "```", " the", ".", "'", "İ", "ß", "\t", "ﬁ"]
    text = "".join(rng.choices(parts, k=rng.randint(0, 400)))
    for leaf in (1, 2, 7, 64):
        assert T.encode(text, plain, leaf) == plain(text)


def test_texts_without_any_seam():
    plain = T.encoder()
    for text in ("a" * 3000, " " * 3000, "倉" * 3000, "!" * 3000):
        assert T.encode(text, plain, 100) == plain(text)


def test_same_ids_as_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("It's 12 o'clock\n\n  now — 倉庫 <|endoftext|>", "", " ", "\u200bodd\ufeff"):
        assert T.encode(text, T.encoder()) == t.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "hello world", "x"), (4, "a " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = dicts(T.token_ids(df, "doc_id", "text"))
    assert len(got) == 5 and [r["ids"] for r in got if r["doc_id"] in (2, 3)] == [[], []]
    sizes = {r["doc_id"]: r["tokens"] for r in dicts(T.token_sizes(df.withColumnRenamed("ids", "tokens"), ["doc_id"], "text"))}
    assert sizes[1] == 2 and sizes[2] == sizes[3] == 0 and sizes[4] > 50_000
    assert T.token_ids(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=120), st.integers(1, 9))
def test_any_text_goes_there_and_back(text, leaf):
    plain = T.encoder()
    ids = T.encode(text, plain, leaf)
    assert ids == plain(text) and T.decode(ids, leaf=leaf) == text


def test_round_trip_of_a_table(spark):
    df = spark.createDataFrame([(1, "It's 倉庫\n​ odd"), (2, ""), (3, None)], "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in dicts(T.token_texts(T.token_ids(df, "doc_id", "text"), "doc_id"))}
    assert back == {1: "It's 倉庫\n​ odd", 2: "", 3: ""}


def test_the_usual_document_is_a_tree(spark, monkeypatch):
    """The rows come through joins of halves; were the tree left out, this would fail."""
    data = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(data):
        pytest.skip("no tables here")
    joins, plain, join = 0, T.encoder(), T._join

    def counted(*a):
        nonlocal joins
        joins += 1
        return join(*a)

    monkeypatch.setattr(T, "_join", counted)
    texts = [r[0] for r in spark.read.parquet(data).select("text").where("text <> ''").collect()]
    through = 0
    for text in texts:
        before = joins
        assert T.encode(text, plain) == plain(text)
        through += joins > before
    assert through > 0.8 * len(texts)
