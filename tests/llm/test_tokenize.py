import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from legflow.llm.tokenize import decode, encode

HARD = [None, "", " ", "  \n\n a", "don't I'LL we've 'em", "<|endoftext|>x", "a\x85b\xa0c 　", "Zürich 12½ ²³ ३४", "🚆🚉 東の駅", "x" * 5000, " " * 3000 + "y", "tab\t\ttab\r\n", "\x1c\x1fz", "Ünïcödé" * 400, "é‍", "a", "a"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_equal_to_the_library_and_back(spark, reference):
    r = random.Random(9)
    texts = HARD + ["".join(r.choice(" \n\t'slabÜßé字.,!?0123 ") for _ in range(r.randint(1, 60))) for _ in range(300)]
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos int, word string").repartition(3)
    got = encode(df, "doc_id", "text")
    ids = {x.doc_id: list(x.ids) for x in got.collect()}
    assert [ids[i] for i in range(len(texts))] == reference(texts)
    back = {x.doc_id: x.text for x in decode(got, "doc_id").collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]


def test_repeated_and_null_keys_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string")
    assert sorted(map(str, ((x.doc_id, list(x.ids)) for x in encode(df, "doc_id", "text").collect()))) == ["(1, [64, 275])", "(1, [64, 275])", "(None, [64])"]
    assert encode(df.filter("false"), "doc_id", "text").count() == 0
    assert decode(encode(df.filter("false"), "doc_id", "text"), "doc_id").count() == 0
