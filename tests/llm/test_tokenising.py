import os
import random

import pytest

from shelfwise.llm import tokenising

pytestmark = pytest.mark.skipif(not os.path.exists(tokenising.VOCABULARY), reason="no vocabulary file")

TEXTS = [
    None,
    "",
    " ",
    "Hello  world\n\n\n  don't we'll 123 ünïcode 🏳️‍🌈 <|endoftext|> x",
    "a" * 5000,
    "\t \r\n   end  ",
    "word " * 3000,
]


def want(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenising.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids if text else []


def run(spark, texts, **options):
    frame = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    return {r.doc_id: list(r.ids) for r in tokenising.encode(frame, **options).collect()}


def test_same_ids_as_the_public_library(spark):
    assert run(spark, TEXTS) == {i: want(t) for i, t in enumerate(TEXTS)}


def test_stitched_chunks_have_the_same_ids(spark):
    rng = random.Random(3)
    pieces = ["a", "Ab", " ", "  ", "\n", "\n\n", "'s", "'", "12", "é", "漢字", "🙂", "...", " the", "\xa0"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 900))) for _ in range(60)] + ["z" * 700, "ok " * 100 + "q" * 300 + " fine" * 90]
    for chunk, overlap in ((50, 20), (64, 40)):
        assert run(spark, texts, chunk=chunk, overlap=overlap) == {i: want(t) for i, t in enumerate(texts)}


def test_round_trip_and_empty(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    back = tokenising.decode(tokenising.encode(frame)).collect()
    assert {r.doc_id: r.decoded for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokenising.encode(frame.limit(0)).collect() == []
