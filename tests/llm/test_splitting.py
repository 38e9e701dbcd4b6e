import random
import re

import pytest

from shelfwise.llm import splitting

LINE = r"\r\n|[\n\r]"


def weakest(text, limit):
    """By the definition, not by cutting."""
    if len(text.split()) <= limit:
        return None
    paragraphs, now = [], []
    for line in re.split(LINE, text):
        if line.strip():
            now.append(line)
        else:
            paragraphs.append("\n".join(now))
            now = []
    paragraphs.append("\n".join(now))
    if all(len(p.split()) <= limit for p in paragraphs):
        return "paragraph"
    if all(len(s.split()) <= limit for p in paragraphs for s in re.split(r"(?<=[.!?])\s+", p)):
        return "sentence"
    return "word"


def texts():
    rng = random.Random(5)
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 60)):
            parts.append(rng.choice(["word", "x", "naïve", "3.5", "end."]) + rng.choice([" "] * 8 + ["\xa0", "\n", "\r\n", "\n\n", "\r\n \r\n", " \n\t\n "]))
        yield "".join(parts)


def test_boundaries_and_pieces(spark):
    rows = [(i, t, "extra") for i, t in enumerate(texts())]
    frame = spark.createDataFrame(rows, "chunk_id long, text string, cut string")
    want = {(i, weakest(t, 12)) for i, t, _ in rows if weakest(t, 12)}
    assert {b for _, b in want} == {"paragraph", "sentence", "word"}
    assert {tuple(r) for r in splitting.oversized_boundaries(frame, 12, 3).collect()} == want
    pieces = splitting.split_oversized(frame, limit=12, overlap=3).orderBy("chunk_id", "piece_no").collect()
    for i, t, _ in rows:
        own, words, end = [p for p in pieces if p.chunk_id == i], t.split(), 0
        for p in own:
            n = len(p.piece.split())
            assert n <= 12 and n == p.piece_words and p.overlap_words <= 3
            assert p.piece.split() == words[end - p.overlap_words : end - p.overlap_words + n]
            assert p.piece.strip() in t
            end += n - p.overlap_words
        assert end == len(words)


def test_null_empty_long_and_unbroken_texts(spark):
    long = "word " * 100_000 + "x" * 100_000
    frame = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, long), (4, long)], "chunk_id long, text string")
    out = splitting.split_oversized(frame).collect()
    assert {(r.chunk_id, r.piece) for r in out if r.chunk_id < 4} == {(2, ""), (3, " \n")}
    assert max(r.piece_words for r in out) <= 400
    assert {tuple(r) for r in splitting.oversized_boundaries(frame).collect()} == {(4, "word")}
    assert splitting.split_oversized(frame.limit(0)).collect() == []


def test_characters(spark):
    text = "One two three. Four five six.\n\nSeven eight " + "y" * 50 + " nine"
    out = splitting.split_characters(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), limit=20, overlap=5).orderBy("piece_no").collect()
    assert all(len(r.piece) <= 20 for r in out)
    assert "".join(r.piece[r.overlap_chars :] for r in out).replace(" ", "") == text.replace(" ", "").replace("\n", "")
    assert "character" in {r.cut for r in out}


def test_wrong_parameters(spark):
    with pytest.raises(ValueError):
        splitting.split_oversized(spark.createDataFrame([(1, "a")], "chunk_id long, text string"), limit=10, overlap=10)
