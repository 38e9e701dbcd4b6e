import sqlite3

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwise.functions import pyfuncs as P
from shelfwise.operators import fts, retrieval, vector

DOCS = [
    (1, "Boron dilution in reactors", "The OR-gate logic of boron."),
    (2, "Study of OR-gate logic", "An or gate, or a gate."),
    (3, "Müller on dilution", None),
    (4, "Gate or", "or or gate dilution boron"),
    (5, "", ""),
    (6, "The the the", "boron boron boron boron dilution"),
    (7, "Nothing here", "plain text"),
]


@pytest.fixture(scope="module")
def lite():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(title, abstract, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t(rowid, title, abstract) VALUES (?, ?, ?)", DOCS)
    return db


@pytest.mark.parametrize("query", ["boron", "or-gate", "boron dilution", "muller", "the", "dilution or-gate", "absent", "Müller"])
def test_bm25_is_that_of_sqlite(spark, lite, query):
    phrases = " AND ".join('"' + " ".join(p) + '"' for p in fts.query_phrases(query))
    want = {i: s for i, s in lite.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (phrases,))}
    docs = spark.createDataFrame(DOCS, "id long, title string, abstract string")
    got = {r.id: r.score for r in fts.search(docs, query, "id", ["title", "abstract"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    index = fts.search_index(*fts.build_index(docs, "id", ["title", "abstract"]), query, "id")
    assert {r.id: round(r.score, 9) for r in index.collect()} == {i: round(s, 9) for i, s in got.items()}


def test_blank_query_and_empty_corpus(spark):
    docs = spark.createDataFrame(DOCS, "id long, title string, abstract string")
    assert fts.search(docs, " ?!", "id", ["title"]).collect() == []
    assert fts.search(docs.limit(0), "boron", "id", ["title"]).collect() == []


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
    rows += [(300, rows[5][1]), (301, [0.0] * 8), (302, None), (303, [1.0] * 7), (304, [float("nan")] * 8)]
    frame = spark.createDataFrame(rows + rows[:9], "item_id long, embedding array<float>").repartition(5)
    own = {i: np.asarray(v) / np.linalg.norm(v) for i, v in rows if i <= 300}
    got = {}
    for r in vector.nearest(frame, [rows[5], rows[17]], 6, 8).orderBy("query_id", "distance", "item_id").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    for q in (5, 17):
        assert got[q] == sorted(own, key=lambda i: (round(float(np.sqrt(max(2 - 2 * own[q] @ own[i], 0))), 9), i))[:6]
    assert vector.nearest(frame.limit(0), [rows[5]], 3, 8).collect() == []
    assert vector.nearest(frame, [], 3, 8).collect() == []


def test_fusion(spark):
    def fuse(*lists):
        rows = [(i, k, r + 1) for k, own in enumerate(lists) for r, i in enumerate(own)]
        return [r.id for r in retrieval.fuse(spark.createDataFrame(rows, "id long, list_no int, rank int"), "id").collect()]

    assert fuse([10, 20, 30]) == [10, 20, 30]
    assert fuse([1, 2, 3], [2, 3, 4])[0] == 2
    assert fuse([1, 2, 3, 4, 5], [1, 99, 98, 97, 96])[0] == 1
    assert fuse([1, 2], [2, 1]) == [1, 2]
    assert fuse() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.text(alphabet="ab. !\n", max_size=80)), max_size=4), st.integers(1, 12), st.integers(0, 11))
def test_chunks_lose_no_word(pages, target, overlap):
    if overlap >= target:
        with pytest.raises(ValueError):
            P.chunk_pages(pages, target, overlap)
        return
    chunks = P.chunk_pages(pages, target, overlap)
    assert [c[0] for c in chunks] == list(range(len(chunks)))
    words = [w for _, t in pages for w in t.split()]
    assert sum(len(c[2].split()) for c in chunks) >= len(words)
    assert not words or (chunks[0][2].split()[0] == words[0] and chunks[-1][2].split()[-1] == words[-1])
    assert all(len(c[2].split()) < 2 * target for c in chunks)


def test_chunks_of_pages():
    text = " ".join(f"w{k}." for k in range(500))
    chunks = P.chunk_pages([(1, text)], 100, 20)
    assert set(chunks[0][2].split()[-20:]) == set(chunks[1][2].split()[:20])
    three = P.chunk_pages([(p, " ".join(["word."] * 150)) for p in (1, 2, 3)], 100, 10)
    assert {c[1] for c in three} == {1, 2, 3} and three[0][1] == 1
    assert P.chunk_pages([]) == [] and P.chunk_pages([(1, "")]) == []


def test_chunks_of_items_are_those_of_their_pages(spark):
    """Borders from sentence lengths alone give what chunking an item's pages at once gives, one hot item among them."""
    rng = np.random.default_rng(1)
    text = lambda: " ".join(" ".join(["w%d" % rng.integers(99)] * int(rng.integers(1, 9))) + rng.choice([".", "!", "?", ","]) for _ in range(int(rng.integers(0, 9))))
    rows = [(i, p, text() if p % 7 else None) for i in range(4) for p in range(1, 400 if i == 0 else 9)]
    frame = spark.createDataFrame(rows, "item_id long, page int, text string").repartition(5)
    got = {}
    for r in P.chunk_items(frame, "item_id", target=20, overlap=4).orderBy("item_id", "chunk_index").collect():
        got.setdefault(r.item_id, []).append((r.chunk_index, r.page, r.text))
    for i in range(4):
        assert got.get(i, []) == P.chunk_pages([(p, t) for j, p, t in rows if j == i and t is not None], 20, 4)


CHUNKS = "chunk_id long, item_id long, page int, chunk_index int, section string, text string"


def test_passages_by_vectors(spark):
    chunks = spark.createDataFrame([(k, k % 4, 1, k, ("methods", "results")[k % 2], f"text {k}") for k in range(40)] * 2, CHUNKS)
    angle = lambda k: [float(np.cos(k / 30)), float(np.sin(k / 30))]
    vectors = spark.createDataFrame([(k, angle(k)) for k in range(40)], "chunk_id long, embedding array<double>")
    ids = lambda df: [r.chunk_id for r in df.orderBy(F.desc("score"), "chunk_id").collect()]
    assert ids(retrieval.vector_passages(chunks, vectors, angle(0), 3, dim=2)) == [0, 1, 2]
    assert ids(retrieval.vector_passages(chunks, vectors, angle(0), 3, section="results", dim=2)) == [1, 3, 5]
    scope = spark.createDataFrame([(3,)], "item_id long")
    assert ids(retrieval.vector_passages(chunks, vectors, angle(0), 3, items=scope, dim=2)) == [3, 7]  # among three times the limit
    assert ids(retrieval.vector_passages(chunks, vectors, angle(0), 3, items=scope, dim=2, exact=True)) == [3, 7, 11]
    # no vector at all: keywords answer a search for passages and a hybrid one, not a semantic one
    none = vectors.limit(0)
    assert retrieval.passages(chunks, "text 7", 3, vectors=none, query_vector=angle(0), dim=2).collect()[0].chunk_id == 7
    items = spark.createDataFrame([(3,)], "item_id long")
    best = lambda mode: retrieval.best_passages(items, chunks, "text 7", n=5, mode=mode, vectors=none, query_vector=angle(0), dim=2).first().chunk_id
    assert best("hybrid") == 7 and best("semantic") is None


def test_stored_index_answers_as_a_scan(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "id long, title string, abstract string")
    index = fts.Index.write(docs, "id", ["title", "abstract"], str(tmp_path))
    for query in ("boron", "or-gate", "boron dilution", "absent", "?"):
        want = {r.id: round(r.score, 9) for r in fts.search(docs, query, "id", ["title", "abstract"]).collect()}
        assert {r.id: round(r.score, 9) for r in index.search(spark, query).collect()} == want
    inside = spark.createDataFrame([(1,), (6,)], "id long")
    assert {r.id for r in index.search(spark, "boron", within=inside).collect()} == {1, 6}


def test_evaluation_and_match_rates(spark):
    runs = spark.createDataFrame([("k", 1, 10, 1, 5.0), ("k", 1, 11, 2, 5.0), ("k", 2, 12, 1, 15.0), ("s", 1, 13, 1, 1.0)], "mode string, query_id long, item_id long, rank int, ms double")
    want = spark.createDataFrame([(1, 10), (1, 13), (2, 99)], "query_id long, item_id long")
    got = {r.mode: (r.queries, r.recall, r.p50_ms) for r in retrieval.evaluation(runs, want).collect()}
    assert got == {"k": (2, 0.25, 10.0), "s": (2, 0.25, 1.0)}
    a = spark.createDataFrame([(1, " Title ", 2000), (2, "x", None)], "id long, title string, year int")
    b = spark.createDataFrame([(1, "title", 2001), (2, None, None), (3, "y", 1)], "id long, title string, year int")
    assert {(r.field, r.compared, r.matched) for r in retrieval.match_rates(a, b, ["title", "year"]).collect()} == {("title", 2, 1), ("year", 2, 0)}
