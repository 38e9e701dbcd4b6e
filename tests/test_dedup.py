import datetime as dt
import math

import pytest

from shelfwise.operators import dedup as D
from shelfwise.operators import graph as G
from shelfwise.operators import metadata as M

SCHEMA = "id long, title string, doi string, arxiv_id string, isbn string, content_hash string, edition string, publication_year int, linked_doi string"


def items(spark, *rows):
    return spark.createDataFrame([(i, *(own.get(c) for c in "title doi arxiv_id isbn content_hash edition publication_year linked_doi".split())) for i, own in rows], SCHEMA)


def test_exact_keys_in_order(spark):
    frame = items(spark, (1, {"doi": "d", "isbn": "i"}), (2, {"doi": "d", "content_hash": "h"}), (3, {"content_hash": "h", "doi": "d"}), (4, {"isbn": "i"}), (5, {"doi": ""}), (6, {"doi": ""}), (7, {"arxiv_id": "a"}), (8, {"arxiv_id": "a"}))
    got = {r.id: (r.target_id, r.reason) for r in D.exact(frame, frame).collect()}
    assert got == {1: (2, "doi_match"), 2: (3, "hash_match"), 3: (2, "hash_match"), 4: (1, "isbn_match"), 7: (8, "arxiv_id_match"), 8: (7, "arxiv_id_match")}


def test_errata_and_linked_preprints(spark):
    library = items(spark, (1, {"title": "Boron dilution transients in reactors", "doi": "10.1/x"}), (2, {"title": "Foo"}), (3, {"title": "Unbelievablylong title"}))
    asked = items(spark, (10, {"title": "Erratum to: Boron Dilution Transients"}), (11, {"title": "Erratum: foo"}), (12, {"title": "Correction: an unknown work of art"}), (13, {"title": "Corrigendum Unbelievablylong title."}), (14, {"title": None}))
    assert {(r.id, r.target_id) for r in D.errata(asked, library).collect()} == {(10, 1), (13, 3)}
    asked = items(spark, (1, {"arxiv_id": "a", "linked_doi": "10.1/x"}), (10, {"arxiv_id": "a", "linked_doi": "10.1/x"}), (11, {"linked_doi": "10.1/x"}), (12, {"arxiv_id": "b", "linked_doi": "10.1/none"}))
    assert {(r.id, r.target_id, r.relation) for r in D.linked(asked, library).collect()} == {(10, 1, "preprint_of")}


CASES = [
    (0.9988, True, None, None, ("merge", None)),
    (0.9806, False, None, None, ("link", "related")),
    (0.9285, True, None, None, None),
    (0.9285, True, None, "same", ("merge", None)),
    (0.9285, True, None, "related", ("link", "related")),
    (0.9285, True, None, "different", None),
    (0.9988, True, ("3rd", "1"), None, ("link", "later_edition_of")),
    (0.9988, True, ("1", "3rd"), None, ("link", "earlier_edition_of")),
    (0.9988, True, ("2", "2nd"), None, ("merge", None)),
    (0.9988, True, (None, "2nd"), None, ("link", "later_edition_of")),
    (0.84, True, ("1", "2"), None, None),
    (0.9806, False, ("1", "2"), None, ("link", "related")),
]


@pytest.mark.parametrize("sim, shared, editions, verdict, want", CASES)
def test_semantic_ladder(spark, sim, shared, editions, verdict, want):
    a, b = editions or (None, None)
    rows = items(spark, (1, {"edition": a}), (2, {"edition": b}))
    near = spark.createDataFrame([(1, 1, 1, 1.0), (1, 2, 2, sim)], "id long, target_id long, rank int, similarity double")
    keys = spark.createDataFrame([(1, "x"), (2, "x" if shared else "y")], "item_id long, key string")
    judged = spark.createDataFrame([(1, 2, verdict)], "id long, target_id long, verdict string") if verdict else None
    got = [(r.outcome, r.relation) for r in D.semantic(near, rows, keys, judged=judged).collect()]
    assert got == ([want] if want else [])


def test_asserted_pairs_and_decisions(spark):
    rows = items(spark, (1, {"doi": "d"}), (2, {}), (3, {"doi": "d"}))
    near = spark.createDataFrame([(1, 2, 1, 0.99), (2, 1, 1, 0.99)], "id long, target_id long, rank int, similarity double")
    keys = spark.createDataFrame([(1, "x"), (2, "x")], "item_id long, key string")
    apart = spark.createDataFrame([(1, 2)], "a_id long, b_id long")
    assert D.semantic(near, rows, keys, apart).collect() == []
    decided = {r.id: (r.outcome, r.reason) for r in D.decide(rows, [D.exact(rows, rows), D.semantic(near, rows, keys)]).collect()}
    assert decided == {1: ("merge", "doi_match"), 2: ("merge", "semantic_match"), 3: ("merge", "doi_match")}
    assert {r.id: r.outcome for r in D.decide(rows, [D.exact(rows.limit(0), rows)]).collect()} == {1: "insert", 2: "insert", 3: "insert"}


def test_relations(spark):
    rows = spark.createDataFrame([(1, " Preprint Of", 2, None), (1, "preprint_of", 2, 0.5), (3, "related", 3, 1.0), (3, "related", 4, 1.0), (5, "unknown", 6, 1.0), (None, "cites", 1, 1.0)], "subject_id long, relation string, object_id long, confidence double")
    assert {tuple(r) for r in G.with_inverses(rows).collect()} == {(1, "preprint_of", 2, 1.0), (2, "published_as", 1, 1.0), (3, "related", 4, 1.0), (4, "related", 3, 1.0)}
    assert {(r.subject_id, r.relation) for r in G.missing_inverses(rows).collect()} == {(1, "preprint_of"), (3, "related")}
    assert all(G.INVERSES[b] == a for a, b in G.INVERSES.items())
    with pytest.raises(ValueError):
        G.neighbours(rows, rows, "friends")


def test_chapters(spark):
    toc = spark.createDataFrame([(1, 0, "Intro", 1), (1, 1, "Methods", 4), (1, 2, "Results", 8), (2, 0, "Only", 1), (3, 0, "a", 5), (3, 1, "b", 5)], "book_id long, position int, title string, page int")
    books = spark.createDataFrame([(1, 10), (2, 5), (3, 4)], "book_id long, page_count int")
    got = {(r.book_id, r["index"]): (r.start_page, r.end_page) for r in G.chapter_ranges(toc, books).collect()}
    assert got == {(1, 0): (1, 3), (1, 1): (4, 7), (1, 2): (8, 10), (3, 0): (5, 5), (3, 1): (5, 5)}


def test_metadata_layers_and_backfill(spark):
    rows = spark.createDataFrame([(1, 1, "grobid", 0.9, "Header title", "An abstract"), (2, 1, "crossref", 0.5, "Registry title", ""), (3, 1, "arxiv", 1.0, None, "Other"), (4, 2, None, None, None, None)], "candidate_id long, item_id long, source string, confidence double, title string, abstract string")
    got = {r.item_id: (r.source, r.title, r.abstract) for r in M.layered(rows, ["title", "abstract"]).collect()}
    assert got == {1: ("crossref", "Registry title", "Other"), 2: (None, None, None)}
    assert {(r.item_id, r.candidate_id) for r in M.best(rows).collect()} == {(1, 2), (2, 4)}
    stored = spark.createDataFrame([(1, "Kept", ""), (9, "Alone", None)], "id long, title string, abstract string")
    filled = M.backfilled(stored, M.layered(rows, ["title", "abstract"]).withColumnRenamed("item_id", "id"), ["title", "abstract"])
    assert {tuple(r) for r in filled.collect()} == {(1, "Kept", "Other"), (9, "Alone", None)}
    assert M.layered(rows.limit(0), ["title"]).collect() == []


def test_upserts(spark):
    day = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, "primary", "old", day), (1, "primary", "new", day + dt.timedelta(1)), (1, "tei", "x", None)], "item_id long, kind string, hash string, at timestamp")
    assert {(r.kind, r.hash) for r in M.latest(rows, ["item_id", "kind"], "at", "hash").collect()} == {("primary", "new"), ("tei", "x")}
    old = spark.createDataFrame([(1, 10, 0, "author"), (1, 11, 4, "editor")], "item_id long, author_id long, position int, role string")
    new = spark.createDataFrame([(1, 12, 0), (1, 10, 1), (1, 13, 2), (2, 14, 0)], "item_id long, author_id long, position int")
    assert {tuple(r) for r in M.union_authors(old, new).collect()} == {(1, 10, 0, "author"), (1, 11, 4, "editor"), (1, 12, 5, "author"), (1, 13, 6, "author"), (2, 14, 0, "author")}
    merged = spark.createDataFrame([('{"a":"1","b":"2"}', '{"b":"3"}'), (None, '{"c":"4"}')], "o string, n string").select(M.merged_json(M.F.col("o"), M.F.col("n")).alias("j"))
    assert [r.j for r in merged.collect()] == ['{"a":"1","b":"3"}', '{"c":"4"}']
    assert math.isclose(1 - 0.05**2 / 2, 0.99875)


def test_every_item_is_tested_for_near_duplicates(spark, tmp_path):
    """No id is a multiple of 100; the first two items share vector and author, the next two the vector alone, the others nothing."""
    from shelfwise.plans import dedup_queries as Q

    spike = lambda at, value=1.0: [value if i == at else 0.0 for i in range(768)]
    vectors = [spike(0), spike(0, 2.0), spike(1), spike(1), spike(2), spike(0, 0.0), [1.0] * 3]
    ids = [15, 20, 30, 40, 50, 55, 60]  # all of one edition, none an erratum or preprint
    fields = "id long, item_type string, title string, abstract string, publication_year int, doi string, arxiv_id string, isbn string, venue string, content_hash string"
    spark.createDataFrame([(i, "paper", f"Work {i}", None, 2000, *[None] * 5) for i in ids], fields).write.parquet(f"{tmp_path}/library_items.parquet")
    spark.createDataFrame(list(zip(ids, vectors)), "item_id long, embedding array<float>").write.parquet(f"{tmp_path}/item_embeddings.parquet")
    spark.createDataFrame([(15, 1), (20, 2), (30, 3)], "item_id long, author_id long").write.parquet(f"{tmp_path}/item_authors.parquet")
    spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "author_id long, normalized_key string").write.parquet(f"{tmp_path}/authors.parquet")
    found = {(r.id, r.outcome, r.target_id, r.relation) for r in Q.dedup_tier4_scan(spark, str(tmp_path)).collect()}
    assert found == {(15, "merge", 20, None), (20, "merge", 15, None), (30, "link", 40, "related"), (40, "link", 30, "related")}
    assert {(r.outcome, r.reason, r.n) for r in Q.dedup_decide_all(spark, str(tmp_path)).collect()} == {("merge", "semantic_match", 2), ("link", "semantic_related", 2), ("insert", "no_match", 3)}
