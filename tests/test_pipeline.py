import numpy as np
from pyspark.sql import functions as F

from shelfwise.functions import pyfuncs as P
from shelfwise.operators import dedup as D
from shelfwise.operators import pipeline as L

ITEM = "id long, item_type string, title string, abstract string, publication_year int, doi string, arxiv_id string, isbn string, venue string, content_hash string, metadata_source string"


def test_resolving(spark):
    files = spark.createDataFrame([("/in/a.pdf", "doi 10.1234/x and ISBN 978-0-13-110163-0"), ("/in/b c.pdf", "nothing")], "path string, text string")
    assert {tuple(r) for r in L.wanted(files).collect()} == {("/in/a.pdf", "doi", "10.1234/x"), ("/in/a.pdf", "isbn", "9780131101630")}
    header = spark.createDataFrame([("/in/a.pdf", "grobid", 0.85, "Header", "Text", [("Doe", "J", None)])], "path string, source string, confidence double, title string, abstract string, authors array<struct<family:string,given:string,orcid:string>>")
    registry = spark.createDataFrame([("/in/a.pdf", "crossref", 1.0, "Registry", 2020)], "path string, source string, confidence double, title string, publication_year int")
    rows = {r.path: r for r in L.resolved(files, [header, registry]).collect()}
    a, b = rows["/in/a.pdf"], rows["/in/b c.pdf"]
    assert (a.title, a.abstract, a.publication_year, a.metadata_source, a.authors[0].family) == ("Registry", "Text", 2020, "crossref", "Doe")
    assert (b.title, b.metadata_source) == ("b c", "manual_required")


def test_acting(spark):
    items = spark.createDataFrame([(1, "paper", "One", None, None, "10.1/a", None, None, "", "h1", "crossref"), (2, "paper", "Two", "x", 2000, None, None, None, "V", None, "crossref")], ITEM)
    new = spark.createDataFrame([(10, "paper", "One again", "Filled", 2001, "10.1/a", "a1", None, "J", "h9", "arxiv"), (11, "paper", " ", None, None, "10.1/b", None, None, None, None, "arxiv"), (12, "paper", "Erratum to: One", None, None, None, None, None, None, None, "arxiv")], ITEM)
    decisions = spark.createDataFrame([(10, 1, "merge", 1, None, 1.0, "doi_match"), (11, None, "insert", None, None, None, "no_match"), (12, 2, "link", 1, "erratum_for", 0.9, "erratum_title")], "id long, tier int, outcome string, target_id long, relation string, confidence double, reason string")
    out = L.acted(decisions, new, items)
    rows = {r.id: r for r in out["items"].collect()}
    assert set(rows) == {1, 2, 11, 12} and rows[11].title == "(untitled)"
    assert (rows[1].title, rows[1].abstract, rows[1].arxiv_id, rows[1].venue, rows[1].content_hash) == ("One", "Filled", "a1", "J", "h1")
    assert {(r.subject_id, r.relation, r.object_id) for r in out["relations"].collect()} == {(12, "erratum_for", 1), (1, "corrected_by", 12)}
    assert [(r.target_id, r.merged_id, r.reason) for r in out["merge_history"].collect()] == [(1, 10, "doi_match")]
    assert {(r.id, r.result, r.item_id) for r in out["ingest_log"].collect()} == {(10, "merged", 1), (11, "inserted", 11), (12, "linked", 12)}
    assert out["items"].count() + out["merge_history"].count() == items.count() + out["ingest_log"].count()
    # the same batch again: everything is known now
    again = D.decide(new, [D.exact(new.where("id <> 12"), out["items"].where("id not in (11, 12)"))])
    assert {r.id: r.outcome for r in again.collect()}[10] == "merge"


def test_merge_chains(spark):
    rows = spark.createDataFrame([(5, "merge", 4), (4, "merge", 3), (3, "merge", 4), (9, "merge", 5), (7, "insert", None)], "id long, outcome string, target_id long")
    assert {tuple(r) for r in L.merge_targets(rows).collect()} == {(5, 3), (4, 3), (3, 4), (9, 3)}


def test_authors_and_tags(spark):
    authors = spark.createDataFrame([(1, "Doe", "Jane", "o1", "doe,j"), (2, "Roe", "Rick", None, "roe,r")], "author_id long, family_name string, given_name string, orcid string, normalized_key string")
    new = spark.createDataFrame([(7, 0, "author", "Doe", "J.", "o1"), (7, 1, "author", "Roe", "R", None), (7, 2, "editor", "New", "Ann", None), (8, 0, "author", "New", "A.", None)], "item_id long, position int, role string, family string, given string, orcid string")
    after, bridge = L.authors_upserted(authors, new)
    assert after.count() == 3
    ids = {(r.item_id, r.position): r.author_id for r in bridge.collect()}
    assert ids[7, 0] == 1 and ids[7, 1] == 2 and ids[7, 2] == ids[8, 0] not in (1, 2)
    tags, links = L.tags_upserted(spark.createDataFrame([(1, "old")], "tag_id long, name string"), spark.createDataFrame([(7, " old "), (7, "new"), (7, "new"), (7, " ")], "item_id long, tag string"))
    assert {r.name for r in tags.collect()} == {"old", "new"} and links.count() == 2


def test_chapters(spark):
    books = spark.createDataFrame([(1, "Book", 10)], "id long, title string, page_count int")
    toc = spark.createDataFrame([(1, 0, "Intro", 1), (1, 1, "Methods", 4)], "book_id long, position int, title string, page int")
    chapters, edges = L.chapters_split(books, toc)
    assert [r.title for r in chapters.orderBy("index").collect()] == ["Intro", "Methods"] and edges.count() == 4


def test_indexing(spark):
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head>Introduction</head><p>A b c. D e f.</p></div><div><head>Methods</head><p>G h.</p></div></body></text></TEI>'
    items = spark.createDataFrame([(i, "paper", f"T{i}", None, None, None, None, None, None, None, "derived" if i == 4 else None) for i in (1, 2, 3, 4)], ITEM)
    vectors = spark.createDataFrame([(3, [0.0])], "item_id long, embedding array<float>")
    chunks = spark.createDataFrame([(3, 0)], "item_id long, chunk_index int")
    documents = spark.createDataFrame([(1, tei)], "item_id long, tei string")
    pages = spark.createDataFrame([(1, 1, "unused"), (2, 1, "Page one."), (2, 2, "Page two."), (3, 1, "known")], "item_id long, page int, text string")
    assert {r.id for r in L.unindexed(items, vectors, chunks).collect()} == {1, 2}
    new, parts = L.indexed(items, vectors, chunks, P.stub_embedder(4), documents, pages)
    assert {r.item_id for r in new.collect()} == {1, 2} and np.isclose(np.linalg.norm(new.first().embedding), 1, atol=1e-5)
    got = {(r.item_id, r.chunk_index): (r.page, r.text, r.section) for r in parts.collect()}
    assert got == {(1, 0): (None, "A b c. D e f.", "introduction"), (1, 1): (None, "G h.", "methods"), (2, 0): (1, "Page one. Page two.", None)}
    assert L.section_chunks(documents, target=3, overlap=0).where(F.col("section") == "introduction").count() == 2


def test_command_line(capsys):
    from shelfwise.__main__ import main

    assert main(["version"]) == 0 and main(["queries"]) == 0
    assert "hybrid_search" in capsys.readouterr().out


def test_merges_join_authors_and_json(spark):
    items = spark.createDataFrame([(1, "One", '{"a":"1","b":"2"}')], "id long, title string, metadata_json string")
    new = spark.createDataFrame([(10, "One", '{"b":"3"}'), (11, "One", '{"b":"4","c":"5"}'), (12, "Other", None)], "id long, title string, metadata_json string")
    decisions = spark.createDataFrame([(10, "merge", 1), (11, "merge", 1), (12, "insert", None)], "id long, outcome string, target_id long").withColumns({"relation": F.lit(None).cast("string"), "confidence": F.lit(1.0), "reason": F.lit("x")})
    old = spark.createDataFrame([(1, 5, 0, "author")], "item_id long, author_id long, position int, role string")
    own = spark.createDataFrame([(10, 5, 0, "author"), (10, 6, 1, "author"), (12, 7, 0, "editor")], "item_id long, author_id long, position int, role string")
    out = L.acted(decisions, new, items, item_authors=old, candidate_authors=own)
    assert {r.id: r.metadata_json for r in out["items"].collect()} == {1: '{"a":"1","b":"4","c":"5"}', 12: None}
    assert {tuple(r) for r in out["item_authors"].collect()} == {(1, 5, 0, "author"), (1, 6, 1, "author"), (12, 7, 0, "editor")}


def test_collections_and_deletes(spark):
    known = spark.createDataFrame([(1, "Physics", None), (2, "Reactors", 1)], "collection_id long, name string, parent_id long")
    incoming = spark.createDataFrame([(70, "Physics", None), (71, "Reactors", 70), (72, "Boron", 71), (73, " ", None), (74, "Reactors", None)], "source_id long, name string, parent_id long")
    after, ids = L.collections_upserted(known, incoming)
    ids = {r.source_id: r.collection_id for r in ids.collect()}
    assert (ids[70], ids[71]) == (1, 2) and {ids[72], ids[74]} == {3, 4}
    assert {(r.name, r.parent_id) for r in after.collect()} == {("Physics", None), ("Reactors", 1), ("Boron", 2), ("Reactors", None)}
    tables = {
        "library_items": spark.createDataFrame([(1,), (2,)], "id long"), "chunks": spark.createDataFrame([(5, 1), (6, 2)], "chunk_id long, item_id long"),
        "chunk_embeddings": spark.createDataFrame([(5,), (6,)], "chunk_id long"), "item_relations": spark.createDataFrame([(1, 2), (2, 2)], "subject_id long, object_id long"),
    }
    left = L.deleted(tables, spark.createDataFrame([(1,)], "id long"))
    assert {n: df.count() for n, df in left.items()} == {"library_items": 1, "chunks": 1, "chunk_embeddings": 1, "item_relations": 1}
