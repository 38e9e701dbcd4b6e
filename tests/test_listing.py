import datetime as dt

import pytest

from shelfwise.library import Library
from shelfwise.operators import listing as L

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def library(spark):
    make = spark.createDataFrame
    items = [
        (1, "paper", "Boron dilution transients in PWR", "About boron.", 2024, "10.1/boron", None, None, "Nucl. Eng. Design", "en", "ab" * 32, "crossref", 1.0, DAY),
        (2, "preprint", "Boron dilution transients in PWR (preprint)", None, 2023, None, "2301.11111", None, None, "en", None, "arxiv", 0.9, DAY + dt.timedelta(1)),
        (3, "book", "nuclear reactor physics handbook", "", 2020, None, None, "9780131101630", " ", "en", None, None, None, DAY + dt.timedelta(2)),
    ]
    return Library(
        spark,
        {
            "library_items": make(items, "id long, item_type string, title string, abstract string, publication_year int, doi string, arxiv_id string, isbn string, venue string, language string, content_hash string, metadata_source string, metadata_confidence double, added_at timestamp"),
            "authors": make([(10, "Smith", "Alice", "smith,a"), (11, "Doe", "Bob", "doe,b"), (12, "Editor", "Em", "editor,e")], "author_id long, family_name string, given_name string, normalized_key string"),
            "item_authors": make([(1, 10, 0, "author"), (1, 11, 1, "author"), (2, 10, 0, "author"), (3, 12, 0, "editor"), (1, 10, 0, "author")], "item_id long, author_id long, position int, role string"),
            "chunks": make([(100 + p, 1, p - 1, p, f"Boron passage {p}.", "methods" if p == 2 else None) for p in (1, 2, 3)], "chunk_id long, item_id long, chunk_index int, page int, text string, section string"),
            "item_relations": make([(2, "preprint_of", 1, None), (1, "Published-As", 2, 1.0)], "subject_id long, relation string, object_id long, confidence double"),
            "item_embeddings": make([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "item_id long, embedding array<float>"),
            "tags": make([(1, "safety"), (2, "unused")], "tag_id long, name string"),
            "item_tags": make([(1, 1)], "item_id long, tag_id long"),
            "collection_rows": make([(1, "A", None, None), (2, "B", 1, None), (3, "Loop", 3, None)], "collection_id long, name string, parent_id long, item_count long"),
            "item_collections": make([(1, 2)], "item_id long, collection_id long"),
            "item_tei": make([(1, '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head n="2.1">Methods</head><p>One.</p></div></body></text></TEI>'), (2, "<broken")], "item_id long, tei string"),
        },
    )


def ids(frame):
    return [r[0] for r in frame.select("id").collect()]


def test_search(library):
    for mode in ("keyword", "semantic", "hybrid"):
        rows = library.search("boron", mode, query_vector=[1.0, 0.0], dim=2).collect()
        assert rows[0].item_id == 1 and rows[0].snippet.startswith("Boron passage") or mode == "semantic"
    assert {r.item_type for r in library.search("boron", item_types=["preprint"], exact=True).collect()} == {"preprint"}
    assert library.search("boron", "keyword", section="methods").where("item_id = 1").first().page == 2
    assert library.search("boron", "keyword", section="conclusion").where("item_id = 1").first().snippet is None
    assert library.search(" ", "keyword").collect() == []
    with pytest.raises(ValueError):
        library.search("x", "fuzzy")


def test_tools(library):
    item = library.get_item(1).first()
    assert item.authors == ["Alice Smith", "Bob Doe"] and item.tags == ["safety"] and item.collections == ["B"]
    assert library.get_full_text(1, [2]).first().text == "Boron passage 2."
    assert library.get_full_text(2).first().text == ""
    assert [r.page for r in library.get_snippets("passage", 1, 2).collect()] and library.get_snippets("boron", 2).collect() == []
    assert [(r.object_id, r.relation) for r in library.list_related(1).collect()] == [(2, "published_as")]
    assert [r.object_id for r in library.list_related(2, "preprint_chain").collect()] == [1] and library.list_related(1, "citations").collect() == []
    entry = library.get_citation(1).first().entry
    assert entry.startswith("@article{smith_2024_boron") and "author = {Smith and Doe}" in entry
    assert [(r.name, r.n) for r in library.list_tags().collect()] == [("safety", 1), ("unused", 0)]
    assert {(r.name, r.own, r.total) for r in library.list_collections().collect()} == {("A", 0, 1), ("B", 1, 1)}
    assert [(r.level, r.label) for r in library.get_document_structure(1).collect()] == [(2, "methods")] and library.get_document_structure(2).collect() == []
    assert ids(library.find_by_tag("safety")) == [1] and ids(library.find_by_tag("none")) == []
    assert [r.item_id for r in library.nearest_items(1, 1, 2).collect()] == [2]


def test_listings(library):
    assert ids(library.browse()) == [3, 2, 1] and ids(library.browse("year_asc")) == [3, 2, 1] and ids(library.browse("title")) == [1, 2, 3]
    assert ids(library.browse("author")) == [2, 1, 3] and ids(library.browse("nonsense")) == [3, 2, 1]
    assert ids(library.browse(limit=2)) == [3, 2] and ids(library.browse(offset=2, limit=2)) == [1]
    assert library.count(item_type="paper", year=2024, venue="Nucl. Eng. Design", author_id=10, tag="safety", collection_id=2) == 1
    facets = {k: [tuple(r) for r in v.collect()] for k, v in library.facets().items()}
    assert facets["type"] == [("paper", 1), ("preprint", 1), ("book", 1)] and facets["venue"] == [("Nucl. Eng. Design", 1)]
    assert [r[0] for r in facets["year"]] == [2024, 2023, 2020] and [r[0] for r in facets["author"]] == [11, 10]
    assert L.page_links(120, 50, 50) == {"first": 0, "prev": 0, "next": 100, "last": 100} and L.page_links(0, 0, 50) == {}
    assert [(r.id, r.place) for r in L.hydrate(library.items, [3, 9, 1, 3]).collect()] == [(3, 0), (1, 2)]
