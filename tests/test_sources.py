import io
import json
import os
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import pyfuncs as P
from shelfwise.sources import catalog as C
from shelfwise.sources import files as S
from shelfwise.sources import registry as R
from shelfwise.streaming import ingest


def epub(chapters=(("One", "<h1>First</h1><p>Hello there.</p>"), ("Two", "<p>More&nbsp;text</p><script>x</script>"))):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{k}" href="c{k}.html"/>' for k in range(len(chapters)))
        spine = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters)))
        z.writestr("OPS/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>A Book</dc:title><dc:creator>Ann Author</dc:creator></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>')
        for k, (_, html) in enumerate(chapters):
            z.writestr(f"OPS/c{k}.html", f"<html><body>{html}</body></html>")
    return out.getvalue()


def test_walk_epub_and_store(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.EPUB").write_bytes(epub())
    (tmp_path / "in/sub/b.pdf").write_bytes(b"%PDF-1.4 fake")
    (tmp_path / "in/sub/copy.pdf").write_bytes(b"%PDF-1.4 fake")
    (tmp_path / "in/c.txt").write_bytes(b"no")
    files = S.walk(spark, str(tmp_path / "in"))
    assert [(os.path.basename(r.path), r.kind) for r in files.select("path", "kind").collect()] == [("a.EPUB", "epub"), ("b.pdf", "pdf"), ("copy.pdf", "pdf")]
    assert S.walk(spark, str(tmp_path / "in"), recursive=False).count() == 1
    parsed = files.where("kind = 'epub'").select(S.epub("content").alias("e"))
    row = parsed.select("e", S.epub_text(F.col("e")).alias("text")).first()
    assert row.e.facts == {"title": "A Book", "creator": "Ann Author"} and [s.title for s in row.e.spine] == ["First", "Chapter 2"] and row.text == "First\nHello there.\n\nMore text"
    pages = S.pdf_pages(files, lambda content: ["", f"{len(content)} bytes"])
    assert [(r.page, r.text) for r in pages.collect()] == [(2, "13 bytes")] * 2
    root = f"file://{tmp_path}/cas"
    first = S.store(files, root).collect()
    assert sorted(r.stored for r in first) == [True, True] and all(os.path.exists(f"{tmp_path}/cas/{r.path}") for r in first)
    assert not any(r.stored for r in S.store(files, root).collect())
    known = spark.createDataFrame([(1, first[0].content_hash)], "id long, content_hash string")
    new, old = S.unseen(files, known)
    assert new.count() == 1 and old.count() >= 1


def test_pdf_needs_a_reader(spark):
    with pytest.raises(NotImplementedError):
        S.pdf_pages(spark.createDataFrame([], "path string, kind string, content binary"))


def test_damaged_books():
    assert S.read_epub(b"PK nonsense") is None and S.read_epub(None) is None


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Main  title</title></titleStmt>
<sourceDesc><biblStruct><analytic><author><persName><forename>Bob</forename><forename>J.</forename><surname>Doe</surname></persName></author></analytic>
<monogr><imprint><date when="2024-03-01"/></imprint></monogr><idno type="DOI">10.1/X</idno></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><div><p>One.</p><p>Two.</p></div></abstract></profileDesc></teiHeader>
<text><body><div><head n="1">Introduction</head><p>First.</p><p>Second.</p></div><div><head n="2.1">Methods</head></div><div/></body>
<back><listBibl><biblStruct><analytic><title/></analytic><monogr><title>A Journal</title><imprint><date>2018</date></imprint></monogr></biblStruct></listBibl></back></text></TEI>"""


def test_tei(spark):
    frame = spark.createDataFrame([("1", TEI), ("2", "<broken"), ("3", None)], "key string, xml string").withColumn("tei", P.tei("xml"))
    rows = {r.key: r.tei for r in frame.collect()}
    t = rows["1"]
    assert (t.header.title, t.header.abstract, t.header.doi, t.header.year) == ("Main title", "One.\n\nTwo.", "10.1/X", 2024)
    assert [(a.family, a.given) for a in t.header.authors] == [("Doe", "Bob J.")]
    assert [(s.level, s.heading, s.text) for s in t.sections] == [(1, "Introduction", "First.\n\nSecond."), (2, "Methods", "")]
    assert [(r.title, r.year, r.venue) for r in t.references] == [("A Journal", 2018, "A Journal")]
    assert frame.where(P.is_tei(F.col("tei"))).count() == 1
    header = R.header_records(frame).collect()
    assert [(r.key, r.title, r.doi, r.source) for r in header] == [("1", "Main title", "10.1/x", "grobid")]


def test_registries(spark):
    def rows(*answers):
        return spark.createDataFrame([(str(k), a if isinstance(a, str) else json.dumps(a)) for k, a in enumerate(answers)], "key string, json string")

    work = {"type": "book-chapter", "title": ["T"], "abstract": "<jats:title>Abstract</jats:title><jats:p>A.</jats:p>", "DOI": "10.1/ABC", "issued": {"date-parts": [[2020, 5]]}, "container-title": ["J"], "author": [{"family": "Doe", "given": "J", "ORCID": "http://orcid.org/0000-0002-1825-0097"}, {"name": "A Group"}, {}]}
    r = R.doi_records(rows({"message": work}, {})).orderBy("key").collect()
    assert (r[0].item_type, r[0].title, r[0].abstract, r[0].doi, r[0].publication_year, r[0].venue) == ("chapter", "T", "A.", "10.1/abc", 2020, "J")
    assert [tuple(a) for a in r[0].authors] == [("Doe", "J", "0000-0002-1825-0097"), ("A Group", None, None)] and r[1].title is None
    a = R.arxiv_records(rows({"id": "http://arxiv.org/abs/2401.01234v2", "title": "T", "published": "2024-01-02", "authors": ["Ada B. Lovelace"], "doi": "10.1/X"})).first()
    assert (a.arxiv_id, a.publication_year, a.linked_doi, a.authors[0].family) == ("2401.01234", 2024, "10.1/x", "Lovelace")
    b = R.isbn_records(rows({"title": "B", "publish_date": "May 1998", "publishers": [{"name": "P"}], "authors": [{"name": "Ann Author"}]})).first()
    assert (b.publication_year, b.venue, b.authors[0].family) == (1998, "P", "Author")
    c = R.prose_records(rows('Sure! {"title": "T", "year": "2011", "authors": ["A B"]} Done.', "no json")).collect()
    assert [(x.title, x.publication_year) for x in c] == [("T", 2011)]
    said = spark.createDataFrame([("I think: SAME work",), ('{"verdict": "related"}',), ("unclear",)], "a string").select(R.verdict(F.col("a")).alias("v"))
    assert [x.v for x in said.collect()] == ["same", "related", None]
    got = R.fetched(spark.createDataFrame([("k",), ("k",)], "key string"), lambda k: k.upper())
    assert [tuple(x) for x in got.collect()] == [("k", "K")]


@pytest.fixture()
def catalog(tmp_path):
    path = str(tmp_path / "catalog.sqlite")
    db = sqlite3.connect(path)
    db.executescript("""
CREATE TABLE itemTypes(itemTypeID INTEGER, typeName TEXT); INSERT INTO itemTypes VALUES (1,'journalArticle'),(2,'book'),(3,'attachment'),(4,'podcast');
CREATE TABLE items(itemID INTEGER PRIMARY KEY, itemTypeID INTEGER, key TEXT); INSERT INTO items VALUES (1,1,'K1'),(2,2,'K2'),(3,3,'K3'),(4,1,'K4'),(5,4,'K5'),(6,3,'K6');
CREATE TABLE deletedItems(itemID INTEGER); INSERT INTO deletedItems VALUES (4);
CREATE TABLE fields(fieldID INTEGER, fieldName TEXT); INSERT INTO fields VALUES (1,'title'),(2,'date'),(3,'DOI'),(4,'ISBN'),(5,'publicationTitle'),(6,'extra');
CREATE TABLE itemDataValues(valueID INTEGER, value TEXT); INSERT INTO itemDataValues VALUES (1,' An article '),(2,'2019-05-00'),(3,'https://doi.org/10.1/ABC'),(4,'0-13-110163-3'),(5,'J. Test'),(6,'A book'),(7,'circa 1998'),(8,'note');
CREATE TABLE itemData(itemID INTEGER, fieldID INTEGER, valueID INTEGER); INSERT INTO itemData VALUES (1,1,1),(1,2,2),(1,3,3),(1,5,5),(1,6,8),(2,1,6),(2,4,4),(2,2,7),(5,2,2);
CREATE TABLE creators(creatorID INTEGER, lastName TEXT, firstName TEXT); INSERT INTO creators VALUES (1,'Doe','Jane'),(2,'','An Institute'),(3,'Ed','Em'),(4,'Cast','Member');
CREATE TABLE creatorTypes(creatorTypeID INTEGER, creatorType TEXT); INSERT INTO creatorTypes VALUES (1,'author'),(2,'editor'),(3,'castMember');
CREATE TABLE itemCreators(itemID INTEGER, creatorID INTEGER, creatorTypeID INTEGER, orderIndex INTEGER); INSERT INTO itemCreators VALUES (1,2,1,1),(1,1,1,0),(1,4,3,2),(2,3,2,0);
CREATE TABLE tags(tagID INTEGER, name TEXT); INSERT INTO tags VALUES (1,' safety '),(2,' ');
CREATE TABLE itemTags(itemID INTEGER, tagID INTEGER); INSERT INTO itemTags VALUES (1,1),(1,2);
CREATE TABLE collections(collectionID INTEGER, collectionName TEXT, parentCollectionID INTEGER); INSERT INTO collections VALUES (2,'Child',1),(1,'Top',NULL);
CREATE TABLE collectionItems(collectionID INTEGER, itemID INTEGER); INSERT INTO collectionItems VALUES (2,1);
CREATE TABLE itemAttachments(itemID INTEGER, parentItemID INTEGER, contentType TEXT, path TEXT); INSERT INTO itemAttachments VALUES (6,1,'application/pdf','/abs/x.pdf'),(3,1,'application/pdf','storage:y.pdf');
""")
    db.commit()
    db.close()
    return path


def test_catalog_import(spark, catalog):
    t = C.tables(spark, catalog)
    rows = {r.source_id: r for r in C.records(t).collect()}
    assert set(rows) == {1, 2}
    a, b = rows[1], rows[2]
    assert (a.item_type, a.title, a.publication_year, a.doi, a.venue) == ("paper", "An article", 2019, "10.1/abc", "J. Test")
    assert [(x.position, x.role, x.family, x.given) for x in a.authors] == [(0, "author", "Doe", "Jane"), (1, "author", "An Institute", None)]
    assert (b.item_type, b.isbn, b.publication_year, b.authors[0].role) == ("book", "9780131101630", 1998, "editor")
    tags, groups = C.labels(t)
    assert [tuple(r) for r in tags.collect()] == [(1, "safety")] and [tuple(r) for r in groups.collect()] == [(1, 2)]
    assert {tuple(r) for r in C.collections(t).collect()} == {(1, "Top", None), (2, "Child", 1)}
    assert [tuple(r) for r in C.attachments(t, "/lib/storage").collect()] == [(1, "/lib/storage/K3/y.pdf")]
    have = spark.createDataFrame([("/abs/x.pdf",)], "path string")
    assert [tuple(r) for r in C.attachments(t, "/lib/storage", have).collect()] == [(1, "/abs/x.pdf")]
    stored = spark.createDataFrame([(a.metadata_json,)], "metadata_json string")
    fresh = C.pending(C.records(t), stored)
    assert [r.source_id for r in fresh.collect()] == [2]
    decisions = spark.createDataFrame([(2, "insert")], "id long, outcome string")
    assert tuple(C.report(C.records(t), fresh, decisions).first()) == (2, 1, 1, 0, 0)


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "events")
    events.repartition(3).write.parquet(folder)
    query = ingest.event_stream(spark, folder, events.schema).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in ingest.windowed(events).collect()}

    inbox, seen = tmp_path / "inbox", []
    inbox.mkdir()
    (inbox / "a.pdf").write_bytes(b"%PDF a")
    (inbox / "b.pdf").write_bytes(b"%PDF a")
    (inbox / "c.epub").write_bytes(b"PK c")
    library = lambda: spark.createDataFrame([(h,) for h in seen], "content_hash string")
    act = lambda rows: seen.extend(r.content_hash for r in rows.select("content_hash").collect())
    for _ in range(2):
        ingest.ingest(ingest.file_stream(spark, str(inbox)), library, act, str(tmp_path / "state")).awaitTermination()
    assert len(seen) == 2


def test_embedder_is_deterministic(spark):
    frame = spark.createDataFrame([("a",), ("b",), (None,)], "t string").select("t", P.stub_embedder(8)("t").alias("v"))
    rows = {r.t: r.v for r in frame.collect()}
    assert len(rows["a"]) == 8 and rows["a"] == P.stub_vector("a", 8).tolist() and rows["a"] != rows["b"] and rows[None] == P.stub_vector("", 8).tolist()


def test_outlines_and_loose_headers(spark):
    from shelfwise.functions import pyfuncs as P
    from shelfwise.sources import files as S
    from shelfwise.sources import registry as R

    pdfs = spark.createDataFrame([("a.pdf", bytearray(b"2")), ("b.pdf", bytearray(b"1")), ("c.pdf", None)], "path string, content binary")
    read = lambda c: [(1, " One ", 1), (2, "Deep", 2), (1, "Two", 5)][: 3 if bytes(c) == b"2" else 1]
    assert [tuple(r) for r in S.pdf_outline(pdfs, read).orderBy("position").collect()] == [("a.pdf", 0, "One", 1), ("a.pdf", 1, "Two", 5)]
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>T</title></titleStmt><sourceDesc><biblStruct><monogr><title>J. Test</title><imprint><date when="1999-05"/></imprint></monogr><note>see 10.1234/abc.</note></biblStruct></sourceDesc></fileDesc></teiHeader></TEI>'
    frame = spark.createDataFrame([("1", tei)], "key string, tei string").select("key", P.tei("tei").alias("tei"))
    row = R.header_records(frame).first()
    assert (row.title, row.venue, row.doi, row.publication_year) == ("T", "J. Test", "10.1234/abc", 1999)
