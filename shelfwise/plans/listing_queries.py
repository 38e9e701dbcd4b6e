"""Listing, counting and facet queries over the library's tables, with SQL for the checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import hierarchy as H
from ..operators import listing as L
from ..operators import pipeline
from ..session import table

VENUE = "Annals of Botany"
COLUMNS = "id, item_type, title, publication_year, venue"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "library_items")


def _short(df):
    return df.select("id", "item_type", "title", "publication_year", "venue")


def list_recent(spark, sf_dir):
    """The newest page of items."""
    return _short(L.page(_items(spark, sf_dir), L.order("added")))


def list_by_type(spark, sf_dir):
    return _short(L.page(L.filtered(_items(spark, sf_dir), L.Filters(item_type="book")), L.order("added")))


def _numbered(rows):
    """Volume, issue and pages taken from DOI and hash, which begin with digits or not: the test tables have no such columns."""
    return rows.withColumns({"volume": F.split_part("doi", F.lit("."), F.lit(-1)), "issue": F.col("content_hash"), "pages": F.substring("content_hash", 3, 4)})


def list_by_year(spark, sf_dir):
    """The items of a year by venue, volume and issue."""
    return _short(L.page(_numbered(L.filtered(_items(spark, sf_dir), L.Filters(year=2012))), L.year_order()))


def list_by_venue(spark, sf_dir):
    """The items of a venue by year, volume, issue and first page."""
    rows = L.page(_numbered(L.filtered(_items(spark, sf_dir), L.Filters(venue=VENUE))), L.venue_order())
    return rows.select("id", "publication_year", *[X.lenient_int(F.col(c)).alias(c) for c in ("volume", "issue", "pages")])


def _tagged(spark, sf_dir):
    """Tags and their items, from the kinds of documents about items."""
    links = table(spark, sf_dir, "documents").where("item_id is not null and doc_type is not null").select("item_id", F.col("doc_type").alias("tag"))
    return pipeline.tags_upserted(spark.createDataFrame([(5, "review")], "tag_id long, name string"), links)


def tag_facet(spark, sf_dir):
    """Every tag with the number of its items."""
    tags, links = _tagged(spark, sf_dir)
    return L.counts_with_zero(tags, "tag_id", links, "tag_id").select("name", "n")


def tags_of_items(spark, sf_dir):
    """The tags of each item in order: items, bridge and tags joined."""
    tags, links = _tagged(spark, sf_dir)
    rows = _items(spark, sf_dir).select(F.col("id").alias("item_id")).join(links, "item_id").join(tags, "tag_id")
    return rows.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tags"))


def tag_feed(spark, sf_dir):
    """The newest items of a tag."""
    tags, links = _tagged(spark, sf_dir)
    own = links.join(tags.where("name = 'letter'"), "tag_id").select("item_id")
    return _short(L.page(L.filtered(_items(spark, sf_dir), L.Filters(items=own)), L.order("added"), 0, 100))


def list_filtered_two(spark, sf_dir):
    """Two filters stacked, sorted by title, second page."""
    return _short(L.page(L.filtered(_items(spark, sf_dir), L.Filters(item_type="paper", venue=VENUE)), L.order("title"), 5, 10))


def list_by_author(spark, sf_dir):
    """Items of the author with most rows."""
    links = table(spark, sf_dir, "item_authors").distinct()
    top = links.groupBy("author_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author_id").limit(1)
    own = links.join(top, "author_id", "left_semi").select("item_id")
    return _short(L.page(L.filtered(_items(spark, sf_dir), L.Filters(items=own)), L.order("year")))


def sort_year(spark, sf_dir):
    return _short(L.page(_items(spark, sf_dir), L.order("year"), 0, 100))


def sort_year_asc(spark, sf_dir):
    return _short(L.page(_items(spark, sf_dir), L.order("year_asc"), 0, 100))


def sort_title(spark, sf_dir):
    return _short(L.page(_items(spark, sf_dir), L.order("title"), 0, 100))


def sort_first_author(spark, sf_dir):
    """By the first author's family name, items without authors last."""
    first = L.first_author(table(spark, sf_dir, "item_authors"), table(spark, sf_dir, "authors"))
    return L.page(_items(spark, sf_dir).join(first, "id", "left"), L.order("author"), 0, 100).select("id", "first_author")


def page_offset(spark, sf_dir):
    """An offset beyond the limits is clamped."""
    return _short(L.page(_items(spark, sf_dir), L.order("added"), 40, 1000))


def count_by_type(spark, sf_dir):
    return L.types(_items(spark, sf_dir))


def count_all(spark, sf_dir):
    """Counts of a listing page: all, of a type, of a venue, with both."""
    items = _items(spark, sf_dir)
    book, venue = F.col("item_type") == "book", F.col("venue") == VENUE
    return items.agg(F.count(F.lit(1)).alias("items"), F.count_if(book).alias("books"), F.count_if(venue).alias("in_venue"), F.count_if(book & venue).alias("both"))


def facet_venue(spark, sf_dir):
    return L.venues(_items(spark, sf_dir), 50)


def facet_year(spark, sf_dir):
    return L.years(_items(spark, sf_dir))


def facet_author(spark, sf_dir):
    return L.author_facet(table(spark, sf_dir, "item_authors"), table(spark, sf_dir, "authors")).select("author_id", "family_name", "given_name", "n")


def facet_including_zero(spark, sf_dir):
    """Every author with the number of items edited, 0 included."""
    edited = table(spark, sf_dir, "item_authors").where("role = 'editor'").select("item_id", "author_id").distinct()
    return L.counts_with_zero(table(spark, sf_dir, "authors").select("author_id"), "author_id", edited, "author_id")


def _collections(spark, sf_dir):
    rows = table(spark, sf_dir, "collection_rows")
    tree = H.hierarchy(rows)
    counts = rows.dropDuplicates(["collection_id"]).select("collection_id", F.coalesce("item_count", F.lit(0)).alias("n"))
    return tree, counts


def collection_tree_rollup(spark, sf_dir):
    """Collections with their own and their rolled-up numbers of items."""
    tree, counts = _collections(spark, sf_dir)
    return L.roll_up(tree, H.descendants(tree), counts, "collection_id")


def prune_empty_collections(spark, sf_dir):
    """Collections that hold items themselves or below."""
    return collection_tree_rollup(spark, sf_dir).where("total > 0").select("collection_id", "total")


def feed_projection(spark, sf_dir):
    """Feed rows: urn, time and media type beside the columns of the newest items."""
    newest = L.page(_items(spark, sf_dir), L.order("added"), 0, 20)
    path = F.concat(X.cas_path(F.col("content_hash")), F.lit(".pdf"))
    return newest.select(
        "id", "title", X.urn(F.col("doi"), F.col("arxiv_id"), F.col("isbn"), F.col("content_hash"), F.col("id")).alias("urn"),
        X.iso_time(F.col("added_at")).alias("updated"), X.cas_path(X.nonblank(F.col("content_hash"))).alias("path"), X.mime(path).alias("mime"),
    )


def authors_per_item(spark, sf_dir):
    """Authors of every item in order, as one text."""
    named = L.authors_of_items(table(spark, sf_dir, "item_authors"), table(spark, sf_dir, "authors"))
    return named.select("item_id", F.array_join("names", "; ").alias("authors"))


def item_full(spark, sf_dir):
    """Items with authors of all roles and the number of their passages and relations."""
    named = L.authors_of_items(table(spark, sf_dir, "item_authors"), table(spark, sf_dir, "authors"), None).select(F.col("item_id").alias("id"), F.size("names").cast("long").alias("n_names"))
    chunks = table(spark, sf_dir, "chunks").select("item_id", "chunk_index").distinct().groupBy(F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("n_chunks"))
    related = table(spark, sf_dir, "item_relations").distinct().groupBy(F.col("subject_id").alias("id")).agg(F.count(F.lit(1)).alias("n_relations"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return _items(spark, sf_dir).join(named, "id", "left").join(chunks, "id", "left").join(related, "id", "left").select("id", "title", zero("n_names"), zero("n_chunks"), zero("n_relations"))


def full_text_concat(spark, sf_dir):
    """The passages of each item joined in order: length and hash of the text."""
    rows = table(spark, sf_dir, "chunks").select("item_id", "chunk_index", "text").distinct()
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"])
    joined = rows.groupBy("item_id").agg(F.array_join(texts, "\n\n").alias("text"))
    return joined.select("item_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("hash"))


def hydrate_by_ids(spark, sf_dir):
    """Items of given ids in the given order; unknown ids are left out."""
    items = _items(spark, sf_dir)
    return L.hydrate(items, [2001, 4397, 999999, 2011, 2017, 2001]).select("id", "place", "title")


def anti_unindexed(spark, sf_dir):
    """Items without an embedding, derived ones left out."""
    items = _items(spark, sf_dir).where(~F.col("metadata_source").eqNullSafe("derived"))
    return items.join(table(spark, sf_dir, "item_embeddings").select(F.col("item_id").alias("id")), "id", "left_anti").select("id")


def missing_artifact_kind(spark, sf_dir):
    """Items with passages but no section labels: the artifact to build."""
    chunks = table(spark, sf_dir, "chunks")
    labelled = chunks.where("section is not null").select("item_id")
    return chunks.select("item_id").distinct().join(labelled, "item_id", "left_anti")


def not_in_cited(spark, sf_dir):
    """Items that no row cites: an anti join in place of NOT IN."""
    cited = table(spark, sf_dir, "item_relations").where("lower(trim(relation)) = 'cites'").select(F.col("object_id").alias("id"))
    return _items(spark, sf_dir).join(cited, "id", "left_anti").select("id")


def artifact_status(spark, sf_dir):
    """Numbers and characters of documents by type."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def json_prop_filter(spark, sf_dir):
    """Events by a number inside their JSON properties."""
    rows = table(spark, sf_dir, "events")
    keys = F.json_object_keys("props")
    return rows.select("event_id", "event_type", F.size(keys).cast("long").alias("n_keys")).where("n_keys > 0")


QUERIES = {
    f.__name__: f
    for f in (
        tag_facet, tags_of_items, tag_feed, list_recent, list_by_type, list_by_year, list_by_venue, list_filtered_two, list_by_author, sort_year, sort_year_asc, sort_title, sort_first_author, page_offset,
        count_by_type, count_all, facet_venue, facet_year, facet_author, facet_including_zero, collection_tree_rollup, prune_empty_collections, feed_projection,
        authors_per_item, item_full, full_text_concat, hydrate_by_ids, anti_unindexed, missing_artifact_kind, not_in_cited, artifact_status, json_prop_filter,
    )
}


def _int(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN NULL ELSE coalesce(try_cast(nullif(regexp_extract({column}, '^\\s*([+-]?[0-9]{{1,18}})', 1), '') AS BIGINT), 0) END"


_TREE = """
WITH RECURSIVE n AS (
  SELECT collection_id AS id, min(parent_id) AS parent, coalesce(min(item_count), 0) AS own FROM collection_rows GROUP BY 1
), l AS (
  SELECT n.id, p.id AS parent, n.own FROM n LEFT JOIN n p ON n.parent = p.id
), t AS (
  SELECT id, 0 AS depth, own FROM l WHERE parent IS NULL
  UNION ALL SELECT l.id, t.depth + 1, l.own FROM t JOIN l ON l.parent = t.id WHERE l.id <> t.id
), d AS (
  SELECT id AS top, id, own FROM t UNION ALL SELECT d.top, l.id, l.own FROM d JOIN l ON l.parent = d.id
), r AS (SELECT top, CAST(sum(own) AS BIGINT) AS total FROM d GROUP BY top)
"""
_DISPLAY = "CASE WHEN trim(coalesce(given_name, '')) <> '' THEN given_name || ' ' || family_name ELSE family_name END"

SQL = {
    "list_recent": f"SELECT {COLUMNS} FROM library_items ORDER BY added_at DESC, id DESC LIMIT 50",
    "list_by_type": f"SELECT {COLUMNS} FROM library_items WHERE item_type = 'book' ORDER BY added_at DESC, id DESC LIMIT 50",
    "list_by_year": f"""SELECT {COLUMNS} FROM library_items WHERE publication_year = 2012
ORDER BY venue NULLS FIRST, {_int("split_part(doi, '.', -1)")} DESC NULLS LAST, {_int('content_hash')} DESC NULLS LAST, id DESC LIMIT 50""",
    "list_by_venue": f"""SELECT id, publication_year, {_int("split_part(doi, '.', -1)")} AS volume, {_int('content_hash')} AS issue, {_int('substr(content_hash, 3, 4)')} AS pages FROM library_items WHERE venue = '{VENUE}'
ORDER BY publication_year DESC NULLS LAST, volume DESC NULLS LAST, issue DESC NULLS LAST, pages NULLS FIRST, id DESC LIMIT 50""",
    "tag_facet": """SELECT name, count(DISTINCT item_id) AS n FROM (SELECT DISTINCT trim(doc_type) AS name, item_id FROM documents WHERE item_id IS NOT NULL AND trim(doc_type) <> '' UNION ALL SELECT 'review', NULL) GROUP BY 1""",
    "tags_of_items": """SELECT item_id, string_agg(name, ',' ORDER BY name) AS tags FROM (SELECT DISTINCT item_id, trim(doc_type) AS name FROM documents WHERE trim(doc_type) <> '') JOIN library_items ON id = item_id GROUP BY 1""",
    "tag_feed": f"SELECT {COLUMNS} FROM library_items WHERE id IN (SELECT item_id FROM documents WHERE trim(doc_type) = 'letter') ORDER BY added_at DESC, id DESC LIMIT 100",
    "list_filtered_two": f"SELECT {COLUMNS} FROM library_items WHERE item_type = 'paper' AND venue = '{VENUE}' ORDER BY lower(title), id DESC LIMIT 10 OFFSET 5",
    "list_by_author": f"""WITH l AS (SELECT DISTINCT * FROM item_authors), a AS (SELECT author_id FROM l GROUP BY 1 ORDER BY count(*) DESC, author_id LIMIT 1)
SELECT {COLUMNS} FROM library_items WHERE id IN (SELECT item_id FROM l JOIN a USING (author_id)) ORDER BY publication_year DESC NULLS LAST, id DESC LIMIT 50""",
    "sort_year": f"SELECT {COLUMNS} FROM library_items ORDER BY publication_year DESC NULLS LAST, id DESC LIMIT 100",
    "sort_year_asc": f"SELECT {COLUMNS} FROM library_items ORDER BY publication_year ASC NULLS LAST, id DESC LIMIT 100",
    "sort_title": f"SELECT {COLUMNS} FROM library_items ORDER BY lower(title), id DESC LIMIT 100",
    "sort_first_author": """WITH f AS (SELECT item_id AS id, arg_min(lower(family_name), (position, author_id)) AS first_author FROM item_authors JOIN authors USING (author_id) WHERE role = 'author' GROUP BY 1)
SELECT id, first_author FROM library_items LEFT JOIN f USING (id) ORDER BY first_author NULLS LAST, id DESC LIMIT 100""",
    "page_offset": f"SELECT {COLUMNS} FROM library_items ORDER BY added_at DESC, id DESC LIMIT 200 OFFSET 40",
    "count_by_type": "SELECT item_type, count(*) AS n FROM library_items GROUP BY 1",
    "count_all": f"SELECT count(*) AS items, count(*) FILTER (item_type = 'book') AS books, count(*) FILTER (venue = '{VENUE}') AS in_venue, count(*) FILTER (item_type = 'book' AND venue = '{VENUE}') AS both FROM library_items",
    "facet_venue": "SELECT venue, count(*) AS n FROM library_items WHERE trim(venue) <> '' GROUP BY 1 ORDER BY n DESC, venue LIMIT 50",
    "facet_year": "SELECT publication_year, count(*) AS n FROM library_items WHERE publication_year IS NOT NULL GROUP BY 1",
    "facet_author": """SELECT author_id, family_name, given_name, n FROM authors JOIN (SELECT author_id, count(DISTINCT item_id) AS n FROM item_authors WHERE role = 'author' GROUP BY 1) USING (author_id)
ORDER BY family_name, given_name NULLS FIRST, author_id LIMIT 1000""",
    "facet_including_zero": "SELECT author_id, count(DISTINCT item_id) AS n FROM authors LEFT JOIN (SELECT * FROM item_authors WHERE role = 'editor') USING (author_id) GROUP BY 1",
    "collection_tree_rollup": _TREE + "SELECT t.id AS collection_id, CAST(t.depth AS INTEGER) AS depth, t.own, r.total FROM t JOIN r ON r.top = t.id",
    "prune_empty_collections": _TREE + "SELECT top AS collection_id, total FROM r WHERE total > 0",
    "feed_projection": """SELECT id, title, CASE WHEN trim(doi) <> '' THEN 'urn:doi:' || doi WHEN trim(arxiv_id) <> '' THEN 'urn:arxiv:' || arxiv_id WHEN trim(isbn) <> '' THEN 'urn:isbn:' || isbn
  WHEN trim(content_hash) <> '' THEN 'urn:sha256:' || content_hash ELSE 'urn:item:' || id END AS urn, strftime(timezone('UTC', CAST(added_at AS TIMESTAMPTZ)), '%Y-%m-%dT%H:%M:%SZ') AS updated,
  CASE WHEN trim(content_hash) <> '' THEN substring(content_hash, 1, 2) || '/' || substring(content_hash, 3, 2) || '/' || content_hash ELSE '' END AS path, 'application/pdf' AS mime
FROM library_items ORDER BY added_at DESC, id DESC LIMIT 20""",
    "authors_per_item": f"SELECT item_id, string_agg({_DISPLAY}, '; ' ORDER BY position, author_id) AS authors FROM (SELECT DISTINCT item_id, author_id, position FROM item_authors WHERE role = 'author') JOIN authors USING (author_id) GROUP BY 1",
    "item_full": """SELECT id, title, coalesce(n_names, 0) AS n_names, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_relations, 0) AS n_relations FROM library_items
LEFT JOIN (SELECT item_id AS id, count(*) AS n_names FROM (SELECT DISTINCT item_id, author_id, position FROM item_authors) GROUP BY 1) USING (id)
LEFT JOIN (SELECT item_id AS id, count(DISTINCT chunk_index) AS n_chunks FROM chunks GROUP BY 1) USING (id)
LEFT JOIN (SELECT subject_id AS id, count(*) AS n_relations FROM (SELECT DISTINCT * FROM item_relations) GROUP BY 1) USING (id)""",
    "full_text_concat": "SELECT item_id, length(t) AS n_chars, sha256(t) AS hash FROM (SELECT item_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS t FROM (SELECT DISTINCT item_id, chunk_index, text FROM chunks) GROUP BY 1)",
    "hydrate_by_ids": "SELECT id, place, title FROM library_items JOIN (VALUES (2001, 0), (4397, 1), (999999, 2), (2011, 3), (2017, 4)) AS v(id, place) USING (id)",
    "anti_unindexed": "SELECT id FROM library_items WHERE metadata_source IS DISTINCT FROM 'derived' AND NOT EXISTS (SELECT 1 FROM item_embeddings WHERE item_id = id)",
    "missing_artifact_kind": "SELECT DISTINCT item_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunks d WHERE d.item_id = c.item_id AND d.section IS NOT NULL)",
    "not_in_cited": "SELECT id FROM library_items WHERE NOT EXISTS (SELECT 1 FROM item_relations WHERE object_id = id AND lower(trim(relation, ' ')) = 'cites')",
    "artifact_status": "SELECT doc_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "json_prop_filter": "SELECT event_id, event_type, len(json_keys(props)) AS n_keys FROM events WHERE len(json_keys(props)) > 0",
}
