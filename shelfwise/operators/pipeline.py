"""From candidates to the library: resolving, deciding's consequences, indexing. Tables in, new tables out.

Spark's tables do not change in place: each function gives the rows of a table's next version, or rows to append.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions import pyfuncs as P
from ..functions import text as X
from ..session import cut, drop
from . import graph as G
from . import metadata as M

#: Fields that a merge fills where the stored item has none (fixed values).
BACKFILLED = ("abstract", "publication_year", "doi", "arxiv_id", "isbn", "venue", "volume", "issue", "pages", "series", "series_number", "edition", "language", "content_hash")


# --- resolving --------------------------------------------------------------------------------------------


def wanted(files: DataFrame, text_col: str = "text", key: str = "path") -> DataFrame:
    """(key, kind, value): the first DOI, arXiv id and ISBN of each file's text."""
    ids = X.identifiers(F.col(text_col))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.get(ids[f], F.lit(0)).alias("value")) for k, f in (("doi", "dois"), ("arxiv", "arxiv_ids"), ("isbn", "isbns"))])
    return files.select(key, F.explode(each).alias("x")).select(key, "x.*").where("value is not null")


def resolved(files: DataFrame, candidates: list[DataFrame], fallback: DataFrame | None = None, key: str = "path") -> DataFrame:
    """One record per file: candidates merged in layers; the fallback only where none came; else the file's stem as title.

    Candidates have ``key``, a source, a confidence and any of the metadata's columns.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), candidates)
    if fallback is not None:
        rows = rows.unionByName(fallback.join(rows.select(key), key, "left_anti"), allowMissingColumns=True)
    fields = [c for c, kind in rows.dtypes if c not in (key, "source", "confidence", "candidate_id") and not kind.startswith("array")]
    rows = rows.withColumn("candidate_id", F.xxhash64(*[c for c in rows.columns if c != "authors"]))
    merged = M.layered(rows, fields, key).withColumnRenamed("source", "metadata_source")
    if "authors" in rows.columns:
        order = F.struct(-M.authority(F.col("source")), -F.coalesce("confidence", F.lit(0.0)), "candidate_id")
        merged = merged.join(rows.where("size(authors) > 0").groupBy(key).agg(F.min_by("authors", order).alias("authors")), key, "left")
    stem = F.regexp_replace(F.regexp_extract(key, r"([^/]+)$", 1), r"\.[^.]*$", "")
    out = files.select(key).distinct().join(merged, key, "left")
    return out.withColumns({"title": F.coalesce(X.nonblank(F.col("title")), stem, F.lit("(untitled)")), "metadata_source": F.coalesce("metadata_source", F.lit("manual_required"))})


# --- acting on decisions ----------------------------------------------------------------------------------


def merge_targets(decisions: DataFrame) -> DataFrame:
    """(id, target_id) of merges, chains followed to their end: within one batch a target may itself be merged.

    Each round doubles the length of chain that is followed and is written, so that plans stay short.
    """
    pairs, path = cut(decisions.where("outcome = 'merge'").select("id", "target_id"), "merges")
    while True:
        ahead = pairs.select(F.col("id").alias("target_id"), F.col("target_id").alias("beyond"))
        # a target that merges back into a smaller id than itself leads on; loops end at their smallest id
        step = pairs.join(ahead, "target_id", "left").select("id", "target_id", F.when((F.col("beyond") < F.col("target_id")) & (F.col("beyond") != F.col("id")), F.col("beyond")).alias("next"))
        after, after_path = cut(step.select("id", F.coalesce("next", "target_id").alias("target_id"), F.col("next").isNotNull().alias("moved")), "merges")
        drop(pairs.sparkSession, path)
        if not after.where("moved").take(1):
            return after.select("id", "target_id")
        pairs, path = after.select("id", "target_id"), after_path


def _numbered(rows: DataFrame, column: str, taken: DataFrame, own: str, order: list[str]) -> DataFrame:
    """``rows`` with ids in ``column`` that follow the largest one of ``taken``, in the given order."""
    last = taken.agg(F.coalesce(F.max(own), F.lit(0)).alias("__last"))
    counted, _ = cut(rows.sort(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    inside = F.row_number().over(W.Window.partitionBy("__part").orderBy(*order))
    # how many rows stand in the partitions before: one row a partition
    sizes = counted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    out = counted.withColumn("__at", inside).join(F.broadcast(before), "__part").join(F.broadcast(last))
    return out.withColumn(column, F.col("__last") + F.col("__before") + F.col("__at")).drop("__part", "__at", "__before", "__last")


def _json_filled(items: DataFrame, merged: DataFrame) -> DataFrame:
    """``items`` whose metadata_json also holds the keys of the merged candidates (id, target_id, metadata_json); candidates win, later ids last."""
    keys = merged.select("target_id", "id", F.explode(F.from_json("metadata_json", "map<string,string>")).alias("key", "value"))
    last = keys.groupBy("target_id", "key").agg(F.max_by("value", "id").alias("value")).groupBy(F.col("target_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("__new"))
    out = items.join(last, "id", "left")
    return out.withColumn("metadata_json", F.when(F.col("__new").isNotNull(), M.merged_json(F.col("metadata_json"), F.to_json("__new"))).otherwise(F.col("metadata_json"))).select(*items.columns)


def acted(
    decisions: DataFrame, candidates: DataFrame, items: DataFrame, when: Column | None = None, item_authors: DataFrame | None = None, candidate_authors: DataFrame | None = None
) -> dict[str, DataFrame]:
    """What decisions (id, outcome, target_id, relation, confidence, reason) do with candidates that are not stored yet.

    items: the next version, with inserted and linked candidates added and merges filled in; relations: edges to add,
    with their inverses; merge_history and ingest_log: rows to append. A candidate's identifier that another item
    already owns is not filled in. JSON objects in metadata_json are joined, the candidate's keys winning. With
    ``item_authors`` and the candidates' bridge (item_id, author_id, position, role) item_authors is their next version:
    authors of merged candidates follow those of their target, others keep their place.
    """
    when = F.current_timestamp() if when is None else when
    rows = candidates.join(decisions.select("id", "outcome", "target_id", "relation", F.col("confidence").alias("__confidence"), F.col("reason").alias("__reason")), "id")
    fields = [f for f in BACKFILLED if f in items.columns and f in candidates.columns]
    kinds = dict(items.dtypes)
    kept = items
    if fields:
        # one record per target: the smallest candidate that fills a field
        fill = rows.where("outcome = 'merge'").groupBy("target_id").agg(*[F.min_by(f, F.when(M.filled(F.col(f), kinds[f]).isNotNull(), F.col("id"))).alias(f) for f in fields])
        for f in (f for f in fields if f in ("doi", "arxiv_id", "content_hash")):
            owned = items.where(F.col(f).isNotNull()).select(F.col(f)).distinct().withColumn("__owned", F.lit(True))
            fill = fill.join(owned, f, "left").withColumn(f, F.when(F.col("__owned").isNull(), F.col(f))).drop("__owned")
        kept = M.backfilled(items, fill.withColumnRenamed("target_id", "id"), fields)
    if "metadata_json" in items.columns and "metadata_json" in candidates.columns:
        kept = _json_filled(kept, rows.where("outcome = 'merge' and metadata_json is not null").select("target_id", "id", "metadata_json"))
    new = rows.where("outcome in ('insert', 'link')").withColumn("title", F.coalesce(X.nonblank(F.col("title")), F.lit("(untitled)")))
    added = new.select(*[(F.col(c) if c in candidates.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in items.columns])
    links = rows.where("outcome = 'link'").select(F.col("id").alias("subject_id"), "relation", F.col("target_id").alias("object_id"), F.col("__confidence").alias("confidence"))
    logged = F.when(F.col("outcome") == "merge", "merged").when(F.col("outcome") == "link", "linked").when(F.col("outcome") == "insert", "inserted").otherwise("skipped")
    out = {}
    if item_authors is not None and candidate_authors is not None:
        own = candidate_authors.join(new.select(F.col("id").alias("item_id")), "item_id", "left_semi").select("item_id", "author_id", "position", "role")
        joined = candidate_authors.join(rows.where("outcome = 'merge'").select(F.col("id").alias("item_id"), "target_id"), "item_id").select(F.col("target_id").alias("item_id"), "author_id", "position")
        out["item_authors"] = M.union_authors(item_authors.select("item_id", "author_id", "position", "role"), joined).unionByName(own)
    return out | {
        "items": kept.unionByName(added),
        "relations": G.with_inverses(links),
        "merge_history": rows.where("outcome = 'merge'").select("target_id", F.col("id").alias("merged_id"), F.col("__reason").alias("reason"), when.alias("merged_at")),
        "ingest_log": rows.select("id", logged.alias("result"), F.coalesce(F.when(F.col("outcome") == "merge", F.col("target_id")), F.col("id")).alias("item_id"), when.alias("ingested_at")),
    }


def authors_upserted(authors: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Authors of incoming (item_id, position, role, family, given, orcid) found by ORCID, else by key and ORCID, else added.

    First the next version of authors, second the bridge (item_id, author_id, position, role).
    """
    key = X.author_key(F.col("family"), F.col("given"))
    rows = incoming.withColumn("normalized_key", key)
    by_orcid = authors.where("orcid is not null").groupBy("orcid").agg(F.min("author_id").alias("a1"))
    by_key = authors.groupBy("normalized_key", F.coalesce("orcid", F.lit("")).alias("o")).agg(F.min("author_id").alias("a2"))
    found = rows.join(by_orcid, "orcid", "left").withColumn("o", F.coalesce("orcid", F.lit(""))).join(by_key, ["normalized_key", "o"], "left").withColumn("author_id", F.coalesce("a1", "a2"))
    fresh = found.where("author_id is null").groupBy("normalized_key", "o").agg(F.min("family").alias("family_name"), F.min("given").alias("given_name"), F.first("orcid").alias("orcid"))
    fresh = _numbered(fresh, "new_id", authors, "author_id", ["normalized_key", "o"])
    bridge = found.join(fresh.select("normalized_key", "o", "new_id"), ["normalized_key", "o"], "left")
    bridge = bridge.select("item_id", F.coalesce("author_id", "new_id").alias("author_id"), F.col("position").cast("int").alias("position"), "role").dropDuplicates(["item_id", "author_id", "role"])
    added = fresh.select(F.col("new_id").alias("author_id"), "family_name", "given_name", "orcid", "normalized_key")
    return authors.select("author_id", "family_name", "given_name", "orcid", "normalized_key").unionByName(added), bridge


def tags_upserted(tags: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next version of tags (tag_id, name) and the bridge (item_id, tag_id) of incoming (item_id, tag): trimmed, blanks dropped."""
    rows = incoming.select("item_id", F.trim("tag").alias("name")).where("name <> ''").distinct()
    fresh = _numbered(rows.select("name").distinct().join(tags, "name", "left_anti"), "tag_id", tags, "tag_id", ["name"]).select("tag_id", "name")
    all_tags = tags.select("tag_id", "name").unionByName(fresh)
    return all_tags, rows.join(all_tags, "name").select("item_id", "tag_id")


def chapters_split(books: DataFrame, toc: DataFrame, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chapter items of books (id, title, page_count) by their tables of contents, and their chapter_of edges with inverses.

    Ids follow the largest one of ``items``, or of the books.
    """
    ranges = _numbered(G.chapter_ranges(toc, books.select(F.col("id").alias("book_id"), "page_count")), "id", books if items is None else items, "id", ["book_id", "index"])
    chapters = ranges.select(
        "id", "book_id", "index", "title", F.lit("chapter").alias("item_type"),
        F.to_json(F.struct("start_page", "end_page", F.col("book_id").alias("parent_id"))).alias("metadata_json"),
    )
    edges = chapters.select(F.col("id").alias("subject_id"), F.lit("chapter_of").alias("relation"), F.col("book_id").alias("object_id"), F.lit(1.0).alias("confidence"))
    return chapters, G.with_inverses(edges)


def collections_upserted(collections: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next version of collections (collection_id, name, parent_id) and (source_id, collection_id) of incoming ones.

    Incoming (source_id, name, parent_id) are found by their name under the same parent name, else added; parents are
    given by source_id and come out under the library's ids. Blank names are left out.
    """
    rows = incoming.where(X.nonblank(F.col("name")).isNotNull()).select("source_id", F.trim("name").alias("name"), "parent_id").dropDuplicates(["source_id"])
    named = lambda df, key: df.join(df.select(F.col(key).alias("parent_id"), F.col("name").alias("parent_name")), "parent_id", "left").withColumn("parent_name", F.coalesce("parent_name", F.lit("")))
    known = named(collections.select("collection_id", "name", "parent_id"), "collection_id").groupBy("name", "parent_name").agg(F.min("collection_id").alias("known_id"))
    found, _ = cut(named(rows, "source_id").join(known, ["name", "parent_name"], "left"), "collections")
    fresh = found.where("known_id is null").groupBy("name", "parent_name").agg(F.min("source_id").alias("first_id"))
    fresh = _numbered(fresh, "new_id", collections, "collection_id", ["first_id"])
    placed = found.join(fresh.select("name", "parent_name", "first_id", "new_id"), ["name", "parent_name"], "left").withColumn("collection_id", F.coalesce("known_id", "new_id"))
    ids = placed.select("source_id", "collection_id")
    parents = ids.select(F.col("source_id").alias("parent_id"), F.col("collection_id").alias("new_parent"))
    added = placed.where((F.col("source_id") == F.col("first_id")) & F.col("known_id").isNull()).join(parents, "parent_id", "left")
    after = collections.select("collection_id", "name", "parent_id").unionByName(added.select("collection_id", "name", F.col("new_parent").alias("parent_id")))
    return after, ids


def chapter_log(chapters: DataFrame, when: Column | None = None) -> DataFrame:
    """Rows of the ingest log for chapters that a book was split into."""
    when = F.current_timestamp() if when is None else when
    path = F.concat(F.lit("book:"), F.col("book_id").cast("string"), F.lit("#"), F.col("index").cast("string"))
    return chapters.select(path.alias("source_path"), F.lit("inserted").alias("result"), F.col("id").alias("item_id"), F.lit("chapter").alias("reason"), when.alias("ingested_at"))


def series_log(edges: DataFrame, when: Column | None = None) -> DataFrame:
    """Rows of the ingest log for items linked to their series."""
    when = F.current_timestamp() if when is None else when
    return edges.select(F.concat(F.lit("series:"), "series").alias("source_path"), F.lit("linked").alias("result"), F.col("subject_id").alias("item_id"), F.lit("series").alias("reason"), when.alias("ingested_at"))


def failure_log(failures: DataFrame, when: Column | None = None) -> DataFrame:
    """Rows of the ingest log for files (path, content_hash, reason) that could not be read."""
    when = F.current_timestamp() if when is None else when
    return failures.select(F.col("path").alias("source_path"), "content_hash", F.lit("failed").alias("result"), F.lit(None).cast("long").alias("item_id"), "reason", when.alias("ingested_at"))


#: Tables that rows of an item stand in, with the columns that name it (fixed values).
OWNED = {
    "item_authors": ("item_id",), "item_tags": ("item_id",), "item_collections": ("item_id",), "chunks": ("item_id",), "item_embeddings": ("item_id",), "item_artifacts": ("item_id",),
    "item_relations": ("subject_id", "object_id"), "merge_history": ("target_id",), "chunk_embeddings": (),
}


def deleted(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The next version of each table without the items ``ids`` (id) and all rows that belong to them; chunk vectors go with their chunks."""
    out = dict(tables)
    if "library_items" in tables:
        out["library_items"] = tables["library_items"].join(ids.select("id"), "id", "left_anti")
    for name, columns in OWNED.items():
        if name in tables:
            for column in columns:
                out[name] = out[name].join(ids.select(F.col("id").alias(column)), column, "left_anti")
    if "chunk_embeddings" in tables and "chunks" in tables:
        out["chunk_embeddings"] = tables["chunk_embeddings"].join(out["chunks"].select("chunk_id").distinct(), "chunk_id", "left_semi")
    return out


# --- indexing ---------------------------------------------------------------------------------------------


def unindexed(items: DataFrame, vectors: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Items without a vector, or without chunks where these are asked for; derived items are left out."""
    rows = items.where(~F.col("metadata_source").eqNullSafe("derived"))
    have = vectors.select(F.col("item_id").alias("id")).distinct()
    if chunks is not None:
        have = have.join(chunks.select(F.col("item_id").alias("id")).distinct(), "id", "left_semi")
    return rows.join(have, "id", "left_anti")


def embedded(items: DataFrame, encode: Callable) -> DataFrame:
    """(item_id, embedding) of items by a column function from texts to vectors."""
    return items.select(F.col("id").alias("item_id"), encode(X.embedding_text(F.col("title"), F.col("abstract"))).alias("embedding"))


_SECTIONS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("section", T.StringType())]))


def section_chunks(documents: DataFrame, tei_col: str = "tei", key: str = "item_id", target: int = P.TARGET, overlap: int = P.OVERLAP) -> DataFrame:
    """(key, chunk_index, page, text, section): each section of a TEI chunked on its own, numbered through the item."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts):
        return texts.map(lambda t: [c[2] for c in P.chunk_pages([(None, t)], target, overlap)] if t else [])

    parsed = documents.select(key, P.tei(tei_col).alias("t")).where(P.is_tei(F.col("t")))
    sections = parsed.select(key, F.posexplode("t.sections").alias("no", "s")).select(key, "no", X.section(F.col("s.heading")).alias("section"), cut(F.col("s.text")).alias("c"))
    rows = sections.select(key, "no", "section", F.posexplode("c").alias("k", "text"))
    place = F.row_number().over(W.Window.partitionBy(key).orderBy("no", "k")) - 1
    return rows.select(key, place.cast("int").alias("chunk_index"), F.lit(None).cast("int").alias("page"), "text", "section")


def chunk_embedded(chunks: DataFrame, encode: Callable) -> DataFrame:
    """(chunk_id, embedding) of passages by a column function from texts to vectors; chunks without an id are keyed by item and index."""
    rows = chunks if "chunk_id" in chunks.columns else chunks.withColumn("chunk_id", F.xxhash64("item_id", "chunk_index"))
    return rows.where("text is not null").select("chunk_id", encode(F.col("text")).alias("embedding"))


def indexed(
    items: DataFrame, vectors: DataFrame, chunks: DataFrame, encode: Callable, tei: DataFrame, pages: DataFrame, force: bool = False, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Vectors and chunks of items not indexed yet (or of all): sections of the TEI where an item has one, else its pages.

    ``limit`` takes the first items by id before those that are indexed already are passed over. ``chunk_embedded``
    gives the vectors of the chunks.
    """
    items = items if limit is None else items.where(~F.col("metadata_source").eqNullSafe("derived")).orderBy("id").limit(limit)
    todo = items if force else unindexed(items, vectors, chunks)
    ids = todo.select(F.col("id").alias("item_id"))
    by_section = section_chunks(tei.join(ids, "item_id", "left_semi"))
    rest = pages.join(ids, "item_id", "left_semi").join(by_section.select("item_id").distinct(), "item_id", "left_anti")
    by_page = P.chunk_items(rest, "item_id").withColumn("section", F.lit(None).cast("string")).select("item_id", "chunk_index", "page", "text", "section")
    return embedded(todo, encode), by_section.unionByName(by_page)
