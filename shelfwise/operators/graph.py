"""Typed relations between items: inverses, neighbours, series, chapters and page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Each relation with its inverse; ``related`` is its own (fixed values).
INVERSES = {
    "preprint_of": "published_as",
    "published_as": "preprint_of",
    "erratum_for": "corrected_by",
    "corrected_by": "erratum_for",
    "later_edition_of": "earlier_edition_of",
    "earlier_edition_of": "later_edition_of",
    "chapter_of": "contains_chapter",
    "contains_chapter": "chapter_of",
    "part_of": "contains_part",
    "contains_part": "part_of",
    "translates": "translated_from",
    "translated_from": "translates",
    "cites": "cited_by",
    "cited_by": "cites",
    "related": "related",
}

#: Relations of each kind of neighbour (fixed values).
KINDS = {
    "all": tuple(INVERSES),
    "preprint_chain": ("preprint_of", "published_as", "later_edition_of", "earlier_edition_of"),
    "structural": ("chapter_of", "contains_chapter", "part_of", "contains_part"),
    "semantic": ("related",),
    "citations": ("cites", "cited_by"),
}


def plain_relation(relation: Column) -> Column:
    """A label in lower case with single underscores; null where it is none of the vocabulary."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(relation), r"[\s_-]+", "_"), "^_|_$", "")
    return F.when(plain.isin(*INVERSES), plain)


def edges(relations: DataFrame) -> DataFrame:
    """(subject_id, relation, object_id, confidence): labels plain, repeats once with the highest confidence (null is 1)."""
    rows = relations.withColumn("relation", plain_relation(F.col("relation"))).where("relation is not null and subject_id is not null and object_id is not null")
    return rows.groupBy("subject_id", "relation", "object_id").agg(F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))


def inverse(relation: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in INVERSES.items() for x in pair])
    return table[relation]


def with_inverses(relations: DataFrame) -> DataFrame:
    """Edges and their inverses, each once; self-loops of a self-inverse relation are left out."""
    rows = edges(relations).where(~((F.col("relation") == "related") & (F.col("subject_id") == F.col("object_id"))))
    back = rows.select(F.col("object_id").alias("subject_id"), inverse(F.col("relation")).alias("relation"), F.col("subject_id").alias("object_id"), "confidence")
    return rows.unionByName(back).groupBy("subject_id", "relation", "object_id").agg(F.max("confidence").alias("confidence"))


def missing_inverses(relations: DataFrame) -> DataFrame:
    """Edges whose inverse is not stored."""
    rows = edges(relations)
    back = rows.select(F.col("object_id").alias("subject_id"), inverse(F.col("relation")).alias("relation"), F.col("subject_id").alias("object_id"))
    return rows.join(back, ["subject_id", "relation", "object_id"], "left_anti")


def neighbours(relations: DataFrame, items: DataFrame, kind: str = "all") -> DataFrame:
    """(subject_id, relation, object_id, confidence, title): stored relations of a kind with the other item's title."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    rows = edges(relations).where(F.col("relation").isin(*KINDS[kind]))
    return rows.join(items.select(F.col("id").alias("object_id"), "title"), "object_id").select("subject_id", "relation", "object_id", "confidence", "title")


def series_parents(items: DataFrame, series: str, types: tuple[str, ...] = ("book", "chapter", "report")) -> tuple[DataFrame, DataFrame]:
    """Parents derived for series, and the part_of edges of their members.

    First (series, title, members); second (subject_id, relation, series). A series' spelling counts as typed.
    """
    members = items.where(F.col("item_type").isin(*types) & (F.trim(series) != ""))
    parents = members.groupBy(F.col(series).alias("series")).agg(F.count(F.lit(1)).alias("members")).withColumn("title", F.col("series"))
    return parents, members.select(F.col("id").alias("subject_id"), F.lit("part_of").alias("relation"), F.col(series).alias("series"))


def chapter_ranges(toc: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, index, title, start_page, end_page) of tables of contents (book_id, position, title, page).

    A chapter ends a page before the next begins, the last with the book; never before its own start. Books with
    fewer than two entries have no chapters.
    """
    order = W.Window.partitionBy("book_id").orderBy("position")
    rows = toc.join(books.select("book_id", "page_count"), "book_id").select(
        "book_id",
        (F.row_number().over(order) - 1).alias("index"),
        "title",
        F.col("page").alias("start_page"),
        F.greatest("page", F.coalesce(F.lead("page").over(order) - 1, "page_count")).alias("end_page"),
        F.count(F.lit(1)).over(W.Window.partitionBy("book_id")).alias("__n"),
    )
    return rows.where("__n >= 2").drop("__n")


#: Pages in a bin of the range join.
BIN = 32


def pages_of_chapters(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """Pages (book_id, page, text) with the chapter whose range holds them.

    An equi-join on the book and a bin of pages, then the range: the pages of one very long book meet the
    chapters of their own bin only, in as many tasks as the book has bins.
    """
    bins = F.sequence(F.floor(F.col("start_page") / BIN), F.floor(F.col("end_page") / BIN))
    ranges = chapters.where("start_page <= end_page").withColumn("__bin", F.explode(bins))
    placed = pages.withColumn("__bin", F.floor(F.col("page") / BIN))
    return placed.join(ranges, ["book_id", "__bin"]).where(F.col("page").between(F.col("start_page"), F.col("end_page"))).drop("__bin")
