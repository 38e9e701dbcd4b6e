"""Listing: filters that stack, named sorts, pages, counts and facets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_name, lenient_int, nonblank

PAGE, LARGEST = 50, 200

#: Types of items, in the order facets show them (fixed values).
ITEM_TYPES = ("paper", "preprint", "book", "chapter", "thesis", "report", "standard", "patent", "other")

FEED = ("id", "item_type", "title", "abstract", "publication_year", "doi", "arxiv_id", "isbn", "venue", "language", "content_hash", "metadata_source", "metadata_confidence", "added_at")


@dataclass(frozen=True)
class Filters:
    """Any subset of these narrows a listing; all that are given must hold."""

    item_type: str | None = None
    year: int | None = None
    venue: str | None = None
    author_id: int | None = None
    items: DataFrame | None = None  # (item_id): a tag's or collection's members


def filtered(items: DataFrame, filters: Filters, item_authors: DataFrame | None = None) -> DataFrame:
    """The items that satisfy the filters; joins happen only for filters that are given."""
    for column, value in (("item_type", filters.item_type), ("publication_year", filters.year), ("venue", filters.venue)):
        if value is not None:
            items = items.where(F.col(column) == value)
    if filters.author_id is not None:
        own = item_authors.where(F.col("author_id") == filters.author_id).select(F.col("item_id").alias("id"))
        items = items.join(own, "id", "left_semi")
    if filters.items is not None:
        items = items.join(filters.items.select(F.col("item_id").alias("id")), "id", "left_semi")
    return items


def first_author(item_authors: DataFrame, authors: DataFrame) -> DataFrame:
    """(id, first_author): the family name, in lower case, at the lowest position; ties to the smaller author."""
    names = item_authors.where("role = 'author'").join(authors.select("author_id", "family_name"), "author_id")
    least = F.min_by(F.lower("family_name"), F.struct("position", "author_id"))
    return names.groupBy(F.col("item_id").alias("id")).agg(least.alias("first_author"))


def order(name: str) -> list[Column]:
    """A named sort; unknown names mean ``added``. ``author`` needs the column first_author."""
    sorts = {
        "added": [F.desc("added_at")],
        "year": [F.desc_nulls_last("publication_year")],
        "year_asc": [F.asc_nulls_last("publication_year")],
        "title": [F.lower("title").asc()],
        "author": [F.asc_nulls_last("first_author")],
    }
    return [*sorts.get(name, sorts["added"]), F.desc("id")]


def venue_order() -> list[Column]:
    """Volumes of a venue: newest first, then volume and issue as numbers, first pages upwards."""
    return [F.desc("publication_year"), lenient_int(F.col("volume")).desc(), lenient_int(F.col("issue")).desc(), lenient_int(F.col("pages")).asc(), F.desc("id")]


def year_order() -> list[Column]:
    """Items of a year: by venue, then volume and issue as numbers from the newest; those without a venue first."""
    return [F.col("venue").asc_nulls_first(), lenient_int(F.col("volume")).desc(), lenient_int(F.col("issue")).desc(), F.desc("id")]


def page(rows: DataFrame, by: list[Column], offset: int = 0, limit: int = PAGE) -> DataFrame:
    """One page; the offset is at least 0, the limit between 1 and ``LARGEST``."""
    return rows.orderBy(*by).offset(max(offset, 0)).limit(min(max(limit, 1), LARGEST))


def page_links(total: int, offset: int, limit: int) -> dict[str, int]:
    """Offsets of the pages to go to: first and previous beyond the first page, next and last before the last one."""
    offset, limit = max(offset, 0), min(max(limit, 1), LARGEST)
    links = {"first": 0, "prev": max(offset - limit, 0)} if offset > 0 else {}
    return links | ({"next": offset + limit, "last": (total - 1) // limit * limit} if offset + limit < total else {})


def hydrate(items: DataFrame, ids: list[int]) -> DataFrame:
    """The items of the given ids in the order given, with their place; unknown ids are left out."""
    wanted = items.sparkSession.createDataFrame([(i, k) for k, i in enumerate(dict.fromkeys(ids))], "id long, place int")
    return items.join(F.broadcast(wanted), "id").orderBy("place")


# --- facets -----------------------------------------------------------------------------------------------


def venues(items: DataFrame, limit: int = 500) -> DataFrame:
    return items.where(nonblank(F.col("venue")).isNotNull()).groupBy("venue").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "venue").limit(limit)


def years(items: DataFrame) -> DataFrame:
    return items.where("publication_year is not null").groupBy("publication_year").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("publication_year"))


def types(items: DataFrame) -> DataFrame:
    """Counts by type, in the vocabulary's order; types without items are left out."""
    place = F.array_position(F.array(*[F.lit(t) for t in ITEM_TYPES]), F.col("item_type"))
    return items.groupBy("item_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.when(place > 0, place).otherwise(len(ITEM_TYPES) + 1), "item_type")


def author_facet(item_authors: DataFrame, authors: DataFrame, limit: int = 1000) -> DataFrame:
    """Authors (not editors) with their numbers of items, by name."""
    counts = item_authors.where("role = 'author'").select("author_id", "item_id").distinct().groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))
    return authors.join(counts, "author_id").orderBy("family_name", F.asc_nulls_first("given_name"), "author_id").limit(limit)


def counts_with_zero(groups: DataFrame, key: str, members: DataFrame, member_key: str) -> DataFrame:
    """Every group with its number of members, 0 where it has none."""
    counts = members.groupBy(F.col(member_key).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    return groups.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def roll_up(tree: DataFrame, pairs: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Every node with its own count and the total of itself and all nodes below it; cycles are left out.

    ``tree`` and ``pairs`` are the results of the hierarchy operator; memberships count, not distinct items.
    """
    below = pairs.join(counts.withColumnRenamed(key, "descendant_id"), "descendant_id").groupBy(key).agg(F.sum("n").alias("below"))
    rows = tree.where("depth >= 0").select(key, "depth").join(counts, key, "left").join(below, key, "left")
    own = F.coalesce("n", F.lit(0))
    return rows.select(key, "depth", own.alias("own"), (own + F.coalesce("below", F.lit(0))).alias("total"))


def authors_of_items(item_authors: DataFrame, authors: DataFrame, role: str | None = "author") -> DataFrame:
    """(item_id, names): display names in order of position; of one role, or of all."""
    rows = item_authors if role is None else item_authors.where(F.col("role") == role)
    named = rows.select("item_id", "author_id", "position").distinct().join(authors.select("author_id", "family_name", "given_name"), "author_id")
    listed = F.collect_list(F.struct("position", "author_id", display_name(F.col("family_name"), F.col("given_name")).alias("name")))
    return named.groupBy("item_id").agg(F.transform(F.array_sort(listed), lambda x: x["name"]).alias("names"))
