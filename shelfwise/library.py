"""One object for a library's tables: the tools and listings a user calls, each giving a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import feeds
from .functions import pyfuncs as P
from .functions import text as X
from .operators import fts
from .operators import graph as G
from .operators import hierarchy as H
from .operators import listing as L
from .operators import retrieval as R
from .operators import vector as V
from .session import table

#: Columns of tables a library may lack; such a table is empty then.
_OPTIONAL = {
    "tags": "tag_id long, name string",
    "item_tags": "item_id long, tag_id long",
    "item_collections": "item_id long, collection_id long",
    "collection_rows": "collection_id long, name string, parent_id long, item_count long",
    "item_embeddings": "item_id long, embedding array<float>",
    "item_relations": "subject_id long, relation string, object_id long, confidence double",
    "item_tei": "item_id long, tei string",
}


@dataclass
class Library:
    """Tables by name; ``Library.load`` reads those of a folder."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    item_index: fts.Index | None = None
    chunk_index: fts.Index | None = None

    @classmethod
    def load(cls, spark: SparkSession, folder: str, names: tuple[str, ...] = ("library_items", "authors", "item_authors", "chunks", "item_relations", "item_embeddings", "collection_rows")) -> Library:
        return cls(spark, {n: table(spark, folder, n) for n in names})

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if name in _OPTIONAL:
            return self.spark.createDataFrame([], _OPTIONAL[name])
        raise KeyError(name)

    def index(self, folder: str | None = None) -> Library:
        """Stored keyword indexes of items and passages, which searches then read in place of all texts."""
        columns = [c for c in R.SEARCHED if c in self.items.columns]
        where = lambda name: None if folder is None else f"{folder.rstrip('/')}/{name}"
        self.item_index = fts.Index.write(self.items.withColumnRenamed("id", "item_id"), "item_id", columns, where("items"))
        self.chunk_index = fts.Index.write(self["chunks"].select("chunk_id", "text").dropDuplicates(["chunk_id"]), "chunk_id", ["text"], where("chunks"))
        return self

    @property
    def items(self) -> DataFrame:
        return self["library_items"]

    def _authors(self, role: str | None = "author") -> DataFrame:
        return L.authors_of_items(self["item_authors"], self["authors"], role)

    # --- the ten tools ------------------------------------------------------------------------------------

    def _chunk_vectors(self) -> DataFrame | None:
        return self.tables.get("chunk_embeddings")

    def search(
        self, query: str, mode: str = "hybrid", item_types: list[str] | None = None, section: str | None = None, limit: int = 10, query_vector: list[float] | None = None, exact: bool = False,
        dim: int = 768, chunk_vector: list[float] | None = None, chunk_dim: int = 1024,
    ) -> DataFrame:
        """Ranked items with names, identifiers and best passage.

        A filter by type looks at twice the limit, as an answer of fixed cost; ``exact`` filters before ranking. The
        best passage is the nearest one to ``chunk_vector`` where the library has chunk vectors, else by keywords.
        """
        whole = self.items
        items = whole.where(F.col("item_type").isin(item_types)) if item_types and exact else whole
        vectors = self["item_embeddings"].join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi") if item_types and exact else self["item_embeddings"]
        found = R.hybrid(items, vectors, query, query_vector, 2 * limit if item_types and not exact else limit, mode, dim, self.item_index if items is whole else None)
        facts = self.items.select(F.col("id").alias("item_id"), "title", "item_type", "publication_year", "doi", "arxiv_id", "isbn")
        rows = found.join(facts, "item_id")
        if item_types:
            rows = rows.where(F.col("item_type").isin(item_types)).orderBy("rank").limit(limit)
        rows = rows.join(self._authors().withColumnRenamed("names", "authors"), "item_id", "left")
        return R.best_passages(rows, self["chunks"], query, section, limit, mode, self._chunk_vectors(), chunk_vector, chunk_dim, self.chunk_index).orderBy("rank")

    def get_item(self, item_id: int) -> DataFrame:
        """An item's columns with authors, tags and collections."""
        tags = self["item_tags"].join(self["tags"], "tag_id").groupBy("item_id").agg(F.array_sort(F.collect_set("name")).alias("tags"))
        groups = self["item_collections"].join(self["collection_rows"].select("collection_id", "name"), "collection_id").groupBy("item_id").agg(F.array_sort(F.collect_set("name")).alias("collections"))
        row = self.items.where(F.col("id") == item_id).withColumn("item_id", F.col("id"))
        return row.join(self._authors().withColumnRenamed("names", "authors"), "item_id", "left").join(tags, "item_id", "left").join(groups, "item_id", "left").drop("item_id")

    def get_full_text(self, item_id: int, pages: list[int] | None = None) -> DataFrame:
        """(text): the item's passages in order, of some pages or all."""
        rows = self["chunks"].where(F.col("item_id") == item_id).select("chunk_index", "page", "text").distinct()
        if pages is not None:
            rows = rows.where(F.col("page").isin(pages))
        return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n\n").alias("text"))

    def get_snippets(self, query: str, item_id: int | None = None, k: int = 10, chunk_vector: list[float] | None = None, chunk_dim: int = 1024) -> DataFrame:
        """The best passages, of one item or of all: the nearest ones where the library has chunk vectors, else by keywords."""
        scope = self.items.where(F.col("id") == item_id).select(F.col("id").alias("item_id")) if item_id is not None else None
        return R.passages(self["chunks"], query, k, None, scope, self._chunk_vectors(), chunk_vector, chunk_dim, self.chunk_index)

    def list_related(self, item_id: int, kind: str = "all") -> DataFrame:
        return G.neighbours(self["item_relations"].where(F.col("subject_id") == item_id), self.items, kind)

    def get_citation(self, item_id: int) -> DataFrame:
        """(entry): the item as BibTeX, with the family names of everybody who took part."""
        people = self["item_authors"].where(F.col("item_id") == item_id).select("author_id", "position").distinct().join(self["authors"], "author_id")
        listed = people.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "author_id", "family_name"))), lambda x: x["family_name"]).alias("authors"))
        names = ("item_type", "title", "venue", "volume", "issue", "pages", "doi", "isbn", "arxiv_id", "edition", "series", "language")
        columns = {k: F.col(k) for k in names if k in self.items.columns} | {"year": F.col("publication_year"), "authors": F.col("authors")}
        return self.items.where(F.col("id") == item_id).join(F.broadcast(listed)).select(X.bibtex(columns).alias("entry"))

    def get_collection(self, collection_id: int) -> DataFrame:
        return self["collection_rows"].where(F.col("collection_id") == collection_id).dropDuplicates(["collection_id"])

    def get_author(self, author_id: int) -> DataFrame:
        """An author's row with the number of its items."""
        n = self["item_authors"].where(F.col("author_id") == author_id).select("item_id").distinct().agg(F.count(F.lit(1)).alias("n_items"))
        return self["authors"].where(F.col("author_id") == author_id).join(F.broadcast(n))

    def get_feed_item(self, item_id: int) -> DataFrame:
        """An item's row of a listing, with its authors."""
        return self.items.where(F.col("id") == item_id).join(self._authors().select(F.col("item_id").alias("id"), F.col("names").alias("authors")), "id", "left")

    def list_tags(self) -> DataFrame:
        return L.counts_with_zero(self["tags"], "tag_id", self["item_tags"], "tag_id").select("name", "n").orderBy("name")

    def list_collections(self) -> DataFrame:
        """Every collection with depth, own and rolled-up numbers of items; cycles are left out."""
        rows = self["collection_rows"]
        tree = H.hierarchy(rows)
        members = self["item_collections"].groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
        counts = rows.dropDuplicates(["collection_id"]).select("collection_id", F.coalesce("item_count", F.lit(0)).alias("n")) if "item_collections" not in self.tables else members
        return L.roll_up(tree, H.descendants(tree), counts, "collection_id").join(rows.dropDuplicates(["collection_id"]).select("collection_id", "name"), "collection_id")

    def get_document_structure(self, item_id: int) -> DataFrame:
        """(level, heading, label, n_chars) of the item's stored TEI, in order."""
        parsed = self["item_tei"].where(F.col("item_id") == item_id).select(P.tei("tei").alias("t")).where(P.is_tei(F.col("t")))
        return parsed.select(F.posexplode("t.sections").alias("no", "s")).select("no", "s.level", "s.heading", X.section(F.col("s.heading")).alias("label"), F.length("s.text").alias("n_chars")).orderBy("no")

    def find_by_tag(self, tag: str, limit: int = 100) -> DataFrame:
        return L.page(L.filtered(self.items, L.Filters(items=self._tagged(tag))), L.order("added"), 0, limit)

    # --- listings -----------------------------------------------------------------------------------------

    def _tagged(self, tag: str) -> DataFrame:
        return self["item_tags"].join(self["tags"].where(F.col("name") == tag), "tag_id").select("item_id")

    def _members(self, collection_id: int) -> DataFrame:
        return self["item_collections"].where(F.col("collection_id") == collection_id).select("item_id")

    def listing(self, item_type: str | None = None, year: int | None = None, venue: str | None = None, author_id: int | None = None, tag: str | None = None, collection_id: int | None = None) -> DataFrame:
        """The items that satisfy all given filters."""
        rows = L.filtered(self.items, L.Filters(item_type, year, venue, author_id), self["item_authors"])
        if tag is not None:
            rows = L.filtered(rows, L.Filters(items=self._tagged(tag)))
        return rows if collection_id is None else L.filtered(rows, L.Filters(items=self._members(collection_id)))

    def browse(self, sort: str = "added", offset: int = 0, limit: int = L.PAGE, **filters) -> DataFrame:
        """A page of a listing with the authors of its items."""
        rows = self.listing(**filters)
        if sort == "author":
            rows = rows.join(L.first_author(self["item_authors"], self["authors"]), "id", "left")
        page = L.page(rows, L.order(sort), offset, limit)
        return page.join(self._authors().select(F.col("item_id").alias("id"), F.col("names").alias("authors")), "id", "left").orderBy(*L.order(sort))

    def feed(self, title: str, path: str, updated: str, sort: str = "added", offset: int = 0, limit: int = L.PAGE, **filters) -> str:
        """A page of a listing as an Atom feed."""
        page = self.browse(sort, offset, limit, **filters)
        placed = page.withColumn("__place", F.row_number().over(W.Window.orderBy(*L.order(sort)))).drop("authors")
        rows = placed.select("id", "__place").join(feeds.entries(placed, self._authors()), "id").orderBy("__place")
        return feeds.acquisition(rows, title, path, updated, self.count(**filters), offset, limit)

    def count(self, **filters) -> int:
        return self.listing(**filters).count()

    def facets(self) -> dict[str, DataFrame]:
        """Types, years, venues, authors and tags of the whole library, with their numbers of items."""
        return {
            "type": L.types(self.items), "year": L.years(self.items), "venue": L.venues(self.items, 50), "author": L.author_facet(self["item_authors"], self["authors"]), "tag": self.list_tags(),
        }

    def nearest_items(self, item_id: int, k: int = 10, dim: int = 768) -> DataFrame:
        """The items nearest to one item's vector, itself left out."""
        query = self["item_embeddings"].where(F.col("item_id") == item_id)
        return V.nearest(self["item_embeddings"], query, k + 1, dim).where(F.col("item_id") != item_id).select("item_id", "distance")
