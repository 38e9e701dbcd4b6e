"""A reference manager's catalog in SQLite, stored as entities, attributes and values: a data source and its import."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import display_name, isbn13, nonblank, plain_doi

#: Types of the catalog and of the library; others become ``other`` (fixed values).
TYPES = {
    "journalArticle": "paper", "conferencePaper": "paper", "preprint": "preprint", "book": "book", "bookSection": "chapter", "report": "report", "thesis": "thesis", "standard": "standard",
    "patent": "patent", "magazineArticle": "paper", "newspaperArticle": "paper", "manuscript": "other", "webpage": "other", "document": "other", "letter": "other", "presentation": "other",
    "computerProgram": "other",
}
#: Roles of the catalog that are kept (fixed values).
ROLES = {
    "author": "author", "bookAuthor": "author", "contributor": "author", "reviewedAuthor": "author", "inventor": "author", "programmer": "author", "originalCreator": "author", "creator": "author",
    "editor": "editor", "seriesEditor": "editor", "translator": "translator",
}
FIELDS = {
    "title": "title", "abstractNote": "abstract", "date": "date", "DOI": "doi", "ISBN": "isbn", "publicationTitle": "venue", "volume": "volume", "issue": "issue", "pages": "pages",
    "series": "series", "seriesNumber": "series_number", "edition": "edition", "language": "language", "bookTitle": "book_title", "proceedingsTitle": "proceedings_title", "publisher": "publisher",
}


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns, self.options = [f.name for f in schema.fields], options

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.options['path']}?mode=ro&immutable=1", uri=True)

    def partitions(self):
        with self._connect() as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM \"{self.options['table']}\"").fetchone()
        if low is None:
            return [_Rows(0, -1)]
        step = max(1, -(-(high - low + 1) // int(self.options.get("partitions", 8))))
        return [_Rows(k, min(k + step - 1, high)) for k in range(low, high + 1, step)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._connect() as db:
            yield from db.execute(f"SELECT {names} FROM \"{self.options['table']}\" WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", ...).option("table", ...)``: read only, in ranges of row ids.

    The file must lie where every executor can read it, as with any file source.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        import sqlite3

        with sqlite3.connect(f"file:{self.options['path']}?mode=ro&immutable=1", uri=True) as db:
            columns = db.execute(f"PRAGMA table_info(\"{self.options['table']}\")").fetchall()
        kinds = {"INTEGER": "long", "INT": "long", "REAL": "double", "BLOB": "binary"}
        return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, self.options)


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The catalog's tables by name."""
    spark.dataSource.register(SqliteSource)
    names = "itemTypes items deletedItems fields itemData itemDataValues creators creatorTypes itemCreators tags itemTags collections collectionItems itemAttachments".split()
    return {n: spark.read.format("sqlite").option("path", path).option("table", n).load() for n in names}


def top_items(t: dict[str, DataFrame]) -> DataFrame:
    """(itemID, key, item_type) of items that are no attachments, notes or annotations, and not deleted."""
    kinds = t["itemTypes"].where(~F.col("typeName").isin("attachment", "note", "annotation"))
    table = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    rows = t["items"].join(kinds, "itemTypeID").join(t["deletedItems"], "itemID", "left_anti")
    return rows.select("itemID", "key", F.coalesce(table[F.col("typeName")], F.lit("other")).alias("item_type"))


def field_values(t: dict[str, DataFrame]) -> DataFrame:
    """One row per item with the fields of FIELDS as columns."""
    rows = t["itemData"].join(t["fields"], "fieldID").join(t["itemDataValues"], "valueID").where(F.col("fieldName").isin(*FIELDS))
    wide = rows.groupBy("itemID").pivot("fieldName", list(FIELDS)).agg(F.first("value"))
    return wide.select("itemID", *[F.col(a).alias(b) for a, b in FIELDS.items()])


def creators(t: dict[str, DataFrame]) -> DataFrame:
    """(itemID, authors array<struct<position, role, family, given>>); institutions stand in the first name; unknown roles are dropped."""
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    rows = t["itemCreators"].join(t["creators"], "creatorID").join(t["creatorTypes"], "creatorTypeID").withColumn("role", table[F.col("creatorType")]).where("role is not null")
    family = F.coalesce(nonblank(F.col("lastName")), nonblank(F.col("firstName")))
    given = F.when(nonblank(F.col("lastName")).isNotNull(), nonblank(F.col("firstName")))
    rows = rows.withColumns({"family": family, "given": given}).where("family is not null")
    place = F.row_number().over(W.Window.partitionBy("itemID").orderBy("orderIndex", "creatorID")) - 1
    rows = rows.withColumn("position", place)
    return rows.groupBy("itemID").agg(F.array_sort(F.collect_list(F.struct("position", "role", "family", "given"))).alias("authors"))


def labels(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(itemID, tag) and (itemID, collectionID): trimmed, blanks dropped, each once."""
    tags = t["itemTags"].join(t["tags"], "tagID").select("itemID", F.trim("name").alias("tag")).where("tag <> ''").distinct()
    return tags, t["collectionItems"].select("itemID", "collectionID").distinct()


def collections(t: dict[str, DataFrame]) -> DataFrame:
    """(collection_id, name, parent_id) under the catalog's own ids, so that nested ones keep their place."""
    return t["collections"].select(F.col("collectionID").alias("collection_id"), F.col("collectionName").alias("name"), F.col("parentCollectionID").alias("parent_id"))


def attachments(t: dict[str, DataFrame], storage: str, available: DataFrame | None = None) -> DataFrame:
    """(itemID, path) of each item's first PDF: ``storage:`` paths lie in the storage folder under the attachment's key.

    ``attachments:`` links are left out; where ``available`` (path) is given, so are files it lacks.
    """
    rows = t["itemAttachments"].where("contentType = 'application/pdf' and path is not null and path not like 'attachments:%'").join(t["items"].select("itemID", "key"), "itemID")
    stored = F.concat_ws("/", F.lit(storage.rstrip("/")), F.col("key"), F.regexp_replace("path", "^storage:", ""))
    rows = rows.select(F.col("itemID").alias("attachment"), F.col("parentItemID").alias("itemID"), F.when(F.col("path").startswith("storage:"), stored).otherwise(F.col("path")).alias("path")).where("itemID is not null")
    if available is not None:
        rows = rows.join(available.select("path").distinct(), "path", "left_semi")
    return rows.groupBy("itemID").agg(F.min_by("path", "attachment").alias("path"))


def records(t: dict[str, DataFrame]) -> DataFrame:
    """The catalog's items as library metadata; items without a title are left out. DOI and ISBN are normalised."""
    rows = top_items(t).join(field_values(t), "itemID").where(nonblank(F.col("title")).isNotNull()).join(creators(t), "itemID", "left")
    year = F.coalesce(F.nullif(F.regexp_extract("date", r"^(\d{4})", 1), F.lit("")), F.nullif(F.regexp_extract("date", r"\b(1\d{3}|20\d{2}|2100)\b", 1), F.lit(""))).try_cast("int")
    venue = F.coalesce(*[nonblank(F.col(c)) for c in ("venue", "proceedings_title", "book_title")])
    return rows.select(
        F.col("itemID").alias("source_id"), "key", "item_type", F.trim("title").alias("title"), "abstract", year.alias("publication_year"), plain_doi(F.col("doi")).alias("doi"),
        F.coalesce(isbn13(F.col("isbn")), F.col("isbn")).alias("isbn"), venue.alias("venue"), "volume", "issue", "pages", "series", "series_number", "edition", "language", "authors",
        F.to_json(F.struct(F.col("itemID").alias("source_item_id"), "key")).alias("metadata_json"), F.lit("zotero_import").alias("metadata_source"), F.lit(0.9).alias("metadata_confidence"),
    )


def pending(records_: DataFrame, items: DataFrame) -> DataFrame:
    """Records whose id no item's metadata_json holds yet: a second import brings nothing."""
    done = items.select(F.get_json_object("metadata_json", "$.source_item_id").cast("long").alias("source_id")).where("source_id is not null")
    return records_.join(done, "source_id", "left_anti")


def report(catalog: DataFrame, fresh: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: candidates, skipped, inserted, merged, linked. ``decisions`` has id (source_id) and outcome."""
    outcome = decisions.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("insert", "inserted"), ("merge", "merged"), ("link", "linked"))])
    sizes = catalog.agg(F.count(F.lit(1)).alias("candidates")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("pending")))
    return sizes.crossJoin(outcome).select("candidates", (F.col("candidates") - F.col("pending")).alias("skipped"), "inserted", "merged", "linked")


def names(authors: str = "authors") -> F.Column:
    """Display names of a record's authors."""
    return F.transform(authors, lambda a: display_name(a["family"], a["given"]))

