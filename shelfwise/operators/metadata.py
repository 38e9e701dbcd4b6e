"""Metadata: candidates ranked by authority and merged in layers; backfilling of stored items; upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import nonblank

#: Authority of sources, higher first; unknown sources rank below all (fixed values).
AUTHORITY = {"crossref": 5, "arxiv": 4, "grobid": 3, "openlibrary": 2, "llm": 1, "zotero_import": 0, "manual": 0, "manual_required": -1}
UNKNOWN = -2


def authority(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in AUTHORITY.items() for x in pair])
    return F.coalesce(table[source], F.lit(UNKNOWN))


def filled(field: Column, kind: str) -> Column:
    """The value where it is neither null nor an empty text."""
    return F.nullif(field, F.lit("")) if kind == "string" else field


def best(candidates: DataFrame, key: str = "item_id") -> DataFrame:
    """The candidate of highest (authority, confidence) of each key; ties to the smaller candidate_id."""
    place = F.row_number().over(W.Window.partitionBy(key).orderBy(F.desc("__rank"), F.desc_nulls_last("confidence"), "candidate_id"))
    return candidates.dropDuplicates(["candidate_id"]).withColumn("__rank", authority(F.col("source"))).withColumn("__place", place).where("__place = 1").drop("__place", "__rank")


def layered(candidates: DataFrame, fields: list[str], key: str = "item_id") -> DataFrame:
    """One record per key: each field from the highest (authority, confidence) that fills it, with the best source.

    Minima of structs are formed before the shuffle; no group is gathered.
    """
    kinds = dict(candidates.dtypes)
    order = lambda: F.struct(-authority(F.col("source")), F.coalesce(-F.col("confidence"), F.lit(float("inf"))), F.col("candidate_id"))
    wins = [F.min(F.when(filled(F.col(f), kinds[f]).isNotNull(), F.struct(order().alias("o"), F.col(f).alias("v"))))["v"].alias(f) for f in fields]
    source = F.min(F.struct(order().alias("o"), F.col("source").alias("v")))["v"].alias("source")
    return candidates.where(F.col(key).isNotNull()).groupBy(key).agg(source, *wins)


def backfilled(items: DataFrame, incoming: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Stored items whose null or empty fields are filled from one incoming record each; filled fields never change."""
    kinds = dict(items.dtypes)
    new = incoming.select(F.col(key), *[F.col(f).alias(f"__{f}") for f in fields])
    out = items.join(new, key, "left")
    return out.withColumns({f: F.coalesce(filled(F.col(f), kinds[f]), filled(F.col(f"__{f}"), kinds[f])) for f in fields}).select(*items.columns)


def latest(rows: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """Insert or replace: the newest row of each key."""
    place = F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.desc_nulls_last(when), F.desc(tie)))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def merged_json(old: Column, new: Column) -> Column:
    """Two JSON objects of texts joined; the new one's keys win."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(read(old), lambda k, v: ~F.array_contains(F.map_keys(read(new)), k))
    return F.to_json(F.map_concat(kept, read(new)))


def union_authors(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(item_id, author_id, position, role): authors not yet linked follow the last position of their item."""
    fresh = incoming.select("item_id", "author_id", F.col("position").alias("__order")).dropDuplicates(["item_id", "author_id"])
    fresh = fresh.join(existing.select("item_id", "author_id"), ["item_id", "author_id"], "left_anti")
    last = existing.groupBy("item_id").agg(F.max("position").alias("__last"))
    place = F.row_number().over(W.Window.partitionBy("item_id").orderBy("__order", "author_id"))
    added = fresh.join(last, "item_id", "left").select("item_id", "author_id", (F.coalesce("__last", F.lit(-1)) + place).cast("int").alias("position"), F.lit("author").alias("role"))
    return existing.select("item_id", "author_id", "position", "role").unionByName(added)
