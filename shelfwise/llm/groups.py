"""Pairwise matches to groups by Hash-to-Min.

Every vertex keeps a set of members. In each round it sends its set to the set's smallest member and that
smallest member to all others, until nothing changes (Rastogi et al., 2013). The sets are rows
(vertex, member), never arrays: the set of a hub with a third of all rows is spread over tasks, the minimum
is aggregated before the shuffle, and the join with the minima is one that AQE splits where a vertex is hot.

Defined results: null ids, null labels and pairs of an item with itself link nothing; repeats count once;
an empty table gives no groups; other columns are ignored, so that their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut, drop

#: Relations between versions of one work (fixed values).
VERSION_RELATIONS = (
    "preprint_of",
    "published_as",
    "later_edition_of",
    "earlier_edition_of",
    "translates",
    "translated_from",
)


def plain_label(label: Column) -> Column:
    """Lower case, one underscore for each run of separators, no padding."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), r"(?U)[\s_\-\u2010-\u2015]+", "_"), "^_|_$", "")


def version_pairs(relations: DataFrame) -> DataFrame:
    """(a, b): pairs of items that a row calls versions of one work, whatever confidence or spelling."""
    return relations.where(plain_label(F.col("relation")).isin(*VERSION_RELATIONS)).select(
        F.col("subject_id").cast("long").alias("a"), F.col("object_id").cast("long").alias("b")
    )


def hash_to_min(pairs: DataFrame) -> DataFrame:
    """(id, group_id) of every id in a pair (a, b) of two different ids; group_id is the group's smallest id."""
    spark = pairs.sparkSession
    links = pairs.where("a is not null and b is not null and a <> b").select("a", "b")
    sets = links.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")), F.struct(F.col("a").alias("v"), F.col("a").alias("u")), F.struct(F.col("b").alias("v"), F.col("b").alias("u")))).alias("p")).select("p.v", "p.u").distinct()
    before, path = None, ""
    while True:
        seen = Observation()
        now, now_path = cut(
            sets.observe(
                seen,
                F.count(F.lit(1)).alias("rows"),
                F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("total"),
                F.bit_xor(F.xxhash64("u", "v")).alias("mix"),
            ),
            "sets",
        )
        if path:
            drop(spark, path)
        path = now_path
        least = now.groupBy("v").agg(F.min("u").alias("m"))
        if seen.get == before:
            return least.select(F.col("v").alias("id"), F.col("m").alias("group_id"))
        before = seen.get
        sent = now.join(least, "v")
        sets = sent.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("p")).select("p.v", "p.u").distinct()


def version_groups(relations: DataFrame) -> DataFrame:
    """(item_id, group_id) of every item linked to another as a version of one work."""
    return hash_to_min(version_pairs(relations)).select(F.col("id").alias("item_id"), "group_id")
