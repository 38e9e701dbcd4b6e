"""Duplicate detection in tiers, as one batch scan of candidates against the library.

Tier 1 equal identifiers merge; tier 2 errata link to the work they name; tier 3 preprints link to the DOI they name;
tier 4 near vectors merge or link, judged by editions, similarity and shared authors. Each tier gives rows
(id, tier, outcome, target_id, relation, confidence, reason); ``decide`` keeps the lowest tier of each candidate.
A candidate is never its own target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import edition_number, erratum_target, nonblank
from ..session import cut

#: Identifiers in the order they are tried, with the reason each gives (fixed values).
KEYS = (("content_hash", "hash_match"), ("doi", "doi_match"), ("arxiv_id", "arxiv_id_match"), ("isbn", "isbn_match"))
#: Similarities of tier 4, and neighbours that are looked at (fixed values).
MERGE, JUDGE, RELATED, EDITION, NEIGHBOURS = 0.97, 0.90, 0.95, 0.85, 10
COLUMNS = ("id", "tier", "outcome", "target_id", "relation", "confidence", "reason")


def _decision(rows: DataFrame, tier: int, outcome: Column, relation: Column, confidence: Column, reason: Column) -> DataFrame:
    return rows.select(
        "id", F.lit(tier).alias("tier"), outcome.alias("outcome"), "target_id", relation.cast("string").alias("relation"), confidence.cast("double").alias("confidence"), reason.alias("reason")
    )


def exact(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Tier 1: the first identifier that another item has; among several such items the smallest.

    Of each key only its two smallest ids are kept before the join, so that a key held by a third of all items
    is as cheap as any other.
    """
    found = []
    for place, (key, reason) in enumerate(KEYS):
        order = F.row_number().over(W.Window.partitionBy(key).orderBy("id"))
        two = items.where(nonblank(F.col(key)).isNotNull()).select("id", key).withColumn("n", order).where("n <= 2")
        least = two.groupBy(key).agg(F.min("id").alias("one"), F.max(F.when(F.col("n") == 2, F.col("id"))).alias("two"))
        hit = candidates.select("id", key).join(least, key).withColumn("target_id", F.when(F.col("one").eqNullSafe(F.col("id")), F.col("two")).otherwise(F.col("one")))
        found.append(hit.where("target_id is not null").select("id", F.struct(F.lit(place).alias("place"), "target_id", F.lit(reason).alias("reason")).alias("x")))
    first = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.min("x").alias("x")).select("id", "x.target_id", "x.reason")
    return _decision(first, 1, F.lit("merge"), F.lit(None), F.lit(1.0), F.col("reason"))


#: Characters of the pieces that short named titles are looked for by.
PIECE = 8


def _rarest(named: DataFrame, keys: Column, titles: DataFrame, of_title: Column) -> DataFrame:
    """(id, target_id) of titles that hold the named ones: joined on that of their keys which fewest titles have.

    Titles meet the keys of named ones only. A key that no title has leaves nothing to find.
    """
    asked, _ = cut(named.select("id", "named", F.explode(F.array_distinct(keys)).alias("key")), "asked")
    held, _ = cut(titles.select("target_id", F.explode(F.array_distinct(of_title)).alias("key")).join(asked.select("key").distinct(), "key"), "held")
    df = held.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    rarest = asked.join(df, "key", "left").groupBy("id", "named").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key")).alias("k")).select("id", "named", F.col("k.key").alias("key"))
    pairs = rarest.join(held, "key").where(~F.col("id").eqNullSafe(F.col("target_id")))
    return pairs.join(titles, "target_id").where(F.contains(F.col("other"), F.col("named"))).select("id", "target_id")


def errata(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Tier 2: titles of errata link to the item whose title holds the title they name, case aside.

    Named titles of three words and more are joined on the rarest of their inner words, which the other title must
    hold as a word; shorter ones on the rarest of their pieces of ``PIECE`` characters.
    """
    named = candidates.select("id", F.lower(erratum_target(F.col("title"))).alias("named")).where("named is not null")
    words = F.split("named", " ")
    inner = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    named, _ = cut(named.withColumn("inner", inner), "named")
    titles = items.where("title is not null").select(F.col("id").alias("target_id"), F.lower("title").alias("other"))
    pieces = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - PIECE + 1), lambda k: F.substring(c, k, F.lit(PIECE)))
    hits = _rarest(named.where("size(inner) > 0"), F.col("inner"), titles, F.split("other", " "))
    short = named.where("size(inner) = 0")
    if not short.isEmpty():
        hits = hits.unionByName(_rarest(short, pieces(F.col("named")), titles.where(F.length("other") >= PIECE), pieces(F.col("other"))))
    hits = hits.groupBy("id").agg(F.min("target_id").alias("target_id"))
    return _decision(hits, 2, F.lit("link"), F.lit("erratum_for"), F.lit(0.9), F.lit("erratum_title"))


def linked(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Tier 3: a preprint that names a DOI of the library links to it."""
    own = candidates.where(nonblank(F.col("arxiv_id")).isNotNull() & nonblank(F.col("linked_doi")).isNotNull()).select("id", F.col("linked_doi").alias("doi"))
    hits = own.join(items.where("doi is not null").groupBy("doi").agg(F.min("id").alias("target_id")), "doi").where(~F.col("id").eqNullSafe(F.col("target_id")))
    return _decision(hits, 3, F.lit("link"), F.lit("preprint_of"), F.lit(1.0), F.lit("arxiv_published_doi"))


def plain_edition(edition: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(edition, r"\s+", " ")))


def edition_relation(own: Column, other: Column, own_year: Column, other_year: Column) -> Column:
    """later_edition_of or earlier_edition_of for different editions, null for equal ones or none at all.

    Direction is by number, else by year, else later.
    """
    a, b, x, y = edition_number(own), edition_number(other), plain_edition(F.coalesce(own, F.lit(""))), plain_edition(F.coalesce(other, F.lit("")))
    none = (x == "") & (y == "")
    same = (x == y) | F.coalesce(a == b, F.lit(False))
    earlier = F.when(a.isNotNull() & b.isNotNull(), a < b).when(own_year.isNotNull() & other_year.isNotNull(), own_year < other_year).otherwise(False)
    return F.when(~none & ~same, F.when(earlier, "earlier_edition_of").otherwise("later_edition_of"))


def author_keys(item_authors: DataFrame, authors: DataFrame) -> DataFrame:
    """(item_id, key) of authors of every role, each once."""
    return item_authors.join(authors.select("author_id", F.col("normalized_key").alias("key")), "author_id").select("item_id", "key").distinct()


def semantic(neighbours: DataFrame, items: DataFrame, keys: DataFrame, apart: DataFrame | None = None, judged: DataFrame | None = None) -> DataFrame:
    """Tier 4, from neighbours (id, target_id, rank, similarity) of the candidates.

    ``items`` has id, edition and publication_year; ``keys`` (item_id, key) of authors; ``apart`` pairs (a_id, b_id)
    known to differ; ``judged`` verdicts (id, target_id, verdict) for the band below merging, none by default.
    """
    rows = neighbours.where(~F.col("id").eqNullSafe(F.col("target_id")))
    if apart is not None:
        known = apart.select(F.least("a_id", "b_id").alias("__a"), F.greatest("a_id", "b_id").alias("__b"))
        rows = rows.join(known, (F.least("id", "target_id") == F.col("__a")) & (F.greatest("id", "target_id") == F.col("__b")), "left_anti")
    shared = (
        rows.select("id", "target_id")
        .join(keys.select(F.col("item_id").alias("id"), "key"), "id")
        .join(keys.select(F.col("item_id").alias("target_id"), "key"), ["target_id", "key"])
        .groupBy("id", "target_id")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    facts = items.select("id", "edition", "publication_year")
    rows = rows.join(shared, ["id", "target_id"], "left").join(facts, "id").join(facts.select(F.col("id").alias("target_id"), F.col("edition").alias("__e"), F.col("publication_year").alias("__y")), "target_id")
    rows = rows.join(judged, ["id", "target_id"], "left") if judged is not None else rows.withColumn("verdict", F.lit(None).cast("string"))
    sim, overlap = F.col("similarity"), F.coalesce("shared", F.lit(0)) >= 1
    edition = F.when((sim >= EDITION) & overlap, edition_relation(F.col("edition"), F.col("__e"), F.col("publication_year"), F.col("__y")))
    band = (sim >= JUDGE) & (sim < MERGE) & overlap
    choice = (
        F.when(edition.isNotNull(), F.struct(F.lit("link").alias("outcome"), edition.alias("relation"), F.lit("edition").alias("reason")))
        .when((sim >= MERGE) & overlap, F.struct(F.lit("merge").alias("outcome"), F.lit(None).cast("string").alias("relation"), F.lit("semantic_match").alias("reason")))
        .when(band & (F.col("verdict") == "same"), F.struct(F.lit("merge").alias("outcome"), F.lit(None).cast("string").alias("relation"), F.lit("llm_judge_same").alias("reason")))
        .when(band & (F.col("verdict") == "related"), F.struct(F.lit("link").alias("outcome"), F.lit("related").alias("relation"), F.lit("llm_judge_related").alias("reason")))
        .when((sim >= RELATED) & ~overlap, F.struct(F.lit("link").alias("outcome"), F.lit("related").alias("relation"), F.lit("semantic_related").alias("reason")))
    )
    rows = rows.withColumn("x", choice).where("x is not null")
    first = rows.withColumn("n", F.row_number().over(W.Window.partitionBy("id").orderBy("rank"))).where("n = 1")
    return _decision(first, 4, F.col("x")["outcome"], F.col("x")["relation"], F.col("similarity"), F.col("x")["reason"])


def decide(candidates: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """One decision for each candidate: the lowest tier's, else insert."""
    rows = reduce(DataFrame.unionByName, [t.select(*COLUMNS) for t in tiers])
    first = rows.withColumn("n", F.row_number().over(W.Window.partitionBy("id").orderBy("tier", "target_id"))).where("n = 1").drop("n")
    out = candidates.select("id").distinct().join(first, "id", "left")
    return out.withColumns({"outcome": F.coalesce("outcome", F.lit("insert")), "reason": F.coalesce("reason", F.lit("no_match"))}).select(*COLUMNS)


def counts(decisions: DataFrame) -> DataFrame:
    """Numbers of decisions by outcome and reason."""
    return decisions.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))
