"""Fusion of rankings, hybrid search, best passages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import cut
from . import fts, vector

RRF_K = 60


def ranked(hits: DataFrame, order: list[Column], list_no: int = 0) -> DataFrame:
    """(id, list_no, rank) of a short list in its order; rank from 1."""
    place = F.row_number().over(W.Window.orderBy(*order))
    return hits.withColumn("rank", place).withColumn("list_no", F.lit(list_no))


def _fused(lists: DataFrame, id_col: str, k: int) -> DataFrame:
    return lists.groupBy(id_col).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("__first"))


def fuse(lists: DataFrame, id_col: str, k: int = RRF_K) -> DataFrame:
    """(id_col, score) of rankings (id_col, list_no, rank): the sum of 1 / (k + rank); ties in order of first sight."""
    return _fused(lists, id_col, k).orderBy(F.desc("score"), "__first", id_col).drop("__first")


def pool_size(limit: int) -> int:
    return max(3 * limit, 60)


def first_per(hits: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return hits.withColumn("__place", F.row_number().over(W.Window.partitionBy(group).orderBy(*order))).where("__place = 1").drop("__place")


#: Columns of items that keyword search reads, where the table has them.
SEARCHED = ("title", "abstract", "notes")


def hybrid(
    items: DataFrame, embeddings: DataFrame, query: str, query_vector: list[float] | None, limit: int = 20, mode: str = "hybrid", dim: int = 768, index: fts.Index | None = None
) -> DataFrame:
    """(item_id, rank, score) of a search: keyword, semantic or both fused; score is 1 / rank.

    ``items`` has id, title, abstract and, if it may, notes; ``embeddings`` item_id and embedding. A stored ``index`` on
    item_id stands for the scan of all items' texts. A blank query finds nothing.
    """
    if mode not in ("keyword", "semantic", "hybrid"):
        raise ValueError(f"no such mode: {mode}")
    columns = [c for c in SEARCHED if c in items.columns]
    items = items.select(F.col("id").alias("item_id"), *columns)
    pool = limit if mode != "hybrid" else pool_size(limit)
    lists = []
    if mode != "semantic":
        hits = index.search(items.sparkSession, query, pool) if index else fts.search(items, query, "item_id", columns, pool)
        lists.append(ranked(hits, [F.col("score"), F.col("item_id")], 0).select("item_id", "list_no", "rank"))
    if mode != "keyword" and query_vector is not None and query.strip():
        near = vector.nearest(embeddings, [(0, query_vector)], pool, dim)
        lists.append(ranked(near, [F.col("distance"), F.col("item_id")], 1).select("item_id", "list_no", "rank"))
    if not lists:
        return items.select("item_id", F.lit(1).alias("rank"), F.lit(1.0).alias("score")).limit(0)
    top = _fused(reduce(DataFrame.unionByName, lists), "item_id", RRF_K).orderBy(F.desc("score"), "__first", "item_id").limit(limit)
    out = top.withColumn("rank", F.row_number().over(W.Window.orderBy(F.desc("score"), "__first", "item_id")))
    return out.select("item_id", "rank", (1.0 / F.col("rank")).alias("score"))


def _with_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` (chunk_id, ...) with what their chunks hold: the few hits meet the chunks, which are not shuffled."""
    facts = chunks.select("chunk_id", "item_id", "page", "chunk_index", "text")
    return facts.join(F.broadcast(hits), "chunk_id").dropDuplicates(["chunk_id"])


def keyword_passages(chunks: DataFrame, query: str, limit: int | None, section: str | None = None, items: DataFrame | None = None, index: fts.Index | None = None) -> DataFrame:
    """(chunk_id, item_id, score) of the best passages; section and items filter hits, not the statistics."""
    asked = chunks if section is None else chunks.where(F.col("section") == section)
    asked = asked if items is None else asked.join(items.select("item_id").distinct(), "item_id", "left_semi")
    if index:
        hits = index.search(chunks.sparkSession, query, limit, within=None if asked is chunks else asked)
        return hits
    where = None if section is None else F.col("section") == section
    if items is None:
        return fts.search(chunks, query, "chunk_id", ["text"], limit, where=where, repeats=True)
    hits = fts.search(chunks, query, "chunk_id", ["text"], None, where=where, repeats=True).join(asked.select("chunk_id").distinct(), "chunk_id", "left_semi").orderBy("score", "chunk_id")
    return hits.limit(limit) if limit is not None else hits


def vector_passages(
    chunks: DataFrame, vectors: DataFrame, query_vector: list[float], limit: int, section: str | None = None, items: DataFrame | None = None, dim: int = 1024, exact: bool = False
) -> DataFrame:
    """(chunk_id, score) of the passages nearest to a vector; score is minus the distance, best first.

    ``vectors`` is (chunk_id, embedding). A section is looked for among five times the limit, items among three times,
    as answers of fixed cost; ``exact`` filters before it ranks.
    """
    scope = chunks.select("chunk_id", "item_id", "section")
    scope = scope if section is None else scope.where(F.col("section") == section)
    scope = scope if items is None else scope.join(items.select("item_id").distinct(), "item_id", "left_semi")
    filtered = section is not None or items is not None
    if filtered and exact:
        vectors = vectors.join(scope.select("chunk_id").distinct(), "chunk_id", "left_semi")
    pool = limit * (1 if exact or not filtered else 5 if section is not None else 3)
    near = vector.nearest(vectors, [(0, query_vector)], pool, dim, "chunk_id")
    if filtered and not exact:
        near = scope.select("chunk_id").join(F.broadcast(near), "chunk_id").dropDuplicates(["chunk_id"])
    return near.select("chunk_id", (-F.col("distance")).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)


def passages(
    chunks: DataFrame, query: str, limit: int = 10, section: str | None = None, items: DataFrame | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None,
    dim: int = 1024, index: fts.Index | None = None,
) -> DataFrame:
    """(chunk_id, item_id, page, chunk_index, text, score): the best passages, of a section or of given items only.

    With chunk vectors the nearest ones; keyword passages where there are no vectors, or no nearest passage at all.
    """
    if vectors is not None and query_vector is not None:
        near, _ = cut(vector_passages(chunks, vectors, query_vector, limit, section, items, dim), "near")
        if not near.isEmpty():
            return _with_texts(near, chunks)
    return _with_texts(keyword_passages(chunks, query, limit, section, items, index), chunks)


def best_passages(
    results: DataFrame, chunks: DataFrame, query: str, section: str | None = None, n: int = 20, mode: str = "hybrid", vectors: DataFrame | None = None, query_vector: list[float] | None = None,
    dim: int = 1024, index: fts.Index | None = None,
) -> DataFrame:
    """``results`` (item_id, ...) with the best passage of each item among the first 5 n passages of the query.

    Semantic and hybrid searches with chunk vectors look at the nearest passages; a hybrid one that finds none
    falls back to keyword passages, a semantic one does not. All else looks at keyword passages.
    """
    pool, near = 5 * n, None
    if mode != "keyword" and vectors is not None and query_vector is not None:
        near, _ = cut(vector_passages(chunks, vectors, query_vector, pool, section, None, dim).withColumn("score", -F.col("score")), "near")
        near = None if mode == "hybrid" and near.isEmpty() else near
    hits = keyword_passages(chunks, query, pool, section, None, index) if near is None else near
    found = first_per(_with_texts(hits, chunks), "item_id", [F.col("score"), F.col("chunk_id")])
    keep = found.select("item_id", "chunk_id", "page", "chunk_index", F.col("text").alias("snippet"))
    return results.join(keep, "item_id", "left")


def evaluation(runs: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(mode, queries, recall, p50_ms, p95_ms) of runs (mode, query_id, item_id, rank, ms) against expected (query_id, item_id).

    Recall is the mean share of a query's expected items among its first k; a query without a run counts as 0.
    """
    wanted = expected.select("query_id", "item_id").distinct()
    size = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    # every mode was asked every query: a handful of modes
    modes = size.select("query_id", "wanted", F.explode(F.array(*[F.lit(r.mode) for r in runs.select("mode").distinct().collect()]) if not runs.isEmpty() else F.array().cast("array<string>")).alias("mode"))
    hits = runs.where(F.col("rank") <= k).join(wanted, ["query_id", "item_id"], "left_semi").groupBy("mode", "query_id").agg(F.countDistinct("item_id").alias("hits"))
    share = modes.join(hits, ["mode", "query_id"], "left").select("mode", (F.coalesce("hits", F.lit(0)) / F.col("wanted")).alias("recall"))
    took = runs.groupBy("mode", "query_id").agg(F.max("ms").alias("ms")).groupBy("mode").agg(F.percentile("ms", 0.5).alias("p50_ms"), F.percentile("ms", 0.95).alias("p95_ms"))
    return share.groupBy("mode").agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall")).join(took, "mode", "left")


def match_rates(got: DataFrame, want: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(field, compared, matched, rate): how often fields of one table equal those of another, where the latter has a value; case and outer blanks aside."""
    plain = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    rows = want.select(key, *[plain(f).alias(f"__w_{f}") for f in fields]).join(got.select(key, *[plain(f).alias(f"__g_{f}") for f in fields]), key, "left")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__w_{f}").alias("w"), F.col(f"__g_{f}").alias("g")) for f in fields]))
    rows = rows.select(each.alias("x")).select("x.*").where(F.col("w").isNotNull() & (F.col("w") != ""))
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("w").eqNullSafe(F.col("g"))).alias("matched")).withColumn("rate", F.col("matched") / F.col("compared"))
