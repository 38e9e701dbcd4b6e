"""Keyword search: BM25 with phrases, over texts or over a stored inverted index.

Scores are those of SQLite's full-text index: a query's words are quoted phrases, all of which must occur (each
within one column); score = -sum idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * |D| / avgdl)), k1 = 1.2, b = 0.75,
idf = ln((N - n + .5) / (n + .5)), at least 1e-6. Smaller is better; ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_phrases, tokens
from ..session import cut, new_path, spread

K1, B, FLOOR = 1.2, 0.75, 1e-6


def _count(words: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs in an array of words."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0]))
    last = F.size(words) - len(phrase) + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    fits = lambda k: reduce(lambda a, b: a & b, [F.get(words, k - 1 + i) == w for i, w in enumerate(phrase)])
    return F.size(F.filter(starts, fits))


def _score(frequencies: list[Column], found: list[Column], size: Column, n_docs: Column, total: Column) -> Column:
    weight = K1 * (1 - B + B * size / (total / n_docs))
    parts = [F.greatest(F.log((n_docs - n + 0.5) / (n + 0.5)), F.lit(FLOOR)) * tf * (K1 + 1) / (tf + weight) for tf, n in zip(frequencies, found)]
    return -reduce(lambda a, b: a + b, parts)


def search(
    docs: DataFrame, query: str, id_col: str, columns: list[str], limit: int | None = 20, unicode: bool = False, where: Column | None = None, repeats: bool = False
) -> DataFrame:
    """(id_col, score) of the documents that hold all phrases of ``query``, best first.

    One scan counts words and phrases of each document and keeps the counts alone, from which one aggregate gives the
    corpus statistics; texts are never shuffled. Of ``repeats`` of rows the counts are made unique by id. ``where``
    filters hits, not the statistics. A query without words finds nothing. For many queries store an ``Index``.
    """
    phrases = query_phrases(query, unicode)
    if not phrases:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    words = [tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    open_ = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    docs = spread(docs.where(F.col(id_col).isNotNull()).select(id_col, *columns, open_.alias("__open")))
    counted = docs.select(
        id_col,
        reduce(lambda a, b: a + b, [F.size(w) for w in words]).alias("__size"),
        *[reduce(lambda a, b: a + b, [_count(w, p) for w in words]).alias(f"__tf{k}") for k, p in enumerate(phrases)],
        "__open",
    )
    counted, _ = cut(counted.dropDuplicates([id_col]) if repeats else counted, "counted")
    stats = counted.agg(
        F.count(F.lit(1)).alias("__docs"), F.sum("__size").alias("__total"), *[F.count_if(F.col(f"__tf{k}") > 0).alias(f"__n{k}") for k in range(len(phrases))]
    )
    every = reduce(lambda a, b: a & b, [F.col(f"__tf{k}") > 0 for k in range(len(phrases))])
    score = _score([F.col(f"__tf{k}") for k in range(len(phrases))], [F.col(f"__n{k}") for k in range(len(phrases))], F.col("__size"), F.col("__docs"), F.col("__total"))
    # the statistics are one row
    hits = counted.where(every & F.col("__open")).join(F.broadcast(stats)).select(id_col, score.alias("score"))
    ranked = hits.orderBy("score", id_col)
    return ranked.limit(limit) if limit is not None else ranked


def build_index(docs: DataFrame, id_col: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """An inverted index: postings (term, id_col, column, positions) and documents (id_col, size).

    Write the postings partitioned or bucketed by term; a search then reads its own terms only.
    """
    arrays = F.array(*[F.struct(F.lit(k).alias("column"), tokens(F.coalesce(F.col(c), F.lit(""))).alias("words")) for k, c in enumerate(columns)])
    parts = docs.where(F.col(id_col).isNotNull()).select(id_col, F.explode(arrays).alias("x")).select(id_col, "x.column", "x.words")
    places = parts.select(id_col, "column", F.posexplode("words").alias("pos", "term"))
    postings = places.groupBy("term", id_col, "column").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    sizes = parts.groupBy(id_col).agg(F.sum(F.size("words")).alias("size"))
    return postings, sizes


def _shifted(by: int) -> Column:
    """Positions at which a phrase begins whose word ``by`` stands at them."""
    return F.transform("positions", lambda p: p - by)


def search_index(postings: DataFrame, sizes: DataFrame, query: str, id_col: str, limit: int | None = 20, unicode: bool = False) -> DataFrame:
    """Like ``search``, from a stored index: only the postings of the query's words are read."""
    phrases = query_phrases(query, unicode)
    if not phrases:
        return sizes.select(id_col, F.lit(0.0).alias("score")).limit(0)
    per_phrase = None
    for k, phrase in enumerate(phrases):
        where = None
        for i, word in enumerate(phrase):
            own = postings.where(F.col("term") == word).select(id_col, "column", _shifted(i).alias(f"p{i}"))
            where = own if where is None else where.join(own, [id_col, "column"])
        both = reduce(F.array_intersect, [F.col(f"p{i}") for i in range(len(phrase))])
        found = where.groupBy(id_col).agg(F.sum(F.size(both)).alias(f"__tf{k}")).where(F.col(f"__tf{k}") > 0)
        found = found.join(F.broadcast(found.agg(F.count(F.lit(1)).alias(f"__n{k}"))))
        per_phrase = found if per_phrase is None else per_phrase.join(found, id_col)
    stats = sizes.agg(F.count(F.lit(1)).alias("__docs"), F.sum("size").alias("__total"))
    score = _score([F.col(f"__tf{k}") for k in range(len(phrases))], [F.col(f"__n{k}") for k in range(len(phrases))], F.col("size"), F.col("__docs"), F.col("__total"))
    hits = per_phrase.join(sizes, id_col).join(F.broadcast(stats)).select(id_col, score.alias("score")).orderBy("score", id_col)
    return hits.limit(limit) if limit is not None else hits


#: Folders of postings in a stored index: a search reads those of its words.
BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    """A stored inverted index: postings in folders by term, sizes by document."""

    path: str
    id_col: str

    @classmethod
    def write(cls, docs: DataFrame, id_col: str, columns: list[str], path: str | None = None) -> Index:
        """Tokenise once and store; ``path`` is in the shared folder where it is not given."""
        path = path or new_path(docs.sparkSession, "index")
        postings, sizes = build_index(docs, id_col, columns)
        rows = postings.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64(id_col), F.lit(8))).sortWithinPartitions("bucket", "term")
        rows.write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
        sizes.write.mode("overwrite").parquet(f"{path}/sizes")
        return cls(path, id_col)

    def search(self, spark: SparkSession, query: str, limit: int | None = 20, unicode: bool = False, within: DataFrame | None = None) -> DataFrame:
        """Like ``search``; only the folders of the query's words are read. ``within`` (id_col) filters hits, not the statistics."""
        words = sorted({w for phrase in query_phrases(query, unicode) for w in phrase})
        numbers = [r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select(_bucket(F.col("w")).alias("b")).distinct().collect()] if words else [-1]
        postings = spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(numbers) & F.col("term").isin(words)).drop("bucket")
        hits = search_index(postings, spark.read.parquet(f"{self.path}/sizes"), query, self.id_col, None if within is not None else limit, unicode)
        if within is None:
            return hits
        hits = hits.join(within.select(self.id_col).distinct(), self.id_col, "left_semi").orderBy("score", self.id_col)
        return hits.limit(limit) if limit is not None else hits
