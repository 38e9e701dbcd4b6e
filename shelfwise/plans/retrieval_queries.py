"""Search queries over the library's tables, with SQL for the checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as X
from ..functions.text import query_phrases
from ..operators import fts, retrieval, vector
from ..session import table

DIM, LETTERS = 768, "abcdefghijklmnopqrstuvwxyz"
QUERY, PHRASE, CHUNK_QUERY, SECTION = "handbook studies", "narrow-band lens", "reported samples", "methods"


def _query_vector(spark, sf_dir):
    """The usable embedding of the smallest item: a stated query vector."""
    rows = table(spark, sf_dir, "item_embeddings").where(F.size("embedding") == DIM)
    usable = rows.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    first = usable.orderBy("item_id").select("item_id", "embedding").first()
    return first.embedding if first else [0.0] * DIM


def fts_items_bm25(spark, sf_dir):
    """Keyword search over titles and abstracts."""
    out = fts.search(table(spark, sf_dir, "library_items"), QUERY, "id", ["title", "abstract"], 20)
    return out.select("id", F.round("score", 6).alias("score"))


def fts_and_phrase(spark, sf_dir):
    """A hyphenated word is a phrase; all phrases must occur."""
    out = fts.search(table(spark, sf_dir, "library_items"), PHRASE, "id", ["title", "abstract"], 20)
    return out.select("id", F.round("score", 6).alias("score"))


def fts_index_search(spark, sf_dir):
    """The same search from an inverted index."""
    postings, sizes = fts.build_index(table(spark, sf_dir, "library_items"), "id", ["title", "abstract"])
    return fts.search_index(postings, sizes, QUERY, "id", 20).select("id", F.round("score", 6).alias("score"))


def fts_chunks(spark, sf_dir):
    """Keyword search over passages."""
    out = fts.search(table(spark, sf_dir, "chunks"), CHUNK_QUERY, "chunk_id", ["text"], 20, repeats=True)
    return out.select("chunk_id", F.round("score", 6).alias("score"))


def fts_by_section(spark, sf_dir):
    """Passages of one section only; statistics are those of all passages."""
    out = fts.search(table(spark, sf_dir, "chunks"), CHUNK_QUERY, "chunk_id", ["text"], 20, where=F.col("section") == SECTION, repeats=True)
    return out.select("chunk_id", F.round("score", 6).alias("score"))


def fts_document_search(spark, sf_dir):
    """Keyword search over documents."""
    out = fts.search(table(spark, sf_dir, "documents"), "reading room", "doc_id", ["text"], 20)
    return out.select("doc_id", F.round("score", 6).alias("score"))


def knn_items(spark, sf_dir):
    """The ten items nearest to a query vector; score is minus the distance."""
    out = vector.nearest(table(spark, sf_dir, "item_embeddings"), [(0, _query_vector(spark, sf_dir))], 10, DIM)
    return out.select("item_id", F.round(-F.col("distance"), 6).alias("score"))


def knn_postfilter(spark, sf_dir):
    """Five times the wanted neighbours, then only papers, then ten: a filter above the limit."""
    near = vector.nearest(table(spark, sf_dir, "item_embeddings"), [(0, _query_vector(spark, sf_dir))], 50, DIM)
    papers = table(spark, sf_dir, "library_items").where("item_type = 'paper'").select(F.col("id").alias("item_id"))
    return near.join(papers, "item_id", "left_semi").orderBy("distance", "item_id").limit(10).select("item_id", F.round("distance", 6).alias("distance"))


def knn_query_set(spark, sf_dir):
    """The ten nearest rows of every item whose id is divisible by 100, against all rows."""
    rows = table(spark, sf_dir, "item_embeddings")
    return vector.nearest(rows, rows.where("item_id % 100 = 0"), 10, DIM).select("query_id", "item_id", F.round("distance", 6).alias("distance"))


def _lists(spark, sf_dir, n=60):
    items = table(spark, sf_dir, "library_items")
    words = retrieval.ranked(fts.search(items, QUERY, "id", ["title", "abstract"], n), [F.col("score"), F.col("id")], 0).select(F.col("id").alias("item_id"), "list_no", "rank")
    near = vector.nearest(table(spark, sf_dir, "item_embeddings"), [(0, _query_vector(spark, sf_dir))], n, DIM)
    return words.unionByName(retrieval.ranked(near, [F.col("distance"), F.col("item_id")], 1).select("item_id", "list_no", "rank"))


def rrf_fusion(spark, sf_dir):
    """Keyword and semantic rankings fused by reciprocal ranks."""
    return retrieval.fuse(_lists(spark, sf_dir), "item_id").select("item_id", F.round("score", 8).alias("score"))


def hybrid_search(spark, sf_dir):
    """Hybrid search with titles and years."""
    items = table(spark, sf_dir, "library_items")
    found = retrieval.hybrid(items, table(spark, sf_dir, "item_embeddings"), QUERY, _query_vector(spark, sf_dir), 20)
    named = items.select(F.col("id").alias("item_id"), "title", "publication_year")
    return found.join(named, "item_id").select("item_id", "rank", F.round("score", 6).alias("score"), "title", "publication_year")


def best_snippet_per_item(spark, sf_dir):
    """Every item's best passage for a query."""
    # ranked by ids; texts are measured where they stand
    hits = fts.search(table(spark, sf_dir, "chunks"), CHUNK_QUERY, "chunk_id", ["text"], None, repeats=True)
    facts = table(spark, sf_dir, "chunks").select("chunk_id", "item_id", "page", F.length("text").alias("n_chars")).distinct()
    best = retrieval.first_per(hits.join(facts, "chunk_id"), "item_id", [F.col("score"), F.col("chunk_id")])
    return best.select("item_id", "chunk_id", "page", F.round("score", 6).alias("score"), "n_chars")


def get_snippets_scoped(spark, sf_dir):
    """Passages of the items of one type."""
    scope = table(spark, sf_dir, "library_items").where("item_type = 'book'").select(F.col("id").alias("item_id"))
    out = retrieval.passages(table(spark, sf_dir, "chunks"), "samples", 10, items=scope)
    return out.select("chunk_id", "item_id", "chunk_index", F.round("score", 6).alias("score"))


def eval_recall_at_10(spark, sf_dir):
    """Share of each query's ten nearest that are of the query's own venue."""
    near = knn_query_set(spark, sf_dir).where("query_id <> item_id")
    items = table(spark, sf_dir, "library_items").select("id", F.lower(F.trim("venue")).alias("venue")).where("venue is not null")
    own = items.select(F.col("id").alias("query_id"), F.col("venue").alias("own"))
    joined = near.join(own, "query_id").join(items.withColumnRenamed("id", "item_id"), "item_id", "left")
    return joined.groupBy("query_id").agg(F.round(F.avg((F.coalesce("venue", F.lit("")) == F.col("own")).cast("double")), 6).alias("recall"))


def _profiles(spark, sf_dir):
    """Letter profiles stand in for passage vectors: SQL can count letters too."""
    rows = table(spark, sf_dir, "chunks").where("text is not null")
    return rows.select("chunk_id", X.letter_profile(F.col("text")).alias("embedding"))


def _profile(text):
    return [float(text.count(c)) for c in LETTERS]


def knn_chunks(spark, sf_dir):
    """The twenty passages nearest to a query vector."""
    chunks = table(spark, sf_dir, "chunks")
    return retrieval.vector_passages(chunks, _profiles(spark, sf_dir), _profile(CHUNK_QUERY), 20, dim=26).select("chunk_id", F.round("score", 6).alias("score"))


def knn_chunks_by_section(spark, sf_dir):
    """Five times the wanted nearest passages, of these the ones of a section."""
    chunks = table(spark, sf_dir, "chunks")
    return retrieval.vector_passages(chunks, _profiles(spark, sf_dir), _profile(CHUNK_QUERY), 40, section="other", dim=26).select("chunk_id", F.round("score", 6).alias("score"))


def get_snippets_semantic(spark, sf_dir):
    """Three times the wanted nearest passages, of these the ones of papers."""
    scope = table(spark, sf_dir, "library_items").where("item_type = 'paper'").select(F.col("id").alias("item_id"))
    chunks = table(spark, sf_dir, "chunks")
    out = retrieval.passages(chunks, CHUNK_QUERY, 20, None, scope, _profiles(spark, sf_dir), _profile(CHUNK_QUERY), 26)
    return out.select("chunk_id", "item_id", "chunk_index", F.round("score", 6).alias("score"))


def best_snippet_semantic(spark, sf_dir):
    """Of the hundred nearest passages each item's nearest one."""
    items = table(spark, sf_dir, "library_items").select(F.col("id").alias("item_id"))
    out = retrieval.best_passages(items, table(spark, sf_dir, "chunks"), CHUNK_QUERY, None, 20, "semantic", _profiles(spark, sf_dir), _profile(CHUNK_QUERY), 26)
    return out.where("chunk_id is not null").select("item_id", "chunk_id", "page", "chunk_index", F.length("snippet").alias("n_chars"))


def fts_stored_index(spark, sf_dir):
    """Passages of one section from a stored index: only the postings of the query's words are read."""
    chunks = table(spark, sf_dir, "chunks")
    index = fts.Index.write(chunks.select("chunk_id", "text").dropDuplicates(["chunk_id"]), "chunk_id", ["text"])
    return retrieval.keyword_passages(chunks, CHUNK_QUERY, 20, SECTION, None, index).select("chunk_id", F.round("score", 6).alias("score"))


def fts_notes(spark, sf_dir):
    """Keyword search over titles, abstracts and notes; venues stand in for notes."""
    items = table(spark, sf_dir, "library_items").withColumn("notes", F.col("venue"))
    out = retrieval.hybrid(items, table(spark, sf_dir, "item_embeddings"), "annals of", None, 20, "keyword")
    return out.select("item_id", "rank")


def search_evaluation(spark, sf_dir):
    """Recall at ten of keyword and of semantic search for items' own titles' first words, with a made-up duration."""
    near = knn_query_set(spark, sf_dir)
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy("distance", "item_id"))
    runs = near.select(F.lit("semantic").alias("mode"), "query_id", "item_id", rank.alias("rank"), F.pmod("query_id", F.lit(97)).cast("double").alias("ms"))
    expected = near.where("distance < 0.3").select("query_id", "item_id")
    out = retrieval.evaluation(runs, expected, 3)
    return out.select("mode", "queries", F.round("recall", 6).alias("recall"), F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_chunks, knn_chunks_by_section, get_snippets_semantic, best_snippet_semantic, fts_stored_index, fts_notes, search_evaluation,
        fts_items_bm25, fts_and_phrase, fts_index_search, fts_chunks, fts_by_section, fts_document_search, knn_items, knn_postfilter, knn_query_set,
        rrf_fusion, hybrid_search, best_snippet_per_item, get_snippets_scoped, eval_recall_at_10,
    )
}


def bm25_sql(source: str, key: str, columns: list[str], query: str, limit: int | None, where: str = "TRUE") -> str:
    """The scores as SQL, for a CTE ``hits``."""
    phrases = query_phrases(query)
    words = [f"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')" for c in columns]

    def count(array: str, phrase: list[str]) -> str:
        fits = " AND ".join(f"{array}[i + {k}] = '{w}'" for k, w in enumerate(phrase))
        return f"len(list_filter(range(1, len({array}) + 1), lambda i: {fits}))"

    tf = [" + ".join(count(f"w{c}", p) for c in range(len(columns))) for p in phrases]
    size = " + ".join(f"len(w{c})" for c in range(len(columns)))
    score = " + ".join(
        f"greatest(ln((s.n - s.n{k} + 0.5) / (s.n{k} + 0.5)), 1e-6) * t.tf{k} * 2.2 / (t.tf{k} + 1.2 * (0.25 + 0.75 * t.size / (s.total / s.n)))" for k in range(len(phrases))
    )
    return f"""
w AS (SELECT {key}, {', '.join(f'{x} AS w{c}' for c, x in enumerate(words))}, {where} AS open FROM {source}),
t AS (SELECT {key}, CAST({size} AS DOUBLE) AS size, open, {', '.join(f'CAST({x} AS DOUBLE) AS tf{k}' for k, x in enumerate(tf))} FROM w),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(size) AS total, {', '.join(f'CAST(count(*) FILTER (tf{k} > 0) AS DOUBLE) AS n{k}' for k in range(len(phrases)))} FROM t),
hits AS (SELECT t.{key}, -({score}) AS score FROM t, s WHERE coalesce(open, FALSE) AND {' AND '.join(f't.tf{k} > 0' for k in range(len(phrases)))}
  ORDER BY score, {key} {f'LIMIT {limit}' if limit else ''})"""


_CHUNKS = "(SELECT DISTINCT * FROM chunks)"
_VECTORS = """
v AS (SELECT DISTINCT item_id, CAST(embedding AS DOUBLE[]) AS e FROM item_embeddings
  WHERE len(embedding) = 768 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT e FROM v ORDER BY item_id LIMIT 1)"""
_NEAR = "SELECT v.item_id, sqrt(greatest(0, 2 - 2 * list_cosine_similarity(v.e, q.e))) AS distance FROM v, q ORDER BY round(distance, 9), item_id LIMIT {n}"
_FUSED = f"""{bm25_sql('library_items', 'id', ['title', 'abstract'], QUERY, 60)},{_VECTORS},
near AS ({_NEAR.format(n=60)}),
l AS (SELECT id AS item_id, 0 AS list_no, row_number() OVER (ORDER BY score, id) AS rank FROM hits
  UNION ALL SELECT item_id, 1, row_number() OVER (ORDER BY round(distance, 9), item_id) FROM near),
f AS (SELECT item_id, sum(1.0 / CAST(60 + rank AS DOUBLE)) AS score, min(list_no * 1000000 + rank) AS first FROM l GROUP BY item_id)"""

SQL = {
    "fts_items_bm25": f"WITH {bm25_sql('library_items', 'id', ['title', 'abstract'], QUERY, 20)} SELECT id, round(score, 6) AS score FROM hits",
    "fts_and_phrase": f"WITH {bm25_sql('library_items', 'id', ['title', 'abstract'], PHRASE, 20)} SELECT id, round(score, 6) AS score FROM hits",
    "fts_index_search": f"WITH {bm25_sql('library_items', 'id', ['title', 'abstract'], QUERY, 20)} SELECT id, round(score, 6) AS score FROM hits",
    "fts_chunks": f"WITH {bm25_sql(_CHUNKS, 'chunk_id', ['text'], CHUNK_QUERY, 20)} SELECT chunk_id, round(score, 6) AS score FROM hits",
    "fts_by_section": f"WITH {bm25_sql(_CHUNKS, 'chunk_id', ['text'], CHUNK_QUERY, 20, f'''section = '{SECTION}' ''')} SELECT chunk_id, round(score, 6) AS score FROM hits",
    "fts_document_search": f"WITH {bm25_sql('documents', 'doc_id', ['text'], 'reading room', 20)} SELECT doc_id, round(score, 6) AS score FROM hits",
    "knn_items": f"WITH {_VECTORS} SELECT item_id, round(-distance, 6) AS score FROM ({_NEAR.format(n=10)})",
    "knn_postfilter": f"WITH {_VECTORS}, near AS ({_NEAR.format(n=50)}) SELECT item_id, round(distance, 6) AS distance FROM near WHERE item_id IN (SELECT id FROM library_items WHERE item_type = 'paper') ORDER BY round(near.distance, 9), item_id LIMIT 10",
    "knn_query_set": f"""WITH {_VECTORS} SELECT query_id, item_id, round(distance, 6) AS distance FROM (
  SELECT a.item_id AS query_id, b.item_id, sqrt(greatest(0, 2 - 2 * list_cosine_similarity(a.e, b.e))) AS distance FROM v a, v b WHERE a.item_id % 100 = 0)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), item_id) <= 10""",
    "rrf_fusion": f"WITH {_FUSED} SELECT item_id, round(score, 8) AS score FROM f",
    "hybrid_search": f"""WITH {_FUSED}, r AS (SELECT item_id, CAST(row_number() OVER (ORDER BY score DESC, first, item_id) AS INTEGER) AS rank FROM f ORDER BY rank LIMIT 20)
SELECT item_id, rank, round(1.0 / CAST(rank AS DOUBLE), 6) AS score, title, publication_year FROM r JOIN library_items ON id = item_id""",
    "best_snippet_per_item": f"""WITH {bm25_sql(_CHUNKS, 'chunk_id', ['text'], CHUNK_QUERY, None)}
SELECT item_id, chunk_id, page, round(score, 6) AS score, CAST(length(text) AS INTEGER) AS n_chars FROM hits JOIN (SELECT DISTINCT * FROM chunks) USING (chunk_id)
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score, chunk_id) = 1""",
    "get_snippets_scoped": f"""WITH {bm25_sql(_CHUNKS, 'chunk_id', ['text'], 'samples', None)}
SELECT chunk_id, item_id, chunk_index, round(score, 6) AS score FROM hits JOIN (SELECT DISTINCT * FROM chunks) USING (chunk_id)
WHERE item_id IN (SELECT id FROM library_items WHERE item_type = 'book') ORDER BY hits.score, chunk_id LIMIT 10""",
}
SQL["eval_recall_at_10"] = f"""WITH near AS ({SQL['knn_query_set']}), i AS (SELECT id, lower(trim(venue)) AS venue FROM library_items WHERE venue IS NOT NULL)
SELECT query_id, round(avg(CASE WHEN coalesce(b.venue, '') = a.venue THEN 1.0 ELSE 0.0 END), 6) AS recall
FROM near JOIN i a ON a.id = query_id LEFT JOIN i b ON b.id = item_id WHERE query_id <> item_id GROUP BY query_id"""

_PROFILE = ", ".join(f"CAST(length(lower(text)) - length(replace(lower(text), '{c}', '')) AS DOUBLE)" for c in LETTERS)
_PASSAGES = f"""p AS (SELECT *, [{_PROFILE}] AS e FROM (SELECT DISTINCT chunk_id, item_id, chunk_index, page, section, text FROM chunks WHERE text IS NOT NULL)),
np AS (SELECT *, round(sqrt(greatest(0, 2 - 2 * list_cosine_similarity(e, {_profile(CHUNK_QUERY)}::DOUBLE[]))), 9) AS d FROM p WHERE list_sum(e) > 0 ORDER BY d, chunk_id LIMIT {{n}})"""
SQL |= {
    "knn_chunks": f"WITH {_PASSAGES.format(n=20)} SELECT chunk_id, round(-d, 6) AS score FROM np",
    "knn_chunks_by_section": f"WITH {_PASSAGES.format(n=200)} SELECT chunk_id, round(-d, 6) AS score FROM (SELECT * FROM np WHERE section = 'other' ORDER BY d, chunk_id LIMIT 40)",
    "get_snippets_semantic": f"""WITH {_PASSAGES.format(n=60)} SELECT chunk_id, item_id, chunk_index, round(-d, 6) AS score FROM (
  SELECT * FROM np WHERE item_id IN (SELECT id FROM library_items WHERE item_type = 'paper') ORDER BY d, chunk_id LIMIT 20)""",
    "best_snippet_semantic": f"""WITH {_PASSAGES.format(n=100)} SELECT item_id, chunk_id, page, chunk_index, CAST(length(text) AS INTEGER) AS n_chars FROM np
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY d, chunk_id) = 1""",
    "fts_stored_index": SQL["fts_by_section"],
    "fts_notes": f"WITH {bm25_sql('library_items', 'id', ['title', 'abstract', 'venue'], 'annals of', 20)} SELECT id AS item_id, CAST(row_number() OVER (ORDER BY score, id) AS INTEGER) AS rank FROM hits",
    "search_evaluation": f"""WITH near AS ({SQL['knn_query_set']}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM near),
q AS (SELECT query_id, count(*) FILTER (distance < 0.3) AS wanted, count(*) FILTER (distance < 0.3 AND rank <= 3) AS hits, query_id % 97 AS ms FROM r GROUP BY 1)
SELECT 'semantic' AS mode, count(*) FILTER (wanted > 0) AS queries, round(avg(hits / wanted) FILTER (wanted > 0), 6) AS recall,
  round(quantile_cont(CAST(ms AS DOUBLE), 0.5), 6) AS p50_ms, round(quantile_cont(CAST(ms AS DOUBLE), 0.95), 6) AS p95_ms FROM q""",
}
