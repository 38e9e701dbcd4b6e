"""Duplicate detection, relations and metadata over the library's tables, with SQL for the checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators import dedup as D
from ..operators import graph as G
from ..operators import metadata as M
from ..operators import vector as V
from ..session import cut, table
from .retrieval_queries import _VECTORS, DIM

#: The library has no editions; this rule gives some items one.
EDITION = "CASE id % 5 WHEN 0 THEN '1' WHEN 1 THEN '2nd' WHEN 2 THEN '3rd ed.' END"
FIELDS = ["title", "abstract", "publication_year", "doi", "venue"]


def _items(spark, sf_dir):
    return table(spark, sf_dir, "library_items").withColumn("edition", F.expr(EDITION.replace("END", "ELSE NULL END")))


def _candidates(spark, sf_dir):
    """Library rows as candidates; those of ids divisible by 7 are errata, and by 9 preprints that name a DOI."""
    items = _items(spark, sf_dir)
    doi = items.select((F.col("id") + 1).alias("id"), F.col("doi").alias("linked_doi")).where("linked_doi is not null")
    title = F.when(F.col("id") % 7 == 0, F.concat(F.lit("Erratum to: "), F.col("title"))).otherwise(F.col("title"))
    arxiv = F.when(F.col("id") % 9 == 0, F.concat(F.lit("9999."), F.col("id").cast("string"))).otherwise(F.col("arxiv_id"))
    return items.withColumns({"title": title, "arxiv_id": arxiv}).join(doi, "id", "left")


def _parts(spark, sf_dir):
    """Candidates without the identifiers a second copy of an item would lack."""
    return _candidates(spark, sf_dir), _items(spark, sf_dir)


def dedup_tier1_exact(spark, sf_dir):
    """Items that share a hash, DOI, arXiv id or ISBN with another."""
    items = _items(spark, sf_dir).withColumn("content_hash", F.col("venue"))  # venues stand in for hashes that repeat
    return D.exact(items, items).select("id", "outcome", "target_id", "reason")


def dedup_tier1_documents(spark, sf_dir):
    """Documents with the same text: the smallest other one."""
    docs = table(spark, sf_dir, "documents").where("trim(text) <> ''").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    docs = docs.withColumns({k: F.lit(None).cast("string") for k in ("doi", "arxiv_id", "isbn")})
    return D.exact(docs, docs).select("id", "target_id", "reason")


def dedup_tier2_erratum(spark, sf_dir):
    """Errata and the works they name."""
    candidates, items = _parts(spark, sf_dir)
    return D.errata(candidates, items).select("id", "target_id", "relation", "confidence")


def dedup_tier3_linked(spark, sf_dir):
    """Preprints and the items whose DOI they name."""
    candidates, items = _parts(spark, sf_dir)
    return D.linked(candidates, items).select("id", "target_id", "relation")


def _neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "item_embeddings")
    near = V.nearest(rows, rows, D.NEIGHBOURS, DIM)
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy("distance", "item_id"))
    return near.select(F.col("query_id").alias("id"), F.col("item_id").alias("target_id"), rank.alias("rank"), F.round(V.similarity_of_distance(F.col("distance")), 6).alias("similarity"))


def _semantic(spark, sf_dir, apart=None):
    keys = D.author_keys(table(spark, sf_dir, "item_authors"), table(spark, sf_dir, "authors"))
    near, _ = cut(_neighbours(spark, sf_dir), "neighbours")
    return D.semantic(near, _items(spark, sf_dir), keys, apart)


def dedup_tier4_scan(spark, sf_dir):
    """Near neighbours of every item with a usable vector: merges, editions and related works."""
    return _semantic(spark, sf_dir).select("id", "outcome", "target_id", "relation", F.round("confidence", 5).alias("confidence"), "reason")


def dedup_tier4_apart(spark, sf_dir):
    """The same where pairs of works of one venue are known to be different: these are passed over."""
    venues = _items(spark, sf_dir).where("venue is not null").select("id", "venue")
    apart = _neighbours(spark, sf_dir).join(venues, "id").join(venues.select(F.col("id").alias("target_id"), "venue"), ["target_id", "venue"])
    rows = _semantic(spark, sf_dir, apart.select(F.col("target_id").alias("a_id"), F.col("id").alias("b_id")))
    return rows.select("id", "outcome", "target_id", "relation", F.round("confidence", 5).alias("confidence"), "reason")


def dedup_edition(spark, sf_dir):
    """How editions of works of one venue and year relate to the venue's first."""
    rows = _items(spark, sf_dir).where("venue is not null")
    first = rows.groupBy("venue").agg(F.min("id").alias("target_id"))
    other = rows.select(F.col("id").alias("target_id"), F.col("edition").alias("e"), F.col("publication_year").alias("y"))
    both = rows.join(first, "venue").join(other, "target_id").where("id <> target_id")
    return both.select("id", "target_id", D.edition_relation(F.col("edition"), F.col("e"), F.col("publication_year"), F.col("y")).alias("relation")).where("relation is not null")


def dedup_decide_all(spark, sf_dir):
    """One decision per candidate, counted by outcome and reason, every candidate through all four tiers."""
    candidates, items = _parts(spark, sf_dir)
    tiers = [D.exact(candidates, items), D.errata(candidates, items), D.linked(candidates, items), _semantic(spark, sf_dir)]
    return D.counts(D.decide(candidates, tiers))


def author_jaccard(spark, sf_dir):
    """Shared authors of works that are called versions of one another."""
    keys = D.author_keys(table(spark, sf_dir, "item_authors"), table(spark, sf_dir, "authors")).groupBy("item_id").agg(F.collect_set("key").alias("keys"))
    rows = G.edges(table(spark, sf_dir, "item_relations")).where("relation = 'preprint_of' and subject_id <> object_id").select("subject_id", "object_id")
    both = rows.join(keys.select(F.col("item_id").alias("subject_id"), F.col("keys").alias("a")), "subject_id").join(keys.select(F.col("item_id").alias("object_id"), F.col("keys").alias("b")), "object_id")
    return both.select("subject_id", "object_id", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


def relation_inverse_closure(spark, sf_dir):
    """All relations with their inverses."""
    return G.with_inverses(table(spark, sf_dir, "item_relations"))


def relation_missing_inverse(spark, sf_dir):
    """Stored relations whose inverse is not stored."""
    return G.missing_inverses(table(spark, sf_dir, "item_relations")).select("subject_id", "relation", "object_id")


def _kind(kind):
    def query(spark, sf_dir):
        return G.neighbours(table(spark, sf_dir, "item_relations"), table(spark, sf_dir, "library_items"), kind)

    query.__doc__ = f"Related items of kind {kind}."
    return query


def series_parents(spark, sf_dir):
    """Parents of series; here the venue stands for the series."""
    return G.series_parents(table(spark, sf_dir, "library_items"), "venue")[0].select("series", "members")


def _toc(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks").where("page is not null").select("item_id", "chunk_index", "page").distinct()
    toc = chunks.where("chunk_index % 3 = 0").select(F.col("item_id").alias("book_id"), F.col("chunk_index").alias("position"), F.concat(F.lit("Part "), F.col("chunk_index").cast("string")).alias("title"), "page")
    return toc, chunks.groupBy(F.col("item_id").alias("book_id")).agg(F.max("page").alias("page_count"))


def chapter_ranges(spark, sf_dir):
    """Page ranges of chapters, from every third passage as a table of contents."""
    return G.chapter_ranges(*_toc(spark, sf_dir))


def pages_range_join(spark, sf_dir):
    """Passages on the pages of each chapter, counted."""
    pages = table(spark, sf_dir, "chunks").where("page is not null").select(F.col("item_id").alias("book_id"), "chunk_id", "page").distinct()
    return G.pages_of_chapters(pages, G.chapter_ranges(*_toc(spark, sf_dir))).groupBy("book_id", "index").agg(F.count(F.lit(1)).alias("n"))


def metadata_layered_merge(spark, sf_dir):
    """Candidates of each item merged in layers of authority."""
    return M.layered(table(spark, sf_dir, "metadata_candidates").where("candidate_id is not null"), FIELDS)


def metadata_best_source(spark, sf_dir):
    """The best candidate of each item."""
    return M.best(table(spark, sf_dir, "metadata_candidates")).select("item_id", "candidate_id", "source")


def merge_backfill(spark, sf_dir):
    """Items whose empty fields are filled from their merged candidates."""
    merged = M.layered(table(spark, sf_dir, "metadata_candidates"), FIELDS).withColumnRenamed("item_id", "id")
    return M.backfilled(table(spark, sf_dir, "library_items"), merged, ["abstract", "publication_year", "doi", "venue"]).select("id", "abstract", "publication_year", "doi", "venue")


def artifact_latest(spark, sf_dir):
    """Insert or replace: the newest candidate of each item and source."""
    rows = table(spark, sf_dir, "metadata_candidates").where("source is not null").dropDuplicates(["candidate_id"])
    return M.latest(rows, ["item_id", "source"], "fetched_at", "candidate_id").select("item_id", "source", "candidate_id")


def eav_pivot(spark, sf_dir):
    """Items as rows of (item, field, value), and back by a pivot."""
    items = table(spark, sf_dir, "library_items").select("id", "title", "venue", F.col("publication_year").cast("string").alias("year"))
    rows = items.unpivot("id", ["title", "venue", "year"], "field", "value").where("value is not null")
    return rows.groupBy("id").pivot("field", ["title", "venue", "year"]).agg(F.first("value"))


def invariants(spark, sf_dir):
    """Numbers of violations of the library's rules."""
    items, chunks, relations = table(spark, sf_dir, "library_items"), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "item_relations")
    ids = items.select("id")
    one = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations"))
    rules = [
        one("hash_unique", items.where("content_hash is not null").groupBy("content_hash").count().where("count > 1")),
        one("doi_unique", items.where("doi is not null").groupBy("doi").count().where("count > 1")),
        one("inverse_exists", G.missing_inverses(relations)),
        one("vector_dimension", table(spark, sf_dir, "item_embeddings").where(F.size("embedding") != DIM)),
        one("orphan_chunks", chunks.join(ids.withColumnRenamed("id", "item_id"), "item_id", "left_anti")),
        one("paper_with_doi_has_venue", items.where("item_type = 'paper' and doi is not null and (venue is null or trim(venue) = '')")),
        one("known_item_type", items.where("item_type is null or title is null")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        dedup_tier1_exact, dedup_tier1_documents, dedup_tier2_erratum, dedup_tier3_linked, dedup_tier4_scan, dedup_tier4_apart, dedup_edition, dedup_decide_all, author_jaccard,
        relation_inverse_closure, relation_missing_inverse, series_parents, chapter_ranges, pages_range_join, metadata_layered_merge, metadata_best_source,
        merge_backfill, artifact_latest, eav_pivot, invariants,
    )
} | {f"related_{k}": _kind(k) for k in G.KINDS}

_INVERSE = "CASE relation " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in G.INVERSES.items()) + " END"
_EDGES = f"""
e AS (SELECT subject_id, relation, object_id, max(coalesce(confidence, 1.0)) AS confidence FROM (
  SELECT subject_id, object_id, confidence, regexp_replace(regexp_replace(lower(relation), '[\\s_-]+', '_', 'g'), '^_|_$', '', 'g') AS relation FROM item_relations)
  WHERE relation IN ({', '.join(f"'{k}'" for k in G.INVERSES)}) GROUP BY 1, 2, 3)"""
_ITEMS = f"i AS (SELECT *, {EDITION} AS edition FROM library_items)"
_CANDIDATES = f"""{_ITEMS},
c AS (SELECT i.* REPLACE (CASE WHEN i.id % 7 = 0 THEN 'Erratum to: ' || i.title ELSE i.title END AS title, CASE WHEN i.id % 9 = 0 THEN '9999.' || i.id ELSE i.arxiv_id END AS arxiv_id), d.doi AS linked_doi
  FROM i LEFT JOIN library_items d ON d.id + 1 = i.id)"""


def _exact(candidates: str, items: str, keys=D.KEYS) -> str:
    parts = [
        f"SELECT a.id, {k} AS place, min(b.id) AS target_id, '{reason}' AS reason FROM {candidates} a JOIN {items} b ON a.{key} = b.{key} AND a.id <> b.id WHERE trim(a.{key}) <> '' GROUP BY a.id"
        for k, (key, reason) in enumerate(keys)
    ]
    return f"SELECT id, target_id, reason FROM ({' UNION ALL '.join(parts)}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1"


def _edition(a: str, b: str, ay: str, by: str) -> str:
    number = lambda x: f"try_cast(nullif(regexp_extract({x}, '(\\d+)', 1), '') AS INTEGER)"
    plain = lambda x: f"lower(trim(coalesce({x}, '')))"
    return f"""CASE WHEN ({plain(a)} = '' AND {plain(b)} = '') OR {plain(a)} = {plain(b)} OR coalesce({number(a)} = {number(b)}, FALSE) THEN NULL
  WHEN CASE WHEN {number(a)} IS NOT NULL AND {number(b)} IS NOT NULL THEN {number(a)} < {number(b)} WHEN {ay} IS NOT NULL AND {by} IS NOT NULL THEN {ay} < {by} ELSE FALSE END THEN 'earlier_edition_of' ELSE 'later_edition_of' END"""


_ERRATA = """SELECT c.id, min(o.id) AS target_id FROM c JOIN library_items o
  ON contains(lower(o.title), lower(trim(regexp_replace(c.title, '^Erratum to: ', ''), '."'' '))) AND o.id <> c.id
  WHERE c.title LIKE 'Erratum to: %' AND length(trim(regexp_replace(c.title, '^Erratum to: ', ''), '."'' ')) >= 15 GROUP BY c.id"""
_LINKED = "SELECT c.id, min(o.id) AS target_id FROM c JOIN library_items o ON o.doi = c.linked_doi WHERE trim(c.arxiv_id) <> '' AND trim(c.linked_doi) <> '' GROUP BY c.id HAVING min(o.id) <> c.id"
_SEMANTIC = f"""
near AS (SELECT id, target_id, round(1 - d * d / 2, 6) AS similarity, row_number() OVER (PARTITION BY id ORDER BY d, target_id) AS rank FROM (
  SELECT a.item_id AS id, b.item_id AS target_id, round(sqrt(greatest(0, 2 - 2 * list_cosine_similarity(a.e, b.e))), 9) AS d FROM v a, v b)
  QUALIFY rank <= 10),
ak AS (SELECT DISTINCT item_id, normalized_key AS key FROM item_authors JOIN authors USING (author_id)),
n AS (SELECT near.*, (SELECT count(*) FROM ak x JOIN ak y USING (key) WHERE x.item_id = near.id AND y.item_id = near.target_id) AS shared, a.edition AS ae, b.edition AS be, a.publication_year AS y1, b.publication_year AS y2
  FROM near JOIN i a ON a.id = near.id JOIN i b ON b.id = near.target_id WHERE near.id <> near.target_id),
n2 AS (SELECT *, CASE WHEN similarity >= 0.85 AND shared > 0 THEN {_edition('ae', 'be', 'y1', 'y2')} END AS edition_relation FROM n),
n3 AS (SELECT *, CASE WHEN edition_relation IS NOT NULL THEN 'edition' WHEN similarity >= 0.97 AND shared > 0 THEN 'semantic_match' WHEN similarity >= 0.95 AND shared = 0 THEN 'semantic_related' END AS reason FROM n2),
sem AS (SELECT id, CASE reason WHEN 'semantic_match' THEN 'merge' ELSE 'link' END AS outcome, target_id, CASE reason WHEN 'edition' THEN edition_relation WHEN 'semantic_related' THEN 'related' END AS relation,
  similarity AS confidence, reason FROM n3 WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank) = 1)"""
_APART = _SEMANTIC.replace("WHERE near.id <> near.target_id)", "WHERE near.id <> near.target_id AND NOT coalesce(a.venue = b.venue, FALSE))")
_RANK = "CASE source " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in M.AUTHORITY.items()) + f" ELSE {M.UNKNOWN} END"
_TOC = """
ch AS (SELECT DISTINCT item_id, chunk_index, page FROM chunks WHERE page IS NOT NULL),
b AS (SELECT item_id, max(page) AS page_count FROM ch GROUP BY 1),
t AS (SELECT item_id AS book_id, CAST(row_number() OVER w - 1 AS INTEGER) AS index, 'Part ' || chunk_index AS title, page AS start_page,
  greatest(page, coalesce(lead(page) OVER w - 1, page_count)) AS end_page, count(*) OVER (PARTITION BY item_id) AS n
  FROM ch JOIN b USING (item_id) WHERE chunk_index % 3 = 0 WINDOW w AS (PARTITION BY item_id ORDER BY chunk_index)),
r AS (SELECT book_id, index, title, start_page, end_page FROM t WHERE n >= 2)"""


def _layer(field: str) -> str:
    filled = f"nullif({field}, '') IS NOT NULL" if field != "publication_year" else f"{field} IS NOT NULL"
    return f"l_{field} AS (SELECT item_id, {field} FROM m WHERE {filled} QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank DESC, confidence DESC NULLS LAST, candidate_id) = 1)"


_LAYERED = f"""m AS (SELECT DISTINCT candidate_id, item_id, source, confidence, title, abstract, publication_year, doi, venue, {_RANK} AS rank FROM metadata_candidates),
{', '.join(_layer(f) for f in FIELDS)},
best AS (SELECT item_id, candidate_id, source FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank DESC, confidence DESC NULLS LAST, candidate_id) = 1),
layered AS (SELECT item_id, source, {', '.join(FIELDS)} FROM best {' '.join(f'LEFT JOIN l_{f} USING (item_id)' for f in FIELDS)})"""

SQL = {
    "dedup_tier1_exact": f"WITH i AS (SELECT * REPLACE (venue AS content_hash) FROM library_items) SELECT id, 'merge' AS outcome, target_id, reason FROM ({_exact('i', 'i')})",
    "dedup_tier1_documents": """SELECT a.doc_id AS id, min(b.doc_id) AS target_id, 'hash_match' AS reason FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) AND a.doc_id <> b.doc_id
WHERE trim(a.text, ' ') <> '' GROUP BY 1""",
    "dedup_tier2_erratum": f"WITH {_CANDIDATES} SELECT id, target_id, 'erratum_for' AS relation, CAST(0.9 AS DOUBLE) AS confidence FROM ({_ERRATA})",
    "dedup_tier3_linked": f"WITH {_CANDIDATES} SELECT id, target_id, 'preprint_of' AS relation FROM ({_LINKED})",
    "dedup_tier4_scan": f"WITH {_VECTORS}, {_ITEMS}, {_SEMANTIC} SELECT id, outcome, target_id, relation, round(confidence, 5) AS confidence, reason FROM sem",
    "dedup_edition": f"""WITH {_ITEMS}, f AS (SELECT venue, min(id) AS target_id FROM i WHERE venue IS NOT NULL GROUP BY 1)
SELECT * FROM (SELECT a.id, f.target_id, {_edition('a.edition', 'b.edition', 'a.publication_year', 'b.publication_year')} AS relation FROM i a JOIN f USING (venue) JOIN i b ON b.id = f.target_id WHERE a.id <> f.target_id) WHERE relation IS NOT NULL""",
    "dedup_decide_all": f"""WITH {_VECTORS}, {_CANDIDATES}, {_SEMANTIC}, d AS (
  SELECT id, 1 AS tier, 'merge' AS outcome, reason FROM ({_exact('c', 'i')})
  UNION ALL SELECT id, 2, 'link', 'erratum_title' FROM ({_ERRATA}) UNION ALL SELECT id, 3, 'link', 'arxiv_published_doi' FROM ({_LINKED})
  UNION ALL SELECT id, 4, outcome, reason FROM sem), one AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier) = 1)
SELECT coalesce(outcome, 'insert') AS outcome, coalesce(reason, 'no_match') AS reason, count(*) AS n FROM c LEFT JOIN one USING (id) GROUP BY 1, 2""",
    "author_jaccard": f"""WITH {_EDGES}, ak AS (SELECT item_id, list(DISTINCT normalized_key) AS keys FROM item_authors JOIN authors USING (author_id) GROUP BY 1)
SELECT subject_id, object_id, round(len(list_intersect(a.keys, b.keys)) / len(list_distinct(list_concat(a.keys, b.keys))), 6) AS jaccard
FROM e JOIN ak a ON a.item_id = subject_id JOIN ak b ON b.item_id = object_id WHERE relation = 'preprint_of' AND subject_id <> object_id""",
    "relation_inverse_closure": f"""WITH {_EDGES}, k AS (SELECT * FROM e WHERE NOT (relation = 'related' AND subject_id = object_id))
SELECT subject_id, relation, object_id, max(confidence) AS confidence FROM (SELECT * FROM k UNION ALL SELECT object_id, {_INVERSE}, subject_id, confidence FROM k) GROUP BY 1, 2, 3""",
    "relation_missing_inverse": f"WITH {_EDGES} SELECT subject_id, relation, object_id FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.subject_id = e.object_id AND b.object_id = e.subject_id AND b.relation = {_INVERSE.replace('CASE relation', 'CASE e.relation')})",
    "series_parents": "SELECT venue AS series, count(*) AS members FROM library_items WHERE item_type IN ('book', 'chapter', 'report') AND trim(venue) <> '' GROUP BY 1",
    "chapter_ranges": f"WITH {_TOC} SELECT * FROM r",
    "pages_range_join": f"WITH {_TOC} SELECT book_id, index, count(*) AS n FROM (SELECT DISTINCT item_id AS book_id, chunk_id, page FROM chunks WHERE page IS NOT NULL) p JOIN r USING (book_id) WHERE page BETWEEN start_page AND end_page GROUP BY 1, 2",
    "metadata_layered_merge": f"WITH {_LAYERED} SELECT item_id, source, {', '.join(FIELDS)} FROM layered",
    "metadata_best_source": f"WITH {_LAYERED} SELECT item_id, candidate_id, source FROM best",
    "merge_backfill": f"""WITH {_LAYERED} SELECT id, coalesce(nullif(i.abstract, ''), nullif(l.abstract, '')) AS abstract, coalesce(i.publication_year, l.publication_year) AS publication_year,
  coalesce(nullif(i.doi, ''), nullif(l.doi, '')) AS doi, coalesce(nullif(i.venue, ''), nullif(l.venue, '')) AS venue FROM library_items i LEFT JOIN layered l ON l.item_id = i.id""",
    "artifact_latest": "SELECT item_id, source, candidate_id FROM (SELECT DISTINCT item_id, source, candidate_id, fetched_at FROM metadata_candidates WHERE source IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY fetched_at DESC NULLS LAST, candidate_id DESC) = 1",
    "eav_pivot": "SELECT id, title, venue, CAST(publication_year AS VARCHAR) AS year FROM library_items",
    "invariants": f"""WITH {_EDGES}
SELECT 'hash_unique' AS rule, count(*) AS violations FROM (SELECT content_hash FROM library_items WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'doi_unique', count(*) FROM (SELECT doi FROM library_items WHERE doi IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'inverse_exists', count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.subject_id = e.object_id AND b.object_id = e.subject_id AND b.relation = {_INVERSE.replace('CASE relation', 'CASE e.relation')})
UNION ALL SELECT 'vector_dimension', count(*) FROM item_embeddings WHERE len(embedding) <> 768
UNION ALL SELECT 'orphan_chunks', count(*) FROM chunks WHERE NOT EXISTS (SELECT 1 FROM library_items WHERE id = item_id)
UNION ALL SELECT 'paper_with_doi_has_venue', count(*) FROM library_items WHERE item_type = 'paper' AND doi IS NOT NULL AND (venue IS NULL OR trim(venue) = '')
UNION ALL SELECT 'known_item_type', count(*) FROM library_items WHERE item_type IS NULL OR title IS NULL""",
} | {
    f"related_{k}": f"WITH {_EDGES} SELECT subject_id, relation, object_id, confidence, title FROM e JOIN library_items ON id = object_id WHERE relation IN ({', '.join(repr(r) for r in labels)})"
    for k, labels in G.KINDS.items()
}
SQL["dedup_tier4_apart"] = SQL["dedup_tier4_scan"].replace(_SEMANTIC, _APART)
