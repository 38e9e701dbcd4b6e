"""Queries of the llm operators: (spark, folder of the tables) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import groups, leakage, names, neighbours, privacy, scans, splitting, survivor, tokenising


def p1_found(spark, sf_dir):
    """Pairs of author rows of one person or organisation."""
    return names.same_pairs(table(spark, sf_dir, "authors"))


def p1_entities(spark, sf_dir):
    """Every author row with the smallest row of its person or organisation."""
    who = names.entities(table(spark, sf_dir, "authors"))
    first = who.groupBy("entity").agg(F.min("author_id").alias("first_id"))
    return who.join(first, "entity").select("author_id", "first_id")


def p2_found(spark, sf_dir):
    """Oversized chunks and the weakest boundary needed to split them."""
    return splitting.oversized_boundaries(table(spark, sf_dir, "chunks"))


def p2_pieces(spark, sf_dir):
    """Every chunk in pieces of at most 400 words, with order and page."""
    chunks = table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"])
    return splitting.split_oversized(chunks).select(
        "chunk_id", "item_id", "chunk_index", "page", "piece_no", "piece", "piece_words", "overlap_words", "cut"
    )


def p3_found(spark, sf_dir):
    """Items that are versions of one work share a group id."""
    return groups.version_groups(table(spark, sf_dir, "item_relations"))


def p4_found(spark, sf_dir):
    """Pairs of items of which one is among the other's ten nearest."""
    return neighbours.similar_pairs(table(spark, sf_dir, "item_embeddings"))


def p5_found(spark, sf_dir):
    """The candidate whose value survives, for each item and field."""
    return survivor.surviving_fields(table(spark, sf_dir, "metadata_candidates"))


def p5_records(spark, sf_dir):
    """One record per item, each field from the most trusted candidate that has a value."""
    return survivor.best_records(table(spark, sf_dir, "metadata_candidates"))


def p5_truths(spark, sf_dir):
    """Values that the two-sided quality model judges, with their probability."""
    return survivor.truth_model(table(spark, sf_dir, "metadata_candidates"))[0]


def p5_source_quality(spark, sf_dir):
    """Sensitivity and specificity of each source by the two-sided quality model."""
    return survivor.truth_model(table(spark, sf_dir, "metadata_candidates"))[1]


def p7_found(spark, sf_dir):
    """The kinds of noise in each chunk of a scanned page."""
    return scans.noise(table(spark, sf_dir, "chunks"))


def p7_repaired(spark, sf_dir):
    """Continuous paragraphs of each chunk of a scanned page."""
    return scans.repaired(table(spark, sf_dir, "chunks"))


def p8_ids(spark, sf_dir):
    """Token ids of every document."""
    return tokenising.encode(table(spark, sf_dir, "documents"))


def p8_roundtrip(spark, sf_dir):
    """Every document decoded from its ids."""
    return tokenising.decode(tokenising.encode(table(spark, sf_dir, "documents")), as_col="text").select("doc_id", "text")


def p9_found(spark, sf_dir):
    """Documents that hold two fifths or more of an evaluation passage."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_passages")).select("doc_id", "passage_id")


def p9_places(spark, sf_dir):
    """Where the passages stand in the documents, and how many words of them."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_passages"))


def p10_found(spark, sf_dir):
    """Every mention of a person or of a way to reach or identify one."""
    return privacy.mentions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "authors"))


def p10_redacted(spark, sf_dir):
    """Every document with typed placeholders in place of mentions."""
    return privacy.redact(table(spark, sf_dir, "documents"), table(spark, sf_dir, "authors"))


QUERIES = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_records": p5_records,
    "p5_truths": p5_truths,
    "p5_source_quality": p5_source_quality,
    "p7_found": p7_found,
    "p7_repaired": p7_repaired,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_found": p9_found,
    "p9_places": p9_places,
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
}

_FILLERS = ", ".join("'" + w + "'" for w in survivor.FILLERS)
_WORD = "regexp_replace(lower({0}), '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"


def _valid(field: str) -> str:
    if field == "publication_year":
        return "publication_year BETWEEN 1500 AND 2026"
    if field == "doi":
        return "coalesce(regexp_matches(doi, '10\\.[0-9]{4,9}/\\S'), false)"
    word = _WORD.format(field)
    return f"{field} IS NOT NULL AND {word} <> '' AND {word} NOT IN ({_FILLERS})"


_RANKED = """
WITH c AS (
  SELECT DISTINCT candidate_id, item_id, title, abstract, publication_year, doi, venue, fetched_at,
    regexp_replace(regexp_replace(lower(source), '[\\s_-]+', '_', 'g'), '^_|_$', '', 'g') AS src,
    CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence < 0 THEN 0.0 WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS conf
  FROM metadata_candidates
), r AS (
  SELECT *, CASE src WHEN 'crossref' THEN 0 WHEN 'arxiv' THEN 1 WHEN 'grobid' THEN 2 WHEN 'openlibrary' THEN 3 WHEN 'llm' THEN 4
    WHEN 'zotero_import' THEN 5 WHEN 'manual' THEN 5 WHEN 'manual_required' THEN 6 ELSE 7 END AS rank
  FROM c
)
"""


def _first(field: str, what: str) -> str:
    return f"SELECT item_id, {what} FROM r WHERE {_valid(field)} QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank, conf DESC, fetched_at DESC NULLS LAST, candidate_id) = 1"


_LINE_ENDS, _SPACES = "\\n\\r\\x0B\\f\\x{85}\\x{2028}\\x{2029}", "\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}"
_SPACE = f"[\\t {_LINE_ENDS}{_SPACES}]"
_BREAK, _BLANK = f"(?:\\r\\n|[{_LINE_ENDS}])", f"[\\t {_SPACES}]*"


def _words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^\\t {_LINE_ENDS}{_SPACES}]+'))"


SQL = {
    "p3_found": """
WITH RECURSIVE e AS (
  SELECT subject_id AS a, object_id AS b FROM item_relations
  WHERE regexp_replace(regexp_replace(lower(relation), '[\\s_-]+', '_', 'g'), '^_|_$', '', 'g')
    IN ('preprint_of', 'published_as', 'later_edition_of', 'earlier_edition_of', 'translates', 'translated_from')
    AND subject_id <> object_id
), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (
  SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a
)
SELECT a AS item_id, least(a, min(b)) AS group_id FROM r GROUP BY a
""",
    "p4_found": """
WITH v AS (
  SELECT DISTINCT item_id, CAST(embedding AS DOUBLE[]) AS e FROM item_embeddings
  WHERE len(embedding) = 768 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT a.item_id AS a, b.item_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.item_id <> b.item_id
), k AS (
  SELECT a, b, sim FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 10
)
SELECT DISTINCT least(a, b) AS item_a, greatest(a, b) AS item_b FROM k WHERE sim >= 0.7
""",
    "p5_found": _RANKED
    + ", two AS (SELECT item_id FROM c GROUP BY item_id HAVING count(DISTINCT candidate_id) > 1)\n"
    + "\nUNION ALL\n".join(f"SELECT item_id, '{f}' AS field, candidate_id FROM ({_first(f, 'candidate_id')}) JOIN two USING (item_id)" for f in survivor.FIELDS),
    "p5_records": _RANKED
    + "".join(f", f_{f} AS ({_first(f, f)})" for f in survivor.FIELDS)
    + " SELECT item_id, title, abstract, publication_year, doi, venue FROM (SELECT DISTINCT item_id FROM c)"
    + "".join(f" LEFT JOIN f_{f} USING (item_id)" for f in survivor.FIELDS),
    "p2_found": f"""
WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT chunk_id, unnest(regexp_split_to_array(text, '{_BREAK}{_BLANK}{_BREAK}')) AS part FROM c WHERE {_words('text')} > 400),
s AS (SELECT chunk_id, {_words('part')} AS n, list_max(list_transform(regexp_split_to_array(regexp_replace(part, '([.!?])({_SPACE})', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {_words('x')})) AS longest FROM p)
SELECT chunk_id, CASE WHEN max(n) <= 400 THEN 'paragraph' WHEN max(longest) <= 400 THEN 'sentence' ELSE 'word' END AS boundary FROM s GROUP BY 1
""",
    "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
