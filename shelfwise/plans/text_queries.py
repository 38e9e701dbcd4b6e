"""Text functions, chunking and markup over the library's tables, with SQL for the checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pyfuncs as P
from ..functions import text as X
from ..session import table


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null")


def _exploded(spark, sf_dir, function, name):
    return _documents(spark, sf_dir).select("doc_id", F.explode(function(F.col("text"))).alias(name))


def identify_doi(spark, sf_dir):
    """DOIs in documents."""
    return _exploded(spark, sf_dir, X.dois, "doi")


def identify_arxiv(spark, sf_dir):
    """arXiv ids in documents."""
    return _exploded(spark, sf_dir, X.arxiv_ids, "arxiv_id")


def identify_isbn(spark, sf_dir):
    """Valid ISBNs in documents."""
    return _exploded(spark, sf_dir, X.isbns, "isbn")


def isbn_checksum(spark, sf_dir):
    """ISBNs of items: valid or not, and as ISBN-13."""
    plain = F.upper(F.regexp_replace("isbn", r"[-\s]", ""))
    return table(spark, sf_dir, "library_items").where("isbn is not null").select(
        "id", "isbn", (X.isbn13_valid(plain) | X.isbn10_valid(plain)).alias("valid"), X.isbn13(F.col("isbn")).alias("isbn13")
    )


def section_classify(spark, sf_dir):
    """First lines of passages as headings, by the kind of section they open."""
    heading = F.regexp_extract("text", r"^([^\n]*)", 1)
    return table(spark, sf_dir, "chunks").where("text is not null").select("chunk_id", X.section(heading).alias("label")).distinct()


def author_key(spark, sf_dir):
    """Blocking keys of author rows."""
    return table(spark, sf_dir, "authors").select("author_id", X.author_key(F.col("family_name"), F.col("given_name")).alias("key"))


def orcid_extract(spark, sf_dir):
    """ORCIDs written with hyphens."""
    return table(spark, sf_dir, "authors").select("author_id", X.orcid(F.col("orcid")).alias("orcid"))


def display_names(spark, sf_dir):
    """Names as shown, and split again at the last word."""
    name = X.display_name(F.col("family_name"), F.col("given_name"))
    return table(spark, sf_dir, "authors").select("author_id", name.alias("name"), X.split_name(name)["family"].alias("last_word"))


def doi_normalised(spark, sf_dir):
    """DOIs of candidates without address and label."""
    return table(spark, sf_dir, "metadata_candidates").select("candidate_id", X.plain_doi(F.col("doi")).alias("doi")).distinct()


def urn_precedence(spark, sf_dir):
    """The most telling identifier of each item."""
    c = F.col
    return table(spark, sf_dir, "library_items").select("id", X.urn(c("doi"), c("arxiv_id"), c("isbn"), c("content_hash"), c("id")).alias("urn"))


def cas_paths(spark, sf_dir):
    """Paths of the content-addressed store for documents' texts."""
    return _documents(spark, sf_dir).select("doc_id", X.cas_path(F.sha2("text", 256)).alias("path"))


def bibtex(spark, sf_dir):
    """BibTeX entries of all items, with the family names of everybody who took part."""
    people = table(spark, sf_dir, "item_authors").select("item_id", "author_id", "position").distinct().join(table(spark, sf_dir, "authors").select("author_id", "family_name"), "author_id")
    listed = people.groupBy(F.col("item_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "author_id", "family_name"))), lambda x: x["family_name"]).alias("authors"))
    rows = table(spark, sf_dir, "library_items").join(listed, "id", "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))
    columns = {k: F.col(k) for k in ("item_type", "title", "venue", "doi", "isbn", "arxiv_id", "language", "authors")} | {"year": F.col("publication_year")}
    return rows.select("id", X.bibtex(columns).alias("entry"))


def highlight(spark, sf_dir):
    """Titles with the query's words marked."""
    return table(spark, sf_dir, "library_items").select("id", X.highlight(F.col("title"), "handbook of layer").alias("html"))


def year_extract(spark, sf_dir):
    """The first year in each document."""
    return _documents(spark, sf_dir).select("doc_id", X.year_in(F.col("text"), r"1[89]\d{2}|20\d{2}|21\d{2}").alias("year"))


def iso_times(spark, sf_dir):
    """Times as feeds write them."""
    return table(spark, sf_dir, "documents").select("doc_id", X.iso_time(F.col("added_at")).alias("added"))


def lenient_numbers(spark, sf_dir):
    """Leading whole numbers of hashes, 0 where there is none."""
    return table(spark, sf_dir, "library_items").select("id", X.lenient_int(F.col("content_hash")).alias("n"))


def erratum_targets(spark, sf_dir):
    """Titles that errata name, from titles dressed as errata."""
    title = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Correction to: "), F.col("title"))).otherwise(F.col("title"))
    return table(spark, sf_dir, "library_items").select("id", X.erratum_target(title).alias("named")).where("named is not null")


def embedding_texts(spark, sf_dir):
    """The texts that items are embedded from."""
    return table(spark, sf_dir, "library_items").select("id", F.md5(X.embedding_text(F.col("title"), F.col("abstract"))).alias("hash"))


def term_counts(spark, sf_dir):
    """Index terms of documents, with their documents and occurrences."""
    words = _documents(spark, sf_dir).select("doc_id", F.explode(X.tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("n"))


def strip_tags(spark, sf_dir):
    """Abstracts dressed as JATS, and plain again."""
    dressed = F.concat(F.lit("<jats:title>Abstract</jats:title><jats:p>"), F.col("abstract"), F.lit("</jats:p>"))
    return table(spark, sf_dir, "library_items").where("abstract is not null").select("id", X.strip_tags(dressed).alias("abstract"))


def chunk_documents(spark, sf_dir):
    """Documents in chunks of whole sentences."""
    return P.chunk_documents(_documents(spark, sf_dir), "doc_id")


def chunk_item_pages(spark, sf_dir):
    """Items chunked anew from their pages."""
    pages = table(spark, sf_dir, "chunks").where("page is not null").select("item_id", "chunk_index", "text").distinct()
    return P.chunk_items(pages, "item_id", "chunk_index")


def html_to_text(spark, sf_dir):
    """Documents dressed as HTML pages, and plain again."""
    page = F.concat(F.lit("<html><head><title>x</title></head><body><h1>"), "doc_type", F.lit("</h1><p>"), F.col("text"), F.lit("</p></body></html>"))
    return _documents(spark, sf_dir).select("doc_id", P.html_to_text(page).alias("text"))


def tei_sections(spark, sf_dir):
    """Items dressed as TEI documents, read into sections."""
    escape = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    items = table(spark, sf_dir, "library_items").where("abstract is not null")
    xml = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), escape("title"), F.lit("</title></titleStmt></fileDesc></teiHeader><text><body><div><head n=\"1.\">Introduction</head><p>"),
        escape("abstract"), F.lit("</p></div><div><head n=\"2.1\">Methods</head><p>First.</p><p>Second.</p></div></body></text></TEI>"),
    )
    parsed = items.select("id", P.tei(xml).alias("t"))
    return parsed.where(P.is_tei(F.col("t"))).select("id", F.posexplode("t.sections").alias("no", "s")).select("id", "no", "s.level", "s.heading", "s.text", X.section(F.col("s.heading")).alias("label"))


QUERIES = {
    f.__name__: f
    for f in (
        identify_doi, identify_arxiv, identify_isbn, isbn_checksum, section_classify, author_key, orcid_extract, display_names, doi_normalised, urn_precedence, cas_paths, bibtex,
        highlight, year_extract, iso_times, lenient_numbers, erratum_targets, embedding_texts, term_counts, strip_tags, chunk_documents, chunk_item_pages, html_to_text, tei_sections,
    )
}

_DOC = "documents WHERE text IS NOT NULL"
_DIGIT = "CASE substr({p}, {k}, 1) WHEN 'X' THEN 10 ELSE coalesce(try_cast(substr({p}, {k}, 1) AS INTEGER), 0) END"
_SUM10 = " + ".join(f"{11 - k} * ({_DIGIT.format(p='p', k=k)})" for k in range(1, 11))
_SUM13 = lambda p, n: " + ".join(f"{1 if k % 2 else 3} * ({_DIGIT.format(p=p, k=k)})" for k in range(1, n + 1))
_V10 = f"(regexp_matches(p, '^[0-9]{{9}}[0-9X]$') AND ({_SUM10}) % 11 = 0)"
_V13 = f"(regexp_matches(p, '^[0-9]{{13}}$') AND ({_SUM13('p', 13)}) % 10 = 0)"
_BODY = "('978' || substr(p, 1, 9))"
_TO13 = f"CASE WHEN {_V13} THEN p WHEN {_V10} THEN {_BODY} || CAST((10 - ({_SUM13(_BODY, 12)}) % 10) % 10 AS VARCHAR) END"
_SECTION = """CASE WHEN contains(h, 'introduction') OR contains(h, 'background') OR contains(h, 'related work') THEN 'introduction'
  WHEN contains(h, 'method') OR contains(h, 'experimental') OR contains(h, 'materials') THEN 'methods'
  WHEN contains(h, 'result') OR contains(h, 'finding') THEN 'results' WHEN contains(h, 'discussion') THEN 'discussion'
  WHEN contains(h, 'conclusion') OR contains(h, 'summary') THEN 'conclusion' ELSE 'other' END"""
_NAME = "CASE WHEN trim(coalesce(given_name, ''), ' ') <> '' THEN given_name || ' ' || family_name ELSE family_name END"
_MARK = lambda c: f"regexp_replace(replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;'), '(handbook|layer|of)', '<mark>\\1</mark>', 'gi')"
_ESC = lambda c: f"regexp_replace({c}, '([&%#_$])', '\\\\\\1', 'g')"
_BIB = """CASE item_type WHEN 'paper' THEN 'article' WHEN 'preprint' THEN 'article' WHEN 'book' THEN 'book' WHEN 'chapter' THEN 'incollection'
  WHEN 'report' THEN 'techreport' WHEN 'thesis' THEN 'phdthesis' ELSE 'misc' END"""
_LINE = lambda name, c: f"'  {name} = {{' || {_ESC(c)} || '}}'"

SQL = {
    "identify_doi": f"SELECT DISTINCT doc_id, regexp_replace(d, '[.,;:)\\]]+$', '') AS doi FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b(10\\.[0-9]{{4,9}}/[^\\s\"<>{{}}|\\\\^`\\[\\]]+)', 1)) AS d FROM {_DOC})",
    "identify_arxiv": " UNION ".join(
        f"SELECT doc_id, unnest(regexp_extract_all(text, '(?i){form}', 1)) AS arxiv_id FROM {_DOC}"
        for form in ("arxiv\\.org/abs/([0-9]{4}\\.[0-9]{4,5})", "arxiv\\.org/abs/([a-z-]+(?:\\.[A-Z]{2})?/[0-9]{7})", "arxiv[:\\s]*?([0-9]{4}\\.[0-9]{4,5})", "arxiv[:\\s]*?([a-z-]+(?:\\.[A-Z]{2})?/[0-9]{7})")
    ),
    "identify_isbn": f"""SELECT DISTINCT doc_id, isbn FROM (SELECT doc_id, {_TO13} AS isbn FROM (SELECT doc_id, regexp_replace(upper(d), '[-\\s]', '', 'g') AS p
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)ISBN(?:-1[03])?[:\\s]*([0-9][0-9\\-\\sXx]{{8,20}}[0-9Xx])', 1)) AS d FROM {_DOC}))) WHERE isbn IS NOT NULL""",
    "isbn_checksum": f"SELECT id, isbn, {_V13} OR {_V10} AS valid, {_TO13} AS isbn13 FROM (SELECT id, isbn, upper(regexp_replace(isbn, '[-\\s]', '', 'g')) AS p FROM library_items WHERE isbn IS NOT NULL)",
    "section_classify": f"SELECT DISTINCT chunk_id, {_SECTION} AS label FROM (SELECT chunk_id, regexp_replace(lower(trim(regexp_extract(text, '^([^\\n]*)', 1), ' ')), '^(?:[ivxlcdm]+\\.?\\s+|[0-9]+(?:\\.[0-9]+)*\\.?\\s+)', '') AS h FROM chunks WHERE text IS NOT NULL)",
    "author_key": """SELECT author_id, CASE WHEN coalesce(family_name, '') = '' THEN ',' ELSE regexp_replace(regexp_replace(lower(trim(strip_accents(family_name), ' ')), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g')
  || ',' || lower(substr(trim(strip_accents(coalesce(given_name, '')), ' '), 1, 1)) END AS key FROM authors""",
    "orcid_extract": "SELECT author_id, nullif(regexp_extract(orcid, '([0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X])', 1), '') AS orcid FROM authors",
    "display_names": f"SELECT author_id, n AS name, regexp_extract(trim(n, ' '), '(\\S+)\\s*$', 1) AS last_word FROM (SELECT author_id, {_NAME} AS n FROM authors)",
    "doi_normalised": "SELECT DISTINCT candidate_id, lower(regexp_replace(trim(doi, ' '), '(?i)^(?:https?://(?:dx\\.)?doi\\.org/|doi:\\s*|doi\\s+)', '')) AS doi FROM metadata_candidates",
    "urn_precedence": "SELECT id, CASE WHEN trim(doi) <> '' THEN 'urn:doi:' || doi WHEN trim(arxiv_id) <> '' THEN 'urn:arxiv:' || arxiv_id WHEN trim(isbn) <> '' THEN 'urn:isbn:' || isbn WHEN trim(content_hash) <> '' THEN 'urn:sha256:' || content_hash ELSE 'urn:item:' || id END AS urn FROM library_items",
    "cas_paths": f"SELECT doc_id, substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h AS path FROM (SELECT doc_id, sha256(text) AS h FROM {_DOC})",
    "bibtex": f"""WITH p AS (SELECT item_id AS id, list(family_name ORDER BY position, author_id) AS authors FROM (SELECT DISTINCT item_id, author_id, position FROM item_authors) JOIN authors USING (author_id) GROUP BY 1),
r AS (SELECT i.*, coalesce(authors, []) AS authors, {_BIB} AS kind,
  list_filter(regexp_extract_all(strip_accents(title), '[A-Za-z0-9]+'), lambda w: length(w) > 2 AND lower(w) NOT IN ('the', 'and', 'for', 'from', 'with', 'into')) AS words FROM library_items i LEFT JOIN p USING (id))
SELECT id, '@' || kind || chr(123) || coalesce(nullif(concat_ws('_', lower(strip_accents(authors[1])), CAST(publication_year AS VARCHAR), substr(lower(words[1]), 1, 12)), ''), 'ref') || ',' || chr(10)
  || concat_ws(',' || chr(10), {_LINE('title', "nullif(title, '')")}, CASE WHEN len(authors) > 0 THEN {_LINE('author', "list_aggregate(authors, 'string_agg', ' and ')")} END, {_LINE('year', 'CAST(publication_year AS VARCHAR)')},
  CASE WHEN venue <> '' THEN CASE WHEN kind = 'incollection' THEN {_LINE('booktitle', 'venue')} ELSE {_LINE('journal', 'venue')} END END, CASE WHEN doi <> '' THEN {_LINE('doi', 'doi')} END, CASE WHEN isbn <> '' THEN {_LINE('isbn', 'isbn')} END,
  CASE WHEN arxiv_id <> '' THEN {_LINE('eprint', 'arxiv_id')} || ',' || chr(10) || '  archivePrefix = ' || chr(123) || 'arXiv' || chr(125) END,
  CASE WHEN language <> 'en' AND language <> '' THEN {_LINE('language', 'language')} END) || chr(10) || chr(125) AS entry FROM r""",
    "highlight": f"SELECT id, {_MARK('title')} AS html FROM library_items",
    "year_extract": f"SELECT doc_id, try_cast(nullif(regexp_extract(text, '\\b(1[89][0-9]{{2}}|20[0-9]{{2}}|21[0-9]{{2}})\\b', 1), '') AS INTEGER) AS year FROM {_DOC}",
    "iso_times": "SELECT doc_id, strftime(timezone('UTC', CAST(added_at AS TIMESTAMPTZ)), '%Y-%m-%dT%H:%M:%SZ') AS added FROM documents",
    "lenient_numbers": "SELECT id, CASE WHEN content_hash IS NOT NULL THEN coalesce(try_cast(nullif(regexp_extract(content_hash, '^\\s*([+-]?[0-9]{1,18})', 1), '') AS BIGINT), 0) END AS n FROM library_items",
    "erratum_targets": "SELECT id, trim(title, '\"''. ') AS named FROM library_items WHERE id % 2 = 0 AND length(trim(title, '\"''. ')) >= 15",
    "embedding_texts": "SELECT id, md5(coalesce(title, '') || ' [SEP] ' || CASE WHEN trim(coalesce(abstract, ''), ' ') <> '' THEN abstract ELSE '' END) AS hash FROM library_items",
    "term_counts": f"SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {_DOC}) GROUP BY 1",
    "tei_sections": """SELECT id, no, level, heading, text, label FROM (SELECT id, trim(regexp_replace(abstract, '\\s+', ' ', 'g'), ' ') AS a FROM library_items WHERE abstract IS NOT NULL),
  LATERAL (SELECT * FROM (VALUES (0, 1, 'Introduction', a, 'introduction'), (1, 2, 'Methods', 'First.' || chr(10) || chr(10) || 'Second.', 'methods')) AS v(no, level, heading, text, label))""",
    "strip_tags": "SELECT id, trim(regexp_replace(abstract, '<[^>]+>', '', 'g'), ' ') AS abstract FROM library_items WHERE abstract IS NOT NULL",
}
