"""Records of public registries, as JSON texts, read into one shape of metadata; all in the JVM.

Fetching is left to the caller: give a table of cached answers (key, json), or a function for ``fetched``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonblank, orcid, split_name, strip_tags, year_in

#: Types of a DOI registry and the item types they become (fixed values).
TYPES = {
    "journal-article": "paper", "proceedings-article": "paper", "posted-content": "preprint", "book": "book", "monograph": "book", "edited-book": "book",
    "book-chapter": "chapter", "dissertation": "thesis", "report": "report", "standard": "standard",
}

COLUMNS = ("item_type", "title", "abstract", "publication_year", "doi", "arxiv_id", "isbn", "venue", "volume", "issue", "pages", "edition", "authors", "linked_doi", "source", "confidence")
_AUTHOR = "struct<family:string,given:string,orcid:string>"


def _shape(rows: DataFrame, key: str, source: str, confidence: float, **columns: Column) -> DataFrame:
    kinds = {"publication_year": "int", "authors": f"array<{_AUTHOR}>"}
    columns |= {"source": F.lit(source), "confidence": F.lit(confidence)}
    return rows.select(key, *[columns.get(c, F.lit(None)).cast(kinds.get(c, "double" if c == "confidence" else "string")).alias(c) for c in COLUMNS])


def _first(json: Column, path: str) -> Column:
    return nonblank(F.coalesce(F.get_json_object(json, f"$.{path}[0]"), F.get_json_object(json, f"$.{path}")))


def doi_records(answers: DataFrame, key: str = "key", json: str = "json") -> DataFrame:
    """Answers of a DOI registry: the work, or a message that holds it."""
    j = F.coalesce(F.get_json_object(json, "$.message"), F.col(json))
    people = F.from_json(F.get_json_object(j, "$.author"), "array<struct<family:string,given:string,name:string,ORCID:string>>")
    authors = F.filter(F.transform(people, lambda a: F.struct(F.coalesce(a["family"], a["name"]).alias("family"), a["given"].alias("given"), orcid(a["ORCID"]).alias("orcid"))), lambda a: a["family"].isNotNull())
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    edition = F.coalesce(*[nonblank(F.get_json_object(j, f"$.{n}")) for n in ("edition-number", "edition_number", "edition")])
    return _shape(
        answers, key, "crossref", 1.0,
        item_type=F.coalesce(kinds[F.get_json_object(j, "$.type")], F.lit("paper")), title=_first(j, "title"), abstract=nonblank(strip_tags(F.get_json_object(j, "$.abstract"))),
        publication_year=F.get_json_object(j, "$.issued.date-parts[0][0]").try_cast("int"), doi=F.lower(F.get_json_object(j, "$.DOI")), isbn=_first(j, "ISBN"), venue=_first(j, "container-title"),
        volume=F.get_json_object(j, "$.volume"), issue=F.get_json_object(j, "$.issue"), pages=F.get_json_object(j, "$.page"), edition=edition, authors=F.coalesce(authors, F.array().cast(f"array<{_AUTHOR}>")),
    )


def arxiv_records(answers: DataFrame, key: str = "key", json: str = "json") -> DataFrame:
    """Records of arXiv: title, summary, published, authors (names), doi of the published version."""
    j = F.col(json)
    names = F.from_json(F.get_json_object(j, "$.authors"), "array<string>")
    authors = F.transform(names, lambda n: F.struct(split_name(n)["family"].alias("family"), split_name(n)["given"].alias("given"), F.lit(None).cast("string").alias("orcid")))
    return _shape(
        answers, key, "arxiv", 0.95,
        item_type=F.lit("preprint"), title=nonblank(F.get_json_object(j, "$.title")), abstract=nonblank(F.get_json_object(j, "$.summary")), publication_year=year_in(F.get_json_object(j, "$.published")),
        arxiv_id=F.regexp_replace(F.get_json_object(j, "$.id"), r"(?i)^.*/abs/|v\d+$", ""), venue=nonblank(F.get_json_object(j, "$.journal_ref")), authors=authors, linked_doi=F.lower(F.get_json_object(j, "$.doi")),
    )


def isbn_records(answers: DataFrame, key: str = "key", json: str = "json") -> DataFrame:
    """Records of a book service: title, publish_date, publishers and authors, as texts or as objects with a name."""
    j = F.col(json)
    names = F.coalesce(F.transform(F.from_json(F.get_json_object(j, "$.authors"), "array<struct<name:string>>"), lambda a: a["name"]), F.from_json(F.get_json_object(j, "$.authors"), "array<string>"))
    authors = F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.struct(split_name(n)["family"].alias("family"), split_name(n)["given"].alias("given"), F.lit(None).cast("string").alias("orcid")))
    publisher = F.coalesce(nonblank(F.get_json_object(j, "$.publishers[0].name")), _first(j, "publishers"))
    return _shape(
        answers, key, "openlibrary", 0.8,
        item_type=F.lit("book"), title=nonblank(F.get_json_object(j, "$.title")), publication_year=year_in(F.get_json_object(j, "$.publish_date")), isbn=F.col(key), venue=publisher, edition=nonblank(F.get_json_object(j, "$.edition_name")), authors=authors,
    )


def prose_records(answers: DataFrame, key: str = "key", text: str = "json") -> DataFrame:
    """The first JSON object in a model's prose: title, year, doi, venue, authors (names)."""
    j = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    names = F.from_json(F.get_json_object(j, "$.authors"), "array<string>")
    authors = F.transform(names, lambda n: F.struct(split_name(n)["family"].alias("family"), split_name(n)["given"].alias("given"), F.lit(None).cast("string").alias("orcid")))
    out = _shape(
        answers, key, "llm", 0.5,
        item_type=F.lit("paper"), title=nonblank(F.get_json_object(j, "$.title")), publication_year=year_in(F.get_json_object(j, "$.year")), doi=F.lower(nonblank(F.get_json_object(j, "$.doi"))), venue=nonblank(F.get_json_object(j, "$.venue")), authors=authors,
    )
    return out.where("title is not null")


def header_records(parsed: DataFrame, key: str = "key", tei: str = "tei") -> DataFrame:
    """Parsed headers of a header service (``functions.pyfuncs.tei``); rows without title, abstract, DOI and authors are left out."""
    h = F.col(tei)["header"]
    authors = F.transform(h["authors"], lambda a: F.struct(a["family"].alias("family"), a["given"].alias("given"), F.lit(None).cast("string").alias("orcid")))
    out = _shape(parsed, key, "grobid", 0.85, item_type=F.lit("paper"), title=h["title"], abstract=h["abstract"], publication_year=F.coalesce(h["imprint_year"], h["year"]), doi=F.lower(F.coalesce(h["doi"], h["doi_in_text"])), venue=h["venue"], authors=authors)
    return out.where("title is not null or abstract is not null or doi is not null or size(authors) > 0")


def fetched(keys: DataFrame, fetch: Callable[[str], str | None], at_once: int = 4, key: str = "key") -> DataFrame:
    """(key, json) by a function of the caller's, with at most ``at_once`` tasks calling at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({key: part[key], "json": [fetch(k) for k in part[key]]})

    return keys.select(key).distinct().repartition(at_once).mapInPandas(run, f"{key} string, json string")


def verdict(answer: Column) -> Column:
    """same, related or different from a judge's answer, as a word or as JSON; null where it says neither."""
    word = F.lower(F.coalesce(F.get_json_object(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), "$.verdict"), F.regexp_extract(answer, r"(?i)\b(same|related|different)\b", 1)))
    return F.when(word.isin("same", "related", "different"), word)


def pair_prompt(a: dict[str, Column], b: dict[str, Column], longest: int = 1200) -> Column:
    """The text a judge is asked about two records: titles, authors and abstracts cut to ``longest`` characters."""
    part = lambda name, r: F.concat(F.lit(f"Record {name}\nTitle: "), F.coalesce(r["title"], F.lit("")), F.lit("\nAuthors: "), F.coalesce(r["authors"], F.lit("")), F.lit("\nAbstract: "), F.substring(F.coalesce(r["abstract"], F.lit("")), 1, longest))
    return F.concat_ws("\n\n", part("A", a), part("B", b))
