"""Text functions as column expressions: everything here stays in the JVM.

Functions take columns and give columns; null in gives null out unless the docstring says otherwise.
"""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Accented letters of the Latin, Greek and Cyrillic blocks with their plain letters, by Unicode's decompositions."""
    accented, plain = [], []
    for point in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(point))
        rest = [c for c in parts if not unicodedata.combining(c)]
        if len(parts) > 1 and len(rest) == 1:
            accented.append(chr(point))
            plain.append(rest[0])
    return "".join(accented), "".join(plain)


_ACCENTS = _accent_table()


def strip_accents(text: Column) -> Column:
    """Letters without their accents, composed or as combining marks."""
    return F.when(F.regexp_like(text, F.lit(_ODD)), F.translate(F.regexp_replace(text, r"\p{M}", ""), *_ACCENTS)).otherwise(text)


def _compatible_table() -> tuple[str, str, dict[str, str]]:
    """Characters by Unicode's compatibility decompositions without marks: those of one letter, and those of several."""
    single, plain, several = [], [], {}
    for point in (*range(0xA0, 0x3000), *range(0x3200, 0x3400), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF)):
        rest = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if rest == chr(point) or not rest:
            continue
        if len(rest) == 1:
            single.append(chr(point))
            plain.append(rest)
        else:
            several[chr(point)] = rest
    return "".join(single), "".join(plain), several


def _ranges(characters: str) -> str:
    """The characters as a class of a pattern, neighbours as ranges."""
    out: list[list[int]] = []
    for point in sorted(map(ord, characters)):
        if out and out[-1][1] == point - 1:
            out[-1][1] = point
        else:
            out.append([point, point])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out) + "]"


_SINGLE, _PLAIN, _SEVERAL = _compatible_table()
#: Whether a text holds any character that is not plain, and any that stands for several.
_ODD, _LONGER = r"[^\x00-\x7f]", _ranges("".join(_SEVERAL))


def asciify(text: Column) -> Column:
    """Letters without accents, and compatibility characters (ligatures, wide forms, small figures) as what they stand for."""
    longer = F.from_json(F.lit(json.dumps(_SEVERAL)), "map<string,string>")
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(longer[c], c)), "")
    folded = F.translate(F.regexp_replace(F.when(F.regexp_like(text, F.lit(_LONGER)), spelled).otherwise(text), r"\p{M}", ""), _SINGLE, _PLAIN)
    return F.when(F.regexp_like(text, F.lit(_ODD)), folded).otherwise(text)


def tokens(text: Column) -> Column:
    """Index terms: lower case, no accents, runs of letters and digits."""
    return F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def collapse(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def nonblank(text: Column) -> Column:
    """The text, null where it is blank."""
    return F.when(F.trim(text) != "", text)


# --- identifiers ------------------------------------------------------------------------------------------

#: Forms of identifiers: DOI, arXiv by address and by label, new and old, ISBN after its label (fixed values).
_DOI = r"(?i)\b(10\.\d{4,9}/[^\s\"<>{}|\\^`\[\]]+)"
_ARXIV = (
    r"(?i)arxiv\.org/abs/(\d{4}\.\d{4,5})",
    r"(?i)arxiv\.org/abs/([a-z\-]+(?:\.[A-Z]{2})?/\d{7})",
    r"(?i)arxiv[:\s]*?(\d{4}\.\d{4,5})",
    r"(?i)arxiv[:\s]*?([a-z\-]+(?:\.[A-Z]{2})?/\d{7})",
)
_ISBN = r"(?i)ISBN(?:-1[03])?[:\s]*([0-9][\d\-\sXx]{8,20}[0-9Xx])"


def dois(text: Column) -> Column:
    """DOIs in order of first occurrence, closing punctuation dropped."""
    found = F.regexp_extract_all(text, F.lit(_DOI), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:)\]]+$", "")))


def arxiv_ids(text: Column) -> Column:
    """arXiv ids, addresses before labels and new ids before old ones, without versions."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in _ARXIV])))


def _digit(code: Column, k: Column) -> Column:
    c = F.substring(code, k, F.lit(1))
    return F.when(c == "X", 10).otherwise(c.try_cast("int"))


def isbn10_valid(code: Column) -> Column:
    """Whether ten characters satisfy the weights 10..1 modulo 11."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0), lambda a, k: a + (11 - k) * F.coalesce(_digit(code, k), F.lit(0)))
    return F.regexp_like(code, F.lit(r"^\d{9}[\dX]$")) & (total % 11 == 0)


def isbn13_valid(code: Column) -> Column:
    """Whether thirteen digits satisfy the weights 1, 3 modulo 10."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda a, k: a + F.when(k % 2 == 1, 1).otherwise(3) * F.coalesce(_digit(code, k), F.lit(0)))
    return F.regexp_like(code, F.lit(r"^\d{13}$")) & (total % 10 == 0)


def isbn13(code: Column) -> Column:
    """The ISBN-13 of an ISBN however dashed; null where the check digit is wrong."""
    plain = F.upper(F.regexp_replace(code, r"[-\s]", ""))
    body = F.concat(F.lit("978"), F.substring(plain, 1, 9))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, k: a + F.when(k % 2 == 1, 1).otherwise(3) * F.coalesce(_digit(body, k), F.lit(0)))
    check = ((10 - total % 10) % 10).cast("string")
    return F.when(isbn13_valid(plain), plain).when(isbn10_valid(plain), F.concat(body, check))


def isbns(text: Column) -> Column:
    """Valid ISBNs after the word ISBN, as ISBN-13."""
    found = F.regexp_extract_all(text, F.lit(_ISBN), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, isbn13), lambda x: x.isNotNull()))


def identifiers(text: Column) -> Column:
    """struct<dois, arxiv_ids, isbns>."""
    return F.struct(dois(text).alias("dois"), arxiv_ids(text).alias("arxiv_ids"), isbns(text).alias("isbns"))


def plain_doi(doi: Column) -> Column:
    """Lower case, without address or label."""
    return F.lower(F.regexp_replace(F.trim(doi), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*|doi\s+)", ""))


def orcid(text: Column) -> Column:
    """The ORCID in an address; null where there is none."""
    return F.nullif(F.regexp_extract(text, r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])", 1), F.lit(""))


def author_key(family: Column, given: Column) -> Column:
    """``family,initial`` without accents: the blocking key of author rows; ``,`` where there is no family name."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(asciify(family))), r"\s+", "-"), r"[^a-z0-9-]", "")
    initial = F.lower(F.substring(F.trim(asciify(F.coalesce(given, F.lit("")))), 1, 1))
    return F.when(F.coalesce(family, F.lit("")) == "", ",").otherwise(F.concat(name, F.lit(","), initial))


def urn(doi: Column, arxiv_id: Column, isbn: Column, content_hash: Column, item_id: Column) -> Column:
    """The most telling identifier: doi, arXiv, isbn, hash, else the row's id."""
    named = [F.concat(F.lit(prefix), nonblank(x)) for prefix, x in (("urn:doi:", doi), ("urn:arxiv:", arxiv_id), ("urn:isbn:", isbn), ("urn:sha256:", content_hash))]
    return F.coalesce(*named, F.concat(F.lit("urn:item:"), item_id.cast("string")))


# --- titles, names, markup --------------------------------------------------------------------------------


def display_name(family: Column, given: Column) -> Column:
    """``given family``; the family name alone where there is no given one."""
    return F.concat_ws(" ", nonblank(given), family)


def split_name(name: Column) -> Column:
    """struct<family, given> of "First Last": the last word is the family name."""
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda x: x != "")
    n = F.size(parts)
    given = F.when(n > 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), " "))
    return F.struct(F.when(n > 0, F.element_at(parts, -1)).alias("family"), given.alias("given"))


def strip_tags(text: Column) -> Column:
    """Text of JATS or HTML: title blocks dropped, then tags."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<jats:title>.*?</jats:title>", ""), r"<[^>]+>", ""))


def erratum_target(title: Column) -> Column:
    """The title that an erratum, correction or corrigendum names; null for other titles and short targets."""
    head = r"(?i)^\s*(?:erratum|correction|corrigendum)(?:\s+to)?\s*:?\s*"
    rest = F.regexp_replace(F.trim(F.regexp_replace(title, head, "")), r"^[\"'“”‘’.\s]+|[\"'“”‘’.\s]+$", "")
    return F.when(F.regexp_like(title, F.lit(head)) & (F.length(rest) >= 15), rest)


def edition_number(edition: Column) -> Column:
    """The first run of digits of an edition, as a number."""
    return F.nullif(F.regexp_extract(edition, r"(\d+)", 1), F.lit("")).try_cast("int")


def lenient_int(text: Column) -> Column:
    """The leading whole number of a text, 0 where it has none; null for null."""
    return F.when(text.isNotNull(), F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d{1,18})", 1), F.lit("")).try_cast("long"), F.lit(0)))


def embedding_text(title: Column, abstract: Column, body: Column | None = None) -> Column:
    """What is embedded of an item: title and abstract, else the first 500 words of the body."""
    rest = nonblank(abstract)
    if body is not None:
        rest = F.coalesce(rest, F.array_join(F.slice(F.split(F.trim(body), r"\s+"), 1, 500), " "))
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" [SEP] "), F.coalesce(rest, F.lit("")))


def query_phrases(query: str, unicode: bool = False) -> list[list[str]]:
    """The phrases of a keyword query: words with hyphens are phrases; by default letters beyond ASCII part words."""
    import re

    word = r"[^\W_]+(?:-[^\W_]+)*" if unicode else r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    return [fold(w).split("-") for w in re.findall(word, query)]


def highlight(text: Column, query: str) -> Column:
    """HTML-escaped text with ``<mark>`` around every word of the query."""
    import re

    escaped = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(safe))
    words = sorted(set(re.findall(r"\w+", query)), key=lambda w: (-len(w), w))
    return F.regexp_replace(escaped, f"(?i)({'|'.join(words)})", "<mark>$1</mark>") if words else escaped


#: Words in headings and the section each stands for, tried in this order (fixed values).
SECTION_WORDS = (
    ("introduction", "introduction"), ("background", "introduction"), ("related work", "introduction"), ("method", "methods"), ("methodolog", "methods"), ("experimental", "methods"),
    ("materials", "methods"), ("result", "results"), ("finding", "results"), ("discussion", "discussion"), ("conclusion", "conclusion"), ("summary", "conclusion"),
)


def section(heading: Column) -> Column:
    """The kind of section a heading opens, numbering aside; ``other`` for null and unknown headings."""
    plain = F.regexp_replace(F.lower(F.trim(heading)), r"^(?:[ivxlcdm]+\.?\s+|\d+(?:\.\d+)*\.?\s+)", "")
    out = F.lit("other")
    for word, label in reversed(SECTION_WORDS):
        out = F.when(plain.contains(word), label).otherwise(out)
    return out


def letter_profile(text: Column) -> Column:
    """How often each letter a to z stands in a text: a vector of 26 numbers that needs no model."""
    low = F.lower(text)
    return F.array(*[F.regexp_count(low, F.lit(c)).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])


# --- dates, types, paths ----------------------------------------------------------------------------------


def iso_time(ts: Column) -> Column:
    """UTC time as feeds write it."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def year_in(text: Column, first: str = r"1[5-9]\d{2}|20\d{2}|21\d{2}") -> Column:
    """The first year written in a text."""
    return F.nullif(F.regexp_extract(text, rf"\b({first})\b", 1), F.lit("")).try_cast("int")


def cas_path(content_hash: Column) -> Column:
    """Where the content-addressed store keeps a hash."""
    return F.concat_ws("/", F.substring(content_hash, 1, 2), F.substring(content_hash, 3, 2), content_hash)


def mime(path: Column) -> Column:
    """Media type by the ending of a path."""
    low = F.lower(path)
    kinds = (("pdf", "application/pdf"), ("epub", "application/epub+zip"), ("xml", "application/xml"), ("html", "text/html"), ("txt", "text/plain"), ("md", "text/markdown"))
    out = F.lit("application/octet-stream")
    for ending, kind in kinds:
        out = F.when(low.endswith("." + ending), kind).otherwise(out)
    return out


def sniff(content: Column) -> Column:
    """pdf or epub by the first bytes; null for others."""
    return F.when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "pdf").when(F.substring(content, 1, 2) == F.lit(b"PK"), "epub")


#: BibTeX entry types by item type, words that make no key, characters that are escaped (fixed values).
BIBTEX_TYPES = {"paper": "article", "preprint": "article", "book": "book", "chapter": "incollection", "report": "techreport", "thesis": "phdthesis", "standard": "misc", "patent": "misc", "other": "misc"}
BIBTEX_STOP = ("the", "and", "for", "from", "with", "into")
BIBTEX_ESCAPED = "&%#_$"


def bibtex_key(family: Column, year: Column, title: Column) -> Column:
    """``author_year_word``: first author, year, first telling word of the title, each where there is one; else ``ref``."""
    words = F.filter(F.regexp_extract_all(asciify(title), F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*BIBTEX_STOP))
    parts = F.concat_ws("_", F.lower(asciify(family)), year.cast("string"), F.substring(F.lower(F.get(words, F.lit(0))), 1, 12))
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("ref"))


def bibtex_escape(text: Column) -> Column:
    return F.regexp_replace(text, f"([{BIBTEX_ESCAPED}])", r"\\$1")


def bibtex(row: dict[str, Column]) -> Column:
    """A BibTeX entry of an item's columns; what is null, empty or missing gives no field.

    Columns: item_type, title, authors (array of family names in order), year, venue, volume, issue, pages, doi, isbn,
    arxiv_id, edition, series, language (left out for English).
    """
    kinds = F.create_map(*[F.lit(x) for pair in BIBTEX_TYPES.items() for x in pair])
    kind = F.coalesce(kinds[row["item_type"]], F.lit("misc"))
    given = lambda name: F.nullif(row.get(name, F.lit(None)).cast("string"), F.lit(""))

    def line(name: str, value: Column) -> Column:
        own = bibtex_escape(value)
        return F.when(own.startswith("{"), F.concat(F.lit(f"  {name} = "), own)).otherwise(F.concat(F.lit(f"  {name} = {{"), own, F.lit("}")))

    fields = F.concat_ws(
        ",\n",
        F.concat(F.lit("  title = {"), bibtex_escape(given("title")), F.lit("}")),
        F.when(F.size(row["authors"]) > 0, line("author", F.array_join(row["authors"], " and "))),
        line("year", given("year")),
        F.when(kind.isin("incollection", "inproceedings"), line("booktitle", given("venue"))).otherwise(line("journal", given("venue"))),
        *[line(name, given(column)) for name, column in (("volume", "volume"), ("number", "issue"), ("pages", "pages"), ("doi", "doi"), ("isbn", "isbn"), ("eprint", "arxiv_id"))],
        F.when(given("arxiv_id").isNotNull(), F.lit("  archivePrefix = {arXiv}")),
        *[line(name, given(name)) for name in ("edition", "series")],
        F.when(row["language"] != "en", line("language", given("language"))),
    )
    return F.concat(F.lit("@"), kind, F.lit("{"), bibtex_key(F.get(row["authors"], F.lit(0)), row["year"], row["title"]), F.lit(",\n"), fields, F.lit("\n}"))
