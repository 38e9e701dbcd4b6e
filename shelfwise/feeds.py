"""Catalog feeds in Atom: entries are expressions over the rows of a listing, one page of them is joined on the driver."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators import listing as L

#: Namespaces, media types and relations of catalog feeds (fixed values).
ATOM, DUBLIN_CORE = "http://www.w3.org/2005/Atom", "http://purl.org/dc/terms/"
NAVIGATION = "application/atom+xml;profile=opds-catalog;kind=navigation"
ACQUISITION = "application/atom+xml;profile=opds-catalog;kind=acquisition"
OPENSEARCH, DOWNLOAD = "application/opensearchdescription+xml", "http://opds-spec.org/acquisition"


def escaped(text: Column) -> Column:
    """Text as XML holds it, without the control characters that it may not."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _element(name: str, value: Column, attributes: str = "") -> Column:
    """An element, nothing where the value is null or empty."""
    own = F.nullif(value.cast("string"), F.lit(""))
    return F.concat(F.lit(f"<{name}{attributes}>"), escaped(own), F.lit(f"</{name}>"))


def _link(rel: str, href: Column, kind: Column, title: str) -> Column:
    return F.concat(F.lit(f'<link rel="{rel}" href="'), escaped(href), F.lit('" type="'), kind, F.lit(f'" title="{title}"/>'))


def entry(item: dict[str, Column]) -> Column:
    """One item as an entry: id, item_type, title, abstract, year, language, venue, doi, arxiv_id, isbn, content_hash, added_at, path, authors (array of names)."""
    urn = X.urn(item["doi"], item["arxiv_id"], item["isbn"], item["content_hash"], item["id"])
    people = F.array_join(F.transform(item["authors"], lambda n: F.concat(F.lit("<author><name>"), escaped(n), F.lit("</name></author>"))), "")
    kind = item["item_type"]
    category = F.concat(F.lit('<category term="'), escaped(kind), F.lit('" label="'), escaped(F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substr(kind, F.lit(2))))), F.lit('"/>'))
    stored = F.nullif(item["content_hash"], F.lit(""))
    parts = [
        _element("id", urn), _element("title", item["title"]), _element("updated", X.iso_time(item["added_at"])), _element("summary", item["abstract"], ' type="text"'), people,
        _element("dc:issued", item["year"]), _element("dc:language", item["language"]), _element("dc:source", item["venue"]), _element("dc:identifier", urn), category,
        _link(DOWNLOAD, F.concat(F.lit("/files/"), stored), X.mime(F.coalesce(item["path"], F.lit(""))), "Download"), _link("alternate", F.concat(F.lit("/items/"), item["id"].cast("string")), F.lit("text/html"), "Details"),
    ]
    return F.concat(F.lit("<entry>"), F.concat_ws("", *parts), F.lit("</entry>"))


def entries(items: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """(id, entry) of items, with names (item_id, names array) of their authors; columns an item lacks give no element."""
    have = lambda name, kind: F.col(name) if name in items.columns else F.lit(None).cast(kind)
    if authors is not None:
        items = items.join(authors.select(F.col("item_id").alias("id"), F.col("names").alias("__names")), "id", "left")
    names = F.coalesce(F.col("__names"), F.array().cast("array<string>")) if authors is not None else F.array().cast("array<string>")
    columns = {c: have(c, "string") for c in ("item_type", "title", "abstract", "language", "venue", "doi", "arxiv_id", "isbn", "content_hash", "path")}
    return items.select("id", entry(columns | {"id": F.col("id"), "year": have("publication_year", "int"), "added_at": have("added_at", "timestamp"), "authors": names}).alias("entry"))


def _frame(title: str, path: str, updated: str, body: list[str]) -> str:
    head = (
        f'<?xml version="1.0" encoding="UTF-8"?>\n<feed xmlns="{ATOM}" xmlns:dc="{DUBLIN_CORE}"><id>urn:feed:{escape(path)}</id><title>{escape(title)}</title><updated>{updated}</updated>'
        f'<author><name>Shelfwise</name></author><link rel="self" href="{escape(path)}" type="{NAVIGATION}"/><link rel="start" href="/opds" type="{NAVIGATION}"/>'
        f'<link rel="search" href="/opds/opensearch.xml" type="{OPENSEARCH}"/>'
    )
    return head + "".join(body) + "</feed>"


def acquisition(rows: DataFrame, title: str, path: str, updated: str, total: int, offset: int = 0, limit: int = L.PAGE) -> str:
    """A feed of one page of items: ``rows`` (entry, ...) in their order, at most ``limit``."""
    offset, limit = max(offset, 0), min(max(limit, 1), L.LARGEST)
    mark = "&amp;" if "?" in path else "?"
    links = [f'<link rel="{rel}" href="{escape(path)}{mark}offset={at}&amp;limit={limit}" type="{ACQUISITION}"/>' for rel, at in L.page_links(total, offset, limit).items()]
    return _frame(title, path, updated, links + [r.entry for r in rows.select("entry").limit(limit).collect()])


def navigation(rows: list[tuple[str, str, str]], title: str, path: str, updated: str) -> str:
    """A feed of places to go on from: (title, href, summary)."""
    body = [
        f'<entry><id>urn:nav:{escape(href)}</id><title>{escape(name)}</title><updated>{updated}</updated><content type="text">{escape(summary)}</content>'
        f'<link rel="subsection" href="{escape(href)}" type="{ACQUISITION}" title="{escape(name)}"/></entry>'
        for name, href, summary in rows
    ]
    return _frame(title, path, updated, body)
