"""Functions that Spark's expressions cannot state: sentence chunks, markup, embeddings. Arrow batches throughout."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

TARGET, OVERLAP = 400, 40


def chunk_pages(pages: list[tuple[int | None, str]], target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int | None, str]]:
    """(index, page, text) of chunks of whole sentences.

    Sentences fill a chunk until it has ``target`` words; the next chunk begins with the last sentences that hold
    ``overlap`` words. A sentence longer than the target is sliced. A chunk's page is that of its first sentence.
    """
    if target < 1 or not 0 <= overlap < target:
        raise ValueError("target must be positive and overlap between 0 and target - 1")
    units: list[tuple[int | None, list[str]]] = []
    for number, text in pages:
        for sentence in re.split(r"(?<=[.!?])\s+", text or ""):
            own = sentence.split()
            units += [(number, own[k : k + target]) for k in range(0, len(own), target)]
    spans = _spans([len(words) for _, words in units], target, overlap)
    return [(k, units[start][0], " ".join(w for _, words in units[start:end] for w in words)) for k, (start, end) in enumerate(spans)]


def _spans(sizes: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """Where chunks begin and end among sentences of so many words."""
    spans, start = [], 0
    while start < len(sizes):
        end, size = start, 0
        while end < len(sizes) and size < target:
            size += sizes[end]
            end += 1
        spans.append((start, end))
        if end == len(sizes):
            break
        back, shared = end, 0
        while back - 1 > start and shared < overlap:
            back -= 1
            shared += sizes[back]
        start = back
    return spans


_CHUNKS = T.ArrayType(T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())]))


def chunk_documents(docs: DataFrame, id_col: str, text_col: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, chunk_index, page, text) of texts without pages; null and blank texts have no chunks."""

    @F.pandas_udf(_CHUNKS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_pages([(None, t)], target, overlap) if t else [])

    return docs.select(id_col, F.explode(cut(text_col)).alias("c")).select(id_col, "c.chunk_index", "c.page", "c.text")


_PLACES = T.ArrayType(T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("part", T.LongType())] + [T.StructField(n, T.IntegerType()) for n in ("start", "end")]))


def chunk_items(pages: DataFrame, id_col: str, page_col: str = "page", text_col: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, chunk_index, page, text) of items whose pages are rows; chunks may span pages.

    The texts of an item never meet in one task: only the sentence lengths of its pages do, from which the chunks'
    borders follow; each page then gives the sentences it has in each chunk, and the parts of a chunk are joined.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def sentences(texts: pd.Series) -> pd.Series:
        def one(text: str) -> list[str]:
            own = [x.split() for x in re.split(r"(?<=[.!?])\s+", text)]
            return [" ".join(w[k : k + target]) for w in own for k in range(0, len(w), target)]

        return texts.map(one)

    @F.pandas_udf(_PLACES)
    def places(parts: pd.Series) -> pd.Series:
        def one(rows) -> list[tuple[int, int, int, int, int]]:
            part = [(r["part"], k, n) for r in rows for k, n in enumerate(r["sizes"])]
            out = []
            for number, (start, end) in enumerate(_spans([n for _, _, n in part], target, overlap)):
                at = start
                while at < end:
                    to = at
                    while to < end and part[to][0] == part[at][0]:
                        to += 1
                    out.append((number, at, part[at][0], part[at][1], part[to - 1][1] + 1))
                    at = to
            return out

        return parts.map(one)

    rows = pages.where(F.col(text_col).isNotNull()).select(id_col, F.col(page_col).alias("page"), sentences(text_col).alias("s")).where(F.size("s") > 0)
    rows, _ = cut(rows.withColumn("part", F.monotonically_increasing_id()), "sentences")
    sizes = F.transform("s", lambda x: F.size(F.split(x, " ")))
    # pages in order, rows of one page by how they begin
    lengths = F.struct("page", F.substring(F.col("s")[0], 1, 100).alias("begins"), "part", sizes.alias("sizes"))
    borders = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(lengths)).alias("p")).select(id_col, F.explode(places("p")).alias("b")).select(id_col, "b.*")
    each = borders.join(rows, [id_col, "part"]).select(id_col, "chunk_index", "place", "page", F.array_join(F.slice("s", F.col("start") + 1, F.col("end") - F.col("start")), " ").alias("t"))
    parts = F.array_sort(F.collect_list(F.struct("place", "page", "t")))
    return each.groupBy(id_col, "chunk_index").agg(parts.alias("p")).select(id_col, "chunk_index", F.col("p")[0]["page"].alias("page"), F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))


# --- markup -----------------------------------------------------------------------------------------------


class _Text(HTMLParser):
    SKIP = ("script", "style", "head", "title")
    BREAK = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.SKIP
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in self.SKIP and self.hidden > 0
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_text(html: str | None) -> str | None:
    """Visible text: one line for each block, white space collapsed."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(parser.out).split("\n")) if x)


@F.pandas_udf(T.StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(html_text)


_AUTHOR = T.StructType([T.StructField("family", T.StringType()), T.StructField("given", T.StringType())])
TEI = T.StructType(
    [
        T.StructField("header", T.StructType([T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType()), T.StructField("doi", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("authors", T.ArrayType(_AUTHOR)), T.StructField("venue", T.StringType()), T.StructField("doi_in_text", T.StringType()), T.StructField("imprint_year", T.IntegerType())])),
        T.StructField("sections", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("heading", T.StringType()), T.StructField("text", T.StringType())]))),
        T.StructField("references", T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("authors", T.ArrayType(_AUTHOR)), T.StructField("year", T.IntegerType()), T.StructField("doi", T.StringType()), T.StructField("venue", T.StringType()), T.StructField("raw", T.StringType())]))),
    ]
)
_NS = {"t": "http://www.tei-c.org/ns/1.0"}


def _words(node) -> str | None:
    """All text of a node, white space collapsed; null where there is none."""
    return (" ".join("".join(node.itertext()).split()) or None) if node is not None else None


def _people(node) -> list[tuple[str | None, str | None]]:
    out = []
    for person in node.findall(".//t:author/t:persName", _NS) if node is not None else []:
        family = _words(person.find("t:surname", _NS))
        given = " ".join(x for x in (_words(n) for n in person.findall("t:forename", _NS)) if x) or None
        if family:
            out.append((family, given))
    return out


def _year(node) -> int | None:
    for date in node.findall(".//t:date", _NS) if node is not None else []:
        found = re.search(r"\d{4}", (date.get("when") or "") + " " + (_words(date) or ""))
        if found:
            return int(found.group())
    return None


#: How a header service's DOI and year are looked for where no element names them (fixed values).
LOOSE_DOI, LOOSE_YEAR = r"\b(10\.\d{4,9}/[^\s]+)\b", r"(1[89]\d{2}|20\d{2}|21\d{2})"


def _looser(head) -> tuple[str | None, str | None, int | None]:
    """(venue, DOI anywhere in the header's text, year of the imprint) of a header service's answer."""
    if head is None:
        return None, None, None
    venue = _words(head.find(".//t:monogr/t:title", _NS))
    loose = re.search(LOOSE_DOI, " ".join(head.itertext()))
    years = (re.search(LOOSE_YEAR, date.get("when") or _words(date) or "") for date in head.findall(".//t:imprint/t:date", _NS))
    year = next((int(y.group()) for y in years if y), None)
    return venue, loose.group(1).rstrip(".,;)") if loose else None, year


def read_tei(tei: str | None) -> tuple | None:
    """Header, sections and references of a TEI document; null where it is not well-formed."""
    import xml.etree.ElementTree as ET

    try:
        root = ET.fromstring(tei or "")
    except ET.ParseError:
        return None
    head, source = root.find("t:teiHeader", _NS), root.find(".//t:sourceDesc", _NS)
    abstract = head.find(".//t:abstract", _NS) if head is not None else None
    paragraphs = [x for x in (_words(p) for p in abstract.findall(".//t:p", _NS)) if x] if abstract is not None else []
    doi = next((_words(n) for n in (head.findall(".//t:idno[@type='DOI']", _NS) if head is not None else []) if _words(n)), None)
    analytic = source.find(".//t:analytic", _NS) if source is not None else None
    title = _words(head.find(".//t:titleStmt/t:title", _NS)) if head is not None else None
    header = (title, "\n\n".join(paragraphs) or None, doi, _year(head), _people(analytic), *_looser(head))
    sections = []
    for div in root.findall("./t:text/t:body/t:div", _NS):
        heading = div.find("t:head", _NS)
        number = (heading.get("n") or "").strip(".") if heading is not None else ""
        text = "\n\n".join(x for x in (_words(p) for p in div.findall("t:p", _NS)) if x)
        if _words(heading) or text:
            sections.append((number.count(".") + 1, _words(heading), text))
    references = []
    for entry in root.findall(".//t:listBibl/t:biblStruct", _NS):
        part, whole = entry.find("t:analytic", _NS), entry.find("t:monogr", _NS)
        name = lambda n: _words(n.find("t:title", _NS)) if n is not None else None
        raw = _words(entry.find("t:note[@type='raw_reference']", _NS))
        references.append((name(part) or name(whole), _people(part) or _people(whole), _year(whole), _words(entry.find(".//t:idno[@type='DOI']", _NS)), name(whole), raw))
    return header, sections, references


@F.pandas_udf(TEI)
def tei(documents: pd.Series) -> pd.DataFrame:
    rows = [read_tei(x) for x in documents]
    # rows that cannot be read are empty structs; ``is_tei`` tells them apart
    return pd.DataFrame([r or (None, None, None) for r in rows], columns=["header", "sections", "references"])


def is_tei(parsed: Column) -> Column:
    return parsed["header"].isNotNull()


# --- embeddings -------------------------------------------------------------------------------------------


def stub_vector(text: str, dim: int) -> np.ndarray:
    """A vector that depends on the text alone: normal numbers seeded by its hash, of unit length."""
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") % 2**32
    v = np.random.default_rng(seed).standard_normal(dim)
    return (v / np.linalg.norm(v)).astype(np.float32)


def embedder(encode: Callable[[list[str]], np.ndarray]) -> Callable:
    """A column function from an encoder of lists of texts; the encoder is loaded once in each Python process."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = texts.fillna("").tolist()
            yield pd.Series(list(np.asarray(encode(known), np.float32)))

    return run


def stub_embedder(dim: int = 768) -> Callable:
    return embedder(lambda texts: np.stack([stub_vector(t, dim) for t in texts]))
