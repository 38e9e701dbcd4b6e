"""Files as rows: walking folders, hashing, telling kinds apart, text of EPUB and PDF, the content-addressed store."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pyfuncs import html_text
from ..functions.text import cas_path, sniff

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def walk(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, content, content_hash, kind) of the PDF and EPUB files of a folder, in order of path; endings in any case."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    rows = rows.where(F.lower("path").rlike(r"\.(pdf|epub)$"))
    return rows.select("path", "content", F.sha2("content", 256).alias("content_hash"), sniff(F.col("content")).alias("kind")).orderBy("path")


def unseen(files: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose hash the library lacks, one of each hash; and files it has, with their item."""
    known = items.where("content_hash is not null").select(F.col("id").alias("item_id"), "content_hash")
    return files.dropDuplicates(["content_hash"]).join(known, "content_hash", "left_anti"), files.join(known, "content_hash")


# --- EPUB -------------------------------------------------------------------------------------------------


def _package(book: zipfile.ZipFile):
    import xml.etree.ElementTree as ET

    container = ET.fromstring(book.read("META-INF/container.xml"))
    path = container.find(".//{*}rootfile").get("full-path")
    return ET.fromstring(book.read(path)), posixpath.dirname(path)


def read_epub(content: bytes | None) -> tuple | None:
    """(metadata map, spine array of (position, href, title, text)); null where it is no readable EPUB."""
    import re

    try:
        book = zipfile.ZipFile(io.BytesIO(content or b""))
        package, base = _package(book)
    except Exception:  # noqa: BLE001 - any damage means no book
        return None
    facts: dict[str, str] = {}
    for node in package.find("{*}metadata") or []:
        name = node.tag.rpartition("}")[2]
        if node.text and node.text.strip():
            facts[name] = f"{facts[name]}; {node.text.strip()}" if name in facts else node.text.strip()
    files = {n.get("id"): n.get("href") for n in package.findall("{*}manifest/{*}item")}
    spine = []
    for ref in package.findall("{*}spine/{*}itemref"):
        href = files.get(ref.get("idref"))
        try:
            raw = book.read(posixpath.join(base, href)).decode("utf-8", "replace")
        except (KeyError, TypeError):
            continue
        heading = re.search(r"(?is)<(h1|h2|title)[^>]*>(.*?)</\1>", raw)
        title = html_text(heading.group(2)) if heading else None
        spine.append((len(spine), href, title or f"Chapter {len(spine) + 1}", html_text(raw)))
    return facts, spine


EPUB = T.StructType(
    [
        T.StructField("facts", T.MapType(T.StringType(), T.StringType())),
        T.StructField("spine", T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), T.StructField("href", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))),
    ]
)


@F.pandas_udf(EPUB)
def epub(contents: pd.Series) -> pd.DataFrame:
    rows = [read_epub(c) or (None, None) for c in contents]
    return pd.DataFrame(rows, columns=["facts", "spine"])


def epub_text(parsed) -> F.Column:
    """The whole text of a parsed EPUB."""
    return F.array_join(F.transform(parsed["spine"], lambda s: s["text"]), "\n\n")


# --- PDF --------------------------------------------------------------------------------------------------


def pdf_pages(files: DataFrame, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, page, text) of the pages with text, from 1, by a function from bytes to page texts.

    No PDF library comes with this package: give the function, or have ``pypdf`` installed on the executors.
    """
    if extract is None:
        try:
            import pypdf  # noqa: F401
        except ImportError:
            raise NotImplementedError("no PDF library is installed: give pdf_pages a function from bytes to page texts") from None

        def extract(content: bytes) -> list[str]:
            import pypdf

            return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pages(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: extract(c) if c else [])

    rows = files.where("kind = 'pdf'").select("path", F.posexplode(pages("content")).alias("k", "text"))
    return rows.where(F.trim("text") != "").select("path", (F.col("k") + 1).alias("page"), "text")


# --- the content-addressed store --------------------------------------------------------------------------


def store(blobs: DataFrame, root: str) -> DataFrame:
    """Write ``content`` of each distinct hash to root/ab/cd/hash, once; gives (content_hash, path, size, stored).

    ``root`` is a URI of storage that all executors share. A blob is written beside its place and then moved, so
    that a lost or repeated task leaves no torn file.
    """

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for part in parts:
            new = []
            for content, path in zip(part.content, part.path):
                target = f"{base}/{path}"
                fresh = system.get_file_info(target).type == fs.FileType.NotFound
                if fresh:
                    system.create_dir(posixpath.dirname(target), recursive=True)
                    draft = f"{target}.{uuid.uuid4().hex}"
                    with system.open_output_stream(draft) as out:
                        out.write(content)
                    system.move(draft, target)
                new.append(fresh)
            yield pd.DataFrame({"content_hash": part.content_hash, "path": part.path, "size": [len(c) for c in part.content], "stored": new})

    rows = blobs.where("content is not null").select(F.sha2("content", 256).alias("content_hash"), "content").dropDuplicates(["content_hash"])
    rows = rows.select("content_hash", "content", cas_path(F.col("content_hash")).alias("path"))
    return rows.mapInPandas(write, "content_hash string, path string, size long, stored boolean")


def valid_hash(text) -> F.Column:
    return F.regexp_like(text, F.lit("^[0-9a-f]{64}$"))


# --- chapters ---------------------------------------------------------------------------------------------


def pdf_outline(files: DataFrame, read: Callable[[bytes], list[tuple[int, str, int]]]) -> DataFrame:
    """(path, position, title, page) of the top-level entries of PDFs' outlines, by a function from bytes to (level, title, page).

    Levels and pages count from 1; entries without a title or with a page before the first are left out, and so are
    files with fewer than two entries.
    """
    kind = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("page", T.IntegerType())]))

    @F.pandas_udf(kind)
    def outline(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: [(t.strip(), p) for level, t, p in read(c) if level == 1 and t and t.strip() and p >= 1] if c is not None else [])

    rows = files.select("path", outline("content").alias("toc")).where(F.size("toc") >= 2)
    return rows.select("path", F.posexplode("toc").alias("position", "x")).select("path", "position", "x.title", "x.page")


def epub_outline(parsed: DataFrame, key: str = "path", epub: str = "epub") -> DataFrame:
    """(key, position, title, page) of the spine entries of parsed EPUBs; an e-book has one page, so entries count as pages."""
    rows = parsed.where(F.size(F.col(epub)["spine"]) >= 2).select(key, F.explode(F.col(epub)["spine"]).alias("s"))
    return rows.select(key, "s.position", "s.title", (F.col("s.position") + 1).alias("page"))
