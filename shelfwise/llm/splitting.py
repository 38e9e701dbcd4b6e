"""Splitting oversized texts at natural boundaries.

One regular expression with bounded quantifiers takes the next core of a text: its alternatives are ordered by
the strength of the boundary at which they end (paragraph, sentence, word, and any character where a word alone
is over a limit in characters), and each consumes as much as the limit allows. Array functions then look back
from each core's start for the overlap. Everything runs in the JVM.

A core first tries to leave room for the overlap (limit - overlap words), then the whole limit; the overlap of a
piece is what then fits, so that no piece exceeds the limit.

Words are runs without white space in the Unicode sense. Paragraphs are parted by lines that are empty or
blank; sentences end by . ! or ? before white space, or with the paragraph.

Defined results: null texts give no pieces; empty and blank texts one piece without words, equal to the text;
texts within the limit one piece, unchanged; exact repeats of rows give pieces once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 400, 40

_BREAK = r"(?>\r\n|[\n\r\x0B\f\x85\u2028\u2029])"
_BLANK = r"[^\S\n\r\x0B\f\x85\u2028\u2029]*+"
#: What follows the last word of a paragraph.
_PARAGRAPH = rf"(?=\s*+\z|{_BLANK}{_BREAK}{_BLANK}{_BREAK})"
#: A sentence ends after its mark, or with its paragraph.
_SENTENCE = rf"(?:(?<=[.!?])(?=\s|\z)|{_PARAGRAPH})"


def core_pattern(limit: int, overlap: int) -> str:
    """Cores of at most ``limit`` words; groups 1, 2, 3: ended by a paragraph, a sentence, a word."""
    short = max(limit - overlap, 1)
    run = lambda n, end: rf"(?:\S++\s++){{0,{n - 1}}}\S++{end}"
    either = lambda end: f"{run(short, end)}|{run(limit, end)}"
    return rf"(?U)({either(_PARAGRAPH)})|({either(_SENTENCE)})|({run(short, '')})"


def char_pattern(limit: int, overlap: int) -> str:
    """Cores of at most ``limit`` characters; group 4: cut inside a word, where no boundary is in reach."""
    short = max(limit - overlap, 1)
    run = lambda n, end: rf"\S.{{0,{n - 1}}}(?<=\S){end}"
    either = lambda end: f"{run(short, end)}|{run(limit, end)}"
    return rf"(?Us)({either(_PARAGRAPH)})|({either(_SENTENCE)})|({run(short, r'(?=\s|\z)')})|(\S.{{0,{short - 1}}})"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def _cores(text: Column, pattern: str, groups: int) -> Column:
    """array<struct<text, cut>>: the cores with the kind of boundary at their end."""
    kinds = ("paragraph", "sentence", "word", "character")
    cut = F.lit(kinds[groups - 1])
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups)]
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("core"), *[a.alias(f"g{k}") for k, a in enumerate(found)])

    def one(x: Column) -> Column:
        kind = cut
        for k in reversed(range(groups - 1)):
            kind = F.when(x[f"g{k}"] != "", kinds[k]).otherwise(kind)
        return F.struct(x["core"].alias("text"), kind.alias("cut"))

    return F.transform(zipped, one)


def split_oversized(rows: DataFrame, text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The columns of ``rows`` but the text, with piece_no, piece, piece_words, overlap_words and cut.

    A row comes out once for each piece, in text order from 0; ``cut`` is the boundary at the piece's end and
    null for texts that are within the limit. Columns of ``rows`` with those names are replaced.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be at least 1 and overlap between 0 and limit - 1")
    own = ["piece_no", "piece", "piece_words", "overlap_words", "cut"]
    keep = [c for c in rows.columns if c != text_col and c not in own]
    text = F.col(text_col)
    rows = rows.where(text.isNotNull()).select(*keep, text.alias("__text"), word_count(text).alias("__n"))
    whole = rows.where(F.col("__n") <= limit).select(
        *keep, F.lit(0).alias("piece_no"), F.col("__text").alias("piece"), F.col("__n").alias("piece_words"), F.lit(0).alias("overlap_words"), F.lit(None).cast("string").alias("cut")
    )
    long = rows.where(F.col("__n") > limit)
    cores = long.select(
        *keep,
        F.regexp_extract_all(F.col("__text"), F.lit(r"(?U)\S+\s*"), F.lit(0)).alias("__words"),
        _cores(F.col("__text"), core_pattern(limit, overlap), 3).alias("__cores"),
    ).withColumn("__sizes", F.transform("__cores", lambda c: word_count(c["text"])))
    # running ends of the cores, in words
    ends = F.aggregate(
        "__sizes",
        F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all")),
        lambda a, n: F.struct((a["sum"] + n).alias("sum"), F.concat(a["all"], F.array(a["sum"] + n)).alias("all")),
        lambda a: a["all"],
    )
    # pieces are formed beside their text, so that none carries more than itself
    def piece(c: Column) -> Column:
        size, end = c["__sizes"], c["__ends"]
        back = F.least(F.lit(overlap), F.lit(limit) - size, end - size)
        text = F.array_join(F.slice("__words", end - size - back + 1, size + back), "")
        return F.struct(F.regexp_replace(text, r"(?U)\s+\z", "").alias("piece"), (size + back).alias("piece_words"), back.alias("overlap_words"), c["__cores"]["cut"].alias("cut"))

    each = cores.withColumn("__ends", ends).select(*keep, F.posexplode(F.transform(F.arrays_zip("__cores", "__sizes", "__ends"), piece)).alias("piece_no", "__p"))
    return whole.unionByName(each.select(*keep, "piece_no", "__p.*"))


def split_characters(rows: DataFrame, text_col: str = "text", limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Like ``split_oversized`` with a limit in characters; a word over the limit is cut between characters."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be at least 1 and overlap between 0 and limit - 1")
    keep = [c for c in rows.columns if c not in (text_col, "piece_no", "piece", "cut", "overlap_chars")]
    text = F.col(text_col)
    cores = rows.where(text.isNotNull()).select(*keep, _cores(text, char_pattern(limit, overlap), 4).alias("__c"))
    previous = F.concat(F.array(F.lit("")), F.transform(F.slice("__c", F.lit(1), F.greatest(F.size("__c") - 1, F.lit(0))), lambda c: c["text"]))

    def piece(c: Column) -> Column:
        room = F.least(F.lit(overlap), F.lit(limit) - F.length(c["c"]["text"]))
        before = c["before"]
        back = F.when(room > 0, F.substring(before, F.greatest(F.length(before) - room + 1, F.lit(1)), room)).otherwise("")
        return F.struct(F.concat(back, c["c"]["text"]).alias("piece"), F.length(back).alias("overlap_chars"), c["c"]["cut"].alias("cut"))

    zipped = F.arrays_zip(F.col("__c").alias("c"), previous.alias("before"))
    each = cores.where(F.size("__c") > 0).select(*keep, F.posexplode(F.transform(zipped, piece)).alias("piece_no", "__p"))
    return each.select(*keep, "piece_no", "__p.*")


def oversized_boundaries(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, boundary): the weakest boundary at which ``split_oversized`` had to cut each oversized chunk.

    A paragraph that fits is never cut elsewhere, nor is a sentence that fits, so the weakest cut tells whether
    every paragraph, else every sentence, is within the limit.
    """
    weakness = lambda c: F.when(c["cut"] == "paragraph", 0).when(c["cut"] == "sentence", 1).otherwise(2)
    names = F.array(F.lit("paragraph"), F.lit("sentence"), F.lit("word"))
    long = chunks.select("chunk_id", "text").where("chunk_id is not null").where(word_count(F.col("text")) > limit)
    worst = F.array_max(F.transform(_cores(F.col("text"), core_pattern(limit, overlap), 3), weakness))
    return long.select("chunk_id", worst.alias("worst")).groupBy("chunk_id").agg(F.max("worst").alias("worst")).select("chunk_id", F.get(names, F.col("worst")).alias("boundary"))
