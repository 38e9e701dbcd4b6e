"""Encoding of a whole corpus with a public byte-level tokenizer.

A long text is cut into chunks that overlap; the chunks are split into pre-tokens in parallel, and neighbours
are stitched where the pre-token boundaries of both agree inside the overlap. The split reads only forward from
where it stands, so that after one common boundary both go on alike; the pieces between such boundaries are then
encoded on their own, and their ids stand in order. A boundary after white space is passed over, because a run
of white space splits by what follows it. Chunks without a common boundary (one run of letters longer than the
overlap goes through both) are encoded as one piece, they alone. Decoding concatenates the raw bytes.

Defined results: null and empty texts give an empty list; special tokens are never formed, their strings are
ordinary text; exact repeats of rows stay.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..session import spread

VOCABULARY = os.environ.get("SHELFWISE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: How the public vocabulary splits text before its merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters of a chunk, and of the overlap with the next one.
CHUNK, OVERLAP = 1800, 240

_ready: dict[str, object] = {}


def _encoding(ranks: bytes):
    """The tokenizer of a rank file's bytes; made once in each Python process."""
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _ready:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) }
        _ready[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ready[key]


def _boundaries(text: str) -> list[int]:
    """Ends of pre-tokens, but the last two: they may depend on text beyond."""
    import regex

    if "pattern" not in _ready:
        _ready["pattern"] = regex.compile(PATTERN)
    return [m.end() for m in _ready["pattern"].finditer(text)][:-2]


def meeting(text: str, start: int) -> int | None:
    """The first boundary beyond ``start`` that a split from 0 and a split from ``start`` share."""
    tail = text[start:]
    other = {start + x for x in _boundaries(tail)}
    return next((x for x in _boundaries(text) if x > start and x in other and not text[x - 1].isspace()), None)


def _ranks(spark: SparkSession, path: str):
    """The rank file, read on the driver and broadcast: its size is that of a vocabulary, under 2 MB."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 16 << 20:
        raise ValueError(f"{path} is no vocabulary of a public tokenizer")
    return spark.sparkContext.broadcast(data)


def encode(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, ids array<int>), a row for each row of ``rows``."""
    ranks = _ranks(rows.sparkSession, vocabulary)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode_ordinary = _encoding(ranks.value).encode_ordinary
        for batch in texts:
            yield batch.map(lambda t: encode_ordinary(t) if t else [])

    @F.pandas_udf(T.IntegerType())
    def meets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: meeting(t, chunk)).astype("Int64")

    rows = spread(rows.select(F.col(id_col), F.col(text_col).alias("__text")))
    short = rows.where(F.coalesce(F.length("__text"), F.lit(0)) <= chunk)
    long = rows.where(F.length("__text") > chunk)
    encoded = short.select(id_col, ids("__text").alias("ids"))

    n = F.ceil(F.length("__text") / chunk).cast("int")
    parts = (
        long.select(id_col, F.monotonically_increasing_id().alias("__row"), n.alias("__n"), "__text")
        .select(id_col, "__row", "__n", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__k"), "__text")
        .select(id_col, "__row", "__n", "__k", F.col("__text").substr(F.col("__k") * chunk + 1, F.lit(chunk + overlap)).alias("__part"))
        .repartition("__row", "__k")
        .withColumn("__meets", F.when(F.col("__k") < F.col("__n") - 1, meets("__part")))
    )
    in_order = W.Window.partitionBy("__row").orderBy("__k")
    before = F.lag("__meets").over(in_order)
    met = F.coalesce(F.sum(F.col("__meets").isNotNull().cast("int")).over(in_order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    start = F.coalesce(before - chunk, F.lit(0))
    end = F.when(F.col("__k") == F.col("__n") - 1, F.length("__part")).otherwise(F.coalesce("__meets", F.lit(chunk)))
    cuts = parts.select(id_col, "__row", "__k", "__part", start.alias("__start"), end.alias("__end"), met.alias("__piece"))
    # what lies between two common boundaries is one piece, as a rule of one chunk
    pieces = cuts.groupBy("__row", "__piece").agg(F.first(id_col).alias(id_col), F.array_sort(F.collect_list(F.struct("__k", F.col("__part").substr(F.col("__start") + 1, F.col("__end") - F.col("__start")).alias("text")))).alias("__parts"))
    piece_ids = pieces.repartition("__row", "__piece").select(id_col, "__row", "__piece", ids(F.array_join(F.transform("__parts", lambda x: x["text"]), "")).alias("ids"))
    stitched = piece_ids.groupBy("__row").agg(F.first(id_col).alias(id_col), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__piece", "ids"))), lambda x: x["ids"])).alias("ids")).select(id_col, "ids")
    return encoded.unionByName(stitched)


def decode(rows: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY, as_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids: the raw bytes of all tokens, concatenated, then read as UTF-8."""
    ranks = _ranks(rows.sparkSession, vocabulary)

    @F.pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode_bytes = _encoding(ranks.value).decode_bytes
        for batch in batches:
            yield batch.map(lambda x: None if x is None else decode_bytes(list(x)).decode("utf-8", "replace"))

    return rows.withColumn(as_col, text(ids_col))
