"""Vectors: normalising, and exact nearest neighbours of a stated query set, in blocks against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import new_path, ship, spread

#: Vectors in one block: with 768 numbers of 8 bytes, 12 MB are read at a time; vectors of the corpus a task holds at once.
BLOCK, HELD = 2048, 8192


def normalised(vector: Column) -> Column:
    """Unit length; vectors of zeros stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def checked(vector: Column, dim: int) -> Column:
    """The vector; an error where its length is not ``dim``."""
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} numbers, got "), F.size(vector).cast("string"))))


def similarity_of_distance(distance: Column) -> Column:
    """Cosine of two unit vectors from their Euclidean distance."""
    return 1 - distance * distance / 2


def _matrix(batch: pa.RecordBatch, id_col: str, vector_col: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the usable rows of a batch."""
    lists = batch.column(vector_col)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero((sizes == dim) & ~np.asarray(batch.column(id_col).is_null()))
    if not len(at):
        return np.empty(0, np.int64), np.empty((0, dim))
    values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((values * values).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    ids = batch.column(id_col).take(pa.array(at)).to_numpy(zero_copy_only=False)
    return ids[good].astype(np.int64), values[good] / norm[good, None]


def _smallest(distances: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the k smallest distances in each row; of equal ones the smaller id, each id once."""
    wide = k + len(ids) - len(np.unique(ids))  # repeats may take places
    if distances.shape[1] > wide:
        row, col = np.nonzero(distances <= np.partition(distances, wide - 1, axis=1)[:, wide - 1 : wide])
    else:
        row, col = np.nonzero(distances >= 0)
    d = distances[row, col]
    order = np.lexsort((ids[col], d, row))
    row, col, d = row[order], col[order], d[order]
    again = np.zeros(len(row), bool)
    again[1:] = (row[1:] == row[:-1]) & (ids[col[1:]] == ids[col[:-1]])
    row, col, d = row[~again], col[~again], d[~again]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], d[keep]


def nearest(corpus: DataFrame, queries: DataFrame | list[tuple[int, list[float]]], k: int, dim: int, id_col: str = "item_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id_col, distance): for each query the k nearest usable rows, the query's own id included.

    ``queries`` is a table like ``corpus``, or a short list. Queries are packed into blocks in the shared folder,
    which every task reads one after the other, so that neither the driver nor a broadcast holds them all. A task
    holds ``HELD`` vectors of the corpus at a time; what is shuffled are the k best rows of each query and hold, never
    vectors. Distances are Euclidean between unit vectors, rounded to 9 decimals; ties go to the smaller id, repeats of an
    id count once, with its nearest vector.
    """
    spark = corpus.sparkSession
    ship(spark)
    rows = spread(corpus.select(F.col(id_col).cast("long").alias(id_col), vector_col))
    if isinstance(queries, list):
        queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in queries], f"{id_col} long, {vector_col} array<double>")
    asked = queries.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias(vector_col)).dropDuplicates([id_col])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, unit = _matrix(batch, id_col, vector_col, dim)
            for lo in range(0, len(ids), BLOCK):
                parts = ids[lo : lo + BLOCK].tobytes(), unit[lo : lo + BLOCK].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], ["ids", "unit"])

    path = new_path(spark, "queries")
    asked.mapInArrow(pack, "ids binary, unit binary").write.option("compression", "none").parquet(path)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, unit = _matrix(batch, id_col, vector_col, dim)
            if len(ids):
                held.append((ids, unit))
                size += len(ids)
            if size >= HELD:
                yield from best(held)
                held, size = [], 0
        if held:
            yield from best(held)

    def best(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        found, unit = np.concatenate([i for i, _ in held]), np.concatenate([u for _, u in held])
        system, root = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
        for block in ds.dataset(root, filesystem=system, format="parquet").to_batches(batch_size=1):
            for own, q in zip(block.column("ids").to_pylist(), block.column("unit").to_pylist()):
                own, q = np.frombuffer(own, np.int64), np.frombuffer(q, np.float64).reshape(-1, dim)
                d = np.round(np.sqrt(np.maximum(2 - 2 * (q @ unit.T), 0)), 9)
                row, col, near = _smallest(d, found, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(found[col]), pa.array(near)], ["query_id", id_col, "distance"])

    out = rows.mapInArrow(local, f"query_id long, {id_col} long, distance double").groupBy("query_id", id_col).agg(F.min("distance").alias("distance"))
    place = F.row_number().over(W.Window.partitionBy("query_id").orderBy("distance", id_col))
    return out.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")
