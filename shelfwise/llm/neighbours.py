"""The most similar vectors of every vector: a block matrix join on int8 tiles with error bounds.

Vectors are normalised, quantised to 7 bits with a scale of their own, and written as blocks to the shared
folder. A task takes pairs of blocks, forms the int8 product of each pair in tiles, and knows for each pair of
vectors how far that product can be off (from the norms of what quantisation left out). Only pairs whose upper
bound reaches the threshold and the k-th best lower bound of one of the two are computed again in floating
point; each task keeps the k best of every vector (a bounded heap) and emits no more than those. The result is
exact.

Pairs of blocks are read from the shared folder, not shuffled: what is shuffled are only the k best of each vector
and task. The work is quadratic in the number of vectors by nature of the method (see README for figures).

Vectors that are copies of one another would make all pairs of a group survive. Of a group of identical vectors
only the k + 1 smallest ids take part; with ties going to the smaller id no other copy can be among anyone's
nearest, and the remaining copies have the neighbours of the first.

Defined results: only vectors of ``dim`` finite numbers, not all zero, take part; lengths other than 1 do not
matter; null ids and null vectors are left out; exact repeats count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import cut, drop, new_path

DIM, K, LEAST = 768, 10, 0.7
#: Vectors in a block, and rows of a tile within it.
BLOCK, STRIP = 4096, 1024
#: Largest absolute value of a quantised number: sums of two products then stay within 16 bits on any CPU.
LEVELS = 63

_ready: dict[str, object] = {}


def _product():
    """f(a uint8 (n, d), b int8 (d, m)) -> int32 (n, m): by onnxruntime where it is there, else by float BLAS."""
    if "product" not in _ready:
        try:
            import onnxruntime as ort

            number = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)
            part = lambda field, data: number(field << 3 | 2) + number(len(data)) + data
            value = lambda field, n: number(field << 3) + number(n)
            shape = part(2, part(1, part(2, b"n")) + part(1, part(2, b"m")))
            tensor = lambda name, kind: part(1, name) + part(2, part(1, value(1, kind) + shape))
            node = part(1, b"A") + part(1, b"B") + part(2, b"Y") + part(4, b"MatMulInteger")
            graph = part(1, node) + part(2, b"tile") + part(11, tensor(b"A", 2)) + part(11, tensor(b"B", 3)) + part(12, tensor(b"Y", 6))
            options = ort.SessionOptions()
            options.intra_op_num_threads = options.inter_op_num_threads = 1
            session = ort.InferenceSession(value(1, 8) + part(7, graph) + part(8, part(1, b"") + value(2, 13)), options, providers=["CPUExecutionProvider"])
            _ready["product"] = lambda a, b: session.run(None, {"A": a, "B": b})[0]
        except Exception:  # noqa: BLE001 - any lack of the library means the plain product
            _ready["product"] = lambda a, b: (a.astype(np.float32) @ b.astype(np.float32)).astype(np.int32)
    return _ready["product"]


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 numbers, scale, norm of the quantised vector, norm of what is left, for unit rows."""
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-30) / LEVELS
    q = np.rint(unit / scale[:, None])
    near = q * scale[:, None]
    return q.astype(np.int8), scale.astype(np.float32), np.linalg.norm(near, axis=1).astype(np.float32), np.linalg.norm(unit - near, axis=1).astype(np.float32)


def _usable(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of usable vectors, and these, normalised."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null inside becomes NaN
    norm = np.sqrt((values * values).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], (values[good] / norm[good, None]).astype(np.float32)


class _Block:
    """One block: ids, floats, numbers ready for either side of the product, and bounds."""

    def __init__(self, row: dict, dim: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.unit = np.frombuffer(row["unit"], np.float32).reshape(-1, dim)
        self.q = np.frombuffer(row["q"], np.int8).reshape(-1, dim)
        self.scale, self.norm, self.left = (np.frombuffer(row[c], np.float32) for c in ("scale", "norm", "rest"))


def _read_block(path: str, number: int, dim: int) -> _Block | None:
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    where = f"{root}/block={number}"
    if system.get_file_info(where).type == fs.FileType.NotFound:
        return None
    return _Block(ds.dataset(where, filesystem=system, format="parquet").to_table().to_pylist()[0], dim)


class _Best:
    """The k best partners of each row of a block: bounded heaps, as arrays."""

    def __init__(self, n: int, k: int):
        self.k, self.sim, self.id = k, np.full((n, k), -2.0), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, row: np.ndarray, sim: np.ndarray, partner: np.ndarray) -> None:
        """Merge (row, sim, partner) triples; more similar first, ties to the smaller id."""
        rows, inverse = np.unique(row, return_inverse=True)
        row = np.concatenate([inverse, np.repeat(np.arange(len(rows)), self.k)])
        sim = np.concatenate([sim, self.sim[rows].ravel()])
        partner = np.concatenate([partner, self.id[rows].ravel()])
        order = np.lexsort((partner, -sim, row))
        row, sim, partner = row[order], sim[order], partner[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.sim[rows[row[keep]], place[keep]] = sim[keep]
        self.id[rows[row[keep]], place[keep]] = partner[keep]

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(self.sim > -2)
        return ids[at], self.id[at, place], self.sim[at, place]


def _join(a: _Block, b: _Block, same: bool, best_a: _Best, best_b: _Best, k: int, least: float) -> None:
    """Add the pairs of two blocks to the heaps of both."""
    product, right, total = _product(), np.ascontiguousarray(b.q.T), b.q.sum(axis=1, dtype=np.int32)
    for lo in range(0, len(a.ids), STRIP):
        part = slice(lo, min(lo + STRIP, len(a.ids)))
        q = (a.q[part].astype(np.int16) + LEVELS).astype(np.uint8)
        near = (product(q, right) - LEVELS * total).astype(np.float32)
        near *= a.scale[part, None]
        near *= b.scale
        # |x.y - near| <= |x^||y - y^| + |x - x^||y|
        off = np.multiply.outer(a.norm[part], b.left) + a.left[part, None] + np.float32(1e-5)
        high = near + off
        if same:
            high[np.arange(part.stop - lo), np.arange(lo, part.stop)] = -2
        # the k-th best value seen so far is a lower bound of the final k-th best
        open_a, open_b = high >= np.maximum(best_a.sim[part, -1], least)[:, None] - 1e-6, high >= np.maximum(best_b.sim[:, -1], least) - 1e-6
        if high.shape[1] > k:
            low = near - off
            floor = np.partition(low, -k - same, axis=1)[:, -k - same] if (high > least).sum() > 64 * high.shape[0] else None
            if floor is not None:
                open_a &= high >= floor[:, None] - 1e-6
        row, col = np.nonzero(open_a | open_b)
        for s in range(0, len(row), 16384):
            r, c = row[s : s + 16384] + lo, col[s : s + 16384]
            sim = np.round(np.einsum("ij,ij->i", a.unit[r].astype(np.float64), b.unit[c].astype(np.float64)), 6)
            ok = sim >= least
            r, c, sim = r[ok], c[ok], sim[ok]
            if len(r):
                best_a.add(r, sim, b.ids[c])
                if not same:
                    best_b.add(c, sim, a.ids[r])


def nearest(vectors: DataFrame, k: int = K, least: float = LEAST, dim: int = DIM, id_col: str = "item_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id, partner, similarity): for every usable vector its k most similar others at ``least`` or above."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    # what ``_usable`` leaves out must not count as copies of one another either; a NaN is greater than infinity
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    # copies: groups of identical vectors of more than k + 1 ids
    keys = rows.where((F.size("v") == dim) & finite & F.exists("v", lambda x: x != 0)).select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    keys, keys_path = cut(keys.distinct(), "keys")
    crowds = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head")).where(F.col("n") > k + 1)
    crowds, crowds_path = cut(crowds, "crowds")
    crowded = bool(crowds.take(1))
    if crowded:
        members = keys.join(crowds.drop("n"), ["h1", "h2"])
        lead = members.withColumn("place", F.row_number().over(W.Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("place") <= k + 1)
        lead, _ = cut(lead.select("id", "head"), "lead")
        extra, _ = cut(members.select("id", "head").join(lead.select("id"), "id", "left_anti"), "extra")
        rows = rows.join(extra.select("id"), "id", "left_anti")

    blocks = max(1, -(-rows.count() // block))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit = _usable(batch.column("v"), dim)
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array([x.tobytes() for x in unit], pa.binary())], ["id", "unit"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, bytes]] = {}
        for batch in batches:
            for b, i, u in zip(*(batch.column(c).to_pylist() for c in ("block", "id", "unit"))):
                held.setdefault(b, {})[i] = u
        for b, own in held.items():
            ids = np.array(sorted(own), np.int64)
            unit = np.frombuffer(b"".join(own[i] for i in ids.tolist()), np.float32).reshape(-1, dim)
            parts = [x.tobytes() for x in (ids, unit, *quantise(unit))]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32())] + [pa.array([x], pa.binary()) for x in parts], ["block", "ids", "unit", "q", "scale", "norm", "rest"])

    path = new_path(spark, "blocks")
    (
        rows.mapInArrow(units, "id long, unit binary")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        .repartition(blocks, "block")
        .mapInArrow(pack, "block int, ids binary, unit binary, q binary, scale binary, norm binary, rest binary")
        .write.partitionBy("block").option("compression", "none").parquet(path)
    )

    # pairs of blocks (i, i + d mod blocks), d up to half: each unordered pair once, and one task's pairs share i
    half = blocks // 2 + 1

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, a, best = -1, None, None

        def out(ids: np.ndarray, heaps: _Best) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in heaps.rows(ids)], ["id", "partner", "similarity"])

        for batch in batches:
            for t in batch.column("t").to_pylist():
                if t // half != i:
                    if a:
                        yield out(a.ids, best)
                    i = t // half
                    a = _read_block(path, i, dim)
                    best = a and _Best(len(a.ids), k)
                d = t % half
                if not a or (blocks % 2 == 0 and d == half - 1 and i >= blocks // 2 and d):
                    continue
                b = _read_block(path, (i + d) % blocks, dim) if d else a
                if b:
                    other = _Best(len(b.ids), k) if d else best
                    _join(a, b, d == 0, best, other, k, least)
                    if d:
                        yield out(b.ids, other)
        if a:
            yield out(a.ids, best)

    pairs = blocks * half
    found = spark.range(0, pairs, 1, max(1, min(pairs, 4 * blocks))).withColumnRenamed("id", "t").mapInArrow(tiles, "id long, partner long, similarity double")
    place = F.row_number().over(W.Window.partitionBy("id").orderBy(F.desc("similarity"), "partner"))
    best = found.withColumn("place", place).where(F.col("place") <= k).drop("place")
    drop(spark, keys_path, crowds_path)
    if crowded:
        best, _ = cut(best, "best")
        # a copy beyond the first k + 1 sees what the first sees, and the first k + 1
        firsts = extra.select("head").distinct()
        seen = best.join(firsts, F.col("id") == F.col("head")).select("head", "partner", "similarity")
        seen = seen.unionByName(lead.join(firsts, "head").select("head", F.col("id").alias("partner"), F.lit(1.0).alias("similarity"))).distinct()
        view = seen.withColumn("place", F.row_number().over(W.Window.partitionBy("head").orderBy(F.desc("similarity"), "partner"))).where(F.col("place") <= k).drop("place")
        best = best.unionByName(extra.join(view, "head").select("id", "partner", "similarity"))
    return best


def similar_pairs(vectors: DataFrame, **options) -> DataFrame:
    """(item_a, item_b), item_a < item_b, where at least one is among the other's nearest."""
    return nearest(vectors, **options).select(F.least("id", "partner").alias("item_a"), F.greatest("id", "partner").alias("item_b")).distinct()
