"""Exact nearest vectors by cosine distance: chunks in cells around pivots, queries only at cells that can matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_folder

#: Chunks that serve as pivots; only they (and a row of statistics for each) go through the driver.
PIVOTS = 64
#: Chunks of a block, about: a larger cell has several blocks.
BLOCK_ROWS = 1 << 16
#: Slack of the bounds, far above the error of a distance and far below what matters.
MARGIN = 1e-6

HITS = "query_id long, chunk_id long, distance double"
_HITS = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("distance", pa.float64())])


def _matrix(column: pa.ListArray, dims: int | None = None) -> np.ndarray:
    lengths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    dims = int(lengths[0]) if dims is None else dims
    if (lengths != dims).any():
        raise ValueError(f"vectors of {dims} and of {int(lengths[lengths != dims][0])} dimensions")
    return flat.reshape(len(lengths), dims)


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.linalg.norm(v, axis=1)
    return v / np.maximum(norm, 1e-300)[:, None], norm > 0


def _chords(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Straight distances of unit vectors, for which the triangle inequality holds; its square is twice the cosine distance."""
    return np.sqrt(np.maximum(0, 2 - 2 * units @ pivots.T))


class VectorCells:
    """Chunks (chunk_id, vector), each in the cell of its nearest pivot with its distance to it, written once.

    Cell -1 holds the zero vectors, which have no direction: their distance to everything is 1.
    """

    def __init__(self, chunks: DataFrame, vector: str = "embedding"):
        self.spark = chunks.sparkSession
        rows = chunks.where(F.col(vector).isNotNull()).select(F.col("chunk_id").cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        first = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
        if len({len(r["v"]) for r in first}) > 1:
            raise ValueError("vectors of different dimensions")
        self.dims = dims = len(first[0]["v"]) if first else None
        units, real = _units(np.array([r["v"] for r in first], float).reshape(len(first), dims or 0))
        pivots = self.pivots = np.unique(units[real], axis=0) if real.any() else units[:0]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    units, real = _units(_matrix(batch.column("v"), dims))
                    chords = _chords(units, pivots) if len(pivots) else np.zeros((len(units), 1))
                    cell = np.where(real, chords.argmin(1), -1)
                    yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(np.where(real, chords.min(1), 0.0))], names=["id", "v", "cell", "radius"])

        path = new_folder(self.spark, "vectors")
        rows.mapInArrow(place, "id long, v array<double>, cell int, radius double").write.parquet(path)
        self.chunks = self.spark.read.schema("id long, v array<double>, cell int, radius double").parquet(path)
        self.cells = self.chunks.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).orderBy("cell").collect()  # PIVOTS + 1 rows at most
        self.blocks = [max(1, -(-c["n"] // BLOCK_ROWS)) for c in self.cells]
        self.first = np.concatenate(([0], np.cumsum(self.blocks))).tolist()

    def _of(self, values: list, place: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), place + 1)

    def _asks(self, queries: DataFrame, vector: str) -> DataFrame:
        """Queries with `bounds`, the least chord to a chunk of each cell, in the order of the cells, and the place of the nearest."""
        pivots, dims = self.pivots, self.dims
        number, low, high = np.array([c["cell"] for c in self.cells]), np.array([c["low"] for c in self.cells]), np.array([c["high"] for c in self.cells])

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    units, real = _units(_matrix(batch.column("v"), dims))
                    chords = np.zeros((len(units), len(number)))
                    if len(pivots):
                        chords[:, number >= 0] = _chords(units, pivots)[:, number[number >= 0]]
                    bounds = np.maximum(0, np.maximum(chords - high, low - chords))
                    bounds[~real] = bounds[:, number < 0] = 0
                    chords[:, number < 0] = np.inf if len(number) > 1 else 0
                    yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(list(bounds), pa.list_(pa.float64())), pa.array(chords.argmin(1), pa.int32())], names=["id", "v", "bounds", "nearest"])

        asked = queries.where(F.col(vector).isNotNull()).select(F.col("query_id").cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return asked.mapInArrow(bound, "id long, v array<double>, bounds array<double>, nearest int")

    def _visit(self, asks: DataFrame, k: int) -> DataFrame:
        """HITS of asks (id, v, place) in the blocks of their cells: the k nearest of each block, with ties at the edge."""
        start, blocks = self._of(self.first[:-1], F.col("place")), self._of(self.blocks, F.col("place"))
        place = F.array_position(F.array(*[F.lit(c["cell"]) for c in self.cells]), F.col("cell")).cast("int") - 1
        own = self.chunks.withColumn("place", place).select((start + F.pmod(F.xxhash64("id"), blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
        asks = asks.select(F.explode(F.sequence(start, start + blocks - 1)).alias("block"), F.lit(1).alias("kind"), "id", "v")
        n, dims = int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.dims

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, ids, units = None, [], []
            for batch in batches:
                blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
                edge = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1]), [True])))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    if blocks[a] != block:
                        block, ids, units = blocks[a], [], []
                    part = batch.slice(a, b - a)
                    unit = _units(_matrix(part.column("v"), dims))[0]
                    if kinds[a] == 0:
                        ids.append(part.column("id").to_numpy())
                        units.append(unit)
                    elif ids:
                        ids, units = [np.concatenate(ids)], [np.concatenate(units)]
                        for at in range(0, len(unit), 256):
                            yield _nearest(part.column("id").to_numpy()[at : at + 256], unit[at : at + 256], ids[0], units[0], k)

        return own.unionByName(asks).repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(search, HITS)

    def topk(self, queries: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
        """HITS with rank of the k nearest chunks of each query (query_id, vector), exactly; ties by chunk_id.

        A query first goes to the cell of its nearest pivot. Its k-th distance there bounds the result, so of the other
        cells only those are visited that may hold a nearer chunk by the triangle inequality, with chords for distances.
        """
        if not self.cells:
            return self.spark.createDataFrame([], f"{HITS}, rank int")
        asked = self._asks(queries, vector)
        near = self._visit(asked.select("id", "v", F.col("nearest").alias("place")), k)
        best = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
        ranked = lambda hits: hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        path = new_folder(self.spark, "nearest")
        ranked(near).write.parquet(path)
        near = self.spark.read.schema(f"{HITS}, rank int").parquet(path)
        far = self._visit(self._further(asked, near, k), k)
        return ranked(near.drop("rank").unionByName(far))

    def _further(self, asked: DataFrame, near: DataFrame, k: int) -> DataFrame:
        """(id, v, place) of the other cells that a query must visit, given its k nearest in its own."""
        kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("kth")).distinct()
        reach = F.when(F.col("kth").isNull(), float("inf")).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 * (F.col("kth") + 1e-9))) + MARGIN)
        other = asked.join(kth, "id", "left").select("id", "v", "nearest", reach.alias("reach"), F.posexplode("bounds").alias("place", "bound"))
        return other.where((F.col("place") != F.col("nearest")) & (F.col("bound") <= F.col("reach"))).select("id", "v", "place")

    def visited(self, queries: DataFrame, k: int, vector: str = "embedding") -> float:
        """The share of all pairs of queries and chunks that a search for the k nearest compares."""
        asked = self._asks(queries, vector)
        own = asked.select("id", "v", F.col("nearest").alias("place"))
        hits = self._visit(own, k)
        near = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id")))
        places = own.select("place").unionByName(self._further(asked, near, k).select("place"))
        pairs = places.agg(F.sum(self._of([c["n"] for c in self.cells], F.col("place")))).head()[0] or 0
        return pairs / max(1, asked.count() * sum(c["n"] for c in self.cells))


def _nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, chunks: np.ndarray, k: int) -> pa.RecordBatch:
    distance = np.round(1 - queries @ chunks.T, 9)
    if len(ids) > k:
        edge = np.partition(distance, k - 1, axis=1)[:, k - 1 : k]  # ties at the edge stay, Spark decides them
        q, c = np.nonzero(distance <= edge)
    else:
        q, c = np.nonzero(np.ones_like(distance, bool))
    return pa.record_batch([pa.array(query_ids[q], pa.int64()), pa.array(ids[c], pa.int64()), pa.array(distance[q, c])], schema=_HITS)
