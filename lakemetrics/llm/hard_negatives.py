"""Operator 13: hard negatives by Fagin's threshold algorithm over per-dimension sorted lists of blocks of candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_sized, partitions, written

#: Candidates of a block, at most about MOST and, where there are few, at least about LEAST.
MOST, LEAST = 1 << 16, 1 << 11
#: List entries of a dimension that are read in the first step; each step reads twice as many as the one before.
STEP = 64

_IN = "_block long, _part int, _anchor long, id long, label long, x array<long>, windows array<struct<low:long,high:long>>"
HITS = "_anchor long, _window int, id long, score long"
_HITS = pa.schema([("_anchor", pa.int64()), ("_window", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


class Lists:
    """A block of candidates with one ascending list of its rows for each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.most = int(np.abs(x).max(initial=0))
        self.values = np.take_along_axis(x, self.order, 0)
        self.exact = x.astype(np.float64)

    def scores(self, rows: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Inner products, exact: in doubles where every sum stays below 2**53, else in 64-bit integers."""
        bound = int(np.abs(a).max(initial=0)) * self.most * max(1, len(a))
        if bound >= 1 << 63:
            raise ValueError("components are too large for scores of 64 bits")
        return (self.exact[rows] @ a.astype(np.float64)).astype(np.int64) if bound < 1 << 53 else self.x[rows] @ a

    def search(self, a: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high): the rows of the k highest scores in it among allowed rows (ties: smaller id), and the scores.

        Sorted access goes down all lists at once, from the end that the anchor's sign makes the higher one; each new row
        is scored in full. The threshold is the score of a row that would stand last in every list so far. A window is done
        once the threshold is below its low end, or strictly below its k-th score; a tie could still have a smaller id.
        """
        n, dims = self.x.shape
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        seen, rows, scores, at, step = np.zeros(n, bool), [], [], 0, STEP
        if not len(up) and not len(down):  # all scores are zero, and no list orders anything
            rows, scores, at = [np.flatnonzero(allowed)], [np.zeros(int(allowed.sum()), np.int64)], n
        while at < n:
            end = min(n, at + step)
            met = np.zeros(n, bool)
            met[self.order[n - end : n - at, up]] = True
            met[self.order[at:end, down]] = True
            new = np.flatnonzero(met & ~seen & allowed)
            seen |= met
            rows.append(new)
            scores.append(self.scores(new, a))
            threshold = int(self.values[n - end, up] @ a[up] + self.values[end - 1, down] @ a[down])
            at, step = end, 2 * step
            if at < n and self._done(np.concatenate(scores), windows, k, threshold):
                break
        row, score = np.concatenate(rows or [np.empty(0, np.int64)]), np.concatenate(scores or [np.empty(0, np.int64)])
        out = []
        for low, high in windows:
            inside = np.flatnonzero((score >= low) & (score <= high))
            first = inside[np.lexsort((self.ids[row[inside]], -score[inside]))[:k]]
            out.append((row[first], score[first]))
        return out

    @staticmethod
    def _done(score: np.ndarray, windows: list[tuple[int, int]], k: int, threshold: int) -> bool:
        for low, high in windows:
            if threshold < low:
                continue
            inside = score[(score >= low) & (score <= high)]
            if len(inside) < k or np.partition(inside, len(inside) - k)[len(inside) - k] <= threshold:
                return False
        return True


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length from a column of lists."""
    flat, n = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), len(column)
    lengths = np.diff(column.offsets.to_numpy())
    if n and (lengths != lengths[0]).any():
        raise ValueError("vectors of different sizes")
    return flat.reshape(n, -1) if n else np.empty((0, 0), np.int64)


def _searching(k: int, same: bool) -> Callable:
    """Tasks that read blocks one after the other, each one's candidates before its anchors, and hold one block's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, lists = None, [], None
        for batch in batches:
            blocks, part = batch.column("_block").to_numpy(), batch.column("_part").to_numpy()
            turn = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (part[1:] != part[:-1]), [True])))
            for start, end in zip(turn[:-1].tolist(), turn[1:].tolist()):
                piece = batch.slice(start, end - start)
                if blocks[start] != block:
                    block, waiting, lists = blocks[start], [], None
                if part[start] == 0:
                    waiting.append((piece.column("id").to_numpy(), piece.column("label").to_numpy(), _matrix(piece.column("x"))))
                    continue
                if lists is None and waiting:
                    if len({x.shape[1] for _, _, x in waiting}) > 1:
                        raise ValueError("vectors of different sizes")
                    lists, waiting = Lists(*[np.concatenate(z) for z in zip(*waiting)]), []
                if lists is not None:
                    yield from answers(lists, piece)

    def answers(lists: Lists, anchors: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, windows = _matrix(anchors.column("x")), anchors.column("windows").to_pylist()
        if x.shape[1] != lists.x.shape[1]:
            raise ValueError("vectors of different sizes")
        out = []
        for a, own, label, number, wanted in zip(x, anchors.column("id").to_pylist(), anchors.column("label").to_pylist(), anchors.column("_anchor").to_pylist(), windows):
            allowed = (lists.labels == label if same else lists.labels != label) & (lists.ids != own)
            bounds = [(w["low"], w["high"]) for w in wanted] if wanted else [(-(1 << 63), (1 << 63) - 1)]
            for w, (rows, scores) in enumerate(lists.search(a, allowed, bounds, k)):
                out.append((np.full(len(rows), number), np.full(len(rows), w, np.int32), lists.ids[rows], scores))
        if out:
            yield pa.record_batch([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), _HITS.types)], schema=_HITS)

    return run


def _search(candidates: DataFrame, anchors: DataFrame, n: int, k: int, same: bool) -> DataFrame:
    """HITS of anchors (with windows) in the candidates of the same _block; n blocks. The k best for each anchor and window of all."""
    columns = lambda df, part, windows: df.select("_block", F.lit(part).alias("_part"), F.col("_row").alias("_anchor"), "id", "label", "x", windows.alias("windows"))
    none = F.lit(None).cast("array<struct<low:long,high:long>>")
    both = columns(candidates, 0, none).unionByName(columns(anchors, 1, F.col("windows")))
    found = both.repartition(n, "_block").sortWithinPartitions("_block", "_part").mapInArrow(_searching(k, same), HITS)
    place = Window.partitionBy("_anchor", "_window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """For each anchor row (where `anchor` holds) and each of its positives, the hardest rows of other labels.

    Components become floor(scale * x); a score is the integer inner product of two rows; higher scores come first, ties
    by the smaller key. An anchor's positives are its first `positives` rows of its label with another key; a positive's
    negatives are the first `negatives` rows of other labels with low % to high % of the positive's score.

    Anchors are the stated query set against all rows. They are searched for in blocks of bounded size: first in the
    blocks of their own label (a frequent label has several), which gives the positives and so the windows, then in
    all blocks. A task reads one block's candidates, sorts a list for each dimension, and runs the threshold algorithm
    for the anchors as they come; each block gives its best few, which are merged.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score; keys and labels are integers.
    Rows with a null key, label or vector, or a null or non-finite component take no part. Rows that are equal in key,
    label and components count once; rows that share only the key are different rows. Vectors of different sizes and scores beyond 64 bits are errors. An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    value = F.col(vector)
    whole = F.col(key).isNotNull() & F.col(label).isNotNull() & value.isNotNull() & F.forall(value, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where(whole).select(
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.transform(value, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long")).alias("x"),
        F.coalesce(anchor, F.lit(False)).alias("_asks"),
    )
    rows = rows.groupBy("id", "label", "x").agg(F.max("_asks").alias("_asks"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    size = max(LEAST, min(MOST, n // (4 * partitions(spark))))
    blocks = max(1, -(-n // size))

    # In the blocks of an anchor's label: block = hash of (label, number of the block among those of the label).
    labels = rows.groupBy("label").agg(F.count("*").alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / size))
    placed = join_sized(rows, labels, "label", "_n", n)
    own = placed.withColumn("_block", F.xxhash64("label", F.pmod(F.xxhash64("_row"), F.col("_blocks"))))
    asking = placed.where("_asks").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).withColumn("_block", F.xxhash64("label", "_block"))
    near = _search(own, asking.withColumn("windows", F.lit(None).cast("array<struct<low:long,high:long>>")), max(blocks, partitions(spark)), positives, True)

    # In all blocks, with a window for each positive.
    found = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))  # `positives` of them at most
    near = written(near.groupBy("_anchor").agg(found.alias("positives")), "positives")
    windows = F.transform("positives", lambda p: F.struct(_ceil(p["score"] * low).alias("low"), _floor(p["score"] * high).alias("high")))
    asking = rows.where("_asks").join(near, F.col("_row") == F.col("_anchor")).withColumn("windows", windows)
    everywhere = asking.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    hard = _search(rows.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks))), everywhere, blocks, negatives, False)

    positive = F.element_at("positives", F.col("_window") + 1)
    return (
        hard.withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        .join(asking.select("_anchor", F.col("id").alias("anchor_id"), "positives"), "_anchor")
        .select("anchor_id", positive["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", positive["score"].alias("positive_score"), "negative_score")
    )


def _floor(x: Column) -> Column:
    """Hundredths of a whole number, rounded down, exactly."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def _ceil(x: Column) -> Column:
    return -_floor(-x)
