"""Questions of text blocks to hashed bins and back: the exchange that both substring operators use.

The corpus is dealt to blocks of bounded size by the hash of its rows. A block asks bins about hashes; each of its
distinct hashes goes out once, however many of its documents hold it, packed with the others for the same bin in one
binary value. A bin answers each block's questions in the order in which they came. So a passage that a third of all
documents share costs a bin one question a block, and no task ever gathers all its occurrences.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Text bytes of a block: at most about MOST, and about LEAST where the corpus is small.
MOST, LEAST = 32 << 20, 1 << 20

MESSAGE = "_bin int, _block int, _kind int, _data binary"
_MESSAGE = pa.schema([("_bin", pa.int32()), ("_block", pa.int32()), ("_kind", pa.int32()), ("_data", pa.binary())])


def count(docs: DataFrame, text: str, most: int = MOST) -> tuple[int, int]:
    """Numbers of blocks and of bins for a corpus, from its size: a block holds about `most` bytes of text at most, and a
    bin answers for about twice as many."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    few = min(4 * partitions(docs.sparkSession), size // LEAST)
    return max(1, size // most, few), max(1, size // (2 * most), few)


def deal(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """_block, _key, _text and _rest (all other columns) of every row.

    Equal rows (say of a null key and a common text) go to as many blocks as there are partitions that hold them, so
    they never meet in one task. A row's partition doesn't change when it is computed again; its place in it may.
    """
    rest = [c for c in docs.columns if c not in (key, text)]
    return docs.select(
        F.pmod(F.xxhash64(key, text, F.spark_partition_id()), F.lit(n)).cast("int").alias("_block"),
        F.col(key).cast("long").alias("_key"),
        F.col(text).alias("_text"),
        (F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("int")).alias("_rest"),
    )


def cuts(first: np.ndarray, n: int) -> np.ndarray:
    """Where the bins 0 to n - 1 begin and end in an ascending array of 64-bit hashes."""
    edges = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(first, edges), [len(first)])).astype(np.int64)


def ask(block: int, n: int, kind: int, first: np.ndarray, *more: np.ndarray) -> pa.Table:
    """Questions of one kind about the hashes `first` (ascending), with arrays of the same length that go with them."""
    at = cuts(first, n)
    full = np.flatnonzero(at[1:] > at[:-1])
    data = [pickle.dumps([a[at[b] : at[b + 1]] for a in (first, *more)], protocol=5) for b in full]
    return pa.table([pa.array(full, pa.int32()), pa.array(np.full(len(full), block), pa.int32()), pa.array(np.full(len(full), kind), pa.int32()), pa.array(data, pa.binary())], schema=_MESSAGE)


def _answering(kinds: dict[int, Callable]) -> Callable[[pa.Table], pa.Table]:
    """A bin: answers the questions of each kind, in their order, by kinds[kind](*arrays of all questions)."""

    def answer(table: pa.Table) -> pa.Table:
        out = []
        for kind, reply in kinds.items():
            asked = table.filter(pc.equal(table.column("_kind"), kind))
            if not asked.num_rows:
                continue
            found = [pickle.loads(x) for x in asked.column("_data").to_pylist()]
            ends = np.cumsum([len(x[0]) for x in found])
            replies = reply(*[np.concatenate(x) for x in zip(*found)])
            data = [pickle.dumps(r, protocol=5) for r in np.split(replies, ends[:-1])]
            out.append(pa.table([asked.column("_bin"), asked.column("_block"), asked.column("_kind"), pa.array(data, pa.binary())], schema=_MESSAGE))
        return pa.concat_tables(out)

    return answer


def answers(table: pa.Table, kind: int, dtype: type) -> np.ndarray:
    """The answers of one kind to a block, in the order in which it asked."""
    mine = table.filter(pc.equal(table.column("_kind"), kind))
    rows = sorted(zip(mine.column("_bin").to_pylist(), mine.column("_data").to_pylist()))
    return np.concatenate([pickle.loads(d) for _, d in rows]) if rows else np.empty(0, dtype)


def rounds(blocks: DataFrame, ask_first: Callable, ask_second: Callable, kinds: dict[int, Callable], finish: Callable, schema: str) -> DataFrame:
    """Two rounds of questions and answers, then finish(block, answers) for the rows of the result.

    ask_first(block) and ask_second(block, answers) give tables of ask(); kinds has the reply to each kind. Spark
    shuffles the blocks once and reads that exchange for all three uses.
    """
    of_block, reply = blocks.groupBy("_block"), _answering(kinds)
    one = of_block.applyInArrow(ask_first, MESSAGE).groupBy("_bin").applyInArrow(reply, MESSAGE)
    two = of_block.cogroup(one.groupBy("_block")).applyInArrow(ask_second, MESSAGE).groupBy("_bin").applyInArrow(reply, MESSAGE)
    return of_block.cogroup(one.unionByName(two).groupBy("_block")).applyInArrow(finish, schema)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values; len(x) - w + 1 of them. Prefix and suffix minima of pieces of w values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    if w == 1:
        return x
    pad = -len(x) % w
    y = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    front = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[w - 1 : w - 1 + n])
