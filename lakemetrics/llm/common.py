"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contracts: space and the ASCII controls 9 to 13. Every other character belongs to a word.
SPACES = b" \t\n\x0b\x0c\r"

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan that has fewer parts than the session has cores (a small table), dealt to all of them; any other as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local session (tests) gets a new temporary folder; on a cluster that is an error, as its
    machines don't share such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: a smaller cut of the lineage than a checkpoint."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_sized(rows: DataFrame, table: DataFrame, on: str, size: str, total: int, share: int = 10_000) -> DataFrame:
    """rows joined with a table that has one row for each value of `on` and says in the column `size` how many of the
    `total` rows have it.

    Values with more than one in `share` of all rows are fewer than `share`, so their rows of the table are broadcast;
    the rest is shuffled, and no value of it is frequent.
    """
    often = table.where(F.col(size) * share > total)
    rest = rows.join(F.broadcast(often.select(on)), on, "left_anti").join(table.where(F.col(size) * share <= total), on)
    return rows.join(F.broadcast(often), on).unionByName(rest)


def through_pandas(name: str, kind: str) -> tuple[Column, str]:
    """A column as it goes through pandas, and its type there: an integer as text, as pandas would make numbers with nulls
    doubles, which are exact up to 2**53 only."""
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.col(name).cast("string"), "string"
    return F.col(name), kind


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that sums and products spread over all bits."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * _MIX_1
        x = (x ^ (x >> np.uint64(27))) * _MIX_2
        return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
    return out[:n]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of UTF-8 data."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Odd multipliers of the two polynomial byte hashes, and their inverses modulo 2**64.
BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of byte * base**position, scaled back to position 0."""
    if not len(starts):
        return np.empty(0, np.uint64)
    base = BASES[which]
    raw = np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(base, len(raw)), dtype=np.uint64)))
        back = powers(pow(base, -1, 1 << 64), len(raw) + 1)
        return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _MIX_2)


def rolling(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A hash of each run of k values of h; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * np.uint64(BASES[which]) + h[i : i + n]
        return mix(out)
