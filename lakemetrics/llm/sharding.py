"""Operator 3: reproducible shuffle and sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 4
#: Cycle walking stops at the first value below n. The domain holds at most n + 2 * sqrt(n) + 1 values, so 64 steps fail
#: for one row number with a probability below 2**-64; such a row raises an error and is never dropped.
MOST_WALKS = 64
ROWS_A_BUCKET = 250
MOST_BUCKETS = 1 << 20
#: Equal rows that are numbered together.
RUN = 1000


def _once(x: Column, side: int, seed: int) -> Column:
    """One pass of a balanced Feistel network on pairs (left, right) below side."""
    left, right = F.call_function("div", x, F.lit(side)), x % F.lit(side)
    for i in range(ROUNDS):
        left, right = right, (left + F.pmod(F.xxhash64(right, F.lit(seed + i)), F.lit(side))) % F.lit(side)
    return left * F.lit(side) + right


def permuted(x: Column, n: int, seed: int = 7) -> Column:
    """The place of row number x (0 to n - 1) in a pseudo-random order of n rows; a bijection."""
    side = isqrt(max(n - 1, 0)) + 1
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST_WALKS)),
        _once(x, side, seed),
        lambda v, _: F.when(v < n, v).otherwise(_once(v, side, seed)),
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the permutation left its range")).cast("long"))


def row_numbers(df: DataFrame, n: int, name: str = "row_number") -> DataFrame:
    """Gives the n rows of df global row numbers 0 to n - 1, which depend on the rows alone and not on their partitioning.

    Equal rows are interchangeable, so they are counted first (with partial counts before the shuffle) and carried as one
    row for each RUN of them. These are dealt to buckets by a hash of all columns, numbered within each bucket in the
    order of all columns, and shifted by the sizes of the buckets before; in the end each is repeated as often as it
    counts. So a bucket never holds more than its share, even if all rows are equal. Only the bucket sizes (at most
    2**20 of them) are broadcast. Nulls are equal to each other.
    """
    columns = df.columns
    buckets = max(1, min(MOST_BUCKETS, -(-n // ROWS_A_BUCKET)))
    runs = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("_n") - 1, F.lit(RUN)))
    counted = df.groupBy(*columns).agg(F.count("*").alias("_n")).select(*columns, "_n", F.explode(runs).alias("_run"))
    counted = counted.withColumn("_size", F.least(F.lit(RUN), F.col("_n") - F.col("_run") * RUN)).withColumn("_bucket", F.pmod(F.xxhash64(*columns, "_run"), F.lit(buckets)).cast("int"))
    sizes = counted.groupBy("_bucket").agg(F.sum("_size").alias("_total"))
    before = sizes.select("_bucket", F.sum("_total").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    within = F.sum("_size").over(Window.partitionBy("_bucket").orderBy(*columns, "_run").rowsBetween(Window.unboundedPreceding, -1))
    first = F.coalesce("_before", F.lit(0)) + F.coalesce("_within", F.lit(0))
    placed = counted.withColumn("_within", within).join(F.broadcast(before), "_bucket")
    return placed.select(*columns, F.explode(F.sequence(first, first + F.col("_size") - 1)).alias(name))


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """Puts every row into one of `shards` shards so that the shard sizes in rows differ by one at most (law ``rows``).

    The row with number i goes to place p = permutation(i); its shard is p modulo `shards` and its slot there p divided
    by `shards`. So shard and slot of a row follow from its number, and the order is the same on every run and for
    every partitioning of the input.

    Returns key, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot and grown_shard (null under this
    law). A null text counts as no bytes (size 1, checksum 0); a null key is numbered like any other; repeated rows get
    a place each; an empty table gives an empty result; other columns of docs are ignored, whatever their names.
    """
    n = docs.count()
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    place = permuted(F.col("_number"), n, seed)
    return (
        row_numbers(rows, n, "_number")
        .withColumn("_place", place)
        .select(
            key,
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            (F.col("_place") % shards).cast("int").alias("shard"),
            F.call_function("div", F.col("_place"), F.lit(shards)).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
