"""Operator 12: exact deduplication against a persistent index of digests, bucketed and sorted by digest."""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_sized, partitions, shared_dir, written

_BATCHES = "batch int, attempt string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    # Of pure ASCII, lower() changes A-Z only, and it is the faster of the two.
    return F.when(F.octet_length(body) == F.char_length(body), F.lower(body)).otherwise(F.translate(body, UPPER, LOWER))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, digest (SHA-256 of the normalised text) and row, a number of its own, of every row: written to the shared folder.

    The only pass over the texts. The numbers are fixed once they are written.
    """
    rows = docs.select(F.col(key).alias("key"), F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256)).alias("digest"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


class DigestIndex:
    """Digests of all texts seen so far, in a Parquet table below `path`, bucketed and sorted by digest.

    A batch of digests() is added by `add`: a sort-merge anti-join finds the digests that the index doesn't hold, and
    these are appended with the row that stays. The table's buckets are read as they are; only the batch is shuffled.
    Every batch also leaves the number of its rows per digest, so that group sizes need no second pass over older rows.
    A batch counts once it is named in the `batches` table, which is written last; what an interrupted attempt has
    written stays unread, and the batch can be added again. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint", buckets: int | None = None):
        """A new index, or the one at `path`, which keeps the key type and the number of buckets of its start."""
        self.spark, self.path, self.name = spark, path, f"digest_index_{uuid4().hex}"
        try:
            key_type, self.buckets = spark.read.parquet(f"{path}/settings").select("key_type", "buckets").first()
            old = True
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            old, self.buckets = False, buckets or partitions(spark)
            spark.createDataFrame([], _BATCHES).write.parquet(f"{path}/batches")
            spark.createDataFrame([(key_type, self.buckets)], "key_type string, buckets int").coalesce(1).write.parquet(f"{path}/settings")
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, key {key_type}, row BIGINT, n BIGINT, attempt STRING, fresh BOOLEAN) USING parquet "
            f"PARTITIONED BY (attempt, fresh) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/entries'"
        )
        if old:
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def batches(self) -> dict[int, str]:
        """The batches that were added whole, each with the attempt that did it."""
        return {r["batch"]: r["attempt"] for r in self.spark.read.schema(_BATCHES).parquet(f"{self.path}/batches").collect()}

    def entries(self) -> DataFrame:
        return self.spark.table(self.name).where(F.col("attempt").isin([*self.batches().values()]))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Adds a batch of digests(). Of equal texts in it, the row with the largest key stays (null is the smallest; of
        equal keys, the last row), unless the index holds the text already. A batch that was added before is an error."""
        if batch in self.batches():
            raise ValueError(f"batch {batch} is in the index already")
        attempt = uuid4().hex
        groups = rows.groupBy("digest").agg(F.max(F.struct("key", "row")).alias("last"), F.count("*").alias("n"))
        groups = groups.select("digest", "last.key", "last.row", "n", F.lit(attempt).alias("attempt"))
        held = self.entries().where("fresh").select("digest").hint("merge")
        new = groups.join(held, "digest", "left_anti").withColumn("fresh", F.lit(True))
        known = groups.join(held, "digest", "left_semi").withColumn("fresh", F.lit(False))
        new.unionByName(known).write.insertInto(self.name)
        self.spark.createDataFrame([(batch, attempt)], _BATCHES).coalesce(1).write.mode("append").parquet(f"{self.path}/batches")

    def resolve(self, rows: DataFrame) -> DataFrame:
        """digest, key, row, keep_key and keep_row (those of the row that stays) and group_size of rows of digests().

        The index says how many rows a text has, so a text of many rows is joined by a bounded broadcast, and the others
        by a shuffle in which no digest is frequent. Rows whose digest was never added are left out.
        """
        entries = self.entries()
        first = F.max(F.when(F.col("fresh"), F.struct("key", "row"))).alias("first")
        texts = entries.groupBy("digest").agg(F.sum("n").alias("group_size"), first)
        texts = texts.select("digest", "group_size", F.col("first.key").alias("keep_key"), F.col("first.row").alias("keep_row"))
        return join_sized(rows, texts, "digest", "group_size", entries.agg(F.sum("n")).first()[0] or 0)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 2, path: str | None = None) -> DataFrame:
    """Exact duplicates of all rows of docs, through a new index; texts are equal when they are after A-Z became a-z.

    Rows are added in `batches` of falling keys (cut at approximate quantiles), so the row with the largest key of all
    comes first and stays; each later batch is new data to the index. A numeric key is needed for more than one batch.

    Returns one row a row: key, keep_id, group_size, kept and text_sha256 (hex, of the normalised text). A null text
    counts as empty. A null key is smaller than every other; of rows with equal keys and texts exactly one is kept.
    An empty table gives an empty result; other columns of docs are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = digests(docs, key, text)
    index = DigestIndex(spark, path or f"{shared_dir(spark).rstrip('/')}/digest-index-{uuid4().hex}", dict(rows.dtypes)["key"])
    edges = sorted(set(rows.stat.approxQuantile("key", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    left = rows
    for batch, edge in enumerate([*reversed(edges), None]):
        above = F.lit(True) if edge is None else F.coalesce(F.col("key") > edge, F.lit(False))
        index.add(left.where(above), batch)
        left = left.where(~above)
    return index.resolve(rows).select(
        F.col("key").alias(key),
        F.col("keep_key").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
