"""A stored inverted index of trigrams and characters, for literal and similarity search of terms in chunks."""

from __future__ import annotations

from math import ceil, log
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import texts as X
from ..sources.shared import new_folder

#: Columns of a chunk that may hold a term; postings have their places in this list.
FIELDS = ("section_title", "document_title", "search_text")
TEXT = FIELDS.index("search_text")
LEAST_SIMILARITY = 0.3
#: Sizes (numbers of trigrams) of a band differ by less than this factor.
BAND, LAST_BAND = 1.25, 60

_POSTINGS = "gram STRING, band INT, field INT, size INT, chunk_id BIGINT"
_SETS = "chunk_id BIGINT, size INT, grams ARRAY<STRING>"


def _band(size: Column) -> Column:
    return F.least(F.floor(F.log(F.greatest(size, F.lit(1))) / log(BAND)), F.lit(LAST_BAND)).cast("int")


def _characters(c: Column) -> Column:
    """Distinct characters of lower-cased text, and the empty string, which every text holds."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(c), "")))


class KeywordIndex:
    """Postings (gram, size band, field, size, chunk) bucketed and sorted by gram, and the trigrams of each text.

    A gram is a trigram of a padded word (length 3) or a single character (length 1, for terms without a trigram). The
    index is built by one pass over the chunks and one shuffle; a search reads it in its buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        """The index at `path`, as another session may have written it."""
        self.spark, self.path, self.buckets = spark, path, buckets
        self._postings, self._sets = (f"keyword_{name}_{uuid4().hex}" for name in ("postings", "sets"))
        spark.sql(f"CREATE TABLE {self._postings} ({_POSTINGS}) USING parquet CLUSTERED BY (gram) SORTED BY (gram) INTO {buckets} BUCKETS LOCATION '{path}/postings'")
        spark.sql(f"CREATE TABLE {self._sets} ({_SETS}) USING parquet LOCATION '{path}/sets'")

    @classmethod
    def build(cls, chunks: DataFrame, path: str | None = None, buckets: int | None = None) -> KeywordIndex:
        """Writes the index of chunks (chunk_id and FIELDS) to a new folder, by default below the shared one."""
        spark = chunks.sparkSession
        index = cls(spark, path or new_folder(spark, "keyword-index"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        chunks.select("chunk_id", X.trigrams(F.col("search_text")).alias("grams")).where("grams is not null").select("chunk_id", F.size("grams").alias("size"), "grams").write.insertInto(index._sets)
        size = F.size("grams")
        posting = lambda df, field: df.select("chunk_id", F.lit(field).alias("field"), size.alias("size"), F.explode("grams").alias("gram"))
        rows = posting(index.sets, TEXT)
        for i, c in enumerate(FIELDS):
            held = chunks.select("chunk_id", X.trigrams(F.col(c)).alias("grams")) if i != TEXT else None
            rows = rows.unionByName(posting(held, i)) if held is not None else rows
            # Characters stand under the size 0: a term without a trigram asks for no size.
            rows = rows.unionByName(chunks.select("chunk_id", F.lit(i).alias("field"), F.lit(0).alias("size"), F.explode(_characters(F.col(c))).alias("gram")))
        rows.select("gram", _band(F.col("size")).alias("band"), "field", "size", F.col("chunk_id").cast("long").alias("chunk_id")).repartition(index.buckets, "gram").write.insertInto(index._postings)
        return index

    @property
    def postings(self) -> DataFrame:
        return self.spark.table(self._postings)

    @property
    def sets(self) -> DataFrame:
        return self.spark.table(self._sets)

    def _counted(self, grams: DataFrame) -> DataFrame:
        """grams (with a column gram) with n, the number of postings of each gram; 0 if there are none."""
        asked = grams.select("gram").distinct()
        n = self.postings.join(asked, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
        return grams.join(n, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def may_contain(self, terms: DataFrame) -> DataFrame:
        """(key, field, chunk_id) where the field may hold the term of terms(key, term) in any case; none is missed.

        A text that holds a term holds the trigrams inside the term's words, or, if it has none, its characters. The
        rarest of these, by the index, leads to the candidates: postings of texts with at least as many trigrams.
        """
        inner = X.inner_trigrams(F.col("term"))
        grams = terms.where(F.col("term").isNotNull()).select("key", F.size(inner).alias("_inner"), F.when(F.size(inner) > 0, inner).otherwise(_characters(F.col("term"))).alias("_grams"))
        rarest = self._counted(grams.select("key", "_inner", F.explode("_grams").alias("gram"))).groupBy("key", "_inner").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
        return self.postings.join(rarest, "gram").where(F.col("size") >= F.col("_inner")).select("key", "field", "chunk_id")

    def similar(self, terms: DataFrame) -> DataFrame:
        """(key, chunk_id, similarity) of terms(key, term) and texts that share LEAST_SIMILARITY of all their trigrams or more.

        Sets of sizes a and b are similar if they share need(b) = (a + b) * s / (1 + s) trigrams or more. So for texts of one
        band of sizes, the most frequent trigrams of a term, one fewer than they must share at least, needn't meet any
        posting: the rarer ones lead to every similar text. The longer the texts, the fewer of them are needed, and only
        bands that the size allows are met. A text that has too few of the rarer ones to reach need(b) with all the
        frequent ones is dropped by its count; of the pairs that are left, the sets are compared.
        """
        needed = lambda size: F.ceil((F.col("_a") + size) * (LEAST_SIMILARITY / (1 + LEAST_SIMILARITY)) - 1e-9)
        asked = terms.where(F.col("term").isNotNull()).select("key", X.trigrams(F.col("term")).alias("_grams")).withColumn("_a", F.size("_grams")).where("_a > 0")
        ranked = self._counted(asked.select("key", "_a", F.explode("_grams").alias("gram"))).withColumn("_place", F.row_number().over(Window.partitionBy("key").orderBy("n", "gram")))
        least, most = F.ceil(F.col("_a") * LEAST_SIMILARITY - 1e-9), F.floor(F.col("_a") / LEAST_SIMILARITY + 1e-9)
        edges = F.array(*[F.lit(ceil(BAND**i - 1e-6)).cast("long") for i in range(LAST_BAND + 1)])
        smallest = F.greatest(F.col("_from"), F.element_at(edges, F.col("band") + 1))
        rarer = ranked.where(F.col("_place") <= F.col("_a") - needed(least) + 1).select("key", "_a", "_place", "gram", least.alias("_from"), most.alias("_to"))
        met = self.postings.where(F.col("field") == TEXT).join(rarer, "gram").where("size between _from and _to")
        met = met.withColumn("_skip", needed(smallest) - 1).where(F.col("_place") <= F.col("_a") - F.col("_skip"))
        enough = met.select("key", "chunk_id", (needed(F.col("size")) - F.col("_skip")).alias("_least"))
        counted = enough.groupBy("key", "chunk_id", "_least").agg(F.count("*").alias("_n")).where("_n >= _least")
        pairs = counted.select("key", "chunk_id").join(asked, "key").join(self.sets, "chunk_id")
        shared = F.size(F.array_intersect("grams", "_grams"))
        found = pairs.select("key", "chunk_id", (shared / (F.col("_a") + F.col("size") - shared)).alias("similarity"))
        return found.where(F.col("similarity") >= LEAST_SIMILARITY)
