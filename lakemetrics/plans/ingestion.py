"""Registered queries of ingest, ledger, arrivals and refresh: raw files are written from the given tables and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, gold, ingest, quality
from ..sources import rawfiles as raw
from ..sources import shared
from ..sources import testviews as tv
from ..sources.ledger import Store, fingerprint, ingest_folder
from ..streaming.arrivals import ingest_arrivals
from .metrics import _COUNTS, _daily_sql, _distinct, doubles

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: The sample of users.
MODULUS, RESIDUE = 3, 1


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _sampled(sql: str) -> str:
    return sql.format(MODULUS, RESIDUE)


def _dirty(spark: SparkSession, d: str) -> ingest.Silver:
    return ingest.read_silver(spark, raw.write(spark, d, dirty=True), MODULUS, RESIDUE)


@query("ingest_users", f"WITH {_sampled(raw.USERS)} SELECT user_id, CAST(age_range AS BIGINT) AS age_range, CAST(gender AS BIGINT) AS gender FROM u")
def users(spark: SparkSession, d: str) -> DataFrame:
    return doubles(_dirty(spark, d).users)


@query("ingest_events", f"WITH {raw.log_sql(True)}, {_sampled(raw.EVENTS)} SELECT * REPLACE (CAST(event_date AS VARCHAR) AS event_date) FROM v")
def events(spark: SparkSession, d: str) -> DataFrame:
    return doubles(_dirty(spark, d).user_events)


@query("ingest_samples", f"WITH {_sampled(raw.SAMPLES)} SELECT user_id, merchant_id, dataset_split, CAST(label AS BIGINT) AS label, CAST(probability AS DOUBLE) AS probability FROM s")
def samples(spark: SparkSession, d: str) -> DataFrame:
    return doubles(_dirty(spark, d).repurchase_samples)


@query("ingest_rejects", f"""WITH {raw.log_sql(True)}, {_sampled(raw.REJECTS)} SELECT 'events' AS file, source_row, category, "column" FROM r""")
def rejects(spark: SparkSession, d: str) -> DataFrame:
    return _dirty(spark, d).rejects


_COUNTED = f"""WITH {raw.log_sql(False)}, {_sampled(raw.EVENTS)}, {_sampled(raw.USERS)}, {_sampled(raw.SAMPLES)}, counted AS (
    SELECT 'users' AS name, count(*) AS n FROM u UNION ALL SELECT 'user_events', count(*) FROM v UNION ALL SELECT 'repurchase_samples', count(*) FROM s UNION ALL SELECT 'raw_users', count(*) FROM customer
    UNION ALL SELECT 'raw_events', count(*) FROM l UNION ALL SELECT 'raw_train', count(*) FROM labels WHERE doc_id % 5 <> 0 UNION ALL SELECT 'raw_test', count(*) FROM labels WHERE doc_id % 5 = 0)"""


@query("ingest_dry_run", f"{_COUNTED} SELECT * FROM counted")
def dry_run(spark: SparkSession, d: str) -> DataFrame:
    counts = ingest.dry_run(ingest.read_silver(spark, raw.write(spark, d), MODULUS, RESIDUE))
    return spark.createDataFrame(list(counts.items()), "name string, n long")


def _store(spark: SparkSession, d: str) -> tuple[Store, str]:
    """A store with the published run of the clean raw files, and their folder."""
    store, folder = Store(spark, shared.new_folder(spark, "store")), raw.write(spark, d)
    ingest_folder(store, folder, MODULUS, RESIDUE)
    return store, folder


@query(
    "ingest_ledger",
    f"""{_COUNTED} SELECT 1 AS run_id, 'succeeded' AS status, (SELECT sum(n) FROM counted WHERE name LIKE 'raw%')::BIGINT AS raw_row_count, (SELECT sum(n) FROM counted WHERE name NOT LIKE 'raw%')::BIGINT AS imported_row_count, 'skip' AS again
    UNION ALL SELECT 2, 'failed', NULL, NULL, 'refuse'""",
)
def ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger after a successful run and one that failed on rejects; and what is decided about the input of each now."""
    store, folder = _store(spark, d)
    bad = raw.write(spark, d, dirty=True)
    try:
        ingest_folder(store, bad, MODULUS, RESIDUE, replace=True)
    except ingest.IngestError:
        pass
    again = {n: store.decide(fingerprint(spark, f), MODULUS, RESIDUE).select(F.lit(n).cast("long").alias("run_id"), F.col("action").alias("again")) for n, f in ((1, folder), (2, bad))}
    return store.runs().select("run_id", "status", "raw_row_count", "imported_row_count").join(again[1].unionByName(again[2]), "run_id")


_PUBLISHED = f"WITH {raw.log_sql(False)}, {_sampled(raw.EVENTS)}"


@query("published_categories", f"{_PUBLISHED} SELECT category_id, count(*) AS event_count, {_distinct('user', 'item', 'merchant')}, {_COUNTS} FROM v GROUP BY ALL")
def published(spark: SparkSession, d: str) -> DataFrame:
    """A metric table as readers of the store see it, after a second run failed."""
    store, _ = _store(spark, d)
    try:
        ingest_folder(store, raw.write(spark, d, dirty=True), MODULUS, RESIDUE, replace=True)
    except ingest.IngestError:
        pass
    return store.table("category_metrics").drop("buy_user_count", "buy_user_rate")


def _copy_files(spark: SparkSession, folder: str) -> None:
    """Copies each Parquet file of a folder to another name in it."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    system = fs.Path(folder).getFileSystem(conf)
    for found in system.globStatus(fs.Path(folder, "*.parquet")):
        path = found.getPath()
        fs.FileUtil.copy(system, path, system, fs.Path(folder, f"copy-of-{path.getName()}"), False, conf)


@query("arriving_files", f"SELECT * REPLACE (CAST(metric_date AS VARCHAR) AS metric_date) FROM ({_daily_sql(tv.STREAM)})")
def arriving(spark: SparkSession, d: str) -> DataFrame:
    """Daily metrics after files arrived four times: twice new ones, then nothing, then a copy of each under another name.

    Each file also holds its number, so that two files of equal events aren't copies of one another.
    """
    root, stream = shared.new_folder(spark, "arrivals"), tv.stream_events(spark, d)
    folder, schema = f"{root}/in", ", ".join(f"{n} {k}" for n, k in stream.dtypes)
    stream = stream.withColumn("file_number", F.spark_partition_id())
    for part in (stream.where("item_id % 2 = 0"), stream.where("item_id % 2 <> 0 or item_id is null"), None, "copies"):
        if part == "copies":
            _copy_files(spark, folder)
        elif part is not None:
            part.write.option("maxRecordsPerFile", 0).mode("append").parquet(folder)
        ingest_arrivals(spark, folder, schema, f"{root}/events", f"{root}/metrics", f"{root}/checkpoint")
    return doubles(spark.read.parquet(f"{root}/metrics/daily_metrics"))


def _counted(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


@query(
    "repeated_refresh",
    f"""WITH {tv.BEHAVIOUR}, {tv.SAMPLES}, c AS (SELECT 'daily_metrics' AS t, count(DISTINCT (event_date, action_type)) AS n FROM e UNION ALL SELECT 'merchant_metrics', count(DISTINCT merchant_id) FROM e UNION ALL SELECT 'category_metrics', count(DISTINCT category_id) FROM e
        UNION ALL SELECT 'user_metrics', count(DISTINCT user_id) FROM e UNION ALL SELECT 'funnel_metrics', count(DISTINCT action_type) FROM e UNION ALL SELECT 'repurchase_metrics', count(DISTINCT (dataset_split, coalesce(label, 2))) FROM s)
    SELECT 'same ' || t AS "check", true AS passed, CAST(n AS VARCHAR) AS actual, CAST(n AS VARCHAR) AS expected, '' AS detail FROM c""",
)
def repeated(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of the metric tables after a refresh, and after a second one over it."""
    where, counts = shared.new_folder(spark, "refresh"), []
    # Joined once, and shuffled once for each clustering, not by each part of each of the tables.
    events = gold.clustered(shared.staged(tv.behaviour(spark, d), "events"), f"{where}/events")
    for k in range(2):
        gold.write_tables(events, tv.samples(spark, d), where)
        _counted({n: spark.read.parquet(f"{where}/{n}") for n in gold.TABLES}).write.parquet(f"{where}/counts-{k}")
        counts.append(spark.read.parquet(f"{where}/counts-{k}"))
    return quality.same_counts(*counts)


@query("strict_utf8", "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN md5(text) END AS digest FROM documents WHERE text IS NOT NULL")
def strict_utf8(spark: SparkSession, d: str) -> DataFrame:
    """Documents as bytes; every seventh has a byte more that is no UTF-8."""
    body = F.col("text").cast("binary")
    files = tv.documents(spark, d).where("text is not null").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(body, F.unhex(F.lit("FF")))).otherwise(body).alias("content"))
    good, bad = corpus.decode_utf8(files)
    return good.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest")).unionByName(bad.select("doc_id", F.lit(None).cast("string").alias("digest")))


@query(
    "document_list",
    "SELECT source AS source_file, 'Source ' || source AS document_title, count(*) AS chunk_count, CAST(min(doc_id) AS VARCHAR) AS created_at, CAST(max(doc_id) AS VARCHAR) AS updated_at, row_number() OVER (ORDER BY max(doc_id) DESC, source) AS position FROM documents WHERE source IS NOT NULL GROUP BY source",
)
def document_list(spark: SparkSession, d: str) -> DataFrame:
    stamp = lambda c: F.timestamp_seconds(c)
    seen = tv.documents(spark, d).where("source is not null").groupBy(F.col("source").alias("source_file")).agg(F.concat(F.lit("Source "), F.first("source")).alias("document_title"), F.count("*").alias("chunk_count"), stamp(F.min("doc_id")).alias("created_at"), stamp(F.max("doc_id")).alias("updated_at"))
    # A table written from sorted rows keeps their order in its parts, so the rows number themselves as files are numbered.
    where = shared.new_folder(spark, "documents")
    corpus.document_list(seen).write.parquet(where)
    listed = ingest.numbered(spark.read.parquet(where), "position")
    seconds = lambda c: F.unix_seconds(c).cast("string").alias(c)
    return listed.select("source_file", "document_title", "chunk_count", seconds("created_at"), seconds("updated_at"), "position")


@query("enriched_chunks", "SELECT doc_id, CASE WHEN length(text) <= 3000 THEN length(text) END AS size FROM documents WHERE text IS NOT NULL")
def enriched(spark: SparkSession, d: str) -> DataFrame:
    """The seam for external models, with a function that fails on long texts."""

    def measure(texts: list[str]) -> list[int]:
        if any(len(t) > 3000 for t in texts):
            raise ValueError("too long")
        return [len(t) for t in texts]

    docs = tv.documents(spark, d).where("text is not null").select("doc_id", "text")
    return corpus.enrich(docs, measure, "size", "long", batch=1, of="text").select("doc_id", "size")


@query("backfilled_chunks", "SELECT doc_id AS chunk_id, md5(CASE WHEN doc_id % 4 = 0 THEN upper(lang) ELSE concat_ws(chr(10), source, lang, text) END) AS digest FROM documents WHERE text IS NOT NULL")
def backfilled(spark: SparkSession, d: str) -> DataFrame:
    base = corpus.base_search_text(F.col("source"), F.col("lang"), F.col("text"))
    rows = tv.documents(spark, d).where("text is not null").select(F.col("doc_id").alias("chunk_id"), "lang", base.alias("search_text"))
    done = rows.where("chunk_id % 4 = 0").select("chunk_id", F.upper("lang").alias("search_text"))
    return corpus.backfilled(rows.drop("lang"), done).select("chunk_id", F.md5(F.col("search_text").cast("binary")).alias("digest"))
