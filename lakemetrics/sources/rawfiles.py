"""The given tables as raw behaviour files, as ingest reads them, and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import FILES
from . import shared
from .testviews import table

_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _lines(spark: SparkSession, d: str, dirty: bool) -> DataFrame:
    """Order lines as log lines, in a fixed order. If dirty, some have a wrong date, action, width, item or brand, and 29
    February stays, which the year of the log doesn't have."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "MMdd").alias("day"))
    rows = table(spark, d, "lineitem").select(*_ORDER).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows if dirty else rows.where("day <> '0229'")
    kind = (F.col("l_orderkey") % 40) if dirty else F.lit(99)
    item = F.when(kind == 4, "-1").otherwise(F.col("l_partkey").cast("string"))
    brand = F.when(kind == 5, "x").when(F.col("l_partkey") % 10 == 0, "").otherwise((F.col("l_partkey") % 25).cast("string"))
    action = F.when(kind == 1, "4").otherwise((F.col("l_linenumber") % 4).cast("string"))
    short = F.concat_ws(",", F.col("o_custkey"), item, F.col("l_partkey") % 50, F.col("l_suppkey"), brand, F.when(kind == 0, "0230").otherwise(F.col("day")))
    line = F.when(kind == 2, short).otherwise(F.concat(short, F.lit(","), action, F.when(kind == 3, ",x").otherwise("")))
    return rows.orderBy(*_ORDER).select(line.alias("line"))


def _text(*columns: Column) -> Column:
    return F.concat_ws(",", *columns).alias("line")


def write(spark: SparkSession, d: str, dirty: bool = False) -> str:
    """Writes the four files (as folders of part files, with headers) and returns the folder that holds them."""
    folder = shared.new_folder(spark, "raw")
    labels = table(spark, d, "labels").orderBy("doc_id", "quality")
    key, test = F.col("doc_id"), F.col("doc_id") % 5 == 0
    customers = table(spark, d, "customer").orderBy("c_custkey").select(_text(F.col("c_custkey"), F.when(F.col("c_custkey") % 10 == 9, "").otherwise((F.col("c_custkey") % 10).cast("string")), F.col("c_custkey") % 3))
    prob = F.when(key % 3 == 0, "").otherwise(((key % 1000) / 1000).cast("decimal(8,7)").cast("string"))
    tables = {
        "users": customers,
        "events": _lines(spark, d, dirty),
        "train": labels.where(~test).select(_text(key, key % 97, F.col("quality"))),
        "test": labels.where(test).select(_text(key, key % 97, prob)),
    }
    for spec in FILES:
        # One text column named like the header; a separator that no line holds keeps the writer from quoting.
        tables[spec.key].toDF(",".join(spec.header)).write.option("header", True).option("sep", "\x01").csv(f"{folder}/{spec.file}")
    return folder


def log_sql(dirty: bool) -> str:
    """Log lines l(source_row_number, user_id, ..., kind, day, action): the SQL of _lines()."""
    kind = "l_orderkey % 40" if dirty else "99"
    where = "" if dirty else "WHERE strftime(o_orderdate, '%m%d') <> '0229'"
    return f"""l AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS source_row_number, o_custkey AS user_id, l_partkey AS item_id, l_partkey % 50 AS category_id, l_suppkey AS merchant_id,
        CASE WHEN l_partkey % 10 <> 0 THEN l_partkey % 25 END AS brand_id, strftime(o_orderdate, '%m%d') AS day, CASE l_linenumber % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'cart' WHEN 2 THEN 'buy' ELSE 'favorite' END AS action_type, {kind} AS kind
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey {where})"""


REJECTS = """r AS (SELECT source_row_number AS source_row, CASE WHEN kind IN (2, 3) THEN 'row_shape' WHEN kind IN (4, 5) THEN 'field_type' WHEN kind = 0 OR day = '0229' THEN 'invalid_date' WHEN kind = 1 THEN 'invalid_action_type' END AS category,
        CASE kind WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 'item_id' WHEN 5 THEN 'brand_id' WHEN 1 THEN CASE WHEN day = '0229' THEN 'time_stamp' ELSE 'action_type' END ELSE 'time_stamp' END AS "column"
        FROM l WHERE (user_id % {0} = {1} OR kind IN (2, 3)) AND (kind <= 5 OR day = '0229'))"""
EVENTS = """v AS (SELECT source_row_number, user_id, item_id, category_id, merchant_id, brand_id, CAST(strptime('2014' || day, '%Y%m%d') AS DATE) AS event_date, action_type FROM l WHERE user_id % {0} = {1} AND kind > 5 AND day <> '0229')"""
USERS = """u AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 10 <> 9 THEN c_custkey % 10 END AS age_range, c_custkey % 3 AS gender FROM customer WHERE c_custkey % {0} = {1})"""
SAMPLES = """s AS (SELECT doc_id AS user_id, doc_id % 97 AS merchant_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS dataset_split, CASE WHEN doc_id % 5 <> 0 THEN quality END AS label,
        CASE WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 THEN (doc_id % 1000) / 1000 END AS probability FROM labels WHERE doc_id % {0} = {1})"""
