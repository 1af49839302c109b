"""The given tables in the shape of the engine's logical inputs, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import money
from ..operators.ingest import decode_action


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a small table in fewer parts than the session has cores is dealt to all of them."""
    found, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour events: a line of an order is an action of its customer on its part at its supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("item_id"),
            F.col("p_type").alias("category_id"),
            F.col("l_suppkey").alias("merchant_id"),
            F.col("p_brand").alias("brand_id"),
            F.col("o_orderdate").cast("date").alias("event_date"),
            decode_action((F.col("l_linenumber") % 4).cast("string")).alias("action_type"),
        )
    )


def retail(spark: SparkSession, sf_dir: str, by_product: bool = False) -> DataFrame:
    """The retail star joined to one row for each order line: region, level, product, category, date and amounts.

    Lines meet their orders last, so that those of an order are in one task, or their products last if by_product.
    """
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("level"))
    customers = customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "region", "level")  # 25 nations
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    # Orders meet their customers before their lines, so that the lines aren't shuffled for it.
    orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("product"), F.col("p_type").alias("category"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    gross = money("l_extendedprice")
    net = F.round(gross * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")), 2).cast("decimal(14,2)")
    of_order, of_part = (orders, F.col("l_orderkey") == F.col("o_orderkey")), (parts, F.col("l_partkey") == F.col("p_partkey"))
    first, last = (of_order, of_part) if by_product else (of_part, of_order)
    return (
        lines.join(*first)
        .join(*last)
        .select(
            F.col("l_orderkey").alias("order_no"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_partkey").alias("product_id"),
            "product",
            "category",
            "region",
            "level",
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.col("l_quantity").cast("long").alias("quantity"),
            gross.cast("decimal(14,2)").alias("gross_amount"),
            net.alias("net_amount"),
        )
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repurchase samples: a label is a user's; every fifth user is in the test split, without label."""
    test = F.pmod("doc_id", F.lit(5)) == 0
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("user_id"),
        F.pmod("doc_id", F.lit(97)).alias("merchant_id"),
        F.when(test, "test").otherwise("train").alias("dataset_split"),
        F.when(~test, F.col("quality").cast("short")).alias("label"),
        F.when(test, (F.pmod("doc_id", F.lit(1000)) / 1000).cast("decimal(8,7)")).alias("probability"),
    )


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream in the shape of behaviour events: signup, purchase, view, click and error are its actions."""
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("item_id"), F.pmod("event_id", F.lit(10)).alias("category_id"), F.pmod("user_id", F.lit(7)).alias("merchant_id"), F.col("ts").cast("date").alias("event_date"), F.col("event_type").alias("action_type"))


BEHAVIOUR = """e AS (
    SELECT o_custkey AS user_id, l_partkey AS item_id, p_type AS category_id, l_suppkey AS merchant_id, p_brand AS brand_id, CAST(o_orderdate AS DATE) AS event_date,
        CASE l_linenumber % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'cart' WHEN 2 THEN 'buy' ELSE 'favorite' END AS action_type
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
STREAM = """e AS (
    SELECT user_id, event_id AS item_id, event_id % 10 AS category_id, user_id % 7 AS merchant_id, CAST(ts AS DATE) AS event_date, event_type AS action_type FROM events)"""
RETAIL = """o AS (
    SELECT l_orderkey AS order_no, o_custkey AS customer_id, l_partkey AS product_id, p_name AS product, p_type AS category, r_name AS region, c_mktsegment AS level, CAST(o_orderdate AS DATE) AS order_date,
        CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS gross_amount,
        CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(14,2)) AS net_amount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
SAMPLES = """s AS (
    SELECT doc_id AS user_id, doc_id % 97 AS merchant_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS dataset_split,
        CASE WHEN doc_id % 5 <> 0 THEN quality END AS label, CASE WHEN doc_id % 5 = 0 THEN CAST((doc_id % 1000) / 1000 AS DECIMAL(8,7)) END AS probability FROM labels)"""
