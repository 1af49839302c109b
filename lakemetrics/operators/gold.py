"""The six metric tables, always recomputed in full from behaviour events and repurchase samples.

`buy` is a record of behaviour and no order. A repeat buyer has two or more buys at the same merchant; buying at two or
more merchants is breadth. Distinct users of a day can't be added up over days.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import FUNNEL
from ..functions.numbers import rate

ACTIONS = ("click", "cart", "favorite", "buy")
#: What the metric tables need of the events in each of their clusterings.
CLUSTERINGS = {
    "user_id": ("user_id", "item_id", "merchant_id", "category_id", "event_date", "action_type"),
    "merchant_id": ("user_id", "item_id", "merchant_id", "category_id", "event_date", "action_type"),
    "item_id": ("item_id", "category_id", "event_date", "action_type"),
}
#: About so many events are in a bucket of a clustering, and so many at most.
BUCKET_ROWS, MOST_ROWS = 1 << 19, 1 << 21


@dataclass(frozen=True)
class Clustered:
    """Events, and the same in tables bucketed by user, by merchant and by item, from which the metrics are made without
    shuffling an event: what is counted of a user, merchant or item is in one bucket, so a task counts its distinct values
    by itself, and only its counts by group are shuffled. See clustered()."""

    events: DataFrame
    by: dict[str, DataFrame]

    def near(self, *columns: str) -> DataFrame:
        """The events in the clustering by the first of these columns that has one (with all of them), or as they are."""
        return next((df for c in columns if (df := self.by.get(c)) is not None and {*columns} <= {*df.columns}), self.events)


def clustered(events: DataFrame, folder: str) -> Clustered:
    """Writes the clusterings below folder: for stored events that are refreshed from several times, or are many.

    A bucket is read by one task, and there are as many as the events (which are counted first) fill. A key with so many
    events that its bucket would hold over MOST_ROWS has no clustering; what needs it shuffles the events, by more than it.
    """
    spark, by = events.sparkSession, {}
    buckets = max(spark.sparkContext.defaultParallelism, events.count() // BUCKET_ROWS + 1)
    for key, columns in CLUSTERINGS.items():
        bucket = F.pmod(F.hash(key), F.lit(buckets))  # as repartition() and bucketBy() number them
        if (events.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0) > MOST_ROWS:
            continue
        name = f"events_by_{key}_{uuid4().hex}"
        events.select(*columns).repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{key}").saveAsTable(name, format="parquet")
        by[key] = spark.table(name)
    return Clustered(events, by)


def _near(events: DataFrame | Clustered, *columns: str) -> DataFrame:
    return events.near(*columns) if isinstance(events, Clustered) else events


def _counts() -> list[Column]:
    return [F.count_if(F.col("action_type") == a).alias(f"{a}_count") for a in ACTIONS]


def _distinct(*columns: str) -> list[Column]:
    return [F.countDistinct(f"{c}_id").alias(f"{c}_count") for c in columns]


def _distinct_by(events: DataFrame | Clustered, keys: list[str], *columns: str) -> DataFrame:
    """Distinct values of columns by keys. Of clustered events each column is counted in the clustering by a key or by itself."""
    names = {c: f"{c.removesuffix('_id')}_count" for c in columns}
    if isinstance(events, DataFrame):
        return events.groupBy(*keys).agg(*[F.countDistinct(c).alias(name) for c, name in names.items()])
    parts = [events.near(*keys, c).select(*keys, c).distinct().groupBy(*keys).agg(F.count(c).alias(name)) for c, name in names.items()]
    return reduce(lambda a, b: _with(a, b, keys), parts)


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left with the other columns of right, both one row for each value of the keys, null included."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(right, same).drop(*[f"_{k}" for k in keys])


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("event_count", *(f"{a}_count" for a in ACTIONS))]


def _by_user(events: DataFrame | Clustered, group: str) -> DataFrame:
    """Events, by action too, of each group and user. Users, buyers and repeat buyers of the group are counts of these rows,
    so no event is multiplied to count distinct users, and the events are read once for all of them."""
    return _near(events, group, "user_id").groupBy(group, "user_id").agg(F.count("*").alias("event_count"), *_counts())


def daily_metrics(events: DataFrame | Clustered) -> DataFrame:
    """Counts by date and action; shares of the day's events and of the day's distinct users (taken from the detail)."""
    keys = ["event_date", "action_type"]
    by_user = _near(events, "user_id").groupBy(*keys, "user_id").agg(F.count("*").alias("_n"))
    per_action = by_user.groupBy(*keys).agg(F.sum("_n").alias("event_count"), F.count("user_id").alias("user_count"))
    joined = _with(per_action, _distinct_by(events, keys, "item_id", "merchant_id", "category_id"), keys).withColumnRenamed("event_date", "metric_date")
    day = by_user.groupBy(F.col("event_date").alias("metric_date"), "user_id").agg(F.sum("_n").alias("_n")).groupBy("metric_date").agg(F.sum("_n").alias("_events"), F.count("user_id").alias("_users"))
    return joined.join(day, "metric_date").withColumns({"event_share": rate("event_count", "_events"), "user_share": rate("user_count", "_users")}).drop("_events", "_users")


def merchant_metrics(events: DataFrame | Clustered) -> DataFrame:
    """Counts, buyers and repeat buyers of every merchant; both sides are aggregated before they are joined."""
    users = _by_user(events, "merchant_id").groupBy("merchant_id").agg(*_sums(), F.count("user_id").alias("user_count"), F.count_if(F.col("user_id").isNotNull() & (F.col("buy_count") > 0)).alias("buy_user_count"), F.count_if(F.col("buy_count") >= 2).alias("repeat_buy_user_count"))
    joined = _with(users, _distinct_by(events, ["merchant_id"], "item_id", "category_id"), ["merchant_id"])
    return joined.withColumns({"buy_user_rate": F.coalesce(rate("buy_user_count", "user_count"), F.lit(0)), "repeat_buy_user_rate": F.coalesce(rate("repeat_buy_user_count", "buy_user_count"), F.lit(0))})


def category_metrics(events: DataFrame | Clustered) -> DataFrame:
    """Counts and buyers of every category."""
    users = _by_user(events, "category_id").groupBy("category_id").agg(*_sums(), F.count("user_id").alias("user_count"), F.count_if(F.col("user_id").isNotNull() & (F.col("buy_count") > 0)).alias("buy_user_count"))
    joined = _with(users, _distinct_by(events, ["category_id"], "item_id", "merchant_id"), ["category_id"])
    return joined.withColumn("buy_user_rate", F.coalesce(rate("buy_user_count", "user_count"), F.lit(0)))


def user_metrics(events: DataFrame | Clustered) -> DataFrame:
    """Counts, active days, breadth and repeat flags, and first and last date of every user."""
    dates = [F.min("event_date").alias("first_event_date"), F.max("event_date").alias("last_event_date")]
    by_merchant = _near(events, "user_id").groupBy("user_id", "merchant_id").agg(F.count("*").alias("event_count"), *_counts(), *dates)
    merchants = by_merchant.groupBy("user_id").agg(
        *_sums(),
        F.count("merchant_id").alias("merchant_count"),
        F.count_if(F.col("buy_count") > 0).alias("buy_merchant_count"),
        F.max("buy_count").alias("_most"),
        F.min("first_event_date").alias("first_event_date"),
        F.max("last_event_date").alias("last_event_date"),
    )
    others = _distinct_by(events, ["user_id"], "item_id", "category_id", "event_date").withColumnRenamed("event_date_count", "active_days")
    joined = _with(merchants, others.withColumn("active_days", F.col("active_days").cast("int")), ["user_id"])
    return joined.withColumns({"multi_merchant_buy_flag": F.col("buy_merchant_count") >= 2, "repeat_buy_flag": F.col("_most") >= 2}).drop("_most")


def funnel_metrics(events: DataFrame | Clustered, steps: dict[str, int] | None = None, base: str = "click") -> DataFrame:
    """Users and events by action, and their rates relative to the base action (over 1 is possible; 0 without a base)."""
    steps = steps or FUNNEL
    by_user = _near(events, "user_id").where(F.col("action_type").isin(list(steps))).groupBy("action_type", "user_id").agg(F.count("*").alias("_n"))
    per = by_user.groupBy("action_type").agg(F.count("user_id").alias("user_count"), F.sum("_n").alias("event_count"))
    first = per.agg(F.max(F.when(F.col("action_type") == base, F.col("user_count"))).alias("_users"), F.max(F.when(F.col("action_type") == base, F.col("event_count"))).alias("_events"))
    order = F.create_map(*[F.lit(x) for pair in steps.items() for x in pair])
    return (
        per.crossJoin(F.broadcast(first))  # one row
        .withColumn("step_order", order[F.col("action_type")].cast("short"))
        .withColumn("user_rate", F.coalesce(rate("user_count", "_users"), F.lit(0)))
        .withColumn("event_rate", F.coalesce(rate("event_count", "_events"), F.lit(0)))
        .drop("_users", "_events")
    )


def repurchase_metrics(samples: DataFrame) -> DataFrame:
    """Samples by split and label group. positive_rate is that of the whole train split, on both of its rows."""
    group = F.when(F.col("label") == 1, "positive").when(F.col("label") == 0, "negative").otherwise("unlabeled")
    per = samples.groupBy("dataset_split", group.alias("label_group")).agg(
        F.count("*").alias("sample_count"), *_distinct("user", "merchant"), F.round(F.avg(F.when(F.col("dataset_split") == "test", F.col("probability"))), 7).cast("decimal(8,7)").alias("average_probability")
    )
    split = samples.groupBy("dataset_split").agg(F.count("*").alias("_n"), F.count_if(F.col("label") == 1).alias("_positive"))
    return per.join(split, "dataset_split").withColumn("positive_rate", F.when(F.col("dataset_split") == "train", rate("_positive", "_n"))).drop("_n", "_positive")


def action_distribution(events: DataFrame) -> DataFrame:
    """Events and date range by action."""
    return events.groupBy("action_type").agg(F.count("*").alias("event_count"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))


TABLES = {"daily_metrics": daily_metrics, "merchant_metrics": merchant_metrics, "category_metrics": category_metrics, "user_metrics": user_metrics, "funnel_metrics": funnel_metrics, "repurchase_metrics": repurchase_metrics}


def all_tables(events: DataFrame | Clustered, samples: DataFrame) -> dict[str, DataFrame]:
    """The six tables of one refresh; all but the last are made of the events."""
    return {name: make(samples if name == "repurchase_metrics" else events) for name, make in TABLES.items()}


def write_tables(events: DataFrame | Clustered, samples: DataFrame, folder: str) -> None:
    """Plans and writes the six tables at the same time, each to its directory of the folder, so that the last tasks of one
    leave no core idle. Waits for all; the error of any is raised."""

    def write(name: str) -> None:
        TABLES[name](samples if name == "repurchase_metrics" else events).write.mode("overwrite").parquet(f"{folder}/{name}")

    inherit = inheritable_thread_target(samples.sparkSession)  # the caller's job group and tags go with each
    with ThreadPoolExecutor(len(TABLES)) as pool:
        for done in [pool.submit(inherit(write), name) for name in TABLES]:
            done.result()


#: Named behaviour metrics: the column, how its rows add up, the formula, and the tables that give it by each legal dimension.
METRICS: dict[str, tuple[str, str, str, dict[str, tuple[str, str]]]] = {
    "behaviour_count": ("event_count", "sum", "sum of events", {"action": ("funnel_metrics", "action_type"), "date": ("daily_metrics", "metric_date"), "merchant": ("merchant_metrics", "merchant_id"), "category": ("category_metrics", "category_id")}),
    "action_user_count": ("user_count", "max", "distinct users of an action", {"action": ("funnel_metrics", "action_type")}),
    "buy_user_rate": ("user_rate", "max", "users of an action over users who clicked", {"action": ("funnel_metrics", "action_type")}),
    "merchant_buy_user_count": ("buy_user_count", "max", "distinct buyers of a merchant", {"merchant": ("merchant_metrics", "merchant_id")}),
    "merchant_repeat_buy_user_count": ("repeat_buy_user_count", "max", "users with two or more buys at a merchant", {"merchant": ("merchant_metrics", "merchant_id")}),
    "merchant_repeat_buy_user_rate": ("repeat_buy_user_rate", "max", "repeat buyers over buyers of a merchant", {"merchant": ("merchant_metrics", "merchant_id")}),
    "user_multi_merchant_buy_flag": ("multi_merchant_buy_flag", "max", "buys at two or more merchants", {"user": ("user_metrics", "user_id")}),
    "category_buy_user_count": ("buy_user_count", "max", "distinct buyers of a category", {"category": ("category_metrics", "category_id")}),
    "repurchase_sample_count": ("sample_count", "sum", "samples", {"split": ("repurchase_metrics", "dataset_split"), "label": ("repurchase_metrics", "label_group")}),
    "repurchase_positive_rate": ("positive_rate", "max", "positive samples over all of the train split", {"split": ("repurchase_metrics", "dataset_split")}),
    "active_user_count": ("user_id", "count", "users with any event", {"all": ("user_metrics", "")}),
}


def metric(tables: dict[str, DataFrame], name: str, dimension: str) -> DataFrame:
    """A named metric by one of its legal dimensions, from the metric tables (see all_tables()): key and value.

    Unknown names and dimensions are errors: a metric isn't defined by a dimension that its table lacks.
    """
    if name not in METRICS:
        raise ValueError(f"no metric {name}")
    column, how, _, tables_of = METRICS[name]
    if dimension not in tables_of:
        raise ValueError(f"{name} has no dimension {dimension}")
    table, key = tables_of[dimension]
    value = {"sum": F.sum, "max": F.max, "count": F.count}[how](F.col(column).cast("int") if column.endswith("_flag") else F.col(column))
    return tables[table].groupBy(F.col(key).cast("string").alias("key") if key else F.lit("all").alias("key")).agg(value.cast("double").alias("value"))
