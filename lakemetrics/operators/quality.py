"""Data-quality checks: each gives rows (check, passed, actual, expected, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import KEYS, RULES

COLUMNS = ("check", "passed", "actual", "expected", "detail")


def _row(name: str, passed: Column, actual: Column, expected: Column, detail: Column | str = "") -> list[Column]:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return [F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), actual.cast("string").alias("actual"), expected.cast("string").alias("expected"), detail.alias("detail")]


def union(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def row_counts(tables: dict[str, DataFrame], expected: dict[str, int] | None) -> DataFrame:
    """Exact row counts; without a registered expectation a check is skipped, and passes."""
    out = []
    for name, df in tables.items():
        want = (expected or {}).get(name)
        n = df.agg(F.count("*").alias("n"))
        out.append(n.select(*_row(f"rows of {name}", F.lit(True) if want is None else F.col("n") == want, F.col("n"), F.lit(want), "skipped" if want is None else "")))
    return union(out)


def actions(events: DataFrame, expected: dict[str, int | None]) -> DataFrame:
    """Every expected action is present, with the expected count if there is one."""
    found = events.groupBy("action_type").agg(F.count("*").alias("n"))
    want = F.create_map(*[F.lit(x) for a, n in expected.items() for x in (a, n if n is not None else -1)])
    known = events.sparkSession.createDataFrame([(a,) for a in expected], "action_type string")
    joined = found.join(F.broadcast(known), "action_type", "full")
    n, w = F.coalesce("n", F.lit(0)), want[F.col("action_type")]
    return joined.select(
        F.concat(F.lit("action "), F.coalesce("action_type", F.lit("null"))).alias("check"),
        (w.isNotNull() & (n > 0) & ((w == -1) | (w == n))).alias("passed"),
        n.cast("string").alias("actual"),
        F.when(w >= 0, w.cast("string")).alias("expected"),
        F.when(w.isNull(), "unknown action").otherwise("").alias("detail"),
    )


def date_range(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """All dates lie within bounds (they needn't reach them); a table without dates fails."""
    span = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    ok = (F.col("a") >= F.lit(first).cast("date")) & (F.col("b") <= F.lit(last).cast("date"))
    return span.select(*_row(f"range of {column}", ok, F.concat_ws(" to ", F.col("a").cast("string"), F.col("b").cast("string")), F.lit(f"{first} to {last}")))


def orphans(children: DataFrame, parents: DataFrame, key: str, name: str, parent_key: str | None = None) -> DataFrame:
    """No child lacks its parent (null keys are no orphans)."""
    missing = children.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).join(parents.select(F.col(parent_key or key).alias("_k")).distinct(), "_k", "left_anti")
    return missing.agg(F.count("*").alias("n")).select(*_row(f"orphans of {name}", F.col("n") == 0, F.col("n"), F.lit(0)))


def gold_matches_silver(events: DataFrame, gold: dict[str, DataFrame]) -> DataFrame:
    """Seven pairs: event sums of five tables equal the events, and user numbers of two the distinct users."""
    silver = events.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.countDistinct("merchant_id").alias("merchants"))
    pairs = [(f"{t} events", gold[t].agg(F.sum("event_count").alias("n")), "events") for t in ("daily_metrics", "merchant_metrics", "category_metrics", "user_metrics", "funnel_metrics")]
    pairs += [("user_metrics users", gold["user_metrics"].agg(F.count("*").alias("n")), "users"), ("merchant_metrics merchants", gold["merchant_metrics"].agg(F.count("*").alias("n")), "merchants")]
    return union([g.crossJoin(silver).select(*_row(name, F.col("n") == F.col(of), F.col("n"), F.col(of))) for name, g, of in pairs])  # one row each


def same_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two tables of counts (name, n), before and after a second run, are equal."""
    joined = before.withColumnRenamed("n", "a").join(after.withColumnRenamed("n", "b"), "name", "full")
    return joined.select(F.concat(F.lit("same "), "name").alias("check"), F.col("a").eqNullSafe(F.col("b")).alias("passed"), F.col("b").cast("string").alias("actual"), F.col("a").cast("string").alias("expected"), F.lit("").alias("detail"))


def sampling(tables: dict[str, DataFrame], modulus: int, residue: int, user: str = "user_id") -> DataFrame:
    """No row of any table belongs to a user outside the sample."""
    off = F.pmod(F.col(user).cast("long"), F.lit(modulus)) != residue
    return union([df.agg(F.count_if(off).alias("n")).select(*_row(f"sample of {name}", F.col("n") == 0, F.col("n"), F.lit(0))) for name, df in tables.items()])


def constraints(df: DataFrame, table: str, rules: dict[str, str] | None = None, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Rows that break each rule of a table, in one pass, and key values that occur more than once."""
    rules = RULES.get(table, {}) if rules is None else rules
    keys = KEYS.get(table, ()) if keys is None else keys
    out = []
    if rules:
        counted = df.agg(*[F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in rules.items()])
        stacked = counted.select(F.explode(F.array(*[F.struct(F.lit(f"{table} {name}").alias("name"), F.col(name).alias("n")) for name in rules])).alias("r"))
        out.append(stacked.select(F.col("r.name").alias("check"), (F.col("r.n") == 0).alias("passed"), F.col("r.n").cast("string").alias("actual"), F.lit("0").alias("expected"), F.lit("").alias("detail")))
    if keys:
        twice = df.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n"))
        out.append(twice.select(*_row(f"{table} key", F.col("n") == 0, F.col("n"), F.lit(0), ", ".join(keys))))
    return union(out)


def retail_rules(months: DataFrame, top: DataFrame, regions: DataFrame, levels: DataFrame, orders: DataFrame, *, least_orders: int = 3000, least_months: int = 12, peak: tuple[int, int] = (11, 12), multiple: float = 1.3, top_products: set | None = None, top_region: str | None = None, level_order: tuple[str, ...] = (), value_range: tuple[float, float] = (0.0, float("inf"))) -> DataFrame:
    """The business rules of the retail area, with their thresholds as parameters.

    months: year, month, net_sales; top: product_id in rank order; regions: region, net_sales; levels: level,
    repurchase_rate; orders: one row with order_count and average_order_value.
    """
    c = F.col
    out = [orders.select(*_row("order volume", c("order_count") >= least_orders, c("order_count"), F.lit(least_orders)))]
    ranked = months.agg(F.count("*").alias("n"), F.median(c("net_sales").cast("double")).alias("m"), F.sort_array(F.collect_list(F.struct(c("net_sales").cast("double").alias("v"), "month")), False).alias("t"))
    pair = F.array_sort(F.array(c("t")[0]["month"], c("t")[1]["month"]))
    season = (c("n") >= least_months) & (pair == F.array(*[F.lit(x).cast("int") for x in sorted(peak)])) & (c("t")[1]["v"] >= multiple * c("m"))
    out.append(ranked.select(*_row("season", season, F.array_join(pair.cast("array<string>"), ","), F.lit(",".join(map(str, sorted(peak)))), F.concat(c("n").cast("string"), F.lit(" months")))))
    if top_products is not None:
        got = top.agg(F.array_sort(F.collect_set(c("product_id").cast("string"))).alias("g"))
        want = sorted(map(str, top_products))
        out.append(got.select(*_row("top products", c("g") == F.array(*map(F.lit, want)), F.array_join("g", ","), F.lit(",".join(want)))))
    if top_region is not None:
        first = regions.agg(F.max_by("region", F.struct("net_sales", "region")).alias("r"))
        out.append(first.select(*_row("top region", c("r") == top_region, c("r"), F.lit(top_region))))
    if level_order:
        rates = levels.agg(F.map_from_entries(F.collect_list(F.struct("level", c("repurchase_rate").cast("double")))).alias("r"))
        rising = reduce(lambda a, b: a & b, [c("r")[F.lit(x)] <= c("r")[F.lit(y)] for x, y in zip(level_order, level_order[1:])])
        out.append(rates.select(*_row("levels rise", rising, F.lit(",".join(level_order)), F.lit("repurchase rates in this order"))))
    out.append(orders.select(*_row("order value", (c("average_order_value") > value_range[0]) & (c("average_order_value").cast("double") <= value_range[1]), c("average_order_value"), F.lit(f"over {value_range[0]}, up to {value_range[1]}"))))
    return union(out)
