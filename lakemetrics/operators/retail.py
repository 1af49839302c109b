"""Retail questions over the star: trend, ranking, breakdowns, repurchase, order value, contribution, and the metric catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import money, rate


def _sales() -> Column:
    return F.sum("net_amount").cast("decimal(18,2)")




def catalogue() -> dict[str, tuple[Column, tuple[str, ...]]]:
    """sales_amount, order_count, average_order_value, units and customers, with their legal dimensions."""
    every = ("month", "region", "product", "category", "level")
    return {
        "sales_amount": (_sales(), every),
        "order_count": (F.countDistinct("order_no"), every),
        "average_order_value": (F.round(_sales() / F.nullif(F.countDistinct("order_no"), F.lit(0)), 2).cast("decimal(18,2)"), ("month", "region", "level")),
        "units": (F.sum("quantity"), every),
        "customer_count": (F.countDistinct("customer_id"), ("month", "region", "level")),
    }


def metric(df: DataFrame, name: str, dims: list[str]) -> DataFrame:
    """A metric of the catalogue by legal dimensions; unknown names and dimensions are errors."""
    if name == "repurchase_rate":
        return repurchase_rate(df, *dims)
    known = catalogue()
    if name not in known:
        raise ValueError(f"no metric {name}")
    expression, legal = known[name]
    if wrong := [d for d in dims if d not in legal]:
        raise ValueError(f"{name} has no dimension {', '.join(wrong)}")
    return with_month(df).groupBy(*dims).agg(expression.alias(name))


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("order_date", "yyyy-MM"))


def monthly_trend(df: DataFrame) -> DataFrame:
    """Sales and order lines by year and month."""
    return df.groupBy(F.year("order_date").alias("year"), F.month("order_date").alias("month")).agg(_sales().alias("net_sales"), F.count("*").alias("order_count"))


def product_ranking(df: DataFrame, n: int = 10) -> DataFrame:
    """The n products with the highest sales; ties by product number."""
    return df.groupBy("product_id", "product").agg(_sales().alias("net_sales")).orderBy(F.desc("net_sales"), "product_id").limit(n)


def _rates(sums: DataFrame) -> DataFrame:
    return sums.withColumns({
        "average_order_value": F.round(F.col("net_sales") / F.nullif("order_count", F.lit(0)), 2).cast("decimal(18,2)"),
        "discount_rate": F.round((F.col("gross_sales") - F.col("net_sales")) / F.nullif("gross_sales", F.lit(0)), 4).cast("decimal(10,4)"),
        "orders_per_customer": rate("order_count", "customer_count", 4),
    })


def breakdown(df: DataFrame, *dims: str) -> DataFrame:
    """Sales, orders, customers, order value, discount rate and orders per customer by any dimensions; a rate of nothing is null."""
    out = with_month(df).groupBy(*dims).agg(
        _sales().alias("net_sales"), F.sum("gross_amount").cast("decimal(18,2)").alias("gross_sales"), F.countDistinct("order_no").alias("order_count"), F.countDistinct("customer_id").alias("customer_count"), F.sum("quantity").alias("units")
    )
    return _rates(out)


def _grouped(df: DataFrame, needs: dict[tuple[str, ...], set[str]]) -> DataFrame:
    """Sums and counts by several sets of dimensions in one pass; needs has what each set counts: orders and customers by
    their keys, and "" for sums.

    A set is grouped once with each of its keys, so distinct keys are counts of rows and a hot value of a dimension is
    spread over them; the rows of orders carry the sums. A set that counts no orders is grouped by itself for its sums, so
    each task makes its lines one row for a group. A month is a date until the end.
    """
    dims = list(dict.fromkeys(d for s in needs for d in s))
    within = [[*s, *key] for s, keys in needs.items() for key in ([k] if k else [] for k in sorted(keys)) if key or "order_no" not in keys]
    names = F.concat_ws(",", *[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims])
    added = ("net_amount", "gross_amount", "quantity")
    lines = df.withColumn("month", F.trunc("order_date", "month"))
    # Amounts of two places are added as whole cents, which is exact and faster; a long holds more than the result's type.
    cents = [c for c in added if (t := df.schema[c].dataType).typeName() == "decimal" and t.scale == 2 and t.precision <= 16]
    lines = lines.withColumns({c: (F.col(c) * 100).cast("long") for c in cents})
    details = lines.groupingSets([[F.col(c) for c in w] for w in within], *dims, "order_no", "customer_id").agg(names.alias("dimensions"), (F.grouping("customer_id") == 1).alias("_sums"), *[F.sum(c).alias(c) for c in added])
    total = {c: F.sum(F.when(F.col("_sums"), F.col(c))) for c in added}
    net, gross, units = (x.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)") if c in cents else x for c, x in total.items())
    sums = details.groupBy("dimensions", *dims).agg(
        net.cast("decimal(18,2)").alias("net_sales"), gross.cast("decimal(18,2)").alias("gross_sales"), F.count("order_no").alias("order_count"), F.count("customer_id").alias("customer_count"), units.alias("units")
    )
    return sums.withColumn("month", F.date_format("month", "yyyy-MM")) if "month" in dims else sums


def breakdowns(df: DataFrame, *sets: tuple[str, ...]) -> DataFrame:
    """breakdown() by several sets of dimensions in one pass: the star is read and shuffled once for all of them.

    `dimensions` names the set of a row, comma-joined in the order in which the dimensions are first given; dimensions
    outside the set are null. A set given twice counts once.
    """
    dims = list(dict.fromkeys(d for s in sets for d in s))
    return _rates(_grouped(df, {tuple(d for d in dims if d in s): {"order_no", "customer_id"} for s in sets}))


#: The columns of breakdowns() that are metrics of the catalogue, and what these count (see _grouped()).
_BROKEN_DOWN = {"sales_amount": "net_sales", "order_count": "order_count", "average_order_value": "average_order_value", "units": "units", "customer_count": "customer_count"}
_COUNTED = {"sales_amount": "", "order_count": "order_no", "average_order_value": "order_no", "units": "", "customer_count": "customer_id"}


def metrics(df: DataFrame, requests: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """Several metrics of the catalogue, each by its own legal dimensions, in one pass: metric, dimensions, keys and value.

    A set of dimensions meets only the keys that its metrics count: sums alone need neither orders nor customers.
    keys maps each dimension to its value (null where that is null); unknown names and dimensions are errors, as in metric().
    """
    known = catalogue()
    for name, dims in requests:
        if name not in known:
            raise ValueError(f"no metric {name}")
        if wrong := [d for d in dims if d not in known[name][1]]:
            raise ValueError(f"{name} has no dimension {', '.join(wrong)}")
    every = list(dict.fromkeys(d for _, dims in requests for d in dims))
    asked: dict[str, list[str]] = {}
    for name, dims in dict.fromkeys((name, tuple(d for d in every if d in dims)) for name, dims in requests):
        asked.setdefault(",".join(dims), []).append(name)
    value = lambda name: F.struct(F.lit(name).alias("metric"), F.col(_BROKEN_DOWN[name]).cast("double").alias("value"))
    rows = F.coalesce(*[F.when(F.col("dimensions") == label, F.array(*map(value, names))) for label, names in asked.items()])
    keys = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(d).alias("k"), F.col(d).cast("string").alias("v")) for d in every]).cast("array<struct<k:string,v:string>>"), lambda x: F.array_contains(F.split("dimensions", ","), x["k"])))
    needs = {tuple(d for d in every if d in label.split(",")): {_COUNTED[n] for n in names} for label, names in asked.items()}
    wide = _rates(_grouped(df, needs))
    return wide.select("dimensions", keys.alias("keys"), F.inline(rows)).select("metric", "dimensions", "keys", "value")


def repurchase_rate(df: DataFrame, *dims: str) -> DataFrame:
    """Customers with two or more orders among customers with orders, by dimensions (a customer's level, say)."""
    orders = with_month(df).groupBy(*dims, "customer_id").agg(F.countDistinct("order_no").alias("_orders"))
    out = orders.groupBy(*dims).agg(F.count("*").alias("customers"), F.count_if(F.col("_orders") >= 2).alias("repeat_customers"))
    return out.withColumn("repurchase_rate", rate("repeat_customers", "customers", 4))


def average_order_value(df: DataFrame, *dims: str) -> DataFrame:
    return df.groupBy(*dims).agg(_sales().alias("net_sales"), F.countDistinct("order_no").alias("order_count")).withColumn("average_order_value", F.round(F.col("net_sales") / F.nullif("order_count", F.lit(0)), 2).cast("decimal(18,2)"))


def member_contribution(df: DataFrame, level: str = "level") -> DataFrame:
    """Share of customers and of sales by level, and the gap of the two shares."""
    per = df.groupBy(level).agg(F.countDistinct("customer_id").alias("customers"), _sales().alias("net_sales"))
    total = per.agg(F.sum("customers").alias("_c"), F.sum("net_sales").alias("_s"))  # a customer has one level
    share = lambda a, b: F.round(F.col(a).cast("decimal(20,2)") / F.nullif(b, F.lit(0)).cast("decimal(20,2)"), 6).cast("decimal(10,6)")
    return (
        per.crossJoin(F.broadcast(total))  # one row
        .withColumns({"customer_share": share("customers", "_c"), "sales_share": share("net_sales", "_s")})
        .withColumn("share_gap", (F.col("sales_share") - F.col("customer_share")).cast("decimal(10,6)"))
        .drop("_c", "_s")
    )


def period_change(df: DataFrame) -> DataFrame:
    """Sales and orders by month, with their change against the month before and the same month a year before.

    The months are few (bounded by the calendar), so the window over all of them is small.
    """
    months = df.groupBy(F.trunc("order_date", "month").alias("month")).agg(_sales().alias("net_sales"), F.countDistinct("order_no").alias("order_count"))
    before = lambda n: months.select(F.add_months("month", n).alias("month"), F.col("net_sales").alias("_s"), F.col("order_count").alias("_o"))
    out = months
    for name, n in (("mom", 1), ("yoy", 12)):
        change = lambda a, b: F.round((F.col(a) - F.col(b)).cast("decimal(20,2)") / F.nullif(b, F.lit(0)).cast("decimal(20,2)"), 6).cast("decimal(18,6)")
        out = out.join(before(n), "month", "left").withColumns({f"sales_{name}": change("net_sales", "_s"), f"orders_{name}": change("order_count", "_o")}).drop("_s", "_o")
    return out


def weekend_effect(df: DataFrame) -> DataFrame:
    """Average orders and sales of a day, on weekends and weekdays."""
    daily = df.groupBy("order_date").agg(F.countDistinct("order_no").alias("_o"), _sales().alias("_s"))
    return daily.groupBy((F.weekday("order_date") >= 5).alias("is_weekend")).agg(
        F.count("*").alias("days"), rate(F.sum("_o"), F.count("*"), 4).alias("orders_a_day"), F.round(F.sum("_s") / F.count("*"), 2).cast("decimal(18,2)").alias("sales_a_day")
    )


def month_peak(months: DataFrame, value: str = "net_sales", multiple: float = 1.3) -> DataFrame:
    """Median of the monthly values, the peak month, its multiple of the median, and the second month.

    months has a row for each year and month (see monthly_trend()).
    """
    stats = months.agg(
        F.count("*").alias("months"),
        F.median(F.col(value).cast("double")).alias("median"),
        F.slice(F.sort_array(F.collect_list(F.struct(value, "year", "month")), False), 1, 2).alias("_top"),
    )
    top = lambda i: F.col("_top")[i]
    return stats.select(
        "months",
        F.round("median", 2).alias("median"),
        *[top(i)[c].alias(f"{p}_{c}") for i, p in ((0, "peak"), (1, "second")) for c in ("year", "month")],
        top(0)[value].alias("peak_value"),
        F.round(top(0)[value].cast("double") / F.col("median"), 4).alias("peak_multiple"),
        (top(0)[value].cast("double") >= multiple * F.col("median")).alias("is_peak"),
    )


def order_amounts(df: DataFrame, quantity: str, price: str, discount_rate: str) -> DataFrame:
    """Gross, discount (rounded half up, at most the gross amount) and net amount of each row, in exact decimals."""
    gross = (F.col(quantity).cast("decimal(10,0)") * money(price)).cast("decimal(14,2)")
    discount = F.least(F.round(F.col("gross_amount") * F.col(discount_rate).cast("decimal(4,2)"), 2), F.col("gross_amount")).cast("decimal(14,2)")
    return df.withColumn("gross_amount", gross).withColumn("discount_amount", discount).withColumn("net_amount", (F.col("gross_amount") - F.col("discount_amount")).cast("decimal(14,2)"))


def date_dim(spark: SparkSession, first: Column | None = None, last: Column | None = None, of: DataFrame | None = None, column: str = "order_date") -> DataFrame:
    """A row for every day from first to last, or between the dates that a table holds."""
    span = of.agg(F.min(column).alias("a"), F.max(column).alias("b")) if of is not None else spark.range(1).select(first.alias("a"), last.alias("b"))
    day = F.col("full_date")
    return span.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("full_date")).select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_id"),
        day,
        F.year(day).cast("short").alias("year"),
        F.quarter(day).cast("short").alias("quarter"),
        F.month(day).cast("short").alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.dayofmonth(day).cast("short").alias("day_of_month"),
        F.weekofyear(day).cast("short").alias("week_of_year"),
        (F.weekday(day) >= 5).alias("is_weekend"),
    )


def top_by(df: DataFrame, key: str, metric_: str, n: int = 10) -> DataFrame:
    """The n keys with the highest metric; ties by key."""
    return df.select(key, metric_).orderBy(F.desc(metric_), key).limit(n)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
