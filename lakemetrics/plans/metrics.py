"""Registered queries of the behaviour and retail metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gold, retail
from ..sources import shared
from ..sources import testviews as tv

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, short and plain integers as long, dates as text, as the SQL of the queries returns them."""
    kinds = {"decimal": "double", "int": "bigint", "smallint": "bigint", "date": "string"}
    return df.select(*[F.col(c).cast(kinds[k]).alias(c) if (k := t.split("(")[0]) in kinds else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a query and its SQL, whose date columns become text."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
        return f

    return add


def rate_sql(part: str, whole: str, digits: int = 6) -> str:
    """A ratio of two counts, rounded half up in integers."""
    return f"(CASE WHEN ({whole}) = 0 THEN NULL ELSE ((2 * CAST({part} AS HUGEINT) * {10**digits} + ({whole})) // (2 * ({whole}))) / {10**digits}.0 END)"


def signed_sql(part: str, whole: str, digits: int) -> str:
    """rate_sql for a part that may be negative; both are scaled to integers."""
    a, b = f"CAST(({part}) * 100 AS HUGEINT)", f"CAST(({whole}) * 100 AS HUGEINT)"
    return f"(CASE WHEN {b} = 0 THEN NULL ELSE sign({a}) * (((2 * abs({a}) * {10**digits} + {b}) // (2 * {b})) / {10**digits}.0) END)"


_COUNTS = ", ".join(f"count(*) FILTER (action_type = '{a}') AS {a}_count" for a in gold.ACTIONS)
_BUYERS = "count(DISTINCT user_id) FILTER (action_type = 'buy') AS buy_user_count"


def _distinct(*columns: str) -> str:
    return ", ".join(f"count(DISTINCT {c}_id) AS {c}_count" for c in columns)


def _daily_sql(view: str) -> str:
    return f"""
    WITH {view}, a AS (SELECT event_date AS metric_date, action_type, count(*) AS event_count, {_distinct("user", "item", "merchant", "category")} FROM e GROUP BY ALL),
    d AS (SELECT event_date AS metric_date, count(*) AS n, count(DISTINCT user_id) AS u FROM e GROUP BY ALL)
    SELECT a.*, {rate_sql("event_count", "n")} AS event_share, {rate_sql("user_count", "u")} AS user_share FROM a JOIN d USING (metric_date)"""


def _funnel_sql(view: str, steps: dict[str, int], base: str) -> str:
    order = "CASE action_type " + " ".join(f"WHEN '{a}' THEN {n}" for a, n in steps.items()) + " END"
    return f"""
    WITH {view}, a AS (SELECT action_type, count(DISTINCT user_id) AS user_count, count(*) AS event_count FROM e WHERE {order} IS NOT NULL GROUP BY ALL),
    b AS (SELECT max(user_count) FILTER (action_type = '{base}') AS u, max(event_count) FILTER (action_type = '{base}') AS n FROM a)
    SELECT a.*, CAST({order} AS BIGINT) AS step_order, coalesce({rate_sql("user_count", "u")}, 0) AS user_rate, coalesce({rate_sql("event_count", "n")}, 0) AS event_rate FROM a, b"""


STREAM_STEPS = {"click": 1, "view": 2, "signup": 3, "purchase": 4}


@query("daily_metrics", _daily_sql(tv.BEHAVIOUR), ("metric_date",))
def daily(spark: SparkSession, d: str) -> DataFrame:
    return doubles(gold.daily_metrics(tv.behaviour(spark, d)))


@query("event_daily_metrics", _daily_sql(tv.STREAM), ("metric_date",))
def event_daily(spark: SparkSession, d: str) -> DataFrame:
    return doubles(gold.daily_metrics(tv.stream_events(spark, d)))


@query(
    "merchant_metrics",
    f"""WITH {tv.BEHAVIOUR}, a AS (SELECT merchant_id, count(*) AS event_count, {_distinct("user", "item", "category")}, {_COUNTS}, {_BUYERS} FROM e GROUP BY ALL),
    r AS (SELECT merchant_id, count(*) AS n FROM (SELECT merchant_id, user_id FROM e WHERE action_type = 'buy' GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL)
    SELECT a.*, coalesce({rate_sql("buy_user_count", "user_count")}, 0) AS buy_user_rate, coalesce(n, 0) AS repeat_buy_user_count,
        coalesce({rate_sql("coalesce(n, 0)", "buy_user_count")}, 0) AS repeat_buy_user_rate FROM a LEFT JOIN r USING (merchant_id)""",
)
def merchant(spark: SparkSession, d: str) -> DataFrame:
    return doubles(gold.merchant_metrics(tv.behaviour(spark, d)))


@query(
    "category_metrics",
    f"""WITH {tv.BEHAVIOUR}, a AS (SELECT category_id, count(*) AS event_count, {_distinct("user", "item", "merchant")}, {_COUNTS}, {_BUYERS} FROM e GROUP BY ALL)
    SELECT a.*, coalesce({rate_sql("buy_user_count", "user_count")}, 0) AS buy_user_rate FROM a""",
)
def category(spark: SparkSession, d: str) -> DataFrame:
    return doubles(gold.category_metrics(tv.behaviour(spark, d)))


@query(
    "user_metrics",
    f"""WITH {tv.BEHAVIOUR}, a AS (SELECT user_id, count(*) AS event_count, {_distinct("item", "merchant", "category")}, count(DISTINCT event_date) AS active_days, {_COUNTS},
        min(event_date) AS first_event_date, max(event_date) AS last_event_date FROM e GROUP BY ALL),
    b AS (SELECT user_id, count(*) AS m, max(n) AS most FROM (SELECT user_id, merchant_id, count(*) AS n FROM e WHERE action_type = 'buy' GROUP BY ALL) GROUP BY ALL)
    SELECT a.*, coalesce(m, 0) AS buy_merchant_count, coalesce(m >= 2, false) AS multi_merchant_buy_flag, coalesce(most >= 2, false) AS repeat_buy_flag FROM a LEFT JOIN b USING (user_id)""",
    ("first_event_date", "last_event_date"),
)
def user(spark: SparkSession, d: str) -> DataFrame:
    return doubles(gold.user_metrics(tv.behaviour(spark, d)))


@query("funnel_metrics", _funnel_sql(tv.BEHAVIOUR, gold.FUNNEL, "click"))
def funnel(spark: SparkSession, d: str) -> DataFrame:
    return doubles(gold.funnel_metrics(tv.behaviour(spark, d)))


@query("event_funnel", _funnel_sql(tv.STREAM, STREAM_STEPS, "click"))
def event_funnel(spark: SparkSession, d: str) -> DataFrame:
    return doubles(gold.funnel_metrics(tv.stream_events(spark, d), STREAM_STEPS))


@query(
    "repurchase_metrics",
    f"""WITH {tv.SAMPLES}, g AS (SELECT *, CASE label WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'unlabeled' END AS label_group FROM s),
    t AS (SELECT dataset_split, count(*) AS n, count(*) FILTER (label = 1) AS p FROM s GROUP BY ALL)
    SELECT dataset_split, label_group, count(*) AS sample_count, {_distinct("user", "merchant")},
        CAST(((2 * CAST(sum(CASE WHEN dataset_split = 'test' THEN probability END) * 10000000 AS HUGEINT) + count(probability)) // (2 * count(probability))) / 10000000.0 AS DOUBLE) AS average_probability,
        CASE WHEN dataset_split = 'train' THEN {rate_sql("any_value(p)", "any_value(n)")} END AS positive_rate
    FROM g JOIN t USING (dataset_split) GROUP BY dataset_split, label_group""",
)
def repurchase(spark: SparkSession, d: str) -> DataFrame:
    return doubles(gold.repurchase_metrics(tv.samples(spark, d)))


@query("action_distribution", f"WITH {tv.BEHAVIOUR} SELECT action_type, count(*) AS event_count, min(event_date) AS first_date, max(event_date) AS last_date FROM e GROUP BY ALL", ("first_date", "last_date"))
def actions(spark: SparkSession, d: str) -> DataFrame:
    return doubles(gold.action_distribution(tv.behaviour(spark, d)))


_NET = "CAST(sum(net_amount) AS DOUBLE) AS net_sales"
_MONTH = "strftime(order_date, '%Y-%m') AS month"


@query("monthly_trend", f"WITH {tv.RETAIL} SELECT year(order_date) AS year, month(order_date) AS month, {_NET}, count(*) AS order_count FROM o GROUP BY ALL")
def monthly_trend(spark: SparkSession, d: str) -> DataFrame:
    return doubles(retail.monthly_trend(tv.retail(spark, d)))


@query("product_ranking", f"WITH {tv.RETAIL} SELECT product_id, product, CAST(s AS DOUBLE) AS net_sales FROM (SELECT product_id, product, sum(net_amount) AS s FROM o GROUP BY ALL ORDER BY s DESC, product_id LIMIT 10)")
def product_ranking(spark: SparkSession, d: str) -> DataFrame:
    return doubles(retail.product_ranking(tv.retail(spark, d, by_product=True)))


@query("region_sales", f"WITH {tv.RETAIL} SELECT region, {_NET}, count(DISTINCT order_no) AS order_count FROM o GROUP BY ALL")
def region_sales(spark: SparkSession, d: str) -> DataFrame:
    return doubles(retail.breakdown(tv.retail(spark, d), "region").select("region", "net_sales", "order_count"))


@query(
    "member_repurchase",
    f"""WITH {tv.RETAIL}, c AS (SELECT level, customer_id, count(DISTINCT order_no) AS n FROM o GROUP BY ALL)
    SELECT level, count(*) AS customers, count(*) FILTER (n >= 2) AS repeat_customers, {rate_sql("count(*) FILTER (n >= 2)", "count(*)", 4)} AS repurchase_rate FROM c GROUP BY ALL""",
)
def member_repurchase(spark: SparkSession, d: str) -> DataFrame:
    return doubles(retail.repurchase_rate(tv.retail(spark, d), "level"))


def _aov(n: str = "count(DISTINCT order_no)") -> str:
    return f"((2 * CAST(sum(net_amount) * 100 AS HUGEINT) + {n}) // (2 * {n})) / 100.0"


@query("average_order_value", f"WITH {tv.RETAIL} SELECT region, {_NET}, count(DISTINCT order_no) AS order_count, {_aov()} AS average_order_value FROM o GROUP BY ALL")
def average_order_value(spark: SparkSession, d: str) -> DataFrame:
    return doubles(retail.average_order_value(tv.retail(spark, d), "region"))


@query(
    "member_contribution",
    f"""WITH {tv.RETAIL}, p AS (SELECT level, count(DISTINCT customer_id) AS customers, sum(net_amount) AS s FROM o GROUP BY ALL),
    t AS (SELECT sum(customers) AS c, sum(s) AS a FROM p)
    SELECT level, customers, CAST(s AS DOUBLE) AS net_sales, {rate_sql("customers", "c")} AS customer_share, {signed_sql("s", "a", 6)} AS sales_share,
        round({signed_sql("s", "a", 6)} - {rate_sql("customers", "c")}, 6) AS share_gap FROM p, t""",
)
def member_contribution(spark: SparkSession, d: str) -> DataFrame:
    return doubles(retail.member_contribution(tv.retail(spark, d)))


@query("category_sales", f"WITH {tv.RETAIL} SELECT category, {_NET}, sum(quantity)::BIGINT AS units FROM o GROUP BY ALL")
def category_sales(spark: SparkSession, d: str) -> DataFrame:
    return doubles(retail.breakdown(tv.retail(spark, d), "category").select("category", "net_sales", "units"))


def _breakdown_sql(dims: str, names: str) -> str:
    return f"""WITH {tv.RETAIL} SELECT {dims}, {_NET}, CAST(sum(gross_amount) AS DOUBLE) AS gross_sales, count(DISTINCT order_no) AS order_count, count(DISTINCT customer_id) AS customer_count,
        sum(quantity)::BIGINT AS units, {_aov()} AS average_order_value, {signed_sql("sum(gross_amount) - sum(net_amount)", "sum(gross_amount)", 4)} AS discount_rate,
        {rate_sql("count(DISTINCT order_no)", "count(DISTINCT customer_id)", 4)} AS orders_per_customer FROM o GROUP BY {names}"""


@query("region_month", _breakdown_sql(f"region, {_MONTH}", "region, month"))
def region_month(spark: SparkSession, d: str) -> DataFrame:
    return doubles(retail.breakdown(tv.retail(spark, d), "region", "month"))


@query("region_category", _breakdown_sql("region, category", "region, category"))
def region_category(spark: SparkSession, d: str) -> DataFrame:
    return doubles(retail.breakdown(tv.retail(spark, d), "region", "category"))


@query("region_level", _breakdown_sql("region, level", "region, level"))
def region_level(spark: SparkSession, d: str) -> DataFrame:
    return doubles(retail.breakdown(tv.retail(spark, d), "region", "level"))


_SETS = {"region,month": ("NULL AS category, NULL AS level", f"region, {_MONTH}"), "region,category": ("NULL AS month, NULL AS level", "region, category"), "region,level": ("NULL AS month, NULL AS category", "region, level")}


@query("region_breakdowns", " UNION ALL BY NAME ".join(f"SELECT '{name}' AS dimensions, {rest}, * FROM ({_breakdown_sql(dims, name)})" for name, (rest, dims) in _SETS.items()))
def region_breakdowns(spark: SparkSession, d: str) -> DataFrame:
    """The three breakdowns of a region from one job."""
    return doubles(retail.breakdowns(tv.retail(spark, d), ("region", "month"), ("region", "category"), ("region", "level")))


_ASKED = [("sales_amount", ("month",)), ("sales_amount", ("region", "category")), ("order_count", ("region",)), ("average_order_value", ("region", "level")), ("units", ("product",)), ("customer_count", ("region", "month")), ("customer_count", ("level",))]
_VALUES = {"sales_amount": "CAST(sum(net_amount) AS DOUBLE)", "order_count": "CAST(count(DISTINCT order_no) AS DOUBLE)", "average_order_value": f"CAST({_aov()} AS DOUBLE)", "units": "CAST(sum(quantity) AS DOUBLE)", "customer_count": "CAST(count(DISTINCT customer_id) AS DOUBLE)"}


def _asked_sql(name: str, dims: tuple[str, ...]) -> str:
    key = " || '|' || ".join(f"'{d}=' || {d}" for d in sorted(dims))
    return f"SELECT '{name}' AS metric, {key} AS key, {_VALUES[name]} AS value FROM m GROUP BY {', '.join(dims)}"


@query("catalogue_metrics", f"WITH {tv.RETAIL}, m AS (SELECT *, {_MONTH} FROM o) " + " UNION ALL ".join(_asked_sql(*a) for a in _ASKED))
def catalogue_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the catalogue by several sets of dimensions, from one pass over the star."""
    key = F.array_join(F.transform(F.array_sort(F.map_keys("keys")), lambda k: F.concat(k, F.lit("="), F.col("keys")[k])), "|")
    return retail.metrics(tv.retail(spark, d), _ASKED).select("metric", key.alias("key"), "value")


@query(
    "metric_catalogue",
    f"""WITH {tv.RETAIL}, c AS (SELECT region, customer_id, count(DISTINCT order_no) AS n FROM o GROUP BY ALL),
    r AS (SELECT region, {rate_sql("count(*) FILTER (n >= 2)", "count(*)", 4)} AS v FROM c GROUP BY ALL),
    b AS (SELECT region, CAST(sum(net_amount) AS DOUBLE) AS s, CAST(count(DISTINCT order_no) AS DOUBLE) AS n, {_aov()} AS a FROM o GROUP BY ALL)
    SELECT region, 'sales_amount' AS metric, s AS value FROM b UNION ALL SELECT region, 'order_count', n FROM b UNION ALL SELECT region, 'average_order_value', a FROM b UNION ALL SELECT region, 'repurchase_rate', v FROM r""",
)
def metric_catalogue(spark: SparkSession, d: str) -> DataFrame:
    star, out = shared.staged(tv.retail(spark, d), "star"), None
    for name in ("sales_amount", "order_count", "average_order_value", "repurchase_rate"):
        one = retail.metric(star, name, ["region"]).select("region", F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "period_change",
    f"""WITH {tv.RETAIL}, m AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, sum(net_amount) AS s, count(DISTINCT order_no) AS n FROM o GROUP BY ALL)
    SELECT m.month, CAST(m.s AS DOUBLE) AS net_sales, m.n AS order_count, {signed_sql("m.s - p.s", "p.s", 6)} AS sales_mom, {signed_sql("m.n - p.n", "p.n", 6)} AS orders_mom,
        {signed_sql("m.s - y.s", "y.s", 6)} AS sales_yoy, {signed_sql("m.n - y.n", "y.n", 6)} AS orders_yoy
    FROM m LEFT JOIN m p ON p.month + INTERVAL 1 MONTH = m.month LEFT JOIN m y ON y.month + INTERVAL 12 MONTH = m.month""",
    ("month",),
)
def period_change(spark: SparkSession, d: str) -> DataFrame:
    return doubles(retail.period_change(tv.retail(spark, d)))


@query(
    "weekend_effect",
    f"""WITH {tv.RETAIL}, x AS (SELECT order_date, count(DISTINCT order_no) AS n, sum(net_amount) AS s FROM o GROUP BY ALL)
    SELECT isodow(order_date) >= 6 AS is_weekend, count(*) AS days, {rate_sql("sum(n)", "count(*)", 4)} AS orders_a_day, ((2 * CAST(sum(s) * 100 AS HUGEINT) + count(*)) // (2 * count(*))) / 100.0 AS sales_a_day FROM x GROUP BY ALL""",
)
def weekend_effect(spark: SparkSession, d: str) -> DataFrame:
    return doubles(retail.weekend_effect(tv.retail(spark, d)))


@query(
    "month_peak",
    f"""WITH {tv.RETAIL}, m AS (SELECT year(order_date) AS year, month(order_date) AS month, CAST(sum(net_amount) AS DOUBLE) AS v FROM o GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (ORDER BY v DESC, year DESC, month DESC) AS k FROM m), q AS (SELECT count(*) AS months, median(v) AS med FROM m)
    SELECT months, round(med, 2) AS median, p.year AS peak_year, p.month AS peak_month, z.year AS second_year, z.month AS second_month, p.v AS peak_value, round(p.v / med, 4) AS peak_multiple, p.v >= 1.3 * med AS is_peak
    FROM q JOIN r p ON p.k = 1 JOIN r z ON z.k = 2""",
)
def month_peak(spark: SparkSession, d: str) -> DataFrame:
    return doubles(retail.month_peak(retail.monthly_trend(tv.retail(spark, d))))


@query(
    "order_amounts",
    """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS rate FROM lineitem),
    g AS (SELECT *, CAST(quantity * CAST(price * 100 AS HUGEINT) AS HUGEINT) AS gross FROM l),
    x AS (SELECT *, least((2 * gross * CAST(rate * 100 AS HUGEINT) + 100) // 200, gross) AS off FROM g)
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, quantity, gross / 100.0 AS gross_amount, off / 100.0 AS discount_amount, (gross - off) / 100.0 AS net_amount FROM x""",
)
def order_amounts(spark: SparkSession, d: str) -> DataFrame:
    lines = tv.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_quantity").cast("long").alias("quantity"), "l_extendedprice", "l_discount")
    return doubles(retail.order_amounts(lines, "quantity", "l_extendedprice", "l_discount").drop("l_extendedprice", "l_discount"))


@query(
    "date_dim",
    """WITH s AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders), x AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS full_date FROM s)
    SELECT CAST(strftime(full_date, '%Y%m%d') AS BIGINT) AS date_id, full_date, year(full_date) AS year, quarter(full_date) AS quarter, month(full_date) AS month, monthname(full_date) AS month_name,
        day(full_date) AS day_of_month, weekofyear(full_date) AS week_of_year, isodow(full_date) >= 6 AS is_weekend FROM x""",
    ("full_date",),
)
def date_dim(spark: SparkSession, d: str) -> DataFrame:
    orders = tv.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("order_date"))
    return doubles(retail.date_dim(spark, of=orders))


_NAMED = (("behaviour_count", "category"), ("action_user_count", "action"), ("buy_user_rate", "action"), ("merchant_repeat_buy_user_count", "merchant"), ("merchant_repeat_buy_user_rate", "merchant"), ("user_multi_merchant_buy_flag", "user"), ("category_buy_user_count", "category"), ("repurchase_sample_count", "split"), ("repurchase_positive_rate", "split"), ("active_user_count", "all"))


def _named_sql(name: str, dimension: str) -> str:
    column, how, _, of = gold.METRICS[name]
    table, key = of[dimension]
    value = f"CAST(max(CAST({column} AS INT)) AS DOUBLE)" if column.endswith("_flag") else f"CAST({how}({column}) AS DOUBLE)"
    return f"SELECT '{name}' AS metric, {f'CAST({key} AS VARCHAR)' if key else "'all'"} AS key, {value} AS value FROM ({ORACLE[table]}) GROUP BY 2"


@query("behaviour_catalogue", " UNION ALL ".join(_named_sql(*n) for n in _NAMED))
def behaviour_catalogue(spark: SparkSession, d: str) -> DataFrame:
    tables, out = gold.all_tables(shared.staged(tv.behaviour(spark, d), "events"), tv.samples(spark, d)), None
    for name, dimension in _NAMED:
        one = gold.metric(tables, name, dimension).select(F.lit(name).alias("metric"), "key", "value")
        out = one if out is None else out.unionByName(one)
    return out
