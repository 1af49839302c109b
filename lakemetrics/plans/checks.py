"""Registered queries of quality checks, ingest, history and questions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import texts as X
from ..operators import gold, history, ingest, quality, questions, retail
from ..sources import shared
from ..sources import testviews as tv
from .metrics import doubles, rate_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _check(name: str, n: str, expected: str = "0", ok: str | None = None, detail: str = "") -> str:
    return f"SELECT '{name}' AS \"check\", coalesce({ok or f'({n}) = {expected}'}, false) AS passed, CAST({n} AS VARCHAR) AS actual, CAST({expected} AS VARCHAR) AS expected, '{detail}' AS detail"


@query("orphan_check", f"{_check('orphans of orders', '(SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))')} UNION ALL {_check('orphans of lines', '(SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))')}")
def orphan_check(spark: SparkSession, d: str) -> DataFrame:
    orders = tv.table(spark, d, "orders")
    return quality.union([quality.orphans(orders, tv.table(spark, d, "customer"), "o_custkey", "orders", "c_custkey"), quality.orphans(tv.table(spark, d, "lineitem"), orders, "l_orderkey", "lines", "o_orderkey")])


#: The groups of the metric tables, to sum their events in SQL.
_GROUPS = {"daily_metrics": "event_date, action_type", "merchant_metrics": "merchant_id", "category_metrics": "category_id", "user_metrics": "user_id", "funnel_metrics": "action_type"}


def _same_sql(name: str, actual: str, expected: str) -> str:
    return f"SELECT '{name}' AS \"check\", ({actual}) = {expected} AS passed, CAST(({actual}) AS VARCHAR) AS actual, CAST({expected} AS VARCHAR) AS expected, '' AS detail FROM s"


@query(
    "gold_silver_consistency",
    f"WITH {tv.BEHAVIOUR}, s AS (SELECT count(*) AS n, count(DISTINCT user_id) AS u, count(DISTINCT merchant_id) AS m FROM e) "
    + " UNION ALL ".join(
        [_same_sql(f"{t} events", f"SELECT CAST(sum(c) AS BIGINT) FROM (SELECT {g}, count(*) AS c FROM e GROUP BY {g})", "n") for t, g in _GROUPS.items()]
        + [_same_sql(f"{t}_metrics {t}s", f"SELECT count(*) FROM (SELECT {t}_id FROM e GROUP BY {t}_id)", c) for t, c in (("user", "u"), ("merchant", "m"))]
    ),
)
def gold_silver(spark: SparkSession, d: str) -> DataFrame:
    events = shared.staged(tv.behaviour(spark, d), "events")
    return quality.gold_matches_silver(events, gold.all_tables(events, tv.samples(spark, d)))


@query(
    "constraint_scan",
    f"""WITH {tv.SAMPLES}, {tv.BEHAVIOUR}, x AS (
        SELECT 'repurchase_samples known_split' AS name, count(*) FILTER (dataset_split NOT IN ('train', 'test')) AS n FROM s
        UNION ALL SELECT 'repurchase_samples train_has_label_only', count(*) FILTER (dataset_split = 'train' AND NOT coalesce(label IN (0, 1) AND probability IS NULL, false)) FROM s
        UNION ALL SELECT 'repurchase_samples test_has_no_label', count(*) FILTER (dataset_split = 'test' AND label IS NOT NULL) FROM s
        UNION ALL SELECT 'repurchase_samples probability_range', count(*) FILTER (probability NOT BETWEEN 0 AND 1) FROM s
        UNION ALL SELECT 'user_events known_action', count(*) FILTER (action_type NOT IN ('click', 'cart', 'buy', 'favorite')) FROM e
        UNION ALL SELECT 'user_events has_user', count(*) FILTER (user_id IS NULL OR user_id < 0) FROM e)
    SELECT name AS "check", n = 0 AS passed, CAST(n AS VARCHAR) AS actual, '0' AS expected, '' AS detail FROM x
    UNION ALL SELECT 'repurchase_samples key', count(*) = 0, CAST(count(*) AS VARCHAR), '0', 'user_id, merchant_id, dataset_split' FROM (SELECT 1 FROM s GROUP BY user_id, merchant_id, dataset_split HAVING count(*) > 1)
    UNION ALL SELECT 'lines key', count(*) = 0, CAST(count(*) AS VARCHAR), '0', 'l_orderkey, l_linenumber' FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def constraint_scan(spark: SparkSession, d: str) -> DataFrame:
    rules = {k: v for k, v in quality.RULES["user_events"].items() if k != "positive_row"}
    return quality.union([
        quality.constraints(tv.samples(spark, d), "repurchase_samples"),
        quality.constraints(tv.behaviour(spark, d), "user_events", rules, ()),
        quality.constraints(tv.table(spark, d, "lineitem"), "lines", {}, ("l_orderkey", "l_linenumber")),
    ])


@query("sampling_check", f"{_check('sample of users', '(SELECT count(*) FROM customer WHERE c_custkey % 7 = 3 AND c_custkey % 7 <> 3)')} UNION ALL {_check('sample of orders', '(SELECT count(*) FROM orders WHERE o_custkey % 7 <> 3)')}")
def sampling_check(spark: SparkSession, d: str) -> DataFrame:
    users = ingest.sampled(tv.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), 7, 3)
    return quality.sampling({"users": users, "orders": tv.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))}, 7, 3)


@query("row_count_check", " UNION ALL ".join(_check(f"rows of {t}", f"(SELECT count(*) FROM {t})", e, ok, x) for t, e, ok, x in (("nation", "25", None, ""), ("region", "6", None, ""), ("orders", "NULL", "true", "skipped"))))
def row_count_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.row_counts({t: tv.table(spark, d, t) for t in ("nation", "region", "orders")}, {"nation": 25, "region": 6})


@query(
    "date_range_check",
    """SELECT 'range of order_date' AS "check", min(CAST(o_orderdate AS DATE)) >= DATE '1995-01-01' AND max(CAST(o_orderdate AS DATE)) <= DATE '2000-12-31' AS passed,
    CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) || ' to ' || CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS actual, '1995-01-01 to 2000-12-31' AS expected, '' AS detail FROM orders""",
)
def date_range_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.date_range(tv.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("order_date")), "order_date", "1995-01-01", "2000-12-31")


@query(
    "action_check",
    """WITH f AS (SELECT event_type AS a, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT * FROM (VALUES ('click', -1), ('view', -1), ('signup', -1), ('purchase', -1), ('refund', -1)) t(a, w))
    SELECT 'action ' || coalesce(f.a, k.a) AS "check", w IS NOT NULL AND coalesce(n, 0) > 0 AS passed, CAST(coalesce(n, 0) AS VARCHAR) AS actual, CAST(NULL AS VARCHAR) AS expected, CASE WHEN w IS NULL THEN 'unknown action' ELSE '' END AS detail FROM f FULL JOIN k ON f.a = k.a""",
)
def action_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.actions(tv.stream_events(spark, d), {"click": None, "view": None, "signup": None, "purchase": None, "refund": None})


@query(
    "retail_rules",
    f"""WITH {tv.RETAIL}, m AS (SELECT year(order_date) AS y, month(order_date) AS month, CAST(sum(net_amount) AS DOUBLE) AS v FROM o GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (ORDER BY v DESC, month DESC) AS k FROM m), t AS (SELECT count(*) AS n, count(DISTINCT order_no) AS c, sum(net_amount) AS s FROM o), q AS (SELECT count(*) AS n, median(v) AS med FROM m),
    l AS (SELECT level, {rate_sql("count(*) FILTER (n >= 2)", "count(*)", 4)} AS r FROM (SELECT level, customer_id, count(DISTINCT order_no) AS n FROM o GROUP BY ALL) GROUP BY ALL)
    SELECT 'order volume' AS "check", c >= 3000 AS passed, CAST(c AS VARCHAR) AS actual, '3000' AS expected, '' AS detail FROM t
    UNION ALL SELECT 'season', q.n >= 12 AND least(a.month, b.month) = 11 AND greatest(a.month, b.month) = 12 AND b.v >= 1.3 * med, least(a.month, b.month) || ',' || greatest(a.month, b.month), '11,12', q.n || ' months' FROM q JOIN r a ON a.k = 1 JOIN r b ON b.k = 2
    UNION ALL SELECT 'top region', region = 'ASIA', region, 'ASIA', '' FROM (SELECT region, sum(net_amount) AS s FROM o GROUP BY ALL ORDER BY s DESC, region DESC LIMIT 1)
    UNION ALL SELECT 'levels rise', (SELECT r FROM l WHERE level = 'BUILDING') <= (SELECT r FROM l WHERE level = 'MACHINERY'), 'BUILDING,MACHINERY', 'repurchase rates in this order', ''
    UNION ALL SELECT 'order value', s / c > 0 AND s / c <= 1000000, printf('%.2f', ((2 * CAST(s * 100 AS HUGEINT) + c) // (2 * c)) / 100.0), 'over 0.0, up to 1000000.0', '' FROM t
    UNION ALL SELECT 'top products', p = '1,2,3', p, '1,2,3', '' FROM (SELECT string_agg(p, ',' ORDER BY p) AS p FROM (SELECT CAST(product_id AS VARCHAR) AS p FROM o GROUP BY product_id ORDER BY sum(net_amount) DESC, product_id LIMIT 3))""",
)
def retail_rules(spark: SparkSession, d: str) -> DataFrame:
    star = shared.staged(tv.retail(spark, d), "star")
    return quality.retail_rules(
        retail.monthly_trend(star), retail.product_ranking(star, 3), retail.breakdown(star, "region"), retail.repurchase_rate(star, "level"), retail.average_order_value(star),
        top_products={1, 2, 3}, top_region="ASIA", level_order=("BUILDING", "MACHINERY"), value_range=(0.0, 1000000.0),
    )


@query("sampled_users", "SELECT c_custkey AS user_id, c_name, c_mktsegment FROM customer WHERE ((c_custkey - 700) % 7 + 7) % 7 = 3")
def sampled_users(spark: SparkSession, d: str) -> DataFrame:
    users = tv.table(spark, d, "customer").select((F.col("c_custkey") - 700).alias("user_id"), "c_name", "c_mktsegment")
    return ingest.sampled(users, 7, 3).withColumn("user_id", F.col("user_id") + 700)


@query(
    "decoded_events",
    """WITH r AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS u, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE CAST(user_id % 9 AS VARCHAR) END AS b,
        CASE WHEN event_id % 13 = 0 THEN '0230' ELSE strftime(ts, '%m%d') END AS t, CAST(event_id % 6 AS VARCHAR) AS a FROM events)
    SELECT event_id, CASE WHEN u = '' THEN 'user_id' WHEN b = 'x' THEN 'brand_id' WHEN t = '0230' THEN 'time_stamp' WHEN a IN ('4', '5') THEN 'action_type' END AS rejected,
        CAST(try_cast(u AS BIGINT) AS VARCHAR) AS user_id, CAST(try_cast(b AS BIGINT) AS VARCHAR) AS brand_id, CASE WHEN t <> '0230' THEN '2014-' || t[1:2] || '-' || t[3:4] END AS event_date, CASE a WHEN '0' THEN 'click' WHEN '1' THEN 'cart' WHEN '2' THEN 'buy' WHEN '3' THEN 'favorite' END AS action_type FROM r""",
)
def decoded_events(spark: SparkSession, d: str) -> DataFrame:
    i, c = F.col("event_id"), F.col
    raw = tv.table(spark, d, "events").select(
        i, F.when(i % 11 == 0, "").otherwise(c("user_id").cast("string")).alias("u"), F.when(i % 5 == 0, "").when(i % 5 == 1, "x").otherwise((c("user_id") % 9).cast("string")).alias("b"),
        F.when(i % 13 == 0, "0230").otherwise(F.date_format("ts", "MMdd")).alias("t"), (i % 6).cast("string").alias("a"),
    )
    rejected = F.when(N.bad_int(c("u"), True), "user_id").when(N.bad_int(c("b")), "brand_id").when(N.month_day(c("t"), 2014).isNull(), "time_stamp").when(ingest.decode_action(c("a")).isNull(), "action_type")
    return doubles(raw.select(i, rejected.alias("rejected"), N.optional_int(c("u")).cast("string").alias("user_id"), N.optional_int(c("b")).cast("string").alias("brand_id"), N.month_day(c("t"), 2014).alias("event_date"), ingest.decode_action(c("a")).alias("action_type")))


@query(
    "probability_parse",
    """WITH r AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'NaN' WHEN 2 THEN '1.5' WHEN 3 THEN '-0.1' ELSE CAST(CAST((event_id % 1000) / 1000 AS DECIMAL(8,7)) AS VARCHAR) END AS p FROM events)
    SELECT event_id, CASE WHEN event_id % 7 >= 4 THEN CAST(CAST(p AS DECIMAL(8,7)) AS DOUBLE) END AS probability, event_id % 7 IN (1, 2, 3) AS rejected FROM r""",
)
def probability_parse(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 7 == 0, "").when(i % 7 == 1, "NaN").when(i % 7 == 2, "1.5").when(i % 7 == 3, "-0.1").otherwise(((i % 1000) / 1000).cast("decimal(8,7)").cast("string"))
    return doubles(tv.table(spark, d, "events").select(i, text.alias("p")).select("event_id", N.probability(F.col("p")).alias("probability"), N.bad_probability(F.col("p")).alias("rejected")))


@query("insert_ignore", "SELECT o_custkey, 'old' AS origin FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    orders = tv.table(spark, d, "orders")
    old = orders.where("o_orderkey % 3 = 0").select("o_custkey", F.lit("old").alias("origin")).distinct()
    return ingest.insert_ignore(old, orders.select("o_custkey", F.lit("new").alias("origin")), ["o_custkey"])


@query("upsert_latest", "SELECT user_id, event_type, arg_max(value, (ts, value)) AS value, CAST(max(ts) AS VARCHAR) AS ts FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.upsert_latest(tv.table(spark, d, "events").select("user_id", "event_type", "value", "ts"), ["user_id", "event_type"], "value", "ts", {"event_type": ["view", "click"]})
    return out.withColumn("ts", F.col("ts").cast("string"))


@query("governed_top", "SELECT n_nationkey AS region_id, n_name AS region_name FROM nation ORDER BY 1 LIMIT 200")
def governed_top(spark: SparkSession, d: str) -> DataFrame:
    return history.governed(tv.table(spark, d, "nation").select(F.col("n_nationkey").alias("region_id"), F.col("n_name").alias("region_name"), F.lit("nation").alias("region_level")), "regions", ["region_id", "region_name"], 200, order=[F.col("region_id")])


@query("redact_text", "SELECT conv_id, turn, regexp_replace(replace(text, 'the', 'select the'), '(?i)\\b(?:select|insert|update|delete|drop|alter|create|truncate)\\b[^\\n]*', '[redacted]', 'g') AS text FROM conversations")
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    return tv.table(spark, d, "conversations").select("conv_id", "turn", X.redact(F.replace("text", F.lit("the"), F.lit("select the"))).alias("text"))


@query("latest_per_conversation", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1")
def latest_per_conversation(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(tv.table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", F.desc("turn"))


@query("latest_child", "SELECT c_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS o_orderpriority, CAST(max(o_orderdate) AS VARCHAR) AS o_orderdate FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def latest_child(spark: SparkSession, d: str) -> DataFrame:
    orders = tv.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderdate")
    return history.latest_child(tv.table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "o_orderpriority", "o_orderdate").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query(
    "history_digest",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
    SELECT conv_id, turn, role, text FROM r WHERE k <= 3
    UNION ALL SELECT conv_id, -1, 'system', string_agg(role || ': ' || coalesce(text, '')[1:500], chr(10) ORDER BY turn) FROM r WHERE k > 3 GROUP BY conv_id""",
)
def history_digest(spark: SparkSession, d: str) -> DataFrame:
    return history.digest(tv.table(spark, d, "conversations"), 3)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return tv.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"), F.col("role").alias("intent"))


_FIRST, _SECOND, _BOTH = ("the", "que", "der", "reti"), ("and", "les", "und", "ing", "tion"), ("en",)
_CATALOGUE = [("behaviour", "metric", "m1", ("the", "que")), ("retail", "metric", "m2", ("tion", "and")), ("behaviour", "dataset", "d1", ("er",)), ("retail", "dataset", "d2", ("ing", "es"))]


def _hits_sql(words: tuple[str, ...], text: str = "q") -> str:
    return f"list_filter([{', '.join(f"'{w}'" for w in words)}], lambda w: contains(lower({text}), w))"


_ROUTED = f"""q AS (SELECT conv_id * 1000 + turn AS question_id, text AS q, role AS intent FROM conversations),
    r AS (SELECT *, {_hits_sql(_FIRST)} AS a, {_hits_sql(_SECOND)} AS b, {_hits_sql(_BOTH)} AS c FROM q), t AS (SELECT *, CASE WHEN len(a) > len(b) THEN 'behaviour' ELSE 'retail' END AS area FROM r)"""


@query("route_questions", f"WITH {_ROUTED} SELECT question_id, area, array_to_string(a, ',') AS behaviour_hits, array_to_string(b, ',') AS retail_hits, array_to_string(c, ',') AS shared_hits FROM t")
def route_questions(spark: SparkSession, d: str) -> DataFrame:
    out = questions.route(_questions(spark, d), _FIRST, _SECOND, _BOTH)
    return out.select("question_id", "area", *[F.array_join(c, ",").alias(c) for c in ("behaviour_hits", "retail_hits", "shared_hits")])


@query("asset_match", f"WITH {_ROUTED} " + " UNION ALL ".join(f"SELECT question_id, CAST({i} AS BIGINT) AS position, '{k}' AS kind, '{n}' AS name, array_to_string({_hits_sql(w)}, ',') AS matched FROM t WHERE area = '{a}' AND len({_hits_sql(w)}) > 0" for i, (a, k, n, w) in enumerate(_CATALOGUE)))
def asset_match(spark: SparkSession, d: str) -> DataFrame:
    return questions.match_assets(questions.route(_questions(spark, d), _FIRST, _SECOND, _BOTH), _CATALOGUE).withColumn("matched", F.array_join("matched", ","))


@query("knowledge_flag", f"WITH {_ROUTED}, z AS (SELECT question_id, CASE WHEN trim(q) = '' THEN NULL WHEN intent = 'system' THEN 'intent system' ELSE 'word ' || {_hits_sql(_SECOND)}[1] END AS reason FROM t) SELECT question_id, reason, reason IS NOT NULL AS needs_knowledge FROM z")
def knowledge_flag(spark: SparkSession, d: str) -> DataFrame:
    return questions.knowledge_flag(_questions(spark, d), _SECOND, ("system",)).select("question_id", "reason", "needs_knowledge")


_Q = questions
_WORDS = tuple(dict.fromkeys((*_Q.BEHAVIOUR_WORDS, *_Q.RETAIL_WORDS, *_Q.SHARED_WORDS, *_Q.KNOWLEDGE_WORDS, *(w for *_, words in _Q.CATALOGUE for w in words))))


def _words_sql(words: tuple[str, ...]) -> str:
    return f"[{', '.join(f"'{w}'" for w in words)}]"


#: Conversation turns with two words of the engine's lists behind them.
_ASKED = f"""q AS (SELECT conv_id * 1000 + turn AS question_id, text || {_words_sql(_WORDS)}[conv_id % {len(_WORDS)} + 1] || ' ' || {_words_sql(_WORDS)}[(conv_id * 7 + turn) % {len(_WORDS)} + 1] AS q, CASE turn % 3 WHEN 0 THEN 'funnel' ELSE 'other' END AS intent FROM conversations),
    t AS (SELECT *, CASE WHEN len({_hits_sql(_Q.BEHAVIOUR_WORDS)}) > len({_hits_sql(_Q.RETAIL_WORDS)}) THEN 'behaviour' ELSE 'retail' END AS area FROM q)"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    words, c, t = F.array(*map(F.lit, _WORDS)), F.col("conv_id"), F.col("turn")
    pick = lambda i: F.get(words, (i % len(_WORDS)).cast("int"))
    return tv.table(spark, d, "conversations").select((c * 1000 + t).alias("question_id"), F.concat("text", pick(c), F.lit(" "), pick(c * 7 + t)).alias("question"), F.when(t % 3 == 0, "funnel").otherwise("other").alias("intent"))


@query(
    "catalogue_questions",
    f"""WITH {_ASKED}, z AS (SELECT *, CASE WHEN trim(q) = '' THEN NULL WHEN intent = 'funnel' THEN 'intent funnel' ELSE 'word ' || {_hits_sql(_Q.KNOWLEDGE_WORDS)}[1] END AS reason FROM t),
    m AS ({" UNION ALL ".join(f"SELECT question_id, '{n}' AS name, {i} AS i, array_to_string({_hits_sql(w)}, ',') AS matched FROM t WHERE area = '{a}' AND len({_hits_sql(w)}) > 0" for i, (a, _, n, w) in enumerate(_Q.CATALOGUE))}),
    n AS (SELECT question_id, string_agg(name || '=' || matched, ';' ORDER BY i) AS assets FROM m GROUP BY ALL)
    SELECT question_id, area, reason, assets FROM z LEFT JOIN n USING (question_id)""",
)
def catalogue_questions(spark: SparkSession, d: str) -> DataFrame:
    """Area, reason for documents and matching assets of questions, by the engine's own word lists."""
    routed = questions.knowledge_flag(questions.route(_asked(spark, d)))
    found = questions.match_assets(routed).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat("name", F.lit("="), F.array_join("matched", ",")).alias("s")))).alias("_a"))
    return routed.select("question_id", "area", "reason").join(found, "question_id", "left").select("question_id", "area", "reason", F.array_join("_a.s", ";").alias("assets"))
