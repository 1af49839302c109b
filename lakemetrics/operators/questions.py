"""Classification of a table of questions: subject area, matching assets, and whether documents are needed.

Words come as a table, so a plan is equally large for ten words and for a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a word table, or of a catalogue, that goes to every task.
WORD_BYTES = 32 << 20
#: Letters by which texts and the words of larger tables meet.
GRAM = 3
_FOUND = pa.list_(pa.struct([("list", pa.string()), ("position", pa.int64()), ("word", pa.string())]))

# The words that decide the subject area of a question, and those that ask for documents.
BEHAVIOUR_WORDS = ("天猫", "双十一", "点击", "加购", "收藏", "购物车", "行为", "漏斗", "商家", "品牌", "转化", "浏览", "用户日志", "样本", "预测")
RETAIL_WORDS = ("销售额", "销售金额", "订单", "客单价", "区域", "会员", "品类", "折扣", "促销", "库存", "毛利", "gmv", "地区", "大区", "客户", "门店")
SHARED_WORDS = ("复购", "回购", "重复购买", "商品", "类目")
KNOWLEDGE_WORDS = (
    "为什么", "原因", "依据", "怎么算", "怎么计算", "如何计算", "口径", "定义", "规则", "说明", "如何理解", "是否合理", "差异",
    "会员等级", "复购", "促销", "季节性", "区域差异", "天猫", "双十一", "加购", "收藏", "行为漏斗",
)
# The metrics and tables that a question may mean, by area, with the words that name them.
CATALOGUE = [
    ("retail", "metric", "sales_amount", ("销售额", "销售金额", "销售收入", "营业额", "gmv", "实付金额")),
    ("retail", "metric", "order_count", ("订单数", "订单量", "订单数量", "订单笔数", "单量", "交易笔数")),
    ("retail", "metric", "average_order_value", ("客单价", "笔单价", "平均订单金额", "单笔金额", "客单")),
    ("retail", "metric", "repurchase_rate", ("复购率", "复购", "重复购买率", "回购率", "二次购买")),
    ("behaviour", "metric", "behaviour_count", ("行为记录数", "行为量", "行为次数", "日志条数", "事件数", "总行为")),
    ("behaviour", "metric", "action_user_count", ("行为用户数", "点击用户数", "加购用户数", "收藏用户数", "购买用户数", "活跃用户", "人数")),
    ("behaviour", "metric", "buy_user_rate", ("购买用户占比", "转化率", "转化", "行为转化", "漏斗转化")),
    ("behaviour", "metric", "merchant_buy_user_count", ("商家购买用户", "商家用户数", "商家排行", "商家对比", "店铺")),
    ("behaviour", "metric", "merchant_repeat_buy_user_count", ("复购用户", "复购人数", "复购用户数", "商家复购", "重复购买", "复购排行")),
    ("behaviour", "metric", "merchant_repeat_buy_user_rate", ("复购率", "商家复购率", "重复购买率", "回购率", "复购比例", "复购")),
    ("behaviour", "metric", "user_multi_merchant_buy_flag", ("购买广度", "多商家购买", "购买面", "跨店购买")),
    ("behaviour", "metric", "category_buy_user_count", ("类目购买用户", "类目用户数", "类目排行", "类目对比", "品类排行")),
    ("behaviour", "metric", "repurchase_sample_count", ("复购样本", "样本数", "样本量", "训练样本", "测试样本", "复购数据集")),
    ("behaviour", "metric", "repurchase_positive_rate", ("正样本占比", "正样本率", "标签分布", "复购标签", "label")),
    ("behaviour", "metric", "active_user_count", ("活跃用户数", "活跃用户", "用户规模", "去重用户")),
    ("retail", "dataset", "orders", ("订单", "订单明细", "销售额", "客单价", "复购", "购买", "下单", "交易", "销量")),
    ("retail", "dataset", "customers", ("客户", "会员", "用户", "复购", "会员等级", "等级")),
    ("retail", "dataset", "products", ("商品", "产品", "品类", "类目", "销量", "单品")),
    ("retail", "dataset", "regions", ("区域", "地区", "大区", "省份", "城市", "华东", "华南", "华北")),
    ("retail", "dataset", "date_dim", ("日期", "时间", "月", "月份", "季度", "年", "趋势", "近六个月", "同比", "环比")),
    ("behaviour", "dataset", "daily_metrics", ("天猫", "每日", "按天", "趋势", "走势", "点击", "加购", "收藏", "购买", "行为", "双十一", "日期")),
    ("behaviour", "dataset", "funnel_metrics", ("漏斗", "行为漏斗", "转化", "转化率", "点击", "加购", "收藏", "购买", "行为", "天猫", "占比")),
    ("behaviour", "dataset", "merchant_metrics", ("商家", "卖家", "店铺", "merchant", "排名", "排行", "对比", "天猫", "购买", "复购")),
    ("behaviour", "dataset", "category_metrics", ("类目", "品类", "类目排行", "类目对比", "天猫", "购买", "点击", "收藏", "加购")),
    ("behaviour", "dataset", "user_metrics", ("用户", "用户行为", "活跃", "活跃天数", "复购", "天猫", "行为分布", "用户画像")),
    ("behaviour", "dataset", "repurchase_metrics", ("复购", "复购样本", "复购预测", "标签", "label", "正样本", "数据集", "训练集", "测试集", "天猫")),
]
KNOWLEDGE_INTENTS = ("repurchase", "funnel")
DEFAULT_AREA = "retail"


Words = list[tuple[str, int, str]]


def _by_automaton(text: Column, words: DataFrame | Words) -> Column:
    """The words of a table of bounded size that occur in text: each task builds one automaton and reads each text once."""
    if isinstance(words, DataFrame):
        table = [tuple(r) for r in words.select("list", "position", "word", F.lower("word")).collect()]
    else:
        table = [(*w, w[2].lower()) for w in words if w[2]]
    if not table:
        return F.array().cast("array<struct<list:string,position:bigint,word:string>>")

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        same: dict[str, list] = {}
        for key, position, word, low in table:
            same.setdefault(low, []).append((key, position, word))
        automaton = ahocorasick.Automaton()
        for low, entries in same.items():
            automaton.add_word(low, (low, entries))
        automaton.make_automaton()
        for batch in batches:
            out = []
            for low in batch.to_pylist():
                hits = dict(v for _, v in automaton.iter(low or ""))
                out.append([dict(zip(("list", "position", "word"), e)) for e in sorted(e for entries in hits.values() for e in entries)])
            yield pa.array(out, _FOUND)

    return F.arrow_udf(search, "array<struct<list:string,position:bigint,word:string>>")(F.lower(text))


def _by_grams(texts: DataFrame, words: DataFrame, text: str, name: str) -> DataFrame:
    """The same for word tables of any size: distinct texts and words are joined by the word's first letters, then compared."""
    low = F.lower(text)
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length("_low")), lambda i: F.substring(F.col("_low"), i, F.lit(n)))
    asked = texts.select(low.alias("_low")).where("_low <> ''").distinct()
    pieces = F.array_distinct(F.flatten(F.array(*[grams(n) for n in range(1, GRAM + 1)])))
    keyed = words.select(F.struct("list", F.col("position").cast("long").alias("position"), "word").alias("_w"), F.lower("word").alias("_word")).withColumn("_gram", F.substring("_word", 1, GRAM))
    met = asked.select("_low", F.explode(pieces).alias("_gram")).join(keyed, "_gram").where(F.contains("_low", "_word"))
    sets = met.groupBy("_low").agg(F.sort_array(F.collect_set("_w")).alias(name)).withColumnRenamed("_low", "_text")
    return texts.join(sets, low == F.col("_text"), "left").drop("_text").withColumn(name, F.coalesce(name, F.array().cast("array<struct<list:string,position:bigint,word:string>>")))


def find(texts: DataFrame, words: DataFrame | Words, text: str = "question", name: str = "found") -> DataFrame:
    """Adds the words (list, position, word) that occur in text, in any case and overlapping, by list and position.

    words is a table of these three columns, or a list of such rows. Null and empty words occur nowhere, and in a null
    text occurs none. A word that stands in several lists is found in each.
    """
    if not isinstance(words, DataFrame):
        return texts.withColumn(name, _by_automaton(F.col(text), words))
    words = words.where("word <> ''").select(F.col("list").cast("string").alias("list"), F.col("position").cast("long").alias("position"), "word")
    size = words.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length("list") + 16), F.lit(0)).alias("n")).head()["n"]
    if size <= WORD_BYTES:
        return texts.withColumn(name, _by_automaton(F.col(text), words))
    return _by_grams(texts, words, text, name)


def _rows(lists: dict[str, tuple[str, ...]]) -> Words:
    return [(name, i, w) for name, words in lists.items() for i, w in enumerate(words)]


def _of(name: str | Column, found: str = "_found") -> Column:
    """The words of one list among those found."""
    return F.transform(F.filter(found, lambda x: x["list"] == (F.lit(name) if isinstance(name, str) else name)), lambda x: x["word"])


def route(questions: DataFrame, behaviour: tuple[str, ...] = BEHAVIOUR_WORDS, retail: tuple[str, ...] = RETAIL_WORDS, shared: tuple[str, ...] = SHARED_WORDS, question: str = "question", words: DataFrame | None = None) -> DataFrame:
    """Adds the area: that with more hits, the default on a tie or without any; shared words never decide.

    words, a table with the lists behaviour, retail and shared, may stand for the three tuples.
    """
    names = ("behaviour", "retail", "shared")
    out = find(questions, _rows(dict(zip(names, (behaviour, retail, shared)))) if words is None else words, question, "_found")
    out = out.withColumns({f"{n}_hits": _of(n) for n in names}).drop("_found")
    return out.withColumn("area", F.when(F.size("behaviour_hits") > F.size("retail_hits"), "behaviour").otherwise(DEFAULT_AREA))


def match_assets(routed: DataFrame, catalogue: DataFrame | list[tuple[str, str, str, tuple[str, ...]]] = CATALOGUE, question: str = "question") -> DataFrame:
    """Rows for the assets (area, kind, name, words) of a question's area of which a word occurs in it, with their place
    in the catalogue.

    The catalogue is a list, or a table of those columns and a position.
    """
    if isinstance(catalogue, DataFrame):
        assets = catalogue.select(F.col("position").cast("long").alias("position"), F.col("area").alias("_area"), "kind", "name", "words")
        size = assets.agg(F.coalesce(F.sum(F.octet_length("name") + F.octet_length("kind") + F.octet_length("_area") + 16), F.lit(0)).alias("n")).head()["n"]
        words = assets.select(F.col("position").cast("string").alias("list"), F.posexplode("words").alias("position", "word"))
        assets = assets.drop("words")
    else:
        words, size = _rows({str(i): a[3] for i, a in enumerate(catalogue)}), 0
        assets = routed.sparkSession.createDataFrame([(i, *a[:3]) for i, a in enumerate(catalogue)], "position long, _area string, kind string, name string")
    found = find(routed.select("question_id", "area", question), words, question, "_found")
    hit = F.transform(F.array_distinct(F.transform("_found", lambda x: x["list"])), lambda key: F.struct(key.cast("long").alias("position"), _of(key).alias("matched")))
    hits = found.select("question_id", "area", F.explode(hit).alias("_h")).select("question_id", "area", "_h.*")
    side = F.broadcast(assets) if size <= WORD_BYTES else assets
    return hits.join(side, "position").where("area = _area").select("question_id", "position", "kind", "name", "matched")


def knowledge_flag(questions: DataFrame, words: DataFrame | tuple[str, ...] = KNOWLEDGE_WORDS, intents: tuple[str, ...] = KNOWLEDGE_INTENTS, question: str = "question", intent: str | None = "intent") -> DataFrame:
    """Adds needs_knowledge and the first reason for it: the intent, or a word of the question (of a table: the first by
    list and position)."""
    out = find(questions, words if isinstance(words, DataFrame) else _rows({"knowledge": words}), question, "_found")
    first = F.get("_found", F.lit(0))["word"]
    by_intent = F.when(F.col(intent).isin(list(intents)), F.concat(F.lit("intent "), F.col(intent))) if intent else F.lit(None).cast("string")
    reason = F.when(F.trim(F.col(question)) == "", None).otherwise(F.coalesce(by_intent, F.concat(F.lit("word "), first)))
    return out.withColumn("reason", reason).drop("_found").withColumn("needs_knowledge", F.col("reason").isNotNull())
