"""Registered queries of batch retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import texts as X
from ..operators import retrieval as R
from ..sources import testviews as tv

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries (every vector whose number 20 divides) and chunks (all vectors)."""
    chunks = tv.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    return chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding"), chunks


_NEAR = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    n AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(1 - list_cosine_similarity(q.e, c.e), 9) AS distance FROM v q, v c WHERE q.vec_id % 20 = 0),
    near AS (SELECT query_id, chunk_id, distance + 0.0 AS distance, k AS rank, round(1 - distance, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS k FROM n) WHERE k <= 5)"""


@query("vector_topk", f"WITH {_NEAR} SELECT query_id, chunk_id, rank, abs(distance) AS distance, similarity FROM near")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_topk(*vectors(spark, d)).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.abs("distance").alias("distance"), "similarity")


@query("searchable_count", "SELECT count(*) AS chunks, count(embedding) AS searchable FROM embeddings")
def searchable_count(spark: SparkSession, d: str) -> DataFrame:
    return R.searchable_count(vectors(spark, d)[1])


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: the source is the title, the language the section; both are keywords."""
    return tv.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_title"), F.col("lang").alias("section_title"), F.array("lang").alias("keywords"), F.array("source").alias("aliases"), F.col("text").alias("search_text"))


def terms(spark: SparkSession, d: str) -> DataFrame:
    """Search terms: the passages of the benchmark and, once each, the sources in capitals."""
    sources = tv.documents(spark, d).where("source is not null").select(F.upper("source").alias("term")).distinct().select((F.regexp_extract("term", "([0-9]+)$", 1).cast("long") + 100000).alias("query_id"), "term")
    return tv.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("term")).unionByName(sources)


def _grams_sql(c: str) -> str:
    words = rf"list_transform(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), lambda w: '  ' || w || ' ')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) - 1), lambda i: w[i:i + 2]))))"


_TERMS = "terms AS (SELECT item_id AS query_id, text AS term FROM benchmark UNION ALL SELECT CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) + 100000, upper(source) FROM (SELECT DISTINCT source FROM documents))"
_WORDS = f"""{_TERMS}, tg AS (SELECT *, {_grams_sql("term")} AS tt FROM terms), cg AS (SELECT doc_id AS chunk_id, source, lang, text, {_grams_sql("text")} AS cc FROM documents),
    p AS (SELECT query_id, term, chunk_id, source, lang, text, len(list_intersect(tt, cc)) AS h, len(tt) AS a, len(cc) AS b FROM tg, cg WHERE len(tt) >= 0.3 * len(cc) AND len(cc) >= 0.3 * len(tt)),
    sim AS (SELECT query_id, term, chunk_id, h / (a + b - h) AS s FROM p WHERE h >= 0.3 * (a + b - h)),
    m AS (SELECT query_id, term, c.chunk_id, lang = term AS r1, source = term AS r2, lower(lang) = lower(term) AS r3, lower(source) = lower(term) AS r4, contains(lower(lang), lower(term)) AS r5, contains(lower(source), lower(term)) AS r6,
        contains(lower(text), lower(term)) AS r7, s FROM tg CROSS JOIN cg c LEFT JOIN sim USING (query_id, term, chunk_id)),
    hit AS (SELECT query_id, term, chunk_id, array_to_string(list_filter([CASE WHEN r1 THEN 'section_title_exact' END, CASE WHEN r2 THEN 'document_title_exact' END, CASE WHEN r3 THEN 'keywords_exact' END, CASE WHEN r4 THEN 'aliases_exact' END,
        CASE WHEN r5 THEN 'section_title_contains' END, CASE WHEN r6 THEN 'document_title_contains' END, CASE WHEN r7 THEN 'search_text_contains' END, CASE WHEN s IS NOT NULL THEN 'search_text_trigram' END], lambda x: x IS NOT NULL), ',') AS matched_terms,
        round(greatest(CASE WHEN r1 THEN 100 ELSE 0 END, CASE WHEN r2 THEN 90 ELSE 0 END, CASE WHEN r3 THEN 80 ELSE 0 END, CASE WHEN r4 THEN 70 ELSE 0 END, CASE WHEN r5 THEN 60 ELSE 0 END, CASE WHEN r6 THEN 50 ELSE 0 END, CASE WHEN r7 THEN 40 ELSE 0 END, 30.0::DOUBLE * coalesce(s, 0)), 9) AS keyword_score FROM m),
    found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, term ORDER BY keyword_score DESC, chunk_id) AS rank FROM hit WHERE matched_terms <> '') WHERE rank <= 10)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_search(terms(spark, d), text_chunks(spark, d), 10)


@query("keyword_search", f"WITH {_WORDS} SELECT query_id, chunk_id, matched_terms, keyword_score, rank FROM found")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("query_id", "chunk_id", F.array_join("matched_terms", ",").alias("matched_terms"), "keyword_score", F.col("rank").cast("long").alias("rank"))


@query("trigram_similarity", f"WITH g AS (SELECT p_partkey, {_grams_sql('p_name')} AS a, {_grams_sql('p_type')} AS b FROM part), h AS (SELECT *, len(list_intersect(a, b)) AS n FROM g) SELECT p_partkey, round(coalesce(n / nullif(len(a) + len(b) - n, 0), 0), 9) AS similarity FROM h")
def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    return tv.table(spark, d, "part").select("p_partkey", F.round(X.trigram_similarity(F.col("p_name"), F.col("p_type")), 9).alias("similarity"))


def plans(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as queries: their lines are rewrites, their first words keywords."""
    raw = tv.table(spark, d, "conversations").where("trim(text) <> ''").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("original_query"), F.split("text", "[.] ?").alias("rewritten_queries"), F.split("text", " ").alias("keywords"))
    return R.query_plan(raw)


_STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
_UNIQUE = "list_filter({0}, lambda y, i: list_position(list_transform({0}, lambda z: lower(z)), lower(y)) = i)"
_PLANS = f"""q AS (SELECT conv_id * 100 + turn AS query_id, {_STRIP.format("text")} AS original_query, list_filter(list_transform(string_split_regex(text, '[.] ?'), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS r,
        list_filter(list_transform(string_split(text, ' '), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS k FROM conversations WHERE trim(text) <> ''),
    p AS (SELECT query_id, original_query, list_filter({_UNIQUE.format("r")}, lambda x: lower(x) <> lower(original_query))[1:2] AS rewritten_queries, {_UNIQUE.format("k")} AS keywords FROM q)"""


@query("query_plan", f"WITH {_PLANS} SELECT query_id, original_query, array_to_string(rewritten_queries, '|') AS rewritten_queries, array_to_string(keywords, '|') AS keywords FROM p")
def query_plan(spark: SparkSession, d: str) -> DataFrame:
    return plans(spark, d).select("query_id", "original_query", *[F.array_join(c, "|").alias(c) for c in ("rewritten_queries", "keywords")])


_LISTS = f"""l AS (SELECT query_id, list_concat([original_query], rewritten_queries) AS v, keywords FROM p), w AS (SELECT *, list_concat(v, keywords) AS u FROM l), x AS (SELECT query_id, v, {_UNIQUE.format("u")} AS u FROM w)"""


@query("search_terms", f"WITH {_PLANS}, {_LISTS} SELECT query_id, unnest(range(0, len(v) + len(u))) AS list_no, unnest(list_concat(list_transform(v, lambda y: 'vector'), list_transform(u, lambda y: 'keyword'))) AS retrieval_type, unnest(list_concat(v, u)) AS query FROM x")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    return R.search_terms(plans(spark, d))


def ranked_lists(spark: SparkSession, d: str) -> DataFrame:
    """Ranked lists out of the event stream: a query is a user, a list an event type, ranked by the largest value of a chunk."""
    hits = tv.table(spark, d, "events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("query"), (F.col("event_id") % 40).alias("chunk_id")).agg(F.max("value").alias("value"))
    names = F.create_map(*[F.lit(x) for i, t in enumerate(("click", "error", "purchase", "signup", "view")) for x in (t, i)])
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("value"), "chunk_id"))
    return hits.select("query_id", names[F.col("query")].cast("long").alias("list_no"), F.when(F.col("query").isin("click", "view"), "vector").otherwise("keyword").alias("retrieval_type"), "query", rank.cast("long").alias("rank"), "chunk_id", F.col("value").alias("distance"), F.col("value").alias("keyword_score")).where("rank <= 10")


_RANKED = """h AS (SELECT user_id AS query_id, event_type AS query, event_id % 40 AS chunk_id, max(value) AS value FROM events GROUP BY ALL),
    ranked AS (SELECT * FROM (SELECT query_id, CASE query WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS list_no, CASE WHEN query IN ('click', 'view') THEN 'vector' ELSE 'keyword' END AS side, query,
        row_number() OVER (PARTITION BY query_id, query ORDER BY value DESC, chunk_id) AS rank, chunk_id, value FROM h) WHERE rank <= 10)"""
_FUSED = """f AS (SELECT query_id, chunk_id, round(list_sum(list(1.0::DOUBLE / (60 + rank) ORDER BY list_no)), 12) AS rrf_score, min(rank) FILTER (side = 'vector') AS vector_rank, min(rank) FILTER (side = 'keyword') AS keyword_rank,
        arg_min(value, (rank, list_no)) FILTER (side = 'vector') AS distance, arg_min(value, (rank, list_no)) FILTER (side = 'keyword') AS keyword_score, min((list_no, rank)) AS seen, string_agg(query, ',' ORDER BY list_no) AS matched_queries FROM ranked GROUP BY ALL),
    fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, least(vector_rank, keyword_rank), seen, chunk_id) AS position FROM f) WHERE position <= 20)"""


@query("rrf_fusion", f"WITH {_RANKED}, {_FUSED} SELECT query_id, chunk_id, position, rrf_score, CAST(vector_rank AS VARCHAR) AS vector_rank, CAST(keyword_rank AS VARCHAR) AS keyword_rank, distance, keyword_score, matched_queries FROM fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    out = R.rrf(ranked_lists(spark, d))
    return out.select("query_id", "chunk_id", F.col("position").cast("long").alias("position"), "rrf_score", *[F.col(c).cast("string").alias(c) for c in ("vector_rank", "keyword_rank")], "distance", "keyword_score", F.array_join("matched_queries", ",").alias("matched_queries"))


@query(
    "hybrid_search",
    f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    n AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(1 - list_cosine_similarity(q.e, c.e), 9) AS distance FROM v q JOIN benchmark ON item_id = q.vec_id, v c JOIN documents ON doc_id = c.vec_id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM n) WHERE rank <= 10), {_WORDS},
    ranked AS (SELECT query_id, 0 AS list_no, 'vector' AS side, chunk_id, rank, distance AS value, '' AS query FROM near UNION ALL SELECT query_id, 1, 'keyword', chunk_id, rank, keyword_score, '' FROM found WHERE query_id < 100000), {_FUSED}
    SELECT query_id, chunk_id, position, rrf_score, CAST(vector_rank AS VARCHAR) AS vector_rank, CAST(keyword_rank AS VARCHAR) AS keyword_rank FROM fused""",
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as queries, with vectors from the table of embeddings, against documents with vectors."""
    items = tv.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("original_query"), F.array().cast("array<string>").alias("rewritten_queries"), F.array().cast("array<string>").alias("keywords"))
    plan = R.query_plan(items)
    embedded = tv.table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = plan.join(embedded, plan.query_id == embedded.vec_id).select("query_id", F.col("original_query").alias("query"), "embedding")
    chunks = text_chunks(spark, d).join(embedded, F.col("chunk_id") == F.col("vec_id"), "left").drop("vec_id")
    out = R.hybrid_search(plan, asked, chunks)
    return out.select("query_id", "chunk_id", F.col("position").cast("long").alias("position"), "rrf_score", *[F.col(c).cast("string").alias(c) for c in ("vector_rank", "keyword_rank")])


# Rerank scores: every third query has none, every fifth a bad one.
_SCORES = "scores AS (SELECT query_id, position - 1 AS \"index\", CASE WHEN query_id % 5 = 0 AND position = 2 THEN 1.5 ELSE round(((chunk_id * 7) % 11) / 11, 6) END AS relevance_score FROM fused WHERE query_id % 3 <> 0 AND position <= 8)"
_RERANKED = f"""{_SCORES}, sound AS (SELECT * FROM scores WHERE query_id NOT IN (SELECT query_id FROM scores WHERE relevance_score NOT BETWEEN 0 AND 1)),
    j AS (SELECT fused.query_id, chunk_id, position, relevance_score AS rerank_score FROM fused LEFT JOIN sound ON fused.query_id = sound.query_id AND position - 1 = "index"),
    final AS (SELECT * FROM (SELECT *, bool_or(rerank_score IS NOT NULL) OVER (PARTITION BY query_id) AS rerank_applied, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, position) AS final_rank FROM j) WHERE final_rank <= 5)"""


def reranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lists = ranked_lists(spark, d)
    fused = R.rrf(lists).select("query_id", "chunk_id", F.col("position").cast("long").alias("position"))
    score = F.when((F.col("query_id") % 5 == 0) & (F.col("position") == 2), 1.5).otherwise(F.round(((F.col("chunk_id") * 7) % 11) / 11, 6))
    scores = fused.where("query_id % 3 <> 0 and position <= 8").select("query_id", (F.col("position") - 1).alias("index"), score.alias("relevance_score"))
    return lists, fused, R.rerank(fused, scores)


@query("rerank_merge", f"WITH {_RANKED}, {_FUSED}, {_RERANKED} SELECT query_id, chunk_id, position, rerank_score, rerank_applied, final_rank FROM final")
def rerank_merge(spark: SparkSession, d: str) -> DataFrame:
    return reranked(spark, d)[2].withColumn("final_rank", F.col("final_rank").cast("long"))


@query("rerank_input", "SELECT doc_id, md5('文档：' || source || chr(10) || '小节：' || lang || chr(10) || chr(10) || text) AS digest FROM documents WHERE text IS NOT NULL")
def rerank_input(spark: SparkSession, d: str) -> DataFrame:
    return tv.documents(spark, d).where("text is not null").select("doc_id", F.md5(R.rerank_input(F.col("source"), F.col("lang"), F.col("text")).cast("binary")).alias("digest"))


_FLAT = _STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')")


@query("source_preview", f"WITH t AS (SELECT doc_id, {_FLAT} AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN length(x) > 120 THEN x[1:120] || '…' ELSE x END AS preview FROM t")
def source_preview(spark: SparkSession, d: str) -> DataFrame:
    return tv.documents(spark, d).where("text is not null").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query(
    "context_block",
    f"""WITH {_RANKED}, {_FUSED}, {_RERANKED} SELECT query_id, '<<<' || chr(10) || string_agg('[资料 ' || final_rank || '] 来源：part' || chunk_id || ' / ' || p_brand || chr(10) || p_name, chr(10) || chr(10) ORDER BY final_rank) || chr(10) || '>>>' AS context
    FROM final JOIN part ON p_partkey = chunk_id GROUP BY query_id""",
)
def context_block(spark: SparkSession, d: str) -> DataFrame:
    parts = tv.table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("source_file"), F.col("p_brand").alias("section_title"), F.col("p_name").alias("content"))
    return R.context_block(reranked(spark, d)[2].join(parts, "chunk_id"))


@query(
    "retrieval_summary",
    f"""WITH {_RANKED}, {_FUSED}, {_RERANKED}, a AS (SELECT query_id, count(DISTINCT query) AS query_count FROM ranked GROUP BY ALL), b AS (SELECT query_id, count(*) AS candidates_considered FROM fused GROUP BY ALL),
    c AS (SELECT query_id, bool_or(rerank_applied) AS rerank_applied, count(*) AS final_count FROM final GROUP BY ALL) SELECT * FROM a JOIN b USING (query_id) JOIN c USING (query_id)""",
)
def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.summary(*reranked(spark, d))


@query(
    "probe_hits",
    f"""WITH {_WORDS}, truth AS (SELECT DISTINCT item_id AS query_id, doc_id AS chunk_id FROM benchmark, documents WHERE contains(documents.text, benchmark.text))
    SELECT t.query_id, bool_or(rank IS NOT NULL) AS hit, CAST(min(rank) AS VARCHAR) AS best_rank, count(DISTINCT t.chunk_id) AS expected FROM truth t LEFT JOIN found f ON f.query_id = t.query_id AND f.chunk_id = t.chunk_id AND rank <= 5 GROUP BY t.query_id""",
)
def probe_hits(spark: SparkSession, d: str) -> DataFrame:
    items = tv.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    chunks = text_chunks(spark, d)
    return R.probe_hits(_found(spark, d), R.holders(items, chunks)).withColumn("best_rank", F.col("best_rank").cast("string"))
