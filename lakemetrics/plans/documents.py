"""Registered queries of the document corpus, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts as X
from ..operators import corpus
from ..sources import shared
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


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown: a heading over all, a numbered section every 8 lines, lines as paragraphs."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 8 == 0, F.concat(F.lit("## "), (F.floor(i / 8) + 1).cast("string"), F.lit(". part "), (F.floor(i / 8) + 1).cast("string"), F.lit("\n"))).otherwise(""), x))
    return tv.documents(spark, d).where("text is not null").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"), F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.array_join(lines, "\n\n")).alias("text"))


def plain(spark: SparkSession, d: str) -> DataFrame:
    return tv.documents(spark, d).where("text is not null").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


_EDGE = r"'[ \t\n\r\x0B\f]+'"
_CLEAN = r"regexp_replace(regexp_replace({}, '[ \t]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


#: Sections (source_file, title, section, k, body) of the Markdown and plain views.
_MD = rf"""l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL),
    b AS (SELECT 'doc/' || doc_id || '.md' AS source_file, 'Doc ' || doc_id AS document_title, 'part ' || (i // 8 + 1) AS section_title, i // 8 AS k, {_strip(_CLEAN.format("string_agg(x, chr(10) || chr(10) ORDER BY i)"))} AS body FROM l GROUP BY doc_id, i // 8)"""
_PLAIN = rf"""b AS (SELECT 'doc/' || doc_id || '.txt' AS source_file, CAST(doc_id AS VARCHAR) AS document_title, '{corpus.PLAIN_TITLE}' AS section_title, 0 AS k, {_strip(_CLEAN.format("replace(text, chr(10), chr(10) || chr(10))"))} AS body FROM documents WHERE text IS NOT NULL)"""
#: Greedy packing of the blocks of bodies over the limit, one block a step, then numbers across a document.
_CHUNKS = r"""z AS (SELECT source_file, k, unnest(range(0, len(string_split_regex(body, '\n\s*\n')))) AS i, unnest(string_split_regex(body, '\n\s*\n')) AS x FROM b WHERE length(body) > 1200),
    s(source_file, k, i, piece, n) AS (SELECT source_file, k, i, 0, length(x) + 2 FROM z WHERE i = 0
        UNION ALL SELECT z.source_file, z.k, z.i, CASE WHEN n + length(x) + 2 > 1200 THEN piece + 1 ELSE piece END, CASE WHEN n + length(x) + 2 > 1200 THEN length(x) + 2 ELSE n + length(x) + 2 END
        FROM s JOIN z ON z.source_file = s.source_file AND z.k = s.k AND z.i = s.i + 1),
    p AS (SELECT source_file, k, piece, string_agg(x, chr(10) || chr(10) ORDER BY i) AS content FROM s JOIN z USING (source_file, k, i) GROUP BY ALL
        UNION ALL SELECT source_file, k, 0, body FROM b WHERE length(body) <= 1200 AND body <> ''),
    c AS (SELECT source_file, document_title, section_title, row_number() OVER (PARTITION BY source_file ORDER BY k, piece) - 1 AS chunk_index, content FROM p JOIN b USING (source_file, k)),
    e AS (SELECT *, '文档：' || document_title || chr(10) || '小节：' || section_title || chr(10) || chr(10) || content AS whole FROM c)"""
_TOKENS = "CAST(round_even(len(regexp_extract_all(content, '[A-Za-z0-9_]+')) * 1.3::DOUBLE, 0) AS BIGINT)"


def _chunk_sql(view: str) -> str:
    return f"WITH RECURSIVE {view}, {_CHUNKS} SELECT source_file, document_title, section_title, chunk_index, content, sha256(whole) AS content_hash, length(content) AS char_count FROM e"


_CHUNK_COLUMNS = ("source_file", "document_title", "section_title", "chunk_index", "content", "content_hash", "char_count")


@query("normalised_text", r"SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def normalised_text(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat(F.lit("﻿"), F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return tv.documents(spark, d).where("text is not null").select("doc_id", X.normalise(dirty).alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("section_titles", f"WITH {_MD} SELECT source_file, document_title, k AS section, section_title FROM b WHERE body <> ''")
def section_titles(spark: SparkSession, d: str) -> DataFrame:
    docs = markdown(spark, d).select("source_file", corpus.title_of(F.col("text"), corpus.stem_of(F.col("source_file"))).alias("document_title"), corpus.sections_of(F.col("text")).alias("_s"))
    out = docs.select("source_file", "document_title", F.explode("_s.section_title").alias("section_title"))
    return out.withColumn("section", F.regexp_extract("section_title", "([0-9]+)$", 1).cast("long") - 1)


@query("clean_body", rf"SELECT doc_id, {_strip(_CLEAN.format("replace(text, '. ', '.  ' || chr(10) || chr(10) || chr(10) || chr(10))"))} AS body FROM documents WHERE text IS NOT NULL")
def clean_body(spark: SparkSession, d: str) -> DataFrame:
    return tv.documents(spark, d).where("text is not null").select("doc_id", X.clean_body(F.replace("text", F.lit(". "), F.lit(".  \n\n\n\n"))).alias("body"))


@query("chunk_plain", _chunk_sql(_PLAIN))
def chunk_plain(spark: SparkSession, d: str) -> DataFrame:
    return corpus.chunk(plain(spark, d), markdown=False).select(*_CHUNK_COLUMNS)


@query("chunk_markdown", _chunk_sql(_MD))
def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    return corpus.chunk(markdown(spark, d)).select(*_CHUNK_COLUMNS)


@query("token_estimate", f"SELECT doc_id, {_TOKENS.replace('content', 'text')} AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return tv.documents(spark, d).where("text is not null").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("chunk_hash", "SELECT doc_id, sha256('文档：' || source || chr(10) || '小节：' || lang || chr(10) || chr(10) || text) AS content_hash FROM documents WHERE text IS NOT NULL")
def chunk_hash(spark: SparkSession, d: str) -> DataFrame:
    return tv.documents(spark, d).where("text is not null").select("doc_id", F.sha2(corpus.embedding_text(F.col("source"), F.col("lang"), F.col("text")), 256).alias("content_hash"))


_DOC_HASH = "h AS (SELECT source_file, document_title, sha256(string_agg(sha256(whole), chr(10) ORDER BY chunk_index)) AS content_hash, count(*) AS chunk_count FROM e GROUP BY ALL)"


@query("document_hash", f"WITH RECURSIVE {_MD}, {_CHUNKS}, {_DOC_HASH} SELECT * FROM h")
def document_hash(spark: SparkSession, d: str) -> DataFrame:
    return corpus.document_hash(corpus.chunk(markdown(spark, d)))


# The corpus as it was: every third document is missing, every fifth had another hash, and one of four chunks has a vector.
def _number():
    return F.regexp_extract("source_file", "([0-9]+)", 1).cast("long")


_OLD = "i AS (SELECT *, CAST(regexp_extract(source_file, '([0-9]+)', 1) AS BIGINT) AS x FROM h), o AS (SELECT source_file, CASE WHEN x % 5 = 0 THEN 'other' ELSE content_hash END AS old FROM i WHERE x % 3 <> 0), g AS (SELECT i.*, CASE WHEN old IS NULL THEN 'insert' WHEN old = content_hash THEN 'skip' ELSE 'update' END AS action FROM i LEFT JOIN o USING (source_file))"
_PLAN = f"WITH RECURSIVE {_MD}, {_CHUNKS}, {_DOC_HASH}, {_OLD}"
_MODEL = "m"


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New chunks, the plan, and old chunks with some vectors."""
    # Chunks are cut once: the plan, the old chunks and the new ones all refer to them.
    new = shared.staged(corpus.chunk(markdown(spark, d)).select("source_file", "document_title", "chunk_index", "content_hash"), "chunks")
    hashes = corpus.document_hash(new)
    old = hashes.where(_number() % 3 != 0).select("source_file", F.when(_number() % 5 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"))
    had = new.where(_number() % 3 != 0).select("source_file", "chunk_index", "content_hash", F.when((_number() + F.col("chunk_index")) % 4 == 0, F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float"))).alias("embedding"), F.lit(_MODEL).alias("embedding_model"))
    return new, corpus.sync_plan(hashes, old), had


@query("sync_plan", f"{_PLAN} SELECT source_file, document_title, content_hash, chunk_count, action FROM g")
def sync_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)[1]


_DUE = """u AS (SELECT e.source_file, e.chunk_index, sha256(whole) AS content_hash, action, x FROM e JOIN g USING (source_file) WHERE action <> 'skip'),
    v AS (SELECT DISTINCT e.source_file, sha256(whole) AS content_hash FROM e JOIN i USING (source_file) WHERE x % 3 <> 0 AND (x + chunk_index) % 4 = 0),
    w AS (SELECT u.*, v.source_file IS NULL OR action <> 'update' AS needs_vector FROM u LEFT JOIN v ON u.source_file = v.source_file AND u.content_hash = v.content_hash)"""


@query("reuse_vectors", f"{_PLAN}, {_DUE} SELECT source_file, chunk_index, content_hash, action, needs_vector FROM w")
def reuse_vectors(spark: SparkSession, d: str) -> DataFrame:
    new, plan, old = _plan(spark, d)
    return corpus.reuse_vectors(new, plan, old, _MODEL).select("source_file", "chunk_index", "content_hash", "action", "needs_vector")


@query("attached_vectors", f"{_PLAN}, {_DUE} SELECT source_file, chunk_index, CAST(CASE WHEN needs_vector THEN 5 ELSE 3 END AS DOUBLE) AS total FROM w")
def attached_vectors(spark: SparkSession, d: str) -> DataFrame:
    new, plan, old = _plan(spark, d)
    due = corpus.reuse_vectors(new, plan, old, _MODEL)
    vectors = due.where("needs_vector").select("content_hash", F.array(F.lit(2.0).cast("float"), F.lit(3.0).cast("float")).alias("embedding"))
    out = corpus.attach_vectors(due, vectors, 2, _MODEL)
    return out.select("source_file", "chunk_index", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("applied_chunks", f"{_PLAN} SELECT e.source_file, e.chunk_index, sha256(whole) AS content_hash, action FROM e JOIN g USING (source_file)")
def applied_chunks(spark: SparkSession, d: str) -> DataFrame:
    new, plan, old = _plan(spark, d)
    columns = ["source_file", "chunk_index", "content_hash"]
    return corpus.apply_plan(old.select(*columns), new.select(*columns), plan).join(plan.select("source_file", "action"), "source_file")


@query("sync_summary", f"{_PLAN}, {_DUE} SELECT (SELECT count(*) FROM g) AS scanned, (SELECT count(*) FROM g WHERE action = 'insert') AS inserted, (SELECT count(*) FROM g WHERE action = 'update') AS updated, (SELECT count(*) FROM g WHERE action = 'skip') AS skipped, (SELECT count(*) FROM w) AS inserted_chunks, (SELECT count(*) FROM w WHERE needs_vector) AS embedded_chunks")
def sync_summary(spark: SparkSession, d: str) -> DataFrame:
    new, plan, old = _plan(spark, d)
    return corpus.sync_summary(plan, corpus.reuse_vectors(new, plan, old, _MODEL))


@query("corpus_summary", f"WITH RECURSIVE {_PLAIN}, {_CHUNKS} SELECT source_file, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM c GROUP BY ALL")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return corpus.corpus_summary(corpus.chunk(plain(spark, d), markdown=False))


_TERMS = r"list_filter(list_transform(string_split_regex(text, '[ \n]'), lambda w: trim(w)), lambda w: w <> '' AND length(w) <= 80)"


@query("term_normalise", f"WITH t AS (SELECT conv_id, turn, {_TERMS} AS w FROM conversations), l AS (SELECT conv_id, turn, w, list_transform(w, lambda y: lower(y)) AS k FROM t) SELECT conv_id, turn, array_to_string(list_filter(w, lambda y, i: list_position(k, lower(y)) = i)[1:12], '|') AS terms FROM l")
def term_normalise(spark: SparkSession, d: str) -> DataFrame:
    return tv.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(corpus.normalise_terms(F.split("text", "[ \n]")), "|").alias("terms"))


_ENRICHED = "'文档：' || source || chr(10) || '小节：' || lang || chr(10) || '关键词：' || lang || '、' || source || chr(10) || '同义表达：' || chr(10) || chr(10) || '正文：' || chr(10) || text"


@query("search_text", f"SELECT doc_id, md5(concat_ws(chr(10), source, lang, text)) AS base, md5({_ENRICHED}) AS enriched FROM documents WHERE text IS NOT NULL")
def search_text(spark: SparkSession, d: str) -> DataFrame:
    title, section, body = F.col("source"), F.col("lang"), F.col("text")
    enriched = corpus.enriched_search_text(title, section, body, F.array(section, title), F.array().cast("array<string>"))
    return tv.documents(spark, d).where("text is not null").select("doc_id", *[F.md5(c.cast("binary")).alias(n) for n, c in (("base", corpus.base_search_text(title, section, body)), ("enriched", enriched))])


@query("backfill_targets", "SELECT doc_id AS chunk_id, source AS document_title FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0")
def backfill_targets(spark: SparkSession, d: str) -> DataFrame:
    base = corpus.base_search_text(F.col("source"), F.col("lang"), F.col("text"))
    rows = tv.documents(spark, d).where("text is not null").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_title"), F.col("lang").alias("section_title"), F.col("text").alias("content"), F.when(F.col("doc_id") % 3 == 0, F.concat(base, F.lit("!"))).otherwise(base).alias("search_text"))
    return corpus.backfill_targets(rows).select("chunk_id", "document_title")


@query(
    "layout_markdown",
    """WITH l AS (SELECT conv_id AS doc_id, turn AS line_no, text, CASE role WHEN 'system' THEN 15.0 WHEN 'user' THEN 12.0 ELSE 10.0 END AS size, turn * 20.0 + CASE WHEN turn % 4 = 3 THEN 9.0 ELSE 0.0 END AS top FROM conversations),
    g AS (SELECT *, top - lag(top + 12) OVER (PARTITION BY doc_id ORDER BY line_no) AS gap FROM l),
    s AS (SELECT doc_id, arg_max(size, (n, -a)) AS body FROM (SELECT doc_id, size, sum(length(text)) AS n, min(line_no) AS a FROM l GROUP BY ALL) GROUP BY ALL),
    u AS (SELECT doc_id, arg_max(step, (n, -a)) AS usual FROM (SELECT doc_id, round_even(gap / 0.5, 0) * 0.5 AS step, count(*) AS n, min(line_no) AS a FROM g WHERE round_even(gap / 0.5, 0) > 0 GROUP BY ALL) GROUP BY ALL),
    r AS (SELECT g.*, usual, size / body AS ratio FROM g JOIN s USING (doc_id) LEFT JOIN u USING (doc_id)),
    t AS (SELECT *, CASE WHEN ratio >= 1.35 AND sum(CASE WHEN ratio >= 1.35 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) = 1 THEN '# ' WHEN ratio >= 1.15 THEN '## ' ELSE '' END || text AS x FROM r)
    SELECT doc_id, string_agg(CASE WHEN usual > 0 AND gap > usual * 1.4 THEN chr(10) ELSE '' END || x, chr(10) ORDER BY line_no) AS markdown FROM t GROUP BY doc_id""",
)
def layout_markdown(spark: SparkSession, d: str) -> DataFrame:
    top = F.col("turn") * 20.0 + F.when(F.col("turn") % 4 == 3, 9.0).otherwise(0.0)
    lines = tv.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), "text", F.when(F.col("role") == "system", 15.0).when(F.col("role") == "user", 12.0).otherwise(10.0).alias("size"), top.alias("top"), (top + 12).alias("bottom"))
    return corpus.layout_markdown(lines)
