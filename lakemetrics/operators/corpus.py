"""Documents to chunks, and the incremental synchronisation of a chunk corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import texts as X

MAX_SECTION = 1200
FRONT_TITLE, PLAIN_TITLE = "文档元信息", "正文"
DOCUMENT, SECTION, KEYWORDS, ALIASES, BODY, SEPARATOR = "文档", "小节", "关键词", "同义表达", "正文", "、"
MOST_TERMS, LONGEST_TERM = 12, 80

_H1 = r"(?m)^#[ \t]+(\S(?:.*\S)?)[ \t]*$"
_H2_START = r"(?m)^(?=##[ \t]+\S)"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every Markdown file below a folder, whole, by its path."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text")).orderBy("source_file")


def decode_utf8(files: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Files whose bytes are valid UTF-8, with their text, and those that aren't; nothing is replaced."""
    raw = F.col(content).cast("string")
    return files.where(F.is_valid_utf8(raw)).withColumn("text", raw).drop(content), files.where(~F.is_valid_utf8(raw)).drop(content)


def title_of(text: Column, stem: Column, explicit: Column | None = None) -> Column:
    """The explicit title, else the first level-one heading, else the file's stem."""
    found = F.nullif(F.regexp_extract(text, _H1, 1), F.lit(""))
    return F.coalesce(*([F.nullif(X.strip(explicit), F.lit(""))] if explicit is not None else []), found, stem)


def stem_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def sections_of(text: Column) -> Column:
    """Array of (title, body): level-two headings begin a section, what stands between the level-one heading and the
    first of them is the front matter; lines before the level-one heading are dropped, and so are empty sections."""
    behind = F.when(F.regexp_extract(text, _H1, 1) != "", F.regexp_replace(text, r"(?s)\A.*?(?m:^#[ \t]+\S[^\n]*$)", "")).otherwise(text)
    parts = F.split(behind, _H2_START)

    def section(p: Column) -> Column:
        head = F.regexp_extract(p, r"\A##[ \t]+(\S(?:.*\S)?)[ \t]*(?:\n|\z)", 1)
        body = F.regexp_replace(p, r"\A##[ \t]+\S.*(?:\n|\z)", "")
        return F.struct(F.when(head != "", X.clean_title(head)).otherwise(FRONT_TITLE).alias("section_title"), X.clean_body(F.when(head != "", body).otherwise(p)).alias("body"))

    return F.filter(F.transform(parts, section), lambda s: s["body"] != "")


def chunk(docs: DataFrame, markdown: bool = True, limit: int = MAX_SECTION) -> DataFrame:
    """Chunks of documents (source_file, text, and title where given), numbered from 0 across a document's sections.

    Everything happens inside the row, so documents are never shuffled; each piece of a section is a chunk with its text
    for embedding, the hash of that, and its size.
    """
    text = X.normalise(F.col("text"))
    explicit = F.col("title") if "title" in docs.columns else None
    sections = sections_of(text) if markdown else F.filter(F.array(F.struct(F.lit(PLAIN_TITLE).alias("section_title"), X.clean_body(text).alias("body"))), lambda s: s["body"] != "")
    pieces = F.flatten(F.transform(F.col("_sections"), lambda s: F.transform(X.pack_blocks(s["body"], limit), lambda p: F.struct(s["section_title"].alias("section_title"), p.alias("content")))))
    rows = docs.select("source_file", title_of(text, stem_of(F.col("source_file")), explicit).alias("document_title"), sections.alias("_sections"))
    out = rows.select("source_file", "document_title", F.posexplode(pieces).alias("chunk_index", "_piece")).select("source_file", "document_title", F.col("_piece.section_title"), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("_piece.content"))
    return described(out)


def embedding_text(title: Column, section: Column, body: Column) -> Column:
    return F.concat(F.lit(f"{DOCUMENT}："), title, F.lit(f"\n{SECTION}："), section, F.lit("\n\n"), body)


def described(chunks: DataFrame) -> DataFrame:
    whole = embedding_text(F.col("document_title"), F.col("section_title"), F.col("content"))
    return chunks.withColumns({"content_for_embedding": whole, "content_hash": F.sha2(whole, 256), "estimated_token_count": X.token_estimate(F.col("content")), "char_count": F.length("content").cast("long")})


def document_hash(chunks: DataFrame) -> DataFrame:
    """SHA-256 of a document's chunk hashes in order, joined by newlines."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content_hash"))), lambda x: x["content_hash"])
    return chunks.groupBy("source_file").agg(F.max("document_title").alias("document_title"), F.sha2(F.array_join(ordered, "\n"), 256).alias("content_hash"), F.count("*").alias("chunk_count"))


def sync_plan(new: DataFrame, existing: DataFrame) -> DataFrame:
    """insert, skip (same hash) or update for every new document; documents that are absent now are left alone."""
    old = existing.select("source_file", F.col("content_hash").alias("_old"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_old") == F.col("content_hash"), "skip").otherwise("update")
    return new.join(old, "source_file", "left").withColumn("action", action).drop("_old")


def reuse_vectors(chunks: DataFrame, plan: DataFrame, old: DataFrame, model: str) -> DataFrame:
    """Chunks of documents to insert or update, with the vector that the same document and model had for the same hash."""
    known = old.where((F.col("embedding_model") == model) & F.col("embedding").isNotNull()).groupBy("source_file", "content_hash").agg(F.first("embedding").alias("embedding"))
    due = chunks.join(plan.where("action <> 'skip'").select("source_file", "action"), "source_file")
    return due.join(known, ["source_file", "content_hash"], "left").withColumn("embedding", F.when(F.col("action") == "update", F.col("embedding"))).withColumn("needs_vector", F.col("embedding").isNull())


def attach_vectors(chunks: DataFrame, vectors: DataFrame, dim: int, model: str) -> DataFrame:
    """Fills missing vectors by content hash; a vector of another size is an error."""
    new = vectors.groupBy("content_hash").agg(F.first("embedding").alias("_new"))
    vector = F.coalesce("embedding", "_new")
    checked = F.when(F.size(vector) == dim, vector).when(vector.isNull(), None).otherwise(F.raise_error(F.lit(f"a vector hasn't {dim} elements")).cast("array<float>"))
    return chunks.join(new, "content_hash", "left").withColumn("embedding", checked).withColumn("embedding_model", F.when(F.col("embedding").isNotNull(), F.lit(model))).drop("_new", "needs_vector")


def apply_plan(old: DataFrame, new: DataFrame, plan: DataFrame) -> DataFrame:
    """The corpus after a synchronisation: all old chunks of updated documents go, new ones of due documents come."""
    kept = old.join(plan.where("action = 'update'").select("source_file"), "source_file", "left_anti")
    fresh = new.join(plan.where("action <> 'skip'").select("source_file"), "source_file", "left_semi")
    return kept.unionByName(fresh, allowMissingColumns=True)


def sync_summary(plan: DataFrame, due: DataFrame) -> DataFrame:
    """Documents scanned, inserted, updated and skipped; chunks inserted and embedded."""
    docs = plan.agg(F.count("*").alias("scanned"), *[F.count_if(F.col("action") == a).alias(n) for a, n in (("insert", "inserted"), ("update", "updated"), ("skip", "skipped"))])
    chunks = due.agg(F.count("*").alias("inserted_chunks"), F.count_if(F.col("needs_vector")).alias("embedded_chunks"))
    return docs.crossJoin(chunks)  # one row each


def corpus_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_file").agg(F.count("*").alias("chunks"), F.sum("char_count").alias("chars"))


def document_list(documents: DataFrame) -> DataFrame:
    """Documents, the last updated first, then by name."""
    return documents.select("source_file", "document_title", "chunk_count", "created_at", "updated_at").orderBy(F.desc("updated_at"), "source_file")


def normalise_terms(terms: Column) -> Column:
    return X.distinct_terms(terms, MOST_TERMS, LONGEST_TERM)


def base_search_text(title: Column, section: Column, body: Column) -> Column:
    """Title, section and body by lines; nulls are left out, empty ones stay."""
    return F.concat_ws("\n", title, section, body)


def enriched_search_text(title: Column, section: Column, body: Column, keywords: Column, aliases: Column) -> Column:
    """Labelled lines; the labels of keywords and aliases stand there even if there are none."""
    line = lambda label, c: F.concat(F.lit(f"{label}："), c)
    return F.array_join(F.array(line(DOCUMENT, title), line(SECTION, section), line(KEYWORDS, F.array_join(keywords, SEPARATOR)), line(ALIASES, F.array_join(aliases, SEPARATOR)), F.lit(""), F.lit(f"{BODY}："), body), "\n")


def backfill_targets(chunks: DataFrame, refresh: bool = False, limit: int | None = None) -> DataFrame:
    """Chunks whose search text still is the base text (all with refresh), by id; a limit counts after the filter."""
    base = base_search_text(F.col("document_title"), F.col("section_title"), F.col("content"))
    due = chunks if refresh else chunks.where(F.col("search_text") == base)
    due = due.orderBy("chunk_id")
    return due.limit(limit) if limit is not None else due


def backfilled(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """chunks with the new search text where there is one; rows that failed keep the old one."""
    new = done.select("chunk_id", F.col("search_text").alias("_new"))
    return chunks.join(new, "chunk_id", "left").withColumn("search_text", F.coalesce("_new", "search_text")).drop("_new")


def enrich(chunks: DataFrame, function: Callable[[list[str]], list], column: str, kind: str, batch: int = 10, of: str = "content_for_embedding") -> DataFrame:
    """Calls function on batches of texts, in order, and adds its results; a batch that fails gives nulls.

    The seam for an external model: function takes up to `batch` texts and returns as many results.
    """
    schema = T.StructType(list(chunks.schema.fields)).add(column, kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = []
            for at in range(0, len(pdf), batch):
                part = pdf[of].iloc[at : at + batch].tolist()
                try:
                    got = list(function(part))
                    out += got if len(got) == len(part) else [None] * len(part)
                except Exception:  # a failed call degrades its rows, and no more
                    out += [None] * len(part)
            yield pdf.assign(**{column: pd.Series(out, index=pdf.index, dtype=object)})

    return chunks.mapInPandas(run, schema)


def layout_markdown(lines: DataFrame, title: float = 1.35, heading: float = 1.15, paragraph: float = 1.4, bucket: float = 0.5) -> DataFrame:
    """Markdown of documents given as laid out lines (doc_id, line_no, size, text, top, bottom).

    The body size is the one with most characters; the usual gap between lines the most frequent one, in steps of half a
    point. The first line of at least 1.35 times the body size is the title, others from 1.15 times are headings; a gap
    of more than 1.4 times the usual one is a blank line. Ties go to the value that comes first.
    """
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    size = lines.where("size > 0").groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("_n"), F.min("line_no").alias("_at")).groupBy("doc_id").agg(F.max_by("size", F.struct("_n", -F.col("_at"))).alias("_body"))
    gaps = lines.withColumn("_gap", F.col("top") - F.lag("bottom").over(by_line))
    # Python's round() and rint() both go to the even number.
    usual = gaps.withColumn("_step", F.rint(F.col("_gap") / bucket) * bucket).where("_step > 0").groupBy("doc_id", "_step").agg(F.count("*").alias("_n"), F.min("line_no").alias("_at")).groupBy("doc_id").agg(F.max_by("_step", F.struct("_n", -F.col("_at"))).alias("_usual"))
    ratio = F.when(F.coalesce(F.col("_body"), F.lit(0.0)) > 0, F.col("size") / F.col("_body")).otherwise(1.0)
    big = gaps.join(size, "doc_id", "left").join(usual, "doc_id", "left").withColumn("_ratio", ratio)
    rank = F.sum((F.col("_ratio") >= title).cast("int")).over(by_line)
    text = F.when((F.col("_ratio") >= title) & (rank == 1), F.concat(F.lit("# "), "text")).when(F.col("_ratio") >= heading, F.concat(F.lit("## "), "text")).otherwise(F.col("text"))
    breaks = F.coalesce((F.col("_usual") > 0) & (F.col("_gap") > F.col("_usual") * paragraph), F.lit(False))
    marked = big.withColumn("_line", F.when(breaks, F.concat(F.lit("\n"), text)).otherwise(text))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_line"))), lambda x: x["_line"])
    return marked.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("markdown"))
