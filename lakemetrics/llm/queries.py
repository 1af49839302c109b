"""The queries of the corpus operators, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, exact_dedup, hard_negatives, html_extraction, license_scan, packing, quality_rules, sharding, simhash, substring, suffix, warc
from .common import spread, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(spread(table(spark, sf_dir, "pages")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), warc.new_folder(spark))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("bytes", 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(spread(table(spark, sf_dir, "documents")))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_substring": op6_substring,
    "op7_suffix": op7_suffix,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

_SPACE = "'[ \\t\\n\\x0B\\f\\r]+'"

ORACLE: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d HAVING count(*) > 1)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
            CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
    """,
    "op5_decontamination": f"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), {_SPACE}), lambda x: x <> '') AS w FROM documents),
        i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), {_SPACE}), lambda x: x <> '') AS w FROM benchmark),
        ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
        s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i WHERE len(w) >= 5),
        n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id),
        c AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN s USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
        FROM c JOIN n USING (item_id) WHERE n_found >= 0.8 * n_shingles
    """,
    "op6_substring": f"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), {_SPACE}), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS k, unnest(list_transform(range(1, len(w) - 11), lambda k: md5(array_to_string(w[k:k + 12], ' ')))) AS s FROM d WHERE len(w) >= 13),
        f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
        r AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM g JOIN f USING (s) WHERE first < doc_id),
        x AS (SELECT doc_id, list(k ORDER BY k) AS gone FROM r GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
            sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN x USING (doc_id)
    """,
    "op7_suffix": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        s AS (SELECT doc_id, k, md5(substring(h, 2 * k + 1, 800)) AS m FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS k FROM d WHERE len(h) >= 800)),
        r AS (SELECT doc_id, k FROM s WHERE m IN (SELECT m FROM s GROUP BY m HAVING count(*) > 1)),
        i AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 400 THEN 0 ELSE 1 END AS fresh FROM r),
        j AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM i),
        z AS (SELECT doc_id, n, min(k) AS a, max(k) + 400 AS b FROM j GROUP BY ALL),
        y AS (SELECT doc_id, sum(b - a) AS gone, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM z GROUP BY doc_id),
        p AS (SELECT doc_id, h, gone, a, CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda i:
            substring(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE b[i] END) + 1, 2 * ((CASE WHEN i = len(a) THEN len(h) // 2 ELSE a[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE b[i] END)))), '') END AS kept
            FROM d LEFT JOIN y USING (doc_id))
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM p
    """,
}

ORACLE["op11_collocations"] = f"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents),
    p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM d),
    g AS ({" UNION ALL ".join(f"SELECT lang, {k} AS size, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM p WHERE len(w) >= {k}" for k in range(1, 6))}),
    t AS MATERIALIZED (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY ALL),
    f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
    j AS (SELECT *, unnest(range(1, size)) AS k FROM c),
    k AS MATERIALIZED (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM j),
    s AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * k.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
        FROM k JOIN f l ON l.lang = k.lang AND l.phrase = head JOIN f r ON r.lang = k.lang AND r.phrase = rest JOIN t ON t.lang = k.lang),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    h AS (SELECT lang, unnest(flatten(list_transform(range(2, size), lambda m: list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase, a FROM c WHERE size > 2),
    x AS (SELECT lang, phrase, max(a) AS longer FROM h GROUP BY ALL),
    y AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
        FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
    SELECT * FROM y WHERE rank <= 2000
"""
ORACLE["op12_exact_dedup"] = f"""
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
ORACLE["op13_hard_negatives"] = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
    SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id))::INTEGER AS rank, negative_id, positive_score, negative_score
    FROM n QUALIFY rank <= 10
"""


def _license_sql() -> str:
    """Brute force of op8: every phrase at every word, every template against every block."""
    word = license_scan.WORD
    starts, base = [], []
    for k, (phrase, label) in enumerate(license_scan.PHRASES.items()):
        words = phrase.split()
        same = " AND ".join(f"w[i + {n}] = '{x}'" for n, x in enumerate(words, 1))
        starts.append(f"list_filter(range(0, len(w) - {len(words) - 1}), lambda i: {same}) AS a{k}")
        base.append(f"CASE WHEN len(a{k}) > 0 THEN '{label}' END")
    templates = ", ".join(f"({n}, '{label}', [{', '.join(f"'{x}'" for x in sorted(set(t.split())))}])" for n, (t, label) in enumerate(license_scan.TEMPLATES))
    places = f"flatten([{', '.join(f'a{k}' for k in range(len(starts)))}])"
    tokens = ", ".join(f"'{x}'" for x in sorted({x for t, _ in license_scan.TEMPLATES for x in t.split()}))
    return f"""
        WITH x AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{word}') AS w FROM documents),
        p AS (SELECT doc_id, w, {', '.join(starts)} FROM x),
        q AS (SELECT doc_id, len(w) AS n_words, {places} AS places, list_filter([{', '.join(base)}], lambda y: y IS NOT NULL) AS base FROM p),
        b AS (SELECT doc_id, unnest(list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] IN ({tokens})), lambda i: w[i:i + {license_scan.BLOCK - 1}])) AS w FROM x),
        t(n, label, tokens) AS (VALUES {templates}),
        h AS (SELECT doc_id, label, max(len(list_intersect(tokens, w)) / len(tokens)) AS s FROM b, t WHERE len(list_intersect(tokens, w)) >= {license_scan.THRESHOLD} * len(tokens) - 1e-9 GROUP BY ALL),
        m AS (SELECT doc_id, list(label) AS more, max(s) AS s FROM h GROUP BY ALL)
        SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
            array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels, greatest(CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE 0 END, coalesce(s, 0)) AS score
        FROM q LEFT JOIN m USING (doc_id)
    """


ORACLE["op8_license_scan"] = _license_sql()
