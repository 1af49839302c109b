"""Text, corpus and retrieval on what the given tables lack: marks, headings, CJK, odd input."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemetrics.functions import texts as X
from lakemetrics.operators import corpus, history, questions, retrieval, vectors
from lakemetrics.operators.keyword_index import KeywordIndex


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).head()[0]


def test_columns(spark):
    assert one(spark, X.normalise(F.col("t")), t="﻿a\r\nb\rc") == "a\nb\nc"
    assert one(spark, X.clean_body(F.col("t")), t="\n a  \n\n\n\n  b \t\n") == "a\n\n  b"
    assert one(spark, X.token_estimate(F.col("t")), t="客单价 = a b c") == 3 + 4
    assert one(spark, X.trigram_similarity(F.col("a"), F.col("b")), a="word", b="two words") == pytest.approx(4 / 11)
    assert one(spark, X.clean_title(F.col("t")), t="4. 客单价") == "客单价"
    assert one(spark, X.clean_title(F.col("t")), t="2. 11 月促销季") == "11 月促销季"
    assert one(spark, X.redact(F.col("t")), t="ok\nSELECT * from x; more\nselected") == "ok\n[redacted]\nselected"
    assert one(spark, X.preview(F.col("t"), 5), t=" a \n b  cdef") == "a b c…"
    assert one(spark, X.contains_literal(F.col("t"), F.lit("A%")), t="x a% y") and not one(spark, X.contains_literal(F.col("t"), F.lit("A%")), t="x ab y")


def test_terms(spark):
    terms = spark.createDataFrame([([" Order", "order", "", None, "x" * 81, "b"],), (None,)], "t array<string>")
    assert [r[0] for r in terms.select(corpus.normalise_terms(F.col("t"))).collect()] == [["Order", "b"], []]


DOC = "dropped\n# Title\n> front matter\n\n## 1. First\nbody one\n### deep\nmore\n## Empty\n\n## 2、Second\n" + "\n\n".join("x" * 500 for _ in range(4))


def test_markdown_chunks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text(DOC)
    (tmp_path / "b.txt").write_text("no")
    docs = corpus.scan(spark, str(tmp_path))
    rows = corpus.chunk(docs).orderBy("chunk_index").collect()
    assert [(r["section_title"], r["chunk_index"]) for r in rows] == [(corpus.FRONT_TITLE, 0), ("First", 1), ("Second", 2), ("Second", 3)]
    assert rows[0]["document_title"] == "Title" and rows[1]["content"] == "body one\n### deep\nmore"
    assert [r["char_count"] for r in rows[2:]] == [1002, 1002]
    plain = corpus.chunk(spark.createDataFrame([("x/y.txt", "a\n\n\n\nb", "T"), ("z.txt", " ", None)], "source_file string, text string, title string"), markdown=False).collect()
    assert [(r["document_title"], r["content"]) for r in plain] == [("T", "a\n\nb")]


def test_invalid_bytes_are_refused(spark):
    files = spark.createDataFrame([("a", bytearray("ä".encode())), ("b", bytearray(b"\xff\xfe"))], "name string, content binary")
    good, bad = corpus.decode_utf8(files)
    assert [r["text"] for r in good.collect()] == ["ä"] and [r["name"] for r in bad.collect()] == ["b"]


def test_enrichment_degrades_by_batch(spark):
    chunks = spark.range(7).select(F.col("id").alias("chunk_id"), F.col("id").cast("string").alias("content_for_embedding")).coalesce(1)

    def lengths(texts):
        if "4" in texts:
            raise RuntimeError
        return [len(t) for t in texts]

    rows = corpus.enrich(chunks, lengths, "n", "long", batch=3).orderBy("chunk_id").collect()
    assert [r["n"] for r in rows] == [1, 1, 1, None, None, None, 1]
    done = spark.createDataFrame([(0, "new")], "chunk_id long, search_text string")
    old = chunks.withColumn("search_text", F.lit("old"))
    assert sorted(r["search_text"] for r in corpus.backfilled(old, done).collect()) == ["new"] + ["old"] * 6


def test_vectors_of_wrong_size_are_an_error(spark):
    due = spark.createDataFrame([("h", None)], "content_hash string, embedding array<float>").withColumn("needs_vector", F.lit(True))
    wrong = spark.createDataFrame([("h", [1.0])], "content_hash string, embedding array<float>")
    with pytest.raises(Exception, match="elements"):
        corpus.attach_vectors(due, wrong, 2, "m").collect()
    with pytest.raises(ValueError):
        retrieval.vector_topk(wrong, wrong, 11)


def test_keyword_tiers_and_fusion(spark):
    chunks = spark.createDataFrame(
        [(1, "Doc", "AOV", ["gmv"], [], "nothing"), (2, "Doc", "Other", [], ["AOV"], "x"), (3, "aov doc", "Z", [], [], "x"), (4, "D", "Z", [], [], "the aov is")],
        "chunk_id long, document_title string, section_title string, keywords array<string>, aliases array<string>, search_text string",
    )
    terms = spark.createDataFrame([(1, "AOV")], "query_id long, term string")
    rows = {r["chunk_id"]: r for r in retrieval.keyword_search(terms, chunks).collect()}
    assert {k: v["keyword_score"] for k, v in rows.items()} == {1: 100.0, 2: 70.0, 3: 50.0, 4: 40.0}
    assert rows[1]["matched_terms"] == ["section_title_exact", "section_title_contains"]
    lists = spark.createDataFrame([(1, 0, "vector", "q", 1, 7), (1, 0, "vector", "q", 2, 8), (1, 1, "keyword", "k", 1, 8)], "query_id long, list_no long, retrieval_type string, query string, rank long, chunk_id long")
    fused = retrieval.rrf(lists).orderBy("position").collect()
    assert [(r["chunk_id"], r["vector_rank"], r["keyword_rank"]) for r in fused] == [(8, 2, 1), (7, 1, None)]
    assert fused[0]["matched_queries"] == ["q", "k"]


def test_questions(spark):
    asked = spark.createDataFrame([(1, "销售额和点击量", "trend"), (2, "漏斗转化", "funnel"), (3, "GMV", None), (4, "", None)], "question_id long, question string, intent string")
    routed = {r["question_id"]: r["area"] for r in questions.route(asked).collect()}
    assert routed == {1: "retail", 2: "behaviour", 3: "retail", 4: "retail"}
    found = {(r["question_id"], r["name"]): r["matched"] for r in questions.match_assets(questions.route(asked)).collect()}
    assert found == {
        (1, "sales_amount"): ["销售额"], (1, "orders"): ["销售额"], (2, "buy_user_rate"): ["转化", "漏斗转化"], (2, "funnel_metrics"): ["漏斗", "转化"], (3, "sales_amount"): ["gmv"],
    }
    flags = {r["question_id"]: r["reason"] for r in questions.knowledge_flag(asked).collect()}
    assert flags == {1: None, 2: "intent funnel", 3: None, 4: None}


WORDS = [("a", 0, "aba"), ("a", 1, "AB"), ("b", 0, "ab"), ("b", 1, "b"), ("b", 2, "dépôt"), ("c", 0, ""), ("c", 1, None), ("d", 0, "abab"), ("d", 1, "漏斗转化")]


def test_words_are_found_as_by_contains(spark, monkeypatch):
    rows = [(1, "xABABx"), (2, None), (3, ""), (4, "Le DÉPÔT b"), (5, "看漏斗转化率"), (6, "xABABx"), (1, "b")]
    texts = spark.createDataFrame(rows, "question_id long, question string").withColumn("list", F.lit("clash"))
    table = spark.createDataFrame(WORDS, "list string, position int, word string")
    want = sorted((i, [w for w in WORDS if w[2] and t and w[2].lower() in t.lower()]) for i, t in rows)
    for size in (questions.WORD_BYTES, 0):
        monkeypatch.setattr(questions, "WORD_BYTES", size)
        got = questions.find(texts, table)
        assert got.columns == ["question_id", "question", "list", "found"]
        assert sorted((r["question_id"], [tuple(w) for w in r["found"]]) for r in got.collect()) == want
        assert questions.find(texts.limit(0), table).count() == 0
        assert all(r["found"] == [] for r in questions.find(texts, table.limit(0)).collect())


def test_a_catalogue_of_many_words_has_the_plan_of_a_small_one(spark):
    asked = spark.createDataFrame([(i, f"what is asset{i * 7}w, please", "other") for i in range(50)], "question_id long, question string, intent string")
    routed = questions.route(asked)
    catalogue = lambda n: spark.range(n).select(F.col("id").alias("position"), F.lit("retail").alias("area"), F.lit("metric").alias("kind"), F.concat(F.lit("n"), "id").alias("name"), F.array(F.concat(F.lit("Asset"), "id", F.lit("w")), F.concat(F.lit("other"), "id")).alias("words"))
    few, many = (questions.match_assets(routed, catalogue(n)) for n in (10, 10_000))
    lines = [len(df._jdf.queryExecution().executedPlan().toString().splitlines()) for df in (few, many)]
    assert lines[0] == lines[1]
    assert sorted((r["question_id"], r["name"]) for r in many.collect()) == sorted((i, f"n{i * 7}") for i in range(50))
    words = spark.createDataFrame([("retail", 0, "asset0"), ("behaviour", 0, "what"), ("behaviour", 1, "please"), ("shared", 0, "is")], "list string, position int, word string")
    assert {r["area"] for r in questions.route(asked, words=words).collect()} == {"behaviour"}
    assert {r["reason"] for r in questions.knowledge_flag(asked, words.where("list = 'shared'")).collect()} == {"word is"}


def test_governed(spark):
    regions = spark.createDataFrame([(str(i), "n", "l") for i in range(3)], "region_id string, region_name string, region_level string")
    assert history.governed(regions, "regions", ["region_id"], 3).count() == 3
    for bad in (("regions", ["region_id"], 2), ("regions", ["secret"], 3), ("nope", ["a"], 3), ("regions", ["region_id"], 201)):
        with pytest.raises(ValueError):
            history.governed(regions, *bad)


def test_empty_tables(spark):
    from lakemetrics.operators import gold, retail
    from lakemetrics.sources import testviews as tv

    nothing = tv.stream_events(spark, "/root/testdata/sf0.001").where("false")
    assert all(df.count() == 0 for df in gold.all_tables(nothing, tv.samples(spark, "/root/testdata/sf0.001").where("false")).values())
    star = tv.retail(spark, "/root/testdata/sf0.001").where("false")
    assert retail.breakdown(star, "region").count() == 0 and retail.date_dim(spark, of=star).count() == 0


def test_catalogue_refuses_unknown_dimensions(spark):
    from lakemetrics.operators import gold, retail
    from lakemetrics.sources import testviews as tv

    star = tv.retail(spark, "/root/testdata/sf0.001")
    for name, dims in (("nope", []), ("average_order_value", ["product"])):
        with pytest.raises(ValueError):
            retail.metric(star, name, dims)
    assert retail.metric(star, "units", ["month", "region"]).count() > 0
    for name, dim in (("nope", "all"), ("active_user_count", "merchant")):
        with pytest.raises(ValueError):
            gold.metric({}, name, dim)


def test_long_runs_of_white_space(spark):
    body = "a" + " \t" * 100_000 + "b" + " " * 200_000 + "\n" + "c\u3000\u00a0"
    began = time.perf_counter()
    got = spark.createDataFrame([(body,)], "t string").select(X.clean_body(F.col("t"))).head()[0]
    assert got == "a" + " \t" * 100_000 + "b\nc" and time.perf_counter() - began < 20


def test_keyword_terms_of_any_length(spark):
    chunks = spark.createDataFrame([(1, "T", "s", None, ["Ab"], "x ab, c%_d"), (2, "ab", "x", ["q"], None, "cab12 3"), (3, None, None, None, None, None)], "chunk_id long, document_title string, section_title string, keywords array<string>, aliases array<string>, search_text string")
    terms = spark.createDataFrame([(1, "ab"), (2, "%_"), (3, "CAB12 3"), (3, None), (4, "zzz")], "query_id long, term string")
    got = {(r["query_id"], r["chunk_id"]): (r["matched_terms"], r["keyword_score"]) for r in retrieval.keyword_search(terms, chunks).collect()}
    assert got[1, 2] == (["document_title_exact", "document_title_contains", "search_text_contains"], 90.0)
    assert got[1, 1] == (["aliases_exact", "search_text_contains", "search_text_trigram"], 70.0) and got[2, 1] == (["search_text_contains"], 40.0)
    assert got[3, 2] == (["search_text_contains", "search_text_trigram"], 40.0) and set(got) == {(1, 1), (1, 2), (2, 1), (3, 2)}


def test_holders_of_passages(spark):
    passages = spark.createDataFrame([(1, "one two three"), (2, "b, the a"), (3, "none of these"), (4, "two"), (5, "of these"), (6, None), (7, ",")], "query_id long, passage string")
    chunks = spark.createDataFrame([(1, "s", "t", "someone two threes"), (2, "s", "t", "ab, the apple"), (3, None, None, None), (4, "two", "t", "Two of these")], "chunk_id long, section_title string, document_title string, search_text string")
    index = KeywordIndex.build(chunks)
    assert {tuple(r) for r in retrieval.holders(passages, chunks, index).collect()} == {(1, 1), (2, 2), (4, 1), (5, 4), (7, 2)}


def test_the_keyword_index_misses_nothing(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcÉü1") for _ in range(rng.randint(1, 4)))
    text = lambda most: " ".join(word() + rng.choice(["", ",", "-"]) for _ in range(rng.randint(0, most)))
    texts = [(i, text(40), text(3), text(2)) for i in range(150)] + [(150, None, None, None), (151, "", "", ""), (152, "abc " * 3000, "abc", "a")]
    asked = [(i, text(20)) for i in range(60)] + [(60, ""), (61, "a"), (62, "-"), (63, "zzz"), (64, None)] + [(70 + i, t[1][3:15]) for i, t in enumerate(texts[:40])]
    chunks = spark.createDataFrame(texts, "chunk_id long, search_text string, section_title string, document_title string")
    terms = spark.createDataFrame(asked, "key long, term string")
    index = KeywordIndex.build(chunks)
    again = KeywordIndex(spark, index.path, index.buckets)
    pairs = terms.crossJoin(chunks).withColumn("s", X.trigram_similarity(F.col("term"), F.col("search_text"))).where("s >= 0.3")
    near = {(r["key"], r["chunk_id"]): round(r["similarity"], 9) for r in again.similar(terms).collect()}
    assert len(near) > 50 and near == {(r["key"], r["chunk_id"]): round(r["s"], 9) for r in pairs.collect()}
    may = {tuple(r) for r in again.may_contain(terms).collect()}
    place = {"section_title": 0, "document_title": 1, "search_text": 2}
    held = {(k, place[c], r["chunk_id"]) for r in chunks.collect() for k, t in asked for c in place if t is not None and r[c] is not None and t.lower() in r[c].lower()}
    assert len(held) > 200 and held <= may


def test_keyword_search_has_no_cross_join(spark):
    chunks = spark.createDataFrame([(1, "t", "s", ["k"], ["a"], "some text")], "chunk_id long, document_title string, section_title string, keywords array<string>, aliases array<string>, search_text string")
    terms = spark.createDataFrame([(1, "te"), (2, "some text")], "query_id long, term string")
    found = retrieval.keyword_search(terms, chunks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and found.count() == 2


@pytest.mark.parametrize("spreading", [0.05, 1.0])
def test_nearest_vectors_equal_plain_search(spark, monkeypatch, spreading):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8))
    v = (centres[rng.integers(0, 20, 700)] + spreading * rng.normal(size=(700, 8))).astype(np.float32)
    v[5] = v[6] = v[7]
    v[[8, 300]] = 0
    chunks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "chunk_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 40)] + [(50, None)], "query_id long, embedding array<float>")
    cells = vectors.VectorCells(chunks)
    got = {}
    for r in cells.topk(queries, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["distance"]))
    unit = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-300)
    assert set(got) == set(range(40))
    for q in range(40):
        distance = np.round(1 - unit @ unit[q], 9)
        order = sorted(range(700), key=lambda i: (distance[i], i))[:5]
        found = sorted(got[q])
        assert [c for _, c, _ in found] == order and [d for *_, d in found] == pytest.approx(distance[order].tolist(), abs=1e-8)
    share = cells.visited(queries, 5)
    assert 0 < share <= 1 and (spreading > 0.5 or share < 0.5)
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    assert vectors.VectorCells(none).topk(queries, 5).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        cells.topk(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>"), 5).count()
