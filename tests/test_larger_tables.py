"""What larger tables and odd inputs of the third review broke."""

import datetime
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from lakemetrics.functions import texts as X
from lakemetrics.operators import gold, retrieval, term_scan
from lakemetrics.operators.keyword_index import KeywordIndex
from lakemetrics.plans import checks, documents, ingestion
from lakemetrics.sources import ledger, shared, testviews
from lakemetrics.streaming import arrivals

DATA = "/root/testdata/sf0.001"


def test_many_terms_are_not_compared_with_each_other(spark):
    words = [f"{'Ww'[i % 2]}ord{i % 15_000}" for i in range(30_000)] + [" ", None, "x" * 90]
    first: dict[str, str] = {}
    for w in words:
        if w and w.strip() and len(w) <= 80:
            first.setdefault(w.lower(), w)
    want = list(first.values())
    one = spark.createDataFrame([(1, "ask " + "y" * 5_000, words, words)], "query_id long, original_query string, rewritten_queries array<string>, keywords array<string>")
    began = time.perf_counter()
    assert one.select(X.distinct_terms(F.col("keywords"), longest=80).alias("t")).head()["t"] == want
    assert one.select(X.distinct_terms(F.col("keywords"), 3).alias("t")).head()["t"] == want[:3]
    assert retrieval.search_terms(retrieval.query_plan(one)).count() == 3 + 3 + len(want) + 1 - 2  # two rewrites are keywords, too
    assert time.perf_counter() - began < 30


def test_files_of_equal_events_are_not_copies(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").coalesce(1)
    for _ in range(3):
        events.write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = ingestion.arriving(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    duck.execute(ingestion.ORACLE["arriving_files"])
    names = [c[0] for c in duck.description]
    want = sorted((r["metric_date"], r["action_type"], r["event_count"]) for r in (dict(zip(names, row)) for row in duck.fetchall()))
    assert sorted((r["metric_date"], r["action_type"], r["event_count"]) for r in got.collect()) == want


def test_the_hash_of_a_file_is_the_same_beside_larger_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "FAN", 4)
    lines = {"a": 3, "b": 5, "c": 17, "d": 100}
    for name, n in lines.items():
        (tmp_path / name).write_bytes(b"".join(b"%d\n" % i for i in range(n)))
    alone = [r["hash"] for name in lines for r in ledger.fingerprints(spark, [str(tmp_path / name)]).collect()]
    assert len(set(alone)) == 4 and sorted(alone) == sorted(r["hash"] for r in ledger.fingerprints(spark, str(tmp_path)).collect())


def test_copies_that_arrive_beside_larger_files_are_known(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "FAN", 4)
    schema, folder = "user_id long, item_id long, category_id long, merchant_id long, event_date date, action_type string", tmp_path / "in"
    events = testviews.stream_events(spark, DATA).coalesce(1)
    arrive = lambda: arrivals.ingest_arrivals(spark, str(folder), schema, **{k: str(tmp_path / k) for k in ("events", "metrics", "checkpoint")})
    events.limit(3).write.parquet(str(folder))
    assert arrive() == [0]
    (small,) = folder.glob("part-*.parquet")
    events.write.mode("append").parquet(str(folder))
    (folder / "copy.parquet").write_bytes(small.read_bytes())
    assert arrive() == [1] and spark.read.parquet(str(tmp_path / "events")).count() == 3 + events.count()


CHUNKS = "chunk_id long, document_title string, section_title string, keywords array<string>, aliases array<string>, search_text string"


def test_bounded_terms_are_scanned_for_without_index(spark, monkeypatch):
    rows = [(1, "T", "s", None, ["Ab"], "x ab, c%_d"), (2, "ab", "x", ["q"], None, "cab12 3"), (3, None, None, None, None, None), (4, "É t", "S", [], [], "Élan Élan ÜBER 12"), (5, "", "", [], [], "")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = spark.createDataFrame([(1, "ab"), (2, "%_"), (3, "CAB12 3"), (3, None), (4, "zzz"), (5, "élan über"), (6, ""), (7, "S")], "query_id long, term string")
    passages = asked.withColumnRenamed("term", "passage")
    built = []
    build = KeywordIndex.build.__func__
    monkeypatch.setattr(KeywordIndex, "build", classmethod(lambda cls, *a, **k: built.append(1) or build(cls, *a, **k)))
    found = [sorted(map(str, retrieval.keyword_search(asked, chunks).collect())), sorted(map(str, retrieval.holders(passages, chunks).collect()))]
    assert not built and len(found[0]) > 10 and len(found[1]) >= 6
    monkeypatch.setattr(term_scan, "TERM_BYTES", 0)
    assert [sorted(map(str, retrieval.keyword_search(asked, chunks).collect())), sorted(map(str, retrieval.holders(passages, chunks).collect()))] == found
    assert len(built) == 2


def test_lines_are_added_up_before_they_are_shuffled(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"".join(b"%d\n" % i for i in range(20_000)))
    hashes = ledger.fingerprints(spark, str(tmp_path)).where("path is not null")
    plan = hashes._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and plan.count("sum(") >= 5 and hashes.count() == 1


def test_shared_tables_are_made_once(spark, monkeypatch):
    made = []
    staged = shared.staged
    monkeypatch.setattr(shared, "staged", lambda df, name: made.append(name) or staged(df, name))
    for query in (documents.QUERIES["sync_summary"], checks.QUERIES["gold_silver_consistency"], checks.QUERIES["retail_rules"]):
        plan = query(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "regexp_extract(text" not in plan
    assert made == ["chunks", "events", "star"]


def test_lines_of_the_star_are_not_shuffled_by_customer(spark):
    plan = testviews.retail(spark, DATA)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    customers, lines = (next(i for i, x in enumerate(plan) if f"Join Inner, ({key}" in x) for key in ("o_custkey", "l_orderkey"))
    depth = lambda i: len(plan[i]) - len(plan[i].lstrip(" :+-"))
    assert depth(customers) > depth(lines)


def odd_events(spark):
    """Events with nulls in every column, and one user, item and merchant of many."""
    day = lambda k: datetime.date(2024, 1, k) if k else None
    rows = [(i % 3, i % 5, i % 4 and f"c{i % 4}", i % 7, f"b{i}", day(i % 6), ["click", "cart", "favorite", "buy", None, "view"][i % 11 % 6]) for i in range(300)]
    rows += [(9, 9, "c9", 9, "b", day(9), "buy")] * 50 + [(0, 0, None, 0, None, None, None), (0, 1, None, 2, None, day(1), "buy")]
    schema = "user_id long, item_id long, category_id string, merchant_id long, brand_id string, event_date date, action_type string"
    return spark.createDataFrame([tuple(None if v == 0 else v for v in r) for r in rows], schema)


def same_tables(one, other):
    assert all(other[name].dtypes == table.dtypes and sorted(map(str, other[name].collect())) == sorted(map(str, table.collect())) for name, table in one.items())


def test_refreshes_from_clustered_events_shuffle_counts_only(spark, tmp_path):
    events, samples = odd_events(spark), testviews.samples(spark, DATA)
    near = gold.clustered(events, str(tmp_path / "events"))
    same_tables(gold.all_tables(events, samples), gold.all_tables(near, samples))
    same_tables(gold.all_tables(events.limit(0), samples), gold.all_tables(gold.clustered(events.limit(0), str(tmp_path / "empty")), samples))
    # Joins of finished counts are by coalesce(key); nothing is shuffled by a user, an item or a merchant itself.
    detail = re.compile(r"Exchange hashpartitioning\((?:[^\n]*, )?(?:user|item|merchant)_id#")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = [{n: t._jdf.queryExecution().executedPlan().toString() for n, t in gold.all_tables(e, samples).items() if n != "repurchase_metrics"} for e in (events, near)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert all(detail.search(p) for p in plans[0].values()) and not any(detail.search(p) for p in plans[1].values())


@pytest.mark.parametrize("hot", ["user_id", "item_id", "merchant_id"])
def test_a_key_of_very_many_events_has_no_clustering(spark, tmp_path, monkeypatch, hot):
    spread = {k: F.monotonically_increasing_id() for k in gold.CLUSTERINGS}
    events, samples = odd_events(spark).withColumns(spread | {hot: F.lit(7).cast("long")}).localCheckpoint(), testviews.samples(spark, DATA)
    monkeypatch.setattr(gold, "MOST_ROWS", 150)  # of 352 in four buckets
    near = gold.clustered(events, str(tmp_path / "events"))
    assert {*near.by} == {*gold.CLUSTERINGS} - {hot}
    same_tables(gold.all_tables(events, samples), gold.all_tables(near, samples))


def test_repeated_refresh_clusters_its_events_once(spark, monkeypatch):
    made, given = [], []
    clustered, write = gold.clustered, gold.write_tables
    monkeypatch.setattr(gold, "clustered", lambda *a: made.append(clustered(*a)) or made[-1])
    monkeypatch.setattr(gold, "write_tables", lambda events, *a: given.append(events) or write(events, *a))
    assert ingestion.QUERIES["repeated_refresh"](spark, DATA).where("passed").count() == 6
    assert len(made) == 1 and given == made * 2
