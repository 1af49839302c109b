"""Raw files to metric tables, on a small hand-made input with two users that mirror each other."""

import datetime

import pytest
from pyspark.sql import functions as F

from lakemetrics.contracts import FILES
from lakemetrics.operators import gold, ingest, quality
from lakemetrics.operators.ingest import IngestError
from lakemetrics.sources import ledger
from lakemetrics.sources.ledger import Store, fingerprint, ingest_folder
from lakemetrics.streaming.arrivals import ingest_arrivals

USERS = ["1,,0", "2,3,1", "5,2,0", "10,,1", "12,8,2"]
LOG = [
    "1,111,11,101,5,0511,0",
    "5,111,11,101,,0511,2",
    "5,112,12,101,5,0512,2",
    "5,222,22,102,7,1112,1",
    "5,222,22,102,7,1112,3",
    "5,111,11,101,5,1112,0",
    "10,333,33,102,9,0601,2",
    "10,444,44,103,8,1112,2",
]
TRAIN = ["1,201,1", "5,201,1", "10,202,0"]
TEST = ["2,301,0.25", "5,301,", "10,302,0.1250000"]


def write(folder, log=LOG, header=None, bom=False, users=USERS, test=TEST):
    folder.mkdir(exist_ok=True)
    for spec, lines in zip(FILES, (users, log, TRAIN, test)):
        names = (header or {}).get(spec.key, ",".join(spec.header))
        (folder / spec.file).write_text(("﻿" if bom else "") + "\n".join([names, *lines]) + "\n", encoding="utf-8")
    return str(folder)


def test_golden_run(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    done = ingest_folder(store, write(tmp_path / "raw", bom=True), 5, 0)
    assert done["counts"] == {"users": 2, "user_events": 7, "repurchase_samples": 4, "daily_metrics": 7, "merchant_metrics": 3, "category_metrics": 5, "user_metrics": 2, "funnel_metrics": 4, "repurchase_metrics": 3}
    users = {r["user_id"]: r for r in store.table("user_metrics").collect()}
    assert (users[5]["buy_merchant_count"], users[5]["multi_merchant_buy_flag"], users[5]["repeat_buy_flag"]) == (1, False, True)
    assert (users[10]["buy_merchant_count"], users[10]["multi_merchant_buy_flag"], users[10]["repeat_buy_flag"]) == (2, True, False)
    merchants = {r["merchant_id"]: r for r in store.table("merchant_metrics").collect()}
    assert [(merchants[m]["buy_user_count"], merchants[m]["repeat_buy_user_count"], float(merchants[m]["repeat_buy_user_rate"])) for m in (101, 102, 103)] == [(1, 1, 1.0), (1, 0, 0.0), (1, 0, 0.0)]
    funnel = {r["action_type"]: float(r["user_rate"]) for r in store.table("funnel_metrics").collect()}
    assert funnel["click"] == 1.0 and funnel["buy"] == 2.0
    rates = {(r["dataset_split"], r["label_group"]): r["positive_rate"] for r in store.table("repurchase_metrics").collect()}
    assert float(rates["train", "positive"]) == float(rates["train", "negative"]) == 0.5 and rates["test", "unlabeled"] is None
    events = store.table("user_events")
    first = events.orderBy("source_row_number").head()
    assert (first["source_row_number"], first["brand_id"], first["event_date"], first["action_type"]) == (2, None, datetime.date(2014, 5, 11), "buy")
    assert quality.constraints(events, "user_events").where("not passed").count() == 0
    assert quality.sampling({"events": events}, 5, 0).where("not passed").count() == 0
    # The same input again is skipped, another one is refused unless it replaces, and the ledger keeps all attempts.
    assert ingest_folder(store, write(tmp_path / "again", bom=True), 5, 0)["action"] == "skip"
    other = write(tmp_path / "other", log=LOG[:6])
    with pytest.raises(IngestError, match="other data"):
        ingest_folder(store, other, 5, 0)
    assert ingest_folder(store, other, 5, 0, replace=True)["counts"]["user_events"] == 5
    assert store.runs().where("status = 'succeeded'").count() == 2
    assert store.runs().where("run_id = 1").head()["raw_row_count"] == 5 + 8 + 3 + 3


def test_failed_run_leaves_published_data(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest_folder(store, write(tmp_path / "raw"), 5, 0)
    with pytest.raises(IngestError) as e:
        ingest_folder(store, write(tmp_path / "bad", log=[*LOG, "5,1,1,1,1,0230,2"]), 5, 0, replace=True)
    assert e.value.category == "invalid_date"
    assert store.table("user_events").count() == 7
    last = store.runs().orderBy("run_id").collect()[-1]
    assert (last["status"], last["error_category"]) == ("failed", "invalid_date")


@pytest.mark.parametrize(
    "bad, category",
    [("5,1,1,1,1,0511,4", "invalid_action_type"), ("5,1,1,1,1,511,2", "invalid_date"), ("5,1,1,1,-1,0511,2", "field_type"), ("5,,1,1,1,0511,2", "field_type"), ("5,1,1", "row_shape"), ("5,1,1,1,1,0511,2,9", "row_shape"), ("-5,1,1,1,1,0511,2", "field_type")],
)
def test_rejects_are_classified(spark, tmp_path, bad, category):
    silver = ingest.read_silver(spark, write(tmp_path / "raw", log=[*LOG, bad]), 5, 0)
    assert [(r["source_row"], r["category"]) for r in silver.rejects.collect()] == [(9, category)]
    with pytest.raises(IngestError):
        ingest.refuse_rejects(silver)


def test_rows_outside_the_sample_are_only_checked_for_width_and_user(spark, tmp_path):
    silver = ingest.read_silver(spark, write(tmp_path / "raw", log=[*LOG, "1,x,1,1,1,9999,9"]), 5, 0)
    assert silver.rejects.count() == 0
    assert ingest.dry_run(silver) == {"users": 2, "user_events": 7, "repurchase_samples": 4, "raw_users": 5, "raw_events": 9, "raw_train": 3, "raw_test": 3}


@pytest.mark.parametrize("value", ["NaN", "1.5", "-0.1", "x"])
def test_probabilities(spark, tmp_path, value):
    silver = ingest.read_silver(spark, write(tmp_path / "raw", test=[*TEST, f"5,9,{value}"]), 5, 0)
    assert [r["column"] for r in silver.rejects.collect()] == ["prob"]


def test_headers_are_checked_first(spark, tmp_path):
    for header in ("user_id,cat_id,item_id,seller_id,brand_id,time_stamp,action_type", ""):
        with pytest.raises(IngestError, match="header"):
            ingest.read_silver(spark, write(tmp_path / "raw", header={"events": header}), 5, 0)
    (tmp_path / "raw" / FILES[3].file).unlink()
    write(tmp_path / "ok")
    (tmp_path / "ok" / FILES[3].file).unlink()
    with pytest.raises(IngestError, match="missing"):
        ingest.read_silver(spark, str(tmp_path / "ok"), 5, 0)
    with pytest.raises(ValueError):
        ingest.check_sampling(5, 5)


def test_fingerprint_ignores_names(spark, tmp_path, monkeypatch):
    a = write(tmp_path / "a")
    before = fingerprint(spark, a)
    (tmp_path / "a" / FILES[0].file).rename(tmp_path / "a" / "renamed.csv")
    assert fingerprint(spark, a) == before
    monkeypatch.setattr(ledger, "FAN", 2)
    assert (small := fingerprint(spark, a)) != before
    (tmp_path / "a" / "renamed.csv").rename(tmp_path / "a" / "zz.csv")
    assert fingerprint(spark, a) == small
    (tmp_path / "a" / "zz.csv").write_text("x")
    assert fingerprint(spark, a) != small


def test_every_byte_changes_the_fingerprint(spark, tmp_path):
    forms = [b"a\nb", b"a\nb\n", b"a\r\nb", b"\xef\xbb\xbfa\nb", b"a\nb\n\n", b"a\n\xffb", b"a\n\xfeb", b"ab\n", b"a\nb ", b"a\x00\nb", b"\na\nb"]
    for i, data in enumerate(forms):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}" / "f.bin").write_bytes(data)
    found = [fingerprint(spark, str(tmp_path / f"{i}")) for i in range(len(forms))]
    assert len(set(found)) == len(forms)
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "f").write_bytes(b"".join(b"%d\n" % i for i in range(5000)))
    whole = fingerprint(spark, str(tmp_path / "big"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert fingerprint(spark, str(tmp_path / "big")) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_two_writers_get_two_numbers(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    real, late = one.log._create, []

    def slow(name, text):
        if not late:
            late.append(two.open("b", "h2", 1, 0))
        return real(name, text)

    one.log._create = slow
    first = one.open("a", "h1", 1, 0)
    assert {first["run_id"], late[0]["run_id"]} == {1, 2} and one.runs().count() == 2
    one.succeed(first, 1, 1, "here")
    two.succeed(late[0], 1, 1, "there")
    assert one.published() == "there" and one.runs().where("status = 'succeeded'").count() == 2
    assert one.log.rows().select("entry").distinct().count() == 4


def test_a_crash_before_publishing_leaves_nothing_half_done(spark, tmp_path, monkeypatch):
    store, folder = Store(spark, str(tmp_path / "store")), write(tmp_path / "raw")

    class Killed(BaseException):
        pass

    def dies(*_):
        raise Killed

    monkeypatch.setattr(store, "succeed", dies)
    with pytest.raises(Killed):
        ingest_folder(store, folder, 5, 0)
    assert store.published() is None and [r["status"] for r in store.runs().collect()] == ["running"]
    after = Store(spark, store.root)
    assert after.decide(fingerprint(spark, folder), 5, 0).head()["action"] == "import"
    assert ingest_folder(after, folder, 5, 0)["run_id"] == 2 and after.table("user_events").count() == 7
    assert ingest_folder(after, folder, 5, 0)["action"] == "skip"


def test_row_numbers_over_many_partitions(spark, tmp_path):
    (tmp_path / "n.csv").write_text("user_id,age_range,gender\n" + "\n".join(f"{i},1,1" for i in range(1, 5001)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        spec = FILES[0].__class__("users", "n.csv", "users", FILES[0].header)
        rows = ingest.numbered(ingest.raw(spark, str(tmp_path), spec)).collect()
        spark.read.csv(str(tmp_path / "n.csv"), header=True).repartition(5).write.csv(str(tmp_path / "several.csv"), header=True)
        several = ingest.numbered(ingest.raw(spark, str(tmp_path), spec.__class__("users", "several.csv", "users", spec.header)).select("*", "_metadata")).orderBy("source_row_number").select("source_row_number", "user_id", F.col("_metadata.file_name"), F.col("_metadata.file_block_start")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["source_row_number"] for r in several] == list(range(1, 5001)) and [tuple(r)[2:] for r in several] == sorted(tuple(r)[2:] for r in several)
    assert all(int(r["user_id"]) == r["source_row_number"] for r in rows) and len(rows) == 5000


def test_arrivals_load_each_file_once(spark, tmp_path):
    schema = "user_id long, item_id long, category_id long, merchant_id long, event_date date, action_type string"
    day = datetime.date(2024, 1, 1)
    folder = str(tmp_path / "in")
    paths = {k: str(tmp_path / k) for k in ("events", "metrics", "checkpoint")}
    spark.createDataFrame([(1, 1, 1, 1, day, "click"), (1, 1, 1, 1, day, "buy")], schema).write.parquet(folder)
    assert ingest_arrivals(spark, folder, schema, **paths) == [0]
    assert ingest_arrivals(spark, folder, schema, **paths) == []
    spark.createDataFrame([(1, 2, 1, 1, day, "buy")], schema).write.mode("append").parquet(folder)
    assert ingest_arrivals(spark, folder, schema, **paths) == [1]
    for i, part in enumerate(sorted((tmp_path / "in").glob("part-*.parquet"))):
        for copy in ("x", "y"):
            (tmp_path / "in" / f"{copy}{i}.parquet").write_bytes(part.read_bytes())
    assert ingest_arrivals(spark, folder, schema, **paths) == []
    row = spark.read.parquet(f"{paths['metrics']}/user_metrics").head()
    assert (row["event_count"], row["buy_count"], row["repeat_buy_flag"]) == (3, 2, True)


def test_one_content_twice_in_a_batch_is_loaded_once(spark, tmp_path):
    schema, folder = "user_id long, item_id long, category_id long, merchant_id long, event_date date, action_type string", tmp_path / "in"
    spark.createDataFrame([(1, 1, 1, 1, datetime.date(2024, 1, 1), "click")], schema).coalesce(1).write.parquet(str(folder))
    (part,) = folder.glob("part-*.parquet")
    (folder / "other.parquet").write_bytes(part.read_bytes())
    assert ingest_arrivals(spark, str(folder), schema, **{k: str(tmp_path / k) for k in ("events", "metrics", "checkpoint")}) == [0]
    assert spark.read.parquet(str(tmp_path / "events")).count() == 1


def test_two_refreshes_are_equal(spark):
    from lakemetrics.sources import testviews as tv

    events = tv.stream_events(spark, "/root/testdata/sf0.001")
    counts = [spark.createDataFrame([(n, df.count()) for n, df in (("daily", gold.daily_metrics(events)), ("users", gold.user_metrics(events)))], "name string, n long") for _ in range(2)]
    assert quality.same_counts(*counts).where("not passed").count() == 0


def scans(df, kind="csv"):
    return df._jdf.queryExecution().executedPlan().toString().count(f"FileScan {kind}")


def test_a_staged_file_is_parsed_once_and_numbered_once(spark, tmp_path):
    silver = ingest.read_silver(spark, write(tmp_path / "raw", log=[*LOG, "5,1,1,1,1,0230,2"]), 5, 0)
    assert all(scans(p.judged) == 1 for p in silver.parts.values())
    before = (sorted(silver.rejects.collect()), sorted(map(str, silver.user_events.collect())))
    staged = ingest.read_silver(spark, write(tmp_path / "raw", log=[*LOG, "5,1,1,1,1,0230,2"]), 5, 0).staged(str(tmp_path / "stage"))
    assert [o.get["rows"] for o in staged.raw_counts.values()] == [5, 9, 3, 3]
    assert all(scans(df) == 0 and scans(df, "parquet") > 0 for df in (staged.users, staged.user_events, staged.repurchase_samples, staged.rejects))
    assert before == (sorted(staged.rejects.collect()), sorted(map(str, staged.user_events.collect())))
    with pytest.raises(IngestError, match="events, row 9: invalid_date time_stamp"):
        ingest.dry_run(staged)


def test_clean_rows_are_judged_once_and_rows_counted_once(spark, tmp_path):
    silver = ingest.read_silver(spark, write(tmp_path / "raw", log=[*LOG, "5,1,1,1,1,0230,2"]), 5, 0)
    for rows, rule in ((silver.user_events, "invalid_action_type"), (silver.users, "row_shape"), (silver.rejects, "invalid_action_type")):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count(rule) == 1
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")]
    assert scans(ingest._offsets(ingest.raw(spark, str(tmp_path / "raw"), FILES[1]).select(*at), False)) == 0


def test_a_large_table_of_blocks_is_joined_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "BROADCAST_BYTES", 0)
    rows = ingest.numbered(ingest.raw(spark, write(tmp_path / "raw"), FILES[1]))
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r["source_row_number"] for r in rows.orderBy("source_row_number").collect()] == list(range(1, 9))


def test_numbers_beyond_a_short_are_rejected(spark, tmp_path):
    silver = ingest.read_silver(spark, write(tmp_path / "raw", users=[*USERS, "5,40000,1", "x,1,1", "1,1,99999"]), 5, 0)
    assert sorted((r["source_row"], r["column"]) for r in silver.rejects.collect()) == [(6, "age_range"), (7, "user_id"), (8, "gender")]
    assert {r["user_id"] for r in silver.users.collect()} == {5, 10}


def test_empty_files_give_no_rows(spark, tmp_path):
    folder = write(tmp_path / "raw", log=[], users=[], test=[])
    assert ingest.dry_run(ingest.read_silver(spark, folder, 5, 0)) == {"users": 0, "user_events": 0, "repurchase_samples": 2, "raw_users": 0, "raw_events": 0, "raw_train": 3, "raw_test": 0}


def test_the_stage_of_a_run_is_removed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest_folder(store, write(tmp_path / "raw"), 5, 0)
    with pytest.raises(IngestError):
        ingest_folder(store, write(tmp_path / "bad", log=[*LOG, "5,1"]), 5, 0, replace=True)
    assert not list((tmp_path / "store" / "stage").glob("*")) and store.table("user_events").count() == 7
