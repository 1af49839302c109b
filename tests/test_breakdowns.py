"""Breakdowns and metric tables that share a pass or a moment with others."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lakemetrics.operators import gold, retail
from lakemetrics.sources import testviews as tv

DATA = "/root/testdata/sf0.001"
STAR = "order_no long, customer_id long, product_id long, product string, category string, region string, level string, order_date date, quantity long, gross_amount decimal(14,2), net_amount decimal(14,2)"


@pytest.fixture(scope="module")
def star(spark):
    """Some lines of the star, and rows with nulls in dimensions, orders and customers, and repeated ones."""
    odd = spark.createDataFrame([(None, 1, 1, "p", None, "X", "L"), (7, None, 1, "p", "c", None, None), (7, None, 1, "p", "c", None, None), (None, None, None, None, None, None, None)], ", ".join(STAR.split(", ")[:7]))
    odd = odd.withColumns({"order_date": F.lit("1999-01-31").cast("date"), "quantity": F.lit(2).cast("long"), "gross_amount": F.lit(0).cast("decimal(14,2)"), "net_amount": F.lit(0).cast("decimal(14,2)")})
    return tv.retail(spark, DATA).unionByName(odd).persist()


def same(a, b):
    columns = sorted(b.columns)
    return sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


SETS = [("region", "month"), ("region", "category"), ("level", "region"), ("product",), ()]


def test_breakdowns_equal_single_ones(star):
    found = retail.breakdowns(star, *SETS, ("month", "region")).persist()
    assert {r[0] for r in found.select("dimensions").distinct().collect()} == {"region,month", "region,category", "region,level", "product", ""}
    for name, dims in zip(("region,month", "region,category", "region,level", "product", ""), SETS):
        assert same(found.where(F.col("dimensions") == name), retail.breakdown(star, *dims))
    assert retail.breakdowns(star.where("false"), ("region",)).count() == 0


def test_metrics_equal_single_ones(star):
    asked = [("sales_amount", ("month",)), ("units", ("month",)), ("customer_count", ("level", "region")), ("average_order_value", ("region",)), ("order_count", ()), ("units", ("month",))]
    found = retail.metrics(star, asked).persist()
    for name, dims in asked:
        one = retail.metric(star, name, list(dims)).collect()
        mine = found.where(F.col("metric") == name).where(F.size("keys") == len(dims)).collect()
        expected = {(tuple(r[d] for d in sorted(dims)), None if r[name] is None else float(r[name])) for r in one}
        assert len(mine) == len(one) and {(tuple(r["keys"][d] for d in sorted(dims)), r["value"]) for r in mine} == expected
    for wrong in ([("profit", ("month",))], [("customer_count", ("product",))]):
        with pytest.raises(ValueError):
            retail.metrics(star, wrong)


def test_metrics_meet_only_the_keys_that_they_count(star):
    asked = [("sales_amount", ("month",)), ("units", ("product",)), ("order_count", ("region",)), ("average_order_value", ("region",)), ("customer_count", ("level",))]
    plan = retail.metrics(star, asked)._jdf.queryExecution().optimizedPlan().toString()
    expand = next(line for line in plan.splitlines() if "Expand [" in line)
    assert expand.split("]], [")[0].count("], [") + 1 == 4  # not eight, each set with orders and with customers


def test_amounts_of_any_type_are_added_exactly(spark, star):
    many = spark.range(2_000).select(F.lit("r").alias("region"), F.lit("L").alias("level"), F.col("id").alias("order_no"), (F.col("id") % 3).alias("customer_id"), F.lit("2000-02-01").cast("date").alias("order_date"), F.lit(1).cast("long").alias("quantity"), *[F.lit(x).cast("decimal(14,2)").alias(c) for c, x in (("gross_amount", "99999999999.99"), ("net_amount", "-99999999999.98"))])
    fine = many.withColumns({"gross_amount": F.lit("0.0049").cast("decimal(18,4)"), "net_amount": F.lit("0.005").cast("decimal(12,3)")})
    for df in (many, fine, star):
        assert same(retail.breakdowns(df, ("region", "month")).drop("dimensions"), retail.breakdown(df, "region", "month"))
        for name, dims in (("sales_amount", ["level"]), ("sales_amount", []), ("average_order_value", ["region"])):
            assert sorted(str(r["value"]) for r in retail.metrics(df, [(name, tuple(dims))]).collect()) == sorted(str(r[name] if r[name] is None else float(r[name])) for r in retail.metric(df, name, dims).collect())


def test_lines_of_an_order_are_counted_in_one_task(spark):
    plan = lambda **k: tv.retail(spark, DATA, **k)._jdf.queryExecution().optimizedPlan().toString()
    last = lambda text: next(line for line in text.splitlines() if "Join Inner" in line)
    assert "l_orderkey" in last(plan()) and "l_partkey" in last(plan(by_product=True))


def test_one_scan_of_the_star(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    lines = "l_orderkey"
    single, several = (plan(df) for df in (retail.breakdown(tv.retail(spark, DATA), "region"), retail.breakdowns(tv.retail(spark, DATA), *SETS)))
    scans = lambda text: sum("FileScan" in line and lines in line for line in text.split("\n"))
    assert scans(several) == scans(single) == 1


def test_tables_written_at_once(spark, tmp_path):
    events, samples = tv.behaviour(spark, DATA).persist(), tv.samples(spark, DATA)
    gold.write_tables(events, samples, str(tmp_path / "a"))
    for name, table in gold.all_tables(events, samples).items():
        assert same(spark.read.parquet(str(tmp_path / "a" / name)), table)
    spark.sparkContext.setJobGroup("refresh", "six tables")
    try:
        gold.write_tables(events.limit(0), samples.where("false"), str(tmp_path / "b"))
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("refresh")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(AnalysisException):
        gold.write_tables(events.drop("item_id"), samples, str(tmp_path / "c"))
