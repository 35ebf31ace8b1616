"""Appending, additive parts, file statistics, bucketed tables, shared folders, hand-over in Arrow."""

from __future__ import annotations

import datetime
import re
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import additive, headline, products, regions
from ledgerloom.sources import batches, handover, scratch, star, tables
from ledgerloom.sources.schema import DOCUMENTED_TYPES, SALES_COLUMNS, documented
from ledgerloom.sources.statistics import file_summary

FOLDER = "/root/testdata/sf0.001"
ROWS = [
    {"transaction_id": "a", "customer_id": "1", "region": "North", "product": "Cup"},
    {"transaction_id": "b", "customer_id": "2", "region": "North", "date": "2024-04-01", "total_amount": 5.25},
    {"transaction_id": "c", "customer_id": None, "region": None, "product": None},
    {"transaction_id": "d", "customer_id": "x", "date": None, "total_amount": None, "quantity": None},
]
MORE = [
    {"transaction_id": "e", "customer_id": "1", "region": "South", "discount_percent": 12.5},
    {"transaction_id": "f", "customer_id": "1", "region": "North"},
    {"transaction_id": "g", "customer_id": None, "region": None, "unit_price": None},
]


def ids(frame):
    return sorted(r["transaction_id"] for r in frame.select("transaction_id").collect())


def test_a_batch_appended_twice_is_there_once(spark, make_sales, tmp_path):
    path, one, two = f"{tmp_path}/t", make_sales(*ROWS), make_sales(*MORE)
    assert batches.batches(spark, path) == []
    assert batches.append_batch(one, path, "2024-01") and batches.append_batch(two, path, "0007")
    assert not batches.append_batch(one, path, "2024-01")
    assert batches.batches(spark, path) == ["0007", "2024-01"]
    back = batches.read_batches(spark, path)
    assert ids(back) == list("abcdefg")
    assert sorted(map(tuple, documented(back).collect()), key=repr) == sorted(map(tuple, documented(one.unionByName(two)).collect()), key=repr)
    assert {r[0] for r in back.select("_batch").distinct().collect()} == {"0007", "2024-01"}
    assert ids(batches.read_batches(spark, path, "0007")) == list("efg")
    assert list(Path(path, "_pending").iterdir()) == []
    with pytest.raises(ValueError, match="batch name"):
        batches.append_batch(one, path, "../x")
    with pytest.raises(ValueError, match="no batch"):
        batches.read_batches(spark, f"{tmp_path}/nothing")


def test_an_append_that_died_leaves_nothing_and_can_be_repeated(spark, make_sales, tmp_path, monkeypatch):
    path, one = f"{tmp_path}/t", make_sales(*ROWS)
    batches.append_batch(make_sales(*MORE), path, "first")
    monkeypatch.setattr(batches, "batch_parts", lambda sales: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        batches.append_batch(one, path, "second")
    monkeypatch.undo()
    assert ids(batches.read_batches(spark, path)) == list("efg")
    assert batches.append_batch(one, path, "second")
    assert ids(batches.read_batches(spark, path)) == list("abcdefg")


def test_a_failing_task_publishes_nothing(spark, make_sales, tmp_path):
    path = f"{tmp_path}/t"
    broken = make_sales(*ROWS).withColumn("quantity", F.expr("if(transaction_id = 'b', raise_error('lost'), quantity)").cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        batches.append_batch(broken, path, "one")
    assert batches.batches(spark, path) == []
    assert batches.append_batch(make_sales(*ROWS), path, "one") and ids(batches.read_batches(spark, path)) == list("abcd")


def test_of_two_appends_at_once_one_is_published(spark, make_sales, tmp_path, monkeypatch):
    path, one = f"{tmp_path}/t", make_sales(*ROWS)
    real = batches.batch_parts

    def meanwhile(sales):
        monkeypatch.setattr(batches, "batch_parts", real)
        assert batches.append_batch(one, path, "same")
        return real(sales)

    monkeypatch.setattr(batches, "batch_parts", meanwhile)
    assert not batches.append_batch(one, path, "same")
    assert ids(batches.read_batches(spark, path)) == list("abcd")
    assert list(Path(path, "_pending").iterdir()) == []


WHOLE = {
    "region_sales": regions.region_sales,
    "region_metrics": regions.region_metrics,
    "region_channel": regions.region_channel,
    "monthly_region_sales": regions.monthly_region_sales,
    "product_performance": products.product_performance,
    "product_monthly": products.product_monthly,
    "product_profitability": products.product_profitability,
    "product_region": products.product_region,
}


def test_parts_give_what_the_sales_give_and_an_append_sums_the_new_batch_only(spark, make_sales, tmp_path):
    path, one, two = f"{tmp_path}/t", make_sales(*ROWS), make_sales(*MORE)
    batches.append_batch(one, path, "one")
    kept = {p: p.stat().st_mtime_ns for p in Path(path, "_batch=one").rglob("*.parquet")}
    batches.append_batch(two, path, "two")
    assert kept == {p: p.stat().st_mtime_ns for p in Path(path, "_batch=one").rglob("*.parquet")}
    given, sales = batches.read_parts(spark, path), one.unionByName(two)
    for name, operator in WHOLE.items():
        got, want = getattr(additive, name)(given), operator(sales)
        assert got.dtypes == want.dtypes, name
        assert got.collect() == want.collect(), name
    read = set(re.findall(r"_kind=(\w+)", "".join(given.inputFiles())))
    assert read == {"parts"}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_count_and_dates_come_from_file_statistics(spark, make_sales, tmp_path):
    sales = make_sales(*ROWS[:3], *MORE, {"date": "2024-04-02"})
    tables.write_sales(sales, f"{tmp_path}/s")
    frame = file_summary(spark, f"{tmp_path}/s")
    assert "PushedAggregation: [COUNT(*), MIN(date), MAX(date)]" in plan(frame)
    assert tuple(frame.first()) == (7, datetime.date(2024, 3, 15), datetime.date(2024, 4, 2))
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_columns_without_statistics_are_read(spark, make_sales, tmp_path):
    sales = make_sales(*ROWS, *MORE)
    sales.write.option("parquet.column.statistics.enabled", "false").parquet(f"{tmp_path}/none")
    sales.write.parquet(f"{tmp_path}/text")
    tables.write_sales(sales, f"{tmp_path}/nulls")  # one of its files has no date at all
    for path, column in ((f"{tmp_path}/none", "date"), (f"{tmp_path}/text", "region"), (f"{tmp_path}/nulls", "date")):
        want = tuple(sales.agg(F.count("*"), F.min(column), F.max(column)).first())
        assert tuple(file_summary(spark, path, column).first()) == want


def test_bucketed_tables_join_without_an_exchange_of_line_items(spark, tmp_path):
    spark.sql(f"CREATE DATABASE bucketed_test LOCATION '{tmp_path}/db'")
    star.write_bucketed(spark, FOLDER, "bucketed_test", 4)
    columns = ("total_amount", "customer_id", "date")
    dates = ("1997-01-01", "1999-12-31")
    # with broadcasts off, as with tables too large for one
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sales = star.sales_view(spark, FOLDER, columns, read=star.from_bucketed("bucketed_test"))
        frame = headline.kpi_values(sales, date_range=dates)
        plain = headline.kpi_values(star.sales_view(spark, FOLDER, columns), date_range=dates)
        assert frame.collect() == plain.collect()
        own, other = plan(frame).split("== Initial Plan ==")[0], plan(plain).split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE bucketed_test CASCADE")
    assert "SortMergeJoin" in own and "Bucketed: true" in own
    assert "Exchange hashpartitioning(l_orderkey" not in own and "Exchange hashpartitioning(o_orderkey" not in own
    assert "Exchange hashpartitioning(l_orderkey" in other


def test_folders_are_shared_or_refused(spark):
    assert scratch.shared_folder(spark) in scratch.fresh_path(spark, "x")
    for master, base, refused in (("local[8]", None, False), ("local-cluster[3,2,1024]", None, True), ("yarn", None, True), ("yarn", "/shared", False)):
        context = SimpleNamespace(
            master=master, applicationId="app-1", _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc,
            getConf=lambda base=base: {"spark.checkpoint.dir": base} if base else {},
        )
        fake = SimpleNamespace(sparkContext=context, conf=spark.conf)
        if refused:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                scratch.shared_folder(fake)
        elif not base:
            assert scratch.shared_folder(fake).endswith("ledgerloom-app-1")


def client_table(make_sales, *rows):
    return documented(make_sales(*rows)).toArrow()


def test_arrow_rows_become_sales(spark, make_sales, tmp_path):
    one, two = client_table(make_sales, *ROWS), client_table(make_sales, *MORE)
    sales = handover.arrow_to_sales(spark, [one, *two.select(list(reversed(SALES_COLUMNS))).to_batches()])
    assert sales.columns == list(SALES_COLUMNS) and dict(sales.dtypes)["total_amount"] == "decimal(14,2)"
    assert sorted(map(tuple, documented(sales).collect()), key=repr) == sorted(map(tuple, documented(make_sales(*ROWS, *MORE)).collect()), key=repr)
    assert handover.arrow_to_sales(spark, []).count() == 0
    with pytest.raises(ValueError, match="region"):
        handover.arrow_to_sales(spark, [one.drop(["region"])])
    with pytest.raises(pa.ArrowInvalid):
        handover.arrow_to_sales(spark, [one.set_column(3, "quantity", pa.array(["many"] * len(one)))])


def test_a_million_rows_without_python_objects(spark):
    n = 1_000_000
    columns = {name: pa.nulls(n, handover.CLIENT_SCHEMA.field(name).type) for name in SALES_COLUMNS}
    columns["quantity"] = pa.array(range(n), pa.int64())
    sales = handover.arrow_to_sales(spark, (pa.table(columns).slice(at, n // 4) for at in range(0, n, n // 4)))
    assert tuple(sales.agg(F.count("*"), F.sum("quantity"), F.count("region")).first()) == (n, n * (n - 1) // 2, 0)


def test_a_pull_comes_in_bounded_batches(spark):
    frame = spark.range(0, 10_007, 1, 3).selectExpr("id", "cast(id AS string) AS s", "cast(id AS decimal(12,2)) AS d")
    sizes, total = [], 0
    for batch in handover.arrow_batches(frame, 1000):
        assert batch.schema.names == ["id", "s", "d"]
        sizes.append(batch.num_rows)
        total += sum(batch.column(0).to_pylist())
    assert sum(sizes) == 10_007 and max(sizes) <= 1000 and total == 10_007 * 10_006 // 2
    assert list(handover.arrow_batches(frame.limit(0))) == []
    assert sorted(DOCUMENTED_TYPES) == sorted(handover.CLIENT_SCHEMA.names)
