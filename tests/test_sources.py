from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import products
from ledgerloom.operators.filters import filtered_sales
from ledgerloom.plans.query import on_sales
from ledgerloom.plans.registry import builders
from ledgerloom.sources import star, tables
from ledgerloom.sources.session import settings_for
from ledgerloom.sources.schema import DOCUMENTED_TYPES, FOLDER_COLUMNS, SALES_COLUMNS, conform, documented

FOLDER = "/root/testdata/sf0.001"


def test_view_has_the_documented_columns_and_types(spark):
    view = documented(star.sales_view(spark, FOLDER))
    assert dict(view.dtypes) == DOCUMENTED_TYPES
    assert tuple(view.columns) == SALES_COLUMNS


def test_every_line_item_is_one_sale(spark):
    lines = star.table(spark, FOLDER, "lineitem").count()
    view = star.sales_view(spark, FOLDER)
    assert view.count() == lines
    assert view.where("region is not null and product is not null and salesperson is not null").count() == lines


@pytest.mark.parametrize("column", SALES_COLUMNS)
def test_narrow_view_equals_the_column_of_the_whole_view(spark, column):
    narrow = star.sales_view(spark, FOLDER, [column])
    whole = star.sales_view(spark, FOLDER).select(column)
    assert narrow.exceptAll(whole).count() == 0 and whole.exceptAll(narrow).count() == 0


def test_unknown_column_is_refused(spark):
    with pytest.raises(ValueError, match="price"):
        star.sales_view(spark, FOLDER, ["price"])


@pytest.fixture
def damaged(spark, tmp_path):
    """The star tables with one customer and one part missing and a zero quantity."""
    for name in star.TABLES:
        frame = star.table(spark, FOLDER, name)
        if name == "customer":
            frame = frame.where("c_custkey > 0")
        if name == "part":
            frame = frame.where("p_partkey > 0")
        if name == "lineitem":
            frame = frame.withColumn(
                "l_quantity", F.when(F.col("l_partkey") == 1, 0.0).otherwise(F.col("l_quantity"))
            )
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_missing_dimension_rows_leave_nulls_and_lose_no_sale(spark, damaged):
    lines = star.table(spark, damaged, "lineitem").count()
    view = star.sales_view(spark, damaged)
    assert view.count() == lines == star.sales_view(spark, damaged, ["region", "quantity"]).count()
    assert view.where("region is null").count() > 0
    assert view.where("product is null").count() > 0
    free = view.where("quantity = 0").select("unit_price", "total_amount").distinct().collect()
    assert [tuple(r) for r in free] == [(None, None)]


def test_declared_columns_are_enough(spark):
    with pytest.raises(Exception, match="region"):
        on_sales("x", lambda sales: sales.select("region"), None, "product").build(spark, FOLDER)


def test_rows_to_sales_and_append(make_sales, rows):
    one, two = make_sales({"transaction_id": "a"}), make_sales({"transaction_id": "b"})
    assert rows(tables.append_sales(one, two.select(*reversed(two.columns))), "transaction_id") == [("a",), ("b",)]


def test_catalog_tables(spark, make_sales):
    make_sales({"total_amount": 1.239}).createOrReplaceTempView("sales")
    tables.use_namespace(spark, "spark_catalog", "default")
    assert "sales" in tables.list_tables(spark)
    assert dict(tables.sales_table(spark).dtypes)["total_amount"] == "decimal(14,2)"
    assert tables.row_count(tables.sales_table(spark, "sales")).first()["n"] == 1
    spark.catalog.dropTempView("sales")


def test_preview_and_profile(make_sales, rows):
    sales = make_sales(*[{"transaction_id": f"t{i}"} for i in (3, 1, 2)])
    assert rows(tables.preview(sales, 2, ["transaction_id"]), "transaction_id") == [("t1",), ("t2",)]
    assert tables.preview(sales).count() == 3
    assert rows(tables.profile(sales)) == [(3, 15, ",".join(SALES_COLUMNS))]


@pytest.fixture
def written(make_sales, tmp_path):
    sales = make_sales(
        {"transaction_id": "a", "date": "2023-12-31"},
        {"transaction_id": "b", "date": "2024-01-01"},
        {"transaction_id": "c", "date": "2024-01-31"},
        {"transaction_id": "d", "date": "2024-02-01"},
    )
    tables.write_sales(documented(sales), f"{tmp_path}/sales")
    return f"{tmp_path}/sales", sales


def test_written_sales_come_back(spark, written):
    path, sales = written
    back = tables.read_sales(spark, path)
    assert set(back.columns) == set(SALES_COLUMNS) | set(FOLDER_COLUMNS)
    assert sorted(map(tuple, documented(back).collect())) == sorted(map(tuple, documented(sales).collect()))


def test_date_filter_on_written_sales_skips_folders(spark, written, plan_of):
    path, _ = written
    kept = filtered_sales(tables.read_sales(spark, path), date_range=("2024-01-01", "2024-01-31"))
    assert sorted(r["transaction_id"] for r in kept.collect()) == ["b", "c"]
    plan = plan_of(kept)
    assert "PartitionFilters: [isnotnull(_sale_year" in plan
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date," in plan


def test_large_months_are_cut_into_several_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        many = spark.range(0, 60000, 1, 8).select(
            F.md5(F.col("id").cast("string")).alias("transaction_id"), F.lit("2024-01-01").alias("date")
        )
        tables.write_sales(conform(many), f"{tmp_path}/sales")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list((tmp_path / "sales" / "_sale_year=2024" / "_sale_month=1").glob("*.snappy.parquet"))
    assert len(files) > 1
    assert tables.read_sales(spark, f"{tmp_path}/sales").count() == 60000


def test_a_foreign_year_and_month_lose_no_sale(make_sales):
    sales = make_sales({"date": "2024-03-15"}).withColumns({"year": F.lit(2025), "month": F.lit(1)})
    assert filtered_sales(sales, date_range=("2024-01-01", "2024-12-31")).count() == 1


def test_a_rerun_replaces_the_written_copy(spark):
    first = builders()["written_months"](spark, FOLDER).collect()
    assert sorted(map(tuple, builders()["written_months"](spark, FOLDER).collect())) == sorted(map(tuple, first))


def test_conform_keeps_other_columns(make_sales):
    frame = make_sales({}).withColumn("note", F.lit(1))
    assert conform(frame).columns[-1] == "note"
    assert documented(frame).columns == list(SALES_COLUMNS)


def test_dates_are_dates(make_sales, rows):
    assert rows(make_sales({"date": "2024-02-29"}), "date") == [(datetime.date(2024, 2, 29),)]


def test_settings_follow_the_size_of_the_data():
    small = settings_for(10 * 2**20, 8)
    assert small["spark.sql.shuffle.partitions"] == "8"
    assert small["spark.sql.files.maxPartitionBytes"] == str(4 * 2**20)
    large = settings_for(20 * 10**12, 8000)
    assert int(large["spark.sql.shuffle.partitions"]) * 128 * 2**20 >= 20 * 10**12
    narrow = settings_for(20 * 10**12, 8000, shuffled_share=0.2)
    assert int(narrow["spark.sql.shuffle.partitions"]) * 4 < int(large["spark.sql.shuffle.partitions"])
    assert int(settings_for(10**18, 8000)["spark.sql.shuffle.partitions"]) == 200_000
    assert large["spark.sql.files.maxPartitionBytes"] == str(256 * 2**20)


def test_matrix_columns_are_not_collected_without_bound(spark, make_sales):
    sales = make_sales({"region": "A"}, {"region": "B"}, {"region": None})
    assert products.product_region_matrix(sales).columns == ["product", "A", "B"]
    spark.conf.set("spark.sql.pivotMaxValues", "1")
    try:
        with pytest.raises(ValueError, match="name the matrix columns"):
            products.product_region_matrix(sales)
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


@pytest.mark.parametrize("column", ["unit_price", "discount_percent", "total_amount"])
def test_double_view_equals_the_decimal_view(spark, column):
    ids = ["transaction_id", column]
    double = star.sales_view(spark, FOLDER, ids, exact=False)
    decimal = documented(star.sales_view(spark, FOLDER, ids))
    assert dict(double.dtypes)[column] == "double"
    assert double.exceptAll(decimal).count() == 0 and decimal.exceptAll(double).count() == 0
