"""All panels from one read, sets of ids, selection and kept results."""

from __future__ import annotations

import gc
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.distinct import id_sets, merged_sets, parts_with_ids, set_sizes
from ledgerloom.functions.keep import Kept
from ledgerloom.functions.selection import middle_values
from ledgerloom.operators import headline, products, regions
from ledgerloom.operators.dashboard import dashboard, panel_values
from ledgerloom.sources.star import sales_view

FOLDER = "/root/testdata/sf0.001"
OPERATORS = {
    "kpi_values": headline.kpi_values,
    "kpi_text": headline.kpi_text,
    "region_bar": regions.region_bar,
    "region_scatter": regions.region_scatter,
    "region_timeline": regions.region_timeline,
    "top_products": products.product_bar,
    "product_profitability": products.product_profitability_scatter,
    "product_region_matrix": products.product_region_matrix,
    "region_table": regions.region_table,
    "product_table": products.product_table,
}
ODD = [
    {"region": None, "customer_id": "c1"},
    {"product": None, "total_amount": 7.5},
    {"date": None, "customer_id": "7"},
    {"customer_id": None, "quantity": 0},
    {"customer_id": "07", "total_amount": None, "unit_price": None, "discount_percent": None, "quantity": None},
    {"region": "South", "product": "Pen", "customer_id": "7", "discount_percent": 12.5},
    {"region": "South", "product": "Pen", "customer_id": "-7", "total_amount": None},
    {"region": "West", "product": "Cup", "total_amount": None, "quantity": 0},
    {"region": "South", "product": "Mouse", "customer_id": "71", "total_amount": 0.125},
    {"region": "South", "product": "Mouse", "customer_id": "71", "total_amount": 0.12, "date": "2024-04-01"},
]
CHOICES = [{}, {"regions": ["South", "North"]}, {"products": ["Pen"]}, {"date_range": ("2024-03-01", "2024-03-31")}, {"regions": ["Nowhere"]}]


@pytest.mark.parametrize("choice", CHOICES, ids=str)
def test_panels_equal_their_operators(make_sales, choice):
    sales = make_sales(*ODD)
    with dashboard(sales, **choice) as panels:
        for name, operator in OPERATORS.items():
            got, want = getattr(panels, name)(), operator(sales, **choice)
            assert got.dtypes == want.dtypes, name
            assert got.collect() == want.collect(), name


def test_panels_of_no_sales(make_sales):
    sales = make_sales({}).limit(0)
    with dashboard(sales) as panels:
        assert {name: getattr(panels, name)().collect() for name in OPERATORS} == {n: o(sales).collect() for n, o in OPERATORS.items()}



def test_line_items_are_read_once_for_all_panels(spark):
    panels = dashboard(sales_view(spark, FOLDER), regions=["ASIA"])
    made_of = panels.kept._held._jdf.queryExecution().executedPlan().toString()
    assert made_of.count("lineitem.parquet") == 1
    assert made_of.split("== Initial Plan ==")[0].count("Exchange hashpartitioning(_is_set") <= 1
    for name in OPERATORS:
        columns = {"regions_shown": ["ASIA"]} if name == "product_region_matrix" else {}
        plan = getattr(panels, name)(**columns)._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" in plan and "Relation [" not in plan.replace("InMemoryRelation [", ""), name
    frame = panel_values(panels, ["ASIA"])
    whole = frame._jdf.queryExecution().withCachedData().toString()
    assert whole.count("InMemoryRelation") >= 10 and "LogicalRelation" not in whole
    panels.close()


def test_a_kept_result_is_found_by_its_own_plan_only_and_let_go(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    one = Kept(spark.read.parquet(path).groupBy().count())
    assert one.frame.first()[0] == 3
    spark.range(4).write.mode("append").parquet(path)
    two = Kept(spark.read.parquet(path).groupBy().count())
    assert two.frame.first()[0] == 7
    result = one.until_gone(one.frame.select("count"))
    held = one._held
    assert held.storageLevel.useMemory
    del result
    gc.collect()
    assert not held.storageLevel.useMemory
    two.release()


# --- sets of ids


IDS = ["1", "2", "64", "65", "01", "+1", " 1", "-1", "-64", "-65", "x", "", "9223372036854775807", "9223372036854775808", "1.0", None, "٣"]


def test_set_sizes_equal_distinct_counts(spark, rows):
    random.seed(5)
    data = [(random.choice("abc"), random.randrange(3), random.choice(IDS)) for _ in range(400)] + [("d", 0, None), (None, 1, "1")]
    frame = spark.createDataFrame(data, "g string, batch int, id string")
    want = sorted(rows(frame.groupBy("g").agg(F.countDistinct("id"))), key=repr)
    by_batch = id_sets(frame, ["g", "batch"], "id")
    got = set_sizes(merged_sets(by_batch, ["g"]), ["g"], "n")
    known = {g: n for g, n in rows(got)}
    assert {g: n for g, n in want if n} == known
    assert set_sizes(merged_sets(by_batch, []), [], "n").first()["n"] == frame.agg(F.countDistinct("id")).first()[0]
    assert set_sizes(merged_sets(by_batch.limit(0), []), [], "n").first()["n"] == 0
    whole = parts_with_ids(frame, ["g"], ["batch"], "id", "n")
    assert sorted(rows(whole, "g", "n"), key=repr) == want
    assert sorted(rows(whole, "g", "batch_sum", "batch_n", "_rows"), key=repr) == sorted(
        rows(frame.groupBy("g").agg(F.sum("batch"), F.count("batch"), F.count("*"))), key=repr
    )


def test_dense_ids_share_words(spark):
    frame = spark.range(0, 6400, 1, 4).selectExpr("cast(id as string) id", "id % 2 = 0 AS g")
    sets = id_sets(frame, ["g"], "id")
    assert sets.count() == 200
    assert sorted(map(tuple, set_sizes(sets, ["g"], "n").collect())) == [(False, 3200), (True, 3200)]


def test_customers_are_not_shuffled_one_by_one(spark, plan_of):
    for frame in (regions.region_metrics(sales_view(spark, FOLDER)), headline.kpi_values(sales_view(spark, FOLDER)), regions.region_table(sales_view(spark, FOLDER))):
        exchanges = [line for line in plan_of(frame).split("\n") if "hashpartitioning" in line]
        assert not any("customer_id" in line for line in exchanges)


# --- selection


def brute_middle(values):
    known = sorted(v for v in values if v is not None)
    return (known[(len(known) - 1) // 2], known[len(known) // 2]) if known else None


@pytest.mark.parametrize(
    "values",
    [
        [],
        [None, None],
        [5],
        [1, 2],
        [7, 7, 7, 7],
        [1, 1, 2, 2],
        [3, None, 1, 2, None],
        [-(10**25), 10**25, 0, 1],
        [2**i for i in range(80)],
        [2**i for i in range(80)] + [2**40 + 1] * 81,
        list(range(5000)),
    ],
    ids=lambda v: f"{len(v)} values",
)
@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_middle_values(spark, values, buckets):
    from decimal import Decimal

    frame = spark.createDataFrame([(None if v is None else Decimal(v),) for v in values], "v decimal(38,0)")
    assert middle_values(frame, "v", buckets) == brute_middle(values)


def test_passes_are_few(spark, monkeypatch):
    jobs = []
    frame = spark.range(0, 20000).selectExpr("id * 7919 % 20011 * 1000003 AS v").cache()
    real = type(frame).collect
    monkeypatch.setattr(type(frame), "collect", lambda self: jobs.append(1) or real(self))
    assert middle_values(frame, "v") == brute_middle([i * 7919 % 20011 * 1000003 for i in range(20000)])
    assert len(jobs) <= 4
    frame.unpersist()


def test_matrix_regions_come_from_the_top_products(make_sales):
    sales = make_sales({"product": "A", "region": "North", "total_amount": 50.0}, {"product": "B", "region": "South", "total_amount": 5.0})
    assert products.product_region_matrix(sales, k=1).columns == ["product", "North"]
    got = products.product_region_matrix(sales)
    assert [tuple(r) for r in got.collect()] == [("A", 50.0, 0.0), ("B", 0.0, 5.0)]
