"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import filters, headline, products, regions, rules
from ledgerloom.plans.registry import builders
from ledgerloom.sources import star

FOLDER = "/root/testdata/sf0.001"
EAGER = {"written_months", "client_rows"}
LAZY = [name for name in builders() if name not in EAGER]


def final_plan(frame) -> str:
    """Executed plan text, after adaptive execution."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", LAZY)
def test_every_plan_is_built_in_partitioned_and_free_of_cross_joins(spark, plan_of, name):
    plan = plan_of(builders()[name](spark, FOLDER))
    for word in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
        assert word not in plan
    for window in re.findall(r"windowspecdefinition\((.*?),", plan):
        # A window that starts with its order has no partition.  The one allowed runs
        # over the sizes of at most 1,024 key ranges.
        unpartitioned = " ASC" in window or " DESC" in window
        assert not unpartitioned or window.startswith("_range#"), window


def scanned(plan: str) -> set[str]:
    return set(re.findall(r"/(\w+)\.parquet", plan))


def columns_read(plan: str, table: str) -> set[str]:
    found = re.search(rf"/{table}\.parquet\].*?ReadSchema: struct<(.*?)>", plan, re.S)
    return {part.split(":")[0] for part in found.group(1).split(",")}


@pytest.mark.parametrize(
    "name, tables",
    [
        ("sales_row_count", {"lineitem"}),
        ("product_summary", {"lineitem", "part"}),
        ("kpi_values", {"lineitem", "orders"}),
        ("kpi_values_by_region", {"lineitem", "orders", "customer", "nation", "region"}),
        ("region_sales", {"lineitem", "orders", "customer", "nation", "region"}),
        ("tier_adjusted_discount", {"lineitem", "supplier"}),
    ],
)
def test_only_needed_tables_are_read(spark, plan_of, name, tables):
    assert scanned(plan_of(builders()[name](spark, FOLDER))) == tables


def test_only_needed_columns_are_read(spark, plan_of):
    plan = plan_of(builders()["product_quantity_vs_revenue"](spark, FOLDER))
    assert columns_read(plan, "lineitem") == {"l_partkey", "l_quantity", "l_extendedprice", "l_discount"}
    assert columns_read(plan, "part") == {"p_partkey", "p_brand"}


def test_all_filters_reach_the_scans(spark, plan_of):
    plan = plan_of(builders()["kpi_values_filtered"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in plan
    assert "LessThan(o_orderdate,2000-01-01T00:00)" in plan
    assert "In(r_name, [ASIA,EUROPE,MIDDLE EAST])" in plan
    assert "In(p_brand, [" in plan
    # The predicates reject nulls, so the joins they pass through are inner ones.
    assert len(re.findall("Join Inner", plan)) >= 3


@pytest.mark.parametrize("name", ["filter_top_products", "top_products", "dash_product_table"])
def test_top_k_does_not_sort_everything(spark, plan_of, name):
    plan = plan_of(builders()[name](spark, FOLDER))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("operator", [regions.best_month_by_region, regions.worst_month_by_region])
def test_best_month_is_cut_before_the_shuffle(spark, plan_of, operator):
    assert "WindowGroupLimit" in plan_of(operator(star.sales_view(spark, FOLDER)))


@pytest.mark.parametrize("operator", [products.top_bottom_products, products.revenue_concentration])
def test_two_rankings_share_one_pass(spark, operator):
    frame = operator(star.sales_view(spark, FOLDER, ["product", "total_amount"]))
    assert "ReusedExchange" in final_plan(frame)


@pytest.mark.parametrize(
    "operator", [products.top_product_trend, lambda s: products.product_region_pivot(s, 5, ["ASIA"])]
)
def test_top_k_reports_read_the_sales_once(spark, plan_of, operator):
    view = star.sales_view(spark, FOLDER, ["product", "region", "date", "total_amount"])
    plan = plan_of(operator(view))
    assert plan.count("lineitem.parquet") == 1
    assert "LeftSemi" not in plan


def test_membership_in_a_top_k_set_does_not_shuffle_the_sales(spark):
    rows = filters.top_product_rows(star.sales_view(spark, FOLDER, ["product", "total_amount"]))
    assert re.search(r"BroadcastHashJoin .*LeftSemi, BuildRight", final_plan(rows))


@pytest.mark.parametrize(
    "rule",
    [
        rules.net_amount,
        rules.adjusted_price,
        rules.discount_bounds,
        rules.tier_adjusted_discount,
        rules.performer_label,
    ],
)
def test_row_rules_move_no_rows(make_sales, plan_of, rule):
    plan = plan_of(rule(make_sales({})))
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["kpi_values_by_region", "kpi_values_filtered", "dash_region_bar_by_region"])
def test_a_region_filter_reaches_the_customers(spark, plan_of, name):
    plan = plan_of(builders()[name](spark, FOLDER))
    assert "LeftOuter" not in plan.split("o_custkey", 1)[1].split("l_orderkey")[0]
    assert not re.search(r"Left keys \[1\]: \[o_custkey[^\]]*\]\s*Right keys[^\n]*\s*Join type: LeftOuter", plan)


def test_the_median_is_distributed(spark, plan_of):
    plan = plan_of(builders()["product_summary"](spark, FOLDER))
    assert "percentile" not in plan and "median(" not in plan


# --- skew ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Star tables in which one order, one customer and one part hold a third of all rows."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    n = 60000
    hot = F.col("id") % 3 == 0
    ids = spark.range(0, n, 1, 16)
    ids.select(
        F.when(hot, 0).otherwise(F.col("id")).alias("l_orderkey"),
        F.when(hot, 0).otherwise(F.col("id") % 5000).alias("l_partkey"),
        (F.col("id") % 10).alias("l_suppkey"),
        F.lit(1).alias("l_linenumber"),
        F.lit(2.0).alias("l_quantity"),
        (F.col("id") % 1000 / F.lit(100.0) + 1).alias("l_extendedprice"),
        F.lit(0.05).alias("l_discount"),
        F.lit(0.0).alias("l_tax"),
        F.lit("A").alias("l_returnflag"),
        F.lit("F").alias("l_linestatus"),
        F.lit("2000-01-01").cast("timestamp_ntz").alias("l_shipdate"),
    ).write.parquet(f"{folder}/lineitem.parquet")
    ids.select(
        F.col("id").alias("o_orderkey"),
        F.when(hot, 0).otherwise(F.col("id") % 3000).alias("o_custkey"),
        F.lit("F").alias("o_orderstatus"),
        F.lit(1.0).alias("o_totalprice"),
        F.lit("2000-01-01").cast("timestamp_ntz").alias("o_orderdate"),
        F.lit("5-LOW").alias("o_orderpriority"),
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(3000).select(
        F.col("id").alias("c_custkey"),
        F.concat(F.lit("Customer#"), "id").alias("c_name"),
        (F.col("id") % 25).cast("int").alias("c_nationkey"),
        F.lit(1.0).alias("c_acctbal"),
        F.lit("BUILDING").alias("c_mktsegment"),
    ).write.parquet(f"{folder}/customer.parquet")
    spark.range(5000).select(
        F.col("id").alias("p_partkey"),
        F.lit("p").alias("p_name"),
        F.concat(F.lit("Brand#"), F.col("id") % 25).alias("p_brand"),
        F.lit("t").alias("p_type"),
        F.lit(1).alias("p_size"),
        F.lit(1.0).alias("p_retailprice"),
    ).write.parquet(f"{folder}/part.parquet")
    for name in ("nation", "region", "supplier"):
        star.table(spark, FOLDER, name).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_skewed_joins_are_split_and_right(spark, skewed):
    columns = ["region", "product", "total_amount", "customer_id"]
    plain = products.product_region(star.sales_view(spark, skewed, [*columns, "quantity"])).collect()
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        frame = products.product_region(star.sales_view(spark, skewed, [*columns, "quantity"]))
        plan = final_plan(frame)
        split = re.findall(r"SortMergeJoin\(skew=true\) \[(\w+)", plan)
        # Line items on their hot order and hot part, orders on their hot customer.
        assert {"l_orderkey", "l_partkey", "o_custkey"} <= set(split)
        assert frame.collect() == plain
        kpi = headline.kpi_values(star.sales_view(spark, skewed, columns)).first()
        assert kpi["total_transactions"] == 60000
    finally:
        for key in settings:
            spark.conf.unset(key)


@pytest.mark.parametrize("name", ["product_performance", "revenue_concentration", "product_summary"])
def test_lines_are_summed_before_they_meet_the_parts(spark, plan_of, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(builders()[name](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = plan.split("\n\n")[0]
    scan = next(line for line in tree.splitlines() if "Scan parquet" in line)
    below = tree[: tree.index(scan)].splitlines()
    # From the scan upwards: projection, partial sums, then the exchange on the part key.
    order = [w for line in reversed(below) for w in ("HashAggregate", "Exchange", "Join") if w in line]
    assert order[:3] == ["HashAggregate", "Exchange", "HashAggregate"]
    assert re.search(r"hashpartitioning\(l_partkey", plan)


def test_labels_are_translated_on_the_dimensions(spark, plan_of):
    plan = plan_of(builders()["adjusted_price"](spark, FOLDER))
    # The map of brand labels is searched in the part table's projection.
    part = plan[plan.index("part.parquet") :]
    assert "Brand#1" in part.split("Scan parquet")[0]
