from __future__ import annotations

import datetime

import pytest

from ledgerloom.operators import regions


def test_revenue_per_region_keeps_the_null_region_and_null_sums(make_sales, rows):
    sales = make_sales(
        {"region": "North", "total_amount": 10.0},
        {"region": "North", "total_amount": None},
        {"region": None, "total_amount": 4.5},
        {"region": "South", "total_amount": None},
    )
    assert rows(regions.region_sales(sales)) == [
        ("North", 10.0, 10.0, 2, 10.0),
        (None, 4.5, 4.5, 1, 4.5),
        ("South", None, None, 1, None),
    ]


def test_region_metrics_count_customers_once(make_sales, rows):
    sales = make_sales(
        {"total_amount": 10.0, "customer_id": "a", "quantity": 2, "discount_percent": 5.0},
        {"total_amount": 20.0, "customer_id": "a", "quantity": 1, "discount_percent": 0.0},
        {"total_amount": 30.0, "customer_id": None, "quantity": 3, "discount_percent": 10.0},
    )
    assert rows(regions.region_metrics(sales)) == [("North", 60.0, 3, 20.0, 6, 1, 5.0, 60.0)]


def test_no_customers_gives_null_not_an_error(make_sales, rows):
    sales = make_sales({"customer_id": None})
    assert rows(regions.region_metrics(sales), "sales_per_customer") == [(None,)]
    assert rows(regions.region_scatter(sales), "sales_per_customer") == [(None,)]


def test_channels_are_listed_by_revenue_inside_a_region(make_sales, rows):
    sales = make_sales(
        {"region": "South", "sales_channel": "Retail", "total_amount": 1.0},
        {"region": "North", "sales_channel": "Retail", "total_amount": 1.0},
        {"region": "North", "sales_channel": "Online", "total_amount": 2.0},
    )
    assert rows(regions.region_channel(sales)) == [
        ("North", "Online", 2.0, 1),
        ("North", "Retail", 1.0, 1),
        ("South", "Retail", 1.0, 1),
    ]


def test_month_series(make_sales, rows):
    sales = make_sales(
        {"date": "2024-02-29", "total_amount": 1.0},
        {"date": "2024-02-01", "total_amount": 2.0},
        {"date": "2023-12-31", "total_amount": 4.0},
    )
    assert rows(regions.monthly_region_sales(sales)) == [
        ("North", "2023-12", 2023, 12, 4.0, 1, 4.0, datetime.date(2023, 12, 1)),
        ("North", "2024-02", 2024, 2, 3.0, 2, 1.5, datetime.date(2024, 2, 1)),
    ]


TWO_MONTHS = (
    {"region": "North", "date": "2024-01-31", "total_amount": 5.0},
    {"region": "North", "date": "2024-02-01", "total_amount": 5.0},
    {"region": "South", "date": "2024-02-10", "total_amount": 3.0},
    {"region": None, "date": "2024-02-10", "total_amount": 99.0},
)


def test_pivot_keeps_missing_cells_null_and_drops_the_null_region(make_sales, rows):
    pivot = regions.region_month_pivot(make_sales(*TWO_MONTHS), ["2024-01", "2024-02"])
    assert pivot.columns == ["region", "2024-01", "2024-02"]
    assert rows(pivot) == [("North", 5.0, 5.0), ("South", None, 3.0)]


def test_pivot_finds_the_months_when_none_are_named(make_sales):
    assert regions.region_month_pivot(make_sales(*TWO_MONTHS)).columns == ["region", "2024-01", "2024-02"]


def test_earliest_month_wins_a_tie(make_sales, rows):
    sales = make_sales(*TWO_MONTHS)
    expected = [("North", "2024-01", 5.0), ("South", "2024-02", 3.0)]
    assert rows(regions.best_month_by_region(sales)) == expected
    assert rows(regions.worst_month_by_region(sales)) == expected


def test_one_month_has_no_deviation(make_sales, rows):
    found = {r[0]: r for r in rows(regions.region_monthly_stats(make_sales(*TWO_MONTHS)))}
    assert found["South"] == ("South", 3.0, 3.0, None, 1, 3.0)
    assert found["North"] == ("North", 10.0, 5.0, 0.0, 2, 5.0)
    assert None not in found


def test_mean_of_monthly_means_counts_months_not_sales(make_sales, rows):
    sales = make_sales(
        {"date": "2024-01-01", "total_amount": 10.0},
        {"date": "2024-02-01", "total_amount": 1.0},
        {"date": "2024-02-02", "total_amount": 3.0},
    )
    assert rows(regions.region_monthly_stats(sales), "avg_transaction_value_mean") == [(6.0,)]


def test_market_share_adds_up_per_month(make_sales, rows):
    shares = rows(regions.market_share(make_sales(*TWO_MONTHS)), "year_month", "market_share")
    for month in ("2024-01", "2024-02"):
        assert sum(share for m, share in shares if m == month) == pytest.approx(1.0)


def test_dashboard_drops_the_null_region_and_sums_nulls_to_zero(make_sales, rows):
    sales = make_sales(
        {"region": None, "total_amount": 7.0},
        {"region": "West", "total_amount": None, "customer_id": None, "quantity": None},
        {"region": "East", "total_amount": 2.0},
    )
    assert rows(regions.region_bar(sales)) == [("West", 0.0, 0), ("East", 2.0, 1)]
    assert rows(regions.region_scatter(sales)) == [
        ("East", 2.0, 2.0, 1, 1, 2.0),
        ("West", 0.0, None, 0, 0, None),
    ]
    assert rows(regions.region_timeline(sales)) == [
        (datetime.date(2024, 3, 1), "East", 2.0),
        (datetime.date(2024, 3, 1), "West", 0.0),
    ]


@pytest.mark.parametrize(
    "amounts, mean",
    [((0.12, 0.13), 0.12), ((0.13, 0.14), 0.14), ((-0.12, -0.13), -0.12), ((0.1, 0.1, 0.11), 0.1)],
)
def test_table_means_round_half_even(make_sales, rows, amounts, mean):
    sales = make_sales(*[{"total_amount": amount} for amount in amounts])
    assert rows(regions.region_table(sales), "avg_transaction") == [(mean,)]


def test_the_month_matrix_holds_all_revenue(spark):
    from ledgerloom.plans.registry import builders

    folder = "/root/testdata/sf0.001"
    matrix = builders()["region_month_pivot"](spark, folder)
    assert len(matrix.columns) == 81
    cells = sum(v or 0.0 for row in matrix.collect() for v in row[1:])
    whole = sum(row["total_sales"] for row in builders()["region_sales"](spark, folder).collect())
    assert cells == pytest.approx(whole, rel=1e-12)
