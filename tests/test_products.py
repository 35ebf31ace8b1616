from __future__ import annotations

import datetime

import pytest

from ledgerloom.operators import products

RANKED = (
    {"product": "D", "total_amount": 40.0, "quantity": 4},
    {"product": "C", "total_amount": 20.0, "quantity": 1},
    {"product": "B", "total_amount": 20.0, "quantity": 2},
    {"product": "A", "total_amount": 10.0, "quantity": 0},
)


def test_ties_at_the_cut_go_to_the_first_name(make_sales, rows):
    sales = make_sales(*RANKED)
    assert rows(products.top_products(sales, 2), "product") == [("D",), ("B",)]
    assert rows(products.product_bar(sales, 2)) == [("D", 40.0), ("B", 20.0)]


def test_zero_units_give_null_and_sort_last(make_sales, rows):
    sales = make_sales(*RANKED)
    assert rows(products.product_profitability(sales), "product", "revenue_per_unit") == [
        ("C", 20.0),
        ("B", 10.0),
        ("D", 10.0),
        ("A", None),
    ]
    assert rows(products.product_profitability_scatter(sales, 1), "product") == [("C",)]
    assert rows(products.top_profitable_products(sales, 2), "product") == [("C",), ("B",)]


def test_performance_and_discount_impact(make_sales, rows):
    sales = make_sales(
        {"unit_price": 10.0, "discount_percent": 10.0, "quantity": 2, "total_amount": 18.0},
        {"unit_price": 30.0, "discount_percent": 0.0, "quantity": 1, "total_amount": 30.0},
    )
    assert rows(products.product_performance(sales)) == [("Mouse", 48.0, 3, 20.0, 2, 5.0, 24.0)]
    assert rows(products.product_profitability(sales)) == [("Mouse", 48.0, 20.0, 5.0, 3, 16.0, 1.0)]


def test_month_series(make_sales, rows):
    sales = make_sales({"date": "2024-01-05"}, {"date": "2024-01-31"}, {"product": None})
    assert rows(products.product_monthly(sales)) == [
        ("Mouse", "2024-01", 2024, 1, 20.0, 2, 2, datetime.date(2024, 1, 1)),
        (None, "2024-03", 2024, 3, 10.0, 1, 1, datetime.date(2024, 3, 1)),
    ]


def test_trend_ranks_the_null_product_but_does_not_draw_it(make_sales, rows):
    sales = make_sales(
        {"product": None, "total_amount": 100.0},
        {"product": "A", "total_amount": 50.0, "date": "2024-01-01"},
        {"product": "A", "total_amount": 1.0, "date": "2024-02-01"},
        {"product": "B", "total_amount": 50.0},
    )
    assert rows(products.top_product_trend(sales, 2)) == [
        ("A", datetime.date(2024, 1, 1), 50.0),
        ("A", datetime.date(2024, 2, 1), 1.0),
    ]


MATRIX = (
    {"product": "A", "region": "North", "total_amount": 5.0},
    {"product": "A", "region": None, "total_amount": 50.0},
    {"product": "B", "region": "South", "total_amount": 20.0},
    {"product": "C", "region": "South", "total_amount": 1.0},
    {"product": None, "region": "South", "total_amount": 3.0},
)


def test_matrix_fills_gaps_with_zero(make_sales, rows):
    matrix = products.product_region_pivot(make_sales(*MATRIX), 2)
    assert matrix.columns == ["product", "North", "South"]
    # A leads through a sale without region; that sale has no cell.
    assert rows(matrix) == [("A", 5.0, 0.0), ("B", 0.0, 20.0)]


def test_matrix_top_set_is_taken_after_filtering(make_sales, rows):
    matrix = products.product_region_matrix(
        make_sales(*MATRIX), 1, ["South"], regions=["South"]
    )
    assert rows(matrix) == [("B", 20.0)]


def test_null_product_takes_a_place_only_in_the_whole_table_matrix(make_sales, rows):
    sales = make_sales(*MATRIX)
    names = ["North", "South"]
    assert rows(products.product_region_pivot(sales, 3, names), "product") == [("A",), ("B",)]
    assert rows(products.product_region_matrix(sales, 3, names), "product") == [("A",), ("B",), ("C",)]


def test_product_known_only_without_region_has_no_matrix_row(make_sales, rows):
    sales = make_sales({"product": "A", "region": None}, {"product": "B", "region": "East"})
    assert rows(products.product_region_matrix(sales, 5, ["East"])) == [("B", 10.0)]


def test_summary(make_sales, rows):
    sales = make_sales(*RANKED)
    assert rows(products.product_summary(sales)) == [(4, "D", 40.0, 22.5, 20.0)]
    assert rows(products.product_summary_text(sales)) == [("4", "D ($40.00)", "$22.50", "$20.00")]


def test_summary_top_product_tie_and_null_totals(make_sales, rows):
    sales = make_sales(
        {"product": "Z", "total_amount": None},
        {"product": "Y", "total_amount": 5.0},
        {"product": "X", "total_amount": 5.0},
    )
    assert rows(products.product_summary(sales)) == [(3, "X", 5.0, 5.0, 5.0)]


def test_top_and_bottom_are_both_shown_largest_first(make_sales, rows):
    assert rows(products.top_bottom_products(make_sales(*RANKED), 2)) == [
        ("top", 1, "D", 40.0),
        ("top", 2, "B", 20.0),
        ("bottom", 1, "C", 20.0),
        ("bottom", 2, "A", 10.0),
    ]


def test_concentration(make_sales, rows):
    sales = make_sales(*RANKED)
    assert rows(products.revenue_concentration(sales, 1)) == [(40.0, 90.0, pytest.approx(44.4444444))]
    assert rows(products.revenue_concentration_text(sales, 1)) == [("44.4%",)]
    assert rows(products.revenue_concentration(sales, 99), "concentration_pct") == [(100.0,)]


def test_table_is_rounded_and_cut(make_sales, rows):
    sales = make_sales(
        {"product": "A", "unit_price": 0.12, "discount_percent": 0.12},
        {"product": "A", "unit_price": 0.13, "discount_percent": 0.13, "customer_id": None},
        {"product": "B", "total_amount": 1.0},
        {"product": None, "total_amount": 100.0},
    )
    assert rows(products.product_table(sales, 1)) == [("A", 20.0, 2, 0.12, 0.12, 1)]


@pytest.mark.parametrize(
    "totals, median",
    [([3, 1, 2], 2.0), ([4, 1, 2, 3], 2.5), ([5, 5, 5, 1], 5.0), ([None, 2, 8], 5.0), ([None], None), ([7], 7.0)],
)
def test_median_of_odd_even_tied_and_null_totals(make_sales, rows, totals, median):
    sales = make_sales(*[{"product": f"p{i}", "total_amount": None if t is None else float(t)} for i, t in enumerate(totals)])
    assert rows(products.product_summary(sales), "median_product_sales") == [(median,)]


def test_text_of_best_and_worst(make_sales, rows):
    assert rows(products.top_bottom_products_text(make_sales(*RANKED), 1)) == [
        ("top", 1, "D", "$40.00"), ("bottom", 1, "A", "$10.00"),
    ]


def test_unnamed_matrix_columns_follow_the_kept_products(make_sales):
    matrix = products.product_region_matrix(make_sales(*MATRIX), 1)
    assert matrix.columns == ["product", "North"]
    filtered = products.product_region_matrix(make_sales(*MATRIX), 5, regions=["North"])
    assert filtered.columns == ["product", "North"]
