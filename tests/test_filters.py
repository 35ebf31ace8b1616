from __future__ import annotations

import datetime

import pytest

from ledgerloom.operators import filters, headline, products, regions

SALES = (
    {"date": "2024-01-01", "region": "North", "product": "A", "total_amount": 1.0},
    {"date": "2024-01-31", "region": "South", "product": "B", "total_amount": 2.0},
    {"date": "2024-02-01", "region": "North", "product": "B", "total_amount": 4.0},
    {"date": "2024-02-02", "region": None, "product": None, "total_amount": 8.0},
)
JANUARY = ("2024-01-01", "2024-01-31")
FILTERED = [
    headline.kpi_values,
    headline.kpi_text,
    regions.region_bar,
    regions.region_scatter,
    regions.region_timeline,
    regions.region_table,
    products.product_bar,
    products.product_profitability_scatter,
    products.product_table,
]


@pytest.fixture(scope="module")
def sales(make_sales):
    return make_sales(*SALES).cache()


@pytest.mark.parametrize(
    "arguments, total",
    [
        ({}, 15.0),
        ({"regions": [], "products": [], "date_range": None}, 15.0),
        ({"date_range": JANUARY}, 3.0),
        ({"date_range": (datetime.date(2024, 1, 31), datetime.date(2024, 2, 1))}, 6.0),
        ({"regions": ["North"]}, 5.0),
        ({"products": ["B"]}, 6.0),
        ({"date_range": JANUARY, "regions": ["South"], "products": ["B"]}, 2.0),
        ({"regions": ["Nowhere"]}, 0.0),
    ],
)
def test_filters_and_their_combinations(sales, rows, arguments, total):
    assert rows(headline.kpi_values(sales, **arguments), "total_sales") == [(total,)]


def test_null_never_passes_a_membership_filter(sales):
    kept = filters.filtered_sales(sales, regions=["North", "South"])
    assert kept.where("region is null").count() == 0


@pytest.mark.parametrize("operator", FILTERED, ids=lambda f: f.__name__)
def test_filtering_first_is_the_same_as_passing_the_filter(sales, rows, operator):
    arguments = {"date_range": JANUARY, "regions": ["North", "South"], "products": ["A", "B"]}
    chosen = filters.filtered_sales(sales, **arguments)
    assert rows(operator(sales, **arguments)) == rows(operator(chosen))


@pytest.mark.parametrize("operator", FILTERED[2:], ids=lambda f: f.__name__)
def test_nothing_matching_gives_no_rows(sales, operator):
    found = operator(sales, products=["Nothing"])
    assert found.columns == operator(sales).columns
    assert found.count() == 0


def test_headline_of_nothing(sales, rows):
    assert rows(headline.kpi_values(sales, regions=["Nowhere"])) == [(0.0, 0, None, 0)]
    assert rows(headline.kpi_text(sales, regions=["Nowhere"])) == [("$0", "0", "$0", "0")]


def test_headline_text(make_sales, rows):
    sales = make_sales(
        {"total_amount": 1234567.5, "customer_id": "a"}, {"total_amount": 1.0, "customer_id": "b"}
    )
    assert rows(headline.kpi_text(sales)) == [("$1,234,568", "2", "$617284.25", "2")]


def test_filter_choices(sales, rows):
    assert {r[0] for r in rows(filters.distinct_regions(sales))} == {"North", "South", None}
    assert rows(filters.top_product_names(sales, 2)) == [(None,), ("B",)]
    assert rows(filters.date_bounds(sales)) == [(datetime.date(2024, 1, 1), datetime.date(2024, 2, 2))]


def test_rows_of_the_top_products(sales, rows):
    kept = filters.top_product_rows(sales, 2)
    assert kept.columns == sales.columns
    assert sorted(r[0] for r in rows(kept, "total_amount")) == [2, 4]


def test_disjoint_region_filters_add_up(sales, rows):
    whole = rows(headline.kpi_values(sales, regions=["North", "South"]), "total_sales")[0][0]
    parts = [rows(headline.kpi_values(sales, regions=[r]), "total_sales")[0][0] for r in ("North", "South")]
    assert sum(parts) == whole
