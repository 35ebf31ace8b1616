from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.lookup import lookup
from ledgerloom.functions.position import KEYS_PER_SPLIT, RANGES, with_position
from ledgerloom.operators import rulebook as book
from ledgerloom.operators import rules


def test_net_amount_rounds_half_up_and_checks_the_stored_total(make_sales, rows):
    sales = make_sales(
        {"quantity": 3, "unit_price": 10.0, "discount_percent": 10.0, "total_amount": 27.0},
        {"quantity": 1, "unit_price": 0.5, "discount_percent": 1.0, "total_amount": 0.49},
    )
    assert rows(rules.net_amount(sales), "subtotal", "discount_amount", "net_amount", "total_matches") == [
        (30, 3, 27, True),
        (Decimal("0.5"), Decimal("0.005"), Decimal("0.5"), False),
    ]


@pytest.mark.parametrize(
    "product, day, factor",
    [
        ("Laptop", "2024-11-30", "1.8"),
        ("Laptop", "2024-08-01", "1.44"),
        ("Printer", "2024-12-01", "1.35"),
        ("Router", "2024-10-31", "1"),
        ("Unknown", "2024-09-01", "1.2"),
    ],
)
def test_season(make_sales, rows, product, day, factor):
    found = rules.seasonal_factor(make_sales({"product": product, "date": day}))
    assert rows(found, "seasonal_factor") == [(Decimal(factor),)]


@pytest.mark.parametrize(
    "product, region, factor",
    [
        ("Laptop", "West", "1.35"),
        ("Mouse", "West", "1.3"),
        ("Tablet", "South", "0.85"),
        ("Mouse", "Elsewhere", "1"),
    ],
)
def test_region(make_sales, rows, product, region, factor):
    found = rules.regional_factor(make_sales({"product": product, "region": region}))
    assert rows(found, "regional_factor") == [(Decimal(factor),)]


def test_segment_and_the_whole_price_chain(make_sales, rows):
    sales = make_sales(
        {
            "product": "Laptop",
            "date": "2024-11-01",
            "region": "North",
            "customer_segment": "SMB",
            "unit_price": 100.01,
        }
    )
    assert rows(rules.segment_factor(sales), "segment_price") == [(Decimal("150.02"),)]
    # 100.01 * 1.8 * 1.25 * 1.5
    assert rows(rules.adjusted_price(sales), "adjusted_price") == [(Decimal("337.53"),)]


@pytest.mark.parametrize(
    "channel, quantity, discount, expected",
    [
        ("Partner", 1, 5.0, (5, 15, "single", True)),
        ("Partner", 1, 4.99, (5, 15, "single", False)),
        ("Direct", 3, 25.0, (9, 25, "multi", True)),
        ("Online", 5, 18.01, (3, 18, "bulk", False)),
        ("Elsewhere", 2, 8.0, (0, 8, "single", True)),
        ("Direct", 9, 0.0, (11, 28, "bulk", True)),
        ("Partner", -2, 5.0, (5, 15, "single", True)),
    ],
)
def test_discount_bounds(make_sales, rows, channel, quantity, discount, expected):
    sales = make_sales({"sales_channel": channel, "quantity": quantity, "discount_percent": discount})
    assert rows(rules.discount_bounds(sales), "min_pct", "max_pct", "volume_tier", "in_bounds") == [expected]


@pytest.mark.parametrize(
    "tier, expected",
    [("top_performer", "8.02"), ("high_performer", "8.02"), ("average_performer", "10.03"),
     ("low_performer", "13.04"), ("unknown", "10.03")],
)
def test_tier_adjusted_discount(make_sales, rows, tier, expected):
    sales = make_sales({"salesperson_tier": tier, "discount_percent": 10.03})
    assert rows(rules.tier_adjusted_discount(sales), "adjusted_discount") == [(Decimal(expected),)]


def test_performer_label(make_sales, rows):
    sales = make_sales(*[{"salesperson_tier": tier} for tier in (*book.TIER_MULTIPLIERS, "unknown")])
    assert [r[0] for r in rows(rules.performer_label(sales), "performer_label")] == [
        "Sam (Top)", "Sam (High)", "Sam", "Sam (Low)", "Sam",
    ]


def test_history_window_includes_both_ends(make_sales, rows):
    sales = make_sales({"date": "2024-01-11"}, {"date": "2024-01-10"}, {"date": "2024-01-09"})
    found = rules.history_window(sales, days=1)
    assert rows(found, "in_window") == [(True,), (True,), (False,)]
    found = rules.history_window(sales, days=1, as_of=datetime.date(2024, 1, 10))
    assert rows(found, "in_window") == [(False,), (True,), (True,)]


# --- positions and accounts ------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 3, 7, 1000, RANGES * KEYS_PER_SPLIT * 3])
def test_position_is_the_rank(spark, n):
    # Keys in scattered order, with gaps, negative ones among them.
    frame = spark.range(n).select(((F.col("id") * 7919 % 100003) * 3 - 5000).alias("k")).repartition(5)
    found = with_position(frame, "k", "at").orderBy("k").select("k", "at").collect()
    keys = sorted(i * 7919 % 100003 * 3 - 5000 for i in range(n))
    assert [tuple(r) for r in found] == [(k, at) for at, k in enumerate(keys, start=1)]


def test_position_of_text_keys(spark):
    keys = [f"user-{i * 31 % 977:x}" for i in range(977)]
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    found = with_position(frame, "k", "at").orderBy("at").collect()
    assert [r["k"] for r in found] == sorted(keys)


def test_position_ranges_are_balanced(spark):
    """No range takes more than a few times its share of the keys."""
    n = RANGES * 100
    plan = with_position(spark.range(n).withColumnRenamed("id", "k"), "k", "at")
    assert plan.agg(F.max("at")).first()[0] == n
    # The limits are an even sample; rebuild them the same way and look at the gaps.
    sample = (
        spark.range(n).withColumnRenamed("id", "k").orderBy(F.xxhash64("k"), "k")
        .limit((RANGES - 1) * KEYS_PER_SPLIT).orderBy("k").collect()
    )
    limits = [r["k"] for r in sample][KEYS_PER_SPLIT - 1 :: KEYS_PER_SPLIT]
    gaps = [b - a for a, b in zip([0, *limits], [*limits, n])]
    assert max(gaps) < 5 * n / RANGES


@pytest.mark.parametrize("n, accounts", [(10, 3), (12, 4), (7, 7), (2, 5), (1, 1)])
def test_account_blocks(spark, n, accounts):
    ids = [f"c{i:03d}" for i in range(n)]
    frame = spark.createDataFrame([(i,) for i in ids * 2 + [None]], "customer_id string")
    found = {r["customer_id"]: r["account"] for r in rules.account_assignment(frame, accounts).collect()}
    size = n // accounts
    expected = {
        name: accounts - 1 if size == 0 else min(at // size, accounts - 1) for at, name in enumerate(ids)
    }
    assert found == expected


def test_account_sales(make_sales, spark, rows):
    sales = make_sales(
        {"customer_id": "a", "total_amount": 1.0},
        {"customer_id": "a", "total_amount": 2.0},
        {"customer_id": "b", "total_amount": 4.0},
        {"customer_id": "c", "total_amount": 8.0},
    )
    assignment = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "customer_id string, account int")
    assert rows(rules.account_sales(sales, assignment)) == [(0, 7.0, 3, 2), (1, 8.0, 1, 1)]


# --- lookups ---------------------------------------------------------------------


def test_lookup_quotes_labels_and_leaves_unknown_ones_null(spark, rows):
    table = {"it's": "1.5", "back\\slash": "2", "": "3"}
    keys = spark.createDataFrame([("it's",), ("back\\slash",), ("",), ("other",), (None,)], "k string")
    found = rows(keys.select(lookup(table, "k", "decimal(3,1)")))
    assert [r[0] for r in found] == [Decimal("1.5"), Decimal("2"), Decimal("3"), None, None]


def test_lookup_has_no_limit(spark, rows):
    frame = spark.createDataFrame([("a",), ("300",)], "k string")
    assert rows(frame.select(lookup({}, "k", "string"))) == [(None,), (None,)]
    assert rows(frame.select(lookup({str(i): i for i in range(500)}, "k", "int"))) == [(None,), (300,)]


def test_a_caller_may_bring_a_table_of_any_size(spark, make_sales, rows):
    table = spark.createDataFrame([("Laptop", "1.5"), *((f"p{i}", "1") for i in range(300))], "k string, v string")
    sales = make_sales({"product": "Laptop", "date": "2024-01-01"}, {"product": "Other", "date": "2024-01-01"})
    found = rules.seasonal_factor(sales, table)
    assert sorted(rows(found, "product", "seasonal_factor")) == [("Laptop", Decimal("1.5")), ("Other", Decimal("1"))]
    assert found.columns == [*sales.columns, "seasonal_factor"]


def test_own_rule_tables(make_sales, rows):
    sales = make_sales({"region": "R", "customer_segment": "S", "salesperson_tier": "T", "unit_price": 10.0,
                        "sales_channel": "C", "quantity": 2, "discount_percent": 10.0})
    assert rows(rules.regional_factor(sales, {"R": "2"}, {}), "regional_factor") == [(Decimal("2"),)]
    assert rows(rules.segment_factor(sales, {"S": "3"}), "segment_price") == [(Decimal("30"),)]
    assert rows(rules.tier_adjusted_discount(sales, {"T": "2"}), "adjusted_discount") == [(Decimal("8"),)]
    assert rows(rules.performer_label(sales, {"T": " (!)"}), "performer_label") == [("Sam (!)",)]
    found = rules.discount_bounds(sales, {"C": (1, 2)}, tiers={0: ("low", (0, 0)), 2: ("two", (1, 1))})
    assert rows(found, "min_pct", "max_pct", "volume_tier") == [(2, 3, "two")]


def test_null_keys_come_last(spark):
    frame = spark.range(5000).select(F.when(F.col("id") != 17, F.col("id")).alias("k"))
    found = {r["k"]: r["at"] for r in with_position(frame, "k", "at", ranges=16).collect()}
    assert found[None] == 5000 and found[16] == 17 and found[18] == 18
