"""``sales`` as a view over star-schema Parquet tables.

One sale per line item.  Dimensions are looked up with left joins on their primary
keys, so every line item stays exactly one sale and a lookup nobody reads can be
left out without changing the result: ``sales_view(..., columns=...)`` plans only
the joins the requested columns come from.  Predicates that reject nulls turn the
left joins on their way into inner ones, and Catalyst pushes them into the dimension scans.

Join shape: customers take their region first, orders then take their customer's attributes,
and line items take theirs last.  So a region filter reaches the customers before anything
is shuffled, and the customer shuffle moves orders rather than the more numerous line items.  No join carries a hint: a dimension is broadcast when its size is below the
session limit, a larger one is shuffled, and adaptive execution splits skewed
partitions of the left (fact) side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.lookup import translated_sql
from ledgerloom.functions.parts import merged, parts
from ledgerloom.sources.schema import SALES_COLUMNS

# The table layouts. Naming them skips the schema-inference job.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}

# Sales columns by the table they come from.
#
# Measures are worked out on the line items before any join, so a join shuffles
# finished 8-byte values.  Stored prices are whole cents and stored discounts whole
# per cent, both held as double: they are taken to the nearest whole number once and
# all further arithmetic is on integers, many times cheaper per row than decimal.
QUANTITY = "cast(l_quantity as bigint)"
LINE_CENTS = "floor(l_extendedprice * 100 + 0.5D)"
PERCENT = "floor(l_discount * 100 + 0.5D)"
PRICE_CENTS = f"((2 * {LINE_CENTS} + {QUANTITY}) div nullif(2 * {QUANTITY}, 0))"
TOTAL_CENTS = f"(({QUANTITY} * {PRICE_CENTS} * (100 - {PERCENT}) + 50) div 100)"
LINE_COLUMNS = {
    "transaction_id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
    "quantity": QUANTITY,
    "unit_price": f"cast(cast({PRICE_CENTS} as decimal(12,0)) * 0.01BD as decimal(12,2))",
    "discount_percent": f"cast({PERCENT} as decimal(5,2))",
    "total_amount": f"cast(cast({TOTAL_CENTS} as decimal(14,0)) * 0.01BD as decimal(14,2))",
}
# The same three as double, for results that list rows and sum nothing.
LINE_COLUMNS_AS_DOUBLE = LINE_COLUMNS | {
    "unit_price": f"{PRICE_CENTS} / 100D",
    "discount_percent": f"cast({PERCENT} as double)",
    "total_amount": f"{TOTAL_CENTS} / 100D",
}
ORDER_COLUMNS = {
    "date": "cast(o_orderdate as date)",
    "customer_id": "cast(o_custkey as string)",
    "sales_channel": "o_orderpriority",
}
CUSTOMER_COLUMNS = {
    "customer_name": "c_name",
    "customer_email": "concat(lower(replace(c_name, '#', '')), '@example.com')",
    "customer_segment": "c_mktsegment",
}
REGION_COLUMNS = {"region": "r_name"}
PART_COLUMNS = {"product": "p_brand"}
SUPPLIER_COLUMNS = {
    "salesperson": "s_name",
    "salesperson_tier": "case when s_acctbal >= 8000 then 'top_performer' "
    "when s_acctbal >= 6000 then 'high_performer' "
    "when s_acctbal >= 1000 then 'average_performer' else 'low_performer' end",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def sales_view(
    spark: SparkSession,
    folder: str,
    columns: Iterable[str] = SALES_COLUMNS,
    exact: bool = True,
    labels: Mapping[str, Mapping[str, str]] | None = None,
    read: Callable[[SparkSession, str, str], DataFrame] = table,
) -> DataFrame:
    """The sales table, limited to ``columns``, in documented column order.

    Money is decimal, or with ``exact=False`` the double it is documented as.  ``labels``
    translates dimension columns, once per dimension row, before the joins.  ``read`` gives
    a star table by session, folder and name.
    """
    wanted = set(columns)
    if unknown := wanted - set(SALES_COLUMNS):
        raise ValueError(f"not sales columns: {sorted(unknown)}")

    def pick(source: dict[str, str], *keys: str) -> list[str]:
        known = labels or {}
        named = {n: translated_sql(known[n], sql) if n in known else sql for n, sql in source.items()}
        return [*keys, *(f"{sql} as {name}" for name, sql in named.items() if name in wanted)]

    def join(fact: DataFrame, name: str, fact_key: str, key: str, picked: list[str]) -> DataFrame:
        dimension = read(spark, folder, name).selectExpr(picked)
        return fact.join(dimension, fact[fact_key] == dimension[key], "left")

    from_region = wanted & REGION_COLUMNS.keys()
    from_customer = from_region or wanted & CUSTOMER_COLUMNS.keys()
    from_order = from_customer or wanted & ORDER_COLUMNS.keys()

    line_keys = ["l_orderkey"] if from_order else []
    line_keys += ["l_partkey"] if wanted & PART_COLUMNS.keys() else []
    line_keys += ["l_suppkey"] if wanted & SUPPLIER_COLUMNS.keys() else []
    measures = LINE_COLUMNS if exact else LINE_COLUMNS_AS_DOUBLE
    sales = read(spark, folder, "lineitem").selectExpr(pick(measures, *line_keys))
    if from_order:
        order_keys = ["o_orderkey", "o_custkey"] if from_customer else ["o_orderkey"]
        orders = read(spark, folder, "orders").selectExpr(pick(ORDER_COLUMNS, *order_keys))
        if from_customer:
            customer_keys = ["c_custkey", "c_nationkey"] if from_region else ["c_custkey"]
            buyers = read(spark, folder, "customer").selectExpr(pick(CUSTOMER_COLUMNS, *customer_keys))
            if from_region:
                buyers = join(buyers, "nation", "c_nationkey", "n_nationkey", ["n_nationkey", "n_regionkey"])
                buyers = join(buyers, "region", "n_regionkey", "r_regionkey", pick(REGION_COLUMNS, "r_regionkey"))
            orders = orders.join(buyers, orders["o_custkey"] == buyers["c_custkey"], "left")
        sales = sales.join(orders, sales["l_orderkey"] == orders["o_orderkey"], "left")
    if wanted & PART_COLUMNS.keys():
        sales = join(sales, "part", "l_partkey", "p_partkey", pick(PART_COLUMNS, "p_partkey"))
    if wanted & SUPPLIER_COLUMNS.keys():
        sales = join(sales, "supplier", "l_suppkey", "s_suppkey", pick(SUPPLIER_COLUMNS, "s_suppkey"))
    return sales.select(*[name for name in SALES_COLUMNS if name in wanted])


def product_parts(spark: SparkSession, folder: str, columns: Iterable[str]) -> DataFrame:
    """Additive parts of the measures ``columns`` per product.

    The line items are summed per part before they meet the part table, so where that is too
    large to broadcast the shuffle carries one row per part and task, not every line item.
    """
    named = [f"{LINE_COLUMNS[name]} as {name}" for name in columns]
    lines = table(spark, folder, "lineitem").selectExpr("l_partkey", *named)
    per_part = parts(lines, ["l_partkey"], columns)
    part = table(spark, folder, "part").selectExpr("p_partkey", f"{PART_COLUMNS['product']} as product")
    joined = per_part.join(part, per_part["l_partkey"] == part["p_partkey"], "left")
    return merged(joined.drop("l_partkey", "p_partkey"), ["product"])


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customer ids, numeric, in the order accounts are dealt out."""
    return table(spark, folder, "customer").selectExpr("c_custkey as customer_key")


def salespeople(spark: SparkSession, folder: str) -> DataFrame:
    """One row per salesperson, tiered by account balance."""
    return table(spark, folder, "supplier").selectExpr(
        *(f"{sql} as {name}" for name, sql in SUPPLIER_COLUMNS.items())
    )


# Tables that are joined on a key of the line items, and that key on either side.
PAIRED = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def write_bucketed(spark: SparkSession, folder: str, database: str, buckets: int) -> None:
    """Save line items and orders as catalog tables bucketed by order, so that the largest join needs
    no exchange from then on.  Choose ``buckets`` so that a bucket of line items fits a task."""
    for name, key in PAIRED.items():
        rows = table(spark, folder, name).repartition(buckets, key)
        rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(f"{database}.{name}")


def from_bucketed(database: str) -> Callable[[SparkSession, str, str], DataFrame]:
    """A ``read`` for :func:`sales_view`: the bucketed tables by name, the others from the folder."""
    return lambda spark, folder, name: spark.table(f"{database}.{name}") if name in PAIRED else table(spark, folder, name)
