"""Product analyses.

Those that only add up measures per product take the sales or, where the caller has summed
them already (``sources/star.py`` does so before it joins the parts), the additive parts of
:mod:`ledgerloom.functions.parts`.

Null rules are those of the regional analyses: whole-table results keep a null
product as a group, the filtered (dashboard) part and the matrices drop it.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions.dates import month_label, month_start
from ledgerloom.functions.keep import Kept
from ledgerloom.functions.measures import (
    count_sum_or_zero,
    mean,
    percent_of,
    ratio,
    rounded_mean,
    total,
    total_or_zero,
)
from ledgerloom.functions.ordering import ascending, largest_first, last_of_largest_first
from ledgerloom.functions.parts import ROWS, part_mean, part_total, parts
from ledgerloom.functions.selection import middle_values
from ledgerloom.functions.text import dollars, grouped_text, percent, plain_text
from ledgerloom.operators.filters import filtered_sales
from ledgerloom.sources.schema import EXACT_TYPES

# --- whole-table analyses ---------------------------------------------------


def product_performance(sales: DataFrame) -> DataFrame:
    """Revenue, volume, price and discount per product, largest revenue first."""
    return _performance(sales).orderBy(*largest_first("total_sales", "product"))


def top_products(sales: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` rows of :func:`product_performance`."""
    return product_performance(sales).limit(k)


def product_monthly(sales: DataFrame) -> DataFrame:
    """Month series per product."""
    return (
        sales.groupBy("product", month_start("date").alias("date"))
        .agg(
            total("total_amount").alias("total_sales"),
            F.sum("quantity").alias("total_quantity"),
            F.count("*").alias("transaction_count"),
        )
        .select(
            "product",
            month_label("date").alias("year_month"),
            F.year("date").alias("year"),
            F.month("date").alias("month"),
            "total_sales",
            "total_quantity",
            "transaction_count",
            "date",
        )
        .orderBy(*ascending("date", "product"))
    )


def top_product_trend(sales: DataFrame, k: int = 5) -> DataFrame:
    """Month series of the ``k`` products of highest revenue.

    One pass: a product's months (a few hundred at most) travel with its total, the
    top rows are kept, and their months unfold again.  Ranking first and joining
    back would read the sales twice.
    """
    months = sales.groupBy("product", month_start("date").alias("date")).agg(
        F.sum("total_amount").alias("total")
    )
    return (
        months.groupBy("product")
        .agg(
            F.sum("total").alias("product_total"),
            F.collect_list(F.struct("date", F.col("total").cast("double").alias("total_sales"))).alias(
                "months"
            ),
        )
        .orderBy(*largest_first("product_total", "product"))
        .limit(k)
        .where(F.col("product").isNotNull())
        .select("product", F.inline("months"))
        .orderBy("product", "date")
    )


def product_quantity_vs_revenue(sales: DataFrame) -> DataFrame:
    """Units sold against revenue."""
    return (
        _by_product(sales, "quantity", "total_amount")
        .select("product", F.col("quantity_sum").alias("total_quantity"), part_total("total_amount").alias("total_sales"))
        .orderBy(*largest_first("total_sales", "product"))
    )


def product_profitability(sales: DataFrame) -> DataFrame:
    """Unit economics per product, best revenue per unit first."""
    return _profitability(sales).orderBy(*largest_first("revenue_per_unit", "product"))


def top_profitable_products(sales: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` rows of :func:`product_profitability`."""
    return product_profitability(sales).limit(k)


def product_region(sales: DataFrame) -> DataFrame:
    """Revenue and units per product and region."""
    return (
        sales.groupBy("product", "region")
        .agg(total("total_amount").alias("total_sales"), F.sum("quantity").alias("quantity"))
        .orderBy(*ascending("product", "region"))
    )


def product_region_pivot(
    sales: DataFrame, k: int = 15, regions: Sequence[str] | None = None
) -> DataFrame:
    """Revenue matrix of the ``k`` top products x region; a missing cell is 0."""
    return _top_product_matrix(sales, k, regions)


def product_summary(sales: DataFrame) -> DataFrame:
    """Number of products, the top one, and mean and median revenue per product.

    The median is found when the frame is made, by selection on the totals, which are kept
    while the frame is referenced."""
    kept, summary = _summary(sales)
    return kept.until_gone(summary)


def _summary(sales: DataFrame) -> tuple[Kept, DataFrame]:
    # Ascending order of these fields is descending revenue with the nulls last.
    rank = F.struct(
        F.col("total").isNull(), -F.col("total"), F.col("product").isNull(), F.col("product")
    )
    # The totals are computed once and read by the passes of the median and by the result.
    kept = Kept(_totals(sales))
    totals = kept.frame
    middle = middle_values(totals.select((F.col("total").cast("decimal(36,2)") * 100).alias("cents")), "cents")
    # the mean of the two as double, as a median of doubles is
    median = None if middle is None else sum(float(Decimal(cents) / 100) for cents in middle) / 2
    summary = totals.agg(
        F.count("*").alias("n_products"),
        F.min_by(F.struct("product", "total"), rank).alias("top"),
        mean("total").alias("avg_product_sales"),
    ).select(
        "n_products",
        F.col("top.product").alias("top_product"),
        F.col("top.total").cast("double").alias("top_product_sales"),
        "avg_product_sales",
        F.lit(median).cast("double").alias("median_product_sales"),
    )
    return kept, summary


def product_summary_text(sales: DataFrame) -> DataFrame:
    """:func:`product_summary` as display text."""

    def amount(name: str):
        return dollars(grouped_text(F.col(name), 2))

    kept, summary = _summary(sales)
    text = summary.select(
        F.col("n_products").cast("string").alias("n_products"),
        F.concat(
            F.coalesce("top_product", F.lit("")), F.lit(" ("), amount("top_product_sales"), F.lit(")")
        ).alias("top_product"),
        amount("avg_product_sales").alias("avg_product_sales"),
        amount("median_product_sales").alias("median_product_sales"),
    )
    return kept.until_gone(text)


def top_bottom_products(sales: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best and the ``k`` worst products, each side in descending revenue."""
    totals = _totals(sales)
    order = largest_first("total", "product")
    best = totals.orderBy(*order).limit(k).withColumn("side", F.lit("top"))
    worst = (
        totals.orderBy(*last_of_largest_first("total", "product"))
        .limit(k)
        .withColumn("side", F.lit("bottom"))
    )
    place = F.row_number().over(Window.partitionBy("side").orderBy(*order))
    return (
        best.unionByName(worst)
        .select("side", place.alias("rank"), "product", F.col("total").cast("double").alias("total_sales"))
        .orderBy(F.desc("side"), "rank")
    )


def top_bottom_products_text(sales: DataFrame, k: int = 5) -> DataFrame:
    """:func:`top_bottom_products` as display text."""
    return top_bottom_products(sales, k).select(
        "side", "rank", "product", dollars(grouped_text(F.col("total_sales"), 2)).alias("total_sales")
    )


def revenue_concentration(sales: DataFrame, k: int = 10) -> DataFrame:
    """Share of the revenue held by the ``k`` top products, in per cent."""
    totals = _totals(sales)
    whole = totals.agg(F.sum("total").cast("double")).scalar()
    return (
        totals.orderBy(*largest_first("total", "product"))
        .limit(k)
        .agg(F.sum("total").cast("double").alias("top_k_revenue"))
        .withColumn("total_revenue", whole)
        .withColumn("concentration_pct", ratio("top_k_revenue", "total_revenue") * 100)
    )


def revenue_concentration_text(sales: DataFrame, k: int = 10) -> DataFrame:
    """:func:`revenue_concentration` as display text."""
    return revenue_concentration(sales, k).select(
        percent(plain_text(F.col("concentration_pct"), 1)).alias("concentration")
    )


# --- filtered (dashboard) analyses ------------------------------------------


def product_bar(sales: DataFrame, k: int = 10, **filters) -> DataFrame:
    """The ``k`` products of highest revenue."""
    return (
        _by_known_product(sales, filters)
        .agg(total_or_zero("total_amount").alias("total_amount"))
        .orderBy(*largest_first("total_amount", "product"))
        .limit(k)
    )


def product_profitability_scatter(sales: DataFrame, k: int = 15, **filters) -> DataFrame:
    """The ``k`` products of highest revenue per unit; price and discount are means."""
    return (
        _by_known_product(sales, filters)
        .agg(
            total_or_zero("total_amount").alias("total_amount"),
            count_sum_or_zero("quantity").alias("quantity"),
            mean("unit_price").alias("unit_price"),
            mean("discount_percent").alias("discount_percent"),
        )
        .withColumn("revenue_per_unit", ratio("total_amount", "quantity"))
        .orderBy(*largest_first("revenue_per_unit", "product"))
        .limit(k)
    )


def product_region_matrix(
    sales: DataFrame, k: int = 15, regions_shown: Sequence[str] | None = None, **filters
) -> DataFrame:
    """Top products of the filtered sales x region; a missing cell is 0.

    ``regions_shown`` names the matrix columns; ``regions`` filters rows as usual.
    """
    rows = filtered_sales(sales, **filters).where(F.col("product").isNotNull())
    amount = F.coalesce("total_amount", F.lit(0).cast(EXACT_TYPES["total_amount"]))
    return _top_product_matrix(rows.withColumn("total_amount", amount), k, regions_shown)


def product_table(sales: DataFrame, k: int = 20, **filters) -> DataFrame:
    """Product summary, rounded to two places, then sorted, then cut to ``k`` rows."""
    return (
        _by_known_product(sales, filters)
        .agg(
            total_or_zero("total_amount").alias("total_sales"),
            count_sum_or_zero("quantity").alias("total_quantity"),
            rounded_mean("unit_price").alias("avg_unit_price"),
            rounded_mean("discount_percent").alias("avg_discount"),
            F.count("customer_id").alias("total_transactions"),
        )
        .orderBy(*largest_first("total_sales", "product"))
        .limit(k)
    )


# --- shared steps ------------------------------------------------------------


def _by_product(sales: DataFrame, *columns: str) -> DataFrame:
    """Additive parts per product: those given, or summed from the sales."""
    return sales if ROWS in sales.columns else parts(sales, ["product"], columns)


def _totals(sales: DataFrame) -> DataFrame:
    """Revenue per product, still decimal."""
    return _by_product(sales, "total_amount").select("product", F.col("total_amount_sum").alias("total"))


def _performance(sales: DataFrame) -> DataFrame:
    return (
        _by_product(sales, "total_amount", "quantity", "unit_price", "discount_percent")
        .select(
            "product",
            part_total("total_amount").alias("total_sales"),
            F.col("quantity_sum").alias("total_quantity"),
            part_mean("unit_price").alias("avg_price"),
            F.col(ROWS).alias("transaction_count"),
            part_mean("discount_percent").alias("avg_discount"),
        )
        .withColumn("revenue_per_transaction", ratio("total_sales", "transaction_count"))
    )


def _profitability(sales: DataFrame) -> DataFrame:
    return (
        _by_product(sales, "total_amount", "unit_price", "discount_percent", "quantity")
        .select(
            "product",
            part_total("total_amount").alias("total_sales"),
            part_mean("unit_price").alias("avg_unit_price"),
            part_mean("discount_percent").alias("avg_discount"),
            F.col("quantity_sum").alias("total_quantity"),
        )
        .withColumn("revenue_per_unit", ratio("total_sales", "total_quantity"))
        .withColumn("discount_impact", percent_of("avg_unit_price", "avg_discount"))
    )


def _top_product_matrix(sales: DataFrame, k: int, regions: Sequence[str] | None) -> DataFrame:
    """Products ranked by their whole revenue, null regions included; cells of the
    known regions.

    The sales are summed to (product, region) once; ranking and spreading into
    columns happen on that small result, in one more grouping.
    """
    return spread_top_products(sales.groupBy("product", "region").agg(F.sum("total_amount").alias("total")), k, regions)


def spread_top_products(pairs: DataFrame, k: int, regions: Sequence[str] | None) -> DataFrame:
    """The matrix of :func:`_top_product_matrix` from revenue (``total``) per product and region.

    Result columns must be known when a plan is built, so a matrix whose columns are not named
    costs a job that finds the regions of the top products.  The pairs are kept for it and for the
    result, and only the regions' names reach the driver.
    """
    if regions:
        return _spread(pairs, k, regions)
    kept = Kept(pairs)
    return kept.until_gone(_spread(kept.frame, k, _regions_of_top(kept.frame, k)))


def _spread(pairs: DataFrame, k: int, regions: Sequence[str]) -> DataFrame:
    cells = [
        F.coalesce(
            F.sum(F.when(F.col("region") == name, F.col("total"))).cast("double"), F.lit(0.0)
        ).alias(name)
        for name in regions
    ]
    return (
        pairs.groupBy("product")
        .agg(
            F.sum("total").alias("_whole"),
            F.count("region").alias("_regions"),
            *cells,
        )
        .orderBy(*largest_first("_whole", "product"))
        .limit(k)
        .where(F.col("product").isNotNull() & (F.col("_regions") > 0))
        .select("product", *[F.col(f"`{name}`") for name in regions])
        .orderBy("product")
    )


def _regions_of_top(pairs: DataFrame, k: int) -> list[str]:
    """The regions that the ``k`` top products sold in; refuses more than Spark's own pivot does."""
    most = int(pairs.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    top = pairs.groupBy("product").agg(F.sum("total").alias("_whole")).orderBy(*largest_first("_whole", "product")).limit(k)
    own = pairs.where(F.col("region").isNotNull()).join(top.select("product"), "product", "left_semi")
    names = own.select("region").distinct().limit(most + 1).collect()
    if len(names) > most:
        raise ValueError(f"more than {most} values of region: name the matrix columns")
    return sorted(row["region"] for row in names)


def _by_known_product(sales: DataFrame, filters: dict):
    rows = filtered_sales(sales, **filters).where(F.col("product").isNotNull())
    return rows.groupBy("product")
