"""All panels of the dashboard from one read of the filtered sales.

The filtered sales are summed once, to additive parts per (product, region, month), and in the
same pass to the sets of customers per region.  This result is kept (:class:`Kept`)
and every panel adds it up further, so no panel scans or joins the sales again.  A panel's
result equals that of its own operator in ``regions``, ``products`` and ``headline``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.dates import month_start
from ledgerloom.functions.distinct import BITS, SET_COLUMNS, merged_sets, ored, set_sizes, word_columns
from ledgerloom.functions.keep import Kept
from ledgerloom.functions.measures import ratio
from ledgerloom.functions.ordering import largest_first, smallest_first
from ledgerloom.functions.parts import (
    ROWS,
    merged,
    part_count_or_zero,
    part_mean,
    part_rounded_mean,
    part_total,
    part_total_or_zero,
)
from ledgerloom.operators.filters import filtered_sales
from ledgerloom.operators.headline import kpi_as_text
from ledgerloom.operators.products import spread_top_products
from ledgerloom.sources.schema import EXACT_TYPES

MEASURES = ("total_amount", "quantity", "unit_price", "discount_percent")
KEYS = ("product", "region", "month")
NEEDED = ("product", "region", "date", "customer_id", *MEASURES)

_IS_SET = "_is_set"
_CUSTOMERS = "customer_id_n"


def shared_parts(sales: DataFrame, **filters) -> DataFrame:
    """Parts per (product, region, month) and, in rows marked as such, customer sets per region.

    Each sale becomes two rows before they are grouped: one that carries the measures and one that
    carries the customer's bit.  So one scan, one grouping and one exchange make both.
    """
    rows = filtered_sales(sales, **filters)
    none = lambda kind: F.lit(None).cast(kind)
    words = word_columns("customer_id")
    kinds = dict(zip(words, ("bigint", "string", "bigint")))
    measured = {
        _IS_SET: F.lit(False),
        "product": F.col("product"),
        "region": F.col("region"),
        "month": month_start("date"),
        **{name: none(kind) for name, kind in kinds.items()},
        **{name: F.col(name) for name in MEASURES},
        "customer": F.when(F.col("customer_id").isNotNull(), 1),
    }
    in_set = {name: none(kind) for name, kind in (("product", "string"), ("month", "date"), ("customer", "int"))}
    in_set |= {_IS_SET: F.lit(True), "region": F.col("region"), **words, **{name: none(EXACT_TYPES[name]) for name in MEASURES}}
    both = F.array(*[F.struct(*[columns[name].alias(name) for name in measured]) for columns in (measured, in_set)])
    sums = [F.sum(name).alias(f"{name}_sum") for name in MEASURES] + [F.count(name).alias(f"{name}_n") for name in MEASURES]
    return (
        rows.select(F.inline(both))
        .where(~F.col(_IS_SET) | F.col(BITS).isNotNull())
        .groupBy(_IS_SET, *KEYS, *SET_COLUMNS)
        .agg(F.count("*").alias(ROWS), *sums, F.count("customer").alias(_CUSTOMERS), ored())
    )


class Dashboard:
    """The panels of one choice of filters.

    The shared parts are computed when the first panel is asked for and kept until :meth:`close` or the
    end of a ``with`` block.
    """

    def __init__(self, sales: DataFrame, **filters):
        self.kept = Kept(shared_parts(sales, **filters))
        shared = self.kept.frame
        sums = [c for c in shared.columns if c not in (_IS_SET, BITS, *SET_COLUMNS)]
        self.parts = shared.where(~F.col(_IS_SET)).select(*sums)
        self.customers = shared.where(_IS_SET).select("region", *SET_COLUMNS, BITS)

    def close(self) -> None:
        self.kept.release()

    def __enter__(self) -> Dashboard:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # --- panels, in the order of the page

    def kpi_values(self) -> DataFrame:
        whole = merged(self.parts.drop(*KEYS), [])
        customers = set_sizes(merged_sets(self.customers, []), [], "unique_customers")
        return whole.select(
            part_total_or_zero("total_amount").alias("total_sales"),
            F.coalesce(ROWS, F.lit(0)).cast("bigint").alias("total_transactions"),
            part_mean("total_amount").alias("avg_transaction"),
            customers.scalar().alias("unique_customers"),
        )

    def kpi_text(self) -> DataFrame:
        return kpi_as_text(self.kpi_values())

    def region_bar(self) -> DataFrame:
        return self._by_region(
            part_total_or_zero("total_amount").alias("total_amount"), F.col(_CUSTOMERS).alias("transaction_count")
        ).orderBy(*smallest_first("total_amount", "region"))

    def region_scatter(self) -> DataFrame:
        return (
            self._by_region(
                part_total_or_zero("total_amount").alias("total_sales"),
                part_mean("total_amount").alias("avg_transaction"),
                F.col("unique_customers"),
                part_count_or_zero("quantity").alias("total_quantity"),
                customers=True,
            )
            .withColumn("sales_per_customer", ratio("total_sales", "unique_customers"))
            .orderBy("region")
        )

    def region_timeline(self) -> DataFrame:
        months = merged(self.parts.where("region IS NOT NULL AND month IS NOT NULL").drop("product"), ["month", "region"])
        return months.select(
            F.col("month").alias("date"), "region", part_total_or_zero("total_amount").alias("total_amount")
        ).orderBy("date", "region")

    def top_products(self, k: int = 10) -> DataFrame:
        found = self._by_product(part_total_or_zero("total_amount").alias("total_amount"))
        return found.orderBy(*largest_first("total_amount", "product")).limit(k)

    def product_profitability(self, k: int = 15) -> DataFrame:
        return (
            self._by_product(
                part_total_or_zero("total_amount").alias("total_amount"),
                part_count_or_zero("quantity").alias("quantity"),
                part_mean("unit_price").alias("unit_price"),
                part_mean("discount_percent").alias("discount_percent"),
            )
            .withColumn("revenue_per_unit", ratio("total_amount", "quantity"))
            .orderBy(*largest_first("revenue_per_unit", "product"))
            .limit(k)
        )

    def product_region_matrix(self, k: int = 15, regions_shown: Sequence[str] | None = None) -> DataFrame:
        zero = F.lit(0).cast(EXACT_TYPES["total_amount"])
        pairs = self.parts.where("product IS NOT NULL").groupBy("product", "region")
        return spread_top_products(pairs.agg(F.sum(F.coalesce("total_amount_sum", zero)).alias("total")), k, regions_shown)

    def region_table(self) -> DataFrame:
        return self._by_region(
            part_total_or_zero("total_amount").alias("total_sales"),
            part_rounded_mean("total_amount").alias("avg_transaction"),
            part_count_or_zero("quantity").alias("total_quantity"),
            F.col(_CUSTOMERS).alias("total_transactions"),
            F.col("unique_customers"),
            part_rounded_mean("discount_percent").alias("avg_discount"),
            customers=True,
        ).orderBy("region")

    def product_table(self, k: int = 20) -> DataFrame:
        return (
            self._by_product(
                part_total_or_zero("total_amount").alias("total_sales"),
                part_count_or_zero("quantity").alias("total_quantity"),
                part_rounded_mean("unit_price").alias("avg_unit_price"),
                part_rounded_mean("discount_percent").alias("avg_discount"),
                F.col(_CUSTOMERS).alias("total_transactions"),
            )
            .orderBy(*largest_first("total_sales", "product"))
            .limit(k)
        )

    # --- shared steps

    def _by_region(self, *columns: Column, customers: bool = False) -> DataFrame:
        found = merged(self.parts.where("region IS NOT NULL").drop("product", "month"), ["region"])
        if customers:
            sizes = set_sizes(self.customers, ["region"], "unique_customers")
            found = found.join(sizes, "region", "left").withColumn("unique_customers", F.coalesce("unique_customers", F.lit(0)))
        return found.select("region", *columns)

    def _by_product(self, *columns: Column) -> DataFrame:
        return merged(self.parts.where("product IS NOT NULL").drop("region", "month"), ["product"]).select("product", *columns)


def dashboard(sales: DataFrame, **filters) -> Dashboard:
    """The dashboard of the sales that pass the filters (those of ``filtered_sales``)."""
    return Dashboard(sales, **filters)


def panel_values(panels: Dashboard, regions_shown: Sequence[str] | None = None) -> DataFrame:
    """All ten panels as one frame: panel, date, region, product, measure, and the value as a number or
    as text.  The shared parts are kept for as long as the frame is referenced."""
    frames = {
        "kpi_values": panels.kpi_values(),
        "kpi_text": panels.kpi_text(),
        "region_bar": panels.region_bar(),
        "region_scatter": panels.region_scatter(),
        "region_timeline": panels.region_timeline(),
        "top_products": panels.top_products(),
        "product_profitability": panels.product_profitability(),
        "product_region_matrix": panels.product_region_matrix(regions_shown=regions_shown),
        "region_table": panels.region_table(),
        "product_table": panels.product_table(),
    }
    labels = {"date": "date", "region": "string", "product": "string"}
    out = None
    for name, frame in frames.items():
        measures = [c for c in frame.columns if c not in labels]
        text = frame.schema[measures[0]].dataType.simpleString() == "string"
        of = lambda c, kind, real: (F.col(f"`{c}`") if real else F.lit(None)).cast(kind)
        cells = [F.struct(F.lit(c).alias("measure"), of(c, "double", not text).alias("value"), of(c, "string", text).alias("text")) for c in measures]
        known = [(F.col(c) if c in frame.columns else F.lit(None)).cast(kind).alias(c) for c, kind in labels.items()]
        rows = frame.select(F.lit(name).alias("panel"), *known, F.inline(F.array(*cells)))
        out = rows if out is None else out.unionByName(rows)
    return panels.kept.until_gone(out)
