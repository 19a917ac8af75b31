"""KPI tables over the reporting table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.period import month_start
from usagelens.functions.rules import replace_values
from usagelens.functions.text import snake_case
from usagelens.operators.counts import distinct_users, group_count, row_total
from usagelens.operators.filters import in_days, with_fewer_nulls
from usagelens.operators.joins import keyed_join
from usagelens.operators.reshape import marker_matrix
from usagelens.operators.windows import with_group_stats
from usagelens.plans.base import DATES, PRODUCTS, reporting_table
from usagelens.settings import KpiSettings
from usagelens.sources.workspace import cut_lineage


def used_products(table: DataFrame) -> DataFrame:
    """One row per present product cell. The cell's column stays, so equal names do not merge."""
    ids = [c for c in table.columns if c not in PRODUCTS]
    return table.unpivot(ids, PRODUCTS, "product_column", "product").where(F.col("product").isNotNull())


def _in_units(table: DataFrame) -> DataFrame:
    return used_products(table).where(F.col("parent_organization").isNotNull()).withColumnRenamed(
        "parent_organization", "unit"
    )


def users_by_product(table: DataFrame) -> DataFrame:
    """Rows per product, and the distinct users behind them."""
    return (
        used_products(table)
        .groupBy("product_column", "product")
        .agg(F.count(F.lit(1)).alias("total_users"), F.count_distinct("email").alias("distinct_users"))
        .drop("product_column")
    )


def users_by_product_and_unit(table: DataFrame) -> DataFrame:
    return (
        _in_units(table)
        .groupBy("product_column", "product", "unit")
        .agg(F.count(F.lit(1)).alias("total_users"), F.count_distinct("email").alias("distinct_users"))
        .drop("product_column")
    )


def users_by_unit(table: DataFrame) -> DataFrame:
    """``total_users`` adds up products, so a person with two counts twice; ``distinct_users`` does not."""
    return (
        _in_units(table)
        .groupBy("unit")
        .agg(F.count(F.lit(1)).alias("total_users"), F.count_distinct("email").alias("distinct_users"))
    )


def products_by_unit(table: DataFrame) -> DataFrame:
    cells = _in_units(table).select("product_column", "product", "unit").distinct()
    return group_count(cells, "unit", name="total_products")


def products_by_unit_wide(
    table: DataFrame, products: Sequence[str], values: Sequence[str] | None = None
) -> DataFrame:
    """Unit by product, 1 where used. ``total`` adds the columns of ``products`` only.

    ``values`` are all product columns to show, by default those found in the table.
    """
    return _named_matrix(marker_matrix(_in_units(table), "unit", "product", values), products)


def _named_matrix(matrix: DataFrame, products: Sequence[str]) -> DataFrame:
    absent = {p: F.lit(None).cast("int") for p in products if p not in matrix.columns}
    named = matrix.withColumns(absent) if absent else matrix
    named = named.toDF(*["unit"] + [snake_case(c) for c in named.columns[1:]])
    return row_total(named, [snake_case(p) for p in products])


def units_per_product(table: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Number of units that use each product, with products relabelled by ``labels``."""
    counts = _in_units(table).groupBy("product").agg(F.count_distinct("unit").alias("n_units"))
    return counts.withColumn("product", replace_values(F.col("product"), labels or {}))


#: Levels of ``monthly_cells``, and the columns that each groups by.
LEVELS = {
    "product": ("product_column", "product"), "product_unit": ("product_column", "product", "unit"), "unit": ("unit",), "total": (),
}


def monthly_cells(table: DataFrame) -> DataFrame:
    """All user counts of a month from one scan: ``level, product_column, product, unit, total_users, distinct_users``.

    Levels are products, products by unit, units and the total, from one expand and aggregate.
    A row without unit counts under its product and in the total, not in units.
    """
    used = used_products(table).withColumnRenamed("parent_organization", "unit")
    columns = ["product_column", "product", "unit"]
    sets = [[F.col(c) for c in level] for level in LEVELS.values()]
    grouped = used.groupingSets(sets, *columns).agg(
        F.grouping_id(*columns).alias("__set"), F.count(F.lit(1)).alias("total_users"), F.count_distinct("email").alias("distinct_users"),
    )
    # A bit is set for each column that a level does not group by, the last column lowest.
    codes = {sum((c not in level) << (len(columns) - 1 - i) for i, c in enumerate(columns)): name for name, level in LEVELS.items()}
    level = F.coalesce(*[F.when(F.col("__set") == code, name) for code, name in codes.items()])
    cells = grouped.withColumn("level", level).drop("__set")
    return cells.where(F.col("unit").isNotNull() | ~F.col("level").isin("product_unit", "unit")).select("level", *columns, "total_users", "distinct_users")


def reports_of_cells(cells: DataFrame, settings: KpiSettings, values: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The five tables of a month from its cells, of which there are no more than products and units allow."""
    at = {name: cells.where(F.col("level") == name).drop("level") for name in LEVELS}
    by_both = at["product_unit"]
    matrix = _named_matrix(marker_matrix(by_both, "unit", "product", values), settings.matrix_products)
    return {
        "user_counts_by_product": at["product"].select("product", "total_users", "distinct_users"),
        "user_counts_by_product_unit": by_both.select("product", "unit", "total_users", "distinct_users"),
        "users_by_unit": at["unit"].select("unit", "total_users", "distinct_users"),
        "products_by_unit": group_count(by_both, "unit", name="total_products"),
        "products_by_unit_wide": matrix,
    }


def unit_first_month(base: DataFrame) -> DataFrame:
    """Month in which the first account of each unit was created."""
    spans = base.groupBy(F.col("parent_organization").alias("unit")).agg(
        F.max("sf_created").alias("last_created"), F.min("sf_created").alias("first_created")
    )
    return spans.where(F.col("first_created").isNotNull()).select(
        "unit", F.month("first_created").alias("first_month"), F.year("first_created").alias("first_year")
    )


def month_activity(base: DataFrame) -> DataFrame:
    """Activity at month grain: rows with any login, dates floored to their month."""
    active = with_fewer_nulls(base, DATES, limit=len(DATES)).drop("num_na")
    months = active.withColumns({c.replace("last_login", "login_month"): month_start(F.col(c)) for c in DATES})
    return months.drop(*DATES).distinct()


def active_users_in_window(base: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Distinct users per product with a login from ``first`` to ``last``."""
    return distinct_users(in_days(base, "sf_last_login", first, last), "email", ["sf_product"], name="users")


def user_product_table(base: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Row counts per user and product of all three sources; the window limits the first only.

    One pass: the three product columns become rows before they are counted.
    """
    day = F.col("sf_last_login")
    recent = (day >= F.lit(first)) & (day < F.lit(last + dt.timedelta(days=1)))
    cells = base.select("email", recent.alias("recent"), *PRODUCTS).unpivot(
        ["email", "recent"], PRODUCTS, "product_column", "product"
    )
    counted = cells.where((F.col("product_column") != "sf_product") | F.col("recent"))
    return group_count(counted, "email", "product_column", "product", name="total").drop("product_column")


def enrich(per_user: DataFrame, table: DataFrame, drop: Sequence[str] = ("total",)) -> DataFrame:
    """Attach the user's rows of ``table`` to each product row. Spark splits the product rows of a skewed email, and repeats the email's rows of ``table`` for each part."""
    return keyed_join(per_user, table, "email", "left").drop(*drop)


def product_share(base: DataFrame) -> DataFrame:
    """Each user's share in the users of a product."""
    pairs = base.where(F.col("sf_product").isNotNull()).groupBy("sf_product", "email").agg(
        F.count_distinct("sf_product").alias("n")
    )
    shared = with_group_stats(cut_lineage(pairs), ["sf_product"], group_n=F.sum("n"))
    return shared.withColumn("share", F.col("n") / F.col("group_n")).drop("group_n")


def mapping_stats(mapping: DataFrame) -> DataFrame:
    """The mapping with its product's number of counted permissions and their sum."""
    return with_group_stats(
        mapping, ["product"],
        occurrence=F.count("n"), total=F.coalesce(F.sum("n"), F.lit(0)), group_size=F.count(F.lit(1)),
    )


def department_breakdown(base: DataFrame, product: str) -> DataFrame:
    return group_count(base.where(F.col("sf_product") == product), "primary_department", "sf_profile")


def monthly_report(base: DataFrame, settings: KpiSettings) -> dict[str, DataFrame]:
    """The five tables of a monthly run from one scan of the base."""
    return reports_of_cells(cut_lineage(monthly_cells(reporting_table(base))), settings)
