"""Data-quality profile of the wide rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelab.functions.numbers import instant, number
from quotelab.operators import prefix

# Columns whose gaps are reported.
IMPORTANT_COLUMNS = [
    "request_created_at_utc",
    "request_source",
    "event_date",
    "event_postal_code",
    "event_city",
    "event_venue_anonymous_key",
    "price_catalog_gross",
    "price_proposed",
    "target_signed",
    "outcome_class",
]
EMPTY_LABEL = "VIDE"


def _trainable(df: DataFrame) -> Column:
    return (
        (number(df, "target_price_training_eligible") == 1)
        & number(df, "target_signed").isin(0.0, 1.0)
        & number(df, "price_proposed").isNotNull()
    )


def profile(quotes: DataFrame, target_rows: int = prefix.TARGET_ROWS) -> DataFrame:
    """One row: shape, training set, price distribution and quality counts.

    The median is exact: it is selected by rank over counted values, not gathered in one task.
    """
    price, gross = number(quotes, "price_proposed"), number(quotes, "price_catalog_gross")
    target = number(quotes, "target_signed")
    trainable = F.coalesce(_trainable(quotes), F.lit(False))
    created = instant(quotes, "request_created_at_utc")
    training_price = F.when(trainable, price)
    middle = prefix.medians(quotes.select(training_price.alias("price")), ["price"], target_rows)

    # A zero catalogue price gives an infinite ratio, with the sign of the proposed price.
    share = F.try_divide(price, gross)
    by_zero = gross == 0
    too_low = F.when(by_zero, price < 0).otherwise(share < 0.5)
    too_high = F.when(by_zero, price > 0).otherwise(share > 1.5)

    rows = F.count("*")
    measures = {
        "rows": rows,
        "columns": F.lit(len(quotes.columns)).cast("long"),
        # Completed below; equal ids beyond the first, where all missing ones count as equal.
        "duplicate_event_ids": rows - F.max(F.when(F.col("request_event_id").isNull(), 1).otherwise(0))
        if "request_event_id" in quotes.columns
        else F.lit(0).cast("long"),
        "request_date_min": F.min(created),
        "request_date_max": F.max(created),
        "training_eligible_rows": F.count_if(trainable),
        "training_signed_rows": F.count_if(trainable & (target == 1)),
        "training_not_signed_rows": F.count_if(trainable & (target == 0)),
        "training_signature_rate": F.round(F.avg(F.when(trainable, target)), 4),
        "price_missing_count": F.count_if(price.isNull()),
        "price_minimum": F.min(training_price),
        "price_median": F.lit(middle.get("price")).cast("double"),
        "price_mean": F.round(F.avg(training_price), 2),
        "price_maximum": F.max(training_price),
        "negative_lead_time_rows": F.count_if(number(quotes, "event_lead_time_days") < 0),
        "nonpositive_proposed_price_rows": F.count_if(price <= 0),
        "nonpositive_catalog_price_rows": F.count_if(gross <= 0),
        "very_low_price_ratio_rows": F.count_if(too_low),
        "very_high_price_ratio_rows": F.count_if(too_high),
        "address_available_rows": F.count_if(number(quotes, "enrichment_address_available") == 1),
        "unique_venue_keys": F.lit(0).cast("long"),
    }
    result = quotes.agg(*[measure.alias(name) for name, measure in measures.items()])
    # Each column's distinct values are counted alone, so that they don't travel with all other sums.
    for name, column, sign in (
        ("duplicate_event_ids", "request_event_id", -1),
        ("unique_venue_keys", "event_venue_anonymous_key", 1),
    ):
        if column in quotes.columns:
            distinct = quotes.select(F.count_distinct(column).alias("_distinct"))
            result = result.crossJoin(distinct).withColumn(name, F.col(name) + sign * F.col("_distinct")).drop("_distinct")
    return result


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """Most frequent values of a column, gaps counted as ``VIDE``; equal counts by name."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(EMPTY_LABEL))
    return (
        df.groupBy(value.alias("value"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "value")
        .limit(n)
    )


def top_values_report(df: DataFrame, columns: list[str], n: int = 20) -> DataFrame:
    tops = [
        top_values(df, c, n).select(F.lit(c).alias("column"), "value", "count")
        for c in columns
        if c in df.columns
    ]
    return reduce(DataFrame.unionByName, tops)


def missingness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing cells per column, from one aggregate over the table."""
    present = [c for c in columns or IMPORTANT_COLUMNS if c in df.columns]
    counts = df.agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in present]
    )
    return counts.unpivot("rows", present, "column", "missing").select(
        "column",
        F.col("missing").alias("count"),
        F.round(F.try_divide(F.col("missing"), F.col("rows")), 4).alias("rate"),
    )
