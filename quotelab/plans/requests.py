"""Requests, stock and a fixed scorer derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Machines owned per code.
STOCK = {"PHOTOBOOTH": 6, "MIROIRBOOTH": 3, "BOOTH_360": 3, "VOGUEBOOTH": 2, "IPADBOOTH": 1}


def as_requests(quotes: DataFrame) -> DataFrame:
    """Quotes seen as open requests: past prices give way to request-only settings."""
    request = F.col("request_event_id")

    def every(n: int, rest: int, value) -> Column:
        return F.when(request % n == rest, value)

    past = [c for c in quotes.columns if c.startswith(("target_", "outcome_", "signed_"))]
    raw = [c for c in quotes.columns if c.endswith("_raw")]
    money = [c for c in quotes.columns if c.startswith("price_")]
    stock = F.create_map(
        F.lit("PHOTOBOOTH"), (request % 4).cast("int"),
        F.lit("miroirbooth"), (request % 3).cast("int"),
        F.lit("product_videobooth"), F.lit(1),
        F.lit("VOGUEBOOTH"), (request % 2).cast("int"),
    )
    return (
        quotes.drop(*past, *raw)
        .withColumns({c: F.col(c).cast("double") for c in money})
        .withColumn("price_catalog_gross", F.when(request % 19 != 5, F.col("price_catalog_gross")))
        .withColumns(
            {
                "request_id": request,
                "catalogue_code": every(97, 3, "PACK_PRESTIGE").when(request % 97 == 4, "PACK_DUO")
                .when(request % 97 == 5, "ABSENT"),
                "direct_cost_eur": every(11, 2, (request % 500).cast("double")),
                "minimum_price_eur": every(13, 4, 700.0),
                "maximum_price_eur": every(17, 6, 900.0),
                "commercial_priority": every(23, 1, " Fill_Date ").when(request % 23 == 2, "other"),
                "bookings_on_date": F.when(request % 3 != 0, (request % 5).cast("int")),
                "date_booking_status": every(29, 3, "full").when(request % 29 == 4, "Empty"),
                "available_products": F.when(request % 4 != 1, stock),
            }
        )
    )


def fixed_scorer(candidates: DataFrame) -> DataFrame:
    """Signature probability from fixed coefficients, so that any engine can repeat it.

    A small term depends on the hundreds of the price, so the raw curve is not monotone.
    """
    logit = (
        F.lit(3.4)
        - 3.1 * F.coalesce(F.col("price_proposed_to_gross_ratio"), F.lit(1.0))
        + 0.4 * F.col("prior_signature_rate")
        + 0.3 * F.col("request_is_business")
        - 0.001 * F.coalesce(F.col("event_lead_time_days").cast("double"), F.lit(0.0))
        + 0.3 * F.pmod(F.floor(F.col("price_proposed") / 100), F.lit(3))
    )
    return candidates.withColumn("raw_probability", 1 / (1 + F.exp(-logit)))
