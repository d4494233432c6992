"""Stock availability, date strategy and date-filling prices around the price choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelab.config import Config
from quotelab.functions.numbers import evaluated, number, number_or, text, whole
from quotelab.operators.history import PRODUCT_CODES
from quotelab.operators.ladder import (
    Scorer,
    _best,
    candidates_of,
    choose,
    recommendation_columns,
)

# Objectives, busy statuses and review texts.
OBJECTIVES = ["fill_date", "balanced", "maximize_expected_margin"]
BUSY_STATUSES = ["busy", "nearly_full", "full"]
UNAVAILABLE_REVIEW = (
    "Au moins un produit demandé est indisponible à cette date. "
    "Proposer un produit disponible ou une autre date avant de calculer le prix."
)
FILL_REVIEW = (
    "Date vide ou prioritaire : le prix favorise la signature sans "
    "descendre sous {margin:.0f} € de marge directe."
)
UNPROVEN_CEILING = 1.10
UNAVAILABLE = "PRODUCT_UNAVAILABLE"

AVAILABILITY = [
    "availability_status",
    "requested_products_available",
    "available_products",
    "requested_products",
    "unavailable_requested_products",
    "alternative_products",
]
STRATEGY = [
    "pricing_objective",
    "objective_source",
    "date_booking_status",
    "bookings_on_date",
    "days_before_event",
    "fill_date_mode",
]


def _stock_of(stock: Column, field: str, code: str) -> Column:
    """Free machines under the first spelling present in the map; a bad value counts as none."""
    short = field.removeprefix("product_")
    spellings = dict.fromkeys([code, code.lower(), field, short, short.upper()])
    found = F.lit(None).cast("int")
    for name in reversed(spellings):
        value = whole(F.try_element_at(stock, F.lit(name)).try_cast("double"))
        present = F.map_contains_key(stock, name)
        found = F.when(present, F.greatest(value, F.lit(0))).otherwise(found)
    return found


def _with_entries(requests: DataFrame) -> DataFrame:
    """Add ``_entries``: requested and free quantity of every product, NULL without a stock map."""
    if "available_products" in requests.columns:
        stock = F.col("available_products")
    else:
        stock = F.lit(None).cast("map<string,int>")
    entries = F.array(
        *[
            F.struct(
                F.lit(code).alias("code"),
                F.ceil(F.greatest(number_or(requests, field), F.lit(0.0))).cast("int").alias(
                    "requested_quantity"
                ),
                _stock_of(stock, field, code).alias("available_quantity"),
            )
            for field, code in PRODUCT_CODES.items()
        ]
    )
    return evaluated(requests, {"_entries": F.when(stock.isNotNull(), entries)})


def _availability_columns() -> dict[str, Column]:
    known = F.col("_entries").isNotNull()
    asked = F.filter("_entries", lambda e: e["requested_quantity"] > 0)
    lacking = F.filter(
        asked,
        lambda e: e["available_quantity"].isNull()
        | (e["available_quantity"] < e["requested_quantity"]),
    )
    counted = F.filter("_entries", lambda e: e["available_quantity"].isNotNull())
    spare = F.filter(
        "_entries", lambda e: (e["available_quantity"] > 0) & (e["requested_quantity"] == 0)
    )
    product = "array<struct<code:string,requested_quantity:int,available_quantity:int>>"
    offer = "array<struct<code:string,available_quantity:int>>"

    def or_empty(value: Column, kind: str) -> Column:
        return F.coalesce(value, F.array().cast(kind))

    def pair(e: Column) -> Column:
        return F.struct(e["code"].alias("code"), e["available_quantity"].alias("available_quantity"))

    return {
        "availability_status": F.when(known, "KNOWN").otherwise("UNKNOWN"),
        "requested_products_available": F.when(known, F.size(lacking) == 0),
        "available_products": F.coalesce(
            F.map_from_entries(F.transform(counted, pair)), F.create_map().cast("map<string,int>")
        ),
        "requested_products": or_empty(asked, product),
        "unavailable_requested_products": or_empty(lacking, product),
        "alternative_products": or_empty(F.transform(spare, pair), offer),
    }


def availability(requests: DataFrame) -> DataFrame:
    """Compare requested quantities with the free stock of the date; row-local.

    Without a stock map everything is unknown and pricing goes on.
    """
    return _with_entries(requests).withColumns(_availability_columns()).drop("_entries")


def _local_day(df: DataFrame, name: str) -> Column:
    """Calendar day as written, before any conversion to UTC."""
    if name not in df.columns:
        return F.lit(None).cast("date")
    if isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.to_date(name)
    written = F.trim(F.col(name))
    dashed = F.when(written.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(written, 1, 10))
    compact = F.when(
        written.rlike(r"^\d{8}([T ]|$)"),
        F.regexp_replace(written, r"^(\d{4})(\d{2})(\d{2}).*$", "$1-$2-$3"),
    )
    return F.coalesce(dashed, compact).try_cast("date")


def days_before_event(requests: DataFrame, as_of=None) -> Column:
    """Whole days left, never negative: given, else lead time, else from the dates as written."""
    given = F.lit(None).cast("int")
    for name in ("event_lead_time_days", "days_before_event"):
        if name in requests.columns:
            given = F.when(
                F.col(name).isNotNull(), F.greatest(whole(number(requests, name)), F.lit(0))
            ).otherwise(given)
    event = _local_day(requests, "event_date")
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    # The first date that is given counts, readable or not.
    start = today
    for name in ("request_date", "request_created_at_utc"):
        is_given = F.coalesce(text(requests, name) != "", F.lit(False))
        start = F.when(is_given, F.coalesce(_local_day(requests, name), today)).otherwise(start)
    return F.coalesce(given, F.when(event.isNotNull(), F.greatest(F.datediff(event, start), F.lit(0))))


def _strategy_columns(requests: DataFrame, config: Config, as_of) -> dict[str, Column]:
    explicit = F.lower(F.trim(F.coalesce(text(requests, "commercial_priority"), F.lit(""))))
    raw = text(requests, "bookings_on_date")
    bookings = F.greatest(whole(number(requests, "bookings_on_date")), F.lit(0))
    written = F.lower(F.trim(F.coalesce(text(requests, "date_booking_status"), F.lit(""))))
    status = (
        F.when(written != "", written)
        .when(raw.isNull(), "unknown")
        .when(bookings == 0, "empty")
        .otherwise("occupied")
    )
    is_explicit = explicit.isin(OBJECTIVES)
    empty = (status == "empty") | (raw.isNotNull() & (bookings == 0))
    days = days_before_event(requests, as_of)
    soon = days.isNull() | (days <= config.fill_date_horizon_days)
    objective = (
        F.when(is_explicit, explicit)
        .when(empty & soon, "fill_date")
        .when(status.isin(BUSY_STATUSES), "maximize_expected_margin")
        .otherwise("balanced")
    )
    return {
        "pricing_objective": objective,
        "objective_source": F.when(is_explicit, "explicit").otherwise("automatic"),
        "date_booking_status": status,
        "bookings_on_date": bookings,
        "days_before_event": days,
        "fill_date_mode": objective == "fill_date",
    }


def strategy(requests: DataFrame, config: Config = Config(), as_of=None) -> DataFrame:
    """Objective per request: an explicit valid one, else from bookings and days left; row-local."""
    return requests.withColumns(_strategy_columns(requests, config, as_of))


def fill_date_choice(chosen: DataFrame, config: Config = Config()) -> DataFrame:
    """Add ``fill_candidate``: the likeliest price that keeps every floor, NULL when none does."""
    gross = F.col("gross_eur")
    unproven = ~F.col("price_signal_reliable") & (gross > 0)
    eligible = F.filter(
        "tested_candidates",
        lambda c: (c["signature_probability"] >= config.minimum_acceptance_probability)
        & (c["direct_margin_eur"] >= config.minimum_direct_margin_eur)
        & ~(unproven & (c["price_eur"] > gross * UNPROVEN_CEILING)),
    )
    likeliest = _best(
        eligible,
        lambda c: c["signature_probability"],
        lambda c: c["expected_direct_margin_eur"],
        lambda c: -c["price_eur"],
    )
    return chosen.withColumn("fill_candidate", likeliest)


def apply_fill_date(chosen: DataFrame, config: Config = Config()) -> DataFrame:
    """Replace the selected candidate in fill mode and say so in the review reason."""
    df = fill_date_choice(chosen, config)
    use = F.col("fill_date_mode") & F.col("all_constraints_satisfied") & F.col(
        "fill_candidate"
    ).isNotNull()
    reason = F.concat_ws(
        " ",
        F.nullif(F.trim("review_reason"), F.lit("")),
        F.lit(FILL_REVIEW.format(margin=config.minimum_direct_margin_eur)),
    )
    return df.withColumns(
        {
            "selected": F.when(use, F.col("fill_candidate")).otherwise(F.col("selected")),
            "review_reason": F.when(use, reason).otherwise(F.col("review_reason")),
        }
    ).drop("fill_candidate")


def recommend_with_stock(
    requests: DataFrame,
    catalogue: DataFrame,
    scorer: Scorer,
    config: Config = Config(),
    key: str = "request_id",
    as_of=None,
    model_name: str = "logistic_regression",
    price_model_name: str = "logistic_regression",
) -> DataFrame:
    """Availability first, then the date strategy, then a price for what is available; one row per request.

    ``recommendation_status`` is OK, PRODUCT_UNAVAILABLE, or why a request can't be priced.  Requests that
    cannot be served get no candidates.
    """
    # Results get their own names: features keep reading the request columns as they were given.
    context = [*STRATEGY, *AVAILABILITY]
    carried = [f"_{c}" for c in context]
    columns = _strategy_columns(requests, config, as_of) | _availability_columns()
    assessed = (
        evaluated(_with_entries(requests), {f"_{name}": column for name, column in columns.items()})
        .withColumn("_event_day", text(requests, "event_date"))
        .drop("_entries")
    )
    missing = F.coalesce(~F.col("_requested_products_available"), F.lit(False))
    refused = {
        "price_status": F.when(missing, UNAVAILABLE),
        "price_error": F.when(missing, UNAVAILABLE_REVIEW),
    }
    carry = ["cost_details", "price_status", "price_error", "_event_day", *carried]
    candidates = candidates_of(
        assessed, catalogue, scorer, config, key, carry, as_of, every_request=True, refused=refused
    )
    chosen = choose(candidates, config, key, carry).withColumn(
        "fill_date_mode", F.col("_fill_date_mode")
    )
    served = F.col("price_status") != UNAVAILABLE
    columns = recommendation_columns(config, model_name, price_model_name)
    always = ("requires_human_review", "review_reason")
    return apply_fill_date(chosen, config).select(
        key,
        F.col("price_status").alias("recommendation_status"),
        F.col("_event_day").alias("event_date"),
        *[(c if name in always else F.when(served, c)).alias(name) for name, c in columns.items()],
        *[F.col(f"_{c}").alias(c) for c in context],
        F.when(served, F.col("cost_details")).alias("cost_details"),
        "tested_candidates",
    )
