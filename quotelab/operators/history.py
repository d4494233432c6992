"""What was known strictly before each request: client history, stock and bookings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelab.operators import prefix
from quotelab.session import materialize

# Request column -> stock code.
PRODUCT_CODES = {
    "product_photobooth": "PHOTOBOOTH",
    "product_miroirbooth": "MIROIRBOOTH",
    "product_videobooth": "BOOTH_360",
    "product_voguebooth": "VOGUEBOOTH",
    "product_ipadbooth": "IPADBOOTH",
    "product_airbooth": "AIRBOOTH",
}


def with_prior_history(
    events: DataFrame,
    client: str = "client_id",
    created: str = "created_at",
    signed: str = "signer_at",
    target_rows: int = prefix.TARGET_ROWS,
) -> DataFrame:
    """Add prior_request_count, prior_signed_count and prior_last_request_at to every event.

    An earlier request counts when it was created strictly before this one; its signature counts
    when it was signed strictly before too, that is when max(created, signed) lies before.  Both
    kinds of facts become points on one time line per client; the point of a request carries its
    event, so running sums over the line give each event its history, without self-join or join
    back.  A client owning a large share of all rows is cut in time blocks (see ``prefix``).  Events
    without client or time have no history and are spread over lines of their own.
    """
    row = F.struct(*[F.col(c) for c in events.columns])
    placed = F.col(client).isNotNull() & F.col(created).isNotNull()
    lines = events.select(
        F.when(placed, F.col(client)).alias("_client"),
        F.when(placed, F.lit(None)).otherwise(F.monotonically_increasing_id() % 4096).alias("_spread"),
        F.unix_micros(created).alias("_at"),
        F.unix_micros(F.when(placed & F.col(signed).isNotNull(), F.greatest(created, signed))).alias("_signed_at"),
        row.alias("_event"),
    )
    kind = lines.schema["_event"].dataType
    request = F.struct(
        F.col("_at").alias("at"), F.lit(1).alias("requests"), F.lit(0).alias("signatures"), F.col("_event").alias("event")
    )
    signature = F.struct(
        F.col("_signed_at").alias("at"), F.lit(0).alias("requests"), F.lit(1).alias("signatures"), F.lit(None).cast(kind).alias("event")
    )
    facts = F.when(F.col("_signed_at").isNotNull(), F.array(request, signature)).otherwise(F.array(request))
    points = lines.select("_client", "_spread", F.inline(facts)).withColumn(
        "request_at", F.when(F.col("requests") > 0, F.col("at"))
    )
    before = prefix.running(
        points,
        ["_client", "_spread"],
        "at",
        sums={"requests_before": "requests", "signatures_before": "signatures"},
        latest={"last_at": "request_at"},
        blocks=prefix.block_count(events, target_rows),
        ties=True,
        target_rows=target_rows,
    ).where("requests > 0")
    known = F.col("_client").isNotNull()
    return before.select(
        "event.*",
        F.when(known, F.col("requests_before")).otherwise(0).cast("long").alias("prior_request_count"),
        F.when(known, F.col("signatures_before")).otherwise(0).cast("long").alias("prior_signed_count"),
        F.when(known, F.timestamp_micros("last_at")).alias("prior_last_request_at"),
    )


def client_times(
    events: DataFrame,
    client: str = "client_id",
    created: str = "created_at",
    signed: str = "signer_at",
    target_rows: int = prefix.TARGET_ROWS,
) -> DataFrame:
    """One row per client and creation time (``_client``, ``_at`` in microseconds) with the history before it.

    The same counts as ``with_prior_history``, for callers that join wide rows by client anyway: only
    client and times travel through the time lines.  Requests without time share one row with no
    history; those without client have none.
    """
    at, signed_at = F.unix_micros(created), F.unix_micros(F.greatest(created, signed))
    lines = materialize(
        events.where(F.col(client).isNotNull()).select(
            F.col(client).alias("_client"), at.alias("_at"), F.when(at.isNotNull() & F.col(signed).isNotNull(), signed_at).alias("_signed_at")
        ),
        "lines",
    )
    request = F.struct(F.col("_at").alias("at"), F.lit(1).alias("requests"), F.lit(0).alias("signatures"))
    signature = F.struct(F.col("_signed_at").alias("at"), F.lit(0).alias("requests"), F.lit(1).alias("signatures"))
    facts = F.when(F.col("_signed_at").isNotNull(), F.array(request, signature)).otherwise(F.array(request))
    points = lines.where("_at IS NOT NULL").select("_client", F.inline(facts)).withColumn(
        "request_at", F.when(F.col("requests") > 0, F.col("at"))
    )
    before = prefix.running(
        points,
        ["_client"],
        "at",
        sums={"requests_before": "requests", "signatures_before": "signatures"},
        latest={"last_at": "request_at"},
        blocks=prefix.block_count(lines, target_rows),
        ties=True,
        target_rows=target_rows,
    ).where("requests > 0")
    timed = before.select(
        "_client",
        F.col("at").alias("_at"),
        F.col("requests_before").cast("long").alias("prior_request_count"),
        F.col("signatures_before").cast("long").alias("prior_signed_count"),
        F.timestamp_micros("last_at").alias("prior_last_request_at"),
    ).dropDuplicates(["_client", "_at"])
    nothing = F.lit(0).cast("long")
    untimed = lines.where("_at IS NULL").select("_client").distinct().select(
        "_client", F.lit(None).cast("long").alias("_at"), nothing.alias("prior_request_count"),
        nothing.alias("prior_signed_count"), F.lit(None).cast("timestamp").alias("prior_last_request_at"),
    )
    return timed.unionByName(untimed)


def prior_history(events: DataFrame, **options) -> DataFrame:
    """One row per event id with its strictly-prior client history."""
    names = {"client": "client_id", "created": "created_at", "signed": "signer_at"}
    needed = ["id", *[options.get(k, v) for k, v in names.items()]]
    return with_prior_history(events.select(*needed), **options).select(
        F.col("id").alias("event_id"),
        "prior_request_count",
        "prior_signed_count",
        "prior_last_request_at",
    )


def stock_as_of(
    quotes: DataFrame, stock: dict[str, int], target_rows: int = prefix.TARGET_ROWS
) -> DataFrame:
    """Free machines and confirmed bookings on each quote's event date when the quote was created.

    A booking is confirmed from its signature on (``signed_at_utc``); unsigned quotes never block a
    machine.  ``stock`` gives the machines owned per code; a code without stock stays unknown.
    Added: bookings_on_date, date_requested_product_bookings, date_utilization_ratio (booked
    machines over owned machines, our definition), available_requested_product_ratio (requested
    products with enough free machines over requested products, our definition) and
    available_products (free machines per code).
    """
    quantity = {c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in PRODUCT_CODES}
    bookings = (
        quotes.where(F.col("signed_at_utc").isNotNull() & F.col("event_date").isNotNull())
        .select(
            F.col("event_date").alias("_date"),
            F.unix_micros("signed_at_utc").alias("at"),
            F.lit(1).alias("bookings"),
            F.lit(0).alias("asked"),
            *[q.alias(c) for c, q in quantity.items()],
        )
    )
    asked = quotes.where(
        F.col("event_date").isNotNull() & F.col("request_created_at_utc").isNotNull()
    ).select(
        F.col("event_date").alias("_date"),
        F.unix_micros("request_created_at_utc").alias("at"),
        F.lit(0).alias("bookings"),
        F.lit(1).alias("asked"),
        *[F.lit(0).cast("long").alias(c) for c in PRODUCT_CODES],
    )
    points = (
        bookings.unionByName(asked)
        .groupBy("_date", "at")
        .agg(
            F.sum("bookings").alias("bookings"),
            F.max("asked").alias("asked"),
            *[F.sum(c).alias(c) for c in PRODUCT_CODES],
        )
    )
    booked = {c: f"booked_{c}" for c in PRODUCT_CODES}
    before = (
        prefix.running(
            points,
            ["_date"],
            "at",
            sums={"bookings_on_date": "bookings"} | {b: c for c, b in booked.items()},
            blocks=prefix.block_count(quotes, target_rows),
            target_rows=target_rows,
        )
        .where(F.col("asked") > 0)
        .select("_date", F.timestamp_micros("at").alias("_at"), "bookings_on_date", *booked.values())
    )
    joined = quotes.join(
        before,
        (F.col("event_date") == F.col("_date")) & (F.col("request_created_at_utc") == F.col("_at")),
        "left",
    )

    def add(terms: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, terms, F.lit(0))

    owned = {c: stock[code] for c, code in PRODUCT_CODES.items() if code in stock}
    taken = {c: F.coalesce(F.col(b), F.lit(0)) for c, b in booked.items()}
    free = {c: F.greatest(F.lit(n) - taken[c], F.lit(0)).cast("int") for c, n in owned.items()}
    wanted = {c: q > 0 for c, q in quantity.items()}
    enough = [F.when(wanted[c] & (free[c] >= quantity[c]), 1).otherwise(0) for c in owned]
    requested = add([F.when(w, 1).otherwise(0) for w in wanted.values()])
    machines = sum(owned.values())
    entries = [part for c, value in free.items() for part in (F.lit(PRODUCT_CODES[c]), value)]
    return joined.withColumns(
        {
            "bookings_on_date": F.coalesce("bookings_on_date", F.lit(0).cast("long")),
            "date_requested_product_bookings": add(
                [F.when(wanted[c], taken[c]).otherwise(0) for c in PRODUCT_CODES]
            ).cast("long"),
            "date_utilization_ratio": F.try_divide(
                add([taken[c] for c in owned]).cast("double"), F.lit(float(machines))
            ),
            "available_requested_product_ratio": F.try_divide(
                add(enough).cast("double"), requested.cast("double")
            ),
            "available_products": F.create_map(*entries)
            if entries
            else F.lit(None).cast("map<string,int>"),
        }
    ).drop("_date", "_at", *booked.values())
