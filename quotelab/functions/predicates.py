"""Signed / refused / expired rules, written once and shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# CRM statuses.
SIGNED_STATUSES = ["Acompte OK", "Presta FINI", "Post Presta", "Sent Media"]
REFUSED_STATUS = "Refused"


def is_signed() -> Column:
    """Signature date, validated price, or a status reached only after signing."""
    by_status = F.coalesce(F.col("status").isin(SIGNED_STATUSES), F.lit(False))
    return F.col("signer_at").isNotNull() | F.col("prix_valided").isNotNull() | by_status


def is_refused() -> Column:
    return F.coalesce(F.col("status") == REFUSED_STATUS, F.lit(False))


def is_past(as_of) -> Column:
    return F.coalesce(F.col("date_evenement") < F.lit(as_of).cast("date"), F.lit(False))


def outcome_class(as_of) -> Column:
    return (
        F.when(is_signed(), "SIGNED")
        .when(is_refused(), "REFUSED")
        .when(is_past(as_of), "EXPIRED_NO_SIGNATURE")
        .otherwise("OPEN")
    )


def is_closed(as_of) -> Column:
    return is_signed() | is_refused() | is_past(as_of)


def is_price_trainable(as_of) -> Column:
    priced = F.col("prix_proposed").isNotNull() & F.coalesce(F.col("prix_brut") > 0, F.lit(False))
    return priced & is_closed(as_of)


def blank(name: str) -> Column:
    """NULL or only spaces."""
    return F.coalesce(F.trim(F.col(name)) == "", F.lit(True))


def as_int(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


# The summary report uses NOT IN, so a NULL status is neither expired nor open there.
def untouched_status() -> Column:
    return (
        F.col("signer_at").isNull()
        & F.col("prix_valided").isNull()
        & ~F.col("status").isin([*SIGNED_STATUSES, REFUSED_STATUS])
    )
