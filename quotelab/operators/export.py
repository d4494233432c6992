"""One leak-free row per quote request, and the summary statements around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelab.functions.numbers import total
from quotelab.functions.predicates import (
    as_int,
    blank,
    is_closed,
    is_past,
    is_price_trainable,
    is_signed,
    outcome_class,
    untouched_status,
)
from quotelab.operators.history import client_times
from quotelab.session import bounded, left_join_spread

# Output column -> option column of the CRM.
OPTION_FLAGS = {
    "option_mur_floral": "MurFloral",
    "option_phonebooth": "Phonebooth",
    "option_livre_or": "LivreOr",
    "option_fond_360": "Fond360",
    "option_panneau_bienvenue": "PanneauBienvenue",
    "option_photographe_voguebooth": "PhotographeVoguebooth",
    "option_impression_voguebooth": "ImpressionVoguebooth",
    "option_decor_voguebooth": "DecorVoguebooth",
    "option_holo_3d": "Holo3D",
    "option_panneau_fontaine": "PanneauFontaine",
    "option_video_livre_or": "VideoLivreOr",
}
OPTION_QUANTITIES = {
    "option_magnets_quantity": "magnets",
    "option_porte_cles_quantity": "PorteCles",
    "option_magnets_simple_quantity": "MagnetsSimple",
}
PRODUCTS = ["photobooth", "miroirbooth", "videobooth", "voguebooth", "ipadbooth", "airbooth"]


def _or_zero(name: str):
    return F.expr(f"coalesce(`{name}`, 0)")


def status_quality(events: DataFrame) -> DataFrame:
    """Requests and signature rate per status, most frequent first."""
    signed = F.sum(as_int(is_signed()))
    return (
        events.groupBy(F.coalesce("status", F.lit("NULL")).alias("status"))
        .agg(
            F.count("*").alias("nombre_demandes"),
            signed.alias("nombre_signees"),
            F.round(F.lit(100.0) * signed / F.nullif(F.count("*"), F.lit(0)), 1).alias(
                "taux_signature_pct"
            ),
        )
        .orderBy(F.desc("nombre_demandes"), "status")
    )


def email_stats(tracking: DataFrame) -> DataFrame:
    opened = F.coalesce(F.col("opened") == 1, F.lit(False))
    opened_at = F.when(opened, F.col("opened_at"))
    return (
        tracking.where(F.col("event_traced").isNotNull())
        .groupBy(F.col("event_traced").alias("event_id"))
        .agg(
            F.count("*").alias("email_sent_count"),
            F.sum(as_int(opened)).alias("email_open_count"),
            F.max(as_int(opened)).alias("email_any_opened"),
            F.min("sent_at").alias("email_first_sent_at"),
            F.max("sent_at").alias("email_last_sent_at"),
            F.min(opened_at).alias("email_first_opened_at"),
            F.max(opened_at).alias("email_last_opened_at"),
        )
    )


def followup_stats(followups: DataFrame) -> DataFrame:
    grade = _or_zero("qualification")
    return followups.groupBy("event_id").agg(
        F.count("*").alias("followup_count"),
        F.min("date_relance").alias("followup_first_at"),
        F.max("date_relance").alias("followup_last_at"),
        F.max(grade).alias("followup_max_qualification"),
        F.round(F.avg(grade), 2).alias("followup_avg_qualification"),
        F.sum(as_int(~blank("commentaire"))).alias("followup_with_comment_count"),
    )


def outcomes(events: DataFrame, details: DataFrame, as_of) -> DataFrame:
    """Target and outcome class per event; ``as_of`` is the day that decides what is past."""
    dates = details.select(F.col("id").alias("_details"), "date_evenement")
    return events.join(dates, events.event_details_id == dates._details).select(
        F.col("id").alias("event_id"),
        as_int(is_signed()).alias("target_signed"),
        outcome_class(as_of).alias("outcome_class"),
        as_int(is_closed(as_of)).alias("target_training_eligible"),
        as_int(is_price_trainable(as_of)).alias("target_price_training_eligible"),
    )


def _optional(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a nullable key, dropping the right-hand id."""
    side = right.withColumnRenamed("id", "_id")
    return left_join_spread(left, side, key, "_id", F.col(key).isNull(), "id")


def quote_rows(tables: dict[str, DataFrame], as_of, after_quote: bool = True) -> DataFrame:
    """The wide row: 92 columns, or only those known when the quote is sent plus the outcome.

    Every join moves the row as it is by then, so what adds least comes first and the texts of the
    details last.  Client and history arrive together, by client and time.  Outcomes are computed on
    the joined row; the events are scanned once more for client and times alone, by ``app_event_times``
    (a row per event with those columns) where ``tables`` has it.
    """
    events = tables["app_event"]
    clients = tables["app_client"].select(
        F.col("id").alias("_client_id"), "how_find", "raison_sociale"
    )
    # A source whose events take joins to build may give their clients and times apart.
    timed = tables.get("app_event_times", events)
    known = client_times(timed).join(clients, F.col("_client") == F.col("_client_id")).drop("_client_id")
    details = tables["app_eventdetails"].withColumnRenamed("id", "_details_id")
    rows = events
    if after_quote:
        emails = email_stats(tables["app_emailtracking"]).withColumnRenamed("event_id", "_email_id")
        calls = followup_stats(tables["app_eventrelance"]).withColumnRenamed("event_id", "_call_id")
        rows = (
            rows.join(emails, F.col("id") == F.col("_email_id"), "left")
            .join(calls, F.col("id") == F.col("_call_id"), "left")
            .drop("_email_id", "_call_id")
        )
        rows = _optional(rows, tables["app_eventpostprestation"], "event_post_presta_id")
        rows = _optional(rows, tables["app_eventacompte"], "event_acompte_id")
    rows = _optional(rows, tables["app_eventproduct"], "event_product_id")
    same = (F.col("client_id") == F.col("_client")) & F.unix_micros("created_at").eqNullSafe(F.col("_at"))
    rows = rows.join(known, same).drop("_client", "_at")
    rows = _optional(rows, tables["app_eventoption"], "event_option_id")
    rows = rows.join(details, F.col("event_details_id") == F.col("_details_id")).drop("_details_id")
    columns = {
        **_identity(),
        **_event_columns(),
        **_product_columns(),
        **_option_columns(),
        **_price_columns(),
        **_outcome_columns(as_of),
    }
    if after_quote:
        columns |= {**_payment_columns(), **_email_columns(), **_followup_columns()}
    return rows.select(*[column.alias(name) for name, column in columns.items()])


def wide_quotes(tables: dict[str, DataFrame], as_of) -> DataFrame:
    return quote_rows(tables, as_of)


def _identity() -> dict:
    return {
        "request_event_id": F.col("id"),
        "request_quote_number": F.col("num_devis"),
        "request_created_at_utc": F.col("created_at"),
        "request_source": F.col("how_find"),
        "request_is_business": as_int(F.coalesce(F.col("raison_sociale") == 1, F.lit(False))),
        "prior_request_count": F.col("prior_request_count"),
        "prior_signed_count": F.col("prior_signed_count"),
        "prior_last_request_at_utc": F.col("prior_last_request_at"),
        "prior_is_returning_client": as_int(F.col("prior_request_count") > 0),
    }


def _event_columns() -> dict:
    day = F.col("date_evenement")
    postal, city = F.col("code_postal_evenement"), F.col("ville_evenement")
    empty = F.lit("")
    return {
        "event_date": day,
        "event_month": F.month(day),
        "event_quarter": F.quarter(day),
        "event_weekday_iso": F.weekday(day) + 1,
        "event_is_weekend": as_int(F.weekday(day) >= 5),
        "event_lead_time_days": F.datediff(day, F.to_date("created_at")),
        "event_postal_code": postal,
        "event_city": F.lower(F.trim(city)),
        "enrichment_event_address_raw": F.col("adresse_evenement"),
        "enrichment_event_full_address_raw": F.concat_ws(
            ", ",
            F.nullif(F.trim("adresse_evenement"), empty),
            F.concat(F.coalesce(postal, empty), F.lit(" "), F.coalesce(city, empty)),
        ),
        "enrichment_address_available": as_int(~blank("adresse_evenement")),
        "event_has_schedule": as_int(~blank("horaire")),
        "event_schedule_raw": F.col("horaire"),
        "event_has_client_comment": as_int(~blank("comment_client")),
        "event_client_comment_length": F.char_length(F.coalesce("comment_client", empty)),
        "event_has_internal_comment": as_int(~blank("comment")),
        "event_internal_comment_length": F.char_length(F.coalesce("comment", empty)),
        "event_venue_anonymous_key": F.sha2(
            F.concat_ws(
                "|",
                F.lower(F.trim(F.coalesce("adresse_evenement", empty))),
                F.coalesce(postal, empty),
                F.lower(F.trim(F.coalesce(city, empty))),
            ),
            256,
        ),
    }


def _product_columns() -> dict:
    flags = {f"product_{p}": _or_zero(p) for p in PRODUCTS}
    return flags | {"product_count": total(list(flags.values()))}


def _option_columns() -> dict:
    flags = {name: _or_zero(source) for name, source in OPTION_FLAGS.items()}
    quantities = {name: _or_zero(source) for name, source in OPTION_QUANTITIES.items()}
    columns = {}
    for name, column in flags.items():
        columns[name] = column
        if name == "option_mur_floral":
            columns["option_mur_floral_style"] = F.col("mur_floral_style")
    present = [as_int(q > 0) for q in quantities.values()]
    return (
        columns
        | quantities
        | {
            "option_delivery": _or_zero("livraison"),
            "option_duration_hours": _or_zero("duree"),
            "option_count": total([*flags.values(), *present]),
        }
    )


def _price_columns() -> dict:
    sources = [*OPTION_FLAGS.values(), *OPTION_QUANTITIES.values()]
    option = total([_or_zero(f"{source}_reduc_prix") for source in sources])
    product, everything = _or_zero("reduc_product"), _or_zero("reduc_all")
    gross, proposed = F.col("prix_brut"), F.col("prix_proposed")
    return {
        "price_catalog_gross": gross,
        "price_product_discount": product,
        "price_global_discount": everything,
        "price_option_discount": option,
        "price_total_declared_discount": product + everything + option,
        "price_proposed": proposed,
        "price_proposed_minus_gross": proposed - gross,
        "price_proposed_to_gross_ratio": F.round(F.try_divide(proposed, gross), 4),
    }


def _outcome_columns(as_of) -> dict:
    validated = F.col("prix_valided")
    return {
        "target_signed": as_int(is_signed()),
        "outcome_class": outcome_class(as_of),
        "target_training_eligible": as_int(is_closed(as_of)),
        "target_price_training_eligible": as_int(is_price_trainable(as_of)),
        "outcome_current_status": F.col("status"),
        "outcome_status_history": F.col("history_status"),
        "signed_at_utc": F.col("signer_at"),
        "signed_delay_days": F.expr("timestampdiff(DAY, created_at, signer_at)"),
        "signed_price": validated,
        "signed_price_vs_proposed": validated - F.col("prix_proposed"),
    }


def _payment_columns() -> dict:
    charge, salary = _or_zero("charge"), _or_zero("membre_salary")
    validated = F.col("prix_valided")
    return {
        "payment_deposit_amount": F.col("montant_acompte"),
        "payment_method": F.col("mode_payement"),
        "payment_date": F.col("date_payement"),
        "payment_remaining_amount": F.col("montant_restant"),
        "postpresta_recorded_charge": F.col("charge"),
        "postpresta_member_salary": F.col("membre_salary"),
        "postpresta_recorded_direct_cost_partial": charge + salary,
        "postpresta_margin_partial": validated - charge - salary,
        "postpresta_client_paid": F.col("client_paid"),
        "postpresta_members_paid": F.col("members_paid"),
    }


def _email_columns() -> dict:
    counts = ["email_sent_count", "email_open_count", "email_any_opened"]
    return {name: _or_zero(name) for name in counts} | {
        "email_first_sent_at_utc": F.col("email_first_sent_at"),
        "email_first_opened_at_utc": F.col("email_first_opened_at"),
        "email_minutes_to_first_open": F.expr(
            "timestampdiff(MINUTE, email_first_sent_at, email_first_opened_at)"
        ),
    }


def _followup_columns() -> dict:
    return {
        "followup_count": _or_zero("followup_count"),
        "followup_first_at_utc": F.col("followup_first_at"),
        "followup_last_at_utc": F.col("followup_last_at"),
        "followup_max_qualification": _or_zero("followup_max_qualification"),
        "followup_avg_qualification": F.coalesce("followup_avg_qualification", F.lit(0.0)),
        "followup_with_comment_count": _or_zero("followup_with_comment_count"),
    }


def cost_lines(costs: DataFrame, names: DataFrame) -> DataFrame:
    named = bounded(names.select(F.col("id").alias("_name_id"), F.col("name").alias("cost_name")))
    return costs.join(named, F.col("name_cost_id") == F.col("_name_id")).select(
        F.col("id").alias("cost_id"), "cost_name", "type_cost", "price_cost", "created_at", "frecency"
    )


def export_summary(tables: dict[str, DataFrame], as_of) -> DataFrame:
    """Nine counts over the whole base; keeps the NOT IN reading of a NULL status."""
    details = tables["app_eventdetails"].select(F.col("id").alias("_details_id"), "date_evenement")
    clients = tables["app_client"].select(F.col("id").alias("_client_id"), "how_find")
    joined = (
        tables["app_event"]
        .join(details, F.col("event_details_id") == F.col("_details_id"))
        .join(clients, F.col("client_id") == F.col("_client_id"))
    )
    upcoming = F.col("date_evenement") >= F.lit(as_of).cast("date")
    counts = {
        "signed_requests": is_signed(),
        "explicitly_refused_requests": F.col("status") == "Refused",
        "expired_without_signature_requests": untouched_status() & is_past(as_of),
        "still_open_requests": untouched_status() & upcoming,
        "missing_proposed_price": F.col("prix_proposed").isNull(),
        "missing_request_source": blank("how_find"),
        "missing_products": F.col("event_product_id").isNull(),
        "missing_options": F.col("event_option_id").isNull(),
    }
    return joined.agg(
        F.count("*").alias("total_requests"),
        *[F.sum(as_int(c)).alias(name) for name, c in counts.items()],
    )


def drop_private(quotes: DataFrame) -> DataFrame:
    """Remove exact addresses before anything is written."""
    return quotes.drop(*[c for c in quotes.columns if c.startswith("enrichment_event_")])
