"""Wide row, summaries and profile on a small hand-made CRM."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quotelab.operators import export, history, profile
from quotelab.sources.tables import SCHEMAS, read_crm, schema

AS_OF = "2024-06-15"


def rows_of(spark, name, rows):
    columns = schema(name).fieldNames()
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema(name))


@pytest.fixture(scope="module")
def crm(spark):
    def at(day, hour=10):
        return datetime(2024, 5, day, hour)

    def money(v):
        return Decimal(v)

    events = [
        dict(id=1, client_id=1, created_at=at(1), event_details_id=1, event_product_id=1, event_option_id=1,
             status="Acompte OK", prix_brut=money(1000), prix_proposed=money(800), reduc_product=money(100)),
        dict(id=2, client_id=1, created_at=at(3), event_details_id=2, signer_at=at(20, 9), status="Sended",
             prix_brut=money(0), prix_proposed=money(10), event_post_presta_id=1, prix_valided=money(700)),
        dict(id=3, client_id=1, created_at=at(3), event_details_id=3, status="Refused", prix_proposed=money(5)),
        dict(id=4, client_id=1, created_at=at(25), event_details_id=4, prix_brut=money(500)),
        dict(id=5, client_id=2, created_at=at(2), event_details_id=5, prix_brut=money(500), prix_proposed=money(900)),
        dict(id=6, client_id=None, created_at=at(2), event_details_id=1),
        dict(id=7, client_id=2, created_at=at(9), event_details_id=6, status="Sended", prix_valided=money(1)),
    ]
    details = [
        dict(id=1, date_evenement=date(2024, 6, 1), adresse_evenement=" 1 rue A ", ville_evenement=" Lyon ",
             code_postal_evenement="01000", horaire="18h", comment_client="été"),
        dict(id=2, date_evenement=date(2024, 6, 20), adresse_evenement="   "),
        dict(id=3, date_evenement=date(2024, 5, 2)),
        dict(id=4, date_evenement=date(2024, 6, 14)),
        dict(id=5, date_evenement=date(2024, 6, 15), comment=" "),
        dict(id=6, date_evenement=date(2024, 6, 20)),
    ]
    tables = {
        "app_event": events,
        "app_client": [dict(id=1, how_find="INSTAGRAM", raison_sociale=1), dict(id=2, how_find=" ")],
        "app_eventdetails": details,
        "app_eventproduct": [dict(id=1, photobooth=1, miroirbooth=2)],
        "app_eventoption": [dict(id=1, Phonebooth=1, magnets=100, Phonebooth_reduc_prix=money(10))],
        "app_eventacompte": [],
        "app_eventpostprestation": [dict(id=1, charge=money(100))],
        "app_emailtracking": [
            dict(event_traced=1, opened=1, sent_at=at(4), opened_at=at(4, 11)),
            dict(event_traced=1, opened=0, sent_at=at(3), opened_at=at(3, 11)),
            dict(event_traced=None, opened=1, sent_at=at(3)),
        ],
        "app_eventrelance": [
            dict(event_id=1, date_relance=at(5), qualification=None, commentaire="  "),
            dict(event_id=1, date_relance=at(6), qualification=5, commentaire="ok"),
            dict(event_id=1, date_relance=at(7), qualification=5),
        ],
        "app_cost": [],
        "app_namecost": [],
    }
    return {name: rows_of(spark, name, rows) for name, rows in tables.items()}


def test_wide_row(crm):
    wide = export.wide_quotes(crm, AS_OF)
    assert len(wide.columns) == 92
    rows = {r.request_event_id: r for r in wide.collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 7}  # the event without client has no row
    a, b = rows[1], rows[2]
    assert (a.product_count, a.option_count, a.price_total_declared_discount) == (3, 2, Decimal("110.00"))
    assert a.enrichment_event_full_address_raw == "1 rue A, 01000  Lyon " and a.event_city == "lyon"
    assert (a.event_client_comment_length, a.event_has_client_comment, a.event_lead_time_days) == (3, 1, 31)
    assert (a.email_sent_count, a.email_open_count, a.email_minutes_to_first_open) == (2, 1, 24 * 60 + 60)
    assert (a.followup_max_qualification, a.followup_avg_qualification, a.followup_with_comment_count) == (5, 3.33, 1)
    assert b.signed_delay_days == 16 and b.postpresta_margin_partial == Decimal("600.00")
    assert b.price_proposed_to_gross_ratio is None and b.enrichment_address_available == 0
    assert b.enrichment_event_full_address_raw == " "
    assert rows[3].prior_request_count == 1  # a request of the same instant does not count
    assert (rows[4].prior_request_count, rows[4].prior_signed_count) == (3, 1)
    assert rows[4].prior_last_request_at_utc == datetime(2024, 5, 3, 10)
    assert [c for c in export.drop_private(wide).columns if c.startswith("enrichment_event_")] == []


def test_outcomes_and_summary_read_null_status_differently(crm):
    rows = {r.event_id: r for r in export.outcomes(crm["app_event"], crm["app_eventdetails"], AS_OF).collect()}
    assert [rows[i].outcome_class for i in (1, 2, 3, 4, 5, 7)] == [
        "SIGNED", "SIGNED", "REFUSED", "EXPIRED_NO_SIGNATURE", "OPEN", "SIGNED",
    ]
    assert [rows[i].target_price_training_eligible for i in (1, 2, 3, 4, 5)] == [1, 0, 0, 0, 0]
    summary = export.export_summary(crm, AS_OF).first()
    assert summary.total_requests == 6 and summary.signed_requests == 3
    assert summary.expired_without_signature_requests == 0 and summary.still_open_requests == 0
    assert (summary.missing_request_source, summary.missing_products) == (2, 5)


def test_status_quality(crm):
    rows = {r.status: r for r in export.status_quality(crm["app_event"]).collect()}
    assert rows["NULL"].nombre_demandes == 3 and rows["NULL"].nombre_signees == 0
    assert rows["Sended"].taux_signature_pct == 100.0


def test_profile_counts_zero_price_as_very_high(crm):
    wide = export.wide_quotes(crm, AS_OF)
    doubled = wide.unionByName(wide.where("request_event_id = 1"))
    row = profile.profile(doubled).first()
    assert (row["rows"], row.columns, row.duplicate_event_ids) == (7, 92, 1)
    # 10 / 0 is infinite, 900 / 500 is 1.8.
    assert row.very_high_price_ratio_rows == 2 and row.nonpositive_catalog_price_rows == 1
    assert row.training_eligible_rows == 2 and row.price_median == 800
    top = profile.top_values(wide, "outcome_current_status").collect()
    assert [(r.value, r["count"]) for r in top] == [("Sended", 2), ("VIDE", 2), ("Acompte OK", 1), ("Refused", 1)]
    gaps = {r.column: (r["count"], r.rate) for r in profile.missingness(wide).collect()}
    assert gaps["price_proposed"] == (2, round(2 / 6, 4)) and gaps["event_date"] == (0, 0.0)


def test_crm_folder_round_trip(crm, spark, tmp_path):
    for name, table in crm.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    again = read_crm(spark, str(tmp_path))
    assert set(again) == set(SCHEMAS)
    assert export.wide_quotes(again, AS_OF).count() == 6


@pytest.mark.parametrize("target_rows", [1_000_000, 2])
def test_stock_counts_only_bookings_signed_before(spark, target_rows):
    day = date(2024, 6, 1)
    rows = [
        (1, day, datetime(2024, 1, 1), datetime(2024, 1, 5), 1, 0),
        (2, day, datetime(2024, 1, 2), None, 1, 1),
        (3, day, datetime(2024, 1, 5), datetime(2024, 1, 6), 2, 0),
        (4, day, datetime(2024, 1, 7), None, 1, 0),
        (5, date(2024, 6, 2), datetime(2024, 1, 7), None, 1, 0),
        (6, None, datetime(2024, 1, 7), None, 0, 0),
    ]
    quotes = spark.createDataFrame(
        rows,
        "request_event_id long, event_date date, request_created_at_utc timestamp, signed_at_utc timestamp, "
        "product_photobooth int, product_miroirbooth int",
    ).withColumns({c: F.lit(0) for c in list(history.PRODUCT_CODES)[2:]})
    got = history.stock_as_of(quotes, {"PHOTOBOOTH": 3, "MIROIRBOOTH": 1}, target_rows)
    by_id = {r.request_event_id: r for r in got.collect()}
    assert [by_id[i].bookings_on_date for i in range(1, 7)] == [0, 0, 0, 2, 0, 0]
    assert by_id[4].available_products == {"PHOTOBOOTH": 0, "MIROIRBOOTH": 1}
    assert by_id[4].date_requested_product_bookings == 3 and by_id[4].date_utilization_ratio == 0.75
    assert by_id[4].available_requested_product_ratio == 0.0
    assert by_id[2].available_requested_product_ratio == 1.0
