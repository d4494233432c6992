"""What jobs move and keep per row, on rows that repeat, lack keys or are cut in blocks."""

import glob
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quotelab.operators import export, history, profile, venues
from quotelab.plans import registry
from quotelab.sources import star_schema
from quotelab.sources.tables import SCHEMAS, schema

T0 = datetime(2024, 1, 1)


def events(spark):
    """Repeated ids and times, a client with most rows, rows without client, time or both."""
    rows = []
    for i in range(120):
        client = None if i % 17 == 0 else 1 if i % 3 else i % 5
        created = None if i % 13 == 0 else T0 + timedelta(hours=i // 2 % 20)
        signed = T0 + timedelta(hours=i % 25) if i % 4 == 0 else None
        rows.append((i % 100, client, created, signed))
    return spark.createDataFrame(rows, "id long, client_id long, created_at timestamp, signer_at timestamp")


@pytest.mark.parametrize("target_rows", [1_000_000, 7])
def test_times_of_clients_hold_the_history_of_their_requests(spark, target_rows):
    rows = events(spark)
    times = history.client_times(rows, target_rows=target_rows)
    keys = [(r["_client"], r["_at"]) for r in times.collect()]
    assert len(keys) == len(set(keys)) and all(c is not None for c, _ in keys)
    same = (F.col("client_id") == F.col("_client")) & F.unix_micros("created_at").eqNullSafe(F.col("_at"))
    added = ["prior_request_count", "prior_signed_count", "prior_last_request_at"]
    got = rows.join(times, same).select("id", *added)
    want = history.with_prior_history(rows.where("client_id IS NOT NULL")).select("id", *added)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_wide_row_moves_clients_with_the_history(spark):
    tables = {name: spark.createDataFrame([], schema(name)) for name in SCHEMAS}
    plan = export.quote_rows(tables, "2024-06-15", after_quote=False)._jdf.queryExecution().optimizedPlan().toString()
    # The event columns take part in four joins, not in the history's windows: those see client and times.
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("prix_proposed" in line or "_event" in line for line in windows)


def test_distinct_counts_travel_alone(spark):
    rows = [(1, "a", 10.0), (1, "a", 12.0), (None, None, 5.0), (None, "b", 3.0), (2, "a", None)]
    quotes = spark.createDataFrame(rows, "request_event_id long, event_venue_anonymous_key string, price_proposed double").withColumns(
        {"price_catalog_gross": F.lit(10.0), "target_signed": F.lit(1), "target_price_training_eligible": F.lit(1),
         "request_created_at_utc": F.lit(T0), "event_lead_time_days": F.lit(1), "enrichment_address_available": F.lit(1)}
    )
    out = profile.profile(quotes)
    first = out.first()
    assert (first.duplicate_event_ids, first.unique_venue_keys, first.rows) == (2, 2, 5)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert profile.profile(quotes.drop("request_event_id", "event_venue_anonymous_key")).first().duplicate_event_ids == 0
    assert profile.profile(quotes.limit(0)).first().duplicate_event_ids is None


def test_request_lines_are_packed(spark):
    path = registry._request_lines(spark, "/root/testdata/sf0.001")
    files = glob.glob(f"{path}/part-*")
    assert files and all(f.endswith(".gz") for f in files)
    assert spark.read.text(path).count() == registry._requests(spark, "/root/testdata/sf0.001").count()


def test_history_reads_the_events_without_their_prices(spark, monkeypatch, tmp_path):
    """Client and times of the events come from the orders alone; their prices take a join with the lines."""
    lines = "l_orderkey long, l_partkey long, l_extendedprice double, l_discount double"
    orders = [(1, 1, "F", T0.date()), (2, 1, "O", T0.date()), (2, 1, "O", T0.date()), (3, None, "F", T0.date()), (None, 2, None, T0.date())]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, 10.0, 0.1), (2, 1, 5.0, 0.0), (2, 2, 7.0, 0.0)], lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    tables = star_schema.crm_tables(spark, str(tmp_path))
    times = tables["app_event_times"]
    assert "Join" not in times._jdf.queryExecution().optimizedPlan().toString()
    same = tables["app_event"].select(*times.columns)
    assert times.schema == same.schema
    assert sorted(map(tuple, times.collect()), key=repr) == sorted(map(tuple, same.collect()), key=repr)
    seen = []
    monkeypatch.setattr(export, "client_times", lambda events: seen.append(events.columns) or history.client_times(events))
    empty = {name: spark.createDataFrame([], schema(name)) for name in SCHEMAS}
    export.quote_rows(empty | {"app_event_times": times.limit(0)}, "2024-06-15", after_quote=False)
    assert seen == [times.columns]


def test_lookups_are_normalized_once(spark, monkeypatch):
    rows = [(1, " Salle A ", None), (2, "Salle A", "k"), (3, None, "k"), (4, "Château B", None)]
    quotes = spark.createDataFrame(rows, "request_event_id long, enrichment_event_full_address_raw string, event_venue_anonymous_key string")
    made = []
    monkeypatch.setattr(venues, "lookup_queries", lambda q, f=venues.lookup_queries: made.append(1) or f(q))
    monkeypatch.setattr(registry, "_PLANS", {})
    monkeypatch.setattr(registry, "_quotes", lambda spark, folder: quotes)
    source = {
        "supplier": spark.createDataFrame([(1, 1)], "s_suppkey long, s_nationkey long"),
    }
    monkeypatch.setattr(registry, "source_tables", lambda spark, folder: source)
    out = registry.venue_queries()["enriched_quotes"](spark, "lookups")
    assert {r.request_event_id: r.venue_enrichment_status for r in out.collect()} == {1: "NO_MATCH", 2: "MANUAL_OVERRIDE", 3: "MANUAL_OVERRIDE", 4: "NO_MATCH"}
    assert len(made) == 1
