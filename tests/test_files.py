"""CSV and JSON sources and sinks."""

import json

import pytest

from quotelab.config import Config, load_config
from quotelab.operators import costing, features, ladder
from quotelab.sources import files


def test_delimiter_and_text_columns(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text('﻿id;"x,y,z,t";postal\n1;é;01000\n', encoding="utf-8")
    b.write_text('id,name\n1,"a;b;c"\n', encoding="utf-8")
    assert files.delimiter(spark, str(a)) == ";" and files.delimiter(spark, str(b)) == ","
    row = files.read_csv(spark, str(a)).first()
    assert row.postal == "01000" and row["id"] == "1"
    assert files.read_csv(spark, str(b)).first()["name"] == "a;b;c"


def test_catalogue(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("code,normal_price_eur,direct_cost_eur,floor_price_eur\nA,10,x,\nB,1,2,3\n")
    rows = {r.code: r for r in files.read_catalogue(spark, str(path)).collect()}
    assert rows["A"].direct_cost_eur is None and rows["B"].floor_price_eur == 3.0
    path.write_text("code,normal_price_eur,direct_cost_eur,floor_price_eur\nA,10,x,\nA,1,2,3\n")
    with pytest.raises(ValueError, match="A"):
        files.read_catalogue(spark, str(path))


def test_overrides(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text("match_key,venue_name\nEXEMPLE_X,no\n,no\nk1 ,old\nk2,b\nk1,new\n")
    rows = {r.match_key: r.venue_name for r in files.read_overrides(spark, str(path)).collect()}
    assert rows == {"k1": "new", "k2": "b"}


SAMPLE = {
    "request_created_at_utc": "2026-07-31T09:15:00Z", "request_source": "SITE INTERNET", "request_is_business": False,
    "prior_last_request_at_utc": None, "event_date": "2027-06-19", "product_miroirbooth": 1, "product_videobooth": True,
    "price_catalog_gross": 750, "direct_cost_eur": 370, "available_products": {"PHOTOBOOTH": 3, "MIROIRBOOTH": 3},
}


def test_requests_and_reports(spark, tmp_path):
    folder = tmp_path / "requests"
    folder.mkdir()
    request = {"price_catalog_gross": 750, "direct_cost_eur": "370", "available_products": {"PHOTOBOOTH": 3}}
    (folder / "a.json").write_text("\ufeff" + json.dumps(request, indent=2), encoding="utf-8")
    (folder / "b.json").write_text(json.dumps({"request_id": "b", "available_products": 5, "product_photobooth": 1}))
    (folder / "c.json").write_text('{"price_catalog_gross": 750, ')
    (folder / "d.json").write_text("[1, 2]")
    requests = files.read_requests(spark, str(folder))
    rows = {r.request_id.rsplit("/", 1)[-1]: r for r in requests.collect()}
    assert set(rows) == {"a.json", "b"}
    assert rows["a.json"].available_products == {"PHOTOBOOTH": "3"} and rows["b"].available_products is None
    bounds = ladder.bounds_of(requests, costing.default_catalogue(spark), Config())
    assert {r.price_status for r in bounds.collect()} == {"OK"}
    rejects = {r.source.rsplit("/", 1)[-1]: r.reason for r in files.rejected_documents(spark, str(folder)).collect()}
    assert rejects == {"c.json": "BROKEN_JSON", "d.json": "NOT_AN_OBJECT"}
    files.write_report(bounds.select("request_id", "cost_details", "price_error"), str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert len(lines) == 2 and all("price_error" in json.loads(r[0]) for r in lines)


def test_gaps_of_a_request_are_derived_per_row(spark, tmp_path):
    given = {**SAMPLE, "request_id": "given", "event_lead_time_days": 5, "request_daypart": "SOIR"}
    undated = {"request_id": "undated", "event_date": "2026-08-11", "event_is_weekend": 1}
    texts = [json.dumps(SAMPLE), "", json.dumps(given), "{oops", json.dumps(undated), "3", "null"]
    (tmp_path / "lines.json").write_text("\n".join(texts))
    requests = files.read_requests(spark, str(tmp_path / "lines.json"), lines=True)
    prepared = features.prepare_features(requests, as_of="2026-08-01", per_row=True).collect()
    rows = {r.request_id.rsplit("/", 1)[-1].split("#")[0]: r for r in prepared}
    sample = rows["lines.json"]
    assert (sample.event_lead_time_days, sample.event_lead_time_bucket) == (323, "PLUS_180_JOURS")
    assert (sample.request_is_business, sample.product_videobooth, sample.product_count) == (0, 1, 2)
    assert sample.request_daypart == "MATIN" and sample.event_month == 6 and sample.prior_signature_rate == 0
    assert (rows["given"].event_lead_time_days, rows["given"].event_lead_time_bucket) == (5, "0_7_JOURS")
    assert rows["given"].request_daypart == "SOIR" and rows["given"].event_is_last_minute == 1
    assert (rows["undated"].event_lead_time_days, rows["undated"].event_is_weekend) == (10, 1)
    rejects = [(r.document, r.reason) for r in files.rejected_documents(spark, str(tmp_path / "lines.json"), lines=True).collect()]
    assert sorted(rejects) == [("3", "NOT_AN_OBJECT"), ("null", "NOT_AN_OBJECT"), ("{oops", "BROKEN_JSON")]


def test_unnamed_lines_get_different_names(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join(['{"product_photobooth": 1}'] * 50))
    names = [r.request_id for r in files.read_requests(spark, str(tmp_path / "lines.json"), lines=True).collect()]
    assert len(set(names)) == 50


def test_history_sink_drops_addresses(spark, tmp_path):
    df = spark.createDataFrame([(1, "rue", "a;b")], "request_event_id long, enrichment_event_address_raw string, c string")
    files.write_history(df, str(tmp_path / "h"))
    assert files.read_csv(spark, str(tmp_path / "h")).columns == ["request_event_id", "c"]
    files.write_history(df, str(tmp_path / "k"), keep_addresses=True)
    assert "enrichment_event_address_raw" in files.read_csv(spark, str(tmp_path / "k")).columns


def test_config(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text('{"price_ending": 50, "other": 1}')
    config = load_config(spark, str(path))
    assert config.price_ending == 50 and config.price_step_eur == 100
