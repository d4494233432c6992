"""Venue queries in plain SQL; word overlap stands for the match score."""

from __future__ import annotations

from oracles.crm import with_quotes


def plain_words(text: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({text})), '[^a-z0-9]+', ' ', 'g'))"


LOOKUPS = f"""
asked AS (SELECT DISTINCT trim(enrichment_event_full_address_raw) AS query FROM quotes
  WHERE trim(coalesce(enrichment_event_full_address_raw, '')) <> ''),
lookups AS (SELECT query, {plain_words("query")} AS query_norm, sha256({plain_words("query")}) AS query_hash FROM asked)"""

PLACES = f"""
five AS (
  SELECT s_nationkey, pos,
    (['Château ', 'Domaine ', 'Salle '])[s_suppkey % 3 + 1] || s_suppkey AS display_name,
    (s_suppkey % 7) || ' rue Nation-' || s_nationkey || ', ' || lpad(CAST(1000 + s_nationkey * 37 AS VARCHAR), 5, '0')
      AS formatted_address,
    (['event_venue', 'premise', 'hotel'])[s_suppkey % 3 + 1] AS primary_type,
    CASE s_suppkey % 4 WHEN 0 THEN ['event_venue', 'street_address'] WHEN 1 THEN ['premise'] WHEN 3 THEN ['hotel'] END
      AS types,
    CASE WHEN s_suppkey % 9 <> 0 THEN 2.5::DOUBLE + (s_suppkey % 11) / 4.0::DOUBLE END AS rating,
    CASE WHEN s_suppkey % 8 <> 0 THEN CAST(s_suppkey * 37 % 5000 AS INTEGER) END AS user_rating_count,
    CASE WHEN s_suppkey % 3 <> 0 THEN 'https://venue' || s_suppkey || '.example.com' END AS website_uri,
    CASE s_suppkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 12 WHEN 3 THEN 24 WHEN 4 THEN 32 ELSE 8 END AS level_points
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS pos
    FROM supplier) WHERE pos < 5),
named AS (SELECT DISTINCT query_hash, query_norm,
    TRY_CAST(regexp_extract(query_norm, 'nation ([0-9]+)', 1) AS INTEGER) AS nation FROM lookups),
places AS (SELECT n.query_hash, n.query_norm, f.*, starts_with(n.query_hash, '0') AS failed
  FROM named n JOIN five f ON f.s_nationkey = n.nation),
scores AS (
  SELECT *, CAST(round_even(least(100.0::DOUBLE, level_points + greatest(0, least(30, stars)) + keyword
      + CASE WHEN website_uri IS NOT NULL THEN 8 ELSE 0 END), 0) AS INTEGER) AS premium_score,
    CAST(round_even(least(100.0::DOUBLE, least(65, reviews * 23) + greatest(0, stars)), 0) AS INTEGER) AS notability_score,
    CASE WHEN list_has_any(coalesce(types, []), ['event_venue', 'hotel']) THEN 0
      WHEN list_has_any(coalesce(types, []), ['street_address', 'premise']) THEN 1 ELSE 0 END AS is_private_address,
    round_even(len(list_intersect(words, list_distinct(string_split(candidate, ' '))))
      / len(words)::DOUBLE, 4) AS confidence
  FROM (SELECT *, (coalesce(rating, 0) - 3.5) * 20 AS stars, log10(coalesce(user_rating_count, 0) + 1) AS reviews,
      CASE WHEN display_name LIKE 'Salle%' THEN 0 ELSE 18 END AS keyword,
      list_distinct(string_split(query_norm, ' ')) AS words,
      {plain_words("display_name || ' ' || formatted_address")} AS candidate FROM places))"""

ENRICHED = """
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_hash ORDER BY confidence DESC, pos) AS spot
  FROM scores WHERE NOT failed) WHERE spot = 1),
failures AS (SELECT DISTINCT query_hash FROM scores WHERE failed),
forced AS (SELECT DISTINCT event_venue_anonymous_key AS key FROM quotes WHERE request_event_id % 450 = 2),
enriched AS (
  SELECT q.request_event_id, f.key IS NOT NULL AS o, x.query_hash IS NOT NULL AS failed,
    b.query_hash IS NOT NULL AS found, b.*, q.event_venue_anonymous_key AS key, q.enrichment_event_full_address_raw AS raw
  FROM quotes q LEFT JOIN forced f ON f.key = q.event_venue_anonymous_key
  LEFT JOIN lookups l ON l.query = trim(q.enrichment_event_full_address_raw)
  LEFT JOIN failures x ON x.query_hash = l.query_hash LEFT JOIN best b ON b.query_hash = l.query_hash),
venues AS (
  SELECT request_event_id, CASE WHEN o THEN 'Domaine ' || substr(key, 1, 4) ELSE display_name END AS venue_name,
    CASE WHEN o THEN 1.0::DOUBLE ELSE confidence END AS venue_match_confidence,
    CASE WHEN o THEN 0 ELSE is_private_address END AS venue_is_private_address,
    CASE WHEN o THEN 'event_venue' ELSE primary_type END AS venue_type,
    CASE WHEN o THEN 180 END AS venue_capacity_seated, CAST(NULL AS INTEGER) AS venue_capacity_cocktail,
    CASE WHEN NOT o THEN rating END AS venue_rating, CASE WHEN NOT o THEN user_rating_count END AS venue_review_count,
    CASE WHEN o THEN 5000.0::DOUBLE END AS venue_price_min, CASE WHEN o THEN 9000.5::DOUBLE END AS venue_price_max,
    CASE WHEN o THEN CAST(substr(key, 1, 1) < '8' AS INTEGER) WHEN found THEN CAST(website_uri IS NOT NULL AS INTEGER) END
      AS venue_has_official_website,
    CASE WHEN o THEN 75 ELSE premium_score END AS venue_premium_score,
    CASE WHEN o THEN 80 ELSE notability_score END AS venue_notability_score,
    CASE WHEN o OR found THEN 1 END AS venue_enrichment_sources_count,
    CASE WHEN o THEN 'MANUAL_OVERRIDE' WHEN trim(coalesce(raw, '')) = '' THEN 'NO_ADDRESS_OR_NAME'
      WHEN failed THEN 'HTTP_ERROR_TimeoutError' WHEN NOT found THEN 'NO_MATCH'
      WHEN confidence < 0.55 THEN 'MATCH_REVIEW_REQUIRED' ELSE 'MATCHED' END AS venue_enrichment_status
  FROM enriched)"""


def statements() -> dict[str, str]:
    placed = [LOOKUPS, PLACES]
    return {
        "normalized_texts": f"SELECT doc_id, {plain_words('text')} AS words FROM documents",
        "lookup_queries": with_quotes("SELECT DISTINCT query_hash, query_norm FROM lookups", LOOKUPS),
        "place_overlap": with_quotes("SELECT query_hash, pos, confidence FROM scores", *placed),
        "place_scores": with_quotes(
            "SELECT query_hash, pos, premium_score, notability_score, is_private_address FROM scores", *placed
        ),
        "enriched_quotes": with_quotes("SELECT * FROM venues", *placed, ENRICHED),
        "enrichment_status_counts": with_quotes(
            "SELECT venue_enrichment_status AS value, COUNT(*) AS count FROM venues GROUP BY 1", *placed, ENRICHED
        ),
    }
