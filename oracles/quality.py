"""Profile and feature queries in plain SQL."""

from __future__ import annotations

from oracles.crm import with_quotes

IMPORTANT = [
    "request_created_at_utc", "request_source", "event_date", "event_postal_code", "event_city",
    "event_venue_anonymous_key", "price_catalog_gross", "price_proposed", "target_signed",
    "outcome_class",
]

PROFILE = """
SELECT COUNT(*) AS rows, CAST(70 AS BIGINT) AS columns,
  COUNT(*) - COUNT(DISTINCT request_event_id) AS duplicate_event_ids,
  MIN(request_created_at_utc) AS request_date_min, MAX(request_created_at_utc) AS request_date_max,
  COUNT(*) FILTER (t) AS training_eligible_rows,
  COUNT(*) FILTER (t AND target_signed = 1) AS training_signed_rows,
  COUNT(*) FILTER (t AND target_signed = 0) AS training_not_signed_rows,
  round(AVG(target_signed) FILTER (t), 4) AS training_signature_rate,
  COUNT(*) FILTER (price_proposed IS NULL) AS price_missing_count,
  MIN(price_proposed) FILTER (t) AS price_minimum, MEDIAN(price_proposed) FILTER (t) AS price_median,
  round(AVG(price_proposed) FILTER (t), 2) AS price_mean, MAX(price_proposed) FILTER (t) AS price_maximum,
  COUNT(*) FILTER (event_lead_time_days < 0) AS negative_lead_time_rows,
  COUNT(*) FILTER (price_proposed <= 0) AS nonpositive_proposed_price_rows,
  COUNT(*) FILTER (price_catalog_gross <= 0) AS nonpositive_catalog_price_rows,
  COUNT(*) FILTER (CASE WHEN price_catalog_gross = 0 THEN price_proposed < 0
    ELSE price_proposed / price_catalog_gross < 0.5 END) AS very_low_price_ratio_rows,
  COUNT(*) FILTER (CASE WHEN price_catalog_gross = 0 THEN price_proposed > 0
    ELSE price_proposed / price_catalog_gross > 1.5 END) AS very_high_price_ratio_rows,
  COUNT(*) FILTER (enrichment_address_available = 1) AS address_available_rows,
  COUNT(DISTINCT event_venue_anonymous_key) AS unique_venue_keys
FROM (SELECT *, target_price_training_eligible = 1 AND price_proposed IS NOT NULL AS t FROM quotes)"""


def top(column: str) -> str:
    return f"""(SELECT '{column}' AS "column", coalesce({column}, 'VIDE') AS value, COUNT(*) AS count
      FROM quotes GROUP BY 2 ORDER BY count DESC, value LIMIT 20)"""


def missing(column: str) -> str:
    return f"""SELECT '{column}' AS "column", COUNT(*) FILTER ({column} IS NULL) AS count,
      round(CAST(COUNT(*) FILTER ({column} IS NULL) AS DOUBLE) / COUNT(*), 4) AS rate FROM quotes"""


# Columns every later query needs: price features are added where prices are set.
FEATURES = """
features AS (
  SELECT *,
    CAST(month(request_created_at_utc) AS DOUBLE) AS request_month,
    CAST(isodow(request_created_at_utc) AS DOUBLE) AS request_weekday_iso,
    CASE WHEN isodow(request_created_at_utc) >= 6 THEN 1.0::DOUBLE ELSE 0 END AS request_is_weekend,
    CAST(hour(request_created_at_utc) AS DOUBLE) AS request_hour,
    CASE WHEN hour(request_created_at_utc) < 8 OR hour(request_created_at_utc) >= 19 THEN 1.0::DOUBLE ELSE 0 END
      AS request_is_outside_business_hours,
    CASE WHEN hour(request_created_at_utc) < 6 THEN 'NUIT' WHEN hour(request_created_at_utc) < 12 THEN 'MATIN'
      WHEN hour(request_created_at_utc) < 18 THEN 'APRES_MIDI' ELSE 'SOIR' END AS request_daypart,
    CASE WHEN event_lead_time_days BETWEEN 0 AND 13 THEN 1.0::DOUBLE ELSE 0 END AS event_is_very_last_minute,
    CASE WHEN event_lead_time_days BETWEEN 0 AND 29 THEN 1.0::DOUBLE ELSE 0 END AS event_is_last_minute,
    CASE WHEN event_lead_time_days > 180 THEN 1.0::DOUBLE ELSE 0 END AS event_is_long_lead,
    CASE WHEN event_lead_time_days < 0 THEN 'DATE_PASSEE_OU_INVALIDE' WHEN event_lead_time_days <= 7 THEN '0_7_JOURS'
      WHEN event_lead_time_days <= 14 THEN '8_14_JOURS' WHEN event_lead_time_days <= 30 THEN '15_30_JOURS'
      WHEN event_lead_time_days <= 60 THEN '31_60_JOURS' WHEN event_lead_time_days <= 120 THEN '61_120_JOURS'
      WHEN event_lead_time_days <= 180 THEN '121_180_JOURS' ELSE 'PLUS_180_JOURS' END AS event_lead_time_bucket,
    coalesce(CAST(prior_signed_count AS DOUBLE) / nullif(prior_request_count, 0), 0) AS prior_signature_rate,
    (epoch_us(request_created_at_utc) - epoch_us(prior_last_request_at_utc)) / 86400e6
      AS prior_days_since_last_request,
    CASE WHEN product_count >= 2 THEN 1.0::DOUBLE ELSE 0 END AS product_is_multi,
    CAST(least(product_miroirbooth, 1) + least(product_videobooth, 1) + least(product_voguebooth, 1) AS DOUBLE)
      AS product_premium_count,
    CASE WHEN product_miroirbooth + product_videobooth + product_voguebooth > 0 THEN 1.0::DOUBLE ELSE 0 END
      AS product_has_premium,
    coalesce(nullif(concat_ws('+', CASE WHEN product_photobooth > 0 THEN 'PHOTOBOOTH' END,
      CASE WHEN product_miroirbooth > 0 THEN 'MIROIRBOOTH' END, CASE WHEN product_videobooth > 0 THEN 'BOOTH_360' END,
      CASE WHEN product_voguebooth > 0 THEN 'VOGUEBOOTH' END, CASE WHEN product_ipadbooth > 0 THEN 'IPADBOOTH' END),
      ''), 'AUCUN_PRODUIT') AS product_bundle_signature,
    CAST(option_magnets_quantity + option_porte_cles_quantity AS DOUBLE) AS option_quantity_total,
    CAST(product_count + option_count AS DOUBLE) AS request_total_items,
    (enrichment_address_available + event_has_schedule + event_has_client_comment
      + least(product_count, 1)) / 4.0::DOUBLE AS event_request_completeness_score,
    4.0::DOUBLE - (enrichment_address_available + event_has_schedule + event_has_client_comment
      + least(product_count, 1)) AS event_missing_information_count
  FROM quotes)"""

BUILT = """
SELECT request_event_id, request_month, request_weekday_iso, request_is_weekend, request_hour,
  request_is_outside_business_hours, request_daypart, event_is_very_last_minute, event_is_last_minute,
  event_is_long_lead, event_lead_time_bucket, round(prior_signature_rate, 6) AS prior_signature_rate,
  round(prior_days_since_last_request, 6) AS prior_days_since_last_request, product_is_multi,
  product_premium_count, product_has_premium, product_bundle_signature, option_quantity_total,
  request_total_items, event_request_completeness_score, event_missing_information_count,
  round(price_proposed - price_catalog_gross, 6) AS price_proposed_minus_gross,
  round(price_proposed / nullif(price_catalog_gross, 0), 6) AS price_proposed_to_gross_ratio,
  round(price_total_declared_discount / nullif(price_catalog_gross, 0), 6) AS price_discount_rate,
  CAST(greatest(seated, cocktail) AS DOUBLE) AS venue_capacity_max,
  coalesce((low + high) / 2, low, high) AS venue_price_midpoint
FROM (SELECT *, CASE WHEN request_event_id % 3 = 0 THEN request_event_id % 200 END AS seated,
  CASE WHEN request_event_id % 2 = 0 THEN request_event_id % 300 END AS cocktail,
  CASE WHEN request_event_id % 4 <> 0 THEN CAST(request_event_id % 5000 AS DOUBLE) END AS low,
  CASE WHEN request_event_id % 5 <> 0 THEN CAST(request_event_id % 7000 AS DOUBLE) END AS high FROM features)"""

ALIGNED = """
SELECT request_event_id, CAST(event_lead_time_days AS DOUBLE) AS event_lead_time_days,
  CAST(option_count AS DOUBLE) AS option_count, CAST(product_photobooth AS DOUBLE) AS product_photobooth,
  CAST(NULL AS DOUBLE) AS venue_rating, coalesce(event_city, 'INCONNU') AS event_city,
  coalesce(option_mur_floral_style, 'INCONNU') AS option_mur_floral_style,
  coalesce(request_source, 'INCONNU') AS request_source, 'INCONNU' AS venue_type
FROM quotes"""


def statements() -> dict[str, str]:
    tops = [top(c) for c in ("outcome_class", "outcome_current_status", "request_source")]
    return {
        "quality_profile": with_quotes(PROFILE),
        "top_values": with_quotes(" UNION ALL ".join(tops)),
        "missing_columns": with_quotes(" UNION ALL ".join(missing(c) for c in IMPORTANT)),
        "built_features": with_quotes(BUILT, FEATURES),
        "aligned_features": with_quotes(ALIGNED),
    }
