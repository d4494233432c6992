"""Names of the features known before a quote is sent. Fixed values, given as plain lists."""

CATEGORICAL_FEATURES = [
    "request_source",
    "request_daypart",
    "event_postal_code",
    "event_city",
    "event_venue_anonymous_key",
    "event_lead_time_bucket",
    "product_bundle_signature",
    "option_mur_floral_style",
    "venue_type",
]

NUMERIC_FEATURES = [
    "request_is_business",
    "request_month",
    "request_weekday_iso",
    "request_is_weekend",
    "request_hour",
    "request_is_outside_business_hours",
    "prior_request_count",
    "prior_signed_count",
    "prior_is_returning_client",
    "prior_days_since_last_request",
    "prior_signature_rate",
    "event_month",
    "event_quarter",
    "event_weekday_iso",
    "event_is_weekend",
    "event_lead_time_days",
    "event_is_very_last_minute",
    "event_is_last_minute",
    "event_is_long_lead",
    "event_has_schedule",
    "event_has_client_comment",
    "event_client_comment_length",
    "event_request_completeness_score",
    "event_missing_information_count",
    "enrichment_address_available",
    "product_count",
    "product_is_multi",
    "product_premium_count",
    "product_has_premium",
    "option_count",
    "option_quantity_total",
    "request_total_items",
    "price_catalog_gross",
    "price_product_discount",
    "price_global_discount",
    "price_option_discount",
    "price_total_declared_discount",
    "price_discount_rate",
    "price_proposed",
    "price_proposed_minus_gross",
    "price_proposed_to_gross_ratio",
    "venue_match_confidence",
    "venue_is_private_address",
    "venue_capacity_seated",
    "venue_capacity_cocktail",
    "venue_capacity_max",
    "venue_rating",
    "venue_review_count",
    "venue_price_min",
    "venue_price_max",
    "venue_price_midpoint",
    "venue_has_official_website",
    "venue_premium_score",
    "venue_notability_score",
    "venue_enrichment_sources_count",
    "bookings_on_date",
    "date_requested_product_bookings",
    "date_utilization_ratio",
    "available_requested_product_ratio",
    "event_distance_km",
    "event_travel_time_minutes",
    "event_toll_cost_eur",
]

PREMIUM_PRODUCTS = ["product_miroirbooth", "product_videobooth", "product_voguebooth"]

UNKNOWN = "INCONNU"
NO_PRODUCT = "AUCUN_PRODUIT"

# First and last hour of each part of the day.
DAYPARTS = [("NUIT", 0, 5), ("MATIN", 6, 11), ("APRES_MIDI", 12, 17), ("SOIR", 18, 23)]

# Closed whole-day ranges: a value between two ranges, such as 7.5, belongs to none.
LEAD_BUCKETS = [
    ("0_7_JOURS", 0, 7),
    ("8_14_JOURS", 8, 14),
    ("15_30_JOURS", 15, 30),
    ("31_60_JOURS", 31, 60),
    ("61_120_JOURS", 61, 120),
    ("121_180_JOURS", 121, 180),
]
LEAD_PAST = "DATE_PASSEE_OU_INVALIDE"
LEAD_FAR = "PLUS_180_JOURS"

# Filled mostly after signing, so they tell the outcome; removable on request.
LEAKY_FEATURES = [
    "event_has_schedule",
    "event_request_completeness_score",
    "event_missing_information_count",
]
