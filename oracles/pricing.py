"""Cost, price ladder, choice, availability and date-filling queries in plain SQL."""

from __future__ import annotations

from oracles.crm import AS_OF, with_quotes
from oracles.quality import FEATURES

CATALOGUE = """
catalogue(code, normal, cost, floor_price) AS (VALUES
  ('PHOTOBOOTH', 450.0::DOUBLE, 200.0::DOUBLE, 350.0::DOUBLE), ('MIROIRBOOTH', 550, 250, 400),
  ('BOOTH_360', 500, 250, 400), ('VOGUEBOOTH', 600, 250, 400), ('VOGUE_PRINT', 150, 100, 100),
  ('PHONEBOOTH', 50, 0, 0), ('LIVRE_VIDEO', 200, 20, 100), ('PANNEAU_FONTAINE', 200, 100, 100),
  ('FOND_LED', 100, 50, 50), ('MUR_FLORAL', 50, 0, 0), ('PORTE_CLES_100', 200, 100, 100),
  ('MAGNETS_100', 200, 100, 100), ('HOLOBOOTH', NULL, NULL, NULL), ('GLAMBOOTH', NULL, NULL, NULL),
  ('PACK_SOUVENIRS', 600, NULL, NULL), ('PACK_IMMERSION', 700, NULL, NULL), ('PACK_SIGNATURE', 800, NULL, NULL),
  ('PACK_DUO', 750, 370, 600), ('PACK_DUO_VIP', 850, NULL, NULL), ('PACK_PRESTIGE', NULL, NULL, NULL))"""

REQUESTS = """
requests AS (
  SELECT * REPLACE (CASE WHEN request_event_id % 19 <> 5 THEN price_catalog_gross END AS price_catalog_gross),
    request_event_id AS request_id,
    CASE request_event_id % 97 WHEN 3 THEN 'PACK_PRESTIGE' WHEN 4 THEN 'PACK_DUO' WHEN 5 THEN 'ABSENT' END
      AS catalogue_code,
    CASE WHEN request_event_id % 11 = 2 THEN CAST(request_event_id % 500 AS DOUBLE) END AS direct_cost_eur,
    CASE WHEN request_event_id % 13 = 4 THEN 700.0::DOUBLE END AS minimum_price_eur,
    CASE WHEN request_event_id % 17 = 6 THEN 900.0::DOUBLE END AS maximum_price_eur,
    CASE request_event_id % 23 WHEN 1 THEN 'fill_date' WHEN 2 THEN 'other' ELSE '' END AS priority,
    CASE WHEN request_event_id % 3 <> 0 THEN CAST(request_event_id % 5 AS INTEGER) END AS bookings_given,
    CASE request_event_id % 29 WHEN 3 THEN 'full' WHEN 4 THEN 'empty' END AS status_given,
    request_event_id % 4 <> 1 AS stock_known,
    CAST(request_event_id % 4 AS INTEGER) AS stock_photo, CAST(request_event_id % 3 AS INTEGER) AS stock_miroir,
    1 AS stock_360, CAST(request_event_id % 2 AS INTEGER) AS stock_vogue
  FROM features)"""

_ITEMS = [
    ("0", "catalogue_code IS NOT NULL", "catalogue_code", "1"),
    ("1", "duo", "'PACK_DUO'", "1"),
    ("2", "product_photobooth > 0", "'PHOTOBOOTH'", "product_photobooth"),
    ("3", "product_miroirbooth > 0 AND NOT duo", "'MIROIRBOOTH'", "product_miroirbooth"),
    ("4", "product_videobooth > 0 AND NOT duo", "'BOOTH_360'", "product_videobooth"),
    ("5", "product_voguebooth > 0", "'VOGUEBOOTH'", "product_voguebooth"),
    ("6", "option_phonebooth > 0", "'PHONEBOOTH'", "1"),
    ("7", "option_fond_360 > 0", "'FOND_LED'", "1"),
    ("8", "option_mur_floral > 0", "'MUR_FLORAL'", "1"),
    ("9", "option_panneau_fontaine > 0", "'PANNEAU_FONTAINE'", "1"),
    ("10", "option_video_livre_or > 0", "'LIVRE_VIDEO'", "1"),
    ("11", "option_porte_cles_quantity > 0", "'PORTE_CLES_100'", "ceil(option_porte_cles_quantity / 100.0)"),
    ("12", "option_magnets_quantity > 0", "'MAGNETS_100'", "ceil(option_magnets_quantity / 100.0)"),
]

ITEMS = (
    """
flagged AS (SELECT *, catalogue_code IS NULL AND product_miroirbooth > 0 AND product_videobooth > 0 AS duo
  FROM requests),
all_items AS (
  SELECT request_id, 0 AS slot, 'MANUAL_OVERRIDE' AS code, 1.0::DOUBLE AS quantity FROM flagged
    WHERE direct_cost_eur IS NOT NULL
"""
    + "".join(
        f"  UNION ALL SELECT request_id, {slot}, {code}, CAST({quantity} AS DOUBLE) FROM flagged"
        f" WHERE direct_cost_eur IS NULL AND {condition}\n"
        for slot, condition, code, quantity in _ITEMS
    )
    + """),
items AS (SELECT request_id, slot, code, quantity,
  CAST(row_number() OVER (PARTITION BY request_id ORDER BY slot) - 1 AS INTEGER) AS position FROM all_items)"""
)

COSTS = """
item_costs AS (
  SELECT i.request_id, COUNT(*) AS lines, SUM(c.cost * i.quantity) AS total,
    COUNT(*) FILTER (c.cost IS NULL) AS failing,
    arg_min(i.code, i.position) FILTER (c.cost IS NULL) AS failing_code,
    arg_min(c.code IS NULL, i.position) FILTER (c.cost IS NULL) AS failing_unknown,
    COUNT(*) FILTER (c.code IS NOT NULL AND c.normal IS NULL) AS without_normal,
    SUM(c.normal) AS normal
  FROM items i LEFT JOIN catalogue c ON c.code = i.code GROUP BY i.request_id),
statuses AS (
  SELECT f.*, c.lines, c.total, c.without_normal, c.normal, c.failing_code,
    CASE WHEN direct_cost_eur IS NOT NULL THEN 'OK'
      WHEN product_ipadbooth > 0 OR option_delivery > 0 OR option_duration_hours > 5 THEN 'MISSING_MANUAL_COST'
      WHEN c.lines IS NULL THEN 'NO_PRICED_ITEM' WHEN c.failing = 0 THEN 'OK'
      WHEN c.failing_unknown THEN 'UNKNOWN_CODE' ELSE 'COST_MISSING' END AS cost_status
  FROM flagged f LEFT JOIN item_costs c ON c.request_id = f.request_id),
costs AS (
  SELECT s.*,
    CASE WHEN s.direct_cost_eur IS NOT NULL THEN s.direct_cost_eur WHEN cost_status = 'OK' THEN s.total END
      AS direct_cost,
    coalesce(m.floor_price, 0) AS catalogue_floor,
    CASE WHEN cost_status = 'OK' AND s.direct_cost_eur IS NULL AND s.without_normal = 0 THEN s.normal END
      AS catalogue_gross,
    s.direct_cost_eur IS NULL AND s.catalogue_code IS NOT NULL AND (product_photobooth > 0
      OR product_miroirbooth > 0 OR product_videobooth > 0 OR product_voguebooth > 0) AS double_charge_risk
  FROM statuses s LEFT JOIN catalogue m ON m.code = coalesce(s.catalogue_code,
    CASE WHEN product_miroirbooth > 0 AND product_videobooth > 0 THEN 'PACK_DUO' END))"""

BOUNDS = """
grossed AS (SELECT *, CASE WHEN cost_status = 'OK' THEN
    CASE WHEN coalesce(price_catalog_gross, 0) > 0 THEN price_catalog_gross ELSE catalogue_gross END END AS gross_eur
  FROM costs),
minimums AS (SELECT *, CASE WHEN gross_eur IS NOT NULL THEN
    greatest(direct_cost + 150, catalogue_floor, coalesce(minimum_price_eur, 0)) END AS minimum_price FROM grossed),
maximums AS (SELECT *, CASE WHEN gross_eur IS NOT NULL THEN
    coalesce(maximum_price_eur, greatest(gross_eur, minimum_price) * 1.3::DOUBLE) END AS maximum_price FROM minimums),
bounds AS (SELECT *, CASE WHEN cost_status <> 'OK' THEN cost_status WHEN gross_eur IS NULL THEN 'GROSS_REQUIRED'
    WHEN first_price > last_price THEN 'NO_PRICE_IN_RANGE' ELSE 'OK' END AS price_status
  FROM (SELECT *, CAST(ceil((minimum_price - 90) / 100) AS BIGINT) * 100 + 90 AS first_price,
    CAST(floor((floor(maximum_price) - 90) / 100) AS BIGINT) * 100 + 90 AS last_price FROM maximums))"""

LADDER = """
ladder AS (SELECT *, greatest(gross_eur - price_eur, 0) AS discount FROM (
  SELECT *, unnest(range(first_price, last_price + 1, 100)) AS price_eur FROM bounds WHERE price_status = 'OK')),
discounted AS (
  SELECT *, least(price_option_discount, discount) AS option_part,
    least(price_product_discount, discount - least(price_option_discount, discount)) AS product_part FROM ladder),
raw AS (
  SELECT *, 1 / (1 + exp(-(3.4::DOUBLE - 3.1::DOUBLE * (price_eur / gross_eur) + 0.4::DOUBLE * prior_signature_rate
    + 0.3::DOUBLE * request_is_business - 0.001::DOUBLE * event_lead_time_days
    + 0.3::DOUBLE * (CAST(floor(price_eur / 100) AS BIGINT) % 3)))) AS raw_probability FROM discounted),
guarded AS (
  SELECT *, least(1.0::DOUBLE, MIN(raw_probability) OVER (PARTITION BY request_id ORDER BY price_eur)) AS p FROM raw),
candidates AS (
  SELECT *, round_even(p, 4) AS signature_probability, round_even(raw_probability, 4) AS raw_model_probability,
    round_even(price_eur - direct_cost, 2) AS direct_margin_eur,
    round_even(p * (price_eur - direct_cost), 2) AS expected_direct_margin_eur,
    p >= 0.6 AS meets_probability_floor FROM guarded)"""

CHOICE = """
signals AS (
  SELECT request_id, COUNT(*) AS tested,
    arg_min(raw_model_probability, price_eur) - arg_max(raw_model_probability, price_eur) AS drop,
    COUNT(*) FILTER (price_eur <= gross_eur * 1.1::DOUBLE) AS under_cap,
    arg_min(price_eur, struct_pack(a := abs(price_eur - gross_eur), b := price_eur)) AS nearest
  FROM candidates GROUP BY request_id),
allowed AS (
  SELECT c.*, s.tested, s.drop, s.drop >= 0.05::DOUBLE AS reliable FROM candidates c
  JOIN signals s ON s.request_id = c.request_id
  WHERE s.drop >= 0.05::DOUBLE OR (s.under_cap > 0 AND c.price_eur <= c.gross_eur * 1.1::DOUBLE)
    OR (s.under_cap = 0 AND c.price_eur = s.nearest)),
marked AS (
  SELECT *, MAX(expected_direct_margin_eur) FILTER (meets_probability_floor) OVER (PARTITION BY request_id) AS best
  FROM allowed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY
    CASE WHEN best IS NULL THEN signature_probability
      WHEN meets_probability_floor AND expected_direct_margin_eur >= best * (1 - 0.05::DOUBLE)
      THEN price_eur ELSE -1 END DESC, price_eur) AS place FROM marked),
chosen AS (
  SELECT *, best IS NOT NULL AS satisfied, coalesce(nullif(concat_ws(' ',
    CASE WHEN NOT reliable THEN 'L''historique ne prouve pas encore suffisamment l''effet du prix. '
      || 'La recommandation est limitée à +10 % du prix catalogue.' END,
    CASE WHEN best IS NULL THEN 'Aucun candidat n''atteint la probabilité minimale de 60%.' END), ''),
    'Validation humaine obligatoire pendant la phase pilote.') AS reason
  FROM ranked WHERE place = 1)"""

_REQUESTED = [
    ("PHOTOBOOTH", "product_photobooth", "stock_photo"),
    ("MIROIRBOOTH", "product_miroirbooth", "stock_miroir"),
    ("BOOTH_360", "product_videobooth", "stock_360"),
    ("VOGUEBOOTH", "product_voguebooth", "stock_vogue"),
    ("IPADBOOTH", "product_ipadbooth", "NULL"),
]


def _list(condition: str, with_request: bool) -> str:
    parts = []
    for code, asked, stock in _REQUESTED:
        shown = f"coalesce(CAST({stock} AS VARCHAR), '?')"
        text = f"'{code}:' || " + (f"{asked} || ':' || {shown}" if with_request else shown)
        parts.append(f"CASE WHEN {condition.format(asked=asked, stock=stock)} THEN {text} END")
    return f"CASE WHEN stock_known THEN concat_ws(',', {', '.join(parts)}) ELSE '' END"


_SHORT = "{asked} > 0 AND ({stock} IS NULL OR {stock} < {asked})"

AVAILABILITY = f"""
stocked AS (
  SELECT *, {_list("{asked} > 0", True)} AS requested_products,
    {_list(_SHORT, True)} AS unavailable_requested_products,
    {_list("{stock} > 0 AND {asked} = 0", False)} AS alternative_products FROM requests),
available AS (
  SELECT request_id, CASE WHEN stock_known THEN 'KNOWN' ELSE 'UNKNOWN' END AS availability_status,
    CASE WHEN stock_known THEN unavailable_requested_products = '' END AS requested_products_available,
    requested_products, unavailable_requested_products, alternative_products FROM stocked)"""

STRATEGY = """
dated AS (
  SELECT request_id, priority, bookings_given, greatest(coalesce(bookings_given, 0), 0) AS bookings_on_date,
    coalesce(status_given, CASE WHEN bookings_given IS NULL THEN 'unknown' WHEN bookings_given <= 0 THEN 'empty'
      ELSE 'occupied' END) AS date_booking_status, greatest(event_lead_time_days, 0) AS days_before_event
  FROM requests),
strategies AS (
  SELECT request_id, CASE WHEN priority = 'fill_date' THEN 'fill_date'
    WHEN (date_booking_status = 'empty' OR bookings_given = 0) AND days_before_event <= 45 THEN 'fill_date'
    WHEN date_booking_status IN ('busy', 'nearly_full', 'full') THEN 'maximize_expected_margin'
    ELSE 'balanced' END AS pricing_objective,
    CASE WHEN priority = 'fill_date' THEN 'explicit' ELSE 'automatic' END AS objective_source,
    date_booking_status, bookings_on_date, days_before_event FROM dated)"""

STOCK_CHOICE = """
fill AS (
  SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.request_id ORDER BY c.signature_probability DESC,
      c.expected_direct_margin_eur DESC, c.price_eur) AS spot
    FROM candidates c JOIN signals s ON s.request_id = c.request_id
    WHERE c.signature_probability >= 0.6 AND c.direct_margin_eur >= 150
      AND (s.drop >= 0.05::DOUBLE OR c.price_eur <= c.gross_eur * 1.1::DOUBLE)) WHERE spot = 1)
SELECT r.request_id, CASE WHEN gone THEN 'PRODUCT_UNAVAILABLE' ELSE e.price_status END AS recommendation_status,
  CAST(r.event_date AS VARCHAR) AS event_date,
  CASE WHEN gone THEN NULL WHEN used THEN f.price_eur ELSE e.recommended_price_eur END AS recommended_price_eur,
  CASE WHEN NOT gone THEN e.all_constraints_satisfied END AS all_constraints_satisfied,
  CASE WHEN gone THEN NULL WHEN used THEN f.signature_probability ELSE e.estimated_signature_probability END
    AS estimated_signature_probability,
  CASE WHEN gone THEN NULL WHEN used THEN f.direct_margin_eur ELSE e.estimated_direct_margin_eur END
    AS estimated_direct_margin_eur,
  CASE WHEN gone THEN NULL WHEN used THEN f.expected_direct_margin_eur ELSE e.estimated_expected_direct_margin_eur END
    AS estimated_expected_direct_margin_eur,
  CASE WHEN NOT gone THEN e.price_catalog_gross_eur END AS price_catalog_gross_eur,
  CASE WHEN NOT gone THEN e.direct_cost_eur END AS direct_cost_eur,
  CASE WHEN NOT gone THEN e.catalogue_floor_price_eur END AS catalogue_floor_price_eur,
  CASE WHEN NOT gone THEN e.price_signal_reliable END AS price_signal_reliable,
  CASE WHEN NOT gone THEN e.probability_drop_across_tested_range END AS probability_drop_across_tested_range,
  CASE WHEN gone THEN 'Au moins un produit demandé est indisponible à cette date. '
      || 'Proposer un produit disponible ou une autre date avant de calculer le prix.'
    WHEN used THEN e.review_reason || ' Date vide ou prioritaire : le prix favorise la signature sans '
      || 'descendre sous 150 € de marge directe.' ELSE e.review_reason END AS review_reason,
  r.pricing_objective, r.pricing_objective = 'fill_date' AS fill_date_mode, r.availability_status,
  CASE WHEN gone THEN 0 ELSE e.tested END AS tested
FROM (SELECT q.request_id, q.event_date, s.pricing_objective, a.availability_status,
    coalesce(NOT a.requested_products_available, false) AS gone
  FROM requests q JOIN strategies s ON s.request_id = q.request_id JOIN available a ON a.request_id = q.request_id) r
JOIN every_request e ON e.request_id = r.request_id
LEFT JOIN fill f ON f.request_id = r.request_id
CROSS JOIN LATERAL (SELECT coalesce(r.pricing_objective = 'fill_date' AND e.all_constraints_satisfied = 'true'
  AND f.price_eur IS NOT NULL, false) AS used) u"""

_BOOKED = ["photobooth", "miroirbooth", "videobooth", "voguebooth", "ipadbooth"]
_OWNED = {"photobooth": 6, "miroirbooth": 3, "videobooth": 3, "voguebooth": 2, "ipadbooth": 1}
_CODES = dict(zip(_BOOKED, ["photobooth", "miroirbooth", "booth_360", "voguebooth", "ipadbooth"], strict=True))


def _free(product: str) -> str:
    return f"greatest({_OWNED[product]} - b_{product}, 0)"


STOCK_AS_OF = f"""
booked AS (
  SELECT q.request_event_id, COUNT(b.request_event_id) AS bookings_on_date,
    {", ".join(f"CAST(coalesce(SUM(b.product_{p}), 0) AS BIGINT) AS b_{p}" for p in _BOOKED)}
  FROM quotes q LEFT JOIN quotes b ON b.event_date = q.event_date AND b.signed_at_utc < q.request_created_at_utc
  GROUP BY q.request_event_id)
SELECT q.request_event_id, bookings_on_date,
  {" + ".join(f"CASE WHEN product_{p} > 0 THEN b_{p} ELSE 0 END" for p in _BOOKED)} AS date_requested_product_bookings,
  round(({" + ".join(f"b_{p}" for p in _BOOKED)}) / 15.0::DOUBLE, 6) AS date_utilization_ratio,
  round(({" + ".join(f"CASE WHEN product_{p} > 0 AND {_free(p)} >= product_{p} THEN 1 ELSE 0 END" for p in _BOOKED)})
    / nullif({" + ".join(f"CAST(product_{p} > 0 AS INTEGER)" for p in _BOOKED)}, 0)::DOUBLE, 6)
    AS available_requested_product_ratio,
  {", ".join(f"CAST({_free(p)} AS INTEGER) AS free_{_CODES[p]}" for p in _BOOKED)}
FROM quotes q JOIN booked k ON k.request_event_id = q.request_event_id"""

MESSAGES = """
messages AS (
  SELECT request_id, price_status,
    CASE price_status WHEN 'MISSING_MANUAL_COST' THEN 'Coût direct manquant pour : ' || concat_ws(', ',
        CASE WHEN product_ipadbooth > 0 THEN 'iPadBooth' END, CASE WHEN option_delivery > 0 THEN 'Livraison' END,
        CASE WHEN option_duration_hours > 5 THEN 'Durée supérieure à 5 heures' END)
        || '. Renseignez direct_cost_eur dans la demande ou complétez le catalogue.'
      WHEN 'NO_PRICED_ITEM' THEN 'Aucune prestation tarifée détectée. Renseignez les product_*, catalogue_code '
        || 'ou direct_cost_eur.'
      WHEN 'UNKNOWN_CODE' THEN 'Code absent du catalogue : ' || failing_code
      WHEN 'COST_MISSING' THEN 'Coût direct absent pour ' || failing_code
        || '. Complétez le catalogue ou fournissez direct_cost_eur.'
      WHEN 'GROSS_REQUIRED' THEN 'price_catalog_gross doit être renseigné.'
      ELSE printf('Aucun prix finissant par 90 entre %.2f € et %.2f €.', minimum_price, maximum_price) END AS price_error
  FROM bounds WHERE price_status <> 'OK')"""

EVERY_REQUEST = """
every_request AS (
  SELECT b.request_id, b.price_status, c.price_eur AS recommended_price_eur,
    CAST(c.satisfied AS VARCHAR) AS all_constraints_satisfied, c.signature_probability AS estimated_signature_probability,
    c.direct_margin_eur AS estimated_direct_margin_eur,
    c.expected_direct_margin_eur AS estimated_expected_direct_margin_eur, b.gross_eur AS price_catalog_gross_eur,
    b.direct_cost AS direct_cost_eur, b.catalogue_floor AS catalogue_floor_price_eur,
    CAST(c.reliable AS VARCHAR) AS price_signal_reliable, round_even(c.drop, 4) AS probability_drop_across_tested_range,
    coalesce(c.reason, m.price_error) AS review_reason, coalesce(c.tested, 0) AS tested
  FROM bounds b LEFT JOIN chosen c ON c.request_id = b.request_id LEFT JOIN messages m ON m.request_id = b.request_id)"""

DOCUMENTS = """
SELECT request_id, request_month, request_weekday_iso, request_hour, request_daypart,
  CAST(event_lead_time_days AS DOUBLE) AS event_lead_time_days, event_is_very_last_minute, event_is_last_minute,
  event_is_long_lead, event_lead_time_bucket, round(prior_signature_rate, 6) AS prior_signature_rate,
  round(prior_days_since_last_request, 6) AS prior_days_since_last_request,
  CAST(product_count AS DOUBLE) AS product_count, product_is_multi, product_premium_count, product_bundle_signature,
  option_quantity_total, request_total_items, event_request_completeness_score
FROM requests WHERE request_id % 41 NOT IN (7, 8)"""


def statements() -> dict[str, str]:
    base = [FEATURES, REQUESTS]
    costed = [*base, CATALOGUE, ITEMS, COSTS]
    bounded = [*costed, BOUNDS]
    laddered = [*bounded, LADDER]
    chosen = [*laddered, CHOICE]
    return {
        "cost_items": with_quotes("SELECT request_id, position, code, quantity FROM items", *base, ITEMS),
        "direct_costs": with_quotes(
            "SELECT request_id, cost_status, direct_cost, catalogue_floor, catalogue_gross, double_charge_risk, "
            "CAST(CASE WHEN cost_status = 'OK' THEN coalesce(lines, 1) ELSE 0 END AS INTEGER) AS cost_lines FROM costs",
            *costed,
        ),
        "price_bounds": with_quotes(
            "SELECT request_id, price_status, gross_eur, minimum_price, round(maximum_price, 6) AS maximum_price, "
            "first_price, last_price FROM bounds",
            *bounded,
        ),
        "candidate_discounts": with_quotes(
            "SELECT request_id, price_eur, round(option_part, 6) AS price_option_discount, "
            "round(product_part, 6) AS price_product_discount, "
            "round(greatest(discount - option_part - product_part, 0), 6) AS price_global_discount, "
            "round(discount, 6) AS price_total_declared_discount FROM discounted",
            *laddered,
        ),
        "scored_candidates": with_quotes(
            "SELECT request_id, price_eur, signature_probability, raw_model_probability, direct_margin_eur, "
            "expected_direct_margin_eur, meets_probability_floor FROM candidates",
            *laddered,
        ),
        "recommendations": with_quotes("SELECT * FROM every_request", *chosen, MESSAGES, EVERY_REQUEST),
        "request_features": with_quotes(DOCUMENTS, *base),
        "request_recommendations": with_quotes(
            "SELECT * FROM every_request WHERE request_id % 41 NOT IN (7, 8)", *chosen, MESSAGES, EVERY_REQUEST
        ),
        "request_rejects": with_quotes(
            "SELECT request_id, CASE request_id % 41 WHEN 7 THEN 'BROKEN_JSON' ELSE 'NOT_AN_OBJECT' END AS reason "
            "FROM requests WHERE request_id % 41 IN (7, 8)",
            *base,
        ),
        "rejected_requests": with_quotes("SELECT * FROM messages", *bounded, MESSAGES),
        "availability": with_quotes(
            "SELECT * REPLACE (CAST(requested_products_available AS VARCHAR) AS requested_products_available) "
            "FROM available",
             *base, AVAILABILITY,
        ),
        "pricing_strategy": with_quotes(
            "SELECT *, pricing_objective = 'fill_date' AS fill_date_mode FROM strategies", *base, STRATEGY
        ),
        "stock_recommendations": with_quotes(
            STOCK_CHOICE.split("SELECT r.request_id", 1)[1].join(["SELECT r.request_id", ""]),
            *chosen,
            MESSAGES,
            EVERY_REQUEST,
            AVAILABILITY,
            STRATEGY,
            STOCK_CHOICE.split("SELECT r.request_id", 1)[0],
        ),
        "stock_as_of": with_quotes(
            STOCK_AS_OF.split("SELECT q.request_event_id, bookings_on_date", 1)[1].join(
                ["SELECT q.request_event_id, bookings_on_date", ""]
            ),
            STOCK_AS_OF.split("SELECT q.request_event_id, bookings_on_date", 1)[0],
        ),
    }


__all__ = ["AS_OF", "statements"]
