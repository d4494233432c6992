"""Split, metric and pilot queries in plain SQL."""

from __future__ import annotations

from oracles.crm import with_quotes
from oracles.quality import FEATURES

TRAINABLE = "target_price_training_eligible = 1 AND price_proposed IS NOT NULL"

SCORED = f"""
scored AS (
  SELECT request_event_id, request_created_at_utc, target_signed AS y, 1 / (1 + exp(-(3.4::DOUBLE
    - 3.1::DOUBLE * (price_proposed / price_catalog_gross) + 0.4::DOUBLE * prior_signature_rate
    + 0.3::DOUBLE * request_is_business - 0.001::DOUBLE * event_lead_time_days
    + 0.3::DOUBLE * (CAST(floor(price_proposed / 100) AS BIGINT) % 3)))) AS p
  FROM features WHERE {TRAINABLE})"""

SPLIT = f"""
split AS (
  SELECT *, row_number() OVER (ORDER BY request_created_at_utc, request_event_id)
    <= CAST(floor(COUNT(*) OVER () * (1 - 0.2::DOUBLE)) AS BIGINT) AS older
  FROM quotes WHERE {TRAINABLE})"""

METRICS = """
SELECT round(AVG((p - y) * (p - y)), 6) AS brier_score,
  round(-AVG(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss, COUNT(*) AS validation_rows,
  round(AVG(y), 6) AS validation_signature_rate, round(AVG(p), 6) AS mean_predicted_probability,
  (SELECT round(SUM(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END)::DOUBLE / COUNT(*), 6)
    FROM scored a JOIN scored b ON a.y = 1 AND b.y = 0) AS roc_auc,
  (SELECT round(SUM(y * tp / n) / SUM(y), 6) FROM (SELECT y, SUM(y) OVER w AS tp, COUNT(*) OVER w AS n FROM scored
    WINDOW w AS (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS average_precision
FROM scored"""

SELECTION = """
parts AS (SELECT s.*, s.p * 0.8::DOUBLE + 0.1::DOUBLE AS q, k.older FROM scored s JOIN split k
  ON k.request_event_id = s.request_event_id),
rate AS (SELECT AVG(y) AS r FROM parts WHERE older),
measured AS (SELECT AVG((p - y) * (p - y)) AS a, AVG((q - y) * (q - y)) AS b, AVG((r - y) * (r - y)) AS n,
  -AVG(y * ln(r) + (1 - y) * ln(1 - r)) AS nl, MAX(r) AS r FROM parts, rate WHERE NOT older)
"""


_CATEGORIES = [
    "request_source", "request_daypart", "event_postal_code", "event_city", "event_venue_anonymous_key",
    "event_lead_time_bucket", "product_bundle_signature",
]
COUNTED = "counted AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce({c}, 'INCONNU') AS value, COUNT(*) AS rows FROM features WHERE {TRAINABLE} GROUP BY 2"
    for c in _CATEGORIES
) + ")"
SLOTS = """
SELECT feature, value, rows, CAST(CASE WHEN rows >= 2
  THEN row_number() OVER (PARTITION BY feature, rows >= 2 ORDER BY value) - 1
  ELSE COUNT(*) FILTER (rows >= 2) OVER (PARTITION BY feature) END AS INTEGER) AS slot
FROM counted"""


def statements() -> dict[str, str]:
    return {
        "category_slots": with_quotes(SLOTS, FEATURES, COUNTED),
        "trainable_rows": with_quotes(
            f"SELECT request_event_id, target_signed, price_proposed FROM quotes WHERE {TRAINABLE}"
        ),
        "class_counts": with_quotes(
            f"SELECT target_signed, COUNT(*) AS rows FROM quotes WHERE {TRAINABLE} GROUP BY target_signed"
        ),
        "temporal_split": with_quotes(
            "SELECT request_event_id, CASE WHEN older THEN 'train' ELSE 'validation' END AS part FROM split", SPLIT
        ),
        "scored_metrics": with_quotes(METRICS, FEATURES, SCORED),
        "model_selection": with_quotes(
            """SELECT CASE WHEN a <= least(a, b) * 1.01::DOUBLE THEN 'logistic_regression' ELSE 'random_forest' END
              AS selected_model, round(a, 6) AS brier_logistic, round(b, 6) AS brier_forest,
              round(r, 6) AS naive_probability, round(n, 6) AS naive_brier, round(nl, 6) AS naive_log_loss,
              CASE WHEN (CASE WHEN a <= least(a, b) * 1.01::DOUBLE THEN a ELSE b END) < n THEN 'PASS'
                ELSE 'FAIL_MODEL_NOT_BETTER_THAN_BASELINE' END AS validation_status FROM measured""",
            FEATURES,
            SCORED,
            SPLIT,
            SELECTION,
        ),
        "reliability": with_quotes(
            """SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS band, COUNT(*) AS rows,
              round(AVG(p), 6) AS mean_predicted, round(AVG(y), 6) AS observed_rate FROM scored GROUP BY 1""",
            FEATURES,
            SCORED,
        ),
        "pilot_kpis": with_quotes(
            """SELECT CASE WHEN request_event_id % 2 = 0 THEN 'control' ELSE 'model' END AS arm, COUNT(*) AS requests,
              COUNT(*) FILTER (target_signed = 1) AS signed,
              round(CAST(COUNT(*) FILTER (target_signed = 1) AS DOUBLE) / COUNT(*), 4) AS signature_rate,
              round(AVG(signed_price) FILTER (target_signed = 1), 4) AS signed_basket,
              round(SUM(signed_price - product_count * 100) FILTER (target_signed = 1), 4) AS direct_margin,
              round(SUM(signed_price - product_count * 100) FILTER (target_signed = 1) / COUNT(*), 4)
                AS direct_margin_per_request,
              COUNT(*) FILTER (request_event_id % 40 = 0 AND target_signed = 1) AS cancellations
            FROM quotes GROUP BY 1"""
        ),
    }
