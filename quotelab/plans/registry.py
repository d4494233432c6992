"""Named queries over the star-schema tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelab.config import Config
from quotelab.functions.words import normalize_text
from quotelab.operators import (
    costing,
    evaluation,
    export,
    features,
    history,
    ladder,
    profile,
    stock_rules,
    training,
    venues,
)
from quotelab.operators.evaluation import CREATED
from quotelab.plans import train
from quotelab.plans.requests import STOCK, as_requests, fixed_scorer
from quotelab.session import configure, materialize, work_path
from quotelab.sources import files
from quotelab.sources.star_schema import (
    AS_OF,
    crm_tables,
    lookup_places,
    source_tables,
    venue_overrides,
)

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Money as double and instants without zone, so that other engines compare equal."""
    casts = {}
    for field in df.schema:
        if isinstance(field.dataType, T.DecimalType):
            casts[field.name] = F.col(field.name).cast("double")
        elif isinstance(field.dataType, T.TimestampType):
            casts[field.name] = F.col(field.name).cast("timestamp_ntz")
    return df.withColumns(casts) if casts else df


_PLANS: dict = {}


def _once(spark: SparkSession, name: str, folder: str, make: Callable[[], object]):
    """Build a shared plan or table once per session and folder."""
    place = (spark.sparkContext.applicationId, name, folder)
    if place not in _PLANS:
        _PLANS[place] = make()
    return _PLANS[place]


def _tables(spark: SparkSession, folder: str):
    return _once(spark, "tables", folder, lambda: crm_tables(spark, folder))


def _crm(make: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, folder: plain(make(_tables(spark, folder)))


def _on_quotes(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: plain(make(_quotes(spark, folder)))


def _quotes(spark: SparkSession, folder: str) -> DataFrame:
    """The quote history, written once like the export file that all later steps start from."""

    def make() -> DataFrame:
        return materialize(
            export.quote_rows(_tables(spark, folder), AS_OF, after_quote=False), "quotes"
        )

    return _once(spark, "quotes", folder, make)


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, "requests", folder, lambda: as_requests(_quotes(spark, folder)))


def crm_queries() -> dict[str, Query]:
    event_columns = [
        "id", "num_devis", "created_at", "client_id", "event_product_id", "status", "signer_at",
        "prix_brut", "prix_proposed", "prix_valided",
    ]
    return {
        "crm_events": _crm(lambda t: t["app_event"].select(*event_columns)),
        "status_quality": _crm(lambda t: export.status_quality(t["app_event"])),
        "email_stats": _crm(lambda t: export.email_stats(t["app_emailtracking"])),
        "followup_stats": _crm(lambda t: export.followup_stats(t["app_eventrelance"])),
        "prior_history": _crm(lambda t: history.prior_history(t["app_event"])),
        "outcome_classes": _crm(
            lambda t: export.outcomes(t["app_event"], t["app_eventdetails"], AS_OF)
        ),
        "wide_quotes": _crm(lambda t: export.wide_quotes(t, AS_OF)),
        "public_quotes": _on_quotes(export.drop_private),
        "cost_lines": _crm(lambda t: export.cost_lines(t["app_cost"], t["app_namecost"])),
        "export_summary": _crm(lambda t: export.export_summary(t, AS_OF)),
    }


def profile_queries() -> dict[str, Query]:
    counted = ["outcome_class", "outcome_current_status", "request_source"]
    return {
        "quality_profile": _on_quotes(profile.profile),
        "top_values": _on_quotes(lambda q: profile.top_values_report(q, counted)),
        "missing_columns": _on_quotes(profile.missingness),
    }


BUILT_FEATURES = [
    "request_month", "request_weekday_iso", "request_is_weekend", "request_hour",
    "request_is_outside_business_hours", "request_daypart", "event_is_very_last_minute",
    "event_is_last_minute", "event_is_long_lead", "event_lead_time_bucket", "prior_signature_rate",
    "prior_days_since_last_request", "product_is_multi", "product_premium_count", "product_has_premium",
    "product_bundle_signature", "option_quantity_total", "request_total_items",
    "event_request_completeness_score", "event_missing_information_count", "price_proposed_minus_gross",
    "price_proposed_to_gross_ratio", "price_discount_rate", "venue_capacity_max", "venue_price_midpoint",
]
ALIGNED_NUMERIC = ["event_lead_time_days", "option_count", "product_photobooth", "venue_rating"]
ALIGNED_CATEGORIES = ["event_city", "option_mur_floral_style", "request_source", "venue_type"]


def _built(quotes: DataFrame) -> DataFrame:
    """All derived features; two made-up venue columns exercise the one-sided cases."""
    key = F.col("request_event_id")
    with_venue = quotes.withColumns(
        {
            "venue_capacity_seated": F.when(key % 3 == 0, key % 200).cast("int"),
            "venue_capacity_cocktail": F.when(key % 2 == 0, key % 300).cast("int"),
            "venue_price_min": F.when(key % 4 != 0, (key % 5000).cast("double")),
            "venue_price_max": F.when(key % 5 != 0, (key % 7000).cast("double")),
        }
    )
    return _rounded(features.prepare_features(with_venue).select("request_event_id", *BUILT_FEATURES))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, since engines may differ in the last bits."""
    return df.withColumns(
        {f.name: F.round(f.name, places) for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    )


def feature_queries() -> dict[str, Query]:
    return {
        "built_features": _on_quotes(_built),
        "aligned_features": _on_quotes(
            lambda q: features.align_features(
                q, ALIGNED_NUMERIC, ALIGNED_CATEGORIES, keep=["request_event_id"]
            )
        ),
    }


CONFIG = Config()
KEY = "request_id"


def _priced(make) -> Query:
    """A query over requests derived from the quotes, with the built-in price list."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        catalogue = costing.default_catalogue(spark)
        return plain(_rounded(make(_requests(spark, folder), catalogue)))

    return run


def _items(requests: DataFrame, _catalogue: DataFrame) -> DataFrame:
    return costing.cost_items(requests).select(
        KEY, F.posexplode("items").alias("position", "item")
    ).select(KEY, "position", "item.code", "item.quantity")


def _costs(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    return costing.direct_cost(requests, catalogue, KEY).select(
        KEY, "cost_status", "direct_cost", "catalogue_floor", "catalogue_gross", "double_charge_risk",
        F.size(F.coalesce("cost_details", F.array())).alias("cost_lines"),
    )


def _bounds(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    return ladder.bounds_of(requests, catalogue, CONFIG, KEY).select(
        KEY, "price_status", "gross_eur", "minimum_price", "maximum_price", "first_price", "last_price"
    )


def _discounts(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    prices = ladder.price_ladder(ladder.bounds_of(requests, catalogue, CONFIG, KEY), CONFIG)
    return ladder.apply_discounts(prices).select(
        KEY, "price_eur", "price_option_discount", "price_product_discount", "price_global_discount",
        "price_total_declared_discount",
    )


def _candidates(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    return ladder.candidates_of(requests, catalogue, fixed_scorer, CONFIG, KEY).select(
        KEY, *ladder.CANDIDATE
    )


FLAT = [
    "recommended_price_eur", "all_constraints_satisfied", "estimated_signature_probability",
    "estimated_direct_margin_eur", "estimated_expected_direct_margin_eur", "price_catalog_gross_eur",
    "direct_cost_eur", "catalogue_floor_price_eur", "price_signal_reliable",
    "probability_drop_across_tested_range", "review_reason",
]


# Unset where a request has no price; as text, since engines differ in how they show a missing truth value.
UNSET = ["all_constraints_satisfied", "price_signal_reliable"]


def _recommendations(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    priced = ladder.recommend(requests, catalogue, fixed_scorer, CONFIG, KEY, as_of=AS_OF)
    return priced.withColumns({c: F.col(c).cast("string") for c in UNSET}).select(
        KEY, "price_status", *FLAT, F.size("tested_candidates").cast("long").alias("tested")
    )


def _rejected(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    return ladder.rejected(ladder.bounds_of(requests, catalogue, CONFIG, KEY), KEY)


def _listed(column: str, *fields: str):
    """Array of structs as one text, for comparison across engines."""
    return F.array_join(
        F.transform(
            column,
            lambda e: F.concat_ws(":", *[F.coalesce(e[f].cast("string"), F.lit("?")) for f in fields]),
        ),
        ",",
    ).alias(column)


def _availability(requests: DataFrame, _catalogue: DataFrame) -> DataFrame:
    return stock_rules.availability(requests).select(
        KEY, "availability_status", F.col("requested_products_available").cast("string"),
        _listed("requested_products", "code", "requested_quantity", "available_quantity"),
        _listed("unavailable_requested_products", "code", "requested_quantity", "available_quantity"),
        _listed("alternative_products", "code", "available_quantity"),
    )


def _strategies(requests: DataFrame, _catalogue: DataFrame) -> DataFrame:
    return stock_rules.strategy(requests, CONFIG, AS_OF).select(KEY, *stock_rules.STRATEGY)


def _stock_recommendations(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    priced = stock_rules.recommend_with_stock(
        requests, catalogue, fixed_scorer, CONFIG, KEY, AS_OF
    )
    return priced.withColumns({c: F.col(c).cast("string") for c in UNSET}).select(
        KEY, "recommendation_status", "event_date", *FLAT, "pricing_objective", "fill_date_mode",
        "availability_status", F.size("tested_candidates").cast("long").alias("tested"),
    )


def _stock_as_of(quotes: DataFrame) -> DataFrame:
    stocked = history.stock_as_of(quotes, STOCK)
    free = [
        F.col("available_products")[code].alias(f"free_{code.lower()}") for code in sorted(STOCK)
    ]
    return _rounded(
        stocked.select(
            "request_event_id", "bookings_on_date", "date_requested_product_bookings",
            "date_utilization_ratio", "available_requested_product_ratio", *free,
        )
    )


DOCUMENT_FEATURES = [
    "request_month", "request_weekday_iso", "request_hour", "request_daypart", "event_lead_time_days",
    "event_is_very_last_minute", "event_is_last_minute", "event_is_long_lead", "event_lead_time_bucket",
    "prior_signature_rate", "prior_days_since_last_request", "product_count", "product_is_multi",
    "product_premium_count", "product_bundle_signature", "option_quantity_total", "request_total_items",
    "event_request_completeness_score",
]


def _request_lines(spark: SparkSession, folder: str) -> str:
    """The requests written as JSON lines, some without what can be derived, some broken."""

    def make() -> str:
        requests = _requests(spark, folder)
        key = F.col(KEY)
        derivable = {"event_lead_time_days": key % 2 == 0, "product_count": key % 3 == 0}
        fields = [c for c in [*files.REQUEST_FIELDS, files.STOCK_FIELD] if c in requests.columns]
        cells = [F.when(~derivable[c], F.col(c)).alias(c) if c in derivable else c for c in fields]
        line = F.to_json(F.struct(*cells))
        broken = F.when(key % 41 == 7, F.left(line, F.char_length(line) - 5)).when(key % 41 == 8, F.concat(F.lit("["), line, F.lit("]")))
        path = work_path(spark, "request-lines")
        # Field names repeat on every line, so the lines take a small part of their size when packed.
        requests.select(F.coalesce(broken, line).alias("value")).write.text(path, compression="gzip")
        return path

    return _once(spark, "request-lines", folder, make)


def _read_back(spark: SparkSession, folder: str) -> DataFrame:
    read = files.read_requests(spark, _request_lines(spark, folder), lines=True)
    return read.withColumn(KEY, F.col(KEY).cast("long"))


def _request_features(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    prepared = features.prepare_features(_read_back(spark, folder), AS_OF, per_row=True)
    return plain(_rounded(prepared.select(KEY, *DOCUMENT_FEATURES)))


def _request_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return plain(_rounded(_recommendations(_read_back(spark, folder), costing.default_catalogue(spark))))


def _request_rejects(spark: SparkSession, folder: str) -> DataFrame:
    rejects = files.rejected_documents(spark, _request_lines(spark, folder), lines=True)
    named = F.regexp_extract("document", r'"request_id":(\d+)', 1).cast("long")
    return rejects.select(named.alias(KEY), "reason")


def pricing_queries() -> dict[str, Query]:
    return {
        "request_features": _request_features,
        "request_recommendations": _request_recommendations,
        "request_rejects": _request_rejects,
        "cost_items": _priced(_items),
        "direct_costs": _priced(_costs),
        "price_bounds": _priced(_bounds),
        "candidate_discounts": _priced(_discounts),
        "scored_candidates": _priced(_candidates),
        "recommendations": _priced(_recommendations),
        "rejected_requests": _priced(_rejected),
        "availability": _priced(_availability),
        "pricing_strategy": _priced(_strategies),
        "stock_recommendations": _priced(_stock_recommendations),
        "stock_as_of": _on_quotes(_stock_as_of),
    }


def _lookups(spark: SparkSession, folder: str) -> DataFrame:
    """The lookups of all quotes, normalized and written once."""

    def make() -> DataFrame:
        return materialize(venues.lookup_queries(_quotes(spark, folder)), "lookups")

    return _once(spark, "lookups", folder, make)


def _places(spark: SparkSession, folder: str) -> DataFrame:
    """Lookup answers, kept once like a cache of fetched places."""

    def make() -> DataFrame:
        queries = _lookups(spark, folder)
        return materialize(lookup_places(source_tables(spark, folder), queries), "places")

    return _once(spark, "places", folder, make)


def _enriched(confidence) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        quotes = _quotes(spark, folder)
        overrides = venue_overrides(quotes)
        enriched = venues.enrich(
            quotes, _places(spark, folder), overrides, confidence=confidence, queries=_lookups(spark, folder)
        )
        return plain(
            _rounded(
                enriched.select("request_event_id", *venues.VENUE_COLUMNS, "venue_enrichment_status")
            )
        )

    return run


def _enrichment_counts(spark: SparkSession, folder: str) -> DataFrame:
    enriched = _enriched(venues.overlap_confidence)(spark, folder)
    return profile.top_values(enriched, "venue_enrichment_status")


def _normalized(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    documents = source_tables(spark, folder)["documents"]
    return documents.select("doc_id", normalize_text("text").alias("words"))


def _overlap(confidence) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        queries = _lookups(spark, folder)
        scored = venues.match_score(queries, _places(spark, folder), confidence)
        return _rounded(scored.select("query_hash", "pos", "confidence"))

    return run


def _place_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = venues.venue_scores(_places(spark, folder))
    return scored.select(
        "query_hash", "pos", "premium_score", "notability_score", "is_private_address"
    )


def _read_pages(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    return venues.page_text(source_tables(spark, folder)["pages"])


def _page_text(spark: SparkSession, folder: str) -> DataFrame:
    return _read_pages(spark, folder).select(
        "url", F.char_length("text").alias("characters"), F.size("links").alias("links"),
        "capacity_seated", "capacity_cocktail",
    )


# The given pages are no venue sites: their language folders stand for the reception pages.
PATH_WORDS = ["en", "fr", "de", "es"]


def _sites(make) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        read = materialize(_read_pages(spark, folder), "pages")
        return make(read.select(F.col("url").alias("website")), read, PATH_WORDS)

    return run


def venue_queries() -> dict[str, Query]:
    return {
        "normalized_texts": _normalized,
        "lookup_queries": _on_quotes(
            lambda q: venues.lookup_queries(q).select("query_hash", "query_norm").distinct()
        ),
        "place_overlap": _overlap(venues.overlap_confidence),
        "place_match": _overlap(venues.match_confidence),
        "place_scores": _place_scores,
        "enriched_quotes": _enriched(venues.overlap_confidence),
        "matched_quotes": _enriched(venues.match_confidence),
        "enrichment_status_counts": _enrichment_counts,
        "page_text": _page_text,
        "site_pages": _sites(venues.site_pages),
        "site_capacity": _sites(venues.site_capacity),
    }


def _scored(quotes: DataFrame) -> DataFrame:
    """Trainable quotes with the fixed scorer's probability for the price that was proposed."""
    prepared = features.prepare_features(evaluation.trainable_rows(quotes))
    return fixed_scorer(prepared).withColumnRenamed("raw_probability", "probability")


def _trainable(quotes: DataFrame) -> DataFrame:
    return evaluation.trainable_rows(quotes).select("request_event_id", "target_signed", "price_proposed")


def _split(quotes: DataFrame) -> DataFrame:
    rows = evaluation.trainable_rows(quotes)
    older = evaluation.temporal_condition(rows, CONFIG.temporal_validation_fraction)
    return rows.select("request_event_id", F.when(older, "train").otherwise("validation").alias("part"))


def _one_row(df: DataFrame, values: dict) -> DataFrame:
    row = {k: round(v, 6) if isinstance(v, float) else v for k, v in values.items()}
    return df.sparkSession.createDataFrame([tuple(row.values())], list(row))


def _metrics(quotes: DataFrame) -> DataFrame:
    scored = materialize(_scored(quotes).select("target_signed", "probability"), "scored")
    return _one_row(quotes, evaluation.metrics(scored))


def _selection(quotes: DataFrame) -> DataFrame:
    """The scorer against the naive rate on the newer part, with the gate's verdict."""
    columns = ["request_event_id", CREATED, "target_signed", "probability"]
    rows = materialize(_scored(quotes).select(*columns), "scored")
    older, newer = evaluation.temporal_split(rows, CONFIG.temporal_validation_fraction)
    steadier = newer.withColumn("probability", F.col("probability") * 0.8 + 0.1)
    scores = {
        "logistic_regression": evaluation.metrics(newer),
        "random_forest": evaluation.metrics(steadier),
    }
    naive = evaluation.baseline(older, newer)
    chosen = evaluation.choose_model(scores)
    return _one_row(
        quotes,
        {
            "selected_model": chosen,
            "brier_logistic": scores["logistic_regression"]["brier_score"],
            "brier_forest": scores["random_forest"]["brier_score"],
            "naive_probability": naive["constant_probability"],
            "naive_brier": naive["brier_score"],
            "naive_log_loss": naive["log_loss"],
            "validation_status": evaluation.gate(scores[chosen], naive),
        },
    )


def _class_counts(quotes: DataFrame) -> DataFrame:
    rows = evaluation.trainable_rows(quotes)
    return rows.groupBy("target_signed").agg(F.count("*").alias("rows"))


def _pilot(quotes: DataFrame) -> DataFrame:
    """Pilot groups by parity of the quote id; a late rest payment stands for a cancellation."""
    key = F.col("request_event_id")
    outcomes = quotes.select(
        F.when(key % 2 == 0, "control").otherwise("model").alias("arm"),
        "target_signed",
        F.col("signed_price").cast("double"),
        (F.col("product_count") * 100.0).alias("direct_cost"),
        F.when((key % 40 == 0) & (F.col("target_signed") == 1), 1).otherwise(0).alias("cancelled"),
    )
    return _rounded(evaluation.pilot_kpis(outcomes), 4)


CATEGORIES = [
    "request_source", "request_daypart", "event_postal_code", "event_city", "event_venue_anonymous_key",
    "event_lead_time_bucket", "product_bundle_signature",
]


def _validation(spark: SparkSession, folder: str):
    return _once(
        spark, "validation", folder, lambda: train.validate(_quotes(spark, folder), CONFIG)
    )


def _training_report(spark: SparkSession, folder: str) -> DataFrame:
    return train.report_frame(spark, train.report(_validation(spark, folder)))


def _importance(spark: SparkSession, folder: str) -> DataFrame:
    validation = _validation(spark, folder)
    model = validation.models["logistic_regression"]
    return training.importance(model, validation.test, seed=CONFIG.random_seed)


def _category_slots(quotes: DataFrame) -> DataFrame:
    """The column that each value of the trainable rows gets."""
    rows = features.prepare_features(evaluation.trainable_rows(quotes))
    encoding = training.fit_encoding(rows, CATEGORIES)
    return encoding.dictionary.select(
        "feature", "value", F.col("counts")[0].alias("rows"), F.col("slots")[0].alias("slot")
    )


def _final_bundle(spark: SparkSession, folder: str) -> train.Bundle:
    """The refitted bundle, saved and read back."""

    def make() -> train.Bundle:
        path = work_path(spark, "bundle")
        train.final_bundle(_validation(spark, folder), CONFIG).save(path)
        return train.Bundle.load(spark, path)

    return _once(spark, "bundle", folder, make)


def _bundle_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    """Prices from the bundle that was refitted on all rows, written and reloaded."""
    bundle = _final_bundle(spark, folder)
    priced = ladder.recommend(
        _requests(spark, folder), costing.default_catalogue(spark), bundle.price_scorer, CONFIG, KEY,
        bundle.model_name, bundle.price_model_name, as_of=AS_OF,
    )
    return plain(priced.select(KEY, "price_status", "model_name", "price_model_name", *FLAT))


def _model_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    """Prices from the trained price model instead of the fixed scorer."""
    bundle = train.Bundle(
        *[_validation(spark, folder).models["logistic_regression"]] * 2,
        {"model_name": "logistic_regression", "price_model_name": "logistic_regression"},
    )
    catalogue = costing.default_catalogue(spark)
    return plain(
        ladder.recommend(_requests(spark, folder), catalogue, bundle.price_scorer, CONFIG, KEY).select(
            KEY, *FLAT
        )
    )


def training_queries() -> dict[str, Query]:
    return {
        "trainable_rows": _on_quotes(_trainable),
        "class_counts": _on_quotes(_class_counts),
        "temporal_split": _on_quotes(_split),
        "scored_metrics": _on_quotes(_metrics),
        "model_selection": _on_quotes(_selection),
        "reliability": _on_quotes(lambda q: _rounded(evaluation.reliability(_scored(q)))),
        "pilot_kpis": _on_quotes(_pilot),
        "training_report": _training_report,
        "feature_importance": _importance,
        "model_recommendations": _model_recommendations,
        "category_slots": _on_quotes(_category_slots),
        "bundle_recommendations": _bundle_recommendations,
    }


def queries() -> dict[str, Query]:
    return (
        crm_queries()
        | profile_queries()
        | feature_queries()
        | pricing_queries()
        | venue_queries()
        | training_queries()
    )
