"""Venue enrichment as table jobs: lookups, scores, overrides and site capacities.

Lookup results come in as a ``places`` table (query_hash, pos, display_name, formatted_address,
primary_type, types, rating, user_rating_count, website_uri, price_level, status) and web pages as a
``pages`` table (url, html); fetching them is not part of this library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelab.functions.numbers import evaluated
from quotelab.functions.words import (
    PAGE_SCHEMA,
    largest_size,
    normalize_text,
    read_pages,
    sequence_ratio,
    stated_sizes,
)
from quotelab.session import bounded, left_join_spread, materialize

# Place types, words and points of the venue scores.
VENUE_TYPES = [
    "wedding_venue",
    "event_venue",
    "banquet_hall",
    "convention_center",
    "hotel",
    "restaurant",
    "night_club",
]
ADDRESS_TYPES = ["street_address", "premise", "subpremise", "route"]
PREMIUM_WORDS = [
    "chateau",
    "domaine",
    "manoir",
    "palace",
    "prestige",
    "abbaye",
    "orangerie",
    "relais",
]
PRICE_POINTS = {
    "PRICE_LEVEL_FREE": 0,
    "PRICE_LEVEL_INEXPENSIVE": 5,
    "PRICE_LEVEL_MODERATE": 12,
    "PRICE_LEVEL_EXPENSIVE": 24,
    "PRICE_LEVEL_VERY_EXPENSIVE": 32,
}
OTHER_PRICE_POINTS = 8
SITE_WORDS = ["mariage", "reception", "salle", "capacite"]
SITE_PAGES = 3
REVIEW_BELOW = 0.55

QUERY = "enrichment_event_full_address_raw"
VENUE_KEY = "event_venue_anonymous_key"


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def lookup_queries(quotes: DataFrame) -> DataFrame:
    """Distinct lookups (query_hash, query_norm): one per normalized address or name.

    Raw texts are made distinct before they are normalized, so a venue asked for by a large share
    of all quotes is normalized once.
    """
    query = F.trim(F.coalesce(F.col(QUERY), F.lit("")))
    raw = quotes.select(query.alias("query")).where(F.col("query") != "").distinct()
    normalized = raw.withColumn("query_norm", normalize_text("query"))
    return normalized.withColumn("query_hash", F.sha2("query_norm", 256))


def token_overlap(query: Column, candidate: Column) -> Column:
    """Share of the query's words found in the candidate."""
    asked = _tokens(query)
    return F.size(F.array_intersect(asked, _tokens(candidate))) / F.greatest(F.size(asked), F.lit(1))


def match_confidence(query: Column, candidate: Column) -> Column:
    return F.bround(0.55 * sequence_ratio(query, candidate) + 0.45 * token_overlap(query, candidate), 4)


def overlap_confidence(query: Column, candidate: Column) -> Column:
    """Word overlap alone: no Python, for checks against engines without a sequence matcher."""
    return F.bround(token_overlap(query, candidate), 4)


def match_score(
    queries: DataFrame,
    places: DataFrame,
    confidence: Callable[[Column, Column], Column] = match_confidence,
) -> DataFrame:
    """Confidence of every candidate place of every distinct lookup."""
    distinct = queries.select("query_hash", "query_norm").distinct()
    candidate = F.concat_ws(
        " ", F.coalesce("display_name", F.lit("")), F.coalesce("formatted_address", F.lit(""))
    )
    pairs = distinct.join(places.withColumn("_candidate", normalize_text(candidate)), "query_hash")
    return pairs.withColumn(
        "confidence", confidence(F.col("query_norm"), F.col("_candidate"))
    ).drop("_candidate", "query_norm")


def best_place(scored: DataFrame) -> DataFrame:
    """Highest confidence per lookup, the earlier candidate on a tie; a combinable aggregate."""
    entry = F.struct(*scored.columns)
    order = F.struct("confidence", -F.col("pos"))
    return scored.groupBy("query_hash").agg(F.max_by(entry, order).alias("best")).select("best.*")


def is_private_address() -> Column:
    types = F.coalesce("types", F.array().cast("array<string>"))
    venue = F.arrays_overlap(types, _array(VENUE_TYPES))
    return F.when(venue, 0).when(F.arrays_overlap(types, _array(ADDRESS_TYPES)), 1).otherwise(0)


def has_website() -> Column:
    return F.when(F.coalesce("website_uri", F.lit("")) != "", 1).otherwise(0)


def venue_scores(places: DataFrame) -> DataFrame:
    """Add premium_score, notability_score and is_private_address."""
    rating = F.coalesce(F.col("rating"), F.lit(0.0))
    reviews = F.log10(F.coalesce(F.col("user_rating_count"), F.lit(0)) + 1)
    levels = [part for name, points in PRICE_POINTS.items() for part in (F.lit(name), F.lit(points))]
    level = F.coalesce(
        F.try_element_at(F.create_map(*levels), F.coalesce("price_level", F.lit(""))),
        F.lit(OTHER_PRICE_POINTS),
    )
    stars = (rating - 3.5) * 20
    words = _tokens(normalize_text(F.coalesce("display_name", F.lit(""))))
    keyword = F.when(F.arrays_overlap(words, _array(PREMIUM_WORDS)), 18).otherwise(0)
    premium = level + F.greatest(F.lit(0.0), F.least(F.lit(30.0), stars)) + keyword + has_website() * 8
    notability = F.least(F.lit(65.0), reviews * 23) + F.greatest(F.lit(0.0), stars)
    hundred = F.lit(100.0)
    return places.withColumns(
        {
            "premium_score": F.bround(F.least(hundred, premium)).cast("int"),
            "notability_score": F.bround(F.least(hundred, notability)).cast("int"),
            "is_private_address": is_private_address(),
        }
    )


def page_text(pages: DataFrame) -> DataFrame:
    """Text, links and stated capacities of every page, whole pages, one pass."""
    read = pages.select("url", "html").mapInPandas(read_pages, PAGE_SCHEMA)
    worded = evaluated(read, {"_words": normalize_text("text")})
    sized = evaluated(worded, {"_sizes": stated_sizes(F.col("_words"))})
    return sized.select(
        *read.columns,
        largest_size(F.col("_sizes"), True).alias("capacity_seated"),
        largest_size(F.col("_sizes"), False).alias("capacity_cocktail"),
    )


def site_links(read: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Links (from_url, pos, url) to pages of the same host whose path speaks of receptions."""
    links = read.select(
        F.col("url").alias("from_url"), F.col("host").alias("own"), F.posexplode("links").alias("pos", "link")
    )
    wanted = normalize_text(F.col("link.path")).rlike("|".join(words or SITE_WORDS))
    return links.where((F.col("own") == F.col("link.host")) & wanted).select(
        "from_url", "pos", "link.url"
    )


def site_pages(websites: DataFrame, read: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Up to three pages per website (website, url, step): the home page, then its links in order,
    then the links of the second page; pages that are not in the table are skipped."""
    known = read.select("url").distinct()
    links = site_links(read, words).join(known, "url", "left_semi")
    first = links.groupBy("from_url", "url").agg(F.min("pos").alias("pos"))
    homes = (
        websites.where(F.col("website").rlike("^https?://[^/]"))
        .select("website")
        .distinct()
        .join(known, F.col("website") == F.col("url"), "left_semi")
        .select("website", F.col("website").alias("url"), F.lit(1).alias("step"))
    )
    # Second and third page by the links of the home page.
    by_home = homes.select("website").join(
        first.where(F.col("url") != F.col("from_url")), F.col("website") == F.col("from_url")
    )
    two = by_home.groupBy("website").agg(F.min(F.struct("pos", "url")).alias("second"))
    after = (
        by_home.join(two, "website")
        .where(F.col("url") != F.col("second.url"))
        .groupBy("website")
        .agg(F.min(F.struct("pos", "url")).alias("third"))
    )
    # Only when the home page gives a single one: the links of the second page.
    next_links = first.select(F.col("from_url").alias("_from"), "pos", "url")
    deeper = (
        two.join(after, "website", "left_anti")
        .join(next_links, F.col("second.url") == F.col("_from"))
        .where((F.col("url") != F.col("website")) & (F.col("url") != F.col("_from")))
        .groupBy("website")
        .agg(F.min(F.struct("pos", "url")).alias("third"))
    )
    second = two.select("website", F.col("second.url").alias("url"), F.lit(2).alias("step"))
    third = after.unionByName(deeper).select(
        "website", F.col("third.url").alias("url"), F.lit(3).alias("step")
    )
    return homes.unionByName(second).unionByName(third)


def site_capacity(websites: DataFrame, read: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Largest stated capacities over the pages of each website, and how many were read."""
    chosen = site_pages(websites, read, words)
    sizes = read.select("url", "capacity_seated", "capacity_cocktail")
    return chosen.join(sizes, "url").groupBy("website").agg(
        F.max("capacity_seated").alias("capacity_seated"),
        F.max("capacity_cocktail").alias("capacity_cocktail"),
        F.count("*").alias("fetched_pages"),
    )


VENUE_COLUMNS = {
    "venue_name": "string",
    "venue_match_confidence": "double",
    "venue_is_private_address": "int",
    "venue_type": "string",
    "venue_capacity_seated": "int",
    "venue_capacity_cocktail": "int",
    "venue_rating": "double",
    "venue_review_count": "int",
    "venue_price_min": "double",
    "venue_price_max": "double",
    "venue_has_official_website": "int",
    "venue_premium_score": "int",
    "venue_notability_score": "int",
    "venue_enrichment_sources_count": "int",
}


def _override_columns(overrides: DataFrame) -> DataFrame:
    def blank_or(name: str, kind: str) -> Column:
        return F.nullif(F.trim(F.col(name).cast("string")), F.lit("")).try_cast("double").cast(kind)

    values = {
        "venue_name": F.col("venue_name"),
        "venue_match_confidence": F.lit(1.0),
        "venue_is_private_address": F.lit(0),
        "venue_type": F.col("venue_type"),
        "venue_has_official_website": F.when(F.coalesce("source_url", F.lit("")) != "", 1).otherwise(0),
        "venue_enrichment_sources_count": F.lit(1),
    }
    for name, kind in VENUE_COLUMNS.items():
        if name not in values:
            given = name in overrides.columns
            values[name] = blank_or(name, kind) if given else F.lit(None).cast(kind)
    return overrides.select(
        F.col("match_key").alias("_match_key"),
        F.struct(*[values[n].cast(k).alias(n) for n, k in VENUE_COLUMNS.items()]).alias("_override"),
    )


def _place_columns(best: DataFrame, capacity: DataFrame | None) -> DataFrame:
    if capacity is not None:
        best = best.join(
            capacity.withColumnRenamed("website", "website_uri"), "website_uri", "left"
        )
    else:
        none = F.lit(None).cast("int")
        best = best.withColumns(
            {"capacity_seated": none, "capacity_cocktail": none, "fetched_pages": F.lit(0)}
        )
    fetched = F.coalesce(F.col("fetched_pages"), F.lit(0)) > 0
    values = {
        "venue_name": F.col("display_name"),
        "venue_match_confidence": F.col("confidence"),
        "venue_is_private_address": F.col("is_private_address"),
        "venue_type": F.col("primary_type"),
        "venue_capacity_seated": F.col("capacity_seated"),
        "venue_capacity_cocktail": F.col("capacity_cocktail"),
        "venue_rating": F.col("rating"),
        "venue_review_count": F.col("user_rating_count"),
        "venue_price_min": F.lit(None),
        "venue_price_max": F.lit(None),
        "venue_has_official_website": has_website(),
        "venue_premium_score": F.col("premium_score"),
        "venue_notability_score": F.col("notability_score"),
        "venue_enrichment_sources_count": F.when(fetched, 2).otherwise(1),
    }
    return best.select(
        "query_hash",
        F.struct(*[values[n].cast(k).alias(n) for n, k in VENUE_COLUMNS.items()]).alias("_place"),
    )


def enrich(
    quotes: DataFrame,
    places: DataFrame,
    overrides: DataFrame,
    pages: DataFrame | None = None,
    confidence: Callable[[Column, Column], Column] = match_confidence,
    row: str = "request_event_id",
    queries: DataFrame | None = None,
) -> DataFrame:
    """Add the venue columns and the enrichment status to every quote.

    An override of the venue key wins.  Otherwise the best candidate of the lookup is used; the
    fetcher's own failures arrive as candidates with a ``status`` and become the row's status.
    With ``pages`` the capacities stated on the venue's site are added.  ``queries`` are the written
    ``lookup_queries(quotes)``, where the caller has them.
    """
    # Long to normalize: written once, used for matching and joining.
    if queries is None:
        queries = materialize(lookup_queries(quotes), "lookups")
    failed = (
        places.where(F.col("status").isNotNull())
        .groupBy("query_hash")
        .agg(F.min("status").alias("_failure"))
    )
    found = venue_scores(
        best_place(match_score(queries, places.where(F.col("status").isNull()), confidence))
    )
    capacity = None
    if pages is not None:
        found = materialize(found, "venues")
        sites = found.select(F.col("website_uri").alias("website")).where("website is not null")
        capacity = site_capacity(sites, page_text(pages))
    results = (
        queries.join(_place_columns(found, capacity), "query_hash", "left")
        .join(failed, "query_hash", "left")
        .select(F.col("query").alias("_query"), "_place", "_failure")
    )
    forced = bounded(_override_columns(overrides))
    query = F.trim(F.coalesce(F.col(QUERY), F.lit("")))
    keyed = quotes.withColumn("_text", query).join(
        forced, F.trim(F.col(VENUE_KEY)) == F.col("_match_key"), "left"
    )
    joined = left_join_spread(keyed, results, "_text", "_query", F.col("_text") == "", row)
    override, place = F.col("_override"), F.col("_place")
    status = (
        F.when(override.isNotNull(), "MANUAL_OVERRIDE")
        .when(F.col("_text") == "", "NO_ADDRESS_OR_NAME")
        .when(F.col("_failure").isNotNull(), F.col("_failure"))
        .when(place.isNull(), "NO_MATCH")
        .when(place["venue_match_confidence"] < REVIEW_BELOW, "MATCH_REVIEW_REQUIRED")
        .otherwise("MATCHED")
    )
    usable = F.when(F.col("_failure").isNull(), place)
    chosen = F.when(override.isNotNull(), override).otherwise(usable)
    placed = evaluated(joined, {"_venue": chosen, "venue_enrichment_status": status})
    return placed.select(*quotes.columns, "_venue.*", "venue_enrichment_status")
