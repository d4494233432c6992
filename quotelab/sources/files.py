"""CSV and JSON sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelab.functions import feature_lists as lists
from quotelab.operators.export import drop_private
from quotelab.operators.features import OPTION_FLAGS, OPTION_QUANTITIES, PRODUCT_CODES

EXAMPLE_PREFIX = "EXEMPLE_"

# Set for each candidate price, so not part of a request.
CANDIDATE_FIELDS = {
    "price_proposed", "price_proposed_minus_gross", "price_proposed_to_gross_ratio", "price_discount_rate",
    "price_global_discount", "price_total_declared_discount",
}
TEXT_FIELDS = [
    "request_id", "request_created_at_utc", "request_date", "prior_last_request_at_utc", "event_date",
    "enrichment_event_full_address_raw", "catalogue_code", "commercial_priority", "date_booking_status",
    *lists.CATEGORICAL_FEATURES,
]
NUMBER_FIELDS = [
    *PRODUCT_CODES, *OPTION_FLAGS, *OPTION_QUANTITIES, "option_delivery", "option_duration_hours",
    "event_has_internal_comment", "event_internal_comment_length", "direct_cost_eur", "minimum_price_eur",
    "maximum_price_eur", "days_before_event",
    *[name for name in lists.NUMERIC_FEATURES if name not in CANDIDATE_FIELDS],
]
# Every scalar is read as text and coerced where it is used, so that a bad cell is a gap, not an error.
REQUEST_FIELDS = list(dict.fromkeys([*TEXT_FIELDS, *NUMBER_FIELDS]))
STOCK_FIELD = "available_products"
_BROKEN = "_broken"
REQUEST_SCHEMA = ", ".join(f"{name} string" for name in [*REQUEST_FIELDS, STOCK_FIELD, _BROKEN])


def delimiter(spark: SparkSession, path: str) -> str:
    """Semicolon or comma, whichever separates the header line (quoted names aside)."""
    lines = spark.read.text(path).limit(1).collect()
    header = re.sub(r'"[^"]*"', "", lines[0][0]) if lines else ""
    return ";" if header.count(";") > header.count(",") else ","


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Delimited export with header; all columns as text (postal codes keep their zeros)."""
    return spark.read.csv(
        path, sep=delimiter(spark, path), header=True, quote='"', escape='"', multiLine=True
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Price list with its three prices as numbers; a repeated code is refused."""
    table = read_csv(spark, path)
    prices = ["normal_price_eur", "direct_cost_eur", "floor_price_eur"]
    catalogue = table.withColumns({c: F.col(c).try_cast("double") for c in prices})
    repeated = catalogue.groupBy("code").count().where("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"repeated catalogue codes: {sorted(str(r['code']) for r in repeated)}")
    return catalogue


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Verified venues by key; example lines are skipped and the last line of a key wins."""
    table = read_csv(spark, path)
    key = F.col("match_key")
    lines = table.where((key != "") & ~key.startswith(EXAMPLE_PREFIX)).withColumns(
        {"match_key": F.trim("match_key"), "_line": F.monotonically_increasing_id()}
    )
    latest = lines.groupBy("match_key").agg(F.max_by(F.struct(*table.columns), "_line").alias("row"))
    return latest.select("row.*")


def _documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """``source, document, request``: texts that hold one request each, and what they parse to."""
    texts = spark.read.text(path, wholetext=not lines).select(
        F.col("_metadata.file_path").alias("source"),
        F.ltrim(F.regexp_replace("value", "^\ufeff", "")).alias("document"),
    )
    parsed = F.from_json("document", REQUEST_SCHEMA, {"columnNameOfCorruptRecord": _BROKEN})
    return texts.where(F.trim("document") != "").withColumn("request", parsed)


def _refusal() -> Column:
    """Why a document is no request; NULL for one that is."""
    return F.when(~F.startswith("document", F.lit("{")), "NOT_AN_OBJECT").when(
        F.col("request").isNull() | F.col(f"request.{_BROKEN}").isNotNull(), "BROKEN_JSON"
    )


def read_requests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON requests: one document per file, or with ``lines`` one per line (files are then split).

    Every known field is a column; one that a document lacks is NULL, and pricing derives what can be
    derived.  A document without id is named after its file, a line after its file and its place in this
    reading.  Anything that is not one JSON object is left to ``rejected_documents``.
    """
    good = _documents(spark, path, lines).where(_refusal().isNull())
    name = F.col("source")
    if lines:
        name = F.concat("source", F.lit("#"), F.monotonically_increasing_id().cast("string"))
    good = good.withColumn("_name", name)

    def value(field: str) -> Column:
        cell = F.col(f"request.{field}")
        if field in NUMBER_FIELDS:  # truth values count as numbers
            cell = F.when(cell == "true", "1").when(cell == "false", "0").otherwise(cell)
        return cell.alias(field)

    others = [f for f in REQUEST_FIELDS if f != "request_id"]
    stock = F.from_json(f"request.{STOCK_FIELD}", "map<string,string>")
    return good.select(
        F.coalesce("request.request_id", "_name").alias("request_id"),
        *map(value, others),
        F.when(F.startswith(f"request.{STOCK_FIELD}", F.lit("{")), stock).alias(STOCK_FIELD),
    )


def rejected_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``source, document, reason`` of what ``read_requests`` leaves out."""
    reason = _refusal()
    found = _documents(spark, path, lines).where(reason.isNotNull())
    return found.select("source", "document", reason.alias("reason"))


def write_requests(requests: DataFrame, path: str) -> None:
    """JSON lines without the fields that a request leaves open."""
    requests.write.option("ignoreNullFields", "true").json(path)


def write_history(quotes: DataFrame, path: str, keep_addresses: bool = False) -> None:
    """CSV with header; exact addresses only on explicit demand."""
    table = quotes if keep_addresses else drop_private(quotes)
    table.write.csv(path, header=True, quote='"', escape='"')


def write_report(report: DataFrame, path: str) -> None:
    """JSON lines, missing values included; recommendations keep their nested parts."""
    report.write.option("ignoreNullFields", "false").json(path)
