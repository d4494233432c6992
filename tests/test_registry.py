"""Registered queries: every SQL has a query, names are unique, the flagship runs."""

import __spark_entry__ as entry
from oracles import all_statements
from quotelab.plans import registry


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    queries, statements = registry.queries(), all_statements()
    assert set(statements) <= set(queries)
    without = set(queries) - set(statements)
    assert without == {
        "place_match", "matched_quotes", "page_text", "site_pages", "site_capacity", "training_report",
        "feature_importance", "model_recommendations", "bundle_recommendations",
    }


def test_flagship_runs(spark):
    result = entry.entry(spark)
    assert result.count() > 1000 and "recommended_price_eur" in result.columns
