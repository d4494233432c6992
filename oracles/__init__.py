"""Plain SQL versions of the registered queries, for checking results with another engine."""

from __future__ import annotations


def all_statements() -> dict[str, str]:
    from oracles import crm, enrichment, models, pricing, quality

    return crm.statements() | quality.statements() | pricing.statements() | enrichment.statements() | models.statements()
