"""All modules of queries; importing this fills the catalog."""

from . import choice_queries, delivery_queries, event_queries, ledger_queries, listing_queries, ordered_queries, pick_queries, registry_queries, report_queries, schedule_queries, search_queries, source_queries, text_queries, transaction_queries, version_queries, wording_queries  # noqa: F401
