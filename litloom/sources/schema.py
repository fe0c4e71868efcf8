"""Explicit schemas of the data model, as DDL."""

PAPER = (
    "arxiv_id string, title string, year int, domain string, objectives array<string>, methods array<string>, "
    "datasets array<string>, evaluation_metrics array<string>, limitations array<string>, future_directions array<string>, "
    "raw_json string, ingested_at timestamp, extraction_tier string"
)
FAILURE = "ts timestamp, arxiv_id string, stage string, reason string, raw string"
EDGE_LIMITATION = "arxiv_id string, text string, tier string"
EDGE_TEXT = "arxiv_id string, text string"
EDGE_NAME = "arxiv_id string, name string"
MENTION = "text string, collection string, arxiv_id string, domain string, year int"
POINT = "collection string, text string, domain string, paper_ids array<string>, year int, embedding array<float>"
TABLES = {
    "papers": PAPER,
    "failures": FAILURE,
    "edges_limitation": EDGE_LIMITATION,
    "edges_future": EDGE_TEXT,
    "edges_method": EDGE_NAME,
    "edges_dataset": EDGE_NAME,
    "mentions": MENTION,
    "points": POINT,
}
#: Defaults of absent fields.
DEFAULT_DOMAIN = "computer_vision"
DEFAULT_TIER = "explicit"
