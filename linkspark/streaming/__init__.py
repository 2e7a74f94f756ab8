"""The engine's data are tables at rest; there are no streaming operators to match. The per-record views (linkspark.operators.records.views) are
maps without state, so they apply to a streaming DataFrame as they are."""
