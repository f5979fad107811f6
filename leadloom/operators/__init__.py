"""DataFrame operators: page parsing, field extraction, joins, dedup, routing, summaries."""
