"""Windows, aggregations, joins and keyed state."""
