"""Query operators: nearest neighbours, filters, joins, aggregates, two-stage search, fusion."""
