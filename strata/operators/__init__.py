"""DataFrame -> DataFrame operators (conform, dedupe, windows, joins, gold,
items, quality)."""
