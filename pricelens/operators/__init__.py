"""Reusable relational building blocks: ordered chunks, as-of joins, range joins, islands, exact quantiles."""
