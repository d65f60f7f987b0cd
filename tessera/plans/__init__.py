"""Catalogue views over the driver's tables, the query registry and its SQL twins."""
