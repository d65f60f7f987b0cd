"""Tessera: retrieval analytics over a product-catalogue graph, as Spark jobs.

Every operator takes DataFrames and returns DataFrames keyed by ``query_id``,
so one plan serves a whole table of questions.
"""

__version__ = "0.1.0"
