"""The registered queries: name -> (Spark query, equivalent SQL or None)."""

from redpencil.plans import edit_queries, option_queries, table_queries, text_queries

REGISTRY = dict(sorted({**text_queries.QUERIES, **edit_queries.QUERIES, **option_queries.QUERIES, **table_queries.QUERIES}.items()))
