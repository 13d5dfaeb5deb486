"""End-to-end pipelines, the query registry and its SQL counterparts."""
