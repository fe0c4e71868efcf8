"""Pipelines, API functions, bindings of the driver's tables and the query registry."""
