"""Relational operators: graph, vectors, clustering, scoring, cross-domain matching."""
