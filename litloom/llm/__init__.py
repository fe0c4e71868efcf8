"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; ``litloom.llm.registry`` lists the
queries and their SQL.
"""
