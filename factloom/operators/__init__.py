"""Relational operators: catalog, profiles, facts, graph, retrieval."""
