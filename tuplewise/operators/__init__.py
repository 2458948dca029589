"""Relational operators of the language: joins, existence, aggregation, paging."""
