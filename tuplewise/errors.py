"""One error type; its category says which step refused the query."""

from __future__ import annotations


class QueryError(Exception):
    """``category``: syntax_error, semantic_error, type_error, json_error, jsonpath_error, resolution_error, conflict_error
    or stage_error."""

    def __init__(self, category: str, message: str):
        super().__init__(f"{category}: {message}")
        self.category = category
        self.message = message


def semantic(message: str) -> QueryError:
    return QueryError("semantic_error", message)
