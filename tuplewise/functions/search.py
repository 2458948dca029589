"""Keyword search: the search string, and its three evaluations."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATORS = r"[^\p{L}\p{N}_]+"


@dataclass(frozen=True)
class Terms:
    some: tuple[str, ...]  # any of these
    every: tuple[str, ...]  # all of these
    none: tuple[str, ...]  # none of these


def parse(text: str) -> Terms:
    """``word`` and ``"a phrase"``: any; ``+word``: all; ``-word``: none. Blanks in quotes don't split."""
    some, every, none = [], [], []
    for piece in re.findall(r'(?:[^\s"]|"[^"]*"|")+', text):
        to = {"+": every, "-": none}.get(piece[0], some)
        term = piece[1:].strip('"') if to is not some else piece[1:-1] if re.fullmatch('".+"', piece) else piece
        if term:
            to.append(term)
    return Terms(tuple(some), tuple(every), tuple(none))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _has(field: Column, term: str) -> Column:
    return F.contains(F.lower(field), F.lit(term.lower()))


def by_field(fields: list[Column], terms: Terms) -> Column:
    """Substrings, each field alone: some field has any, all and none of the terms asked for."""

    def one(field: Column) -> Column:
        parts = [_has(field, t) for t in terms.every] + [~_has(field, t) for t in terms.none]
        if terms.some:
            parts.append(_any([_has(field, t) for t in terms.some]))
        return F.coalesce(_all(parts), F.lit(False))

    return _any([one(f) for f in fields])


def pooled(fields: list[Column], terms: Terms) -> Column:
    """Substrings over all fields together."""
    found = lambda t: _any([F.coalesce(_has(f, t), F.lit(False)) for f in fields])
    return _combine(terms, found)


def _combine(terms: Terms, found) -> Column:
    parts = [found(t) for t in terms.every] + [~found(t) for t in terms.none]
    if terms.some:
        parts.append(_any([found(t) for t in terms.some]))
    return _all(parts)


def _words(fields: list[Column]) -> Column:
    """Lower-cased words of all fields with two blanks between and around them, so that neighbours can both match."""
    text = F.concat_ws(" ", *fields)
    return F.concat(F.lit("  "), F.regexp_replace(F.lower(text), _SEPARATORS, "  "), F.lit("  "))


def _word(term: str) -> str:
    return "  ".join(w for w in re.split(r"[^\w]+", term.lower()) if w)


def indexed(fields: list[Column], terms: Terms) -> Column:
    """Whole words over all fields of an index; the ``some`` terms only count when no term is asked for with ``+``."""
    words = _words(fields)
    found = lambda t: F.contains(words, F.lit(f" {_word(t)} "))
    return _combine(Terms(() if terms.every else terms.some, terms.every, terms.none), found)


def score(fields: list[Column], terms: Terms) -> Column:
    """How often the wanted words and phrases occur in the index's fields."""
    words = _words(fields)
    counts = [(F.length(words) - F.length(F.replace(words, F.lit(w), F.lit("")))) / len(w) for t in (*terms.every, *terms.some) for w in [f" {_word(t)} "]]
    return reduce(lambda a, b: a + b, counts, F.lit(0.0)).cast("double")
