"""Small helpers for writing Spark SQL expressions."""

from __future__ import annotations

from collections.abc import Iterable


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(expr: str, values: Iterable[str]) -> str:
    """``expr IN (...)``; false for an empty list."""
    listed = sorted(set(values))
    return f"({expr} IN ({', '.join(map(text, listed))}))" if listed else "(false)"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def bind(name: str, value: str, body: str) -> str:
    """As :func:`let`, for expressions that run often: Spark works out the type of an array's element anew
    for each row, over the whole of ``body``, and copies it; the last function of a fold has neither."""
    return f"aggregate(array(), {value}, (_b, _x) -> _b, {name} -> {body})"


def any_of(terms: Iterable[str]) -> str:
    listed = list(terms)
    return "(" + " OR ".join(listed) + ")" if listed else "true"


def all_of(terms: Iterable[str]) -> str:
    listed = [t for t in terms if t != "true"]
    return "(" + " AND ".join(listed) + ")" if listed else "true"
