"""Predicates a match must pass before it counts, as native SQL over ``value`` and ``match``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from textveil.functions import words as w
from textveil.functions.dialect import java
from textveil.functions.sql import in_list, text


def _no_suffix(value: str) -> str:
    return "NOT (" + " OR ".join(f"endswith({value}, {text(d)})" for d in w.KEPT_DOMAINS) + ")"


def named_checks(given: Iterable[str], surnames: Iterable[str]) -> Mapping[str, str]:
    """SQL of every named predicate. Names are the two dictionaries of person names."""
    first = f"lower(regexp_extract(match, {text(java(r'^(\S+)\s+'))}, 1))"
    last = f"lower(regexp_extract(match, {text(java(r'\s+(\S+)$'))}, 1))"
    return {
        # five addresses that mean "here", "nobody" or "everybody"
        "public_ip": f"NOT {in_list('value', w.KEPT_ADDRESSES)}",
        # providers' domains, compared as plain suffixes
        "own_domain": _no_suffix("match"),
        "own_domain_value": _no_suffix("value"),
        "uncommon": f"NOT {in_list('lower(value)', w.KEPT_WORDS)}",
        "not_redacted": f"NOT startswith(value, {text(w.REDACTED_MARK)})",
        "ssn_area": "left(value, 3) NOT IN ('000', '666') AND NOT startswith(value, '9')",
        # luhn_check is false for separators, so they go first
        "luhn": "(length(regexp_replace(value, '[^0-9]', '')) >= 13 AND "
                "luhn_check(regexp_replace(value, '[^0-9]', '')))",
        "known_name": f"({in_list(first, given)} AND {in_list(last, surnames)})",
    }
