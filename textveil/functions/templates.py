"""Pseudonym templates: rendering on Spark, and the shapes rendered pseudonyms have."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textveil.functions.detectors import Detector
from textveil.functions.sql import text

_FIELD = re.compile(r"\{n(?::0(\d+)d)?\}")

# Rules that are more than a template, as SQL over ``n`` and ``value``.
_FIRST_ACCOUNT = 100_000_000_000
RULES = {
    "@ip": "concat_ws('.', '10', (n div 256) % 256, n % 256, (n * 7) % 254 + 1)",
    "@mac": "format_string('AA:BB:CC:00:00:%02X', n % 256)",
    "@account": f"CAST({_FIRST_ACCOUNT} + n AS STRING)",
    # service, region and resource type stay; account and resource go
    "@arn": (
        "concat('arn:aws:', split_part(value, ':', 3), ':', split_part(value, ':', 4), ':',"
        f" {_FIRST_ACCOUNT} + n, ':', CASE WHEN contains(split_part(value, ':', 6), '/')"
        " THEN concat(substring_index(split_part(value, ':', 6), '/', 1), '/') ELSE '' END,"
        " 'redacted-', n)"
    ),
}
_RULE_SHAPES = {
    "@ip": r"10\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "@mac": r"AA:BB:CC:00:00:[0-9A-F]{2}",
    "@account": r"[1-9][0-9]{11,}",
    "@arn": r"arn:aws:[a-z0-9\-]+:[a-z0-9\-]*:[1-9][0-9]{11,}:(?:[^\s\"'`:/]*/)?redacted-[0-9]+",
}


def render_sql(template: str) -> str:
    """SQL that renders one template for ``n`` (and ``value``).

    ``format_string`` pads but never cuts, so wide counters stay whole; counters that are not
    padded are put in as they are, which costs much less.
    """
    if template in RULES:
        return RULES[template]
    if template.startswith("@"):
        raise ValueError(f"unknown rule {template}")
    if is_constant(template):
        return text(template)
    if not any(_FIELD.findall(template)):
        number = "coalesce(CAST(n AS STRING), 'null')"
        parts = [text(part) for part in _FIELD.split(template)[::2]]
        return f"concat({f', {number}, '.join(parts)})"
    pattern = "".join(
        part if i % 2 else part.replace("%", "%%")
        for i, part in enumerate(re.split(r"(%0?\d*d)", _FIELD.sub(
            lambda m: f"%0{m[1]}d" if m[1] else "%d", template)))
    )
    return f"format_string({text(pattern)}, {', '.join(['n'] * len(_FIELD.findall(template)))})"


def is_constant(template: str) -> bool:
    return template not in RULES and not _FIELD.search(template)


def render_pseudonym(detectors: Iterable[Detector]) -> Column:
    """Pseudonym of a row with ``pattern``, ``n`` and ``value``."""
    by_sql: dict[str, list[str]] = {}
    for d in detectors:
        by_sql.setdefault(render_sql(d.template), []).append(d.name)
    whens = " ".join(
        f"WHEN pattern IN ({', '.join(map(text, names))}) THEN {sql}"
        for sql, names in by_sql.items()
    )
    return F.expr(f"CASE {whens} END") if whens else F.lit(None).cast("string")


def shape(template: str) -> str:
    """Regex (portable notation) of every pseudonym a template can render."""
    if template in _RULE_SHAPES:
        body = _RULE_SHAPES[template]
    else:
        parts = _FIELD.split(template)
        body = ""
        for i, part in enumerate(parts):
            if i % 2 == 0:
                body += re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", part)
            else:
                body += f"[0-9]{{{part},}}" if part else "[0-9]+"
    return r"(?<![0-9])" + body if body[:1].isdigit() or body.startswith(("[0-9]", "[1-9]")) else body


def shapes(templates: Iterable[str]) -> str:
    """One regex for all templates, longer ones first.

    Shapes are listed by first character behind a look-ahead, so that most positions of a
    text fail after one class test.
    """
    by_first: dict[str, set[str]] = {}
    for t in templates:
        first = t[0] if t[0] != "@" else {"@ip": "1", "@mac": "A", "@account": "0", "@arn": "a"}[t]
        by_first.setdefault("0-9" if first in "0123456789{" else first, set()).add(shape(t))
    if not by_first:
        return "$^"
    heads = {f: f if f == "0-9" else re.sub(r"([\[\]^\\-])", r"\\\1", f) for f in by_first}
    groups = [
        f"(?=[{heads[f]}])(?:{'|'.join(sorted(by_first[f], key=lambda s: (-len(s), s)))})"
        for f in sorted(by_first)
    ]
    return f"(?=[{''.join(heads[f] for f in sorted(by_first))}])(?:{'|'.join(groups)})"


def shorter(token: str) -> str:
    """SQL: the token cut inside its final digits, longest first, without itself.

    A digit that follows a pseudonym in the text reads as part of its number; one of these
    is then the pseudonym.
    """
    digits = f"length(regexp_extract({token}, '([0-9]*)$', 1))"
    return (f"CASE WHEN {digits} > 1 THEN transform(sequence(1, {digits} - 1),"
            f" j -> left({token}, length({token}) - j)) ELSE CAST(array() AS array<string>) END")
