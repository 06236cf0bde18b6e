"""Regular-expression notation used by the detector catalogue, and its Java form.

The catalogue is written in a portable notation whose classes are Unicode-aware:
``\\d`` any decimal digit, ``\\s`` any white space, ``\\w`` any letter, number or
underscore, ``\\b`` a word boundary, plus ``\\<`` (no word character before) and
``\\>`` (no word character after), which are cheaper than ``\\b`` where the
neighbour inside the match is known to be a word character.

``java()`` spells these classes out, so the result does not depend on the JDK's
default for ``\\b`` or on the slow ``(?U)`` flag.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
WORD = r"\p{L}\p{N}_"

_OUTSIDE = {
    "d": r"\p{Nd}",
    "s": f"[{SPACE}]",
    "S": f"[^{SPACE}]",
    "w": f"[{WORD}]",
    "<": f"(?<![{WORD}])",
    ">": f"(?![{WORD}])",
    "b": f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
}
_INSIDE = {"d": r"\p{Nd}", "s": SPACE, "w": WORD}


def java(regex: str) -> str:
    """Expand the portable classes of ``regex`` into explicit Java classes."""
    out: list[str] = []
    in_class = False
    chars = iter(regex)
    for ch in chars:
        if ch == "\\":
            nxt = next(chars)
            if in_class and nxt == "S":
                raise ValueError(r"\S inside a character class is not supported")
            out.append((_INSIDE if in_class else _OUTSIDE).get(nxt, "\\" + nxt))
        else:
            if ch == "[" and not in_class:
                in_class = True
            elif ch == "]" and in_class:
                in_class = False
            out.append(ch)
    return "".join(out)


def _either_case(ch: str) -> str:
    forms = sorted(f for f in {ch, ch.lower(), ch.upper()} if len(f) == 1)
    return _literal(ch) if len(forms) == 1 else "[" + "".join(forms) + "]"


def _literal(ch: str) -> str:
    plain = ch.isalnum() or ch == "_" or ch > "\x7f"
    return ch if plain else "\\" + ch


_OTHER = "\x80-\U0010ffff"  # all that is not ASCII, as one range


def _trie(words: Iterable[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}
    return root


def _branches(node: dict, spell) -> str:
    """Alternation over the children of a trie node.

    A regex engine tries alternatives one after the other, so a wide node is split into
    groups, each behind a look-ahead on the group's first characters. Characters outside
    ASCII sit behind one common test, as most positions fail it.
    """
    items = [(ch, spell(ch) + _branches(child, spell)) for ch, child in sorted(node.items()) if ch]
    if not items:
        return ""
    plain = [x for x in items if x[0].isascii()]
    other = [x for x in items if not x[0].isascii()]
    parts = _grouped(plain, spell)
    if plain and len(other) > 1:
        parts.append(f"(?=[{_OTHER}])(?:{'|'.join(_grouped(other, spell))})")
    else:
        parts += _grouped(other, spell)
    body = "|".join(parts)
    if len(items) > 1 or "" in node:
        body = f"(?:{body})"
    return body + "?" if "" in node else body


def _grouped(items: list[tuple[str, str]], spell) -> list[str]:
    if len(items) <= 6:
        return [branch for _, branch in items]
    size = max(3, round(len(items) ** 0.5))
    return [
        f"(?=[{_around([x for ch, _ in group for x in spell(ch).strip('[]')])}])"
        f"(?:{'|'.join(branch for _, branch in group)})"
        for group in (items[i:i + size] for i in range(0, len(items), size))
    ]


def _around(chars: list[str]) -> str:
    """Content of a class that holds the characters; outside ASCII, ranges that may hold more.

    Java looks ASCII characters up in a table, but others one after the other.
    """
    if all(ch.isascii() for ch in chars):
        return "".join(chars)
    low = [ch for ch in chars if ch == ch.lower()]
    ranges = [x for x in (low, [ch for ch in chars if ch != ch.lower()]) if x]
    return "".join(f"{min(x)}-{max(x)}" for x in ranges)


def any_word(words: Iterable[str]) -> str:
    """A case-insensitive alternation of literal words, factored by common prefix.

    Trying 300 alternatives at every character is what makes keyword patterns slow;
    factored, a position costs a handful of class tests.
    """
    return _branches(_trie(x.lower() for x in words), _either_case)


def may_start(words: Iterable[str], spell=_either_case) -> str:
    """Zero-width test for a first and a second character of the words: two class tests where most
    places fail, in front of a trie, which takes a test for each of its branches."""
    words = list(words)
    classes = []
    for i in range(min(2, min(map(len, words), default=0))):
        forms = [form for ch in {x[i] for x in words} for form in re.sub(r"^\[(.*)\]$|\\(.)", r"\1\2", spell(ch))]
        plain = "".join(sorted(re.sub(r"([^\w])", r"\\\1", ch) for ch in set(forms) if ch.isascii()))
        other = [ch for ch in forms if not ch.isascii()]
        classes.append(f"[{plain}{_around(other) if other else ''}]")
    return f"(?={''.join(classes)})" if classes else ""


def any_literal(literals: Iterable[str]) -> str:
    """Zero-width test for the longest of the literals at a position, captured as group 1."""
    literals = list(literals)
    return f"{may_start(literals, _literal)}(?=({_branches(_trie(literals), _literal)}))"


def first_letters(labels: str, either_case: bool = False) -> str:
    """The letters that alternatives of a keyword pattern start with."""
    first = {literal[0] for literal in _leading(labels)}
    return "".join(sorted(first | {x.upper() for x in first} if either_case else first))


def leading_literals(labels: str) -> tuple[str, ...]:
    """The literal that starts each alternative of a keyword pattern.

    A text that holds none of them cannot match, so they serve as a prefilter.
    """
    return fewest(_leading(labels))


def _leading(labels: str) -> list[str]:
    found: list[str] = []
    depth = 0
    alternatives = [""]
    for ch in labels:
        depth += (ch in "([") - (ch in ")]")
        if ch == "|" and depth == 0:
            alternatives.append("")
        else:
            alternatives[-1] += ch
    for alternative in alternatives:
        literal = ""
        for ch in alternative:
            if not (ch.isalpha() or ch == "_"):
                if ch in "?*":
                    literal = literal[:-1]
                break
            literal += ch
        if not literal:
            raise ValueError(f"no leading literal in {alternative!r}")
        found.append(literal.lower())
    return found


def fewest(literals: Iterable[str]) -> tuple[str, ...]:
    """Drop literals implied by a shorter one in the list (``aged`` by ``age``)."""
    unique = sorted(set(literals), key=lambda s: (len(s), s))
    kept: list[str] = []
    for literal in unique:
        if not any(k in literal for k in kept):
            kept.append(literal)
    return tuple(kept)
