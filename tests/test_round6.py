"""Claims recorded while scanning, literals one by one, tries behind a test of two characters."""

import random
import re

import pytest

from conftest import docs_of
from test_united import both, kinds

from textveil import by_name, find_spans
from textveil.functions import words as w
from textveil.functions.detectors import FAMILIES, foreign_secrets, ordered
from textveil.functions.dialect import any_literal, any_word, may_start
from textveil.operators import scan
from textveil.operators.scan import SPAN, Scanner

FOREIGN = "mon mot de passe est abc123 ; mein Passwort ist xyz789 ; mi contraseña es qqq111 ; mdp = \"def 456\" ."
TEXTS = [FOREIGN, "postgres://u:p@db/app | Authorization: Bearer " + "ab12" * 8 + " | sk-ant-" + "c3" * 12, "é😀 hash_key: " + "0f" * 16, "", None]


def rows(spark, detectors, **options):
    return sorted(map(tuple, find_spans(docs_of(spark, TEXTS), "text", detectors, **options).collect()))


@pytest.mark.parametrize("unite", [False, True])
def test_few_claims_are_not_read_off_the_shadow(spark, monkeypatch, unite):
    detectors = [*ordered(by_name(*FAMILIES["secret_formats"])), *foreign_secrets()]
    want = rows(spark, detectors, resolve=True, unite=unite), rows(spark, detectors)
    assert len(want[0]) == 8 and all(TEXTS[r[0]][r[6]:r[7]] == r[-1] for found in want for r in found)
    monkeypatch.setattr(Scanner, "decode", classmethod(lambda cls, *_: f"CAST(raise_error('read off') AS array<{SPAN}>)"))
    assert (rows(spark, detectors, resolve=True, unite=unite), rows(spark, detectors)) == want


def test_literals_one_by_one_or_in_one_pass(spark, monkeypatch):
    found = []
    for few in (0, 1_000):
        monkeypatch.setattr(scan, "FEW_LITERALS", few)
        found.append([rows(spark, list(ds), resolve=True) for ds in (ordered(by_name(*FAMILIES["secret_formats"])), foreign_secrets())])
    assert found[0] == found[1] and all(found[0])


def test_more_detectors_than_one_pass_takes(spark):
    detectors = kinds(**{f"d{i}": [f"k{i}", "all"] for i in range(scan.UNITE_MOST + 9)})
    text = " ".join(f"k{i}:v{i}" for i in range(scan.UNITE_MOST + 9)) + " all:xx"
    alone, together = both(spark, [text, text.upper()], detectors)
    assert alone == together and len(alone) > scan.UNITE_MOST


def test_two_characters_hide_no_word():
    rng = random.Random(5)
    for words in ({k for ks in w.FOREIGN_SECRET_WORDS.values() for k in ks}, {"@", "ab"}, {"a-b", "]x", "^y", "\\z"}, {"ß1", "Éa"}):
        text = " ".join(rng.choice([k, k.upper(), k.title(), k[:-1]]) for k in rng.choices(sorted(words), k=400))
        trie = any_word(words)
        assert re.findall(may_start(words) + trie, text) == re.findall(trie, text)
        low = sorted({k.lower() for k in words})
        plain = [x for i in range(len(text)) for x in [max((k for k in low if text.lower().startswith(k, i)), key=len, default=None)] if x]
        assert re.findall(any_literal(low), text.lower()) == plain
