"""One pass for the keywords of all languages gives what one pass per language gives."""

import random

import pytest

from textveil import find_spans
from textveil.functions import words as w
from textveil.functions.detectors import KEYWORD, Detector, any_word, foreign_secrets
from textveil.operators import scan
from textveil.operators.scan import Scanner, explode_spans


def both(spark, texts, detectors, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = []
    for unite in (False, True):
        spans = Scanner(detectors, unite=unite, **options).spans(df, "text")
        found.append(sorted(map(str, explode_spans(spans, detectors, ["doc_id"]).collect())))
    return found


def test_languages_together(spark, monkeypatch):
    rng = random.Random(7)
    keywords = [k for listed in w.FOREIGN_SECRET_WORDS.values() for k in listed]
    glue = ["", " ", " ", "\n", '"', "'", "; ", "mon ", "mi ", "mein ", "minha ", "la mia ", "mijn ", "我的", "の", "내 ", "мой ", "ال", "है",
            "est ", "the ", "und ", "não ", "é "]
    links = [" est ", "=", ": ", " = ", " es ", " é ", "は", " ist ", "是", ' = "', ": '", " ", " is"]
    values = ["abcdef", "REDACTED_1", "xy", "pass1234", "a b c d e", "мойключ", 'qwerty"', "zz99'"]

    def piece():
        k = rng.choice(keywords)
        k = rng.choice([k, k.upper(), k.title(), k[:-1]])
        return rng.choice(glue) + k + rng.choice(links) + rng.choice([*values, rng.choice(keywords)]) + rng.choice(glue)

    texts = ["".join(piece() for _ in range(rng.randint(1, 14))) for _ in range(600)] + ["", None, "plain"]
    for least in (2, 3):
        monkeypatch.setattr(scan, "UNITE_FROM", least)
        alone, together = both(spark, texts, list(foreign_secrets()), allow=("mdp = abcdef",))
        assert alone == together and len(alone) > 1_000


def kinds(**keywords):
    around = rf"(({KEYWORD})\s*:\s*)([a-z0-9:]{{2,}})"
    return [Detector(name, name, around.replace(f"({KEYWORD})", f"(?:{any_word(ks)})"), name + "_{n}", 50, prefix=1, value=2,
                     keywords=tuple(ks), around=around) for name, ks in keywords.items()]


@pytest.mark.parametrize("text", ["pass:word:abc", "aa:bb:cc:dd", "password: xx pass: yy", "pass:xx key:yy pass:key:zz", "aa:xx"])
def test_matches_that_overlap_are_run_one_by_one(spark, monkeypatch, text):
    monkeypatch.setattr(scan, "UNITE_FROM", 1)
    detectors = kinds(one=["word", "bb", "key"], two=["pass", "cc", "aa"], three=["password", "aa", "dd"], four=["pas", "key"])
    alone, together = both(spark, [text, text + " " + text], detectors)
    assert alone == together and alone


def test_find_spans_takes_the_option(spark):
    df = spark.createDataFrame([(1, "mon mot de passe est abc123 ; mein Passwort ist xyz789 ; mi contraseña es qqq111")],
                               "doc_id int, text string")
    got = find_spans(df, "text", list(foreign_secrets()), resolve=True, unite=True).collect()
    assert sorted(r.value for r in got) == ["abc123", "qqq111", "xyz789"]
