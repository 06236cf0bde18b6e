import re

from textveil import find_spans
from textveil.functions.detectors import BUILT_IN, FAMILIES, by_name, foreign_secrets, ordered
from textveil.functions.dialect import any_word, first_letters
from textveil.functions.languages import detect_languages, keywords_for
from textveil.functions.words import FOREIGN_SECRET_WORDS
from textveil.operators import scan
from textveil.operators.scan import Scanner
from textveil.sources.readers import split_lines
from workload.queries import longer_words

TEXTS = ["Le mot de passe: x", "nichts und wieder nichts", None, "", "пароль привет\nlonger wordsinhere", "el perro y la casa, una contraseña"]


def filters_below(df):
    """Filters by the size of an array under the repartition of a plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("Repartition", 1)[1].split("\n") if "Filter" in line and "size(" in line]


def texts_of(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4)


def test_languages_are_looked_for_once_and_after_the_repartition(spark):
    found = keywords_for(texts_of(spark).select("doc_id", detect_languages("text").alias("langs")))
    assert not filters_below(found)
    langs = texts_of(spark).select("doc_id", detect_languages("text").alias("langs")).collect()
    assert sorted(r.doc_id for r in found.collect()) == sorted(
        r.doc_id for r in langs for x in r.langs for _ in FOREIGN_SECRET_WORDS.get(x, ()))
    listed = spark.createDataFrame([(1, None), (2, []), (3, ["fr"])], "doc_id long, langs array<string>")
    assert {r.doc_id for r in keywords_for(listed).collect()} == {3}


def test_words_and_lines_are_cut_once_and_after_the_repartition(spark):
    words = longer_words(texts_of(spark))
    assert not filters_below(words)
    assert sorted(r.word for r in words.collect()) == ["contrase", "wordsinhere"]
    lines = split_lines(texts_of(spark), "doc_id")
    assert not filters_below(lines)
    assert sorted((r.doc_id, r.line_no) for r in lines.collect()) == [(0, 0), (1, 0), (3, 0), (4, 0), (4, 1), (5, 0)]


def test_groups_outside_ascii_are_looked_up_by_ranges():
    words = [x for listed in FOREIGN_SECRET_WORDS.values() for x in listed]
    regex = any_word(words)
    wide = [x for x in re.findall(r"\(\?=\[([^]]*)\]\)", regex) if not x.isascii()]
    assert wide and all(re.fullmatch(r"(.-.){1,2}", x) for x in wide)
    for word in words:
        assert re.fullmatch(regex, word) and re.fullmatch(regex, word.lower())


def test_first_letters_of_keywords_lose_nothing():
    assert first_letters(r"dob|date\s+of\s+birth|born") == "bd"
    labelled = [d for d in BUILT_IN if d.labelled]
    assert labelled and all(d.regex.startswith("(?=[") for d in labelled)


def test_few_and_many_claims_are_decoded_alike(spark, monkeypatch):
    texts = ["", None, "no", "a@b.com é", *("😀é 10.1.2.3/8 u%d@mail.com, tel +44 2000 123456 | " % i * i for i in (1, 3, 12, 40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    detectors = ordered(by_name(*FAMILIES["network"], "phone_uk", "phone_us"))

    def found(resolve):
        return sorted(map(tuple, find_spans(df, "text", detectors, resolve=resolve).collect()))

    both = {}
    for few in (0, 32, 1_000):
        monkeypatch.setattr(scan, "FEW_CLAIMS", few)
        both[few] = found(True), found(False)
    assert both[0] == both[32] == both[1_000] and len(both[0][0]) >= 3 * (1 + 3 + 12 + 40)
    rows = [dict(zip(find_spans(df, "text", detectors).columns, r, strict=True)) for r in both[32][0]]
    for r in rows:
        assert texts[r["doc_id"]][r["start"]:r["end"]] == r["match"]
        assert texts[r["doc_id"]][r["v_start"]:r["v_end"]] == r["value"]


def test_short_rows_are_decoded_without_running_sums(spark):
    df = spark.createDataFrame([(1, "u@mail.com and 10.1.2.3")], "doc_id long, text string")
    assert "aggregate" not in Scanner.decode("s", "c").split("<=")[1].split("ELSE")[0]
    spans = Scanner(list(foreign_secrets()), unite=True).spans(df, "text")
    assert spans.first().spans == []
