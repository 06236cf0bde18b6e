"""Words of a table in texts: against brute force, long texts and words, many words, leaks."""

import random

import pytest
from pyspark.sql import functions as F

from textveil import Veil, by_name
from textveil.operators import audit, dictionary, skew
from textveil.operators.dictionary import count_words, find_words


def fold(text):
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def brute(rows, words, ignore_case):
    same = fold if ignore_case else str
    known = {}
    for w in words:
        if w:
            known[same(w)] = min(w, known.get(same(w), w))
    found = []
    for key, text in rows:
        t = same(text or "")
        for f, w in known.items():
            at = t.find(f)
            while at >= 0:
                found.append((key, at, at + len(f), w, text[at:at + len(f)]))
                at = t.find(f, at + 1)
    return sorted(map(str, found))


def table(spark, words):
    return spark.createDataFrame([(w,) for w in words], "w string")


def search(spark, rows, words, **options):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "key long, text string, word string, start int")
    got = find_words(df.repartition(3), "text", table(spark, words), ["key"], **options)
    return sorted(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("ignore_case", [True, False])
@pytest.mark.parametrize("block", [dictionary.BLOCK, 5])
def test_all_occurrences(spark, monkeypatch, ignore_case, block):
    rng = random.Random(4)
    letters = "aAbBé É😀ǅßK\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (70, None), (71, ""), (72, "aaaaaaaaaaaa")]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    words += ["aaaa", "aa", "a", "A", texts[5][2:50] or "x", "", None, words[0]]
    monkeypatch.setattr(dictionary, "BLOCK", block)
    assert search(spark, rows, words, ignore_case=ignore_case) == brute(rows, words, ignore_case)


def test_leftmost_of_overlapping_words(spark):
    rows = [(1, "abcabcd xABCD"), (1, "cd"), (2, "bcd")]
    got = search(spark, rows, ["abc", "abcd", "cd", "bcd"], resolve=True)
    assert got == sorted(map(str, [(1, 0, 3, "abc", "abc"), (1, 3, 7, "abcd", "abcd"), (1, 9, 13, "abcd", "ABCD"),
                                   (1, 0, 2, "cd", "cd"), (2, 0, 3, "bcd", "bcd")]))


def test_empty_tables(spark):
    assert search(spark, [(1, "abc")], [None, ""]) == [] and search(spark, [], ["abc"]) == []


def test_long_texts_and_words(spark):
    word = "".join(random.Random(1).choice("ab c") for _ in range(3_000))
    text = "x" * (dictionary.BLOCK - 1_000) + word + "y" * 700_000 + word[:-1]
    assert search(spark, [(1, text), (2, word)], [word, word[:5] + "zz"]) == sorted(map(str, [
        (1, dictionary.BLOCK - 1_000, dictionary.BLOCK + 2_000, word, word), (2, 0, 3_000, word, word)]))


def test_many_words_and_a_frequent_one(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    n = 100_000
    words = spark.range(n).select(F.concat(F.lit("customer#"), F.lpad("id", 9, "0")).alias("w"))
    text = F.concat(F.lit("to Customer#"), F.lpad((F.col("id") * 7 % (2 * n)).cast("string"), 9, "0"),
                    F.lit(" and customer#000000005."))
    got = count_words(spark.range(3_000).select(F.col("id").alias("doc_id"), text.alias("text")), "text", words)
    uses = {(r.doc_id, r.word): r.uses for r in got.collect()}
    want = {}
    for i in range(3_000):
        for k in (i * 7 % (2 * n), 5):
            if k < n:
                want[i, f"customer#{k:09d}"] = want.get((i, f"customer#{k:09d}"), 0) + 1
    assert uses == want


def test_originals_that_no_detector_sees(spark):
    engine = Veil(detectors=by_name("email", "ipv4"))
    df = spark.createDataFrame([(1, "mail a.b@corp.com"), (2, "host 172.16.3.4 up")], "doc_id int, text string")
    done = engine.redact(df)
    assert audit.verify_no_originals(done.documents, done.mapping).isEmpty()
    hidden = done.documents.withColumn("text", F.concat(F.col("text"), F.lit(" xé172.16.3.45")))
    assert audit.verify_no_leak(hidden, done.mapping, engine).isEmpty()
    assert sorted((r.doc_id, r.value) for r in audit.verify_no_originals(hidden, done.mapping).collect()) == [
        (1, "172.16.3.4"), (2, "172.16.3.4")]
