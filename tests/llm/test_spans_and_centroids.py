import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from textveil.llm import centroids, fill_in_middle, personal_data, pii_examples, queries

from .conftest import prose


# --- fill in middle

def brute_form(key, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [fill_in_middle.BLOCK, 7])
def test_fill_in_middle(docs, rows, block):
    found = fill_in_middle.fill_in_middle(docs, block=block)
    got = found.select("row", "n", "form", "prefix_chars", "middle_chars", "output",
                       fill_in_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    want = [(k, t, *brute_form(k, t)) for k, t in rows]
    assert sorted(map(str, want)) == sorted(
        str((r.row.doc_id, r.row.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got)
    assert all(r.back == (r.row.text or "") for r in got)


def test_fill_in_middle_markers_and_long_texts(spark):
    texts = ["<P>", "a<S>b", "x <M", "<<P", "S>" * 50, "<P" * 50, "é😀\n" * 400_000, " " * 1_000_000, "w" * 1_000_001, "😀"]
    rows = [(i, t) for i in range(30) for t in texts[:6]] + [(i, t) for i in range(2) for t in texts[6:]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = fill_in_middle.fill_in_middle(df).withColumn(
        "back", fill_in_middle.restored(F.col("output"), F.col("form")))
    for r in found.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_form(r.row.doc_id, r.row.text)
        assert r.back == r.row.text


def test_fill_in_middle_other_units(spark, nothing):
    words = regex.compile(r"(?s)(\s*\S+|\s+\Z)*+")
    for block in (4, 1 << 20):
        assert fill_in_middle.unit_ends("one two  three", words, block).tolist() == [3, 7, 14]
    assert not len(fill_in_middle.unit_ends("", words))
    with pytest.raises(ValueError):
        fill_in_middle.unit_ends("ab c", regex.compile(r"([a-z])*+"))
    with pytest.raises(ValueError):
        fill_in_middle.transformed(F.col("k"), F.col("t"), markers=("<P>", "><", "<M>"))
    assert fill_in_middle.fill_in_middle(nothing).count() == 0


# --- centroids

def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()))
    at = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for c in range(len(at)):
            mine = [v for (_, v), (_, i) in zip(kept, near, strict=True) if i == c]
            if mine:
                at[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    near = assign()
    per = [sum(d for d, i in near if i == c) for c in range(len(at))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(str((k, i, d, per[i], sum(per), digest[i])) for (k, _), (d, i) in zip(kept, near, strict=True))


def clustered(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1, 2, []) for i, v in rows],
                               "vec_id long, embedding array<float>, row string, cluster int, t int, centroid array<int>")
    found = centroids.cluster_vectors(df.repartition(3), "vec_id", "embedding")
    return sorted(str((r.row.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256))
                  for r in found.collect())


def vectors(seed, n, groups=9):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, 64))
    return [(i, (middle[i % groups] + 0.3 * rng.normal(size=64)).tolist()) for i in range(n)]


def test_clusters(spark):
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63),
           (905, [float("nan")] + [1.0] * 63), (906, [float("inf")] + [1.0] * 63)]
    copies = [(i, [0.25] * 64) for i in range(500, 560)] + [(560, [0.0] * 64)] * 3
    rows = vectors(1, 150) + bad + copies
    assert clustered(spark, rows) == brute_clusters(rows)


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(5, [0.5] * 64)], vectors(3, 5), [(i, [0.0] * 64) for i in range(20)],
    [(i, [float(i % 3 == j % 3) for j in range(64)]) for i in range(30)], [(None, [1.0] * 64), *vectors(4, 4)],
], ids=["none", "null", "one", "few", "equal", "ties", "null key"])
def test_clusters_of_awkward_tables(spark, rows):
    assert clustered(spark, rows) == brute_clusters(rows)


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="beyond"):
        clustered(spark, [(1, [1e6] + [0.0] * 63)])


def test_progressive_search_is_exact():
    rng = np.random.default_rng(5)
    assert (centroids.WALSH @ centroids.WALSH.T == 64 * np.eye(64)).all()
    for scale in (2, 50, 1 << 23):
        x = rng.integers(-scale, scale + 1, (300, 64))
        c = np.concatenate([x[:5], rng.integers(-scale, scale + 1, (3, 64)), x[:2]])
        c[0] = x[0] = np.resize([scale, -scale], 64)
        x[1] = -x[0]
        number, distance = centroids.nearest(centroids.transform(x), centroids.transform(c))
        full = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()
        assert (centroids.inverse(centroids.transform(x)) == x).all()


# --- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((kind, *m.span()))
    return found


PII = [
    "a@b.c_d@e.f", "x.y@z", "x@y.z.", "é.a@b.cd ü@x.yy", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111  1111 1111 1111", "4111111111111112", "+1 (017) 555-7713",
    "+12", "+123456789", "+1234567890123456", "+1 2 3 4 5 6 7 8 9 ", "+ 12345678901", "++49 30 123456", "+1.2.3.4.5.6.7.8.9",
    "call +44 20 7946 0958, 10.0.0.1 or a.b+c@mail.example.org", "😀 a@b.cd 😀 +1 (017) 555-7713",
]


def test_patterns_are_those_of_the_contract():
    rng = random.Random(1)
    texts = PII + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
                   for letters in ("ab12 90.@+-()_é\n", "a.@-_", "12.", "0123456789 -", "+1 ()-.") for _ in range(3000)]
    for text in texts:
        assert personal_data.base_spans(text) == brute_base(text), text


@pytest.fixture(scope="module")
def tagger(spark):
    return personal_data.train(personal_data.labelled(spark))


def test_found_spans(spark, docs, rows, nothing, tagger):
    got = personal_data.find_personal_data(docs).collect()
    assert sorted(str(r.row.doc_id) for r in got) == sorted(str(k) for k, _ in rows)
    extra = [(i, t) for i, t in enumerate([*PII, None, "", "Contact Maria Keller at (020) 7946-0958 or a@b.cd, +1 (017) 555-7713.",
                                           "Contact Maria Keller at (020) 7946-0958 or a@b.cd, +1 (017) 555-7713."])]
    df = spark.createDataFrame(extra, "doc_id long, text string").repartition(3)
    for r in personal_data.find_personal_data(df).collect():
        text = r.row.text or ""
        base = [(s.kind, s.start, s.end) for s in r.spans if s.base]
        assert base == brute_base(text)
        order = [(personal_data.BASE.index(s.kind) if s.kind in personal_data.BASE else 9, s.start) for s in r.spans]
        assert order == sorted(order)
        for s in r.spans:
            assert s.base or all(s.end <= a or b <= s.start for _, a, b in base)
        if "Maria" in text:
            assert {text[s.start:s.end] for s in r.spans} == {"Maria Keller", "(020) 7946-0958", "a@b.cd", "+1 (017) 555-7713"}
    assert personal_data.find_personal_data(nothing).count() == 0
    none = spark.createDataFrame([], "text string, spans array<struct<kind: string, start: int, end: int>>")
    only = personal_data.find_personal_data(df, examples=none).collect()
    assert all(s.base for r in only for s in r.spans) and len(only) == len(extra)


def test_query_of_personal_data(spark, tmp_path):
    texts = [*PII, None, "", "Dear Mrs Olga Weber, a@b.cd"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op11_personal_data(spark, str(tmp_path)).collect():
        base = brute_base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in PATTERNS]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_held_out_values(tagger):
    rows = pii_examples.examples(seed=99, rounds=6)
    got = tagger.spans([t for t, _ in rows])
    hit = sum(len(set(g) & set(w)) for g, (_, w) in zip(got, rows, strict=True))
    assert hit >= 0.97 * sum(len(w) for _, w in rows) and hit >= 0.97 * sum(map(len, got))
    clean = [prose(i, 200) for i in range(50)] + ["it " * 500, "Of " * 300]
    assert not any(tagger.spans(clean))


def test_long_texts(tagger):
    person = "Contact Maria Keller at (020) 7946-0958."
    for filler, joint in (("water under the house ", "\n"), ("x", " "), (" ", " "), ("1 ", "\n"), ("\n", "\n"), ("a.", "\n")):
        pad = filler * (1_100_000 // len(filler))
        found = personal_data._tagged(tagger, [pad + joint + person + joint + pad, "", person])
        assert found[2] == [("name", 8, 20), ("phone", 24, 39)] and found[1] == []
        at = len(pad) + 1
        assert {("name", at + 8, at + 20), ("phone", at + 24, at + 39)} <= set(found[0])


def test_viterbi_and_likelihood_by_enumeration():
    rng = np.random.default_rng(2)
    length = np.array([1, 4, 3, 5])
    first = np.cumsum(length) - length
    n, labels = int(length.sum()), 3
    emissions, moves, starts = rng.normal(size=(n, labels)), rng.normal(size=(labels, labels)), rng.normal(size=labels)
    got = personal_data.viterbi(emissions, moves, starts, first, length, np.zeros(4, int), length)
    label = rng.integers(0, labels, n)
    value, by_emission, by_move = personal_data.likelihood(emissions, moves, starts, label, first, length)
    want = 0.0
    for a, m in zip(first, length, strict=True):
        def score(y, a=a):
            return starts[y[0]] + sum(emissions[a + i, y[i]] for i in range(len(y))) + sum(moves[p] for p in zip(y, y[1:], strict=False))
        ways = list(product(range(labels), repeat=int(m)))
        assert tuple(got[a:a + m]) == max(ways, key=score)
        want += score(label[a:a + m]) - np.log(sum(np.exp(score(y)) for y in ways))
    assert abs(value - want) < 1e-9
    step = 1e-6
    for array, gradient in ((emissions, by_emission), (moves, by_move)):
        for at in [(0, 1), (2, 2), (1, 0)]:
            array[at] += step
            more = personal_data.likelihood(emissions, moves, starts, label, first, length)[0]
            array[at] -= step
            assert abs((more - value) / step - gradient[at]) < 1e-4


def test_windows_agree_with_whole_lines(tagger, monkeypatch):
    text = " ".join(t for t, _ in pii_examples.examples(seed=4, rounds=1)[:60])
    whole = personal_data.Tokens([text])
    monkeypatch.setattr(personal_data, "WINDOW", 10 ** 9)
    want = tagger.decode(whole)
    monkeypatch.setattr(personal_data, "WINDOW", 50)
    assert (tagger.decode(whole) == want).mean() > 0.99
