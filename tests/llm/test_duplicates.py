import random

import numpy as np
import pytest

from textveil.llm import jaccard_join, line_dedup, substring_dedup, vector_dedup
from textveil.llm.common import words_of

from .conftest import classes, prose, shingle_set


def removed(rows, length):
    """Brute force of the removal: rows in order of (id, hash of the text is not needed here)."""
    seen, out = set(), {}
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p:p + length]
            if s in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(s)
        out[key] = (bytes(c for c, g in zip(data, gone, strict=True) if not g), sum(gone))
    return out


@pytest.mark.parametrize(("length", "gram"), [(100, 32), (20, 8), (20, 16)])
def test_repeated_strings(spark, docs, rows, length, gram):
    got = substring_dedup.remove_repeats(docs, length=length, gram=gram).collect()
    once = {}
    for i, t in rows:  # a null id comes last; repeated rows are one document
        once.setdefault((i is None, i or 0), t)
    want = removed(sorted(once.items()), length)
    assert len(got) == len(rows)
    for r in got:
        kept, gone = want[(r.doc_id is None, r.doc_id or 0)]
        assert bytes(r.kept) == kept and sum(s.bytes for s in r.spans) == gone
        assert r.n_bytes == len(kept) + gone


def test_a_string_that_repeats_in_one_text_only(spark):
    one = "".join(chr(97 + i * i % 23) for i in range(40))
    got = substring_dedup.remove_repeats(
        spark.createDataFrame([(1, one + "-" + one), (2, "z" * 5)], "doc_id int, text string"), length=20, gram=8)
    assert {r.doc_id: bytes(r.kept).decode() for r in got.collect()} == {1: one + "-", 2: "z" * 5}


def test_repeats_of_random_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 2_000)  # many blocks
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = list(enumerate(texts))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id int, text string"), length=9, gram=4)
    want = removed(rows, 9)
    assert {r.doc_id: bytes(r.kept) for r in got.collect()} == {i: k for i, (k, _) in want.items()}


def test_no_rows(nothing, spark):
    assert substring_dedup.remove_repeats(nothing).count() == 0
    assert jaccard_join.similar_documents(nothing).count() == 0
    assert line_dedup.duplicate_lines(nothing).count() == 0
    assert line_dedup.without_duplicate_lines(nothing).count() == 0
    none = spark.createDataFrame([], "id long, v array<float>")
    assert vector_dedup.near_duplicates(none, "id", "v").count() == 0


def brute_jaccard(rows):
    sets = [shingle_set(t) for _, t in rows]
    return [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and (
        rows[i][1] == rows[j][1] and sets[i] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0)]


def test_similar_documents(docs, rows):
    got = jaccard_join.similar_documents(docs).collect()
    links = brute_jaccard(rows)
    low = classes(range(len(rows)), links)
    want = []
    for n, (key, _) in enumerate(rows):
        ids = [rows[m][0] for m in low if low[m] == low[n] and rows[m][0] is not None]
        cls = min(ids) if ids else None
        want.append((key, sum(a == n for a, _ in links), cls, key == cls))
    assert sorted(map(str, want)) == sorted(str((r.row.doc_id, r.n_links, r.class_id, r.kept)) for r in got)
    assert got[0].row.node == 1  # extra columns come along


def test_large_groups_go_through_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_TILE", 8)
    monkeypatch.setattr(jaccard_join, "CLUSTER_TILE", 8)
    rng, base = random.Random(5), prose(9, 120).split()
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 5)}"
        rows.append((i, " ".join(words)))
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    links = brute_jaccard(rows)
    low = classes(range(len(rows)), links)
    assert {r.row.doc_id: (r.n_links, r.class_id) for r in got} == {
        i: (sum(a == i for a, _ in links), low[i]) for i, _ in rows}


def test_shingles_of_hashes_are_those_of_words():
    texts = [words_of(prose(s, n)) for s, n in ((1, 3), (2, 5), (3, 40), (4, 1))]
    hashes, made = jaccard_join.shingles(texts)
    assert made.tolist() == [1, 1, 36, 1]
    again, _ = jaccard_join.shingles(texts[2:3])
    assert (hashes[2:38] == again).all()


def test_posterior_bounds():
    for n, least in jaccard_join.fewest_matches(0.8, 1e-6, 112):
        p = np.linspace(0, 1, 20001)
        for m, dropped in ((least - 1, True), (least, False)):
            if m >= 0:
                density = p ** m * (1 - p) ** (n - m)
                assert (density[p >= 0.8].sum() / density.sum() < 1e-6) == dropped


def vectors(rng):
    base = rng.normal(size=(40, 16))
    near = base[:25] + rng.normal(size=(25, 16)) * 0.05
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near, base[:5], base[:5] * 3]))]
    n = len(rows)
    return [*rows, (n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] + [1.0] * 15), (n + 3, [None] + [1.0] * 15),
            (n + 4, [float("inf")] + [1.0] * 15), (n + 5, []), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, [1e300] * 16)]


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE", 6)
    rows = vectors(np.random.default_rng(2))
    table = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, e array<double>, kept long")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(table, "vec_id", "e", pivots=12).collect()}
    fine = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    unit = {i: (v / abs(v).max()) / np.linalg.norm(v / abs(v).max()) for i, v in fine.items()}
    links = [(a, b) for a in unit for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(rows) and 0.9 * len(links) <= found <= len(links)
    low = classes([i for i, _ in rows], links)
    assert sum(got[i].component_id == low[i] for i in low) >= 0.9 * len(low)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[i].n_links == 0 for i, _ in rows if i not in fine)


def test_recall_of_the_registered_query(spark):
    from textveil.llm.queries import op2_vector_dedup
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x = np.array([r.embedding for r in table], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = int((x @ x.T >= 0.95).sum()) - len(x)
    found = sum(r.n_links for r in op2_vector_dedup(spark, "/root/testdata/sf0.01").collect())
    assert 0.9 * links <= found <= links


@pytest.mark.parametrize(("groups", "share", "median"), [(1, 1 / 3, 0.957), (1, 1 / 3, 0.97), (1, 1 / 3, 0.99), (16, 1 / 16, 0.97)])
def test_recall_in_large_groups_of_near_vectors(spark, groups, share, median):
    rng, n, d = np.random.default_rng(4), 1500, 64
    x = rng.normal(size=(n, d))
    size = int(n * share)
    for g in range(groups):
        centre = rng.normal(size=d)
        centre /= np.linalg.norm(centre)
        x[g * size:(g + 1) * size] = centre + rng.normal(size=(size, d)) * np.sqrt((1 / median - 1) / d)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = int((x @ x.T >= 0.95).sum()) - n
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, e array<double>")
    found = sum(r.n_links for r in vector_dedup.near_duplicates(table, "vec_id", "e").collect())
    assert links > 40_000 and 0.99 * links <= found <= links


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_lines_within_edits(spark, most):
    rng = random.Random(most)
    lines = []
    for k in range(25):
        line = "".join(rng.choice("abcé ") for _ in range(rng.randint(8, 30)))
        lines.append(line)
        for _ in range(3):
            chars = list(lines[-1])
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(chars))
                chars[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "é", "yy"])
            lines.append("".join(chars))
    rows = [(i, "\n".join(lines[i::10])) for i in range(10)]
    got = line_dedup.duplicate_lines(
        spark.createDataFrame(rows, "doc_id long, text string"), edits=most, shortest=8).collect()
    places = [(i, k) for i, t in rows for k, _ in enumerate(t.split("\n"))]
    text = {(i, k): line for i, t in rows for k, line in enumerate(t.split("\n"))}
    links = [(a, b) for a in places for b in places if a != b and min(len(text[a]), len(text[b])) >= 8
             and edits(text[a], text[b]) <= most]
    low = classes(places, links)
    assert {(r.doc_id, r.line_no): (r.n_links, (r.class_key, r.class_line), r.kept) for r in got} == {
        p: (sum(a == p for a, _ in links), low[p], low[p] == p) for p in places}


@pytest.mark.parametrize("most", [2, 3])
def test_short_lines_with_fewer_edits(spark, most):
    rng = random.Random(most)
    lines = ["", "", "Les.", "Les.", "Les!", "a", "a", " ", " "]
    for n in range(2, 26):
        line = "".join(rng.choice("abcé ") for _ in range(n))
        lines += [line, line]
        for _ in range(4):
            chars = list(line)
            for _ in range(rng.randint(1, most)):
                at = rng.randrange(len(chars) + 1)
                chars[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
            lines.append("".join(chars))
    rows = [(i, "\n".join(lines[i::10])) for i in range(10)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    text = {(i, k): line for i, t in rows for k, line in enumerate(t.split("\n"))}

    def linked(x, y):
        n = min(len(x), len(y))
        return n and edits(x, y) <= min(most, n * most // 20)

    links = [(a, b) for a in text for b in text if a != b and linked(text[a], text[b])]
    low = classes(list(text), links)
    got = line_dedup.duplicate_lines(table, edits=most, short=True).collect()
    assert {(r.doc_id, r.line_no): (r.n_links, (r.class_key, r.class_line), r.kept) for r in got} == {
        p: (sum(a == p for a, _ in links), low[p], low[p] == p) for p in text}
    left = {r.doc_id: r.text for r in line_dedup.without_duplicate_lines(table, edits=most).collect()}
    assert left == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if low[i, k] == (i, k)) for i, t in rows}


def test_lines_are_taken_out(docs, rows, spark):
    left = line_dedup.without_duplicate_lines(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    by = {(r.doc_id, r.row): r.text for r in left.collect()}
    texts = dict(rows)
    assert by[(0, texts[0])] == texts[0] and by[(1, texts[1])] == ""
    assert by[(5, None)] is None and by[(4, "")] == ""
    assert by[(10, texts[10])] == texts[10].split("\n")[1]


def test_line_dedup_runs_no_python(docs):
    plan = line_dedup.linked_lines(line_dedup.lines_of(docs, "doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_lines_that_share_a_hash(spark):
    first, other, near = "the same hash for two lines", "another line of text entirely", "the same hash for two lined"
    lines = spark.createDataFrame([(1, first), (1, other), (2, near)], "h1 long, line string")
    got = line_dedup.linked_lines(lines)
    want = spark.createDataFrame([(first,), (near,)], "s string").selectExpr("xxhash64(1, s) AS h").collect()
    assert [(r.a.h1, r.a.h2, r.b.h1, r.b.h2) for r in got.collect()] == [(1, want[0].h, 2, want[1].h)]
