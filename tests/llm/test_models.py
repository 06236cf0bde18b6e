import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from textveil.llm import decontaminate, hmm, language_id, queries, sharding
from textveil.llm.common import words_of

from .conftest import prose


def benchmark_rows(rows):
    text = dict(rows)
    return [(1, " ".join(text[18].split()[55:75])), (2, "one two"), (3, None), (4, ""), (None, "日本語 テキスト"),
            (5, " ".join(text[18].split()[58:70]).upper()), (5, prose(3, 4)), (6, "never " * 12)]


def brute_hits(words, items):
    hit, found = set(), set()
    for item, text in items:
        w = words_of(text)
        for a in range(max(1, len(w) - 9) if w else 0):
            window = w[a:a + 10]
            for p in range(len(words) - len(window) + 1):
                if words[p:p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    if item is not None:
                        found.add(str(item))
    return hit, sorted(found)


@pytest.mark.parametrize("block", [32 * 1024 ** 2, 60])
def test_contamination(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = benchmark_rows(rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs, table).collect()
    assert len(got) == len(rows)
    for r in got:
        words = words_of(r.row.text)
        hit, found = brute_hits(words, items)
        spans = [p for s in r.spans for p in range(s.start, s.start + s.words)]
        assert (r.n_words, set(spans), len(spans), r.items) == (len(words), hit, len(hit), found)
    clean = decontaminate.Decontaminator(table).clean(F.col("text"))
    for r in docs.select("text", clean.alias("clean")).collect():
        assert not brute_hits(words_of(r.clean), items)[0]
        if not brute_hits(words_of(r.text), items)[0]:
            assert r.clean == r.text


def test_contamination_without_rows(docs, nothing, rows, spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.spans and not r.items for r in decontaminate.contaminated(docs, empty).collect())
    assert decontaminate.contaminated(nothing, empty).count() == 0


def test_fm_index_against_slices():
    rng = np.random.default_rng(1)
    for _ in range(20):
        symbols = np.r_[rng.integers(0, 4, rng.integers(1, 80)), 0]
        index = decontaminate.FMIndex(symbols, 3)
        patterns = np.array(list(product([1, 2, 3], repeat=3)))
        first, count = index.search(patterns)
        for p, f, n in zip(patterns, first, count, strict=True):
            want = [i for i in range(len(symbols) - 2) if (symbols[i:i + 3] == p).all()]
            assert sorted(index.locate(np.arange(f, f + n)).tolist()) == want


def test_held_out_languages(spark):
    from textveil.llm.queries import op6_language_id
    sf = "/root/testdata/sf0.01"
    got = op6_language_id(spark, sf).where("held_out").join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, docs, nothing, rows):
    training = spark.createDataFrame([(prose(s, 300, x), x) for s in range(4) for x in ("en", "de")]
                                     + [(None, "en"), ("text", None), ("12 34", "xx"), ("words", "und")],
                                     "text string, lang string")
    got = {r.row.doc_id: r for r in language_id.identify_language(docs, training).collect()}
    for i, t in rows:
        r = got[i]
        assert r.row.node == 1 and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert got[0].lang_pred == "en" and got[3].lang_pred == "de"
    assert language_id.identify_language(nothing, training).count() == 0
    assert {r.lang_pred for r in language_id.identify_language(docs, training.where("false")).collect()} == {"und"}


def test_phrases_are_longest_matches():
    data = language_id.letters(prose(1, 60))
    parser = language_id.Parser(data)
    for text in (prose(2, 40), prose(3, 40, "de"), "x", "thethethe", "日本"):
        z = language_id.letters(text)
        at = want = 0
        while at < len(z):
            n = 1
            while at + n < len(z) and z[at:at + n + 1] in data:
                n += 1
            at, want = at + n, want + 1
        got = parser.phrases(np.frombuffer(z, np.uint8), np.array([0]), np.array([len(z)]))
        assert got.tolist() == [want]


def test_shards_are_even_and_keep_groups(spark):
    nodes = spark.range(500).withColumnRenamed("id", "node")
    links = spark.range(500).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 5).alias("b")).union(
        spark.createDataFrame([(1, 1), (1, 9999), (3, None)], "a long, b long"))
    got = sharding.balanced_shards(nodes, links, 8).collect()
    size = Counter(r.shard for r in got)
    assert len(got) == 500 and max(size.values()) - min(size.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(size[s]))
    at = {r.node: r.shard for r in got}
    together = sum(at[n] == at[n - n % 5] for n in at if n % 5)
    assert together > 0.6 * 400  # by chance it would be an eighth


def test_hardly_any_link_is_cut(spark):
    """Groups of two to twenty beside one of a third of all rows: the small ones stay whole."""
    n, rows, links, at = 6_000, [], [], 2_000
    links += [(i, 0) for i in range(1, 2_000)]
    while at < n:
        size = min(2 + at % 19, n - at)
        links += [(at + i, at) for i in range(1, size)]
        at += size + at % 3
    got = sharding.balanced_shards(spark.range(n).toDF("node"), spark.createDataFrame(links, "a long, b long"), 8).collect()
    shard = {r.node: r.shard for r in got}
    size = Counter(shard.values())
    assert len(got) == n and max(size.values()) - min(size.values()) <= 1
    small = [(a, b) for a, b in links if b >= 2_000]
    assert sum(shard[a] != shard[b] for a, b in small) < 0.025 * len(small)
    hot = Counter(shard[i] for i in range(2_000))
    assert max(hot.values()) >= 0.75 * n / 8  # its hub's shard holds little else


def test_query_of_shards(spark, tmp_path):
    texts = [None, "", "", None, "a", "a", "é", "b" * 5_000, "a"] + [f"text {i}" for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a"), (4, "a"), (4, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in got)
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1
    for s, n in count.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))


def test_shards_of_a_hot_group_and_of_few_rows(spark):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    hot = spark.range(40).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    size = Counter(r.shard for r in sharding.balanced_shards(nodes, hot, 7).collect())
    assert sorted(size.values()) == [8, 8, 8, 9, 9, 9, 9]
    few = sharding.balanced_shards(nodes.limit(2), hot, 4).collect()
    assert len(few) == 2 and len({r.shard for r in few}) == 2
    assert sharding.balanced_shards(nodes.limit(0), hot, 4).count() == 0


def test_forward_is_the_sum_over_paths():
    model = hmm.Model.guess(np.array([0.1, 0.2, 0.3, 0.4]), 3)
    sequence = np.array([1, 3, 2, 2, 0])
    total = 0.0
    for path in product(range(3), repeat=len(sequence)):
        p = model.start[path[0]] * model.emit[path[0], sequence[0]]
        for a, b, c in zip(path, path[1:], sequence[1:], strict=False):
            p *= model.move[a, b] * model.emit[b, c]
        total += p
    got = model.forward([sequence, np.array([0])])
    assert math.isclose(got[0], math.log(total)) and math.isclose(got[1], math.log((model.start * model.emit[:, 0]).sum()))


def test_expected_counts_add_up():
    model = hmm.Model.guess(np.array([0.1, 0.2, 0.3, 0.4]), 3)
    sequences = [np.array([1, 3, 2, 2, 0]), np.array([2, 0]), np.array([0])]
    counts = hmm.Counts(3, 4)
    model.expect(sequences, counts)
    assert math.isclose(counts.start.sum(), 3) and math.isclose(counts.move.sum(), 5)
    assert np.allclose(counts.emit.sum(0), np.bincount(np.concatenate(sequences), minlength=4))
    assert math.isclose(counts.log, model.forward(sequences).sum())


def test_scores(spark, docs, nothing, rows):
    def learnt(i):
        return i is not None and zlib.crc32(str(i).encode()) % 3 != 1
    got = hmm.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1, states=3, rounds=2).collect()
    tokens = [(i, (t or "").encode().lower().split()) for i, t in rows]
    count = Counter(w for i, ws in tokens if learnt(i) for w in [*ws, None])
    total, distinct = sum(count.values()), len(count)
    want = sorted((str(i), len(w) + 1, sum(count[x] > 0 for x in [*w, None]), total,
                   round(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in [*w, None]), 6)) for i, w in tokens)
    assert want == sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert hmm.score_texts(nothing, F.lit(True)).count() == 0
    unlearnt = hmm.score_texts(docs, F.lit(None).cast("boolean"), states=2, rounds=1).collect()
    assert len(unlearnt) == len(rows) and {r.train_tokens for r in unlearnt} == {0}


def test_held_out_scores_beat_word_counts(spark):
    from textveil.llm.queries import op9_hmm
    got = op9_hmm(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_probabilities_of_words_add_up():
    """Known words of a class and its unseen word take all of its mass."""
    counts = [3, 1, 7]
    n, v = sum(counts), len(counts)
    assert math.isclose(sum((c + 1) / (n + v + 1) for c in counts) + 1 / (n + v + 1), 1)
