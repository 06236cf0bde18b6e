"""The mapping of a stream: batches, merged tiers, lookups by bucket, repeated batches."""

import pytest
from pyspark.sql import functions as F

from textveil import Veil, by_name
from textveil.streaming import store as st
from textveil.streaming import stream


def test_tiers_and_buckets(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "s"), "k string, v bigint", ["k"], buckets=8, fan=3)
    want = []
    for b in range(20):
        rows = [(f"k{b * 5 + i}" if i else None, b) for i in range(5)]
        want += rows
        store.append(b, spark.createDataFrame(rows, store.schema))
        assert len(store.folders()) <= 2 + 2 + 2
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, store.read().collect()), key=key) == sorted(want, key=key)
    for before in (0, 1, 9, 10, 17):
        got = sorted(map(tuple, store.read(before).collect()), key=key)
        assert got == sorted((r for r in want if r[1] < before), key=key)
    wanted = spark.createDataFrame([("k7",), ("k56",)], "k string")
    some = store.read(18, wanted)
    assert {"k7", "k56"} <= {r.k for r in some.collect()} and some.count() < 60
    assert store.read(18, wanted.where("false")).count() == 0
    # a batch that is run again, and a merge that did not end
    before = store.folders()
    store.append(8, spark.createDataFrame([r for r in want if r[1] == 8], store.schema))
    (tmp_path / "s" / "tier=2" / "first=9" / "_SUCCESS").unlink()
    assert store.folders() != before
    assert sorted(map(tuple, store.read().collect()), key=key) == sorted(want, key=key)


def test_a_late_batch_reads_no_more_than_an_early_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "FAN", 4)
    engine = Veil(detectors=by_name("email"))
    store = stream.mapping_store(spark, f"{tmp_path}/mapping")
    read = []
    original = st.Store.read

    def counted(self, before=None, keys=None):
        rows = original(self, before, keys)
        if keys is not None:
            read.append((rows.count(), len(self.folders(before))))
        return rows

    monkeypatch.setattr(st.Store, "read", counted)
    texts = {}
    for b in range(14):
        mails = [f"user{b * 40 + i}@corp.com" for i in range(40)]
        rows = [(b, " ".join(mails) + " old@corp.com")] if b % 7 == 0 else [(b, f"old@corp.com and user{b}@corp.com and n{b}@corp.com")]
        texts |= dict(rows)
        for _ in range(2 if b in (3, 8) else 1):
            stream.redact_batch(spark.createDataFrame(rows, "doc_id int, text string"), b, engine, f"{tmp_path}/mapping", f"{tmp_path}/out")
    mapping = stream.final_mapping(spark, f"{tmp_path}/mapping")
    assert mapping.count() == mapping.select("value").distinct().count() == mapping.select("pseudonym").distinct().count()
    assert sorted(r.n for r in mapping.collect()) == list(range(1, mapping.count() + 1))
    back = engine.restore(spark.read.parquet(f"{tmp_path}/out").select("doc_id", "text"), mapping)
    assert {r.doc_id: r.text for r in back.collect()} == texts
    small = [n for n, _ in read[-6:]]  # batches of three values: a few of 256 buckets
    assert max(small) <= 12 and store.read().count() > 80


@pytest.mark.parametrize("standing", [10_000])
def test_many_taken_numbers_and_a_huge_one(spark, standing):
    from textveil import custom_detector

    engine = Veil(detectors=[custom_detector("ticket", r"TICKET-\d+", "REF_{n}")])
    taken = " ".join(f"REF_{n}" for n in range(1, standing + 1)) + " REF_9999999999999999999"
    df = spark.createDataFrame([(1, taken), (2, "TICKET-1 TICKET-2")], "doc_id int, text string")
    done = engine.redact(df)
    assert sorted(r.n for r in done.mapping.collect()) == [standing + 1, standing + 2]
    assert sorted(engine.restore(done.documents, done.mapping).collect()) == sorted(df.collect())
    assert done.mapping.where(F.col("reversible")).count() == 2


def test_numbers_round_taken_ones(spark):
    """Against brute force, over scopes, categories and a mapping that is continued."""
    import random

    from textveil import custom_detector
    from textveil.operators import mapping as mp

    detectors = [custom_detector("a", "x", "A_{n}"), custom_detector("b", "x", "B-{n:03d}-z"), custom_detector("c", "x", "[C]")]
    rng = random.Random(5)
    taken = {"a": {rng.randint(1, 60) for _ in range(30)} | set(range(70, 90)) | {10 ** 18}, "b": {1, 2, 3, 999, 1000, 7}}
    tokens = [f"A_{n}" for n in taken["a"]] + [f"B-{n:03d}-z" for n in taken["b"]]
    tokens += ["A_007", "B-7-z", "A_", "A_99999999999999999999", "[C]", "A_5x", "Z_4", "A_0"]
    left = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = {(r.category, r.place) for r in mp.taken_numbers(left, detectors).collect()}
    assert got == {(c, n) for c, ns in taken.items() for n in ns}
    last = {("s0", "a"): 33, ("s1", "a"): 75, ("s0", "b"): 998, ("s2", "a"): 95}
    rows = [(s, c, f"{s}{c}{i}", last.get((s, c), 0) + i) for s in ("s0", "s1", "s3") for c in "abc" for i in range(1, 41)]
    numbered = spark.createDataFrame(rows, "scope string, category string, value string, n bigint")
    table = spark.createDataFrame([(s, c, n) for (s, c), n in last.items()], "scope string, category string, n bigint")
    numbers = spark.createDataFrame([(c, n) for c, ns in taken.items() for n in ns], "category string, place bigint")
    for before in (table, None):
        some = rows if before is not None else [(s, c, v, i) for s in ("s0",) for c in "abc" for i, v in enumerate("pqrst" * 9, 1)]
        source = numbered if before is not None else spark.createDataFrame([(s, c, v + str(n), n) for s, c, v, n in some], numbered.schema)
        want = set()
        for s, c, v, n in some if before is not None else [tuple(r) for r in source.collect()]:
            base = last.get((s, c), 0) if before is not None else 0
            free = (x for x in range(base + 1, 10 ** 6) if x not in taken.get(c, ()))
            for _ in range(n - base):
                x = next(free)
            want.add((s, c, v, x))
        got = {(r.scope, r.category, r.value, r.n) for r in mp.around_taken(source, numbers, before).collect()}
        assert got == want


def test_many_values_in_a_row(spark):
    import time

    from conftest import redact_each

    engine = Veil(detectors=by_name("email"))
    redact_each(spark, ["a@corp.com"], engine)
    took = []
    for n in (2_000, 20_000):
        text = " ".join(f"user{i * 7919 % n}@corp.com and" for i in range(n + 50))
        began = time.time()
        (redacted, mapping), = redact_each(spark, [text], engine)
        took.append(time.time() - began)
        assert len(mapping) == n and redacted.startswith("user-1@redacted.example.net and user-2@")
        for p in sorted(mapping, key=len, reverse=True)[:50]:
            assert p in redacted
        df = spark.createDataFrame([(1, text)], "doc_id int, text string")
        done = engine.redact(df, scope="document")
        assert engine.restore(done.documents, done.mapping, scope="document").first().text == text
    assert took[1] < 20 + 15 * took[0]
