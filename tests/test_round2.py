"""Rows with null or repeated keys, one-pass restoring, leftovers of earlier batches."""

import pytest
from pyspark.sql import functions as F

from textveil import Veil, by_name, custom_detector
from textveil.functions.detectors import ordered
from textveil.functions.words import GIVEN_NAMES, SURNAMES
from textveil.operators.restore import restore_exact, restore_join, restore_nested
from textveil.streaming import stream
from workload import queries

MAILS = ordered(by_name("email"))


def mails(**options):
    return Veil(detectors=MAILS, **options)


@pytest.mark.parametrize("scope", ["corpus", "document", "source"])
def test_null_and_repeated_keys_and_scopes(spark, scope):
    rows = [(1, "to x@corp.com", "a"), (1, "to y@corp.com", None), (None, "mail y@corp.com", None),
            (None, "and z@corp.com, x@corp.com", "a"), (2, None, "b"), (2, "none", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    done = mails().redact(df, scope=scope)
    texts = [r.text for r in done.documents.collect()]
    assert len(texts) == len(rows) and not any("corp.com" in t for t in texts if t)
    back = restore_join(done.documents, "text", done.mapping, MAILS, ["doc_id"], scope)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_rows_that_share_a_key_share_a_numbering(spark):
    df = spark.createDataFrame([(1, "mail a@x.com"), (1, "mail b@y.com and c@z.com"), (2, "to b@y.com"), (None, "a@x.com"),
                                (None, "b@y.com, a@x.com")], "doc_id int, text string")
    done = mails().redact(df, scope="document")
    names = done.mapping.groupBy("scope", "pseudonym").count()
    assert done.mapping.where("NOT reversible").isEmpty() and names.where("count > 1").isEmpty()
    back = restore_join(done.documents, "text", done.mapping, MAILS, ["doc_id"], "document")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_two_values_for_a_token_leave_it(spark):
    pairs = [("user-1@redacted.example.net", "a@x.com"), ("user-1@redacted.example.net", "b@x.com"),
             ("user-2@redacted.example.net", "c@x.com"), ("user-2@redacted.example.net", "c@x.com")]
    df = spark.createDataFrame([(1, "user-1@redacted.example.net user-2@redacted.example.net")], "doc_id int, text string")
    want = "user-1@redacted.example.net c@x.com"
    mapping = entries(spark, pairs)
    assert restore_exact(df, "text", mapping).first().text == want
    assert restore_join(df, "text", mapping, MAILS).first().text == want
    assert stream.restore_stream(df, mapping).first().text == want
    assert restore_nested(df, mapping, MAILS, ["doc_id"]).first().text == want


def test_allowlist_table_with_null_keys(spark):
    df = spark.createDataFrame([(None, "x@corp.com y@corp.com"), (None, "x@corp.com")], "doc_id int, text string")
    allow = spark.createDataFrame([("x@corp.com",)], "value string")
    texts = [r.text for r in mails(allow=allow).redact(df).documents.collect()]
    assert sum("x@corp.com" in t for t in texts) == 2 and not any("y@corp.com" in t for t in texts)


MAPPING = ("scope string, value string, pseudonym string, category string, pattern string,"
           " confidence string, n bigint, reversible boolean")


def entries(spark, pairs):
    return spark.createDataFrame([("", v, p, "email", "email", "high", i, True) for i, (p, v) in enumerate(pairs)], MAPPING)


def test_a_restored_value_is_not_replaced_again(spark):
    pairs = [("user-1@redacted.example.net", "user-2@redacted.example.net"),
             ("user-2@redacted.example.net", "real@corp.com")]
    df = spark.createDataFrame([(1, "a user-1@redacted.example.net b user-2@redacted.example.net")], "doc_id int, text string")
    want = "a user-2@redacted.example.net b real@corp.com"
    mapping = entries(spark, pairs)
    assert restore_exact(df, "text", mapping).first().text == want
    assert restore_join(df, "text", mapping, MAILS).first().text == want
    assert restore_nested(df, mapping, MAILS, ["doc_id"]).first().text == want
    assert restore_nested(df, mapping).first().text == want
    assert stream.restore_stream(df, mapping).first().text == want


def test_restoring_with_more_entries_than_fit_an_expression(spark):
    n = 12_000
    mapping = spark.range(n).select(
        F.lit("").alias("scope"), F.concat(F.lit("v"), "id").alias("value"), F.concat(F.lit("A[x]_"), "id").alias("pseudonym"),
        F.lit("c").alias("category"), F.lit("p").alias("pattern"), F.lit("high").alias("confidence"),
        F.col("id").alias("n"), F.lit(True).alias("reversible"))
    df = spark.createDataFrame([(1, "A[x]_11999 and A[x]_7, A[x]_120001 A[x]_x")], "doc_id int, text string")
    # the longest entry that a token begins with counts: 12000 is none, 1200 is one
    want = "v11999 and v7, v120001 A[x]_x"
    assert restore_exact(df, "text", mapping).first().text == want
    assert restore_nested(df, mapping, key=["doc_id"]).first().text == want


def tickets():
    return Veil(detectors=[custom_detector("ticket", r"TICKET-\d+", "REF_{n}")])


def test_leftovers_of_earlier_batches(spark, tmp_path):
    engine, base = tickets(), str(tmp_path)
    for k, text in enumerate(["plain REF_1 here", "see TICKET-77 and TICKET-78"]):
        batch = spark.createDataFrame([(k, text)], "doc_id int, text string")
        for _ in range(2):  # a batch that is run again changes nothing
            stream.redact_batch(batch, k, engine, f"{base}/mapping", f"{base}/out")
    mapping = stream.final_mapping(spark, f"{base}/mapping")
    out = spark.read.parquet(f"{base}/out").select("doc_id", "text")
    back = engine.restore(out, mapping)
    assert sorted(r.text for r in back.collect()) == ["plain REF_1 here", "see TICKET-77 and TICKET-78"]


def test_leftovers_of_an_earlier_corpus(spark):
    engine = tickets()
    first = engine.redact(spark.createDataFrame([(1, "REF_1 REF_2 TICKET-5")], "doc_id int, text string"))
    second = engine.redact(spark.createDataFrame([(2, "TICKET-6 TICKET-5")], "doc_id int, text string"),
                           mapping=first.mapping, leftovers=first.leftovers)
    names = {r.value: r.pseudonym for r in second.mapping.collect()}
    assert len(set(names.values())) == 2 and not {"REF_1", "REF_2"} & set(names.values())


@pytest.mark.parametrize("standing", [
    " ".join(f"REF_{n}" for n in range(1, 30)), "REF_99999999999999999999", "REF_999999999999", "REF_9223372036854775807"])
@pytest.mark.parametrize("scope", ["corpus", "document"])
def test_clashes_end_whatever_numbers_stand_there(spark, standing, scope):
    text = f"TICKET-1 {standing} TICKET-2"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    done = tickets().redact(df, scope=scope)
    assert all(r.reversible for r in done.mapping.collect())
    assert restore_join(done.documents, "text", done.mapping, tickets().detectors, ["doc_id"], scope).first().text == text


def test_lines_of_large_files(spark, tmp_path):
    """Many splits per file: numbers go on from split to split."""
    from textveil.sources.readers import read_lines

    texts = {f"{name}.txt": [f"{name}{i} " + "x" * (i % 50) + "\r" * (i % 2) for i in range(3_000)] for name in "ab"}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 6_000
    for r in got:
        assert texts[r.path.rsplit("/", 1)[1]][r.line_no] == r.line


def test_constant_pseudonyms_can_be_unique(spark):
    text = "due 2024-01-02 and due 2024-03-04, born on 01/02/1980 and born on 03/04/1981"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    engine = Veil(unique=True)
    done = engine.redact(df)
    assert all(r.reversible for r in done.mapping.collect())
    assert "2024" not in done.documents.first().text
    assert engine.restore(done.documents, done.mapping).first().text == text


def test_strict_keywords_begin_a_word(spark):
    df = spark.createDataFrame([(1, "heritage cat and tag ABC 123")], "doc_id int, text string")
    loose, strict = Veil(detectors=by_name("plate_us")), Veil(detectors=by_name("plate_us"), strict=True)
    assert len(loose.scan(df).first()["_spans_0"]) == 2
    assert [s.value for s in strict.scan(df).first()["_spans_0"]] == ["ABC 123"]


def test_streams_refuse_an_allowlist_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sdf = spark.readStream.schema("doc_id int, text string").json(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="allowlist"):
        mails(allow=spark.createDataFrame([("a",)], "value string")).redact_rows(sdf)


def test_long_allowlists(spark):
    allow = [f"user{i}@corp.com" for i in range(6_000)]
    df = spark.createDataFrame([(1, "user5999@corp.com other@corp.com")], "doc_id int, text string")
    text = mails(allow=allow).redact(df).documents.first().text
    assert text.startswith("user5999@corp.com ") and "other@corp.com" not in text


def test_all_names_of_the_default_lists(spark):
    assert len(set(GIVEN_NAMES)) == len(GIVEN_NAMES) >= 256 and len(set(SURNAMES)) == len(SURNAMES) >= 263
    n = max(len(GIVEN_NAMES), len(SURNAMES))
    names = [f"{GIVEN_NAMES[k % len(GIVEN_NAMES)]} {SURNAMES[k % len(SURNAMES)]}".title() for k in range(n)]
    names += ["Abigail Aguilar", "Zoey Woods", "Alan Alvarado", "Skylar Williamson"]
    df = spark.createDataFrame([(k, f"Patient: {x}, Abigail River.") for k, x in enumerate(names)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in Veil().redact_rows(df).collect()}
    assert all(got[k] == "Patient: [PERSON_1], Abigail River." for k in range(len(names)))


def test_text_files_are_of_bounded_size(spark, tmp_path, monkeypatch):
    sf, out = str(tmp_path / "sf"), str(tmp_path / "out")
    rows = [(i, f"text {i}\nof " + "x" * 300, "en" if i % 3 else "de") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(queries, "FILE_BYTES", 10_000, raising=False)
    monkeypatch.setattr(queries, "new_folder", lambda spark, name: out)
    got = {r.doc_id: r for r in queries.text_files(spark, sf).collect()}
    assert {i: r.text for i, r in got.items()} == {i: t.replace("\n", " ") for i, t, _ in rows}
    assert all(r.same for r in got.values())
    sizes = [p.stat().st_size for p in (tmp_path / "out").rglob("*.txt")]
    assert len(sizes) >= 8 and max(sizes) <= 2 * 10_000


def test_nested_records_by_scope(spark):
    df = spark.createDataFrame([(1, "x", "mail a@x.com"), (2, "y", "mail b@y.com"), (3, None, "c@z.com")], "doc_id int, site string, text string")
    done = mails().redact(df, scope="site")
    assert {r.pseudonym for r in done.mapping.collect()} == {"user-1@redacted.example.net"}
    records = done.documents.select("doc_id", "site", F.struct(F.array("text").alias("t"), F.create_map(F.lit("k"), "text").alias("m")).alias("r"))
    back = mails().restore_nested(records, done.mapping, ["doc_id"], scope="site")
    want = {r.doc_id: r.text for r in df.collect()}
    for r in back.collect():
        assert r.r.t == [want[r.doc_id]] and r.r.m == {"k": want[r.doc_id]} and r.site in ("x", "y", None)
