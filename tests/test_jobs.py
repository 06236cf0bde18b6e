"""Whole jobs: numbering, rewriting, restoring, audits."""

import pytest
from conftest import docs_of
from pyspark.sql import functions as F

from textveil import Veil, by_name, custom_detector, custom_pattern
from textveil.operators import audit
from textveil.operators import mapping as mp
from textveil.operators.restore import (
    longest_first, restore_exact, restore_join, restore_nested, restored_count,
)
from textveil.operators.skew import hot_keys, join_hot

ALL_KINDS = (
    "Email: alice@company.com\nIP: 10.0.0.1\nPhone: +1 (555) 123-4567\nSSN: 123-45-6789\n"
    "CC: 4111111111111111\nIBAN: GB29 NWBK 6016 1331 9268 19\nNHS number: 943 476 5919\n"
    "DOB: 15/03/1990\nsort code: 20-00-00\nUTR: 1234567890\nVIN: 1HGBH41JXMN109186\n"
    'SWIFT code: BARCGB22\npassword = "hunter2"\nclaim number: CLM-2024-123456\nEIN: 12-3456789\n'
)
TEXTS = [
    ALL_KINDS,
    "REDACTED_SECRET_1 is already in the text",
    "REDACTED_EMAIL_1 and REDACTED_EMAIL_1 again and REDACTED_EMAIL_2",
    "email: a@b.com and longer-a@b.com.evil.org",
    "first: mytest@example.com second: test@example.com",
    "email: repeat@test.com\n" * 50,
    'password = "REDACTED_SECRET_1" is what it generates',
    "联系邮件: test@company.com について",
    r"[regex] (test) {email}: user@test.com ^end$ \1 $0",
    "path: C:\\Users\\admin, email: user@test.com",
    " ".join(f"user{i}@domain{i}.com" for i in range(50)),
    " ".join(f"10.0.0.{i}" for i in range(50)),
    "stin 4952935900253052 follows",
    "icons \ue000\uf8f0 and a@icons.com \ue123",
    "", "clean",
    "password = 'one-more' next REDACTED_SECRET_3 REDACTED_SECRET_12",
    "\x00X_0\x00 and null@bytes.com",
]


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


@pytest.mark.parametrize("scope", ["corpus", "document"])
def test_round_trip(spark, scope):
    df = docs_of(spark, TEXTS)
    engine = Veil()
    done = engine.redact(df, scope=scope)
    redacted = by_id(done.documents)
    assert "alice@company.com" not in redacted[0]
    assert redacted[15] == "clean" and redacted[14] == ""
    assert by_id(engine.restore(done.documents, done.mapping, scope=scope)) == dict(enumerate(TEXTS))
    assert audit.verify_roundtrip(
        df, engine.restore(done.documents, done.mapping, scope=scope)).isEmpty()
    assert mp.audit_mapping(done.mapping, done.findings).isEmpty()


def test_restore_exact_small_corpus(spark):
    df = docs_of(spark, ["a@b.com 10.1.1.1", "c@d.com and a@b.com", "none"])
    done = Veil().redact(df)
    assert by_id(restore_exact(done.documents, "text", done.mapping)) == by_id(df)


def test_same_value_one_row_and_bijection(spark):
    done = Veil().redact(docs_of(spark, [
        "a = 192.168.1.1\nb = 192.168.1.1", " ".join(f"user{i}@example{i}.com" for i in range(200))]))
    rows = done.mapping.collect()
    assert sum(r.category == "ip" for r in rows) == 1
    assert len(rows) == 201
    assert len({r.pseudonym for r in rows}) == len({r.value for r in rows}) == 201
    assert sorted(r.n for r in rows if r.category == "email") == list(range(1, 201))


def test_numbers_follow_document_then_rank_then_position(spark):
    done = Veil(detectors=by_name("credit_card", "email", "ipv4")).redact(docs_of(spark, [
        "z@z.com 9.9.9.9 a@a.com", "b@b.com a@a.com 8.8.8.8"]))
    got = {r.value: r.n for r in done.mapping.collect()}
    assert got == {"z@z.com": 1, "a@a.com": 2, "b@b.com": 3, "9.9.9.9": 1, "8.8.8.8": 2}


def test_two_step_numbering_equals_window(spark):
    values = spark.range(5000).selectExpr(
        "'' AS scope", "concat('v', id) AS value", "concat('c', id * id % 5) AS category",
        "struct(id * 7919 % 5000 AS a, 0 AS rank, id AS start) AS first_seen")
    a = mp.number_values(values, scope="corpus").select("value", "n")
    b = mp.number_values(values, scope="document").select("value", "n")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_first_category_owns_a_value(spark):
    # the same digits as a driving licence first, later as a bank account
    done = Veil().redact(docs_of(spark, ["DL# 12345678", "account number: 12345678"]))
    rows = done.mapping.collect()
    assert len(rows) == 1 and rows[0].pattern == "id_us_driving"
    assert by_id(done.documents)[1] == "account number: DL-00000001"


def test_reset_gives_the_same_mapping(spark):
    df = docs_of(spark, TEXTS)
    a, b = Veil().redact(df).mapping, Veil().redact(df).mapping
    assert mp.mapping_diff(a, b).isEmpty()


def test_scope_column_and_continued_mapping(spark):
    df = spark.createDataFrame(
        [(1, "f1", "a@b.com"), (2, "f2", "c@d.com a@b.com"), (3, "f1", "c@d.com")],
        "doc_id long, path string, text string")
    done = Veil().redact(df, scope="path")
    assert {(r.scope, r.value): r.n for r in done.mapping.collect()} == {
        ("f1", "a@b.com"): 1, ("f2", "c@d.com"): 1, ("f2", "a@b.com"): 2, ("f1", "c@d.com"): 2}
    assert by_id(Veil().restore(done.documents, done.mapping, scope="path")) == by_id(df)
    first = Veil().redact(docs_of(spark, ["a@b.com"]))
    more = Veil().redact(docs_of(spark, ["x@y.com a@b.com"]), mapping=first.mapping)
    assert by_id(more.documents)[0] == "user-2@redacted.example.net user-1@redacted.example.net"


def test_not_reversible_rows_are_flagged_and_left(spark):
    done = Veil().redact(docs_of(spark, ["DOB: 15/03/1990", "DOB: 16/03/1990"]))
    assert [r.reversible for r in done.mapping.collect()] == [False, False]
    back = by_id(Veil().restore(done.documents, done.mapping))
    assert set(back.values()) == {"DOB: 01/01/1990"}
    report = mp.audit_mapping(done.mapping).collect()
    assert [(r.check, r.item, r.rows) for r in report] == [("duplicate_pseudonym", "01/01/1990", 2)]


def test_groups_allowlist_words_and_patterns(spark):
    def run(text, **options):
        return by_id(Veil(**options).redact(docs_of(spark, [text])).documents)[0]

    assert run("IP 192.168.1.1 and SSN 123-45-6789", groups={"pii": False}) == (
        "IP 10.0.1.8 and SSN 123-45-6789")
    off = dict.fromkeys(["secrets", "network", "pii", "aws", "cloud", "identifiers"], False)
    text = 'email: a@b.com password = "hunter2" ip: 10.0.0.1 mot_de_passe = "abcd"'
    assert run(text, groups=off) == text
    assert run("servers: 192.168.1.100 and 10.0.0.50", allow=["192.168.1.100"]) == (
        "servers: 192.168.1.100 and 10.0.1.8")
    # an allowed match frees its text: the keyword detector still takes it
    assert run("server = 192.168.1.100", allow=["192.168.1.100"]) == (
        "server = REDACTED_IDENTIFIER_1")
    assert run("Acme Corp and ACME corp", words=["acme corp", " "]) == "CUSTOM_1 and CUSTOM_2"
    assert run("fix ab-12 now", patterns=[custom_pattern("my code", r"AB-\d+", True)]) == (
        "fix MY_CODE_1 now")
    assert run("SECRET_WORD inside", extra=[
        custom_detector("x", r"\bSECRET_WORD\b", "GONE", 1, category="unknown_future")],
        groups=off) == "GONE inside"


def test_long_allowlist_equals_inline(spark):
    texts = ["server = 192.168.1.100 and 10.0.0.50", "host 10.0.0.50 user is 10.0.0.50", "a@b.com"]
    allow = ["192.168.1.100", "10.0.0.50", "server = 192.168.1.100", "zzz"]
    df = docs_of(spark, texts)
    inline = Veil(allow=allow).redact(df)
    table = Veil(allow=spark.createDataFrame([(a,) for a in allow], "value string")).redact(df)
    assert by_id(inline.documents) == by_id(table.documents)


def test_registered_detector_belongs_to_one_engine(spark):
    engine = Veil()
    engine.register("TICKET", r"TICKET-\d+")
    done = engine.redact(docs_of(spark, ["fix TICKET-12345 and TICKET-67890"]))
    assert by_id(done.documents)[0] == "fix REDACTED_TICKET_1 and REDACTED_TICKET_2"
    assert by_id(Veil().redact(docs_of(spark, ["fix TICKET-12345"])).documents)[0] == (
        "fix TICKET-12345")


def test_bad_pattern_raises(spark):
    with pytest.raises(Exception, match="(?i)regex|pattern"):
        Veil(patterns=[custom_pattern("bad", "(")]).redact(docs_of(spark, ["x ( y"]))


def test_python_predicate(spark):
    own = custom_detector("even", r"\d+", "<{n}>", python_check=lambda v: v.astype(int) % 2 == 0)
    engine = Veil(detectors=[*by_name("email"), own])
    done = engine.redact(docs_of(spark, ["1 2 3 44 a@b.com", "none", "7"]))
    assert by_id(done.documents) == {
        0: "1 <1> 3 <2> user-1@redacted.example.net", 1: "none", 2: "7"}


def test_merge_renumbers_or_rejects(spark):
    engine = Veil(detectors=by_name("email"))
    a = engine.redact(docs_of(spark, ["a@a.com b@b.com"])).mapping
    b = engine.redact(docs_of(spark, ["c@c.com b@b.com"])).mapping
    got = {r.value: r.pseudonym for r in mp.merge_mappings(a, b, engine.detectors).collect()}
    assert got == {"c@c.com": "user-1@redacted.example.net", "b@b.com": "user-2@redacted.example.net",
                   "a@a.com": "user-3@redacted.example.net"}
    with pytest.raises(ValueError):
        mp.merge_mappings(a, b, engine.detectors, conflicts="error")


def test_nested_records(spark):
    engine = Veil()
    done = engine.redact(docs_of(spark, ["a@b.com"]))
    record = done.documents.select(
        "doc_id", F.col("text").alias("top"), F.struct(F.array("text", "text").alias("deep"))
        .alias("nested"), F.lit(42).alias("number"), F.lit(True).alias("flag"),
        F.lit(None).cast("string").alias("nothing"),
        F.array(F.struct(F.array("text").alias("emails"))).alias("list"),
        F.create_map(F.col("text"), F.col("text")).alias("facts"))
    for back in (restore_nested(record, done.mapping),
                 restore_nested(record, done.mapping, engine.detectors, ["doc_id"])):
        row = back.first()
        assert (row.top, row.nested.deep, row.number, row.flag, row.nothing) == (
            "a@b.com", ["a@b.com", "a@b.com"], 42, True, None)
        assert row["list"][0].emails == ["a@b.com"]
        assert row.facts == {"user-1@redacted.example.net": "a@b.com"}


def test_longest_first(spark):
    row = spark.range(1).select(longest_first(F.expr(
        "array(named_struct('p', 'x_1', 'o', ''), named_struct('p', 'x_10', 'o', ''))")).alias("e"))
    assert [e.p for e in row.first().e] == ["x_10", "x_1"]


def test_restored_count_and_digits_behind_a_pseudonym(spark):
    engine = Veil(detectors=[custom_detector("id", r"ID[a-z]+", "X_{n}")])
    df = docs_of(spark, ["IDa7 IDb IDa", "no"])
    done = engine.redact(df)
    assert by_id(done.documents)[0] == "X_17 X_2 X_1"
    counts = restored_count(done.documents, "text", done.mapping, engine.detectors)
    assert {r.doc_id: r.restored for r in counts.collect()} == {0: 2, 1: 0}
    assert by_id(restore_join(done.documents, "text", done.mapping, engine.detectors)) == by_id(df)


def test_redact_twice_restore_twice(spark):
    df = docs_of(spark, ['email: attacker@evil.com password = "hunter2"', *TEXTS[:6]])
    assert audit.verify_idempotent(df, Veil()).isEmpty()


def test_no_leak(spark):
    df = docs_of(spark, TEXTS)
    engine = Veil()
    done = engine.redact(df)
    leaked = audit.verify_no_leak(done.documents, done.mapping, engine)
    # the only value left is a pseudonym-like text that was itself a value
    assert {r.value for r in leaked.collect()} <= {"10.0.0.1"}
    assert not audit.verify_no_leak(df, done.mapping, engine).isEmpty()


def test_hot_keys_are_joined_once_each(spark):
    big = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS k")
    small = big.select("k").distinct().withColumn("v", F.upper("k"))
    got = join_hot(big, small, ["k"], [("hot", 7)], ["id"])
    want = big.join(small, "k")
    assert got.count() == 3000
    assert got.select("id", "k", "v").exceptAll(want.select("id", "k", "v")).isEmpty()
    counts = big.groupBy("k").agg((F.count("*") * 10_000).alias("uses"))
    assert hot_keys(counts, ["k"], 30_000_000) == [("hot", 21)]


def test_two_text_columns_share_one_numbering(spark):
    df = spark.createDataFrame([(1, "a@b.com", "c@d.com"), (2, "c@d.com", None)],
                               "doc_id long, x string, y string")
    rows = Veil().redact(df, ["x", "y"]).documents.orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [
        (1, "user-1@redacted.example.net", "user-2@redacted.example.net"),
        (2, "user-2@redacted.example.net", None)]
