"""Texts with few edits, rendering without a formatter, tokens found by marks."""

from textveil import BUILT_IN
from textveil.functions.detectors import Detector
from textveil.functions.templates import render_sql
from textveil.operators.restore import shape_of, token_spans
from textveil.operators.rewrite import FEW_EDITS, rebuild_text
from textveil.operators.scan import FEW_CLAIMS, OPEN, Scanner


def test_edits_below_and_above_the_bound(spark):
    for n in (0, 1, 2, FEW_EDITS, FEW_EDITS + 1, 3 * FEW_EDITS):
        text = "ä😀" + "".join(f"<{i}>" for i in range(n)) + "ß"
        edits, at = [], 2
        for i in range(n):
            edits.append((at + 1, at + 1 + len(str(i)), f"[ü{i}]" if i % 3 else ""))
            at += len(str(i)) + 2
        df = spark.createDataFrame([(text, edits), (None, edits), (text, None)],
                                   "t string, e array<struct<v_start:int,v_end:int,new:string>>")
        want = "ä😀" + "".join(f"<{e[2]}>" for e in edits) + "ß"
        got = [r.t for r in df.select(rebuild_text("t", "e").alias("t")).collect()]
        assert got == [want, None, text]


def test_rendering_needs_no_formatter(spark):
    for template in ("[X]~{n}", "REDACTED_a%b_{n}", "{n}", "it's\\{n}-{n}"):
        sql = render_sql(template)
        assert "format_string" not in sql
        row = spark.sql(f"SELECT {sql} AS a FROM VALUES (12L) AS v(n)").first()
        assert row.a == template.replace("{n}", "12")
        assert spark.sql(f"SELECT {sql} AS a FROM VALUES (CAST(NULL AS BIGINT)) AS v(n)").first().a == template.replace("{n}", "null")
    assert "format_string" in render_sql("X{n:03d}")


def test_tokens_are_those_of_a_scan(spark):
    arn = "arn:aws:iam::100000000007:{}/redacted-7"
    texts = [
        None, "", "no token", "10.0.0.8", "ä😀10.0.0.8 and user1@redacted.example.net\n10.0.1.15!", "9910.0.0.8",
        "REDACTED_SECRET_1REDACTED_SECRET_12", arn.format("role"), arn.format("ro\ue123le"), f"a{OPEN}b 10.0.0.8 {OPEN}{OPEN}",
        " ".join(f"10.0.{i}.8" for i in range(FEW_CLAIMS)), " ".join(f"10.0.{i}.8" for i in range(FEW_CLAIMS + 1)),
        "é ".join(f"10.0.{i % 99}.8" for i in range(300)), "user\ufffd 10.0.0.8",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for shape in (shape_of(BUILT_IN), shape_of([]), r"(?:10\.0\.[0-9]+|b)"):
        want = Scanner([Detector("token", "token", shape, "")]).spans(df, "t", "_tokens")
        got = token_spans(df, "t", shape)
        assert got.schema["_tokens"].dataType == want.schema["_tokens"].dataType
        assert sorted(got.collect()) == sorted(want.collect())
