"""The registered queries: every operator over whole driver tables.

Each takes ``(spark, sf_dir)`` and returns a DataFrame; ``oracles.py`` holds the SQL with the
same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil import Veil, by_name, custom_detector, custom_pattern, detect_languages, find_spans
from textveil.functions.detectors import BUILT_IN, FAMILIES, foreign_secrets, ordered
from textveil.functions.languages import keywords_for
from textveil.functions.templates import render_pseudonym
from textveil.functions.words import GIVEN_NAMES, SURNAMES
from textveil.operators import audit, findings as fnd, mapping as mp
from textveil.operators.dictionary import count_words
from textveil.operators.env import redact_env, restore_env
from textveil.operators.restore import restore_exact, restore_join, restore_nested, restored_count
from textveil.operators.scan import Scanner, explode_spans, resolve_overlaps
from textveil.operators.skew import join_hot
from textveil.plans.storage import shared_folder, spread_small, stage
from textveil.sources.readers import (
    mapping_from_json, read_allowlist, read_corpus, read_env_lines, read_lines, read_mapping,
    read_records, split_lines,
)
from textveil.sources.writers import mapping_objects, write_mapping, write_redacted
from textveil.streaming import stream
from workload.lines import LINES, lines_sql
from workload.oracles import env_lines

Query = Callable[[SparkSession, str], DataFrame]

THREE = ordered(by_name("credit_card", "email", "ipv4"))
FACTS = ["doc_id", "rank", "pattern", "category", "grp", "confidence", "start", "end", "v_start",
         "v_end", "value"]
MAP = ["scope", "value", "pseudonym", "category", "pattern", "confidence", "n"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread_small(spark.read.parquet(f"{sf}/{name}.parquet"))


def sql_over(spark: SparkSession, sf: str, name: str, query: str) -> DataFrame:
    """Run shared SQL over one driver table."""
    view = f"{name}_{uuid.uuid4().hex[:8]}"
    table(spark, sf, name).createOrReplaceTempView(view)
    return spark.sql(query.replace(f"FROM {name}", f"FROM {view}"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/textveil/{name}-{uuid.uuid4().hex}"


def three(**options) -> Veil:
    return Veil(detectors=THREE, **options)


def corpus_findings(spark: SparkSession, sf: str, resolve: bool = True) -> DataFrame:
    return find_spans(documents(spark, sf), "text", THREE, resolve=resolve)


def scoped(spark, sf, scope: str = "corpus", only=None) -> DataFrame:
    docs = table(spark, sf, "documents")
    carried = [] if scope in ("corpus", "document") else [scope]
    docs = (docs if only is None else docs.where(only)).select("doc_id", "text", *carried)
    return mp.with_scope(find_spans(docs, "text", THREE, ["doc_id", *carried], resolve=True), scope, ["doc_id"])


def corpus_mapping(spark, sf, scope: str = "corpus", only=None, mapping=None) -> DataFrame:
    found = scoped(spark, sf, scope, only)
    return mp.build_mapping(mp.distinct_values(found, ["doc_id"], THREE), THREE, scope, mapping)


# -- detection --------------------------------------------------------------------------------


def family(name: str) -> Query:
    detectors = (list(foreign_secrets()) if name == "i18n_secrets"
                 else ordered(by_name(*FAMILIES[name])))

    def run(spark, sf):
        lines = sql_over(spark, sf, "orders", lines_sql(name))
        return find_spans(lines, "text", detectors, ["line_id"], resolve=True, unite=name == "i18n_secrets").select(
            "line_id", "pattern", "start", "end", "v_start", "value")

    return run


def one(name: str, *columns: str, tbl: str = "documents", key: str = "doc_id",
        column: str = "text") -> Query:
    def run(spark, sf):
        found = find_spans(table(spark, sf, tbl), column, by_name(name), [key])
        return found.select(key, *columns)

    return run


def find_phones(spark, sf):
    found = find_spans(documents(spark, sf), "text", by_name("phone_us"))
    return found.groupBy("doc_id", "value").agg(F.count("*").alias("uses"))


def find_domains(spark, sf):
    engine = Veil(detectors=by_name("domain"))
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    scanned = engine.scan(pages, ["url", "html"], ["page_id"])
    found = engine.findings(scanned, ["url", "html"], ["page_id"])
    return found.groupBy("page_id", "col", "value").agg(F.count("*").alias("uses"))


def scan_everything(spark, sf):
    """All 101 detectors over whole texts."""
    engine = Veil()
    docs = documents(spark, sf)
    return engine.findings(engine.scan(docs)).select("doc_id", "pattern", "start", "value")


def resolve(spark, sf):
    lines = sql_over(spark, sf, "orders", lines_sql("network"))
    detectors = ordered(by_name(*FAMILIES["network"]))
    spans = Scanner(detectors).raw_spans(lines, "text")
    return explode_spans(resolve_overlaps(spans), detectors, ["line_id"]).select(
        "line_id", "pattern", "start", "end", "v_start", "value")


# -- filters and joins ------------------------------------------------------------------------


def allow_table(spark, sf):
    ips = find_spans(documents(spark, sf), "text", by_name("ipv4"))
    return ips.where("value LIKE '2%'").select("value").distinct()


def allowlist_scan(spark, sf):
    engine = three(allow=stage(allow_table(spark, sf), "allow"))
    return engine.findings(engine.scan(documents(spark, sf))).select(*FACTS)


def split_clean(spark, sf):
    engine = three()
    scanned = stage(engine.scan(documents(spark, sf)), "scanned")
    dirty, clean = fnd.split_clean(scanned, "_spans_0")
    return (dirty.select("doc_id", F.lit(0).alias("clean"))
            .unionByName(clean.select("doc_id", F.lit(1).alias("clean"))))


def match_names(spark, sf):
    lines = sql_over(spark, sf, "orders", lines_sql("person_names"))
    pairs = by_name("person_name")[0]
    candidates = find_spans(lines, "text", [custom_detector("pair", pairs.regex, "[PERSON_{n}]")],
                            ["line_id"]).select("line_id", "start", "value")
    first = spark.createDataFrame([(name,) for name in GIVEN_NAMES], "name string")
    last = spark.createDataFrame([(name,) for name in SURNAMES], "name string")
    return fnd.match_names(candidates, first, last)


REJECTED = """SELECT o_orderkey AS line_id, concat('ssn ', CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN '000' WHEN 1 THEN '666'
  WHEN 2 THEN concat('9', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')) ELSE concat('2', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0'))
  END, '-45-', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'), ' | username: ', CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'None'
  WHEN 1 THEN concat('REDACTED_USER_', CAST(o_orderkey AS STRING)) WHEN 2 THEN 'undefined' WHEN 3 THEN 'TRUE'
  ELSE concat('svc_', CAST(o_orderkey AS STRING)) END, ' . ') AS text FROM orders"""


def rejected(spark, sf):
    """Social security numbers of areas that don't exist, common words, and values redacted before."""
    found = find_spans(sql_over(spark, sf, "orders", REJECTED), "text",
                       ordered(by_name("ssn", "generic_identifier_unquoted")), ["line_id"], resolve=True)
    return found.select("line_id", "pattern", "start", "value")


def by_priority(spark, sf):
    """Detectors that claim the same text: the lower priority wins, then the one registered first."""
    lines = table(spark, sf, "orders").selectExpr("o_orderkey AS line_id", "concat('ref ', 1000 + o_orderkey % 9000, '-', o_orderkey,"
                                                  " 'z and ', o_orderkey, 'z') AS text")
    engine = Veil(detectors=())
    for name, regex, priority in (("late", r"\d+z", 60), ("tie", r"\d+z", 60), ("early", r"\d{4}-\d+z", 40), ("first", r"ref", -5)):
        engine.register(name, regex, priority=priority)
    return engine.findings(engine.scan(lines, key=["line_id"]), key=["line_id"]).select("line_id", "pattern", "start", "value")


def names_sql(given: str, surnames: str) -> str:
    return (f"SELECT k AS line_id, concat('Seen by ', CASE WHEN k % 3 = 0 THEN concat('Qx', {surnames}) ELSE {given} END, ' ',"
            f" {surnames}, ', ok') AS text FROM (SELECT o_orderkey AS k FROM orders) o")


def person_names(spark, sf):
    """Every given name with every fourth surname or so; a third of the lines has a first word that is no name."""
    pick = "array({})[CAST({} AS INT)]"
    given = pick.format(", ".join(f"'{x.title()}'" for x in GIVEN_NAMES), f"k % {len(GIVEN_NAMES)}")
    surname = pick.format(", ".join("'" + x.title().replace("'", "\\'") + "'" for x in SURNAMES), f"(k div 4) % {len(SURNAMES)}")
    lines = sql_over(spark, sf, "orders", names_sql(given, surname))
    return find_spans(lines, "text", by_name("person_name"), ["line_id"], resolve=True).select("line_id", "start", "value")


def languages(spark, sf):
    return documents(spark, sf).select("doc_id", detect_languages("text").alias("langs"))


def keywords(spark, sf):
    return keywords_for(languages(spark, sf)).groupBy("doc_id", "lang").agg(
        F.count("*").alias("keywords"))


# -- numbering and mapping --------------------------------------------------------------------


def distinct_values(spark, sf):
    return mp.distinct_values(scoped(spark, sf), ["doc_id"], THREE).drop("first_seen")


def numbered(scope: str) -> Query:
    return lambda spark, sf: corpus_mapping(spark, sf, scope).select(*MAP)


def continued(spark, sf):
    before = stage(corpus_mapping(spark, sf, only="lang = 'en'"), "before")
    return corpus_mapping(spark, sf, mapping=before).select(*MAP)


def new_values(spark, sf):
    before = stage(corpus_mapping(spark, sf, only="lang = 'en'"), "before")
    values = mp.distinct_values(scoped(spark, sf), ["doc_id"], THREE)
    return mp.new_values(values, before).select("value", "category")


def mapping_table(spark, sf):
    """Written and read back as a table."""
    path = new_folder(spark, "mapping")
    write_mapping(corpus_mapping(spark, sf), path)
    return spark.read.parquet(path).select(*MAP)


def join_mapping(spark, sf):
    found = scoped(spark, sf)
    values = stage(mp.distinct_values(found, ["doc_id"], THREE), "values")
    known = stage(mp.build_mapping(values, THREE), "mapping")
    return mp.join_mapping(found, known, values).select("doc_id", "start", "value", "pseudonym", "n")


def join_hot_values(spark, sf):
    """The same join with its most frequent value treated as hot."""
    found = scoped(spark, sf)
    values = stage(mp.distinct_values(found, ["doc_id"], THREE), "values")
    known = stage(mp.build_mapping(values, THREE), "mapping")
    hot = [(r.scope, r.value, 4) for r in
           values.orderBy(F.desc("uses"), "value").select("scope", "value").limit(3).collect()]
    return join_hot(found, known.select("scope", "value", "pseudonym", "n"), ["scope", "value"],
                    hot, ["doc_id", "start"]).select("doc_id", "start", "value", "pseudonym", "n")


def render_all(spark, sf):
    names = "array(" + ", ".join(f"'{x.name}'" for x in BUILT_IN) + ")"
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("n")).withColumn(
        "pattern", F.expr(f"{names}[CAST(n % {len(BUILT_IN)} AS INT)]"))
    rows = rows.withColumn("value", F.lit("arn:aws:iam::123456789012:role/x")).withColumn(
        "value", F.expr("CASE WHEN pattern = 'arn' THEN 'arn:aws:iam::1:role/x' ELSE value END"))
    return rows.select("n", "pattern", render_pseudonym(BUILT_IN).alias("pseudonym"))


def render_one(rule: str, tbl: str, n: str, value: str = "''") -> Query:
    detector = next(x for x in BUILT_IN if x.template == rule)

    def run(spark, sf):
        rows = table(spark, sf, tbl).selectExpr(f"{n} AS n").selectExpr(
            "n", f"{value} AS value", f"'{detector.name}' AS pattern")
        keep = ["value"] if rule == "@arn" else ["n"]
        return rows.select(*keep, render_pseudonym([detector]).alias("pseudonym"))

    return run


ARN_VALUE = ("concat('arn:aws:lambda:eu-west-1:', lpad(CAST(n AS STRING), 12, '0'), ':', CASE WHEN"
             " n % 2 = 0 THEN 'function/f' ELSE 'queue' END, n, ':7')")


def keep_cidr(spark, sf):
    lines = sql_over(spark, sf, "orders", (
        "SELECT o_orderkey AS line_id, concat('cidr = 172.16.', CAST((o_orderkey % 65536) div 256 AS"
        " STRING), '.', CAST(o_orderkey % 256 AS STRING), '/24') AS text FROM orders"))
    return Veil(detectors=by_name("ipv4")).redact(lines, key="line_id").documents


# -- rewriting and restoring ------------------------------------------------------------------


def redact(scope: str = "corpus") -> Query:
    def run(spark, sf):
        docs = table(spark, sf, "documents")
        return three().redact(docs, scope=scope).documents.select("doc_id", "text")

    return run


def redact_everything(spark, sf):
    """The whole catalogue, one numbering for the corpus."""
    return Veil().redact(documents(spark, sf)).documents


def restored(how: str) -> Query:
    def run(spark, sf):
        engine = three()
        scope = "document" if how == "document" else "corpus"
        done = engine.redact(documents(spark, sf), scope=scope)
        if how == "exact":
            return restore_exact(done.documents, "text", done.mapping)
        return restore_join(done.documents, "text", done.mapping, engine.detectors, scope=scope)

    return run


def nested(spark, sf):
    engine = three()
    docs = table(spark, sf, "documents")
    done = engine.redact(docs)
    records = done.documents.select(
        "doc_id", F.struct(
            F.col("text").alias("top"),
            F.struct(F.array("text", F.col("lang"), "text").alias("deep")).alias("nested"),
            F.create_map(F.lit("label"), F.col("lang")).alias("facts"),
            F.col("n_chars").alias("number")).alias("record"))
    back = restore_nested(records, done.mapping, engine.detectors, ["doc_id"])
    return back.select(
        "doc_id", F.col("record.top").alias("top"), F.expr("record.nested.deep[0] AS deep_first"),
        F.expr("record.nested.deep[2] AS deep_last"), F.col("record.number").alias("number"),
        F.expr("record.facts['label'] AS label"))


def nested_by_source(spark, sf):
    """Records restored by the mapping of their own source."""
    engine = three()
    done = engine.redact(table(spark, sf, "documents").select("doc_id", "source", "text"), scope="source")
    records = done.documents.select("doc_id", "source", F.struct(F.array("text", F.lit("plain")).alias("parts")).alias("record"))
    back = engine.restore_nested(records, done.mapping, ["doc_id"], scope="source")
    return back.select("doc_id", "source", F.expr("record.parts[0] AS text"))


def count_restored(spark, sf):
    engine = three()
    done = engine.redact(documents(spark, sf))
    return restored_count(done.documents, "text", done.mapping, engine.detectors)


def multi_column(spark, sf):
    pages = table(spark, sf, "pages").selectExpr(
        "page_id",
        "replace(url, 'example.com', concat('site', page_id % 50, '.org')) AS url",
        "concat('title of www.site', page_id % 70, '.net and page ', page_id) AS title")
    engine = Veil(detectors=by_name("domain"))
    return engine.redact(pages, ["url", "title"], "page_id").documents


# -- sets, audits -----------------------------------------------------------------------------


def union(spark, sf):
    docs = documents(spark, sf)
    parts = [find_spans(docs, "text", by_name(n)) for n in ("email", "ipv4")]
    return fnd.union_findings(*parts).select("doc_id", "pattern", "start", "value")


def merged(spark, sf):
    a = stage(corpus_mapping(spark, sf, only="lang = 'en'"), "left")
    b = stage(corpus_mapping(spark, sf, only="lang <> 'en'"), "right")
    return mp.merge_mappings(a, b, THREE).select(*MAP)


def diff(spark, sf):
    a = stage(corpus_mapping(spark, sf, only="lang = 'en'"), "before")
    b = stage(corpus_mapping(spark, sf), "after")
    return mp.mapping_diff(a, b).select("value", "pseudonym", "side")


def audited(spark, sf):
    """Mappings numbered per language and then thrown together do collide."""
    per_language = stage(corpus_mapping(spark, sf, "lang"), "mapping").withColumn("scope", F.lit(""))
    return audit_columns(mp.audit_mapping(per_language, scoped(spark, sf)))


def audit_columns(report):
    return report.select("check", "scope", "item", "rows")


def json_mapping(spark, sf):
    objects = mapping_objects(corpus_mapping(spark, sf, "document"))
    return mapping_from_json(objects, "mapping", "scope").select("scope", "pseudonym", "value")


def failures(of) -> Query:
    def run(spark, sf):
        docs = documents(spark, sf)
        bad = of(docs).agg(F.count("*").cast("int").alias("failures"))
        return bad.withColumn("documents", F.lit(docs.count())).select("documents", "failures")

    return run


def round_trip(docs):
    engine = Veil()
    done = engine.redact(docs)
    return audit.verify_roundtrip(docs, engine.restore(done.documents, done.mapping))


def leaks(docs):
    engine = three()
    done = engine.redact(docs)
    return audit.verify_no_leak(done.documents, done.mapping, engine)


def words_of_table(spark, sf):
    """Every longer word of the conversations, wherever it stands in a document."""
    return count_words(documents(spark, sf), "text", longer_words(table(spark, sf, "conversations")))


def longer_words(df):
    # explode() would add a filter that cuts the texts a second time, below the deal-out of the table
    words = df.select(F.explode_outer(F.regexp_extract_all("text", F.lit("([a-z]{8,})"), F.lit(1))).alias("word"))
    return words.where("word IS NOT NULL")


def planted_originals(spark, sf):
    """Redacted texts to which an original was attached where no detector sees it."""
    done = three().redact(documents(spark, sf))
    own = done.mapping.where("category = 'email'").select(F.col("n").alias("doc_id"), F.col("value").alias("_v"))
    text = F.expr("CASE WHEN _v IS NULL THEN text ELSE concat(text, ' é', substring(_v, 1, 9), '_', _v, 'é') END")
    planted = done.documents.join(own, "doc_id", "left").withColumn("text", text)
    return audit.verify_no_originals(planted, done.mapping).groupBy("doc_id", "value").agg(F.count("*").alias("uses"))


def twice(docs):
    return audit.verify_idempotent(docs, three())


# -- the caller's own detectors ---------------------------------------------------------------


def own_words(spark, sf):
    lines = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS line_id", "concat('priority ', o_orderpriority, ' is set') AS text")
    engine = Veil(words=["1-urgent", "5-low"], detectors=())
    return engine.findings(engine.scan(lines, key=["line_id"]), key=["line_id"]).select(
        "line_id", "start", "value")


def own_regex(spark, sf):
    lines = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS line_id",
        "concat('see ORD-', o_orderkey, ' and TICKET-', o_orderkey) AS text")
    engine = Veil(detectors=(), patterns=[custom_pattern("ord-code", r"ord-\d+", True)])
    engine.register("TICKET", r"TICKET-\d+")
    return engine.redact(lines, key="line_id").documents


def packs(spark, sf):
    lines = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS line_id", "concat('pod_name: pod-', o_orderkey, '-x') AS text")
    pack = [custom_detector("k8s_pod", r"(pod_name:\s*)(pod-[0-9]+-[a-z]+)", "K8S_POD_{n}",
                            prefix=1, value=2)]
    engine = Veil(packs=[pack])
    return engine.findings(engine.scan(lines, key=["line_id"]), key=["line_id"]).select(
        "line_id", "pattern", "value")


def predicate(kind: str) -> Query:
    def run(spark, sf):
        base = by_name("email")[0]
        docs = documents(spark, sf)
        if kind == "filter":
            found = find_spans(docs, "text", [base])
            return fnd.filter_python(found, _even).select("doc_id", "value")
        options = ({"check": ("length(value) % 2 = 0",)} if kind == "sql"
                   else {"python_check": lambda values: values.str.len() % 2 == 0})
        own = custom_detector("own_email", base.regex, **options)
        return find_spans(docs, "text", [own], resolve=True).select("doc_id", "value")

    return run


def _even(values):
    return values.str.len() % 2 == 0


# annotations at run time, so that pandas is only needed where a Python predicate runs
def _annotate():
    import pandas as pd

    _even.__annotations__ = {"values": pd.Series, "return": pd.Series}


_annotate()


# -- configuration lines, sources and sinks ---------------------------------------------------


def env(spark, sf):
    return redact_env(sql_over(spark, sf, "customer", env_lines())).documents


def lines_of(spark, sf):
    return split_lines(documents(spark, sf), "doc_id").groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def corpus_source(spark, sf):
    docs = read_corpus(spark, f"{sf}/documents.parquet", ["doc_id", "text"], "parquet")
    return docs.select("doc_id", "text", F.length("text").alias("chars"))


def allowlist_source(spark, sf):
    path = new_folder(spark, "allowlist")
    table(spark, sf, "customer").selectExpr("concat('  ', c_name, ' ') AS value").write.text(path)
    return read_allowlist(spark, path).distinct()


def records_source(spark, sf):
    path = new_folder(spark, "records")
    table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "named_struct('who', role, 'text', text) AS body").write.json(path)
    records = read_records(
        spark, path, "conv_id bigint, turn bigint, body struct<who:string,text:string>")
    return records.select("conv_id", "turn", F.col("body.who").alias("who"),
                          F.col("body.text").alias("text"), F.length("body.text").alias("chars"))


def written(spark, sf):
    path = new_folder(spark, "redacted")
    write_redacted(three().redact(documents(spark, sf)).documents, path)
    return spark.read.parquet(path)


FILE_BYTES = 8 * 1024 ** 2  # of text, about, in a file of text_files


def text_files(spark, sf):
    """Files of bounded size per language, whole and in numbered lines, against each other."""
    path = new_folder(spark, "files")
    docs = table(spark, sf, "documents").selectExpr(
        "lang", "concat(doc_id, ' ', replace(text, '\\n', ' ')) AS value", "xxhash64(doc_id, text) AS h")
    size = docs.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    (docs.repartitionByRange(-(-size // FILE_BYTES) or 1, "lang", "h").sortWithinPartitions("lang", "value")
     .select("lang", "value").write.partitionBy("lang").text(path))
    whole = split_lines(read_corpus(spark, f"{path}/*/*.txt"), "path").where("line <> ''")
    lines = read_lines(spark, f"{path}/*/*.txt").withColumnRenamed("line", "again")
    both = whole.withColumn("line_no", F.col("line_no").cast("long")).join(lines, ["path", "line_no"], "full")
    return both.selectExpr("CAST(split_part(line, ' ', 1) AS BIGINT) AS doc_id",
                           "substring(line, length(split_part(line, ' ', 1)) + 2) AS text", "line = again AS same")


def env_files(spark, sf):
    """Configuration files: redacted line by line and restored."""
    path = new_folder(spark, "env")
    sql_over(spark, sf, "customer", env_lines()).select("line").write.text(path)
    lines = read_env_lines(spark, f"{path}/*.txt").where("line <> ''")
    done = redact_env(lines)
    left = done.documents.where("line LIKE '%REDACTED_ENV_%'").count() > 0
    return restore_env(done.documents, done.mapping).select("line", F.lit(left).alias("redacted"))


def mapping_files(spark, sf):
    """A mapping as JSON files and back."""
    path = new_folder(spark, "mapping")
    mapping = corpus_mapping(spark, sf)
    write_mapping(mapping, path, "jsonl")
    return read_mapping(spark, path, "jsonl").select("value", "pseudonym")


def domains_of_sites(spark, sf):
    engine = Veil(detectors=by_name("domain"))
    pages = table(spark, sf, "pages").selectExpr(
        "page_id", "replace(url, 'example.com', concat('site', page_id % 50, '.org')) AS url")
    return engine.findings(engine.scan(pages, "url", ["page_id"]), "url", ["page_id"]).select("page_id", "value")


def identifiers_of_pages(spark, sf):
    pages = table(spark, sf, "pages").selectExpr(
        "page_id", "concat(html, ' hostname: web', page_id, 'x') AS html")
    return find_spans(pages, "html", by_name("generic_identifier_unquoted"), key=["page_id"]).select("page_id", "value")


# -- streams ----------------------------------------------------------------------------------


def _stream(spark, path):
    return spark.readStream.schema("doc_id bigint, text string").parquet(path)


def stream_rows(spark, sf):
    folder = new_folder(spark, "stream")
    documents(spark, sf).write.parquet(f"{folder}/in")
    redacted = stream.redact_stream(_stream(spark, f"{folder}/in"), three())
    (redacted.select("doc_id", "text").writeStream.format("parquet")
     .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
     .start(f"{folder}/out").awaitTermination())
    return spark.read.schema("doc_id bigint, text string").parquet(f"{folder}/out")


def stream_batches(spark, sf):
    """Two arrivals on one stream: the mapping of the first is continued by the second."""
    folder = new_folder(spark, "stream")
    docs = table(spark, sf, "documents")
    for arrival, rows in enumerate((docs.where("lang = 'en'"), docs.where("lang <> 'en'"))):
        rows.select("doc_id", "text").write.parquet(f"{folder}/in/arrival={arrival}")
        stream.start_redaction(
            _stream(spark, f"{folder}/in/*"), three(), f"{folder}/mapping", f"{folder}/out",
            f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "text")


def stream_back(spark, sf):
    folder = new_folder(spark, "stream")
    engine = three()
    done = engine.redact(documents(spark, sf))
    done.documents.write.parquet(f"{folder}/in")
    stream.start_restore(_stream(spark, f"{folder}/in"), engine, done.mapping, f"{folder}/out",
                         f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "text")


MAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"


def awkward(key: str = "doc_id", source: str = "source", scope: str = "corpus") -> Query:
    """Redact and restore under null or repeated keys and scopes; mails that were left."""

    def run(spark, sf):
        engine = three()
        docs = table(spark, sf, "documents").selectExpr("doc_id AS id", f"{key} AS doc_id", "text", f"{source} AS source")
        done = engine.redact(docs, scope=scope)
        left = F.expr("size(filter(regexp_extract_all(text, '" + MAIL.replace("\\", "\\\\")
                      + "', 0), m -> NOT endswith(m, '@redacted.example.net')))")
        mails = done.documents.select("id", left.cast("long").alias("left"))
        back = restore_join(done.documents, "text", done.mapping, engine.detectors, ["doc_id"], scope)
        return back.select("id", "text").join(mails, "id")

    return run


UNIQUE = ("date_iso", "dob", "age", "gender")


def restore_unique(spark, sf):
    """Two lines of equal kind: constant pseudonyms are numbered and come back."""
    engine = Veil(detectors=by_name(*UNIQUE), unique=True)
    lines = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS doc_id", "concat('due ', CAST(o_orderdate AS DATE), ' born on 0', o_orderkey % 9 + 1, '/0', o_custkey % 9 + 1,"
        " '/19', 50 + o_orderkey % 50, ' and due ', date_add(CAST(o_orderdate AS DATE), 1)) AS text")
    done = engine.redact(lines)
    redacted = stage(done.documents, "redacted")  # read twice
    left = redacted.selectExpr("doc_id", "CAST(contains(text, '~') AS BOOLEAN) AS numbered")
    return engine.restore(redacted, done.mapping).join(left, "doc_id")


def plates_strict(spark, sf):
    engine = Veil(detectors=by_name("plate_us"), strict=True)
    scanned = engine.scan(documents(spark, sf))
    return engine.findings(scanned).select("doc_id", "v_start", "value")


def queries() -> dict[str, Query]:
    every: dict[str, Query] = {f"find_{name}": family(name) for name in LINES}
    every |= {
        "find_emails": one("email", "start", "end", "value"),
        "find_ips": one("ipv4", "start", "end", "v_end", "value"),
        "find_cards_luhn": one("credit_card", "start", "end", "value"),
        "find_phones": find_phones,
        "find_secret_tokens": one("generic_secret", "start", "v_start", "value"),
        "find_identifiers_documents": one("generic_identifier_unquoted", "start", "v_start", "value"),
        "find_identifiers_pages": one("generic_identifier_unquoted", "start", "v_start", "value",
                                      tbl="pages", key="page_id", column="html"),
        "find_domains": find_domains,
        "find_plates": one("plate_us", "start", "v_start", "value"),
        "find_spans_offsets": lambda s, d: corpus_findings(s, d, False).select(*FACTS),
        "scan_documents": lambda s, d: corpus_findings(s, d).select(*FACTS),
        "scan_everything": scan_everything,
        "resolve_overlaps": resolve,
        "category_filter": lambda s, d: _grouped_off(s, d),
        "enabled_findings": lambda s, d: fnd.enabled(
            corpus_findings(s, d), {"pii": False}).select(*FACTS),
        "allowlist_anti": lambda s, d: fnd.not_allowlisted(
            corpus_findings(s, d), allow_table(s, d), "value").select(*FACTS),
        "allowlist_scan": allowlist_scan,
        "split_clean": split_clean,
        "with_group": lambda s, d: fnd.count_by(
            fnd.with_group(corpus_findings(s, d)), "category", "grp"),
        "match_names": match_names,
        "rejected_values": rejected,
        "detectors_by_priority": by_priority,
        "find_all_person_names": person_names,
        "detect_languages": lambda s, d: languages(s, d).select(
            "doc_id", F.array_join("langs", ",").alias("langs")),
        "keywords_for": keywords,
        "distinct_values": distinct_values,
        "count_by_category_rollup": lambda s, d: fnd.count_rollup(corpus_findings(s, d)),
        "count_by_document": lambda s, d: fnd.count_by(corpus_findings(s, d), "doc_id", "category"),
        "top_values": lambda s, d: fnd.top_values(corpus_findings(s, d), 5),
        "occurrence_index": lambda s, d: fnd.occurrence_index(
            corpus_findings(s, d), ["doc_id"]).select("doc_id", "start", "value", "occurrence"),
        "number_values_corpus": numbered("corpus"),
        "number_values_document": numbered("document"),
        "number_values_source": numbered("source"),
        "continue_mapping": continued,
        "new_values": new_values,
        "mapping_table": mapping_table,
        "join_mapping": join_mapping,
        "join_hot_values": join_hot_values,
        "item_count": lambda s, d: mp.item_count(corpus_mapping(s, d)),
        "confidence_summary": lambda s, d: mp.confidence_summary(corpus_mapping(s, d)),
        "render_pseudonyms": render_all,
        "pseudo_ip": render_one("@ip", "lineitem", "l_orderkey * 8 + l_linenumber"),
        "pseudo_mac": render_one("@mac", "customer", "c_custkey"),
        "pseudo_arn": render_one("@arn", "orders", "o_orderkey", ARN_VALUE),
        "keep_cidr": keep_cidr,
        "redact_documents": redact(),
        "redact_by_document": redact("document"),
        "redact_by_source": redact("source"),
        "redact_everything": redact_everything,
        "redact_multi_column": multi_column,
        "redact_null_key": awkward(key="CASE WHEN doc_id % 2 = 0 THEN doc_id END"),
        "redact_duplicate_key": awkward(key="doc_id div 10"),
        "redact_duplicate_key_document": awkward(key="doc_id div 10", scope="document"),
        "redact_null_key_document": awkward(key="CASE WHEN doc_id % 2 = 0 THEN doc_id END", scope="document"),
        "redact_null_scope": awkward(source="CASE WHEN doc_id % 3 <> 0 THEN source END", scope="source"),
        "restore_unique": restore_unique,
        "find_plates_strict": plates_strict,
        "restore_exact": restored("exact"),
        "restore_join": restored("join"),
        "restore_by_document": restored("document"),
        "restore_nested": nested,
        "restore_nested_by_source": nested_by_source,
        "restored_count": count_restored,
        "union_findings": union,
        "merge_mappings": merged,
        "mapping_diff": diff,
        "audit_mapping": audited,
        "mapping_json": json_mapping,
        "verify_roundtrip": failures(round_trip),
        "verify_no_leak": failures(leaks),
        "verify_idempotent": failures(twice),
        "verify_no_originals": planted_originals,
        "find_words": words_of_table,
        "custom_words": own_words,
        "custom_regex": own_regex,
        "detector_packs": packs,
        "predicate_sql": predicate("sql"),
        "predicate_python": predicate("python"),
        "filter_python": predicate("filter"),
        "env_lines": env,
        "split_lines": lines_of,
        "read_corpus": corpus_source,
        "read_allowlist": allowlist_source,
        "read_text_files": text_files,
        "read_env_files": env_files,
        "mapping_files": mapping_files,
        "find_domains_sites": domains_of_sites,
        "find_identifiers_hosts": identifiers_of_pages,
        "read_records": records_source,
        "write_redacted": written,
        "redact_stream_rows": stream_rows,
        "redact_stream_batches": stream_batches,
        "restore_stream": stream_back,
    }
    return every


def _grouped_off(spark, sf):
    engine = three(groups={"pii": False})
    found = engine.findings(engine.scan(documents(spark, sf)))
    # ranks of the smaller catalogue count from 0 again
    return found.withColumn("rank", F.col("rank") + 1).select(*FACTS)


__all__ = ["queries"]
