"""DuckDB SQL with the same meaning as the queries in ``queries.py``."""

from __future__ import annotations

from textveil.functions import words as w
from textveil.functions.detectors import BUILT_IN, FAMILIES
from textveil.functions.templates import _FIELD, is_constant
from workload.lines import LINES, expected_sql, lines_sql


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    listed = ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")"
                       for r in rows)
    return f"(VALUES {listed}) AS v({columns})"


# -- matches with positions -------------------------------------------------------------------

O, S, C = "chr(57344)", "chr(57345)", "chr(57346)"


def matches(table: str, key: str, column: str, regex: str, groups: int = 1, after: int = 0) -> str:
    """Matches of ``regex``: (prefix)(value) for two groups, (value)(tail) for -2, else (value).
    ``after`` characters at the end of the regex stand for a look-ahead.

    Matches are bracketed by a replace, the text is cut at the brackets, and running sums of
    the lengths give the positions.
    """
    mark = {
        1: f"{O} || {S} || '\\1' || {S} || {C}",
        2: f"{O} || '\\1' || {S} || '\\2' || {S} || {C}",
        -2: f"{O} || {S} || '\\1' || {S} || '\\2' || {C}",
    }[groups]
    return f"""
      SELECT {key}, start, start + length(f1) + length(f2) + length(f3) AS "end",
             start + length(f1) AS v_start, start + length(f1) + length(f2) AS v_end, f2 AS value
      FROM (
        SELECT {key}, i, f1, f2, f3, coalesce(sum(n) OVER (PARTITION BY {key} ORDER BY i
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
        FROM (
          SELECT {key}, i, piece,
                 CASE WHEN i > 1 THEN split_part(split_part(piece, {C}, 1), {S}, 1) ELSE '' END AS f1,
                 CASE WHEN i > 1 THEN split_part(split_part(piece, {C}, 1), {S}, 2) ELSE '' END AS f2,
                 CASE WHEN i > 1 THEN split_part(split_part(piece, {C}, 1), {S}, 3) ELSE '' END AS f3,
                 length(piece) - CASE WHEN i > 1 THEN {3 - after} ELSE 0 END AS n
          FROM (
            SELECT {key}, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i
            FROM (SELECT {key}, string_split(regexp_replace({column}, {q(regex)}, {mark}, 'g'), {O})
                         AS parts FROM {table} WHERE regexp_matches({column}, {q(regex)}))
          )
        )
      ) WHERE i > 1
    """


EMAIL = r"([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"
_OCT = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
IPV4 = rf"\b((?:{_OCT}\.){{3}}{_OCT})((?:/\d{{1,2}})?)\b"
CARD = r"(\b(?:\d[ -]*?){13,19}\b)"
DOMAIN = (r"(\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)"
          r"+(?:com|org|net|io|dev|co|app|cloud|internal|local|corp)\b)")


def luhn(value: str) -> str:
    s = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    digit = f"CAST(substr({s}, length({s}) - i + 1, 1) AS INT)"
    return (f"(length({s}) >= 13 AND list_sum(list_transform(range(1, length({s}) + 1), lambda i:"
            f" CASE WHEN i % 2 = 0 THEN (2 * {digit}) // 10 + (2 * {digit}) % 10 ELSE {digit} END))"
            " % 10 = 0)")


KEPT_IPS = ", ".join(map(q, w.KEPT_ADDRESSES))
OWN = " AND ".join(f"NOT ends_with(value, {q(x)})" for x in w.KEPT_DOMAINS)


def three(table: str = "documents", key: str = "doc_id", column: str = "text") -> str:
    """CTEs ``raw`` and ``f``: cards, e-mails and addresses in rank order, overlaps resolved."""
    return f"""
    raw AS (
      SELECT 0 AS rank, 'credit_card' AS pattern, 'credit_card' AS category, 'pii' AS grp,
             'high' AS confidence, * FROM ({matches(table, key, column, CARD)}) WHERE {luhn('value')}
      UNION ALL
      SELECT 1, 'email', 'email', 'network', 'high', * FROM ({matches(table, key, column, EMAIL)})
      UNION ALL
      SELECT 2, 'ipv4', 'ip', 'network', 'medium', * FROM ({matches(table, key, column, IPV4, -2)})
      WHERE value NOT IN ({KEPT_IPS})
    ),
    f AS (
      SELECT * FROM raw x WHERE NOT EXISTS (SELECT 1 FROM raw y WHERE y.{key} = x.{key}
        AND y.rank < x.rank AND x.start < y."end" AND y.start < x."end")
    )"""


PSEUDONYM = """CASE category
      WHEN 'credit_card' THEN printf('4000-0000-0000-%04d', n)
      WHEN 'email' THEN 'user-' || n || '@redacted.example.net'
      WHEN 'ip' THEN '10.' || (n // 256) % 256 || '.' || n % 256 || '.' || ((n * 7) % 254 + 1)
    END"""


def numbered(scope: str = "''", source: str = "f") -> str:
    """CTEs ``firsts`` and ``m``, the mapping."""
    return f"""
    firsts AS (
      SELECT * FROM (SELECT {scope} AS scope, *, count(*) OVER (PARTITION BY {scope}, value) AS uses,
        row_number() OVER (PARTITION BY {scope}, value ORDER BY doc_id, rank, start) AS r
        FROM {source}) WHERE r = 1
    ),
    m AS (
      SELECT *, {PSEUDONYM} AS pseudonym FROM (
        SELECT scope, value, category, pattern, confidence, uses, row_number() OVER (
          PARTITION BY scope, category ORDER BY doc_id, rank, start) AS n FROM firsts)
    )"""


def rewritten(scope: str = "''", cte: str = "x") -> str:
    """CTE ``x``: documents with every finding replaced."""
    return f"""
    e AS (
      SELECT f.doc_id, v_start, v_end, pseudonym, coalesce(lag(v_end) OVER (
        PARTITION BY f.doc_id ORDER BY v_start), 0) AS before
      FROM f JOIN m ON m.value = f.value AND m.scope = {scope}
    ),
    g AS (
      SELECT e.doc_id, string_agg(substr(d.text, before + 1, v_start - before) || pseudonym, ''
             ORDER BY v_start) AS head, max(v_end) AS last
      FROM e JOIN documents d ON d.doc_id = e.doc_id GROUP BY e.doc_id
    ),
    {cte} AS (
      SELECT d.doc_id, CASE WHEN g.doc_id IS NULL THEN d.text
             ELSE g.head || substr(d.text, g.last + 1) END AS text
      FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
    )"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


DOC_SCOPE = "CAST(f.doc_id AS VARCHAR)"
FULL = ('SELECT doc_id, rank, pattern, category, grp, confidence, start, "end", v_start, v_end,'
        " value FROM f")
MAP = "SELECT scope, value, pseudonym, category, pattern, confidence, n FROM m"
TOKENS = rf"""
    tok AS (
      SELECT doc_id, unnest(regexp_extract_all(text,
        '4000-0000-0000-[0-9]{{4,}}|user-[0-9]+@redacted\.example\.net|10\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}'
      )) AS pseudonym FROM x
    )"""


def language_cases() -> dict[str, str]:
    cases = {lang: f"regexp_matches(text, {q('[' + r + ']')})"
             for lang, r in w.SCRIPT_RANGES.items()}
    for lang, words in w.MARKER_WORDS.items():
        edge = r"[^\p{L}\p{N}_]"
        cases[lang] = (f"regexp_matches(lower(text), {q(f'(?:^|{edge})(?:{chr(124).join(words)})'
                                                      f'(?:{edge}|$)')})")
    return cases


def languages() -> str:
    items = ["'en'"] + [f"CASE WHEN {test} THEN '{lang}' END"
                        for lang, test in language_cases().items()]
    return f"list_sort(list_filter([{', '.join(items)}], lambda l: l IS NOT NULL))"


def printf_of(template: str) -> str:
    rules = {
        "@ip": "'10.' || (n // 256) % 256 || '.' || n % 256 || '.' || ((n * 7) % 254 + 1)",
        "@mac": "'AA:BB:CC:00:00:' || printf('%02X', n % 256)",
        "@account": "CAST(100000000000 + n AS VARCHAR)",
        "@arn": "'arn:aws:iam::' || (100000000000 + n) || ':role/redacted-' || n",
    }
    if template in rules:
        return rules[template]
    if is_constant(template):
        return q(template)
    return f"printf({q(_FIELD.sub(lambda x: f'%0{x[1]}d' if x[1] else '%d', template))}, n)"


_IDENT = "|".join(k for family in w.IDENTIFIER_WORDS.values() for k in family)
_SECRET = "|".join(w.SECRET_WORDS)


def env_lines() -> str:
    """Configuration lines from customers: one file per nation; Spark and DuckDB alike."""
    k = "CAST(c_custkey AS STRING)"
    return f"""SELECT 'nation_' || CAST(c_nationkey AS STRING) AS path, c_custkey AS line_no,
      CASE c_custkey % 5
        WHEN 0 THEN 'DB_HOST=172.16.' || CAST(c_custkey % 200 AS STRING) || '.' || CAST(c_custkey % 90 AS STRING)
        WHEN 1 THEN '  DB_PASSWORD = "pw' || {k} || '"'
        WHEN 2 THEN '# comment ' || {k}
        WHEN 3 THEN 'APP_NAME=app' || {k}
        ELSE 'MAIL_TOKEN=ops' || {k} || '@corp' || CAST(c_custkey % 7 AS STRING) || '.com'
      END AS line FROM customer"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for family in LINES:
        out[f"find_{family}"] = expected_sql(family)

    # detection in documents and pages
    out["find_emails"] = f"SELECT doc_id, start, \"end\", value FROM ({matches('documents', 'doc_id', 'text', EMAIL)})"
    out["find_ips"] = (f"SELECT doc_id, start, \"end\", v_end, value FROM"
                       f" ({matches('documents', 'doc_id', 'text', IPV4, -2)}) WHERE value NOT IN ({KEPT_IPS})")
    out["find_cards_luhn"] = (f"SELECT doc_id, start, \"end\", value FROM"
                              f" ({matches('documents', 'doc_id', 'text', CARD)}) WHERE {luhn('value')}")
    # a boundary character on each side stands for the look-arounds; two passes find
    # neighbours that share one
    phone = r"(^|[^0-9])((?:\+1[-.\s]?)?\(?[2-9][0-9]{2}\)?[-.\s][0-9]{3}[-.\s]?[0-9]{4})($|[^0-9])"
    mark = f"'\\1' || {O} || '\\2' || {C} || '\\3'"
    out["find_phones"] = f"""
      SELECT doc_id, value, count(*) AS uses FROM (
        SELECT doc_id, unnest(regexp_extract_all(
          regexp_replace(regexp_replace(text, {q(phone)}, {mark}, 'g'), {q(phone)}, {mark}, 'g'),
          {O} || '([^' || {O} || {C} || ']+)' || {C}, 1)) AS value
        FROM documents WHERE regexp_matches(text, {q(phone)})
      ) GROUP BY doc_id, value"""
    secret = rf"(?i)((?:{_SECRET}){w.SECRET_LINK}\s*[\"'])([^\"']{{4,500}})[\"']"
    # the closing quote is no part of the match, and no later match can start with it
    out["find_secret_tokens"] = f"""
      SELECT doc_id, start, v_start, value FROM ({matches('documents', 'doc_id', 'text', secret, 2, 1)})
      WHERE NOT starts_with(value, 'REDACTED_')"""
    ident = rf"(?i)((?:{_IDENT}){w.IDENTIFIER_LINK}\s*)([^\s\"']{{2,}})"
    common = ", ".join(map(q, w.KEPT_WORDS))
    for table, key, column in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
        out[f"find_identifiers_{table}"] = f"""
          SELECT {key}, start, v_start, value FROM ({matches(table, key, column, ident, 2)})
          WHERE NOT starts_with(value, 'REDACTED_') AND lower(value) NOT IN ({common}) AND {OWN}"""
    out["find_domains"] = f"""
      SELECT page_id, col, value, count(*) AS uses FROM (
        SELECT page_id, 0 AS col, unnest(regexp_extract_all(url, {q(DOMAIN)}, 1)) AS value FROM pages
        UNION ALL
        SELECT page_id, 1, unnest(regexp_extract_all(html, {q(DOMAIN)}, 1)) FROM pages
      ) WHERE {OWN} GROUP BY page_id, col, value"""
    plate = r"(?i)((?:plate|license\s*plate|tag|registration)[-.\s:]*)([A-Z0-9]{1,4}[-.\s]?[A-Z0-9]{2,5})"
    out["find_plates"] = f"SELECT doc_id, start, v_start, value FROM ({matches('documents', 'doc_id', 'text', plate, 2)})"
    strict = plate.replace("(?i)((?:", r"(?i)((?:^|[^\pL\pN_])(?:")
    out["find_plates_strict"] = f"SELECT doc_id, v_start, value FROM ({matches('documents', 'doc_id', 'text', strict, 2)})"
    for name in ("redact_null_key", "redact_duplicate_key", "redact_null_scope", "redact_duplicate_key_document",
                 "redact_null_key_document"):
        out[name] = 'SELECT doc_id AS id, text, CAST(0 AS BIGINT) AS "left" FROM documents'
    out["restore_unique"] = """
      SELECT o_orderkey AS doc_id, concat('due ', CAST(o_orderdate AS DATE), ' born on 0', o_orderkey % 9 + 1, '/0',
        o_custkey % 9 + 1, '/19', 50 + o_orderkey % 50, ' and due ', CAST(o_orderdate AS DATE) + 1) AS text,
        true AS numbered FROM orders"""
    out["find_spans_offsets"] = with_(three(), select=FULL.replace("FROM f", "FROM raw"))
    out["scan_documents"] = with_(three(), select=FULL)
    out["resolve_overlaps"] = expected_sql("network")

    # filters and joins
    out["category_filter"] = with_(three(), select=f"{FULL} WHERE grp <> 'pii'")
    out["enabled_findings"] = out["category_filter"]
    allow = "SELECT DISTINCT value FROM f WHERE category = 'ip' AND value LIKE '2%'"
    out["allowlist_anti"] = with_(three(), select=f"{FULL} WHERE value NOT IN ({allow})")
    out["allowlist_scan"] = out["allowlist_anti"]
    out["split_clean"] = with_(three(), select=(
        "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM f) THEN 0 ELSE 1 END AS clean"
        " FROM documents"))
    out["with_group"] = with_(three(), select="SELECT category, grp, count(*) AS findings FROM f GROUP BY ALL")
    names = ", ".join(f"({q(a)}, {q(b)})" for a, b in (
        ("john", "smith"), ("sarah", "johnson"), ("emily", "davis"), ("robert", "wilson")))
    out["match_names"] = (expected_sql("person_names").replace("WITH o AS", "WITH o AS", 1)
                          .replace("SELECT k AS line_id, 'person_name' AS pattern,", "SELECT * EXCLUDE (\"end\", v_start, pattern) FROM (SELECT k AS line_id, 'person_name' AS pattern,", 1)
                          + f") WHERE (lower(split_part(value, ' ', 1)), lower(split_part(value, ' ', 2))) IN ({names})")
    out["keywords_for"] = f"""
      SELECT d.doc_id, k.lang, count(*) AS keywords
      FROM (SELECT doc_id, unnest({languages()}) AS lang FROM documents) d
      JOIN {values([(lang, x) for lang, xs in w.FOREIGN_SECRET_WORDS.items() for x in xs], 'lang, keyword').replace('AS v(', 'AS k(')}
        ON k.lang = d.lang GROUP BY d.doc_id, k.lang"""
    out["detect_languages"] = f"SELECT doc_id, array_to_string({languages()}, ',') AS langs FROM documents"

    # aggregates, order, numbering
    out["distinct_values"] = with_(three(), numbered(), select="SELECT scope, value, category, pattern, confidence, uses FROM m")
    out["count_by_category_rollup"] = with_(three(), select=(
        "SELECT grp, category, pattern, count(*) AS findings FROM f GROUP BY ROLLUP (grp, category, pattern)"))
    out["count_by_document"] = with_(three(), select="SELECT doc_id, category, count(*) AS findings FROM f GROUP BY ALL")
    out["top_values"] = with_(three(), select=(
        "SELECT * FROM (SELECT category, value, count(*) AS uses, row_number() OVER (PARTITION BY category"
        " ORDER BY count(*) DESC, value) AS place FROM f GROUP BY category, value) WHERE place <= 5"))
    out["occurrence_index"] = with_(three(), select=(
        "SELECT doc_id, start, value, row_number() OVER (PARTITION BY doc_id, value ORDER BY start)"
        " AS occurrence FROM f"))
    src = "(SELECT source FROM documents d WHERE d.doc_id = f.doc_id)"
    out["number_values_corpus"] = with_(three(), numbered(), select=MAP)
    out["mapping_table"] = out["number_values_corpus"]
    out["number_values_document"] = with_(three(), numbered(DOC_SCOPE), select=MAP)
    by_source = "fs AS (SELECT f.*, source FROM f JOIN documents USING (doc_id))"
    out["number_values_source"] = with_(three(), by_source, numbered("source", "fs"), select=MAP)
    english = "fe AS (SELECT f.* FROM f JOIN documents USING (doc_id) WHERE lang = 'en')"
    cont = f"""
      m0 AS (SELECT * FROM m),
      late AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY doc_id, rank, start) AS r
          FROM f WHERE value NOT IN (SELECT value FROM m0)) WHERE r = 1),
      m1 AS (
        SELECT '' AS scope, value, category, pattern, confidence, row_number() OVER (PARTITION BY category
          ORDER BY doc_id, rank, start) + coalesce((SELECT max(n) FROM m0 WHERE m0.category = late.category), 0)
          AS n FROM late),
      m2 AS (
        SELECT scope, value, pseudonym, category, pattern, confidence, n FROM m0 UNION ALL
        SELECT scope, value, {PSEUDONYM}, category, pattern, confidence, n FROM m1)"""
    out["continue_mapping"] = with_(three(), english, numbered(source="fe"), cont, select="SELECT * FROM m2")
    out["new_values"] = with_(three(), english, numbered(source="fe"), cont, select="SELECT value, category FROM m1")
    out["join_hot_values"] = out["join_mapping"] = with_(three(), numbered(), select=(
        "SELECT doc_id, start, f.value, pseudonym, n FROM f JOIN m ON m.value = f.value"))
    out["item_count"] = with_(three(), numbered(), select="SELECT count(*) AS items FROM m")
    out["confidence_summary"] = with_(three(), numbered(), select=(
        "SELECT pattern, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium')"
        " AS medium, count(*) FILTER (confidence = 'low') AS low FROM m GROUP BY pattern"))

    # rendering
    templates = [(i, x) for i, x in enumerate(BUILT_IN)]
    cases = " ".join(f"WHEN {i} THEN {printf_of(x.template)}" for i, x in templates)
    names_ = " ".join(f"WHEN {i} THEN {q(x.name)}" for i, x in templates)
    out["render_pseudonyms"] = f"""
      SELECT n, CASE n % {len(templates)} {names_} END AS pattern, CASE n % {len(templates)} {cases} END AS pseudonym
      FROM (SELECT o_orderkey AS n FROM orders)"""
    out["pseudo_ip"] = f"SELECT n, {printf_of('@ip')} AS pseudonym FROM (SELECT l_orderkey * 8 + l_linenumber AS n FROM lineitem)"
    out["pseudo_mac"] = f"SELECT n, {printf_of('@mac')} AS pseudonym FROM (SELECT c_custkey AS n FROM customer)"
    out["pseudo_arn"] = """
      SELECT value, 'arn:aws:' || split_part(value, ':', 3) || ':' || split_part(value, ':', 4) || ':'
        || (100000000000 + n) || ':' || CASE WHEN n % 2 = 0 THEN 'function/' ELSE '' END || 'redacted-' || n AS pseudonym
      FROM (SELECT o_orderkey AS n, 'arn:aws:lambda:eu-west-1:' || printf('%012d', o_orderkey) || ':'
        || CASE WHEN o_orderkey % 2 = 0 THEN 'function/f' ELSE 'queue' END || o_orderkey || ':7' AS value FROM orders)"""
    out["keep_cidr"] = """
      SELECT line_id, 'cidr = 10.' || (r // 256) % 256 || '.' || r % 256 || '.' || ((r * 7) % 254 + 1) || '/24' AS text
      FROM (SELECT o_orderkey AS line_id, dense_rank() OVER (ORDER BY first) AS r FROM (
        SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_orderkey % 65536) AS first FROM orders))"""

    # rewriting and restoring
    docs = "SELECT doc_id, text FROM x"
    out["redact_documents"] = with_(three(), numbered(), rewritten(), select=docs)
    out["redact_by_document"] = with_(three(), numbered(DOC_SCOPE), rewritten("CAST(f.doc_id AS VARCHAR)"), select=docs)
    out["redact_stream_rows"] = out["redact_by_document"]
    out["redact_by_source"] = with_(three(), by_source, numbered("source", "fs"), rewritten(src), select=docs)
    out["restore_exact"] = "SELECT doc_id, text FROM documents"
    out["restore_join"] = out["restore_exact"]
    out["restore_by_document"] = out["restore_exact"]
    out["restore_stream"] = out["restore_exact"]
    out["restored_count"] = with_(three(), numbered(), rewritten(), TOKENS, select=(
        "SELECT d.doc_id, coalesce(c, 0) AS restored FROM documents d LEFT JOIN (SELECT doc_id,"
        " count(DISTINCT tok.pseudonym) AS c FROM tok JOIN m ON m.pseudonym = tok.pseudonym GROUP BY doc_id) t"
        " ON t.doc_id = d.doc_id"))
    out["restore_nested"] = ("SELECT doc_id, text AS top, text AS deep_first, text AS deep_last, n_chars AS number,"
                             " lang AS label FROM documents")
    out["redact_multi_column"] = f"""
      WITH u AS (SELECT page_id, replace(url, 'example.com', 'site' || page_id % 50 || '.org') AS url,
                        'title of www.site' || page_id % 70 || '.net and page ' || page_id AS title FROM pages),
      d AS (
        SELECT page_id, col, value, start, length(value) AS n FROM (
          SELECT page_id, 0 AS col, * EXCLUDE (page_id) FROM ({matches('u', 'page_id', 'url', DOMAIN)})
          UNION ALL
          SELECT page_id, 1, * EXCLUDE (page_id) FROM ({matches('u', 'page_id', 'title', DOMAIN)}))
        WHERE {OWN}),
      m AS (SELECT value, row_number() OVER (ORDER BY page_id, col, start) AS n FROM (
        SELECT *, row_number() OVER (PARTITION BY value ORDER BY page_id, col, start) AS r FROM d) WHERE r = 1)
      SELECT u.page_id,
        coalesce((SELECT substr(url, 1, start) || 'redacted-host-' || m.n || '.example.net' || substr(url, start + d.n + 1)
          FROM d JOIN m USING (value) WHERE d.page_id = u.page_id AND col = 0), url) AS url,
        coalesce((SELECT substr(title, 1, start) || 'redacted-host-' || m.n || '.example.net' || substr(title, start + d.n + 1)
          FROM d JOIN m USING (value) WHERE d.page_id = u.page_id AND col = 1), title) AS title
      FROM u"""

    # sets and audits
    out["union_findings"] = with_(three(), select="SELECT doc_id, pattern, start, value FROM raw WHERE pattern <> 'credit_card'")
    other = "fo AS (SELECT f.* FROM f JOIN documents USING (doc_id) WHERE lang <> 'en')"
    renamed = numbered(source="fo").replace("firsts", "firsts2").replace("m AS (", "mo AS (")
    merge = f"""
      lft AS (SELECT * FROM m WHERE value NOT IN (SELECT value FROM mo)),
      clash AS (SELECT * FROM lft WHERE pseudonym IN (SELECT pseudonym FROM mo)),
      moved AS (SELECT scope, value, category, pattern, confidence, row_number() OVER (PARTITION BY category
        ORDER BY n, value) + greatest(coalesce((SELECT max(n) FROM m WHERE m.category = clash.category), 0),
        coalesce((SELECT max(n) FROM mo WHERE mo.category = clash.category), 0)) AS n FROM clash)"""
    out["merge_mappings"] = with_(three(), english, other, numbered(source="fe"), renamed, merge, select=(
        f"SELECT scope, value, {PSEUDONYM} AS pseudonym, category, pattern, confidence, n FROM moved UNION ALL "
        + MAP.replace("FROM m", "FROM lft WHERE value NOT IN (SELECT value FROM clash)") + " UNION ALL "
        + MAP.replace("FROM m", "FROM mo")))
    out["mapping_diff"] = with_(three(), english, numbered(), numbered(source="fe").replace("firsts", "firsts2")
                                .replace("m AS (", "me AS ("), select=(
        "(SELECT value, pseudonym, 'removed' AS side FROM me EXCEPT SELECT value, pseudonym, 'removed' FROM m) UNION ALL"
        " (SELECT value, pseudonym, 'added' FROM m EXCEPT SELECT value, pseudonym, 'added' FROM me)"))
    by_lang = "fl AS (SELECT f.*, lang FROM f JOIN documents USING (doc_id))"
    out["audit_mapping"] = with_(three(), by_lang, numbered("lang", "fl"), select="""
      SELECT 'duplicate_pseudonym' AS "check", '' AS scope, pseudonym AS item, count(*) AS rows FROM m
      GROUP BY pseudonym HAVING count(*) > 1
      UNION ALL SELECT 'duplicate_value', '', value, count(*) FROM m GROUP BY value HAVING count(*) > 1
      UNION ALL SELECT 'unmapped', '', value, count(*) FROM f WHERE value NOT IN (SELECT value FROM m) GROUP BY value""")
    out["mapping_json"] = with_(three(), numbered(DOC_SCOPE), select="SELECT scope, pseudonym, value FROM m")
    out["verify_roundtrip"] = "SELECT count(*) AS documents, 0 AS failures FROM documents"
    out["verify_no_leak"] = out["verify_roundtrip"]
    out["verify_idempotent"] = out["verify_roundtrip"]

    # the caller's own detectors, configuration lines, sources
    out["restore_nested_by_source"] = "SELECT doc_id, source, text FROM documents"
    out["rejected_values"] = """
    SELECT o_orderkey AS line_id, 'ssn' AS pattern, 4 AS start, '2' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '-45-'
      || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS value FROM orders WHERE o_orderkey % 5 > 2
    UNION ALL SELECT o_orderkey, 'generic_identifier_unquoted', 18, 'svc_' || o_orderkey FROM orders WHERE o_orderkey % 7 > 3"""
    out["detectors_by_priority"] = """
    SELECT o_orderkey AS line_id, 'first' AS pattern, 0 AS start, 'ref' AS value FROM orders
    UNION ALL SELECT o_orderkey, 'early', 4, (1000 + o_orderkey % 9000) || '-' || o_orderkey || 'z' FROM orders
    UNION ALL SELECT o_orderkey, 'late', 15 + length(CAST(o_orderkey AS VARCHAR)), o_orderkey || 'z' FROM orders"""
    given, surnames = ("[" + ", ".join(q(x.title()) for x in names) + "]" for names in (w.GIVEN_NAMES, w.SURNAMES))
    out["find_all_person_names"] = f"""
    SELECT line_id, 8 AS start, value FROM (SELECT o_orderkey AS line_id, {given}[o_orderkey % {len(w.GIVEN_NAMES)} + 1] || ' '
      || {surnames}[(o_orderkey // 4) % {len(w.SURNAMES)} + 1] AS value FROM orders WHERE o_orderkey % 3 <> 0)"""
    out["verify_no_originals"] = with_(three(), numbered(), rewritten(), """
    p AS (SELECT x.doc_id, CASE WHEN o.value IS NULL THEN x.text
        ELSE x.text || ' é' || substr(o.value, 1, 9) || '_' || o.value || 'é' END AS text
      FROM x LEFT JOIN m o ON o.category = 'email' AND o.n = x.doc_id)""", select="""
    SELECT doc_id, value, CAST((length(text) - length(replace(text, value, ''))) // length(value) AS BIGINT) AS uses
    FROM p JOIN m ON contains(p.text, m.value)""")
    out["find_words"] = """
    WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{8,}')) AS word FROM conversations),
    l AS (SELECT DISTINCT length(word) AS n FROM w),
    runs AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{8,}'))) AS run FROM documents),
    places AS (SELECT doc_id, run, n, unnest(range(1, length(run) - n + 2)) AS p FROM runs, l WHERE n <= length(run))
    SELECT doc_id, word, count(*) AS uses FROM places JOIN w ON w.word = substr(run, p, n) GROUP BY ALL"""
    out["custom_words"] = """
      SELECT o_orderkey AS line_id, 9 AS start, o_orderpriority AS value FROM orders
      WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"""
    out["custom_regex"] = """
      SELECT line_id, 'see ORD_CODE_' || n || ' and REDACTED_TICKET_' || n AS text FROM (
        SELECT o_orderkey AS line_id, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)"""
    out["detector_packs"] = """
      SELECT o_orderkey AS line_id, 'k8s_pod' AS pattern, 'pod-' || o_orderkey || '-x' AS value FROM orders"""
    out["predicate_sql"] = f"""
      SELECT doc_id, value FROM ({matches('documents', 'doc_id', 'text', EMAIL)}) WHERE length(value) % 2 = 0"""
    out["predicate_python"] = out["predicate_sql"]
    out["filter_python"] = out["predicate_sql"]
    out["env_lines"] = f"""
      WITH l AS ({env_lines()}),
      n AS (
        SELECT path, line_no, kind, value, row_number() OVER (PARTITION BY path, kind ORDER BY line_no) AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY path, value ORDER BY line_no) AS r FROM (
            SELECT path, line_no, line_no % 5 AS kind, CASE line_no % 5 WHEN 1 THEN 'pw' || line_no
              WHEN 0 THEN substr(line, 9) WHEN 4 THEN substr(line, 12) END AS value FROM l) WHERE value IS NOT NULL)
        WHERE r = 1),
      p AS (SELECT path, value, CASE kind WHEN 1 THEN 'REDACTED_ENV_' || n
        WHEN 0 THEN '10.' || (n // 256) % 256 || '.' || n % 256 || '.' || ((n * 7) % 254 + 1)
        ELSE 'user-' || n || '@redacted.example.net' END AS new FROM n)
      SELECT l.path, l.line_no, CASE l.line_no % 5
        WHEN 0 THEN 'DB_HOST=' || (SELECT new FROM p WHERE p.path = l.path AND p.value = substr(line, 9))
        WHEN 1 THEN '  DB_PASSWORD = "' || (SELECT new FROM p WHERE p.path = l.path AND p.value = 'pw' || l.line_no) || '"'
        WHEN 4 THEN 'MAIL_TOKEN=' || (SELECT new FROM p WHERE p.path = l.path AND p.value = substr(line, 12))
        ELSE line END AS line FROM l"""
    out["split_lines"] = """
      SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id"""
    out["read_corpus"] = "SELECT doc_id, text, length(text) AS chars FROM documents"
    out["read_allowlist"] = "SELECT DISTINCT trim(c_name) AS value FROM customer"
    out["read_records"] = "SELECT conv_id, turn, role AS who, text, length(text) AS chars FROM conversations"
    out["read_text_files"] = "SELECT doc_id, replace(text, chr(10), ' ') AS text, true AS same FROM documents"
    out["read_env_files"] = f"SELECT line, true AS redacted FROM ({env_lines()}) WHERE line <> ''"
    out["mapping_files"] = with_(three(), numbered("''"), select="SELECT value, pseudonym FROM m")
    out["find_domains_sites"] = f"""
      SELECT page_id, value FROM (SELECT page_id, unnest(regexp_extract_all(
        replace(url, 'example.com', concat('site', page_id % 50, '.org')), {q(DOMAIN)}, 1)) AS value FROM pages)
      WHERE {OWN}"""
    out["find_identifiers_hosts"] = "SELECT page_id, concat('web', page_id, 'x') AS value FROM pages"
    out["write_redacted"] = out["redact_documents"]
    out["redact_stream_batches"] = with_(three(), english, numbered(source="fe"), cont,
                                         "mm AS (SELECT * FROM m2)",
                                         rewritten().replace("JOIN m ON m.value = f.value AND m.scope = ''",
                                                             "JOIN mm ON mm.value = f.value"), select=docs)
    return out


__all__ = ["FAMILIES", "env_lines", "lines_sql", "oracle_sql"]
