"""Lines rendered from the ``orders`` table, with known sensitive values in known places.

One piece is ``(pattern, lead, label, value, tail)``, each an SQL expression over ``k`` (the
order key) in the dialect Spark and DuckDB share. The text is all pieces in a row; the
finding a piece must give follows from the lengths of what stands before it.
"""

from __future__ import annotations


def t(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'"


def d(width: int, factor: int = 1, add: int = 0) -> str:
    """``width`` digits that vary with the key."""
    return f"lpad(CAST((k * {factor} + {add}) % {10 ** width} AS STRING), {width}, '0')"


K = "CAST(k AS STRING)"
MD5 = f"md5({K})"
GUID = (f"substr({MD5}, 1, 8) || '-' || substr({MD5}, 9, 4) || '-' || substr({MD5}, 13, 4)"
        f" || '-' || substr({MD5}, 17, 4) || '-' || substr({MD5}, 21, 12)")
DAY = "lpad(CAST(1 + k % 28 AS STRING), 2, '0')"
MONTH = "lpad(CAST(1 + k % 12 AS STRING), 2, '0')"
BAR = t(" | ")


def p(pattern, label, *value, tail="", lead=" | "):
    return (pattern, t(lead), t(label), "(" + " || ".join(f"({v})" for v in value) + ")", t(tail))


LINES = {
    "secret_formats": [
        p("connection_string", "", t("postgres://u"), K, t(":p@db"), K, t("/app")),
        p("hex_secret", 'webhook_secret = "', MD5, tail='"'),
        p("jwt", "", t("eyJhbGci"), K, t(".eyJzdWIi"), K, t(".s_"), MD5),
        p("bearer_token", "Authorization: Bearer ", MD5),
        p("ssh_public_key", "ssh-ed25519 ", t("AAAA"), MD5, t("==")),
        p("pem_key", "", t("-----BEGIN PRIVATE KEY-----"), "chr(10)", MD5, "chr(10)",
          t("-----END PRIVATE KEY-----")),
        p("api_key", "", t("sk-ant-"), MD5),
        p("sentry_dsn", "", t("https://"), MD5, t("@o"), K, t(".ingest.sentry.io/"), K),
    ],
    "secret_assignments": [
        p("generic_secret", 'password = "', t("hunter"), K),
        p("generic_secret_unquoted", "api_key: ", t("zz"), K, t("x"), lead='" | '),
        p("generic_secret_unquoted", "TOKEN is set to ", MD5),
    ],
    "network": [
        p("private_url", "", t("http://svc"), K, t(".corp:8080/v1/"), K),
        p("ipv4", "", t("172.16."), "CAST(k % 256 AS STRING)", t("."), "CAST(k % 100 AS STRING)",
          tail="/16"),
        p("email", "", t("user"), K, t("@mail"), "CAST(k % 9 AS STRING)", t(".com")),
        p("domain", "", t("host"), K, t(".internal")),
        p("mac_address", "", t("aa:bb:cc:"), d(2), t(":"), d(2, 7), t(":"), d(2, 13)),
    ],
    "aws": [
        p("arn", "", t("arn:aws:iam::"), d(12), t(":role/deploy-"), K),
        p("aws_account_id", "", d(12, 3, 5), lead=' | id:"'),
        p("s3_bucket", "", t("bucket-"), K, t("x"), lead='" | s3://'),
    ],
    "cloud": [
        p("azure_subscription", "/subscriptions/", GUID),
        p("gcp_project", "projects/", t("proj-"), K, t("-x")),
    ],
    "pii": [
        p("phone_us", "", t("(2"), d(2), t(") "), d(3), t("-"), d(4), lead=" | tel "),
        p("phone_uk", "", t("+44 "), d(4), t(" "), d(6)),
        p("credit_card", "", t("4111 1111 1111 1111")),
        p("ssn", "", t("1"), d(2), t("-"), d(2), t("-"), d(4)),
        p("passport", "", t("C"), d(8)),
        p("iban", "", t("DE89"), d(18)),
    ],
    "intl_phones": [
        p("phone_fr", "", t("+33 6 1"), d(1), t(" 2"), d(1), t(" 3"), d(1), t(" 4"), d(1)),
        p("phone_de", "", t("+49 30 1"), d(6)),
        p("phone_es", "", t("+34 6"), d(2), t(" 1"), d(2), t(" 1"), d(2)),
        p("phone_it", "", t("+39 3"), d(2), t(" 1"), d(2), t(" 1"), d(3)),
        p("phone_br", "", t("+55 11 9"), d(4), t("-1"), d(3)),
        p("phone_in", "", t("+91 9"), d(9)),
        p("phone_au", "", t("+61 4"), d(2), t(" 1"), d(2), t(" 1"), d(2)),
        p("phone_jp", "", t("+81 90 1"), d(3), t(" 1"), d(3)),
    ],
    "national_ids": [
        p("id_fr_insee", "", t("2 85 12 75 1"), d(2), t(" 4"), d(2), t(" 7"), d(1)),
        p("id_de_steuerid", "Steuer-ID: ", t("1"), d(1), t(" "), d(3), t(" "), d(3), t(" "), d(3)),
        p("id_in_aadhaar", "Aadhaar: ", t("2"), d(3), t(" "), d(4), t(" "), d(4)),
        p("id_in_pan", "", t("ABCDE"), d(4), t("F")),
        p("id_ca_sin", "SIN: ", d(3), t("-"), d(3, 7), t("-"), d(3)),
        p("id_au_tfn", "TFN: ", d(3), t(" "), d(3, 7), t(" "), d(3)),
        p("id_au_medicare", "Medicare: ", d(4), t(" "), d(5), t(" 1")),
        p("id_uk_utr", "UTR: ", d(10)),
        p("id_uk_nino", "", t("AB "), d(2), t(" "), d(2, 3), t(" "), d(2, 7), t(" C")),
        p("id_us_ein", "EIN: ", d(2), t("-"), d(7)),
        p("id_us_itin", "ITIN: ", t("9"), d(2), t("-"), d(2), t("-"), d(4)),
    ],
    "health_ids": [
        p("id_nhs", "NHS number: ", d(3), t(" "), d(3, 3), t(" "), d(4)),
        p("id_us_medicare", "Medicaid: ", t("M"), d(7)),
        p("id_insurance_policy", "policy number: ", t("P"), d(8)),
        p("id_vat", "VAT number: ", t("GB"), d(9)),
        p("id_uk_driving", "driving licence: ", t("JONES"), d(6), t("AB9CD")),
        p("id_us_driving", "DL# ", t("A"), d(7)),
    ],
    "bank_refs": [
        p("bank_sort_code", "sort code: ", d(2), t("-"), d(2, 3), t("-"), d(2, 7)),
        p("bank_routing", "routing number: ", d(9)),
        p("bank_account", "account number: ", d(8)),
        p("bank_swift", "SWIFT code: ", t("BARCGB"), d(2)),
    ],
    "postcodes": [
        p("postcode_uk", "", t("AB"), d(1), t(" "), d(1, 3), t("CD")),
        p("postcode_de", "PLZ: ", t("1"), d(4)),
        p("postcode_fr", "CP: ", t("75"), d(3)),
        p("postcode_jp", "〒", d(3), t("-"), d(4)),
        p("postcode_ca", "", t("K"), d(1), t("A "), d(1), t("B"), d(1)),
        p("postcode_in", "PIN code: ", t("1"), d(5)),
    ],
    "dates": [
        p("date_eu", "", DAY, t("/"), MONTH, t("/20"), d(2)),
        p("date_iso", "", t("20"), d(2), t("-"), MONTH, t("-"), DAY),
        p("dob", "DOB: ", DAY, t("/"), MONTH, t("/19"), d(2)),
    ],
    "vehicles_and_refs": [
        p("plate_uk", "", t("AB"), d(2), t(" CDE")),
        p("plate_us", "plate: ", t("XYZ-"), d(4)),
        p("plate_eu", "Kennzeichen: ", t("B-AB-"), d(4)),
        p("id_vin", "VIN: ", t("1HGBH41JXMN"), d(6)),
        p("id_claim_ref", "order number: ", t("ORD-2024-"), d(6)),
    ],
    "personal_attributes": [
        p("age", "age: ", "CAST(20 + k % 60 AS STRING)", tail=" years old"),
        p("gender", "gender: ", "CASE WHEN k % 2 = 0 THEN 'female' ELSE 'male' END"),
        p("nationality", "nationality: ", "CASE WHEN k % 3 = 0 THEN 'British' ELSE 'New Zealand' END",
          tail=" "),
        p("religion", "religion: ", "CASE WHEN k % 3 = 0 THEN 'Christianity' ELSE 'Islam' END",
          tail=" ", lead="| "),
    ],
    "person_names": [
        p("person_name", "", "CASE k % 4 WHEN 0 THEN 'John Smith' WHEN 1 THEN 'Sarah Johnson'"
          " WHEN 2 THEN 'Emily Davis' ELSE 'Robert Wilson' END", lead="Patient: "),
        (None, t(", Jordan River, "), "''", "''", "''"),
    ],
    "uuids": [p("uuid", "", GUID)],
    "keyword_identifiers": [
        p("generic_identifier", 'hostname = "', t("prod-"), K),
        p("generic_identifier_unquoted", "username: ", t("svc_"), K, lead='" | '),
        p("generic_identifier_unquoted", "dns_server set to ", t("ns"), K),
    ],
    "i18n_secrets": [
        p("i18n_secret_unquoted_fr", "mot de passe est ", t("abc"), K, t("xyz"), lead="mon "),
        p("i18n_secret_unquoted_es", "contraseña es ", t("abc"), K, t("xyz"), lead=" ; mi "),
        p("i18n_secret_unquoted_de", "Passwort ist ", t("abc"), K, t("xyz"), lead=" ; mein "),
        p("i18n_secret_unquoted_pt", "senha é ", t("abc"), K, t("xyz"), lead=" ; minha "),
        p("i18n_secret_unquoted_it", "password è ", t("abc"), K, t("xyz"), lead=" ; la mia "),
        p("i18n_secret_unquoted_nl", "wachtwoord is ", t("abc"), K, t("xyz"), lead=" ; mijn "),
        p("i18n_secret_unquoted_ja", "パスワードは", t("abc"), K, t("xyz"), lead=" ; "),
        p("i18n_secret_unquoted_zh", "密码是", t("abc"), K, t("xyz"), lead=" ; 我的"),
        p("i18n_secret_unquoted_ko", "비밀번호는 ", t("abc"), K, t("xyz"), lead=" ; 내 "),
        p("i18n_secret_unquoted_ru", "пароль: ", t("abc"), K, t("xyz"), lead=" ; мой "),
        p("i18n_secret_unquoted_ar", "السر: ", t("abc"), K, t("xyz"), lead=" ; "),
        p("i18n_secret_unquoted_hi", "पासवर्ड: ", t("abc"), K, t("xyz"), lead=" ; "),
        p("i18n_secret_fr", 'mdp = "', t("def"), K, lead=" ; "),
    ],
}
END = t('" . ')


def text_sql(family: str) -> str:
    """The line as one SQL expression over ``k``."""
    parts = [x for piece in LINES[family] for x in piece[1:]] + [END]
    return " || ".join(f"({x})" for x in parts)


def lines_sql(family: str) -> str:
    """``(line_id, text)`` over the orders table, for Spark and DuckDB alike."""
    return (f"SELECT k AS line_id, {text_sql(family)} AS text"
            " FROM (SELECT o_orderkey AS k FROM orders) o")


def expected_sql(family: str) -> str:
    """The findings every line must give: ``line_id, pattern, start, end, v_start, value``."""
    selects = []
    before: list[str] = []
    for pattern, lead, label, value, tail in LINES[family]:
        if pattern:
            start = " + ".join(f"length({x})" for x in [*before, lead])
            selects.append(
                f"SELECT k AS line_id, '{pattern}' AS pattern, {start} AS start,"
                f" {start} + length({label}) + length({value}) + length({tail}) AS \"end\","
                f" {start} + length({label}) AS v_start, {value} AS value FROM o")
        before += [lead, label, value, tail]
    return ("WITH o AS (SELECT o_orderkey AS k FROM orders) "
            + " UNION ALL ".join(selects))
