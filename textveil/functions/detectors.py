"""The detector catalogue: what counts as sensitive, as data.

A detector is one regular expression with at most two capture groups, the kept prefix and
the replaced value, plus the facts needed to order, check, gate and render its findings.
Everything that runs on Spark (:mod:`textveil.operators.scan`) is generic over this table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from textveil.functions import words as w
from textveil.functions.dialect import any_word, fewest, first_letters, java, leading_literals


@dataclass(frozen=True)
class Detector:
    """One kind of sensitive value.

    name, category   the category owns the counter that numbers the values
    regex            portable notation, see :mod:`textveil.functions.dialect`
    template         pseudonym with ``{n}`` / ``{n:04d}``, or a named rule (``@ip``)
    priority         lower runs first; ties keep catalogue order
    prefix, value    capture group numbers, 0 = none / the whole match
    check            predicates a match must pass: names from ``checks.py``, or SQL over
                     ``value`` and ``match``
    ignore_case      letters outside ASCII fold too if the regex holds any
    literals         lower-case strings of which a matching text holds at least one
    gate             name of a cheap necessary condition (see ``scan.GATES``)
    languages        languages the text must show (empty: any)
    trim             white space at the end of the value stays in the text
    allowable        the allowlist can spare a match
    labelled         starts with a keyword (see ``strict`` of the engine)
    python_check     vectorised predicate ``pandas.Series -> pandas.Series`` over values
    keywords, around lower-case keywords, and the regex with KEYWORD in their place, as group 2
                     of three, the others prefix and value: detectors with one ``around`` can be
                     run together
    """

    name: str
    category: str
    regex: str
    template: str
    priority: int = 50
    confidence: str = "high"
    prefix: int = 0
    value: int = 0
    check: tuple[str, ...] = ()
    ignore_case: bool = False
    literals: tuple[str, ...] = ()
    gate: str | None = None
    languages: tuple[str, ...] = ()
    trim: bool = False
    allowable: bool = True
    labelled: bool = False
    python_check: Callable | None = None
    keywords: tuple[str, ...] = ()
    around: str | None = None

    @property
    def java_regex(self) -> str:
        flags = ("(?i)" if self.regex.isascii() else "(?iu)") if self.ignore_case else ""
        return flags + java(self.regex)

    @property
    def group(self) -> str | None:
        return next((g for g, cats in w.CATEGORY_GROUPS.items() if self.category in cats), None)


# --------------------------------------------------------------------------------------
# Fixed values. Patterns, templates, priorities and confidence levels decide results, so
# they are stated plainly.  H and P are the two separator classes after a keyword.
# --------------------------------------------------------------------------------------

P = r"[-.\s:]*"
H = r"[-.\s#:]*"


def _labelled(name, category, priority, confidence, labels, sep, value, template, after="",
              before="", gate="digit", trim=False):
    """Keyword, separators, value: the keyword part stays in the text.

    The look-ahead on first letters is one class test where most places fail.
    """
    return Detector(
        name, category, f"(?=[{first_letters(labels)}])({before}(?:{labels}){sep})({value}){after}", template, priority,
        confidence, prefix=1, value=2, ignore_case=True, literals=leading_literals(labels),
        gate=gate, trim=trim, labelled=True,
    )


def _plain(name, category, priority, confidence, regex, template, **kw):
    return Detector(name, category, regex, template, priority, confidence, **kw)


_SECRET_KEY = any_word(w.SECRET_WORDS)
_IDENTIFIER_KEY = any_word(k for family in w.IDENTIFIER_WORDS.values() for k in family)
_SECRET_HINTS = fewest(w.SECRET_WORDS)
_IDENTIFIER_HINTS = fewest(k for family in w.IDENTIFIER_WORDS.values() for k in family)
_HEX4 = r"-[0-9a-fA-F]{4}"
_GUID = rf"[0-9a-fA-F]{{8}}{_HEX4}{_HEX4}{_HEX4}-[0-9a-fA-F]{{12}}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"

BUILT_IN: tuple[Detector, ...] = (
    # --- secret formats (run before everything else) ---------------------------------
    _plain("connection_string", "secret", 10, "high",
           r"(?=[mpra])(?:mysql|postgres|postgresql|mongodb|mongodb\+srv|redis|amqp)://[^\s\"'`\]}>)]+",
           "REDACTED_CONNSTR_{n}", ignore_case=True, literals=("://",)),
    Detector("hex_secret", "secret",
             rf"(?=[{first_letters('|'.join(w.HEX_SECRET_WORDS), True)}])((?:{any_word(w.HEX_SECRET_WORDS)})\s*[=:]\s*[\"']?)([a-fA-F0-9]{{32,64}})[\"']?",
             "REDACTED_HEX_{n}", 11, "medium", 1, 2, literals=fewest(w.HEX_SECRET_WORDS)),
    _plain("jwt", "secret", 12, "high",
           r"(?=e)(?<!eyJ)eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+",
           "REDACTED_JWT_{n}", literals=("eyj",)),
    Detector("bearer_token", "secret", r"(?=[ab])((?:Authorization:\s*)?Bearer\s+)([a-zA-Z0-9._\-+/=]{20,})",
             "REDACTED_BEARER_{n}", 13, "high", 1, 2, ("not_redacted",), ignore_case=True,
             literals=("bearer",)),
    Detector("ssh_public_key", "secret",
             r"(?=s)(ssh-(?:rsa|ed25519|ecdsa|dsa)\s+)(AAAA[0-9A-Za-z+/]+={0,2})",
             "REDACTED_SSH_KEY_{n}", 14, "high", 1, 2, literals=("ssh-",)),
    _plain("pem_key", "secret", 15, "high",
           r"-----BEGIN(?<label>[A-Z ]+)-----(?s:.*?)-----END\k<label>-----",
           "REDACTED_PEM_KEY_{n}", literals=("-----begin",)),
    _plain("api_key", "secret", 16, "high",
           r"(?=[Asgxh])\<(?:AKIA[0-9A-Z]{16}|sk-ant-[a-zA-Z0-9\-_]{20,}|sk-proj-[a-zA-Z0-9\-_]{20,}"
           r"|sk-[a-zA-Z0-9\-_]{20,}|AIza[a-zA-Z0-9\-_]{20,}|gsk_[a-zA-Z0-9]{20,}"
           r"|gh[pousr]_[A-Za-z0-9_]{36,}|xox[baprs]-[0-9\-a-zA-Z]{20,}|hf_[a-zA-Z0-9]{20,})\b",
           "REDACTED_SECRET_{n}",
           literals=("akia", "sk-", "aiza", "gsk_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_",
                     "xox", "hf_")),
    _plain("sentry_dsn", "secret", 17, "high",
           r"https://[a-f0-9]{32}@(?:o\d+\.)?ingest(?:\.[a-z]{2})?\.sentry\.io/\d+",
           "https://REDACTED_SENTRY_DSN_{n}@ingest.sentry.io/0", literals=("sentry.io/",)),
    # --- cloud, accounts, private addresses -------------------------------------------
    Detector("azure_subscription", "cloud", rf"(/subscriptions/)({_GUID})",
             "00000000-0000-4000-a000-{n:012d}", 18, "medium", 1, 2, literals=("/subscriptions/",)),
    _plain("arn", "arn", 20, "high", r"arn:aws:[a-z0-9\-]+:[a-z0-9\-]*:\d{12}:[^\s\"'`\]}>),$]+",
           "@arn", literals=("arn:aws:",)),
    Detector("gcp_project", "cloud", r"(projects/)([a-z][a-z0-9\-]{4,28}[a-z0-9])",
             "redacted-project-{n}", 22, "medium", 1, 2, literals=("projects/",)),
    _plain("s3_bucket", "bucket", 25, "medium",
           r"(?<=(?:s3://|s3:::))[a-z0-9][a-z0-9.\-]{1,61}[a-z0-9]",
           "redacted-bucket-{n}", literals=("s3:",)),
    _plain("aws_account_id", "account", 30, "medium", r"(?<=[:\"/])\d{12}(?=[:/\"\s])",
           "@account", gate="digits12"),
    _plain("private_url", "url", 35, "low",
           r"https?://[a-zA-Z0-9.\-]+:[1-9]\d{2,4}(?:/[^\s\"'`\]}>)]*)?",
           "http://redacted-internal-{n}.local:8080", literals=("://",)),
    # --- insurance, tax --------------------------------------------------------------
    _labelled("id_insurance_policy", "ssn", 38, "high",
              r"policy\s+(?:number|no|#)|insurance\s+id|member\s+id|subscriber\s+id"
              r"|group\s+(?:number|no|#)|plan\s+id",
              H, r"[A-Z0-9]{4,20}", "POLICY-{n:06d}", gate=None),
    _labelled("id_vat", "ssn", 38, "high", r"vat[_\s]*+(?:reg(?:istration)?[_\s]*+)?(?:number|no|id)?",
              H, r"[A-Z]{2}\d{8,12}[A-Z]?", "VAT{n:09d}"),
    # --- keyword secrets ------------------------------------------------------------
    Detector("generic_secret", "secret",
             rf"((?:{_SECRET_KEY})(?i:{w.SECRET_LINK})\s*[\"'])([^\"']{{4,500}})(?=[\"'])",
             "REDACTED_SECRET_{n}", 39, "low", 1, 2, ("not_redacted",),
             literals=_SECRET_HINTS, gate="quote"),
    Detector("generic_secret_unquoted", "secret",
             rf"((?:{_SECRET_KEY})(?i:{w.SECRET_LINK})\s*)([^\s\"']{{4,500}})",
             "REDACTED_SECRET_{n}", 39, "low", 1, 2, ("not_redacted",), literals=_SECRET_HINTS),
    # --- health, tax and national numbers ---------------------------------------------
    _labelled("id_nhs", "ssn", 43, "high", r"nhs|nhs\s+number|nhs\s+no", P,
              r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}", "000 000 {n:04d}"),
    _labelled("dob", "ssn", 43, "high",
              r"dob|date\s+of\s+birth|birthdate|birth\s+date|born\s+on|born", P,
              r"\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}", "01/01/1990"),
    _plain("ssn", "ssn", 44, "high", r"(?=\d)\<\d{3}-\d{2}-\d{4}\>", "078-05-{n:04d}",
           check=("ssn_area",), gate="dashed_digits"),
    _plain("id_fr_insee", "ssn", 44, "high",
           r"(?=[12])\<[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}\>",
           "1 00 00 00 000 {n:03d} 00", gate="digits7"),
    _labelled("id_de_steuerid", "ssn", 44, "high",
              r"steuer[-\s]?id(?:entifikationsnummer)?|tin", P,
              r"\d{2}\s?\d{3}\s?\d{3}\s?\d{3}", "00 000 000 {n:03d}"),
    _labelled("id_in_aadhaar", "ssn", 44, "high", r"aadhaar|aadhar|uidai", P,
              r"[2-9]\d{3}[-.\s]?\d{4}[-.\s]?\d{4}", "2000 0000 {n:04d}"),
    _labelled("id_ca_sin", "ssn", 44, "high", r"sin|social\s+insurance", P,
              r"\d{3}[-.\s]?\d{3}[-.\s]?\d{3}", "000-000-{n:03d}"),
    _labelled("id_au_tfn", "ssn", 44, "high", r"tfn|tax\s+file\s+number", P,
              r"\d{3}[-.\s]?\d{3}[-.\s]?\d{2,3}", "000 000 {n:03d}"),
    _labelled("id_au_medicare", "ssn", 44, "high", r"medicare", P,
              r"\d{4}[-.\s]?\d{5}[-.\s]?\d{1,2}", "0000 00000 {n}"),
    _labelled("id_us_medicare", "ssn", 44, "high", r"medicare|medicaid", H,
              r"[A-Z0-9]{4,12}", "0000-000-{n:04d}", gate=None),
    _labelled("id_uk_driving", "ssn", 44, "high",
              r"driving\s+licen[cs]e|driver'?s?\s+licen[cs]e|dvla", H,
              r"[A-Z]{5}\d{6}[A-Z0-9]{5}", "XXXXX000000XX0XX"),
    _labelled("id_us_driving", "ssn", 44, "high", r"driver'?s?\s+licen[cs]e|dl|dmv", H,
              r"[A-Z]?\d{4,12}", "DL-0000{n:04d}"),
    _labelled("id_uk_utr", "ssn", 44, "high",
              r"utr|unique\s+taxpayer\s+reference|tax\s+reference", H,
              r"\d{10}", "0000000{n:03d}", after=r"\>"),
    _plain("id_uk_nino", "ssn", 44, "high",
           r"(?=[A-Z])\<(?!BG|GB|NK|KN|TN|NT|ZZ)[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\>",
           "XX 00 00 {n:02d} A", gate="digit"),
    _labelled("id_us_ein", "ssn", 44, "high", r"ein|employer\s+id|fein|tax\s+id", H,
              r"\d{2}-\d{7}", "00-000{n:04d}", gate="dashed_digits"),
    _labelled("id_us_itin", "ssn", 44, "high", r"itin", H, r"9\d{2}-\d{2}-\d{4}", "900-00-{n:04d}",
              gate="dashed_digits"),
    # --- phones -----------------------------------------------------------------------
    _plain("phone_us", "phone", 45, "medium",
           r"(?<!\d)(?:\+1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s]\d{3}[-.\s]?\d{4}(?!\d)",
           "(555) 000-{n:04d}", gate="digits7"),
    _plain("phone_uk", "phone", 45, "medium", r"(?<!\d)(?:\+44[-.\s]?)\d{4}[-.\s]?\d{6}(?!\d)",
           "+44 7700 900{n:03d}", literals=("+44",)),
    _plain("phone_fr", "phone", 45, "medium", r"(?<!\d)(?:\+33[-.\s]?|0)[1-9](?:[-.\s]?\d{2}){4}(?!\d)",
           "+33 6 00 00 {n:04d}", gate="digits7"),
    _plain("phone_de", "phone", 45, "medium", r"(?<!\w)(?:\+49[-.\s]?|0)\d{2,5}[-.\s]?\d{3,8}(?!\d)",
           "+49 30 000{n:04d}", gate="digits5"),
    _plain("phone_es", "phone", 45, "medium",
           r"(?<!\d)\+34[-.\s]?[6-9]\d{2}[-.\s]?\d{3}[-.\s]?\d{3}(?!\d)",
           "+34 600 000 {n:03d}", literals=("+34",)),
    _plain("phone_it", "phone", 45, "medium",
           r"(?<!\d)\+39[-.\s]?3\d{2}[-.\s]?\d{3}[-.\s]?\d{4}(?!\d)",
           "+39 300 000 {n:04d}", literals=("+39",)),
    _plain("phone_br", "phone", 45, "medium",
           r"(?<!\d)\+55[-.\s]?\d{2}[-.\s]?9?\d{4}[-.\s]?\d{4}(?!\d)",
           "+55 11 90000 {n:04d}", literals=("+55",)),
    _plain("phone_in", "phone", 45, "medium", r"(?<!\d)(?:\+91[-.\s]?|0)[6-9]\d{9}(?!\d)",
           "+91 90000 {n:05d}", gate="digits7"),
    _plain("phone_au", "phone", 45, "medium",
           r"(?<!\d)(?:\+61[-.\s]?|0)4\d{2}[-.\s]?\d{3}[-.\s]?\d{3}(?!\d)",
           "+61 400 000 {n:03d}", gate="digits7"),
    _plain("phone_jp", "phone", 45, "medium",
           r"(?<!\d)(?:\+81[-.\s]?|0)[1-9]0[-.\s]?\d{4}[-.\s]?\d{4}(?!\d)",
           "+81 90 0000 {n:04d}", gate="digits7"),
    # --- bank -------------------------------------------------------------------------
    _labelled("bank_sort_code", "identifier", 46, "high", r"sort\s*code", H,
              r"\d{2}[-.\s]?\d{2}[-.\s]?\d{2}", "00-00-{n:02d}"),
    _labelled("bank_routing", "identifier", 46, "high",
              r"routing|routing\s+number|aba|transit", H, r"\d{9}", "000000{n:03d}", after=r"\>"),
    _labelled("bank_account", "identifier", 46, "high",
              r"account\s*(?:number|no|#)|acct\s*(?:no|#)|bank\s+account|checking|savings"
              r"|current\s+account", H, r"\d{6,18}", "00000000{n:04d}"),
    _labelled("bank_swift", "identifier", 46, "high", r"swift|bic|swift\s*code|bic\s*code", H,
              r"[A-Z]{6}[A-Z0-9]{2,5}", "XXXXXX00", gate=None),
    _plain("credit_card", "credit_card", 47, "high", r"\b(?:\d[ -]*?){13,19}\b",
           "4000-0000-0000-{n:04d}", check=("luhn",), gate="digits13"),
    # --- network ----------------------------------------------------------------------
    _plain("mac_address", "mac", 50, "medium", r"(?=[0-9A-Fa-f])\<(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\>",
           "@mac", gate="hex_pairs"),
    _plain("uuid", "uuid", 52, "medium", rf"(?=[0-9a-fA-F])\<{_GUID}\>", "00000000-0000-4000-a000-{n:012d}",
           gate="hex8"),
    # only where a run begins, or where one goes on right after a match: others fail as it did
    _plain("email", "email", 55, "high",
           r"(?:(?<![a-zA-Z0-9._%+\-])|(?<=[a-zA-Z])(?=[0-9._%+\-]))"
           r"[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
           "user-{n}@redacted.example.net", literals=("@",)),
    Detector("ipv4", "ip", rf"(?=\d)\<((?:{_OCTET}\.){{3}}{_OCTET})(?:/\d{{1,2}})?\>", "@ip", 60, "medium",
             value=1, check=("public_ip",), gate="dotted_digits"),
    _plain("iban", "iban", 62, "high", r"(?=[A-Z])\<[A-Z]{2}\d{2}(?:\s?[A-Z0-9]){11,30}\>",
           "GB00XXXX0000000{n:05d}", gate="digit"),
    _plain("passport", "passport", 65, "medium", r"(?=[A-Z])\<[A-Z]\d{8}\>", "X0000{n:04d}", gate="digits7"),
    _plain("id_in_pan", "ssn", 65, "medium", r"(?=[A-Z])\<[A-Z]{5}\d{4}[A-Z]\>", "AAAAA0000A", gate="digit"),
    # --- references and vehicles ------------------------------------------------------
    _labelled("id_vin", "identifier", 65, "high", r"vin|vehicle\s+identification", H,
              r"[A-HJ-NPR-Z0-9]{17}", "00000000000000{n:03d}", gate=None),
    _labelled("id_claim_ref", "identifier", 66, "medium",
              r"claim\s*(?:number|no|#|ref)|reference\s*(?:number|no|#)|case\s*(?:number|no|#)"
              r"|ticket\s*(?:number|no|#)|invoice\s*(?:number|no|#)|order\s*(?:number|no|#)"
              r"|booking\s*(?:number|no|#|ref)|confirmation\s*(?:number|no|#)"
              r"|tracking\s*(?:number|no|#)", H,
              r"[A-Z0-9][-A-Z0-9]{3,20}", "REF-{n:06d}", gate=None),
    _plain("plate_uk", "identifier", 68, "medium", r"(?=[A-Z])\<[A-Z]{2}\d{2}\s?[A-Z]{3}\>", "XX00 XXX",
           gate="digit"),
    _labelled("plate_us", "identifier", 68, "medium", r"plate|license\s*plate|tag|registration", P,
              r"[A-Z0-9]{1,4}[-.\s]?[A-Z0-9]{2,5}", "XXXX-{n:03d}", gate=None),
    _labelled("plate_eu", "identifier", 68, "medium",
              r"plate|plaque|kennzeichen|targa|matricula|kenteken|immatriculation", P,
              r"[A-Z0-9]{1,4}[-.\s]?[A-Z0-9]{1,4}[-.\s]?[A-Z0-9]{1,5}", "XX-000-XX", gate=None),
    # --- persons ----------------------------------------------------------------------
    _plain("person_name", "ssn", 69, "medium", r"(?=[A-Z])\<[A-Z][a-z]{1,14}\s+[A-Z][a-z']{1,19}\b",
           "[PERSON_{n}]", check=("known_name",)),
    # names have at most 127 labels; an open repetition would recurse without bound
    _plain("domain", "domain", 70, "low",
           r"(?=[a-zA-Z0-9])\<(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)"
           r"{1,127}(?:com|org|net|io|dev|co|app|cloud|internal|local|corp)\>",
           "redacted-host-{n}.example.net", check=("own_domain",),
           literals=(".com", ".org", ".net", ".io", ".dev", ".co", ".app", ".cloud", ".internal",
                     ".local", ".corp")),
    # --- postcodes --------------------------------------------------------------------
    _plain("postcode_uk", "identifier", 70, "low", r"(?=[A-Z])\<[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\>",
           "XX{n} 0XX", ignore_case=True, gate="digit"),
    _labelled("postcode_de", "identifier", 70, "low", r"plz|postleitzahl|postal", P, r"\d{5}",
              "0000{n}", after=r"\>"),
    _labelled("postcode_fr", "identifier", 70, "low", r"code\s+postal|cp", P, r"\d{5}",
              "7500{n}", after=r"\>"),
    Detector("postcode_jp", "identifier", r"(〒\s?)(\d{3}-\d{4})", "000-{n:04d}", 70, "low", 1, 2,
             literals=("〒",)),
    _plain("postcode_ca", "identifier", 70, "low", r"(?=[A-Z])\<[A-Z]\d[A-Z]\s?\d[A-Z]\d\>", "X0X 0X{n}",
           ignore_case=True, gate="digit"),
    _labelled("postcode_in", "identifier", 70, "low", r"pin\s*code|pincode|postal", P, r"\d{6}",
              "10000{n}", after=r"\>"),
    # --- personal attributes ----------------------------------------------------------
    _labelled("age", "ssn", 70, "medium", r"age|aged", P, r"\d{1,3}", "[AGE]",
              after=r"\s*(?:years?\s+old|yrs?\s+old|y\.?o\.?|years?|yrs?)?\b"),
    _labelled("gender", "ssn", 70, "medium", r"gender|sex", P,
              r"male|female|non-binary|nonbinary|other|m|f", "[GENDER]", after=r"\>", gate=None),
    _labelled("nationality", "ssn", 70, "medium", r"nationality|citizenship|ethnicity|race",
              r"\>" + P, r"[A-Za-z][-A-Za-z\s]{2,25}", "[NATIONALITY]", before=r"\<", gate=None,
              trim=True),
    _labelled("religion", "ssn", 70, "medium", r"religion|faith|religious\s+affiliation", P,
              r"[A-Za-z][-A-Za-z\s]{2,25}", "[RELIGION]", gate=None, trim=True),
    # --- dates ------------------------------------------------------------------------
    _plain("date_eu", "identifier", 72, "low",
           r"(?=[0-3])\<(?:0[1-9]|[12]\d|3[01])[/.\-](?:0[1-9]|1[0-2])[/.\-](?:19|20)\d{2}\>",
           "01/01/2000", gate="joined_digits"),
    _plain("date_iso", "identifier", 72, "low",
           r"(?=[12])\<(?:19|20)\d{2}[/\-](?:0[1-9]|1[0-2])[/\-](?:0[1-9]|[12]\d|3[01])\>",
           "2000-01-01", gate="joined_digits"),
    # --- keyword identifiers ----------------------------------------------------------
    Detector("generic_identifier", "identifier",
             rf"((?:{_IDENTIFIER_KEY})(?i:{w.IDENTIFIER_LINK})\s*[\"'])([^\"']{{2,}})(?=[\"'])",
             "REDACTED_IDENTIFIER_{n}", 85, "low", 1, 2,
             ("not_redacted", "own_domain_value", "uncommon"), literals=_IDENTIFIER_HINTS,
             gate="quote"),
    Detector("generic_identifier_unquoted", "identifier",
             rf"((?:{_IDENTIFIER_KEY})(?i:{w.IDENTIFIER_LINK})\s*)([^\s\"']{{2,}})",
             "REDACTED_IDENTIFIER_{n}", 85, "low", 1, 2,
             ("not_redacted", "own_domain_value", "uncommon"), literals=_IDENTIFIER_HINTS),
)

FAMILIES: Mapping[str, tuple[str, ...]] = {
    "secret_formats": ("connection_string", "hex_secret", "jwt", "bearer_token", "ssh_public_key",
                       "pem_key", "api_key", "sentry_dsn"),
    "secret_assignments": ("generic_secret", "generic_secret_unquoted"),
    "network": ("private_url", "ipv4", "email", "domain", "mac_address"),
    "aws": ("arn", "aws_account_id", "s3_bucket"),
    "cloud": ("azure_subscription", "gcp_project"),
    "pii": ("phone_us", "phone_uk", "credit_card", "ssn", "passport", "iban"),
    "intl_phones": ("phone_fr", "phone_de", "phone_es", "phone_it", "phone_br", "phone_in",
                    "phone_au", "phone_jp"),
    "national_ids": ("id_fr_insee", "id_de_steuerid", "id_in_aadhaar", "id_in_pan", "id_ca_sin",
                     "id_au_tfn", "id_au_medicare", "id_uk_utr", "id_uk_nino", "id_us_ein",
                     "id_us_itin"),
    "health_ids": ("id_nhs", "id_us_medicare", "id_insurance_policy", "id_vat", "id_uk_driving",
                   "id_us_driving"),
    "bank_refs": ("bank_sort_code", "bank_routing", "bank_account", "bank_swift"),
    "postcodes": ("postcode_uk", "postcode_de", "postcode_fr", "postcode_jp", "postcode_ca",
                  "postcode_in"),
    "dates": ("date_eu", "date_iso", "dob"),
    "vehicles_and_refs": ("plate_uk", "plate_us", "plate_eu", "id_vin", "id_claim_ref"),
    "personal_attributes": ("age", "gender", "nationality", "religion"),
    "person_names": ("person_name",),
    "uuids": ("uuid",),
    "keyword_identifiers": ("generic_identifier", "generic_identifier_unquoted"),
}


KEYWORD = "\x00"  # stands for keywords in the common regex of several detectors


def foreign_secrets(
    keywords: Mapping[str, Sequence[str]] = w.FOREIGN_SECRET_WORDS,
) -> tuple[Detector, ...]:
    """Secret keywords of other languages: one bare and one quoted detector per language.

    The bare form runs first, as its priority is lower.
    """
    made: list[Detector] = []
    for quoted in (False, True):
        for lang, listed in keywords.items():
            key = any_word(listed)
            tail = r"\s*[\"'])([^\"']{4,})(?=[\"'])" if quoted else r"\s*)([^\s\"']{4,})"
            made.append(Detector(
                f"i18n_secret_{lang}" if quoted else f"i18n_secret_unquoted_{lang}",
                "secret", rf"((?:{key})(?iu:{w.FOREIGN_LINK}){tail}", "REDACTED_SECRET_{n}",
                41 if quoted else 40, "high", 1, 2, ("not_redacted",),
                literals=fewest(k.lower() for k in listed),
                gate="quote" if quoted else None, languages=(lang,),
                keywords=tuple(k.lower() for k in listed),
                around=rf"(({KEYWORD})(?iu:{w.FOREIGN_LINK}){tail}",
            ))
    return tuple(made)


def custom_words(words: Iterable[str]) -> tuple[Detector, ...]:
    """The caller's own words, literal and case-insensitive, ahead of everything else."""
    listed = [x for x in words if x and x.strip()]
    if not listed:
        return ()
    return (Detector(
        "custom_word", "custom", "(?:" + "|".join(_escape(x) for x in listed) + ")",
        "CUSTOM_{n}", -20, "high", ignore_case=True,
        literals=fewest(x.lower() for x in listed), allowable=False,
    ),)


def custom_pattern(name: str, regex: str, ignore_case: bool = False) -> Detector:
    """A caller's regex from a list ``{name, regex, caseInsensitive}``, ahead of built-ins."""
    prefix = re.sub(r"[^A-Z0-9]", "_", (name or "PATTERN").upper())
    return Detector(name, f"cp_{prefix}", regex, prefix + "_{n}", -10, "high",
                    ignore_case=ignore_case)


def custom_detector(name: str, regex: str, template: str = "REDACTED_{name}_{n}",
                    priority: int = 80, **options) -> Detector:
    """A caller's detector with its own template and priority."""
    return Detector(name, options.pop("category", name), regex, template.replace("{name}", name),
                    priority, **options)


def _escape(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}&~#-])", r"\\\1", text)


def ordered(detectors: Iterable[Detector]) -> list[Detector]:
    """Run order: by priority, ties in the order given."""
    return sorted(detectors, key=lambda d: d.priority)


def enabled(detectors: Iterable[Detector], groups: Mapping[str, bool] | None) -> list[Detector]:
    """Drop detectors of switched-off groups before any plan is built.

    A category outside every group cannot be switched off.
    """
    groups = groups or {}
    return [d for d in detectors if groups.get(d.group, True)]


def by_name(*names: str, given: Iterable[Detector] = BUILT_IN) -> list[Detector]:
    index = {d.name: d for d in given}
    return [index[n] for n in names]


def without_gates(d: Detector) -> Detector:
    """The same detector with no prefilter, to test that prefilters lose nothing."""
    return replace(d, literals=(), gate=None)
