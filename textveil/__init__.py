"""Pseudonymise sensitive text at corpus scale on Spark, and restore it."""

from textveil.functions.detectors import (
    BUILT_IN, FAMILIES, Detector, by_name, custom_detector, custom_pattern, custom_words,
)
from textveil.functions.languages import detect_languages, keywords_for, secret_keywords
from textveil.operators.env import redact_env
from textveil.operators.scan import find_spans, resolve_overlaps
from textveil.plans.engine import Redaction, Veil

__all__ = [
    "BUILT_IN", "FAMILIES", "Detector", "Redaction", "Veil", "by_name", "custom_detector",
    "custom_pattern", "custom_words", "detect_languages", "find_spans", "keywords_for",
    "redact_env", "resolve_overlaps", "secret_keywords",
]
