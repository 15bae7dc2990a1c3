"""Column expressions: usable in select, filter, SQL-free and streaming-safe."""

from incognita.functions.fakes import GENERATORS, digest, fake, generate, register_type
from incognita.functions.names import context_score, normalize_name, preview, score_band
from incognita.functions.preserve import PreserveRules, parse_rules, should_preserve
from incognita.functions.text import (
    detect_value,
    find_all,
    planned_replacements,
    pseudonymize_text,
    redact_document,
)

__all__ = [
    "GENERATORS",
    "PreserveRules",
    "context_score",
    "detect_value",
    "digest",
    "fake",
    "find_all",
    "generate",
    "normalize_name",
    "parse_rules",
    "planned_replacements",
    "preview",
    "pseudonymize_text",
    "redact_document",
    "register_type",
    "score_band",
    "should_preserve",
]
