"""Text normalisation, screening forms, injection codes and redaction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Patterns of instructions addressed to the reader's tooling.
INJECTION_PATTERNS: dict[str, str] = {
    "INSTRUCTION_OVERRIDE": r"\b(ignore|disregard|override|forget)\b.{0,50}\b(previous|prior|above|system|developer)\b.{0,30}\b(instruction|prompt|rule)s?\b",
    "INSTRUCTION_OVERRIDE_DE": r"\b(ignoriere|missachte|vergiss)\b.{0,50}\b(vorherigen?|bisherigen?|system)\b.{0,30}\b(anweisungen?|regeln?|prompt)\b",
    "INSTRUCTION_OVERRIDE_FR_ES_IT": r"\b(ignorez|oubliez|ignora|olvida|dimentica)\b.{0,55}\b(instructions?|instrucciones?|istruzioni|precedentes?|précédentes?)\b",
    "ROLE_HIJACK": r"\b(you are now|act as|developer message|system message|system prompt|maintenance mode)\b",
    "AUTHORIZATION_BYPASS": r"\b(auto[- ]?approve|skip validation|without validation|bypass.{0,25}(approval|review|policy)|disable.{0,25}(guardrail|security))\b",
    "SECRET_EXFILTRATION": r"\b(reveal|show|print|return|send|export|exfiltrate)\b.{0,60}\b(system prompt|secret|api key|token|password|customer database|all customers|other customers)\b",
    "TOOL_INJECTION": r"\b(call|invoke|run|execute)\b.{0,30}\b(tool|function|shell|sql|query)\b",
    "DELIMITER_BREAKOUT": r"</?\s*(system|assistant|developer|tool|untrusted)[^>]*>|\[/?\s*(system|assistant|developer|tool)\s*\]",
}
# The same intents with all separators removed.
COMPACT_NEEDLES: dict[str, str] = {
    "ignoreallpreviousinstructions": "OBFUSCATED_OVERRIDE",
    "ignorepreviousinstructions": "OBFUSCATED_OVERRIDE",
    "ignoriereallebisherigenanweisungen": "OBFUSCATED_OVERRIDE",
    "revealsystemprompt": "OBFUSCATED_EXFILTRATION",
    "sendallcustomerdata": "OBFUSCATED_EXFILTRATION",
    "bypassvalidation": "OBFUSCATED_BYPASS",
}
# Payload keys whose values never reach the log.
SENSITIVE_KEYS = (
    "api_key", "authorization", "body", "content", "cookie", "customer_data", "password", "prompt",
    "raw_email", "secret", "stack_trace", "token", "traceback",
)
SENSITIVE_MARKERS = ("password", "secret", "token", "authorization", "api_key")
EMAIL_PATTERN = r"(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w.-])"
BEARER_PATTERN = r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+"
LONG_TEXT = 512
MANY_LINES = 4

# Unicode classes and case folding, dot matches line ends, as the texts need.
_FLAGS = "(?isuU)"


def _nfkc():
    """The normaliser as a pandas UDF; nested so that workers need no package."""

    def normalize(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")

    return F.pandas_udf(normalize, "string")


def normalize_text(text: Column) -> Column:
    """NFKC and no NUL; plain ASCII rows never leave the JVM as text."""
    foreign = text.rlike(r"[^\x00-\x7F]")
    normalized = F.coalesce(_nfkc()(F.when(foreign, text)), text)
    return F.replace(normalized, F.lit("\u0000"), F.lit(""))


def collapsed_form(text: Column) -> Column:
    """Words separated by single spaces."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\W_]+", " "))


# Each pattern needs one of these words; a plain search for them is much cheaper
# than the pattern and settles most texts.
_NEEDED_WORDS: dict[str, tuple[str, ...]] = {
    "INSTRUCTION_OVERRIDE": ("ignore", "disregard", "override", "forget"),
    "INSTRUCTION_OVERRIDE_DE": ("ignoriere", "missachte", "vergiss"),
    "INSTRUCTION_OVERRIDE_FR_ES_IT": ("ignorez", "oubliez", "ignora", "olvida", "dimentica"),
    "ROLE_HIJACK": ("you are now", "act as", "message", "system prompt", "maintenance mode"),
    "AUTHORIZATION_BYPASS": ("approve", "validation", "bypass", "disable"),
    "SECRET_EXFILTRATION": (
        "system prompt", "secret", "api key", "token", "password", "customer database", "customers",
    ),
    "TOOL_INJECTION": ("tool", "function", "shell", "sql", "query"),
    "DELIMITER_BREAKOUT": ("system", "assistant", "developer", "tool", "untrusted"),
}


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def screening_forms(df: DataFrame, text: str) -> DataFrame:
    """Adds the letters-only form of a normalised text column, a folded twin, and its words where a pattern may match.

    Case-insensitive patterns take the dotless and the dotted capital i for an i,
    so the folded form does too.
    """
    letters = F.regexp_replace(F.col(text), "[^a-zA-ZÀ-ž]+", "")
    forms = df.withColumn("_letters", letters).select(
        *df.columns, F.lower("_letters").alias("_compact"), F.lower(F.translate("_letters", "İı", "ii")).alias("_folded")
    )
    words = sorted({w.replace(" ", "") for needed in _NEEDED_WORDS.values() for w in needed})
    return forms.withColumn("_spaced", F.when(_any_word(F.col("_folded"), tuple(words)), collapsed_form(F.col(text))))


def injection_codes(text: str) -> Column:
    """Sorted distinct codes; the frame must hold the forms of :func:`screening_forms`.

    A pattern can only match, on the text or on its words, where the letters of
    one of its needed words follow each other; other texts skip the pattern.
    """
    whole, spaced = F.col(text), F.col("_spaced")
    tests = []
    for code, pattern in INJECTION_PATTERNS.items():
        words = tuple(w.replace(" ", "") for w in _NEEDED_WORDS[code])
        full = _FLAGS + pattern
        tests.append(F.when(_any_word(F.col("_folded"), words) & (whole.rlike(full) | spaced.rlike(full)), code))
    for code in sorted(set(COMPACT_NEEDLES.values())):
        needles = tuple(n for n, owner in COMPACT_NEEDLES.items() if owner == code)
        tests.append(F.when(_any_word(F.col("_compact"), needles), code))
    return F.array_sort(F.array_compact(F.array(*tests)))


def sensitive_key(name: Column) -> Column:
    plain = F.replace(F.lower(name), F.lit("-"), F.lit("_"))
    hit = plain.isin(*SENSITIVE_KEYS)
    for marker in SENSITIVE_MARKERS:
        hit = hit | F.contains(plain, F.lit(marker))
    return F.coalesce(hit, F.lit(False))


def redact(name: Column, value: Column) -> Column:
    """Value of one payload key, safe for the standard log."""
    cleaned = F.regexp_replace(value, BEARER_PATTERN, "Bearer [REDACTED]")
    cleaned = F.regexp_replace(cleaned, "(?U)" + EMAIL_PATTERN, "[REDACTED_EMAIL]")
    lines = F.length(cleaned) - F.length(F.replace(cleaned, F.lit("\n"), F.lit("")))
    bulky = (F.length(cleaned) > LONG_TEXT) | (lines > MANY_LINES)
    marker = F.concat(F.lit("[REDACTED_TEXT sha256="), F.sha2(cleaned, 256), F.lit("]"))
    return F.when(sensitive_key(name), F.lit("[REDACTED]")).when(bulky, marker).otherwise(cleaned)


def redact_map(payload: Column) -> Column:
    return F.transform_values(payload, redact)
