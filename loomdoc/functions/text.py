"""Redaction, repair and extraction functions of texts, all native expressions.

Patterns carry (?U), so classes and word edges are Unicode's, and (?d) where only \\n may end a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order matters, each step sees what the one before left.
BEFORE_CARD = (
    (r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    (r"(?U)\bDE\d{2}\s?(?:\d{4}\s?){4}\d{2}\b", "[IBAN]"),
    (r"(?U)\b[A-Z]{2}\d{2}(?:\s?[A-Za-z0-9]){11,30}\b", "[IBAN]"),
)
CARD = r"(?U)\b(?:\d[ \-]?){13,19}\b"
PHONE = r"(?U)\b(?:\+49[\s\-]?|0)\d{2,5}[\s\-/]?\d{3,10}\b"
PHONE_MENDED = r"(?U)(?:\+49[\s\-]?|\b0)\d{2,5}[\s\-/]?\d{3,10}\b"
AFTER_CARD = (
    (r"(?U)\b\d{2}\s?\d{2}\s?\d{2}\s?[A-Z]\s?\d{3}\b", "[SV-NUMMER]"),
    (r"(?iU)\b(?:Steuer-?ID|Identifikationsnummer)\s*:?\s*\d[\d\s]{9,14}\d\b", "[STEUER-ID]"),
    (r"(?iU)\b(?:Konto-?Nr\.?|Kontonummer|Kundennummer|Aktenzeichen|Vertragsnummer)\s*:?\s*[\w\-/]+", "[KUNDEN-/KONTONUMMER]"),
    (r"(?U)\b\d{1,3}(?:[.,]\d{3})*,\d{2}\s?(?:€|EUR)\b", "[BETRAG]"),
    (r"(?U)\b\d{5}\s+[A-ZÄÖÜ][a-zäöüß\-]+(?:\s+[A-ZÄÖÜ][a-zäöüß\-]+)*\b", "[PLZ-ORT]"),
    (PHONE, "[TELEFON]"),
    (r"(?U)\b(?:Herrn?|Frau)\s+[A-ZÄÖÜ][\wÄÖÜäöüß\-]+(?:\s+[A-ZÄÖÜ][\wÄÖÜäöüß\-]+){0,2}", "[NAME]"),
    (r"(?iU)\b[A-ZÄÖÜ][\wÄÖÜäöüß\.\-]*(?:straße|strasse|str\.|weg|allee|platz|gasse)\s+\d+\s?[a-z]?\b", "[ADRESSE]"),
    (r"(?U)\b\d{9,}\b", "[NUMMER]"),
)
ISO_DATE = r"(?U)\b(\d{4}-\d{2}-\d{2})\b"
DMY_DATE = r"(?U)\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b"
SENDER = (
    r"(?imdU)^.*\b(?:GmbH|AG|KG|e\.\s?V\.|Jobcenter|Amt|Agentur für Arbeit|Bank|Versicherung|"
    r"Behörde|Finanzamt|Stadt(?:verwaltung)?|Gemeinde|Kanzlei)\b.*$"
)
NO_SENDER = "ABSENDER-PRUEFEN"
SHORT_TOKEN_SHARE, LEAST_TOKENS = 0.35, 20


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.greatest(F.call_function("instr", F.lit("0123456789"), c) - 1, F.lit(0)) * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def redact_cards(text: Column) -> Column:
    """Runs of 13 to 19 digits with a valid check digit; other runs stay. What lies between runs is kept as it is."""

    def one(before: Column, run: Column) -> Column:
        digits = F.regexp_replace(run, r"\D", "")
        return F.concat(before, F.when(run.isNull(), F.lit("")).when(luhn(digits), F.lit("[KREDITKARTE]")).otherwise(run))

    joined = lambda t, runs: F.when(F.size(runs) > 0, F.array_join(F.zip_with(F.split(t, CARD, -1), runs, one), "")).otherwise(t)
    return let(text, lambda t: let(F.regexp_extract_all(t, F.lit(CARD), F.lit(0)), lambda runs: joined(t, runs)))


def redact(text: Column, mended_phone: bool = False) -> Column:
    for pattern, label in BEFORE_CARD:
        text = F.regexp_replace(text, pattern, label)
    text = redact_cards(text)
    for pattern, label in AFTER_CARD:
        text = F.regexp_replace(text, PHONE_MENDED if mended_phone and pattern == PHONE else pattern, label)
    return text


def collapse_letter_spacing(text: Column) -> Column:
    """Runs of three or more marks with single blanks between them, without the blanks."""
    return F.regexp_replace(text, r"(?U) (?:(?<=\S )(?=\S \S)|(?<=\S \S )(?=\S))", "")


def is_garbled(text: Column) -> Column:
    """20 tokens or more, and over 35 % of them of one or two characters."""
    short = lambda tokens: F.size(F.filter(tokens, lambda t: F.char_length(t) <= 2))
    return let(F.array_remove(F.split(text, r"(?U)\s+"), ""), lambda t: (F.size(t) >= LEAST_TOKENS) & (short(t) / F.nullif(F.size(t), F.lit(0)) > SHORT_TOKEN_SHARE))


def find_date(text: Column) -> Column:
    """The first ISO date anywhere, else the first D.M.Y, as YYYY-MM-DD; not validated."""
    parts = F.split(F.regexp_extract(text, DMY_DATE, 0), r"\.")
    dmy = let(parts, lambda p: F.when(F.size(p) == 3, F.concat_ws("-", p[2], F.lpad(p[1], 2, "0"), F.lpad(p[0], 2, "0"))))
    return F.coalesce(F.nullif(F.regexp_extract(text, ISO_DATE, 1), F.lit("")), dmy)


def sender_hint(redacted: Column) -> Column:
    return F.nullif(F.substring(F.trim(F.regexp_extract(redacted, SENDER, 0)), 1, 80), F.lit(""))


def slug(hint: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.regexp_replace(hint, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""), F.lit(NO_SENDER))


def snippet(redacted: Column) -> Column:
    return F.substring(F.replace(F.regexp_replace(redacted, r"(?U)^\s+|\s+$", ""), F.lit("\n"), F.lit(" ")), 1, 400)


def variants(label: Column) -> Column:
    """Search terms of a document type: without brackets, split at /, trimmed of blanks and dashes, 3 characters or more."""
    parts = F.split(F.regexp_replace(label, r"\([^)]*\)", " "), "/")
    clean = F.transform(parts, lambda p: F.lower(F.trim(F.regexp_replace(F.trim(p), "^[-–—]+|[-–—]+$", ""))))
    return F.filter(clean, lambda p: F.char_length(p) >= 3)


def leaks(text: Column, forbidden: Column) -> Column:
    """The forbidden strings that are still there after redaction."""
    return let(redact(text), lambda cleaned: F.filter(forbidden, lambda v: F.contains(cleaned, v)))


def placeholders(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\{\{[^}]*\}\}"))
