"""Cleaning, validation and masking as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed

# Whitespace as Unicode sees it; Java's and RE2's ``\s`` cover ASCII only.
WS = r"\s\p{Z}\x{85}\x0b"


def squeeze(text: Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def clean_text(text: Column) -> Column:
    """Straight quotes, single spaces, and only word characters, space and ``.,!?;:-'"()``."""
    straight = text
    for curly, plain in (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'")):
        straight = F.replace(straight, F.lit(curly), F.lit(plain))
    # a space by itself is no match, as nothing would change
    spaced = F.regexp_replace(straight, f"[{WS}&&[^ ]][{WS}]*| [{WS}]+", " ")
    kept = F.regexp_replace(spaced, r"""[^a-z\p{L}\p{N}_ .,!?;:\-'"()]+""", "")
    return F.coalesce(F.trim(kept), F.lit(""))


def sanitize_text(text: Column) -> Column:
    """Escape HTML, then drop script blocks, ``javascript:`` and inline handlers.

    Escaping runs first, so the tag patterns never match afterwards; the order is kept
    because stored values depend on it.
    """
    out = F.coalesce(text, F.lit(""))
    # HTML escapes, ampersand first.
    for char, escape in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        out = F.replace(out, F.lit(char), F.lit(escape))
    for pattern in (
        r"(?is)<script[^>]*>.*?</script>",
        r"(?is)<iframe[^>]*>.*?</iframe>",
        r"(?i)javascript:",
        rf"(?i)on[\p{{L}}\p{{N}}_]+[{WS}]*=",
    ):
        out = F.regexp_replace(out, pattern, "")
    return squeeze(out)


def sanitize_map(values: Column) -> Column:
    """`sanitize_text` on every value of a ``map<string,string>``."""
    return F.transform_values(values, lambda _, v: sanitize_text(v))


def sanitize_array(values: Column) -> Column:
    """`sanitize_text` on every element of an ``array<string>``."""
    return F.transform(values, sanitize_text)


def raw_words(text: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.regexp_extract_all(text, F.lit(f"[^{WS}]+"), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def letters(text: Column) -> Column:
    """Lower-cased runs of letters only."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Non-blank pieces between ``.``, ``!`` and ``?`` runs, trimmed."""
    return F.filter(
        F.transform(F.split(text, "[.!?]+"), lambda s: F.regexp_replace(s, f"^[{WS}]+|[{WS}]+$", "")),
        lambda s: s != "",
    )


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def phrase_count(text: Column, phrases: list[str]) -> Column:
    """Sum of non-overlapping occurrences of each phrase in the lower-cased text."""
    lowered = F.lower(text)
    total = F.lit(0)
    for phrase in phrases:
        total = total + occurrences(lowered, phrase)
    return total


def member_count(tokens: Column, vocabulary: list[str]) -> Column:
    """How many tokens belong to a vocabulary."""
    return F.size(F.filter(tokens, lambda t: t.isin(vocabulary)))


# -- validation ---------------------------------------------------------------------------

def valid_email(email: Column) -> Column:
    return email.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def valid_identifier(value: Column, longest: int = 100) -> Column:
    return value.rlike(r"^[a-zA-Z0-9_-]+$") & (F.length(value) <= longest)


def content_checks(text: Column, tokens: Column) -> dict[str, Column]:
    """Length verdict, share of common English words, and warning texts.

    ``tokens`` are the `raw_words` of the text, passed as a column so they are split once.
    """
    n_words, n_chars = F.size(tokens), F.length(text)
    bounds = (
        F.when(F.coalesce(n_chars, F.lit(0)) == 0, "content is required")
        .when(n_chars < 100, "fewer than 100 characters")
        .when(n_chars > 50000, "more than 50,000 characters")
        .when(n_words < 50, "fewer than 50 words")
        .when(n_words > 10000, "more than 10,000 words")
    )
    ratio = F.when(n_words > 0, member_count(F.transform(tokens, F.lower), fixed.COMMON_ENGLISH) / n_words).otherwise(0.0)
    warnings = F.array_compact(
        F.array(
            *[
                F.when(text.rlike("(?iU)" + p), F.lit("Suspicious pattern detected: " + p))
                for p in fixed.SUSPICIOUS_PATTERNS
            ],
            F.when(ratio < 0.05, F.lit("Content may not be in English")),
        )
    )
    return {"rejected": bounds, "english_ratio": ratio, "warnings": warnings}


# -- fingerprints and masking -------------------------------------------------------------

def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def salted_hash(value: Column, salt: Column) -> Column:
    return F.sha2(F.concat(salt, value.cast("string")), 256)


def matches_salted_hash(value: Column, salt: Column, stored: Column) -> Column:
    return salted_hash(value, salt) == stored


def mask_email(email: Column, placeholder: str = "anonymous@example.com") -> Column:
    local = F.substring_index(email, "@", 1)
    domain = F.substr(email, F.length(local) + F.lit(2))
    masked = F.when(F.length(local) <= 2, F.lit("**")).otherwise(
        F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("*"), F.length(local) - 2), F.right(local, F.lit(1)))
    )
    return F.when(F.contains(email, F.lit("@")), F.concat(masked, F.lit("@"), domain)).otherwise(placeholder)


def mask_ip(address: Column) -> Column:
    quads, groups = F.split(address, r"\."), F.split(address, ":")
    has_dot, has_colon = F.contains(address, F.lit(".")), F.contains(address, F.lit(":"))
    return (
        F.when(has_dot & ~has_colon & (F.size(quads) == 4), F.concat(F.concat_ws(".", F.slice(quads, 1, 3)), F.lit(".0")))
        .when(has_colon & (F.size(groups) >= 4), F.concat(F.concat_ws(":", F.slice(groups, 1, 4)), F.lit("::0")))
        .otherwise("0.0.0.0")
    )


def browser_family(agent: Column) -> Column:
    lowered = F.lower(agent)
    out = F.when(F.coalesce(agent, F.lit("")) == "", "Unknown")
    # Browser families, first match wins.
    for name in ("Chrome", "Firefox", "Safari", "Edge"):
        out = out.when(F.contains(lowered, F.lit(name.lower())), name)
    return out.otherwise("Other")


def pseudonym(user_id: Column, salt: str) -> Column:
    return F.concat(F.lit("User_"), F.left(F.sha2(F.concat(F.lit(salt), user_id.cast("string")), 256), F.lit(8)))


def normalize_path(path: Column) -> Column:
    """UUID and numeric path segments become ``{id}``."""
    uuid = r"(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    return F.regexp_replace(F.regexp_replace(path, uuid, "/{id}"), r"/\d+", "/{id}")


def profile_issues(lexical: Column, syntactic: Column, semantic: Column, total_words: Column, confidence: Column) -> Column:
    """Violated rules of a writing profile whose feature groups are maps."""
    missing = [
        F.when(F.coalesce(F.size(group), F.lit(0)) < 1, F.lit(f"Missing required field: {name}"))
        for name, group in (
            ("lexical_features", lexical),
            ("syntactic_features", syntactic),
            ("semantic_features", semantic),
        )
    ]
    return F.array_compact(
        F.array(
            *missing,
            F.when(total_words < 0, F.lit("Total words must be a non-negative integer")),
            F.when(~confidence.between(0, 100), F.lit("Confidence score must be between 0 and 100")),
        )
    )
