"""Text columns: blanks, hashes, ids, HTML, tags, slugs. Every function is Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points a JavaScript runtime trims and matches as blanks.
BLANK_CODES = (
    *range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)
BLANKS = "".join(map(chr, BLANK_CODES))
# The same set for a Java character class: ASCII blanks are looked up in a bit set, and one range
# test rules out most other characters before the full list is tried.
BLANK_CLASS = (
    r"\t\n\x0B\f\r [\x{A0}-\x{FEFF}&&[\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
)

# The noise blocks and the named entities that are cleaned, in this order.
NOISE_TAGS = ("script", "style", "noscript")
ENTITIES = (
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
)


def trim_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def blank_to_null(text: Column) -> Column:
    return F.nullif(trim_blanks(text), F.lit(""))


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{BLANK_CLASS}]+", " "))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), sha256_hex(text))


def stable_id(prefix: str, seed: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.left(sha256_hex(seed), F.lit(20)))


def utf16_length(text: Column) -> Column:
    """Number of UTF-16 code units; ``length`` would count code points."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def utf16_prefix(text: Column, units: int) -> Column:
    """The longest prefix of at most ``units`` UTF-16 code units (no pair is cut in half)."""
    plain = F.left(text, F.lit(units))
    fitting = F.array_max(
        F.filter(
            F.sequence(F.lit(0), F.lit(units)),
            lambda size: utf16_length(F.left(text, size)) <= units,
        )
    )
    return F.when(utf16_length(plain) <= units, plain).otherwise(F.left(text, fitting))


# --- HTML -------------------------------------------------------------------------


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def decode_entities(text: Column) -> Column:
    def decode(entities: tuple) -> Column:
        decoded = text
        for entity, char in entities:
            decoded = F.regexp_replace(decoded, f"(?i){entity}", char)
        return decoded

    # Decoding an ampersand can complete another entity, so the order is part of the result.
    # Most texts only hold ampersands; one look for the other names saves their passes.
    ampersand = tuple(pair for pair in ENTITIES if pair[0] == "&amp;")
    others = "|".join(pair[0][1:-1] for pair in ENTITIES if pair not in ampersand)
    return (
        F.when(~F.contains(text, F.lit("&")), text)
        .when(F.rlike(text, F.lit(f"(?i)&(?:amp;)*(?:{others});")), decode(ENTITIES))
        .otherwise(decode(ampersand))
    )


def html_text(html: Column) -> Column:
    body = html
    for tag in NOISE_TAGS:
        # A look-ahead and not \b: Java's \b takes accented letters for word characters.
        body = F.regexp_replace(body, rf"(?i)<{tag}(?![A-Za-z0-9_])[^>]*>[\s\S]*?</{tag}>", " ")
    return collapse_blanks(decode_entities(strip_tags(body)))


def html_title(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?i)<title[^>]*>([\s\S]*?)</title>", 1)
    return F.nullif(collapse_blanks(decode_entities(strip_tags(inner))), F.lit(""))


# --- JSON seeds -------------------------------------------------------------------

_CONTROL_CODES = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def seed_json(**fields: Column) -> Column:
    """Compact JSON with the given key order and nulls kept.

    Spark writes control characters with upper-case hex digits; ids are defined over
    lower-case ones, so those escapes are rewritten where they occur.
    """
    text = F.to_json(
        F.struct(*[column.alias(name) for name, column in fields.items()]),
        {"ignoreNullFields": "false"},
    )
    repaired = F.aggregate(
        F.array(*[F.lit(code) for code in _CONTROL_CODES]),
        text,
        lambda done, code: F.regexp_replace(
            done,
            F.concat(F.lit(r"(?<!\\)((?:\\\\)*)\\u00"), code),
            F.concat(F.lit(r"$1\\u00"), F.lower(code)),
        ),
    )
    return F.when(F.rlike(text, F.lit(r"\\u00[01][A-F]")), repaired).otherwise(text)


# --- tags -------------------------------------------------------------------------


def normalize_tags(tags: Column) -> Column:
    """Trim, drop blanks, keep the first of equal tags in order."""
    kept = F.filter(F.transform(tags, trim_blanks), lambda tag: tag != "")
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


# --- slugs ------------------------------------------------------------------------


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(trim_blanks(text)), f"[{BLANK_CLASS}]+", "-")
    safe = F.regexp_replace(dashed, r"[^\p{L}\p{N}._~-]+", "-")
    return F.regexp_replace(F.regexp_replace(safe, "-+", "-"), "^-|-$", "")


def slug_path(path: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(path, "/"), slug), lambda part: part != ""), "/")


def document_slug(path: Column, content_dir: Column) -> Column:
    inner = F.substring(path, F.length(content_dir) + 2, F.length(path))
    return slug_path(F.regexp_replace(inner, r"(?i)\.(md|mdoc)$", ""))


# --- privacy ----------------------------------------------------------------------


def privacy_level(level: Column) -> Column:
    from gleanflow.contract import DEFAULT_PRIVACY_LEVEL, PRIVACY_LEVELS

    return F.when(level.isin(*PRIVACY_LEVELS), level).otherwise(DEFAULT_PRIVACY_LEVEL)


def privacy(level: Column, allow: Column) -> Column:
    return F.struct(
        privacy_level(level).alias("level"),
        F.coalesce(allow, F.lit(False)).alias("allow_cloud_llm"),
    )
