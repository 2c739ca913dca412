"""Column functions on text. Lengths are UTF-8 bytes where a limit or an offset is meant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The longest slug and the forms of links and tags.
SLUG_MOST = 80
WIKILINK = r"!?\[\[([^\]|\n]+?)(?:\|([^\]\n]+))?\]\]"
TAG = r"(?U)(?:^|\s)#([\p{L}][\w/-]*)"
# Entities in the order in which they are replaced.
MARKUP_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def ascii_fold(c: Column) -> Column:
    """Lower case for A-Z only, as a case-insensitive match on ASCII compares."""
    return F.translate(c, UPPER, LOWER)


def slugify(c: Column) -> Column:
    """ASCII letters and digits in lower case, other runs as one hyphen; more than 80 characters end in a hash."""
    plain = F.regexp_replace(F.regexp_replace(ascii_fold(c), "[^a-z0-9]+", "-"), "^-|-$", "")
    cut = F.concat(F.regexp_replace(F.substring(plain, 1, SLUG_MOST), "-$", ""), F.lit("-"), F.substring(F.md5(c), 1, 8))
    return F.when(F.length(plain) > SLUG_MOST, cut).otherwise(plain)


def display_name(c: Column) -> Column:
    """ALL-CAPS names word by word in capitals and small letters, others trimmed."""
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    caps = trimmed.rlike(r"\p{Lu}") & ~trimmed.rlike(r"\p{Ll}")
    return F.when(caps, F.initcap(F.lower(F.regexp_replace(trimmed, r"(?U)\s+", " ")))).otherwise(trimmed)


def normalize_alias(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", ""))


def byte_prefix(c: Column, n: int) -> Column:
    """The first n bytes, without a character that they cut."""
    cut = F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(c) > n, F.regexp_replace(cut, "\\x{FFFD}$", "")).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.floor(F.octet_length(c) / 4).cast("int")


def wikilink_targets(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(WIKILINK), 1), lambda x: F.trim(x))


def tags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TAG), 1)


def strip_markup(c: Column) -> Column:
    """Tags become line ends; six entities are unescaped, in order. What scripts and styles contain stays."""
    out = F.regexp_replace(c, r"(?s)<[^>]+>", "\n")
    for entity, plain in MARKUP_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def fingerprint(title: Column, texts: Column) -> Column:
    """SHA-256 of the title and each text, every one ended by U+0001."""
    return F.sha2(F.concat(F.array_join(F.concat(F.array(title), texts), "\x01"), F.lit("\x01")), 256)


def chrome_key(c: Column) -> Column:
    """A line in the form in which running heads are compared: digits as #, ASCII lower case."""
    return ascii_fold(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\d+", "#"))


def heading_score(c: Column, taller: Column) -> Column:
    """How much a single line looks like a heading; 4 or more makes one."""
    line = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    letters = line.rlike(r"\p{L}")
    caps = ~line.rlike(r"[\p{L}&&[^\p{Lu}]]")
    title = F.forall(F.split(line, r"(?U)\s+"), lambda w: ~w.rlike(r"^\P{L}*[\p{L}&&[^\p{Lu}]]"))
    short = (F.length(line) > 0) & (F.length(line) < 60)
    score = short.cast("int") + (~line.rlike("[.,;]$")).cast("int") + F.when(letters & (caps | title), 2).otherwise(0) + taller.cast("int")
    return F.when(F.length(line) > 0, score).otherwise(F.lit(0))


def frontmatter_list(json: Column, key: str) -> Column:
    """A key's value as a list: a list as it is, a scalar as the only item, else no items."""
    v = F.try_parse_json(json)
    many = F.try_variant_get(v, f"$.{key}", "array<string>")
    one = F.try_variant_get(v, f"$.{key}", "string")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def frontmatter_scalar(json: Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(json), f"$.{key}", "string")


def low_confidence(ocr_conf: Column, text: Column, least: float = 45.0, thin: int = 100) -> Column:
    """Recognised with little confidence, or native and almost empty."""
    return F.when(ocr_conf.isNotNull(), ocr_conf < least).otherwise(F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", "")) < thin)
