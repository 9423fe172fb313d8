"""Content identities, reference keys and field validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_CODE_POINTS, SUMMARY_CODE_POINTS, OPAQUE_CODE_POINTS = 128, 4096, 512


def content_id(content: Column) -> Column:
    """The name-based (MD5, version 3) UUID of a text's UTF-8."""
    h = F.md5(content.cast("binary"))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def reference_key(*parts: Column) -> Column:
    """One string of an address; parts are escaped, null is an empty part."""
    return F.concat_ws("/", *(F.coalesce(F.replace(F.replace(p.cast("string"), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")), F.lit("")) for p in parts))


def reference_parts(key: Column, names: list[str]) -> Column:
    """The struct of reference_key()'s parts; an empty part is null."""
    p = F.split(key, "/", -1)
    get = lambda k: F.nullif(F.replace(F.replace(F.get(p, F.lit(k)), F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%")), F.lit(""))
    return F.struct(*(get(k).alias(n) for k, n in enumerate(names)))


def valid_text(value: Column, longest: int) -> Column:
    """Not empty, no longer than that many code points, no control characters, no white space at either end."""
    edge = r"^[\s\x{85}\x{A0}]|[\s\x{85}\x{A0}]$"
    return F.coalesce((value != "") & (F.char_length(value) <= longest) & ~value.rlike(r"\p{Cc}") & ~value.rlike(edge), F.lit(False))


def valid_identifier(value: Column) -> Column:
    return valid_text(value, ID_CODE_POINTS)


def valid_opaque(value: Column) -> Column:
    return valid_text(value, OPAQUE_CODE_POINTS)


def valid_summary(value: Column) -> Column:
    """As valid_text, but line feeds and tabs may occur inside."""
    edge = r"^[\s\x{85}\x{A0}]|[\s\x{85}\x{A0}]$"
    return F.coalesce((value != "") & (F.char_length(value) <= SUMMARY_CODE_POINTS) & ~F.regexp_replace(value, r"[\n\t]", "").rlike(r"\p{Cc}") & ~value.rlike(edge), F.lit(False))
