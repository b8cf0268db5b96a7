"""Text expressions: blank pages, token sets, previews, stable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the OID namespace of RFC 4122 name-based UUIDs, as hex
UUID_NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"


def is_not_blank(text: Column) -> Column:
    """True when the text has any character that is not Unicode white space."""
    return text.rlike(r"(?U)\S")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def name_uuid(name: Column) -> Column:
    """Version-5 UUID of a name in the OID namespace, without leaving the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID_NAMESPACE_OID)), F.encode(name, "utf-8")))
    variant = F.lower(
        F.hex(
            F.conv(F.substring(digest, 17, 1), 16, 10)
            .cast("int")
            .bitwiseAND(F.lit(3))
            .bitwiseOR(F.lit(8))
        )
    )
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def stable_id(*parts: Column) -> Column:
    """Reproducible row id: a retried task writes the same id again.

    A null part differs from an empty one and keeps its place.
    """
    marked = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    digest = F.sha2(F.concat_ws("\u0001", *marked), 256)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.substring(digest, 13, 4),
        F.substring(digest, 17, 4),
        F.substring(digest, 21, 12),
    )


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens; anything but letters and digits separates them."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def preview(text: Column, width: int = 100) -> Column:
    """One-line preview of long text; short text is returned untouched."""
    head = F.translate(F.substring(text, 1, width), "\n", " ")
    return F.when(F.length(text) > width, F.concat(head, F.lit("..."))).otherwise(text)


def json_text_or_null(value: Column) -> Column:
    """JSON with explicit nulls."""
    return F.to_json(value, {"ignoreNullFields": "false"})
