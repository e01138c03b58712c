"""Scalar functions over columns: identity, digests, text folding, byte slices and accounting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Folds A-Z only; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The bytes [start, end) of a text, as text; null if they don't begin and end between characters."""
    return F.try_validate_utf8(F.substring(F.encode(text, "UTF-8"), start + 1, end - start).cast("string"))


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a byte offset: one more than the newlines before it."""
    before = F.substring(F.hex(F.encode(text, "UTF-8")), F.lit(1), offset * 2)
    return F.size(F.filter(F.transform(F.sequence(F.lit(0), F.greatest(offset, F.lit(1)) - 1), lambda i: F.substring(before, i * 2 + 1, F.lit(2))), lambda x: x == "0A")) + 1


def is_identity(text: Column, prefix: str) -> Column:
    """A strict typed identity: prefix and 32 lower-case hexadecimal digits."""
    return F.coalesce(text.rlike(f"^{prefix}_[0-9a-f]{{32}}\\z"), F.lit(False))


def fact_bytes(subject: Column, predicate: Column, value: Column, links: Column) -> Column:
    """Accounted size of a fact in an answer."""
    return F.lit(192) + F.octet_length(subject) + F.octet_length(predicate) + F.octet_length(value) + 16 * links


def canonical_map(entries: Column) -> Column:
    """A map as JSON with keys in byte order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def effective_support(recorded: Column, visible: Column, revoked: Column, last_revoked: Column) -> Column:
    """Support of a claim from its visible citations; the order of the cases decides."""
    return (
        F.when(recorded == "unsupported", "recorded_unsupported")
        .when(visible == 0, "no_visible_citation")
        .when(visible == revoked, F.concat(F.lit("revoked@"), last_revoked.cast("string")))
        .otherwise("as_recorded")
    )


def freshness(kind: Column, retrieved: Column, evaluated: Column, max_age: Column) -> Column:
    """Fresh, stale with its age in seconds, or unknown if evaluated before retrieval."""
    age = evaluated - retrieved
    return F.when(evaluated < retrieved, "unknown").when(kind == "pinned", "fresh").when(age > max_age, F.concat(F.lit("stale:"), age.cast("string"))).otherwise("fresh")


def status_at(status: Column, status_revision: Column, revision: int) -> Column:
    """A terminal status holds from its revision on; before it the claim is active."""
    return F.when(status_revision.isNotNull() & (status_revision <= revision), status).otherwise("active")
