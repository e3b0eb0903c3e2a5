"""Base64 and percent decoding as lenient as the clients that the policies guard against."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import BASE64_RUN

#: Shortest decoded text that is scanned, less one.
MIN_DECODED = 8


def base64_text(candidate: Column) -> Column:
    r"""The text of a base64 candidate, or null.

    Characters outside the alphabet are skipped, padding is optional, and bytes that aren't UTF-8 go.  A
    candidate with a non-ASCII character, or one whose data can't be a whole number of bytes, has no text.  A
    ``=`` inside the data ends it.
    """
    data = F.regexp_replace(F.regexp_replace(candidate, r"[^A-Za-z0-9+/=]", ""), r"(?s)=.*", "")
    whole = F.when(candidate.rlike(r"\A\p{ASCII}*\z") & (F.length(data) % 4 != 1), data)
    padded = F.concat(whole, F.repeat(F.lit("="), F.pmod(-F.length(data), F.lit(4))))
    return F.regexp_replace(F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")), "�", "")


def printable(text: Column) -> Column:
    """No control, format, unassigned or separator character but the space."""
    return ~text.rlike(r"[\p{C}\p{Z}&&[^ ]]")


def percent_text(text: Column) -> Column:
    """Percent escapes decoded as UTF-8; ``+`` stays, and so does a percent sign that begins no escape."""
    kept = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(kept)


def candidates(text: Column) -> Column:
    """What may be base64: the text without space around it, then every long run of the alphabet."""
    trimmed = F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    return F.concat(F.array(trimmed), F.regexp_extract_all(text, F.lit(BASE64_RUN), F.lit(0)))


def decoded_parts(text: Column) -> Column:
    """The texts hidden in a text: of each candidate that decodes to a printable text of over MIN_DECODED characters, and the percent-decoded text if it differs."""
    plain = F.transform(candidates(text), base64_text)
    kept = F.filter(plain, lambda d: d.isNotNull() & (F.length(d) > MIN_DECODED) & printable(d) & (d != text))
    url = percent_text(text)
    return F.concat(kept, F.when(url.isNotNull() & (url != text), F.array(url)).otherwise(F.array().cast("array<string>")))


def scan_text(text: Column) -> Column:
    """The text and, if it hides anything, a space and what it hides, joined by spaces; decoding goes one level deep."""
    hidden = F.when(suspicious(text), decoded_parts(text))
    return F.when(F.size(hidden) > 0, F.concat_ws(" ", text, F.array_join(hidden, " "))).otherwise(text)


def suspicious(text: Column) -> Column:
    """A cheap test that no text fails which hides another: a percent sign, a long run, or nothing but base64."""
    return F.contains(text, F.lit("%")) | text.rlike(r"[A-Za-z0-9+/]{20}") | ~text.rlike(r"[^\p{ASCII}]") & (F.length(F.regexp_replace(text, r"[^A-Za-z0-9+/]", "")) > MIN_DECODED)
