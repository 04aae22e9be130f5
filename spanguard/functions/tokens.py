"""Token ids, token markup and seeds of a conversation's vault."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the digits of base 62, in order.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
TOKEN = r"<pii[^>]*>.*?</pii>"


def token_id(conversation: Column, ordinal: Column) -> Column:
    """Eight base-62 digits of the first six bytes of SHA-256(conversation:ordinal)."""
    number = F.conv(F.substring(F.sha2(F.concat_ws(":", conversation.cast("string"), ordinal.cast("string")), 256), 1, 12), 16, 10).cast("long")
    # Integer arithmetic: what is left above a digit is a multiple of its place value.
    place = [(number % F.lit(62 ** (i + 1)) - number % F.lit(62**i)) / F.lit(62**i) for i in range(7, -1, -1)]
    return F.concat(*[F.substring(F.lit(BASE62), p.cast("int") + 1, F.lit(1)) for p in place])


def markup(token: Column, display: Column) -> Column:
    return F.concat(F.lit('<pii id="'), token, F.lit('">'), display, F.lit("</pii>"))


def attribute_id(token: Column) -> Column:
    """The id attribute of a token; empty if there is none."""
    return F.regexp_extract(token, r'^<pii[^>]*\bid="([^"]*)"', 1)


def inner(token: Column) -> Column:
    """What stands between the first `>` and the last `</`."""
    return F.regexp_extract(token, r"(?s)^[^>]*>(.*)</", 1)


def vault_seed(conversation: Column) -> Column:
    """Unsigned 64-bit little-endian number of the first eight bytes of SHA-1(conversation), as decimal(20,0)."""
    h = F.sha1(conversation.cast("string"))
    swapped = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)])
    high, low = (F.conv(F.substring(swapped, p, 8), 16, 10).cast("decimal(20,0)") for p in (1, 9))
    return (high * F.lit(2**32).cast("decimal(20,0)") + low).cast("decimal(20,0)")


def fingerprint(role: Column, content: Column) -> Column:
    """SHA-1 of `role:content` of the first message; of nothing where there is none."""
    return F.when(role.isNull() & content.isNull(), F.sha1(F.lit(""))).otherwise(F.sha1(F.concat(F.coalesce(role, F.lit("")), F.lit(":"), F.coalesce(content, F.lit("")))))
