"""Checks of matched strings: Luhn, IPv6 structure, CPF digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn(text: Column) -> Column:
    """13 to 19 digits, separators ignored, whose Luhn sum is a multiple of ten."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def ipv6(text: Column) -> Column:
    """Two colons or more, and no group of over four characters."""
    return (F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit(""))) >= 2) & F.forall(F.split(text, ":"), lambda g: F.length(g) <= 4)


def cpf(text: Column) -> Column:
    """Eleven digits, not all equal, with both modulo-11 check digits right."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    at = lambda i: F.substring(digits, i, 1).cast("int")

    def check(n: int) -> Column:
        total = sum(((n + 1 - i) * at(i + 1) for i in range(n)), F.lit(0))
        return F.when(total % 11 < 2, 0).otherwise(11 - total % 11)

    return (F.length(digits) == 11) & ~digits.rlike(r"^(\d)\1{10}$") & (at(10) == check(9)) & (at(11) == check(10))


BY_NAME = {"luhn": luhn, "ipv6": ipv6, "cpf": cpf}
