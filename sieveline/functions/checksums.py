"""Checksums and small hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplication in the dihedral group of order ten, and the
#: permutation that the Verhoeff scheme repeats.
VERHOEFF_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _dihedral(a: int, b: int) -> int:
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def _permutations() -> list[list[int]]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([VERHOEFF_PERMUTATION[x] for x in rows[-1]])
    return rows


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Luhn check of the digits; fewer than eight fail."""
    digits = digits_of(value)
    return (F.length(digits) >= 8) & F.call_function("luhn_check", digits)


def verhoeff(value: Column) -> Column:
    """Verhoeff check of exactly twelve digits."""
    digits = F.split(F.reverse(digits_of(value)), "")
    table = F.array(*[F.lit(_dihedral(a, b)) for a in range(10) for b in range(10)])
    permuted = F.array(*[F.lit(x) for row in _permutations() for x in row])
    at = F.transform(digits, lambda d, i: F.element_at(permuted, (i % 8) * 10 + d.cast("int") + 1))
    return F.when(F.length(digits_of(value)) == 12, F.aggregate(at, F.lit(0), lambda c, x: F.element_at(table, c * 10 + x + 1)) == 0).otherwise(False)


def mod97(value: Column) -> Column:
    """ISO 7064 MOD 97-10 of an account number with its check digits in front."""
    plain = F.upper(F.regexp_replace(value, r"\s", ""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    codes = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.cast("int")))
    rest = F.aggregate(codes, F.lit(0), lambda r, x: F.pmod(r * F.when(x > 9, 100).otherwise(10) + x, F.lit(97)))
    return F.when(F.length(plain) >= 5, F.coalesce(rest == 1, F.lit(False))).otherwise(False)


def polynomial_hash(value: Column) -> Column:
    """The 31-polynomial over code points in 32 bits, unsigned, base 36."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, x: F.pmod(acc * 31 + x, F.lit(2**32)))
    return F.lower(F.conv(h.cast("string"), 10, 36))
