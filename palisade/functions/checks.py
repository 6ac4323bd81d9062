"""Checksums, entropy and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """13 to 19 digits with a right check digit."""
    return F.coalesce(F.when(c.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", c)), F.lit(False))


def iban(c: Column) -> Column:
    """15 to 34 letters and digits whose number, with the first four moved to the end, leaves 1 modulo 97."""
    s = F.upper(F.regexp_replace(c, "[\\s-]", ""))
    turned = F.split(F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4)), "")

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code >= 65, (acc * 100 + (code - 55)) % 97).otherwise((acc * 10 + (code - 48)) % 97)

    rest = F.aggregate(F.filter(turned, lambda x: x != ""), F.lit(0), step)
    return F.coalesce(F.when(F.length(s).between(15, 34), rest == 1), F.lit(False))


def entropy(c: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty or null string.

    The terms are added in the order in which the characters first occur.
    """
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.length(c).cast("double")

    def step(acc: Column, ch: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == ch)).cast("double") / n
        return acc - p * F.log2(p)

    return F.coalesce(F.when(F.length(c) > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), step)), F.lit(0.0))


def same_digit(c: Column, low: int, high: int | str = "") -> Column:
    return c.rlike(f"^([0-9])\\1{{{low},{high}}}$")


def mask_email(c: Column) -> Column:
    """First letter of the name and everything from the domain's first dot."""
    at = F.instr(c, "@")
    domain = F.substr(c, at + 1)
    tail = F.when(F.instr(domain, ".") > 0, F.substr(domain, F.instr(domain, "."))).otherwise("")
    return F.when(at <= 2, "[EMAIL_REDACTED]").otherwise(F.concat(F.left(c, F.lit(1)), F.lit("***@***"), tail))


def mask_phone(c: Column) -> Column:
    d = digits_of(c)
    return F.when(F.length(d) < 4, "[PHONE_REDACTED]").otherwise(F.concat(F.lit("***-***-"), F.right(d, F.lit(2))))
