"""Decimal quantities with suffixes, and plain number text, as column expressions."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, functions as F

# Decimal suffixes with their powers of ten.
DECIMAL_SUFFIXES = {"n": -9, "u": -6, "m": -3, "k": 3, "M": 6, "G": 9, "T": 12, "P": 15, "E": 18}

# Binary suffixes with their powers of two.
BINARY_SUFFIXES = {"Ki": 10, "Mi": 20, "Gi": 30, "Ti": 40, "Pi": 50, "Ei": 60}

# Fixed format: sign, digits, then either a suffix or an exponent.
QUANTITY_PATTERN = r"^([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))(?:([KMGTPE]i|[numkMGTPE])|[eE]([+-]?[0-9]+))?$"


# Units of duration texts in seconds.
DURATION_UNITS = {"ns": "1e-9", "us": "1e-6", "ms": "1e-3", "s": "1", "m": "60", "h": "3600"}


def duration_seconds(text: str) -> float | int:
    """Seconds of a duration text, e.g. 90 for ``1m30s``."""
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ns|us|ms|s|m|h)", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    total = sum(Decimal(n) * Decimal(DURATION_UNITS[u]) for n, u in parts)
    return int(total) if total == int(total) else float(total)


def quantity_number(text: str) -> Decimal:
    """The number of one quantity text, for configuration."""
    found = re.match(QUANTITY_PATTERN, text)
    if not found:
        raise ValueError(f"not a quantity: {text!r}")
    number, suffix, exponent = found.groups()
    if suffix in BINARY_SUFFIXES:
        return Decimal(number) * 2 ** BINARY_SUFFIXES[suffix]
    return Decimal(number).scaleb(int(exponent) if exponent else DECIMAL_SUFFIXES.get(suffix, 0))


def parse_quantity(text: Column) -> Column:
    """Quantity text to decimal(38,9); NULL where the text is not a quantity.

    Digits finer than a billionth round away from zero.
    """
    number = F.regexp_extract(text, QUANTITY_PATTERN, 1)
    suffix = F.regexp_extract(text, QUANTITY_PATTERN, 2)
    exponent = F.regexp_extract(text, QUANTITY_PATTERN, 3)

    power = F.when(exponent != "", exponent)
    for name, ten in DECIMAL_SUFFIXES.items():
        power = power.when(suffix == name, F.lit(str(ten)))
    power = power.otherwise(F.lit("0"))
    exact = F.concat(number, F.lit("e"), power).try_cast("decimal(38,18)")
    up = F.ceil(F.abs(exact), F.lit(9))
    away = F.when(exact < 0, -up).otherwise(up)

    factor = F.lit(None).cast("decimal(19,0)")
    for name, two in BINARY_SUFFIXES.items():
        factor = F.when(suffix == name, F.lit(2**two).cast("decimal(19,0)")).otherwise(factor)
    # decimal(18,9) * decimal(19,0) is exactly decimal(38,9)
    binary = number.try_cast("decimal(18,9)") * factor

    return F.when(number == "", F.lit(None)).when(factor.isNotNull(), binary).otherwise(away).try_cast("decimal(38,9)")


def plain_text(value: Column) -> Column:
    """Shortest text of a double without an exponent, e.g. 1.0E-7 -> 0.0000001.

    Most values have no exponent to begin with and take the first, cheap branch.
    """
    signed = value.cast("double").cast("string")
    size = F.abs(value.cast("double"))
    text = size.cast("string")
    # the JVM now and then prints a 17th digit that the number does not need
    sixteen = F.format_string("%.15E", size)
    text = F.when((F.length(text) >= 18) & (sixteen.try_cast("double") == size), sixteen).otherwise(text)
    sign = F.when(signed.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    # d.dddE<n>: one digit before the point
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    digits = F.rtrim(F.replace(F.substring_index(text, "E", 1), F.lit("."), F.lit("")), F.lit("0"))
    zeros = F.lit("0")
    moved = (
        F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(zeros, -exponent - 1), digits))
        .when(F.length(digits) <= exponent + 1, F.rpad(digits, exponent + 1, zeros))
        .otherwise(
            F.concat(
                F.substring(digits, F.lit(1), exponent + 1),
                F.lit("."),
                F.substring(digits, exponent + 2, F.length(digits)),
            )
        )
    )
    plain = (
        F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.length(text) - 2))
        .when(~text.contains("E"), text)
        .otherwise(moved)
    )
    return F.when(text.isin("NaN", "Infinity"), signed).otherwise(F.concat(sign, plain))
