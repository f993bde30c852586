"""Address and header-byte expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(part: Column) -> Column:
    """Decimal, octal (leading 0) or hexadecimal (leading 0x) text; null if it is none of these or far too large."""
    return (F.when(part.rlike("^[1-9][0-9]*$"), part.try_cast("bigint"))
            .when(part.rlike("^0+[0-7]{0,11}$"), F.conv(part, 8, 10).try_cast("bigint"))
            .when(part.rlike("^0[xX]0*[0-9A-Fa-f]{1,8}$"), F.conv(F.substring(part, 3, 1000), 16, 10).try_cast("bigint")))


def _classful(ip: Column) -> Column:
    """One to four numbers, the last of which fills the bytes left; white space ends the text."""
    parts = F.split(F.regexp_extract(ip, r"(?s)^([0-9A-Za-z.]+)(?:\s.*)?$", 1), r"\.")
    numbers = F.transform(parts, _number)
    front, last, n = F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(0))), F.element_at(numbers, -1), F.size(numbers)
    bytes_left = F.call_function("shiftleft", F.lit(1).cast("bigint"), (5 - n) * 8)
    whole = F.aggregate(front, F.lit(0).cast("bigint"), lambda a, x: F.when((x >= 0) & (x <= 255), a * 256 + x))
    return F.when((n <= 4) & (last < bytes_left), whole * bytes_left + last)


def ip_to_int(ip: Column) -> Column:
    """IPv4 text as an unsigned 32-bit number; anything else, and null, is 0.

    Four plain decimal numbers count if writing them out again gives the same text. The other
    forms of address text are parsed too: fewer numbers, octal and hexadecimal ones, and text
    behind white space.
    """
    cut = F.substring_index
    texts = [cut(ip, ".", 1), cut(cut(ip, ".", 2), ".", -1), cut(cut(ip, ".", -2), ".", 1), cut(ip, ".", -1)]
    a, b, c, d = octets = [t.try_cast("int").cast("bigint") for t in texts]
    same = F.concat_ws(".", *[o.cast("string") for o in octets]) == ip
    valid = same & (F.least(*octets) >= 0) & (F.greatest(*octets) <= 255)
    return F.when(valid, ((a * 256 + b) * 256 + c) * 256 + d).otherwise(F.coalesce(_classful(ip), F.lit(0).cast("bigint")))


def int_to_ip(number: Column) -> Column:
    shifted = [F.shiftright(number, bits).bitwiseAND(255) for bits in (24, 16, 8)]
    return F.concat_ws(".", *[o.cast("string") for o in (*shifted, number.bitwiseAND(255))])


def hex_int(digits: Column) -> Column:
    """Hexadecimal text as an integer."""
    return F.conv(digits, 16, 10).cast("int")


def hex_byte(digits: Column, offset: int) -> Column:
    """The byte at a 0-based `offset` of a hexadecimal dump."""
    return hex_int(F.substring(digits, 2 * offset + 1, 2))


def hex_ip(digits: Column, offset: int) -> Column:
    """The four bytes at `offset` of a hexadecimal dump as dotted text."""
    return F.concat_ws(".", *[hex_byte(digits, offset + i).cast("string") for i in range(4)])
