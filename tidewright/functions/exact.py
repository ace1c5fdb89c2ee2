"""Exact numbers of any length, as text: comparison without decimals' 38 digits, and without doubles.

A number is text of the grammar -?digits[.digits], as the number rules leave it. Its order key is text whose
byte order is the order of the numbers, equal for 2.5 and 2.50: a sign, the length of the whole part and the digits,
for negative numbers each digit's complement to nine and an end mark above all digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = r"^-?[0-9]+(\.[0-9]+)?$"
_SHORT = 11  # characters that decimal(38,10) holds whatever they are


def order_key(number: Column) -> Column:
    """Text that sorts as the number does; null for what is no number."""
    body = F.regexp_replace(number, "^-?0*", "")
    fraction = F.rtrim(F.when(body.contains("."), F.substring_index(body, ".", -1)).otherwise(""), F.lit("0"))
    whole = F.substring_index(body, ".", 1)
    size = F.concat(F.lpad(F.length(whole).cast("string"), 4, "0"), whole, fraction)
    negative = F.concat(F.lit("0"), F.translate(size, "0123456789", "9876543210"), F.lit("~"))
    key = F.when((whole == "") & (fraction == ""), "1").when(number.startswith("-"), negative).otherwise(F.concat(F.lit("2"), size))
    return F.when(number.rlike(_PLAIN), key)


def _by(left: Column, right: Column, test) -> Column:
    short = (F.length(left) <= _SHORT) & (F.length(right) <= _SHORT)
    return F.when(short, test(left.try_cast("decimal(38,10)"), right.try_cast("decimal(38,10)"))).otherwise(test(order_key(left), order_key(right)))


def less(left: Column, right: Column) -> Column:
    """left < right, exactly, of two parsed numbers; unknown where one is null. Short texts are compared as decimals."""
    return _by(left, right, lambda a, b: a < b)


def same(left: Column, right: Column) -> Column:
    """Equal as numbers, whatever their scales, of two parsed numbers; unknown where one is null."""
    return _by(left, right, lambda a, b: a == b)


def is_negative(number: Column) -> Column:
    """Below zero; -0.00 is not."""
    return number.rlike(r"^-.*[1-9]")


def plain(number: Column) -> Column:
    """The shortest text of the same number: no zeros before it or behind its fraction, no sign of zero."""
    body = F.regexp_replace(number, r"^-?0+(?=[0-9])|^-", "")
    short = F.when(body.contains("."), F.rtrim(F.rtrim(body, F.lit("0")), F.lit("."))).otherwise(body)
    return F.when(number.rlike(_PLAIN), F.when(number.startswith("-") & (short != "0"), F.concat(F.lit("-"), short)).otherwise(short))
