"""The closed registry of named text rules, as column functions.

A normalizer maps a text column to (value, code): a null value means "no value", a code means the
text is rejected. Chains stop at the first rejection; nothing raises on dirty data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions import exact

Step = tuple[Column, Column]

# Error codes of fields and rows.
INVALID_NUMBER_GROUPING = "INVALID_NUMBER_GROUPING"
INVALID_DECIMAL = "INVALID_DECIMAL"
NOT_WHOLE_NUMBER = "NOT_WHOLE_NUMBER"
NEGATIVE_VALUE = "NEGATIVE_VALUE"
INVALID_DATE = "INVALID_DATE"
INVALID_TYPE = "INVALID_TYPE"
REQUIRED_VALUE_MISSING = "REQUIRED_VALUE_MISSING"
PRICE_INCONSISTENT = "PRICE_INCONSISTENT"
DUPLICATE_SUPERSEDED = "DUPLICATE_ISIN_SUPERSEDED"
CONFLICTING_COLLATERAL = "CONFLICTING_COLLATERAL_DATA"

# The grammar of numbers; a grouped number does not begin with a zero group.
_PLAIN = r"^-?[0-9]+(\.[0-9]+)?$"
_WESTERN = r"^-?[1-9][0-9]{0,2}(,[0-9]{3})+(\.[0-9]+)?$"
_INDIAN = r"^-?[1-9][0-9]?(,[0-9]{2})*,[0-9]{3}(\.[0-9]+)?$"
_GROUPED_SHAPE = r"^-?[0-9,]+(\.[0-9]+)?$"
# White space, without the no-break spaces.
_WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000"
_NO_CODE = "cast(null as string)"


def none() -> Column:
    return F.expr(_NO_CODE)


def strip(c: Column) -> Column:
    """Drop surrounding white space as Unicode defines it (a no-break space stays)."""
    return F.btrim(c, F.lit(_WHITE))


def trim(c: Column) -> Step:
    return strip(c), none()


def blank_to_null(c: Column) -> Step:
    return F.when(strip(c) != "", c), none()


def uppercase(c: Column) -> Step:
    return F.upper(c), none()


def normalize_grouped_number(c: Column) -> Step:
    """Ungrouped, Western or Indian grouping; other comma shapes are a grouping error."""
    good = c.rlike(_PLAIN) | c.rlike(_WESTERN) | c.rlike(_INDIAN)
    code = F.when(c.isNull() | good, none()).when(c.contains(",") & c.rlike(_GROUPED_SHAPE), INVALID_NUMBER_GROUPING).otherwise(INVALID_DECIMAL)
    return F.when(good, F.regexp_replace(c, ",", "")), code


def strip_trailing_percent(c: Column) -> Step:
    return F.regexp_replace(c, r"\p{javaWhitespace}*%$", ""), none()


def keep_before_first_percent(c: Column) -> Step:
    return strip(F.substring_index(c, "%", 1)), none()


def zero_to_null(c: Column) -> Step:
    return F.when(~c.rlike(r"^0+(\.0+)?$"), c), none()


NORMALIZERS: dict[str, Callable[[Column], Step]] = {
    "trim": trim,
    "blankToNull": blank_to_null,
    "uppercase": uppercase,
    "normalizeGroupedNumber": normalize_grouped_number,
    "stripTrailingPercent": strip_trailing_percent,
    "keepBeforeFirstPercent": keep_before_first_percent,
    "zeroToNull": zero_to_null,
}


def non_negative(number: Column) -> Column:
    """NEGATIVE_VALUE or null for an exact number's text; the number itself is kept by the caller."""
    return F.when(exact.is_negative(number), NEGATIVE_VALUE)


#: Validators read the exact text of a parsed number, of any length.
VALIDATORS: dict[str, Callable[[Column], Column]] = {"nonNegative": non_negative}


def _known(registry: dict, names: Sequence[str]) -> list:
    missing = [n for n in names if n not in registry]
    if missing:
        raise KeyError(f"unknown rules: {', '.join(missing)}")
    return [registry[n] for n in names]


def normalize(c: Column, names: Sequence[str]) -> Step:
    """Apply normalizers in order; after a rejection later ones see no value."""
    value, code = c, none()
    for rule in _known(NORMALIZERS, names):
        value, found = rule(value)
        code = F.coalesce(code, found)
    return F.when(code.isNull(), value), code


def validate(number: Column, names: Sequence[str]) -> Column:
    """All violations of the named validators, in order."""
    return F.array_compact(F.array(*(rule(number) for rule in _known(VALIDATORS, names)))) if names else F.expr("cast(array() as array<string>)")


def register_normalizer(name: str, rule: Callable[[Column], Step]) -> None:
    if name in NORMALIZERS:
        raise KeyError(f"rule exists: {name}")
    NORMALIZERS[name] = rule


def register_validator(name: str, rule: Callable[[Column], Column]) -> None:
    if name in VALIDATORS:
        raise KeyError(f"rule exists: {name}")
    VALIDATORS[name] = rule


def exact_decimal(c: Column) -> Step:
    """Exact decimal text of at most 1000 characters; exponents are not numbers here."""
    good = c.rlike(_PLAIN) & (F.length(c) <= 1000)
    return F.when(good, c), F.when(c.isNotNull() & ~good, INVALID_DECIMAL)


def whole_number(c: Column) -> Step:
    """14.00 is 14; 14.5 is NOT_WHOLE_NUMBER."""
    text, code = exact_decimal(c)
    fraction = text.rlike(r"\.0*[1-9]")
    return F.when(~fraction, F.regexp_replace(text, r"\..*$", "")), F.coalesce(code, F.when(fraction, NOT_WHOLE_NUMBER))


def strict_date(c: Column) -> Step:
    """DD-MM-YYYY or YYYY-MM-DD, a real day from 1900 on; the value is ISO text."""
    day_first = F.when(c.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_date(c, "dd-MM-yyyy"))
    day = F.coalesce(day_first, F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd")))
    good = F.year(day) >= 1900
    return F.when(good, F.date_format(day, "yyyy-MM-dd")), F.when(c.isNotNull() & ~F.coalesce(good, F.lit(False)), INVALID_DATE)


def trade_date(c: Column) -> Step:
    """An ISO day of the years 1900 to 9999, as the inputs of a run name it; the value is ISO text."""
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    good = F.coalesce(F.year(day).between(1900, 9999), F.lit(False))
    return F.when(good, F.date_format(day, "yyyy-MM-dd")), F.when(c.isNotNull() & ~good, INVALID_DATE)


def percent(c: Column) -> Step:
    """A decimal with at most 30 digits on each side."""
    text, code = exact_decimal(c)
    return F.when(text.rlike(r"^-?[0-9]{1,30}(\.[0-9]{1,30})?$"), text), F.coalesce(
        code, F.when(~text.rlike(r"^-?[0-9]{1,30}(\.[0-9]{1,30})?$"), INVALID_DECIMAL)
    )


def as_text(c: Column) -> Step:
    return c, none()


PARSERS: dict[str, Callable[[Column], Step]] = {"TEXT": as_text, "DECIMAL": exact_decimal, "INTEGER": whole_number, "DATE": strict_date, "PERCENT": percent}


def number(text: Column) -> Column:
    """Parsed text as decimal(38,10) for sums; text that does not fit is null. Rules compare the text itself (exact)."""
    return text.try_cast("decimal(38,10)")


def identity_text(c: Column) -> Column:
    """How security and exchange names are compared: stripped, upper case."""
    return F.upper(strip(c))


def preview(c: Column, limit: int = 1000) -> tuple[Column, Column]:
    """First code points of a raw value and whether it was cut."""
    return F.substring(c, 1, limit), F.char_length(c) > limit


def base_name(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)
