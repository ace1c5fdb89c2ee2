"""Source and mapping contracts as data; validate_rows compiles a source contract to columns."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FieldSpec:
    name: str
    header: str
    type: str = "TEXT"
    normalizers: tuple[str, ...] = ("trim", "blankToNull")
    validators: tuple[str, ...] = ()
    required: bool = False
    ignore_invalid: bool = False


@dataclass(frozen=True)
class RowRule:
    """left must not be below (>=) or above (<=) right, where both passed."""

    left: str
    op: str
    right: str


@dataclass(frozen=True)
class SourceContract:
    name: str
    fields: tuple[FieldSpec, ...]
    rules: tuple[RowRule, ...] = ()
    duplicate_key: str | None = None
    max_bytes: int = 10_485_760


@dataclass(frozen=True)
class MappingContract:
    """target column -> source field; constants are added as they are."""

    table: str
    columns: dict[str, str]
    constants: dict[str, str] = field(default_factory=dict)


_NUMBER = ("trim", "blankToNull", "normalizeGroupedNumber")
_PRICE = {"type": "DECIMAL", "normalizers": _NUMBER, "validators": ("nonNegative",)}
_COUNT = {"type": "INTEGER", "normalizers": _NUMBER, "validators": ("nonNegative",)}

# The daily exchange file and where its fields go.
DAILY_CSV = SourceContract(
    "daily-csv",
    (
        FieldSpec("security_code", "Security_cd"),
        FieldSpec("isin", "ISIN No.", normalizers=("trim", "blankToNull", "uppercase"), required=True),
        FieldSpec("open_price", "Open Price", **_PRICE),
        FieldSpec("high_price", "High Price", **_PRICE),
        FieldSpec("low_price", "Low Price", **_PRICE),
        FieldSpec("close_price", "Close Price", **_PRICE),
        FieldSpec("traded_volume", "Total Traded Volume", **_COUNT),
        FieldSpec("number_of_trades", "Number of Trades", **_COUNT),
        FieldSpec("turnover", "Total Turnover", **_PRICE),
        FieldSpec("face_value", "FACE VALUE", **_PRICE),
        FieldSpec("coupon_rate", "COUP0N (%)", "PERCENT", ("trim", "blankToNull", "stripTrailingPercent", "normalizeGroupedNumber", "zeroToNull"), ("nonNegative",), ignore_invalid=True),
    ),
    (
        RowRule("high_price", ">=", "low_price"),
        RowRule("open_price", ">=", "low_price"),
        RowRule("open_price", "<=", "high_price"),
        RowRule("close_price", ">=", "low_price"),
        RowRule("close_price", "<=", "high_price"),
    ),
    "isin",
)
DAILY_SUMMARY = MappingContract("daily_summary", {f.name: f.name for f in DAILY_CSV.fields if f.name != "coupon_rate"})
DAILY_COUPON = MappingContract("coupon", {"isin": "isin", "coupon_rate_value": "coupon_rate"}, {"coupon_rate_unit": "PERCENT"})
