"""Money rules: whole minor units, one currency at a time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from revsync import vocab
from revsync.functions.text import trim_ws

# The leading number of a text: sign, digits with an optional point, optional exponent.
NUMBER_PREFIX = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_LONG_LIMIT = 9.2e18


def leading_number(text: Column) -> Column:
    """The number a text starts with ('12.5abc' is 12.5), null where there is none."""
    return F.regexp_extract(text, NUMBER_PREFIX, 1).try_cast("double")


def amount_to_minor(text: Column) -> Column:
    """Major units as text to minor units, half rounded up; null where it is no number.

    Binary floating point on purpose: a decimal would round some amounts differently.
    """
    scaled = leading_number(text) * 100
    return F.when(F.abs(scaled) < _LONG_LIMIT, F.floor(scaled + 0.5))


def normalize_currency(currency: Column) -> Column:
    return F.upper(trim_ws(currency))


def is_money(amount_minor: Column, currency: Column) -> Column:
    """A whole amount that is not negative, in a three-letter currency."""
    return F.coalesce((amount_minor >= 0) & _known_currency(currency), F.lit(False))


def _known_currency(currency: Column) -> Column:
    """Three letters once normalised; the plain case is seen without normalising."""
    plain = currency.rlike(r"^ *[A-Za-z]{3} *\z")
    return plain | normalize_currency(currency).rlike(vocab.CURRENCY_PATTERN)


def money_error(amount_minor: Column, currency: Column, missing: str = vocab.NULL) -> Column:
    """Why (amount, currency) is not money, or null. `missing` is what a missing amount is called."""
    return (
        F.when(amount_minor.isNull(), F.lit(vocab.AMOUNT_NOT_INTEGER % missing))
        .when(amount_minor < 0, F.format_string(vocab.AMOUNT_NEGATIVE, amount_minor.cast("string")))
        .when(
            ~F.coalesce(_known_currency(currency), F.lit(False)),
            F.format_string(vocab.CURRENCY_INVALID, F.coalesce(currency, F.lit(vocab.UNDEFINED))),
        )
    )


def to_major(amount_minor: Column) -> Column:
    return amount_minor.cast("double") / 100


def add_money(amount_minor: Column) -> Column:
    """Sum of amounts; only meaningful inside a group of one currency (see `sum_by_currency`)."""
    return F.sum(amount_minor)
