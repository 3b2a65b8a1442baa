"""Text coercions with the legacy job's results, as plain column expressions.

NULL stands for "not a number": in Spark NaN sorts above every number, so it must
never reach a comparison.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEADING_INTEGER = r"^\s*([+-]?[0-9]+)"
LEADING_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
# Every digit of an amount that fits 64 bits counts; larger ones are refused.
AMOUNT = "decimal(38,18)"
BLANK = " \t\n\x0b\f\r"


def leading_int(text: Column) -> Column:
    """Whole number a text starts with: ``'12.5'`` and ``'12abc'`` give 12, ``''`` NULL."""
    return F.regexp_extract(text, LEADING_INTEGER, 1).try_cast("bigint")


def leading_number(text: Column) -> Column:
    """Decimal a text starts with: ``'12.5x'`` gives 12.5, ``'x'`` NULL."""
    return F.regexp_extract(text, LEADING_NUMBER, 1).try_cast(AMOUNT)


def whole_number(text: Column) -> Column:
    """The whole text as a decimal: missing and blank give 0, ``'12abc'`` NULL."""
    blank = text.isNull() | (F.btrim(text, F.lit(BLANK)) == "")
    return F.when(blank, F.lit(0).cast(AMOUNT)).otherwise(text.try_cast(AMOUNT))


def round_half_up(amount: Column) -> Column:
    """Round halves towards plus infinity: -0.5 gives 0, 0.5 gives 1."""
    return F.floor(amount + F.lit(0.5).cast("decimal(2,1)")).cast("bigint")


def has_text(text: Column) -> Column:
    """True for a non-empty text, never NULL."""
    return F.coalesce(text != "", F.lit(False))


def join_skipping_nulls(*parts: Column) -> Column:
    """Concatenation that treats NULL as empty."""
    return F.concat_ws("", *parts)


def canonical(*values: Column) -> Column:
    """One text for several values, different for different ones: each as ``length:text``, NULL as ``-``."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.concat(*parts)


def contains(text: Column, mark: str) -> Column:
    return F.instr(text, mark) > 0


def ending_at(text: Column, mark: str, length: int) -> Column:
    """Up to ``length`` characters of ``text`` that end at the first ``mark``."""
    return F.right(F.left(text, F.instr(text, mark)), F.lit(length))


def zero_to_null(number: Column) -> Column:
    return F.nullif(number, F.lit(0))


def lenient_date(text: Column) -> Column:
    """``2011-1-5`` is a date; blank or impossible texts are NULL."""
    return F.try_to_date(text, "y-M-d")


def fraction_of(text: Column) -> Column:
    """The number that ``0.`` and what follows the first decimal point begin with, 0 without a point: ``5.99999`` gives
    0.99999, ``5.5x`` 0.5, ``5.1.2`` 0.1 and ``5.`` 0."""
    after = F.concat(F.lit("0."), F.split_part(text, F.lit("."), F.lit(2)))
    return F.when(contains(text, "."), leading_number(after)).otherwise(F.lit(0).cast(AMOUNT))
