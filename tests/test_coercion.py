from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cartshift.functions import coercion


def evaluate(rows, function, values):
    df = rows("i int, t string", *enumerate(values))
    return [r.v for r in df.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


def test_leading_int_reads_what_the_text_starts_with(rows):
    values = ["12", "12.5", "12abc", " 7", "-3", "+4", "", "abc", None, ".5"]
    expected = [12, 12, 12, 7, -3, 4, None, None, None, None]
    assert evaluate(rows, coercion.leading_int, values) == expected


def test_leading_number_keeps_the_fraction(rows):
    values = ["12.5", "12.5x", "12.", ".5", "1e2", "", "x", None]
    expected = [Decimal("12.5"), Decimal("12.5"), 12, Decimal("0.5"), 100, None, None, None]
    assert evaluate(rows, coercion.leading_number, values) == expected


def test_whole_number_takes_blank_as_zero_but_no_trailing_text(rows):
    values = ["10.4", "", "  ", None, "12abc", "1e2"]
    assert evaluate(rows, coercion.whole_number, values) == [Decimal("10.4"), 0, 0, 0, None, 100]


@pytest.mark.parametrize(
    "text, rounded", [("10.4", 10), ("10.5", 11), ("-0.5", 0), ("-1.5", -1), ("-1.6", -2)]
)
def test_halves_round_up(rows, text, rounded):
    function = lambda c: coercion.round_half_up(coercion.whole_number(c))
    assert evaluate(rows, function, [text]) == [rounded]


def test_city_ends_at_the_first_mark(rows):
    values = ["市abc", "北市x", "台北市大安區", "新北新北市市", "none", None]
    expected = ["市", "北市", "台北市", "新北市", "", None]
    assert evaluate(rows, lambda c: coercion.ending_at(c, "市", 3), values) == expected


def test_lenient_dates(rows):
    values = ["2011-1-5", "2011-01-05", "2011-13-45", "", None]
    expected = [date(2011, 1, 5), date(2011, 1, 5), None, None, None]
    assert evaluate(rows, coercion.lenient_date, values) == expected


def test_texts_and_zeros(rows):
    assert evaluate(rows, coercion.has_text, ["x", "", None]) == [True, False, False]
    joined = lambda c: coercion.join_skipping_nulls(F.lit("a"), c, F.lit("b"))
    assert evaluate(rows, joined, ["-", "", None]) == ["a-b", "ab", "ab"]
    zeros = lambda c: coercion.zero_to_null(c.cast("int"))
    assert evaluate(rows, zeros, ["0", "5", None]) == [None, 5, None]
    texts = ["10.25", "10", "10.", "5.99999", "5.5x", "5.1.2", "5.x", ".5", "5.25e1", "5.000000000000000001", ""]
    wanted = ["0.25", "0", "0", "0.99999", "0.5", "0.1", "0", "0.5", "2.5", "0.000000000000000001", "0"]
    assert evaluate(rows, coercion.fraction_of, texts) == list(map(Decimal, wanted))


def test_every_digit_of_an_amount_counts(rows):
    texts = ["0.4999999", "0.49999999999", "0.5", "\t", "123456789012345.5", "1e30"]
    frame = rows("t string", *[(t,) for t in texts])
    got = [r[0] for r in frame.select(coercion.round_half_up(coercion.whole_number(F.col("t")))).collect()]
    assert got == [0, 0, 1, 0, 123456789012346, None]  # beyond 64 bits: refused
