"""The expression language: syntax, types, and values on a five-row table."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gridlark.functions import STANDARD, ErrorKind, ExpressionError, ExprType, compile_expression, names, parse, to_source, try_parse
from gridlark.functions.registry import ExpressionFunction, python_function
from gridlark.operators.facts import FactTable

ROWS = [
    ("Europe", "Germany", date(2024, 1, 5), 1, 10.0, True),
    ("Europe", "Hungary", date(2024, 3, 5), 2, 20.0, False),
    ("Europe", None, date(2025, 1, 5), 3, None, None),
    ("Asia", "Japan", date(2025, 6, 5), 5, 50.0, True),
    (None, "Iceland", None, None, 70.0, False),
]
N = None


@pytest.fixture(scope="module")
def facts(spark):
    return FactTable.of(spark.createDataFrame(ROWS, "region string, country string, date date, qty int, price double, active boolean"))


VALUES = {
    "qty * price": [10, 40, N, 250, N],
    "qty / 0": [N] * 5,
    "qty + price": [11, 22, N, 55, N],
    "-qty": [-1, -2, -3, -5, N],
    "-7 % 3": [2] * 5,
    "-5 % -3": [1] * 5,
    "qty % 2": [1, 0, 1, 1, N],
    "coalesce(price, qty, 0)": [10, 20, 3, 50, 70],
    "qty >= 2 and price > 10": [False, True, N, True, N],
    "qty >= 2 or price > 10": [False, True, True, True, True],
    "not active": [False, True, N, False, True],
    "qty in (1, null)": [True, N, N, N, N],
    "qty in ()": [False, False, False, False, N],
    "qty not in (1, 2)": [False, False, True, True, N],
    "qty between 2 and 3": [False, True, True, False, N],
    "country is empty": [False, False, True, False, False],
    "isempty(qty)": [False, False, False, False, True],
    'concat(region, "-", country)': ["Europe-Germany", "Europe-Hungary", "Europe-", "Asia-Japan", "-Iceland"],
    "substring(region, 5)": ["pe", "pe", "pe", "", N],
    "substring(region, -3, 2)": ["Eu", "Eu", "Eu", "As", N],
    "left(region, 0)": ["", "", "", "", N],
    "text(price)": ["10", "20", N, "50", "70"],
    "text(price / 3)": ["3.3333333333333335", "6.666666666666667", N, "16.666666666666668", "23.333333333333332"],
    "text(date)": ["2024-01-05", "2024-03-05", "2025-01-05", "2025-06-05", N],
    "text(date + 0.5)": ["2024-01-05 12:00:00", "2024-03-05 12:00:00", "2025-01-05 12:00:00", "2025-06-05 12:00:00", N],
    "text(active)": ["true", "false", N, "true", "false"],
    "weekday(date)": [5, 2, 7, 4, N],
    "week(date)": [1, 10, 1, 23, N],
    "date - #2024-01-01#": [4, 64, 370, 521, N],
    "round(price / 3, 2)": [3.33, 6.67, N, 16.67, 23.33],
    "round(1.005, 2)": [1.0] * 5,
    "round(2.5)": [3] * 5,
    "round(-2.5)": [-3] * 5,
    "min(qty, price)": [1, 2, 3, 5, 70],
    "max(qty)": [1, 2, 3, 5, N],
    "sqrt(qty - 2)": [N, 0, 1, 3**0.5, N],
    'len("a🙂b")': [4] * 5,
    'number(" 1e3 ")': [1000] * 5,
    'number("NaN")': [N] * 5,
    'number("1d")': [N] * 5,
    'if(price > 15, "big", "small")': ["small", "big", "small", "big", "big"],
    'replace(region, "", "x")': ["Europe", "Europe", "Europe", "Asia", N],
    'trim("  a\t")': ["a"] * 5,
    'date("2024-02-30")': [N] * 5,
    "date(2024, 14, 0) = #2025-01-31#": [True] * 5,
    "date = #2024-01-05#": [True, False, False, False, N],
    "region < country": [True, True, N, True, N],
}


@pytest.mark.parametrize("source", VALUES)
def test_values(facts, source):
    column = facts.compile(source).column()
    found = [r[0] for r in facts.frame.select(column).collect()]
    assert [x if not isinstance(x, float) else pytest.approx(x) for x in VALUES[source]] == found


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_either_ansi_setting(spark, facts, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for source in ("qty / 0", 'number("x")', 'date("x")', "date(99999, 1, 1)", "date + 1e18", "left(region, 1e12)", "1e308 * 1e308 - 1e308 * 1e308"):
            facts.frame.select(facts.compile(source).column()).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize(
    "source,kind,offset",
    [
        ("1abc", ErrorKind.INVALID_NUMBER, 0),
        ('qty + "x', ErrorKind.UNTERMINATED_TEXT, 6),
        ("[qty", ErrorKind.UNTERMINATED_NAME, 0),
        ("#2024", ErrorKind.UNTERMINATED_DATE, 0),
        ("#2024-02-30#", ErrorKind.INVALID_DATE, 0),
        ("qty < 2 < 3", ErrorKind.UNEXPECTED_TOKEN, 8),
        ("(qty", ErrorKind.UNEXPECTED_END, 4),
        ("qty ? 1", ErrorKind.UNEXPECTED_CHARACTER, 4),
        ("Qty + 1", ErrorKind.UNKNOWN_COLUMN, 0),
        ("nothing(1)", ErrorKind.UNKNOWN_FUNCTION, 0),
        ("abs(1, 2)", ErrorKind.ARGUMENT_COUNT, 0),
        ("abs(region)", ErrorKind.ARGUMENT_TYPE, 4),
        ("qty + region", ErrorKind.OPERAND_TYPE, 6),
        ("qty = region", ErrorKind.INCOMPATIBLE_TYPES, 0),
        ("active < active", ErrorKind.INCOMPATIBLE_TYPES, 0),
        ("date + date", ErrorKind.INCOMPATIBLE_TYPES, 0),
        ("null", ErrorKind.UNKNOWN_TYPE, 0),
        ("if(true, null, null)", ErrorKind.UNKNOWN_TYPE, 0),
    ],
)
def test_errors(facts, source, kind, offset):
    with pytest.raises(ExpressionError) as e:
        facts.compile(source)
    assert (e.value.kind, e.value.offset) == (kind, offset)


def test_expected_type(facts):
    with pytest.raises(ExpressionError) as e:
        facts.compile("qty", ExprType.BOOLEAN)
    assert e.value.kind is ErrorKind.RESULT_TYPE


@pytest.mark.parametrize(
    "source,canonical",
    [
        ("1+2*3", "1 + 2 * 3"),
        ("(1+2)*3", "(1 + 2) * 3"),
        ("a-(b-c)", "a - (b - c)"),
        ("NOT (a=1 OR b != 2)", "not (a = 1 or b <> 2)"),
        ("[two words] IS NOT NULL", "[two words] is not empty"),
        ("[and] in ('x')", '[and] in ("x")'),
        ("#2024-01-05T10:30#", "#2024-01-05 10:30:00#"),
        ("IF(x, 'it''s', \"q\"\"\")", 'if(x, "it\'s", "q""")'),
    ],
)
def test_canonical_source(source, canonical):
    assert to_source(parse(source)) == canonical == to_source(parse(canonical))


def test_names_and_try_parse():
    assert names(parse("a + b * [c d] - a")) == ["a", "b", "c d"]
    assert try_parse("1 +") is None


def test_registered_functions(spark, facts):
    twice = ExpressionFunction("twice", (ExprType.NUMBER,), ExprType.NUMBER, lambda n: n * 2)
    odd = python_function("odd", (ExprType.NUMBER,), ExprType.BOOLEAN, lambda n: n % 2 == 1 if n is not None else "no")
    registry = STANDARD.with_functions(twice, odd)
    assert [r[0] for r in facts.frame.select(facts.compile("Twice(qty) + 1", functions=registry).column()).collect()] == [3, 5, 7, 11, None]
    assert [r[0] for r in facts.frame.select(facts.compile("odd(qty)", functions=registry).column()).collect()] == [True, False, True, True, None]
    replaced = registry.with_functions(ExpressionFunction("twice", (ExprType.NUMBER,), ExprType.NUMBER, lambda n: n * 3))
    assert len(replaced.lookup("twice")) == 1


def test_date_times_keep_milliseconds(spark):
    f = FactTable.of(spark.createDataFrame([(datetime(2024, 1, 1, 10, 0, 0, 123456),)], "t timestamp_ntz"))
    assert f.frame.select(f.compile("text(t)").column()).first()[0] == "2024-01-01 10:00:00.123"
    assert compile_expression("t - t", f.scope()).type is ExprType.NUMBER
    assert f.frame.select(F.col(f["t"].inner)).first()[0].microsecond == 123000
