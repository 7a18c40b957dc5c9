import random

import pytest
from pyspark.sql import functions as F

from tabloom import VerbError
from tabloom.functions.expression import number_text, period_literal
from tabloom.operators import columns as C
from tabloom.sources.readers import boundary


@pytest.fixture(scope="module")
def five(spark):
    rows = [(1, 1.0, 10.0, "a", 21915), (2, 2.0, 20.0, "bb", 21916), (3, None, 30.0, "", None), (4, 4.0, None, None, 21918), (5, 5.0, 50.0, "héé🦆", 21919)]
    return boundary(spark.createDataFrame(rows, "id int, x double, y double, s string, d int"))


def high(v):
    return type(v)(**{**v.__dict__, "missing_high": True})


@pytest.mark.parametrize(("text", "n"), [("x > 2", 2), ("x != 2", 3), ("missing(x)", 1), ("mi(x, y)", 2), ("x == .", 1), ("x < .", 4), ("x", 5), ('s == ""', 2), ("!(x > 2)", 2), ("x > 2 | id == 3", 3)])
def test_counts_with_unknown(five, text, n):
    assert C.count(five, text) == n


@pytest.mark.parametrize(("text", "n"), [("x > 2", 3), ("x < 99", 4), ("x <= .", 5), ("x != 2", 4), ("x >= .", 1)])
def test_counts_with_missing_high(five, text, n):
    assert C.count(high(five), text) == n


def values(v, text):
    return [r[0] for r in C.gen(v, "v", text).df.orderBy("id").select("v").collect()]


@pytest.mark.parametrize(
    ("text", "got"),
    [
        ("strlen(s)", [1, 2, 0, 0, 9]), ("ustrlen(s)", [1, 2, 0, 0, 4]), ("upper(s)", ["A", "BB", "", "", "Héé🦆"]), ('strpos(s, "")', [0] * 5), ('s + "!"', ["a!", "bb!", "!", "!", "héé🦆!"]),
        ("substr(s, 2, 2)", ["", "b", "", "", "é"]), ("substr(s, 2, 1)", ["", "b", "", "", "�"]), ("substr(s, 0, 1)", [""] * 5), ("substr(s, -2, .)", ["", "bb", "", "", "��"]),
        ("mdy(2, 30, 2020)", [None] * 5), ("td(1jan2020)", [21915] * 5), ("-2^2", [-4] * 5), ("2^-1", [0.5] * 5), ("1/0", [None] * 5), ("mod(-7, 3)", [2] * 5), ("round(-2.5)", [-2] * 5),
        ("cond(x > 2, 1, 0)", [0, 0, None, 1, 1]), ("inlist(x, 1, .)", [1, 0, 1, 0, 0]), ('real("1e3")', [1000] * 5), ('real("12d")', [None] * 5), ('regexm(s, "^[[:alpha:]]+$")', [1, 1, 0, 0, 0]),
        ("min(x, y)", [1, 2, 30, 4, 5]), ("inrange(x, 2, .)", [0, 1, 0, 1, 1]), ("year(d)", [2020, 2020, None, 2020, 2020]), ("exp(1000)", [None] * 5), ("ln(-1)", [None] * 5), ('`"a"b"\'', ['a"b'] * 5),
    ],
)
def test_functions(five, text, got):
    assert values(five, text) == got


@pytest.mark.parametrize("text", ["x ||y", "x = 2", "nosuch + 1", "f(x)", 's > 1', "x +", "(x", "1.2.3", "", "_n", 'abs("a")', "td(31feb2020)"])
def test_refused(five, text):
    with pytest.raises(VerbError):
        C.replace(five, "x", text)


@pytest.mark.parametrize(("x", "text"), [(1e100, "1.0e+100"), (0.00009999999, ".0001"), (0.000009999999, "1.00e-05"), (12, "12"), (3.14159265, "3.141593"), (-0.5, "-.5"), (None, "."), (0, "0"), (123456.789, "123456.8")])
def test_number_text(spark, x, text):
    assert plain_text(x) == text
    assert texts_of(spark, [x]) == [text]


def plain_text(x):
    """The rule once more, by C's own formats."""
    if x is None or x != x or abs(x) >= 2.0**1023:
        return "."
    if abs(x) < 1e9 and x == int(x):
        return str(int(x))
    e = int(f"{x:e}".partition("e")[2])
    text = f"{x:.7f}".rstrip("0").rstrip(".") if -5 <= e < 0 else f"{x:.7g}" if 0 <= e < 7 else "e"
    if "e" in text:
        mantissa, _, power = f"{x:.{1 if abs(e) >= 100 else 2}e}".partition("e")
        return f"{mantissa}e{int(power):+03d}"
    return text.replace("0.", ".", 1) if text.startswith(("0.", "-0.")) else text


def texts_of(spark, xs):
    return [r[0] for r in spark.createDataFrame([(k, None if x is None else float(x)) for k, x in enumerate(xs)], "k int, x double").orderBy("k").select(number_text(F.col("x"))).collect()]


def test_number_texts_by_c_formats(spark):
    r = random.Random(3)
    xs = [r.choice((-1, 1)) * r.uniform(1, 10) * 10 ** r.randint(-20, 20) for _ in range(4000)] + [round(r.uniform(0, 10 ** r.randint(0, 6)), r.randint(1, 9)) for _ in range(6000)]
    xs += [float(f"{r.randint(1, 9)}.{r.randint(0, 99):02d}5e{r.randint(-19, 19)}") for _ in range(2000)] + [r.randint(1, 10**7) / 10 ** r.randint(1, 8) + 5 / 10 ** r.randint(5, 9) for _ in range(4000)] + [r.randint(0, 2**26) / 2 ** r.randint(1, 20) for _ in range(2000)]
    xs += [9.9999999, 9999999.9, 999999.95, 0.99999999, 9.9999999e-6, 9.9999994e-6, 1e-5, 0.1, 1e7 + 0.5, 1e9, 1.5e9, 1125000000.0, 1e-30 * 3, None, float("nan"), float("inf"), -0.0, 123456.75, 1234.5675]
    got = texts_of(spark, xs)
    assert [(x, a, b) for x, a in zip(xs, got) if a != (b := plain_text(x))] == []


def test_periods():
    assert period_literal("tm", "1960m1") == 0 and period_literal("tq", "1959q4") == -1 and period_literal("tc", "1jan1960 00:00:01.5") == 1500
