"""The expression language: text to Column, in two missing-value modes.

Precedence, loosest first: | & relations (+ -) (* /) unary power.  An expression
is numeric ("n"), a string ("s") or a truth value ("b").
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import VerbError, not_found
from .values import BIG, date_of_days, days_of, double, down, finite, trunc, up

TOKEN = re.compile(
    r"""\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[^\W\d]\w*)|(?P<compound>`"(?:(?!"').)*"')|(?P<str>"[^"\n]*")|(?P<mis>\.[a-z]?(?![\w.]))|(?P<op>==|!=|~=|<=|>=|[-+*/^&|!~<>(),]))""",
    re.S,
)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
PSEUDO = re.compile(r"\b(td|tm|tq|th|tw|ty|tc|tC)\(\s*([^()]*)\)")


@dataclass
class Value:
    kind: str
    col: Column
    missing: bool = False  # the literal missing value
    sure: bool = False  # a number that needs no further check of its range


def _rounded_product(a: Column, times: Column) -> Column:
    """The whole number nearest to a * times (even if halfway) as its exact product has it: the rounding error of the product decides what it leaves open."""
    cut = F.lit(134217729.0)

    def halves(x: Column) -> tuple[Column, Column]:
        high = cut * x - (cut * x - x)
        return high, x - high

    (ah, al), (th, tl) = halves(a), halves(times)
    p = a * times
    error = ((ah * th - p) + ah * tl + al * th) + al * tl
    n = F.floor(p)
    part = p - n
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (n % 2 == 1))))
    return n + F.when(up, 1).otherwise(0)


def _fixed(whole: Column, places: Column) -> Column:
    """whole / 10^places in digits, without zeros at the end of the fraction or before the point."""
    digits = F.lpad(whole.cast("string"), 8, "0")
    head = F.regexp_replace(F.substring(digits, F.lit(1), F.lit(8) - places), "^0+", "")
    tail = F.regexp_replace(F.substring(digits, F.lit(9) - places, places), "0+$", "")
    return F.concat(head, F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(F.lit("")))


def number_text(x: Column) -> Column:
    """A number in at most nine characters, as a table shows it: "." if missing.

    Whole numbers under 10^9 have their digits; others from 10^-5 to 10^7 seven digits (seven
    places below 1); the rest a power of ten, whose digits beyond 10^20 and below 10^-20 are
    rounded half up from the shortest decimal.
    """
    a = F.abs(x)
    sign = F.when(x < 0, "-").otherwise("")
    # digits before the point, and the seven-digit whole number
    before = F.lit(0)
    for k in range(7):
        before = before + F.when(a >= 10.0**k, 1).otherwise(0)
    places = F.when(a < 1, 7).otherwise(7 - before)
    times = F.lit(1.0)
    for k in range(1, 8):
        times = F.when(places == k, 10.0**k).otherwise(times)
    seven = _rounded_product(a, times)
    plain = F.concat(sign, _fixed(seven, places))
    # a power of ten: three digits
    e = F.floor(F.log10(a)).cast("int")
    e = F.when(F.pow(F.lit(10.0), e) > a, e - 1).when(F.pow(F.lit(10.0), e + 1) <= a, e + 1).otherwise(e)
    scale = F.pow(F.lit(10.0), F.abs(e - 2))
    low = F.floor(a / scale)
    middle = (low + 0.5) * scale
    large = low + F.when((a > middle) | ((a == middle) & (low % 2 == 1)), 1).otherwise(0)
    three = F.when(e < 2, _rounded_product(a, scale)).otherwise(large)
    power = F.when(three >= 1000, e + 1).otherwise(e)
    digits = F.when(three >= 1000, 100).otherwise(three).cast("bigint").cast("string")
    tens = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    exact = F.concat(sign, F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 2), F.lit("e"), tens)
    far = F.when(F.abs(e) >= 100, F.format_string("%.1e", x)).otherwise(F.format_string("%.2e", x))
    return (
        F.when(F.coalesce(~(a < F.lit(BIG)), F.lit(True)), ".")
        .when((a < 1e9) & (x == F.floor(x)), x.cast("bigint").cast("string"))
        .when((a >= 9.9999995e-6) & (a < 1e7) & ~((seven >= 10_000_000) & (a >= 1e6)), plain)
        .when(F.abs(e) <= 20, exact)
        .otherwise(far)
    )


def day_literal(text: str, what: str = "td") -> int:
    m = re.fullmatch(r"\s*(\d{1,2})\s*[-/ ]?\s*([A-Za-z]{3})[a-z]*\s*[-/ ]?\s*(\d{4})\s*", text)
    try:
        return (dt.date(int(m[3]), MONTHS.index(m[2].lower()) + 1, int(m[1])) - dt.date(1960, 1, 1)).days
    except (TypeError, ValueError):
        raise VerbError(f"{what}({text}): no such date") from None


def period_literal(kind: str, text: str) -> float:
    """Counts since 1960 of date literals."""
    text = text.strip()
    if kind == "td":
        return day_literal(text)
    if kind in ("tc", "tC"):
        m = re.fullmatch(r"(\S+(?:\s+\S+)*?)\s+(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,3})?))?", text)
        if not m or int(m[2]) > 23 or int(m[3]) > 59 or float(m[4] or 0) >= 60:
            raise VerbError(f"{kind}({text}): no such time")
        return day_literal(m[1], kind) * 86_400_000 + int(m[2]) * 3_600_000 + int(m[3]) * 60_000 + round(float(m[4] or 0) * 1000)
    if kind == "ty":
        if re.fullmatch(r"\d{4}", text):
            return int(text)
        raise VerbError(f"ty({text}): no such year")
    letter, most = {"tm": ("m", 12), "tq": ("q", 4), "th": ("h", 2), "tw": ("w", 52)}[kind]
    m = re.fullmatch(rf"(\d{{4}}){letter}(\d{{1,2}})", text, re.I)
    if not m or not 1 <= int(m[2]) <= most:
        raise VerbError(f"{kind}({text}): no such period")
    return (int(m[1]) - 1960) * most + int(m[2]) - 1


POSIX = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "punct": r"\p{Punct}", "xdigit": "0-9a-fA-F", "word": r"\w", "blank": r" \t"}


class Parser:
    """One expression over named columns of known kinds."""

    def __init__(self, text: str, kinds: dict[str, str], missing_high: bool = False, rows: bool = False):
        self.text, self.kinds, self.high, self.rows = text, kinds, missing_high, rows
        self.uses: set[str] = set()
        self.tokens: list[tuple[str, str, int]] = []
        text = PSEUDO.sub(lambda m: repr(float(period_literal(m[1], m[2]))) if period_literal(m[1], m[2]) >= 0 else f"(-{abs(period_literal(m[1], m[2]))})", text)
        at = 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                raise VerbError(f"can't read the expression at position {at + 1}: {text[at : at + 12]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            at = m.end()
        for (a, x, _), (b, y, _) in zip(self.tokens, self.tokens[1:], strict=False):
            if a in ("num", "mis") and b in ("num", "mis") or (x, y) in (("|", "|"), ("&", "&")):
                raise VerbError(f"unexpected {y!r} in {text!r}")
        self.at = 0

    # -- pieces

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op",) else ""

    def take(self, *ops: str) -> str:
        op = self.peek()
        if op in ops and op:
            self.at += 1
            return op
        return ""

    def need(self, op: str) -> None:
        if not self.take(op):
            raise VerbError(f"{op!r} expected in {self.text!r}")

    def parse(self) -> Value:
        if not self.tokens:
            raise VerbError("empty expression")
        v = self.either()
        if self.at < len(self.tokens):
            raise VerbError(f"unexpected {self.tokens[self.at][1]!r} at position {self.tokens[self.at][2] + 1} of {self.text!r}")
        return v

    def truth(self, v: Value) -> Column:
        """A truth value; a number is true if it is not 0 (missing included)."""
        if v.kind == "s":
            raise VerbError("a string is no condition", 109)
        return v.col if v.kind == "b" else F.coalesce(v.col != 0, F.lit(True))

    def number(self, v: Value) -> Column:
        if v.kind == "s":
            raise VerbError("a string where a number is needed", 109)
        return F.when(v.col, 1.0).when(~v.col, 0.0) if v.kind == "b" else double(v.col)

    def string(self, v: Value) -> Column:
        if v.kind != "s":
            raise VerbError("a number where a string is needed", 109)
        return F.coalesce(v.col, F.lit(""))

    # -- grammar

    def either(self) -> Value:
        v = self.both()
        while self.take("|"):
            v = Value("b", self.truth(v) | self.truth(self.both()))
        return v

    def both(self) -> Value:
        v = self.relation()
        while self.take("&"):
            v = Value("b", self.truth(v) & self.truth(self.relation()))
        return v

    def relation(self) -> Value:
        v = self.sum()
        while op := self.take("==", "!=", "~=", "<=", ">=", "<", ">"):
            v = Value("b", self.compare("!=" if op == "~=" else op, v, self.sum()))
        return v

    def compare(self, op: str, a: Value, b: Value) -> Column:
        if (a.kind == "s") != (b.kind == "s"):
            raise VerbError("a string compared with a number", 109)
        plain = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
        if a.kind == "s":
            return plain(self.string(a), self.string(b))
        x, y = self.number(a), self.number(b)
        if not self.high and not a.missing and not b.missing:
            return plain(x, y)
        # missing is greater than every number, and comparisons are never unknown
        less = x.isNotNull() & F.coalesce(x < y, F.lit(True))
        more = y.isNotNull() & F.coalesce(x > y, F.lit(True))
        return {"==": x.eqNullSafe(y), "!=": ~x.eqNullSafe(y), "<": less, ">": more, "<=": ~more, ">=": ~less}[op]

    def sum(self) -> Value:
        v = self.term()
        while op := self.take("+", "-"):
            w = self.term()
            if op == "+" and v.kind == w.kind == "s":
                v = Value("s", F.concat(self.string(v), self.string(w)))
            else:
                x, y = self.number(v), self.number(w)
                v = Value("n", finite(x + y if op == "+" else x - y), sure=True)
        return v

    def term(self) -> Value:
        v = self.unary()
        while op := self.take("*", "/"):
            x, y = self.number(v), self.number(self.unary())
            v = Value("n", finite(x * y) if op == "*" else finite(F.try_divide(x, y)), sure=True)
        return v

    def unary(self) -> Value:
        if op := self.take("-", "+", "!", "~"):
            v = self.unary()
            if op in "!~":
                return Value("b", ~self.truth(v))
            return Value("n", -self.number(v) if op == "-" else self.number(v))
        return self.power()

    def power(self) -> Value:
        v = self.primary()
        while self.take("^"):
            sign = 1
            while op := self.take("-", "+"):
                sign = -sign if op == "-" else sign
            v = Value("n", finite(F.pow(self.number(v), sign * self.number(self.primary()))), sure=True)
        return v

    def primary(self) -> Value:
        if self.take("("):
            v = self.either()
            self.need(")")
            return v
        if self.at >= len(self.tokens):
            raise VerbError(f"the expression {self.text!r} ends too soon")
        group, word, where = self.tokens[self.at]
        self.at += 1
        if group == "num":
            x = float(word)
            return Value("n", F.lit(x) if abs(x) < BIG else F.lit(None).cast("double"), abs(x) >= BIG)
        if group == "mis":
            return Value("n", F.lit(None).cast("double"), True)
        if group == "str":
            return Value("s", F.lit(word[1:-1]))
        if group == "compound":
            return Value("s", F.lit(word[2:-2]))
        if group == "name":
            if self.peek() == "(":
                return self.call(word, where)
            if word in ("_n", "_N"):
                if not self.rows:
                    raise VerbError(f"{word} is not allowed here")
                self.uses.add(word)
                return Value("n", F.col("__row_n" if word == "_n" else "__rows").cast("double"))
            if word not in self.kinds:
                raise not_found(word)
            return Value(self.kinds[word], F.col(f"`{word}`"))
        raise VerbError(f"unexpected {word!r} at position {where + 1} of {self.text!r}")

    def call(self, name: str, where: int) -> Value:
        self.need("(")
        args: list[Value] = []
        if self.peek() != ")":
            args.append(self.either())
            while self.take(","):
                args.append(self.either())
        self.need(")")
        f = getattr(self, f"f_{ALIAS.get(name, name)}", None)
        if not f:
            raise VerbError(f"unknown function {name}() at position {where + 1}", 133)
        least, most = ARGS.get(ALIAS.get(name, name), (1, 1))
        if not least <= len(args) <= most:
            raise VerbError(f"{name}() takes {least}{'' if least == most else f' to {most}'} arguments, not {len(args)}")
        return f(*args)

    # -- functions

    def is_missing(self, v: Value) -> Column:
        return self.string(v) == "" if v.kind == "s" else finite(self.number(v)).isNull()

    def f_missing(self, *vs):
        out = self.is_missing(vs[0])
        for v in vs[1:]:
            out = out | self.is_missing(v)
        return Value("b", out)

    def f_abs(self, v):
        return Value("n", F.abs(self.number(v)))

    def f_exp(self, v):
        return Value("n", finite(F.exp(self.number(v))), sure=True)

    def f_ln(self, v):
        x = self.number(v)
        return Value("n", F.when(x > 0, F.ln(x)))

    def f_log10(self, v):
        x = self.number(v)
        return Value("n", F.when(x > 0, F.log10(x)))

    def f_sqrt(self, v):
        x = self.number(v)
        return Value("n", F.when(x >= 0, F.sqrt(x)))

    def f_floor(self, v):
        return Value("n", down(self.number(v)))

    def f_ceil(self, v):
        return Value("n", up(self.number(v)))

    def f_int(self, v):
        return Value("n", trunc(self.number(v)))

    def f_round(self, v, unit=None):
        x = self.number(v)
        if unit is None:
            return Value("n", down(x + 0.5))
        u = self.number(unit)
        return Value("n", F.when(u == 0, x).otherwise(finite(down(F.try_divide(x, u) + 0.5) * u)))

    def f_mod(self, a, b):
        x, y = self.number(a), self.number(b)
        return Value("n", F.when(y > 0, x - y * down(F.try_divide(x, y))))

    def f_min(self, *vs):
        return Value("n", F.least(*map(self.number, vs)))

    def f_max(self, *vs):
        return Value("n", F.greatest(*map(self.number, vs)))

    def f_cond(self, c, a, b, d=None):
        if (a.kind == "s") != (b.kind == "s") or d is not None and (d.kind == "s") != (a.kind == "s"):
            raise VerbError("the branches of cond() are of different kinds", 109)
        as_ = self.string if a.kind == "s" else self.number
        test = self.truth(c) if d is None else (c.col if c.kind == "b" else c.col != 0)
        out = F.when(test, as_(a)).when(~test, as_(b))
        return Value("s" if a.kind == "s" else "n", out if d is None else out.otherwise(as_(d)))

    def f_inrange(self, v, lo, hi):
        if v.kind == "s":
            x = self.string(v)
            return Value("b", (x >= self.string(lo)) & (x <= self.string(hi)))
        x, a, b = self.number(v), self.number(lo), self.number(hi)
        return Value("b", x.isNotNull() & F.coalesce(x >= a, F.lit(True)) & F.coalesce(x <= b, F.lit(True)))

    def f_inlist(self, v, *vs):
        out = F.lit(False)
        for w in vs:
            out = out | F.coalesce(self.compare("==", v, w), F.lit(False))
        return Value("b", out)

    def f_strlen(self, v):
        return Value("n", F.octet_length(self.string(v)).cast("double"), sure=True)

    def f_ustrlen(self, v):
        return Value("n", F.char_length(self.string(v)).cast("double"), sure=True)

    def f_upper(self, v):
        return Value("s", F.translate(self.string(v), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    def f_lower(self, v):
        return Value("s", F.translate(self.string(v), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    def f_ustrupper(self, v):
        return Value("s", F.upper(self.string(v)))

    def f_ustrlower(self, v):
        return Value("s", F.lower(self.string(v)))

    def f_trim(self, v):
        return Value("s", F.trim(self.string(v)))

    def f_ltrim(self, v):
        return Value("s", F.ltrim(self.string(v)))

    def f_rtrim(self, v):
        return Value("s", F.rtrim(self.string(v)))

    def f_substr(self, v, start, count=None):
        raw = self.string(v).cast("binary")
        size = F.octet_length(raw)
        p = trunc(self.number(start))
        first = F.when(p < 0, size + p + 1).otherwise(p)
        rest = size - first + 1
        n = rest if count is None or count.missing else F.coalesce(F.least(trunc(self.number(count)), rest), rest)
        ok = (p != 0) & (first >= 1) & (first <= size) & (n > 0)
        cut = F.make_valid_utf8(F.substring(raw, first.cast("int"), n.cast("int")).cast("string"))
        return Value("s", F.when(ok, cut).otherwise(""))

    def f_strpos(self, v, needle):
        s, t = self.string(v), self.string(needle)
        where = F.call_function("instr", s, t)
        return Value("n", F.when((t == "") | (where == 0), 0.0).otherwise(F.octet_length(F.substring(s, F.lit(1), where - 1)) + 1).cast("double"))

    def f_subinstr(self, v, old, new, count):
        if not count.missing:
            raise VerbError("subinstr() replaces all occurrences: its last argument is .")
        s, t = self.string(v), self.string(old)
        return Value("s", F.when(t == "", s).otherwise(F.replace(s, t, self.string(new))))

    def f_string(self, v):
        return Value("s", number_text(self.number(v)))

    def f_real(self, v):
        s = F.trim(self.string(v))
        plain = s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        return Value("n", F.when(plain, finite(s.try_cast("double"))), sure=True)

    def f_regexm(self, v, pattern):
        p = self.string(pattern)
        for k, x in POSIX.items():
            p = F.replace(p, F.lit(f"[:{k}:]"), F.lit(x))
        return Value("b", F.rlike(self.string(v), p))

    def _of_date(self, v, part):
        return Value("n", part(date_of_days(self.number(v))).cast("double"), sure=True)

    def f_year(self, v):
        return self._of_date(v, F.year)

    def f_month(self, v):
        return self._of_date(v, F.month)

    def f_day(self, v):
        return self._of_date(v, F.dayofmonth)

    def f_quarter(self, v):
        return self._of_date(v, F.quarter)

    def f_dow(self, v):
        return self._of_date(v, lambda d: F.dayofweek(d) - 1)

    def f_doy(self, v):
        return self._of_date(v, F.dayofyear)

    def f_mdy(self, m, d, y):
        return Value("n", days_of(self.number(y), self.number(m), self.number(d)), sure=True)

    def f_dofm(self, v):
        m = self.number(v)
        first = F.lit("1960-01-01").cast("date")
        # months of the years 0 to 9999
        whole = F.when((m >= -23_520) & (m < 96_480), F.floor(m)).cast("int")
        return Value("n", F.datediff(F.add_months(first, whole), first).cast("double"), sure=True)

    def f_mofd(self, v):
        d = date_of_days(self.number(v))
        return Value("n", ((F.year(d) - 1960) * 12 + F.month(d) - 1).cast("double"), sure=True)

    def f_yofd(self, v):
        return self.f_year(v)


#: Names of the same function; how many arguments each takes.
ALIAS = {"mi": "missing", "log": "ln", "trunc": "int", "length": "strlen", "strupper": "upper", "strlower": "lower", "strtrim": "trim", "strofreal": "string", "strltrim": "ltrim", "strrtrim": "rtrim"}
ARGS = {"missing": (1, 64), "round": (1, 2), "mod": (2, 2), "min": (2, 64), "max": (2, 64), "cond": (3, 4), "inrange": (3, 3), "inlist": (2, 64), "substr": (2, 3), "strpos": (2, 2), "subinstr": (4, 4), "regexm": (2, 2), "mdy": (3, 3)}


def parse(text: str, kinds: dict[str, str], missing_high: bool = False, rows: bool = False) -> tuple[Value, Parser]:
    p = Parser(text, kinds, missing_high, rows)
    return p.parse(), p
