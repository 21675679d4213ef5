"""Numbers and partial dates in texts."""

from __future__ import annotations

import calendar
import datetime
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _c

#: Fixed values that decide which texts are numbers or dates.
FLOAT_TEXT = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
ORDINAL_WORDS = ["zeroth", "first", "second", "third", "fourth", "fith", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth"]
ORDINAL_SUFFIXES = ["st", "nd", "rd", "th"]
NUMBER = r"((^|\s)[+-])?((\.\d+)|(\d+(,\d\d\d)*(\.\d*)?))"
FIRST_YEAR, LAST_YEAR = 1700, 2016
DATE_FORMS = [
    ("%B", "m"), ("%Y", "y"), ("%Ys", "y"), ("%b %Y", "ym"), ("%B %Y", "ym"), ("%B %d", "md"), ("%b %d", "md"), ("%d %b", "md"), ("%d %B", "md"),
    ("%B %d, %Y", "ymd"), ("%d %B %Y", "ymd"), ("%m-%d-%Y", "ymd"), ("%Y-%m-%d", "ymd"), ("%Y-%m", "ym"), ("%d %b %Y", "ymd"), ("%b %d, %Y", "ymd"),
    ("%d.%m.%Y", "ymd"), ("%A, %b %d", "md"), ("%A, %B %d", "md"),
]
DATE_WORDS = 5


def python_float(x: str | Column) -> Column:
    """A text as Python reads a float; null where it would refuse. ``nan`` and ``inf`` count."""
    c = F.trim(F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", ""))
    word = F.lower(F.regexp_replace(c, r"^[+-]", ""))
    special = F.when(word == "nan", F.lit(float("nan"))).when(word.isin("inf", "infinity"), F.when(F.startswith(c, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.when(F.regexp_like(c, F.lit(FLOAT_TEXT)), F.replace(c, F.lit("_"), F.lit("")).try_cast("double")).otherwise(special)


def read_float(text: str | None) -> float | None:
    """A text as a number by the same ladder as :func:`to_float`, for work inside a task."""
    if text is None:
        return None
    commas, dots = text.count(","), text.count(".")
    if commas and (dots or any(len(part) == 3 for part in text.split(","))):
        text = text.replace(",", "")
    elif commas == 1:
        text = text.replace(",", ".")
    elif dots > 1:
        text = text.replace(".", "")
    elif commas > 1:
        text = text.replace(",", "")
    try:
        return float(text) if text.isascii() else None
    except ValueError:
        return None


def to_float(x: str | Column) -> Column:
    """Texts as numbers through a ladder of readings of commas and dots; null where none applies.

    Both signs: commas group. A comma piece of three digits: commas group. One other comma: a decimal
    comma. Repeated dots or commas: dropped.
    """
    c = _c(x).cast("string")
    commas, dots = F.length(c) - F.length(F.replace(c, F.lit(","), F.lit(""))), F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    drop = lambda s: F.replace(c, F.lit(s), F.lit(""))
    grouped = F.exists(F.split(c, ","), lambda p: F.length(p) == 3)
    plain = (
        F.when((dots > 0) & (commas > 0), drop(","))
        .when((commas > 0) & grouped, drop(","))
        .when(commas == 1, F.replace(c, F.lit(","), F.lit(".")))
        .when(dots > 1, drop("."))
        .when(commas > 1, drop(","))
        .otherwise(c)
    )
    return python_float(plain)


def half_even(x: str | Column, digits: int = 2) -> Column:
    """Fixed digits by the exact binary value, ties to even, without thousands groups."""
    return F.replace(F.format_number(_c(x), digits), F.lit(","), F.lit(""))


def format_number(x: str | Column) -> Column:
    """Whole numbers without a fraction, others with two digits."""
    c = _c(x).cast("double")
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(half_even(c, 2))


def numeric_relation(a: str | Column, b: str | Column) -> Column:
    """1 equal, 2 less, 4 greater; null if either is."""
    return F.when(_c(a) == _c(b), F.lit(1)).when(_c(a) < _c(b), F.lit(2)).when(_c(a) > _c(b), F.lit(4))


def date_key(date: str | Column, other: str | Column) -> tuple[Column, Column]:
    """Two partial dates as comparable arrays of the fields that both have; null if they share none."""
    a, b = _c(date), _c(other)
    fields = [("year", a["year"], b["year"]), ("month", a["month"], b["month"]), ("day", a["day"], b["day"])]
    both = [F.when(x.isNotNull() & y.isNotNull(), x) for _, x, y in fields], [F.when(x.isNotNull() & y.isNotNull(), y) for _, x, y in fields]
    left, right = (F.filter(F.array(*side), lambda v: v.isNotNull()) for side in both)
    return F.when(F.size(left) > 0, left), F.when(F.size(right) > 0, right)


def _compiled() -> list:
    # fixed values: what each field of a date form looks like
    names = {"%A": r"\w+", "%B": r"\w+", "%Y": r"\d{4}", "%b": r"\w{3}", "%d": r"\d{1,2}", "%m": r"\d{1,2}"}
    return [(f, fields, re.compile("^" + re.sub("%[ABYbdm]", lambda m: names[m[0]], re.escape(f).replace("\\ ", r"\s+")) + "$")) for f, fields in DATE_FORMS]


_FORMS = _compiled()
_ANY_FORM = re.compile("|".join(shape.pattern for _, _, shape in _FORMS))
_MONTHS = {m.lower() for m in calendar.month_name if m}


def read_date(text: str) -> dict | None:
    """The first form that fits gives year, month and day as far as it has them; years outside the range fail."""
    if text.lower() not in _MONTHS and not any(c.isdigit() for c in text):
        return None  # every form but a lone month has digits
    text = re.sub(r"Sept\b", "Sep", text) if "Sept" in text else text
    if not _ANY_FORM.match(text):
        return None
    for form, fields, shape in _FORMS:
        if shape.match(text):
            try:
                # a form without a year is read in a leap year inside the range, so 29 February is a date
                d = datetime.datetime.strptime(text, form) if "y" in fields else datetime.datetime.strptime(f"{text} 2000", f"{form} %Y")
            except ValueError:
                continue
            if FIRST_YEAR <= d.year <= LAST_YEAR:
                return {"year": d.year if "y" in fields else None, "month": d.month if "m" in fields else None, "day": d.day if "d" in fields else None}
    return None


def read_number(text: str) -> float | None:
    for suffix in ORDINAL_SUFFIXES:
        if text.endswith(suffix):
            text = text.removesuffix(suffix)
            break
    try:
        value = float(text.replace(",", ""))
    except ValueError:
        return None
    return None if math.isnan(value) or value == math.inf else value


_TOKEN, _NUMBER, _DIGIT = re.compile(r"[^\W_]+"), re.compile(NUMBER), re.compile(r"\d")
_WORDS = {w: float(i) for ws in (NUMBER_WORDS, ORDINAL_WORDS) for i, w in enumerate(ws)}


def token_spans(text: str, most: int) -> list[tuple[int, int]]:
    """Begin and end of every run of up to ``most`` alphanumeric tokens; other characters separate."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    return [(tokens[i][0], tokens[j][1]) for i in range(len(tokens)) for j in range(i, min(len(tokens), i + most))]


def _date_spans(tokens: list[tuple[int, int]], digits: list[int]) -> list[tuple[int, int]]:
    """The runs of up to ``DATE_WORDS`` tokens that hold one of those at the places ``digits``, once each, by start and length."""
    out, after = [], 0
    for n, k in enumerate(digits):
        for i in range(max(after, k - DATE_WORDS + 1), k + 1):  # starts that saw no earlier one
            out.extend((tokens[i][0], tokens[j][1]) for j in range(k, min(len(tokens), i + DATE_WORDS)))
        after = k + 1
    return out


def parse_spans(text: str) -> list[dict]:
    """Numbers and dates of a text: the longest spans, none inside another, in order."""
    found: dict[tuple[int, int], list[dict]] = {}
    tokens, digits, months = [m.span() for m in _TOKEN.finditer(text)], [], []
    for m in _NUMBER.finditer(text):
        if (n := read_number(m[0])) is not None:
            found.setdefault(m.span(), []).append({"float_value": n, "date": None})
    for k, (a, b) in enumerate(tokens):
        token = text[a:b]
        if _DIGIT.search(token):
            digits.append(k)
        elif token.lower() in _MONTHS:
            months.append((a, b))
        elif token not in _WORDS:
            continue  # neither a number nor a date without digits
        if (a, b) not in found:
            values = [v for v in (read_number(token), _WORDS.get(token)) if v is not None]
            if values:
                found[a, b] = [{"float_value": v, "date": None} for v in values]
    for a, b in months + _date_spans(tokens, digits):
        if (d := read_date(text[a:b])) is not None:
            found.setdefault((a, b), []).append({"float_value": None, "date": d})
    chosen, reach = [], -1
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):  # a span lies in another if an earlier start reaches its end
        if b > reach:
            chosen.append((a, b))
            reach = b
    return [{"begin": a, "end": b, "values": found[a, b]} for a, b in chosen]


_DATE = T.StructType([T.StructField(f, T.IntegerType()) for f in ("year", "month", "day")])
_VALUE = T.StructType([T.StructField("float_value", T.DoubleType()), T.StructField("date", _DATE)])
SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("values", T.ArrayType(_VALUE))]))


@F.pandas_udf(SPANS)
def number_spans(x: pd.Series) -> pd.Series:
    """Number and date spans with character offsets; the pattern scan over characters has no JVM form."""
    return x.map(parse_spans, na_action="ignore")
