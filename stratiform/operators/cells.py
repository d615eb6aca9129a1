"""Spreadsheet cells: names of a range, and equality of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def column_number(name: Column) -> Column:
    """A is 1, Z is 26, AA is 27."""
    return F.aggregate(F.filter(F.split(name, ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)


def column_name(n: Column) -> Column:
    """Up to three letters."""
    letter = lambda x: F.char(x + 65)
    one, two = letter((n - 1) % 26), F.concat(letter(F.floor((n - 1) / 26).cast("int") - 1), letter((n - 1) % 26))
    m = n - 703
    three = F.concat(letter(F.floor(m / 676).cast("int")), letter(F.floor(m / 26).cast("int") % 26), letter(m % 26))
    return F.when(n <= 26, one).when(n <= 702, two).otherwise(three)


def range_cells(spec: Column, last_column: int = 26, last_row: int = 1000) -> Column:
    """Cells of a range, column by column; an open end runs to the sheet's bound."""
    ends = F.split(F.upper(F.replace(spec, F.lit("$"), F.lit(""))), ":")
    first, last = F.get(ends, F.lit(0)), F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0)))
    part = lambda e, p, d: F.coalesce(F.nullif(F.regexp_extract(e, p, 1), F.lit("")), d)
    c0, c1 = column_number(part(first, "^([A-Z]+)", F.lit("A"))), column_number(part(last, "^([A-Z]+)", column_name(F.lit(last_column))))
    r0, r1 = part(first, "([0-9]+)$", F.lit("1")).cast("int"), part(last, "([0-9]+)$", F.lit(str(last_row))).cast("int")
    return F.flatten(F.transform(F.sequence(c0, c1), lambda c: F.transform(F.sequence(r0, r1), lambda r: F.concat(column_name(c), r.cast("string")))))


#: A cell: kind is number, text, boolean, datetime or time; a cell of no kind is empty.
CELL = "struct<kind:string, value:string>"
_NUMBER = r"(?i)^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?\s*$"
_SPECIAL = r"(?i)^\s*[+-]?(inf(inity)?|nan)\s*$"
#: Above it doubles lie farther apart than the places that are kept.
_COARSE = 2.0**46


def rounded_to_cents(x: Column) -> Column:
    """The double nearest to ``x`` at two places; what lies exactly between two goes to the even one.

    The exact product with 100 is p + err, with err from a split of ``x`` into two halves, so a value
    such as 2.675, which is a little less than it looks, goes down.
    """

    def of(v: Column) -> Column:
        p, high = v * 100.0, v * 134217729.0 - (v * 134217729.0 - v)
        err, whole = (high * 100.0 - p) + (v - high) * 100.0, F.floor(p).cast("double")
        beyond = (p - whole) - 0.5
        up = (beyond > 0) | ((beyond == 0) & ((err > 0) | ((err == 0) & (F.pmod(whole, F.lit(2.0)) == 1))))
        return F.when(F.isnan(v) | (F.abs(v) >= _COARSE), v).otherwise((whole + F.when(up, 1.0).otherwise(0.0)) / 100.0)

    return F.element_at(F.transform(F.array(x), of), 1)


def parsed_number(text: Column) -> Column:
    """A text that spells a number as a double, else null."""
    plain = F.when(text.rlike(_NUMBER), F.replace(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("_"), F.lit("")).try_cast("double"))
    word = F.lower(F.regexp_extract(text, _SPECIAL, 1))
    special = F.when(word == "nan", float("nan")).when(word != "", F.when(F.contains(text, F.lit("-")), float("-inf")).otherwise(float("inf")))
    return F.coalesce(plain, special)


def serial_days(moment: Column) -> Column:
    """Days since 1899-12-30, to the nearest whole one (halves to the even one)."""
    t = moment.try_cast("timestamp_ntz")
    seconds = F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))
    return F.rint(F.datediff(F.to_date(t), F.lit("1899-12-30").cast("date")) + seconds / 86400.0)


def same_cell(a: Column, b: Column) -> Column:
    """Whether two cells (``CELL``) are equal once normalised.

    Empty and '' are one. Numbers, booleans and texts that spell a number are compared at two places,
    date-times by whole serial days, times as text without the last three characters. A number never
    equals a text, and what is not a number equals nothing.
    """

    def number(c: Column) -> Column:
        v = F.when(c["kind"] == "boolean", F.when(F.lower(c["value"]) == "true", 1.0).otherwise(0.0)).when(c["kind"].isin("number", "text"), parsed_number(c["value"]))
        return F.when(c["kind"] == "datetime", serial_days(c["value"])).otherwise(rounded_to_cents(v))

    def text(c: Column) -> Column:
        return F.when(c["kind"] == "time", F.left(c["value"], F.greatest(F.lit(0), F.length(c["value"]) - 3))).when(c["kind"] == "text", c["value"])

    empty = lambda c: c.isNull() | c["kind"].isNull() | c["value"].isNull() | ((c["kind"] == "text") & (c["value"] == ""))

    def told(n: Column, c: Column) -> Column:
        x, y = n["x"], n["y"]
        numeric = F.when(x.isNotNull() & y.isNotNull(), (x == y) & ~F.isnan(x)).when(x.isNotNull() | y.isNotNull(), F.lit(False))
        return F.coalesce(numeric, text(c["a"]) == text(c["b"]), F.lit(False))

    def pair(c: Column) -> Column:
        x, y = c["a"], c["b"]
        numbers = F.struct(number(x).alias("x"), number(y).alias("y"))
        return F.when(empty(x) | empty(y), empty(x) & empty(y)).otherwise(T.once(numbers, lambda n: told(n, c)))

    return T.once(F.struct(a.alias("a"), b.alias("b")), pair)


def cell(kind: str | Column, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.cast("string").alias("value"))


def same_value(a: Column, b: Column) -> Column:
    """``same_cell`` of two text cells."""
    return same_cell(cell("text", a), cell("text", b))
