"""Reading raw text cells: kinds, numbers and rendered text.

Casts are always guarded by a pattern, because Spark's own cast also accepts
spellings such as ``1d`` or ``Infinity``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowguard import vocab

# The characters that count as blank space, and number grammars.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
          "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")
INTEGER = r"^[+-]?[0-9]+\z"
DECIMAL = r"^[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
# The looser grammar of the generic reader: one underscore between two digits.
LOOSE_DECIMAL = (r"^[+-]?(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)"
                 r"(?:[eE][+-]?[0-9](?:_?[0-9])*)?\z")
NON_FINITE = ["nan", "+nan", "-nan", "inf", "+inf", "-inf",
              "infinity", "+infinity", "-infinity"]

INFINITY = float("inf")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row.

    Plain Columns are trees: using one twice evaluates it twice and doubles the
    generated code, soon past the size the JVM compiles. A lambda variable is
    bound once and keeps the plan small.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _visible(c: Column) -> Column:
    return F.ascii(c).between(33, 126)


def strip(c: Column) -> Column:
    """Text without surrounding blank space of any kind.

    Text that starts and ends with a printable ASCII character is passed through;
    the search through all kinds of blanks runs only for the rest.
    """
    return let(c, strip_bound)


def strip_bound(c: Column) -> Column:
    """:func:`strip` of a plain column or lambda variable."""
    return (F.when(_visible(c) & _visible(F.right(c, F.lit(1))), c)
            .otherwise(F.trim(c, F.lit(BLANKS))))


def is_finite(c: Column) -> Column:
    """True for a number that is neither infinite nor not-a-number."""
    return F.abs(c) < F.lit(INFINITY)


def guarded_double(text: Column) -> Column:
    return text.try_cast("double")


def _kind(text: Column, number: Column) -> Column:
    return (F.when(F.coalesce(text, F.lit("")) == "", F.lit("null"))
            .when(number.isNotNull() & text.rlike(INTEGER), F.lit("integer"))
            .when(is_finite(number), F.lit("float"))
            .when(F.lower(text).isin("true", "false"), F.lit("boolean"))
            .otherwise(F.lit("string")))


def _typed(raw: Column, body) -> Column:
    """``body`` of a struct with the trimmed text, its number and its kind."""
    def with_number(text):
        return let(F.struct(text.alias("t"), parsed_number(text).alias("d")), with_kind)

    def with_kind(x):
        return let(F.struct(x["t"].alias("t"), x["d"].alias("d"),
                            _kind(x["t"], x["d"]).alias("k")), body)
    return let(let(raw, strip_bound), with_number)


def cell_kind(raw: Column) -> Column:
    """``null``, ``boolean``, ``integer``, ``float`` or ``string`` of a text cell."""
    return _typed(raw, lambda x: x["k"])


def whole_number_text(text: Column) -> Column:
    """Plain spelling of an integer: no plus sign, no leading zeros."""
    digits = F.regexp_replace(text, r"^[+-]?0*", "")
    sign = F.when(text.startswith("-") & (digits != ""), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.when(digits == "", F.lit("0")).otherwise(digits))


def float_text(d: Column) -> Column:
    """Shortest plain spelling of a double; exponents only below 1e-4 and from 1e16."""
    java = d.cast("string")
    sign = F.when(java.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    parts = r"^-?([0-9])\.([0-9]+)E(-?[0-9]+)$"
    tail = F.regexp_extract(java, parts, 2)
    digits = F.concat(F.regexp_extract(java, parts, 1),
                      F.when(tail == "0", F.lit("")).otherwise(tail))
    power = F.regexp_extract(java, parts, 3).try_cast("int")
    padded = F.rpad(digits, F.greatest(power + 1, F.length(digits)), "0")
    fraction = F.substring(padded, power + 2, F.length(padded))
    plain = F.concat(sign, F.substring(padded, F.lit(1), power + 1), F.lit("."),
                     F.when(fraction == "", F.lit("0")).otherwise(fraction))
    small = F.concat(sign, F.lit("0.000"), digits)
    mantissa = F.concat(
        F.substring(digits, 1, 1),
        F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 40)))
        .otherwise(F.lit("")))
    exponent = F.concat(F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
                        F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")),
                        F.abs(power).cast("string"))
    return (F.when(~java.contains("E"), java)
            .when(power.between(0, 15), plain)
            .when(power == -4, small)
            .otherwise(F.concat(sign, mantissa, F.lit("e"), exponent)))


def double_text(d: Column) -> Column:
    """:func:`float_text` of a column; only numbers that Java writes with an exponent take the long way.

    Its lambda also keeps the step that it stands in apart from those below, so that generated methods stay
    short enough for the JVM to compile.
    """
    usual = (d == 0) | F.abs(d).between(1e-3, 9_999_999)
    return F.when(usual, d.cast("string")).otherwise(let(d, float_text))


def _text(x: Column) -> Column:
    return (F.when(x["k"] == "boolean", F.initcap(F.lower(x["t"])))
            .when(x["k"] == "integer", whole_number_text(x["t"]))
            .when(x["k"] == "float", float_text(x["d"]))
            .when(x["k"] == "string", x["t"]))


def cell_text(raw: Column) -> Column:
    """A cell as it reads after typing: ``007`` is ``7``, ``true`` is ``True``."""
    return _typed(raw, _text)


def coerce(raw: Column) -> Column:
    """Kind, rendered text and numeric value of a cell as one struct."""
    return _typed(raw, lambda x: F.struct(
        x["k"].alias("kind"), _text(x).alias("text"),
        F.when(x["k"].isin("integer", "float"), finite_or_null(x["d"])).alias("number")))


def finite_or_null(d: Column) -> Column:
    return F.when(is_finite(d), d)


def plain_number(raw: Column) -> Column:
    """Number of a cell in the strict grammar with at most spaces around it.

    Short enough to stay in generated code; cells it does not read go to the
    slower expressions below.
    """
    return F.when(F.trim(raw).rlike(DECIMAL), guarded_double(F.trim(raw)))


def to_number(raw: Column, strict: bool = False) -> Column:
    """A cell as a measurement; null when it is not a finite number.

    The generic reader also reads ``1_0`` as 10; ``strict`` refuses that.
    """
    def number(text):
        plain = parsed_number(text)
        if strict:
            return plain
        grouped = F.when(text.contains("_") & text.rlike(LOOSE_DECIMAL),
                         parsed_number(F.replace(text, F.lit("_"), F.lit(""))))
        return F.coalesce(plain, grouped)
    slow = let(let(raw, strip_bound), number)
    return let(F.coalesce(plain_number(raw), slow), finite_or_null)


def parsed_number(text: Column) -> Column:
    """Number of an already trimmed text, infinite when it overflows.

    Same grammar as ``DECIMAL`` without running a pattern per cell: what the
    engine's cast accepts beyond it are words, a type letter at the end, hex
    digits and leading control characters, and each shows in one character.
    """
    first, last = F.ascii(text), F.ascii(F.right(text, F.lit(1)))
    plain = ((first.between(48, 57) | first.isin(43, 45, 46))
             & (last.between(48, 57) | (last == 46))
             & ~text.contains("x") & ~text.contains("X"))
    return F.when(plain, guarded_double(text))


def measurement_code(text: Column, value: Column) -> Column:
    """Reason code of a trimmed measurement and its parsed number; null when usable."""
    return (F.when(is_finite(value), F.lit(None).cast("string"))
            .when(value.isNotNull(), F.lit(vocab.NON_FINITE_VALUE))
            .when(F.coalesce(text, F.lit("")) == "", F.lit(vocab.MISSING_VALUE))
            .when(F.lower(text).isin(NON_FINITE), F.lit(vocab.NON_FINITE_VALUE))
            .otherwise(F.lit(vocab.UNPARSABLE_VALUE)))


def column_type(has_boolean: Column, has_integer: Column, has_float: Column,
                has_string: Column) -> Column:
    """One type for a column out of the kinds seen in it."""
    kinds = sum((F.when(h, 1).otherwise(0) for h in
                 (has_boolean, has_integer, has_float, has_string)), F.lit(0))
    return (F.when(kinds == 0, F.lit("null"))
            .when((kinds == 2) & has_integer & has_float, F.lit("float"))
            .when(kinds > 1, F.lit("mixed"))
            .when(has_boolean, F.lit("boolean"))
            .when(has_integer, F.lit("integer"))
            .when(has_float, F.lit("float"))
            .otherwise(F.lit("string")))
