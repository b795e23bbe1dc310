"""Missing values, whitespace, numbers and canonical keys as column expressions.

NULL, the empty string and whitespace-only text are three different things in
every operator; NaN counts as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a regular-expression character class.
WHITESPACE_CLASS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

NUMBER_PATTERN = (
    r"^[+-]?(?:(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)"
    r"(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
)

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*INTEGRAL, *FRACTIONAL, T.DecimalType))


def storage_kind(dtype: T.DataType) -> str:
    """numeric, string, datetime, boolean or other."""
    if is_numeric(dtype):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, TEMPORAL):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "other"


def quoted(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_if_nan(c: Column, dtype: T.DataType) -> Column:
    """Floats: NaN to NULL and -0.0 to 0.0, so grouping sees one of each."""
    if isinstance(dtype, FRACTIONAL):
        return F.when(~F.isnan(c), c + F.lit(0.0))
    return c


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_empty(c: Column) -> Column:
    return c == F.lit("")


def is_blank(c: Column) -> Column:
    """Whitespace only, but not empty."""
    return (c != F.lit("")) & (strip(c) == F.lit(""))


def parse_number(c: Column) -> Column:
    """Text to double; NULL where the text is not a number.

    Guarded by a pattern because a plain cast also accepts forms such as '1d'.
    """
    text = strip(c)
    return F.when(
        text.rlike(NUMBER_PATTERN), F.regexp_replace(text, "_", "").try_cast("double")
    )


def as_number(c: Column, dtype: T.DataType) -> Column:
    """Any column as a double; booleans, dates and nested values are not numbers."""
    if is_numeric(dtype):
        return null_if_nan(c, dtype).cast("double")
    if isinstance(dtype, T.StringType):
        return parse_number(c)
    return F.lit(None).cast("double")


def not_missing(c: Column, dtype: T.DataType) -> Column:
    """True where a value is present: not NULL, not empty and not blank."""
    present = null_if_nan(c, dtype).isNotNull()
    if isinstance(dtype, T.StringType):
        return present & (strip(c) != F.lit(""))
    return present


def canonical_key(c: Column, dtype: T.DataType) -> Column:
    """Key text that is equal for 1, 1.0 and "1"; booleans become 1 / 0."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "1").when(~c, "0")
    if isinstance(dtype, INTEGRAL):
        return c.cast("string")
    if isinstance(dtype, FRACTIONAL):
        v = null_if_nan(c, dtype).cast("double")
        whole = (v == F.floor(v)) & (F.abs(v) < F.lit(9.2e18))
        # Plain digits as in text and decimal keys; only what 18 places can't hold keeps its exponent.
        plain = F.regexp_replace(v.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
        exponent = v.cast("string").contains("E")
        part = F.when(exponent & F.coalesce(plain.try_cast("double") == v, F.lit(False)), plain).otherwise(v.cast("string"))
        return F.when(whole, v.try_cast("bigint").cast("string")).otherwise(part)
    if isinstance(dtype, T.DecimalType):
        whole = c == F.floor(c)
        return F.when(whole, c.cast(T.DecimalType(dtype.precision, 0)).cast("string")).otherwise(
            F.regexp_replace(c.cast("string"), r"0+$", "")
        )
    if isinstance(dtype, NESTED):
        return F.to_json(c)
    return strip(c.cast("string"))


def value_text(c: Column, dtype: T.DataType) -> Column:
    """A value as text, stable enough to group by."""
    if isinstance(dtype, NESTED):
        return F.to_json(c)
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    return c.cast("string")
