"""Date text: supported formats, shapes and parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqloom.functions.missing import strip

# Supported date formats and the shape each one has.
DATE_FORMATS = (
    ("%Y-%m-%d", r"\d{4}-\d{1,2}-\d{1,2}"),
    ("%Y/%m/%d", r"\d{4}/\d{1,2}/\d{1,2}"),
    ("%d/%m/%Y", r"\d{1,2}/\d{1,2}/\d{4}"),
    ("%m/%d/%Y", r"\d{1,2}/\d{1,2}/\d{4}"),
    ("%d-%m-%Y", r"\d{1,2}-\d{1,2}-\d{4}"),
    ("%m-%d-%Y", r"\d{1,2}-\d{1,2}-\d{4}"),
    ("%d.%m.%Y", r"\d{1,2}\.\d{1,2}\.\d{4}"),
    ("%d-%b-%Y", r"\d{1,2}-[A-Za-z]{3}-\d{4}"),
    ("%d %b %Y", r"\d{1,2} [A-Za-z]{3} \d{4}"),
    ("%d %B %Y", r"\d{1,2} [A-Za-z]{3,9} \d{4}"),
    ("%B %d, %Y", r"[A-Za-z]{3,9} \d{1,2}, \d{4}"),
)
COMPACT_FORMAT = "%Y%m%d"
TIME_SUFFIX = r"[ T]\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?"
DATE_SHAPE = (
    "^(?:(?:" + "|".join(dict.fromkeys(shape for _, shape in DATE_FORMATS)) + ")"
    + "(?:" + TIME_SUFFIX + r")?|\d{8})$"
)
# Format directives and the Spark letters that read them.
DIRECTIVES = {
    "Y": "yyyy", "m": "M", "d": "d", "b": "MMM", "B": "MMMM", "y": "yy",
    "H": "H", "M": "m", "S": "s", "f": "[SSSSSS][SSSSS][SSSS][SSS][SS][S]", "p": "a", "I": "h", "j": "D",
    "a": "EEE", "A": "EEEE", "z": "[XXX][XX]",
}


def spark_pattern(fmt: str) -> str:
    """The Spark datetime pattern for a %-style format."""
    compact = re.search(r"%[Ymd](?=%[Ymd])", fmt) is not None
    out = []
    for directive, text in re.findall(r"%(.)|([^%]+)", fmt):
        if text:
            out.append("'" + text.replace("'", "''") + "'" if re.search("[A-Za-z]", text) else text)
        elif directive not in DIRECTIVES:
            raise ValueError(f"unsupported date directive %{directive}")
        elif compact and directive in "mdHMS":
            out.append(DIRECTIVES[directive] * 2)
        else:
            out.append(DIRECTIVES[directive])
    return "".join(out)


def parse_format(c: Column, fmt: str) -> Column:
    """Strict parse under one format; NULL when it does not fit."""
    parsed = F.try_to_timestamp(c, F.lit(spark_pattern(fmt)))
    # The optional fraction still asks for a digit.
    return F.when(c.rlike(r"\d$"), parsed) if fmt.endswith("%f") else parsed


def without_clock(c: Column) -> Column:
    """Date text with a trailing time of day removed."""
    return F.regexp_replace(c, TIME_SUFFIX + "$", "")


def parse_date_part(bare: Column, fmt: str) -> Column:
    """Parse date text under one format; the shape is tested first, as it is cheaper."""
    shape = dict(DATE_FORMATS).get(fmt, r"\d{8}")
    return F.when(bare.rlike(f"^{shape}$"), parse_format(bare, fmt))


def parse_any(c: Column) -> Column:
    """Timestamp of date text in any supported form, month first when both fit."""
    text = strip(c)
    iso = F.when(
        text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?"
                   r"(?:Z|[+-]\d{2}:?\d{2})?)?$"),
        text.try_cast("timestamp"),
    )
    bare = without_clock(text)
    clock = F.regexp_extract(text, r"[ T](\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?)$", 1)
    order = ["%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%m-%Y", "%d.%m.%Y",
             "%d-%b-%Y", "%d %b %Y", "%d %B %Y", "%B %d, %Y", COMPACT_FORMAT]
    day = F.coalesce(*[parse_date_part(bare, fmt) for fmt in order])
    with_clock = F.concat(F.date_format(day, "yyyy-MM-dd "), clock).try_cast("timestamp")
    return F.coalesce(iso, F.when(clock == "", day).otherwise(with_clock))


def as_timestamp(c: Column, dtype: T.DataType) -> Column:
    """Any column as a timestamp; NULL when it is not a date."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    if isinstance(dtype, T.StringType):
        return parse_any(c)
    return F.lit(None).cast("timestamp")
