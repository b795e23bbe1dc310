"""Value-frequency tables: every distinct value of every column with its count.

One row per (column, value). Most profile operators are weighted sums over this
frame, so a value is examined once however often it occurs. The partial
aggregation in front of the shuffle folds hot values inside each map task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqloom.functions.missing import (
    FRACTIONAL,
    INTEGRAL,
    null_if_nan,
    quoted,
    storage_kind,
    value_text,
)


@dataclass(frozen=True)
class Field:
    """One column of a table: position, name, Spark type and storage kind."""

    pos: int
    name: str
    dtype: T.DataType

    @property
    def kind(self) -> str:
        return storage_kind(self.dtype)

    @property
    def value(self) -> Column:
        return null_if_nan(quoted(self.name), self.dtype)


def fields_of(
    df: DataFrame, columns: Sequence[str] | None = None, kinds: Sequence[str] | None = None
) -> list[Field]:
    wanted = None if columns is None else set(columns)
    out = [Field(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)]
    return [
        f for f in out
        if (wanted is None or f.name in wanted) and (kinds is None or f.kind in kinds)
    ]


def column_name(fields: Sequence[Field], pos: Column | None = None) -> Column:
    """The name behind a column position."""
    pos = F.col("pos") if pos is None else pos
    names = {f.pos: f.name for f in fields}
    top = max(names, default=0)
    return F.element_at(F.array(*[F.lit(names.get(i)) for i in range(top + 1)]), pos + 1)


def _slots(field: Field, digest_over: int | None) -> tuple[Column, Column, Column]:
    """(long, double, text) slots; one carries the value, exactly."""
    no_long, no_double, no_text = (F.lit(None).cast(t) for t in ("long", "double", "string"))
    v = field.value
    if isinstance(field.dtype, INTEGRAL):
        return v.cast("long"), no_double, no_text
    if isinstance(field.dtype, FRACTIONAL):
        return no_long, v.cast("double"), no_text
    text = value_text(v, field.dtype)
    if isinstance(field.dtype, T.DecimalType):
        return no_long, v.cast("double"), text
    if digest_over is not None and isinstance(field.dtype, T.StringType):
        # Long texts travel as a prefix and a SHA-256 digest: still exact as an
        # identity, a hundred times smaller in the shuffle.
        text = F.when(F.length(text) > digest_over, digested(text)).otherwise(text)
    return no_long, no_double, text


LONG_TEXT = 256
_DIGESTED = r"(?s)^.{64}#[0-9a-f]{64}$"


def digested(text: Column) -> Column:
    return F.concat(F.left(text, F.lit(64)), F.lit("#"), F.sha2(text, 256))


def spelled_out(df: DataFrame, frame: DataFrame, value: str, by: str = "column_name") -> DataFrame:
    """`frame` with the texts behind the digests in its column `value`.

    `frame` is report-sized: a few values per column of `df`. It is evaluated, and only if
    it shows a digest is the table read once more for these texts.
    """
    frame = df.sparkSession.createDataFrame(frame.toArrow())
    held = frame.filter(F.col(value).rlike(_DIGESTED)).select(by, value).distinct()
    texts = [f for f in fields_of(df) if isinstance(f.dtype, T.StringType)]
    if not texts or held.isEmpty():
        return frame
    args: list[Column] = []
    for f in texts:
        args += [F.lit(f.pos if by == "pos" else f.name), quoted(f.name)]
    cells = df.select(F.stack(F.lit(len(texts)), *args).alias(by, "whole")).filter(F.length("whole") > LONG_TEXT)
    found = cells.withColumn(value, digested(F.col("whole"))).join(F.broadcast(held), [by, value]).groupBy(by, value).agg(
        F.any_value("whole").alias("whole"))
    return frame.join(F.broadcast(found), [by, value], "left").withColumn(
        value, F.coalesce("whole", value)).select(*frame.columns)


def unpivot(
    df: DataFrame, fields: Sequence[Field], digest_over: int | None = None,
    keep: Sequence[Column] = (),
) -> DataFrame:
    """(pos, l, d, s): one row per non-null cell."""
    args: list[Column] = []
    for f in fields:
        args += [F.lit(f.pos), *_slots(f, digest_over)]
    cells = df.select(*keep, F.stack(F.lit(len(fields)), *args).alias("pos", "l", "d", "s"))
    return cells.filter("l IS NOT NULL OR d IS NOT NULL OR s IS NOT NULL")


def value_frequencies(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    kinds: Sequence[str] | None = None,
    digest_over: int | None = None,
) -> DataFrame:
    """(pos, l, d, s, cnt) over the chosen columns."""
    fields = fields_of(df, columns, kinds)
    return (
        unpivot(df, fields, digest_over)
        .groupBy("pos", "l", "d", "s")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def display_text() -> Column:
    """A frequency row's value as text."""
    return F.coalesce(F.col("s"), F.col("l").cast("string"), F.col("d").cast("string"))


def number_value() -> Column:
    """A frequency row's value as a double (numeric columns)."""
    return F.coalesce(F.col("l").cast("double"), F.col("d"))


def numeric_values(vft: DataFrame) -> DataFrame:
    """(pos, v, cnt) of the numeric columns of a frequency table."""
    return vft.select("pos", number_value().alias("v"), "cnt")


def text_values(
    df: DataFrame, columns: Sequence[str] | None = None, repeated: bool = True
) -> tuple[DataFrame, list[Field]]:
    """((pos, value, cnt), fields) for text columns.

    `repeated=True` groups equal values first. `repeated=False` passes rows
    through with weight 1: no shuffle, the better plan for mostly-unique text.
    """
    fields = fields_of(df, columns, ["string"])
    args: list[Column] = []
    for f in fields:
        args += [F.lit(f.pos), quoted(f.name)]
    cells = df.select(F.stack(F.lit(len(fields)), *args).alias("pos", "value"))
    cells = cells.filter(F.col("value").isNotNull())
    if repeated:
        return cells.groupBy("pos", "value").agg(F.count(F.lit(1)).alias("cnt")), fields
    return cells.withColumn("cnt", F.lit(1).cast("long")), fields
