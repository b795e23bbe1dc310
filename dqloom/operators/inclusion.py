"""Which columns' values lie in which other columns, over many tables at once.

Every column of every table gets a number, its place. One shuffle folds the cells of all
tables to (value, bitmap of places): each map task sends a value once with the bits of all
columns where it met it. The bitmaps are packed into 64-bit words.

Equal bitmaps are counted in the tasks that made them. Counting then needs no pairs of
places: a bitmap is repeated once per word and per *key* column in it, and one aggregation
of 64 bit sums per (key column, word) says how many distinct values each other column
shares with it. The sums are combined inside the tasks, so a task sends at most 64 numbers
per key column and word; single pairs are made from the finished sums, and only those that
share enough values.

Rows sent: distinct values of a map task once; distinct bitmaps of a task once; then one row
per task, key column and word.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqloom.functions.missing import canonical_key, quoted
from dqloom.operators.frequency import fields_of

LONG_KEY = 128
WORD = 64
EVERY = -1


@dataclass(frozen=True)
class Keys:
    """Bitmaps of places with the number of distinct values that have them, and what the
    places are."""

    places: list[tuple[str, str]]
    bitmaps: DataFrame
    tables: Mapping[str, DataFrame]

    @property
    def catalog(self) -> DataFrame:
        rows = [(i, t, c) for i, (t, c) in enumerate(self.places)]
        return self.bitmaps.sparkSession.createDataFrame(rows, "place int, table_name string, column_name string")


def key_columns(df: DataFrame) -> list[tuple[str, Column]]:
    """(name, canonical key) per column. Long keys are compared by digest, so whole texts
    never travel."""
    out = []
    for f in fields_of(df):
        key = canonical_key(quoted(f.name), f.dtype)
        if f.kind in ("string", "other"):
            key = F.when(F.length(key) > LONG_KEY, F.sha2(key, 256)).otherwise(key)
        out.append((f.name, key))
    return out


def value_bitmaps(tables: Mapping[str, DataFrame]) -> Keys:
    """The columns of all tables as places, and a bitmap of them per distinct value."""
    places = [(name, c) for name, df in tables.items() for c in df.columns]
    words = -(-len(places) // WORD)
    cells, at = None, 0
    for df in tables.values():
        wide = df.select(*[key.alias(str(at + i)) for i, (_, key) in enumerate(key_columns(df))])
        part = wide.unpivot([], wide.columns, "place", "key").filter(F.col("key").isNotNull())
        cells = part if cells is None else cells.unionByName(part)
        at += len(df.columns)
    cells = cells.select(F.col("place").cast("int").alias("place"), "key")
    bits = [F.expr(f"CASE WHEN place DIV {WORD} = {w} THEN shiftleft(1L, CAST(place % {WORD} AS INT)) ELSE 0L END").alias(f"w{w}")
            for w in range(words)]
    folded = cells.select("key", *bits).groupBy("key").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(words)])
    alike = folded.groupBy(*[f"w{w}" for w in range(words)]).agg(F.count(F.lit(1)).alias("values"))
    return Keys(places, alike.select(F.array(*[f"w{w}" for w in range(words)]).alias("words"), "values"), tables)


def masks(places: Sequence[int], words: int) -> list[int]:
    out = [0] * words
    for p in places:
        out[p // WORD] |= 1 << p % WORD
    return [m - (1 << WORD) if m >> (WORD - 1) else m for m in out]


def shared_counts(keys: Keys, parents: Sequence[int] | None = None, min_shared: int = 1) -> DataFrame:
    """(parent, child, shared): distinct values that two places share, for the chosen
    parents (all by default). Rows with `parent` = EVERY hold the children's own counts.

    Pairs of one table are left to the caller; they are there like any others.
    """
    words = -(-len(keys.places) // WORD)
    chosen = range(len(keys.places)) if parents is None else parents
    wanted = "array(" + ", ".join(f"{m}L" for m in masks(chosen, words)) + ")"
    every = f"sequence(0, {WORD - 1})"
    holders = F.expr(f"""concat(array({EVERY}), flatten(transform(sequence(0, {words - 1}), w -> CASE
        WHEN words[w] & {wanted}[w] = 0L THEN array()
        ELSE transform(filter({every}, b -> getbit(words[w] & {wanted}[w], b) = 1), b -> w * {WORD} + b) END)))""")
    spread = keys.bitmaps.select("words", "values", F.explode(holders).alias("parent"))
    spread = spread.select("parent", "values", F.posexplode("words").alias("word", "bits")).filter("bits <> 0")
    sums = spread.groupBy("parent", "word").agg(*[F.expr(f"sum(getbit(bits, {b}) * values) AS b{b}") for b in range(WORD)])
    return sums.select("parent", "word", F.posexplode(F.array(*[f"b{b}" for b in range(WORD)])).alias("bit", "shared")).filter(
        F.col("shared") >= min_shared).select("parent", (F.col("word") * WORD + F.col("bit")).alias("child"), "shared").filter("parent <> child")


def _number(column: Column, kind: str, key: Column) -> Column:
    """The key as a number, without a detour over text where the column is one."""
    if kind == "numeric":
        return column.cast("double")
    if kind == "boolean":
        return column.cast("int").cast("double")
    if kind == "datetime":
        return F.lit(None).cast("double")
    # A failed cast costs far more than a look at the text.
    return F.when(key.rlike(r"^[-+]?\.?[0-9]"), key.try_cast("double"))


def number_ranges(keys: Keys) -> DataFrame:
    """(place, lo, hi, numeric): the range of a place's keys, and whether all are numbers.
    One scan per table with one row of results."""
    out, at = None, 0
    for df in keys.tables.values():
        facts: list[Column] = []
        for f, (_, key) in zip(fields_of(df), key_columns(df), strict=True):
            number = _number(f.value, f.kind, key)
            facts += [F.min(number).alias(f"lo{f.pos}"), F.max(number).alias(f"hi{f.pos}"),
                      (F.count(number) == F.count(f.value)).alias(f"ok{f.pos}"), F.count(f.value).alias(f"n{f.pos}")]
        n = len(df.columns)
        rows = ", ".join(f"{at + i}, lo{i}, hi{i}, ok{i} AND n{i} > 0" for i in range(n))
        part = df.agg(*facts).selectExpr(f"stack({n}, {rows}) AS (place, lo, hi, numeric)")
        out = part if out is None else out.unionByName(part)
        at += n
    return out
