"""Text column profile over (pos, value, cnt) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqloom.functions import text as tx
from dqloom.functions.missing import strip
from dqloom.operators.counts import percent
from dqloom.operators.frequency import Field, column_name, text_values
from dqloom.operators.ranks import folded_median

TOP_SHAPES = 5
TOP_SEPARATORS = 5
TOP_TOKENS = 5
REGULAR_SHARE = 95.0
DISGUISED_MAX_SHARE = 0.5
VARIANT_EXAMPLES = 3


def _named(fields: Sequence[Field], result: DataFrame) -> DataFrame:
    rest = [c for c in result.columns if c != "pos"]
    return result.select(column_name(fields).alias("column_name"), *rest)


def _weighted(flag: Column) -> Column:
    return F.coalesce(F.sum(F.when(flag, F.col("cnt"))), F.lit(0))


def length_summary(values: DataFrame) -> DataFrame:
    """T1, T10 per position. Lengths are folded to a histogram before the median: different
    lengths are no more than the root of twice all characters."""
    lengths = values.groupBy("pos", F.length("value").cast("double").alias("v")).agg(
        F.sum("cnt").alias("cnt")
    )
    median = folded_median(lengths, "pos").withColumnRenamed("median", "median_length")
    base = lengths.groupBy("pos").agg(
        F.min("v").cast("long").alias("min_length"),
        F.max("v").cast("long").alias("max_length"),
        (F.sum(F.col("v") * F.col("cnt")) / F.sum("cnt")).alias("mean_length"),
    )
    return base.join(F.broadcast(median), "pos").withColumn(
        "free_text", F.col("mean_length") > tx.FREE_TEXT_MEAN_LENGTH
    )


def text_lengths(
    df: DataFrame, columns: Sequence[str] | None = None, repeated: bool = True
) -> DataFrame:
    values, fields = text_values(df, columns, repeated)
    return _named(fields, length_summary(values))


def pattern_summary(values: DataFrame) -> DataFrame:
    """T2 per position: rows matching each of the nine patterns."""
    flags = tx.pattern_flags(F.col("value"))
    return values.groupBy("pos").agg(*[_weighted(c).alias(n) for n, c in flags.items()])


def text_patterns(
    df: DataFrame, columns: Sequence[str] | None = None, repeated: bool = True
) -> DataFrame:
    values, fields = text_values(df, columns, repeated)
    return _named(fields, pattern_summary(values))


def cased_shapes(values: DataFrame) -> DataFrame:
    """(pos, cased, shape, cnt, example): rows per shape, upper and lower case apart.

    Free text (mean length over 64) is left out, as its shapes mean nothing. All shape
    operators read this frame; a value is examined once.
    """
    length = F.length("value")
    short = values.groupBy("pos").agg((F.sum(length * F.col("cnt")) / F.sum("cnt")).alias("mean_length")).filter(
        F.col("mean_length") <= tx.FREE_TEXT_MEAN_LENGTH)
    # One row per table column on the broadcast side, here and below.
    kept = values.join(F.broadcast(short.select("pos")), "pos")
    folded = kept.groupBy("pos", tx.cased_shape_of(F.col("value")).alias("cased")).agg(
        F.sum("cnt").alias("cnt"), F.min("value").alias("example"))
    return folded.withColumn("shape", F.regexp_replace("cased", "[a-z]", "A"))


def shape_ranking(values: DataFrame, k: int = TOP_SHAPES) -> DataFrame:
    """T3 per position: distinct shapes, dominant shape and the k most frequent."""
    return ranked_shapes(cased_shapes(values), k)


def ranked_shapes(cased: DataFrame, k: int = TOP_SHAPES) -> DataFrame:
    """T3 over cased_shapes(). A value is as long as its shape."""
    shapes = cased.groupBy("pos", "shape").agg(F.sum("cnt").alias("cnt"), F.min("example").alias("example"))
    length = F.length("shape")
    totals = shapes.groupBy("pos").agg(
        F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("distinct_shapes"),
        (F.min(length) == F.max(length)).alias("constant_length"),
        F.min(length).alias("length_min"), F.max(length).alias("length_max"),
    )
    rank = Window.partitionBy("pos").orderBy(F.col("cnt").desc(), F.col("shape"))
    top = shapes.withColumn("position", F.row_number().over(rank)).filter(F.col("position") <= k)
    return top.join(F.broadcast(totals), "pos").select(
        "pos", "position", "shape", F.col("cnt").alias("count"),
        (F.col("cnt") / F.col("n") * 100).alias("percentage"), "example",
        "distinct_shapes", "constant_length", "length_min", "length_max",
    )


def text_shapes(
    df: DataFrame, columns: Sequence[str] | None = None, repeated: bool = True
) -> DataFrame:
    values, fields = text_values(df, columns, repeated)
    ranked = shape_ranking(values)
    return _named(
        fields,
        ranked.withColumn(
            "is_regular", (F.col("position") == 1) & (F.col("percentage") >= REGULAR_SHARE)
        ),
    )


def _position_classes(members: DataFrame) -> DataFrame:
    """Per character position of each (pos, shape): which classes of character occur."""
    chars = members.select(
        "pos", "shape", F.posexplode(tx.characters(F.col("value"))).alias("at", "c")
    )
    c = F.col("c")
    return chars.groupBy("pos", "shape", "at").agg(
        F.bool_or(c.rlike(r"^\p{Nd}$")).alias("digit"),
        F.bool_or(c.rlike(r"^\p{Lu}$")).alias("upper"),
        F.bool_or(c.rlike(r"^\p{Ll}$")).alias("lower"),
        F.bool_or(~c.rlike(r"^[\p{L}\p{N}]$")).alias("other"),
        F.bool_and(c.rlike(r"^\p{Lu}$")).alias("all_upper"),
        F.bool_and(c.rlike(r"^\p{Ll}$")).alias("all_lower"),
        # At most the alphabet in use at one position of one shape.
        F.array_sort(F.collect_set(c)).alias("chars"),
    )


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([^A-Za-z0-9_])", r"\\$1")


def _pattern_part() -> Column:
    """The regular-expression class of one position."""
    d, u, lo, other = (F.col(x) for x in ("digit", "upper", "lower", "other"))
    listed = F.concat(
        F.lit("["), F.array_join(F.transform("chars", _escaped), ""), F.lit("]")
    )
    by_class = (
        F.when(d & u & lo, "[A-Za-z0-9]").when(d & u, r"(?:\d|[A-Z])")
        .when(d & lo, r"(?:\d|[a-z])").when(u & lo, "[A-Za-z]")
        .when(d, r"\d").when(u, "[A-Z]").when(lo, "[a-z]")
    )
    single = _escaped(F.element_at("chars", 1))
    literal = F.when(F.size("chars") == 1, single).otherwise(listed)
    return F.coalesce(F.when(~other, by_class), literal)


def _display_part() -> Column:
    """The readable class of one position; case as observed."""
    mark = F.substring(F.col("shape"), F.col("at") + 1, F.lit(1))
    letters = F.when(F.col("all_upper"), "[A-Z]").when(F.col("all_lower"), "[a-z]").otherwise(
        "[A-Za-z]"
    )
    return F.when(mark == "9", "[0-9]").when(mark == "A", letters).otherwise(mark)


def _counted(run: Column, body: Column) -> Column:
    return F.concat(body, F.lit("{"), run["n"].cast("string"), F.lit("}"))


def _join_display(parts: Column) -> Column:
    return F.array_join(
        F.transform(
            tx.run_lengths(parts),
            lambda r: F.when(r["n"] == 1, r["t"])
            .when(r["t"].startswith("["), _counted(r, r["t"]))
            .otherwise(F.repeat(r["t"], r["n"])),
        ),
        "",
    )


def _join_pattern(parts: Column) -> Column:
    body = F.array_join(
        F.transform(
            tx.run_lengths(parts),
            lambda r: F.when(r["n"] == 1, r["t"])
            .when(
                r["t"].startswith("\\"),
                _counted(r, F.concat(F.lit("(?:"), r["t"], F.lit(")"))),
            )
            .otherwise(_counted(r, r["t"])),
        ),
        "",
    )
    return F.concat(F.lit("^"), body, F.lit("$"))


def shape_details(values: DataFrame) -> DataFrame:
    """T4, T5 per position: the dominant shape in readable form and as a pattern.

    The pattern is read from every member of the shape, so all of them match it.
    """
    cased = cased_shapes(values)
    return described_shapes(cased, ranked_shapes(cased, k=1))


def described_shapes(cased: DataFrame, ranked: DataFrame) -> DataFrame:
    """T4, T5 over cased_shapes() and ranked_shapes().

    Members of a shape differ in the case of letters and in digits only, so its cased
    shapes say which classes a position holds; the values' characters are not needed.
    """
    dominant = ranked.filter("position = 1").select(
        "pos", "shape", F.col("percentage").alias("dominant_coverage_percentage"),
        "distinct_shapes", "constant_length",
    )
    members = cased.select("pos", "shape", F.col("cased").alias("value")).join(
        F.broadcast(dominant.select("pos", "shape")), ["pos", "shape"], "left_semi"
    )
    positions = _position_classes(members).withColumn("part", _pattern_part()).withColumn(
        "shown", _display_part()
    )
    # One row per character position of one shape; shapes average 64 characters at most.
    folded = positions.groupBy("pos", "shape").agg(
        F.sort_array(F.collect_list(F.struct("at", "part", "shown"))).alias("parts")
    )
    regular = F.col("dominant_coverage_percentage") >= REGULAR_SHARE
    return dominant.join(F.broadcast(folded), ["pos", "shape"], "left").select(
        "pos", F.col("shape").alias("dominant_shape"), "dominant_coverage_percentage",
        "distinct_shapes", regular.alias("is_regular"), "constant_length",
        tx.collapse_shape(F.col("shape")).alias("collapsed_shape"),
        _join_display(F.col("parts.shown")).alias("display_shape"),
        F.when(regular & (F.col("shape") != ""), _join_pattern(F.col("parts.part"))).alias(
            "suggested_regex"
        ),
    )


def shape_descriptions(
    df: DataFrame, columns: Sequence[str] | None = None, repeated: bool = True
) -> DataFrame:
    values, fields = text_values(df, columns, repeated)
    return _named(fields, shape_details(values))


def separator_summary(values: DataFrame, k: int = TOP_SEPARATORS) -> DataFrame:
    """T6 per position: the k most frequent separator characters, by rows and repeats.

    What stands between separators is taken out in whole runs, and characters are counted
    inside the map tasks.
    """
    rest = F.regexp_replace("value", tx.PLAIN_RUN, "")
    found = values.select("pos", "cnt", F.explode(F.split(rest, "")).alias("c")).filter("c <> ''")
    counted = found.groupBy("pos", F.col("c").alias("separator")).agg(F.sum("cnt").alias("count"))
    rank = Window.partitionBy("pos").orderBy(F.col("count").desc(), F.col("separator"))
    return counted.withColumn("position", F.row_number().over(rank)).filter(
        F.col("position") <= k
    )


def separator_characters(
    df: DataFrame, columns: Sequence[str] | None = None, repeated: bool = True
) -> DataFrame:
    values, fields = text_values(df, columns, repeated)
    return _named(fields, separator_summary(values))


def disguised_missing_tokens(values: DataFrame, row_count: DataFrame) -> DataFrame:
    """T7 per (position, token): rows that hold a word for "no value".

    A token on half of the rows or more is a real category. `row_count` is a
    one-row frame with `rows`.
    """
    token = F.lower(strip(F.col("value")))
    hits = values.select("pos", token.alias("token"), "cnt").filter(
        F.col("token").isin(*tx.DISGUISED_MISSING)
    ).groupBy("pos", "token").agg(F.sum("cnt").alias("count"))
    rank = Window.partitionBy("pos").orderBy(F.col("count").desc(), F.col("token"))
    # At most one row per token and column; `row_count` is a single row.
    return (
        hits.join(F.broadcast(row_count))
        .filter((F.col("rows") == 0) | (F.col("count") / F.col("rows") < DISGUISED_MAX_SHARE))
        .drop("rows")
        .withColumn("position", F.row_number().over(rank))
    )


def disguised_missing(
    df: DataFrame, columns: Sequence[str] | None = None, repeated: bool = False
) -> DataFrame:
    """The five most frequent disguised-missing tokens per column."""
    values, fields = text_values(df, columns, repeated)
    hits = disguised_missing_tokens(values, df.agg(F.count(F.lit(1)).alias("rows")))
    total = F.sum("count").over(Window.partitionBy("pos"))
    return _named(
        fields,
        hits.withColumn("disguised_missing_count", total)
        .filter(F.col("position") <= TOP_TOKENS)
        .select("pos", "position", "token", "count", "disguised_missing_count"),
    )


def _normalised(values: DataFrame) -> DataFrame:
    spelled = F.regexp_replace(strip(F.col("value")), tx.ANY_WHITESPACE + "+", " ")
    return values.select("pos", spelled.alias("spelling")).withColumn(
        "norm", F.lower("spelling")
    )


def variant_summary(values: DataFrame) -> DataFrame:
    """T8 per position: number of variant groups and of normalised values."""
    distinct = _normalised(values).groupBy("pos", "norm").agg(
        F.min(F.xxhash64("spelling")).alias("lo"), F.max(F.xxhash64("spelling")).alias("hi")
    )
    return distinct.groupBy("pos").agg(
        F.count(F.lit(1)).alias("normalized_distinct_count"),
        F.count_if(F.col("lo") != F.col("hi")).alias("case_variant_groups"),
    )


def case_variants(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Counts of case/whitespace variant groups per column."""
    values, fields = text_values(df, columns)
    return _named(fields, variant_summary(values))


def case_variant_examples(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The three largest variant groups per column with three spellings each."""
    values, fields = text_values(df, columns)
    spellings = _normalised(values).distinct()
    groups = spellings.groupBy("pos", "norm").agg(F.count(F.lit(1)).alias("spellings")).filter(
        F.col("spellings") > 1
    )
    best = Window.partitionBy("pos").orderBy(F.col("spellings").desc(), F.col("norm"))
    top = groups.withColumn("position", F.row_number().over(best)).filter(
        F.col("position") <= VARIANT_EXAMPLES
    )
    inside = Window.partitionBy("pos", "norm").orderBy("spelling")
    # Three groups per table column on the broadcast side.
    shown = (
        spellings.join(F.broadcast(top), ["pos", "norm"])
        .withColumn("r", F.row_number().over(inside))
        .filter(F.col("r") <= VARIANT_EXAMPLES)
        .groupBy("pos", "position", "norm", "spellings")
        .agg(F.array_sort(F.collect_list("spelling")).alias("examples"))
    )
    return _named(fields, shown.drop("norm"))


def whitespace_padding(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Values with leading or trailing whitespace around real text; no text is shuffled."""
    values, fields = text_values(df, columns, repeated=False)
    v = F.col("value")
    padded = (v != strip(v)) & (strip(v) != F.lit(""))
    return _named(fields, values.groupBy("pos").agg(_weighted(padded).alias("padded_count")))


def text_storage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """C10 for text: every value looks like a number; no text is shuffled."""
    values, fields = text_values(df, columns, repeated=False)
    numeric = _weighted(tx.pattern_flags(F.col("value"))["numeric_like"])
    counted = values.groupBy("pos").agg(numeric.alias("numeric_like"), F.sum("cnt").alias("n"))
    return _named(
        fields,
        counted.select(
            "pos", F.lit("string").alias("stored_as"),
            percent(F.col("numeric_like"), F.col("n")).alias("numeric_like_percentage"),
            (F.col("numeric_like") == F.col("n")).alias("semantic_storage_mismatch"),
        ),
    )
