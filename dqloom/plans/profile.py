"""Full profile of a table: one row per column, plus the table-level findings.

Rows are scanned once for plain counts and moments; distinct-value work hangs off
one frequency shuffle per storage kind. What comes back to the driver is one row
per column, never per row of the table.
"""

from __future__ import annotations

import datetime
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow.lib import ArrowException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from dqloom.functions import names
from dqloom.functions.missing import is_blank, is_empty, strip
from dqloom.operators import counts, dates, numeric, tables, text
from dqloom.operators.frequency import (
    LONG_TEXT,
    Field,
    fields_of,
    numeric_values,
    spelled_out,
    text_values,
    value_frequencies,
)
from dqloom.operators.ranks import exact_quantiles, quantile_columns

LEVEL = StorageLevel.MEMORY_AND_DISK


def small(frame: DataFrame) -> DataFrame:
    """Evaluate a schema-sized frame (rows per column, not per row) once."""
    try:
        return frame.sparkSession.createDataFrame(frame.toArrow())
    except ArrowException:  # absent structs whose fields Arrow marks as never null
        return frame.sparkSession.createDataFrame(frame.collect(), frame.schema).coalesce(1)


def together(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Evaluate independent schema-sized frames as concurrent Spark jobs."""
    with ThreadPoolExecutor(max_workers=8) as pool:
        return dict(zip(frames, pool.map(small, frames.values())))


def _struct(columns: list[str], name: str) -> Column:
    return F.struct(*columns).alias(name)


COUNTS = {
    "row_count": lambda f: F.count(F.lit(1)), "non_null": lambda f: F.count(f.value),
}
TEXT_COUNTS = {
    **COUNTS,
    "empty_string_count": lambda f: F.count_if(is_empty(f.value)),
    "whitespace_only_count": lambda f: F.count_if(is_blank(f.value)),
    "leading_trailing_whitespace_count": lambda f: F.count_if(
        (f.value != strip(f.value)) & (strip(f.value) != F.lit(""))
    ),
    "longest": lambda f: F.max(F.length(f.value)),
}


def _time_counts(as_of: str | datetime.datetime) -> dict:
    def stamp(f):
        return f.value.cast("timestamp")

    return {
        **COUNTS,
        "t_min": lambda f: F.min(stamp(f)), "t_max": lambda f: F.max(stamp(f)),
        "t_clock": lambda f: F.bool_or(stamp(f) != F.date_trunc("day", stamp(f))),
        "t_future": lambda f: F.count_if(stamp(f) > F.lit(str(as_of)).cast("timestamp")),
    }


def scans(df: DataFrame, as_of: str | datetime.datetime) -> dict[str, DataFrame]:
    """What plain scans can say: one aggregation per storage kind, over its columns only."""
    wanted = {
        "numeric": {**COUNTS, **numeric.MOMENTS}, "string": TEXT_COUNTS,
        "datetime": _time_counts(as_of), "boolean": COUNTS, "other": COUNTS,
    }
    out = {}
    for kind, metrics in wanted.items():
        fields = fields_of(df, kinds=[kind])
        if fields:
            out["scan_" + kind] = counts.wide_to_long(df, fields, metrics)
    return out


def _merged(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    for name in TEXT_COUNTS:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(0).cast("long"))
    return out.fillna(0, [
        "empty_string_count", "whitespace_only_count", "leading_trailing_whitespace_count",
    ])


def _numeric_block(scan: DataFrame, vft: DataFrame) -> DataFrame:
    values = numeric_values(vft)
    first = together({
        "q": quantile_columns(
            exact_quantiles(values, ["pos"], list(numeric.QUANTILES)), ["pos"], numeric.QUANTILES
        ).withColumn("iqr", F.col("q75") - F.col("q25")).withColumn("median", F.col("q50")),
        "sequence": numeric.sequence_summary(values),
        "zeros": numeric.leading_zero_summary(
            values.filter((F.col("v") == F.rint("v")) & (F.abs("v") < F.lit(1e18)))
        ).drop("modal_length"),
    })
    second = together({
        "mad": numeric.median_absolute_deviation(values, first["q"]),
        "outliers": numeric.iqr_outliers(values, first["q"]).withColumnsRenamed({
            "outlier_count": "outlier_count_iqr", "outlier_percentage": "outlier_percentage_iqr",
        }),
    })
    out = scan.filter(F.col("count") > 0).withColumn(
        "skewness", numeric.adjusted_skew()
    ).select("pos", *[m for m in numeric.MOMENTS if m != "raw_skew"], "skewness")
    for part in (first["q"], second["mad"], second["outliers"], first["sequence"], first["zeros"]):
        out = out.join(part, "pos", "left")
    return out


def _code_shapes(vft: DataFrame, positions: list[int]) -> DataFrame:
    """Shapes of the digits of code-like whole numbers: they differ in length only, so
    one row of digits per length stands for all."""
    lengths = small(numeric.digit_lengths(numeric_values(vft.filter(F.col("pos").isin(positions)))))
    return text.shape_details(lengths.select(
        "pos", F.repeat(F.lit("9"), F.col("digits")).alias("value"), "cnt"))


def _text_block(
    values: DataFrame, row_count: DataFrame, fields: list[Field], as_of
) -> tuple[DataFrame, DataFrame]:
    """(text block, date block) per position."""
    cased = text.cased_shapes(values).persist(LEVEL)
    try:
        parts = together({"ranked": text.ranked_shapes(cased), **_text_parts(values, row_count, fields)})
        parts["details"] = small(text.described_shapes(cased, parts["ranked"]))
    finally:
        cased.unpersist()
    parts["shapes"] = parts["ranked"].groupBy("pos").agg(
        F.sort_array(
            F.collect_list(F.struct("position", "shape", "count", "percentage", "example"))
        ).alias("top_shapes"),
    )
    block = parts["lengths"]
    for name in ("patterns", "separators", "shapes", "details", "missing", "variants", "zeros"):
        block = block.join(parts[name], "pos", "left")
    # Only columns that hold dates are parsed again.
    found = [r["pos"] for r in parts["formats"].select("pos").collect()]
    dated = values.filter(F.col("pos").isin(found)) if found else values.limit(0)
    return block, small(dates.date_statistics(dated, parts["formats"], as_of))


def _text_parts(values: DataFrame, row_count: DataFrame, fields: list[Field]) -> dict[str, DataFrame]:
    """The text operators that read the values themselves."""
    value = F.col("value")
    return {
        "lengths": text.length_summary(values),
        "patterns": text.pattern_summary(values),
        "zeros": values.groupBy("pos").agg(
            F.bool_or(strip(value).rlike(r"^0\d+$")).alias("leading_zero_text")
        ),
        "separators": text.separator_summary(values).groupBy("pos").agg(
            F.sort_array(F.collect_list(F.struct("position", "separator", "count"))).alias(
                "separator_characters"
            )
        ),
        "missing": text.disguised_missing_tokens(values, row_count).groupBy("pos").agg(
            F.sum("count").alias("disguised_missing_count"),
            F.sort_array(F.collect_list(F.when(
                F.col("position") <= text.TOP_TOKENS, F.struct("position", "token", "count")
            ))).alias("disguised_missing_values"),
        ),
        "variants": text.variant_summary(values),
        "formats": dates.detect_formats(values, fields),
    }


DATE_BLOCK = [
    "detected_format", "format_ambiguous", "format_confidence_percentage",
    "parse_success_percentage", "count", "min", "max", "span_days", "has_time_component",
    "future_date_percentage",
]


def _datetime_block(scan: DataFrame) -> DataFrame:
    none = F.lit(None)
    n = F.col("non_null")
    micros = F.unix_micros("t_max") - F.unix_micros("t_min")
    return scan.filter(F.col("t_min").isNotNull()).select(
        "pos", none.cast("string").alias("detected_format"), F.lit(False).alias("format_ambiguous"),
        none.cast("double").alias("format_confidence_percentage"),
        counts.percent(n, F.col("row_count")).alias("parse_success_percentage"),
        n.alias("count"), F.col("t_min").alias("min"), F.col("t_max").alias("max"),
        (micros / 86_400_000_000).alias("span_days"), F.col("t_clock").alias("has_time_component"),
        counts.percent(F.col("t_future"), n).alias("future_date_percentage"),
    )


def column_profile(df: DataFrame, as_of: str | datetime.datetime) -> DataFrame:
    """One row per column with counts and numeric, text, datetime and categorical blocks.

    One scan, then one frequency shuffle for numbers and one for everything else.
    The two frequency frames are kept while the operators read them; a lost
    executor only makes its own pieces run again.
    """
    fields = fields_of(df)
    spark = df.sparkSession
    catalog = spark.createDataFrame(
        [(f.pos, f.name, f.dtype.simpleString(), f.kind) for f in fields],
        "pos int, column_name string, data_type string, stored_as string",
    )
    numbers = [f.name for f in fields if f.kind == "numeric"]
    others = [f.name for f in fields if f.kind != "numeric"]
    number_vft = value_frequencies(df, numbers).persist(LEVEL) if numbers else None
    other_vft = (
        value_frequencies(df, others, digest_over=LONG_TEXT).persist(LEVEL) if others else None
    )
    try:
        wanted = scans(df, as_of)
        for name, members, vft in (("n", numbers, number_vft), ("o", others, other_vft)):
            if vft is not None:
                wanted["distinct_" + name] = counts.distinct_summary(vft).drop("top_count")
                wanted["top_" + name] = counts.top_values(df, members, vft=vft, k=counts.LISTED_VALUES)
        got = together(wanted)
        if others:
            got["distinct_o"] = spelled_out(df, got["distinct_o"], "representative_value", "pos")
            got["top_o"] = spelled_out(df, got["top_o"], "value")
        scan = _merged([got[k] for k in got if k.startswith("scan_")])
        out = catalog.join(scan.select(
            "pos", "row_count", "non_null", "empty_string_count", "whitespace_only_count",
            "leading_trailing_whitespace_count",
        ), "pos")
        summary = _union([got[k] for k in got if k.startswith("distinct_")])
        out = out.join(summary, "pos", "left")
        packed = _union([got[k] for k in got if k.startswith("top_")]).groupBy("column_name").agg(
            F.sort_array(F.collect_list(F.when(
                F.col("position") <= counts.TOP_VALUES, F.struct("position", "value", "count", "percentage")
            ))).alias("top_values"),
            F.sort_array(F.collect_list(F.when(
                F.col("category_count") <= counts.LISTED_VALUES, F.struct("position", "value")
            ))).alias("listed"),
        ).withColumn("category_values", F.when(
            F.size("listed") > 0, F.transform("listed", lambda v: v["value"])
        )).drop("listed")
        out = out.join(packed, "column_name", "left")
        if number_vft is not None:
            block = _numeric_block(got["scan_numeric"], number_vft)
            columns = [c for c in block.columns if c != "pos"]
            out = out.join(block.select("pos", _struct(columns, "numeric")), "pos", "left")
        times = [_datetime_block(got["scan_datetime"])] if "scan_datetime" in got else []
        values = _text_source(df, fields, scan, other_vft)
        if values is not None:
            row_count = spark.createDataFrame(
                [(scan.select("row_count").first()[0],)], "rows long"
            )
            block, texts = _text_block(values, row_count, fields, as_of)
            columns = [c for c in block.columns if c != "pos"]
            out = out.join(block.select("pos", _struct(columns, "text")), "pos", "left")
            times.append(texts.select("pos", *DATE_BLOCK))
        if times:
            dated = _union(times).select("pos", _struct(DATE_BLOCK, "datetime"))
            out = out.join(dated, "pos", "left")
        out = small(_finish(out))
        codes = [r["pos"] for r in out.filter("code_like AND numeric.integer_valued").collect()]
        if codes:
            shapes = small(_code_shapes(number_vft, codes))
            columns = [c for c in shapes.columns if c != "pos"]
            shapes = shapes.select("pos", F.struct(*columns).cast(SHAPE_BLOCK).alias("shape"))
        else:
            shapes = spark.createDataFrame([], f"pos int, shape {SHAPE_BLOCK}")
        return out.join(shapes, "pos", "left")
    finally:
        for vft in (number_vft, other_vft):
            if vft is not None:
                vft.unpersist()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _text_source(
    df: DataFrame, fields: list[Field], scan: DataFrame, vft: DataFrame | None
) -> DataFrame | None:
    """(pos, value, cnt) of the text columns.

    Short text comes from the frequency frame. Columns with long text, whose
    frequency rows only hold digests, are read again row by row without a shuffle.
    """
    texts = [f for f in fields if f.kind == "string"]
    if not texts:
        return None
    longest = {r["pos"]: r["longest"] or 0 for r in scan.select("pos", "longest").collect()}
    short = [f.pos for f in texts if longest[f.pos] <= LONG_TEXT]
    long = [f.name for f in texts if longest[f.pos] > LONG_TEXT]
    parts = []
    if short:
        parts.append(
            vft.filter(F.col("pos").isin(short)).select("pos", F.col("s").alias("value"), "cnt")
        )
    if long:
        parts.append(text_values(df, long, repeated=False)[0])
    return _union(parts)


SHAPE_BLOCK = (
    "struct<dominant_shape:string,dominant_coverage_percentage:double,distinct_shapes:bigint,"
    "is_regular:boolean,constant_length:boolean,collapsed_shape:string,display_shape:string,"
    "suggested_regex:string>"
)
EMPTY_BLOCKS = {
    "numeric": "struct<count:bigint,min:double,max:double,mean:double,std:double,"
               "zero_count:bigint,negative_count:bigint,positive_count:bigint,"
               "integer_valued:boolean,max_decimal_places:int,skewness:double,p01:double,"
               "p05:double,q25:double,q50:double,q75:double,p95:double,p99:double,iqr:double,"
               "median:double,mad:double,outlier_count_iqr:bigint,outlier_percentage_iqr:double,"
               "step_one:boolean,dense:boolean,counter_like:boolean,"
               "leading_zero_loss_suspected:boolean,leading_zero_loss_count:bigint,"
               "digit_length_distribution:string>",
    "text": "struct<min_length:bigint,max_length:bigint,mean_length:double,median_length:double,"
            "free_text:boolean,email_like:bigint,phone_like:bigint,postal_like:bigint,"
            "currency_like:bigint,numeric_like:bigint,date_like:bigint,alphanumeric_like:bigint,"
            "contains_whitespace:bigint,contains_special_character:bigint,"
            "separator_characters:array<struct<position:int,separator:string,count:bigint>>,"
            "top_shapes:array<struct<position:int,shape:string,count:bigint,percentage:double,"
            "example:string>>,dominant_shape:string,dominant_coverage_percentage:double,"
            "distinct_shapes:bigint,is_regular:boolean,constant_length:boolean,"
            "collapsed_shape:string,display_shape:string,suggested_regex:string,"
            "disguised_missing_count:bigint,disguised_missing_values:array<struct<position:int,"
            "token:string,count:bigint>>,normalized_distinct_count:bigint,"
            "case_variant_groups:bigint,leading_zero_text:boolean>",
    "datetime": "struct<detected_format:string,format_ambiguous:boolean,"
                "format_confidence_percentage:double,parse_success_percentage:double,"
                "count:bigint,min:timestamp,max:timestamp,span_days:double,"
                "has_time_component:boolean,future_date_percentage:double>",
    "top_values": "array<struct<position:int,value:string,count:bigint,percentage:double>>",
    "category_values": "array<string>",
}


def _finish(out: DataFrame) -> DataFrame:
    """Name evidence, identifier likeness and storage verdicts from the blocks."""
    for name, ddl in EMPTY_BLOCKS.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(ddl))
    name = F.col("column_name")
    strong = names.has_token(name, names.IDENTIFIER_STRONG_TOKENS)
    weak = names.has_token(name, names.IDENTIFIER_WEAK_TOKENS)
    by_name = names.has_token(name, names.CODE_LIKE_TOKENS)
    zero = F.lit(0).cast("long")
    out = out.withColumns({
        "non_null_count": F.col("non_null"),
        "null_count": F.col("row_count") - F.col("non_null"),
        "distinct_count": F.coalesce("distinct_count", zero),
        "duplicate_count": F.coalesce("duplicate_count", zero),
        "duplicate_excess_count": F.coalesce("duplicate_excess_count", zero),
        "distinct_percentage": F.coalesce("distinct_percentage", F.lit(0.0)),
        "top_value_share_percentage": F.col("top_value_share") * 100,
        "strong_name": strong,
        "identifier_name_signal": strong | weak,
    })
    unique = (F.col("non_null_count") > 0) & (F.col("distinct_count") == F.col("non_null_count"))
    out = out.withColumn("identifier_signal", unique & F.col("strong_name"))
    num = F.col("numeric")
    is_number = num.isNotNull()
    integer = F.coalesce(num["integer_valued"], F.lit(False))
    counter = F.coalesce(num["counter_like"], F.lit(False))
    code_like = is_number & (by_name | (integer & (counter | F.col("identifier_signal"))))
    constant = F.coalesce(F.col("constant"), F.lit(True))
    free_text = F.coalesce(F.col("text.free_text"), F.lit(False))
    is_text = F.col("text").isNotNull()
    id_number = is_number & integer & ~constant & F.col("strong_name")
    id_text = is_text & ~free_text & (F.col("identifier_signal") | F.col("strong_name"))
    regular = F.coalesce(F.col("text.is_regular"), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(is_text & id_text & F.col("identifier_signal"), "unique_with_name_signal"),
        F.when((is_text & id_text & F.col("strong_name")) | id_number, "name_signal"),
        F.when(id_text & regular, "regular_shape"),
        F.when(is_number & counter, "counter_like"),
    ))
    sentinel, sentinel_share = numeric.sentinel_expression()
    rows = F.col("row_count")
    return out.select(
        "pos", "column_name", "data_type", "stored_as", "row_count", "non_null_count",
        "null_count",
        counts.percent(F.col("null_count"), rows).alias("null_percentage"),
        "empty_string_count",
        counts.percent(F.col("empty_string_count"), rows).alias("empty_string_percentage"),
        "whitespace_only_count",
        counts.percent(F.col("whitespace_only_count"), rows).alias("whitespace_only_percentage"),
        "leading_trailing_whitespace_count",
        "distinct_count", "distinct_percentage", "duplicate_count", "duplicate_excess_count",
        constant.alias("constant"),
        F.coalesce(F.col("near_constant"), F.lit(False)).alias("near_constant"),
        "top_value_share_percentage", "representative_value",
        "strong_name", "identifier_name_signal", "identifier_signal",
        (id_number | id_text).alias("identifier_like"),
        reasons.alias("identifier_like_reasons"),
        ((id_number | id_text) & (F.col("distinct_percentage") < 100)).alias("identifier_repeats"),
        code_like.alias("code_like"),
        F.when(is_number, sentinel).alias("sentinel_value"),
        F.when(is_number, sentinel_share).alias("sentinel_percentage"),
        (F.when(is_number, code_like)
         .when(is_text, F.col("text.numeric_like") == F.col("non_null_count"))
         .otherwise(F.lit(False))).alias("semantic_storage_mismatch"),
        ((code_like & integer & F.coalesce(num["leading_zero_loss_suspected"], F.lit(False)))
         | (is_text & by_name & F.coalesce(F.col("text.leading_zero_text"), F.lit(False)))).alias(
            "leading_zero_loss_suspected"),
        (is_number & ~integer & ~constant).alias("float_measure"),
        free_text.alias("free_text"),
        "numeric", "text", "datetime", "top_values", "category_values",
    )


@dataclass
class TableProfile:
    """A table's profile. Every frame here has schema-sized or report-sized content."""

    table_name: str
    columns: DataFrame
    duplicates: DataFrame
    completeness: DataFrame
    co_missing: DataFrame
    composites: DataFrame
    dependencies: DataFrame
    observations: DataFrame


def column_facts(columns: DataFrame) -> list[dict]:
    """What key and dependency search needs to know per column."""
    rows = columns.select(
        "column_name", "distinct_count", "non_null_count", "row_count",
        F.col("constant").alias("is_constant"), F.col("float_measure").alias("is_float_measure"),
        F.col("free_text").alias("is_free_text"),
        (F.col("identifier_like") | F.col("code_like")).alias("is_key_like"),
    ).collect()
    return [r.asDict() for r in rows]


def dependency_columns(facts: list[dict], limit: int | None = None) -> list[str]:
    """Columns that can take part in a dependency, least distinct first."""
    ratio = {
        c["column_name"]: c["distinct_count"] / c["non_null_count"] for c in facts
        if not (c["is_constant"] or c["is_free_text"] or c["is_float_measure"])
        and c["non_null_count"] > 0 and c["distinct_count"] >= 2
        and not c["column_name"].startswith("Unnamed:")
    }
    chosen = sorted(
        (c for c, r in ratio.items() if r <= tables.FD_UNIQUE_RATIO), key=lambda c: (ratio[c], c)
    )
    return chosen[:limit]


def table_dependencies(df: DataFrame, facts: list[dict]) -> DataFrame:
    """Every dependency left after reduction; broken pairs come last."""
    chosen = dependency_columns(facts)
    if len(chosen) < 2:
        return df.sparkSession.createDataFrame([], tables.FD_SCHEMA)
    # Pairs of column names: evaluated once, as the reduction reads them four times.
    counts_of = {c["column_name"]: c["distinct_count"] for c in facts}
    pairs = small(tables.functional_dependencies(df, chosen, distinct=counts_of, row_count=facts[0]["row_count"]))
    return tables.reduce_dependencies(pairs).orderBy(
        F.col("coverage_percentage").desc(), "determinant", "dependent"
    )


def profile_table(
    df: DataFrame, table_name: str, as_of: str | datetime.datetime
) -> TableProfile:
    """The full profile of a table, evaluated."""
    from dqloom.plans.observations import observations

    columns = small(column_profile(df, as_of))
    facts = column_facts(columns)
    row_count = facts[0]["row_count"] if facts else 0
    with ThreadPoolExecutor(max_workers=3) as pool:
        keys = pool.submit(tables.composite_candidates, df, facts, row_count)
        pairs = pool.submit(lambda: small(table_dependencies(df, facts)))
        plain = together({
            "duplicates": tables.duplicate_rows(df), "completeness": tables.row_completeness(df),
            "co_missing": tables.co_missing_patterns(df),
        })
        composites, dependencies = keys.result(), pairs.result()
    duplicates, completeness = plain["duplicates"], plain["completeness"]
    co_missing = plain["co_missing"]
    found = observations(columns, duplicates, completeness, composites, dependencies)
    return TableProfile(
        table_name, columns, duplicates, completeness, co_missing, composites, dependencies, found
    )


def dataset_profile(tables_by_name: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns, cells and nulls per table, and the dataset's totals."""
    out: DataFrame | None = None
    for name, df in tables_by_name.items():
        fields = fields_of(df)
        filled = sum((F.count(f.value) for f in fields), F.lit(0))
        part = df.agg(F.count(F.lit(1)).alias("row_count"), filled.alias("filled")).select(
            F.lit(name).alias("table_name"), "row_count",
            F.lit(len(fields)).cast("long").alias("column_count"),
            (F.col("row_count") * len(fields) - F.col("filled")).alias("null_count"),
        )
        out = part if out is None else out.unionByName(part)
    total = out.agg(
        F.lit("(dataset)").alias("table_name"), F.sum("row_count").alias("row_count"),
        F.sum("column_count").alias("column_count"), F.sum("null_count").alias("null_count"),
    )
    return out.unionByName(total)

