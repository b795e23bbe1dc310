"""Which metrics apply to a column, and which rules to propose. Metadata only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqloom.operators.scoring import METRICS

# Concept names with a known domain, and ranking weights.
IDENTIFIER_CONCEPTS = (
    "Customer ID", "Account ID", "Product ID", "Order ID", "Employee ID",
    "Loyalty Member ID", "Identifier",
)
EMAIL_CONCEPTS = ("Email", "Email Address")
PHONE_CONCEPTS = ("Phone", "Phone Number", "Telephone")
GEO_CONCEPTS = (
    "Country", "State", "City", "Region", "Province", "Postal Code", "Zip Code",
)
RANK_WEIGHTS = {
    "approved_key": 0.30, "identifier_semantic": 0.25, "identifier_signal": 0.20,
    "observed_uniqueness": 0.15, "pattern_evidence": 0.10, "approved_relationship": 0.30,
}
DATE_PAIRS = (
    ("start", "end"), ("begin", "end"), ("created", "closed"), ("opened", "closed"),
    ("effective", "expiry"), ("effective", "expiration"),
)
APPROVED = ("approved", "edited", "manual")
YES, NO, REVIEW = "APPLICABLE", "NOT_APPLICABLE", "NEEDS_REVIEW"
MEANING_SCHEMA = "table_name string, column_name string, concept string"
KEY_SCHEMA = "table_name string, key_columns array<string>, status string"
LINK_SCHEMA = (
    "parent_table string, parent_column string, child_table string, child_column string, "
    "status string"
)
REQUIRED_SCHEMA = "table_name string, column_name string, metric string, required boolean"


def column_context(
    columns: DataFrame, meanings: DataFrame | None = None, keys: DataFrame | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """Profile rows with final meaning, key membership and relationships attached.

    `columns` is a column profile with table_name. `keys` lists key candidates with
    their member columns as an array, `links` relationship candidates.
    """
    spark = columns.sparkSession
    own = ["table_name", "column_name"]
    meanings = spark.createDataFrame([], MEANING_SCHEMA) if meanings is None else meanings
    keys = spark.createDataFrame([], KEY_SCHEMA) if keys is None else keys
    links = spark.createDataFrame([], LINK_SCHEMA) if links is None else links
    approved = F.col("status").isin(*APPROVED)
    pending = ~F.col("status").isin(*APPROVED, "rejected")
    members = keys.select(
        "table_name", F.explode("key_columns").alias("column_name"), "status"
    ).groupBy(*own).agg(
        F.bool_or(approved).alias("approved_key"), F.bool_or(pending).alias("pending_key")
    )
    parents = links.select(
        F.col("child_table").alias("table_name"), F.col("child_column").alias("column_name"),
        "parent_table", "parent_column", "status",
    ).groupBy(*own).agg(
        F.array_sort(F.collect_list(
            F.when(approved, F.struct("parent_table", "parent_column"))
        )).alias("parents"),
        F.bool_or(F.col("status") == "pending").alias("pending_link"),
    )
    inside = links.filter(approved & (F.col("child_table") == F.col("parent_table"))).select(
        F.col("child_table").alias("table_name")
    ).distinct().withColumn("inner_link", F.lit(True))
    out = columns.join(meanings.select(*own, "concept"), own, "left")
    out = out.join(members, own, "left").join(parents, own, "left").join(
        inside, "table_name", "left")
    no = F.lit(False)
    return out.withColumns({
        flag: F.coalesce(flag, no) for flag in
        ("approved_key", "pending_key", "pending_link", "inner_link")
    }).withColumn(
        "parents", F.coalesce("parents", F.array().cast(
            "array<struct<parent_table:string,parent_column:string>>"))
    )


def _concept_in(words) -> Column:
    return F.coalesce(F.col("concept").isin(*words), F.lit(False))


def _is_date() -> Column:
    return F.col("datetime").isNotNull() | (F.col("stored_as") == "datetime")


def metric_status() -> dict[str, Column]:
    """Status of each metric for a column in context."""
    identifier = _concept_in(IDENTIFIER_CONCEPTS)
    signal = F.coalesce("identifier_signal", F.lit(False))
    unique = (
        F.when(F.col("approved_key") | (identifier & signal), YES)
        .when(identifier | signal | F.col("pending_key"), REVIEW).otherwise(NO)
    )
    shaped = (
        _concept_in(EMAIL_CONCEPTS) | F.col("numeric").isNotNull() | _is_date()
        | F.col("top_values").isNotNull()
        | F.coalesce((F.col("text.email_like") > 0) | (F.col("text.date_like") > 0), F.lit(False))
    )
    verifiable = _concept_in(EMAIL_CONCEPTS + GEO_CONCEPTS + PHONE_CONCEPTS)
    related = F.col("inner_link") | _concept_in(GEO_CONCEPTS) | _is_date()
    return {
        "completeness": F.lit(YES), "uniqueness": unique,
        "validity": F.when(shaped, YES).otherwise(REVIEW),
        "accuracy": F.when(verifiable, REVIEW).otherwise(NO),
        "consistency": F.when(related, REVIEW).otherwise(NO),
        "referential_integrity": F.when(F.size("parents") > 0, YES)
        .when(F.col("pending_link"), REVIEW).otherwise(NO),
        "timeliness": F.when(_is_date(), REVIEW).otherwise(NO),
    }


def metric_reasons() -> dict[str, Column]:
    """The evidence behind each status."""
    none = F.lit(None).cast("string")

    def told(*pairs: tuple[Column, str]) -> Column:
        return F.array_compact(F.array(*[F.when(c, F.lit(t)).otherwise(none) for c, t in pairs]))

    signal = F.coalesce("identifier_signal", F.lit(False))
    patterns = {p: F.coalesce(F.col(f"text.{p}") > 0, F.lit(False)) for p in
                ("email_like", "date_like")}
    return {
        "completeness": told((F.lit(True), "measurable for every column")),
        "uniqueness": told(
            (F.col("approved_key"), "approved key"), (F.col("pending_key"), "pending key"),
            (_concept_in(IDENTIFIER_CONCEPTS), "identifier concept"),
            (signal, "identifier signal"),
            (F.col("distinct_percentage") < 99, "repeated values observed")),
        "validity": told(
            (_concept_in(EMAIL_CONCEPTS), "email concept"),
            (F.col("numeric").isNotNull(), "numeric"), (_is_date(), "dates"),
            (F.col("top_values").isNotNull(), "few distinct values"),
            (patterns["email_like"], "email pattern"), (patterns["date_like"], "date pattern")),
        "accuracy": told((F.lit(True), "needs an authoritative source")),
        "consistency": told(
            (F.col("inner_link"), "approved relationship inside the table"),
            (_concept_in(GEO_CONCEPTS), "geographic concept"), (_is_date(), "dates")),
        "referential_integrity": told(
            (F.size("parents") > 0, "approved relationship"),
            (F.col("pending_link"), "pending relationship")),
        "timeliness": told((_is_date(), "dates; the threshold has to be given")),
    }


def applicability(context: DataFrame) -> DataFrame:
    """Seven rows per column: metric, status, reasons."""
    status, reasons = metric_status(), metric_reasons()
    args: list[Column] = []
    for m in METRICS:
        args += [F.lit(m), status[m], reasons[m]]
    return context.select(
        "table_name", "column_name", "concept",
        F.stack(F.lit(len(METRICS)), *args).alias("metric", "status", "reasons"),
    )


def _confidence(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def _rule(
    frame: DataFrame, when: Column, metric: str, template: str, confidence: str | Column,
    score: float | Column, params: Column | None = None, columns: Column | None = None,
) -> DataFrame:
    as_column = (lambda v: v if isinstance(v, Column) else F.lit(v))
    return frame.filter(when).select(
        "table_name",
        (F.array("column_name") if columns is None else columns).alias("target_columns"),
        F.lit(metric).alias("metric"), F.lit(template).alias("rule_template"),
        (F.lit("{}") if params is None else F.to_json(params)).alias("parameters"),
        as_column(confidence).alias("confidence"),
        F.round(as_column(score).cast("double"), 4).alias("score"),
    )


def rule_candidates(
    context: DataFrame, composites: DataFrame | None = None, required: DataFrame | None = None
) -> DataFrame:
    """Proposed rules, one generator per kind, in a fixed order.

    `composites` has table_name and columns; `required` turns requiredness off per
    (table, column, metric). Observed bounds and value lists are only proposals.
    """
    spark = context.sparkSession
    status = metric_status()
    needs = spark.createDataFrame([], REQUIRED_SCHEMA) if required is None else required
    optional = needs.filter((F.col("metric") == "completeness") & ~F.col("required")).select(
        "table_name", "column_name", F.lit(True).alias("optional")
    )
    c = context.join(optional, ["table_name", "column_name"], "left").withColumn(
        "optional", F.coalesce("optional", F.lit(False))
    ).withColumns({f"is_{m}": s for m, s in status.items()})
    text = F.col("text").isNotNull() | (F.col("stored_as") == "string")
    must = ~F.col("optional")
    w = RANK_WEIGHTS

    def points(when: Column, name: str) -> Column:
        return F.when(when, w[name]).otherwise(F.lit(0.0))

    unique_score = (
        points(F.col("approved_key"), "approved_key")
        + points(_concept_in(IDENTIFIER_CONCEPTS), "identifier_semantic")
        + points(F.coalesce("identifier_signal", F.lit(False)), "identifier_signal")
        + points(F.col("distinct_percentage") >= 99, "observed_uniqueness")
    )
    number = F.col("numeric").isNotNull()
    emails = _concept_in(EMAIL_CONCEPTS) & F.coalesce(F.col("text.email_like") > 0, F.lit(False))
    flags = F.struct(F.lit(True).alias("ignore_nulls"), F.lit(True).alias("normalize_whitespace"))
    listed = F.struct(F.col("category_values").alias("allowed_values"))
    bounds = F.struct(F.col("numeric.min").alias("min"), F.col("numeric.max").alias("max"))
    linked = c.filter(F.size("parents") > 0).withColumn("p", F.explode("parents"))
    key = F.struct(
        F.col("p.parent_table").alias("parent_table"),
        F.col("p.parent_column").alias("parent_column"),
        F.col("table_name").alias("child_table"), F.col("column_name").alias("child_column"),
    )
    inner = linked.filter(
        (F.col("p.parent_table") == F.col("table_name"))
        & (F.col("p.parent_column") != F.col("column_name"))
    )
    depends = F.struct(
        F.col("p.parent_column").alias("determinant_column"),
        F.col("column_name").alias("dependent_column"),
    )
    every = F.lit(True)
    parts = [
        _rule(c, must, "completeness", "NOT_NULL",
              F.when(F.col("null_percentage") < 5, "high").otherwise("medium"), 0.0),
        _rule(c, must & text, "completeness", "NOT_EMPTY", "medium", 0.0),
        _rule(c, must & text, "completeness", "NOT_WHITESPACE", "medium", 0.0),
        _rule(c, F.col("is_uniqueness") == YES, "uniqueness", "UNIQUE",
              _confidence(unique_score), unique_score, flags),
        _rule(c, emails, "validity", "REGEX", "high", w["pattern_evidence"] + 0.5,
              F.struct(F.lit("email_syntax").alias("pattern_name"))),
        _rule(c, number, "validity", "NUMERIC_TYPE", "high", w["pattern_evidence"]),
        _rule(c, number & F.col("numeric.min").isNotNull(), "validity", "NUMERIC_RANGE", "low",
              0.2, bounds),
        _rule(c, _is_date(), "validity", "DATE_FORMAT", "medium", w["pattern_evidence"]),
        _rule(c, F.coalesce(F.size("category_values") >= 1, F.lit(False)), "validity",
              "ALLOWED_VALUES", "low", 0.2, listed),
        _rule(linked, every, "referential_integrity", "FOREIGN_KEY_EXISTS", "high",
              w["approved_relationship"], key),
        _rule(inner, every, "consistency", "FUNCTIONAL_DEPENDENCY", "medium", 0.3, depends,
              F.array("p.parent_column", "column_name")),
        _rule(c, F.col("is_timeliness") == REVIEW, "timeliness", "FRESHNESS_THRESHOLD", "low", 0.1),
        date_order_candidates(c),
    ]
    if composites is not None:
        parts.append(_rule(
            composites, F.size("columns") >= 2, "uniqueness", "COMPOSITE_UNIQUE", "medium", 0.35,
            flags, F.col("columns"),
        ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(
        "table_name", F.element_at("target_columns", 1), "metric", F.col("score").desc(),
        "rule_template", F.array_join("target_columns", ","),
    )


def date_order_candidates(columns: DataFrame) -> DataFrame:
    """Date columns whose names suggest an order, first match per table and pair."""
    dated = columns.filter(_is_date())
    lower = F.lower("column_name")
    spots = []
    for i, (left, right) in enumerate(DATE_PAIRS):
        def first(word: str) -> Column:
            return F.min_by(
                F.when(lower.contains(word), F.col("column_name")),
                F.when(lower.contains(word), F.col("pos")),
            )

        spots += [first(left).alias(f"l{i}"), first(right).alias(f"r{i}")]
    per_table = dated.groupBy("table_name").agg(*spots)
    args: list[Column] = []
    for i in range(len(DATE_PAIRS)):
        args += [F.col(f"l{i}"), F.col(f"r{i}")]
    pairs = per_table.select(
        "table_name", F.stack(F.lit(len(DATE_PAIRS)), *args).alias("left_column", "right_column")
    ).filter("left_column IS NOT NULL AND right_column IS NOT NULL AND left_column <> right_column")
    return _rule(
        pairs.withColumn("column_name", F.col("left_column")), F.lit(True), "consistency",
        "DATE_ORDER", "medium", 0.3,
        F.struct("left_column", "right_column", F.lit(False).alias("allow_equal")),
        F.array("left_column", "right_column"),
    )


def check_rules(
    rules: DataFrame, columns: DataFrame, links: DataFrame, known_templates: list[str]
) -> DataFrame:
    """VALID, NEEDS_REVIEW or INVALID per rule with the reasons.

    `rules`: rule_id, table_name, target_columns, rule_template, parameters (JSON).
    """
    targets = rules.select(
        "rule_id", "table_name", "rule_template", F.explode_outer("target_columns").alias("column_name")
    ).join(
        columns.select(
            "table_name", "column_name", "distinct_percentage", F.lit(True).alias("found"),
            (F.col("numeric").isNotNull() | F.coalesce(F.col("text.numeric_like") > 0, F.lit(False)))
            .alias("numeric_evidence"),
        ), ["table_name", "column_name"], "left",
    )
    template = F.col("rule_template")
    found = F.coalesce("found", F.lit(False))
    crossing = template == "FOREIGN_KEY_EXISTS"
    per_rule = targets.groupBy("rule_id").agg(
        F.bool_or(~found & ~crossing).alias("unknown_column"),
        F.bool_or(found & template.isin("UNIQUE", "COMPOSITE_UNIQUE")
                  & (F.col("distinct_percentage") < 95)).alias("low_distinct"),
        F.bool_or(found & template.isin("NUMERIC_TYPE", "NUMERIC_RANGE")
                  & ~F.col("numeric_evidence")).alias("not_numeric"),
    )
    link = ["parent_table", "parent_column", "child_table", "child_column"]
    params = {k: F.get_json_object("parameters", f"$.{k}") for k in (
        *link, "max_age", "deadline", "time_of_day", "hierarchy", "reference_name", "provider")}
    approved = links.filter(F.col("status").isin(*APPROVED)).select(*link).distinct().withColumn(
        "linked", F.lit(True))
    out = rules.withColumns(params).join(approved, link, "left").join(per_rule, "rule_id", "left")
    no_sla = template.isin("FRESHNESS_THRESHOLD", "DEADLINE") & F.coalesce(
        "max_age", "deadline", "time_of_day").isNull()
    no_source = template.isin("REFERENCE_HIERARCHY", "REFERENCE_LOOKUP") & F.coalesce(
        "hierarchy", "reference_name", "provider").isNull()
    errors = F.array_compact(F.array(
        F.when(~template.isin(*known_templates), "unknown template"),
        F.when(F.col("unknown_column"), "unknown column"),
        F.when(crossing & F.col("linked").isNull(), "no approved relationship"),
        F.when(no_sla, "no threshold given"), F.when(no_source, "no reference given"),
    ))
    warnings = F.array_compact(F.array(
        F.when(F.col("low_distinct"), "low distinct ratio"),
        F.when(F.col("not_numeric"), "no numeric evidence"),
    ))
    return out.withColumns({"errors": errors, "warnings": warnings}).select(
        "rule_id", "rule_template",
        F.when(F.size("errors") > 0, "INVALID").when(F.size("warnings") > 0, "NEEDS_REVIEW")
        .otherwise("VALID").alias("check_status"),
        F.concat("errors", "warnings").alias("issues"),
    )
