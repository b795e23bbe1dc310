"""Key and foreign-key candidates across tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqloom.functions.missing import FRACTIONAL, INTEGRAL
from dqloom.functions.similarity import split_name, text_similarity
from dqloom.operators.combinations import combination_counts
from dqloom.operators.counts import column_catalog, name_signals, percent, wide_to_long
from dqloom.operators.frequency import Field, fields_of
from dqloom.operators.inclusion import Keys, number_ranges, shared_counts, value_bitmaps
from dqloom.operators.tables import COMPOSITES_PER_SCAN, group_value

# Evidence weights and gates.
WEIGHTS = {
    "name_similarity": 0.10, "semantic_compatibility": 0.20, "datatype_compatibility": 0.05,
    "parent_uniqueness": 0.15, "value_containment": 0.20, "value_overlap": 0.10,
    "cardinality_compatibility": 0.10, "child_completeness": 0.05, "structural_evidence": 0.05,
}
PK_MIN_SCORE = 0.55
PK_STRONG_SCORE = 0.75
PK_MIN_DISTINCT = 95.0
COMPOSITE_MIN_UNIQUENESS = 98.0
MIN_NAME = 0.40
MIN_NAME_WITHOUT_VALUES = 0.60
MIN_SCORE = 0.35
TOP_PER_CHILD = 3
DENSE_MAX = 100_000
DENSE_SHARE = 0.95
NARROW = (*INTEGRAL, *FRACTIONAL, T.DateType, T.TimestampType, T.TimestampNTZType)
DECIDED = ("approved", "rejected", "missed", "manual", "edited")


def _number(make: Callable[[Column], Column], other: str) -> Callable[[Field], Column]:
    """A fact of a numeric column's values as doubles; null for other columns."""
    return lambda f: make(f.value.cast("double")) if f.kind == "numeric" else F.lit(None).cast(other)


_NUMBER_FACTS = {
    "row_count": lambda f: F.count(F.lit(1)),
    "lo": _number(F.min, "double"), "hi": _number(F.max, "double"),
    "whole": _number(lambda v: F.bool_and(v == F.rint(v)), "boolean"),
    "finite": _number(lambda v: F.bool_and(F.abs(v) < float("inf")), "boolean"),
}


def _counters(tables: Mapping[str, DataFrame], starts: Mapping[str, int], known: Mapping, distinct: Mapping) -> set[int]:
    """The places whose values are different whole numbers from 0 on, in one constant step.

    n of them have that step exactly when it is (max - min) / (n - 1) and all are congruent
    to min; with a step of one they always are, and are not read again.
    """
    found, out = set(), None
    for name, df in tables.items():
        checks = {}
        for f in fields_of(df):
            place = starts[name] + f.pos
            r, d = known[place], distinct.get(place)
            if d is None or not (r.whole and r.finite and r.lo >= 0) or d.distinct_count < 2 or d.distinct_count != d.non_null_count:
                continue
            step = (r.hi - r.lo) / (d.distinct_count - 1)
            if step == 1:
                found.add(place)
            elif step and step == int(step):
                checks[place] = F.bool_and(F.pmod(f.value.cast("double") - F.lit(r.lo), F.lit(step)) == 0)
        if checks:
            row = df.agg(*[check.alias(str(p)) for p, check in checks.items()])
            part = row.unpivot([], [str(p) for p in checks], "place", "on_grid")
            out = part if out is None else out.unionByName(part)
    return found | (set() if out is None else {int(r.place) for r in out.collect() if r.on_grid})


def key_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """What key discovery needs to know: one row per (table, column).

    Ranges and whole numbers take a scan of all tables, and distinct values one packed shuffle
    of hashes; so the number of jobs does not grow with the number of tables. Only columns of
    unique whole numbers that could stand in steps of two or more are read once more.
    """
    from dqloom.plans.profile import small

    spark = next(iter(tables.values())).sparkSession
    catalog, facts, at = None, None, 0
    starts: dict[str, int] = {}
    for name, df in tables.items():
        place = (F.col("pos") + F.lit(at)).cast("int")
        parts = (column_catalog(df, name).withColumn("place", place),
                 wide_to_long(df, fields_of(df), _NUMBER_FACTS).withColumn("pos", place))
        catalog, facts = (part if whole is None else whole.unionByName(part)
                          for whole, part in zip((catalog, facts), parts, strict=True))
        starts[name] = at
        at += len(df.columns)
    # One row per column comes back, twice.
    known = {r.pos: r for r in facts.collect()}
    sizes = spark.createDataFrame([(name, known[starts[name]].row_count) for name, df in tables.items() if df.columns],
                                  "table_name string, row_count long")
    distinct = None
    for name, df in tables.items():
        fields = fields_of(df)
        for start in range(0, len(fields), COMPOSITES_PER_SCAN):
            chunk = fields[start:start + COMPOSITES_PER_SCAN]
            narrow = [i for i, f in enumerate(chunk) if isinstance(f.dtype, NARROW)]
            part = combination_counts(df, [[group_value(f)] for f in chunk], known[starts[name]].row_count, narrow).select(
                (F.col("combo") + F.lit(starts[name] + start)).alias("place"),
                F.col("rows").alias("non_null_count"), F.col("distinct").alias("distinct_count"))
            distinct = part if distinct is None else distinct.unionByName(part)
    distinct = small(distinct)
    counters = _counters(tables, starts, known, {r.place: r for r in distinct.collect()})
    whole = spark.createDataFrame([(p, r.whole) for p, r in known.items()], "place int, integer_valued boolean")
    counters = spark.createDataFrame([(p, p in counters) for p in known], "place int, counter_like boolean")
    part = name_signals(catalog).join(sizes, "table_name")
    for frame in (distinct, whole, counters):
        part = part.join(frame, "place", "left")
    zero = F.lit(0).cast("long")
    part = part.withColumns({
        "non_null_count": F.coalesce("non_null_count", zero),
        "distinct_count": F.coalesce("distinct_count", zero),
    })
    return part.select(
        "table_name", "pos", "column_name", "data_type", F.col("kind").alias("stored_as"),
        "row_count", "non_null_count", "distinct_count",
        percent(F.col("distinct_count"), F.col("non_null_count")).alias("distinct_percentage"),
        percent(F.col("row_count") - F.col("non_null_count"), F.col("row_count")).alias(
            "null_percentage"),
        (F.col("strong_name") | F.col("weak_name")).alias("identifier_name_signal"),
        (F.col("strong_name") & (F.col("non_null_count") > 0)
         & (F.col("distinct_count") == F.col("non_null_count"))).alias("identifier_signal"),
        F.coalesce((F.col("kind") == "numeric") & ~F.col("integer_valued"), F.lit(False)).alias("float_measure"),
        F.coalesce((F.col("kind") == "numeric") & F.col("counter_like"), F.lit(False)).alias("counter_like"),
    )


def pk_score() -> Column:
    """K1: uniqueness, completeness and name, damped below ten rows."""
    unique = F.col("distinct_percentage") / 100
    complete = 1 - F.col("null_percentage") / 100
    named = F.col("identifier_name_signal").cast("double")
    sample = F.least(F.lit(1.0), F.greatest(F.lit(0.3), F.col("non_null_count") / 10))
    base = (unique * 0.55 + complete * 0.25 + named * 0.20) * sample
    return F.round(
        F.when(F.col("identifier_signal"), F.least(F.lit(1.0), base + 0.1)).otherwise(base), 4
    )


def pk_evidence(profile: DataFrame) -> DataFrame:
    return profile.withColumn("pk_score", pk_score())


def pk_candidates(profile: DataFrame) -> DataFrame:
    """K2: columns that could be a primary key; counters are flagged as surrogates."""
    scored = pk_evidence(profile)
    return scored.filter(
        (F.col("pk_score") >= PK_MIN_SCORE) & (F.col("distinct_percentage") >= PK_MIN_DISTINCT)
        & ~F.col("float_measure")
    ).select(
        "table_name", "column_name", "pk_score", F.col("counter_like").alias("surrogate_counter"),
    )


def composite_pk_candidates(composites: DataFrame, columns: DataFrame) -> DataFrame:
    """K3: composite keys without measures or free text, at least 98% unique.

    `composites` and `columns` come from a table profile (`float_measure`,
    `free_text`); members stay an array.
    """
    barred = columns.filter(F.col("float_measure") | F.col("free_text")).agg(
        F.collect_list("column_name").alias("barred")
    )
    return (
        composites.filter(F.col("composite_uniqueness_percentage") >= COMPOSITE_MIN_UNIQUENESS)
        .join(F.broadcast(barred))
        .filter(~F.arrays_overlap("columns", "barred"))
        .select(
            F.col("columns").alias("key_columns"),
            F.round(F.col("composite_uniqueness_percentage") / 100, 4).alias("score"),
        )
    )


def key_values(tables: Mapping[str, DataFrame]) -> Keys:
    """Distinct canonical key values of all columns, each with the columns that hold it."""
    return value_bitmaps(tables)


def shared_values(keys: Keys, parents: Sequence[int] | None = None, min_shared: int = 1) -> DataFrame:
    """(child_table, child_column, parent_table, parent_column, contained_distinct,
    child_distinct) of columns of different tables that share values; and with null parents
    the distinct values of every column."""
    found = shared_counts(keys, parents, min_shared)
    catalog = keys.catalog
    named = found.join(_place(catalog, "child"), found.child == F.col("child_place")).join(
        _place(catalog, "parent"), found.parent == F.col("parent_place"), "left")
    apart = F.col("parent_table").isNull() | (F.col("child_table") != F.col("parent_table"))
    return named.filter(apart).select(
        "child_table", "child_column", "parent_table", "parent_column", F.col("shared").alias("contained_distinct"))


def _place(catalog: DataFrame, role: str) -> DataFrame:
    return catalog.select(F.col("place").alias(f"{role}_place"), F.col("table_name").alias(f"{role}_table"),
                          F.col("column_name").alias(f"{role}_column"))


def containment(keys: Keys, parents: Sequence[int] | None = None, min_shared: int = 1) -> DataFrame:
    """K5: shared distinct values of every two columns of different tables.

    `parents` restricts one side to the numbers of likely keys in `keys.places`.
    """
    from dqloom.plans.profile import small

    # One row per pair that shares values: evaluated once, used three times.
    found = small(shared_values(keys, parents, min_shared))
    sizes = found.filter("parent_table IS NULL")
    child = sizes.select("child_table", "child_column", F.col("contained_distinct").alias("child_distinct"))
    parent = sizes.select(F.col("child_table").alias("parent_table"), F.col("child_column").alias("parent_column"),
                          F.col("contained_distinct").alias("parent_distinct"))
    out = found.filter("parent_table IS NOT NULL").join(child, ["child_table", "child_column"]).join(
        parent, ["parent_table", "parent_column"])
    n, c, p = F.col("contained_distinct"), F.col("child_distinct"), F.col("parent_distinct")
    return out.select(
        "parent_table", "parent_column", "child_table", "child_column",
        "child_distinct", "parent_distinct", "contained_distinct",
        F.round(n / c, 4).alias("containment"),
        F.round(n / F.least(c, p), 4).alias("overlap"),
        (c - n).alias("orphan_distinct_count"),
        F.round((c - n) / c, 4).alias("orphan_distinct_rate"),
    )


def dense_integers(keys: Keys, sizes: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """K6: columns whose keys are numbers that fill their range from 0 to 100,000.

    `sizes` has the distinct keys per column (table_name, column_name, distinct).
    """
    ranges = number_ranges(keys) if ranges is None else ranges
    ranges = ranges.join(keys.catalog, "place").join(sizes, ["table_name", "column_name"])
    dense = (
        F.col("numeric") & (F.col("lo") >= 0) & (F.col("hi") <= DENSE_MAX)
        & (F.col("distinct") / (F.col("hi") - F.col("lo") + 1) >= DENSE_SHARE)
    )
    return ranges.select("table_name", "column_name", "distinct", F.coalesce(dense, F.lit(False)).alias("dense"))


def type_family(stored_as: Column) -> Column:
    """K7: the datatype family; families within this list can be joined."""
    return F.when(stored_as == "datetime", "temporal").otherwise(stored_as)


def _side(frame: DataFrame, role: str, columns: Sequence[str]) -> DataFrame:
    return frame.select(
        F.col("table_name").alias(f"{role}_table"), F.col("column_name").alias(f"{role}_column"),
        *[F.col(c).alias(f"{role}_{c}") for c in columns],
    )


def key_candidates(tables: Mapping[str, DataFrame], free_text: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """K1-K3: single and composite key candidates (kind, table_name, key_columns, score).

    Composite keys are searched among the columns that are no measure, and none of the
    table's `free_text` columns. The profile's rows per column steer the search.
    """
    from dqloom.operators.tables import composite_candidates
    from dqloom.plans.profile import small

    profile = small(key_profile(tables))
    out = pk_candidates(profile).select(
        F.lit("pk").alias("kind"), "table_name", F.array("column_name").alias("key_columns"), F.col("pk_score").alias("score"))
    rows = [r.asDict() for r in profile.collect()]
    for name, df in tables.items():
        told = set((free_text or {}).get(name, ()))
        facts = [{**r, "is_constant": r["distinct_count"] <= 1, "is_float_measure": r["float_measure"], "is_free_text": r["column_name"] in told,
                  "is_key_like": r["identifier_name_signal"]} for r in rows if r["table_name"] == name]
        found = composite_candidates(df, facts, facts[0]["row_count"] if facts else 0)
        columns = profile.filter(F.col("table_name") == name).select(
            "column_name", "float_measure", F.col("column_name").isin(*told).alias("free_text"))
        out = out.unionByName(composite_pk_candidates(found, columns).select(
            F.lit("composite_pk").alias("kind"), F.lit(name).alias("table_name"), "key_columns", "score"))
    return out


def likely_keys(profile: DataFrame) -> DataFrame:
    """The columns that may be a parent: scored well as a key, or all of them where no
    column is."""
    scored = pk_evidence(profile)
    everyone = Window.partitionBy()
    any_key = F.max(F.col("pk_score") >= PK_MIN_SCORE).over(everyone)
    return scored.withColumn("any_key", any_key).filter(~F.col("any_key") | (F.col("pk_score") >= PK_MIN_SCORE)).drop("any_key")


def column_pairs(profile: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """K8: (child, parent) column pairs worth scoring, with their names' similarity.

    A pair can only become a candidate if it shares a value, or if the names are similar by
    0.6, which takes a common word. So pairs come from `shared` (child_table, child_column,
    parent_table, parent_column) and from a join of names' words; columns and keys are never
    crossed. `profile` is key_profile(): rows per column.
    """
    facts = ["stored_as", "pk_score", "identifier_name_signal", "null_percentage"]
    children, parents = _side(pk_evidence(profile), "child", facts), _side(likely_keys(profile), "parent", facts)
    link = ["child_table", "child_column", "parent_table", "parent_column"]
    word = lambda side, role: side.select(
        f"{role}_table", f"{role}_column", F.explode(F.array_distinct(split_name(F.col(f"{role}_column")))).alias("word"))
    met = word(children, "child").join(word(parents, "parent"), "word").select(*link)
    if shared is not None:
        met = met.unionByName(shared.select(*link))
    met = met.filter("child_table <> parent_table").distinct()
    pairs = met.join(children, ["child_table", "child_column"]).join(parents, ["parent_table", "parent_column"])
    named = pairs.withColumn(
        "name_similarity", F.round(text_similarity(F.col("child_column"), F.col("parent_column")), 4)
    )
    return named.filter(
        (F.col("name_similarity") >= MIN_NAME) | (F.col("parent_pk_score") >= PK_STRONG_SCORE)
    )


def score_pairs(
    pairs: DataFrame, shared: DataFrame, sizes: DataFrame, meanings: DataFrame | None = None
) -> DataFrame:
    """Evidence and score per pair.

    `sizes` is dense_integers(); `meanings` (table_name, column_name, concept) holds
    the final meaning of columns. Every frame has rows per column or pair.
    """
    link = ["child_table", "child_column", "parent_table", "parent_column"]
    spark = pairs.sparkSession
    if meanings is None:
        meanings = spark.createDataFrame(
            [], "table_name string, column_name string, concept string"
        )
    out = pairs.join(shared.select(*link, "contained_distinct"), link, "left")
    for role in ("child", "parent"):
        key = [f"{role}_table", f"{role}_column"]
        out = out.join(_side(sizes, role, ["distinct", "dense"]), key, "left")
        out = out.join(_side(meanings, role, ["concept"]), key, "left")
    zero = F.lit(0).cast("long")
    n = F.coalesce("contained_distinct", zero)
    c, p = F.coalesce("child_distinct", zero), F.coalesce("parent_distinct", zero)
    damp = F.when(F.col("child_dense") & F.col("parent_dense"), 0.5).otherwise(1.0)
    smaller = F.least(c, p)
    contained = F.when(c > 0, n / c).otherwise(F.lit(0.0))
    overlap = F.when(smaller > 0, n / smaller).otherwise(F.lit(0.0))
    ratio = F.when((c > 0) & (p > 0), c / p)
    cardinality = F.when(ratio <= 1, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), 1 - (ratio - 1))
    )
    families = [type_family(F.col(f"{r}_stored_as")) for r in ("child", "parent")]
    joinable = [f.isin("numeric", "string", "temporal", "boolean") for f in families]
    compatible = (families[0] == families[1]) | (joinable[0] & joinable[1])
    same = F.lower(F.btrim("child_concept")) == F.lower(F.btrim("parent_concept"))
    structural = (
        F.col("child_identifier_name_signal").cast("double")
        + F.col("parent_identifier_name_signal").cast("double")
    ) / 2
    out = out.withColumns({
        "datatype_compatibility": compatible.cast("double"),
        "semantic_compatibility": same.cast("double"),
        "parent_uniqueness": F.col("parent_pk_score"),
        "value_containment": F.round(contained * damp, 4),
        "value_overlap": F.round(overlap * damp, 4),
        "cardinality_compatibility": F.round(F.when(ratio.isNotNull(), cardinality), 4),
        "child_completeness": F.round(1 - F.col("child_null_percentage") / 100, 4),
        "structural_evidence": structural,
        "containment": F.round(contained, 4),
        "orphan_distinct_count": c - n,
        "orphan_distinct_rate": F.when(c > 0, F.round((c - n) / c, 4)).otherwise(F.lit(0.0)),
        "dense_integer_warning": F.coalesce(
            F.col("child_dense") & F.col("parent_dense"), F.lit(False)),
    })
    total, weight = F.lit(0.0), F.lit(0.0)
    for feature, w in WEIGHTS.items():
        known = F.col(feature).isNotNull()
        total = total + F.when(known, F.col(feature) * w).otherwise(F.lit(0.0))
        weight = weight + F.when(known, F.lit(w)).otherwise(F.lit(0.0))
    return out.withColumn("score", F.round(total / weight, 4)).select(
        *link, "score", *WEIGHTS, "containment", "orphan_distinct_count",
        "orphan_distinct_rate", "dense_integer_warning",
    )


def fk_candidates(scored: DataFrame, top: int = TOP_PER_CHILD) -> DataFrame:
    """K9: pairs that pass the gates, the best `top` per child column."""
    no_values = (F.col("value_containment") == 0) & (F.col("value_overlap") == 0)
    kept = scored.filter(
        (F.col("score") >= MIN_SCORE)
        & ~(no_values & (F.col("name_similarity") < MIN_NAME_WITHOUT_VALUES))
    )
    rank = Window.partitionBy("child_table", "child_column").orderBy(
        F.col("score").desc(), "parent_table", "parent_column"
    )
    return kept.withColumn("position", F.row_number().over(rank)).filter(
        F.col("position") <= top
    )


def discover(
    tables: Mapping[str, DataFrame], meanings: DataFrame | None = None, top: int = TOP_PER_CHILD
) -> DataFrame:
    """K1-K10 end to end: foreign-key candidates across the given tables.

    Frames of rows per column, or per pair that shares values, are evaluated in between:
    the profile says which columns are likely keys, and only those are counted as parents.
    """
    from dqloom.plans.profile import small, together

    keys = key_values(tables)
    profile = small(key_profile(tables))
    likely = {(r.table_name, r.column_name) for r in likely_keys(profile).select("table_name", "column_name").collect()}
    parents = [i for i, place in enumerate(keys.places) if place in likely]
    found = together({"shared": shared_values(keys, parents), "ranges": number_ranges(keys)})
    shared = found["shared"].filter("parent_table IS NOT NULL")
    sizes = found["shared"].filter("parent_table IS NULL").select(
        F.col("child_table").alias("table_name"), F.col("child_column").alias("column_name"), F.col("contained_distinct").alias("distinct"))
    scored = score_pairs(column_pairs(profile, shared), shared, dense_integers(keys, sizes, found["ranges"]), meanings)
    return fk_candidates(scored, top)


def merge_decisions(fresh: DataFrame, decided: DataFrame) -> DataFrame:
    """New candidates next to kept human decisions; the decision wins.

    Both have kind, parent_table, parent_column, child_table, child_column, score;
    `decided` also has status. Undecided old candidates are replaced.
    """
    link = ["kind", "parent_table", "parent_column", "child_table", "child_column"]
    kept = decided.filter(F.col("status").isin(*DECIDED)).select(
        F.coalesce("kind", F.lit("relationship")).alias("kind"), *link[1:],
        F.col("score").alias("old_score"), "status",
    )
    return fresh.select(*link, "score").join(kept, link, "full").select(
        *link, F.coalesce("score", "old_score").alias("score"),
        F.coalesce("status", F.lit("pending")).alias("status"),
    )


