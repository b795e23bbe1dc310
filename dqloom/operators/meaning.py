"""What a column is about: names, vectors and profile facts against a concept table.

Works on metadata: one row per column, per concept, per (column, concept). The
frames are distributed all the same, so a lake of many tables runs as one job.

A concept row has: concept_id, concept_name, category, description, aliases,
expected_types, expectations (map of check -> wanted), entities (NULL: derived
from the names), head_tokens, family, role, is_family, family_only,
value_vocabulary, value_regex, context_keywords, domain_keywords.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqloom.functions.names import literal_array
from dqloom.functions.similarity import sequence_ratio, split_name, text_similarity, token_f1

CONCEPT_SCHEMA = (
    "concept_id int, concept_name string, category string, description string, "
    "aliases array<string>, expected_types array<string>, expectations map<string,string>, "
    "entities array<string>, head_tokens array<string>, family string, role string, "
    "is_family boolean, family_only boolean, value_vocabulary array<string>, "
    "value_regex string, context_keywords array<string>, domain_keywords array<string>"
)

# Words that name the role of a column.
HEAD_WORDS = (
    "identifier", "id", "code", "number", "name", "date", "time", "timestamp", "amount",
    "price", "cost", "fee", "quantity", "count", "total", "rate", "ratio", "percent",
    "percentage", "score", "rating", "flag", "status", "type", "category", "class",
    "description", "comment", "text", "address", "email", "phone", "url", "year", "month",
    "day", "hour", "age", "weight", "length", "width", "height", "area", "size", "level",
)
HEAD_SYNONYMS = {
    "identifier": "id", "no": "number", "cd": "code", "percent": "percentage",
    "timestamp": "time", "score": "rating",
}
BOOLEAN_PREFIXES = ("is", "has", "was")
NOISE_WORDS = (
    "col", "column", "field", "var", "variable", "attr", "attribute", "feature", "unnamed",
    "unknown",
)
TYPE_PREFIXES = ("col", "fld", "tbl")
TYPE_SUFFIXES = ("txt", "str", "num")
NON_ENTITIES = ("is", "has", "was", "prefix", "num", "no", "dt")
OPAQUE = r"^(?:x|y|z|c|v|f)?[\s_:.\-]*\d*$"

# Evidence weights, thresholds and caps.
WEIGHTS = {
    "name_similarity": 0.28, "embedding_similarity": 0.22, "description_similarity": 0.15,
    "profile_compatibility": 0.12, "datatype_compatibility": 0.08, "value_evidence": 0.07,
    "context_similarity": 0.05, "relationship_evidence": 0.03,
}
STRONG, PROBABLE, AMBIGUOUS = 0.85, 0.80, 0.40
STRONG_MARGIN, PROBABLE_MARGIN = 0.12, 0.05
MIN_COVERAGE = 0.50
PATTERN_COVERAGE = 0.6
MIN_UNIQUE_SAMPLE = 10
ALTERNATIVES = 5

# Which observed roles fit which concept role.
ROLE_FITS = {
    "identifier": ("identifier", "code", "count", "text"),
    "code": ("code", "identifier", "categorical", "text"),
    "measure": ("measure", "count", "flag"),
    "count": ("count", "measure", "identifier", "code"),
    "flag": ("flag", "categorical", "count", "code", "identifier"),
    "text": ("text", "categorical"),
    "categorical": ("categorical", "text", "flag"),
    "date": ("date", "time"),
    "time": ("time", "date"),
}
ALL_ROLES = tuple(ROLE_FITS)
EXACT_ROLE_FITS = {
    **ROLE_FITS,
    "measure": ("measure", "count"), "flag": ("flag", "categorical"),
    "text": ("text", "categorical", "identifier", "code"),
    "categorical": ("categorical", "text", "flag", "code"),
}

BLOCK_ROWS = 20_000


# --- names ----------------------------------------------------------------


def _leading(tokens: Column, words: Sequence[str]) -> Column:
    """How many leading tokens are in `words`, leaving at least one token."""
    flags = F.transform(tokens, lambda t: ~t.isin(*words))
    first = F.array_position(flags, True)
    run = F.when(first > 0, first - 1).otherwise(F.size(tokens))
    return F.greatest(F.lit(0), F.least(run, F.size(tokens) - 1)).cast("int")


def _drop(tokens: Column, n: Column) -> Column:
    return F.slice(tokens, n + 1, F.greatest(F.size(tokens) - n, F.lit(0)))


def expand(tokens: Column, abbreviations: Mapping[str, str] | None) -> Column:
    """Replace known abbreviations; none are built in."""
    if not abbreviations:
        return tokens
    pairs = [F.lit(x) for k, v in abbreviations.items() for x in (k, v)]
    table = F.create_map(*pairs)
    return F.flatten(F.transform(
        tokens, lambda t: F.split(F.coalesce(F.element_at(table, t), t), " ")
    ))


def parse_names(
    frame: DataFrame, name: str, table: str | None = None,
    abbreviations: Mapping[str, str] | None = None, prefix: str = "",
) -> DataFrame:
    """Tokens, key, head word, entity tokens and opacity of names."""
    c = F.col
    tokens = split_name(c(name))
    out = frame.withColumn("_t", tokens)
    if table is not None:
        owner = F.filter(split_name(c(table)), lambda t: ~t.isin(*NOISE_WORDS))
        starts = (F.size(owner) > 0) & (F.size("_t") > F.size(owner)) & (
            F.slice("_t", F.lit(1), F.greatest(F.size(owner), F.lit(1))) == owner
        )
        out = out.withColumn("_t", F.when(starts, _drop(c("_t"), F.size(owner))).otherwise(c("_t")))
    out = out.withColumn("_t", _drop(c("_t"), _leading(c("_t"), TYPE_PREFIXES)))
    out = out.withColumn("_t", F.reverse(
        _drop(F.reverse(c("_t")), _leading(F.reverse(c("_t")), TYPE_SUFFIXES))
    ))
    plain = F.filter(
        c("_t"), lambda t: ~t.isin(*NOISE_WORDS) & ~t.rlike(r"^\d+$") & (F.length(t) > 1)
    )
    out = out.withColumn("_x", expand(c("_t"), abbreviations)).withColumn("_plain", plain)
    content = F.filter(
        c("_x"), lambda t: ~t.isin(*NOISE_WORDS) & ~t.rlike(r"^\d+$") & (F.length(t) > 1)
    )
    out = out.withColumn("_e", content)
    flags = F.transform("_e", lambda t: t.isin(*HEAD_WORDS))
    backwards = F.array_position(F.reverse(flags), True)
    at = F.when(backwards > 0, F.size("_e") - backwards)
    out = out.withColumn("_at", at)
    entities = F.filter(
        c("_e"), lambda t, i: (F.col("_at").isNull() | (i != F.col("_at")))
        & ~t.isin(*BOOLEAN_PREFIXES)
    )
    opaque = (F.size("_plain") == 0) | F.lower(F.trim(c(name))).rlike(OPAQUE)
    named = {
        "tokens": c("_x"), "key": F.array_join("_x", " "),
        "head": F.when(c("_at").isNotNull(), F.get("_e", c("_at").cast("int"))),
        "entities": entities, "opaque": opaque,
    }
    return out.withColumns({prefix + k: v for k, v in named.items()}).drop(
        "_t", "_x", "_e", "_at", "_plain"
    )


# --- vectors --------------------------------------------------------------


def _search(block_ids: list, block: np.ndarray, k: int):
    """Batches of (id, vector) -> the k most similar block rows of each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            queries = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vector"]])
            norms = np.linalg.norm(queries, axis=1, keepdims=True)
            scores = queries @ block.T / np.where(norms == 0, 1.0, norms)
            take = min(k, scores.shape[1])
            # All rows as good as the k-th, so that ties are decided by id and not by place.
            least = -np.partition(-scores, take - 1, axis=1)[:, take - 1:take]
            rows, best = np.nonzero(scores >= least)
            yield pd.DataFrame({
                "id": pdf["id"].to_numpy()[rows],
                "concept_id": np.asarray(block_ids)[best],
                "similarity": scores[rows, best],
            })

    return run


def vector_topk(
    queries: DataFrame, concepts: DataFrame, k: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(id, concept_id, similarity, position): the k nearest concepts by cosine.

    `queries` has id and vector, `concepts` concept_id and vector. Concepts travel to
    the tasks as one matrix of at most `block_rows` rows; a larger table is searched
    block by block and the partial answers are merged, which is still exact.
    """
    total = concepts.count()
    blocks = max(1, -(-total // block_rows))
    part = F.pmod(F.xxhash64("concept_id"), F.lit(blocks))
    kinds = {f.name: f.dataType.simpleString() for f in
             queries.select("id").schema.fields + concepts.select("concept_id").schema.fields}
    schema = f"id {kinds['id']}, concept_id {kinds['concept_id']}, similarity double"
    found: DataFrame | None = None
    for b in range(blocks):
        # One block, bounded by construction.
        chosen = concepts.filter(part == b).select("concept_id", "vector").toPandas()
        if chosen.empty:
            continue
        matrix = np.stack([np.asarray(v, dtype=np.float64) for v in chosen["vector"]])
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        unit = matrix / np.where(norms == 0, 1.0, norms)
        hits = queries.select("id", "vector").mapInPandas(
            _search(chosen["concept_id"].tolist(), unit, k), schema
        )
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return queries.sparkSession.createDataFrame([], schema + ", position int")
    # At most k rows per block and query.
    rank = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "concept_id")
    return found.withColumn("position", F.row_number().over(rank)).filter(F.col("position") <= k)


def lexical_scores(columns: DataFrame, variants: DataFrame) -> DataFrame:
    """(table_name, column_name, concept_id, lexical): shared name tokens, by joining
    on the token; an identical key scores 1."""
    own = ["table_name", "column_name"]
    mine = columns.select(
        *own, F.size(F.array_distinct("tokens")).alias("n"),
        F.explode(F.array_distinct("tokens")).alias("token"),
    )
    theirs = variants.select("concept_id", F.explode("v_tokens").alias("token")).distinct()
    shared = mine.join(theirs, "token").groupBy(*own, "n", "concept_id").agg(
        F.count(F.lit(1)).alias("common")
    ).select(*own, "concept_id", (F.col("common") / F.col("n")).alias("lexical"))
    exact = columns.filter("key <> ''").select(*own, "key").join(
        variants.select("concept_id", F.col("v_key").alias("key")).distinct(), "key"
    ).select(*own, "concept_id", F.lit(1.0).alias("lexical"))
    return shared.unionByName(exact).groupBy(*own, "concept_id").agg(
        F.max("lexical").alias("lexical")
    )


# --- concepts -------------------------------------------------------------


def concept_variants(
    concepts: DataFrame, abbreviations: Mapping[str, str] | None = None
) -> DataFrame:
    """One parsed row per concept name and alias."""
    every = F.concat(F.array("concept_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = concepts.select("concept_id", F.posexplode(every).alias("variant", "v_name"))
    return parse_names(rows, "v_name", abbreviations=abbreviations, prefix="v_")


def concept_facts(concepts: DataFrame, variants: DataFrame) -> DataFrame:
    """Concept rows with the entities and head words their names assert."""
    pooled = variants.groupBy("concept_id").agg(
        F.array_distinct(F.flatten(F.collect_list("v_entities"))).alias("pool"),
        F.collect_set("v_head").alias("heads"),
    )
    joined = concepts.join(pooled, "concept_id")
    empty = F.array().cast("array<string>")
    return joined.withColumns({
        "entity_pool": F.coalesce("entities", "pool"),
        "heads": F.array_union("heads", F.coalesce("head_tokens", empty)),
    }).drop("pool", "entities", "head_tokens")


def vocabulary(variants: DataFrame) -> DataFrame:
    """One row: every word the concept table uses, plus the role words."""
    return variants.agg(
        F.array_union(
            F.array_distinct(F.flatten(F.collect_list("v_tokens"))), literal_array(HEAD_WORDS)
        ).alias("known")
    )


def _synonym(head: Column) -> Column:
    pairs = [F.lit(x) for k, v in HEAD_SYNONYMS.items() for x in (k, v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), head), head)


def _head_match(a: Column, b: Column) -> Column:
    """1 for equal or synonymous role words, 0.5 when one side has none, else 0."""
    return F.when(a.isNull() | b.isNull(), 0.5).when(_synonym(a) == _synonym(b), 1.0).otherwise(0.0)


def _entity_overlap(a: Column, b: Column) -> Column:
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 0.6)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.5)
        .otherwise(token_f1(a, b))
    )


def name_evidence(pairs: DataFrame, variants: DataFrame, known: DataFrame) -> DataFrame:
    """E3 name part: similarity and conflicts per (column, concept).

    `pairs` carries the parsed column name and concept facts. Variants join on the
    concept; the strongest one speaks for it.
    """
    own = ["table_name", "column_name", "concept_id"]
    v = pairs.join(variants, "concept_id").join(F.broadcast(known))
    c = F.col
    last = F.element_at("tokens", -1)
    ratio = sequence_ratio(c("key"), c("v_key"))
    part_of = (c("key") != "") & (c("v_key") != "")
    sequence = F.when(
        part_of & ~F.array_contains("v_tokens", last), ratio * 0.5
    ).otherwise(ratio)
    contained = F.when(part_of & c("v_key").contains(c("key")), 0.5).otherwise(0.0)
    overlap = _entity_overlap(c("entities"), c("v_entities"))
    head = _head_match(c("head"), c("v_head"))
    raw = F.greatest(
        overlap * 0.6 + head * 0.4, token_f1(c("tokens"), c("v_tokens")) * 0.6 + sequence * 0.4,
        contained,
    )
    covers = F.array_contains(F.array_union("v_tokens", "v_entities"), last)
    capped = F.when(
        ~c("is_family") & (F.size("tokens") > 0) & ~covers, F.least(raw, F.lit(0.4))
    ).otherwise(raw)
    value = F.when((c("key") != "") & (c("key") == c("v_key")), 1.0).otherwise(capped)
    scored = v.withColumns({"value": value, "overlap": overlap, "match": head})
    best = F.max_by(
        F.struct("value", "overlap", "match"), F.struct(c("value"), (-c("variant")).alias("first"))
    )
    out = scored.groupBy(*own).agg(
        best.alias("b"), F.first("tokens").alias("tokens"), F.first("entities").alias("entities"),
        F.first("head").alias("head"), F.first("entity_pool").alias("entity_pool"),
        F.first("heads").alias("heads"), F.first("known").alias("known"),
    )

    def asserted(words: Column) -> Column:
        return F.filter(
            words, lambda t: ~t.isin(*NON_ENTITIES) & F.array_contains(c("known"), t)
        )

    mine, theirs = asserted(c("entities")), asserted(c("entity_pool"))
    recognised = F.arrays_overlap("tokens", "known")
    value = c("b.value")
    agreed = F.exists("heads", lambda h: _synonym(h) == _synonym(c("head")))
    return out.select(
        *own,
        F.round(F.when((value < 1) & ~recognised, F.least(value, F.lit(0.2))).otherwise(value), 4)
        .alias("name_similarity"),
        ((F.size(mine) > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap(mine, theirs)).alias(
            "entity_conflict"),
        F.coalesce(c("head").isNotNull() & (F.size("heads") > 0) & ~agreed, F.lit(False)).alias(
            "head_conflict"),
        F.round("b.overlap", 4).alias("entity_overlap"), F.col("b.match").alias("head_match"),
    )


# --- profile facts --------------------------------------------------------


def observed_roles() -> Column:
    """The structural roles a profiled column can play, as an array."""
    c = F.col
    number, text, date = c("numeric").isNotNull(), c("text").isNotNull(), c("datetime").isNotNull()
    whole = F.coalesce(c("numeric.integer_valued"), F.lit(False))
    key = F.coalesce(c("identifier_like"), F.lit(False)) | F.coalesce(
        c("identifier_signal"), F.lit(False))
    counter = F.coalesce(c("numeric.counter_like"), F.lit(False))
    code = F.coalesce(c("code_like"), F.lit(False))
    flat = F.coalesce(c("constant") | c("near_constant"), F.lit(False))
    free = F.coalesce(c("free_text"), F.lit(False))
    clock = F.coalesce(c("datetime.has_time_component"), F.lit(False))

    def roles(when: Column, *names: str) -> Column:
        return F.when(when, literal_array(names)).otherwise(F.array().cast("array<string>"))

    found = F.array_distinct(F.concat(
        roles(number & (code | key), "identifier", "code"),
        roles(number & counter, "identifier", "code", "count"),
        roles(number & whole, "count", "measure"), roles(number & ~whole, "measure"),
        roles(number & flat, "flag"), roles(c("stored_as") == "boolean", "flag"),
        roles(text & free, "text"), roles(text & ~free, "categorical", "text"),
        roles(text & key, "identifier", "code"),
        roles(date & clock, "time"), roles(date & ~clock, "date"),
    ))
    return F.when(F.size(found) > 0, F.array_sort(found)).otherwise(
        F.array_sort(literal_array(ALL_ROLES)))


def _fits(role: Column, observed: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """False only when the role is known and shares nothing with the observed ones."""
    fits = F.lit(True)
    for name, allowed in table.items():
        fits = F.when(role == name, F.arrays_overlap(observed, literal_array(allowed))).otherwise(fits)
    return F.coalesce(fits, F.lit(True))


def datatype_name() -> Column:
    """int, float, datetime, bool or string; date-like text counts as datetime."""
    c = F.col
    parsed = F.coalesce(c("datetime.parse_success_percentage") >= 95, F.lit(False))
    kind = c("data_type")
    return (
        F.when((c("stored_as") == "string") & parsed, "datetime")
        .when(kind.rlike("int|long"), "int").when(kind.rlike("double|float|decimal"), "float")
        .when(kind.startswith("timestamp"), "datetime").when(kind == "date", "date")
        .when(kind == "boolean", "bool").when(kind == "string", "string").otherwise(kind)
    )


def _checks(name_likeness: Column) -> dict[str, Column]:
    """What the profile says about each expectation a concept may state."""
    c = F.col
    rows = c("non_null_count")
    lo, hi = c("numeric.min"), c("numeric.max")
    number, text = c("numeric").isNotNull(), c("text").isNotNull()
    values = F.transform(
        F.coalesce("top_values", F.array().cast("array<struct<position:int,value:string,"
                                                "count:bigint,percentage:double>>")),
        lambda v: F.trim(v["value"]),
    )
    seen = F.size(values) > 0
    words = literal_array(("0", "1", "true", "false", "yes", "no", "y", "n"))
    unique = (c("distinct_percentage") >= 99) & (rows >= MIN_UNIQUE_SAMPLE)

    def share(test) -> Column:
        return F.when(seen, F.size(F.filter(values, test)) / F.size(values)).otherwise(F.lit(0.0))

    def pattern(name: str) -> Column:
        return c(f"text.{name}") / rows >= PATTERN_COVERAGE

    return {
        "identifier_like": c("identifier_like") | c("identifier_repeats")
        | c("identifier_name_signal") | c("identifier_signal")
        | (unique & (c("null_percentage") == 0) & (name_likeness >= 0.5)),
        "non_null": c("null_percentage") == 0, "numeric": number, "text": text,
        "temporal": c("datetime").isNotNull(),
        "categorical": text & (c("distinct_percentage") < 50),
        "non_negative": lo >= 0, "continuous": number & (c("distinct_percentage") >= 50),
        "bounded": (lo >= 0) & (hi <= 150), "integer_valued": c("numeric.integer_valued"),
        "boolean_like": (c("stored_as") == "boolean")
        | (seen & F.forall(values, lambda v: F.array_contains(words, F.lower(v))))
        | (number & (c("distinct_count") <= 3)),
        "year": lo.between(1900, 2100) & hi.between(1900, 2100),
        "long_text": c("text.max_length") >= 100,
        "email_pattern": pattern("email_like"), "phone_pattern": pattern("phone_like"),
        "postal_pattern": pattern("postal_like"), "currency_code": pattern("currency_like"),
        "url_pattern": share(lambda v: v.contains("://") | v.startswith("/")) >= PATTERN_COVERAGE,
        "time_of_day": (lo.between(0, 23) & hi.between(0, 23))
        | F.coalesce(c("datetime.has_time_component"), F.lit(False))
        | (share(lambda v: v.rlike(r"^\d{1,2}:\d{2}(?::\d{2})?$")) >= PATTERN_COVERAGE),
        "domain_range": (lo >= F.split("expectations.domain_range", ",")[0].try_cast("double"))
        & (hi <= F.split("expectations.domain_range", ",")[1].try_cast("double")),
    }


def _profile_share(name_likeness: Column) -> Column:
    """Share of stated expectations that hold; NULL when none is stated."""
    wanted = F.col("expectations")
    results = []
    for key, actual in _checks(name_likeness).items():
        value = F.element_at(wanted, F.lit(key))
        expected = F.lit(True) if key == "domain_range" else F.lower(value) == "true"
        results.append(F.when(value.isNotNull(), F.coalesce(actual, F.lit(False)) == expected))
    # Uniqueness is a hint and always counts as met.
    results.append(F.when(F.element_at(wanted, F.lit("unique")).isNotNull(), F.lit(True)))
    told = F.array_compact(F.array(*results))
    return F.when(
        F.size(told) > 0, F.round(F.size(F.filter(told, lambda x: x)) / F.size(told), 4)
    )


def _value_share() -> Column:
    """Share of observed top values in the concept's vocabulary or pattern."""
    values = F.transform("top_values", lambda v: F.trim(v["value"]))
    words = F.transform(
        F.coalesce("value_vocabulary", F.array().cast("array<string>")),
        lambda w: F.lower(F.trim(w)),
    )
    fits = F.filter(values, lambda v: F.array_contains(words, F.lower(v)) | F.coalesce(
        F.regexp_like(v, F.concat(F.lit("^(?:"), F.col("value_regex"), F.lit(")$"))), F.lit(False)
    ))
    stated = (F.size(words) > 0) | F.col("value_regex").isNotNull()
    return F.when(stated & (F.size(values) > 0), F.round(F.size(fits) / F.size(values), 4))


def concept_evidence(
    columns: DataFrame, concepts: DataFrame, similarities: DataFrame | None = None,
    domain: str | None = None, relations: DataFrame | None = None,
    abbreviations: Mapping[str, str] | None = None,
) -> DataFrame:
    """Every evidence feature per (column, concept); NULL means not applicable.

    `columns` is a profile with table_name (and an optional `description`),
    `similarities` has table_name, column_name, concept_id, similarity, and
    `relations` gives the confirmed concept of a column's approved parent.
    """
    own = ["table_name", "column_name"]
    if "description" not in columns.columns:
        columns = columns.withColumn("description", F.lit(None).cast("string"))
    variants = concept_variants(concepts, abbreviations)
    facts = concept_facts(concepts, variants)
    parsed = parse_names(columns, "column_name", None, abbreviations)
    siblings = parsed.groupBy("table_name").agg(
        F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("sibling_tokens")
    )
    # The concept ids ride along as one array, so columns meet concepts by an equi-join.
    ids = concepts.agg(F.collect_set("concept_id").alias("ids"))
    base = (
        parsed.join(siblings, "table_name").join(F.broadcast(ids))
        .withColumn("concept_id", F.explode("ids")).drop("ids")
        .join(facts.withColumnRenamed("description", "concept_description"), "concept_id")
    )
    named = name_evidence(
        base.select(*own, "concept_id", "tokens", "key", "head", "entities", "is_family",
                    "entity_pool", "heads"),
        variants, vocabulary(variants),
    )
    out = base.join(named, [*own, "concept_id"])
    if similarities is not None:
        out = out.join(
            similarities.select(*own, "concept_id", F.col("similarity").alias("embedding_similarity")),
            [*own, "concept_id"], "left",
        )
    else:
        out = out.withColumn("embedding_similarity", F.lit(None).cast("double"))
    if relations is not None:
        hints = relations.groupBy(*own).agg(F.collect_set("concept").alias("hints"))
        out = out.join(hints, own, "left")
    else:
        out = out.withColumn("hints", F.lit(None).cast("array<string>"))
    described = F.when(
        F.coalesce(F.col("description"), F.lit("")) != "",
        F.round(F.greatest(
            text_similarity(F.col("description"), F.col("concept_description")),
            text_similarity(F.col("description"), F.col("concept_name")),
        ), 4),
    )
    actual = datatype_name()
    typed = F.when(
        F.size(F.coalesce("expected_types", F.array().cast("array<string>"))) > 0,
        F.array_contains("expected_types", actual).cast("double"),
    )
    keywords = F.when(
        (F.size("context_keywords") > 0) & (F.size("sibling_tokens") > 0),
        token_f1(F.col("sibling_tokens"), F.col("context_keywords")),
    )
    domain_tokens = split_name(F.lit(domain or ""))
    topical = F.when(
        (F.size("domain_keywords") > 0) & (F.size(domain_tokens) > 0),
        token_f1(domain_tokens, F.col("domain_keywords")),
    )
    context = F.coalesce(F.greatest(keywords, topical), F.when(
        F.lit(bool(domain)), text_similarity(F.lit(domain or ""), F.col("category"))
    ))
    related = F.when(
        F.col("hints").isNotNull(), F.array_contains("hints", F.col("concept_name")).cast("double")
    )
    roles = observed_roles()
    share = _profile_share(F.col("name_similarity"))
    return out.withColumn("observed_roles", roles).withColumns({
        "description_similarity": described, "datatype_compatibility": typed,
        "profile_compatibility": share, "value_evidence": _value_share(),
        "context_similarity": F.round(context, 4), "relationship_evidence": related,
        "profile_veto": share.isNotNull() & ~_fits(F.col("role"), F.col("observed_roles"), ROLE_FITS),
        "exact_name": (F.col("name_similarity") == 1) & ~F.col("opaque"),
        "exact_conflict": (F.col("name_similarity") == 1) & (
            (F.coalesce(typed, F.lit(1.0)) == 0)
            | ~_fits(F.col("role"), F.col("observed_roles"), EXACT_ROLE_FITS)
            | (F.col("role").isin("identifier", "code")
               & F.coalesce(F.col("constant") | F.col("near_constant"), F.lit(False)))
        ),
    }).select(
        *own, "concept_id", "concept_name", "family", "role", "is_family",
        F.coalesce("family_only", F.lit(False)).alias("family_only"), "opaque", "tokens",
        *WEIGHTS, "entity_conflict", "head_conflict", "profile_veto", "observed_roles",
        "exact_name", F.coalesce("exact_conflict", F.lit(False)).alias("exact_conflict"),
    )


def score_concepts(evidence: DataFrame) -> DataFrame:
    """E5: weighted mean over applicable evidence, coverage, and capped score."""
    total, weight, active, known = F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0)
    for feature, w in WEIGHTS.items():
        has = F.col(feature).isNotNull()
        total = total + F.when(has, F.col(feature) * w).otherwise(F.lit(0.0))
        weight = weight + F.when(has, F.lit(w)).otherwise(F.lit(0.0))
        known = known + has.cast("int")
        active = active + F.coalesce((F.col(feature) > 0).cast("int"), F.lit(0))
    raw = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / weight)), 4)
    out = evidence.withColumn("raw_score", raw).withColumn("coverage", active / known)
    capped = (
        F.when(F.col("entity_conflict"), F.least("raw_score", F.lit(AMBIGUOUS - 0.01)))
        .when(F.col("profile_veto") | F.col("head_conflict"),
              F.least("raw_score", F.lit(PROBABLE - 0.01)))
        .otherwise(F.col("raw_score"))
    )
    out = out.withColumn("score", capped)
    clears = F.col("score") >= PROBABLE
    kind = (
        F.when(F.col("entity_conflict"), F.when(F.col("is_family"), "FAMILY_MATCH").otherwise("UNKNOWN"))
        .when(clears & ~F.col("profile_veto"), "KB_MATCH")
        .when(F.col("is_family") & clears, "FAMILY_MATCH").otherwise("UNKNOWN")
    )
    return out.withColumn("candidate_kind", kind)


def confidence_level(score: Column, coverage: Column, margin: Column, kind: Column) -> Column:
    """Strong, Probable, Ambiguous or Unknown."""
    covered = coverage >= MIN_COVERAGE
    return (
        F.when(kind == "FAMILY_MATCH",
               F.when(score >= AMBIGUOUS, "Ambiguous").otherwise("Unknown"))
        .when((score >= STRONG) & covered & (margin >= STRONG_MARGIN), "Strong")
        .when((score >= PROBABLE) & covered & (margin >= PROBABLE_MARGIN), "Probable")
        .when(score >= AMBIGUOUS, "Ambiguous").otherwise("Unknown")
    )


def decide(scored: DataFrame) -> DataFrame:
    """One row per column: concept, kind, margin, alternatives, confidence.

    Exact names without a contradicting profile are looked at first; then the best
    specific concept, then the best family, else the column stays unknown.
    """
    own = ["table_name", "column_name"]
    rank = Window.partitionBy(*own).orderBy(F.col("score").desc(), "concept_id")
    # Windows over the concepts of one column.
    r = scored.withColumn("r", F.row_number().over(rank)).withColumn(
        "runner_up", F.lead("score").over(rank)
    )
    exact = F.col("exact_name") & ~F.col("exact_conflict")
    clean = ~(F.col("entity_conflict") | F.col("head_conflict") | F.col("profile_veto"))
    item = F.struct("score", "coverage", "concept_id", "concept_name", "family", "candidate_kind")
    order = F.struct(F.col("score"), (-F.col("concept_id")).alias("c"))

    def best(when: Column) -> Column:
        return F.max_by(F.when(when, item), F.when(when, order))

    fallback = F.col("is_family") & ~F.col("entity_conflict")
    out = r.groupBy(*own).agg(
        best(exact & clean & (F.col("candidate_kind") == "KB_MATCH")).alias("exact"),
        F.sort_array(F.collect_list(F.when(exact, F.col("score"))), asc=False).alias("exact_scores"),
        best(~F.col("family_only")).alias("specific"),
        best(fallback).alias("family_pick"),
        F.max(F.when(F.col("r") == 1, item)).alias("leader"),
        F.max(F.when(F.col("r") == 1, F.col("score") - F.coalesce("runner_up", F.lit(0.0)))).alias(
            "margin"),
        F.count(F.lit(1)).alias("n"), F.first("opaque").alias("opaque"),
        F.first("tokens").alias("tokens"),
        F.bool_or(F.col("exact_name") & F.col("exact_conflict")).alias("exact_but_profile_conflict"),
        F.sort_array(F.collect_list(
            F.when(F.col("r") <= ALTERNATIVES + 1, F.struct("r", "concept_name", "score"))
        )).alias("top"),
    )
    # get() is NULL past the end of the array.
    exact_margin = F.col("exact.score") - F.coalesce(F.get("exact_scores", F.lit(1)), F.lit(0.0))
    takes_exact = F.col("exact").isNotNull() & (exact_margin >= PROBABLE_MARGIN)
    takes_specific = F.col("specific.candidate_kind") == "KB_MATCH"
    takes_family = F.col("family_pick.score") >= AMBIGUOUS
    chosen = (
        F.when(takes_exact, F.col("exact")).when(takes_specific, F.col("specific"))
        .when(takes_family, F.col("family_pick")).otherwise(F.col("leader"))
    )
    kind = F.when(takes_exact | takes_specific, "KB_MATCH").when(
        takes_family, "FAMILY_MATCH").otherwise("UNKNOWN")
    out = out.withColumn("chosen", chosen).withColumn("decision_kind", kind)
    out = out.withColumn("margin", F.round(
        F.when(takes_exact, exact_margin)
        .when(F.col("n") > 1, F.col("margin")).otherwise(F.lit(0.0)), 4))
    named = F.filter("tokens", lambda t: (F.length(t) > 1) & ~t.rlike(r"^\d+$"))
    others = F.slice(
        F.filter("top", lambda t: (F.col("decision_kind") == "UNKNOWN") & (t["r"] > 1)
                 | (F.col("decision_kind") != "UNKNOWN")
                 & (t["concept_name"] != F.col("chosen.concept_name"))),
        1, ALTERNATIVES,
    )
    matched = F.col("decision_kind") == "KB_MATCH"
    return out.select(
        *own, "decision_kind",
        F.when(matched, F.col("chosen.concept_name")).alias("concept"),
        F.when(F.col("decision_kind") != "UNKNOWN", F.col("chosen.family")).alias("family"),
        F.col("chosen.score").alias("confidence_score"),
        F.round("chosen.coverage", 4).alias("evidence_coverage"), "margin",
        confidence_level(
            F.col("chosen.score"), F.col("chosen.coverage"), F.col("margin"), F.col("decision_kind")
        ).alias("confidence_level"),
        F.transform(others, lambda t: t["concept_name"]).alias("alternatives"),
        "exact_but_profile_conflict",
        # A new concept is proposed from the name unless the name says nothing.
        F.when(~matched & ~F.col("opaque") & (F.size(named) > 0), F.array_join(named, "_")).alias(
            "proposal"),
    )


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two runs side by side per column."""
    own = ["table_name", "column_name"]

    def side(run: DataFrame, name: str) -> DataFrame:
        return run.select(
            *own, F.col("concept").alias(f"{name}_prediction"),
            F.col("confidence_level").alias(f"{name}_confidence_level"),
        )

    joined = side(old, "old").join(side(new, "new"), own, "full")
    same = F.col("old_prediction").eqNullSafe(F.col("new_prediction"))
    return joined.withColumn("changed", ~same)
