"""Column meaning, recommendation and learning over profiles of the test tables."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from dqloom.catalog.inputs import dirty, table
from dqloom.catalog.registry import register
from dqloom.functions.similarity import split_name
from dqloom.operators import learning, meaning, recommend
from dqloom.plans.profile import column_profile, small
from dqloom.plans.quality import supported_templates

AS_OF = "2015-06-01 00:00:00"
_PROFILES: dict = {}


def profiles(spark, sf):
    """Column profiles of two tables, evaluated at the same time; one row per column,
    computed once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PROFILES:
        frames = {"customer": dirty(spark, sf, "customer"), "events": table(spark, sf, "events")}
        with ThreadPoolExecutor(max_workers=len(frames)) as pool:
            found = pool.map(lambda df: small(column_profile(df, AS_OF)), frames.values())
            parts = [p.withColumn("table_name", F.lit(name)) for name, p in zip(frames, found, strict=True)]
        _PROFILES[key] = parts[0].unionByName(parts[1])
    return _PROFILES[key]


def _concept(i, name, category, aliases, types, checks, role, family=False, **more):
    return (
        i, name, category, more.get("description", f"{name} of the record"), aliases, types, checks,
        more.get("entities"), more.get("heads", []), more.get("family", name), role, family, family,
        more.get("words"), more.get("pattern"), more.get("context", []), more.get("domain", []),
    )


def concepts(spark):
    """A hand-made concept table; the real one is an input of the library's user."""
    rows = [
        _concept(1, "Customer ID", "customer", ["cust key", "custkey", "customer key"],
                 ["int", "string"], {"identifier_like": "true", "unique": "true"}, "identifier",
                 family_name="Identifier"),
        _concept(2, "Customer Name", "customer", ["client name"], ["string"],
                 {"text": "true", "numeric": "false"}, "text"),
        _concept(3, "Email", "contact", ["email address", "c email"], ["string"],
                 {"email_pattern": "true", "text": "true"}, "text"),
        _concept(4, "Phone", "contact", ["phone number", "c phone"], ["string"],
                 {"phone_pattern": "true"}, "text"),
        _concept(5, "Account Balance", "finance", ["acctbal", "c acctbal"], ["float"],
                 {"numeric": "true", "continuous": "true"}, "measure", context=["name", "email"]),
        _concept(6, "Market Segment", "customer", ["mktsegment", "c mktsegment"], ["string"],
                 {"categorical": "true"}, "categorical",
                 words=["automobile", "building", "furniture", "household", "machinery"]),
        _concept(7, "Event Type", "activity", ["event kind"], ["string"],
                 {"categorical": "true", "text": "true"}, "categorical", domain=["activity"]),
        _concept(8, "Identifier", "generic", ["id", "key"], ["int", "string"],
                 {"identifier_like": "true"}, "identifier", True, entities=[], heads=["id"]),
        _concept(9, "Date", "generic", ["day", "since"], ["date", "datetime"],
                 {"temporal": "true"}, "date", True, entities=[], heads=["date", "time"]),
        _concept(10, "Amount", "generic", ["value", "total"], ["float", "int"],
                 {"numeric": "true"}, "measure", True, entities=[], heads=["amount"]),
    ]
    return spark.createDataFrame(rows, meaning.CONCEPT_SCHEMA)


@register("name_tokens")
def name_tokens(spark, sf):
    parsed = meaning.parse_names(profiles(spark, sf), "column_name", "table_name")
    return parsed.select(
        "table_name", "column_name", "key", "head", F.array_join("entities", " ").alias("entities"),
        "opaque",
    )


@register("vector_topk", """
    WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
               FROM embeddings),
    a AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY 1, 2),
    c AS (SELECT label, list(x ORDER BY i) AS v FROM a GROUP BY 1),
    s AS (SELECT vec_id AS id, c.label AS concept_id,
                 list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS sim FROM embeddings, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, concept_id) AS position FROM s)
    SELECT id, concept_id, round(sim, 4) AS similarity, CAST(position AS INT) AS position
    FROM r WHERE position <= 3""")
def vector_topk(spark, sf):
    """The three label centroids nearest to every vector."""
    vectors = table(spark, sf, "embeddings")
    centroids = (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        .select(F.col("label").alias("concept_id"), F.col("v.x").alias("vector"))
    )
    queries = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = meaning.vector_topk(queries, centroids, 3)
    return out.withColumn("similarity", F.round("similarity", 4))


def _evidence(spark, sf):
    return meaning.concept_evidence(profiles(spark, sf), concepts(spark), domain="activity")


def _flat(frame):
    for f in frame.schema.fields:
        if f.dataType.simpleString().startswith("array<string"):
            frame = frame.withColumn(f.name, F.array_join(f.name, ","))
    return frame


@register("lexical_candidates")
def lexical_candidates(spark, sf):
    parsed = meaning.parse_names(profiles(spark, sf), "column_name")
    return meaning.lexical_scores(parsed, meaning.concept_variants(concepts(spark)))


@register("column_roles")
def column_roles(spark, sf):
    return profiles(spark, sf).select(
        "table_name", "column_name", F.array_join(meaning.observed_roles(), ",").alias("roles")
    )


@register("concept_evidence")
def concept_evidence(spark, sf):
    return _flat(_evidence(spark, sf))


@register("concept_scores")
def concept_scores(spark, sf):
    return meaning.score_concepts(_evidence(spark, sf)).select(
        "table_name", "column_name", "concept_name", "score", "coverage", "candidate_kind"
    )


def _decisions(spark, sf):
    """One row per column, evaluated once, as several steps read it."""
    return small(meaning.decide(meaning.score_concepts(_evidence(spark, sf))))


@register("column_concepts")
def column_concepts(spark, sf):
    return _flat(_decisions(spark, sf))


@register("run_compare")
def run_compare(spark, sf):
    old = meaning.decide(meaning.score_concepts(
        meaning.concept_evidence(profiles(spark, sf), concepts(spark).filter("concept_id <> 6"))
    ))
    return meaning.compare_runs(old, _decisions(spark, sf))


def _context(spark, sf):
    keys = spark.createDataFrame(
        [("customer", ["c_custkey"], "approved"), ("events", ["user_id", "ts"], "pending")],
        recommend.KEY_SCHEMA,
    )
    links = spark.createDataFrame(
        [("customer", "c_custkey", "events", "user_id", "approved")], recommend.LINK_SCHEMA
    )
    meanings = _decisions(spark, sf).filter("concept IS NOT NULL")
    return small(recommend.column_context(profiles(spark, sf), meanings, keys, links)), links


@register("applicability")
def applicability(spark, sf):
    return _flat(recommend.applicability(_context(spark, sf)[0]))


def _candidates(spark, sf):
    required = spark.createDataFrame(
        [("customer", "c_rating", "completeness", False)], recommend.REQUIRED_SCHEMA
    )
    return recommend.rule_candidates(_context(spark, sf)[0], required=required)


@register("rule_candidates")
def rule_candidates(spark, sf):
    return _flat(_candidates(spark, sf))


@register("rule_checks")
def rule_checks(spark, sf):
    context, links = _context(spark, sf)
    rules = recommend.rule_candidates(context).withColumn(
        "rule_id", F.concat_ws(":", "table_name", F.array_join("target_columns", "+"), "rule_template")
    )
    bad = spark.createDataFrame(
        [("customer", ["no_such"], "NOT_NULL", "{}", "bad:1"),
         ("customer", ["c_name"], "UNIQUE", "{}", "bad:2"),
         ("customer", ["c_name"], "NO_SUCH_RULE", "{}", "bad:3"),
         ("events", ["user_id"], "FOREIGN_KEY_EXISTS",
          json.dumps({"parent_table": "x", "parent_column": "y", "child_table": "events",
                      "child_column": "user_id"}), "bad:4")],
        "table_name string, target_columns array<string>, rule_template string, "
        "parameters string, rule_id string",
    )
    every = rules.select(*bad.columns).unionByName(bad)
    checked = recommend.check_rules(every, profiles(spark, sf), links, supported_templates())
    return _flat(checked)


def _feedback(evidence):
    """Decisions on every predicted column: kept, replaced or rejected by name."""
    predicted = meaning.score_concepts(evidence).groupBy(
        "table_name", "column_name"
    ).agg(F.max_by("concept_id", F.struct("score", F.col("concept_id"))).alias("predicted_concept_id"))
    pick = F.pmod(F.xxhash64("column_name"), F.lit(3))
    feedback = predicted.select(
        "table_name", "column_name",
        F.when(pick == 0, "approved").when(pick == 1, "edited").otherwise("rejected").alias("decision"),
        F.when(pick == 0, F.col("predicted_concept_id")).when(pick == 1, F.lit(1)).alias(
            "corrected_concept_id"),
    )
    return feedback, predicted


@register("training_examples")
def training_examples(spark, sf):
    # Evidence and predictions are evaluated once, as several steps read them.
    evidence = small(_evidence(spark, sf))
    feedback, predicted = _feedback(evidence)
    return learning.training_examples(feedback, small(predicted), evidence)


@register("feedback_summary")
def feedback_summary(spark, sf):
    return learning.feedback_summary(_feedback(_evidence(spark, sf))[0])


@register("reranker_train")
def reranker_train(spark, sf):
    """Document quality from plain text facts, as a stand-in for judged candidates."""
    text = F.col("text")
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", (F.log1p("n_chars") / 10).alias("size"),
        (F.length(F.regexp_replace(text, r"[^A-Za-z]", "")) / F.greatest(F.length(text), F.lit(1)))
        .alias("letters"),
        (F.length(F.regexp_replace(text, r"[^0-9]", "")) / F.greatest(F.length(text), F.lit(1)))
        .alias("digits"),
        F.col("quality").alias("label"),
    )
    trained = learning.train_reranker(rows, ["size", "letters", "digits"], "doc_id")
    return _flat(trained.metrics).withColumn(
        "feature_weights", F.concat_ws(",", F.col("feature_weights").cast("array<string>"))
    )


@register("gold_accuracy")
def gold_accuracy(spark, sf):
    predictions = _decisions(spark, sf).withColumn("dataset_id", F.lit("sales"))
    gold = profiles(spark, sf).select(
        F.lit("sales").alias("dataset_id"), "table_name", "column_name",
        F.when(F.col("column_name").contains("email"), F.array(F.lit("Email")))
        .when(F.col("column_name").contains("custkey"), F.array(F.lit("Customer ID"), F.lit("Identifier")))
        .otherwise(F.array().cast("array<string>")).alias("targets"),
    )
    variants = meaning.concept_variants(concepts(spark)).select(
        "concept_id", F.array_join(split_name(F.col("v_name")), " ").alias("alias")
    )
    return learning.gold_accuracy(learning.judged_columns(gold, predictions, variants))
