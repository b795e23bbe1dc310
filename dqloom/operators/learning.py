"""Learning from human decisions, and measuring against gold labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The evidence features a reranker sees, in order.
FEATURES = (
    "embedding_similarity", "name_similarity", "description_similarity",
    "datatype_compatibility", "profile_compatibility", "context_similarity",
)
MIN_EXAMPLES = 20
SPLIT_SEED = 42


def training_examples(feedback: DataFrame, predictions: DataFrame, evidence: DataFrame) -> DataFrame:
    """L1: (table_name, column_name, features…, label) from human decisions.

    Approving or keeping the predicted concept is 1, replacing or rejecting it 0; an
    approval of another concept says nothing. Rows without any evidence are left out.
    """
    own = ["table_name", "column_name"]
    same = F.col("corrected_concept_id").eqNullSafe(F.col("predicted_concept_id"))
    label = (
        F.when(F.col("decision") == "approved", F.when(same, 1))
        .when(F.col("decision") == "edited", same.cast("int"))
        .when(F.col("decision") == "rejected", 0)
    )
    judged = feedback.join(
        predictions.select(*own, "predicted_concept_id"), own
    ).withColumn("label", label).filter(F.col("label").isNotNull())
    chosen = evidence.select(
        *own, F.col("concept_id").alias("predicted_concept_id"),
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES],
    )
    out = judged.join(chosen, [*own, "predicted_concept_id"]).select(*own, *FEATURES, "label")
    some = F.lit(False)
    for f in FEATURES:
        some = some | (F.col(f) != 0)
    return out.filter(some)


@dataclass
class Reranker:
    status: str
    metrics: DataFrame
    model: LogisticRegressionModel | None = None


METRICS_SCHEMA = (
    "status string, example_count long, train_count long, test_count long, accuracy double, "
    "f1 double, feature_names array<string>, feature_weights array<double>, intercept double"
)


def train_reranker(examples: DataFrame, features: list[str], key: str, label: str = "label") -> Reranker:
    """L2: balanced logistic regression on 80% of the examples, measured on the rest.

    The split hashes the row key, so it is the same however the rows are partitioned.
    Training never gathers the examples; Spark sums gradients across partitions.
    """
    spark = examples.sparkSession
    part = F.pmod(F.xxhash64(F.col(key), F.lit(SPLIT_SEED)), F.lit(5))
    data = VectorAssembler(inputCols=features, outputCol="features").transform(
        examples.withColumn("label", F.col(label).cast("double")).withColumn("part", part)
    ).select("features", "label", "part")
    counts = {r["label"]: r["n"] for r in data.groupBy("label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if total < MIN_EXAMPLES or len(counts) < 2:
        row = ("insufficient_data", total, None, None, None, None, features, None, None)
        return Reranker("insufficient_data", spark.createDataFrame([row], METRICS_SCHEMA))
    train = data.filter("part > 0")
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())
    weight = F.lit(1.0)
    for value, size in sizes.items():
        weight = F.when(F.col("label") == value, n / (len(sizes) * size)).otherwise(weight)
    # A ridge penalty of 1 on the summed loss, in Spark's averaged form.
    model = LogisticRegression(
        maxIter=1000, regParam=1.0 / n, standardization=False, weightCol="weight", tol=1e-8
    ).fit(train.withColumn("weight", weight))
    judged = model.transform(data.filter("part = 0"))
    hit, positive = F.col("prediction") == F.col("label"), F.col("label") == 1
    r = judged.agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("accuracy"),
        F.count_if(hit & positive).alias("tp"), F.count_if(~hit).alias("wrong"),
    ).first()
    denominator = 2 * r["tp"] + r["wrong"]
    row = (
        "trained", total, n, r["n"], round(r["accuracy"], 4) if r["n"] else None,
        round(2 * r["tp"] / denominator, 4) if denominator else 0.0, features,
        [round(float(c), 4) for c in model.coefficients], float(model.intercept),
    )
    return Reranker("trained", spark.createDataFrame([row], METRICS_SCHEMA), model)


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """L3: decisions of each kind, and all together."""
    def n(kind: str):
        return F.count_if(F.col("decision") == kind).alias(kind)

    return feedback.agg(
        F.count(F.lit(1)).alias("total"), n("approved"), n("edited"), n("rejected")
    )


def judged_columns(gold: DataFrame, predictions: DataFrame, aliases: DataFrame) -> DataFrame:
    """L4 rows: gold columns with the prediction, its verdict and the alias path.

    `gold`: dataset_id, table_name, column_name, targets (array; empty when no
    concept is acceptable). `predictions`: dataset_id, table_name, column_name,
    concept. `aliases`: alias (normalised name), concept_id.
    """
    from dqloom.functions.similarity import split_name

    def folded(frame: DataFrame) -> DataFrame:
        return frame.withColumns({
            "t": F.lower(F.trim("table_name")), "c": F.lower(F.trim("column_name"))})

    link = ["dataset_id", "t", "c"]
    hits = aliases.groupBy("alias").agg(F.count_distinct("concept_id").alias("hits"))
    predicted = folded(predictions).select(*link, F.col("concept").alias("predicted_concept"),
                                           F.lit(True).alias("has_prediction"))
    out = folded(gold).withColumn("alias", F.array_join(split_name(F.col("column_name")), " "))
    out = out.join(predicted, link, "left").join(hits, "alias", "left")
    path = (
        F.when(F.col("has_prediction").isNull(), "no_prediction")
        .when(F.col("hits") == 1, "unique_alias").when(F.col("hits") > 1, "alias_ambiguous")
        .otherwise("open_world")
    )
    correct = F.when(
        F.col("has_prediction") & (F.size("targets") > 0),
        F.coalesce(F.array_contains("targets", F.col("predicted_concept")), F.lit(False)),
    )
    return out.select(
        "dataset_id", "table_name", "column_name", "predicted_concept",
        path.alias("name_path"), correct.alias("correct"),
    )


def gold_accuracy(judged: DataFrame) -> DataFrame:
    """L4: accuracy over all and per dataset, with alias-path counts."""
    counts = [
        F.count(F.lit(1)).alias("gold_rows"),
        F.count("correct").alias("scored"), F.count_if("correct").alias("correct_count"),
        *[F.count_if(F.col("name_path") == p).alias(p) for p in
          ("no_prediction", "unique_alias", "alias_ambiguous", "open_world")],
    ]
    per = judged.groupBy("dataset_id").agg(*counts)
    every = judged.agg(*counts).withColumn("dataset_id", F.lit("(all)"))
    return per.unionByName(every).withColumn("accuracy", F.when(
        F.col("scored") > 0, F.round(F.col("correct_count") / F.col("scored"), 4)))
