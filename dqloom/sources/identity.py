"""Fingerprints, duplicates, dataset matching."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqloom.session import ship

WHOLE = 64 * 1024 * 1024
PIECE = 8 * 1024 * 1024
STREAMED = {"file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss"}
STRONG_SIMILARITY = 0.80
MODERATE_SIMILARITY = 0.50


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, length) to (path, length, fingerprint), a piece of a file at a time."""
    for batch in batches:
        prints = []
        for path in batch["path"].to_pylist():
            if path.startswith("file:"):
                system, place = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
            else:
                system, place = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(place, compression=None) as data:
                while piece := data.read(PIECE):
                    digest.update(piece)
            prints.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch["path"], batch["length"], pa.array(prints, pa.string())],
                                         names=["path", "length", "fingerprint"])


def file_fingerprints(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """SHA-256 of each file's bytes, one task per file.

    The hash is a chain over the file, so its task reads all of it; of files over `WHOLE` bytes
    (or over what Spark reads as one value), `PIECE` bytes are in memory at a time. Schemes that
    Arrow can't open are left to Spark, up to its limit.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(list(paths))
    parts = files
    if {path.split(":", 1)[0] for path in files.inputFiles()} <= STREAMED:
        most = min(WHOLE, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
        parts = files.filter(F.col("length") <= most)
    found = parts.select("path", "length", F.sha2("content", 256).alias("fingerprint"))
    if parts is not files:
        pieces = files.filter(F.col("length") > most).select("path", "length")
        found = found.unionByName(pieces.mapInArrow(_streamed, "path string, length long, fingerprint string"))
    return found.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("length").alias("bytes"), "fingerprint")


def schema_fingerprint(catalog: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """SHA-256 over ordered table and column lines; `catalog` has table order.

    Needs table_order, table_name, pos, column_name, data_type: schema rows.
    """
    line = F.concat(F.lit("COLUMN:"), "column_name", F.lit("|TYPE:"), "data_type")
    head = F.concat(F.lit("TABLE:"), F.col("table_name"))
    per_table = catalog.groupBy(*by, "table_order", "table_name").agg(
        F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines")
    ).withColumn("text", F.array_join(F.concat(F.array(head), F.col("lines.line")), "\n"))
    whole = F.sort_array(F.collect_list(F.struct("table_order", "text")))
    return per_table.groupBy(*by).agg(
        F.sha2(F.array_join(F.transform(whole, lambda t: t["text"]), "\n"), 256).alias(
            "schema_fingerprint"
        )
    )


def content_fingerprint(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """SHA-256 over `filename|fingerprint` lines in lower-case file-name order."""
    entry = F.struct(
        F.lower("filename").alias("k"), F.concat_ws("|", "filename", "fingerprint").alias("v")
    )
    whole = F.sort_array(F.collect_list(entry))
    return files.groupBy(*by).agg(
        F.sha2(F.array_join(F.transform(whole, lambda e: e["v"]), "\n"), 256).alias(
            "content_fingerprint"
        )
    )


def classify_upload(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Which incoming files are already part of an active dataset.

    `incoming` has filename and fingerprint; `known` also dataset_id and deleted_at.
    """
    active = known.filter(F.col("deleted_at").isNull()).select("fingerprint").distinct()
    flagged = incoming.join(
        active.withColumn("duplicate", F.lit(True)), "fingerprint", "left"
    )
    return flagged.select(
        "filename", "fingerprint", F.coalesce("duplicate", F.lit(False)).alias("duplicate")
    )


def batch_verdict(flagged: DataFrame) -> DataFrame:
    """all_new, all_duplicates or review_required for the whole batch."""
    n, d = F.count(F.lit(1)), F.count_if("duplicate")
    verdict = F.when(d == 0, "all_new").when(d == n, "all_duplicates").otherwise("review_required")
    return flagged.agg(n.alias("files"), d.alias("duplicates"), verdict.alias("verdict"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union
    ).otherwise(F.lit(0.0))


def column_sets(catalog: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lower-case column, table and file-stem sets per dataset version (schema rows)."""
    stem = F.regexp_replace(F.lower("source_file"), r"\.[^.]*$", "")
    return catalog.groupBy(*by).agg(
        F.collect_set(F.lower("column_name")).alias("columns"),
        F.collect_set(F.lower("table_name")).alias("tables"),
        F.collect_set(stem).alias("stems"),
    )


def schema_similarity(datasets: DataFrame, key: str) -> DataFrame:
    """Jaccard similarity between the different schemas in use.

    `datasets` has `key` and `columns`. Datasets with the same column names are one
    schema, named after its smallest key; schemas meet on shared names, as only
    those pairs can score above zero.
    """
    schemas = datasets.groupBy(F.array_sort("columns").alias("columns")).agg(
        F.min(key).alias("id"), F.count(F.lit(1)).alias("datasets")
    )

    def names(side: str) -> DataFrame:
        return schemas.select(
            F.col("id").alias(f"{side}_id"), F.col("datasets").alias(f"{side}_datasets"),
            F.size("columns").alias(f"{side}_n"), F.explode("columns").alias("name"),
        )

    keys = [f"{side}_{c}" for side in ("left", "right") for c in ("id", "datasets", "n")]
    shared = names("left").join(names("right"), "name").filter("left_id < right_id").groupBy(
        *keys
    ).agg(F.count(F.lit(1)).alias("common"))
    union = F.col("left_n") + F.col("right_n") - F.col("common")
    return shared.select(
        "left_id", "right_id", "left_datasets", "right_datasets",
        F.round(F.col("common") / union, 4).alias("column_similarity"),
    )


def dataset_matches(incoming: DataFrame, versions: DataFrame) -> DataFrame:
    """Existing versions an incoming file may belong to, with the evidence.

    Both are schema rows (table_name, source_file, column_name); `versions` also has
    dataset_id, version_id, version_number. Names, never data.
    """
    new = column_sets(incoming, []).select(
        F.col("columns").alias("new_columns"), F.col("tables").alias("new_tables"),
        F.col("stems").alias("new_stems"),
    )
    old = column_sets(versions, ["dataset_id", "version_id", "version_number"])
    # `new` is a single row.
    out = old.join(F.broadcast(new))
    similarity = jaccard(F.col("new_columns"), F.col("columns"))
    out = out.select(
        "dataset_id", "version_id", "version_number",
        F.arrays_overlap("stems", "new_stems").alias("filename_match"),
        F.arrays_overlap("tables", "new_tables").alias("table_name_overlap"),
        F.round(similarity, 4).alias("column_similarity"), similarity.alias("exact"),
    )
    evidence = F.array_compact(F.array(
        F.when(F.col("filename_match"), "filename_match"),
        F.when(F.col("table_name_overlap"), "table_name_match"),
        F.when(F.col("exact") >= STRONG_SIMILARITY, "strong_column_similarity")
        .when(F.col("exact") >= MODERATE_SIMILARITY, "moderate_column_similarity"),
    ))
    return out.withColumn("evidence", evidence).filter(F.size("evidence") > 0).drop("exact")


def version_proposals(matches: DataFrame) -> DataFrame:
    """Every match proposes its version as the parent of the new one."""
    return matches.withColumn("proposed_parent_version_id", F.col("version_id"))
