"""Sources and identity over the test tables with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqloom.catalog.inputs import DIRTY, TABLES, dirty, dirty_sql, table
from dqloom.catalog.registry import register
from dqloom.catalog.relationship_queries import TABLES as COLUMNS
from dqloom.operators import tables
from dqloom.operators.counts import column_catalog
from dqloom.plans.profile import (
    column_facts,
    column_profile,
    dataset_profile,
    profile_table,
    small,
)
from dqloom.sources import identity
from dqloom.sources.files import discover_tables, typed

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _paths(sf: str, names=TABLES) -> list[str]:
    return [f"{sf}/{t}.parquet" for t in names]


@register("table_catalog", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{t}.parquet' AS source_file, (SELECT count(*) FROM {t}) AS row_count, "
    f"CAST(ordinal_position - 1 AS INT) AS pos, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' "
    "WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' "
    "WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' "
    "ELSE data_type END AS data_type "
    f"FROM information_schema.columns WHERE table_name = '{t}'" for t in TABLES
))
def table_catalog(spark, sf):
    return discover_tables(spark, _paths(sf))


@register("file_fingerprints")
def file_fingerprints(spark, sf):
    return identity.file_fingerprints(spark, _paths(sf))


@register("content_fingerprint")
def content_fingerprint(spark, sf):
    return identity.content_fingerprint(identity.file_fingerprints(spark, _paths(sf)))


def _catalogs(spark, sf, names):
    out = None
    for i, t in enumerate(names):
        part = column_catalog(table(spark, sf, t), t).withColumn("table_order", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


@register("schema_fingerprint")
def schema_fingerprint(spark, sf):
    return identity.schema_fingerprint(_catalogs(spark, sf, STAR))


@register("upload_duplicates")
def upload_duplicates(spark, sf):
    files = identity.file_fingerprints(spark, _paths(sf))
    known = files.filter(F.col("filename").isin("orders.parquet", "part.parquet")).select(
        "fingerprint", F.lit("sales").alias("dataset_id"),
        F.when(F.col("filename") == "part.parquet", F.current_timestamp()).alias("deleted_at"),
    )
    return identity.classify_upload(files, known)




@register("schema_similarity", """
    WITH t AS (SELECT conv_id AS id, list_sort(list_distinct(list(role || CAST(turn AS VARCHAR)))) AS columns
               FROM conversations GROUP BY 1),
    u AS (SELECT columns, min(id) AS id, count(*) AS datasets, len(columns) AS n FROM t GROUP BY 1),
    x AS (SELECT a.id AS left_id, b.id AS right_id, a.datasets AS left_datasets,
                 b.datasets AS right_datasets, len(list_intersect(a.columns, b.columns)) AS common,
                 a.n AS an, b.n AS bn FROM u a JOIN u b ON a.id < b.id)
    SELECT left_id, right_id, left_datasets, right_datasets,
           round(common * 1.0 / (an + bn - common), 4) AS column_similarity FROM x WHERE common > 0""")
def schema_similarity(spark, sf):
    """Conversations as datasets, role and turn as their column names."""
    sets = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(
        F.collect_set(F.concat("role", F.col("turn").cast("string"))).alias("columns")
    )
    return identity.schema_similarity(sets, "id")


@register("dataset_matches")
def dataset_matches(spark, sf):
    incoming = column_catalog(dirty(spark, sf, "customer"), "customer").withColumn(
        "source_file", F.lit("customer.csv")
    )
    known = None
    for i, t in enumerate(TABLES):
        part = column_catalog(table(spark, sf, t), t).select(
            "table_name", "column_name", F.lit(f"{t}.parquet").alias("source_file"),
            F.lit(t).alias("dataset_id"), F.lit(i).alias("version_id"),
            F.lit(1).alias("version_number"),
        )
        known = part if known is None else known.unionByName(part)
    return identity.version_proposals(identity.dataset_matches(incoming, known)).withColumn(
        "evidence", F.array_join("evidence", ",")
    )


_TYPED = [*DIRTY["customer"], "c_branch_code"]


@register("typed_columns", f"""WITH {dirty_sql('customer')},
    d AS (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS c_branch_code FROM dirty_customer),
    tall AS (""" + " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS column_name, trim(CAST({c} AS VARCHAR)) AS v FROM d" for i, c in enumerate(_TYPED)
    ) + """),
    f AS (SELECT pos, column_name, bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) AS num,
                 bool_and(regexp_matches(v, '^[+-]?[0-9]+$') AND TRY_CAST(v AS BIGINT) IS NOT NULL) AS whole,
                 bool_or(regexp_matches(v, '^0[0-9]+$')) AND list_contains(string_split(column_name, '_'), 'code') AS code,
                 bool_and(lower(v) IN ('true', 'false')) AS yes FROM tall WHERE v <> '' GROUP BY 1, 2),
    t AS (SELECT pos, column_name, CASE WHEN num AND code THEN 'string' WHEN whole THEN 'bigint' WHEN num THEN 'double'
                 WHEN yes THEN 'boolean' ELSE 'string' END AS data_type FROM f)
    SELECT 'customer' AS table_name, CAST(pos AS INT) AS pos, column_name, data_type,
           CASE WHEN data_type IN ('bigint', 'double') THEN 'numeric' ELSE data_type END AS kind FROM t""")
def typed_columns(spark, sf):
    """Customers as raw text, typed from their values; phone codes keep leading zeros."""
    raw = dirty(spark, sf, "customer")
    raw = raw.select(
        *[F.col(c).cast("string").alias(c) for c in raw.columns],
        F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("c_branch_code"),
    )
    return column_catalog(typed(raw), "customer")


_PROFILED = {**{t: list(COLUMNS[t]) for t in STAR}, "dirty_customer": list(DIRTY["customer"]), "dirty_orders": list(DIRTY["orders"])}


@register("dataset_profile", f"WITH {dirty_sql('customer', 'orders')}, t AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({len(columns)} AS BIGINT) AS column_count, "
    f"{' + '.join(f'count(*) - count({c})' for c in columns)} AS null_count FROM {t}" for t, columns in _PROFILED.items()
) + """) SELECT * FROM t UNION ALL SELECT '(dataset)', CAST(sum(row_count) AS BIGINT),
    CAST(sum(column_count) AS BIGINT), CAST(sum(null_count) AS BIGINT) FROM t""")
def full_dataset_profile(spark, sf):
    return dataset_profile({t: dirty(spark, sf, t[6:]) if t.startswith("dirty_") else table(spark, sf, t) for t in _PROFILED})


@register("column_profile")
def full_column_profile(spark, sf):
    out = column_profile(dirty(spark, sf, "customer"), "2015-06-01")
    return out.select(
        "column_name", "data_type", "stored_as", "row_count", "non_null_count", "null_count",
        "distinct_count", "duplicate_count", "identifier_signal", "identifier_like",
        "code_like", "semantic_storage_mismatch", "leading_zero_loss_suspected",
        "float_measure", "free_text", F.to_json("numeric").alias("numeric"),
        F.to_json("text").alias("text"), F.to_json("datetime").alias("datetime"),
        F.to_json("top_values").alias("top_values"), F.to_json("shape").alias("shape"),
    )


@register("identifier_like")
def identifier_like(spark, sf):
    out = column_profile(table(spark, sf, "events"), "2024-06-01")
    return out.select(
        "column_name", "identifier_like", "identifier_repeats",
        F.array_join("identifier_like_reasons", ",").alias("reasons"),
    )


@register("observations")
def table_observations(spark, sf):
    return profile_table(dirty(spark, sf, "customer"), "customer", "2015-06-01").observations


@register("composite_candidates")
def composite_candidates(spark, sf):
    customers = dirty(spark, sf, "customer")
    facts = column_facts(small(column_profile(customers, "2015-06-01")))
    found = tables.composite_candidates(customers, facts, facts[0]["row_count"])
    return found.withColumns({
        "columns": F.array_join("columns", "+"),
        "key_like_members": F.array_join("key_like_members", "+"),
    })
