"""Headline timings as one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. `profile_200k_x_20` is the published reference shape.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from dqloom import catalog  # noqa: E402
from dqloom.catalog.inputs import table  # noqa: E402
from dqloom.plans.profile import column_profile, profile_table  # noqa: E402
from dqloom.session import local_session  # noqa: E402

AS_OF = "2015-06-01 00:00:00"
HEADLINE = (
    "profile_nulls", "profile_distinct", "profile_top_values", "numeric_quantiles",
    "numeric_mad", "numeric_outliers", "text_patterns", "text_shapes", "duplicate_rows",
    "composite_keys", "functional_dependencies", "rule_suite", "score_breakdown",
    "rule_foreign_key", "rca_concentration", "remediation_apply", "drift_columns",
    "fk_containment", "vector_topk",
)


def reference_shape(spark: SparkSession) -> DataFrame:
    """200,000 rows x 20 columns: 17 text, 2 numeric, 1 boolean."""
    i = F.col("id")
    spread = F.pmod(F.xxhash64(i), F.lit(1_000_000)) / 1000.0
    return spark.range(0, 200_000, 1, 8).select(
        F.concat_ws("-", F.lit("ID"), (i % 50_000).cast("string"), i.cast("string")).alias("id"),
        F.concat(F.lit("AB-"), F.lpad((i % 1000).cast("string"), 4, "0")).alias("code"),
        spread.alias("price"), F.pmod(F.xxhash64(i, F.lit(1)), F.lit(50)).alias("quantity"),
        F.lit("2024-01-15").alias("date"), (F.pmod(F.xxhash64(i, F.lit(2)), F.lit(2)) == 0).alias("flag"),
        *[F.concat(F.lit("c"), (i % 10).cast("string")).alias(f"cat_{c}") for c in range(14)],
    )


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    queries = catalog.queries()
    table(spark, sf_dir, "region").collect()

    seconds: dict[str, float] = {}
    lineitem = table(spark, sf_dir, "lineitem")
    seconds["column_profile_lineitem"] = timed(
        lambda: column_profile(lineitem, AS_OF).collect())
    seconds["full_profile_lineitem"] = timed(
        lambda: profile_table(lineitem, "lineitem", AS_OF).observations.collect())
    wide = reference_shape(spark)
    seconds["profile_200k_x_20"] = timed(
        lambda: profile_table(wide, "shape", AS_OF).observations.collect())
    for name in HEADLINE:
        seconds[name] = timed(lambda: queries[name](spark, sf_dir).collect())
    print(json.dumps({
        "metric": "data_quality_headline_queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name,
    }))


if __name__ == "__main__":
    main()
