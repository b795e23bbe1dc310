"""Mixing sources to target weights by Pareto order sampling.

Every source gets a share of the total size by its weight, at most `max_copies` times what
it has; what exceeds that is shared again by weight. A document's expected copies are its
source's target over the source's size, tilted by the document's own weight without moving
the source's total. Whole copies are certain. The rest is a fraction, the chance of one
more copy: documents are ranked by the odds of a hashed uniform number over the odds of
that chance, and the first of the ranking get the copy until the source's target is met,
to within half a document.

The ranking is cut without sorting a source: the ranks' order is preserved by a number that
is nearly uniform, documents are summed in buckets of it, and only the bucket that holds
the cut is put in order. A source has at least `BUCKETS` buckets and more as it grows, of
about `BUCKET_ROWS` rows. Sources' totals are one row each; the targets of all sources are
set in one task, which thousands of them suit.

Defined cases: a null source is one source, last in order; a null text has size 0; size-0
documents may be taken and add nothing; null, zero or negative document weights count as
1; null ids are hashed as such; equal rows have equal ranks and are interchangeable; an
empty table gives an empty result; columns of the input named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_SPACE, stored, text_or_empty
from .sharding import shuffle_key, source_key

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = "mix-1"
BUCKETS = 1024
BUCKET_ROWS = 50_000


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0,
            max_copies: int = MAX_COPIES) -> DataFrame:
    """`totals` (src, source, source_size: one row per source) plus `target`.

    The level at which targets stop is found by prefix sums over the sources in the order
    in which they reach their limits; this is where repeated resharing ends.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    given = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    every = W.orderBy("limit_ratio", "src").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    earlier = W.orderBy("limit_ratio", "src").rowsBetween(W.unboundedPreceding, -1)
    later = W.orderBy("limit_ratio", "src").rowsBetween(W.currentRow, W.unboundedFollowing)
    out = totals.withColumn("w", given).withColumn("most", max_copies * F.col("source_size"))
    out = out.withColumn("limit_ratio", F.col("most") / F.col("w"))
    out = out.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
    out = out.withColumn("capped", (F.col("budget") - F.coalesce(F.sum("most").over(earlier), F.lit(0)))
                         / F.sum("w").over(later) >= F.col("limit_ratio"))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(every), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)
    return out.withColumn("target", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(
        left.cast("double") * F.col("w") / open_weight)).select(*totals.columns, "target")


def mix(df: DataFrame, size_col: str = "size", weight_col: str | None = None, id_col: str = "doc_id",
        source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.0,
        max_copies: int = MAX_COPIES, seed: str = SEED, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`df` plus `source_size`, `target` (of its source) and `copies` (0 to `max_copies`).

    The frame is read several times: give it stored rows, with ids rather than texts.
    """
    results = ("source_size", "target", "copies")
    df = df.drop(*[c for c in results if c not in (size_col, weight_col, id_col, source_col)])
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    weight = F.lit(1.0) if weight_col is None else F.when(F.col(weight_col) > 0, F.col(weight_col).cast("double")).otherwise(1.0)
    rows = df.select(F.struct("*").alias("row"), source_key(F.col(source_col)).alias("src"),
                     F.col(source_col).alias("source"), size.alias("s"), weight.alias("v"),
                     ((shuffle_key(seed, F.col(id_col)) + F.lit(0.5)) / F.lit(float(1 << 52))).alias("u"))
    totals = rows.groupBy("src", "source").agg(
        F.sum("s").alias("source_size"), F.sum((F.col("v") * 1048576).cast("decimal(38,0)") * F.col("s")).alias("vs"),
        F.max("v").alias("v_max"), F.greatest(F.lit(buckets), F.ceil(F.count(F.lit(1)) / bucket_rows)).alias("buckets"))
    aims = targets(totals, weights, share, max_copies)
    rate = F.try_divide(F.col("target"), F.col("source_size"))
    mean = F.try_divide(F.col("vs").cast("double") / 1048576, F.col("source_size"))
    aims = aims.withColumn("rate", F.coalesce(rate, F.lit(0.0))).withColumn("mean", F.coalesce(mean, F.lit(1.0)))
    room = F.try_divide(F.try_divide(F.lit(float(max_copies)), F.col("rate")) - 1, F.try_divide(F.col("v_max"), F.col("mean")) - 1)
    aims = stored(aims.withColumn("tilt", F.when((F.col("v_max") > F.col("mean")) & (F.col("rate") > 0),
                                          F.greatest(F.lit(0.0), F.least(F.lit(1.0), room))).otherwise(0.0)), "aims")

    # A document's expected copies; what rounding adds beyond the limit is cut off.
    drawn = rows.drop("source").join(aims.drop("source", "vs", "v_max"), "src")
    drawn = drawn.withColumn("e", F.least(F.lit(float(max_copies)), F.round(
        F.col("rate") * (1 + F.col("tilt") * (F.coalesce(F.try_divide(F.col("v"), F.col("mean")), F.lit(1.0)) - 1)), 9)))
    drawn = drawn.withColumn("sure", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.col("sure"))
    chance = F.col("p") > 0
    drawn = drawn.withColumn("q", F.when(chance, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    asked = drawn.groupBy("src", "target").agg(
        F.sum(F.col("sure") * F.col("s")).alias("sure_size"),
        F.coalesce(F.sum(F.when(chance, F.col("s"))), F.lit(0)).alias("chance_size"))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("sure_size"))
    typical = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.coalesce(F.try_divide(rest, F.col("chance_size")), F.lit(0.5))))
    asked = stored(asked.select("src", rest.alias("rest"), (typical / (1 - typical)).alias("odds")), "asked")
    spread = F.col("q") * F.col("odds")
    drawn = drawn.join(asked, "src").withColumn(
        "b", F.when(F.col("q").isNotNull(), F.floor(spread / (1 + spread) * F.col("buckets")).cast("int")))

    before = W.partitionBy("src").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    sums = drawn.filter("b is not null").groupBy("src", "b").agg(F.sum("s").alias("n"))
    sums = stored(sums.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))), "sums")
    placed = drawn.join(sums.select("src", "b", "ahead", (F.col("ahead") + F.col("n")).alias("through")), ["src", "b"], "left")
    whole = F.col("through") + 0 <= F.col("rest")
    cut = ~whole & (F.col("ahead") < F.col("rest"))
    order = W.partitionBy("src").orderBy("q", "u", F.col(f"row.{id_col}"), "s").rowsBetween(W.unboundedPreceding, -1)
    shown = [F.col(f"row.`{c}`").alias(c) for c in df.columns]
    done = placed.filter(F.coalesce(~cut, F.lit(True))).select(
        *shown, "source_size", "target", (F.col("sure") + F.when(whole, 1).otherwise(0)).alias("copies"))
    edge = placed.filter(cut).withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("s").over(order), F.lit(0)))
    return done.unionByName(edge.select(*shown, "source_size", "target", (F.col("sure") + F.when(
        F.col("ahead") + F.col("s") / 2 <= F.col("rest"), 1).otherwise(0)).alias("copies")))


def word_count(text):
    return F.size(F.filter(F.split(text, f"{WORD_SPACE}+"), lambda w: w != "")).cast("long")


def length_weight(size):
    """Longer documents get a somewhat smaller chance of a further copy."""
    return 1 / (1 + F.least(size, F.lit(10_000)) / 10_000)


def op8_query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "source", word_count(text_or_empty()).alias("size"))
    documents = stored(documents.withColumn("weight", length_weight(F.col("size"))), "sizes")
    return mix(documents, weight_col="weight").select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_sql() -> str:
    levels = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    most = MAX_COPIES
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce('=' || source, '') AS src,
      len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS s FROM documents),
v AS (SELECT *, 1 / (1 + least(s, 10000) / 10000) AS v,
      (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u FROM d),
t AS (SELECT src, source, sum(s)::BIGINT AS n, sum(round(v * 1048576)::HUGEINT * s)::DOUBLE / 1048576 AS vs, max(v) AS vm FROM v GROUP BY ALL),
w AS (SELECT *, {levels}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS w FROM t),
l AS (SELECT *, sum(n) OVER () AS budget, (sum(n) OVER () - coalesce(sum({most} * n) OVER (ORDER BY {most} * n / w, src
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY {most} * n / w, src
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= {most} * n / w AS capped FROM w),
a AS (SELECT src, n, CASE WHEN capped THEN {most} * n ELSE
      (budget - coalesce(sum({most} * n) FILTER (capped) OVER (), 0))::DOUBLE * w / sum(w) FILTER (NOT capped) OVER () END::DOUBLE AS target,
      vs / n AS mean, vm FROM l),
r AS (SELECT *, coalesce(target / nullif(n, 0), 0) AS rate FROM a),
k AS (SELECT *, CASE WHEN vm > mean AND rate > 0 THEN greatest(0, least(1, ({most} / rate - 1) / (vm / mean - 1))) ELSE 0 END AS tilt FROM r),
e AS (SELECT v.*, n, target, least({most}, round(rate * (1 + tilt * (v / mean - 1)), 9)) AS e FROM v JOIN k USING (src)),
q AS (SELECT *, floor(e)::BIGINT AS sure, CASE WHEN e > floor(e) THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM e),
o AS (SELECT *, greatest(0, target - sum(sure * s) OVER (PARTITION BY src)) AS rest,
      sum(s) FILTER (q IS NOT NULL) OVER (PARTITION BY src ORDER BY q, u, doc_id, s, rid ROWS UNBOUNDED PRECEDING) AS through FROM q)
SELECT doc_id, s AS size, n AS source_size, target,
       ((sure + CASE WHEN q IS NOT NULL AND through - s + s / 2 <= rest THEN 1 ELSE 0 END) * s)::BIGINT AS taken FROM o"""
