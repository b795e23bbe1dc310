"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regular expression class
#: and as plain characters.
WORD_SPACE = "[\\x20\\x09-\\x0D]"
WORD_SPACE_CHARS = " \t\n\x0b\x0c\r"

_OWN_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application, so that Python
    tasks can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="dqloom-source-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only where the session names none (tests in one process) is a temporary one made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        key = spark.sparkContext.applicationId
        folder = _OWN_FOLDERS.setdefault(key, "") or tempfile.mkdtemp(prefix="dqloom-shared-")
        _OWN_FOLDERS[key] = folder
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/dqloom-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    The plan behind it ends there: a lost executor only repeats a read. The table stays
    until the folder is cleaned, since the returned frame reads it lazily.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def unit_interval(*parts: Column) -> Column:
    """A number in (0, 1) that only depends on `parts`, from the top 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or a variant of it that `df` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of `edges` (a, b: non-null ids of one type).

    The component is its smallest node. Each round links every neighbour to the smallest
    one, first upwards and then downwards; the rounds grow with the logarithm of the
    longest path, and each is stored, so losing an executor never repeats earlier ones.
    A node with very many edges is pre-aggregated and its joins can be split.
    """
    now = stored(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")


#: One row per key may be broadcast up to this many keys and bytes of keys.
BROADCAST_KEYS = 1_000_000
BROADCAST_KEY_BYTES = 64 << 20


def met_by_key(rows: DataFrame, by_key: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """`rows` plus the columns of `by_key`, one row per value of `key`, nulls too.

    Up to `BROADCAST_KEYS` keys are broadcast; more are repeated `salts` times, so that a
    key with a third of all rows is met in that many pieces.
    """
    by_key = stored(by_key, "keys")
    held = by_key.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0)).alias("bytes")).first()
    other = by_key.withColumnRenamed(key, "__key")
    if held.n <= BROADCAST_KEYS and held.bytes <= BROADCAST_KEY_BYTES:
        return rows.join(F.broadcast(other), rows[key].eqNullSafe(other["__key"]), "left").drop("__key")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)))
    other = other.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(other, salted[key].eqNullSafe(other["__key"]) & (F.col("__salt") == F.col("__other")), "left") \
        .drop("__key", "__salt", "__other")
