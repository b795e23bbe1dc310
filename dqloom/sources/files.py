"""Reading tables from files."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqloom.functions import names
from dqloom.functions.missing import parse_number, quoted, strip

# What Windows-1252 has at the bytes 0x80 to 0x9F; five are undefined.
WINDOWS_1252 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ",
    0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“",
    0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›",
    0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}


def _is_utf8(name: str) -> bool:
    try:
        name.encode("iso-8859-1").decode("utf-8")
    except UnicodeError:
        return False
    return True


def read_text_table(
    spark: SparkSession, path: str, na_values: Sequence[str] = (), multi_line: bool = False
) -> DataFrame:
    """A CSV with every column as text: UTF-8, else Windows-1252, else Latin-1.

    The file is read byte for byte, so what its bytes are decides, not how they look
    once decoded: a replacement character that really stands in a UTF-8 file is kept.
    Only the empty field is NULL unless `na_values` names more. `multi_line` allows
    line breaks inside quoted cells, at the price of one task per file.
    """
    raw = spark.read.csv(
        path, header=True, inferSchema=False, encoding="ISO-8859-1", multiLine=multi_line,
        escape='"', nullValue="", emptyValue="",
    )
    octets = {name: F.encode(quoted(name), "ISO-8859-1").cast("string") for name in raw.columns}
    bad = F.lit(False)
    for c in octets.values():
        bad = bad | F.coalesce(~F.is_valid_utf8(c), F.lit(False))
    utf8 = all(map(_is_utf8, raw.columns)) and raw.filter(bad).isEmpty()
    low, high = "".join(map(chr, WINDOWS_1252)), "".join(WINDOWS_1252.values())
    columns = []
    for name in raw.columns:
        c = octets[name] if utf8 else F.translate(quoted(name), low, high)
        shown = name.encode("iso-8859-1").decode("utf-8").removeprefix("\ufeff") if utf8 else name.translate(WINDOWS_1252)
        if na_values:
            c = F.when(~c.isin(*na_values), c)
        columns.append(c.alias(shown))
    return raw.select(*columns)


def typed(df: DataFrame) -> DataFrame:
    """S3: types for an all-text table from one scan.

    A column becomes whole numbers, numbers, booleans or stays text, by what every
    value allows. A code-named column with a leading zero stays text, since a number
    would lose the zero.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    aggregates: list[Column] = []
    for i, name in enumerate(text):
        c = strip(quoted(name))
        filled = c != ""
        number = parse_number(c)

        def every(test: Column, filled: Column = filled) -> Column:
            return F.coalesce(F.bool_and(F.when(filled, test)), F.lit(False))

        aggregates += [
            F.count_if(filled).alias(f"n{i}"),
            every(number.isNotNull()).alias(f"num{i}"),
            every(c.rlike(r"^[+-]?\d+$") & c.try_cast("bigint").isNotNull()).alias(f"int{i}"),
            every(c.rlike(r"^[+-]?\d{1,38}$")).alias(f"wide{i}"),
            every(c.rlike(r"^[+-]?\d+$")).alias(f"digits{i}"),
            every(F.lower(c).isin("true", "false")).alias(f"bool{i}"),
            F.coalesce(F.bool_or(c.rlike(r"^0\d+$")), F.lit(False)).alias(f"zero{i}"),
            names.has_token(F.lit(name), names.CODE_TOKENS).alias(f"code{i}"),
        ]
    # One row of flags.
    row = df.agg(*aggregates).first()
    columns = []
    for name in df.columns:
        c = quoted(name)
        i = text.index(name) if name in text else -1
        if i < 0 or not row[f"n{i}"]:
            columns.append(c.alias(name))
        elif row[f"num{i}"] and row[f"zero{i}"] and row[f"code{i}"]:
            columns.append(F.nullif(strip(c), F.lit("")).alias(name))
        elif row[f"int{i}"]:
            columns.append(strip(c).try_cast("bigint").alias(name))
        elif row[f"wide{i}"]:
            columns.append(strip(c).try_cast("decimal(38,0)").alias(name))
        elif row[f"digits{i}"]:
            columns.append(F.nullif(strip(c), F.lit("")).alias(name))
        elif row[f"num{i}"]:
            columns.append(parse_number(c).alias(name))
        elif row[f"bool{i}"]:
            columns.append(strip(c).try_cast("boolean").alias(name))
        else:
            columns.append(c.alias(name))
    return df.select(*columns)


def unique_names(df: DataFrame) -> DataFrame:
    """Repeated column names get their position appended."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(df.columns):
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}__pos{i}")
    return df.toDF(*out)


def read_table(
    spark: SparkSession, path: str, na_values: Sequence[str] = (), multi_line: bool = False
) -> DataFrame:
    """One table from a CSV or Parquet file or folder."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".csv":
        return typed(read_text_table(spark, path, na_values, multi_line))
    if suffix in (".parquet", ""):
        return unique_names(spark.read.parquet(path))
    raise ValueError(f"unsupported table format: {suffix}")


def table_name(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).stem


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the CSV and Parquet tables directly in a folder, in name order."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = [s.getPath().toString() for s in system.listStatus(root)]
    kept = [p for p in paths if PurePosixPath(p).suffix.lower() in (".csv", ".parquet")]
    return sorted(kept)


def discover_tables(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per column of every table: table, source, rows, position, name, type."""
    out: DataFrame | None = None
    for path in paths:
        df = read_table(spark, path)
        schema = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
        described = spark.createDataFrame(
            schema, "pos int, column_name string, data_type string"
        )
        rows = df.agg(F.count(F.lit(1)).alias("row_count"))
        part = described.join(F.broadcast(rows)).select(
            F.lit(table_name(path)).alias("table_name"),
            F.lit(PurePosixPath(path).name).alias("source_file"),
            "row_count", "pos", "column_name", "data_type",
        )
        out = part if out is None else out.unionByName(part)
    return out
