"""URL filters: allow and block entries in one trie, the longest match decides.

An entry is a host and a path. It fits its host and all subdomains, for urls whose path
starts with the entry's. The trie descends the reversed host labels and then the path
segments; the last segment of an entry may be cut short, so it is matched as a prefix.
The entry with the most host labels wins, among those the one with the longest path.
Urls that no entry fits get `default`.

The trie is broadcast when the entries' measured size is within `max_broadcast_bytes`;
beyond it `judge` joins the urls' host suffixes and path prefixes with the entries.

Defined cases: a null url or one without `://` has an empty host and path and fits
nothing; an empty path fits only entries without a path; repeated rows are judged each;
of equal entries the block entry wins; columns named like results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

#: Fixed values of the query: host, path, verdict.
ENTRIES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
RESULTS = ("host", "path", "rule", "verdict")
URL_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str | None) -> tuple[str, str]:
    found = URL_PARTS.search(url or "")
    return (found[1].translate(str.maketrans(UPPER, LOWER)), found[2]) if found else ("", "")


class PathNode:
    """Whole segments lead to children; `cut` holds the entries that end here."""

    def __init__(self) -> None:
        self.children: dict[str, PathNode] = {}
        self.cut: dict[str, tuple[str, str]] = {}

    def add(self, path: str, entry: tuple[str, str]) -> None:
        node, segments = self, path.split("/")
        for segment in segments[:-1]:
            node = node.children.setdefault(segment, PathNode())
        if entry[1] == "block" or segments[-1] not in node.cut:
            node.cut[segments[-1]] = entry

    def longest(self, path: str) -> tuple[str, str] | None:
        node, best = self, None
        for segment in path.split("/"):
            for length in sorted({len(c) for c in node.cut}, reverse=True):
                if found := node.cut.get(segment[:length]) if length <= len(segment) else None:
                    best = found
                    break
            node = node.children.get(segment)
            if node is None:
                break
        return best


class HostNode:
    def __init__(self) -> None:
        self.children: dict[str, HostNode] = {}
        self.paths = PathNode()


class Trie:
    def __init__(self, entries: Iterable[tuple[str, str, str]]) -> None:
        self.root = HostNode()
        for host, path, verdict in entries:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.children.setdefault(label, HostNode())
            node.paths.add(path, (host + path, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            best = node.paths.longest(path) or best
        return best


def _judge_with_trie(df: DataFrame, entries, url_col: str, default: str) -> DataFrame:
    ship(df.sparkSession)
    trie = df.sparkSession.sparkContext.broadcast(Trie(entries))
    kept = df.drop(*RESULTS) if url_col not in RESULTS else df
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.StringType()) for c in RESULTS]])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            parts = [split_url(u) for u in batch.column(url_col).to_pylist()]
            found = [match(*p) or (None, default) for p in parts]
            columns = [[p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, pa.string()) for c in columns]], names=[*batch.schema.names, *RESULTS])

    return kept.mapInArrow(judged, schema)


def _judge_with_join(df: DataFrame, entries: DataFrame, url_col: str, default: str) -> DataFrame:
    """Each url meets the entries under its host suffixes and those path prefixes whose
    length any entry has; the lengths are at most as many as the longest path."""
    lengths = sorted(r[0] for r in entries.select(F.length("path")).distinct().collect())
    keys = df.select(F.col(url_col).alias("u")).distinct().select("u", *url_columns(F.col("u")))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.struct(
        n.alias("n"), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".").alias("h")))
    met = keys.select("u", "path", F.explode(suffixes).alias("s")).select(
        "u", "path", "s.n", F.col("s.h").alias("h"), F.explode(F.array(*[F.lit(x) for x in lengths])).alias("l"))
    met = met.filter(F.length("path") >= F.col("l")).select("u", "n", "l", "h", F.substring("path", F.lit(1), F.col("l")).alias("p"))
    ruled = entries.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict")
    best = met.join(ruled, ["h", "p"]).groupBy("u").agg(F.max_by(
        F.struct(F.concat("h", "p").alias("rule"), F.col("verdict")),
        F.struct("n", "l", (F.col("verdict") == "block").alias("b"))).alias("best"))
    kept = df.drop(*RESULTS) if url_col not in RESULTS else df
    return kept.join(best, kept[url_col].eqNullSafe(best.u), "left").select(
        *[kept[c] for c in kept.columns], *url_columns(kept[url_col]), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def url_columns(url: Column) -> list[Column]:
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, URL_PARTS.pattern, 1), UPPER, LOWER)
    return [host.alias("host"), F.regexp_extract(text, URL_PARTS.pattern, 2).alias("path")]


def judge(df: DataFrame, entries: Iterable[tuple[str, str, str]] | DataFrame, url_col: str = "url",
          default: str = "allow", max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """`df` plus `host`, `path`, `rule` (null if none fits) and `verdict`."""
    spark = df.sparkSession
    if isinstance(entries, DataFrame):
        size = entries.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 200)).first()[0] or 0
        if size > max_broadcast_bytes:
            return _judge_with_join(df, entries, url_col, default)
        entries = [tuple(r) for r in entries.select("host", "path", "verdict").collect()]
    else:
        entries = list(entries)
        if sum(len(h.encode()) + len(p.encode()) + 200 for h, p, _ in entries) > max_broadcast_bytes:
            return _judge_with_join(df, spark.createDataFrame(entries, "host string, path string, verdict string"), url_col, default)
    return _judge_with_trie(df, entries, url_col, default)


def op6_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, ENTRIES).select("page_id", "host", "path", "rule", "verdict")


def op6_sql() -> str:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in ENTRIES)
    return f"""
WITH rules(h, p, v) AS (VALUES {rows}),
u AS (SELECT row_number() OVER () AS rid, page_id,
      translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
      regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
b AS (SELECT rid, arg_max({{'r': h || p, 'v': v}}, length(h) * 10000 + length(p)) AS x
      FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, x.r AS rule, coalesce(x.v, 'allow') AS verdict FROM u LEFT JOIN b USING (rid)"""
