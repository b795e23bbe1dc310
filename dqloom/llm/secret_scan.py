"""Secret scan with multipart credential linking.

Strong candidates (long assigned secrets, access identifiers, long hexadecimal runs) are
reported as they stand. Weak candidates (short or oddly named secrets, user and client
identifiers, mixed random-looking runs, service endpoints) are reported only where a
complementary part lies near: a secret needs an identifier or an endpoint, an identifier
or endpoint needs a secret. Near means that at most `reach` code points lie between the end
of one part and the start of the other, in one scope, a stretch of text without a blank
line; parts that overlap are near. This is an interval join; as only "is there one" matters,
the first start after a part and the furthest end before it answer it without making pairs.
Weak parts that a base span overlaps are partners like any others, but the base span stands
for them in the report.

Only DataFrame functions are used. Positions come from the lengths of the matches and of
the gaps between them. Texts never leave their row; only parts are shuffled, by row.

Defined cases: a null text is empty; without candidates the span list is empty and its
digest is that of the empty string; repeated rows are scanned each; null ids stay null;
positions count code points, ends are exclusive; columns of the input other than id and
text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_or_empty

REACH = 300


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def named(*names: str, value: str) -> str:
    """`name = value` with optional quotes; group 2 is the value."""
    return f"({'|'.join(map(either_case, names))})[\"']?\\x20*[:=]\\x20*[\"']?({value})"


@dataclass(frozen=True)
class Kind:
    """What counts is the length of `group` and that the match holds all of `holds`."""

    name: str
    role: str
    base: bool
    pattern: str
    shortest: int
    longest: int = 1 << 30
    group: int = 0
    holds: tuple[str, ...] = ()


KINDS = (
    Kind("assign", "secret", True, named("password", "passwd", "secret", "token", "api_?key",
                                         value="[A-Za-z0-9+/_.=-]+"), 8, group=2),
    Kind("access", "identifier", True, "AKIA[A-Z0-9]+", 16),
    Kind("hex", "secret", True, "[0-9a-f]{32,}", 32),
    Kind("weak_secret", "secret", False, named(
        "passphrase", "password", "passwd", "pass", "pwd", "credentials?", "private_?key", "secret_?key", "secret",
        "auth_?token", "token", "api_?key", value="[A-Za-z0-9+/_.=!@-]+"), 4, group=2),
    Kind("weak_run", "secret", False, "[A-Za-z0-9+/]{24,}", 24, holds=("[a-z]", "[A-Z]", "[0-9]")),
    Kind("weak_id", "identifier", False, named(
        "user_?name", "user_?id", "user", "login", "account_?id", "account", "client_?id", "access_?key_?id", "access_?key",
        value="[A-Za-z0-9@+_.-]+"), 3, group=2),
    Kind("weak_access", "identifier", False, "AKIA[A-Z0-9]+", 8, 15),
    Kind("endpoint", "endpoint", False,
         "(?:https?|ftp|ssh|amqps?|redis|mysql|postgres|postgresql|mongodb)://[^\\x20\\x09-\\x0D\"'<>]+", 1),
)
SCOPE_BREAK = Kind("break", "", False, "\\n[\\x20\\x09\\r]*\\n", 1)


def _hits(text: Column, pattern: str, group: int) -> Column:
    """Per match: the gap before it, its length, the match and the wanted group."""
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))
    return F.when(text.rlike(pattern), F.filter(found, lambda x: x["m"].isNotNull()))


def parts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate and scope break (row, id, kind, start, end, ok), and one with
    a null kind per text, so that texts whose candidates all fail stay in the result."""
    text = F.col("t")
    shape = "array<struct<kind:int,at:int,gap:int,len:int,ok:boolean>>"
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))

    def listed(number: int, kind: Kind) -> Column:
        def one(x: Column, i: Column) -> Column:
            ok = F.length(x["v"]).between(kind.shortest, kind.longest)
            for piece in kind.holds:
                ok = ok & x["m"].rlike(piece)
            return F.struct(F.lit(number).alias("kind"), i.alias("at"), x["gap"].alias("gap"), F.length(x["m"]).alias("len"), ok.alias("ok"))
        return F.coalesce(F.transform(_hits(text, kind.pattern, kind.group), one), F.array()).cast(shape)

    found = rows.select("row", "id", "t", F.concat(*[listed(n, k) for n, k in enumerate(KINDS)]).alias("p"))
    weak = F.exists("p", lambda x: (x["kind"] >= F.lit(sum(k.base for k in KINDS))) & x["ok"])
    breaks = F.when(weak, listed(len(KINDS), SCOPE_BREAK)).otherwise(F.array().cast(shape))
    present = F.array(F.struct(F.lit(None).alias("kind"), F.lit(0).alias("at"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(False).alias("ok"))).cast(shape)
    flat = found.select("row", "id", F.explode(F.concat("p", breaks, present)).alias("p")).select("row", "id", "p.*")
    flat = flat.repartition("row")
    so_far = W.partitionBy("row", "kind").orderBy("at")
    ended = F.sum(F.col("gap") + F.col("len")).over(so_far)
    return flat.select("row", "id", "kind", (ended - F.col("len")).alias("start"), ended.alias("end"), "ok")


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """All reported spans: row, id, kind, start, end, base; besides, one row with a null
    kind per text."""
    kind, start = F.col("kind"), F.col("start")
    base_kinds, real = sum(k.base for k in KINDS), len(KINDS)
    roles = {role: kind.isin(*[n for n, k in enumerate(KINDS) if k.role == role]) for role in ("secret", "identifier", "endpoint")}
    usable = parts(df, id_col, text_col).filter(F.col("ok") | kind.isNull())
    is_base = kind < base_kinds
    row = W.partitionBy("row").orderBy("start")
    backward, forward = (row.rangeBetween(W.unboundedPreceding, 0), row.rangeBetween(0, W.unboundedFollowing))
    covered = F.coalesce((F.max(F.when(is_base, F.col("end"))).over(backward) > start)
                         | (F.min(F.when(is_base, start)).over(forward) < F.col("end")), F.lit(False))
    scoped = usable.withColumn("scope", F.count(F.when(kind == real, 1)).over(backward)) \
        .withColumn("covered", covered & ~is_base).filter(kind.isNull() | (kind < real))
    part = W.partitionBy("row", "scope").orderBy("start")
    earlier, later = part.rangeBetween(W.unboundedPreceding, 0), part.rangeBetween(0, W.unboundedFollowing)

    def near(role: Column) -> Column:
        return F.coalesce((F.max(F.when(role, F.col("end"))).over(earlier) + reach >= start)
                          | (F.min(F.when(role, start)).over(later) <= F.col("end") + reach), F.lit(False))

    linked = F.when(roles["secret"], near(roles["identifier"] | roles["endpoint"])).otherwise(near(roles["secret"]))
    told = scoped.withColumn("linked", linked).filter(kind.isNull() | is_base | (F.col("linked") & ~F.col("covered")))
    return told.select("row", "id", "kind", "start", "end", is_base.alias("base"))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per text: id, the base counts, the digest of base spans and all spans."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    spans = secret_spans(df, id_col, text_col, reach).withColumn("s", F.when(F.col("kind").isNotNull(), F.struct(
        "start", "kind", F.concat_ws(":", F.get(names, F.col("kind")), "start", "end").alias("said"), "base")))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: s["said"]), ",")
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    out = spans.groupBy("row", "id").agg(F.array_sort(F.collect_list("s")).alias("all"),
                                         count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"))
    return out.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.filter("all", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"),
        (F.size("all") - F.col("n_assign") - F.col("n_access") - F.col("n_hex")).cast("long").alias("n_linked"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op1_sql() -> str:
    def hits(n: int, kind: Kind) -> str:
        p = kind.pattern.replace("'", "''")
        holds = "".join(f" AND regexp_matches(m, '{x}')" for x in kind.holds)
        return f"""
SELECT rid, doc_id, {n} AS kind, start, start + length(m) AS stop FROM (
  SELECT rid, doc_id, m, v, sum(gap + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m) AS start FROM (
    SELECT rid, doc_id, i, ms[i] AS m, vs[i] AS v, length(gs[i]) AS gap FROM (
      SELECT rid, doc_id, ms, vs, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT rid, doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {kind.group}) AS vs,
               string_split_regex(t, '{p}') AS gs FROM d WHERE regexp_matches(t, '{p}')))))
WHERE length(v) BETWEEN {kind.shortest} AND {kind.longest}{holds}"""
    base = sum(k.base for k in KINDS)
    named_kinds = "[" + ", ".join(f"'{k.name}'" for k in KINDS) + "]"
    role = {r: "kind IN (" + ", ".join(str(n) for n, k in enumerate(KINDS) if k.role == r) + ")" for r in ("secret", "identifier", "endpoint")}
    up, down = "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    every = "\nUNION ALL".join(hits(n, k) for n, k in enumerate([*KINDS, SCOPE_BREAK]))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({every}),
c AS (SELECT *, count(CASE WHEN kind = {len(KINDS)} THEN 1 END) OVER (PARTITION BY rid ORDER BY start {up}) AS scope,
      coalesce(max(CASE WHEN kind < {base} THEN stop END) OVER (PARTITION BY rid ORDER BY start {up}) > start, false)
      OR coalesce(min(CASE WHEN kind < {base} THEN start END) OVER (PARTITION BY rid ORDER BY start {down}) < stop, false) AS hit FROM p),
r AS (SELECT *, {role['secret']} AS secret FROM c WHERE kind < {len(KINDS)}),
m AS (SELECT DISTINCT w.rid, w.kind, w.start FROM r AS w JOIN r AS o ON w.rid = o.rid AND w.scope = o.scope AND w.secret <> o.secret
      AND o.start - w.stop <= {REACH} AND w.start - o.stop <= {REACH} WHERE w.kind >= {base} AND NOT w.hit),
k AS (SELECT rid, kind, start, {named_kinds}[kind + 1] || ':' || start || ':' || stop AS said FROM r LEFT JOIN m USING (rid, kind, start)
      WHERE kind < {base} OR m.rid IS NOT NULL),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
      count(*) FILTER (kind >= {base}) AS l, string_agg(said, ',' ORDER BY start, kind) AS spans,
      string_agg(said, ',' ORDER BY start, kind) FILTER (kind < {base}) AS based FROM k GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(l, 0) AS n_linked FROM d LEFT JOIN g USING (rid)"""
