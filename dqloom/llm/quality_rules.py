"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one
failure bit per rule; policies are versioned masks over these bits, so a policy change or
an ablation is integer arithmetic on the ledger and never reads a text again.

Only DataFrame functions are used. One document is one row, so nothing is shuffled to
measure it. The windows of a text are compared by 64-bit hashes.

Defined cases: a null text counts as one without words; an empty text has no words and
fails `few_words`; repeated rows are judged each on its own; columns of the input whose
names clash with ledger columns are replaced by the ledger's; an empty table gives an
empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, WORD_SPACE_CHARS, free_name, text_or_empty

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """`fails` is a boolean SQL expression over the measurements; `bit` never changes."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
)
POLICIES = {
    "v1": Policy("v1", ("few_words", "repeated_words")),
    "v2": Policy("v2", tuple(r.name for r in RULES)),
}
CURRENT = "v2"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WORD_SPACE}+"), lambda w: w != "")


def measure(df: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """`df`, without its text unless that is asked for, plus the measurements."""
    def windows(words: Column) -> Column:
        hashed = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
        return F.slice(hashed, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))

    def placed(hashes: Column) -> Column:
        return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def met_twice(ordered: Column) -> Column:
        def starts(e: Column, i: Column) -> Column:
            same = (F.coalesce(F.get(ordered, i - 1)["h"] == e["h"], F.lit(False))
                    | F.coalesce(F.get(ordered, i + 1)["h"] == e["h"], F.lit(False)))
            return F.when(same, e["p"])
        return F.array_sort(F.filter(F.transform(ordered, starts), lambda p: p.isNotNull()))

    def covered(starts: Column) -> Column:
        lengths = F.transform(starts, lambda p, i: F.coalesce(
            F.least(F.get(starts, i + 1) - p, F.lit(3)), F.lit(3)).cast("long"))
        return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)

    none = F.array().cast("array<struct<h:bigint,p:int>>")
    kept = [c for c in df.columns if (keep_text or c != text_col) and c.lower() not in MEASURES]
    t, w, l, h, o, s = (free_name(df, name) for name in ("_t", "_w", "_l", "_h", "_o", "_s"))
    # Each step is used more than once by the next, so it stays a step of its own.
    out = df.select(*kept, text_or_empty(text_col).alias(t))
    out = out.withColumn(w, _words(F.col(t))).withColumn(l, F.filter(
        F.split(F.col(t), "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")))
    out = out.withColumn(h, windows(F.col(w)))
    out = out.withColumn(o, F.when(F.size(h) > F.size(F.array_distinct(h)), placed(F.col(h))).otherwise(none))
    out = out.withColumn(s, met_twice(F.col(o)))
    # Measured once, whatever is asked of the results: filters don't move below a generator.
    m = free_name(df, "_m")
    out = out.select(*kept, F.explode_outer(F.array(F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, WORD_SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(l).cast("long").alias("n_lines"),
        (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
        covered(F.col(s)).alias("n_repeat_words"),
    ))).alias(m))
    return out.select(*kept, f"{m}.*")


def ledger(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep_text: bool = False) -> DataFrame:
    """`measure(df)` plus `failed_bits`: bit `rule.bit` is set where the rule fails."""
    measured = measure(df, text_col, keep_text)
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.drop("failed_bits").withColumn("failed_bits", bits)


def apply_policy(book: DataFrame, policy: Policy = POLICIES[CURRENT]) -> DataFrame:
    """Add `policy_version` and `kept` to a ledger."""
    failing = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    return book.withColumn("policy_version", F.lit(policy.version)).withColumn("kept", failing == 0)


def ablations(book: DataFrame, policy: Policy = POLICIES[CURRENT]) -> DataFrame:
    """What each rule of a policy is worth, from the ledger alone.

    Per rule: documents failing it, documents failing nothing else (the policy would keep
    them without the rule), and documents kept without the rule. Documents fold to one
    row per bit pattern first; the patterns are at most 2 ** number of rules.
    """
    patterns = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")) \
        .agg(F.count(F.lit(1)).alias("n"))
    named = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("mask"))
                      for r in RULES if r.name in policy.rules])
    bit, mask = F.col("bits"), F.col("r.mask")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return patterns.select("bits", "n", F.explode(named).alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        count(bit.bitwiseAND(mask) != 0).alias("n_failed"),
        count(bit == mask).alias("n_only_this_rule"),
        count(bit.bitwiseAND(F.bitwise_not(mask)) == 0).alias("n_kept_without"),
    )


def op4_query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = apply_policy(ledger(documents))
    base = F.lit(POLICIES["v1"].mask).cast("long")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "failed_bits", "n_lines",
    )


def ledger_sql(source: str = "documents") -> str:
    """The ledger of `source` in DuckDB SQL, with the text still in it."""
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    return f"""
WITH d AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {source}),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
m AS (SELECT w.* EXCLUDE (ws, ls), len(ws)::BIGINT AS n_words,
      length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
      coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (rid))
SELECT *, ({bits})::BIGINT AS failed_bits FROM m"""


def op4_sql() -> str:
    return f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & {POLICIES["v1"].mask}) <> 0 AS base_failed,
       (failed_bits & {POLICIES[CURRENT].mask}) = 0 AS kept, failed_bits, n_lines
FROM ({ledger_sql()}) l"""
