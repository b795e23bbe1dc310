"""Rules that need to see more than one row: uniqueness, dependencies, lookups.

Each counts over pre-aggregated keys, so a key that holds a third of the table is
one row by the time it is shuffled or joined.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqloom.functions.missing import canonical_key, quoted, strip
from dqloom.operators.frequency import Field
from dqloom.operators.rules import Cell, Context, RuleError, parameters, template_of
from dqloom.operators.tables import comparable, group_value

#: An automaton holds at most about this many characters of entries.
SHARD_CHARACTERS = 2_000_000


class KeyedRule:
    """A rule decided per key: `key` columns, rows it applies to, failing keys."""

    #: When a group of equal keys fails, said about its fused counts; none if the keys
    #: themselves must be looked at.
    broken: str | None = None
    dependent: Column | None = None
    allowed: DataFrame | None = None

    def __init__(self, df: DataFrame, keys: list[Column], applicable: Column, counted: Column):
        self.df, self.keys, self.applicable, self.counted = df, keys, applicable, counted
        self.names = [f"key{i}" for i in range(len(keys))]

    def keyed(self) -> DataFrame:
        named = [k.alias(n) for k, n in zip(self.keys, self.names)]
        return self.df.select(
            *named, self.applicable.alias("applicable"), self.counted.alias("counted")
        )

    def bad_keys(self, groups: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _groups(self) -> DataFrame:
        return self.keyed().filter("counted").groupBy(*self.names).agg(
            F.count(F.lit(1)).alias("cnt")
        )

    def counts(self) -> DataFrame:
        """One row: total, applicable and failed rows."""
        totals = self.keyed().agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if("applicable").alias("applicable_rows"),
        )
        failed = self.bad_keys(self._groups()).agg(
            F.coalesce(F.sum("cnt"), F.lit(0)).alias("failed_rows")
        )
        # Two single-row frames.
        return totals.join(F.broadcast(failed))

    def failing_rows(self) -> DataFrame:
        """The rows whose key fails; the distinct failing keys are the build side."""
        named = [k.alias(n) for k, n in zip(self.keys, self.names)]
        rows = self.df.select("*", *named, self.counted.alias("counted__")).filter("counted__")
        bad = self.bad_keys(self._groups()).select(
            *[F.col(n).alias(f"bad_{n}") for n in self.names]
        )
        same = F.lit(True)
        for n in self.names:
            same = same & F.col(n).eqNullSafe(F.col(f"bad_{n}"))
        return rows.join(bad, same, "left_semi").drop(*self.names, "counted__")


class _Repeated(KeyedRule):
    broken = "cnt > 1"

    def bad_keys(self, groups):
        return groups.filter(self.broken)


class _Inconsistent(KeyedRule):
    """Failing keys have more than one distinct dependent value."""

    broken = "lo <> hi"

    def __init__(self, df, keys, applicable, counted, dependent: Column):
        super().__init__(df, keys, applicable, counted)
        self.dependent = dependent

    def keyed(self):
        return self.df.select(
            self.keys[0].alias("key0"), self.applicable.alias("applicable"),
            self.counted.alias("counted"), self.dependent.alias("dependent"),
        )

    def _groups(self):
        return self.keyed().filter("counted").groupBy("key0").agg(
            F.count(F.lit(1)).alias("cnt"), F.min("dependent").alias("lo"),
            F.max("dependent").alias("hi"),
        )

    def bad_keys(self, groups):
        return groups.filter(self.broken)


class _Absent(KeyedRule):
    """Failing keys are absent from a frame of allowed keys."""

    broken = "allowed IS NULL"

    def __init__(self, df, keys, applicable, counted, allowed: DataFrame):
        super().__init__(df, keys, applicable, counted)
        self.allowed = allowed

    def bad_keys(self, groups):
        return groups.join(self.allowed, self.names, "left_anti")


class _NotContaining(_Absent):
    """Failing texts contain none of the entries of a reference.

    The entries are dealt to shards of about `SHARD_CHARACTERS`, each shard becomes one
    Aho-Corasick automaton, and every distinct text is read once per shard, whatever the
    entries' number and lengths and whatever they have in common. Entries that fit into one
    shard are broadcast, so the texts stay where they are; with more, texts and shards meet
    in tasks that hold one automaton, sorted so that a shard's entries come first, and the
    texts stream past it. Shards are dealt by hash, so entries with a common start spread.
    """

    broken = None

    def bad_keys(self, groups):
        entries = self.allowed.select(F.col("key0").alias("entry")).distinct()
        size = entries.agg(F.coalesce(F.sum(F.length("entry") + 1), F.lit(0)).alias("n"),
                           F.coalesce(F.bool_or(F.col("entry") == ""), F.lit(False)).alias("every")).first()
        if size.every:
            return groups.filter(F.lit(False))  # every text contains the empty entry
        if not size.n:
            return groups
        shards = -(-size.n // SHARD_CHARACTERS)
        if shards == 1:
            listed = sorted(r["entry"] for r in entries.collect())
            return groups.mapInArrow(_unmatched(listed), groups.schema)
        spark = groups.sparkSession
        of = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
        wide = groups.select("key0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(int(shards) - 1)))).select(
            "shard", F.lit(1).alias("kind"), F.col("key0").alias("text"))
        both = entries.select(of("entry").alias("shard"), F.lit(0).alias("kind"), F.col("entry").alias("text")).unionByName(wide)
        # A shard's texts are read in several tasks, each with its own copy of the automaton.
        spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // int(shards))
        piece = F.when(F.col("kind") == 1, F.pmod(F.xxhash64("text", F.lit("piece")), F.lit(spread)))
        both = both.withColumn("piece", F.explode(F.when(piece.isNotNull(), F.array(piece)).otherwise(
            F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long")))))
        met = both.repartition("shard", "piece").sortWithinPartitions("shard", "piece", "kind").mapInArrow(_matched, "text string")
        return groups.join(met.distinct(), F.col("key0") == F.col("text"), "left_anti")


# Defined here so that tasks get the functions by value: workers need no install.
def _unmatched(entries: list[str]):
    def tested(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for e in entries:
            automaton.add_word(e)
        automaton.make_automaton()
        for batch in batches:
            texts = batch.column("key0").to_pylist()
            keep = [t is None or next(automaton.iter(t), None) is None for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return tested


def _matching():
    def tested(batches):
        import ahocorasick
        import pyarrow as pa

        at, automaton, open_ = None, None, False
        for batch in batches:
            found = []
            for shard, piece, kind, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "piece", "kind", "text")), strict=True):
                if (shard, piece) != at:
                    at, automaton, open_ = (shard, piece), ahocorasick.Automaton(ahocorasick.STORE_LENGTH), False
                if kind == 0:
                    automaton.add_word(text)
                    continue
                if not open_:
                    automaton.make_automaton()
                    open_ = True
                if text is not None and len(automaton) and next(automaton.iter(text), None) is not None:
                    found.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["text"])

    return tested


_matched = _matching()


def fused_counts(df: DataFrame, rules: Mapping[str, KeyedRule]) -> DataFrame:
    """(rule_id, total_rows, applicable_rows, failed_rows) of many set rules of one table.

    One scan and one grouping for all: a row is repeated once per rule as 128 bits of key
    hash, a dependent's hash and two flags, and equal keys fold before the shuffle. Allowed
    keys of all rules meet the groups in one join.
    """
    columns: list[Column] = []
    allowed: DataFrame | None = None

    def halves(keys: list[Column]) -> list[Column]:
        told = [x for k in keys for x in (k, k.isNull())]
        return [F.xxhash64(*told), F.xxhash64(F.lit("second"), *told)]

    for i, rule in enumerate(rules.values()):
        counted = F.coalesce(rule.counted, F.lit(False))
        k, l = halves(rule.keys)
        dependent = F.lit(None).cast("long") if rule.dependent is None else F.when(rule.dependent.isNotNull(), F.xxhash64(rule.dependent))
        columns += [F.when(counted, k).alias(f"k{i}"), F.when(counted, l).alias(f"l{i}"), F.when(counted, dependent).alias(f"d{i}"),
                    F.coalesce(rule.applicable, F.lit(False)).cast("long").alias(f"a{i}"), counted.cast("long").alias(f"c{i}")]
        if rule.allowed is not None:
            k, l = halves([F.col(n) for n in rule.names])
            part = rule.allowed.select(F.lit(i).alias("rule"), k.alias("k"), l.alias("l"), F.lit(True).alias("allowed")).distinct()
            allowed = part if allowed is None else allowed.unionByName(part)
    groups = ", ".join(f"(k{i}, l{i}, d{i}, a{i}, c{i}) AS `{i}`" for i in range(len(rules)))
    rows = df.sparkSession.sql(
        f"SELECT CAST(rule AS INT) AS rule, k, l, d, a, c FROM {{wide}} UNPIVOT ((k, l, d, a, c) FOR rule IN ({groups}))", wide=df.select(*columns))
    met = rows.groupBy("rule", "k", "l").agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("c").alias("cnt"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    met = met.withColumn("allowed", F.lit(None).cast("boolean")) if allowed is None else met.join(allowed, ["rule", "k", "l"], "left")
    broken = F.expr("CASE rule " + " ".join(f"WHEN {i} THEN {r.broken}" for i, r in enumerate(rules.values())) + " END")
    names = F.array(*[F.lit(name) for name in rules])
    return met.groupBy("rule").agg(
        F.sum("n").alias("total_rows"), F.sum("a").alias("applicable_rows"),
        F.coalesce(F.sum(F.when(F.col("k").isNotNull() & broken, F.col("cnt"))), F.lit(0)).alias("failed_rows"),
    ).select(F.get(names, F.col("rule")).alias("rule_id"), "total_rows", "applicable_rows", "failed_rows")


def _value(df: DataFrame, name: str) -> Column:
    cell = Cell(df, name)
    return group_value(Field(0, name, cell.dtype))


def _uniqueness(df, rule, ctx) -> KeyedRule:
    params = parameters(rule)
    columns = list(rule.get("columns") or ([rule["column"]] if rule.get("column") else []))
    if not columns:
        raise RuleError("a uniqueness rule needs at least one column")
    ignore_nulls = params.get("ignore_nulls", rule.get("ignore_nulls", True))
    normalise = params.get("normalize_whitespace", rule.get("normalize_whitespace", True))
    keys, applicable = [], F.lit(True)
    for name in columns:
        cell = Cell(df, name)
        value = _value(df, name)
        keys.append(F.lower(strip(value)) if cell.is_text and normalise else value)
        if ignore_nulls:
            applicable = applicable & cell.present
    return _Repeated(df, keys, applicable, applicable)


def _dependency(df, rule, ctx) -> KeyedRule:
    params = parameters(rule)
    a = _value(df, params.get("determinant_column"))
    dependent = params.get("dependent_column")
    b = comparable(Field(0, dependent, Cell(df, dependent).dtype))
    return _Inconsistent(df, [a], F.lit(True), a.isNotNull(), b)


def _hierarchy(df, rule, ctx) -> KeyedRule:
    params = parameters(rule)
    parent = Cell(df, params.get("parent_column"))
    child = Cell(df, params.get("child_column"))
    hierarchy = params.get("hierarchy")
    if isinstance(hierarchy, DataFrame):
        allowed = hierarchy.select(
            F.lower(strip(F.col("parent").cast("string"))).alias("key0"),
            F.lower(strip(F.col("child").cast("string"))).alias("key1"),
        ).distinct()
    else:
        if isinstance(hierarchy, Mapping):
            pairs = [(p, c) for p, children in hierarchy.items() for c in children or []]
        elif isinstance(hierarchy, list) and hierarchy:
            pairs = [(e.get("parent", ""), e.get("child", "")) for e in hierarchy]
        else:
            raise RuleError("a REFERENCE_HIERARCHY rule needs its parent and child pairs")
        allowed = df.sparkSession.createDataFrame(
            [(str(p), str(c)) for p, c in pairs], "parent string, child string"
        ).select(
            F.lower(strip(F.col("parent"))).alias("key0"),
            F.lower(strip(F.col("child"))).alias("key1"),
        ).distinct()
    applicable = parent.value.isNotNull() & child.value.isNotNull()
    keys = [F.lower(strip(c.value.cast("string"))) for c in (parent, child)]
    return _Absent(df, keys, applicable, applicable, allowed)


def _foreign_key(df, rule, ctx: Context) -> KeyedRule:
    params = parameters(rule)
    child = Cell(df, params.get("child_column") or rule.get("column"))
    parent_table = ctx.tables.get(params.get("parent_table"))
    if parent_table is None:
        raise RuleError(f"the parent table {params.get('parent_table')!r} is not loaded")
    parent = Cell(parent_table, params.get("parent_column"))
    allowed = (
        parent_table.select(canonical_key(parent.value, parent.dtype).alias("key0"))
        .filter(F.col("key0").isNotNull()).distinct()
    )
    key = canonical_key(child.value, child.dtype)
    return _Absent(df, [key], F.lit(True), child.value.isNotNull(), allowed)


def _reference_lookup(df, rule, ctx: Context) -> KeyedRule:
    params = parameters(rule)
    cell = Cell(df, rule.get("column"))
    source = ctx.references.get(params.get("reference"))
    if source is None:
        source = params.get("reference_values")
    if source is None:
        raise RuleError("a REFERENCE_LOOKUP rule needs reference values")
    if isinstance(source, DataFrame):
        f = source.schema.fields[0]
        allowed = source.select(canonical_key(quoted(f.name), f.dataType).alias("key0"))
    else:
        allowed = df.sparkSession.createDataFrame(
            [(str(v).strip(),) for v in source], "key0 string"
        )
    allowed = allowed.filter(F.col("key0").isNotNull()).distinct()
    key = canonical_key(cell.value, cell.dtype)
    if cell.is_text and str(params.get("match_mode", "exact")).lower() != "exact":
        return _NotContaining(df, [key], F.lit(True), cell.present, allowed)
    return _Absent(df, [key], F.lit(True), cell.present, allowed)


SET_TEMPLATES = {
    "UNIQUE": _uniqueness, "COMPOSITE_UNIQUE": _uniqueness, "uniqueness": _uniqueness,
    "FUNCTIONAL_DEPENDENCY": _dependency, "REFERENCE_HIERARCHY": _hierarchy,
    "FOREIGN_KEY_EXISTS": _foreign_key, "REFERENCE_LOOKUP": _reference_lookup,
}


def set_rule(df: DataFrame, rule: Mapping[str, Any], ctx: Context) -> KeyedRule:
    template = template_of(rule)
    if template not in SET_TEMPLATES:
        raise RuleError(f"there is no rule template {template!r}")
    return SET_TEMPLATES[template](df, rule, ctx)
