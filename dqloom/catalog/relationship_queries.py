"""Key and foreign-key discovery with their SQL, over whole tables."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from dqloom.catalog.inputs import table
from dqloom.catalog.registry import register
from dqloom.functions import names
from dqloom.operators import relationships as rel

#: All columns of these tables, by type, as their Parquet schemas have them.
TABLES = {
    "region": {"r_regionkey": "int", "r_name": "text"},
    "nation": {"n_nationkey": "int", "n_name": "text", "n_regionkey": "int"},
    "customer": {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "real", "c_mktsegment": "text"},
    "supplier": {"s_suppkey": "int", "s_name": "text", "s_nationkey": "int", "s_acctbal": "real"},
    "part": {"p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int", "p_retailprice": "real"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "real", "o_orderdate": "time",
               "o_orderpriority": "text"},
    "lineitem": {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "real",
                 "l_extendedprice": "real", "l_discount": "real", "l_tax": "real", "l_returnflag": "text", "l_linestatus": "text",
                 "l_shipdate": "time"},
    "events": {"event_id": "int", "ts": "time", "user_id": "int", "event_type": "text", "value": "real", "props": "text"},
    "documents": {"doc_id": "int", "text": "text", "lang": "text", "source": "text", "n_chars": "int"},
    "labels": {"doc_id": "int", "quality": "int", "toxic": "int"},
}


def tables(spark, sf):
    return {t: table(spark, sf, t) for t in TABLES}


def _key(c: str, kind: str) -> str:
    if kind == "real":
        return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))" if kind == "text" else f"CAST({c} AS VARCHAR)"


def _tokens(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_COLUMNS = [(t, c, kind) for t, columns in TABLES.items() for c, kind in columns.items()]
_TALL = " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v, "
    f"{f'CAST({c} AS DOUBLE)' if kind in ('int', 'real') else 'NULL'} AS x, {_key(c, kind)} AS k FROM {t}"
    for t, c, kind in _COLUMNS)
_PROFILE = f"""WITH tall AS MATERIALIZED ({_TALL}),
    p AS (SELECT t AS table_name, c AS column_name, count(*) AS n, count(v) AS nn, count(DISTINCT v) AS d,
                 bool_and(x = floor(x)) AS whole, min(x) AS lo, max(x) AS hi,
                 list_filter(string_split_regex(lower(c), '[^a-z0-9]+'), lambda w: w <> '') AS words
          FROM tall GROUP BY 1, 2),
    g AS (SELECT t AS table_name, c AS column_name, bool_and((x - lo) % ((hi - lo) / (d - 1)) = 0) AS grid
          FROM tall JOIN p ON t = table_name AND c = column_name WHERE whole AND d > 1 GROUP BY 1, 2),
    s AS (SELECT p.*, coalesce(NOT whole, false) AS measure,
                 list_has_any(words, {_tokens(names.IDENTIFIER_STRONG_TOKENS)}) AS strong,
                 list_has_any(words, {_tokens(names.IDENTIFIER_STRONG_TOKENS + names.IDENTIFIER_WEAK_TOKENS)}) AS named,
                 coalesce(whole AND d = nn AND lo >= 0 AND grid AND ((hi - lo) / (d - 1)) % 1 = 0, false) AS counter
          FROM p LEFT JOIN g USING (table_name, column_name)),
    q AS MATERIALIZED (SELECT *, round(CASE WHEN strong AND d = nn THEN least(1.0, base + 0.1) ELSE base END, 4) AS pk_score FROM (
          SELECT *, (d * 1.0 / nn * 0.55 + (1 - (n - nn) * 1.0 / n) * 0.25 + named::INT * 0.20) * least(1.0, greatest(0.3, nn / 10.0)) AS base
          FROM s))"""


@register("pk_evidence", _PROFILE + " SELECT table_name, column_name, pk_score::DOUBLE AS pk_score FROM q")
def pk_evidence(spark, sf):
    return rel.pk_evidence(rel.key_profile(tables(spark, sf))).select(
        "table_name", "column_name", "pk_score"
    )


@register("pk_candidates", _PROFILE + """
    SELECT table_name, column_name, pk_score::DOUBLE AS pk_score, counter AS surrogate_counter
    FROM q WHERE pk_score >= 0.55 AND d * 100.0 / nn >= 95 AND NOT measure""")
def pk_candidates(spark, sf):
    return rel.pk_candidates(rel.key_profile(tables(spark, sf)))


_SEARCHED = {t: [c for c, kind in TABLES[t].items() if kind != "real" or c == "l_quantity"] for t in ("lineitem", "orders", "part", "labels")}


def _combinations() -> str:
    """Every pair and triple of the searched columns with its measures."""
    return " UNION ALL ".join(
        f"SELECT '{t}' AS t, {list(combo)} AS cols, count(*) AS distinct_rows, coalesce(sum(n), 0)::BIGINT AS evaluated FROM (SELECT count(*) AS n FROM {t} "
        f"WHERE {' AND '.join(f'{c} IS NOT NULL' for c in combo)} GROUP BY {', '.join(combo)})"
        for t, columns in _SEARCHED.items() for size in (2, 3) for combo in itertools.combinations(columns, size))


@register("key_candidates", f"""{_PROFILE},
    e AS (SELECT table_name AS t, column_name AS c, d, n FROM q WHERE NOT measure AND d >= 2 AND d * 1.0 / nn < 0.95),
    m AS MATERIALIZED ({_combinations()}),
    a AS (SELECT m.t, cols, any_value(m.distinct_rows) AS k, any_value(evaluated) AS ev, product(e.d) AS cells, count(*) AS parts, any_value(e.n) AS n
          FROM (SELECT *, unnest(cols) AS c FROM m) m JOIN e ON e.t = m.t AND e.c = m.c GROUP BY m.t, cols),
    u AS (SELECT *, k * 100.0 / ev AS share FROM a WHERE parts = len(cols) AND cells >= 0.5 * n AND ev >= 0.5 * n AND k * 100.0 / ev >= 95),
    b AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u s WHERE s.t = u.t AND len(s.cols) < len(u.cols) AND list_has_all(u.cols, s.cols)))
    SELECT 'pk' AS kind, table_name, column_name AS key_columns, pk_score::DOUBLE AS score
    FROM q WHERE pk_score >= 0.55 AND d * 100.0 / nn >= 95 AND NOT measure AND table_name IN ({", ".join(f"'{t}'" for t in _SEARCHED)})
    UNION ALL SELECT 'composite_pk', t, array_to_string(cols, '+'), round(share / 100, 4)::DOUBLE FROM b WHERE share >= 98""")
def key_candidates(spark, sf):
    """Single and composite keys of four tables; names and brands of parts are no free text."""
    found = rel.key_candidates({t: table(spark, sf, t) for t in _SEARCHED})
    return found.withColumn("key_columns", F.array_join("key_columns", "+"))


_SHARED = """
    k AS MATERIALIZED (SELECT DISTINCT t, c, k AS v FROM tall WHERE k IS NOT NULL),
    z AS MATERIALIZED (SELECT t, c, count(*) AS d, coalesce(bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL)
          AND min(TRY_CAST(v AS DOUBLE)) >= 0 AND max(TRY_CAST(v AS DOUBLE)) <= 100000
          AND count(*) / (max(TRY_CAST(v AS DOUBLE)) - min(TRY_CAST(v AS DOUBLE)) + 1) >= 0.95, false) AS dense FROM k GROUP BY 1, 2),
    x AS MATERIALIZED (SELECT a.t AS ct, a.c AS cc, b.t AS pt, b.c AS pc, count(*) AS n
          FROM k a JOIN k b ON a.v = b.v AND a.t <> b.t GROUP BY 1, 2, 3, 4)"""


@register("fk_containment", f"""WITH tall AS MATERIALIZED ({_TALL}), {_SHARED}
    SELECT pt AS parent_table, pc AS parent_column, ct AS child_table, cc AS child_column,
           zc.d AS child_distinct, zp.d AS parent_distinct, n AS contained_distinct,
           round(n * 1.0 / zc.d, 4) AS containment,
           round(n * 1.0 / least(zc.d, zp.d), 4) AS overlap,
           zc.d - n AS orphan_distinct_count,
           round((zc.d - n) * 1.0 / zc.d, 4) AS orphan_distinct_rate
    FROM x JOIN z zc ON zc.t = ct AND zc.c = cc JOIN z zp ON zp.t = pt AND zp.c = pc""")
def fk_containment(spark, sf):
    return rel.containment(rel.key_values(tables(spark, sf)))


#: Every column beside every likely key of another table, with the names' similarity.
_PAIRS = """
    m AS (SELECT c.table_name AS ct, c.column_name AS cc, c.named AS cn, (c.n - c.nn) * 100.0 / c.n AS cnull,
                 p.table_name AS pt, p.column_name AS pc, p.named AS pn, p.pk_score AS pk, list_has_any(c.words, p.words) AS met,
                 CASE WHEN list_has_any(c.words, p.words) THEN 0.6 * 2 * len(list_intersect(c.words, p.words))
                      / (len(list_distinct(c.words)) + len(list_distinct(p.words))) ELSE 0 END
                 + 0.4 * (1 - levenshtein(array_to_string(c.words, ' '), array_to_string(p.words, ' '))
                      / greatest(len(array_to_string(c.words, ' ')), len(array_to_string(p.words, ' ')))) AS similarity
          FROM q c JOIN q p ON c.table_name <> p.table_name AND p.pk_score >= 0.55),
    f AS MATERIALIZED (SELECT *, round(similarity, 4)::DOUBLE AS ns FROM m WHERE round(similarity, 4) >= 0.4 OR pk >= 0.75)"""


@register("name_similarity", f"""{_PROFILE}, {_PAIRS}
    SELECT ct AS child_table, cc AS child_column, pt AS parent_table, pc AS parent_column, ns AS name_similarity FROM f WHERE met""")
def name_similarity(spark, sf):
    """Columns and likely keys whose names share a word."""
    pairs = rel.column_pairs(rel.key_profile(tables(spark, sf)))
    return pairs.select(
        "child_table", "child_column", "parent_table", "parent_column", "name_similarity"
    )


_CANDIDATES = f"""{_PROFILE}, {_SHARED}, {_PAIRS},
    e AS (SELECT f.*, coalesce(x.n, 0) AS n, coalesce(zc.d, 0) AS cd, coalesce(zp.d, 0) AS pd,
                 CASE WHEN zc.dense AND zp.dense THEN 0.5 ELSE 1.0 END AS damp
          FROM f LEFT JOIN x USING (ct, cc, pt, pc) LEFT JOIN z zc ON zc.t = ct AND zc.c = cc LEFT JOIN z zp ON zp.t = pt AND zp.c = pc),
    v AS (SELECT *, CASE WHEN cd > 0 THEN n::DOUBLE / cd ELSE 0 END AS contained,
                 CASE WHEN least(cd, pd) > 0 THEN n::DOUBLE / least(cd, pd) ELSE 0 END AS overlap,
                 CASE WHEN cd > 0 AND pd > 0 THEN CASE WHEN cd <= pd THEN 1.0 ELSE greatest(0.0, 1 - (cd::DOUBLE / pd - 1)) END END AS fit FROM e),
    w AS (SELECT *, round(contained * damp, 4) AS vc, round(overlap * damp, 4) AS vo,
                 round((ns * 0.10 + 0.05 + pk * 0.15 + round(contained * damp, 4) * 0.20 + round(overlap * damp, 4) * 0.10
                  + coalesce(round(fit, 4) * 0.10, 0) + round(1 - cnull / 100, 4) * 0.05 + (cn::INT + pn::INT) / 2 * 0.05)
                 / CASE WHEN fit IS NULL THEN 0.70 ELSE 0.80 END, 4)::DOUBLE AS score FROM v),
    r AS (SELECT *, row_number() OVER (PARTITION BY ct, cc ORDER BY score DESC, pt, pc) AS position
          FROM w WHERE score >= 0.35 AND NOT (vc = 0 AND vo = 0 AND ns < 0.6)),
    best AS (SELECT ct AS child_table, cc AS child_column, position::INTEGER AS position, pt AS parent_table, pc AS parent_column, score,
                    round(contained, 4)::DOUBLE AS containment, cd - n AS orphan_distinct_count FROM r WHERE position <= 3)"""


@register("fk_candidates", _CANDIDATES + " SELECT * FROM best")
def fk_candidates(spark, sf):
    return rel.discover(tables(spark, sf)).select(
        "child_table", "child_column", "position", "parent_table", "parent_column", "score",
        "containment", "orphan_distinct_count",
    )


@register("candidate_merge", _CANDIDATES + """
    SELECT 'relationship' AS kind, parent_table, parent_column, child_table, child_column, score,
           CASE WHEN position > 1 THEN 'pending' WHEN containment < 0.5 THEN 'rejected' ELSE 'approved' END AS status FROM best""")
def candidate_merge(spark, sf):
    from dqloom.plans.profile import small

    fresh = small(fk_candidates(spark, sf)).withColumn("kind", F.lit("relationship"))
    decided = fresh.filter(F.col("position") == 1).select(
        "kind", "parent_table", "parent_column", "child_table", "child_column", "score",
        F.when(F.col("containment") < 0.5, "rejected").otherwise("approved").alias("status"),
    )
    return rel.merge_decisions(fresh, decided)
