"""Rules, scores, root causes, remediation and drift with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from dqloom.catalog.inputs import DIRTY, dirty, dirty_sql, table, tall_sql
from dqloom.catalog.registry import register
from dqloom.functions.missing import WHITESPACE
from dqloom.functions.text import EMAIL
from dqloom.operators import drift, rca, remediation, scoring
from dqloom.operators.rules import Context
from dqloom.plans.quality import failing_rows, rule_counts, rule_examples, rule_frame, run_rules

AS_OF = datetime.datetime(2000, 1, 1)
WS = "'" + WHITESPACE + "'"


def _strip(c: str) -> str:
    return f"trim({c}, {WS})"


def _present(c: str) -> str:
    return f"({c} IS NOT NULL AND {_strip(c)} <> '')"


def context(spark, sf) -> Context:
    tables = {n: dirty(spark, sf, n) for n in ("customer", "orders", "lineitem", "part")}
    tables |= {n: table(spark, sf, n) for n in ("nation", "events")}
    return Context(as_of=AS_OF, tables=tables)


def _counts_sql(source: str, applicable: str, failed: str) -> str:
    """Result columns of one rule from its two predicates."""
    return f"""SELECT n AS total_rows, a AS applicable_rows, f AS failed_rows, a - f AS passed_rows,
        n - a AS not_applicable_rows,
        CASE WHEN a > 0 THEN round((a - f) * 100.0 / a, 4) END AS pass_rate,
        CASE WHEN a > 0 THEN round(f * 100.0 / a, 4) END AS violation_rate
        FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {applicable}) AS a,
                     count(*) FILTER (WHERE {failed}) AS f FROM {source})"""


_NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def _bad_number(c: str) -> str:
    return f"{_present(c)} AND NOT regexp_matches({_strip(c)}, {_NUMBER})"


def _day(c: str) -> str:
    return f"TRY_CAST({_strip(c)} AS TIMESTAMP)"


HIERARCHY = [
    {"parent": "ECONOMY", "child": "group economy"}, {"parent": "SMALL", "child": "group small"},
    {"parent": "large", "child": "Group Large"}, {"parent": "PROMO", "child": "group promo"},
    {"parent": "STANDARD", "child": "group standard"}, {"parent": "MEDIUM", "child": "group medium"},
]
_PAIRS = ", ".join(f"('{h['parent'].lower()}', '{h['child'].lower()}')" for h in HIERARCHY)
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_SEGMENTS = ", ".join(f"'{s.lower()}'" for s in SEGMENTS)

# name -> (rule, table, applicable SQL, failed SQL)
RULES = {
    "rule_not_null": (
        {"rule_template": "NOT_NULL", "column": "c_name", "metric": "completeness"},
        "customer", "true", "c_name IS NULL"),
    "rule_not_empty": (
        {"rule_template": "NOT_EMPTY", "column": "c_name", "metric": "completeness"},
        "customer", "true", "c_name = ''"),
    "rule_not_whitespace": (
        {"rule_template": "NOT_WHITESPACE", "column": "c_name", "metric": "completeness"},
        "customer", "true", f"c_name <> '' AND {_strip('c_name')} = ''"),
    "rule_completeness": (
        {"type": "completeness", "column": "c_name", "metric": "completeness",
         "treat_empty_string_as_null": True, "treat_whitespace_as_null": True},
        "customer", "true", f"c_name IS NULL OR {_strip('c_name')} = ''"),
    "rule_regex": (
        {"rule_template": "REGEX", "column": "c_email", "metric": "validity",
         "parameters": {"pattern_name": "email_syntax"}},
        "customer", "true",
        f"{_present('c_email')} AND NOT regexp_matches({_strip('c_email')}, '{EMAIL}')"),
    "rule_regex_prefix": (
        {"rule_template": "REGEX", "column": "c_phone", "metric": "validity",
         "parameters": {"pattern": r"\+1 \(555\) [1-4]"}},
        "customer", "true",
        f"{_present('c_phone')} AND NOT regexp_matches({_strip('c_phone')}, "
        r"'^\+1 \(555\) [1-4]')"),
    "rule_numeric_type": (
        {"rule_template": "NUMERIC_TYPE", "column": "c_rating", "metric": "validity"},
        "customer", "true", _bad_number("c_rating")),
    "rule_numeric_range": (
        {"rule_template": "NUMERIC_RANGE", "column": "c_rating", "metric": "validity",
         "parameters": {"min": 3, "max": 40}},
        "customer", "true",
        f"{_present('c_rating')} AND coalesce(TRY_CAST({_strip('c_rating')} AS DOUBLE) "
        "NOT BETWEEN 3 AND 40, true)"),
    "rule_allowed_values": (
        {"rule_template": "ALLOWED_VALUES", "column": "c_mktsegment", "metric": "validity",
         "parameters": {"allowed_values": SEGMENTS}},
        "customer", "true",
        f"{_present('c_mktsegment')} AND lower({_strip('c_mktsegment')}) NOT IN ({_SEGMENTS})"),
    "rule_date_format": (
        {"rule_template": "DATE_FORMAT", "column": "c_since", "metric": "validity",
         "parameters": {"date_format": "%Y-%m-%d"}},
        "customer", "true", f"{_present('c_since')} AND {_day('c_since')} IS NULL"),
    "rule_date_any": (
        {"rule_template": "DATE_FORMAT", "column": "c_renewal", "metric": "validity"},
        "customer", "true",
        f"{_present('c_renewal')} AND try_strptime(c_renewal, '%d/%m/%Y') IS NULL"),
    "rule_datatype": (
        {"rule_template": "DATATYPE_COMPATIBILITY", "column": "o_urgent", "metric": "validity",
         "parameters": {"expected_datatype": "boolean"}},
        "orders", "true",
        f"{_present('o_urgent')} AND lower({_strip('o_urgent')}) NOT IN "
        "('true', 'false', '0', '1', 'yes', 'no')"),
    "rule_validity": (
        {"type": "validity", "check": "numeric_type", "column": "c_rating", "metric": "validity"},
        "customer", "true", _bad_number("c_rating")),
    "rule_column_comparison": (
        {"rule_template": "COLUMN_COMPARISON", "metric": "consistency",
         "parameters": {"left_column": "l_amount", "operator": ">", "right_column": "l_quantity"}},
        "lineitem", "l_amount IS NOT NULL AND l_quantity IS NOT NULL", "l_amount <= l_quantity"),
    "rule_date_order": (
        {"rule_template": "DATE_ORDER", "metric": "consistency",
         "parameters": {"left_column": "o_orderdate", "right_column": "o_shipdate"}},
        "orders", "o_orderdate IS NOT NULL AND o_shipdate IS NOT NULL",
        "o_orderdate >= o_shipdate"),
    "rule_arithmetic": (
        {"rule_template": "ARITHMETIC_RELATION", "metric": "consistency",
         "parameters": {"left_column": "l_quantity", "operator": "*", "right_column": "l_price",
                        "expected_column": "l_amount", "tolerance": 5}},
        "lineitem",
        "l_quantity IS NOT NULL AND l_price IS NOT NULL AND l_amount IS NOT NULL",
        "abs(l_quantity * l_price - l_amount) > abs(l_amount) * 0.05"),
    "rule_freshness": (
        {"rule_template": "FRESHNESS_THRESHOLD", "column": "o_shipdate", "metric": "timeliness",
         "parameters": {"max_age": {"amount": 52, "unit": "weeks"}}},
        "orders", "true", "o_shipdate < TIMESTAMP '2000-01-01' - INTERVAL 364 DAY"),
    "rule_deadline": (
        {"rule_template": "DEADLINE", "column": "o_orderdate", "metric": "timeliness",
         "parameters": {"deadline": "1996-06-01T00:00:00"}},
        "orders", "true", "o_orderdate < TIMESTAMP '1996-06-01'"),
}

for _name, (_rule, _table, _applicable, _failed) in RULES.items():
    def _run(spark, sf, rule=_rule, name=_table):
        ctx = context(spark, sf)
        return rule_counts(ctx.tables[name], rule, ctx)

    register(_name, f"WITH {dirty_sql(_table)} "
             + _counts_sql(f"dirty_{_table}", _applicable, _failed))(_run)

# name -> (rule, table, extra WITH items, source with `applicable` and `failed` columns)
_NAME_KEY = f"lower({_strip('c_name')})"
SET_RULES = {
    "rule_unique": (
        {"rule_template": "UNIQUE", "column": "c_name", "metric": "uniqueness"}, "customer",
        f"""SELECT coalesce({_present('c_name')}, false) AS applicable,
            coalesce({_present('c_name')}, false) AND count(*) OVER (PARTITION BY {_NAME_KEY}) > 1
            AS failed FROM dirty_customer"""),
    "rule_composite_unique": (
        {"rule_template": "COMPOSITE_UNIQUE", "columns": ["o_custkey", "o_orderstatus"],
         "metric": "uniqueness"}, "orders",
        f"""SELECT o_custkey IS NOT NULL AND coalesce({_present('o_orderstatus')}, false) AS applicable,
            o_custkey IS NOT NULL AND coalesce({_present('o_orderstatus')}, false) AND
            count(*) OVER (PARTITION BY o_custkey, lower({_strip('o_orderstatus')})) > 1 AS failed
            FROM dirty_orders"""),
    "rule_fd": (
        {"rule_template": "FUNCTIONAL_DEPENDENCY", "metric": "consistency",
         "parameters": {"determinant_column": "p_group", "dependent_column": "p_type"}}, "part",
        """SELECT true AS applicable, p_group IN (SELECT p_group FROM dirty_part
            WHERE p_type IS NOT NULL GROUP BY 1 HAVING count(DISTINCT p_type) > 1) AS failed
            FROM dirty_part"""),
    "rule_hierarchy": (
        {"rule_template": "REFERENCE_HIERARCHY", "metric": "consistency",
         "parameters": {"parent_column": "p_type", "child_column": "p_group",
                        "hierarchy": HIERARCHY}}, "part",
        f"""SELECT p_type IS NOT NULL AND p_group IS NOT NULL AS applicable,
            p_type IS NOT NULL AND p_group IS NOT NULL AND
            (lower({_strip('p_type')}), lower({_strip('p_group')})) NOT IN ({_PAIRS}) AS failed
            FROM dirty_part"""),
    "rule_foreign_key": (
        {"rule_template": "FOREIGN_KEY_EXISTS", "metric": "referential_integrity",
         "parameters": {"child_column": "o_custkey", "parent_table": "customer",
                        "parent_column": "c_custkey"}}, "orders",
        """SELECT true AS applicable, o_custkey IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM customer WHERE c_custkey = o_custkey) AS failed FROM dirty_orders"""),
    "rule_reference_lookup": (
        {"rule_template": "REFERENCE_LOOKUP", "column": "c_mktsegment", "metric": "accuracy",
         "parameters": {"reference_values": SEGMENTS, "match_mode": "exact"}}, "customer",
        f"""SELECT true AS applicable, coalesce({_present('c_mktsegment')}, false) AND
            {_strip('c_mktsegment')} NOT IN ({", ".join(f"'{s}'" for s in SEGMENTS)}) AS failed
            FROM dirty_customer"""),
}

for _name, (_rule, _table, _source) in SET_RULES.items():
    def _run_set(spark, sf, rule=_rule, name=_table):
        ctx = context(spark, sf)
        return rule_counts(ctx.tables[name], rule, ctx)

    register(_name, f"WITH {dirty_sql(_table)}, src AS ({_source}) "
             + _counts_sql("src", "applicable", "failed"))(_run_set)


@register("rule_reference_contains", "WITH src AS (SELECT true AS applicable, "
          f"{_present('text')} AND NOT EXISTS (SELECT 1 FROM benchmark b "
          f"WHERE contains({_strip('d.text')}, {_strip('b.text')})) AS failed FROM documents d) "
          + _counts_sql("src", "applicable", "failed"))
def rule_reference_contains(spark, sf):
    """Documents that quote none of the benchmark passages in full."""
    references = {"passages": table(spark, sf, "benchmark").select("text")}
    rule = {"rule_template": "REFERENCE_LOOKUP", "column": "text",
            "parameters": {"reference": "passages", "match_mode": "contains"}}
    ctx = Context(as_of=AS_OF, references=references)
    return rule_counts(table(spark, sf, "documents"), rule, ctx)


@register("rule_failures", f"WITH {dirty_sql('customer')} SELECT c_custkey, c_email "
          f"FROM dirty_customer WHERE {RULES['rule_regex'][3]}")
def rule_failures(spark, sf):
    ctx = context(spark, sf)
    return failing_rows(ctx.tables["customer"], RULES["rule_regex"][0], ctx).select(
        "c_custkey", "c_email"
    )


@register("rule_set_failures", f"WITH {dirty_sql('orders')} SELECT o_orderkey, o_custkey "
          "FROM dirty_orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def rule_set_failures(spark, sf):
    ctx = context(spark, sf)
    return failing_rows(ctx.tables["orders"], SET_RULES["rule_foreign_key"][0], ctx).select(
        "o_orderkey", "o_custkey"
    )


# --- suites and scores ----------------------------------------------------

def suite() -> list[dict]:
    """All rules above as one approved suite, plus one that cannot run."""
    rules = []
    for name, entry in {**RULES, **SET_RULES}.items():
        rules.append({**entry[0], "rule_id": name, "table": entry[1], "status": "approved"})
    rules.append({"rule_id": "rule_broken", "table": "customer", "metric": "validity",
                  "rule_template": "NOT_NULL", "column": "no_such_column", "status": "approved"})
    rules.append({"rule_id": "rule_draft", "table": "customer", "metric": "validity",
                  "rule_template": "NOT_NULL", "column": "c_name", "status": "recommended"})
    return rules


_COLUMN_OF = {
    "rule_column_comparison": "l_amount", "rule_date_order": "o_orderdate",
    "rule_arithmetic": "l_quantity", "rule_composite_unique": "o_custkey",
    "rule_fd": "p_group", "rule_hierarchy": "p_group", "rule_foreign_key": "o_custkey",
}


def _suite_sql() -> str:
    """`results`: one row per approved rule, as a WITH item list."""
    parts = []
    for name, (rule, t, applicable, failed) in RULES.items():
        parts.append((name, t, rule, f"dirty_{t}", applicable, failed))
    items = [dirty_sql("customer", "orders", "lineitem", "part")]
    for name, (rule, t, source) in SET_RULES.items():
        items.append(f"src_{name} AS ({source})")
        parts.append((name, t, rule, f"src_{name}", "applicable", "failed"))
    rows = []
    for name, t, rule, source, applicable, failed in parts:
        column = rule.get("column") or _COLUMN_OF[name]
        template = rule.get("rule_template") or rule.get("type")
        rows.append(
            f"SELECT '{name}' AS rule_id, '{t}' AS table_name, '{column}' AS column_name, "
            f"'{rule['metric']}' AS metric, '{template}' AS template, 'passed' AS status, r.* "
            f"FROM ({_counts_sql(source, applicable, failed)}) r"
        )
    rows.append(
        "SELECT 'rule_broken', 'customer', 'no_such_column', 'validity', 'NOT_NULL', 'error', "
        "NULL, NULL, NULL, NULL, NULL, NULL, NULL"
    )
    return f"WITH {', '.join(items)}, results AS ({' UNION ALL '.join(rows)})"


_SUITE = _suite_sql()


def _results(spark, sf):
    return run_rules(spark, suite(), context(spark, sf))


@register("rule_suite", _SUITE + " SELECT * FROM results")
def rule_suite(spark, sf):
    return _results(spark, sf).drop("error_message")


_METRICS = """, m AS (SELECT metric,
        CAST(coalesce(sum(applicable_rows) FILTER (WHERE status <> 'error'), 0) AS BIGINT)
            AS applicable_records,
        CAST(coalesce(sum(failed_rows) FILTER (WHERE status <> 'error'), 0) AS BIGINT)
            AS failed_records,
        count(*) AS rule_count, count(*) FILTER (WHERE status = 'error') AS error_count
        FROM results GROUP BY metric),
    metrics AS (SELECT *, CASE WHEN rule_count = error_count THEN 'execution_error'
        WHEN applicable_records = 0 THEN 'not_applicable' ELSE 'available' END AS status,
        CASE WHEN applicable_records > 0
        THEN round((applicable_records - failed_records) * 100.0 / applicable_records, 2)
        ELSE 0.0 END AS score FROM m)"""


@register("metric_scores", _SUITE + _METRICS + " SELECT * FROM metrics")
def metric_scores(spark, sf):
    return scoring.metric_scores(_results(spark, sf))


WEIGHTS = {"completeness": 2.0, "referential_integrity": 3.0}


@register("dq_score", _SUITE + _METRICS + """
    , w AS (SELECT *, CASE metric WHEN 'completeness' THEN 2.0 WHEN 'referential_integrity' THEN 3.0
                      ELSE 1.0 END AS w FROM metrics)
    SELECT round(sum(score * w) FILTER (WHERE status = 'available')
                 / sum(w) FILTER (WHERE status = 'available'), 2) AS overall_score,
           count(*) FILTER (WHERE status = 'available') AS metric_count,
           count(*) FILTER (WHERE status = 'not_applicable') AS excluded_metrics,
           CAST(sum(error_count) AS BIGINT) AS execution_errors,
           count(*) FILTER (WHERE status = 'available' AND score < 90) AS critical_failures FROM w""")
def dq_score(spark, sf):
    return scoring.dq_score(scoring.metric_scores(_results(spark, sf)), True, WEIGHTS)


_BREAKDOWN = """, c AS (SELECT table_name, column_name, metric,
        coalesce(sum(applicable_rows) FILTER (WHERE status <> 'error'), 0) AS applicable,
        coalesce(sum(failed_rows) FILTER (WHERE status <> 'error'), 0) AS failed,
        bool_or(status = 'error') AS err FROM results GROUP BY 1, 2, 3),
    l AS (SELECT 'column' AS level, table_name, column_name, metric, applicable, failed,
                 err AND applicable = 0 AS err FROM c
          UNION ALL SELECT 'table', table_name, '', metric, sum(applicable), sum(failed),
                 bool_or(err AND applicable = 0) FROM c GROUP BY 2, 4
          UNION ALL SELECT 'dataset', '', '', metric, sum(applicable), sum(failed),
                 bool_or(err AND applicable = 0) FROM c GROUP BY 4),
    g AS (SELECT DISTINCT p.level, p.table_name, p.column_name, x.metric FROM l p,
          (VALUES ('completeness'), ('uniqueness'), ('validity'), ('accuracy'), ('consistency'),
                  ('referential_integrity'), ('timeliness')) x(metric)),
    b AS (SELECT g.*, coalesce(applicable, 0) AS a, failed AS f, coalesce(err, false) AS err
          FROM g LEFT JOIN l USING (level, table_name, column_name, metric)),
    breakdown AS (SELECT level, table_name, column_name, metric,
        CASE WHEN a > 0 THEN 'ok' WHEN err THEN 'EXECUTION_ERROR' ELSE 'N/A' END AS status,
        CASE WHEN a > 0 THEN round((a - f) * 100.0 / a, 2) END AS score,
        CAST(CASE WHEN a > 0 THEN a END AS BIGINT) AS applicable,
        CAST(CASE WHEN a > 0 THEN f END AS BIGINT) AS failed FROM b)"""


def _breakdown(spark, sf):
    rules = rule_frame(spark, [r for r in suite() if r["status"] == "approved"])
    return scoring.score_breakdown(rules, _results(spark, sf))


@register("score_breakdown", _SUITE + _BREAKDOWN + " SELECT * FROM breakdown")
def score_breakdown(spark, sf):
    return _breakdown(spark, sf)


@register("level_scores", _SUITE + _BREAKDOWN + """
    SELECT level, table_name, column_name, round(avg(score), 2) AS level_score,
           count(score) AS evaluated_metrics,
           CAST(coalesce(sum(applicable), 0) AS BIGINT) AS applicable_total,
           CAST(coalesce(sum(failed), 0) AS BIGINT) AS failed_total
    FROM breakdown GROUP BY 1, 2, 3""")
def level_scores(spark, sf):
    return scoring.level_scores(_breakdown(spark, sf))


@register("latest_execution", """
    SELECT rule_id, execution_id, status FROM (
        SELECT event_type AS rule_id, event_id AS execution_id, props AS status,
               row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events)
    WHERE r = 1""")
def latest_execution(spark, sf):
    """Events as an execution log: the type is the rule, the id the run."""
    log = table(spark, sf, "events").select(
        F.col("event_type").alias("rule_id"), F.col("event_id").alias("execution_id"),
        F.col("props").alias("status"),
    )
    return scoring.latest_executions(log)


# --- root causes ----------------------------------------------------------

_RANGE = {"rule_template": "NUMERIC_RANGE", "column": "o_totalprice", "rule_id": "price_range",
          "table": "orders", "parameters": {"min": 20000, "max": 400000}}
_EMAIL_RULE = {**RULES["rule_regex"][0], "rule_id": "email", "table": "customer"}
_NAME_RULE = {"rule_template": "REGEX", "column": "c_name", "rule_id": "name", "table": "customer",
              "parameters": {"pattern": r"Customer#\d+[02468]$"}}
_NAME_FAILS = (f"{_present('c_name')} AND NOT regexp_matches({_strip('c_name')}, "
               r"'^Customer#\d+[02468]$')")


@register("rca_concentration", f"""WITH {dirty_sql('orders')},
    f AS (SELECT * FROM dirty_orders WHERE o_totalprice < 20000 OR o_totalprice > 400000),
    t AS ({tall_sql('f', ['o_orderstatus', 'o_orderpriority', 'o_urgent'])}),
    c AS (SELECT column_name, {_strip('value')} AS value, count(*) AS count FROM t GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS position,
                 count(*) OVER (PARTITION BY column_name) AS k FROM c)
    SELECT column_name, CAST(position AS INT) AS position, value, count,
           round(count * 100.0 / (SELECT count(*) FROM f), 1) AS percentage
    FROM r WHERE k > 1 AND position <= 5""")
def rca_concentration(spark, sf):
    ctx = context(spark, sf)
    orders = ctx.tables["orders"]
    columns = rca.low_cardinality_columns(orders, ["o_totalprice"])
    return rca.concentration(failing_rows(orders, _RANGE, ctx), columns)


@register("rule_examples", f"""WITH {dirty_sql('orders')}, {dirty_sql('customer')},
    f AS (SELECT 'price_range' AS rule_id, o_orderkey AS key, o_totalprice < 20000 AS low
          FROM dirty_orders WHERE o_totalprice < 20000 OR o_totalprice > 400000
          UNION ALL SELECT 'name', c_custkey, NULL FROM dirty_customer WHERE {_NAME_FAILS}),
    r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY key) AS place FROM f)
    SELECT rule_id, CAST(place AS INT) AS place, CAST(key AS VARCHAR) AS key FROM r WHERE place <= 20""")
def examples_of_rules(spark, sf):
    shown = rule_examples([_RANGE, _NAME_RULE], context(spark, sf), {"orders": "o_orderkey", "customer": "c_custkey"})
    key = F.coalesce(F.col("example")["o_orderkey"], F.col("example")["c_custkey"])
    return shown.select("rule_id", "place", key.alias("key"))


@register("rca_patterns", f"""WITH {dirty_sql('customer')},
    f AS (SELECT c_name AS v FROM dirty_customer WHERE {_NAME_FAILS})
    SELECT 'c_name' AS column_name, CASE WHEN v = '' THEN 'empty_string'
           WHEN v <> {_strip('v')} THEN 'leading_or_trailing_whitespace' ELSE 'other' END AS value,
           count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM f), 1) AS percentage
    FROM f WHERE v IS NOT NULL GROUP BY 2""")
def rca_patterns(spark, sf):
    ctx = context(spark, sf)
    return rca.whitespace_patterns(
        failing_rows(ctx.tables["customer"], _NAME_RULE, ctx), ["c_name"]
    )


@register("rca_repeated", f"""WITH {dirty_sql('orders')},
    f AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, lower({_strip('o_orderstatus')}))
          AS k FROM dirty_orders WHERE o_custkey IS NOT NULL AND {_present('o_orderstatus')}) WHERE k > 1),
    t AS (SELECT 0 AS ci, 'o_custkey' AS column_name, CAST(o_custkey AS VARCHAR) AS value FROM f
          UNION ALL SELECT 1, 'o_orderstatus', {_strip('o_orderstatus')} FROM f),
    c AS (SELECT ci, column_name, value, count(*) AS count FROM t GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY ci ORDER BY count DESC, value) AS r FROM c)
    SELECT column_name, value, count,
           round(count * 100.0 / (SELECT count(*) FROM f), 1) AS percentage
    FROM r WHERE r <= 3 AND count >= 2 ORDER BY count DESC, ci, r LIMIT 5""")
def rca_repeated(spark, sf):
    ctx = context(spark, sf)
    failing = failing_rows(ctx.tables["orders"], SET_RULES["rule_composite_unique"][0], ctx)
    return rca.repeated_values(failing, ["o_custkey", "o_orderstatus"])


@register("rca_all")
def rca_all(spark, sf):
    ctx = context(spark, sf)
    lookup = {**SET_RULES["rule_foreign_key"][0], "rule_id": "customer_fk", "table": "orders"}
    return rca.analyze_failures([_RANGE, _EMAIL_RULE, _NAME_RULE, lookup], ctx)


# --- remediation ----------------------------------------------------------

_TEXTS = ["c_name", "c_email", "c_phone", "c_mktsegment", "c_rating", "c_since", "c_renewal"]


@register("remediation_proposal", f"WITH {dirty_sql('customer')}, p AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} <> {_strip(c)}) AS affected_rows, "
    f"'whitespace_normalization' AS remediation_type FROM dirty_customer" for c in _TEXTS
) + ") SELECT * FROM p WHERE affected_rows > 0")
def remediation_proposal(spark, sf):
    return remediation.remediation_proposal(dirty(spark, sf, "customer"))


_CHANGED = [f"coalesce({c} <> {_strip(c)}, false)" for c in _TEXTS]


@register("remediation_rows", f"""WITH {dirty_sql('customer')}
    SELECT CAST(sum({" + ".join(f"CAST({c} AS INT)" for c in _CHANGED)}) AS BIGINT) AS total_corrections,
           count(*) FILTER (WHERE {" OR ".join(_CHANGED)}) AS affected_rows FROM dirty_customer""")
def remediation_rows(spark, sf):
    return remediation.affected_rows(dirty(spark, sf, "customer"))


@register("remediation_apply", f"WITH {dirty_sql('customer')} SELECT c_custkey, c_nationkey, c_acctbal, "
          + ", ".join(f"{_strip(c)} AS {c}" for c in _TEXTS) + " FROM dirty_customer")
def remediation_apply(spark, sf):
    return remediation.apply_trimming(dirty(spark, sf, "customer"))


_REASSESS = [
    {"rule_id": "a", "table": "customer", "metric": "completeness", "rule_template": "NOT_WHITESPACE",
     "column": "c_name"},
    {"rule_id": "b", "table": "customer", "metric": "validity", "rule_template": "ALLOWED_VALUES",
     "column": "c_mktsegment",
     "parameters": {"allowed_values": [*SEGMENTS, "unknown"], "case_sensitive": True}},
]


def _reassess_side(source: str, alias: str) -> str:
    allowed = ", ".join(f"'{s}'" for s in [*SEGMENTS, "unknown"])
    return f"""SELECT 'completeness' AS metric, round(100.0 - count(*) FILTER (WHERE c_name <> '' AND
        {_strip('c_name')} = '') * 100.0 / count(*), 2) AS {alias} FROM {source} UNION ALL
        SELECT 'validity', round(100.0 - count(*) FILTER (WHERE {_present('c_mktsegment')} AND
        c_mktsegment NOT IN ({allowed})) * 100.0 / count(*), 2) FROM {source}"""


@register("reassessment", f"""WITH {dirty_sql('customer')},
    fixed AS (SELECT {_strip('c_name')} AS c_name, {_strip('c_mktsegment')} AS c_mktsegment
              FROM dirty_customer),
    b AS ({_reassess_side('dirty_customer', 'before_score')}),
    a AS ({_reassess_side('fixed', 'after_score')})
    SELECT metric, before_score, after_score, round(after_score - before_score, 2) AS delta
    FROM b JOIN a USING (metric)""")
def reassessment(spark, sf):
    before = dirty(spark, sf, "customer")
    after = remediation.apply_trimming(before)
    scores = [
        scoring.metric_scores(run_rules(spark, _REASSESS, Context(tables={"customer": t})))
        for t in (before, after)
    ]
    return remediation.reassessment(*scores)


# --- drift ----------------------------------------------------------------

_SPLIT = "1998-01-01"


def _versions(spark, sf):
    """Orders before and after a date, the later ones with shifted prices."""
    o = table(spark, sf, "orders")
    early = F.col("o_orderdate") < F.lit(_SPLIT).cast("timestamp")
    later = o.filter(~early).withColumn(
        "o_totalprice", F.col("o_totalprice") * 1.5
    ).withColumn(
        "o_orderpriority",
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("0-NOW")).otherwise(F.col("o_orderpriority")),
    )
    return o.filter(early).drop("o_orderdate"), later.drop("o_orderdate")


_KS_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice"]
_PSI_COLUMNS = ["o_orderstatus", "o_orderpriority"]
_VERSIONS = f"""base AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{_SPLIT}'),
    comp AS (SELECT o_orderkey, o_custkey, o_totalprice * 1.5 AS o_totalprice, o_orderstatus,
             CASE WHEN o_orderkey % 3 = 0 THEN '0-NOW' ELSE o_orderpriority END AS o_orderpriority
             FROM orders WHERE o_orderdate >= TIMESTAMP '{_SPLIT}')"""


def _both(columns: list[str], cast: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS {cast}) AS v, {b} AS b, {k} AS c FROM {s} "
        f"WHERE {c} IS NOT NULL"
        for c in columns for s, b, k in (("base", 1, 0), ("comp", 0, 1))
    )


_KS = f"""WITH {_VERSIONS}, t AS ({_both(_KS_COLUMNS, 'DOUBLE')}),
    g AS (SELECT column_name, v, sum(b) AS b, sum(c) AS c FROM t GROUP BY 1, 2),
    w AS (SELECT column_name, sum(b) OVER x AS bu, sum(c) OVER x AS cu,
                 sum(b) OVER y AS bt, sum(c) OVER y AS ct FROM g
          WINDOW x AS (PARTITION BY column_name ORDER BY v), y AS (PARTITION BY column_name)),
    ks AS (SELECT column_name, 'ks' AS method, CAST(max(bt) AS BIGINT) AS baseline_count,
                  CAST(max(ct) AS BIGINT) AS comparison_count,
                  round(max(abs(bu / bt - cu / ct)), 4) AS statistic, 0.15 AS threshold
           FROM w GROUP BY 1)"""
_PSI = f"""u AS ({_both(_PSI_COLUMNS, 'VARCHAR')}),
    h AS (SELECT column_name, v, sum(b) AS b, sum(c) AS c FROM u GROUP BY 1, 2),
    z AS (SELECT column_name, v, b, c, sum(b) OVER p AS bt, sum(c) OVER p AS ct,
                 1 + count(*) OVER p * 1e-6 AS s FROM h WINDOW p AS (PARTITION BY column_name)),
    q AS (SELECT column_name, bt, ct, (b / bt + 1e-6) / s AS e, (c / ct + 1e-6) / s AS a FROM z),
    psi AS (SELECT column_name, 'psi' AS method, CAST(max(bt) AS BIGINT) AS baseline_count,
                   CAST(max(ct) AS BIGINT) AS comparison_count,
                   round(sum((a - e) * ln(a / e)), 4) AS statistic, 0.2 AS threshold
            FROM q GROUP BY 1)"""


@register("drift_ks", _KS + " SELECT * FROM ks")
def drift_ks(spark, sf):
    out = drift.ks_drift(*_versions(spark, sf))
    return out.withColumn("statistic", F.round("statistic", 4))


@register("drift_psi", f"{_KS}, {_PSI} SELECT * FROM psi")
def drift_psi(spark, sf):
    out = drift.psi_drift(*_versions(spark, sf))
    return out.withColumn("statistic", F.round("statistic", 4))


@register("drift_columns", f"""{_KS}, {_PSI}
    SELECT *, statistic > threshold AS drift_detected, 'compared' AS status
    FROM (SELECT * FROM ks UNION ALL SELECT * FROM psi)""")
def drift_columns(spark, sf):
    return drift.column_drift(*_versions(spark, sf))


@register("drift_summary", f"""{_KS}, {_PSI},
    d AS (SELECT * FROM ks UNION ALL SELECT * FROM psi)
    SELECT count(*) AS columns_compared, count(*) FILTER (WHERE statistic > threshold) AS drift_columns,
           0 AS insufficient_sample_count, true AS schema_changed FROM d""")
def drift_summary(spark, sf):
    base, comp = _versions(spark, sf)
    changes = drift.schema_changes(base, comp.withColumn("o_channel", F.col("o_orderstatus")))
    return drift.drift_summary(drift.column_drift(base, comp), changes)


@register("schema_drift", f"""WITH {dirty_sql('customer')},
    b AS (SELECT column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
                 WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS t
          FROM information_schema.columns WHERE table_name = 'customer'),
    r AS (SELECT """ + ", ".join(f"typeof({c}) AS {c}" for c in DIRTY["customer"]) + """ FROM dirty_customer LIMIT 1),
    c AS (SELECT column_name, CASE t WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                 ELSE 'string' END AS t FROM (UNPIVOT r ON COLUMNS(*) INTO NAME column_name VALUE t))
    SELECT column_name, b.t AS baseline_type, c.t AS comparison_type,
           CASE WHEN b.t IS NULL THEN 'added' WHEN c.t IS NULL THEN 'removed' ELSE 'retyped' END AS change
    FROM b FULL JOIN c USING (column_name) WHERE b.t IS DISTINCT FROM c.t""")
def schema_drift(spark, sf):
    clean, changed = table(spark, sf, "customer"), dirty(spark, sf, "customer")
    return drift.schema_changes(clean, changed)


@register("version_pairs", """
    WITH v AS (SELECT conv_id AS dataset_id, turn AS version_number,
                      lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS baseline_version
               FROM conversations)
    SELECT * FROM v WHERE baseline_version IS NOT NULL""")
def version_pairs(spark, sf):
    """Conversations as version lists: every turn follows the one before it."""
    versions = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("dataset_id"), F.col("turn").alias("version_number")
    )
    return scoring.version_pairs(versions)
