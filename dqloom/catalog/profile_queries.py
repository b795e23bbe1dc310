"""Profile operators (counts, numbers, text, dates, tables) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqloom.catalog.inputs import dirty, dirty_sql, table, tall_sql
from dqloom.catalog.registry import register
from dqloom.functions import names
from dqloom.functions import text as tx
from dqloom.functions.dates import DATE_SHAPE
from dqloom.functions.missing import WHITESPACE
from dqloom.operators import counts, dates, numeric, tables, text

AS_OF = "2015-06-01 00:00:00"

CUSTOMER_TEXT = [
    "c_name", "c_email", "c_phone", "c_mktsegment", "c_rating", "c_since", "c_renewal",
]
CUSTOMER = ["c_custkey", *CUSTOMER_TEXT, "c_nationkey", "c_acctbal"]
LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]
WS = "'" + WHITESPACE + "'"
CUST = dirty_sql("customer")
CUST_TALL = f"WITH {CUST}, tall AS ({tall_sql('dirty_customer', CUSTOMER, 'VARCHAR')})"
TEXT_TALL = f"WITH {CUST}, tall AS ({tall_sql('dirty_customer', CUSTOMER_TEXT)})"
NUM_TALL = f"WITH tall AS ({tall_sql('lineitem', LINEITEM_NUMBERS, 'DOUBLE')})"


def _each(columns: list[str], row: str, source: str = "dirty_customer") -> str:
    return " UNION ALL ".join(
        "SELECT " + row.replace("{c}", c) + f" FROM {source}" for c in columns
    )


def _rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(F.col(n), 4))
    return df


# --- counts ---------------------------------------------------------------

@register("profile_nulls", f"WITH {CUST} " + _each(
    CUSTOMER,
    "'{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
    "count({c}) AS non_null_count, "
    "round((count(*) - count({c})) * 100.0 / count(*), 4) AS null_percentage",
))
def profile_nulls(spark, sf):
    return _rounded(counts.null_counts(dirty(spark, sf, "customer")), "null_percentage")


@register("profile_blank", f"WITH {CUST} " + _each(
    CUSTOMER_TEXT,
    "'{c}' AS column_name, count(*) AS row_count, "
    "count(*) FILTER (WHERE {c} = '') AS empty_string_count, "
    "round(count(*) FILTER (WHERE {c} = '') * 100.0 / count(*), 4) AS empty_string_percentage, "
    f"count(*) FILTER (WHERE {{c}} <> '' AND trim({{c}}, {WS}) = '') AS whitespace_only_count, "
    f"round(count(*) FILTER (WHERE {{c}} <> '' AND trim({{c}}, {WS}) = '') * 100.0 / count(*), 4)"
    " AS whitespace_only_percentage, "
    f"count(*) FILTER (WHERE {{c}} <> trim({{c}}, {WS}) AND trim({{c}}, {WS}) <> '') AS padded_count",
))
def profile_blank(spark, sf):
    return _rounded(
        counts.blank_counts(dirty(spark, sf, "customer")),
        "empty_string_percentage", "whitespace_only_percentage",
    )


@register("profile_distinct", CUST_TALL + """
    SELECT column_name, count(*) AS non_null_count, count(DISTINCT value) AS distinct_count,
           round(count(DISTINCT value) * 100.0 / count(*), 4) AS distinct_percentage
    FROM tall GROUP BY column_name""")
def profile_distinct(spark, sf):
    return _rounded(counts.distinct_counts(dirty(spark, sf, "customer")), "distinct_percentage")


@register("profile_duplicates", CUST_TALL + """,
    v AS (SELECT column_name, value, count(*) AS cnt FROM tall GROUP BY 1, 2)
    SELECT column_name, CAST(coalesce(sum(cnt) FILTER (WHERE cnt > 1), 0) AS BIGINT) AS duplicate_count,
           CAST(sum(cnt) - count(*) AS BIGINT) AS duplicate_excess_count
    FROM v GROUP BY column_name""")
def profile_duplicates(spark, sf):
    return counts.duplicate_counts(dirty(spark, sf, "customer"))


@register("profile_top_values", f"""WITH tall AS ({tall_sql('orders', ['o_orderstatus', 'o_orderpriority'])}
        UNION ALL {tall_sql('lineitem', ['l_linenumber', 'l_returnflag'], 'VARCHAR')}),
    v AS (SELECT column_name, value, count(*) AS cnt FROM tall GROUP BY 1, 2),
    s AS (SELECT column_name, count(*) AS category_count, sum(cnt) AS n FROM v GROUP BY 1
          HAVING count(*) <= 50 AND count(*) < sum(cnt)),
    r AS (SELECT v.*, s.category_count, s.n,
                 row_number() OVER (PARTITION BY v.column_name ORDER BY cnt DESC, value) AS position
          FROM v JOIN s USING (column_name))
    SELECT column_name, CAST(position AS INT) AS position, value, cnt AS count,
           round(cnt * 100.0 / n, 4) AS percentage, category_count FROM r WHERE position <= 10""")
def profile_top_values(spark, sf):
    o = counts.top_values(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])
    li = counts.top_values(table(spark, sf, "lineitem"), ["l_linenumber", "l_returnflag"])
    return _rounded(o.unionByName(li), "percentage")


@register("profile_constant", f"""WITH {dirty_sql('lineitem')},
    tall AS ({tall_sql('dirty_lineitem', ['l_price', 'l_returnflag', 'l_linenumber'], 'VARCHAR')}),
    v AS (SELECT column_name, value, count(*) AS cnt FROM tall GROUP BY 1, 2)
    SELECT column_name, count(*) <= 1 AS constant,
           count(*) > 1 AND max(cnt) / sum(cnt) >= 0.98 AS near_constant,
           round(max(cnt) * 100.0 / sum(cnt), 4) AS top_value_share_percentage,
           CASE WHEN count(*) <= 1 THEN max(value) END AS representative_value
    FROM v GROUP BY column_name""")
def profile_constant(spark, sf):
    return counts.constant_columns(
        dirty(spark, sf, "lineitem"), ["l_price", "l_returnflag", "l_linenumber"]
    )


def _words(tokens) -> str:
    return "[" + ", ".join(f"'{t}'" for t in tokens) + "]"


@register("column_name_signals", f"""WITH n AS (
        SELECT table_name, column_name, list_filter(string_split_regex(lower(regexp_replace(
            column_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: t <> '') AS t
        FROM information_schema.columns
        WHERE table_name IN ('customer', 'orders', 'lineitem', 'part', 'events', 'documents'))
    SELECT table_name, column_name, list_has_any(t, {_words(names.IDENTIFIER_STRONG_TOKENS)}) AS strong_name,
           list_has_any(t, {_words(names.IDENTIFIER_WEAK_TOKENS)}) AS weak_name,
           list_has_any(t, {_words(names.CODE_LIKE_TOKENS)}) AS code_name,
           list_has_any(t, {_words(names.COMPACT_DATE_TOKENS)}) AS date_name,
           array_to_string(t, ' ') AS tokens FROM n""")
def column_name_signals(spark, sf):
    columns = None
    for t in ("customer", "orders", "lineitem", "part", "events", "documents"):
        part = counts.column_catalog(table(spark, sf, t), t)
        columns = part if columns is None else columns.unionByName(part)
    return counts.name_signals(columns).select(
        "table_name", "column_name", "strong_name", "weak_name", "code_name", "date_name",
        F.array_join("name_tokens", " ").alias("tokens"),
    )


@register("identifier_signal", f"""WITH tall AS (
        {tall_sql('documents', ['doc_id', 'lang', 'source', 'n_chars'], 'VARCHAR')}
        UNION ALL {tall_sql('events', ['event_id', 'user_id', 'event_type', 'value'], 'VARCHAR')}),
    n AS (SELECT 'd' AS t, count(*) AS rows FROM documents UNION ALL SELECT 'e', count(*) FROM events),
    s AS (SELECT column_name, count(*) AS nn, count(DISTINCT value) AS dc FROM tall GROUP BY 1),
    m AS (SELECT s.*, CASE WHEN column_name IN ('event_id', 'user_id', 'event_type', 'value')
                           THEN 'e' ELSE 'd' END AS t,
                 column_name IN ('doc_id', 'event_id', 'user_id') AS strong FROM s)
    SELECT column_name, strong AS identifier_name_signal,
           round(nn * 100.0 / rows, 4) AS identifier_completeness_percentage,
           round(dc * 100.0 / nn, 4) AS identifier_uniqueness_percentage,
           strong AND nn = dc AS identifier_signal
    FROM m JOIN n USING (t)""")
def identifier_signal(spark, sf):
    d = counts.identifier_signals(
        table(spark, sf, "documents"), ["doc_id", "lang", "source", "n_chars"]
    )
    e = counts.identifier_signals(
        table(spark, sf, "events"), ["event_id", "user_id", "event_type", "value"]
    )
    return d.unionByName(e)


@register("profile_nested", """
    WITH v AS (SELECT embedding, count(*) AS cnt FROM embeddings GROUP BY 1)
    SELECT 'embedding' AS column_name, CAST(sum(cnt) AS BIGINT) AS non_null_count,
           count(*) AS distinct_count, round(count(*) * 100.0 / sum(cnt), 4) AS distinct_percentage
    FROM v""")
def profile_nested(spark, sf):
    return _rounded(
        counts.distinct_counts(table(spark, sf, "embeddings"), ["embedding"]),
        "distinct_percentage",
    )


# --- numbers --------------------------------------------------------------

@register("numeric_summary", NUM_TALL + """
    SELECT column_name, count(*) AS count, min(value) AS min, max(value) AS max,
           round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
           round(quantile_cont(value, 0.5), 4) AS median FROM tall GROUP BY column_name""")
def numeric_summary(spark, sf):
    out = numeric.numeric_summary(table(spark, sf, "lineitem"))
    return _rounded(out, "mean", "median", "std")


@register("numeric_quantiles", NUM_TALL + """
    SELECT column_name, """ + ", ".join(
        f"round(quantile_cont(value, {p}), 4) AS {n}" for p, n in numeric.QUANTILES.items()
    ) + """, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr
    FROM tall GROUP BY column_name""")
def numeric_quantiles(spark, sf):
    out = numeric.numeric_quantiles(table(spark, sf, "lineitem"))
    return _rounded(out, *numeric.QUANTILES.values(), "iqr")


@register("numeric_mad", NUM_TALL + """,
    m AS (SELECT column_name, quantile_cont(value, 0.5) AS med FROM tall GROUP BY 1)
    SELECT column_name, round(quantile_cont(abs(value - med), 0.5), 4) AS mad
    FROM tall JOIN m USING (column_name) GROUP BY column_name""")
def numeric_mad(spark, sf):
    return _rounded(numeric.numeric_mad(table(spark, sf, "lineitem")), "mad")


OUTLIER_COLUMNS = ["o_totalprice", "o_custkey"]


@register("numeric_outliers", f"""WITH {dirty_sql('orders')},
    tall AS ({tall_sql('dirty_orders', OUTLIER_COLUMNS, 'DOUBLE')}),
    q AS (SELECT column_name, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75
          FROM tall GROUP BY 1),
    f AS (SELECT tall.*, value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25) AS o
          FROM tall JOIN q USING (column_name))
    SELECT column_name, count(*) FILTER (WHERE o) AS outlier_count,
           round(count(*) FILTER (WHERE o) * 100.0 / count(*), 4) AS outlier_percentage
    FROM f GROUP BY column_name""")
def numeric_outliers(spark, sf):
    out = numeric.numeric_outliers(dirty(spark, sf, "orders"), OUTLIER_COLUMNS)
    return _rounded(out, "outlier_percentage")


@register("numeric_signs", f"""WITH {dirty_sql('orders')},
    tall AS ({tall_sql('dirty_orders', ['o_orderkey', *OUTLIER_COLUMNS], 'DOUBLE')})
    SELECT column_name, count(*) FILTER (WHERE value = 0) AS zero_count,
           count(*) FILTER (WHERE value < 0) AS negative_count,
           count(*) FILTER (WHERE value > 0) AS positive_count FROM tall GROUP BY column_name""")
def numeric_signs(spark, sf):
    return numeric.numeric_signs(dirty(spark, sf, "orders"))


@register("numeric_skew", f"""WITH {dirty_sql('orders')},
    tall AS ({tall_sql('dirty_orders', OUTLIER_COLUMNS, 'DOUBLE')}
             UNION ALL {tall_sql('events', ['value'], 'DOUBLE')})
    SELECT column_name, round(skewness(value), 4) AS skewness FROM tall GROUP BY column_name""")
def numeric_skew(spark, sf):
    o = numeric.numeric_skewness(dirty(spark, sf, "orders"), OUTLIER_COLUMNS)
    e = numeric.numeric_skewness(table(spark, sf, "events"), ["value"])
    return _rounded(o.unionByName(e), "skewness")


_DECIMALS = "CASE WHEN value = round(value) THEN 0 " + " ".join(
    f"WHEN abs(round(value * 1e{p}, 6) - round(round(value * 1e{p}, 6))) < 1e-6 THEN {p}"
    for p in range(1, 7)
) + " ELSE 6 END"


@register("numeric_precision", NUM_TALL + f"""
    SELECT column_name, bool_and(value = round(value)) AS integer_valued,
           max({_DECIMALS}) AS max_decimal_places,
           count(DISTINCT value) <= 50 AS low_cardinality FROM tall GROUP BY column_name""")
def numeric_precision(spark, sf):
    return numeric.numeric_precision(table(spark, sf, "lineitem"))


_SEQ_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice"]


@register("integer_sequence", f"""WITH tall AS (
        {tall_sql('orders', _SEQ_COLUMNS, 'DOUBLE')} UNION ALL
        {tall_sql('lineitem', ['l_linenumber', 'l_quantity'], 'DOUBLE')}),
    v AS (SELECT column_name, value, count(*) AS cnt FROM tall GROUP BY 1, 2),
    l AS (SELECT *, value - lag(value) OVER (PARTITION BY column_name ORDER BY value) AS step FROM v),
    s AS (SELECT column_name, bool_and(value = round(value)) AND count(*) > 1 AS usable,
                 max(cnt) = 1 AS uniq, min(step) AS lo, max(step) AS hi, min(value) AS first
          FROM l GROUP BY 1)
    SELECT column_name, usable AND lo = hi AND lo = 1 AS step_one,
           usable AND lo = hi AND lo = 1 AND uniq AS dense,
           usable AND lo = hi AND uniq AND first >= 0 AS counter_like FROM s""")
def integer_sequence(spark, sf):
    o = numeric.integer_sequences(table(spark, sf, "orders"), _SEQ_COLUMNS)
    li = numeric.integer_sequences(table(spark, sf, "lineitem"), ["l_linenumber", "l_quantity"])
    return o.unionByName(li)


@register("code_like", f"""WITH tall AS (
        {tall_sql('orders', ['o_orderkey', 'o_custkey', 'o_totalprice'], 'DOUBLE')} UNION ALL
        {tall_sql('events', ['event_id', 'user_id', 'value'], 'DOUBLE')}),
    v AS (SELECT column_name, value, count(*) AS cnt FROM tall GROUP BY 1, 2),
    l AS (SELECT *, value - lag(value) OVER (PARTITION BY column_name ORDER BY value) AS step FROM v),
    s AS (SELECT column_name, bool_and(value = round(value)) AS whole, count(*) > 1 AS several,
                 max(cnt) = 1 AS uniq, min(step) AS lo, max(step) AS hi, min(value) AS first
          FROM l GROUP BY 1),
    c AS (SELECT column_name, whole AS integer_valued, whole AND several AND lo = hi AND uniq AND first >= 0
                 AS counter_like, uniq AND list_has_any(string_split(column_name, '_'),
                 {_words(names.IDENTIFIER_STRONG_TOKENS)}) AS identifier_signal,
                 list_has_any(string_split(column_name, '_'), {_words(names.CODE_LIKE_TOKENS)}) AS named FROM s)
    SELECT column_name, integer_valued, counter_like, identifier_signal,
           named OR (integer_valued AND (counter_like OR identifier_signal)) AS code_like FROM c""")
def code_like(spark, sf):
    return numeric.code_like_columns(table(spark, sf, "orders")).unionByName(
        numeric.code_like_columns(table(spark, sf, "events"))
    )


@register("numeric_sentinel", f"""WITH {CUST},
    tall AS ({tall_sql('dirty_customer', ['c_custkey', 'c_nationkey', 'c_acctbal'], 'DOUBLE')}),
    v AS (SELECT column_name, value, count(*) AS cnt FROM tall GROUP BY 1, 2),
    r AS (SELECT *, sum(cnt) OVER (PARTITION BY column_name) AS n,
                 row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value DESC) AS r FROM v),
    h AS (SELECT *, value IN (-1, 0, 99, 999, 9999, -999, -9999, 99999) AND cnt / n >= 0.01 AS hit
          FROM r WHERE r = 1)
    SELECT column_name, CASE WHEN hit THEN CAST(value AS BIGINT) END AS sentinel_value,
           CASE WHEN hit THEN round(cnt * 100.0 / n, 4) END AS sentinel_percentage FROM h""")
def numeric_sentinel(spark, sf):
    return _rounded(
        numeric.numeric_sentinels(dirty(spark, sf, "customer")), "sentinel_percentage"
    )


@register("leading_zero_loss", f"""WITH tall AS (
        {tall_sql('events', ['event_id', 'user_id'], 'BIGINT')}),
    l AS (SELECT column_name, length(CAST(abs(value) AS VARCHAR)) AS digits, count(*) AS cnt
          FROM tall GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, digits) AS r,
                 first_value(digits) OVER (PARTITION BY column_name ORDER BY cnt DESC, digits) AS modal
          FROM l),
    s AS (SELECT column_name, max(modal) AS modal_length, max(cnt) FILTER (WHERE r = 1) AS mc,
                 sum(cnt) AS n, coalesce(sum(cnt) FILTER (WHERE digits < modal), 0) AS shorter,
                 string_agg(CAST(digits AS VARCHAR) || ':' || CAST(cnt AS VARCHAR), ',' ORDER BY r)
                     FILTER (WHERE r <= 5) AS digit_length_distribution
          FROM r GROUP BY 1)
    SELECT column_name, CAST(modal_length AS INT) AS modal_length,
           mc / n >= 0.8 AND shorter > 0 AND modal_length > 1 AS leading_zero_loss_suspected,
           CAST(CASE WHEN mc / n >= 0.8 AND shorter > 0 AND modal_length > 1 THEN shorter ELSE 0 END
                AS BIGINT) AS leading_zero_loss_count, digit_length_distribution FROM s""")
def leading_zero_loss(spark, sf):
    return numeric.leading_zero_loss(table(spark, sf, "events"))


# --- text -----------------------------------------------------------------

def _documents_text(spark, sf):
    return table(spark, sf, "documents").select("text", "lang", "source")


DOC_TALL = f"WITH tall AS ({tall_sql('documents', ['text', 'lang', 'source'])}) "


@register("text_lengths", DOC_TALL + """
    SELECT column_name, CAST(min(length(value)) AS BIGINT) AS min_length,
           CAST(max(length(value)) AS BIGINT) AS max_length,
           round(avg(length(value)), 4) AS mean_length,
           round(quantile_cont(CAST(length(value) AS DOUBLE), 0.5), 4) AS median_length,
           avg(length(value)) > 64 AS free_text FROM tall GROUP BY column_name""")
def text_lengths(spark, sf):
    out = text.text_lengths(_documents_text(spark, sf), repeated=False)
    return _rounded(out, "mean_length", "median_length")


def _pattern_sql(v: str) -> str:
    t = f"trim({v}, {WS})"
    date = f"regexp_matches({t}, '{DATE_SHAPE}')"
    digits = f"length(regexp_replace({t}, '[^0-9]', '', 'g'))"

    def test(p: str, x: str = t) -> str:
        return f"regexp_matches({x}, '{p}')"

    flags = {
        "email_like": test(tx.EMAIL),
        "phone_like": f"{test(tx.PHONE_SHAPE)} AND {digits} BETWEEN 7 AND 15 AND NOT {date}",
        "postal_like": test(tx.POSTAL), "currency_like": test(tx.CURRENCY),
        "numeric_like": test(tx.NUMERIC), "date_like": date,
        "alphanumeric_like": test(tx.ALPHANUMERIC),
        "contains_whitespace": test(tx.ANY_WHITESPACE, v),
        "contains_special_character": test(tx.SPECIAL, v),
    }
    return ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in flags.items())


@register("text_patterns", f"""WITH {CUST}, tall AS (
        {tall_sql('dirty_customer', CUSTOMER_TEXT)} UNION ALL
        {tall_sql('documents', ['text', 'lang'])} UNION ALL {tall_sql('pages', ['url'])})
    SELECT column_name, {_pattern_sql('value')} FROM tall GROUP BY column_name""")
def text_patterns(spark, sf):
    c = text.text_patterns(dirty(spark, sf, "customer"))
    d = text.text_patterns(
        table(spark, sf, "documents").select("text", "lang"), repeated=False
    )
    p = text.text_patterns(table(spark, sf, "pages").select("url"), repeated=False)
    return c.unionByName(d).unionByName(p)


@register("text_shapes", f"""WITH {CUST}, tall AS (
        {tall_sql('dirty_customer', CUSTOMER_TEXT)} UNION ALL
        {tall_sql('documents', ['text', 'source'])} UNION ALL {tall_sql('pages', ['url'])}),
    keep AS (SELECT column_name, count(*) AS n, min(length(value)) AS length_min,
                    max(length(value)) AS length_max FROM tall GROUP BY 1
             HAVING avg(length(value)) <= 64),
    s AS (SELECT column_name, regexp_replace(regexp_replace(value, '[A-Za-z]', 'A', 'g'),
                 '\\p{{Nd}}', '9', 'g') AS shape, count(*) AS cnt, min(value) AS example
          FROM tall WHERE column_name IN (SELECT column_name FROM keep) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, shape) AS position,
                 count(*) OVER (PARTITION BY column_name) AS distinct_shapes FROM s)
    SELECT column_name, CAST(position AS INT) AS position, shape, cnt AS count,
           round(cnt * 100.0 / n, 4) AS percentage, example, distinct_shapes,
           length_min = length_max AS constant_length, CAST(length_min AS INT) AS length_min,
           CAST(length_max AS INT) AS length_max,
           position = 1 AND cnt * 100.0 / n >= 95 AS is_regular
    FROM r JOIN keep USING (column_name) WHERE position <= 5""")
def text_shapes(spark, sf):
    c = text.text_shapes(dirty(spark, sf, "customer"))
    d = text.text_shapes(table(spark, sf, "documents").select("text", "source"), repeated=False)
    p = text.text_shapes(table(spark, sf, "pages").select("url"), repeated=False)
    return _rounded(c.unionByName(d).unionByName(p), "percentage")


def _described(spark, sf):
    c = text.shape_descriptions(dirty(spark, sf, "customer"))
    o = text.shape_descriptions(table(spark, sf, "orders"))
    return c.unionByName(o)


@register("shape_display")
def shape_display(spark, sf):
    return _described(spark, sf).select(
        "column_name", "dominant_shape", "collapsed_shape", "display_shape"
    )


@register("shape_regex")
def shape_regex(spark, sf):
    return _described(spark, sf).select("column_name", "is_regular", "suggested_regex")


@register("separator_chars", f"""WITH tall AS (
        {tall_sql('pages', ['url'])} UNION ALL {tall_sql('documents', ['text'])} UNION ALL
        {tall_sql('events', ['props'])}),
    c AS (SELECT column_name, unnest(regexp_extract_all(value, '{tx.SPECIAL}')) AS separator FROM tall),
    g AS (SELECT column_name, separator, count(*) AS count FROM c GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, separator) AS p
          FROM g)
    SELECT column_name, separator, count, CAST(p AS INT) AS position FROM r WHERE p <= 5""")
def separator_chars(spark, sf):
    p = text.separator_characters(table(spark, sf, "pages").select("url"), repeated=False)
    d = text.separator_characters(table(spark, sf, "documents").select("text"), repeated=False)
    e = text.separator_characters(table(spark, sf, "events").select("props"))
    return p.unionByName(d).unionByName(e)


_TOKENS = ", ".join(f"'{t}'" for t in tx.DISGUISED_MISSING)


@register("disguised_missing", TEXT_TALL + f""",
    h AS (SELECT column_name, lower(trim(value, {WS})) AS token, count(*) AS count FROM tall
          WHERE lower(trim(value, {WS})) IN ({_TOKENS}) GROUP BY 1, 2),
    k AS (SELECT * FROM h WHERE count / (SELECT count(*) FROM customer) < 0.5),
    r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, token) AS position,
                 sum(count) OVER (PARTITION BY column_name) AS total FROM k)
    SELECT column_name, CAST(position AS INT) AS position, token, count,
           CAST(total AS BIGINT) AS disguised_missing_count FROM r WHERE position <= 5""")
def disguised_missing(spark, sf):
    return text.disguised_missing(dirty(spark, sf, "customer"))


@register("case_variants", f"""WITH {CUST}, tall AS (
        {tall_sql('dirty_customer', CUSTOMER_TEXT)} UNION ALL {tall_sql('pages', ['url'])}),
    s AS (SELECT DISTINCT column_name,
                 regexp_replace(trim(value, {WS}), '{tx.ANY_WHITESPACE}+', ' ', 'g') AS spelling FROM tall),
    g AS (SELECT column_name, lower(spelling) AS norm, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT column_name, count(*) AS normalized_distinct_count,
           count(*) FILTER (WHERE n > 1) AS case_variant_groups FROM g GROUP BY column_name""")
def case_variants(spark, sf):
    c = text.case_variants(dirty(spark, sf, "customer"))
    return c.unionByName(text.case_variants(table(spark, sf, "pages").select("url")))


@register("case_variant_examples", TEXT_TALL + f""",
    s AS (SELECT DISTINCT column_name,
                 regexp_replace(trim(value, {WS}), '{tx.ANY_WHITESPACE}+', ' ', 'g') AS spelling FROM tall),
    r AS (SELECT *, lower(spelling) AS norm,
                 row_number() OVER (PARTITION BY column_name, lower(spelling) ORDER BY spelling) AS r,
                 count(*) OVER (PARTITION BY column_name, lower(spelling)) AS spellings FROM s),
    g AS (SELECT column_name, norm, max(spellings) AS spellings,
                 string_agg(spelling, '|' ORDER BY spelling) FILTER (WHERE r <= 3) AS examples,
                 row_number() OVER (PARTITION BY column_name ORDER BY max(spellings) DESC, norm) AS position
          FROM r WHERE spellings > 1 GROUP BY 1, 2)
    SELECT column_name, CAST(position AS INT) AS position, spellings, examples FROM g
    WHERE position <= 3""")
def case_variant_examples(spark, sf):
    out = text.case_variant_examples(dirty(spark, sf, "customer"))
    return out.withColumn("examples", F.array_join("examples", "|"))


@register("whitespace_padding", f"""WITH {CUST}, tall AS (
        {tall_sql('dirty_customer', CUSTOMER_TEXT)} UNION ALL {tall_sql('conversations', ['text', 'role'])})
    SELECT column_name, count(*) FILTER (WHERE value <> trim(value, {WS}) AND trim(value, {WS}) <> '')
           AS padded_count FROM tall GROUP BY column_name""")
def whitespace_padding(spark, sf):
    c = text.whitespace_padding(dirty(spark, sf, "customer"))
    return c.unionByName(text.whitespace_padding(table(spark, sf, "conversations")))


_IS_NUMBER = f"regexp_matches(trim(value, {WS}), '{tx.NUMERIC}')"


@register("storage_mismatch", f"""WITH {CUST}, tall AS (
        {tall_sql('dirty_customer', CUSTOMER_TEXT)} UNION ALL {tall_sql('events', ['props'])})
    SELECT column_name, 'string' AS stored_as,
           round(count(*) FILTER (WHERE {_IS_NUMBER}) * 100.0 / count(*), 4) AS numeric_like_percentage,
           bool_and({_IS_NUMBER}) AS semantic_storage_mismatch FROM tall GROUP BY column_name""")
def storage_mismatch(spark, sf):
    c = text.text_storage(dirty(spark, sf, "customer"))
    e = text.text_storage(table(spark, sf, "events"), ["props"])
    return _rounded(c.unionByName(e), "numeric_like_percentage")


# --- dates ----------------------------------------------------------------

def _detection_sql(c: str, fmt: str) -> str:
    shaped = f"count(*) FILTER (WHERE regexp_matches(trim({c}, {WS}), '{DATE_SHAPE}'))"
    return (
        f"SELECT '{c}' AS column_name, count(*) AS n, {shaped} AS date_like_count, "
        f"round({shaped} * 100.0 / count(*), 4) AS date_like_percentage, '{fmt}' AS detected_format, "
        f"100.0 AS format_confidence_percentage, false AS format_ambiguous "
        f"FROM dirty_customer WHERE {c} IS NOT NULL HAVING {shaped} * 100.0 / count(*) >= 95"
    )


@register("date_detection", f"WITH {CUST} " + _detection_sql("c_since", "%Y-%m-%d")
          + " UNION ALL " + _detection_sql("c_renewal", "%d/%m/%Y"))
def date_detection(spark, sf):
    return _rounded(dates.detect_dates(dirty(spark, sf, "customer")), "date_like_percentage")


@register("date_ambiguity")
def date_ambiguity(spark, sf):
    renewals = dirty(spark, sf, "customer").withColumn(
        "c_midmonth", F.concat(F.lit("0"), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit("/05/2020"))
    ).select("c_renewal", "c_midmonth")
    return dates.detect_dates(renewals).select(
        "column_name", "detected_format", "format_ambiguous", "format_confidence_percentage"
    )


_SINCE = f"trim(c_since, {WS})"


@register("date_profile", f"""WITH {CUST},
    t AS (SELECT {_SINCE} AS text, TRY_CAST({_SINCE} AS TIMESTAMP) AS ts FROM dirty_customer
          WHERE c_since IS NOT NULL)
    SELECT 'c_since' AS column_name, count(*) AS date_like_count, 100.0 AS date_like_percentage,
           '%Y-%m-%d' AS detected_format, 100.0 AS format_confidence_percentage,
           false AS format_ambiguous, count(ts) AS count, min(ts) AS min, max(ts) AS max,
           CAST(date_diff('day', min(ts), max(ts)) AS DOUBLE) AS span_days,
           count(DISTINCT ts) AS distinct_dates, false AS has_time_component,
           round(count(*) FILTER (WHERE ts > TIMESTAMP '{AS_OF}') * 100.0 / count(ts), 4)
               AS future_date_percentage,
           round(count(ts) * 100.0 / count(*), 4) AS parse_success_percentage,
           count(*) - count(ts) AS null_or_unparseable_count FROM t
    UNION ALL
    SELECT 'c_renewal', count(*), 100.0, '%d/%m/%Y', 100.0, false, count(ts), min(ts), max(ts),
           CAST(date_diff('day', min(ts), max(ts)) AS DOUBLE), count(DISTINCT ts), false,
           round(count(*) FILTER (WHERE ts > TIMESTAMP '{AS_OF}') * 100.0 / count(ts), 4),
           round(count(ts) * 100.0 / count(*), 4), count(*) - count(ts)
    FROM (SELECT try_strptime(c_renewal, '%d/%m/%Y') AS ts FROM dirty_customer)""")
def date_profile(spark, sf):
    out = dates.date_profile(dirty(spark, sf, "customer"), AS_OF)
    return _rounded(
        out, "span_days", "future_date_percentage", "parse_success_percentage",
        "date_like_percentage",
    )


def _datetime_sql(source: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, count({c}) AS count, min({c}) AS min, max({c}) AS max, "
        f"round(count({c}) * 100.0 / count(*), 4) AS format_valid_percentage, "
        f"bool_or({c} <> date_trunc('day', {c})) AS has_time_component, "
        f"round(count(*) FILTER (WHERE {c} > TIMESTAMP '{AS_OF}') * 100.0 / count({c}), 4) "
        "AS future_date_percentage, "
        f"round((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000.0, 4) AS span_days, "
        f"count(DISTINCT {c}) AS distinct_dates FROM {source}"
    )


@register("datetime_profile", f"WITH {dirty_sql('orders')} " + " UNION ALL ".join([
    _datetime_sql("dirty_orders", "o_orderdate"), _datetime_sql("dirty_orders", "o_shipdate"),
    _datetime_sql("events", "ts"),
]))
def datetime_profile(spark, sf):
    o = dates.datetime_profile(dirty(spark, sf, "orders"), AS_OF)
    e = dates.datetime_profile(table(spark, sf, "events"), AS_OF)
    return _rounded(
        o.unionByName(e), "format_valid_percentage", "future_date_percentage", "span_days"
    )


def _monotonic_sql(source: str, v: str, o: str) -> str:
    return (
        f"SELECT '{v}' AS column_name, coalesce(bool_and(hi_before <= v OR hi_before IS NULL), true) "
        "AS monotonic_increasing, coalesce(bool_and(lo_before >= v OR lo_before IS NULL), true) "
        "AS monotonic_decreasing FROM ("
        f"SELECT {v} AS v, max({v}) OVER w AS hi_before, min({v}) OVER w AS lo_before FROM {source} "
        f"WHERE {v} IS NOT NULL WINDOW w AS (ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND 1 PRECEDING))"
    )


@register("date_monotonic", " UNION ALL ".join([
    _monotonic_sql("events", "ts", "event_id"),
    _monotonic_sql("orders", "o_orderdate", "o_orderkey"),
    _monotonic_sql("part", "p_retailprice", "p_partkey"),
]))
def date_monotonic(spark, sf):
    return (
        dates.monotonic(table(spark, sf, "events"), "ts", "event_id")
        .unionByName(dates.monotonic(table(spark, sf, "orders"), "o_orderdate", "o_orderkey"))
        .unionByName(dates.monotonic(table(spark, sf, "part"), "p_retailprice", "p_partkey"))
    )


# --- tables ---------------------------------------------------------------

_REPEATED = "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1"


@register("duplicate_rows", " UNION ALL ".join(f"""
    SELECT '{name}' AS table_name, CAST(sum(cnt) AS BIGINT) AS row_count,
           CAST(coalesce(sum(cnt) FILTER (WHERE cnt > 1), 0) AS BIGINT) AS complete_duplicate_rows,
           CAST(coalesce(sum(cnt - 1) FILTER (WHERE cnt > 1), 0) AS BIGINT)
               AS complete_duplicate_excess_count
    FROM (SELECT count(*) AS cnt FROM ({source}) GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
          l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"""
    for name, source in (("lineitem", "SELECT * FROM lineitem"), ("repeated", _REPEATED))))
def duplicate_rows(spark, sf):
    """All columns of lineitem, and of lineitem with its first lines twice."""
    lines = table(spark, sf, "lineitem")
    twice = lines.unionByName(lines.filter("l_linenumber = 1"))
    named = [tables.duplicate_rows(df).withColumn("table_name", F.lit(name)) for name, df in (("lineitem", lines), ("repeated", twice))]
    return named[0].unionByName(named[1])


_FILLED = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in CUSTOMER)
_WIDTH = len(CUSTOMER)


@register("row_completeness", f"""WITH {CUST}, f AS (SELECT {_FILLED} AS filled FROM dirty_customer)
    SELECT count(*) AS row_count, count(*) FILTER (WHERE filled = {_WIDTH}) AS fully_complete_rows,
           round(count(*) FILTER (WHERE filled = {_WIDTH}) * 100.0 / count(*), 4)
               AS fully_complete_percentage,
           count(*) FILTER (WHERE filled < {_WIDTH}) AS rows_with_any_null,
           round(avg(filled) / {_WIDTH} * 100, 4) AS average_filled_percentage_per_row,
           round(min(filled) * 100.0 / {_WIDTH}, 4) AS emptiest_row_filled_percentage FROM f""")
def row_completeness(spark, sf):
    return _rounded(
        tables.row_completeness(dirty(spark, sf, "customer")), "fully_complete_percentage",
        "average_filled_percentage_per_row", "emptiest_row_filled_percentage",
    )


_NULLABLE = ["l_amount", "l_discount", "l_linestatus", "l_price", "l_quantity", "l_returnflag"]


@register("co_missing", f"""WITH {dirty_sql('lineitem')},
    p AS (SELECT concat_ws(',', {", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _NULLABLE)})
          AS columns FROM dirty_lineitem)
    SELECT columns, count(*) AS row_count FROM p WHERE columns LIKE '%,%'
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def co_missing(spark, sf):
    out = tables.co_missing_patterns(dirty(spark, sf, "lineitem"))
    return out.withColumn("columns", F.array_join("columns", ","))


_COMBOS = [
    ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_partkey"), ("l_partkey", "l_suppkey"),
    ("l_orderkey", "l_linenumber", "l_quantity"), ("l_orderkey", "l_shipdate"),
]


@register("composite_keys", " UNION ALL ".join(
    f"""SELECT '{"+".join(c)}' AS columns, CAST(sum(n) AS BIGINT) AS evaluated_row_count,
        count(*) AS composite_distinct_count,
        round(count(*) * 100.0 / sum(n), 4) AS composite_uniqueness_percentage,
        CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_composite_rows,
        CAST(sum(n) - count(*) AS BIGINT) AS duplicate_composite_excess_count,
        count(*) * 100.0 / sum(n) >= 99.9 AS near_exact
        FROM (SELECT count(*) AS n FROM lineitem GROUP BY {", ".join(c)})""" for c in _COMBOS
))
def composite_keys(spark, sf):
    out = tables.composite_uniqueness(table(spark, sf, "lineitem"), _COMBOS)
    out = out.withColumn("columns", F.array_join("columns", "+"))
    return _rounded(out, "composite_uniqueness_percentage")


_FD_COLUMNS = ["p_brand", "p_type", "p_group", "p_size"]
_FD_PART = dirty_sql("part")


def _fd_pairs_sql() -> str:
    parts = []
    for a in _FD_COLUMNS:
        for b in _FD_COLUMNS:
            if a != b:
                parts.append(
                    f"SELECT '{a}' AS determinant, '{b}' AS dependent, sum(n) AS evaluated_rows, "
                    "coalesce(sum(n) FILTER (WHERE d > 1), 0) AS violating_rows, "
                    "count(*) FILTER (WHERE d > 1) AS violating_groups FROM ("
                    f"SELECT count(*) AS n, count(DISTINCT {b}) AS d FROM dirty_part "
                    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a})"
                )
    return " UNION ALL ".join(parts)


_FD_CTE = f"""WITH {_FD_PART}, m AS ({_fd_pairs_sql()}),
    c AS (SELECT *, 100.0 * (1.0 - violating_rows / evaluated_rows) AS cov FROM m),
    k AS (SELECT * FROM c WHERE cov >= 98),
    fd AS (SELECT a.*, EXISTS (SELECT 1 FROM k b WHERE b.determinant = a.dependent
                               AND b.dependent = a.determinant) AS bidirectional
           FROM k a WHERE a.evaluated_rows >= 30)"""
_FD_OUT = """determinant, dependent, CAST(evaluated_rows AS BIGINT) AS evaluated_rows,
    CAST(violating_rows AS BIGINT) AS violating_rows, violating_groups,
    round(cov, 4) AS coverage_percentage, bidirectional"""


def _dependencies(spark, sf):
    return tables.functional_dependencies(dirty(spark, sf, "part"), _FD_COLUMNS)


@register("functional_dependencies", f"{_FD_CTE} SELECT {_FD_OUT} FROM fd")
def functional_dependencies(spark, sf):
    return _rounded(_dependencies(spark, sf), "coverage_percentage")


_CHAIN = ["c_custkey", "c_nationkey", "n_name", "n_regionkey"]


def _chain(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(*_CHAIN)


def _chain_pairs_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS determinant, '{b}' AS dependent, count(*) FILTER (WHERE d > 1) = 0 AS exact "
        f"FROM (SELECT count(DISTINCT {b}) AS d FROM chain GROUP BY {a})"
        for a in _CHAIN for b in _CHAIN if a != b
    )


@register("fd_reduced", f"""WITH chain AS (
        SELECT {", ".join(_CHAIN)} FROM customer JOIN nation ON c_nationkey = n_nationkey),
    p AS ({_chain_pairs_sql()}), e AS (SELECT determinant, dependent FROM p WHERE exact)
    SELECT determinant, dependent FROM e WHERE NOT EXISTS (
        SELECT 1 FROM e x JOIN e y ON x.dependent = y.determinant
        WHERE x.determinant = e.determinant AND y.dependent = e.dependent
          AND x.dependent <> e.dependent AND y.determinant <> e.determinant
          AND NOT EXISTS (SELECT 1 FROM e z WHERE z.determinant = e.dependent
                          AND z.dependent = x.dependent))""")
def fd_reduced(spark, sf):
    pairs = tables.functional_dependencies(_chain(spark, sf), _CHAIN, min_coverage=100.0)
    return tables.reduce_dependencies(pairs).select("determinant", "dependent")


@register("fd_violations", f"""WITH {_FD_PART},
    b AS (SELECT p_group AS a FROM dirty_part GROUP BY 1 HAVING count(DISTINCT p_type) > 1
          ORDER BY 1 LIMIT 3),
    v AS (SELECT DISTINCT p_group AS a, p_type AS b FROM dirty_part WHERE p_group IN (SELECT a FROM b)),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS r FROM v)
    SELECT 'p_group' AS determinant, 'p_type' AS dependent, a AS determinant_value,
           string_agg(b, '|' ORDER BY b) AS dependent_values FROM r WHERE r <= 3 GROUP BY a""")
def fd_violations(spark, sf):
    out = tables.dependency_violations(dirty(spark, sf, "part"), "p_group", "p_type")
    return out.withColumn("dependent_values", F.array_join("dependent_values", "|"))
