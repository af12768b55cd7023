"""The same results as plain SQL, for checking the registered queries."""

from __future__ import annotations

from tabulon.operators.corpus import stop_word_list

# Whitespace as the text functions see it, for an engine whose \s is ASCII only.
SPACES = (
    r"\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORDS = f"CAST(len(regexp_extract_all(text, '[^{SPACES}]+')) AS INTEGER)"
STRIPPED = f"regexp_replace(text, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"
CLEAN = f"regexp_replace(regexp_replace(lower(text), '[{SPACES}]+', ' ', 'g'), '^ +| +$', '', 'g')"


def _words_of(column: str) -> str:
    return f"CAST(len(regexp_extract_all({column}, '[^{SPACES}]+')) AS INTEGER)"


def _stop_list() -> str:
    words = stop_word_list("english")
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _tokens(stop: bool = True) -> str:
    found = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
    if not stop:
        return found
    return f"list_filter({found}, lambda w: NOT list_contains({_stop_list()}, w))"


def _profile(source: str, columns: dict[str, str], text: str | None = None, extras: bool = False):
    parts = []
    for c, kind in columns.items():
        part = (
            f"SELECT '{c}' AS column_name, '{kind}' AS column_type, "
            f"count(*) - count({c}) AS missing_count, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_percentage, "
            f"count(DISTINCT {c}) AS unique_count"
        )
        if extras and c == text:
            part += (
                f", round(avg({WORDS}), 2) AS average_words, max({WORDS}) AS max_words, "
                f"round(avg(length({c})), 2) AS average_characters"
            )
        elif extras:
            part += (
                ", CAST(NULL AS DOUBLE) AS average_words, CAST(NULL AS INTEGER) AS max_words, "
                "CAST(NULL AS DOUBLE) AS average_characters"
            )
        parts.append(f"{part} FROM {source}")
    return " UNION ALL ".join(parts)


def _states(source: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        text = kind == "text"
        words = f"round(avg({_words_of(c)}), 2), max({_words_of(c)}), round(avg(length({c})), 2)" if text else (
            "CAST(NULL AS DOUBLE), CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE)"
        )
        value = f"CAST({c} AS DOUBLE)" if kind == "numeric" else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{source}', '{c}', '{kind}', count(*), count(*) - count({c}), {words}, min({value}), max({value}), "
            f"round(avg({value}), 4), round(stddev_samp({value}), 4), TRUE FROM {source}"
        )
    names = (
        "source_table, column_name, column_type, row_count, missing_count, average_words, max_words, "
        "average_characters, minimum, maximum, mean, standard_deviation, unique_fits"
    )
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS t({names})"


GAPPY_LINEITEM = """(SELECT * REPLACE (nullif(l_quantity, 50) AS l_quantity,
    nullif(l_discount, 0) AS l_discount, nullif(l_returnflag, 'R') AS l_returnflag) FROM lineitem)"""
MANY_GROUPS = """(SELECT l_extendedprice, l_returnflag || CAST(l_linenumber AS VARCHAR) AS slot FROM lineitem)"""
GAPPY_CUSTOMER = """(SELECT c_custkey, c_nationkey,
    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal,
    nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)"""


def _missing(columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count FROM {GAPPY_LINEITEM}"
        for c in columns
    )


LINEITEM_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def _numeric(source, columns, digits=4, coerced=False):
    parts = []
    for c in columns:
        x = f"CASE WHEN regexp_full_match({c}, '[0-9]+') THEN TRY_CAST({c} AS DOUBLE) END" if coerced else f"CAST({c} AS DOUBLE)"
        r = (lambda e: f"round({e}, {digits})") if not coerced else (lambda e: e)
        parts.append(
            f"""SELECT '{c}' AS column_name, count(x) AS count, count(*) - count(raw) AS missing_count,
            count(DISTINCT x) AS unique_count, round(avg(x), {digits}) AS mean,
            round(stddev_samp(x), {digits}) AS standard_deviation, min(x) AS minimum,
            {r('quantile_cont(x, 0.25)')} AS first_quartile, {r('quantile_cont(x, 0.5)')} AS median,
            {r('quantile_cont(x, 0.75)')} AS third_quartile, max(x) AS maximum,
            count(*) FILTER (x = 0) AS zero_count, count(*) FILTER (x < 0) AS negative_count
            FROM (SELECT {x} AS x, {c} AS raw FROM {source})"""
        )
    return " UNION ALL ".join(parts)


def _describe_text(table):
    return f"""SELECT 'text' AS column_name, count(t) AS count, count(*) - count(t) AS missing_count,
    count(DISTINCT t) AS unique_count, count(*) FILTER (t = '') AS empty_string_count,
    round(avg(w), 6) AS average_words, min(w) AS minimum_words, max(w) AS maximum_words,
    round(avg(n), 6) AS average_characters, min(n) AS minimum_characters, max(n) AS maximum_characters,
    '{table}' AS source_table
    FROM (SELECT t, CASE WHEN t <> '' THEN {_words_of('t')} END AS w,
          CASE WHEN t <> '' THEN CAST(length(t) AS INTEGER) END AS n
          FROM (SELECT {STRIPPED} AS t FROM {table}))"""


def _datetime(source, column, expression):
    iso = """CASE WHEN microsecond({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%dT%H:%M:%S')
        ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') END"""
    return f"""SELECT '{column}' AS column_name, count(t) AS count, count(*) - count(raw) AS missing_count,
    count(raw) - count(t) AS invalid_date_count, count(DISTINCT t) AS unique_count,
    {iso.format('min(t)')} AS earliest, {iso.format('max(t)')} AS latest,
    date_sub('day', min(t), max(t)) AS range_days
    FROM (SELECT {expression} AS t, {column} AS raw FROM {source})"""


def _boolean(source, column, expression):
    return f"""SELECT '{column}' AS column_name, count(b) AS count, count(*) - count(b) AS missing_count,
    count(*) FILTER (b) AS true_count, count(*) FILTER (NOT b) AS false_count,
    round(count(*) FILTER (b) * 100.0 / count(b), 2) AS true_percentage,
    round(count(*) FILTER (NOT b) * 100.0 / count(b), 2) AS false_percentage
    FROM (SELECT {expression} AS b FROM {source})"""


# Two-sided normal tail of |z| by Simpson's rule on 4,000 intervals.
NORMAL_P = """(SELECT greatest(0.0, 1 - 2 * sum(
      CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * exp(-power(i * {z} / 4000, 2) / 2) / sqrt(2 * pi())) * {z} / 4000 / 3)
    FROM range(0, 4001) AS s(i))"""

# Mann-Whitney figures per pair of groups (a < b) of a table base(g, x).
PAIR_TESTS = """
  ranked AS (
    SELECT p.a, p.b, t.g, t.x,
      rank() OVER (PARTITION BY p.a, p.b ORDER BY t.x) + (count(*) OVER (PARTITION BY p.a, p.b, t.x) - 1) / 2.0 AS r,
      count(*) OVER (PARTITION BY p.a, p.b, t.x) AS ties
    FROM base t JOIN (SELECT a.g AS a, b.g AS b FROM (SELECT DISTINCT g FROM base) a
                      JOIN (SELECT DISTINCT g FROM base) b ON a.g < b.g) p ON t.g = p.a OR t.g = p.b),
  sums AS (
    SELECT a, b, CAST(count(*) FILTER (g = a) AS DOUBLE) AS n1, CAST(count(*) FILTER (g = b) AS DOUBLE) AS n2,
      sum(r) FILTER (g = a) AS r1, median(x) FILTER (g = a) AS m1, median(x) FILTER (g = b) AS m2,
      sum(CAST(ties AS DOUBLE) * ties - 1) AS tie
    FROM ranked GROUP BY a, b),
  scored AS (
    SELECT *, r1 - n1 * (n1 + 1) / 2 AS u,
      (greatest(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) - n1 * n2 / 2 - 0.5)
      / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM sums),
  tested AS (SELECT s0.*, least(1.0, CASE WHEN z > 8 THEN 0.0 ELSE """ + NORMAL_P.format(z="s0.z") + """ END) AS p FROM scored s0)
"""


def _posthoc(source):
    return f"""WITH base AS ({source}), {PAIR_TESTS},
    ordered AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM tested),
    adjusted AS (SELECT *, least(1.0, max(p * (m - i + 1)) OVER (ORDER BY i)) AS q FROM ordered)
    SELECT a AS group_1, b AS group_2, CAST(n1 AS BIGINT) AS group_1_n, CAST(n2 AS BIGINT) AS group_2_n,
      round(m1, 6) AS group_1_median, round(m2, 6) AS group_2_median, u AS statistic, round(p, 6) AS p_value,
      round(2 * u / n1 / n2 - 1, 6) AS rank_biserial, 'normal' AS p_method, round(q, 6) AS adjusted_p_value, q <= 0.05 AS significant FROM adjusted"""


def _kruskal(numeric, group, table, p):
    return f"""WITH base AS (SELECT {group} AS g, CAST({numeric} AS DOUBLE) AS x FROM {table}),
    ranked AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r,
      count(*) OVER (PARTITION BY x) AS ties FROM base),
    total AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie FROM ranked),
    per AS (SELECT g, count(*) AS c, avg(r) AS mean FROM ranked GROUP BY g),
    stat AS (SELECT 12 / (n * (n + 1)) * sum(c * power(mean - (n + 1) / 2, 2)) / (1 - tie / (n * n * n - n)) AS h,
      any_value(n) AS n, count(*) AS k FROM per, total GROUP BY n, tie)
    SELECT 'kruskal_wallis' AS method, '{numeric}' AS numeric_column, '{group}' AS group_column,
      CAST(n AS BIGINT) AS n, k AS number_of_groups, round(h, 6) AS statistic, round({p}, 6) AS p_value"""


def _chi(column_1, column_2, table):
    return f"""cells AS (SELECT {column_1} AS a, {column_2} AS b, count(*) AS n FROM {table} GROUP BY 1, 2),
    ra AS (SELECT a, sum(n) AS r FROM cells GROUP BY a), cb AS (SELECT b, sum(n) AS c FROM cells GROUP BY b),
    tot AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM cells),
    grid AS (SELECT coalesce(n, 0) AS o, r * c / t AS e, t FROM ra CROSS JOIN cb CROSS JOIN tot
      LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b)"""


def _scaled(centre, scale):
    stats = f"""filled AS (SELECT c_custkey, coalesce(c_acctbal, (SELECT median(c_acctbal) FROM {GAPPY_CUSTOMER})) AS x,
      CAST(c_nationkey AS DOUBLE) AS y FROM {GAPPY_CUSTOMER})"""
    part = lambda v: f"(v.{v} - f.{v}c) / CASE WHEN f.{v}s = 0 THEN 1 ELSE f.{v}s END"
    figures = ", ".join(
        f"{centre.format(v)} AS {v}c, {scale.format(v)} AS {v}s" for v in ("x", "y")
    )
    return f"""WITH {stats}, figures AS (SELECT {figures} FROM filled)
    SELECT c_custkey, round({part('x')}, 6) AS balance, round({part('y')}, 6) AS nation
    FROM filled v CROSS JOIN figures f"""


def _fold_scaled(centre, scale):
    parts = [
        f"""SELECT CAST({fold} AS INTEGER) AS fold, '{column}' AS column_name, any_value(m) AS fill, {centre} AS centre, {scale} AS scale
        FROM (SELECT m, coalesce(CAST({column} AS DOUBLE), m) AS x FROM
          (SELECT *, median({column}) OVER () AS m FROM {GAPPY_CUSTOMER} WHERE c_custkey % 4 <> {fold}))"""
        for fold in range(4) for column in ("c_acctbal", "c_nationkey")
    ]
    return f"""SELECT fold, column_name, round(CAST(fill AS DOUBLE), 6) AS fill, round(CAST(centre AS DOUBLE), 6) AS centre,
      round(CAST(CASE WHEN scale = 0 THEN 1 ELSE scale END AS DOUBLE), 6) AS scale FROM ({" UNION ALL ".join(parts)})"""


TWO_CENTERS = ((0, 5), (6000, 20))
THREE_CENTERS = ((-500, 0), (4000, 12), (9000, 24))


def _nearest(centers):
    """The number of the nearest centre of a customer, the first of equals."""
    far = ", ".join(f"(c_acctbal - ({b})) * (c_acctbal - ({b})) + (c_nationkey - {n}) * (c_nationkey - {n})" for b, n in centers)
    return f"CAST(list_position([{far}], least({far})) - 1 AS INTEGER)"


def _ngrams(n, table="documents", stop=True, name="ngram"):
    slice_ = f"array_to_string(w[i:i + {n - 1}], ' ')" if n > 1 else "w[i]"
    return f"""SELECT {name}, count(*) AS frequency FROM (
      SELECT unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: {slice_})) AS {name}
      FROM (SELECT {_tokens(stop)} AS w FROM {table})) GROUP BY {name}
      ORDER BY frequency DESC, {name} LIMIT 20"""


def _corpus(table):
    return f"""SELECT 'text' AS column_name, count(*) AS document_count, count(DISTINCT text) AS unique_documents,
    count(*) - count(DISTINCT text) AS duplicate_documents, round(avg(w), 6) AS average_words,
    median(w) AS median_words, min(w) AS minimum_words, max(w) AS maximum_words,
    round(avg(length(text)), 6) AS average_characters, '{table}' AS source_table
    FROM (SELECT text, {WORDS} AS w FROM {table} WHERE {STRIPPED} <> '')"""


def _detect(column, table, task, warned):
    return f"""SELECT '{column}' AS target_column, '{task}' AS task_type,
    count(DISTINCT {column}) AS unique_target_values, {warned} AS warned FROM {table}"""


def _class_metrics(source):
    return f"""WITH pairs AS ({source}),
    labels AS (SELECT t AS label FROM pairs UNION SELECT p FROM pairs),
    per AS (SELECT label, (SELECT count(*) FROM pairs WHERE t = label) AS s,
      (SELECT count(*) FROM pairs WHERE p = label) AS q,
      (SELECT count(*) FROM pairs WHERE p = label AND t = label) AS h FROM labels)
    SELECT round(avg(2.0 * h / (s + q)), 9) AS f1_macro, round(sum(2.0 * h / (s + q) * s) / sum(s), 9) AS f1_weighted,
      round(avg(CASE WHEN s > 0 THEN h * 1.0 / s END), 9) AS balanced_accuracy,
      round(sum(h) * 1.0 / sum(s), 9) AS accuracy FROM per"""


def _fold_summary(deviation):
    return f"""WITH t AS (SELECT o_orderkey % 5 AS fold, o_totalprice AS y, o_custkey * 100.0 AS p FROM orders),
    folds AS (SELECT fold, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2, avg(abs(y - p)) AS mae,
      sqrt(avg((y - p) * (y - p))) AS rmse FROM t GROUP BY fold),
    long AS (SELECT 'r2' AS metric, r2 AS v FROM folds UNION ALL SELECT 'mae', mae FROM folds
      UNION ALL SELECT 'rmse', rmse FROM folds)
    SELECT metric, round(avg(v), 4) AS mean, round({deviation}(v), 4) AS standard_deviation,
      round(min(v), 4) AS minimum, round(max(v), 4) AS maximum FROM long GROUP BY metric"""



def _cluster(distance, kind):
    """Indices of the labelled vectors; ``distance`` of squared distance d2 feeds the silhouette."""
    return f"""WITH pts AS (SELECT vec_id AS id, label AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    sizes AS (SELECT c, count(*) AS n FROM pts GROUP BY c),
    flat AS (SELECT id, c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM pts),
    centre AS (SELECT c, d, avg(x) AS m FROM flat GROUP BY c, d),
    overall AS (SELECT d, avg(x) AS m FROM flat GROUP BY d),
    own AS (SELECT id, f.c, sum((x - m) * (x - m)) AS d2 FROM flat f JOIN centre USING (c, d) GROUP BY id, f.c),
    spread AS (SELECT c, avg(sqrt(d2)) AS s, sum(d2) AS w FROM own GROUP BY c),
    apart AS (SELECT a.c AS i, b.c AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dist
      FROM centre a JOIN centre b ON a.d = b.d AND a.c <> b.c GROUP BY 1, 2),
    davies AS (SELECT avg(worst) AS db FROM (SELECT i, max((si.s + sj.s) / dist) AS worst
      FROM apart JOIN spread si ON si.c = i JOIN spread sj ON sj.c = j GROUP BY i)),
    between_ AS (SELECT sum(n * (centre.m - overall.m) * (centre.m - overall.m)) AS b
      FROM centre JOIN overall USING (d) JOIN sizes USING (c)),
    pair AS (SELECT a.id, a.c AS own_c, b.c AS other, list_sum(list_transform(range(1, len(a.v) + 1),
        lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS d2
      FROM pts a JOIN pts b ON a.id <> b.id),
    means AS (SELECT id, own_c, other, sum({distance}) / CASE WHEN own_c = other THEN any_value(n) - 1 ELSE any_value(n) END AS m
      FROM pair JOIN sizes ON sizes.c = other GROUP BY id, own_c, other),
    sil AS (SELECT avg((bb - aa) / greatest(aa, bb)) AS s FROM (
      SELECT id, max(m) FILTER (own_c = other) AS aa, min(m) FILTER (own_c <> other) AS bb FROM means GROUP BY id))
    SELECT CAST(k AS INTEGER) AS k, round(s, 6) AS silhouette_score, '{kind}' AS silhouette_kind,
      round(b / w * (n - k) / (k - 1), 6) AS calinski_harabasz_score,
      round(db, 6) AS davies_bouldin_score, round(w, 6) AS inertia
    FROM sil, davies, between_, (SELECT sum(w) AS w FROM spread),
      (SELECT count(*) AS k, sum(n) AS n FROM sizes)"""


def _corrections():
    steps = {
        "holm": "max(p * (m - i + 1)) OVER (ORDER BY i)",
        "bonferroni": "p * m",
        "sidak": "1 - power(1 - p, m)",
        "holm-sidak": "max(1 - power(1 - p, m - i + 1)) OVER (ORDER BY i)",
        "fdr_bh": "min(p * m / i) OVER (ORDER BY i DESC)",
        "fdr_by": "min(p * m / i * h) OVER (ORDER BY i DESC)",
        "simes-hochberg": "min(p * (m - i + 1)) OVER (ORDER BY i DESC)",
        "hommel": "hommel",
        "fdr_tsbh": "bh * CASE WHEN r1 BETWEEN 1 AND m - 1 THEN (m - r1) / m ELSE 1.0 END",
        "fdr_tsbky": "1.05 * bh * CASE WHEN r2 BETWEEN 1 AND m - 1 THEN (m - r2) / m ELSE 1.0 END",
    }
    parts = [
        f"SELECT group_1, group_2, round(p, 6) AS p_value, round(least(1.0, {step}), 6) AS adjusted_p_value, "
        f"'{name}' AS correction FROM ordered"
        for name, step in steps.items()
    ]
    return (
        f"WITH base AS (SELECT event_type AS g, value AS x FROM events), {PAIR_TESTS}, "
        "placed AS (SELECT a AS group_1, b AS group_2, p, row_number() OVER (ORDER BY p) AS i, "
        "count(*) OVER () AS m, (SELECT sum(1.0 / j) FROM range(1, 11) AS t(j)) AS h FROM tested), "
        "step AS (SELECT *, least(1.0, min(p * m / i) OVER (ORDER BY i DESC)) AS bh FROM placed), "
        # Hommel by its definition: p is adjusted to the least level at which every set of
        # tests that holds it is rejected by Simes; sets with the largest others suffice.
        "sizes AS (SELECT unnest(range(1, 11)) AS size), "
        "subsets AS (SELECT a.i, size, min(least(1.0, size * b.p / CASE WHEN b.i = a.i AND a.i <= 10 - size + 1 THEN 1 "
        "ELSE b.i - (10 - size) END)) AS simes FROM placed a, sizes, placed b WHERE size <= a.m AND "
        "CASE WHEN a.i > 10 - size THEN b.i > 10 - size ELSE b.i > 10 - size + 1 OR b.i = a.i END GROUP BY a.i, size), "
        "closed AS (SELECT i, max(simes) AS hommel FROM subsets GROUP BY i), "
        "ordered AS (SELECT *, (SELECT count(*) FROM step WHERE bh <= 0.05) AS r1, "
        "(SELECT count(*) FROM step WHERE bh <= 0.05 / 1.05) AS r2 FROM step JOIN closed USING (i)) "
        + " UNION ALL ".join(parts)
    )


def oracle_sql() -> dict[str, str]:
    orders = {
        "o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical",
        "o_totalprice": "numeric", "o_orderdate": "datetime", "o_orderpriority": "categorical",
    }
    events = {
        "event_id": "numeric", "ts": "datetime", "user_id": "numeric",
        "event_type": "categorical", "value": "numeric", "props": "categorical",
    }
    documents = {
        "doc_id": "numeric", "text": "text", "lang": "categorical", "source": "categorical",
        "n_chars": "numeric",
    }
    segments = ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    mode = f"(SELECT c_mktsegment FROM {GAPPY_CUSTOMER} WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    return {
        "preview_rows": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10",
        "dataset_names": " UNION ALL ".join(
            f"SELECT '{t}' AS dataset_name, count(*) AS n FROM {t}" for t in ("orders", "customer", "events")
        ),
        "csv_roundtrip": """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
            nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, c_acctbal < 0 AS owes FROM customer""",
        "pairwise_rows": """SELECT count(*) AS n, sum(l_quantity) AS total FROM lineitem
            WHERE l_quantity <> 50 AND l_tax > 0""",
        "coerce_numeric": _numeric("(SELECT CASE WHEN event_type = 'view' THEN event_type ELSE json_extract_string(props, '$.k') END AS k FROM events)", ["k"], 6, True),
        "clean_texts": f"SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM (SELECT doc_id, {CLEAN} AS t FROM documents)",
        "text_lengths": f"SELECT doc_id, {WORDS} AS words, CAST(length(text) AS INTEGER) AS chars FROM documents",
        "token_counts": f"SELECT doc_id, CAST(len({_tokens()}) AS INTEGER) AS tokens FROM documents",
        "profile_orders": _profile("orders", orders),
        "profile_events": _profile(
            "(SELECT * REPLACE (CASE WHEN value < 50 THEN value END AS value) FROM events)", events
        ),
        "profile_documents": _profile("documents", documents, "text", True),
        "profile_incremental": _states("lineitem", dict.fromkeys(LINEITEM_COLUMNS[:8], "numeric") | dict.fromkeys(LINEITEM_COLUMNS[8:10], "categorical")
            | {"l_shipdate": "datetime"}) + " UNION ALL "
            + _states("documents", {"doc_id": "numeric", "text": "text", "lang": "categorical", "source": "categorical", "n_chars": "numeric"}),
        "dataset_row": """SELECT count(*) AS row_count, 2 AS column_count,
            count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicate_rows FROM documents""",
        "text_columns": f"""SELECT column_name FROM (
            SELECT 'text' AS column_name, avg({WORDS}) AS w FROM documents
            UNION ALL SELECT 'lang', avg({_words_of('lang')}) FROM documents
            UNION ALL SELECT 'source', avg({_words_of('source')}) FROM documents) WHERE w >= 6""",
        "top_missing": _missing(LINEITEM_COLUMNS),
        "total_missing_cells": f"SELECT CAST(sum(missing_count) AS BIGINT) AS total_missing_cells FROM ({_missing(LINEITEM_COLUMNS)})",
        "testable_columns": """SELECT *, CASE WHEN unique_count = 2 THEN 'binary' ELSE 'multi_group' END AS candidate FROM (
            SELECT 'l_returnflag' AS column_name, 'categorical' AS column_type, count(DISTINCT l_returnflag) AS unique_count FROM lineitem
            UNION ALL SELECT 'l_linestatus', 'categorical', count(DISTINCT l_linestatus) FROM lineitem) WHERE unique_count >= 2""",
        "describe_numeric": _numeric(
            GAPPY_LINEITEM, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey"]
        ),
        "describe_categorical": " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count({c}) AS count, count(*) - count({c}) AS missing_count,
            count(DISTINCT {c}) AS unique_count,
            (SELECT {c} FROM {GAPPY_LINEITEM} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS most_frequent,
            (SELECT count(*) FROM {GAPPY_LINEITEM} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS most_frequent_count
            FROM {GAPPY_LINEITEM}"""
            for c in ("l_returnflag", "l_linestatus")
        ),
        "describe_categorical_top": "SELECT column_name, CAST(place AS INTEGER) AS place, value, frequency FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS place,
            CAST({c} AS VARCHAR) AS value, count(*) AS frequency FROM orders GROUP BY {c}"""
            for c in ("o_orderstatus", "o_orderpriority", "o_custkey")
        )
        + ") WHERE place <= 3",
        "describe_text": " UNION ALL ".join(_describe_text(t) for t in ("documents", "conversations")),
        "describe_datetime": " UNION ALL ".join(
            [
                _datetime("events", "ts", "ts"),
                _datetime("orders", "o_orderdate", "o_orderdate"),
                _datetime(
                    """(SELECT CASE WHEN o_orderstatus = 'P' THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END
                    AS order_text FROM orders)""",
                    "order_text", "TRY_CAST(order_text AS TIMESTAMP)",
                ),
            ]
        ),
        "describe_boolean": _boolean("labels", "good", "quality = 1") + " UNION ALL "
        + _boolean("labels", "toxic_if_good", "CASE WHEN quality = 1 THEN toxic = 1 END"),
        "describe_other": """SELECT 'embedding' AS column_name, 'array<float>' AS dtype, count(embedding) AS count,
            count(*) - count(embedding) AS missing_count, count(DISTINCT embedding) AS unique_count FROM embeddings""",
        "dataset_sections": " UNION ALL ".join(
            f"SELECT '{s}' AS section, '{c}' AS column_name, count({c}) AS count, count(*) - count({c}) AS missing_count "
            "FROM (SELECT *, o_totalprice > 200000 AS big FROM orders)"
            for c, s in {**orders, "big": "boolean"}.items()
        ),
        "column_report": f"SELECT *, 'numeric' AS section FROM ({_numeric('orders', ['o_totalprice'])})",
        "spearman": """WITH r AS (
            SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x,
              rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem),
            s AS (SELECT corr(x, y) AS rho, CAST(count(*) AS DOUBLE) AS n FROM r),
            q AS (SELECT rho, n, n - 2 AS v, abs(rho) * sqrt((n - 2) / ((1 - rho) * (1 + rho))) AS t FROM s)
            SELECT 'spearman' AS method, 'l_quantity' AS column_1, 'l_extendedprice' AS column_2,
              CAST(n AS BIGINT) AS n, round(rho, 6) AS statistic,
              round((SELECT 1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * sum(
                CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                * power(1 + power(i * t / 4000, 2) / v, -(v + 1) / 2)) * t / 4000 / 3
                FROM range(0, 4001) AS g(i)), 6) AS p_value FROM q""",
        "mann_whitney": f"""WITH base AS (SELECT l_linestatus AS g, l_extendedprice AS x FROM lineitem), {PAIR_TESTS}
            SELECT 'mann_whitney_u' AS method, 'l_extendedprice' AS numeric_column, 'l_linestatus' AS group_column,
              a AS group_1, b AS group_2, CAST(n1 AS BIGINT) AS group_1_n, CAST(n2 AS BIGINT) AS group_2_n,
              round(m1, 6) AS group_1_median, round(m2, 6) AS group_2_median, u AS statistic, round(p, 6) AS p_value,
              'normal' AS p_method, round(2 * u / n1 / n2 - 1, 6) AS rank_biserial FROM tested""",
        # All ways to place the five members of the small group among the ranks.
        "mann_whitney_exact": """WITH ranked AS (SELECT rank() OVER (ORDER BY n_nationkey) AS r, n_regionkey = 0 AS hit, n_nationkey FROM nation),
            s AS (SELECT count(*) FILTER (hit) AS n2, count(*) FILTER (NOT hit) AS n1, sum(r) FILTER (NOT hit) AS r1,
              median(n_nationkey) FILTER (NOT hit) AS m1, median(n_nationkey) FILTER (hit) AS m2 FROM ranked),
            u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM s),
            ways AS (SELECT a.r + b.r + c.r + d.r + e.r - 15 AS w FROM ranked a JOIN ranked b ON a.r < b.r
              JOIN ranked c ON b.r < c.r JOIN ranked d ON c.r < d.r JOIN ranked e ON d.r < e.r)
            SELECT 'mann_whitney_u' AS method, 'n_nationkey' AS numeric_column, 'first_region' AS group_column,
              'false' AS group_1, 'true' AS group_2, n1 AS group_1_n, n2 AS group_2_n, m1 AS group_1_median, m2 AS group_2_median,
              CAST(u AS DOUBLE) AS statistic,
              round(least(1.0, 2.0 * (SELECT count(*) FROM ways WHERE w >= greatest(u, n1 * n2 - u)) / (SELECT count(*) FROM ways)), 9) AS p_value,
              'exact' AS p_method, round(2.0 * u / (n1 * n2) - 1, 9) AS rank_biserial FROM u""",
        "crosstab": """SELECT a.v AS value_1, b.v AS value_2, count(l.l_returnflag) AS n
            FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_linestatus AS v FROM lineitem) b
            LEFT JOIN lineitem l ON l.l_returnflag = a.v AND l.l_linestatus = b.v GROUP BY 1, 2""",
        "chi_square_v": f"""WITH {_chi('o_orderstatus', 'o_orderpriority', 'orders')},
            s AS (SELECT sum((o - e) * (o - e) / e) AS x, any_value(t) AS n, min(e) AS low FROM grid)
            SELECT 'chi_square_cramers_v' AS method, 'o_orderstatus' AS column_1, 'o_orderpriority' AS column_2,
              CAST(n AS BIGINT) AS n, round(x, 6) AS chi_square,
              round(exp(-x / 2) * (1 + x / 2 + power(x / 2, 2) / 2 + power(x / 2, 3) / 6), 6) AS p_value,
              CAST(8 AS BIGINT) AS degrees_of_freedom, round(sqrt(x / n / 2), 6) AS cramers_v,
              round(low, 6) AS minimum_expected_count FROM s""",
        "binary_phi": f"""WITH {_chi('quality', 'toxic', 'labels')},
            s AS (SELECT sum(power(greatest(abs(o - e) - 0.5, 0), 2) / e) AS x, any_value(t) AS n, min(e) AS low FROM grid)
            SELECT 'chi_square_phi' AS method, 'quality' AS column_1, 'toxic' AS column_2, CAST(n AS BIGINT) AS n,
              round(x, 6) AS chi_square, round({NORMAL_P.format(z='sqrt(s.x)')}, 6) AS p_value,
              CAST(1 AS BIGINT) AS degrees_of_freedom, round(sqrt(x / n), 6) AS phi,
              round(low, 6) AS minimum_expected_count,
              CASE WHEN low < 5 THEN 'Some expected cell counts are below 5; an exact test may fit better.' END AS warning FROM s""",
        "kruskal": _kruskal("l_extendedprice", "l_returnflag", "lineitem", "exp(-h / 2)") + " FROM stat",
        "kruskal_groups": """SELECT l_returnflag AS group_name, count(*) AS n, round(median(l_extendedprice), 6) AS median
            FROM lineitem GROUP BY 1""",
        "posthoc_holm": _posthoc("SELECT lang AS g, CAST(n_chars AS DOUBLE) AS x FROM documents"),
        "kruskal_many_groups": _kruskal(
            "l_extendedprice", "slot", MANY_GROUPS,
            "exp(-h / 2) * (SELECT sum(power(h / 2, i) / gamma(i + 1)) FROM range(0, 10) AS t(i))",
        ) + " FROM stat",
        "kruskal_many_medians": f"""SELECT slot AS group_name, count(*) AS n, round(median(l_extendedprice), 6) AS median
            FROM {MANY_GROUPS} GROUP BY 1""",
        "posthoc_many_groups": _posthoc(f"SELECT slot AS g, l_extendedprice AS x FROM {MANY_GROUPS}"),
        "posthoc_corrections": _corrections(),
        "kruskal_gated": _kruskal("value", "event_type", "events", "exp(-h / 2) * (1 + h / 2)")
        + ", CAST(CASE WHEN exp(-h / 2) * (1 + h / 2) < 0.05 THEN k * (k - 1) / 2 ELSE 0 END AS BIGINT) AS comparisons FROM stat",
        "impute_scale_standard": _scaled("avg({})", "stddev_pop({})"),
        "impute_scale_robust": _scaled("median({})", "(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))"),
        "impute_scale_minmax": _scaled("min({})", "(max({0}) - min({0}))"),
        "impute_scale_none": _scaled("0 * count({})", "1 + 0 * count({})"),
        "one_hot": f"SELECT c_custkey, "
        + ", ".join(
            f"CAST(coalesce(c_mktsegment, {mode}) = '{s}' AS INTEGER) * 1.0::DOUBLE AS c_mktsegment_{s}" for s in segments
        )
        + f" FROM {GAPPY_CUSTOMER}",
        "removed_columns": f"""SELECT 'constant' AS column_name, 'removed' AS kept_as
            UNION ALL SELECT 'c_acctbal', 'feature' UNION ALL
            SELECT DISTINCT 'c_mktsegment_' || c_mktsegment, 'feature' FROM {GAPPY_CUSTOMER} WHERE c_mktsegment IS NOT NULL""",
        "cluster_indices": _cluster("sqrt(d2)", "euclidean"),
        "kmeans_fixed_centers": f"SELECT c_custkey, {_nearest(TWO_CENTERS)} AS cluster_of_2, {_nearest(THREE_CENTERS)} AS cluster_of_3 FROM customer",
        "kmeans_step": " UNION ALL ".join(
            f"""SELECT CAST({len(c)} AS INTEGER) AS k, {_nearest(c)} AS cluster, count(*) AS n,
              round(avg(CAST(c_acctbal AS DOUBLE)), 6) AS balance, round(avg(c_nationkey), 6) AS nation FROM customer GROUP BY ALL"""
            for c in (TWO_CENTERS, THREE_CENTERS)
        ),
        "fold_scaling_standard": _fold_scaled("avg(x)", "stddev_pop(x)"),
        "fold_scaling_robust": _fold_scaled("median(x)", "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)"),
        "fold_scaling_minmax": _fold_scaled("min(x)", "max(x) - min(x)"),
        "text_report_terms": " UNION ALL ".join(
            f"(SELECT CAST({n} AS INTEGER) AS size, ngram AS term, frequency FROM ({_ngrams(n)}))" for n in (1, 2, 3)
        ),
        "cluster_indices_squared": _cluster("d2", "squared_euclidean"),
        "label_sizes": "SELECT label, count(*) AS size FROM embeddings GROUP BY label",
        "corpus_stats": " UNION ALL ".join(_corpus(t) for t in ("documents", "conversations")),
        "word_freq": _ngrams(1, name="word"),
        "word_freq_all": _ngrams(1, "conversations", False, "word"),
        "bigrams": _ngrams(2),
        "trigrams": _ngrams(3),
        "tfidf_keywords": f"""WITH docs AS (SELECT doc_id, {_tokens()} AS w FROM documents WHERE {STRIPPED} <> ''),
            tf AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(w) AS term FROM docs) GROUP BY 1, 2),
            terms AS (SELECT term, sum(c) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 5000),
            n AS (SELECT count(*) AS n FROM docs),
            wt AS (SELECT doc_id, tf.term, c * (ln((1.0 + n) / (1 + df)) + 1) AS v FROM tf JOIN terms USING (term), n),
            norm AS (SELECT doc_id, sqrt(sum(v * v)) AS len FROM wt GROUP BY doc_id)
            SELECT term, round(sum(v / len) / any_value(n), 8) AS score FROM wt JOIN norm USING (doc_id), n
            GROUP BY term ORDER BY sum(v / len) DESC, term LIMIT 20""",
        "vocab_df_limits": f"""WITH docs AS (SELECT doc_id, {_tokens()} AS w FROM documents WHERE {STRIPPED} <> ''),
            tf AS (SELECT doc_id, unnest(w) AS term FROM docs)
            SELECT term, count(*) AS term_count, count(DISTINCT doc_id) AS document_frequency FROM tf GROUP BY term
            HAVING count(DISTINCT doc_id) BETWEEN 2 AND 0.95 * (SELECT count(*) FROM docs)
            ORDER BY term_count DESC, term LIMIT 5000""",
        "lda_mixtures": f"SELECT doc_id, 1.0::DOUBLE AS total FROM documents WHERE {STRIPPED} <> ''",
        "forest_held_out": """WITH c AS (SELECT quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality),
            s AS (SELECT quality, n, sum(n) OVER (ORDER BY quality) - n AS start FROM c),
            spots AS (SELECT quality, start, unnest(range(0, n)) AS i FROM s)
            SELECT quality, CAST((i + start) % 3 AS INTEGER) AS fold, count(*) AS n FROM spots GROUP BY 1, 2""",
        "network_scores": "SELECT c_custkey, 1.0::DOUBLE AS total, true AS known_class FROM customer",
        "detect_task": " UNION ALL ".join(
            [
                _detect("o_orderstatus", "orders", "classification", "false"),
                _detect("o_totalprice", "orders", "regression", "false"),
                _detect("l_linenumber", "lineitem", "classification", "true"),
                _detect("p_size", "part", "regression", "false"),
                _detect("quality", "labels", "classification", "true"),
            ]
        ),
        "fold_sizes_stratified": """WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
            s AS (SELECT quality, n, sum(n) OVER (ORDER BY quality) - n AS start FROM c),
            spots AS (SELECT quality, start, unnest(range(0, n)) AS i FROM s)
            SELECT quality, CAST((i + start) % 7 AS INTEGER) AS fold, count(*) AS n FROM spots GROUP BY 1, 2""",
        "fold_sizes": """SELECT CAST(f AS INTEGER) AS fold, n // 7 + CASE WHEN f < n % 7 THEN 1 ELSE 0 END AS n
            FROM (SELECT count(*) AS n FROM customer), range(0, 7) AS t(f)""",
        "class_weights": """SELECT o_orderstatus, n, round(sum(n) OVER () * 1.0 / (count(*) OVER () * n), 9) AS weight
            FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)""",
        "class_metrics": _class_metrics("SELECT quality AS t, toxic AS p FROM labels"),
        "reg_metrics": """SELECT round(1 - avg(m * m) / var_pop(y), 4) AS r2, round(avg(abs(m)), 4) AS mae,
            round(sqrt(avg(m * m)), 4) AS rmse FROM (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 2000 AS m FROM lineitem)""",
        "fold_summary": _fold_summary("stddev_samp"),
        "fold_summary_population": _fold_summary("stddev_pop"),
    }
