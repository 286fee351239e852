"""ANSI SQL with the same results as the registered queries."""

from __future__ import annotations

from metricloom.plans import inputs

ORACLE: dict[str, str] = {}


def _with(*names: str) -> str:
    """WITH clause of the named building blocks, in order."""
    return "WITH " + ",\n".join(f"{n} AS ({_PARTS[n]})" for n in names) + "\n"


def _values(rows: list[tuple]) -> str:
    def literal(v) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)


_NORMAL = (
    "regexp_replace(regexp_replace(regexp_replace(lower(sql), '^\\s+', ''), '\\s*;*\\s*$', ''), '\\s+', ' ', 'g')"
)
_TOKENS = (
    r"list_filter(regexp_extract_all(sql, '(?s)\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|''(?:[^'']|'''')*''|--[^\n]*|/\*.*?\*/|\w+|[^\s\w]'), "
    "lambda t: NOT starts_with(t, '--') AND NOT starts_with(t, '/*'))"
)
_AFTER = "CASE WHEN k[i + 2] = '.' THEN k[i + 3] ELSE k[i + 1] END"
_REFERENCED = (
    f"list_sort(list_distinct(list_filter(list_transform([{_TOKENS}], lambda k: list_transform(range(1, len(k)), "
    f"lambda i: CASE WHEN lower(k[i]) IN ('from', 'join') THEN lower(trim({_AFTER}, '\"`[]')) END))[1], "
    "lambda t: t IS NOT NULL)))"
)


def _snap(date: str) -> str:
    return (
        f"CASE WHEN length({date}) = 4 THEN {date} || '-01-01' WHEN length({date}) < 7 THEN {date} "
        f"WHEN granularity IN ('monthly', 'quarterly') THEN left({date}, 7) || '-01' "
        f"WHEN granularity = 'annual' THEN left({date}, 4) || '-01-01' ELSE {date} END"
    )


def _aligned(date: str) -> str:
    return (
        f"({date} = '' OR CASE WHEN granularity IN ('monthly', 'quarterly') THEN {date} LIKE '%-01' "
        f"WHEN granularity = 'annual' THEN {date} LIKE '%-01-01' ELSE TRUE END)"
    )


# Metric results from entry fields and statistics, rule by rule.
_RULES = f"""
SELECT *, CASE WHEN NOT shaped THEN 'FAIL' WHEN error = '' THEN 'PASS' ELSE 'WARN' END AS status
FROM (
  SELECT *, CASE WHEN sql_error <> '' THEN sql_error
    WHEN n_cols < 2 THEN 'Only ' || CAST(n_cols AS STRING) || ' column(s) returned; expected 2'
    WHEN total_rows = 0 THEN 'zero_rows'
    ELSE concat_ws(', ', CASE WHEN null_rate > 0.1 THEN 'high_nulls' END, CASE WHEN n_rows < 3 THEN 'sparse' END,
      CASE WHEN NOT date_range_ok THEN 'date_mismatch' END, CASE WHEN n_cols <> 2 THEN 'extra_cols' END,
      CASE WHEN NOT period_boundary_ok THEN 'period_boundary' END,
      CASE WHEN NOT date_col_ok THEN 'non_date_col' END,
      CASE WHEN n_rows > 1 AND value_min = value_max THEN 'constant_values' END) END AS error
  FROM (
    SELECT *,
      CASE WHEN analysed THEN (total_rows - valid_rows) / total_rows ELSE 0.0 END AS null_rate,
      CASE WHEN analysed THEN valid_rows ELSE total_rows END AS n_rows,
      analysed AND (declared_start = '' OR left(actual_start, 7) >= left(declared_start, 7))
        AND (declared_end = '' OR left(actual_end, 7) <= left(declared_end, 7)) AS date_range_ok,
      NOT analysed OR ({_aligned('declared_start')} AND {_aligned('declared_end')}) AS period_boundary_ok,
      NOT analysed OR bad_dates / total_rows <= 0.05 AS date_col_ok
    FROM (
      SELECT catalogue_id, pos, name, confidence, granularity, unit, declared_start, declared_end, n_cols,
        sql_error, sql_ok, total_rows, valid_rows, bad_dates, shaped, analysed,
        CASE WHEN analysed THEN v_min END AS value_min, CASE WHEN analysed THEN v_max END AS value_max,
        CASE WHEN analysed THEN coalesce(first_date, '') ELSE '' END AS actual_start,
        CASE WHEN analysed THEN coalesce(last_date, '') ELSE '' END AS actual_end
      FROM (
        SELECT *, sql_ok AND sql_error = '' AND n_cols >= 2 AS shaped,
          sql_ok AND sql_error = '' AND n_cols >= 2 AND total_rows > 0 AS analysed
        FROM measured
      )
    )
  )
)
"""

_PARTS = {
    "entries": inputs.CUSTOMER_METRICS,
    "series": inputs.CUSTOMER_SERIES,
    "facts": inputs.SUPPLIER_FACTS,
    "responses": inputs.JUDGE_RESPONSES,
    "log": inputs.QUERY_LOG,
    "proposals": inputs.PROPOSALS,
    "calls": inputs.CALL_LOG,
    "submissions": inputs.SUBMISSIONS,
    "connections": inputs.CONNECTIONS,
    "rejections": inputs.REJECTIONS,
    "mixed": inputs.MIXED_VALUES,
    "stats": """
SELECT pos, count(*) AS total_rows, count(value) AS valid_rows, min(value) AS v_min, max(value) AS v_max,
  strftime(min(period) FILTER (value IS NOT NULL), '%Y-%m-%d') AS first_date,
  strftime(max(period) FILTER (value IS NOT NULL), '%Y-%m-%d') AS last_date, 0 AS bad_dates
FROM series GROUP BY pos""",
    "measured": """
SELECT e.*, coalesce(total_rows, 0) AS total_rows, coalesce(valid_rows, 0) AS valid_rows, v_min, v_max,
  first_date, last_date, bad_dates FROM entries e LEFT JOIN stats USING (pos)""",
    "judged_rows": _RULES,
    "dups": f"""
SELECT * FROM (
  SELECT catalogue_id, pos, name, first_value(name) OVER w AS duplicate_of, row_number() OVER w AS rn
  FROM (SELECT *, {_NORMAL} AS norm FROM entries WHERE sql <> '')
  WINDOW w AS (PARTITION BY catalogue_id, norm ORDER BY pos)
) WHERE rn > 1""",
    "results": """
SELECT r.* EXCLUDE (error, status), coalesce(d.duplicate_of, '') AS duplicate_of,
  CASE WHEN d.duplicate_of IS NULL THEN r.error WHEN r.error = '' THEN 'duplicate_sql'
    ELSE r.error || ', duplicate_sql' END AS error,
  CASE WHEN d.duplicate_of IS NOT NULL AND r.status = 'PASS' THEN 'WARN' ELSE r.status END AS status
FROM judged_rows r LEFT JOIN dups d USING (catalogue_id, pos)""",
    "db": _values([(t,) for t in inputs.TABLES]),
    "fk": _values([(t, c[0], to, tc[0]) for t, c, to, tc in inputs.FOREIGN_KEYS]),
    "mentions": """
SELECT DISTINCT catalogue_id, table_name FROM (
  SELECT catalogue_id, unnest(string_split(tables_csv, ',')) AS table_name FROM entries
  UNION ALL SELECT catalogue_id, unnest(string_split(tables_csv, ',')) FROM facts)""",
    "cats": "SELECT DISTINCT catalogue_id, label, db_stem FROM entries",
    "counted": """
SELECT catalogue_id, count(*) AS n_metrics, count(*) FILTER (status = 'PASS') AS n_pass,
  count(*) FILTER (status = 'WARN') AS n_warn, count(*) FILTER (status = 'FAIL') AS n_fail,
  count(*) FILTER (duplicate_of <> '') AS n_duplicates,
  count(*) FILTER (error LIKE '%constant_values%') AS n_constants,
  count(*) FILTER (confidence = 'high') AS n_high, count(*) FILTER (sql_ok AND date_range_ok) AS n_date_ok,
  list_sort(list(n_rows) FILTER (sql_ok)) AS ns
FROM results GROUP BY catalogue_id""",
    "spans": """
SELECT catalogue_id, coalesce(avg(
  TRY_CAST(left(declared_end, 4) AS int) * 12 + TRY_CAST(substr(declared_end, 6, 2) AS int)
  - TRY_CAST(left(declared_start, 4) AS int) * 12 - TRY_CAST(substr(declared_start, 6, 2) AS int)), 0.0) AS span,
  count(*) FILTER (len(string_split(tables_csv, ',')) > 1) AS n_joins
FROM entries GROUP BY catalogue_id""",
    "scores": """
SELECT c.catalogue_id, c.label, c.db_stem, n_metrics, n_pass, n_warn, n_fail, n_duplicates, n_constants, n_joins,
  coalesce(n_facts, 0) AS n_facts, coalesce(n_facts_pass, 0) AS n_facts_pass, n_covered_tables,
  CAST(14 AS bigint) AS n_db_tables,
  round_even(n_pass / n_metrics, 4) AS pass_rate, round_even(n_covered_tables / 14, 4) AS coverage_rate,
  round_even((n_duplicates + n_constants) / n_metrics, 4) AS noise_ratio,
  round_even(n_high / n_metrics, 4) AS conf_rate, round_even(n_date_ok / n_metrics, 4) AS date_ok_rate,
  coalesce(CAST(ns[len(ns) // 2 + 1] AS double), 0.0) AS median_rows, round_even(span, 1) AS avg_span_months,
  n_pass / n_metrics * (n_covered_tables / 14) * (1 - (n_duplicates + n_constants) / n_metrics) * 100 + 0.0 AS raw
FROM cats c JOIN counted USING (catalogue_id) JOIN spans USING (catalogue_id)
LEFT JOIN (SELECT catalogue_id, count(*) AS n_facts, count(*) FILTER (status = 'PASS') AS n_facts_pass
  FROM facts GROUP BY catalogue_id) USING (catalogue_id)
JOIN (SELECT catalogue_id, count(*) AS n_covered_tables FROM mentions
  WHERE table_name IN (SELECT col0 FROM db) GROUP BY catalogue_id) USING (catalogue_id)""",
    "patched": f"""
SELECT *, CASE WHEN snap THEN {_snap('p_start')} ELSE p_start END AS new_start,
  CASE WHEN snap THEN {_snap('p_end')} ELSE p_end END AS new_end
FROM (
  SELECT *, CASE WHEN take THEN actual_start ELSE declared_start END AS p_start,
    CASE WHEN take THEN actual_end ELSE declared_end END AS p_end
  FROM (SELECT *, error LIKE '%date_mismatch%' AND actual_start <> '' AND actual_end <> '' AS take,
    error LIKE '%period_boundary%' AS snap FROM results WHERE status <> 'PASS')
)""",
    "patches": "SELECT * FROM patched WHERE new_start <> declared_start OR new_end <> declared_end",
    "issues": """
SELECT 'METRIC' AS kind, catalogue_id, pos, name, status, error, n_rows, value_min, value_max FROM results
WHERE status <> 'PASS' AND NOT (sql_ok AND error LIKE 'eval error:%')
  AND len(list_filter(string_split(error, ', '), lambda c: c NOT IN ('date_mismatch', 'period_boundary'))) > 0
UNION ALL
SELECT 'FACT', catalogue_id, pos, name, status, error, n_rows, NULL, NULL FROM facts WHERE status <> 'PASS'""",
    "actions": """
SELECT *, CASE WHEN action = 'remove' THEN 'Metric removed, no data: ' || name
  WHEN action = 'annotate' AND error LIKE '%constant_values%' THEN 'Same value in all ' || n_rows || ' rows.'
  WHEN action = 'annotate' THEN 'Only ' || n_rows || ' rows.' ELSE '' END AS note
FROM (
  SELECT r.catalogue_id, r.pos, r.name, r.error, r.n_rows, CASE WHEN error LIKE 'Only %' THEN 'move_to_facts'
    WHEN r.sql_ok AND error LIKE 'eval error:%' THEN 'keep' WHEN status = 'FAIL' THEN 'report'
    WHEN error LIKE '%zero_rows%' THEN 'remove'
    WHEN error LIKE '%extra_cols%' AND n_categories BETWEEN 1 AND 5 THEN 'split'
    WHEN error LIKE '%extra_cols%' THEN 'move_to_facts' WHEN error LIKE '%high_nulls%' THEN 'report'
    WHEN error LIKE '%sparse%' OR error LIKE '%constant_values%' THEN 'annotate' ELSE 'keep' END AS action
  FROM results r JOIN entries e USING (pos)
)""",
    "refined": """
SELECT catalogue_id, CASE WHEN action = 'split' THEN name || ' (A)' ELSE name END AS name
FROM actions WHERE action NOT IN ('remove', 'move_to_facts')""",
    "kept": """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY regexp_replace(sql, '^\\s+|\\s+$', '', 'g') ORDER BY run, pos) AS rn FROM log) WHERE rn = 1""",
    "priced": """
SELECT *, (input_tokens * p_in + output_tokens * p_out) / 1000000 + cache_write_tokens * p_write / 1000000
  + cache_read_tokens * p_read / 1000000 AS cost
FROM calls JOIN (VALUES
  ('vendor/alpha', 2.0::double, 8.0::double, 2.5::double, 0.2::double, FALSE), ('alpha-2', 1.0, 4.0, 1.5, 0.2, FALSE),
  ('beta', 6.0, 30.0, 7.5, 0.5, FALSE), ('acme/gamma-x', 0.25, 1.25, 0.4, 0.025, FALSE),
  ('delta', 3.0, 15.0, 3.75, 0.3, TRUE)) AS price(model, p_in, p_out, p_write, p_read, is_default) USING (model)""",
}

_RESULTS = ("entries", "series", "stats", "measured", "judged_rows", "dups", "results")

_KEYS = {**inputs.PRIMARY_KEYS, "lineitem": ["l_orderkey", "l_linenumber"]}

_COLUMNS = {
    "region": "r_regionkey, r_name",
    "nation": "n_nationkey, n_name, n_regionkey",
    "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment",
    "supplier": "s_suppkey, s_name, s_nationkey, s_acctbal",
    "part": "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice",
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
    "l_tax, l_returnflag, l_linestatus, l_shipdate",
    "events": "event_id, ts, user_id, event_type, value, props",
    "documents": "doc_id, text, lang, source, n_chars",
    "embeddings": "vec_id, embedding, label",
    "pages": "page_id, url, html",
    "benchmark": "item_id, text",
    "labels": "doc_id, quality, toxic",
    "conversations": "conv_id, turn, role, text",
}


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# --- Profiles ---------------------------------------------------------------

ORACLE["profile_table_counts"] = _union(
    [
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST({c.count(',') + 1} AS bigint) AS n_cols FROM {t}"
        for t, c in _COLUMNS.items()
    ]
)

_NUMERIC = {
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax",
    "orders": "o_orderkey o_custkey o_totalprice",
    "customer": "c_custkey c_nationkey c_acctbal",
    "region": "r_regionkey",
    "nation": "n_nationkey n_regionkey",
    "supplier": "s_suppkey s_nationkey s_acctbal",
    "part": "p_partkey p_size p_retailprice",
    "events": "event_id user_id value",
    "documents": "doc_id n_chars",
    "embeddings": "vec_id label",
    "pages": "page_id",
    "benchmark": "item_id",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn",
}
ORACLE["profile_numeric_stats"] = _union(
    [
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS n_null, "
        f"round(CAST(min({c}) AS double), 4) + 0.0 AS min_value, round(CAST(max({c}) AS double), 4) AS max_value FROM {t}"
        for t, cols in _NUMERIC.items()
        for c in cols.split()
    ]
)
ORACLE["profile_date_stats"] = _union(
    [
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS n_null, "
        f"strftime(min({c}), '%Y-%m-%d') AS first_day, strftime(max({c}), '%Y-%m-%d') AS last_day FROM {t}"
        for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("events", "ts"))
    ]
)

_CATEGORICAL = {
    "region": "r_name",
    "nation": "n_name",
    "customer": "c_name c_mktsegment",
    "supplier": "s_name",
    "part": "p_name p_brand p_type",
    "orders": "o_orderstatus o_orderpriority",
    "lineitem": "l_returnflag l_linestatus",
    "events": "event_type props",
    "documents": "text lang source",
    "pages": "url html",
    "benchmark": "text",
    "conversations": "role text",
}
ORACLE["profile_distinct"] = _union(
    [
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM {t}"
        for t, cols in _CATEGORICAL.items()
        for c in cols.split()
    ]
)
ORACLE["profile_distinct_sketch"] = _union(
    [
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
        f"TRUE AS same_at_once, TRUE AS within_error FROM {t}"
        for t, cols in _CATEGORICAL.items()
        for c in cols.split()
    ]
)


def _top(table: str, column: str, k: int = 8) -> str:
    return f"""
SELECT '{table}' AS table_name, '{column}' AS column_name, rn - 1 AS rank, value, cnt FROM (
  SELECT {column} AS value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, {column}) AS rn
  FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}) WHERE rn <= {k}"""


ORACLE["profile_top_values"] = _union(
    [
        _top(t, c)
        for t, cols in _CATEGORICAL.items()
        for c in cols.split()
    ]
)


def _line(table: str, ordinal: int, column: str, kind: str) -> str:
    key = ", key" if column in inputs.PRIMARY_KEYS.get(table, []) else ""
    shown = []
    if column in _CATEGORICAL.get(table, "").split():
        shown = [
            f"(SELECT count(DISTINCT {column}) FROM {table}) || ' values'",
            f"(SELECT string_agg(cnt || ' x ' || value, '; ' ORDER BY rank) FROM ({_top(table, column, 5)}))",
        ]
    elif kind != "array<float>":
        bound = "CAST({0}({1}) AS STRING)" if "timestamp" in kind else "CAST({0}({1}) + 0 AS STRING)"
        shown = [f"{bound.format('min', column)} || ' to ' || {bound.format('max', column)}"]
    detail = " || ' | ' || ".join([*shown, f"(count(*) - count({column})) || ' null'"])
    return (
        f"SELECT '{table}' AS table_name, CAST({ordinal} AS bigint) AS ordinal, '{column} ({kind}{key}): ' || "
        f"{detail} AS line FROM {table}"
    )


# Types that are no bigint for numbers, and no text for the rest.
_KINDS = dict.fromkeys(
    "r_regionkey n_nationkey n_regionkey c_nationkey s_nationkey p_size l_linenumber label quality toxic".split(), "int"
) | dict.fromkeys(
    "c_acctbal s_acctbal p_retailprice o_totalprice l_quantity l_extendedprice l_discount l_tax value".split(), "double"
) | {"o_orderdate": "timestamp_ntz", "l_shipdate": "timestamp_ntz", "ts": "timestamp_ntz", "embedding": "array<float>"}
_SHOWN = [
    (t, i, c, _KINDS.get(c, "string" if c in _CATEGORICAL.get(t, "").split() else "bigint"))
    for t, names in _COLUMNS.items()
    for i, c in enumerate(names.split(", "))
]
ORACLE["column_lines"] = _union([_line(*row) for row in _SHOWN])

ORACLE["snapshot_text"] = (
    "WITH n AS (" + ORACLE["profile_table_counts"] + "), c AS (" + ORACLE["column_lines"] + ") "
    "SELECT table_name, 0 AS section, CAST(0 AS bigint) AS pos, '# ' || table_name || ', ' || n_rows || ' rows' AS line FROM n "
    "UNION ALL SELECT table_name, 1, ordinal, line FROM c UNION ALL "
    + _union(
        [
            f"SELECT '{a}', 2, CAST(0 AS bigint), '{', '.join(x)} refers to {b} by {', '.join(y)}'"
            for a, x, b, y in inputs.FOREIGN_KEYS
        ]
    )
)
ORACLE["value_counts"] = (
    "WITH v AS ("
    + _union(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS value, count(*) AS cnt FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
            for t, cols in _CATEGORICAL.items()
            for c in cols.split()
        ]
    )
    + ") SELECT * FROM v QUALIFY count(*) OVER (PARTITION BY table_name, column_name) <= 20"
)
ORACLE["schema_lines"] = _union(
    [
        f"SELECT '{t}' AS table_name, '{t}({c})' AS line, count(*) AS n_rows FROM {t}"
        for t, c in _COLUMNS.items()
    ]
)
ORACLE["sample_rows"] = _union(
    [
        f"SELECT '{t}' AS table_name, least(5, count(*)) AS n_sampled, count(*) AS n_rows FROM {t}"
        for t in inputs.TABLES
    ]
)

ORACLE["sample_contents"] = _union(
    [
        f"SELECT '{t}' AS table_name, CAST(pos AS int) AS pos, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM ("
        f"SELECT row_number() OVER (ORDER BY {', '.join(inputs.PRIMARY_KEYS[t])}) - 1 AS pos, * FROM {t}) AS x WHERE pos < 5"
        for t, columns in inputs.SAMPLED.items()
        for c in columns
    ]
)

_NUMBERS = {
    "region": "r_regionkey",
    "nation": "n_nationkey n_regionkey",
    "customer": "c_custkey c_nationkey",
    "supplier": "s_suppkey s_nationkey",
    "part": "p_partkey p_size",
    "orders": "o_orderkey o_custkey",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber",
    "events": "event_id user_id",
    "documents": "doc_id n_chars",
    "embeddings": "vec_id label",
    "pages": "page_id",
    "benchmark": "item_id",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn",
}
_NUMBERS = {t: columns.split() for t, columns in _NUMBERS.items()}
_SINGLES = [
    (t, c) for t in inputs.TABLES for c in (*_NUMBERS[t], *_CATEGORICAL.get(t, "").split())
]
_STEMS = {c: c.split("_", 1)[1] if c.index("_") <= 2 else c for cs in _NUMBERS.values() for c in cs if "_" in c}
_LINKS = [
    (a, x, b, y)
    for a, xs in _NUMBERS.items()
    for x in xs
    for b, ys in _NUMBERS.items()
    for y in ys
    if a != b and _STEMS.get(x, x) == _STEMS.get(y, y)
]


def _is_key(table: str, *columns: str) -> str:
    full = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return (
        f"(SELECT count(*) > 0 AND count(*) = count(*) FILTER (WHERE {full}) "
        f"AND count(*) = count(DISTINCT ({', '.join(columns)})) FROM {table})"
    )


ORACLE["inferred_keys"] = (
    "WITH s AS ("
    + _union([f"SELECT '{t}' AS table_name, '{c}' AS column_names WHERE {_is_key(t, c)}" for t, c in _SINGLES])
    + "), p AS ("
    + _union(
        [
            f"SELECT '{t}' AS table_name, '{a},{b}' AS column_names WHERE {_is_key(t, a, b)}"
            for t, cs in _NUMBERS.items()
            for i, a in enumerate(cs)
            for b in cs[i + 1 :]
        ]
    )
    + "), l AS ("
    + _union(
        [
            f"SELECT '{a}' AS table_name, '{x}' AS column_names, '{b}' AS to_table, '{y}' AS to_column "
            f"WHERE EXISTS (SELECT 1 FROM s WHERE table_name = '{b}' AND column_names = '{y}') AND NOT EXISTS "
            f"(SELECT {x} FROM {a} WHERE {x} IS NOT NULL EXCEPT SELECT {y} FROM {b}) AND EXISTS (SELECT 1 FROM {a} WHERE {x} IS NOT NULL)"
            for a, x, b, y in _LINKS
        ]
    )
    + ") SELECT *, '' AS to_table, '' AS to_column FROM s UNION ALL "
    "SELECT *, '', '' FROM p WHERE table_name NOT IN (SELECT table_name FROM s WHERE column_names IN ("
    + ", ".join(f"'{c}'" for c in sorted({c for cs in _NUMBERS.values() for c in cs}))
    + ")) UNION ALL SELECT * FROM l"
)

_TEMPORAL = ("orders", "lineitem", "events")
ORACLE["table_classes"] = _union(
    [
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, {t in _TEMPORAL} AS is_temporal, FALSE AS is_junction, "
        f"{t not in _TEMPORAL} AS is_lookup, {t in _TEMPORAL} AS is_required FROM {t}"
        for t in inputs.TABLES
    ]
)

_TEXT_COLUMNS = [
    ("region", 1, "r_name"), ("nation", 1, "n_name"), ("customer", 1, "c_name"), ("customer", 4, "c_mktsegment"),
    ("supplier", 1, "s_name"), ("part", 1, "p_name"), ("part", 2, "p_brand"), ("part", 3, "p_type"),
    ("orders", 2, "o_orderstatus"), ("orders", 5, "o_orderpriority"), ("lineitem", 8, "l_returnflag"),
    ("lineitem", 9, "l_linestatus"), ("events", 3, "event_type"), ("events", 5, "props"),
    ("documents", 1, "text"), ("documents", 2, "lang"), ("documents", 3, "source"), ("pages", 1, "url"),
    ("pages", 2, "html"), ("benchmark", 1, "text"), ("conversations", 2, "role"), ("conversations", 3, "text"),
]
_FK_COLUMNS = [(t, c[0], to) for t, c, to, _ in inputs.FOREIGN_KEYS if t != "labels"]
ORACLE["dimension_manifest"] = (
    "WITH dims AS ("
    + _union(
        [
            f"SELECT '{t}' AS table_name, {i} AS ordinal, '{c}' AS column_name, (SELECT count(DISTINCT {c}) FROM {t}) "
            f"AS n_distinct, (SELECT count(*) FROM {t}) AS n_rows, (SELECT string_agg(value, ',' ORDER BY value) "
            f"FROM ({_top(t, c, 20)})) AS \"values\""
            for t, i, c in _TEXT_COLUMNS
        ]
    )
    + f"""),
few AS (SELECT * FROM dims WHERE n_distinct BETWEEN 2 AND 20),
labels_of AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY ordinal) AS rn
  FROM few WHERE n_rows <= 200) WHERE rn = 1),
links AS ({_values(_FK_COLUMNS)})
SELECT table_name, column_name, '' AS via, "values" FROM few
WHERE NOT regexp_matches("values", '(^|,)[{{\\[]')
UNION ALL
SELECT k.col0, k.col1, k.col2, l."values" FROM links k JOIN labels_of l ON l.table_name = k.col2"""
)

ORACLE["time_coverage"] = """
SELECT strftime(min(a), '%Y-%m-%d') AS first_day, strftime(max(b), '%Y-%m-%d') AS last_day FROM (
  SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders
  UNION ALL SELECT min(l_shipdate), max(l_shipdate) FROM lineitem
  UNION ALL SELECT min(ts), max(ts) FROM events)"""

ORACLE["null_and_size_notes"] = (
    """
WITH n AS (SELECT 'o_totalprice' AS c, count(*) FILTER (o_orderkey % 4 = 0) AS nulls, count(*) AS total FROM orders
  UNION ALL SELECT 'o_custkey', count(*) FILTER (o_orderkey % 10 = 0), count(*) FROM orders
  UNION ALL SELECT 'o_orderpriority', count(*) FILTER (o_orderkey % 3 = 0), count(*) FROM orders)
SELECT 'orders' AS table_name, 'Column ' || c || ': '
  || CAST(CAST(round_even(nulls / total * 100, 0) AS bigint) AS STRING) || '% empty (' || nulls || ' rows)' AS note
FROM n WHERE nulls / total >= 0.2
UNION ALL
SELECT * FROM (SELECT table_name, 'Table ' || table_name || ': only ' || n_rows
  || ' rows, too few for firm conclusions' AS note FROM ("""
    + ORACLE["profile_table_counts"]
    + ") WHERE n_rows < 100 AND n_rows > 0)"
)

ORACLE["key_check"] = _union(
    [
        f"SELECT '{t}' AS table_name, '{','.join(k)}' AS key_columns, count(*) AS n_rows, "
        f"count(DISTINCT ({', '.join(k)})) AS n_distinct, CAST(0 AS bigint) AS n_null_keys, "
        f"count(*) = count(DISTINCT ({', '.join(k)})) AS is_key FROM {t}"
        for t, k in _KEYS.items()
    ]
)
ORACLE["fk_orphans"] = _union(
    [
        f"SELECT '{t}' AS from_table, '{c[0]}' AS from_cols, '{to}' AS to_table, count(*) AS orphan_rows, "
        f"count(DISTINCT {c[0]}) AS orphan_keys FROM {t} WHERE {c[0]} NOT IN (SELECT {tc[0]} FROM {to})"
        for t, c, to, tc in inputs.FOREIGN_KEYS
    ]
    + [
        "SELECT 'lineitem', 'l_orderkey', 'urgent_orders', count(*), count(DISTINCT l_orderkey) FROM lineitem "
        "WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"
    ]
)

# --- Metrics and facts ------------------------------------------------------


def _by_period(unit: str, fmt: str, ts: str, value: str, source: str) -> str:
    return (
        f"SELECT strftime(date_trunc('{unit}', {ts}), '{fmt}') AS date, {value} AS value FROM {source} GROUP BY 1"
    )


ORACLE["metric_count_monthly"] = _by_period("month", "%Y-%m", "o_orderdate", "count(*)", "orders")
ORACLE["metric_sum_quarterly"] = _by_period(
    "quarter", "%Y-%m", "l_shipdate", "round(sum(l_extendedprice * (1 - l_discount)), 2)", "lineitem"
)
ORACLE["metric_avg_weekly"] = _by_period("week", "%Y-%m-%d", "ts", "round(avg(value), 6)", "events")
ORACLE["metric_count_daily"] = _by_period(
    "day", "%Y-%m-%d", "ts", "count(*)", "events WHERE event_type = 'purchase'"
)
ORACLE["metric_sum_annual"] = _by_period(
    "year", "%Y-%m", "o_orderdate", "round(sum(o_totalprice), 2)", "orders"
)
ORACLE["metric_tick"] = "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS date, value FROM events"
ORACLE["metric_rate"] = _by_period(
    "month", "%Y-%m", "l_shipdate", "round(count(*) FILTER (l_returnflag = 'R') / count(*), 8)", "lineitem"
)
ORACLE["metric_rate_base"] = _by_period(
    "day",
    "%Y-%m-%d",
    "ts",
    "round(count(*) FILTER (event_type = 'error') / nullif(count(*) FILTER (event_type IN "
    "('error', 'purchase', 'click')), 0), 8)",
    "events",
)
ORACLE["metric_cumulative"] = """
SELECT strftime(p, '%Y-%m') AS date, CAST(sum(n) OVER (ORDER BY p) AS bigint) AS value
FROM (SELECT date_trunc('month', o_orderdate) AS p, count(*) AS n FROM orders GROUP BY 1)"""
ORACLE["metric_cumulative_customers"] = """
SELECT strftime(p, '%Y-%m') AS date, CAST(sum(n) OVER (ORDER BY p) AS bigint) AS value
FROM (SELECT date_trunc('quarter', f) AS p, count(*) AS n
  FROM (SELECT min(o_orderdate) AS f FROM orders GROUP BY o_custkey) GROUP BY 1)"""
ORACLE["metric_dimension_split"] = """
SELECT 'New Orders (' || o_orderpriority || ')' AS name, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS date,
  count(*) AS value FROM orders GROUP BY 1, 2"""
ORACLE["metric_cross_table"] = """
SELECT r_name, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS date, round(sum(l_quantity), 2) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""
ORACLE["metric_cross_table_child_date"] = """
SELECT s_nationkey, strftime(date_trunc('year', l_shipdate), '%Y-%m') AS date, count(*) AS value
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""
ORACLE["fact_lookup"] = "SELECT DISTINCT p_brand, p_type FROM part"
ORACLE["fact_snapshot"] = """
SELECT count(*) AS n_orders, count(*) FILTER (o_orderstatus = 'O') AS n_open, round(sum(o_totalprice), 2) AS total
FROM orders"""
ORACLE["fact_breakdown"] = """
SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m') AS period, l_returnflag, l_linestatus, count(*) AS n,
  round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2, 3"""

# --- Evaluation -------------------------------------------------------------


def _code(name, source, start, end, gran, cols=2, date="d", value="v", bad="0", order="d", dup="") -> str:
    """Statistics row of one entry over its ordered rows (d, v)."""
    return f"""
SELECT 'codes' AS catalogue_id, 0 AS pos, '{name}' AS name, 'high' AS confidence, '{gran}' AS granularity,
  'count' AS unit, '{start}' AS declared_start, '{end}' AS declared_end, CAST({cols} AS bigint) AS n_cols,
  '' AS sql_error, TRUE AS sql_ok, count(*) AS total_rows, count({value}) AS valid_rows,
  CAST(min({value}) AS double) AS v_min, CAST(max({value}) AS double) AS v_max,
  first({date} ORDER BY {order}) FILTER ({value} IS NOT NULL) AS first_date,
  last({date} ORDER BY {order}) FILTER ({value} IS NOT NULL) AS last_date, {bad} AS bad_dates, '{dup}' AS dup
FROM ({source})"""


def _code_failure(name: str, ok: bool, error: str, cols: int, rows: str = "0") -> str:
    return f"""
SELECT 'codes', 0, '{name}', 'high', 'monthly', 'count', '', '', CAST({cols} AS bigint), '{error}', {ok}, {rows},
  0, NULL, NULL, NULL, NULL, 0, ''"""


_M = "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS d, count(*) AS v FROM orders"
_D = "strftime(ts, '%Y-%m-%d')"
_CODES = _union(
    [
        _code("pass", f"{_M} GROUP BY 1", "1990-01-01", "2010-12-01", "monthly"),
        _code_failure("blank", False, "No SQL in catalogue entry", 0),
        _code_failure("bad_sql", False, "sql_error", 0),
        _code_failure("runtime_error", False, "sql_error", 0),
        _code_failure("one_column", True, "", 1, "1"),
        _code("zero_rows", f"{_M} WHERE o_totalprice < 0 GROUP BY 1", "", "", "monthly"),
        _code(
            "sparse",
            "SELECT strftime(date_trunc('year', l_shipdate), '%Y-%m-%d') AS d, sum(l_quantity) AS v FROM lineitem "
            "WHERE l_shipdate < DATE '1997-01-01' GROUP BY 1",
            "1990-01-01", "2010-01-01", "annual",
        ),
        _code(
            "high_nulls",
            "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS d, CASE WHEN max(o_orderkey) % 4 = 0 "
            "THEN NULL ELSE sum(o_totalprice) END AS v FROM orders GROUP BY 1",
            "", "", "monthly",
        ),
        _code(
            "extra_cols",
            "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS d, NULL AS v, o_orderpriority "
            "FROM orders GROUP BY 1, 3",
            "", "", "monthly", 3,
        ),
        _code("three_numbers", f"SELECT {_D} AS d, count(*) AS v FROM events GROUP BY 1",
              "2023-12-01", "2024-12-01", "daily", 3),
        _code("constant", f"SELECT {_D} AS d, count(DISTINCT event_type) AS v FROM events GROUP BY 1",
              "", "", "daily"),
        _code("bad_dates", "SELECT left(p_brand, 10) AS d, count(*) AS v, p_brand FROM part GROUP BY p_brand",
              "", "", "monthly", 2, bad="count(*)", order="p_brand"),
        _code("date_mismatch", f"{_M} GROUP BY 1", "1996-01-01", "1999-12-01", "monthly", dup="pass"),
        _code("descending", f"{_M} GROUP BY 1", "1994-01-01", "1996-01-01", "monthly", order="d DESC"),
        _code("period_boundary", f"{_M} GROUP BY 1", "1990-01-15", "2010-12-31", "monthly", dup="pass"),
        _code("duplicate", f"{_M} GROUP BY 1", "1990-01-01", "2010-12-01", "monthly", dup="pass"),
        _code("tick", "SELECT strftime(l_shipdate, '%Y-%m-%d') AS d, l_extendedprice AS v FROM lineitem",
              "1990-01-01", "2010-12-31", "tick"),
    ]
)
ORACLE["eval_metrics"] = f"""
WITH coded AS ({_CODES}), measured AS (SELECT * FROM coded), ruled AS ({_RULES})
SELECT r.name, r.sql_ok, CASE WHEN dup = '' THEN error WHEN error = '' THEN 'duplicate_sql'
    ELSE error || ', duplicate_sql' END AS error, r.n_cols, n_rows, round(null_rate, 4) AS null_rate,
  round(value_min, 4) AS value_min, round(value_max, 4) AS value_max, actual_start, actual_end, date_range_ok,
  period_boundary_ok, date_col_ok, dup AS duplicate_of,
  CASE WHEN dup <> '' AND status = 'PASS' THEN 'WARN' ELSE status END AS status
FROM ruled r JOIN coded c USING (name)"""

ORACLE["eval_facts"] = """
SELECT 'lookup' AS name, TRUE AS sql_ok, '' AS error, CAST(2 AS bigint) AS n_cols, count(*) AS n_rows, 'PASS' AS status
FROM (SELECT DISTINCT p_brand, p_type FROM part)
UNION ALL SELECT 'snapshot', TRUE, '', 1, 1, 'PASS' FROM lineitem HAVING count(*) > 0
UNION ALL SELECT 'empty', TRUE, 'zero_rows', 6, count(*), 'WARN' FROM events WHERE event_type = 'none'
UNION ALL SELECT 'blank', FALSE, 'No SQL in catalogue entry', 0, 0, 'FAIL'
UNION ALL SELECT 'bad', FALSE, 'sql_error', 0, 0, 'FAIL'"""

ORACLE["eval_family"] = _with(*_RESULTS) + """
SELECT catalogue_id, pos, name, sql_ok, error, n_cols, n_rows, round(null_rate, 6) AS null_rate, value_min, value_max,
  actual_start, actual_end, date_range_ok, period_boundary_ok, date_col_ok, duplicate_of, status FROM results"""

ORACLE["eval_proposed_facts"] = _union(
    [
        f"SELECT '{t.title()} Snapshot' AS name, TRUE AS sql_ok, '' AS error, CAST(1 AS bigint) AS n_cols, "
        f"CAST(count(*) > 0 AS bigint) AS n_rows, 'PASS' AS status FROM {t}"
        if t in _TEMPORAL
        else f"SELECT '{t.title()} Lookup' AS name, TRUE AS sql_ok, '' AS error, "
        f"CAST({_COLUMNS[t].count(',') + 1} AS bigint) AS n_cols, count(*) AS n_rows, 'PASS' AS status "
        f"FROM (SELECT DISTINCT * FROM {t})"
        for t in inputs.TABLES
    ]
)


def _proposed() -> str:
    """One line per proposed metric: months with a value, and the resulting codes."""

    def line(name: str, ts: str, source: str) -> str:
        return (
            f"SELECT '{name}' AS name, count(DISTINCT date_trunc('month', {ts})) AS n_rows FROM {source}"
        )

    lines = []
    measures = {
        "orders": ("o_orderdate", ["o_totalprice"]),
        "lineitem": (
            "l_shipdate", ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        ),
        "events": ("ts", ["user_id", "value"]),
    }
    dims = {
        "orders": ["o_orderstatus", "o_orderpriority"],
        "lineitem": ["l_returnflag", "l_linestatus"],
        "events": ["event_type"],
    }
    for t, (ts, columns) in measures.items():
        lines.append(line(t.title(), ts, t))
        for c in columns:
            label = c.replace("_", " ").title()
            lines += [line(f"Total {label}", ts, t), line(f"Average {label}", ts, t)]
        for c in dims[t]:
            lines.append(
                f"SELECT '{t.title()} (' || {c} || ')', count(DISTINCT date_trunc('month', {ts})) FROM {t} GROUP BY {c}"
            )
    for t, c, to, _ in inputs.FOREIGN_KEYS:
        if t in measures:
            lines.append(line(f"{t.title()} Per {to.title()} Rate", measures[t][0], t))
    return _union(lines)


ORACLE["eval_proposal"] = f"""
SELECT name, TRUE AS sql_ok, CASE WHEN n_rows < 3 THEN 'sparse' ELSE '' END AS error, n_rows,
  CASE WHEN n_rows < 3 THEN 'WARN' ELSE 'PASS' END AS status FROM ({_proposed()})"""

ORACLE["duplicate_sql"] = _with("entries", "dups") + "SELECT catalogue_id, pos, name, duplicate_of FROM dups"
ORACLE["warning_codes"] = _with(*_RESULTS) + """
SELECT catalogue_id, code, count(*) AS n_results FROM (
  SELECT catalogue_id, unnest(string_split(error, ', ')) AS code FROM results WHERE status = 'WARN' AND error <> '')
GROUP BY 1, 2"""

_UNCOVERED = """
SELECT catalogue_id, col0 AS table_name FROM (SELECT DISTINCT catalogue_id FROM entries), db
WHERE (catalogue_id, col0) NOT IN (SELECT (catalogue_id, table_name) FROM mentions)"""
ORACLE["eval_report"] = _with(*_RESULTS, "facts", "db", "mentions") + f"""
SELECT catalogue_id, coalesce(mt, 0) AS metrics_total, coalesce(mp, 0) AS metrics_pass, coalesce(mw, 0) AS metrics_warn,
  coalesce(mf, 0) AS metrics_fail, coalesce(ft, 0) AS facts_total, coalesce(fp, 0) AS facts_pass,
  coalesce(fw, 0) AS facts_warn, coalesce(ff, 0) AS facts_fail, coalesce(u, '') AS uncovered_tables
FROM (SELECT catalogue_id, count(*) AS mt, count(*) FILTER (status = 'PASS') AS mp,
  count(*) FILTER (status = 'WARN') AS mw, count(*) FILTER (status = 'FAIL') AS mf FROM results GROUP BY 1)
FULL JOIN (SELECT catalogue_id, count(*) AS ft, count(*) FILTER (status = 'PASS') AS fp,
  count(*) FILTER (status = 'WARN') AS fw, count(*) FILTER (status = 'FAIL') AS ff FROM facts GROUP BY 1)
  USING (catalogue_id)
LEFT JOIN (SELECT catalogue_id, string_agg(table_name, ',' ORDER BY table_name) AS u FROM ({_UNCOVERED}) GROUP BY 1)
  USING (catalogue_id)"""

ORACLE["coerced_values"] = _with("mixed") + """
SELECT event_id, CASE event_id % 9 WHEN 0 THEN CAST(number_text AS double) WHEN 1 THEN CAST(event_id AS double)
    WHEN 4 THEN 1000.0 WHEN 7 THEN -0.5 END AS value,
  event_id % 9 NOT IN (6, 8) AS is_date FROM mixed"""

# --- SQL text, coverage -----------------------------------------------------

ORACLE["tables_referenced"] = _with("entries") + f"""
SELECT pos, coalesce(array_to_string({_REFERENCED}, ','), '') AS tables FROM entries"""
ORACLE["ghost_tables"] = _with("entries") + f"""
SELECT catalogue_id, name, array_to_string(list_sort(g), ',') AS ghosts FROM (
  SELECT catalogue_id, name, list_filter(string_split(lower(tables_csv), ','),
    lambda t: NOT list_contains({_REFERENCED}, t)) AS g FROM entries) WHERE len(g) > 0"""
ORACLE["sql_lint"] = _with("entries") + f"""
SELECT pos, pos % 8 NOT IN (6, 7) AS is_select,
  regexp_replace(regexp_replace(sql, '^\\s+', ''), '\\s*;*\\s*$', '') AS stored_sql, {_NORMAL} AS normal_sql
FROM entries"""
ORACLE["fk_coverage"] = _with("entries", "fk") + f"""
SELECT c.catalogue_id, lower(f.col0) AS from_table, lower(f.col2) AS to_table
FROM (SELECT DISTINCT catalogue_id FROM entries) c, (SELECT DISTINCT col0, col2 FROM fk
  WHERE col0 NOT IN ('region', 'part') AND col2 NOT IN ('region', 'part') AND NOT (col0 = 'customer' AND col2 = 'nation')) f
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT catalogue_id, {_REFERENCED} AS t FROM entries) e
  WHERE e.catalogue_id = c.catalogue_id AND list_contains(t, f.col0) AND list_contains(t, f.col2))"""
ORACLE["fk_waivers"] = _with("rejections") + """
SELECT least(lower(table_a), lower(table_b)) || ',' || greatest(lower(table_a), lower(table_b)) AS pair,
  count(*) AS n_rejections, count(*) >= 2 AS waived FROM rejections GROUP BY 1"""
ORACLE["table_coverage"] = _with("entries", "facts", "db", "mentions") + _UNCOVERED
ORACLE["covered_tables"] = _with("entries", "facts", "db", "mentions") + """
SELECT catalogue_id, count(*) AS n_covered_tables FROM mentions WHERE table_name IN (SELECT col0 FROM db) GROUP BY 1"""
ORACLE["required_coverage"] = _with("entries") + """
SELECT catalogue_id, t AS table_name FROM (SELECT DISTINCT catalogue_id FROM entries),
  (VALUES ('orders'), ('lineitem'), ('events')) AS r(t)
WHERE (catalogue_id, t) NOT IN (
  SELECT (catalogue_id, u) FROM (SELECT catalogue_id, unnest(string_split(lower(tables_csv), ',')) AS u FROM entries))"""

# --- Refinement -------------------------------------------------------------

ORACLE["snap_periods"] = _with("entries") + f"""
SELECT pos, {_snap('declared_start')} AS snapped_start, {_snap('declared_end')} AS snapped_end FROM entries"""
ORACLE["patched_ranges"] = _with(*_RESULTS, "patched", "patches") + "SELECT pos, new_start, new_end FROM patches"
ORACLE["patched_catalogue"] = (
    _with(*_RESULTS, "patched", "patches")
    + f""", fixed AS (
  SELECT m.* EXCLUDE (declared_start, declared_end), coalesce(new_start, m.declared_start) AS declared_start,
    coalesce(new_end, m.declared_end) AS declared_end
  FROM measured m LEFT JOIN (SELECT pos, new_start, new_end FROM patches) USING (pos)),
again AS ({_RULES.replace('FROM measured', 'FROM fixed')})
SELECT pos, declared_start, declared_end, error, status FROM again"""
)
ORACLE["issue_routing"] = _with(*_RESULTS, "facts", "issues") + """
SELECT kind, catalogue_id, pos, name, status, error FROM issues"""
ORACLE["issue_details"] = _with(*_RESULTS, "facts", "issues") + """
SELECT kind, pos, name, CASE WHEN n_rows = 0 THEN '0 rows returned'
  WHEN value_min = value_max THEN n_rows || ' row(s), all values = ' || CAST(value_min AS STRING)
  ELSE n_rows || ' row(s) returned' END AS detail FROM issues"""
ORACLE["refine_actions"] = _with(*_RESULTS, "actions") + "SELECT pos, name, action, note FROM actions"
_DIFF = """
SELECT catalogue_id, name, 'removed' AS change FROM (SELECT catalogue_id, name FROM entries EXCEPT
  SELECT catalogue_id, name FROM refined)
UNION ALL
SELECT catalogue_id, name, 'added' FROM (SELECT catalogue_id, name FROM refined EXCEPT
  SELECT catalogue_id, name FROM entries)"""
ORACLE["catalogue_diff"] = _with(*_RESULTS, "actions", "refined") + _DIFF
ORACLE["refinement_summary"] = (
    _with(*_RESULTS, "facts", "issues", "patched", "patches", "actions", "refined")
    + f""", diff AS ({_DIFF})
SELECT catalogue_id, n_before, coalesce(n_after, 0) AS n_after, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_added, 0) AS n_added, coalesce(n_patched, 0) AS n_patched, coalesce(n_issues, 0) AS n_issues,
  coalesce(n_after, 0) < n_before * 0.5 AS lost_half
FROM (SELECT catalogue_id, count(*) AS n_before FROM results GROUP BY 1)
LEFT JOIN (SELECT catalogue_id, count(*) AS n_after FROM refined GROUP BY 1) USING (catalogue_id)
LEFT JOIN (SELECT catalogue_id, count(*) FILTER (change = 'removed') AS n_removed,
  count(*) FILTER (change = 'added') AS n_added FROM diff GROUP BY 1) USING (catalogue_id)
LEFT JOIN (SELECT catalogue_id, count(*) AS n_patched FROM patches GROUP BY 1) USING (catalogue_id)
LEFT JOIN (SELECT catalogue_id, count(*) AS n_issues FROM issues GROUP BY 1) USING (catalogue_id)"""
)
ORACLE["refined_choice"] = _with(*_RESULTS, "facts") + """, good AS (
  SELECT catalogue_id, name FROM results WHERE status = 'PASS' AND n_rows > 8),
sound AS (SELECT catalogue_id, name FROM facts WHERE status = 'PASS' AND n_rows > 2),
alive AS (SELECT catalogue_id FROM good UNION SELECT catalogue_id FROM sound)
SELECT catalogue_id, name, 'METRIC' AS kind FROM good
UNION ALL SELECT catalogue_id, name, 'METRIC' FROM results
  WHERE catalogue_id NOT IN (SELECT catalogue_id FROM alive)
UNION ALL SELECT catalogue_id, name, 'FACT' FROM sound
UNION ALL SELECT catalogue_id, name, 'FACT' FROM facts WHERE catalogue_id NOT IN (SELECT catalogue_id FROM alive)"""

_SPLITS = (
    ("METRIC", "'Status (' || o_orderstatus || ')'", "o_orderdate", "orders"),
    ("METRIC", "'Flag (' || l_returnflag || ')'", "l_shipdate", "lineitem"),
    ("FACT", "'Numbers'", "o_orderdate", "orders"),
)
ORACLE["split_metrics"] = _union(
    [
        f"SELECT '{kind}' AS kind, {name} AS name, TRUE AS sql_ok, count(DISTINCT date_trunc('month', {ts})) AS n_rows "
        f"FROM {table} GROUP BY 2"
        for kind, name, ts, table in _SPLITS
    ]
    + [
        "SELECT 'METRIC', 'Event (' || event_type || ')', TRUE, count(DISTINCT date_trunc('day', ts)) FROM events GROUP BY 2",
        "SELECT 'FACT', 'Customers', TRUE, count(DISTINCT (date_trunc('month', o_orderdate), o_custkey % 7)) FROM orders",
        "SELECT 'FACT', 'Texts', TRUE, count(DISTINCT (date_trunc('month', o_orderdate), o_orderstatus)) FROM orders",
    ]
)

# --- Catalogue documents ----------------------------------------------------

ORACLE["catalogue_documents"] = _with("entries") + """
SELECT label, db_stem, CAST(length(db_stem) AS int) AS run_index, rank AS pos, name, stored AS sql, tables_csv AS tables,
  granularity, declared_start FROM (
  SELECT *, row_number() OVER (PARTITION BY label, db_stem, name ORDER BY rank DESC) AS last FROM (
    SELECT *, regexp_replace(regexp_replace(sql, '^\\s+', ''), '\\s*;*\\s*$', '') AS stored,
      row_number() OVER (PARTITION BY label, db_stem ORDER BY pos) - 1 AS rank FROM entries))
WHERE last = 1"""
ORACLE["appended_documents"] = _with("entries") + """
SELECT label AS model, 2 * count(DISTINCT db_stem) AS n_catalogues, 2 * count(*) AS n_metrics FROM (
  SELECT DISTINCT label, db_stem, name FROM entries) GROUP BY label"""
ORACLE["broken_documents"] = """
SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 1 THEN 'no JSON' WHEN s_suppkey % 7 = 2 THEN 'no object'
    WHEN s_suppkey % 4 = 2 THEN 'other content: measurable_metrics' WHEN s_suppkey % 7 = 3 THEN 'no connection' ELSE '' END AS reason,
  CASE WHEN s_suppkey % 7 IN (1, 2, 3) OR s_suppkey % 4 = 2 THEN NULL ELSE 'db' || s_nationkey END AS db_stem,
  CASE WHEN s_suppkey % 7 IN (1, 2, 3) OR s_suppkey % 4 = 2 THEN NULL WHEN s_suppkey % 4 = 0 THEN s_name
    WHEN s_suppkey % 4 = 1 THEN s_name || ',N' ELSE '' END AS names
FROM supplier"""
ORACLE["compared_catalogues"] = """
SELECT label, 'shop' AS db_stem, CAST(CASE label WHEN 'sound' THEN 1 ELSE 2 END AS bigint) AS rank, CAST(0 AS bigint) AS unmatched,
  (SELECT count(DISTINCT o_orderpriority) FROM orders) AS n_metrics
FROM (SELECT 'sound' AS label UNION ALL SELECT 'broken') AS m"""
ORACLE["paired_results"] = _with(*_RESULTS) + """
SELECT e.catalogue_id, e.pos, e.name, e.sql, e.tables_csv, r.status, r.error, r.n_rows
FROM entries e JOIN results r USING (catalogue_id, pos)"""
ORACLE["report_rows"] = _with(*_RESULTS) + """
SELECT catalogue_id, pos, name, status, confidence, granularity, unit, actual_start, actual_end, duplicate_of, error,
  n_rows, round(null_rate, 4) AS null_rate FROM results"""
ORACLE["listed_names"] = _with("entries", "facts") + """
SELECT name, 'METRIC' AS kind FROM (SELECT DISTINCT catalogue_id, name FROM entries)
UNION ALL SELECT name, 'FACT' FROM (SELECT DISTINCT catalogue_id, name FROM facts)"""
ORACLE["listed_tables"] = _union([f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in inputs.TABLES])

# --- Serving ----------------------------------------------------------------

ORACLE["broker_fetch"] = """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS date, round(sum(o_totalprice), 2) AS value
FROM orders GROUP BY 1 HAVING max(o_orderkey) % 4 <> 0"""
_SERVED = "SELECT d AS date, CAST(v AS double) AS value FROM (" + _M + " GROUP BY 1) "
ORACLE["broker_window"] = _SERVED + "WHERE d >= '1996-03' AND d <= '1998-06'"
ORACLE["broker_window_inclusive"] = _SERVED + "WHERE d >= '1996-03' AND left(d, 7) <= '1998-06'"
ORACLE["broker_query"] = "SELECT DISTINCT p_brand, p_type FROM part"
ORACLE["fuzzy_match_tokens"] = f"""
WITH n AS (SELECT DISTINCT lower(name) AS name FROM ({inputs.PART_NAMES}) AS x),
r AS (SELECT DISTINCT lower(trim(request)) AS request FROM ({inputs.PART_REQUESTS}) AS x),
nw AS (SELECT name, list_distinct(list_filter(regexp_split_to_array(replace(name, '_', ' '), '\\s+'), lambda w: w <> ''))
  AS a FROM n),
rw AS (SELECT request, list_distinct(list_filter(regexp_split_to_array(replace(request, '_', ' '), '\\s+'),
  lambda w: w <> '')) AS b FROM r),
p AS (SELECT request, name, len(list_intersect(a, b)) AS shared, len(a) + len(b) AS total FROM nw, rw)
SELECT request, name, CAST(shared AS bigint) AS shared, round(shared / (total - shared), 6) AS overlap
FROM p WHERE shared >= 0.5 * (total - shared)
"""
ORACLE["submission_decision"] = f"""
WITH a AS (SELECT run, attempt, iteration, p_partkey AS k, k4, p_partkey % 10 = 3 AS single FROM ({inputs.ATTEMPTS}) AS x),
f AS (
  SELECT *, k % 4 <> 0 AND (single OR k4 % 4 <> 0) AS no_oc, k % 4 <> 1 AND (single OR k4 % 4 <> 1) AS no_lo,
    k % 9 = 1 AS g1, k % 9 = 2 AND NOT single AS g2,
    k % 4 IN (0, 1) OR (NOT single AND k4 % 4 IN (0, 1)) AS has_orders,
    k % 4 = 1 OR (NOT single AND k4 % 4 = 1) AS has_lineitem
  FROM a),
w AS (
  SELECT *, sum(CAST(no_oc AS int)) OVER r AS n_oc, sum(CAST(no_lo AS int)) OVER r AS n_lo
  FROM f WINDOW r AS (PARTITION BY run ORDER BY attempt)),
j AS (
  SELECT *,
    concat_ws('; ', CASE WHEN no_lo AND n_lo <= 2 THEN 'lineitem-orders' END,
      CASE WHEN no_oc AND n_oc <= 2 THEN 'orders-customer' END) AS fk,
    concat_ws('; ', CASE WHEN g1 THEN 'M1: ghost1' END, CASE WHEN g2 THEN 'M2: ghost2' END) AS ghost,
    concat_ws('; ', CASE WHEN NOT has_lineitem THEN 'Lineitem' END, CASE WHEN NOT has_orders THEN 'orders' END) AS req,
    concat_ws(',', CASE WHEN n_lo - CAST(no_lo AS int) >= 2 THEN 'lineitem-orders' END,
      CASE WHEN n_oc - CAST(no_oc AS int) >= 2 THEN 'orders-customer' END) AS waived
  FROM w),
hard AS (
  SELECT *, list_filter([
    CASE WHEN k % 13 = 0 THEN ['tables_not_list', 'text'] END, CASE WHEN k % 13 = 1 THEN ['bare_tables', 'part'] END,
    CASE WHEN k % 31 = 0 THEN ['compressed', ''] END,
    CASE WHEN iteration < 2 AND k % 13 > 1 AND k % 31 > 0 THEN ['too_early', iteration || '/2'] END,
    CASE WHEN k % 17 = 0 THEN ['keys_absent', 'overview'] END, CASE WHEN k % 13 = 2 THEN ['empty_lists', 'tables'] END,
    CASE WHEN ghost <> '' THEN ['ghost_tables', ghost] END, CASE WHEN fk <> '' THEN ['foreign_keys', fk] END
  ], lambda x: x IS NOT NULL) AS h
  FROM j),
all_reasons AS (
  SELECT *, CASE WHEN len(h) > 0 THEN h WHEN req <> '' THEN [['required_tables', req]]
    WHEN single THEN [['too_few_metrics', '1']]
    WHEN k % 6 = 5 THEN [['item_rules', 'measurable_metrics[0].granularity:not_allowed; '
      || 'measurable_metrics[1].granularity:not_allowed']] ELSE [] END AS reasons
  FROM hard),
d AS (SELECT *, min(CASE WHEN len(reasons) = 0 THEN attempt END) OVER (PARTITION BY run) AS ends FROM all_reasons)
SELECT run, attempt, CASE WHEN attempt > ends THEN 'closed' WHEN len(reasons) = 0 THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN len(reasons) > 0 THEN reasons[1][1] END AS first_reason,
  array_to_string(list_transform(reasons, lambda x: x[1]), ',') AS rules,
  array_to_string(list_transform(reasons, lambda x: x[2]), '|') AS details, waived
FROM d
"""
ORACLE["broker_info"] = """
SELECT 'THREE_NUMBERS' AS asked, 'three_numbers' AS metric_name, 1.0 AS match_score, 'daily' AS granularity, 'count' AS unit,
  'high' AS confidence, '' AS agent_notes, count(DISTINCT CAST(ts AS DATE)) AS n_rows FROM events
UNION ALL SELECT 'date mismatch', 'date_mismatch', round((2 * 12 / 26.0 + 1) / 2, 3), 'monthly', 'count', 'high', '',
  count(DISTINCT date_trunc('month', o_orderdate)) FROM orders"""
ORACLE["broker_describe"] = _with("entries", "facts") + """
SELECT name, 'METRIC' AS kind, catalogue_id, pos, tables_csv FROM entries WHERE name = (SELECT arg_max(name, pos) FROM entries)
UNION ALL SELECT name, 'FACT', catalogue_id, pos, tables_csv FROM facts WHERE name = (SELECT arg_min(name, pos) FROM facts)"""
ORACLE["tables_resolved"] = """
SELECT o_orderpriority, f.* FROM (SELECT DISTINCT o_orderpriority FROM orders) AS o, (VALUES
  ('plain', TRUE, 'orders', 'orders.o_totalprice', 'orders', 'nation'),
  ('cte', TRUE, 'customer,orders', 'orders.o_totalprice', 'big,customer,orders', 'nation'),
  ('comma', TRUE, 'customer,nation,orders', 'customer.c_custkey', 'nation', NULL),
  ('filter', TRUE, 'nation,supplier', 'supplier.s_acctbal', 'nation,supplier', 'orders'),
  ('union', TRUE, 'orders,part', 'orders.o_totalprice,part.p_retailprice', 'orders,part', 'nation'),
  ('scalar', TRUE, 'lineitem,part', 'lineitem.l_tax,part.p_retailprice', 'lineitem,part', 'nation,orders'),
  ('window', TRUE, 'orders', 'orders.o_orderdate', 'orders', 'nation'),
  ('broken', FALSE, NULL, NULL, 'orders', NULL)) AS f(form, ok, tables, sources, by_text, ghosts)"""
ORACLE["sql_preview"] = """
SELECT 'grouped' AS name, 'o_orderpriority | n' || chr(10) || repeat('-', 19) || chr(10)
  || string_agg(p || ' | ' || n, chr(10) ORDER BY p) || CASE WHEN count(*) = 5 THEN chr(10) || '(truncated to 5 rows)'
  ELSE '' END AS result FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)
UNION ALL
SELECT 'short', 'n | q' || chr(10) || repeat('-', 10) || chr(10) || count(*) || ' | ' || max(l_quantity) FROM lineitem
UNION ALL
SELECT 'long', CASE WHEN length(t) > 500 THEN left(t, 500) || chr(10) || '... (truncated)' ELSE t END FROM (
  SELECT 'text' || chr(10) || repeat('-', 10) || chr(10) || string_agg(text, chr(10) ORDER BY doc_id) || chr(10)
    || '(truncated to 5 rows)' AS t FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 5))
UNION ALL SELECT 'none', 'Query returned 0 rows.'
UNION ALL SELECT 'refused', 'ERROR: Only SELECT queries are allowed.'"""
ORACLE["runnable_entries"] = """
SELECT unnest(['pass', 'one_column', 'zero_rows', 'sparse', 'high_nulls', 'extra_cols', 'three_numbers', 'constant',
  'bad_dates', 'date_mismatch', 'descending', 'period_boundary', 'duplicate', 'tick']) AS name
FROM (SELECT count(*) FROM orders)"""

# --- Scores and rankings ----------------------------------------------------

_SCORES = (*_RESULTS, "facts", "db", "mentions", "cats", "counted", "spans", "scores")
ORACLE["catalogue_scores"] = _with(*_SCORES) + """
SELECT * EXCLUDE (raw), round_even(raw, 1) AS composite FROM scores"""
ORACLE["stored_scores"] = _with(*_SCORES) + "SELECT db_stem, catalogue_id, round_even(raw, 1) AS composite FROM scores"
ORACLE["catalogue_ranking"] = _with(*_SCORES) + """
SELECT db_stem, catalogue_id, round_even(raw, 1) AS composite,
  rank() OVER (PARTITION BY db_stem ORDER BY round_even(raw, 1) DESC) AS rank FROM scores"""
_SEMANTIC = """, sem AS (SELECT catalogue_id, round_even(avg(score), 2) AS semantic_score FROM responses
  GROUP BY 1),
comb AS (SELECT *, round_even(raw * (semantic_score / 5.0), 1) AS combined FROM scores LEFT JOIN sem USING (catalogue_id)),
flag AS (SELECT db_stem, bool_or(semantic_score IS NOT NULL) AS has FROM comb GROUP BY 1)
"""
ORACLE["semantic_ranking"] = _with(*_SCORES, "responses") + _SEMANTIC + """
SELECT db_stem, catalogue_id, semantic_score, combined, rank() OVER (PARTITION BY db_stem ORDER BY
  coalesce(CASE WHEN has THEN combined ELSE round_even(raw, 1) END, 0) DESC) AS rank
FROM comb JOIN flag USING (db_stem)"""
ORACLE["model_ranking"] = _with(*_SCORES) + """
SELECT label, n_dbs, score, rank() OVER (ORDER BY score DESC) AS rank FROM (
  SELECT label, count(*) AS n_dbs, round_even(avg(round_even(raw, 1)), 1) AS score FROM scores GROUP BY label)"""
ORACLE["judge_scores"] = _with("responses") + """
SELECT catalogue_id, name, CAST(score AS double) AS score, 'r' || batch AS reason FROM responses"""
ORACLE["semantic_join"] = _with("entries") + """
SELECT pos, name, CASE WHEN 1 + pos % 5 > 2 THEN CAST(1 + pos % 5 AS double) END AS semantic FROM entries"""
ORACLE["proposal_spans"] = _with("entries", "spans") + """
SELECT catalogue_id, round(span, 6) AS avg_span_months FROM spans"""
ORACLE["database_match"] = _with("entries", "cats") + """
SELECT catalogue_id, db_stem, n_regionkey <> 2 AS matched FROM cats JOIN nation ON n_name = db_stem"""
ORACLE["metric_groups"] = _with("entries") + """
SELECT catalogue_id, CASE WHEN metric_group <> '' THEN metric_group
    WHEN list_contains(string_split(tables_csv, ','), 'orders') THEN 'orders' ELSE 'Other' END AS metric_group,
  min(pos) AS first_pos, count(*) AS n_metrics FROM entries GROUP BY 1, 2"""

# --- Catalogue documents ----------------------------------------------------

_HAS_METRIC = "p_partkey % 7 > 1"
_VIOLATIONS = [
    ("measurable_metrics", "p_name", "time_range.end:missing", f"{_HAS_METRIC} AND p_size % 5 = 0"),
    ("measurable_metrics", "p_name", "granularity:not_allowed", f"{_HAS_METRIC} AND p_size % 3 = 1"),
    ("measurable_metrics", "p_name", "unit:not_text", f"{_HAS_METRIC} AND p_size % 4 = 0"),
    ("measurable_metrics", "p_name", "tables_used:not_a_list", f"{_HAS_METRIC} AND p_size % 7 = 0"),
    ("measurable_metrics", "p_name", "confidence:not_allowed", f"{_HAS_METRIC} AND p_size % 3 = 2"),
    ("queryable_facts", "'F'", "agent_notes:missing", "p_partkey % 11 <> 0 AND p_size % 4 = 1"),
    ("key_terms", "'t' || p_size", "definition:missing", "p_size % 5 = 0"),
    ("table_relationships", "''", "join_key:not_text", "p_size % 6 = 0"),
]
ORACLE["catalogue_violations"] = _with("submissions") + _union(
    [
        f"SELECT submission_id, '{f}' AS field, CAST(0 AS bigint) AS idx, {n} AS name, '{r}' AS rule "
        f"FROM submissions WHERE {w}"
        for f, n, r, w in _VIOLATIONS
    ]
)
_CLEAN = "p_partkey % 5 IN (0, 4) AND p_partkey % 7 > 1 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0"
ORACLE["submission_gate"] = _with("submissions") + f"""
SELECT submission_id, 'tables_not_list' AS rule, 'text' AS detail FROM submissions WHERE p_partkey % 5 = 2
UNION ALL SELECT submission_id, 'bare_tables', 'part' FROM submissions WHERE p_partkey % 5 = 1
UNION ALL SELECT submission_id, 'keys_absent', concat_ws(',', CASE WHEN p_partkey % 13 = 0 THEN 'description' END,
    CASE WHEN p_partkey % 7 = 0 THEN 'measurable_metrics' END, CASE WHEN p_partkey % 11 = 0 THEN 'queryable_facts' END)
  FROM submissions WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 13 = 0
UNION ALL SELECT submission_id, 'empty_lists', concat_ws(',', CASE WHEN p_partkey % 7 = 1 THEN 'measurable_metrics' END,
    CASE WHEN p_partkey % 5 = 3 THEN 'tables' END)
  FROM submissions WHERE p_partkey % 7 = 1 OR p_partkey % 5 = 3
UNION ALL SELECT submission_id, 'too_few_metrics', '0' FROM submissions WHERE {_CLEAN} AND p_partkey % 7 <= 1"""
ORACLE["submitted_notes"] = """
SELECT p_partkey AS submission_id, CASE WHEN p_partkey % 3 = 0 THEN 'n1,n2' ELSE '' END AS notes FROM part"""
ORACLE["missing_fields"] = """
SELECT p_partkey AS catalogue_id, 'description' AS field FROM part WHERE p_partkey % 13 = 0
UNION ALL SELECT p_partkey, 'overview' FROM part"""
ORACLE["catalogue_tables"] = (
    _with("entries", "facts", "mentions")
    + f", counts AS ({ORACLE['profile_table_counts']})"
    + """
SELECT m.catalogue_id, m.table_name AS name, coalesce(c.n_rows, 7) AS row_count, '' AS description,
  CASE WHEN m.table_name = 'orders' AND nulls / n_rows >= 0.2 THEN 'Column o_totalprice: '
    || CAST(CAST(round_even(nulls / n_rows * 100, 0) AS bigint) AS STRING) || '% empty (' || nulls || ' rows)' ELSE '' END AS notes
FROM mentions m LEFT JOIN counts c USING (table_name),
  (SELECT count(*) FILTER (o_orderkey % 4 = 0) AS nulls FROM orders)"""
)
ORACLE["relationships"] = (
    _with("fk")
    + f", counts AS ({ORACLE['profile_table_counts']})"
    + """
SELECT col0 AS table_a, col2 AS table_b, col1 AS join_key, n_rows FROM fk JOIN counts ON table_name = col0"""
)
ORACLE["restored_tables"] = _with("entries") + """
, u AS (SELECT catalogue_id, unnest(string_split(tables_csv, ',')) AS name FROM entries)
SELECT catalogue_id, name, count(*) AS row_count, 'seen in ' || name AS notes FROM u WHERE name <> 'events' GROUP BY 1, 2
UNION ALL SELECT DISTINCT catalogue_id, 'fresh', CAST(-1 AS bigint), 'told' FROM entries"""
ORACLE["built_catalogues"] = _with("entries", "facts") + f"""
, m AS (SELECT catalogue_id, count(*) AS n_metrics, arg_min(name, pos) AS first_metric FROM entries GROUP BY 1),
f AS (SELECT catalogue_id, count(*) AS n_facts FROM facts GROUP BY 1),
t AS (SELECT catalogue_id, count(DISTINCT name) AS n_tables FROM (
  SELECT catalogue_id, unnest(string_split(tables_csv, ',')) AS name FROM entries
  UNION ALL SELECT catalogue_id, unnest(string_split(tables_csv, ',')) FROM facts) GROUP BY 1),
d AS ({ORACLE["time_coverage"]})
SELECT catalogue_id, 'm' AS model, 'd' AS description, '' AS overview, n_metrics, coalesce(n_facts, 0) AS n_facts, n_tables,
  CAST({len(inputs.FOREIGN_KEYS)} AS bigint) AS n_links, first_metric, 'submitted' AS last_note, first_day
FROM m LEFT JOIN f USING (catalogue_id) JOIN t USING (catalogue_id), d"""
ORACLE["redacted_sources"] = """
SELECT s_suppkey AS source_id, CASE s_suppkey % 6
    WHEN 0 THEN 'postgresql://user' || k || ':***@host.example:5432/db_' || k || '?sslmode=on'
    WHEN 1 THEN 'sqlite:///data/db' || k || '.db' WHEN 2 THEN 'mysql://root@host/shop.v' || k
    WHEN 3 THEN '/data/files/base' || k || '.sqlite' WHEN 4 THEN 'mssql://u' || k || ':***@host/sales' || k
    ELSE 'oracle://host' || k || ':1521' END AS redacted,
  CASE s_suppkey % 6 WHEN 0 THEN 'db_' || k WHEN 1 THEN 'db' || k WHEN 2 THEN 'shop' WHEN 3 THEN 'base' || k
    WHEN 4 THEN 'sales' || k ELSE 'host' || k || ':1521' END AS db_stem,
  CASE s_suppkey % 6 WHEN 0 THEN 'db_' || k WHEN 1 THEN 'db' || k WHEN 2 THEN 'shop.v' || k
    WHEN 3 THEN 'data/files/base' || k || '.sqlite' WHEN 4 THEN 'sales' || k ELSE 'db' END AS output_stem
FROM (SELECT s_suppkey, CAST(s_suppkey AS STRING) AS k FROM supplier)"""

# --- Logs and usage ---------------------------------------------------------

ORACLE["query_log_dedup"] = _with("log", "kept") + """
SELECT run, pos, CASE WHEN plain_language <> '' THEN plain_language WHEN reason <> '' THEN reason ELSE 'Query' END
  AS label, sql, CASE WHEN length(result) > 800 THEN left(result, 800) || chr(10) || '... (truncated)'
  ELSE result END AS result FROM kept"""
ORACLE["query_log_totals"] = _with("log", "kept") + """
SELECT run, n_queries, coalesce(n_unique, 0) AS n_unique FROM (SELECT run, count(*) AS n_queries FROM log GROUP BY 1)
LEFT JOIN (SELECT run, count(*) AS n_unique FROM kept GROUP BY 1) USING (run)"""
ORACLE["query_log_proposals"] = _with("log", "kept", "proposals") + """
SELECT run, n_queries, coalesce(n_unique, 0) AS n_unique, coalesce(n_proposed, 0) AS n_proposed
FROM (SELECT run, count(*) AS n_queries FROM log GROUP BY 1)
LEFT JOIN (SELECT run, count(*) AS n_unique FROM kept GROUP BY 1) USING (run)
LEFT JOIN (SELECT run, count(*) AS n_proposed FROM proposals GROUP BY 1) USING (run)"""
ORACLE["proposal_union"] = _with("proposals") + f"""
SELECT run, pos, name, CASE WHEN length(sql) > 120 THEN left(replace(sql, chr(10), ' '), 120) || '…'
  ELSE replace(sql, chr(10), ' ') END AS sql, runs FROM (
  SELECT arg_min(run, (run, pos)) AS run, arg_min(pos, (run, pos)) AS pos, name, arg_min(sql, (run, pos)) AS sql,
    array_to_string(list_sort(list(DISTINCT run)), ',') AS runs
  FROM (SELECT *, {_NORMAL} AS form FROM proposals) GROUP BY name, form)"""
ORACLE["ledger_cost"] = _with("calls", "priced") + """
SELECT session, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, model, round(cost, 9) AS cost, is_default FROM priced"""
ORACLE["ledger_totals"] = _with("calls", "priced") + """
SELECT session, n AS n_calls, i AS input_tokens, o AS output_tokens, w AS cache_write_tokens, r AS cache_read_tokens,
  round(c, 9) AS total_cost, i // n AS avg_input, o // n AS avg_output, round(c / n, 6) AS avg_cost,
  round(CASE WHEN s > 0 THEN n / s * 60 ELSE 0.0 END, 6) AS calls_per_minute,
  round((i // n + (w + r) // n) / 200000 * 100, 6) AS context_pct
FROM (SELECT session, count(*) AS n, CAST(sum(input_tokens) AS bigint) AS i, CAST(sum(output_tokens) AS bigint) AS o,
  CAST(sum(cache_write_tokens) AS bigint) AS w, CAST(sum(cache_read_tokens) AS bigint) AS r, sum(cost) AS c,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS s FROM priced GROUP BY session)"""
_MINUTES = """
SELECT session, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n_calls,
  CAST(sum(output_tokens) AS bigint) AS tokens FROM calls GROUP BY 1, 2"""
ORACLE["calls_per_minute"] = _with("calls") + _MINUTES
ORACLE["stream_calls_per_minute"] = _with("calls") + _MINUTES


def _trailing(session: str, seconds: int, limit: int) -> str:
    keep = "session, " if session == "session" else ""
    return f"""
SELECT {keep}strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, n_calls, tokens, used, {limit} - used AS headroom,
  used + 100 > {limit} AS over_limit
FROM (
  SELECT *, CAST(sum(tokens) OVER (PARTITION BY session ORDER BY epoch_us(ts)
    RANGE BETWEEN {seconds * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS bigint) AS used
  FROM (SELECT {session} AS session, ts, count(*) AS n_calls, CAST(sum(output_tokens) AS bigint) AS tokens
    FROM calls WHERE output_tokens > 0 GROUP BY 1, 2)
)"""


ORACLE["trailing_tokens"] = _with("calls") + _trailing("session", 60, 400)
ORACLE["stream_trailing_tokens"] = ORACLE["trailing_tokens"]
ORACLE["greedy_minutes"] = f"""
WITH RECURSIVE c AS (SELECT session, CAST(ts AS TIMESTAMP) AS ts, output_tokens FROM ({inputs.CALL_LOG}) AS x),
w AS (
  SELECT session, min(ts) AS start FROM c GROUP BY session
  UNION ALL
  SELECT w.session, min(c.ts) FROM w JOIN c ON c.session = w.session AND c.ts >= w.start + INTERVAL 60 SECOND
  GROUP BY w.session)
SELECT w.session, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n_calls,
  CAST(sum(output_tokens) AS bigint) AS tokens
FROM w JOIN c ON c.session = w.session AND c.ts >= w.start AND c.ts < w.start + INTERVAL 60 SECOND
GROUP BY w.session, start
"""
ORACLE["trailing_tokens_total"] = _with("calls") + _trailing("0", 600, 2000)
