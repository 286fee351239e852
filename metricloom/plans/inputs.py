"""Inputs of the registered queries, derived from the given tables.

Catalogue entries, logs, submissions and answers are no tables of the test data, so
they are built from whole tables: one metric per customer, one logged query or call
per event, one submission per part, one connection per supplier. Each text below
reads the same in Spark SQL and in ANSI SQL, so both sides start from equal rows.
"""

from __future__ import annotations

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

PRIMARY_KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "pages": ["page_id"],
    "benchmark": ["item_id"],
    "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}

FOREIGN_KEYS = [
    ("nation", ["n_regionkey"], "region", ["r_regionkey"]),
    ("customer", ["c_nationkey"], "nation", ["n_nationkey"]),
    ("supplier", ["s_nationkey"], "nation", ["n_nationkey"]),
    ("orders", ["o_custkey"], "customer", ["c_custkey"]),
    ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]),
    ("lineitem", ["l_partkey"], "part", ["p_partkey"]),
    ("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"]),
    ("labels", ["doc_id"], "documents", ["doc_id"]),
]

# Columns whose text is the same in every engine, for samples.
SAMPLED = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    "events": ["event_id", "user_id", "event_type", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}

# One metric entry per customer. Every fourth customer shares one statement.
CUSTOMER_METRICS = """
SELECT n_name || '/' || c_mktsegment AS catalogue_id, c_mktsegment AS label, n_name AS db_stem,
  c_custkey AS pos, 'Orders (' || c_name || ')' AS name, 'count' AS unit,
  CASE c_custkey % 8
    WHEN 0 THEN 'SELECT period, value FROM orders WHERE o_custkey = ' || CAST(c_custkey AS STRING)
    WHEN 1 THEN 'select period, count(*) FROM "orders" o JOIN `lineitem` l ON l_orderkey = o_orderkey AND o_custkey = '
      || CAST(c_custkey AS STRING) || ' ; '
    WHEN 2 THEN 'SELECT * FROM public.orders JOIN [customer] ON c_custkey = ' || CAST(c_custkey AS STRING)
    WHEN 3 THEN '  SELECT   period, count(*)' || chr(10) || 'FROM Orders ; '
    WHEN 4 THEN 'select period, count(*) from orders;'
    WHEN 5 THEN '-- by customer' || chr(10) || 'SELECT * FROM "public"."orders" JOIN nation n ON n_nationkey = '
      || CAST(c_custkey AS STRING)
    WHEN 6 THEN 'WITH x AS (SELECT * FROM orders) SELECT * FROM x JOIN customer c ON c_custkey = '
      || CAST(c_custkey AS STRING)
    ELSE '' END AS sql,
  CASE c_custkey % 8
    WHEN 0 THEN 'orders' WHEN 1 THEN 'Orders,lineitem' WHEN 2 THEN 'orders,customer,part'
    WHEN 3 THEN 'orders' WHEN 4 THEN 'orders,lineitem' WHEN 5 THEN 'nation,orders'
    WHEN 6 THEN 'orders,customer' ELSE 'events' END AS tables_csv,
  CASE c_custkey % 5 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' WHEN 2 THEN 'annual'
    WHEN 3 THEN 'daily' ELSE 'weekly' END AS granularity,
  CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment || ' Orders' END AS metric_group,
  CASE c_custkey % 6
    WHEN 0 THEN substr(first_day, 1, 7) || '-01' WHEN 1 THEN substr(first_day, 1, 4) || '-01-01'
    WHEN 2 THEN last_day WHEN 3 THEN '' WHEN 4 THEN substr(first_day, 1, 4) ELSE 'unknown' END AS declared_start,
  CASE c_custkey % 6
    WHEN 0 THEN substr(last_day, 1, 7) || '-01' WHEN 1 THEN substr(last_day, 1, 4) || '-12-31'
    WHEN 2 THEN first_day WHEN 3 THEN '' WHEN 4 THEN substr(last_day, 1, 4) ELSE '2001-0' END AS declared_end,
  CAST(CASE WHEN c_custkey % 13 = 0 THEN 1 WHEN c_custkey % 9 = 0 THEN 3 ELSE 2 END AS bigint) AS n_cols,
  CASE WHEN c_custkey % 8 = 7 THEN 'No SQL in catalogue entry' WHEN c_custkey % 17 = 0 THEN 'no such column'
    WHEN c_custkey % 23 = 0 THEN 'eval error: out of range' ELSE '' END AS sql_error,
  NOT (c_custkey % 8 = 7 OR c_custkey % 17 = 0) AS sql_ok,
  n_categories
FROM (
  SELECT c_custkey, c_name, c_mktsegment, n_name,
    coalesce(CAST(CAST(min(o_orderdate) AS DATE) AS STRING), '') AS first_day,
    coalesce(CAST(CAST(max(o_orderdate) AS DATE) AS STRING), '') AS last_day,
    count(DISTINCT o_orderpriority || o_orderstatus) AS n_categories
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
  GROUP BY c_custkey, c_name, c_mktsegment, n_name
) AS c
"""

# Monthly order counts of each customer; every fourth month has no value.
CUSTOMER_SERIES = """
SELECT o_custkey AS pos, date_trunc('month', o_orderdate) AS period,
  CASE WHEN min(o_orderkey) % 4 = 0 THEN NULL ELSE CAST(count(*) AS DOUBLE) END AS value
FROM orders GROUP BY o_custkey, date_trunc('month', o_orderdate)
"""

# One evaluated fact per supplier: the rows its statement found. Suppliers in debt have none.
SUPPLIER_FACTS = """
SELECT n_name || '/' || CASE s_suppkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING'
    WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS catalogue_id,
  s_suppkey AS pos, 'Deliveries of ' || s_name AS name, s_suppkey % 7 <> 0 AS sql_ok,
  CASE WHEN s_suppkey % 7 = 0 THEN 'no such table' WHEN count(l_orderkey) = 0 THEN 'zero_rows' ELSE '' END AS error,
  CAST(4 AS bigint) AS n_cols, count(l_orderkey) AS n_rows,
  CASE WHEN s_suppkey % 7 = 0 THEN 'FAIL' WHEN count(l_orderkey) = 0 THEN 'WARN' ELSE 'PASS' END AS status,
  'lineitem' AS tables_csv
FROM supplier JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN lineitem ON l_suppkey = s_suppkey AND s_acctbal >= 0
GROUP BY n_name, s_suppkey, s_name
"""

# One scored answer per customer in one of four shapes.
JUDGE_RESPONSES = """
SELECT n_name || '/' || c_mktsegment AS catalogue_id, c_custkey AS batch,
  CASE c_custkey % 4
    WHEN 0 THEN '[' || item || ']'
    WHEN 1 THEN '```json' || chr(10) || '[' || item || ']' || chr(10) || '```'
    WHEN 2 THEN '{"note": "scores", "scores": [' || item || ']}'
    ELSE '[' || item || ', {"name": "Cut", "sco' END AS text,
  'Orders (' || c_name || ')' AS name, 1 + c_custkey % 5 AS score
FROM (
  SELECT c_custkey, c_name, c_mktsegment, c_nationkey, '{"name": "Orders (' || c_name || ')", "score": '
    || CAST(1 + c_custkey % 5 AS STRING) || ', "reason": "r' || CAST(c_custkey AS STRING) || '"}' AS item
  FROM customer
) AS c JOIN nation ON c_nationkey = n_nationkey
"""

# One logged query per event; a few hundred statements repeat throughout.
QUERY_LOG = """
SELECT user_id % 4 AS run, event_id AS pos,
  CASE WHEN event_id % 3 = 0 THEN '  ' ELSE '' END || 'SELECT count(*) FROM ' || event_type || ' WHERE k = '
    || CAST(CAST(floor(value) AS bigint) % 40 AS STRING) || CASE WHEN event_id % 7 = 0
    THEN repeat(' OR k IS NULL', 20) ELSE '' END || CASE WHEN event_id % 5 = 0 THEN chr(10) ELSE '' END AS sql,
  CASE WHEN event_id % 2 = 0 THEN '' ELSE 'check ' || event_type END AS reason,
  CASE WHEN event_id % 6 = 0 THEN 'Count of ' || event_type ELSE '' END AS plain_language,
  CASE WHEN event_id % 11 = 0 THEN repeat(props, 100) ELSE props END AS result
FROM events
"""

# One proposed metric per order; names repeat over runs, statements in other spellings.
PROPOSALS = """
SELECT o_orderkey % 3 AS run, o_orderkey AS pos,
  'Orders ' || o_orderpriority || ' of ' || CAST(o_custkey % 500 AS STRING) AS name,
  CASE WHEN o_orderkey % 2 = 0 THEN 'SELECT  ' ELSE 'select' || chr(10) END || CAST(o_orderkey % 50 AS STRING)
    || CASE WHEN o_orderkey % 50 = 7 THEN repeat(' + 1', 40) ELSE '' END
    || CASE WHEN o_orderkey % 3 = 0 THEN ' ;' ELSE '' END AS sql
FROM orders
"""

# One metered call per event.
CALL_LOG = """
SELECT user_id AS session, ts,
  CASE event_type WHEN 'click' THEN 'vendor/alpha' WHEN 'view' THEN 'alpha-2' WHEN 'purchase' THEN 'beta'
    WHEN 'error' THEN 'acme/gamma-x' ELSE 'delta' END AS model,
  CAST(floor(value * 100) AS bigint) AS input_tokens, CAST(floor(value * 10) AS bigint) AS output_tokens,
  CASE WHEN event_id % 3 = 0 THEN event_id % 50 ELSE 0 END AS cache_write_tokens,
  CASE WHEN event_id % 4 = 0 THEN event_id % 70 ELSE 0 END AS cache_read_tokens
FROM events
"""

# (model, position, input, output, cache write, cache read) per million tokens.
PRICE_BOOK = [
    ("vendor/alpha", 0, 2.0, 8.0, None, None),
    ("alpha-2-large", 1, 1.0, 4.0, 1.5, 0.2),
    ("alpha-2-small", 2, 0.5, 2.0, None, None),
    ("beta", 3, 6.0, 30.0, None, 0.5),
    ("gamma-x-2025", 4, 0.25, 1.25, 0.4, None),
]

# One submitted catalogue document per part.
SUBMISSIONS = """
SELECT p_partkey AS submission_id, p_partkey, p_size, p_name,
  '{"tables": ' || CASE p_partkey % 5
    WHEN 0 THEN '[{"name": "part"}]' WHEN 1 THEN '["part"]' WHEN 2 THEN '"part"' WHEN 3 THEN '[]'
    ELSE '"[{' || chr(92) || '"name' || chr(92) || '": ' || chr(92) || '"part' || chr(92) || '"}]"' END
  || CASE p_partkey % 7
    WHEN 0 THEN '' WHEN 1 THEN ', "measurable_metrics": []'
    ELSE ', "measurable_metrics": [{"name": "' || p_name || '", "description": "d", "sql": "SELECT 1", '
      || '"time_range": {"start": "2024-01-01"' || CASE WHEN p_size % 5 = 0 THEN '' ELSE ', "end": "2024-12-01"' END
      || '}, "granularity": "' || CASE p_size % 3 WHEN 1 THEN 'hourly' ELSE 'monthly' END || '", "unit": '
      || CASE WHEN p_size % 4 = 0 THEN '7' ELSE '"count"' END || ', "tables_used": '
      || CASE WHEN p_size % 7 = 0 THEN '"part"' ELSE '["part"]' END
      || CASE p_size % 3 WHEN 2 THEN '' ELSE ', "confidence": "high"' END || ', "agent_notes": "n"}]' END
  || CASE WHEN p_partkey % 11 = 0 THEN ''
    ELSE ', "queryable_facts": [{"name": "F", "description": "d", "sql": "SELECT 1"'
      || CASE WHEN p_size % 4 = 1 THEN '' ELSE ', "agent_notes": "n"' END || '}, "loose text"]' END
  || CASE WHEN p_partkey % 13 = 0 THEN '' ELSE ', "description": "Parts"' END
  || ', "overview": "o", "key_terms": [{"term": "t' || CAST(p_size AS STRING) || '"'
  || CASE WHEN p_size % 5 = 0 THEN '' ELSE ', "definition": "x"' END || '}]'
  || ', "table_relationships": [{"table_a": "a", "table_b": "b", "join_key": '
  || CASE WHEN p_size % 6 = 0 THEN '3' ELSE '"k"' END || '}]'
  || ', "data_quality_notes": ' || CASE p_partkey % 3 WHEN 0 THEN '["n1", "n2"]' WHEN 1 THEN '"one"' ELSE '[1, 2]' END
  || '}' AS data
FROM part
"""

# Eight submissions of a run, one per part, with two metrics over joined tables.
_JOIN_KINDS = """CASE {k} % 4 WHEN 0 THEN 'SELECT m, count(*) FROM orders JOIN customer c ON true'
      WHEN 1 THEN 'SELECT m, 1 FROM public.lineitem l, x JOIN orders o ON true' WHEN 2 THEN 'SELECT 1 FROM lineitem JOIN part'
      ELSE 'SELECT day, n FROM Events' END"""
_JOIN_TABLES = """CASE {k} % 4 WHEN 0 THEN '"orders", "Customer"' WHEN 1 THEN '"lineitem", "orders"'
      WHEN 2 THEN '"part"' ELSE '"events"' END"""
_ATTEMPT_METRIC = """'{{"name": "M{i}", "description": "d", "sql": "' || {sql} || '", "time_range": {{"start": "2024-01", '
      || '"end": "2024-12"}}, "granularity": "' || CASE WHEN p_partkey % 6 = 5 THEN 'hourly' ELSE 'monthly' END
      || '", "unit": "count", "confidence": "high", "agent_notes": "n", "tables_used": [' || {used}
      || CASE WHEN p_partkey % 9 = {i} THEN ', "ghost{i}"' ELSE '' END || ']}}'"""
_FIRST = _ATTEMPT_METRIC.format(i=1, sql=_JOIN_KINDS.format(k="p_partkey"), used=_JOIN_TABLES.format(k="p_partkey"))
_OTHER = _ATTEMPT_METRIC.format(i=2, sql=_JOIN_KINDS.format(k="k4"), used=_JOIN_TABLES.format(k="k4"))
ATTEMPTS = f"""
SELECT p_partkey AS submission_id, run, p_partkey AS attempt, p_partkey % 20 AS iteration, p_partkey, k4,
  '{{"tables": ' || CASE p_partkey % 13 WHEN 0 THEN '"part"' WHEN 1 THEN '["part"]' WHEN 2 THEN '[]'
    ELSE '[{{"name": "part"}}]' END || CASE WHEN p_partkey % 31 = 0 THEN ', "_compressed": true' ELSE '' END
  || CASE WHEN p_partkey % 17 = 0 THEN '' ELSE ', "overview": "o"' END || ', "description": "d", "queryable_facts": [], '
  || '"measurable_metrics": [' || {_FIRST} || CASE WHEN p_partkey % 10 = 3 THEN '' ELSE ', ' || {_OTHER} END || ']}}' AS data
FROM (SELECT p_partkey, CAST(floor(p_partkey / 4) AS bigint) AS k4, CAST(floor(p_partkey / 8) AS bigint) AS run FROM part) AS p
"""

# One document file per supplier, some cut off, of another shape, or encoded once more.
DOCUMENT_FILES = """
SELECT s_suppkey, CASE s_suppkey % 7
  WHEN 1 THEN substr(whole, 1, length(whole) - 3) WHEN 2 THEN '[' || whole || ']' WHEN 3 THEN replace(whole, 'connection', 'link')
  ELSE whole END AS value
FROM (
  SELECT s_suppkey, '{"connection": "parquet://files/db' || CAST(s_nationkey AS STRING) || '", "measurable_metrics": '
    || CASE s_suppkey % 4
      WHEN 0 THEN '[{"name": "' || s_name || '", "sql": "SELECT 1;"}]'
      WHEN 1 THEN '"[{' || q || 'name' || q || ': ' || q || s_name || q || '}, {' || q || 'name' || q || ': ' || q || 'N' || q || '}]"'
      WHEN 2 THEN '"none"' ELSE '[]' END || '}' AS whole
  FROM (SELECT s_suppkey, s_name, s_nationkey, chr(92) || '"' AS q FROM supplier) AS s
) AS d
"""

# One connection text per supplier.
CONNECTIONS = """
SELECT s_suppkey AS source_id, CASE s_suppkey % 6
  WHEN 0 THEN 'postgresql://user' || k || ':pw' || k || '@Host.Example:5432/db_' || k || '?sslmode=on'
  WHEN 1 THEN 'sqlite:///data/db' || k || '.db'
  WHEN 2 THEN 'mysql://root@host/shop.v' || k
  WHEN 3 THEN '/data/files/base' || k || '.sqlite'
  WHEN 4 THEN 'mssql://u' || k || ':p@w' || k || '@host/sales' || k
  ELSE 'oracle://host' || k || ':1521' END AS connection
FROM (SELECT s_suppkey, CAST(s_suppkey AS STRING) AS k FROM supplier) AS s
"""

# One rejected table pair per line item, in either direction.
REJECTIONS = """
SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'Lineitem' ELSE other END AS table_a,
  CASE WHEN l_linenumber % 2 = 0 THEN other ELSE 'lineitem' END AS table_b
FROM (
  SELECT l_linenumber, CASE l_returnflag WHEN 'A' THEN 'orders' WHEN 'N' THEN 'part'
    ELSE 'Supplier' END AS other
  FROM lineitem
) AS l
UNION ALL SELECT 'Region', r_name FROM region
"""

# One column value per event, as a mix of number and date spellings.
MIXED_VALUES = """
SELECT event_id, CASE event_id % 9
  WHEN 0 THEN CAST(value AS STRING) WHEN 1 THEN ' ' || CAST(event_id AS STRING) || ' ' WHEN 2 THEN 'N/A'
  WHEN 3 THEN '' WHEN 4 THEN '1e3' WHEN 5 THEN 'nan' WHEN 6 THEN '12d' WHEN 7 THEN '-.5' ELSE NULL END AS number_text,
  CASE event_id % 9
  WHEN 0 THEN CAST(CAST(ts AS DATE) AS STRING) WHEN 1 THEN substr(CAST(CAST(ts AS DATE) AS STRING), 1, 7)
  WHEN 2 THEN '2024' WHEN 3 THEN '2024-Q1' WHEN 4 THEN '01/02/2024' WHEN 5 THEN 'Jan 2024'
  WHEN 6 THEN 'row ' || CAST(event_id AS STRING) WHEN 7 THEN '20240115' ELSE NULL END AS date_text
FROM events
"""

# Names to serve, and one request per part in varying spelling.
PART_NAMES = "SELECT 'Total ' || p_name AS name, min(p_partkey) AS pos FROM part GROUP BY p_name"
PART_REQUESTS = """
SELECT p_partkey, CASE p_partkey % 6
  WHEN 0 THEN upper('Total ' || p_name) WHEN 1 THEN replace('total ' || p_name, ' ', '_')
  WHEN 2 THEN p_name WHEN 3 THEN substr('Total ' || p_name, 2) WHEN 4 THEN p_type || ' ' || p_brand
  ELSE 'monthly ' || p_name || ' totals' END AS request
FROM part
"""
