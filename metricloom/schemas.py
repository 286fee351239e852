"""Fixed schemas of catalogue documents, result rows and logs."""

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STR = T.StringType()
LONG = T.LongType()
DOUBLE = T.DoubleType()
BOOL = T.BooleanType()
TEXTS = T.ArrayType(STR)

TIME_RANGE = _struct(start=STR, end=STR)

METRIC = _struct(
    name=STR,
    description=STR,
    sql=STR,
    time_range=TIME_RANGE,
    granularity=STR,
    unit=STR,
    tables_used=TEXTS,
    confidence=STR,
    agent_notes=STR,
    group=STR,
)

FACT = _struct(name=STR, description=STR, sql=STR, tables_used=TEXTS, agent_notes=STR, group=STR)

KEY_TERM = _struct(term=STR, definition=STR)

RELATIONSHIP = _struct(table_a=STR, table_b=STR, join_key=STR)

TABLE_SUMMARY = _struct(
    name=STR, row_count=LONG, description=STR, key_columns=TEXTS, data_quality_notes=TEXTS
)

CATALOGUE = _struct(
    analysed_at=STR,
    model=STR,
    connection=STR,
    dialect=STR,
    description=STR,
    overview=STR,
    tables=T.ArrayType(TABLE_SUMMARY),
    measurable_metrics=T.ArrayType(METRIC),
    queryable_facts=T.ArrayType(FACT),
    time_coverage=TIME_RANGE,
    data_quality_notes=TEXTS,
    key_terms=T.ArrayType(KEY_TERM),
    table_relationships=T.ArrayType(RELATIONSHIP),
)

FOREIGN_KEY = _struct(from_table=STR, from_cols=TEXTS, to_table=STR, to_cols=TEXTS)

# A metric or fact row of a flat catalogue table.
METRIC_ROW = T.StructType(
    [T.StructField("catalogue_id", STR), T.StructField("pos", LONG), *METRIC.fields]
)
FACT_ROW = T.StructType(
    [T.StructField("catalogue_id", STR), T.StructField("pos", LONG), *FACT.fields]
)

# What one run over a metric's rows measures, before any rule is applied.
SERIES_STATS = _struct(
    sql=STR,
    sql_ok=BOOL,
    sql_error=STR,
    n_cols=LONG,
    col_names=TEXTS,
    total_rows=LONG,
    valid_rows=LONG,
    value_min=DOUBLE,
    value_max=DOUBLE,
    actual_start=STR,
    actual_end=STR,
    bad_dates=LONG,
)

PRICE_BOOK = _struct(
    model=STR, pos=LONG, input=DOUBLE, output=DOUBLE, cache_write=DOUBLE, cache_read=DOUBLE
)

JUDGE_ITEM = _struct(name=STR, score=DOUBLE, reason=STR)
