"""Statements that read one table by one period, evaluated together in one grouped pass.

Spark analyses each statement. One whose analysed plan is a single grouped aggregate, in
order of its group, over a filter of a table has a normal form: table, filter, group, value.
Statements of the same table and group then differ in filter and value only, and become
columns of one aggregate. Everything else runs as it is.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.coerce import date_text, reads_as_date, to_value
from metricloom.sources.tables import run_sql

#: Statements of one pass; each is two columns of its aggregate.
WIDTH = 64


@dataclass(frozen=True)
class Form:
    """Normal form of a statement; the texts are Spark SQL over ``table`` named ``alias``."""

    sql: str
    names: tuple[str, ...]
    table: str
    alias: str
    condition: str
    group: str
    value: str
    descending: bool
    group_type: T.DataType
    value_type: T.DataType

    @property
    def pass_key(self) -> tuple[str, str, str]:
        return self.table, self.alias, self.group


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _plain(expression) -> bool:
    """No part of the expression is another query, a Python function or a random value."""
    todo = [expression]
    while todo:
        node = todo.pop()
        if _kind(node) == "Exists" or any(x in _kind(node) for x in ("Query", "query", "Python")):
            return False
        todo += _list(node.children())
    return expression.deterministic()


def _filtered(expression, condition: str) -> str | None:
    """Text of a value whose aggregates only see rows of the condition; None where that
    cannot be said."""
    text, found = expression.sql(), []
    todo = [expression]
    while todo:
        node = todo.pop()
        if _kind(node) == "AggregateExpression":
            if node.filter().isDefined():
                return None
            found.append(node.sql())
        else:
            todo += _list(node.children())
    if not found or not _plain(expression):
        return None
    if condition:
        # Longest first, so that no text is changed inside another.
        for own in sorted(set(found), key=len, reverse=True):
            text = text.replace(own, f"{own} FILTER (WHERE {condition})")
        if text.count("FILTER (WHERE") != sum(expression.sql().count(own) for own in set(found)):
            return None
    return text


def normal_form(spark: SparkSession, sql: str) -> Form | None:
    """The normal form of a statement, None for one of another shape or with an error."""
    try:
        df = run_sql(spark, sql)
    except PySparkException:
        return None
    if len(df.columns) != 2:
        return None
    node = df._jdf.queryExecution().analyzed()
    for wrapper in ("Project", "SubqueryAlias"):
        if _kind(node) != wrapper:
            return None
        node = node.child()
    if _kind(node) != "Sort" or node.order().size() != 1:
        return None
    order, node = node.order().apply(0), node.child()
    direction, nulls = str(order.direction()), str(order.nullOrdering())
    if (direction, nulls) not in (("Ascending", "NullsFirst"), ("Descending", "NullsLast")):
        return None
    if _kind(node) != "Aggregate" or node.groupingExpressions().size() != 1:
        return None
    group = node.groupingExpressions().apply(0)
    outputs = _list(node.aggregateExpressions())
    if len(outputs) != 2 or not _plain(group):
        return None
    first = outputs[0].child() if _kind(outputs[0]) == "Alias" else outputs[0]
    if first.sql() != group.sql() or _kind(outputs[1]) != "Alias":
        return None
    if _kind(order.child()) != "AttributeReference" or order.child().exprId().id() != outputs[0].exprId().id():
        return None
    node, condition = node.child(), ""
    if _kind(node) == "Filter":
        if not _plain(node.condition()):
            return None
        node, condition = node.child(), node.condition().sql()
    alias = table = None
    while _kind(node) == "SubqueryAlias":
        table = node.identifier().toString()
        alias = alias or node.alias()
        node = node.child()
    if table is None or _kind(node) not in ("View", "LogicalRelation", "HiveTableRelation"):
        return None
    value = _filtered(outputs[1].child(), condition)
    if value is None:
        return None
    kinds = [f.dataType for f in df.schema.fields]
    return Form(
        sql, tuple(df.columns), table, alias, condition, group.sql(), value, direction == "Descending", *kinds
    )


def passes(forms: Iterable[Form], width: int = WIDTH) -> list[list[Form]]:
    """Forms of one table and group together, ``width`` at a time."""
    together: dict[tuple, list[Form]] = {}
    for form in forms:
        together.setdefault(form.pass_key, []).append(form)
    return [g[i : i + width] for g in together.values() for i in range(0, len(g), width)]


def grouped(spark: SparkSession, forms: list[Form]) -> DataFrame:
    """The rows of all forms of a pass from one scan: (form, place, date, value, date_ok).

    ``place`` orders the rows of a form as its statement does. A group is a row of a form
    only if some row of the table passes the form's filter.
    """
    source = spark.table(forms[0].table).alias(forms[0].alias)
    columns = []
    for i, form in enumerate(forms):
        present = f"count(1) FILTER (WHERE {form.condition})" if form.condition else "count(1)"
        columns += [F.expr(present).alias(f"n{i}"), F.expr(form.value).alias(f"v{i}")]
    wide = source.groupBy(F.expr(forms[0].group).alias("g")).agg(*columns)
    kind = forms[0].group_type
    rows = [
        F.when(
            F.col(f"n{i}") > 0,
            F.struct(F.lit(i).alias("form"), to_value(F.col(f"v{i}"), form.value_type).alias("value")),
        )
        for i, form in enumerate(forms)
    ]
    return wide.select(
        F.struct(F.col("g").isNotNull().alias("known"), F.col("g").alias("g")).alias("place"),
        date_text(F.col("g"), kind).alias("date"),
        reads_as_date(F.col("g"), kind).alias("date_ok"),
        F.inline(F.array_compact(F.array(*rows))),
    )


def statistics(spark: SparkSession, forms: list[Form]) -> dict[str, dict]:
    """The statistics of every form of a pass by statement, reduced inside Spark."""
    valid = F.when(F.col("value").isNotNull(), F.col("place"))
    rows = grouped(spark, forms).groupBy("form").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count("value").alias("valid_rows"),
        F.min("value").alias("value_min"),
        F.max("value").alias("value_max"),
        F.coalesce(F.min_by("date", valid), F.lit("")).alias("low"),
        F.coalesce(F.max_by("date", valid), F.lit("")).alias("high"),
        F.count_if(~F.col("date_ok")).alias("bad_dates"),
    )
    found = {r["form"]: r.asDict() for r in rows.collect()}  # one row a statement of the pass
    empty = {"total_rows": 0, "valid_rows": 0, "value_min": None, "value_max": None, "bad_dates": 0}
    out = {}
    for i, form in enumerate(forms):
        stats = found.get(i, {**empty, "low": "", "high": ""})
        ends = (stats["low"], stats["high"])
        start, end = ends[::-1] if form.descending else ends
        out[form.sql] = {**stats, "actual_start": start, "actual_end": end}
    return out
