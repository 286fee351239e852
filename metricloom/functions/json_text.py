"""Reading JSON held in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.schemas import JUDGE_ITEM

# Fields a submission may carry as JSON text, and the JSON they must hold.
ENCODED_FIELDS = {
    "tables": "array",
    "measurable_metrics": "array",
    "queryable_facts": "array",
    "time_coverage": "object",
}


def decode_field(document: Column, field: str) -> Column:
    """JSON text of ``field``; a value that was itself encoded as a string comes out unwrapped."""
    return F.get_json_object(document, f"$.{field}")


def field_kind(document: Column, field: str) -> Column:
    """What ``field`` of a parsed document (a variant) holds after decoding: array,
    object, text, other, null, absent."""
    value = F.try_variant_get(document, f"$.{field}", "variant")
    kind = F.schema_of_variant(value)
    plain = (
        F.when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind == "STRING", "text")
        .when(kind == "VOID", "null")
        .otherwise("other")
    )
    if field in ENCODED_FIELDS:
        wanted = ENCODED_FIELDS[field]
        inner = F.schema_of_variant(F.try_parse_json(F.try_variant_get(document, f"$.{field}", "string")))
        unwrapped = (kind == "STRING") & F.coalesce(inner.startswith(wanted.upper()), F.lit(False))
        plain = F.when(unwrapped, wanted).otherwise(plain)
    return F.when(value.isNull(), "absent").otherwise(plain)


def text_list(document: Column, field: str) -> Column:
    """List of texts; anything else counts as an empty list."""
    raw = F.get_json_object(document, f"$.{field}")
    kind = F.schema_of_variant(F.try_parse_json(raw))
    parsed = F.when(kind == "ARRAY<STRING>", F.from_json(raw, T.ArrayType(T.StringType())))
    return F.coalesce(parsed, F.array().cast("array<string>"))


FLAT_OBJECT = r"\{[^{}]+\}"
FENCE = "```"


def clean_answer(answer: Column) -> Column:
    """Answer without surrounding whitespace and code fences."""
    text = F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")
    body = F.when(text.startswith(FENCE), F.regexp_replace(text, r"(?U)^```\w*\s*", "")).otherwise(text)
    cut = F.left(body, F.length(body) - 3)
    return F.when(body.endswith(FENCE), F.regexp_replace(cut, r"(?U)\s+$", "")).otherwise(body)


def json_kind(text: Column) -> Column:
    """Type text of a JSON value, null where the text is no JSON."""
    return F.schema_of_variant(F.try_parse_json(text))


def scored_items(text: Column, kind: Column) -> Column:
    """Scored items of a cleaned answer: a plain list, the first list inside an object,
    or whole objects recovered from text that was cut off."""
    items = T.ArrayType(JUDGE_ITEM)
    values = F.map_values(F.from_json(text, T.MapType(T.StringType(), T.StringType())))
    listed = F.get(F.filter(values, lambda v: F.ltrim(v).startswith("[")), F.lit(0))
    # A cut-off answer: every whole object in it that parses and has a name and a score.
    parsed = F.transform(
        F.regexp_extract_all(text, F.lit(FLAT_OBJECT), F.lit(0)),
        lambda m: F.when(F.try_parse_json(m).isNotNull(), F.from_json(m, JUDGE_ITEM)),
    )
    scraped = F.filter(parsed, lambda i: i["name"].isNotNull() & i["score"].isNotNull())
    return (
        F.when(kind.startswith("ARRAY"), F.from_json(text, items))
        .when(kind.startswith("OBJECT"), F.from_json(listed, items))
        .otherwise(scraped)
    )


def judge_items(answer: Column) -> Column:
    """Scored items of a free-text answer."""
    text = clean_answer(answer)
    return scored_items(text, json_kind(text))
