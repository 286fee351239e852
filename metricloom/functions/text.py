"""Functions over SQL text, connection strings and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One token of SQL text: a quoted name, a string, a comment, a word, or any other sign.
TOKEN = (
    r"(?sU)\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/|\w+|[^\s\w]"
)
# A token that can name a table.
NAME = r"(?U)^(?:\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|\w+)$"


def tables_referenced(sql: Column) -> Column:
    """Lower-case table names after FROM or JOIN, sorted, quotes and schema dropped.

    The text is cut into tokens; comments and strings are none that could name a table.
    """
    tokens = F.filter(
        F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0)),
        lambda t: ~(t.startswith("--") | t.startswith("/*")),
    )
    # Bound once, so that no token list is made again for each of its tokens.
    return F.coalesce(F.transform(F.array(tokens), _named_tables)[0], F.array().cast("array<string>"))


def _named_tables(tokens: Column) -> Column:
    def at(i: Column) -> Column:
        return F.coalesce(F.get(tokens, i), F.lit(""))

    def named(i: Column) -> Column:
        qualified = (at(i + 2) == ".") & at(i + 3).rlike(NAME)
        name = F.when(qualified, at(i + 3)).otherwise(at(i + 1))
        bare = F.when(name.rlike(r'^["`\[]'), name.substr(F.lit(2), F.length(name) - 2)).otherwise(name)
        after = F.lower(at(i)).isin("from", "join") & at(i + 1).rlike(NAME)
        return F.when(after, F.lower(bare))

    found = F.transform(tokens, lambda _, i: named(i))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: t.isNotNull())))


def strip_semicolons(sql: Column) -> Column:
    """Text without surrounding whitespace and trailing semicolons."""
    return F.regexp_replace(F.regexp_replace(sql, r"(?U)^\s+", ""), r"(?U)\s*;*\s*$", "")


def normalise_sql(sql: Column) -> Column:
    """Form under which two statements count as the same."""
    return F.regexp_replace(strip_semicolons(F.lower(sql)), r"(?U)\s+", " ")


def strip_line_comments(sql: Column) -> Column:
    """Text without lines that hold only a ``--`` comment."""
    without = F.regexp_replace(sql, r"(?m)^[^\S\r\n]*--[^\r\n]*(?:\r?\n|$)", "")
    return F.regexp_replace(without, r"(?U)^\s+|\s+$", "")


def is_select(sql: Column) -> Column:
    """True when the text is a plain SELECT; ``WITH`` bodies are refused."""
    return F.coalesce(strip_line_comments(sql).rlike(r"(?i)^select"), F.lit(False))


def truncate(text: Column, limit: int, suffix: str) -> Column:
    """First ``limit`` characters, with ``suffix`` where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(suffix))).otherwise(
        text
    )


def redact(connection: Column) -> Column:
    """Connection string with its password masked; unchanged where it has none."""
    url = r"^([^:/?#]+)://([^:@/?#]*):([^/?#]+)@([^:@/?#]*)((?::\d+)?)((?:[/?#].*)?)$"

    def part(i: int) -> Column:
        return F.regexp_extract(connection, url, i)

    user = F.when(part(2) != "", F.concat(part(2), F.lit(":***@"))).otherwise("")
    masked = F.concat(F.lower(part(1)), F.lit("://"), user, F.lower(part(4)), part(5), part(6))
    return F.when(connection.rlike(url), masked).otherwise(connection)


def _stem(path: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.regexp_replace(last, r"^(.+)\.[^.]+$", "$1")


def db_stem(source: Column) -> Column:
    """Database name without its suffix, as used to match catalogues to databases."""
    after_scheme = F.regexp_replace(source, r"^.*?://", "")
    url_path = F.regexp_replace(F.regexp_replace(after_scheme, "^/+", ""), r"\?.*$", "")
    return _stem(F.when(source.contains("://"), url_path).otherwise(source))


def output_stem(source: Column) -> Column:
    """Database name for output paths; a server database keeps its dots."""
    file_path = F.regexp_replace(F.regexp_replace(source, "^sqlite:///", ""), r"\?.*$", "")
    url_path = F.regexp_extract(source, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)
    server = F.regexp_replace(url_path, "^/+", "")
    return F.when(source.startswith("sqlite:///"), _stem(file_path)).otherwise(
        F.when(server == "", "db").otherwise(server)
    )


def title(text: Column) -> Column:
    """Identifier text as Title Case words."""
    return F.initcap(F.regexp_replace(text, "_", " "))


def metric_name(measure: Column, form: str = "count", value: Column | None = None) -> Column:
    """Metric name by form (count, average, rate, cumulative), with an optional split value."""
    base = title(measure)
    if form == "average":
        base = F.concat(F.lit("Average "), base)
    elif form == "rate":
        base = F.concat(base, F.lit(" Rate"))
    elif form == "cumulative":
        base = F.concat(F.lit("Cumulative "), base)
    if value is not None:
        base = F.concat(base, F.lit(" ("), value, F.lit(")"))
    return base


def quoted_name(name: str | Column) -> str | Column:
    """Name as an identifier of a statement, whatever characters it has."""
    if isinstance(name, str):
        return "`" + name.replace("`", "``") + "`"
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def quoted_text(value: str | Column) -> str | Column:
    """Value as a text of a statement, backslashes and quotes escaped."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def pair_key(a: Column, b: Column) -> Column:
    """Key of a table pair that ignores its direction."""
    low, high = F.lower(a), F.lower(b)
    return F.array(F.least(low, high), F.greatest(low, high))
