"""Reading fields out of a JSON line the way a lenient log reader does.

Values are taken as text straight from the parsed line. Their type is looked up only where
the text leaves it open, because that is the dearer step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts of values that count as absent, unless they are strings (fixed values).
EMPTY_VALUES = ("", "false", "0", "0.0", "-0", "-0.0", "[]", "{}")


def opens_object(line: Column) -> Column:
    """True where `line` begins as a JSON object does."""
    return line.startswith("{") | F.ltrim(line, F.lit(" \t\r\n")).startswith("{")


def is_json_object(line: Column, parsed: Column) -> Column:
    """True where `line` is valid UTF-8 and one JSON object (`parsed` is its VARIANT)."""
    return parsed.isNotNull() & opens_object(line) & F.is_valid_utf8(line)


def value_at(parsed: Column, path: str) -> Column:
    return F.try_variant_get(parsed, path, "variant")


def text_at(parsed: Column, path: str) -> Column:
    """Strings as they are, other values as JSON text, null for null and absent ones."""
    return F.try_variant_get(parsed, path, "string")


def is_string_at(parsed: Column, path: str) -> Column:
    return F.schema_of_variant(value_at(parsed, path)) == "STRING"


def is_integer_at(parsed: Column, path: str) -> Column:
    return F.schema_of_variant(value_at(parsed, path)) == "BIGINT"


def present_text(parsed: Column, path: str) -> Column:
    """The text of a value that is not empty, zero, false or null."""
    text = text_at(parsed, path)
    return F.when(~text.isin(*EMPTY_VALUES), text).when(
        (text != "") & is_string_at(parsed, path), text
    )


def time_text(parsed: Column, path: str) -> Column:
    """As present_text, but a number that reads like a date is marked as no time."""
    text = present_text(parsed, path)
    number = text.rlike(r"^\d{8}$") & ~is_string_at(parsed, path)
    return F.when(number, "number").otherwise(text)


def odd_container(parsed: Column, path: str) -> Column:
    """True where a value is there but is no object, so nothing can be read from it."""
    value = value_at(parsed, path)
    return value.isNotNull() & ~F.schema_of_variant(value).startswith("OBJECT")


def parse_error_payload(line: Column) -> Column:
    """Wrapper kept for a line that cannot be read, so that the line still leaves an event."""
    return F.to_json(
        F.struct(F.lit(True).alias("_parse_error"), F.make_valid_utf8(line).alias("raw"))
    )
