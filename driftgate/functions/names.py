"""Column functions over qualified names and write destinations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftgate.functions.text import strip

# Fixed value: a reference to a variable of the bundle. Built as a literal because Spark replaces
# ${...} inside SQL text.
VARIABLE = r"(?s)^\$\{(?:var\.)?(.*)\}$"

# Skips the first part if two more follow, takes the next one, and needs one after it. No braces anywhere.
DESTINATION_SCHEMA = r"^\.*(?:[^.{}]+\.+(?=[^.{}]+\.+[^.{}]))?([^.{}]+)\.+[^.{}][^{}]*$"


def normalise_ref(ref: Column, default: str, present: Column | None = None) -> Column:
    """`${var.x}` and `${x}` become `{x}`; a literal is trimmed; a missing key becomes `default`.

    `present` tells that the key was written. A key written with a null value is the text `None`.
    """
    text = F.regexp_replace(strip(ref), F.lit(VARIABLE), F.lit("{$1}"))
    if present is not None:
        text = F.when(present & ref.isNull(), F.lit("None")).otherwise(text)
    return F.coalesce(text, F.lit(default))


def qualify_name(catalog: Column, schema: Column, table: Column) -> Column:
    """`catalog.schema.table`; null if any part is null."""
    return F.concat(catalog, F.lit("."), schema, F.lit("."), table)


def name_parts(name: Column) -> Column:
    """How many dot-separated parts a name has."""
    return F.size(F.split(name, r"\.")).cast("bigint")


def schema_of_name(name: Column) -> Column:
    """The middle part of a three-part name, null for any other shape."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) == 3, F.get(parts, F.lit(1)))


def clean_destination(destination: Column) -> Column:
    """A write destination without surrounding blanks and backticks."""
    return F.replace(strip(destination), F.lit("`"))


def is_interpolated(destination: Column) -> Column:
    """The destination holds a placeholder, so its schema is only known at run time."""
    return destination.contains("{") | destination.contains("}")


def destination_schema(cleaned: Column) -> Column:
    """Schema a cleaned destination is in: the first of two parts, the second of three or more.

    Null if the name is unqualified or interpolated. Empty parts do not count. One expression, because a
    filter on the result would evaluate every use of the destination again.
    """
    return F.nullif(F.regexp_extract(cleaned, DESTINATION_SCHEMA, 1), F.lit(""))


def schema_of_destination(destination: Column) -> Column:
    """Schema a destination is in, as it was written."""
    return destination_schema(clean_destination(destination))
