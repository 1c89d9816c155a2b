"""Column functions over settings whose values keep their type as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A string, or the end of a whole number that was written as a fraction.
WHOLE_FRACTION = r'("(?:[^"\\]|\\.)*")|(\d)\.0(?![\d.eE])'


def canonical_value(text: Column) -> Column:
    """A JSON value in one spelling, so that equal values are equal texts whatever their nesting.

    Numbers are compared by value (`1` and `1.0` are equal), everything else by type and value (`true`, `"true"` and `1`
    differ); the order of an object's keys has no meaning, the order of a list has. The JSON null is null, as an absent
    value is. Text that isn't JSON fails: what can't be read must not look like what is absent.
    """
    spelled = F.to_json(F.parse_json(text))
    return F.nullif(F.regexp_replace(spelled, WHOLE_FRACTION, "$1$2"), F.lit("null"))
