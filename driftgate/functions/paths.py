"""Column functions over paths inside a repository."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolved_path(declaring_file: Column, path: Column) -> Column:
    """`path` as seen from the file that declares it, from the top of the repository, without `.` and `..`.

    Null for a path that leads out of the repository (one `..` too many, or an absolute path), for one that ends at its
    top, and for null inputs. Segments are folded over a stack: `..` takes the last one away.
    """
    folder = F.regexp_replace(declaring_file, r"[^/]*\z", "")
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(False).alias("outside"))

    def step(held: Column, segment: Column) -> Column:
        stack = held["stack"]
        up = segment == ".."
        after = (
            F.when(segment.isin("", "."), stack)
            .when(~up, F.array_append(stack, segment))
            .when(F.size(stack) > 0, F.slice(stack, F.lit(1), F.size(stack) - 1))
            .otherwise(stack)
        )
        return F.struct(after.alias("stack"), (held["outside"] | (up & (F.size(stack) == 0))).alias("outside"))

    def finish(held: Column) -> Column:
        inside = ~held["outside"] & (F.size(held["stack"]) > 0)
        return F.when(inside, F.array_join(held["stack"], "/"))

    return F.when(~path.startswith("/"), F.aggregate(F.split(F.concat(folder, path), "/"), start, step, finish))
