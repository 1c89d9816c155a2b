"""Column functions over text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftgate.model import OWNER_ROLE, TOOLING_ROLE

# The characters that count as blank, and the breaks that end a line.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0" + "".join(
    map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85\x{2028}\x{2029}]"

# Fixed value: statements that write, with the verb and the destination as groups. Reads are left out.
# The flags are "any case" and "Unicode word and blank characters".
WRITE_STATEMENT = (
    r"(?iU)\b(INSERT\s+INTO|INSERT\s+OVERWRITE(?:\s+TABLE)?|CREATE\s+(?:OR\s+REPLACE\s+)?"
    r"(?:EXTERNAL\s+)?(?:TABLE|VIEW)(?:\s+IF\s+NOT\s+EXISTS)?|MERGE\s+INTO|UPDATE|"
    r"DELETE\s+FROM|DROP\s+TABLE(?:\s+IF\s+EXISTS)?|TRUNCATE\s+TABLE|ALTER\s+TABLE)"
    r"\s+([A-Za-z0-9_.`{}]+)"
)

# Names of owners and of repositories.
ORG_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
REPO_NAME = r"[\w.-]+"

# `^` matches after a line feed only; `\s` and `\w` are Unicode.
LINE_FLAGS = "(?mdU)"


@dataclass(frozen=True)
class ReferencePattern:
    """Where an owner name stands in a text, and what stands around it.

    `before`, `between` and `after` are expressions without groups. `repo` is empty where the reference
    names no repository. `needle` is plain text that every hit contains; texts without it are skipped.
    """

    kind: str
    role: str
    needle: str
    before: str
    org: str = ORG_NAME
    between: str = ""
    repo: str = ""
    after: str = ""

    @property
    def expression(self) -> str:
        """Groups: before, owner, between, repository, after. What follows the owner is looked at, not consumed.

        So one search can hold several patterns: a reference that begins in what follows another owner is found too.
        """
        return f"({self.before})({self.org})(?=({self.between})({self.repo})({self.after}))"


GROUPS = 5


# The references that are governed.
REFERENCE_PATTERNS = (
    ReferencePattern(
        "reusable workflow", TOOLING_ROLE, "uses:",
        before=r"^\s*uses:\s*", between="/", repo=REPO_NAME, after=r"/\.github/workflows/",
    ),
    ReferencePattern(
        "git dependency", TOOLING_ROLE, "git+https://github.com/",
        before=r"git\+https://github\.com/", between="/", repo=REPO_NAME,
    ),
    ReferencePattern("owner team", OWNER_ROLE, "@", before="@", after=r"/[\w.-]+"),
    ReferencePattern(
        "owner declaration", OWNER_ROLE, "github_org",
        before=r'^\s*github_org\s*=\s*"', after='"',
    ),
    ReferencePattern(
        "tooling declaration", TOOLING_ROLE, "tooling_org",
        before=r'^\s*tooling_org\s*=\s*"', after='"',
    ),
)


def strip(text: Column) -> Column:
    """`text` without leading and trailing blanks of any kind."""
    return F.btrim(text, F.lit(BLANKS))


# Marks around a hit. A text that holds one of the first two itself is escaped while it is searched.
MARK, ESCAPE = "\x01", "\x02"
ESCAPED_ESCAPE, ESCAPED_MARK = ESCAPE + "\x04", ESCAPE + "\x03"


def escaped(text: Column) -> Column:
    """`text` without marks, from which `unescaped` gives it back."""
    safe = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED_ESCAPE)), F.lit(MARK), F.lit(ESCAPED_MARK))
    return F.when(text.contains(MARK) | text.contains(ESCAPE), safe).otherwise(text)


def unescaped(text: Column) -> Column:
    back = F.replace(F.replace(text, F.lit(ESCAPED_MARK), F.lit(MARK)), F.lit(ESCAPED_ESCAPE), F.lit(ESCAPE))
    return F.when(text.contains(ESCAPE), back).otherwise(text)


def search_fields(text: Column, patterns: Sequence[ReferencePattern]) -> Column:
    """One search of `text` for all patterns, as a flat list: a stretch of text, the fields of a hit, a stretch, and so on.

    The fields of a hit are what stands before the owner, the owner once for each pattern (empty but for the one that
    hit), what stands between owner and repository, the repository, and what follows. Texts without a needle are not
    searched; they are one stretch.
    """
    expression = LINE_FLAGS + "|".join(f"(?:{p.expression})" for p in patterns)

    def groups(which: int) -> list[str]:
        return [f"${GROUPS * i + which}" for i in range(len(patterns))]

    fields = ["".join(groups(1)), *groups(2), *("".join(groups(n)) for n in (3, 4, 5))]
    marked = F.regexp_replace(escaped(text), F.lit(expression), F.lit(MARK + MARK.join(fields) + MARK))
    needed = reduce(or_, [text.contains(needle) for needle in sorted({p.needle for p in patterns})])
    return F.when(needed, F.split(marked, MARK)).when(text.isNotNull(), F.array(escaped(text)))


def field_hits(fields: Column, patterns: Sequence[ReferencePattern]) -> Column:
    """The hits in `search_fields`, in order: stretch before the hit, before, owner, number of its pattern, between, repo, after."""
    n, width = len(patterns), len(patterns) + 5

    def hit(i: Column) -> Column:
        at = lambda k: F.get(fields, i * width + k)
        owners = F.slice(fields, i * width + 3, F.lit(n))
        return F.struct(
            at(0).alias("stretch"),
            at(1).alias("before"),
            F.array_join(owners, "").alias("org"),
            F.array_position(F.transform(owners, lambda o: o != ""), True).cast("int").alias("pattern"),
            at(n + 2).alias("between"),
            at(n + 3).alias("repo"),
            at(n + 4).alias("after"),
        )

    count = ((F.size(fields) - 1) / width).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), hit)).otherwise(F.array())


def hit_lines(hits: Column) -> Column:
    """The 1-based line of each hit's owner, in order.

    The text up to the last owner is put together again with a mark for each owner and cut at line feeds; a line stands
    as often in the result as it holds marks. So lines are counted once for all hits, not once for each.
    """
    flow = F.array_join(F.transform(hits, lambda h: F.concat(h["stretch"], h["before"], F.lit(MARK))), "")
    marks = lambda line: F.length(line) - F.length(F.replace(line, F.lit(MARK)))
    lines = F.transform(F.split(flow, "\n"), lambda line, i: F.array_repeat((i + 1).cast("bigint"), marks(line)))
    return F.flatten(lines)
