"""References to owners in text: finding, checking and moving them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.functions.text import (
    LINE_FLAGS,
    REFERENCE_PATTERNS,
    ReferencePattern,
    field_hits,
    hit_lines,
    search_fields,
    strip,
    unescaped,
)
from driftgate.model import OWNER_ROLE, TOOLING_ROLE, require

# The files that are governed, and a declaration in a settings file.
GOVERNED_FILES = ("pyproject.toml", "CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS")
GOVERNED_WORKFLOWS = r"^\.github/workflows/[^/]+\.ya?ml$"
DECLARATION = LINE_FLAGS + r'^\s*{key}\s*=\s*"([^"]*)"'


def line_matches(
    texts: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", needle: str | None = None
) -> DataFrame:
    """1-based line of each line that matches, and the first group of its first hit.

    `needle` is lower-case text that every hit contains in any case. Texts without it are not split.
    """
    require(texts, key, text)
    if needle is not None:
        texts = texts.filter(F.lower(text).contains(needle))
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "content"))
    return lines.filter(F.col("content").rlike(pattern)).select(
        key,
        (F.col("pos") + 1).cast("bigint").alias("line"),
        F.regexp_extract("content", pattern, 1).alias("hit"),
    )


def with_hits(texts: DataFrame, patterns: Sequence[ReferencePattern]) -> DataFrame:
    """Add `_fields` and `_hits`: the result of one search of each text for all patterns.

    Each step is a projection of its own, because the search must not be repeated for every use of its result.
    """
    return texts.withColumn("_fields", search_fields(F.col("text"), patterns)).withColumn(
        "_hits", field_hits(F.col("_fields"), patterns)
    )


def reference_extract(
    texts: DataFrame, patterns: Sequence[ReferencePattern] = REFERENCE_PATTERNS
) -> DataFrame:
    """Every reference: kind, role, owner, repository if it names one, the line of the owner, and the text that matched.

    A text is searched once, with all patterns in one expression, and only hits are exploded. Patterns are tried in their
    order where two begin at the same place.
    """
    others = [c for c in require(texts, "text").columns if c != "text"]
    of = lambda values, number: F.element_at(F.array(*[F.lit(v) for v in values]), number)
    names_repo = F.array(*[F.lit(bool(p.repo)) for p in patterns])
    found = with_hits(texts, patterns).withColumn("_lines", F.when(F.size("_hits") > 0, hit_lines(F.col("_hits"))))

    def reference(hit: Column, i: Column) -> Column:
        whole = F.concat(hit["before"], hit["org"], hit["between"], hit["repo"], hit["after"])
        return F.struct(
            F.get("_lines", i).alias("line"),
            of([p.role for p in patterns], hit["pattern"]).alias("role"),
            of([p.kind for p in patterns], hit["pattern"]).alias("kind"),
            hit["org"].alias("org"),
            F.when(F.element_at(names_repo, hit["pattern"]), hit["repo"]).alias("target_repo"),
            strip(unescaped(whole)).alias("matched"),
        )

    return found.select(*others, F.inline(F.transform("_hits", reference)))


def governed_files(texts: DataFrame) -> DataFrame:
    """The files whose references are governed. What other documents say is history and stays."""
    return require(texts, "path").filter(is_governed(F.col("path")))


def is_governed(path: Column) -> Column:
    """Whether a file has references that are governed."""
    return path.isin(*GOVERNED_FILES) | path.rlike(GOVERNED_WORKFLOWS)


def read_org_config(settings: DataFrame) -> DataFrame:
    """The owner declarations in a settings text, null where a key is missing.

    Works on the raw text, as the rewrite does, so that both see the same. The first of repeated keys counts.
    """
    others = [c for c in require(settings, "text").columns if c != "text"]

    def declared(key: str) -> Column:
        pattern = DECLARATION.format(key=key)
        return F.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, 1))

    return settings.select(
        *others,
        declared("github_org").alias("owner_org"),
        declared("tooling_org").alias("tooling_org"),
        declared("tooling_repo").alias("tooling_repo"),
    )


def filled(text: Column) -> Column:
    """`text`, or null if it is empty. An empty declaration counts as none."""
    return F.when(text != "", text)


def role_expected(role: Column, owner: Column, tooling: Column) -> Column:
    """The owner a reference of this role must name; tooling follows the owner unless declared."""
    return F.when(role == TOOLING_ROLE, F.coalesce(filled(tooling), owner)).otherwise(owner)


def third_party_filter(tooling_repo: Column) -> Column:
    """Whether a reference is governed: tooling references to another repository are not."""
    return (
        (F.col("role") != TOOLING_ROLE)
        | F.col("target_repo").isNull()
        | (F.col("target_repo") == tooling_repo)
    )


def one_setting(config: DataFrame, *columns: str) -> DataFrame:
    """One row (repo, *columns) per repository. Equal rows are one; a repository with differing rows is an error.

    A second row would multiply every reference of the repository.
    """
    settings = F.struct(*columns)
    error = F.raise_error(F.concat(F.lit("more than one settings row for repository "), F.col("repo").cast("string")))
    return (
        require(config, "repo", *columns)
        .groupBy("repo")
        .agg(F.min(settings).alias("least"), F.max(settings).alias("most"))
        .select("repo", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(error.cast(config.select(settings).schema[0].dataType)).alias("one"))
        .select("repo", "one.*")
    )


def reference_audit(refs: DataFrame, config: DataFrame, default_tooling_repo: str) -> DataFrame:
    """The governed references, the owner each must name, and whether it names another.

    `config` has one row per repository, which is checked. It is joined once for filter and check.
    """
    require(refs, "repo", "role", "org", "target_repo")
    settings = one_setting(config, "owner_org", "tooling_org", "tooling_repo")
    expected = role_expected(F.col("role"), F.col("owner_org"), F.col("tooling_org"))
    repo_name = F.coalesce(filled(F.col("tooling_repo")), F.lit(default_tooling_repo))
    return (
        refs.join(settings, "repo", "left")
        .filter(third_party_filter(repo_name))
        .select(*refs.columns, expected.alias("expected"))
        .withColumn("drifts", ~F.col("org").eqNullSafe(F.col("expected")))
    )


def reference_drift(audit: DataFrame) -> DataFrame:
    """The references that do not name the owner they must."""
    return require(audit, "drifts").filter("drifts").drop("drifts")


def reference_counts(refs: DataFrame, by: tuple[str, ...] = ("role",)) -> DataFrame:
    """How many references each role has."""
    return require(refs, *by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def plan_moves(
    config: DataFrame,
    owner: str | None = None,
    tooling: str | None = None,
    source: str | None = None,
) -> DataFrame:
    """(repo, role, old_org, new_org): which role moves from which owner to which.

    Without a declared tooling owner, moving the owner moves the tooling too, because tooling follows the
    owner. `source` replaces the declared owner, for a repository that declares none yet. A repository with
    neither has no owner to move from: nothing of it moves, and its rows have a null `old_org`.
    """
    if not (owner or tooling):
        raise ValueError("give an owner or a tooling owner to move to")
    require(config, "repo", "owner_org", "tooling_org", "tooling_repo")
    old_owner = F.lit(source) if source else F.col("owner_org")
    old_tooling = F.when(old_owner.isNotNull(), F.coalesce(filled(F.col("tooling_org")), old_owner))
    moves = []
    if owner:
        moves.append(F.struct(
            F.lit(OWNER_ROLE).alias("role"), old_owner.alias("old_org"), F.lit(owner).alias("new_org")))
    if tooling:
        moves.append(F.struct(
            F.lit(TOOLING_ROLE).alias("role"), old_tooling.alias("old_org"), F.lit(tooling).alias("new_org")))
    else:
        moves.append(F.when(F.col("tooling_org").isNull(), F.struct(
            F.lit(TOOLING_ROLE).alias("role"), old_tooling.alias("old_org"), F.lit(owner).alias("new_org"))))
    return config.select("repo", F.inline(F.array_compact(F.array(*moves))))


def moved_config(
    config: DataFrame, owner: str | None = None, tooling: str | None = None, source: str | None = None
) -> DataFrame:
    """The declarations after a move. What is given is declared, even if it equals the old value.

    Where neither an owner is declared nor `source` is given, the move is refused and the row stays as it is.
    """
    require(config, "repo", "owner_org", "tooling_org", "tooling_repo")
    moves = F.coalesce(F.lit(source), F.col("owner_org")).isNotNull()

    def after(new: str | None, column: str) -> Column:
        return (F.when(moves, F.lit(new)).otherwise(F.col(column)) if new else F.col(column)).alias(column)

    return config.select(
        "repo",
        after(owner, "owner_org"),
        after(tooling, "tooling_org"),
        "tooling_repo",
    )


def moves_by_repo(moves: DataFrame, config: DataFrame, default_tooling_repo: str) -> DataFrame:
    """One row per repository with the old and new owner of each role, for a single join with the texts."""
    def of(role: str, column: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(column))).alias(f"{role}_{column}")

    pairs = [of(role, c) for role in (OWNER_ROLE, TOOLING_ROLE) for c in ("old_org", "new_org")]
    repo_name = F.coalesce(filled(F.col("tooling_repo")), F.lit(default_tooling_repo))
    wide = require(moves, "repo", "role", "old_org", "new_org").groupBy("repo").agg(*pairs)
    return wide.join(one_setting(config, "tooling_repo").select("repo", repo_name.alias("governed_repo")), "repo", "left")


def reference_rewrite(
    texts: DataFrame,
    moves: DataFrame,
    config: DataFrame,
    default_tooling_repo: str,
    patterns: Sequence[ReferencePattern] = REFERENCE_PATTERNS,
) -> DataFrame:
    """The texts with the moved owners replaced, and whether each changed.

    Only the owner in a governed reference changes, and only where it is the old owner of a role that
    moves. The search is the one of `reference_extract` and knows no owner; the text is then put together again from the
    stretches between owners, which stay as they are, and the owners, old or new. All texts are kept, so the result can
    replace the table. A null text stays null and has not moved.
    """
    columns = require(texts, "repo", "text").columns
    settings = moves_by_repo(moves, config, default_tooling_repo)
    found = with_hits(texts, patterns).join(settings, "repo", "left")
    is_tooling = F.array(*[F.lit(p.role == TOOLING_ROLE) for p in patterns])
    governs = F.array(*[F.lit(p.role == TOOLING_ROLE and bool(p.repo)) for p in patterns])

    def moved(hit: Column) -> Column:
        of = lambda c: F.when(
            F.element_at(is_tooling, hit["pattern"]), F.col(f"{TOOLING_ROLE}_{c}")
        ).otherwise(F.col(f"{OWNER_ROLE}_{c}"))
        own = ~F.element_at(governs, hit["pattern"]) | (hit["repo"] == F.col("governed_repo"))
        return F.when(own & (hit["org"] == of("old_org")), of("new_org"))

    part = lambda hit: F.concat(hit["stretch"], hit["before"], F.coalesce(moved(hit), hit["org"]))
    pieces = F.concat(F.transform("_hits", part), F.slice("_fields", -1, 1))
    spliced = found.withColumn("_spliced", F.when(F.size("_hits") > 0, unescaped(F.array_join(pieces, ""))).otherwise(F.col("text")))
    return spliced.select(
        *[F.col("_spliced").alias("text") if c == "text" else c for c in columns],
        F.coalesce(F.col("_spliced") != F.col("text"), F.lit(False)).alias("moved"),
    )


def references_moved(
    refs: DataFrame, moves: DataFrame, config: DataFrame, default_tooling_repo: str
) -> DataFrame:
    """The references a rewrite touches, with their new owner."""
    settings = moves_by_repo(moves, config, default_tooling_repo)
    of = lambda c: F.when(F.col("role") == TOOLING_ROLE, F.col(f"{TOOLING_ROLE}_{c}")).otherwise(
        F.col(f"{OWNER_ROLE}_{c}"))
    return (
        refs.join(settings, "repo")
        .filter(third_party_filter(F.col("governed_repo")))
        .filter((F.col("org") == of("old_org")) & (of("old_org") != of("new_org")))
        .withColumn("org", of("new_org"))
        .select(*refs.columns)
    )
