"""Owner verdicts and moves from files alone."""

import pytest

from driftgate import model
from driftgate.plans.owners import declared_config, owner_move, owner_plan

from .conftest import rows

FILES = [
    (1, "pyproject.toml", 'github_org = "mint"\ndep = "x @ git+https://github.com/mint/press@v1"\n'),
    (1, "CODEOWNERS", "* @mint/growers\n"),
    (1, "docs/notes.md", 'github_org = "sage"\n* @sage/pickers\n'),
    (2, "pyproject.toml", 'github_org = "mint"\ntooling_org = "sage"\n'),
    (2, ".github/workflows/a.yml", "jobs:\n  uses: mint/press/.github/workflows/x.yml@v1\n"),
    (3, "CODEOWNERS", 'github_org = "mint"\n* @mint/growers\n'),
    (4, "src/a.py", "@mint/growers"),
    (5, "pyproject.toml", None),
    (5, None, "@mint/growers"),
]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(FILES, model.TEXTS_SCHEMA)


def test_only_the_settings_file_declares(texts):
    assert rows(declared_config(texts)) == [
        (1, "mint", None, None), (2, "mint", "sage", None), (3, None, None, None), (4, None, None, None), (5, None, None, None)]


def test_verdicts_come_from_governed_files(texts):
    found = rows(owner_plan(texts, "press"), "repo", "n_owner", "n_tooling", "n_drifting", "status")
    assert found == [
        (1, 2, 1, 0, "ok"), (2, 1, 2, 1, "drift"), (3, 2, 0, 2, "undeclared"), (4, 0, 0, 0, "undeclared"), (5, 0, 0, 0, "undeclared")]


def test_a_move_changes_governed_files_of_declaring_repositories(texts):
    moved = {(r["repo"], r["path"]): (r["text"], r["moved"]) for r in owner_move(texts, "press", owner="dill").collect()}
    assert len(moved) == len(FILES)
    for repo, path, text in FILES:
        changes = (repo, path) in {(1, "pyproject.toml"), (1, "CODEOWNERS"), (2, "pyproject.toml")}
        assert moved[repo, path] == (text.replace("mint", "dill") if changes else text, changes)


def test_two_settings_files_that_differ_fail(spark, texts):
    second = spark.createDataFrame([(1, "pyproject.toml", 'github_org = "else"')], model.TEXTS_SCHEMA)
    with pytest.raises(Exception, match="more than one settings row"):
        owner_plan(texts.unionAll(second), "press").collect()
