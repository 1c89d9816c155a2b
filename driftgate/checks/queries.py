"""One query per operator, each over whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.checks.views import (
    DESTROY,
    INACTIVE,
    TOOLING_REPO,
    URL_OWNERS,
    URL_PATTERNS,
    Views,
)
from driftgate.functions.names import name_parts, schema_of_name
from driftgate.model import BASE, HEAD, NOTICE, PIPELINES, RECREATE_FIELDS
from driftgate.operators import audit, diff, gate, inventory, refs, revisions
from driftgate.plans.destructive import destructive_gate, pair_gate, resource_findings, table_findings
from driftgate.plans.lock import lock_gate, stored_lock_gate
from driftgate.plans.owners import move_status, owner_gate, owner_move, owner_plan
from driftgate.plans.schemas import schema_gate
from driftgate.session import shared_folder
from driftgate.sources import store
from driftgate.sources.inventory import (
    explode_files,
    files_outside,
    inventory_names,
    resolved_files,
    resources_by_kind,
)

LABELS = {"destroy_label": DESTROY, "inactive_label": INACTIVE}


# Shared inputs -------------------------------------------------------------------------------------


def classified(v: Views) -> DataFrame:
    return diff.removed_classified(diff.removed_tables(v.declared_rows), v.retired)


def findings(v: Views) -> DataFrame:
    """Removed names with their severity, and a notice where there is no inventory at head."""
    with_head = v.inventories.filter(F.col("rev") == HEAD).select("repo").distinct()
    notices = v.repos.join(with_head, "repo", "left_anti").select(
        "repo",
        F.lit(NOTICE).alias("severity"),
        F.lit("no inventory at head").alias("item"),
        F.lit(None).cast("string").alias("detail"),
    )
    tables = classified(v).select(
        "repo", "severity", F.col("name").alias("item"), F.col("reason").alias("detail")
    )
    return tables.unionByName(notices)


def declared(v: Views) -> DataFrame:
    return audit.declared_union(v.declared_rows, v.retired)


def writes(v: Views) -> DataFrame:
    return audit.statement_writes(v.statements)


def code_writes(v: Views) -> DataFrame:
    """Writes in statements and in calls."""
    return filed_writes(v).drop("path")


def filed_writes(v: Views) -> DataFrame:
    """The same with the file each stands in."""
    columns = ("event_id", "repo", "path", *audit.WRITE_COLUMNS)
    calls = audit.writer_calls(v.event_calls).withColumn("path", v.event_path).select(*columns)
    return audit.statement_writes(v.filed_statements).select(*columns).unionByName(calls)


def url_refs(v: Views) -> DataFrame:
    return refs.reference_extract(v.urls, URL_PATTERNS)


def url_audit(v: Views) -> DataFrame:
    return refs.reference_audit(url_refs(v), v.org_config, TOOLING_REPO)


def all_findings(v: Views) -> DataFrame:
    """What the whole gate finds: resources and tables."""
    tables = table_findings(v.repos, v.declared_rows, v.inventories, v.retired)
    return resource_findings(v.resources).unionByName(tables)


def whole_gate(v: Views, mode: str) -> DataFrame:
    labels = gate.label_set(v.labels)
    return destructive_gate(v.repos, v.inventories, all_findings(v), labels, mode, **LABELS)


# Queries -------------------------------------------------------------------------------------------


def qualify_name(v: Views) -> DataFrame:
    return v.named


def read_inventory(v: Views) -> DataFrame:
    return inventory_names(v.table("documents"), text="text")


def explode_pipeline_files(v: Views) -> DataFrame:
    path = F.concat(F.lit("pipelines/"), F.col("l_partkey"), F.lit(".py"))
    extra = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("lib/"), F.col("l_suppkey")))
    pipelines = v.table("lineitem").select(
        F.col("l_suppkey").alias("repo"),
        F.col("l_orderkey").alias("key"),
        F.array(path, extra, F.lit("")).alias("files"),
    )
    return explode_files(pipelines)


def kinds(v: Views) -> DataFrame:
    return resources_by_kind(v.resources, PIPELINES).select("repo", "rev", "kind", "key", "file_order")


def lock_inventory(v: Views) -> DataFrame:
    names = inventory.declared_inventory(v.files, v.calls, on=("path",))
    return names.filter(F.col("rev") == HEAD).select("repo", "name")


def provider_inventory(v: Views) -> DataFrame:
    """Repositories of some nations take their names from a provider in place of the scan."""
    providers = v.repos.filter(F.col("s_nationkey") < 8)
    part = v.table("part")
    provided = part.select(
        (F.col("p_partkey") % 100).alias("repo"),
        F.lit(HEAD).alias("rev"),
        F.concat(F.lit("{catalog}.finance."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"),
    ).distinct()
    return inventory.with_provider(v.named, provided, providers)


def lock_drift(v: Views) -> DataFrame:
    return diff.inventory_drift(v.declared_rows)


def removed_tables(v: Views) -> DataFrame:
    return diff.removed_tables(v.declared_rows)


def last_definition(v: Views) -> DataFrame:
    return inventory.last_definition(v.resource_files, ("rev", "key"), RECREATE_FIELDS)


def resource_removed(v: Views) -> DataFrame:
    return diff.resource_removed(v.resource_files, keys=("key",))


def resource_removed_by_kind(v: Views) -> DataFrame:
    return diff.resource_removed(v.resources)


def recreate_fields(v: Views) -> DataFrame:
    return diff.recreate_fields(v.resource_files, keys=("key",))


def recreate_typed(v: Views) -> DataFrame:
    """Changed settings, compared by type and value."""
    return diff.recreate_fields(v.typed_resources, keys=("key",), typed=True)


def pair_removed(v: Views) -> DataFrame:
    return revisions.pair_removed(v.dated_rows, v.pairs)


def pair_drift(v: Views) -> DataFrame:
    return revisions.pair_drift(v.dated_rows, v.pairs)


def pair_guard(v: Views) -> DataFrame:
    return revisions.pair_guard(v.pairs, v.dated_files, v.dated_inventories)


def whole_pair_gate(v: Views) -> DataFrame:
    """Every pair of revisions: resources, tables, labels."""
    return pair_gate(
        v.pairs, v.dated_files, v.dated_inventories, v.dated_rows, v.retired, v.dated_resources, gate.label_set(v.labels), **LABELS
    )


def resolved_inventory(v: Views) -> DataFrame:
    """Names declared in files that pipelines load by relative paths."""
    return inventory.declared_inventory(resolved_files(v.relative_files), v.code_calls, on=("path",))


def outside_files(v: Views) -> DataFrame:
    return files_outside(v.relative_files)


def revision_guard(v: Views) -> DataFrame:
    return diff.revision_guard(v.repos, v.inventories)


def severity_rollup(v: Views) -> DataFrame:
    return gate.severity_rollup(findings(v))


def label_set(v: Views) -> DataFrame:
    return gate.label_set(v.labels)


def gate_decision(v: Views, mode: str = "pr") -> DataFrame:
    return gate.gate_decision(findings(v), gate.label_set(v.labels), mode, **LABELS)


def gate_report(v: Views) -> DataFrame:
    return gate_decision(v, "report")


def gate_flags(v: Views) -> DataFrame:
    return gate.flags(v.repos, gate_decision(v))


def finding_report(v: Views) -> DataFrame:
    return gate.finding_report(findings(v))


def finding_report_pages(v: Views) -> DataFrame:
    return gate.finding_report(findings(v), page_lines=50)


def report_lines(v: Views) -> DataFrame:
    return gate.report_lines(v.repos, findings(v), gate.label_set(v.labels), **LABELS)


def malformed_names(v: Views) -> DataFrame:
    return audit.malformed_names(declared(v))


def schema_of_names(v: Views) -> DataFrame:
    name = F.col("name")
    return declared(v).select("name").distinct().select(
        "name", name_parts(name).alias("parts"), schema_of_name(name).alias("schema_name")
    )


def allowed_schemas(v: Views) -> DataFrame:
    return audit.allowed_schemas(v.schema_config)


def allowed_declared(v: Views) -> DataFrame:
    return audit.allowed_declared(v.schema_config)


def outside_schema(v: Views) -> DataFrame:
    return audit.outside_schema(declared(v), v.allowed)


def distinct_files(v: Views) -> DataFrame:
    return inventory.distinct_files(v.files)


def declaration_calls(v: Views) -> DataFrame:
    return inventory.declaration_calls(v.event_calls).select("event_id", "method", "name_literal")


def dynamic_names(v: Views) -> DataFrame:
    return inventory.dynamic_names(v.event_calls, by=("user_id",))


def statement_writes(v: Views) -> DataFrame:
    return writes(v).select("event_id", "verb", "dest")


def document_writes(v: Views) -> DataFrame:
    """Long texts with a write at either end, searched whole."""
    lang = F.col("lang")
    sql = F.concat(
        F.lit("insert into "), lang, F.lit(".docs select "), F.col("text"),
        F.lit(" ; drop table if exists c."), lang, F.lit(".old"),
    )
    texts = v.table("documents").select("doc_id", sql.alias("sql"))
    return audit.statement_writes(texts).select("doc_id", "verb", "dest")


def statement_violations(v: Views) -> DataFrame:
    return audit.statement_violations(writes(v), v.allowed).select(
        "event_id", "verb", "dest", "schema_name"
    )


def statement_unresolved(v: Views) -> DataFrame:
    return audit.statement_unresolved(writes(v)).select("event_id", "verb", "dest")


def loaded_statements(v: Views) -> DataFrame:
    return audit.in_loaded_files(v.filed_statements, v.files).select("event_id", "repo", "path")


def writer_calls(v: Views) -> DataFrame:
    return audit.writer_calls(v.event_calls).select("event_id", "repo", "verb", "dest", "dynamic")


def code_violations(v: Views) -> DataFrame:
    return audit.statement_violations(code_writes(v), v.allowed)


def code_unresolved(v: Views) -> DataFrame:
    return audit.statement_unresolved(code_writes(v))


def line_matches(v: Views) -> DataFrame:
    return refs.line_matches(v.table("documents"), r"(?i)\b(license)\b", needle="license")


def reference_extract(v: Views) -> DataFrame:
    return url_audit(v).select("page_id", "role", "org", "target_repo")


def reference_drift(v: Views) -> DataFrame:
    return refs.reference_drift(url_audit(v)).select("page_id", "role", "org", "expected")


def reference_counts(v: Views) -> DataFrame:
    return refs.reference_counts(url_audit(v))


def reference_lines(v: Views) -> DataFrame:
    return refs.reference_extract(v.config_texts).drop("repo", "matched")


def reference_matches(v: Views) -> DataFrame:
    """The matched text of every reference."""
    return refs.reference_extract(v.config_texts).select("page_id", "line", "kind", "matched")


def governed_files(v: Views) -> DataFrame:
    return refs.governed_files(v.filed_texts).select("page_id", "path")


def read_org_config(v: Views) -> DataFrame:
    return refs.read_org_config(v.config_texts)


def reference_rewrite(v: Views) -> DataFrame:
    moves = refs.plan_moves(v.org_config, owner="neworg")
    new = refs.reference_rewrite(v.urls, moves, v.org_config, TOOLING_REPO, URL_OWNERS)
    return new.select("page_id", F.col("text").alias("url"))


def plan_moves(v: Views) -> DataFrame:
    return refs.plan_moves(v.mixed_config, owner="neworg")


def plan_moves_split(v: Views) -> DataFrame:
    return refs.plan_moves(v.mixed_config, owner="neworg", tooling="newtools", source="tionsh")


def moved_config(v: Views) -> DataFrame:
    return refs.moved_config(v.mixed_config, owner="neworg")


def moved_config_source(v: Views) -> DataFrame:
    return refs.moved_config(v.mixed_config, owner="neworg", tooling="newtools", source="tionsh")


def plan_moves_tooling(v: Views) -> DataFrame:
    return refs.plan_moves(v.mixed_config, tooling="newtools")


def text_rewrite(v: Views) -> DataFrame:
    moves = refs.plan_moves(v.mixed_config, owner="neworg")
    return refs.reference_rewrite(v.config_texts, moves, v.mixed_config, TOOLING_REPO).drop("repo")


def references_moved(v: Views) -> DataFrame:
    moves = refs.plan_moves(v.mixed_config, owner="neworg")
    found = refs.reference_extract(v.config_texts)
    moved = refs.references_moved(found, moves, v.mixed_config, TOOLING_REPO)
    return moved.select("page_id", "line", "kind", "org")


def resource_finding_rows(v: Views) -> DataFrame:
    return resource_findings(v.resources).select("repo", "severity", "kind", "item", "detail")


def table_finding_rows(v: Views) -> DataFrame:
    rows = table_findings(v.repos, v.declared_rows, v.inventories, v.retired)
    return rows.select("repo", "severity", "kind", "item", "detail")


def whole_gate_pr(v: Views) -> DataFrame:
    return whole_gate(v, "pr")


def whole_gate_report(v: Views) -> DataFrame:
    return whole_gate(v, "report")


def incomplete_files(v: Views) -> DataFrame:
    return inventory.incomplete_files(v.files, v.mixed_calls, v.providers, on=("path",))


def whole_lock_gate(v: Views) -> DataFrame:
    return lock_gate(v.repos, v.inventories, v.declared_rows, stored=BASE, expected=HEAD, incomplete=incomplete_files(v))


def published(v: Views) -> str:
    """Store the base inventories, of some repositories those of head in their place, and of some none at all."""
    path = f"{shared_folder(v.spark)}/inventories-{uuid.uuid4().hex}"
    scope = v.repos.withColumn("rev", F.lit(BASE))
    store.publish(v.declared_rows.filter(F.col("rev") == BASE), scope.filter("s_nationkey % 5 != 0"), path)
    changed = v.declared_rows.filter(F.col("rev") == HEAD).withColumn("rev", F.lit(BASE))
    store.publish(changed, scope.filter("s_nationkey % 5 = 1"), path)
    store.publish(changed.limit(0), scope.filter("s_nationkey % 5 = 2"), path)
    return path


def stored_names(v: Views) -> DataFrame:
    """What is read back after two replacements."""
    return store.stored_names(v.spark, published(v))


def stored_manifest(v: Views) -> DataFrame:
    """Which inventories there are, empty ones among them."""
    return store.manifest(v.spark, published(v)).select("repo", "rev", "n_names")


def whole_stored_lock_gate(v: Views) -> DataFrame:
    return stored_lock_gate(v.repos, v.declared_rows, published(v))


def given_scope(v: Views) -> DataFrame:
    """Names under scopes that are absent, null, or written."""
    return inventory.declared_inventory(v.given_files, v.calls.drop("catalog_ref", "schema_ref"), on=("path",))


def keyword_writers(v: Views) -> DataFrame:
    return audit.writer_calls(v.keyword_calls).select("event_id", "repo", "verb", "dest", "dynamic")


def whole_schema_gate(v: Views) -> DataFrame:
    return schema_gate(v.repos, v.schema_config, declared(v), filed_writes(v), v.files)


def whole_owner_gate(v: Views) -> DataFrame:
    return owner_gate(v.mixed_config, url_refs(v), TOOLING_REPO)


def whole_owner_plan(v: Views) -> DataFrame:
    """Verdicts from files alone."""
    return owner_plan(v.repo_texts, TOOLING_REPO)


def whole_owner_move(v: Views) -> DataFrame:
    """Every file after its repository's owner has moved."""
    return owner_move(v.repo_texts, TOOLING_REPO, owner="neworg")


def whole_move_status(v: Views) -> DataFrame:
    return move_status(v.mixed_config)


QUERIES: dict[str, Callable[[Views], DataFrame]] = {
    "qualify_name": qualify_name,
    "read_inventory": read_inventory,
    "explode_files": explode_pipeline_files,
    "resources_by_kind": kinds,
    "lock_inventory": lock_inventory,
    "provider_inventory": provider_inventory,
    "lock_drift": lock_drift,
    "removed_tables": removed_tables,
    "removed_classified": classified,
    "last_definition": last_definition,
    "resource_removed": resource_removed,
    "resource_removed_by_kind": resource_removed_by_kind,
    "recreate_fields": recreate_fields,
    "recreate_typed": recreate_typed,
    "revision_guard": revision_guard,
    "pair_removed": pair_removed,
    "pair_drift": pair_drift,
    "pair_guard": pair_guard,
    "pair_gate": whole_pair_gate,
    "resolved_inventory": resolved_inventory,
    "files_outside": outside_files,
    "severity_rollup": severity_rollup,
    "label_set": label_set,
    "gate_decision": gate_decision,
    "gate_report": gate_report,
    "gate_flags": gate_flags,
    "finding_report": finding_report,
    "finding_report_pages": finding_report_pages,
    "report_lines": report_lines,
    "declared_union": declared,
    "malformed_names": malformed_names,
    "schema_of_name": schema_of_names,
    "allowed_schemas": allowed_schemas,
    "allowed_declared": allowed_declared,
    "outside_schema": outside_schema,
    "distinct_files": distinct_files,
    "declaration_calls": declaration_calls,
    "dynamic_names": dynamic_names,
    "statement_writes": statement_writes,
    "document_writes": document_writes,
    "statement_violations": statement_violations,
    "statement_unresolved": statement_unresolved,
    "loaded_statements": loaded_statements,
    "writer_calls": writer_calls,
    "code_violations": code_violations,
    "code_unresolved": code_unresolved,
    "line_matches": line_matches,
    "reference_extract": reference_extract,
    "reference_drift": reference_drift,
    "reference_counts": reference_counts,
    "reference_lines": reference_lines,
    "reference_matches": reference_matches,
    "governed_files": governed_files,
    "read_org_config": read_org_config,
    "reference_rewrite": reference_rewrite,
    "plan_moves": plan_moves,
    "plan_moves_split": plan_moves_split,
    "plan_moves_tooling": plan_moves_tooling,
    "moved_config": moved_config,
    "moved_config_source": moved_config_source,
    "text_rewrite": text_rewrite,
    "references_moved": references_moved,
    "resource_findings": resource_finding_rows,
    "table_findings": table_finding_rows,
    "destructive_gate": whole_gate_pr,
    "destructive_gate_report": whole_gate_report,
    "lock_gate": whole_lock_gate,
    "stored_lock_gate": whole_stored_lock_gate,
    "stored_names": stored_names,
    "stored_manifest": stored_manifest,
    "incomplete_files": incomplete_files,
    "given_scope": given_scope,
    "keyword_writers": keyword_writers,
    "schema_gate": whole_schema_gate,
    "owner_gate": whole_owner_gate,
    "owner_plan": whole_owner_plan,
    "owner_move": whole_owner_move,
    "move_status": whole_move_status,
}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """The named query over the tables in `folder`."""
    return QUERIES[name](Views(spark, folder))
