"""The results of the queries, stated independently as DuckDB SQL over the same tables."""

from __future__ import annotations

# Fixed value: statements that write.
WRITE = (
    r"(?i)\b(INSERT\s+INTO|INSERT\s+OVERWRITE(?:\s+TABLE)?|CREATE\s+(?:OR\s+REPLACE\s+)?"
    r"(?:EXTERNAL\s+)?(?:TABLE|VIEW)(?:\s+IF\s+NOT\s+EXISTS)?|MERGE\s+INTO|UPDATE|"
    r"DELETE\s+FROM|DROP\s+TABLE(?:\s+IF\s+EXISTS)?|TRUNCATE\s+TABLE|ALTER\s+TABLE)"
    r"\s+([A-Za-z0-9_.`{}]+)"
)
HOST = r"^https?://(?:([a-z]+)\.)?([a-z]+)\.example\.([a-z]+)/"
ORG = r"([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)"

# Inputs, each a common table expression.
VIEWS = {
    "decl": r"""
        SELECT l_suppkey AS repo, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'base' ELSE 'head' END AS rev,
               CASE p_size WHEN 1 THEN NULL WHEN 3 THEN '${bundle.target}'
                           ELSE '${var.catalog_' || lower(p_type) || '}' END AS catalog_ref,
               CASE WHEN p_size = 2 THEN NULL ELSE lower(replace(p_brand, '#', '_')) END AS schema_ref,
               replace(p_name, ' ', '_') AS table_name
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "named": r"""
        SELECT DISTINCT repo, rev,
               regexp_replace(coalesce(catalog_ref, '{catalog}'), '^\$\{(var\.)?(.*)\}$', '{\2}')
               || '.' || coalesce(schema_ref, 'default') || '.' || table_name AS name FROM decl""",
    "retired": r"""
        SELECT DISTINCT repo, name, 'retired: old catalog' AS reason FROM named
        WHERE name LIKE '{catalog_economy}.%'""",
    "seen": "SELECT repo, rev FROM named WHERE name LIKE '%.brand_7.cold%'",
    "allowed": r"""
        SELECT s_suppkey AS repo, b AS schema_name
        FROM supplier, (SELECT DISTINCT lower(replace(p_brand, '#', '_')) AS b FROM part)
        WHERE (length(b) + s_nationkey) % 2 = 0""",
    "brand": "SELECT 'brand_' || i AS b FROM range(1, 26) t(i)",
    "schema_list": r"""
        SELECT s_suppkey AS repo, s_nationkey % 4 AS kase,
               CASE s_nationkey % 4 WHEN 0 THEN NULL WHEN 2 THEN []
                    WHEN 1 THEN (SELECT list(b) FROM brand WHERE length(b) % 2 = 1)
                    ELSE (SELECT list(b) FROM (SELECT b FROM brand UNION ALL VALUES ('default'), ('hr'), ('sales')))
               END AS schemas FROM supplier""",
    "list_allowed": "SELECT DISTINCT repo, unnest(schemas) AS schema_name FROM schema_list",
    "res_file": r"""
        SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'base' ELSE 'head' END AS rev, o_custkey AS key,
               o_orderkey AS file_order, o_orderpriority AS catalog, o_orderstatus AS schema,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS target,
               CAST(month(o_orderdate) AS VARCHAR) AS storage, CAST(o_totalprice > 250000 AS VARCHAR) AS serverless,
               o_custkey % 10 AS repo, CASE WHEN o_custkey % 4 = 0 THEN 'jobs' ELSE 'pipelines' END AS kind
        FROM orders""",
    "res": r"""
        SELECT rev, key, repo, kind, catalog, schema, target, storage, serverless FROM
          (SELECT *, row_number() OVER (PARTITION BY rev, key ORDER BY file_order DESC) AS rn FROM res_file)
        WHERE rn = 1""",
    "long": r"""
        SELECT rev, key, repo, kind, 'catalog' AS field, catalog AS v FROM res
        UNION ALL SELECT rev, key, repo, kind, 'schema', schema FROM res
        UNION ALL SELECT rev, key, repo, kind, 'target', target FROM res
        UNION ALL SELECT rev, key, repo, kind, 'storage', storage FROM res
        UNION ALL SELECT rev, key, repo, kind, 'serverless', serverless FROM res""",
    "changed": r"""
        SELECT key, any_value(repo) AS repo, any_value(kind) AS kind, field, max(v) FILTER (WHERE rev = 'base') AS old_value,
               max(v) FILTER (WHERE rev = 'head') AS new_value FROM long GROUP BY key, field
        HAVING count(DISTINCT rev) = 2 AND old_value IS DISTINCT FROM new_value""",
    "typed": r"""
        SELECT * FROM (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'base' ELSE 'head' END AS rev, o_custkey AS key,
               ['1', '1', '"1"', 'true', '{"a":[1,2],"b":"x.0"}', '{"a":[1,2],"b":"x.0"}'][o_orderkey % 6 + 1] AS catalog,
               ['[1,2]', '[2,1]', NULL, NULL][o_orderkey % 4 + 1] AS schema, ['100', '100', '100.5'][o_orderkey % 3 + 1] AS storage,
               CASE WHEN o_totalprice > 250000 THEN 'true' ELSE '"true"' END AS serverless,
               row_number() OVER (PARTITION BY o_custkey, o_orderdate < TIMESTAMP '1998-01-01' ORDER BY o_orderkey DESC) AS rn
        FROM orders) WHERE rn = 1""",
    "typed_long": r"""
        SELECT rev, key, 'catalog' AS field, catalog AS v FROM typed UNION ALL SELECT rev, key, 'schema', schema FROM typed
        UNION ALL SELECT rev, key, 'storage', storage FROM typed UNION ALL SELECT rev, key, 'serverless', serverless FROM typed""",
    "dated": r"""
        SELECT DISTINCT l_suppkey AS repo, 'y' || year(l_shipdate) AS rev,
               regexp_replace(coalesce(CASE p_size WHEN 1 THEN NULL WHEN 3 THEN '${bundle.target}'
                 ELSE '${var.catalog_' || lower(p_type) || '}' END, '{catalog}'), '^\$\{(var\.)?(.*)\}$', '{\2}')
               || '.' || CASE WHEN p_size = 2 THEN 'default' ELSE lower(replace(p_brand, '#', '_')) END
               || '.' || replace(p_name, ' ', '_') AS name
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "pair": r"""
        SELECT s_suppkey AS repo, CASE WHEN s_nationkey % 7 = 0 THEN 'lost' ELSE 'y' || (1993 + s_nationkey % 4) END AS base_rev,
               'y1997' AS head_rev FROM supplier
        UNION ALL SELECT s_suppkey, 'y1994', 'y1995' FROM supplier WHERE s_suppkey % 3 = 0""",
    "read_rev": "SELECT DISTINCT l_suppkey AS repo, 'y' || year(l_shipdate) AS rev FROM lineitem",
    "listed_rev": "SELECT DISTINCT repo, rev FROM dated WHERE name LIKE '%.brand_7.%'",
    "pair_seen": r"""
        SELECT p.*, EXISTS (SELECT 1 FROM read_rev r WHERE r.repo = p.repo AND r.rev = base_rev) AS has_base,
               EXISTS (SELECT 1 FROM read_rev r WHERE r.repo = p.repo AND r.rev = head_rev) AS has_head,
               EXISTS (SELECT 1 FROM listed_rev r WHERE r.repo = p.repo AND r.rev = base_rev) AS base_listed,
               EXISTS (SELECT 1 FROM listed_rev r WHERE r.repo = p.repo AND r.rev = head_rev) AS head_listed FROM pair p""",
    "pair_gone": r"""
        SELECT p.*, b.name FROM pair p JOIN dated b ON b.repo = p.repo AND b.rev = p.base_rev
        WHERE NOT EXISTS (SELECT 1 FROM dated h WHERE h.repo = p.repo AND h.rev = p.head_rev AND h.name = b.name)""",
    "dated_res": r"""
        SELECT * FROM (SELECT o_custkey % 10 AS repo, 'y' || year(o_orderdate) AS rev, o_custkey AS key,
               CASE WHEN o_custkey % 4 = 0 THEN 'jobs' ELSE 'pipelines' END AS kind, o_orderpriority AS catalog, o_orderstatus AS schema,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS target, CAST(month(o_orderdate) AS VARCHAR) AS storage,
               CAST(o_totalprice > 250000 AS VARCHAR) AS serverless,
               row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    "pair_found": r"""
        SELECT p.repo, p.base_rev, p.head_rev, CASE WHEN b.kind = 'jobs' THEN 'NOTICE' ELSE 'DESTRUCTIVE' END AS severity
        FROM pair_seen p JOIN dated_res b ON has_base AND b.repo = p.repo AND b.rev = p.base_rev
        WHERE NOT EXISTS (SELECT 1 FROM dated_res h WHERE h.key = b.key AND h.rev = p.head_rev)
        UNION ALL SELECT p.repo, p.base_rev, p.head_rev, 'DESTRUCTIVE'
        FROM pair_seen p JOIN dated_res b ON has_base AND b.repo = p.repo AND b.rev = p.base_rev AND b.kind = 'pipelines'
        JOIN dated_res h ON h.key = b.key AND h.rev = p.head_rev,
             (SELECT unnest(['catalog', 'schema', 'target', 'storage', 'serverless']) AS f)
        WHERE CASE f WHEN 'catalog' THEN b.catalog IS DISTINCT FROM h.catalog WHEN 'schema' THEN b.schema IS DISTINCT FROM h.schema
                     WHEN 'target' THEN b.target IS DISTINCT FROM h.target WHEN 'storage' THEN b.storage IS DISTINCT FROM h.storage
                     ELSE b.serverless IS DISTINCT FROM h.serverless END
        UNION ALL SELECT g.repo, g.base_rev, g.head_rev, CASE WHEN r.name IS NULL THEN 'ORPHAN' ELSE 'DESTRUCTIVE' END
        FROM pair_gone g JOIN pair_seen USING (repo, base_rev, head_rev) LEFT JOIN retired r ON r.repo = g.repo AND r.name = g.name
        WHERE has_base AND head_listed
        UNION ALL SELECT repo, base_rev, head_rev, 'NOTICE' FROM pair_seen WHERE has_base AND NOT head_listed""",
    "pair_sum": r"""
        SELECT repo, base_rev, head_rev, count(*) AS n, bool_or(severity = 'DESTRUCTIVE') AS d, bool_or(severity = 'ORPHAN') AS o
        FROM pair_found GROUP BY repo, base_rev, head_rev""",
    "written_file": r"""
        SELECT l_suppkey AS repo, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'base' ELSE 'head' END AS rev, l_partkey AS part,
               ['resources/p.yml', 'resources/more/p.yml', 'p.yml'][l_linenumber % 3 + 1] AS declared_in,
               ['../', './x/../.././', '../..//', '', '/'][l_orderkey % 5 + 1] || 'pipelines/' || l_partkey || '.py' AS written,
               CASE l_orderkey % 5 WHEN 0 THEN [0, 1, -1] WHEN 1 THEN [0, 1, -1] WHEN 2 THEN [-1, 0, -1] WHEN 3 THEN [1, 2, 0]
                    ELSE [-1, -1, -1] END[l_linenumber % 3 + 1] AS folders FROM lineitem""",
    "gone": r"""
        SELECT repo, kind, key FROM res WHERE rev = 'base'
        EXCEPT SELECT repo, kind, key FROM res WHERE rev = 'head'""",
    "removed": r"""
        SELECT repo, name FROM named WHERE rev = 'base' EXCEPT SELECT repo, name FROM named WHERE rev = 'head'""",
    "classified": r"""
        SELECT q.repo, q.name, CASE WHEN r.name IS NULL THEN 'ORPHAN' ELSE 'DESTRUCTIVE' END AS severity, r.reason
        FROM removed q LEFT JOIN retired r ON q.repo = r.repo AND q.name = r.name""",
    "no_head": r"""
        SELECT s_suppkey AS repo FROM supplier
        WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.repo = s_suppkey AND seen.rev = 'head')""",
    "finding": r"""
        SELECT repo, severity, name AS item, reason AS detail FROM classified
        UNION ALL SELECT repo, 'NOTICE', 'no inventory at head', NULL FROM no_head""",
    "label": r"""
        SELECT DISTINCT repo, trim(x) AS label FROM (SELECT s_suppkey AS repo, unnest(string_split(
          CASE s_nationkey % 4 WHEN 0 THEN 'allow-destroy, allow-inactive' WHEN 1 THEN ' allow-inactive ,,'
               WHEN 2 THEN 'other' ELSE '' END, ',')) AS x FROM supplier) WHERE trim(x) <> ''""",
    "decided": r"""
        SELECT f.repo, f.destructive, f.orphaned, (f.destructive AND d.repo IS NULL) AS needs_destroy,
               (f.orphaned AND o.repo IS NULL) AS needs_inactive
        FROM (SELECT repo, bool_or(severity = 'DESTRUCTIVE') AS destructive, bool_or(severity = 'ORPHAN') AS orphaned
              FROM finding GROUP BY repo) f
        LEFT JOIN (SELECT repo FROM label WHERE label = 'allow-destroy') d ON f.repo = d.repo
        LEFT JOIN (SELECT repo FROM label WHERE label = 'allow-inactive') o ON f.repo = o.repo""",
    "declared": r"""
        SELECT repo, name, 'materialize' AS origin FROM named WHERE rev = 'head' UNION SELECT repo, name, 'retire' FROM retired""",
    "stmt": r"""
        SELECT event_id, user_id % 7 AS repo, CASE event_type
          WHEN 'click'    THEN 'INSERT  INTO c.brand_' || (user_id % 5) || '.t SELECT 1'
          WHEN 'view'     THEN 'SELECT * FROM c.hr.t'
          WHEN 'signup'   THEN 'create table if not exists `brand_' || (user_id % 5) || '`.t (a int)'
          WHEN 'purchase' THEN 'MERGE INTO {c}.sales.t USING s ON 1=1; DROP TABLE IF EXISTS hr.t'
          ELSE 'UPDATE t SET a = 1' END AS sql FROM events""",
    "write": rf"""
        SELECT event_id, repo, upper(regexp_replace(v, '\s+', ' ', 'g')) AS verb, replace(t, '`', '') AS dest,
               FALSE AS dynamic
        FROM (SELECT event_id, repo, unnest(regexp_extract_all(sql, '{WRITE}', 1)) AS v,
                     unnest(regexp_extract_all(sql, '{WRITE}', 2)) AS t FROM stmt)""",
    "saved": r"""
        SELECT event_id, user_id % 7 AS repo, 'saveAsTable' AS verb, 'c.brand_' || (user_id % 25) || '.t' AS dest,
               CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 AS dynamic
        FROM events WHERE event_type = 'purchase'""",
    "coded": "SELECT * FROM write UNION ALL SELECT * FROM saved",
    "coded_schema": r"""
        SELECT *, CASE WHEN dynamic OR dest LIKE '%{%' OR dest LIKE '%}%' THEN NULL
                       WHEN len(parts) = 2 THEN parts[1] WHEN len(parts) >= 3 THEN parts[2] END AS schema_name
        FROM (SELECT *, list_filter(string_split(dest, '.'), lambda x: x <> '') AS parts FROM coded)""",
    "ref": rf"""
        SELECT page_id, regexp_extract(url, '{HOST}', 2) AS org, regexp_extract(url, '{HOST}', 3) AS target_repo,
               CASE WHEN url LIKE 'https://%' THEN 'tooling' ELSE 'repo' END AS role, url FROM pages""",
    "governed": r"""
        SELECT page_id, role, org, target_repo, 'tionsh' AS expected FROM ref
        WHERE org <> '' AND (role = 'repo' OR target_repo = 'com')""",
    "owners": r"""
        SELECT s_suppkey AS repo, CASE WHEN s_nationkey % 5 <> 0 THEN 'tionsh' END AS owner_org,
               CASE WHEN s_nationkey % 5 IN (1, 2) THEN 'thther' END AS tooling_org,
               CASE WHEN s_nationkey % 5 = 2 THEN 'com' END AS tooling_repo FROM supplier""",
    "cfg_text": rf"""
        SELECT page_id, page_id % 10 AS repo,
               'jobs:' || chr(10) || chr(10) || '  check:' || chr(10) || '    uses: ' || o || '/' || r
               || '/.github/workflows/ci.yml@v1' || chr(10) || '  steps:' || chr(10)
               || '    - uses: actions/checkout@v4' || chr(10) || 'dev = ["x @ git+https://github.com/' || o || '/' || r
               || '@v1"]' || chr(10) || '* @' || o || '/data @' || o || '/ops' || chr(10) || chr(10)
               || '  github_org = "' || o || '"' || chr(10) || 'tooling_org = "thther"' || chr(10) || '# '
               || html || chr(10) AS text
        FROM (SELECT page_id, html, CASE WHEN page_id % 3 = 0 THEN 'other-ci' ELSE 'shared-ci' END AS r,
                     coalesce(nullif(regexp_extract(url, '{HOST}', 2), ''), 'nobody') AS o FROM pages)""",
    "cfg_line": r"""
        SELECT page_id, repo, unnest(string_split(text, chr(10))) AS l,
               generate_subscripts(string_split(text, chr(10)), 1) AS line FROM cfg_text""",
    "found": rf"""
        SELECT page_id, repo, line, 'tooling' AS role, 'reusable workflow' AS kind,
               unnest(regexp_extract_all(l, '^\s*uses:\s*{ORG}/([\w.-]+)/\.github/workflows/', 1)) AS org,
               unnest(regexp_extract_all(l, '^\s*uses:\s*{ORG}/([\w.-]+)/\.github/workflows/', 2)) AS target_repo
        FROM cfg_line
        UNION ALL SELECT page_id, repo, line, 'tooling', 'git dependency',
               unnest(regexp_extract_all(l, 'git\+https://github\.com/{ORG}/([\w.-]+)', 1)),
               unnest(regexp_extract_all(l, 'git\+https://github\.com/{ORG}/([\w.-]+)', 2)) FROM cfg_line
        UNION ALL SELECT page_id, repo, line, 'repo', 'owner team',
               unnest(regexp_extract_all(l, '@{ORG}/[\w.-]+', 1)), NULL FROM cfg_line
        UNION ALL SELECT page_id, repo, line, 'repo', 'owner declaration',
               unnest(regexp_extract_all(l, '^\s*github_org\s*=\s*"{ORG}"', 1)), NULL FROM cfg_line
        UNION ALL SELECT page_id, repo, line, 'tooling', 'tooling declaration',
               unnest(regexp_extract_all(l, '^\s*tooling_org\s*=\s*"{ORG}"', 1)), NULL FROM cfg_line""",
    "held_name": r"""
        SELECT repo, name FROM named JOIN supplier ON s_suppkey = repo
        WHERE (s_nationkey % 5 IN (3, 4) AND rev = 'base') OR (s_nationkey % 5 = 1 AND rev = 'head')""",
    "file_owner": rf"""
        SELECT p.repo, s.o AS owner_org, CASE WHEN s.o IS NOT NULL THEN 'thther' END AS tooling
        FROM (SELECT DISTINCT page_id // 6 AS repo FROM pages) p LEFT JOIN (
          SELECT page_id // 6 AS repo, coalesce(nullif(regexp_extract(url, '{HOST}', 2), ''), 'nobody') AS o
          FROM pages WHERE page_id % 6 = 0) s USING (repo)""",
    "resource_found": r"""
        SELECT repo, CASE kind WHEN 'pipelines' THEN 'DESTRUCTIVE' ELSE 'NOTICE' END AS severity,
               'resource removed' AS kind, CAST(key AS VARCHAR) AS item,
               CASE kind WHEN 'pipelines' THEN 'its tables are deleted with it' ELSE 'it stops running' END AS detail
        FROM gone
        UNION ALL SELECT repo, 'DESTRUCTIVE', 'resource recreated', key || '.' || field,
               coalesce(old_value, 'None') || ' -> ' || coalesce(new_value, 'None')
        FROM changed WHERE kind = 'pipelines'""",
    "table_found": r"""
        SELECT repo, severity, CASE severity WHEN 'ORPHAN' THEN 'table removed' ELSE 'table retired' END AS kind,
               name AS item, CASE severity WHEN 'ORPHAN' THEN 'becomes inactive' ELSE reason END AS detail
        FROM classified WHERE repo NOT IN (SELECT repo FROM no_head)
        UNION ALL SELECT repo, 'NOTICE', 'inventory missing', 'no inventory at head',
               'removed tables cannot be detected' FROM no_head""",
    "whole": r"""
        SELECT s_suppkey AS repo, EXISTS (SELECT 1 FROM seen WHERE seen.repo = s_suppkey AND rev = 'base') AS has_base,
               coalesce(f.d, FALSE) AS destructive, coalesce(f.o, FALSE) AS orphaned, f.repo IS NULL AS is_clean,
               coalesce(f.d, FALSE) AND NOT EXISTS
                 (SELECT 1 FROM label l WHERE l.repo = s_suppkey AND label = 'allow-destroy') AS needs_destroy,
               coalesce(f.o, FALSE) AND NOT EXISTS
                 (SELECT 1 FROM label l WHERE l.repo = s_suppkey AND label = 'allow-inactive') AS needs_inactive
        FROM supplier LEFT JOIN (
          SELECT repo, bool_or(severity = 'DESTRUCTIVE') AS d, bool_or(severity = 'ORPHAN') AS o
          FROM (SELECT repo, severity FROM resource_found UNION ALL SELECT repo, severity FROM table_found)
          GROUP BY repo) f ON f.repo = s_suppkey""",
}

SECTION = "CASE severity WHEN 'DESTRUCTIVE' THEN 1 WHEN 'ORPHAN' THEN 2 ELSE 3 END"
BLANKS = "concat({})".format(
    ", ".join(
        f"chr({n})"
        for n in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
    )
)


def pages(lines: int) -> str:
    return f"""
        SELECT repo, severity, {SECTION} AS section, page, any_value(total) AS total,
               string_agg(item || coalesce(': ' || detail, ''), chr(10) ORDER BY item, detail) AS detail
        FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY repo, severity ORDER BY item, detail) - 1) / {lines})
                             AS BIGINT) AS page, count(*) OVER (PARTITION BY repo, severity) AS total FROM finding)
        GROUP BY repo, severity, page"""


def verdict(mode: str) -> str:
    blocks = "FALSE" if mode == "report" else "needs_destroy OR needs_inactive"
    return f"""
        SELECT repo, status, CASE WHEN has_base THEN destructive END AS destructive,
               CASE WHEN has_base THEN orphaned END AS orphaned,
               CASE WHEN has_base THEN needs_destroy END AS needs_destroy,
               CASE WHEN has_base THEN needs_inactive END AS needs_inactive,
               CAST(CASE status WHEN 'error' THEN 2 WHEN 'blocked' THEN 1 ELSE 0 END AS BIGINT) AS exit_code
        FROM (SELECT *, CASE WHEN NOT has_base THEN 'error' WHEN is_clean THEN 'clean'
                             WHEN {blocks} THEN 'blocked' ELSE 'accepted' END AS status FROM whole)"""


MOVES_OWNER = r"""
    SELECT repo, 'repo' AS role, owner_org AS old_org, 'neworg' AS new_org FROM owners
    UNION ALL SELECT repo, 'tooling', owner_org, 'neworg' FROM owners WHERE tooling_org IS NULL"""

ORACLE = {
    "qualify_name": "SELECT repo, rev, name FROM named",
    "read_inventory": rf"""
        SELECT DISTINCT name FROM (SELECT trim(l, {BLANKS}) AS name FROM (SELECT unnest(regexp_split_to_array(text,
          '\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85\x{{2028}}\x{{2029}}]')) AS l FROM documents))
        WHERE name <> '' AND name NOT LIKE '#%'""",
    "explode_files": r"""
        SELECT l_suppkey AS repo, l_orderkey AS key, 'pipelines/' || l_partkey || '.py' AS path FROM lineitem
        UNION ALL SELECT l_suppkey, l_orderkey, 'lib/' || l_suppkey FROM lineitem WHERE l_linenumber % 2 = 0""",
    "resources_by_kind": "SELECT repo, rev, kind, key, file_order FROM res_file WHERE kind = 'pipelines'",
    "lock_inventory": "SELECT repo, name FROM named WHERE rev = 'head'",
    "provider_inventory": r"""
        SELECT repo, rev, name FROM named WHERE repo NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 8)
        UNION ALL SELECT DISTINCT p_partkey % 100, 'head', '{catalog}.finance.' || replace(p_name, ' ', '_') FROM part
        WHERE p_partkey % 100 IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 8)""",
    "lock_drift": r"""
        SELECT coalesce(b.repo, h.repo) AS repo, coalesce(b.name, h.name) AS name,
               CASE WHEN b.name IS NULL THEN 'missing' ELSE 'extra' END AS drift
        FROM (SELECT * FROM named WHERE rev = 'base') b FULL JOIN (SELECT * FROM named WHERE rev = 'head') h
          ON b.repo = h.repo AND b.name = h.name WHERE b.name IS NULL OR h.name IS NULL""",
    "removed_tables": "SELECT repo, name FROM removed",
    "removed_classified": "SELECT repo, name, severity, reason FROM classified",
    "last_definition": "SELECT rev, key, catalog, schema, target, storage, serverless FROM res",
    "resource_removed": "SELECT key FROM gone",
    "resource_removed_by_kind": r"""
        SELECT repo, kind, key, CASE kind WHEN 'pipelines' THEN 'DESTRUCTIVE' ELSE 'NOTICE' END AS severity
        FROM gone""",
    "recreate_fields": "SELECT key, field, old_value, new_value FROM changed",
    "recreate_typed": r"""
        SELECT key, field, max(v) FILTER (WHERE rev = 'base') AS old_value, max(v) FILTER (WHERE rev = 'head') AS new_value
        FROM typed_long GROUP BY key, field HAVING count(DISTINCT rev) = 2 AND old_value IS DISTINCT FROM new_value""",
    "pair_removed": "SELECT repo, base_rev, head_rev, name FROM pair_gone",
    "pair_drift": r"""
        SELECT repo, base_rev, head_rev, name, 'extra' AS drift FROM pair_gone
        UNION ALL SELECT p.repo, p.base_rev, p.head_rev, h.name, 'missing'
        FROM pair p JOIN dated h ON h.repo = p.repo AND h.rev = p.head_rev
        WHERE NOT EXISTS (SELECT 1 FROM dated b WHERE b.repo = p.repo AND b.rev = p.base_rev AND b.name = h.name)""",
    "pair_guard": r"""
        SELECT *, CASE WHEN NOT has_base THEN 'unresolved' WHEN NOT head_listed THEN 'no inventory at head'
                       WHEN NOT base_listed THEN 'no inventory at base' ELSE 'ok' END AS status FROM pair_seen""",
    "pair_gate": r"""
        SELECT *, CAST(CASE status WHEN 'error' THEN 2 WHEN 'blocked' THEN 1 ELSE 0 END AS BIGINT) AS exit_code FROM (
          SELECT repo, base_rev, head_rev, base_listed, head_listed, n_findings, destructive, orphaned, needs_destroy, needs_inactive,
                 CASE WHEN NOT has_base THEN 'error' WHEN n_findings = 0 THEN 'clean' WHEN needs_destroy OR needs_inactive THEN 'blocked'
                      ELSE 'accepted' END AS status
          FROM (SELECT repo, base_rev, head_rev, has_base, base_listed, head_listed,
                       CASE WHEN has_base THEN coalesce(n, 0) END AS n_findings, CASE WHEN has_base THEN coalesce(d, FALSE) END AS destructive,
                       CASE WHEN has_base THEN coalesce(o, FALSE) END AS orphaned,
                       CASE WHEN has_base THEN coalesce(d, FALSE) AND (repo, 'allow-destroy') NOT IN (SELECT (repo, label) FROM label) END
                         AS needs_destroy,
                       CASE WHEN has_base THEN coalesce(o, FALSE) AND (repo, 'allow-inactive') NOT IN (SELECT (repo, label) FROM label) END
                         AS needs_inactive
                FROM pair_seen LEFT JOIN pair_sum USING (repo, base_rev, head_rev)))""",
    "resolved_inventory": r"""
        SELECT DISTINCT repo, rev, regexp_replace(coalesce(CASE p_size WHEN 1 THEN NULL WHEN 3 THEN '${bundle.target}'
                 ELSE '${var.catalog_' || lower(p_type) || '}' END, '{catalog}'), '^\$\{(var\.)?(.*)\}$', '{\2}')
               || '.' || CASE WHEN p_size = 2 THEN 'default' ELSE lower(replace(p_brand, '#', '_')) END
               || '.' || replace(p_name, ' ', '_') AS name
        FROM written_file JOIN part ON part = p_partkey WHERE folders = 0""",
    "files_outside": "SELECT repo, rev, declared_in, written FROM written_file WHERE folders = -1",
    "revision_guard": r"""
        SELECT s_suppkey AS repo, coalesce(bool_or(rev = 'base'), FALSE) AS has_base,
               coalesce(bool_or(rev = 'head'), FALSE) AS has_head,
               CASE WHEN coalesce(bool_or(rev = 'base'), FALSE) THEN 'ok' ELSE 'unresolved' END AS status
        FROM supplier LEFT JOIN seen ON seen.repo = s_suppkey GROUP BY s_suppkey""",
    "severity_rollup": "SELECT repo, severity, count(*) AS n FROM finding GROUP BY repo, severity",
    "label_set": "SELECT repo, label FROM label",
    "gate_decision": "SELECT *, NOT (needs_destroy OR needs_inactive) AS passes FROM decided",
    "gate_report": "SELECT *, TRUE AS passes FROM decided",
    "gate_flags": r"""
        SELECT s_suppkey AS repo, CAST(coalesce(destructive, FALSE) AS VARCHAR) AS destructive,
               CAST(coalesce(orphaned, FALSE) AS VARCHAR) AS orphaned
        FROM supplier LEFT JOIN decided ON decided.repo = s_suppkey""",
    "finding_report": pages(1000),
    "finding_report_pages": pages(50),
    "report_lines": rf"""
        SELECT repo, CAST({SECTION} AS INT) AS section, item,
               item || CASE WHEN detail IS NULL THEN '' ELSE ': ' || detail END AS line FROM finding
        UNION ALL SELECT s_suppkey, 0, '', 'Nothing that holds data is lost or left behind.'
        FROM supplier WHERE s_suppkey NOT IN (SELECT repo FROM finding)
        UNION ALL SELECT repo, 4, 'allow-destroy',
               'label allow-destroy: ' || CASE WHEN needs_destroy THEN 'missing' ELSE 'granted' END
        FROM decided WHERE destructive
        UNION ALL SELECT repo, 4, 'allow-inactive',
               'label allow-inactive: ' || CASE WHEN needs_inactive THEN 'missing' ELSE 'granted' END
        FROM decided WHERE orphaned""",
    "declared_union": "SELECT repo, name, origin FROM declared",
    "malformed_names": "SELECT repo, name, origin FROM declared WHERE len(string_split(name, '.')) <> 3",
    "schema_of_name": r"""
        SELECT DISTINCT name, len(string_split(name, '.')) AS parts,
               CASE WHEN len(string_split(name, '.')) = 3 THEN split_part(name, '.', 2) END AS schema_name
        FROM declared""",
    "allowed_schemas": "SELECT repo, schema_name FROM list_allowed",
    "allowed_declared": "SELECT repo FROM schema_list WHERE schemas IS NOT NULL",
    "outside_schema": r"""
        SELECT d.repo, d.name, d.origin, split_part(d.name, '.', 2) AS schema_name FROM declared d
        LEFT JOIN allowed a ON a.repo = d.repo AND a.schema_name = split_part(d.name, '.', 2)
        WHERE a.repo IS NULL AND len(string_split(d.name, '.')) = 3""",
    "distinct_files": "SELECT DISTINCT l_suppkey AS repo, l_partkey AS path FROM lineitem",
    "declaration_calls": r"""
        SELECT event_id, CASE event_type WHEN 'click' THEN 'table' WHEN 'view' THEN 'view'
                              ELSE 'create_streaming_table' END AS method,
               'c.brand_' || (user_id % 25) || '.t' AS name_literal
        FROM events WHERE event_type IN ('click', 'view', 'signup')""",
    "dynamic_names": r"""
        SELECT user_id, count(*) FILTER (WHERE dyn) AS n_dynamic, count(*) FILTER (WHERE NOT dyn) AS n_literal
        FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 AS dyn FROM events
              WHERE event_type IN ('click', 'view', 'signup'))
        GROUP BY user_id HAVING bool_or(dyn)""",
    "statement_writes": "SELECT event_id, verb, dest FROM write",
    "document_writes": rf"""
        SELECT doc_id, upper(regexp_replace(v, '\s+', ' ', 'g')) AS verb, replace(t, '`', '') AS dest
        FROM (SELECT doc_id, unnest(regexp_extract_all(sql, '{WRITE}', 1)) AS v,
                     unnest(regexp_extract_all(sql, '{WRITE}', 2)) AS t
              FROM (SELECT doc_id, 'insert into ' || lang || '.docs select ' || text
                                   || ' ; drop table if exists c.' || lang || '.old' AS sql FROM documents))""",
    "statement_violations": r"""
        SELECT event_id, verb, dest, schema_name FROM coded_schema w
        WHERE verb <> 'saveAsTable' AND schema_name IS NOT NULL AND NOT EXISTS
          (SELECT 1 FROM allowed a WHERE a.repo = w.repo AND a.schema_name = w.schema_name)""",
    "statement_unresolved": "SELECT event_id, verb, dest FROM write WHERE dest LIKE '%{%' OR dest LIKE '%}%'",
    "loaded_statements": r"""
        SELECT event_id, user_id % 7 AS repo, event_id % 2000 AS path FROM events
        WHERE (user_id % 7, event_id % 2000) IN (SELECT (l_suppkey, l_partkey) FROM lineitem
                                                     WHERE l_shipdate >= TIMESTAMP '1998-01-01')""",
    "writer_calls": "SELECT event_id, repo, verb, dest, dynamic FROM saved",
    "code_violations": r"""
        SELECT event_id, repo, verb, dest, dynamic, schema_name FROM coded_schema w
        WHERE schema_name IS NOT NULL AND NOT EXISTS
          (SELECT 1 FROM allowed a WHERE a.repo = w.repo AND a.schema_name = w.schema_name)""",
    "code_unresolved": "SELECT * FROM coded WHERE dynamic OR dest LIKE '%{%' OR dest LIKE '%}%'",
    "line_matches": r"""
        SELECT doc_id, line, regexp_extract(l, '(?i)\b(license)\b', 1) AS hit
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
                     generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
        WHERE regexp_matches(l, '(?i)\b(license)\b')""",
    "reference_extract": "SELECT page_id, role, org, target_repo FROM governed",
    "reference_drift": "SELECT page_id, role, org, expected FROM governed WHERE org <> expected",
    "reference_counts": "SELECT role, count(*) AS n FROM governed GROUP BY role",
    "reference_lines": "SELECT page_id, line, role, kind, org, target_repo FROM found",
    "reference_matches": rf"""
        SELECT page_id, line, 'reusable workflow' AS kind,
               trim(unnest(regexp_extract_all(l, '^\s*uses:\s*{ORG}/[\w.-]+/\.github/workflows/'))) AS matched FROM cfg_line
        UNION ALL SELECT page_id, line, 'git dependency', unnest(regexp_extract_all(l, 'git\+https://github\.com/{ORG}/[\w.-]+'))
        FROM cfg_line
        UNION ALL SELECT page_id, line, 'owner team', unnest(regexp_extract_all(l, '@{ORG}/[\w.-]+')) FROM cfg_line
        UNION ALL SELECT page_id, line, 'owner declaration', trim(unnest(regexp_extract_all(l, '^\s*github_org\s*=\s*"{ORG}"')))
        FROM cfg_line
        UNION ALL SELECT page_id, line, 'tooling declaration', trim(unnest(regexp_extract_all(l, '^\s*tooling_org\s*=\s*"{ORG}"')))
        FROM cfg_line""",
    "governed_files": r"""
        SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'pyproject.toml' WHEN 1 THEN 'docs/CODEOWNERS'
                             ELSE '.github/workflows/' || page_id || '.yaml' END AS path
        FROM pages WHERE page_id % 6 IN (0, 1, 3)""",
    "read_org_config": rf"""
        SELECT page_id, page_id % 10 AS repo, coalesce(nullif(regexp_extract(url, '{HOST}', 2), ''), 'nobody') AS owner_org,
               'thther' AS tooling_org, CAST(NULL AS VARCHAR) AS tooling_repo FROM pages""",
    "reference_rewrite": r"""
        SELECT page_id, regexp_replace(url, '^(https?://(?:[a-z]+\.)?)tionsh(\.example\.)', '\1neworg\2') AS url
        FROM pages""",
    "plan_moves": MOVES_OWNER,
    "plan_moves_split": r"""
        SELECT repo, 'repo' AS role, 'tionsh' AS old_org, 'neworg' AS new_org FROM owners
        UNION ALL SELECT repo, 'tooling', coalesce(tooling_org, 'tionsh'), 'newtools' FROM owners""",
    "plan_moves_tooling": r"""
        SELECT repo, 'tooling' AS role, CASE WHEN owner_org IS NOT NULL THEN coalesce(tooling_org, owner_org) END AS old_org,
               'newtools' AS new_org FROM owners""",
    "moved_config": r"""
        SELECT repo, CASE WHEN owner_org IS NOT NULL THEN 'neworg' END AS owner_org, tooling_org, tooling_repo FROM owners""",
    "moved_config_source": "SELECT repo, 'neworg' AS owner_org, 'newtools' AS tooling_org, tooling_repo FROM owners",
    "text_rewrite": r"""
        SELECT page_id, new AS text, new <> text AS moved FROM (
          SELECT page_id, text, CASE WHEN tooling_org IS NULL AND owner_org IS NOT NULL THEN
                   regexp_replace(regexp_replace(own, '(?m)^(\s*uses:\s*)tionsh(/shared-ci/\.github/workflows/)',
                     '\1neworg\2', 'g'), '(git\+https://github\.com/)tionsh(/shared-ci(?:[^\w.-]|$))', '\1neworg\2', 'g')
                 ELSE own END AS new
          FROM (SELECT page_id, text, owner_org, tooling_org, CASE WHEN owner_org IS NULL THEN text ELSE
                  regexp_replace(regexp_replace(text, '@tionsh(/[\w.-])', '@neworg\1', 'g'),
                    '(?m)^(\s*github_org\s*=\s*")tionsh"', '\1neworg"', 'g') END AS own
                FROM cfg_text LEFT JOIN owners USING (repo)))""",
    "references_moved": rf"""
        SELECT page_id, line, kind, new_org AS org FROM found JOIN ({MOVES_OWNER}) m USING (repo, role)
        JOIN owners USING (repo)
        WHERE found.org = m.old_org
          AND (role = 'repo' OR target_repo IS NULL OR target_repo = coalesce(tooling_repo, 'shared-ci'))""",
    "resource_findings": "SELECT repo, severity, kind, item, detail FROM resource_found",
    "table_findings": "SELECT repo, severity, kind, item, detail FROM table_found",
    "destructive_gate": verdict("pr"),
    "destructive_gate_report": verdict("report"),
    "incomplete_files": r"""
        SELECT DISTINCT l_suppkey AS repo, l_partkey AS path FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
        WHERE l_partkey % 7 = 0 AND s_nationkey >= 8 AND l_shipdate >= TIMESTAMP '1998-01-01'
          AND l_partkey IN (SELECT p_partkey FROM part)""",
    "stored_names": "SELECT repo, 'base' AS rev, name FROM held_name",
    "stored_manifest": r"""
        SELECT s_suppkey AS repo, 'base' AS rev, (SELECT count(*) FROM held_name h WHERE h.repo = s_suppkey) AS n_names
        FROM supplier WHERE s_nationkey % 5 <> 0""",
    "stored_lock_gate": r"""
        SELECT repo, n_tables, n_missing, n_extra, status,
               CAST(CASE status WHEN 'up to date' THEN 0 ELSE 1 END AS BIGINT) AS exit_code
        FROM (SELECT *, CASE WHEN n % 5 = 0 THEN 'absent' WHEN n_missing + n_extra > 0 THEN 'outdated' ELSE 'up to date' END AS status
              FROM (SELECT s_suppkey AS repo, any_value(s_nationkey) AS n, count(h.name) AS n_tables,
                           count(*) FILTER (WHERE b.name IS NULL AND h.name IS NOT NULL) AS n_missing,
                           count(*) FILTER (WHERE h.name IS NULL AND b.name IS NOT NULL) AS n_extra
                    FROM supplier LEFT JOIN (held_name b FULL JOIN (SELECT repo, name FROM named WHERE rev = 'head') h USING (repo, name))
                      ON repo = s_suppkey GROUP BY s_suppkey))""",
    "given_scope": r"""
        SELECT DISTINCT l_suppkey AS repo, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'base' ELSE 'head' END AS rev,
               ['{main}', 'None', '{catalog}', '{catalog}'][l_orderkey % 4 + 1] || '.'
               || ['default', 'default', 'sales', 'None'][l_orderkey % 4 + 1] || '.' || replace(p_name, ' ', '_') AS name
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "keyword_writers": "SELECT event_id, repo, verb, dest, dynamic OR event_id % 3 = 0 AS dynamic FROM saved",
    "lock_gate": r"""
        SELECT repo, n_tables, n_missing, n_extra, status,
               (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
                WHERE l_suppkey = repo AND l_partkey % 7 = 0 AND s_nationkey >= 8 AND l_shipdate >= TIMESTAMP '1998-01-01') AS n_incomplete,
               CAST(CASE status WHEN 'up to date' THEN 0 ELSE 1 END AS BIGINT) AS exit_code
        FROM (SELECT *, CASE WHEN NOT stored THEN 'absent' WHEN n_missing + n_extra > 0 THEN 'outdated'
                             ELSE 'up to date' END AS status
              FROM (SELECT s_suppkey AS repo,
                           s_suppkey IN (SELECT repo FROM seen WHERE rev = 'base') AS stored,
                           count(h.name) AS n_tables, count(*) FILTER (WHERE b.name IS NULL AND h.name IS NOT NULL) AS n_missing,
                           count(*) FILTER (WHERE h.name IS NULL AND b.name IS NOT NULL) AS n_extra
                    FROM supplier LEFT JOIN (
                      (SELECT repo, name FROM named WHERE rev = 'base') b
                      FULL JOIN (SELECT repo, name FROM named WHERE rev = 'head') h USING (repo, name)
                    ) ON repo = s_suppkey GROUP BY s_suppkey))""",
    "schema_gate": r"""
        SELECT repo, n_declared, n_malformed, n_outside, n_writes_outside, n_unresolved, status,
               CAST(CASE WHEN status IN ('malformed', 'outside', 'writes outside') THEN 1 ELSE 0 END AS BIGINT) AS exit_code
        FROM (SELECT *, CASE WHEN schemas IS NULL THEN 'skipped' WHEN n_malformed > 0 THEN 'malformed'
                             WHEN n_outside > 0 THEN 'outside' WHEN n_writes_outside > 0 THEN 'writes outside'
                             WHEN n_unresolved > 0 THEN 'warnings' ELSE 'ok' END AS status
          FROM (SELECT s.repo, s.schemas, coalesce(n_declared, 0) AS n_declared, coalesce(n_malformed, 0) AS n_malformed,
                       coalesce(n_outside, 0) AS n_outside, coalesce(n_writes_outside, 0) AS n_writes_outside,
                       coalesce(n_unresolved, 0) AS n_unresolved
            FROM schema_list s
            LEFT JOIN (SELECT repo, count(*) AS n_declared, count(*) FILTER (WHERE parts <> 3) AS n_malformed,
                              count(*) FILTER (WHERE parts = 3 AND a.schema_name IS NULL) AS n_outside
                       FROM (SELECT repo, len(string_split(name, '.')) AS parts, split_part(name, '.', 2) AS schema_name
                             FROM declared) d LEFT JOIN list_allowed a USING (repo, schema_name) GROUP BY repo) n
              ON n.repo = s.repo
            LEFT JOIN (SELECT repo, count(*) FILTER (WHERE c.schema_name IS NOT NULL AND a.schema_name IS NULL) AS n_writes_outside,
                              count(*) FILTER (WHERE dynamic OR dest LIKE '%{%' OR dest LIKE '%}%') AS n_unresolved
                       FROM (SELECT * FROM coded_schema WHERE (repo, event_id % 2000) IN
                          (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')) c
                       LEFT JOIN list_allowed a USING (repo, schema_name) GROUP BY repo) w
              ON w.repo = s.repo))""",
    "owner_gate": r"""
        SELECT repo, n_owner, n_tooling, n_drifting, status, CAST(CASE status WHEN 'ok' THEN 0 ELSE 1 END AS BIGINT) AS exit_code
        FROM (SELECT *, CASE WHEN owner_org IS NULL THEN 'undeclared' WHEN n_drifting > 0 THEN 'drift' ELSE 'ok' END AS status
          FROM (SELECT o.repo, o.owner_org, count(*) FILTER (WHERE role = 'repo') AS n_owner,
                       count(*) FILTER (WHERE role = 'tooling') AS n_tooling,
                       count(*) FILTER (WHERE org IS DISTINCT FROM
                         CASE role WHEN 'tooling' THEN coalesce(tooling_org, owner_org) ELSE owner_org END
                         AND role IS NOT NULL) AS n_drifting
                FROM owners o LEFT JOIN (SELECT page_id % 10 AS repo, * FROM ref WHERE org <> '') r
                  ON r.repo = o.repo AND (r.role = 'repo' OR r.target_repo = coalesce(o.tooling_repo, 'shared-ci'))
                GROUP BY o.repo, o.owner_org))""",
    "owner_plan": r"""
        SELECT repo, n_owner, n_tooling, n_drifting, status, CAST(CASE status WHEN 'ok' THEN 0 ELSE 1 END AS BIGINT) AS exit_code
        FROM (SELECT *, CASE WHEN owner_org IS NULL THEN 'undeclared' WHEN n_drifting > 0 THEN 'drift' ELSE 'ok' END AS status
          FROM (SELECT d.repo, d.owner_org, count(*) FILTER (WHERE role = 'repo') AS n_owner,
                       count(*) FILTER (WHERE role = 'tooling') AS n_tooling,
                       count(*) FILTER (WHERE role IS NOT NULL AND org IS DISTINCT FROM
                         CASE WHEN role = 'tooling' THEN d.tooling ELSE d.owner_org END) AS n_drifting
                FROM file_owner d LEFT JOIN (SELECT *, page_id // 6 AS r FROM found WHERE page_id % 6 IN (0, 1, 3)
                       AND (role = 'repo' OR target_repo IS NULL OR target_repo = 'shared-ci')) f ON f.r = d.repo
                GROUP BY d.repo, d.owner_org))""",
    "owner_move": r"""
        SELECT page_id, repo, path, new AS text, new <> text AS moved FROM (
          SELECT page_id, repo, path, text, CASE WHEN page_id % 6 IN (0, 1, 3) AND owner_org IS NOT NULL THEN
              regexp_replace(regexp_replace(text, '@' || owner_org || '(/[\w.-])', '@neworg\1', 'g'),
                '(?m)^(\s*github_org\s*=\s*")' || owner_org || '"', '\1neworg"', 'g') ELSE text END AS new
          FROM (SELECT page_id, page_id // 6 AS repo, text,
                       CASE page_id % 6 WHEN 0 THEN 'pyproject.toml' WHEN 1 THEN 'docs/CODEOWNERS' WHEN 2 THEN 'docs/history.md'
                            WHEN 3 THEN '.github/workflows/' || page_id || '.yaml' WHEN 4 THEN '.github/workflows/old/' || page_id || '.yml'
                            ELSE 'src/' || page_id || '.py' END AS path FROM cfg_text) JOIN file_owner USING (repo))""",
    "move_status": r"""
        SELECT repo, CASE WHEN owner_org IS NULL THEN 'error' ELSE 'ok' END AS status FROM owners""",
}


def statements() -> dict[str, str]:
    """Each query as one statement over the base tables."""
    prefix = "WITH " + ",\n".join(f"{name} AS ({' '.join(sql.split(chr(10)))})" for name, sql in VIEWS.items())
    return {name: f"{prefix}\n{sql.strip()}" for name, sql in ORACLE.items()}
