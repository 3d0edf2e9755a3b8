"""Procurement tables derived from the star-schema test tables.

Each binding is plain SQL that Spark and DuckDB both run, so that a query and its check start from
the same rows. Names in braces refer to other bindings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

PRECEDENCE = ("bom-a.xlsx", "bom-n.xlsx", "bom-r.xlsx")
KEYWORD = "widget"
CUTOFF = "2024-01-20 00:00:00"

_SCOPE = "'tenant-1' AS tenant_id, {project} AS project_id, 'site-1' AS site_id, 'r1' AS version"


def _scope(project: str) -> str:
    return _SCOPE.replace("{project}", project)


_RECORD = (
    "CAST(l_orderkey AS STRING)||'-'||CAST(l_linenumber AS STRING)||'-'||CAST(l_partkey AS STRING)"
    "||'-'||CAST(l_suppkey AS STRING)"
)
_ITEM = "'P-'||lpad(CAST(l_partkey AS STRING),7,'0')"


def _bom(project: str) -> str:
    return f"""
SELECT {_scope(project)},
       'bom-'||lower(l_returnflag)||'.xlsx' AS artifact_id,
       'hash-'||lower(l_returnflag) AS content_hash,
       CAST(l_orderkey AS BIGINT) * 100 + l_linenumber AS line_no,
       CASE l_linenumber % 3 WHEN 0 THEN 'P-' WHEN 1 THEN 'p ' ELSE 'P_' END
         ||lpad(CAST(l_partkey AS STRING),7,'0') AS sku,
       p_name AS description,
       CAST(l_quantity AS DECIMAL(18,6)) AS quantity,
       CASE WHEN l_partkey % 11 = 0 THEN NULL
            WHEN l_returnflag='R' AND l_partkey % 3 = 0
              THEN CAST(CAST(p_retailprice AS DECIMAL(18,6))+1 AS DECIMAL(18,6))
            ELSE CAST(p_retailprice AS DECIMAL(18,6)) END AS unit_price,
       CASE WHEN l_orderkey % 97 = 0 THEN 'unresolved' ELSE 'observed' END AS status,
       'record' AS location_kind, 'lineitem' AS collection, {_RECORD} AS record_key,
       CAST(NULL AS STRING) AS sheet, CAST(NULL AS BIGINT) AS "row", l_orderkey, l_partkey
FROM lineitem JOIN part ON l_partkey = p_partkey"""


BINDINGS = {
    # scope = supplier: several sources per item, so both reconciliation outcomes occur
    "bom_lines": _bom("'project-'||CAST(l_suppkey AS STRING)"),
    # many small bills: some resolve completely, so claims of every status occur
    "small_boms": _bom("'project-'||CAST(l_suppkey AS STRING)||'-'||CAST(l_orderkey % 40 AS STRING)"),
    "candidates": """
SELECT 'P-'||lpad(CAST(p_partkey AS STRING),7,'0') AS candidate FROM part WHERE p_partkey % 13 <> 0
UNION ALL
SELECT 'p '||lpad(CAST(p_partkey AS STRING),7,'0') FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 17 = 0""",
    "expected": f"""
SELECT {_scope("'project-'||CAST(l_suppkey % 5 AS STRING)")}, {_ITEM} AS canonical_key,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,6))) AS DECIMAL(20,6)) AS required_quantity,
       CAST(CASE WHEN l_partkey % 19 = 0 THEN '2024-02-01 00:00:00' ELSE '2024-01-10 00:00:00' END AS TIMESTAMP)
         AS as_of
FROM lineitem GROUP BY l_partkey, l_suppkey % 5""",
    "observed": f"""
SELECT {_scope("'project-'||CAST(event_id % 5 AS STRING)")},
       'P-'||lpad(CAST(user_id AS STRING),7,'0') AS canonical_key,
       CASE WHEN event_type='error' THEN CAST(0 AS DECIMAL(18,6)) ELSE CAST(value AS DECIMAL(18,6)) END AS ordered_quantity,
       CASE WHEN event_type='purchase' THEN CAST(value AS DECIMAL(18,6)) ELSE CAST(0 AS DECIMAL(18,6)) END AS received_quantity,
       CASE WHEN event_id % 7 = 0 THEN CAST(1 AS DECIMAL(18,6)) ELSE CAST(0 AS DECIMAL(18,6)) END AS substituted_quantity,
       CASE WHEN event_id % 11 = 0 THEN CAST(1 AS DECIMAL(18,6)) ELSE CAST(0 AS DECIMAL(18,6)) END AS delayed_quantity,
       CASE WHEN event_type='view' THEN CAST(2 AS DECIMAL(18,6)) ELSE CAST(0 AS DECIMAL(18,6)) END AS unknown_quantity,
       CASE event_type WHEN 'view' THEN 'partial' WHEN 'error' THEN 'unknown' WHEN 'click' THEN 'stale' ELSE 'current' END AS freshness,
       CAST(date_trunc('day', ts) AS TIMESTAMP) AS as_of, event_id AS input_ordinal
FROM events""",
    "purchase_orders": f"""
SELECT {_scope("'project-'||CAST(o_custkey % 50 AS STRING)").replace("'r1' AS version", "CASE WHEN o_orderkey % 2 = 0 THEN 'r1' ELSE 'r2' END AS version")},
       'PO-'||CAST(o_orderkey AS STRING) AS order_number,
       'S-'||CAST(o_custkey AS STRING) AS supplier_key,
       CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'issued' ELSE 'partially_received' END AS status,
       CAST(o_orderdate AS TIMESTAMP) AS issued_at, CAST(o_orderdate AS DATE) AS order_date, o_orderkey
FROM orders""",
    "boq": f"""
SELECT tenant_id, project_id, site_id, version, 'boq-'||CAST(o_orderkey AS STRING) AS boq_id,
       'BOQ-'||CAST(o_orderkey AS STRING) AS boq_number, version AS revision, issued_at AS as_of, o_orderkey
FROM {{purchase_orders}}""",
    # one required line per ordered item; every fourth asks for more than was ordered
    "boq_lines": f"""
SELECT b.tenant_id, b.project_id, b.site_id, b.version, b.boq_id, 'line-'||CAST(l_partkey AS STRING) AS line_id,
       {_ITEM} AS item_key, 'item '||CAST(l_partkey AS STRING) AS description, 'each' AS unit,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,6))) + CASE WHEN l_partkey % 4 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,6)) AS quantity
FROM lineitem JOIN {{boq}} b ON l_orderkey = b.o_orderkey
GROUP BY b.tenant_id, b.project_id, b.site_id, b.version, b.boq_id, l_partkey""",
    # every ninth item is ordered without a bill reference
    "po_lines": f"""
SELECT o.tenant_id, o.project_id, o.site_id, o.version, o.order_number, {_RECORD} AS line_id,
       {_ITEM} AS item_key, CAST(l_quantity AS DECIMAL(18,6)) AS quantity, 'each' AS unit,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,6)) AS unit_price, 'USD' AS currency,
       CASE WHEN l_partkey % 9 <> 0 THEN 'boq-'||CAST(l_orderkey AS STRING) END AS boq_id,
       CASE WHEN l_partkey % 9 <> 0 THEN 'line-'||CAST(l_partkey AS STRING) END AS boq_line_id,
       o.order_date, CAST(l_shipdate AS DATE) AS ship_date, l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_linestatus
FROM lineitem JOIN {{purchase_orders}} o ON l_orderkey = o.o_orderkey""",
    "event_assertions": f"""
SELECT {_scope("'project-'||CAST(event_id % 5 AS STRING)")},
       'event-'||lpad(CAST(event_id AS STRING),12,'0') AS assertion_id,
       'user-'||CAST(user_id AS STRING) AS subject_key, event_type AS predicate,
       CAST(CAST(value AS DECIMAL(18,2)) AS STRING) AS value_text,
       CAST(ts AS TIMESTAMP) AS observed_at, event_id
FROM events""",
    "event_ledger": """
SELECT a.*, event_id + 1 AS sequence,
       'entry-'||lpad(CAST(event_id + 1 AS STRING),12,'0') AS entry_id
FROM {event_assertions} a""",
    "questions": f"""
SELECT 'tenant-1' AS tenant_id, 'project-'||CAST(conv_id % 100 AS STRING)||'-'||CAST(turn % 40 AS STRING) AS project_id,
       'site-1' AS site_id, 'r1' AS version,
       CAST(conv_id AS STRING)||'.'||CAST(turn AS STRING) AS question_id,
       CASE conv_id % 6 WHEN 0 THEN 'How many WIDGETs: ' WHEN 1 THEN 'What is the total-cost? '
            WHEN 2 THEN 'Which SKUs are listed? ' WHEN 3 THEN 'widget   Quantity at what price - '
            WHEN 4 THEN 'Widget-sku list ' ELSE '' END || text AS question
FROM conversations WHERE role = 'user'""",
    "search_queries": """
SELECT 'q'||CAST(item_id AS STRING) AS query_id,
       CASE item_id % 4 WHEN 0 THEN 'User-'||CAST(item_id AS STRING)||' purchase 1'
            WHEN 1 THEN 'VIEW view er-'||CAST(item_id AS STRING)
            WHEN 2 THEN CAST(item_id AS STRING)||'.5 signup'
            ELSE 'error '||text END AS query
FROM benchmark""",
}


def binding_sql(name: str) -> str:
    """SQL of a binding with the bindings it refers to in place."""
    return inline(BINDINGS[name])


def inline(sql: str) -> str:
    """Replace {binding} names by their SQL."""
    return re.sub(r"\{([a-z_]+)\}", lambda m: f"({inline(BINDINGS[m.group(1)])})", sql)


def oracle(body: str) -> str:
    """A check query: every {binding} it names becomes a common table."""
    names: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\{([a-z_]+)\}", sql):
            visit(BINDINGS[name])
            if name not in names:
                names.append(name)

    visit(body)
    if not names:
        return body
    bare = lambda sql: re.sub(r"\{([a-z_]+)\}", r"\1", sql)
    tables = ", ".join(f"{name} AS ({bare(BINDINGS[name])})" for name in names)
    body = bare(body).strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {tables}, {body[5:]}"
    return f"WITH {tables} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy procurement table over one data directory."""
    return run_sql(spark, sf_dir, binding_sql(name))


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the tables of one data directory."""
    used = [name for name in TABLES if re.search(rf"\b{name}\b", sql)]
    for name in used:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql.replace('"row"', "`row`"))
