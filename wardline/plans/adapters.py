"""Clinical tables from the driver's star schema.

The same SELECT text serves Spark and the DuckDB oracle, so both sides start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

_CENTS = "CAST(ROUND(value * 100) AS BIGINT)"

VIEWS = {
    "patient": """
        SELECT CAST(c_custkey AS STRING) AS id, c_custkey AS seq, c_name AS family_name,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS block,
               c_nationkey AS tenant,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 12 AS INT) END AS stored_total,
               c_acctbal > 0 AS active, CAST(c_custkey % 500 AS STRING) AS identifier,
               CAST(c_nationkey AS STRING) AS practitioner,
               CAST(c_custkey % 400 AS INT) AS birth_no,
               CASE c_custkey % 7 WHEN 0 THEN 'Maria' WHEN 1 THEN 'Marie' WHEN 2 THEN 'Peter' WHEN 3 THEN 'Pieter'
                    WHEN 4 THEN 'Anna' WHEN 5 THEN 'Hanna' ELSE 'Klaus' END AS given,
               CASE c_custkey % 11 WHEN 0 THEN 'Meyer' WHEN 1 THEN 'Maier' WHEN 2 THEN 'Schmidt' WHEN 3 THEN 'Schmitt'
                    WHEN 4 THEN 'Fischer' WHEN 5 THEN 'Vischer' WHEN 6 THEN 'Weber' WHEN 7 THEN 'Wagner'
                    WHEN 8 THEN 'Becker' WHEN 9 THEN 'Bekker' ELSE 'Hoffmann' END AS family
        FROM customer""",
    "person": """
        SELECT 'Patient' AS resource_type, CAST(c_custkey AS STRING) AS id, c_acctbal > 0 AS active, CAST(c_custkey % 500 AS STRING) AS identifier,
               CAST(c_nationkey AS STRING) AS practitioner, CAST(c_custkey % 400 AS INT) AS birth_no, CASE c_custkey % 7 WHEN 0 THEN 'Maria' WHEN 1 THEN 'Marie' WHEN 2 THEN 'Peter' WHEN 3 THEN 'Pieter'
                    WHEN 4 THEN 'Anna' WHEN 5 THEN 'Hanna' ELSE 'Klaus' END AS given,
               CASE c_custkey % 11 WHEN 0 THEN 'Meyer' WHEN 1 THEN 'Maier' WHEN 2 THEN 'Schmidt' WHEN 3 THEN 'Schmitt'
                    WHEN 4 THEN 'Fischer' WHEN 5 THEN 'Vischer' WHEN 6 THEN 'Weber' WHEN 7 THEN 'Wagner'
                    WHEN 8 THEN 'Becker' WHEN 9 THEN 'Bekker' ELSE 'Hoffmann' END AS family
        FROM customer
        UNION ALL
        SELECT 'Practitioner', CAST(s_suppkey AS STRING), s_acctbal > 0, CAST(s_suppkey % 25 AS STRING),
               CAST(s_nationkey AS STRING), CAST(s_suppkey % 10 AS INT), CASE s_suppkey % 3 WHEN 0 THEN 'Anna' WHEN 1 THEN 'Hanna' ELSE 'Peter' END,
               CASE s_suppkey % 4 WHEN 0 THEN 'Meyer' WHEN 1 THEN 'Maier' WHEN 2 THEN 'Schmidt' ELSE 'Schmitt' END
        FROM supplier""",
    "observation": f"""
        SELECT CAST(event_id AS STRING) AS id, event_id AS seq, concat('Patient/', CAST(user_id AS STRING)) AS subject,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS issued,
               CASE WHEN event_id % 11 = 0 AND event_id % 22 <> 0 THEN ts - INTERVAL '1' DAY END AS effective,
               CASE event_type WHEN 'click' THEN '8867-4' WHEN 'view' THEN '9279-1' WHEN 'purchase' THEN '8480-6'
                    WHEN 'signup' THEN '8310-5' WHEN 'error' THEN '59408-5' END AS code,
               CAST(CAST(CASE event_type WHEN 'click' THEN 3000 + {_CENTS} % 12000 WHEN 'view' THEN 500 + {_CENTS} % 2500
                    WHEN 'purchase' THEN 8000 + {_CENTS} % 16000 WHEN 'signup' THEN 3400 + {_CENTS} % 600
                    WHEN 'error' THEN 8800 + {_CENTS} % 1200 END AS DECIMAL(16,0)) * 0.01 AS DECIMAL(18,2)) AS value,
               user_id, event_type, ts, props
        FROM events""",
    "encounter": """
        SELECT CAST(o_orderkey AS STRING) AS id, concat('Patient/', CAST(o_custkey AS STRING)) AS subject,
               CAST(o_custkey AS STRING) AS patient_id, CAST(o_orderdate AS DATE) AS period_start,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL
                    ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) AS DATE) END AS period_end,
               o_orderstatus AS status
        FROM orders""",
    "medication_request": """
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id,
               CAST(o_custkey AS STRING) AS patient_id, concat('Medication/', CAST(l_partkey AS STRING)) AS medication,
               CAST(l_partkey AS STRING) AS medication_id,
               CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'completed' END AS status,
               CASE WHEN l_returnflag = 'N' THEN 'community' ELSE 'inpatient' END AS category, 'order' AS intent
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "medication": "SELECT CAST(p_partkey AS STRING) AS id, p_type AS code, p_brand AS system FROM part",
    "condition": """
        SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS patient_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'encounter-diagnosis' WHEN '2-HIGH' THEN 'health-concern'
                    WHEN '3-MEDIUM' THEN 'problem-list-item' ELSE 'other' END AS category,
               CASE o_orderstatus WHEN 'O' THEN 'active' ELSE 'resolved' END AS clinical_status,
               CAST(o_orderkey % 50 AS STRING) AS code
        FROM orders""",
    "service_request": """
        SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS patient_id,
               CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'completed' ELSE 'draft' END AS status
        FROM orders""",
    "concept": "SELECT DISTINCT p_brand AS system, p_type AS code, concat(p_brand, ' ', p_type) AS display FROM part",
    "refs": """
        SELECT 'Encounter' AS src_type, CAST(o_orderkey AS STRING) AS src_id, 'subject' AS path,
               'Patient' AS ref_type, CAST(o_custkey AS STRING) AS ref_id FROM orders
        UNION ALL
        SELECT 'Organization', CAST(s_suppkey AS STRING), 'partOf', 'Nation', CAST(s_nationkey AS STRING) FROM supplier
        UNION ALL
        SELECT 'Nation', CAST(n_nationkey AS STRING), 'partOf', 'Region', CAST(n_regionkey AS STRING) FROM nation
        UNION ALL
        SELECT 'Patient', CAST(c_custkey AS STRING), 'nation', 'Nation', CAST(c_nationkey AS STRING) FROM customer""",
    "version": """
        SELECT concat(CAST(user_id AS STRING), '-', event_type) AS id, ts AS last_updated, event_id AS seq,
               value, props, CAST(event_id % 3 AS STRING) AS status
        FROM events""",
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """DataFrames of base tables or clinical views, in the order asked for."""
    out = []
    for name in names:
        if name in BASE:
            out.append(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            continue
        text = VIEWS[name]
        used = [b for b in BASE if f" {b}" in text]
        frames = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in used}
        for b in used:
            text = text.replace(f"FROM {b}", f"FROM {{{b}}}").replace(f"JOIN {b}", f"JOIN {{{b}}}")
        out.append(spark.sql(text, **frames))
    return out


def sql(body: str, *views: str) -> str:
    """A DuckDB query whose WITH clause defines the named clinical views before ``body``."""
    named = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {named}, {body.lstrip()[len('WITH RECURSIVE'):]}"
    if body.lstrip().upper().startswith("WITH"):
        return f"WITH {named}, {body.lstrip()[4:]}"
    return f"WITH {named} {body}"
