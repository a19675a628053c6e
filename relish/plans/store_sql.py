"""The relevance store derived from the given tables, in SQL that both engines read.

Orders are queries, parts are consumables, order-part pairs are examples, and
labels come from the line items.  ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relish.operators.store import Store, conform
from relish.plans.registry import Tables
from relish.session import dealt, parts_for, stage

GIVEN = ["orders", "part", "lineitem"]

STORE_SQL = {
    # every fifth-priority class carries item names, the others are priority and month
    "query": """SELECT o_orderkey AS id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN p_name ELSE o_orderpriority || ' ' || substr(cast(o_orderdate AS string), 1, 7) END AS query_content,
  CASE WHEN o_orderstatus = 'O' THEN '{{"status":"O"}}' END AS query_filters,
  'g' || cast(o_custkey % 10 AS string) AS data_gen_hash, o_orderdate AS created_at,
  'run_' || cast(o_custkey % 20 AS string) AS mlflow_run_id
FROM {orders} JOIN {part} ON p_partkey = o_custkey""",
    "consumable": """SELECT p_partkey AS id, 'http://img.example.org/' || cast(p_partkey AS string) AS image_url, p_name AS consumable_name,
  p_type AS consumable_type, '["' || replace(p_name, ' ', '","') || '"]' AS consumable_ingredients FROM {part}""",
    "example": """SELECT l_orderkey * 10000000 + l_partkey AS id, l_orderkey AS query_id, l_partkey AS consumable_id, min(l_shipdate) AS created_at,
  min('g' || cast(o_custkey % 10 AS string)) AS example_gen_hash, min('run_' || cast(o_custkey % 20 AS string)) AS run_id
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey GROUP BY l_orderkey, l_partkey""",
    # generators call small quantities exact, more of them in later runs; humans saw the open lines
    "label": """SELECT (l_orderkey * 10000000 + l_partkey) * 2 AS id, 100 + min(o_custkey % 10) AS labeler_id, l_orderkey * 10000000 + l_partkey AS example_id,
  CASE WHEN max(l_quantity) <= 20 + 2 * min(o_custkey % 20) THEN 'E' WHEN min(l_returnflag) = 'A' THEN 'S' WHEN min(l_returnflag) = 'N' THEN 'C' ELSE 'I' END AS esci_label,
  'qty ' || cast(cast(max(l_quantity) AS int) AS string) AS label_reason, 1.0 AS auto_label_score, min(l_shipdate) AS created_at
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_tax < 0.07 GROUP BY l_orderkey, l_partkey
UNION ALL SELECT (l_orderkey * 10000000 + l_partkey) * 2 + 1, 1, l_orderkey * 10000000 + l_partkey,
  CASE WHEN min(l_returnflag) = 'R' THEN 'I' ELSE 'E' END, NULL, NULL, max(l_shipdate)
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_linestatus = 'O' AND l_discount > 0.05 GROUP BY l_orderkey, l_partkey""",
    "labeler": """SELECT 1 AS id, 'ana' AS name, 'labeler' AS role, 'human' AS type, min(o_orderdate) AS created_at FROM {orders}
UNION ALL SELECT 100 + o_custkey % 10, 'g' || cast(o_custkey % 10 AS string), 'labeler', 'synthetic_data_generation_initial', min(o_orderdate)
FROM {orders} GROUP BY o_custkey % 10""",
}


def store_of(t: Tables, *stored: str) -> Store:
    """The derived store; the tables named in ``stored`` are written out first, as a real store's are.

    So are the labelers, a row per generator, so that their size is known to the joins with them.
    """
    given = {name: getattr(t, name) for name in GIVEN}
    given["lineitem"] = dealt(given["lineitem"], parts_for(given["lineitem"]), "l_orderkey")
    tables = {
        name: conform(t.spark.sql(sql, **{g: df for g, df in given.items() if "{" + g + "}" in sql}), name)
        for name, sql in STORE_SQL.items()}
    return Store(**{name: stage(df) if name in (*stored, "labeler") else df for name, df in tables.items()})


def store_ctes() -> str:
    """The same tables as WITH clauses, named ``s_query`` and so on."""
    names = {g: g for g in GIVEN}
    return ",\n".join(f"s_{name} AS MATERIALIZED ({sql.format(**names)})" for name, sql in STORE_SQL.items())


def generated_rows(t: Tables) -> DataFrame:
    """Generated rows of three runs from the line items: old and new texts, unknown items, null texts."""
    return t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"), "l_orderkey").select(
        F.concat(F.lit("new_"), (F.col("o_custkey") % 3).cast("string")).alias("run_id"),
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("row_id"),
        F.when(F.col("l_returnflag") == "R", F.col("l_partkey") + 1000000).otherwise(F.col("l_partkey")).alias("consumable_id"),
        F.when(F.col("l_linestatus") == "F", F.concat("o_orderpriority", F.lit(" "), F.date_format("l_shipdate", "yyyy-MM")))
        .when(F.col("l_tax") < 0.08, F.concat(F.lit("ship to "), (F.col("l_suppkey") % 50).cast("string"))).alias("query"),
        F.when(F.col("l_tax") < 0.04, F.concat(F.lit('{"tax":"'), F.col("l_linenumber").cast("string"), F.lit('"}')))
        .when(F.col("l_tax") < 0.06, F.lit("{}")).otherwise(F.lit("{broken")).alias("query_filters"),
        F.col("l_returnflag").alias("reasoning"),
        F.when(F.col("l_linestatus") == "F", "bridged").otherwise("intent").alias("query_type"),
    )


GENERATED_SQL = """gen AS (SELECT 'new_' || (o_custkey % 3) AS run_id, ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS row_id,
  CASE WHEN l_returnflag = 'R' THEN l_partkey + 1000000 ELSE l_partkey END AS consumable_id,
  CASE WHEN l_linestatus = 'F' THEN o_orderpriority || ' ' || substr(cast(l_shipdate AS string), 1, 7)
       WHEN l_tax < 0.08 THEN 'ship to ' || (l_suppkey % 50) END AS query,
  CASE WHEN l_tax < 0.04 THEN '{"tax":"' || l_linenumber || '"}' WHEN l_tax < 0.06 THEN '{}' ELSE '{broken' END AS query_filters,
  l_returnflag AS reasoning, CASE WHEN l_linestatus = 'F' THEN 'bridged' ELSE 'intent' END AS query_type
FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
