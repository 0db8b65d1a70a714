"""Form-shaped views over the driver's tables. The same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import MULTIPLY, PERMUTE

VIEWS = {
    "v_teacher": """SELECT 'C' || CAST(b AS STRING) AS id, event_id AS ord,
 CASE b % 6 WHEN 0 THEN 'date_of_birth' WHEN 1 THEN 'annual_income' WHEN 2 THEN 'age_years' WHEN 3 THEN 'pan_number' WHEN 4 THEN 'first_name' ELSE 'gender_mark' END AS field_name,
 CASE b % 6 WHEN 0 THEN 'date' WHEN 1 THEN 'amount' WHEN 2 THEN 'numeric' WHEN 3 THEN 'short_id' WHEN 4 THEN 'name_text' ELSE 'binary_mark' END AS field_family,
 CASE b % 6
  WHEN 0 THEN lpad(CAST(1 + b % 28 AS STRING),2,'0') || CASE WHEN event_id % 7 = 0 THEN '|' WHEN event_id % 7 = 1 THEN '-' ELSE '/' END || lpad(CAST(1 + b % 12 AS STRING),2,'0') || '/' || CAST(1950 + b % 60 AS STRING)
  WHEN 1 THEN CAST(1 + b % 900 AS STRING) || CASE WHEN event_id % 3 = 0 THEN ',' ELSE '' END || lpad(CAST(b % 1000 AS STRING),3,'0')
  WHEN 2 THEN CAST(b % 90 AS STRING) || CASE WHEN event_id % 4 = 0 THEN ' yrs' ELSE '' END
  WHEN 3 THEN chr(CAST(65 + b % 26 AS INT)) || 'BCDE' || lpad(CAST(b % 10000 AS STRING),4,'0') || CASE WHEN event_id % 5 = 0 THEN '7' ELSE 'F' END
  WHEN 4 THEN 'Name' || CASE WHEN event_id % 9 = 0 THEN '#' ELSE '  ' END || 'Kumar'
  ELSE CASE event_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'n.o' WHEN 2 THEN 'x' ELSE 'maybe' END END AS text,
 event_type AS model, CAST(floor(value * 100) AS BIGINT) % 10001 AS confidence_bp
FROM (SELECT event_id, event_type, value, event_id % 2500 AS b FROM events) e""",
    "v_region": """SELECT CAST(floor(l_orderkey / 40) AS BIGINT) AS doc_id, CAST(l_linenumber AS INT) AS page_num,
 CAST(((CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 100003 + l_partkey) * 1009 + l_suppkey AS BIGINT) AS region_id,
 CAST((l_partkey * 37) % 900 AS INT) AS x1, CAST((l_suppkey * 53 + l_orderkey) % 1300 AS INT) AS y1,
 CAST((l_partkey * 37) % 900 + 20 + l_partkey % 120 AS INT) AS x2, CAST((l_suppkey * 53 + l_orderkey) % 1300 + 10 + l_suppkey % 30 AS INT) AS y2,
 CAST((CAST(l_quantity AS BIGINT) * 211) % 10001 AS BIGINT) AS confidence_bp, CASE WHEN l_returnflag = 'R' THEN 'hi' ELSE 'en' END AS lang,
 l_linestatus || CAST(l_partkey % 97 AS STRING) AS text FROM lineitem""",
    "v_field": """SELECT CAST(o_orderkey AS BIGINT) AS doc_key, CAST(o_custkey AS BIGINT) AS doc_id,
 CASE o_orderkey % 5 WHEN 0 THEN 'Proposer_PAN' WHEN 1 THEN 'Sum_Assured' WHEN 2 THEN 'Premium_Amount' WHEN 3 THEN 'Nominee_Name' ELSE 'Proposer_Age' END AS field_name,
 CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 100000 AS STRING) END AS value,
 CAST(floor(o_totalprice) AS BIGINT) % 10001 AS confidence_bp,
 CASE o_orderstatus WHEN 'F' THEN 'Extracted' WHEN 'O' THEN 'Low Confidence' ELSE 'Rejected' END AS status FROM orders""",
    "v_lexicon": """SELECT category, text, CAST(count(*) AS BIGINT) AS frequency FROM (
 SELECT 'person_full' AS category, upper(p_name) AS text FROM part UNION ALL SELECT 'plan_name', upper(p_brand) FROM part UNION ALL SELECT 'employer_name', upper(c_mktsegment) FROM customer) t GROUP BY category, text""",
    "v_query": """SELECT CAST(p_partkey AS BIGINT) AS qid, 'person_full' AS category,
 CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN translate(upper(p_name),'OIS','015')
 ELSE substr(upper(p_name),1,CAST(2 + p_partkey % 3 AS INT)) || substr(upper(p_name),CAST(4 + p_partkey % 3 AS INT)) END AS raw_text, upper(p_name) AS truth FROM part""",
    "v_html": """SELECT CAST(c_custkey AS BIGINT) AS doc_id, '<table><tr><td>Name</td><td>' || c_name || '</td></tr><tr><td>Segment</td><td>' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END || '</td></tr><tr><td>SECTION ' || CAST(c_nationkey AS STRING) || '</td></tr></table>' AS html FROM customer""",
    "v_review": """SELECT event_id, user_id AS doc_id, event_type AS field_name, ts, CAST(floor(value) AS BIGINT) AS new_value FROM events""",
    "v_template": """SELECT * FROM (VALUES (1, 'f1', 1, 40, 100, 400, 200), (2, 'f2', 1, 300, 250, 700, 330), (3, 'f3', 2, 100, 500, 500, 640), (4, 'f4', 3, 10, 900, 500, 1000), (5, 'f5', 4, 600, 40, 1000, 160), (6, 'f6', 5, 350, 700, 900, 900), (7, 'f7', 6, 20, 1100, 460, 1290), (8, 'f8', 7, 500, 300, 840, 480)) t(ford, fname, page_num, fx1, fy1, fx2, fy2)""",
}
def pick_sql(m: int, *key: str) -> str:
    """DuckDB SQL for a number under m that a key decides, as quillspark.operators.dataset.pick gives it."""
    text = " || ':' || ".join(k if not k.isdigit() else f"'{k}'" for k in key)
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {m})"


#: DuckDB SQL for an 11-digit string of an order.
DIGITS11 = "lpad(CAST(o_orderkey * 104729 + 275492384 AS STRING), 11, '3')"


def residue_sql(text: str, permute: tuple[str, ...] = PERMUTE) -> str:
    """DuckDB SQL for a digit string's checksum, its last digit at place 0."""
    listed = lambda rows: ", ".join(f"'{r}'" for r in rows)
    placed = f"list_transform(range(1, length({text}) + 1), lambda k: CAST(substr([{listed(permute)}][(k - 1) % 8 + 1], CAST(substr(reverse({text}), k, 1) AS INT) + 1, 1) AS INT))"
    return f"list_reduce(list_prepend(0, {placed}), lambda a, x: CAST(substr([{listed(MULTIPLY)}][a + 1], x + 1, 1) AS INT))"


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    return spark.sql(re.sub(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b", r"\1 {\2}", sql), **used)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names before it."""
    named = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in named)
    if not heads:
        return sql
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{heads}, {body[len(start) :]}"
    return f"WITH {heads} {body}"
