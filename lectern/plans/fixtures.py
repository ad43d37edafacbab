"""Reference-shaped views over the given tables, as SQL that Spark and DuckDB both read.

In Spark, names of tables are bound to DataFrames; nothing is registered in the session. Where the dialects differ a view has two texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Definitions of the test views.
VIEWS: dict[str, str | tuple[str, str]] = {
    "fx_document": "SELECT doc_id AS document_id, split_part(text, '.', 1) AS title, source AS journal, CAST(2000 + doc_id % 25 AS INT) AS year, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('10.1000/', CAST(doc_id % 700 AS STRING)) END AS doi, CAST(1 + floor(n_chars / 400) AS INT) AS n_pages FROM documents",
    "fx_activity": "SELECT user_id, (user_id * 7 + event_id % 5) % 200 AS document_id, CAST(event_id % 12 AS INT) AS page_index, ts FROM events",
    "fx_reading": "SELECT event_type AS tag, ts, value, CASE event_type WHEN 'click' THEN 'bar(g)' WHEN 'view' THEN 'kg/h' WHEN 'error' THEN '°C' WHEN 'signup' THEN 'wt%' ELSE CASE WHEN event_id % 2 = 0 THEN 't/h' ELSE 'kg/h' END END AS unit, event_id FROM events",
    "fx_shift_event": "SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' ELSE 'purchase' END AS tag, ts FROM events",
    "fx_shift": (
        "SELECT DISTINCT date_trunc('day', ts) + INTERVAL '8' HOUR AS start_ts, date_trunc('day', ts) + INTERVAL '16' HOUR AS end_ts FROM (SELECT CAST(ts AS TIMESTAMP_NTZ) AS ts FROM events)",
        "SELECT DISTINCT CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL '8' HOUR AS start_ts, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL '16' HOUR AS end_ts FROM events",
    ),
    "fx_limit": "SELECT DISTINCT event_type AS tag, 100.0D AS warn, 200.0D AS alarm FROM events",
    "fx_equipment": "SELECT user_id AS line, event_id AS seq, concat(CAST(value AS STRING), ' t/h raw') AS throughput FROM events",
    "fx_annotation_log": "SELECT user_id * 10 + event_id % 7 AS annotation_id, user_id AS document_id, CAST(event_id % 7 AS INT) AS page_index, CASE event_type WHEN 'signup' THEN 'highlight' WHEN 'click' THEN 'note' WHEN 'view' THEN 'underline' WHEN 'purchase' THEN 'draw' ELSE 'erase' END AS tool, ts, event_id FROM events",
    "fx_annotation_page": "SELECT DISTINCT user_id AS document_id, CAST(event_id % 9 AS INT) AS page_index, CASE WHEN event_id % 9 % 2 = 0 THEN '' ELSE concat('p', CAST(event_id % 9 AS STRING)) END AS label FROM events",
    "fx_message": "SELECT conv_id, turn, role, text AS content FROM conversations",
    "fx_claim": "SELECT conv_id AS answer_id, turn AS claim_id, CASE (conv_id + turn) % 6 WHEN 0 THEN 'paper' WHEN 1 THEN 'external' WHEN 2 THEN 'model' WHEN 3 THEN 'user' WHEN 4 THEN 'paper' ELSE NULL END AS badge FROM conversations",
    "fx_note": "SELECT doc_id AS note_id, doc_id % 200 AS document_id, CASE doc_id % 9 WHEN 0 THEN 'Grounded Note' WHEN 1 THEN 'Research Question' WHEN 2 THEN 'Result' WHEN 3 THEN 'Method' WHEN 4 THEN 'Limitation' WHEN 5 THEN 'Assumption' WHEN 6 THEN 'Formula' WHEN 7 THEN 'Figure Note' ELSE 'Dataset Note' END AS type, CASE WHEN doc_id % 3 = 0 THEN 'ai' ELSE 'user' END AS author_kind, source AS folder, lang AS project, doc_id % 2 = 0 AS resolved FROM documents",
    "fx_uses": "SELECT DISTINCT concat('paper:', CAST(l_orderkey AS STRING)) AS source, 'uses' AS kind, concat('method:', CAST(l_partkey AS STRING)) AS target FROM lineitem",
    "fx_effect_edge": "SELECT DISTINCT concat('variable:', CAST(l_suppkey AS STRING)) AS source, CASE WHEN l_returnflag = 'A' THEN 'increases' WHEN l_returnflag = 'R' THEN 'decreases' WHEN l_linenumber = 1 THEN 'contradicts' ELSE 'affects' END AS kind, concat('result:', CAST(l_partkey AS STRING)) AS target FROM lineitem",
    "fx_edge_log": "SELECT concat('variable:', CAST(l_suppkey AS STRING)) AS source, concat('result:', CAST(l_partkey AS STRING)) AS target, CASE WHEN l_linenumber = 7 THEN 'rejected' WHEN l_linestatus = 'F' THEN 'confirmed' ELSE 'proposed' END AS status, l_shipdate AS ts, l_orderkey AS seq FROM lineitem",
    "fx_evidence": "SELECT concat('variable:', CAST(l_suppkey AS STRING)) AS source, concat('result:', CAST(l_partkey AS STRING)) AS target, concat('paper:', CAST(l_orderkey AS STRING)) AS document_id, l_linenumber AS page_index, 1 - 5 * l_discount AS confidence, l_shipdate AS created_at FROM lineitem",
    "fx_trace": "SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_orderkey % 1100 AS document_id, CASE WHEN (l_orderkey * 10 + l_linenumber) % 5 = 0 THEN NULL ELSE concat(CAST(l_orderkey % 1100 AS STRING), '-', CAST(3 * (l_linenumber % 3) AS STRING)) END AS anchor_id FROM lineitem",
    "fx_node": "SELECT concat('variable:', CAST(s_suppkey AS STRING)) AS id, 'Variable' AS kind, s_name AS title, s_acctbal / 100 AS strength FROM supplier UNION ALL SELECT concat('result:', CAST(p_partkey AS STRING)), 'Result', p_name, p_retailprice / 20 FROM part WHERE p_partkey % 97 <> 0",
    "fx_question": "SELECT concat('question:', CAST(o_orderkey AS STRING)) AS id, concat('method:', CAST(o_custkey AS STRING)) AS about FROM orders",
    "fx_answer_edge": "SELECT concat('question:', CAST(o_orderkey AS STRING)) AS source, 'answered-by' AS kind, concat('paper:', CAST(o_custkey AS STRING)) AS target, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'proposed' ELSE 'rejected' END AS status FROM orders UNION ALL SELECT concat('question:', CAST(o_orderkey AS STRING)), 'unanswered-by', concat('paper:', CAST(o_custkey AS STRING)), CASE WHEN o_orderstatus = 'P' THEN 'rejected' ELSE 'proposed' END FROM orders WHERE o_orderpriority LIKE '1%'",
    "fx_external": "SELECT c_custkey % 4 AS provider, CASE c_custkey % 3 WHEN 0 THEN concat('https://doi.org/10.1000/', CAST(c_custkey % 500 AS STRING)) WHEN 1 THEN concat('DOI:10.1000/', CAST(c_custkey % 500 AS STRING)) ELSE NULL END AS doi, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS title, c_mktsegment AS journal, CAST(1990 + c_custkey % 30 AS INT) AS year FROM customer",
    "fx_item": "SELECT p_partkey AS id, p_name AS label, p_brand AS keyword1, p_type AS keyword2, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_type END AS item_group FROM part",
    "fx_pool": "SELECT label AS pool_id, vec_id AS document_id FROM embeddings",
    "fx_query": "SELECT item_id AS query_id, split_part(text, '.', 1) AS text, text AS quote, item_id % 10 AS pool_id FROM benchmark",
    "fx_glossary": "SELECT * FROM (VALUES ('the','THE-u','user'), ('the','THE-m','model'), ('of the','OF-m','model'), ('and','AND-u','user'), ('and of the','AOT-u','user'), ('tion','T-m','model')) AS g(term, rendering, scope)",
    "fx_text_block": (
        r"SELECT document_id, CAST(floor(block_index / 5) AS INT) AS page_index, block_index, text, 50 AS x, 72 + 100 * (block_index % 5) AS y, 500 AS width, 90 AS height FROM (SELECT doc_id AS document_id, posexplode(split(text, '\\n')) AS (block_index, text) FROM documents)",
        "SELECT document_id, CAST(floor(block_index / 5) AS INT) AS page_index, block_index, text, 50 AS x, 72 + 100 * (block_index % 5) AS y, 500 AS width, 90 AS height FROM (SELECT doc_id AS document_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS block_index, unnest(string_split(text, chr(10))) AS text FROM documents)",
    ),
    "fx_anchor": "SELECT concat(CAST(document_id AS STRING), '-', CAST(block_index AS STRING)) AS anchor_id, document_id, v, CASE WHEN v = 1 THEN page_index + 1 ELSE page_index END AS page_index, CASE WHEN v = 3 THEN concat(substr(q, 1, 19), 'X', substr(q, 21)) WHEN v = 4 THEN reverse(q) ELSE q END AS quote, substr(text, 11, 10) AS prefix, substr(text, 61, 10) AS suffix, CASE WHEN v < 2 THEN x END AS x, CASE WHEN v < 2 THEN y END AS y, CASE WHEN v < 2 THEN width END AS width, CASE WHEN v < 2 THEN height END AS height FROM (SELECT *, (document_id + block_index) % 5 AS v, substr(text, 21, 40) AS q FROM fx_text_block WHERE length(text) >= 80)",
    "fx_link": (
        "SELECT page_id AS source_note, explode(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS target_note FROM pages",
        "SELECT page_id AS source_note, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS target_note FROM pages",
    ),
}
NAMES = re.compile(r"\bfx_[a-z_]+\b")


def text_of(name: str, duck: bool) -> str:
    text = VIEWS[name]
    text = text if isinstance(text, str) else text[duck]
    return text.replace("100.0D", "100.0::DOUBLE").replace("200.0D", "200.0::DOUBLE") if duck else text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the Parquet tables in ``sf_dir``."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = text_of(name, False)
    needed = sorted({w for w in re.findall(r"\b(?:FROM|JOIN|,)\s+([a-z_]+)\b", text) if w in BASE or w in VIEWS})
    for w in needed:
        text = re.sub(rf"\b(FROM|JOIN|,)(\s+){w}\b", rf"\1\2{{{w}}}", text)
    return spark.sql(text, **{w: view(spark, sf_dir, w) for w in needed}) if needed else spark.sql(text)


def duck(body: str) -> str:
    """``body`` with the views it names (and those they name) as common table expressions before it."""
    found: list[str] = []

    def add(text: str) -> None:
        for name in dict.fromkeys(NAMES.findall(text)):
            if name in VIEWS and name not in found:
                add(text_of(name, True))
                found.append(name)

    add(body)
    ctes = ", ".join(f"{n} AS ({text_of(n, True)})" for n in found)
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}" if ctes else body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}" if ctes else body
    return f"WITH {ctes} {body}" if ctes else body
