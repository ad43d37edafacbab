"""The registered queries, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import columns as C
from lectern.functions import udfs
from lectern.operators import graph, library, process, reader, search
from lectern.operators.index import GramIndex, TextIndex
from lectern.operators.sketches import PoolReaders
from lectern.operators.vectors import VectorIndex
from lectern.plans.fixtures import duck, view
from lectern.sources import tables
from lectern.sources.scratch import scratch
from lectern.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a view getter ``v`` (and session and folder) under ``name``."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: view(spark, sf_dir, n), spark, sf_dir)
        if sql:
            ORACLE_SQL[name] = duck(sql)
        return f

    return put


def rects(df: DataFrame) -> DataFrame:
    """Flat x, y, width, height as an array of one struct, empty where there is none."""
    cols = ["x", "y", "width", "height"]
    return df.withColumn("rects", F.when(F.col("x").isNotNull(), F.array(F.struct(*cols))).otherwise(F.array().cast("array<struct<x:int,y:int,width:int,height:int>>"))).drop(*cols)


SINCE = "1998-01-01"

# Sources and sinks


@query("load_table", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(v, spark, sf_dir):
    return tables.load_table(spark, sf_dir, "documents")


@query("register_originals", "SELECT sha256(text) AS digest, min(doc_id) AS document_id FROM documents GROUP BY 1 HAVING sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)")
def _(v, spark, sf_dir):
    d = v("documents").select(F.col("doc_id").alias("document_id"), F.encode("text", "utf-8").alias("content"))
    known = d.where("document_id % 10 = 0").select(F.sha2("content", 256).alias("digest"))
    return tables.register_originals(d, known)


@query("text_blocks", "SELECT document_id, page_index, block_index, text FROM fx_text_block")
def _(v, spark, sf_dir):
    return reader.text_blocks(v("documents").select(F.col("doc_id").alias("document_id"), "text"))


@query("read_external_metadata", "SELECT CASE provider WHEN 0 THEN 'openalex' WHEN 1 THEN 'crossref' WHEN 2 THEN 'semanticscholar' ELSE 'arxiv' END AS provider, doi, title, journal, year FROM fx_external")
def _(v, spark, sf_dir):
    base, paths = scratch(spark, "metadata"), {}
    for n, name in enumerate(schemas.PROVIDERS):
        paths[name] = f"{base}/{name}"
        v("fx_external").where(F.col("provider") == n).drop("provider").write.json(paths[name])
    return tables.read_external_metadata(spark, paths)


@query("read_result_files", "SELECT 'clicks' AS tag, ts, value, 'bar(g)' AS unit, 'demo' AS project FROM events WHERE event_type = 'click' UNION ALL SELECT 'others', ts, value, 'kg/h', 'demo' FROM events WHERE event_type <> 'click'")
def _(v, spark, sf_dir):
    path = scratch(spark, "results")
    is_click = F.col("event_type") == "click"
    v("events").select("ts", F.when(is_click, F.col("value")).alias("clicks"), F.when(~is_click, F.col("value")).alias("others")).write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    return tables.read_result_files(spark, path, {"clicks": "bar(g)", "others": "kg/h"}, "demo")


@query("write_partitioned", "SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang")
def _(v, spark, sf_dir):
    path = scratch(spark, "derived")
    tables.write_partitioned(v("documents").select("doc_id", "n_chars", "lang"), path, ["lang"])
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# Projections, filters, scalar functions


@query("clamp_pct", "SELECT id, round(CASE WHEN strength IS NOT NULL AND NOT isnan(strength) THEN greatest(0.0, least(100.0, strength)) END, 6) AS pct, CAST(floor(CASE WHEN strength IS NOT NULL AND NOT isnan(strength) THEN greatest(0.0, least(100.0, strength)) END + 0.5) AS BIGINT) AS label FROM fx_node")
def _(v, spark, sf_dir):
    return v("fx_node").select("id", F.round(C.clamp_pct(F.col("strength")), 6).alias("pct"), C.pct_label(F.col("strength")).alias("label"))


@query("fallback_label", "SELECT document_id, page_index, coalesce(nullif(label, ''), concat('Page ', page_index)) AS label FROM fx_annotation_page")
def _(v, spark, sf_dir):
    return v("fx_annotation_page").select("document_id", "page_index", C.fallback_label(F.col("label"), F.col("page_index")).alias("label"))


@query("clean_messages", r"SELECT * FROM (SELECT conv_id, turn, role, regexp_replace(content, '^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$', '', 'g') AS content FROM fx_message) WHERE content <> ''")
def _(v, spark, sf_dir):
    return library.clean_messages(v("fx_message"))


def items(v) -> DataFrame:
    return v("fx_item").select("id", "label", "item_group", C.command_search_text(F.col("label"), F.array("keyword1", "keyword2")).alias("search_text"))


@query("command_search_text", "SELECT id, concat(label, ' ', keyword1, ' ', keyword2) AS search_text FROM fx_item")
def _(v, spark, sf_dir):
    return items(v).select("id", "search_text")


@query("filter_documents", "SELECT * FROM fx_document WHERE journal IN ('src1', 'src2', 'src3') AND year BETWEEN 2005 AND 2015 AND doi IS NOT NULL")
def _(v, spark, sf_dir):
    return library.filter_documents(v("fx_document"), journal=["src1", "src2", "src3"], year_range=(2005, 2015), has_doi=True)


@query("normalize_rects", "SELECT anchor_id, round(CAST(x AS DOUBLE) / 600, 6) AS x, round(CAST(y AS DOUBLE) / 800, 6) AS y, round(CAST(width AS DOUBLE) / 600, 6) AS width, round(CAST(height AS DOUBLE) / 800, 6) AS height FROM fx_anchor WHERE x IS NOT NULL")
def _(v, spark, sf_dir):
    a = rects(v("fx_anchor"))
    pages = a.select("document_id", "page_index").distinct().withColumns({"page_width": F.lit(600), "page_height": F.lit(800)})
    return reader.normalize_rects(a, pages).select("anchor_id", F.explode("normalized_rects").alias("r")).select("anchor_id", "r.*")


QTY = r"^\s*(?:(HH|LL|H|L)\s+)?([-−]?\d+(?:\.\d+)?)\s*(\S+)(?:\s+(.*))?$"


@query("parse_quantity", f"SELECT line, seq, nullif(regexp_extract(throughput, '{QTY}', 1), '') AS limit_kind, try_cast(regexp_extract(throughput, '{QTY}', 2) AS DOUBLE) AS value, nullif(regexp_extract(throughput, '{QTY}', 3), '') AS unit, nullif(regexp_extract(throughput, '{QTY}', 4), '') AS rest FROM fx_equipment")
def _(v, spark, sf_dir):
    return v("fx_equipment").select("line", "seq", C.parse_quantity(F.col("throughput")).alias("q")).select("line", "seq", "q.*")


@query("validate_enum", "SELECT answer_id, claim_id, badge, coalesce(badge IN ('paper', 'external', 'model', 'user'), false) AS is_valid FROM fx_claim")
def _(v, spark, sf_dir):
    return v("fx_claim").withColumn("is_valid", C.is_valid(F.col("badge"), schemas.CLAIM_BADGES))


@query("unit_guard", "SELECT tag, count(DISTINCT nullif(unit, '')) AS n_units, string_agg(DISTINCT nullif(unit, ''), ',' ORDER BY nullif(unit, '')) AS units, count(DISTINCT nullif(unit, '')) = 1 AND count(*) FILTER (WHERE nullif(unit, '') IS NULL) = 0 AS is_safe FROM fx_reading GROUP BY tag")
def _(v, spark, sf_dir):
    return process.unit_guard(v("fx_reading"))


# Joins


@query("edges_with_nodes", "SELECT e.source, e.target, e.kind, s.kind AS source_kind, s.title AS source_title, s.strength AS source_strength, t.kind AS target_kind, t.title AS target_title, t.strength AS target_strength FROM fx_effect_edge e LEFT JOIN fx_node s ON e.source = s.id LEFT JOIN fx_node t ON e.target = t.id")
def _(v, spark, sf_dir):
    return graph.edges_with_nodes(v("fx_effect_edge"), v("fx_node"))


@query("validate_edges", "SELECT source, kind, target, 'missing_source' AS reason FROM fx_effect_edge WHERE source NOT IN (SELECT id FROM fx_node) UNION ALL SELECT source, kind, target, 'missing_target' FROM fx_effect_edge WHERE target NOT IN (SELECT id FROM fx_node) UNION ALL SELECT source, kind, target, 'unknown_class' FROM fx_effect_edge WHERE kind NOT IN ('uses', 'increases', 'decreases')")
def _(v, spark, sf_dir):
    return graph.validate_edges(v("fx_effect_edge"), v("fx_node"), ["uses", "increases", "decreases"])


@query("nodes_without_evidence", "SELECT id, kind, title, strength FROM fx_node WHERE id NOT IN (SELECT source FROM fx_evidence)")
def _(v, spark, sf_dir):
    return graph.nodes_without_evidence(v("fx_node"), v("fx_evidence"))


@query("nodes_with_evidence", "SELECT id, kind, title, strength FROM fx_node WHERE id IN (SELECT source FROM fx_evidence)")
def _(v, spark, sf_dir):
    return graph.nodes_with_evidence(v("fx_node"), v("fx_evidence"))


@query("resolve_aliases", "WITH a AS (SELECT lower(p_name) AS k, min(p_partkey) AS concept_id FROM part GROUP BY 1) SELECT m.mention, a.concept_id FROM (SELECT concat('  ', CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, ' x') ELSE p_name END, ' ') AS mention, lower(CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, ' x') ELSE p_name END) AS k FROM part) m LEFT JOIN a ON m.k = a.k")
def _(v, spark, sf_dir):
    p = v("part")
    mentions = p.select(F.concat(F.lit("  "), F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name")), F.lit(" ")).alias("mention"))
    return library.resolve_aliases(mentions, p.select(F.upper("p_name").alias("alias"), F.col("p_partkey").alias("concept_id")))


@query("apply_glossary", "WITH t AS (SELECT DISTINCT lower(split_part(text, ' ', 1)) AS term FROM benchmark UNION SELECT term FROM fx_glossary) SELECT t.term, coalesce(u.rendering, m.rendering, t.term) AS rendering, CASE WHEN u.rendering IS NOT NULL THEN 'user' WHEN m.rendering IS NOT NULL THEN 'model' END AS scope FROM t LEFT JOIN fx_glossary u ON t.term = u.term AND u.scope = 'user' LEFT JOIN fx_glossary m ON t.term = m.term AND m.scope = 'model'")
def _(v, spark, sf_dir):
    terms = v("benchmark").select(F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("term")).union(v("fx_glossary").select("term")).distinct()
    return reader.apply_glossary(terms, v("fx_glossary"))


SPOTTED = r"""
    WITH t AS (SELECT document_id, block_index, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS raw FROM (SELECT document_id, block_index, regexp_split_to_array(text, '[ \t]+') AS a FROM fx_text_block)),
    w AS (SELECT document_id, block_index, pos, lower(regexp_replace(raw, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) AS token FROM t),
    l AS (SELECT *, lead(token) OVER p AS second, lead(token, 2) OVER p AS third FROM w WINDOW p AS (PARTITION BY document_id, block_index ORDER BY pos)),
    g AS (SELECT document_id, block_index, pos, token AS term, 1 AS n_words FROM l UNION ALL SELECT document_id, block_index, pos, token || ' ' || second, 2 FROM l UNION ALL SELECT document_id, block_index, pos, token || ' ' || second || ' ' || third, 3 FROM l),
    h AS (SELECT g.*, row_number() OVER (PARTITION BY document_id, block_index, pos ORDER BY n_words DESC) AS r FROM g WHERE term IN (SELECT term FROM fx_glossary))
    SELECT document_id, block_index, pos, term, n_words FROM h WHERE r = 1"""


@query("spot_terms", SPOTTED)
def _(v, spark, sf_dir):
    return reader.spot_terms(v("fx_text_block"), v("fx_glossary"))


@query("spot_terms_trie", SPOTTED)
def _(v, spark, sf_dir):
    return reader.spot_terms(v("fx_text_block"), v("fx_glossary"), max_terms=0)


@query("trace_provenance", "SELECT e.evidence_id, e.document_id, e.anchor_id, a.page_index, a.quote, d.title, CASE WHEN e.anchor_id IS NULL THEN 'no_anchor' WHEN a.quote IS NULL THEN 'missing_anchor' WHEN d.document_id IS NULL THEN 'missing_document' ELSE 'ok' END AS status FROM fx_trace e LEFT JOIN fx_anchor a ON e.anchor_id = a.anchor_id LEFT JOIN fx_document d ON e.document_id = d.document_id")
def _(v, spark, sf_dir):
    return graph.trace_provenance(v("fx_trace"), v("fx_anchor"), v("fx_document"))


HITS = """SELECT a.anchor_id, a.document_id, b.block_index, CAST((least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * (least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) AS BIGINT) AS area
    FROM fx_anchor a JOIN fx_text_block b ON a.document_id = b.document_id AND a.page_index = b.page_index
    AND a.x < b.x + b.width AND b.x < a.x + a.width AND a.y < b.y + b.height AND b.y < a.y + a.height"""


@query("rect_hits", HITS)
def _(v, spark, sf_dir):
    return reader.rect_hits(rects(v("fx_anchor")), v("fx_text_block"))


def n_of(s: str) -> str:
    return f"CAST((length(b.text) - length(replace(b.text, {s}, ''))) // length({s}) AS BIGINT)"


EXACT = f"""
    h AS ({HITS}),
    c AS (SELECT a.anchor_id, b.block_index, instr(b.text, a.quote) AS pos, {n_of('a.quote')} AS n,
          {n_of('concat(a.prefix, a.quote)')} + {n_of('concat(a.quote, a.suffix)')} - {n_of('concat(a.prefix, a.quote, a.suffix)')} AS nc,
          CASE WHEN instr(b.text, concat(a.prefix, a.quote)) > 0 THEN instr(b.text, concat(a.prefix, a.quote)) + length(a.prefix) WHEN instr(b.text, concat(a.quote, a.suffix)) > 0 THEN instr(b.text, concat(a.quote, a.suffix)) END AS pos_c,
          h.anchor_id IS NOT NULL AS hit
          FROM fx_anchor a JOIN fx_text_block b ON a.document_id = b.document_id AND contains(b.text, a.quote) LEFT JOIN h ON h.anchor_id = a.anchor_id AND h.block_index = b.block_index),
    g AS (SELECT anchor_id, sum(n) AS n, sum(nc) AS nc, min(block_index) AS ab, arg_min(pos, block_index) AS ap,
          min(block_index) FILTER (WHERE hit) AS gb, arg_min(pos, block_index) FILTER (WHERE hit) AS gp, min(block_index) FILTER (WHERE nc > 0) AS cb, arg_min(pos_c, block_index) FILTER (WHERE nc > 0) AS cp FROM c GROUP BY 1),
    r AS (SELECT a.anchor_id, a.document_id, a.quote, a.page_index, CASE WHEN gb IS NOT NULL THEN 'geometry' WHEN n = 1 THEN 'quote' WHEN n > 1 AND nc = 1 THEN 'context' ELSE 'unresolved' END AS method, g.* EXCLUDE (anchor_id) FROM fx_anchor a LEFT JOIN g ON a.anchor_id = g.anchor_id),
    p AS (SELECT *, CASE method WHEN 'geometry' THEN gb WHEN 'quote' THEN ab WHEN 'context' THEN cb END AS block_index, CASE method WHEN 'geometry' THEN gp WHEN 'quote' THEN ap WHEN 'context' THEN cp END AS pos FROM r)"""
#: The edit distance of the quote to the nearest stretch of a text from each of its characters on (both reversed), a column of its table as two numbers with a bit for each character of the quote.
FUZZY = """
    fk AS (SELECT anchor_id, block_index, length(text) AS n, length(quote) AS m, string_split(reverse(text), '') AS t, string_split(reverse(quote), '') AS q FROM {pairs} WHERE length(text) > 0),
    fe AS (SELECT *, map_from_entries(list_transform(list_distinct(q), lambda c: {{'k': c, 'v': list_sum(list_transform(range(1, m + 1), lambda i: CASE WHEN q[i] = c THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT}})) AS eq,
                 (1::BIGINT << m) - 1 AS whole, 1::BIGINT << (m - 1) AS top FROM fk),
    fs AS (SELECT anchor_id, block_index, n, m, list_reduce(list_zip(t, range(0, n)), lambda s, c: list_transform([coalesce(eq[c[1]], 0)], lambda x:
                 list_transform([(xor(((x | s.down) & s.up) + s.up, s.up) | x | s.down) & whole], lambda z: list_transform([{{'z': z, 'more': (s.down | ~(z | s.up)) & whole, 'less': s.up & z}}], lambda w:
                 list_transform([s.d + ((w.more & top) <> 0)::BIGINT - ((w.less & top) <> 0)::BIGINT], lambda d: {{
                     'up': ((w.less << 1) | ~(w.z | (w.more << 1))) & whole, 'down': (w.more << 1) & w.z & whole, 'd': d, 'best': least(s.best, d),
                     'high': CASE WHEN d < s.best THEN c[2] ELSE s.high END, 'low': CASE WHEN d <= s.best THEN c[2] ELSE s.low END}})[1])[1])[1])[1],
                 {{'up': whole, 'down': 0::BIGINT, 'd': m, 'best': 99999::BIGINT, 'high': 0::BIGINT, 'low': 0::BIGINT}}) AS s FROM fe),
    f AS (SELECT anchor_id, block_index, CAST(n - s.low AS INT) AS pos, 1 - s.best / m::DOUBLE AS similarity, s.low - s.high < m AS is_unique FROM fs)"""


@query("recover_anchors_exact", f"""
    WITH {EXACT}
    SELECT anchor_id, method, block_index, pos, coalesce(method IN ('quote', 'context') AND CAST(floor(block_index / 5) AS INT) <> page_index, false) AS moved FROM p""")
def _(v, spark, sf_dir):
    return reader.recover_anchors(rects(v("fx_anchor")), v("fx_text_block"), threshold=None)


@query("recover_anchors", f"""
    WITH {EXACT},
    fp AS (SELECT p.anchor_id, b.block_index, b.text, p.quote FROM p JOIN fx_text_block b ON p.document_id = b.document_id AND b.page_index BETWEEN p.page_index - 1 AND p.page_index + 1 WHERE p.method = 'unresolved' AND coalesce(p.n, 0) = 0),
    {FUZZY.format(pairs='fp')},
    ft AS (SELECT * FROM f WHERE similarity >= 0.8 QUALIFY similarity = max(similarity) OVER (PARTITION BY anchor_id)),
    fb AS (SELECT anchor_id, min(block_index) AS block_index, min(pos) AS pos FROM ft GROUP BY 1 HAVING count(*) = 1 AND bool_and(is_unique)),
    z AS (SELECT p.anchor_id, p.page_index, CASE WHEN fb.anchor_id IS NOT NULL THEN 'fuzzy' ELSE p.method END AS method, coalesce(fb.block_index, p.block_index) AS block_index, coalesce(fb.pos, p.pos) AS pos FROM p LEFT JOIN fb ON p.anchor_id = fb.anchor_id)
    SELECT anchor_id, method, block_index, pos, coalesce(method IN ('quote', 'context', 'fuzzy') AND CAST(floor(block_index / 5) AS INT) <> page_index, false) AS moved FROM z""")
def _(v, spark, sf_dir):
    return reader.recover_anchors(rects(v("fx_anchor")), v("fx_text_block"))


@query("asof_align", "WITH r AS (SELECT tag, ts, max(value) AS value FROM fx_reading GROUP BY tag, ts) SELECT e.event_id, e.tag, e.ts, r.value FROM fx_shift_event e ASOF LEFT JOIN r ON e.tag = r.tag AND e.ts >= r.ts")
def _(v, spark, sf_dir):
    return process.asof_align(v("fx_shift_event"), v("fx_reading"))


@query("asof_align_tolerance", "WITH r AS (SELECT tag, ts, max(value) AS value FROM fx_reading GROUP BY tag, ts) SELECT e.event_id, e.tag, e.ts, CASE WHEN r.ts >= e.ts - INTERVAL '5' MINUTE THEN r.value END AS value FROM fx_shift_event e ASOF LEFT JOIN r ON e.tag = r.tag AND e.ts >= r.ts")
def _(v, spark, sf_dir):
    return process.asof_align(v("fx_shift_event"), v("fx_reading"), "5 minutes")


CLASSIFIED = "SELECT r.tag, r.ts, r.value, r.unit, r.event_id, CASE WHEN value >= alarm THEN 'alarm' WHEN value >= warn THEN 'warn' ELSE 'normal' END AS state FROM fx_reading r LEFT JOIN fx_limit l ON r.tag = l.tag"


def classified(v) -> DataFrame:
    return process.classify_readings(v("fx_reading"), v("fx_limit"))


@query("classify_readings", CLASSIFIED)
def _(v, spark, sf_dir):
    return classified(v)


@query("events_in_shift", "SELECT e.event_id, e.tag, e.ts, s.start_ts, CAST(floor((epoch_us(e.ts) - epoch_us(s.start_ts)) / 60000000) AS BIGINT) AS minutes_in FROM fx_shift_event e JOIN fx_shift s ON e.ts >= s.start_ts AND e.ts < s.end_ts")
def _(v, spark, sf_dir):
    return process.events_in_shift(v("fx_shift_event"), v("fx_shift"))


DOI = r"regexp_replace(lower(trim(doi)), '^(https?://(dx\.)?doi\.org/|doi:\s*)', '')"
PAPERS = rf"""SELECT key, arg_min(d, provider) FILTER (WHERE d IS NOT NULL) AS doi, (min(struct_pack(p := provider, x := title)) FILTER (WHERE title IS NOT NULL)).x AS title, (min(struct_pack(p := provider, x := journal)) FILTER (WHERE journal IS NOT NULL)).x AS journal,
    (min(struct_pack(p := provider, x := year)) FILTER (WHERE year IS NOT NULL)).x AS year, string_agg(DISTINCT CAST(provider AS VARCHAR), ',' ORDER BY CAST(provider AS VARCHAR)) AS providers
    FROM (SELECT *, coalesce('doi:' || d, 'title:' || t || '|' || coalesce(CAST(year AS VARCHAR), ''), 'row:' || coalesce(journal, '') || '|' || coalesce(CAST(year AS VARCHAR), '') || '|' || CAST(provider AS VARCHAR)) AS key
          FROM (SELECT *, nullif({DOI}, '') AS d, nullif(lower(regexp_replace(trim(title), '\s+', ' ', 'g')), '') AS t FROM fx_external)) GROUP BY key"""


@query("consolidate_metadata", PAPERS)
def _(v, spark, sf_dir):
    return library.consolidate_metadata(v("fx_external"))


@query("link_local_papers", f"WITH p AS ({PAPERS}) SELECT f.document_id, f.doi, p.title AS paper_title, CASE WHEN f.doi IS NULL THEN 'no_doi' WHEN p.key IS NULL THEN 'not_found' ELSE 'linked' END AS status FROM fx_document f LEFT JOIN p ON f.doi = p.doi")
def _(v, spark, sf_dir):
    return library.link_local_papers(v("fx_document"), library.consolidate_metadata(v("fx_external")))


# Aggregations


@query("annotations_per_page", "SELECT p.document_id, p.page_index, p.label, count(a.event_id) AS n_annotations FROM fx_annotation_page p LEFT JOIN fx_annotation_log a ON p.document_id = a.document_id AND p.page_index = a.page_index GROUP BY ALL")
def _(v, spark, sf_dir):
    return library.annotations_per_page(v("fx_annotation_log"), v("fx_annotation_page"))


@query("backlinks", "SELECT target_note, source_note, count(*) AS n_contexts, concat('Mentions this note in ', count(*), ' linked context', CASE WHEN count(*) > 1 THEN 's' ELSE '' END) AS text FROM fx_link GROUP BY 1, 2")
def _(v, spark, sf_dir):
    return library.backlinks(v("fx_link"))


@query("folder_counts", "SELECT project, folder, count(*) AS n_notes, CAST(grouping_id(project, folder) AS BIGINT) AS level FROM fx_note GROUP BY ROLLUP (project, folder)")
def _(v, spark, sf_dir):
    return library.folder_counts(v("fx_note"))


@query("tag_counts", "SELECT tag, count(DISTINCT note_id) AS n_notes FROM (SELECT note_id, type AS tag FROM fx_note UNION ALL SELECT note_id, author_kind FROM fx_note) GROUP BY tag")
def _(v, spark, sf_dir):
    return library.tag_counts(v("fx_note").withColumn("tags", F.array("type", "author_kind")))


SEEN = "SELECT document_id, count(DISTINCT page_index) AS pages_seen FROM fx_activity GROUP BY 1"


@query("paper_cards", f"""WITH s AS ({SEEN}), n AS (SELECT document_id, count(*) AS n_notes, count(*) FILTER (WHERE type = 'Research Question' AND NOT resolved) AS q FROM fx_note GROUP BY 1)
    SELECT d.document_id, d.title, d.journal, d.year, round(least(100.0, 100.0 * coalesce(s.pages_seen, 0) / d.n_pages), 6) AS progress, coalesce(n.n_notes, 0) AS n_notes, coalesce(n.q, 0) AS n_open_questions, CASE WHEN doi IS NULL THEN 'no_doi' ELSE 'has_doi' END AS doi_status, 'local' AS badge
    FROM fx_document d LEFT JOIN s ON d.document_id = s.document_id LEFT JOIN n ON d.document_id = n.document_id""")
def _(v, spark, sf_dir):
    return library.paper_cards(v("fx_document"), v("fx_activity"), v("fx_note"))


CONTRA = """SELECT source, target, 'contradicts' AS reason FROM fx_effect_edge WHERE kind = 'contradicts' UNION ALL
    SELECT source, target, 'opposite_effects' FROM fx_effect_edge GROUP BY source, target HAVING max(CASE WHEN kind = 'increases' THEN 1 ELSE 0 END) + max(CASE WHEN kind = 'decreases' THEN 1 ELSE 0 END) = 2"""


@query("contradictions", CONTRA)
def _(v, spark, sf_dir):
    return graph.contradictions(v("fx_effect_edge"))


FRESH = f"SELECT source, target, count(*) FILTER (WHERE created_at > TIMESTAMP '{SINCE}') AS n_new, min(created_at) > TIMESTAMP '{SINCE}' AS is_first FROM fx_evidence GROUP BY 1, 2 HAVING count(*) FILTER (WHERE created_at > TIMESTAMP '{SINCE}') > 0"


@query("new_evidence", FRESH)
def _(v, spark, sf_dir):
    return graph.new_evidence(v("fx_evidence"), SINCE)


OPEN = """SELECT id, about, CASE WHEN u THEN 'unanswered_by' ELSE 'no_answer' END AS reason FROM (SELECT *, id IN (SELECT source FROM fx_answer_edge WHERE kind = 'answered-by' AND status = 'confirmed') AS a, id IN (SELECT source FROM fx_answer_edge WHERE kind = 'unanswered-by' AND status <> 'rejected') AS u FROM fx_question) WHERE NOT a OR u"""


@query("open_questions", OPEN)
def _(v, spark, sf_dir):
    return graph.open_questions(v("fx_question"), v("fx_answer_edge"))


OVERLAP = """SELECT p.paper_a, p.paper_b, p.shared, round(p.shared / CAST(a.n + b.n - p.shared AS DOUBLE), 6) AS jaccard
    FROM (SELECT x.source AS paper_a, y.source AS paper_b, count(*) AS shared FROM fx_uses x JOIN fx_uses y ON x.target = y.target AND x.source < y.source GROUP BY 1, 2 HAVING count(*) >= 2) p
    JOIN (SELECT source, count(*) AS n FROM fx_uses GROUP BY 1) a ON a.source = p.paper_a JOIN (SELECT source, count(*) AS n FROM fx_uses GROUP BY 1) b ON b.source = p.paper_b"""


@query("method_overlaps", OVERLAP)
def _(v, spark, sf_dir):
    return graph.method_overlaps(v("fx_uses"))


WEAK = """SELECT * FROM (SELECT e.source, e.target, coalesce(p.n, 0) AS n_evidence, round(coalesce(p.c, 0), 6) AS confidence, CASE WHEN least(a.d, b.d) < 2 THEN 'insufficient_data' ELSE 'weak' END AS label, coalesce(p.c, 0) AS c
    FROM (SELECT DISTINCT source, target FROM fx_effect_edge) e LEFT JOIN (SELECT source, target, count(*) AS n, avg(confidence) AS c FROM fx_evidence GROUP BY 1, 2) p ON e.source = p.source AND e.target = p.target
    JOIN (SELECT source AS id, count(DISTINCT target) AS d FROM fx_effect_edge GROUP BY 1) a ON a.id = e.source JOIN (SELECT target AS id, count(DISTINCT source) AS d FROM fx_effect_edge GROUP BY 1) b ON b.id = e.target) WHERE n_evidence < 2 OR round(c, 9) < 0.6"""


@query("weak_connections", f"SELECT source, target, n_evidence, confidence, label FROM ({WEAK})")
def _(v, spark, sf_dir):
    return graph.weak_connections(v("fx_effect_edge"), v("fx_evidence"), 2, 0.6, 2)


@query("evidence_signals", f"""
    SELECT 'contradiction' AS signal, source AS subject, target AS object, 1.0::DOUBLE AS score, reason AS detail FROM ({CONTRA}) UNION ALL
    SELECT 'new_evidence', source, target, n_new, CASE WHEN is_first THEN 'first' ELSE 'more' END FROM ({FRESH}) UNION ALL
    SELECT 'open_question', id, about, 1.0, reason FROM ({OPEN}) UNION ALL
    SELECT 'method_overlap', paper_a, paper_b, jaccard, concat('shared ', shared) FROM ({OVERLAP}) UNION ALL
    SELECT 'weak_connection', source, target, confidence, label FROM ({WEAK})""")
def _(v, spark, sf_dir):
    return graph.evidence_signals(v("fx_effect_edge"), v("fx_evidence"), v("fx_question"), v("fx_answer_edge"), v("fx_uses"), SINCE)


@query("node_degrees", "WITH e AS (SELECT source AS id, 1 AS o, 0 AS i FROM fx_effect_edge UNION ALL SELECT target, 0, 1 FROM fx_effect_edge), g AS (SELECT id, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, count(*) AS degree FROM e GROUP BY id) SELECT *, degree = max(degree) OVER () AS is_hub FROM g")
def _(v, spark, sf_dir):
    return graph.node_degrees(v("fx_effect_edge"))


@query("kind_counts", "SELECT e.kind, s.kind AS source_kind, t.kind AS target_kind, count(*) AS n_edges, CAST(grouping(s.kind) AS INT) AS is_total FROM fx_effect_edge e LEFT JOIN fx_node s ON e.source = s.id LEFT JOIN fx_node t ON e.target = t.id GROUP BY GROUPING SETS ((e.kind, s.kind, t.kind), (e.kind))")
def _(v, spark, sf_dir):
    return graph.kind_counts(v("fx_effect_edge"), v("fx_node"))


@query("claim_mix", "SELECT answer_id, count(*) FILTER (WHERE badge = 'paper') AS n_paper, count(*) FILTER (WHERE badge = 'external') AS n_external, count(*) FILTER (WHERE badge = 'model') AS n_model, count(*) FILTER (WHERE badge = 'user') AS n_user, count(*) FILTER (WHERE badge IS NULL) AS n_unlabelled, count(*) FILTER (WHERE badge IS NULL) = 0 AS is_clean FROM fx_claim GROUP BY 1")
def _(v, spark, sf_dir):
    return library.claim_mix(v("fx_claim"))


def messages_with_sources(v) -> DataFrame:
    n = F.when(F.col("role") == "assistant", (F.col("conv_id") + F.col("turn")) % 3).otherwise(0).cast("int")
    source = lambda i: (F.col("conv_id") + 13 * F.col("turn") + i) % 200
    made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(source(i).alias("id"), F.concat(F.lit("src"), source(i)).alias("label")))
    return v("fx_message").withColumn("sources", F.when(n > 0, made))


@query("cited_sources", "SELECT (conv_id + 13 * turn + i) % 200 AS source_id, concat('src', (conv_id + 13 * turn + i) % 200) AS label, count(DISTINCT (conv_id, turn)) AS n_answers FROM fx_message, (VALUES (1), (2)) AS k(i) WHERE role = 'assistant' AND i <= (conv_id + turn) % 3 GROUP BY 1, 2")
def _(v, spark, sf_dir):
    return library.cited_sources(messages_with_sources(v))


@query("uncited_answers", "SELECT conv_id, turn FROM fx_message WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0")
def _(v, spark, sf_dir):
    return library.uncited_answers(messages_with_sources(v))


@query("tag_summary", "SELECT tag, unit, (max(struct_pack(ts := ts, v := value))).v AS latest, min(value) AS lowest, max(value) AS highest, round(avg(value), 6) AS mean, count(*) AS n FROM fx_reading GROUP BY tag, unit")
def _(v, spark, sf_dir):
    return process.tag_summary(v("fx_reading"))


@query("metric_trend", "WITH t AS (SELECT tag, CAST(date_trunc('day', ts) AS TIMESTAMP) AS period_start, round(sum(value), 4) AS total FROM fx_reading GROUP BY 1, 2), c AS (SELECT *, round(total - lag(total) OVER (PARTITION BY tag ORDER BY period_start), 4) AS change FROM t) SELECT *, CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' END AS direction FROM c")
def _(v, spark, sf_dir):
    return process.metric_trend(v("fx_reading"))


@query("pool_summary", "WITH m AS (SELECT p.* FROM fx_pool p WHERE document_id IN (SELECT document_id FROM fx_document)), a AS (SELECT pool_id, count(DISTINCT document_id) AS n_papers FROM m GROUP BY 1), b AS (SELECT pool_id, count(DISTINCT user_id) AS n_readers, max(ts) AS last_activity FROM m JOIN fx_activity x ON m.document_id = x.document_id GROUP BY 1) SELECT a.pool_id, n_papers, coalesce(n_readers, 0) AS n_readers, last_activity FROM a LEFT JOIN b ON a.pool_id = b.pool_id")
def _(v, spark, sf_dir):
    return library.pool_summary(v("fx_pool"), v("fx_document"), v("fx_activity")).drop("n_readers_approx")


@query("pool_summary_approx")
def _(v, spark, sf_dir):
    return library.pool_summary(v("fx_pool"), v("fx_document"), v("fx_activity"))


READERS = "SELECT pool_id, count(DISTINCT user_id) AS n, max(ts) AS last_activity FROM fx_pool p JOIN fx_activity x ON p.document_id = x.document_id"


@query("pool_readers_stored", f"SELECT pool_id, last_activity, true AS is_close FROM ({READERS} GROUP BY 1)")
def _(v, spark, sf_dir):
    """Sketches by day, added in two steps and united; close is within 5 per cent, three standard errors, of the exact count."""
    stored, late = PoolReaders(spark, scratch(spark, "pool-readers")), F.dayofmonth("ts") > 15
    for days in (~late, late):
        stored.add(v("fx_pool"), v("fx_activity").where(days))
    exact = v("fx_pool").join(v("fx_activity"), "document_id").groupBy("pool_id").agg(F.countDistinct("user_id").alias("n"))
    close = F.abs(F.col("n_readers_approx") - F.col("n")) <= 0.05 * F.col("n")
    return stored.summary().join(exact, "pool_id").select("pool_id", "last_activity", close.alias("is_close"))


@query("group_items", "SELECT group_name, min(id) OVER (PARTITION BY group_name) AS first_pos, count(*) OVER (PARTITION BY group_name) AS n_items, id, label FROM (SELECT coalesce(nullif(item_group, ''), 'Commands') AS group_name, id, label FROM fx_item)")
def _(v, spark, sf_dir):
    return library.group_items(v("fx_item"))


# Windows, sorting, top-k


@query("sparkline_points", "WITH p AS (SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY ts, event_id) - 1 AS i, value, count(*) OVER (PARTITION BY tag) AS n, min(value) OVER (PARTITION BY tag) AS lo, max(value) OVER (PARTITION BY tag) AS hi FROM fx_reading) SELECT tag, i, round(CASE WHEN n = 1 THEN 0 ELSE i / CAST(n - 1 AS DOUBLE) * 100 END, 6) AS x, round(36 - (value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 30, 6) AS y FROM p")
def _(v, spark, sf_dir):
    return process.sparkline_points(v("fx_reading"))


@query("last_n_readings", "WITH b AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ts DESC, event_id DESC) AS b FROM fx_reading) SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY b DESC) AS k, ts, value FROM b WHERE b <= 7")
def _(v, spark, sf_dir):
    return process.last_n_readings(v("fx_reading"))


TRANSITIONS = f"WITH c AS ({CLASSIFIED}), f AS (SELECT *, lag(state) OVER (PARTITION BY tag ORDER BY ts, event_id) AS from_state FROM c), k AS (SELECT *, lag(ts) OVER (PARTITION BY tag ORDER BY ts, event_id) AS since FROM f WHERE from_state IS NULL OR from_state <> state) SELECT tag, ts, from_state, state AS to_state, round((epoch_us(ts) - epoch_us(since)) / 1e6, 3) AS seconds_before, event_id FROM k WHERE from_state IS NOT NULL"


@query("alarm_transitions", TRANSITIONS)
def _(v, spark, sf_dir):
    return process.alarm_transitions(classified(v))


@query("alarm_queue", f"WITH c AS ({CLASSIFIED}), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY tag ORDER BY ts DESC, event_id DESC) = 1) SELECT tag, state, ts, value, CAST(dense_rank() OVER (ORDER BY CASE state WHEN 'alarm' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, ts DESC) AS INT) AS rank FROM l")
def _(v, spark, sf_dir):
    return process.alarm_queue(classified(v))


@query("line_balance", "WITH r AS (SELECT line, seq, CAST(split_part(throughput, ' ', 1) AS DOUBLE) AS rate FROM fx_equipment) SELECT line, seq, rate, round(rate / lag(rate) OVER (PARTITION BY line ORDER BY seq), 6) AS step_yield, round(rate / first_value(rate) OVER (PARTITION BY line ORDER BY seq), 6) AS overall_yield FROM r")
def _(v, spark, sf_dir):
    return process.line_balance(v("fx_equipment"))


@query("continue_reading", "WITH g AS (SELECT user_id, a.document_id, max(ts) AS last_ts, round(least(100.0, 100.0 * count(DISTINCT page_index) / any_value(n_pages)), 6) AS progress FROM fx_activity a JOIN fx_document d ON a.document_id = d.document_id GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, document_id) AS INT) AS rank FROM g WHERE progress < 100) SELECT user_id, document_id, rank, progress, last_ts FROM r WHERE rank <= 3")
def _(v, spark, sf_dir):
    return library.continue_reading(v("fx_activity"), v("fx_document"))


@query("latest_edge_status", "SELECT source, target, (max(struct_pack(ts := ts, seq := seq, s := status))).s AS status, (max(struct_pack(ts := ts, seq := seq, s := status))).s = 'confirmed' AS on_map FROM fx_edge_log GROUP BY 1, 2")
def _(v, spark, sf_dir):
    return graph.latest_edge_status(v("fx_edge_log"))


@query("illegal_transitions", "WITH s AS (SELECT source, target, lag(status) OVER (PARTITION BY source, target ORDER BY ts, seq, status) AS from_status, status AS to_status, ts, seq FROM fx_edge_log) SELECT * FROM s WHERE from_status IS NOT NULL AND from_status <> to_status AND NOT (from_status = 'proposed' AND to_status IN ('confirmed', 'rejected'))")
def _(v, spark, sf_dir):
    allowed = spark.createDataFrame([("proposed", "confirmed"), ("proposed", "rejected")], "from_status string, to_status string")
    return graph.illegal_transitions(v("fx_edge_log"), allowed)


@query("turn_pairs", "WITH n AS (SELECT conv_id, turn, role, content, lead(role) OVER w AS r, lead(content) OVER w AS c FROM fx_message WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, content AS question, CASE WHEN r = 'assistant' THEN c END AS answer FROM n WHERE role = 'user'")
def _(v, spark, sf_dir):
    return library.turn_pairs(v("fx_message"))


SESSIONS = "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS n FROM fx_activity), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_events"


@query("reading_sessions", SESSIONS + ", count(DISTINCT document_id) AS n_documents FROM s GROUP BY user_id, s")
def _(v, spark, sf_dir):
    return library.reading_sessions(v("fx_activity"))


# Search

TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
BM25 = f"""
    WITH d AS (SELECT doc_id AS document_id, {TOKENS.format('text')} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
    q AS (SELECT DISTINCT query_id, unnest({TOKENS.format('text')}) AS term FROM fx_query),
    tf AS (SELECT term, document_id, count(*) AS tf FROM (SELECT document_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT q.query_id, tf.document_id, round(sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len(d.w) / n.a))), 6) AS score FROM q JOIN tf ON q.term = tf.term JOIN df ON q.term = df.term JOIN d ON d.document_id = tf.document_id CROSS JOIN n GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INT) AS rank FROM s)"""


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(v) -> DataFrame:
    return v("documents").select(F.col("doc_id").alias("document_id"), "text")


INDEXES: dict[tuple, TextIndex | GramIndex | VectorIndex] = {}


def stored(kind: Callable, spark: SparkSession, sf_dir: str, name: str, rows) -> TextIndex | GramIndex | VectorIndex:
    """The index over ``rows()``, built by the first query of the application that asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in INDEXES:
        INDEXES[key] = kind(spark, scratch(spark, f"index-{name}")).append(rows())
    return INDEXES[key]


@query("index_terms", f"SELECT term, count(*) AS df, max(tf) AS max_tf FROM (SELECT document_id, term, count(*) AS tf FROM (SELECT doc_id AS document_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def _(v, spark, sf_dir):
    return stored(TextIndex, spark, sf_dir, "terms", lambda: texts(v)).term_stats().select("term", "df", F.col("max_tf").cast("long").alias("max_tf"))


@query("index_grams", """
    WITH t AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents),
    g AS (SELECT DISTINCT doc_id, c || lead(c) OVER w || lead(c, 2) OVER w AS gram FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT gram, count(*) AS df FROM g WHERE gram IS NOT NULL GROUP BY 1""")
def _(v, spark, sf_dir):
    return stored(GramIndex, spark, sf_dir, "grams", lambda: texts(v)).gram_stats(3)


@query("fulltext_search", f"{BM25} SELECT query_id, document_id, score, rank FROM r WHERE rank <= 10")
def _(v, spark, sf_dir):
    return stored(TextIndex, spark, sf_dir, "terms", lambda: texts(v)).search(v("fx_query"), 10).select("query_id", "document_id", "score", "rank")


@query("quote_search", "SELECT q.query_id, d.doc_id AS document_id, CAST(instr(d.text, q.quote) AS INT) AS pos FROM fx_query q JOIN documents d ON contains(d.text, q.quote)")
def _(v, spark, sf_dir):
    return stored(GramIndex, spark, sf_dir, "grams", lambda: texts(v)).find(v("fx_query"), texts(v))


@query("search_in_document", """
    WITH RECURSIVE b AS (SELECT document_id, page_index, block_index, lower(text) AS t FROM fx_text_block WHERE document_id = 8),
    o AS (SELECT document_id, page_index, block_index, t, instr(t, 'en') AS pos FROM b WHERE instr(t, 'en') > 0 UNION ALL
          SELECT document_id, page_index, block_index, t, pos + 1 + instr(substr(t, pos + 2), 'en') FROM o WHERE instr(substr(t, pos + 2), 'en') > 0)
    SELECT document_id, page_index, block_index, CAST(pos AS INT) AS pos FROM o""")
def _(v, spark, sf_dir):
    return search.search_in_document(v("fx_text_block"), 8, "En")


def vectors(v) -> DataFrame:
    return v("embeddings").select(F.col("vec_id").alias("document_id"), "embedding")


def vector_queries(v) -> DataFrame:
    return v("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


COS = """WITH c AS (SELECT q.vec_id AS query_id, d.vec_id AS document_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings d ON q.vec_id % 50 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INT) AS rank FROM c)"""


@query("vector_search", f"{COS} SELECT query_id, document_id, score, rank FROM r WHERE rank <= 10")
def _(v, spark, sf_dir):
    return search.vector_search(vectors(v), vector_queries(v))


@query("vector_search_lists")
def _(v, spark, sf_dir):
    index = stored(lambda spark, path: VectorIndex(spark, path, vectors(v)), spark, sf_dir, "vectors", lambda: vectors(v))
    return index.search(vector_queries(v), vectors(v))


@query("cosine", "SELECT a.vec_id AS query_id, b.vec_id AS document_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(v, spark, sf_dir):
    e = v("embeddings")
    b = e.select(F.col("vec_id").alias("document_id"), F.col("embedding").alias("other"))
    pairs = e.join(b, F.col("document_id") == F.col("vec_id") + 1)
    return pairs.select(F.col("vec_id").alias("query_id"), "document_id", F.round(udfs.cosine_batch("embedding", "other"), 6).alias("similarity"))


@query("fuzzy_locate", f"""
    WITH fp AS (SELECT a.anchor_id, b.block_index, b.text, a.quote FROM fx_anchor a JOIN fx_text_block b ON a.document_id = b.document_id AND a.page_index = b.page_index),
    {FUZZY.format(pairs='fp')}
    SELECT anchor_id, block_index, pos, similarity, is_unique FROM f UNION ALL SELECT anchor_id, block_index, NULL, 0.0::DOUBLE, false FROM fp WHERE text = ''""")
def _(v, spark, sf_dir):
    rows = v("fx_anchor").select("anchor_id", "document_id", "page_index", "quote").join(v("fx_text_block").select("document_id", "page_index", "block_index", "text"), ["document_id", "page_index"])
    return rows.select("anchor_id", "block_index", udfs.fuzzy_locate("text", "quote", F.lit(0.0)).alias("f")).select("anchor_id", "block_index", "f.*")


WEIGHTS = {"text": 0.5, "quote": 0.3, "vector": 0.4, "local": 0.1, "adjacent": 0.1, "exact_term": 0.1, "in_pool": 0.1, "authority": 0.05}


@query("hybrid_search", f"""{BM25},
    tx AS (SELECT query_id, document_id, score / nullif(max(score) OVER (PARTITION BY query_id), 0) AS text FROM s),
    qt AS (SELECT q.query_id, d.doc_id AS document_id, 1.0::DOUBLE AS quote FROM fx_query q JOIN documents d ON contains(d.text, q.quote)),
    vs AS (SELECT q.query_id, e.vec_id AS document_id, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM fx_query q JOIN embeddings x ON x.vec_id = q.query_id JOIN embeddings e ON true),
    vn AS (SELECT query_id, document_id, score / nullif(max(score) OVER (PARTITION BY query_id), 0) AS vector FROM vs WHERE score IS NOT NULL),
    u AS (SELECT query_id, document_id, text, NULL AS quote, NULL AS vector FROM tx UNION ALL SELECT query_id, document_id, NULL, quote, NULL FROM qt UNION ALL SELECT query_id, document_id, NULL, NULL, vector FROM vn),
    g AS (SELECT query_id, document_id, coalesce(max(text), 0) AS text, coalesce(max(quote), 0) AS quote, coalesce(max(vector), 0) AS vector FROM u GROUP BY 1, 2),
    c AS (SELECT g.*, CASE WHEN d.document_id IS NOT NULL THEN 1.0 ELSE 0.0 END AS "local", CASE WHEN g.document_id % 7 = g.query_id % 7 THEN 1.0 ELSE 0.0 END AS adjacent, CASE WHEN contains(d.title, split_part(q.text, ' ', 1)) THEN 1.0 ELSE 0.0 END AS exact_term, CASE WHEN p.pool_id IS NOT NULL THEN 1.0 ELSE 0.0 END AS in_pool, CASE WHEN d.doi IS NOT NULL THEN 1.0 ELSE 0.0 END AS authority
          FROM g JOIN fx_query q ON g.query_id = q.query_id LEFT JOIN fx_document d ON d.document_id = g.document_id LEFT JOIN fx_pool p ON p.document_id = g.document_id AND p.pool_id = q.pool_id),
    f AS (SELECT *, round({' + '.join(f'{w} * "{c}"' for c, w in WEIGHTS.items())}, 6) AS score FROM c),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INT) AS rank FROM f)
    SELECT query_id, document_id, {', '.join(f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in WEIGHTS)}, score, rank FROM k WHERE rank <= 10""")
def _(v, spark, sf_dir):
    q, d, docs = v("fx_query").where("query_id is not null"), v("fx_document"), texts(v)
    terms, grams = stored(TextIndex, spark, sf_dir, "terms", lambda: docs), stored(GramIndex, spark, sf_dir, "grams", lambda: docs)
    first = q.select("query_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("quote"))
    asked = lambda left: q.join(left, "query_id", "left_semi")
    vq = v("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)

    def some(rows: DataFrame, depth: int) -> DataFrame:
        """The first rows of a list whose values are all 1."""
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("document_id"))
        return rows.withColumn("nth", rank).where(F.col("nth") <= depth).select("query_id", "document_id", F.lit(1.0).alias("score"))

    def vector_pairs(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(vq.withColumnRenamed("embedding", "a"), "query_id").join(vectors(v).withColumnRenamed("embedding", "b"), "document_id")
        return rows.select("query_id", "document_id", F.round(udfs.cosine_batch("a", "b"), 6).alias("score")).where("score is not null")

    def quote_pairs(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(q.select("query_id", "quote"), "query_id").join(docs, "document_id")
        return rows.where(F.contains("text", "quote")).select("query_id", "document_id", F.lit(1.0).alias("score"))

    def context(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(first.join(q.select("query_id", "pool_id"), "query_id"), "query_id").join(d.select("document_id", "title", "doi"), "document_id", "left")
        rows = rows.join(v("fx_pool").withColumn("pooled", F.lit(True)), ["document_id", "pool_id"], "left")
        return rows.select("query_id", "document_id", flag(F.col("title").isNotNull()).alias("local"), flag(F.col("document_id") % 7 == F.col("query_id") % 7).alias("adjacent"), flag(F.contains("title", "quote")).alias("exact_term"), flag(F.col("pooled")).alias("in_pool"), flag(F.col("doi").isNotNull()).alias("authority"))

    lists = {
        "text": lambda left, depth: terms.search(asked(left), depth),
        "quote": lambda left, depth: some(grams.find(asked(left), docs), depth),
        "vector": lambda left, depth: search.vector_search(vectors(v), vq.join(left, "query_id", "left_semi"), depth),
        "in_pool": lambda left, depth: some(asked(left).select("query_id", "pool_id").join(v("fx_pool"), "pool_id"), depth),
    }
    of_pairs = {"text": lambda pairs: terms.scores(q, pairs), "quote": quote_pairs, "vector": vector_pairs}
    return search.hybrid_search(q, lists, of_pairs, context, WEIGHTS, depth=1024)


@query("filter_commands", "SELECT id, label, search_text FROM (SELECT id, label, concat(label, ' ', keyword1, ' ', keyword2) AS search_text FROM fx_item) WHERE contains(lower(search_text), 'brand#1') AND contains(lower(search_text), 'e')")
def _(v, spark, sf_dir):
    return search.filter_commands(items(v), "  Brand#1 E ").select("id", "label", "search_text")


@query("recommend_papers", f"""
    WITH k AS (SELECT * FROM fx_uses), o AS (SELECT about, count(*) AS n FROM ({OPEN}) GROUP BY 1),
    rd AS (SELECT DISTINCT source AS paper FROM fx_uses WHERE CAST(substr(source, 7) AS BIGINT) % 20 = 0),
    p AS (SELECT a.source AS paper, b.source AS related, count(*) AS n_shared, string_agg(a.target, ',' ORDER BY a.target) AS why, CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS n_questions
          FROM k a JOIN k b ON a.target = b.target LEFT JOIN o ON o.about = a.target WHERE a.source IN (SELECT paper FROM rd) AND b.source NOT IN (SELECT paper FROM rd) GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY paper ORDER BY n_shared DESC, related) AS INT) AS rank FROM p) SELECT paper, related, n_shared, why, n_questions, rank FROM r WHERE rank <= 5""")
def _(v, spark, sf_dir):
    uses = v("fx_uses")
    read = uses.select(F.col("source").alias("paper")).distinct().where(F.substring("paper", 7, 20).cast("long") % 20 == 0)
    return graph.recommend_papers(uses, v("fx_question"), v("fx_answer_edge"), read)


# Set operations


@query("neighbors", "SELECT source AS id, target AS neighbor, 'out' AS direction, kind FROM fx_effect_edge UNION SELECT target, source, 'in', kind FROM fx_effect_edge")
def _(v, spark, sf_dir):
    return graph.neighbors(v("fx_effect_edge"))


@query("notebook", "SELECT note_id, document_id, type, folder, author_kind FROM fx_note")
def _(v, spark, sf_dir):
    n = v("fx_note").select("note_id", "document_id", "type", "folder", "author_kind")
    return library.notebook(n.where("author_kind = 'user'").drop("author_kind"), n.where("author_kind = 'ai'").drop("author_kind"))


@query("graph_diff", "WITH o AS (SELECT source, kind, target FROM fx_uses WHERE CAST(substr(source, 7) AS BIGINT) % 3 <> 0), n AS (SELECT source, kind, target FROM fx_uses WHERE CAST(substr(source, 7) AS BIGINT) % 3 <> 1) SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL SELECT *, 'kept' FROM (SELECT * FROM n INTERSECT SELECT * FROM o)")
def _(v, spark, sf_dir):
    number = F.substring("source", 7, 20).cast("long")
    return graph.graph_diff(v("fx_uses").where(number % 3 != 0), v("fx_uses").where(number % 3 != 1))


# Streaming, run over all that is there


def reading_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.expr("CASE event_type WHEN 'click' THEN 'bar(g)' WHEN 'view' THEN 'kg/h' WHEN 'error' THEN '°C' WHEN 'signup' THEN 'wt%' ELSE CASE WHEN event_id % 2 = 0 THEN 't/h' ELSE 'kg/h' END END")
    return jobs.read_stream(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), "ts", "value", unit.alias("unit"), "event_id")


def without_zone(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


WINDOWED = "SELECT tag, unit, round(avg(value), 6) AS mean, min(value) AS lowest, max(value) AS highest, count(*) AS n, {} AS start_ts FROM {} GROUP BY ALL"


@query("stream_tag_windows", WINDOWED.format("CAST(date_trunc('hour', ts) AS TIMESTAMP)", "fx_reading"))
def _(v, spark, sf_dir):
    return without_zone(jobs.run_closed(jobs.stream_tag_windows, reading_stream(spark, sf_dir), scratch(spark, "tagwindows")))


@query("stream_tag_trend", WINDOWED.format("time_bucket(INTERVAL '15' MINUTE, ts) - k * INTERVAL '15' MINUTE", "fx_reading, (VALUES (0), (1), (2), (3)) AS s(k)"))
def _(v, spark, sf_dir):
    return without_zone(jobs.run_closed(jobs.stream_tag_trend, reading_stream(spark, sf_dir), scratch(spark, "tagtrend")))


@query("stream_reading_sessions", SESSIONS + " FROM s GROUP BY user_id, s")
def _(v, spark, sf_dir):
    return without_zone(jobs.run_closed(jobs.stream_reading_sessions, jobs.read_stream(spark, sf_dir, "events").select("user_id", "ts"), scratch(spark, "sessions")))


@query("stream_alarm_transitions", TRANSITIONS.replace("state AS to_state, round((epoch_us(ts) - epoch_us(since)) / 1e6, 3) AS seconds_before, event_id", "state AS to_state, event_id"))
def _(v, spark, sf_dir):
    rows = process.classify_readings(reading_stream(spark, sf_dir), v("fx_limit")).select("tag", "ts", "state", "event_id")
    return without_zone(jobs.run_closed(jobs.stream_alarm_transitions, rows, scratch(spark, "transitions")))


@query("stream_annotation_state", "SELECT * FROM (SELECT annotation_id, document_id, page_index, tool, ts, event_id FROM fx_annotation_log QUALIFY row_number() OVER (PARTITION BY annotation_id ORDER BY ts DESC, event_id DESC) = 1) WHERE tool <> 'erase'")
def _(v, spark, sf_dir):
    tool = F.expr("CASE event_type WHEN 'signup' THEN 'highlight' WHEN 'click' THEN 'note' WHEN 'view' THEN 'underline' WHEN 'purchase' THEN 'draw' ELSE 'erase' END")
    e = jobs.read_stream(spark, sf_dir, "events")
    log = e.select((F.col("user_id") * 10 + F.col("event_id") % 7).alias("annotation_id"), F.col("user_id").alias("document_id"), (F.col("event_id") % 7).cast("int").alias("page_index"), tool.alias("tool"), "ts", "event_id")
    path = scratch(spark, "annotations")
    q = jobs.stream_annotation_state(log, f"{path}/table", f"{path}/checkpoint")
    q.awaitTermination()
    return without_zone(jobs.live_annotations(spark, f"{path}/table"))


@query("late_rows", """SELECT count(*) AS n_rows, count(*) FILTER (event_id % 2 = 1 AND ts <= (SELECT date_trunc('millisecond', max(ts)) FROM events WHERE event_id % 4 = 0) - INTERVAL '10' MINUTE) AS n_late FROM events""")
def _(v, spark, sf_dir):
    path, rows = scratch(spark, "late"), v("events")
    for part in ("event_id % 4 = 0", "event_id % 4 = 2", "event_id % 2 = 1"):  # a batch each; late is what lies behind the watermark of the batch before the last
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    stream = jobs.read_stream(spark, path, "events", max_files=1).withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])
    n = jobs.late_rows(spark, lambda: jobs.run_to_table(stream.select("event_id"), f"{path}/table", f"{path}/checkpoint"))
    return rows.agg(F.count("*").alias("n_rows"), F.lit(n).cast("long").alias("n_late"))
