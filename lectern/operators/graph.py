"""Research graph: edges, nodes, evidence and the signals made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.columns import is_valid
from lectern.schemas import EDGE_CLASSES
from lectern.sources.scratch import put_aside


def edges_with_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with kind, title and strength of both ends; a missing end gives nulls. Where nodes are too many to be sent everywhere, a task holds its nodes and edges stream past them unsorted."""
    end = lambda side: nodes.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("kind", "title", "strength")]).hint("shuffle_hash")
    return edges.join(end("source"), "source", "left").join(end("target"), "target", "left")


def validate_edges(edges: DataFrame, nodes: DataFrame, classes: list[str] = EDGE_CLASSES) -> DataFrame:
    """source, kind, target, reason: one row per fault of an edge."""
    cols = ["source", "kind", "target"]
    ids = nodes.select("id")
    fault = lambda df, why: df.select(*cols, F.lit(why).alias("reason"))
    out = fault(edges.join(ids, edges["source"] == ids["id"], "left_anti"), "missing_source")
    out = out.unionByName(fault(edges.join(ids, edges["target"] == ids["id"], "left_anti"), "missing_target"))
    return out.unionByName(fault(edges.where(~is_valid(F.col("kind"), classes)), "unknown_class"))


def nodes_without_evidence(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    return nodes.join(evidence.select(F.col("source").alias("id")).distinct(), "id", "left_anti")


def nodes_with_evidence(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    return nodes.join(evidence.select(F.col("source").alias("id")).distinct(), "id", "left_semi")


def trace_provenance(evidence: DataFrame, anchors: DataFrame, documents: DataFrame) -> DataFrame:
    """Each evidence with its selection and paper, and a status that names the first broken link."""
    a = anchors.select("anchor_id", "page_index", "quote")
    d = documents.select("document_id", "title", F.lit(True).alias("has_document"))
    rows = evidence.join(a, "anchor_id", "left").join(d, "document_id", "left")
    status = F.when(F.col("anchor_id").isNull(), "no_anchor").when(F.col("quote").isNull(), "missing_anchor").when(F.col("has_document").isNull(), "missing_document").otherwise("ok")
    return rows.select("evidence_id", "document_id", "anchor_id", "page_index", "quote", "title", status.alias("status"))


EDGE, CONTRADICTS, INCREASES, DECREASES = 1, 2, 4, 8


def pair_facts(edges: DataFrame, evidence: DataFrame | None = None, since: str | None = None) -> DataFrame:
    """source, target and what the signals ask of a pair, from one grouping of edges and evidence together: is_edge, is_contradicted, is_opposed (rejected edges ignored), n_evidence, confidence, n_new, is_first.

    What an edge says is a set of bits, so that a pair is few numbers when it is shuffled.
    """
    live = F.coalesce(F.col("status") != "rejected", F.lit(True)) if "status" in edges.columns else F.lit(True)
    kind = F.when(live & (F.col("kind") == "contradicts"), CONTRADICTS).when(live & (F.col("kind") == "increases"), INCREASES).when(live & (F.col("kind") == "decreases"), DECREASES).otherwise(0)
    rows = edges.select("source", "target", (kind + EDGE).alias("says"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    if evidence is not None:
        rows = rows.unionAll(evidence.select("source", "target", F.lit(0), F.col("confidence").cast("double"), F.col("created_at").cast("timestamp_ntz")))
    after = F.lit(since).cast("timestamp_ntz")
    got = rows.groupBy("source", "target").agg(F.bit_or("says").alias("says"), F.count_if(F.col("says") == 0).alias("n_evidence"), F.avg("confidence").alias("confidence"), F.count_if(F.col("created_at") > after).alias("n_new"), (F.min("created_at") > after).alias("is_first"))
    has = lambda bits: F.col("says").bitwiseAND(F.lit(bits)) == bits
    return got.select("source", "target", has(EDGE).alias("is_edge"), has(CONTRADICTS).alias("is_contradicted"), has(INCREASES | DECREASES).alias("is_opposed"), "n_evidence", "confidence", "n_new", "is_first")


def contradictions_of(facts: DataFrame) -> DataFrame:
    reason = F.explode(F.filter(F.array(F.when(F.col("is_contradicted"), F.lit("contradicts")), F.when(F.col("is_opposed"), F.lit("opposite_effects"))), lambda x: x.isNotNull()))
    return facts.where("is_contradicted or is_opposed").select("source", "target", reason.alias("reason"))


def contradictions(edges: DataFrame) -> DataFrame:
    """source, target, reason: edges of class contradicts, and pairs that both increase and decrease; rejected edges are ignored."""
    return contradictions_of(pair_facts(edges))


def new_evidence(evidence: DataFrame, since: str) -> DataFrame:
    """source, target, n_new, is_first: subjects with evidence after ``since``."""
    at = F.lit(since).cast("timestamp_ntz")
    got = evidence.groupBy("source", "target").agg(F.count_if(F.col("created_at") > at).alias("n_new"), (F.min("created_at") > at).alias("is_first"))
    return got.where("n_new > 0")


def open_questions(questions: DataFrame, edges: DataFrame) -> DataFrame:
    """id, about, reason: question nodes (id, about) without a confirmed answered-by edge, or with an unanswered-by edge that is not rejected."""
    live = F.coalesce(F.col("status") != "rejected", F.lit(True))
    answered = F.max((F.col("kind") == "answered-by") & (F.col("status") == "confirmed"))
    marks = edges.where(F.col("kind").isin("answered-by", "unanswered-by")).groupBy(F.col("source").alias("id")).agg(F.coalesce(answered, F.lit(False)).alias("answered"), F.max((F.col("kind") == "unanswered-by") & live).alias("unanswered"))
    rows = questions.select("id", "about").join(marks, "id", "left")
    unanswered = F.coalesce("unanswered", F.lit(False))
    return rows.where(~F.coalesce("answered", F.lit(False)) | unanswered).select("id", "about", F.when(unanswered, "unanswered_by").otherwise("no_answer").alias("reason"))


def rare_first(edges: DataFrame, numbers: bool = False) -> DataFrame:
    """source, items: the targets of each source, those of fewest sources first; with ``numbers`` each target is a number of its own, which takes less room than its name."""
    degree = edges.groupBy("target").agg(F.count("*").alias("degree"))
    if numbers:
        edges = edges.join(put_aside(degree.withColumn("number", F.monotonically_increasing_id()), "targets"), "target")
    else:
        edges = edges.join(degree, "target")
    name = "number" if numbers else "target"
    return edges.groupBy("source").agg(F.transform(F.array_sort(F.collect_set(F.struct("degree", name))), lambda x: x[name]).alias("items"))


def sharing_pairs(left: DataFrame, right: DataFrame, ordered: bool, min_shared: int = 2) -> DataFrame:
    """a, b, common, na, nb: pairs of sources of two ``rare_first`` tables that share ``min_shared`` targets or more, each pair once.

    Two such sources share a target among all but the last ``min_shared`` - 1 of each list, so a target that most sources have, which
    stands last, makes no pairs. A pair is met at its first common target only.
    """
    cut = lambda df, name: df.select(F.col("source").alias(name), F.col("items").alias(f"{name}_items"), F.explode(F.slice("items", 1, F.greatest(F.size("items") - (min_shared - 1), F.lit(0)))).alias("at"))
    rows = cut(left, "a").join(cut(right, "b"), "at")
    rows = rows.where("a < b") if ordered else rows
    rows = rows.withColumn("common", F.array_intersect("a_items", "b_items")).where((F.size("common") >= min_shared) & (F.col("common")[0] == F.col("at")))
    return rows.select("a", "b", "common", F.size("a_items").alias("na"), F.size("b_items").alias("nb"))


def method_overlaps(edges: DataFrame, min_shared: int = 2) -> DataFrame:
    """paper_a, paper_b, shared, jaccard: pairs of papers that share methods, whatever the number of papers of a method."""
    edges = put_aside(edges.select("source", "target"), "uses")  # read for the degrees and for the lists
    sets = put_aside(rare_first(edges, numbers=True), "rare-first")
    shared = F.size("common")
    jaccard = F.round(shared / (F.col("na") + F.col("nb") - shared), 6)
    return sharing_pairs(sets, sets, True, min_shared).select(F.col("a").alias("paper_a"), F.col("b").alias("paper_b"), shared.cast("long").alias("shared"), jaccard.alias("jaccard"))


def weak_of(facts: DataFrame, min_evidence: int, min_conf: float, min_degree: int) -> DataFrame:
    """The weak edges of ``facts``. A degree is asked for only where it is below ``min_degree``; those ends are put aside, so that edges need not be shuffled where they are few."""
    links = facts.where("is_edge").select("source", "target", "n_evidence", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    degree = links.select(F.col("source").alias("id")).unionAll(links.select("target")).where("id is not null").groupBy("id").agg(F.count("*").alias("degree"))
    sparse = put_aside(degree.where(F.col("degree") < min_degree).select("id"), "sparse-ends")
    weak = links.where("source is not null and target is not null").where((F.col("n_evidence") < min_evidence) | (F.col("confidence") < min_conf))
    rows = weak.join(sparse.select(F.col("id").alias("source"), F.lit(True).alias("s")), "source", "left").join(sparse.select(F.col("id").alias("target"), F.lit(True).alias("t")), "target", "left")
    label = F.when(F.col("s") | F.col("t"), "insufficient_data").otherwise("weak")
    return rows.select("source", "target", "n_evidence", F.round("confidence", 6).alias("confidence"), label.alias("label"))


def weak_connections(edges: DataFrame, evidence: DataFrame, min_evidence: int, min_conf: float, min_degree: int) -> DataFrame:
    """source, target, n_evidence, confidence, label: edges with little evidence; a sparse surrounding is insufficient data, never a gap."""
    facts = pair_facts(edges, evidence).where("is_edge").select("source", "target", "is_edge", "n_evidence", "confidence")
    return weak_of(put_aside(facts, "weak-facts"), min_evidence, min_conf, min_degree)  # read three times, grouped once


def evidence_signals(edges: DataFrame, evidence: DataFrame, questions: DataFrame, answers: DataFrame, uses: DataFrame, since: str) -> DataFrame:
    """signal, subject, object, score, detail: the five signals in one schema. Edges and evidence are read and grouped once, for three of them."""
    facts = put_aside(pair_facts(edges, evidence, since), "pair-facts")
    shape = lambda df, s, subject, obj, score, detail: df.select(F.lit(s).alias("signal"), F.col(subject).alias("subject"), F.expr(obj).cast("string").alias("object"), F.expr(score).cast("double").alias("score"), F.expr(detail).cast("string").alias("detail"))
    parts = [
        shape(contradictions_of(facts), "contradiction", "source", "target", "1", "reason"),
        shape(facts.where("n_new > 0"), "new_evidence", "source", "target", "n_new", "if(is_first, 'first', 'more')"),
        shape(open_questions(questions, answers), "open_question", "id", "about", "1", "reason"),
        shape(method_overlaps(uses), "method_overlap", "paper_a", "paper_b", "jaccard", "concat('shared ', shared)"),
        shape(weak_of(facts, 2, 0.6, 2), "weak_connection", "source", "target", "confidence", "label"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def node_degrees(edges: DataFrame) -> DataFrame:
    """id, n_in, n_out, degree, is_hub (of the highest degree)."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("target", F.lit(0), F.lit(1)))
    got = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count("*").alias("degree"))
    top = got.agg(F.max("degree").alias("top"))  # one row
    return got.join(F.broadcast(top)).select("id", "n_in", "n_out", "degree", (F.col("degree") == F.col("top")).alias("is_hub"))


def kind_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by source kind, class and target kind, with a total row per class."""
    rows = edges_with_nodes(edges, nodes)
    sets = rows.groupingSets([[F.col("kind"), F.col("source_kind"), F.col("target_kind")], [F.col("kind")]], F.col("kind"), F.col("source_kind"), F.col("target_kind"))
    return sets.agg(F.count("*").alias("n_edges"), F.grouping("source_kind").cast("int").alias("is_total"))


def latest_edge_status(log: DataFrame) -> DataFrame:
    """source, target, status, on_map: the newest status by (ts, seq), ties by status; only confirmed edges go to the map."""
    got = log.groupBy("source", "target").agg(F.max_by("status", F.struct("ts", "seq", "status")).alias("status"))
    return got.withColumn("on_map", F.col("status") == "confirmed")


def illegal_transitions(log: DataFrame, allowed: DataFrame) -> DataFrame:
    """source, target, from_status, to_status, ts, seq: changes of status that ``allowed`` (from_status, to_status) does not have."""
    w = W.partitionBy("source", "target").orderBy("ts", "seq", "status")
    steps = log.select("source", "target", F.lag("status").over(w).alias("from_status"), F.col("status").alias("to_status"), "ts", "seq")
    steps = steps.where("from_status is not null and from_status <> to_status")
    return steps.join(allowed, ["from_status", "to_status"], "left_anti")


def neighbors(edges: DataFrame) -> DataFrame:
    """id, neighbor, direction, kind of every edge, from both of its ends."""
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("neighbor"), F.lit("out").alias("direction"), "kind")
    return out.union(edges.select("target", "source", F.lit("in"), "kind")).distinct()


def graph_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """source, kind, target, change: edges added, removed and kept between two snapshots, from one grouping of both; an edge that comes n times more in one is n rows, one in both is kept once."""
    cols = ["source", "kind", "target"]
    side = lambda df, o: df.select(*cols, F.lit(o).alias("o"), F.lit(1 - o).alias("n"))
    rows = side(old, 1).unionAll(side(new, 0)).groupBy(*cols).agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    more = F.abs(F.col("n") - F.col("o")).cast("int")
    changes = F.concat(F.array_repeat(F.when(F.col("n") > F.col("o"), "added").otherwise("removed"), more), F.when((F.col("o") > 0) & (F.col("n") > 0), F.array(F.lit("kept"))).otherwise(F.array().cast("array<string>")))
    return rows.select(*cols, F.explode(changes).alias("change"))


def recommend_papers(uses: DataFrame, questions: DataFrame, answers: DataFrame, read: DataFrame, k: int = 5) -> DataFrame:
    """paper, related, n_shared, why, n_questions, rank: for papers read (paper), unread ones that share concepts, and the open questions about those.

    Pairs that share two concepts or more are met as in ``sharing_pairs``. Of those that share one, the first ``k`` by name can count only if fewer than
    ``k`` share more, so the first 2k - 1 unread papers of each concept hold them all; so no concept is left out, however common.
    """
    sets = rare_first(uses)
    papers = read.select(F.col("paper").alias("source")).distinct()
    mine, other = sets.join(papers, "source", "left_semi"), sets.join(papers, "source", "left_anti")
    more = sharing_pairs(mine, other, False).select("a", "b", "common")
    place = F.row_number().over(W.partitionBy("at").orderBy("source"))
    first = other.select("source", "items", F.explode("items").alias("at")).withColumn("place", place).where(F.col("place") <= 2 * k - 1)
    ones = mine.select(F.col("source").alias("a"), F.col("items").alias("a_items"), F.explode("items").alias("at")).join(first, "at")
    ones = ones.select("a", F.col("source").alias("b"), F.array_intersect("a_items", "items").alias("common")).where(F.size("common") == 1)
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc(F.size("common")), "b"))
    best = more.union(ones).withColumn("rank", rank).where(F.col("rank") <= k)
    asked = open_questions(questions, answers).groupBy(F.col("about").alias("at")).agg(F.count("*").alias("asked"))
    counted = best.select("a", "b", "rank", "common", F.explode("common").alias("at")).join(asked, "at", "left")
    got = counted.groupBy(F.col("a").alias("paper"), F.col("b").alias("related"), "rank").agg(F.first("common").alias("common"), F.sum(F.coalesce("asked", F.lit(0))).alias("n_questions"))
    return got.select("paper", "related", F.size("common").cast("long").alias("n_shared"), F.array_join(F.sort_array("common"), ",").alias("why"), "n_questions", "rank")
