"""Library, notebook and chat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.columns import clamp_pct, normal_doi, normal_name, trim_all
from lectern.schemas import CLAIM_BADGES


def filter_documents(documents: DataFrame, journal: list[str] | None = None, year_range: tuple[int, int] | None = None, source: str | None = None, has_doi: bool | None = None) -> DataFrame:
    """Documents that meet every condition given."""
    tests = []
    if journal:
        tests.append(F.col("journal").isin(journal))
    if year_range:
        tests.append(F.col("year").between(*year_range))
    if source:
        tests.append(F.col("source_badge") == source)
    if has_doi is not None:
        tests.append(F.col("doi").isNotNull() if has_doi else F.col("doi").isNull())
    return documents.where(reduce(lambda a, b: a & b, tests)) if tests else documents


def resolve_aliases(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """mention, concept_id: by normalised name; an unmatched one has a null concept."""
    names = aliases.groupBy(normal_name(F.col("alias")).alias("key")).agg(F.min("concept_id").alias("concept_id"))
    return mentions.withColumn("key", normal_name(F.col("mention"))).join(names, "key", "left").select("mention", "concept_id")


def consolidate_metadata(external: DataFrame) -> DataFrame:
    """One row per paper from (provider as its rank, doi, title, journal, year): first non-null field by provider.

    The key is the DOI, else title and year; a row with neither stays alone, under a key from all it has.
    """
    doi = F.nullif(normal_doi(F.col("doi")), F.lit(""))
    title = F.nullif(normal_name(F.col("title")), F.lit(""))
    rest = F.concat(F.lit("row:"), F.coalesce("journal", F.lit("")), F.lit("|"), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("|"), F.col("provider").cast("string"))
    key = F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("title:"), title, F.lit("|"), F.coalesce(F.col("year").cast("string"), F.lit(""))), rest)
    rows = external.select(key.alias("key"), "provider", doi.alias("doi"), "title", "journal", "year")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("provider", c))).getField(c).alias(c)
    providers = F.array_join(F.sort_array(F.collect_set(F.col("provider").cast("string"))), ",")
    return rows.groupBy("key").agg(*[first(c) for c in ("doi", "title", "journal", "year")], providers.alias("providers"))


def link_local_papers(documents: DataFrame, papers: DataFrame) -> DataFrame:
    """document_id, doi, paper_title, status (linked, no_doi, not_found)."""
    docs = documents.select("document_id", F.nullif(normal_doi(F.col("doi")), F.lit("")).alias("doi"))
    known = papers.where("doi is not null").select("doi", F.col("title").alias("paper_title"), F.lit(True).alias("hit"))
    out = docs.where("doi is not null").join(known, "doi", "left").withColumn("status", F.when(F.col("hit"), "linked").otherwise("not_found"))
    none = docs.where("doi is null").select("document_id", "doi", F.lit(None).cast("string").alias("paper_title"), F.lit("no_doi").alias("status"))
    return out.select("document_id", "doi", "paper_title", "status").unionByName(none)


def annotations_per_page(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with their number of annotations; 0 where the badge is hidden."""
    got = annotations.groupBy("document_id", "page_index").agg(F.count("*").alias("n_annotations"))
    return pages.join(got, ["document_id", "page_index"], "left").fillna(0, ["n_annotations"])


def backlinks(links: DataFrame) -> DataFrame:
    """target_note, source_note, n_contexts, text."""
    got = links.groupBy("target_note", "source_note").agg(F.count("*").alias("n_contexts"))
    plural = F.when(F.col("n_contexts") > 1, "s").otherwise("")
    return got.withColumn("text", F.concat(F.lit("Mentions this note in "), F.col("n_contexts"), F.lit(" linked context"), plural))


def folder_counts(notes: DataFrame) -> DataFrame:
    """project, folder, n_notes, level: per folder of a project (0), per project (1), whole vault (3)."""
    return notes.rollup("project", "folder").agg(F.count("*").alias("n_notes"), F.grouping_id().cast("long").alias("level"))


def tag_counts(notes: DataFrame) -> DataFrame:
    """tag, n_notes: distinct notes per tag."""
    return notes.select("note_id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.countDistinct("note_id").alias("n_notes"))


def progress(documents: DataFrame, seen: DataFrame) -> DataFrame:
    """``documents`` with progress from seen (document_id, pages_seen)."""
    pct = clamp_pct(100.0 * F.coalesce("pages_seen", F.lit(0)) / F.col("n_pages"))
    return documents.join(seen, "document_id", "left").withColumn("progress", F.round(pct, 6)).drop("pages_seen")


def paper_cards(documents: DataFrame, activity: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per paper; each child table is added up by document before it is joined."""
    seen = activity.groupBy("document_id").agg(F.countDistinct("page_index").alias("pages_seen"))
    asked = F.count_if((F.col("type") == "Research Question") & ~F.col("resolved"))
    note = notes.groupBy("document_id").agg(F.count("*").alias("n_notes"), asked.alias("n_open_questions"))
    rows = progress(documents, seen).join(note, "document_id", "left").fillna(0, ["n_notes", "n_open_questions"])
    status = F.when(F.col("doi").isNull(), "no_doi").otherwise("has_doi")
    return rows.select("document_id", "title", "journal", "year", "progress", "n_notes", "n_open_questions", status.alias("doi_status"), F.lit("local").alias("badge"))


def pool_summary(pools: DataFrame, documents: DataFrame, activity: DataFrame) -> DataFrame:
    """pool_id, n_papers, n_readers, n_readers_approx, last_activity."""
    member = pools.join(documents.select("document_id"), "document_id", "left_semi")
    papers = member.groupBy("pool_id").agg(F.countDistinct("document_id").alias("n_papers"))
    readers = member.join(activity, "document_id").groupBy("pool_id").agg(F.countDistinct("user_id").alias("n_readers"), F.approx_count_distinct("user_id").alias("n_readers_approx"), F.max("ts").alias("last_activity"))
    return papers.join(readers, "pool_id", "left").fillna(0, ["n_readers", "n_readers_approx"])


def continue_reading(activity: DataFrame, documents: DataFrame, k: int = 3) -> DataFrame:
    """user_id, document_id, rank, progress: the papers a user read last and has not finished."""
    got = activity.groupBy("user_id", "document_id").agg(F.max("ts").alias("last_ts"), F.countDistinct("page_index").alias("pages_seen"))
    got = got.join(documents.select("document_id", "n_pages"), "document_id")
    got = got.withColumn("progress", F.round(clamp_pct(100.0 * F.col("pages_seen") / F.col("n_pages")), 6)).where("progress < 100")
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("last_ts"), "document_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("user_id", "document_id", "rank", "progress", "last_ts")


def reading_sessions(activity: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start_ts, end_ts (of the last event), n_events, n_documents; a session ends after ``gap`` without an event."""
    rows = activity.withColumn("at", F.col("ts").cast("timestamp"))
    got = rows.groupBy("user_id", F.session_window("at", gap).alias("s")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_events"), F.countDistinct("document_id").alias("n_documents"))
    return got.drop("s")


def notebook(user_notes: DataFrame, ai_notes: DataFrame) -> DataFrame:
    """Both kinds of notes in one table; who wrote a note stays a column."""
    return user_notes.withColumn("author_kind", F.lit("user")).unionByName(ai_notes.withColumn("author_kind", F.lit("ai")))


def clean_messages(messages: DataFrame) -> DataFrame:
    """Messages with trimmed content, those left empty dropped."""
    return messages.withColumn("content", trim_all(F.col("content"))).where("content <> ''")


def claim_mix(claims: DataFrame) -> DataFrame:
    """Per answer the claims of each badge, those unlabelled, and whether none is."""
    per = [F.count_if(F.col("badge") == b).alias(f"n_{b}") for b in CLAIM_BADGES]
    none = F.count_if(~F.coalesce(F.col("badge").isin(CLAIM_BADGES), F.lit(False)))
    return claims.groupBy("answer_id").agg(*per, none.alias("n_unlabelled"), (none == 0).alias("is_clean"))


def cited_sources(messages: DataFrame) -> DataFrame:
    """source_id, label, n_answers: distinct answers per source."""
    rows = messages.select("conv_id", "turn", F.explode("sources").alias("s"))
    return rows.groupBy(F.col("s.id").alias("source_id"), F.col("s.label").alias("label")).agg(F.count_distinct("conv_id", "turn").alias("n_answers"))


def uncited_answers(messages: DataFrame) -> DataFrame:
    """conv_id, turn of assistant messages without a source."""
    return messages.where((F.col("role") == "assistant") & (F.coalesce(F.size("sources"), F.lit(0)) <= 0)).select("conv_id", "turn")


def turn_pairs(messages: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: each user message with the next message where that is the assistant's."""
    after = F.lead(F.struct("role", "content")).over(W.partitionBy("conv_id").orderBy("turn"))
    rows = messages.withColumn("next", after).where("role = 'user'")
    return rows.select("conv_id", "turn", F.col("content").alias("question"), F.when(F.col("next.role") == "assistant", F.col("next.content")).alias("answer"))


def group_items(items: DataFrame) -> DataFrame:
    """group_name, first_pos, n_items, id, label: one row per item with its group; groups go by first item, items by id; no group is 'Commands'."""
    rows = items.select(F.coalesce(F.nullif("item_group", F.lit("")), F.lit("Commands")).alias("group_name"), "id", "label")
    groups = rows.groupBy("group_name").agg(F.min("id").alias("first_pos"), F.count("*").alias("n_items"))
    return rows.join(groups, "group_name").select("group_name", "first_pos", "n_items", "id", "label")
