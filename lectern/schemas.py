"""Fixed table schemas and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T


KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType(), "array<float>": T.ArrayType(T.FloatType())}


def struct(spec: str) -> T.StructType:
    """A schema from 'name type' pairs, without a session."""
    return T.StructType([T.StructField(*(f.split()[0], KINDS[f.split()[1]])) for f in spec.split(", ")])


#: Driver tables that ``load_table`` knows, with the columns jobs read.
TABLES: dict[str, T.StructType] = {
    "documents": struct("doc_id long, text string, lang string, source string, n_chars long"),
    "conversations": struct("conv_id long, turn long, role string, text string"),
    "embeddings": struct("vec_id long, embedding array<float>, label int"),
    "benchmark": struct("item_id long, text string"),
    "labels": struct("doc_id long, quality int, toxic int"),
    "pages": struct("page_id long, url string, html string"),
    "events": struct("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
}

READING = struct("tag string, ts timestamp_ntz, value double, unit string, project string")
EXTERNAL_PAPER = struct("doi string, title string, journal string, year int")

# Vocabularies of the described screens and data model.
NODE_KINDS = ["concept", "paper", "method", "equation"]
NODE_CLASSES = ["Feedstock", "Pretreatment", "Method", "Model", "Variable", "Mechanism", "Result", "Limitation", "Question", "Paper", "Dataset"]
EDGE_CLASSES = ["uses", "affects", "increases", "decreases", "validated-by", "contradicts", "extends", "cites", "derived-from", "unanswered-by"]
NOTE_TYPES = ["Grounded Note", "Research Question", "Result", "Method", "Limitation", "Assumption", "Formula", "Figure Note", "Dataset Note"]
CLAIM_BADGES = ["paper", "external", "model", "user"]
ANNOTATION_TOOLS = ["select", "highlight", "underline", "note", "draw", "erase"]
READING_STATES = ["normal", "warn", "alarm"]
PROVIDERS = ["openalex", "crossref", "semanticscholar", "arxiv"]
