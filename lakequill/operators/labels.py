"""Label specifications as data: what a label may be, its class index, and the checks that follow from that."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Spec = Mapping[str, Sequence[str]]
#: The options of a label that is true or false; its class indices are 0 and 1.
BOOL = ("false", "true")

#: Names and options of the labels of a question, in the order of their class indices.
QUESTION: Spec = {
    "duplicate": BOOL,
    "language_ok": BOOL,
    "fluent": BOOL,
    "realistic": BOOL,
    "self_answering": BOOL,
    "unique_place": BOOL,
    "facts_supported": ("yes", "partly", "no"),
    "facts_answer": BOOL,
    "translation_ok": BOOL,
    "query_ok": BOOL,
    "answer_difficulty": ("easy", "medium", "hard"),
    "retrieval_difficulty": ("easy", "medium", "hard"),
    "verdict": ("keep", "fix", "drop"),
}
#: Criteria of a context, a question and an answer.
TRIPLE: Spec = dict.fromkeys(("context_relevant", "answerable", "answer_relevant", "answer_supported", "answer_complete", "language_match", "answer_fluent"), BOOL)
#: Tags of a page and their options.
PAGE: Spec = {
    "article_type": ("descriptive", "registry_stub", "list_or_disambiguation", "other"),
    "information_richness": ("low", "medium", "high"),
    "tourist_appeal": ("low", "medium", "high"),
    "primary_focus": ("description", "history", "visiting", "data", "protection", "other"),
    "visitor_info": BOOL,
    "history": BOOL,
    "nature": BOOL,
    "culture": BOOL,
}


def _value(labels: Column, name: str) -> Column:
    return F.try_element_at(labels, F.lit(name))


def _options(spec: Spec, name: str) -> Column:
    return F.array(*map(F.lit, spec[name]))


def problems(spec: Spec, labels: Column) -> Column:
    """What is wrong with labels, a map of texts: 'missing <name>', '<name>: <value>' for a value that is no option, 'unknown <name>'; in the order of the spec, then of the names."""
    found = [F.when(_value(labels, n).isNull(), F.concat(F.lit("missing "), F.lit(n))).when(~F.array_contains(_options(spec, n), _value(labels, n)), F.concat(F.lit(f"{n}: "), _value(labels, n))) for n in spec]
    others = F.transform(F.array_sort(F.array_except(F.map_keys(labels), F.array(*map(F.lit, spec)))), lambda k: F.concat(F.lit("unknown "), k))
    return F.concat(F.array_compact(F.array(*found)), others)


def class_indices(spec: Spec, labels: Column) -> Column:
    """The place of each label's value among its options, in the order of the spec; null for a label that is missing or no option."""
    return F.array(*(F.nullif(F.array_position(_options(spec, n), _value(labels, n)), F.lit(0)) - 1 for n in spec)).cast("array<int>")


def labels_of(spec: Spec, indices: Column) -> Column:
    """The inverse of class_indices, without the labels that are null or out of range."""
    pairs = [F.struct(F.lit(n).alias("key"), F.get(_options(spec, n), F.when(F.get(indices, F.lit(i)) >= 0, F.get(indices, F.lit(i)))).alias("value")) for i, n in enumerate(spec)]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
