"""Answered rows: layers without shuffles, absent layers, stale answers, judges, evidence in the text."""

from __future__ import annotations

import re
import zlib

import pytest

from lakequill.operators.qa import RAG_CRITERIA
from lakequill.plans import rag_rows

TEXT = "# Castle\n\nA castle stands **here**. It is old.\n\n| built | 1200 |\n| height | 30 m |\n" + "More text. " * 300
GOOD = dict.fromkeys(RAG_CRITERIA, True)


def answer(j, question="Where is the castle?", evidence=("castle stands here",)):
    return ("corpus", j, question, "a", "fact", list(evidence), "sl", "qx", "ax")


@pytest.fixture(scope="module")
def rows(spark):
    pages = [(p, f"Q{p}", "u", "Castle (hill)", "en", "SI", ["c"], False, 3, 46.0, 14.0, TEXT if p == "p1" else "short") for p in ("p1", "p2", "p3", "p4")]
    answers = [("p1", [answer(0), answer(1, "Stale?"), answer(2, "How high?", ["height | 30", "nowhere"])]), ("p2", [answer(0)]), ("p3", [answer(0)])]
    sources = [("p1", [("corpus", 0, "Where is the castle?", {"verdict": "keep"}), ("corpus", 1, "Repaired?", {}), ("corpus", 2, "How high?", {})]), ("p2", [("corpus", 0, "Where is the castle?", None), ("challenge", 0, "x", None)])]
    full = [tuple(GOOD.values())] * 3
    bad = [tuple((GOOD | {"grounded": False}).values()), full[0], tuple((GOOD | {"x_ok": False}).values())]
    key = f"{zlib.crc32(b'How high?'):08x}"
    pool = [("p1", "yes", True, None), ("p9", "no", False, 7), ("p8", "no", False, 2), ("p7", "no", False, None), ("p6", "yes", True, 1), ("p5", "partly", False, 3)]
    layers = {"pages": pages, "answers": answers, "sources": sources, "judge_a": [("p1", full), ("p2", full)], "judge_b": [("p1", bad)], "ranks": [("p1", {"2|x": (1, 0.5, 3)})], "lexical": [("p1", {0: 0.25})], "qrels": [("p1", {key: pool})]}
    frames = {n: spark.createDataFrame(v, f"page_id string, {rag_rows.LAYERS[n]}") for n, v in layers.items()}
    rag_rows.save_layers(frames, "castle_layers", 4)
    return {(r.page_id, r.n): r for r in rag_rows.answered_rows(spark, "castle_layers").collect()}


def test_current_answers_only(rows):
    assert set(rows) == {("p1", 0), ("p1", 2), ("p2", 0)}  # one is stale, p3 has no source, p4 no answer


def test_judgement(rows):
    first, third, other = rows["p1", 0], rows["p1", 2], rows["p2", 0]
    assert (first.judges, first.criteria.grounded, first.answer_ok, first.x_ok) == (2, False, False, True)
    assert (third.judges, third.answer_ok, third.x_ok) == (2, True, False)  # the translation doesn't count for the answer
    assert (other.judges, other.criteria, other.answer_ok, other.x_ok) == (0, None, None, None)  # three labels for one answer


def test_evidence(rows):
    first, third = rows["p1", 0], rows["p1", 2]
    (a, b), = first.spans
    assert TEXT[a:b] == "castle stands **here" and first.verbatim and not first.evidence_in_table and first.evidence_pos == round(a / len(TEXT), 3)
    assert not third.verbatim and third.evidence_in_table and len(third.spans) == 1
    assert rows["p2", 0].spans == [] and rows["p2", 0].evidence_pos is None


def test_layers_and_pool(rows):
    third, other = rows["p1", 2], rows["p2", 0]
    assert third.rank_o is None and third.rank_x.bm25 == 3 and rows["p1", 0].lex_overlap == 0.25 and rows["p1", 0].title_in_question and other.stub and not third.stub
    assert (third.qrels_judged, third.gold_match, third.gold_answers, third.relevant, third.partial, third.answering, third.hard_negatives, third.n_relevant, third.hits) == (True, "yes", True, ["p6"], ["p5"], ["p1", "p6"], ["p8", "p9"], 2, "few")
    assert other.qrels_judged is False and other.relevant is None and other.variants is None and other.page_tags is None
    assert len(other) >= 48


def test_layers_meet_without_a_shuffle(spark, rows):
    plan = rag_rows.joined_layers(spark, "castle_layers")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == len(rag_rows.LAYERS) - 1 and "Exchange" not in plan
    assert len(re.findall(r"Bucketed: true", plan)) == len(rag_rows.LAYERS)
