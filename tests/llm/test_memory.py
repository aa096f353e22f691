"""What Python workers hold beside and after a task: executors have little room beside their heap."""

from __future__ import annotations

import re

from hostmill.llm import bpe_count, shingles, substring_dedup


def test_repeated_passages_are_cut_by_one_worker_a_task(spark):
    words = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, words, 0), (2, f"first {words} last", 0)], "doc_id long, text string, n_chars int")
    kept = substring_dedup.remove(docs)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython", plan)) == 1, plan
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()} == {1: (words, len(words)), 2: ("first last", 10)}


def test_counts_of_units_go_when_other_work_begins():
    count = bpe_count.counter(bpe_count.model_path())
    assert count("some words more") >= 3 and bpe_count._counters
    assert list(shingles.tidy(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert not bpe_count._counters
