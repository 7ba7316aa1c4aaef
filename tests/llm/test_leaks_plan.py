"""Each passage is computed once, and each document's tokens are cut once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from fleetlens.llm import leaks


def paired(make, rows):
    docs = make([(i, words) for i, (words, *_) in enumerate(rows)], "doc_id long, words string")
    own = make([(i, 7, len(item.split()), item, distance) for i, (_, item, distance) in enumerate(rows)],
               "doc_id long, item_id long, item_tokens long, own string, distance int")
    return docs.join(own, "doc_id")


def test_runs_are_computed_once(make):
    runs = leaks._longest_run(paired(make, [("a b", "a b", 0)]), 13).filter(F.col("n_tokens") >= F.least(F.lit(13), F.col("item_tokens")))
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"aggregate\(", plan)) == 1
    # The document's tokens (``words``) stand outside of any lambda.
    assert plan.count("split(words") == 1 and "lambdafunction" not in plan[plan.rindex("transform(", 0, plan.index("split(words")):plan.index("split(words")]


def test_items_that_stand_over_an_end_of_the_text(make):
    rows = [("c d e x", "a b c d e", -2), ("x a b", "a b c d e", 1), ("x", "a b", -5), ("x", "a b", 5), ("a b c", "a b c", 0)]
    found = leaks._longest_run(paired(make, rows), 13).select("doc_id", "n_tokens").collect()
    assert sorted((row.doc_id, row.n_tokens) for row in found) == [(0, 3), (1, 2), (2, 0), (3, 0), (4, 3)]
