"""The pipeline's stages on their own, and together against brute force."""

from __future__ import annotations

import corpus_pipeline as pipeline
from fleetlens.llm import rules
from fleetlens.llm.common import land

from .test_operators import SF_DIR, VOCAB, brute_lines, brute_near


def test_stages_keep_columns_and_odd_rows(spark, make, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        now = docs
        for name, stage in pipeline.STAGES[:-1]:
            out = land(stage(spark, docs, SF_DIR), "test-stage")
            assert out.columns == docs.columns, name
            now = land(stage(spark, now, SF_DIR), "test-stage")
        assert pipeline.STAGES[-1][1](spark, now, SF_DIR).count() == now.count()


def test_repeated_rows_leave_one(spark, make):
    rows = [(1, "a b c d e f g", "en", "s", 13)] * 3 + [(2, "a b c d e f g", "en", "s", 13), (3, "other words", "en", "s", 11)]
    docs = make(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(row.doc_id for row in pipeline.near_duplicates(spark, docs, SF_DIR).collect()) == [1, 3]


def test_texts_under_one_id_are_judged_each_by_itself(spark, make):
    """A clean text beside a leaked one, a unique one beside a copy."""
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "s", 1), (2, words, "en", "s", 1), (2, "quite another text of the same id", "en", "s", 1),
            (3, f"so it goes and then we asked {item} and so on", "en", "s", 1), (3, "nothing of the kind", "en", "s", 1)]
    docs = make(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, SF_DIR).collect())
    assert left == sorted((i, t) for i, t, *_ in rows if (i, t) != (2, words))
    clean = sorted((r.doc_id, r.text) for r in pipeline.decontaminated(spark, docs, SF_DIR).collect())
    assert clean == sorted((i, t) for i, t, *_ in rows if item not in t)


def test_run(spark, make):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {row.doc_id: row.text for row in docs.collect()}
    kept = {row.doc_id for row in rules.quality_rules(docs).filter("kept").collect()}
    texts = {i: t for i, t in texts.items() if i in kept}
    lost = brute_lines(texts)
    left = {}
    for i, text in texts.items():
        own = [line for at, line in enumerate(text.split("\n")) if at not in lost.get(i, [])]
        if own:
            left[i] = "\n".join(own)
    left = {i: t for i, t in left.items() if brute_near(left)[i][0] == i} if len(left) < 30 else _first_of_groups(left)
    items = [row.text for row in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    found = {row.doc_id: row.n_tokens for row in pipeline.run(spark, SF_DIR).collect()}
    clean = {i: t for i, t in left.items() if not any(item in t for item in items)}
    assert set(found) <= set(clean) and len(found) >= len(clean) - 3
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(VOCAB)
    assert all(len(tokenizer.encode(clean[i], add_special_tokens=False).ids) == n for i, n in found.items())


def _first_of_groups(texts):
    roots = brute_near(texts)
    return {i: t for i, t in texts.items() if roots[i][0] == i}
