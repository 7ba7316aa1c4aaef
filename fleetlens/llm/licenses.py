"""License scan: an exact set-similarity join of text blocks with license templates.

Words are ordered by their frequency over the whole corpus, rarest first. A
block that holds at least a share ``t`` of a template's distinct words must
hold one of its first ``n - ceil(t * n) + 1`` words in that order (the prefix).
So only places of prefix words become rows. Such a place and the template's
layout say which block of words to look at (position); blocks too short to hold
enough words fall out (length); the rest are verified on all their words.
Phrases are templates with ``t`` = 1 whose words must also stand consecutively.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import land, pieces, texts


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrase: bool  # its words must stand consecutively


def _phrase(label: str, text: str) -> Template:
    return Template(label, tuple(text.split()), True)


def _text(label: str, text: str) -> Template:
    return Template(label, tuple(text.split()), False)


# Phrases of the contract, then the opening sentences of well-known public licences.
PHRASES = [
    _phrase("cc-by", "cc by"),
    _phrase("gpl", "general public license"),
    _phrase("reserved", "all rights reserved"),
]
TEMPLATES = [
    _text("apache", "licensed under the apache license version 2 0"),
    _text("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
                 "the following conditions are met"),
    _text("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    _text("gpl", "this work is licensed under the gnu general public license version 3"),
    _text("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                 "public license as published by the free software foundation"),
    _text("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                 "documentation files to deal in the software without restriction"),
    _text("mit", "released under the mit license"),
    _text("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

# Words are ASCII letters and digits and everything beyond ASCII; only A-Z is lowered. Works on UTF-8 bytes.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
CHUNK_BYTES = 8 << 20
# Words beyond a template's own length that its block may be longer on either side.
SLACK = 0.5


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


def _vocabulary(templates: list[Template]) -> dict[bytes, int]:
    return {word.encode(): i for i, word in enumerate(sorted({w for t in templates for w in t.words}))}


def word_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> list[int]:
    """How often each template word occurs in all texts; as many numbers as template words reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK_BYTES):
            counts: Counter[int] = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(filter(None.__ne__, map(vocabulary.get, words_of(text))))
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})
    rows = texts(docs).select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {row.word: row.n for row in rows}
    return [found.get(i, 0) for i in range(len(vocabulary))]


def prefixes(templates: list[Template], frequencies: list[int], vocabulary: dict[bytes, int], threshold: float) -> list[tuple]:
    """Rows (word, template, label, phrase, words, need, place, reach): one for each prefix word of a template."""
    rows = []
    for number, template in enumerate(templates):
        ids = [vocabulary[word.encode()] for word in template.words]
        distinct = sorted(set(ids), key=lambda i: (frequencies[i], i))
        need = len(distinct) if template.phrase else math.ceil(threshold * len(distinct) - 1e-9)
        reach = 0 if template.phrase else math.ceil(SLACK * len(ids))
        for word in distinct[:len(distinct) - need + 1]:
            rows.append((word, number, template.label, template.phrase, ids, need, ids.index(word), reach))
    return rows


def license_scan(docs: DataFrame, templates: list[Template] | None = None, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Two tables: documents (row, doc_id, n_words) and blocks (row, template, label, phrase, start, end, containment).

    ``row`` tells repeated rows apart. A block is ``[start, end)`` in words; it
    meets its template's threshold, and for a phrase it is the phrase itself.
    NULL and empty texts have no words and no blocks.
    """
    spark = docs.sparkSession
    templates = templates if templates is not None else PHRASES + TEMPLATES
    vocabulary = _vocabulary(templates)
    listed = prefixes(templates, word_frequencies(docs, vocabulary), vocabulary, threshold)
    watched = {row[0] for row in listed}
    around = max((len(row[4]) + row[7] for row in listed), default=0)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = {word: i for word, i in vocabulary.items() if i in watched}
        for batch in pieces(batches, CHUNK_BYTES):
            counts, found = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                counts.append(len(words))
                if keys.keys().isdisjoint(words):
                    found.append([])
                    continue
                hits = []
                for at, word in enumerate(words):
                    if word in keys:
                        first = max(0, at - around)
                        hits.append({"word": keys[word], "at": at, "first": first,
                                     "near": [vocabulary.get(w, -1) for w in words[first:at + around + 1]]})
                found.append(hits)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(counts, pa.int64()),
                pa.array(found, pa.list_(pa.struct([("word", pa.int32()), ("at", pa.int64()), ("first", pa.int64()), ("near", pa.list_(pa.int32()))])))],
                names=["doc_id", "n_words", "places"])
    schema = "doc_id long, n_words long, places array<struct<word:int,at:bigint,first:bigint,near:array<int>>>"
    # Landed, so that the row numbers given next stay the same for every later use.
    scanned = land(land(texts(docs).mapInArrow(places, schema), "license-places")
                   .select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "places"), "license-rows")
    index = spark.createDataFrame(
        listed, "word int, template int, label string, phrase boolean, words array<int>, need int, place int, reach int")
    # The index has one row per prefix word of a template: bounded by the templates given.
    found = scanned.select("row", "n_words", F.inline("places")).join(F.broadcast(index), "word")
    start = F.greatest(F.lit(0), F.col("at") - F.col("place") - F.col("reach"))
    end = F.least("n_words", F.col("at") - F.col("place") + F.size("words") + F.col("reach"))
    # Length: a block must have room for the words it needs. A phrase must have room for all of it.
    sized = found.withColumn("start", start).withColumn("end", end).filter(
        (F.col("end") - F.col("start") >= F.when(F.col("phrase"), F.size("words")).otherwise(F.col("need")))
        & (~F.col("phrase") | (F.col("at") >= F.col("place"))))
    block = F.slice("near", (F.col("start") - F.col("first") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    shared = F.size(F.array_intersect("block", "words"))
    blocks = (sized.withColumn("block", block)
              .filter((shared >= F.col("need")) & (~F.col("phrase") | (F.col("block") == F.col("words"))))
              .select("row", "template", "label", "phrase", "start", "end",
                      (shared / F.size(F.array_distinct("words"))).alias("containment")))
    return scanned.select("row", "doc_id", "n_words"), blocks
