"""Quality score by compression: which of two dictionaries does a text shrink better with?

One zstandard dictionary is trained on text labelled good, one on text labelled
bad. A text is cut into pieces short enough for the dictionary to matter, and
each piece is compressed with both. The difference of the summed sizes, divided
by their sum, is the evidence; a logistic curve fitted on other labelled texts
turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import pieces, texts

PIECE_BYTES = 1024
CHUNK_BYTES = 4 << 20
LEVEL = 3
DICTIONARY_BYTES = 110 << 10


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_content_size=False, write_dict_id=False)


def _cut(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[i:i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]


def difference(text: str, model: Model) -> float:
    """Normalised difference of compressed sizes, from -1 (bad) to 1 (good); 0 for an empty text."""
    good, bad = _compressor(model.good), _compressor(model.bad)
    a = b = 0
    for piece in _cut(text):
        a += len(good.compress(piece))
        b += len(bad.compress(piece))
    return (b - a) / (a + b) if a + b else 0.0


def _dictionary(samples: list[bytes]) -> bytes:
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge."""
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 1e-3 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _differences(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    columns = ["doc_id", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK_BYTES):
            found = [difference(text, model) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(found, pa.float64())], names=[*columns, "difference"])
    return texts(docs, *more).mapInArrow(run, ", ".join(["doc_id long", *[f"{c} int" for c in more], "difference double"]))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 4000, samples: int = 4000) -> Model:
    """Fit on at most ``sample`` labelled documents of each class, picked by a hash of their id.

    Half of them give the dictionaries, from at most ``samples`` pieces of
    ``PIECE_BYTES`` a class; the other half gives the curve. Labels that are
    NULL, neither 0 nor 1, or contradict each other are left out. Ids and
    labels picked are bounded by ``sample``, and so is what is broadcast. With
    one class only, the score is the smoothed share of good labels.
    """
    clean = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
             .agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other"))
    draw = F.xxhash64("doc_id", F.lit("quality"))
    picked = [clean.filter(F.col("quality") == q).select("doc_id", "quality", draw.alias("draw")).orderBy("draw", "doc_id").limit(sample)
              for q in (0, 1)]
    chosen = picked[0].union(picked[1])
    # Bounded by the parameter: two numbers for each of at most 2 * sample ids.
    chosen = chosen.select("doc_id", "quality", F.pmod("draw", F.lit(2)).cast("int").alias("part"))
    labelled = texts(docs).join(F.broadcast(chosen), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK_BYTES):
            found = [(q, piece) for q, text in zip(batch.column("quality").to_pylist(), batch.column("text").to_pylist(), strict=True) for piece in _cut(text)]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], names=["quality", "piece"])
    parts = labelled.filter("part = 0").select("quality", "text").mapInArrow(cut, "quality int, piece binary").distinct()
    sets = [[bytes(row.piece) for row in parts.filter(F.col("quality") == q).orderBy(F.xxhash64("piece"), "piece").limit(samples).collect()]
            for q in (0, 1)]
    model = Model(_dictionary(sets[1]), _dictionary(sets[0]), 0.0, 0.0)
    rows = _differences(labelled.filter("part = 1"), model, "quality").select("quality", "difference").toPandas()
    counts = [int((rows.quality == q).sum()) for q in (0, 1)]
    if not all(sets) or not all(counts):
        good, bad = (n + len(s) for n, s in zip(counts[::-1], sets[::-1], strict=True))
        return Model(b"", b"", 0.0, float(np.log((good + 1) / (bad + 1))))
    # Classes were drawn evenly; the curve is moved to the shares they have among all labels.
    totals = {row.quality: row.n for row in clean.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    slope, offset = _logistic(rows.difference.to_numpy(), rows.quality.to_numpy().astype(float))
    shift = np.log(totals[1] / totals[0]) - np.log(counts[1] / counts[0])
    return Model(model.good, model.bad, slope, offset + float(shift))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Rows (doc_id, score, predicted, difference); the score is the probability that the label is 1.

    NULL and empty texts have no evidence and get the curve's value at 0.
    Repeated rows give repeated rows; a NULL doc_id stays NULL.
    """
    found = _differences(docs, model)
    probability = 1 / (1 + F.exp(-(F.col("difference") * model.slope + model.offset)))
    return found.select("doc_id", probability.alias("score"), (probability >= threshold).cast("int").alias("predicted"), "difference")
