"""Language mixtures: which languages a text is written in, and in what shares.

Each language is a distribution over hashed character trigrams, learned from
labelled texts. A document is a mixture: every word comes from one language.
Expectation-maximisation estimates the shares from the words' likelihoods; the
set of languages is the one with the best likelihood after a penalty of half
the log of the number of words for each language. Tasks run the steps for all
documents of a chunk at once, on matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import pieces, texts

BINS = 1 << 16
CHUNK_BYTES = 2 << 20
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # languages x BINS


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and its lower-case form."""
    points = range(0x110000)
    known = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in points), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(known).tolist():
        small = chr(c).lower()
        if len(small) == 1:
            lower[c] = ord(small)
    return known, lower


def _trigrams(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigram around every letter, first trigram of every word, text number of every word."""
    known, lower = _letters()
    lengths = np.array([len(v) + 1 for v in values], np.int64)
    points = np.frombuffer("\n".join([*values, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = known[points]
    points = np.where(letter, lower[points], 0).astype(np.uint64)
    padded = np.concatenate([[0], points, [0]]).astype(np.uint64)
    mixed = (padded[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ padded[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
             ^ padded[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    grams = (mixed >> np.uint64(48)).astype(np.int64)
    begins = letter & ~np.concatenate([[False], letter[:-1]])
    at = np.flatnonzero(letter)
    starts = np.searchsorted(at, np.flatnonzero(begins))
    text_of = np.searchsorted(np.cumsum(lengths), np.flatnonzero(begins), side="right")
    return grams[at], starts, text_of


def learn(docs: DataFrame, sample: int = 4000, smoothing: float = 0.5, use: Column | None = None) -> Model:
    """Fit trigram distributions on about ``sample`` documents a language, picked by a hash of the text.

    ``docs`` has text and lang; rows without a language are left out, and
    ``use`` may hold a further condition. One pass counts documents a language,
    one reads the texts picked. What reaches the driver is bounded by the
    number of languages times the number of bins.
    """
    known = docs.filter(F.col("lang").isNotNull() & (use if use is not None else F.lit(True))).select(
        F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    totals = {row.lang: row.n for row in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Model([], np.zeros((0, BINS)))
    shares = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    picked = known.filter(draw < shares[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK_BYTES):
            langs = np.array(batch.column("lang").to_pylist(), object)
            grams, starts, text_of = _trigrams(batch.column("text").to_pylist())
            owner = np.repeat(text_of, np.diff(np.append(starts, len(grams))))
            for lang in dict.fromkeys(langs.tolist()):
                bins, n = np.unique(grams[(langs == lang)[owner]], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(bins), pa.string()), "bin": pa.array(bins, pa.int32()), "n": pa.array(n, pa.int64())})
    rows = picked.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(totals)
    counts = np.full((len(languages), BINS), smoothing)
    numbers = {lang: i for i, lang in enumerate(languages)}
    if len(rows):
        np.add.at(counts, (rows.lang.map(numbers).to_numpy(), rows.bin.to_numpy()), rows.n.to_numpy())
    return Model(languages, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def _shares(p: np.ndarray, base: np.ndarray, first: np.ndarray, owner: np.ndarray, n: np.ndarray,
            allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for all texts at once; shares and log-likelihood of each text."""
    shares = allowed / allowed.sum(1, keepdims=True)
    for _ in range(steps):
        weight = p * shares[owner]
        total = weight.sum(1, keepdims=True)
        shares = np.add.reduceat(weight / total, first, axis=0) / n[:, None]
    total = (p * shares[owner]).sum(1)
    return shares, np.add.reduceat(np.log(np.maximum(total, 1e-300)) + base, first)


def mixtures(values: list[str], model: Model, steps: int = 12, least: float = 0.02) -> list[list[tuple[str, float]]]:
    """Languages and shares of each text, largest share first; none for a text without a letter."""
    out: list[list[tuple[str, float]]] = [[] for _ in values]
    grams, starts, text_of = _trigrams(values)
    if not len(starts) or not model.languages:
        return out
    logs = np.add.reduceat(model.logp[:, grams].astype(np.float64), starts, axis=1).T
    base = logs.max(1)
    p = np.maximum(np.exp(logs - base[:, None]), 1e-30)
    first = np.flatnonzero(np.concatenate([[True], text_of[1:] != text_of[:-1]]))
    rows = text_of[first]
    n = np.diff(np.append(first, len(text_of))).astype(float)
    owner = np.repeat(np.arange(len(rows)), n.astype(int))
    everything = np.ones((len(rows), len(model.languages)))
    full, _ = _shares(p, base, first, owner, n, everything, steps)
    rank = (-full).argsort(1, kind="stable").argsort(1, kind="stable")
    best = np.full(len(rows), -np.inf)
    chosen = np.zeros_like(full)
    for size in range(1, len(model.languages) + 1):
        # Only texts where the next language has a share worth a try.
        tried = np.flatnonzero(((full >= least).sum(1) >= size) | (size == 1))
        if not len(tried):
            break
        mask = np.zeros(len(rows), bool)
        mask[tried] = True
        words = mask[owner]
        count = n[tried].astype(int)
        some, likelihood = _shares(p[words], base[words], np.cumsum(count) - count, np.repeat(np.arange(len(tried)), count),
                                   n[tried], (rank[tried] < size).astype(float), steps if size > 1 else 1)
        value = likelihood - 0.5 * size * np.log(np.maximum(n[tried], 2))
        better = value > best[tried]
        best[tried[better]] = value[better]
        chosen[tried[better]] = some[better]
    for row, shares in zip(rows.tolist(), chosen, strict=True):
        order = [i for i in (-shares).argsort(kind="stable").tolist() if shares[i] > 0]
        out[row] = [(model.languages[i], float(shares[i])) for i in order]
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, lang_pred, score, languages, shares): the main language and its share, then all of the set.

    ``und`` with score 0 where the text is NULL, has no letter, or nothing was
    learned. Ties go to the language first in the alphabet. Repeated rows give
    repeated rows; a NULL doc_id stays NULL.
    """
    limit = max(1, CHUNK_BYTES * 8 // max(8, len(model.languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit):
            found = mixtures(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([m[0][0] if m else UNKNOWN for m in found]),
                pa.array([min(1.0, m[0][1]) if m else 0.0 for m in found], pa.float64()),
                pa.array([[lang for lang, _ in m] for m in found], pa.list_(pa.string())),
                pa.array([[share for _, share in m] for m in found], pa.list_(pa.float64()))],
                names=["doc_id", "lang_pred", "score", "languages", "shares"])
    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")
