"""Language-model scores: a log-bilinear model over frequent words, rare words by their counts.

Texts are cut into chunks of whole documents. A chunk keeps its distinct words
as 64-bit hashes and its tokens as numbers of those, so a word is counted and
looked up once a chunk, not once a token. Counts are summed over all training
documents. The most frequent words, one class for all others, and the end of a
text form the classes of the neural model: two context words predict the next
class through a product of small vectors. It is trained in the tasks, by
noise-contrastive estimation over all training texts, in rounds whose results
are averaged. Scoring computes the class probabilities of all distinct contexts
of a chunk as matrix products, normalised over all classes; a word of the rare
class takes its share of that class by its count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import land, pieces, texts

CHUNK_BYTES = 8 << 20
# The end of a text is a token with this hash.
END = 0
CONTEXT = 2
# Columns at either side of a matrix product that may be summed in another order.
EDGE = 8


@dataclass
class Model:
    top: np.ndarray        # hashes of the classes' words, sorted; class number is the place, the rare class comes last
    inputs: np.ndarray     # (classes + 1) x size; the last row stands before a text begins
    position: np.ndarray   # CONTEXT x size
    outputs: np.ndarray    # classes x size
    bias: np.ndarray       # classes

    @property
    def classes(self) -> int:
        return len(self.top) + 1


class _Numbers(dict):
    """Words to numbers, a new word's given when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def chunks(docs: DataFrame, training: Column) -> DataFrame:
    """Landed rows (chunk, doc_ids, training, lengths, hashes, counts, tokens), one for about ``CHUNK_BYTES`` of text.

    ``lengths`` are in tokens and hold the end; ``counts`` are each word's
    occurrences in the chunk's training texts; ``tokens`` are compressed
    32-bit places in ``hashes``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, CHUNK_BYTES):
            numbers = _Numbers({b"": 0})
            lengths, parts = [], []
            for text in batch.column("text").to_pylist():
                words = text.encode().lower().split()
                lengths.append(len(words) + 1)
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                parts.append(np.zeros(1, np.int32))
            tokens = np.concatenate(parts)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
            hashes[hashes == END] = 1
            hashes[0] = END
            learned = np.array(batch.column("training").to_pylist(), bool)
            counts = np.bincount(tokens[np.repeat(learned, lengths)], minlength=len(numbers))
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([learned.tolist()], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())),
                pa.array([hashes.view(np.int64)], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())),
                pa.array([zstandard.compress(tokens.tobytes(), 1)], pa.binary())],
                names=["chunk", "doc_ids", "training", "lengths", "hashes", "counts", "tokens"])
            number += 1
    schema = ("chunk long, doc_ids array<long>, training array<boolean>, lengths array<int>, hashes array<long>, "
              "counts array<int>, tokens binary")
    return land(texts(docs, training.alias("training")).mapInArrow(run, schema), "lm-chunks")


def word_counts(chunked: DataFrame) -> DataFrame:
    """Landed rows (hash, n): occurrences of every word in all training texts, the end among them."""
    words = chunked.select(F.inline(F.arrays_zip(F.col("hashes").alias("hash"), F.col("counts").alias("n")))).filter("n > 0")
    return land(words.groupBy("hash").agg(F.sum("n").alias("n")), "lm-counts")


def _classes(row: dict, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a chunk, and the class of each of its words."""
    tokens = np.frombuffer(zstandard.decompress(row["tokens"]), np.int32)
    hashes = np.asarray(row["hashes"], np.int64)
    at = np.minimum(np.searchsorted(top, hashes), max(0, len(top) - 1))
    known = top[at] == hashes if len(top) else np.zeros(len(hashes), bool)
    return tokens, np.where(known, at, len(top))


def _contexts(classes: np.ndarray, lengths: np.ndarray, start: int) -> list[np.ndarray]:
    """The class one and two tokens before each token; ``start`` before the text begins."""
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(classes)) - np.repeat(begins, lengths)
    out = []
    for back in range(1, CONTEXT + 1):
        shifted = np.concatenate([np.full(back, start), classes])[:len(classes)]
        out.append(np.where(place < back, start, shifted))
    return out


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict]:
    """One chunk at a time, its arrays as numpy."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {}
            for name in names:
                value = batch.column(name)[i]
                plain = name == "doc_ids" or not isinstance(value, pa.ListScalar) or not value.is_valid
                row[name] = value.as_py() if plain else value.values.to_numpy(zero_copy_only=False)
            yield row


def _add_rows(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add each row of ``values`` to the row of ``total`` it belongs to, in order.

    The same sums as ``np.add.at(total, rows, values)``, which takes a slow path for anything but flat arrays.
    """
    width = total.shape[1]
    np.add.at(total.reshape(-1), (rows[:, None] * width + np.arange(width)).ravel(), values.ravel())


def _noise_gradients(model: Model, query: np.ndarray, drawn: np.ndarray, offset: np.ndarray, room: np.ndarray) -> np.ndarray:
    """-1 / (1 + exp(offset - score)) of each query and drawn word; what a word that was drawn again takes is computed once."""
    # A product rounds its outer columns otherwise, so draws there stand for themselves.
    column = np.arange(len(drawn))
    _, first, place = np.unique(2 * drawn + ((column < EDGE) | (column >= len(drawn) - EDGE)), return_index=True, return_inverse=True)
    words = drawn[first]
    # Laid out anew, as the product with a transposed view takes longer; of all draws, as another width rounds otherwise.
    narrow = (query @ np.ascontiguousarray(model.outputs[drawn].T)).take(first, axis=1)
    narrow += model.bias[words]
    wide = room[:narrow.size].reshape(narrow.shape)
    np.subtract(offset[words], narrow, out=wide)
    np.clip(wide, -30, 30, out=wide)
    np.exp(wide, out=wide)
    wide += 1
    return np.divide(-1, wide, out=wide).astype(np.float32).take(place, axis=1)


def train_part(model: Model, triples: np.ndarray, counts: np.ndarray, noise: np.ndarray, rng: np.random.Generator,
               draws: int = 2, samples: int = 128, batch: int = 1024, rate: float = 0.2) -> None:
    """Noise-contrastive estimation with AdaGrad on (class, class before, one before that).

    ``draws`` examples for every distinct triple are drawn by the triples' counts.
    """
    parts = [model.inputs, model.position, model.outputs, model.bias]
    squares = [np.full_like(part, 0.1) for part in parts]
    order = rng.choice(len(triples), draws * len(triples), p=counts / counts.sum())
    log_noise, shift = np.log(noise), np.log(samples)
    # All draws at once, the same that ``choice`` with ``p`` makes a step.
    upto = noise.cumsum()
    draws_of = (upto / upto[-1]).searchsorted(rng.random((-(-len(order) // batch), samples)), side="right")
    # The scores of the drawn words are made in place: fresh memory for each step takes longer than the arithmetic.
    room = np.empty(batch * samples)
    for at, drawn in zip(range(0, len(order), batch), draws_of, strict=True):
        chosen = order[at:at + batch]
        word = triples[chosen, 0]
        before = [triples[chosen, 1 + k] for k in range(CONTEXT)]
        vectors = [model.inputs[c] for c in before]
        query = sum(v * model.position[k] for k, v in enumerate(vectors))
        true = (query * model.outputs[word]).sum(1) + model.bias[word] - log_noise[word] - shift
        # Gradient of the log-likelihood of telling data from noise.
        up = ((1 - 1 / (1 + np.exp(-np.clip(true, -30, 30))))[:, None]).astype(np.float32)
        down = _noise_gradients(model, query, drawn, log_noise + shift, room)
        to_query = up * model.outputs[word] + down @ model.outputs[drawn]
        gradients = [np.zeros_like(part) for part in parts]
        _add_rows(gradients[2], word, up * query)
        _add_rows(gradients[2], drawn, down.T @ query)
        np.add.at(gradients[3], word, up[:, 0])
        np.add.at(gradients[3], drawn, down.sum(0))
        for k, v in enumerate(vectors):
            _add_rows(gradients[0], before[k], to_query * model.position[k])
            gradients[1][k] = (to_query * v).sum(0)
        for part, square, gradient in zip(parts, squares, gradients, strict=True):
            gradient /= len(chosen) ** 0.5
            square += gradient * gradient
            part += rate * gradient / np.sqrt(square)


def _triples(row: dict, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (class, contexts) of a chunk's training texts and how often each occurs."""
    tokens, of_word = _classes(row, top)
    classes, k = of_word[tokens], len(top) + 2
    before = _contexts(classes, row["lengths"], len(top) + 1)
    code = (classes * k + before[0]) * k + before[1]
    learned = np.repeat(np.asarray(row["training"], bool), row["lengths"])
    code, n = np.unique(code[learned], return_counts=True)
    return np.stack([code // (k * k), code // k % k, code % k], 1), n


def train(chunked: DataFrame, counts: DataFrame, classes: int = 512, size: int = 24, rounds: int = 2, seed: int = 7) -> Model:
    """Train on all training texts: every task passes over its chunks, results are averaged by tokens, ``rounds`` times.

    The driver sees the ``classes`` most frequent words and sums of the
    parameters, whose number does not depend on the corpus.
    """
    frequent = counts.orderBy(F.desc("n"), "hash").limit(classes - 1).collect()
    frequency = {row.hash: row.n for row in frequent}
    top = np.array(sorted(frequency), np.int64)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    weights = np.array([*[frequency[h] for h in top.tolist()], max(1, total - sum(frequency.values()))], float)
    noise = weights / weights.sum()
    rng = np.random.default_rng(seed)
    model = Model(top, rng.normal(0, 0.1, (len(top) + 2, size)).astype(np.float32), np.ones((CONTEXT, size), np.float32) / CONTEXT,
                  rng.normal(0, 0.1, (len(top) + 1, size)).astype(np.float32), np.log(noise).astype(np.float32))
    shapes = [part.shape for part in (model.inputs, model.position, model.outputs, model.bias)]
    for number in range(rounds):
        start = np.concatenate([part.ravel() for part in (model.inputs, model.position, model.outputs, model.bias)])

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = start, number: int = number) -> Iterator[pa.RecordBatch]:
            own = _unpacked(top, start, shapes)
            seen = 0
            for row in _rows(batches, ["chunk", "training", "lengths", "hashes", "tokens"]):
                triples, n = _triples(row, top)
                if len(triples):
                    train_part(own, triples, n.astype(float), noise, np.random.default_rng([seed, number, row["chunk"]]))
                    seen += int(n.sum())
            if seen:
                flat = np.concatenate([part.ravel() for part in (own.inputs, own.position, own.outputs, own.bias)]).astype(float) * seen
                yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(flat) + 1), pa.int32()), "value": np.append(flat, seen)})
        rows = (chunked.select("chunk", "training", "lengths", "hashes", "tokens").mapInArrow(run, "place int, value double")
                .groupBy("place").agg(F.sum("value").alias("value")).toPandas().sort_values("place"))
        if not len(rows):
            break
        values = rows.value.to_numpy()
        model = _unpacked(top, (values[:-1] / values[-1]).astype(np.float32), shapes)
    return model


def _unpacked(top: np.ndarray, flat: np.ndarray, shapes: list[tuple]) -> Model:
    parts, at = [], 0
    for shape in shapes:
        n = int(np.prod(shape))
        # Arrays that came by pickle have a type object of their own, for which ``np.add.at`` takes its slow path.
        parts.append(flat[at:at + n].reshape(shape).astype(np.float32))
        at += n
    return Model(top, *parts)


def class_logs(model: Model, words: np.ndarray, before: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """Natural log-probability of each class after its context, normalised over all classes."""
    k = model.classes + 1
    contexts, of = np.unique(before[0] * k + before[1], return_inverse=True)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(0, len(contexts) + block, block))
    out = np.empty(len(words))
    for number, at in enumerate(range(0, len(contexts), block)):
        part = contexts[at:at + block]
        query = model.inputs[part // k] * model.position[0] + model.inputs[part % k] * model.position[1]
        scores = query @ model.outputs.T + model.bias
        high = scores.max(1, keepdims=True)
        scores -= high + np.log(np.exp(scores - high).sum(1, keepdims=True))
        own = order[bounds[number]:bounds[number + 1]]
        out[own] = scores[of[own] - at, words[own]]
    return out


def score(docs: DataFrame, training: Column, **fit: int) -> DataFrame:
    """Rows (doc_id, training, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``.

    Learns from the rows where ``training`` holds. ``base_score`` sums
    log10((c + 1) / (N + V + 1)) over tokens, ``score`` is the neural model's
    log10 probability. NULL and empty texts hold only their end. Without any
    training text every word is unseen and only the untrained model speaks. A
    NULL doc_id stays NULL; repeated rows give repeated rows.
    """
    chunked = chunks(docs, training)
    counts = word_counts(chunked)
    model = train(chunked, counts, **fit)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = counts.filter(F.col("hash").isin(model.top.tolist())).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rare_total, rare_distinct = total - common[0], distinct - common[1]
    asked = chunked.select("chunk", F.posexplode("hashes").alias("at", "hash"))
    # One row for each word a chunk holds, gathered again by chunk: bounded by the words of a chunk.
    answers = asked.join(counts, "hash").groupBy("chunk").agg(F.collect_list(F.struct("at", "n")).alias("found"))
    joined = chunked.join(answers, "chunk", "left").select(
        "chunk", "doc_ids", "training", "lengths", "hashes", "tokens", "found.at", "found.n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches, ["doc_ids", "training", "lengths", "hashes", "tokens", "at", "n"]):
            tokens, of_word = _classes(row, model.top)
            lengths = row["lengths"]
            first = np.cumsum(lengths) - lengths
            n = np.zeros(len(row["hashes"]), np.int64)
            if row["at"] is not None:
                n[row["at"]] = row["n"]
            base = np.log10((n + 1) / (total + distinct + 1))
            rare = np.where(of_word == len(model.top), np.log10((n + 1) / (rare_total + rare_distinct + 1)), 0.0)
            classes = of_word[tokens]
            logs = class_logs(model, classes, _contexts(classes, lengths, model.classes)) / np.log(10) + rare[tokens]
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array(row["training"], pa.bool_()), pa.array(lengths, pa.int64()),
                pa.array(np.add.reduceat((n > 0)[tokens].astype(np.int64), first), pa.int64()),
                pa.array(np.full(len(lengths), total), pa.int64()), pa.array(np.add.reduceat(base[tokens], first)), pa.array(np.add.reduceat(logs, first))],
                names=["doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return joined.mapInArrow(run, "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
