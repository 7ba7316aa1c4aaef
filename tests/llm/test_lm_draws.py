"""Noise-contrastive steps: drawn words are scored as one by one, and drawn as numpy's ``choice`` draws them."""

from __future__ import annotations

import numpy as np

from fleetlens.llm import lm


def model_of(rng, classes=40, size=6):
    return lm.Model(np.arange(classes - 1), rng.normal(size=(classes + 1, size)).astype(np.float32), np.ones((lm.CONTEXT, size), np.float32) / 2,
                    rng.normal(size=(classes, size)).astype(np.float32), rng.normal(size=classes).astype(np.float32))


def test_a_word_drawn_again_is_scored_once():
    rng = np.random.default_rng(5)
    model, query = model_of(rng), rng.normal(size=(50, 6)).astype(np.float32)
    drawn, offset = rng.integers(0, 9, 64), rng.normal(size=40)
    found = lm._noise_gradients(model, query, drawn, offset, np.empty(50 * 64))
    scores = (query @ model.outputs[drawn].T + model.bias[drawn]).astype(float)
    assert np.allclose(found, -1 / (1 + np.exp(offset[drawn] - scores)), rtol=1e-5) and found.dtype == np.float32


def test_draws_are_those_of_choice():
    rng = np.random.default_rng(5)
    noise = rng.random(40)
    noise /= noise.sum()
    triples, counts = rng.integers(0, 40, (300, 3)), rng.integers(1, 9, 300).astype(float)
    seen = []

    def watch(model, query, drawn, offset, room, own=lm._noise_gradients):
        seen.append(drawn.copy())
        return own(model, query, drawn, offset, room)
    lm._noise_gradients, kept = watch, lm._noise_gradients
    try:
        lm.train_part(model_of(rng), triples, counts, noise, np.random.default_rng(3), samples=16, batch=128)
    finally:
        lm._noise_gradients = kept
    same = np.random.default_rng(3)
    same.choice(300, 600, p=counts / counts.sum())
    assert len(seen) == 5 and all((drawn == same.choice(40, 16, p=noise)).all() for drawn in seen)


def test_words_are_numbered_as_they_come():
    numbers = lm._Numbers({b"": 0})
    assert [numbers[word] for word in (b"b", b"a", b"b", b"")] == [1, 2, 1, 0]
