"""Sums of gradients by row."""

from __future__ import annotations

import pickle

import numpy as np

from fleetlens.llm import lm


def test_rows_are_added_in_order():
    draw = np.random.default_rng(3)
    rows, values = draw.integers(0, 9, 700), draw.normal(size=(700, 5)).astype(np.float32)
    plain, flat = np.zeros((9, 5), np.float32), np.zeros((9, 5), np.float32)
    np.add.at(plain, rows, values)
    lm._add_rows(flat, rows, values)
    assert (plain == flat).all()


def test_parameters_that_were_sent_to_a_task_are_plain_arrays():
    sent = pickle.loads(pickle.dumps(np.arange(12, dtype=np.float32)))
    shapes = [(2, 2), (1, 2), (2, 2), (2,)]
    model = lm._unpacked(np.zeros(0, np.int64), sent, shapes)
    parts = [model.inputs, model.position, model.outputs, model.bias]
    assert sent.dtype is not np.dtype(np.float32) and all(part.dtype is np.dtype(np.float32) for part in parts)
    assert np.concatenate([part.ravel() for part in parts]).tolist() == list(range(12))
