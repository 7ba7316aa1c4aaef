"""Byte-pair encoding by parts of texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from fleetlens.llm import bpe

from .test_operators import VOCAB


def test_parts_give_the_words_of_whole_texts():
    vocab, draw = bpe.vocabulary(VOCAB), random.Random(3)
    letters = ["a", "b", " ", "  ", "\n", "\t", "\x85", "\xa0", " ", " ", "　", " ", "é", "日", "—", "'s", "'", "1", "!", "\x1c", "<", "|", *vocab.special]
    values = ["", *("".join(draw.choice(letters) for _ in range(draw.randrange(30))) for _ in range(3000)), ""]
    found = bpe.Cut(pa.array(["cut off", *values]).slice(1), vocab)
    ends = np.cumsum([0, *found.words_in])
    for row, text in enumerate(values):
        parts = found.part[found.starts[row]:found.starts[row + 1]]
        assert [found.words[i] for part in parts for i in found.word[ends[part]:ends[part + 1]]] == vocab.words(text)


def test_slots_hold_every_merge_and_no_other():
    vocab, draw = bpe.vocabulary(VOCAB), np.random.default_rng(5)
    assert (vocab.best(vocab.keys >> 20, vocab.keys & 0xFFFFF) == vocab.merges).all()
    left, right = draw.integers(-1, 300, (2, 20, 500))
    held = {int(key): int(merge) for key, merge in zip(vocab.keys, vocab.merges)}
    want = [held.get(a << 20 | b, int(bpe.NO_RANK)) if a >= 0 and b >= 0 else int(bpe.NO_RANK) for a, b in zip(left.ravel().tolist(), right.ravel().tolist())]
    assert vocab.best(left, right).ravel().tolist() == want


def test_ids_that_end_within_a_character_are_read_each_by_itself():
    vocab = bpe.vocabulary(VOCAB)
    packed = [np.array([vocab.first[byte]], "<u4").tobytes() for byte in "é".encode()]
    assert bpe.decode_ids(packed, vocab).to_pylist() == ["�", "�"]
    assert bpe.decode_ids([packed[0] + packed[1], b""], vocab).to_pylist() == ["é", ""]
