"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit borders found in a wavelet matrix.

A unit is a run of ASCII letters or any other single character. A text's
characters become classes, and a letter that begins a run has another class than
one inside it. The wavelet matrix over the classes answers how many characters
of a class stand before a place; added up over all classes that begin a unit, the
ranks count the units begun there. That count never falls, so bisection finds
the place after which a given number of units has ended. One matrix holds the
texts of a whole chunk one after another, and all cuts of the chunk are
searched for at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import pieces, texts

CHUNK_BYTES = 2 << 20

INNER, FIRST, DIGIT, SPACE, MARK, WIDE = range(6)
CLASS_BITS = 3
# Every class but a letter inside a run begins a unit.
BEGINNING = (FIRST, DIGIT, SPACE, MARK, WIDE)

# The marks before the three parts, and the names of the forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

_ASCII = np.full(128, MARK, np.uint8)
_ASCII[48:58] = DIGIT
_ASCII[9:14] = _ASCII[32] = SPACE
_ASCII[65:91] = _ASCII[97:123] = FIRST


class Ranks:
    """How many bits are set before a place: counts up to every 64th place, and the bits of one word beyond it."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def __call__(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Ranks of small symbols: a bit vector a level, and below it the symbols parted stably by their bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for shift in reversed(range(bits)):
            level = (symbols >> shift) & 1
            self.levels.append((shift, Ranks(level), len(level) - int(np.count_nonzero(level))))
            symbols = np.concatenate([symbols[level == 0], symbols[level == 1]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each place."""
        begin = np.zeros(1, np.int64)
        for shift, ones, zeros in self.levels:
            if symbol >> shift & 1:
                begin, at = zeros + ones(begin), zeros + ones(at)
            else:
                begin, at = begin - ones(begin), at - ones(at)
        return at - begin


def classes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of every code point of texts that begin at ``starts``."""
    found = np.full(len(points), WIDE, np.uint8)
    ascii_ = points < 128
    found[ascii_] = _ASCII[points[ascii_]]
    letter = found == FIRST
    inner = np.zeros(len(points), bool)
    inner[1:] = letter[1:] & letter[:-1]
    inner[starts[starts < len(points)]] = False
    found[inner] = INNER
    return found


class Units:
    """The units of texts laid one after another."""

    def __init__(self, values: list[str]):
        points = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(value) for value in values], dtype=np.int64)
        self.starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.ends = ends
        self.matrix = WaveletMatrix(classes(points, self.starts), CLASS_BITS)
        self.base = self.begun(self.starts)
        self.counts = self.begun(self.ends) - self.base

    def begun(self, at: np.ndarray) -> np.ndarray:
        """Units that begin before each place."""
        return sum(self.matrix.rank(kind, at) for kind in BEGINNING)

    def cut_after(self, units: np.ndarray) -> np.ndarray:
        """For each text the place, in its code points, where its first ``units`` units end.

        That is the last place with no more units begun before it.
        """
        low, high = self.starts.copy(), self.ends.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.begun(middle) - self.base <= units
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low - self.starts


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the SHA-256 of seed and id; a NULL id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output), one per row of ``docs``, in one pass without a shuffle.

    ``n`` counts the units. Two draws choose the cuts among the n + 1 borders of
    units, a third leaves the text plain if it is at least ``plain_from`` of 100,
    a fourth chooses suffix-prefix-middle below ``spm_below`` of 100 and
    prefix-suffix-middle otherwise. Empty texts and texts that hold a mark stay
    plain, with NULL lengths.

    A NULL text is empty, a NULL id draws as an empty id. Repeated rows give
    repeated rows and rows of one id the same draws; other columns are ignored,
    an empty table gives an empty one. A text is held whole, five bytes a
    character beside it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK_BYTES):
            ids, values = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            units = Units(values)
            drawn = np.array([draws(doc_id, seed) for doc_id in ids], np.int64).reshape(-1, 4)
            first, second = (drawn[:, i] % (units.counts + 1) for i in (0, 1))
            begins, ends = (units.cut_after(at).tolist() for at in (np.minimum(first, second), np.maximum(first, second)))
            forms, outputs, prefixes, middles = [], [], [], []
            for text, a, b, (_, _, third, fourth) in zip(values, begins, ends, drawn.tolist(), strict=True):
                plain = not text or third % 100 >= plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))
                form = PLAIN if plain else SPM if fourth % 100 < spm_below else PSM
                forms.append(form)
                outputs.append(arranged(text[:a], text[a:b], text[b:], form))
                prefixes.append(None if plain else a)
                middles.append(None if plain else b - a)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(units.counts, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
                pa.array(middles, pa.int64()), pa.array(outputs, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return texts(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def arranged(prefix: str, middle: str, suffix: str, form: str) -> str:
    if form == PSM:
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == SPM:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return prefix + middle + suffix


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text an output was made from. No part holds a mark, so the first mark of a kind ends the part before it."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    body = F.substr(output, F.lit(len(PREFIX) + 1))

    def parts(mark: str) -> tuple[Column, Column, Column]:
        outer = F.split(body, mark, 2)
        inner = F.split(F.get(outer, F.lit(1)), MIDDLE, 2)
        return F.get(outer, F.lit(0)), F.get(inner, F.lit(0)), F.get(inner, F.lit(1))
    prefix, suffix, middle = parts(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
