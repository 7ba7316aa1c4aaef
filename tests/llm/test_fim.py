"""Fill-in-the-middle against regular expressions, and the wavelet matrix against counting."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fleetlens.llm import fim

SCHEMA = "doc_id long, text string, n int, form string"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(make, rows):
    docs = make([(*row, 7, "clash") for row in rows], SCHEMA)
    made = fim.fill_in_middle(docs).withColumn("again", fim.restored())
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in made.collect()), key=str)
    assert got == sorted(((i, *brute(i, t), t or "") for i, t in rows), key=str)


def test_cuts(make):
    texts = ["", None, "a", " ", "ab cd", "<P>not cut", "ends in <", "<", "<S", "\n\n\t.", "naïve café \U0001f600 x", "Ångström" * 30,
             "word " * 500, "1234567890", "A<" * 40, "<M", "P>x<S", "中文 text 中"]
    check(make, [(i, texts[i % len(texts)]) for i in range(400)] + [(None, "no id here"), (None, "no id here"), (4, "ab cd"), (4, "another text")])


def test_long_text_and_nothing(make, odd_documents, no_documents):
    check(make, [(i, f"some words and {i} numbers, über " * 120_000) for i in range(2)])
    assert fim.fill_in_middle(no_documents).collect() == []
    assert fim.fill_in_middle(odd_documents).filter(fim.restored() != F.col("output")).count() >= 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=300), st.integers(0, 5))
def test_ranks(symbols, symbol):
    values = np.array(symbols, np.uint8)
    matrix = fim.WaveletMatrix(values, 3)
    at = np.arange(len(values) + 1)
    assert matrix.rank(symbol, at).tolist() == [0, *np.cumsum(values == symbol).tolist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abZ 1.é\U0001f600\n", max_size=40), min_size=1, max_size=8), st.integers(0, 60))
def test_units(texts, wanted):
    units = fim.Units(texts)
    found = [re.findall(r"[A-Za-z]+|[^A-Za-z]", text) for text in texts]
    assert units.counts.tolist() == list(map(len, found))
    cuts = units.cut_after(np.minimum(wanted, units.counts))
    assert cuts.tolist() == [len("".join(f[:wanted])) for f in found]
